import hashlib
import random
import zlib
from collections import defaultdict

from pyspark.sql import functions as F

from faultline.llm import prefix_trie
from faultline.llm.queries import QUERIES

ROWS = "conv_id long, turn long, role string, text string"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_turns(rows):
    """Turns of each conversation in order; equal turn numbers by the digest that the docstring names."""
    own = defaultdict(list)
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            own[c].append((turn is not None, turn or 0, hashlib.md5(f"{len(role)}:{role}{text}".encode()).hexdigest(), role, text))
    return {c: [t[3:] for t in sorted(ts)] for c, ts in own.items()}


def brute(rows, base=lambda c: c - int(c - 100 * int(c / 100)), heads=lambda c: zlib.crc32(str(c).encode()) % 6):
    own = plain_turns(rows)
    built = {c: own.get(base(c), [])[:heads(c)] + ts[heads(c):] for c, ts in own.items()}
    members = defaultdict(list)
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members[tuple(ts[:d])].append(c)
    out = []
    for path, who in members.items():
        below = [p for p in members if p[:len(path)] == path]
        kids = {p: sum(len(q) == len(p) + 1 and q[:len(p)] == p for q in members) for p in below}
        saved = sum((len(members[p]) - 1) * len(p[-1][1]) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in who if len(built[c]) == len(path))))
        out.append((min(who), len(path), min(members[path[:-1]]) if path else None, len(who), kids[path], sum(k == 0 for k in kids.values()), saved,
                    hashlib.sha256(ends.encode()).hexdigest()))
    return sorted(out, key=str)


def found(spark, rows, schema=ROWS, base="conv_id - conv_id % 100", heads="crc32(cast(cast(conv_id AS string) AS binary)) % 6", most=5):
    base, heads = F.expr(base), F.expr(heads)
    table = spark.createDataFrame(rows, schema)
    return sorted([tuple(r) for r in prefix_trie.conversation_trie(table, base, heads, most).select(NAMES).collect()], key=str)


def test_whole_table(spark, small):
    rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert sorted([tuple(r) for r in QUERIES["op12_prefix_trie"](spark, small).select(NAMES).collect()], key=str) == brute(rows)


def test_nulls_ties_negative_ids_and_turnless(spark):
    """Some conversations borrow from one that is absent and have no turn of their own left."""
    rng = random.Random(3)
    rows = [(c, rng.choice([None, 0, 1, 2]), rng.choice([None, "user", "bot"]), rng.choice([None, "", "a", "é𝄞", "b"])) for c in [*range(-130, -60), *range(90, 140), *range(205, 215)]
            for _ in range(rng.randrange(1, 7))] + [(None, 1, "user", "x")]
    expected = brute(rows)
    assert next(r for r in expected if r[1] == 0)[-1] != hashlib.sha256(b"").hexdigest()
    assert found(spark, rows) == expected


def test_repeated_rows_and_copies(spark):
    rows = [(c, t, "user", "same") for c in range(100, 160) for t in (0, 0, 1)] + [(7, 0, "user", "z" * 200_000), (7, 0, "user", "z" * 200_000)]
    assert found(spark, rows) == brute(rows)


def test_deep_chain_in_few_rounds_and_blocks(spark, monkeypatch):
    """A chain of 700 turns with side branches, each of which keeps its node from being a chain's node at first."""
    monkeypatch.setattr(prefix_trie, "BLOCK", 50)
    steps, contract = [], prefix_trie.contract

    def counted(*a):
        steps.append(1)
        return contract(*a)

    monkeypatch.setattr(prefix_trie, "contract", counted)
    rows = [(1, t, "user", f"t{t}") for t in range(700)]
    for side in range(2, 20):
        rows += [(side, t, "user", f"t{t}") for t in range(30 * side)] + [(side, 1000 + t, "bot", f"s{side} {t}") for t in range(side)]
    got = {(r[0], r[1]): r for r in found(spark, rows, base="conv_id", heads="0", most=0)}
    assert len(steps) <= 16
    assert len(got) == 701 + sum(range(2, 20))
    for d in range(701):
        inside = [s for s in range(2, 20) if d <= 30 * s]
        saved = sum(len(f"t{t}") * sum(t < 30 * s for s in range(2, 20)) for t in range(max(0, d - 1), 700))
        top = got[1, d]
        assert top[3] == 1 + len(inside) and top[5] == 1 + len(inside)
        assert top[6] == saved
    assert all(got[s, 30 * s + 1][5] == 1 for s in range(2, 20))


def test_empty_and_clashing_columns(spark):
    schema = ROWS + ", key string, depth long, pos string, length int, copy int, at int"
    assert found(spark, [], schema) == []
    rows = [(c, t, "user", f"{(c + t) % 3}") for c in range(100, 130) for t in range(4)]
    assert found(spark, [r + ("k", 1, "p", 2, 3, 4) for r in rows], schema) == brute(rows)


def test_long_lists_of_ends_are_joined_in_chunks(spark, monkeypatch):
    rows = [(c, 0, "user", "x") for c in range(-3000, 3000)]
    got = found(spark, rows, base="conv_id", heads="0", most=0)
    ids = ",".join(map(str, range(-3000, 3000)))
    assert [r[1:] for r in got] == [(0, None, 6000, 1, 1, 5999, hashlib.sha256(b"").hexdigest()), (1, -3000, 6000, 0, 1, 5999, hashlib.sha256(ids.encode()).hexdigest())]
    chunks = list(prefix_trie.joined_chunks(iter([prefix_trie.pa.record_batch([prefix_trie.pa.array([b"k"] * 9000), prefix_trie.pa.array(range(9000))], ["key", "conv_id"])])))
    assert sum(b.num_rows for b in chunks) == 3
    assert ",".join(t for b in chunks for t in b.column(2).to_pylist()) == ",".join(map(str, range(9000)))
