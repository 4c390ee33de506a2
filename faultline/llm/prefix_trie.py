"""The trie of conversation prefixes and its subtree totals, by parallel tree contraction.

A prefix is known by the sum of its turns' digests, each taken together with its place, so
prefixes come from running sums (block-wise, however long a conversation is) and no text is
moved. Totals come from join rounds over the shrinking tree: leaves give their sums to their
parents (rake), then every chain of nodes with one child loses an independent set of its
nodes (compress). Afterwards the rounds are undone from the last to the first, and each node
taken out of a chain gets its child's total plus what it held itself.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.llm.words import stored

BLOCK = 4096  # turns of one conversation summed in one window
CHUNK_CHARS = 1 << 16
DIGITS = "decimal(20,0)"
TURNS = "conv_id long, depth long, turn_hash string, n_chars long, last boolean"


def number_turns(turns: DataFrame, id: str = "conv_id", order: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """conv_id, pos (from 0), turn_hash, n_chars and n_own (turns of the conversation) for each row.

    Turns are numbered by `order`, nulls first, then by the digest of role and text; null
    texts and roles are empty, rows with a null id take no part. Ranges of (id, order) are
    counted and numbered on their own, so a long conversation spreads over many tasks.
    """
    role_text = [F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text)]
    light = turns.filter(F.col(id).isNotNull()).select(
        F.col(id).cast("long").alias("conv_id"), F.col(order).alias("at"),
        F.md5(F.concat(F.char_length(role_text[0]).cast("string"), F.lit(":"), *role_text).cast("binary")).alias("turn_hash"),
        F.char_length(role_text[1]).cast("long").alias("n_chars"), F.monotonically_increasing_id().alias("copy"))
    place = [F.col("at").asc_nulls_first(), F.col("turn_hash"), F.col("copy")]
    ranged = stored(light.repartitionByRange(F.col("conv_id"), *place).withColumn("part", F.spark_partition_id()), "turns")
    whole = Window.partitionBy("conv_id")
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    ranges = ranged.groupBy("part", "conv_id").agg(F.count("*").alias("n")).select(
        "part", "conv_id", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("n_own"))
    inside = F.row_number().over(Window.partitionBy("part", "conv_id").orderBy(*place))
    return ranged.withColumn("inside", inside).join(ranges, ["part", "conv_id"]).select(
        "conv_id", (F.col("before") + F.col("inside") - 1).alias("pos"), "turn_hash", "n_chars", "n_own")


def with_borrowed_heads(numbered: DataFrame, base: Column, heads: Column, most: int) -> tuple[DataFrame, DataFrame]:
    """Rebuilt conversations: the first `heads` turns of conversation `base`, then the own turns after the first `heads`.

    Takes number_turns' rows; `base` and `heads` (0 to `most`) are expressions on conv_id.
    Returns all conversations (conv_id, length) and their turns (TURNS).
    """
    convs = numbered.filter("pos = 0").select("conv_id", "n_own")
    lengths = convs.select(F.col("conv_id").alias("base"), F.col("n_own").alias("n_base"))
    wanted = convs.select("conv_id", "n_own", base.alias("base"), heads.cast("long").alias("heads"))
    plans = wanted.join(lengths, "base", "left").withColumn("n_head", F.least("heads", F.coalesce("n_base", F.lit(0))))
    plans = stored(plans.withColumn("length", F.col("n_head") + F.greatest(F.col("n_own") - F.col("heads"), F.lit(0))), "rebuilt")
    lent = numbered.filter(F.col("pos") < most).select(F.col("conv_id").alias("base"), "pos", "turn_hash", "n_chars")
    first = plans.join(lent, "base").filter("pos < n_head").select("conv_id", (F.col("pos") + 1).alias("depth"), "turn_hash", "n_chars", "length")
    # of a conversation's many rows only the first `most` may go, and depth follows from pos: a join that a hot conversation can be split in
    rest = numbered.join(plans.select("conv_id", "heads", "n_head", "length"), "conv_id").filter("pos >= heads").select(
        "conv_id", (F.col("pos") - F.col("heads") + F.col("n_head") + 1).alias("depth"), "turn_hash", "n_chars", "length")
    turns = first.unionByName(rest).withColumn("last", F.col("depth") == F.col("length")).drop("length")
    return plans.select("conv_id", "length"), turns


def digits(code: Column, start: int) -> Column:
    return F.conv(F.substring(code, start, 16), 16, 10).cast(DIGITS)


def node_key(one: Column, two: Column, depth: Column) -> Column:
    return F.unhex(F.md5(F.concat_ws(",", one.cast("string"), two.cast("string"), depth.cast("string")).cast("binary")))


def prefixes(turns: DataFrame) -> DataFrame:
    """conv_id, depth, key, parent, n_chars, last of each prefix of each conversation."""
    code = F.md5(F.concat_ws(",", "turn_hash", F.col("depth").cast("string")).cast("binary"))
    terms = turns.withColumn("_code", code).withColumns({"t1": digits(F.col("_code"), 1), "t2": digits(F.col("_code"), 17),
                                                         "block": F.floor(F.col("depth") / BLOCK)}).drop("_code", "turn_hash")
    before = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    nought = F.lit(0).cast("decimal(38,0)")
    blocks = terms.groupBy("conv_id", "block").agg(F.sum("t1").alias("s1"), F.sum("t2").alias("s2")).select(
        "conv_id", "block", *[F.coalesce(F.sum(s).over(before).cast("decimal(38,0)"), nought).alias(s) for s in ("s1", "s2")])
    inside = Window.partitionBy("conv_id", "block").orderBy("depth").rowsBetween(Window.unboundedPreceding, 0)
    sums = terms.withColumns({"i1": F.sum("t1").over(inside), "i2": F.sum("t2").over(inside)}).join(blocks, ["conv_id", "block"])
    one, two = ((F.col(f"s{i}") + F.col(f"i{i}")).cast("decimal(38,0)") for i in (1, 2))
    return sums.select("conv_id", "depth", node_key(one, two, F.col("depth")).alias("key"),
                       node_key((one - F.col("t1")).cast("decimal(38,0)"), (two - F.col("t2")).cast("decimal(38,0)"), F.col("depth") - 1).alias("parent"), "n_chars", "last")


ROOT = hashlib.md5(b"0,0,0").digest()  # node_key of the empty prefix


def trie_nodes(convs: DataFrame, paths: DataFrame) -> DataFrame:
    """key, parent (root: null), conv_id, depth, n_convs, n_chars, n_children of each distinct prefix and of the root."""
    inner = paths.groupBy("key").agg(F.min("parent").alias("parent"), F.min("conv_id").alias("conv_id"), F.min("depth").alias("depth"),
                                     F.count("*").alias("n_convs"), F.min("n_chars").alias("n_chars"))
    root = convs.agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_convs")).filter("n_convs > 0").select(
        F.lit(ROOT).alias("key"), F.lit(None).cast("binary").alias("parent"), "conv_id", F.lit(0).cast("long").alias("depth"), "n_convs", F.lit(0).cast("long").alias("n_chars"))
    nodes = stored(inner.unionByName(root), "trie")
    children = nodes.groupBy(F.col("parent").alias("key")).agg(F.count("*").alias("n_children"))
    return stored(nodes.join(children, "key", "left").withColumn("n_children", F.coalesce("n_children", F.lit(0))), "trie")


def subtree_totals(nodes: DataFrame, values: dict[str, Column]) -> DataFrame:
    """key and, for each name, the sum of its value over the node's subtree, the node included.

    nodes: key, parent (null at roots), depth, n_children. Rounds are about the logarithm of
    the longest chain plus that of the bushiest nesting; each works on the nodes left only.
    """
    names = list(values)
    held = {**{f"own_{n}": values[n].cast("long") for n in names}, **{f"up_{n}": F.lit(0).cast("long") for n in names}}
    live = stored(nodes.select("key", "parent", "depth", F.col("n_children").cast("long").alias("left"), *[c.alias(n) for n, c in held.items()]), "contract")
    sizes = live.agg(F.max("depth"), F.count_if(F.col("parent").isNull())).first()
    bits = int(sizes[0] or 0).bit_length()
    rounds: list[tuple[DataFrame, DataFrame]] = []
    while live.count() > sizes[1]:
        after = contract(live, names, len(rounds), bits)
        rounds.append((live, after))
        live = after.filter("child IS NULL").drop("child", *[f"add_{n}" for n in names])
    known = live.select("key", *[F.col(f"own_{n}").alias(n) for n in names])
    for before, after in reversed(rounds):
        known = known.unionByName(before.filter("left = 0 AND parent IS NOT NULL").select("key", *[F.col(f"own_{n}").alias(n) for n in names]))
        taken = after.filter("child IS NOT NULL").select("key", "child", *[f"add_{n}" for n in names])
        if not taken.isEmpty():
            below = known.withColumnRenamed("key", "child")
            known = known.unionByName(stored(taken.join(below, "child").select("key", *[(F.col(n) + F.col(f"add_{n}")).alias(n) for n in names]), "expand"))
    return known


def contract(live: DataFrame, names: list[str], step: int, bits: int) -> DataFrame:
    """One round: leaves raked, then nodes with one child taken out where the coin falls so.

    A chain's nodes are told apart by one binary digit of their depth (all digits in turn),
    later by a hash; no node goes together with its child. Nodes taken out keep their row,
    with `child` set and in add_* what they count beyond that child's total.
    """
    given = live.filter("left = 0 AND parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.count("*").alias("gone"), *[F.sum(F.col(f"own_{n}") + F.col(f"up_{n}")).alias(f"from_{n}") for n in names])
    raked = live.filter("left > 0 OR parent IS NULL").join(given, "key", "left").withColumns(
        {"left": F.col("left") - F.coalesce("gone", F.lit(0)), **{f"own_{n}": F.col(f"own_{n}") + F.coalesce(f"from_{n}", F.lit(0)) for n in names}}).drop(
        "gone", *[f"from_{n}" for n in names])
    if step < bits:
        coin = F.shiftright("depth", step).bitwiseAND(1) == 1
    else:
        coin = F.xxhash64("key", F.lit(step)).bitwiseAND(1) == 1
    raked = raked.withColumn("goes", coin & (F.col("left") == 1) & F.col("parent").isNotNull())
    # of parents with one child left these are that child's own values
    only = raked.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("key")).agg(
        F.min("key").alias("child"), F.max("goes").alias("child_goes"), *[F.min(f"up_{n}").alias(f"child_up_{n}") for n in names])
    out = raked.filter("goes").join(only, "key").filter("NOT child_goes").select(
        "key", "child", "parent", *[F.col(f"own_{n}") + F.col(f"child_up_{n}") for n in names], *[F.col(f"own_{n}") + F.col(f"up_{n}") for n in names])
    out = out.toDF("key", "child", "grandparent", *[f"add_{n}" for n in names], *[f"more_{n}" for n in names])
    changes = out.withColumn("other", F.explode(F.array(F.lit(True), F.lit(False)))).select(
        F.when(F.col("other"), F.col("child")).otherwise(F.col("key")).alias("key"),
        F.when(~F.col("other"), F.col("child")).alias("child"), F.when(F.col("other"), F.col("grandparent")).alias("grandparent"),
        *[F.when(~F.col("other"), F.col(f"add_{n}")).alias(f"add_{n}") for n in names], *[F.when(F.col("other"), F.col(f"more_{n}")).alias(f"more_{n}") for n in names])
    joined = raked.drop("goes").join(changes, "key", "left")
    moved = {"parent": F.coalesce("grandparent", "parent"), **{f"up_{n}": F.col(f"up_{n}") + F.coalesce(f"more_{n}", F.lit(0)) for n in names}}
    return stored(joined.withColumns(moved).drop("grandparent", *[f"more_{n}" for n in names]), "contract")


def joined_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs of sorted (key, conv_id) rows as texts of bounded length: key, first id, comma-joined ids."""
    key, ids, room = None, [], 0
    for batch in batches:
        rows = []
        for own, conv in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if own != key or room > CHUNK_CHARS:
                if ids:
                    rows.append((key, ids[0], ",".join(map(str, ids))))
                key, ids, room = own, [], 0
            ids.append(conv)
            room += 20
        yield chunk_batch(rows)
    if ids:
        yield chunk_batch([(key, ids[0], ",".join(map(str, ids)))])


def chunk_batch(rows: list[tuple[bytes, int, str]]) -> pa.RecordBatch:
    keys, firsts, texts = zip(*rows) if rows else ((), (), ())
    return pa.record_batch([pa.array(keys, pa.binary()), pa.array(firsts, pa.int64()), pa.array(texts, pa.string())], ["key", "first", "ids"])


def digest_chunks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """key and SHA-256 of each key's chunks, in their order, joined by commas."""
    key, code = None, None
    for batch in batches:
        rows = []
        for own, text in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist()):
            if own == key:
                code.update(b",")
            else:
                if key is not None:
                    rows.append((key, code.hexdigest()))
                key, code = own, hashlib.sha256()
            code.update(text.encode())
        yield pa.record_batch([pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())], ["key", "ends_sha256"])
    if key is not None:
        yield pa.record_batch([pa.array([key], pa.binary()), pa.array([code.hexdigest()])], ["key", "ends_sha256"])


def end_digests(ends: DataFrame) -> DataFrame:
    """key and SHA-256 of its conv_ids, ascending and comma-joined; ids become texts in ranges, only texts meet by key."""
    ranged = ends.repartitionByRange("key", "conv_id").sortWithinPartitions("key", "conv_id")
    chunks = ranged.mapInArrow(joined_chunks, "key binary, first long, ids string")
    return chunks.repartition("key").sortWithinPartitions("key", "first").mapInArrow(digest_chunks, "key binary, ends_sha256 string")


def build_trie(convs: DataFrame, turns: DataFrame) -> DataFrame:
    """Every node of the trie of prefixes of the conversations (`convs`: conv_id, length; `turns`: TURNS).

    conv_id (smallest member), depth, parent_conv_id (root: null), n_convs, n_children,
    n_leaves, saved_tokens (over the subtree: members less one times code points of the last
    text), ends_sha256. A conversation without turns is a member of the root alone. Without
    any conversation there is no node. Prefixes are equal when 120 bits of digests are.
    """
    paths = stored(prefixes(turns), "prefixes")
    nodes = trie_nodes(convs, paths)
    totals = subtree_totals(nodes, {"n_leaves": (F.col("n_children") == 0).cast("long"), "saved_tokens": (F.col("n_convs") - 1) * F.col("n_chars")})
    ends = paths.filter("last").select("key", "conv_id").unionByName(convs.filter("length = 0").select(F.lit(ROOT).alias("key"), "conv_id"))
    parents = nodes.select(F.col("key").alias("parent"), F.col("conv_id").alias("parent_conv_id"))
    found = nodes.join(totals, "key").join(end_digests(ends), "key", "left").join(parents, "parent", "left")
    return found.select("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                        F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"))


def conversation_trie(conversations: DataFrame, base: Column, heads: Column, most: int) -> DataFrame:
    """build_trie over the conversations table (conv_id, turn, role, text), each rebuilt with another one's first turns.

    `base` and `heads` (at most `most`) are expressions on conv_id. Columns other than the
    four are left out; repeated rows are turns of their own.
    """
    numbered = stored(number_turns(conversations), "numbered")
    return build_trie(*with_borrowed_heads(numbered, base, heads, most))
