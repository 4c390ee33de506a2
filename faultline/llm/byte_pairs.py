"""Byte-level BPE: DuckDB recursive queries over token positions encode, ordered aggregation decodes.

The rank file's path and the pattern that splits texts are parameters; nothing is trained. A
task splits its texts with array operations, keeps the distinct pieces it has met, and
gives only new ones to its own DuckDB connection (one thread, in memory).
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import FACTOR, map_texts, mix, powers

LONG = 64  # bytes, under 128; longer pieces contract equal pairs together
HELD = 1 << 19  # distinct pieces a task remembers, and runs of ids
AT_ONCE = 1 << 13  # new pieces contracted in one query, whose table holds a row per token and step
IDS = 1 << 20  # ids decoded at once
STEP = 1 << 18  # numbers hashed or laid out at once
# the one pattern whose splits are made by array operations; it must equal the tokenizer's
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
ENDINGS = ("s", "t", "re", "ve", "m", "ll", "d")  # after an apostrophe, in the pattern's order

# Each row is a token of a piece and knows its right neighbour; `c` is the rank of the pair, its
# place and its neighbour's (both under 128), so the least `c` is the leftmost pair of minimum rank.
CONTRACT = """
WITH RECURSIVE t(step, piece, pos, id, npos, nid, c) AS (
  SELECT 0, s.piece, s.pos, s.id, s.pos + 1, s.nid, (m::BIGINT << 14) | (pos << 7) | (pos + 1)
  FROM start s LEFT JOIN merges ON k = ((id::BIGINT << 20) | nid)
  UNION ALL
  SELECT * FROM (
    WITH hit AS (SELECT piece, min(c) AS c FROM t GROUP BY piece HAVING min(c) IS NOT NULL),
    link AS (SELECT h.piece, ((h.c >> 7) & 127)::INT AS pos, (h.c >> 14)::INT AS m, g.pos AS gone, g.npos AS after, g.nid AS nafter
             FROM hit h JOIN t g ON g.piece = h.piece AND g.pos = (h.c & 127)),
    moved AS (SELECT t.step + 1 AS step, t.piece, t.pos,
        CASE WHEN t.pos = l.pos THEN l.m ELSE t.id END AS id,
        CASE WHEN t.pos = l.pos THEN l.after ELSE t.npos END AS npos,
        CASE WHEN t.pos = l.pos THEN l.nafter WHEN t.npos = l.pos THEN l.m ELSE t.nid END AS nid,
        CASE WHEN t.pos = l.pos OR t.npos = l.pos THEN NULL ELSE t.c END AS c,
        t.pos = l.pos OR t.npos = l.pos AS fresh
      FROM t JOIN link l ON t.piece = l.piece WHERE t.pos <> l.gone)
    SELECT v.step, v.piece, v.pos, v.id, v.npos, v.nid, CASE WHEN v.fresh THEN (m::BIGINT << 14) | (pos << 7) | npos ELSE c END
    FROM moved v LEFT JOIN merges ON k = CASE WHEN fresh THEN (id::BIGINT << 20) | nid END)
), last AS (SELECT piece, max(step) AS s FROM t GROUP BY piece)
SELECT t.piece, t.pos, t.id FROM t JOIN last ON t.piece = last.piece AND t.step = last.s ORDER BY t.piece, t.pos
"""

# For long pieces: all pairs of the minimum rank, left to right without overlap, up to and with
# the first whose contraction makes a pair of lower rank. One at a time would do the same.
CONTRACT_LONG = """
WITH RECURSIVE t(step, piece, pos, id) AS (
  SELECT 0, piece, pos, id FROM start
  UNION ALL
  SELECT * FROM (
    WITH p AS (SELECT *, lead(id) OVER w AS nid, lead(pos) OVER w AS npos, lead(id, 2) OVER w AS nnid, lag(id) OVER w AS lid,
                 row_number() OVER w AS i FROM t WINDOW w AS (PARTITION BY piece ORDER BY pos)),
    ranked AS (SELECT p.*, m, min(m) OVER (PARTITION BY piece) AS lo FROM p JOIN merges ON k = ((id::BIGINT << 20) | nid)),
    runs AS (SELECT *, i - row_number() OVER (PARTITION BY piece ORDER BY i) AS run FROM ranked WHERE m = lo),
    picked AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY piece, run ORDER BY i) AS r FROM runs) WHERE r % 2 = 1),
    sides AS (SELECT *, CASE WHEN lag(i) OVER (PARTITION BY piece ORDER BY i) = i - 2 THEN lo ELSE lid END AS near FROM picked),
    judged AS (SELECT s.*, coalesce(a.m < s.lo, false) OR coalesce(b.m < s.lo, false) AS lower
               FROM sides s LEFT JOIN merges a ON a.k = ((near::BIGINT << 20) | s.lo) LEFT JOIN merges b ON b.k = ((s.lo::BIGINT << 20) | nnid)),
    done AS (SELECT piece, pos, npos, lo FROM (
               SELECT *, coalesce(sum(lower::INT) OVER (PARTITION BY piece ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM judged)
             WHERE before = 0),
    busy AS (SELECT DISTINCT piece FROM done)
    SELECT p.step + 1, p.piece, p.pos, coalesce(d.lo, p.id)::INT FROM p SEMI JOIN busy b ON p.piece = b.piece
      LEFT JOIN done d ON p.piece = d.piece AND p.pos = d.pos ANTI JOIN done g ON p.piece = g.piece AND p.pos = g.npos)
), last AS (SELECT piece, max(step) AS s FROM t GROUP BY piece)
SELECT t.piece, t.pos, t.id FROM t JOIN last ON t.piece = last.piece AND t.step = last.s ORDER BY t.piece, t.pos
"""

# Runs lie end to end, so one ordered aggregation gives the bytes of them all.
DECODE = "SELECT string_agg(h, '' ORDER BY i.pos) FROM ids i JOIN vocab USING (id)"


def read_ranks(path: str) -> dict[bytes, int]:
    """Token bytes to rank, from a rank file (a base64 token and its rank per line)."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


def connect(ranks: dict[bytes, int]):
    """A connection with the vocabulary and the merge table: every split of a token into two tokens."""
    con = duckdb.connect(config={"threads": 1})
    merges = [((left << 20) | right, rank) for token, rank in ranks.items() for i in range(1, len(token))
              if (left := ranks.get(token[:i])) is not None and (right := ranks.get(token[i:])) is not None]
    con.register("made", pa.table({"k": pa.array([x[0] for x in merges], pa.int64()), "m": pa.array([x[1] for x in merges], pa.int32())}))
    con.execute("CREATE TABLE merges AS SELECT * FROM made")
    con.register("made", pa.table({"id": pa.array(list(ranks.values()), pa.int32()), "h": [t.hex() for t in ranks]}))
    con.execute("CREATE TABLE vocab AS SELECT * FROM made")
    con.unregister("made")
    return con


def contract(con, todo: list[bytes], byte_id: np.ndarray, query: str) -> list[bytes]:
    """Token ids of each piece (none is empty), as 32-bit integers."""
    if not todo:
        return []
    length = np.array([len(x) for x in todo])
    ids = byte_id[np.frombuffer(b"".join(todo), np.uint8)]
    piece = np.repeat(np.arange(len(todo), dtype=np.int32), length)
    pos = (np.arange(len(ids)) - np.repeat(np.cumsum(length) - length, length)).astype(np.int32)
    ends = np.append(piece[1:] != piece[:-1], True)
    con.register("start", pa.table({"piece": piece, "pos": pos, "id": ids, "nid": pa.array(np.append(ids[1:], 0).astype(np.int32), mask=ends)}))
    got = con.execute(query).fetchnumpy()
    con.unregister("start")
    cuts = (4 * np.searchsorted(got["piece"], np.arange(len(todo) + 1))).tolist()
    raw = np.asarray(got["id"]).astype(np.int32).tobytes()
    return [raw[a:b] for a, b in zip(cuts, cuts[1:])]


def class_table() -> np.ndarray:
    """Letters 0, numbers 1, others 2, white space 3, by code point."""
    table = np.full(0x110000, 2, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for number, kind in enumerate((r"\p{L}", r"\p{N}")):
        table[[ord(c) for c in regex.findall(kind, points)]] = number
    table[[ord(c) for c in regex.findall(r"\s", points)]] = 3
    return table


def split_points(code: np.ndarray, first: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Where the pattern's matches start in texts laid end to end; `first` marks text starts.

    Matches are runs of one class; a blank before a run joins it; in longer white space
    the last character splits off if something follows; an apostrophe that starts a match
    takes a short ending from the letters behind it.
    """
    n = len(code)
    kind = table[code]
    start = np.ones(n, bool)
    start[1:] = (kind[1:] != kind[:-1]) | first[1:]
    space = kind == 3
    follows = np.zeros(n, bool)  # white space right before something else of the same text
    follows[:-1] = space[:-1] & ~space[1:] & ~first[1:]
    start |= follows  # it is split from the white space before it
    joins = np.zeros(n, bool)
    joins[1:] = follows[:-1] & (code[:-1] == 32)
    start &= ~joins
    quote = np.flatnonzero((code == 39) & start)
    room = np.append(np.flatnonzero(first), n)
    until = room[np.searchsorted(room, quote, "right")] if len(quote) else quote
    open_ = np.ones(len(quote), bool)
    for ending in ENDINGS:
        good = open_ & (quote + len(ending) < until)
        for j, c in enumerate(ending, 1):
            good &= code[np.minimum(quote + j, n - 1)] == ord(c)
        at = quote[good]
        for j in range(1, len(ending) + 1):
            start[at + j] = False
        after = at + len(ending) + 1
        start[after[after < n]] = True
        open_ &= ~good
    return np.flatnonzero(start)


class Store:
    """Runs of numbers by their 64-bit hash, in sorted arrays: some 30 bytes for a short run, where a dict takes 200."""

    def __init__(self, kind):
        self.kind = kind
        self.clear()

    def clear(self) -> None:
        self.key, self.first = np.zeros(0, np.uint64), np.zeros(0, np.int64)
        self.size, self.flat = np.zeros(0, np.int32), np.zeros(0, self.kind)

    def missing(self, keys: np.ndarray) -> np.ndarray:
        """Places of the keys that are not held."""
        if not len(self.key):
            return np.arange(len(keys))
        at = np.minimum(np.searchsorted(self.key, keys), len(self.key) - 1)
        return np.flatnonzero(self.key[at] != keys)

    def add(self, keys: np.ndarray, size: np.ndarray, flat: np.ndarray) -> None:
        """Takes up new keys, in ascending order, and their runs end to end; a size of -1 has no numbers."""
        if not len(keys):
            return
        held = np.maximum(size, 0).astype(np.int64)
        at = np.searchsorted(self.key, keys)
        self.first = np.insert(self.first, at, len(self.flat) + np.cumsum(held) - held)
        self.size = np.insert(self.size, at, size)
        self.flat = np.concatenate([self.flat, flat.astype(self.kind, copy=False)])
        self.key = np.insert(self.key, at, keys)

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(where its run begins, its size) of each key; all are held."""
        at = np.searchsorted(self.key, keys)
        return self.first[at], self.size[at]


def steps(size: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of runs of about `STEP` numbers; a longer run is a range of its own."""
    ends, a = np.cumsum(size), 0
    while a < len(size):
        b = max(a + 1, int(np.searchsorted(ends, (ends[a - 1] if a else 0) + STEP, "right")))
        yield a, b
        a = b


def laid(flat: np.ndarray, first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The runs of `flat` that begin at `first`, end to end."""
    out, done = np.empty(int(size.sum()), flat.dtype), 0
    for a, b in steps(size):
        own = size[a:b].astype(np.int64)
        n = int(own.sum())
        out[done:done + n] = flat[np.repeat(first[a:b] - (np.cumsum(own) - own), own) + np.arange(n)]
        done += n
    return out


def run_hashes(codes, start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Hash of each run; runs are not empty and lie end to end from 0, `codes(a, b)` gives the numbers from a to b, spread over 64 bits."""
    out = np.empty(len(start), np.uint64)
    power = powers(0xD6E8FEB86659FD93, min(1 << 16, int(size.max(initial=0)) + 1))
    for a, b in steps(size):
        at, n = start[a:b] - start[a], int(size[a:b].sum())
        place = np.arange(n) - np.repeat(at, size[a:b])
        out[a:b] = np.add.reduceat(codes(int(start[a]), int(start[a]) + n) * power[place & 0xFFFF], at)
    return mix(out + size.astype(np.uint64))


class Encoder:
    """Pieces a task has met, with their ids."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, con=None):
        self.ranks, self.con, self.ids = ranks, con or connect(ranks), Store(np.int32)
        self.random = mix((np.arange(0x110000, dtype=np.uint64) + np.uint64(1)) * FACTOR)  # by code point
        self.byte_id = np.array([ranks[bytes([i])] for i in range(256)], np.int32)
        self.table = class_table() if pattern == PATTERN else None
        self.pattern = regex.compile(pattern)

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, str, np.ndarray, np.ndarray, np.ndarray]:
        """(text of each piece, all pieces end to end, start and size of each, hashes)."""
        if self.table is None:
            found = [[p for p in self.pattern.findall(t) if p] for t in texts]
            joined = "".join(p for x in found for p in x)
            size = np.array([len(p) for x in found for p in x], np.int64)
            row, start = np.repeat(np.arange(len(texts)), [len(x) for x in found]), np.cumsum(size) - size
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        else:
            joined, length = "".join(texts), np.array([len(t) for t in texts], np.int64)
            code = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
            ends = np.cumsum(length)
            first = np.zeros(len(code), bool)
            first[(ends - length)[length > 0]] = True
            start = split_points(code, first, self.table) if len(code) else np.zeros(0, np.int64)
            size = np.diff(start, append=len(code))
            row = np.searchsorted(ends, start, "right")
        return row, joined, start, size, run_hashes(lambda a, b: self.random[code[a:b]], start, size)

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts, number of ids of each text)."""
        row, joined, start, size, hashes = self.pieces(texts)
        keys, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.ids.key) > HELD:
            self.ids.clear()
        new = self.ids.missing(keys)
        begins = start[chosen[new]]
        self.learn(keys[new], [joined[a:b].encode() for a, b in zip(begins.tolist(), (begins + size[chosen[new]]).tolist())])
        first, length = self.ids.find(keys)
        length = length[which]
        return laid(self.ids.flat, first[which], length), np.bincount(row, length, len(texts)).astype(np.int64)

    def learn(self, keys: np.ndarray, pieces: list[bytes]) -> None:
        """Ids of new pieces: a token is itself, all others are contracted."""
        ids = [None if (rank := self.ranks.get(p)) is None else rank.to_bytes(4, "little") for p in pieces]
        todo = [i for i, known in enumerate(ids) if known is None]
        for query, part in ((CONTRACT, [i for i in todo if len(pieces[i]) <= LONG]), (CONTRACT_LONG, [i for i in todo if len(pieces[i]) > LONG])):
            for a in range(0, len(part), AT_ONCE):
                some = part[a:a + AT_ONCE]
                for i, got in zip(some, contract(self.con, [pieces[i] for i in some], self.byte_id, query)):
                    ids[i] = got
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        self.ids.add(keys, size, np.frombuffer(b"".join(ids), "<i4"))


def encode(docs: DataFrame, ranks_path: str, pattern: str = PATTERN, text: str = "text", out: str = "ids") -> DataFrame:
    """Adds `ids`, the token ids (array of int) of each text; special tokens are ordinary text.

    Each match of `pattern` is encoded on its own, as the tiktoken library does: a match
    that is a token is that token, others start as bytes, whose leftmost pair of
    minimum rank is contracted until no pair is in the merge table. A null or empty text has no
    ids; repeated rows stay; columns pass through, an older `ids` is replaced. The rank
    file is read on the driver and sent once (its size is that of the vocabulary).
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = Encoder(sent.value, pattern)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, per_row = coder.encode([t or "" for t in texts.to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            return [pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))]

        return work

    kind = T.StructType([T.StructField("ids", T.ArrayType(T.IntegerType()))])
    made = map_texts(docs.drop(out), text, "_coded", kind, start)
    return made.withColumn(out, F.col("_coded.ids")).drop("_coded")


def decode(coded: DataFrame, ranks_path: str, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """Adds `decoded`, the bytes (binary) of an array of token ids.

    Arrays are cut before tokens that begin with a blank; DuckDB joins each distinct run a task
    meets with the vocabulary and aggregates the bytes in order of position; runs are laid end
    to end. An empty array gives no bytes, a null array or an unknown id a null.
    """
    kept = coded.drop(out)
    sent = coded.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))
    schema = T.StructType([*kept.schema.fields, T.StructField(out, T.BinaryType())])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Decoder(sent.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            size = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False))
            a = 0
            while a < len(batch):
                b = max(a + 1, int(np.searchsorted(size, (size[a - 1] if a else 0) + IDS, "right")))
                yield pa.RecordBatch.from_arrays([*batch.slice(a, b - a).columns, coder.decode(column.slice(a, b - a))], schema.names)
                a = b

    return kept.mapInArrow(work, schema)


def encode_decode(docs: DataFrame, ranks_path: str, derive, kind: T.StructType, pattern: str = PATTERN, text: str = "text",
                  out: str = "coded") -> DataFrame:
    """Adds struct `coded`: what `derive` makes of the ids (Arrow lists) and the bytes decoded from them, both as above.

    For results smaller than ids and bytes: those stay in the task, which keeps one connection.
    """
    sent = docs.sparkSession.sparkContext.broadcast(read_ranks(ranks_path))

    def start():
        coder = Encoder(sent.value, pattern)
        back = Decoder(sent.value, coder.con)

        def work(texts: pa.Array) -> list[pa.Array]:
            ids, per_row = coder.encode([t or "" for t in texts.to_pylist()])
            ends = pa.array(np.concatenate([[0], np.cumsum(per_row)]).astype(np.int32))
            column = pa.ListArray.from_arrays(ends, pa.array(ids, pa.int32()))
            return derive(column, back.decode(column))

        return work

    return map_texts(docs, text, out, kind, start)


class Decoder:
    """Runs of ids a task has met, with their bytes."""

    def __init__(self, ranks: dict[bytes, int], con=None):
        self.con, self.bytes = con or connect(ranks), Store(np.uint8)
        # by id, and for unknown ones at the end
        self.opens = np.zeros(max(ranks.values(), default=0) + 2, bool)
        self.opens[[i for t, i in ranks.items() if t[:1] == b" "]] = True
        self.width = np.full(len(self.opens), -1, np.int32)
        self.width[list(ranks.values())] = [len(t) for t in ranks]

    def decode(self, column: pa.Array) -> pa.Array:
        column = column.cast(pa.list_(pa.int64()))
        length = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        flat = column.flatten().to_numpy(zero_copy_only=False)
        if not len(flat):
            return pa.array([b"" if x.is_valid else None for x in column], pa.binary())
        row_end = np.cumsum(length)
        begins = self.opens[np.clip(flat, -1, len(self.opens) - 1)]
        begins[(row_end - length)[length > 0]] = True
        start = np.flatnonzero(begins)
        size = np.diff(start, append=len(flat))
        hashes = run_hashes(lambda a, b: mix((flat[a:b].view(np.uint64) + np.uint64(1)) * FACTOR), start, size)
        keys, chosen, which = np.unique(hashes, return_index=True, return_inverse=True)
        if len(self.bytes.key) > HELD:
            self.bytes.clear()
        new = self.bytes.missing(keys)
        self.look_up(keys[new], laid(flat, start[chosen[new]], size[chosen[new]]), size[chosen[new]])
        first, held = self.bytes.find(keys)
        lost, held = held[which] < 0, np.maximum(held, 0)[which]
        row = np.searchsorted(row_end, start, "right")
        ends = np.concatenate([[0], np.cumsum(np.bincount(row, held, len(length)))]).astype(np.int32)
        data = laid(self.bytes.flat, first[which], held)
        bad = np.bincount(row, lost, len(length)) > 0
        valid = ~bad & column.is_valid().to_numpy(zero_copy_only=False)
        bits = pa.py_buffer(np.packbits(valid, bitorder="little").tobytes())
        return pa.Array.from_buffers(pa.binary(), len(length), [bits, pa.py_buffer(ends), pa.py_buffer(data)])

    def look_up(self, keys: np.ndarray, ids: np.ndarray, size: np.ndarray) -> None:
        """Bytes of new runs of ids, which lie end to end; a run with an unknown id has none."""
        if not len(keys):
            return
        width = self.width[np.clip(ids, -1, len(self.width) - 1)]
        at = np.cumsum(size) - size
        lost = np.minimum.reduceat(width, at) < 0
        held = np.where(lost, -1, np.add.reduceat(width, at, dtype=np.int64))
        ids, found = ids[np.repeat(~lost, size)], []
        for a in range(0, len(ids), IDS):
            some = ids[a:a + IDS]
            self.con.register("ids", pa.table({"id": some.astype(np.int32), "pos": np.arange(len(some), dtype=np.int32)}))
            found.append(bytes.fromhex(self.con.execute(DECODE).fetchall()[0][0]))
            self.con.unregister("ids")
        self.bytes.add(keys, held, np.frombuffer(b"".join(found), np.uint8))
