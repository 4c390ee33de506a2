"""Hashed maximum-entropy language model with a class-factored softmax.

Tokens are words and one end per text. The `classes * words` most frequent ones are the
model's words, grouped into classes by frequency; the others share classes by the end of
the word, in which they are told apart by their counts. The class of a token is drawn from a softmax
over hashed features of the text before it (last word, the one before it as a skip, both together), the
word from a softmax over its class with features of the same words. Weights start from counts
and are trained by distributed gradient updates: in each round every task takes its texts of one
share, makes gradient steps on its copy, and the changes are averaged; the rounds visit every share.
The vocabulary and the weights grow with the number of distinct tokens, up to a bound (`sizes`).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.llm.words import FACTOR, Words, between_spaces, mix, pieces, stored, words_of

END = np.uint64(0x0E5D0F7E47000001)  # hash of the end token; no word's in practice
TAIL = 16  # classes of the words outside the model's vocabulary
FLUSH = 1 << 20  # distinct tokens a task holds before it passes their counts on
KNOWN = 1 << 18  # most frequent tokens whose counts are sent to the tasks; the others are joined
TASK_TOKENS = 5_000_000  # training tokens of a task in one round
BATCH = 2048
BLOCK = 256  # weight rows averaged together


def tokens(words: Words) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and tail class of every token, and the first token of each text (and the end)."""
    n = len(words.first) - 1
    first = words.first + np.arange(n + 1)
    hashes, tail = np.full(int(first[-1]), END), np.zeros(int(first[-1]), np.int64)
    at = np.arange(len(words.hash)) + np.repeat(np.arange(n), np.diff(words.first))
    hashes[at] = words.hash
    low = np.arange(256, dtype=np.uint64)
    low[0x41:0x5B] += np.uint64(32)
    last, before = low[words.raw[words.end - 1]], low[words.raw[np.maximum(words.end - 2, words.start)]]
    tail[at] = (mix((last * np.uint64(256) + before + np.uint64(1)) * FACTOR) % np.uint64(TAIL)).astype(np.int64)
    return hashes, tail, first


def token_counts(docs: DataFrame, text: str) -> DataFrame:
    """token, tail, n over all texts of `docs`; a null text has one token, its end."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, held, size = between_spaces(), [], 0

        def packed():
            token, at = np.unique(np.concatenate([h[0] for h in held]), return_index=True)
            order = np.searchsorted(token, np.concatenate([h[0] for h in held]))
            n = np.bincount(order, np.concatenate([h[2] for h in held])).astype(np.int64)
            return token, np.concatenate([h[1] for h in held])[at], n

        def batch_of(token, tail, n):
            return pa.RecordBatch.from_arrays([pa.array(token.view(np.int64)), pa.array(tail), pa.array(n)], ["token", "tail", "n"])

        for batch in batches:
            for a, b in pieces(batch.column(0)):
                hashes, tail, _ = tokens(words_of(batch.column(0).slice(a, b - a), table, lower=True))
                token, at, n = np.unique(hashes, return_index=True, return_counts=True)
                held.append((token, tail[at], n))
                size += len(token)
                if size > FLUSH:
                    held, size = [packed()], 0
                    size = len(held[0][0])
                    if size > FLUSH:
                        yield batch_of(*held[0])
                        held, size = [], 0
        if held:
            yield batch_of(*packed())

    counted = docs.select(text).mapInArrow(run, "token long, tail long, n long")
    return counted.groupBy("token").agg(F.first("tail").alias("tail"), F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int):
    """The tokens of the highest counts, all of a count or none, `most` at the most; sorted by token."""
    sizes = counts.groupBy(F.least("n", F.lit(1 << 20)).alias("n")).count().orderBy(F.desc("n")).toPandas()
    fits = sizes[sizes["count"].cumsum() <= most]["n"]
    least = int(fits.min()) if len(fits) else 1 << 62
    return counts.filter(F.col("n") >= least).select("token", "n").toPandas().sort_values("token")


class Model:
    """Weights and the fixed parts: vocabulary, class sizes, biases."""

    def __init__(self, words: np.ndarray, order: np.ndarray, width: int, class_bias: np.ndarray, word_bias: np.ndarray, a: np.ndarray, b: np.ndarray):
        self.words, self.order, self.width = words, order, width  # sorted hashes, and their ranks
        self.class_bias, self.word_bias, self.a, self.b = class_bias, word_bias, a, b

    def state(self) -> tuple:
        return self.words, self.order, self.width, self.class_bias, self.word_bias, self.a, self.b

    def ranks(self, hashes: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """Vocabulary rank of each token; beyond the vocabulary its size plus the tail class."""
        size = len(self.class_bias[:-TAIL]) * self.width
        if not len(self.words):
            return size + tail
        at = np.minimum(np.searchsorted(self.words, hashes), len(self.words) - 1)
        return np.where(self.words[at] == hashes, self.order[at], size + tail)

    def features(self, rank: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(class of each token, its place in the class, class feature rows, the two words before)."""
        size = len(self.class_bias[:-TAIL]) * self.width
        start = size + TAIL
        one, two = np.full(len(rank), start), np.full(len(rank), start)
        one[1:], two[2:] = rank[:-1], rank[:-2]
        head = first[:-1]
        one[head], two[head] = start, start
        second = head + 1
        two[second[second < first[1:]]] = start
        kind = np.where(rank < size, rank // self.width, size // self.width + rank - size)
        keys = np.stack([one * 4 + 1, two * 4 + 2, (one * (start + 1) + two) * 4 + 3])
        rows = (mix(keys.astype(np.uint64) * FACTOR) & np.uint64(len(self.a) - 1)).astype(np.int64)
        return kind, np.where(rank < size, rank % self.width, -1), rows, np.stack([one, two])

    def word_rows(self, before: np.ndarray, kind: np.ndarray) -> np.ndarray:
        keys = np.stack([(before[i] * len(self.class_bias) + kind) * 2 + i for i in (0, 1)])
        return (mix((keys + 1).astype(np.uint64) * FACTOR) & np.uint64(len(self.b) - 1)).astype(np.int64)

    def logs(self, kind, place, rows, before) -> tuple[np.ndarray, np.ndarray]:
        """Natural logs: of each token's class and, for vocabulary words, of the word in it (else 0)."""
        p = log_chosen(added(self.class_bias, self.a, rows), kind)
        q = np.zeros(len(kind))
        own = np.flatnonzero(place >= 0)
        if len(own):
            w = self.word_rows(before[:, own], kind[own])
            q[own] = log_chosen(added(self.word_bias[kind[own]], self.b, w), place[own])
        return p.astype(np.float64), q

    def step(self, kind, place, rows, before, memory: tuple, rate: float) -> None:
        """One gradient step (Adagrad) on a batch."""
        g = softmax(added(self.class_bias, self.a, rows))
        g[np.arange(len(kind)), kind] -= 1
        update(self.a, memory[0], rows, g, rate)
        own = np.flatnonzero(place >= 0)
        if len(own):
            w = self.word_rows(before[:, own], kind[own])
            g = softmax(added(self.word_bias[kind[own]], self.b, w))
            g[np.arange(len(own)), place[own]] -= 1
            update(self.b, memory[1], w, g, rate)


def added(bias: np.ndarray, weights: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """The bias plus each feature's weight row, in the order of the features."""
    x = weights.take(rows[0], axis=0)
    x += bias
    for feature in rows[1:]:
        x += weights.take(feature, axis=0)
    return x


def log_chosen(x: np.ndarray, chosen: np.ndarray) -> np.ndarray:
    """Log softmax of one column of each row; `x` is used up."""
    x -= x.max(axis=1, keepdims=True)
    own = x[np.arange(len(x)), chosen]
    return own - np.log(np.exp(x, out=x).sum(axis=1))


def softmax(x: np.ndarray) -> np.ndarray:
    """Softmax of each row, in place."""
    x -= x.max(axis=1, keepdims=True)
    np.exp(x, out=x)
    x /= x.sum(axis=1, keepdims=True)
    return x


def update(weights: np.ndarray, memory: np.ndarray, rows: np.ndarray, gradient: np.ndarray, rate: float) -> None:
    """Adds `gradient`, a row per token, to the weight rows of each of the token's features (`rows`: feature by token)."""
    flat = rows.reshape(-1)
    order = np.argsort(flat.astype(np.uint16) if len(weights) <= 1 << 16 else flat, kind="stable")  # 16 bits are sorted by radix
    flat = flat[order]
    cuts = np.flatnonzero(np.diff(flat, prepend=-1))
    order, touched = order % len(gradient), flat[cuts]
    total = gradient.take(order[cuts], axis=0)
    more = np.diff(cuts, append=len(flat)) > 1  # most rows have one token
    if more.any():
        several = np.repeat(more, np.diff(cuts, append=len(flat)))
        flat = flat[several]
        total[more] = np.add.reduceat(gradient.take(order[several], axis=0), np.flatnonzero(np.diff(flat, prepend=-1)), axis=0)
    seen = memory.take(touched, axis=0)
    seen += total * total
    memory[touched] = seen
    seen += np.float32(1e-2)
    total *= np.float32(rate)
    total /= np.sqrt(seen, out=seen)
    weights[touched] -= total


def sizes(distinct: int) -> tuple[int, int]:
    """(words of a class, weight rows) for so many distinct tokens: 64 to 128, 2^14 to 2^16."""
    bits = max(1, distinct).bit_length()
    return int(np.clip(64 + 8 * (bits - 18), 64, 128)), 1 << int(np.clip(bits // 2 + 6, 14, 16))


def round_tasks(tokens: int, shares: int) -> int:
    """Tasks of one round: they follow from the training tokens, not from the cores, so no task and no model update grows with the corpus."""
    return max(1, -(-tokens // (shares * TASK_TOKENS)))


def start_model(counts: DataFrame, classes: int, width: int, rows: int) -> Model:
    """The untrained model: classes and words by count alone. Ties in count go by hash."""
    top = counts.orderBy(F.desc("n"), "token").limit(classes * width).toPandas()
    rank, n = np.arange(len(top)), np.zeros(classes * width)
    n[:len(top)] = top["n"]
    hashes = top["token"].to_numpy().astype(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    n = n.reshape(classes, width)
    all_tails = {r[0]: r[1] for r in counts.groupBy("tail").agg(F.sum(F.col("n") + 1)).collect()}
    in_top = top.assign(n=top["n"] + 1).groupby("tail")["n"].sum().to_dict()
    tails = np.array([all_tails.get(t, 0) - in_top.get(t, 0) + 1 for t in range(TAIL)], np.float64)
    both = np.concatenate([n.sum(axis=1), tails])
    word_bias = np.where(n > 0, np.log(np.maximum(n, 1)), -1e9)
    word_bias[n.sum(axis=1) == 0] = 0
    return Model(hashes[order], rank[order], width, np.log(np.maximum(both, 1e-3)).astype(np.float32), word_bias.astype(np.float32),
                 np.zeros((rows, classes + TAIL), np.float32), np.zeros((rows, width), np.float32)), tails


def train(docs: DataFrame, text: str, share: Column, shares: int, model: Model, rounds: int, rate: float, tasks: int) -> Model:
    """Rounds of gradient updates; round r takes the rows whose `share` is r modulo `shares`, in `tasks` tasks that each send their changes."""
    sc = docs.sparkSession.sparkContext
    schema = T.StructType([T.StructField("block", T.IntegerType()), T.StructField("change", T.BinaryType()), T.StructField("n", T.LongType())])
    for number in range(rounds):
        sent = sc.broadcast(model.state())

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            own, table, seen = Model(*sent.value), between_spaces(), 0
            own.a, own.b = own.a.copy(), own.b.copy()
            memory = np.zeros(own.a.shape, np.float32), np.zeros(own.b.shape, np.float32)
            for batch in batches:
                for a, b in pieces(batch.column(0)):
                    hashes, tail, first = tokens(words_of(batch.column(0).slice(a, b - a), table, lower=True))
                    kind, place, rows, before = own.features(own.ranks(hashes, tail), first)
                    for i in range(0, len(kind), BATCH):
                        j = i + BATCH
                        own.step(kind[i:j], place[i:j], rows[:, i:j], before[:, i:j], memory, rate)
                    seen += len(kind)
            if seen:
                for name, after, was in (("a", own.a, sent.value[5]), ("b", own.b, sent.value[6])):
                    for i in range(0, len(after), BLOCK):
                        change = (after[i:i + BLOCK] - was[i:i + BLOCK]).astype(np.float16)
                        at = i // BLOCK + (len(own.a) // BLOCK + 1) * (name == "b")
                        yield pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([change.tobytes()]), pa.array([seen])], schema.names)

        def average(group):
            n = group.column("n").to_numpy().astype(np.float64)
            total = sum(np.frombuffer(c.as_py(), np.float16).astype(np.float64) * w for c, w in zip(group.column("change"), n))
            return pa.table({"block": group.column("block")[:1], "change": pa.array([(total / n.sum()).astype(np.float32).tobytes()], pa.binary()),
                             "n": pa.array([int(n.sum())], pa.int64())})

        changes = docs.filter(share == number % shares).select(text).coalesce(tasks).mapInArrow(run, schema).groupBy("block").applyInArrow(average, schema)
        a, b = model.a, model.b  # the tasks have their copy
        for block, change, _ in changes.toLocalIterator():
            weights, i = (a, block * BLOCK) if block < len(a) // BLOCK + 1 else (b, (block - len(a) // BLOCK - 1) * BLOCK)
            part = np.frombuffer(bytes(change), np.float32).reshape(-1, weights.shape[1])
            weights[i:i + len(part)] += part
        sent.destroy()
    return model


PARTS = T.StructType([T.StructField("row", T.LongType()), T.StructField("n_tokens", T.LongType()), T.StructField("n_known", T.LongType()),
                      T.StructField("base", T.DoubleType()), T.StructField("score", T.DoubleType()),
                      T.StructField("rest", T.ArrayType(T.StructType([T.StructField(x, T.LongType()) for x in ("token", "tail", "times")])))])


def score_texts(docs: DataFrame, training: DataFrame, key: str = "doc_id", text: str = "text", classes: int = 32, width: int | None = None,
                rows: int | None = None, rounds: int | None = None, shares: int = 4, rate: float = 0.15, known: int = KNOWN) -> DataFrame:
    """key, n_tokens, n_known, train_tokens, base_score, score and all other columns but the text, for every row of `docs`.

    Words are runs between white space, A-Z lower-cased; a null text is empty, so it has the end
    alone. base_score sums log10((c + 1) / (N + V + 1)), c being the token's count in `training`, N
    the number of tokens there and V of distinct ones; score sums the model's log10
    probabilities. An unknown token is one event of its tail class. In each of `rounds` rounds one
    of `shares` parts of the training rows (by a hash of the key and text) is trained on, by default each
    part once; 0 rounds leave the weights untrained. `width` and `rows` follow from the distinct tokens. Counts of the
    most frequent tokens (`known` at the most) go to the tasks; the others are joined with the
    whole count table, so no token is left out. Clashing columns of `docs` are replaced.
    """
    rounds = shares if rounds is None else rounds
    if 0 < rounds < shares:
        raise ValueError("fewer rounds than shares leave training rows out")
    spark = docs.sparkSession
    counts = stored(token_counts(training, text), "token-counts")
    sums = counts.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    total, distinct = sums["n"], sums["v"]
    sized = sizes(distinct)
    model, tails = start_model(counts, classes, width or sized[0], rows or sized[1])
    share = F.pmod(F.xxhash64(key, text, F.lit("share")), F.lit(shares))
    model = train(training, text, share, shares, model, rounds, rate, round_tasks(total, shares))
    top = frequent(counts, known)
    sent = spark.sparkContext.broadcast((model.state(), top["token"].to_numpy().astype(np.int64), top["n"].to_numpy().astype(np.int64), tails))
    made = [f for f in docs.schema.fields if f.name not in (text, "_part", "n_tokens", "n_known", "train_tokens", "base_score", "score")]
    kept = docs.select(*[F.col(f.name) for f in made], F.struct(F.xxhash64(key, text).alias("row"), F.col(text).alias("text")).alias("_part"))
    schema = T.StructType([*made, T.StructField("_part", PARTS)])
    unit = np.log10(total + distinct + 1.0)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, known_token, known_n, tail_sizes = sent.value
        own, table = Model(*state), between_spaces()
        for batch in batches:
            place = batch.schema.get_field_index("_part")
            column, rest = batch.column(place), [c for i, c in enumerate(batch.columns) if i != place]
            texts = column.field(1)
            for a, b in pieces(texts):
                part = scored(own, known_token, known_n, tail_sizes, unit, column.field(0).slice(a, b - a), texts.slice(a, b - a), table)
                yield pa.RecordBatch.from_arrays([*[c.slice(a, b - a) for c in rest], part], schema.names)

    parts = stored(kept.mapInArrow(run, schema), "scored-parts")
    rest = parts.select(F.col("_part.row").alias("row"), F.explode("_part.rest").alias("r")).select("row", "r.*").distinct()
    looked = rest.join(counts.select("token", F.col("n").alias("c")), "token", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    size = F.get(F.array(*[F.lit(float(x)) for x in tails]), F.col("tail").cast("int"))  # tail -1: a vocabulary word, whose score is complete
    late = looked.groupBy(F.col("row").alias("_row")).agg(
        F.sum(F.when(F.col("c") > 0, F.col("times")).otherwise(0)).alias("_known"),
        F.sum(F.col("times") * (F.log10(F.col("c") + 1.0) - F.lit(float(unit)))).alias("_base"),
        F.sum(F.when(F.col("tail") >= 0, F.col("times") * (F.log10(F.col("c") + 1.0) - F.log10(size))).otherwise(0.0)).alias("_score"))
    joined = parts.join(late, F.col("_part.row") == F.col("_row"), "left")
    return joined.select(*[f.name for f in made], "_part.n_tokens", (F.col("_part.n_known") + F.coalesce("_known", F.lit(0))).alias("n_known"),
                         F.lit(total).cast("long").alias("train_tokens"), (F.col("_part.base") + F.coalesce("_base", F.lit(0.0))).alias("base_score"),
                         (F.col("_part.score") + F.coalesce("_score", F.lit(0.0))).alias("score"))


def scored(own: Model, known_token, known_n, tail_sizes, unit: float, row: pa.Array, texts: pa.Array, table) -> pa.StructArray:
    """What a task knows of a batch of texts: sums over tokens with counts at hand, and the rest of the tokens."""
    hashes, tail, first = tokens(words_of(texts, table, lower=True))
    of = np.repeat(np.arange(len(texts)), np.diff(first))
    rank = own.ranks(hashes, tail)
    kind, place, rows, before = own.features(rank, first)
    logs = np.zeros(len(kind))
    for i in range(0, len(kind), BATCH):
        j = i + BATCH
        p, q = own.logs(kind[i:j], place[i:j], rows[:, i:j], before[:, i:j])
        logs[i:j] = (p + q) / np.log(10)
    token, which = np.unique(hashes, return_inverse=True)
    signed = token.view(np.int64)
    at = np.minimum(np.searchsorted(known_token, signed), max(0, len(known_token) - 1))
    here = known_token[at] == signed if len(known_token) else np.zeros(len(signed), bool)
    c = np.where(here, known_n[at], 0)[which] if len(known_token) else np.zeros(len(which))
    here = here[which]
    base = np.where(here, np.log10(c + 1.0) - unit, 0.0)
    logs += np.where(here & (place < 0), np.log10(c + 1.0) - np.log10(tail_sizes[tail]), 0.0)
    n = len(texts)
    lost = np.flatnonzero(~here)
    pair, chosen, times = np.unique(np.stack([of[lost].astype(np.uint64), hashes[lost]]), axis=1, return_index=True, return_counts=True)
    rest = pa.StructArray.from_arrays([pa.array(hashes[lost][chosen].view(np.int64)), pa.array(np.where(place < 0, tail, -1)[lost][chosen]), pa.array(times.astype(np.int64))], ["token", "tail", "times"])
    ends = np.concatenate([[0], np.cumsum(np.bincount(pair[0].astype(np.int64), minlength=n))]).astype(np.int32)
    sums = [np.bincount(of, w, n) for w in (base, logs)]
    return pa.StructArray.from_arrays([row, pa.array(np.diff(first)), pa.array(np.bincount(of, here, n).astype(np.int64)), *map(pa.array, sums),
                                       pa.ListArray.from_arrays(pa.array(ends), rest)], PARTS.names)
