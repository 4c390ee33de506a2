"""Density clustering of alerts, exact, per run.

Equal vectors are merged into one weighted vector. Space is cut in halves along its widest
side, again and again, until a part holds few vectors; a part also gets a copy of the
vectors within eps of it (its halo), so it sees every neighbour of its own vectors. A part
too dense to be cut is dealt into blocks, and each pair of blocks is a task. A first pass
over the parts adds up the weight around each vector; a second joins core vectors to local
components, and components of different parts that share a vector are one cluster. What is
passed on is one row per vector and task, never a pair of vectors.
"""

from __future__ import annotations

from collections.abc import Callable
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.alerts import assign_incident_id
from faultline.operators.ordering import positions
from faultline.operators.scaling import clustering_columns, standard_scale
from faultline.session import cut_lineage, sized_side

EXACT_PAIRS = 20_000_000  # vector pairs that one task compares
LEAST_BLOCK = 32
MOST_CUTS = 60  # of one part
CHUNK_VALUES = 4_000_000  # distances held at once in a task


SMALL_LABELS = 500_000  # cells; up to here the label table (16 bytes a row) goes to every task


def connected_components(nodes: DataFrame, edges: DataFrame, rounds: int = 3) -> DataFrame:
    """(id, comp): the smallest id reachable.

    Every node has an edge to itself, so one join and one minimum spread the
    labels a step further. After a few steps each label is replaced by its own
    label, which doubles the distance covered; the table is then written.
    """
    own = nodes.select(F.col("id").alias("a"), F.col("id").alias("b"))
    both = cut_lineage(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
                       .distinct().unionByName(own))
    small = both.filter("a = b").count() <= SMALL_LABELS
    labels = both.filter("a = b").select(F.col("a").alias("id"), F.col("a").alias("comp"))

    def spread(at: DataFrame) -> DataFrame:
        return F.broadcast(at) if small else at

    while True:
        step = labels.withColumn("_old", F.col("comp"))
        for _ in range(rounds):
            step = (both.join(spread(step.withColumnRenamed("id", "b")), "b").groupBy(F.col("a").alias("id"))
                    .agg(F.min("comp").alias("comp"), F.max(F.when(F.col("a") == F.col("b"), F.col("_old"))).alias("_old")))
        jump = labels.select(F.col("id").alias("comp"), F.col("comp").alias("_next"))
        moved = cut_lineage(step.join(spread(jump), "comp").select("id", "_old", F.least("comp", "_next").alias("comp")))
        labels = moved.select("id", "comp")
        if moved.filter(F.col("comp") != F.col("_old")).isEmpty():
            return labels


def within(a: np.ndarray, b: np.ndarray, eps2: float) -> np.ndarray:
    """Which vectors of `a` and `b` are no farther apart than eps; what rounding leaves open is computed by differences."""
    a2, b2 = (a * a).sum(1), (b * b).sum(1)
    fast = a2[:, None] + b2[None, :] - 2 * (a @ b.T)
    near = fast <= eps2
    slack = 1e-9 * (a2.max(initial=0.0) + b2.max(initial=0.0) + eps2)
    i, j = np.nonzero(np.abs(fast - eps2) <= slack)
    for k in range(0, len(i), CHUNK_VALUES // max(1, a.shape[1])):
        part = slice(k, k + CHUNK_VALUES // max(1, a.shape[1]))
        gap = a[i[part]] - b[j[part]]
        near[i[part], j[part]] = (gap * gap).sum(-1) <= eps2
    return near


def weight_around(x: np.ndarray, others: np.ndarray, weight: np.ndarray, eps2: float, enough: int) -> np.ndarray:
    """Weight of the `others` within eps of each vector; a vector that has enough is not looked at again."""
    total = np.zeros(len(x), np.int64)
    step = 1024
    for k in range(0, len(others), step):
        open_ = np.flatnonzero(total < enough)
        for m in range(0, len(open_), CHUNK_VALUES // step):
            rows = open_[m:m + CHUNK_VALUES // step]
            total[rows] += within(x[rows], others[k:k + step], eps2) @ weight[k:k + step]
    return total


def local_components(x: np.ndarray, core: np.ndarray, uid: np.ndarray, eps2: float) -> np.ndarray:
    """Smallest uid of each core vector's component among the given ones (-1: not core)."""
    label = np.full(len(x), -1, np.int64)
    unseen = np.flatnonzero(core)
    unseen = unseen[np.argsort(uid[unseen])]
    while len(unseen):
        name, wave, unseen = uid[unseen[0]], unseen[:1], unseen[1:]
        label[wave] = name
        while len(wave):
            step = max(1, CHUNK_VALUES // max(1, len(unseen)))
            now, wave = wave[:step], wave[step:]
            hit = within(x[now], x[unseen], eps2).any(axis=0)
            label[unseen[hit]] = name
            wave, unseen = np.concatenate([wave, unseen[hit]]), unseen[~hit]
    return label


def _vectors(table: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Vectors, uids, weights, and which rows are a part's own, and which are to be seen, in this task."""
    x = table.column("x").combine_chunks()
    flat = x.flatten().to_numpy(zero_copy_only=False).reshape(len(x), -1)
    home = table.column("home").to_numpy() & (table.column("side").to_numpy() != 2)
    return flat, table.column("uid").to_numpy(), table.column("w").to_numpy(), home, table.column("side").to_numpy() != 1


def _count_task(eps2: float, min_samples: int) -> Callable[[pa.Table], pa.Table]:
    def count(table: pa.Table) -> pa.Table:
        x, uid, w, home, seen = _vectors(table)
        return pa.table({"uid": uid[home], "around": weight_around(x[home], x[seen], w[seen], eps2, min_samples)})

    return count


def _link_task(eps2: float) -> Callable[[pa.Table], pa.Table]:
    """(uid, label, core): core vectors with their local component, others of the part with each component they touch."""
    def link(table: pa.Table) -> pa.Table:
        x, uid, _, home, seen = _vectors(table)
        core = table.column("core").to_numpy(zero_copy_only=False).astype(bool)
        label = local_components(x, core, uid, eps2)
        inner, rim = np.flatnonzero(core), np.flatnonzero(home & ~core)
        uids, labels, flags = [uid[inner]], [label[inner]], [np.ones(len(inner), bool)]
        step = max(1, CHUNK_VALUES // max(1, len(inner)))
        for k in range(0, len(rim), step):
            r, c = np.nonzero(within(x[rim[k:k + step]], x[inner], eps2))
            pairs = np.unique(np.stack([uid[rim[k:k + step]][r], label[inner][c]]), axis=1)
            uids.append(pairs[0])
            labels.append(pairs[1])
            flags.append(np.zeros(pairs.shape[1], bool))
        return pa.table({"uid": np.concatenate(uids), "label": np.concatenate(labels), "core": np.concatenate(flags)})

    return link


def _spread(dims: int) -> Column:
    """Width of a part in each dimension."""
    return F.expr("array(" + ", ".join(f"max(x[{i}]) - min(x[{i}])" for i in range(dims)) + ")")


def halo_parts(vectors: DataFrame, group: list[str], dims: int, eps: float, block: int) -> tuple[DataFrame, bool]:
    """Vectors with their part (`leaf`), whether it is their own (`home`), and the task (`i`, `j`, `side`); and whether anything was cut.

    A part of more than `block` vectors is halved at the median of its widest dimension, as
    long as that is wider than four eps and the last cut made it smaller by a tenth. In a task
    (i, j) the own vectors of block i (side 1) meet those of block j (side 2); in (i, i) a row
    is both (side 0).
    """
    part = [*group, "leaf"]
    halo = eps * (1 + 1e-9)
    rows = vectors.withColumns({"leaf": F.lit(1).cast("long"), "home": F.lit(True), "before": F.lit(None).cast("long")})
    largest = rows.groupBy(*part).agg(F.count("*").alias("n")).agg(F.max("n")).first()[0] or 0
    cuts = 0
    while largest > block and cuts < MOST_CUTS:
        size = rows.groupBy(*part).agg(F.count("*").alias("n"), F.first("before").alias("before"), _spread(dims).alias("wide")).filter(F.col("n") > block)
        size = size.filter((F.array_max("wide") > 4 * eps) & (F.col("before").isNull() | (F.col("n") < 0.9 * F.col("before"))))
        size = size.select(*part, "n", F.array_position("wide", F.array_max("wide")).cast("int").alias("dim"))
        cut = sized_side(rows.join(size, part).groupBy(*part).agg(F.percentile_approx(F.element_at("x", F.col("dim")), 0.5).alias("cut"),
                                                                  F.first("dim").alias("dim"), F.first("n").alias("n")))
        if cut.isEmpty():
            break
        at = F.element_at("x", F.col("dim"))
        lower = F.when(at <= F.col("cut") + halo, F.struct((F.col("leaf") * 2).alias("leaf"), (F.col("home") & (at <= F.col("cut"))).alias("home"), F.col("n").alias("before")))
        upper = F.when(at >= F.col("cut") - halo, F.struct((F.col("leaf") * 2 + 1).alias("leaf"), (F.col("home") & (at > F.col("cut"))).alias("home"), F.col("n").alias("before")))
        same = F.struct("leaf", "home", F.lit(0).cast("long").alias("before"))
        halves = F.when(F.col("cut").isNull(), F.array(same)).otherwise(F.filter(F.array(lower, upper), lambda h: h.isNotNull()))
        rows = cut_lineage(rows.join(cut, part, "left").select(*vectors.columns, F.inline(halves)))
        cuts += 1
    rows = rows.drop("before")
    if largest <= block:
        return rows.withColumns({"i": F.lit(0), "j": F.lit(0), "side": F.lit(0)}), False
    blocks = sized_side(rows.groupBy(*part).agg(F.ceil(F.count("*") / block).cast("int").alias("blocks")).filter("blocks > 1"))
    rows = rows.join(blocks, part, "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    own = F.pmod(F.xxhash64("uid"), F.col("blocks")).cast("int")
    entry = lambda i, j, side: F.struct(i.alias("i"), j.alias("j"), F.lit(side).alias("side"))
    others = F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda b: b != F.col("own"))
    tasks = F.concat(F.array(entry(F.col("own"), F.col("own"), 0)), F.when(F.col("home"), F.transform(others, lambda b: entry(F.col("own"), b, 1))).otherwise(F.array()),
                     F.transform(others, lambda b: entry(b, F.col("own"), 2)))
    return rows.withColumn("own", own).select("*", F.inline(tasks)).drop("own", "blocks"), True


def dbscan(points: DataFrame, group: list[str], coords: list[str], order: list[str],
           eps: float = 0.8, min_samples: int = 3) -> DataFrame:
    """Add `cluster_id`: -1 for noise, else numbered per group by the first core point in `order`.

    A point counts itself; distances up to and including eps are neighbours; a
    border point joins the lowest-numbered cluster it touches.
    """
    eps2 = eps * eps
    pts = points.withColumn("_x", F.expr("array(" + ", ".join(f"`{c}` + 0D" for c in coords) + ")"))
    uniq = cut_lineage(pts.groupBy(*group, F.col("_x").alias("x")).agg(F.count(F.lit(1)).alias("w"), F.min(F.struct(*order)).alias("first"))
                       .withColumn("uid", F.monotonically_increasing_id()))
    block = max(LEAST_BLOCK, isqrt(EXACT_PAIRS))
    parts, cut = halo_parts(uniq.select(*group, "uid", "x", "w"), group, len(coords), eps, block)
    task = [*group, "leaf", "i", "j"]
    around = parts.groupBy(*task).applyInArrow(_count_task(eps2, min_samples), "uid LONG, around LONG")
    core = cut_lineage(around.groupBy("uid").agg((F.sum("around") >= min_samples).alias("core")))
    found = cut_lineage(parts.join(core, "uid").groupBy(*task).applyInArrow(_link_task(eps2), "uid LONG, label LONG, core BOOLEAN"))

    named = found.filter("core").groupBy("uid").agg(F.min("label").alias("label"))
    whole = named.select("label").distinct().withColumn("comp", F.col("label"))
    if cut:  # components of several parts that share a vector
        shared = found.filter("core").join(named.withColumnRenamed("label", "a"), "uid").filter("label <> a").select("a", F.col("label").alias("b")).distinct()
        labels = found.filter("core").select(F.col("label").alias("id")).distinct()
        whole = connected_components(labels, shared).withColumnRenamed("id", "label")
    members = named.join(whole, "label").select("uid", "comp")
    heads = uniq.join(members, "uid").groupBy(*group, "comp").agg(F.min("first").alias("first"))
    placed = cut_lineage(positions(heads, [*group, "first"]))
    bases = sized_side(placed.groupBy(*group).agg(F.min("pos").alias("base")))
    numbers = placed.join(bases, group).select("comp", (F.col("pos") - F.col("base")).cast("int").alias("cluster_id"))
    # a core vector has one number; another takes the lowest it touches
    labels = found.select("uid", "label").join(whole, "label").join(numbers, "comp").groupBy("uid").agg(F.min("cluster_id").alias("cluster_id"))
    labels = uniq.join(labels, "uid", "left").select(*group, F.col("x").alias("_x"), F.coalesce("cluster_id", F.lit(-1)).alias("cluster_id"))
    return pts.join(labels, [*group, "_x"]).drop("_x")


def group_alerts(alerts: DataFrame, tfidf: list[str], eps: float = 0.8, min_samples: int = 3,
                 time_weight: float = 0.05, weight_after_scale: bool = False) -> DataFrame:
    """Cluster each run's alerts into incidents.

    Scaling to unit deviation cancels `time_weight`; `weight_after_scale`
    applies it once more after scaling, so that it has an effect.
    """
    raw, coords = clustering_columns(cut_lineage(alerts), tfidf, time_weight)
    scaled_rows = standard_scale(raw, coords, ["run_id"])
    if weight_after_scale:
        scaled_rows = scaled_rows.withColumn("_c_time", F.col("_c_time") * F.lit(float(time_weight)))
    out = dbscan(scaled_rows, ["run_id"], coords, ["ts", "service", "signal"], eps, min_samples)
    return assign_incident_id(out.drop(*coords))
