"""Exact global order without a single-task window.

A table is range-partitioned on its sort key and written to the shared
checkpoint folder; each range knows the totals of the ranges before it, so a
window inside the range is enough for exact prefix sums and positions. Callers
aggregate to distinct keys first, so no key can fill a range by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from faultline.session import cut_lineage, sized_side


def _sort_columns(order: list[str | Column]) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in order]


def prefix_sums(df: DataFrame, order: list[str | Column], sums: dict[str, str]) -> DataFrame:
    """Add `name` = sum of `column` over all rows before this one, for each name -> column."""
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    keys = _sort_columns(order)
    ranged = cut_lineage(
        df.repartitionByRange(n, *keys).withColumn("_part", F.spark_partition_id()))
    # one row per range: at most `n`
    totals = ranged.groupBy("_part").agg(*[F.sum(c).alias(name) for name, c in sums.items()]).collect()
    types = {name: ranged.schema[c].dataType.simpleString() for name, c in sums.items()}
    types = {k: "double" if t in ("double", "float") else "bigint" for k, t in types.items()}
    running = {name: 0 for name in sums}
    rows = []
    for row in sorted(totals, key=lambda r: r["_part"]):
        rows.append([row["_part"], *[float(running[k]) if types[k] == "double" else int(running[k]) for k in sums]])
        for name in sums:
            running[name] += row[name] or 0
    schema = "_part int, " + ", ".join(f"_off_{k} {types[k]}" for k in sums)
    offsets = F.broadcast(spark.createDataFrame(rows, schema))
    inside = Window.partitionBy("_part").orderBy(*keys).rowsBetween(Window.unboundedPreceding, -1)
    placed = ranged.withColumns({
        f"_in_{name}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for name, c in sums.items()})
    return (placed.join(offsets, "_part")
            .withColumns({name: (F.col(f"_in_{name}") + F.col(f"_off_{name}")).cast(types[name])
                          for name in sums})
            .drop("_part", *[f"_in_{k}" for k in sums], *[f"_off_{k}" for k in sums]))


def positions(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """Zero-based place of every row in the global order."""
    return prefix_sums(df.withColumn("_one", F.lit(1).cast("long")), order, {name: "_one"}).drop("_one")


BINS = 1 << 14  # of one refinement of one cut
FETCHED_KEYS = 10_000  # distinct keys per cut that the driver may sort through
WHOLE_TYPES = (T.TimestampType, T.TimestampNTZType, T.LongType, T.IntegerType, T.ShortType, T.ByteType, T.DateType)


def _whole(df: DataFrame, column: str) -> Column | None:
    """The column as whole numbers in its own order; None if it has no such form."""
    kind = df.schema[column].dataType
    if isinstance(kind, T.TimestampType):
        return F.unix_micros(column)
    if isinstance(kind, T.TimestampNTZType):
        return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01', `{column}`)")
    if isinstance(kind, T.DateType):
        return F.unix_date(column).cast("long")
    return F.col(column).cast("long") if isinstance(kind, WHOLE_TYPES) else None


def keys_at(df: DataFrame, order: list[str], places: list[int]) -> list[Row | None]:
    """The keys of the rows at these zero-based places of the order (nulls first); None beyond the end.

    Whole-numbered leading columns are narrowed by histograms, all places together: one
    scan finds the range of values, each further one the bin of `BINS` that a place falls
    into, and the next column takes over where a single value still holds many rows. Once few
    rows are left around each place their distinct keys are counted and walked through in
    order; if too many share all leading values, they alone are ordered by ranges.
    """
    found: list[Row | None] = [None] * len(places)
    at = {i: p for i, p in enumerate(places)}  # place among the rows that the conditions leave
    inside = {i: F.lit(True) for i in at}
    wholes = []
    for c in order:
        value = _whole(df, c)
        if value is None:
            break
        wholes.append(value)
    keys = df.select(*order, *[w.alias(f"_w{k}") for k, w in enumerate(wholes)])
    left: dict[int, int] = {}
    if not wholes:
        left = dict.fromkeys(at, keys.count())
        at = {i: p for i, p in at.items() if p < left[i]}
    for k in range(len(wholes)):
        col = F.col(f"_w{k}")
        ends = keys.agg(*[x for i in at for x in (F.count_if(inside[i]), F.count_if(inside[i] & col.isNull()), F.min(F.when(inside[i], col)), F.max(F.when(inside[i], col)))]).first()
        span = {}
        for n, i in enumerate(list(at)):
            total, nulls, low, high = ends[4 * n:4 * n + 4]
            left[i] = total
            if at[i] >= total:
                del at[i]
            elif at[i] < nulls:
                inside[i], left[i] = inside[i] & col.isNull(), nulls
            else:
                at[i] -= nulls
                inside[i], span[i] = inside[i] & col.isNotNull(), (low, high)
                left[i] = total - nulls
        while span and any(left[i] > FETCHED_KEYS and span[i][0] < span[i][1] for i in span):
            width = {i: -(-(high - low + 1) // BINS) for i, (low, high) in span.items()}
            bins = F.array(*[F.when(inside[i] & col.between(*span[i]), F.struct(F.lit(i).alias("i"), F.expr(f"(_w{k} - {span[i][0]}) div {width[i]}").alias("bin"))) for i in span])
            counts = keys.select(F.inline(F.filter(bins, lambda b: b.isNotNull()))).groupBy("i", "bin").agg(F.count("*").alias("n")).orderBy("i", "bin").collect()
            done = set()
            for i, bin_, n in counts:
                if i in done:
                    continue
                if at[i] < n:
                    low = span[i][0] + bin_ * width[i]
                    span[i], left[i] = (low, min(span[i][1], low + width[i] - 1)), n
                    done.add(i)
                else:
                    at[i] -= n
        for i, (low, high) in span.items():
            inside[i] = inside[i] & col.between(low, high)
        if not any(left[i] > FETCHED_KEYS for i in at):
            break
        # a cut whose value is not settled here has few rows left and is not narrowed further
    if not at:
        return found
    few = F.array(*[F.when(inside[i], F.lit(i)) for i in at])
    rows = keys.withColumn("_i", F.explode(F.filter(few, lambda x: x.isNotNull()))).groupBy("_i", *order).agg(F.count("*").alias("_n"))
    if max(left[i] for i in at) <= FETCHED_KEYS:
        before: dict[int, int] = {}
        for row in rows.orderBy("_i", *order).collect():
            i = row["_i"]
            start = before.get(i, 0)
            before[i] = start + row["_n"]
            if start <= at[i] < before[i]:
                found[i] = row
        return found
    placed = prefix_sums(rows, ["_i", *order], {"_before": "_n"})
    for i in at:
        first = placed.filter(F.col("_i") == i).agg(F.min("_before")).scalar()
        found[i] = placed.filter((F.col("_i") == i) & (F.col("_before") - first <= at[i]) & (F.col("_before") - first + F.col("_n") > at[i])).first()
    return found


def temporal_split(df: DataFrame, order: list[str], fractions: list[float], name: str = "split_no") -> DataFrame:
    """Number the consecutive parts of the time order: part i ends after int(n * fraction_i) more rows.

    Only the cut keys (one per fraction) are looked for, by small aggregates; the rows are
    then told apart by a plain comparison, so the wide table is neither sorted nor shuffled.
    """
    total = df.count()
    cuts, at = [], 0
    for f in fractions:
        at += int(total * f)
        cuts.append(at)
    key = F.struct(*order)
    part = F.lit(0)
    for row in keys_at(df, order, cuts):
        if row is not None:
            part = part + (key >= F.struct(*[F.lit(row[c]).cast(df.schema[c].dataType).alias(c) for c in order])).cast("int")
    return df.withColumn(name, part)


def exact_quantiles(df: DataFrame, groups: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Linear-interpolated quantiles per group, exact, with no group held in one task."""
    constant = not groups
    if constant:
        df, groups = df.withColumn("_all", F.lit(1)), ["_all"]
    counts = (df.filter(F.col(value).isNotNull()).groupBy(*groups, value)
              .agg(F.count(F.lit(1)).alias("_n")))
    placed = prefix_sums(counts, [*groups, value], {"_before": "_n"})
    bases = sized_side(placed.groupBy(*groups).agg(F.min("_before").alias("_base"), F.sum("_n").alias("_total")))
    joined = placed.join(bases, groups).withColumn("_at", F.col("_before") - F.col("_base"))

    def holds(place: Column) -> Column:
        return (F.col("_at") <= place) & (place < F.col("_at") + F.col("_n"))

    aggs = [F.max("_total").alias("_total")]
    for name, q in points.items():
        h = (F.col("_total") - 1) * F.lit(q)
        aggs += [F.max(F.when(holds(F.floor(h)), F.col(value))).alias(f"_lo_{name}"),
                 F.max(F.when(holds(F.ceil(h)), F.col(value))).alias(f"_hi_{name}")]
    out = joined.groupBy(*groups).agg(*aggs)
    picks = []
    for name, q in points.items():
        h = (F.col("_total") - 1) * F.lit(q)
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        picks.append((lo + (hi - lo) * (h - F.floor(h))).alias(name))
    return out.select(*([] if constant else groups), *picks)


def row_lookback(df: DataFrame, order: list[str], rows: int, block_rows: int = 100_000) -> DataFrame:
    """Cut the global order into blocks of rows, each with the `rows` rows before it.

    Adds `pos`, `_block` and `_home`; keep rows with `_block = _home` after a
    ROWS frame of at most `rows` preceding rows.
    """
    if block_rows < rows:
        block_rows = rows
    placed = positions(df, order).withColumn("_home", F.expr(f"pos div {block_rows}"))
    last = F.expr(f"(pos + {rows}) div {block_rows}")
    return placed.withColumn("_block", F.explode(F.sequence(F.col("_home"), last)))
