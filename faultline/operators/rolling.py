"""Rolling features over (t - w, t] per run and service."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import from_micros, micros
from faultline.operators.blocks import home_rows, with_time_blocks
from faultline.operators.intervals import MINUTE, RUN_SERVICE
from faultline.operators.ordering import row_lookback
from faultline.schemas import METRIC_NAMES

# The rolling windows and their column suffixes.
WINDOWS = {"1min": MINUTE, "5min": 5 * MINUTE, "15min": 15 * MINUTE}
STATS = {"mean": "avg", "std": "stddev_samp", "min": "min", "max": "max"}


def pivot_metrics(metrics: DataFrame) -> DataFrame:
    """One row per run, time and service; a column per metric; rows without any value vanish.

    The metric names are known, so conditional means need one shuffle where a
    pivot would take two.
    """
    means = [F.expr(f"avg(CASE WHEN metric = '{m}' THEN value END) AS {m}") for m in METRIC_NAMES]
    return (metrics.na.drop(subset=["ts", "service", "metric"])
            .groupBy("run_id", "ts", "service").agg(*means).na.drop("all", subset=METRIC_NAMES))


def union_metrics(wide: DataFrame, keys: list[str], metrics: list[str] = METRIC_NAMES) -> DataFrame:
    """One row per key and metric name: the union of the metrics' results, each tagged with its name."""
    pairs = ", ".join(f"'{m}', `{m}`" for m in metrics)
    return wide.selectExpr(*keys, f"stack({len(metrics)}, {pairs}) AS (metric, value)")


def stack_windows(wide: DataFrame, keys: list[str], end: str, names: dict[str, list[str]],
                  windows: dict[str, int]) -> DataFrame:
    """One row per window length, holding only that length's columns; the others are null.

    `names` maps each window label to its columns in `wide`.
    """
    widths = ", ".join(f"{us}L" for us in windows.values())
    tall = wide.selectExpr("*", f"posexplode(array({widths})) AS (_w, _us)")
    cols = [f"CASE WHEN _w = {i} THEN `{c}` END AS `{c}`" for i, w in enumerate(windows) for c in names[w]]
    return tall.selectExpr(*keys, f"timestamp_micros(unix_micros({end}) - _us) AS window_start", f"{end} AS window_end", *cols)


PARTS = {"n": "count", "mean": "avg", "var": "var_pop", "lo": "min", "hi": "max"}


def _merged(c: str) -> list[str]:
    """Statistics of a window from those of its two parts: `_begin_<c>` and, in another cell, `_before.<c>` (null: no row there)."""
    a, b = f"_begin_{c}", f"_before.{c}"
    n = f"({a}.n + coalesce({b}.n, 0))"
    both = f"{a}.n > 0 AND {b}.n > 0"
    gap = f"({b}.mean - {a}.mean)"
    spread = f"({a}.var * {a}.n + {b}.var * {b}.n + {gap} * {gap} * {a}.n * {b}.n / {n})"
    one = f"coalesce({a}.var * nullif({a}.n, 0), {b}.var * {b}.n)"
    return [f"CASE WHEN {both} THEN {a}.mean + {gap} * {b}.n / {n} ELSE coalesce({a}.mean, {b}.mean) END AS {c}_mean",
            f"CASE WHEN {n} > 1 THEN sqrt(CASE WHEN {both} THEN {spread} ELSE {one} END / ({n} - 1)) END AS {c}_std",
            f"least({a}.lo, {b}.lo) AS {c}_min", f"greatest({a}.hi, {b}.hi) AS {c}_max"]


def rolling_stats(samples: DataFrame, columns: list[str] = METRIC_NAMES,
                  windows: dict[str, int] = WINDOWS, keys: list[str] = RUN_SERVICE,
                  layout: str = "long") -> DataFrame:
    """Mean, deviation, minimum and maximum of each column, one row per sample and window length.

    Input has one row per key and time. Nulls are skipped; a single value has no
    deviation. `layout="wide"` keeps one row per sample with all lengths side by side.

    Time is cut into cells of one window length, so a window is the end of one cell
    and the beginning of the next. Statistics of every beginning and every end come
    from frames that only grow; the end that a window needs is the one of the first
    sample after its start, found by moving ends one length ahead. The work is
    linear in the rows at any density, and all of it follows one exchange.
    """
    reach = max(windows.values())
    rows = with_time_blocks(samples.select(*keys, "ts", *columns), micros("ts"), 4 * reach, reach).repartition(*keys, "_block")
    widths = ", ".join(f"{us}L" for us in windows.values())
    tall = rows.withColumn("_t", micros("ts")).selectExpr("*", f"posexplode(array({widths})) AS (_w, _us)").selectExpr(
        "*", "(_t - pmod(_t, _us)) div _us AS _cell")
    cell = f"PARTITION BY {', '.join(keys)}, _block, _w, _cell"
    growing = "BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"

    def parts(name: str, order: str) -> list[str]:
        over = f"OVER ({cell} ORDER BY _t {order} RANGE {growing})"
        return ["named_struct(" + ", ".join(f"'{p}', {fn}({c}) {over}" for p, fn in PARTS.items()) + f") AS {name}_{c}" for c in columns]

    halves = tall.selectExpr(*keys, "ts", "_home", "_block", "_w", "_us", "_cell", "_t", *parts("_begin", "ASC"), *parts("_end", "DESC"))
    ends = "named_struct(" + ", ".join(f"'{c}', _end_{c}" for c in columns) + ")"
    events = halves.selectExpr(
        *keys, "ts", "_home", "_block", "_w", *[f"_begin_{c}" for c in columns],
        f"inline(array(named_struct('_moved', 0, '_at', _t, '_cell', _cell, '_end', CASE WHEN false THEN {ends} END), "
        f"named_struct('_moved', 1, '_at', _t + _us, '_cell', _cell + 1, '_end', {ends})))")
    seen = events.selectExpr("*", f"last(_end, true) OVER ({cell} ORDER BY _at DESC, _moved ROWS {growing}) AS _before")
    kept = home_rows(seen.filter("_moved = 0"))
    stats = kept.selectExpr(*keys, "ts", "_w", *[e for c in columns for e in _merged(c)])
    names = {w: [f"{c}_{s}_{w}" for c in columns for s in STATS] for w in windows}
    own = [f"{c}_{s}" for c in columns for s in STATS]
    cols = [f"CASE WHEN _w = {i} THEN {o} END AS {n}" for i, w in enumerate(windows) for o, n in zip(own, names[w])]
    if layout == "wide":
        held = stats.selectExpr(*keys, "ts AS window_end", *cols)
        flat = [n for w in windows for n in names[w]]
        return held.groupBy(*keys, "window_end").agg(*[F.max(n).alias(n) for n in flat])
    return stats.selectExpr(*keys, f"timestamp_micros(unix_micros(ts) - element_at(array({widths}), _w + 1)) AS window_start", "ts AS window_end", *cols)


def rolling_sums(rows: DataFrame, measures: list[str], windows: dict[str, int],
                 keys: list[str], names: dict[str, list[str]]) -> DataFrame:
    """Sums of whole numbers over (t - w, t], one row per key and time, in linear time.

    Each value enters at its own time and leaves one window length later, so a
    running total over both kinds of event is the rolling sum for any density
    of rows. Rows of one time are added up before anything moves.
    """
    reach = max(windows.values())
    totals = rows.groupBy(*keys, micros("ts").alias("_at")).agg(
        *[F.sum(F.col(m).cast("long")).alias(m) for m in measures])
    blocked = with_time_blocks(totals, F.col("_at"), 4 * reach, reach)
    shifts = ", ".join(f"{us}L" for us in [0, *windows.values()])
    steps = blocked.selectExpr("*", f"posexplode(array({shifts})) AS (_k, _us)")
    deltas = {out: f"CASE _k WHEN 0 THEN {m} WHEN {i} THEN -{m} ELSE 0L END"
              for i, w in enumerate(windows, start=1) for m, out in zip(measures, names[w])}
    events = steps.selectExpr(*keys, "_block", "_at + _us AS _t", "_k = 0 AND _block = _home AS _out",
                              *[f"{e} AS {n}" for n, e in deltas.items()])
    running = f"PARTITION BY {', '.join(keys)}, _block ORDER BY _t RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW"
    wide = events.selectExpr(*keys, "_t", "_out", *[f"sum({n}) OVER ({running}) AS {n}" for n in deltas]).filter("_out")
    return wide.select(*keys, from_micros("_t").alias("ts"), *deltas)


LOG_MEASURES = ["count", "error_count", "warn_count", "error_keywords"]


def rolling_log_counts(logs: DataFrame, windows: dict[str, int] = WINDOWS,
                       keys: list[str] = RUN_SERVICE, layout: str = "long") -> DataFrame:
    """Lines, errors, warnings and keyword hits per window; `logs` carries the prepared flags."""
    rows = logs.select(*keys, "ts", F.col("text").isNotNull().cast("int").alias("count"),
                       F.col("is_error").alias("error_count"), F.col("is_warn").alias("warn_count"),
                       F.col("err_kw").alias("error_keywords"))
    names = {w: [f"logs_{m}_{w}" for m in LOG_MEASURES] for w in windows}
    wide = rolling_sums(rows, LOG_MEASURES, windows, keys, names)
    if layout == "wide":
        return wide.withColumnRenamed("ts", "window_end")
    return stack_windows(wide, keys, "ts", names, windows)


def rolling_zscore(df: DataFrame, column: str, order: list[str], window: int = 12, z_threshold: float = 3.0,
                   keys: list[str] | None = None, block_rows: int = 100_000) -> DataFrame:
    """z = (x - mean) / deviation over the last `window` rows including this one.

    Too few rows, a zero deviation or a missing value give 0. Without `keys`
    the rows of all services form one sequence in the given order.
    """
    keys = keys or []
    least = max(2, window // 3)
    rows = row_lookback(df, [*keys, *order], window - 1, block_rows)
    frame = Window.partitionBy(*keys, "_block").orderBy("pos").rowsBetween(-(window - 1), 0)
    rows = rows.withColumns({"_n": F.count(column).over(frame), "_mu": F.avg(column).over(frame),
                             "_sd": F.stddev_samp(column).over(frame)})
    z = F.when((F.col("_n") >= least) & (F.col("_sd") != 0),
               (F.col(column) - F.col("_mu")) / F.col("_sd"))
    z = F.coalesce(z, F.lit(0.0))
    return (home_rows(rows).withColumns({"z_score": z, "y_pred": (z >= z_threshold).cast("int")})
            .drop("_n", "_mu", "_sd", "pos"))
