"""Joins on time: closed intervals, points in intervals, nearest rows.

Intervals are indexed by dyadic bins: one is cut into at most two pieces a level, so a
fault that stays open for years is a few dozen rows, and a point probes one bin of each
level in use. Pieces and probes meet on (keys, level, bin), which spreads a busy key over
its bins. No side is forced to broadcast: the label tables are small in practice and Spark
broadcasts them from their size statistics, while a large one still runs as a shuffled
equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from faultline.functions.scalars import bin_of, from_micros, micros
from faultline.operators.blocks import with_time_blocks

MINUTE = 60_000_000
WINDOW_KEY = ["run_id", "service", "window_start", "window_end"]
RUN_SERVICE = ["run_id", "service"]


def dyadic_index(df: DataFrame, first: str, last: str, pieces: bool | None, probes: bool | None = None, top: Column | None = None) -> DataFrame:
    """One row per index entry of the base bins first..last: (_of, _level, _bin).

    Bin `b` of level `l` holds the 2^l base bins from b * 2^l on. Entries marked `pieces`
    are the fewest bins that make up the range, at most two a level: at each level what is
    left begins at the next whole bin and ends before the last whole one, and an odd begin,
    or an odd end, belongs to no larger bin. Entries marked `probes` are the bins that hold
    `first` at the levels up to `top`. A mark of None leaves that kind out.
    """
    own = F.floor(F.log2((F.col(last) - F.col(first) + 1).cast("double"))).cast("int") + 1 if pieces is not None else F.lit(0)
    highest = own if probes is None else F.greatest(own, F.coalesce(top, F.lit(-1)))
    rows = df.withColumn("_level", F.explode(F.sequence(F.lit(0), highest)))
    low = -F.call_function("shiftright", -F.col(first), F.col("_level"))
    high = F.call_function("shiftright", F.col(last) + 1, F.col("_level"))
    entries = []
    if probes is not None:
        at = F.when(F.col("_level") <= top, F.call_function("shiftright", F.col(first), F.col("_level")))
        entries.append(F.struct(F.lit(probes).alias("_of"), at.alias("_bin")))
    if pieces is not None:
        for end, bin_ in ((low, low), (high, high - 1)):
            entries.append(F.struct(F.lit(pieces).alias("_of"), F.when((low < high) & (end.bitwiseAND(1) == 1), bin_).alias("_bin")))
    return rows.select("*", F.inline(F.array(*entries))).filter("_bin IS NOT NULL")


def overlap_pairs(left: DataFrame, right: DataFrame, keys: list[str],
                  left_span: tuple[Column, Column], right_span: tuple[Column, Column],
                  bin_us: int) -> DataFrame:
    """All pairs of same-key closed intervals that touch, each pair once.

    Of two that touch, the later start (the left one of equal starts) lies in the other
    interval. So each side's starts probe the other's pieces: a start lies in exactly one
    piece of an interval that covers its bin, at no level above that of the other side's
    longest interval (a subquery of the join). A left side of points (one column for both
    ends) has no pieces. The right side's non-key columns must not clash with the left side's.
    """
    points = left_span[0] is left_span[1]

    def placed(df: DataFrame, span: tuple[Column, Column], s: str, e: str) -> DataFrame:
        rows = df.withColumns({s: micros(span[0]), e: micros(span[1])}).filter(F.col(s) <= F.col(e))
        return rows.withColumns({"_first": bin_of(F.col(s), bin_us), "_last": bin_of(F.col(e), bin_us)})

    def top(df: DataFrame) -> Column:
        return df.agg(F.floor(F.log2(F.max(F.col("_last") - F.col("_first") + 1).cast("double"))).cast("int") + 1).scalar()

    lhs, rhs = placed(left, left_span, "_ls", "_le"), placed(right, right_span, "_rs", "_re")
    starts_of_left, starts_of_right = False, True
    by_left = dyadic_index(lhs, "_first", "_last", None if points else starts_of_right, starts_of_left, top(rhs))
    by_right = dyadic_index(rhs, "_first", "_last", starts_of_left, None if points else starts_of_right, None if points else top(lhs))
    inside = F.when(F.col("_of"), (F.col("_ls") < F.col("_rs")) & (F.col("_rs") <= F.col("_le"))).otherwise(
        (F.col("_rs") <= F.col("_ls")) & (F.col("_ls") <= F.col("_re")))
    hidden = ["_first", "_last"]
    return by_left.drop(*hidden).join(by_right.drop(*hidden), [*keys, "_of", "_level", "_bin"]).filter(inside)


def label_points(features: DataFrame, labels: DataFrame, at: str = "window_start",
                 bin_us: int = 15 * MINUTE, name: str = "y") -> DataFrame:
    """1 where the row's time lies in a fault of the same run and service."""
    key = [*RUN_SERVICE, at]
    faults = labels.select(*RUN_SERVICE, "start_ts", "end_ts")
    moment = F.col(at)
    hits = (overlap_pairs(features.select(*key), faults, RUN_SERVICE,
                          (moment, moment), (F.col("start_ts"), F.col("end_ts")), bin_us)
            .groupBy(*key).agg(F.lit(1).alias(name)))
    return features.join(hits, key, "left").withColumn(name, F.coalesce(name, F.lit(0)))


def label_windows(features: DataFrame, labels: DataFrame, bin_us: int = 15 * MINUTE) -> DataFrame:
    """y_true = the window overlaps a fault; fault_type = the first such label in file order."""
    faults = labels.select(*RUN_SERVICE, "start_ts", "end_ts", "label_seq", "fault_type")
    hits = (overlap_pairs(features.select(*WINDOW_KEY), faults, RUN_SERVICE,
                          (F.col("window_start"), F.col("window_end")),
                          (F.col("start_ts"), F.col("end_ts")), bin_us)
            .groupBy(*WINDOW_KEY).agg(F.min_by("fault_type", "label_seq").alias("fault_type"),
                                      F.lit(1).alias("y_true")))
    return (features.join(hits, WINDOW_KEY, "left")
            .withColumns({"y_true": F.coalesce("y_true", F.lit(0)),
                          "fault_type": F.coalesce("fault_type", F.lit("normal"))}))


def label_future(features: DataFrame, labels: DataFrame, horizon_us: int = 5 * MINUTE,
                 bin_us: int = 15 * MINUTE) -> DataFrame:
    """y_future = a fault touches [end, end + horizon] and none touches the window itself."""
    faults = labels.select(*RUN_SERVICE, "start_ts", "end_ts")
    reach = from_micros(micros("window_end") + F.lit(horizon_us))
    hits = (overlap_pairs(features.select(*WINDOW_KEY), faults, RUN_SERVICE,
                          (F.col("window_start"), reach), (F.col("start_ts"), F.col("end_ts")), bin_us)
            .groupBy(*WINDOW_KEY)
            .agg(F.bool_or(F.col("start_ts") <= F.col("window_end")).alias("_now"),
                 F.bool_or(F.col("end_ts") >= F.col("window_end")).alias("_later")))
    future = F.col("_later") & ~F.col("_now")
    return (features.join(hits, WINDOW_KEY, "left")
            .withColumn("y_future", F.coalesce(future.cast("int"), F.lit(0))).drop("_now", "_later"))


def detection_delay(scored: DataFrame, labels: DataFrame, flag: str = "y_pred",
                    bin_us: int = 15 * MINUTE, clip_zero: bool = False) -> DataFrame:
    """Per fault: the earliest flagged window that overlaps it, and the delay to its start.

    The delay may be negative because a window may begin before the fault.
    """
    flagged = scored.filter(F.col(flag) == 1).select(*WINDOW_KEY)
    first = (overlap_pairs(flagged, labels.select(*RUN_SERVICE, "start_ts", "end_ts", "label_seq"), RUN_SERVICE,
                           (F.col("window_start"), F.col("window_end")),
                           (F.col("start_ts"), F.col("end_ts")), bin_us)
             .groupBy("label_seq").agg(F.min("window_start").alias("first_detect_ts")))
    delay = (micros("first_detect_ts") - micros("start_ts")) / 1e6
    if clip_zero:
        delay = F.when(delay < 0, F.lit(0.0)).otherwise(delay)
    return (labels.join(first, "label_seq", "left")
            .select("label_seq", *RUN_SERVICE, "fault_type", F.col("start_ts").alias("fault_start"),
                    F.col("end_ts").alias("fault_end"), "first_detect_ts", delay.alias("mttd_seconds")))


def nearest_row(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str,
                payload: list[str], tolerance_us: int = MINUTE, prefer: str | None = None,
                matched: str = "embed_window_end", block_us: int | None = None) -> DataFrame:
    """Nearest right row of the same keys within the tolerance; a tie goes to the earlier one.

    Of right rows that share a time the one with the largest `prefer` value is
    taken. One union, then the last value seen from each side; both frames only
    grow, so the work per block is linear.
    """
    block_us = block_us or max(60 * tolerance_us, MINUTE)
    rhs = right.select(*keys, micros(right_ts).alias("_t"), F.struct(*payload).alias("_payload"),
                       (F.col(prefer) if prefer else F.lit(0)).alias("_prefer"),
                       F.lit(0).alias("_side"), F.lit(None).cast(left.schema).alias("_left"))
    lhs = left.select(*keys, micros(left_ts).alias("_t"), *[F.lit(None).cast(rhs.schema[c].dataType).alias(c) for c in ("_payload", "_prefer")],
                      F.lit(1).alias("_side"), F.struct(*left.columns).alias("_left"))
    rhs = with_time_blocks(rhs, F.col("_t"), block_us, tolerance_us, tolerance_us)
    lhs = with_time_blocks(lhs, F.col("_t"), block_us)
    both = rhs.unionByName(lhs)
    seen = F.when(F.col("_side") == 0, F.struct(F.col("_t").alias("t"), F.col("_payload").alias("p")))
    part = Window.partitionBy(*keys, "_block")
    grow = (Window.unboundedPreceding, 0)
    back = F.last(seen, ignorenulls=True).over(part.orderBy("_t", "_side", "_prefer").rowsBetween(*grow))
    ahead = F.last(seen, ignorenulls=True).over(part.orderBy(F.desc("_t"), "_side", "_prefer").rowsBetween(*grow))
    out = both.withColumns({"_b": back, "_a": ahead}).filter(F.col("_side") == 1)
    gap_b, gap_a = F.col("_t") - F.col("_b.t"), F.col("_a.t") - F.col("_t")
    ok_b = F.coalesce(gap_b <= tolerance_us, F.lit(False))
    ok_a = F.coalesce(gap_a <= tolerance_us, F.lit(False))
    pick = (F.when(ok_b & (~ok_a | (gap_b <= gap_a)), F.col("_b")).when(ok_a, F.col("_a")))
    out = out.withColumn("_hit", pick)
    return out.selectExpr("_left.*", f"timestamp_micros(_hit.t) AS `{matched}`", *[f"_hit.p.`{c}` AS `{c}`" for c in payload])


def attach_embeddings(alerts: DataFrame, features: DataFrame, columns: list[str],
                      tolerance_us: int = MINUTE) -> DataFrame:
    """Text weights of the feature row nearest to each alert; zeros where none is close."""
    out = nearest_row(alerts, features, RUN_SERVICE, "ts", "window_end", columns,
                      tolerance_us, prefer="window_start")
    return out.withColumn("has_embed", F.col("embed_window_end").isNotNull()).na.fill(0.0, columns)


def fault_active_grid(labels: DataFrame, step_us: int) -> DataFrame:
    """0/1 per run, service, fault type and tick: is such a fault open?

    Ticks are multiples of the step from the run's first fault start to its last end.
    """
    spans = labels.withColumns({"_s": F.ceil(micros("start_ts") / step_us), "_e": bin_of(micros("end_ts"), step_us)})
    runs = (spans.groupBy("run_id").agg(F.min("_s").alias("_lo"), F.max("_e").alias("_hi"))
            .filter(F.col("_lo") <= F.col("_hi")))
    series = spans.select("run_id", "service", "fault_type").distinct()
    grid = series.join(runs, "run_id").select(
        "run_id", "service", "fault_type", F.explode(F.sequence("_lo", "_hi")).alias("_k"))
    active = (spans.filter(F.col("_s") <= F.col("_e"))
              .select("run_id", "service", "fault_type", F.explode(F.sequence("_s", "_e")).alias("_k"))
              .distinct().withColumn("active", F.lit(1)))
    return (grid.join(active, ["run_id", "service", "fault_type", "_k"], "left")
            .select("run_id", "service", "fault_type", from_micros(F.col("_k") * step_us).alias("ts"),
                    F.coalesce("active", F.lit(0)).alias("active")))


def intervals_from_events(events: DataFrame, keys: list[str], start_message: str = "fault_start",
                          end_messages: tuple[str, ...] = ("fault_end", "fault_cleared"),
                          span_us: int = 60 * MINUTE) -> DataFrame:
    """Pair each fault start with the first end event after it (null while still open).

    Every time block keeps its rows in order by itself; what a block cannot
    close is closed by the first end event of a later block, found on the
    one-row-per-block table.
    """
    ev = (events.filter(F.col("message").isin(start_message, *end_messages))
          .select(*keys, micros("ts").alias("_t"), (F.col("message") == start_message).alias("_is_start")))
    ev = ev.withColumn("_block", bin_of(F.col("_t"), span_us))
    inside = (Window.partitionBy(*keys, "_block").orderBy(F.desc("_t"), F.desc("_is_start"))
              .rowsBetween(Window.unboundedPreceding, 0))
    ev = ev.withColumn("_end", F.last(F.when(~F.col("_is_start"), F.col("_t")), ignorenulls=True).over(inside))
    firsts = ev.groupBy(*keys, "_block").agg(F.min(F.when(~F.col("_is_start"), F.col("_t"))).alias("_first"))
    later = Window.partitionBy(*keys).orderBy(F.desc("_block")).rowsBetween(Window.unboundedPreceding, -1)
    firsts = firsts.withColumn("_next", F.last("_first", ignorenulls=True).over(later)).drop("_first")
    return (ev.filter("_is_start").join(firsts, [*keys, "_block"])
            .select(*keys, from_micros("_t").alias("start_ts"),
                    from_micros(F.coalesce("_end", "_next")).alias("end_ts")))


def run_time_window(labels: DataFrame, pad_us: int = MINUTE // 2) -> DataFrame:
    """Padded time range of each run."""
    return labels.groupBy("run_id").agg(
        from_micros(F.min(micros("start_ts")) - pad_us).alias("start_ts"),
        from_micros(F.max(micros("end_ts")) + pad_us).alias("end_ts"))


def coverage(expected: DataFrame, observed: DataFrame, rules: dict[str, str], key: str = "service", name: str = "name") -> DataFrame:
    """signal, missing (expected values no observed name contains, comma-joined), ok, for every signal of `rules`.

    A signal with the rule `all` needs every expected value, one with `any` needs one. Names and
    expected values are distinct first; the expected ones, a list of services, travel as one array.
    """
    wanted = expected.select(key).distinct().agg(F.array_sort(F.collect_set(key)).alias("_wanted")).scalar()
    signals = expected.sparkSession.createDataFrame(list(rules.items()), "signal STRING, _rule STRING").withColumn("_wanted", wanted)
    found = (observed.select("signal", name).distinct().withColumn("_wanted", wanted)
             .select("signal", name, F.explode("_wanted").alias("_w")).filter(F.contains(name, F.col("_w")))
             .groupBy("signal").agg(F.collect_set("_w").alias("_found")))
    rows = signals.join(found, "signal", "left").withColumn("_found", F.coalesce("_found", F.array().cast("array<string>")))
    lost = F.array_except("_wanted", "_found")
    return rows.select("signal", F.when(F.size(lost) > 0, F.array_join(lost, ",")).alias("missing"),
                       F.when(F.col("_rule") == "any", F.size("_found") > 0).otherwise(F.size(lost) == 0).alias("ok"))


def missing_services(expected: DataFrame, observed: DataFrame, key: str = "service") -> DataFrame:
    """Expected values that never occur; `observed` is reduced to its distinct values first."""
    return expected.join(observed.select(key).distinct(), key, "left_anti")


