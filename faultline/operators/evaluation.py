"""Scores of binary predictions. Ranking metrics work on counts per distinct score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from faultline.operators.ordering import exact_quantiles, prefix_sums


def safe_ratio(num: Column, den: Column) -> Column:
    return F.when(den == 0, F.lit(0.0)).otherwise(num / den)


def _prf(tp: Column, fp: Column, fn: Column) -> dict[str, Column]:
    p, r = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return {"precision": p, "recall": r, "f1": safe_ratio(2 * p * r, p + r)}


def confusion(df: DataFrame, y: str = "y", pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    t, p = F.col(y) == 1, F.col(pred) == 1
    return df.groupBy(*(by or [])).agg(
        F.count_if(~t & ~p).alias("tn"), F.count_if(~t & p).alias("fp"),
        F.count_if(t & ~p).alias("fn"), F.count_if(t & p).alias("tp"))


def precision_recall_f1(df: DataFrame, y: str = "y", pred: str = "y_pred", by: list[str] | None = None) -> DataFrame:
    return confusion(df, y, pred, by).select(*(by or []), *[
        v.alias(k) for k, v in _prf(F.col("tp"), F.col("fp"), F.col("fn")).items()])


def threshold_grid() -> list[float]:
    """0.05, 0.10, ..., 0.95."""
    return [round(0.05 * i, 2) for i in range(1, 20)]


def tune_threshold(df: DataFrame, y: str = "y", score: str = "score", thresholds: list[float] | None = None) -> DataFrame:
    """Precision, recall and F1 at each threshold, in one pass over the rows."""
    taus = thresholds or threshold_grid()
    aggs = [F.expr(f"count_if(`{y}` = 1) AS _pos")]
    for i, tau in enumerate(taus):
        aggs += [F.expr(f"count_if(`{score}` >= {tau!r}D AND `{y}` = 1) AS _tp{i}"),
                 F.expr(f"count_if(`{score}` >= {tau!r}D AND `{y}` <> 1) AS _fp{i}")]
    cells = ", ".join(f"struct({tau!r}D AS threshold, _tp{i} AS tp, _fp{i} AS fp)" for i, tau in enumerate(taus))
    rows = df.agg(*aggs).selectExpr("_pos", f"inline(array({cells}))")
    return rows.select("threshold", *[
        v.alias(k) for k, v in _prf(F.col("tp"), F.col("fp"), F.col("_pos") - F.col("tp")).items()])


def best_threshold(grid: DataFrame) -> DataFrame:
    """Highest F1; the lowest threshold wins a tie."""
    return grid.orderBy(F.desc("f1"), "threshold").limit(1)


def classification_report(df: DataFrame, y: str = "y", pred: str = "y_pred") -> DataFrame:
    """Rows 0, 1, accuracy, macro avg, weighted avg with precision, recall, f1 and support."""
    c = confusion(df, y, pred)
    tn, fp, fn, tp = (F.col(k) for k in ("tn", "fp", "fn", "tp"))
    zero, one = _prf(tn, fn, fp), _prf(tp, fp, fn)
    n0, n1 = tn + fp, tp + fn
    n = n0 + n1
    acc = safe_ratio(tn + tp, n)

    def row(name: str, p: Column, r: Column, f: Column, s: Column) -> Column:
        return F.struct(F.lit(name).alias("label"), p.alias("precision"), r.alias("recall"),
                        f.alias("f1"), s.cast("long").alias("support"))

    # a class that never occurs and is never predicted has no row and no share in the averages
    has0, has1 = (n0 > 0) | (fn > 0), (n1 > 0) | (fp > 0)
    classes = has0.cast("int") + has1.cast("int")
    macro = {k: safe_ratio(zero[k] * has0.cast("int") + one[k] * has1.cast("int"), classes) for k in zero}
    weighted = {k: safe_ratio(zero[k] * n0 + one[k] * n1, n) for k in zero}
    return c.select(F.inline(F.array_compact(F.array(
        F.when(has0, row("0", zero["precision"], zero["recall"], zero["f1"], n0)),
        F.when(has1, row("1", one["precision"], one["recall"], one["f1"], n1)),
        row("accuracy", acc, acc, acc, n),
        row("macro avg", macro["precision"], macro["recall"], macro["f1"], n),
        row("weighted avg", weighted["precision"], weighted["recall"], weighted["f1"], n)))))


def _score_counts(df: DataFrame, y: str, score: str) -> DataFrame:
    """Per distinct score, highest first: positives, negatives and their totals before it."""
    counts = df.groupBy(F.col(score).cast("double").alias("score")).agg(
        F.count_if(F.col(y) == 1).alias("pos"), F.count_if(F.col(y) != 1).alias("neg"))
    return prefix_sums(counts, [F.desc("score")], {"pos_before": "pos", "neg_before": "neg"})


def roc_auc(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Share of (positive, negative) pairs in the right order, ties counting half; NaN for one class."""
    s = _score_counts(df, y, score)
    won = F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2))
    p, n = F.sum("pos"), F.sum("neg")
    return s.agg(F.when((p == 0) | (n == 0), F.lit(float("nan"))).otherwise(won / (p * n)).alias("roc_auc"))


def average_precision(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """Sum over distinct scores of recall gained times precision there."""
    s = _score_counts(df, y, score)
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    total = F.sum("pos")
    return s.agg(F.when(total == 0, F.lit(float("nan")))
                 .otherwise(F.sum(F.col("pos") * tp / (tp + fp)) / total).alias("average_precision"))


def curve_points(df: DataFrame, y: str = "y", score: str = "score") -> DataFrame:
    """One point per distinct score: false and true positive rate, precision, recall."""
    s = _score_counts(df, y, score)
    totals = s.agg(F.struct(F.sum("pos").alias("p"), F.sum("neg").alias("n"))).scalar()
    tp, fp = F.col("pos_before") + F.col("pos"), F.col("neg_before") + F.col("neg")
    return s.select(
        F.col("score").alias("threshold"), safe_ratio(fp, totals["n"]).alias("fpr"), safe_ratio(tp, totals["p"]).alias("tpr"),
        (tp / (tp + fp)).alias("precision"), safe_ratio(tp, totals["p"]).alias("recall"))


def score_metrics(df: DataFrame, name: str, y: str, pred: str, score: str) -> DataFrame:
    """One row: precision, recall, F1, ROC-AUC, average precision of one model."""
    flat = precision_recall_f1(df, y, pred)
    s = _score_counts(df, y, score)
    tp = F.col("pos_before") + F.col("pos")
    p, n = F.sum("pos"), F.sum("neg")
    none = F.lit(float("nan"))
    ranked = s.agg(F.struct(
        F.when((p == 0) | (n == 0), none).otherwise(
            F.sum(F.col("neg") * (F.col("pos_before") + F.col("pos") / 2)) / (p * n)).alias("roc_auc"),
        F.when((p == 0) | (n == 0), none).otherwise(
            F.sum(F.col("pos") * tp / (tp + F.col("neg_before") + F.col("neg"))) / p).alias("pr_auc"))).scalar()
    return flat.select(F.lit(name).alias("model"), "precision", "recall", "f1",
                       ranked["roc_auc"].alias("roc_auc"), ranked["pr_auc"].alias("pr_auc"))


def class_balance(df: DataFrame, y: str = "y") -> DataFrame:
    return df.agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col(y) == 1).alias("positives"),
                  F.avg(F.col(y).cast("double")).alias("positive_rate"))


def mttd_stats(mttd: DataFrame) -> DataFrame:
    """Mean and median delay of the detected faults."""
    known = mttd.filter(F.col("mttd_seconds").isNotNull())
    median = exact_quantiles(known, [], "mttd_seconds", {"m": 0.5}).scalar()
    return known.agg(F.avg("mttd_seconds").alias("mttd_mean_seconds"), F.count(F.lit(1)).alias("n_detected")).select(
        "n_detected", "mttd_mean_seconds", median.alias("mttd_median_seconds"))


def equal_width_bins(df: DataFrame, value: str, bins: int = 5) -> DataFrame:
    """Counts of equal-width bins between minimum and maximum; the last bin holds the maximum."""
    per = df.groupBy(F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("n"))
    ends = per.agg(F.struct(F.min("v").alias("lo"), F.max("v").alias("hi"))).scalar()
    width = (ends["hi"] - ends["lo"]) / bins
    idx = F.when(width == 0, F.lit(0)).otherwise(F.least(F.floor((F.col("v") - ends["lo"]) / width), F.lit(bins - 1)))
    return (per.withColumn("bin", idx.cast("int")).groupBy("bin").agg(F.sum("n").alias("count"))
            .select("bin", (ends["lo"] + F.col("bin") * width).alias("bin_start"), "count"))


def minmax_normalize(df: DataFrame, value: str, out: str) -> DataFrame:
    """(s - min) / (max - min + 1e-9); a single row gives 0."""
    ends = df.agg(F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))).scalar()
    return df.withColumn(out, (F.col(value) - ends["lo"]) / (ends["hi"] - ends["lo"] + 1e-9))
