"""Feature scaling."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from faultline.functions.scalars import finite_or_zero_sql, micros, replace_columns
from faultline.session import sized_side


def fit_scaler(df: DataFrame, columns: list[str], keys: list[str] | None = None) -> DataFrame:
    """Mean and population deviation of each column, one row per key (one row without keys)."""
    aggs = [F.expr(e) for c in columns for e in (f"avg(`{c}`) AS `_mu_{c}`", f"stddev_pop(`{c}`) AS `_sd_{c}`")]
    return df.groupBy(*(keys or [])).agg(*aggs)


def scaled(value: str, mean: str, deviation: str) -> str:
    """SQL text of the scaled value; a constant column is only centred."""
    return f"({value} - {mean}) / CASE WHEN {deviation} IS NULL OR {deviation} = 0 THEN 1D ELSE {deviation} END"


def standard_scale(df: DataFrame, columns: list[str], keys: list[str]) -> DataFrame:
    params = sized_side(fit_scaler(df, columns, keys))
    out = [f"`{c}`" if c not in columns else f"{scaled(f'`{c}`', f'`_mu_{c}`', f'`_sd_{c}`')} AS `{c}`" for c in df.columns]
    return df.join(params, keys).selectExpr(*out)


def clustering_columns(alerts: DataFrame, tfidf: list[str], time_weight: float = 0.05) -> tuple[DataFrame, list[str]]:
    """Columns to cluster on: weighted seconds since the run's first alert, score, text weights."""
    first = sized_side(alerts.groupBy("run_id").agg(F.min(micros("ts")).alias("_t0")))
    out = replace_columns(alerts.join(first, "run_id"), {
        "_c_time": f"(unix_micros(ts) - _t0) / 1e6 * {float(time_weight)!r}D",
        "_c_score": finite_or_zero_sql("score"),
        **{f"_c_{c}": finite_or_zero_sql(c) for c in tfidf}}).drop("_t0")
    return out, ["_c_time", "_c_score", *[f"_c_{c}" for c in tfidf]]
