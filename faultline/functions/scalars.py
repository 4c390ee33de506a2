"""Column expressions for cleaning telemetry. All run inside code generation."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The words that mark an error line.
ERROR_KEYWORDS = [
    "error",
    "exception",
    "timeout",
    "failed",
    "connection",
    "unavailable",
    "refused",
    "traceback",
    "critical",
]

# Columns that identify a feature row and are never model inputs.
ID_COLUMNS = ["run_id", "service", "window_start", "window_end"]
LABEL_COLUMNS = ["y", "y_true", "y_future", "y_pred", "fault_type"]

# Panel colour steps (lower bound, colour).
ERROR_STEPS = [(5, "red"), (1, "orange")]
WARNING_STEPS = [(20, "red"), (5, "orange")]


def micros(ts: Column | str) -> Column:
    return F.unix_micros(ts)


def from_micros(us: Column | str) -> Column:
    return F.timestamp_micros(us)


def bin_of(value: Column, width: int) -> Column:
    """Integer floor division that is exact for negative values too."""
    return ((value - F.pmod(value, F.lit(width))) / F.lit(width)).cast("long")


def parse_ts_utc(text: Column | str) -> Column:
    """ISO text with `Z`, an offset or neither (then UTC); anything else is null."""
    return F.try_to_timestamp(F.trim(text))


def to_rfc3339(ts: Column | str) -> Column:
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss'+00:00'")


def epoch_seconds_to_ts(seconds: Column) -> Column:
    return F.timestamp_micros(F.round(seconds * 1_000_000).cast("long"))


def epoch_nanos_to_ts(nanos: Column) -> Column:
    return F.timestamp_micros((nanos.cast("decimal(38,0)") / F.lit(1000)).cast("long"))


def ts_to_epoch_nanos(ts: Column | str) -> Column:
    return F.unix_micros(ts) * F.lit(1000)


def normalize_service(name: Column) -> Column:
    """Container-style names become logical service names."""
    bare = F.regexp_replace(F.regexp_replace(name, r"^\s+|\s+$", ""), "simulator-", "")
    return F.coalesce(F.regexp_replace(bare, r"-[0-9]+$", ""), F.lit("unknown"))


def present(text: Column) -> Column:
    """Empty text counts as missing."""
    return F.nullif(text, F.lit(""))


def resolve_service(line: Column, labels: Column) -> Column:
    """Payload first, then labels, then the container name."""
    container = present(F.regexp_extract(
        F.coalesce(F.try_element_at(labels, F.lit("container")), F.lit("")),
        r"simulator-([a-zA-Z0-9_-]+)", 1))
    return F.coalesce(
        present(F.get_json_object(line, "$.service")),
        *[present(F.try_element_at(labels, F.lit(k))) for k in ("service", "app", "job")],
        container,
        F.lit("unknown"),
    )


def log_field(line: Column, *names: str) -> Column:
    return F.coalesce(*[present(F.get_json_object(line, f"$.{n}")) for n in names])


def log_text(message: Column, line: Column) -> Column:
    return F.coalesce(message, line, F.lit(""))


def log_level(level: Column) -> Column:
    return F.upper(F.coalesce(level, F.lit("unknown")))


def error_keyword_count(text: Column) -> Column:
    """How many of the keywords occur; each counts once."""
    lowered = F.lower(F.coalesce(text, F.lit("")))
    return reduce(add, [F.contains(lowered, F.lit(k)).cast("int") for k in ERROR_KEYWORDS])


def is_level(level: Column, name: str) -> Column:
    return F.coalesce((level == F.lit(name)).cast("int"), F.lit(0))


def finite_or_zero(value: Column) -> Column:
    """Null, NaN and the infinities all mean missing, and missing means zero."""
    v = value.cast("double")
    bad = v.isNull() | F.isnan(v) | (F.abs(v) == F.lit(float("inf")))
    return F.when(bad, F.lit(0.0)).otherwise(v)


def finite_or_null(value: Column) -> Column:
    v = value.cast("double")
    return F.when(~(F.isnan(v) | (F.abs(v) == F.lit(float("inf")))), v)


def clamp_min(value: Column, floor: float) -> Column:
    return F.when(value < F.lit(floor), F.lit(floor)).otherwise(value)


def anchored_match(value: Column, pattern: str) -> Column:
    """A selector's regex must cover the whole label value."""
    return value.rlike(f"^(?:{pattern})$")


def threshold_color(value: Column, steps: list[tuple[int, str]]) -> Column:
    out = F.lit("green")
    for bound, color in sorted(steps):
        out = F.when(value >= bound, F.lit(color)).otherwise(out)
    return out


def rule_text(column: str, threshold: float) -> str:
    return f"{column}>={threshold}"


def finite_or_zero_sql(name: str) -> str:
    """`finite_or_zero` as text: a wide table needs one parse instead of many column calls."""
    return f"CASE WHEN `{name}` IS NULL OR isnan(`{name}`) OR abs(`{name}`) = double('Infinity') THEN 0D ELSE CAST(`{name}` AS DOUBLE) END"


def replace_columns(df: DataFrame, texts: dict[str, str]) -> DataFrame:
    """Replace or add columns given as SQL text, in one projection."""
    kept = [f"`{c}`" if c not in texts else f"{texts[c]} AS `{c}`" for c in df.columns]
    return df.selectExpr(*kept, *[f"{e} AS `{c}`" for c, e in texts.items() if c not in df.columns])


def clean_features(df: DataFrame, columns: list[str]) -> DataFrame:
    return replace_columns(df, {c: finite_or_zero_sql(c) for c in columns})


def numeric_features(df: DataFrame, exclude: list[str] | None = None) -> list[str]:
    """Numeric columns that are not ids, times or labels; none is an error."""
    skip = set(ID_COLUMNS + LABEL_COLUMNS + (exclude or []))
    out = [f.name for f in df.schema.fields
           if f.name not in skip and isinstance(f.dataType, T.NumericType)]
    if not out:
        raise ValueError("no numeric feature columns")
    return out


def tfidf_columns(df: DataFrame) -> list[str]:
    """`tfidf_<i>` numeric columns in numeric order."""
    found = [f.name for f in df.schema.fields
             if f.name.startswith("tfidf_") and isinstance(f.dataType, T.NumericType)]
    return sorted(found, key=lambda c: (not c[6:].isdigit(), int(c[6:]) if c[6:].isdigit() else 0, c))


def align_vector(names: Column, values: Column, columns: list[str]) -> Column:
    """Struct(vector, reject): the model's column order, absent names as 0.0.

    Without names the vector must already have the model's length.
    """
    n = len(columns)
    order = F.array(*[F.lit(c) for c in columns])
    pairs = F.map_from_entries(F.arrays_zip(names.alias("k"), values.alias("v")))
    reject = (
        F.when(values.isNull() | (F.size(values) == 0), F.lit("empty_features"))
        .when(names.isNull() & (F.size(values) != n), F.lit("bad_feature_length"))
        .when(names.isNotNull() & (F.size(names) != F.size(values)), F.lit("feature_names_mismatch"))
    )
    vector = F.when(names.isNull(), values).otherwise(
        F.transform(order, lambda c: F.coalesce(F.try_element_at(pairs, c), F.lit(0.0))))
    return F.struct(F.when(reject.isNull(), vector).alias("vector"), reject.alias("reject"))
