"""Registry of queries and their checking SQL."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from faultline.catalog.views import VIEWS_SQL, Tables
from faultline.session import prepare

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def tidy(df: DataFrame) -> DataFrame:
    """Report form: doubles to six decimals, times without a zone (they are UTC)."""
    cols = []
    for f in df.schema.fields:
        c = f"`{f.name}`"
        if isinstance(f.dataType, (T.DoubleType, T.FloatType)):
            c = f"round(CAST({c} AS DOUBLE), 6) + 0D AS {c}"
        elif isinstance(f.dataType, T.TimestampType):
            c = f"CAST({c} AS TIMESTAMP_NTZ) AS {c}"
        cols.append(c)
    return df.selectExpr(*cols)


def with_views(body: str) -> str:
    """Prepend the view definitions a statement uses, in order of definition."""
    needed: set[str] = set()

    def visit(text: str) -> None:
        for name in set(re.findall(r"\bv_[a-z_]+\b", text)):
            if name in VIEWS_SQL and name not in needed:
                needed.add(name)
                visit(VIEWS_SQL[name])

    visit(body)
    ctes = [f"{n} AS ({VIEWS_SQL[n].strip()})" for n in VIEWS_SQL if n in needed]
    body = body.strip()
    if not ctes:
        return body
    if body[:5].upper() == "WITH ":
        rest = body[5:]
        if rest[:10].upper() == "RECURSIVE ":
            return "WITH RECURSIVE " + ",\n".join(ctes) + ",\n" + rest[10:]
        return "WITH " + ",\n".join(ctes) + ",\n" + rest
    return "WITH " + ",\n".join(ctes) + "\n" + body


def query(key: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return tidy(fn(Tables(prepare(spark), sf_dir)))

        run.__name__ = key
        run.__doc__ = fn.__doc__
        if key in QUERIES:
            raise ValueError(f"query {key} registered twice")
        QUERIES[key] = run
        if sql:
            ORACLES[key] = with_views(sql)
        return fn

    return register
