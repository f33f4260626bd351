"""Registration of queries with their SQL, and the views of the driver tables that both sides share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

#: Kinds of result columns: long, double (rounded to 6 digits), fine double (to 9), string, boolean.
_SPARK = {"l": lambda c: F.col(c).cast("bigint"), "d": lambda c: F.round(F.col(c).cast("double"), 6), "f": lambda c: F.round(F.col(c).cast("double"), 9), "s": lambda c: F.col(c).cast("string"), "b": lambda c: F.col(c).cast("boolean")}
_SQL = {"l": "CAST({0} AS BIGINT)", "d": "round(CAST({0} AS DOUBLE), 6)", "f": "round(CAST({0} AS DOUBLE), 9)", "s": "CAST({0} AS VARCHAR)", "b": "CAST({0} AS BOOLEAN)"}

#: Common table expressions by name, each with those it needs.
CTES: dict[str, tuple[tuple[str, ...], str]] = {}


def cte(name: str, sql: str, *needs: str) -> None:
    CTES[name] = (needs, sql)


def _with(names: tuple[str, ...]) -> str:
    order: list[str] = []

    def add(n: str) -> None:
        for m in CTES[n][0]:
            add(m)
        if n not in order:
            order.append(n)

    for n in names:
        add(n)
    return "WITH " + ", ".join(f"{n} AS ({CTES[n][1]})" for n in order) + " " if order else ""


def query(name: str, columns: str, sql: str | None = None, *needs: str):
    """Register f(spark, sf_dir). ``columns``: the result's columns as name:kind; ``sql`` gives columns of the same names."""
    spec = [c.split(":") for c in columns.split()]

    def put(f: Callable[[SparkSession, str], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(spark, sf_dir).select(*[_SPARK[k](c).alias(c) for c, k in spec])
        if sql is not None:
            out = ", ".join(f'{_SQL[k].format(chr(34) + c + chr(34))} AS "{c}"' for c, k in spec)
            ORACLE[name] = f"{_with(needs)}SELECT {out} FROM ({sql}) AS result"
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
