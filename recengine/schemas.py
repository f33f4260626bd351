"""Table schemas and contract checks.

Checks are aggregates over whole tables: each gives a small report DataFrame, and
``require`` turns a report with violations into an error.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


class ContractError(ValueError):
    """A table breaks its contract."""


def _fields(*pairs: tuple[str, T.DataType]) -> T.StructType:
    return T.StructType([T.StructField(n, t) for n, t in pairs])


_LONG, _DOUBLE, _TEXT, _LONGS, _TEXTS = T.LongType(), T.DoubleType(), T.StringType(), T.ArrayType(T.LongType()), T.ArrayType(T.StringType())

# Column names and types of the raw files, the catalog and the tables built from them.
RAW = {
    "movies": _fields(("movieId", _LONG), ("title", _TEXT), ("genres", _TEXT)),
    "links": _fields(("movieId", _LONG), ("imdbId", _LONG), ("tmdbId", _LONG)),
    "ratings": _fields(("userId", _LONG), ("movieId", _LONG), ("rating", _DOUBLE), ("timestamp", _LONG)),
    "tags": _fields(("userId", _LONG), ("movieId", _LONG), ("tag", _TEXT), ("timestamp", _LONG)),
}
CATALOG = _fields(
    ("movie_id", _LONG), ("tmdb_id", _LONG), ("imdb_id", _TEXT), ("title", _TEXT), ("overview", _TEXT), ("genres", _TEXTS), ("keywords", _TEXTS), ("top_cast", _TEXTS),
    ("director", _TEXT), ("runtime_minutes", _LONG), ("release_year", _LONG), ("release_date", _TEXT), ("popularity_score", _DOUBLE), ("vote_count", _LONG), ("vote_average", _DOUBLE),
    ("imdb_rating", _DOUBLE), ("imdb_votes", _LONG), ("poster_path", _TEXT), ("backdrop_path", _TEXT), ("language", _TEXT), ("country", _TEXT), ("collection_id", _LONG), ("collection_name", _TEXT),
)
INTERACTIONS = _fields(("user_id", _LONG), ("item_id", _LONG), ("rating", _DOUBLE), ("ts", _LONG), ("ord", _LONG))
QUERIES = _fields(("query_id", _TEXT), ("user_id", _LONG), ("seeds", _LONGS), ("truth", _LONGS), ("history_end_ts", _LONG), ("truth_start_ts", _LONG))
NEIGHBORS = _fields(("source", _TEXT), ("seed_id", _LONG), ("candidate_id", _LONG), ("score", _DOUBLE), ("rank", T.IntegerType()))


def assert_columns(df: DataFrame, required: T.StructType | list[str], exact: bool = False) -> DataFrame:
    """``df`` itself if it has the required columns (and, if ``exact``, no others); missing names are reported sorted."""
    names = required if isinstance(required, list) else required.names
    missing = sorted(set(names) - set(df.columns))
    if missing:
        raise ContractError(f"missing columns: {missing}")
    extra = sorted(set(df.columns) - set(names))
    if exact and extra:
        raise ContractError(f"unexpected columns: {extra}")
    return df


def cast_report(df: DataFrame, schema: T.StructType) -> DataFrame:
    """One row per column of ``schema``: column, uncastable (values that aren't null but become null by the cast). One pass."""
    assert_columns(df, schema)
    counts = df.agg(*[F.count_if(F.col(f.name).isNotNull() & F.col(f.name).try_cast(f.dataType).isNull()).alias(f.name) for f in schema])
    return counts.unpivot([], schema.names, "column", "uncastable") if len(schema) > 1 else counts.select(F.lit(schema.names[0]).alias("column"), F.col(schema.names[0]).alias("uncastable"))


def conform(df: DataFrame, schema: T.StructType, exact: bool = False) -> DataFrame:
    """``df`` with the columns of ``schema``, cast; an error if columns are missing or values uncastable."""
    assert_columns(df, schema, exact)
    bad = cast_report(df, schema).where("uncastable > 0").collect()
    if bad:
        raise ContractError(f"uncastable values: { {r['column']: r['uncastable'] for r in bad} }")
    return df.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in schema])


def _integer(value: Column) -> tuple[Column, Column, Column]:
    """The value as a long (exact up to 64 bits; null where it has no such form), whether it is malformed, and whether it has a fraction."""
    number = value.try_cast("decimal(38,18)")
    long = F.floor(number).try_cast("bigint")
    approximate = value.try_cast("double")
    fractional = number.isNotNull() & ((number != F.floor(number)) | F.coalesce((F.abs(approximate) < F.lit(2.0**52)) & (approximate % 1 != 0), F.lit(False)))
    return long, value.isNotNull() & long.isNull(), fractional


def to_integer(value: Column, nullable: bool = False) -> Column:
    """A long from any number or text, exact over all 64 bits; a malformed value is an error unless ``nullable`` (then null), a fractional one always is."""
    long, malformed, fractional = _integer(value)
    bad = malformed | value.isNull() if not nullable else F.lit(False)
    return (
        F.when(fractional, F.raise_error(F.lit("fractional value in an integer column")).cast("long"))
        .when(bad, F.raise_error(F.lit("not an integer")).cast("long"))
        .otherwise(long)
    )


def integer_report(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row per column: column, malformed, fractional, missing."""
    parts = []
    for c in columns:
        _, malformed, fractional = _integer(F.col(c))
        parts += [F.count_if(malformed), F.count_if(fractional), F.count_if(F.col(c).isNull())]
    row = df.agg(*[p.alias(f"{k}") for k, p in enumerate(parts)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"{3 * k}").alias("malformed"), F.col(f"{3 * k + 1}").alias("fractional"), F.col(f"{3 * k + 2}").alias("missing")) for k, c in enumerate(columns)])).alias("r")).select("r.*")


def canonical_interactions(df: DataFrame, names: dict[str, str], columns: tuple[str, ...] = ("user_id", "item_id", "source_item_id", "rating", "ts")) -> DataFrame:
    """``df`` renamed by ``names`` (raw to canonical) and cut to ``columns`` in this order; a missing one is an error."""
    return assert_columns(df.withColumnsRenamed(names), list(columns)).select(*columns)


def valid_interactions(df: DataFrame) -> DataFrame:
    """Rows with positive ids and a finite rating."""
    return df.where((F.col("user_id") > 0) & (F.col("item_id") > 0) & is_finite(F.col("rating")))


def invalid_interaction_counts(df: DataFrame) -> DataFrame:
    """bad_user, bad_item, bad_rating over the whole table in one row."""
    return df.agg(
        F.count_if(F.coalesce(F.col("user_id") <= 0, F.lit(True))).alias("bad_user"),
        F.count_if(F.coalesce(F.col("item_id") <= 0, F.lit(True))).alias("bad_item"),
        F.count_if(~F.coalesce(is_finite(F.col("rating")), F.lit(False))).alias("bad_rating"),
    )


def is_finite(value: Column) -> Column:
    return ~F.isnan(value) & (F.abs(value) != F.lit(float("inf")))


def representable_report(df: DataFrame, columns: list[str], bound: float = 3.4028234663852886e38) -> DataFrame:
    """One row per feature column: column, not_finite, out_of_range (of the target precision)."""
    row = df.agg(*[x for k, c in enumerate(columns) for x in (F.count_if(~is_finite(F.col(c))).alias(f"a{k}"), F.count_if(is_finite(F.col(c)) & (F.abs(F.col(c)) > bound)).alias(f"b{k}"))])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(f"a{k}").alias("not_finite"), F.col(f"b{k}").alias("out_of_range")) for k, c in enumerate(columns)])).alias("r")).select("r.*")


def require(report: DataFrame, columns: list[str]) -> None:
    """An error if any of the report's counts isn't 0."""
    bad = report.where(reduce(lambda a, b: a | b, [F.col(c) > 0 for c in columns])).limit(20).collect()
    if bad:
        raise ContractError("; ".join(str(r.asDict()) for r in bad))
