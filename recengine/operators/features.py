"""The ordered feature table, popularity and sampling weights."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recengine.functions.scalars import finite_or_zero, log_count, reciprocal
from recengine.operators.candidates import SOURCES
from recengine.schemas import assert_columns
from recengine.sources.scratch import written


def popularity(train: DataFrame, item_col: str = "item_id") -> DataFrame:
    """item_id, popularity: rows per item; null and non-positive ids don't count."""
    return train.where(F.col(item_col) > 0).groupBy(F.col(item_col).alias("item_id")).agg(F.count(F.lit(1)).alias("popularity"))


def negative_weights(counts: DataFrame, power: float = 0.75) -> DataFrame:
    """item_id, weight: count ** power as a share of all."""
    raw = counts.select("item_id", F.pow(F.col("popularity").cast("double"), F.lit(power)).alias("w"))
    return raw.join(F.broadcast(raw.agg(F.sum("w").alias("total")))).select("item_id", (F.col("w") / F.col("total")).alias("weight"))


def feature_names(sources: tuple[str, ...] = SOURCES) -> list[str]:
    """The feature contract: names in order."""
    return ["source_count", *(f"{s}_{kind}" for s in sources for kind in ("rank", "rr")), "popularity", "log_popularity"]


def feature_columns(sources: tuple[str, ...] = SOURCES) -> dict[str, Column]:
    """Name to expression, in the order of the feature contract."""
    out = {"source_count": F.col("source_count").cast("float")}
    for s in sources:
        out[f"{s}_rank"] = F.col(f"{s}_rank").cast("float")
        out[f"{s}_rr"] = reciprocal(F.col(f"{s}_rank"))
    out["popularity"] = F.coalesce("popularity", F.lit(0)).cast("float")
    out["log_popularity"] = log_count(F.coalesce("popularity", F.lit(0)))
    return out


def materialize_features(candidates: DataFrame, counts: DataFrame, sources: tuple[str, ...] = SOURCES, key: str = "query_id") -> DataFrame:
    """key, candidate_id, label, then the features in contract order, all finite floats; items without a count have 0."""
    rows = candidates.join(counts.withColumnRenamed("item_id", "candidate_id"), "candidate_id", "left")
    return rows.select(key, "candidate_id", "label", *[finite_or_zero(x).cast("float").alias(n) for n, x in feature_columns(sources).items()])


def assert_feature_contract(features: DataFrame, names: list[str]) -> DataFrame:
    """``features`` if its feature columns are exactly these in this order."""
    assert_columns(features, names)
    own = [c for c in features.columns if c in names]
    if own != names:
        raise ValueError(f"feature order differs: {own}")
    return features


def popular_items(counts: DataFrame, n: int) -> DataFrame:
    """The first n items by (popularity desc, id) with their rank."""
    top = counts.orderBy(F.desc("popularity"), "item_id").limit(n)
    return top.withColumn("rank", F.row_number().over(Window.orderBy(F.desc("popularity"), "item_id")))  # n rows


#: Most popular items that are broadcast as one list.
MOST_POPULAR = 4096


def recommend_popular(queries: DataFrame, counts: DataFrame, n: int, key: str = "query_id") -> DataFrame:
    """key, candidate_id, rank: the n most popular items without the query's seeds.

    ``queries`` has one row a key. A query lacks as many of the first items as it has seeds,
    so with short lists of seeds one list of popular items serves all, and nothing is
    shuffled. With longer ones only queries that have seeds among the first n meet further
    items, as many as they have seeds.
    """
    longest = queries.agg(F.coalesce(F.max(F.size("seeds")), F.lit(0))).first()[0]
    if n + max(0, longest) <= MOST_POPULAR:
        items = popular_items(counts, n + max(0, longest)).agg(F.array_sort(F.collect_list(F.struct("rank", "item_id"))).alias("top"))  # one row
        left = F.slice(F.filter(F.transform("top", lambda x: x["item_id"]), lambda x: ~F.array_contains("seeds", x)), 1, n)
        rows = queries.select(key, "seeds").join(F.broadcast(items)).select(key, F.posexplode(left).alias("rank", "candidate_id"))
        return rows.select(key, "candidate_id", (F.col("rank") + 1).alias("rank"))
    top = popular_items(counts, n).select(F.col("item_id").alias("candidate_id"), F.col("rank").alias("at"))  # n rows
    seeds = queries.select(key, F.explode(F.array_distinct("seeds")).alias("candidate_id"))
    # a query lacks as many of the first n as are its seeds; it gets the next ones that aren't
    lost = seeds.join(F.broadcast(top), "candidate_id").groupBy(key).agg(F.count(F.lit(1)).alias("lost"))
    first = queries.select(key, "seeds").join(F.broadcast(top)).where(~F.array_contains("seeds", F.col("candidate_id"))).select(key, "candidate_id", "at")
    short = queries.select(key, "seeds").join(lost, key)
    most = short.agg(F.coalesce(F.max(F.size("seeds")), F.lit(0))).first()[0]
    rest = popular_items(counts, n + most).where(F.col("rank") > n).select(F.col("item_id").alias("candidate_id"), F.col("rank").alias("at"))
    places = short.where(F.size("seeds") > 0).withColumn("at", F.explode(F.sequence(F.lit(n + 1), F.lit(n) + F.size("seeds"))))
    more = places.join(rest, "at").where(~F.array_contains("seeds", F.col("candidate_id")))
    allowed = first.unionByName(more.select(key, "candidate_id", "at"))
    return allowed.withColumn("rank", F.row_number().over(Window.partitionBy(key).orderBy("at"))).where(F.col("rank") <= n).select(key, "candidate_id", "rank")


def dense_index(items: DataFrame, id_col: str = "item_id") -> DataFrame:
    """id_col, item_index: 0-based by id, for ids of any orderable type.

    Distinct ids are dealt out by range and counted per range; they are numbered
    within the ranges, so no task holds all of them, however sparse they are.
    """
    spark = items.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = items.select(id_col).where(F.col(id_col).isNotNull()).distinct().repartitionByRange(parts, id_col)
    ids = written(ids.withColumn("_range", F.spark_partition_id()), "index-ranges")  # ranges are drawn once
    sums = ids.groupBy("_range").agg(F.count(F.lit(1)).alias("c"))
    earlier = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    before = F.broadcast(sums.select("_range", F.coalesce(F.sum("c").over(earlier), F.lit(0)).alias("before")))
    w = Window.partitionBy("_range").orderBy(id_col)
    return ids.join(before, "_range").select(id_col, (F.col("before") + F.row_number().over(w) - 1).alias("item_index"))
