"""Registered queries: sources, contracts, catalog, splits, payloads and catalog views."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine import schemas
from recengine.functions import scalars as S
from recengine.operators import catalog as C
from recengine.operators import datasets as O
from recengine.operators import payloads as Y
from recengine.operators import splits as P
from recengine.operators.features import dense_index, negative_weights, popularity
from recengine.operators.validation import validate_dataset
from recengine.plans import views as V
from recengine.plans.registry import query, table
from recengine.sources import tables as IO
from recengine.sources.scratch import scratch_path, written

# --- sources and sinks ---


@query(
    "s1_read_raw_csv",
    "file:s rows:l first:l last:l",
    "SELECT 'links' AS file, count(*) AS rows, min(source_item_id) AS first, max(source_item_id) AS last FROM links UNION "
    "ALL SELECT 'ratings', count(*), min(user_id), max(user_id) FROM interactions UNION ALL SELECT 'tags', count(*), min(item_id), "
    "max(item_id) FROM interactions UNION ALL SELECT 'movies', count(*), min(p_partkey), max(p_partkey) FROM part",
    "links",
    "interactions",
)
def s1_read_raw_csv(spark, d):
    folder = scratch_path(spark, "raw")
    k = V.links(spark, d)
    k.select(F.col("source_item_id").alias("movieId"), F.lit(0).alias("imdbId"), F.col("item_id").alias("tmdbId")).write.option("header", True).csv(f"{folder}/links.csv")
    x = V.interactions(spark, d)
    x.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", F.col("ts").alias("timestamp")).write.option("header", True).csv(f"{folder}/ratings.csv")
    x.select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), F.lit("t").alias("tag"), F.col("ts").alias("timestamp")).write.option("header", True).csv(f"{folder}/tags.csv")
    table(spark, d, "part").select(F.col("p_partkey").alias("movieId"), F.col("p_name").alias("title"), F.col("p_type").alias("genres")).write.option("header", True).csv(f"{folder}/movies.csv")
    raw = IO.read_raw_csv(spark, folder)
    one = lambda name, col: raw[name].agg(F.lit(name).alias("file"), F.count(F.lit(1)).alias("rows"), F.min(F.col(col).cast("long")).alias("first"), F.max(F.col(col).cast("long")).alias("last"))
    return one("links", "movieId").unionByName(one("ratings", "userId")).unionByName(one("tags", "movieId")).unionByName(one("movies", "movieId"))


@query("s2_read_catalog", "rows:l ids:l", "SELECT count(*) AS rows, count(DISTINCT item_id) AS ids FROM catalog", "catalog")
def s2_read_catalog(spark, d):
    path = scratch_path(spark, "catalog")
    IO.write_table(V.catalog(spark, d).withColumnsRenamed({"item_id": "tmdb_id", "source_item_id": "movie_id"}), path)
    return IO.read_catalog(spark, path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("tmdb_id").alias("ids"))


@query(
    "s3_read_interactions",
    "user_id:l rows:l total:d",
    "SELECT user_id, count(*) AS rows, sum(rating) AS total FROM interactions GROUP BY user_id",
    "interactions",
)
def s3_read_interactions(spark, d):
    path = scratch_path(spark, "interactions")
    IO.write_table(V.interactions(spark, d), path)
    return IO.read_interactions(spark, path).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"), F.sum("rating").alias("total"))


@query("s4_write_parquet", "rows:l items:l", "SELECT count(*) AS rows, count(DISTINCT item_id) AS items FROM pos", "pos")
def s4_write_parquet(spark, d):
    path = scratch_path(spark, "positives")
    IO.write_table(V.positives(spark, d), path)
    return spark.read.parquet(path).agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("item_id").alias("items"))


@query(
    "s5_user_partitioned_write",
    "users:l users_in_one_file:l",
    "SELECT count(DISTINCT user_id) AS users, count(DISTINCT user_id) AS users_in_one_file FROM interactions",
    "interactions",
)
def s5_user_partitioned_write(spark, d):
    path = scratch_path(spark, "by-user")
    IO.write_by_user(V.interactions(spark, d), path, 8)
    files = spark.read.parquet(path).select("user_id", F.col("_metadata.file_name").alias("f")).distinct().groupBy("user_id").agg(F.count(F.lit(1)).alias("files"))
    return files.agg(F.count(F.lit(1)).alias("users"), F.count_if(F.col("files") == 1).alias("users_in_one_file"))


@query("s5_bucketed_split", "user_id:l item_id:l rating:d ts:l part:s", "SELECT user_id, item_id, rating, ts, part FROM split", "split")
def s5_bucketed_split(spark, d):
    """The split from a table bucketed by user: latest events, positions and cuts without a further shuffle."""
    events = IO.write_bucketed(V.interactions(spark, d), scratch_path(spark, "events-by-user"), "user_id", 8, ("ts",))
    return P.split_per_user(P.positives(events))


@query("s6_compact_parts", "files:l rows:l", "SELECT 1 AS files, count(*) AS rows FROM interactions", "interactions")
def s6_compact_parts(spark, d):
    parts, whole = scratch_path(spark, "parts"), scratch_path(spark, "whole")
    IO.write_by_user(V.interactions(spark, d), parts, 8, order=("ord",))
    IO.compact(spark, parts, whole)
    return spark.read.parquet(whole).agg(F.count_distinct(F.col("_metadata.file_name")).alias("files"), F.count(F.lit(1)).alias("rows"))


@query(
    "s7_incremental_ingest",
    "user_id:l rows:l runs:l other_settings_rejected:b",
    "SELECT user_id, count(*) AS rows, 2 AS runs, true AS other_settings_rejected FROM interactions GROUP BY user_id",
    "interactions",
)
def s7_incremental_ingest(spark, d):
    """A first run over some events, a second over all, a third that finds nothing new, and one with other settings."""
    x = written(V.interactions(spark, d), "arrivals")
    target, state = scratch_path(spark, "ingested"), scratch_path(spark, "ingest-state")
    for arrived in (x.where("ord % 3 = 0"), x, x):
        out = IO.ingest(spark, arrived, target, state, "ord", {"source": "events"})
    try:
        IO.ingest(spark, x, target, state, "ord", {"source": "others"})
        rejected = False
    except schemas.ContractError:
        rejected = True
    runs = spark.read.parquet(f"{state}/keys").agg(F.count_distinct("run").alias("runs"))
    return out.groupBy("user_id").agg(F.count(F.lit(1)).alias("rows")).join(F.broadcast(runs)).withColumn("other_settings_rejected", F.lit(rejected))


@query(
    "s8_merge_batches",
    "item_id:l rows:l lacking_batch_rejected:b",
    "SELECT item_id, count(*) AS rows, true AS lacking_batch_rejected FROM (SELECT * FROM interactions UNION ALL SELECT * "
    "FROM interactions WHERE ord % 2 = 0) GROUP BY item_id",
    "interactions",
)
def s8_merge_batches(spark, d):
    folder, x = scratch_path(spark, "batches"), V.interactions(spark, d)
    x.write.parquet(f"{folder}/movies_batch_0")
    x.where("ord % 2 = 0").write.parquet(f"{folder}/movies_batch_1")
    merged = IO.merge_batches(spark, f"{folder}/movies_batch_*", schemas.INTERACTIONS)
    x.drop("rating").write.parquet(f"{folder}/lacking_batch_2")
    try:
        IO.merge_batches(spark, f"{folder}/*_batch_*", schemas.INTERACTIONS)
        rejected = False
    except schemas.ContractError:
        rejected = True
    return merged.groupBy("item_id").agg(F.count(F.lit(1)).alias("rows")).withColumn("lacking_batch_rejected", F.lit(rejected))


@query(
    "s10_table_fingerprint",
    "rows:l same_in_any_order:b other_differs:b",
    "SELECT count(*) AS rows, true AS same_in_any_order, true AS other_differs FROM interactions",
    "interactions",
)
def s10_table_fingerprint(spark, d):
    x = V.interactions(spark, d)
    a, b, c = IO.fingerprint(x), IO.fingerprint(x.repartition(7, "item_id")).withColumnRenamed("content", "b").drop("rows"), IO.fingerprint(x.withColumn("ts", F.col("ts") + 1)).withColumnRenamed("content", "c").drop("rows")
    return a.join(F.broadcast(b)).join(F.broadcast(c)).select("rows", (F.col("content") == F.col("b")).alias("same_in_any_order"), (F.col("content") != F.col("c")).alias("other_differs"))


@query(
    "s10_changed_parts",
    "part:s status:s rows:l read:l",
    "SELECT concat('n=', substr(o_orderpriority, 1, 1)) AS part, CASE substr(o_orderpriority, 1, 1) WHEN '1' THEN 'changed' "
    "WHEN '2' THEN 'removed' WHEN '3' THEN 'touched' ELSE 'same' END AS status, count(*) AS rows, "
    "CASE WHEN substr(o_orderpriority, 1, 1) IN ('1', '3') THEN 1 ELSE 0 END AS read FROM orders GROUP BY ALL UNION ALL SELECT "
    "'n=9', 'added', count(*), 1 FROM orders WHERE o_orderpriority LIKE '5%'",
)
def s10_changed_parts(spark, d):
    """A table by order priority, against the fingerprints of its files from before: one part was changed, one went, one was written anew, one came."""
    path, orders = scratch_path(spark, "orders"), table(spark, d, "orders").withColumn("n", F.substring("o_orderpriority", 1, 1))
    orders.repartition("n").write.partitionBy("n").parquet(path)
    known = written(IO.file_fingerprints(spark, path), "fingerprints")
    of = lambda n: orders.where(F.col("n") == n).drop("n").repartition(1)
    dearer = of("1").withColumn("o_totalprice", F.col("o_totalprice") + F.when(F.col("o_orderkey") % 50 < 25, 1.0).otherwise(0.0))
    dearer.write.mode("overwrite").parquet(f"{path}/n=1")
    IO.remove(spark, f"{path}/n=2")
    of("3").write.mode("overwrite").parquet(f"{path}/n=3")
    of("5").write.parquet(f"{path}/n=9")
    return IO.changed_parts(spark, path, known)


@query(
    "s11_write_manifest",
    "name:s rows:l columns:l settings:s",
    "SELECT 'positives' AS name, count(*) AS rows, 5 AS columns, '{\"threshold\":\"3.0\"}' AS settings FROM pos",
    "pos",
)
def s11_write_manifest(spark, d):
    return IO.manifest("positives", V.positives(spark, d), threshold=3.0)


# --- contracts and filters ---


@query(
    "p2_to_integer",
    "number:l rows:l",
    "SELECT number, count(*) AS rows FROM (SELECT CASE WHEN p_partkey % 5 <> 0 THEN p_partkey END AS number FROM part) GROUP "
    "BY number",
)
def p2_to_integer(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 5 == 0, F.lit("n/a")).otherwise(F.concat(k.cast("string"), F.lit(".0")))
    return table(spark, d, "part").select(schemas.to_integer(text, nullable=True).alias("number")).groupBy("number").agg(F.count(F.lit(1)).alias("rows"))


@query("p2_large_integers", "number:l", "SELECT 9007199254740993 + p_partkey AS number FROM part")
def p2_large_integers(spark, d):
    """Beyond 2 ** 53 a double would lose the last digits."""
    return table(spark, d, "part").select(schemas.to_integer((F.col("p_partkey") + 9007199254740993).cast("string")).alias("number"))


@query(
    "p2_integer_violations",
    "column:s malformed:l fractional:l missing:l",
    "SELECT 'a' AS \"column\", count(*) FILTER (p_partkey % 5 = 0 AND p_partkey % 3 <> 0) AS malformed, count(*) FILTER (p_partkey "
    "% 5 <> 0 AND p_partkey % 3 <> 0 AND p_partkey % 7 = 0) AS fractional, count(*) FILTER (p_partkey % 3 = 0) AS missing "
    "FROM part",
)
def p2_integer_violations(spark, d):
    k = F.col("p_partkey")
    text = F.when(k % 3 != 0, F.when(k % 5 == 0, F.lit("n/a")).when(k % 7 == 0, F.concat(k.cast("string"), F.lit(".5"))).otherwise(k.cast("string")))
    return schemas.integer_report(table(spark, d, "part").select(text.alias("a")), ["a"])


@query(
    "p3_assert_schema",
    "column:s uncastable:l",
    "SELECT 'item_id' AS \"column\", 0 AS uncastable UNION ALL SELECT 'text', count(*) FILTER (p_partkey % 4 = 0) FROM part",
)
def p3_assert_schema(spark, d):
    k = F.col("p_partkey")
    rows = table(spark, d, "part").select(k.alias("item_id"), F.when(k % 4 == 0, F.lit("x")).otherwise(k.cast("string")).alias("text"))
    return schemas.cast_report(rows, T.StructType([T.StructField("item_id", T.LongType()), T.StructField("text", T.DoubleType())]))


@query("p4_positive_filter", "user_id:l item_id:l rating:d ts:l", "SELECT user_id, item_id, rating, ts FROM pos", "pos")
def p4_positive_filter(spark, d):
    return V.positives(spark, d)


_FAULTY = "SELECT CASE WHEN ord % 11 = 0 THEN -user_id ELSE user_id END AS user_id, CASE WHEN ord % 13 = 0 THEN 0 ELSE item_id END AS item_id, CASE WHEN ord % 17 = 0 THEN CAST('NaN' AS DOUBLE) WHEN ord % 19 = 0 THEN CAST('Infinity' AS DOUBLE) ELSE rating END AS rating FROM interactions"


def _faulty(spark, d):
    o = F.col("ord")
    rating = F.when(o % 17 == 0, F.lit(float("nan"))).when(o % 19 == 0, F.lit(float("inf"))).otherwise(F.col("rating"))
    return V.interactions(spark, d).select(F.when(o % 11 == 0, -F.col("user_id")).otherwise(F.col("user_id")).alias("user_id"), F.when(o % 13 == 0, 0).otherwise(F.col("item_id")).alias("item_id"), rating.alias("rating"))


@query(
    "p5_valid_ids",
    "user_id:l rows:l",
    f"SELECT user_id, count(*) AS rows FROM ({_FAULTY}) WHERE user_id > 0 AND item_id > 0 AND isfinite(rating) GROUP BY user_id",
    "interactions",
)
def p5_valid_ids(spark, d):
    return schemas.valid_interactions(_faulty(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "p5_invalid_counts",
    "bad_user:l bad_item:l bad_rating:l",
    "SELECT count(*) FILTER (user_id <= 0) AS bad_user, count(*) FILTER (item_id <= 0) AS bad_item, count(*) FILTER (NOT "
    f"isfinite(rating)) AS bad_rating FROM ({_FAULTY})",
    "interactions",
)
def p5_invalid_counts(spark, d):
    return schemas.invalid_interaction_counts(_faulty(spark, d))


@query(
    "p6_rename_reorder",
    "user_id:l item_id:l source_item_id:l rating:d ts:l",
    "SELECT user_id, i.item_id, source_item_id, rating, ts FROM interactions i JOIN catalog USING (item_id)",
    "interactions",
    "catalog",
)
def p6_rename_reorder(spark, d):
    raw = V.interactions(spark, d).join(V.catalog(spark, d), "item_id").withColumnsRenamed({"user_id": "userId", "ts": "timestamp"})
    return schemas.canonical_interactions(raw, {"userId": "user_id", "timestamp": "ts"})


_DIRTY = "SELECT user_id, list_concat(list_concat(list(item_id ORDER BY ts, ord, item_id), [0, -1]), list(item_id ORDER BY ts, ord, item_id)) AS seeds FROM interactions GROUP BY user_id"


def _dirty(spark, d):
    ordered = V.interactions(spark, d).groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("ts", "ord", "item_id"))).alias("e")).select("user_id", F.transform("e", lambda x: x["item_id"]).alias("s"))
    return ordered.select("user_id", F.concat("s", F.array(F.lit(0).cast("long"), F.lit(-1).cast("long")), "s").alias("seeds"))


@query(
    "p7_seed_normalisation",
    "user_id:l seeds:s",
    "SELECT user_id, array_to_string(list_transform(list_filter(seeds, lambda x, i: x > 0 AND list_position(seeds, x) = i), "
    f"lambda x: CAST(x AS VARCHAR)), ',') AS seeds FROM ({_DIRTY})",
    "interactions",
)
def p7_seed_normalisation(spark, d):
    return _dirty(spark, d).select("user_id", F.array_join(S.clean_seeds(F.col("seeds")).cast("array<string>"), ",").alias("seeds"))


@query(
    "p8_sanitize",
    "user_id:l recommended:s",
    "SELECT user_id, array_to_string(list_transform(list_filter(seeds, lambda x, i: x > 0 AND x % 3 <> 0 AND list_position(seeds, "
    f"x) = i)[1:7], lambda x: CAST(x AS VARCHAR)), ',') AS recommended FROM ({_DIRTY})",
    "interactions",
)
def p8_sanitize(spark, d):
    return _dirty(spark, d).select("user_id", F.array_join(S.sanitize(F.col("seeds"), F.filter("seeds", lambda x: x % 3 == 0), 7).cast("array<string>"), ",").alias("recommended"))


@query(
    "p10_representable",
    "column:s not_finite:l out_of_range:l",
    "SELECT 'rating' AS \"column\", count(*) FILTER (NOT isfinite(rating)) AS not_finite, count(*) FILTER (isfinite(rating) "
    f"AND rating > 4) AS out_of_range FROM ({_FAULTY})",
    "interactions",
)
def p10_representable(spark, d):
    return schemas.representable_report(_faulty(spark, d), ["rating"], 4.0)


@query("p11_display_filter", "item_id:l", "SELECT item_id FROM catalog WHERE poster_path IS NOT NULL AND NOT adult", "catalog")
def p11_display_filter(spark, d):
    return C.displayable(V.catalog(spark, d))


# --- catalog building ---

_GOOD = "SELECT source_item_id, item_id FROM links WHERE item_id IS NOT NULL QUALIFY count(*) OVER (PARTITION BY source_item_id) = 1 AND count(*) OVER (PARTITION BY item_id) = 1"


@query("a1_ambiguous_keys", "source_item_id:l item_id:l", _GOOD, "links")
def a1_ambiguous_keys(spark, d):
    return C.unambiguous_links(V.links(spark, d))


@query(
    "a2_exact_pairs",
    "source_item_id:l item_id:l",
    "SELECT source_item_id, item_id FROM (SELECT * FROM links UNION ALL SELECT * FROM links WHERE source_item_id % 4 = 0) "
    "WHERE item_id IS NOT NULL GROUP BY ALL HAVING count(*) = 1",
    "links",
)
def a2_exact_pairs(spark, d):
    k = V.links(spark, d).where("item_id is not null")
    return C.unique_only(k.unionByName(k.where("source_item_id % 4 = 0")), "source_item_id", "item_id")


_SUMMARY = f"""SELECT count(*) AS links, count(*) FILTER (item_id IS NULL) AS unmapped, (SELECT count(*) FROM m WHERE ns > 1) AS ambiguous_source, (SELECT count(*) FROM m WHERE ni > 1) AS ambiguous_item, (SELECT count(*) FROM m WHERE ns > 1 OR ni > 1) AS ambiguous,
  (SELECT count(*) FROM ({_GOOD}) g WHERE NOT EXISTS (SELECT 1 FROM metadata x WHERE x.source_item_id = g.source_item_id AND x.item_id = g.item_id)) AS mismatch, (SELECT count(*) FROM ({_GOOD}) g JOIN metadata x USING (source_item_id, item_id)) AS retained
  FROM links"""


@query(
    "a3_exclusion_summary",
    "links:l unmapped:l ambiguous_source:l ambiguous_item:l ambiguous:l mismatch:l retained:l",
    "WITH m AS (SELECT *, count(*) OVER (PARTITION BY source_item_id) AS ns, count(*) OVER (PARTITION BY item_id) AS ni FROM "
    f"links WHERE item_id IS NOT NULL) {_SUMMARY}",
    "links",
    "metadata",
)
def a3_exclusion_summary(spark, d):
    return C.exclusion_summary(V.links(spark, d), V.metadata(spark, d))


_CATALOG = f"SELECT x.item_id, x.source_item_id, x.title, row_number() OVER (ORDER BY x.item_id) - 1 AS item_index FROM metadata x JOIN ({_GOOD}) g USING (source_item_id, item_id)"


@query("j1_catalog_join", "item_id:l source_item_id:l title:s", f"SELECT item_id, source_item_id, title FROM ({_CATALOG})", "metadata", "links")
@query("e1_prepare_catalog", "item_id:l source_item_id:l title:s item_index:l", _CATALOG, "metadata", "links")
def e1_prepare_catalog(spark, d):
    return C.prepare_catalog(V.links(spark, d), V.metadata(spark, d))


def _ratings(spark, d):
    return V.interactions(spark, d).select("user_id", F.col("item_id").alias("source_item_id"), "rating", "ts")


def _prepared(spark, d, *keys):
    rows = C.prepare_interactions(_ratings(spark, d), C.prepare_catalog(V.links(spark, d), V.metadata(spark, d)))
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows"))


@query(
    "j2_interactions_to_catalog",
    "user_id:l item_id:l rows:l",
    f"SELECT user_id, c.item_id, count(*) AS rows FROM interactions i JOIN ({_CATALOG}) c ON c.source_item_id = i.item_id "
    "GROUP BY 1, 2",
    "interactions",
    "metadata",
    "links",
)
def j2_interactions_to_catalog(spark, d):
    return _prepared(spark, d, "user_id", "item_id")


@query(
    "e2_prepare_interactions",
    "item_id:l rows:l",
    f"SELECT c.item_id, count(*) AS rows FROM interactions i JOIN ({_CATALOG}) c ON c.source_item_id = i.item_id GROUP BY "
    "1",
    "interactions",
    "metadata",
    "links",
)
def e2_prepare_interactions(spark, d):
    return _prepared(spark, d, "item_id")


@query(
    "j3_tags_to_catalog",
    "item_id:l tag:s rows:l",
    f"SELECT c.item_id, event_type AS tag, count(*) AS rows FROM stream s JOIN ({_CATALOG}) c ON c.source_item_id = s.item_id "
    "GROUP BY 1, 2",
    "stream",
    "metadata",
    "links",
)
def j3_tags_to_catalog(spark, d):
    tags = V.events(spark, d).select("user_id", F.col("item_id").alias("source_item_id"), F.col("event_type").alias("tag"))
    return C.prepare_tags(tags, C.prepare_catalog(V.links(spark, d), V.metadata(spark, d))).groupBy("item_id", "tag").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "e3_build_processed",
    "part:s rows:l",
    f"WITH c AS ({_CATALOG}) SELECT 'catalog' AS part, count(*) AS rows FROM c UNION ALL SELECT 'interactions', count(*) FROM "
    "interactions i JOIN c ON c.source_item_id = i.item_id UNION ALL SELECT 'tags', count(*) FROM stream s JOIN c ON c.source_item_id "
    "= s.item_id "
    f"UNION ALL SELECT 'unmapped', count(*) FROM links WHERE item_id IS NULL",
    "interactions", "metadata", "links", "stream",
)
def e3_build_processed(spark, d):
    raw = {
        "links": V.links(spark, d).select(F.col("source_item_id").cast("string").alias("movieId"), F.col("item_id").cast("string").alias("tmdbId")),
        "ratings": V.interactions(spark, d).select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), "rating", F.col("ts").alias("timestamp")),
        "tags": V.events(spark, d).select(F.col("user_id").alias("userId"), F.col("item_id").alias("movieId"), F.col("event_type").alias("tag"), F.col("epoch").alias("timestamp")),
    }
    out = C.build_processed(raw, V.metadata(spark, d).withColumnsRenamed({"source_item_id": "movie_id", "item_id": "tmdb_id"}))
    n = lambda name: out[name].agg(F.lit(name).alias("part"), F.count(F.lit(1)).alias("rows"))
    return n("catalog").unionByName(n("interactions")).unionByName(n("tags")).unionByName(out["exclusions"].select(F.lit("unmapped").alias("part"), F.col("unmapped").alias("rows")))


@query(
    "e10_unique_ids",
    "rows:l missing:l repeated:l",
    "SELECT count(*) AS rows, count(*) FILTER (item_id IS NULL) AS missing, count(item_id) - count(DISTINCT item_id) AS repeated "
    "FROM links",
    "links",
)
def e10_unique_ids(spark, d):
    return C.unique_id_report(V.links(spark, d))


@query(
    "w11_dense_index",
    "item_id:l item_index:l",
    "SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_index FROM (SELECT DISTINCT item_id FROM pos)",
    "pos",
)
def w11_dense_index(spark, d):
    return dense_index(V.positives(spark, d))


_BROKEN_INDEX = "SELECT CASE WHEN item_id % 11 = 0 THEN -item_id WHEN item_id % 7 = 0 THEN item_id - 1 ELSE item_id END AS item_id, CASE WHEN item_id % 5 = 0 THEN item_index + 1 ELSE item_index END AS item_index FROM (SELECT item_id, row_number() OVER (ORDER BY item_id) - 1 AS item_index FROM (SELECT DISTINCT item_id FROM pos))"


@query(
    "e18_dense_index_checks",
    "bad_ids:l repeated_ids:l repeated_positions:l gaps:l loose_edges:l",
    f"WITH x AS ({_BROKEN_INDEX}) SELECT (SELECT count(*) FROM x WHERE item_id <= 0) AS bad_ids, (SELECT count(*) - count(DISTINCT "
    "item_id) FROM x) AS repeated_ids, (SELECT count(*) - count(DISTINCT item_index) FROM x) AS repeated_positions, "
    "(SELECT max(item_index) + 1 - count(DISTINCT item_index) + min(item_index) FROM x) AS gaps, (SELECT count(*) FROM (SELECT "
    "seed_id AS x FROM content UNION ALL SELECT candidate_id FROM content) WHERE x NOT IN (SELECT item_id FROM x)) AS loose_edges",
    "content", "pos",
)
def e18_dense_index_checks(spark, d):
    """The checks of an index with planted faults: negative, repeated and shifted entries."""
    k, at = F.col("item_id"), F.col("item_index")
    broken = dense_index(V.positives(spark, d)).select(F.when(k % 11 == 0, -k).when(k % 7 == 0, k - 1).otherwise(k).alias("item_id"), F.when(k % 5 == 0, at + 1).otherwise(at).alias("item_index"))
    return C.assert_dense_index(broken, V.content_neighbors(spark, d))


@query(
    "e19_vector_checks",
    "vectors:l dims:l not_finite:l repeated_ids:l",
    "SELECT count(*) AS vectors, count(DISTINCT CASE WHEN item_id % 13 = 0 THEN 3 ELSE len(vector) END) AS dims, count(*) "
    "FILTER (item_id % 13 <> 0 AND item_id % 5 = 0) AS not_finite, count(*) - count(DISTINCT CASE WHEN item_id % 7 = 0 THEN "
    "item_id - 1 ELSE item_id END) AS repeated_ids FROM vectors",
    "vectors",
)
def e19_vector_checks(spark, d):
    """The checks of vectors with planted faults: short, not finite and repeated ones."""
    k, v = F.col("item_id"), F.col("vector").cast("array<double>")
    bad = F.concat(F.slice(v, 1, 3), F.array(F.when(k % 2 == 0, F.lit(float("nan"))).otherwise(F.lit(float("-inf")))), F.slice(v, 5, 1000))
    return C.assert_vectors(V.vectors(spark, d).select(F.when(k % 7 == 0, k - 1).otherwise(k).alias("item_id"), F.when(k % 13 == 0, F.slice(v, 1, 3)).when(k % 5 == 0, bad).otherwise(v).alias("vector")))


@query(
    "e21_missing_seed_metadata",
    "request_id:l seed_id:l",
    "SELECT DISTINCT user_id AS request_id, item_id AS seed_id FROM stream WHERE item_id NOT IN (SELECT item_id FROM catalog "
    "WHERE item_id % 5 <> 0)",
    "stream",
    "catalog",
)
def e21_missing_seed_metadata(spark, d):
    requests = V.events(spark, d).groupBy(F.col("user_id").alias("request_id")).agg(F.collect_set("item_id").alias("seeds"))
    return C.missing_seed_metadata(requests, V.catalog(spark, d).where("item_id % 5 <> 0"))


@query("j12_resume_selection", "item_id:l", "SELECT item_id FROM catalog WHERE item_id % 3 = 0 AND item_id % 2 <> 0", "catalog")
def j12_resume_selection(spark, d):
    c = V.catalog(spark, d)
    todo = IO.unprocessed(c, c.where("item_id % 2 = 0"), "item_id")
    return C.lookup(todo, c.where("item_id % 3 = 0"))


# --- events, splits ---


@query("a4_latest_event", "user_id:l item_id:l rating:d ts:l ord:l", "SELECT * FROM latest", "latest")
def a4_latest_event(spark, d):
    return P.latest_events(V.interactions(spark, d))


@query("a5_popularity_counts", "item_id:l popularity:l", "SELECT * FROM popularity", "popularity")
def a5_popularity_counts(spark, d):
    return popularity(V.train(spark, d))


@query(
    "a6_interaction_counts",
    "users:l items:l cells:l rows:l",
    "SELECT count(DISTINCT user_id) AS users, count(DISTINCT item_id) AS items, (SELECT count(*) FROM (SELECT DISTINCT user_id, "
    "item_id FROM interactions)) AS cells, count(*) AS rows FROM interactions",
    "interactions",
)
def a6_interaction_counts(spark, d):
    return P.interaction_counts(V.interactions(spark, d))


@query(
    "a7_duplicate_cell_sum",
    "user_id:l item_id:l rating:d",
    "SELECT user_id, item_id, sum(rating) AS rating FROM interactions GROUP BY 1, 2",
    "interactions",
)
def a7_duplicate_cell_sum(spark, d):
    return P.summed_cells(V.interactions(spark, d))


@query(
    "a13_array_collection",
    "user_id:l truth:s",
    "SELECT user_id, array_to_string(list_transform(truth, lambda x: CAST(x AS VARCHAR)), ',') AS truth FROM test_queries",
    "test_queries",
)
def a13_array_collection(spark, d):
    return P.query_records(V.split(spark, d), "test").select("user_id", F.array_join(F.col("truth").cast("array<string>"), ",").alias("truth"))


@query(
    "a14_latency_percentiles",
    "event_type:s n:l mean:d max:d p50:d p95:d p99:d",
    "SELECT event_type, count(value) AS n, avg(value) AS mean, max(value) AS max, quantile_cont(value, 0.5) AS p50, quantile_cont(value, "
    "0.95) AS p95, quantile_cont(value, 0.99) AS p99 FROM events GROUP BY event_type",
)
def a14_latency_percentiles(spark, d):
    from recengine.operators.metrics import latency_summary

    return latency_summary(table(spark, d, "events"), "value", ("event_type",))


@query(
    "a16_negative_weights",
    "item_id:l weight:d",
    "SELECT item_id, pow(popularity, CAST(0.75 AS DOUBLE)) / sum(pow(popularity, CAST(0.75 AS DOUBLE))) OVER () AS weight "
    "FROM popularity",
    "popularity",
)
def a16_negative_weights(spark, d):
    return negative_weights(popularity(V.train(spark, d)))


@query("w1_split_per_user", "user_id:l item_id:l rating:d ts:l part:s", "SELECT user_id, item_id, rating, ts, part FROM split", "split")
def w1_split_per_user(spark, d):
    return V.split(spark, d)


_ORDERED = "o AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS i, count(*) OVER () AS n FROM pos)"


@query(
    "w2_global_cutoffs",
    "validation_start:l test_start:l total:l",
    f"WITH {_ORDERED} SELECT min(ts) FILTER (ts > b1) AS validation_start, min(ts) FILTER (ts > b2) AS test_start, max(n) "
    "AS total FROM o, (SELECT max(ts) FILTER (i = CAST(ceil(CAST(0.6 AS DOUBLE) * (n - 1)) AS BIGINT)) AS b1, max(ts) FILTER "
    "(i = CAST(ceil((CAST(0.6 AS DOUBLE) + CAST(0.2 AS DOUBLE)) * (n - 1)) AS BIGINT)) AS b2 FROM o)",
    "pos",
)
def w2_global_cutoffs(spark, d):
    return P.global_cutoffs(V.positives(spark, d))


_GLOBAL = (
    f"WITH {_ORDERED}, c AS (SELECT min(ts) FILTER (ts > b1) AS v, min(ts) FILTER (ts > b2) AS t FROM o, (SELECT max(ts) FILTER "
    "(i = CAST(ceil(CAST(0.6 AS DOUBLE) * (n - 1)) AS BIGINT)) AS b1, max(ts) FILTER (i = CAST(ceil((CAST(0.6 AS DOUBLE) "
    "+ CAST(0.2 AS DOUBLE)) * (n - 1)) AS BIGINT)) AS b2 FROM o)), "
    "p AS (SELECT pos.*, CASE WHEN ts < v THEN 'train' WHEN ts < t THEN 'validation' ELSE 'test' END AS part FROM pos, c) "
    "SELECT user_id, item_id, part FROM p "
    "QUALIFY count(*) OVER (PARTITION BY user_id) >= 8 AND count(*) FILTER (part = 'train') OVER (PARTITION BY user_id) >= "
    "6 AND count(*) FILTER (part = 'validation') OVER (PARTITION BY user_id) > 0 AND count(*) FILTER (part = 'test') OVER "
    "(PARTITION BY user_id) > 0"
)


@query("w2_split_global", "user_id:l item_id:l part:s", _GLOBAL, "pos")
def w2_split_global(spark, d):
    return P.split_global(written(V.positives(spark, d), "positives"))


@query(
    "e12_split_dataset",
    "strategy:s status:s positive_rows:l eligible_users:l excluded_users:l train_rows:l validation_rows:l test_rows:l validation_queries:l "
    "test_queries:l",
    "SELECT strategy, 'complete' AS status, (SELECT count(*) FROM pos) AS positive_rows, count(DISTINCT user_id) AS eligible_users, "
    "(SELECT count(DISTINCT user_id) FROM pos) - count(DISTINCT user_id) AS excluded_users, count(*) FILTER (part = 'train') "
    "AS train_rows, "
    "count(*) FILTER (part = 'validation') AS validation_rows, count(*) FILTER (part = 'test') AS test_rows, count(DISTINCT "
    f"user_id) AS validation_queries, count(DISTINCT user_id) AS test_queries FROM (SELECT '{O.STRATEGIES[0]}' AS strategy, "
    f"user_id, part FROM split UNION ALL SELECT '{O.STRATEGIES[1]}', user_id, part FROM ({_GLOBAL})) GROUP BY strategy",
    "split", "pos",
)
def e12_split_dataset(spark, d):
    x, out = written(V.interactions(spark, d), "interactions"), None
    for strategy in O.STRATEGIES:
        try:
            made = O.split_dataset(x, scratch_path(spark, "dataset"), strategy)
        except schemas.ContractError:  # too few events for this strategy
            continue
        one = made["manifest"].withColumns({f"{t}_queries": F.lit(made[t].count()) for t in ("validation", "test")})
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


for _target in ("validation", "test"):

    @query(
        f"w3_query_records_{_target}",
        "query_id:s user_id:l seeds:s truth:s history_end_ts:l truth_start_ts:l",
        "SELECT query_id, user_id, array_to_string(list_transform(seeds, lambda x: CAST(x AS VARCHAR)), ',') AS seeds, array_to_string(list_transform(truth, "
        f"lambda x: CAST(x AS VARCHAR)), ',') AS truth, history_end_ts, truth_start_ts FROM {_target}_queries",
        f"{_target}_queries",
    )
    def w3_query_records(spark, d, target=_target):
        text = lambda c: F.array_join(F.col(c).cast("array<string>"), ",").alias(c)
        return P.query_records(V.split(spark, d), target).select("query_id", "user_id", text("seeds"), text("truth"), "history_end_ts", "truth_start_ts")


@query(
    "w4_eligibility",
    "eligible_users:l excluded_users:l",
    "SELECT count(DISTINCT user_id) AS eligible_users, (SELECT count(DISTINCT user_id) FROM pos) - count(DISTINCT user_id) "
    "AS excluded_users FROM split",
    "pos",
    "split",
)
def w4_eligibility(spark, d):
    pos = V.positives(spark, d)
    return P.eligibility(pos, P.split_per_user(pos))


_INNER = "SELECT user_id, item_id, part FROM inner_split"


@query("w5_split_inner", "user_id:l item_id:l part:s", _INNER, "inner_split")
def w5_split_inner(spark, d):
    return P.split_inner(V.train(spark, d))


_AGAIN = "SELECT user_id, item_id, rating, ts, ord FROM train_rows UNION ALL SELECT user_id, item_id, 1.0, ts - 5, ord FROM train_rows WHERE item_id % 3 = 0 UNION ALL SELECT user_id, item_id, 1.0, ts + 5, ord FROM train_rows WHERE item_id % 7 = 0"
_AGAIN = f"(SELECT * FROM (SELECT * FROM ({_AGAIN}) QUALIFY row_number() OVER (PARTITION BY user_id, item_id ORDER BY ts DESC, ord DESC, rating DESC) = 1) WHERE rating >= 3)"


def _train_again(spark, d):
    """The train part with earlier low ratings, which don't count, and later ones, which take the event away."""
    t = written(V.train(spark, d), "train").drop("part")
    low = lambda shift: t.withColumn("rating", F.lit(1.0)).withColumn("ts", F.col("ts") + shift)
    return t.unionByName(low(-5).where("item_id % 3 = 0")).unionByName(low(5).where("item_id % 7 = 0"))


@query("e13_prepare_ranking", "user_id:l item_id:l part:s", f"SELECT user_id, item_id, part FROM ({V.INNER.format(source=_AGAIN)})", "train_rows")
def e13_prepare_ranking(spark, d):
    out = O.prepare_ranking(_train_again(spark, d), scratch_path(spark, "ranking"))
    one = lambda name, part: out[name].select("user_id", "item_id", F.lit(part).alias("part"))
    return one("history", "history").unionByName(one("targets", "target"))


@query(
    "e13_ranking_manifest",
    "status:s eligible_users:l excluded_users:l history_rows:l history_items:l target_rows:l queries:l other_settings_rejected:b",
    f"SELECT 'complete' AS status, count(DISTINCT user_id) AS eligible_users, (SELECT count(DISTINCT user_id) FROM {_AGAIN}) "
    "- count(DISTINCT user_id) AS excluded_users, count(*) FILTER (part = 'history') AS history_rows, count(DISTINCT item_id) "
    "FILTER (part = 'history') AS history_items, "
    "count(*) FILTER (part = 'target') AS target_rows, count(DISTINCT user_id) AS queries, true AS other_settings_rejected "
    f"FROM ({V.INNER.format(source=_AGAIN)})",
    "train_rows",
)
def e13_ranking_manifest(spark, d):
    rows, path = written(_train_again(spark, d), "train-again"), scratch_path(spark, "ranking")
    O.prepare_ranking(rows, path)
    out = O.prepare_ranking(rows, path)  # again: what is there
    try:
        O.prepare_ranking(rows, path, fraction=0.7)
        rejected = False
    except schemas.ContractError:
        rejected = True
    return out["manifest"].withColumn("queries", F.lit(out["queries"].count())).withColumn("other_settings_rejected", F.lit(rejected))


@query(
    "w10_adjacent_pairs",
    "query_id:l candidate_id:l rows:l",
    "WITH p AS (SELECT item_id AS a, lead(item_id) OVER w AS b, row_number() OVER w AS rn FROM split WHERE part = 'train' "
    "WINDOW w AS (PARTITION BY user_id ORDER BY ts, item_id)), q AS (SELECT a, b FROM p WHERE rn <= 50 AND b IS NOT NULL "
    "AND a <> b) SELECT query_id, candidate_id, count(*) AS rows FROM (SELECT a AS query_id, b AS candidate_id FROM q UNION "
    "ALL SELECT b, a FROM q) GROUP BY 1, 2",
    "split",
)
def w10_adjacent_pairs(spark, d):
    return P.adjacent_pairs(V.train(spark, d)).groupBy("query_id", "candidate_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "u3_history_union",
    "user_id:l rows:l",
    "SELECT user_id, count(*) AS rows FROM split WHERE part IN ('train', 'validation') GROUP BY user_id",
    "split",
)
def u3_history_union(spark, d):
    return P.history_union(V.split(spark, d)).groupBy("user_id").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "j9_history_targets",
    "user_id:l history:l targets:l",
    f"SELECT user_id, count(*) FILTER (part = 'history') AS history, count(*) FILTER (part = 'target') AS targets FROM ({_INNER}) "
    "GROUP BY user_id",
    "inner_split",
)
def j9_history_targets(spark, d):
    from recengine.operators.candidates import align

    inner = written(P.split_inner(V.train(spark, d)), "inner")
    one = lambda part, name: inner.where(F.col("part") == part).groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    return align(one("history", "history"), one("target", "targets"))


@query(
    "e9_validate_dataset",
    "rule:s part:s violations:l",
    "SELECT 'not_complete' AS rule, 'manifest' AS part, 1 AS violations UNION ALL SELECT 'empty_seeds', 'validation', count(*) "
    "FILTER (user_id % 5 = 0) FROM validation_queries UNION ALL SELECT 'empty_truth', 'validation', count(*) FILTER (user_id "
    "% 7 = 0) FROM validation_queries "
    "UNION ALL SELECT 'not_after_history', 'validation', count(*) FILTER (user_id % 3 = 0) FROM validation_queries UNION "
    "ALL SELECT 'empty_table', 'split', 0 UNION ALL SELECT 'other_content', 'split', 0 UNION ALL SELECT 'empty_table', 'changed', "
    "0 UNION ALL SELECT 'other_content', 'changed', 1 UNION ALL SELECT 'empty_table', 'none', 1 UNION ALL SELECT 'other_content', "
    "'none', 1",
    "validation_queries",
)
def e9_validate_dataset(spark, d):
    """The checks of a dataset with planted faults: queries without seeds or truth or too early, changed and empty tables, a job cut off."""
    s = V.stored_split(spark, d)
    u = F.col("user_id")
    q = P.query_records(s).withColumn("seeds", F.when(u % 5 != 0, F.col("seeds"))).withColumn("truth", F.when(u % 7 == 0, F.slice("truth", 1, 0)).otherwise(F.col("truth")))
    q = q.withColumn("truth_start_ts", F.when(u % 3 == 0, F.col("history_end_ts")).otherwise(F.col("truth_start_ts")))
    tables = {"split": s, "changed": s.withColumn("ts", F.col("ts") + 1), "none": s.limit(0)}
    known = written(IO.manifest("split", s).select("name", "content"), "known")
    known = known.select(F.explode(F.array(*[F.lit(n) for n in tables])).alias("name"), "content")
    return validate_dataset({"validation": q}, tables, known, spark.createDataFrame([("partial",)], "status string"))


# --- tokens and scalar functions ---


@query(
    "f1_structured_token",
    "source:s token:s rows:l",
    "SELECT p_type AS source, 'type_' || trim(regexp_replace(lower(p_type), '[^\\p{L}\\p{N}]', '_', 'g'), '_') AS token, "
    "count(*) AS rows FROM part GROUP BY 1, 2",
)
def f1_structured_token(spark, d):
    return table(spark, d, "part").select(F.col("p_type").alias("source"), S.structured_token("type", F.col("p_type")).alias("token")).groupBy("source", "token").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "f2_year_tokens",
    "item_id:l token:s",
    "SELECT item_id, 'year_' || y || ' decade_' || (y // 10 * 10) AS token FROM (SELECT item_id, CAST(substr(release_date, "
    "1, 4) AS BIGINT) AS y FROM catalog)",
    "catalog",
)
def f2_year_tokens(spark, d):
    return V.catalog(spark, d).select("item_id", S.year_tokens(S.release_year(F.col("release_date"))).alias("token"))


@query("f3_runtime_token", "item_id:l token:s", "SELECT item_id, 'runtime_' || (vote_count // 15 * 15) AS token FROM catalog", "catalog")
def f3_runtime_token(spark, d):
    return V.catalog(spark, d).select("item_id", S.runtime_token(F.col("vote_count")).alias("token"))


@query(
    "f4_array_tokens",
    "item_id:l tokens:s",
    "SELECT item_id, array_to_string(list_transform(genres, lambda g: 'genres_' || trim(regexp_replace(lower(g), '[^\\p{L}\\p{N}]', "
    "'_', 'g'), '_')), ' ') AS tokens FROM catalog",
    "catalog",
)
def f4_array_tokens(spark, d):
    return V.catalog(spark, d).select("item_id", S.array_tokens("genres", F.col("genres")).alias("tokens"))


@query(
    "f5_nullable_text",
    "item_id:l text:s genres:s",
    "SELECT item_id, coalesce(poster_path, '') AS text, array_to_string(genres, ' ') AS genres FROM catalog",
    "catalog",
)
def f5_nullable_text(spark, d):
    return V.catalog(spark, d).select("item_id", S.plain_text(F.col("poster_path")).alias("text"), S.plain_text(F.col("genres"), True).alias("genres"))


@query(
    "f6_weighted_document",
    "item_id:l document:s",
    "SELECT item_id, title || ' ' || title || CASE WHEN poster_path IS NULL THEN '' ELSE ' ' || poster_path END AS document "
    "FROM catalog",
    "catalog",
)
def f6_weighted_document(spark, d):
    return V.catalog(spark, d).select("item_id", S.weighted_document([(S.plain_text(F.col("title")), 2), (S.plain_text(F.col("poster_path")), 1)]).alias("document"))


@query(
    "f7_f8_f9_rank_features",
    "item_id:l reciprocal:d log_count:d finite:d",
    "SELECT p_partkey AS item_id, CASE WHEN p_size % 4 > 0 THEN CAST(CAST(1 AS DOUBLE) / (p_size % 4) AS FLOAT) ELSE 0 END "
    "AS reciprocal, CAST(ln(1 + p_size) AS FLOAT) AS log_count, CASE WHEN p_partkey % 5 = 0 OR p_partkey % 7 = 0 THEN 0 ELSE "
    "p_size END AS finite FROM part",
)
def f7_f8_f9_rank_features(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    odd = F.when(k % 5 == 0, F.lit(float("nan"))).when(k % 7 == 0, F.lit(float("-inf"))).otherwise(size.cast("double")).cast("float")
    return table(spark, d, "part").select(k.alias("item_id"), S.reciprocal(size % 4).alias("reciprocal"), S.log_count(size).alias("log_count"), S.finite_or_zero(odd).alias("finite"))


@query(
    "f10_release_year",
    "year:l items:l",
    "SELECT TRY_CAST(substr(x, 1, 4) AS BIGINT) AS year, count(*) AS items FROM (SELECT CASE WHEN item_id % 9 = 0 THEN 'n/a "
    "1' WHEN item_id % 10 = 0 THEN '19' ELSE release_date END AS x FROM catalog) WHERE length(x) >= 4 GROUP BY 1 UNION ALL "
    "SELECT NULL, count(*) FROM catalog WHERE item_id % 9 <> 0 AND item_id % 10 = 0 HAVING false",
    "catalog",
)
def f10_release_year(spark, d):
    k = F.col("item_id")
    odd = F.when(k % 9 == 0, "n/a 1").when(k % 10 == 0, "19").otherwise(F.col("release_date"))
    return V.catalog(spark, d).where(F.length(odd) >= 4).select(S.release_year(odd).alias("year")).groupBy("year").agg(F.count(F.lit(1)).alias("items"))


@query(
    "f11_image_url",
    "item_id:l url:s",
    "SELECT item_id, CASE WHEN poster_path IS NOT NULL THEN 'https://image.tmdb.org/t/p/w500' || poster_path END AS url FROM "
    "catalog",
    "catalog",
)
def f11_image_url(spark, d):
    return V.catalog(spark, d).select("item_id", S.image_url(F.col("poster_path"), S.POSTER_SIZE).alias("url"))


_GENRES = "MAP {" + ", ".join(f"{k}: '{v}'" for k, v in S.GENRES.items()) + "}"


@query(
    "f12_genre_names",
    "item_id:l names:s",
    f"SELECT p_partkey AS item_id, array_to_string(list_filter([{_GENRES}[p_size + 10], {_GENRES}[p_partkey % 100], {_GENRES}[878]], "
    "lambda x: x IS NOT NULL), ',') AS names FROM part",
)
def f12_genre_names(spark, d):
    ids = F.array((F.col("p_size") + 10).cast("long"), F.col("p_partkey") % 100, F.lit(878).cast("long"))
    return table(spark, d, "part").select(F.col("p_partkey").alias("item_id"), F.array_join(S.genre_names(ids), ",").alias("names"))


@query(
    "f13_not_available_cleanup",
    "item_id:l rating:d votes:l",
    "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 6 <> 0 THEN CAST(p_size AS DOUBLE) / 4 END AS rating, CASE WHEN p_partkey "
    "% 5 <> 0 THEN 1000 + p_size END AS votes FROM part",
)
def f13_not_available_cleanup(spark, d):
    k, size = F.col("p_partkey"), F.col("p_size")
    rating, votes = F.when(k % 6 == 0, "N/A").otherwise((size / 4).cast("string")), F.when(k % 5 == 0, "N/A").otherwise(F.concat(F.lit("1,"), F.lpad(size.cast("string"), 3, "0")))
    return table(spark, d, "part").select(k.alias("item_id"), S.rating_or_null(rating).alias("rating"), S.votes_or_null(votes).alias("votes"))


# --- payloads: JSON made from the part table ---


def _payloads(spark, d):
    k = F.col("p_partkey")
    tmdb = F.to_json(
        F.struct(
            F.when(k % 31 != 0, k).alias("id"), F.when(k % 6 != 0, F.concat(F.lit("tt"), k.cast("string"))).alias("imdb_id"), F.when(k % 8 != 0, F.col("p_name")).alias("title"), F.col("p_brand").alias("original_title"),
            F.array(F.struct(F.lit(1).alias("id"), F.col("p_type").alias("name")), F.struct(F.lit(2).alias("id"), F.col("p_brand").alias("name"))).alias("genres"),
            F.struct(F.array(F.struct(F.col("p_name").alias("name"))).alias("keywords")).alias("keywords"),
            F.struct(F.transform(F.sequence(F.lit(1), F.lit(7)), lambda i: F.struct(F.concat(F.lit("Cast "), i.cast("string")).alias("name"))).alias("cast"), F.array(F.struct(F.lit("Writer").alias("job"), F.lit("W").alias("name")), F.struct(F.lit("Director").alias("job"), F.concat(F.lit("Dir "), (k % 50).cast("string")).alias("name"))).alias("crew")).alias("credits"),
            F.concat((k % 70 + 1950).cast("string"), F.lit("-02-03")).alias("release_date"), F.col("p_size").alias("runtime"), F.concat(F.lit("/p"), k.cast("string")).alias("poster_path"), F.lit("en").alias("original_language"),
            F.array(F.struct(F.lit("Chile").alias("name")), F.struct(F.lit("Peru").alias("name"))).alias("production_countries"), F.when(k % 4 == 0, F.struct((k % 9).alias("id"), F.lit("Set").alias("name"))).alias("belongs_to_collection"),
            F.struct(F.array(F.struct(F.lit("YouTube").alias("site"), F.lit("Trailer").alias("type"), F.lit("a").alias("key"), F.lit(False).alias("official")), F.struct(F.lit("YouTube").alias("site"), F.lit("Trailer").alias("type"), F.lit("b").alias("key"), (k % 2 == 0).alias("official"))).alias("results")).alias("videos"),
        )
    )
    omdb = F.when(k % 10 != 0, F.to_json(F.struct(F.when(k % 3 == 0, "N/A").otherwise("7.5").alias("imdbRating"), F.lit("1,234").alias("imdbVotes"))))
    return table(spark, d, "part").select(k.alias("movie_id"), tmdb.alias("tmdb_json"), omdb.alias("omdb_json"))


@query(
    "e4_normalize_payloads",
    "movie_id:l tmdb_id:l imdb_id:s title:s genres:s top_cast:s director:s runtime_minutes:l release_year:l imdb_rating:d "
    "imdb_votes:l country:s collection_id:l collection_name:s",
    "SELECT p_partkey AS movie_id, CASE WHEN p_partkey % 31 <> 0 THEN p_partkey END AS tmdb_id, CASE WHEN p_partkey % 6 <> "
    "0 THEN 'tt' || p_partkey END AS imdb_id, CASE WHEN p_partkey % 8 <> 0 THEN p_name ELSE p_brand END AS title, lower(p_type) "
    "|| '|' || lower(p_brand) AS genres, "
    "'cast 1|cast 2|cast 3|cast 4|cast 5' AS top_cast, 'dir ' || (p_partkey % 50) AS director, p_size AS runtime_minutes, "
    "p_partkey % 70 + 1950 AS release_year, CASE WHEN p_partkey % 10 <> 0 AND p_partkey % 3 <> 0 THEN 7.5 END AS imdb_rating, "
    "CASE WHEN p_partkey % 10 <> 0 THEN 1234 END AS imdb_votes, "
    "'Chile' AS country, CASE WHEN p_partkey % 4 = 0 THEN p_partkey % 9 END AS collection_id, CASE WHEN p_partkey % 4 = 0 "
    "THEN 'Set' END AS collection_name FROM part",
)
def e4_normalize_payloads(spark, d):
    return Y.normalize_payloads(_payloads(spark, d)).withColumns({"genres": F.array_join("genres", "|"), "top_cast": F.array_join("top_cast", "|")})


@query(
    "e5_partition_failures",
    "status:s rows:l",
    "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'no_imdb_id' WHEN p_partkey % 10 = 0 THEN 'no_omdb' ELSE 'ok' END AS status, "
    "count(*) AS rows FROM part GROUP BY 1",
)
def e5_partition_failures(spark, d):
    good, bad = Y.partition_failures(_payloads(spark, d))
    return good.select(F.lit("ok").alias("status")).unionByName(bad.select("status")).groupBy("status").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "e6_retry_failed",
    "outcome:s rows:l",
    "SELECT CASE WHEN p_partkey % 6 = 0 THEN 'still_failed' ELSE 'recovered' END AS outcome, count(*) AS rows FROM part WHERE "
    "p_partkey % 6 = 0 OR p_partkey % 10 = 0 GROUP BY 1",
)
def e6_retry_failed(spark, d):
    rows = _payloads(spark, d)
    _, failed = Y.partition_failures(rows)
    again, still = Y.retry_failed(failed, rows.withColumn("omdb_json", F.coalesce("omdb_json", F.lit("{}"))))
    return again.select(F.lit("recovered").alias("outcome")).unionByName(still.select(F.lit("still_failed").alias("outcome"))).groupBy("outcome").agg(F.count(F.lit(1)).alias("rows"))


@query(
    "e7_normalize_summary",
    "item_id:l title:s year:l genres:s poster_url:s",
    "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 8 <> 0 THEN p_name ELSE p_brand END AS title, p_partkey % 70 + 1950 "
    "AS year, p_type || '|' || p_brand AS genres, 'https://image.tmdb.org/t/p/w500/p' || p_partkey AS poster_url FROM part "
    "WHERE p_partkey % 31 <> 0",
)
def e7_normalize_summary(spark, d):
    return Y.normalize_summary(_payloads(spark, d)).withColumn("genres", F.array_join("genres", "|"))


@query(
    "e8_normalize_detail",
    "item_id:l keywords:s cast:s director:s trailer_url:s country:s collection_name:s",
    "SELECT p_partkey AS item_id, p_name AS keywords, 'Cast 1|Cast 2|Cast 3|Cast 4|Cast 5' AS \"cast\", 'Dir ' || (p_partkey "
    "% 50) AS director, 'https://www.youtube.com/watch?v=' || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS trailer_url, "
    "'Chile' AS country, CASE WHEN p_partkey % 4 = 0 THEN 'Set' END AS collection_name FROM part WHERE p_partkey % 31 <> "
    "0",
)
@query(
    "f14_f15_f16_f17_nested_fields",
    "item_id:l title:s director:s trailer_url:s country:s",
    "SELECT p_partkey AS item_id, CASE WHEN p_partkey % 8 <> 0 THEN p_name ELSE p_brand END AS title, 'Dir ' || (p_partkey "
    "% 50) AS director, 'https://www.youtube.com/watch?v=' || CASE WHEN p_partkey % 2 = 0 THEN 'b' ELSE 'a' END AS trailer_url, "
    "'Chile' AS country FROM part WHERE p_partkey % 31 <> 0",
)
def e8_normalize_detail(spark, d):
    return Y.normalize_detail(_payloads(spark, d)).withColumns({"keywords": F.array_join("keywords", "|"), "cast": F.array_join("cast", "|")})


# --- catalog queries ---


@query(
    "c1_discover",
    "item_id:l vote_average:d",
    "SELECT item_id, vote_average FROM catalog WHERE vote_count >= 100 AND list_contains(genres, 'PROMO') AND release_date "
    "BETWEEN '1960-01-01' AND '2010-12-31' AND vote_average >= 2 ORDER BY vote_average DESC, item_id LIMIT 10 OFFSET 10",
    "catalog",
)
def c1_discover(spark, d):
    return C.discover(V.catalog(spark, d), "PROMO", 1960, 2010, 2.0, "rating", 2, 10)


@query(
    "c2_popular",
    "item_id:l popularity_score:d",
    "SELECT item_id, popularity_score FROM catalog ORDER BY popularity_score DESC, item_id LIMIT 25 OFFSET 25",
    "catalog",
)
def c2_popular(spark, d):
    return C.popular(V.catalog(spark, d), 25, 2)


@query(
    "c3_new_releases",
    "item_id:l release_date:s",
    "SELECT item_id, release_date FROM catalog WHERE release_date <= '2001-06-30' ORDER BY release_date DESC, item_id LIMIT "
    "30",
    "catalog",
)
def c3_new_releases(spark, d):
    return C.new_releases(V.catalog(spark, d), "2001-06-30", 30)


_TREND = "SELECT item_id, count(*) AS events FROM stream WHERE epoch > (SELECT max(epoch) FROM stream) - 7 * 86400 GROUP BY item_id"


def _trend(spark, d):
    e = V.events(spark, d)
    return C.trending(e, e.agg(F.max("epoch")).first()[0], ts_col="epoch")


@query("c4_trending", "item_id:l events:l", _TREND, "stream")
def c4_trending(spark, d):
    return _trend(spark, d)


@query("c5_featured", "item_id:l events:l", f"{_TREND} ORDER BY events DESC, item_id LIMIT 1", "stream")
def c5_featured(spark, d):
    return C.featured(_trend(spark, d))


@query("c6_genres", "genre:s", "SELECT DISTINCT unnest(genres) AS genre FROM catalog", "catalog")
def c6_genres(spark, d):
    return C.genre_list(V.catalog(spark, d))


@query(
    "c7_similar",
    "candidate_id:l score:f rank:l",
    "SELECT candidate_id, score, rank FROM content WHERE seed_id = 7 AND rank BETWEEN 6 AND 10",
    "content",
)
def c7_similar(spark, d):
    return C.similar(V.content_neighbors(spark, d), 7, 5, 2)


@query(
    "c8_search",
    "item_id:l title:s",
    "SELECT item_id, title FROM catalog WHERE poster_path IS NOT NULL AND NOT adult AND contains(lower(title), 'ro') ORDER "
    "BY starts_with(lower(title), 'ro') DESC, popularity_score DESC, item_id LIMIT 40",
    "catalog",
)
def c8_search(spark, d):
    return C.search(V.catalog(spark, d), " RO ", 40)


@query(
    "c8_search_index",
    "search:s item_id:l title:s",
    " UNION ALL ".join(
        f"SELECT * FROM (SELECT '{t}' AS search, item_id, title FROM catalog WHERE poster_path IS NOT NULL AND NOT adult AND "
        f"contains(lower(title), '{t}') "
        f"ORDER BY starts_with(lower(title), '{t}') DESC, popularity_score DESC, item_id LIMIT 25)"
        for t in ("g", "ro", "widget", "ed wid")
    ),
    "catalog",
)
def c8_search_index(spark, d):
    """Searches of one, two and more letters through the written index of titles."""
    path = scratch_path(spark, "title-index")
    catalog = V.catalog(spark, d)
    C.write_title_index(catalog, path)
    index = spark.read.parquet(path)
    pages = [C.search_index(index, catalog, t, 25).select(F.lit(t).alias("search"), "item_id", "title") for t in ("g", "ro", "widget", "ed wid")]
    return reduce(DataFrame.unionByName, pages)


@query("c9_lookup", "item_id:l title:s", "SELECT item_id, title FROM catalog WHERE item_id IN (SELECT item_id FROM stream)", "catalog", "stream")
def c9_lookup(spark, d):
    return C.lookup(V.catalog(spark, d), V.events(spark, d))


@query("c10_page_shift", "item_id:l page:l", "SELECT item_id, greatest(1, 47 % 20 + item_id % 5 - 9) AS page FROM catalog", "catalog")
def c10_page_shift(spark, d):
    return V.catalog(spark, d).select("item_id", S.shifted_page(F.col("item_id") % 5 - 9, 47).alias("page"))
