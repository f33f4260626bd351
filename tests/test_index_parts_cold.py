"""The title index, fingerprints by file, and line-ups of seeds without a vector."""

import pytest
from pyspark.sql import functions as F

from recengine.operators import catalog as C
from recengine.operators import content as X
from recengine.operators import lineup as L
from recengine.sources import tables as IO

TITLES = ["The Rose", "Rose Rose", "arose", "Ro", "R", "", None, "the ROad", "Éro", "o r", "roe ose"]


@pytest.fixture(scope="module")
def catalog(spark):
    rows = [(k + 1, t, "/p.jpg" if k != 3 else None, k == 10, float(k % 4)) for k, t in enumerate(TITLES)]
    return spark.createDataFrame(rows, "item_id long, title string, poster_path string, adult boolean, popularity_score double")


def test_index_searches_equal_scans(spark, catalog, tmp_path):
    C.write_title_index(catalog, f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    for text in ("ro", "Rose", " the ro", "e r", "é", "rose rose", "zzz", "ose", "roser"):
        wanted = text.strip().lower()
        rows = [(k + 1, t, float(k % 4)) for k, t in enumerate(TITLES) if t and wanted in t.lower() and k not in (3, 10)]
        rows.sort(key=lambda r: (not r[1].lower().startswith(wanted), -r[2], r[0]))
        for page in (1, 2):
            got = [r["item_id"] for r in C.search_index(index, catalog, text, 2, page).collect()]
            assert got == [r[0] for r in rows[2 * page - 2 : 2 * page]], text
            if len(wanted) > 1:
                assert got == [r["item_id"] for r in C.search(catalog, text, 2, page).collect()]
    with pytest.raises(ValueError):
        C.search_index(index, catalog, "  ")


def test_a_search_reads_the_postings_of_its_grams_only(spark, tmp_path):
    rows = spark.range(3000).select(F.col("id").alias("item_id"), F.concat(F.lit("title "), F.md5(F.col("id").cast("string"))).alias("title"), F.lit("/p").alias("poster_path"), F.lit(False).alias("adult"), F.lit(1.0).alias("popularity_score"))
    C.write_title_index(rows, f"file://{tmp_path}/index")
    index = spark.read.parquet(f"file://{tmp_path}/index")
    plan = C.search_index(index, rows, "abcd")._jdf.queryExecution().toString()
    assert "In(gram, [abc,bcd])" in plan


def test_changed_parts_name_what_changed_and_read_no_other_file(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    rows = spark.range(100).select((F.col("id") % 5).alias("p"), F.col("id"), (F.col("id") * 2).alias("x"))
    rows.repartition(2).write.partitionBy("p").parquet(path)
    known = spark.createDataFrame(IO.file_fingerprints(spark, path).collect())
    assert known.count() == 10
    whole, direct = IO.table_content(known).first(), IO.fingerprint(rows.drop("p")).first()
    assert tuple(whole) == (100, direct["content"])
    assert {tuple(r) for r in IO.changed_parts(spark, path, known).collect()} == {(f"p={k}", "same", 20, 0) for k in range(5)}
    part = lambda k: rows.where(F.col("p") == k).drop("p")
    part(0).repartition(1).write.mode("overwrite").parquet(f"{path}/p=0")  # the same rows in other files
    part(1).withColumn("x", F.when(F.col("id") == 6, -1).otherwise(F.col("x"))).repartition(1).write.mode("overwrite").parquet(f"{path}/p=1")
    IO.remove(spark, f"{path}/p=2")
    part(3).limit(0).write.parquet(f"{path}/p=7")
    got = {r["part"]: (r["status"], r["rows"]) for r in IO.changed_parts(spark, path, known).collect()}
    assert got == {"p=0": ("touched", 20), "p=1": ("changed", 20), "p=2": ("removed", 20), "p=3": ("same", 20), "p=4": ("same", 20), "p=7": ("added", 0)}
    assert {r["part"]: r["read"] for r in IO.changed_parts(spark, path, known).collect() if r["status"] == "same"} == {"p=3": 0, "p=4": 0}


def test_requests_of_unseen_seeds_have_content_candidates(spark):
    rows = [(k, f"space ship star {'moon' if k % 2 else 'sun'}" if k % 3 else f"castle knight king {'queen' if k % 2 else 'page'}", ["en"]) for k in range(1, 31)]
    catalog = spark.createDataFrame(rows, "item_id long, title string, genres array<string>").withColumn("poster_path", F.lit("/p"))
    model = X.fit_content(catalog, {"title": 2, "genres": 1}, dim=6, min_df=1)
    vectors = model.vectors(catalog)
    metadata = spark.createDataFrame([(1001, "a star ship in space", None), (1002, "the king of the castle", ["en"]), (1003, "zzz", None), (1004, None, None), (5, "known", None)], "item_id long, title string, genres array<string>")
    requests = spark.createDataFrame([("a", [1001]), ("b", [1002, -1]), ("c", [1003, 1004, 9999]), ("d", [5])], "request_id string, seeds array<long>")
    unseen = L.unseen_seed_neighbors(requests, metadata, model, vectors, 8)
    assert {r["seed_id"] for r in unseen.select("seed_id").distinct().collect()} == {1001, 1002}  # no text, no row, no known term: nothing

    class ByRank:
        def score(self, rows):
            return rows.withColumn("score", F.col("content_rr").cast("double"))

    known = unseen.where("seed_id < 0")
    popularity = catalog.select("item_id", F.lit(1).cast("long").alias("popularity"))
    shown = L.lineup(requests, known, popularity, ByRank(), catalog, 5, unseen=unseen).collect()
    assert {r["request_id"] for r in shown} == {"a", "b"} and len(shown) == 10
    assert all((r["candidate_id"] % 3 > 0) == (r["request_id"] == "a") for r in shown)
    assert L.lineup(requests, known, popularity, ByRank(), catalog, 5).count() == 0
