"""Provider payloads (JSON text) to catalog rows, summaries and details."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.functions import scalars as S

# The parts of the payloads that are read.
_NAMED = "array<struct<id: long, name: string>>"
TMDB = (
    f"struct<id: long, imdb_id: string, title: string, original_title: string, overview: string, genres: {_NAMED}, genre_ids: array<long>, keywords: struct<keywords: {_NAMED}>, "
    "credits: struct<`cast`: array<struct<name: string>>, crew: array<struct<job: string, name: string>>>, release_date: string, runtime: long, popularity: double, vote_count: long, vote_average: double, "
    "poster_path: string, backdrop_path: string, original_language: string, production_countries: array<struct<name: string>>, belongs_to_collection: struct<id: long, name: string>, tagline: string, "
    "videos: struct<results: array<struct<site: string, type: string, key: string, official: boolean>>>>"
)
OMDB = "struct<imdbRating: string, imdbVotes: string>"


def _parsed(payloads: DataFrame) -> DataFrame:
    out = payloads.withColumn("t", F.from_json("tmdb_json", TMDB))
    return out.withColumn("o", F.from_json("omdb_json", OMDB)) if "omdb_json" in payloads.columns else out


def normalize_payloads(payloads: DataFrame) -> DataFrame:
    """The 23 catalog columns of (movie_id, tmdb_json, omdb_json); names in lower case."""
    t = lambda path: F.col(f"t.{path}")
    return _parsed(payloads).select(
        "movie_id",
        t("id").alias("tmdb_id"),
        t("imdb_id").alias("imdb_id"),
        F.coalesce(F.nullif(t("title"), F.lit("")), t("original_title")).alias("title"),
        t("overview").alias("overview"),
        S.lower_names(t("genres")).alias("genres"),
        S.lower_names(t("keywords.keywords")).alias("keywords"),
        S.lower_names(F.slice(t("credits.cast"), 1, 5)).alias("top_cast"),
        F.lower(S.first_director(t("credits.crew"))).alias("director"),
        t("runtime").alias("runtime_minutes"),
        S.release_year(t("release_date")).cast("long").alias("release_year"),
        t("release_date").alias("release_date"),
        t("popularity").alias("popularity_score"),
        t("vote_count").alias("vote_count"),
        t("vote_average").alias("vote_average"),
        S.rating_or_null(F.col("o.imdbRating")).alias("imdb_rating"),
        S.votes_or_null(F.col("o.imdbVotes")).alias("imdb_votes"),
        t("poster_path").alias("poster_path"),
        t("backdrop_path").alias("backdrop_path"),
        t("original_language").alias("language"),
        F.get(t("production_countries"), F.lit(0))["name"].alias("country"),
        t("belongs_to_collection.id").alias("collection_id"),
        t("belongs_to_collection.name").alias("collection_name"),
    )


def with_status(payloads: DataFrame) -> DataFrame:
    """``payloads`` with status: ok if both payloads are there and the first has an imdb_id, else what is missing."""
    imdb = F.get_json_object("tmdb_json", "$.imdb_id")
    status = F.when(F.col("tmdb_json").isNull(), "no_tmdb").when(F.coalesce(imdb, F.lit("")) == "", "no_imdb_id").when(F.col("omdb_json").isNull(), "no_omdb").otherwise("ok")
    return payloads.withColumn("status", status)


def partition_failures(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(succeeded, failed with status)."""
    rows = with_status(payloads)
    return rows.where("status = 'ok'").drop("status"), rows.where("status <> 'ok'")


def retry_failed(failed: DataFrame, fetched: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(rows that now succeed, ids that still fail): only ids of ``failed`` are taken from ``fetched``."""
    again, _ = partition_failures(fetched.join(failed.select("movie_id").distinct(), "movie_id", "left_semi"))
    return again, failed.join(again.select("movie_id"), "movie_id", "left_anti")


def _summary_columns() -> list:
    t = lambda path: F.col(f"t.{path}")
    genres = F.when(t("genres").isNotNull(), S.names(t("genres"))).otherwise(F.coalesce(S.genre_names(t("genre_ids")), F.array().cast("array<string>")))
    return [
        t("id").alias("item_id"),
        S.title_or(t("title"), t("original_title")).alias("title"),
        S.release_year(t("release_date")).alias("year"),
        genres.alias("genres"),
        S.image_url(t("poster_path"), S.POSTER_SIZE).alias("poster_url"),
        S.image_url(t("backdrop_path"), S.BACKDROP_SIZE).alias("backdrop_url"),
        t("vote_average").alias("rating"),
        t("overview").alias("overview"),
    ]


def normalize_summary(items: DataFrame) -> DataFrame:
    """Display rows of list items (tmdb_json); items without a positive id are dropped."""
    return _parsed(items).where(F.col("t.id") > 0).select(*_summary_columns())


def normalize_detail(payloads: DataFrame) -> DataFrame:
    """Display rows of full payloads (tmdb_json): the summary with cast, keywords, director, trailer and the rest."""
    t = lambda path: F.col(f"t.{path}")
    countries = F.filter(t("production_countries"), lambda c: c["name"].isNotNull())
    directors = F.filter(t("credits.crew"), lambda m: (m["job"] == "Director") & m["name"].isNotNull())
    return _parsed(payloads).where(F.col("t.id") > 0).select(
        *_summary_columns(),
        S.names(t("keywords.keywords")).alias("keywords"),
        S.names(F.slice(t("credits.cast"), 1, 5)).alias("cast"),
        F.get(directors, F.lit(0))["name"].alias("director"),
        t("tagline").alias("tagline"),
        t("release_date").alias("release_date"),
        t("runtime").alias("runtime_minutes"),
        t("vote_count").alias("vote_count"),
        t("popularity").alias("popularity"),
        t("original_language").alias("language"),
        F.get(countries, F.lit(0))["name"].alias("country"),
        t("belongs_to_collection.name").alias("collection_name"),
        S.trailer_url(t("videos.results")).alias("trailer_url"),
    )
