"""One-to-one catalogs, prepared interactions, exclusion counts and catalog queries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.operators.features import dense_index
from recengine.schemas import ContractError, to_integer
from recengine.sources.scratch import written


def unique_only(df: DataFrame, *keys: str) -> DataFrame:
    """Rows whose key occurs once: all rows of a repeated key go. Null keys don't count as equal."""
    repeated = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(*keys)
    return df.join(repeated, list(keys), "left_anti")


def unambiguous_links(links: DataFrame, source_col: str = "source_item_id", item_col: str = "item_id") -> DataFrame:
    """Mapped links in which both ids occur once."""
    mapped = links.where(F.col(source_col).isNotNull() & F.col(item_col).isNotNull())
    # both counts are of all mapped rows, so a row may fall by either
    bad_source = mapped.groupBy(source_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(source_col)
    bad_item = mapped.groupBy(item_col).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(item_col)
    return mapped.join(bad_source, source_col, "left_anti").join(bad_item, item_col, "left_anti")


def exclusion_summary(links: DataFrame, metadata: DataFrame, source_col: str = "source_item_id", item_col: str = "item_id") -> DataFrame:
    """One row: links, unmapped, ambiguous_source, ambiguous_item, ambiguous, mismatch, retained.

    A link that repeats on both ids counts in both of the single columns and once in
    ``ambiguous``; a mismatch is an unambiguous link without its pair in ``metadata``.
    """
    mapped = links.where(F.col(source_col).isNotNull() & F.col(item_col).isNotNull())
    by_source = mapped.groupBy(source_col).agg(F.count(F.lit(1)).alias("ns"))
    by_item = mapped.groupBy(item_col).agg(F.count(F.lit(1)).alias("ni"))
    flagged = mapped.join(by_source, source_col).join(by_item, item_col)
    pairs = unique_only(metadata.select(source_col, item_col), source_col, item_col).withColumn("known", F.lit(1))
    flagged = flagged.join(pairs, [source_col, item_col], "left")
    good = (F.col("ns") == 1) & (F.col("ni") == 1)
    counts = flagged.agg(
        F.count_if(F.col("ns") > 1).alias("ambiguous_source"),
        F.count_if(F.col("ni") > 1).alias("ambiguous_item"),
        F.count_if(~good).alias("ambiguous"),
        F.count_if(good & F.col("known").isNull()).alias("mismatch"),
        F.count_if(good & F.col("known").isNotNull()).alias("retained"),
    )
    unmapped = links.agg(F.count(F.lit(1)).alias("links"), F.count_if(F.col(source_col).isNull() | F.col(item_col).isNull()).alias("unmapped"))
    return unmapped.join(F.broadcast(counts))  # one row each


def prepare_catalog(links: DataFrame, metadata: DataFrame, source_col: str = "source_item_id", item_col: str = "item_id") -> DataFrame:
    """``metadata`` rows of unambiguous links, one for each id, with item_index by item id; an empty result is an error."""
    pairs = unambiguous_links(links, source_col, item_col).select(source_col, item_col)
    own = unique_only(metadata, source_col, item_col)
    out = own.join(pairs, [source_col, item_col])
    out = out.join(dense_index(out, item_col), item_col)
    twice = out.groupBy().agg((F.count(F.lit(1)) - F.count_distinct(item_col)).alias("a"), (F.count(F.lit(1)) - F.count_distinct(source_col)).alias("b"), F.count(F.lit(1)).alias("n")).first()
    if not twice["n"]:
        raise ContractError("no link is left")
    if twice["a"] or twice["b"]:
        raise ContractError("the catalog isn't one-to-one")
    return out


def prepare_interactions(ratings: DataFrame, catalog: DataFrame, source_col: str = "source_item_id", item_col: str = "item_id") -> DataFrame:
    """Ratings of catalog items with their item id; others are dropped. Spark broadcasts the id map if it is small."""
    return ratings.join(catalog.select(source_col, item_col), source_col)


def prepare_tags(tags: DataFrame, catalog: DataFrame, source_col: str = "source_item_id", item_col: str = "item_id") -> DataFrame:
    """Tags of catalog items with their item id."""
    return prepare_interactions(tags, catalog, source_col, item_col)


def build_processed(raw: dict[str, DataFrame], metadata: DataFrame) -> dict[str, DataFrame]:
    """catalog, interactions, tags and the exclusion summary from links, ratings and tags with the raw files' columns."""
    links = raw["links"].select(to_integer(F.col("movieId")).alias("source_item_id"), to_integer(F.col("tmdbId"), nullable=True).alias("item_id"))
    meta = metadata.withColumnsRenamed({"movie_id": "source_item_id", "tmdb_id": "item_id"})
    catalog = written(prepare_catalog(links, meta), "catalog")  # four outputs use it
    rename = {"userId": "user_id", "movieId": "source_item_id", "timestamp": "ts"}
    canonical = lambda df, value: prepare_interactions(df.withColumnsRenamed(rename).withColumns({c: F.col(c).cast("long") for c in ("user_id", "source_item_id", "ts")}), catalog).select("user_id", "item_id", "source_item_id", value, "ts")
    return {
        "catalog": catalog,
        "interactions": canonical(raw["ratings"].withColumn("rating", F.col("rating").cast("double")), "rating"),
        "tags": canonical(raw["tags"], "tag"),
        "exclusions": exclusion_summary(links, meta),
    }


def unique_id_report(df: DataFrame, id_col: str = "item_id") -> DataFrame:
    """One row: rows, missing, repeated."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(F.col(id_col).isNull()).alias("missing"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated"))


def _page(df: DataFrame, limit: int, page: int) -> DataFrame:
    return df.offset(limit * (page - 1)).limit(limit)


def displayable(catalog: DataFrame) -> DataFrame:
    """Rows with a poster that aren't marked adult."""
    return catalog.where((F.coalesce("poster_path", F.lit("")) != "") & ~F.coalesce("adult", F.lit(False)))


def discover(catalog: DataFrame, genre: str | None = None, year_from: int | None = None, year_to: int | None = None, rating_min: float | None = None, sort: str = "popularity", page: int = 1, limit: int = 20, min_votes: int = 100) -> DataFrame:
    """A page of the catalog by popularity, rating or newest, all descending and then by id."""
    rows = catalog.where(F.col("vote_count") >= min_votes)
    if genre is not None:
        rows = rows.where(F.array_contains("genres", genre))
    if year_from is not None:
        rows = rows.where(F.col("release_date") >= f"{year_from}-01-01")
    if year_to is not None:
        rows = rows.where(F.col("release_date") <= f"{year_to}-12-31")
    if rating_min is not None:
        rows = rows.where(F.col("vote_average") >= rating_min)
    by = {"popularity": "popularity_score", "rating": "vote_average", "newest": "release_date"}[sort]
    return _page(rows.orderBy(F.desc_nulls_last(by), "item_id"), limit, page)


def popular(catalog: DataFrame, limit: int = 20, page: int = 1) -> DataFrame:
    return _page(catalog.orderBy(F.desc_nulls_last("popularity_score"), "item_id"), limit, page)


def new_releases(catalog: DataFrame, as_of: str, limit: int = 20, page: int = 1) -> DataFrame:
    return _page(catalog.where(F.col("release_date") <= as_of).orderBy(F.desc("release_date"), "item_id"), limit, page)


def trending(events: DataFrame, as_of: int, days: int = 7, item_col: str = "item_id", ts_col: str = "ts") -> DataFrame:
    """item_id, events: how often each item was met in the last days up to ``as_of`` (epoch seconds)."""
    recent = events.where((F.col(ts_col) > as_of - days * 86_400) & (F.col(ts_col) <= as_of))
    return recent.groupBy(F.col(item_col).alias("item_id")).agg(F.count(F.lit(1)).alias("events"))


def featured(trend: DataFrame) -> DataFrame:
    """The first trending row."""
    return trend.orderBy(F.desc("events"), "item_id").limit(1)


def genre_list(catalog: DataFrame) -> DataFrame:
    """The distinct genres."""
    return catalog.select(F.explode("genres").alias("genre")).distinct()


def similar(neighbors: DataFrame, item: int, limit: int = 20, page: int = 1) -> DataFrame:
    """A page of an item's neighbors."""
    return neighbors.where((F.col("seed_id") == item) & (F.col("rank") > limit * (page - 1)) & (F.col("rank") <= limit * page))


def search(catalog: DataFrame, text: str, limit: int = 20, page: int = 1) -> DataFrame:
    """A page of displayable titles that contain ``text`` (two characters at least): those that begin with it first, then by popularity and id."""
    if len(text.strip()) < 2:
        raise ValueError("a search needs two characters")
    wanted, title = text.strip().lower(), F.lower("title")
    rows = displayable(catalog).where(title.contains(wanted))
    return _page(rows.orderBy(F.desc(title.startswith(wanted)), F.desc_nulls_last("popularity_score"), "item_id"), limit, page)


def title_index(catalog: DataFrame) -> DataFrame:
    """gram, item_id: the distinct runs of one to three characters of the lower-cased titles of displayable rows.

    Write it with ``write_title_index``; then a search reads the postings of its own grams only.
    """
    title = F.lower("title")
    places = F.sequence(F.lit(1), F.length(title))
    grams = F.array_distinct(F.flatten(F.transform(places, lambda i: F.array(*[F.substring(title, i, F.lit(n)) for n in (1, 2, 3)]))))
    return displayable(catalog).where(F.length("title") > 0).select(F.explode(grams).alias("gram"), "item_id")


def write_title_index(catalog: DataFrame, path: str) -> None:
    """The index in ranges of grams, sorted within files, so that statistics of row groups leave all other grams unread."""
    title_index(catalog).repartitionByRange("gram", "item_id").sortWithinPartitions("gram", "item_id").write.mode("overwrite").parquet(path)


def search_index(index: DataFrame, catalog: DataFrame, text: str, limit: int = 20, page: int = 1) -> DataFrame:
    """The page of ``search``, by way of the postings of a written title index.

    Items that hold all grams of the text are counted out of the postings; only their
    titles are then tested for the text itself. A text of one or two characters is a
    gram itself, so its postings are the answer; an empty one is an error.
    """
    wanted = text.strip().lower()
    if not wanted:
        raise ValueError("a search needs a character")
    size = min(3, len(wanted))
    grams = sorted({wanted[i : i + size] for i in range(len(wanted) - size + 1)})
    held = index.where(F.col("gram").isin(grams)).groupBy("item_id").agg(F.count(F.lit(1)).alias("grams"))
    candidates = catalog.join(held.where(F.col("grams") == len(grams)).select("item_id"), "item_id", "left_semi")
    title = F.lower("title")
    rows = displayable(candidates).where(title.contains(wanted))
    return _page(rows.orderBy(F.desc(title.startswith(wanted)), F.desc_nulls_last("popularity_score"), "item_id"), limit, page)


def lookup(catalog: DataFrame, ids: DataFrame) -> DataFrame:
    """Catalog rows of these ids; ids without a row are left out."""
    return catalog.join(ids.select("item_id").distinct(), "item_id", "left_semi")


def missing_seed_metadata(requests: DataFrame, catalog: DataFrame, key: str = "request_id") -> DataFrame:
    """key, seed_id of seeds without a catalog row."""
    seeds = requests.select(key, F.explode("seeds").alias("seed_id")).distinct()
    return seeds.join(catalog.select(F.col("item_id").alias("seed_id")), "seed_id", "left_anti")


def assert_dense_index(items: DataFrame, edges: DataFrame | None = None, id_col: str = "item_id") -> DataFrame:
    """One row of violation counts: bad_ids, repeated_ids, repeated_positions, gaps, loose_edges."""
    checks = items.agg(
        F.count_if(F.coalesce(F.col(id_col) <= 0, F.lit(True))).alias("bad_ids"),
        (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"),
        (F.count("item_index") - F.count_distinct("item_index")).alias("repeated_positions"),
        (F.coalesce(F.max("item_index") + 1, F.lit(0)) - F.count_distinct("item_index") + F.abs(F.coalesce(F.min("item_index"), F.lit(0)))).alias("gaps"),
    )
    if edges is None:
        return checks.withColumn("loose_edges", F.lit(0).cast("long"))
    ids = items.select(F.col(id_col).alias("end"))
    ends = edges.select(F.explode(F.array("seed_id", "candidate_id")).alias("end"))
    return checks.join(F.broadcast(ends.join(ids, "end", "left_anti").agg(F.count(F.lit(1)).alias("loose_edges"))))


def assert_vectors(vectors: DataFrame, id_col: str = "item_id", vector_col: str = "vector") -> DataFrame:
    """One row: vectors, dims (distinct lengths), not_finite, repeated_ids."""
    bad = F.exists(vector_col, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))))
    return vectors.agg(F.count(F.lit(1)).alias("vectors"), F.count_distinct(F.size(vector_col)).alias("dims"), F.count_if(bad).alias("not_finite"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"))
