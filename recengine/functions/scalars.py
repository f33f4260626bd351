"""Column functions: text tokens, ranks, JSON clean-up and display fields."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names of the genre ids.
GENRES = {
    12: "Adventure",
    14: "Fantasy",
    16: "Animation",
    18: "Drama",
    27: "Horror",
    28: "Action",
    35: "Comedy",
    36: "History",
    37: "Western",
    53: "Thriller",
    80: "Crime",
    99: "Documentary",
    878: "Science Fiction",
    9648: "Mystery",
    10402: "Music",
    10749: "Romance",
    10751: "Family",
    10752: "War",
    10770: "TV Movie",
}
IMAGE_BASE, POSTER_SIZE, BACKDROP_SIZE = "https://image.tmdb.org/t/p", "w500", "w1280"
TRAILER_BASE = "https://www.youtube.com/watch?v="


def structured_token(field: str, value: Column) -> Column:
    """field_value in lower case with all but letters and digits as underscores; '' for a value without any."""
    bare = F.regexp_replace(F.regexp_replace(F.lower(value), r"[^\p{L}\p{N}]", "_"), "^_+|_+$", "")
    return F.when(F.coalesce(bare, F.lit("")) == "", F.lit("")).otherwise(F.concat(F.lit(f"{field}_"), bare))


def year_tokens(year: Column) -> Column:
    """year_Y decade_D; '' for null and 0."""
    y = year.cast("double").cast("long")
    return F.when(F.coalesce(y, F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit("year_"), y.cast("string"), F.lit(" decade_"), (F.floor(y / 10) * 10).cast("string")))


def runtime_token(minutes: Column) -> Column:
    """runtime_M with M rounded down to a quarter of an hour; '' for null and 0."""
    m = minutes.cast("double").cast("long")
    return F.when(F.coalesce(m, F.lit(0)) == 0, F.lit("")).otherwise(F.concat(F.lit("runtime_"), (F.floor(m / 15) * 15).cast("string")))


def array_tokens(field: str, values: Column) -> Column:
    """The tokens of the non-empty elements, joined by spaces; '' for null."""
    tokens = F.transform(F.filter(values, lambda x: x.isNotNull() & (x != "")), lambda x: structured_token(field, x))
    return F.coalesce(F.array_join(tokens, " "), F.lit(""))


def plain_text(value: Column, is_array: bool = False) -> Column:
    """'' for null; an array as its non-empty elements joined by spaces."""
    if is_array:
        return F.coalesce(F.array_join(F.filter(value, lambda x: x.isNotNull() & (x != "")), " "), F.lit(""))
    return F.coalesce(value.cast("string"), F.lit(""))


def weighted_document(parts: list[tuple[Column, int]]) -> Column:
    """Every non-empty part as often as its weight says, all joined by spaces."""
    pieces = [F.when(p != "", F.rtrim(F.repeat(F.concat(p, F.lit(" ")), w))) for p, w in parts]
    return F.concat_ws(" ", *pieces)


def reciprocal(rank: Column) -> Column:
    """1 / rank as float, 0 where there is no rank."""
    return F.when(rank > 0, F.lit(1.0) / rank).otherwise(F.lit(0.0)).cast("float")


def log_count(n: Column) -> Column:
    return F.log1p(n.cast("double")).cast("float")


def finite_or_zero(x: Column) -> Column:
    """0 for null, NaN and infinities."""
    return F.when(x.isNull() | F.isnan(x) | (F.abs(x) == F.lit(float("inf"))), F.lit(0).cast("float")).otherwise(x)


def rrf_score(ranks: list[Column], constant: int = 60) -> Column:
    """Sum of 1 / (constant + rank) over the positive ranks, in the given order of sources."""
    total = F.lit(0.0)
    for r in ranks:
        total = total + F.when(r > 0, F.lit(1.0) / (F.lit(float(constant)) + r)).otherwise(F.lit(0.0))
    return total


def clean_seeds(seeds: Column) -> Column:
    """Positive ids in first-seen order, each once."""
    return F.array_distinct(F.filter(seeds, lambda x: x > 0))


def sanitize(recommended: Column, seeds: Column, limit: int) -> Column:
    """Recommended ids without non-positive ones, seeds and repeats, cut at ``limit``."""
    return F.slice(F.array_distinct(F.filter(recommended, lambda x: (x > 0) & ~F.array_contains(seeds, x))), 1, limit)


def release_year(date: Column) -> Column:
    """The first four characters as a number, else null."""
    return F.when(F.length(date) >= 4, F.substring(date, 1, 4).try_cast("int"))


def image_url(path: Column, size: str) -> Column:
    return F.when(F.coalesce(path, F.lit("")) != "", F.concat(F.lit(f"{IMAGE_BASE}/{size}"), path))


def genre_names(ids: Column) -> Column:
    """Names of the known genre ids, in order; unknown ids are dropped."""
    names = F.create_map(*[F.lit(x) for pair in GENRES.items() for x in pair])
    return F.filter(F.transform(ids, lambda g: F.try_element_at(names, g.cast("int"))), lambda x: x.isNotNull())


def rating_or_null(text: Column) -> Column:
    """A double; null for N/A and anything that isn't a number."""
    return text.try_cast("double")


def votes_or_null(text: Column) -> Column:
    """A long from digits with thousands commas; null for N/A and anything else."""
    return F.replace(text, F.lit(","), F.lit("")).try_cast("long")


def lower_names(items: Column) -> Column:
    """Lower-cased names of an array of structs with a name; '[]' for null."""
    named = F.filter(F.transform(items, lambda x: F.lower(x["name"])), lambda x: x.isNotNull())
    return F.coalesce(named, F.array().cast("array<string>"))


def names(items: Column) -> Column:
    named = F.filter(F.transform(items, lambda x: x["name"]), lambda x: x.isNotNull())
    return F.coalesce(named, F.array().cast("array<string>"))


def first_director(crew: Column) -> Column:
    """The name of the first crew member whose job is Director."""
    return F.get(F.filter(crew, lambda x: x["job"] == "Director"), F.lit(0))["name"]


def trailer_url(videos: Column) -> Column:
    """The first official trailer, else the first trailer."""
    trailers = F.filter(videos, lambda v: (v["site"] == "YouTube") & (v["type"] == "Trailer") & v["key"].isNotNull())
    official = F.filter(trailers, lambda v: v["official"])
    key = F.coalesce(F.get(official, F.lit(0)), F.get(trailers, F.lit(0)))["key"]
    return F.when(key.isNotNull(), F.concat(F.lit(TRAILER_BASE), key))


def title_or(title: Column, original: Column) -> Column:
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(original, F.lit("")), F.lit("Untitled"))


def rotated_rank(rank: Column, n: Column, refresh_seed: int) -> Column:
    """Ranks of a list of n rotated left by refresh_seed % n."""
    return F.pmod(rank - 1 - F.lit(refresh_seed), n) + 1


def shifted_page(page: Column, refresh_seed: int, cycle: int = 20) -> Column:
    """max(1, refresh_seed % cycle + page)."""
    return F.greatest(F.lit(1), F.lit(refresh_seed % cycle) + page)
