"""Latest events, temporal splits and query records.

A split is a set of window expressions over one shuffle by user; only the global
cutoffs look at all timestamps, as counts per distinct timestamp.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from recengine.schemas import ContractError


@dataclass(frozen=True)
class SplitConfig:
    positive_rating: float = 3.0
    train_fraction: float = 0.6
    validation_fraction: float = 0.2
    min_positive: int = 8
    min_train: int = 6
    seed_count: int = 5


def latest_events(events: DataFrame) -> DataFrame:
    """The latest row of each (user, item) by (ts, ord)."""
    last = events.groupBy("user_id", "item_id").agg(F.max(F.struct("ts", "ord", "rating")).alias("last"))
    return last.select("user_id", "item_id", "last.rating", "last.ts", "last.ord")


def positives(events: DataFrame, threshold: float = 3.0) -> DataFrame:
    """Latest events with a rating of ``threshold`` or more: a later low rating takes an earlier high one away."""
    return latest_events(events).where(F.col("rating") >= threshold)


def _positions(pos: DataFrame) -> DataFrame:
    user, by_time = Window.partitionBy("user_id"), Window.partitionBy("user_id").orderBy("ts")
    return (
        pos.withColumn("n", F.count(F.lit(1)).over(user))
        .withColumn("rn", F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "item_id")))
        .withColumn("le", F.count(F.lit(1)).over(by_time.rangeBetween(Window.unboundedPreceding, Window.currentRow)))
        .withColumn("lt", F.rank().over(by_time) - 1)
    )


def _boundary(position, most):
    """Rows up to ``position`` and its ties; if these reach beyond ``most``, the rows before the ties of row ``most``."""
    user = Window.partitionBy("user_id")
    at = F.least(position, most)
    moved = F.max(F.when(F.col("rn") == at, F.col("le"))).over(user)
    return F.when(moved <= most, moved).otherwise(F.max(F.when(F.col("rn") == most, F.col("lt"))).over(user))


def split_per_user(pos: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """Positives of eligible users with ``part``: train, validation or test, in time order and never between equal timestamps."""
    n = F.col("n")
    rows = _positions(pos).where(n >= config.min_positive)
    first = F.least(F.greatest(F.lit(config.min_train), F.floor(n * F.lit(config.train_fraction))), n - 2).cast("long")
    second = F.least(F.greatest(F.lit(1), F.floor(n * F.lit(config.validation_fraction))), n - F.col("first") - 1).cast("long")
    rows = rows.withColumn("first", first).withColumn("second", second)
    rows = rows.withColumn("train_end", _boundary(F.col("first"), n - 2))
    rows = rows.withColumn("validation_end", _boundary(F.col("train_end") + F.col("second"), n - 1))
    part = F.when(F.col("rn") <= F.col("train_end"), "train").when(F.col("rn") <= F.col("validation_end"), "validation").otherwise("test")
    kept = rows.where((F.col("train_end") >= config.min_train) & (F.col("validation_end") > F.col("train_end")) & (n > F.col("validation_end")))
    return kept.select("user_id", "item_id", "rating", "ts", "ord", part.alias("part"))


def global_cutoffs(pos: DataFrame, config: SplitConfig = SplitConfig()) -> DataFrame:
    """One row: validation_start, test_start, total.

    A cutoff is the next distinct timestamp after the value at ceil(f * (n - 1)) of
    all timestamps in order. Works on counts per timestamp; these are ranked by
    range-partitioned running sums, not in one task.
    """
    counts = pos.groupBy("ts").agg(F.count(F.lit(1)).alias("c"))
    # running counts: sums per coarse bucket of time first, then within each bucket
    bucket = F.floor(F.col("ts") / 86_400 / 32)
    counts = counts.withColumn("bucket", bucket)
    sums = counts.groupBy("bucket").agg(F.sum("c").alias("s"))
    before = sums.select("bucket", F.coalesce(F.sum("s").over(Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    within = Window.partitionBy("bucket").orderBy("ts")
    running = counts.join(before, "bucket").select("ts", (F.col("before") + F.sum("c").over(within)).alias("upto"))
    total = pos.agg(F.count(F.lit(1)).alias("total"))
    f1, f2 = config.train_fraction, config.train_fraction + config.validation_fraction
    wanted = total.select("total", F.ceil(F.lit(f1) * (F.col("total") - 1)).alias("i1"), F.ceil(F.lit(f2) * (F.col("total") - 1)).alias("i2"))
    at = running.join(F.broadcast(wanted)).agg(
        F.min(F.when(F.col("upto") > F.col("i1"), F.col("ts"))).alias("b1"), F.min(F.when(F.col("upto") > F.col("i2"), F.col("ts"))).alias("b2"), F.max("total").alias("total")
    )
    return counts.join(F.broadcast(at)).agg(
        F.min(F.when(F.col("ts") > F.col("b1"), F.col("ts"))).alias("validation_start"), F.min(F.when(F.col("ts") > F.col("b2"), F.col("ts"))).alias("test_start"), F.max("total").alias("total")
    )


def split_global(pos: DataFrame, config: SplitConfig = SplitConfig(), cutoffs: DataFrame | None = None) -> DataFrame:
    """Positives of eligible users with ``part`` by the two global cutoffs."""
    cut = (cutoffs or global_cutoffs(pos, config)).first()
    if cut["validation_start"] is None or cut["test_start"] is None:
        raise ContractError("not enough distinct timestamps for a temporal split")
    part = F.when(F.col("ts") < cut["validation_start"], "train").when(F.col("ts") < cut["test_start"], "validation").otherwise("test")
    user = Window.partitionBy("user_id")
    rows = pos.withColumn("part", part)
    count = lambda p: F.count_if(F.col("part") == p).over(user)
    rows = rows.withColumn("n", F.count(F.lit(1)).over(user)).withColumn("a", count("train")).withColumn("b", count("validation")).withColumn("c", count("test"))
    return rows.where((F.col("n") >= config.min_positive) & (F.col("a") >= config.min_train) & (F.col("b") > 0) & (F.col("c") > 0)).select("user_id", "item_id", "rating", "ts", "ord", "part")


def eligibility(pos: DataFrame, split: DataFrame) -> DataFrame:
    """One row: eligible_users, excluded_users."""
    users = pos.select("user_id").distinct().join(split.select("user_id").distinct().withColumn("in_split", F.lit(1)), "user_id", "left")
    return users.agg(F.count_if(F.col("in_split") == 1).alias("eligible_users"), F.count_if(F.col("in_split").isNull()).alias("excluded_users"))


def query_records(split: DataFrame, target: str = "validation", seed_count: int = 5) -> DataFrame:
    """One row per user: query_id, user_id, seeds, truth, history_end_ts, truth_start_ts.

    Seeds are the last items before the target part: of train for ``validation``,
    of train and validation for ``test``.
    """
    history = F.col("part").isin(["train"] if target == "validation" else ["train", "validation"])
    event = F.struct("ts", "item_id")
    grouped = split.groupBy("user_id").agg(
        F.array_sort(F.collect_list(F.when(history, event))).alias("past"),
        F.array_sort(F.collect_list(F.when(F.col("part") == target, event))).alias("future"),
    )
    past, future = F.transform("past", lambda x: x["item_id"]), F.transform("future", lambda x: x["item_id"])
    return grouped.select(
        F.concat(F.lit(f"{target}:"), F.col("user_id").cast("string")).alias("query_id"),
        "user_id",
        F.slice(past, F.greatest(F.size("past") - (seed_count - 1), F.lit(1)), seed_count).alias("seeds"),
        future.alias("truth"),
        F.element_at("past", -1)["ts"].alias("history_end_ts"),
        F.element_at("future", 1)["ts"].alias("truth_start_ts"),
    )


def split_inner(train: DataFrame, seed_count: int = 5, fraction: float = 0.8) -> DataFrame:
    """The ranker's own split of the train rows: ``part`` is history or target, with a strict time boundary."""
    n = F.col("n")
    rows = _positions(train).where(n >= seed_count + 1)
    rows = rows.withColumn("want", F.least(F.greatest(F.lit(seed_count), F.floor(n * F.lit(fraction))), n - 1).cast("long"))
    user = Window.partitionBy("user_id")
    upto = F.max(F.when(F.col("rn") == F.col("want"), F.col("le"))).over(user)
    before_last = F.max(F.when(F.col("rn") == n, F.col("lt"))).over(user)
    rows = rows.withColumn("end", F.when(upto >= n, before_last).otherwise(upto))
    kept = rows.where((F.col("end") >= seed_count) & (F.col("end") < n))
    return kept.select("user_id", "item_id", "rating", "ts", "ord", F.when(F.col("rn") <= F.col("end"), "history").otherwise("target").alias("part"))


def split_counts(split: DataFrame) -> DataFrame:
    """part, rows, users: the counts of a split's manifest."""
    return split.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("user_id").alias("users"))


def history_union(split: DataFrame) -> DataFrame:
    """The rows that come before the test part: those of train and validation together."""
    return split.where(F.col("part").isin("train", "validation"))


def interaction_counts(events: DataFrame) -> DataFrame:
    """One row for a manifest: users, items, cells (distinct pairs of both), rows."""
    cells = events.groupBy("user_id", "item_id").agg(F.count(F.lit(1)).alias("n"))
    return cells.agg(F.count_distinct("user_id").alias("users"), F.count_distinct("item_id").alias("items"), F.count(F.lit(1)).alias("cells"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))


def summed_cells(events: DataFrame) -> DataFrame:
    """user_id, item_id, rating: the ratings of repeated cells summed."""
    return events.groupBy("user_id", "item_id").agg(F.sum("rating").alias("rating"))


def query_subset(queries: DataFrame, n: int) -> DataFrame:
    """The first n queries by user."""
    return queries.orderBy("user_id").limit(n)


def inner_queries(inner: DataFrame, seed_count: int = 5) -> DataFrame:
    """The query records of a ranker's own split: seeds are the last items of the history, the truth is the targets."""
    return query_records(inner.withColumn("part", F.when(F.col("part") == "history", "train").otherwise("validation")), "validation", seed_count).withColumn("query_id", F.concat(F.lit("ranking:"), F.col("user_id").cast("string")))


def adjacent_pairs(pos: DataFrame, max_pairs: int = 50) -> DataFrame:
    """query_id, candidate_id: consecutive items of a user in both directions, from the first ``max_pairs`` places; no self-pairs."""
    w = Window.partitionBy("user_id").orderBy("ts", "item_id")
    pairs = pos.select(F.col("item_id").alias("a"), F.lead("item_id").over(w).alias("b"), F.row_number().over(w).alias("rn"))
    pairs = pairs.where((F.col("rn") <= max_pairs) & F.col("b").isNotNull() & (F.col("a") != F.col("b")))
    both = F.array(F.struct(F.col("a").alias("query_id"), F.col("b").alias("candidate_id")), F.struct(F.col("b").alias("query_id"), F.col("a").alias("candidate_id")))
    return pairs.select(F.explode(both).alias("p")).select("p.*")
