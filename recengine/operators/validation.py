"""Checks of a built dataset, as one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recengine.sources.tables import fingerprint


def validate_dataset(queries: dict[str, DataFrame], tables: dict[str, DataFrame], fingerprints: DataFrame | None = None, manifest: DataFrame | None = None) -> DataFrame:
    """rule, part, violations.

    Per query table: empty seeds, empty truth, and a truth that doesn't start
    strictly after the history. Per table: empty, and (with ``fingerprints``: name,
    content) other content than recorded. With ``manifest`` (status), a dataset whose
    status isn't "complete", or that has none.
    """
    out = []
    if manifest is not None:
        complete = F.count_if(F.coalesce(F.col("status") == "complete", F.lit(False)))
        bad = F.greatest(F.count(F.lit(1)), F.lit(1)) - complete
        out.append(manifest.agg(bad.alias("violations")).select(F.lit("not_complete").alias("rule"), F.lit("manifest").alias("part"), "violations"))
    for part, q in queries.items():
        one = q.agg(
            F.count_if(F.coalesce(F.size("seeds"), F.lit(0)) < 1).alias("empty_seeds"),
            F.count_if(F.coalesce(F.size("truth"), F.lit(0)) < 1).alias("empty_truth"),
            F.count_if(F.col("history_end_ts") >= F.col("truth_start_ts")).alias("not_after_history"),
        )
        out.append(one.unpivot([], one.columns, "rule", "violations").select("rule", F.lit(part).alias("part"), "violations"))
    for name, t in tables.items():
        out.append(t.limit(1).agg((F.lit(1) - F.count(F.lit(1))).alias("violations")).select(F.lit("empty_table").alias("rule"), F.lit(name).alias("part"), "violations"))
        if fingerprints is not None:
            known = fingerprints.where(F.col("name") == name).select(F.col("content").alias("known"))
            out.append(fingerprint(t).join(F.broadcast(known)).select(F.lit("other_content").alias("rule"), F.lit(name).alias("part"), (F.col("content") != F.col("known")).cast("long").alias("violations")))
    return reduce(DataFrame.unionByName, out)
