"""A corpus pipeline of five stages over ``documents``.

Each stage takes (spark, docs, sf_dir) and returns what goes on; ``run`` writes
every stage's rows as Parquet and reads them again as the next one's input. All
stages but the last return the columns of ``documents``.
"""

from __future__ import annotations

from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from recengine.llm import decontam, line_dedup, ngram_join, packing, quality
from recengine.llm._scratch import scratch_path, temporary_tables


def _begins_clean(stage):
    """A stage that first has the driver's garbage collected: only then do shuffle files, broadcasts and plans of the stage before go."""

    @wraps(stage)
    def begin(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        spark.sparkContext._jvm.System.gc()
        return stage(spark, docs, sf_dir)

    return begin


def _unused(docs: DataFrame, name: str) -> str:
    while name in docs.columns:
        name += "_"
    return name


@_begins_clean
def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble, learned from ``labels``, gives at least 0.5."""
    model = quality.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    score = _unused(docs, "_quality")
    return quality.score(docs, model, score_col=score).where(F.col(score) >= 0.5).drop(score)


@_begins_clean
def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without chunks of lines and passages of over 50 words that occurred before; n_chars follows the text."""
    own = {c: _unused(docs, f"_{c}") for c in ("removed_chunks", "removed_lines") if c in docs.columns}
    out = line_dedup.dedup_lines(docs.withColumnsRenamed(own), passages=True).drop("removed_chunks", "removed_lines")
    out = out.withColumnsRenamed({v: k for k, v in own.items()})
    return out.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.lit(0).cast("long"))) if "n_chars" in docs.columns else out


@_begins_clean
def ngram_join_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of linked documents (five words, 0.8) the row with the smallest id, by id and text."""
    return ngram_join.keep_one_of_each(docs)


@_begins_clean
def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no item of ``benchmark``."""
    return decontam.remove_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@_begins_clean
def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents, packed into sequences of at most 2048 ids."""
    return packing.pack(docs, "word_bpe_49k.json")


STAGES = [
    ("quality", quality_stage),
    ("line_dedup", line_dedup_stage),
    ("ngram_join", ngram_join_stage),
    ("decontamination", decontamination_stage),
    ("packing", packing_stage),
]

#: The rule ensemble and the tokenizer have no SQL form; tests/llm/test_pipeline.py holds all stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; of the others only their results stay behind in the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, f"pipeline-{name}")
        with temporary_tables(spark):
            out = stage(spark, docs, sf_dir)
            out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs


QUERIES = {"pipeline": run}
ORACLE: dict[str, str] = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
