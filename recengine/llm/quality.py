"""Quality scores from a sparse ensemble of rules over text statistics.

Statistics of each text are one Arrow pass over its bytes. On a bounded sample of
labelled rows a random forest is grown; every path from a root to a node is a
rule, a conjunction of comparisons of statistics. A logistic regression with an
L1 penalty weighs the rules and drops most of them, and what is left is compiled
into one Spark column expression over the statistics.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from recengine.llm._arrow import IS_SPACE, STEP_BYTES, text_bytes, word_hashes, words
from recengine.llm._scratch import materialize

#: Bound of the training sample, picked by a hash of the id.
SAMPLE_ROWS = 6000

STATISTICS = (
    "log_bytes", "log_words", "word_bytes", "upper_share", "digit_share", "symbol_share", "stop_share", "high_share", "space_share",
    "line_bytes", "log_lines", "same_line_share", "distinct_share", "decorated_share", "upper_word_share", "short_word_share", "bar_share",
)
STAT_TYPE = T.StructType([T.StructField(x, T.DoubleType()) for x in STATISTICS])

_KINDS = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "letter": bytes(range(65, 91)) + bytes(range(97, 123)) + bytes(range(128, 256)), "digit": b"0123456789", "symbol": b"#$%&*!@^~=+<>\\_{}[]", "stop": b".,;:?", "high": bytes(range(128, 256)), "bar": b"|"}
_TABLES = {k: np.isin(np.arange(256), list(v)).astype(np.int32) for k, v in _KINDS.items()}
_LINE = 10


def _distinct(groups: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    """Distinct hashes in each of n groups; groups ascend."""
    if not len(groups):
        return np.zeros(n)
    order = np.lexsort((hashes, groups))
    g, h = groups[order], hashes[order]
    first = np.r_[True, (g[1:] != g[:-1]) | (h[1:] != h[:-1])]
    return np.bincount(g[first], minlength=n).astype(float)


def _step(column: pa.Array) -> np.ndarray:
    data, offs = text_bytes(column)
    n, size = len(column), np.diff(offs).astype(float)

    def per_text(values: np.ndarray) -> np.ndarray:
        sums = np.r_[0, np.cumsum(values, dtype=np.int64)]
        return (sums[offs[1:]] - sums[offs[:-1]]).astype(float)

    count = {k: per_text(t[data]) for k, t in _TABLES.items()}
    start, end, doc = words(data, offs)
    n_words = np.bincount(doc, minlength=n).astype(float)
    word_size = (end - start).astype(float)
    solid = np.r_[0, np.cumsum(_TABLES["letter"][data], dtype=np.int64)]
    tail = _TABLES["symbol"][data[end - 1]].astype(bool) if len(end) else np.zeros(0, bool)
    ups = np.r_[0, np.cumsum(_TABLES["upper"][data], dtype=np.int64)]
    all_upper = (ups[end] - ups[start] == solid[end] - solid[start]) & (ups[end] - ups[start] >= 2)
    share = lambda mask: np.bincount(doc, weights=mask.astype(float), minlength=n) / n_words.clip(1)

    # lines: runs between line ends, empty ones left out
    solid_line = data != _LINE
    begins = solid_line.copy()
    begins[1:] &= ~solid_line[:-1]
    edge = offs[:-1][offs[:-1] < offs[1:]]
    begins[edge] = solid_line[edge]
    stops = solid_line.copy()
    stops[:-1] &= ~solid_line[1:]
    edge = offs[1:][offs[:-1] < offs[1:]] - 1
    stops[edge] = solid_line[edge]
    l_start, l_end = np.flatnonzero(begins), np.flatnonzero(stops) + 1
    l_doc = np.searchsorted(offs, l_start, side="right") - 1
    lines = np.bincount(l_doc, minlength=n).astype(float)

    per_byte = lambda k: count[k] / size.clip(1)
    out = {
        "log_bytes": np.log1p(size),
        "log_words": np.log1p(n_words),
        "word_bytes": np.bincount(doc, weights=word_size, minlength=n) / n_words.clip(1),
        "upper_share": count["upper"] / count["letter"].clip(1),
        "digit_share": per_byte("digit"),
        "symbol_share": per_byte("symbol"),
        "stop_share": per_byte("stop"),
        "high_share": per_byte("high"),
        "space_share": per_text(IS_SPACE[data].astype(np.int32)) / size.clip(1),
        "line_bytes": size / lines.clip(1),
        "log_lines": np.log1p(lines),
        "same_line_share": 1 - _distinct(l_doc, word_hashes(data, l_start, l_end), n) / lines.clip(1),
        "distinct_share": _distinct(doc, word_hashes(data, start, end), n) / n_words.clip(1),
        "decorated_share": share(tail),
        "upper_word_share": share(all_upper),
        "short_word_share": share(word_size <= 3),
        "bar_share": count["bar"] / n_words.clip(1),
    }
    return np.stack([out[k] for k in STATISTICS], axis=1)


@F.arrow_udf(STAT_TYPE)
def statistics(text: pa.Array) -> pa.Array:
    """The STATISTICS of each whole text; those of a null text are those of an empty one."""
    text = text.fill_null("")
    sizes = np.diff(text_bytes(text)[1])
    part = (np.cumsum(sizes) - sizes) // STEP_BYTES
    cuts = np.r_[0, np.flatnonzero(np.diff(part)) + 1, len(text)] if len(text) else np.r_[0, 0]
    rows = np.concatenate([_step(text.slice(int(a), int(b - a))) for a, b in zip(cuts, cuts[1:], strict=False)]) if len(text) else np.zeros((0, len(STATISTICS)))
    return pa.StructArray.from_arrays([pa.array(np.ascontiguousarray(rows[:, k])) for k in range(len(STATISTICS))], names=list(STATISTICS))


@dataclass
class RuleEnsemble:
    """Rules as conjunctions of (statistic, "<=" or ">", bound), their weights, and the intercept."""

    rules: list[tuple[tuple[str, str, float], ...]]
    weights: list[float]
    intercept: float

    def column(self, stats: str) -> Column:
        """The score as an expression over the struct column ``stats``."""
        logit = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights, strict=True):
            logit = logit + F.when(rule_column(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-logit))


def rule_column(rule: tuple[tuple[str, str, float], ...], stats: str) -> Column:
    out = F.lit(True)
    for name, sign, bound in rule:
        value = F.col(stats).getField(name)
        out = out & (value <= F.lit(bound) if sign == "<=" else value > F.lit(bound))
    return out


def paths(debug: str) -> list[tuple[tuple[str, str, float], ...]]:
    """The distinct rules of a forest from its printed form: one for each node below a root."""
    found: dict[tuple, None] = {}
    stack: list[tuple[int, tuple[str, str, float]]] = []
    for line in debug.splitlines():
        m = re.match(r"( *)(?:If|Else) \(feature (\d+) (<=|>) ([-\d.eE]+)\)", line)
        if not m:
            if line.strip().startswith("Tree"):
                stack = []
            continue
        depth = len(m[1])
        while stack and stack[-1][0] >= depth:
            stack.pop()
        stack.append((depth, (STATISTICS[int(m[2])], m[3], float(m[4]))))
        tightest: dict[tuple[str, str], float] = {}
        for _, (name, sign, bound) in stack:
            old = tightest.get((name, sign))
            tightest[name, sign] = bound if old is None else (min if sign == "<=" else max)(old, bound)
        found[tuple(sorted((n, s, b) for (n, s), b in tightest.items()))] = None
    return list(found)


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", trees: int = 12, depth: int = 3, l1: float = 0.001, seed: int = 7) -> RuleEnsemble:
    """Learn from the labelled rows of ``labels`` that have a text in ``docs``, SAMPLE_ROWS at most.

    An id that is labelled twice counts once, with its higher label; of documents
    that repeat an id the one whose statistics come first in order counts, and null
    ids don't. Null texts count as empty ones. Without labels, or with one class
    only, the ensemble has no rules and gives the smoothed share of label 1.
    """
    from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
    from pyspark.ml.feature import VectorAssembler

    known = labels.select(F.col(id_col).alias("l_id"), F.col(label_col).cast("int").alias("label")).where("l_id is not null and label is not null")
    known = known.groupBy("l_id").agg(F.max("label").alias("label")).orderBy(F.xxhash64("l_id"), "l_id").limit(SAMPLE_ROWS)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    # joined by as many tasks as the scan has; only the sample comes into one
    found = rows.join(F.broadcast(known), F.col("id") == F.col("l_id")).select("id", F.col("label").cast("double").alias("label"), statistics("text").alias("s"))
    found = materialize(found.groupBy("id", "label").agg(F.min("s").alias("s")).select("id", "label", "s.*"), "quality-sample")
    sample = materialize(found.repartition(1).sortWithinPartitions("id").drop("id"), "quality-sample-ordered")
    seen = sample.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("label"), F.lit(0.0)).alias("ones")).first()
    share = (seen["ones"] + 1) / (seen["n"] + 2)
    if seen["ones"] in (0, seen["n"]):
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))

    vectors = VectorAssembler(inputCols=list(STATISTICS), outputCol="x").transform(sample).select("label", "x", F.struct(*STATISTICS).alias("s")).cache()
    forest = RandomForestClassifier(labelCol="label", featuresCol="x", numTrees=trees, maxDepth=depth, featureSubsetStrategy="onethird", seed=seed).fit(vectors)
    rules = paths(forest.toDebugString)
    if not rules:
        vectors.unpersist()
        return RuleEnsemble([], [], float(np.log(share / (1 - share))))
    held = _as_vector(vectors, rules).cache()
    lasso = LogisticRegression(labelCol="label", featuresCol="r", elasticNetParam=1.0, regParam=l1, standardization=False, maxIter=60).fit(held)
    vectors.unpersist(), held.unpersist()
    weights = lasso.coefficients.toArray()
    kept = [k for k in range(len(rules)) if abs(weights[k]) > 1e-9]
    return RuleEnsemble([rules[k] for k in kept], [float(weights[k]) for k in kept], float(lasso.intercept))


def _as_vector(rows: DataFrame, rules: list) -> DataFrame:
    from pyspark.ml.functions import array_to_vector

    return rows.select("label", array_to_vector(F.array(*[rule_column(r, "s").cast("double") for r in rules])).alias("r"))


def score(docs: DataFrame, model: RuleEnsemble, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """``docs`` with ``score_col``, 0 to 1, higher where label 1 is likelier; a column of that name is replaced.

    Every row keeps its place, also with a null or repeated id; a null text is scored
    as an empty one. All other columns stay as they are, whatever their names.
    """
    stats = "_quality_statistics"
    while stats in docs.columns or stats == score_col:
        stats += "_"
    return docs.withColumn(stats, statistics(F.col(text_col))).withColumn(score_col, model.column(stats)).drop(stats)
