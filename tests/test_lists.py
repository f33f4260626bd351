"""Term weights and popular items by lists: the same rows, and nothing shuffled after the lists."""

import math
import re
from collections import Counter

from recengine.operators import content as X
from recengine.operators import features as Z


def _exchanges(df) -> list[str]:
    return [x for x in re.findall(r"\w*Exchange\w*", df._jdf.queryExecution().executedPlan().toString()) if "Broadcast" not in x]


def test_term_weights_move_nothing_after_the_lists(spark):
    docs = [(i % 37, " ".join(f"w{(i * j) % 23} Ab" for j in range(i % 9))) for i in range(400)] + [(None, "w1 w2"), (None, "w1"), (500, None), (501, "?")]
    table = spark.createDataFrame(docs, "item_id long, document string").repartition(5)
    own = {}
    for k, text in docs:
        own.setdefault(k, Counter()).update(re.findall(r"\w{2,}", (text or "").lower()))
    df, total = Counter(t for c in own.values() for t in c), Counter()
    for c in own.values():
        total.update(c)
    kept = sorted((t for t in df if df[t] >= 2), key=lambda t: (-total[t], t))[:10]
    wanted = {}
    for k, c in own.items():
        w = {t: c[t] * (math.log((1 + len(docs)) / (1 + df[t])) + 1) for t in kept if c[t]}
        wanted.update({(k, t): round(x / math.sqrt(sum(y * y for y in w.values())), 9) for t, x in w.items()})
    found = X.tfidf(table, 2, 10)
    rows = found.collect()
    assert {(r.item_id, r.term): round(r.weight, 9) for r in rows} == wanted and len(rows) == len(wanted)
    assert not _exchanges(found)


def test_popular_items_are_left_out_of_one_list(spark, monkeypatch):
    counts = spark.createDataFrame([(i, 100 - i // 2) for i in range(1, 60)], "item_id long, popularity long")
    queries = spark.createDataFrame([(f"q{i}", list(range(i, i + i % 6))) for i in range(40)], "query_id string, seeds array<long>").repartition(4)
    made = Z.recommend_popular(queries, counts, 7)
    rows = sorted(map(tuple, made.collect()))
    monkeypatch.setattr(Z, "MOST_POPULAR", 0)
    longer = Z.recommend_popular(queries, counts, 7)
    assert rows == sorted(map(tuple, longer.collect())) and len(rows) == 40 * 7
    assert "hashpartitioning(query_id" not in made._jdf.queryExecution().executedPlan().toString()


def test_joined_terms_have_the_same_weights(spark, monkeypatch):
    docs = [(i % 37, " ".join(f"w{(i * j) % 23} Ab" for j in range(i % 9))) for i in range(400)] + [(None, "w1 w2"), (500, None)]
    table = spark.createDataFrame(docs, "item_id long, document string").repartition(5)
    rows = lambda d: sorted((r.item_id is None, r.item_id or 0, r.term, round(r.weight, 9)) for r in d.collect())
    found = X.tfidf(table)
    assert not _exchanges(found)
    monkeypatch.setattr(X, "MOST_TERMS", 5)
    joined = X.tfidf(table)
    assert _exchanges(joined) and rows(joined) == rows(found)
