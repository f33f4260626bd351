"""All stages of corpus_pipeline in a row, each against a brute-force version on its own input."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import pytest

from recengine.llm import line_dedup, packing, quality
from recengine.llm._scratch import materialize
from test_operators import brute_components
from test_templates import brute_leak
from test_text_tools import brute_statistics

corpus_pipeline = pytest.importorskip("corpus_pipeline")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, _quality string, removed_lines int"
GOOD = "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi pi rho sigma tau".split()
BAD = "#BUY X$$$ !!now a%%% ~click~ {spam} *FREE* <<go>>".split()
ITEM = "Say that Alice buys 12 apples for 3 dollars each and then she gives 4 apples to Bob, how many apples does Alice have left?"
OTHER = "Say that Carol buys 15 apples for 7 dollars each and then she gives 9 apples to Dan, how many apples does Carol have left?"


def corpus():
    rng = random.Random(21)
    line = lambda n: " ".join(rng.choice(GOOD) + str(rng.randint(0, 999)) for _ in range(n))
    texts = []
    good = lambda n=6: "\n".join(line(rng.randint(8, 15)) for _ in range(n))
    for k in range(60):
        texts.append((k, good()))
    for k in range(40):
        texts.append((100 + k, " ".join(rng.choices(BAD, k=40))))
    passage, licence = line(60), "\n".join(line(9) for _ in range(8))
    for k in range(6):
        texts.append((200 + k, f"{line(10)}\n{passage}\n{line(11)}\n{licence}\n{line(12)}"))
    near = [good(3).split(" ") for _ in range(4)]
    for k in range(24):
        words = list(near[k % 4])
        words[rng.randrange(len(words))] = f"edit{k}"
        texts.append((300 + k, " ".join(words)))
    texts += [(400 + k, f"{line(20)} {x} {line(20)}") for k, x in enumerate((ITEM, OTHER, ITEM.replace(",", " -")))]
    texts += [(500, "long " + line(20_000)), (None, good()), (None, good()), (None, None), (501, None), (502, ""), (503, None)]
    texts += [texts[3], texts[3], (3, texts[4][1]), (600, texts[5][1]), (600, good()), (None, texts[6][1])]
    return texts


def as_rows(texts):
    return [(i, t, "en", "s", len(t or ""), "own", 7) for i, t in texts]


def brute_passages(docs):
    """Texts without repeated chunks and passages; docs are (id, text), and rows that repeat both count once."""
    def key(i, t):
        return hashlib.sha256(("\x01" if i is None else str(i)).encode() + b"\x00" + (t or "").encode()).digest()

    places, chunks = defaultdict(set), defaultdict(set)
    for i, t in set(docs):
        lines, rank = (t or "").split("\n"), ((i is not None, i or 0), key(i, t))
        words = [x.count(" ") + 1 for x in lines]
        spans = set()
        for a in range(len(lines)):
            ends = [b for b in range(a, len(lines)) if sum(words[a : b + 1]) > line_dedup.PASSAGE_WORDS]
            begins = [b for b in range(a, -1, -1) if sum(words[b : a + 1]) > line_dedup.PASSAGE_WORDS]
            spans |= {(a, ends[0])} if ends else set()
            spans |= {(begins[0], a)} if begins else set()
        for a, b in spans:
            places[tuple(lines[a : b + 1])].add((*rank, a))
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        starts = [k for k in range(len(lines)) if k == 0 or ((h[k - 2] if k > 1 else 0) * 1_000_003 + h[k - 1]) % 2_147_483_647 % line_dedup.DIVISOR == 0]
        for n, (a, b) in enumerate(zip(starts, [*starts[1:], len(lines)], strict=True)):
            if b - a > 1 and "".join(lines[a:b]).strip(" "):
                chunks[tuple(lines[a:b])].add((*rank, n, a))
    gone = defaultdict(set)
    for span, where in places.items():
        first = min(where)
        for w in where:
            if w[1] != first[1] or w[2] >= first[2] + len(span):
                gone[w[1]] |= set(range(w[2], w[2] + len(span)))
    for span, where in chunks.items():
        first = min(where)
        for w in where - {first}:
            gone[w[1]] |= set(range(w[3], w[3] + len(span)))
    return [(i, None if t is None else "\n".join(x for n, x in enumerate(t.split("\n")) if n not in gone[key(i, t)])) for i, t in docs]


def plain(rows):
    return sorted(((r["doc_id"], r["text"]) for r in rows), key=str)


def test_every_stage_equals_brute_force(spark, tmp_path):
    texts = corpus()
    spark.createDataFrame(as_rows(texts), SCHEMA).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    labels = [(i, 0 if 100 <= i < 200 else 1) for i in {i for i, _ in texts if i is not None}]
    spark.createDataFrame([(i, q, 0) for i, q in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, ITEM), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "line_dedup", "ngram_join", "decontamination", "packing"]
    model, out = quality.fit(docs, spark.read.parquet(f"{tmp_path}/labels.parquet")), {}
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        now = materialize(stage(spark, now, str(tmp_path)), name)
        out[name] = now.collect()
        if name != "packing":
            assert now.columns == docs.columns and {(r["_quality"], r["removed_lines"], r["lang"], r["source"]) for r in out[name]} == {("own", 7, "en", "s")}

    def score(text):
        stats, logit = brute_statistics(text or ""), model.intercept
        for rule, weight in zip(model.rules, model.weights, strict=True):
            logit += weight * all(stats[n] <= b if s == "<=" else stats[n] > b for n, s, b in rule)
        return 1 / (1 + np.exp(-logit))

    kept = [x for x in texts if score(x[1]) >= 0.5]
    assert plain(out["quality"]) == sorted(kept, key=str) and not any(i is not None and 100 <= i < 200 for i, _ in kept) and len(kept) > 90

    lines = brute_passages(kept)
    assert plain(out["line_dedup"]) == sorted(lines, key=str)
    assert all(r["n_chars"] == len(r["text"] or "") for r in out["line_dedup"])

    before, after = plain(out["line_dedup"]), plain(out["ngram_join"])
    component = {}
    for i, t in before:  # rows of a component, by brute force on texts
        component.setdefault(t or "", len(component))
    by_text = [(component[t or ""], t) for _, t in before]
    label = {(number, n): root for number, n, root in brute_components(by_text, 5, 80)}
    of = lambda t: next(root for (number, n), root in label.items() if number == str(component[t or ""]))
    groups = defaultdict(list)
    for i, t in before:
        groups[of(t) if (t or "").split() else object()].append((i, t))
    assert len(after) == len(groups) and not [x for x in after if x not in before]
    for rows in groups.values():
        stays = [x for x in rows if x in after]
        assert stays and min(rows, key=lambda x: (x[0] is None, x[0] or 0))[0] in [i for i, _ in stays]

    leaks = [x for x in after if brute_leak(x[1], ITEM)]
    assert {i for i, _ in leaks} == {400, 401, 402} & {i for i, _ in after} and leaks
    assert plain(out["decontamination"]) == sorted((x for x in after if x not in leaks), key=str)

    encode = packing.word_tokenizer("word_bpe_49k.json").encode
    want = []
    for i, t in plain(out["decontamination"]):
        ids = encode(t or "", add_special_tokens=False).ids + [1]
        want += [(str(i), s, zlib.crc32(np.array(ids[s : s + 2048], "<u4").tobytes()), len(ids)) for s in range(0, len(ids), 2048)]
    assert sorted((str(r["doc_id"]), r["start"], r["ids_crc32"], r["doc_tokens"]) for r in out["packing"]) == sorted(want)
    filled = defaultdict(int)
    for seq, offset, length in sorted((r["sequence_id"], r["offset"], r["length"]) for r in out["packing"]):
        assert filled[seq] == offset
        filled[seq] += length
    assert max(filled.values()) <= 2048

    before = {p.name for p in tmp_path.iterdir()}
    assert plain(corpus_pipeline.run(spark, str(tmp_path)).withColumnRenamed("ids_crc32", "text").collect()) == plain([{"doc_id": r["doc_id"], "text": r["ids_crc32"]} for r in out["packing"]])
    stays = {p.name.rsplit("-", 1)[0] for p in tmp_path.iterdir() if p.name not in before}
    assert stays == {f"pipeline-{n}" for n, _ in corpus_pipeline.STAGES}  # the stages' own tables are gone


def test_empty_tables_pass_through(spark, tmp_path):
    spark.createDataFrame([], SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
