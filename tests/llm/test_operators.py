"""The operators on small tables: nulls, empty and long texts, ties, repeated rows, empty tables and extra columns."""

import base64
import hashlib
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from recengine.llm import decontam, exact_dedup, langid, line_dedup, ngram_join, packing, pii, quality, token_counts, warc
from recengine.llm.components import components

SCHEMA = "doc_id long, text string, lang string, key string, n int, sid long"


def make(spark, rows):
    return spark.createDataFrame([(i, t, "en", "k", 1, 2) for i, t in rows], SCHEMA)


ROWS = [(1, None), (2, ""), (3, "one two three four five six"), (3, "one two three four five six"), (4, "ONE two three four five six"), (None, "x"), (None, None), (5, "long " * 4000), (6, "a b"), (7, "a b"), (7, "other words")]


@pytest.fixture
def docs(spark):
    return make(spark, ROWS)


@pytest.fixture
def nothing(spark):
    return make(spark, [])


def test_exact_dedup(spark, tmp_path):
    for name, rows in (("some", ROWS), ("none", [])):
        path = f"{tmp_path}/{name}"
        make(spark, rows).repartition(3).write.parquet(path)
        for digest in (exact_dedup.sha256_hex, lambda c: F.substring(F.sha2(c, 256), 1, 1)):
            got = exact_dedup.exact_dedup(spark, path, digest=digest, max_bytes_per_trigger=1).collect()
            groups = defaultdict(list)
            for i, t in rows:
                groups[t or ""].append(i)
            want = sorted((str(i), str(max((x for x in groups[t or ""] if x is not None), default=None)), len(groups[t or ""]), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in rows)
            assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
            assert sum(r.kept for r in got) == len(groups)


def test_exact_dedup_goes_on_from_its_state(spark, tmp_path):
    path, state = f"{tmp_path}/in", f"{tmp_path}/state"
    make(spark, [(1, "a"), (2, "b")]).write.parquet(path)
    assert exact_dedup.stream_state(spark, path, state).count() == 2
    make(spark, [(3, "a")]).write.mode("append").parquet(path)
    assert sorted((r.keep.id, r.n) for r in exact_dedup.stream_state(spark, path, state).collect()) == [(2, 1), (3, 2)]


def brute_components(rows, size, percent):
    sets = []
    for _, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append(frozenset(tuple(w[k : k + size]) for k in range(len(w) - size + 1)) if len(w) >= size else frozenset([tuple(w)] if w else []))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            c = len(sets[a] & sets[b])
            if sets[a] and sets[b] and 100 * c >= percent * len(sets[a] | sets[b]):
                root[max(find(a), find(b))] = min(find(a), find(b))
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted((str(i), len(sets[k]), str(least.get(find(k)) if sets[k] else i)) for k, (i, _) in enumerate(rows))


def near_copies(seed, groups, size):
    rng, rows = random.Random(seed), []
    vocabulary = [f"w{k}" for k in range(400)]
    common = [rng.choice(vocabulary) for _ in range(12)]
    for _ in range(groups):
        base = [rng.choice(vocabulary) for _ in range(rng.randint(20, 120))]
        for _ in range(rng.randint(1, size)):
            text = list(base)
            for _ in range(rng.randint(0, 4)):
                text[rng.randrange(len(text))] = rng.choice(vocabulary)
            rows.append((len(rows) * 7 % 1009, " ".join(text + (common if rng.random() < 0.5 else []))))
    return rows


@pytest.mark.parametrize("block", [256, 4])
def test_ngram_join_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(ngram_join, "BLOCK", block)
    for rows in (ROWS, near_copies(1, 12, 14), []):
        got = ngram_join.jaccard_components(make(spark, rows), size=4, percent=85).collect()
        assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == brute_components(rows, 4, 85)


def test_unrelated_texts_with_a_common_passage_do_not_meet(spark, monkeypatch):
    for name, value in (("GROUPS", 16), ("HOT", 16), ("BLOCK", 16)):
        monkeypatch.setattr(ngram_join, name, value)
    seen, write = defaultdict(int), ngram_join.materialize
    monkeypatch.setattr(ngram_join, "materialize", lambda df, name: (t := write(df, name), seen.__setitem__(name, seen[name] + t.count()))[0])
    common = " ".join(f"c{k}" for k in range(60))
    texts = lambda n: [(k, " ".join(f"o{k}x{j}" for j in range(60)) + " " + common) for k in range(n)]
    for n in (500,):
        seen.clear()
        got = ngram_join.jaccard_components(make(spark, texts(n)), size=4, percent=85)
        assert got.where("doc_id = component_id").count() == n
        assert seen["visitors"] + seen["more-visits"] + seen["candidates"] < n / 2, dict(seen)


def test_ngram_stage_keeps_one_row_of_each_component(spark):
    import corpus_pipeline

    words = lambda k: " ".join(f"{c}{k}" for c in "abcdefghijklmnopqrstuvwxyz")
    rows = [
        (1, words(1)), (None, words(1)), (None, words(2)), (None, None), (None, None), (5, None),  # a null id linked to an id
        (7, words(3)), (7, words(4)), (6, words(4)),  # a repeated id, one of its texts a copy
        (8, words(5)), (8, words(5)), (8, words(5)), (None, words(6)), (None, words(6)), (None, words(6) + " more"), (None, words(7)),
    ]
    d = make(spark, rows)
    left = corpus_pipeline.ngram_join_stage(spark, d, "")
    got = [(r.doc_id, r.text) for r in left.collect()]
    sixth = [x for x in got if x[1] and x[1].startswith(words(6))]
    assert left.columns == d.columns and len(sixth) == 1 and sixth[0] in rows
    want = [(1, words(1)), (None, words(2)), (None, None), (None, None), (5, None), (7, words(3)), (6, words(4)), (8, words(5)), (None, words(7))]
    assert sorted((x for x in got if x not in sixth), key=str) == sorted(want, key=str)


def test_components(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(1, 40)] + [(100, 103), (103, 100), (101, 103), (7, 7)], "u long, v long")
    got = {r.node: r.component for r in components(links).collect()}
    assert got == {**{k: 1 for k in range(1, 41)}, 100: 100, 101: 100, 103: 100}
    assert components(links.limit(0)).count() == 0


def test_packing(spark, docs, nothing):
    out = packing.pack(docs, "word_bpe_49k.json", max_len=64).collect()
    t = packing.word_tokenizer("word_bpe_49k.json")
    want = sorted(zlib.crc32(np.array((t.encode(x or "", add_special_tokens=False).ids + [1])[k : k + 64], "<u4").tobytes()) for _, x in ROWS for k in range(0, len(t.encode(x or "", add_special_tokens=False).ids) + 1, 64))
    assert sorted(r.ids_crc32 for r in out) == want
    by = defaultdict(list)
    for r in out:
        by[r.sequence_id].append((r.offset, r.length))
    for pieces in by.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 64
    assert packing.pack(nothing, "word_bpe_49k.json").count() == 0


def test_packing_of_many_equal_lengths_and_repeated_rows(spark):
    rows = [(k % 50, "a b c") for k in range(400)] + [(None, "a b c")] * 30 + [(k, "x " * (k % 9)) for k in range(200)]
    out = packing.pack(make(spark, rows).drop("key").withColumn("salt", F.lit(1)).withColumn("length", F.lit("l")), "word_bpe_49k.json", max_len=16).collect()
    places = sorted((r.sequence_id, r.offset, r.length) for r in out)
    assert len(out) == len(rows) and len({p[:2] for p in places}) == len(places)
    filled = defaultdict(int)
    for seq, offset, length in places:
        assert filled[seq] == offset
        filled[seq] += length
    assert max(filled.values()) <= 16 and sum(filled.values()) > 0.95 * 16 * len(filled)


def test_other_tokenizers_encode_whole_texts(tmp_path):
    from tokenizers import Tokenizer, models, pre_tokenizers

    other = Tokenizer(models.WordLevel({"a b": 3, "c": 4, "?": 0}, unk_token="?"))
    other.pre_tokenizer = pre_tokenizers.Split(",", "removed")
    other.save(f"{tmp_path}/t.json")
    encoder = packing.WordIds(f"{tmp_path}/t.json")
    ids, ends = encoder.texts(pa.array(["a b,c", "", "c,a b,zz"]))
    assert ids.tolist() == [3, 4, 4, 3, 0] and ends.tolist() == [0, 2, 2, 5]


def test_token_counts(spark, docs, nothing):
    model, _ = token_counts.piece_model("piece_bpe_32k.model")
    got = token_counts.count_tokens(docs, "piece_bpe_32k.model", limit=5, chunk_chars=1000, overlap_chars=4).collect()
    assert sorted((str(r.doc_id), r.n_bytes, r.n_tokens, r.over_limit) for r in got) == sorted((str(i), len((t or "").encode()), len(model.encode(t or "")), len(model.encode(t or "")) > 5) for i, t in ROWS)
    assert token_counts.count_tokens(nothing, "piece_bpe_32k.model").count() == 0


def test_warc(spark, tmp_path):
    rows = [(1, "http://a", "same"), (2, None, "same"), (3, "u", None), (4, "u", ""), (None, "u", "same"), (5, "u", "é" * 3000), (6, "u", "alone"), (6, "u", "alone")]
    pages = spark.createDataFrame([(*r, "extra") for r in rows], "page_id long, url string, html string, first string")
    got = warc.archive_and_read(pages, f"{tmp_path}/w").collect()
    last = {}
    for i, _, h in rows:
        last[h or ""] = max(x for x in (last.get(h or ""), i) if x is not None) if (last.get(h or "") or i) is not None else None
    want = [(str(i), len((h or "").encode()), base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode(), *(("response", "None") if i == last[h or ""] else ("revisit", str(last[h or ""])))) for i, _, h in rows]
    assert sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, str(r.refers_to)) for r in got) == sorted(want)
    assert warc.archive_and_read(pages.limit(0), f"{tmp_path}/e").count() == 0


def test_archives_begin_with_their_dictionary_and_are_bounded_by_bytes(spark, tmp_path, monkeypatch):
    import glob

    import zstandard

    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 3000)
    rng = random.Random(7)
    words = ["alpha", "beta", "gamma", "<p>", "</p>", "delta"]
    rows = [(k, f"http://x/{k}", "<html>" + " ".join(rng.choices(words, k=60)) + "</html>") for k in range(300)] + [(300, "u", "y" * 5000), (None, None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write_warc(pages, f"{tmp_path}/w")
    files, dictionaries, records = glob.glob(f"{tmp_path}/w/part-*"), set(), 0
    assert len(files) > 3
    for name in files:
        data = open(name, "rb").read()
        found = list(warc.frames(memoryview(data)))
        assert found[0][0] == warc.DICT_FRAME and [m for m, _ in found].count(warc.DICT_FRAME) == 1
        head = bytes(found[0][1])
        dictionaries.add(head)
        own = [len(x) for m, x in found if m == warc.ZSTD_FRAME]
        assert sum(own[:-1]) < 3000  # closed by the record that reaches the bound
        records += len(own)
        # any Zstandard reader passes over the skippable frames and gives the records in a row
        reader = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(head)).stream_reader(data, read_across_frames=True)
        assert reader.read().count(b"WARC/1.1\r\n") == len(own)
        alone = [x for m, x in found if m == warc.ZSTD_FRAME][-1]  # a record is read without those before it
        assert zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(head)).decompress(bytes(alone)).startswith(b"WARC/1.1")
    assert records == len(rows) and len(dictionaries) == 1
    trained = zstandard.ZstdCompressionDict(next(iter(dictionaries)))
    assert trained.dict_id() != 0  # trained, not raw content
    assert warc.read_warc(spark, f"{tmp_path}/w").count() == len(rows)


def test_langid(spark):
    rng = random.Random(2)
    word = {"en": ["the", "and", "of", "with", "this"], "de": ["der", "und", "über", "nicht", "ist"]}
    rows = [(k, " ".join(rng.choices(word[g], k=20)), g) for k in range(60) for g in ("en", "de")] + [(900, None, "en"), (901, "123 !", "de"), (902, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = langid.fit(docs)
    got = {(r.doc_id, r.text): r.lang_pred for r in docs.join(langid.predict(docs.select("doc_id", "text").distinct(), model), "doc_id").collect()}
    assert got[900, None] == got[901, "123 !"] == got[902, ""] == "und"
    out = langid.predict(spark.createDataFrame([(1, "with this and the"), (2, "nicht der über ist")], "doc_id long, text string"), model).collect()
    assert {r.doc_id: r.lang_pred for r in out} == {1: "en", 2: "de"} and all(0 < r.score <= 1 for r in out)
    assert langid.fit(docs.limit(0)) is None and langid.predict(docs.limit(0), model).count() == 0
    extra = spark.createDataFrame([(1, "with this", 5, "p"), (1, "with this", 6, "q"), (None, "nicht der", 7, "r")], "doc_id long, text string, size int, place string")
    assert sorted((str(r.doc_id), r.lang_pred) for r in langid.predict(extra, model).collect()) == [("1", "en"), ("1", "en"), ("None", "de")]


def test_langid_sample_is_bounded_and_no_language_is_without_a_text(spark, monkeypatch):
    monkeypatch.setattr(langid, "SAMPLE_ROWS", 10)
    monkeypatch.setattr(langid, "SAMPLE_BYTES", 4000)
    monkeypatch.setattr(langid, "SAMPLE_TEXT_BYTES", 500)
    rows = [(k, "en", 100) for k in range(300)] + [(7, "en", 100)] * 900 + [(None, "de", 9000), (1, "de", 8000), (2, "fr", 400), (2, "fr", 400), (3, "fr", 600)]
    got = langid.pick_sample(spark.createDataFrame(rows, "id long, lang string, size long")).collect()
    by = defaultdict(list)
    for r in got:
        by[r.lang].append((r.id, r.size))
    assert 1 <= len(by["en"]) <= 10 and len(set(by["en"])) == len(by["en"])
    assert by["de"] == [(1, 8000)] and by["fr"] == [(2, 400)]


def test_langid_of_texts_longer_than_a_step_is_that_of_their_bytes(spark, monkeypatch):
    rng = random.Random(3)
    word = {"en": ["the", "and", "of", "with", "this"], "de": ["der", "und", "über", "nicht", "ist"]}
    docs = spark.createDataFrame([(k, " ".join(rng.choices(word[g], k=20)), g) for k in range(30) for g in ("en", "de")], "doc_id long, text string, lang string")
    model = langid.fit(docs)
    texts = [(1, " ".join(rng.choices(word["en"], k=400))), (2, ""), (3, " ".join(rng.choices(word["de"] + word["en"], k=300))), (4, "der")]
    monkeypatch.setattr(langid, "_CHUNK", 64)
    got = {r.doc_id: r for r in langid.predict(spark.createDataFrame(texts, "doc_id long, text string"), model).collect()}
    for i, t in texts:
        if t:
            data, real, _ = langid.padded(pa.array([t]))
            total = model.costs(langid.windows(data, 0, len(data))[real]).sum(1, dtype=np.float64)
            assert got[i].lang_pred == model.langs[int(total.argmin())] and abs(got[i].bits_per_byte - total.min() / len(t.encode())) < 1e-3
    assert {r.lang_pred for r in langid.predict(docs, None).collect()} == {"und"}


def test_quality(spark, docs, nothing):
    rng = random.Random(4)
    rows, labels = [], []
    for k in range(300):
        good = k % 3 > 0
        rows.append((k, " ".join(rng.choices(["alpha", "beta", "Gamma", "delta."], k=30) if good else rng.choices(["#!", "X$$$", "BUY!!", "a%%%"], k=30))))
        labels.append((k, int(good)))
    d, lab = make(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int")
    model = quality.fit(d.where("doc_id < 200"), lab)
    assert model.rules
    scored = quality.score(d, model).join(lab, "doc_id").where("doc_id >= 200").collect()
    assert sum((r.score >= 0.5) == bool(r.quality) for r in scored) >= 0.95 * len(scored)
    assert all(0 <= r.score <= 1 for r in quality.score(docs, model).collect()) and quality.score(nothing, model).count() == 0
    assert quality.fit(nothing, lab).rules == [] and quality.fit(d, lab.where("quality = 1")).rules == []
    # repeated rows, null ids and texts, and columns with the names of the inside
    odd = spark.createDataFrame([(1, "BUY!! X$$$"), (1, "BUY!! X$$$"), (None, "alpha"), (2, None), (3, "")], "doc_id long, text string").withColumn("_quality_statistics", F.lit(7)).withColumn("score", F.lit("old"))
    out = quality.score(odd, model)
    assert out.columns == odd.columns and out.count() == 5 and {r["_quality_statistics"] for r in out.collect()} == {7}
    scores = {(r.doc_id, r.text): r.score for r in out.collect()}
    assert scores[2, None] == scores[3, ""]
    twice = quality.fit(d.where("doc_id < 200").unionByName(d.where("doc_id < 200")), lab)
    assert (twice.rules, twice.weights) == (model.rules, model.weights)


def test_decontamination(spark, docs, nothing):
    item = "Say that Alice buys 12 apples for 3 dollars each and then she gives 4 apples to Bob, how many apples does Alice have left?"
    bench = spark.createDataFrame([(1, item), (2, None), (3, "short one")], "item_id long, text string")
    rows = [
        (1, "Well. " + item + " The end."),
        (2, "say that Carol buys 15 apples for 7 dollars each and then she gives 9 apples to Dan, how many apples does Carol have left?"),
        (3, "Say that Carol buys 15 apples for 7 dollars each and then she gives 9 apples to Dan, how many apples does Erin have left?"),
        (4, None), (None, item), (None, "clean text that is long enough to have several windows of eight words each"), (5, ""),
    ]
    d = make(spark, rows)
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontam.find_leaks(d, bench).collect()}
    assert got == {(1, 1): 0, (2, 1): 5, (None, 1): 0}
    left = decontam.remove_leaks(d, bench)
    assert left.columns == d.columns and sorted(str(r.doc_id) for r in left.collect()) == ["3", "4", "5", "None"]
    assert decontam.find_leaks(nothing, bench).count() == 0 and decontam.find_leaks(d, bench.limit(0)).count() == 0


def test_decontamination_of_opening_names_and_short_items(spark):
    item = "Tom has 5 apples. Mary has 7 pears. Tom gives Mary 2 apples. Mary gives Tom 3 pears. How many apples does Mary have now?"
    items = [(1, item), (2, "Add 12 and 7 quickly"), (3, "1 2 3 4 5 6 7 8 9 10 11"), (4, "Which old river runs through Paris"), (5, ""), (6, "... !")]
    bench = spark.createDataFrame(items, "item_id long, text string")
    other = item.replace("Tom", "Bob").replace("Mary", "Sue").replace("5", "6").replace("7", "9").replace("2", "4").replace("3", "8")
    rows = [
        (1, "Here it is. " + other), (2, item), (3, other.replace("Bob 8", "Dan 8").replace("Sue gives", "Ann gives")), (4, "please add 12 and 7 quickly, then stop"), (5, "please add 13 and 8 quickly, then stop"),
        (6, "so 1 2 3 4 5 6 7 8 9 10 11 end"), (7, "so 1 2 3 4 5 6 7 8 9 11 10 end"), (8, "Say it: which old river runs through London"), (9, ""), (10, None),
    ]
    got = {(r.doc_id, r.item_id): r.changed_slots for r in decontam.find_leaks(make(spark, rows), bench).collect()}
    assert {k: got.pop(k) for k in ((1, 1), (2, 1), (4, 2), (6, 3), (8, 4))} == {(1, 1): 6, (2, 1): 0, (4, 2): 0, (6, 3): 0, (8, 4): 1}
    assert set(got) <= {(3, 1)}  # half changed consistently, a matter of min_share


STORIES = [
    "{a} has {x} apples. {b} has {y} pears. {a} gives {b} {z} apples. {b} gives {a} {w} pears. How many apples does {b} have now?",
    "{a} drives {x} km in {y} hours. Then {b} drives {z} km in {w} hours on the same road. Who was faster, {a} or {b}?",
    "Say that {a} buys {x} books for {y} dollars each and sells {z} of them to {b} for {w} dollars, how much does {a} lose?",
    "{a} and {b} share {x} sweets so that {a} has {y} more than {b} and both eat {z} of them.",
    "If {a} paints {x} walls in {y} days and {b} paints {z} walls in {w} days how long do both take together for one wall?",
    "What is {x} plus {y} minus {z} when {a} counts from {w}?",
    "{a} runs {x} miles before lunch today",
    "Which river did {a} and {b} cross?",
]


def test_recall_of_questions_with_other_names_and_numbers(spark):
    rng = random.Random(12)
    people = ["Tom", "Mary", "Alice", "Bob", "Carol", "Dan", "Erin", "Frank", "Grace", "Heidi"]
    values = lambda names: dict(zip("ab", names, strict=True)) | dict(zip("xyzw", map(str, rng.sample(range(2, 30), 4)), strict=True))
    filler = lambda n: " ".join(rng.choices("some words that stand around a question in a text of no interest at all".split(), k=n))
    items, rows, planted = [], [], set()
    for k, story in enumerate(STORIES):
        items.append((k, story.format(**values(rng.sample(people[:5], 2)))))
        for j in range(10):
            own = values(rng.sample(people[5:], 2))
            if j % 3 == 0:
                own |= dict.fromkeys("xyz", "5")  # numbers of the item become one
            rows.append((100 * k + j, filler(30) + ". " + story.format(**own) + " " + filler(20)))
            planted.add(100 * k + j)
    rows += [(10_000 + k, filler(80) + ". " + " ".join(rng.choices(people, k=3))) for k in range(60)]
    found = {r.doc_id for r in decontam.find_leaks(make(spark, rows), spark.createDataFrame(items, "item_id long, text string")).collect()}
    assert len(found & planted) >= 0.9 * len(planted) and not found - planted, len(found & planted) / len(planted)


def test_a_window_of_all_items_and_repeated_item_ids(spark):
    prompt = "Answer the following question as well as you can and explain every step."
    bench = spark.createDataFrame([(k // 2, f"{prompt} {' '.join(f'w{k}x{j}' for j in range(14))}") for k in range(20)] + [(None, "a null id for this one item of the benchmark table")], "item_id long, text string")
    rows = [(k, f"{prompt} clean text number {k}") for k in range(40)] + [(100, "so " + f"{prompt} {' '.join(f'w7x{j}' for j in range(14))}"), (101, "a null id for this one item of the benchmark table"), (101, "clean")]
    d = make(spark, rows)
    assert sorted(((r.doc_id, r.item_id) for r in decontam.find_leaks(d, bench).collect())) == [(100, 3), (101, None)]
    left = decontam.remove_leaks(d, bench).collect()
    assert len(left) == 41 and (101, "clean") in [(r.doc_id, r.text) for r in left]


def brute_lines(rows, least_words=1):
    chunks = []
    for i, t in rows:
        lines = (t or "").split("\n")
        h = [int(hashlib.md5(x.encode()).hexdigest()[:8], 16) for x in lines]
        out = []
        for k, x in enumerate(lines):
            if k == 0 or ((h[k - 2] if k > 1 else 0) * 1_000_003 + h[k - 1]) % 2_147_483_647 % 4 == 0:
                out.append([])
            out[-1].append(x)
        chunks.append((i, t, out))
    first = {}
    for i, t, out in sorted(chunks, key=lambda c: (c[0] is not None, c[0] or 0)):
        for k, c in enumerate(out):
            first.setdefault("\n".join(c), (i, t, k))
    result = []
    for i, t, out in chunks:
        able = lambda c: len(c) > 1 and "".join(c).strip(" ") and len(re.findall("[ \n]", "\n".join(c))) + 1 >= least_words
        gone = [bool(able(c)) and first["\n".join(c)] != (i, t, k) for k, c in enumerate(out)]
        result.append((str(i), None if t is None else "\n".join(x for c, g in zip(out, gone, strict=True) if not g for x in c), sum(gone)))
    return sorted(result, key=str)


def test_line_dedup(spark, nothing):
    rng = random.Random(6)
    line = lambda n: " ".join(rng.choices("abcdefghij", k=n))
    passage, paragraph = line(60), "\n".join(line(12) for _ in range(9))
    rows = [(k, "\n".join([line(8), passage if k % 2 else line(9), line(7), paragraph if k % 3 == 0 else line(5), line(6)])) for k in range(20)]
    rows += [(50, None), (51, ""), (None, passage), (52, "\n".join([line(3)] * 40)), (53, rows[0][1]), (54, "\n\n \n" * 9), (55, "\n".join(line(1) for _ in range(3000)))]
    rows += [(60 + k, "home\nabout us\n\nimprint\n" + line(9)) for k in range(4)]
    d = make(spark, rows)
    got = line_dedup.dedup_lines(d)
    assert got.columns == [*d.columns, "removed_chunks", "removed_lines"]
    assert sorted(((str(r.doc_id), r.text, r.removed_chunks) for r in got.collect()), key=str) == brute_lines(rows)
    assert sorted(((str(r.doc_id), r.text, r.removed_chunks) for r in line_dedup.dedup_lines(d, least_words=20).collect()), key=str) == brute_lines(rows, 20)
    assert "Python" not in got._jdf.queryExecution().toString() and line_dedup.dedup_lines(nothing).count() == 0


def test_line_dedup_removes_whole_passages(spark, nothing):
    rng = random.Random(11)
    line = lambda n: " ".join("".join(rng.choices("abcdefghij", k=4)) for _ in range(n))
    passages = [[line(-(-51 // n) + rng.randint(0, 9)) for _ in range(n)] for n in (2, 3, 4, 5, 6) for _ in range(8)]
    around = lambda lines: "\n".join([line(5), line(7), *lines, line(6), line(4)])
    rows = [(k, around(p)) for k, p in enumerate(passages)] + [(100 + k, around(p)) for k, p in enumerate(passages)]
    short = [line(20), line(9)]
    rows += [(200, "\n".join([line(60), *short, line(60)])), (300, None), (None, around(passages[0])), (301, "\n".join([line(30)] * 5)), (302, rows[0][1]), (302, rows[0][1])]
    d = make(spark, rows)
    got = defaultdict(list)
    for r in line_dedup.dedup_lines(d, passages=True).collect():
        got[r.doc_id].append((r.text, r.removed_lines))
    text = dict(rows)
    for k, p in enumerate(passages):
        own = text[100 + k].split("\n")
        assert got[100 + k] == [("\n".join(own[:2] + own[-2:]), len(p))]
        assert k == 0 or got[k] == [(text[k], 0)]  # the first place stays
    assert got[None] == [(text[None], 0)] and got[0][0][1] == 2 and got[200] == [(text[200], 0)] and got[300] == [(None, 0)]
    assert len(set(text[301].split("\n"))) == 1 and got[301][0][0] == "\n".join(text[301].split("\n")[:2])
    assert [n for _, n in got[302]] == [6, 6]  # equal rows stay alike
    assert line_dedup.dedup_lines(nothing, passages=True).count() == 0
    # all that chunks alone remove is removed too
    chunks = {(r.doc_id, r.text): r.removed_lines for r in line_dedup.dedup_lines(d).collect()}
    assert sum(n for v in got.values() for _, n in v) > sum(chunks.values())


def test_pseudonyms(spark, docs, nothing):
    long = "w " * 200_000 + "1.2.3.4"
    rows = [(1, "call +1 (017) 555-7713"), (2, "again +1 (017) 555-7713 and 1.2.3.4"), (2, "again +1 (017) 555-7713 and 1.2.3.4"), (3, None), (4, ""), (None, long), (2, "no value")]
    d = make(spark, rows)
    got = pii.pseudonymise_texts(d, "secret").collect()
    assert sorted((str(r.doc_id), r.text, r.n_replaced) for r in got if r.text) == sorted((str(i), *pii.pseudonymise(t, b"secret")) for i, t in rows if t)
    by = {r.doc_id: r for r in got if r.doc_id != 2}
    assert by[3].text is None and by[4].text == "" and by[None].n_replaced == 1 and len(by[None].text) == len(long)
    assert by[1].text != "call +1 (017) 555-7713" and len(got) == len(rows) and pii.pseudonymise_texts(nothing, "s").count() == 0
    clash = spark.createDataFrame([(1, "1.2.3.4", 5, "t")], "doc_id long, text string, n_replaced int, id string")
    assert [(r.doc_id, r.n_replaced) for r in pii.pseudonymise_texts(clash, "s").collect()] == [(1, 1)]
    assert sorted(str(r.doc_id) for r in pii.pseudonymise_texts(docs, "s").collect()) == sorted(str(i) for i, _ in ROWS)
