"""De-duplication of content-defined chunks of lines.

A rolling hash over the hashes of the last two lines decides after which lines a
chunk ends. Where a chunk ends depends on the lines around that place alone, so a
passage that was moved is cut as before but for its edges. Chunks of several lines
that occur more than once in the corpus are removed but for their first occurrence;
before, their bytes are compared with those of the first. Chunks of blank lines
only are layout and stay.

The boundaries of chunks are sparse, so a passage of a few lines may hold no chunk.
With ``passages`` every run of whole lines of over ``PASSAGE_WORDS`` words that
stood before is removed too. At each line the shortest run of so many words that
begins there, and the one that ends there, is a window; a passage that is long
enough is covered by the windows within it, wherever it stands, so equal windows
are found by an aggregation and no passages need to be aligned.

Everything is a DataFrame expression; no Python runs in the tasks. Bodies of
chunks and texts are only shuffled where a bitmap says that the
chunk is repeated or the text loses lines; the bitmap grows with the number of
its keys up to a bound.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recengine.llm._bitmap import Bitmap
from recengine.llm._scratch import materialize

#: A chunk ends where the rolling hash is divisible by this, so chunks have about as many lines.
DIVISOR = 4
#: A passage of over so many words is removed where it stood before; a line counts as one word at least.
PASSAGE_WORDS = 50
_BASE, _MODULUS = 1_000_003, 2_147_483_647
_LOW = (1 << 32) - 1


def _let(value: Column, f) -> Column:
    """f(value) with the value computed once for a row, however often f uses it."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def _chunks(text: Column, begins: bool = False) -> Column:
    """The lines of each chunk of a text, in order; or the places of their first lines."""
    line_hash = lambda x: F.conv(F.substring(F.md5(x), 1, 8), 16, 10).cast("long")

    def of_lines(lines: Column) -> Column:
        return _let(F.transform(lines, line_hash), lambda h: _let(starts_of(h), lambda starts: cut(lines, starts)))

    def starts_of(h: Column) -> Column:
        at = lambda i: F.get(h, i)
        rolled = lambda i: (F.coalesce(at(i - 1), F.lit(0)) * _BASE + at(i)) % _MODULUS
        return F.filter(F.sequence(F.lit(0), F.size(h) - 1), lambda i: (i == 0) | (rolled(i - 1) % DIVISOR == 0))

    def cut(lines: Column, starts: Column) -> Column:
        if begins:
            return starts
        return F.transform(starts, lambda s, k: F.slice(lines, s + 1, F.coalesce(F.get(starts, k + 1), F.size(lines)) - s))

    return _let(_lines(text), of_lines)


def _windows(text: Column) -> Column:
    """start, hashes of the lines of each shortest run of over PASSAGE_WORDS words that begins or ends at a line."""
    words = lambda x: (F.length(x) - F.length(F.replace(x, F.lit(" "))) + 1).cast("long")
    # words in the low half, lines in the high half; nothing is added once the words are enough
    total, lines_of = lambda acc: acc.bitwiseAND(F.lit(_LOW)), lambda acc: F.shiftright(acc, 32).cast("int")
    run = lambda part: F.aggregate(part, F.lit(0).cast("long"), lambda acc, x: F.when(total(acc) <= PASSAGE_WORDS, acc + x + F.lit(_LOW + 1)).otherwise(acc))
    most = PASSAGE_WORDS + 1

    def spans(w: Column) -> Column:
        ahead = lambda i, n: F.slice(w, i + 1, F.lit(n))
        behind = lambda i, n: F.reverse(F.slice(w, F.greatest(i - n + 1, F.lit(0)) + 1, F.least(i + 1, F.lit(n))))

        def span(i: Column, part, start) -> Column:
            found = lambda acc: F.when(total(acc) > PASSAGE_WORDS, F.shiftleft(start(lines_of(acc)).cast("long"), 32) + lines_of(acc)).otherwise(F.lit(0).cast("long"))
            return _let(run(part(i, 8)), lambda few: _let(F.when(total(few) > PASSAGE_WORDS, few).otherwise(run(part(i, most))), found))

        begins = F.transform(w, lambda _, i: span(i, ahead, lambda n: i))
        ends = F.transform(w, lambda _, i: span(i, behind, lambda n: i - n + 1))
        # longs (start, lines) are united by a hash set
        return F.filter(F.array_union(begins, ends), lambda x: x > 0)

    def of_lines(lines: Column) -> Column:
        cut = lambda h, found: F.transform(found, lambda x: F.struct(lines_of(x).alias("start"), F.slice(h, lines_of(x) + 1, total(x).cast("int")).alias("hashes")))
        return _let(F.transform(lines, words), lambda w: _let(spans(w), lambda found: _let(F.transform(lines, lambda x: F.xxhash64(x)), lambda h: cut(h, found))))

    return _let(_lines(text), of_lines)


def _passages(source: DataFrame) -> DataFrame:
    """_ld_key, _ld_place: the lines, not yet distinct, of windows that stood before, from (_ld_id, _ld_key, _ld_text).

    A window stays at its first place by (id, place), and where it overlaps that
    place. Windows are equal if the hashes of all their lines are; a line whose hash
    stands for several texts is not removed.
    """
    windows = source.select("_ld_id", "_ld_key", F.explode(_windows(F.col("_ld_text"))).alias("_ld_w")).select("_ld_id", "_ld_key", F.col("_ld_w")["start"].alias("_ld_place"), F.col("_ld_w")["hashes"].alias("_ld_hashes"))
    windows = windows.withColumn("_ld_h", F.xxhash64("_ld_hashes"))
    several = materialize(windows.groupBy("_ld_h").agg(F.count(F.lit(1)).alias("_ld_n")).where("_ld_n > 1").select("_ld_h"), "repeated-windows")
    near = Bitmap(several, "_ld_h", "window-bitmap").near(windows, F.col("_ld_h"))
    near = materialize(near.join(several, "_ld_h", "left_semi").select("_ld_id", "_ld_key", "_ld_place", "_ld_hashes"), "windows")

    where = F.struct("_ld_id", "_ld_key", "_ld_place")
    found = near.groupBy("_ld_hashes").agg(F.min(where).alias("_ld_first"), F.max(where).alias("_ld_last")).where("_ld_first <> _ld_last").select("_ld_hashes", "_ld_first")
    first = F.col("_ld_first")
    clear = (F.col("_ld_key") != first["_ld_key"]) | (F.col("_ld_place") >= first["_ld_place"] + F.size("_ld_hashes"))
    gone = near.join(found, "_ld_hashes").where(clear).select("_ld_key", F.posexplode("_ld_hashes").alias("_ld_k", "_ld_h"), "_ld_place")
    gone = materialize(gone.select("_ld_key", (F.col("_ld_place") + F.col("_ld_k")).alias("_ld_place"), "_ld_h").distinct(), "passage-lines")

    # the bytes of all lines that have the hash of a removed one
    hashes = materialize(gone.select("_ld_h").distinct(), "line-hashes")
    lines = source.select(F.explode(_lines(F.col("_ld_text"))).alias("_ld_line")).withColumn("_ld_h", F.xxhash64("_ld_line"))
    lines = Bitmap(hashes, "_ld_h", "line-bitmap").near(lines, F.col("_ld_h"))
    mixed = lines.groupBy("_ld_h").agg(F.min("_ld_line").alias("_ld_a"), F.max("_ld_line").alias("_ld_b")).where("_ld_a <> _ld_b").select("_ld_h")
    return gone.join(materialize(mixed, "mixed-hashes"), "_ld_h", "left_anti").select("_ld_key", "_ld_place")


def dedup_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", passages: bool = False, least_words: int = 1) -> DataFrame:
    """``docs`` with the later occurrences of repeated chunks taken out of ``text_col``, and removed_chunks, removed_lines.

    The first occurrence by (id, place in the text) stays; null ids are the
    smallest. All rows and all other columns stay as they are; a text whose
    chunks all occurred before becomes empty. A null text stays null. Rows that
    repeat an id and a text count as one document and stay alike. Existing columns
    named removed_chunks or removed_lines are replaced.

    Only chunks of at least ``least_words`` words (as many as blanks and line ends, and
    one more) are removed; by default all of several lines that aren't all blank.

    With ``passages``, also the later occurrences of all runs of whole lines of over
    PASSAGE_WORDS words; removed_chunks then counts the runs of removed lines.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    key = F.unhex(F.sha2(F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("\x01")), F.lit("\x00"), text), 256))
    kept_columns = [c for c in docs.columns if c not in ("removed_chunks", "removed_lines")]
    keyed = docs.select(*kept_columns, key.alias("_ld_key"))

    body = lambda c: F.array_join(c, "\n")
    words = lambda c: F.length(c) - F.length(F.replace(F.replace(c, F.lit(" ")), F.lit("\n"))) + 1
    source = keyed.select(F.col(id_col).alias("_ld_id"), "_ld_key", F.col(text_col).alias("_ld_text"))
    exploded = source.select("_ld_id", "_ld_key", F.posexplode(_chunks(F.col("_ld_text"))).alias("_ld_place", "_ld_chunk"))
    bodies = exploded.select("_ld_id", "_ld_key", "_ld_place", F.size("_ld_chunk").alias("_ld_n"), body(F.col("_ld_chunk")).alias("_ld_body"))
    able = (F.col("_ld_n") > 1) & (words(F.col("_ld_body")) >= least_words) & F.col("_ld_body").rlike("[^ \n]")
    bodies = bodies.where(able).withColumn("_ld_digest", F.unhex(F.sha2("_ld_body", 256)))

    # the repeated chunks and where they occur first; rows that repeat a document count once
    where = F.struct("_ld_id", "_ld_key", "_ld_place")
    found = bodies.groupBy("_ld_digest").agg(F.min(where).alias("_ld_first"), F.max(where).alias("_ld_last"))
    repeated = materialize(found.where("_ld_first <> _ld_last").select("_ld_digest", "_ld_first"), "repeated-chunks")

    # their bodies, each compared with the first
    likely = Bitmap(repeated, "_ld_digest", "chunk-bitmap").near(bodies, F.col("_ld_digest"))
    likely = likely.join(repeated, "_ld_digest").select("_ld_digest", "_ld_key", "_ld_place", "_ld_n", "_ld_body", (where == F.col("_ld_first")).alias("_ld_is_first"))
    likely = materialize(likely, "chunk-bodies")
    firsts = likely.where("_ld_is_first").select("_ld_digest", F.col("_ld_body").alias("_ld_first_body")).dropDuplicates(["_ld_digest"])
    gone = likely.where("not _ld_is_first").join(firsts, "_ld_digest").where("_ld_body = _ld_first_body")
    gone = materialize(gone.select("_ld_key", "_ld_place", "_ld_n").distinct(), "removed-chunks")

    if passages:
        # where the removed chunks begin and end, as lines
        near = Bitmap(gone, "_ld_key", "chunk-text-bitmap").near(source, F.col("_ld_key"))
        begin = near.select("_ld_key", F.posexplode(_chunks(F.col("_ld_text"), begins=True)).alias("_ld_place", "_ld_begin")).distinct()
        of_chunks = gone.join(begin, ["_ld_key", "_ld_place"]).select("_ld_key", F.explode(F.sequence("_ld_begin", F.col("_ld_begin") + F.col("_ld_n") - 1)).alias("_ld_place"))
        gone = materialize(of_chunks.unionByName(_passages(source)).distinct().withColumn("_ld_n", F.lit(1)), "removed-lines")

    # only texts that lose lines are shuffled
    split = Bitmap(gone, "_ld_key", "text-bitmap").mark(keyed, F.col("_ld_key"), "_ld_near")
    lost = gone.groupBy("_ld_key").agg(F.collect_list("_ld_place").alias("_ld_places"), F.sum("_ld_n").alias("_ld_lost"))
    changed = split.where("_ld_near").join(lost, "_ld_key", "left")
    left = lambda parts: F.transform(F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), F.col("_ld_places")), lambda k: F.get(parts, k))
    if passages:
        rest = F.array_join(_let(_lines(F.col(text_col)), left), "\n")
        runs = F.size(F.array_except("_ld_places", F.transform("_ld_places", lambda k: k + 1)))
    else:
        rest = F.array_join(F.flatten(_let(_chunks(F.col(text_col)), left)), "\n")
        runs = F.size("_ld_places")
    outputs = [F.when(F.col("_ld_places").isNotNull(), rest).otherwise(F.col(c)).alias(c) if c == text_col else F.col(c) for c in kept_columns]
    changed = changed.select(*outputs, F.coalesce(runs, F.lit(0)).cast("long").alias("removed_chunks"), F.coalesce("_ld_lost", F.lit(0)).cast("long").alias("removed_lines"))
    changed = changed.withColumn("removed_chunks", F.greatest("removed_chunks", F.lit(0).cast("long")))
    same = split.where("not _ld_near").select(*kept_columns, F.lit(0).cast("long").alias("removed_chunks"), F.lit(0).cast("long").alias("removed_lines"))
    return changed.unionByName(same)
