"""The registered queries of this subpackage and their SQL equivalents."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE: dict = {}


def query(name: str, sql: str | None = None):
    def put(f):
        QUERIES[name] = f
        if sql:
            ORACLE[name] = sql
        return f

    return put


@query(
    "op7_exact_dedup",
    """
    WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents)
    SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
           doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
    FROM d
    """,
)
def op7_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.exact_dedup import exact_dedup

    return exact_dedup(spark, f"{sf_dir}/documents.parquet")


@query("op6_token_counts")
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.token_counts import count_tokens

    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model")


@query("op10_packing")
def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.packing import pack

    return pack(spark.read.parquet(f"{sf_dir}/documents.parquet"), "word_bpe_49k.json")


@query(
    "op2_warc",
    """
    WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
    q AS (SELECT page_id, strlen(h) AS n, sha1(h) AS s, max(page_id) OVER (PARTITION BY h) AS m FROM p)
    SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
           array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
             CAST((CAST('0x' || substr(s, CAST(1 + 10 * (i // 8) AS INTEGER), 10) AS BIGINT) >> (35 - 5 * (i % 8))) & 31 AS INTEGER) + 1, 1)), '') AS payload_digest,
           CASE WHEN page_id = m THEN 'response' ELSE 'revisit' END AS record_type,
           CASE WHEN page_id = m THEN NULL ELSE m END AS refers_to
    FROM q
    """,
)
def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.warc import archive_and_read

    return archive_and_read(spark.read.parquet(f"{sf_dir}/pages.parquet"))


@query("op5_langid")
def op5_langid(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from recengine.llm.langid import fit, held_out, predict

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(~held_out("doc_id", 4, 2)))
    return predict(docs, model).select("doc_id", held_out("doc_id", 4, 2).alias("held_out"), "lang_pred", F.col("score"), "bits_per_byte")


@query("op9_quality")
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from recengine.llm.langid import held_out
    from recengine.llm.quality import fit, score

    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = fit(docs, labels.where(~held_out("doc_id", 3, 1)))
    scored = score(docs.select("doc_id", "text"), model)
    return scored.select("doc_id", held_out("doc_id", 3, 1).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


@query(
    "op8_ngram_jaccard",
    r"""
    WITH RECURSIVE w AS (
      SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws
      FROM documents),
    s AS (
      SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
        ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS g FROM w),
    n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
    p AS (SELECT a.doc_id AS u, b.doc_id AS v, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
    l AS (SELECT u, v FROM p JOIN n x ON x.doc_id = u JOIN n y ON y.doc_id = v WHERE 100 * c >= 85 * (x.n + y.n - c)),
    r AS (SELECT doc_id AS d, doc_id AS m FROM documents UNION SELECT r.d, l.v FROM r JOIN l ON l.u = r.m),
    k AS (SELECT d, min(m) AS m FROM r GROUP BY d)
    SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, k.m AS component_id
    FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN k ON k.d = w.doc_id
    """,
)
def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.ngram_join import jaccard_components

    return jaccard_components(spark.read.parquet(f"{sf_dir}/documents.parquet"), size=4, percent=85)


@query("op4_decontamination")
def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.decontam import find_leaks

    return find_leaks(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


@query(
    "op1_line_dedup",
    """
    WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS l, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
    m AS (SELECT *, CAST('0x' || substr(md5(l), 1, 8) AS BIGINT) AS h FROM l),
    r AS (SELECT *, (lag(h, 1, 0) OVER (PARTITION BY doc_id ORDER BY i) * 1000003 + h) % 2147483647 AS roll FROM m),
    b AS (SELECT *, CASE WHEN i = 1 OR lag(roll) OVER (PARTITION BY doc_id ORDER BY i) % 4 = 0 THEN 1 ELSE 0 END AS s FROM r),
    c AS (SELECT *, sum(s) OVER (PARTITION BY doc_id ORDER BY i) AS chunk FROM b),
    g AS (SELECT doc_id, chunk, count(*) AS n, string_agg(l, chr(10) ORDER BY i) AS body FROM c GROUP BY 1, 2),
    e AS (SELECT *, n > 1 AND trim(replace(body, chr(10), '')) <> '' AS able FROM g),
    f AS (SELECT *, able AND row_number() OVER (PARTITION BY able, body ORDER BY doc_id, chunk) > 1 AS gone FROM e)
    SELECT doc_id, coalesce(string_agg(body, chr(10) ORDER BY chunk) FILTER (NOT gone), '') AS text,
           CAST(count(*) FILTER (gone) AS BIGINT) AS removed_chunks, CAST(coalesce(sum(n) FILTER (gone), 0) AS BIGINT) AS removed_lines
    FROM f GROUP BY doc_id
    """,
)
def op1_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.line_dedup import dedup_lines

    return dedup_lines(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


@query("op3_pseudonyms")
def op3_pseudonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.pii import pseudonymise_texts

    return pseudonymise_texts(spark.read.parquet(f"{sf_dir}/documents.parquet"), key="key of this query, not a secret")


@query("op12_piece_codec")
def op12_piece_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.piece_codec import round_trip

    return round_trip(spark.read.parquet(f"{sf_dir}/documents.parquet"), "piece_bpe_32k.model")


@query(
    "op13_hard_negatives",
    """
    WITH v AS (
      SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS e
      FROM embeddings
      WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
    s AS (
      SELECT a.vec_id AS anchor_id, b.vec_id AS other, a.label = b.label AS same, CAST(list_sum(list_transform(list_zip(a.e, b.e), lambda t: t[1] * t[2])) AS BIGINT) AS score
      FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0),
    p AS (SELECT anchor_id, other AS positive_id, score AS positive_score FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other) <= 5),
    n AS (
      SELECT p.*, s.other AS negative_id, s.score AS negative_score, row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY s.score DESC, s.other) AS rank
      FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT s.same AND 30 * positive_score <= 100 * s.score AND 100 * s.score <= 90 * positive_score)
    SELECT anchor_id, positive_id, CAST(rank AS INTEGER) AS rank, negative_id, positive_score, negative_score FROM n WHERE rank <= 10
    """,
)
def op13_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import functions as F

    from recengine.llm.hard_negatives import mine

    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return mine(rows, rows.where(F.col("vec_id") % 100 == 0))


@query(
    "op11_collocations",
    r"""
    WITH p AS (
      SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece
      FROM documents),
    w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
    g AS (SELECT lang, k, unnest(list_transform(range(1, len(ws) - k + 2), lambda i: array_to_string(ws[i:i + k - 1], ' '))) AS phrase FROM w, (VALUES (1), (2), (3)) AS t(k) WHERE len(ws) >= k),
    f AS (SELECT lang, k, phrase, count(*) AS f FROM g GROUP BY ALL),
    n AS (SELECT lang, sum(f) AS n FROM f WHERE k = 1 GROUP BY lang),
    c AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS ws FROM f WHERE k > 1 AND f >= 10),
    m AS MATERIALIZED (SELECT concat(lang, ' ', phrase) AS name, f FROM f WHERE f >= 10),
    t AS MATERIALIZED (
      SELECT c.*, cut, concat(lang, ' ', array_to_string(ws[1:cut], ' ')) AS first, concat(lang, ' ', array_to_string(ws[cut + 1:], ' ')) AS rest
      FROM c JOIN (VALUES (1), (2)) AS v(cut) ON cut < k),
    u AS MATERIALIZED (
      SELECT t.lang, t.phrase, t.k, t.a, t.cut, x.f AS l, y.f AS r, (CAST(1000000 AS HUGEINT) * t.a * t.a) // (CAST(x.f AS HUGEINT) * y.f) AS score
      FROM t JOIN m x ON x.name = t.first JOIN m y ON y.name = t.rest
      QUALIFY row_number() OVER (PARTITION BY t.lang, t.phrase ORDER BY score, t.cut) = 1),
    e AS MATERIALIZED (SELECT lang, unnest([array_to_string(ws[1:2], ' '), array_to_string(ws[2:3], ' ')]) AS phrase, a FROM c WHERE k = 3),
    d AS (SELECT DISTINCT u.lang, u.phrase FROM u JOIN e ON e.lang = u.lang AND e.phrase = u.phrase AND 100 * e.a >= 50 * u.a WHERE u.k = 2),
    z AS (
      SELECT u.lang, row_number() OVER (PARTITION BY u.lang ORDER BY u.score DESC, u.a DESC, encode(u.phrase)) AS rank, u.phrase, u.a, u.l, u.r, n.n, u.score, u.cut
      FROM u JOIN n ON n.lang = u.lang ANTI JOIN d ON d.lang = u.lang AND d.phrase = u.phrase)
    SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score, CAST(cut AS INTEGER) AS cut
    FROM z WHERE rank <= 2000
    """,
)
def op11_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    from recengine.llm.collocations import collocations

    return collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))
