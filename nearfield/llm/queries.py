"""The opN_ queries: each applies one operator to its whole table and derives the result columns."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nearfield.llm import alignment, bpe, embedding_dedup, hard_negatives, html_text, langid, licenses, minhash, mixing, quality, suffix_dedup, topk, warc
from nearfield.runtime import table, work_path


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    model = langid.train(docs.where(~F.coalesce(held_out, F.lit(False))))
    return langid.predict(docs.select("doc_id", "text"), model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def _tokenizer() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path, pattern = _tokenizer()
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    ids = bpe.encode(docs, path, pattern).select("doc_id", "n_tokens", "ids")
    return bpe.decode(ids, path).select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op1_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), width=3, percent=85)


def op2_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(table(spark, sf_dir, "documents"), weights=[5, 2, 1], percent=150)


def op3_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = work_path(spark, "warc")
    warc.write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return warc.read(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op7_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(table(spark, sf_dir, "documents")).withColumn("score", F.round("score", 6))


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return topk.top_k(vectors, vectors.where("vec_id % 100 = 0"), 10)


def op10_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return html_text.extract(pages).select("page_id", "url", "text", "n_chars")


def op11_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = alignment.align(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model"))
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256))
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", digest.alias("groups_sha256"))


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding", "label")
    rows = rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))
    return hard_negatives.mine(rows, F.col("vec_id") % 100 == 0, positives=5, negatives=10, low=30, high=90, scale=256)


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    model = quality.train(docs, table(spark, sf_dir, "labels").where(~held_out))
    score = F.col("score")
    return quality.predict(docs, model).select("doc_id", held_out.alias("held_out"), "score", (score >= 0.3).cast("int").alias("predicted"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_minhash_dedup": op1_minhash_dedup,
    "op2_source_mixing": op2_source_mixing,
    "op3_embedding_dedup": op3_embedding_dedup,
    "op4_language_id": op4_language_id,
    "op5_byte_bpe": op5_byte_bpe,
    "op6_warc": op6_warc,
    "op7_license_scan": op7_license_scan,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_topk_search": op9_topk_search,
    "op10_html_extraction": op10_html_extraction,
    "op11_token_alignment": op11_token_alignment,
    "op12_hard_negatives": op12_hard_negatives,
    "op13_quality": op13_quality,
}

WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"

OP1_SQL = f"""
WITH RECURSIVE w AS (SELECT doc_id, {WORDS} AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN w IS NULL OR len(w) = 0 THEN [] WHEN len(w) < 3 THEN [w] ELSE list_distinct(list_transform(range(1, len(w) - 1), lambda i: [w[i], w[i + 1], w[i + 2]])) END AS s FROM w),
n AS (SELECT doc_id, len(s)::BIGINT AS n FROM s),
e AS (SELECT doc_id, unnest(s) AS x FROM s),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM common JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS id, doc_id AS r FROM n UNION SELECT reach.id, b FROM reach JOIN both_ways ON r = a)
SELECT doc_id, n AS n_shingles, c AS component_id, doc_id = c AS kept FROM n JOIN (SELECT id, min(r) AS c FROM reach GROUP BY id) ON id = doc_id
"""

OP2_SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size, md5(doc_id::VARCHAR) AS h FROM documents),
t AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
p AS (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS place, 2 * source_size AS most FROM t),
w AS (SELECT *, [5, 2, 1][(place - 1) % 3 + 1] AS weight FROM p),
f AS (SELECT *, sum(most) OVER o AS filled, sum(weight) OVER o AS weights, (SELECT sum(weight) FROM w) AS total, 1.5 * (SELECT sum(source_size) FROM t) AS budget FROM w WINDOW o AS (ORDER BY most::DOUBLE / weight, place)),
u AS (SELECT (budget - (filled - most)) / (total - (weights - weight)) AS until FROM f WHERE filled + most::DOUBLE / weight * (total - weights) >= budget ORDER BY most::DOUBLE / weight, place LIMIT 1),
q AS (SELECT d.*, w.source_size, w.weight, w.place, sum(d.size) OVER (PARTITION BY d.source ORDER BY h, doc_id) AS upto FROM d JOIN w ON d.source IS NOT DISTINCT FROM w.source),
c AS (SELECT *, (upto + copy * source_size)::DOUBLE / weight AS finish FROM q, (VALUES (0), (1)) v(copy) WHERE size > 0),
r AS (SELECT doc_id, size, sum(size) OVER (ORDER BY finish, place, h, doc_id, copy) AS total FROM c),
k AS (SELECT doc_id, sum(size)::BIGINT AS taken FROM r WHERE total <= (SELECT budget FROM f LIMIT 1) GROUP BY doc_id)
SELECT q.doc_id, size, source_size, least(2 * source_size, until * weight)::DOUBLE AS target, coalesce(taken, 0)::BIGINT AS taken FROM q, u LEFT JOIN k ON k.doc_id = q.doc_id
"""

_COSINE = "list_sum(list_transform(list_zip(x.v, y.v), lambda p: p[1] * p[2])) / (x.n * y.n)"
OP3_SQL = f"""
WITH RECURSIVE v AS (SELECT vec_id, label, list_transform(embedding, lambda c: c::DOUBLE) AS v FROM embeddings),
u AS (SELECT *, sqrt(list_sum(list_transform(v, lambda c: c * c))) AS n FROM v WHERE label IS NOT NULL AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM u x JOIN u y ON x.label = y.label AND x.vec_id <> y.vec_id AND x.n > 0 AND y.n > 0 AND len(x.v) = len(y.v) WHERE {_COSINE} >= 0.98),
reach AS (SELECT vec_id AS id, vec_id AS r FROM v UNION SELECT reach.id, b FROM reach JOIN links ON r = a)
SELECT vec_id, coalesce(k, 0)::BIGINT AS n_links, c AS component_id, vec_id = c AS kept FROM v JOIN (SELECT id, min(r) AS c FROM reach GROUP BY id) ON id = vec_id LEFT JOIN (SELECT a, count(*) AS k FROM links GROUP BY a) ON a = vec_id
"""

OP6_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
h AS (SELECT *, sha1(html) AS hex FROM p),
b AS (SELECT *, array_to_string(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(hex, i, 1)) - 1), 4, '0')), '') AS bits FROM h),
d AS (SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + list_sum(list_transform(range(0, 5), lambda j: substr(bits, 5 * i + j + 1, 1)::INT * (1 << (4 - j))))::INT, 1)), '') AS payload_digest, max(page_id) OVER (PARTITION BY html) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to FROM d
"""

OP8_SQL = """
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT doc_id, i, substr(h, 2 * i + 1, 100) AS s FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 49)) AS i FROM t WHERE len(h) >= 100)),
g AS (SELECT doc_id, i FROM (SELECT doc_id, i, min(doc_id) OVER (PARTITION BY s) AS least FROM w) WHERE least < doc_id),
m AS (SELECT *, coalesce(i > lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 50, true) AS fresh FROM g),
r AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM (SELECT *, sum(fresh::INT) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM m) GROUP BY doc_id, run),
k AS (SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM (SELECT doc_id, a, b FROM r UNION ALL SELECT doc_id, -1, 0 FROM t)),
j AS (SELECT doc_id, string_agg(substr(h, 2 * a + 1, coalesce(2 * (b - a), len(h))), '' ORDER BY a) AS kept FROM k JOIN t USING (doc_id) GROUP BY doc_id),
n AS (SELECT doc_id, sum(b - a) AS removed, count(*) AS spans FROM r GROUP BY doc_id)
SELECT t.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(removed, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(kept)) AS kept_sha256 FROM t JOIN j USING (doc_id) LEFT JOIN n USING (doc_id)
"""

OP9_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda c: floor(1024 * c::DOUBLE)::HUGEINT) AS v FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT DISTINCT vec_id, v FROM v WHERE vec_id % 100 = 0),
s AS (SELECT q.vec_id AS query_id, q.v AS asked, c.vec_id, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS score FROM q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v))
SELECT query_id, rank::INT AS rank, vec_id, score::BIGINT AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id, asked ORDER BY score DESC, vec_id) AS rank FROM s) WHERE rank <= 10
"""

OP12_SQL = """
WITH v AS (SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda c: floor(256 * c::DOUBLE)::HUGEINT) AS v FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0),
q AS (SELECT *, row_number() OVER () AS tag FROM (SELECT DISTINCT * FROM v WHERE id % 100 = 0)),
s AS (SELECT q.tag, q.id AS anchor_id, c.id, q.label = c.label AS same, list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2]))::BIGINT AS score FROM q JOIN v c ON q.id <> c.id AND len(q.v) = len(c.v)),
p AS (SELECT *, row_number() OVER (PARTITION BY tag ORDER BY score DESC, id) AS slot FROM s WHERE same QUALIFY slot <= 5),
n AS (SELECT p.tag, p.slot, p.anchor_id, p.id AS positive_id, p.score AS positive_score, s.id AS negative_id, s.score AS negative_score FROM p JOIN s ON s.tag = p.tag AND NOT s.same AND 30 * p.score <= 100 * s.score AND 100 * s.score <= 90 * p.score)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY tag, slot ORDER BY negative_score DESC, negative_id)::INT AS rank, negative_id, positive_score, negative_score FROM n QUALIFY rank <= 10
"""

#: Language ID, tokens and HTML blocks have no SQL: tests hold them against plain versions.
ORACLE_SQL: dict[str, str] = {
    "op1_minhash_dedup": OP1_SQL,
    "op2_source_mixing": OP2_SQL,
    "op3_embedding_dedup": OP3_SQL,
    "op6_warc": OP6_SQL,
    "op7_license_scan": licenses.oracle_sql(),
    "op8_suffix_dedup": OP8_SQL,
    "op9_topk_search": OP9_SQL,
    "op12_hard_negatives": OP12_SQL,
}
