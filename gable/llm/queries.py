"""The registered queries of the corpus operators, over their whole tables, and SQL for those that it can express."""

from __future__ import annotations

import zlib

import numpy as np
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gable.llm import periodic_runs
from gable.llm.byte_bpe import digests
from gable.llm.centroids import clustered
from gable.llm.common import written
from gable.llm.embedding_dedup import near_vectors
from gable.llm.exact_dedup import exact_groups
from gable.llm.fingerprints import edited_fingerprints
from gable.llm.language_id import identified
from gable.llm.ngram_join import near_copies
from gable.llm.packing import packed
from gable.llm.paragraph_dedup import repeated_passages
from gable.llm.quotation import as_mail, chat_lines, linked
from gable.llm.token_counts import counted
from gable.llm.warc_fixity import audited, index_of, measured, placed, record_bytes


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors; see near_vectors for null, zero, odd and repeated ones."""
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op2_quotation_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations written as mails that quote the two messages before, and taken apart again."""
    return chat_lines(linked(as_mail(table(spark, sf_dir, "conversations"))))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text counts as empty, see counted."""
    return counted(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text is its closing id alone, see packed."""
    return packed(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null and short texts hold no passage, see repeated_passages for null and repeated ids."""
    return repeated_passages(table(spark, sf_dir, "documents"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text counts as empty, see exact_groups for null and repeated ids."""
    return exact_groups(table(spark, sf_dir, "documents"))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null or empty text has no ids, see encoded."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def op8_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as WARC records against a replica in which some records are altered, cut short or lost."""
    records = table(spark, sf_dir, "pages").select("page_id", record_bytes(F.col("url"), F.col("page_id"), F.col("html")).alias("record"))
    size = F.octet_length("record")
    flipped = F.concat(F.substring("record", 1, size - 5), F.lit("~").cast("binary"), F.substring("record", size - 3, F.lit(4)))
    copy = F.when(F.col("page_id") % 97 == 13, flipped).when(F.col("page_id") % 211 == 5, F.substring("record", 1, size - 7)).otherwise(F.col("record"))
    held = F.coalesce(F.col("page_id") % 307 != 11, F.lit(True))
    rows = written(placed(records.select("page_id", measured(F.col("record")).alias("first"), F.when(held, measured(copy)).alias("copy")), ["copy"]))
    return audited(index_of(rows, "first"), index_of(rows, "copy"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a text that is null or has no letter is `und`, see identified for null ids and labels."""
    return identified(table(spark, sf_dir, "documents"))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; null texts and those without a word link with nothing, see near_copies for null and repeated ids."""
    return near_copies(table(spark, sf_dir, "documents"))


def repeating(doc_id: int | None, n: int) -> np.ndarray | None:
    """Which word stands at each place: in a tenth of the documents, by a checksum of the id, a stretch repeats up to the end. A null id leaves words as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    i = np.arange(n)
    return np.where(i < a, i, a + (i - a) % (1 + (n - a) // (3 + g % 8)))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text has no words, see periodic_runs."""
    return periodic_runs.digests(periodic_runs.periodic_runs(table(spark, sf_dir, "documents"), order=repeating))


def op12_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents; a null text counts as empty, see edited_fingerprints."""
    return edited_fingerprints(table(spark, sf_dir, "documents"))


def op13_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All vectors of 64 finite components; see clustered."""
    out = clustered(table(spark, sf_dir, "embeddings"))
    digest = F.sha2(F.array_join(F.col("centroid").cast("array<string>"), ","), 256)
    return out.select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", digest.alias("centroid_sha256"))


QUERIES = {
    "op1_embedding_dedup": op1_embedding_dedup,
    "op2_quotation_linking": op2_quotation_linking,
    "op3_token_counts": op3_token_counts,
    "op4_packing": op4_packing,
    "op5_paragraph_dedup": op5_paragraph_dedup,
    "op6_exact_dedup": op6_exact_dedup,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_merkle_fixity": op8_merkle_fixity,
    "op9_language_id": op9_language_id,
    "op10_ngram_join": op10_ngram_join,
    "op11_periodic_runs": op11_periodic_runs,
    "op12_fingerprints": op12_fingerprints,
    "op13_centroids": op13_centroids,
}

_NEAREST = "SELECT vec_id, any_value(e) AS e, arg_min(k, (d, k)) AS k, min(d) AS d FROM (SELECT v.vec_id, v.e, c.k, list_sum(list_transform(list_zip(v.e, c.e), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS d FROM v, c{i} c) GROUP BY vec_id"
_MEANS = """SELECT c.k, coalesce(m.e, c.e) AS e FROM c{i} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS e FROM (
  SELECT k, i, CAST((sum(x) - (sum(x) % count(*) + count(*)) % count(*)) // count(*) AS BIGINT) AS x FROM (SELECT k, unnest(e) AS x, unnest(range(64)) AS i FROM a{i}) GROUP BY k, i) GROUP BY k) m USING (k)"""
_LLOYD = f"""
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, e FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16),
{", ".join(f"a{i} AS MATERIALIZED ({_NEAREST.format(i=i)}), c{i + 1} AS MATERIALIZED ({_MEANS.format(i=i)})" for i in range(3))},
a3 AS MATERIALIZED ({_NEAREST.format(i=3)})
SELECT vec_id, CAST(a.k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY a.k) AS BIGINT) AS cluster_inertia,
  CAST(sum(d) OVER () AS BIGINT) AS inertia, sha256(array_to_string(c.e, ',')) AS centroid_sha256
FROM a3 a JOIN c3 c ON a.k = c.k"""

ORACLES = {
    "op1_embedding_dedup": """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b
  ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach(id, r) AS (SELECT vec_id, vec_id FROM embeddings UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT id, min(r) AS k FROM reach GROUP BY id),
n AS (SELECT a, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0) AS n_links, c.k AS component_id, c.k = e.vec_id AS kept
FROM embeddings e JOIN c ON c.id = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op2_quotation_linking": r"""
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
b AS (SELECT conv_id, turn, min(text) AS text FROM m GROUP BY 1, 2),
j AS (SELECT m.*, regexp_matches(x.text, '\S') AS has1, regexp_matches(y.text, '\S') AS has2,
    regexp_matches(split_part(x.text, E'\n', 1), '\S') AS head, regexp_matches(substr(x.text, length(split_part(x.text, E'\n', 1)) + 1), '\S') AS tail
  FROM m LEFT JOIN b x ON x.conv_id = m.conv_id AND x.turn = m.turn - 1 LEFT JOIN b y ON y.conv_id = m.conv_id AND y.turn = m.turn - 2),
q AS (SELECT *, CASE WHEN turn % 5 = 3 THEN CASE WHEN head THEN 1 ELSE 0 END + CASE WHEN tail THEN 1 ELSE 0 END
    WHEN turn % 3 = 1 THEN CASE WHEN head THEN 1 ELSE 0 END
    ELSE CASE WHEN has1 THEN 1 ELSE 0 END + CASE WHEN has2 THEN 1 ELSE 0 END END AS n,
  CASE WHEN turn % 5 = 3 THEN head OR tail WHEN turn % 3 = 1 THEN head ELSE has1 END AS answers FROM j)
SELECT conv_id AS conversation_id, 0 AS thread_rank, conv_id, turn, role, trim(text, E' \n\t\r') AS text,
  CASE WHEN answers THEN conv_id END AS reply_thread, CASE WHEN answers THEN turn - 1 END AS reply_order, n AS n_quotes, n AS n_linked,
  '<|' || coalesce(role, 'unknown') || E'|>\n' || trim(text, E' \n\t\r') || E'\n<|end|>\n' AS chat
FROM q""",
    "op8_merkle_fixity": r"""
WITH n AS (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE CAST(ceil(count(*) / 1000.0) AS BIGINT) END AS files FROM pages),
r AS (SELECT page_id,
  E'WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:gable:' || coalesce(CAST(page_id AS VARCHAR), '') || E'>\r\nWARC-Target-URI: ' || coalesce(url, '')
  || E'\r\nContent-Type: text/html\r\nContent-Length: ' || strlen(coalesce(html, '')) || E'\r\n\r\n' || coalesce(html, '') || E'\r\n\r\n' AS record
  FROM pages),
f AS (SELECT *, CAST((CAST('0x' || sha256(record)[1:8] AS BIGINT) + (row_number() OVER (PARTITION BY page_id, record) - 1) // 1000) % files AS INTEGER) AS file FROM r, n),
o AS (SELECT *, row_number() OVER w - 1 AS seq, CAST(sum(strlen(record)) OVER w - strlen(record) AS BIGINT) AS offset_ FROM f
  WINDOW w AS (PARTITION BY file ORDER BY page_id NULLS FIRST, sha256(record) ROWS UNBOUNDED PRECEDING)),
d AS (SELECT *, CASE WHEN page_id % 307 = 11 THEN NULL
  WHEN page_id % 97 = 13 THEN encode(record)[1:strlen(record) - 5] || encode('~') || encode(record)[strlen(record) - 3:]
  WHEN page_id % 211 = 5 THEN encode(record)[1:strlen(record) - 7] ELSE encode(record) END AS copy FROM o)
SELECT file, seq, offset_ AS offset, CAST(strlen(record) AS BIGINT) AS length, CASE WHEN copy IS NULL THEN 'missing' ELSE 'changed' END AS status,
  sha256(record) AS digest, sha256(copy) AS replica_digest
FROM d WHERE copy IS NULL OR copy <> encode(record)""",
    "op13_centroids": _LLOYD,
    "op6_exact_dedup": """
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept,
  sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW w AS (PARTITION BY coalesce(text, ''))""",
    "op10_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '\s+'), lambda x: x <> '') AS ws FROM documents WHERE text IS NOT NULL),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) >= 5 THEN list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' '))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS c FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT p.a, p.b, k = x.c AND k = y.c AS same FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b
  WHERE k >= 0.8 * (x.c + y.c - k) - 1e-9),
reach(id, r) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, l.b FROM reach JOIN l ON reach.r = l.a),
c AS (SELECT id, min(r) AS k FROM reach GROUP BY id),
m AS (SELECT a, count(*) AS n, min(CASE WHEN same THEN b END) AS twin FROM l GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(m.twin, d.doc_id)) AS class_id, c.k AS component_id, coalesce(m.n, 0) AS n_links, c.k = d.doc_id AS kept
FROM documents d JOIN c ON c.id = d.doc_id LEFT JOIN m ON m.a = d.doc_id""",
}
