"""The queries of this subpackage: operator N as opN_<name>, over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from . import alignment, bpe, embeddings, html_text, jaccard, media, packing, quality, spelling, suffix_array, token_files, tokens, warc


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op3_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join_components(_table(spark, sf_dir, "documents"), words=4, num=85, den=100)


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    read = warc.read_archives(warc.write_archives(_table(spark, sf_dir, "pages")), keep=False)
    return read.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op5_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embeddings.near_duplicates(_table(spark, sf_dir, "embeddings"))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = bpe.encode_decode(_table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN, keep=False)
    return found.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")


def op7_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.store_payloads(_table(spark, sf_dir, "documents"), keep=False).drop("media", "tile")


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = tokens.prefix_counts(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))
    return found.selectExpr("doc_id", "n_bytes", "n_tokens", "n_tokens > 2048 as over_limit")


def op1_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_array.dedup(_table(spark, sf_dir, "documents"), window=100).drop("spans", "kept")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False).drop("ids")


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return quality.score(docs, quality.fit(docs, _table(spark, sf_dir, "labels")))


def op10_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_table(spark, sf_dir, "pages"))


def op11_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"), keep=False).drop("ids")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    paths = map(public_tokenizers.path, ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    return alignment.align(_table(spark, sf_dir, "documents"), *paths, keep=False).drop("groups")


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


#: Payload digests as SQL: twenty bits of the hexadecimal SHA-1 are four letters of base32.
_BASE32 = """array_to_string(list_transform(range(8), lambda i: list_aggregate(list_transform([32768, 1024, 32, 1],
  lambda d: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(h, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) // d) % 32 + 1 AS INT), 1)), 'string_agg', '')), '')"""

QUERIES = {
    "op1_suffix_array": op1_suffix_array,
    "op2_packing": op2_packing,
    "op3_jaccard": op3_jaccard,
    "op4_warc": op4_warc,
    "op5_embeddings": op5_embeddings,
    "op6_bpe": op6_bpe,
    "op7_media": op7_media,
    "op8_token_counts": op8_token_counts,
    "op9_quality": op9_quality,
    "op10_html": op10_html,
    "op11_token_files": op11_token_files,
    "op12_alignment": op12_alignment,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL = {
    "op3_jaccard": r"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
g AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
  ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS s FROM w),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id), sets AS (SELECT doc_id, md5(string_agg(s, chr(10) ORDER BY s)) AS h FROM g GROUP BY doc_id),
rep AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY h) AS r FROM sets),
d AS (SELECT g.doc_id, g.s FROM g JOIN rep ON rep.doc_id = g.doc_id AND rep.r = g.doc_id),
x AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM d a JOIN d b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x.a, x.b FROM x JOIN n p ON p.doc_id = x.a JOIN n q ON q.doc_id = x.b WHERE 100 * x.k >= 85 * (p.n + q.n - x.k)
  UNION SELECT r, doc_id FROM rep WHERE r <> doc_id),
e AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach AS (SELECT doc_id AS node, doc_id AS other FROM documents UNION SELECT r.node, e.b FROM reach r JOIN e ON e.a = r.other)
SELECT t.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, m.c AS component_id FROM documents t JOIN (SELECT node, min(other) AS c FROM reach GROUP BY node) m ON m.node = t.doc_id
LEFT JOIN n ON n.doc_id = t.doc_id""",
    "op5_embeddings": """WITH RECURSIVE v AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS x FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL),
w AS (SELECT *, sqrt(list_sum(list_transform(x, lambda e: e * e))) AS norm FROM v),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM w a JOIN w b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.x, b.x) / (a.norm * b.norm) >= 0.98),
reach AS (SELECT vec_id AS node, vec_id AS other FROM embeddings UNION SELECT r.node, l.b FROM reach r JOIN links l ON l.a = r.other),
c AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node), n AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT e.vec_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_links, c.component_id, c.component_id = e.vec_id AS kept
FROM embeddings e JOIN c ON c.node = e.vec_id LEFT JOIN n ON n.a = e.vec_id""",
    "op4_warc": f"""WITH p AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT page_id, octet_length(encode(body)) AS n, h, min(page_id) OVER (PARTITION BY h) AS m FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, {_BASE32} AS payload_digest,
  CASE WHEN m = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN m < page_id THEN m END AS refers_to FROM f""",
}
