"""The registered queries of this subpackage and, where SQL can express them, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from lumenix.llm.common import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


@query
def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import toxicity

    return toxicity.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenix.llm import bpe

    return bpe.round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from lumenix.llm import packing

    return packing.pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


@query
def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import language_id

    return language_id.identify(table(spark, sf_dir, "documents"))


@query
def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import quality

    return quality.classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import exact_dedup

    return exact_dedup.dedup(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = r"""
WITH n AS (
  SELECT doc_id, length(coalesce(text, '')) AS points, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', '', 'g') AS body FROM documents
), k AS (
  SELECT doc_id, body, first_value(doc_id) OVER (PARTITION BY body ORDER BY points DESC, doc_id NULLS LAST) AS keep_id, count(*) OVER (PARTITION BY body) AS group_size FROM n
)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(body) AS text_sha256 FROM k
"""


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import minhash

    return minhash.near_duplicates(table(spark, sf_dir, "documents"), minhash.MinHashParams(words=4))


@query
def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import common, warc

    return warc.archive_round_trip(table(spark, sf_dir, "pages"), common.fresh_path(spark, "archive"))


_BASE32 = " || ".join(
    f"substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(hex, {10 * k + 1}, 10))::BIGINT >> {35 - 5 * i}) & 31) + 1)::INT, 1)" for k in range(4) for i in range(8)
)
ORACLES["op5_warc"] = f"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS body, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS hex FROM pages
), k AS (
  SELECT *, max(page_id) OVER (PARTITION BY body) AS first_page FROM p
)
SELECT page_id, payload_bytes, {_BASE32} AS payload_digest,
       CASE WHEN page_id IS DISTINCT FROM first_page THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN page_id IS DISTINCT FROM first_page THEN first_page END AS refers_to
FROM k
"""


@query
def op4_bitsliced_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import bitsliced

    rows = bitsliced.quantise(table(spark, sf_dir, "embeddings"))
    return bitsliced.search(bitsliced.index(rows), rows.where("vec_id % 100 = 0"))


ORACLES["op4_bitsliced_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS q FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS query_id, b.vec_id, list_dot_product(a.q, b.q)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 100 = 0
), r AS (
  SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""


@query
def op1_cross_parsing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from lumenix.llm import cross_parsing

    documents = table(spark, sf_dir, "documents")
    return cross_parsing.score(documents, cross_parsing.good_reference(documents, table(spark, sf_dir, "labels")))


ORACLES["op10_minhash"] = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
                 ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w
), k AS (
  SELECT doc_id, len(sh) AS n, sh, md5(array_to_string(list_sort(sh), chr(10))) AS same FROM s
), u AS (
  SELECT min(doc_id) AS rep, any_value(n) AS n, any_value(sh) AS sh, same FROM k WHERE n > 0 GROUP BY same
), e AS (
  SELECT rep, unnest(sh) AS x FROM u
), p AS (
  SELECT a.rep AS a, b.rep AS b, count(*) AS i FROM e a JOIN e b USING (x) WHERE a.rep < b.rep GROUP BY a.rep, b.rep
), l AS (
  SELECT a, b FROM p JOIN u ua ON a = ua.rep JOIN u ub ON b = ub.rep WHERE 100 * i >= 80 * (ua.n + ub.n - i)
), g AS (
  SELECT a, b FROM l UNION ALL SELECT b, a FROM l
), r AS (
  SELECT rep AS a, rep AS b FROM u UNION SELECT r.a, g.b FROM r JOIN g ON r.b = g.a
), c AS (
  SELECT a, min(b) AS component_id FROM r GROUP BY a
)
SELECT k.doc_id, k.n::BIGINT AS n_shingles, coalesce(c.component_id, k.doc_id) AS component_id, k.doc_id = coalesce(c.component_id, k.doc_id) AS kept
FROM k LEFT JOIN u ON k.same = u.same AND k.n > 0 LEFT JOIN c ON c.a = u.rep
"""
