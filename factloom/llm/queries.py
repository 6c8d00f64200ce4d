"""The queries of the corpus operators, with production parameters over whole tables, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (
    best_fit_packing, dart_minhash, exact_dedup, heap_lloyd, hilbert_shards, host_suffix_array, license_scan, periodic_runs,
    pii_crf, sampled_pieces, string_kernel_lang, topk_nra, url_filter,
)


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(_table(spark, sf_dir, "documents"))


def op2_dart_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dart_minhash.near_dedup(_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "class_size", "n_links", "kept")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.license_scan(_table(spark, sf_dir, "documents"))


def op4_sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampled_pieces.pieces_query(_table(spark, sf_dir, "documents"))


def op5_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.url_filter(_table(spark, sf_dir, "pages"), url_filter.rule_table(spark))


def op6_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert_shards.shard(_table(spark, sf_dir, "documents"))


def op7_topk_nra(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk_nra.top_k(_table(spark, sf_dir, "embeddings"))


def op8_pii_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_crf.find_pii(_table(spark, sf_dir, "documents"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return best_fit_packing.pack(_table(spark, sf_dir, "documents"))


def op10_string_kernel_lang(spark: SparkSession, sf_dir: str) -> DataFrame:
    return string_kernel_lang.identify(_table(spark, sf_dir, "documents"))


def op11_kolpakov_kucherov(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periodic_runs.find_runs(_table(spark, sf_dir, "documents"), rewrite=True)


def op13_heap_lloyd(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heap_lloyd.compress(_table(spark, sf_dir, "embeddings"))


def op12_host_suffix_array(spark: SparkSession, sf_dir: str) -> DataFrame:
    return host_suffix_array.extract(_table(spark, sf_dir, "pages"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    every = (
        op1_exact_dedup, op2_dart_minhash, op3_license_scan, op4_sampled_pieces, op5_url_filter,
        op6_hilbert_shards, op7_topk_nra, op8_pii_crf, op9_best_fit_packing, op10_string_kernel_lang,
        op11_kolpakov_kucherov, op12_host_suffix_array, op13_heap_lloyd,
    )
    return {f.__name__: f for f in every}


OP1 = r"""
WITH d AS (
  SELECT doc_id, sha256(regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g')) AS text_sha256, length(coalesce(text, '')) AS n
  FROM documents
), g AS (
  SELECT doc_id, text_sha256, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM d WINDOW w AS (PARTITION BY text_sha256 ORDER BY n DESC, doc_id)
)
SELECT doc_id, keep_id, CAST(group_size AS BIGINT) AS group_size, doc_id = keep_id AS kept, text_sha256 FROM g
"""

OP5 = r"""
WITH u AS (
  SELECT page_id,
    translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), r AS (
  SELECT *, CASE
    WHEN (host = 'example.net' OR host LIKE '%.example.net') AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN (host = 'example.com' OR host LIKE '%.example.com') AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN (host = 'net' OR host LIKE '%.net') AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM u
)
SELECT page_id, host, path, rule, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' ELSE 'allow' END AS verdict FROM r
"""

OP7 = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


#: For pages whose main text is one article of headings and paragraphs with no other part in it, as in the pages table; references: the five of XML.
OP12 = r"""
WITH a AS (
  SELECT page_id, url, regexp_extract(html, '(?s)<article[^>]*>(.*)</article>', 1) AS inside FROM pages
), b AS (
  SELECT page_id, url, list_filter(list_transform(
    regexp_split_to_array(regexp_replace(inside, '</?(b|i|em|strong|a|span|br)(\s[^>]*)?>', ' ', 'g'), '<[^>]*>'),
    lambda t: trim(regexp_replace(replace(replace(replace(replace(replace(regexp_replace(t, '&amp([^;a-zA-Z0-9]|$)', '&amp;\1', 'g'),
      '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#x27;', chr(39)), '&amp;', '&'), '[\s\x0B\x{85}\x{A0}]+', ' ', 'g'))), lambda t: t <> '') AS blocks
  FROM a
)
SELECT page_id, url, array_to_string(blocks, chr(10)) AS text, CAST(length(array_to_string(blocks, chr(10))) AS BIGINT) AS n_chars FROM b
"""


def _op13(rounds: int = heap_lloyd.ROUNDS) -> str:
    """Plain rounds over every part and entry; each round's tables are written out once."""
    steps = [
        """WITH v AS MATERIALIZED (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS x, len(embedding) // 8 AS w
  FROM embeddings WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), p AS MATERIALIZED (
  SELECT vec_id, CAST(part AS INTEGER) AS part, list_slice(x, part * w + 1, part * w + w) AS x FROM v, range(8) t(part)
), e0 AS MATERIALIZED (
  SELECT part, CAST(row_number() OVER (PARTITION BY part ORDER BY vec_id) - 1 AS INTEGER) AS entry, x AS c FROM p QUALIFY entry < 16
)"""
    ]
    for i in range(rounds + 1):
        steps.append(f"""a{i} AS MATERIALIZED (
  SELECT vec_id, part, min(far * 16 + entry) % 16 AS entry, min(far) AS far
  FROM (SELECT vec_id, p.part, entry, CAST(list_sum(list_transform(list_zip(p.x, e.c), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS BIGINT) AS far FROM p JOIN e{i} e ON p.part = e.part)
  GROUP BY vec_id, part
)""")
        if i < rounds:
            steps.append(f"""m{i} AS (
  SELECT part, entry, list(m ORDER BY place) AS c FROM (
    SELECT part, entry, place, CAST(floor(CAST(sum(x[place]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM (SELECT a.part, a.entry, p.x, unnest(range(1, len(p.x) + 1)) AS place FROM a{i} a JOIN p ON a.vec_id = p.vec_id AND a.part = p.part) GROUP BY part, entry, place
  ) GROUP BY part, entry
), e{i + 1} AS MATERIALIZED (
  SELECT e.part, e.entry, coalesce(m.c, e.c) AS c FROM e{i} e LEFT JOIN m{i} m ON e.part = m.part AND e.entry = m.entry
)""")
    return ", ".join(steps) + f""", told AS (
  SELECT vec_id, string_agg(printf('%02x', CAST(entry AS INTEGER)), '' ORDER BY part) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY vec_id
), books AS (
  SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM e{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM told JOIN v USING (vec_id), books"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op5_url_filter": OP5, "op7_topk_nra": OP7, "op12_host_suffix_array": OP12, "op13_heap_lloyd": _op13()}
