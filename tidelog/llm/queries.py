"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(_docs(spark, sf_dir))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .quality import classify_documents

    return classify_documents(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op3_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .bagminhash import classes_of

    return classes_of(_docs(spark, sf_dir))


def op4_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import archive_pages

    return archive_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .langid import identify_documents

    return identify_documents(_docs(spark, sf_dir))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .decontam import contaminated

    return contaminated(_docs(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op7_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .merkle import fingerprint_documents

    return fingerprint_documents(_docs(spark, sf_dir))


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .sharding import shard_documents

    return shard_documents(_docs(spark, sf_dir), 40)


def op9_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .pii import find_in_documents

    return find_in_documents(_docs(spark, sf_dir))


def op10_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .idfiles import documents_ids

    return documents_ids(_docs(spark, sf_dir))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {k: f for k, f in globals().items() if k.startswith("op") and callable(f)}


#: The first part of ``warc``'s contract in SQL; the archives' rows must say the same.
OP4_SQL = """
WITH p AS (SELECT page_id, url, sha1(coalesce(html, '')) AS payload_digest, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes FROM pages),
q AS (SELECT *, CASE WHEN payload_bytes >= 1000 THEN max(page_id) OVER (PARTITION BY payload_digest, payload_bytes >= 1000) END AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN kept <> page_id THEN kept END AS refers_to, url FROM q
"""


def _fingerprint_sql(source: str, out: str) -> str:
    """Tables that give ``out`` (doc_id, fp) of a table ``source`` (doc_id, t)."""
    return f"""
{out}_b AS (SELECT doc_id, list_transform(string_split(t, chr(10)), lambda p: list_transform(regexp_extract_all(p, '[^.]{{1,160}}[.]?|[.]'), lambda b: sha256(b))) AS blocks FROM {source}),
{out}_n AS (SELECT doc_id, blocks, list_transform(blocks, lambda h: sha256('p' || array_to_string(h, ''))) AS nodes FROM {out}_b),
{out}_s AS (SELECT *, list_transform(string_split(array_to_string(list_transform(nodes, lambda h: h || CASE WHEN h[1] IN ('0', '1', '2', '3') THEN chr(10) ELSE '' END), ''), chr(10)), lambda s: sha256('s' || s)) AS sections FROM {out}_n),
{out} AS (SELECT doc_id, sha256('r' || array_to_string(sections, '')) || '/' || array_to_string(list_transform(sections, lambda h: h[1:16]), ',') || '/' || array_to_string(list_transform(nodes, lambda h: h[1:12]), ',') || '/' ||
  array_to_string(list_transform(blocks, lambda h: array_to_string(list_transform(h, lambda x: x[1:8]), ',')), ',') AS fp FROM {out}_s)"""


def _likeness_sql(a: str, b: str) -> str:
    leaves = lambda x: f"list_distinct(list_filter(string_split(split_part({x}, '/', 4), ','), lambda h: h <> ''))"
    return f"CASE WHEN split_part({a}, '/', 1) = split_part({b}, '/', 1) THEN 1.0::DOUBLE ELSE 2.0::DOUBLE * len(list_intersect({leaves(a)}, {leaves(b)})) / greatest(len({leaves(a)}) + len({leaves(b)}), 1) END"


def _locate_sql(a: str, b: str, level: int) -> str:
    x, y = (f"string_split(split_part({c}, '/', {level}), ',')" for c in (a, b))
    return f"CAST(list_min(list_filter(list_transform(range(0, greatest(len({x}), len({y}))), lambda i: CASE WHEN {x}[i + 1] IS DISTINCT FROM {y}[i + 1] THEN i END), lambda i: i IS NOT NULL)) AS INTEGER)"


OP7_SQL = f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
n AS (SELECT doc_id, t, coalesce(lead(t) OVER w, first_value(t) OVER w) AS nt, coalesce(lead(doc_id) OVER w, first_value(doc_id) OVER w) AS nid FROM d WINDOW w AS (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
e AS (SELECT doc_id, left(t, length(t) - length(t) // 2) || left(nt, length(t) // 2) AS t FROM n), {_fingerprint_sql("d", "own")}, {_fingerprint_sql("e", "edited")}
SELECT n.doc_id, CAST(length(n.t) AS BIGINT) AS n_chars, sha256(e.t) AS edited_sha256, own.fp AS fingerprint, edited.fp AS edited_fingerprint,
  {_likeness_sql("own.fp", "edited.fp")} AS near_edited, {_likeness_sql("own.fp", "nxt.fp")} AS near_next, {_locate_sql("own.fp", "edited.fp", 2)} AS edit_section, {_locate_sql("own.fp", "edited.fp", 3)} AS edit_paragraph
FROM n JOIN e USING (doc_id) JOIN own ON own.doc_id = n.doc_id JOIN edited ON edited.doc_id = n.doc_id JOIN own nxt ON nxt.doc_id = n.nid
"""


def oracle_sql() -> dict[str, str]:
    """SQL of the queries that SQL can express; tests/llm holds the others against brute force."""
    return {"op4_warc": OP4_SQL, "op7_fingerprints": OP7_SQL}
