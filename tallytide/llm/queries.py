"""One registered query per operator, over its whole table, and SQL where it can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tallytide.llm import (
    conversations,
    decontaminate,
    fingerprints,
    language,
    lines,
    merkle,
    mixing,
    near_dup,
    repeats,
    secrets,
    token_counts,
    token_files,
    warc,
)
from tallytide.llm.common import new_folder, table

Query = Callable[[SparkSession, str], DataFrame]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.languages(table(spark, sf_dir, "documents"))


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.secrets(table(spark, sf_dir, "documents"))


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    warc.write_archives(table(spark, sf_dir, "pages"), path)
    return warc.archived(spark, path)


def op4_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return mixing.mixed(docs, mixing.tempered_weights(docs))


def op6_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark)
    token_files.write_tokens(table(spark, sf_dir, "documents"), path)
    return token_files.read_tokens(spark, path)


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    text = lines.text_lines(F.col("html"))
    return lines.without_boilerplate(pages, "page_id", lines.host_of(F.col("url")), text)


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, benchmark = (table(spark, sf_dir, name) for name in ("documents", "benchmark"))
    return decontaminate.decontaminated(docs, benchmark)


def op9_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.compared_with_next(table(spark, sf_dir, "documents"))


def op10_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"))


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verified_rows(table(spark, sf_dir, "documents"))


def op12_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.digests(repeats.without_repeats(table(spark, sf_dir, "documents")))


def op13_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.audited(table(spark, sf_dir, "conversations"))


QUERIES: dict[str, Query] = {
    query.__name__: query
    for query in (
        op1_language,
        op2_secrets,
        op3_warc,
        op4_near_duplicates,
        op5_mixing,
        op6_token_files,
        op7_line_dedup,
        op8_decontamination,
        op9_fingerprints,
        op10_token_counts,
        op11_merkle,
        op12_repeats,
        op13_conversations,
    )
}

ORACLE_SQL = {
    "op3_warc": f"""
        WITH payloads AS (
            SELECT page_id, coalesce(html, '') AS payload FROM pages
        ), measured AS (
            SELECT page_id, octet_length(encode(payload)) AS size, sha1(payload) AS digest
            FROM payloads
        ), placed AS (
            SELECT *, max(page_id) OVER (PARTITION BY size, digest) AS original FROM measured
        )
        SELECT page_id, size AS payload_bytes, digest AS payload_digest,
            CASE WHEN size >= {warc.LEAST} AND page_id < original THEN 'revisit' ELSE 'response'
            END AS record_type,
            CASE WHEN size >= {warc.LEAST} AND page_id < original THEN original END AS refers_to
        FROM placed
    """,
    "op7_line_dedup": f"""
        WITH pieces AS (
            SELECT page_id,
                coalesce(lower(regexp_extract(url, '^[A-Za-z]+://([^/:?#]+)', 1)), '') AS host,
                coalesce(list_filter(
                    list_transform(
                        string_split(regexp_replace(html, '<[^>]*>', chr(10), 'g'), chr(10)),
                        lambda x: trim(x, ' ')),
                    lambda x: x <> ''), []) AS lines
            FROM pages
        ), totals AS (
            SELECT host, count(*) AS n_pages FROM pieces GROUP BY host
        ), spread AS (
            SELECT host, page_id, unnest(list_distinct(lines)) AS line FROM pieces
        ), boilerplate AS (
            SELECT host, list(line) AS dropped
            FROM (
                SELECT s.host, s.line FROM spread s JOIN totals t ON s.host = t.host
                GROUP BY s.host, s.line, t.n_pages
                HAVING count(*) * 1000 > t.n_pages * {round(lines.RATIO * 1000)}
                    AND count(*) >= {lines.LEAST_REPEATS}
            ) GROUP BY host
        ), kept AS (
            SELECT p.page_id, p.host, p.lines,
                list_filter(p.lines, lambda x: NOT coalesce(list_contains(b.dropped, x), false)) AS kept
            FROM pieces p LEFT JOIN boilerplate b ON p.host = b.host
        )
        SELECT page_id, host, CAST(len(lines) AS BIGINT) AS n_lines,
            CAST(len(lines) - len(kept) AS BIGINT) AS n_dropped,
            coalesce(array_to_string(kept, chr(10)), '') AS text
        FROM kept
    """,
    "op11_merkle": """
        WITH RECURSIVE fields AS (
            SELECT lang, doc_id,
                coalesce(octet_length(encode(CAST(doc_id AS VARCHAR))) || ':' || doc_id, '-')
                    || coalesce(octet_length(encode(source)) || ':' || source, '-')
                    || coalesce(octet_length(encode(lang)) || ':' || lang, '-') AS head,
                n_chars,
                coalesce(octet_length(encode(text)) || ':' || text, '-') AS tail,
                list_reduce(
                    list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda c: CAST(ord(c) AS BIGINT))),
                    lambda crc, c: list_reduce(
                        list_prepend(xor(crc, c), range(8)),
                        lambda x, i: xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END))
                ) AS crc
            FROM documents
        ), hashed AS (
            SELECT lang, doc_id,
                sha256(head || coalesce(length(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
                sha256(head || coalesce(length(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) AS changed,
                doc_id IS NOT NULL AND xor(crc, 4294967295) % 7 = 0 AS tampered
            FROM fields
        ), leaves AS (
            SELECT *, row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                count(*) OVER (PARTITION BY lang) AS n
            FROM hashed
        ), nodes AS (
            SELECT lang, 0 AS level, place, n, leaf AS node FROM leaves
            UNION ALL
            SELECT lang, level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
            FROM nodes WHERE n > 1 GROUP BY lang, level, place // 2, n
        ), subroots AS (
            SELECT lang, node AS subroot, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place, count(*) OVER () AS n
            FROM nodes WHERE n = 1
        ), tops AS (
            SELECT 0 AS level, place, n, subroot AS node FROM subroots
            UNION ALL
            SELECT level + 1, place // 2, (n + 1) // 2, sha256(string_agg(node, '' ORDER BY place))
            FROM tops WHERE n > 1 GROUP BY level, place // 2, n
        ), steps AS (
            SELECT l.lang, l.doc_id, l.leaf, a.level, (l.place >> a.level) & 1 AS is_right, b.node AS sibling
            FROM leaves l JOIN nodes a ON l.lang IS NOT DISTINCT FROM a.lang AND a.place = l.place >> a.level AND a.n > 1
            LEFT JOIN nodes b ON a.lang IS NOT DISTINCT FROM b.lang AND a.level = b.level AND b.place = xor(a.place, 1)
            UNION ALL
            SELECT l.lang, l.doc_id, l.leaf, 1000 + a.level, (s.place >> a.level) & 1, b.node
            FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
            JOIN tops a ON a.place = s.place >> a.level AND a.n > 1
            LEFT JOIN tops b ON a.level = b.level AND b.place = xor(a.place, 1)
        ), paths AS (
            SELECT lang, doc_id, leaf, list({'is_right': is_right, 'sibling': sibling} ORDER BY level) AS path
            FROM steps GROUP BY lang, doc_id, leaf
        ), folded AS (
            SELECT l.doc_id, l.leaf, s.subroot, coalesce(p.path, []) AS path,
                (SELECT node FROM tops WHERE n = 1) AS root,
                CASE WHEN l.tampered THEN l.changed ELSE l.leaf END AS start
            FROM leaves l JOIN subroots s ON l.lang IS NOT DISTINCT FROM s.lang
            LEFT JOIN paths p ON l.lang IS NOT DISTINCT FROM p.lang AND l.doc_id IS NOT DISTINCT FROM p.doc_id AND l.leaf = p.leaf
        ), rooted AS (
            SELECT *, list_reduce(
                    list_prepend(start, list_transform(path, lambda s:
                        CASE WHEN s.sibling IS NULL THEN '-' WHEN s.is_right = 1 THEN '<' || s.sibling ELSE '>' || s.sibling END)),
                    lambda node, s: sha256(CASE left(s, 1) WHEN '-' THEN node WHEN '<' THEN s[2:] || node ELSE node || s[2:] END)
                ) AS folded_root
            FROM folded
        )
        SELECT doc_id, leaf, subroot, root,
            sha256(coalesce(array_to_string(list_transform(path, lambda s: s.sibling), ''), '')) AS proof_sha256,
            folded_root, folded_root = root AS verified
        FROM rooted
    """,
}
