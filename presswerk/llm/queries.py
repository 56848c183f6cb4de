"""Queries of the training-data operators, and SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from presswerk.sources.tables import table, tables


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.history import repeated_rows

    return repeated_rows(*tables(spark, folder, "articles", "pipeline_runs"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.furniture import furniture_lines

    return furniture_lines(table(spark, folder, "articles"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.residue import residue_pages

    return residue_pages(table(spark, folder, "articles"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.components import duplicate_group_keys

    return duplicate_group_keys(*tables(spark, folder, "duplicate_groups", "duplicate_members"))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.repeated_lines import repeated_lines

    return repeated_lines(table(spark, folder, "articles"))


def p7_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.language import wrong_labels

    return wrong_labels(table(spark, folder, "articles"))


def p8_ids(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.tokenizer import encode_corpus

    return encode_corpus(table(spark, folder, "documents"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.leaks import leaked_items

    return leaked_items(*tables(spark, folder, "documents", "eval_passages"))


def p9_passages(spark: SparkSession, folder: str) -> DataFrame:
    """Passages with up to one wrong word too, and how much they share."""
    from presswerk.llm.leaks import leaked_passages

    return leaked_passages(*tables(spark, folder, "documents", "eval_passages"))


def p10_found(spark: SparkSession, folder: str) -> DataFrame:
    from presswerk.llm.mojibake import garbled_documents

    return garbled_documents(table(spark, folder, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (p1_found, p2_found, p3_found, p4_found, p6_found, p7_found, p8_ids, p9_found, p9_passages, p10_found)}


def oracle_sql() -> dict[str, str]:
    return {
        "p4_found": r"""
            WITH RECURSIVE link AS (
              SELECT DISTINCT lower(trim(g.canonical_url_hash)) AS a, lower(trim(m.duplicate_url_hash)) AS b
              FROM duplicate_groups g JOIN duplicate_members m ON m.group_id = g.id
              WHERE g.confidence >= 0.75 AND NOT isnan(g.confidence)),
            edge AS (SELECT a, b FROM link WHERE a <> b UNION SELECT b, a FROM link WHERE a <> b),
            reach AS (SELECT a AS n, b AS m FROM edge UNION SELECT r.n, e.b FROM reach r JOIN edge e ON e.a = r.m)
            SELECT n AS url_hash, least(n, min(m)) AS group_key FROM reach GROUP BY n""",
        "p6_found": r"""
            WITH line AS (
              SELECT id, source, unnest(string_split(content, chr(10))) AS line,
                     unnest(range(1, len(string_split(content, chr(10))) + 1)) AS line_no
              FROM articles WHERE content IS NOT NULL),
            t AS (
              SELECT id, source, line_no,
                     trim(regexp_replace(regexp_replace(lower(line), '[\s\p{Z}\x{85}\x{b}\x{c}]+', ' ', 'g'), '\p{Nd}+', '<*>', 'g')) AS template
              FROM line),
            often AS (
              SELECT source, template FROM t WHERE template <> '' GROUP BY ALL HAVING count(DISTINCT id) >= 6)
            SELECT DISTINCT id, CAST(line_no AS BIGINT) AS line_no FROM t JOIN often USING (source, template)""",
    }
