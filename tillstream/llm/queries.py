"""The registered queries of this package and the SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tillstream.llm import (
    alignment, bpe, common, contamination, extraction, langid, licenses, line_dedup, pii, quality,
    simhash, toxicity, variants, winnowing)

HELD_OUT_LANGUAGE = 4  # documents whose crc32 is 2 modulo this are not learned from
HELD_OUT_TOXIC = 5  # every document whose crc32 is 0 modulo this is not learned from


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return bpe.digests(docs, bpe.fit(docs, tokenizer_path()))


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    held_out = F.coalesce(common.crc_remainder("doc_id", HELD_OUT_LANGUAGE) == 2, F.lit(False))
    model = langid.fit(docs.where(~held_out))
    return langid.identify(docs, model).withColumn("held_out", held_out)


def op3_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extraction.extract(common.table(spark, sf_dir, "pages"))


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.report(common.table(spark, sf_dir, "documents"))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.groups(common.table(spark, sf_dir, "documents"))


def op6_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.report(common.table(spark, sf_dir, "documents"))


def op7_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return winnowing.compare(common.table(spark, sf_dir, "documents"))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination.hits(
        common.table(spark, sf_dir, "documents"), common.table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        contamination.is_contaminated().alias("contaminated"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    return line_dedup.drop_boilerplate(docs, dropped="n_dropped")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = common.table(spark, sf_dir, "labels")
    held_out = common.crc_remainder("doc_id", HELD_OUT_TOXIC) == 0
    model = toxicity.fit(docs, labels.where(~held_out))
    scored = docs.select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"),
                         toxicity.score_column(spark, model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


def op11_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    return alignment.compare(docs, alignment.load(
        docs, tokenizer_path(), tokenizer_path("piece_bpe_32k.model")))


def op12_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants.variants(common.table(spark, sf_dir, "documents"))


def op13_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(common.table(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        "base_failed", "kept", "score")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_bpe": op1_bpe,
    "op2_language": op2_language,
    "op3_extraction": op3_extraction,
    "op4_pii": op4_pii,
    "op5_simhash": op5_simhash,
    "op6_licenses": op6_licenses,
    "op7_winnowing": op7_winnowing,
    "op8_decontamination": op8_decontamination,
    "op9_line_dedup": op9_line_dedup,
    "op10_toxicity": op10_toxicity,
    "op11_alignment": op11_alignment,
    "op12_variants": op12_variants,
    "op13_quality": op13_quality,
}

SQL: dict[str, str] = {
    "op8_decontamination": r"""
        WITH d AS (
            SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''),
                'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM documents),
        b AS (
            SELECT CAST(item_id AS VARCHAR) AS item, list_filter(regexp_split_to_array(translate(
                coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w
            FROM benchmark),
        windows AS (
            SELECT DISTINCT item, len(part) AS n, array_to_string(part, ' ') AS win
            FROM (SELECT item, w[i:i + least(len(w), 13) - 1] AS part
                  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i
                        FROM b WHERE len(w) > 0))),
        lengths AS (SELECT DISTINCT n FROM windows),
        places AS (
            SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS win
            FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i
                  FROM d CROSS JOIN lengths WHERE len(w) >= n)),
        found AS (SELECT doc_id, p.n, i, item FROM places p JOIN windows v
                  ON p.n = v.n AND p.win = v.win),
        hit AS (SELECT doc_id, count(DISTINCT x) AS n_hit
                FROM (SELECT doc_id, unnest(range(i, i + n)) AS x FROM found) GROUP BY 1),
        items AS (SELECT doc_id, count(DISTINCT item) AS n_items,
                         array_to_string(list_sort(list_distinct(list(item))), ',') AS ids
                  FROM found GROUP BY 1)
        SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words,
            CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
            CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
            sha256(coalesce(ids, '')) AS items_sha256,
            coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
        FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN items USING (doc_id)
    """,
    "op9_line_dedup": """
        WITH pages AS (SELECT DISTINCT source, text FROM documents WHERE text IS NOT NULL),
        totals AS (SELECT source, count(*) AS pages FROM pages GROUP BY 1),
        lines AS (SELECT DISTINCT source, text, trim(line) AS line FROM (
            SELECT source, text, unnest(string_split(text, chr(10))) AS line FROM pages)
            WHERE trim(line) <> ''),
        counts AS (SELECT source, line, count(*) AS n FROM lines GROUP BY 1, 2),
        boilerplate AS (
            SELECT c.source, list(line) AS lines FROM counts c JOIN totals t
            ON c.source IS NOT DISTINCT FROM t.source
            WHERE n >= 3 AND n > CAST(0.02 AS DOUBLE) * pages GROUP BY 1),
        cut AS (
            SELECT doc_id, d.source, text, string_split(text, chr(10)) AS old,
                list_filter(string_split(text, chr(10)), lambda line: trim(line) = ''
                    OR NOT list_contains(lines, trim(line))) AS new, lines
            FROM documents d LEFT JOIN boilerplate b ON d.source IS NOT DISTINCT FROM b.source)
        SELECT doc_id, source,
            CASE WHEN lines IS NULL THEN text ELSE array_to_string(new, chr(10)) END AS text,
            CAST(CASE WHEN lines IS NULL OR text IS NULL THEN 0 ELSE len(old) - len(new) END
                AS INTEGER) AS n_dropped
        FROM cut
    """,
}
