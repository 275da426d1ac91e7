"""The opN_ queries: each applies its operator to the whole table under its contract; ORACLE has the SQL that DuckDB can run."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spalt.llm.common import crc32_mod, read


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.langid import predict, train

    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 4) == 2, F.lit(False))
    models = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    columns = ["lang_pred", "score", "cross_entropy", "rejected"]
    return predict(docs.select("doc_id", "text"), models, keep=["doc_id"]).select("doc_id", held_out.alias("held_out"), *columns)


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.linededup import dedup_lines

    return dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spalt.llm.pieces import encode

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    columns = ["n_tokens", "ids_sha256", "decoded_sha256", "spans_crc32"]
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns).select("doc_id", *columns)


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spalt.llm.tokenid import length_histogram, suffix_sums

    docs = read(spark, sf_dir, "documents")
    return suffix_sums(length_histogram(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN))


def op5_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.suffixdedup import remove_repeats

    return remove_repeats(read(spark, sf_dir, "documents").select("doc_id", "text"))


def op6_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.simhash import near_groups

    groups = near_groups(read(spark, sf_dir, "documents").select("doc_id", "text"), words=3, distance=2)
    return groups.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op7_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from spalt.llm.tokenid import read_token_files, write_token_files

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return read_token_files(write_token_files(docs, public_tokenizers.path("word_bpe_49k.json"), end_id=1))


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.quality import judge

    counts = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    judged = judge(read(spark, sf_dir, "documents").select("doc_id", "text"), features=counts)
    base_failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return judged.select("doc_id", *counts, base_failed.alias("base_failed"), "kept")


def op9_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.toxicity import CUT, score, train

    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.coalesce(crc32_mod(F.col("doc_id"), 3) == 1, F.lit(False))
    model = train(docs, read(spark, sf_dir, "labels"), ~held_out)
    scored = score(docs, model, keep=["doc_id"])
    return scored.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= CUT).cast("int").alias("predicted"), F.size("offending").cast("long").alias("n_offending"))


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from spalt.llm.decontam import contaminated

    return contaminated(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_language_id, op2_line_dedup, op3_sentencepiece, op4_token_counts, op5_suffix_dedup, op6_simhash_dedup, op7_token_files, op8_quality_rules, op9_toxicity, op10_decontamination)}

ORACLE: dict[str, str] = {
    "op2_line_dedup": r"""
        WITH l AS (SELECT doc_id, text, string_split(text, chr(10)) AS lines FROM documents),
        w AS (SELECT doc_id, p, lines[p + 1] AS a, lines[p + 2] AS b, lines[p + 3] AS c FROM (SELECT *, unnest(range(0, len(lines) - 2)) AS p FROM l)),
        k AS (SELECT *, row_number() OVER (PARTITION BY a, b, c ORDER BY doc_id, p) AS rn FROM w WHERE NOT (trim(a) = '' AND trim(b) = '' AND trim(c) = '')),
        g AS (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) AS p FROM k WHERE rn > 1),
        r AS (SELECT doc_id, list(p) AS removed FROM g GROUP BY doc_id)
        SELECT l.doc_id, CASE WHEN removed IS NULL THEN text ELSE array_to_string([lines[i + 1] FOR i IN range(0, len(lines)) IF NOT list_contains(removed, i)], chr(10)) END AS text,
          CAST(coalesce(len(lines), 0) AS BIGINT) AS n_lines, CAST(coalesce(len(removed), 0) AS BIGINT) AS n_removed
        FROM l LEFT JOIN r USING (doc_id)""",
    "op8_quality_rules": r"""
        WITH b AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
        l AS (SELECT doc_id, t, w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM b),
        g AS (SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS p FROM l)),
        d AS (SELECT doc_id, p, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
        c AS (SELECT doc_id, count(*) AS n_repeat_words FROM (SELECT DISTINCT doc_id, p + unnest([0, 1, 2]) FROM d WHERE n > 1) GROUP BY doc_id),
        f AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS BIGINT) AS word_chars,
            CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines,
            CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, len(lines) AS n_lines,
            length(t) - length(regexp_replace(t, '\p{Lu}', '', 'g')) AS up, length(t) - length(regexp_replace(t, '\p{Ll}', '', 'g')) AS low
          FROM l LEFT JOIN c USING (doc_id)),
        v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM f)
        SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
          NOT (base_failed OR 10 * n_symbols > n_words OR 2 * n_dup_lines > n_lines OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 2 * up > greatest(1, up + low)) AS kept
        FROM v""",
}
