"""The corpus pipeline; counted as part of spalt.llm. Each stage's rows are written as Parquet and read again by the next.

Every stage takes nulls in any column, repeated and missing doc_ids, empty tables, and columns beside those of documents,
whatever they are called; texts are taken whole, however long. What each does with these is said below.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from spalt.llm.common import forget, fresh, materialize, read, written
from spalt.llm.decontam import keep_clean
from spalt.llm.linededup import dedup_lines
from spalt.llm.pieces import encode
from spalt.llm.quality import keep_good
from spalt.llm.simhash import keep_one


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a rule rejects go: null, empty and short texts among them. Repeated rows are judged one by one, so all go or stay."""
    return keep_good(docs)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated passages of three lines and more are cut from all but their first document; n_chars follows.

    Documents without a doc_id come first, those with the same one in the order of their texts' hashes; of equal rows one
    keeps its lines. A null text stays null, with n_chars null; a text that loses all its lines stays as an empty one.
    """
    lines, gone = fresh("n_lines", docs), fresh("n_removed", docs)
    out = dedup_lines(docs, {"n_lines": lines, "n_removed": gone}).drop(lines, gone)
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in docs.columns else out


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays: shingles of five words, an exact Jaccard similarity of 0.8 or more, and what such links reach.

    SimHash fingerprints and the pigeonring filter link first and the sets of shingles confirm; pairs of that similarity whose
    fingerprints lie further apart are found by an exact prefix filter.
    That of the least doc_id stays, one without a doc_id only if no other has one; of rows with the same doc_id the one
    whose text has the least hash. Null and empty texts have no shingles and are one group; a text of fewer than five words
    is one shingle.
    """
    return keep_one(docs, words=5, similarity=0.8)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a copy, maybe edited, of a benchmark item go; null texts and null or very short items match nothing."""
    return keep_clean(docs, read(spark, sf_dir, "benchmark"))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with their ids, each piece's span of source bytes, and the text that the ids decode to; a null text has no ids and decodes to an empty one."""
    import public_tokenizers

    columns = ["ids", "begins", "ends", "n_tokens", "decoded"]
    return encode(docs, public_tokenizers.path("piece_bpe_32k.model"), columns, {c: fresh(c, docs) for c in columns})


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminate),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can't express the fingerprints and the encoding; the tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. Tables that a stage wrote on its way, and the stage's before it, are deleted once it is written."""
    docs, start = read(spark, sf_dir, "documents"), written()
    for name, stage in STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "_"))
        forget(spark, start)
    return docs
