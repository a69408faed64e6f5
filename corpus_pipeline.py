"""From raw documents to token ids: five stages, each a table that the next one reads.

Every stage takes ``(spark, docs, sf_dir)`` and works on all its predecessor kept.  All but the last return the
columns of ``documents``, and further columns of any name.  An empty table gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilframe.llm import bpe, common, decontaminate, langid, pii, simhash

#: A document stays if one learned language makes up at least this share of it.
LEAST_SHARE = 0.5


def numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The table with columns ``c0``, ``c1``..., which no operator's result clashes with, and their names by the old ones."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def named(rows: DataFrame, names: dict[str, str]) -> DataFrame:
    return rows.select(*(F.col(new).alias(old) for old, new in names.items()))


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without letters and those of which no learned language makes up half.

    Null texts have no letters.  Null and repeated ids are judged row by row.
    """
    model = langid.fit(docs.where(~langid.held_out(docs["doc_id"])))
    rows, names = numbered(docs)
    rest = tuple(c for c in rows.columns if c != names["doc_id"])
    judged = langid.predict_languages(rows, model, names["doc_id"], names["text"], rest)
    return named(judged.where((F.col("lang_pred") != langid.UNDETERMINED) & (F.col("score") >= LEAST_SHARE)), names)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps, of each class of documents with a five-word similarity of 0.8 or more, the one of smallest id.

    SimHash's index proposes pairs, exact similarity judges them.  Rows are judged, not ids: an id may occur with different
    texts, a null id comes last, of repeated rows one stays, and null and blank texts are one class.
    """
    return simhash.keep_similar(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents in which a benchmark window occurs; null texts, null and repeated ids stay."""
    rows, names = numbered(docs)
    rest = tuple(c for c in rows.columns if c != names["doc_id"])
    found = decontaminate.find_contamination(rows, common.table(spark, sf_dir, "benchmark"), names["doc_id"], names["text"], keep=rest)
    return named(found.where(~F.col("contaminated")), names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces personal data by its kind; ``n_chars`` follows the text.  A null text stays null."""
    masked = pii.mask(docs)
    return masked.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids (little-endian unsigned 32-bit integers) with the digest of what they decode to; a null text has none."""
    return bpe.encode_documents(docs, public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("personal_data", mask_personal_data),
    ("bpe", encode),
]

#: SQL cannot express the mixture model, the fingerprints or the encoding; the tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = common.materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
