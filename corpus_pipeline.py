"""The corpus pipeline: from raw documents to packed sequences.

Each stage takes all rows its predecessor kept and calls one operator of
``numera.llm``; ``run`` writes what a stage returns as Parquet in the shared
folder and reads it again as the next stage's documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from numera.llm import lines, packing, pii, shingles, toxicity
from numera.llm.common import cut, mark, sweep, table


def _measured(docs: DataFrame) -> DataFrame:
    """``n_chars`` follows the text it counts."""
    return docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else docs


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores under its cut; it is fitted on the labelled ones among them.

    A null text is empty and scores like an ordinary clean one; equal texts score alike; an empty table stays empty.
    """
    return toxicity.clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without the lines that an earlier line matches; rows of repeated or missing ids are documents of their own, a null text stays null."""
    return _measured(lines.strip(docs, every_row=True))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document of smallest id of every component of texts with a five-word Jaccard similarity of 0.8 or more.

    Candidates come from the byte-position index of their SimHash fingerprints, as in operator 10, and beyond its two bits from minimum hashes within
    a SimHash radius; all are checked on whole texts.  Null, empty and blank texts are equal; rows without an id all stay, and so do rows repeated under the id that is kept.
    """
    return shingles.keep_one(docs)


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data replaced by its kind in brackets; a null text stays null."""
    return _measured(pii.redact(docs))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The token pieces of all documents and their places in sequences of 2048; a null text is empty, and every row has a piece."""
    return packing.pack(docs, public_tokenizers.path("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", drop_repeated_lines),
    ("SimHash near-dedup", drop_near_duplicates),
    ("PII", hide_personal_data),
    ("best-fit packing", pack_sequences),
]

#: The stages train models and compare fingerprints, which SQL cannot express;
#: tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what a stage has written goes once the next one's documents are there."""
    docs, since = table(spark, sf_dir, "documents"), mark()
    for name, stage in STAGES:
        docs = cut(stage(spark, docs, sf_dir), name.replace(" ", "-"))
        sweep(spark, since)
    return docs


def queries() -> dict:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
