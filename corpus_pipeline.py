"""A training corpus from ``documents`` in five stages, each written as Parquet and read again.

Quality classifier (documents that it rejects go), SimHash near-dedup (one document of each group
stays), benchmark decontamination (documents that hold a benchmark passage go), PII (values get
pseudonyms), SentencePiece (each document's ids and the text decoded from them). Extra columns of the
documents, of any name, go through all stages but the last unchanged.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paddock.functions.storage import delete, scratch, stored
from paddock.llm import decontamination, pii, quality_classifier, sentencepiece_bpe, simhash
from paddock.llm.common import packed, table


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier predicts to be good; it learns from the labelled rows of its input. Null and empty texts are scored as empty ones."""
    forest = quality_classifier.fit(docs, table(spark, sf_dir, "labels"))
    return quality_classifier.apply(packed(docs), forest, keep=("__row",)).where("predicted = 1").select("__row.*")


def dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies; documents without an id all stay."""
    return simhash.keep_one(docs)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark passage; null and empty texts hold none."""
    return decontamination.clean(docs, table(spark, sf_dir, "benchmark"))


def private(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with pseudonyms, null ones as empty; ``n_chars`` follows the text."""
    made = pii.pseudonymize(packed(docs), pii.session_key(spark), keep=("__row",))
    new = {"text": F.col("text"), "n_chars": F.length("text")}
    return made.select(*((new[c].cast(docs.schema[c].dataType) if c in new else F.col("__row").getField(c)).alias(c) for c in docs.columns))


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, lang, source, the ids, their number, and the text decoded from them."""
    coded = sentencepiece_bpe.encode_and_decode(docs, public_tokenizers.path("piece_bpe_32k.model"), keep=("doc_id", "lang", "source"))
    return coded.withColumnRenamed("decoded", "text")


STAGES = [("quality", quality), ("dedup", dedup), ("decontaminate", decontaminate), ("pii", private), ("sentencepiece", tokenize)]

#: The stages hold trained trees, components of links and a tokenizer: SQL can't express them
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage. What a stage stored for itself goes when it has ended, its result when the next one has."""
    docs, before = table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch(spark):
            docs = stored(stage(spark, docs, sf_dir), f"stage-{name}", keep=True)
        for path in before:
            delete(spark, path)
        before = sorted({f.rpartition("/")[0] for f in docs.inputFiles()})
    return docs
