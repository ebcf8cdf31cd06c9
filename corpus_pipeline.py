"""From raw documents to packed training sequences, in five stages."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusmill.llm.jaccard import similar
from corpusmill.llm.op01 import LAST_ID, SIZE, tokenizer_spec
from corpusmill.llm.op05 import SAMPLE, THRESHOLD
from corpusmill.llm.op10 import KEY
from corpusmill.llm.packing import pack
from corpusmill.llm.private import pseudonymise
from corpusmill.llm.quality import judge, train
from corpusmill.llm.registry import table
from corpusmill.llm.repeats import removed
from corpusmill.session import materialize

#: A passage of over 50 words repeats: strings of this many bytes find it, if its words have three letters on average,
#: and runs with fewer words are left alone.
PASSAGE_BYTES, PASSAGE_WORDS = 200, 50

#: No SQL: a trained classifier decides in the first stage.
ORACLE_SQL = None


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Reject documents that fail the base rules or the classifier, trained on labelled ones among them."""
    model = train(docs, table(spark, sf_dir, "labels"), SAMPLE)
    whole = docs.select(F.struct("*").alias("row"), "text")
    return judge(whole, model, THRESHOLD).where("kept").select("row.*")


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document with the smallest id of each group of similar ones.

    Documents without an id are kept; of rows that repeat id and text one is.
    """
    kept = similar(docs.select("doc_id", "text")).where("kept").select("doc_id").distinct()
    found = docs.join(kept, "doc_id", "left_semi").dropDuplicates(["doc_id", "text"])
    return found.select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def suffix_array_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words that occur elsewhere out of the texts; a document may be left empty."""
    others = [c for c in docs.columns if c != "text"]
    return with_length(removed(docs, keep=others, size=PASSAGE_BYTES, words=PASSAGE_WORDS, texts=True), docs)


def private_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Put pseudonyms in the place of personal data."""
    return with_length(pseudonymise(docs, KEY, found=None), docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack the token ids of all texts into sequences."""
    return pack(docs.select("doc_id", "text"), tokenizer_spec(), SIZE, LAST_ID).drop("row_id")


def with_length(found: DataFrame, docs: DataFrame) -> DataFrame:
    """The columns of ``docs``, with the length of the new text."""
    if "n_chars" in docs.columns:
        found = found.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return found.select(*docs.columns)


STAGES = [
    ("quality rules", quality_rules),
    ("n-gram Jaccard join", jaccard_join),
    ("suffix-array dedup", suffix_array_dedup),
    ("PII", private_data),
    ("packing", packing),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES):
        docs = materialize(stage(spark, docs, sf_dir), f"stage{number}")
    return docs
