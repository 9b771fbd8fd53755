"""From raw documents to packed training sequences, in five stages.

Each stage takes (spark, docs, sf_dir), works on all that the stage before it
kept, and returns rows with the columns of documents; the last one returns the
packed pieces.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradespark.llm import language, mixing, nearcopies, packing, quality, simhash
from gradespark.llm.common import shared_folder, table

TOKENIZER = "word_bpe_49k.json"


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language cannot be told (no letter, or too low a score for any language that was learned) go."""
    return language.keep_identified(docs, language.learn(docs))


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the two co-trained views together call bad go."""
    return quality.keep_good(docs, quality.learn(docs, table(spark, sf_dir, "labels")))


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-copies (five-word shingles, a Jaccard similarity of 0.8) the document with the smallest id stays.

    SimHash links and MinHash bands say which texts are compared.
    """
    return simhash.one_of_each_class(docs, nearcopies.jaccard_classes(docs))


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for every time a document is read: each at least once, small sources up to the limit on repetition."""
    return mixing.mix(docs).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences of at most 4,096 tokens."""
    with open(public_tokenizers.path(TOKENIZER), encoding="utf8") as file:
        return packing.pack(packing.token_pieces(docs, file.read()))


STAGES = [
    ("language ID", identify_language),
    ("quality classifier", keep_quality),
    ("near-dedup", drop_copies),
    ("mixing sources", mix_sources),
    ("best-fit packing", pack_sequences),
]
#: Trained models, hashed orders and packing have no SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on ``documents``; each result is written to the shared folder and read again."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark).rstrip('/')}/pipeline-{uuid.uuid4().hex}"
    for number, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{number}")
        docs = spark.read.parquet(f"{folder}/{number}")
    return docs
