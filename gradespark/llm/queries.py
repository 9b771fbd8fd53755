"""The registered queries of this subpackage; each reads the whole of its tables."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from gradespark.llm import codes, conversations, hilbert, language, licenses, mixing, packing, quality, simhash, tokencount, topk, urls, warc
from gradespark.llm.common import table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_warc(spark, folder):
    return warc.read_records(warc.write_archives(table(spark, folder, "pages")))


ORACLES["op1_warc"] = warc.ORACLE


@query
def op2_license_scan(spark, folder):
    return licenses.scan_licenses(table(spark, folder, "documents"))


ORACLES["op2_license_scan"] = licenses.oracle()


@query
def op3_quality_cotraining(spark, folder):
    docs = table(spark, folder, "documents")
    return quality.score_quality(docs, quality.learn(docs, table(spark, folder, "labels")))


@query
def op4_token_counts(spark, folder):
    vocabulary = tokencount.vocabulary_of(public_tokenizers.path("piece_bpe_32k.model"))
    return tokencount.count_tokens(table(spark, folder, "documents"), vocabulary)


@query
def op5_exact_top_k(spark, folder):
    return topk.exact_top_k(table(spark, folder, "embeddings"))


ORACLES["op5_exact_top_k"] = topk.ORACLE


@query
def op6_hilbert_neighbours(spark, folder):
    return hilbert.nearest(table(spark, folder, "embeddings"))


ORACLES["op6_hilbert_neighbours"] = hilbert.ORACLE


@query
def op7_temperature_mixing(spark, folder):
    return mixing.mixture(table(spark, folder, "documents"))


@query
def op8_best_fit_packing(spark, folder):
    with open(public_tokenizers.path("word_bpe_49k.json"), encoding="utf8") as file:
        return packing.pack(packing.token_pieces(table(spark, folder, "documents"), file.read()))


@query
def op9_simhash(spark, folder):
    return simhash.simhash_classes(table(spark, folder, "documents"))


@query
def op10_language(spark, folder):
    docs = table(spark, folder, "documents")
    return language.identify(docs, language.learn(docs))


@query
def op11_vector_codes(spark, folder):
    return codes.compress(table(spark, folder, "embeddings"))


ORACLES["op11_vector_codes"] = codes.ORACLE


@query
def op12_url_filter(spark, folder):
    return urls.judge(table(spark, folder, "pages"), urls.learn(urls.examples(spark)))


ORACLES["op12_url_filter"] = urls.ORACLE


@query
def op13_conversation_repair(spark, folder):
    return conversations.digests(conversations.damage(table(spark, folder, "conversations")), gone_col="gone")


ORACLES["op13_conversation_repair"] = conversations.ORACLE
