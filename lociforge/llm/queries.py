"""The queries of this subpackage, with production parameters over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .ann import search
from .common import documents, tokenizer_path
from .decision_list import judge, labelled, learn
from .divergence import ORACLE as DIVERGENCE_ORACLE
from .divergence import source_divergence
from .licences import scan_licences
from .minhash import ORACLE as MINHASH_ORACLE
from .minhash import minhash_groups
from .mixing import mix_words
from .ngram_join import ORACLE as JACCARD_ORACLE
from .ngram_join import jaccard_groups
from .packing import pack
from .prefix_trie import ORACLE as TRIE_ORACLE
from .prefix_trie import conversation_trie
from .repair import round_trip
from .toxicity import fit_chain, score_chain
from .url_filter import ORACLE as URL_ORACLE
from .url_filter import judge_urls, listed_urls
from .warc import ORACLE as WARC_ORACLE
from .warc import round_trip as warc_round_trip


def op6_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir), tokenizer_path())


def op8_repair_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(documents(spark, sf_dir), tokenizer_path())


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_toxicity_chain(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return score_chain(docs, fit_chain(docs, labels(spark, sf_dir)))


def op3_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_groups(documents(spark, sf_dir))


def op10_decision_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    return judge(docs, learn(labelled(docs, labels(spark, sf_dir))))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/pages.parquet")


def op2_mixture_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_words(documents(spark, sf_dir))


def op7_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = pages(spark, sf_dir)
    return judge_urls(p, listed_urls(p, labels(spark, sf_dir)))


def op4_warc_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_round_trip(pages(spark, sf_dir))


def op5_projected_kdtree(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op9_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(documents(spark, sf_dir))


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op12_minhash_bayes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_groups(documents(spark, sf_dir))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity_chain": op1_toxicity_chain,
    "op2_mixture_tree": op2_mixture_tree,
    "op3_ngram_jaccard": op3_ngram_jaccard,
    "op4_warc_chunks": op4_warc_chunks,
    "op5_projected_kdtree": op5_projected_kdtree,
    "op6_harmonic_packing": op6_harmonic_packing,
    "op7_url_filter": op7_url_filter,
    "op8_repair_shards": op8_repair_shards,
    "op9_licence_scan": op9_licence_scan,
    "op10_decision_list": op10_decision_list,
    "op11_prefix_trie": op11_prefix_trie,
    "op12_minhash_bayes": op12_minhash_bayes,
    "op13_source_divergence": op13_source_divergence,
}

ORACLES: dict[str, str] = {
    "op3_ngram_jaccard": JACCARD_ORACLE,
    "op4_warc_chunks": WARC_ORACLE,
    "op7_url_filter": URL_ORACLE,
    "op11_prefix_trie": TRIE_ORACLE,
    "op12_minhash_bayes": MINHASH_ORACLE,
    "op13_source_divergence": DIVERGENCE_ORACLE,
}
