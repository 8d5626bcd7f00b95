"""The registered queries of the corpus operators over the driver tables, with their SQL where it can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from lumensift.llm import sqltext, sqltext_rows
from lumensift.llm.common import tables
from lumensift.llm.conversation import damage, report
from lumensift.llm.decontaminate import contamination
from lumensift.llm.html_extract import extract
from lumensift.llm.importance import resample
from lumensift.llm.langid import held_out, identify, learn_from
from lumensift.llm.licenses import scan
from lumensift.llm.near_dup import classes
from lumensift.llm.pack import pack_documents
from lumensift.llm.quality import judge
from lumensift.llm.shards import shard_documents
from lumensift.llm.substring_dedup import dedup_report
from lumensift.llm.topk import top_k
from lumensift.llm.url_filter import Rule, filter_urls, host_of, path_of
from lumensift.session import ship_package

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

URL_RULES = (Rule("block", "com", "/en/"), Rule("allow", "example.com", "/en/7"), Rule("allow", "net", "/de/"), Rule("block", "example.net", "/de/8"), Rule("block", "org", "/es/"))


def _query(fn):
    def run(spark, sf_dir):
        ship_package(spark)
        return fn(spark, sf_dir)

    QUERIES[fn.__name__] = run
    for sql in (sqltext.SQL, sqltext_rows.SQL):
        if fn.__name__ in sql:
            ORACLES[fn.__name__] = sql[fn.__name__]
    return fn


@_query
def op1_exact_topk(spark, sf_dir):
    (vectors,) = tables(spark, sf_dir, "embeddings")
    return top_k(vectors, F.col("vec_id") % 20 == 0, k=20)


@_query
def op2_probminhash_classes(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return classes(docs)


@_query
def op3_rendezvous_shards(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return shard_documents(docs, 16)


@_query
def op4_substring_dedup(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return dedup_report(docs)


@_query
def op5_decontamination(spark, sf_dir):
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return contamination(docs, benchmark)


@_query
def op6_license_scan(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return scan(docs)


@_query
def op7_best_fit_packing(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return pack_documents(docs, tokenizer_path())


def tokenizer_path() -> str:
    """The public tokenizer file that packing counts tokens with."""
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@_query
def op8_url_reputation(spark, sf_dir):
    pages, labels = tables(spark, sf_dir, "pages", "labels")
    return filter_urls(pages, page_outcomes(pages, labels), URL_RULES)


def page_outcomes(pages: DataFrame, labels: DataFrame) -> DataFrame:
    """host, bad: the labels of the document that a page's path ends in; bad is toxic or of low quality."""
    number = F.regexp_extract(path_of(F.col("url")), "/([0-9]{1,18})(?:/|[.]html)?$", 1)
    shown = pages.select(host_of(F.col("url")).alias("host"), F.when(number != "", number).cast("bigint").alias("doc_id"))
    bad = F.when((F.col("toxic") == 1) | (F.col("quality") == 0), 1).when(F.col("toxic").isNotNull() | F.col("quality").isNotNull(), 0)
    return shown.where(F.col("doc_id").isNotNull()).join(labels.select("doc_id", bad.alias("bad")), "doc_id").select("host", "bad")


@_query
def op9_language_mixture(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    d = identify(docs.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out")), learn_from(docs))
    return d.select("doc_id", "held_out", "lang_pred", "score")


@_query
def op10_article_text(spark, sf_dir):
    (pages,) = tables(spark, sf_dir, "pages")
    return extract(pages)


@_query
def op11_importance_resampling(spark, sf_dir):
    docs, benchmark = tables(spark, sf_dir, "documents", "benchmark")
    return resample(docs, benchmark).select("doc_id", "n_features", "weight", "score", "rank")


@_query
def op12_adaptive_quality(spark, sf_dir):
    (docs,) = tables(spark, sf_dir, "documents")
    return judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


@_query
def op13_conversation_repair(spark, sf_dir):
    (turns,) = tables(spark, sf_dir, "conversations")
    return report(damage(turns), turns)
