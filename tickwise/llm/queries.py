"""Registered queries of the training-data operators and the SQL of those that SQL can express."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickwise.llm import bpe, chatformat, decontam, hardneg, htmlmain, langid, neardup, packing, quality, tokencount, toxicity, urlfilter, vqcodes
from tickwise.llm.common import held_out, learnable, stash, table

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PATTERN = public_tokenizers.PATTERN
PIECES = public_tokenizers.path("piece_bpe_32k.model")
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")
# The url rules of the query.
URL_RULES = [("net/", "block"), ("example.net/en/", "allow"), ("example.com/de/", "block"), ("org/fr/", "allow")]


def op1_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.fit(docs.where(learnable(F.col("doc_id"))))
    found = langid.predict(docs.select("doc_id", "text"), model)
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op2_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chatformat.rotate(table(spark, sf_dir, "conversations"))


def op3_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return tokencount.count_tokens(docs, PIECES).select("doc_id", "n_words", "n_tokens", F.round("score", 6).alias("score"))


def toxic_field(spark: SparkSession, sf_dir: str, docs: DataFrame):
    """The field fitted on the labelled rows of ``docs`` that may be learned from."""
    labels = table(spark, sf_dir, "labels").where(learnable(F.col("doc_id"))).select("doc_id", "toxic")
    return toxicity.fit_labelled(docs.select("doc_id", "text"), labels)


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.score(docs, toxic_field(spark, sf_dir, docs))
    return scored.select(
        "doc_id",
        held_out(F.col("doc_id")).alias("held_out"),
        "score",
        (F.col("score") >= toxicity.REJECT).cast("int").alias("predicted"),
        F.size("spans").alias("n_spans"),
    )


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    weights = urlfilter.fit(urlfilter.labelled_urls(spark))
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return urlfilter.judge(pages, weights, URL_RULES).select("page_id", "host", "path", "rule", "verdict", F.round("score", 6).alias("score"))


def op6_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.groups(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(F.col("id").alias("doc_id"), "n_shingles", "component_id", (F.col("id") == F.col("component_id")).alias("kept"))


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return htmlmain.extract(pages).select("page_id", "url", "text", F.length("text").cast("long").alias("n_chars"))


def op8_decontam(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontam.contamination(docs, table(spark, sf_dir, "benchmark"))
    digest = F.sha2(F.array_join("items", ","), 256)
    return found.select("doc_id", "n_words", "n_hit", "n_items", digest.alias("items_sha256"), "contaminated")


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.decode(bpe.encode(docs, RANKS, PATTERN).drop("text"), RANKS)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = quality.fit(docs, quality.trusted_ids(table(spark, sf_dir, "labels")))
    found = quality.judge(docs, model)
    return found.select("doc_id", *[c for c in quality.ADDED if c != "ratio"], F.round("ratio", 6).alias("ratio"))


def op11_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    books = vqcodes.fit(vectors)
    coded = stash(vqcodes.encode(vectors, books).select("vec_id", "label", "codes", "error"), "codes")
    digits = F.transform("codes", lambda c: F.lower(F.lpad(F.hex(c), 2, "0")))
    found = vqcodes.with_group_total(coded, "label", "error", "label_error")
    return found.select("vec_id", F.array_join(digits, "").alias("code"), "error", "label_error", F.sha2(F.lit(books.text()).cast("binary"), 256).alias("codebooks_sha256"))


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    changed = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hardneg.mine(vectors.withColumn("label", changed), F.col("vec_id") % 50 == 0)


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cut = stash(packing.pieces(docs, VOCABULARY), "pieces")
    return packing.pack(cut).select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {
    f.__name__: f
    for f in (op1_language, op2_chat, op3_tokens, op4_toxicity, op5_urls, op6_neardup, op7_html, op8_decontam, op9_bpe, op10_quality, op11_codes, op12_negatives, op13_packing, pipeline)
}

ORACLE = {"op2_chat": chatformat.ORACLE, "op11_codes": vqcodes.ORACLE, "op12_negatives": hardneg.ORACLE}
