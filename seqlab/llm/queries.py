"""Registered queries of the corpus operators: each runs its operator over the whole tables it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from seqlab.llm import phrase_mining, quality_rules, url_lists

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def register(name: str, sql: str | None = None):
    def add(build):
        QUERIES[name] = build
        if sql:
            ORACLES[name] = sql
        return build

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


@register("op2_winnowing_decontamination")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.decontamination import decontaminate

    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@register("op3_hilbert_sharding")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.sharding import shard_documents

    return shard_documents(table(spark, sf_dir, "documents"))


@register("op4_warc_index_merge")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.warc import archive_pages

    return archive_pages(table(spark, sf_dir, "pages"))


@register("op7_vertical_jaccard_join")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.jaccard_join import jaccard_components

    return jaccard_components(table(spark, sf_dir, "documents"))


@register("op8_bpe_automaton")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    from seqlab.llm.bpe import encode_documents

    return encode_documents(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


@register("op1_line_quality_rules", quality_rules.ORACLE)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules.quality_rules(table(spark, sf_dir, "documents"))


@register("op9_temporal_url_lists", url_lists.ORACLE)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return url_lists.temporal_list_join(url_lists.page_captures(pages), url_lists.list_entries(pages))


@register("op5_attention_quality")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.mil_quality import classify_quality

    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op10_ordinal_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.toxicity import classify_toxicity

    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@register("op6_katz_backoff")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.katz import score_documents

    return score_documents(table(spark, sf_dir, "documents"))


@register("op13_periodic_runs")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.periodic_runs import periodic_runs, planted_periods, run_digests

    return run_digests(periodic_runs(table(spark, sf_dir, "documents"), rewrite=planted_periods))


@register("op12_html_host_suffix_array")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from seqlab.llm.html_extraction import main_text

    return main_text(table(spark, sf_dir, "pages"))


@register("op11_toivonen_phrases", phrase_mining.ORACLE)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrase_mining.mine_phrases(table(spark, sf_dir, "documents"))
