"""The queries of this subpackage: each applies its operator to the whole table it is meant for."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table


def op1_ppm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .ppm import score

    return score(table(spark, sf_dir, "documents"))


def op2_risk_controlled_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .risk_rules import judge

    return judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .skip_chain import find, learn

    docs = table(spark, sf_dir, "documents")
    return find(docs, learn(docs))


def op4_tensored_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .near_dup import link

    return link(table(spark, sf_dir, "documents"), size=2)


def op5_temporal_url_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """pages as captures of the days of 2024 by page_id, against lists that a rule makes of their hosts.

    The tables hold neither fetch days nor lists. A number from the host's (or host and first path part's)
    digest says whether it is listed, from which day, and when it is taken off and put back."""
    from .url_lists import evaluate, host, path

    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    start = F.lit("2024-01-01").cast("date")
    captures = pages.withColumn("fetched", F.date_add(start, (F.col("page_id") % 366).cast("int")))
    h = host(F.col("url"))
    named = pages.select(F.explode(F.array(
        F.struct(F.lit("malware").alias("list"), F.concat(F.lit("host:"), h).alias("entry")),
        F.struct(F.lit("adult").alias("list"), F.concat(F.lit("path:"), h, F.lit("/"), F.element_at(F.split(path(F.col("url")), "/+"), 1)).alias("entry")))).alias("e")).select("e.*").where("entry is not null").distinct()
    number = F.conv(F.substring(F.md5("entry"), 1, 6), 16, 10).cast("int")
    changes = F.array(*(F.struct(F.lit(a).alias("action"), F.lit(d).alias("after"), F.lit(m).alias("every")) for a, d, m in (("add", 0, 4), ("remove", 90, 8), ("add", 150, 16))))
    log = named.withColumn("k", number).withColumn("c", F.explode(changes)).where(F.col("k") % F.col("c.every") == 0).select(
        "list", "entry", "c.action", F.date_add(start, (F.col("k") % 200 + F.col("c.after")).cast("int")).alias("day"))
    return evaluate(captures, log)


def op6_positional_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .positional_index import contamination

    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.drop("items", "spans")


def op7_warc_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc_store import read_archive, write_archive

    return read_archive(write_archive(table(spark, sf_dir, "pages")))


def op8_bit_packed_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .token_file import read_segments, write_segments

    return read_segments(write_segments(table(spark, sf_dir, "documents")))


def op9_pattern_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op10_nb_svm_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .nbsvm import classify, train

    docs = table(spark, sf_dir, "documents")
    return classify(docs, train(docs, table(spark, sf_dir, "labels")))


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .periodic_runs import find

    return find(table(spark, sf_dir, "documents"), plant=True)


def op12_block_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .block_names import deduplicate

    return deduplicate(table(spark, sf_dir, "documents"))


def op13_turn_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .turn_repair import damaged, repair

    conversations = table(spark, sf_dir, "conversations")
    return repair(damaged(conversations), conversations)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (op1_ppm_scores, op2_risk_controlled_rules, op3_skip_chain_pii, op4_tensored_minhash, op5_temporal_url_lists, op6_positional_decontamination, op7_warc_store, op8_bit_packed_tokens, op9_pattern_packing, op10_nb_svm_quality, op11_periodic_runs,
              op12_block_names, op13_turn_repair)
}
