"""The registered queries of this subpackage: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm import chat, forest, linededup, mixing, neardup, packing, pieces, pii, quality, runs, search, sharding, toxicity
from citesift.llm.frames import small_batches, stored, text_bytes

NEIGHBOURS = 5
TOXIC_FROM = 0.3

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_interleaved_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    data = text_bytes("text")
    rows = docs.select(
        "doc_id",
        "source",
        (F.length(data) + 1).cast("bigint").alias("size"),
        F.crc32(data).alias("text_crc32"),
    )
    sharded = sharding.interleave(rows, ties=("text_crc32", "size"))
    return sharded.select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("rows").alias("law"),
        "shard",
        "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query
def op2_streaming_viterbi(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return coded(docs)


def coded(docs: DataFrame) -> DataFrame:
    """``doc_id, n_ids, ids, exact``: ids of the text, and whether they decode to it."""
    found = docs.select("doc_id", pieces.round_trip(docs.sparkSession, F.col("text")).alias("found"))
    ids = F.col("found.ids")
    return found.select("doc_id", F.size(ids).cast("bigint").alias("n_ids"), ids.alias("ids"), "found.exact")


@query
def op3_template_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    cleaned = linededup.drop_recurring_lines(docs)
    return cleaned.select(
        "doc_id",
        F.size(F.split("text", "\n")).cast("bigint").alias("n_lines_kept"),
        F.length("text").cast("bigint").alias("n_chars_kept"),
        F.md5(F.col("text").cast("binary")).alias("text_md5"),
    )


@query
def op4_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    more = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], turns.schema)
    return chat.digest(chat.chat_examples(turns.unionByName(more)))


@query
def op5_hyperminhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).drop("text_key")


def domain_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Complete rows of the labelled table with the domain they stand for."""
    labels = table(spark, sf_dir, "labels").dropna(subset=["doc_id", "quality", "toxic"])
    return labels.select("doc_id", mixing.domain_of(F.col("quality"), F.col("toxic")).alias("domain"))


@query
def op8_soft_mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("text_key", F.xxhash64(text_bytes("text")))
    member, m, rate = mixing.mixing_rates(docs, domain_labels(spark, sf_dir), carry=["doc_id", "text_key"])
    copies = mixing.copies_of(F.col("rate"), F.col("doc_id"), F.col("text_key"))
    domains = sorted(mixing.TARGETS)
    return member.withColumn("rate", rate).select(
        "doc_id",
        m["n_tokens"].alias("n_tokens"),
        *[(m["posterior"][i] / mixing.GRAIN).alias(f"p_{d}") for i, d in enumerate(domains)],
        "rate",
        copies.alias("copies"),
    )


@query
def op6_projection_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", "embedding")
    return forest.nearest(rows, F.col("vec_id") % 50 == 0, NEIGHBOURS)


@query
def op7_recurrent_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")) % 4 == 2
    labels = table(spark, sf_dir, "labels").where(~held_out)
    model = toxicity.trained(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    scored = docs.withColumn("score", toxicity.scores(spark, model, text_bytes("text")))
    return scored.select(
        "doc_id",
        held_out.alias("held_out"),
        "score",
        (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"),
    )


@query
def op9_host_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    m = F.col("m")
    measured = stored(
        docs.select("doc_id", F.col("source").alias("host"), quality.measures("text").alias("m")),
        "measures",
    )
    failed = quality.count_failures(measured, F.col("host"), quality.breaks_rule(m))
    verdicts = quality.host_verdicts(failed).select(
        F.col("host").alias("of"), "host_rate", "host_rejected"
    )
    return measured.join(verdicts, F.col("host").eqNullSafe(F.col("of"))).select(
        "doc_id",
        *[m[c].alias(c) for c in quality.MEASURES],
        quality.base_failed(m).alias("base_failed"),
        F.round("host_rate", 6).alias("host_rate"),
        (~quality.base_failed(m) & ~F.col("host_rejected")).alias("kept"),
    )


@query
def op10_bootstrapped_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = pii.personal_data(docs)
    return found.select(
        "doc_id",
        *[pii.count_kind("base", kind).alias(f"n_{kind}") for kind in pii.KINDS],
        F.sha2(pii.written(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        pii.written(F.col("spans")).alias("spans"),
        pii.count_kind("spans", pii.SECRET).alias("n_secret"),
        pii.count_kind("spans", pii.LEARNED).alias("n_learned"),
    )


@query
def op11_diagonal_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    seed = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary"))
    found = docs.select("doc_id", runs.periodic_runs(text_bytes("text"), seed).alias("found")).select("doc_id", "found.*")
    lines = F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"]))
    written = F.array_join(F.transform(lines, lambda x: F.concat(x, F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("bigint").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(written.cast("binary"), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_pipelined_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    return search.ranked_search(docs, items)


@query
def op13_concatenate_and_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pieces_ = packing.pack(docs)
    return pieces_.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )
