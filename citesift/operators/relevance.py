"""Which documents hold a query's text: relevance labels for a table of passages.

A passage is in a document if its words stand there in order. Both sides are cut into short runs of
words. A passage is looked up by its rarest run, which tells where in a document it would have to
start; only the words there are compared, by their digest. Texts of passages never leave their row,
texts of documents meet places by document id, and copies of a passage are looked up once.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.functions.text import words
from citesift.session import work_dir, write_and_read

ANCHOR_WORDS = 5
# A run is tested against one bit; the filter has this many bits per run, 64 MB at most.
BITS_PER_RUN = 16
LEAST_FILTER_BITS, MOST_FILTER_BITS = 1 << 20, 1 << 29
# 64-bit numbers in a row of the filter.
PART_NUMBERS = 512
# Bytes that are sent to every executor at most. A key is a row of fixed size.
BROADCAST_BYTES = 64 << 20
KEY_BYTES = 160


def relevant_documents(queries: DataFrame, documents: DataFrame, anchor: int = ANCHOR_WORDS) -> DataFrame:
    """Distinct ``query_id, doc_id`` where the document's words contain the query's words.

    Passages shorter than the anchor are one run. Runs of documents pass a bit filter of the passages'
    runs before they are shuffled or written; what it lets through by chance finds no key. A passage
    with a run that stands nowhere is in no document and goes. Frequencies are counted once, from the
    written runs. Keys and places are broadcast up to ``BROADCAST_BYTES``, and joined by shuffles beyond,
    where AQE splits a run that many copies share. Blank passages are in no document; rows without an
    id have no partner.
    """
    spark = queries.sparkSession
    folder = f"{work_dir(spark)}/anchored/{uuid.uuid4().hex}"
    asked = queries.select("query_id", words(F.col("query")).alias("w")).where(F.size("w") > 0)
    asked = asked.select("query_id", "w", F.size("w").alias("length"), _digest(F.col("w")).alias("passage"))

    lengths = asked.select(F.least(F.lit(anchor), "length").alias("n")).distinct()
    lengths = sorted(r["n"] for r in lengths.collect())  # at most ``anchor`` rows
    if not lengths:
        return queries.select("query_id", F.lit("").alias("doc_id")).where(F.lit(False))
    cut = F.least(F.lit(anchor), F.size("w"))
    runs = F.transform(
        F.sequence(F.lit(0), F.size("w") - cut),
        lambda i: F.struct(i.alias("offset"), F.xxhash64(F.slice("w", i + 1, cut)).alias("run")),
    )
    passage_runs = (
        asked.select("passage", "length", F.explode(runs).alias("r"))
        .select("passage", "length", "r.offset", "r.run")
        .distinct()
    )
    passage_runs = write_and_read(passage_runs, f"{folder}/passage-runs")

    placed = _runs_of(documents, lengths)
    placed = write_and_read(_maybe_in(placed, passage_runs), f"{folder}/document-runs")

    keys = write_and_read(_rarest(passage_runs, placed), f"{folder}/keys")
    n_keys = keys.count()
    if n_keys * KEY_BYTES <= BROADCAST_BYTES:
        keys = F.broadcast(keys)
    places = (
        placed.join(keys, "run")
        .where("start >= offset")
        .select("doc_id", (F.col("start") - F.col("offset")).alias("start"), "length", "passage")
    )
    places = write_and_read(places, f"{folder}/places")
    sent = places.agg(F.coalesce(F.sum(F.octet_length("doc_id") + KEY_BYTES), F.lit(0))).first()[0]
    held = places.select("doc_id").distinct()
    if sent <= BROADCAST_BYTES:
        places, held = F.broadcast(places), F.broadcast(held)
    found = (
        documents.join(held, "doc_id", "left_semi")  # only their words are needed
        .select("doc_id", words(F.col("text")).alias("w"))
        .join(places, "doc_id")
        .where(_digest(F.slice("w", F.col("start") + 1, F.col("length"))) == F.col("passage"))
        .select("doc_id", "passage")
        .distinct()
    )
    return found.join(asked.select("query_id", "passage"), "passage").select("query_id", "doc_id").distinct()


def _runs_of(documents: DataFrame, lengths: list[int]) -> DataFrame:
    """``doc_id, start, run``: all runs of the given lengths in the words of a document.

    Only places are made rows: the words stay a variable of the loop over them that Spark generates.
    """
    w, start, n = F.col("w"), F.col("start"), F.col("n")
    starts = F.when(F.size("w") >= n, F.sequence(F.lit(0), F.size("w") - n))
    sized = documents.select("doc_id", words(F.col("text")).alias("w")).select("doc_id", "w", F.explode(F.lit(lengths)).alias("n"))
    placed = sized.select("doc_id", "w", "n", F.explode(starts).alias("start"))
    return placed.select("doc_id", "start", F.xxhash64(F.slice(w, start + 1, n)).alias("run"))


def _maybe_in(placed: DataFrame, passage_runs: DataFrame) -> DataFrame:
    """The rows whose run sets a bit of the passages' filter: all that match, and few others.

    The filter is a table of bits in 64-bit numbers, broadcast whole: its size is fixed by ``bits``.
    """
    n = passage_runs.count()
    bits = min(MOST_FILTER_BITS, max(LEAST_FILTER_BITS, 1 << (n * BITS_PER_RUN).bit_length()))
    place = F.pmod("run", F.lit(bits))
    part, number = F.expr(f"_place div {64 * PART_NUMBERS}"), F.expr(f"cast(_place div 64 % {PART_NUMBERS} as int)")
    numbers = (
        passage_runs.select(place.alias("_place"))
        .groupBy(part.alias("_part"), number.alias("at"))
        .agg(F.expr("bit_or(shiftleft(1L, cast(_place % 64 as int)))").alias("x"))
        .groupBy("_part")
        .agg(F.map_from_entries(F.collect_list(F.struct("at", "x"))).alias("m"))
    )
    every = F.sequence(F.lit(0), F.lit(PART_NUMBERS - 1))
    filled = numbers.select("_part", F.transform(every, lambda i: F.coalesce(F.col("m")[i], F.lit(0).cast("long"))).alias("_bits"))
    return (
        placed.withColumn("_place", place)
        .withColumn("_part", part)
        .join(F.broadcast(filled), "_part")
        .where(F.getbit(F.element_at("_bits", number + 1), F.expr("cast(_place % 64 as int)")) == 1)
        .select(*placed.columns)
    )


def _rarest(passage_runs: DataFrame, placed: DataFrame) -> DataFrame:
    """``passage, length, offset, run``: the run of each passage that stands in the fewest places."""
    frequency = placed.groupBy("run").agg(F.count(F.lit(1)).alias("n"))
    best = F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "run")).alias("best")
    return (
        passage_runs.join(frequency, "run", "left")
        .groupBy("passage", "length")
        .agg(best)
        .where("best.n > 0")
        .select("passage", "length", "best.offset", "best.run")
    )


def _digest(w: Column) -> Column:
    return F.sha2(F.array_join(w, " ").cast("binary"), 256)
