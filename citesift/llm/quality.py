"""Host-level quality rules: documents are judged by how often their host breaks rules.

1. Every whole text is measured in one pass (Arrow task): words, symbols, repeated lines, words in
   repeated three-word windows.
2. A document breaks a rule, or not. Failures are counted per host (map-side sums, so a host with a
   third of all rows is a few rows per task).
3. The failure rate of a host with few documents says little. Rates are shrunk towards the common
   one with a beta prior whose mean and strength are fitted to all hosts by the method of moments.
4. Hosts whose shrunken rate exceeds ``MAX_HOST_RATE`` are rejected, and the verdict is joined back
   to their documents.

Defined cases: a NULL text counts as empty; rows with a NULL host form one host of their own;
repeated rows count as often as they occur; an empty table gives an empty result; a single host, or
hosts that all fail equally often, have a defined prior (see ``fit_prior``).
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import column, fresh, small, stored, text_bytes
from citesift.llm.texts import WHITE_SPACE, WordHashes, windows, word_hashes

SYMBOLS = b"#*$%&|<>"
MIN_WORDS = 50
MAX_HOST_RATE = 0.5
MIN_STRENGTH, MAX_STRENGTH = 2.0, 1e6

MEASURES = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines"]
MEASURES_TYPE = "struct<" + ",".join(f"{m}:bigint" for m in MEASURES) + ">"


def repeated_words(hashes: np.ndarray) -> int:
    """Words inside three-word windows that occur at least twice in the text."""
    found = windows(hashes, 3)
    if not len(found):
        return 0
    _, place, count = np.unique(found, return_inverse=True, return_counts=True)
    again = count[place] >= 2
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(again)] |= again
    return int(covered.sum())


def measure_text(data: bytes, n_chars: int, known: WordHashes) -> tuple[int, ...]:
    hashes = word_hashes(data, known)
    lines = [line for line in data.split(b"\n") if line.strip()]
    return (
        len(hashes),
        n_chars - (len(data) - len(data.translate(None, WHITE_SPACE))),
        len(data) - len(data.translate(None, SYMBOLS)),
        len(lines) - len(set(lines)),
        repeated_words(hashes),
        len(lines),
    )


def _measure(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = WordHashes()
    for batch in batches:
        chars = pc.utf8_length(batch.cast(pa.string())).to_pylist()
        rows = [measure_text(d.as_py(), n, known) for d, n in zip(batch, chars)]
        columns = zip(*rows) if rows else [[] for _ in MEASURES]
        yield pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], MEASURES)


def measures(text: str = "text") -> Column:
    """Struct of ``MEASURES``. Marked as not deterministic so that a filter does not compute it twice."""
    return F.arrow_udf(_measure, MEASURES_TYPE).asNondeterministic()(text_bytes(text))


def base_failed(m: Column) -> Column:
    """Too short, or mostly repeated windows."""
    return (m["n_words"] < MIN_WORDS) | (100 * m["n_repeat_words"] > 50 * m["n_words"])


def breaks_rule(m: Column) -> Column:
    """The base rules, many symbols, many repeated lines, words of unlikely length."""
    return (
        base_failed(m)
        | (10 * m["n_symbols"] > m["n_words"])
        | (10 * m["n_dup_lines"] > 3 * m["n_lines"])
        | (m["word_chars"] < 3 * m["n_words"])
        | (m["word_chars"] > 12 * m["n_words"])
    )


class Prior(NamedTuple):
    mean: float
    strength: float


def fit_prior(hosts: DataFrame) -> Prior:
    """Beta prior of the hosts' failure rates, from two numbers: their mean and their variance.

    Strength is ``mean * (1 - mean) / variance - 1`` within ``MIN_STRENGTH`` and ``MAX_STRENGTH``; no
    variance between hosts means full pooling, and a single host the weakest prior.
    """
    rate = F.col("n_failed") / F.col("n_docs")
    mean, variance = hosts.agg(F.avg(rate), F.var_samp(rate)).first()
    if mean is None or variance is None:
        return Prior(mean or 0.0, MIN_STRENGTH)
    if variance == 0:
        return Prior(mean, MAX_STRENGTH)
    return Prior(mean, min(MAX_STRENGTH, max(MIN_STRENGTH, mean * (1 - mean) / variance - 1)))


def host_verdicts(hosts: DataFrame, max_rate: float = MAX_HOST_RATE) -> DataFrame:
    """``host, n_docs, n_failed`` with ``host_rate`` (shrunken) and ``host_rejected``."""
    prior = fit_prior(hosts)
    rate = (F.col("n_failed") + F.lit(prior.mean * prior.strength)) / (
        F.col("n_docs") + F.lit(prior.strength)
    )
    return hosts.withColumn("host_rate", rate).withColumn("host_rejected", rate > max_rate)


def count_failures(rows: DataFrame, host: Column, failed: Column) -> DataFrame:
    return rows.groupBy(host.alias("host")).agg(
        F.count(F.lit(1)).alias("n_docs"), F.sum(failed.cast("bigint")).alias("n_failed")
    )


def keep_good(
    docs: DataFrame, text: str = "text", host: str = "source", max_rate: float = MAX_HOST_RATE
) -> DataFrame:
    """The documents that pass the base rules and whose host is not rejected, columns unchanged.

    Texts are measured twice, once for the hosts and once for the documents: cheaper than storing
    every text again. Only rejected hosts take part in the last join.
    """
    m, h = fresh(docs, "measured"), fresh(docs, "host_key")
    slim = docs.select(column(host).alias(h), measures(text).alias(m))
    hosts = count_failures(slim, F.col(h), breaks_rule(F.col(m)))
    rejected = host_verdicts(hosts, max_rate).where("host_rejected").select(F.col("host").alias(h))
    rejected = stored(rejected, "rejected-hosts")
    rejected = small(rejected, rejected.count(), 200)  # texts are shuffled only beyond that
    kept = docs.withColumn(m, measures(text)).where(~base_failed(F.col(m)))
    kept = kept.select([column(c) for c in docs.columns])
    return kept.join(rejected, column(host).eqNullSafe(F.col(h)), "left_anti")
