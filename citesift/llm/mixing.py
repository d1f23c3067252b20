"""Mixing to target weights with soft domain membership.

Domains are classes of the labelled table. A classifier fitted to labelled documents gives every
document a posterior over domains, so a document counts towards all of them in part. Rates ``w`` per
document are the nonnegative least-squares answer to "expected tokens per domain = target":

    minimise  1/2 * r' inv(M) r,   r_c = sum_i w_i t_i p_ic / T - target_c,   w >= 0

with t tokens, p posteriors, T all tokens and M = sum_i t_i p_i p_i' / T, the overlap of the domains
(pseudo-inverse if singular). If the targets can be met, r = 0 under any such weighting, and of all such
rates those nearest to 1 (in sum_i t_i (w_i - 1)^2) are taken: w_i = max(0, 1 - pull . p_i), one number of
``pull`` per domain. The rate of a document depends on its posterior alone.

- The classifier is a softmax model over hashed words and four measures of form. It is fitted in
  numpy on at most ``SAMPLE_PER_DOMAIN`` labelled documents per domain, drawn by hash order and
  weighted back to the labelled shares. Documents are turned into features inside tasks; the driver gets
  ``N_BUCKETS`` counts per sampled document at most, never texts.
- Posteriors are stated in thousandths. All documents with the same posterior have the same rate, so
  tokens are first summed per posterior (map-side); that table has at most C(1002, 2) rows for three
  domains, whatever the corpus. Every projected gradient step is one aggregate over it and brings back, for each length
  tried, one number per domain and pair of domains. There is no cap on steps, and ``Fit`` has the shares reached
  next to the targets; what cannot be met, as with a domain that no document belongs to, is a warning.
- A rate is turned into whole copies by a hash of the row: ``floor(rate + u)``.

Defined cases: NULL texts are empty and have no tokens; labels with a NULL in any column, or for unknown documents,
are ignored; without any label, posteriors are equal; a domain without labels has posterior 0, and
its target cannot be met (least squares then goes for the nearest mixture, and a warning states shares
reached and targets; so it is with targets of zero that no document leaves at zero); repeated rows each count and
get the same rate and copies; an empty table gives an empty result.
"""

from __future__ import annotations

import logging
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.frames import column, fresh, stored, text_bytes
from citesift.llm.samples import first_rows
from citesift.llm.texts import WHITE_SPACE, WordHashes, word_hashes

log = logging.getLogger(__name__)

N_BUCKETS = 1 << 13
N_FORM = 4
SAMPLE_PER_DOMAIN = 1500
EPOCHS, LEARNING_RATE, PENALTY = 60, 0.05, 1e-5
GRAIN = 1000
# Entries (a feature of a document) whose products are held at once while fitting.
BLOCK_ENTRIES = 1 << 16
# Totals and optimality are met to TOLERANCE; directions of M below RANK of the largest are taken as none.
TOLERANCE, RANK, LEAST_EPS, MOST_STALLS = 1e-7, 1e-9, 1e-7, 10
# Lengths of a step that are tried.
STEPS = [0.5**k for k in range(8)]
# Shares of tokens aimed at, by domain of the labelled table.
TARGETS = {"good": 0.90, "poor": 0.06, "toxic": 0.04}
MARKS = b"#*$%&|<>"


def domain_of(quality: Column, toxic: Column) -> Column:
    return F.when(toxic == 1, "toxic").when(quality == 0, "poor").otherwise("good")


def features(data: bytes, known: WordHashes) -> tuple[np.ndarray, np.ndarray, int]:
    """Buckets, their weights (unit length), and the number of words."""
    hashes = word_hashes(data.lower(), known)
    bucket, count = np.unique(hashes >> np.uint64(64 - 13), return_counts=True)
    weight = np.log1p(count)
    weight = weight / max(1e-9, np.sqrt((weight**2).sum()))
    n, size = len(hashes), max(1, len(data))
    marks = size - len(data.translate(None, MARKS))
    letters = size - len(data.translate(None, WHITE_SPACE + MARKS + b"0123456789"))
    form = [marks / size * 10, letters / size * 3, len(bucket) / max(1, min(n, N_BUCKETS)), np.log1p(n) / 10]
    at = np.concatenate([bucket.astype(np.int32), N_BUCKETS + np.arange(N_FORM, dtype=np.int32)])
    return at, np.concatenate([weight, form]).astype(np.float32), n


class Classifier(NamedTuple):
    """Softmax model: ``weights`` is (features, domains)."""

    weights: np.ndarray
    bias: np.ndarray

    def posterior(self, at: np.ndarray, weight: np.ndarray) -> np.ndarray:
        z = weight @ self.weights[at] + self.bias
        z = np.exp(z - z.max())
        return z / z.sum()


class Sample(NamedTuple):
    """Labelled documents in a row: ``at`` and ``value`` hold the features of all, from ``starts`` on those of each."""

    at: np.ndarray
    value: np.ndarray
    starts: np.ndarray
    domain: np.ndarray
    importance: np.ndarray


def blocks(starts: np.ndarray, end: int) -> list[tuple[slice, slice]]:
    """Segments, and their entries, in blocks of about ``BLOCK_ENTRIES``; a segment is never cut."""
    first = np.unique(np.append(np.searchsorted(starts, np.arange(0, end, BLOCK_ENTRIES)), len(starts)))
    entry = np.append(starts, end)[first]
    return [(slice(*s), slice(*e)) for s, e in zip(zip(first[:-1], first[1:]), zip(entry[:-1], entry[1:]))]


def fit(sample: Sample, n_domains: int) -> Classifier:
    """Full-batch Adam on the weighted log loss. Products of features are made block by block and not kept."""
    n_features = N_BUCKETS + N_FORM
    weights, bias = np.zeros((n_features, n_domains), np.float32), np.full(n_domains, 0.0)
    at, value, starts, y, importance = sample
    if not len(y):
        return Classifier(weights, bias)
    importance = importance / importance.sum()
    shares = np.bincount(y, importance, n_domains)
    bias = np.log(np.maximum(shares, 1e-12))
    bias[shares == 0] = -1e9
    # The same entries by feature: their rows and values, and where each feature begins.
    by_feature = np.argsort(at, kind="stable")
    feature, value_of = at[by_feature], value[by_feature]
    row_of = np.repeat(np.arange(len(y), dtype=np.int32), np.diff(starts, append=len(at)))[by_feature]
    del by_feature
    first = np.flatnonzero(np.append(True, feature[1:] != feature[:-1]))
    used = feature[first]
    del feature
    by_row, by_used = blocks(starts, len(at)), blocks(first, len(at))
    goal = np.eye(n_domains)[y]
    m, v = np.zeros_like(weights), np.zeros_like(weights)
    mb, vb = np.zeros(n_domains), np.zeros(n_domains)
    z = np.empty((len(y), n_domains))
    for step in range(1, EPOCHS + 1):
        for rows, e in by_row:
            z[rows] = np.add.reduceat(weights[at[e]] * value[e, None].astype(float), starts[rows] - e.start) + bias
        odds = np.exp(z - z.max(axis=1, keepdims=True))
        error = (odds / odds.sum(axis=1, keepdims=True) - goal) * importance[:, None]
        gradient = PENALTY * weights
        for features_, e in by_used:
            spread = error[row_of[e]] * value_of[e, None]
            gradient[used[features_]] += np.add.reduceat(spread, first[features_] - e.start)
        m, v = 0.9 * m + 0.1 * gradient, 0.99 * v + 0.01 * gradient**2
        rate = LEARNING_RATE * np.sqrt(1 - 0.99**step) / (1 - 0.9**step)
        weights = (weights - rate * m / (np.sqrt(v) + 1e-8)).astype(np.float32)
        gb = error.sum(axis=0)
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb**2
        bias = bias - rate * mb / (np.sqrt(vb) + 1e-8)
    return Classifier(weights, bias)


FEATURES_TYPE = "struct<at:array<int>,weight:array<float>,n_words:bigint>"
MEMBERSHIP_TYPE = "struct<n_tokens:bigint,posterior:array<int>>"


def _features(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = WordHashes()
    for batch in batches:
        rows = [features(d.as_py(), known) for d in batch]
        yield pa.array(
            [{"at": a, "weight": w, "n_words": n} for a, w, n in rows],
            pa.struct([("at", pa.list_(pa.int32())), ("weight", pa.list_(pa.float32())), ("n_words", pa.int64())]),
        )


def thousandths(p: np.ndarray) -> np.ndarray:
    """Whole thousandths that sum to ``GRAIN``: the largest remainders are rounded up."""
    scaled = p * GRAIN
    whole = np.floor(scaled).astype(np.int64)
    up = np.argsort(-(scaled - whole), kind="stable")[: GRAIN - whole.sum()]
    whole[up] += 1
    return whole


def fit_domains(
    docs: DataFrame, labels: DataFrame, domains: list[str], doc: str = "doc_id", text: str = "text"
) -> Classifier:
    """Classifier of ``domains`` from ``labels`` (``doc_id``, ``domain``) for the documents in ``docs``."""
    ids = docs.select(column(doc).alias("doc_id")).where(F.col("doc_id").isNotNull()).distinct()
    known = labels.where(F.col("doc_id").isNotNull() & F.col("domain").isin(domains)).distinct()
    order = F.xxhash64(F.col("doc_id").cast("string"))
    known = stored(known.join(ids, "doc_id", "left_semi"), "labelled")
    sizes = {r["domain"]: r["count"] for r in known.groupBy("domain").count().collect()}
    sample = first_rows(known, "domain", order, "doc_id", dict.fromkeys(sizes, SAMPLE_PER_DOMAIN), sizes)
    # At most SAMPLE_PER_DOMAIN ids per domain.
    rows = docs.select(column(doc).alias("doc_id"), text_bytes(text).alias("data"))
    rows = rows.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "domain"])
    built = F.arrow_udf(_features, FEATURES_TYPE)("data")
    found = rows.select("doc_id", "domain", built.alias("f")).select("doc_id", "domain", "f.*")
    return fit(drawn_sample(found.orderBy("doc_id", "domain"), domains, sizes), len(domains))


def drawn_sample(found: DataFrame, domains: list[str], sizes: dict[str, int]) -> Sample:
    """The rows ``doc_id, domain, at, weight`` on the driver: 8 bytes an entry, as Arrow and never as Python objects."""
    table = found.select("domain", "at", "weight").toArrow().combine_chunks()
    at, weight = (pa.concat_arrays(table[c].chunks or [pa.array([], table[c].type)]) for c in ("at", "weight"))
    domain = np.array([domains.index(d) for d in table["domain"].to_pylist()], np.int64)
    drawn = np.bincount(domain, minlength=len(domains))
    importance = np.array([sizes[domains[d]] / drawn[d] for d in domain])
    length = at.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
    return Sample(at.flatten().to_numpy(), weight.flatten().to_numpy(), np.cumsum(length) - length, domain, importance)


def membership(docs: DataFrame, model: Classifier, text: str = "text") -> Column:
    """Struct of ``n_tokens`` (words) and ``posterior`` (thousandths per domain)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known, model = WordHashes(), shared.value
        for batch in batches:
            sizes, found = [], []
            for d in batch:
                at, weight, n = features(d.as_py(), known)
                sizes.append(n)
                found.append(thousandths(model.posterior(at, weight)))
            yield pa.StructArray.from_arrays(
                [pa.array(sizes, pa.int64()), pa.array(found, pa.list_(pa.int32()))], ["n_tokens", "posterior"]
            )

    return F.arrow_udf(score, MEMBERSHIP_TYPE).asNondeterministic()(text_bytes(text))


class Fit(NamedTuple):
    """``pull`` per domain makes the rate of a posterior; shares of tokens ``reached`` and ``targets``."""

    pull: np.ndarray
    reached: np.ndarray
    targets: np.ndarray

    @property
    def met(self) -> bool:
        return bool(np.abs(self.reached - self.targets).max() < TOLERANCE)


def pulled(posterior: Column, pull: Column, n: int) -> Column:
    total = F.lit(0.0)
    for c in range(n):
        total = total + pull[c] * posterior[c] / GRAIN
    return total


def vectors(found: list[np.ndarray]) -> Column:
    return F.array(*[F.array(*map(F.lit, map(float, v))) for v in found])


def rate_of(posterior: Column, fit: Fit) -> Column:
    """The rate of a document: max(0, 1 - pull . p)."""
    return F.greatest(F.lit(0.0), 1 - pulled(posterior, vectors([fit.pull])[0], len(fit.pull)))


class Totals(NamedTuple):
    """Per token of the corpus: tokens by domain, squared rates, and the overlap where rates are above zero."""

    reached: np.ndarray
    energy: float
    overlap: np.ndarray


def totals(groups: DataFrame, pulls: list[np.ndarray], total: float) -> list[Totals]:
    """What each of ``pulls`` gives, in one job."""
    n = len(pulls[0])
    rows = groups.select("posterior", "tokens", F.posexplode(vectors(pulls)).alias("k", "pull"))
    rate = F.greatest(F.lit(0.0), 1 - pulled(F.col("posterior"), F.col("pull"), n))
    rows = rows.select("k", "posterior", F.col("tokens").cast("double").alias("t"), rate.alias("w"))
    p = [F.col("posterior")[c] / GRAIN for c in range(n)]
    held = F.when(F.col("w") > 0, F.col("t")).otherwise(0.0)
    sums = [F.sum(F.col("t") * F.col("w") * p[c]) for c in range(n)]
    sums += [F.sum(F.col("t") * F.col("w") * F.col("w"))]
    sums += [F.sum(held * p[c] * p[d]) for c in range(n) for d in range(n)]
    found = rows.groupBy("k").agg(*[x.alias(f"s{i}") for i, x in enumerate(sums)]).collect()
    values = [np.array(r[1:], float) / total for r in sorted(found)]
    return [Totals(v[:n], v[n], v[n + 1 :].reshape(n, n)) for v in values]


def fit_rates(groups: DataFrame, targets: list[float]) -> Fit:
    """The pull over ``posterior, tokens`` groups, by scaled projected gradient.

    A step takes every unprojected rate ``1 - pull . p`` against the gradient of the misfit, in the metric of the
    documents whose rate is above zero (their overlap), and projects it to zero or above. Plain steps, in one
    metric throughout, take thousands of jobs where many rates are zero. ``STEPS`` lengths are tried per job.

    Domains are whitened by M (``q``, in which the misfit is a plain sum of squares); directions in which no document
    lies are left out, as no rate changes them. For a centre c and a small eps, ``mu`` with r(mu) = eps * (mu - c) is the
    minimum of a smooth convex function. Then c moves to mu: r goes to zero, or, if the targets cannot be met, to the
    smallest possible, which the optimality conditions certify. Tolerances are shares of tokens. Should rounding
    end all progress before that, the best rates so far are returned with a warning.
    """
    n, goal = len(targets), np.array(targets, float)
    total = groups.agg(F.sum("tokens")).first()[0]
    if not total:
        return Fit(np.zeros(n), np.zeros(n), goal)
    at = totals(groups, [np.zeros(n)], total)[0]
    size, axes = np.linalg.eigh(at.overlap)
    axes, size = axes[:, size > RANK * size.max()], size[size > RANK * size.max()]
    white = axes / np.sqrt(size)
    mu, eps, best, stalls = np.zeros(white.shape[1]), 0.1, (np.inf, None), 0
    # What is left of the misfit in the directions that rates can change.
    while np.abs(axes @ (axes.T @ (at.reached - goal))).max() >= TOLERANCE:
        eps, centre = max(eps / 100, LEAST_EPS), mu

        def height(m: np.ndarray, x: Totals) -> float:
            return x.energy / 2 + (white.T @ goal) @ m + eps / 2 * ((m - centre) @ (m - centre))  # noqa: B023

        while True:
            down = white.T @ (at.reached - goal) - eps * (mu - centre)
            if np.abs(down).max() < TOLERANCE / 100:
                break
            bend = white.T @ at.overlap @ white + eps * np.eye(len(mu))
            move = np.linalg.solve(bend, down)
            tried = [mu + s * move for s in STEPS]
            found = totals(groups, [white @ m for m in tried], total)
            heights = [height(m, x) for m, x in zip(tried, found)]
            k = int(np.argmin(heights))
            steepest = [np.abs(white.T @ (x.reached - goal) - eps * (m - centre)).max() for m, x in zip(tried, found)]
            if heights[k] >= height(mu, at):
                # Heights agree to the last digit near the minimum; slopes still tell.
                k = int(np.argmin(steepest))
                if steepest[k] >= np.abs(down).max():
                    break
            mu, at = tried[k], found[k]
        r = white.T @ (at.reached - goal)
        # Least squares: no document may lie uphill of r (slope below zero), and none with a rate may lie downhill.
        slope = groups.where("tokens > 0").agg(F.min(pulled(F.col("posterior"), vectors([white @ r])[0], n))).first()[0]
        miss = max(abs(r @ (white.T @ at.reached)), -slope) / max(float(np.linalg.norm(r)), TOLERANCE)
        stalls, best = (0, (miss, Fit(white @ mu, at.reached, goal))) if miss < best[0] else (stalls + 1, best)
        if miss < TOLERANCE:
            break
        if stalls > MOST_STALLS:
            log.warning("rates are optimal to %.1e only", best[0])
            return best[1]
    return Fit(white @ mu, at.reached, goal)


def copies_of(rate: Column, *key: Column) -> Column:
    """``floor(rate + u)`` with u in [0, 1) from a hash of the row."""
    u = F.xxhash64(F.lit("copies"), *key).bitwiseAND(F.lit((1 << 52) - 1)) / F.lit(float(1 << 52))
    return F.floor(rate + u).cast("bigint")


def fitted(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    doc: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
) -> tuple[DataFrame, Column, Fit]:
    """``docs`` with a membership struct, the column of its name, and the fit (domains in order of name).

    ``labels`` has ``doc_id`` and ``domain``. Texts are scored once: the columns ``carry`` (all, if
    not given) are written with the result, which is cheaper than scoring them again.
    """
    targets = targets or TARGETS
    total = sum(targets.values())
    domains = sorted(targets)
    model = fit_domains(docs, labels, domains, doc, text)
    name = fresh(docs, "membership")
    columns = [column(c) for c in (carry or docs.columns)]
    member = stored(docs.select(*columns, membership(docs, model, text).alias(name)), "memberships")
    m = F.col(name)
    groups = member.groupBy(m["posterior"].alias("posterior")).agg(F.sum(m["n_tokens"]).alias("tokens"))
    groups = stored(groups.coalesce(8), "posteriors")
    fit = fit_rates(groups, [targets[d] / total for d in domains])
    if not fit.met:
        log.warning("targets not met: domains %s, reached %s, targets %s", domains, fit.reached, fit.targets)
    return member, m, fit


def mixing_rates(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    doc: str = "doc_id",
    text: str = "text",
    carry: list[str] | None = None,
) -> tuple[DataFrame, Column, Column]:
    """As ``fitted``, with the rate of a row instead of the fit."""
    member, m, fit = fitted(docs, labels, targets, doc, text, carry)
    return member, m, rate_of(m["posterior"], fit)


def mix(
    docs: DataFrame,
    labels: DataFrame,
    targets: dict[str, float] | None = None,
    doc: str = "doc_id",
    text: str = "text",
) -> DataFrame:
    """``docs`` with every row as often as its rate says, columns unchanged."""
    member, _, rate = mixing_rates(docs, labels, targets, doc, text)
    copy = fresh(member, "copy")
    copies = copies_of(rate, column(doc), F.xxhash64(text_bytes(text)))
    kept = member.withColumn(copy, copies).where(F.col(copy) > 0)
    kept = kept.withColumn(copy, F.explode(F.sequence(F.lit(1).cast("bigint"), F.col(copy))))
    return kept.select([column(c) for c in docs.columns])
