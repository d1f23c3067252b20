"""Toxicity scores of whole texts: the largest score of all overlapping windows.

The network (``gru``) is trained on the driver from a bounded sample of labelled rows: at most
``SAMPLE_PER_CLASS`` per class, in hash order, with texts up to ``SAMPLE_BYTES``. Only the label of a
document is known, not where it is toxic. So each epoch scores all windows of the sample, and every
document teaches its highest window (clean ones also a random one). Embeddings start with the log
odds of words and n-grams, which say where to look first; those of words and n-grams in fewer than
``MIN_TEXTS`` sampled texts stay zero.

Scoring is one Arrow pass without a shuffle: windows of ``WINDOW`` words every ``STRIDE`` words over
the whole text, in batches of ``BATCH_WINDOWS`` whatever the length of a text. The words met are
remembered up to ``KNOWN_WORDS``. A score does not depend on the other texts of a batch.

Words are runs of characters other than white space, A-Z in lower case, with marks at their ends taken off.

Defined cases: NULL and empty texts, or texts without words, score 0; rows with a NULL label or id do
not train; with labels of one class only, or none, every text with words gets that class's share
(0 without labels); repeated rows score alike; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from citesift.llm import gru
from citesift.llm.frames import column, stored, text_bytes
from citesift.llm.samples import first_rows
from citesift.llm.texts import slices

SAMPLE_PER_CLASS = {0: 1600, 1: 800}
SAMPLE_BYTES = 24_000
EPOCHS, PASSES, BATCH, RATE = 7, 2, 64, 0.01
BATCH_WINDOWS = 2048
KNOWN_WORDS = 200_000
MARKS = b".,;:!?()[]{}\"'*#$%&|<>"
MIN_TEXTS = 4
SEED = 11


def plain_words(data: bytes) -> list[bytes]:
    """Lower-case words without the marks at their ends; a word of marks only stays as it is."""
    return [w.strip(MARKS) or w for w in data.lower().split()]


def starts_of(n_words: int) -> int:
    """Number of windows that cover ``n_words`` at every ``STRIDE``."""
    return max(1, -(-(n_words - gru.WINDOW) // gru.STRIDE) + 1) if n_words else 0


def cut(ids: np.ndarray) -> np.ndarray:
    """Windows of a list of word ids, the last one filled up with 0."""
    n = starts_of(len(ids))
    padded = np.zeros((n - 1) * gru.STRIDE + gru.WINDOW, np.int32)
    padded[: len(ids)] = ids
    return np.lib.stride_tricks.sliding_window_view(padded, gru.WINDOW)[:: gru.STRIDE]


class Scorer:
    """Highest window logit per text, for a stream of texts."""

    def __init__(self, model: gru.Model):
        self.model = model
        self.lexicon = gru.Lexicon(model)

    def highest(self, texts: list[bytes]) -> np.ndarray:
        """Logit per text; minus infinity without words."""
        best = np.full(len(texts), -np.inf, np.float32)
        waiting: list[tuple[np.ndarray, int]] = []
        n_waiting = 0

        def flush() -> None:
            nonlocal n_waiting
            if waiting:
                ids = np.concatenate([w for w, _ in waiting])
                owner = np.repeat([i for _, i in waiting], [len(w) for w, _ in waiting])
                table = self.lexicon.table()
                short = ids[:, -1] == 0
                for part, padded in ((~short, False), (short, True)):
                    if part.any():
                        found = gru.logits(self.model, table, ids[part], padded)
                        np.maximum.at(best, owner[part], found)
                waiting.clear()
                n_waiting = 0
            if len(self.lexicon) > KNOWN_WORDS:
                self.lexicon.forget()

        for i, data in enumerate(texts):
            left: list[bytes] = []
            windowed = False
            for piece in slices(data):
                words = left + plain_words(piece)
                # Whole windows now; what the next window needs waits for the next piece.
                n_full = max(0, (len(words) - gru.WINDOW) // gru.STRIDE + 1)
                if n_full:
                    ids = self._ids(words[: (n_full - 1) * gru.STRIDE + gru.WINDOW])
                    waiting.append((cut(ids), i))
                    n_waiting += n_full
                    windowed = True
                left = words[n_full * gru.STRIDE :]
                if n_waiting >= BATCH_WINDOWS:
                    flush()
            # A window before has covered the first words of the rest.
            if len(left) > (gru.WINDOW - gru.STRIDE if windowed else 0):
                waiting.append((cut(self._ids(left)), i))
                n_waiting += 1
        flush()
        return best

    def _ids(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.lexicon.__getitem__, words), np.int32, len(words))


def log_odds(
    documents: list[np.ndarray], labels: np.ndarray, n_buckets: int
) -> tuple[np.ndarray, np.ndarray]:
    """How much more often a bucket occurs in documents of label 1, within -1 and 1; and which are known.

    Buckets of fewer than ``MIN_TEXTS`` documents are unknown: learning them would be learning texts by heart.
    """
    seen = np.zeros((2, n_buckets))
    for buckets, label in zip(documents, labels):
        seen[int(label), np.unique(buckets)] += 1
    n = np.bincount(labels, minlength=2) + 1
    odds = np.log((seen[1] + 0.5) / n[1]) - np.log((seen[0] + 0.5) / n[0])
    known = seen.sum(axis=0) >= MIN_TEXTS
    return np.where(known, np.clip(odds / 4, -1, 1), 0).astype(np.float32), known


def train(texts: list[bytes], labels: np.ndarray, seed: int = SEED) -> gru.Model:
    """Fit the network to labelled texts."""
    random = np.random.Generator(np.random.PCG64(seed))
    model = gru.initial(seed)
    share = float(labels.mean()) if len(labels) else 0.0
    if share in (0.0, 1.0):
        for parameter in model:
            parameter[...] = 0
        model.b_out[0] = -20.0 if share == 0.0 else 20.0
        return model
    rows: dict[bytes, int] = {}
    documents = [
        np.array([rows.setdefault(w, len(rows) + 1) for w in plain_words(t)], np.int32) for t in texts
    ]
    used = [i for i, d in enumerate(documents) if len(d)]
    documents, labels = [documents[i] for i in used], labels[used]
    words = list(rows)
    buckets = np.array([0] + [gru.word_bucket(w) for w in words])
    codes, first = gru.gram_buckets(words)
    ends = np.append(first[1:], len(codes))
    model.words[:, 0], known_words = log_odds([buckets[d] for d in documents], labels, len(model.words))

    def grams_of(ids: np.ndarray) -> np.ndarray:
        distinct = np.unique(ids) - 1
        return np.concatenate([codes[first[w] : ends[w]] for w in distinct])

    model.grams[:, 0], known_grams = log_odds([grams_of(d) for d in documents], labels, len(model.grams))
    model.words[~known_words] = 0
    model.grams[~known_grams] = 0
    vectors = gru.word_vectors(model, words)
    hint = np.concatenate([[-9.0], vectors[:, 0] + vectors[:, gru.D_WORD]])

    cuts = [cut(d) for d in documents]
    every, owner = np.concatenate(cuts), np.repeat(np.arange(len(cuts)), [len(c) for c in cuts])
    begin = np.concatenate([[0], np.cumsum([len(c) for c in cuts])])
    score = hint[every].max(axis=1)
    optimiser = gru.Adam(model, RATE)
    for epoch in range(EPOCHS):
        if epoch:
            lexicon = gru.Lexicon(model)
            lexicon.pending = list(words)
            table = lexicon.table()
            score = np.concatenate(
                [
                    gru.logits(model, table, every[i : i + BATCH_WINDOWS], True)
                    for i in range(0, len(every), BATCH_WINDOWS)
                ]
            )
        top = np.array([begin[d] + score[begin[d] : begin[d + 1]].argmax() for d in range(len(cuts))])
        for _ in range(PASSES):
            chance = begin[:-1] + (random.random(len(cuts)) * np.diff(begin)).astype(int)
            picked = np.concatenate([top, chance[labels == 0]])
            target = np.concatenate([labels, np.zeros((labels == 0).sum())]).astype(np.float32)
            order = random.permutation(len(picked))
            for i in range(0, len(order), BATCH):
                at = order[i : i + BATCH]
                ids = every[picked[at]]
                distinct, place = np.unique(ids, return_inverse=True)
                local = place.reshape(ids.shape)
                if distinct[0] == 0:
                    distinct = distinct[1:]
                else:
                    local = local + 1
                weight = np.full(len(at), 1 / len(at), np.float32)
                _, gradient = gru.gradients(model, [words[w - 1] for w in distinct], local, target[at], weight)
                gradient.words[~known_words] = 0
                gradient.grams[~known_grams] = 0
                optimiser.update(model, gradient)
        optimiser.rate = RATE * (1 - (epoch + 1) / EPOCHS) + RATE / 10
    return model


def labelled_sample(
    docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text"
) -> tuple[list[bytes], np.ndarray, float]:
    """Texts, labels, and the log of how much more often label 1 is in the sample than in the labels.

    At most ``SAMPLE_PER_CLASS`` texts of each class, from ``labels`` (``doc_id``, ``label`` 0 or 1)."""
    rows = docs.select(column(doc).alias("doc_id"), text_bytes(text).alias("data"))
    short = rows.where((F.length("data") <= SAMPLE_BYTES) & F.col("doc_id").isNotNull())
    known = labels.where(F.col("doc_id").isNotNull() & F.col("label").isin(0, 1)).distinct()
    order = F.xxhash64(F.lit(SEED), F.col("doc_id").cast("string"))
    known = known.join(short.select("doc_id"), "doc_id", "left_semi").select("doc_id", "label")
    known = stored(known, "toxic-known")
    n = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    wanted = {g: SAMPLE_PER_CLASS[int(g)] for g in n}
    sample = stored(first_rows(known, "label", order, "doc_id", wanted, n), "toxic-sample")
    # At most SAMPLE_PER_CLASS ids per class.
    found = short.join(F.broadcast(sample), "doc_id").dropDuplicates(["doc_id", "label"])
    found = found.orderBy("doc_id", "label").collect()
    drawn = np.array([r["label"] for r in found], np.int64)
    shift = 0.0
    if len(n) == 2 and 0 < drawn.sum() < len(drawn):
        shift = float(np.log(drawn.sum() / (len(drawn) - drawn.sum())) - np.log(n[1] / n[0]))
    return [bytes(r["data"]) for r in found], drawn, shift


def trained(docs: DataFrame, labels: DataFrame, doc: str = "doc_id", text: str = "text") -> gru.Model:
    """Network fitted to the sample; its bias is moved from the sample's share of label 1 to the labels'."""
    texts, drawn, shift = labelled_sample(docs, labels, doc, text)
    model = train(texts, drawn)
    model.b_out[0] -= shift
    return model


def scores(spark: SparkSession, model: gru.Model, text: Column) -> Column:
    """Score between 0 and 1 of a text given as bytes."""
    shared = spark.sparkContext.broadcast(model)

    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for batch in batches:
            best = scorer.highest(batch.to_pylist()).astype(np.float64)
            found = 1 / (1 + np.exp(-np.clip(best, -30, 30)))
            yield pa.array(np.where(np.isinf(best), 0.0, found), pa.float64())

    return F.arrow_udf(score, "double").asNondeterministic()(text)
