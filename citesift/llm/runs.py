"""Periodic runs of words: where a text repeats a stretch of words over and over.

A run is a stretch of consecutive words with smallest period ``q`` (words ``q`` apart are identical),
at least ``max(MIN_WORDS, MIN_PERIODS * q)`` words long, that no neighbouring word extends.

Words are read in order. Every word knows at which lags it recurs: where its earlier occurrences lie.
A lag met at the word before too has its match length raised by one; a lag that is not met any more is a
diagonal that has ended, which is a run if it was long enough, and comes out at once (``online_runs``).

What counts as an occurrence is kept sparse without losing a run. Lags fall into classes
``[2^k, 2^(k+1))``. A run of a lag of class ``k`` has at least ``3 * 2^k`` matching words, so a word is looked up
together with the words before it, ``3 * 2^k`` in all. If these stand at two earlier places of the class, the
shorter lag divides the longer (two periods of a stretch longer than their sum), so the longer is not
smallest: only the nearest occurrence counts. A word hence has one lag per class at most, work is
O(words x log(words)) for any text, and a text without repetitions has next to no occurrences. Words
are compared by number, not by hash, so nothing collides.

Each text is one row of an Arrow task; there is no shuffle. A task holds the distinct words of one text and
eight bytes a word and array.

Defined cases: a NULL text has no words and no runs, and its collapsed text is empty; a text without words
likewise; a very long text is cut into words slice by slice; repeated rows are measured each on their own;
an empty table gives an empty result; columns are named by the caller, so none can clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from citesift.llm.texts import slices

MIN_WORDS = 6
MIN_PERIODS = 4
BLOCK = 1 << 16

RUN = "struct<start:bigint,length:bigint,period:bigint>"
RUNS_TYPE = f"struct<n_words:bigint,runs:array<{RUN}>,best:{RUN},collapsed:binary>"
_RUN = pa.struct([(name, pa.int64()) for name in ("start", "length", "period")])
_RUNS = pa.struct([("n_words", pa.int64()), ("runs", pa.list_(_RUN)), ("best", _RUN), ("collapsed", pa.binary())])


class Run(NamedTuple):
    start: int
    length: int
    period: int

    def __str__(self) -> str:
        return f"{self.start},{self.length},{self.period}"


class Numbers(dict):
    """Words numbered in the order they are met."""

    def __missing__(self, word: bytes) -> int:
        number = self[word] = len(self)
        return number


def numbered(data: bytes) -> tuple[np.ndarray, list[bytes]]:
    """The words of a text as numbers, and the word behind each number."""
    known, parts = Numbers(), [np.empty(0, np.int64)]
    for piece in slices(data):
        words = piece.split()
        parts.append(np.fromiter(map(known.__getitem__, words), np.int64, len(words)))
    return np.concatenate(parts), list(known)


def paired(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """One dense number per distinct pair."""
    return np.unique(a * (b.max(initial=0) + 1) + b, return_inverse=True)[1]


def occurrences(words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(word, lag, width)`` in word order: the ``width`` words up to ``word`` stand ``lag`` earlier too."""
    n, found = len(words), []
    if n < MIN_WORDS:
        return (np.empty(0, np.int64),) * 3
    at, width, least = np.arange(n - 2), 3, 1
    ids = paired(paired(words[:-2], words[1:-1]), words[2:])
    while MIN_PERIODS * least <= n and len(at):
        order = np.argsort(ids, kind="stable")
        same = ids[order[1:]] == ids[order[:-1]]
        later, earlier = order[1:][same], order[:-1][same]
        lag = at[later] - at[earlier]
        near = (lag >= least) & (lag < 2 * least)
        if near.any():
            found.append((at[later[near]] + width - 1, lag[near], np.full(near.sum(), width)))
        again = np.zeros(len(at), bool)
        again[later] = again[earlier] = True
        at, ids = at[again], ids[again]
        # Twice as many words recur only where both halves do.
        half = np.searchsorted(at, at + width)
        whole = half < len(at)
        whole[whole] = at[half[whole]] == at[whole] + width
        ids, at = paired(ids[whole], ids[half[whole]]), at[whole]
        width, least = 2 * width, 2 * least
    if not found:
        return (np.empty(0, np.int64),) * 3
    ends, lags, widths = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((lags, ends))
    return ends[order], lags[order], widths[order]


def online_runs(words: np.ndarray) -> Iterator[Run]:
    """Runs in the order in which their diagonals end."""
    active: dict[int, list[int]] = {}  # lag: first and last word of its diagonal

    def ended(before: int) -> Iterator[Run]:
        for lag in [q for q, (_, last) in active.items() if last < before]:
            first, last = active.pop(lag)
            length = last - first + 1 + lag
            if length >= max(MIN_WORDS, MIN_PERIODS * lag):
                yield Run(first - lag, length, lag)

    columns, now = occurrences(words), -1
    for block in range(0, len(columns[0]), BLOCK):
        for word, lag, width in zip(*(c[block : block + BLOCK].tolist() for c in columns)):
            if word != now:
                yield from ended(word - 1)
                now = word
            diagonal = active.get(lag)
            if diagonal is None:
                active[lag] = [word - width + 1, word]
            else:
                diagonal[1] = word
    yield from ended(len(words))


def runs_of(words: np.ndarray) -> list[Run]:
    """All runs, by start, then period."""
    return sorted(online_runs(words), key=lambda r: (r.start, r.period))


def best_run(runs: list[Run]) -> Run | None:
    """The run with the greatest length in periods; ties: smallest start, then period."""
    return max(runs, key=lambda r: (Fraction(r.length, r.period), -r.start, -r.period), default=None)


def kept_words(n: int, runs: list[Run]) -> np.ndarray:
    """False for words that some run holds after its first period."""
    change = np.zeros(n + 1, np.int64)
    for r in runs:
        change[r.start + r.period] += 1
        change[r.start + r.length] -= 1
    return np.cumsum(change)[:n] == 0


def joined(words: np.ndarray, spelled: list[bytes]) -> bytes:
    """The words with one space between them."""
    blocks = (words[i : i + BLOCK].tolist() for i in range(0, len(words), BLOCK))
    return b" ".join([b" ".join(map(spelled.__getitem__, block)) for block in blocks])


def repeated_from(words: np.ndarray, seed: int) -> np.ndarray:
    """The words with a planted run, if the seed says so: from word ``a`` on, the first ``p`` of them over and over."""
    n, g = len(words), seed // 10
    if seed % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return np.concatenate([words[:a], words[a + np.arange(n - a) % p]])


def examined(data: bytes, seed: int | None = None) -> dict:
    words, spelled = numbered(data)
    if seed is not None:
        words = repeated_from(words, seed)
    found = runs_of(words)
    best = best_run(found)
    return {
        "n_words": len(words),
        "runs": [r._asdict() for r in found],
        "best": best and best._asdict(),
        "collapsed": joined(words[kept_words(len(words), found)], spelled),
    }


def _runs(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
    for texts, seeds in batches:
        yield pa.array((examined(t.as_py(), s.as_py()) for t, s in zip(texts, seeds)), _RUNS)


def periodic_runs(data: Column, seed: Column | None = None) -> Column:
    """``n_words``, all ``runs``, the ``best`` one, and the text ``collapsed`` to the words outside repetitions.

    ``data`` is a text as bytes. With a ``seed`` per row, a run is planted in a tenth of the texts first (``repeated_from``).
    """
    seed = F.lit(None).cast("bigint") if seed is None else seed
    return F.arrow_udf(_runs, RUNS_TYPE).asNondeterministic()(data, seed)
