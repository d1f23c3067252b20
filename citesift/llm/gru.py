"""Bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as two vectors: the embedding of its hash bucket, and the largest value, per dimension,
of the embeddings of its character n-grams (3 and 5 bytes, with word ends). A window of words runs
through a gated recurrent layer in both directions; attention pools the states; a logistic unit
scores the window.

What the input layer makes of a word depends on the word alone, so it is computed once per word and
looked up (``Lexicon``); the recurrence runs over thousands of windows at a time.
"""

from __future__ import annotations

from typing import NamedTuple

import numpy as np
import xxhash

WINDOW, STRIDE = 32, 16
WORD_BITS, GRAM_BITS = 15, 14
D_WORD, D_CHAR, HIDDEN, ATTENTION = 8, 8, 8, 8
GRAMS = (3, 5)
CLIP = 5.0


class Model(NamedTuple):
    words: np.ndarray  # (buckets, D_WORD)
    grams: np.ndarray  # (buckets, D_CHAR)
    w_in: np.ndarray  # (D_WORD + D_CHAR, 2 * 3 * HIDDEN): forward z, r, n, then backward
    b_in: np.ndarray
    u_fwd: np.ndarray  # (HIDDEN, 3 * HIDDEN)
    u_bwd: np.ndarray
    w_att: np.ndarray  # (2 * HIDDEN, ATTENTION)
    b_att: np.ndarray
    v_att: np.ndarray
    w_out: np.ndarray  # (2 * HIDDEN,)
    b_out: np.ndarray  # (1,)


def initial(seed: int = 7) -> Model:
    random = np.random.Generator(np.random.PCG64(seed))

    def normal(*shape: int, scale: float) -> np.ndarray:
        return random.normal(0, scale, shape).astype(np.float32)

    gates = 3 * HIDDEN
    return Model(
        normal(1 << WORD_BITS, D_WORD, scale=0.1),
        normal(1 << GRAM_BITS, D_CHAR, scale=0.1),
        normal(D_WORD + D_CHAR, 2 * gates, scale=0.35),
        np.zeros(2 * gates, np.float32),
        normal(HIDDEN, gates, scale=0.3),
        normal(HIDDEN, gates, scale=0.3),
        normal(2 * HIDDEN, ATTENTION, scale=0.3),
        np.zeros(ATTENTION, np.float32),
        normal(ATTENTION, scale=0.5),
        normal(2 * HIDDEN, scale=0.3),
        np.zeros(1, np.float32),
    )


def word_bucket(word: bytes) -> int:
    return xxhash.xxh3_64_intdigest(word) >> (64 - WORD_BITS)


def gram_buckets(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams of all words, and the position of each word's first one."""
    ended = [b"\x02" + w + b"\x03" for w in words]
    data = np.frombuffer(b"".join(ended), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in ended])
    starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    owner = np.repeat(np.arange(len(words)), sizes)
    left = np.repeat(starts + sizes, sizes) - np.arange(len(data))
    codes, owners = [], []
    for n in GRAMS:
        at = np.flatnonzero(left >= n)
        code = np.full(len(at), n, np.uint64)
        for i in range(n):
            code = code * np.uint64(0x9E3779B97F4A7C15) + data[at + i]
        code = (code ^ (code >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
        codes.append((code >> np.uint64(64 - GRAM_BITS)).astype(np.int64))
        owners.append(owner[at])
    owners = np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    first = np.searchsorted(owners[order], np.arange(len(words)))
    return np.concatenate(codes)[order], first


def word_vectors(model: Model, words: list[bytes]) -> np.ndarray:
    codes, first = gram_buckets(words)
    chars = np.maximum.reduceat(model.grams[codes], first, axis=0)
    return np.concatenate([model.words[[word_bucket(w) for w in words]], chars], axis=1)


class Lexicon(dict):
    """Row of each word met in a table of input-layer outputs; row 0 is padding."""

    def __init__(self, model: Model):
        super().__init__()
        self.model = model
        self.pending: list[bytes] = []
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.pending.clear()
        self.n_rows = 1
        self.rows = np.zeros((1 << 14, self.model.w_in.shape[1]), np.float32)

    def __missing__(self, word: bytes) -> int:
        row = self[word] = self.n_rows + len(self.pending)
        self.pending.append(word)
        return row

    def table(self) -> np.ndarray:
        while self.pending:
            words = self.pending[:20_000]
            del self.pending[:20_000]
            upto = self.n_rows + len(words)
            if upto > len(self.rows):
                grown = np.zeros((max(upto, 2 * len(self.rows)), self.rows.shape[1]), np.float32)
                grown[: self.n_rows] = self.rows[: self.n_rows]
                self.rows = grown
            found = word_vectors(self.model, words) @ self.model.w_in + self.model.b_in
            self.rows[self.n_rows : upto] = found
            self.n_rows = upto
        return self.rows


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * np.tanh(0.5 * x) + 0.5


def _run(inputs, ids, u, mask, order, keep):
    """States of one direction, (steps, windows, HIDDEN); with ``keep`` also what gradients need."""
    h = np.zeros((ids.shape[0], HIDDEN), np.float32)
    states = np.empty((ids.shape[1], ids.shape[0], HIDDEN), np.float32)
    kept = {}
    for t in order:
        x, hu = inputs(t), h @ u
        zr = sigmoid(x[:, : 2 * HIDDEN] + hu[:, : 2 * HIDDEN])
        z, r, c = zr[:, :HIDDEN], zr[:, HIDDEN:], hu[:, 2 * HIDDEN :]
        n = np.tanh(x[:, 2 * HIDDEN :] + r * c)
        new = n + z * (h - n)
        if mask is not None:
            new = np.where(mask[:, t, None], new, h)
        if keep:
            kept[t] = (h, z, r, c, n)
        h = states[t] = new
    return states, kept


def _attend(model: Model, states: np.ndarray, mask: np.ndarray | None):
    """Logits, and what gradients need. ``states`` is (steps, windows, 2 * HIDDEN)."""
    hidden = np.tanh(states @ model.w_att + model.b_att)
    score = hidden @ model.v_att
    if mask is not None:
        score = np.where(mask.T, score, np.float32(-1e9))
    weight = np.exp(score - score.max(axis=0))
    weight /= weight.sum(axis=0)
    pooled = np.einsum("tb,tbh->bh", weight, states)
    return pooled @ model.w_out + model.b_out[0], (hidden, weight, pooled)


def logits(model: Model, table: np.ndarray, ids: np.ndarray, padded: bool) -> np.ndarray:
    """Scores of windows given as rows of the lexicon's table, (windows, WINDOW)."""
    half, steps = 3 * HIDDEN, range(ids.shape[1])
    mask = ids > 0 if padded else None
    fwd, _ = _run(lambda t: table[ids[:, t], :half], ids, model.u_fwd, mask, steps, False)
    bwd, _ = _run(lambda t: table[ids[:, t], half:], ids, model.u_bwd, mask, reversed(steps), False)
    return _attend(model, np.concatenate([fwd, bwd], axis=2), mask)[0]


def _back(d_states, kept, u, mask, order):
    """Gradients of the inputs (steps, windows, 3 * HIDDEN) and of ``u``."""
    steps, n_windows, _ = d_states.shape
    d_inputs = np.zeros((steps, n_windows, 3 * HIDDEN), np.float32)
    d_u = np.zeros_like(u)
    carry = np.zeros((n_windows, HIDDEN), np.float32)
    for t in order:
        h, z, r, c, n = kept[t]
        d = d_states[t] + carry
        live = mask[:, t, None]
        on = np.where(live, d, 0)
        d_n = on * (1 - z) * (1 - n * n)
        d_z = on * (h - n) * z * (1 - z)
        d_r = d_n * c * r * (1 - r)
        d_inputs[t] = np.concatenate([d_z, d_r, d_n], axis=1)
        d_hu = np.concatenate([d_z, d_r, d_n * r], axis=1)
        d_u += h.T @ d_hu
        carry = on * z + d_hu @ u.T + np.where(live, 0, d)
    return d_inputs, d_u


def gradients(model: Model, words: list[bytes], ids: np.ndarray, target: np.ndarray, weight: np.ndarray):
    """Loss and gradients of all parameters. ``ids`` are 1 + position in ``words``, 0 pads."""
    codes, first = gram_buckets(words)
    found = model.grams[codes]
    chars = np.maximum.reduceat(found, first, axis=0)
    buckets = np.array([word_bucket(w) for w in words])
    vectors = np.concatenate([model.words[buckets], chars], axis=1)
    table = np.concatenate([np.zeros((1, model.w_in.shape[1]), np.float32), vectors @ model.w_in + model.b_in])
    half, steps, mask = 3 * HIDDEN, range(ids.shape[1]), ids > 0
    fwd, kept_f = _run(lambda t: table[ids[:, t], :half], ids, model.u_fwd, mask, steps, True)
    bwd, kept_b = _run(lambda t: table[ids[:, t], half:], ids, model.u_bwd, mask, reversed(steps), True)
    states = np.concatenate([fwd, bwd], axis=2)
    logit, (hidden, attention, pooled) = _attend(model, states, mask)
    p = sigmoid(logit)
    loss = -(weight * (target * np.log(p + 1e-7) + (1 - target) * np.log(1 - p + 1e-7))).sum()

    d_logit = (weight * (p - target)).astype(np.float32)
    d_pooled = d_logit[:, None] * model.w_out
    d_states = attention[:, :, None] * d_pooled
    d_weight = np.einsum("bh,tbh->tb", d_pooled, states)
    d_score = attention * (d_weight - (attention * d_weight).sum(axis=0))
    d_hidden = d_score[:, :, None] * model.v_att * (1 - hidden**2)
    d_states = d_states + d_hidden @ model.w_att.T
    flat = states.reshape(-1, 2 * HIDDEN)
    in_f, d_uf = _back(d_states[:, :, :HIDDEN], kept_f, model.u_fwd, mask, reversed(steps))
    in_b, d_ub = _back(d_states[:, :, HIDDEN:], kept_b, model.u_bwd, mask, steps)
    d_table = np.zeros_like(table)
    np.add.at(d_table, ids.T, np.concatenate([in_f, in_b], axis=2))
    d_rows = d_table[1:]
    d_vectors = d_rows @ model.w_in.T
    d_words, d_grams = np.zeros_like(model.words), np.zeros_like(model.grams)
    np.add.at(d_words, buckets, d_vectors[:, :D_WORD])
    sizes = np.diff(np.append(first, len(codes)))
    top = found == np.repeat(chars, sizes, axis=0)
    np.add.at(d_grams, codes, np.repeat(d_vectors[:, D_WORD:], sizes, axis=0) * top)
    return loss, Model(
        d_words,
        d_grams,
        vectors.T @ d_rows,
        d_rows.sum(axis=0),
        d_uf,
        d_ub,
        flat.T @ d_hidden.reshape(-1, ATTENTION),
        d_hidden.sum(axis=(0, 1)),
        np.einsum("tb,tba->a", d_score, hidden),
        pooled.T @ d_logit,
        np.array([d_logit.sum()], np.float32),
    )


class Adam:
    def __init__(self, model: Model, rate: float):
        self.rate, self.step = rate, 0
        self.m = [np.zeros_like(p) for p in model]
        self.v = [np.zeros_like(p) for p in model]

    def update(self, model: Model, gradient: Model) -> None:
        self.step += 1
        norm = np.sqrt(sum(float((g**2).sum()) for g in gradient))
        shrink = min(1.0, CLIP / (norm + 1e-9))
        rate = self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for p, g, m, v in zip(model, gradient, self.m, self.v):
            m += 0.1 * (shrink * g - m)
            v += 0.001 * ((shrink * g) ** 2 - v)
            p -= (rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
