"""SentencePiece encoding and decoding by a streaming Viterbi search.

The text is read once. For every boundary inside a window as long as the longest piece the best
path to it is kept as a backpointer. Whenever the paths to all boundaries of the window run through
one common boundary, the ids before it are final and are put out; only the window stays, however
long the text is.

Two kinds of models, told apart by the model file:

- ``unigram``: an arc is a piece, the best path has the largest sum of scores.
- ``bpe``: merging is the reference, and its result is the one path on which any two neighbouring
  pieces are those that merging makes of their own joined text. Arcs are therefore limited to pieces
  that may follow the last piece of the path they extend (checked by merging the two, remembered),
  and exactly one path to each boundary is left. Ids equal those of the SentencePiece library.

A text is cut where no piece can lie across (before a space, around characters that only stand
alone, between a word and a sign that no piece has behind a letter); those stretches, mostly words, and inside
them the runs between two characters that no piece has side by side, are remembered per task, up to ``REMEMBERED``
and ``REMEMBERED_BYTES`` of them together.

Spaces become the marker character and one is put in front; characters outside the vocabulary become
their UTF-8 bytes. The marker character itself, if a text holds it, is written as bytes too, so
that decoding gives back every text exactly.

Defined cases: NULL stays NULL; an empty text has no ids; ids out of range, and control pieces,
decode to nothing; repeated rows, an empty table and further columns need no care, as the operators
are column functions.
"""

from __future__ import annotations

import re
import uuid
from array import array
from collections.abc import Callable, Iterator
from operator import add
from string import punctuation
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
REMEMBERED = 250_000
# Words and runs of a task together; an entry takes about ENTRY_BYTES besides its text and ids.
REMEMBERED_BYTES, ENTRY_BYTES = 32 << 20, 200
LONG_STRETCH = 64
SLICE_CHARS = 1 << 20
BLOCK_IDS = 1 << 16
UNKNOWN_PENALTY = 10.0


class Vocabulary(NamedTuple):
    """What encoding needs of a model; a fixed few MB whatever the corpus."""

    algorithm: str
    scores: dict[str, tuple[float, int]]
    byte_ids: list[int]
    unknown: int
    spelled: list[bytes]
    longest: int
    mark_leads: bool


def _fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protobuf message: number and value."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = varint() if key & 7 == 2 else {1: 8, 5: 4}[key & 7]
        yield key >> 3, data[at : at + size]
        at += size


def algorithm_of(model: bytes) -> str:
    """Field 3 of the trainer's settings (field 2): 1 is unigram (also if left out), 2 is BPE."""
    settings = next((v for n, v in _fields(model) if n == 2), b"")
    kind = next((v for n, v in _fields(settings) if n == 3), 1)
    if kind not in (1, 2):
        raise ValueError(f"neither a unigram nor a BPE model: {kind}")
    return {1: "unigram", 2: "bpe"}[kind]


def load(path: str = MODEL) -> Vocabulary:
    """Read a model on the driver; tasks get the vocabulary and need no file."""
    import sentencepiece

    with open(path, "rb") as f:
        data = f.read()
    model = sentencepiece.SentencePieceProcessor(model_proto=data)
    if model.encode(" A  b ") and model.decode(model.encode("  AÅ ")) != "  AÅ ":
        raise ValueError("the model normalises texts; only identity models round-trip")
    scores, byte_ids, spelled = {}, [-1] * 256, []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            value = int(piece[3:5], 16)
            byte_ids[value] = i
            spelled.append(bytes([value]))
        elif model.is_control(i) or model.is_unused(i):
            spelled.append(b"")
        elif model.is_unknown(i):
            spelled.append(" ⁇ ".encode())
        else:
            scores[piece] = (model.get_score(i), i)
            spelled.append(piece.replace(MARK, " ").encode())
    return vocabulary(algorithm_of(data), scores, byte_ids, model.unk_id(), spelled)


def vocabulary(
    algorithm: str,
    scores: dict[str, tuple[float, int]],
    byte_ids: list[int],
    unknown: int,
    spelled: list[bytes],
) -> Vocabulary:
    longest = max(map(len, scores), default=1)
    leads = all(MARK not in p.lstrip(MARK) for p in scores)
    return Vocabulary(algorithm, scores, byte_ids, unknown, spelled, longest, leads)


class Merger:
    """Merging, the definition that BPE arcs are checked with. Used on two joined pieces at a time."""

    def __init__(self, scores: dict[str, tuple[float, int]]):
        self.scores = scores
        self.ids = {piece: i for piece, (_, i) in scores.items()}
        # id of the left piece -> id of the right one -> whether they may stand side by side
        self.follows: dict[int, dict[int, bool]] = {}
        self.n_known = 0

    def merge(self, text: str) -> list[str]:
        """Join the best scored neighbours, the leftmost of equals, until none are a piece."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                found = self.scores.get(parts[i] + parts[i + 1])
                if found is not None and (best is None or found[0] > best):
                    best, at = found[0], i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def may_follow(self, left: str, right: str) -> bool:
        """Whether merging leaves these two pieces side by side; ``left`` may be empty or unknown."""
        # Outside the vocabulary nothing merges, so only ``right`` itself matters.
        pair = [left, right] if left in self.ids else [right]
        return self.merge("".join(pair)) == pair

    def checked(self, left: str, right: str) -> bool:
        """``may_follow``, remembered under the ids of both."""
        known = self.follows.setdefault(self.ids.get(left, -1), {})
        if self.n_known >= REMEMBERED:
            self.follows.clear()
            self.n_known, known = 0, {}
        self.n_known += 1
        found = known[self.ids[right]] = self.may_follow(left, right)
        return found


class Node(dict):
    """A place of ``Endings``: the node after each character that was met here, and ``ending`` for ``state``."""

    __slots__ = ("endings", "state", "ending")

    def __init__(self, endings: Endings, state: str):
        super().__init__()
        self.endings, self.state = endings, state
        ids = endings.ids
        self.ending = [(ids[state[i:]], len(state) - i) for i in range(len(state)) if state[i:] in ids]

    def __missing__(self, char: str) -> Node:
        return self.endings.after(self, char)


class Endings:
    """Which pieces end at each place of a text, longest first: one lookup a character.

    The state is the longest end of the text read so far that some piece begins with. Nodes are made when a text
    first needs them; beyond ``REMEMBERED`` steps they are all forgotten.
    """

    def __init__(self, ids: dict[str, int]):
        self.ids = ids
        self.begins = {p[:i] for p in ids for i in range(1, len(p) + 1)}
        self.forget()

    def forget(self) -> None:
        self.nodes: dict[str, Node] = {}
        self.root, self.n_steps = Node(self, ""), 0

    def after(self, node: Node, char: str) -> Node:
        state = node.state + char
        while state and state not in self.begins:
            state = state[1:]
        if not state:
            return self.root
        if self.n_steps >= REMEMBERED:
            self.forget()
        found = self.nodes.get(state)
        if found is None:
            found = self.nodes[state] = Node(self, state)
        node[char] = found
        self.n_steps += 1
        return found


class Stream:
    """Viterbi search over a text of any length, with the state of one window."""

    def __init__(self, vocab: Vocabulary):
        self.vocab = vocab
        self.merger = Merger(vocab.scores)
        self.lowest = min((s for s, _ in vocab.scores.values()), default=0.0) - UNKNOWN_PENALTY
        self.endings = Endings(self.merger.ids)

    def search(self, text: str) -> Iterator[tuple[int, int, int]]:
        """``id, start, end`` of each piece as soon as it is certain; id -1 for unknown characters."""
        scores, merger, node = self.vocab.scores, self.merger, self.endings.root
        follows, longest, merging = merger.follows, self.vocab.longest, self.vocab.algorithm == "bpe"
        nothing: dict[int, bool] = {}
        # State of the boundaries from ``base`` on: id of the last piece, its start, score of the path.
        base, last, back, total = 0, [-1], [0], [0.0]
        check = 2 * longest
        for end in range(1, len(text) + 1):
            start = end - 1
            best, come, score = -1, start, None
            node = node[text[start]]
            if not merging and text[start] not in scores:
                score = total[start - base] + self.lowest
            # Of equal sums the shortest piece is taken.
            for piece, size in node.ending if merging else reversed(node.ending):
                start = end - size
                if start < base:
                    continue
                if merging:
                    left = last[start - base]
                    may = follows.get(left, nothing).get(piece)
                    if may is None:
                        before = text[back[start - base] : start] if left >= 0 else ""
                        may = merger.checked(before, text[start:end])
                    if may:  # no other arc can end here
                        best, come = piece, start
                        break
                else:
                    now = total[start - base] + scores[text[start:end]][0]
                    if score is None or now > score:
                        best, come, score = piece, start, now
            last.append(best)
            back.append(come)
            total.append(score or 0.0)
            if end - base >= check:
                common = self._common(range(end - longest + 1, end + 1), base, back)
                if common > base:
                    yield from self._path(common, base, last, back)
                    del last[: common - base], back[: common - base], total[: common - base]
                    base = common
                check = end - base + longest
        yield from self._path(len(text), base, last, back)

    def word(self, text: str) -> list[tuple[int, int, int]]:
        """``search`` for a text inside one window, where nothing is certain before the end."""
        if self.vocab.algorithm != "bpe":
            return list(self.search(text))
        node, follows, nothing = self.endings.root, self.merger.follows, {}
        last, back = [-1], [-1]
        # What is known to follow the last piece of the path to each boundary.
        after = [follows.get(-1, nothing)]
        for end, char in enumerate(text, 1):
            node = node[char]
            best, come = -1, end - 1
            for piece, size in node.ending:
                start = end - size
                may = after[start].get(piece)
                if may is None:
                    before = text[back[start] : start] if last[start] >= 0 else ""
                    may = self.merger.checked(before, text[start:end])
                if may:
                    best, come = piece, start
                    break
            last.append(best)
            back.append(come)
            after.append(follows.get(best, nothing))
        return self._path(len(text), 0, last, back)

    @staticmethod
    def _common(ends: range, base: int, back: list[int]) -> int:
        """The last boundary that the paths to all of ``ends`` share."""
        alive = set(ends)
        while len(alive) > 1:
            furthest = max(alive)
            alive.remove(furthest)
            alive.add(max(base, back[furthest - base]))
        return alive.pop()

    @staticmethod
    def _path(end: int, base: int, last: list[int], back: list[int]) -> list[tuple[int, int, int]]:
        path = []
        while end > base:
            path.append((last[end - base], back[end - base], end))
            end = back[end - base]
        return path[::-1]


class Encoder(dict):
    """Ids of a stretch of text as packed 32-bit numbers, remembered while there is room."""

    def __init__(self, vocab: Vocabulary):
        super().__init__()
        self.vocab = vocab
        self.stream = Stream(vocab)
        self.pairs = {p[i : i + 2] for p in vocab.scores for i in range(len(p) - 1)}
        if vocab.mark_leads:
            alone = {c for c in "\n\t\r" if not any(c in p for p in vocab.scores)}
            alone = re.escape("".join(sorted(alone)))
            # A word is a stretch without the sign behind it, if no piece has a letter before that sign.
            signs = {c for c in punctuation if not any(a.isalpha() and b == c for a, b in self.pairs)}
            numerals = "".join(sorted({a for a, _ in self.pairs if a.isalnum() and not a.isalpha()}))
            ahead = f"(?=[{re.escape(''.join(sorted(signs)))}])"
            word = f"{MARK}*+[^\\W\\d_{numerals}]++{ahead}|" if signs else ""
            self.stretches = re.compile(f"{word}{MARK}*[^{MARK}{alone}]+|{MARK}+|[{alone or MARK}]")
        else:
            self.stretches = re.compile("(?s).+")
        self.mark_ids = self.pack(self.spell(MARK))
        self.room = REMEMBERED_BYTES

    def _make_room(self, key: str, packed: bytes) -> None:
        """Forget all that is remembered when there is too much of it, in number or in bytes."""
        self.room -= ENTRY_BYTES + 4 * len(key) + len(packed)
        if self.room < 0 or len(self) >= REMEMBERED:
            self.clear()
            self.room = REMEMBERED_BYTES

    @staticmethod
    def pack(ids: list[int]) -> bytes:
        return array("i", ids).tobytes()

    def spell(self, piece: str) -> list[int]:
        """Ids of a piece that is not in the vocabulary."""
        ids = [self.vocab.byte_ids[b] for b in piece.encode()]
        return [self.vocab.unknown] if -1 in ids else ids

    def _ids(self, text: str) -> list[int]:
        ids: list[int] = []
        short = len(text) <= self.vocab.longest
        for piece, start, end in self.stream.word(text) if short else self.stream.search(text):
            if piece >= 0:
                ids.append(piece)
            else:
                ids.extend(self.spell(text[start:end]))
        return ids

    def __missing__(self, stretch: str) -> bytes:
        if len(stretch) > LONG_STRETCH:
            return self.pack(self._ids(stretch))
        pairs = self.pairs
        # Where no piece has the two neighbours side by side.
        cuts = [i for i, pair in enumerate(map(add, stretch, stretch[1:]), 1) if pair not in pairs]
        if cuts:
            bounds = zip([0, *cuts], [*cuts, len(stretch)])
            packed = b"".join([self[stretch[lo:hi]] for lo, hi in bounds])
        else:
            packed = self.pack(self._ids(stretch))
        self._make_room(stretch, packed)
        self[stretch] = packed
        return packed

    def _slices(self, text: str) -> Iterator[str]:
        start = 0
        while start < len(text):
            end = start + SLICE_CHARS
            if end < len(text) and self.vocab.mark_leads:
                # In front of a run of marks nothing can lie across.
                while end < len(text) and not (text[end] == MARK and text[end - 1] != MARK):
                    end += 1
            else:
                end = len(text)
            yield text[start:end]
            start = end

    def encode(self, text: str) -> np.ndarray:
        if not text:
            return np.empty(0, np.int32)
        out = []
        for i, part in enumerate((" " + text).split(MARK)):
            if i:
                out.append(self.mark_ids)
            for piece in self._slices(part.replace(" ", MARK)):
                out.extend(map(self.__getitem__, self.stretches.findall(piece)))
        return np.frombuffer(b"".join(out), np.int32)


_encoders: dict[int, Encoder] = {}


def _released(encoder: Encoder, results: Iterator[pa.Array]) -> Iterator[pa.Array]:
    try:
        yield from results
    finally:
        encoder.clear()
        encoder.room = REMEMBERED_BYTES


def task_encoder(key: int, vocab: Vocabulary) -> Encoder:
    """The encoder of this worker process for one broadcast model."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocab)
    return _encoders[key]


def decode_ids(ids: np.ndarray, spelled: list[bytes]) -> str:
    ids = ids[(ids >= 0) & (ids < len(spelled))]
    # Blocks of ids become Python numbers one after the other.
    blocks = (ids[i : i + BLOCK_IDS].tolist() for i in range(0, len(ids), BLOCK_IDS))
    data = b"".join([b"".join(map(spelled.__getitem__, block)) for block in blocks])
    text = data.decode("utf-8", "replace")
    return text[1:] if text.startswith(" ") else text


def _numbers(row: pa.ListScalar) -> np.ndarray:
    """Ids of a row; a NULL inside counts as out of range."""
    return row.values.fill_null(-1).to_numpy(zero_copy_only=False)


def _listed(rows: list[np.ndarray | None]) -> pa.ListArray:
    sizes = [0 if r is None else len(r) for r in rows]
    flat = [r for r in rows if r is not None]
    return pa.ListArray.from_arrays(
        pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()),
        pa.array(np.concatenate(flat) if flat else np.empty(0, np.int32)),
        mask=pa.array([r is None for r in rows]),
    )


def _encoding(spark: SparkSession, path: str, finish: Callable, kind: str) -> Callable:
    """An Arrow function over texts: ``finish`` makes a column of a batch's texts and their ids."""
    vocab = load(path)
    shared = spark.sparkContext.broadcast(vocab)
    key = hash((path, len(vocab.scores), uuid.uuid4()))

    def encode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encoder = task_encoder(key, shared.value)
        # Words are let go when the task ends: an idle worker keeps only what merging has taught it.
        yield from _released(encoder, encode_with(encoder, batches))

    def encode_with(encoder: Encoder, batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            rows = [encoder.encode(t.as_py()) if t.is_valid else None for t in batch]
            yield finish(encoder.vocab, batch, rows)

    return F.arrow_udf(encode, kind).asNondeterministic()


def encoded(spark: SparkSession, text: Column, path: str = MODEL) -> Column:
    """Ids of a text, ``array<int>``."""
    return _encoding(spark, path, lambda vocab, batch, rows: _listed(rows), "array<int>")(text)


def round_trip(spark: SparkSession, text: Column, path: str = MODEL) -> Column:
    """``ids`` of a text, and ``exact``: whether they decode to it. One worker encodes and decodes."""

    def finish(vocab: Vocabulary, batch: pa.Array, rows: list[np.ndarray | None]) -> pa.Array:
        exact = [None if r is None else decode_ids(r, vocab.spelled) == t.as_py() for t, r in zip(batch, rows)]
        return pa.StructArray.from_arrays([_listed(rows), pa.array(exact, pa.bool_())], ["ids", "exact"])

    return _encoding(spark, path, finish, "struct<ids:array<int>,exact:boolean>")(text)


def decoded(spark: SparkSession, ids: Column, path: str = MODEL) -> Column:
    """Text of an array of ids."""
    shared = spark.sparkContext.broadcast(load(path).spelled)

    def decode(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for batch in batches:
            # One row at a time: a batch of ids as Python numbers would be ten times its size.
            found = [decode_ids(_numbers(row), shared.value) if row.is_valid else None for row in batch]
            yield pa.array(found, pa.string())

    return F.arrow_udf(decode, "string").asNondeterministic()(ids)
