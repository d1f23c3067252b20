"""Packing documents into sequences of at most ``CONTEXT`` tokens: concatenate and cut.

1. Every whole text becomes ids plus an end id. A task counts on as it goes, so each row is written with the number
   of tokens before it in its partition. The table is written once; its order never changes after that, whatever
   executor is lost.
2. Partition totals (one row per partition, summed map-side) get prefix sums, which place each partition in one
   long row of tokens.
3. That row is cut at every ``CONTEXT`` tokens. A document is cut in its own row, inside the JVM, into
   boundary records: where the piece begins in its document and in its sequence, and its ids. Rows are never
   sorted or shuffled, and no task sees more than its own rows.

All sequences but the last are full, so there is no padding but there. Order is the order in which tables are read.

Ids are those of the tokenizer for the whole text. Its rules never look across ASCII white space. Slices of Latin letters
and common punctuation are cut into stretches of letters, digits and symbols as the tokenizer does, and a stretch that a task
has not met is merged in the tokenizer's own order (``Merger``). Slices with other characters go word by word, and their
odd words to the tokenizer itself. What is remembered is bounded in bytes.

Memory of a task: a batch of texts and its ids. A document needs four bytes per token, however long.

Defined cases: a NULL text is empty and has the end id only; so has an empty one; a text longer than a sequence
spans several; repeated rows and rows with the same or no doc_id are packed each on their own; an empty table gives an
empty result; other columns of the table are not read, so none can clash.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window
from tokenizers import Tokenizer

from citesift.llm.frames import column, stored, text_bytes
from citesift.llm.texts import slices

CONTEXT = 4096
END_ID = 2
REMEMBERED_BYTES = 96 << 20
ENTRY_BYTES = 180
PLAIN_BYTES = 1 << 14
SMALL_PARTS = 1 << 20

_ID = np.dtype("<u4")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class Merger:
    """Ids of one stretch of letters, digit or stretch of symbols, by the tokenizer's own merges.

    Made for byte-level models with word ends whose ids rise with the order of merging: bytes, bytes at a word's end,
    then one id per merge. The word's end is one more byte that no UTF-8 text has, and the first to be merged.
    """

    END = b"\xff"

    def __init__(self, model: dict):
        def spelled(token: str) -> bytes:
            whole = token.removesuffix("</w>")
            return bytes(map(_BYTE_OF.__getitem__, whole)) + self.END * (whole != token)

        n_special = len(model["vocab"]) - 512 - len(model["merges"])
        ordinary = sorted(model["vocab"], key=model["vocab"].get)[: len(model["vocab"]) - n_special]
        ranks = {spelled(token): model["vocab"][token] for token in ordinary}
        # The pattern is not used: stretches come one by one.
        self.encode = tiktoken.Encoding("word-ends", pat_str="x", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece

    def __call__(self, stretch: str) -> bytes:
        return array("I", self.encode(stretch.encode() + self.END)).tobytes()


def _byte_letters() -> dict[str, int]:
    """Byte-level models write printable bytes as themselves, and the others as the letters from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(others)}


_BYTE_OF = _byte_letters()
# Texts of these characters need no normal form and have one lower case, letter by letter.
_PLAIN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u2010-\u2027]+")
_STRETCH = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-z\u00df-\u00f6\u00f8-\u012f]+|[0-9]|[^\\sa-z0-9\u00df-\u00f6\u00f8-\u012f]+")


def merger(path: str) -> Merger | None:
    """The quick way for the words of most texts, if this is the kind of model that ``Merger`` knows."""
    with open(path, encoding="utf-8") as file:
        stated = json.load(file)
    model = stated["model"]
    known = model["type"] == "BPE" and model.get("end_of_word_suffix") == "</w>" and not model.get("ignore_merges")
    pattern = "[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+" in json.dumps(stated["pre_tokenizer"], ensure_ascii=False).replace("\\\\", "\\")
    merges = [m if isinstance(m, list) else m.split(" ") for m in model.get("merges", [])]
    in_order = all(model["vocab"].get("".join(m)) == 512 + i for i, m in enumerate(merges))
    bytes_first = all(
        model["vocab"].get(c, 512) < 256 and 256 <= model["vocab"].get(c + "</w>", 0) < 512 for c in _BYTE_OF
    )
    return Merger(model | {"merges": merges}) if known and pattern and in_order and bytes_first else None


class Remembered(dict):
    """A mapping that forgets all when it holds ``room`` bytes."""

    def __init__(self, room: int, make: Callable):
        super().__init__()
        self.most = self.room = room
        self.make = make

    def __missing__(self, key: str | bytes) -> bytes:
        value = self.make(key)
        cost = ENTRY_BYTES + len(key) + len(value)
        if cost > self.most // 64:
            return value
        if cost > self.room:
            self.clear()
            self.room = self.most
        self.room -= cost
        self[key] = value
        return value


class WordIds:
    """Ids of words as little-endian 32-bit numbers, remembered within ``REMEMBERED_BYTES``."""

    def __init__(self, path: str):
        self.tokenizer = Tokenizer.from_file(path)
        self.merger = merger(path)
        self.stretches = Remembered(REMEMBERED_BYTES // 2, self.merger)
        self.words = Remembered(REMEMBERED_BYTES // 2, self.ids)

    def asked(self, word: str) -> bytes:
        """What the tokenizer itself says."""
        return np.array(self.tokenizer.encode(word, add_special_tokens=False).ids, _ID).tobytes()

    def merged(self, text: str) -> bytes | None:
        """Ids of a text of plain characters, else None."""
        if self.merger is None or "<|" in text or not _PLAIN.fullmatch(text):
            return None
        return b"".join(map(self.stretches.__getitem__, _STRETCH.findall(text.lower())))

    def ids(self, word: bytes) -> bytes:
        text = word.decode("utf-8", "replace")
        found = self.merged(text)
        return self.asked(text) if found is None else found

    def encode(self, data: bytes) -> bytes:
        """Ids of a whole text."""
        out = []
        for piece in slices(data, PLAIN_BYTES):
            found = self.merged(piece.decode("utf-8", "replace"))
            out.append(b"".join(map(self.words.__getitem__, piece.split())) if found is None else found)
        return b"".join(out)


_known: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The words this worker process remembers; one tokenizer at a time."""
    if path not in _known:
        _known.clear()
        _known[path] = WordIds(path)
    return _known[path]


def tokenised(docs: DataFrame, text: str, key: str, path: str, end_id: int) -> DataFrame:
    """``key, ids, n, part, before``: packed ids with the end id, their number, the partition, and the tokens before in it."""
    kinds = docs.select(column(key).alias("key")).schema["key"].dataType.simpleString()
    end = np.array([end_id], _ID).tobytes()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part, before = word_ids(path), TaskContext.get().partitionId(), 0
        for batch in batches:
            ids = [words.encode(t.as_py()) + end for t in batch.column(1)]
            sizes = np.array([len(x) // _ID.itemsize for x in ids], np.int64)
            upto = before + np.cumsum(sizes)
            before = int(upto[-1]) if len(ids) else before
            columns = [batch.column(0), pa.array(ids, pa.binary()), pa.array(sizes)]
            columns += [pa.array(np.full(len(ids), part, np.int32)), pa.array(upto - sizes)]
            yield pa.RecordBatch.from_arrays(columns, ["key", "ids", "n", "part", "before"])

    rows = docs.select(column(key).alias("key"), text_bytes(text).alias("data"))
    return rows.mapInArrow(encode, f"key {kinds}, ids binary, n bigint, part int, before bigint")


def partition_bases(rows: DataFrame) -> DataFrame:
    """``part, base``: the tokens in all partitions before. One row per partition of the written table."""
    totals = rows.groupBy("part").agg(F.sum("n").alias("total"))
    return totals.select("part", (F.sum("total").over(Window.orderBy("part")) - F.col("total")).alias("base"))


def pack(
    docs: DataFrame,
    text: str = "text",
    key: str = "doc_id",
    path: str | None = None,
    context: int = CONTEXT,
    end_id: int = END_ID,
) -> DataFrame:
    """Pieces ``key, start, length, ids, doc_tokens, sequence_id, offset``; ids are packed 32-bit numbers.

    ``start`` counts the document's ids before the piece, ``offset`` the ids before it in its sequence.
    """
    rows = stored(tokenised(docs, text, key, path or default_path(), end_id), "packed-ids")
    bases = stored(partition_bases(rows), "packed-bases")
    bases = F.broadcast(bases) if bases.count() <= SMALL_PARTS else bases  # twelve bytes a row
    at = F.col("base") + F.col("before")
    placed = rows.join(bases, "part").select("key", "ids", at.alias("at"), F.col("n").alias("doc_tokens"))

    def piece(sequence: Column) -> Column:
        begin = F.greatest(F.col("at"), sequence * context)
        end = F.least(F.col("at") + F.col("doc_tokens"), (sequence + 1) * context)
        start = begin - F.col("at")
        first = (start * _ID.itemsize + 1).cast("int")
        return F.struct(
            start.alias("start"),
            (end - begin).alias("length"),
            F.substring(F.col("ids"), first, ((end - begin) * _ID.itemsize).cast("int")).alias("ids"),
            sequence.alias("sequence_id"),
            (begin - sequence * context).alias("offset"),
        )

    first = F.expr(f"at div {context}")
    last = F.expr(f"(at + doc_tokens - 1) div {context}")
    pieces = F.transform(F.sequence(first, last), piece)
    cut = placed.select("key", "doc_tokens", F.explode(pieces).alias("piece"))
    return cut.select(F.col("key").alias(key), "doc_tokens", "piece.*")


def sequences(pieces: DataFrame) -> DataFrame:
    """``sequence_id, length, ids``: whole sequences, put together from at most one piece per token."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    whole = pieces.groupBy("sequence_id").agg(parts.alias("parts"), F.sum("length").alias("length"))
    joined = F.aggregate("parts", F.lit(b""), lambda all_, x: F.concat(all_, x["ids"]))
    return whole.select("sequence_id", "length", joined.alias("ids"))
