"""Ranked lexical search over all documents, with the index partitioned by term.

1. **Bags.** Each whole text becomes its number of terms and, for the terms that items ask for, how often each
   occurs (one Arrow task, no shuffle). Texts are read once.
2. **Counts.** Documents with terms, all terms, and documents per term are sums over all bags.
3. **Owners.** Terms are dealt to ``OWNERS`` owners by rising frequency, each with about as many postings. Documents
   are dealt to blocks of about ``BLOCK_DOCS``; a block's posting lists are written by owner, and hold what a term
   adds to the score of each document (64-bit integers).
4. **Pipeline.** Per block and item there is a bundle: the item's terms and a sparse accumulator (documents and sums).
   The bundles pass the owners one after the other. At each, they are cogrouped with its
   posting lists by block, the owner adds its contributions, takes its terms out of the bundle, and sends it on.
   Documents that cannot come among the block's best any more, even with the most that the owners to come can add
   there, are not sent on; this is exact, as their bound lies below the score of enough others.
5. **Selection.** The last owner keeps the best of the block, and the best of all blocks are ranked per item.

No group grows with the data: blocks are bounded by their count of documents, and documents are dealt by a hash of
their row, so equal ids or copies do not meet. An accumulator holds one entry a document of the block at most.
Items are taken ``ITEMS_AT_ONCE`` at a time and as many as have ``VOCABULARY_BYTES`` of text, so that
terms fit every task; all documents are read for each such block of items.

Defined cases: a NULL text has no terms; documents without terms count nowhere; an item without terms, or whose terms
no document has, gives no rows; a repeated term of an item adds again; repeated documents are ranked each on their own,
as are items with the same id; ties go by ascending doc_id, NULL first; long texts are read slice by slice; without
documents or items the result is empty; other columns are not read, so none can clash.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from citesift.llm.frames import column, stored, text_bytes
from citesift.llm.texts import slices

BEST = 20
OWNERS = 4
BLOCK_DOCS = 1 << 14
ITEMS_AT_ONCE = 512
VOCABULARY_BYTES = 16 << 20

# Term characters: ASCII letters and digits, and everything outside ASCII. Only A-Z are lower-cased.
_TABLE = bytes(
    c + 32 if 0x41 <= c <= 0x5A else c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else 0x20
    for c in range(256)
)

Parts = "places binary, gains binary"
LISTS = f"block int, owner int, term int, {Parts}, ids array<bigint>"
BUNDLE = f"block int, item int, terms array<int>, times array<int>, floor bigint, {Parts}"


def terms_of(data: bytes) -> Iterator[list[bytes]]:
    """The terms of a text, slice by slice."""
    for piece in slices(data.translate(_TABLE)):
        yield piece.split()


class Counts(NamedTuple):
    """What a score needs from the corpus."""

    n_docs: int  # documents with a term
    n_terms: int  # terms of all documents

    def weight(self, df: int) -> int:
        return math.floor(1000 * math.log((2 * self.n_docs + 2) / (2 * df + 1)))

    def gains(self, weight: np.ndarray, tf: np.ndarray, size: np.ndarray) -> np.ndarray:
        """What each posting adds: ``weight * (10^9 tf div (1000 tf + 12 m))``, rounded down in 64 bits."""
        m = 75 + 25 * size * self.n_docs // max(1, self.n_terms)
        return weight * (1_000_000_000 * tf // (1000 * tf + 12 * m))


class Item(NamedTuple):
    number: int
    terms: dict[int, int]  # term: times it stands in the item


# ------------------------------------------------------------------ bags and counts


def bags(docs: DataFrame, text: str, key: str, vocabulary: dict[bytes, int]) -> DataFrame:
    """``id, row, size, terms, tfs``: the terms of the vocabulary in each document that has any term."""
    shared = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def count(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        known = shared.value
        for batch in batches:
            found = []
            for data in batch:
                size, held = 0, Counter()
                for words in terms_of(data.as_py()):
                    size += len(words)
                    held.update(words)
                wanted = [(known[w], n) for w, n in held.items() if w in known]
                found.append({"size": size, "terms": [t for t, _ in wanted], "tfs": [n for _, n in wanted]})
            yield pa.array(found, pa.struct([("size", pa.int64()), ("terms", pa.list_(pa.int32())), ("tfs", pa.list_(pa.int32()))]))

    bag = F.arrow_udf(count, "struct<size:bigint,terms:array<int>,tfs:array<int>>").asNondeterministic()
    rows = docs.select(column(key).cast("bigint").alias("id"), bag(text_bytes(text)).alias("bag"))
    rows = rows.select("id", F.monotonically_increasing_id().alias("row"), "bag.*")
    return rows.where("size > 0")


def frequencies(bag: DataFrame) -> dict[int, int]:
    """Documents per term; the vocabulary is bounded, and so is this."""
    counted = bag.select(F.explode("terms").alias("term")).groupBy("term").count()
    return {r["term"]: r["count"] for r in counted.collect()}


def owners_of(df: dict[int, int], owners: int) -> dict[int, int]:
    """Terms to owners, rare ones first, with about as many postings each."""
    total, upto, owner = sum(df.values()), 0, {}
    for term in sorted(df, key=lambda t: (df[t], t)):
        owner[term] = min(owners - 1, upto * owners // total)
        upto += df[term]
    return owner


# ------------------------------------------------------------------ posting lists


def posting_lists(
    bag: DataFrame, n_blocks: int, counts: Counts, df: dict[int, int], owner: dict[int, int], owners: int
) -> DataFrame:
    """``LISTS``: per block and term, the places of documents and what the term adds to them.

    A place is the rank of a document in its block by id. Each owner also gets one row per block without a term: in
    ``places`` and ``gains`` the most that each term adds there, and in ``ids`` the block's ids.
    """
    size = max(df, default=-1) + 1
    weight, owned = np.zeros(size, np.int64), np.zeros(size, np.int32)
    for term, n in df.items():
        weight[term], owned[term] = counts.weight(n), owner[term]
    shared = bag.sparkSession.sparkContext.broadcast((weight, owned))

    def invert(key: tuple, table: pa.Table) -> pa.Table:
        weight, owned = shared.value
        table = table.combine_chunks().sort_by([("id", "ascending"), ("row", "ascending")])
        # Arrow sorts missing ids last; they come first.
        missing = table["id"].null_count
        order = np.roll(np.arange(len(table)), missing)
        table = table.take(pa.array(order))
        ids, sizes = table["id"].combine_chunks(), table["size"].to_numpy()
        lists = table["terms"].combine_chunks()
        held = np.diff(lists.offsets.to_numpy())
        places = np.repeat(np.arange(len(table), dtype=np.int32), held)
        terms = lists.flatten().to_numpy()
        tfs = table["tfs"].combine_chunks().flatten().to_numpy().astype(np.int64)
        gains = counts.gains(weight[terms], tfs, sizes[places])
        order = np.argsort(terms, kind="stable")
        terms, places, gains = terms[order], places[order], gains[order]
        starts = np.flatnonzero(np.diff(terms, prepend=-1))
        distinct, ends = terms[starts], np.append(starts[1:], len(terms))
        most = np.maximum.reduceat(gains, starts) if len(starts) else gains
        rows = [
            {"owner": o, "term": None, "places": distinct.tobytes(), "gains": most.tobytes()} for o in range(owners)
        ]
        for term, a, b in zip(distinct.tolist(), starts.tolist(), ends.tolist()):
            rows.append({"owner": owned[term], "term": term, "places": places[a:b].tobytes(), "gains": gains[a:b].tobytes()})
        block = pa.array([key[0].as_py()] * len(rows), pa.int32())
        kinds = {"owner": pa.int32(), "term": pa.int32(), "places": pa.binary(), "gains": pa.binary()}
        columns = [pa.array([r[c] for r in rows], kind) for c, kind in kinds.items()]
        head = [None] * len(rows)
        head[owners - 1] = ids.to_pylist()
        return pa.Table.from_arrays([block, *columns, pa.array(head, pa.list_(pa.int64()))], ["block", *kinds, "ids"])

    block = F.pmod(F.xxhash64("row"), F.lit(n_blocks)).cast("int")
    return bag.withColumn("block", block).groupBy("block").applyInArrow(invert, LISTS)


# ------------------------------------------------------------------ the pipeline


def visit(block: int, lists: pa.Table, bundles: pa.Table, best: int) -> Iterator[dict]:
    """One owner adds its contributions to the bundles of a block and sends on what can still win."""
    held, most, n = {}, {}, 0
    for r in lists.select(["term", "places", "gains"]).to_pylist():
        places, gains = np.frombuffer(r["places"], np.int32), np.frombuffer(r["gains"], np.int64)
        if r["term"] is None:
            most = dict(zip(places.tolist(), gains.tolist()))
        else:
            held[r["term"]] = (places, gains)
            n = max(n, int(places[-1]) + 1)
    for i in range(len(bundles)):
        bundle = {c: bundles[c][i].as_py() for c in bundles.column_names}
        was = np.frombuffer(bundle["places"], np.int32)
        sums = np.zeros(max(n, int(was[-1]) + 1 if len(was) else 0), np.int64)
        sums[was] = np.frombuffer(bundle["gains"], np.int64)
        rest, left = 0, {}
        for term, times in zip(bundle["terms"], bundle["times"]):
            if term in held:
                places, gains = held[term]
                sums[places] += times * gains
            elif term in most:  # a later owner's
                left[term] = times
                rest += times * most[term]
        found = np.flatnonzero(sums)
        floor = bundle["floor"]
        if len(found) > best:
            floor = max(floor, int(np.partition(sums[found], -best)[-best]))
        found = found[sums[found] + rest >= floor]
        yield {
            "block": block,
            "item": bundle["item"],
            "terms": list(left),
            "times": list(left.values()),
            "floor": floor,
            "places": found.astype(np.int32).tobytes(),
            "gains": sums[found].tobytes(),
        }


_INTS = pa.list_(pa.int32())
_BUNDLE = pa.schema(
    [("block", pa.int32()), ("item", pa.int32()), ("terms", _INTS), ("times", _INTS), ("floor", pa.int64()), ("places", pa.binary()), ("gains", pa.binary())]
)
_FOUND = pa.schema([("item", pa.int32()), ("id", pa.int64()), ("score", pa.int64()), ("place", pa.int64())])


def passed(key: tuple, lists: pa.Table, bundles: pa.Table, best: int) -> pa.Table:
    return pa.Table.from_pylist(list(visit(key[0].as_py(), lists, bundles, best)), _BUNDLE)


def selected(key: tuple, lists: pa.Table, bundles: pa.Table, best: int) -> pa.Table:
    """The last owner: after its contributions, the best documents of the block for each item."""
    block = key[0].as_py()
    ids = [x for r in lists["ids"].to_pylist() if r for x in r]
    rows = []
    for bundle in visit(block, lists, bundles, best):
        places, sums = np.frombuffer(bundle["places"], np.int32), np.frombuffer(bundle["gains"], np.int64)
        for i in np.lexsort((places, -sums))[:best].tolist():
            place = int(places[i])
            rows.append({"item": bundle["item"], "id": ids[place], "score": int(sums[i]), "place": block * BLOCK_DOCS * 4 + place})
    return pa.Table.from_pylist(rows, _FOUND)


def at_owner(step: Callable, best: int) -> Callable:
    """The step as a function of a group, which Spark tells by its number of arguments."""

    def work(key: tuple, lists: pa.Table, bundles: pa.Table) -> pa.Table:
        return step(key, lists, bundles, best)

    return work


def first_bundles(spark: SparkSession, items: list[Item], n_blocks: int) -> DataFrame:
    """Every item's empty bundle, in every block of documents."""
    rows = [(i.number, list(i.terms), list(i.terms.values())) for i in items]
    stated = spark.createDataFrame(rows, "item int, terms array<int>, times array<int>")
    blocks = F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1)))
    nothing = F.lit(b"")
    return stated.select(
        blocks.alias("block"), "item", "terms", "times", F.lit(0).cast("bigint").alias("floor"), nothing.alias("places"), nothing.alias("gains")
    )


def through_owners(lists: DataFrame, bundles: DataFrame, owners: int, best: int) -> DataFrame:
    """``item, id, score, place``: the best of each block after all owners in turn."""
    for owner in range(owners):
        own = lists.where(F.col("owner") == owner).drop("owner").groupBy("block")
        last = owner == owners - 1
        kinds = "item int, id bigint, score bigint, place bigint" if last else BUNDLE
        step = at_owner(selected if last else passed, best)
        bundles = own.cogroup(bundles.groupBy("block")).applyInArrow(step, kinds)
    return bundles


# ------------------------------------------------------------------ items


def blocks_of_items(items: DataFrame, text: str, key: str) -> Iterator[list[tuple[int, int | None, bytes]]]:
    """Items in blocks of bounded number and size: ``(number, id, text)``."""
    rows = items.select(column(key).cast("bigint").alias("id"), text_bytes(text).alias("data"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "search-items")
    block, size = [], 0
    for r in rows.toLocalIterator():
        if block and (len(block) == ITEMS_AT_ONCE or size + len(r["data"]) > VOCABULARY_BYTES):
            yield block
            block, size = [], 0
        block.append((len(block), r["id"], bytes(r["data"])))
        size += len(r["data"])
    if block:
        yield block


def _search_block(docs: DataFrame, block: list, text: str, key: str, best: int, owners: int) -> DataFrame:
    spark, vocabulary, items = docs.sparkSession, {}, []
    for number, _, data in block:
        times = Counter()
        for words in terms_of(data):
            times.update(words)
        items.append(Item(number, {vocabulary.setdefault(w, len(vocabulary)): n for w, n in times.items()}))
    bag = stored(bags(docs, text, key, vocabulary), "search-bags")
    n_docs, n_terms = bag.agg(F.count(F.lit(1)), F.coalesce(F.sum("size"), F.lit(0))).first()
    df = frequencies(bag)
    owner = owners_of(df, owners)
    n_blocks = max(1, -(-n_docs // BLOCK_DOCS))
    lists = posting_lists(bag, n_blocks, Counts(n_docs, n_terms), df, owner, owners)
    lists = stored(lists, "search-lists", by="owner")
    asked = [i._replace(terms={t: n for t, n in i.terms.items() if t in df}) for i in items]
    asked = [i for i in asked if i.terms]
    found = through_owners(lists, first_bundles(spark, asked, n_blocks), owners, best)
    names = spark.createDataFrame([(n, i) for n, i, _ in block], "item int, item_id bigint")
    order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("id").asc_nulls_first(), "place")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= best)
    return ranked.join(F.broadcast(names), "item").select("item_id", "rank", F.col("id").alias("doc_id"), "score")


def ranked_search(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    doc_key: str = "doc_id",
    item_key: str = "item_id",
    item_text: str = "text",
    best: int = BEST,
    owners: int = OWNERS,
) -> DataFrame:
    """``item_id, rank, doc_id, score``: each item's ``best`` documents with a score above 0."""
    found = None
    for block in blocks_of_items(items, item_text, item_key):
        part = _search_block(docs, block, text, doc_key, best, owners)
        found = part if found is None else found.unionByName(part)
    if found is None:
        return docs.sparkSession.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    return found
