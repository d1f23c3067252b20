"""Near-duplicate documents by HyperMinHash, confirmed on full shingle sets.

Words are runs of characters other than white space, with A-Z in lower case; a text is the set of its
five-word shingles.

Sketch: the hash space is cut into ``BANDS * ROWS`` buckets; of the smallest hash in each, the number
of leading zeros and the next mantissa bits are kept, one byte together, 0 for an empty bucket. For
banding, empty buckets show the register of another one, chosen by a fixed preference list per bucket,
so that every register agrees with probability J whatever the length. A band is seven registers, packed
in one 64-bit number. With 80 bands a pair at J = 0.75 shares none with probability
(1 - 0.75 ** 7) ** 80 = 1e-5.

Links are wanted for connected components, so pairs inside a group are not spelled out:

1. Every text gets one link candidate: the best connected member (hub) of its buckets.
2. Texts whose component still differs from that of the hub of a bucket are compared with that hub.
3. All pairs of one bucket that still lie in different components are compared, with no cap, in
   blocks of bounded size. After 1 and 2 a group of copies is one component, and such pairs are few.

A candidate must pass the sizes, then the Jaccard estimate of the two sketches, corrected for chance
agreement of one-byte registers and lowered by ``SLACK`` standard errors (see ``may_link``), then the exact test
100 * intersection >= 75 * union on the full sets.

Equal shingle sets are one vertex, so copies cost one comparison. A vertex is named by a 64-bit hash of its set.

Defined cases: NULL and empty texts, or texts without words, are linked with nothing; texts under
five words are one shingle; repeated rows are copies; NULL ids lose against any other id; an empty
table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from citesift.llm.components import connected
from citesift.llm.frames import column, fresh, small, stored, text_bytes
from citesift.llm.texts import WordHashes, mix, shingle_set, word_hashes

BANDS, ROWS = 80, 7
REGISTERS = BANDS * ROWS
MANTISSA_BITS = 4
MAX_ZEROS = 15
PERCENT = 75
SLACK = 4
SIZE_CLASSES = 32
BLOCK_ROWS = 1024
PAIR_CHUNK = 8192

SKETCH_TYPE = "struct<v:bigint,n:bigint,bands:array<bigint>,registers:array<bigint>>"
SET_TYPE = "struct<v:bigint,n:bigint,shingles:array<bigint>>"

_edges = (np.arange(REGISTERS, dtype=np.uint64) * np.uint64(2**64 // REGISTERS)).astype(np.uint64)
_width = float(2**64 // REGISTERS)


class Preferences:
    """For each register the order in which it copies others while it is empty.

    ``order[a, j]`` is the register that j asks in its attempt a, ``rank[j, b]`` the attempt in which
    j asks b. Both give the same answer; which is faster depends on how many registers are filled.
    """

    ATTEMPTS = 24

    def __init__(self) -> None:
        random = np.random.Generator(np.random.PCG64(20))
        registers = np.arange(REGISTERS, dtype=np.uint16)
        orders = random.permuted(np.tile(registers, (REGISTERS, 1)), axis=1)
        self.rank = np.empty_like(orders)
        np.put_along_axis(self.rank, orders, np.broadcast_to(registers, orders.shape), axis=1)
        self.order = np.ascontiguousarray(orders[:, : self.ATTEMPTS].T)

    def sources(self, filled: np.ndarray) -> np.ndarray:
        """For every register the filled one it shows: itself, or the first filled one it asks."""
        source = np.arange(REGISTERS)
        chosen, empty = np.flatnonzero(filled), np.flatnonzero(~filled)
        if len(chosen) > 32:
            asked = self.order[:, empty]
            hit = filled[asked]
            first = hit.argmax(axis=0)
            columns = np.arange(len(empty))
            source[empty] = asked[first, columns]
            empty = empty[~hit[first, columns]]
        if len(empty):
            source[empty] = chosen[self.rank[np.ix_(empty, chosen)].argmin(axis=1)]
        return source


def registers(shingles: np.ndarray) -> np.ndarray:
    """One byte per bucket from sorted distinct shingles: 1 + zeros and mantissa, 0 if empty."""
    first = np.searchsorted(shingles, _edges)
    full = first < np.append(first[1:], len(shingles))
    chosen = np.flatnonzero(full)
    rest = (shingles[first[chosen]] - _edges[chosen]).astype(np.float64) / _width
    fraction, exponent = np.frexp(np.clip(rest, 2.0**-60, 1 - 2.0**-53))
    zeros = np.minimum(-exponent, MAX_ZEROS)
    mantissa = ((fraction * 2 - 1) * (1 << MANTISSA_BITS)).astype(np.int64)
    out = np.zeros(REGISTERS, np.uint8)
    out[chosen] = np.minimum(254, (zeros << MANTISSA_BITS) | mantissa) + 1
    return out


def packed(codes: np.ndarray) -> np.ndarray:
    """Registers as one 64-bit number per band; the bytes left over are 0."""
    out = np.zeros((BANDS, 8), np.uint8)
    out[:, :ROWS] = codes.reshape(BANDS, ROWS)
    return out.view(np.int64).ravel()


def set_key(shingles: np.ndarray) -> int:
    """64-bit name of a set, the same for every order."""
    total = (mix(shingles).sum(dtype=np.uint64) + np.uint64(len(shingles))).reshape(1)
    return int(mix(total).view(np.int64)[0])


def _sketch(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known, preferences = WordHashes(), Preferences()
    for batch in batches:
        keys, sizes, bands, plain, offsets = [], [], [], [], [0]
        for data in batch:
            shingles = shingle_set(word_hashes(data.as_py().lower(), known))
            sizes.append(len(shingles))
            keys.append(set_key(shingles))
            if len(shingles):
                codes = registers(shingles)
                plain.append(packed(codes))
                bands.append(packed(codes[preferences.sources(codes > 0)]))
            offsets.append(offsets[-1] + (BANDS if len(shingles) else 0))
        places = pa.array(offsets, pa.int32())
        lists = [
            pa.ListArray.from_arrays(places, pa.array(np.concatenate(x) if x else np.empty(0, np.int64), pa.int64()))
            for x in (bands, plain)
        ]
        yield pa.StructArray.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), *lists], ["v", "n", "bands", "registers"]
        )


def _set(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
    known = WordHashes()
    for batch in batches:
        sets = [shingle_set(word_hashes(data.as_py().lower(), known)) for data in batch]
        sizes = [len(s) for s in sets]
        flat = np.concatenate(sets) if sets else np.empty(0, np.uint64)
        offsets = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
        yield pa.StructArray.from_arrays(
            [
                pa.array([set_key(s) for s in sets], pa.int64()),
                pa.array(sizes, pa.int64()),
                pa.ListArray.from_arrays(offsets, pa.array(flat.view(np.int64), pa.int64())),
            ],
            ["v", "n", "shingles"],
        )


def collision_rate(n_a: float, n_b: float) -> float:
    """Share of the buckets filled by either of two unrelated sets of these sizes in which they agree.

    Sum over all register values of the product of their probabilities: the smallest of a Poisson
    number of uniform values falls into [l, u) with probability exp(-n l) - exp(-n u), n per bucket.
    """
    cells = 1 << MANTISSA_BITS
    zeros = np.arange(MAX_ZEROS)
    lower = np.append(0.0, (2.0 ** -(zeros[::-1, None] + 1) * (1 + np.arange(cells) / cells)).ravel())
    upper = np.append(lower[1:], 1.0)
    chance = [np.exp(-n / REGISTERS * lower) - np.exp(-n / REGISTERS * upper) for n in (n_a, n_b)]
    return float((chance[0] * chance[1]).sum() / (1 - np.exp(-(n_a + n_b) / REGISTERS)))


def collision_rates() -> np.ndarray:
    """``collision_rate`` by classes of sizes, powers of two."""
    sizes = 1.5 * 2.0 ** np.arange(SIZE_CLASSES)
    return np.array([[collision_rate(a, b) for b in sizes] for a in sizes])


def _size_class(n: np.ndarray) -> np.ndarray:
    return np.minimum(np.log2(n).astype(int), SIZE_CLASSES - 1)


def estimate(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Jaccard similarity of rows of registers, corrected for chance collisions.

    Agreeing buckets over buckets that either set fills, which for short texts is nearly exact.
    """
    agree = ((a == b) & (a != 0)).sum(axis=1)
    share = agree / np.maximum(1, ((a | b) != 0).sum(axis=1))
    chance = rates[_size_class(n_a), _size_class(n_b)]
    return (share - chance) / (1 - chance)


def standard_error(union: np.ndarray) -> np.ndarray:
    """Standard error of the estimate at the threshold, for sets whose union has this size.

    Filled registers are draws without replacement from the union, so a short text leaves little to
    chance.
    """
    filled = (1 - np.exp(-union / REGISTERS)) * REGISTERS
    at = PERCENT / 100
    return np.sqrt(at * (1 - at) / filled * np.maximum(0.0, 1 - filled / union))


def may_link(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, rates: np.ndarray) -> np.ndarray:
    """Sizes allow the similarity, and the estimate does not rule it out.

    The estimate may lie ``SLACK`` standard errors below the threshold, and two elements of the union
    more, since the error of very short texts comes in whole elements.
    """
    fewer, more = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    out = 100 * fewer >= PERCENT * more
    union = (n_a + n_b) / (1 + PERCENT / 100)
    floor = PERCENT / 100 - SLACK * standard_error(union) - 2 / union
    at = np.flatnonzero(out)
    for i in range(0, len(at), PAIR_CHUNK):
        part = at[i : i + PAIR_CHUNK]
        out[part] = estimate(a[part], b[part], n_a[part], n_b[part], rates) >= floor[part]
    return out


def _bytes(lists: pa.Array, n: int) -> np.ndarray:
    """Rows of registers from lists of 64-bit numbers."""
    return np.ascontiguousarray(_numbers(lists, n)).view(np.uint8)


def _numbers(lists: pa.Array, n: int) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(n, BANDS)


def _likely(a: pa.Array, b: pa.Array, n_a: pa.Array, n_b: pa.Array) -> pa.Array:
    n = len(a)
    sizes = (n_a.to_numpy(), n_b.to_numpy())
    return pa.array(may_link(_bytes(a, n), _bytes(b, n), *sizes, collision_rates()) if n else [], pa.bool_())


def _pairs_inside(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs ``a, b`` of rows of one ``pack`` (neighbouring rows) that may be links.

    Only pairs of different components, of the two blocks that the pack is for, and in the first
    band that the two share. Rows of the last pack of a batch wait for the next batch; packs are bounded.
    """
    rates, rest = collision_rates(), None
    for batch in itertools.chain(batches, [None]):
        if batch is not None:
            rest = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])])
        if rest is None or not len(rest):
            continue
        pack = rest["pack"].to_numpy()
        ended = np.flatnonzero(pack != pack[-1])
        n = len(pack) if batch is None else int(ended[-1]) + 1 if len(ended) else 0
        now, rest = rest.slice(0, n), rest.slice(n)
        if not n:
            continue
        pack = pack[:n]
        v, root, size, band, block, across = (
            now[c].to_numpy() for c in ("v", "root", "n", "band", "block", "across")
        )
        bands = _numbers(now["bands"].combine_chunks(), n)
        plain = _bytes(now["registers"].combine_chunks(), n)
        step = 1
        while step < n:
            left = np.flatnonzero(pack[:-step] == pack[step:])
            if not len(left):
                break
            left = left[(root[left] != root[left + step]) & ((block[left] != block[left + step]) == across[left])]
            for i in range(0, len(left), PAIR_CHUNK):
                x = left[i : i + PAIR_CHUNK]
                y = x + step
                good = may_link(plain[x], plain[y], size[x], size[y], rates)
                x, y = x[good], y[good]
                first = (bands[x] == bands[y]).argmax(axis=1) == band[x]
                x, y = x[first], y[first]
                if len(x):
                    yield pa.record_batch([pa.array(v[x]), pa.array(v[y])], ["a", "b"])
            step += 1


class _Search:
    """Candidate pairs and their confirmation; tables are written once and read by every step."""

    def __init__(self, docs: DataFrame, doc: str, text: str):
        rows = docs.select(
            column(doc).alias("doc_id"),
            text_bytes(text).alias("data"),
        )
        sketch = F.arrow_udf(_sketch, SKETCH_TYPE).asNondeterministic()
        rows = rows.select(
            "doc_id", F.xxhash64("data").alias("text_key"), sketch("data").alias("s")
        ).select("doc_id", "text_key", "s.*")
        self.sketches = stored(rows, "sketches")
        self.members = stored(self._members(), "members")
        self._vertices()
        self._full_sets(docs, doc, text)

    def _members(self) -> DataFrame:
        """``bucket, band, v, size``: all buckets with at least two different sets."""
        bands = self.sketches.select("v", F.posexplode("bands").alias("band", "value"))
        bands = bands.select("v", "band", F.xxhash64("band", "value").alias("bucket"))
        # Copies fold into one row map-side where they meet.
        sizes = bands.groupBy("bucket").agg(F.min("v").alias("low"), F.max("v").alias("high"))
        shared = sizes.where(F.col("low") != F.col("high")).select("bucket")
        members = bands.join(shared, "bucket").groupBy("bucket", "band", "v").agg(F.lit(1).alias("one"))
        members = stored(members.drop("one"), "bucket-members")
        sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("size"))
        return members.join(sizes, "bucket")

    def _vertices(self) -> None:
        """``v, doc_id, n, bands, registers`` of every set that shares a bucket, from its smallest document."""
        wanted = stored(self.members.select("v").distinct(), "wanted")
        self.n_vertices = wanted.count()
        rows = self.sketches.join(small(wanted, self.n_vertices, 16), "v", "left_semi")
        self.vertices = stored(
            rows.groupBy("v").agg(
                F.min("doc_id").alias("doc_id"),
                F.max("n").alias("n"),
                F.any_value("bands").alias("bands"),
                F.any_value("registers").alias("registers"),
            ),
            "vertices",
        )

    def _full_sets(self, docs: DataFrame, doc: str, text: str) -> None:
        """Shingle sets of the vertices, computed from one document each."""
        ids = small(self.vertices.select(F.col("doc_id").alias("of")), self.n_vertices, 16)
        rows = docs.select(column(doc).alias("doc_id"), text_bytes(text).alias("data"))
        rows = rows.join(ids, F.col("doc_id").eqNullSafe(F.col("of")), "left_semi")
        full = F.arrow_udf(_set, SET_TYPE).asNondeterministic()
        rows = rows.select(full("data").alias("s")).select("s.*")
        rows = rows.join(small(self.vertices.select("v"), self.n_vertices, 16), "v", "left_semi")
        self.sets = stored(rows, "shingle-sets")
        n_shingles = self.sets.agg(F.sum("n")).first()[0] or 0
        self.set_bytes = 8 * n_shingles // max(1, self.n_vertices) + 32

    def likely(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that sizes and sketches do not rule out."""
        sketch = self.vertices.select("v", "n", "registers")
        left = sketch.toDF("a", "n_a", "registers_a")
        right = sketch.toDF("b", "n_b", "registers_b")
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        likely = F.arrow_udf(_likely, "boolean")("registers_a", "registers_b", "n_a", "n_b")
        return pairs.join(left, "a").join(right, "b").where(likely).select("a", "b")

    def confirmed(self, pairs: DataFrame) -> DataFrame:
        """The pairs ``a, b`` that are links, by their full sets."""
        sets = small(self.sets, self.n_vertices, self.set_bytes, 16 << 20)
        common = F.size(F.array_intersect("shingles_a", "shingles_b")).cast("bigint")
        return stored(
            stored(pairs, "likely")
            .join(sets.toDF("a", "n_a", "shingles_a"), "a")
            .join(sets.toDF("b", "n_b", "shingles_b"), "b")
            .withColumn("common", common)
            .where(100 * F.col("common") >= PERCENT * (F.col("n_a") + F.col("n_b") - F.col("common")))
            .select("a", "b"),
            "confirmed",
        )

    def _hubs(self) -> DataFrame:
        """``bucket, hub, weight``: the member of each bucket that shares buckets with most others."""
        weights = self.members.groupBy("v").agg(F.sum(F.col("size") - 1).alias("weight"))
        weighed = self.members.join(weights, "v")
        best = weighed.groupBy("bucket").agg(F.max(F.struct("weight", "v")).alias("best"))
        return best.select("bucket", F.col("best.v").alias("hub"), F.col("best.weight").alias("weight"))

    def _placed(self, links: DataFrame) -> DataFrame:
        """Members with the root of their component so far."""
        roots = connected(links)
        return self.members.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))

    def links(self) -> DataFrame:
        """All links that components need."""
        hubs = stored(self._hubs(), "hubs")
        beside = self.members.join(hubs, "bucket").where(F.col("hub") != F.col("v"))
        best = beside.groupBy("v").agg(F.max(F.struct("weight", "hub")).alias("best"))
        links = self.confirmed(self.likely(best.select(F.col("v").alias("a"), F.col("best.hub").alias("b"))))

        placed = stored(self._placed(links), "placed")
        at_hub = placed.join(hubs, "bucket").where(F.col("hub") == F.col("v"))
        at_hub = at_hub.select("bucket", "hub", F.col("root").alias("hub_root"))
        apart = placed.join(at_hub, "bucket").where(F.col("root") != F.col("hub_root"))
        more = self.confirmed(self.likely(apart.select(F.col("v").alias("a"), F.col("hub").alias("b"))))
        links = stored(links.union(more), "links")

        placed = stored(self._placed(links), "placed")
        mixed = placed.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high"))
        mixed = mixed.where(F.col("low") != F.col("high")).select("bucket")
        open_ = stored(placed.join(mixed, "bucket", "left_semi").select("bucket", "band", "v", "root"), "open")
        last = self.confirmed(self._inside(open_).distinct())
        return links.union(last)

    def _inside(self, rows: DataFrame) -> DataFrame:
        """Pairs inside buckets that sketches do not rule out.

        A bucket is cut into blocks of about ``BLOCK_ROWS`` by hash, and every two blocks meet in a
        pack, so that a task compares a bounded number of rows at a time however large a bucket is.
        """
        sizes = rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("held"))
        blocks = F.ceil(F.col("held") / BLOCK_ROWS).cast("int")
        rows = rows.join(sizes, "bucket").withColumn("blocks", blocks)
        rows = rows.withColumn("block", F.pmod(F.xxhash64("v"), F.col("blocks")).cast("int"))
        rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("block", "other"), F.greatest("block", "other")
        rows = rows.select(
            F.xxhash64("bucket", low, high).alias("pack"),
            (low != high).alias("across"),
            "block",
            "band",
            "v",
            "root",
        )
        rows = rows.join(self.vertices.select("v", "n", "bands", "registers"), "v")
        packs = rows.repartition("pack").sortWithinPartitions("pack", "block", "v")
        return packs.mapInArrow(_pairs_inside, "a bigint, b bigint")

    def classes(self) -> DataFrame:
        """``v, component_id`` of every set."""
        roots = connected(self.links())
        lowest = self.sketches.where(F.col("n") > 0).groupBy("v").agg(F.min("doc_id").alias("doc_id"))
        rooted = lowest.join(roots, "v", "left").withColumn("root", F.coalesce("root", "v"))
        rooted = stored(rooted, "rooted")
        lowest = rooted.groupBy("root").agg(F.min("doc_id").alias("component_id"))
        return rooted.join(lowest, "root").select("v", "component_id")


def near_duplicates(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept``: one row per row of ``docs``."""
    search = _Search(docs, doc, text)
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id"))
    return (
        search.sketches.select("doc_id", "text_key", "v", "n")
        .join(search.classes(), "v", "left")
        .select("doc_id", "text_key", F.col("n").alias("n_shingles"), component.alias("component_id"))
        .withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))
    )


def keep_one(docs: DataFrame, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with one document of each group: the one with the smallest id. Columns unchanged.

    Rows that agree in id and text are copies of one document; one of them stays.
    """
    found = stored(near_duplicates(docs, doc, text), "near-duplicates")
    lost = stored(found.where(~F.col("kept")).select("doc_id", "text_key").distinct(), "lost")
    n_lost = lost.count()
    key = fresh(docs, "text_key")
    of_doc, of_key = f"{key}_doc", f"{key}_of"

    def same(table: DataFrame) -> DataFrame:
        return table.select(F.col("doc_id").alias(of_doc), F.col("text_key").alias(of_key))

    def on() -> Column:
        return column(doc).eqNullSafe(F.col(of_doc)) & (F.col(key) == F.col(of_key))

    keyed = docs.withColumn(key, F.xxhash64(text_bytes(text)))
    kept = keyed.join(small(same(lost), n_lost, 32), on(), "left_anti")
    repeated = found.where(F.col("kept") & (F.col("n_shingles") > 0)).groupBy("doc_id", "text_key").count()
    repeated = stored(repeated.where(F.col("count") > 1).drop("count"), "repeated")
    n_repeated = repeated.count()
    if n_repeated:
        again = small(same(repeated), n_repeated, 32)
        once = kept.join(again, on(), "left_semi").dropDuplicates([doc, key])
        kept = kept.join(again, on(), "left_anti").unionByName(once)
    return kept.select([column(c) for c in docs.columns])
