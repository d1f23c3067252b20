"""Many logistic regressions at once: one step of all fits is one pass over the rows.

MLlib reads (and caches) its training rows once more for every fit. Here the fits share the rows: each
sends the point it wants to know, and one Spark job sums loss and gradient of all points. The problem
and the steps are those of MLlib's ``LogisticRegression`` (weighted rows, L2 penalty on the given
features, L-BFGS on centred features of deviation 1), so a fit ends at MLlib's weights but for rounding.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Generator, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.ml.functions import array_to_vector
from pyspark.ml.stat import Summarizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# As in MLlib's optimiser.
MEMORY = 10
RECENT_VALUES = 20
SEARCH_STEPS = 10
DECREASE, CURVATURE = 1e-4, 0.9
# Larger blocks take longer to hand over, smaller ones to multiply.
BLOCK_ROWS = 512


class SearchFailed(Exception):
    """No step along the direction is good enough."""


@dataclass(frozen=True)
class Fit:
    """One regression: the fold it does not see, its penalty and the column that weighs its rows."""

    held_out: int
    penalty: float
    weight: str


@dataclass(frozen=True)
class TrainingPart:
    """What a fit knows of its rows before it starts."""

    mean: np.ndarray
    deviation: np.ndarray
    class_weights: np.ndarray


# A search yields a point and is sent the value and the gradient there.
Search = Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]


def minimize(x: np.ndarray, max_steps: int, tolerance: float) -> Search:
    """L-BFGS. It stops by the length of the gradient or by the fall of the last values."""
    value, gradient = yield x
    first, recent, history = value, deque([math.inf], maxlen=RECENT_VALUES), deque(maxlen=MEMORY)
    steps, failed = 0, False
    while True:
        falls = len(recent) < 2 or not abs(value - max(recent)) <= tolerance * first
        flat = np.linalg.norm(gradient) <= max(tolerance * value, 1e-8)
        if steps >= max_steps or flat or not falls:
            return x
        try:
            direction = descent(history, gradient)
            length = 1.0 if steps else 1.0 / np.linalg.norm(direction)
            length, new_value, new_gradient = yield from line_search(x, value, gradient, direction, length)
            if length * np.linalg.norm(gradient) < 1e-10:
                raise SearchFailed
        except SearchFailed:
            if failed:
                return x
            failed = True
            history.clear()
            continue
        failed = False
        new_x = x + length * direction
        history.appendleft((new_x - x, new_gradient - gradient))
        x, value, gradient = new_x, new_value, new_gradient
        recent.append(value)
        steps += 1


def descent(history: Sequence[tuple[np.ndarray, np.ndarray]], gradient: np.ndarray) -> np.ndarray:
    """Minus the gradient, bent by the steps in ``history`` (newest first)."""
    direction, passed = gradient.copy(), []
    with np.errstate(all="ignore"):
        for step, change in history:
            curvature = step @ change
            share = step @ direction / curvature
            if np.isnan(share):
                raise SearchFailed
            direction -= share * change
            passed.append((step, change, curvature, share))
        if history:
            step, change = history[0]
            if not step @ change >= 0:
                raise SearchFailed
            direction *= step @ change / (change @ change)
        for step, change, curvature, share in reversed(passed):
            direction += (share - change @ direction / curvature) * step
    return -direction


@dataclass(frozen=True)
class Probe:
    """A place on the line: its distance, value, slope, and gradient."""

    t: float
    value: float
    slope: float
    gradient: np.ndarray


def line_search(x, value: float, gradient: np.ndarray, direction: np.ndarray, t: float):
    """``distance, value, gradient`` of a place that meets the strong Wolfe conditions."""
    start = Probe(0.0, value, gradient @ direction, gradient)
    if start.slope > 0:
        raise SearchFailed

    def probe(t: float):
        found, slope = yield x + t * direction
        return Probe(t, found, slope @ direction, slope)

    def too_high(at: Probe) -> bool:
        return at.value > start.value + DECREASE * at.t * start.slope

    def flat_enough(at: Probe) -> bool:
        return abs(at.slope) <= CURVATURE * abs(start.slope)

    def zoom(low: Probe, high: Probe):
        for _ in range(SEARCH_STEPS):
            at = yield from probe(between(high, low) if low.t > high.t else between(low, high))
            if too_high(at) or at.value >= low.value:
                high = at
                continue
            if flat_enough(at):
                return at.t, at.value, at.gradient
            if at.slope * (high.t - low.t) >= 0:
                high = low
            low = at
        raise SearchFailed

    low = start
    for i in range(SEARCH_STEPS):
        at = yield from probe(t)
        if not math.isfinite(at.value):
            t /= 2.0
            continue
        if too_high(at) or (at.value >= low.value and i > 0):
            return (yield from zoom(low, at))
        if flat_enough(at):
            return at.t, at.value, at.gradient
        if at.slope >= 0:
            return (yield from zoom(at, low))
        low = at
        t *= 1.5
    raise SearchFailed


def between(left: Probe, right: Probe) -> float:
    """Where the cubic through both places is least, kept off the ends."""
    with np.errstate(all="ignore"):
        width = np.float64(right.t - left.t)
        d1 = left.slope + right.slope + 3.0 * (left.value - right.value) / width
        d2 = np.sqrt(d1 * d1 - left.slope * right.slope)
        t = right.t - width * (right.slope + d2 - d1) / (right.slope - left.slope + 2.0 * d2)
    if t < left.t + 0.1 * width:
        return left.t + 0.1 * width
    return min(t, left.t + 0.9 * width) if t == t else t


def training_parts(rows: DataFrame, fits: Sequence[Fit], n_classes: int) -> dict[tuple[int, str], TrainingPart]:
    """Means, deviations and class weights of the rows of every fit, by its fold and weight column."""
    kinds = sorted({(f.held_out, f.weight) for f in fits})
    sums = rows.groupBy("fold", "label").agg(*[F.sum(w).alias(w) for w in {w for _, w in kinds}]).collect()
    class_weights = {kind: np.zeros(n_classes) for kind in kinds}
    for fold, weight in kinds:
        for r in sums:
            if r["fold"] != fold:
                class_weights[fold, weight][int(r["label"])] += r[weight]
        if not class_weights[fold, weight].any():
            raise ValueError(f"The training data at fold {fold} is empty.")
    metrics = Summarizer.metrics("mean", "std")
    # Rows without weight are left out.
    summaries = [
        metrics.summary(F.col("_vector"), F.when(F.col("fold") != fold, F.col(weight)).otherwise(0.0))
        for fold, weight in kinds
    ]
    found = rows.withColumn("_vector", array_to_vector("embedding")).agg(*summaries).first()
    parts = {}
    for kind, summary in zip(kinds, found, strict=True):
        mean, deviation = summary["mean"].toArray(), summary["std"].toArray()
        if not np.isfinite(mean).all():
            raise ValueError("embeddings must not hold NaN or infinity")
        parts[kind] = TrainingPart(mean, deviation, class_weights[kind])
    return parts


class Problem:
    """One fit's view of the sums: weights of centred, scaled features, and back to given ones.

    Two classes share one set of weights, that of the second class.
    """

    def __init__(self, fit: Fit, part: TrainingPart):
        self.fit, self.part = fit, part
        self.n_classes = len(part.class_weights)
        self.sets = self.n_classes if self.n_classes > 2 else 1
        varies = part.deviation != 0
        self.scale = np.divide(1.0, part.deviation, out=np.zeros(len(varies)), where=varies)
        self.centre = self.scale * part.mean
        self.total = part.class_weights.sum()

    def start(self) -> np.ndarray:
        """No weights, and intercepts that give every class its share."""
        x = np.zeros((self.sets, len(self.scale) + 1))
        counts = self.part.class_weights
        if self.sets > 1:
            seen = np.log1p(counts[: np.flatnonzero(counts)[-1] + 1])
            x[: len(seen), -1] = seen - seen.mean()
        else:
            x[0, -1] = math.log(counts[1] / counts[0])
        return x.ravel()

    def weights(self, x: np.ndarray) -> np.ndarray:
        """Classes x (features as given + 1)."""
        x = x.reshape(self.sets, -1)
        out = np.zeros((self.n_classes, x.shape[1]))
        out[-self.sets :, :-1] = x[:, :-1] * self.scale
        out[-self.sets :, -1] = x[:, -1] - x[:, :-1] @ self.centre
        return out

    def objective(self, x: np.ndarray, sums: np.ndarray) -> tuple[float, np.ndarray]:
        """Penalised mean loss and its gradient, from the sums over given features."""
        x = x.reshape(self.sets, -1)
        loss, slopes = sums[0], sums[1:].reshape(self.n_classes, -1)[-self.sets :] / self.total
        gradient = np.empty_like(x)
        gradient[:, -1] = slopes[:, -1]
        gradient[:, :-1] = slopes[:, :-1] * self.scale - np.outer(slopes[:, -1], self.centre)
        pull = self.fit.penalty * x[:, :-1] * self.scale**2
        gradient[:, :-1] += pull
        return loss / self.total + 0.5 * (pull * x[:, :-1]).sum(), gradient.ravel()

    def constant(self) -> np.ndarray | None:
        """Weights that always give the only class, if there is only one."""
        seen = np.flatnonzero(self.part.class_weights)
        if len(seen) > 1:
            return None
        out = np.zeros((self.n_classes, len(self.scale) + 1))
        out[seen[0], -1] = np.inf
        return out


def pack(rows: DataFrame, weights: Sequence[str]) -> DataFrame:
    """``fold, n, vectors, labels`` and the weight columns: rows of one fold, as the bytes of their numbers.

    Python takes a block over as it is; lists of numbers would be converted one by one at every step.
    """
    names = ["vectors", "labels", *weights]

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("embedding")
            if column.null_count:
                raise ValueError("embeddings must not be null")
            vectors = column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)
            numbers = [vectors, batch.column("label").to_numpy().astype(np.int64)]
            numbers += [batch.column(w).to_numpy() for w in weights]
            folds = batch.column("fold").to_numpy()
            for fold in np.unique(folds):
                at = np.flatnonzero(folds == fold)
                for some in np.array_split(at, -(-len(at) // BLOCK_ROWS)):
                    arrays = [pa.array([fold], pa.int32()), pa.array([len(some)], pa.int32())]
                    arrays += [pa.array([x[some].tobytes()], pa.binary()) for x in numbers]
                    yield pa.RecordBatch.from_arrays(arrays, names=["fold", "n", *names])

    schema = ", ".join(["fold int", "n int", *[f"{name} binary" for name in names]])
    return rows.mapInArrow(blocks, schema)


def unpack(batches: Iterator[pa.RecordBatch], vector_type: str, weights: Sequence[str] = ()):
    """``fold, vectors, labels, {weight column: its numbers}`` of every block."""
    for batch in batches:
        for i, fold in enumerate(batch.column("fold").to_pylist()):
            n = batch.column("n")[i].as_py()

            def numbers(name: str, kind: str, i: int = i) -> np.ndarray:
                return np.frombuffer(batch.column(name)[i].as_buffer(), kind)

            vectors = numbers("vectors", vector_type).reshape(n, -1).astype(np.float64)
            yield fold, vectors, numbers("labels", "i8"), {w: numbers(w, "f8") for w in weights}


def margins(weights: np.ndarray, vectors: np.ndarray) -> np.ndarray:
    """Classes x fits x rows, from weights of classes x fits x (features + 1)."""
    n_classes, n_fits, _ = weights.shape
    flat = weights[:, :, :-1].reshape(n_classes * n_fits, -1) @ vectors.T
    return flat.reshape(n_classes, n_fits, -1) + weights[:, :, -1:]


def loss_sums(
    blocks: DataFrame, vector_type: str, fits: dict[int, Fit], weights: dict[int, np.ndarray]
) -> dict[int, np.ndarray]:
    """Per fit: the weighted loss of its rows, then the gradient by class and feature (intercept last)."""
    weighed = sorted({f.weight for f in fits.values()})

    def seen_by(fold: int) -> tuple[list[int], np.ndarray | None]:
        using = [i for i, f in fits.items() if f.held_out != fold]
        return using, np.stack([weights[i] for i in using], axis=1) if using else None

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, stacked = {}, {}
        for fold, vectors, labels, by_column in unpack(batches, vector_type, weighed):
            if fold not in stacked:
                stacked[fold] = seen_by(fold)
            using, points = stacked[fold]
            if not using:
                continue
            row_weights = np.stack([by_column[fits[i].weight] for i in using])
            n_fits, n = row_weights.shape
            z = margins(points, vectors)
            z -= z.max(axis=0)
            at = (labels, slice(None), np.arange(n))
            own = z[at].T
            np.exp(z, out=z)
            total = z.sum(axis=0)
            loss = (row_weights * (np.log(total) - own)).sum(axis=1)
            z *= row_weights / total
            z[at] -= row_weights.T
            slopes = (z.reshape(-1, n) @ vectors).reshape(len(z), n_fits, -1)
            slopes = np.concatenate([slopes, z.sum(axis=2, keepdims=True)], axis=2)
            for k, i in enumerate(using):
                new = np.concatenate([loss[k : k + 1], slopes[:, k].ravel()])
                sums[i] = sums[i] + new if i in sums else new
        part = TaskContext.get().partitionId()
        if sums:
            columns = [list(sums), [part] * len(sums), [s.tobytes() for s in sums.values()]]
            types = (pa.int32(), pa.int32(), pa.binary())
            arrays = [pa.array(c, t) for c, t in zip(columns, types, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=["fit", "part", "sums"])

    def add(table: pa.Table) -> pa.Table:
        # In the order of the parts, so that two runs add alike.
        table = table.sort_by("part")
        total = sum(np.frombuffer(s) for s in table.column("sums").to_pylist())
        columns = {"fit": pa.array([table.column("fit")[0].as_py()], pa.int32()), "sums": [total.tobytes()]}
        return pa.table(columns)

    parts = blocks.mapInArrow(partial, "fit int, part int, sums binary")
    whole = parts.groupBy("fit").applyInArrow(add, "fit int, sums binary")
    return {r["fit"]: np.frombuffer(r["sums"]) for r in whole.collect()}


def fit_jointly(
    rows: DataFrame, fits: Sequence[Fit], n_classes: int, max_steps: int, tolerance: float
) -> tuple[list[np.ndarray], DataFrame]:
    """Weights of every fit, classes x (features + 1), the intercept last; and, for every fit, counts
    ``fit, label, prediction, n`` of the rows it did not see.

    ``rows``: ``embedding, label, fold`` and the weight columns. The driver holds the weights and the last
    steps of the fits and one row per fit, label and prediction, never rows of the table.
    """
    parts = training_parts(rows, fits, n_classes)
    problems = [Problem(f, parts[f.held_out, f.weight]) for f in fits]
    vector_type = "f4" if rows.schema["embedding"].dataType.elementType.simpleString() == "float" else "f8"
    blocks = pack(rows, sorted({f.weight for f in fits})).persist()
    try:
        weights = search_all(blocks, vector_type, problems, max_steps, tolerance)
        counts = held_out_confusion(blocks, vector_type, fits, weights)
        return weights, rows.sparkSession.createDataFrame(counts.collect(), counts.schema)
    finally:
        blocks.unpersist()


def search_all(
    blocks: DataFrame, vector_type: str, problems: list[Problem], max_steps: int, tolerance: float
) -> list[np.ndarray]:
    """Run the searches side by side until the last one has ended."""
    found = {i: p.constant() for i, p in enumerate(problems) if p.constant() is not None}
    searches = {i: minimize(p.start(), max_steps, tolerance) for i, p in enumerate(problems) if i not in found}
    points = {i: next(s) for i, s in searches.items()}
    while points:
        weights = {i: problems[i].weights(x) for i, x in points.items()}
        sums = loss_sums(blocks, vector_type, {i: problems[i].fit for i in points}, weights)
        for i, x in list(points.items()):
            try:
                points[i] = searches[i].send(problems[i].objective(x, sums[i]))
            except StopIteration as end:
                found[i] = problems[i].weights(end.value)
                del points[i]
    return [found[i] for i in range(len(problems))]


def held_out_confusion(
    blocks: DataFrame, vector_type: str, fits: Sequence[Fit], weights: Sequence[np.ndarray]
) -> DataFrame:
    """``fit, label, prediction, n``: every fit's classes of the rows it did not see."""
    use, stacked = {}, {}
    for fold in {f.held_out for f in fits}:
        use[fold] = [i for i, f in enumerate(fits) if f.held_out == fold]
        stacked[fold] = np.stack([weights[i] for i in use[fold]], axis=1)
    n_classes = len(weights[0])

    def counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((len(fits), n_classes, n_classes), np.int64)
        for fold, vectors, labels, _ in unpack(batches, vector_type):
            if fold not in use:
                continue
            predicted = margins(stacked[fold], vectors).argmax(axis=0)
            for i, classes in zip(use[fold], predicted, strict=True):
                np.add.at(total[i], (labels, classes), 1)
        at = np.nonzero(total)
        types = (pa.int32(), pa.float64(), pa.float64(), pa.int64())
        arrays = [pa.array(c).cast(t) for c, t in zip((*at, total[at]), types, strict=True)]
        yield pa.RecordBatch.from_arrays(arrays, names=["fit", "label", "prediction", "n"])

    schema = "fit int, label double, prediction double, n bigint"
    return blocks.mapInArrow(counts, schema).groupBy("fit", "label", "prediction").agg(F.sum("n").alias("n"))
