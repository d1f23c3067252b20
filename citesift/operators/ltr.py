"""Training the ranker on labelled candidates: tune on a query split, select, refit on everything.

Three families that scale are tried, and the validation nDCG decides between them:

* ``listwise``: boosted trees on the gradients of nDCG within each query (``citesift.operators.listwise``);
* ``trees``: gradient-boosted regression trees on the labels;
* ``linear``: logistic regression on features centred within their query, where the relevant and
  the other candidates of a query weigh the same. Centring leaves only differences within a query,
  as pairs would, without forming any pair; the fitted margin orders raw features all the same.
"""

from __future__ import annotations

import math
import random
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass

from pyspark import inheritable_thread_target
from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from citesift.operators.features import FEATURES
from citesift.operators.listwise import fit_listwise
from citesift.operators.metrics import mean_ndcg
from citesift.operators.rerank import ModelRanker
from citesift.operators.splits import VALIDATION_SHARE, prefix_split
from citesift.session import pack_for_training

TRIALS = 12
FAMILIES = ("trees", "linear", "listwise")
METRIC_DEPTH = 5
ROW_BYTES = 128

# The search space of the boosted trees.
STEP_SIZE = (0.01, 0.3)
TREE_DEPTH = (2, 6)
MIN_ROWS_PER_LEAF = (0.5, 5.0)
ROUNDS = (50, 100, 200)
REGULARISATION = (1e-4, 1.0)


@dataclass(frozen=True)
class RankerConfig:
    """One trial. Tree settings are unused by the linear family and the other way round."""

    family: str
    step_size: float = 0.1
    depth: int = 3
    min_rows: float = 1.0
    rounds: int = 50
    reg: float = 0.01


def ranker_configs(
    trials: int, seed: int = 0, rounds: tuple[int, ...] = ROUNDS, families: tuple[str, ...] = ("trees", "linear")
) -> list[RankerConfig]:
    """Random draws, the families in turn."""
    rng = random.Random(seed)

    def log_uniform(low: float, high: float) -> float:
        return math.exp(rng.uniform(math.log(low), math.log(high)))

    return [
        RankerConfig(
            family=families[i % len(families)],
            step_size=log_uniform(*STEP_SIZE),
            depth=rng.randint(*TREE_DEPTH),
            min_rows=rng.uniform(*MIN_ROWS_PER_LEAF),
            rounds=rng.choice(rounds),
            reg=log_uniform(*REGULARISATION),
        )
        for i in range(trials)
    ]


def fit_ranker(examples: DataFrame, config: RankerConfig) -> PipelineModel:
    """``examples``: ``query_id``, the feature columns and ``label``."""
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    if config.family == "listwise":
        vectors = assembler.transform(examples).select("query_id", "features", "label")
        return PipelineModel(
            [assembler, fit_listwise(vectors, config.step_size, config.depth, config.min_rows, config.rounds)]
        )
    if config.family == "trees":
        trees = GBTRegressor(
            featuresCol="features",
            labelCol="label",
            stepSize=config.step_size,
            maxDepth=config.depth,
            minInstancesPerNode=max(1, round(config.min_rows)),
            maxIter=config.rounds,
            seed=0,
        )
        return PipelineModel([assembler, trees.fit(assembler.transform(examples))])
    per_query = Window.partitionBy("query_id")
    mine = F.count(F.lit(1)).over(Window.partitionBy("query_id", "label"))
    centred = examples.select(
        "label",
        (F.lit(0.5) / mine).alias("weight"),
        *[(F.col(f) - F.avg(f).over(per_query)).alias(f) for f in FEATURES],
    )
    logistic = LogisticRegression(
        featuresCol="features",
        labelCol="label",
        weightCol="weight",
        regParam=config.reg,
        family="binomial",
        maxIter=100,
    )
    return PipelineModel([assembler, logistic.fit(assembler.transform(centred))])


def validation_ndcg(model: PipelineModel, rows: DataFrame, k: int = METRIC_DEPTH) -> float:
    scored = ModelRanker(model).score(rows)
    return float(mean_ndcg(scored, k, "rerank_score").first()["mean_ndcg"])


def best_trial(trials: DataFrame, trial: str = "trial", metric: str = "metric") -> DataFrame:
    """``trial, metric`` of the best row (the first by name among equals); no usable row raises."""
    usable = trials.where(F.col(metric).isNotNull() & ~F.isnan(metric))
    best = F.min_by(F.struct(trial, metric), F.struct(-F.col(metric), F.col(trial)))
    checked = F.when(F.count(F.lit(1)) == 0, F.raise_error(F.lit("no trial succeeded")))
    return usable.agg(checked.otherwise(best).alias("b")).select(
        F.col(f"b.{trial}").alias(trial), F.col(f"b.{metric}").alias(metric)
    )


@dataclass
class RankerTraining:
    model: PipelineModel
    config: RankerConfig
    val_ndcg: float


def train_ranker(
    examples: DataFrame,
    trials: int = TRIALS,
    val_share: float = VALIDATION_SHARE,
    k: int = METRIC_DEPTH,
    parallelism: int = 4,
    configs: list[RankerConfig] | None = None,
) -> RankerTraining:
    """``examples``: ``query_id, seq, rank``, features and ``label`` of every labelled candidate.

    The first queries by ``seq`` validate. The fits of the trials run as concurrent Spark jobs.
    """
    configs = configs or ranker_configs(trials, families=FAMILIES)
    rows = examples.select("query_id", "seq", "rank", *FEATURES, "label").persist()
    try:
        queries = rows.select("query_id", "seq").distinct()
        if queries.count() < 2:
            raise ValueError("training needs at least 2 labelled queries with candidates")
        marked = rows.join(prefix_split(queries, val_share).drop("seq", "position"), "query_id")
        n_rows = rows.count()
        split = pack_for_training(marked, n_rows, ROW_BYTES).persist()
        train, validation = split.where(~F.col("is_validation")), split.where("is_validation")

        def run(config: RankerConfig) -> float:
            return validation_ndcg(fit_ranker(train, config), validation, k)

        in_session = inheritable_thread_target(examples.sparkSession)
        with ThreadPoolExecutor(parallelism) as pool:
            futures = [pool.submit(in_session(run), c) for c in configs]
            scores = [f.result() for f in futures]
        usable = [(s, -i) for i, s in enumerate(scores) if not math.isnan(s)]
        if not usable:
            raise RuntimeError("no ranker trial succeeded")
        score, best = max(usable)
        split.unpersist()
        packed = pack_for_training(rows, n_rows, ROW_BYTES)
        return RankerTraining(fit_ranker(packed, configs[-best]), configs[-best], score)
    finally:
        rows.unpersist()
