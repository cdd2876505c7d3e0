"""Candidate strategies: specs, generators, and the registries of both."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass
from typing import Any

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tickloom.identity import canonical_json, stable_hash

LINEAR = "linear_signal_v1"
SCHEMA = "cand_block int, cand_idx int, strategy_hash string, strategy_name string, weights array<double>, threshold double, strategy_json string"
#: Candidates go to every executor; more than this aren't meant to.
MOST = 100_000
#: Candidates that share a copy of the market on its way to their task.
BLOCK = 8


@dataclass(frozen=True)
class StrategySpec:
    name: str
    params: dict[str, Any]

    def spec_hash(self) -> str:
        return stable_hash(self)


def linear_random(n_candidates: int, n_features: int, rng: np.random.Generator) -> Iterable[StrategySpec]:
    """Random directions of length one and thresholds of half-normal size."""
    for _ in range(n_candidates):
        weights = rng.normal(size=n_features)
        weights = weights / (np.linalg.norm(weights) + 1e-12)
        yield StrategySpec(LINEAR, {"weights": weights.tolist(), "threshold": float(abs(rng.normal(scale=0.25)))})


GENERATORS: dict[str, Callable] = {"linear_random_v1": linear_random}


def generate(name: str, n_candidates: int, n_features: int, seed: int) -> list[StrategySpec]:
    if name not in GENERATORS:
        raise ValueError(f"no generator {name}")
    return list(GENERATORS[name](n_candidates, n_features, np.random.default_rng(seed)))


def unique(specs: Iterable[StrategySpec]) -> list[StrategySpec]:
    """The first spec of each hash, in order."""
    out: dict[str, StrategySpec] = {}
    for s in specs:
        out.setdefault(s.spec_hash(), s)
    return list(out.values())


def candidate_table(spark: SparkSession, specs: list[StrategySpec]) -> DataFrame:
    if len(specs) > MOST:
        raise ValueError(f"{len(specs)} candidates; at most {MOST} are broadcast")
    rows = [(i // BLOCK, i, s.spec_hash(), s.name, [float(w) for w in s.params.get("weights", [])], float(s.params.get("threshold", 0.0)), canonical_json(s)) for i, s in enumerate(specs)]
    return spark.createDataFrame(rows, SCHEMA)


def distinct_candidates(candidates: DataFrame) -> DataFrame:
    """The first row of each strategy_hash by cand_idx."""
    first = candidates.groupBy("strategy_hash").agg(F.min_by(F.struct(*candidates.columns), "cand_idx").alias("_c"))
    return first.select("_c.*")


def blocks(candidates: DataFrame) -> DataFrame:
    """cand_block and its candidates as an array."""
    own = F.struct("cand_idx", "strategy_hash", "strategy_name", "weights", "threshold")
    return candidates.groupBy("cand_block").agg(F.collect_list(own).alias("_candidates"))


def linear_signal(features: list[str]) -> Column:
    """1 above the threshold, -1 below its negative, else 0, of the weighted sum of the features. Another number of weights than features is an error."""
    score = sum((F.get("weights", F.lit(i)) * F.col(c) for i, c in enumerate(features)), F.lit(0.0))
    wrong = F.raise_error(F.format_string("%d weights for %d features", F.size("weights"), F.lit(len(features)))).cast("double")
    score = F.when(F.size("weights") == len(features), score).otherwise(wrong)
    return F.when(score > F.col("threshold"), 1.0).when(score < -F.col("threshold"), -1.0).otherwise(0.0)


#: Native strategies: from feature names to a position before lag and leverage.
STRATEGIES: dict[str, Callable[[list[str]], Column]] = {LINEAR: linear_signal}


def signal_for(name: str, features: list[str]) -> Column:
    if name not in STRATEGIES:
        raise ValueError(f"no strategy {name}")
    return STRATEGIES[name](features)


def fault(spec: StrategySpec, n_features: int) -> str | None:
    """Why a candidate can't be evaluated, if so."""
    if spec.name not in STRATEGIES and spec.name not in PANDAS:
        return f"no strategy {spec.name}"
    if spec.name == LINEAR and len(spec.params.get("weights", [])) != n_features:
        return f"{len(spec.params.get('weights', []))} weights for {n_features} features"
    return None


class Strategy:
    """A strategy in pandas, for what Columns can't express. fit sees the train frame, positions each slice's frame; both frames are in time order."""

    def fit(self, train):
        return self

    def positions(self, frame):
        raise NotImplementedError


#: Strategies in pandas: from a spec's params to a Strategy. A run evaluates them beside the native ones.
PANDAS: dict[str, Callable[[dict], Strategy]] = {}
OUTCOME = "cand_block int, cand_idx int, strategy_hash string, strategy_name string, fold int, split string, ts timestamp_ntz, raw double, error string, elapsed_ms long"


def pandas_outcomes(sliced: DataFrame, candidates: DataFrame, factories: dict[str, Callable[[dict], Strategy]], only: DataFrame | None = None) -> DataFrame:
    """OUTCOME: the positions of candidates in pandas on each slice, or for a (candidate, fold) that fails one row with its error.

    A candidate's fold goes to a task: fit on its train rows (for the holdout, whose fold is null, those before it), then
    positions on each other slice, in time order. What raises, or gives another number of positions than rows, fails
    that candidate and fold alone. elapsed_ms is that of the fold. only: (strategy_hash, fold) to evaluate.
    """
    names = ["cand_block", "cand_idx", "strategy_hash", "strategy_name", "strategy_json"]
    wide = sliced.crossJoin(F.broadcast(candidates.select(*names)))  # candidates are checked to be few
    if only is not None:
        wide = wide.join(F.broadcast(only.select("strategy_hash", "fold")), ["strategy_hash", "fold"], "left_semi")

    def run(key, frame):
        import json
        import time

        import pandas as pd

        began = time.perf_counter()
        frame = frame.sort_values("row_idx")
        first = frame.iloc[0]
        try:
            model = factories[first["strategy_name"]](json.loads(first["strategy_json"])["params"])
            fitted = model.fit(frame[frame["split"].isin(["train", "holdout_train"])])
            parts = []
            for _, part in frame[frame["split"] != "holdout_train"].groupby("split", sort=False):
                raw = np.asarray(fitted.positions(part), dtype=float)
                if raw.shape != (len(part),):
                    raise ValueError(f"{raw.shape} positions for {len(part)} rows")
                parts.append(part[["cand_block", "cand_idx", "strategy_hash", "strategy_name", "fold", "split", "ts"]].assign(raw=np.nan_to_num(raw), error=None))
            out = pd.concat(parts)
        except Exception as e:
            out = frame[["cand_block", "cand_idx", "strategy_hash", "strategy_name", "fold"]].head(1).assign(split=None, ts=pd.NaT, raw=np.nan, error=f"{type(e).__name__}: {e}"[:1000])
        return out.assign(elapsed_ms=int((time.perf_counter() - began) * 1000))

    return wide.groupBy("strategy_hash", "fold").applyInPandas(run, OUTCOME)


def pandas_positions(sliced: DataFrame, strategies: dict[str, Strategy]) -> DataFrame:
    """Rows of sliced (from slices.assign) for each strategy, with strategy_hash, strategy_name, cand_idx and raw.

    A fold's slices go to one task for each strategy: fit on its train rows (those of holdout_train for the holdout, whose
    fold is null), then positions on each other slice. Positions that are missing count as 0.
    """
    names = list(strategies)
    ids = F.array(*[F.struct(F.lit(i // BLOCK).alias("cand_block"), F.lit(i).alias("cand_idx"), F.lit(n).alias("strategy_name"), F.lit(stable_hash({"name": n, "params": {}})).alias("strategy_hash")) for i, n in enumerate(names)])
    wide = sliced.withColumn("_c", F.explode(ids)).select("_c.*", *sliced.columns)
    schema = T.StructType([*wide.schema.fields, T.StructField("raw", T.DoubleType())])

    def run(key, frame):
        import pandas as pd

        frame = frame.sort_values("row_idx")
        model = strategies[frame["strategy_name"].iloc[0]]
        fitted = model.fit(frame[frame["split"].isin(["train", "holdout_train"])])
        parts = []
        for _, part in frame[frame["split"] != "holdout_train"].groupby("split", sort=False):
            raw = pd.Series(np.asarray(fitted.positions(part), dtype=float), index=part.index).fillna(0.0)
            parts.append(part.assign(raw=raw))
        return pd.concat(parts) if parts else frame.assign(raw=0.0).head(0)

    return wide.groupBy("strategy_hash", "fold").applyInPandas(run, schema)
