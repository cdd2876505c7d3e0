"""Time-series splits as half-open row ranges: slices(fold, split, lo, hi)."""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom.config import CvConfig, SplitConfig

SCHEMA = "fold int, split string, lo long, hi long"


class Slice(NamedTuple):
    fold: int | None
    split: str  # train, valid, test, or holdout_train (for fitting only)
    lo: int
    hi: int

    @property
    def rows(self) -> int:
        return self.hi - self.lo


class Plan(NamedTuple):
    method: str
    slices: list[Slice]
    n_rows: int
    holdout_train: list[Slice]

    def of(self, split: str) -> list[Slice]:
        return [s for s in self.slices if s.split == split]

    @property
    def n_folds(self) -> int:
        return len(self.of("valid"))

    @property
    def has_holdout(self) -> bool:
        return bool(self.of("test"))


def chronological(n: int, cfg: SplitConfig) -> dict[str, tuple[int, int]]:
    """Train, valid and test by fractions, with embargo rows cut off on both sides of each border."""
    one, two, gap = int(n * cfg.train_frac), int(n * (cfg.train_frac + cfg.valid_frac)), cfg.embargo_rows
    valid_lo = min(n, one + gap)
    out = {"train": (0, max(0, one - gap)), "valid": (valid_lo, max(min(n, two - gap), valid_lo)), "test": (min(n, two + gap), n)}
    for name, (lo, hi) in out.items():
        if hi - lo < cfg.min_rows:
            raise ValueError(f"{name} has {hi - lo} rows, fewer than {cfg.min_rows}")
    return out


def single_plan(n: int, cfg: SplitConfig) -> Plan:
    parts = chronological(n, cfg)
    fold = [Slice(0, s, *parts[s]) for s in ("train", "valid")]
    return Plan("single", [*fold, Slice(None, "test", *parts["test"])], n, [Slice(None, "holdout_train", s.lo, s.hi) for s in fold])


def feasible_folds(limit: int, cfg: CvConfig) -> int:
    """How many valid windows fit before row limit."""
    room = limit - (cfg.min_train_rows + cfg.purge_rows) - cfg.valid_window_rows
    return 0 if room < 0 else room // cfg.step_rows + 1


def walk_forward_plan(n: int, cfg: CvConfig) -> Plan:
    start, holdout = n, []
    train_start = lambda end: max(0, end - cfg.train_window_rows) if cfg.train_window_rows else 0
    slices: list[Slice] = []
    if cfg.holdout_test_rows > 0:
        start = n - cfg.holdout_test_rows
        if start <= 0:
            raise ValueError(f"a holdout of {cfg.holdout_test_rows} rows leaves none of {n}")
    limit = max(0, start - cfg.purge_rows)  # the gap before the holdout belongs to no fold
    if cfg.holdout_test_rows > 0:
        holdout = [Slice(None, "holdout_train", train_start(limit), limit)]
    first = cfg.min_train_rows + cfg.purge_rows
    if first >= limit:
        raise ValueError(f"the first valid row would be {first}, with {limit} rows before the gap and the holdout")
    most = feasible_folds(limit, cfg)
    if cfg.n_folds > most:
        raise ValueError(f"{cfg.n_folds} folds are asked for, {most} fit")
    for i in range(cfg.n_folds):
        at = first + i * cfg.step_rows
        train, valid = Slice(i, "train", train_start(at - cfg.purge_rows), at - cfg.purge_rows), Slice(i, "valid", at, at + cfg.valid_window_rows)
        for s, least in ((train, cfg.min_train_rows), (valid, cfg.min_valid_rows)):
            if s.rows < least:
                raise ValueError(f"fold {i}: {s.split} has {s.rows} rows, fewer than {least}")
        slices += [train, valid]
    if holdout:
        slices.append(Slice(None, "test", start, n))
    return Plan("walk_forward", slices, n, holdout)


def build_plan(n: int, splits: SplitConfig, cv: CvConfig) -> Plan:
    return single_plan(n, splits) if cv.method == "single" else walk_forward_plan(n, cv)


def slice_table(spark: SparkSession, slices: list[Slice]) -> DataFrame:
    return spark.createDataFrame(slices, SCHEMA)


def assign(bars: DataFrame, slices: list[Slice]) -> DataFrame:
    """A row for each bar and slice that holds it, with slice_lo, the slice's first row. The slices are literals, so there is no join."""
    ranges = F.array(*[F.struct(F.lit(s.fold).cast("int").alias("fold"), F.lit(s.split).alias("split"), F.lit(s.lo).cast("long").alias("lo"), F.lit(s.hi).cast("long").alias("hi")) for s in slices])
    inside = F.filter(ranges, lambda s: (F.col("row_idx") >= s["lo"]) & (F.col("row_idx") < s["hi"]))
    return bars.withColumn("_s", F.explode(inside)).select("_s.fold", "_s.split", F.col("_s.lo").alias("slice_lo"), *bars.columns)


def plan_meta(bars: DataFrame, plan: Plan) -> DataFrame:
    """fold, split, lo, hi, rows, and first and last time of each slice."""
    ranges = slice_table(bars.sparkSession, [*plan.slices, *plan.holdout_train])
    at = bars.select("row_idx", F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("at"))
    first = ranges.join(at.withColumnsRenamed({"row_idx": "lo", "at": "first_ts"}), "lo", "left")
    return first.withColumn("_last", F.col("hi") - 1).join(at.withColumnsRenamed({"row_idx": "_last", "at": "last_ts"}), "_last", "left").select("fold", "split", "lo", "hi", (F.col("hi") - F.col("lo")).alias("rows"), "first_ts", "last_ts")
