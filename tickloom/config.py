"""Experiment configuration: frozen sections, lenient reading of JSON, strict checks."""

from __future__ import annotations

import json
import types
from dataclasses import dataclass, field, fields
from typing import Any, get_args, get_type_hints

# The sections, their fields and defaults are the format of stored configurations.


@dataclass(frozen=True)
class DataConfig:
    type: str = "synthetic"
    n_rows: int = 400
    n_features: int = 6
    freq: str = "D"
    start: str = "2018-01-01"
    dataset_id: str | None = None
    dataset_version: str | None = None
    path: str | None = None
    timestamp_col: str | None = None
    price_col: str | None = None
    feature_cols: list[str] | None = None
    tz: str | None = None
    row_limit: int | None = None
    dropna: bool | None = None
    dedup: bool | None = None
    sep: str | None = None


@dataclass(frozen=True)
class SplitConfig:
    train_frac: float = 0.6
    valid_frac: float = 0.2
    embargo_rows: int = 0
    min_rows: int = 50


@dataclass(frozen=True)
class CvConfig:
    method: str = "single"
    n_folds: int = 3
    valid_window_rows: int = 50
    step_rows: int = 50
    min_train_rows: int = 120
    train_window_rows: int = 0
    purge_rows: int = 2
    holdout_test_rows: int = 80
    min_valid_rows: int = 30


@dataclass(frozen=True)
class ResearchConfig:
    n_candidates: int = 20
    generator: str = "linear_random_v1"
    top_k: int = 5
    selection_split: str = "valid"
    selection_metric: str = "sharpe_net"
    cv_agg: str = "median"
    cv_penalty_std: float = 0.5


@dataclass(frozen=True)
class BacktestConfig:
    execution_lag: int = 1
    leverage: float = 1.0


@dataclass(frozen=True)
class CostConfig:
    tc_bps: float = 2.0
    slippage_bps: float = 1.0
    borrow_bps_annual: float = 0.0


@dataclass(frozen=True)
class PersistenceConfig:
    db_path: str = "tickloom_store"


@dataclass(frozen=True)
class ExecutionConfig:
    n_jobs: int = 0
    prefer_processes: bool = True


@dataclass(frozen=True)
class EngineConfig:
    run_name: str = "experiment"
    mode: str = "light"
    seed: int = 42
    data: DataConfig = field(default_factory=DataConfig)
    splits: SplitConfig = field(default_factory=SplitConfig)
    cv: CvConfig = field(default_factory=CvConfig)
    research: ResearchConfig = field(default_factory=ResearchConfig)
    backtest: BacktestConfig = field(default_factory=BacktestConfig)
    costs: CostConfig = field(default_factory=CostConfig)
    persistence: PersistenceConfig = field(default_factory=PersistenceConfig)
    execution: ExecutionConfig = field(default_factory=ExecutionConfig)

    def config_hash(self) -> str:
        from tickloom.identity import pruned, stable_hash

        return stable_hash(pruned(self))


#: Words that stand for truth and falsehood.
TRUE, FALSE = ("1", "true", "yes", "y", "on"), ("0", "false", "no", "n", "off")


def to_bool(value: Any) -> bool | None:
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, int | float):
        return bool(int(value))
    word = str(value).strip().lower()
    return True if word in TRUE else False if word in FALSE else None


def to_str(value: Any) -> str | None:
    text = "" if value is None else str(value).strip()
    return text or None


def to_list(value: Any) -> list[str] | None:
    items = value.split(",") if isinstance(value, str) else value if isinstance(value, list) else []
    return [s for s in map(to_str, items) if s] or None


def to_number(kind: type):
    def convert(value: Any):
        try:
            return kind(value)
        except (TypeError, ValueError, OverflowError):
            return None

    return convert


def coerced(hint: Any, value: Any, default: Any) -> Any:
    """value as the hint asks; null and what can't be read give the default."""
    if value is None:
        return default
    optional = isinstance(hint, types.UnionType)
    kind = next(k for k in get_args(hint) if k is not type(None)) if optional else hint
    if kind is str:
        return to_str(value) if optional else str(value)
    convert = {int: to_number(int), float: to_number(float), bool: to_bool}.get(kind, to_list)
    out = convert(value)
    return default if out is None else out


def section(cls: type, raw: Any):
    """A section from a mapping; unknown keys don't count."""
    raw = raw if isinstance(raw, dict) else {}
    hints = get_type_hints(cls)
    values = {}
    for f in fields(cls):
        kind = hints[f.name]
        if hasattr(kind, "__dataclass_fields__"):
            values[f.name] = section(kind, raw.get(f.name))
        else:
            values[f.name] = coerced(kind, raw.get(f.name), f.default)
    return cls(**values)


def checked(cfg: EngineConfig) -> EngineConfig:
    s, cv, r = cfg.splits, cfg.cv, cfg.research
    rules = [
        (0 < s.train_frac < 1, "splits.train_frac must lie between 0 and 1"),
        (0 <= s.valid_frac < 1, "splits.valid_frac must be 0 or more and less than 1"),
        (s.train_frac + s.valid_frac < 1, "splits.train_frac and splits.valid_frac must leave rows for a test"),
        (cfg.backtest.execution_lag >= 0, "backtest.execution_lag must not be negative"),
        (r.n_candidates > 0, "research.n_candidates must be positive"),
        (r.top_k > 0, "research.top_k must be positive"),
        (cfg.data.n_features > 0, "data.n_features must be positive"),
        (cfg.data.type != "synthetic" or cfg.data.n_rows > 10, "data.n_rows must exceed 10 for synthetic data"),
        (cfg.data.type != "csv" or cfg.data.path, "data.path is needed for csv data"),
        (cv.method in ("single", "walk_forward"), "cv.method must be single or walk_forward"),
        (cv.n_folds >= 1, "cv.n_folds must be 1 or more"),
        (cv.valid_window_rows >= 1, "cv.valid_window_rows must be 1 or more"),
        (cv.step_rows >= 1, "cv.step_rows must be 1 or more"),
        (cv.min_train_rows >= 10, "cv.min_train_rows must be 10 or more"),
        (cv.purge_rows >= 0, "cv.purge_rows must not be negative"),
        (cv.train_window_rows >= 0, "cv.train_window_rows must not be negative"),
        (r.cv_agg in ("median", "mean", "min"), "research.cv_agg must be median, mean or min"),
        (r.cv_penalty_std >= 0, "research.cv_penalty_std must not be negative"),
    ]
    for holds, message in rules:
        if not holds:
            raise ValueError(message)
    return cfg


def from_dict(raw: dict) -> EngineConfig:
    return checked(section(EngineConfig, raw))


def load_config(path: str) -> EngineConfig:
    with open(path, encoding="utf-8") as f:
        return from_dict(json.load(f))
