"""Selection: fold metrics to cross-validated scores, diagnostics of overfitting, and a ranking."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.config import ResearchConfig
from tickloom.functions.stats import deflated_from_metrics, finite

ID = ["cand_idx", "strategy_hash", "strategy_name"]
AGGREGATES = {"median": F.median, "mean": F.avg, "min": F.min}
#: Columns of scores, in order, and what their metric names end in (None: the name as it is).
SCORES = ("cv_score", "cv_complete", "cv_n_folds_ok", "cv_n_folds_total")


def selected(metric: str, trials: int) -> Column:
    """The selection metric of a row of fold metrics; dsr_net is computed here, with the number of candidates tried."""
    return finite(deflated_from_metrics(trials) if metric == "dsr_net" else F.col(metric))


def fold_pairs(metrics: DataFrame, metric: str, trials: int) -> DataFrame:
    """ID, fold, train and valid: the selection metric on both sides of a fold."""
    rows = metrics.where(F.col("split").isin("train", "valid")).select(*ID, "fold", "split", selected(metric, trials).alias("m"))
    return rows.groupBy(*ID, "fold").agg(F.max(F.when(F.col("split") == "train", F.col("m"))).alias("train"), F.max(F.when(F.col("split") == "valid", F.col("m"))).alias("valid"))


def spread(c: Column) -> Column:
    return F.when(F.count(c) > 1, F.stddev_samp(c)).when(F.count(c) == 1, 0.0)


def cv_scores(pairs: DataFrame, n_folds: int, agg: str, penalty: float) -> DataFrame:
    """A row for each candidate: score and diagnostics. Without a value in each of n_folds folds there is no score, nor diagnostics.

    Columns: cv_score, cv_complete, cv_n_folds_ok, cv_n_folds_total, valid_agg, valid_std, valid_min, train_agg,
    train_std, train_min, train_valid_gap, train_gt_valid_frac, train_valid_corr, train_valid_n_pairs.
    """
    both = F.col("train").isNotNull() & F.col("valid").isNotNull()
    t, v = F.when(both, F.col("train")), F.when(both, F.col("valid"))
    of = AGGREGATES[agg]
    raw = pairs.groupBy(*ID).agg(
        F.count("valid").alias("ok"),
        of("valid").alias("valid_agg"),
        spread(F.col("valid")).alias("valid_std"),
        F.min("valid").alias("valid_min"),
        of("train").alias("train_agg"),
        spread(F.col("train")).alias("train_std"),
        F.min("train").alias("train_min"),
        F.avg((t > v).cast("double")).alias("train_gt_valid_frac"),
        F.when(F.count(t) >= 2, F.try_divide(F.covar_samp(t, v), F.stddev_samp(t) * F.stddev_samp(v))).alias("train_valid_corr"),
        F.count(t).cast("double").alias("train_valid_n_pairs"),
    )
    complete = (F.col("ok") == n_folds) & (F.col("ok") > 0)
    names = ["valid_agg", "valid_std", "valid_min", "train_agg", "train_std", "train_min", "train_gt_valid_frac", "train_valid_corr"]
    raw = raw.withColumns({c: F.when(complete, F.col(c)) for c in names} | {"train_valid_n_pairs": F.when(complete, F.col("train_valid_n_pairs")).otherwise(0.0)})
    out = raw.withColumns({
        "train_valid_gap": F.col("train_agg") - F.col("valid_agg"),
        "cv_score": F.col("valid_agg") - penalty * F.col("valid_std"),
        "cv_complete": complete.cast("double"),
        "cv_n_folds_ok": F.col("ok").cast("double"),
        "cv_n_folds_total": F.lit(float(n_folds)),
    })
    return out.select(*ID, *SCORES, "valid_agg", "valid_std", "valid_min", "train_agg", "train_std", "train_min", "train_valid_gap", "train_gt_valid_frac", "train_valid_corr", "train_valid_n_pairs")


def metric_names(metric: str, agg: str) -> dict[str, str]:
    """From columns of cv_scores to the names under which they are stored."""
    renamed = {"valid_agg": f"valid_{agg}", "train_agg": f"train_{agg}", "train_valid_gap": f"train_valid_gap_{agg}"}
    rest = ("valid_agg", "valid_std", "valid_min", "train_agg", "train_std", "train_min", "train_valid_gap", "train_gt_valid_frac", "train_valid_corr", "train_valid_n_pairs")
    return {c: c for c in SCORES} | {c: f"{metric}_{renamed.get(c, c)}" for c in rest}


def ranking(scores: DataFrame, top_k: int) -> DataFrame:
    """The top_k scored candidates with rank from 1; ties in the order of candidates. A top-k, so no full sort."""
    best = scores.where(F.col("cv_score").isNotNull()).orderBy(F.desc("cv_score"), "cand_idx").limit(top_k)
    rank = F.row_number().over(Window.orderBy(F.desc("cv_score"), "cand_idx"))  # over top_k rows
    return best.select(rank.alias("rank"), *ID, F.col("cv_score").alias("score_value"))


def score(metrics: DataFrame, n_folds: int, research: ResearchConfig, trials: int) -> DataFrame:
    return cv_scores(fold_pairs(metrics, research.selection_metric, trials), n_folds, research.cv_agg, research.cv_penalty_std)
