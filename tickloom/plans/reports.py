"""Reports over the tracking store: experiments, leaderboard, and the lines of one run."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tickloom.functions.stats import deflated_from_metrics, expected_best_column, normal_ppf
from tickloom.sources.store import EXPERIMENT, Tables, best_of, cache_diagnostics, latest_artifact, latest_metrics

#: Newest rows that the leaderboard looks at before it sorts.
NEWEST = 500


def selection_of(config: Column) -> tuple[Column, Column]:
    """Selection metric and aggregate of a stored config."""
    part = lambda name, default: F.coalesce(F.nullif(F.get_json_object(config, f"$.research.{name}"), F.lit("")), F.lit(default))
    return part("selection_metric", "sharpe_net"), part("cv_agg", "median")


def list_experiments(experiments: DataFrame, dataset_id: str | None = None, limit: int = 20, with_config: bool = False) -> DataFrame:
    """Newest first."""
    df = experiments if not dataset_id else experiments.where(F.col("dataset_id") == dataset_id)
    columns = ["experiment_id", "created_at", "mode", "run_name", "data_type", "dataset_id", "dataset_version"]
    if with_config:
        metric, agg = selection_of(F.col("config_json"))
        df = df.withColumns({"selection_metric": metric, "cv_agg": agg})
        columns += ["selection_metric", "cv_agg"]
    return df.orderBy(F.desc("experiment_id")).limit(limit).select(*columns)


def leaderboard(tables: Tables, dataset_id: str | None = None, limit: int = 20, sort_by: str = "cv", score_key: str | None = None) -> DataFrame:
    """The best candidate of each experiment with its cross-validated and test figures.

    The newest NEWEST rows are taken first, then sorted (cv, test or test_sharpe, missing last, ties newest first), then
    cut to limit. All lookups are two joins: the latest metrics as a map for each split, and the latest exec_stats.
    """
    if sort_by not in ("cv", "test", "test_sharpe"):
        raise ValueError(f"can't sort by {sort_by}")
    top = tables.best_candidates.where("rank = 1").select("experiment_id", "strategy_hash", "strategy_name", "score_key", "score_value")
    rows = tables.experiments.join(top, "experiment_id")
    if dataset_id:
        rows = rows.where(F.col("dataset_id") == dataset_id)
    if score_key and score_key not in ("any", "*"):
        rows = rows.where(F.col("score_key") == score_key)
    metric, agg = selection_of(F.col("config_json"))
    rows = rows.orderBy(F.desc("experiment_id")).limit(NEWEST).withColumns({"selection_metric": metric, "cv_agg": agg})
    rows = rows.withColumn("cv_sel_key", F.concat_ws("_", "selection_metric", F.lit("valid"), "cv_agg"))

    own = F.broadcast(rows.select("experiment_id", "strategy_hash"))  # NEWEST rows at most
    runs = tables.runs.join(own, ["experiment_id", "strategy_hash"], "left_semi").where(F.col("split").isin("cv", "test"))
    found = latest_metrics(runs, tables.metrics, unfolded=True)
    of = lambda split, key: F.max(F.when((F.col("split") == split) & (F.col("key") == key), F.col("value")))
    maps = found.groupBy("experiment_id", "strategy_hash").agg(
        of("cv", "dsr_trials").alias("_trials"),
        *[of("test", k).alias(k) for k in ("sharpe_net_per", "sharpe_net", "periods_per_year", "n_obs", "skew_net", "kurt_net")],
        F.map_from_entries(F.collect_list(F.struct(F.concat_ws("|", "split", "key"), "value"))).alias("_values"),
    )
    stats = latest_artifact(tables.runs.where(F.col("strategy_hash") == EXPERIMENT), tables.artifacts, "exec", "exec_stats").select("experiment_id", F.get_json_object("content", "$.candidates_unique").try_cast("int").alias("_tried"))
    rows = rows.join(maps, ["experiment_id", "strategy_hash"], "left").join(stats, "experiment_id", "left")

    named = lambda split, key: F.try_element_at("_values", F.concat_ws("|", F.lit(split), F.col(key)))
    rows = rows.withColumn("dsr_trials", F.greatest(F.lit(1), F.coalesce(F.col("_trials").cast("int"), F.col("_tried"), F.lit(1))))
    rows = rows.withColumns({"cv_sel_value": named("cv", "cv_sel_key"), "_plain": named("test", "selection_metric"), "_shift": expected_best_column(F.col("dsr_trials"))}).withColumn("_dsr", deflated_from_metrics(F.col("_shift")))
    rows = rows.withColumns({"test_sharpe_net": F.col("sharpe_net"), "test_sel_value": F.when(F.col("selection_metric") == "dsr_net", F.col("_dsr")).otherwise(F.col("_plain"))})
    order = {"cv": "score_value", "test": "test_sel_value", "test_sharpe": "test_sharpe_net"}[sort_by]
    rows = rows.withColumn("_by", F.when(~F.isnan(order), F.col(order))).orderBy(F.desc_nulls_last("_by"), F.desc("experiment_id")).limit(limit)
    return rows.select("experiment_id", "mode", "run_name", "dataset_id", "dataset_version", "strategy_name", F.substring("strategy_hash", 1, 12).alias("strategy_hash"), "score_key", "score_value", "selection_metric", "cv_agg", "cv_sel_key", "cv_sel_value", "test_sel_value", "test_sharpe_net", "dsr_trials")


def run_report(tables: Tables, experiment_id: int, show_top: int = 5) -> list[str]:
    """The lines that a run ends with: data, executor, cache, and its best candidates."""
    # The labels of the lines.
    import json

    experiment = tables.experiments.where(F.col("experiment_id") == experiment_id).first()
    config = json.loads(experiment.config_json)
    runs, artifacts = tables.runs.where(F.col("experiment_id") == experiment_id), tables.artifacts.where(F.col("experiment_id") == experiment_id)
    lines = [f"experiment_id={experiment_id}"]
    stored = lambda split, name: next((json.loads(r.content) for r in latest_artifact(runs, artifacts, split, name, EXPERIMENT).collect()), None)
    if data := stored("meta", "data_fingerprint"):
        lines.append(f"Data: type={data['kind']} id={data['name']} version={data['version']} method={data['basis']}")
    stats = stored("exec", "exec_stats")
    if stats:
        lines.append(f"Executor: mode={stats['mode']} requested_n_jobs={stats['requested_n_jobs']} used_n_jobs={stats['n_jobs_used']} executed_tasks={stats['n_tasks_executed']} had_fallback={stats['had_fallback']}")
        lines.append(f"Cache: fold_skipped={stats['fold_tasks_skipped']}/{stats['fold_tasks_total']} | test_skipped={stats['test_tasks_skipped']}/{stats['test_tasks_total']} | unique_candidates={stats['candidates_unique']}/{stats['candidates_generated']}")
        diag = cache_diagnostics(tables.experiments, experiment.evaluation_hash, experiment.eval_code_hash, experiment.code_hash, experiment_id).first()
        lines.append("CacheDiag: " + " ".join(f"{k}={v}" for k, v in diag.asDict().items()))
        lines += cache_hint(*diag[:3])
    else:
        lines.append("Executor: (no exec_stats found)")
    best = best_of(tables.best_candidates, experiment_id).collect()
    if not best:
        return [*lines, "No best candidates stored (check run logs)."]
    lines.append(f"Top-{min(show_top, len(best))} (score: {best[0].score_key})")
    metric, agg = config.get("research", {}).get("selection_metric") or "sharpe_net", config.get("research", {}).get("cv_agg") or "median"
    values: dict[tuple[str, str, str], float] = {(r.strategy_hash, r.split, r.key): r.value for r in latest_metrics(runs, tables.metrics.where(F.col("experiment_id") == experiment_id)).where(F.col("split").isin("cv", "test") & F.col("strategy_hash").isin([b.strategy_hash for b in best[:show_top]])).collect()}
    for b in best[:show_top]:
        of = lambda split, key, b=b: values.get((b.strategy_hash, split, key))
        shown = [(f"cv_{metric}_valid_{agg}", of("cv", f"{metric}_valid_{agg}"), 4), ("cv_gap", of("cv", f"{metric}_train_valid_gap_{agg}"), 4), ("cv_std", of("cv", f"{metric}_valid_std"), 4), ("cv_train>valid", of("cv", f"{metric}_train_gt_valid_frac"), 2)]
        test = dsr_value(*(of("test", k) for k in ("sharpe_net_per", "n_obs", "skew_net", "kurt_net")), (stats or {}).get("candidates_unique") or 1) if metric == "dsr_net" else of("test", metric)
        shown += [(f"test_{metric}", test, 4), ("test_sharpe_net", of("test", "sharpe_net"), 4)]
        extra = " ".join(f"{k}={v:.{d}f}" for k, v, d in shown if v is not None and v == v)
        lines.append(f"#{b.rank:02d} {b.score_key}={b.score_value:.4f} strategy={b.strategy_name} hash={b.strategy_hash[:12]}" + (f" | {extra}" if extra else ""))
    return lines


def cache_hint(same_eval: int, same_code: int, same_all: int) -> list[str]:
    if same_eval and not same_code:
        return ["CacheHint: earlier runs of this evaluation used other evaluation code, so nothing of them is taken over."]
    if not same_code:
        return ["CacheHint: this evaluation is stored for the first time; the next run of it can take it over."]
    if not same_all:
        return ["CacheHint: only code that no evaluation depends on has changed; stored runs still serve."]
    return []


def dsr_value(sharpe: float | None, n: float | None, skew: float | None, kurt: float | None, trials: int) -> float | None:
    """The deflated Sharpe ratio of plain numbers, for a report's line."""
    from statistics import NormalDist

    if None in (sharpe, n, skew, kurt) or n <= 1:
        return None
    term = 1 - skew * sharpe + (kurt - 1) / 4 * sharpe**2
    if term <= 0:
        return None
    shift = normal_ppf((trials - 0.375) / (trials + 0.25)) if trials > 1 else 0.0
    return NormalDist().cdf(sharpe / (term / (n - 1)) ** 0.5 - shift)
