"""The engine's operators as queries over the driver's tables, and the same in DuckDB's SQL.

Bars are daily aggregates of lineitem (sources.bars.daily_bars). Three literal candidates run over a walk-forward plan with
leverage 0.1. The tracking tables are views over customer, orders and lineitem of the shapes that the store has.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tickloom.config import BacktestConfig, CostConfig, CvConfig, DataConfig, ResearchConfig, SplitConfig
from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.stats import expected_best, normal_cdf_sql
from tickloom.operators import candidates as C
from tickloom.operators import metrics as M
from tickloom.operators import panel as P
from tickloom.operators import selection as S
from tickloom.operators import slices as V
from tickloom.plans import reports as R
from tickloom.sources import bars as B
from tickloom.sources import store as T
from tickloom.workers import send_package

CV = CvConfig(method="walk_forward", n_folds=4, valid_window_rows=200, step_rows=200, min_train_rows=600, purge_rows=5, holdout_test_rows=400)
RUN, COSTS = BacktestConfig(leverage=0.1), CostConfig(borrow_bps_annual=50.0)
SPECS = [
    C.StrategySpec(C.LINEAR, {"weights": [1.0, 0.0, 0.0, 0.0], "threshold": 0.0005}),
    C.StrategySpec(C.LINEAR, {"weights": [0.6, -0.6, 0.2, 0.5], "threshold": 0.001}),
    C.StrategySpec(C.LINEAR, {"weights": [0.0, 0.3, -0.9, 0.3], "threshold": 0.004}),
]
TRIALS = 60


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.daily_bars(_table(spark, sf_dir, "lineitem"))


def _plan(spark: SparkSession, sf_dir: str) -> V.Plan:
    """The plan needs the number of bars: one count over the distinct days."""
    days = _table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_shipdate")).first()[0]
    return V.walk_forward_plan(days, CV)


def _panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    return P.panel(_bars(spark, sf_dir), _plan(spark, sf_dir).slices, C.candidate_table(spark, SPECS), RUN, COSTS)


def _whole_metrics(bars: DataFrame, plan: V.Plan) -> DataFrame:
    facts = P.slice_facts(bars, plan.slices)
    return M.fold_metrics(P.panel(bars, plan.slices, C.candidate_table(bars.sparkSession, SPECS), RUN, COSTS, facts=facts), some_own=P.some_own(facts))


def _rounded(df: DataFrame, keep: list[str], names: list[str], digits: int = 6) -> DataFrame:
    return df.select(*keep, *[(F.round(F.col(c), digits) + 0.0).alias(c) for c in names])  # no negative zero


ID = ["cand_idx", "fold", "split"]


# --- bars -------------------------------------------------------------------------------------------------------------
def bars_daily(spark, sf_dir):
    return _rounded(_bars(spark, sf_dir), ["ts", "row_idx"], ["price", "f000", "f001", "f002", "f003"])


def bars_last_n(spark, sf_dir):
    return _rounded(B.last_rows(_bars(spark, sf_dir), 100), ["ts"], ["price"])


def bars_dedup_first(spark, sf_dir):
    raw = _table(spark, sf_dir, "events").select("event_id", F.date_trunc("minute", "ts").cast("timestamp_ntz").alias("ts"), "value")
    return B.first_by(raw, "ts", [F.col("event_id")]).select("ts", "event_id", "value")


def bars_dropna(spark, sf_dir):
    raw = _table(spark, sf_dir, "customer").select("c_custkey", F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("price"), F.when(F.col("c_nationkey") % 3 != 0, F.col("c_nationkey").cast("double")).alias("f000"))
    return B.complete_rows(raw, ["price", "f000"])


def bars_normalised(spark, sf_dir):
    """Events as a series: repeated times resolved by event_id, the last 500 kept, rows with gaps dropped, numeric features by name."""
    raw = _table(spark, sf_dir, "events").select("event_id", F.date_trunc("minute", "ts").alias("timestamp"), (F.col("value") + 1000).alias("price"), F.when(F.col("user_id") % 7 != 0, F.col("user_id").cast("double")).alias("zz"), F.length("event_type").cast("double").alias("aa"))
    return B.normalise(raw, features=["zz", "aa"], n_features=2, row_limit=500, order=F.col("event_id")).select("ts", "row_idx", "price", "f000", "f001")


def time_axis(spark, sf_dir):
    """A regular axis of hours over the events' time, and how many events each hour has; hours without any are there too."""
    hours = _table(spark, sf_dir, "events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts")).agg(F.count("*").alias("n"))
    first, last = hours.agg(F.min("ts"), F.max("ts")).first()
    axis = B.time_axis(spark, str(first), int((last - first).total_seconds() // 3600) + 1, "h")
    return axis.join(hours, "ts", "left").select("ts", F.coalesce("n", F.lit(0)).alias("n"))


def synthetic_bars(spark, sf_dir):
    """A drawn series as long as the events', by hashes (SQL has none of these; a test holds it against numpy)."""
    return B.synthetic_bars_at_scale(spark, DataConfig(n_rows=_table(spark, sf_dir, "events").count()), 42)


# --- slices -----------------------------------------------------------------------------------------------------------
def split_single(spark, sf_dir):
    days = _table(spark, sf_dir, "lineitem").agg(F.count_distinct("l_shipdate")).first()[0]
    return V.slice_table(spark, V.single_plan(days, SplitConfig(embargo_rows=5)).slices)


def slices_walk_forward(spark, sf_dir):
    return V.slice_table(spark, _plan(spark, sf_dir).slices)


def slice_membership(spark, sf_dir):
    return V.assign(_bars(spark, sf_dir), _plan(spark, sf_dir).slices).groupBy("fold", "split").agg(F.count("*").alias("n"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"), F.sum("row_idx").alias("idx_sum"))


def plan_meta(spark, sf_dir):
    return V.plan_meta(_bars(spark, sf_dir), _plan(spark, sf_dir)).where("split <> 'holdout_train'")


def periods_per_year(spark, sf_dir):
    return _rounded(P.periods_per_year(_bars(spark, sf_dir), _plan(spark, sf_dir).slices), ["fold", "split"], ["ppy"])


# --- panel ------------------------------------------------------------------------------------------------------------
def signal_positions(spark, sf_dir):
    market = P.market(_bars(spark, sf_dir), _plan(spark, sf_dir).slices)
    return P.core(P.signals(market, C.candidate_table(spark, SPECS))).select(*ID, "ts", "raw")


def exec_lag(spark, sf_dir):
    market = P.market(_bars(spark, sf_dir), _plan(spark, sf_dir).slices, lag=2)
    rows = P.backtest(P.signals(market, C.candidate_table(spark, SPECS)), BacktestConfig(execution_lag=2, leverage=0.1), COSTS)
    return _rounded(rows, [*ID, "ts"], ["pos", "tov"])


def asset_returns(spark, sf_dir):
    return _rounded(P.core(P.moves(_bars(spark, sf_dir), _plan(spark, sf_dir).slices)), ["fold", "split", "ts"], ["ret"], 9)


def turnover_costs(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir), [*ID, "ts"], ["tov", "tc", "slip", "borrow"], 9)


def equity_curve(spark, sf_dir):
    return _rounded(_panel(spark, sf_dir), [*ID, "ts"], ["net", "eq"], 8)


def drawdown(spark, sf_dir):
    rows = _panel(spark, sf_dir)
    return _rounded(rows.withColumn("dd", F.col("eq") / F.col("peak") - 1), [*ID, "ts"], ["peak", "dd"], 8)


def equity_head(spark, sf_dir):
    heads = P.equity_head(_panel(spark, sf_dir))
    return heads.select(*ID, "t0", "t1", F.round("equity_end", 6).alias("equity_end"), F.size("equity_head").cast("long").alias("n"), F.round(F.element_at("equity_head", -1), 6).alias("last_of_head"))


def rolling_vol(spark, sf_dir):
    return _rounded(P.core(P.moves(_bars(spark, sf_dir), _plan(spark, sf_dir).slices)), ["fold", "split", "ts"], ["vol"], 9)


def regime_quantiles(spark, sf_dir):
    market = P.market(_bars(spark, sf_dir), _plan(spark, sf_dir).slices)
    facts = P.core(market).groupBy("fold", "split").agg(*[F.first(c).alias(c) for c in ("vol_q33", "vol_q66", "n_vol", "ref_used", "ref_coverage")])
    return _rounded(facts, ["fold", "split", "n_vol", "ref_used", "ref_coverage"], ["vol_q33", "vol_q66"], 9)


# --- metrics ----------------------------------------------------------------------------------------------------------
def base_metrics(spark, sf_dir):
    return _rounded(M.base_metrics(_panel(spark, sf_dir)), ID, list(M.BASE))


def regime_metrics(spark, sf_dir):
    return _rounded(_whole_metrics(_bars(spark, sf_dir), _plan(spark, sf_dir)), ID, list(M.REFERENCE + M.REGIME))


def psr(spark, sf_dir):
    return _rounded(M.base_metrics(_panel(spark, sf_dir)), ID, ["sharpe_net_per", "psr_net"])


def dsr(spark, sf_dir):
    from tickloom.functions.stats import deflated_from_metrics

    return M.base_metrics(_panel(spark, sf_dir)).select(*ID, F.round(deflated_from_metrics(TRIALS), 6).alias("dsr_net"))


def metrics_eav(spark, sf_dir):
    return M.to_long(M.base_metrics(_panel(spark, sf_dir)), ID, M.BASE).select(*ID, "key", F.round("value", 6).alias("value"))


# --- selection --------------------------------------------------------------------------------------------------------
def _metrics(spark, sf_dir, name: str = "sharpe_net") -> DataFrame:
    return S.fold_pairs(M.base_metrics(_panel(spark, sf_dir)), name, TRIALS)


def _scores(spark, sf_dir) -> DataFrame:
    return S.cv_scores(_metrics(spark, sf_dir), CV.n_folds, "median", 0.5)


def fold_pairs(spark, sf_dir):
    return _rounded(_metrics(spark, sf_dir), ["cand_idx", "fold"], ["train", "valid"])


def cv_score(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), ["cand_idx", "cv_complete", "cv_n_folds_ok", "cv_n_folds_total"], ["cv_score", "valid_agg", "valid_std", "valid_min"])


def cv_score_dsr(spark, sf_dir):
    """Deflated Sharpe ratios as the selection metric, their mean as the aggregate."""
    scores = S.cv_scores(_metrics(spark, sf_dir, "dsr_net"), CV.n_folds, "mean", 1.0)
    return _rounded(scores, ["cand_idx", "cv_complete"], ["cv_score", "valid_agg", "train_agg"])


def cv_score_min(spark, sf_dir):
    scores = S.cv_scores(_metrics(spark, sf_dir, "total_return"), CV.n_folds, "min", 0.0)
    return _rounded(scores, ["cand_idx"], ["cv_score", "train_valid_gap"])


def aligned_positions(spark, sf_dir):
    """Positions from elsewhere, some rows missing, put onto the panel's rows: what is missing is flat."""
    rows = _panel(spark, sf_dir)
    kept = rows.where("row_idx % 3 <> 0")
    return P.aligned(rows, kept.select(*P.KEY, "ts", "raw")).groupBy(*ID).agg(F.sum(F.abs("raw")).alias("days_held"))


def reference_returns(spark, sf_dir):
    """Asset returns implied by gross results and the position before."""
    return _rounded(P.reference_returns(_panel(spark, sf_dir)), [*ID, "ts"], ["implied"], 8)


def _event_bars(spark, sf_dir) -> DataFrame:
    """A series that grows with the tables: a bar for each event."""
    features = {"a": F.col("user_id") % 11 / 5.0 - 1, "b": F.col("user_id") % 7 / 3.0 - 1, "c": F.length("event_type") / 6.0 - 1, "d": F.col("event_id") % 5 / 2.0 - 1}
    raw = _table(spark, sf_dir, "events").select("event_id", F.col("ts").alias("timestamp"), (F.col("value") + 1000).alias("price"), *[f.alias(n) for n, f in features.items()])
    return B.normalise(raw, features=list(features), order=F.col("event_id"))


def _event_plan(spark, sf_dir) -> V.Plan:
    n = _table(spark, sf_dir, "events").where("value is not null").agg(F.count_distinct("ts")).first()[0]
    return V.walk_forward_plan(n, CvConfig(method="walk_forward", n_folds=3, valid_window_rows=n // 10, step_rows=n // 10, min_train_rows=n // 2, purge_rows=5, holdout_test_rows=n // 10))


def series_curve(spark, sf_dir):
    """Equity and its peak at every bar of a series whose slices have many stretches."""
    panel = P.panel(_event_bars(spark, sf_dir), _event_plan(spark, sf_dir).slices, C.candidate_table(spark, SPECS), RUN, COSTS)
    return _rounded(panel, [*ID, "row_idx"], ["pos", "net", "eq", "peak"])


def series_metrics(spark, sf_dir):
    """All metrics but cagr, which 180,000 bars a year make too large to compare (base_metrics has it)."""
    return _rounded(_whole_metrics(_event_bars(spark, sf_dir), _event_plan(spark, sf_dir)), ID, [c for c in M.ALL if c != "cagr"])


def series_quantiles(spark, sf_dir):
    """Exact quantiles of the events' values by type."""
    rows = exact_quantiles(_table(spark, sf_dir, "events"), ["event_type"], F.col("value"), [0.0, 0.25, 0.5, 0.99, 1.0], few=True)
    return _rounded(rows, ["event_type", "n"], [f"q{i}" for i in range(5)], 9)


def overfit_diag(spark, sf_dir):
    return _rounded(_scores(spark, sf_dir), ["cand_idx", "train_valid_n_pairs"], ["train_agg", "train_std", "train_min", "train_valid_gap", "train_gt_valid_frac", "train_valid_corr"])


def ranking_topk(spark, sf_dir):
    return _rounded(S.ranking(_scores(spark, sf_dir), 2), ["rank", "cand_idx"], ["score_value"])


def holdout_eval(spark, sf_dir):
    plan, bars = _plan(spark, sf_dir), _bars(spark, sf_dir)
    best = S.ranking(_scores(spark, sf_dir), 2).select("strategy_hash", "rank")
    chosen = C.candidate_table(spark, SPECS).join(F.broadcast(best.select("strategy_hash")), "strategy_hash", "left_semi")
    tested = M.base_metrics(P.panel(bars, plan.of("test"), chosen, RUN, COSTS))
    return _rounded(tested.join(F.broadcast(best), "strategy_hash"), ["rank", "cand_idx"], ["n_obs", "sharpe_net", "total_return", "max_drawdown"])


def candidates_distinct(spark, sf_dir):
    rows = _table(spark, sf_dir, "part").select(F.col("p_partkey").alias("cand_idx"), F.md5(F.concat_ws("|", "p_brand", "p_type")).alias("strategy_hash"))
    return C.distinct_candidates(rows)


def custom_strategy_pandas(spark, sf_dir):
    """A fitted strategy in pandas: long where a feature exceeds its train median, the holdout's by the rows before it."""
    send_package(spark)
    bars, plan = _bars(spark, sf_dir), _plan(spark, sf_dir)
    sliced, market = V.assign(bars, [*plan.slices, *plan.holdout_train]), P.market(bars, plan.slices)
    positions = C.pandas_positions(sliced.select("fold", "split", "ts", "row_idx", "f000"), {"median_rule": _median_rule()})
    names = positions.select("cand_block", "cand_idx", "strategy_hash", "strategy_name").distinct()
    rows = P.aligned(market.crossJoin(F.broadcast(names)).drop(*B.features_of(market)), positions)  # a row for each named strategy
    return _rounded(M.base_metrics(P.backtest(rows, RUN, COSTS)), ID, ["n_obs", "sharpe_net", "total_return", "exposure_mean"])


def _median_rule() -> C.Strategy:
    class MedianRule(C.Strategy):
        def fit(self, train):
            self.middle = train["f000"].median()
            return self

        def positions(self, frame):
            return np.where(frame["f000"] > self.middle, 1.0, -1.0)

    return MedianRule()


def _broken_rule(params: dict) -> C.Strategy:
    rule = _median_rule()
    fit, rule.rows = rule.fit, 0

    def counted(train):
        if len(train) == CV.min_train_rows + 2 * CV.step_rows:
            raise RuntimeError("no positions")
        return fit(train)

    rule.fit = counted
    return rule


def strategy_outcomes(spark, sf_dir):
    """Two strategies in pandas on every fold, of which one raises in the third: its error stands in place of that fold's positions."""
    send_package(spark)
    plan = _plan(spark, sf_dir)
    sliced = V.assign(_bars(spark, sf_dir), [*plan.slices, *plan.holdout_train]).select("fold", "split", "ts", "row_idx", "f000")
    table = C.candidate_table(spark, [C.StrategySpec("median", {}), C.StrategySpec("broken", {})])
    rows = C.pandas_outcomes(sliced, table, {"median": lambda params: _median_rule(), "broken": _broken_rule})
    out = rows.groupBy("cand_idx", "fold", F.coalesce("split", F.lit("")).alias("split"), F.coalesce("error", F.lit("")).alias("error"))
    return out.agg(F.count("raw").alias("n"), F.coalesce(F.sum("raw"), F.lit(0.0)).alias("raw_sum"))


# --- tracking ---------------------------------------------------------------------------------------------------------
#: Line items that a task groups at a time. A task's memory follows this number, not the table.
TASK_LINES = 400_000


def _by_run(lineitem: DataFrame, rows: int | None = None) -> DataFrame:
    """lineitem dealt by l_orderkey to tasks of some rows (TASK_LINES) each, which all later groups and joins by run keep to. Costs a count, which Parquet's footers answer."""
    tasks = -(-lineitem.count() // (rows or TASK_LINES))
    return lineitem.repartition(max(tasks, lineitem.sparkSession.sparkContext.defaultParallelism), "l_orderkey")


def _tracking(spark: SparkSession, sf_dir: str) -> T.Tables:
    customer, orders, lineitem = (_table(spark, sf_dir, t) for t in ("customer", "orders", "lineitem"))
    config = F.concat(F.lit('{"research":{"selection_metric":"'), F.when(F.col("c_custkey") % 3 == 0, "dsr_net").otherwise("sharpe_net"), F.lit('","cv_agg":"'), F.when(F.col("c_custkey") % 4 == 0, "").otherwise("mean"), F.lit('"}}'))
    experiments = customer.select(
        F.col("c_custkey").alias("experiment_id"), F.lit("2024-01-01T00:00:00Z").alias("created_at"), F.col("c_name").alias("run_name"), F.lit("light").alias("mode"),
        config.alias("config_json"), F.concat(F.lit("e"), F.col("c_custkey") % 5).alias("evaluation_hash"), F.concat(F.lit("c"), F.col("c_custkey") % 2).alias("eval_code_hash"),
        F.concat(F.lit("k"), F.col("c_custkey") % 7).alias("code_hash"), F.lit("table").alias("data_type"), F.col("c_mktsegment").alias("dataset_id"), F.lit("v1").alias("dataset_version"),
    )
    split = F.element_at(F.array(*map(F.lit, ("train", "valid", "cv", "test", "exec"))), (F.col("o_orderkey") % 5 + 1).cast("int"))
    runs = orders.select(
        F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"), split.alias("split"),
        F.when(F.col("o_orderkey") % 5 < 2, (F.col("o_orderkey") % 3).cast("int")).alias("fold"),
        F.when(F.col("o_orderkey") % 5 == 4, T.EXPERIMENT).otherwise(F.concat(F.lit("h"), F.col("o_custkey") % 4)).alias("strategy_hash"),
        F.when(F.col("o_orderstatus") == "F", "error").otherwise("ok").alias("status"),
    )
    keys = F.array(*map(F.lit, ("sharpe_net", "sharpe_net_per", "n_obs", "skew_net", "dsr_trials", "sharpe_net_valid_mean", "kurt_net")))
    key = F.element_at(keys, F.col("l_linenumber"))
    value = F.when(key == "n_obs", F.col("l_quantity") + 30).when(key == "dsr_trials", F.col("l_quantity")).when(key == "kurt_net", 3 + F.col("l_discount")).otherwise(F.col("l_discount") - 0.05)
    lines = _by_run(lineitem).where("l_linenumber <= 7").withColumn("run_id", F.col("l_orderkey"))
    values = lines.groupBy("run_id", key.alias("key")).agg(F.max(F.when(F.col("l_quantity") <= 45, value)).alias("value"))
    values = values.join(runs.select("run_id", "experiment_id"), "run_id")
    artifacts = orders.select(F.col("o_custkey").alias("experiment_id"), F.col("o_orderkey").alias("run_id"), F.lit("exec_stats").alias("name"), F.concat(F.lit('{"candidates_unique":'), F.col("o_orderkey") % 50, F.lit("}")).alias("content"))
    rank = F.row_number().over(Window.partitionBy("o_custkey").orderBy(F.desc("o_totalprice"), "o_orderkey"))
    best = orders.select(F.col("o_custkey").alias("experiment_id"), rank.alias("rank"), F.lit("cv_score").alias("score_key"), (F.col("o_totalprice") / 1000).alias("score_value"), F.concat(F.lit("h"), F.col("o_custkey") % 4).alias("strategy_hash"), F.lit(C.LINEAR).alias("strategy_name"))
    return T.Tables(experiments, runs, values, artifacts, best.where("rank <= 3"))


def _log(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """A store's log of runs and metrics, and its commits: line items as writes of the runs that their orders are."""
    own = _table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("run_id"), F.col("o_custkey").alias("experiment_id"))
    lines = _table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("run_id"), F.col("l_linenumber").cast("long").alias("seq"), "l_returnflag", "l_partkey", "l_quantity")
    log = lines.join(own, "run_id").groupBy("experiment_id", "run_id", "seq").agg(F.max("l_returnflag").alias("flag"), F.max("l_partkey").alias("part"), F.max("l_quantity").alias("value"))
    status = F.when(F.col("seq") == 1, "running").when(F.col("flag") == "R", "error").otherwise("ok")
    runs = log.select("experiment_id", "run_id", status.alias("status"), "seq")
    values = log.where("seq > 1").select("experiment_id", "run_id", F.concat(F.lit("k"), F.col("part") % 3).alias("key"), "value", "seq")
    n = F.col("experiment_id") + F.col("seq")
    commits = log.select("experiment_id", "seq").distinct().where(n % 7 != 0).withColumn("base", (n % 5 == 0) & (F.col("seq") == 3))
    return runs, values, commits


def merged_runs(spark, sf_dir):
    """Runs as they stand: of committed writes, none before a base, the newest of each run."""
    runs, _, commits = _log(spark, sf_dir)
    return T.merged(runs, commits, T.KEYS["runs"])


def merged_metrics(spark, sf_dir):
    _, values, commits = _log(spark, sf_dir)
    return T.merged(values, commits, T.KEYS["metrics"])


def source_digest(spark, sf_dir):
    """The number of rows and the summed hash of a table's rows: what a source's version is made of."""
    from tickloom.identity import content_digest

    parts = [(t, *content_digest(_table(spark, sf_dir, t).repartition(3))) for t in ("nation", "events", "orders")]
    same = {t: content_digest(_table(spark, sf_dir, t)) for t, _, _ in parts}
    return spark.createDataFrame([(t, n, d == same[t][1]) for t, n, d in parts], "name string, n long, same boolean")


def latest_metric(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    return T.latest_metrics(t.runs, t.metrics).select("experiment_id", "strategy_hash", "split", "key", F.round("value", 6).alias("value"))


def latest_metric_unfolded(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    return T.latest_metrics(t.runs, t.metrics, unfolded=True).select("experiment_id", "strategy_hash", "split", "key", F.round("value", 6).alias("value"))


def latest_artifact(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    return T.latest_artifact(t.runs, t.artifacts, "exec", "exec_stats", T.EXPERIMENT)


def metrics_pivot(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    return _rounded(M.to_wide(t.metrics, ["run_id"], ["sharpe_net", "n_obs", "skew_net"]), ["run_id"], ["sharpe_net", "n_obs", "skew_net"])


def run_metrics(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    first = t.metrics.agg(F.min("run_id")).first()[0]
    return T.run_metrics(t.metrics, first).select("key", F.round("value", 6).alias("value"))


def run_artifact(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    first = t.artifacts.agg(F.min("run_id")).first()[0]
    return T.run_artifact(t.artifacts, first, "exec_stats")


def best_candidates(spark, sf_dir):
    t = _tracking(spark, sf_dir)
    return t.best_candidates.where("score_value > 100").select("experiment_id", "rank", "strategy_hash", F.round("score_value", 6).alias("score_value"))


def _tasks(spark, sf_dir) -> DataFrame:
    hashes = spark.range(0, 6).select(F.concat(F.lit("h"), "id").alias("strategy_hash"))
    return hashes.select("strategy_hash", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("fold"))


def cache_hits(spark, sf_dir):
    return T.split_by_cache(_tasks(spark, sf_dir), T.cached_runs(_tracking(spark, sf_dir), "e1", "c1", 1))[0]


def cache_misses(spark, sf_dir):
    return T.split_by_cache(_tasks(spark, sf_dir), T.cached_runs(_tracking(spark, sf_dir), "e1", "c1", 1))[1]


def cached_runs(spark, sf_dir):
    return T.cached_runs(_tracking(spark, sf_dir), "e1", "c1", 1)


def union_results(spark, sf_dir):
    """Cached and computed runs in one table, cached ones marked."""
    t = _tracking(spark, sf_dir)
    hit = T.cached_runs(t, "e1", "c1", 1).select("strategy_hash", "split", "fold", F.lit(1.0).alias("cached"))
    own = t.runs.where("experiment_id = 1").select("strategy_hash", "split", "fold", F.lit(0.0).alias("cached"))
    return hit.unionByName(own)


def cache_diag(spark, sf_dir):
    return T.cache_diagnostics(_tracking(spark, sf_dir).experiments, "e1", "c1", "k1", 1)


def experiments_list(spark, sf_dir):
    return R.list_experiments(_tracking(spark, sf_dir).experiments, "BUILDING", 20, True)


def _board(sort_by: str):
    def query(spark, sf_dir):
        return _rounded(R.leaderboard(_tracking(spark, sf_dir), None, 50, sort_by), ["experiment_id", "dataset_id", "strategy_hash", "selection_metric", "cv_agg", "cv_sel_key", "dsr_trials"], ["score_value", "cv_sel_value", "test_sel_value", "test_sharpe_net"])

    return query


def leaderboard_filtered(spark, sf_dir):
    board = R.leaderboard(_tracking(spark, sf_dir), "MACHINERY", 10, "cv", "cv_score")
    return board.select("experiment_id", "strategy_hash", F.round("score_value", 6).alias("score_value"))


def experiment_flow(spark, sf_dir):
    """The flagship: bars to a ranking with holdout figures, regime metrics included."""
    plan, bars = _plan(spark, sf_dir), _bars(spark, sf_dir)
    metrics = _whole_metrics(bars, plan)
    research = ResearchConfig(selection_metric="regime_worst_sharpe_net")
    ranked = S.ranking(S.score(metrics, plan.n_folds, research, len(SPECS)), 3)
    test = metrics.where("split = 'test'").select("strategy_hash", "sharpe_net", "total_return", "max_drawdown", "regime_worst_sharpe_net")
    return _rounded(ranked.join(test, "strategy_hash"), ["rank", "cand_idx"], ["score_value", "sharpe_net", "total_return", "max_drawdown", "regime_worst_sharpe_net"])


# --- DuckDB -----------------------------------------------------------------------------------------------------------
BARS = """bars AS (SELECT *, row_number() OVER (ORDER BY ts) - 1 AS row_idx FROM (SELECT l_shipdate AS ts, 20000 + sum(l_extendedprice) / sum(l_quantity) AS price,
 avg(l_discount) - 0.05::DOUBLE AS f000, avg(l_tax) - 0.04::DOUBLE AS f001, avg(l_quantity) / 25.5::DOUBLE - 1 AS f002,
 avg(CASE WHEN l_returnflag = 'R' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) - 1.0::DOUBLE / 3 AS f003 FROM lineitem GROUP BY 1)),
n AS (SELECT count(*)::BIGINT AS n FROM bars)"""
SLICES = BARS + """,
firsts AS (SELECT i::INT AS fold, 605 + 200 * i AS v FROM range(4) AS r(i)),
slices AS (SELECT fold, 'train' AS split, 0::BIGINT AS lo, (v - 5)::BIGINT AS hi FROM firsts UNION ALL SELECT fold, 'valid', v, v + 200 FROM firsts UNION ALL SELECT NULL, 'test', n - 400, n FROM n)"""
MARKET = SLICES + """,
sliced AS (SELECT s.fold, s.split, b.* FROM bars b JOIN slices s ON b.row_idx >= s.lo AND b.row_idx < s.hi),
steps AS (SELECT fold, split, epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY fold, split ORDER BY row_idx) AS step FROM sliced),
ppys AS (SELECT fold, split, 365.25::DOUBLE * 86400 / CASE WHEN count(*) >= 3 AND median(step) > 0 THEN median(step) ELSE 86400 END AS ppy FROM steps GROUP BY 1, 2),
rets AS (SELECT *, coalesce(price / nullif(lag(price) OVER w, 0) - 1, 0) AS ret FROM sliced WINDOW w AS (PARTITION BY fold, split ORDER BY row_idx)),
vols AS (SELECT *, CASE WHEN count(*) OVER v = 20 THEN stddev_pop(ret) OVER v END AS vol FROM rets WINDOW v AS (PARTITION BY fold, split ORDER BY row_idx ROWS 19 PRECEDING)),
facts AS (SELECT fold, split, quantile_cont(vol, 0.33) AS vol_q33, quantile_cont(vol, 0.66) AS vol_q66, count(vol) AS n_vol, CASE WHEN stddev_pop(ret) > 1e-12 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS ref_used, 1.0::DOUBLE AS ref_coverage FROM vols GROUP BY 1, 2),
market AS (SELECT v.*, f.vol_q33, f.vol_q66, f.n_vol, f.ref_used, f.ref_coverage, p.ppy FROM vols v JOIN facts f ON f.split = v.split AND f.fold IS NOT DISTINCT FROM v.fold JOIN ppys p ON p.split = v.split AND p.fold IS NOT DISTINCT FROM v.fold)"""
CANDS = ",\ncands(cand_idx, w0, w1, w2, w3, threshold) AS (VALUES " + ", ".join(f"({i}, {', '.join(f'{w!r}::DOUBLE' for w in s.params['weights'])}, {s.params['threshold']!r}::DOUBLE)" for i, s in enumerate(SPECS)) + ")"
SIGNAL = MARKET + CANDS + """,
scored AS (SELECT m.*, c.cand_idx, c.threshold, f000 * w0 + f001 * w1 + f002 * w2 + f003 * w3 AS score FROM market m CROSS JOIN cands c),
signal AS (SELECT * EXCLUDE (score, threshold), CASE WHEN score > threshold THEN 1.0::DOUBLE WHEN score < -threshold THEN -1.0::DOUBLE ELSE 0.0::DOUBLE END AS raw FROM scored)"""


def _panel_sql(lag: int = 1) -> str:
    w = "WINDOW w AS (PARTITION BY cand_idx, fold, split ORDER BY row_idx)"
    return SIGNAL + f""",
held AS (SELECT *, coalesce(lag(raw, {lag}) OVER w, 0) * 0.1::DOUBLE AS pos FROM signal {w}),
turned AS (SELECT *, pos * ret AS gross, abs(pos - coalesce(lag(pos) OVER w, 0)) AS tov FROM held {w}),
costed AS (SELECT *, tov * (2.0::DOUBLE / 1e4) AS tc, tov * (1.0::DOUBLE / 1e4) AS slip, abs(pos) * (50.0::DOUBLE / 1e4) / greatest(1.0::DOUBLE, ppy) AS borrow FROM turned),
netted AS (SELECT *, gross - tc - slip - borrow AS net FROM costed),
curve AS (SELECT *, product(1 + net) OVER (PARTITION BY cand_idx, fold, split ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS eq FROM netted),
panel AS (SELECT *, max(eq) OVER (PARTITION BY cand_idx, fold, split ORDER BY row_idx ROWS UNBOUNDED PRECEDING) AS peak FROM curve)"""


PANEL = _panel_sql()
METRICS = PANEL + f""",
moments AS (SELECT cand_idx, fold, split, count(*)::DOUBLE AS n_obs, avg(net) AS mu, CASE WHEN stddev_samp(net) > 0 THEN stddev_samp(net) END AS sd FROM panel GROUP BY 1, 2, 3),
agg AS (SELECT p.cand_idx, p.fold, p.split, any_value(n_obs) AS n_obs, any_value(ppy) AS periods_per_year, max_by(eq, row_idx) AS last_eq, any_value(mu / sd) AS sharpe_net_per,
 CASE WHEN any_value(n_obs) >= 3 THEN avg(((net - mu) / sd) ** 3) END AS skew_net, CASE WHEN any_value(n_obs) >= 4 THEN avg(((net - mu) / sd) ** 4) END AS kurt_net,
 min(eq / peak - 1) AS max_drawdown, avg(tov) AS avg_turnover, sum(gross) AS gross_sum, sum(net) AS net_sum, sum(tc + slip + borrow) AS cost_sum, avg(abs(pos)) AS exposure_abs_mean,
 avg(pos) AS exposure_mean, avg(CASE WHEN abs(pos) > 1e-12 THEN CASE WHEN net > 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END END) AS hit_rate
 FROM panel p JOIN moments m ON m.cand_idx = p.cand_idx AND m.split = p.split AND m.fold IS NOT DISTINCT FROM p.fold GROUP BY 1, 2, 3),
se AS (SELECT *, sharpe_net_per * sqrt(periods_per_year) AS sharpe_net, last_eq - 1 AS total_return, CASE WHEN last_eq > 0 THEN last_eq ** (periods_per_year / n_obs) - 1 END AS cagr,
 1 - coalesce(skew_net, 0) * sharpe_net_per + (coalesce(kurt_net, 3) - 1) / 4 * sharpe_net_per * sharpe_net_per AS term FROM agg),
zs AS (SELECT *, CASE WHEN n_obs > 1 AND term > 0 THEN sharpe_net_per / nullif(sqrt(term / (n_obs - 1)), 0) END AS z, CASE WHEN n_obs > 1 AND term > 0 THEN sharpe_net_per / nullif(sqrt(term / (n_obs - 1)), 0) - {expected_best(TRIALS)!r}::DOUBLE END AS z_best FROM se),
base AS (SELECT *, {normal_cdf_sql("z")} AS psr_net, {normal_cdf_sql("z_best")} AS dsr_net FROM zs)"""
PAIRS = METRICS + """,
pairs AS (SELECT cand_idx, fold, max(CASE WHEN split = 'train' THEN sharpe_net END) AS train, max(CASE WHEN split = 'valid' THEN sharpe_net END) AS valid FROM base WHERE split <> 'test' GROUP BY 1, 2),
cv AS (SELECT cand_idx, (count(valid) = 4)::INT::DOUBLE AS cv_complete, count(valid)::DOUBLE AS cv_n_folds_ok, 4.0::DOUBLE AS cv_n_folds_total,
 CASE WHEN count(valid) = 4 THEN median(valid) END AS valid_agg, CASE WHEN count(valid) = 4 THEN stddev_samp(valid) END AS valid_std, CASE WHEN count(valid) = 4 THEN min(valid) END AS valid_min,
 CASE WHEN count(valid) = 4 THEN median(train) END AS train_agg, CASE WHEN count(valid) = 4 THEN stddev_samp(train) END AS train_std, CASE WHEN count(valid) = 4 THEN min(train) END AS train_min,
 CASE WHEN count(valid) = 4 THEN avg((train > valid)::INT) END AS train_gt_valid_frac, CASE WHEN count(valid) = 4 THEN covar_samp(train, valid) / nullif(stddev_samp(train) * stddev_samp(valid), 0) END AS train_valid_corr,
 CASE WHEN count(valid) = 4 THEN count(train) ELSE 0 END::DOUBLE AS train_valid_n_pairs FROM pairs GROUP BY 1),
scores AS (SELECT *, valid_agg - 0.5::DOUBLE * valid_std AS cv_score, train_agg - valid_agg AS train_valid_gap FROM cv),
ranked AS (SELECT row_number() OVER (ORDER BY cv_score DESC, cand_idx)::INT AS rank, cand_idx, cv_score AS score_value FROM scores WHERE cv_score IS NOT NULL ORDER BY rank LIMIT 2)"""
#: The fitted rule of custom_strategy_pandas in place of the candidates: the median of the train rows, for the test slice of those before the gap.
CUSTOM = METRICS.replace(SIGNAL, MARKET + """,
medians AS (SELECT fold, median(f000) AS middle FROM sliced WHERE split = 'train' GROUP BY 1 UNION ALL SELECT NULL, median(f000) FROM bars WHERE row_idx < (SELECT n FROM n) - 405),
signal AS (SELECT m.*, 0 AS cand_idx, CASE WHEN f000 > middle THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS raw FROM market m JOIN medians d ON m.fold IS NOT DISTINCT FROM d.fold)""")
REGIMES = METRICS + """,
labelled AS (SELECT *, CASE WHEN vol IS NULL THEN NULL WHEN vol_q66 <= vol_q33 THEN 'mid' WHEN vol <= vol_q33 THEN 'low' WHEN vol <= vol_q66 THEN 'mid' ELSE 'high' END AS regime FROM panel),
per AS (SELECT cand_idx, fold, split, any_value(n_vol) AS points, any_value(vol_q33) AS q33, any_value(vol_q66) AS q66, any_value(ref_used) AS regime_ref_used, any_value(ref_coverage) AS regime_ref_coverage,
""" + ",\n".join(f" count(*) FILTER (regime = '{x}')::DOUBLE AS n_{x}, avg(net) FILTER (regime = '{x}') / CASE WHEN stddev_samp(net) FILTER (regime = '{x}') > 0 THEN stddev_samp(net) FILTER (regime = '{x}') END AS s_{x}" for x in M.NAMES) + """
 FROM labelled GROUP BY 1, 2, 3),
lim AS (SELECT p.*, b.n_obs, b.periods_per_year, b.sharpe_net, least(30, greatest(10, floor(0.2::DOUBLE * greatest(0, b.n_obs - 19))))::DOUBLE AS least_obs, (b.n_obs < 22 OR points < 10) AS early
 FROM per p JOIN base b ON b.cand_idx = p.cand_idx AND b.split = p.split AND b.fold IS NOT DISTINCT FROM p.fold),
three AS (SELECT *, """ + ", ".join(f"CASE WHEN NOT early AND n_{x} >= least_obs THEN s_{x} * sqrt(periods_per_year) END AS sharpe_regime_{x}_net, CASE WHEN early THEN 0 ELSE n_{x} END::DOUBLE AS regime_n_{x}" for x in M.NAMES) + """ FROM lim),
reg AS (SELECT *, least(sharpe_regime_low_net, sharpe_regime_mid_net, sharpe_regime_high_net) AS worst, greatest(sharpe_regime_low_net, sharpe_regime_mid_net, sharpe_regime_high_net) AS best FROM three),
regimes AS (SELECT *, 20.0::DOUBLE AS regime_window, 0.33::DOUBLE AS regime_q_low, 0.66::DOUBLE AS regime_q_high, least_obs AS regime_min_obs_per_regime, (early OR worst IS NULL)::INT::DOUBLE AS regime_used_fallback,
 CASE WHEN NOT early THEN q33 END AS regime_vol_q33, CASE WHEN NOT early THEN q66 END AS regime_vol_q66, coalesce(worst, sharpe_net) AS regime_worst_sharpe_net, coalesce(best, sharpe_net) AS regime_best_sharpe_net,
 CASE WHEN worst IS NULL THEN 0 ELSE best - worst END::DOUBLE AS regime_spread_sharpe_net, """ + ", ".join(f"regime_n_{x} / nullif(regime_n_low + regime_n_mid + regime_n_high, 0) AS regime_{x}_frac" for x in M.NAMES) + " FROM reg)"

#: The same with a bar for each event.
EVENT_SLICES = """bars AS (SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS row_idx, value + 1000 AS price, user_id % 11 / 5.0::DOUBLE - 1 AS f000, user_id % 7 / 3.0::DOUBLE - 1 AS f001, length(event_type) / 6.0::DOUBLE - 1 AS f002, event_id % 5 / 2.0::DOUBLE - 1 AS f003
 FROM (SELECT *, row_number() OVER (PARTITION BY ts ORDER BY event_id) AS i FROM events) WHERE i = 1 AND value IS NOT NULL),
n AS (SELECT count(*)::BIGINT AS n FROM bars),
firsts AS (SELECT i::INT AS fold, n // 2 + 5 + i * (n // 10) AS v, n // 10 AS w FROM range(3) AS r(i), n),
slices AS (SELECT fold, 'train' AS split, 0::BIGINT AS lo, (v - 5)::BIGINT AS hi FROM firsts UNION ALL SELECT fold, 'valid', v, v + w FROM firsts UNION ALL SELECT NULL, 'test', n - n // 10, n FROM n)"""


def _on_events(ctes: str) -> str:
    return ctes.replace(SLICES, EVENT_SLICES).replace("epoch(ts) - lag(epoch(ts)) OVER (PARTITION BY fold, split ORDER BY row_idx)", "(epoch_us(ts) - lag(epoch_us(ts)) OVER (PARTITION BY fold, split ORDER BY row_idx)) / 1e6")


def _pick(ctes: str, source: str, keep: list[str], names: list[str], digits: int = 6, where: str = "") -> str:
    return f"WITH {ctes}\nSELECT {', '.join([*keep, *[f'round({c}, {digits}) + 0.0::DOUBLE AS {c}' for c in names]])} FROM {source} {where}"


TRACKING = """experiments AS (SELECT c_custkey AS experiment_id, '2024-01-01T00:00:00Z' AS created_at, c_name AS run_name, 'light' AS mode, CASE WHEN c_custkey % 3 = 0 THEN 'dsr_net' ELSE 'sharpe_net' END AS selection_metric,
 CASE WHEN c_custkey % 4 = 0 THEN 'median' ELSE 'mean' END AS cv_agg, 'e' || c_custkey % 5 AS evaluation_hash, 'c' || c_custkey % 2 AS eval_code_hash, 'k' || c_custkey % 7 AS code_hash, 'table' AS data_type, c_mktsegment AS dataset_id, 'v1' AS dataset_version FROM customer),
runs AS (SELECT o_orderkey AS run_id, o_custkey AS experiment_id, ['train','valid','cv','test','exec'][o_orderkey % 5 + 1] AS split, CASE WHEN o_orderkey % 5 < 2 THEN (o_orderkey % 3)::INT END AS fold,
 CASE WHEN o_orderkey % 5 = 4 THEN '__experiment__' ELSE 'h' || o_custkey % 4 END AS strategy_hash, CASE WHEN o_orderstatus = 'F' THEN 'error' ELSE 'ok' END AS status FROM orders),
raws AS (SELECT l_orderkey AS run_id, ['sharpe_net','sharpe_net_per','n_obs','skew_net','dsr_trials','sharpe_net_valid_mean','kurt_net'][l_linenumber] AS key, l_quantity, l_discount FROM lineitem WHERE l_linenumber <= 7),
metrics AS (SELECT run_id, key, max(CASE WHEN l_quantity <= 45 THEN CASE key WHEN 'n_obs' THEN l_quantity + 30 WHEN 'dsr_trials' THEN l_quantity WHEN 'kurt_net' THEN 3 + l_discount ELSE l_discount - 0.05::DOUBLE END END) AS value FROM raws GROUP BY 1, 2),
artifacts AS (SELECT o_orderkey AS run_id, '{"candidates_unique":' || o_orderkey % 50 || '}' AS content FROM orders),
best AS (SELECT * FROM (SELECT o_custkey AS experiment_id, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)::INT AS rank, 'cv_score' AS score_key, o_totalprice / 1000 AS score_value, 'h' || o_custkey % 4 AS strategy_hash FROM orders) WHERE rank <= 3)"""


def _latest_sql(fold: str) -> str:
    return TRACKING + f""",
latest AS (SELECT experiment_id, strategy_hash, split, key, value FROM (SELECT r.*, m.key, m.value, row_number() OVER (PARTITION BY experiment_id, strategy_hash, split, key ORDER BY r.run_id DESC) AS i FROM runs r JOIN metrics m USING (run_id) WHERE status = 'ok' AND {fold}) WHERE i = 1)"""


CACHED = TRACKING + """,
cached AS (SELECT strategy_hash, split, fold, run_id, experiment_id FROM (SELECT r.*, row_number() OVER (PARTITION BY strategy_hash, split, fold ORDER BY run_id DESC) AS i FROM runs r JOIN experiments e USING (experiment_id)
 WHERE evaluation_hash = 'e1' AND eval_code_hash = 'c1' AND experiment_id <> 1 AND status = 'ok' AND split IN ('train', 'valid', 'test')) WHERE i = 1),
tasks AS (SELECT 'h' || i AS strategy_hash, j::INT AS fold FROM range(6) AS a(i), range(4) AS b(j)),
full_ AS (SELECT strategy_hash, fold FROM cached WHERE split IN ('train', 'valid') GROUP BY 1, 2 HAVING count(DISTINCT split) = 2)"""


def _board_sql(order: str) -> str:
    steps = ", ".join(f"({m}, {expected_best(m)!r}::DOUBLE)" for m in range(1, 101))
    return f"""WITH {_latest_sql('fold IS NULL')},
top AS (SELECT e.*, b.strategy_hash, b.score_value FROM experiments e JOIN best b ON b.experiment_id = e.experiment_id AND rank = 1 ORDER BY e.experiment_id DESC LIMIT 500),
wide AS (SELECT experiment_id, strategy_hash, max(value) FILTER (split = 'cv' AND key = 'dsr_trials') AS trials, max(value) FILTER (split = 'test' AND key = 'sharpe_net') AS sharpe_net, max(value) FILTER (split = 'test' AND key = 'sharpe_net_per') AS per,
 max(value) FILTER (split = 'test' AND key = 'n_obs') AS n_obs, max(value) FILTER (split = 'test' AND key = 'skew_net') AS skew, max(value) FILTER (split = 'test' AND key = 'kurt_net') AS kurt FROM latest GROUP BY 1, 2),
stats AS (SELECT experiment_id, (content::JSON ->> 'candidates_unique')::INT AS tried FROM (SELECT r.experiment_id, a.content, row_number() OVER (PARTITION BY r.experiment_id ORDER BY r.run_id DESC) AS i FROM runs r JOIN artifacts a USING (run_id) WHERE split = 'exec') WHERE i = 1),
j AS (SELECT t.*, t.selection_metric || '_valid_' || t.cv_agg AS cv_sel_key, greatest(1, coalesce(trunc(w.trials)::INT, s.tried, 1))::INT AS dsr_trials, w.sharpe_net, coalesce(w.per, w.sharpe_net / sqrt(252.0::DOUBLE)) AS per, w.n_obs, w.skew, w.kurt
 FROM top t LEFT JOIN wide w USING (experiment_id, strategy_hash) LEFT JOIN stats s USING (experiment_id)),
k AS (SELECT j.*, q.z AS shift, 1 - coalesce(skew, 0) * per + (coalesce(kurt, 3) - 1) / 4 * per * per AS term FROM j LEFT JOIN (VALUES {steps}) AS q(m, z) ON q.m = dsr_trials),
zz AS (SELECT *, CASE WHEN n_obs > 1 AND term > 0 THEN per / sqrt(term / (n_obs - 1)) - shift END AS z FROM k),
f AS (SELECT zz.*, c.value AS cv_sel_value, CASE WHEN selection_metric = 'dsr_net' THEN {normal_cdf_sql('z')} ELSE x.value END AS test_sel_value FROM zz
 LEFT JOIN latest c ON c.experiment_id = zz.experiment_id AND c.strategy_hash = zz.strategy_hash AND c.split = 'cv' AND c.key = zz.cv_sel_key
 LEFT JOIN latest x ON x.experiment_id = zz.experiment_id AND x.strategy_hash = zz.strategy_hash AND x.split = 'test' AND x.key = zz.selection_metric)
SELECT experiment_id, dataset_id, strategy_hash, selection_metric, cv_agg, cv_sel_key, dsr_trials, round(score_value, 6) AS score_value, round(cv_sel_value, 6) AS cv_sel_value, round(test_sel_value, 6) AS test_sel_value, round(sharpe_net, 6) AS test_sharpe_net
FROM f ORDER BY {order} DESC NULLS LAST, experiment_id DESC LIMIT 50"""


LOG = """lines AS (SELECT o_custkey AS experiment_id, l_orderkey AS run_id, l_linenumber::BIGINT AS seq, max(l_returnflag) AS flag, max(l_partkey) AS part, max(l_quantity) AS value FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2, 3),
commits AS (SELECT DISTINCT experiment_id, seq, (experiment_id + seq) % 5 = 0 AND seq = 3 AS base FROM lines WHERE (experiment_id + seq) % 7 <> 0),
valid AS (SELECT l.*, row_number() OVER (PARTITION BY l.experiment_id, run_id ORDER BY l.seq DESC) AS i, row_number() OVER (PARTITION BY l.experiment_id, run_id, l.seq > 1, part % 3 ORDER BY l.seq DESC) AS j FROM lines l JOIN commits c ON c.experiment_id = l.experiment_id AND c.seq = l.seq
 LEFT JOIN (SELECT experiment_id, max(seq) AS last FROM commits WHERE base GROUP BY 1) b ON b.experiment_id = l.experiment_id WHERE last IS NULL OR l.seq >= last)"""
ALL_REGIME = list(M.REFERENCE + M.REGIME)
REGIME_AND_BASE = REGIMES + ", whole AS (SELECT b.*, r.* EXCLUDE (cand_idx, fold, split, n_obs, periods_per_year, sharpe_net) FROM base b JOIN regimes r ON r.cand_idx = b.cand_idx AND r.split = b.split AND r.fold IS NOT DISTINCT FROM b.fold)"
KEYS = ["cand_idx", "fold", "split"]
EVENTS = "SELECT event_id, date_trunc('minute', ts) AS ts, value, user_id, event_type, row_number() OVER (PARTITION BY date_trunc('minute', ts) ORDER BY event_id) AS i FROM events"
ORACLES = {
    "bars_daily": _pick(BARS, "bars", ["ts", "row_idx"], ["price", "f000", "f001", "f002", "f003"]),
    "bars_last_n": _pick(BARS, "bars, n", ["ts"], ["price"], where="WHERE row_idx >= n - 100"),
    "bars_dedup_first": f"SELECT ts, event_id, value FROM ({EVENTS}) WHERE i = 1",
    "bars_dropna": "SELECT c_custkey, c_acctbal AS price, c_nationkey::DOUBLE AS f000 FROM customer WHERE c_acctbal >= 0 AND c_nationkey % 3 <> 0",
    "bars_normalised": f"WITH last AS (SELECT * FROM ({EVENTS}) WHERE i = 1 ORDER BY ts DESC LIMIT 500) SELECT ts, row_number() OVER (ORDER BY ts) - 1 AS row_idx, value + 1000 AS price, user_id::DOUBLE AS f000, length(event_type)::DOUBLE AS f001 FROM last WHERE user_id % 7 <> 0 AND value IS NOT NULL",
    "time_axis": "WITH h AS (SELECT date_trunc('hour', ts)::TIMESTAMP AS ts, count(*) AS n FROM events GROUP BY 1) SELECT a.ts, coalesce(h.n, 0) AS n FROM (SELECT unnest(generate_series((SELECT min(ts) FROM h), (SELECT max(ts) FROM h), interval 1 hour)) AS ts) a LEFT JOIN h ON h.ts = a.ts",
    "split_single": f"WITH {BARS}, c AS (SELECT n, floor(n * 0.6::DOUBLE)::BIGINT AS a, floor(n * (0.6::DOUBLE + 0.2::DOUBLE))::BIGINT AS b FROM n) SELECT 0::INT AS fold, 'train' AS split, 0::BIGINT AS lo, a - 5 AS hi FROM c UNION ALL SELECT 0, 'valid', a + 5, b - 5 FROM c UNION ALL SELECT NULL, 'test', b + 5, n FROM c",
    "slices_walk_forward": f"WITH {SLICES} SELECT fold, split, lo, hi FROM slices",
    "slice_membership": f"WITH {MARKET} SELECT fold, split, count(*) AS n, min(ts) AS first_ts, max(ts) AS last_ts, sum(row_idx)::BIGINT AS idx_sum FROM sliced GROUP BY 1, 2",
    "plan_meta": f"WITH {MARKET} SELECT s.fold, s.split, s.lo, s.hi, s.hi - s.lo AS rows, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS first_ts, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS last_ts FROM slices s JOIN bars b ON b.row_idx >= s.lo AND b.row_idx < s.hi GROUP BY 1, 2, 3, 4",
    "periods_per_year": _pick(MARKET, "ppys", ["fold", "split"], ["ppy"]),
    "signal_positions": f"WITH {SIGNAL} SELECT cand_idx, fold, split, ts, raw FROM signal",
    "exec_lag": _pick(_panel_sql(2), "panel", [*KEYS, "ts"], ["pos", "tov"]),
    "asset_returns": _pick(MARKET, "market", ["fold", "split", "ts"], ["ret"], 9),
    "turnover_costs": _pick(PANEL, "panel", [*KEYS, "ts"], ["tov", "tc", "slip", "borrow"], 9),
    "equity_curve": _pick(PANEL, "panel", [*KEYS, "ts"], ["net", "eq"], 8),
    "drawdown": f"WITH {PANEL} SELECT cand_idx, fold, split, ts, round(peak, 8) AS peak, round(eq / peak - 1, 8) + 0.0::DOUBLE AS dd FROM panel",
    "equity_head": f"WITH {PANEL}, r AS (SELECT *, row_number() OVER (PARTITION BY cand_idx, fold, split ORDER BY row_idx) AS i FROM panel) SELECT cand_idx, fold, split, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS t0, strftime(max(ts), '%Y-%m-%d %H:%M:%S') AS t1, round(max_by(eq, row_idx), 6) AS equity_end, count(*) FILTER (i <= 50) AS n, round(max_by(eq, row_idx) FILTER (i <= 50), 6) AS last_of_head FROM r GROUP BY 1, 2, 3",
    "rolling_vol": _pick(MARKET, "market", ["fold", "split", "ts"], ["vol"], 9),
    "regime_quantiles": _pick(MARKET, "facts", ["fold", "split", "n_vol", "ref_used", "ref_coverage"], ["vol_q33", "vol_q66"], 9),
    "base_metrics": _pick(METRICS, "base", KEYS, list(M.BASE)),
    "custom_strategy_pandas": _pick(CUSTOM, "base", KEYS, ["n_obs", "sharpe_net", "total_return", "exposure_mean"]),
    "regime_metrics": _pick(REGIMES, "regimes", KEYS, ALL_REGIME),
    "psr": _pick(METRICS, "base", KEYS, ["sharpe_net_per", "psr_net"]),
    "dsr": _pick(METRICS, "base", KEYS, ["dsr_net"]),
    "metrics_eav": f"WITH {METRICS} " + " UNION ALL ".join(f"SELECT cand_idx, fold, split, '{c}' AS key, round({c}, 6) AS value FROM base" for c in M.BASE),
    "fold_pairs": _pick(PAIRS, "pairs", ["cand_idx", "fold"], ["train", "valid"]),
    "cv_score": _pick(PAIRS, "scores", ["cand_idx", "cv_complete", "cv_n_folds_ok", "cv_n_folds_total"], ["cv_score", "valid_agg", "valid_std", "valid_min"]),
    "cv_score_dsr": f"WITH {METRICS}, p AS (SELECT cand_idx, fold, max(dsr_net) FILTER (split = 'train') AS train, max(dsr_net) FILTER (split = 'valid') AS valid FROM base WHERE split <> 'test' GROUP BY 1, 2), g AS (SELECT cand_idx, count(valid) = 4 AS done, avg(valid) AS v, avg(train) AS t, stddev_samp(valid) AS s FROM p GROUP BY 1) SELECT cand_idx, done::INT::DOUBLE AS cv_complete, round(CASE WHEN done THEN v - s END, 6) + 0.0::DOUBLE AS cv_score, round(CASE WHEN done THEN v END, 6) + 0.0::DOUBLE AS valid_agg, round(CASE WHEN done THEN t END, 6) + 0.0::DOUBLE AS train_agg FROM g",
    "cv_score_min": f"WITH {METRICS} SELECT cand_idx, round(min(total_return) FILTER (split = 'valid'), 6) + 0.0::DOUBLE AS cv_score, round(min(total_return) FILTER (split = 'train') - min(total_return) FILTER (split = 'valid'), 6) + 0.0::DOUBLE AS train_valid_gap FROM base GROUP BY 1",
    "aligned_positions": f"WITH {PANEL} SELECT cand_idx, fold, split, sum(CASE WHEN row_idx % 3 <> 0 THEN abs(raw) ELSE 0 END)::DOUBLE AS days_held FROM panel GROUP BY 1, 2, 3",
    "reference_returns": f"WITH {PANEL}, w AS (SELECT *, lag(pos) OVER (PARTITION BY cand_idx, fold, split ORDER BY row_idx) AS before FROM panel) SELECT cand_idx, fold, split, ts, round(CASE WHEN abs(before) > 1e-12 THEN gross / before END, 8) + 0.0::DOUBLE AS implied FROM w",
    "strategy_outcomes": "WITH " + CUSTOM + """, one AS (SELECT fold, split, count(*) AS n, sum(raw)::DOUBLE AS raw_sum FROM signal GROUP BY 1, 2)
SELECT i::INT AS cand_idx, fold, split, '' AS error, n, raw_sum FROM one, range(2) AS r(i) WHERE i = 0 OR fold IS DISTINCT FROM 2 UNION ALL SELECT 1, 2, '', 'RuntimeError: no positions', 0, 0""",
    "merged_runs": f"WITH {LOG} SELECT experiment_id, run_id, CASE WHEN seq = 1 THEN 'running' WHEN flag = 'R' THEN 'error' ELSE 'ok' END AS status, seq FROM valid WHERE i = 1",
    "merged_metrics": f"WITH {LOG} SELECT experiment_id, run_id, 'k' || part % 3 AS key, value, seq FROM valid WHERE seq > 1 AND j = 1",
    "source_digest": " UNION ALL ".join(f"SELECT '{t}' AS name, count(*) AS n, true AS same FROM {t}" for t in ("nation", "events", "orders")),
    "series_curve": _pick(_on_events(PANEL), "panel", [*KEYS, "row_idx"], ["pos", "net", "eq", "peak"]),
    "series_metrics": _pick(_on_events(REGIME_AND_BASE), "whole", KEYS, [c for c in M.ALL if c != "cagr"]),
    "series_quantiles": "SELECT event_type, count(value) AS n, " + ", ".join(f"round(quantile_cont(value, {q}), 9) AS q{i}" for i, q in enumerate((0.0, 0.25, 0.5, 0.99, 1.0))) + " FROM events GROUP BY 1",
    "run_artifact": f"WITH {TRACKING} SELECT content FROM artifacts WHERE run_id = (SELECT min(run_id) FROM artifacts)",
    "leaderboard_filtered": f"WITH {TRACKING} SELECT e.experiment_id, b.strategy_hash, round(b.score_value, 6) AS score_value FROM experiments e JOIN best b ON b.experiment_id = e.experiment_id AND rank = 1 WHERE dataset_id = 'MACHINERY' QUALIFY row_number() OVER (ORDER BY e.experiment_id DESC) <= 500 ORDER BY score_value DESC, e.experiment_id DESC LIMIT 10",
    "overfit_diag": _pick(PAIRS, "scores", ["cand_idx", "train_valid_n_pairs"], ["train_agg", "train_std", "train_min", "train_valid_gap", "train_gt_valid_frac", "train_valid_corr"]),
    "ranking_topk": _pick(PAIRS, "ranked", ["rank", "cand_idx"], ["score_value"]),
    "holdout_eval": _pick(PAIRS, "ranked JOIN base USING (cand_idx)", ["rank", "cand_idx"], ["n_obs", "sharpe_net", "total_return", "max_drawdown"], where="WHERE split = 'test'"),
    "candidates_distinct": "SELECT min(p_partkey) AS cand_idx, md5(p_brand || '|' || p_type) AS strategy_hash FROM part GROUP BY 2",
    "latest_metric": f"WITH {_latest_sql('true')} SELECT experiment_id, strategy_hash, split, key, round(value, 6) AS value FROM latest",
    "latest_metric_unfolded": f"WITH {_latest_sql('fold IS NULL')} SELECT experiment_id, strategy_hash, split, key, round(value, 6) AS value FROM latest",
    "latest_artifact": f"WITH {TRACKING} SELECT experiment_id, run_id, content FROM (SELECT r.experiment_id, r.run_id, a.content, row_number() OVER (PARTITION BY experiment_id ORDER BY r.run_id DESC) AS i FROM runs r JOIN artifacts a USING (run_id) WHERE split = 'exec' AND strategy_hash = '__experiment__') WHERE i = 1",
    "metrics_pivot": f"WITH {TRACKING} SELECT run_id, " + ", ".join(f"round(max(value) FILTER (key = '{k}'), 6) AS {k}" for k in ("sharpe_net", "n_obs", "skew_net")) + " FROM metrics GROUP BY 1",
    "run_metrics": f"WITH {TRACKING} SELECT key, round(value, 6) AS value FROM metrics WHERE run_id = (SELECT min(run_id) FROM metrics)",
    "best_candidates": f"WITH {TRACKING} SELECT experiment_id, rank, strategy_hash, round(score_value, 6) AS score_value FROM best WHERE score_value > 100",
    "cache_hits": f"WITH {CACHED} SELECT strategy_hash, fold FROM tasks WHERE (strategy_hash, fold) IN (SELECT (strategy_hash, fold) FROM full_)",
    "cache_misses": f"WITH {CACHED} SELECT strategy_hash, fold FROM tasks WHERE (strategy_hash, fold) NOT IN (SELECT (strategy_hash, fold) FROM full_)",
    "cached_runs": f"WITH {CACHED} SELECT strategy_hash, split, fold, run_id, experiment_id FROM cached",
    "union_results": f"WITH {CACHED} SELECT strategy_hash, split, fold, 1.0::DOUBLE AS cached FROM cached UNION ALL SELECT strategy_hash, split, fold, 0.0::DOUBLE FROM runs WHERE experiment_id = 1",
    "cache_diag": f"WITH {TRACKING} SELECT count(*) AS same_eval_experiments, count(*) FILTER (eval_code_hash = 'c1') AS same_eval_evalcode_experiments, count(*) FILTER (code_hash = 'k1') AS same_eval_fullcode_experiments, max(experiment_id) FILTER (eval_code_hash = 'c1') AS latest_same_eval_evalcode_experiment_id FROM experiments WHERE evaluation_hash = 'e1' AND experiment_id <> 1",
    "experiments_list": f"WITH {TRACKING} SELECT experiment_id, created_at, mode, run_name, data_type, dataset_id, dataset_version, selection_metric, cv_agg FROM experiments WHERE dataset_id = 'BUILDING' ORDER BY experiment_id DESC LIMIT 20",
    "leaderboard": _board_sql("score_value"),
    "leaderboard_by_test": _board_sql("test_sel_value"),
    "leaderboard_by_test_sharpe": _board_sql("sharpe_net"),
    "experiment_flow": f"""WITH {REGIMES},
p AS (SELECT cand_idx, median(regime_worst_sharpe_net) - 0.5::DOUBLE * stddev_samp(regime_worst_sharpe_net) AS score_value FROM regimes WHERE split = 'valid' GROUP BY 1 HAVING count(regime_worst_sharpe_net) = 4)
SELECT row_number() OVER (ORDER BY score_value DESC, p.cand_idx)::INT AS rank, p.cand_idx, round(score_value, 6) AS score_value, round(b.sharpe_net, 6) AS sharpe_net, round(b.total_return, 6) AS total_return, round(b.max_drawdown, 6) AS max_drawdown, round(r.regime_worst_sharpe_net, 6) AS regime_worst_sharpe_net
FROM p JOIN base b ON b.cand_idx = p.cand_idx AND b.split = 'test' JOIN regimes r ON r.cand_idx = p.cand_idx AND r.split = 'test'""",
}



def _whole_fold(query):
    """fold is -1 where there is none, so results have no nullable integers."""

    def run(spark, sf_dir):
        df = query(spark, sf_dir)
        return df.withColumn("fold", F.coalesce("fold", F.lit(-1))) if "fold" in df.columns else df

    run.__name__, run.__doc__ = query.__name__, query.__doc__
    return run


QUERIES = {f.__name__: _whole_fold(f) for f in (
    bars_daily, bars_last_n, bars_dedup_first, bars_dropna, bars_normalised, time_axis, synthetic_bars, split_single, slices_walk_forward, slice_membership, plan_meta, periods_per_year,
    signal_positions, exec_lag, asset_returns, turnover_costs, equity_curve, drawdown, equity_head, rolling_vol, regime_quantiles, base_metrics, regime_metrics, psr, dsr, metrics_eav,
    fold_pairs, cv_score, cv_score_dsr, cv_score_min, overfit_diag, series_curve, series_metrics, series_quantiles, aligned_positions, reference_returns, ranking_topk, holdout_eval, candidates_distinct, custom_strategy_pandas, strategy_outcomes, merged_runs, merged_metrics, source_digest, latest_metric, latest_metric_unfolded, latest_artifact, metrics_pivot,
    run_metrics, run_artifact, leaderboard_filtered, best_candidates, cache_hits, cache_misses, cached_runs, union_results, cache_diag, experiments_list, experiment_flow,
)} | {"leaderboard": _board("cv"), "leaderboard_by_test": _board("test"), "leaderboard_by_test_sharpe": _board("test_sharpe")}
#: Queries whose rows have a fold.
FOLDED = ("split_single", "slices_walk_forward", "slice_membership", "plan_meta", "periods_per_year", "signal_positions", "exec_lag", "asset_returns", "turnover_costs", "equity_curve", "drawdown", "equity_head", "rolling_vol", "regime_quantiles", "base_metrics", "custom_strategy_pandas", "regime_metrics", "psr", "dsr", "metrics_eav", "fold_pairs", "aligned_positions", "reference_returns", "series_curve", "series_metrics", "strategy_outcomes", "cache_hits", "cache_misses", "cached_runs", "union_results")
ORACLES |= {name: f"SELECT * REPLACE (coalesce(fold, -1)::INT AS fold) FROM ({ORACLES[name]}) AS q" for name in FOLDED}
