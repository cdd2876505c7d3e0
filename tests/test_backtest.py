import json
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.config import BacktestConfig, CostConfig, DataConfig, from_dict
from tickloom.operators import candidates as C
from tickloom.operators import metrics as M
from tickloom.operators import panel as P
from tickloom.operators import selection as S
from tickloom.operators.slices import Slice
from tickloom.plans.experiment import run_experiment
from tickloom.plans.reports import leaderboard, list_experiments, run_report
from tickloom.sources import bars as B
from tickloom.sources.store import RUNS_OF_ONE, SCHEMAS, Store, cached_runs

YEAR = 365.25


def golden(frame: pd.DataFrame, weights, threshold, run: BacktestConfig, costs: CostConfig) -> dict:
    """The formulas in numpy, for one slice of daily bars."""
    x = frame[[c for c in frame if c.startswith("f0")]].to_numpy() @ np.array(weights)
    raw = np.where(x > threshold, 1.0, np.where(x < -threshold, -1.0, 0.0))
    lag = run.execution_lag
    pos = (np.r_[np.zeros(min(lag, len(raw))), raw[: max(0, len(raw) - lag)]] if lag else raw) * run.leverage
    p = frame.price.to_numpy()
    ret = np.r_[0.0, p[1:] / p[:-1] - 1]
    tov = np.abs(np.diff(np.r_[0.0, pos]))
    cost = tov * (costs.tc_bps + costs.slippage_bps) / 1e4 + np.abs(pos) * costs.borrow_bps_annual / 1e4 / YEAR
    net, n = pos * ret - cost, len(p)
    eq = np.cumprod(1 + net)
    out = {"n_obs": n, "total_return": eq[-1] - 1, "max_drawdown": (eq / np.maximum.accumulate(eq) - 1).min(), "cost_sum": cost.sum(), "exposure_mean": pos.mean(), "avg_turnover": tov.mean(), "periods_per_year": YEAR}
    out["cagr"] = eq[-1] ** (YEAR / n) - 1
    sd = net.std(ddof=1)
    if sd > 0:
        z = (net - net.mean()) / sd
        out |= {"sharpe_net_per": net.mean() / sd, "sharpe_net": net.mean() / sd * math.sqrt(YEAR), "skew_net": (z**3).mean()} | ({"kurt_net": (z**4).mean()} if n >= 4 else {})
        out["hit_rate"] = (net > 0)[np.abs(pos) > 1e-12].mean()
    vol = pd.Series(ret).rolling(20).std(ddof=0).to_numpy()
    ok = np.isfinite(vol)
    if n >= 22 and ok.sum() >= 10:
        q1, q2 = np.quantile(vol[ok], [0.33, 0.66])
        low, high = ok & (vol <= q1), ok & (vol > q2)
        least, sharpes = min(30, max(10, int(0.2 * (n - 19)))), {}
        for name, mask in (("low", low), ("mid", ok & ~low & ~high), ("high", high)):
            out[f"regime_n_{name}"] = mask.sum()
            if mask.sum() >= least and net[mask].std(ddof=1) > 0:
                sharpes[name] = out[f"sharpe_regime_{name}_net"] = net[mask].mean() / net[mask].std(ddof=1) * math.sqrt(YEAR)
        out |= {"regime_vol_q33": q1, "regime_vol_q66": q2, "regime_min_obs_per_regime": least}
        if sharpes:
            out |= {"regime_worst_sharpe_net": min(sharpes.values()), "regime_spread_sharpe_net": max(sharpes.values()) - min(sharpes.values()), "regime_used_fallback": 0}
    return out


@pytest.mark.parametrize(("run", "rows"), [(BacktestConfig(), P.STRETCH_ROWS), (BacktestConfig(), 50), (BacktestConfig(execution_lag=0, leverage=2.0), 7), (BacktestConfig(execution_lag=3, leverage=0.5), 64), (BacktestConfig(execution_lag=25), 11)])
def test_metrics_against_numpy(spark, run, rows):
    """With slices in one stretch and in many, also in stretches shorter than their halo."""
    costs = CostConfig(borrow_bps_annual=80.0)
    bars = B.synthetic_bars(spark, DataConfig(n_rows=300, n_features=2), 5)
    specs = [C.StrategySpec(C.LINEAR, {"weights": [1.0, -0.5], "threshold": 0.2}), C.StrategySpec(C.LINEAR, {"weights": [0.1, 0.1], "threshold": 99.0})]
    slices = [Slice(0, "train", 0, 120), Slice(0, "valid", 100, 300), Slice(1, "valid", 7, 31), Slice(1, "train", 5, 26), Slice(None, "test", 290, 293)]
    got = M.fold_metrics(P.panel(bars, slices, C.candidate_table(spark, specs), run, costs, rows)).collect()
    assert len(got) == 10
    frame = bars.toPandas().sort_values("row_idx")
    for r in got:
        s = next(s for s in slices if (s.fold, s.split) == (r.fold, r.split))
        spec = specs[r.cand_idx].params
        want = golden(frame.iloc[s.lo : s.hi], spec["weights"], spec["threshold"], run, costs)
        for key, value in want.items():
            assert math.isclose(r[key], value, rel_tol=1e-8, abs_tol=1e-11), (key, r)
        for key in ("sharpe_net", "hit_rate", "skew_net"):
            assert (r[key] is None) == (key not in want)
        if s.rows < 29:
            assert r.regime_used_fallback == 1 and r.regime_worst_sharpe_net == r.sharpe_net
        assert not any(isinstance(v, float) and math.isnan(v) for v in r)


def test_constant_price_uses_own_results_for_regimes(spark):
    bars = B.synthetic_bars(spark, DataConfig(n_rows=80, n_features=1), 5).withColumn("price", F.lit(100.0))
    slices = [Slice(0, "valid", 0, 80)]
    table = C.candidate_table(spark, [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.1})])
    one, many = (M.regimes(M.derived(M.with_volatility(P.panel(bars, slices, table, BacktestConfig(), CostConfig(), rows), rows).withColumn("regime", M.regime_label()).groupBy(*P.KEY).agg(*M.base_aggregates(), *M.regime_aggregates()))).select(*P.KEY, *M.ALL).first() for rows in (P.STRETCH_ROWS, 9))
    facts = P.slice_facts(bars, slices)
    assert P.some_own(facts) and facts[0].n_vol == 61
    assert all(a == b or math.isclose(a, b, rel_tol=1e-9) for a, b in zip(one, many, strict=True))
    r = M.fold_metrics(P.panel(bars, slices, C.candidate_table(spark, [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.1})]), BacktestConfig(), CostConfig())).first()
    assert r.regime_ref_used == 0 and r.regime_ref_coverage == 1 and r.regime_n_low + r.regime_n_mid + r.regime_n_high == 61 and r.regime_vol_q33 > 0


def test_equity_that_turns_negative(spark):
    """Losses of more than everything: equity changes its sign, within stretches and between them."""
    bars = B.synthetic_bars(spark, DataConfig(n_rows=200, n_features=1), 5)
    specs = [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.1})]
    got = P.panel(bars, [Slice(0, "valid", 10, 200)], C.candidate_table(spark, specs), BacktestConfig(leverage=150.0), CostConfig(), 16).orderBy("row_idx").collect()
    eq = np.cumprod([1 + r.net for r in got])
    assert min(eq) < 0 < max(eq) and len(got) == 190
    assert np.allclose([r.eq for r in got], eq, rtol=1e-9) and np.allclose([r.peak for r in got], np.maximum.accumulate(eq), rtol=1e-9)
    head = P.equity_head(P.panel(bars, [Slice(0, "valid", 10, 200)], C.candidate_table(spark, specs), BacktestConfig(), CostConfig(), 16)).first()
    assert len(head.equity_head) == 50


def test_no_window_holds_a_slice(spark):
    """Every window over bars is partitioned by stretch; the scan of the stretches' carries has a row a stretch."""
    bars = B.synthetic_bars(spark, DataConfig(n_rows=200, n_features=1), 5)
    rows = P.panel(bars, [Slice(0, "valid", 10, 200)], C.candidate_table(spark, [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.1})]), BacktestConfig(), CostConfig(), 16)
    plan = M.fold_metrics(rows)._jdf.queryExecution().optimizedPlan().toString()
    windows = [line for line in plan.splitlines() if "Window [" in line and "row_idx" in line]
    assert windows and all("stretch" in line for line in windows)
    assert "percentile" not in plan and P.carries(P.local_results(P.signals(P.market(bars, [Slice(0, "valid", 10, 200)], 1, 16), C.candidate_table(spark, [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.1})])), BacktestConfig(), CostConfig())).count() == 13


def test_exact_quantiles(spark):
    from tickloom.functions.quantiles import exact_quantiles, from_order_bits, order_bits

    rng = np.random.default_rng(1)
    odd = [0.0, -0.0, 5e-324, -5e-324, 2.2250738585072014e-308, 1.7976931348623157e308, -1.7976931348623157e308, 1.0, np.nextafter(1, 2), np.nextafter(1, 0), 2.0, 4.0, 8.0, -3.5, 1e-310]
    groups = {"odd": odd, "normal": rng.normal(size=500), "scales": 10.0 ** rng.uniform(-300, 300, 400) * rng.choice([-1, 1], 400), "close": 1 + rng.integers(0, 50, 300) * 2.0**-52, "same": [3.25] * 40, "one": [7.0], "two": [1.0, 2.0]}
    df = spark.createDataFrame([(k, float(x)) for k, v in groups.items() for x in v] + [("normal", None), ("normal", float("nan")), ("normal", float("inf")), ("none", None)], "k string, x double")
    bits = df.where("x is not null and not isnan(x) and x <> double('inf')").select("x", order_bits(F.col("x")).alias("b")).withColumn("y", from_order_bits(F.col("b"))).collect()
    assert all(r.x == r.y for r in bits)
    ordered = sorted(bits, key=lambda r: r.x)
    assert all((a.b < b.b) == (a.x < b.x) for a, b in zip(ordered, ordered[1:], strict=False))
    shares = [0.0, 0.33, 0.5, 0.66, 1.0]
    got = {r.k: r for r in exact_quantiles(df, ["k"], F.col("x"), shares).collect()}
    assert set(got) == set(groups)
    for k, v in groups.items():
        v = np.sort(np.array(v, float))
        for i, q in enumerate(shares):
            at = q * (len(v) - 1)
            lo, hi = v[math.floor(at)], v[math.ceil(at)]
            assert math.isclose(got[k][f"q{i}"], lo + (hi - lo) * (at - math.floor(at)), rel_tol=1e-12, abs_tol=0), (k, q)
        assert got[k].n == len(v)


def test_quantiles_of_few_keys_leave_the_rows_in_place(spark):
    from tickloom.functions.quantiles import exact_quantiles

    df = spark.range(2000).select((F.col("id") % 3).alias("k"), (F.col("id") * 0.37 % 1).alias("x"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)  # as if the tables were large
    try:
        rows = exact_quantiles(df, ["k"], F.col("x"), [0.2, 0.5], few=True)
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin" not in plan and "BroadcastHashJoin" in plan
        assert sorted(rows.collect()) == sorted(exact_quantiles(df, ["k"], F.col("x"), [0.2, 0.5]).collect())
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)


def test_positions_know_nothing_of_later_rows(spark):
    bars = B.synthetic_bars(spark, DataConfig(n_rows=60, n_features=1), 2)
    changed = bars.withColumn("f000", F.when(F.col("row_idx") >= 40, -5.0).otherwise(F.col("f000")))
    table = C.candidate_table(spark, [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.0})])
    of = lambda b: {r.row_idx: r.pos for r in P.panel(b, [Slice(0, "valid", 0, 60)], table, BacktestConfig(), CostConfig()).collect()}
    one, two = of(bars), of(changed)
    assert all(one[i] == two[i] for i in range(41)) and one != two


def test_scores_and_ranking(spark):
    rows = [(0, "a", f, t, v) for f, (t, v) in enumerate([(1.0, 2.0), (3.0, 1.0), (2.0, 3.0)])] + [(1, "b", 0, 1.0, None), (1, "b", 1, 1.0, 9.0), (1, "b", 2, 1.0, 9.0)] + [(2, "c", f, 1.0, 2.0) for f in range(3)] + [(3, "d", f, None, 2.0) for f in range(3)]
    pairs = spark.createDataFrame([(i, h, "n", f, t, v) for i, h, f, t, v in rows], "cand_idx int, strategy_hash string, strategy_name string, fold int, train double, valid double")
    got = {r.strategy_hash: r for r in S.cv_scores(pairs, 3, "median", 0.5).collect()}
    a, b, c, d = (got[x] for x in "abcd")
    assert math.isclose(a.cv_score, 2 - 0.5 * 1) and math.isclose(a.train_gt_valid_frac, 1 / 3) and math.isclose(a.train_valid_corr, np.corrcoef([1, 3, 2], [2, 1, 3])[0, 1])
    assert b.cv_score is None and b.cv_complete == 0 and b.cv_n_folds_ok == 2 and c.train_valid_corr is None and d.train_agg is None and d.train_valid_n_pairs == 0
    assert [(r.rank, r.strategy_hash) for r in S.ranking(S.cv_scores(pairs, 3, "median", 0.5), 2).collect()] == [(1, "c"), (2, "d")]
    assert S.cv_scores(pairs.where("fold = 0"), 1, "mean", 0.5).where("strategy_hash = 'a'").first().valid_std == 0


def test_candidates(spark):
    specs = C.generate("linear_random_v1", 20, 6, 42)
    assert specs == C.generate("linear_random_v1", 60, 6, 42)[:20]
    assert all(math.isclose(np.linalg.norm(s.params["weights"]), 1, rel_tol=1e-9) and s.params["threshold"] >= 0 for s in specs)
    assert C.unique([*specs, *specs]) == specs
    with pytest.raises(ValueError):
        C.generate("none", 1, 1, 1)
    with pytest.raises(ValueError):
        C.signal_for("none", [])


BASE = {"data": {"n_rows": 400}, "splits": {"embargo_rows": 2}, "cv": {"method": "walk_forward"}, "research": {"n_candidates": 6, "top_k": 2}}


def test_experiment_store_and_cache(spark, tmp_path):
    path = str(tmp_path / "store")
    one = run_experiment(spark, from_dict(BASE), path)
    two = run_experiment(spark, from_dict(BASE | {"run_name": "again", "research": {"n_candidates": 6, "top_k": 2, "selection_metric": "dsr_net"}}), path)
    tables = Store(spark, path).tables()
    runs = tables.runs.toPandas()
    assert runs.groupby("experiment_id").size().tolist() == [2 + 36 + 6 + 2] * 2 and runs.run_id.is_unique
    assert runs[runs.experiment_id == one].split.value_counts().to_dict() == {"train": 18, "valid": 18, "cv": 6, "test": 2, "meta": 1, "exec": 1}
    stats = {r.experiment_id: json.loads(r.content) for r in tables.artifacts.where("name = 'exec_stats'").collect()}
    assert stats[one]["fold_tasks_executed"] == 18 and stats[two]["fold_tasks_executed"] == 0 and stats[two]["mode"] == "cache"
    same = tables.metrics.where("key = 'sharpe_net'").join(tables.runs.select("run_id", "strategy_hash", "split", "fold"), "run_id").where("split in ('train', 'valid')").groupBy("strategy_hash", "split", "fold").agg(F.count_distinct("value").alias("n"), F.count("*").alias("m")).collect()
    assert len(same) == 36 and all((r.n, r.m) == (1, 2) for r in same)
    assert tables.artifacts.where(f"experiment_id = {two} and name = 'cache_info'").count() >= 36
    head = json.loads(tables.artifacts.where("name = 'equity_curve_head'").first().content)
    assert len(head["equity_head"]) == 50 and set(head) == {"t0", "t1", "equity_end", "equity_head"}
    board = leaderboard(tables, sort_by="test").collect()
    assert {r.experiment_id for r in board} == {one, two} and all(r.dsr_trials == 6 and r.cv_sel_value is not None for r in board)
    assert [r.experiment_id for r in list_experiments(tables.experiments, with_config=True).collect()] == [two, one]
    lines = run_report(tables, two, 2)
    assert lines[0] == f"experiment_id={two}" and sum(x.startswith("#") for x in lines) == 2 and any("fold_skipped=18/18" in x for x in lines)
    assert runs.run_id.min() // RUNS_OF_ONE == one and set(runs.status) == {"ok"}


def test_a_run_counts_as_a_whole_or_not_at_all(spark, tmp_path, monkeypatch):
    """A failure between the tables of a write leaves no results and no cache hit; a killed run stays running, a failed one is an error."""
    path, cfg = str(tmp_path / "store"), from_dict(BASE)
    write = Store.write

    def broken(self, name, df, experiment_id, seq):
        if name == "artifacts":
            raise KeyboardInterrupt("killed")
        write(self, name, df, experiment_id, seq)

    monkeypatch.setattr(Store, "write", broken)
    with pytest.raises(KeyboardInterrupt):
        run_experiment(spark, cfg, path)
    monkeypatch.undo()
    store = Store(spark, path)
    tables = store.tables()
    exp = tables.experiments.first()
    assert {r.status for r in tables.runs.collect()} == {"running"} and tables.runs.count() == 2 + 36
    assert tables.metrics.count() == 0 and store.log("metrics").count() > 0
    assert cached_runs(tables, exp.evaluation_hash, exp.eval_code_hash).count() == 0
    monkeypatch.setattr("tickloom.plans.experiment.fold_metrics", lambda *a, **k: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        run_experiment(spark, cfg, path)
    monkeypatch.undo()
    second = store.tables().runs.where("experiment_id = 2").collect()
    assert {(r.status, r.error) for r in second} == {("error", "ZeroDivisionError: division by zero")} and len(second) == 38


def test_the_log_of_a_store(spark, tmp_path):
    store = Store(spark, str(tmp_path / "s"))
    assert store.tables().runs.count() == 0
    one, two = store.create_experiment({"run_name": "a"}), Store(spark, str(tmp_path / "s")).create_experiment({"run_name": "b"})
    assert (one, two) == (1, 2)
    # two writers at once: both see id 3 as free, one of them gets it
    assert store._create(f"{store.path}/claims/3") and not store._create(f"{store.path}/claims/3") and store.create_experiment({}) == 4
    run = lambda status, i=7: spark.createDataFrame([(i, "valid", status)], "run_id long, split string, status string").withColumns({c: F.lit(None).cast(t) for c, t in (("created_at", "string"), ("fold", "int"), ("strategy_name", "string"), ("strategy_json", "string"), ("strategy_hash", "string"), ("error", "string"), ("elapsed_ms", "long"))})
    values = lambda **v: spark.createDataFrame([(7, k, x) for k, x in v.items()], "run_id long, key string, value double")
    state = lambda: ([(r.run_id, r.status) for r in store.read("runs").orderBy("run_id").collect()], {r.key: r.value for r in store.read("metrics").collect()})
    store.start_runs(one, run("running"))
    assert state() == ([(7, "running")], {})
    store.finish_runs(one, run("ok"), metrics=values(a=1.0, b=2.0))
    store.finish_runs(one, run("ok"), metrics=values(a=5.0))
    assert state() == ([(7, "ok")], {"a": 5.0, "b": 2.0})
    lost = store.next_seq(one)  # a writer that dies before its commit
    store.write("metrics", values(a=9.0), one, lost)
    store.start_runs(two, run("running", 8))
    assert state() == ([(7, "ok"), (8, "running")], {"a": 5.0, "b": 2.0})
    store.compact(one)
    assert state() == ([(7, "ok"), (8, "running")], {"a": 5.0, "b": 2.0})
    assert store.read("metrics").where("experiment_id = 1").count() == 2 and store.log("metrics").count() == 6
    store.finish_runs(one, run("error"), metrics=values(b=0.0))
    assert state() == ([(7, "error"), (8, "running")], {"a": 5.0, "b": 0.0})


def test_lookups_read_few_files(spark, tmp_path):
    """A lookup in one of forty experiments opens the files of that one."""
    store = Store(spark, str(tmp_path / "s"))
    ids = spark.range(1, 41).withColumnRenamed("id", "experiment_id").withColumn("seq", F.lit(1).cast("long"))
    run = ids.selectExpr("experiment_id", "seq", "experiment_id * 4294967296 run_id", "'x' created_at", "'valid' split", "0 fold", "'n' strategy_name", "'{}' strategy_json", "'h' strategy_hash", "'ok' status", "cast(null as string) error", "1L elapsed_ms")
    value = ids.selectExpr("experiment_id", "seq", "experiment_id * 4294967296 run_id", "'sharpe_net' key", "double(experiment_id) value")
    store._write("runs", run, store.path)
    store._write("metrics", value, store.path)
    for i in range(1, 41):
        store.commit(i, 1)
    from tickloom.sources.store import latest_metrics

    found = latest_metrics(store.read("runs").where("experiment_id = 7"), store.read("metrics"))
    assert [r.value for r in found.collect()] == [7.0]
    plan = found._jdf.queryExecution().executedPlan()

    def scans(node):
        children = [node.children().apply(i) for i in range(node.children().size())]
        for name in ("executedPlan", "plan"):
            if "Adaptive" in node.nodeName() or "QueryStage" in node.nodeName():
                try:
                    children.append(getattr(node, name)())
                except Exception:
                    continue
        own = [node.metrics().apply("numFiles").value()] if "Scan parquet" in node.nodeName() else []
        return own + [x for c in children for x in scans(c)]

    files = scans(plan)
    assert len(files) >= 2 and max(files) <= 4, files


def test_a_store_of_the_layout_before_is_taken_over(spark, tmp_path):
    """Opening it copies it once and fills in what older rows lack."""
    path = str(tmp_path / "s")
    one = run_experiment(spark, from_dict(BASE), str(tmp_path / "new"))
    tables = Store(spark, str(tmp_path / "new")).tables()
    old = tables.experiments.withColumns({c: F.lit("") for c in ("eval_code_hash", "dataset_id", "data_type")})
    for name, df in zip(SCHEMAS, (old, *tables[1:]), strict=True):
        df.write.partitionBy(*(["experiment_id"] if name != "experiments" else [])).parquet(f"{path}/{name}")
    for _ in range(2):
        store = Store(spark, path)
        exp = store.tables().experiments.first()
        assert (exp.experiment_id, exp.dataset_id, exp.data_type, exp.eval_code_hash) == (one, "synthetic", "synthetic", exp.code_hash)
        assert all(getattr(store.tables(), t).count() == getattr(tables, t).count() > 0 for t in SCHEMAS)
    assert store.create_experiment({}) == one + 1


def test_a_faulty_candidate_fails_alone(spark, tmp_path, monkeypatch):
    from tickloom.operators import candidates as C

    good = list(C.linear_random(2, DataConfig().n_features, np.random.default_rng(1)))
    bad = [C.StrategySpec(C.LINEAR, {"weights": [1.0], "threshold": 0.0}), C.StrategySpec("unknown", {})]
    monkeypatch.setitem(C.GENERATORS, "given", lambda n, k, rng: [bad[0], *good, bad[1]])
    cfg = from_dict(BASE | {"research": {"generator": "given", "n_candidates": 4, "top_k": 2}})
    number = run_experiment(spark, cfg, str(tmp_path / "store"))
    runs = Store(spark, str(tmp_path / "store")).tables().runs.where(f"experiment_id = {number}").toPandas()
    failed = runs[runs.status == "error"]
    assert set(failed.strategy_hash) == {s.spec_hash() for s in bad} and runs.run_id.is_unique
    assert set(failed.error) == {f"1 weights for {cfg.data.n_features} features", "no strategy unknown"}
    assert set(failed.split) == {"train", "valid"} and len(runs[(runs.split == "valid") & (runs.status == "ok")]) == 2 * cfg.cv.n_folds


def middle_rule(params):
    """Long where the first feature exceeds a quantile of its train rows; told to fail, it raises in one fold."""

    class Rule(C.Strategy):
        def fit(self, train):
            self.rows, self.middle = len(train), train["f000"].quantile(params["share"])
            return self

        def positions(self, frame):
            if params.get("fails_at") == self.rows and frame["split"].iloc[0] == "valid":
                raise RuntimeError("no positions")
            return np.where(frame["f000"] > self.middle, 1.0, -1.0)

    return Rule()


def test_any_strategy_in_a_run(spark, tmp_path, monkeypatch):
    """Native and pandas candidates in one run; one that raises is an error for its fold, the others finish and are tested."""
    k = DataConfig().n_features
    specs = [next(iter(C.linear_random(1, k, np.random.default_rng(1)))), C.StrategySpec("middle", {"share": 0.5}), C.StrategySpec("middle", {"share": 0.7, "fails_at": 170})]
    monkeypatch.setitem(C.GENERATORS, "given", lambda n, k, rng: specs)
    monkeypatch.setitem(C.PANDAS, "middle", middle_rule)
    cfg = from_dict(BASE | {"research": {"generator": "given", "n_candidates": 3, "top_k": 3}})
    path = str(tmp_path / "store")
    number = run_experiment(spark, cfg, path)
    tables = Store(spark, path).tables()
    runs = tables.runs.toPandas()
    failed = runs[(runs.status == "error") & (runs.split != "cv")]
    assert sorted(zip(failed.split, failed.fold, failed.error, failed.strategy_hash, strict=True)) == [(s, 1.0, "RuntimeError: no positions", specs[2].spec_hash()) for s in ("train", "valid")]
    assert set(runs[runs.split == "test"].strategy_hash) == {s.spec_hash() for s in specs[:2]} and (runs[runs.split == "cv"].status == "error").sum() == 1
    assert len(runs[(runs.split == "valid") & (runs.status == "ok")]) == 8 and "running" not in set(runs.status)
    # the holdout's positions by numpy: fitted on the rows before the gap
    frame = B.synthetic_bars(spark, cfg.data, cfg.seed).toPandas().sort_values("row_idx")
    middle = frame.f000[:318].quantile(0.5)
    raw = np.where(frame.f000[320:] > middle, 1.0, -1.0)
    pos = np.r_[0.0, raw[:-1]]
    ret = np.r_[0.0, frame.price[320:].to_numpy()[1:] / frame.price[320:].to_numpy()[:-1] - 1]
    net = pos * ret - np.abs(np.diff(np.r_[0.0, pos])) * 3e-4
    run = runs[(runs.split == "test") & (runs.strategy_hash == specs[1].spec_hash())].run_id.iloc[0]
    got = {r.key: r.value for r in tables.metrics.where(f"run_id = {run}").collect()}
    assert math.isclose(got["net_sum"], net.sum(), rel_tol=1e-9) and math.isclose(got["total_return"], np.prod(1 + net) - 1, rel_tol=1e-9)
    assert number == 1


def test_custom_strategy(spark):
    from tickloom.queries import custom_strategy_pandas

    got = custom_strategy_pandas(spark, "/root/testdata/sf0.001").collect()
    assert len(got) == 9 and all(abs(r.exposure_mean) <= 0.1 for r in got)


def test_entry(spark):
    import __spark_entry__ as e

    names = e.queries()
    assert set(e.oracle_sql()) <= set(names) and len(names) >= 49
    assert e.entry(spark).count() == 3
