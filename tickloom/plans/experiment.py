"""One experiment: load bars, plan slices, evaluate what isn't cached, score, rank, test on the holdout, store."""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tickloom import identity
from tickloom.config import EngineConfig
from tickloom.operators import candidates as C
from tickloom.operators import panel as P
from tickloom.operators import selection as S
from tickloom.operators.metrics import ALL, fold_metrics, to_long
from tickloom.operators.slices import Plan, assign, build_plan, plan_meta
from tickloom.sources.bars import check_bars, features_of, load_bars
from tickloom.sources.store import EXPERIMENT, RUNS_OF_ONE, Store, Tables, cached_runs, split_by_cache
from tickloom.workers import send_package

SIDES = ("train", "valid")


#: What evaluating gives for each candidate and slice; error is null but for a task that failed, and then the rest is.
RESULT = [*P.KEY, *ALL, "content", "error", "elapsed_ms"]


def evaluate(bars: DataFrame, plan: Plan, candidates: DataFrame, cfg: EngineConfig, splits: tuple[str, ...], settle: Callable[[DataFrame, str], DataFrame], only: DataFrame | None = None, in_pandas: Sequence[str] = ()) -> DataFrame:
    """RESULT of candidates on the slices of some splits; only: (strategy_hash, fold) to keep; in_pandas: names of theirs that aren't native."""
    slices = [s for s in plan.slices if s.split in splits]
    if only is not None:
        candidates = candidates.join(F.broadcast(only.select("strategy_hash").distinct()), "strategy_hash", "left_semi")  # before the market is copied
    facts = P.slice_facts(bars, slices)
    market = P.market(bars, slices, cfg.backtest.execution_lag, facts=facts)
    head = P.head_aggregates()

    def results(raw: DataFrame, elapsed: Column) -> DataFrame:
        also = head | {"elapsed_ms": elapsed}
        values = fold_metrics(P.backtest(raw, cfg.backtest, cfg.costs), some_own=P.some_own(facts), also=also)
        return values.withColumns({"content": F.to_json(F.struct(*head)), "error": F.lit(None).cast("string")}).select(*RESULT)

    raw = P.signals(market, candidates)
    if only is not None:
        raw = raw.join(F.broadcast(only.select("strategy_hash", "fold")), ["strategy_hash", "fold"], "left_semi")  # candidates x folds
    out = results(raw, F.max(F.lit(None).cast("long")))
    own = [n for n in in_pandas if n in C.PANDAS]
    if not own:
        return out
    chosen = candidates.where(F.col("strategy_name").isin(own))
    fitting = plan.holdout_train if "test" in splits else []
    send_package(bars.sparkSession)
    found = settle(C.pandas_outcomes(assign(bars, [*slices, *fitting]).drop("slice_lo"), chosen, {n: C.PANDAS[n] for n in own}, only), f"positions-{'-'.join(splits)}")
    failed = found.where(F.col("error").isNotNull())
    done = found.where(F.col("error").isNull()).groupBy(*P.KEY[:4], "fold").agg(F.max("elapsed_ms").alias("_elapsed"))
    rows = P.null_safe_join(market.drop(*features_of(market)), done, ["fold"])  # the candidates that have positions in the slice's fold
    raw = P.aligned(rows, found.where(F.col("error").isNull())).repartition(*P.PLACE)
    wrong = failed.drop("split").withColumn("split", F.explode(F.array(*map(F.lit, splits))))
    nothing = {c: F.lit(None).cast("double") for c in ALL} | {"content": F.lit(None).cast("string")}
    return out.unionByName(results(raw, F.max("_elapsed"))).unionByName(wrong.withColumns(nothing).select(*RESULT))


def from_cache(tables: Tables, cached: DataFrame, keep: DataFrame, on: list[str]) -> DataFrame:
    """Metrics (wide), content and cache_info of cached runs whose on columns are in keep."""
    runs = cached.join(keep, on, "left_semi")
    info = F.to_json(F.struct(F.lit(True).alias("cached"), "run_id", "experiment_id"))
    known = runs.withColumn("cache_info", info).withColumnRenamed("experiment_id", "_of")
    own = ["_of", "run_id"]
    values = known.join(tables.metrics.select(F.col("experiment_id").alias("_of"), "run_id", "key", "value"), own)
    wide = values.groupBy(*own, "strategy_hash", "fold", "split", "cache_info").pivot("key", list(ALL)).agg(F.first("value"))
    heads = tables.artifacts.where(F.col("name") == "equity_curve_head").select(F.col("experiment_id").alias("_of"), "run_id", "content")
    return wide.join(heads, own, "left").drop(*own)


def run_experiment(spark: SparkSession, cfg: EngineConfig, path: str | None = None) -> int:
    """Runs and stores an experiment; returns its id.

    Runs are stored as running when it is known which will be computed. Results of all tables count from one commit on;
    where the work fails its runs become errors, and where it is killed they stay running.
    """
    store = Store(spark, path or cfg.persistence.db_path)
    source = identity.source_of(spark, cfg.data, cfg.seed)
    raw = identity.plain(cfg)
    hashes = {"evaluation_hash": identity.evaluation_hash(raw, source), "eval_code_hash": identity.evaluation_code_hash(C.PANDAS), "config_hash": cfg.config_hash(), "code_hash": identity.code_hash()}
    prints = source.record()
    row = {"created_at": identity.now_utc(), "run_name": cfg.run_name, "mode": cfg.mode, "config_json": identity.canonical_json(raw), "data_type": source.kind, "dataset_id": source.name, "dataset_version": source.version, "data_fp_hash": prints["digest"]}
    exp = store.create_experiment(row | hashes | identity.environment())
    try:
        _run(store, exp, cfg, hashes, prints)
    except Exception as failure:
        store.fail_running(exp, f"{type(failure).__name__}: {failure}"[:1000])
        raise
    return exp


def _run(store: Store, exp: int, cfg: EngineConfig, hashes: dict, prints: dict) -> None:
    began = time.perf_counter()
    spark, research, tables = store.spark, cfg.research, store.tables()
    base = exp * RUNS_OF_ONE
    store.start_runs(exp, experiment_runs(spark, base))

    bars = load_bars(spark, cfg.data, cfg.seed).persist()
    check_bars(bars)
    plan = build_plan(bars.count(), cfg.splits, cfg.cv)
    generated = C.generate(research.generator, research.n_candidates, cfg.data.n_features, cfg.seed)
    faults = [(s, C.fault(s, cfg.data.n_features)) for s in C.unique(generated)]
    specs, faults = [s for s, why in faults if why is None], [(s, why) for s, why in faults if why]
    if not specs:
        raise ValueError(f"no candidate can be evaluated: {faults[0][1] if faults else 'none was generated'}")
    n, folds, trials = len(specs), plan.n_folds, max(1, len(specs))
    candidates = C.candidate_table(spark, specs).persist()

    cached = cached_runs(tables, hashes["evaluation_hash"], hashes["eval_code_hash"], exp).persist()
    tasks = candidates.select("strategy_hash", F.explode(F.sequence(F.lit(0), F.lit(folds - 1))).alias("fold"))
    hits, misses = (x.persist() for x in split_by_cache(tasks, cached))
    n_hits, n_misses = hits.count(), misses.count()
    first_cv = base + 2 + 2 * n * folds
    numbered = Numbers(base, folds, first_cv, first_cv + n)
    open_ = misses.join(candidates, "strategy_hash").select("cand_idx", "strategy_hash", "strategy_name", "strategy_json", "fold", F.explode(F.array(*map(F.lit, SIDES))).alias("split"))
    store.start_runs(exp, open_.withColumns({"run_id": numbered.fold(), "created_at": F.lit(identity.now_utc())}))
    settle = lambda df, name: store.settled(df, f"{exp}/{name}")
    in_pandas = sorted({s.name for s in specs} & set(C.PANDAS))
    compute = lambda of, splits, only=None: evaluate(bars, plan, of, cfg, splits, settle, only, in_pandas)
    metrics = settle(gathered(compute, candidates, tables, cached.where(F.col("split").isin(*SIDES)), hits, misses if n_misses else None, bool(n_hits), SIDES), "folds")

    scores = S.score(metrics, folds, research, trials).persist()
    ranked = S.ranking(scores, research.top_k).persist()
    best = ranked.count()
    tested = None
    test_hits = 0
    if plan.has_holdout and best:
        chosen = candidates.join(F.broadcast(ranked.select("strategy_hash")), "strategy_hash", "left_semi")
        old = cached.where(F.col("split") == "test")
        test_hit = chosen.join(old, "strategy_hash", "left_semi").persist()
        test_hits = test_hit.count()
        left = chosen.join(old.select("strategy_hash"), "strategy_hash", "left_anti")
        tested = settle(gathered(compute, left, tables, old, test_hit.select("strategy_hash"), None, bool(test_hits), ("test",), test_hits < best, candidates), "holdout")

    stats = {
        "mode": "cache" if n_misses == 0 and n_hits else "spark", "requested_n_jobs": cfg.execution.n_jobs, "prefer_processes": cfg.execution.prefer_processes,
        "n_jobs_used": spark.sparkContext.defaultParallelism if n_misses else 0, "n_tasks_executed": n_misses, "had_fallback": False, "fallback_reason": None,
        "candidates_generated": len(generated), "candidates_unique": n, "fold_tasks_total": n * folds, "fold_tasks_executed": n_misses, "fold_tasks_skipped": n_hits,
        "test_tasks_total": best if plan.has_holdout else 0, "test_tasks_executed": best - test_hits if tested is not None else 0, "test_tasks_skipped": test_hits, "cache_key": hashes,
    }
    meta = [r.asDict() for r in plan_meta(bars, plan).orderBy("lo", "hi").collect()]  # a row for each slice
    fixed = fixed_rows(plan, stats, prints, {"method": plan.method, "n_rows": plan.n_rows, "slices": meta})
    write_results(store, exp, numbered, candidates, metrics, scores, ranked, tested, fixed, cfg, folds, trials, int((time.perf_counter() - began) * 1000), faults)
    for df in (bars, candidates, cached, hits, misses, scores, ranked):
        df.unpersist()
    store.drop_settled(str(exp))


RUN = "run_id long, split string, fold int, strategy_name string, strategy_json string, strategy_hash string, status string, error string, elapsed_ms long"


def experiment_runs(spark: SparkSession, base: int) -> DataFrame:
    """The two runs of an experiment that belong to no candidate, while they go on."""
    rows = [(base + i, split, None, EXPERIMENT, "{}", EXPERIMENT, "running", None, None) for i, split in enumerate(("meta", "exec"))]
    return spark.createDataFrame(rows, RUN).withColumn("created_at", F.lit(identity.now_utc()))


def gathered(compute, candidates, tables, cached, hits, only, any_hit, splits, any_miss=None, every=None) -> DataFrame:
    """Computed and cached results together: RESULT, cached and cache_info."""
    any_miss = only is not None if any_miss is None else any_miss
    columns, parts = [*RESULT, "cached", "cache_info"], []
    if any_miss:
        parts.append(compute(candidates, splits, only).withColumns({"cached": F.lit(0.0), "cache_info": F.lit(None).cast("string")}).select(*columns))
    if any_hit:
        values = from_cache(tables, cached, hits, [c for c in hits.columns if c in ("strategy_hash", "fold")])
        names = (every if every is not None else candidates).select("cand_block", "cand_idx", "strategy_hash", "strategy_name")
        values = values.withColumns({"cached": F.lit(1.0), "error": F.lit(None).cast("string"), "elapsed_ms": F.lit(0).cast("long")})
        parts.append(values.join(F.broadcast(names), "strategy_hash").select(*columns))
    return parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])


class Numbers:
    """Run ids by kind: meta, exec, two for each candidate and fold, one for each candidate's cv, one for each rank's test."""

    def __init__(self, base: int, folds: int, first_cv: int, first_test: int):
        self.base, self.folds, self.first_cv, self.first_test = base, folds, first_cv, first_test

    def fold(self) -> Column:
        return (F.lit(self.base + 2) + (F.col("cand_idx") * self.folds + F.col("fold")) * 2 + (F.col("split") == "valid").cast("int")).cast("long")

    def cv(self) -> Column:
        return (F.lit(self.first_cv) + F.col("cand_idx")).cast("long")

    def test(self) -> Column:
        return (F.lit(self.first_test) + F.col("rank") - 1).cast("long")


def fixed_rows(plan: Plan, stats: dict, prints: dict, plan_record: dict) -> dict[str, tuple[dict, dict]]:
    """Metrics and artifacts of the meta and exec runs."""
    meta = {"n_rows": plan.n_rows, "n_folds": plan.n_folds, "has_holdout": float(plan.has_holdout)}
    counters = {"exec_n_tasks": stats["n_tasks_executed"], "exec_n_jobs": stats["n_jobs_used"], "exec_had_fallback": 0.0, "candidates_generated": stats["candidates_generated"], "candidates_unique": stats["candidates_unique"]}
    counters |= {f"cache_{kind}_tasks_{x}": stats[f"{kind}_tasks_{x}"] for kind in ("fold", "test") for x in ("total", "executed", "skipped")}
    return {"meta": (meta, {"cv_plan_meta": plan_record, "data_fingerprint": prints}), "exec": (counters, {"exec_stats": stats})}


def write_results(store, exp, ids, candidates, metrics, scores, ranked, tested, fixed, cfg, folds, trials, elapsed, faults=()):
    spark, now, research = store.spark, identity.now_utc(), cfg.research
    spec = candidates.select("strategy_hash", "strategy_json")
    runs, values, artifacts = [], [], []

    def add(rows: DataFrame, artifact_parts: list[DataFrame], long: DataFrame) -> None:
        runs.append(rows)
        artifacts.extend(artifact_parts)
        values.append(long)

    for i, (split, (own, contents)) in enumerate(fixed.items()):
        number = ids.base + i
        add(
            spark.createDataFrame([(number, split, None, EXPERIMENT, "{}", EXPERIMENT, "ok", None, 0)], RUN),
            [spark.createDataFrame([(number, k, identity.canonical_json(v)) for k, v in contents.items()], "run_id long, name string, content string")],
            spark.createDataFrame([(number, k, float(v)) for k, v in own.items()], "run_id long, key string, value double"),
        )

    def add_slices(rows: DataFrame, split_of_curves: str) -> None:
        named = rows.join(F.broadcast(spec), "strategy_hash")
        curve = rows.where((F.col("split") == split_of_curves) & F.col("content").isNotNull())
        info = rows.where(F.col("cache_info").isNotNull()).select("run_id", F.lit("cache_info").alias("name"), F.col("cache_info").alias("content"))
        add(
            named.select("run_id", "split", "fold", "strategy_name", "strategy_json", "strategy_hash", F.when(F.col("error").isNull(), "ok").otherwise("error").alias("status"), "error", F.coalesce("elapsed_ms", F.lit(elapsed)).alias("elapsed_ms")),
            [curve.select("run_id", F.lit("equity_curve_head").alias("name"), "content"), info],
            to_long(rows.where(F.col("error").isNull()), ["run_id"], (*ALL, "cached")),
        )

    add_slices(metrics.withColumn("run_id", ids.fold()), "valid")
    if tested is not None:
        add_slices(tested.join(F.broadcast(ranked.select("strategy_hash", "rank")), "strategy_hash").withColumn("run_id", ids.test()), "test")

    failed = [(s, why, fold, split) for s, why in faults for fold in range(folds) for split in SIDES]
    if failed:  # candidates that can't be evaluated: a run of its own for each task, and the others go on
        at = ids.first_test + research.top_k
        rows = [(at + i, split, fold, s.name, identity.canonical_json(s), s.spec_hash(), "error", why, 0) for i, (s, why, fold, split) in enumerate(failed)]
        runs.append(spark.createDataFrame(rows, RUN))

    names = S.metric_names(research.selection_metric, research.cv_agg)
    cv = scores.withColumn("run_id", ids.cv()).withColumnsRenamed(names)
    keys = list(names.values())
    if research.selection_metric == "dsr_net":
        cv, keys = cv.withColumn("dsr_trials", F.lit(float(trials))), [*keys, "dsr_trials"]
    done = F.col("cv_score").isNotNull()
    message = F.format_string("incomplete_valid_folds ok=%d total=%d", F.col("cv_n_folds_ok").cast("int"), F.lit(folds))
    pair = F.struct("fold", F.col("train").alias("train_metric"), F.col("valid").alias("valid_metric"), "train_n", "valid_n", "train_cached", "valid_cached")
    side = lambda s, c: F.max(F.when(F.col("split") == s, F.col(c)))
    compact = S.fold_pairs(metrics, research.selection_metric, trials).join(metrics.groupBy(*S.ID, "fold").agg(*[side(s, c).alias(f"{s}_{n}") for s in SIDES for c, n in (("n_obs", "n"), ("cached", "cached"))]), [*S.ID, "fold"])
    compact = compact.groupBy(*S.ID).agg(F.to_json(F.sort_array(F.collect_list(pair))).alias("content")).withColumn("run_id", ids.cv())
    add(
        cv.join(F.broadcast(spec), "strategy_hash").select("run_id", F.lit("cv").alias("split"), F.lit(None).cast("int").alias("fold"), "strategy_name", "strategy_json", "strategy_hash", F.when(done, "ok").otherwise("error").alias("status"), F.when(~done, message).alias("error"), F.lit(0).alias("elapsed_ms")),
        [compact.select("run_id", F.lit("cv_folds_compact").alias("name"), "content")],
        to_long(cv, ["run_id"], tuple(keys)),
    )

    def whole(parts: list[DataFrame]) -> DataFrame:
        out = parts[0]
        for p in parts[1:]:
            out = out.unionByName(p)
        return out

    store.finish_runs(
        exp,
        whole(runs).withColumn("created_at", F.lit(now)),
        metrics=whole(values),
        artifacts=whole(artifacts).withColumns({"content_type": F.lit("application/json"), "compression": F.lit("parquet")}),
        best_candidates=ranked.join(F.broadcast(spec), "strategy_hash").withColumns({"created_at": F.lit(now), "score_key": F.lit("cv_score")}),
    )
