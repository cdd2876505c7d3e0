import json
import math
from statistics import NormalDist

import pytest
from pyspark.sql import functions as F

from tickloom import identity
from tickloom.config import EngineConfig, from_dict, load_config
from tickloom.functions import stats

WALK = {"data": {"n_rows": 400}, "splits": {"embargo_rows": 2}, "cv": {"method": "walk_forward"}}


def test_defaults_and_coercion(tmp_path):
    path = tmp_path / "c.json"
    path.write_text(json.dumps({"seed": "7", "unknown": 1, "data": {"n_rows": None, "feature_cols": "a, b,,", "dedup": "off", "row_limit": "x", "path": "  "}, "research": {"top_k": "3", "cv_penalty_std": "oops"}, "execution": {"prefer_processes": "false"}}))
    cfg = load_config(str(path))
    assert (cfg.seed, cfg.data.n_rows, cfg.data.feature_cols, cfg.data.dedup, cfg.data.row_limit, cfg.data.path) == (7, 400, ["a", "b"], False, None, None)
    assert (cfg.research.top_k, cfg.research.cv_penalty_std, cfg.execution.prefer_processes) == (3, 0.5, False)
    assert from_dict({}) == EngineConfig()


@pytest.mark.parametrize("raw", [
    {"splits": {"train_frac": 0}}, {"splits": {"valid_frac": 1}}, {"splits": {"train_frac": 0.6, "valid_frac": 0.5}}, {"backtest": {"execution_lag": -1}}, {"research": {"n_candidates": 0}},
    {"research": {"top_k": 0}}, {"data": {"n_features": 0}}, {"data": {"n_rows": 10}}, {"data": {"type": "csv"}}, {"cv": {"method": "x"}}, {"cv": {"n_folds": 0}}, {"cv": {"valid_window_rows": 0}},
    {"cv": {"step_rows": 0}}, {"cv": {"min_train_rows": 9}}, {"cv": {"purge_rows": -1}}, {"cv": {"train_window_rows": -1}}, {"research": {"cv_agg": "max"}}, {"research": {"cv_penalty_std": -1}},
])
def test_rules(raw):
    with pytest.raises(ValueError):
        from_dict(raw)


def test_cache_relations(spark):
    def of(**k):
        cfg = from_dict(WALK | k)
        return identity.evaluation_hash(cfg, identity.source_of(spark, cfg.data, cfg.seed))

    assert of() == of(run_name="x", mode="full", execution={"n_jobs": 4}, research={"n_candidates": 60, "selection_metric": "psr_net"}, persistence={"db_path": "y"})
    assert len({of(), of(seed=1), of(splits={}), of(cv={"method": "single"}), of(costs={"tc_bps": 3}), of(backtest={"leverage": 2}), of(data={"n_rows": 400, "freq": "h"})}) == 7
    cfg = from_dict(WALK)
    source = identity.source_of(spark, cfg.data, cfg.seed)
    assert identity.evaluation_hash(cfg, source) == identity.evaluation_hash(json.loads(identity.canonical_json(cfg)), source)
    assert cfg.config_hash() != from_dict(WALK | {"run_name": "z"}).config_hash()


def test_sources_are_known_by_their_content(spark, tmp_path):
    """Equal rows are one version in one file or many, anywhere; a changed row in a folder is another."""
    rows = spark.range(1000).selectExpr("timestamp'2020-01-01' + make_dt_interval(cast(id as int)) timestamp", "1.0 + id price", "cast(id % 7 as double) x")
    rows.coalesce(1).write.parquet(str(tmp_path / "a" / "t"))
    rows.repartition(5).write.parquet(str(tmp_path / "b" / "t"))
    version = lambda path, kind="parquet": identity.source_of(spark, {"type": kind, "path": str(path)})
    one = version(tmp_path / "a" / "t")
    assert one == version(f"file://{tmp_path}/b/t") and (one.name, one.basis, one.rows) == ("t", "rows", 1000)
    changed = rows.withColumn("price", F.when(F.col("x") == 3, F.col("price") + 1e-9).otherwise(F.col("price")))
    changed.write.mode("overwrite").parquet(str(tmp_path / "b" / "t"))
    assert version(tmp_path / "b" / "t").version != one.version
    rows.union(rows.limit(1)).write.parquet(str(tmp_path / "c"))
    rows.withColumnRenamed("x", "y").write.parquet(str(tmp_path / "d"))
    assert len({version(tmp_path / x).version for x in ("a/t", "c", "d")}) == 3
    text = tmp_path / "a.csv"
    text.write_text("timestamp,price\n1,2\n")
    first = version(text, "csv")
    text.write_text("timestamp,price\n1,3\n")
    assert version(text, "csv").version != first.version and first.rows == 2
    assert identity.source_of(spark, {"type": "csv", "dataset_id": "d", "dataset_version": 3, "path": "/none"}) == ("csv", "d", "3", "given", None)
    assert identity.source_of(spark, {}) == ("unknown", "unknown", "", "none", None)
    assert set(one.record()) == {"kind", "name", "version", "basis", "rows", "digest"}
    assert identity.canonical_json({"b": 1e-5, "a": ["é", None]}) == '{"a":["é",null],"b":1e-05}'
    with pytest.raises(Exception, match="PATH_NOT_FOUND"):
        version(tmp_path / "nothing")


def test_normal_and_sharpe(spark):
    zs = [-40.0, -8.0, -3.0, -1e-9, 0.0, 0.5, 2.0, 7.2, 40.0, None]
    got = spark.createDataFrame([(z,) for z in zs], "z double").select("z", stats.normal_cdf(F.col("z")).alias("p")).collect()
    for r in got:
        assert r.p is None if r.z is None else abs(r.p - NormalDist().cdf(r.z)) < 1e-15
    trials = [1, 2, 3, 5, 17, 60, 2000, 2001, 10**6, 10**9, 10**11, 10**14]
    best = spark.createDataFrame([(m,) for m in trials], "m long").select("m", stats.expected_best_column(F.col("m")).alias("x")).collect()
    assert all(math.isclose(r.x, stats.expected_best(r.m), rel_tol=1e-5 if r.m > 10**9 else 1e-8) for r in best)
    assert math.isclose(stats.expected_best(60), 2.3125591810669337) and stats.expected_best(1) == 0
    cols = [F.col(c) for c in ("sr", "n", "skew", "kurt")]
    rows = spark.createDataFrame([(0.1, 250.0, -0.3, 4.0), (0.1, 1.0, 0.0, 3.0), (None, 9.0, 0.0, 3.0), (0.1, 250.0, None, None), (5.0, 9.0, 30.0, 3.0)], "sr double, n double, skew double, kurt double")
    out = rows.select(stats.sharpe_error(*cols).alias("se"), stats.probabilistic_sharpe(*cols).alias("psr"), stats.deflated_sharpe(*cols, 60).alias("dsr"), stats.deflated_sharpe(*cols, 1).alias("one")).collect()
    se = math.sqrt((1 + 0.03 + 0.75 * 0.01) / 249)
    assert math.isclose(out[0].se, se) and math.isclose(out[0].psr, NormalDist().cdf(0.1 / se)) and math.isclose(out[0].dsr, NormalDist().cdf(0.1 / se - stats.expected_best(60))) and out[0].one == out[0].psr
    assert out[1].se is None and out[2].psr is None and out[3].psr is not None and out[4].dsr is None
