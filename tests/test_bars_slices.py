import datetime as dt

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tickloom.config import CvConfig, DataConfig, SplitConfig
from tickloom.operators import slices as V
from tickloom.sources import bars as B


def test_synthetic_and_csv_agree(spark, tmp_path):
    path = str(tmp_path / "toy.csv")
    B.write_toy_csv(path, rows=300, features=3)
    cfg = DataConfig(type="csv", path=path, n_features=3, row_limit=100, feature_cols=["feat0", "feat1", "feat2"])
    got = B.load_bars(spark, cfg, 1).orderBy("row_idx").collect()
    want = B.synthetic_bars(spark, DataConfig(n_rows=300, n_features=3, start="2016-01-01"), 42).orderBy("row_idx").collect()[-100:]
    assert [(r.ts, r.price, r.f000, r.f002) for r in got] == [(r.ts, r.price, r.f000, r.f002) for r in want] and [r.row_idx for r in got] == list(range(100))
    B.check_bars(B.load_bars(spark, cfg, 1))
    auto = B.load_bars(spark, DataConfig(type="csv", path=path, n_features=2), 1)
    assert auto.columns == ["ts", "row_idx", "price", "f000", "f001"]
    for bad in ({"price_col": "zz"}, {"feature_cols": ["feat0"]}, {"n_features": 9, "feature_cols": None}, {"feature_cols": ["feat0", "feat1", "no"]}):
        with pytest.raises(ValueError):
            B.load_bars(spark, DataConfig(**({"type": "csv", "path": path, "n_features": 3, "feature_cols": ["feat0", "feat1", "feat2"]} | bad)), 1)
    with pytest.raises(ValueError):
        B.load_bars(spark, DataConfig(type="odd"), 1)


def test_duplicates_gaps_and_times(spark):
    rows = [("2020-01-02", 2.0, 1.0), ("2020-01-01", 1.0, 1.0), ("2020-01-02", 9.0, 1.0), ("2020-01-03", None, 1.0), ("2020-01-04", 4.0, float("nan")), ("2020-01-05", 5.0, 1.0)]
    raw = spark.createDataFrame([(*r, i) for i, r in enumerate(rows)], "timestamp string, price double, x double, i int").coalesce(1)
    keep = lambda **k: [(r.ts.day, r.price) for r in B.normalise(raw, features=["x"], order=F.col("i"), **k).orderBy("row_idx").collect()]
    assert keep() == [(1, 1.0), (2, 2.0), (5, 5.0)]
    assert keep(row_limit=3) == [(5, 5.0)] and len(keep(dropna=False)) == 5
    with pytest.raises(ValueError):
        keep(dedup=False)
    with pytest.raises(ValueError):
        B.normalise(raw.union(spark.createDataFrame([("soon", 1.0, 1.0, 9)], raw.schema)), features=["x"])


def test_parquet_source_keeps_the_first_row_in_file_order(spark, tmp_path):
    rows = [("2020-01-0%d 00:00:00" % (1 + i % 3), float(i + 1), 1.0) for i in range(9)]
    spark.createDataFrame(rows, "timestamp string, price double, x double").coalesce(1).write.parquet(str(tmp_path / "t"))
    got = B.load_bars(spark, DataConfig(type="parquet", path=str(tmp_path / "t"), n_features=1), 1).orderBy("row_idx").collect()
    assert [(r.ts.day, r.price, r.row_idx) for r in got] == [(1, 1.0, 0), (2, 2.0, 1), (3, 3.0, 2)]


def test_bars_at_scale(spark):
    """Against the model in numpy with the same hashes, in one stretch or many, and by any parallelism."""
    import numpy as np
    from xxhash import xxh64_intdigest

    cfg = DataConfig(n_rows=300, n_features=2, freq="h")
    df = B.synthetic_bars_at_scale(spark, cfg, 3, rows=64)
    got = df.orderBy("row_idx").toPandas()

    def normal(row, column):
        u = []
        for half in (0, 1):
            h = 42
            for v in (3, row, 2 * column + half):
                h = xxh64_intdigest(int(v).to_bytes(8, "little"), h)
            u.append(((h >> 11) + 0.5) / 2.0**53)
        return np.sqrt(-2 * np.log(u[0])) * np.cos(2 * np.pi * u[1])

    x = np.array([[0.7 * normal(r, 1 + i) + 0.3 * normal(r, 0) for i in range(2)] for r in range(300)])
    mix = np.random.default_rng(3).normal(size=2)
    mix /= np.linalg.norm(mix) + 1e-12
    ret = np.array([0.0008 * (x[r - 1] @ mix if r else 0.0) + 0.01 * normal(r, 3) for r in range(300)])
    assert np.allclose(got[["f000", "f001"]], x, rtol=1e-9) and np.allclose(got.price, 100 * np.cumprod(1 + ret), rtol=1e-9)
    other = B.synthetic_bars_at_scale(spark, cfg, 3).repartition(7).orderBy("row_idx").toPandas()
    assert np.allclose(other.price, got.price, rtol=1e-12) and (other.ts.diff().dropna() == pd.Timedelta("1h")).all()
    big = B.synthetic_bars_at_scale(spark, DataConfig(n_rows=20000, n_features=1), 5).select("f000").toPandas().f000
    assert abs(big.mean()) < 0.03 and abs(big.std() - (0.49 + 0.09) ** 0.5) < 0.03


def test_numbering_spreads_however_times_are(spark):
    """A series within a minute but for one row years away: numbered in order, in many stretches."""
    base = 1_577_836_800_000_000
    micros = [base + 7 * i for i in range(5000)] + [base + 10**15]
    df = spark.createDataFrame([(m,) for m in reversed(micros)], "m long").select(F.timestamp_micros("m").cast("timestamp_ntz").alias("ts"), "m")
    got = [(r.m, r.row_idx) for r in B.indexed(df).collect()]
    assert sorted(got) == [(m, i) for i, m in enumerate(micros)]
    bounds = [2, 3, 5, 8]
    places = spark.range(10).select("id", B.stretch_of(F.col("id"), bounds).alias("s")).collect()
    assert all(r.s == sum(b <= r.id for b in bounds) for r in places)
    assert B.indexed(df.limit(0)).count() == 0 and B.indexed(df.limit(1)).first().row_idx == 0
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    edges = sorted(set(df.agg(F.approx_percentile(at, [i / B.STRETCHES for i in range(1, B.STRETCHES)], B.ACCURACY)).first()[0]))
    assert df.groupBy(B.stretch_of(at, edges).alias("s")).count().agg(F.max("count")).first()[0] <= 20


def ranges(plan, split):
    return [(s.lo, s.hi) for s in plan.of(split)]


def test_plans():
    one = V.single_plan(400, SplitConfig(embargo_rows=2))
    assert (ranges(one, "train"), ranges(one, "valid"), ranges(one, "test")) == ([(0, 238)], [(242, 318)], [(322, 400)])
    walk = V.walk_forward_plan(400, CvConfig(method="walk_forward"))
    assert ranges(walk, "train") == [(0, 120), (0, 170), (0, 220)] and ranges(walk, "valid") == [(122, 172), (172, 222), (222, 272)]
    assert ranges(walk, "test") == [(320, 400)] and walk.holdout_train[0].hi == 318 and V.feasible_folds(318, CvConfig()) == 3
    csv = V.walk_forward_plan(400, CvConfig(method="walk_forward", valid_window_rows=60, step_rows=60))
    assert ranges(csv, "valid") == [(122, 182), (182, 242), (242, 302)]
    fixed = V.walk_forward_plan(400, CvConfig(method="walk_forward", train_window_rows=120))
    assert ranges(fixed, "train") == [(0, 120), (50, 170), (100, 220)]
    assert not V.walk_forward_plan(400, CvConfig(method="walk_forward", holdout_test_rows=0)).has_holdout
    for bad in ({"n_folds": 4}, {"valid_window_rows": 66, "step_rows": 66}, {"holdout_test_rows": 400}, {"min_train_rows": 320}, {"train_window_rows": 50}, {"min_valid_rows": 60}):
        with pytest.raises(ValueError):
            V.walk_forward_plan(400, CvConfig(**({"method": "walk_forward"} | bad)))
    with pytest.raises(ValueError):
        V.single_plan(100, SplitConfig())


def test_assignment_and_meta(spark):
    bars = B.synthetic_bars(spark, DataConfig(n_rows=400, n_features=1), 1)
    plan = V.build_plan(400, SplitConfig(), CvConfig(method="walk_forward"))
    counts = {(r.fold, r.split): r["count"] for r in V.assign(bars, plan.slices).groupBy("fold", "split").count().collect()}
    assert counts == {(s.fold, s.split): s.rows for s in plan.slices}
    meta = V.plan_meta(bars, plan).where("split = 'test'").first()
    assert (meta.first_ts, meta.rows) == ("2018-11-17 00:00:00", 80)


def test_axes_against_pandas(spark):
    for freq in ("B", "W", "ME", "MS", "D", "h"):
        for start in ("2018-01-01 09:30:00", "2020-02-29", "2021-05-08", "2022-12-31"):
            got = [r.ts for r in B.time_axis(spark, start, 40, freq).orderBy("ts").collect()]
            assert got == pd.date_range(start, periods=40, freq=freq).to_pydatetime().tolist(), (freq, start)
    assert B.time_axis(spark, "1900-01-01", 50_000, "D").agg(F.max("ts")).first()[0] == dt.datetime(1900, 1, 1) + dt.timedelta(days=49_999)


def test_a_wrong_number_of_weights_is_an_error(spark):
    from tickloom.operators.candidates import linear_signal

    rows = spark.createDataFrame([([1.0, 2.0], 0.0, 1.0)], "weights array<double>, threshold double, f000 double")
    with pytest.raises(Exception, match="2 weights for 1 features"):
        rows.select(linear_signal(["f000"])).collect()
