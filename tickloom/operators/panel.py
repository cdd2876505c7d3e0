"""The backtest panel: bars x slices x candidates, as one windowed plan.

A slice is worked on in stretches of STRETCH_ROWS rows, each with a copy of the few rows before it (its halo), so that
returns, volatility, lags and turnover need no other stretch and no window holds a slice. What runs through a whole slice
(equity and its peak) is taken within the stretch first; each stretch's product, highest and lowest equity are scanned
along the slice, and every stretch finishes with what came before it. What doesn't depend on a candidate (returns,
volatility, its quantiles, the time step) is computed once for each slice.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from tickloom.config import BacktestConfig, CostConfig
from tickloom.functions.quantiles import exact_quantiles, is_finite, order_bits, quantiles_of_bits
from tickloom.functions.stats import SECONDS_PER_YEAR
from tickloom.operators.candidates import LINEAR, blocks, signal_for
from tickloom.operators.slices import Slice, assign
from tickloom.sources.bars import features_of

KEY = ["cand_block", "cand_idx", "strategy_hash", "strategy_name", "fold", "split"]
#: What a task's rows share: own is 1 where a slice's regimes go by the candidate's own results.
PLACE = ["cand_block", "slice_key", "own", "stretch"]
STRETCH_ROWS = 4096
WINDOW_ROWS = 20
Q_LOW, Q_HIGH = 0.33, 0.66
DAY = 86400.0


def upto(w):
    return w.rowsBetween(Window.unboundedPreceding, 0)


def stretched(df: DataFrame, halo: int, rows: int = STRETCH_ROWS) -> DataFrame:
    """df with stretch and halo: rows by row_idx in stretches, and a copy, with halo true, of the halo rows before each."""
    own = F.floor(F.col("row_idx") / rows)
    every = F.sequence(own, F.floor((F.col("row_idx") + halo) / rows))
    return df.withColumn("stretch", F.explode(every)).withColumn("halo", F.col("stretch") > own)


def core(df: DataFrame) -> DataFrame:
    """Rows without the copies that stand before each stretch."""
    return df.where(~F.col("halo"))


def rolling_deviation(c: Column, w, rows: int = WINDOW_ROWS) -> Column:
    """Population deviation of the last rows values; NULL while there are fewer."""
    frame = w.rowsBetween(-(rows - 1), 0)
    return F.when(F.count(c).over(frame) == rows, F.stddev_pop(c).over(frame))


def moves(bars: DataFrame, slices: list[Slice], lag: int = 1, rows: int = STRETCH_ROWS) -> DataFrame:
    """Bars by slice and stretch (with halo) with slice_key, ret, vol (of ret) and step (seconds since the row before)."""
    sliced = assign(stretched(bars, max(WINDOW_ROWS, lag + 1), rows), slices)
    sliced = sliced.withColumn("slice_key", F.concat_ws(":", "split", F.coalesce("fold", F.lit(-1))))
    w = Window.partitionBy("slice_key", "stretch").orderBy("row_idx")
    ret = F.coalesce(F.try_divide(F.col("price"), F.lag("price").over(w)) - 1, F.lit(0.0))
    at = F.unix_micros(F.col("ts").cast("timestamp"))
    moved = sliced.withColumns({"ret": ret, "step": (at - F.lag(at).over(w)) / 1e6})
    return moved.withColumn("vol", rolling_deviation(F.col("ret"), w))


def periods(median: Column, rows: Column) -> Column:
    """Periods of a year: its seconds over the median step of a slice, a day if it has under three rows or no step."""
    return SECONDS_PER_YEAR / F.when((rows >= 3) & (median > 0), median).otherwise(DAY)


def periods_per_year(bars: DataFrame, slices: list[Slice], rows: int = STRETCH_ROWS) -> DataFrame:
    """fold, split and ppy."""
    moved = core(moves(bars, slices, rows=rows))
    counts = moved.groupBy("fold", "split", "slice_key").agg(F.count("*").alias("rows"))
    steps = exact_quantiles(moved, ["slice_key"], F.col("step"), [0.5], few=True)
    return counts.join(steps, "slice_key", "left").select("fold", "split", periods(F.col("q0"), F.col("rows")).alias("ppy"))


FACTS = "slice_key string, ref_coverage double, ref_used double, own int, vol_q33 double, vol_q66 double, n_vol long, ppy double"


def slice_facts(bars: DataFrame, slices: list[Slice], rows: int = STRETCH_ROWS) -> list[Row]:
    """FACTS: what holds for all of a slice, a row for each slice of a plan, computed here and now.

    ref_used says whether the asset's returns serve for regimes (own is its opposite); vol_q33, vol_q66 and n_vol are
    quantiles and number of its volatilities. Plans that use these rows needn't hold the selection of quantiles.
    """
    bits = lambda c: F.when(is_finite(F.col(c)), order_bits(F.col(c)))
    inner = core(moves(bars, slices, rows=rows)).select("slice_key", "ret", bits("vol").alias("vol"), bits("step").alias("step")).persist()
    ok = F.col("ret").isNotNull() & ~F.isnan("ret")
    facts = inner.groupBy("slice_key").agg(F.avg(ok.cast("double")).alias("ref_coverage"), F.stddev_pop("ret").alias("_spread"), F.count("*").alias("_rows"))
    each = inner.select("slice_key", F.explode(F.array(F.struct(F.lit("vol").alias("what"), F.col("vol").alias("_bits")), F.struct(F.lit("step").alias("what"), F.col("step").alias("_bits")))).alias("_e")).select("slice_key", "_e.what", "_e._bits")
    q = quantiles_of_bits(each.where("_bits is not null"), ["slice_key", "what"], [Q_LOW, Q_HIGH, 0.5], few=True)
    pick = lambda what, c: F.max(F.when(F.col("what") == what, F.col(c)))
    q = q.groupBy("slice_key").agg(pick("vol", "q0").alias("vol_q33"), pick("vol", "q1").alias("vol_q66"), pick("vol", "n").alias("n_vol"), pick("step", "q2").alias("_median"))
    used = (F.col("ref_coverage") >= 0.99) & (F.col("_spread") > 1e-12)
    whole = facts.join(q, "slice_key", "left").select(
        "slice_key", "ref_coverage", F.when(used, 1.0).otherwise(0.0).alias("ref_used"), F.when(used, 0).otherwise(1).alias("own"),
        "vol_q33", "vol_q66", F.coalesce("n_vol", F.lit(0)).alias("n_vol"), periods(F.col("_median"), F.col("_rows")).alias("ppy"),
    )
    out = whole.collect()  # a row a slice
    inner.unpersist()
    return out


def some_own(facts: list[Row]) -> bool:
    """Whether any slice's regimes go by the candidates' own results."""
    return any(f["own"] == 1 for f in facts)


def market(bars: DataFrame, slices: list[Slice], lag: int = 1, rows: int = STRETCH_ROWS, facts: list[Row] | None = None) -> DataFrame:
    """moves() with FACTS (computed here if not given). lag is the execution lag that the halo must serve; core() leaves the slices' rows."""
    known = bars.sparkSession.createDataFrame(slice_facts(bars, slices, rows) if facts is None else facts, FACTS)
    return moves(bars, slices, lag, rows).join(F.broadcast(known), "slice_key")


def null_safe_join(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({c: f"_right_{c}" for c in on})
    keys = [left[c].eqNullSafe(renamed[f"_right_{c}"]) for c in on]
    condition = keys[0]
    for k in keys[1:]:
        condition = condition & k
    return left.join(renamed, condition, how).drop(*[f"_right_{c}" for c in on])


def signals(market_: DataFrame, candidates: DataFrame, name: str = LINEAR) -> DataFrame:
    """Market rows (halo included) for each candidate of a native strategy, with raw positions.

    A copy of the market goes to each (block of candidates, slice, stretch), which spreads the work however few slices
    there are; within it every candidate gets its rows without another shuffle, and all later windows stay there.
    """
    features = features_of(market_)
    some = blocks(candidates.where(F.col("strategy_name") == name))
    wide = market_.crossJoin(F.broadcast(some)).repartition(*PLACE)  # candidates are checked to be few
    each = wide.withColumn("_c", F.explode("_candidates")).select("_c.*", *wide.columns).drop("_candidates")
    return each.withColumn("raw", signal_for(name, features)).drop("weights", "threshold", *features)


def local_results(raw: DataFrame, run: BacktestConfig, costs: CostConfig) -> DataFrame:
    """From raw positions to pos, gross, tov, tc, slip, borrow and net, and within each stretch alone the equity _eq and the highest and lowest so far. One sort serves all windows."""
    w = Window.partitionBy(*PLACE, "cand_idx").orderBy("row_idx")
    held = F.coalesce(F.lag("raw", run.execution_lag).over(w), F.lit(0.0)) if run.execution_lag else F.col("raw")
    df = raw.withColumn("pos", held * run.leverage).withColumn("gross", F.col("pos") * F.col("ret"))
    df = df.withColumn("tov", F.abs(F.col("pos") - F.coalesce(F.lag("pos").over(w), F.lit(0.0))))
    df = df.withColumns({"tc": F.col("tov") * (costs.tc_bps / 1e4), "slip": F.col("tov") * (costs.slippage_bps / 1e4), "borrow": F.abs("pos") * (costs.borrow_bps_annual / 1e4) / F.greatest(F.lit(1.0), "ppy")})
    df = core(df.withColumn("net", F.col("gross") - F.col("tc") - F.col("slip") - F.col("borrow")))
    df = df.withColumn("_eq", F.product(1.0 + F.col("net")).over(upto(w)))
    return df.withColumns({"_high": F.max("_eq").over(upto(w)), "_low": F.min("_eq").over(upto(w))})


def carries(local: DataFrame) -> DataFrame:
    """PLACE and _before: for each candidate the equity at the end of the stretches before, and its peak until then.

    The highest equity of a stretch is the equity before it times its highest local one, or its lowest if that equity is
    negative. A row for each candidate, slice and stretch goes through the scan.
    """
    ends = local.groupBy(*PLACE, "cand_idx").agg(F.product(1.0 + F.col("net")).alias("_product"), F.max("_eq").alias("_high"), F.min("_eq").alias("_low"))
    w = Window.partitionBy("cand_block", "slice_key", "own", "cand_idx").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)
    ends = ends.withColumn("equity", F.coalesce(F.product("_product").over(w), F.lit(1.0)))
    ends = ends.withColumn("_top", F.col("equity") * F.when(F.col("equity") >= 0, F.col("_high")).otherwise(F.col("_low")))
    ends = ends.withColumn("peak", F.max("_top").over(w))
    return ends.groupBy(*PLACE).agg(F.collect_list(F.struct("cand_idx", "equity", "peak")).alias("_before"))  # those of one block


def backtest(raw: DataFrame, run: BacktestConfig, costs: CostConfig) -> DataFrame:
    """From raw positions (market rows with halo) to the panel: pos, gross, tov, tc, slip, borrow, net, eq and peak."""
    if run.execution_lag < 0:
        raise ValueError("execution_lag must not be negative")
    local = local_results(raw, run, costs)
    whole = local.join(carries(local), PLACE)  # both lie by PLACE already
    whole = whole.withColumn("_c", F.get(F.filter("_before", lambda x: x["cand_idx"] == F.col("cand_idx")), F.lit(0)))
    before = F.col("_c.equity")
    peak = F.greatest(F.col("_c.peak"), before * F.when(before >= 0, F.col("_high")).otherwise(F.col("_low")))
    return whole.withColumns({"eq": before * F.col("_eq"), "peak": peak}).drop("_eq", "_high", "_low", "_before", "_c", "halo")


def panel(bars: DataFrame, slices: list[Slice], candidates: DataFrame, run: BacktestConfig, costs: CostConfig, rows: int = STRETCH_ROWS, facts: list[Row] | None = None) -> DataFrame:
    return backtest(signals(market(bars, slices, run.execution_lag, rows, facts), candidates), run, costs)


def aligned(panel_rows: DataFrame, positions: DataFrame) -> DataFrame:
    """raw of positions (KEY and ts) on the rows of panel_rows; 0 where there is none."""
    other = positions.select(*KEY, "ts", F.col("raw").alias("_raw"))
    return null_safe_join(panel_rows.drop("raw"), other, [*KEY, "ts"], "left").withColumn("raw", F.coalesce("_raw", F.lit(0.0))).drop("_raw")


def head_aggregates(n: int = 50) -> dict[str, Column]:
    """First and last time, the final equity, and the equity of the slice's first n rows, as aggregates by KEY."""
    head = F.sort_array(F.collect_list(F.when(F.col("row_idx") < F.col("slice_lo") + n, F.struct("row_idx", "eq"))))
    stamp = lambda c: F.date_format(c, "yyyy-MM-dd HH:mm:ss")
    return {"t0": stamp(F.min("ts")), "t1": stamp(F.max("ts")), "equity_end": F.max_by("eq", "row_idx"), "equity_head": F.transform(head, lambda s: s["eq"])}


def equity_head(panel_rows: DataFrame, n: int = 50) -> DataFrame:
    """KEY and head_aggregates()."""
    return panel_rows.groupBy(*KEY).agg(*[c.alias(name) for name, c in head_aggregates(n).items()])


def reference_returns(panel_rows: DataFrame, eps: float = 1e-12, rows: int = STRETCH_ROWS) -> DataFrame:
    """panel_rows with implied: the return that gross results and the position before imply; NULL without one."""
    df = stretched(panel_rows, 1, rows)
    before = F.lag("pos").over(Window.partitionBy(*PLACE, "cand_idx").orderBy("row_idx"))
    return core(df.withColumn("implied", F.when(F.abs(before) > eps, F.col("gross") / before))).drop("halo")
