"""Metrics of each (candidate, fold, split): 17 base, 2 reference and 19 volatility-regime columns. NULL means missing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tickloom.functions.quantiles import exact_quantiles
from tickloom.functions.stats import finite, probabilistic_sharpe
from tickloom.operators.panel import KEY, PLACE, Q_HIGH, Q_LOW, STRETCH_ROWS, WINDOW_ROWS, core, rolling_deviation, stretched

#: The metric names, in the order of the columns.
BASE = ("n_obs", "periods_per_year", "total_return", "cagr", "sharpe_net", "sharpe_net_per", "skew_net", "kurt_net", "psr_net", "max_drawdown", "avg_turnover", "gross_sum", "net_sum", "cost_sum", "exposure_abs_mean", "exposure_mean", "hit_rate")
REFERENCE = ("regime_ref_used", "regime_ref_coverage")
REGIME = ("regime_window", "regime_q_low", "regime_q_high", "regime_min_obs_per_regime", "regime_used_fallback", "regime_vol_q33", "regime_vol_q66", "regime_n_low", "regime_n_mid", "regime_n_high", "sharpe_regime_low_net", "sharpe_regime_mid_net", "sharpe_regime_high_net", "regime_worst_sharpe_net", "regime_best_sharpe_net", "regime_spread_sharpe_net", "regime_low_frac", "regime_mid_frac", "regime_high_frac")
ALL = BASE + REFERENCE + REGIME
#: Observations that a regime's Sharpe ratio needs: a fifth of the volatility points, within these.
MIN_OBS, MAX_MIN_OBS, SHARE = 10, 30, 0.2
NAMES = ("low", "mid", "high")


def sharpe(c: Column) -> Column:
    deviation = F.stddev_samp(c)
    return F.when(deviation > 0, F.avg(c) / deviation)


def base_aggregates() -> list[Column]:
    """Aggregates over panel rows; derived() makes the base metrics of them."""
    active = F.abs("pos") > 1e-12
    return [
        F.count("*").cast("double").alias("n_obs"),
        F.first("ppy").alias("periods_per_year"),
        F.max_by("eq", "row_idx").alias("_end"),
        sharpe(F.col("net")).alias("sharpe_net_per"),
        F.stddev_samp("net").alias("_deviation"),
        F.skewness("net").alias("_skew"),
        F.kurtosis("net").alias("_kurt"),
        F.min(F.try_divide(F.col("eq"), F.col("peak")) - 1).alias("max_drawdown"),
        F.avg("tov").alias("avg_turnover"),
        F.sum("gross").alias("gross_sum"),
        F.sum("net").alias("net_sum"),
        F.sum(F.col("tc") + F.col("slip") + F.col("borrow")).alias("cost_sum"),
        F.avg(F.abs("pos")).alias("exposure_abs_mean"),
        F.avg("pos").alias("exposure_mean"),
        F.avg(F.when(active, (F.col("net") > 0).cast("double"))).alias("hit_rate"),
    ]


def derived(df: DataFrame) -> DataFrame:
    n, spread = F.col("n_obs"), F.col("_deviation") > 0
    shrink = (n - 1) / n
    df = df.withColumns({
        "skew_net": F.when(spread & (n >= 3), finite(F.col("_skew")) * F.pow(shrink, 1.5)),
        "kurt_net": F.when(spread & (n >= 4), (finite(F.col("_kurt")) + 3) * F.pow(shrink, 2)),
        "sharpe_net": F.col("sharpe_net_per") * F.sqrt("periods_per_year"),
        "total_return": F.col("_end") - 1,
        "cagr": F.when(F.col("_end") > 0, F.pow(F.greatest("_end", F.lit(0.0)), F.col("periods_per_year") / n) - 1),
    })
    df = df.withColumn("psr_net", probabilistic_sharpe(F.col("sharpe_net_per"), n, F.col("skew_net"), F.col("kurt_net")))
    return df.drop("_end", "_deviation", "_skew", "_kurt")


def base_metrics(panel: DataFrame) -> DataFrame:
    return derived(panel.groupBy(*KEY).agg(*base_aggregates())).select(*KEY, *BASE)


def with_volatility(panel: DataFrame, rows: int = STRETCH_ROWS, some_own: bool = True) -> DataFrame:
    """Adds v, q33, q66 and n_v: volatility of the asset where its returns can be used, else of the candidate's own results.

    Only slices whose reference can't be used (a property of the slice alone, part of PLACE and so pushed below every
    window) pay for the second kind; some_own False says that there are none, and leaves it out of the plan.
    """
    asset = panel.where("own = 0").withColumns({"v": F.col("vol"), "q33": F.col("vol_q33"), "q66": F.col("vol_q66"), "n_v": F.col("n_vol")})
    if not some_own:
        return asset
    ids = ["slice_key", "cand_idx"]
    own = stretched(panel.where("own = 1"), WINDOW_ROWS, rows)
    own = core(own.withColumn("v", rolling_deviation(F.col("net"), Window.partitionBy(*PLACE, "cand_idx").orderBy("row_idx"))))
    q = exact_quantiles(own, ids, F.col("v"), [Q_LOW, Q_HIGH]).select(*ids, F.col("q0").alias("q33"), F.col("q1").alias("q66"), F.col("n").alias("n_v"))
    return asset.unionByName(own.join(q, ids, "left").withColumn("n_v", F.coalesce("n_v", F.lit(0))).select(*asset.columns))


def regime_label() -> Column:
    """low, mid or high by v against the quantiles; all mid if these don't differ; NULL without v."""
    flat = F.col("q66") <= F.col("q33")
    return F.when(F.col("v").isNull(), F.lit(None)).when(flat, "mid").when(F.col("v") <= F.col("q33"), "low").when(F.col("v") <= F.col("q66"), "mid").otherwise("high")


def regime_aggregates() -> list[Column]:
    out = [F.first("n_v").alias("_points"), F.first("q33").alias("_q33"), F.first("q66").alias("_q66"), F.first("ref_used").alias("regime_ref_used"), F.first("ref_coverage").alias("regime_ref_coverage")]
    for name in NAMES:
        inside = F.when(F.col("regime") == name, F.col("net"))
        out += [F.count(inside).cast("double").alias(f"_n_{name}"), sharpe(inside).alias(f"_sharpe_{name}")]
    return out


def regimes(df: DataFrame) -> DataFrame:
    """Regime metrics from regime_aggregates, n_obs, periods_per_year and sharpe_net.

    Under WINDOW_ROWS + 2 rows, or with fewer than MIN_OBS volatility points, there are no regimes: the fallback. Nor are
    there where no regime has enough observations. Worst and best are then the Sharpe ratio of the whole slice.
    """
    n = F.col("n_obs")
    least = F.least(F.lit(float(MAX_MIN_OBS)), F.greatest(F.lit(float(MIN_OBS)), F.floor(SHARE * F.greatest(F.lit(0.0), n - WINDOW_ROWS + 1)).cast("double")))
    early = (n < WINDOW_ROWS + 2) | (F.col("_points") < MIN_OBS)
    columns = {"regime_window": F.lit(float(WINDOW_ROWS)), "regime_q_low": F.lit(Q_LOW), "regime_q_high": F.lit(Q_HIGH), "regime_min_obs_per_regime": least, "_early": early}
    df = df.withColumns(columns)
    some = lambda c: F.when(~F.col("_early"), c)
    df = df.withColumns({"regime_vol_q33": some(F.col("_q33")), "regime_vol_q66": some(F.col("_q66"))})
    df = df.withColumns({f"regime_n_{x}": F.when(F.col("_early"), 0.0).otherwise(F.col(f"_n_{x}")) for x in NAMES})
    enough = lambda x: F.when(~F.col("_early") & (F.col(f"_n_{x}") >= F.col("regime_min_obs_per_regime")), F.col(f"_sharpe_{x}") * F.sqrt("periods_per_year"))
    df = df.withColumns({f"sharpe_regime_{x}_net": enough(x) for x in NAMES})
    three = [F.col(f"sharpe_regime_{x}_net") for x in NAMES]
    total = sum((F.col(f"regime_n_{x}") for x in NAMES), F.lit(0.0))
    worst, best = F.least(*three), F.greatest(*three)
    df = df.withColumns({
        "regime_used_fallback": F.when(F.col("_early") | worst.isNull(), 1.0).otherwise(0.0),
        "regime_worst_sharpe_net": F.coalesce(worst, F.col("sharpe_net")),
        "regime_best_sharpe_net": F.when(worst.isNull(), F.col("sharpe_net")).otherwise(best),
        "regime_spread_sharpe_net": F.when(worst.isNull(), 0.0).otherwise(best - worst),
    } | {f"regime_{x}_frac": F.try_divide(F.col(f"regime_n_{x}"), total) for x in NAMES})
    return df


def fold_metrics(panel: DataFrame, rows: int = STRETCH_ROWS, some_own: bool = True, also: dict[str, Column] | None = None) -> DataFrame:
    """KEY, ALL and the aggregates of also for each candidate and slice, in one aggregation of the panel; rows, some_own: see with_volatility."""
    labelled = with_volatility(panel, rows, some_own).withColumn("regime", regime_label())
    more = also or {}
    one = labelled.groupBy(*KEY).agg(*base_aggregates(), *regime_aggregates(), *[c.alias(name) for name, c in more.items()])
    return regimes(derived(one)).select(*KEY, *ALL, *more)


def to_long(metrics: DataFrame, ids: list[str], names: tuple[str, ...] = ALL) -> DataFrame:
    """ids, key and value: a row for each metric."""
    return metrics.select(*ids, *[F.col(c).cast("double") for c in names]).unpivot(ids, list(names), "key", "value")


def to_map(long: DataFrame, ids: list[str]) -> DataFrame:
    """ids and metrics, a map of the long form."""
    return long.groupBy(*ids).agg(F.map_from_entries(F.collect_list(F.struct("key", "value"))).alias("metrics"))


def to_wide(long: DataFrame, ids: list[str], names: list[str]) -> DataFrame:
    return long.groupBy(*ids).pivot("key", names).agg(F.first("value"))
