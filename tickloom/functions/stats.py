"""Normal distribution, Sharpe ratio's error, and probabilistic and deflated Sharpe ratios, as Column expressions.

Missing values are NULL throughout, never NaN.
"""

from __future__ import annotations

from statistics import NormalDist

from pyspark.sql import Column
from pyspark.sql import functions as F

SECONDS_PER_YEAR = 365.25 * 86400
#: Hart's rational approximation of the normal distribution (as in West, 2005), highest power first.
NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383, 112.079291497871, 221.213596169931, 220.206867912376)
DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461, 296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
#: Wichura's rational approximations of the normal quantile (algorithm AS 241), highest power first: near the
#: middle, in the tails, and far out in them.
MIDDLE = (2.50908092873012267e3, 3.34305755835881281e4, 6.72657709270087009e4, 4.59219539315498715e4, 1.37316937655094611e4, 1.97159095030655144e3, 1.33141667891784377e2, 3.38713287279636661)
MIDDLE_BELOW = (5.22649527885285456e3, 2.87290857357219427e4, 3.93078958000927106e4, 2.12137943015865959e4, 5.39419602142475111e3, 6.87187007492057908e2, 4.23133307016009113e1, 1.0)
TAIL = (7.74545014278341407e-4, 2.27238449892691846e-2, 2.41780725177450612e-1, 1.27045825245236838, 3.64784832476320461, 5.76949722146069141, 4.63033784615654530, 1.42343711074968358)
TAIL_BELOW = (1.05075007164441684e-9, 5.47593808499534495e-4, 1.51986665636164572e-2, 1.48103976427480075e-1, 6.89767334985100005e-1, 1.67638483018380385, 2.05319162663775882, 1.0)
FAR = (2.01033439929228813e-7, 2.71155556874348758e-5, 1.24266094738807844e-3, 2.65321895265761230e-2, 2.96560571828504891e-1, 1.78482653991729133, 5.46378491116411437, 6.65790464350110378)
FAR_BELOW = (2.04426310338993979e-15, 1.42151175831644589e-7, 1.84631831751005468e-5, 7.86869131145613259e-4, 1.48753612908506149e-2, 1.36929880922735805e-1, 5.99832206555887938e-1, 1.0)


def _horner(coefficients: tuple[float, ...], x: Column) -> Column:
    out = F.lit(coefficients[0])
    for c in coefficients[1:]:
        out = out * x + F.lit(c)
    return out


def bound(x: Column, of) -> Column:
    """of(x) with x computed once, however often of uses it."""
    return F.get(F.transform(F.array(x), of), F.lit(0))


def normal_cdf(z: Column) -> Column:
    def tail(a: Column) -> Column:
        e = F.exp(-a * a / 2.0)
        fraction = a + 1.0 / (a + 2.0 / (a + 3.0 / (a + 4.0 / (a + 0.65))))
        return F.when(a > 37.0, 0.0).when(a < 7.07106781186547, e * _horner(NUMERATOR, a) / _horner(DENOMINATOR, a)).otherwise(e / fraction / 2.506628274631)

    return bound(z, lambda x: F.when(x > 0, 1.0 - tail(F.abs(x))).when(x.isNotNull(), tail(F.abs(x))))


def normal_cdf_sql(z: str) -> str:
    """The same in DuckDB's SQL, for a column name."""

    def horner(coefficients: tuple[float, ...]) -> str:
        out = f"{coefficients[0]!r}::DOUBLE"
        for c in coefficients[1:]:
            out = f"({out} * abs({z}) + {c!r}::DOUBLE)"
        return out

    a = f"abs({z})"
    e = f"exp(-{a} * {a} / 2.0::DOUBLE)"
    fraction = f"({a} + 1.0::DOUBLE / ({a} + 2.0::DOUBLE / ({a} + 3.0::DOUBLE / ({a} + 4.0::DOUBLE / ({a} + 0.65::DOUBLE)))))"
    tail = f"CASE WHEN {a} > 37 THEN 0.0::DOUBLE WHEN {a} < 7.07106781186547 THEN {e} * {horner(NUMERATOR)} / {horner(DENOMINATOR)} ELSE {e} / {fraction} / 2.506628274631::DOUBLE END"
    return f"CASE WHEN {z} IS NULL THEN NULL WHEN {z} > 0 THEN 1.0::DOUBLE - ({tail}) ELSE {tail} END"


def normal_ppf(p: float) -> float:
    return NormalDist().inv_cdf(min(max(p, 1e-12), 1 - 1e-12))


def normal_quantile_above(tail: Column) -> Column:
    """The value that a normal variable exceeds with probability tail, at most a half."""
    ratio = lambda above, below: lambda r: _horner(above, r) / _horner(below, r)

    def of(t: Column) -> Column:
        q = F.lit(0.5) - t
        outer = lambda r: F.when(r <= 5.0, bound(r - 1.6, ratio(TAIL, TAIL_BELOW))).otherwise(bound(r - 5.0, ratio(FAR, FAR_BELOW)))
        return F.when(q <= 0.425, q * bound(0.180625 - q * q, ratio(MIDDLE, MIDDLE_BELOW))).otherwise(bound(F.sqrt(-F.log(t)), outer))

    return bound(tail, of)


def finite(c: Column) -> Column:
    """c, NULL where it is NaN or infinite."""
    return F.when(~F.isnan(c) & (F.abs(c) != float("inf")), c)


def sharpe_error(sharpe: Column, n: Column, skew: Column, kurt: Column) -> Column:
    """Standard error of a per-period Sharpe ratio; skew and kurt default to a normal's."""
    skew, kurt = F.coalesce(skew, F.lit(0.0)), F.coalesce(kurt, F.lit(3.0))
    term = 1.0 - skew * sharpe + (kurt - 1.0) / 4.0 * sharpe * sharpe
    return F.when((n > 1) & (term > 0), F.sqrt(F.try_divide(term, n - 1)))


def probabilistic_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, benchmark: float = 0.0) -> Column:
    return normal_cdf(F.try_divide(sharpe - benchmark, sharpe_error(sharpe, n, skew, kurt)))


def expected_best(trials: int) -> float:
    """Deviations that the best of so many trials is expected above the mean; 0 for one."""
    return 0.0 if trials <= 1 else normal_ppf((trials - 0.375) / (trials + 0.25))


def expected_best_column(trials: Column) -> Column:
    """expected_best for a column of any numbers of trials."""
    tail = F.greatest(0.625 / (F.greatest(trials, F.lit(2)) + 0.25), F.lit(1e-12))
    return F.when(trials <= 1, 0.0).otherwise(normal_quantile_above(tail))


def deflated_sharpe(sharpe: Column, n: Column, skew: Column, kurt: Column, trials: int | Column, benchmark: float = 0.0) -> Column:
    """Probability that the ratio beats what the best of so many trials would by chance. trials: a number, or a column of expected_best values."""
    shift = F.lit(expected_best(trials)) if isinstance(trials, int) else trials
    return normal_cdf(F.try_divide(sharpe - benchmark, sharpe_error(sharpe, n, skew, kurt)) - shift)


def deflated_from_metrics(trials: int | Column) -> Column:
    """deflated_sharpe from metric columns; the per-period ratio falls back on the annual one over sqrt(periods_per_year or 252)."""
    per = F.coalesce(F.col("sharpe_net_per"), F.try_divide(F.col("sharpe_net"), F.sqrt(F.coalesce(F.when(F.col("periods_per_year") > 0, F.col("periods_per_year")), F.lit(252.0)))))
    return deflated_sharpe(per, F.col("n_obs"), F.col("skew_net"), F.col("kurt_net"), trials)
