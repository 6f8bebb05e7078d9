"""Scalar statistics as SQL expression text.

Each builder takes and returns expression text, so one formula serves `F.expr` on the Spark side and any other
ANSI engine that has to give the same number.
"""
from __future__ import annotations

import math
from statistics import NormalDist

from pyspark.sql import Column, functions as F

TRADING_DAYS = 252
RISK_FREE = 0.05
EULER_GAMMA = 0.5772156649

# Rational approximation of the normal distribution function (West 2005, after Hart 1968).
CDF_NUMERATOR = (3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
                 112.079291497871, 221.213596169931, 220.206867912376)
CDF_DENOMINATOR = (8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
                   296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752)
# Rational approximation of the inverse normal distribution function (Acklam).
PPF_A = (-3.969683028665376e+01, 2.209460984245205e+02, -2.759285104469687e+02,
         1.383577518672690e+02, -3.066479806614716e+01, 2.506628277459239e+00)
PPF_B = (-5.447609879822406e+01, 1.615858368580409e+02, -1.556989798598866e+02,
         6.680131188771972e+01, -1.328068155288572e+01, 1.0)
PPF_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838e+00,
         -2.549732539343734e+00, 4.374664141464968e+00, 2.938163982698783e+00)
PPF_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996e+00,
         3.754408661907416e+00, 1.0)


def lit(x: float) -> str:
    """A literal that every engine reads as DOUBLE (not DECIMAL)."""
    return f"CAST({x!r} AS DOUBLE)"


def horner(coefficients, x: str) -> str:
    text = lit(coefficients[0])
    for c in coefficients[1:]:
        text = f"({text} * {x} + {lit(c)})"
    return text


def norm_pdf(x: str) -> str:
    return f"(EXP(-({x}) * ({x}) / 2) / {lit(math.sqrt(2 * math.pi))})"


def norm_cdf(x: str) -> str:
    """Normal distribution function, absolute error below 1e-14."""
    a = f"ABS({x})"
    tail = (f"EXP(-({x}) * ({x}) / 2) / ({a} + 1 / ({a} + 2 / ({a} + 3 / ({a} + 4 / ({a} + {lit(0.65)}))))) "
            f"/ {lit(2.506628274631)}")
    upper = (f"(CASE WHEN {a} > 37 THEN {lit(0.0)} WHEN {a} < {lit(7.07106781186547)} THEN "
             f"EXP(-({x}) * ({x}) / 2) * {horner(CDF_NUMERATOR, a)} / {horner(CDF_DENOMINATOR, a)} ELSE {tail} END)")
    return f"(CASE WHEN ({x}) > 0 THEN 1 - {upper} ELSE {upper} END)"


def norm_ppf(p: str) -> str:
    """Inverse normal distribution function, relative error below 1.2e-9."""
    q = f"(({p}) - {lit(0.5)})"
    r = f"({q} * {q})"
    low = f"SQRT(-2 * LN({p}))"
    high = f"SQRT(-2 * LN(1 - ({p})))"
    return (f"(CASE WHEN ({p}) < {lit(0.02425)} THEN {horner(PPF_C, low)} / {horner(PPF_D, low)} "
            f"WHEN ({p}) > {lit(0.97575)} THEN -{horner(PPF_C, high)} / {horner(PPF_D, high)} "
            f"ELSE {horner(PPF_A, r)} * {q} / {horner(PPF_B, r)} END)")


def expected_max_sharpe(n_trials: int) -> float:
    """Expected maximum of n standard normal draws (Bailey et al. 2014)."""
    if n_trials <= 1:
        return 0.0
    inv = NormalDist().inv_cdf
    return (1 - EULER_GAMMA) * inv(1 - 1 / n_trials) + EULER_GAMMA * inv(1 - 1 / (n_trials * math.e))


def expected_max_sharpe_of(n: str) -> str:
    """The same for a number of trials that is itself a column."""
    safe = f"GREATEST({n}, 2)"
    return (f"(CASE WHEN {n} > 1 THEN {lit(1 - EULER_GAMMA)} * {norm_ppf(f'(1 - 1 / CAST({safe} AS DOUBLE))')} + "
            f"{lit(EULER_GAMMA)} * {norm_ppf(f'(1 - 1 / ({safe} * {lit(math.e)}))')} ELSE {lit(0.0)} END)")


def deflated_sharpe(sharpe: str, n_obs: str, e_max: str, skew: str = "0", kurt: str = "0") -> str:
    """Deflated Sharpe ratio as a z-score.

    The ratio enters annualised while the variance counts daily observations; that is the tested contract of this
    metric, kept as it is. The z-score saturates at 3 where the distribution function rounds to 1, at -3 where to 0.
    """
    var = (f"((1 + 0.5 * ({sharpe}) * ({sharpe}) - ({skew}) * ({sharpe}) + ({kurt}) / 4.0 * ({sharpe}) * ({sharpe})) "
           f"/ GREATEST({n_obs} - 1, 1))")
    z = f"((({sharpe}) - ({e_max})) / SQRT({var}))"
    return (f"(CASE WHEN {n_obs} < 5 THEN {lit(-1.0)} WHEN ({sharpe}) IS NULL OR {var} < 0 THEN NULL "
            f"WHEN SQRT({var}) < {lit(1e-8)} THEN {lit(0.0)} "
            f"WHEN {z} > {lit(8.2924)} THEN {lit(3.0)} WHEN {z} < {lit(-38.4)} THEN {lit(-3.0)} ELSE {z} END)")


def sample_skew(x: Column) -> Column:
    """Bias-corrected skewness from Spark's population skewness."""
    n = F.count(x).cast("double")
    return F.when(n >= 3, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def sample_kurt(x: Column) -> Column:
    """Bias-corrected excess kurtosis from Spark's population excess kurtosis."""
    n = F.count(x).cast("double")
    return F.when(n >= 4, ((n + 1) * F.kurtosis(x) + 6) * (n - 1) / ((n - 2) * (n - 3)))


def rnd(x, digits: int = 6) -> Column:
    """Round for comparison between engines.

    Averages of decimal prices often sit exactly half-way between two rounded values, where engines disagree; a shift
    far below the precision asked for moves them off the tie.
    """
    col = F.col(x) if isinstance(x, str) else x
    return F.round(col.cast("double") + F.lit(1.7 * 10.0 ** -(digits + 4)), digits) + F.lit(0.0)
