"""Option pricing as SQL expression text: price, greeks, quotes and contract symbols.

s, k, t, r, v are expressions for spot, strike, years, rate and volatility; `call` is a boolean expression.
"""
from __future__ import annotations

from marketframe.functions.stats import norm_cdf, norm_pdf


def d1(s: str, k: str, t: str, r: str, v: str) -> str:
    return f"((LN({s} / {k}) + ({r} + 0.5 * {v} * {v}) * {t}) / NULLIF({v} * SQRT({t}), 0))"


def price(s, k, t, r, v, call, n1: str = "n1", n2: str = "n2") -> str:
    """Black-Scholes price from N(d1), N(d2); intrinsic value where time or volatility has run out, never below 0."""
    intrinsic = f"GREATEST(CASE WHEN {call} THEN {s} - {k} ELSE {k} - {s} END, 0)"
    disc = f"{k} * EXP(-{r} * {t})"
    value = f"CASE WHEN {call} THEN {s} * {n1} - {disc} * {n2} ELSE {disc} * (1 - {n2}) - {s} * (1 - {n1}) END"
    return f"(CASE WHEN {t} <= 0 OR {v} <= 0 THEN {intrinsic} ELSE GREATEST({value}, 0) END)"


def greeks(s, k, t, r, v, call, x1: str = "d1", n1: str = "n1", n2: str = "n2") -> dict[str, str]:
    """delta, gamma, theta per day, vega and rho per percentage point.

    The theta of a put carries interest with a positive sign, which is the analytic value.
    """
    pdf = norm_pdf(x1)
    disc = f"{k} * EXP(-{r} * {t})"
    over = f"{t} <= 0"
    edge = f"CASE WHEN {call} AND {s} > {k} THEN 1.0 WHEN NOT ({call}) AND {s} < {k} THEN -1.0 ELSE 0.0 END"
    return {
        "delta": f"(CASE WHEN {over} THEN {edge} WHEN {call} THEN {n1} ELSE {n1} - 1 END)",
        "gamma": f"(CASE WHEN {over} THEN 0 ELSE {pdf} / ({s} * {v} * SQRT({t})) END)",
        "theta": f"(CASE WHEN {over} THEN 0 ELSE (-({s} * {pdf} * {v}) / (2 * SQRT({t})) + {r} * {disc} * "
                 f"CASE WHEN {call} THEN -{n2} ELSE 1 - {n2} END) / 365 END)",
        "vega": f"(CASE WHEN {over} THEN 0 ELSE {s} * {pdf} * SQRT({t}) / 100 END)",
        "rho": f"(CASE WHEN {over} THEN 0 WHEN {call} THEN {disc} * {t} * {n2} / 100 ELSE -{disc} * {t} * (1 - {n2}) / 100 END)",
    }


def cdf_columns(s, k, t, r, v) -> dict[str, str]:
    """d1 first, then its distribution values, so the long formula is written once per row."""
    return {"d1": d1(s, k, t, r, v), "d2": f"(d1 - {v} * SQRT({t}))"}


def cdf_values() -> dict[str, str]:
    return {"n1": norm_cdf("d1"), "n2": norm_cdf("d2")}
