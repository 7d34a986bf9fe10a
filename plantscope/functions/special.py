"""Special functions Spark lacks.

Column forms (``ln_gamma``, ``digamma``, ``normal_cdf``, …) stay in the JVM. The incomplete gamma
and beta functions have no closed form; their numpy versions serve Arrow batches and the few
scalars a test statistic needs.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

SHIFT = 10

# fixed values: coefficients of the double-precision rational approximation of the normal
# distribution function by Hart, as published by West (2005)
NORMAL_NUM = (
    3.52624965998911e-02, 0.700383064443688, 6.37396220353165, 33.912866078383,
    112.079291497871, 221.213596169931, 220.206867912376,
)
NORMAL_DEN = (
    8.83883476483184e-02, 1.75566716318264, 16.064177579207, 86.7807322029461,
    296.564248779674, 637.333633378831, 793.826512519948, 440.413735824752,
)
# fixed values: coefficients of Acklam's published rational approximation of the normal quantile
QUANTILE_A = (-3.969683028665376e01, 2.209460984245205e02, -2.759285104469687e02, 1.383577518672690e02, -3.066479806614716e01, 2.506628277459239)
QUANTILE_B = (-5.447609879822406e01, 1.615858368580409e02, -1.556989798598866e02, 6.680131188771972e01, -1.328068155288572e01, 1.0)
QUANTILE_C = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
QUANTILE_D = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)


def _poly(coefs, x: str) -> str:
    out = repr(coefs[0])
    for c in coefs[1:]:
        out = f"({out}*{x}+{c!r})"
    return out


def normal_cdf_sql(x: str) -> str:
    """Normal distribution function as SQL text, valid in Spark and in other engines."""
    a = f"abs({x})"
    near = f"exp(-{a}*{a}/2.0D0)*{_poly(NORMAL_NUM, a)}/{_poly(NORMAL_DEN, a)}"
    far = f"exp(-{a}*{a}/2.0D0)/(({a}+1.0D0/({a}+2.0D0/({a}+3.0D0/({a}+4.0D0/({a}+0.65D0)))))*2.506628274631D0)"
    tail = f"(CASE WHEN {a} > 37 THEN 0.0D0 WHEN {a} < 7.07106781186547D0 THEN {near} ELSE {far} END)"
    text = f"(CASE WHEN {x} > 0 THEN 1.0D0 - {tail} ELSE {tail} END)"
    return text.replace("D0", "e0")


def normal_quantile_sql(p: str) -> str:
    """Normal quantile as SQL text (relative error below 1.2e-9)."""

    def tail(q: str) -> str:
        return f"({_poly(QUANTILE_C, q)})/({_poly(QUANTILE_D, q)})"

    low, high = f"sqrt(-2e0*ln({p}))", f"sqrt(-2e0*ln(1e0-({p})))"
    r = f"(({p})-0.5e0)"
    middle = f"({_poly(QUANTILE_A, f'({r}*{r})')})*{r}/({_poly(QUANTILE_B, f'({r}*{r})')})"
    return f"(CASE WHEN {p} < 0.02425e0 THEN {tail(low)} WHEN {p} > 0.97575e0 THEN -({tail(high)}) ELSE {middle} END)"


def normal_cdf(name: str) -> Column:
    """Of a named column."""
    return F.expr(normal_cdf_sql(f"`{name}`"))


def normal_quantile(name: str) -> Column:
    return F.expr(normal_quantile_sql(f"`{name}`"))


def _shifted_sum(x: Column, term) -> Column:
    out = term(x)
    for i in range(1, SHIFT):
        out = out + term(x + i)
    return out


def ln_gamma(x: Column) -> Column:
    """ln Gamma for x > 0: Stirling's series at x + SHIFT, brought back by the recurrence."""
    z = x + SHIFT
    series = 1 / (12 * z) - 1 / (360 * F.pow(z, F.lit(3))) + 1 / (1260 * F.pow(z, F.lit(5))) - 1 / (1680 * F.pow(z, F.lit(7)))
    stirling = (z - 0.5) * F.ln(z) - z + 0.5 * math.log(2 * math.pi) + series
    return stirling - _shifted_sum(x, F.ln)


def digamma(x: Column) -> Column:
    z = x + SHIFT
    series = 1 / (12 * z * z) - 1 / (120 * F.pow(z, F.lit(4))) + 1 / (252 * F.pow(z, F.lit(6))) - 1 / (240 * F.pow(z, F.lit(8)))
    return F.ln(z) - 1 / (2 * z) - series - _shifted_sum(x, lambda v: 1 / v)


def trigamma(x: Column) -> Column:
    z = x + SHIFT
    series = 1 / (2 * z * z) + 1 / (6 * F.pow(z, F.lit(3))) - 1 / (30 * F.pow(z, F.lit(5))) + 1 / (42 * F.pow(z, F.lit(7)))
    return 1 / z + series + _shifted_sum(x, lambda v: 1 / (v * v))


# -- numpy forms ------------------------------------------------------------------------

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def gamma_p(a, x):
    """Regularised lower incomplete gamma, by series below a + 1 and continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.zeros(a.shape)
    pos = x > 0
    with np.errstate(all="ignore"):
        front = np.exp(-x + a * np.log(np.where(pos, x, 1.0)) - _lgamma(a))
        low = pos & (x < a + 1)
        if low.any():
            al, xl = a[low], x[low]
            term = 1.0 / al
            total, n = term.copy(), 1
            while n < 20_000:
                term = term * xl / (al + n)
                total += term
                n += 1
                if np.all(np.abs(term) <= 1e-16 * np.abs(total)):
                    break
            else:
                raise ArithmeticError("the incomplete gamma series did not converge")
            out[low] = total * front[low]
        high = pos & ~low
        if high.any():
            ah, xh = a[high], x[high]
            b = xh + 1 - ah
            c, d = np.full(xh.shape, 1e300), 1 / b
            h = d.copy()
            for i in range(1, 20_000):
                an = -i * (i - ah)
                b = b + 2
                d = 1 / np.where(np.abs(an * d + b) < 1e-300, 1e-300, an * d + b)
                c = np.where(np.abs(b + an / c) < 1e-300, 1e-300, b + an / c)
                step = c * d
                h = h * step
                if np.all(np.abs(step - 1) < 1e-15):
                    break
            else:
                raise ArithmeticError("the incomplete gamma fraction did not converge")
            out[high] = 1 - front[high] * h
    return np.clip(out, 0.0, 1.0)


def beta_i(a, b, x):
    """Regularised incomplete beta by continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, t = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(t) + q * np.log1p(-t)) / p
        c = np.ones(t.shape)
        d = 1 - (p + q) * t / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        h = d.copy()
        for m in range(1, 20_000):
            for num in (
                m * (q - m) * t / ((p + 2 * m - 1) * (p + 2 * m)),
                -(p + m) * (p + q + m) * t / ((p + 2 * m) * (p + 2 * m + 1)),
            ):
                d = 1 + num * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + num / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                step = c * d
                h = h * step
            if np.all(np.abs(step - 1)[(t > 0) & np.isfinite(step)] < 1e-14):
                break
        else:
            raise ArithmeticError("the incomplete beta fraction did not converge")
        val = front * h
    val = np.where(t <= 0, 0.0, val)
    return np.clip(np.where(swap, 1 - val, val), 0.0, 1.0)


def f_tail(f: float, d1: float, d2: float) -> float:
    """P(F > f)."""
    return 1.0 if f <= 0 else float(beta_i(d2 / 2, d1 / 2, d2 / (d2 + d1 * f)))


def t_two_sided(t: float, df: float) -> float:
    return float(beta_i(df / 2, 0.5, df / (df + t * t)))


def t_quantile(p: float, df: float) -> float:
    """Student t quantile for 0.5 < p < 1, by bisection on the tail."""
    low, high = 0.0, 1.0
    while 1 - t_two_sided(high, df) / 2 < p:
        high *= 2
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if 1 - t_two_sided(mid, df) / 2 < p else (low, mid)
    return (low + high) / 2


@F.pandas_udf(T.DoubleType())
def gamma_cdf(shape: pd.Series, x: pd.Series) -> pd.Series:
    """Regularised lower incomplete gamma over Arrow batches."""
    return pd.Series(gamma_p(shape.to_numpy(float), x.to_numpy(float)))


@F.pandas_udf(T.DoubleType())
def beta_cdf(a: pd.Series, b: pd.Series, x: pd.Series) -> pd.Series:
    return pd.Series(beta_i(a.to_numpy(float), b.to_numpy(float), x.to_numpy(float)))
