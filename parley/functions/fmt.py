"""Fixed-point text with Python/C rounding: half-to-even on the *exact* binary value.

Java's ``%.4f`` rounds half-up on the shortest decimal form (0.90625 -> 0.9063,
Python gives 0.9062). Here x * 10^d is split into p + err exactly (Dekker's
two-product), so ties and near-ties are decided on the exact value.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_SPLITTER = 134217729.0  # 2^27 + 1


def _split(a: Column):
    c = F.lit(_SPLITTER) * a
    hi = c - (c - a)
    return hi, a - hi


def fixed(x, digits: int = 4) -> Column:
    xc = F.col(x) if isinstance(x, str) else x
    ax = F.abs(xc)
    s = float(10**digits)
    p = ax * F.lit(s)
    xh, xl = _split(ax)
    sh, sl = _split(F.lit(s))
    err = ((xh * sh - p) + xh * sl + xl * sh) + xl * sl
    f = F.floor(p)
    frac = p - f
    up = (frac > 0.5) | ((frac == 0.5) & ((err > 0) | ((err == 0) & (F.pmod(f, F.lit(2)) == 1))))
    n = (f + F.when(up, 1).otherwise(0)).cast("bigint")
    body = F.concat(
        F.floor(n / F.lit(10**digits)).cast("bigint").cast("string"),
        F.lit("."),
        F.lpad(F.pmod(n, F.lit(10**digits)).cast("string"), digits, "0"),
    )
    return F.when(xc.isNull(), F.lit(None)).otherwise(F.concat(F.when(xc < 0, F.lit("-")).otherwise(F.lit("")), body))


def mean_std_text(mean, std, digits: int = 4) -> Column:
    """``mean (+/- std)`` with four decimals."""
    return F.concat(fixed(mean, digits), F.lit(" (+/- "), fixed(std, digits), F.lit(")"))
