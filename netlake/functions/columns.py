"""Column helpers shared by the operators (all JVM-side expressions)."""
from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def round_bin(x: Column, digits: int) -> Column:
    """Round a double on its binary value: sign(x) * floor(|x| * 10^d + 0.5) / 10^d.

    Spark's ``round`` rounds the shortest decimal text of the double half-up,
    so 0.5045 (binary 0.50449999...) becomes 0.505; Python and DuckDB give
    0.504.  This form follows the binary value.
    """
    m = F.lit(float(10 ** digits))
    xd = x.cast("double")
    return F.signum(xd) * F.floor(F.abs(xd) * m + F.lit(0.5)) / m


def clip(x: Column, lo: float, hi: float) -> Column:
    """F8: saturate to [lo, hi]."""
    return F.least(F.greatest(x, F.lit(lo)), F.lit(hi))


def payload_text(data: Column, max_chars: int = 300) -> Column:
    """bytes -> UTF-8 text (malformed bytes become U+FFFD), first ``max_chars`` characters."""
    return F.substring(F.decode(data, "UTF-8"), 1, max_chars)
