"""Random numbers that depend on row content only.

``rand(seed)`` changes with partitioning and with task retries. Hashing the row's
own key gives the same draw on any cluster layout, and any engine with MD5 can
reproduce it.
"""

from __future__ import annotations

from pyspark.sql import Column, functions as F

_HEX_DIGITS = 12
_SPAN = float(16**_HEX_DIGITS)


def uniform(*parts: Column | str | int) -> Column:
    """Uniform double strictly inside (0, 1) from the joined text of ``parts``.

    Python strings and ints are literals (salt, epoch); pass columns as ``Column``.
    """
    cols = [p if isinstance(p, Column) else F.lit(str(p)) for p in parts]
    text = F.concat_ws(":", *[c.cast("string") for c in cols])
    digits = F.conv(F.substring(F.md5(text), 1, _HEX_DIGITS), 16, 10)
    return (digits.cast("double") + F.lit(0.5)) / F.lit(_SPAN)


def gumbel(log_weight: Column, u: Column) -> Column:
    """Gumbel-perturbed log weight; the k largest are a weighted sample without replacement."""
    return log_weight - F.log(-F.log(u))
