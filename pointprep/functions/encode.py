"""Vector-valued column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

from pointprep.functions.scalar import as_col

ROTARY_DIMS = (22, 22, 20)
ROTARY_BASE = 100.0
REGISTER_TOKENS = 16


def leaf_vector(stats: Column, sdf: Column, grad: Sequence[Column], curv_mean: Column, curv_gauss: Column,
                centre: Sequence[Column], distances: Column) -> Column:
    """One array per leaf: 21 statistics, sdf, gradient, two curvatures, centre, 16 ray features."""
    return F.concat(stats, F.array(sdf, *grad, curv_mean, curv_gauss, *centre), distances)


def fourier(inputs: Sequence[Column | str], freqs: int = 10) -> Column:
    """The inputs, then per input its ``freqs`` sines followed by its cosines."""
    cols = [as_col(c) for c in inputs]
    omega = [F.lit(2.0**k * math.pi) for k in range(freqs)]
    # Spelled out rather than as a lambda over an array, which would leave generated code.
    waves = [fn(c * w) for c in cols for fn in (F.sin, F.cos) for w in omega]
    return F.array(*cols, *waves)


def rotary_angles(pos: Sequence[Column | str], scale: Sequence[Column | float],
                  dims: Sequence[int] = ROTARY_DIMS, base: float = ROTARY_BASE) -> Column:
    """Angle per pair: axes in order, dims/2 pairs each."""
    angles = []
    for c, s, d in zip(pos, scale, dims):
        s = s if isinstance(s, Column) else F.lit(float(s))
        angles += [as_col(c) * F.lit(1.0 / base ** (2.0 * i / d)) * s for i in range(d // 2)]
    return F.array(*angles)
