"""Column expressions on single rows. All stay inside code generation."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, functions as F

# Constants, cut-offs and per-stratum parameters that results depend on.
COORD_MAX = 550.0
GRAVITY = 9.81
SDF_MAX = 1100.0
SDF_BASE_WIDTH = 3.125
RANGE_CUTS = ((19, "0-19"), (39, "20-39"), (59, "40-59"), (79, "60-79"))
RANGE_LAST = "80-123"
STRATA = (
    "0-19_easy", "0-19_hard", "20-39_easy", "20-39_hard", "40-59_easy",
    "40-59_hard", "60-79_easy", "60-79_hard", "80-123_easy", "80-123_hard",
)
LEAVES_PER_STRATUM = {s: 8192 * (i + 1) for i, s in enumerate(STRATA)}
DEFAULT_LEAVES = 40960
BATCH_PER_STRATUM = dict(zip(STRATA, (4, 4, 4, 4, 2, 2, 2, 1, 1, 1)))
DEFAULT_BATCH = 1
# Importance by signed distance: below ``until`` the weight is
# ``start + rise * (sdf - at) / width``; the last piece never falls below 0.1.
WEIGHT_PIECES = (
    # until, start, rise, at, width
    (-3.0, 0.05, 0.0, 0.0, 1.0),
    (0.0, 6.0, 0.0, 0.0, 1.0),
    (1.5, 6.0, 2.0, 0.0, 1.5),
    (2.5, 8.0, 0.0, 0.0, 1.0),
    (5.0, 8.0, -2.0, 2.5, 2.5),
    (50.0, 6.0, -3.0, 5.0, 45.0),
    (80.0, 3.0, -2.5, 50.0, 30.0),
)
WEIGHT_LAST = (0.5, -0.3, 80.0, 300.0)
WEIGHT_FLOOR = 0.1


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def nan_to_null(c: Column | str) -> Column:
    c = as_col(c)
    return F.when(~F.isnan(c), c)


def floored_log(c: Column | str, floor: float) -> Column:
    return F.log(F.greatest(as_col(c), F.lit(floor)))


def log_abs(c: Column | str, floor: float = 1e-30) -> Column:
    return floored_log(F.abs(as_col(c)), floor)


def clip(c: Column | str, low: float, high: float) -> Column:
    return F.greatest(F.least(as_col(c), F.lit(high)), F.lit(low))


def magnitude(*parts: Column | str) -> Column:
    cols = [as_col(p) for p in parts]
    total = cols[0] * cols[0]
    for c in cols[1:]:
        total = total + c * c
    return F.sqrt(total)


def range_label(n: Column | str) -> Column:
    n = as_col(n)
    out = F
    for top, label in RANGE_CUTS:
        out = out.when(n <= top, label)
    return out.otherwise(RANGE_LAST)


def sdf_bin_edges(bins: int = 15, base: float = SDF_BASE_WIDTH) -> list[float]:
    """Inner edges: widths grow linearly from twice the base width."""
    edges, reach = [], 0
    for width in range(2, bins + 1):
        reach += width
        edges.append(base * reach)
    return edges


def sdf_bin(sdf: Column | str, edges: Sequence[float] | None = None, top: float = SDF_MAX) -> Column:
    """Left-closed bin number from 0; NULL for NaN, NULL and values from ``top`` on."""
    sdf = as_col(sdf)
    edges = sdf_bin_edges() if edges is None else list(edges)
    out = F.when(sdf.isNull() | F.isnan(sdf) | (sdf >= top), F.lit(None).cast("int"))
    for i, edge in enumerate(edges):
        out = out.when(sdf < edge, F.lit(i))
    return out.otherwise(F.lit(len(edges)))


def sample_weight(sdf: Column | str) -> Column:
    sdf = as_col(sdf)
    start, rise, at, width = WEIGHT_LAST
    out = F
    for until, s, rs, a, w in WEIGHT_PIECES:
        value = F.lit(s) if rs == 0.0 else F.lit(s) + F.lit(rs) * (sdf - F.lit(a)) / F.lit(w)
        out = out.when(sdf < until, value)
    return out.otherwise(
        F.greatest(F.lit(start) + F.lit(rise) * (sdf - F.lit(at)) / F.lit(width), F.lit(WEIGHT_FLOOR))
    )


def log_sample_weight(sdf: Column | str) -> Column:
    return floored_log(sample_weight(sdf), 1e-10)


def standardise(x: Column | str, mean: Column | float, std: Column | float) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    std = std if isinstance(std, Column) else F.lit(float(std))
    return (as_col(x) - mean) / F.greatest(std, F.lit(1e-8))


def unstandardise(z: Column | str, mean: Column | float, std: Column | float) -> Column:
    mean = mean if isinstance(mean, Column) else F.lit(float(mean))
    std = std if isinstance(std, Column) else F.lit(float(std))
    return as_col(z) * std + mean


def detrend(p: Column | str, z: Column | str, g: float = GRAVITY) -> Column:
    return as_col(p) + F.lit(g) * as_col(z)


def retrend(p: Column | str, z: Column | str, g: float = GRAVITY) -> Column:
    return as_col(p) - F.lit(g) * as_col(z)


def lookup(key: Column | str, table: dict, default) -> Column:
    """Value of a small fixed table, or ``default`` for keys it lacks."""
    entries = [F.lit(x) for pair in table.items() for x in pair]
    return F.coalesce(F.element_at(F.create_map(*entries), as_col(key)), F.lit(default))


def query_split(n_volume: Column | str, n_surface: Column | str, total: int, ratio: float = 2.0) -> tuple[Column, Column]:
    """(volume, surface) query counts; a surface point is ``ratio`` times as likely. Both are clamped."""
    nv, ns = as_col(n_volume), as_col(n_surface)
    share = F.floor(F.lit(float(total)) * ns / (ns + nv / F.lit(ratio))).cast("bigint")
    n_surf = F.least(ns, F.coalesce(share, F.lit(0).cast("bigint")))
    n_vol = F.least(F.lit(total).cast("bigint") - n_surf, nv)
    return n_vol, n_surf


def curriculum_temperature(epoch: int, total_epochs: int, start: float = 3.0, end: float = 1.0) -> float:
    return start - (start - end) * epoch / total_epochs


def curriculum_count(
    n: Column | str,
    stratum_index: Column | str,
    n_strata: int,
    temperature: float,
    floor_ratio: float = 0.3,
    floor_min: int = 3,
) -> Column:
    """Cases drawn from a stratum. Favours low strata throughout, least so at the end."""
    n, i = as_col(n), as_col(stratum_index)
    weight = F.exp(-(i / F.lit(float(max(n_strata - 1, 1)))) * F.lit(temperature))
    floor = F.greatest(F.lit(floor_min).cast("bigint"), F.ceil(F.lit(floor_ratio) * n).cast("bigint"))
    # rint rounds half to even
    return F.least(F.greatest(floor, F.rint(n * weight).cast("bigint")), n)


def bin_weights(bins: int, alpha: float) -> list[float]:
    return [1.0 / math.pow(1 + i, alpha) for i in range(bins)]
