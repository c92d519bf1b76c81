"""Target tables as explicit schemas."""

from __future__ import annotations

from pyspark.sql.types import (
    BooleanType,
    DoubleType,
    LongType,
    StringType,
    StructField,
    StructType,
)


def _table(**columns) -> StructType:
    return StructType([StructField(n, t, True) for n, t in columns.items()])


_L, _D, _S, _B = LongType(), DoubleType(), StringType(), BooleanType()

POINTS = _table(
    case_id=_S, point_id=_L, is_surface=_B, x=_D, y=_D, z=_D, sdf=_D, gx=_D, gy=_D, gz=_D,
    ux=_D, uy=_D, uz=_D, p=_D, nut=_D, wss_x=_D, wss_y=_D, wss_z=_D, area=_D,
)
#: What preparation adds to the points.
POINT_FEATURES = _table(curv_mean=_D, curv_gauss=_D, leaf_id=_L, log_weight=_D)
VERTICES = _table(case_id=_S, vertex_id=_L, x=_D, y=_D, z=_D)
FACES = _table(case_id=_S, face_id=_L, v0=_L, v1=_L, v2=_L)
FACE_CENTERS = _table(case_id=_S, face_id=_L, x=_D, y=_D, z=_D)
LEAF_POINTS = _table(case_id=_S, leaf_id=_L, rank=_L, point_id=_L, dist=_D)
LEAF_LEAVES = _table(case_id=_S, leaf_id=_L, rank=_L, nbr_leaf_id=_L, dist=_D)
NORM_STATS = _table(feature=_S, channel=_L, n=_L, mean=_D, std=_D)
ROPE_SCALE = _table(sub_bin=_S, axis=_S, scale=_D)
MANIFEST = _table(case_name=_S, sub_bin=_S, n_buildings=_L, n_volume=_L, n_surface=_L, split=_S)
PREDICTIONS = _table(case_id=_S, point_id=_L, channel=_S, pred_z=_D, target_z=_D)
METRICS = _table(case_id=_S, metric=_S, value=_D)

# Normalised groups with their channel counts, 39 channels in all.
FEATURE_GROUPS = {
    "vol": 5, "surf": 1, "pt_sdf": 1, "pt_sdfg": 3, "pt_cm": 1, "pt_cg": 1,
    "leaf_sdf": 1, "leaf_sdfg": 3, "leaf_cm": 1, "leaf_cg": 1, "leaf_stats": 21,
}
FORBIDDEN_LEFTOVER = ("original_sdf_volume",)
