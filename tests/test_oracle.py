"""Every registered query against its SQL on the smallest tables."""

import pytest

from compare import connect, difference
from pointprep.registry import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    return connect(SF)


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_query(spark, duck, name):
    df = QUERIES[name](spark, SF)
    if name in ORACLES:
        rows, why = difference(df, duck, ORACLES[name])
        assert why is None, why
    else:
        assert df.count() > 0


HOT = ["manifest", "mad_scores", "manifest_summary", "gumbel_topk", "uniform_sample", "query_slots", "axis_scale",
       "slice_stats", "knn_points", "knn_self", "nearest_centroid", "idw_interpolate", "dbscan_labels", "lloyd_step",
       "oversample_fill", "batches", "median_case", "curvature", "ray_distance"]


@pytest.mark.parametrize("name", HOT)
def test_query_with_heavy_groups(spark, duck, hot, name):
    hot(7)
    rows, why = difference(QUERIES[name](spark, SF), duck, ORACLES[name])
    assert why is None, why
