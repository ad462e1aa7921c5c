"""Operators on small made tables."""

import numpy as np

from trialgrid.operators import series
from trialgrid.plans.statistics import decode_permutation_p_200


def test_nearest_has_no_bound(spark):
    rng = np.random.RandomState(2)
    cloud = [(i, *map(float, p)) for i, p in enumerate(rng.normal(size=(60, 3)) * 30)] + [(90, 5.0, 5.0, 5.0), (91, 5.0, 5.0, 5.0)]
    queries = [(100 + i, *map(float, p)) for i, p in enumerate(rng.normal(size=(40, 3)) * 60)] + [(200, 1e6, -1e6, 3.0), (201, 5.0, 5.0, 5.0), (202, None, 0.0, 0.0)]
    schema = "id long, x double, y double, z double"
    q, c = spark.createDataFrame(queries, schema), spark.createDataFrame(cloud, schema)
    want = {i: min((np.sqrt((x - a) ** 2 + (y - b) ** 2 + (z - d) ** 2), j) for j, a, b, d in cloud)[1] for i, x, y, z in queries if x is not None}
    assert {r.id: r.vid for r in series.nearest(q, c, 0.5).collect()} == want
    assert series.nearest(q, c.limit(0), 0.5).count() == 0


def test_strong_effect_passes_the_gate(spark, tmp_path):
    rng = np.random.RandomState(3)
    rows = [(i, i % 2, [float(x) for x in rng.normal(size=4) + 4 * (i % 2)]) for i in range(60)]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = decode_permutation_p_200(spark, str(tmp_path)).first()
    assert got.observed >= 0.95 and abs(got.p - 1 / 201) < 1e-5
