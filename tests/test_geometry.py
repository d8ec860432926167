import numpy as np

from quercus.operators import geometry


def test_inliers(spark):
    rng = np.random.default_rng(1)
    h = np.array([[1.1, 0.1, 5.0], [-0.05, 0.9, 9.0], [1e-4, 2e-4, 1.0]])
    a = rng.uniform(0, 400, (40, 2))
    p = np.column_stack([a, np.ones(40)]) @ h.T
    b = p[:, :2] / p[:, 2:]
    b[30:] = rng.uniform(0, 400, (10, 2))
    rows = [(1, "x", *map(float, [*q, *t])) for q, t in zip(a, b, strict=True)] + [(1, "y", 1.0, 1.0, 2.0, 2.0)] * 3
    got = {r.slug: (r.inliers, r.matches) for r in geometry.verified(spark.createDataFrame(rows, "query_id int, slug string, qx double, qy double, tx double, ty double")).collect()}
    assert 30 <= got["x"][0] <= 32 and got["x"][1] == 40 and got["y"] == (0, 3)
    assert np.allclose(geometry.homography(a[:30], b[:30]), h, atol=1e-6)
    assert geometry.inliers(np.zeros((5, 2)), np.zeros((5, 2))) in range(6)
