"""Geometric verification of matched points."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Pixels that a point may be off, draws, and the matches that a homography needs.
TOLERANCE, DRAWS, FEWEST = 5.0, 200, 4


def homography(a: np.ndarray, b: np.ndarray) -> np.ndarray | None:
    """The matrix that takes points a to b (least squares over normalised points); null if they don't determine one."""

    def normal(p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        centre = p.mean(axis=0)
        spread = np.sqrt(((p - centre) ** 2).sum(axis=1)).mean() or 1.0
        scale = np.sqrt(2) / spread
        return np.array([[scale, 0, -scale * centre[0]], [0, scale, -scale * centre[1]], [0, 0, 1]]), (p - centre) * scale

    ta, x = normal(a)
    tb, y = normal(b)
    n = len(x)
    one, zero = np.ones(n), np.zeros((n, 3))
    source = np.column_stack([x, one])
    rows = np.vstack([np.hstack([source, zero, -y[:, :1] * source]), np.hstack([zero, source, -y[:, 1:] * source])])
    try:
        h = np.linalg.svd(rows)[2][-1].reshape(3, 3)
        full = np.linalg.inv(tb) @ h @ ta
    except np.linalg.LinAlgError:
        return None
    return full / full[2, 2] if abs(full[2, 2]) > 1e-12 else None


def inliers(a: np.ndarray, b: np.ndarray) -> int:
    """Most points within the tolerance of one homography, by draws of four that the points themselves seed; 0 for fewer than four."""
    n = len(a)
    if n < FEWEST:
        return 0
    rng = np.random.default_rng(int(abs(np.round(np.concatenate([a, b]).sum(), 3)) * 1000) % (1 << 32))
    homogeneous = np.column_stack([a, np.ones(n)])
    best = 0
    for _ in range(DRAWS):
        some = rng.choice(n, 4, replace=False)
        h = homography(a[some], b[some])
        if h is None:
            continue
        moved = homogeneous @ h.T
        with np.errstate(divide="ignore", invalid="ignore"):
            off = np.sqrt(((moved[:, :2] / moved[:, 2:] - b) ** 2).sum(axis=1))
        best = max(best, int((off <= TOLERANCE).sum()))
        if best == n:
            break
    return best


def verified(matches: DataFrame) -> DataFrame:
    """query_id, slug, inliers, matches from one-to-one matches (query_id, slug, qx, qy, tx, ty); a group has a picture's key points at most."""
    kinds = {c: matches.schema[c].dataType.simpleString() for c in ("query_id", "slug")}

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["qx", "qy", "tx", "ty"])
        count = inliers(group[["qx", "qy"]].to_numpy(float), group[["tx", "ty"]].to_numpy(float))
        return pd.DataFrame({"query_id": [group["query_id"].iloc[0]], "slug": [group["slug"].iloc[0]], "inliers": [count], "matches": [len(group)]})

    return matches.groupBy("query_id", "slug").applyInPandas(run, f"query_id {kinds['query_id']}, slug {kinds['slug']}, inliers bigint, matches bigint")
