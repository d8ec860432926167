"""Fitting of small models. Gradients are sums over rows and come back as one row; rows never come to the driver."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.functions.tables import forget, written


def scales(rows: DataFrame, features: list[str]) -> dict[str, float]:
    """Population deviation of each feature; 1 where it doesn't vary."""
    row = rows.agg(*(F.stddev_pop(f).alias(f) for f in features)).first()
    return {f: row[f] if row[f] else 1.0 for f in features}


def conditional_logit(rows: DataFrame, features: list[str], query: str = "query_id", label: str = "label", steps: int = 40, l2: float = 1e-3) -> dict[str, float]:
    """Weights of the group softmax by penalised likelihood: rows of a query compete, label 1 marks the right one.

    Newton steps; each reads the rows once and brings back one sum of gradients and Hessians.
    """
    scale = scales(rows, features)
    usable = rows.join(rows.groupBy(query).agg(F.sum(label).alias("__n")).where("__n = 1").select(query), query, "left_semi")
    data = usable.select(query, F.col(label).cast("double").alias("y"), F.array(*(F.col(f).cast("double") / scale[f] for f in features)).alias("x")).groupBy(query).agg(F.collect_list(F.struct("y", "x")).alias("g")).select("g")
    data = written(data, "groups")  # read once for each step
    d, w = len(features), np.zeros(len(features))
    for _ in range(steps):
        now = w.copy()

        def run(batches: Iterator[pa.RecordBatch], now=now) -> Iterator[pa.RecordBatch]:
            total = np.zeros(d + d * d + 1)
            for batch in batches:
                for g in batch.column(0).to_pylist():
                    x = np.array([r["x"] for r in g])
                    y = np.array([r["y"] for r in g])
                    z = x @ now
                    p = np.exp(z - z.max())
                    p /= p.sum()
                    mean = p @ x
                    total[:d] += mean - y @ x
                    total[d:-1] += ((x * p[:, None]).T @ x - np.outer(mean, mean)).ravel()
                    total[-1] += 1
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()])], names=["s"])

        got = data.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).collect()
        sums = np.zeros(d + d * d + 1)
        for r in got:
            sums[r["i"]] = r["v"]
        n = sums[-1] or 1.0
        step = np.linalg.solve(sums[d:-1].reshape(d, d) / n + 2 * l2 * np.eye(d), sums[:d] / n + 2 * l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return {f: float(w[i] / scale[f]) for i, f in enumerate(features)}


def open_set_threshold(found: DataFrame, share: float = 0.03) -> DataFrame:
    """threshold: the quantile of the best probability of known things below which share of them lie."""
    best = found.groupBy("query_id").agg(F.max("p").alias("p1"))
    return best.agg(F.expr(f"percentile(p1, {share})").alias("threshold"), F.count("*").alias("n"))


def without_truth(found: DataFrame, p: str = "p", label: str = "label") -> DataFrame:
    """Probabilities as they would be if the right answer were unknown: its row goes, the others are scaled to 1."""
    return found.where(F.col(label) == 0).withColumn(p, F.col(p) / F.sum(p).over(Window.partitionBy("query_id")))


def swapped_siblings(rows: DataFrame, visual: list[str], most: int = 6) -> DataFrame:
    """For each right row one copy with the visual features of a sibling among its query's most best, chosen by hash."""
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc(visual[0]), "slug"))
    others = rows.where("label = 0").withColumn("__n", place).where(F.col("__n") <= most)
    one = others.groupBy("query_id").agg(F.min_by(F.struct(*visual), F.sha2(F.concat_ws("|", F.col("query_id").cast("string"), F.col("slug").cast("string")), 256)).alias("__s"))
    return rows.where("label = 1").join(one, "query_id").withColumns({v: F.col(f"__s.{v}") for v in visual}).drop("__s")


def calibration(found: DataFrame, at: float = 0.8) -> DataFrame:
    """Of answers with probability at or more: n and precision."""
    return found.where(F.col("p1") >= at).agg(F.count("*").alias("n"), F.avg(F.col("correct").cast("double")).alias("precision"))


def weighted_logistic(rows: DataFrame, features: list[str], label: str = "label", held_out: str = "id", sweep: int = 99) -> DataFrame:
    """held_out id, probability by a class-balanced logistic regression on all other rows (each id is left out once).

    For the few hundred labelled rows of an open-set calibration: the rows are broadcast behind a check of their number.
    """
    data = rows.select(held_out, label, *features).limit(100_001).toPandas()
    if len(data) > 100_000:
        raise ValueError("leave-one-out is for at most 100,000 rows")
    shipped = rows.sparkSession.sparkContext.broadcast((data[held_out].to_numpy(), data[label].to_numpy(float), data[features].to_numpy(float)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, y, x = shipped.value
        for batch in batches:
            out = []
            for i in batch.column(0).to_pylist():
                w = _fit(x[ids != i], y[ids != i])
                own = np.concatenate([x[ids == i], np.ones((int((ids == i).sum()), 1))], axis=1)
                out.append(float(1 / (1 + np.exp(-own @ w)).mean()))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out)], names=[held_out, "p"])

    ids = rows.select(held_out).distinct()
    return ids.mapInArrow(run, f"{held_out} {ids.schema[0].dataType.simpleString()}, p double")


#: Most values of a gallery that fit_adapter() sends to every task.
GALLERY_VALUES = 64 << 20


def adapter(queries: DataFrame, gallery: DataFrame, steps: int = 60, l2: float = 1.0, rate: float = 1e-3, scale: float = 30.0, slug: str = "slug", vector: str = "embedding") -> np.ndarray:
    """A matrix, applied to queries and gallery before both are scaled to unit length, that draws queries (vector, slug) to the gallery's entry of their slug (slug once each).

    Softmax over the whole gallery of scaled cosines, pulled to the identity by l2, Adam from the identity on; the scale is fitted,
    too. A step reads the queries once where they lie and brings back one gradient. A gallery beyond GALLERY_VALUES is an error.
    """
    names = [r[0] for r in gallery.select(slug).where(F.col(vector).isNotNull()).orderBy(slug).toLocalIterator()]
    g = np.array([r[0] for r in gallery.where(F.col(vector).isNotNull()).orderBy(slug).select(vector).toLocalIterator()], dtype=np.float64).reshape(len(names), -1)
    if g.size > GALLERY_VALUES:
        raise ValueError(f"a gallery of {g.shape} is too large to send")
    place = {n: i for i, n in enumerate(names)}
    d = g.shape[1]
    spark = gallery.sparkSession
    known = written(queries.where(F.col(vector).isNotNull() & F.col(slug).isNotNull()).select(slug, vector), "queries")
    w, log_scale = np.eye(d), math.log(scale)
    moment, square = np.zeros(d * d + 1), np.zeros(d * d + 1)
    for step in range(1, steps + 1):
        shipped = spark.sparkContext.broadcast((g, place, w, log_scale))

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            g, place, w, log_scale = shipped.value
            total, n = np.zeros(d * d + 1), 0
            gw = g @ w
            g_norm = np.maximum(1e-12, np.linalg.norm(gw, axis=1, keepdims=True))
            gu = gw / g_norm
            for batch in batches:
                y = np.array([place.get(s, -1) for s in batch.column(0).to_pylist()], dtype=np.int64)
                x = np.array(batch.column(1).to_pylist(), dtype=np.float64).reshape(len(y), -1)[y >= 0] if len(y) else np.empty((0, d))
                y = y[y >= 0]
                if not len(y):
                    continue
                xw = x @ w
                x_norm = np.maximum(1e-12, np.linalg.norm(xw, axis=1, keepdims=True))
                xu = xw / x_norm
                cosine = xu @ gu.T
                z = cosine * math.exp(log_scale)
                p = np.exp(z - z.max(axis=1, keepdims=True))
                p /= p.sum(axis=1, keepdims=True)
                p[np.arange(len(y)), y] -= 1.0  # the loss's slope in z
                total[-1] += float((p * z).sum())
                p *= math.exp(log_scale)
                dx, dg = p @ gu, p.T @ xu
                dx = (dx - xu * (dx * xu).sum(axis=1, keepdims=True)) / x_norm
                dg = (dg - gu * (dg * gu).sum(axis=1, keepdims=True)) / g_norm
                total[:-1] += (x.T @ dx + g.T @ dg).ravel()
                n += len(y)
            yield pa.RecordBatch.from_arrays([pa.array([[*total.tolist(), float(n)]])], names=["s"])

        sums = np.zeros(d * d + 2)
        for r in known.mapInArrow(run, "s array<double>").select(F.posexplode("s").alias("i", "v")).groupBy("i").agg(F.sum("v").alias("v")).toLocalIterator():
            sums[r["i"]] = r["v"]
        shipped.destroy()
        if not sums[-1]:
            break
        slope = sums[:-1] / sums[-1]
        slope[:-1] += (2 * l2 / d) * (w - np.eye(d)).ravel()
        moment, square = 0.9 * moment + 0.1 * slope, 0.999 * square + 0.001 * slope**2
        move = rate * (moment / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.999**step)) + 1e-8)
        w, log_scale = w - move[:-1].reshape(d, d), log_scale - float(move[-1])
    forget(known)
    return w


def _fit(x: np.ndarray, y: np.ndarray, l2: float = 1e-2) -> np.ndarray:
    x = np.concatenate([x, np.ones((len(x), 1))], axis=1)
    c = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y <= 0).sum()))
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (c * p * (1 - p))[:, None]).T @ x + l2 * np.eye(len(w)), x.T @ (c * (p - y)) + l2 * w)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return w


def split_weights(text: str) -> dict[str, float]:
    """train=0.8,test=0.2 as a map; the shares must sum to 1."""
    out = {}
    for part in text.split(","):
        name, sep, value = part.partition("=")
        if not sep or not name.strip() or name.strip() in out or float(value) < 0:
            raise ValueError(f"bad split weights: {text}")
        out[name.strip()] = float(value)
    if abs(sum(out.values()) - 1) > 1e-9:
        raise ValueError(f"split weights must sum to 1: {text}")
    return out


def threshold_sweep(scored: DataFrame, steps: int = 99) -> DataFrame:
    """threshold, kept (share of label 1 at or above), rejected (share of label 0 below), balanced; one pass over p and label."""
    at = F.explode(F.sequence(F.lit(1), F.lit(steps)))
    n = scored.agg(F.count_if(F.col("label") == 1).alias("ones"), F.count_if(F.col("label") == 0).alias("zeros"))
    bins = scored.groupBy(F.least(F.floor(F.col("p") * (steps + 1)), F.lit(steps)).alias("bin")).agg(F.count_if(F.col("label") == 1).alias("a"), F.count_if(F.col("label") == 0).alias("b"))
    table = n.select("ones", "zeros", at.alias("step")).join(bins, F.col("bin") >= F.col("step"), "left").groupBy("step", "ones", "zeros").agg(F.coalesce(F.sum("a"), F.lit(0)).alias("a"), F.coalesce(F.sum("b"), F.lit(0)).alias("b"))
    kept, rejected = F.col("a") / F.nullif("ones", F.lit(0)), 1 - F.col("b") / F.nullif("zeros", F.lit(0))
    return table.select((F.col("step") / (steps + 1)).alias("threshold"), kept.alias("kept"), rejected.alias("rejected"), ((kept + rejected) / 2).alias("balanced"))
