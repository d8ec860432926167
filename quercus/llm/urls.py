"""URL filters: host and path rules, and a character language-model ratio for the URLs that no rule fits.

Two variable-order Markov models over a URL's bytes, of accepted and of rejected URLs (those that rules decide), give a
log-likelihood difference per sign. A gram's probability blends its count with that of the shorter gram:
p(c | ctx) = (n(ctx c) + B p(c | shorter ctx)) / (n(ctx) + B). Counts are kept in hashed tables of fixed size. The threshold
is set on decided URLs that the models haven't seen.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import utf8

#: Longest gram, buckets of the hashed counts (of both classes), weight of the shorter gram.
LONGEST, BUCKETS, BLEND = 6, 1 << 19, 2.0
#: One of so many decided URLs is held out for the threshold; scores are binned so finely for it.
FOLDS, BIN = 5, 1 / 64
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class Rule:
    """verdict (allow or block) for a host, its subdomains and paths that begin with path."""

    verdict: str
    host: str
    path: str

    @property
    def name(self) -> str:
        return self.host + self.path


def host_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty for null and for what has no '://'."""
    part = lambda n: F.coalesce(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)([^?#]*)", n), F.lit(""))
    return F.translate(part(1), _UPPER, _LOWER), part(2)


def decided(host: Column, path: Column, rules: list[Rule]) -> tuple[Column, Column]:
    """Name and verdict of the longest rule that fits (of equally long ones the first by name); null if none does."""
    name = verdict = F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r.name), [-ord(c) for c in r.name])):
        fits = ((host == rule.host) | host.endswith("." + rule.host)) & path.startswith(rule.path)
        name, verdict = F.when(fits, rule.name).otherwise(name), F.when(fits, rule.verdict).otherwise(verdict)
    return name, verdict


def grams(urls: list[bytes]) -> tuple[list[np.ndarray], np.ndarray]:
    """For lengths 0 to LONGEST the bucket of the gram that ends at each sign (-1: it would begin before the URL), and each sign's URL."""
    parts = [b"\x02" + u + b"\x03" for u in urls]
    signs = np.frombuffer(b"".join(parts), dtype=np.uint8).astype(np.uint64)
    sizes = np.array([len(p) for p in parts], dtype=np.int64)
    owner = np.repeat(np.arange(len(parts)), sizes)
    place = np.arange(len(signs)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    out = [np.zeros(len(signs), dtype=np.int64)]
    state = np.zeros(len(signs), dtype=np.uint64)
    for n in range(1, LONGEST + 1):
        before = np.concatenate([np.zeros(1, np.uint64), state[:-1]]) if len(signs) else state
        state = (before ^ (signs + np.uint64(1))) * np.uint64(0x9E3779B97F4A7C15)
        state ^= state >> np.uint64(29)
        bucket = ((state + np.uint64(n)) * np.uint64(0xD6E8FEB86659FD93) >> np.uint64(64 - BUCKETS.bit_length() + 1)).astype(np.int64)
        out.append(np.where(place >= n - 1, bucket, -1))
    return out, owner


def _counts(urls: list[bytes]) -> np.ndarray:
    found, _ = grams(urls)
    out = np.zeros(BUCKETS + 1, dtype=np.int64)
    for g in found[1:]:
        out[:-1] += np.bincount(g[g >= 0], minlength=BUCKETS)
    out[-1] = len(found[0])
    return out


def scores(urls: list[bytes], model: np.ndarray) -> np.ndarray:
    """Mean log-likelihood difference (accepted minus rejected) per sign. model: counts, rows accepted and rejected; the last column holds all signs."""
    found, owner = grams(urls)
    difference = np.zeros(len(owner))
    for sign, counts in ((1, model[0]), (-1, model[1])):
        p = np.full(len(owner), 1 / 256)
        for n in range(1, LONGEST + 1):
            whole = found[n]
            context = np.concatenate([[-1], found[n - 1][:-1]]) if n > 1 and len(owner) else np.zeros(len(owner), dtype=np.int64)
            of_context = counts[-1] if n == 1 else counts[context]
            blended = np.minimum(1.0, (counts[whole] + BLEND * p) / (of_context + BLEND))
            p = np.where(whole >= 0, blended, p)
        difference += sign * np.log(np.maximum(p, 1e-30))
    size = np.bincount(owner, minlength=len(urls))
    return np.bincount(owner, weights=difference, minlength=len(urls)) / np.maximum(size, 1)


def fit(urls: DataFrame) -> np.ndarray:
    """Counts over all rows of url, verdict (allow or block)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((2, BUCKETS + 1), dtype=np.int64)
        for batch in batches:
            texts, verdicts = utf8(batch.column(0)).to_pylist(), batch.column(1).to_pylist()
            for i, v in enumerate(("allow", "block")):
                total[i] += _counts([t or b"" for t, x in zip(texts, verdicts, strict=True) if x == v])
        at = np.nonzero(total.any(axis=0))[0]
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[0, at]), pa.array(total[1, at])], names=["bucket", "allowed", "blocked"])

    found = urls.select("url", "verdict").mapInArrow(run, "bucket bigint, allowed bigint, blocked bigint").groupBy("bucket").agg(F.sum("allowed").alias("allowed"), F.sum("blocked").alias("blocked")).toArrow()
    model = np.zeros((2, BUCKETS + 1))
    for i, c in ((0, "allowed"), (1, "blocked")):
        model[i, found["bucket"].to_numpy()] = found[c].to_numpy()
    return model


def _scored(df: DataFrame, model: np.ndarray) -> DataFrame:
    """df (with a column url) with its score."""
    shipped = df.sparkSession.sparkContext.broadcast(model.astype(np.float32))  # of fixed size
    place = df.columns.index("url")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = shipped.value
        for batch in batches:
            found = scores([t or b"" for t in utf8(batch.column(place)).to_pylist()], counts)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=[*batch.schema.names, "score"])

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields]
    return df.mapInArrow(run, ", ".join([*columns, "score double"]))


def threshold(scored: DataFrame) -> float:
    """The score that best parts the held-out URLs (verdict, score): least sum of both error rates; of several the middle. 0 if a class is missing."""
    rows = scored.groupBy(F.floor(F.col("score") / BIN).cast("int").alias("bin"), "verdict").count().collect()  # as many as there are bins
    bins = sorted({r["bin"] for r in rows})
    count = {(r["bin"], r["verdict"]): r["count"] for r in rows}
    total = {v: sum(n for (_, x), n in count.items() if x == v) for v in ("allow", "block")}
    if not all(total.values()):
        return 0.0
    wrong, best = 1.0, []
    for b in [*bins, bins[-1] + 1]:
        best.append((wrong, b))
        wrong += count.get((b, "allow"), 0) / total["allow"] - count.get((b, "block"), 0) / total["block"]
    least = min(w for w, _ in best)
    good = [i for i, (w, _) in enumerate(best) if w <= least + 1e-12]
    # between the last bin below the cut and the first above it
    cut = best[good[0]][1]
    lower = bins[bins.index(cut) - 1] + 1 if cut in bins and bins.index(cut) else cut
    return (lower + cut) / 2 * BIN


def judged(df: DataFrame, rules: list[Rule], id_column: str = "page_id", url_column: str = "url") -> DataFrame:
    """id, host, path, rule, verdict, score, threshold of each row.

    The longest rule that fits decides; without one the score does (allow from the threshold on). A null url counts as
    empty; repeated rows are judged alike; other columns aren't looked at. Without decided URLs of both classes every score
    is held against 0. What is collected and broadcast are tables of fixed size.
    """
    host, path = host_path(F.col(url_column))
    rule, verdict = decided(host, path, rules)
    urls = df.select(F.col(id_column).alias("id"), F.coalesce(F.col(url_column), F.lit("")).alias("url"), host.alias("host"), path.alias("path"), rule.alias("rule"), verdict.alias("ruled"))
    known = urls.where("ruled is not null").select("url", F.col("ruled").alias("verdict"), (F.pmod(F.xxhash64("url"), F.lit(FOLDS)) == 0).alias("held_out"))
    model = fit(known.where("not held_out"))
    level = threshold(_scored(known.where("held_out"), model))
    by_method = F.when(F.col("score") >= level, "allow").otherwise("block")
    return _scored(urls, model).select("id", "host", "path", "rule", F.coalesce("ruled", by_method).alias("verdict"), "score", F.lit(level).alias("threshold"))
