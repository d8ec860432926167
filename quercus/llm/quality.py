"""Quality classifier by importance resampling.

Two generative models over hashed word uni- and bigrams, of target texts (labelled good and not toxic) and of all raw texts,
give each document a log importance weight; documents are sampled without replacement by Gumbel top-k.

A feature counts once in a document, so that a text that repeats a word a thousand times says no more about it than any
other. Its log ratio is ln((t + S) / (e + S)): t target documents have it, e would if the target were like the raw texts.
Where labels don't bear out a difference, the two models share the feature's probability and the ratio is 1: of the labelled
documents that have it, the share of target ones must differ from the common rate by a likelihood-ratio test that gives a
bar (in nats) or more. Each feature has a bucket in two tables, and the ratio nearer to 0 counts: a bucket that other
features share by chance doesn't mislead twice. The log weight is the sum of the log ratios, of either sign.

The bar, and the weight from which documents are accepted, are set on held-out labels, toxic and low-quality documents
counting alike. Then comes a veto: long texts gather weight with every ordinary word, and a few words that the target never
has don't outweigh that. So the ratios below 1 alone are summed, too, and documents far below 0 by that are never sampled;
its bar and threshold are set in the same way on the held-out documents that the weight accepts.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.functions.tables import small_batches
from quercus.llm.common import alone, free, keeps, others, written

#: Buckets of each of the two tables; smoothing; bars (nats of evidence) among which held-out labels choose.
BUCKETS, SMOOTH, BARS = 1 << 18, 0.25, (4.0, 6.0, 10.0, 15.0)
#: At most so many labelled documents are used (by hash of their ids); of them one in FOLDS sets bars and thresholds.
MAX_LABELS, FOLDS = 400_000, 4
#: A good document lost costs as much as so many bad ones kept.
COST = 40.0
#: Divides log weights before Gumbel noise is added: at 1 documents are drawn in proportion to their weights; the lower, the
#: nearer to the threshold are those that the draw decides on (here some tenths of a nat).
TEMPERATURE = 0.25
KEPT_WORDS, SEED = 100_000, 42
_WORDS = re.compile(r"\w+|[^\w\s]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0xD6E8FEB86659FD93))
_REPEAT = np.uint64(0x7265706561740000)


class _Codes(dict):
    """Word as it is written -> hash of its lower-case form; the lowest bits say whether it is capitals (1) or signs (2)."""

    def __missing__(self, word: str) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        signs = not (word[0].isalnum() or word[0] == "_")
        code = self[word] = xxhash.xxh64_intdigest(word.lower(), SEED) & ~3 | (word.isupper() and len(word) > 1) | signs << 1
        return code


_codes = _Codes()
keeps("quality", _codes)


def features(text: str) -> np.ndarray:
    """Places of a text's distinct features in the two tables, one column for each feature; none if it has no words.

    Features: lower-case words and runs of signs, pairs of neighbours (a repeated word counts as a mark of its own), and how
    many of the words are capitals, signs or repeats, by powers of two.
    """
    words = _WORDS.findall(text)
    if not words:
        return np.empty((2, 0), dtype=np.int64)
    codes = np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))
    kinds = np.bincount((codes & np.uint64(3)).astype(np.int64), minlength=4)
    codes &= ~np.uint64(3)
    again = np.zeros(len(codes), dtype=bool)
    again[1:] = codes[1:] == codes[:-1]
    codes = np.where(again, _REPEAT, codes)
    pairs = (codes[:-1] * _MIX[0] ^ codes[1:]) * _MIX[1]
    n = len(words)
    shares = (int(kinds[1] + kinds[3]), int(kinds[2] + kinds[3]), int(again.sum()))
    marks = [1 + 64 * i + min(10, math.ceil(-math.log2(c / n))) for i, c in enumerate(shares) if c and n >= 8]
    every = np.unique(np.concatenate([codes, pairs, np.array(marks, dtype=np.uint64) * _MIX[2]]))
    shift = np.uint64(64 - BUCKETS.bit_length() + 1)
    return np.stack([(every * _MIX[1] >> shift).astype(np.int64), ((every ^ every >> np.uint64(31)) * _MIX[2] >> shift).astype(np.int64)])


@dataclass(frozen=True)
class Model:
    """Log ratios by table and bucket, and how many of BARS the evidence for each reaches."""

    ratios: np.ndarray
    levels: np.ndarray

    def weights(self, text: str) -> np.ndarray:
        """For each bar the sum of the ratios that reach it, then for each bar the sum of those below 0; minus infinity for a text without words."""
        a, b = features(text)
        if not len(a):
            return np.full(2 * len(BARS), -np.inf)
        one, two = self.ratios[0, a], self.ratios[1, b]
        ratio = np.where(np.abs(one) <= np.abs(two), one, two).astype(np.float64)
        level = np.minimum(self.levels[0, a], self.levels[1, b])
        by_level = lambda r: np.bincount(level, weights=r, minlength=len(BARS) + 1)[:0:-1].cumsum()[::-1]
        return np.concatenate([by_level(ratio), by_level(np.minimum(ratio, 0.0))])


@dataclass(frozen=True)
class Rule:
    """Which bars count, from which weight documents are accepted, and below which sum of the ratios below 0 they never are."""

    bar: int = len(BARS) - 1
    threshold: float = -math.inf
    veto_bar: int = len(BARS) - 1
    veto: float = -math.inf


def _labels(labels: DataFrame) -> DataFrame:
    """id, good, held_out of at most about MAX_LABELS labelled documents. Several labels of one document must all be good."""
    one = labels.where("doc_id is not null").groupBy("doc_id").agg((F.coalesce(F.min("quality"), F.lit(0)) > 0).alias("high"), (F.coalesce(F.max("toxic"), F.lit(0)) == 0).alias("clean"))
    total = one.count()
    kept = one if total <= MAX_LABELS else one.where(F.pmod(F.xxhash64("doc_id"), F.lit(1 << 20)) < int((1 << 20) * MAX_LABELS / total))
    kind = F.when(~F.col("clean"), "toxic").when(~F.col("high"), "low").otherwise("good")
    return kept.select(F.col("doc_id").cast("bigint").alias("id"), kind.alias("kind"), (F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(FOLDS)) == 0).alias("held_out"))


def fit(docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> Model:
    """Counts every document's features; those of the target from the labelled good ones that aren't held out."""
    spark = docs.sparkSession
    known = _labels(labels).toArrow()  # bounded by MAX_LABELS
    good, held = known["kind"].to_numpy(zero_copy_only=False) == "good", known["held_out"].to_numpy(zero_copy_only=False)
    shipped = spark.sparkContext.broadcast((np.sort(known["id"].to_numpy()[~held]), np.sort(known["id"].to_numpy()[good & ~held])))
    source = docs.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labelled, target = shipped.value
        total = np.zeros((3, 2 * BUCKETS + 1), dtype=np.int64)  # of raw, labelled and target documents
        for batch in batches:
            ids = batch.column(0).to_pylist()
            some = np.array([i is not None for i in ids], dtype=bool)
            values = np.array([-1 if i is None else i for i in ids], dtype=np.int64)
            kind = (np.isin(values, labelled) & some).astype(int) + (np.isin(values, target) & some)
            parts: list[list[np.ndarray]] = [[], [], []]
            for n, (t, k) in enumerate(zip(batch.column(1), kind.tolist(), strict=True), 1):
                found = features(t.as_py() or "")
                if found.shape[1]:
                    parts[k].append(np.concatenate([np.unique(found[0]), np.unique(found[1]) + BUCKETS, [2 * BUCKETS]]))
                if n % 128 == 0 or n == batch.num_rows:  # few documents' features are held at a time
                    for k, held in enumerate(parts):
                        if held:
                            total[: k + 1] += np.bincount(np.concatenate(held), minlength=2 * BUCKETS + 1)
                            held.clear()
        at = np.nonzero(total[0])[0]
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), *(pa.array(row[part]) for row in total)], names=["bucket", "raw", "labelled", "target"])

    names = ("raw", "labelled", "target")
    with small_batches(spark):
        counts = source.mapInArrow(alone("quality", count), "bucket int, raw bigint, labelled bigint, target bigint").groupBy("bucket").agg(*(F.sum(n).alias(n) for n in names)).toArrow()  # bounded by the buckets
    raw, labelled, hits = np.zeros((3, 2 * BUCKETS + 1))
    for row, n in zip((raw, labelled, hits), names, strict=True):
        row[counts["bucket"].to_numpy()] = counts[n].to_numpy()
    return model(raw, labelled, hits)


def model(raw: np.ndarray, labelled: np.ndarray, hits: np.ndarray) -> Model:
    """The model from how many raw, labelled and target documents have each bucket (first table, second table, then all documents)."""
    ratio = np.log((hits + SMOOTH) / (raw * (hits[-1] / max(1.0, raw[-1])) + SMOOTH))
    rate = hits[-1] / max(1.0, labelled[-1])
    share = hits / np.maximum(labelled, 1)
    with np.errstate(divide="ignore", invalid="ignore"):
        evidence = labelled * (np.where(share > 0, share * np.log(share / rate), 0.0) + np.where(share < 1, (1 - share) * np.log((1 - share) / (1 - rate)), 0.0))
    same = (share < rate) == (ratio < 0)  # labelled and raw documents must say the same
    level = np.where(same, (np.nan_to_num(evidence)[:, None] >= np.array(BARS)).sum(axis=1), 0) * bool(hits[-1])
    ratio[level == 0] = 0.0
    return Model(ratio[:-1].reshape(2, BUCKETS).astype(np.float32), level[:-1].reshape(2, BUCKETS).astype(np.uint8))


def weighted(docs: DataFrame, fitted: Model, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, drop_columns: bool = False, name: str = "weights") -> DataFrame:
    """docs with an array column name of Model.weights() and last the Gumbel noise. No shuffle.

    The noise comes from a hash of seed, id and text, the same in every pass; rows that repeat have equal noise. With drop_columns only the id and the new column come back.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(fitted)
    kept = others(docs, [name])
    noise = free("noise", kept)
    source = docs.select(*(docs[f"`{c}`"] for c in kept), F.xxhash64(F.lit(seed), docs[f"`{id_column}`"], docs[f"`{text_column}`"]).alias(noise))
    place = kept.index(text_column)
    out = [kept.index(id_column)] if drop_columns else list(range(len(kept)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shipped.value
        for batch in batches:
            uniform = ((batch.column(len(kept)).to_numpy().view(np.uint64) >> np.uint64(11)).astype(np.float64) + 0.5) / (1 << 53)
            gumbel = -np.log(-np.log(uniform))
            found = [np.append(own.weights(t.as_py() or ""), g) for t, g in zip(batch.column(place), gumbel, strict=True)]
            lists = pa.ListArray.from_arrays(np.arange(len(found) + 1, dtype=np.int32) * (2 * len(BARS) + 1), np.concatenate(found) if found else np.empty(0))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), lists], names=[*(kept[i] for i in out), name])

    columns = [f"`{source.schema[i].name}` {source.schema[i].dataType.simpleString()}" for i in out]
    return source.mapInArrow(alone("quality", run), ", ".join([*columns, f"`{name}` array<double>"]))


def _cut(values: np.ndarray, kinds: np.ndarray) -> tuple[float, float]:
    """Cost and threshold: COST times the good documents below it, plus the toxic and the low-quality ones from it on (as rates, the mean of those kinds that there are)."""
    order = np.argsort(values, kind="stable")
    values, kinds = values[order], kinds[order]
    below = {k: np.concatenate([[0.0], np.cumsum(kinds == k)]) for k in ("good", "toxic", "low")}
    cost = COST * below["good"] / below["good"][-1] + np.mean([1 - b / b[-1] for k, b in below.items() if k != "good" and b[-1]], axis=0)
    able = np.concatenate([[True], values[1:] > values[:-1], [True]])  # cuts between equal values are none
    at = int(np.argmin(np.where(able, cost, np.inf)))
    if at == 0:
        return float(cost[0]), -math.inf
    if at == len(values):
        return float(cost[at]), math.inf
    low, high = values[at - 1], values[at]
    return float(cost[at]), float((low + high) / 2 if math.isfinite(low) else high)


def calibrated(weights: np.ndarray, kinds: np.ndarray, veto: bool = True) -> Rule:
    """The rule from the weights (rows of Model.weights()) and kinds (good, toxic, low) of held-out documents; it accepts all if there aren't both good and bad ones."""
    both = lambda k: bool((k == "good").any() and (k != "good").any())
    if not both(kinds):
        return Rule()
    n = len(BARS)
    (_, threshold), bar = min((_cut(weights[:, i], kinds), i) for i in range(n))
    kept = weights[:, bar] >= threshold
    if not veto or not both(kinds[kept]):
        return Rule(bar, threshold)
    (_, low), veto_bar = min((_cut(weights[kept, n + i], kinds[kept]), i) for i in range(n))
    return Rule(bar, threshold, veto_bar, low)


def kth_largest(table: DataFrame, column: str, k: int) -> float:
    """The k-th largest value of a double column without nulls, exactly: by counts in ever narrower bins, without a sort."""
    if k <= 0:
        return math.inf
    finite = table.where(F.col(column) > F.lit(-math.inf))
    low, high, n = finite.agg(F.min(column), F.max(column), F.count("*")).first()
    if k > n:
        return -math.inf
    above, bins = 0, 1024
    while True:
        inside = finite.where((F.col(column) >= low) & (F.col(column) <= high))
        if high - low <= abs(high) * 1e-15 or inside.count() <= 4096:
            values = sorted((r[0] for r in inside.groupBy(column).count().orderBy(F.desc(column)).limit(4097).select(F.struct(column, "count")).collect()), reverse=True)
            for value, count in values:
                above += count
                if above >= k:
                    return value
            return low
        width = (high - low) / bins
        rows = {r["bin"]: r for r in inside.groupBy(F.least(F.floor((F.col(column) - low) / width), F.lit(bins - 1)).alias("bin")).agg(F.count("*").alias("n"), F.min(column).alias("a"), F.max(column).alias("b")).collect()}
        for b in sorted(rows, reverse=True):
            if above + rows[b]["n"] >= k:
                low, high = rows[b]["a"], rows[b]["b"]
                break
            above += rows[b]["n"]


def resampled(
    docs: DataFrame, labels: DataFrame, k: int | None = None, id_column: str = "doc_id", text_column: str = "text", seed: int = SEED, drop_columns: bool = False,
    temperature: float = TEMPERATURE, veto: bool = True,
) -> DataFrame:
    """The sampled rows of docs, with log_weight (above the threshold) and gumbel_key.

    k: how many rows to sample (rows that tie with the last all stay); None: as many as have a log weight of 0 or more,
    that is as the rule accepts. labels: doc_id, quality, toxic. Null and empty texts and texts without words are never
    sampled, nor are those that the veto (if it is on) keeps out. Without labels all other texts are. Repeated rows tie: all
    or none are sampled. Very long texts count whole. An empty table gives an empty sample. Columns of the new names (in any
    case) are replaced, all others stay. Texts are read twice: to count features, and to weigh; they are never shuffled.
    """
    kept = [id_column] if drop_columns else others(docs, ["log_weight", "gumbel_key"])
    name = free("weights", kept)
    first = written(weighted(docs.select(*(f"`{c}`" for c in others(docs, ["log_weight", "gumbel_key"]))), fit(docs, labels, id_column, text_column), id_column, text_column, seed, drop_columns, name), "weights")
    at = lambda i: F.element_at(F.col(f"`{name}`"), F.lit(i + 1))
    judged = first.select(F.col(f"`{id_column}`").cast("bigint").alias("id"), F.col(f"`{name}`").alias("w")).join(_labels(labels).where("held_out"), "id").select("kind", "w").toArrow()  # bounded by MAX_LABELS
    values = np.array(judged["w"].to_pylist(), dtype=np.float64).reshape(-1, 2 * len(BARS) + 1)[:, :-1]
    rule = calibrated(values, judged["kind"].to_numpy(zero_copy_only=False), veto)
    weight = at(rule.bar) - F.lit(rule.threshold if math.isfinite(rule.threshold) else 0.0)
    accepted = F.lit(rule.threshold < 0) if math.isinf(rule.threshold) else F.col("log_weight") >= 0
    able = first.where((at(0) > -math.inf) & (at(len(BARS) + rule.veto_bar) >= F.lit(max(rule.veto, -1e300))))
    keyed = able.select(*(f"`{c}`" for c in kept), weight.alias("log_weight"), (weight / temperature + at(2 * len(BARS))).alias("gumbel_key"))
    cut = kth_largest(keyed, "gumbel_key", keyed.where(accepted).count() if k is None else k)
    return keyed.where(F.col("gumbel_key") >= F.lit(cut if math.isfinite(cut) else math.copysign(1e300, cut)))
