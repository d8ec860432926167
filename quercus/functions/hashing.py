"""Checksums, fingerprints and choices that follow from hashes alone."""

from __future__ import annotations

import hashlib
import json
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def sha256(c: Column) -> Column:
    return F.sha2(c, 256)


def crc32_hex(c: Column) -> Column:
    """Eight upper-case hex digits."""
    return F.lpad(F.hex(F.crc32(c)), 8, "0")


def verified(size: Column, crc: Column, content: Column) -> Column:
    return (F.octet_length(content) == size) & (crc32_hex(content) == F.upper(crc))


def set_fingerprint(df: DataFrame, column: str) -> str:
    """SHA-256 of the sorted distinct values as a compact JSON list. The hash needs them in order: they come to the driver range by range, and none is kept."""
    digest, before = hashlib.sha256(), b"["
    values = df.select(F.col(column).alias("v")).where("v is not null").distinct()
    for row in values.repartitionByRange("v").sortWithinPartitions("v").toLocalIterator():
        digest.update(before + json.dumps(row[0], ensure_ascii=False).encode())
        before = b","
    return (digest.update(b"]" if before == b"," else b"[]"), digest.hexdigest())[1]


def short_id(c: Column, digits: int = 20) -> Column:
    return F.substring(sha256(c), 1, digits)


def share(key: Column) -> Column:
    """0 to 1, from the first 32 bits of the key's SHA-256."""
    return F.conv(F.substring(sha256(key), 1, 8), 16, 10).cast("double") / 0xFFFFFFFF


def holdout(key: Column, fraction: float) -> Column:
    return share(key) < fraction


def weighted_choice(key: Column, seed: str, weights: dict[str, float]) -> Column:
    """One of the names, in declared order by cumulative weight: first 64 bits of SHA-256 of seed, a zero byte and key, over 2 ** 64."""
    value = F.conv(F.substring(sha256(F.concat(F.lit(seed + "\0"), key)), 1, 16), 16, 10).cast("decimal(20,0)").cast("double") / float(1 << 64)
    names = list(weights)
    bounds = [sum(list(weights.values())[: i + 1]) for i in range(len(names))]
    return reduce(lambda rest, i: F.when(value < bounds[i], names[i]).otherwise(rest), reversed(range(len(names) - 1)), F.lit(names[-1]))


def image_kind(content: Column) -> Column:
    """webp, jpeg or png by the first bytes; null for all else."""
    head = lambda a, n: F.hex(F.substring(content, a, n))
    return (
        F.when((head(1, 4) == "52494646") & (head(9, 4) == "57454250"), "webp")
        .when(head(1, 2) == "FFD8", "jpeg")
        .when(head(1, 8) == "89504E470D0A1A0A", "png")
    )
