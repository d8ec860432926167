"""What the operators share."""

from __future__ import annotations

import ctypes
import functools
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quercus.functions.tables import forget, keep_batches_small, read, scratch, shared_dir, written
from quercus.operators.graph import components

__all__ = ["alone", "components", "forget", "free", "keep_batches_small", "keeps", "others", "read", "row_id", "scratch", "shared_dir", "utf8", "written"]


_kept: dict[str, dict] = {}


def keeps(operator: str, table: dict) -> None:
    """Names a table that an operator keeps in a worker from one task to the next; it must work when emptied."""
    _kept[operator] = table


@functools.cache
def _trim() -> Callable[[int], int]:
    return getattr(ctypes.CDLL(None), "malloc_trim", lambda _: 0)


def _release() -> None:
    """Hands memory that the allocators hold without use back to the system."""
    pa.default_memory_pool().release_unused()
    _trim()(0)


def _drop_others(operator: str) -> None:
    """Its own function, not part of what is sent to workers: that would take the driver's tables along."""
    full = [t for name, t in _kept.items() if name != operator and t]
    for table in full:
        table.clear()
    if full:
        gc.collect()
        _release()


def alone(operator: str, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow. Workers live on from one job to the next: one that comes to it drops what other operators kept, and after it what the allocators hold."""

    def only(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        _drop_others(operator)
        try:
            yield from run(batches)
        finally:
            _release()

    return only


def utf8(column: pa.Array) -> pa.Array:
    """A string column as its UTF-8 bytes, without a copy."""
    return column.cast(pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary())


def row_id() -> Column:
    """Names a row of a scanned table for good: partition and place in it, which a rerun of the scan repeats."""
    return F.monotonically_increasing_id()


def others(df: DataFrame, new: tuple[str, ...] | list[str]) -> list[str]:
    """The columns of df that new ones don't replace; names that differ only in case are one to Spark."""
    gone = {n.lower() for n in new}
    return [c for c in df.columns if c.lower() not in gone]


def free(name: str, columns: list[str]) -> str:
    """name, with underscores before it until no column is called so."""
    taken = {c.lower() for c in columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
