"""Benchmark decontamination by a prefix-filtered set join with exact verification.

Each benchmark item is cut into windows. A window occurs in a document only if all its shingles do, so the necessary
prefix of its shingles, ordered by rarity in the corpus, is the rarest one alone. Documents are joined with windows on that
shingle; the shingle's place in the window gives the one place where the window could lie (positional bound), which must
lie within the document (length bound); a hash of the words there is compared, and then the words themselves.

The benchmark goes to the executors in blocks of bounded size (windows and bytes). One block is one pass over the
documents, which are neither shuffled nor copied. With several blocks, every pass writes the few rows that have hits and
its broadcast is destroyed before the next; a last pass puts the spans of a document together. No plan holds two blocks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import alone, forget, free, keeps, others, row_id, utf8, written

#: Words are runs of 0-9, a-z (A-Z lower-cased) and everything outside ASCII.
_WORD_BYTES = bytes(b | 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else 32 for b in range(256))
WINDOW = 10
SHINGLE = 3
#: Windows and bytes of text in one broadcast (an item longer than that is a block of its own); a larger benchmark takes several, one after the other.
BLOCK_WINDOWS, BLOCK_BYTES = 1 << 18, 8 << 20
#: Buckets in which shingles are counted: a collision only makes a shingle look less rare.
COUNTED = 1 << 20
#: Words whose codes a worker keeps; matches that are expanded at a time.
KEPT_WORDS, CHUNK = 100_000, 1 << 16
_BASE, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_WORD_BYTES).split()


class _Codes(dict):
    def __missing__(self, word: bytes) -> int:
        if len(self) >= KEPT_WORDS:
            self.clear()
        code = self[word] = xxhash.xxh64_intdigest(word)
        return code


_codes = _Codes()
keeps("decontaminate", _codes)


def codes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(_codes.__getitem__, words), dtype=np.uint64, count=len(words))


def grams(codes: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of n words."""
    if len(codes) < n:
        return np.empty(0, dtype=np.uint64)
    return _hashed(codes, np.arange(len(codes) - n + 1), n)


def _hashed(codes: np.ndarray, starts: np.ndarray, n: int) -> np.ndarray:
    total = np.full(len(starts), n, dtype=np.uint64)
    for i in range(n):
        total = total * _BASE + codes[starts + i]
    return (total ^ total >> np.uint64(31)) * _MIX


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(44)).astype(np.int64) % COUNTED


@dataclass
class Block:
    """Items of the benchmark: their words one after the other, and where their windows lie."""

    window: int
    words: list[bytes] = field(default_factory=list)
    first: list[np.ndarray] = field(default_factory=list)
    items: list[int] = field(default_factory=list)
    names: list[str | None] = field(default_factory=list)
    lengths: list[int] = field(default_factory=list)
    windows: int = 0
    bytes: int = 0

    def add(self, item_id: object, text: bytes) -> None:
        words = words_of(text)
        if not words:
            return
        n = max(1, len(words) - self.window + 1)
        self.first.append(len(self.words) + np.arange(n))
        self.items.append(n)
        self.lengths.append(min(len(words), self.window))
        self.names.append(None if item_id is None else str(item_id))
        self.words += words
        self.windows += n
        self.bytes += len(text)


@dataclass(frozen=True)
class Index:
    """What finds a block's windows: postings sorted by the hash of each distinct window's rarest shingle, and the windows' words."""

    sizes: tuple[int, ...]
    """Lengths of the shingles in use."""
    seen: np.ndarray
    """By the low bits of a shingle's hash, whether there is one."""
    keys: np.ndarray
    at: np.ndarray
    length: np.ndarray
    whole: np.ndarray
    start: np.ndarray
    """Of each posting: shingle's hash, place in the window, the window's words, hash and first word in text."""
    text: bytes
    offsets: np.ndarray
    """All words with one blank between, and where each begins."""
    owner_from: np.ndarray
    owners: np.ndarray
    names: tuple[str, ...]
    """Of each posting, where its items stand in owners (places in names)."""

    def words(self, posting: int) -> bytes:
        a = self.start[posting]
        return self.text[self.offsets[a] : self.offsets[a + self.length[posting]] - 1]

    def items(self, posting: int) -> list[str]:
        return [self.names[i] for i in self.owners[self.owner_from[posting] : self.owner_from[posting + 1]]]


def _blocks(benchmark: DataFrame, item_id: str, text: str, window: int) -> Iterator[Block]:
    block = Block(window)
    for row in benchmark.select(F.col(item_id).alias("id"), F.col(text).alias("text")).where("text is not null").toLocalIterator():
        block.add(row["id"], row["text"].encode())
        if block.windows >= BLOCK_WINDOWS or block.bytes >= BLOCK_BYTES:
            yield block
            block = Block(window)
    if block.windows:
        yield block


def _sizes(length: int, shingle: int) -> int:
    return min(shingle, length)


def _wanted(benchmark: DataFrame, text: str, window: int, shingle: int) -> tuple[np.ndarray, tuple[int, ...]]:
    """The buckets that shingles of the benchmark fall into, and their lengths: at most COUNTED rows come back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen, sizes = np.zeros(COUNTED, dtype=bool), set()
        for batch in batches:
            for t in utf8(batch.column(0)):
                codes = codes_of(words_of(t.as_py() or b""))
                if len(codes):
                    n = _sizes(min(len(codes), window), shingle)
                    sizes.add(n)
                    seen[_bucket(grams(codes, n))] = True
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.nonzero(seen)[0], -np.array(sorted(sizes), dtype=np.int64)]))], names=["bucket"])

    found = benchmark.select(F.col(text).alias("text")).mapInArrow(alone("decontaminate", run), "bucket bigint").distinct().toArrow()["bucket"].to_numpy()
    seen = np.zeros(COUNTED, dtype=bool)
    seen[found[found >= 0]] = True
    sizes = {int(-x) for x in found if x < 0}
    return seen, tuple(sorted(sizes))


def _rarity(texts: DataFrame, wanted: np.ndarray, sizes: tuple[int, ...]) -> np.ndarray:
    """How often shingles of each wanted bucket occur in all documents. One pass for all blocks; at most COUNTED rows come back."""
    shipped = texts.sparkSession.sparkContext.broadcast((np.packbits(wanted), sizes))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packed, sizes = shipped.value
        wanted, total = np.unpackbits(packed).astype(bool), np.zeros(COUNTED, dtype=np.int64)
        for batch in batches:
            for t in utf8(batch.column(0)):
                codes = codes_of(words_of(t.as_py() or b""))
                for n in sizes:
                    found = _bucket(grams(codes, n))
                    found = found[wanted[found]]
                    np.add.at(total, found, 1)
        at = np.nonzero(total)[0]
        for i in range(0, len(at), 1 << 16):
            part = at[i : i + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(part), pa.array(total[part])], names=["bucket", "n"])

    found = texts.mapInArrow(alone("decontaminate", run), "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    shipped.destroy()
    counts = np.zeros(COUNTED, dtype=np.int64)
    counts[found["bucket"].to_numpy()] = found["n"].to_numpy()
    return counts


def _index(block: Block, counts: np.ndarray, shingle: int) -> Index:
    codes = codes_of(block.words)
    ends = np.cumsum([len(w) + 1 for w in block.words], dtype=np.int64)
    offsets = np.concatenate([[0], ends])
    text = b" ".join(block.words) + b" "
    first = np.concatenate(block.first) if block.first else np.empty(0, dtype=np.int64)
    item = np.repeat(np.arange(len(block.items)), block.items)
    length = np.repeat(np.array(block.lengths, dtype=np.int64), block.items)
    # equal windows are one posting with several owners
    distinct: dict[bytes, int] = {}
    window = np.fromiter((distinct.setdefault(text[offsets[a] : offsets[a + n] - 1], len(distinct)) for a, n in zip(first.tolist(), length.tolist(), strict=True)), dtype=np.int64, count=len(first))
    one = np.unique(window, return_index=True)[1]
    named = np.array([n is not None for n in block.names], dtype=bool)[item] if len(item) else np.empty(0, dtype=bool)
    pairs = np.unique(np.stack([window[named], item[named]]), axis=1)
    names, place = np.unique(np.array([n or "" for n in block.names], dtype=object), return_inverse=True)
    a, n = first[one], length[one]
    key, at, whole = np.zeros(len(one), dtype=np.uint64), np.zeros(len(one), dtype=np.int32), np.zeros(len(one), dtype=np.uint64)
    for size in np.unique(n).tolist():
        of = np.nonzero(n == size)[0]
        k = _sizes(size, shingle)
        whole[of] = _hashed(codes, a[of], size)
        inside = grams(codes, k)
        order = np.empty(len(inside), dtype=np.int64)
        order[np.lexsort((inside, counts[_bucket(inside)]))] = np.arange(len(inside))
        value, rank = np.unique(inside, return_inverse=True)
        least = np.full(len(value), len(inside), dtype=np.int64)  # equal shingles rank equal
        np.minimum.at(least, rank, order)
        spots = a[of][:, None] + np.arange(size - k + 1)
        at[of] = np.argmin(least[rank][spots], axis=1)
        key[of] = inside[a[of] + at[of]]
    by_key = np.argsort(key, kind="stable")
    seen = np.zeros(COUNTED, dtype=bool)
    seen[(key & np.uint64(COUNTED - 1)).astype(np.int64)] = True
    held = np.bincount(pairs[0], minlength=len(one))
    starts = np.concatenate([[0], np.cumsum(held)])
    owners = np.concatenate([place[pairs[1][starts[w] : starts[w + 1]]] for w in by_key.tolist()]) if len(one) else np.empty(0, dtype=np.int64)
    small = lambda v, top: v.astype(np.int32 if top < 1 << 31 else np.int64)
    return Index(
        tuple(sorted({_sizes(x, shingle) for x in n.tolist()})), seen, key[by_key], at[by_key], n[by_key].astype(np.int32), whole[by_key], small(a[by_key], len(codes)), text,
        small(offsets, len(text)), small(np.concatenate([[0], np.cumsum(held[by_key])]), len(pairs[0])), owners.astype(np.int32), tuple(names.tolist()),
    )


def _met(codes: np.ndarray, index: Index) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Starts in the document and postings whose shingle and window hash agree there, some at a time."""
    total = len(codes)
    for size in index.sizes:
        found = grams(codes, size)
        near = np.nonzero(index.seen[(found & np.uint64(COUNTED - 1)).astype(np.int64)])[0]
        low = np.searchsorted(index.keys, found[near], "left")
        many = np.searchsorted(index.keys, found[near], "right") - low
        near, low, many = near[many > 0], low[many > 0], many[many > 0]
        upto = np.cumsum(many)
        for a in range(0, int(upto[-1]) if len(upto) else 0, CHUNK):
            flat = np.arange(a, min(a + CHUNK, int(upto[-1])))
            of = np.searchsorted(upto, flat, "right")
            posting = low[of] + flat - (upto[of] - many[of])
            start, length = near[of] - index.at[posting], index.length[posting]
            ok = (start >= 0) & (start + length <= total)
            start, length, posting = start[ok], length[ok], posting[ok]
            for n in np.unique(length).tolist():
                here = length == n
                same = _hashed(codes, start[here], n) == index.whole[posting[here]]
                yield start[here][same], posting[here][same]


def find(words: list[bytes], index: Index) -> tuple[list[tuple[int, int]], set[str]]:
    """The spans of words (start, end) where windows occur, and the items they belong to."""
    spans, items = [], set()
    for starts, postings in _met(codes_of(words), index):
        for start, posting in zip(starts.tolist(), postings.tolist(), strict=True):
            end = start + int(index.length[posting])
            if b" ".join(words[start:end]) == index.words(posting):
                spans.append((start, end))
                items.update(index.items(posting))
    return spans, items


def covered(spans: list[tuple[int, int]]) -> int:
    total, end = 0, 0
    for a, b in sorted(spans):
        total += max(0, b - max(a, end))
        end = max(end, b)
    return total


NEW = ("n_words", "n_hit", "items")
_FOUND = "n_words bigint, n_hit bigint, items array<string>"


def contaminated(
    docs: DataFrame,
    benchmark: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    window: int = WINDOW,
    shingle: int = SHINGLE,
    keep_text: bool = True,
) -> DataFrame:
    """docs with n_words, n_hit (words inside any occurrence of a window) and items (sorted ids, as strings, of items with occurring windows).

    A null or empty text has no words. An item of fewer than window words, but not none, is one window; null texts and
    texts without words give none. Equal ids count once; an item without id counts for n_hit only. Repeated rows and equal
    ids of documents stay rows of their own. Very long texts are searched whole, in the memory of their words. Empty tables
    give an empty result, or documents without hits. Columns of the new names (in any case) are replaced, all others stay
    (the text only if keep_text).
    """
    kept = others(docs, NEW)
    source = docs.select(*(docs[f"`{c}`"] for c in kept))
    blocks = _blocks(benchmark, item_id, item_text, window)
    first, second = next(blocks, None), next(blocks, None)
    if first is None:
        return _appended(source, kept, text, keep_text, None)
    counts = _rarity(source.select(source[f"`{text}`"]), *_wanted(benchmark, item_text, window, shingle))
    if second is None:
        return _appended(source, kept, text, keep_text, _index(first, counts, shingle))
    return _in_passes(source, kept, text, keep_text, (_index(b, counts, shingle) for b in _chain(first, second, blocks)))


def _chain(first: Block, second: Block, rest: Iterator[Block]) -> Iterator[Block]:
    yield first
    del first
    yield second
    del second
    yield from rest


def _columns(df: DataFrame, names: list[str]) -> str:
    return ", ".join(f"`{n}` {df.schema[n].dataType.simpleString()}" for n in names)


def _appended(source: DataFrame, kept: list[str], text: str, keep_text: bool, index: Index | None) -> DataFrame:
    """One pass with one block."""
    place = kept.index(text)
    out = [i for i in range(len(kept)) if keep_text or i != place]
    names = [kept[i] for i in out]
    shipped = source.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = shipped.value
        for batch in batches:
            total, hit, items = [], [], []
            for t in utf8(batch.column(place)):
                words = words_of(t.as_py() or b"")
                spans, ids = find(words, index) if index else ((), ())
                total.append(len(words))
                hit.append(covered(spans))
                items.append(sorted(ids))
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*names, *NEW])

    return source.mapInArrow(alone("decontaminate", run), ", ".join(x for x in (_columns(source, names), _FOUND) if x))


def _in_passes(source: DataFrame, kept: list[str], text: str, keep_text: bool, indexes: Iterator[Index]) -> DataFrame:
    """A pass for each block; rows are named once in a written table."""
    row = free("row", kept)
    numbered = written(source.withColumn(row, row_id()), "numbered")
    texts = numbered.select(F.col(f"`{row}`").alias("row"), F.col(f"`{text}`").alias("text"))
    paths = []
    for index in indexes:
        shipped = source.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch], shipped=shipped) -> Iterator[pa.RecordBatch]:
            index = shipped.value
            for batch in batches:
                rows, spans, items = [], [], []
                for r, t in zip(batch.column(0), utf8(batch.column(1)), strict=True):
                    more, ids = find(words_of(t.as_py() or b""), index)
                    if more:
                        rows.append(r.as_py())
                        spans.append([x for span in more for x in span])
                        items.append(sorted(ids))
                yield pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(spans, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["row", "spans", "items"])

        part = written(texts.mapInArrow(alone("decontaminate", run), "row bigint, spans array<int>, items array<string>"), "hits")
        shipped.destroy()
        paths.append(part._quercus_path)
    merged = source.sparkSession.read.schema(part.schema).parquet(*paths).groupBy("row").agg(F.flatten(F.collect_list("spans")).alias("spans"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"))
    hits = written(merged, "merged")  # a row for each document with hits, of the size of its own hits
    both = numbered.join(hits.select(F.col("row").alias(row), F.col("spans").alias(free("spans", kept)), F.col("items").alias(free("items", kept))), row, "left")
    spans_at, items_at = len(kept), len(kept) + 1
    both = both.select(*(f"`{c}`" for c in kept), f"`{free('spans', kept)}`", f"`{free('items', kept)}`")
    place = kept.index(text)
    out = [i for i in range(len(kept)) if keep_text or i != place]
    names = [kept[i] for i in out]

    def end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            total = [len(words_of(t.as_py() or b"")) for t in utf8(batch.column(place))]
            flat = [s or [] for s in batch.column(spans_at).to_pylist()]
            hit = [covered(list(zip(s[::2], s[1::2], strict=True))) for s in flat]
            items = [i or [] for i in batch.column(items_at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(total, pa.int64()), pa.array(hit, pa.int64()), pa.array(items, pa.list_(pa.string()))], names=[*names, *NEW])

    result = written(both.mapInArrow(alone("decontaminate", end), ", ".join(x for x in (_columns(source, names), _FOUND) if x)), "contaminated")
    for table in (numbered, hits):
        forget(table)
    return result
