"""SimHash near-duplicates through a byte-position inverted index with count filtering.

Fingerprints that differ in at most d of 64 bits differ in at most d of their 8 bytes: they share at least 8 - d
positional bytes. Lists of single positional bytes have N / 256 members each, so tallying them pair by pair takes time in
the square of N. The index is therefore keyed by sets of 8 - d positional bytes, the guaranteed minimum: a pair's tally
over single bytes reaches that minimum exactly if the pair meets in one of these lists. In a list the fixed bytes leave
8 d free bits, so it has at most 2 ** (8 d) distinct fingerprints whatever the input; equal fingerprints count once. A list
emits, for every member, one link to the least member of its part of the list (not all pairs), which loses no class.

64 bits tell texts that are nearly the same from others, but not texts that share four fifths of their shingles: those
differ in about 10 bits, more than 8 bytes can guarantee a match for. With a similarity asked for, texts are linked by the
Jaccard similarity of their shingle sets, counted exactly; fingerprints and sketches only say which pairs to count. Each
distinct set (unit) has a sketch of 128 positional bytes, byte p being taken from the hash that is least under permutation
p (a consistent sample, so a byte agrees as often as shingles do), indexed in the same way by groups of four. Neighbours in
a few lists are verified first, which joins most groups with few pairs, then those neighbours in the other lists that still
lie in different classes, and the nearest fingerprints of units that stand in no list with another; then the lists whose
members lie in several classes are compared, every member with all of other classes. Blocks of their sets meet in a task,
which counts exactly and sends on only the links that join classes.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.common import alone, components, forget, row_id, utf8, written

SEED = 42
#: Members of a list up to which its pairs are compared in blocks; longer lists look up the neighbours of each member.
PAIRWISE = 512


#: Positional bytes of a sketch, groups of four of them that are indexed, those whose neighbours are verified first, members of a list that are compared in one
#: block, and their hashes.
SKETCH_BYTES, GROUPS, FIRST, BLOCK, BLOCK_HASHES = 128, 20, 4, 512, 1 << 18
_PERMUTATIONS = np.random.Generator(np.random.PCG64(SEED)).integers(1, 1 << 32, (2, SKETCH_BYTES), dtype=np.uint32) | np.array([[1], [0]], dtype=np.uint32)


def hashes_of(text: bytes, k: int) -> np.ndarray:
    """XXH64 of the k-word shingles, as rows of 8 bytes, most significant first; of all words if they are fewer; none without words."""
    words = text.lower().split()  # bytes: A-Z only, and the six ASCII white-space signs
    if not words:
        return np.empty((0, 8), dtype=np.uint8)
    shingles = map(b" ".join, zip(*(words[i:] for i in range(k)))) if len(words) > k else (b" ".join(words),)
    digest = xxhash.xxh64_digest
    return np.frombuffer(b"".join([digest(s, SEED) for s in shingles]), dtype=np.uint8).reshape(-1, 8)


def fingerprint(hashes: np.ndarray) -> bytes:
    """64 bits, most significant byte first. A bit is 1 if set in over half the hashes; zero without hashes."""
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 1 << 16):
        ones += np.unpackbits(hashes[i : i + (1 << 16)], axis=1).sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > len(hashes)).tobytes()


def sketch(hashes: np.ndarray) -> bytes | None:
    """The positional bytes; none without hashes."""
    if not len(hashes):
        return None
    values = np.unique(np.ascontiguousarray(hashes[:, 4:]).view(">u4").ravel().astype(np.uint32))
    least = np.full(SKETCH_BYTES, 0xFFFFFFFF, dtype=np.uint32)
    for i in range(0, len(values), 4096):
        np.minimum(least, (values[i : i + 4096, None] * _PERMUTATIONS[0] + _PERMUTATIONS[1]).min(axis=0), out=least)
    return (least * np.uint32(0x9E3779B1) >> np.uint32(24)).astype(np.uint8).tobytes()


def _set(hashes: np.ndarray) -> bytes:
    """The distinct hashes in order, 8 bytes each."""
    return np.unique(np.ascontiguousarray(hashes).view("<u8").ravel()).tobytes()


def fingerprints(df: DataFrame, id_column: str, text_column: str, k: int, sketches: bool = False, row_column: str | None = None) -> DataFrame:
    """row (names the row), id, fp (the fingerprint as a signed long), unit (names the shingle set) and sketch (both null unless asked for) of each row. A null text counts as empty."""
    source = df.select((F.col(row_column) if row_column else row_id()).alias("row"), F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints, units, drawn = [], [], []
            for t in utf8(batch.column(2)):
                hashes = hashes_of(t.as_py() or b"", k)
                prints.append(fingerprint(hashes))
                units.append(int.from_bytes(xxhash.xxh3_64_digest(_set(hashes), SEED), "big", signed=True) if sketches else None)
                drawn.append(sketch(hashes) if sketches else None)
            values = np.frombuffer(b"".join(prints), dtype=">u8").astype("<u8").view("<i8")
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(values), pa.array(units, pa.int64()), pa.array(drawn, pa.binary())], names=["row", "id", "fp", "unit", "sketch"]
            )

    return source.mapInArrow(alone("simhash", run), "row bigint, id bigint, fp bigint, unit bigint, sketch binary")


def postings(units: DataFrame) -> DataFrame:
    """key, unit: the lists that each unit (unit, sketch) stands in."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drawn = np.frombuffer(b"".join(batch.column(1).to_pylist()), dtype=np.uint8).reshape(-1, SKETCH_BYTES)
            keys = np.ascontiguousarray(drawn[:, : 4 * GROUPS]).view("<u4").astype(np.int64) | np.arange(GROUPS, dtype=np.int64) << 32
            yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(batch.column(0).to_numpy(), GROUPS))], names=["key", "unit"])

    return units.where("sketch is not null").select("unit", "sketch").mapInArrow(alone("simhash", run), "key bigint, unit bigint")


def _runs(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[pa.RecordBatch]:
    """Rows that agree in the first columns, by which they are sorted, as a batch for each group of two rows or more."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.Table.from_batches([held, batch]).combine_chunks().to_batches()[0]
        if not batch.num_rows:
            continue
        first = np.ones(batch.num_rows, dtype=bool)
        columns = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(keys)]
        first[1:] = np.logical_or.reduce([v[1:] != v[:-1] for v in columns])
        starts = np.nonzero(first)[0]
        for at in np.nonzero(np.diff(starts) > 1)[0].tolist():
            yield batch.slice(starts[at], starts[at + 1] - starts[at])
        held = batch.slice(starts[-1])
    if held is not None and held.num_rows > 1:
        yield held


def _pairs(found: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Batches a, b of some thousand pairs."""
    left, right, n = [], [], 0
    for a, b in found:
        left.append(a)
        right.append(b)
        n += len(a)
        if n >= 1 << 13:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])
            left, right, n = [], [], 0
    if n:
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(left)), pa.array(np.concatenate(right))], names=["a", "b"])


def neighbours(members: DataFrame) -> DataFrame:
    """a, b: members (key, unit, n: how many the list has, root) with different roots that are next to each other in a block of a list. Blocks and orders differ from list to list; short lists are one block."""
    at = F.pmod(F.xxhash64("unit", "key"), F.ceil(F.col("n") / BLOCK))
    over = Window.partitionBy("key", at).orderBy(F.xxhash64("key", "unit", F.lit(1)), "unit")
    beside = members.select(F.col("unit").alias("a"), F.col("root").alias("x"), F.lag("unit").over(over).alias("b"), F.lag("root").over(over).alias("y"))
    return _ordered(beside.where("b is not null and x != y"))


def _ordered(pairs: DataFrame) -> DataFrame:
    return pairs.where("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _joining(units: np.ndarray, roots: np.ndarray, low: np.ndarray, apart: bool, sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Of the pairs of units with a Jaccard similarity of similarity or more, one of the low block and one of the other (apart) or both of the low, as many as join their classes (roots)."""
    sizes = np.fromiter(map(len, sets), np.int64, len(sets))
    code, owner = np.unique(np.concatenate(sets), return_inverse=True)[1], np.repeat(np.arange(len(sets)), sizes)
    able = np.ones(len(sets), dtype=bool)
    for _ in range(3):  # a set reaches the similarity with no other if too many of its hashes are in none
        shared = np.bincount(code, minlength=1)[code] > 1
        code, owner = code[shared], owner[shared]
        able &= np.bincount(owner, minlength=len(sets)) >= similarity * sizes
        code, owner = code[able[owner]], owner[able[owner]]
    starts, roots = np.searchsorted(owner, np.arange(len(sets) + 1)), roots.copy()
    here, left, right = np.zeros(code.max(initial=-1) + 1, dtype=bool), [], []
    for i in np.nonzero(able & low)[0].tolist():
        rest = able & (roots != roots[i]) & (np.minimum(sizes, sizes[i]) >= similarity * np.maximum(sizes, sizes[i]))
        if apart:
            rest &= ~low
        if not rest.any():
            continue
        mine = code[starts[i] : starts[i + 1]]
        here[mine] = True
        common = np.bincount(owner[here[code]], minlength=len(sets))
        here[mine] = False
        for j in np.nonzero(rest & (common >= similarity * (sizes + sizes[i] - common)))[0].tolist():
            if roots[j] != roots[i]:
                roots[roots == roots[j]] = roots[i]
                left.append(units[i])
                right.append(units[j])
    return np.array(left, dtype=np.int64), np.array(right, dtype=np.int64)


def blocks(members: DataFrame, sets: DataFrame) -> DataFrame:
    """key, main (the root of most of its members), of_main, of_rest: in how many blocks those of the main class and all others of a list (members: key, unit, root) are compared."""
    sized = members.join(sets.select("unit", "size"), "unit").groupBy("key", "root").agg(F.count("*").alias("n"), F.sum("size").alias("size"))
    lists = sized.groupBy("key").agg(F.max(F.struct("n", "root", "size")).alias("main"), F.sum("n").alias("n"), F.sum("size").alias("size"))
    number = lambda n, size: F.least(n, F.greatest(F.ceil(n / BLOCK), F.ceil(size / BLOCK_HASHES))).cast("int")
    rest = number(F.col("n") - F.col("main.n"), F.col("size") - F.col("main.size"))
    return lists.select("key", F.col("main.root").alias("main"), number(F.col("main.n"), F.col("main.size")).alias("of_main"), rest.alias("of_rest"))


def dealt(members: DataFrame, lists: DataFrame) -> DataFrame:
    """key, low, high (two blocks of a list), unit, root, own (its block): members (key, unit, root) so that every two of a list (of blocks()) with different roots meet in a pair of blocks.

    The class that has most of a list has blocks of its own, which don't meet each other. So a list of one large class and a
    few others has rows in proportion to its members, and one of many classes as many as its members times its blocks.
    """
    listed = members.join(lists, "key")
    is_main, at = F.col("root") == F.col("main"), F.xxhash64("unit")
    own = F.when(is_main, F.pmod(at, F.col("of_main"))).otherwise(F.col("of_main") + F.pmod(at, F.col("of_rest"))).cast("int")
    others = F.sequence(F.when(is_main, F.col("of_main")).otherwise(F.lit(0)), F.col("of_main") + F.col("of_rest") - 1)
    each = listed.select("key", "unit", "root", own.alias("own"), F.explode(others).alias("other"))
    return each.select("key", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"), "unit", "root", "own")


def across(members: DataFrame, lists: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """a, b: of all pairs of members (key, unit, root) of a list (of blocks()) with different roots whose sets (unit, hashes, size) have a Jaccard similarity of similarity or more, as many as their classes need.

    A pair of blocks comes with its sets to one task, which compares them there and sends on at most one link less than it
    has classes; pairs are neither sent nor written. The members of a pair of blocks come in order, one after the other; a
    task holds those of one at a time.
    """

    def compared(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for cell in _runs(batches, 3):
            units, roots, own = (cell.column(i).to_numpy() for i in (3, 4, 5))
            low, high = (cell.column(i)[0].as_py() for i in (1, 2))
            yield _joining(units, roots, own == low, low != high, [np.frombuffer(x.as_buffer(), dtype="<u8") for x in cell.column(6)], similarity)

    cells = dealt(members, lists).join(sets.select("unit", "hashes"), "unit").select("key", "low", "high", "unit", "root", "own", "hashes")
    ordered = cells.repartition("key", "low", "high").sortWithinPartitions("key", "low", "high")
    return _ordered(ordered.mapInArrow(alone("simhash", lambda batches: _pairs(compared(batches))), "a bigint, b bigint"))


def verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs a, b whose sets (unit, hashes) have a Jaccard similarity of similarity or more. Both joins stand on shuffles of their own, which AQE can split at a hub."""
    of = lambda side: sets.select(F.col("unit").alias(side), F.col("hashes").alias(f"of_{side}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "of_a", "of_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = np.frombuffer(x.as_buffer(), dtype="<u8"), np.frombuffer(y.as_buffer(), dtype="<u8")
                if min(len(x), len(y)) < similarity * max(len(x), len(y)):
                    good.append(False)
                    continue
                common = len(np.intersect1d(x, y, assume_unique=True))
                good.append(common >= similarity * (len(x) + len(y) - common))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(good, pa.bool_()))

    return written(both.mapInArrow(alone("simhash", run), "a bigint, b bigint"), "verified")


def sets_of(names: DataFrame, units: DataFrame, df: DataFrame, text_column: str, row_column: str, k: int) -> DataFrame:
    """unit, hashes, size (their number) of the units named (each once), from their texts."""
    named = names.join(units.select("unit", "row"), "unit")
    source = df.select(F.col(row_column).alias("row"), F.col(text_column).alias("text")).join(named, "row").select("unit", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = pa.array([_set(hashes_of(t.as_py() or b"", k)) for t in utf8(batch.column(1))], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), hashes, pc.divide(pc.cast(pc.binary_length(hashes), pa.int64()), 8)], names=["unit", "hashes", "size"])

    return written(source.mapInArrow(alone("simhash", run), "unit bigint, hashes binary, size bigint"), "sets")


def similar_links(units: DataFrame, df: DataFrame, text_column: str, row_column: str, k: int, max_bits: int, similarity: float) -> tuple[DataFrame, list[DataFrame]]:
    """Links a, b between units (unit, fp, sketch, row), as many as the classes by similarity need; and the written tables that they are read from."""
    # one after the other: joined in one job, their stages would run together and hold their memory together
    posted = written(postings(units), "postings")
    counted = written(posted.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "counted")
    members = written(posted.join(counted, "key"), "members")
    listed = written(members.select("unit").distinct(), "listed")
    marked = units.join(listed.withColumn("listed", F.lit(True)), "unit", "left").select("unit", "fp", F.col("listed").isNull().alias("alone"))
    prints = written(marked.groupBy("fp").agg(F.min("unit").alias("unit"), F.bool_or("alone").alias("alone"), F.count("*").alias("n")), "prints")
    equal = marked.where("alone").join(prints.where("n > 1").select("fp", F.col("unit").alias("b")), "fp").select(F.col("unit").alias("a"), "b")
    alike = written(_ordered(lone_links(prints, max_bits).union(equal)), "alike")
    for table in (posted, counted, prints):
        forget(table)
    group = F.shiftright("key", 32)
    pairs = written(neighbours(members.where(group < FIRST).withColumn("root", F.col("unit"))), "pairs")
    # every pair that is compared below stands in a list with another unit, so these are all the sets there is need of
    names = written(listed.union(alike.select(F.explode(F.array("a", "b")))).distinct(), "names")
    sets = sets_of(names, units, df, text_column, row_column, k)
    first = verified(pairs, sets, similarity)
    classes = written(components(first, "a", "b"), "classes")
    rooted = written(_rooted(members, "unit", classes), "rooted")
    more = written(_ordered(neighbours(rooted.where(group >= FIRST)).union(alike)).join(pairs, ["a", "b"], "left_anti"), "pairs")
    second = verified(more, sets, similarity)
    for table in (alike, listed, names, rooted, classes):
        forget(table)
    found = written(first.union(second), "found")
    classes = written(components(found, "a", "b"), "classes")
    rooted = written(_rooted(members, "unit", classes), "rooted")
    several = written(rooted.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y")).where("x != y").select("key"), "several")
    mixed = written(rooted.join(several, "key", "left_semi"), "mixed")
    for table in (members, rooted, several, classes, first, second, pairs, more):
        forget(table)
    lists = written(blocks(mixed, sets), "lists")
    last = written(across(mixed.select("key", "unit", "root"), lists, sets, similarity), "verified")
    for table in (mixed, lists, sets):
        forget(table)
    return found.union(last), [found, last]


def _rooted(rows: DataFrame, unit: str, classes: DataFrame) -> DataFrame:
    """rows with root, the least unit of the class (node, root) that the unit in a column is of."""
    return rows.join(classes.withColumnRenamed("node", unit), unit, "left").withColumn("root", F.coalesce("root", unit))


def _flips(free: list[int], d: int) -> np.ndarray:
    """All sets of up to d of the free bits."""
    return np.array([sum(1 << b for b in c) for n in range(1, d + 1) for c in combinations(free, n)], dtype=np.uint64)


def _least(members: np.ndarray, d: int, fewest: int, free: list[int]) -> np.ndarray:
    """For each distinct member of one list, the least member (as a signed long) that it reaches by links in the list."""
    members = np.sort(members)
    bits = members.view(np.uint64)
    n = len(members)
    left, right = [], []
    if n <= PAIRWISE:
        apart = bits[:, None] ^ bits[None, :]
        shared = 8 - (apart.view(np.uint8).reshape(n, n, 8) != 0).sum(axis=2)  # the tally of positional bytes
        found = np.triu((shared >= fewest) & (np.bitwise_count(apart) <= d), 1)
        a, b = np.nonzero(found)
        left, right = [a], [b]
    else:
        order = np.argsort(bits)
        ranked = bits[order]
        for flip in _flips(free, d):
            at = np.minimum(np.searchsorted(ranked, bits ^ flip), n - 1)
            here = np.nonzero(ranked[at] == bits ^ flip)[0]
            left.append(here)
            right.append(order[at[here]])
    a, b = np.concatenate(left), np.concatenate(right)
    low = np.arange(n)
    while True:
        before = low.copy()
        np.minimum.at(low, a, low[b])
        np.minimum.at(low, b, low[a])
        low = low[low]
        if (low == before).all():
            return np.stack([members, members[low]])


def free_bits(d: int) -> list[list[int]]:
    """The bits that each set of 8 - d positional bytes leaves free."""
    return [[8 * i + j for i in range(8) if i not in s for j in range(8)] for s in combinations(range(8), 8 - d)]


def _lists(prints: DataFrame, fp: str, d: int, *more: str) -> DataFrame:
    """at, part, fp, more: the lists of each fingerprint by sets of 8 - d positional bytes, a list's members one after the other."""
    if not 1 <= d <= 4:
        raise ValueError("the index is for 1 to 4 differing bits of 64")
    masks = [sum(0xFF << 8 * i for i in s) for s in combinations(range(8), 8 - d)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    fp_column = F.col(fp)
    key = F.explode(F.array(*(F.struct(F.lit(n).cast("tinyint").alias("at"), fp_column.bitwiseAND(F.lit(m)).alias("part")) for n, m in enumerate(signed))))
    posted = prints.select(key.alias("key"), fp_column.alias("fp"), *more).select("key.at", "key.part", "fp", *more)
    return posted.repartition("at", "part").sortWithinPartitions("at", "part")


def links(prints: DataFrame, fp: str, d: int) -> DataFrame:
    """Links a, b between distinct fingerprints that differ in at most d bits, as many as their classes need (see above)."""
    free = free_bits(d)

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for members in _runs(batches, 2):
            pair = _least(members.column(2).to_numpy(), d, 8 - d, free[members.column(0)[0].as_py()])
            a, b = pair[:, pair[0] != pair[1]]
            yield a, b

    return _lists(prints, fp, d).mapInArrow(alone("simhash", lambda batches: _pairs(linked(batches))), "a bigint, b bigint")


def lone_links(prints: DataFrame, d: int) -> DataFrame:
    """a, b: the units of prints (fp, unit, alone; each fp once) that are alone, each with the nearest print within d bits in every list that it stands in."""

    def linked(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for members in _runs(batches, 2):
            alone = np.nonzero(members.column(4).to_numpy(zero_copy_only=False))[0]
            if not len(alone):
                continue
            bits, units = members.column(2).to_numpy().view(np.uint64), members.column(3).to_numpy()
            order = np.argsort(bits)
            ranked, left = bits[order], alone
            for flip in _flips(free_bits(d)[members.column(0)[0].as_py()], d):  # those of fewer bits come first
                at = np.minimum(np.searchsorted(ranked, bits[left] ^ flip), len(ranked) - 1)
                met = ranked[at] == bits[left] ^ flip
                yield units[left[met]], units[order[at[met]]]
                left = left[~met]
                if not len(left):
                    break

    lists = _lists(prints, "fp", d, "unit", "alone")
    return lists.mapInArrow(alone("simhash", lambda batches: _pairs(linked(batches))), "a bigint, b bigint")


def near_duplicates(
    df: DataFrame, id_column: str = "doc_id", text_column: str = "text", k: int = 3, max_bits: int = 2, similarity: float | None = None, row_column: str | None = None
) -> DataFrame:
    """row, id, fingerprint, component_id, first of each row of df.

    row is row_column, which must name the rows of a written table for good, or row_id() over df; fingerprint has 16 hex
    digits; component_id is the least id that links of at most max_bits differing bits reach (with a similarity: links of
    shingle sets with a Jaccard similarity of that or more, whatever their fingerprints), the row's own included (null only
    if all those ids are null); first is true for one row of each
    class, that with the least id (nulls last) and then the least row. Texts without words have fingerprint zero and link
    like any other (with a similarity: with each other). Repeated rows and equal ids stay rows of their own; equal texts
    are always one class. Very long texts count whole. An empty table gives an empty result. Other columns of df, whatever
    their names, are not looked at.
    """
    done = []
    if similarity is not None and row_column is None:  # texts are read again by row
        df = written(df.select(row_id().alias("row"), F.col(id_column).alias("id"), F.col(text_column).alias("text")), "numbered")
        id_column, text_column, row_column, done = "id", "text", "row", [df]
    prints = written(fingerprints(df, id_column, text_column, k, similarity is not None, row_column), "fingerprints")
    by_id = F.struct(F.col("id").isNull().alias("none"), "id", "row")
    name = "fp" if similarity is None else "unit"
    if similarity is None:
        distinct = written(prints.groupBy("fp").agg(F.min(by_id).alias("least")), "distinct")
        found = links(distinct, "fp", max_bits)
    else:
        distinct = written(prints.groupBy("unit").agg(F.min(by_id).alias("least"), F.min("fp").alias("fp"), F.min("sketch").alias("sketch"), F.min("row").alias("row")), "distinct")
        found, tables = similar_links(distinct, df, text_column, row_column, k, max_bits, similarity)
        done += tables
    classes = written(components(found, "a", "b"), "classes")
    least = written(classes.join(distinct, classes.node == distinct[name]).groupBy("root").agg(F.min("least").alias("of_class")), "least")
    linked = written(classes.join(least, "root").select(F.col("node").alias(name), "of_class"), "linked")
    labels = written(distinct.join(linked, name, "left").select(name, F.coalesce("of_class", "least").alias("least")), "labels")
    for table in (*done, distinct, classes, least, linked):
        forget(table)
    return prints.join(labels, name).select(
        "row",
        prints.id,
        F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("least.id").alias("component_id"),
        (F.col("row") == F.col("least.row")).alias("first"),
    )
