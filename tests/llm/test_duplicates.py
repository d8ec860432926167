import random

import numpy as np
import pytest
import xxhash

from quercus.llm import simhash


def plain_fingerprint(text, k):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def classes(fps, ids, d):
    parent = list(range(len(fps)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= d:
                parent[find(i)] = find(j)
    least = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(least.get(find(i), x), x)
    return [least.get(find(i)) for i in range(len(fps))]


def texts(n):
    rng = random.Random(6)
    words = ["".join(rng.choices("abcdefgé", k=rng.randint(1, 4))) for _ in range(60)]
    base = [" ".join(rng.choices(words, k=rng.randint(1, 120))) for _ in range(n)]
    near = []
    for t in base[: n // 2]:
        w = t.split()
        w[rng.randrange(len(w))] = "changed"
        near.append(" ".join(w))
    return [*base, *near, *base[: n // 4], None, "", " \t\n", " ", "One Two", "one two", "x " * 40000]


def test_equals_brute_force(spark):
    every = texts(80)
    ids = [None if i % 17 == 3 else i // 2 for i in range(len(every))]  # ids repeat and some are null
    df = spark.createDataFrame([(i, t, "clash", n) for n, (i, t) in enumerate(zip(ids, every, strict=True))], "doc_id bigint, text string, fp string, row bigint").coalesce(1)
    got = sorted(simhash.near_duplicates(df).collect(), key=lambda r: r.row)
    fps = [plain_fingerprint(t, 3) for t in every]
    assert [r.fingerprint for r in got] == [f"{f:016x}" for f in fps]
    want = classes(fps, ids, 2)
    assert [r.component_id for r in got] == want
    assert simhash.near_duplicates(df.limit(0)).count() == 0


@pytest.mark.parametrize("d", [1, 2, 3])
def test_links_keep_every_class(spark, d):
    rng = np.random.default_rng(d)
    base = rng.integers(0, 1 << 63, 40, dtype=np.uint64)
    fps = {int(b) for b in base}
    for b in base[:20]:
        x = int(b)
        for _ in range(20):  # walks of close steps
            for bit in rng.integers(0, 64, int(rng.integers(1, d + 2))):
                x ^= 1 << int(bit)
            fps.add(x)
    fps = sorted(fps)
    df = spark.createDataFrame([(f - (1 << 64) if f >> 63 else f,) for f in fps], "fp bigint").repartition(4)
    edges = [(r.a % (1 << 64), r.b % (1 << 64)) for r in simhash.links(df, "fp", d).collect()]
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        parent[find(a)] = find(b)
    groups = {}
    for f in fps:
        groups.setdefault(find(f), set()).add(f)
    plain = classes(fps, list(range(len(fps))), d)
    want = {}
    for f, c in zip(fps, plain, strict=True):
        want.setdefault(c, set()).add(f)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, want.values()))


def test_long_list_equals_pairs():
    """One list of more members than are compared pair by pair."""
    rng = np.random.default_rng(9)
    members = np.unique(rng.integers(0, 1 << 16, 900).astype(np.int64))
    free = list(range(16))
    long = simhash._least(members, 2, 6, free)
    least = dict(zip(members.tolist(), classes(members.tolist(), members.tolist(), 2), strict=True))
    assert {int(a): int(b) for a, b in long.T} == least


def test_similarity_finds_near_copies(spark):
    rng = random.Random(7)
    words = ["".join(rng.choices("abcdefghij", k=5)) for _ in range(4000)]
    docs, pairs = [], []
    for n in range(60):
        t = rng.choices(words, k=300)
        near = list(t)
        for _ in range(n % 12):
            near[rng.randrange(300)] = rng.choice(words)
        docs += [" ".join(t), " ".join(near)]
        a, b = ({" ".join(x[i : i + 5]) for i in range(296)} for x in (t, near))
        pairs.append(len(a & b) / len(a | b))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string")
    got = {r.id: r.component_id for r in simhash.near_duplicates(df, k=5, max_bits=3, similarity=0.8).collect()}
    caught = [got[2 * n] == got[2 * n + 1] for n in range(60)]
    assert all(c for c, j in zip(caught, pairs, strict=True) if j >= 0.85)
    assert not any(c for c, j in zip(caught, pairs, strict=True) if j < 0.65)
    assert len(set(got.values())) == 120 - sum(caught)


def shingles(text, k=5):
    w = text.split()
    return {" ".join(w[i : i + k]) for i in range(len(w) - k + 1)}


def groups_by_jaccard(docs, least):
    """The classes of all pairs that reach least, as sets of places."""
    sets, root = [shingles(d) for d in docs], list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            common = len(a & sets[j])
            if root[i] != root[j] and common >= least * (len(a) + len(sets[j]) - common):
                old, new = root[i], root[j]
                root = [new if r == old else r for r in root]
    return {frozenset(i for i, r in enumerate(root) if r == x) for x in root}


def groups_found(spark, docs, partitions):
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(partitions)
    found = {}
    for r in simhash.near_duplicates(df, k=5, max_bits=3, similarity=0.8).collect():
        found.setdefault(r.component_id, set()).add(r.id)
    return {frozenset(g) for g in found.values()}


def test_repeated_line_is_no_similarity(spark):
    rng = random.Random(3)
    line = " ".join(f"line{i}" for i in range(11))
    docs = [" ".join([line] * 20 + [f"w{rng.randrange(10**9)}" for _ in range(100)]) for _ in range(30)]
    assert groups_found(spark, docs, 3) == {frozenset([i]) for i in range(30)}


def test_pairs_about_the_similarity(spark):
    rng = random.Random(4)
    docs = []
    for n in range(150):
        t = [f"w{rng.randrange(10**9)}" for _ in range(304)]
        near = list(t)
        for i in range(5 + n % 5):  # 0.85 to 0.75
            near[20 + 30 * i] = "changed"
        docs += [" ".join(t), " ".join(near)]
    assert groups_found(spark, docs, 3) == groups_by_jaccard(docs, 0.8)


def test_drifting_group_over_partitions(spark, monkeypatch):
    monkeypatch.setattr(simhash, "BLOCK", 16)
    rng = random.Random(8)
    docs = [[f"w{rng.randrange(10**9)}" for _ in range(154)]]
    for n in range(400):
        near = list(docs[rng.randrange(len(docs))])
        for _ in range(rng.choice((2, 3, 3, 3, 3, 4))):
            near[rng.randrange(154)] = f"x{n}" if rng.random() < 0.5 else "changed"
        docs.append(near)
    docs = [" ".join(d) for d in docs]
    want = groups_by_jaccard(docs, 0.8)
    assert max(map(len, want)) > 100 and len(want) > 10
    assert groups_found(spark, docs, 8) == want


def test_equal_fingerprints_keep_their_own_links(spark):
    rng = random.Random(5)
    line = " ".join(f"line{i}" for i in range(11))
    docs = []
    for _ in range(10):
        own = [f"w{rng.randrange(10**9)}" for _ in range(100)]
        docs.append(" ".join([line] * 200 + own))
        docs.append(" ".join([line] * 200 + [*own[:50], "changed", *own[51:]]))
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(3)
    got = simhash.near_duplicates(df, k=5, max_bits=3, similarity=0.8).collect()
    assert len({r.fingerprint for r in got}) < len(docs) / 2
    assert all(r.component_id == r.id - r.id % 2 for r in got)


def test_similarity_with_odd_rows(spark):
    """Nulls, empty and blank texts, repeated rows and ids, short and very long texts; an empty table."""
    rng = random.Random(12)
    long = [f"w{rng.randrange(10**9)}" for _ in range(30_000)]
    docs = [None, "", " \n", "one", "One", "one two", "a b c d e", "A b c d e", " ".join(long), " ".join([*long[:15_000], "changed", *long[15_001:]]), None, "one two"]
    rows = [(None if n == 3 else n, d, "clash") for n, d in enumerate(docs)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, unit string").coalesce(1)
    got = simhash.near_duplicates(df, k=5, max_bits=3, similarity=0.8).orderBy("row").collect()
    groups = {}
    for n, r in enumerate(got):
        groups.setdefault(r.component_id, set()).add(n)
    assert {frozenset(g) for g in groups.values()} == set(map(frozenset, ([0, 1, 2, 10], [3, 4], [5, 11], [6, 7], [8, 9])))
    assert sum(r.first for r in got) == 5
    assert simhash.near_duplicates(df.limit(0), k=5, max_bits=3, similarity=0.8).count() == 0


def test_layouts_give_equal_groups(spark, tmp_path):
    rng = random.Random(13)
    docs = []
    for _ in range(60):
        t = [f"w{rng.randrange(10**9)}" for _ in range(120)]
        docs.append(" ".join(t))
        for i in range(rng.randint(0, 4)):
            t[rng.randrange(120)] = f"x{i}"
            docs.append(" ".join(t))
    found = [groups_found(spark, docs, n) for n in (1, 5, 16)]
    assert found[0] == found[1] == found[2] == groups_by_jaccard(docs, 0.8)


def test_pairs_at_the_similarity(spark):
    """Of a thousand pairs from 0.80 to 0.82 nearly all are found, and of as many below 0.8 none."""
    rng = random.Random(14)
    docs, near = [], []
    for n in range(1200):
        t = [f"w{rng.randrange(10**9)}" for _ in range(204)]  # 200 shingles; an inner change takes 5 of them
        u = list(t)
        for i in range(4 if n % 2 else 5):
            u[10 + 40 * i] = "changed"
        a, b = ({" ".join(x[i : i + 5]) for i in range(200)} for x in (t, u))
        near.append(len(a & b) / len(a | b))
        docs += [" ".join(t), " ".join(u)]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id bigint, text string").repartition(4)
    got = {r.id: r.component_id for r in simhash.near_duplicates(df, k=5, max_bits=3, similarity=0.8).collect()}
    at = [got[2 * n] == got[2 * n + 1] for n, j in enumerate(near) if 0.8 <= j <= 0.82]
    assert len(at) >= 500 and sum(at) >= 0.995 * len(at)
    assert not any(got[2 * n] == got[2 * n + 1] for n, j in enumerate(near) if j < 0.8)


def test_pairs_of_a_loose_group_are_not_joined(spark, monkeypatch):
    """Copies of one text that are like it, but not like each other, or only some of them: nothing grows with their pairs but comparisons within a task."""
    rng = random.Random(16)
    base, docs = [f"w{rng.randrange(10**9)}" for _ in range(204)], []
    for n in range(150):
        t = list(base)
        for i in rng.sample(range(25), 3 if n % 3 else 5):  # 0.73 to 0.86 of each other
            t[5 + 8 * i] = f"x{rng.randrange(40)}"
        docs.append(" ".join(t))
    joined, verified = [], simhash.verified

    def counted(pairs, *rest):
        joined.append(pairs.count())
        return verified(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    monkeypatch.setattr(simhash, "BLOCK", 16)
    want = groups_by_jaccard(docs, 0.8)
    assert 2 < len(want) and groups_found(spark, docs, 3) == want
    assert 0 < sum(joined) <= 20 * len(docs)


@pytest.mark.parametrize("main", [0, 60])
def test_every_two_of_other_classes_meet_once_in_blocks(spark, monkeypatch, main):
    """A class that has most of a list doesn't meet itself: rows in proportion to its members."""
    monkeypatch.setattr(simhash, "BLOCK", 4)
    roots = [0] * main + list(range(1, 13))
    members = spark.createDataFrame([(5, n, r) for n, r in enumerate(roots)], "key bigint, unit bigint, root bigint")
    sets = spark.createDataFrame([(n, bytes(80), 10) for n in range(len(roots))], "unit bigint, hashes binary, size bigint")
    rows = simhash.dealt(members, simhash.blocks(members, sets)).collect()
    cells, met = {}, []
    for r in rows:
        cells.setdefault((r.low, r.high), []).append(r)
    for (low, high), of in cells.items():
        met += [tuple(sorted((a.unit, b.unit))) for a in of for b in of if a.own == low and b.own == high and (low != high or a.unit < b.unit)]
    wanted = {(a, b) for b in range(len(roots)) for a in range(b) if roots[a] != roots[b]}
    assert len(met) == len(set(met)) and set(met) >= wanted
    assert sum(r.root == 0 for r in rows) <= 3 * main
