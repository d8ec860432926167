import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quercus.llm import quality, urls
from quercus.llm.queries import URL_RULES

URLS = [
    "http://Example.COM/en/7?x",
    "https://a.example.com/en/9",
    "http://x.net/de/1",
    "http://example.net/de/8#t",
    "http://b.example.net/de/88/",
    "http://notexample.net/de/8",
    "http://o.org/es/",
    "http://o.org/es",
    "http://com/en/",
    "http://xcom/en/",
    "no scheme/en/",
    "",
    None,
    "http://",
    "a://b://c.com/en/1",
    "http://ÉX.com/en/1?http://x.net/de/",
    "http://" + "a" * 60000 + ".com/en/",
    "http://x.net/de/1\n",
    "http://x.net?/de/",
]


def plain(url):
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in host)
    fits = [r for r in URL_RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    return host, path, max(fits, key=lambda r: len(r.name), default=None)


def test_rules(spark):
    df = spark.createDataFrame([(n if n else None, u, "x", 1.0) for n, u in enumerate(URLS)] + [(1, URLS[1], "x", 1.0)], "page_id bigint, url string, host string, score double")
    got = urls.judged(df, URL_RULES).collect()
    assert len(got) == len(URLS) + 1
    for r in got:
        host, path, rule = plain(URLS[r.id or 0])
        assert (r.host, r.path, r.rule) == (host, path, rule and rule.name)
        assert r.verdict == rule.verdict if rule else r.verdict in ("allow", "block")
    assert urls.judged(df.limit(0), URL_RULES).count() == 0


def test_url_model_tells_classes_apart(spark):
    rng = random.Random(8)
    word = lambda s: "".join(rng.choices(s, k=7))
    rules = [urls.Rule("allow", "good.com", "/"), urls.Rule("block", "bad.com", "/")]
    rows = [(n, f"http://{'good' if n % 2 else 'bad'}.com/{word('abcde') if n % 2 else word('vwxyz')}") for n in range(600)]
    rows += [(n, f"http://other.com/{word('abcde') if n % 2 else word('vwxyz')}") for n in range(600, 700)]
    got = urls.judged(spark.createDataFrame(rows, "page_id bigint, url string"), rules).where("rule is null").collect()
    assert len(got) == 100 and sum((r.verdict == "allow") == bool(r.id % 2) for r in got) >= 98


def test_scores_equal_plain_model():
    """Hashed grams against counts of strings."""
    texts = [b"http://a.b/c", b"", b"x", b"http://a.b/dd"]
    model = np.stack([urls._counts(texts[:2]), urls._counts(texts[2:])]).astype(float)

    def counts(some):
        out = {}
        for t in some:
            s = b"\x02" + t + b"\x03"
            for n in range(1, urls.LONGEST + 1):
                for i in range(len(s) - n + 1):
                    out[s[i : i + n]] = out.get(s[i : i + n], 0) + 1
            out[b""] = out.get(b"", 0) + len(s)
        return out

    known = [counts(texts[:2]), counts(texts[2:])]
    for t, score in zip(texts, urls.scores(texts, model), strict=True):
        s, total = b"\x02" + t + b"\x03", 0.0
        for sign, c in ((1, known[0]), (-1, known[1])):
            for i in range(len(s)):
                p = 1 / 256
                for n in range(1, min(urls.LONGEST, i + 1) + 1):
                    p = min(1.0, (c.get(s[i - n + 1 : i + 1], 0) + urls.BLEND * p) / (c.get(s[i - n + 1 : i], 0) + urls.BLEND))
                total += sign * np.log(p)
        assert score == pytest.approx(total / len(s))


def corpus(n=1500):
    rng = random.Random(9)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 6))) for _ in range(400)]
    rows, labels = [], []
    for i in range(n):
        good = i % 5 != 0
        text = " ".join(rng.choices(words, k=rng.randint(20, 200)))
        if not good:
            text = " | ".join(rng.choices(words, k=60)) if i % 2 else "worthless " + text + " idiot"
        rows.append((i, text, "clash", 0.5))
        if i % 3:
            labels.append((i, int(good or i % 2 == 0), int(not good and i % 2 == 0)))
    return rows, labels


def test_resampling_keeps_the_good(spark):
    rows, known = corpus()
    rows += [(9001, None, "x", 0.1), (9002, "", "x", 0.1), (9003, " \n", "x", 0.1), (None, rows[1][1], "x", 0.1), (1, rows[1][1], "x", 0.1)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw string, log_weight double").repartition(4)
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    kept = quality.resampled(docs, labels)
    assert kept.columns == ["doc_id", "text", "raw", "log_weight", "gumbel_key"]
    ids = [r.doc_id for r in kept.collect()]
    assert all(i is None or i < 9000 for i in ids) and None in ids and ids.count(1) == 2
    good = [i for i in range(1500) if i % 5]
    assert len({*good} & {*ids}) >= 0.995 * len(good)
    assert len([i for i in ids if i is not None and i % 5 == 0]) <= 0.05 * 300
    slim = quality.resampled(docs, labels, drop_columns=True)
    assert sorted(map(str, ids)) == sorted(str(r.doc_id) for r in slim.collect())
    # exactly k, and the heaviest weights are preferred
    some = quality.resampled(docs.where("doc_id is not null and doc_id != 1"), labels, k=700, drop_columns=True).collect()
    assert len(some) == 700 and sum(r.doc_id % 5 == 0 for r in some) <= 20


def test_model_equals_plain_counts(spark):
    """Counts, evidence, ratios and weights against loops over sets of features; then the k largest keys."""
    import math

    rows, known = corpus(300)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw string, w double").repartition(3)
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    split = {r.id: (r.kind, r.held_out) for r in quality._labels(labels).collect()}
    assert all(kind == ("toxic" if t else "good" if q else "low") for i, q, t in known for kind in [split[i][0]])
    of = {i: quality.features(t) for i, t, _, _ in rows}
    plain = [[{}, {}, {}], [{}, {}, {}]]
    totals = [0, 0, 0]
    for i, f in of.items():
        kinds = [0] + ([1] if i in split and not split[i][1] else []) + ([2] if split.get(i) == ("good", False) else [])
        for k in kinds:
            totals[k] += 1
            for side in (0, 1):
                for b in set(f[side].tolist()):
                    plain[side][k][b] = plain[side][k].get(b, 0) + 1

    def ratio(side, b):
        raw, n, t = (plain[side][k].get(b, 0) for k in range(3))
        r = math.log((t + quality.SMOOTH) / (raw * totals[2] / totals[0] + quality.SMOOTH))
        rate = totals[2] / totals[1]
        share = t / n if n else 0.0
        evidence = n * ((share * math.log(share / rate) if share else 0.0) + ((1 - share) * math.log((1 - share) / (1 - rate)) if share < 1 else 0.0))
        level = sum(evidence >= bar for bar in quality.BARS) if (share < rate) == (r < 0) else 0
        return (r if level else 0.0), level

    fitted = quality.fit(docs, labels)
    for i in list(of)[:60]:
        want = [0.0] * 8
        for a, b in of[i].T.tolist():
            (ra, la), (rb, lb) = ratio(0, a), ratio(1, b)
            r, level = (ra if abs(ra) <= abs(rb) else rb), min(la, lb)
            for bar in range(4):
                if level > bar:
                    want[bar] += r
                    want[4 + bar] += min(r, 0.0)
        assert fitted.weights(rows[i][1]) == pytest.approx(want, abs=1e-4)
    assert (fitted.ratios != 0).sum() > 20 and (fitted.ratios > 0).any() and (fitted.ratios < 0).any()
    scored = {r.doc_id: r.weights for r in quality.weighted(docs, fitted, drop_columns=True).collect()}
    rule = quality.calibrated(np.array([scored[i][:-1] for i, x in split.items() if x[1]]), np.array([x[0] for x in split.values() if x[1]]))
    got = {r.doc_id: (r.log_weight, r.gumbel_key) for r in quality.resampled(docs, labels, k=50, drop_columns=True).collect()}
    able = {i: w[rule.bar] - rule.threshold for i, w in scored.items() if w[4 + rule.veto_bar] >= rule.veto}
    keys = {i: w / quality.TEMPERATURE + scored[i][-1] for i, w in able.items()}
    best = sorted(keys, key=lambda i: -keys[i])[:50]
    assert set(got) == set(best) and all(got[i] == pytest.approx((able[i], keys[i])) for i in best)


def test_cut_equals_all_cuts():
    rng = np.random.default_rng(3)
    for _ in range(50):
        values = rng.integers(-4, 5, 40) / 2.0
        kinds = rng.choice(["good", "toxic", "low"], 40)
        cost, at = quality._cut(values, kinds)
        plain = lambda c: quality.COST * (values[kinds == "good"] < c).mean() + np.mean([(values[kinds == k] >= c).mean() for k in ("toxic", "low")])
        assert cost == pytest.approx(plain(at)) == pytest.approx(min(map(plain, [-9.0, *(np.unique(values) + 0.25), 9.0])))


def test_draw_decides_at_the_threshold(spark):
    """At temperature 1 rows are drawn in proportion to their weights; at the default one the draw decides among those about the threshold."""
    rows, known = corpus(600)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw string, w double")
    labels = spark.createDataFrame(known, "doc_id bigint, quality int, toxic int")
    by_weight = {r.doc_id for r in quality.resampled(docs, labels, k=200, temperature=1e-6, drop_columns=True).collect()}
    drawn = [{r.doc_id for r in quality.resampled(docs, labels, k=200, temperature=t, seed=s, drop_columns=True).collect()} for t, s in ((1.0, 1), (1.0, 2), (quality.TEMPERATURE, 1))]
    assert len({*map(frozenset, (by_weight, *drawn))}) == 4
    assert len(by_weight & drawn[2]) > len(by_weight & drawn[0]) > 60


def test_resampling_without_labels(spark):
    rows, _ = corpus(60)
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, raw string, w double")
    none = spark.createDataFrame([], "doc_id bigint, quality int, toxic int")
    odd = spark.createDataFrame([(None, 1, 0), (1, None, None), (2, 1, 0), (2, 0, 0)], none.schema)
    assert quality.resampled(docs, none).count() == 60
    assert quality.resampled(docs, odd).count() == 60
    assert quality.resampled(docs.limit(0), none).count() == 0
    long = spark.createDataFrame([(1, "word " * 200_000)], "doc_id bigint, text string")
    assert quality.resampled(long, none).count() == 1


def test_kth_largest(spark):
    df = spark.range(30000).select((F.hash("id") % 5000 / F.lit(7.0)).alias("v"))
    values = sorted((r.v for r in df.collect()), reverse=True)
    for k in (1, 2, 777, 15000, 30000):
        assert quality.kth_largest(df, "v", k) == values[k - 1]
    assert quality.kth_largest(df, "v", 30001) == float("-inf") and quality.kth_largest(df, "v", 0) == float("inf")
