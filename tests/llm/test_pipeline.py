import os
import random

import public_tokenizers
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from quercus.llm import bpe, decontaminate, quality, queries

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    rng = random.Random(13)
    words = ["".join(rng.choices("abcdefghij", k=rng.randint(2, 7))) for _ in range(500)]
    text = lambda n: " ".join(rng.choices(words, k=n))
    docs, labels, kind = [], [], {}
    for i in range(400):
        kind[i] = "bad" if i % 8 == 0 else "good"
        docs.append((i, " | ".join(rng.choices(words, k=50)) if kind[i] == "bad" else text(rng.randint(60, 200)), "en", "s", 0, "extra"))
        labels.append((i, int(kind[i] == "good"), 0))
    passage = text(30)
    docs.append((1000, docs[1][1], "en", "s", 0, None))
    near = docs[2][1].split()
    near[5] = "changed"
    docs.append((1001, " ".join(near), "en", "s", 0, None))
    docs.append((1002, f"{text(80)} {passage} {text(50)}", "en", "s", 0, None))
    docs.append((1003, f"{text(80)} password=hunter2222 {text(50)}", "en", "s", 0, None))
    docs += [(1004, None, None, None, None, None), (1005, "", "en", "s", 0, None), (None, text(90), None, None, None, None)]
    path = str(tmp_path_factory.mktemp("sf"))
    docs = [(i, t, lang, s, None if t is None else len(t), x) for i, t, lang, s, _, x in docs]
    spark.createDataFrame(docs, "doc_id bigint, text string, lang string, source string, n_chars bigint, N_hit string").repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(1, passage)], "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path, kind


def test_stages(spark, small, tmp_path):
    path, kind = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    columns, ids = docs.columns, {}
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, path)
        if n < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        ids[name] = [r.doc_id for r in docs.select("doc_id").collect()]
    good = {i for i, k in kind.items() if k == "good"}
    assert good | {1000, 1001, 1002, 1003, None} == set(ids["quality"])
    assert set(ids["quality"]) - set(ids["near_dedup"]) == {1000, 1001}
    assert set(ids["near_dedup"]) - set(ids["decontaminate"]) == {1002}
    assert sorted(map(str, ids["secrets"])) == sorted(map(str, ids["decontaminate"])) == sorted(map(str, ids["bpe"]))
    masked = spark.read.parquet(f"{tmp_path}/3").where("doc_id = 1003").first()
    assert "hunter2222" not in masked.text and masked.n_chars == len(masked.text)
    assert sorted(map(str, corpus_pipeline.run(spark, path).collect())) == sorted(map(str, docs.collect()))


def test_clashing_names_stay(spark, small, tmp_path):
    """Columns called like those that operators add come out of every stage as they went in."""
    path, _ = small
    clash = ["log_weight", "Gumbel_Key", "n_words", "items", "row", "__row", "weights", "noise", "unit", "secrets", "own_items", "spans"]
    docs = spark.read.parquet(f"{path}/documents.parquet")
    docs = docs.select("*", *(F.concat(F.lit(f"{c} "), F.coalesce(F.col("doc_id").cast("string"), F.lit("none"))).alias(c) for c in clash))
    for n, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, path)
        assert out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{n}")
        docs = spark.read.parquet(f"{tmp_path}/{n}")
        for r in docs.collect():
            assert [r[c] for c in clash] == [f"{c} {'none' if r.doc_id is None else r.doc_id}" for c in clash]
    assert docs.count() > 300


def test_empty_tables(spark, small, tmp_path):
    path, _ = small
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{path}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


def test_registered():
    names = entry.queries()
    assert "pipeline" in names and all(any(n.startswith(f"op{i}_") for n in names) for i in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontaminate", "secrets", "bpe"]


@pytest.mark.skipif(not os.path.isdir(SF), reason="needs the test tables")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query_equals_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for f in os.listdir(SF):
        con.execute(f"create view {f.removesuffix('.parquet')} as select * from '{SF}/{f}'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [c[0] for c in found.description]
    columns = sorted(df.columns)
    assert columns == sorted(names)
    want = sorted((tuple(dict(zip(names, r, strict=True))[c] for c in columns) for r in found.fetchall()), key=repr)
    assert sorted((tuple(r[c] for c in columns) for r in df.select(*(F.col(c) for c in columns)).collect()), key=repr) == want


def test_groups_hold_when_the_scan_splits_otherwise(spark, small, tmp_path):
    """Splits depend on the cores that are registered; here a setting changes them between the scans."""
    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet").where("text is not null")
    docs.union(docs.selectExpr("doc_id + 5000", *docs.columns[1:])).coalesce(1).write.option("parquet.block.size", 20000).parquet(f"{tmp_path}/documents")
    split, key = spark.read.parquet(f"{tmp_path}/documents"), "spark.sql.files.maxPartitionBytes"
    before = spark.conf.get(key)
    out = corpus_pipeline.keep_one_of_each_group(spark, split, path)
    try:
        spark.conf.set(key, "20000")
        kept = [(r.doc_id, r.text) for r in out.collect()]
    finally:
        spark.conf.set(key, before)
    texts = {r.text for r in split.collect()}
    assert len(kept) == len({t for _, t in kept}) and len(kept) >= len(texts) - 1
    assert all(i is None or i < 5000 for i, _ in kept)


def test_a_worker_keeps_only_the_running_stages_tables(spark, small, monkeypatch):
    """Workers live on: tables of all stages in one of them took more memory than an executor has."""
    path, _ = small
    docs = spark.read.parquet(f"{path}/documents.parquet")
    sent = []
    with monkeypatch.context() as patch:
        patch.setattr(type(docs), "mapInArrow", lambda self, f, *more: sent.append(f) or self)
        quality.weighted(docs, quality.model(*(quality.np.zeros((3, 2 * quality.BUCKETS + 1)))))
        corpus_pipeline.encode(spark, docs, path)
        corpus_pipeline.mask_secrets(spark, docs, path)
    weigh, encode, mask = sent
    tables = lambda: [bool(t) for t in (quality._codes, decontaminate._codes, bpe._workers)]
    quality.features("three short words")
    decontaminate.codes_of([b"word"])
    list(encode(iter(())))
    assert tables() == [False, False, True]
    quality.features("three short words")
    list(weigh(iter(())))
    assert tables() == [True, False, False]
    list(mask(iter(())))
    assert tables() == [False, False, False]


def test_kept_words_and_pairs_only_bound_memory(monkeypatch):
    data = bpe.tokenizer_bytes(public_tokenizers.path("word_bpe_49k.json"))
    texts = [f"one {i} unusualwords{i} don't übermäßig {'x' * i}" for i in range(60)]
    whole = bpe.prefix_encoder(data)
    want = [whole.encode(t) for t in texts]
    bpe._workers.clear()
    monkeypatch.setattr(bpe, "KEPT_WORDS", 7)
    monkeypatch.setattr(bpe, "KEPT_PAIRS", 5)
    few = bpe.prefix_encoder(data)
    assert [few.encode(t) for t in texts] == want
    assert len(few) <= 7 and len(few.of_word.__self__.known) <= 5
    bpe._workers.clear()
