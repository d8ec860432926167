"""Queries through normalisers, keys, hashes and picture columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.functions import hashing, imaging
from quercus.functions import text as T
from quercus.functions.tables import read, written
from quercus.operators import fit, graph, legacy, recommend, textindex
from quercus.plans import service
from quercus.plans.registry import query

_KEYED = lambda c: f"trim(regexp_replace(lower({c}), '[^a-z0-9]+', '_', 'g'), '_')"
#: Letters that the table of media names gives back unchanged.
_BACK, _SINGLE = "абвгдезийклмнопрстуфхы", "abvgdezijklmnoprstufhy"


def _docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents")


@query(
    r"""WITH t AS (SELECT doc_id, ' ' || replace(coalesce(text, ''), ' ', chr(9) || '  ') || chr(13) || chr(10) || 'e' || chr(769) || ' ' AS v FROM documents)
SELECT doc_id, sha256(trim(array_to_string(list_transform(string_split(replace(replace(nfc_normalize(v), chr(13) || chr(10), chr(10)), chr(13), chr(10)), chr(10)), lambda x: trim(regexp_replace(x, '[ \t]+', ' ', 'g'))), chr(10)), ' ' || chr(10))) AS cleaned FROM t"""
)
def cleaned_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    value = F.concat(F.lit(" "), F.replace(F.coalesce("text", F.lit("")), F.lit(" "), F.lit("\t  ")), F.lit("\r\né "))
    return _docs(spark, sf_dir).select("doc_id", F.sha2(T.clean(value), 256).alias("cleaned"))


@query(
    f"""SELECT p_partkey, {_KEYED("p_name || ' no ' || p_brand || 'x'")} AS media_key, CASE WHEN p_partkey % 3 = 0 THEN regexp_replace({_KEYED("p_name")}, '^((small|large)_)+', '') ELSE 'x' || {_KEYED("p_name")} END || '_png' AS archive_key, p_partkey % 3 = 0 AS is_rendition, replace({_KEYED("p_name || p_type")}, '_', '') AS compact FROM part"""
)
def media_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys of names in Cyrillic letters, with signs that fall away, and of renditions with the digits that uploads get."""
    k = F.col("p_partkey")
    cyrillic = lambda c: F.translate(F.lower(c), _SINGLE, _BACK)
    name = F.concat(F.lit("a/b/"), cyrillic(F.concat("p_name", F.lit(" no "), "p_brand", F.lit("x"))), F.lit("№.webp"))
    stored = F.concat(F.when(k % 3 == 0, "Thumbnail_small_").otherwise("x"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("_png_0a1b2c3d4e.webp"))
    return read(spark, sf_dir, "part").select("p_partkey", T.media_key(name).alias("media_key"), T.archive_key(stored).alias("archive_key"), T.is_rendition(stored).alias("is_rendition"), T.compact(T.media_key(F.concat(cyrillic(F.concat("p_name", "p_type")), F.lit(".x")))).alias("compact"))


@query(
    """WITH w AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS r FROM documents WHERE text IS NOT NULL) SELECT doc_id, sha256(array_to_string(r, ' ')) AS words, sha256(array_to_string(list_transform(list_sort(list_transform(list_distinct(r), lambda x: x)), lambda x: x), ' ')) AS distinct_words FROM w"""
)
def query_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _docs(spark, sf_dir).where("text is not null")
    return d.select("doc_id", F.sha2(T.query_text(F.col("text")), 256).alias("words"), F.sha2(F.array_join(F.array_sort(T.query_tokens(F.col("text"))), " "), 256).alias("distinct_words"))


@query(
    r"""WITH w AS (SELECT doc_id, regexp_extract_all(replace(lower(text || ' 1987 2150 19 Straße'), 'ß', 'ss'), '[\p{L}\p{N}]+') AS w FROM documents)
SELECT doc_id, sha256(array_to_string(list_filter(w, lambda x: NOT regexp_full_match(x, '(19|20)[0-9]{2}')), ' ')) AS words FROM w"""
)
def words_without_years(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", F.sha2(F.array_join(T.without_years(T.words(F.concat("text", F.lit(" 1987 2150 19 Straße")))), " "), 256).alias("words"))


@query(
    """WITH w AS (SELECT DISTINCT a.p_name AS a, b.p_type AS b FROM part a JOIN part b ON a.p_partkey = b.p_partkey),
t AS (SELECT *, lower(split_part(a, ' ', 1)) AS x, CASE WHEN length(a) % 3 = 0 THEN lower(split_part(a, ' ', 1)) WHEN length(a) % 3 = 1 THEN lower(split_part(a, ' ', 1)) || '7' ELSE 'qzj' END AS y FROM w)
SELECT a, b, length(a) % 3 = 0 OR (x = 'red' AND y = 'qzj') AS same FROM t"""
)
def token_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Equal words, words with another number, and words that a map makes equal."""
    p = read(spark, sf_dir, "part").select(F.col("p_name").alias("a"), F.col("p_type").alias("b")).distinct()
    x, n = F.lower(F.substring_index("a", " ", 1)), F.length("a") % 3
    y = F.when(n == 0, x).when(n == 1, F.concat(x, F.lit("7"))).otherwise("qzj")
    return p.select("a", "b", T.tokens_match(x, y, {"red": "qzj"}).alias("same"))


_ROMAN = "['', 'i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix'][1 + p_size % 10]"
_TENS = "['', 'x', 'xx', 'xxx', 'xl', 'l'][1 + p_size // 10]"


@query(f"SELECT p_partkey, CASE WHEN length({_TENS} || {_ROMAN}) >= 2 THEN p_size::VARCHAR END AS value, CASE WHEN p_size > 0 THEN (100 + p_size)::VARCHAR END AS more FROM part")
def roman_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    text = F.concat(at(["", "x", "xx", "xxx", "xl", "l"], F.floor(F.col("p_size") / 10)), at(["", "i", "ii", "iii", "iv", "v", "vi", "vii", "viii", "ix"], F.col("p_size") % 10))
    return read(spark, sf_dir, "part").select("p_partkey", T.roman(text).alias("value"), T.roman(F.concat(F.lit("c"), text)).alias("more"))


@query(
    """WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents)
SELECT w, CASE WHEN regexp_full_match(w, '[abcehkmoptxy3]{3,}') THEN translate(w, 'abcehkmoptxy3', 'авсенкмортхуз') ELSE w END AS fixed, translate(w || 'д', 'abcehkmoptxy3', 'авсенкмортхуз') AS mixed FROM w"""
)
def script_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _docs(spark, sf_dir).select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("w")).distinct()
    return w.select("w", T.lookalikes(F.col("w")).alias("fixed"), T.lookalikes(F.concat("w", F.lit("д"))).alias("mixed"))


PHRASES = [("Экстра-Брют", "extra_brut", None), ("вино полусухое КРАСНОЕ", "semi_dry", "red"), ("demi sec, Bianco", "semi_dry", "white"), ("Dry rosé", "dry", None), ("dolce and brut", "brut", None), ("drycask", None, None), ("ORANZH", None, "orange")]
_STYLED = lambda i: "CASE p_partkey % 7 " + " ".join(f"WHEN {n} THEN {'NULL' if x[i] is None else chr(39) + x[i] + chr(39)}" for n, x in enumerate(PHRASES)) + " END"


@query(f"SELECT p_partkey, {_STYLED(1)} AS sweetness, {_STYLED(2)} AS colour FROM part")
def style_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit("; "), F.element_at(F.array(*(F.lit(x[0]) for x in PHRASES)), (F.col("p_partkey") % 7 + 1).cast("int")))
    part = read(spark, sf_dir, "part").select("p_partkey", F.translate(F.regexp_replace(text, "red|blue", "zzz"), "\u0000", "").alias("t"))
    style = T.styles(F.col("t"))
    return part.select("p_partkey", F.try_element_at(style, F.lit("sweetness")).alias("sweetness"), F.try_element_at(style, F.lit("colour")).alias("colour"))


@query(
    """WITH t AS (SELECT p_partkey, list_filter(regexp_extract_all(lower(p_name || ' ab ' || p_partkey || ' 18 xviii red ' || p_type), '[a-z0-9]+'), lambda x: length(x) >= 3 AND NOT (regexp_full_match(x, '[0-9]+') AND length(x) < 4) OR x = '18') AS w FROM part)
SELECT p_partkey, array_to_string(list_sort(list_filter(list_distinct(list_concat(list_filter(w, lambda x: length(x) >= 3), ['18'])), lambda x: x <> 'red')), ',') AS tokens FROM t"""
)
def legacy_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat("p_name", F.lit(" ab "), F.col("p_partkey").cast("string"), F.lit(" 18 xviii red "), "p_type")
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(legacy.tokens(text), ",").alias("tokens"))


@query("""SELECT p_partkey, array_to_string(list_sort(list_distinct(list_transform(string_split(p_name, ' '), lambda x: x))), ',') AS grapes FROM part""")
def grape_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.concat(F.lit(" ; "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" /, ")), F.lit(" ,"), F.initcap("p_name"))
    grapes = T.grapes(F.replace(text, F.lit(" ,"), F.lit(",")))
    single = F.filter(grapes, lambda g: ~g.contains(" "))
    return read(spark, sf_dir, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.concat(single, F.split("p_name", " ")))), ",").alias("grapes"))


_STYLE = """CASE WHEN p_size % 6 = 0 THEN 'sparkling' WHEN p_size % 6 = 1 THEN 'sweet' WHEN p_size % 6 IN (2, 4) THEN 'red' WHEN p_size % 6 = 3 THEN 'rose' ELSE 'white' END"""


@query(
    f"""WITH s AS (SELECT p_partkey, {_STYLE} AS style FROM part) SELECT p_partkey, style, CASE style WHEN 'sparkling' THEN '6–8 °C' WHEN 'sweet' THEN '10–12 °C' WHEN 'red' THEN '16–18 °C' WHEN 'rose' THEN '8–10 °C' ELSE '8–12 °C' END AS temperature FROM s"""
)
def style_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    n = F.col("p_size") % 6
    text = F.when(n == 0, "a брют b").otherwise("plain")
    kind = F.when(n == 4, "Красное").otherwise("other")
    style = recommend.style_key(text, kind, F.when(n == 1, "sweet"), F.when(n == 2, "red").when(n == 3, "rose"))
    return read(spark, sf_dir, "part").select("p_partkey", style.alias("style"), recommend.serving(style)["temperature"].alias("temperature"))


@query(
    r"""SELECT p_partkey, CASE WHEN p_partkey % 3 = 0 THEN (SELECT string_agg(upper(w[1]) || w[2:], ' ' ORDER BY i) FROM (SELECT unnest(string_split(p_name, ' ')) AS w, unnest(range(1, 1 + len(string_split(p_name, ' ')))) AS i)) ELSE p_name END AS title,
  lower(p_type) AS grapes, CASE WHEN p_partkey % 4 <> 0 THEN '/v1/wines/' || replace(p_name, ' ', '-') || '/image' END AS image_url FROM part"""
)
def item_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = read(spark, sf_dir, "part")
    k = F.col("p_partkey")
    rows = p.select(k, F.replace("p_name", F.lit(" "), F.lit("-")).alias("slug"), F.when(k % 3 != 0, F.concat(F.lit(" "), "p_name")).alias("name"), F.concat("p_type", F.lit("; ")).alias("grapes"), F.when(k % 4 != 0, "p.png").alias("photo_name"))
    return _cards(rows)


def _cards(rows: DataFrame) -> DataFrame:
    """cards() for rows whose slugs repeat: each by itself."""
    one = rows.withColumnRenamed("slug", "own").withColumn("slug", F.col("own"))
    told = service.cards(one.withColumn("slug", F.concat_ws("@", "own", F.col("p_partkey").cast("string"))))
    k = F.regexp_extract("slug", "@([0-9]+)$", 1)
    plain = lambda c: F.regexp_replace(c, "@[0-9]+", "")
    return told.select(k.cast("bigint").alias("p_partkey"), plain("title").alias("title"), "grapes", plain("image_url").alias("image_url"))


@query("SELECT doc_id, left(sha256(source || chr(0) || doc_id), 20) AS id, ('0x' || left(sha256(doc_id::VARCHAR), 8))::UBIGINT::DOUBLE / 4294967295.0::DOUBLE AS share FROM documents")
def short_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", hashing.short_id(F.concat("source", F.lit("\0"), F.col("doc_id").cast("string"))).alias("id"), hashing.share(F.col("doc_id").cast("string")).alias("share"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_tax = 0 THEN 'empty_image' WHEN l_returnflag = 'R' THEN 'invalid_image' WHEN (l_quantity * 10)::BIGINT * l_suppkey > 2000 THEN 'image_too_large' WHEN least((l_quantity * 10)::BIGINT, l_suppkey) < 4 THEN 'image_too_small' END AS issue,
  CASE WHEN (l_quantity * 10) / (l_suppkey + 1) > 0.85 THEN floor(((l_quantity * 10)::INT - greatest(1, round_even((l_suppkey + 1) * 0.26, 0)::INT)) / 2)::INT ELSE 0 END AS crop_left FROM lineitem"""
)
def picture_limits(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide, high = (F.col("l_quantity") * 10).cast("int"), F.col("l_suppkey").cast("int")
    known = F.col("l_returnflag") != "R"
    issue = imaging.decode_issue(F.when(F.col("l_tax") != 0, 10).otherwise(0), F.when(known, wide), F.when(known, high), 2000, 4)
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", issue.alias("issue"), imaging.centre_view(wide, high + 1)["left"].alias("crop_left"))


@query(
    """SELECT l_orderkey, l_linenumber, l_partkey, round(least(1.0::DOUBLE, l_quantity / 38 * 0.55::DOUBLE + l_tax * 100 / 15 * 0.45::DOUBLE), 9) AS quality, CASE WHEN l_quantity < 8 THEN 'too_dark' WHEN l_tax * 100 < 3 THEN 'blurred' END AS hint,
  round(l_discount * (0.2::DOUBLE + 0.8::DOUBLE * exp(-pow((l_quantity / 50 - 0.5) / 0.2, 2))) * least(1.0::DOUBLE, 0.4::DOUBLE + 12 * l_tax), 9) + 0.0 AS weight FROM lineitem"""
)
def picture_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    score, hint = imaging.quality(F.col("l_quantity"), F.col("l_tax") * 100)
    weight = imaging.word_weight(F.col("l_discount"), F.col("l_quantity") / 50, F.col("l_tax"))
    return read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.round(score, 9).alias("quality"), hint.alias("hint"), (F.round(weight, 9) + 0.0).alias("weight"))


@query("""SELECT vec_id, round(sqrt(abs(embedding[2]::DOUBLE) / greatest(list_sum(list_transform(embedding, lambda x: abs(x::DOUBLE))), 1e-8::DOUBLE)), 6) AS second, len(embedding)::BIGINT AS size FROM embeddings""")
def root_descriptors(spark: SparkSession, sf_dir: str) -> DataFrame:
    root = imaging.root_normalised(F.transform("embedding", F.abs))
    return read(spark, sf_dir, "embeddings").select("vec_id", F.round(F.get(root, 1), 6).alias("second"), F.size(root).cast("bigint").alias("size"))


@query("SELECT l_orderkey, l_linenumber, l_partkey FROM lineitem WHERE (l_quantity + 5) / 60 BETWEEN 0.3 AND 0.7 AND l_discount - 0.02 >= 0")
def central_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = read(spark, sf_dir, "lineitem")
    words = li.select("l_orderkey", "l_linenumber", "l_partkey", F.col("l_quantity").alias("left"), F.lit(10).alias("width"), F.lit(60).alias("frame_width"), (F.col("l_discount") - 0.02).alias("conf"))
    return imaging.central_words(words).select("l_orderkey", "l_linenumber", "l_partkey")


@query(
    """SELECT doc_id, CASE WHEN v < 0.5 THEN 'a' WHEN v < 0.75 THEN 'b' ELSE 'c' END AS chosen FROM (SELECT doc_id, ('0x' || left(sha256('s' || chr(0) || doc_id), 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS v FROM documents)"""
)
def weighted_choices(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _docs(spark, sf_dir).select("doc_id", hashing.weighted_choice(F.col("doc_id").cast("string"), "s", fit.split_weights("a=0.5, b=0.25,c=0.25")).alias("chosen"))


@query(
    """WITH m AS (SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'train' WHEN doc_id % 11 = 0 THEN 'nowhere' WHEN doc_id % 13 = 0 THEN ' ' END AS split, source || (doc_id % 40) AS component FROM documents),
g AS (SELECT component, list(DISTINCT nullif(trim(split), '')) FILTER (nullif(trim(split), '') IS NOT NULL) AS d, min(doc_id::VARCHAR) AS k FROM m GROUP BY component),
v AS (SELECT *, ('0x' || left(sha256('s' || chr(0) || k), 16))::UBIGINT::DOUBLE / 18446744073709551616.0::DOUBLE AS x FROM g)
SELECT component, CASE WHEN d IS NULL THEN CASE WHEN x < 0.7 THEN 'train' ELSE 'test' END WHEN len(d) = 1 AND d[1] = 'train' THEN 'train' END AS split, CASE WHEN len(d) > 1 THEN 'conflicting_splits' WHEN len(d) = 1 AND d[1] <> 'train' THEN 'unknown_split' END AS issue FROM v"""
)
def declared_splits(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("doc_id")
    members = _docs(spark, sf_dir).select(F.concat("source", (k % 40).cast("string")).alias("component"), k.cast("string").alias("key"), F.when(k % 7 == 0, "train").when(k % 11 == 0, "nowhere").when(k % 13 == 0, " ").alias("split"))
    return graph.component_splits(members, {"train": 0.7, "test": 0.3}, "s")


@query(
    """WITH t AS (SELECT DISTINCT unnest(list_concat(string_split(p_name, ' '), ['k' || (p_partkey % 700), 'old'])) AS token, p_brand FROM part), df AS (SELECT token, count(*) AS df FROM t GROUP BY token), n AS (SELECT count(DISTINCT p_brand) AS n FROM part)
SELECT token, df FROM df, n WHERE df <= greatest(3, ceil(n / 100.0)) AND token NOT IN ('k7', 'old')"""
)
def identifying_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = written(read(spark, sf_dir, "part").select("p_brand", "p_name", "p_partkey"), "part")
    total = p.select("p_brand").distinct().count()
    names = F.concat(F.split("p_name", " "), F.array(F.concat(F.lit("k"), (F.col("p_partkey") % 700).cast("string")), F.lit("old")))
    weights = textindex.idf(p.select("p_brand", F.explode(names).alias("token")).distinct(), total, "p_brand")
    return textindex.identifying(weights, total, ["k7", "old"]).select("token", "df")
