"""Text index queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quercus.functions import text as T
from quercus.functions.tables import read, written
from quercus.operators import textindex
from quercus.plans.registry import query

RUN = r"[\p{L}\p{N}]+"
TOKENS = rf"tok AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '{RUN}')) AS token FROM documents)"
IDF = f"{TOKENS}, n AS (SELECT count(*) AS n FROM documents), idf AS (SELECT token, count(*) AS df, ln((any_value(n) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM tok, n GROUP BY token)"


def _lower_runs(c) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit(f"({RUN})"))


def _postings(docs: DataFrame, key: str) -> DataFrame:
    return docs.select(key, F.explode(F.array_distinct(_lower_runs(F.coalesce("text", F.lit("")))))).withColumnRenamed("col", "token")


@query(f"WITH {IDF} SELECT token, df, round(idf, 6) AS idf FROM idf")
def token_idf(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    return textindex.idf(_postings(docs, "doc_id"), docs.count(), "doc_id").withColumn("idf", F.round("idf", 6))


PART_WEIGHTS = {"p_name": 2.0, "p_brand": 1.5, "p_type": 0.5}
VOCABULARY = """w AS (
  SELECT p_partkey, token, max(weight) AS weight FROM (
    SELECT p_partkey, unnest(regexp_extract_all(lower(p_name), '[a-z0-9]+')) AS token, 2.0::DOUBLE AS weight FROM part
    UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_brand), '[a-z0-9]+')), 1.5::DOUBLE FROM part
    UNION ALL SELECT p_partkey, unnest(regexp_extract_all(lower(p_type), '[a-z0-9]+')), 0.5::DOUBLE FROM part) GROUP BY ALL)"""


def _part_tokens(c) -> F.Column:
    return F.regexp_extract_all(F.lower(c), F.lit("([a-z0-9]+)"))


def _vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.vocabulary(read(spark, sf_dir, "part"), PART_WEIGHTS, "p_partkey", _part_tokens)


@query(f"WITH {VOCABULARY} SELECT p_partkey, token, weight FROM w")
def field_weighted_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _vocabulary(spark, sf_dir)


@query(
    f"""WITH {VOCABULARY}, i AS (SELECT token, ln(((SELECT count(*) FROM part) + 1.0::DOUBLE) / (count(*) + 1)) + 1 AS idf FROM w GROUP BY token)
SELECT p_partkey, round(coalesce(sum(weight * idf) FILTER (NOT regexp_full_match(token, '[0-9]+')), 0), 5) AS norm FROM w JOIN i USING (token) GROUP BY p_partkey"""
)
def vocab_norms(spark: SparkSession, sf_dir: str) -> DataFrame:
    w = _vocabulary(spark, sf_dir)
    total = read(spark, sf_dir, "part").count()
    return textindex.norms(w, textindex.idf(w, total, "p_partkey"), "p_partkey").withColumn("norm", F.round("norm", 5))


MATCHED = rf"""{IDF}, b AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(lower(text), '{RUN}')) AS token FROM benchmark),
s AS (SELECT item_id, doc_id, sum(idf) AS score, list(token) AS matched FROM b JOIN tok USING (token) JOIN idf USING (token) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY round(score, 5) DESC, doc_id) AS rank FROM s),
top AS (SELECT * FROM r WHERE rank <= 5)"""


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five documents that share most weight with each benchmark item, and the tokens shared. Documents are cut into tokens once."""
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    asked = written(_postings(read(spark, sf_dir, "benchmark").select("item_id", "text"), "item_id"), "asked")
    posts = written(_postings(docs, "doc_id").join(asked.select("token").distinct(), "token", "left_semi"), "postings")
    weights = written(textindex.idf(posts, docs.count(), "doc_id"), "weights")
    top = textindex.top_by_idf(asked, posts, weights, "item_id", "doc_id", 5)
    shared = top.join(asked, "item_id").join(posts, ["doc_id", "token"]).join(weights, "token")
    return written(shared.groupBy("item_id", "doc_id", "score", "rank").agg(F.collect_list(F.struct("token", "idf")).alias("matched")), "matched")


@query(f"WITH {MATCHED} SELECT item_id, doc_id, round(score, 5) AS score, rank, len(matched) AS n_matched FROM top")
def inverted_index_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("item_id", "doc_id", "score", "rank", F.size("matched").cast("bigint").alias("n_matched"))


@query(
    f"""WITH {MATCHED}, e AS (SELECT DISTINCT item_id, unnest(matched) AS token FROM top),
t AS (SELECT item_id, sum(idf) AS total FROM e JOIN idf USING (token) GROUP BY item_id),
own AS (SELECT item_id, doc_id, sum(idf) AS own FROM (SELECT item_id, doc_id, unnest(matched) AS token FROM top) JOIN idf USING (token) GROUP BY ALL)
SELECT item_id, doc_id, round((total - own) / total, 5) + 0.0::DOUBLE AS t_missing FROM own JOIN t USING (item_id)"""
)
def explained_away(spark: SparkSession, sf_dir: str) -> DataFrame:
    top = _matched(spark, sf_dir)
    each = top.select("item_id", "doc_id", F.explode("matched").alias("m")).select("item_id", "doc_id", "m.token", "m.idf")
    total = each.select("item_id", "token", "idf").distinct().groupBy("item_id").agg(F.sum("idf").alias("total"))
    own = each.groupBy("item_id", "doc_id").agg(F.sum("idf").alias("own"))
    return own.join(total, "item_id").select("item_id", "doc_id", (F.round((F.col("total") - F.col("own")) / F.col("total"), 5) + 0.0).alias("t_missing"))


KNOWN = "v AS (SELECT DISTINCT unnest(regexp_extract_all(lower(p_name), '[a-z]+')) AS found FROM part)"
ASKED = "a AS (SELECT DISTINCT token FROM (SELECT unnest(regexp_extract_all(lower(text), '[a-z]+')) AS token FROM documents))"


def _known(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "part").select(F.explode(F.regexp_extract_all(F.lower("p_name"), F.lit("([a-z]+)"))).alias("token")).distinct()


def _asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("([a-z]+)"))).alias("token")).distinct()


@query(
    f"""WITH {KNOWN}, {ASKED}, d AS (SELECT token, found, levenshtein(token, found) AS distance FROM a, v WHERE length(token) >= 4 AND abs(length(token) - length(found)) <= 2),
r AS (SELECT *, row_number() OVER (PARTITION BY token ORDER BY distance, found) AS n FROM d WHERE distance <= CASE WHEN length(token) <= 6 THEN 1 ELSE 2 END)
SELECT token, found, distance FROM r WHERE n = 1"""
)
def fuzzy_nearest_token(spark: SparkSession, sf_dir: str) -> DataFrame:
    return textindex.nearest_token(_asked(spark, sf_dir), _known(spark, sf_dir))


@query(
    f"""WITH {ASKED},
c AS (SELECT token, unnest(range(3, length(token) - 2)) AS cut FROM a WHERE length(token) >= 6),
h AS (SELECT c.token, cut, substr(c.token, 1, cut) AS l, substr(c.token, cut + 1) AS r FROM c),
m AS (SELECT h.*, row_number() OVER (PARTITION BY h.token ORDER BY cut) AS n FROM h JOIN a x ON x.token = l JOIN a y ON y.token = r)
SELECT token, l AS "left", r AS "right" FROM m WHERE n = 1"""
)
def compound_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = written(_asked(spark, sf_dir), "tokens")
    return textindex.compounds(tokens, tokens)


GROUPS = {"article": {"definite": ["the", "der", "le"], "indefinite": ["a", "an", "un"]}, "link": {"conjunction": ["and", "et", "und"], "preposition": ["of", "de", "von"]}}
_CASES = {g: "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(f, {chr(39)} {w} {chr(39)})' for w in words)} THEN '{s}'" for s, words in styles.items()) + " END" for g, styles in GROUPS.items()}


@query(
    rf"""WITH f AS (SELECT conv_id, turn, CASE role WHEN 'user' THEN 1.0::DOUBLE WHEN 'assistant' THEN 0.5::DOUBLE ELSE 0.25::DOUBLE END AS weight,
  ' ' || array_to_string(regexp_extract_all(lower(text), '{RUN}'), ' ') || ' ' AS f FROM conversations),
s AS (SELECT conv_id, turn, weight, 'article' AS grp, {_CASES['article']} AS style FROM f UNION ALL SELECT conv_id, turn, weight, 'link', {_CASES['link']} FROM f),
v AS (SELECT conv_id, grp, style, sum(weight) AS votes, min(turn) AS first FROM s WHERE style IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY conv_id, grp ORDER BY votes DESC, first, style) AS n FROM v WHERE votes >= 0.2)
SELECT conv_id, grp, style, votes FROM r WHERE n = 1"""
)
def style_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = read(spark, sf_dir, "conversations")
    folded = F.concat(F.lit(" "), F.array_join(_lower_runs(F.col("text")), " "), F.lit(" "))
    rows = c.select("conv_id", "turn", F.when(F.col("role") == "user", 1.0).when(F.col("role") == "assistant", 0.5).otherwise(0.25).alias("weight"), folded.alias("f"))
    entries = []
    for g, styles in GROUPS.items():
        style = F.lit(None).cast("string")
        for s, words in reversed(styles.items()):
            any_of = F.lit(False)
            for w in words:
                any_of = any_of | F.col("f").contains(f" {w} ")
            style = F.when(any_of, s).otherwise(style)
        entries.append(F.struct(F.lit(g).alias("grp"), style.alias("style")))
    votes = rows.select("conv_id", "turn", "weight", F.explode(F.array(*entries)).alias("e")).select("conv_id", "turn", "weight", "e.grp", "e.style").where("style is not null")
    summed = votes.groupBy("conv_id", "grp", "style").agg(F.sum("weight").alias("votes"), F.min("turn").alias("first")).where("votes >= 0.2")
    best = summed.groupBy("conv_id", "grp").agg(F.min(F.struct((-F.col("votes")).alias("order"), "first", "style", "votes")).alias("b"))
    return best.select("conv_id", "grp", "b.style", "b.votes")


@query(
    """WITH t AS (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, p_type) AS k FROM t)
SELECT p.p_partkey, (p.p_type <> b.p_type) AS conflict, (p.p_type = b.p_type) AS agrees,
       (p.p_size BETWEEN 1 AND 25) <> (length(b.p_type) % 2 = 0) AS size_conflict FROM part p JOIN b ON p.p_brand = b.p_brand AND k = 1"""
)
def conflict_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    part = read(spark, sf_dir, "part")
    one = part.groupBy("p_brand", "p_type").agg(F.count("*").alias("n")).groupBy("p_brand").agg(F.min(F.struct((-F.col("n")).alias("o"), "p_type")).alias("b")).select("p_brand", F.col("b.p_type").alias("usual"))
    asked, own = F.create_map(F.lit("type"), F.col("usual")), F.create_map(F.lit("type"), F.col("p_type"))
    differs, agrees = textindex.conflict(asked, own)
    sized = F.col("p_size").between(1, 25) != (F.length("usual") % 2 == 0)
    return part.join(one, "p_brand").select("p_partkey", differs.alias("conflict"), agrees.alias("agrees"), sized.alias("size_conflict"))


@query(
    """SELECT doc_id, sha256(array_to_string(regexp_extract_all(lower(text), '[a-z0-9]+'), ' ')) AS words_sha256, trim(regexp_replace(lower(coalesce(lang, source)), '[^a-z0-9]+', '_', 'g'), '_') AS media_key FROM documents"""
)
def nfkc_translit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys and query words of whole texts (whose letters NFKC leaves as they are, so that SQL can follow)."""
    return read(spark, sf_dir, "documents").select("doc_id", F.sha2(T.query_text(F.col("text")), 256).alias("words_sha256"), T.media_key(F.concat_ws("/", "source", F.concat("lang", F.lit(".txt")))).alias("media_key"))
