from pyspark.sql import functions as F

from quercus.functions import hashing
from quercus.functions import text as T


def values(spark, f, *inputs):
    df = spark.createDataFrame([(n, v) for n, v in enumerate(inputs)], "n int, v string")
    return [r[1] for r in df.select("n", f(F.col("v"))).orderBy("n").collect()]


def test_clean(spark):
    assert values(spark, T.clean, " Wine\t \tred \r\n second ", None, "e\u0301", "") == ["Wine red\nsecond", "", "\u00e9", ""]


def test_media_keys(spark):
    assert values(spark, T.media_key, "Спуманте белый брют.webp", "Бленд №4.png", "a/b/Щука.JPG", ".hidden") == ["spumante_belyj_bryut", "blend_4", "shhuka", "hidden"]
    assert values(spark, T.archive_key, "thumbnail_small_Wine_0123456789.webp", "Wine_012345678.webp") == ["wine", "wine_012345678"]
    assert values(spark, T.compact, "a_b_c") == ["abc"]


def test_query_tokens(spark):
    assert values(spark, T.query_tokens, "Пино  Нуар, ПИНО 2022", "", None) == [["pino", "nuar", "2022"], [], None]


def test_tokens_match(spark):
    rows = spark.createDataFrame([("chardonnay", "shardonnay"), ("a1", "a2"), ("x", "y"), ("rose", "roze"), ("abcdef", "uvwxyz")], "a string, b string")
    got = [r[0] for r in rows.select(T.tokens_match(F.col("a"), F.col("b"), {"roze": "rose"})).collect()]
    assert got == [True, False, False, True, False]


def test_label_tokens(spark):
    tokens = values(spark, T.label_tokens, "MACCAHAPA", "ПиноНуар", "XXIV", "KPACHOE2022", "АРАТTИ", "CABERNET FRANC", "\u0391\u041b\u03a5\u0428\u0422\u0410", "of and", None)
    assert "массанара" in tokens[0]
    assert {"пино", "нуар", "pino", "nuar"} <= set(tokens[1])
    assert "24" in tokens[2]
    assert {"красное", "2022"} <= set(tokens[3])
    assert "аратти" in tokens[4]
    assert {"каберне", "фран"} <= set(tokens[5])
    assert "алушта" in tokens[6]
    assert tokens[7] == [] and not tokens[8]


def test_roman(spark):
    assert values(spark, T.roman, "xxiv", "i", "iv", "ccc", "abc", "xl") == ["24", None, "4", None, None, "40"]


def test_styles(spark):
    got = values(spark, T.styles, "CYXOE KPACHOE", "Игристое экстра брют", "nothing")
    assert got == [{"sweetness": "dry", "colour": "red"}, {"sweetness": "extra_brut"}, {}]


def test_words_keep_every_script(spark):
    assert values(spark, T.words, "Вино Rosé-2019 \u03b1") == [["вино", "rosé", "2019", "\u03b1"]]
    assert values(spark, lambda c: T.without_years(T.words(c)), "Reserve 2019 24 9") == [["reserve", "24", "9"]]


def test_lists_and_booleans(spark):
    assert values(spark, T.candidate_list, "a|b|a, c", '[{"slug":"a"},"b"]', "", None, "[broken", "{}", "  ", '[1, "a", {"slug": 5}, null]', '{"a|b') == [["a", "b", "c"], ["a", "b"], None, None, [], ["{}"], [], ["a"], ['{"a', "b"]]
    assert values(spark, T.lenient_boolean, "Yes", "0", None, " TRUE ") == [True, False, False, True]
    assert values(spark, T.grapes, "Мерло; Пино, мерло/ ", None) == [["мерло", "пино"], []]


def test_safe_path(spark):
    assert values(spark, T.safe_path, "a/b.png", "../x", "/abs", "a/../b", "a\x01", "C:/x", "x" * 241, None) == [True, False, False, False, False, False, False, False]


def test_hashes(spark):
    import binascii
    import hashlib

    text = "Вино"
    assert values(spark, hashing.sha256, text) == [hashlib.sha256(text.encode()).hexdigest()]
    assert values(spark, hashing.crc32_hex, text) == [f"{binascii.crc32(text.encode()):08X}"]
    keys = [f"k{i}" for i in range(40)]
    assert values(spark, lambda c: hashing.holdout(c, 0.2), *keys) == [int(hashlib.sha256(k.encode()).hexdigest()[:8], 16) / 0xFFFFFFFF < 0.2 for k in keys]

    def choose(k):
        v = int.from_bytes(hashlib.sha256(f"s\0{k}".encode()).digest()[:8], "big") / 2**64
        return "train" if v < 0.5 else "test" if v < 0.8 else "rest"

    assert values(spark, lambda c: hashing.weighted_choice(c, "s", {"train": 0.5, "test": 0.3, "rest": 0.2}), *keys) == [choose(k) for k in keys]


def test_image_kind(spark):
    rows = spark.createDataFrame([(b"RIFF\0\0\0\0WEBP",), (b"\xff\xd8\xff\xe0",), (b"\x89PNG\r\n\x1a\n",), (b"<svg",), (b"",), (b"\xff\xd8",)], "c binary")
    assert [r[0] for r in rows.select(hashing.image_kind(F.col("c"))).collect()] == ["webp", "jpeg", "png", None, None, "jpeg"]
