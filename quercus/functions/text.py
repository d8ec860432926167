"""Normalisers, keys, tokens and parsers of strings, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as S

from quercus.functions.unicode import nfc, nfkc, nfkc_casefold, ratio

# Both ways of writing Cyrillic in Latin letters. A is that of media names, B that of label text.
CYRILLIC = "абвгдеёжзийклмнопрстуфхцчшщъыьэюя"
LATIN_A = ["a", "b", "v", "g", "d", "e", "yo", "zh", "z", "i", "j", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "cz", "ch", "sh", "shh", "", "y", "", "e", "yu", "ya"]
LATIN_B = ["a", "b", "v", "g", "d", "e", "e", "zh", "z", "i", "y", "k", "l", "m", "n", "o", "p", "r", "s", "t", "u", "f", "h", "ts", "ch", "sh", "sch", "", "y", "", "e", "yu", "ya"]
# Signs that look alike. Latin for Cyrillic, Greek for Cyrillic.
LOOKALIKE_LATIN, LOOKALIKE_LATIN_TO = "abcehkmoptxy3", "авсенкмортхуз"
LOOKALIKE_GREEK, LOOKALIKE_GREEK_TO = "ΑΒΓΔΕΖΗΚΛΜΟΠΡΤΥΦΧαγδεκλμοπρτυφχ", "АВГДЕЗНКЛМОПРТУФХагдеклмопртуфх"
# Words of both scripts for grapes and styles, by the Cyrillic word that stands for all.
TERMS = {
    "каберне": ["cabernet", "kaberne"],
    "совиньон": ["sauvignon", "sovinon"],
    "фран": ["franc", "fran"],
    "мерло": ["merlot", "merlo"],
    "пино": ["pinot", "pino"],
    "нуар": ["noir", "nuar"],
    "блан": ["blanc", "blancs", "blan"],
    "гри": ["gris"],
    "гриджио": ["grigio", "gridzhio"],
    "шардоне": ["chardonnay", "shardone"],
    "рислинг": ["riesling", "risling"],
    "сира": ["syrah", "shiraz", "sira", "шираз"],
    "мускат": ["muscat", "moscato", "muskat"],
    "алиготе": ["aligote"],
    "ркацители": ["rkatsiteli", "rkaciteli"],
    "вионье": ["viognier", "vione"],
    "шенен": ["chenin", "shenen"],
    "траминер": ["traminer"],
    "мальбек": ["malbec", "malbek"],
    "санджовезе": ["sangiovese", "sandzhoveze"],
    "темпранильо": ["tempranillo"],
    "розе": ["rose", "roze"],
    "руж": ["rouge", "ruzh"],
    "брют": ["brut", "bryut"],
    "резерв": ["reserve", "reserva", "rezerv"],
    "совиньонблан": ["sauvignonblanc"],
    "саперави": ["saperavi"],
    "кокур": ["kokur"],
    "красностоп": ["krasnostop"],
    "цимлянский": ["tsimlyanskiy", "tsimlyansky"],
    "мюскадель": ["muscadelle"],
}
# Words that say nothing.
STOP_WORDS = ["вино", "wine", "vino", "винодельня", "winery", "россии", "russia", "год", "урожая", "сорт", "сорта", "винограда", "the", "and", "of", "de", "из", "для", "выдержка"]
# Style phrases, the more specific first.
STYLES = {
    "sweetness": {
        "brut_nature": ["брют натюр", "brut nature", "bryut natyur"],
        "extra_brut": ["экстра брют", "extra brut", "ekstra bryut"],
        "brut": ["брют", "brut", "bryut"],
        "semi_dry": ["полусухое", "polusuhoe", "semi dry", "demi sec"],
        "semi_sweet": ["полусладкое", "polusladkoe", "semi sweet"],
        "dry": ["сухое", "suhoe", "dry", "secco", "trocken"],
        "sweet": ["сладкое", "sladkoe", "sweet", "десертное", "desertnoe", "dolce"],
    },
    "colour": {
        "red": ["красное", "krasnoe", "red", "rosso", "rouge", "tinto", "rot"],
        "white": ["белое", "beloe", "white", "bianco", "byanko", "blanc", "blanco", "weiss"],
        "rose": ["розовое", "rozovoe", "rose", "rosé", "roze", "rosato", "rosado"],
        "orange": ["оранж", "oranzh", "orange"],
    },
}
YEAR = r"^(?:19[5-9][0-9]|20[0-4][0-9])$"
_RUNS = "([a-zа-яё]+|[0-9]+)"


def spelled(c: Column, table: list[str]) -> Column:
    """Lower-case Cyrillic in Latin letters by one of the tables; other signs stay."""
    single = [(x, y) for x, y in zip(CYRILLIC, table, strict=True) if len(y) == 1]
    out = F.translate(c, "".join(x for x, _ in single), "".join(y for _, y in single))
    for x, y in zip(CYRILLIC, table, strict=True):
        if len(y) != 1:
            out = F.replace(out, F.lit(x), F.lit(y))
    return out


def clean(c: Column) -> Column:
    """NFC, one kind of line end, single blanks, trimmed lines and text; null becomes empty."""
    lines = F.split(F.regexp_replace(nfc(F.coalesce(c, F.lit(""))), "\r\n?", "\n"), "\n")
    trimmed = F.transform(lines, lambda x: _trim(F.regexp_replace(x, "[ \t]+", " ")))
    return _trim(F.array_join(trimmed, "\n"))


def _trim(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def base_name(c: Column) -> Column:
    return F.element_at(F.split(c, "/"), -1)


def stem(c: Column) -> Column:
    """File name without its last suffix; a leading dot isn't one."""
    return F.regexp_replace(base_name(c), r"(?<=.)\.[^.]*$", "")


def _key(c: Column) -> Column:
    lower = F.lower(nfkc(F.replace(c, F.lit("№"), F.lit(""))))
    return F.regexp_replace(F.regexp_replace(spelled(lower, LATIN_A), "[^a-z0-9]+", "_"), "^_+|_+$", "")


def media_key(file_name: Column) -> Column:
    """What two names of one picture have in common: stem in Latin letters, other signs as one underscore."""
    return _key(stem(file_name))


def archive_key(file_name: Column) -> Column:
    """media_key without marks of smaller renditions and without the ten hex digits that uploads get."""
    plain = F.regexp_replace(F.regexp_replace(stem(file_name), "(?i)^(?:(?:thumbnail|small|medium|large)_)+", ""), "(?i)_[0-9a-f]{10}$", "")
    return _key(F.regexp_replace(plain, r"(?<=.)\.[^.]*$", ""))


def is_rendition(file_name: Column) -> Column:
    return stem(file_name).rlike("(?i)^(?:thumbnail|small|medium|large)_")


def compact(key: Column) -> Column:
    return F.replace(key, F.lit("_"), F.lit(""))


def query_text(c: Column) -> Column:
    """NFKC, Latin letters, words of a-z and 0-9 with single blanks."""
    return F.array_join(F.regexp_extract_all(spelled(F.lower(nfkc(c)), LATIN_A), F.lit("([a-z0-9]+)")), " ")


def query_tokens(c: Column) -> Column:
    return F.filter(F.array_distinct(F.split(query_text(c), " ")), lambda t: t != "")


def tokens_match(a: Column, b: Column, same: dict[str, str], least: float = 0.74) -> Column:
    """Equal, or equal by the map same; else, without digits and from three signs on, a ratio of at least least."""
    known = F.create_map(*[F.lit(x) for pair in same.items() for x in pair]) if same else None
    form = lambda c: F.coalesce(F.try_element_at(known, c), c) if same else c
    worded = ~a.rlike("[0-9]") & ~b.rlike("[0-9]") & (F.length(a) >= 3) & (F.length(b) >= 3)
    return (form(a) == form(b)) | F.when(worded, ratio(a, b) >= least).otherwise(False)


def identity(c: Column) -> Column:
    """NFKC, folded case, single blanks; null stays null."""
    return _trim(F.regexp_replace(nfkc_casefold(c), r"(?U)\s+", " "))


def words(c: Column) -> Column:
    """Runs of letters and digits of any script, NFKC and folded."""
    return F.regexp_extract_all(nfkc_casefold(c), F.lit(r"([\p{L}\p{N}]+)"))


def without_years(tokens: Column) -> Column:
    return F.filter(tokens, lambda t: ~t.rlike("^(?:19|20)[0-9]{2}$"))


def lookalikes(c: Column) -> Column:
    """A Cyrillic word that was read with Latin signs: all of them look-alikes (from three on), or scripts are mixed."""
    return F.when((c.rlike(f"^[{LOOKALIKE_LATIN}]{{3,}}$")) | c.rlike("[а-яё]"), F.translate(c, LOOKALIKE_LATIN, LOOKALIKE_LATIN_TO)).otherwise(c)


def roman(c: Column) -> Column:
    """Value of a Roman number of two signs or more (i to c, 2 to 199), as a string; null for all else."""
    digits = F.transform(F.split(c, ""), lambda x: F.element_at(F.create_map(*[F.lit(v) for p in (("i", 1), ("v", 5), ("x", 10), ("l", 50), ("c", 100)) for v in p]), x))
    following = F.concat(F.slice(digits, 2, F.greatest(F.size(digits) - 1, F.lit(0))), F.array(F.lit(0)))
    total = F.aggregate(F.zip_with(digits, following, lambda x, y: F.when(y > x, -x).otherwise(x)), F.lit(0), lambda s, x: s + x)
    return F.when(c.rlike("^[ivxlc]{2,}$"), F.when((total > 1) & (total < 200), total.cast("string")))


def _terms() -> Column:
    return F.create_map(*[F.lit(x) for whole, variants in TERMS.items() for v in variants for x in (v, whole)])


def raw_runs(c: Column) -> Column:
    """Letter and digit runs of a label, look-alike Greek made Cyrillic, parted at inner capitals, lower case."""
    plain = F.translate(nfkc(c), LOOKALIKE_GREEK, LOOKALIKE_GREEK_TO)
    parted = F.regexp_replace(plain, "(?<=[a-zа-яё])(?=[A-ZА-ЯЁ])", " ")
    return F.regexp_extract_all(F.replace(F.lower(parted), F.lit("ё"), F.lit("е")), F.lit(_RUNS))


def run_tokens(raw: Column) -> Column:
    """All that one run may stand for, sorted: itself, in the other script, as a known term, as a number."""
    first = F.array_distinct(F.array(raw, lookalikes(raw)))
    known = F.concat(first, F.filter(F.transform(first, lambda t: F.try_element_at(_terms(), t)), lambda t: t.isNotNull()))
    numbered = F.concat(known, F.filter(F.array(roman(raw)), lambda t: t.isNotNull()))
    every = F.concat(numbered, F.transform(F.filter(numbered, lambda t: t.rlike("[а-я]")), lambda t: spelled(t, LATIN_B)))
    return F.filter(F.array_sort(F.array_distinct(every)), lambda t: ~t.isin(STOP_WORDS) & (F.length(t) >= F.when(t.rlike("^[0-9]+$"), 2).otherwise(3)))


def label_tokens(c: Column) -> Column:
    return F.flatten(F.transform(raw_runs(c), run_tokens))


def styles(c: Column) -> Column:
    """Map of sweetness and colour: in each group the first style of which a phrase occurs as whole words."""
    plain = F.replace(nfkc_casefold(F.translate(c, LOOKALIKE_GREEK, LOOKALIKE_GREEK_TO)), F.lit("ё"), F.lit("е"))
    folded = F.concat(F.lit(" "), F.array_join(F.transform(F.regexp_extract_all(plain, F.lit(_RUNS)), lookalikes), " "), F.lit(" "))
    entries = []
    for group, known in STYLES.items():
        found = F.lit(None).cast("string")
        for style, phrases in reversed(known.items()):
            found = F.when(reduce(lambda x, y: x | y, (folded.contains(f" {p} ") for p in phrases)), style).otherwise(found)
        entries.append(F.struct(F.lit(group).alias("key"), found.alias("value")))
    return F.map_from_entries(F.filter(F.array(*entries), lambda e: e["value"].isNotNull()))


def grapes(c: Column) -> Column:
    return F.array_distinct(F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), "[,;/]+"), lambda x: F.trim(x)), lambda g: g != ""))


def first_filled(*columns: Column) -> Column:
    """The first that isn't null or blank, trimmed."""
    return F.coalesce(*(F.nullif(F.trim(c.cast("string")), F.lit("")) for c in columns))


def lenient_boolean(c: Column) -> Column:
    """1, true, yes and y in any case are true, all else is false."""
    return F.coalesce(F.lower(F.trim(c.cast("string"))).isin("1", "true", "yes", "y"), F.lit(False))


def named(df: DataFrame, names: list[str]) -> Column:
    """The first value that isn't null or empty of the columns called so, in the order of names, as text (lists and objects as JSON); case and blanks around a column's name make no difference."""
    by_name = {f.name.strip().lower(): f for f in df.schema.fields}
    written = lambda f: F.to_json(F.col(f"`{f.name}`")) if isinstance(f.dataType, (S.ArrayType, S.MapType, S.StructType, S.VariantType)) else F.col(f"`{f.name}`").cast("string")
    found = [F.nullif(written(by_name[n.lower()]), F.lit("")) for n in names if n.lower() in by_name]
    return F.coalesce(*found) if found else F.lit(None).cast("string")


def _slugs(items: Column) -> Column:
    """Names from an array of variants: strings, and the slugs of objects that are strings; trimmed, in order, once each, the rest left out."""
    text = lambda v: F.when(F.schema_of_variant(v) == "STRING", F.try_variant_get(v, "$", "string"))
    own = F.transform(items, lambda v: F.coalesce(text(v), text(F.try_variant_get(v, "$.slug", "variant"))))
    return F.array_distinct(F.filter(F.transform(own, _trim), lambda x: x.isNotNull() & (x != "")))


def candidate_list(c: Column) -> Column:
    """Names from a JSON array of strings or objects with slug, or from a list with | or , between; in order, once each.

    Null and empty give null, blanks an empty list; so does what begins like an array and isn't one.
    """
    text = _trim(c)
    none = F.array().cast("array<string>")
    split = F.array_distinct(F.filter(F.transform(F.split(text, "[|,]"), _trim), lambda x: x != ""))
    listed = F.coalesce(_slugs(F.try_variant_get(F.try_parse_json(F.when(text.startswith("["), text)), "$", "array<variant>")), none)
    return F.when(c.isNull() | (c == ""), None).when(text.startswith("["), listed).otherwise(split)


def candidate_values(v: Column) -> Column:
    """candidate_list of a value inside a JSON document: a string as above, an array, an empty list for anything else; null stays null."""
    kind, none = F.schema_of_variant(v), F.array().cast("array<string>")
    return F.when(v.isNull() | (kind == "VOID"), None).when(kind == "STRING", candidate_list(F.try_variant_get(v, "$", "string"))).otherwise(F.coalesce(_slugs(F.try_variant_get(v, "$", "array<variant>")), none))


def safe_path(c: Column, most: int = 240) -> Column:
    """Relative, without '..' parts, control signs or backslashes, of at most so many bytes."""
    return c.isNotNull() & (c != "") & ~c.startswith("/") & ~c.rlike(r"(^|/)\.\.(/|$)") & ~c.rlike(r"[\x00-\x1f\x7f\\]") & ~c.rlike("^[A-Za-z]:") & (F.octet_length(c) <= most)
