"""Secret scans: three fixed patterns, and a battery of randomness tests for other tokens.

A candidate is a run of 20 or more signs that encodings use, between '=' (so that NAME=value is tested as its value). Its
signs tell its encoding (alphabet). Against the hypothesis that the signs are drawn at random from that alphabet, three
tests give statistics: chi-squared uniformity (one-sided), Wald-Wolfowitz runs about the alphabet's middle, and lag-1
serial correlation (both two-sided). Their sum on a log scale is held against its own distribution over random tokens of the
same alphabet and length, which is drawn once: the three depend on each other and the first is far from normal for short
tokens, so no formula for independent tests holds. In each document, Benjamini-Hochberg picks the candidates that are shown
not to be random, at a level that depends on length: a short token says little, so a weaker hint suffices to dismiss it. The
others are reported: of random tokens, a share below the level is dismissed.

That bounds secrets lost, not words reported. So a token is only a candidate where the tests can tell it from words: the
least lengths of alphabets without digits are those from which on 95 in 100 strings of letters as frequent as in English
are dismissed.
"""

from __future__ import annotations

import functools
import math
import re
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quercus.llm.common import alone, others

ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ASSIGN_WORDS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
RUNS = (re.compile(r"[A-Za-z0-9+/]{20,}"), re.compile(r"[A-Za-z0-9_-]{20,}"))
KINDS = ("assign", "access", "hex", "random")
#: The battery needs so many signs, and so many bits if they were random.
MIN_SIGNS, MIN_BITS = 20, 80.0
#: Least signs of alphabets that words are made of, by power (see above; tests measure it).
POWER_SIGNS = {"lower": 76, "upper": 76, "letters": 52}
#: False-discovery level for tokens of 40 signs and more; it grows as the square of 40 / length for shorter ones.
LEVEL, FULL_LENGTH = 0.01, 40

LOWER, UPPER, DIGITS = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
#: Encodings and their alphabets, in the order in which they are tried.
ALPHABETS = {
    "decimal": DIGITS,
    "hex": DIGITS + "abcdef",
    "HEX": DIGITS + "ABCDEF",
    "base32": UPPER + "234567",
    "lower": LOWER,
    "upper": UPPER,
    "base36": DIGITS + LOWER,
    "BASE36": DIGITS + UPPER,
    "letters": UPPER + LOWER,
    "base62": UPPER + LOWER + DIGITS,
    "base64": UPPER + LOWER + DIGITS + "+/",
    "base64url": UPPER + LOWER + DIGITS + "-_",
}
_PLACES = {name: {s: i for i, s in enumerate(alphabet)} for name, alphabet in ALPHABETS.items()}
_SETS = {name: frozenset(alphabet) for name, alphabet in ALPHABETS.items()}


def encoding(token: str) -> str | None:
    """The first alphabet that has all signs of token."""
    signs = set(token)
    if signs <= _SETS["upper"]:
        return "upper"
    return next((name for name, known in _SETS.items() if signs <= known), None)


#: Random tokens that are drawn for each alphabet and length; lengths up to which each has its own; the seed.
DRAWN, OWN_LENGTHS, SEED = 20_000, 64, 42
#: What p-values are multiplied by: the drawn distribution's own error at a share of 1 %.
MARGIN = 1.1
_QUANTILES = np.concatenate([np.linspace(0.0, 0.95, 96), 1.0 - 0.05 * np.linspace(0.96, 0.04, 24)])


def _tail(z: np.ndarray) -> np.ndarray:
    """Upper tail of the normal distribution, on a scale of -ln p; linear in the square far out, where p would be 0."""
    z = np.asarray(z, dtype=np.float64)
    p = 0.5 * np.vectorize(math.erfc, otypes=[np.float64])(np.minimum(z, 25.0) / math.sqrt(2))
    return np.where(z > 25.0, z * z / 2, -np.log(p))


def statistic(values: np.ndarray, m: int) -> np.ndarray:
    """Of each row of values (places in an alphabet of m signs): -ln p of the three tests, summed; the more, the less random."""
    rows, n = values.shape
    counts = np.bincount((values + m * np.arange(rows)[:, None]).ravel(), minlength=rows * m).reshape(rows, m)
    chi = (counts.astype(np.float64) ** 2).sum(axis=1) * m / n - n
    out = _tail((chi - (m - 1)) / math.sqrt(2 * (m - 1) * (n - 1) / n))
    high = values >= m / 2
    a = high.sum(axis=1).astype(np.float64)
    mean = 1 + 2 * a * (n - a) / n
    runs = 1 + (high[:, 1:] != high[:, :-1]).sum(axis=1)
    spread = np.sqrt(np.maximum(1e-9, (mean - 1) * (mean - 2) / (n - 1)))
    one_sided = (a == 0) | (a == n)  # so many signs of one half: n - 1 equal throws
    out += np.where(one_sided, (n - 1) * math.log(2), np.maximum(0.0, _tail(np.abs(runs - mean) / np.where(one_sided, 1.0, spread)) - math.log(2)))
    off = values - values.mean(axis=1, keepdims=True)
    around = (off * off).sum(axis=1)
    r = (off[:, 1:] * off[:, :-1]).sum(axis=1) / np.where(around > 0, around, 1.0)
    return out + np.where(around > 0, np.maximum(0.0, _tail(np.abs(r + 1 / n) * math.sqrt(n)) - math.log(2)), (n - 1) * math.log(2))


def _drawn_length(n: int) -> int:
    """The length whose distribution stands for n: n itself up to OWN_LENGTHS, then steps of a sixteenth of an octave, 2,048 at most (the tests are standardised, so longer ones differ little)."""
    if n <= OWN_LENGTHS:
        return n
    return min(2048, round(OWN_LENGTHS * 2 ** (math.floor(16 * math.log2(n / OWN_LENGTHS)) / 16)))


@functools.lru_cache(maxsize=4096)
def _null(m: int, n: int) -> tuple[np.ndarray, np.ndarray, float]:
    """Quantiles of the statistic over random tokens, their upper shares, and how much its excess beyond the last is on average."""
    rng = np.random.Generator(np.random.PCG64([SEED, m, n]))
    drawn = np.sort(np.concatenate([statistic(rng.integers(0, m, (DRAWN // 10, n)), m) for _ in range(10)]))
    beyond = drawn[drawn > np.quantile(drawn, 0.98)]
    return np.quantile(drawn, _QUANTILES), 1.0 - _QUANTILES, max(1.0, float((beyond - beyond[0]).mean()) if len(beyond) > 1 else 1.0)


def battery(token: str, name: str) -> float:
    """p-value of the three tests together for token under the named encoding."""
    place = _PLACES[name]
    m = len(place)
    found = float(statistic(np.fromiter((place[s] for s in token), dtype=np.int64, count=len(token))[None, :], m)[0])
    at, share, excess = _null(m, _drawn_length(len(token)))
    if found >= at[-1]:  # beyond what was drawn the tail falls off exponentially, as -ln p does
        return float(MARGIN * share[-1] * math.exp(-(found - at[-1]) / excess))
    return min(1.0, MARGIN * float(np.interp(found, at, share)))


def _mixed(token: str) -> bool:
    """Whether token reads like base64 or base64url as a whole."""
    return encoding(token) in ("base64", "base64url") and all(set(token) & _SETS[c] for c in ("lower", "upper", "decimal"))


class _Taken:
    """Spans that don't overlap, in order, and whether another one overlaps them: by bisection."""

    def __init__(self, spans: list[tuple[int, int]]) -> None:
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def overlaps(self, start: int, end: int) -> bool:
        at = bisect_right(self.ends, start)
        return at < len(self.starts) and self.starts[at] < end


def _parts(token: str) -> Iterator[tuple[int, str]]:
    """Place and text of the parts of a token without '=' that are tested: all of it, its runs of one base64 alphabet (longer ones first), or what alphanumeric runs are left."""
    if _mixed(token):
        yield 0, token
        return
    held: list[tuple[int, int]] = []
    if encoding(token) is None:
        # runs of one alphabet don't overlap each other; of two that do, of either alphabet, the longer counts
        plain, url = ([x for x in run.finditer(token) if _mixed(x[0])] for run in RUNS)
        for some, rest in ((plain, url), (url, plain)):
            spans = [x.span() for x in rest]
            starts = [a for a, _ in spans]
            for x in some:
                a, b = x.span()
                crossing = (spans[i] for i in range(max(0, bisect_right(starts, a) - 1), bisect_right(starts, b - 1)) if spans[i][1] > a)
                if all((d - c, c) < (b - a, a) if some is url else (d - c, c) <= (b - a, a) for c, d in crossing):
                    held.append((a, b))
                    yield a, x[0]
    taken = _Taken(held)
    for x in re.finditer(r"[A-Za-z0-9]+", token):
        if not taken.overlaps(*x.span()):
            yield x.start(), x[0]


def _candidates(text: str, taken: list[tuple[int, int]]) -> Iterator[tuple[int, int, str]]:
    """start, end and encoding of what the battery can judge, outside the spans taken. An '=' ends a name or an encoding and is part of none."""
    known = _Taken(taken)
    for m in CANDIDATE.finditer(text):
        for piece in re.finditer(r"[^=]{%d,}" % MIN_SIGNS, m[0]):
            for at, part in _parts(piece[0]):
                start = m.start() + piece.start() + at
                end = start + len(part)
                if len(part) < MIN_SIGNS or known.overlaps(start, end):
                    continue
                name = encoding(part)
                if name and len(part) >= POWER_SIGNS.get(name, MIN_SIGNS) and len(part) * math.log2(len(ALPHABETS[name])) >= MIN_BITS:
                    yield start, end, name


def random_tokens(text: str, taken: list[tuple[int, int]]) -> list[tuple[int, int, str, float]]:
    """The candidates that the battery doesn't dismiss: start, end, encoding, p-value."""
    tested = [(battery(text[a:b], name), a, b, name) for a, b, name in _candidates(text, taken)]
    # weighted Benjamini-Hochberg: p over the level of the token's length, against its rank
    scaled = sorted((p / (LEVEL * max(1.0, FULL_LENGTH / (b - a)) ** 2), a, b, name, p) for p, a, b, name in tested)
    dismissed = max((i for i, x in enumerate(scaled, 1) if x[0] <= i / len(scaled)), default=0)
    return sorted((a, b, name, p) for _, a, b, name, p in scaled[dismissed:])


def spans(text: str) -> list[tuple[str, int, int, str, float]]:
    """kind, start, end (code points, end exclusive), encoding and p-value (for random ones), by start, then kind."""
    found: list[tuple[str, int, int, str, float]] = []
    lower = text.lower()
    if any(w in lower for w in ASSIGN_WORDS):
        found += [("assign", m.start(), m.end(), "", 0.0) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [("access", m.start(), m.end(), "", 0.0) for m in ACCESS.finditer(text) if len(m[0]) >= 20]
    found += [("hex", m.start(), m.end(), "", 0.0) for m in HEX.finditer(text)]
    found += [("random", a, b, name, p) for a, b, name, p in random_tokens(text, [(x[1], x[2]) for x in found])]
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


SECRETS = "array<struct<kind:string,start:bigint,end:bigint,encoding:string,p:double>>"


def _mapped(df: DataFrame, text: str, secrets: str | None, keep_text: bool = True) -> DataFrame:
    kept = others(df, [secrets] if secrets else [])
    source = df.select(*(df[f"`{c}`"] for c in kept))
    place = kept.index(text)
    out = [i for i in range(len(kept)) if keep_text or i != place]
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("encoding", pa.string()), ("p", pa.float64())]))
    names = ("kind", "start", "end", "encoding", "p")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = (t.as_py() for t in batch.column(place))
            if secrets:
                found = [[dict(zip(names, s, strict=True)) for s in spans(t or "")] for t in texts]
                yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in out), pa.array(found, kind)], names=[*(kept[i] for i in out), secrets])
            else:
                clean = pa.array([t if t is None else redacted(t) for t in texts], batch.column(place).type)
                yield pa.RecordBatch.from_arrays([clean if i == place else c for i, c in enumerate(batch.columns)], names=kept)

    columns = [f"`{f.name}` {f.dataType.simpleString()}" for f in (source.schema.fields[i] for i in out)]
    return source.mapInArrow(alone("secrets", run), ", ".join([*columns, f"`{secrets}` {SECRETS}"] if secrets else columns))


def scan(df: DataFrame, text: str = "text", secrets: str = "secrets", keep_text: bool = True) -> DataFrame:
    """df with an array column of the secrets in each whole text (kind, start, end, encoding, p).

    Null and empty texts have none; an empty table gives an empty result. Rows stay as they are, each by itself: repeated
    ones get equal secrets. Secrets that start at one place stand in the order of KINDS; equal p-values are dismissed or
    kept by the same rule (place decides only the order of tests). Very long texts are scanned whole, in time about in
    proportion to their length. A column of the new one's name (in any case) is replaced, all others stay (the text only if
    keep_text). No shuffle.
    """
    return _mapped(df, text, secrets, keep_text)


MASK = "[SECRET]"


def redacted(text: str) -> str:
    """text with each stretch of secrets as one mask."""
    out, end = [], 0
    for _, a, b, _, _ in spans(text):
        if a >= end:
            out += [text[end:a], MASK]
        end = max(end, b)
    return "".join(out) + text[end:]


def redact(df: DataFrame, text: str = "text") -> DataFrame:
    """df with secrets masked in its text; null stays null, texts without secrets stay as they are. Columns, rows and their number don't change."""
    return _mapped(df, text, None)
