"""BPE encoding and decoding by per-prefix dynamic programming.

For each prefix of a word the last token of its encoding is unique. An automaton over the vocabulary gives, after every
symbol, the tokens that end there (longest first). A token t is the last one if the prefix before it ends in a token p
such that the pair (p, t) encodes to itself. That test undoes the merges of p and t at their common seam, latest first,
and looks for a merge across the seam that would have come earlier. Back-pointers give the ids.
"""

from __future__ import annotations

import hashlib
from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quercus.llm.common import alone, keeps, utf8
from quercus.llm.wordbpe import Encoder, Vocabulary, byte_signs

NEVER = 1 << 60
#: Words and pairs that a worker keeps at most; beyond that it starts anew. Bounds memory, never changes results.
KEPT_WORDS, KEPT_PAIRS = 200_000, 300_000


class PrefixEncoder:
    """ids(word): exact ids of one word. Symbols are bytes; a word's last byte counts as another symbol (byte + 256)."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        ids = vocabulary.ids
        self.rank: dict[int, int] = {}
        self.parts: dict[int, tuple[int, int]] = {}
        self.merge: dict[tuple[int, int], int] = {}
        for n, (left, right) in enumerate(vocabulary.merges):
            whole = ids[left + right]
            if whole in self.rank:
                raise ValueError("two merges make one token: encodings of prefixes are not unique")
            self.rank[whole], self.parts[whole] = n, (ids[left], ids[right])
            self.merge[ids[left], ids[right]] = n
        if any(self.rank.get(x, -1) >= self.rank[t] for t, pair in self.parts.items() for x in pair):
            raise ValueError("a merge comes before the merges of its parts")
        self.known: dict[int, bool] = {}
        self._automaton(vocabulary)

    def seam(self, left: int, right: int, before: int = NEVER) -> bool:
        """Whether left and right stay apart when their symbols are merged together, in the merges ranked below before."""
        rank, parts, merge = self.rank, self.parts, self.merge
        end_left = end_right = before
        while True:
            cross = merge.get((left, right))
            if cross is not None and cross < end_left and cross <= end_right and cross < before:
                return False
            a, b = rank.get(left, -1), rank.get(right, -1)
            if a < 0 and b < 0:
                return True
            if a > b:
                end_left, left = a, parts[left][1]
            else:
                end_right, right = b, parts[right][0]

    def _automaton(self, vocabulary: Vocabulary) -> None:
        """Trie of the tokens that encode to themselves, with failure links; transitions are completed when first used."""
        byte_of = {s: b for b, s in enumerate(byte_signs())}
        end = vocabulary.end
        whole: dict[int, bool] = {}
        for t in sorted(self.rank, key=self.rank.__getitem__):
            a, b = self.parts[t]
            whole[t] = whole.get(a, True) and whole.get(b, True) and self.seam(a, b, self.rank[t])
        step: dict[int, int] = {}
        own: list[tuple[int, int] | None] = [None]
        for s, t in vocabulary.ids.items():
            if not whole.get(t, True) or t in vocabulary.special.values():
                continue
            ended = s.endswith(end) and len(s) > len(end)
            symbols = [byte_of[c] for c in (s[: -len(end)] if ended else s)]
            symbols[-1] += 256 * ended
            node = 0
            for x in symbols:
                key = node * 512 + x
                if key not in step:
                    step[key] = len(own)
                    own.append(None)
                node = step[key]
            own[node] = (t, len(symbols))
        below: dict[int, list[tuple[int, int]]] = {}
        for key, node in step.items():
            below.setdefault(key >> 9, []).append((key & 511, node))
        fail = [0] * len(own)
        ends: list[tuple[tuple[int, int], ...]] = [()] * len(own)
        todo = deque([0])
        while todo:
            at = todo.popleft()
            for x, node in below.get(at, ()):
                if at:
                    f = fail[at]
                    while f and f * 512 + x not in step:
                        f = fail[f]
                    fail[node] = step.get(f * 512 + x, 0)
                ends[node] = ((own[node],) if own[node] else ()) + ends[fail[node]]
                todo.append(node)
        self.step, self.fail, self.ends, self.ended = step, fail, ends, end

    def _next(self, state: int, symbol: int) -> int:
        f = state
        while f and f * 512 + symbol not in self.step:
            f = self.fail[f]
        found = self.step[state * 512 + symbol] = self.step.get(f * 512 + symbol, 0)
        return found

    def ids(self, word: str) -> list[int]:
        data = word.encode()
        step, ends, known = self.step, self.ends, self.known
        last = [(-1, 0)]
        state, i, n = 0, 0, len(data)
        for x in data:
            i += 1
            if i == n:
                x += 256
            key = state * 512 + x
            state = step[key] if key in step else self._next(state, x)
            for t, length in ends[state]:
                if length == i:
                    last.append((t, length))
                    break
                p = last[i - length][0]
                pair = p << 20 | t
                fits = known.get(pair)
                if fits is None:
                    if len(known) >= KEPT_PAIRS:
                        known.clear()
                    fits = known[pair] = self.seam(p, t)
                if fits:
                    last.append((t, length))
                    break
            else:
                raise ValueError(f"the vocabulary lacks a byte of {word!r}")
        out = []
        while i:
            t, length = last[i]
            out.append(t)
            i -= length
        return out[::-1]


_workers: dict[bytes, Encoder] = {}
keeps("bpe", _workers)


def prefix_encoder(data: bytes) -> Encoder:
    """One for each worker process and tokenizer file."""
    key = hashlib.sha256(data).digest()
    if key not in _workers:
        vocabulary = Vocabulary(data)
        _workers[key] = Encoder(vocabulary, PrefixEncoder(vocabulary).ids, KEPT_WORDS)
    return _workers[key]


def decoded(strings: list[str], ids: bytes) -> str:
    """As the library decodes without a decoder in its file: the tokens' strings with blanks between them."""
    return " ".join(map(strings.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


def tokenizer_bytes(path: str) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(df: DataFrame, tokenizer: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with a binary column ids: the ids of the whole text as little-endian unsigned 32-bit integers.

    tokenizer: the path of the tokenizer file on the driver; its bytes (a few MB whatever the input) are broadcast.
    A null text counts as empty and gets no ids. Other columns stay; ids replaces one of that name. No shuffle.
    """
    return _mapped(df, tokenizer, text, {ids: pa.binary()}, lambda e, b: [e.encode(b.decode())])


def decode(df: DataFrame, tokenizer: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with a string column: the decoded ids. Null and empty ids give an empty text."""
    return _mapped(df, tokenizer, ids, {text: pa.string()}, lambda e, b: [decoded(e.vocabulary.strings, b)])


def digests(df: DataFrame, tokenizer: str, text: str = "text") -> DataFrame:
    """df without its text, with n_tokens, ids_sha256 and decoded_sha256, from the ids and the text decoded from them; neither is kept."""

    def of(e: Encoder, b: bytes) -> list:
        ids = e.encode(b.decode())
        return [len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(decoded(e.vocabulary.strings, ids).encode()).hexdigest()]

    return _mapped(df, tokenizer, text, {"n_tokens": pa.int64(), "ids_sha256": pa.string(), "decoded_sha256": pa.string()}, of, keep=False)


def _mapped(df: DataFrame, tokenizer: str, column: str, adds: dict[str, pa.DataType], of, keep: bool = True) -> DataFrame:
    shipped = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))
    kept = [c for c in df.columns if c not in adds and (keep or c != column)]
    kinds = {pa.int64(): "bigint", pa.string(): "string", pa.binary(): "binary"}
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema if f.name in kept), *(f"`{n}` {kinds[k]}" for n, k in adds.items())])
    place = df.columns.index(column)
    places = [df.columns.index(c) for c in kept]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = prefix_encoder(shipped.value)
        for batch in batches:
            source = batch.column(place)
            if not pa.types.is_binary(source.type) and not pa.types.is_large_binary(source.type):
                source = utf8(source)
            rows = [of(encoder, x.as_py() or b"") for x in source]
            new = [pa.array([r[i] for r in rows], type=k) for i, k in enumerate(adds.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in places), *new], names=[*kept, *adds])

    return df.mapInArrow(alone("bpe", run), schema)
