import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from quercus.llm import bpe, planes
from quercus.llm.wordbpe import Vocabulary, byte_signs, library_encoder

PATH = public_tokenizers.path("word_bpe_49k.json")
DATA = bpe.tokenizer_bytes(PATH)
LIBRARY = Tokenizer.from_file(PATH)
SIGNS = [*map(chr, range(32, 127)), *"éΣİ́̈一\U0001f600\x1c\x85​٣½͸\U00010940\t\n", "<|endoftext|>", "<|startoftext|>", "'s", "'LL", " the ", "ing", "ΑΣ", "é"]
EDGES = ["", " ", "\n\t", "a", "A", "'", "don't we'll", "<|endoftext|>", "x<|endoftext|>y", "ῼ", "ß", "a" * 5000, "!?" * 300, "1234567890", " nbsp em"]


def wanted(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def test_both_encoders_equal_the_library():
    rng = random.Random(1)
    words = [w.replace("</w>", "") for w in LIBRARY.get_vocab()]
    bytes_of = {s: b for b, s in enumerate(byte_signs())}
    texts = EDGES + ["".join(rng.choices(SIGNS, k=rng.randint(0, 14))) for _ in range(4000)]
    texts += [bytes(bytes_of.get(c, 32) for c in "".join(rng.choices(words, k=4))).decode("utf8", "ignore") for _ in range(4000)]
    for encoder in (bpe.prefix_encoder(DATA), library_encoder(DATA)):
        for t in texts:
            ids = encoder.encode(t)
            assert np.frombuffer(ids, "<u4").tolist() == wanted(t), t
            assert bpe.decoded(encoder.vocabulary.strings, ids) == LIBRARY.decode(wanted(t), skip_special_tokens=False)


def test_every_letter():
    encoder = library_encoder(DATA)
    for c in [*range(0xD800), *range(0xE000, 0x3000), *range(0xF900, 0x11000, 7), *range(0x1E000, 0x20000, 11)]:
        t = f"a{chr(c)}b"
        assert np.frombuffer(encoder.encode(t), "<u4").tolist() == wanted(t), hex(c)


def test_seam_equals_merging():
    """The pair test against plain merging of both tokens' symbols."""
    vocabulary = Vocabulary(DATA)
    encoder = bpe.PrefixEncoder(vocabulary)
    model = LIBRARY.model
    rng = random.Random(2)
    tokens = [t for t in vocabulary.ids if not t.endswith("</w>")]
    for _ in range(3000):
        a, b = rng.choice(tokens), rng.choice([t for t in (rng.choice(tokens) + "</w>", rng.choice(tokens)) if t in vocabulary.ids] or tokens)
        if not b.endswith("</w>"):
            continue
        whole = [t.id for t in model.tokenize(a + b.removesuffix("</w>"))]
        apart = [t.id for t in model.tokenize(b.removesuffix("</w>"))]
        if apart == [vocabulary.ids[b]] and whole[-1] == vocabulary.ids[b] and encoder.seam(vocabulary.ids[a], vocabulary.ids[b]):
            assert vocabulary.ids[a] in whole or len(whole) > 2


ROWS = [(1, "The cat's whiskers", "x"), (2, None, None), (None, "", "y"), (1, "The cat's whiskers", "x"), (5, "É " * 30000, None), (4, "<|endoftext|>tail", "z")]


def table(spark, rows=ROWS):
    return spark.createDataFrame(rows, "doc_id bigint, text string, ids string").repartition(3)


def test_digests_and_round_trip(spark):
    got = sorted(map(tuple, bpe.digests(table(spark), PATH).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=repr)

    def one(i, t):
        ids = wanted(t)
        return i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(LIBRARY.decode(ids, skip_special_tokens=False).encode()).hexdigest()

    assert got == sorted((one(i, t) for i, t, _ in ROWS), key=repr)
    encoded = bpe.encode(table(spark), PATH)  # replaces the column ids
    assert encoded.columns == ["doc_id", "text", "ids"]
    decoded = bpe.decode(encoded, PATH).collect()
    assert all(r.decoded == LIBRARY.decode(wanted(r.text), skip_special_tokens=False) for r in decoded) and len(decoded) == len(ROWS)
    assert bpe.digests(table(spark, []), PATH).count() == 0


def test_planes_hold_all_ids(spark):
    got = sorted((r.start, r.id, r.n_tokens, r.ids_crc32) for r in planes.round_trip(table(spark), PATH).collect())
    want, start = [], 0
    for i, t, _ in sorted(ROWS, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = [*wanted(t), 1]
        want.append((start, i, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert got == want
    assert planes.round_trip(table(spark, []), PATH).count() == 0


@pytest.mark.parametrize("kind", [planes.BYTE_PLANES, planes.BIT_PLANES])
def test_plane_files(tmp_path, kind):
    rng = np.random.default_rng(3)
    docs = [(i if i != 3 else None, rng.integers(0, 1 << 32 if i % 5 == 0 else 49408, int(rng.integers(0, 900)), dtype=np.uint32)) for i in range(60)]
    docs[7] = (7, np.empty(0, np.uint32))
    writer = planes.Writer(str(tmp_path / "x.ids"), kind, chunk=256)
    for i, ids in docs:
        writer.add(i, ids.astype("<u4").tobytes())
    writer.close()
    reader = planes.Reader(str(tmp_path / "x.ids"))
    every = np.concatenate([ids for _, ids in docs])
    start = 0
    for (i, ids), (j, at, data) in zip(docs, reader.documents(), strict=True):
        assert (i, start, ids.tobytes()) == (j, at, data)
        start += len(ids)
    for a, n in ((0, 1), (255, 2), (1000, 700), (len(every) - 1, 1), (5, 0)):
        assert (reader.slice(a, n) == every[a : a + n]).all()
    (tmp_path / "bad").write_bytes(b"0" * 200)
    with pytest.raises(ValueError, match="not a file of planes"):
        planes.Reader(str(tmp_path / "bad"))
