"""Token ids in files of shuffled planes.

A file holds the ids of consecutive documents, end to end, cut into chunks of a fixed number of ids. A chunk's ids, 32 bits
each, are transposed into planes: byte plane k has byte k of every id (bit plane k: bit k). Similar values then lie together,
and the upper planes are mostly zero. Each plane is compressed on its own with zstandard. After the chunks come the document
table, the chunk index (offset and length of every plane) and a footer that says where they are.

Layout: magic; planes of all chunks; documents (zstd: ids as int64, null flags, lengths as int64); index (zstd: int64);
footer (little-endian: offset and length of documents, of index; counts of documents, ids, chunks; chunk size; planes; magic).
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quercus.llm.bpe import tokenizer_bytes
from quercus.llm.common import scratch, utf8, written
from quercus.llm.files import Source, attempt_file, create
from quercus.llm.wordbpe import library_encoder

MAGIC, FOOTER = b"IDPLANE1", struct.Struct("<9q8s")
CHUNK_IDS, ZSTD_LEVEL = 1 << 16, 3
BYTE_PLANES, BIT_PLANES = 4, 32


def to_planes(ids: np.ndarray, planes: int) -> list[bytes]:
    data = np.ascontiguousarray(ids, dtype="<u4").view(np.uint8).reshape(-1, 4)
    if planes == BYTE_PLANES:
        return [np.ascontiguousarray(data[:, k]).tobytes() for k in range(4)]
    bits = np.unpackbits(data, axis=1, bitorder="little")
    return [np.packbits(bits[:, k], bitorder="little").tobytes() for k in range(32)]


def from_planes(planes: list[bytes], n: int) -> np.ndarray:
    if len(planes) == BYTE_PLANES:
        return np.stack([np.frombuffer(p, np.uint8) for p in planes], axis=1).reshape(-1).view("<u4")
    bits = np.stack([np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") for p in planes], axis=1)
    return np.packbits(bits, axis=1, bitorder="little").reshape(-1).view("<u4")


class Writer:
    def __init__(self, uri: str, planes: int = BYTE_PLANES, chunk: int = CHUNK_IDS) -> None:
        self.uri, self.out, self.planes, self.chunk = uri, create(uri), planes, chunk
        self.compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL)
        self.out.write(MAGIC)
        self.at = len(MAGIC)
        self.index: list[tuple[int, int]] = []
        self.docs: list[int | None] = []
        self.lengths: list[int] = []
        self.parts: list[bytes] = []
        self.pending = self.total = 0

    def add(self, doc: int | None, ids: bytes) -> None:
        self.docs.append(doc)
        self.lengths.append(len(ids) // 4)
        self.parts.append(ids)
        self.pending += len(ids) // 4
        self.total += len(ids) // 4
        if self.pending >= 16 * self.chunk:
            self._chunks(False)

    def _chunks(self, last: bool) -> None:
        ids = np.frombuffer(b"".join(self.parts), dtype="<u4")
        whole = len(ids) if last else len(ids) // self.chunk * self.chunk
        for i in range(0, whole, self.chunk):
            for plane in to_planes(ids[i : min(whole, i + self.chunk)], self.planes):
                self.index.append(self._put(self.compressor.compress(plane)))
        self.parts = [ids[whole:].tobytes()]
        self.pending = len(ids) - whole

    def _put(self, data: bytes) -> tuple[int, int]:
        self.out.write(data)
        self.at += len(data)
        return self.at - len(data), len(data)

    def close(self) -> None:
        self._chunks(True)
        docs = np.array([d or 0 for d in self.docs], dtype="<i8").tobytes() + bytes(d is None for d in self.docs) + np.array(self.lengths, dtype="<i8").tobytes()
        documents = self._put(self.compressor.compress(docs))
        index = self._put(self.compressor.compress(np.array(self.index, dtype="<i8").tobytes()))
        self.out.write(FOOTER.pack(*documents, *index, len(self.docs), self.total, len(self.index) // self.planes, self.chunk, self.planes, MAGIC))
        self.out.close()


class Reader:
    """Reads chunks one at a time."""

    def __init__(self, uri: str) -> None:
        self.source = Source(uri)
        documents, n_documents, index, n_index, self.n, self.total, self.chunks, self.chunk, self.planes, magic = FOOTER.unpack(self.source.read(self.source.size - FOOTER.size, FOOTER.size))
        if magic != MAGIC:
            raise ValueError(f"{uri} is not a file of planes")
        self.decompressor = zstandard.ZstdDecompressor()
        docs = self.decompressor.decompress(self.source.read(documents, n_documents))
        none = np.frombuffer(docs, np.uint8, self.n, 8 * self.n)
        self.docs = [None if x else d for d, x in zip(np.frombuffer(docs, "<i8", self.n).tolist(), none, strict=True)]
        self.lengths = np.frombuffer(docs, "<i8", self.n, 9 * self.n)
        self.index = np.frombuffer(self.decompressor.decompress(self.source.read(index, n_index)), "<i8").reshape(self.chunks, self.planes, 2)

    def ids(self, chunk: int) -> np.ndarray:
        n = min(self.chunk, self.total - chunk * self.chunk)
        return from_planes([self.decompressor.decompress(self.source.read(int(a), int(b))) for a, b in self.index[chunk]], n)

    def slice(self, start: int, length: int) -> np.ndarray:
        """Ids by place in the file; only the chunks that hold them are read."""
        first, last = start // self.chunk, (start + length - 1) // self.chunk
        parts = [self.ids(c) for c in range(first, last + 1)] if length else [np.empty(0, "<u4")]
        return np.concatenate(parts)[start - first * self.chunk :][:length] if length else parts[0]

    def documents(self) -> Iterator[tuple[int | None, int, bytes]]:
        """Each document's id, the ids before it in the file, and its own."""
        held, at, chunk, start = b"", 0, 0, 0
        for doc, n in zip(self.docs, self.lengths.tolist(), strict=True):
            parts = [held[at : at + 4 * n]]
            need = 4 * n - len(parts[0])
            at += 4 * n
            while need > 0:
                held, chunk = self.ids(chunk).tobytes(), chunk + 1
                parts.append(held[:need])
                at, need = min(need, len(held)), need - len(held)
            yield doc, start, b"".join(parts)
            start += n

    def close(self) -> None:
        self.source.close()


def write(df: DataFrame, folder: str, tokenizer: str, end_id: int | None = 1, id_column: str = "doc_id", text_column: str = "text", planes: int = BYTE_PLANES) -> DataFrame:
    """Encodes each whole text with the tokenizers library and writes all ids, in ascending id order, to files under folder.

    Gives the manifest as a written table: shard (ascending with the ids), path, documents, ids. end_id is appended to each
    document (None: nothing). Null texts are empty; null ids come first; rows of one id stand in the order of their texts'
    hashes, so that even an id with many rows is dealt over several files. An empty table gives no file.
    """
    data = df.sparkSession.sparkContext.broadcast(tokenizer_bytes(tokenizer))
    source = df.select(F.col(id_column).cast("bigint").alias("id"), F.col(text_column).alias("text"))
    ordered = source.repartitionByRange(F.col("id"), F.xxhash64("text")).sortWithinPartitions("id", F.xxhash64("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        writer, encoder = None, None
        ended = b"" if end_id is None else np.array([end_id], dtype="<u4").tobytes()
        for batch in batches:
            encoder = encoder or _encoder(data.value)
            for doc, text in zip(batch.column(0).to_pylist(), utf8(batch.column(1)), strict=True):
                if writer is None:
                    writer = Writer(attempt_file(folder, ".ids"), planes)
                writer.add(doc, encoder.encode((text.as_py() or b"").decode()) + ended)
        if writer is not None:
            writer.close()
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (TaskContext.get().partitionId(), writer.uri, len(writer.docs), writer.total)], names=["shard", "path", "documents", "ids"])

    return written(ordered.mapInArrow(run, "shard bigint, path string, documents bigint, ids bigint"), "manifest")


_encoders: dict = {}


def _encoder(data: bytes):
    if hash(data) not in _encoders:
        _encoders[hash(data)] = library_encoder(data)
    return _encoders[hash(data)]


def read_back(manifest: DataFrame, keep_ids: bool = False) -> DataFrame:
    """A row for each document in the files: id, start (ids of all documents before it), n_tokens, ids_crc32 (and ids)."""
    spark = manifest.sparkSession
    before = F.sum("ids").over(Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1))
    shards = manifest.select("path", F.coalesce(before, F.lit(0)).alias("before")).repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    names = {"id": pa.int64(), "start": pa.int64(), "n_tokens": pa.int64(), "ids_crc32": pa.int64()} | ({"ids": pa.binary()} if keep_ids else {})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, before in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                reader = Reader(path)
                rows: list[tuple] = []
                for doc, start, ids in reader.documents():
                    rows.append((doc, before + start, len(ids) // 4, zlib.crc32(ids), ids if keep_ids else None))
                    if len(rows) == 4096:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())], names=list(names))
                        rows = []
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())], names=list(names))

    return shards.mapInArrow(run, ", ".join(f"{n} {'binary' if n == 'ids' else 'bigint'}" for n in names))


def round_trip(df: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes df's ids to a new place in the shared folder and reads them back."""
    return read_back(write(df, scratch(df.sparkSession, "ids"), tokenizer, **options))
