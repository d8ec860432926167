"""WARC archives as seekable Zstandard bundles.

Records are grouped into frames that can be read alone. After the frames come two skippable frames, which any zstd decoder
passes over: the record index (identifier -> frame, offset in the frame, length) and the seek table of the seekable format
(sizes of every frame, then a footer). zstd -d turns a bundle into a plain WARC file.
"""

from __future__ import annotations

import base64
import hashlib
import json
import struct
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quercus.llm.common import forget, row_id, scratch, written
from quercus.llm.files import Source, attempt_file, create

#: Fixed values of the zstd seekable format and of the index frame beside it.
SKIPPABLE_SEEK, SKIPPABLE_INDEX, SEEKABLE_MAGIC = 0x184D2A5E, 0x184D2A50, 0x8F92EAB1
#: Uncompressed bytes after which a frame ends (a longer record has a frame of its own), and a bundle's.
FRAME_BYTES, BUNDLE_BYTES, ZSTD_LEVEL = 1 << 18, 256 << 20, 3
DATE = "1970-01-01T00:00:00Z"


def digest(payload: bytes) -> str:
    """SHA-1 in upper-case base32, as WARC-Payload-Digest has it."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_uri(key: int | None, row: int) -> str:
    """One for each row: the name says the id, the fragment the row."""
    return f"urn:page:{'' if key is None else key}#{row}"


def record(uri: str, url: str | None, payload: bytes | None, size: int, payload_digest: str, refers_to: str | None) -> bytes:
    """A response record, or a revisit record if refers_to is given (with HTTP headers and no payload)."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    block = http if refers_to else http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if refers_to else 'response'}", f"WARC-Record-ID: <{uri}>", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append("WARC-Target-URI: " + "".join(c if c > "\x20" and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url))
    head += [f"WARC-Payload-Digest: sha1:{payload_digest}", "Content-Type: application/http;msgtype=response"]
    if refers_to:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <{refers_to}>"]
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict[str, str], bytes]:
    """Headers (names in lower case) and block of the record that data begins with."""
    end = data.index(b"\r\n\r\n")
    first, *lines = data[:end].decode().split("\r\n")
    if not first.startswith("WARC/1."):
        raise ValueError("not a WARC record")
    headers = {k.lower(): v for k, _, v in (line.partition(": ") for line in lines)}
    return headers, data[end + 4 : end + 4 + int(headers["content-length"])]


def _skippable(magic: int, body: bytes) -> bytes:
    return struct.pack("<II", magic, len(body)) + body


class Bundle:
    """Writes one bundle."""

    def __init__(self, uri: str) -> None:
        self.uri, self.out, self.size, self.records = uri, create(uri), 0, 0
        self.compressor = zstandard.ZstdCompressor(level=ZSTD_LEVEL, write_checksum=True)
        self.frames: list[tuple[int, int]] = []
        self.index: list[tuple[str, int, int, int]] = []
        self.parts: list[bytes] = []
        self.pending = 0

    def add(self, uri: str, data: bytes) -> None:
        if self.pending and self.pending + len(data) > FRAME_BYTES:
            self._frame()
        self.index.append((uri, len(self.frames), self.pending, len(data)))
        self.parts.append(data)
        self.pending += len(data)
        self.records += 1

    def _frame(self) -> None:
        packed = self.compressor.compress(b"".join(self.parts))
        self.out.write(packed)
        self.frames.append((len(packed), self.pending))
        self.size += self.pending
        self.parts, self.pending = [], 0

    def close(self) -> None:
        if self.pending:
            self._frame()
        index = _skippable(SKIPPABLE_INDEX, zstandard.ZstdCompressor(level=ZSTD_LEVEL).compress(json.dumps(self.index).encode()))
        entries = [*self.frames, (len(index), 0)]
        self.out.write(index)
        table = b"".join(struct.pack("<II", *e) for e in entries)
        self.out.write(_skippable(SKIPPABLE_SEEK, table + struct.pack("<IBI", len(entries), 0, SEEKABLE_MAGIC)))
        self.out.close()


class BundleReader:
    """Reads a bundle through its seek table."""

    def __init__(self, uri: str) -> None:
        self.source = Source(uri)
        size = self.source.size
        count, flags, magic = struct.unpack("<IBI", self.source.read(size - 9, 9))
        if magic != SEEKABLE_MAGIC or flags:
            raise ValueError(f"{uri} has no seek table")
        table = self.source.read(size - 9 - 8 * count, 8 * count)
        sizes = [struct.unpack_from("<II", table, 8 * i) for i in range(count)]
        self.frames, at = [], 0
        for packed, plain in sizes:
            self.frames.append((at, packed, plain))
            at += packed
        self.starts = [0]
        for _, _, plain in self.frames:
            self.starts.append(self.starts[-1] + plain)
        at, packed, _ = self.frames.pop()
        self.index = json.loads(zstandard.ZstdDecompressor().decompress(self.source.read(at + 8, packed - 8)))
        self.places = {uri: place for uri, *place in reversed(self.index)}

    def frame(self, n: int) -> bytes:
        at, packed, plain = self.frames[n]
        return zstandard.ZstdDecompressor().decompress(self.source.read(at, packed), max_output_size=plain)

    def record(self, uri: str) -> tuple[dict[str, str], bytes]:
        """One record: its frame alone is read."""
        frame, offset, length = self.places[uri]
        return parse(self.frame(frame)[offset : offset + length])

    def read_at(self, offset: int, length: int) -> bytes:
        """Bytes of the plain WARC file; only the frames that hold them are read."""
        out, n = [], bisect_right(self.starts, offset) - 1
        while length > 0 and n < len(self.frames):
            part = self.frame(n)[offset - self.starts[n] :][:length]
            out.append(part)
            offset, length, n = offset + len(part), length - len(part), n + 1
        return b"".join(out)

    def records(self) -> Iterator[tuple[str, dict[str, str], bytes]]:
        now, data = -1, b""
        for uri, frame, offset, length in self.index:
            if frame != now:
                now, data = frame, self.frame(frame)
            yield uri, *parse(data[offset : offset + length])

    def close(self) -> None:
        self.source.close()


def write(df: DataFrame, folder: str, id_column: str = "page_id", url_column: str = "url", payload_column: str = "html", min_revisit_bytes: int = 0) -> DataFrame:
    """Writes a record for each row into bundles under folder; gives their manifest (path, records, n_bytes) as a written table.

    Of the records with equal payloads (by SHA-256 and length) of at least min_revisit_bytes, that with the largest id (null
    ids are least; of equal ids the last row) is a response and the others are revisits of it. A null payload is empty, a
    null url gives no target. An empty table gives no bundle. What is shuffled to find equal payloads are digests; the rows
    themselves are joined with the revisits alone, so where these are few enough to broadcast, payloads are never shuffled.
    """
    payload = F.coalesce(F.col(payload_column).cast("binary"), F.lit(b""))
    rows = df.select(row_id().alias("row"), F.col(id_column).cast("bigint").alias("id"), F.col(url_column).alias("url"), payload.alias("payload"), F.unhex(F.sha2(payload, 256)).alias("print"), F.octet_length(payload).alias("size"))
    # Written, because row numbers hold for one reading of df only: a plan with a shuffle may deal its rows otherwise the next time.
    source = written(rows, "rows", compression="zstd")
    prints = source.select("row", "id", "print", "size")
    by_id = F.struct(F.col("id").isNotNull().alias("named"), "id", "row")
    repeated = written(prints.where(F.col("size") >= min_revisit_bytes).groupBy("print", "size").agg(F.count("*").alias("n"), F.max(by_id).alias("kept")).where("n > 1").drop("n"), "repeated")
    # Written, so that its size is known and a small one is broadcast: then no payload is shuffled.
    revisits = written(prints.join(repeated, ["print", "size"]).where("row != kept.row").select("row", F.col("kept.id").alias("to_id"), F.col("kept.row").alias("to_row")), "revisits")
    told = source.select("row", "id", "url", "payload").join(revisits, "row", "left")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bundle, done = None, []
        for batch in batches:
            rows, ids, urls, to_ids, to_rows = (batch.column(i).to_pylist() for i in (0, 1, 2, 4, 5))
            for i, p in enumerate(batch.column(3)):
                payload = p.as_py()
                if bundle is None:
                    bundle = Bundle(attempt_file(folder, ".warc.zst", len(done)))
                uri = record_uri(ids[i], rows[i])
                refers_to = None if to_rows[i] is None else record_uri(to_ids[i], to_rows[i])
                bundle.add(uri, record(uri, urls[i], payload, len(payload), digest(payload), refers_to))
                if bundle.size >= BUNDLE_BYTES:
                    bundle.close()
                    done.append(bundle)
                    bundle = None
        if bundle is not None:
            bundle.close()
            done.append(bundle)
        yield pa.RecordBatch.from_arrays([pa.array([getattr(b, a) for b in done], k) for a, k in (("uri", pa.string()), ("records", pa.int64()), ("size", pa.int64()))], names=["path", "records", "n_bytes"])

    manifest = written(told.select("row", "id", "url", "payload", "to_id", "to_row").mapInArrow(run, "path string, records bigint, n_bytes bigint"), "manifest")
    forget(source)
    forget(revisits)
    return manifest


def read_back(manifest: DataFrame, keep_payload: bool = False) -> DataFrame:
    """The records of the bundles: record_id, url, record_type, payload_bytes, payload_digest, refers_to_id (and payload, empty for revisits).

    Length and digest of a response come from the payload read; a wrong digest is an error. Those of a revisit come from
    its headers.
    """
    spark = manifest.sparkSession
    names = {"record_id": pa.string(), "url": pa.string(), "record_type": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string(), "refers_to_id": pa.string()}
    names |= {"payload": pa.binary()} if keep_payload else {}
    kinds = {pa.string(): "string", pa.int64(): "bigint", pa.binary(): "binary"}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                reader = BundleReader(path)
                rows: list[tuple] = []
                held = 0
                for uri, headers, block in reader.records():
                    head, _, payload = block.partition(b"\r\n\r\n")
                    declared = headers["warc-payload-digest"].removeprefix("sha1:")
                    size = int(head.rpartition(b"Content-Length: ")[2])
                    if headers["warc-type"] == "response" and (len(payload) != size or digest(payload) != declared):
                        raise ValueError(f"{path}: the payload of {uri} is damaged")
                    rows.append((uri, headers.get("warc-target-uri"), headers["warc-type"], size, declared, headers["warc-refers-to"].strip("<>") if "warc-refers-to" in headers else None, payload))
                    held += len(payload) if keep_payload else 200
                    if held > 1 << 24:
                        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())], names=list(names))
                        rows, held = [], 0
                reader.close()
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(names.values())], names=list(names))

    paths = manifest.select("path").repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "path")
    return paths.mapInArrow(run, ", ".join(f"{n} {kinds[k]}" for n, k in names.items()))


def id_of(uri: str):
    """The id in a record's name, as a column expression over the column of that name; null if the row had none."""
    return F.expr(f"try_cast(regexp_extract({uri}, '^urn:page:(-?[0-9]*)#', 1) as bigint)")


def round_trip(df: DataFrame, **columns: str) -> DataFrame:
    """Writes df's records to a new place in the shared folder and reads them back."""
    return read_back(write(df, scratch(df.sparkSession, "warc"), **columns))
