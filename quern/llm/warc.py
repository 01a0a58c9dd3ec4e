"""WARC archives written and read as a chunked record table.

A payload is a run of rows ``(record, chunk_no, data)`` of at most ``CHUNK`` bytes each. Rows of one record follow each
other in a partition, so digests are carried from row to row and a task holds one chunk at a time, both when writing
and when reading. Archives are sequences of gzip members, one per record, in the folder given; every task writes its
own file under a temporary name and renames it when done, so a repeated task replaces its own output.

Of records with equal payloads of at least ``LEAST`` bytes the one with the largest identifier is the response, the
others are revisits that name it; smaller payloads are all responses. Null payloads are empty. Rows without an
identifier are responses. Repeated rows each get a record; equal rows of the largest identifier are all responses.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.shared import place, saved

CHUNK = 1 << 16  # bytes of a chunk
LEAST = 0  # payloads from this size on are deduplicated
DATE = "2024-01-01T00:00:00Z"  # default capture date: the same rows give the same archive


def chunks(rows: DataFrame, payload: str, size: int = CHUNK) -> DataFrame:
    """Replaces a text column by rows (chunk_no, chunks, data); an empty or null payload is one empty chunk."""
    keep = [F.col(f"`{c}`") for c in rows.columns if c != payload]
    b = F.encode(F.coalesce(F.col(payload).cast("string"), F.lit("")), "UTF-8")
    n = F.greatest(F.ceil(F.length("__b") / size), F.lit(1)).cast("int")
    cut = F.transform(F.sequence(F.lit(0), F.col("chunks") - 1), lambda i: F.substring(F.col("__b"), i * size + 1, F.lit(size)))
    out = rows.select(*keep, b.alias("__b")).withColumn("chunks", n)
    return out.select(*[c for c in out.columns if c != "__b"], F.posexplode(cut).alias("chunk_no", "data"))


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def digests(rows: DataFrame, payload: str, keys: list[str]) -> DataFrame:
    """Chunk table without its data: keys, chunk_no, chunks, and size and SHA-1 of the payload up to and with the chunk."""
    table = chunks(rows.select(*keys, payload), payload)
    schema = table.select(*keys, "chunk_no", "chunks").schema.add("bytes", "long").add("digest", "string")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state, size = hashlib.sha1(), 0
        for batch in batches:
            sizes, ends = [], []
            for no, data in zip(batch.column("chunk_no").to_pylist(), batch.column("data")):
                if no == 0:
                    state, size = hashlib.sha1(), 0
                buf = data.as_buffer()
                state.update(buf)
                size += len(buf)
                sizes.append(size)
                ends.append(base32(state.digest()))
            cols = [batch.column(c) for c in [*keys, "chunk_no", "chunks"]]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(sizes, pa.int64()), pa.array(ends, pa.string())], names=[*keys, "chunk_no", "chunks", "bytes", "digest"])

    return table.mapInArrow(run, schema)


def decide(rows: DataFrame, record: str, payload: str, least: int = LEAST) -> DataFrame:
    """(record, check, bytes, digest, refers_to) per distinct record and payload; refers_to is null for responses.

    ``check`` is a hash of the payload that tells apart rows with one identifier.
    """
    base = rows.select(F.col(record).cast("long").alias("record"), F.xxhash64(F.coalesce(F.col(payload).cast("string"), F.lit(""))).alias("check"), F.col(payload).alias("payload"))
    whole = digests(base, "payload", ["record", "check"]).where("chunk_no = chunks - 1")
    whole = saved(whole.groupBy("record", "check").agg(F.max("bytes").alias("bytes"), F.max("digest").alias("digest")), "digests")
    first = whole.where(F.col("bytes") >= least).groupBy("digest", "bytes").agg(F.max("record").alias("first"), F.count("*").alias("n")).where("n > 1")
    first = saved(first.drop("n"), "first")
    out = whole.join(first, ["digest", "bytes"], "left")
    return out.select("record", "check", "bytes", "digest", F.when(F.col("record") != F.col("first"), F.col("first")).alias("refers_to"))


def clean(value: str | None) -> str:
    """A header value on one line."""
    return "".join(c if c.isprintable() and c not in "\r\n" else "%" + c.encode().hex().upper() for c in value or "")


def header(record: int | None, url: str | None, size: int, digest: str, refers_to: int | None, date: str) -> tuple[bytes, bytes]:
    """Header of a record and the HTTP header that opens its block."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % size
    name = "none" if record is None else str(record)
    lines = [
        "WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: <urn:page:{name}>", f"WARC-Target-URI: {clean(url)}",
        f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}", "Content-Type: application/http; msgtype=response",
    ]
    if refers_to is not None:
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    block = len(http) + (size if refers_to is None else 0)
    return ("\r\n".join([*lines, f"Content-Length: {block}"]) + "\r\n\r\n").encode(), http


class Member:
    """Writes one gzip member to a stream, chunk by chunk."""

    def __init__(self, out):
        self.out, self.z = out, zlib.compressobj(4, zlib.DEFLATED, 31)

    def write(self, data) -> None:
        if packed := self.z.compress(data):
            self.out.write(packed)

    def close(self) -> None:
        self.out.write(self.z.flush())


def write(rows: DataFrame, folder: str, record: str, url: str, payload: str, least: int = LEAST, date: str = DATE) -> DataFrame:
    """Writes all rows as records and returns the manifest (path, records)."""
    found = decide(rows, record, payload, least)
    base = rows.select(F.col(record).cast("long").alias("record"), F.col(url).cast("string").alias("url"), F.coalesce(F.col(payload).cast("string"), F.lit("")).alias("payload")).withColumn("check", F.xxhash64("payload"))
    found = found.withColumnsRenamed({"record": "r", "check": "k"})
    full = base.join(found, F.col("record").eqNullSafe(F.col("r")) & (F.col("check") == F.col("k")))
    # a revisit has no block: its payload stays behind
    full = full.select("record", "url", "bytes", "digest", "refers_to", F.when(F.col("refers_to").isNull(), F.col("payload")).otherwise("").alias("payload"))
    table = chunks(full, "payload")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        ctx = TaskContext.get()
        store, root = fs.FileSystem.from_uri(folder)
        name = f"{root}/part-{ctx.partitionId():05d}.warc.gz"
        part = f"{name}.{ctx.taskAttemptId()}.tmp"
        n, out = 0, None
        for batch in batches:
            for r in zip(*(batch.column(c) for c in ("record", "url", "bytes", "digest", "refers_to", "chunks", "chunk_no", "data"))):
                record, url, size, digest, refers, count, no = (x.as_py() for x in r[:7])
                if out is None:
                    store.create_dir(root, recursive=True)
                    out = store.open_output_stream(part, compression=None)
                if no == 0:
                    member = Member(out)
                    head, http = header(record, url, size, digest, refers, date)
                    member.write(head + http)
                    n += 1
                member.write(r[7].as_buffer())
                if no == count - 1:
                    member.write(b"\r\n\r\n")
                    member.close()
        if out is not None:
            out.close()
            if store.get_file_info(name).type != fs.FileType.NotFound:
                store.delete_file(name)
            store.move(part, name)
            yield pa.RecordBatch.from_arrays([pa.array([f"{folder}/{name.rpartition('/')[2]}"]), pa.array([n], pa.int64())], names=["path", "records"])

    return saved(table.mapInArrow(run, "path string, records long"), "manifest")


def records(stream, size: int = CHUNK) -> Iterator[tuple[dict[str, str], int, bytes, bool]]:
    """(headers, chunk number, payload bytes, last) of every record of an uncompressed stream, chunk by chunk."""
    while line := stream.readline():
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("no WARC record where one should begin")
        head: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b"\n", b""):
            k, _, v = line.decode().partition(":")
            head[k.strip().lower()] = v.strip()
        left = int(head["content-length"])
        if head.get("content-type", "").startswith("application/http"):
            while left > 0:
                line = stream.readline(left)
                left -= len(line)
                if line in (b"\r\n", b"\n", b""):
                    break
                k, _, v = line.decode("latin-1").partition(":")
                if k.lower() == "content-length":
                    head["http-length"] = v.strip()
        no = 0
        while left > 0 or no == 0:
            data = stream.read(min(size, left))
            if left > 0 and not data:
                raise ValueError("a WARC record ends too early")
            left -= len(data)
            yield head, no, data, left <= 0
            no += 1


def read(manifest: DataFrame, data: bool = True) -> DataFrame:
    """Chunk table of archives: record, url, type, refers_to, chunk_no, last, bytes and digest so far, data if wanted.

    The last chunk of a response is held against the digest in its header. Revisits have one chunk; their size and
    digest are those of the payload they stand for.
    """
    schema = "record long, url string, type string, refers_to long, chunk_no int, last boolean, bytes long, digest string" + ", data binary" * data
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int32(), pa.bool_(), pa.int64(), pa.string(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        rows: list[tuple] = []
        held = 0
        number = lambda x: int(x[10:-1]) if x.startswith("<urn:page:") and x != "<urn:page:none>" else None

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

        for batch in batches:
            for path in batch.column("path").to_pylist():
                store, root = fs.FileSystem.from_uri(path)
                with store.open_input_stream(root, compression=None) as raw, gzip.GzipFile(fileobj=raw) as stream:
                    state, size = hashlib.sha1(), 0
                    for head, no, piece, last in records(stream):
                        if no == 0:
                            state, size = hashlib.sha1(), 0
                        state.update(piece)
                        size += len(piece)
                        kind, told = head["warc-type"], head.get("warc-payload-digest", "").removeprefix("sha1:")
                        done, digest = size, base32(state.digest())
                        if kind == "revisit":
                            done, digest = int(head.get("http-length", 0)), told
                        elif last and told and told != digest:
                            raise ValueError(f"payload of {head['warc-record-id']} does not have its digest")
                        row = (number(head["warc-record-id"]), head.get("warc-target-uri"), kind, number(head.get("warc-refers-to", "")), no, last, done, digest)
                        rows.append((*row, piece) if data else row)
                        held += len(piece) if data else 100
                        if held > 4 << 20 or len(rows) >= 5000:
                            yield batch_of()
                            rows, held = [], 0
        if rows:
            yield batch_of()

    return manifest.select("path").repartition(max(1, min(2000, manifest.count())), "path").mapInArrow(run, schema)


def archive_pages(rows: DataFrame, record: str = "page_id", url: str = "url", payload: str = "html", least: int = LEAST) -> DataFrame:
    """Writes the pages to a new folder of archives, reads them back and returns their chunk table without data."""
    return read(write(rows, place(rows.sparkSession, "warc"), record, url, payload, least), data=False)
