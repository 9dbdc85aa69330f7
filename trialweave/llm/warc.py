"""WARC archives of pages, and a normaliser that turns whole-file gzip streams into one gzip member a record.

:func:`write_archives` makes a record of each page: a response with the page, or, where an
earlier page (smaller page_id) has the same payload, a revisit that refers to it. Which
page is first is found from digests and ids alone. Each archive is one gzip stream over
all its records, which can only be read from the start.

:func:`normalise` inflates each stream once, in pieces, writes every record as a member of
its own to a new ``.warc.gz`` file and keeps the place of each in a sidecar ``.cdx`` file.
It takes archives of any tool: records of every type, ids of any form, records without
digest or target, streams of one member or many. :func:`read_archives` then inflates
single members at the places in the sidecar.

Archives are files in a folder that driver and executors share (any file system that Arrow
opens by its address), written by tasks. A file's name has the number of the task's
attempt, and a table beside the files, which Spark commits, names those that count: what a
lost or repeated attempt left behind is not in it. An archive closes at ``ARCHIVE_BYTES``
of records; a task holds one record, and one archive while it writes.

Edge cases: a null page is an empty payload; a null url becomes the record's own id; control
characters and spaces in a url are percent-encoded; pages of one page_id and payload are
each a response if that id is the smallest; a page without id is a response only where no
page with an id has its payload, else a revisit; payloads shorter than ``min_bytes`` are
always responses; an empty table makes no archive; extra columns are not read. A stream
that ends within a member or a record is an error, and so is a wrong SHA-1 digest; digests
of other kinds are kept unread.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trialweave.llm import words as W
from trialweave.llm.scratch import materialize

ARCHIVE_BYTES = 8 << 20
PIECE = 1 << 18
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_UNSAFE = re.compile(r"[\x00-\x20\x7f]")
MANIFEST = "_archives"
_LISTED = "name string, records bigint, bytes bigint"


def base32_sha1(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None) -> str:
    return f"<urn:page:{'none' if page_id is None else page_id}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> bytes:
    """The bytes of one record."""
    uri = _UNSAFE.sub(lambda m: f"%{ord(m[0]):02X}", url) if url else record_id(page_id)[1:-1]
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Target-URI: {uri}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha1:{base32_sha1(payload)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        head += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(refers_to)}"]
    else:
        block += payload
    head.append(f"Content-Length: {len(block)}")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def headers(data: bytes) -> dict[str, str]:
    """Named fields of a head, without its first line; a line that begins with space goes on with the one before."""
    lines = re.sub(r"\r\n[ \t]+", " ", data.decode("utf-8", "replace")).split("\r\n")[1:]
    return {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines) if k}


def parse(data: bytes) -> dict:
    """record_id, record_type, uri, refers_to (a record id), payload_bytes, payload_digest and payload of one record.

    The payload of an HTTP response or request is what follows its head, of other records the whole block; a revisit has none, and its size, if told, is that in the HTTP head.
    """
    head, _, rest = data.partition(b"\r\n\r\n")
    named = headers(head)
    block = rest[: int(named["content-length"])]
    kind, digest = named.get("warc-type", ""), named.get("warc-payload-digest")
    out = {"record_id": named.get("warc-record-id"), "record_type": kind, "uri": named.get("warc-target-uri"), "refers_to": named.get("warc-refers-to")}
    is_http = named.get("content-type", "").replace(" ", "").startswith("application/http")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    shown = digest.removeprefix("sha1:") if digest else None
    if kind == "revisit":
        told = headers(http).get("content-length", "")
        return out | {"payload_bytes": int(told) if told.isdigit() else None, "payload_digest": shown, "payload": None}
    own = base32_sha1(payload)
    if digest and digest.startswith("sha1:") and shown.upper() != own:
        raise ValueError(f"{out['record_id']}: the payload does not have its digest")
    return out | {"payload_bytes": len(payload), "payload_digest": own if digest is None else shown, "payload": payload}


def inflated(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """What a stream of one or many gzip members holds, at most ``PIECE`` bytes at a time."""
    inflate, begun = zlib.decompressobj(31), False
    for piece in pieces:
        while piece:
            begun = True
            out = inflate.decompress(piece, PIECE)
            if out:
                yield out
            piece = inflate.unconsumed_tail
            if inflate.eof:
                piece, inflate, begun = inflate.unused_data, zlib.decompressobj(31), False
    while begun and (out := inflate.decompress(inflate.unconsumed_tail, PIECE)):
        yield out
    if begun and not inflate.eof:
        raise ValueError("the archive ends within a gzip member")


def records(pieces: Iterable[bytes]) -> Iterator[bytes]:
    """The records of an archive, from one inflation of its stream."""
    held, need = bytearray(), 0
    for piece in inflated(pieces):
        held += piece
        while len(held) >= need:
            if not need:
                end = held.find(b"\r\n\r\n")
                if end < 0:
                    break
                length = headers(bytes(held[:end])).get("content-length", "")
                if not held.startswith(b"WARC/") or not length.isdigit():
                    raise ValueError("the archive has a record without its first line or length")
                need = end + 8 + int(length)
                continue
            yield bytes(held[:need])
            del held[:need]
            need = 0
    if held:
        raise ValueError("the archive ends within a record")


def cut(data: bytes) -> Iterator[bytes]:
    return (data[k : k + PIECE] for k in range(0, len(data), PIECE))


def _open(folder: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a folder's address, as a task or the driver sees it."""
    return fs.FileSystem.from_uri(folder) if ":" in folder else (fs.LocalFileSystem(), folder)


def _pieces(files: fs.FileSystem, path: str) -> Iterator[bytes]:
    with files.open_input_stream(path, compression=None) as f:
        while piece := f.read(PIECE):
            yield piece


def member(data: bytes, level: int = 6) -> bytes:
    pack = zlib.compressobj(level, wbits=31)
    return pack.compress(data) + pack.flush()


def deduplicated(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """page_id, url, html, revisit, refers_to of every page."""
    html = F.coalesce("html", F.lit(""))
    pages = pages.select(F.col("page_id").cast("bigint").alias("page_id"), "url", html.alias("html"), F.sha1(html.cast("binary")).alias("_digest"))
    # a table, so that the partition of a very frequent payload can be split in the join
    first = materialize(pages.select("_digest", "page_id").groupBy("_digest").agg(F.min("page_id").alias("first_id")), "first-pages")
    revisit = (F.octet_length("html") >= min_bytes) & ~F.col("page_id").eqNullSafe(F.col("first_id"))
    return pages.join(first, "_digest").select("page_id", "url", "html", revisit.alias("revisit"), F.when(revisit, F.col("first_id")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES) -> None:
    """Write ``.warc.gz`` files of one gzip stream each to ``folder``, and the table that names them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        files.create_dir(path, recursive=True)
        task, seq = TaskContext.get(), 0
        pack, out, size, n = zlib.compressobj(3, wbits=31), [], 0, 0

        def close() -> pa.RecordBatch:
            name = f"pages-{task.partitionId():06d}-{seq:06d}-{task.taskAttemptId()}.warc.gz"
            data = b"".join([*out, pack.flush()])
            with files.open_output_stream(f"{path}/{name}", compression=None) as f:
                f.write(data)
            return pa.RecordBatch.from_pydict({"name": [name], "records": pa.array([n], pa.int64()), "bytes": pa.array([len(data)], pa.int64())})

        for whole in batches:
            for batch in W.slices(whole, "html"):
                columns = [batch.column(c).to_pylist() for c in ("page_id", "url", "refers_to", "revisit")]
                data, offsets = W.strings(batch.column("html"))
                for k, (page_id, url, refers_to, revisit) in enumerate(zip(*columns, strict=True)):
                    one = record(page_id, url, data[offsets[k] : offsets[k + 1]].tobytes(), refers_to, revisit)
                    out.append(pack.compress(one))
                    size, n = size + len(one), n + 1
                    if size >= archive_bytes:
                        yield close()
                        seq, pack, out, size, n = seq + 1, zlib.compressobj(3, wbits=31), [], 0, 0
        if n:
            yield close()

    deduplicated(pages, min_bytes).mapInArrow(run, _LISTED).write.parquet(f"{folder}/{MANIFEST}")


def archives(spark: SparkSession, folder: str) -> DataFrame:
    """name, records, bytes of the archives of a folder, dealt one archive after the other."""
    listed = spark.read.schema(_LISTED).parquet(f"{folder}/{MANIFEST}")
    return listed.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), "name")


def normalise(named: DataFrame, source: str, folder: str) -> None:
    """Write each archive of ``source`` that ``named`` names as members of one record, with its sidecar, to ``folder``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (files, here), (target, there) = _open(source), _open(folder)
        target.create_dir(there, recursive=True)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                stem = f"{name.removesuffix('.gz').removesuffix('.warc')}-{TaskContext.get().taskAttemptId()}"
                at = n = 0
                with target.open_output_stream(f"{there}/{stem}.warc.gz", compression=None) as body, target.open_output_stream(f"{there}/{stem}.cdx", compression=None) as index:
                    for one in records(_pieces(files, f"{here}/{name}")):
                        fields, packed = headers(one.partition(b"\r\n\r\n")[0]), member(one)
                        places = [str(at), str(len(packed)), *(_UNSAFE.sub("", fields.get(x, "-")) or "-" for x in ("warc-type", "warc-record-id", "warc-target-uri"))]
                        index.write((" ".join(places) + "\n").encode())
                        body.write(packed)
                        at, n = at + len(packed), n + 1
                yield pa.RecordBatch.from_pydict({"name": [f"{stem}.warc.gz"], "records": pa.array([n], pa.int64()), "bytes": pa.array([at], pa.int64())})

    named.select("name").mapInArrow(run, _LISTED).write.parquet(f"{folder}/{MANIFEST}")


def _index(files: fs.FileSystem, path: str) -> list[list[str]]:
    with files.open_input_stream(path.removesuffix(".warc.gz") + ".cdx", compression=None) as f:
        return [x.split(" ", 4) for x in f.read().decode().splitlines()]


def sidecar(spark: SparkSession, folder: str) -> DataFrame:
    """name, offset, length, type, record_id, uri of every record; reads no archive."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows = _index(files, f"{path}/{name}")
                columns = {"name": pa.array([name] * len(rows), pa.string()), "offset": pa.array([int(x[0]) for x in rows], pa.int64()), "length": pa.array([int(x[1]) for x in rows], pa.int64())}
                yield pa.RecordBatch.from_pydict(columns | {c: pa.array([x[k] for x in rows], pa.string()) for k, c in enumerate(("type", "record_id", "uri"), 2)})

    return archives(spark, folder).select("name").mapInArrow(run, "name string, offset bigint, length bigint, type string, record_id string, uri string")


def read_archives(spark: SparkSession, folder: str, with_payload: bool = True) -> DataFrame:
    """record_id, record_type, uri, refers_to, payload_bytes, payload_digest and, if wanted, payload: each member inflated at its place in the sidecar."""
    kinds = {"record_id": pa.string(), "record_type": pa.string(), "uri": pa.string(), "refers_to": pa.string(), "payload_bytes": pa.int64(), "payload_digest": pa.string()} | ({"payload": pa.binary()} if with_payload else {})
    schema = pa.schema(list(kinds.items()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, path = _open(folder)
        for batch in batches:
            for name in batch.column("name").to_pylist():
                rows, held = [], 0
                with files.open_input_file(f"{path}/{name}") as f:
                    for at, length, *_ in _index(files, f"{path}/{name}"):
                        f.seek(int(at))
                        rows.append(parse(zlib.decompress(f.read(int(length)), 31)))
                        held += len(rows[-1]["payload"] or b"") if with_payload else 0
                        if len(rows) == 4096 or held > ARCHIVE_BYTES:
                            yield pa.RecordBatch.from_pydict({n: [x[n] for x in rows] for n in kinds}, schema=schema)
                            rows, held = [], 0
                yield pa.RecordBatch.from_pydict({n: [x[n] for x in rows] for n in kinds}, schema=schema)

    sql = "record_id string, record_type string, uri string, refers_to string, payload_bytes bigint, payload_digest string" + ", payload binary" * with_payload
    return archives(spark, folder).select("name").mapInArrow(run, sql)


def page_records(spark: SparkSession, folder: str, with_payload: bool = False) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of the records that :func:`write_archives` made of pages."""
    page = lambda c: F.regexp_extract(c, "^<urn:page:(-?[0-9]+)>$", 1)
    number = lambda c: F.when(page(c) != "", page(c)).cast("bigint").alias("page_id" if c == "record_id" else c)
    read = read_archives(spark, folder, with_payload).where(F.col("record_id").startswith("<urn:page:"))
    return read.select(number("record_id"), "payload_bytes", "payload_digest", "record_type", number("refers_to"), *["uri", "payload"] * with_payload)


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages
), d AS (SELECT page_id, strlen(html) AS n, min(page_id) OVER (PARTITION BY html) AS first_id,
    array_to_string(list_transform(string_split(sha1(html), ''), lambda c: lpad(bin(instr('0123456789abcdef', c) - 1), 4, '0')), '') AS bits FROM p)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(1 + list_sum(list_transform(range(0, 5), lambda j: CAST(substr(bits, CAST(5 * i + j + 1 AS BIGINT), 1) AS INTEGER) * CAST(2 ** (4 - j) AS INTEGER))) AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first_id THEN first_id END AS refers_to FROM d
"""
