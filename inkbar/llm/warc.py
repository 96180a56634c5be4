"""WARC archives with a two-level capture index.

``write`` turns pages into gzip-per-record WARC files and indexes every record.  Index
lines are sorted by reversed-host URL key and packed in compressed blocks of
``BLOCK_LINES``; a sparse directory keeps the first key and the byte range of each
block.  ``lookup`` finds a URL by binary search in the directory, reads the few blocks that
can hold it, and then reads the records by byte range.  ``read_back`` takes every
block, orders the captures by file and offset, and reads the archives front to back.

Of records with equal payloads the one with the largest page_id is a response and
the others revisit it.

Files go through Arrow's file systems to the shared folder.  A task writes to names
of its own and reports them; a name counts once the table that reports it is committed, so
a lost or repeated task leaves at most a file nobody reads.

Defined cases: a null html is an empty payload; equal empty payloads revisit like others.
A null url has the key ``-``.  A null page_id never wins over another id; where all are null, and for
repeated rows of the winning page_id, all of those rows are responses.  Empty tables give empty
archives.  Other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import hashlib
import re
import uuid
import zlib
from dataclasses import dataclass
from urllib.parse import quote, unquote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkbar.plans.scratch import scratch_path, written

BLOCK_LINES = 1000
LEVEL = 3
DIRECTORY_ROWS = 200_000
_SAFE = "".join(chr(c) for c in range(33, 127) if c not in (34, 37, 60, 62))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    if "://" not in path and not path.startswith("file:"):
        return pafs.LocalFileSystem(), path
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", path))


def url_key(url: str | None) -> str:
    """Host labels reversed, then port, path and query; the fragment is dropped."""
    if url is None:
        return "-"
    found = re.match(r"(?:[A-Za-z][A-Za-z0-9+.-]*:)?//(?:[^/?#]*@)?([^/?#:]*)(:[0-9]*)?([^#]*)", url)
    if not found:
        return "-)" + quote(url, safe=_SAFE)
    host = ",".join(reversed(found[1].lower().split(".")))
    return quote(f"{host}{found[2] or ''}){found[3] or '/'}", safe=_SAFE + "%")


def _record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool) -> tuple[bytes, str]:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = (
        b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\n"
        b"Content-Length: %d\r\n\r\n" % len(payload)
    )
    block = http if revisit else http + payload
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha1:{digest}",
        f"Content-Length: {len(block)}",
    ]
    if url is not None:
        head.append(f"WARC-Target-URI: {quote(url, safe=_SAFE)}")
    if revisit:
        head.append(f"WARC-Refers-To: <urn:page:{'' if refers_to is None else refers_to}>")
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", digest


def _page(value: str) -> int | None:
    number = value[len("<urn:page:") : -1]
    return int(number) if number else None


def parse(raw: bytes) -> dict:
    """A record read back; payload and digest of a response are taken from its bytes."""
    text = zlib.decompress(raw, 31)
    head, _, rest = text.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    told = int(re.search(rb"Content-Length: ([0-9]+)", http)[1])
    stated = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    revisit = fields["WARC-Type"] == "revisit"
    digest = stated if revisit else base64.b32encode(hashlib.sha1(payload).digest()).decode()
    if digest != stated or not revisit and len(payload) != told:
        raise ValueError(f"damaged record {fields['WARC-Record-ID']}")
    return {
        "page_id": _page(fields["WARC-Record-ID"]),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload": None if revisit else payload,
        "payload_bytes": told,
        "payload_digest": digest,
        "record_type": fields["WARC-Type"],
        "refers_to": _page(fields["WARC-Refers-To"]) if revisit else None,
    }


@dataclass
class Archive:
    """Where an archive's files are, its directory and how many rows that has."""

    path: str
    directory: DataFrame


def _marked(pages: DataFrame) -> DataFrame:
    payload = F.coalesce("html", F.lit(""))
    keyed = pages.select(
        F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("html"),
        F.sha2(payload, 256).alias("same"),
    )
    groups = (
        keyed.groupBy(F.col("same").alias("of")).agg(F.max("page_id").alias("best"), F.count("*").alias("n"))
        .filter("n > 1")
    )
    revisit = F.col("of").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("best"))
    return keyed.join(groups, F.col("same") == F.col("of"), "left").select(
        "page_id", "url", "html", revisit.alias("revisit"), "best"
    )


def write(pages: DataFrame, block_lines: int = BLOCK_LINES) -> Archive:
    """Write ``pages(page_id, url, html)`` as WARC files with their index."""
    spark = pages.sparkSession
    path = scratch_path(spark, "warc")
    fs, local = file_system(path)
    fs.create_dir(local, recursive=True)

    def archive(batches):
        fs, local = file_system(path)
        name, out, at = f"{uuid.uuid4().hex}.warc.gz", None, 0
        try:
            for batch in batches:
                rows = []
                columns = [batch.column(c) for c in ("page_id", "url", "html", "revisit", "best")]
                for i in range(batch.num_rows):
                    page_id, url, html, revisit, best = (c[i].as_py() for c in columns)
                    raw, digest = _record(page_id, url, html.encode(), best, revisit)
                    packer = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    raw = packer.compress(raw) + packer.flush()
                    if out is None:
                        out = fs.open_output_stream(f"{local}/{name}", compression=None)
                    out.write(raw)
                    rows.append((url_key(url), page_id, name, at, len(raw), digest))
                    at += len(raw)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * 6, _CAPTURE)],
                    names=["key", "page_id", "file", "offset", "length", "digest"],
                )
        finally:
            if out is not None:
                out.close()

    captures = written(
        _marked(pages).mapInArrow(
            archive, "key string, page_id long, file string, offset long, length long, digest string"
        ),
        "warc-captures",
    )
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    order = ["key", "page_id", "file", "offset"]
    ordered = captures.repartitionByRange(n, *order).sortWithinPartitions(*order)

    def blocks(batches):
        fs, local = file_system(path)
        name, out, at, lines, first = f"{uuid.uuid4().hex}.index.gz", None, 0, [], None
        found = []

        def close():
            nonlocal out, at, lines
            packer = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = packer.compress("\n".join(lines).encode()) + packer.flush()
            if out is None:
                out = fs.open_output_stream(f"{local}/{name}", compression=None)
            out.write(raw)
            found.append((first, lines[-1].split(" ", 1)[0], name, at, len(raw), len(lines)))
            at, lines = at + len(raw), []

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                first = first if lines else row[0]
                lines.append(" ".join("" if x is None else str(x) for x in row[:6]))
                if len(lines) == block_lines:
                    close()
        if lines:
            close()
        if out is not None:
            out.close()
        yield pa.RecordBatch.from_arrays(
            [pa.array(c, t) for c, t in zip(zip(*found) if found else [[]] * 6, _DIRECTORY)],
            names=["first_key", "last_key", "file", "offset", "length", "lines"],
        )

    directory = ordered.mapInArrow(
        blocks,
        "first_key string, last_key string, file string, offset long, length long, lines long",
    ).withColumn("part", F.spark_partition_id())
    return Archive(path, written(directory, "warc-directory"))


_CAPTURE = [pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
_DIRECTORY = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.int64()]
_LINE = "key string, page_id long, file string, offset long, length long, digest string"


def _read(fs: pafs.FileSystem, open_files: dict, path: str, offset: int, length: int) -> bytes:
    if path not in open_files:
        for old in [p for p in open_files][:-15]:
            open_files.pop(old).close()
        open_files[path] = fs.open_input_file(path)
    return open_files[path].read_at(length, offset)


def _lines(raw: bytes) -> list[list[str]]:
    return [x.split(" ") for x in zlib.decompress(raw, 31).decode().split("\n")]


def _capture_batch(lines: list[list[str]]) -> pa.RecordBatch:
    columns = list(zip(*lines)) if lines else [[]] * 6
    number = lambda c: pa.array([int(x) if x else None for x in c], pa.int64())
    return pa.RecordBatch.from_arrays(
        [
            pa.array(columns[0], pa.string()), number(columns[1]), pa.array(columns[2], pa.string()),
            number(columns[3]), number(columns[4]), pa.array(columns[5], pa.string()),
        ],
        names=["key", "page_id", "file", "offset", "length", "digest"],
    )


def captures(archive: Archive, directory: DataFrame | None = None) -> DataFrame:
    """The index lines of an archive (or of some of its directory's blocks)."""
    path = archive.path

    def run(batches):
        fs, local = file_system(path)
        files: dict = {}
        for batch in batches:
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                yield _capture_batch(_lines(_read(fs, files, f"{local}/{f}", o, n)))

    n = int(archive.directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    some = archive.directory if directory is None else directory
    return some.select("file", "offset", "length").repartition(n, "file", "offset").mapInArrow(run, _LINE)


_RECORD = (
    "page_id long, url string, payload binary, payload_bytes long, payload_digest string, "
    "record_type string, refers_to long"
)
_RECORD_TYPES = {
    "page_id": pa.int64(), "url": pa.string(), "payload": pa.binary(), "payload_bytes": pa.int64(),
    "payload_digest": pa.string(), "record_type": pa.string(), "refers_to": pa.int64(),
}


def records(archive: Archive, lines: DataFrame, payload: bool = True) -> DataFrame:
    """The records of index lines, read by byte range; without ``payload`` it is null."""
    path = archive.path

    def run(batches):
        fs, local = file_system(path)
        files: dict = {}
        for batch in batches:
            rows, size = [], 0
            for f, o, n in zip(*(batch.column(c).to_pylist() for c in ("file", "offset", "length"))):
                row = parse(_read(fs, files, f"{local}/{f}", o, n))
                if not payload:
                    row["payload"] = None
                rows.append(row)
                size += len(row["payload"] or b"")
                if size > 1 << 24:
                    yield _record_batch(rows)
                    rows, size = [], 0
            yield _record_batch(rows)

    return lines.select("file", "offset", "length").mapInArrow(run, _RECORD)


def _record_batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([r[c] for r in rows], t) for c, t in _RECORD_TYPES.items()], names=list(_RECORD_TYPES)
    )


def read_back(archive: Archive, payload: bool = True) -> DataFrame:
    """Every record of the archive, found through its index, read in file order."""
    n = int(archive.directory.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    order = captures(archive).repartitionByRange(n, "file", "offset").sortWithinPartitions("file", "offset")
    return records(archive, order, payload)


def lookup(archive: Archive, urls: DataFrame) -> DataFrame:
    """The records of ``urls(url)``: their keys' captures, by binary search.

    The directory is searched in slices of about ``DIRECTORY_ROWS`` blocks, one after another,
    so what is broadcast is bounded.
    """
    spark = urls.sparkSession
    keyed = urls.select(F.udf(lambda u: url_key(u), "string")("url").alias("key")).distinct()
    per_part = archive.directory.groupBy("part").agg(F.count("*").alias("n")).orderBy("part").collect()
    slices, room = [], 0
    for r in per_part:
        if not slices or room < r.n:
            slices.append([])
            room = max(DIRECTORY_ROWS, r.n)
        slices[-1].append(r.part)
        room -= r.n
    found = None
    for parts in slices:
        rows = archive.directory.filter(F.col("part").between(parts[0], parts[-1])).collect()
        rows.sort(key=lambda r: (r.first_key.encode(), r.part, r.offset))
        shared = spark.sparkContext.broadcast(
            ([r.first_key.encode() for r in rows], [(r.last_key.encode(), r.file, r.offset, r.length) for r in rows])
        )
        found_here = keyed.mapInArrow(_search(archive.path, shared), _LINE)
        found = found_here if found is None else found.unionByName(found_here)
    if found is None:
        found = spark.createDataFrame([], _LINE)
    return records(archive, found)


def _search(path: str, shared):
    def run(batches):
        fs, local = file_system(path)
        files: dict = {}
        firsts, blocks = shared.value
        for batch in batches:
            lines = []
            for key in batch.column("key").to_pylist():
                want = key.encode()
                # captures of one key may begin in the block before the first that begins with it
                at = max(0, bisect.bisect_left(firsts, want) - 1)
                while at < len(firsts) and firsts[at] <= want:
                    last, f, o, n = blocks[at]
                    if last >= want:
                        lines += [x for x in _lines(_read(fs, files, f"{local}/{f}", o, n)) if x[0] == key]
                    at += 1
            yield _capture_batch(lines)

    return run
