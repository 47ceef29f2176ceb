"""WARC archives with a two-level capture index.

Writing. Each task writes the pages that it reads to an archive of its own in the shared folder, a gzip member
per record, and returns a capture line per record: key (URL with reversed host), archive, offset, length. An
archive's name holds a fresh id, so a task that runs again after an executor is lost writes another archive,
and only the archive whose lines arrive is ever read. Whether a record is a response or a revisit follows from
the digests that occur more than once; they are broadcast where they measure under the bound.

Index. Capture lines are range-sorted by key (ties by id, so that a host with a third of all pages spreads) and
packed into compressed blocks of ``BLOCK_LINES`` lines. An index file holds ``FILE_LINES`` lines at most and ends
with its sparse directory: first and last key, offset and length of each block. What a reader holds in memory is a
line per file (its key range and where its directory lies): a millionth of the captures.

Looking up. Keys are searched by bisection among the files, then in a file's directory, which is range-read once;
each of the one or few blocks in range is range-read, searched by bisection for the key's lines, and the lines'
records are range-read. :class:`CaptureIndex` does so for one URL; :func:`look_up` for a table of keys, in three
Spark stages: sorted keys find their blocks, blocks give their lines, and archives are read in order of offset. A key
with a third of all captures spreads over tasks by its blocks.

Defined results: null payloads are empty; null URLs have the empty key; empty or equal payloads make revisits
as others do, from ``least`` bytes on; of equal payloads, all records of the smallest id are responses, and where all
ids are null, all records; repeated page ids get a record each, whatever their payloads; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import base64
import bisect
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .runtime import batches_of, if_small, materialize, new_path

BLOCK_LINES = 256
FILE_LINES = 1 << 20
ROLL_BYTES = 256 << 20  # an archive's size, about; then the task goes on with another
DATE = "2024-01-01T00:00:00Z"
LEVEL = 5
CAPTURES = "key string, page_id long, url string, archive string, offset long, length long"
FILES = "first string, last string, file string, offset long, length long"


def surt(url: str | None) -> str:
    """Sort key of a URL: host labels reversed, then path and query, lower-cased host, without scheme and fragment."""
    if not url:
        return ""
    try:
        u = urlsplit(url)
        host, port = (u.hostname or ""), u.port
    except ValueError:
        return url
    if not host:
        return url
    query = f"?{u.query}" if u.query else ""
    return ",".join(reversed(host.split("."))) + (f":{port}" if port else "") + ")" + (u.path or "/") + query


def store(path: str):
    """pyarrow's file system for a folder's URI, and the folder's path there."""
    from pyarrow import fs

    if ":" not in path.split("/")[0]:
        return fs.LocalFileSystem(), path
    return fs.FileSystem.from_uri(path.replace("file:///", "/") if path.startswith("file:///") else path)


def digest_of(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: int | None, digest: str, place: str = "") -> str:
    """The id of a response follows from page and payload, so that revisits can name it; ``place`` sets others apart."""
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}:{digest}:{place}')}>"


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, place: str = "") -> bytes:
    """One WARC/1.1 record as a gzip member: an HTTP response, or a revisit without payload."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    revisit, digest = refers_to is not None, digest_of(payload)
    block = http if revisit else http + payload
    head = [
        "WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: {record_id(page_id, digest, place if revisit or page_id is None else '')}", f"WARC-Date: {DATE}",
        f"WARC-Target-URI: {json.dumps(url or '')[1:-1]}", f"WARC-Page-ID: {'' if page_id is None else page_id}", f"WARC-Payload-Digest: sha1:{digest}",
    ]
    if revisit:
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to, digest)}", f"WARC-Refers-To-Page-ID: {refers_to}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n", LEVEL, mtime=0)


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    """Headers and payload of a record's gzip member."""
    head, _, rest = gzip.decompress(member).partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError("not a WARC record")
    fields = dict(x.split(": ", 1) if ": " in x else (x.rstrip(":"), "") for x in lines)
    block = rest[: int(fields["Content-Length"])]
    return fields, block.partition(b"\r\n\r\n")[2]


def write(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes archives into ``folder`` (shared); capture rows as in ``CAPTURES``, materialized."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").alias("url"), html.alias("html"), F.when(F.octet_length(html) >= least, F.sha1(html.cast("binary"))).alias("h"))
    groups = rows.where("h is not null").groupBy("h").agg(F.min("page_id").alias("first"), F.count("*").alias("c")).where("c > 1 and first is not null").select(F.col("h").alias("again"), "first")
    groups = if_small(materialize(groups, "warc-groups"), 64)
    rows = rows.join(groups, F.col("h") == F.col("again"), "left")
    rows = rows.select("page_id", "url", "html", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first")).alias("first"))

    def put(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        out, name, at = None, "", 0
        try:
            for batch in batches:
                lines = []
                for page_id, url, html, first in batch.astype(object).itertuples(index=False):
                    page_id = None if pd.isna(page_id) else int(page_id)
                    url = url if isinstance(url, str) else None
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name, at = f"{uuid.uuid4().hex}.warc.gz", 0
                        out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
                    member = record(page_id, url, html.encode(), None if pd.isna(first) else int(first), f"{name}:{at}")
                    out.write(member)
                    lines.append((surt(url), page_id, url, name, at, len(member)))
                    at += len(member)
                frame = pd.DataFrame(lines, columns=["key", "page_id", "url", "archive", "offset", "length"])
                yield frame.astype({"page_id": "Int64"})
        finally:
            if out is not None:
                out.close()

    with batches_of(pages.sparkSession, 64):
        return materialize(rows.mapInPandas(put, CAPTURES), "warc-captures")


def build_index(captures: DataFrame, folder: str) -> DataFrame:
    """Sorts capture lines into index files in ``folder``; a row per file as in ``FILES``, materialized."""
    spark = captures.sparkSession
    # Partitions of even size by key, then id; offsets break further ties.
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ordered = captures.repartitionByRange(parts, "key", "page_id", "archive", "offset").sortWithinPartitions("key", "page_id", "archive", "offset")

    def pack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        fs, base = store(folder)
        fs.create_dir(base, recursive=True)
        out, name, at, held, directory = None, "", 0, [], []

        def put(rows: list) -> int:
            """Writes compressed lines; how many bytes they take."""
            nonlocal out, name, at
            if out is None:
                name, at = f"{uuid.uuid4().hex}.cdx.z", 0
                out = fs.open_output_stream(f"{base}/{name}", compression=None, buffer_size=1 << 20)
            data = zlib.compress("\n".join(json.dumps(x, ensure_ascii=False, separators=(",", ":")) for x in rows).encode(), 6)
            out.write(data)
            at += len(data)
            return len(data)

        def block() -> None:
            n = put(held)
            directory.append((held[0][0], held[-1][0], at - n, n))
            held.clear()

        def finish() -> pd.DataFrame:
            nonlocal out
            if held:
                block()
            n = put(directory)
            row = (directory[0][0], directory[-1][1], name, at - n, n)
            directory.clear()
            out.close()
            out = None
            return pd.DataFrame([row], columns=["first", "last", "file", "offset", "length"])

        try:
            for batch in batches:
                for key, page_id, url, archive, offset, length in batch.astype(object).itertuples(index=False):
                    held.append((key, None if pd.isna(page_id) else int(page_id), url if isinstance(url, str) else None, archive, int(offset), int(length)))
                    if len(held) == BLOCK_LINES:
                        block()
                        if len(directory) * BLOCK_LINES >= FILE_LINES:
                            yield finish()
            if held or directory:
                yield finish()
        finally:
            if out is not None:
                out.close()

    return materialize(ordered.mapInPandas(pack, FILES), "warc-files")


def read_lines(fs, base: str, file: str, offset: int, length: int) -> list[list]:
    """Lines of a block or of a file's directory, by a range read."""
    with fs.open_input_file(f"{base}/{file}") as f:
        data = f.read_at(length, offset)
    return [json.loads(x) for x in zlib.decompress(data).decode().split("\n")]


def in_range(spans: list, key: str) -> Iterator:
    """Of spans (first, last, ...) in order of keys, those that can hold the key; found by bisection."""
    k = bisect.bisect_left(spans, key, key=lambda r: r[1])
    while k < len(spans) and spans[k][0] <= key:
        yield spans[k]
        k += 1


def of_key(lines: list, key: str) -> list:
    """A key's lines in a block, by bisection."""
    return lines[bisect.bisect_left(lines, key, key=lambda x: x[0]) : bisect.bisect_right(lines, key, key=lambda x: x[0])]


class Directory:
    """The files' key ranges, and the sparse directory of the file last asked for."""

    def __init__(self, files: list[tuple], folder: str):
        self.files = files
        (self.fs, self.base), self.name, self.blocks, self.reads = store(folder), None, [], 0

    def find(self, key: str) -> Iterator[tuple[str, int, int]]:
        """Where the blocks lie that can hold the key: file, offset, length."""
        for _, _, file, offset, length in in_range(self.files, key):
            if file != self.name:
                self.name, self.blocks = file, read_lines(self.fs, self.base, file, offset, length)
                self.reads += 1
            for _, _, at, n in in_range(self.blocks, key):
                yield file, at, n


def file_list(files: DataFrame) -> list[tuple]:
    """The index files in order of keys: a row per million captures, or per task that wrote the index."""
    return sorted(tuple(r) for r in files.select("first", "last", "file", "offset", "length").collect())


class CaptureIndex:
    """Lookups of single URLs over a written index: a row per file in memory, everything else by range reads."""

    def __init__(self, files: DataFrame, index_folder: str, archive_folder: str):
        self.directory = Directory(file_list(files), index_folder)
        self.fs, self.base = store(archive_folder)

    def captures(self, url: str) -> list[list]:
        """Lines of a URL's captures."""
        key, d = surt(url), self.directory
        return [line for place in d.find(key) for line in of_key(read_lines(d.fs, d.base, *place), key)]

    def records(self, url: str) -> list[tuple[dict[str, str], bytes]]:
        out = []
        for line in self.captures(url):
            with self.fs.open_input_file(f"{self.base}/{line[3]}") as f:
                out.append(parse(f.read_at(line[5], line[4])))
        return out


READ = "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long"
STRIPE = 64 << 20  # bytes of an archive that one task reads in order


def look_up(keys: DataFrame, files: DataFrame, index_folder: str) -> DataFrame:
    """Captures of a table of keys (column ``key``, without repeats): url, archive, offset, length."""
    spark = keys.sparkSession
    parts, listed = max(1, int(spark.conf.get("spark.sql.shuffle.partitions"))), file_list(files)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        d = Directory(listed, index_folder)
        for batch in batches:
            yield pd.DataFrame([(key, *place) for key in batch["key"] for place in d.find(key)], columns=["key", "file", "offset", "length"])

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, base), held, block = store(index_folder), None, []
        for batch in batches:
            rows = []
            for key, *place in batch.itertuples(index=False):
                if place != held:
                    held, block = place, read_lines(fs, base, *place)
                rows += [x[2:] for x in of_key(block, key)]
            yield pd.DataFrame(rows, columns=["url", "archive", "offset", "length"])

    placed = keys.repartitionByRange(parts, "key").sortWithinPartitions("key").mapInPandas(blocks, "key string, file string, offset long, length long")
    dealt = placed.repartition(parts, "file", "offset").sortWithinPartitions("file", "offset", "key")
    return dealt.mapInPandas(lines, "url string, archive string, offset long, length long")


def read_records(captures: DataFrame, archive_folder: str) -> DataFrame:
    """A row per captured record as in ``READ``; archives are read in order of offset, a revisit's bytes are left out."""
    parts = max(1, int(captures.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = captures.repartition(parts, F.col("archive"), F.floor(F.col("offset") / STRIPE)).sortWithinPartitions("archive", "offset")

    def get(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        (fs, base), opened, name = store(archive_folder), None, None
        try:
            for batch in batches:
                rows = []
                for url, archive, at, n in batch.astype(object).itertuples(index=False):
                    if archive != name:
                        if opened is not None:
                            opened.close()
                        opened, name = fs.open_input_file(f"{base}/{archive}"), archive
                    fields, payload = parse(opened.read_at(n, at))
                    kind, digest = fields["WARC-Type"], fields["WARC-Payload-Digest"].removeprefix("sha1:")
                    if kind == "response" and digest_of(payload) != digest:
                        raise ValueError(f"payload of {url} differs from its digest")
                    own, to = fields["WARC-Page-ID"], fields.get("WARC-Refers-To-Page-ID")
                    rows.append((int(own) if own else None, url if isinstance(url, str) else None, kind, len(payload) if kind == "response" else None, digest, int(to) if to else None))
                frame = pd.DataFrame(rows, columns=["page_id", "url", "record_type", "payload_bytes", "payload_digest", "refers_to"])
                yield frame.astype({"page_id": "Int64", "payload_bytes": "Int64", "refers_to": "Int64"})
        finally:
            if opened is not None:
                opened.close()

    return dealt.mapInPandas(get, READ)


def archive_and_read(pages: DataFrame, least: int = 0) -> DataFrame:
    """Writes archives and index, looks up every page's URL: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    spark: SparkSession = pages.sparkSession
    archives, index = new_path(spark, "warc-archives"), new_path(spark, "warc-index")
    captures = write(pages, archives, least)
    files = build_index(captures, index)
    found = look_up(captures.select("key").distinct(), files, index)
    with batches_of(spark, 256):
        rows = materialize(read_records(found, archives), "warc-read")
    # A revisit's payload is its response's.
    again = rows.where("refers_to is not null").select("payload_digest").distinct()
    sizes = rows.where("record_type = 'response'").join(again, "payload_digest", "left_semi").select(F.col("payload_digest").alias("to_digest"), F.col("payload_bytes").alias("to_bytes")).distinct()
    out = rows.join(if_small(materialize(sizes, "warc-sizes"), 48), rows["payload_digest"] == F.col("to_digest"), "left")
    return out.select("page_id", F.coalesce("payload_bytes", "to_bytes").alias("payload_bytes"), "payload_digest", "record_type", "refers_to")
