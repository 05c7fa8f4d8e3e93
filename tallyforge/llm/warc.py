"""WARC archives: a writer, and a splittable reader that finds records by their gzip members."""

from __future__ import annotations

import posixpath
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialise, new_path

MAGIC = b"\x1f\x8b\x08"
RECORDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"
BLOCK = 1 << 20


def base32_sha1(data: bytes) -> str:
    import base64
    import hashlib

    return base64.b32encode(hashlib.sha1(data, usedforsecurity=False).digest()).decode()


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One gzip member with one WARC 1.1 record. A revisit carries the headers only; the payload's length goes with it."""
    import gzip
    import uuid

    def name(i: int | None) -> str:
        return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{i}')}>"

    body = b"" if revisit else payload
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {name(page_id)}", "WARC-Date: 1970-01-01T00:00:00Z"]
    if url is not None:
        from urllib.parse import quote

        head.append("WARC-Target-URI: " + quote(url, safe=";/?:@&=+$,#[]!~*'()"))
    if page_id is not None:
        head.append(f"X-Page-ID: {page_id}")
    if revisit:
        head += [f"WARC-Refers-To: {name(refers_to)}", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
        if refers_to is not None:
            head.append(f"X-Refers-To-Page-ID: {refers_to}")
    head += [f"WARC-Payload-Digest: sha1:{digest}", f"X-Payload-Length: {len(payload)}", "Content-Type: application/octet-stream", f"Content-Length: {len(body)}"]
    return gzip.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n", 6, mtime=0)


def _write(batches: Iterator[pa.RecordBatch], folder: str) -> Iterator[pa.RecordBatch]:
    """Stream a task's records into one file; it gets its final name when it is complete, so a repeated task replaces it."""
    import base64

    from pyarrow import fs
    from pyspark import TaskContext

    files, root = fs.FileSystem.from_uri(folder)
    task = TaskContext.get()
    final = posixpath.join(root, f"part-{task.partitionId():06d}.warc.gz")
    draft = posixpath.join(root, f"_draft-{task.partitionId():06d}-{task.taskAttemptId()}")
    files.create_dir(root, recursive=True)
    n, size, out = 0, 0, None
    for batch in batches:
        for page, url, payload, digest, first in zip(*(batch.column(i).to_pylist() for i in range(5))):
            if out is None:
                out = files.open_output_stream(draft)
            revisit = first["known"] and not first["own"]
            data = record(page, url, payload, base64.b32encode(digest).decode(), first["page_id"], revisit)
            out.write(data)
            n, size = n + 1, size + len(data)
    if out is not None:
        out.close()
        files.move(draft, final)
    yield pa.RecordBatch.from_arrays([pa.array([final] if n else [], pa.string()), pa.array([n] if n else [], pa.int64()), pa.array([size] if n else [], pa.int64())], ["file", "records", "bytes"])


def write_archives(pages: DataFrame, folder: str | None = None, least: int = 0, salts: int = 16, broadcast_rows: int = 500_000) -> tuple[str, list[tuple[str, int, int]]]:
    """Write a record for each row of pages (page_id, url, html) below folder (a shared one of our own if None).

    Of equal payloads of `least` bytes or more, the record with the smallest page_id is the response and others revisit
    it; of rows that repeat in full one is the response. A null page_id comes after all others (of several, by a hash of the
    url); a null html is an empty payload, a null url leaves out the target. Only digests that occur more than once are joined back:
    by broadcast if a count shows no more than `broadcast_rows` of them, so that payloads stay where they are read; else
    by a shuffle, each in `salts` copies so that no group of copies meets in one task. Gives (folder, [(file, records, bytes)]); the list
    has a row for each task. Folder must be on a file system that pyarrow opens, the same for driver and executors.
    """
    spark = pages.sparkSession
    folder = folder or new_path(spark, "warc")
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("digest", F.unhex(F.sha1("payload")))


    def copied(rows: DataFrame) -> DataFrame:
        """(twin, first, same): digests that occur more than once, the smallest rank of theirs and how many rows share it."""
        ranks = rows.filter(F.length("payload") >= least).groupBy("digest", "rank").agg(F.count("*").alias("n"))
        found = ranks.groupBy(F.col("digest").alias("twin")).agg(F.min(F.struct("rank", "n")).alias("x"), F.sum("n").alias("n")).filter("n > 1")
        return materialise(found.select("twin", F.col("x.rank").alias("first"), F.col("x.n").alias("same")), "copies")

    order = [F.col("page_id").isNull().alias("last"), F.col("page_id").alias("page_id"), F.xxhash64("url").alias("tie")]
    rows = rows.withColumn("rank", F.struct(*order, F.lit(0).cast("long").alias("row")))
    copies = copied(rows)
    if not copies.filter("same > 1").isEmpty():  # rows that repeat in full: written with numbers, so that one of them comes first
        rows = materialise(rows.withColumn("rank", F.struct(*order, F.monotonically_increasing_id().alias("row"))), "numbered")
        copies = copied(rows)
    same = (F.col("digest") == F.col("twin")) & (F.length("payload") >= least)
    rows = rows.withColumnRenamed("rank", "own_rank")
    copies = copies.drop("same")
    if copies.count() <= broadcast_rows:
        joined = rows.join(F.broadcast(copies), same, "left")
    else:
        salted = copies.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = rows.withColumn("own_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(salts)).cast("int")).join(salted, same & (F.col("own_salt") == F.col("salt")), "left")
    first = F.struct(F.col("first").isNotNull().alias("known"), F.coalesce(F.col("own_rank") == F.col("first"), F.lit(True)).alias("own"), F.col("first.page_id").alias("page_id"))
    made = joined.select("page_id", "url", "payload", "digest", first.alias("first")).mapInArrow(lambda it: _write(it, folder), "file string, records long, bytes long").collect()
    return folder, [(r["file"], r["records"], r["bytes"]) for r in made]


class _Source:
    """Bytes of a file from any place on, read in blocks."""

    def __init__(self, handle, size: int):
        self.handle, self.size, self.start, self.data = handle, size, 0, b""

    def at(self, place: int, n: int) -> bytes:
        """Up to n bytes from `place`, fewer at the file's end only."""
        if not (self.start <= place and place + n <= self.start + len(self.data)):
            self.handle.seek(place)
            self.start, self.data = place, self.handle.read(max(n, BLOCK))
        return self.data[place - self.start : place - self.start + n]


class Broken(NamedTuple):
    """A member that begins as a record and can't be decoded to its end."""

    place: int
    reason: str


def member(source: _Source, place: int) -> tuple[bytes, int] | Broken | None:
    """(content, end) of the gzip member at `place` if it holds a WARC record; Broken if it begins as one but ends early or
    fails its checksum; None if it is no record.

    The headers are decoded first, so a chance match of the magic bytes costs little; then all of it is, with its checksum.
    """
    import zlib

    try:
        if zlib.decompressobj(31).decompress(source.at(place, 65536), 5) != b"WARC/":
            return None
    except zlib.error:
        return None
    inflate, parts, at, reason = zlib.decompressobj(31), [], place, ""
    try:
        while not inflate.eof:
            data = source.at(at, 65536)
            if not data:
                return Broken(place, "the file ends within the record")
            at += len(data)
            parts.append(inflate.decompress(data))
    except zlib.error as error:
        reason = str(error)
    content = b"".join(parts)
    if reason or b"\r\n\r\n" not in content:
        return Broken(place, reason or "the record has no end of headers")
    return content, at - len(inflate.unused_data)


def records_in(source: _Source, begin: int, end: int) -> Iterator[bytes | Broken]:
    """Contents of the members with records that start in [begin, end), and those that are broken.

    A member is a record's if its header and checksum say so; whatever stands between members, padding or other data, is
    passed over. After a whole member the search goes on at its end, after a broken one right behind its first byte.
    """
    place = begin
    while place < end:
        data = source.at(place, min(BLOCK, end - place) + len(MAGIC) - 1)
        hit = data.find(MAGIC)
        if hit < 0:
            place += max(1, len(data) - len(MAGIC) + 1)
            if len(data) < len(MAGIC):
                return
            continue
        place += hit
        if place >= end:
            return
        found = member(source, place)
        if isinstance(found, Broken):
            yield found
        elif found:
            yield found[0]
        place = found[1] if found and not isinstance(found, Broken) else place + 1


def headers(head: bytes) -> dict[str, str]:
    """Fields of a record's head by their names in small letters; a line that begins with white space goes on with the one before."""
    out: dict[str, str] = {}
    name = ""
    for line in head.decode("utf-8", "replace").split("\r\n")[1:]:
        if line[:1] in (" ", "\t") and name:
            out[name] += " " + line.strip()
        elif ":" in line:
            name, _, value = line.partition(":")
            name = name.strip().lower()
            out.setdefault(name, value.strip())
    return out


def payload_of(fields: dict[str, str], block: bytes) -> bytes:
    """What a record's block carries: of an HTTP message what comes after its own headers, else all of it."""
    if fields.get("content-type", "").lower().startswith("application/http") and b"\r\n\r\n" in block:
        return block.partition(b"\r\n\r\n")[2]
    return block


def parse(content: bytes) -> Iterator[tuple]:
    """Rows of the records in a member, one as a rule."""
    from urllib.parse import unquote

    while content.startswith(b"WARC/"):
        head, _, rest = content.partition(b"\r\n\r\n")
        fields = headers(head)
        length = fields.get("content-length", "")
        block = rest[: int(length)] if length.isdigit() else rest
        content = rest[len(block) :].lstrip(b"\r\n")
        kind, own = fields.get("warc-type", "").lower() or None, "x-payload-length" in fields
        payload = None if kind == "revisit" else payload_of(fields, block)
        told = fields.get("warc-payload-digest", "")
        digest = told.partition(":")[2].upper() if told.lower().startswith("sha1:") else None
        error = None
        if not length.isdigit() or len(block) < int(length):
            error = "the record is shorter than its length"
        elif payload is not None:
            made = base32_sha1(payload)
            if digest not in (None, made, base32_sha1(block)) or own and len(payload) != int(fields["x-payload-length"]):
                error = "the payload doesn't fit its digest"
            digest = digest or made
        size = int(fields["x-payload-length"]) if own else None if payload is None else len(payload)
        url = fields.get("warc-target-uri")
        url = url if url is None else unquote(url) if own else url.removeprefix("<").removesuffix(">")
        number = lambda name: int(fields[name]) if fields.get(name, "").lstrip("-").isdigit() else None
        yield number("x-page-id"), url, size, digest, kind, number("x-refers-to-page-id"), payload, error


def _read(batches: Iterator[pa.RecordBatch], folder: str, rows: int) -> Iterator[pa.RecordBatch]:
    from pyarrow import fs

    files, _ = fs.FileSystem.from_uri(folder)
    types = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
    names = [x.split()[0] for x in RECORDS.split(", ")]

    def batch_of(held: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*held) if held else [()] * len(names), types)], names)

    for batch in batches:
        for file, begin, end, size in zip(*(batch.column(i).to_pylist() for i in range(4))):
            with files.open_input_file(file) as handle:
                held, weight = [], 0
                for content in records_in(_Source(handle, size), begin, end):
                    if isinstance(content, Broken):
                        held.append((*[None] * 7, f"{file} at {content.place}: {content.reason}"))
                        continue
                    held += [(*r[:7], r[7] and f"{file}: {r[7]} ({r[1]})") for r in parse(content)]
                    weight += len(content)
                    if len(held) >= rows or weight > 16 << 20:
                        yield batch_of(held)
                        held, weight = [], 0
                yield batch_of(held)


def read_archives(spark: SparkSession, folder: str, files: list[tuple[str, int]], split_bytes: int = 8 << 20, broken: str = "raise") -> DataFrame:
    """Records of archives [(file, bytes)]: (page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload, error).

    Each task scans a byte range of `split_bytes` for gzip members, and has the records that start in it, so a large
    archive is read by many tasks and every record by one. Archives of any writer are read: field names in any case, records
    of all types (warcinfo, request, metadata and others), without digests (they are worked out) or page ids (null), several in
    a member, with padding or other data between members. A revisit's payload is null. A member that begins as a record
    and is cut short or damaged, and a payload that doesn't fit its digest, fail the job, or with broken="row" are rows
    that say so in `error`. Other members than records are passed over. No file gives no row.
    """
    known = spark.createDataFrame(files, "file string, size long")
    begins = F.explode(F.when(F.col("size") > 0, F.sequence(F.lit(0).cast("long"), F.col("size") - 1, F.lit(split_bytes).cast("long"))))
    ranges = known.withColumn("begin", begins).select("file", "begin", F.least(F.col("begin") + split_bytes, F.col("size")).alias("stop"), "size")
    n = sum(-(-size // split_bytes) for _, size in files)
    dealt = ranges.repartition(max(1, min(n, 10_000)), "file", "begin")
    out = dealt.mapInArrow(lambda it: _read(it, folder, 1000), RECORDS)
    if broken == "row":
        return out
    checked = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(F.col("error")).cast("string"))
    return out.withColumn("record_type", checked)


def round_trip(pages: DataFrame, folder: str | None = None, least: int = 0, split_bytes: int = 8 << 20) -> DataFrame:
    """Write pages as archives and read them back."""
    folder, made = write_archives(pages, folder, least)
    return read_archives(pages.sparkSession, folder, [(f, size) for f, _, size in made], split_bytes)
