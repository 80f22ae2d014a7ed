"""Conversion of legacy ARC archives to WARC, and both formats' readers and writers.

An ARC file is a sequence of records, each a gzip member here: a header line whose fields
depend on the file's version, the declared number of bytes, and a line feed. The first
record (filedesc) names the version. Converted records get WARC identifiers, dates,
types and digests; of several records with the same large payload one is a response
and the others are revisits of it.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from tenurelens.llm.worker import Committed, file_system, read_range
from tenurelens.sources.workspace import scratch_path, settle

#: Smaller payloads are never revisits.
REVISIT_BYTES = 1000
#: Bytes read from an archive at once.
READ_BYTES = 1 << 18

# The fields of an ARC record header, by version of the file.
ARC_FIELDS = {
    1: ["URL", "IP-address", "Archive-date", "Content-type", "Archive-length"],
    2: ["URL", "IP-address", "Archive-date", "Content-type", "Result-code", "Checksum", "Location", "Offset", "Filename", "Archive-length"],
}
IDENTICAL = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


def gzip_member(data: bytes) -> bytes:
    # zlib's gzip header carries no time, so a repeated task writes the same bytes
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def members(folder: str, name: str) -> Iterator[tuple[int, int, bytes]]:
    """(offset, compressed length, content) of each gzip member of a file, read in blocks."""
    system, base = file_system(folder)
    with system.open_input_stream(f"{base}/{name}", compression=None) as f:
        start, used, rest = 0, 0, f.read(READ_BYTES)
        while rest:
            z, content = zlib.decompressobj(31), []
            while not z.eof:
                if not rest:
                    rest = f.read(READ_BYTES)
                    if not rest:
                        raise ValueError(f"{name} ends within a record")
                content.append(z.decompress(rest))
                used += len(rest) - len(z.unused_data)
                rest = z.unused_data
            yield start, used - start, b"".join(content)
            start = used
            rest = rest or f.read(READ_BYTES)


@dataclass
class ArcRecord:
    fields: dict[str, str]
    block: bytes


def arc_version(filedesc: bytes) -> int:
    """The version in a filedesc block: the first number of its first line."""
    return int(filedesc.split(None, 1)[0])


def parse_arc(content: bytes, version: int) -> ArcRecord:
    """One ARC record. The fields are counted from the right, as an old URL may hold blanks."""
    line, _, rest = content.lstrip(b"\n").partition(b"\n")
    names = ARC_FIELDS[version]
    values = line.decode("utf-8", "replace").rsplit(" ", len(names) - 1)
    if len(values) != len(names):
        raise ValueError(f"not an ARC {version} header: {line[:200]!r}")
    fields = dict(zip(names, values, strict=True))
    length = int(fields["Archive-length"])
    if len(rest) < length:
        raise ValueError(f"declared {length} bytes, found {len(rest)}")
    return ArcRecord(fields, rest[:length])


def arc_records(folder: str, name: str) -> Iterator[tuple[int, int, ArcRecord]]:
    """(offset, length, record) of an ARC file, its filedesc first."""
    version = None
    for offset, length, content in members(folder, name):
        if version is None:
            record = parse_arc(content, 1)
            version = arc_version(record.block)
        else:
            record = parse_arc(content, version)
        yield offset, length, record


def split_http(block: bytes) -> tuple[bytes, bytes]:
    """Header (blank line included) and payload of an HTTP message; all is payload without one."""
    if not block.startswith(b"HTTP/"):
        return b"", block
    at = block.find(b"\r\n\r\n")
    return (block, b"") if at < 0 else (block[: at + 4], block[at + 4 :])


def http_fields(header: bytes) -> dict[str, str]:
    pairs = (line.partition(":") for line in header.decode("utf-8", "replace").split("\r\n")[1:])
    return {k.strip().lower(): v.strip() for k, sep, v in pairs if sep}


def warc_date(arc_date: str) -> str:
    """An ARC date of 14 digits, or its beginning, as a WARC date."""
    digits = (arc_date + "19700101000000"[len(arc_date) :])[:14]
    return f"{digits[:4]}-{digits[4:6]}-{digits[6:8]}T{digits[8:10]}:{digits[10:12]}:{digits[12:]}Z"


def record_id(name: str, offset: int) -> str:
    """The WARC identifier of a record, from the place it came from."""
    return f"urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'{name}#{offset}')}"


def sha1_label(data: bytes) -> str:
    return "sha1:" + base64.b32encode(hashlib.sha1(data).digest()).decode()


def warc_record(fields: list[tuple[str, str]], block: bytes) -> bytes:
    lines = [*fields, ("WARC-Block-Digest", sha1_label(block)), ("Content-Length", str(len(block)))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return b"WARC/1.0\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def parse_warc(content: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise ValueError(f"not a WARC record: {version[:100]!r}")
    fields = {k.lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    return fields, rest[: int(fields["content-length"])]


def _http_message(key: int | None, payload: bytes) -> bytes:
    marked = "" if key is None else f"X-Page-Id: {key}\r\n"
    head = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n{marked}Content-Length: {len(payload)}\r\n\r\n"
    return head.encode() + payload


def _write_arc(folder: str, versions: tuple[int, ...], date: str):
    def header(version: int, url: str, kind: str, length: int, name: str, offset: int) -> bytes:
        values = [url, "0.0.0.0", date, kind, "200", "-", "-", str(offset), name, str(length)]
        return (" ".join(values if version == 2 else [*values[:4], values[-1]]) + "\n").encode()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task, out, n = TaskContext.get(), None, 0
        name = f"pages-{task.partitionId():06d}.arc.gz"
        version = versions[task.partitionId() % len(versions)]
        for batch in batches:
            for key, url, html in zip(*(batch[c].to_pylist() for c in ("page_id", "url", "html")), strict=True):
                if out is None:
                    out = Committed(folder, name, task.taskAttemptId())
                    block = f"{version} 0 tenurelens\n{' '.join(ARC_FIELDS[version])}\n".encode()
                    first = f"filedesc://{name} 0.0.0.0 {date} text/plain {len(block)}\n".encode()
                    out.write(gzip_member(first + block + b"\n"))
                block = _http_message(key, (html or "").encode("utf-8", "surrogatepass"))
                place = "".join(c if c > " " else f"%{ord(c):02X}" for c in url or "unknown:")
                out.write(gzip_member(header(version, place, "text/html", len(block), name, out.at) + block + b"\n"))
                n += 1
        if out:
            out.commit()
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    return run


def write_arc(pages: DataFrame, folder: str, versions: tuple[int, ...] = (1, 2), date: str = "20000101000000") -> DataFrame:
    """Writes ``pages`` (page_id, url, html) as ARC files, one per input partition; returns (file, records).

    Files take the versions in turn. NULL html is an empty payload, a NULL url
    ``unknown:``, and a NULL page_id is not written.
    """
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html")
    return settle(rows.mapInArrow(_write_arc(folder, versions, date), "file string, records long"), "arc-files")


_RECORD = "file string, at long, length long, record_id string, key long, payload_bytes long, payload_digest string"


def _scan(folder: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows: list[list] = [[] for _ in range(7)]
                for at, length, record in arc_records(folder, name):
                    if record.fields["URL"].startswith("filedesc:"):
                        continue
                    head, payload = split_http(record.block)
                    key = http_fields(head).get("x-page-id")
                    found = [name, at, length, record_id(name, at), None if key is None else int(key), len(payload), hashlib.sha1(payload).hexdigest()]
                    for column, value in zip(rows, found, strict=True):
                        column.append(value)
                kinds = [pa.string(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [x.split()[0] for x in _RECORD.split(", ")])

    return run


def _convert(arc_folder: str, warc_folder: str):
    def convert(out: Committed, arc: str, row: dict) -> None:
        content = next(iter_member(read_range(arc_folder, arc, row["at"], row["length"])))
        version = versions[arc]
        record = parse_arc(content, version)
        head, _ = split_http(record.block)
        http = bool(head)
        fields = [
            ("WARC-Type", "revisit" if row["refers_to"] else "response" if http else "resource"),
            ("WARC-Record-ID", f"<{row['record_id']}>"),
            ("WARC-Date", warc_date(record.fields["Archive-date"])),
            ("WARC-Target-URI", record.fields["URL"]),
            ("WARC-IP-Address", record.fields["IP-address"]),
            ("WARC-Payload-Digest", "sha1:" + base64.b32encode(bytes.fromhex(row["payload_digest"])).decode()),
        ]
        if row["refers_to"]:
            fields += [("WARC-Refers-To", f"<{row['refers_to']}>"), ("WARC-Profile", IDENTICAL)]
        fields.append(("Content-Type", "application/http; msgtype=response" if http else record.fields["Content-type"]))
        if row["refers_to"] and not http:
            fields.append(("X-Payload-Length", str(row["payload_bytes"])))
        out.write(gzip_member(warc_record(fields, head if row["refers_to"] else record.block)))

    def iter_member(data: bytes):
        yield zlib.decompress(data, 31)

    versions: dict[str, int] = {}

    def begin(arc: str, attempt: int) -> Committed:
        _, _, first = next(arc_records(arc_folder, arc))
        versions[arc] = arc_version(first.block)
        name = arc.removesuffix(".arc.gz") + ".warc.gz"
        out = Committed(warc_folder, name, attempt)
        info = f"software: tenurelens\r\nformat: WARC File Format 1.0\r\nconverted-from: {arc}\r\n".encode()
        fields = [
            ("WARC-Type", "warcinfo"),
            ("WARC-Record-ID", f"<{record_id(arc, 0)}>"),
            ("WARC-Date", warc_date(first.fields["Archive-date"])),
            ("WARC-Filename", name),
            ("Content-Type", "application/warc-fields"),
        ]
        out.write(gzip_member(warc_record(fields, info)))
        return out

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, arc, out, n = TaskContext.get().taskAttemptId(), None, None, 0

        def end():
            out.commit()
            return pa.RecordBatch.from_arrays([pa.array([arc.removesuffix(".arc.gz") + ".warc.gz"]), pa.array([n], pa.int64())], ["file", "records"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["file"] != arc:
                    if out:
                        yield end()
                    arc, n = row["file"], 0
                    out = begin(arc, attempt)
                convert(out, arc, row)
                n += 1
        if out:
            yield end()

    return run


def _larger(key: Column) -> Column:
    """Orders records by key, NULL least, then by place."""
    return F.struct(key.isNotNull(), key, F.col("file"), F.col("at"), F.col("record_id"))


def _spread(files: DataFrame) -> tuple[DataFrame, int]:
    """One archive to a task, and their number: the few bytes of a name say nothing about the archive behind it."""
    number = max(1, files.count())
    return files.select("file").repartition(number), number


def convert_arc(files: DataFrame, arc_folder: str, warc_folder: str, revisit_bytes: int = REVISIT_BYTES) -> DataFrame:
    """Converts the ARC files of ``files`` (file) to WARC files; returns (file, records).

    Of records with equal payloads of ``revisit_bytes`` or more, the one with the largest key
    (the X-Page-Id of its HTTP header, NULL least; then the last place) is a response and the
    others revisit it. First the records' digests are gathered, without payloads; then
    each file is read again by the offsets of its records and written in order.
    """
    spread, number = _spread(files)
    records = settle(spread.mapInArrow(_scan(arc_folder), _RECORD), "arc-records")
    same = ["payload_digest", "payload_bytes"]
    originals = (
        records.where(F.col("payload_bytes") >= revisit_bytes)
        .groupBy(*same)
        .agg(F.max(_larger(F.col("key"))).alias("last"), F.count("*").alias("n"))
        .where("n > 1")
        .select(*same, F.col("last.record_id").alias("original"))
    )
    refers = F.when(F.col("original") != F.col("record_id"), F.col("original")).alias("refers_to")
    decided = records.join(originals, same, "left").select(records.columns + [refers])
    ordered = decided.repartition(number, "file").sortWithinPartitions("file", "at")
    return settle(ordered.mapInArrow(_convert(arc_folder, warc_folder), "file string, records long"), "warc-files")


_READ = "record_id string, record_type string, url string, key long, payload_bytes long, payload_digest string, refers_to_id string"


def _read_warc(folder: str):
    def bare(x: str | None) -> str | None:
        return x and x.strip("<>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name in batch["file"].to_pylist():
                rows: list[list] = [[] for _ in range(7)]
                for _, _, content in members(folder, name):
                    fields, block = parse_warc(content)
                    if fields["warc-type"] == "warcinfo":
                        continue
                    head, payload = split_http(block) if fields["content-type"].startswith("application/http") else (b"", block)
                    sent = http_fields(head)
                    if fields["warc-type"] == "revisit":
                        size = int(sent.get("content-length") or fields["x-payload-length"])
                        digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
                    else:
                        size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                    key = sent.get("x-page-id")
                    found = [bare(fields["warc-record-id"]), fields["warc-type"], fields["warc-target-uri"], None if key is None else int(key), size, digest, bare(fields.get("warc-refers-to"))]
                    for column, value in zip(rows, found, strict=True):
                        column.append(value)
                kinds = [pa.string(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(rows, kinds, strict=True)], [x.split()[0] for x in _READ.split(", ")])

    return run


def read_warc(files: DataFrame, folder: str) -> DataFrame:
    """One row per record of the WARC files of ``files`` (file), warcinfo left out, with the key of what it refers to."""
    spread, _ = _spread(files)
    records = settle(spread.mapInArrow(_read_warc(folder), _READ), "warc-records")
    originals = records.where("record_type <> 'revisit'").select(F.col("record_id").alias("refers_to_id"), F.col("key").alias("refers_to"))
    revisits = records.where("record_type = 'revisit'").join(originals, "refers_to_id", "left")
    return records.where("record_type <> 'revisit'").withColumn("refers_to", F.lit(None).cast("long")).unionByName(revisits)


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """``pages`` written as ARC, converted to WARC and read back."""
    arc, warc = scratch_path(spark, "arc"), scratch_path(spark, "warc")
    return read_warc(convert_arc(write_arc(pages, arc), arc, warc), warc)


def query(spark, sf_dir: str) -> DataFrame:
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet")
    found = round_trip(spark, pages).withColumnRenamed("key", "page_id")
    return found.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
with digests as (
  select page_id, octet_length(encode(coalesce(html, '')))::bigint as payload_bytes, sha1(coalesce(html, '')) as payload_digest from pages
), last as (
  select *, max(page_id) over (partition by payload_digest, payload_bytes) as original from digests
)
select page_id, payload_bytes, payload_digest,
  case when payload_bytes >= 1000 and original <> page_id then 'revisit' else 'response' end as record_type,
  case when payload_bytes >= 1000 and original <> page_id then original end as refers_to
from last
"""
