"""WARC records in ZIP packages: written by tasks, read back by ranges.

A package holds two stored members: archive/data.warc.gz, in which each record is a gzip member of its own, and
indexes/index.cdxj, a line with offset and length for each record. The reader parses the end of the file, the central
directory and its ZIP64 fields, finds where the stored members begin, and from the index the ranges of the records;
these are spread over the cluster and read one by one, without extraction. Files are opened through pyarrow's file
systems, so packages lie wherever the shared folder is.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import math
import struct
import uuid
import zipfile
import zlib
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, many_to_one, often, shared_dir, ship, table

DATA, INDEX = "archive/data.warc.gz", "indexes/index.cdxj"
RECORDS_PER_PACKAGE = 20_000
BYTES_PER_PACKAGE = 256 << 20
DATE = "2024-01-01T00:00:00Z"
RANGE_BYTES = 1 << 20  # of a package, read by one task
TASK_BYTES = 64 << 20  # to be read by a task, about


def digest32(data: bytes) -> str:
    """The bare base32 form of SHA-1, as WARC digests have it behind "sha1:"."""
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def record_id(page_id: int | None, row: int) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page {page_id} row {row}')}>"


def warc_record(page_id, row, url, payload: bytes, refers: tuple | None) -> bytes:
    """A response record with its payload, or a revisit record that refers to (page_id, row) of another."""
    head = [("WARC-Type", "revisit" if refers else "response"), ("WARC-Record-ID", record_id(page_id, row)), ("WARC-Date", DATE), ("WARC-Payload-Digest", f"sha1:{digest32(payload)}")]
    if page_id is not None:
        head.append(("X-Page-ID", str(page_id)))
    if url:
        head.append(("WARC-Target-URI", " ".join(url.split())))
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
    if refers:
        head += [("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_id(*refers))]
        block = http + b"\r\n"
    else:
        block = http + f"Content-Length: {len(payload)}\r\n\r\n".encode() + payload
    head += [("Content-Type", "application/http;msgtype=response"), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


class Record(NamedTuple):
    headers: dict[str, str]
    block: bytes

    @property
    def payload(self) -> bytes:
        return self.block.partition(b"\r\n\r\n")[2]


def parse_record(data: bytes) -> Record:
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError(f"no WARC record: {lines[0][:40]!r}")
    headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
    return Record(headers, rest[: int(headers["content-length"])])


class Member(NamedTuple):
    name: str
    method: int
    size: int
    packed: int
    header: int


def _file(path: str):
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path)
    return system, inner


def read_directory(file, size: int) -> list[Member]:
    """The members of a ZIP file, from its end: end record, ZIP64 locator and end record if needed, central directory."""
    tail_at = max(0, size - (1 << 16) - 22 - 20)
    tail = file.read_at(size - tail_at, tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0:
        raise ValueError("no ZIP end record")
    count, length, start = struct.unpack_from("<HII", tail, at + 10)
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (end64,) = struct.unpack_from("<Q", tail, at - 12)
        count, length, start = struct.unpack_from("<QQQ", file.read_at(56, end64), 32)
    directory, out, p = file.read_at(length, start), [], 0
    for _ in range(count):
        signature, method, packed, whole, n_name, n_extra, n_note, header = struct.unpack_from("<4s6xH8xIIHHH8xI", directory, p)
        if signature != b"PK\x01\x02":
            raise ValueError("broken central directory")
        name = directory[p + 46 : p + 46 + n_name].decode("utf-8", "replace")
        extra, e = directory[p + 46 + n_name : p + 46 + n_name + n_extra], 0
        while e + 4 <= len(extra):
            kind, n = struct.unpack_from("<HH", extra, e)
            if kind == 1:  # ZIP64: those values that are full in the entry itself, in this order
                wide = iter(struct.unpack_from(f"<{n // 8}Q", extra, e + 4))
                whole = next(wide) if whole == 0xFFFFFFFF else whole
                packed = next(wide) if packed == 0xFFFFFFFF else packed
                header = next(wide) if header == 0xFFFFFFFF else header
            e += 4 + n
        out.append(Member(name, method, whole, packed, header))
        p += 46 + n_name + n_extra + n_note
    return out


def data_start(file, member: Member) -> int:
    """Where a stored member's bytes begin: behind its local header, whose name and extra field have lengths of their own."""
    signature, n_name, n_extra = struct.unpack("<4s22xHH", file.read_at(30, member.header))
    if signature != b"PK\x03\x04" or member.method != 0 or member.size != member.packed:
        raise ValueError(f"{member.name} is not a stored member")
    return member.header + 30 + n_name + n_extra


def scan_gzip(file, start: int, size: int, step: int = 1 << 20) -> Iterator[tuple[int, int]]:
    """The ranges of the gzip members of an archive that has no index."""
    at, begin, unzip = start, start, zlib.decompressobj(31)
    rest = b""
    while at < start + size or rest:
        chunk = rest or file.read_at(min(step, start + size - at), at)
        at += 0 if rest else len(chunk)
        unzip.decompress(chunk)
        rest = unzip.unused_data
        if unzip.eof:
            end = at - len(rest)
            yield begin, end - begin
            begin, unzip = end, zlib.decompressobj(31)
        else:
            rest = b""


def records_in(path: str) -> Iterator[tuple[int, int]]:
    """(offset in the package, length) of each record of each WARC member, from the indexes or, without one, by reading."""
    system, inner = _file(path)
    with system.open_input_file(inner) as file:
        members = {m.name: m for m in read_directory(file, file.size())}
        begins: dict[str, int] = {}
        for m in members.values():
            if m.name.startswith("indexes/"):
                at = data_start(file, m)
                held = file.read_at(m.size, at)
                for line in (gzip.decompress(held) if m.name.endswith(".gz") else held).decode().splitlines():
                    if "{" not in line:  # a header, or an index of another form: its archives are read through
                        continue
                    entry = json.loads(line[line.index("{") :])
                    archive = members.get(f"archive/{entry.get('filename')}")
                    if archive is None or "offset" not in entry or "length" not in entry:
                        continue
                    if archive.name not in begins:
                        begins[archive.name] = data_start(file, archive)
                    yield begins[archive.name] + int(entry["offset"]), int(entry["length"])
        for m in members.values():
            if m.name.startswith("archive/") and m.name not in begins and m.size:
                yield from scan_gzip(file, data_start(file, m), m.size)


def write_packages(pages: DataFrame, folder: str, per_package: int = RECORDS_PER_PACKAGE, per_bytes: int = BYTES_PER_PACKAGE) -> DataFrame:
    """pages: (row, page_id, url, payload binary, to_id, to_row, revisit). Writes packages into folder and returns their
    (path, records, bytes). A task that is run again writes other files; only those that are returned count."""

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs

        system, inner = fs.FileSystem.from_uri(folder)
        system.create_dir(inner, recursive=True)
        done: list[tuple[str, int]] = []
        rows = (r for b in batches for at in range(0, b.num_rows, 64) for r in b.slice(at, 64).to_pylist())
        row = next(rows, None)
        while row is not None:
            name, lines, size = f"{uuid.uuid4().hex}.zip", [], 0
            with system.open_output_stream(f"{inner}/{name}") as sink, zipfile.ZipFile(sink, "w", zipfile.ZIP_STORED) as package:
                with package.open(DATA, "w", force_zip64=True) as member:
                    while row is not None and len(lines) < per_package and size < per_bytes:
                        refers = (row["to_id"], row["to_row"]) if row["revisit"] else None
                        packed = gzip.compress(warc_record(row["page_id"], row["row"], row["url"], row["payload"], refers), 3, mtime=0)
                        member.write(packed)
                        entry = {"url": row["url"] or "", "offset": str(size), "length": str(len(packed)), "filename": "data.warc.gz"}
                        lines.append(f"{row['page_id']} 20240101000000 {json.dumps(entry)}\n")
                        size += len(packed)
                        row = next(rows, None)
                package.writestr(INDEX, "".join(lines))
            done.append((f"{folder}/{name}", len(lines), size))
        yield pa.RecordBatch.from_arrays([pa.array([d[k] for d in done], t) for k, t in enumerate((pa.string(), pa.int64(), pa.int64()))], ["path", "records", "bytes"])

    return cut(pages.mapInArrow(write, "path string, records long, bytes long"))


READ = pa.schema([("record_id", pa.string()), ("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("stated_digest", pa.string()), ("record_type", pa.string()), ("refers", pa.string())])
READ_DDL = "record_id string, page_id long, payload_bytes long, payload_digest string, stated_digest string, record_type string, refers string"


def read_packages(packages: DataFrame) -> DataFrame:
    """packages: (path, bytes). One row per record of any type, by its own name for it; of a revisit, size and digest of the
    payload are null, of what is no response (warcinfo, request, metadata and others) they are those of the whole block.
    Digests that a record doesn't state are null.

    The rows that say where records are weigh next to nothing, so the number of tasks goes by the bytes to be read.
    """

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column(0).to_pylist():
                found = list(records_in(path))
                for at in range(0, len(found), 4096):
                    part = found[at : at + 4096]
                    yield pa.RecordBatch.from_arrays([pa.array([path] * len(part)), *(pa.array([x[k] for x in part], pa.int64()) for k in (0, 1))], ["path", "offset", "length"])

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, file = None, None
        for batch in batches:
            out = []
            for where, offset, length in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if where != path:
                    system, inner = _file(where)
                    path, file = where, system.open_input_file(inner)
                record = parse_record(gzip.decompress(file.read_at(length, offset)))
                head = record.headers
                page = int(head["x-page-id"]) if "x-page-id" in head else None
                kind, name, stated = head.get("warc-type"), head.get("warc-record-id"), head.get("warc-payload-digest")
                stated = stated and stated.removeprefix("sha1:")
                if kind == "revisit":
                    out.append((name, page, None, None, stated, kind, head.get("warc-refers-to")))
                else:
                    payload = record.payload if kind == "response" else record.block
                    out.append((name, page, len(payload), digest32(payload), stated, kind, None))
            columns = zip(*out, strict=True) if out else [[] for _ in READ]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, READ, strict=True)], schema=READ)

    total = packages.agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).first()
    least = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(least, math.ceil((total.bytes or 0) / TASK_BYTES))
    found = packages.select("path").repartition(max(1, min(total.n, tasks)), "path").mapInArrow(ranges, "path string, offset long, length long")
    spread = found.repartition(tasks, "path", F.expr(f"offset div {RANGE_BYTES}")).sortWithinPartitions("path", "offset")
    return spread.mapInArrow(read, READ_DDL)


def archive(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", least_bytes: int = 0, folder: str | None = None) -> DataFrame:
    """Writes one record per row of pages, reads all packages back, and returns per record: page_id, payload_bytes,
    payload_digest, record_type, refers_to.

    Of rows with equal payloads of at least least_bytes the one with the largest id is the response (null last; among
    repeated rows the first) and the others refer to it. Null payloads are empty. Equal means equal SHA-1 and length.
    A digest that doesn't fit the payload read, or a reference to nothing, raises. An empty table writes no package.
    """
    spark = pages.sparkSession
    ship(spark)
    folder = folder or f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    payload = F.encode(F.coalesce(F.col(html_col), F.lit("")), "UTF-8")
    rows = pages.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).cast("long").alias("page_id"), F.col(url_col).cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumn("sha", F.sha1("payload")).withColumn("size", F.octet_length("payload"))
    # The smallest of (no id, -id, row) wins; it is found before anything wide is shuffled.
    rank = F.struct(F.col("page_id").isNull().alias("a"), (-F.col("page_id")).alias("b"), F.col("row").alias("c"))
    best = rows.where(F.col("size") >= least_bytes).groupBy("sha", "size").agg(F.min(rank).alias("best"), F.count("*").alias("n"))
    best = best.where("n > 1").select("sha", "size", (-F.col("best.b")).alias("to_id"), F.col("best.c").alias("to_row"))
    marked = many_to_one(rows, cut(best), ["sha", "size"], "left", often(rows, ["sha", "size"])).withColumn("revisit", F.coalesce(F.col("row") != F.col("to_row"), F.lit(False)))
    marked = marked.select("row", "page_id", "url", "payload", "to_id", "to_row", "revisit")
    read = cut(read_packages(write_packages(marked, folder)))
    own = read.select(F.col("record_id").alias("refers"), F.col("page_id").alias("refers_to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("digest")).where("size IS NOT NULL")
    both = read.join(own.join(read.where("record_type = 'revisit'").select("refers").distinct(), "refers", "left_semi"), "refers", "left")
    size, digest = F.coalesce("payload_bytes", "size"), F.coalesce("payload_digest", "digest")
    sound = digest.isNotNull() & (digest == F.col("stated_digest"))
    checked = F.when(sound, digest).otherwise(F.raise_error(F.concat(F.lit("bad digest or reference in "), F.col("record_id"))))
    return both.select("page_id", size.alias("payload_bytes"), checked.alias("payload_digest"), "record_type", "refers_to")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive(table(spark, sf_dir, "pages"))


#: DuckDB has SHA-1 in hex only: each five hex digits are four base32 ones.
OP7_SQL = """
WITH p AS (
  SELECT page_id, coalesce(html, '') AS h FROM pages
), d AS (
  SELECT page_id, octet_length(encode(h)) AS n, sha1(h) AS x, count(*) OVER (PARTITION BY h) AS c, max(page_id) OVER (PARTITION BY h) AS best FROM p
)
SELECT page_id, CAST(n AS BIGINT) AS payload_bytes,
       list_aggregate(list_transform(range(0, 8), lambda i: list_aggregate(list_transform(range(0, 4), lambda j:
         substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST((CAST('0x' || substr(x, CAST(i * 5 + 1 AS INT), 5) AS BIGINT) >> CAST(15 - 5 * j AS INT)) & 31 AS INT) + 1, 1)), 'string_agg', '')), 'string_agg', '') AS payload_digest,
       CASE WHEN page_id = best THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> best THEN best END AS refers_to
FROM d
"""
