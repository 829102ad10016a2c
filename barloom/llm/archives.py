"""Web archives in ZIP packages: records and their index as stored members, read back by byte ranges.

`write_archives` turns pages into WARC records (response, or revisit where a later page has the same payload) and packs those of
a task into ZIP files of about ARCHIVE_BYTES, with the stored members archive/data.warc.gz (each record a gzip member of its own)
and indexes/index.cdxj. `read_archives` opens each package at its end, parses the end record, the ZIP64 records and the central
directory, goes through all indexes (.cdxj, .cdxj.gz) below indexes/, and reads the records by their ranges from the stored members
below archive/ that the entries name; nothing is extracted. An entry that names no member where there are several, one that names
a member that is not stored, and archive members that no index covers are errors. A record in two indexes is read once.

Files carry the task attempt in their name, and only those of attempts that Spark committed are listed, so a lost executor
leaves files that nobody reads. The folder must be one that all executors see (file, hdfs, s3 or gs as pyarrow reads them).

A null html is an empty payload, a null url becomes the page's own name. Of rows with equal payloads those with the largest
id are responses; with a null id everywhere all are. Repeated rows are records of their own. An empty table gives an empty
result. Extra columns are not carried.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barloom.llm.registry import query, table
from barloom.llm.scratch import kept
from barloom.session import work_path

ARCHIVE_BYTES = 16 << 20
RANGE_BYTES = 4 << 20
ARCHIVES, INDEXES = "archive/", "indexes/"
WARC_MEMBER, INDEX_MEMBER = "archive/data.warc.gz", "indexes/index.cdxj"
DATE = "2024-01-01T00:00:00Z"
#: Fixed values of the revisit profile and of the ZIP records.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
END, END64, LOCATOR64, ENTRY, LOCAL = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02", b"PK\x03\x04"

Read = Callable[[int, int], bytes]


def record(page: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit has the HTTP head of the full payload and no payload."""
    name = lambda k: f"<urn:page:{'none' if k is None else k}>"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + payload
    head = ["WARC/1.1", f"WARC-Type: {'response' if refers_to is None else 'revisit'}", f"WARC-Record-ID: {name(page)}", f"WARC-Date: {DATE}"]
    target = url if url is not None else name(page)[1:-1]
    head.append("WARC-Target-URI: " + target.replace("\r", "%0D").replace("\n", "%0A"))
    head.append(f"WARC-Payload-Digest: sha1:{digest}")
    if refers_to is not None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {name(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(raw: bytes) -> dict:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to, payload; the payload of a response is checked."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if not lines[0].startswith("WARC/"):
        raise ValueError("no WARC record at this place")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(dict(line.split(": ", 1) for line in http.decode().split("\r\n")[1:])["Content-Length"])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha1:")
    if fields["WARC-Type"] == "response" and (len(payload) != size or digest != payload_digest(payload)):
        raise ValueError(f"damaged payload of {fields['WARC-Record-ID']}")
    number = lambda name: None if name in (None, "<urn:page:none>") else int(name[len("<urn:page:") : -1])
    return {
        "page_id": number(fields["WARC-Record-ID"]), "url": fields["WARC-Target-URI"], "payload_bytes": size, "payload_digest": digest,
        "record_type": fields["WARC-Type"], "refers_to": number(fields.get("WARC-Refers-To")), "payload": payload,
    }


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def packed(records: list[bytes], index: list[dict]) -> bytes:
    """A ZIP package of stored members."""
    out, at = io.BytesIO(), 0
    lines = []
    for raw, entry in zip(records, index):
        lines.append(f"{entry['url']} {entry['date']} " + json.dumps({"offset": at, "length": len(raw), "digest": entry["digest"], "filename": WARC_MEMBER.removeprefix(ARCHIVES)}))
        at += len(raw)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        z.writestr(zipfile.ZipInfo(WARC_MEMBER), b"".join(records))
        z.writestr(zipfile.ZipInfo(INDEX_MEMBER), "\n".join(lines))
    return out.getvalue()


def members(read: Read, size: int) -> dict[str, tuple[int, int]]:
    """Names of stored members with offset and length of their bytes. `read(offset, length)` reads a range of the package.

    Compressed members are left out. Entry counts, sizes and offsets of 0xFFFF or 0xFFFFFFFF are taken from the ZIP64 records.
    """
    tail_at = max(size - (22 + 0xFFFF + 20), 0)
    tail = read(tail_at, size - tail_at)
    end = tail.rfind(END, 0, max(len(tail) - 18, 0))
    while end >= 0 and tail_at + end + 22 + struct.unpack_from("<H", tail, end + 20)[0] != size:
        end = tail.rfind(END, 0, end)
    if end < 0:
        raise ValueError("no end record: not a ZIP package")
    count, length, start = struct.unpack_from("<HII", tail, end + 10)
    if end >= 20 and tail[end - 20 : end - 16] == LOCATOR64:
        (at,) = struct.unpack_from("<Q", tail, end - 12)
        end64 = read(at, 56)
        if end64[:4] != END64:
            raise ValueError("damaged ZIP64 end record")
        count, length, start = struct.unpack_from("<QQQ", end64, 32)
    directory, at, found = read(start, length), 0, {}
    for _ in range(count):
        if directory[at : at + 4] != ENTRY:
            raise ValueError("damaged central directory")
        method = struct.unpack_from("<H", directory, at + 10)[0]
        packed_size, full_size, n, m, k = struct.unpack_from("<IIHHH", directory, at + 20)
        (local,) = struct.unpack_from("<I", directory, at + 42)
        name = directory[at + 46 : at + 46 + n].decode()
        extra, stop = at + 46 + n, at + 46 + n + m
        while extra + 4 <= stop:
            kind, width = struct.unpack_from("<HH", directory, extra)
            if kind == 1:  # 64-bit values stand for those that did not fit, in this order
                values = list(struct.unpack_from(f"<{width // 8}Q", directory, extra + 4))
                full_size = values.pop(0) if full_size == 0xFFFFFFFF else full_size
                packed_size = values.pop(0) if packed_size == 0xFFFFFFFF else packed_size
                local = values.pop(0) if local == 0xFFFFFFFF else local
            extra += 4 + width
        if method == zipfile.ZIP_STORED:
            header = read(local, 30)
            if header[:4] != LOCAL:
                raise ValueError(f"damaged local header of {name}")
            found[name] = (local + 30 + sum(struct.unpack_from("<HH", header, 26)), full_size)
        at = stop + k
    return found


def index_ranges(read: Read, size: int) -> list[tuple[int, list[int]]]:
    """Ranges of a package that together hold all records: offset, and lengths of the records that lie there in a row."""
    found = members(read, size)
    stored = {k: v for k, v in found.items() if k.startswith(ARCHIVES) and not k.endswith("/")}
    records: set[tuple[int, int]] = set()
    covered: set[str] = set()
    for index in (k for k in found if k.startswith(INDEXES) and k.endswith((".cdxj", ".cdxj.gz"))):
        raw = read(*found[index])
        for line in (gzip.decompress(raw) if index.endswith(".gz") else raw).decode().split("\n"):
            if not line.strip() or line.startswith("!"):
                continue
            entry = json.loads(line[line.index(" {") + 1 :])
            if "filename" not in entry and len(stored) != 1:
                raise ValueError(f"an entry of {index} names none of {len(stored)} archive members")
            name = ARCHIVES + entry["filename"].removeprefix(ARCHIVES) if "filename" in entry else next(iter(stored))
            if name not in stored:
                raise ValueError(f"{index} names {name}, which is no stored member")
            covered.add(name)
            records.add((stored[name][0] + int(entry["offset"]), int(entry["length"])))
    if missed := sorted(k for k, (_, length) in stored.items() if length and k not in covered):
        raise ValueError(f"archive members that no index covers: {', '.join(missed)}")
    entries = sorted(records)
    out: list[tuple[int, list[int]]] = []
    held = 0
    for at, length in entries:
        if not out or held + length > RANGE_BYTES or out[-1][0] + held != at:
            out.append((at, []))
            held = 0
        out[-1][1].append(length)
        held += length
    return out


def write_archives(pages: DataFrame, folder: str, *, id_column: str = "page_id", url_column: str = "url", html_column: str = "html") -> DataFrame:
    """Write the packages below `folder`; columns path, n_records, n_bytes of those that were committed."""
    html = F.coalesce(F.col(html_column), F.lit(""))
    rows = pages.select(
        F.col(id_column).cast("long").alias("page"), F.col(url_column).alias("url"), html.cast("binary").alias("payload"),
        F.sha1(html.cast("binary")).alias("sha1"), F.octet_length(html).cast("long").alias("size"),
    )
    same = rows.groupBy("sha1", "size").agg(F.max("page").alias("last"), F.count("*").alias("k")).filter("k > 1 AND last IS NOT NULL")
    rows = rows.join(same.drop("k"), ["sha1", "size"], "left")
    again = F.col("last").isNotNull() & ~F.col("page").eqNullSafe(F.col("last"))
    rows = rows.select("page", "url", "sha1", "size", F.when(again, F.col("last")).alias("refers_to"), F.when(~again, F.col("payload")).alias("payload"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        context = TaskContext.get()
        system, base = pafs.FileSystem.from_uri(folder)
        system.create_dir(base, recursive=True)
        records: list[bytes] = []
        index: list[dict] = []
        done = held = 0

        def flush() -> pa.RecordBatch:
            nonlocal records, index, held, done
            raw = packed(records, index)
            name = f"pages-{context.partitionId():05d}-{context.taskAttemptId()}-{done:04d}.wacz"
            with system.open_output_stream(f"{base}/{name}") as out:
                out.write(raw)
            row = pa.RecordBatch.from_pydict({"path": [f"{folder.rstrip('/')}/{name}"], "n_records": [len(records)], "n_bytes": [len(raw)]})
            records, index, held, done = [], [], 0, done + 1
            return row

        for batch in batches:
            for page, url, sha1, size, refers_to, payload in zip(*(batch.column(c).to_pylist() for c in ("page", "url", "sha1", "size", "refers_to", "payload"))):
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                records.append(gzip.compress(record(page, url, payload or b"", size, digest, refers_to), 1, mtime=0))
                index.append({"url": (url or f"urn:page:{page}").replace(" ", "%20").replace("\n", "%0A").replace("\r", "%0D"), "date": "20240101000000", "digest": f"sha1:{digest}"})
                held += len(records[-1])
                if held >= ARCHIVE_BYTES:
                    yield flush()
        if records:
            yield flush()

    return kept(rows.mapInArrow(run, "path STRING, n_records BIGINT, n_bytes BIGINT"), "packages")


def _reader(path: str) -> tuple[Read, int, object]:
    system, at = pafs.FileSystem.from_uri(path)
    source = system.open_input_file(at)
    return (lambda offset, length: source.read_at(length, offset)), source.size(), source


def read_archives(packages: DataFrame) -> DataFrame:
    """The records of packages (column path), read by ranges of a few MB that are dealt out evenly."""

    def ranges(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                read, size, source = _reader(path)
                found = index_ranges(read, size)
                source.close()
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([f[0] for f in found], pa.int64()), pa.array([f[1] for f in found], pa.list_(pa.int64()))],
                    ["path", "at", "lengths"],
                )

    def records(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        for batch in batches:
            for path, at, lengths in zip(*(batch.column(c).to_pylist() for c in ("path", "at", "lengths"))):
                read, _, source = _reader(path)
                raw, begin, rows = read(at, sum(lengths)), 0, []
                source.close()
                for length in lengths:
                    rows.append(parse_record(gzip.decompress(raw[begin : begin + length])))
                    begin += length
                yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], k) for c, k in zip(names, kinds)], names)

    parts = int(packages.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = packages.select("path").repartition(parts).mapInArrow(ranges, "path STRING, at BIGINT, lengths ARRAY<BIGINT>").repartition(parts)
    fields = "page_id BIGINT, url STRING, payload_bytes BIGINT, payload_digest STRING, record_type STRING, refers_to BIGINT, payload BINARY"
    return dealt.mapInArrow(records, fields)


@query("op3_zip_archives")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    """All pages written as records in ZIP packages and read back by ranges."""
    packages = write_archives(table(spark, folder, "pages"), work_path(spark, "archives"))
    return read_archives(packages).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
