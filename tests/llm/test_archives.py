from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import random
import struct
import zipfile
import zlib

import pytest
from brute import ODD

from barloom.llm import archives
from barloom.session import work_path


def test_pages_come_back(spark):
    rng = random.Random(41)
    pages = [(i, f"http://x/{i}", rng.choice([None, "", "<p>same</p>", f"<p>{rng.random()}</p>"])) for i in range(200)]
    pages += [(300 + i, None, t) for i, t in enumerate(ODD)] + [(None, "a b\r\nEvil: 1", "odd one"), (None, "u", "<p>same</p>"), (199, "again", pages[199][2])]
    frame = spark.createDataFrame([(*p, 1, "x") for p in pages], "page_id BIGINT, url STRING, html STRING, size INT, sha1 STRING")
    packages = archives.write_archives(frame, work_path(spark, "archives"))
    got = archives.read_archives(packages)
    best: dict = {}
    for i, _, h in pages:
        best[h or ""] = max((k for k in (best.get(h or ""), i) if k is not None), default=None)
    want = []
    for i, _, h in pages:
        raw = (h or "").encode()
        first = i == best[h or ""]
        want.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if first else "revisit", None if first else best[h or ""], raw if first else b""))
    rows = [(r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"], bytes(r["payload"])) for r in got.collect()]
    assert sorted(map(repr, rows)) == sorted(map(repr, want))
    assert packages.selectExpr("sum(n_records)").first()[0] == len(pages)
    assert archives.read_archives(archives.write_archives(frame.limit(0), work_path(spark, "archives"))).count() == 0


def members(raw: bytes) -> dict[str, bytes]:
    found = archives.members(lambda at, n: raw[at : at + n], len(raw))
    return {k: raw[a : a + n] for k, (a, n) in found.items()}


def test_directory_equals_the_standard_library():
    out = io.BytesIO(b"")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
        for k in range(5):
            z.writestr(f"dir/é{k}", bytes([k]) * k)
        z.writestr(zipfile.ZipInfo("packed"), b"x" * 100, compress_type=zipfile.ZIP_DEFLATED)
        z.comment = b"a comment with PK\x05\x06 inside"
    assert members(out.getvalue()) == {f"dir/é{k}": bytes([k]) * k for k in range(5)}
    with pytest.raises(ValueError):
        members(b"no package at all" * 10)


def test_zip64_values_replace_those_that_do_not_fit():
    name, body = b"archive/data.warc.gz", b"records"
    local = struct.pack("<4sHHHHHIIIHH", archives.LOCAL, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), 20) + name + struct.pack("<HHQQ", 1, 16, len(body), len(body))
    extra = struct.pack("<HHHQ", 9, 2, 0, 0)[:6] + struct.pack("<HHQQQ", 1, 24, len(body), len(body), 0)
    entry = struct.pack("<4sHHHHHHIIIHHHHHII", archives.ENTRY, 45, 45, 0, 0, 0, 0, zlib.crc32(body), 0xFFFFFFFF, 0xFFFFFFFF, len(name), len(extra), 0, 0, 0, 0, 0xFFFFFFFF) + name + extra
    at = len(local) + len(body)
    end64 = struct.pack("<4sQHHIIQQQQ", archives.END64, 44, 45, 45, 0, 0, 1, 1, len(entry), at)
    locator = struct.pack("<4sIQI", archives.LOCATOR64, 0, at + len(entry), 1)
    end = struct.pack("<4sHHHHIIH", archives.END, 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 0)
    raw = local + body + entry + end64 + locator + end
    assert members(raw) == {name.decode(): body}
    assert zipfile.ZipFile(io.BytesIO(raw)).read(name.decode()) == body


def test_all_members_and_indexes_of_a_package():
    parts = {"a.warc.gz": [b"one", b"three"], "b.warc.gz": [b"eleven", b"x"]}

    def package(named: bool, listed: str) -> bytes:
        out = io.BytesIO()
        with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as z:
            for k, records in parts.items():
                z.writestr("archive/" + k, b"".join(records))
            for k, records in parts.items():
                if k[0] in listed:
                    entries = [{"offset": str(len(records[0]) * i), "length": len(r)} | ({"filename": k} if named else {}) for i, r in enumerate(records)]
                    lines = "".join(f"u{i} 20240101000000 {json.dumps(e)}\n" for i, e in enumerate(entries)).encode()
                    z.writestr(f"indexes/{k[0]}.cdxj" + ".gz" * (k[0] == "b"), gzip.compress(lines) if k[0] == "b" else lines)
        return out.getvalue()

    def read(raw: bytes) -> list[bytes]:
        found = []
        for at, lengths in archives.index_ranges(lambda at, n: raw[at : at + n], len(raw)):
            for n in lengths:
                found.append(raw[at : at + n])
                at += n
        return found

    assert read(package(True, "ab")) == [b"one", b"three", b"eleven", b"x"]
    for raw in (package(True, "a"), package(False, "ab"), package(True, "")):
        with pytest.raises(ValueError):
            read(raw)


def test_damage_is_noticed():
    raw = archives.record(1, "u", b"payload", 7, archives.payload_digest(b"payload"), None)
    assert archives.parse_record(raw)["payload"] == b"payload"
    with pytest.raises(ValueError):
        archives.parse_record(raw.replace(b"payload", b"pAyload"))
