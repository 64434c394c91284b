import hashlib
import struct
import uuid

import pytest
import zstandard

from folioflow.llm import warc
from folioflow.llm.common import shared_dir


def test_archive_round_trip():
    records = [b"record %d " % i + b"shared words of all records " * 50 for i in range(200)] + [b"", b"x" * 300_000]
    data = warc.archive(records)
    assert data[:4] == (0x184D2A5D).to_bytes(4, "little")
    assert int.from_bytes(data[4:8], "little") > 0
    assert list(warc.read_archive(data)) == records
    assert list(warc.read_archive(warc.archive([b"one"]))) == [b"one"]


def test_revisits(spark):
    long, other = "é" * 600, "b" * 1000
    rows = [(1, "u", long), (2, None, long), (9, "u\r\nv", long), (9, "w", long), (3, "u", "s"), (4, "u", "s"), (5, "u", None), (6, "u", ""), (7, "u", other), (None, "u", other), (8, "u", "b" * 999), (10, "u", "b" * 999)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS size", "'x' AS digest")
    got = warc.round_trip(pages, f"{shared_dir(spark)}/{uuid.uuid4().hex}").collect()
    assert len(got) == len(rows)
    revisits = {r.page_id: r.refers_to for r in got if r.record_type == "revisit"}
    assert revisits == {1: 9, 2: 9}
    for r in got:
        text = {x[0]: x[2] or "" for x in rows}[r.page_id]
        assert (r.payload_bytes, r.payload_digest) == (len(text.encode()), hashlib.sha1(text.encode()).hexdigest())
        assert r.html == (None if r.record_type == "revisit" else text)
    assert warc.round_trip(pages.limit(0), f"{shared_dir(spark)}/{uuid.uuid4().hex}").count() == 0


def test_every_archive_has_a_dictionary(spark, tmp_path):
    """Small archives, and such as nothing can be learnt from, hold one too, and read back."""
    some = [warc.record_bytes(i, f"http://x/{i}", f"<p>{i}</p>" * (i % 50), hashlib.sha1((f"<p>{i}</p>" * (i % 50)).encode()).hexdigest(), len(f"<p>{i}</p>" * (i % 50)), None) for i in range(200)]
    for records in (some[:1], some[:3], some[:7], some[:8], [some[0]] * 20, some, some[:2] + [b"x" * 5_000_000 + b"tail"]):
        data = warc.archive(records)
        magic, n = struct.unpack_from("<II", data)
        assert magic == warc.DICTIONARY_MAGIC and 8 <= n <= warc.DICTIONARY_BYTES
        assert list(warc.read_archive(data)) == records
        with pytest.raises((ValueError, zstandard.ZstdError)):
            list(warc.read_archive(data[:-3]))
    assert len(warc.archive(some)) < sum(map(len, some)) / 2


def test_reading_is_linear(monkeypatch):
    """A record hands the library no more than a piece of what follows it."""
    records = [f"record {i} ".encode() * 40 for i in range(4000)]
    data, seen = warc.archive(records), []

    class View:
        def __init__(self, whole):
            self.whole = memoryview(whole)

        def __getitem__(self, part):
            seen.append(len(self.whole[part]))
            return self.whole[part]

    monkeypatch.setattr(warc, "memoryview", View, raising=False)
    assert list(warc.read_archive(data)) == records
    assert sum(seen) <= len(records) * warc.PIECE + len(data)
