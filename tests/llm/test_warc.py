"""WARC source and the archive of pages: round trip, pushed filters, skipped payloads, foreign files, damage, NULLs, copies."""

import gzip
import hashlib
import io

import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from growthlens.llm import warc

SCHEMA = "page_id bigint, url string, html string, record_type string, payload binary, same string, kept string"


def expected(rows):
    groups = {}
    for i, _, html in rows:
        b = (html or "").encode()
        if len(b) >= 1000:
            groups.setdefault(b, []).append(i)
    out = []
    for i, _, html in rows:
        b = (html or "").encode()
        ids = [x for x in groups.get(b, []) if x is not None]
        keep = max(ids) if len(groups.get(b, [])) > 1 and ids else None
        revisit = keep is not None and keep != i
        out.append((i, len(b), hashlib.sha1(b).hexdigest(), "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def test_pages_come_back(spark, tmp_path):
    rows = [(1, "http://a/", "x" * 999), (2, "http://a/", "x" * 999), (3, None, None), (4, "http://b/\r\nWARC-Type: revisit", ""), (5, "u", "é" * 500)]
    rows += [(i, "http://copies/", "y" * 1000) for i in range(10, 60)] + [(7, "http://b/", "é" * 500), (None, "z", "é" * 500), (None, "z", "alone")]
    rows += [(80, "d", "q" * 5000), (80, "d", "q" * 5000), (79, "d", "q" * 5000), (90, "long", "<p>WARC/1.1\r\n\r\n</p>" * 100_000)]
    rows += [(None, "n", "w" * 2000), (None, "n", "w" * 2000)]
    df = spark.createDataFrame([(*r, "a", b"", "b", "c") for r in rows], SCHEMA).repartition(3)
    path = str(tmp_path / "a")
    assert sorted((tuple(r) for r in warc.archive_pages(df, path).collect()), key=str) == expected(rows)
    back = warc.read_warc(spark, path)
    kept = back.filter("record_type = 'response'").select("record_id", F.col("payload").cast("string").alias("html"), "target_uri", "status").collect()
    html = {r.record_id: r.html for r in kept}
    assert html["urn:page:90"] == rows[-3][2] and html["urn:page:59"] == "y" * 1000 and html["urn:page:3"] == ""
    assert back.filter("record_type = 'revisit' AND payload = X''").count() == 49 + 2 + 1
    assert {r.target_uri for r in kept if r.record_id == "urn:page:4"} == {"http://b/%0D%0AWARC-Type: revisit"}
    assert back.filter("record_type = 'warcinfo'").count() >= 1 and {r.status for r in kept} == {200}
    assert warc.archive_pages(spark.createDataFrame([], SCHEMA), str(tmp_path / "none")).count() == 0


def test_filters_reach_the_source_and_agree_with_spark(spark, tmp_path):
    df = spark.createDataFrame([(i, f"http://h{i % 3}/{i}", "body " * 300 + str(i // 2)) for i in range(40)], "page_id bigint, url string, html string")
    path = str(tmp_path / "a")
    warc.archive_pages(df, path).count()
    back = warc.read_warc(spark, path)
    rows = [r.asDict() for r in back.collect()]
    for text, keep in {
        "record_type = 'revisit'": lambda r: r["record_type"] == "revisit",
        "refers_to IS NULL AND target_uri LIKE 'http://h1%'": lambda r: r["refers_to"] is None and (r["target_uri"] or "").startswith("http://h1"),
        "NOT (record_type = 'response') AND date >= '1970'": lambda r: r["record_type"] != "response" and r["date"] >= "1970",
        "record_id IN ('urn:page:3', 'urn:page:4') AND payload_length > 10": lambda r: r["record_id"] in ("urn:page:3", "urn:page:4"),
        "refers_to <> 'urn:page:9'": lambda r: r["refers_to"] not in (None, "urn:page:9"),
    }.items():
        got = back.filter(text)
        assert sorted(str(r.asDict()) for r in got.collect()) == sorted(str(r) for r in rows if keep(r)), text
    # decided by the source: no filter is left above it
    plan = back.filter("record_type = 'revisit'")._jdf.queryExecution().executedPlan().toString()
    assert "Filter (" not in plan and "Filter [" not in plan
    assert warc.read_warc(spark, path, "record_id", "payload_length").columns == ["record_id", "payload_length"]


class Counted(io.BytesIO):
    def __init__(self, data):
        super().__init__(data)
        self.n = 0

    def size(self):
        return len(self.getvalue())

    def read(self, n=-1):
        out = super().read(n)
        self.n += len(out)
        return out


def some_records(n=20, size=300_000):
    import random

    rng = random.Random(1)
    return [
        warc.record({"WARC-Type": "response", "WARC-Record-ID": f"<urn:x:{i}>", "WARC-Payload-Digest": "sha1:" + "A" * 32, "Content-Type": "application/http"},
                    warc.http_block(rng.randbytes(size), size))
        for i in range(n)
    ]


@pytest.mark.parametrize("pack", [bytes, warc.member, gzip.compress])
def test_unwanted_records_are_stepped_over(pack):
    data = b"".join(map(pack, some_records()))
    file = Counted(data)
    got = list(warc.read_records(warc.Tape(file), lambda r: r["record_id"] == "urn:x:7", ["record_id", "payload", "payload_digest", "offset"]))
    assert [r[0] for r in got] == ["urn:x:7"] and len(got[0][1]) == 300_000 and got[0][2] == "0" * 40
    if pack is not gzip.compress:
        assert file.n < 0.4 * len(data)
    heads = Counted(data)
    only = list(warc.read_records(warc.Tape(heads), lambda r: True, ["record_id", "payload_length", "status"]))
    assert only == [[f"urn:x:{i}", 300_000, 200] for i in range(20)]
    assert pack is gzip.compress or heads.n < 0.4 * len(data)


@pytest.mark.parametrize("pack", [bytes, warc.member, gzip.compress])
def test_damage_is_reported(pack):
    data = b"".join(map(pack, some_records(3, 5000)))
    for bad in (data[:-2000], b"no archive" + data, data[: len(data) // 2] + b"\0" * 40 + data[len(data) // 2 + 40 :]):
        if pack is bytes and len(bad) == len(data):
            continue  # changed payload bytes cannot be seen without a check sum
        with pytest.raises(ValueError, match="damaged record"):
            list(warc.read_records(warc.Tape(Counted(bad)), lambda r: True, ["payload"]))


def test_foreign_folders_and_overwritten_archives(spark, tmp_path):
    for name, pack in (("a.warc", bytes), ("b.warc.gz", gzip.compress)):
        (tmp_path / name).write_bytes(b"".join(map(pack, some_records(4, 100))))
    (tmp_path / "notes.txt").write_text("no archive")
    back = warc.read_warc(spark, str(tmp_path))
    assert back.count() == 8 and back.filter("status = 200 AND payload_length = 100 AND octet_length(payload) = 100").count() == 8
    assert warc.read_warc(spark, f"file://{tmp_path}/a.warc").count() == 4
    rows = warc.page_records(spark.createDataFrame([(1, "u", "t")], "page_id bigint, url string, html string"))
    path = str(tmp_path / "own")
    for _ in range(2):
        warc.write_warc(rows, path)
    responses = lambda: warc.read_warc(spark, path).filter("record_type = 'response'").count()
    assert responses() == 2  # appended
    names = ("record_type", "record_id", "target_uri", "date", "payload_digest", "refers_to", "payload_length", "payload")
    rows.select(*names).write.format("warc").mode("overwrite").save(path)
    assert responses() == 1
    (tmp_path / "bad.warc").write_bytes(b"WARC/1.1\r\nWARC-Type: response\r\n\r\n")
    with pytest.raises(PythonException, match="damaged record"):
        warc.read_warc(spark, str(tmp_path / "bad.warc")).count()
