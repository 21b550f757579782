"""WARC source: round trips, foreign archives, pushdown and skipped payloads."""

import gzip
import hashlib
import io
import random

import pytest

from proxima.llm import warc as W
from proxima.session import scratch_path

PAGES = [(1, "http://a/", "x" * 100), (2, "http://a/", "x" * 100), (3, None, "y" * 99), (4, "u", "y" * 99), (5, "u", None), (6, "u", ""), (None, "u", "z" * 500), (7, "u", "z" * 500),
         (8, "a b\r\nWARC-Type: evil", "é" * 50 + "\r\n\r\nWARC/1.1\r\n\r\n"), (9, "u", "only me " * 40), (10, "u", "twice " * 40), (10, "u", "twice " * 40), (11, "u", "twice " * 40),
         (10, "v", "twice " * 40), (None, None, "null " * 40), (None, None, "null " * 40), (12, "u", "long " * 400_000)]


def slow(rows):
    groups, out = {}, []
    for i, u, t in rows:
        b = (t or "").encode()
        groups.setdefault(b, []).append((i is None, i or 0, u is None, u or ""))
    for b, ids in groups.items():
        lead = None
        for k, (none, i, *_) in enumerate(sorted(ids)):
            me = None if none else i
            lead = me if k == 0 else lead
            again = len(b) >= 100 and k > 0
            out.append((me, len(b), hashlib.sha256(b).hexdigest(), "revisit" if again else "response", lead if again else None))
    return sorted(out, key=repr)


def seen(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=repr)


@pytest.mark.parametrize("few", [200_000, 0])
def test_round_trip(spark, few, monkeypatch):
    df = spark.createDataFrame([(*r, "x", 1) for r in PAGES], "page_id long, url string, html string, payload string, digest int")
    path = scratch_path(spark, "warc")
    W.write(W.captures(df, few=few), path)
    assert seen(W.read_captures(spark, path).withColumnRenamed("id", "page_id")) == slow(PAGES)


def test_many_copies(spark):
    rows = [(7, "u", "hot " * 50)] * 2500 + [(i, "u", "hot " * 50) for i in range(100, 1100)] + [(i, f"u{i}", f"page {i} " * 20) for i in range(5000, 6000)]
    assert seen(W.archive(spark.createDataFrame(rows, "page_id long, url string, html string"))) == slow(rows)


def test_empty(spark):
    out = W.archive(spark.createDataFrame([], "page_id long, url string, html string"))
    assert out.collect() == [] and out.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]


def some_records(n=40):
    rnd = random.Random(n)
    return [W.record_bytes({"warc_type": rnd.choice(["response", "revisit", "metadata"]), "record_id": f"<urn:{i}>", "target_uri": f"http://h{i % 3}/{i}",
                            "payload": None if i % 5 == 0 else bytes(rnd.choices(b"ab\r\n", k=rnd.choice([0, 5, 70_000])))}) for i in range(n)]


class Counting(io.BytesIO):
    bytes_read = 0

    def read(self, n=-1):
        out = super().read(n)
        self.bytes_read += len(out)
        return out


@pytest.mark.parametrize("pack", [b"".join, lambda r: b"".join(map(W.member, r)), lambda r: b"".join(map(gzip.compress, r)), lambda r: gzip.compress(b"".join(r))])
def test_all_layouts_read_the_same(pack):
    recs = some_records()
    data = pack(recs)
    want = list(W.records(W.Records(io.BytesIO(b"".join(recs)), len(b"".join(recs))), lambda f: True, True))
    assert [f["warc-record-id"] for f, _ in want] == [f"<urn:{i}>" for i in range(40)]
    for wanted in (True, False):
        got = list(W.records(W.Records(io.BytesIO(data), len(data)), lambda f: True, wanted))
        assert got == [(f, p if wanted else None) for f, p in want]
        got = list(W.records(W.Records(io.BytesIO(data), len(data)), lambda f: f["warc-type"] == "revisit", wanted))
        assert got == [(f, p if wanted else None) for f, p in want if f["warc-type"] == "revisit"]
    with pytest.raises(ValueError):
        list(W.records(W.Records(io.BytesIO(data[:-70_010]), len(data) - 70_010), lambda f: True, True)) if pack is b"".join else W.parse_header(b"HTTP/1.1 200")


def test_unwanted_payloads_are_not_read():
    rnd = random.Random(1)
    recs = [W.record_bytes({"warc_type": "response", "record_id": f"<{i}>", "payload": rnd.randbytes(1 << 20)}) for i in range(10)]
    for data in (b"".join(recs), b"".join(map(W.member, recs))):
        f = Counting(data)
        assert len(list(W.records(W.Records(f, len(data)), lambda x: False, True))) == 0
        assert f.bytes_read < len(data) / 4


def test_ranges_cover_every_record_once():
    recs = some_records(25)
    members = list(map(W.member, recs))
    data, edges = b"".join(members), [0]
    for m in members:
        edges.append(edges[-1] + len(m))
    for cut in edges:
        got = [f["warc-record-id"] for a, b in ((0, cut), (cut, len(data))) for f, _ in W.records(W.Records(io.BytesIO(data), len(data), a, b), lambda x: True, False)]
        assert got == [f"<urn:{i}>" for i in range(25)]


def test_pushdown_partitions_and_foreign_files(spark, tmp_path):
    recs = some_records()
    (tmp_path / "a.warc").write_bytes(b"".join(recs[:20]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(map(gzip.compress, recs[20:])))
    W.register(spark)
    df = spark.read.format("warc").load(str(tmp_path))
    assert df.count() == 40
    kept = df.where("warc_type in ('revisit', 'metadata') and target_uri like 'http://h1/%' and content_length >= 0 and payload is not null")
    plan = kept._jdf.queryExecution().executedPlan().toString()
    left = [line for line in plan.splitlines() if "Filter" in line.split("[")[0].split("(")[0] or "Filter isnotnull" in line]
    assert left and all("isnotnull(payload" in line and "target_uri" not in line and "content_length" not in line for line in left)
    want = [r for r in df.collect() if r.warc_type != "response" and r.target_uri.startswith("http://h1/")]
    assert sorted(r.record_id for r in kept.collect()) == sorted(r.record_id for r in want) != []
    assert df.where("headers['warc-type'] = 'revisit'").count() == df.where("warc_type = 'revisit'").count()
    reader = W.Reader(df.schema, {"path": str(tmp_path), "partition_bytes": "1"})
    assert len(reader.partitions()) == 2


def test_only_committed_files_are_read(spark):
    path = scratch_path(spark, "warc")
    df = spark.createDataFrame([(i, "u", "page " * 30 + str(i)) for i in range(50)], "page_id long, url string, html string")
    W.write(W.captures(df), path)
    system, root = W.file_system(path)
    with system.open_output_stream(f"{root}/part-lost.warc.gz", compression=None) as f:
        f.write(W.member(some_records(1)[0]))
    assert W.read(spark, path).count() == 50
    W.write(W.captures(df), path)
    assert W.read(spark, path).count() == 100
    W.write(W.captures(df), path, "overwrite")
    assert W.read(spark, path).count() == 50
