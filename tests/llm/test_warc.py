"""WARC archives: written, read back, the same twice, and whole after a lost attempt."""

import base64
import gzip
import hashlib
import os
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from numera.llm import registry, warc

PAGES = "page_id long, url string, html string"
ROWS = (
    [(i, f"http://a/{i}", f"<p>page {i} é</p>" * (i % 40)) for i in range(60)]
    + [(100 + i, f"http://copies/{i}", "<p>one copy</p>") for i in range(70)]
    + [(300, "http://same", "<p>again</p>")] * 40
    + [(None, None, None), (None, "u", ""), (-5, "http://x/ä b\r\n", None), (1 << 62, "", "<p>one copy</p>"), (-(1 << 63), None, "<b>"), (None, None, "<p>again</p>"), (400, "http://long", "<p>é</p>" * 200_000)]
)


def brute(rows, least=0):
    groups = defaultdict(list)
    for i, _, h in rows:
        groups[h or ""].append(i)
    out = Counter()
    for h, ids in groups.items():
        data = h.encode()
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        first = min((i for i in ids if i is not None), default=None)
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            alone = k == 0 or len(data) < least
            out[(i, len(data), digest, "response" if alone else "revisit", None if alone else first)] += 1
    return out


def found(df):
    return Counter((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect())


def pages(spark, rows=ROWS):
    return spark.createDataFrame(rows, PAGES).withColumns({c: F.lit(1) for c in ("shard", "copy", "first", "rows", "member", "sha256", "key")}).repartition(3)


def test_round_trip(spark, tmp_path):
    where = f"file://{tmp_path}/a"
    files = warc.write(pages(spark), where, shard_bytes=20_000, roll_bytes=1500).collect()
    assert len(files) > 5 and any(f.part for f in files) and sum(f.records for f in files) == len(ROWS)
    got = warc.read(spark, where)
    assert found(got) == brute(ROWS)
    texts = {(r.page_id, r.payload.decode()) for r in got.where("record_type = 'response'").collect()}
    assert {h for _, h in texts} == {h or "" for _, _, h in ROWS} and texts <= {(i, h or "") for i, _, h in ROWS}
    ids = [r.record_id for r in got.collect()]
    assert len(set(ids)) == len(ids)
    for f in files:
        data = open(f"{tmp_path}/a/{f.name}", "rb").read()
        assert len(data) == f.bytes and hashlib.sha256(data).hexdigest() == f.sha256 and gzip.decompress(data).count(b"WARC/1.1\r\n") == f.records
    assert not os.path.exists(f"{tmp_path}/a/temporary")
    # the order of the archive is that of page ids, nulls last
    order = []
    for f in sorted(files, key=lambda f: f.name):
        with open(f"{tmp_path}/a/{f.name}", "rb") as g:
            order += [warc.parse(m)["page_id"] for m in warc._members_of(g)]
    assert order == sorted(order, key=lambda i: (i is None, i or 0))


def test_same_bytes_again(spark, tmp_path):
    for name, parts in (("a", 2), ("b", 7)):
        warc.write(pages(spark).repartition(parts), str(tmp_path / name), shard_bytes=20_000, roll_bytes=1500)
    files = sorted(f for f in os.listdir(tmp_path / "a") if f.endswith(".gz"))
    assert files == sorted(f for f in os.listdir(tmp_path / "b") if f.endswith(".gz"))
    assert all((tmp_path / "a" / f).read_bytes() == (tmp_path / "b" / f).read_bytes() for f in files)


def test_small_payloads_and_faults(spark, tmp_path):
    where = str(tmp_path / "a")
    files = warc.write(pages(spark), where, min_bytes=20).collect()
    assert found(warc.read(spark, where, payloads=False)) == brute(ROWS, 20)
    (tmp_path / "a" / "stray.warc.gz").write_bytes(b"no archive")  # in no manifest
    assert warc.read(spark, where).count() == len(ROWS)
    name = tmp_path / "a" / files[0].name
    name.write_bytes(name.read_bytes()[:-40])
    with pytest.raises(Exception, match="ends within a record|Error"):
        warc.read(spark, where).count()
    assert warc.write(pages(spark).limit(0), str(tmp_path / "none")).count() == 0 and warc.read(spark, str(tmp_path / "none")).count() == 0


def test_ids():
    for i in (None, 0, 1, -1, 1 << 62, -(1 << 63), (1 << 63) - 1):
        assert warc.page_of(warc.record_id(i, "u", b"x", 3)) == i
        assert warc.record_id(i, "u", b"x", 3) != warc.record_id(i, "u", b"x", 4)


def test_query(spark, tmp_path):
    spark.createDataFrame(ROWS, PAGES).write.parquet(f"{tmp_path}/pages.parquet")
    assert found(registry.queries()["op12_warc"](spark, str(tmp_path))) == brute(ROWS)
