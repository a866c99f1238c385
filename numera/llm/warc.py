"""WARC archives of pages: a deterministic sharded writer, and a reader of what it committed.

Writing goes in five steps, all of them Spark jobs.

1. The narrow columns of the pages (id, url, SHA-256, SHA-1, length) are
   grouped, so rows that are equal in all become one row with a count.  The
   first record of every payload is the response, the others are to revisit it.
   Payloads are equal if their SHA-256 is; those that hold a thousandth of all
   rows, a thousand at most, are broadcast, the others are joined.
2. The records are sorted by ranges, in the order of page id (nulls last), url
   and payload, and running sums of their lengths deal them into shards of about
   ``shard_bytes`` of payload.  Ranges come from a sample, but places and sums
   are those of the whole order, so shards do not depend on it.
3. Only the responses need their payload: it is compressed, then joined by
   digest, once for each payload, and every record becomes a gzip member,
   headers regenerated.
4. The members are dealt by shard, sorted within it, and written under temporary
   names; a file is closed once it holds ``roll_bytes`` compressed.  What a task
   wrote (names, sizes, digests) is a row of a table, so the files of a task that
   was lost or ran twice are in no row.
5. The files in the table are renamed to their final names, which may be done
   again after a failure, and the manifest is written.  Readers trust it alone.

The same pages give the same files, byte for byte: dates are a parameter, ids
are made from the page id and the record, gzip headers hold no time.
"""

from __future__ import annotations

import base64
import hashlib
import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from typing import BinaryIO

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from numera.llm.common import cut, drop_cut, shared_dir, small_batches

DATE = "1970-01-01T00:00:00Z"
#: Payload bytes of a shard, and compressed bytes after which a file is closed.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 1 << 30
#: A payload that holds this part of all rows is hot; there are at most as many such payloads.
HOT_PART = 1000
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


def base32(digest: bytes) -> str:
    return base64.b32encode(digest).decode()


def record_id(page_id: int | None, url: str | None, sha256: bytes, copy: int) -> str:
    """A UUID of version 8 that holds the page id: 57 bits of hash tell records of one page apart, one bit says that the id is null."""
    h = hashlib.sha256(repr((url, copy)).encode("utf-8", "surrogatepass") + sha256).digest()
    value = (page_id or 0) & (1 << 64) - 1
    bits = int.from_bytes(h[:6]) << 80 | 8 << 76 | (page_id is None) << 75 | (h[6] << 1 | h[7] & 1) << 66 | value >> 62 << 64 | 2 << 62 | value & (1 << 62) - 1
    return f"<urn:uuid:{uuid.UUID(int=bits)}>"


def page_of(record: str) -> int | None:
    """The page id in a record id."""
    bits = uuid.UUID(record.removeprefix("<urn:uuid:").removesuffix(">")).int
    value = (bits >> 64 & 3) << 62 | bits & (1 << 62) - 1
    return None if bits >> 75 & 1 else value - (value >> 63 << 64)


def _uri(url: str | None) -> str:
    """The url with everything but printable ASCII in percent escapes; a page without one has an address of no place."""
    return "".join(chr(c) if 32 < c < 127 else f"%{c:02X}" for c in url.encode("utf-8", "surrogatepass")) if url else "about:blank"


def head(r: dict, block_sha1: bytes, block_bytes: int, date: str = DATE) -> bytes:
    """The WARC/1.1 header of a record, up to its block."""
    fields = [
        ("WARC-Type", "response" if r["response"] else "revisit"),
        ("WARC-Record-ID", record_id(r["page_id"], r["url"], r["sha256"], r["copy"])),
        ("WARC-Date", date),
        ("WARC-Target-URI", _uri(r["url"])),
    ]
    if not r["response"]:
        fields += [("WARC-Profile", _PROFILE), ("WARC-Refers-To", record_id(r["first_id"], r["first_url"], r["sha256"], 0)), ("WARC-Refers-To-Target-URI", _uri(r["first_url"])), ("WARC-Refers-To-Date", date)]
    fields += [
        ("WARC-Payload-Digest", "sha1:" + base32(r["sha1"])),
        ("WARC-Block-Digest", "sha1:" + base32(block_sha1)),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", str(block_bytes)),
    ]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields).encode() + b"\r\n"


def _deflated(data: bytes, end: int) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, -15)
    return z.compress(data) + z.flush(end)


def packed(payload: bytes) -> bytes:
    """A payload as deflate blocks that end on a byte and may stand anywhere in a stream."""
    return _deflated(payload, zlib.Z_SYNC_FLUSH)


def member(r: dict, blocks: bytes | None, date: str = DATE) -> bytes:
    """The gzip member of a record; ``blocks`` is the packed payload of a response.  A revisit's block is the HTTP head alone.

    The payload is not compressed again: its blocks follow those of the headers.
    The gzip header holds no time and no name.
    """
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {r['bytes']}\r\n\r\n".encode()
    payload = zlib.decompressobj(-15).decompress(blocks) if r["response"] else b""
    sha1 = hashlib.sha1(http)
    sha1.update(payload)
    before, after = head(r, sha1.digest(), len(http) + len(payload), date) + http, b"\r\n\r\n"
    check = zlib.crc32(after, zlib.crc32(payload, zlib.crc32(before)))
    size = len(before) + len(payload) + len(after)
    out = [b"\x1f\x8b\x08\0\0\0\0\0\0\xff", _deflated(before, zlib.Z_SYNC_FLUSH), blocks if r["response"] else b"", _deflated(after, zlib.Z_FINISH), struct.pack("<II", check, size & 0xFFFFFFFF)]
    return b"".join(out)


def _order(where: str = "") -> list:
    return [F.col(f"{where}page_id").isNull(), F.col(f"{where}page_id"), F.col(f"{where}url").isNull(), F.col(f"{where}url"), F.col(f"{where}sha256"), F.col(f"{where}copy")]


def plan_records(pages: DataFrame, min_bytes: int = 0, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """A row per page, written to the shared folder: what its record says, without the payload, and its ``shard``.

    Of payloads of at least ``min_bytes`` that are equal, the first in the order
    of page id (nulls last) and url is the response, rows equal in both and
    payload counting on from copy 0; smaller payloads are all responses.
    """
    spark = pages.sparkSession
    html = F.coalesce("html", F.lit("")).cast("binary")
    narrow = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.unhex(F.sha2(html, 256)).alias("sha256"), F.unhex(F.sha1(html)).alias("sha1"), F.octet_length(html).cast("long").alias("bytes"))
    keys = cut(narrow.groupBy("page_id", "url", "sha256", "sha1", "bytes").agg(F.count(F.lit(1)).alias("copies")), "warc-keys")
    place = F.struct(F.col("page_id").isNull().alias("a"), F.col("page_id").alias("first_id"), F.col("url").isNull().alias("b"), F.col("url").alias("first_url"))
    groups = cut(keys.where(F.col("bytes") >= min_bytes).groupBy("sha256").agg(F.count(F.lit(1)).alias("rows"), F.min(place).alias("first")).where("rows > 1"), "warc-groups")
    total = keys.count()
    hot = groups.where(F.col("rows") * HOT_PART > total).select("sha256", F.col("first").alias("hot"))  # fewer than HOT_PART
    rest = groups.where(F.col("rows") * HOT_PART <= total).select("sha256", "first")
    # rows of hot payloads join nothing: their keys are spread
    marked = keys.join(F.broadcast(hot), "sha256", "left").withColumn("key", F.when(F.col("hot").isNull(), F.col("sha256")).otherwise(F.unhex(F.hex(F.xxhash64("page_id", "url")))))
    marked = marked.join(rest.withColumnRenamed("sha256", "key"), "key", "left").withColumn("first", F.coalesce("hot", "first", place))
    small = F.col("bytes") < min_bytes
    leads = small | (F.col("first.first_id").eqNullSafe(F.col("page_id")) & F.col("first.first_url").eqNullSafe(F.col("url")))
    each = marked.withColumn("copy", F.explode(F.sequence(F.lit(0).cast("long"), F.col("copies") - 1)))
    each = each.select("page_id", "url", "sha256", "sha1", "bytes", "copy", F.col("first.first_id").alias("first_id"), F.col("first.first_url").alias("first_url"), (small | (leads & (F.col("copy") == 0))).alias("response"))
    plan = cut(each, "warc-plan")
    # the whole order: ranges by Spark's sample, then sums within and before each range
    parts = max(1, min(10_000, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    dealt = cut(plan.repartitionByRange(parts, *_order()).sortWithinPartitions(*_order()).withColumn("part", F.spark_partition_id()), "warc-sorted")
    size = F.col("bytes") + 512
    sums = dealt.groupBy("part").agg(F.sum(size).alias("sum"))  # a row per range
    before = sums.select("part", (F.sum("sum").over(Window.orderBy("part")) - F.col("sum")).alias("before"))
    within = F.sum(size).over(Window.partitionBy("part").orderBy(*_order()).rowsBetween(Window.unboundedPreceding, Window.currentRow)) - size
    sharded = dealt.join(F.broadcast(before), "part").withColumn("shard", F.floor((F.col("before") + within) / shard_bytes)).drop("part", "before")
    out = cut(sharded, "warc-records")
    for t in (keys, groups, plan, dealt):
        drop_cut(t)
    return out


def members(pages: DataFrame, plan: DataFrame, date: str = DATE) -> DataFrame:
    """``plan`` with ``member``, the gzip member of each record: revisits from the plan alone, responses with their payload joined by digest.

    Payloads are compressed before they are shuffled, one of each digest.
    """
    cols = plan.columns

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in small_batches([b], 1):
                yield pa.RecordBatch.from_arrays([p.column(0), pa.array([packed(x.encode("utf-8", "surrogatepass")) for x in p.column(1).to_pylist()], pa.binary())], ["sha256", "blocks"])

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for p in small_batches([b], len(cols)):
                made = [member(r, r["blocks"], date) for r in p.to_pylist()]
                yield pa.RecordBatch.from_arrays([*(p.column(i) for i in range(len(cols))), pa.array(made, pa.binary())], [*cols, "member"])

    kind = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in plan.schema.fields) + ", member binary"
    html = F.coalesce("html", F.lit(""))
    payloads = pages.select(F.unhex(F.sha2(html.cast("binary"), 256)).alias("sha256"), html.alias("html")).mapInArrow(pack, "sha256 binary, blocks binary").dropDuplicates(["sha256"])
    responses = plan.where("response").join(payloads, "sha256").select(*cols, "blocks")
    revisits = plan.where("not response").select(*cols, F.lit(None).cast("binary").alias("blocks"))
    return responses.mapInArrow(work, kind).unionByName(revisits.mapInArrow(work, kind))


def _open(where: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(where) if "://" in where or where.startswith("file:") else (pafs.LocalFileSystem(), where)


def write(pages: DataFrame, where: str, min_bytes: int = 0, date: str = DATE, shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Write a record per row of ``pages`` (page_id, url, html) below ``where``, a folder all executors reach, and return the manifest.

    The manifest, kept as Parquet in ``where/manifest``, has a row per file:
    name, shard, part, records, bytes, sha256.  A null html is an empty payload;
    null or repeated ids, null urls and repeated rows each get a record of their
    own; other columns are not read; an empty table gives an empty manifest.
    """
    spark = pages.sparkSession
    plan = plan_records(pages, min_bytes, shard_bytes)
    made = members(pages, plan, date)
    shards = (plan.agg(F.max("shard")).first()[0] or 0) + 1

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(where)
        fs.create_dir(f"{base}/temporary", recursive=True)
        state: dict = {}
        rows: list[dict] = []

        def close() -> None:
            if state:
                state["out"].close()
                rows.append({"shard": state["shard"], "part": state["part"], "temporary": state["name"], "records": state["records"], "bytes": state["bytes"], "sha256": state["sha"].hexdigest()})

        for b in batches:
            for shard, m in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                if not state or state["shard"] != shard or state["bytes"] >= roll_bytes:
                    part = state["part"] + 1 if state and state["shard"] == shard else 0
                    close()
                    name = f"temporary/{shard:08d}-{part:04d}-{uuid.uuid4().hex}"
                    state = {"shard": shard, "part": part, "name": name, "records": 0, "bytes": 0, "sha": hashlib.sha256(), "out": fs.open_output_stream(f"{base}/{name}", compression=None)}
                state["out"].write(m)
                state["sha"].update(m)
                state["records"] += 1
                state["bytes"] += len(m)
        close()
        yield pa.RecordBatch.from_pylist(rows, pa.schema([("shard", pa.int64()), ("part", pa.int64()), ("temporary", pa.string()), ("records", pa.int64()), ("bytes", pa.int64()), ("sha256", pa.string())]))

    ordered = made.repartition(min(shards, 100_000), "shard").sortWithinPartitions("shard", *_order()).select("shard", "member")
    written = cut(ordered.mapInArrow(work, "shard long, part long, temporary string, records long, bytes long, sha256 string"), "warc-written")
    drop_cut(plan)

    def commit(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(where)
        for b in batches:
            names = []
            for r in b.to_pylist():
                name = f"{r['shard']:08d}-{r['part']:04d}.warc.gz"
                if fs.get_file_info(f"{base}/{r['temporary']}").type != pafs.FileType.NotFound:
                    fs.move(f"{base}/{r['temporary']}", f"{base}/{name}")
                if fs.get_file_info(f"{base}/{name}").size != r["bytes"]:
                    raise OSError(f"{name} was not committed whole")
                names.append(name)
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), *(b.column(c) for c in ("shard", "part", "records", "bytes", "sha256"))], ["name", "shard", "part", "records", "bytes", "sha256"])

    moved = written.mapInArrow(commit, "name string, shard long, part long, records long, bytes long, sha256 string")
    moved.write.mode("overwrite").parquet(f"{where}/manifest")
    drop_cut(written)
    fs, base = _open(where)
    if fs.get_file_info(f"{base}/temporary").type != pafs.FileType.NotFound:
        fs.delete_dir(f"{base}/temporary")  # files of lost attempts
    return spark.read.parquet(f"{where}/manifest")


def _members_of(f: BinaryIO, size: int = 1 << 16) -> Iterator[bytes]:
    """The gzip members of a stream, decompressed, one at a time."""
    left = b""
    while left or (left := f.read(size)):
        z, parts = zlib.decompressobj(31), []
        while not z.eof:
            if not left and not (left := f.read(size)):
                raise ValueError("the archive ends within a record")
            parts.append(z.decompress(left))
            left = z.unused_data
        yield b"".join(parts)


def parse(data: bytes) -> dict:
    """Fields of one record, checked: lengths, block digest, and the payload digest of a response."""
    head, _, rest = data.partition(b"\r\n\r\n")
    version, *lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines)
    block = rest[: int(fields["Content-Length"])]
    if version != "WARC/1.1" or rest[len(block) :] != b"\r\n\r\n":
        raise ValueError("not a whole WARC record")
    if fields["WARC-Block-Digest"] != "sha1:" + base32(hashlib.sha1(block).digest()):
        raise ValueError(f"block digest of {fields['WARC-Record-ID']}")
    http, _, payload = block.partition(b"\r\n\r\n")
    length = next(int(x.split(b":")[1]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length:"))
    if fields["WARC-Type"] == "response" and (len(payload) != length or fields["WARC-Payload-Digest"] != "sha1:" + base32(hashlib.sha1(payload).digest())):
        raise ValueError(f"payload of {fields['WARC-Record-ID']}")
    refers = fields.get("WARC-Refers-To")
    return {
        "page_id": page_of(fields["WARC-Record-ID"]),
        "url": fields["WARC-Target-URI"],
        "record_type": fields["WARC-Type"],
        "payload_bytes": length,
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "refers_to": None if refers is None else page_of(refers),
        "record_id": fields["WARC-Record-ID"],
        "payload": payload if fields["WARC-Type"] == "response" else None,
    }


def read(spark: SparkSession, where: str, payloads: bool = True) -> DataFrame:
    """Every record of the archives that the manifest below ``where`` names, in no order, digests checked.

    Columns page_id, url (as escaped in the archive), record_type, payload_bytes,
    payload_digest, refers_to, record_id, and ``payload`` of responses (null with
    ``payloads=False``).  A file is read as a stream, one record in memory at a
    time; one that is shorter than the manifest says, or whose digest differs, is
    an error.
    """
    kinds = [("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("refers_to", pa.int64()), ("record_id", pa.string()), ("payload", pa.binary())]

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, base = _open(where)
        for b in batches:
            for name, records in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                held, size, seen = [], 0, 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as f:
                    for data in _members_of(f):
                        r = parse(data)
                        if not payloads:
                            r["payload"] = None
                        held.append(r)
                        size += len(r["payload"] or b"") + 300
                        seen += 1
                        if size > 4 << 20:
                            yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))
                            held, size = [], 0
                if seen != records:
                    raise ValueError(f"{name} holds {seen} records instead of {records}")
                yield pa.RecordBatch.from_pylist(held, pa.schema(kinds))

    files = spark.read.parquet(f"{where}/manifest").select("name", "records")
    n = max(1, min(10_000, files.count()))
    return files.repartition(n, "name").mapInArrow(work, "page_id long, url string, record_type string, payload_bytes long, payload_digest string, refers_to long, record_id string, payload binary")


def fresh_folder(spark: SparkSession) -> str:
    """A new folder name in the shared folder."""
    return f"{shared_dir(spark)}/numera-warc-{uuid.uuid4().hex}"
