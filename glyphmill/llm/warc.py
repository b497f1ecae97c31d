"""WARC archives: a deterministic sharded writer, and a reader that checks digests.

Records are range-sorted by page_id. Shard bounds come from a histogram of payload bytes over the id range, of which
buckets that are too large are cut further (a bounded number of counts reaches the driver, as the number of shards is
bounded), so equal tables give equal shards, and equal files byte by byte. A task writes its
shards in order, rolls a file when its compressed size is reached, writes under a name of its attempt in a staging
folder and renames it to its final one, so a repeated attempt puts the same bytes there. The manifest lists the files that count and is
committed last, by one rename; a folder without it is unfinished and never read.

Files are opened through pyarrow's file systems by URI, as Spark has no writer of binary files.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import math
import re
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TASK_BYTES, commit, exists, remove, scratch, written

#: Bits of the first histogram over ids, and by which a bucket that is too large is cut; shards in all, about.
BUCKET_BITS, FAN_BITS, MAX_SHARDS = 12, 5, 1 << 15
SHARD_BYTES, FILE_BYTES, LEAST_REVISIT = 32 << 20, 8 << 20, 100
DATE = "2024-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_MANIFEST = "shard int, file string, bytes long, records long, sha256 string"
_LENGTH = "X-Payload-Length"


def planned(pages: DataFrame, least: int = LEAST_REVISIT) -> DataFrame:
    """page_id, url, payload (null for a revisit), size, digest, refers_to.

    Of payloads that are equal and have at least `least` bytes, the least page_id is the response; rows that repeat it
    are responses as well. The join's other side has one row per repeated digest, so a hot payload can be split.
    """
    payload = F.coalesce(F.col("html"), F.lit("")).cast("binary")
    rows = pages.select("page_id", "url", payload.alias("payload"), F.octet_length(payload).cast("long").alias("size"), F.sha2(payload, 256).alias("digest"))
    firsts = rows.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    again = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    # written first, so that its size is known: where few payloads repeat, Spark sends them to the pages and not the pages to them
    firsts = written(firsts.select("digest", "first"), "repeated-payloads")
    return rows.join(firsts, "digest", "left").select(
        "page_id", "url", F.when(~again, F.col("payload")).alias("payload"), "size", "digest", F.when(again, F.col("first")).alias("refers_to")
    )


def sharded(rows: DataFrame, pages: DataFrame, shard_bytes: int) -> DataFrame:
    """rows with a shard by ranges of page_id of about shard_bytes each, or of a MAX_SHARDS-th of all bytes if that is more.

    Null ids come first. Rows of one id (or of none) that pass that size are dealt to more shards by url and digest.
    """
    spark = rows.sparkSession
    sizes = pages.select(F.col("page_id").cast("long").alias("id"), (F.coalesce(F.octet_length("html"), F.lit(0)) + 500).alias("n"))
    none = F.sum(F.when(F.col("id").isNull(), F.col("n")))
    whole = sizes.agg(F.min("id").alias("lo"), F.max("id").alias("hi"), F.sum("n").alias("n"), F.coalesce(none, F.lit(0)).alias("none")).first()
    if whole.n is None:
        return rows.withColumn("shard", F.lit(0))
    limit = max(shard_bytes, math.ceil(whole.n / MAX_SHARDS))
    # buckets are ids without their last `shift` bits; those over the limit are cut further
    shift = max(0, (whole.hi - whole.lo).bit_length() - BUCKET_BITS) if whole.lo is not None else 0
    left, shifts, leaves = sizes.where("id is not null"), [], []
    while True:
        counts = left.groupBy(F.shiftright("id", shift).alias("b")).agg(F.sum("n").alias("n")).collect()
        wide = {r.b for r in counts if r.n > limit} if shift else set()
        leaves += [(r.b << shift, len(shifts), r.b, r.n) for r in counts if r.b not in wide]
        shifts.append(shift)
        if not wide:
            break
        parents = spark.createDataFrame([(b,) for b in wide], "b long")
        left = left.join(F.broadcast(parents), F.shiftright("id", shift) == F.col("b"), "left_semi")
        shift = max(0, shift - FAN_BITS)
    ways = math.ceil(whole.none / limit)
    at, full, bounds = ways, 0, [[] for _ in shifts]
    for _, level, b, n in sorted(leaves):
        if full and full + n > limit:
            at, full = at + 1, 0
        many = max(1, math.ceil(n / limit))
        bounds[level].append((b, at, many))
        full += n
        if many > 1:
            at, full = at + many, 0
    shard, deal = F.lit(None).cast("int"), F.lit(None).cast("int")
    for k, found in enumerate(bounds):
        if found:  # FAN_BITS bits of buckets a shard at most, and shards are bounded
            table = spark.createDataFrame(found, f"_b{k} long, _s{k} int, _w{k} int")
            rows = rows.join(F.broadcast(table), F.shiftright(F.col("page_id").cast("long"), shifts[k]) == F.col(f"_b{k}"), "left")
            shard, deal = F.coalesce(shard, f"_s{k}"), F.coalesce(deal, f"_w{k}")
    turn = F.pmod(F.xxhash64("url", "digest"), F.coalesce(deal, F.lit(max(1, ways)))).cast("int")
    return rows.withColumn("shard", F.coalesce(shard, F.lit(0)) + turn)


def _uri(url: str) -> str:
    return quote(url, safe="%:/?#[]@!$&'()*+,;=~-._")


def _record(kind: str, name: str, fields: list[tuple[str, str]], block: bytes, date: str) -> bytes:
    head = [("WARC-Type", kind), ("WARC-Record-ID", name), ("WARC-Date", date), *fields]
    head += [("WARC-Block-Digest", "sha256:" + hashlib.sha256(block).hexdigest()), ("Content-Length", str(len(block)))]
    return b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"


def _page(page_id, url, payload, size, digest, refers_to, date: str) -> bytes:
    fields = [("WARC-Target-URI", _uri(url))] if url is not None else []
    fields += [("WARC-Payload-Digest", f"sha256:{digest}"), (_LENGTH, str(size)), ("Content-Type", "application/http; msgtype=response")]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    if refers_to is not None:
        fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
        return _record("revisit", f"<urn:page:{page_id}>", fields, http, date)
    return _record("response", f"<urn:page:{page_id}>", fields, http + payload, date)


def _zipped(record: bytes) -> bytes:
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(record) + packer.flush()


class _File:
    """An archive file under a name of its attempt in the staging folder, moved to its final name when it is whole."""

    def __init__(self, root: str, staging: str, name: str, date: str):
        self.system, folder = fs.FileSystem.from_uri(f"{root}/archive")
        _, aside = fs.FileSystem.from_uri(f"{root}/{staging}")
        for where in (folder, aside):
            self.system.create_dir(where, recursive=True)
        self.name, self.final, self.staged = name, f"{folder}/{name}", f"{aside}/{name}.{uuid.uuid4().hex}"
        self.out, self.hash, self.bytes, self.records = self.system.open_output_stream(self.staged, compression=None), hashlib.sha256(), 0, 0
        self._put(_record("warcinfo", f"<urn:file:{name}>", [("WARC-Filename", name), ("Content-Type", "application/warc-fields")], b"format: WARC File Format 1.1\r\n", date))

    def _put(self, record: bytes) -> None:
        packed = _zipped(record)
        self.out.write(packed)
        self.hash.update(packed)
        self.bytes += len(packed)

    def add(self, record: bytes) -> None:
        self._put(record)
        self.records += 1

    def close(self, shard: int) -> tuple:
        self.out.close()
        try:
            self.system.move(self.staged, self.final)
        except OSError:  # some stores don't replace: an attempt before this one has put the same bytes there
            if self.system.get_file_info(self.final).size != self.bytes:
                raise
        return shard, self.name, self.bytes, self.records, self.hash.hexdigest()


def write(pages: DataFrame, root: str, shard_bytes: int = SHARD_BYTES, file_bytes: int = FILE_BYTES, date: str = DATE) -> DataFrame:
    """Writes pages (page_id, url, html) under root, a URI, and returns the manifest.

    A null html is an empty payload, a null url gives no target, a null page_id is named null. Other columns are
    ignored; no rows give an empty manifest. A root that has a manifest fails.
    """
    spark = pages.sparkSession
    if exists(spark, f"{root}/manifest"):
        raise FileExistsError(f"{root} has been written")
    staging = f"_staging-{uuid.uuid4().hex}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done: list[tuple] = []
        at, seq, file = None, 0, None
        for batch in batches:
            for shard, *page in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if file and (shard != at or file.bytes >= file_bytes):
                    done.append(file.close(at))
                    file = None
                if shard != at:
                    at, seq = shard, 0
                if file is None:
                    file, seq = _File(root, staging, f"pages-{shard:06d}-{seq:05d}.warc.gz", date), seq + 1
                file.add(_page(*page, date))
        if file:
            done.append(file.close(at))
        for row in done:
            yield pa.RecordBatch.from_pylist([dict(zip(("shard", "file", "bytes", "records", "sha256"), row, strict=True))], schema=pa.schema([("shard", pa.int32()), ("file", pa.string()), ("bytes", pa.int64()), ("records", pa.int64()), ("sha256", pa.string())]))

    rows = sharded(planned(pages), pages, shard_bytes).select("shard", "page_id", "url", "payload", "size", "digest", "refers_to")
    in_order = rows.repartitionByRange("shard").sortWithinPartitions("shard", "page_id", "url", "digest")
    staged = scratch(spark, "manifest")
    in_order.mapInArrow(run, _MANIFEST).write.parquet(staged)
    remove(spark, f"{root}/{staging}")  # what dead attempts left
    if not commit(spark, staged, f"{root}/manifest"):
        raise FileExistsError(f"{root} has been written")
    return spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")


def _records(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    while line := stream.readline():
        if not line.startswith(b"WARC/"):
            raise ValueError(f"not a record: {line[:40]!r}")
        head = {}
        while (line := stream.readline().rstrip(b"\r\n")):
            name, _, value = line.decode().partition(": ")
            head[name] = value
        block = stream.read(int(head["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError("a record doesn't end where it should")
        yield head, block


def _number(name: str | None) -> int | None:
    found = re.fullmatch(r"<urn:page:(-?\d+)>", name or "")
    return int(found[1]) if found else None


def read(spark: SparkSession, root: str, with_payload: bool = False) -> DataFrame:
    """page_id, url, payload_bytes, payload_digest, record_type, refers_to of the archives that the manifest lists.

    Block digests of all records and payload digests of responses are checked; a mismatch fails. payload is null for
    revisits, and unless with_payload is set.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file in batch.column(0).to_pylist():
                system, path = fs.FileSystem.from_uri(f"{root}/archive/{file}")
                rows: list[tuple] = []
                with system.open_input_stream(path, compression=None) as raw, gzip.GzipFile(fileobj=io.BufferedReader(raw)) as stream:
                    for head, block in _records(stream):
                        if "sha256:" + hashlib.sha256(block).hexdigest() != head["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: {head['WARC-Record-ID']} has another digest")
                        kind = head["WARC-Type"]
                        if kind == "warcinfo":
                            continue
                        digest = head["WARC-Payload-Digest"].removeprefix("sha256:")
                        payload = block.partition(b"\r\n\r\n")[2] if kind == "response" else None
                        if payload is not None and hashlib.sha256(payload).hexdigest() != digest:
                            raise ValueError(f"{file}: {head['WARC-Record-ID']} has another payload digest")
                        size = len(payload) if payload is not None else int(head[_LENGTH])
                        rows.append((_number(head["WARC-Record-ID"]), head.get("WARC-Target-URI"), size, digest, kind, _number(head.get("WARC-Refers-To")), payload if with_payload else None))
                        if len(rows) == 500:
                            yield _batch(rows)
                            rows = []
                yield _batch(rows)

    kind = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"
    listed = spark.read.schema(_MANIFEST).parquet(f"{root}/manifest")
    whole = listed.agg(F.count("*").alias("files"), F.coalesce(F.sum("bytes"), F.lit(0)).alias("bytes")).first()
    # the manifest is small whatever the archive's size, so its rows are dealt by the bytes that they stand for
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    tasks = max(1, min(whole.files, max(least, -(-whole.bytes // TASK_BYTES))))
    return listed.select("file").repartition(tasks).mapInArrow(run, kind)


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    names = ("page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload")
    kinds = (pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in rows], schema=pa.schema(list(zip(names, kinds, strict=True))))
