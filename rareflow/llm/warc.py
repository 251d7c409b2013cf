"""WARC archives: a deterministic sharded writer, and a reader.

Records are put in order of page id, cut into ranges, one task per range. The bounds come from a sample
chosen by a hash of the id, so they depend on the rows alone and reruns make the same files. Every
page is packed into a gzip member of its own before the shuffle. A task streams its sorted members, starts a new file when the compressed size reaches the
limit, writes under a temporary name and renames a finished file. The manifest, written last by Spark's own
committer, names the files that count; what a lost attempt left is never read.

Equal payloads of ``REVISIT_BYTES`` or more are stored once. Which page keeps the payload is decided on
(id, digest, length) rows alone; the decisions of duplicates travel to the writer as rows of their own beside
the pages, so the pages themselves are shuffled once, and a payload that a third of all pages share only
meets a maximum per task. Headers and digests are made anew from the payload.

Cases: a null payload is empty, a null url becomes ``urn:page:`` and the id. Line breaks in a url are
percent-encoded. Rows with a null id come first; they never keep a shared payload unless no row has an id.
Of rows equal in id and payload one is a response, the others revisit it. An empty table makes no file.
Other columns are ignored. Payloads of any length are handled one at a time.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import uuid
import zlib
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyarrow import fs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import shared_dir, stage_table

#: Payloads from this length on are stored once.
REVISIT_BYTES = 1000
#: Payload bytes of a range, if that makes no more than SHARDS ranges; compressed bytes of a file.
SHARD_BYTES = 16 << 20
SHARDS = 10_000
FILE_BYTES = 256 << 20
#: Ids looked at for each bound.
SAMPLE = 100
#: The date of all records; a crawl's own date would be a column.
DATE = "2024-01-01T00:00:00Z"
#: Fixed names of the format.
VERSION = b"WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

MANIFEST = "file string, shard int, records long, bytes long, sha1 string, first long, last long"
READ = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string,"
    " refers_to long, payload binary"
)


def _base32(hex_digest: str) -> str:
    return "sha1:" + base64.b32encode(bytes.fromhex(hex_digest)).decode()


def _lines(first: bytes, fields: list[tuple[str, Any]]) -> bytes:
    told = [f"{k}: {v}".encode("utf-8", "surrogatepass") for k, v in fields if v is not None]
    return b"\r\n".join([first, *told, b"", b""])


def record(
    page_id: int | None, url: str | None, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool
) -> bytes:
    """One uncompressed record; a revisit has the head of the response and no payload."""
    uri = f"urn:page:{page_id}" if url is None else url.replace("\r", "%0D").replace("\n", "%0A").strip()
    block = _lines(b"HTTP/1.1 200 OK", [("Content-Type", "text/html; charset=utf-8"), ("Content-Length", size)])
    if not revisit:
        block += payload
    name = uuid.uuid5(uuid.NAMESPACE_URL, f"{page_id} {digest} {revisit} {uri}")
    head = _lines(
        VERSION,
        [
            ("WARC-Type", "revisit" if revisit else "response"),
            ("WARC-Record-ID", f"<urn:uuid:{name}>"),
            ("WARC-Date", DATE),
            ("WARC-Target-URI", uri),
            ("WARC-Payload-Digest", _base32(digest)),
            ("WARC-Block-Digest", _base32(hashlib.sha1(block).hexdigest())),
            ("WARC-Profile", PROFILE if revisit else None),
            ("X-Page-ID", page_id),
            ("X-Url", json.dumps(url) if url is None or url != uri else None),
            ("X-Payload-Length", size),
            ("X-Refers-To-Page-ID", refers_to if revisit else None),
            ("Content-Type", "application/http; msgtype=response"),
            ("Content-Length", len(block)),
        ],
    )
    return head + block + b"\r\n\r\n"


def pack(data: bytes) -> bytes:
    """A record as a gzip member, the same bytes each time."""
    packer = zlib.compressobj(6, zlib.DEFLATED, 31)
    return packer.compress(data) + packer.flush()


def _members(rows: DataFrame) -> DataFrame:
    """Pages with their finished response instead of the payload, so that only packed bytes are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, members = [], []
            for page_id, url, payload, digest in zip(*batch.columns, strict=True):
                data = payload.as_py()
                sizes.append(len(data))
                members.append(pack(record(page_id.as_py(), url.as_py(), data, len(data), digest.as_py(), None, False)))
            columns = [batch.column(0), batch.column(1), batch.column(3), pa.array(sizes, pa.int64()), pa.array(members, pa.binary())]
            yield pa.RecordBatch.from_arrays(columns, ["page_id", "url", "digest", "size", "member"])

    told = rows.select("page_id", "url", "payload", F.sha1("payload").alias("digest"))
    return told.mapInArrow(run, "page_id long, url string, digest string, size long, member binary")


class _Files:
    """The files of one shard, one open at a time."""

    def __init__(self, base: str, limit: int):
        self.store, self.root = fs.FileSystem.from_uri(base)
        self.limit, self.out, self.seq, self.shard = limit, None, 0, -1

    def add(self, shard: int, page_id: int | None, member: bytes) -> Iterator[tuple]:
        if shard != self.shard:
            yield from self.close()
            self.shard, self.seq = shard, 0
        if self.out is None:
            self.draft = f"{self.root}/_temporary/{uuid.uuid4().hex}"
            self.store.create_dir(f"{self.root}/_temporary", recursive=True)
            self.out = self.store.open_output_stream(self.draft, compression=None)
            self.records, self.bytes, self.sha1, self.first = 0, 0, hashlib.sha1(), page_id
        self.out.write(member)
        self.sha1.update(member)
        self.records, self.bytes, self.last = self.records + 1, self.bytes + len(member), page_id
        if self.bytes >= self.limit:
            yield from self.close()

    def close(self) -> Iterator[tuple]:
        if self.out is None:
            return
        self.out.close()
        self.out = None
        name = f"shard-{self.shard:05d}-{self.seq:05d}.warc.gz"
        self.seq += 1
        self.store.move(self.draft, f"{self.root}/{name}")
        yield name, self.shard, self.records, self.bytes, self.sha1.hexdigest(), self.first, self.last


def _bounds(slim: DataFrame, shards: int) -> list[float]:
    """Inner bounds of the ranges, from ids chosen by hash; at most about ``SAMPLE`` per range."""
    if shards < 2:
        return []
    every = max(1, slim.count() // (SAMPLE * shards))
    chosen = slim.filter(F.pmod(F.xxhash64("page_id"), F.lit(every)) == 0)
    ids = sorted(float(r[0]) for r in chosen.select("page_id").distinct().collect() if r[0] is not None)
    return sorted({ids[len(ids) * i // shards] for i in range(1, shards)}) if ids else []


def _decisions(slim: DataFrame) -> DataFrame:
    """page_id, digest, keeper: for rows whose payload occurs more than once."""
    large = slim.filter(F.col("n") >= REVISIT_BYTES)
    shared = large.groupBy("digest").agg(F.max("page_id").alias("keeper"), F.count(F.lit(1)).alias("c"))
    return large.join(shared.filter("c > 1").drop("c"), "digest").select("page_id", "digest", "keeper").distinct()


def write_archives(
    pages: DataFrame,
    base: str,
    id_col: str = "page_id",
    url_col: str = "url",
    payload_col: str = "html",
    shard_bytes: int = SHARD_BYTES,
    file_bytes: int = FILE_BYTES,
) -> DataFrame:
    """Write the pages under ``base`` and return the manifest, read from where it was committed."""
    spark = pages.sparkSession
    payload = F.coalesce(F.col(f"`{payload_col}`"), F.lit("")).cast("binary")
    rows = pages.select(
        F.col(f"`{id_col}`").cast("long").alias("page_id"), F.col(f"`{url_col}`").alias("url"), payload.alias("payload")
    )
    slim = stage_table(
        rows.select("page_id", F.sha1("payload").alias("digest"), F.octet_length("payload").alias("n")), "digests"
    )
    total = slim.agg(F.sum(F.col("n").cast("long"))).first()[0] or 0
    bounds = _bounds(slim, min(SHARDS, total // shard_bytes + 1))
    low, high = -float("inf"), float("inf")
    cut = Bucketizer(splits=[low, *(bounds or [0.0]), high], inputCol="_at", outputCol="_shard")
    nothing = F.lit(None)
    told = _decisions(slim).select(
        "page_id", nothing.cast("string").alias("url"), "digest", nothing.cast("long").alias("size"),
        nothing.cast("binary").alias("member"), "keeper", F.lit(0).alias("kind"),
    )
    both = told.unionByName(_members(rows).select("*", nothing.cast("long").alias("keeper"), F.lit(1).alias("kind")))
    at = F.coalesce(F.col("page_id").cast("double"), F.lit(low))
    sharded = cut.transform(both.withColumn("_at", at)).withColumn("shard", F.col("_shard").cast("int"))
    order = ["shard", F.asc_nulls_first("page_id"), "kind", "digest", F.asc_nulls_first("url")]
    columns = ["shard", "page_id", "url", "digest", "size", "member", "keeper", "kind"]
    dealt = sharded.select(*columns).repartitionById(max(2, len(bounds) + 1), F.col("shard")).sortWithinPartitions(*order)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = _Files(base, file_bytes)
        done: list[tuple] = []
        keepers: dict[str, int | None] = {}
        kept: set[str] = set()
        current: tuple = ()
        for batch in batches:
            for row in zip(*[c for c in batch.columns], strict=True):
                shard, page_id, url, digest, size, member, keeper, kind = (x.as_py() for x in row)
                if (page_id,) != current:
                    current, keepers, kept = (page_id,), {}, set()
                if kind == 0:
                    keepers[digest] = keeper
                    continue
                is_revisit = digest in keepers and (keepers[digest] != page_id or digest in kept)
                kept.add(digest)
                if is_revisit:
                    member = pack(record(page_id, url, b"", size, digest, keepers[digest], True))
                done += files.add(shard, page_id, member)
        done += files.close()
        kinds = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64()]
        names = ["file", "shard", "records", "bytes", "sha1", "first", "last"]
        lists = list(zip(*done, strict=True)) or [()] * len(kinds)
        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], names)

    dealt.mapInArrow(run, MANIFEST).write.parquet(f"{base}/manifest")
    return spark.read.schema(MANIFEST).parquet(f"{base}/manifest")


def _records(stream: Any) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers and block of each record of an uncompressed stream."""
    while True:
        line = stream.readline()
        if not line:
            return
        if not line.strip():
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError(f"no record begins with {line[:40]!r}")
        fields: dict[str, str] = {}
        while (line := stream.readline()).strip():
            name, _, value = line.decode("utf-8", "surrogatepass").partition(":")
            fields[name.lower()] = value.strip()
        yield fields, stream.read(int(fields["content-length"]))


def _parsed(fields: dict[str, str], block: bytes) -> tuple:
    if _base32(hashlib.sha1(block).hexdigest()) != fields["warc-block-digest"]:
        raise ValueError(f"block of {fields['warc-record-id']} does not match its digest")
    digest = base64.b32decode(fields["warc-payload-digest"].removeprefix("sha1:")).hex()
    kind, size, payload = fields["warc-type"], int(fields["x-payload-length"]), None
    if kind == "response":
        payload = block.partition(b"\r\n\r\n")[2]
        if hashlib.sha1(payload).hexdigest() != digest or len(payload) != size:
            raise ValueError(f"payload of {fields['warc-record-id']} does not match its digest")
    number = lambda name: int(fields[name]) if name in fields else None
    url = json.loads(fields["x-url"]) if "x-url" in fields else fields["warc-target-uri"]
    return number("x-page-id"), url, size, digest, kind, number("x-refers-to-page-id"), payload


def read_archives(spark: SparkSession, base: str, payloads: bool = True) -> DataFrame:
    """One row per record of the files the manifest names, every digest verified.

    ``payload`` is null for revisits, and for all if ``payloads`` is false.
    """
    manifest = spark.read.schema(MANIFEST).parquet(f"{base}/manifest")
    names = [f.split(" ")[0] for f in READ.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(base)
        for batch in batches:
            for file in batch.column(0).to_pylist():
                with store.open_input_stream(f"{root}/{file}", compression=None) as raw, gzip.open(raw) as stream:
                    rows: list[tuple] = []
                    size = 0
                    for fields, block in _records(stream):
                        rows.append(_parsed(fields, block)[: None if payloads else -1])
                        size += len(block) if payloads else 100
                        if size > 8 << 20:
                            yield table(rows)
                            rows, size = [], 0
                    yield table(rows)

    def table(rows: list[tuple]) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]
        full = [r if payloads else (*r, None) for r in rows]
        lists = list(zip(*full, strict=True)) or [()] * len(kinds)
        return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(lists, kinds, strict=True)], names)

    n = spark.sparkContext.defaultParallelism
    return manifest.select("file").repartition(max(n, manifest.count() // 4)).mapInArrow(run, READ)


def archive_folder(spark: SparkSession) -> str:
    """A new folder in the shared one."""
    base = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    return base if "://" in base or base.startswith("file:") else f"file://{base}"
