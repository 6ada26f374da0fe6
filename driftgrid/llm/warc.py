"""A deterministic, sharded WARC writer and its reader.

Which record goes to which shard depends on the data alone. The bytes before
each ``page_id`` are measured exactly, and the ids are cut into ranges of
``shard_bytes``, or of a ``BINS``-th of the whole if that is more. A range is a
shard; one that holds more than ``shard_bytes``, because the table is large or
one id has many rows, is dealt to several shards by a hash of the row. There is
no bound on the number of shards. Each is sorted by ``page_id`` and digest and
written by one task as gzip members, one per record, in files that roll at
``roll_bytes``. Headers, record ids and digests are made from the rows.

A file is written under a temporary name of the attempt. The attempts that
count are those whose rows reach the stored list of files; a second job moves
these files to their final names, which it may do twice without harm, and the
manifest is written last. The reader reads only what the manifest names, so
files of lost or repeated attempts are never seen.

Defined cases: a null html is an empty payload; a null url has no target
header; a null ``page_id`` sorts first and is never referred to unless all
equal payloads have none; rows that repeat the smallest ``page_id`` of a payload
are all responses. Any long is a ``page_id``. Rows equal in id, url and payload
share a shard, which its task writes as a stream. Other columns are not carried.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs as pafs
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from driftgrid.deploy import ship
from driftgrid.llm import places
from driftgrid.scale import durable

#: Ranges of ids at most; their edges are held by the driver.
BINS = 1 << 15
#: Tasks at most, beyond the session's shuffle partitions; a task with several shards writes one after the other.
TASKS = 20_000
DATE = "2020-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
FILES = "name string, temporary string, records long, bytes long, sha256 string"
RECORDS = "page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def _record_id(page_id, digest: str) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.sha256(f'{page_id} {digest}'.encode()).digest()[:16], version=5)}>"


def _url(url: str) -> str:
    return "".join(c if c > " " and c != "\x7f" else "".join(f"%{b:02X}" for b in c.encode()) for c in url)


def record(page_id, url, payload: bytes | None, size: int, digest: str, refers_to=None) -> bytes:
    """A response, or a revisit if ``payload`` is None."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"")
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if payload is None else 'response'}", f"WARC-Record-ID: {_record_id(page_id, digest)}", f"WARC-Date: {DATE}"]
    if url is not None:
        head.append(f"WARC-Target-URI: {_url(url)}")
    if page_id is not None:
        head.append(f"Page-Id: {page_id}")
    if payload is None:
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_record_id(refers_to, digest)}", f"Refers-To-Page-Id: {refers_to}"]
    head += [
        "Content-Type: application/http;msgtype=response",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}",
        f"Content-Length: {len(block)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def member(data: bytes) -> bytes:
    """One gzip member without a time stamp."""
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


class _File:
    def __init__(self, folder: str, name: str):
        self.fs, base = pafs.FileSystem.from_uri(folder)
        self.name, self.temporary = name, f"{base}/_temporary/{name}.{uuid.uuid4().hex}"
        self.fs.create_dir(f"{base}/_temporary", recursive=True)
        self.out, self.sum, self.bytes, self.records = self.fs.open_output_stream(self.temporary), hashlib.sha256(), 0, 0
        body = f"format: WARC File Format 1.1\r\nfilename: {name}\r\n".encode()
        head = f"WARC/1.1\r\nWARC-Type: warcinfo\r\nWARC-Record-ID: {_record_id(name, '')}\r\nWARC-Date: {DATE}\r\nContent-Type: application/warc-fields\r\nContent-Length: {len(body)}\r\n\r\n"
        self.put(head.encode() + body + b"\r\n\r\n")
        self.records = 0

    def put(self, data: bytes) -> None:
        packed = member(data)
        self.out.write(packed)
        self.sum.update(packed)
        self.bytes += len(packed)
        self.records += 1

    def close(self) -> pa.RecordBatch:
        self.out.close()
        row = {"name": self.name, "temporary": self.temporary, "records": self.records, "bytes": self.bytes, "sha256": self.sum.hexdigest()}
        return pa.RecordBatch.from_pylist([row])


def _ranged(rows: DataFrame, edges: list[float]) -> DataFrame:
    """``rows`` with ``bin``, the range of their ``page_id``: 0 without one, then one for each edge it reaches."""
    number = rows.withColumn("number_", F.coalesce(F.col("page_id").cast("double"), F.lit(0.0)))
    cuts = [-float("inf"), *edges[1:], float("inf")]  # all ids reach the first edge
    if len(cuts) > 2:
        number = Bucketizer(splits=cuts, inputCol="number_", outputCol="range_").transform(number)
    else:
        number = number.withColumn("range_", F.lit(0.0))
    return number.withColumn("bin", F.when(F.col("page_id").isNull(), 0).otherwise(F.col("range_").cast("int") + 1)).drop("number_", "range_")


def _shards(meta: DataFrame, shard_bytes: int) -> tuple[list[float], DataFrame, int]:
    """The first ids of the ranges, the ranges with their first shard and number of shards, and the number of shards.

    Ids count as doubles here, so very long ones that lie close together are of one range.
    """
    sized = meta.select("page_id", (F.col("size") + 512).alias("bytes"))
    ids = durable(sized.where(F.col("page_id").isNotNull()).groupBy(F.col("page_id").cast("double").alias("number")).agg(F.sum("bytes").alias("bytes")))
    step = max(shard_bytes, -(-(ids.agg(F.sum("bytes")).first()[0] or 1) // BINS))
    cut = places.before(ids, [], ["number"], "before", "bytes").groupBy(F.floor(F.col("before") / step)).agg(F.min("number").alias("edge"))
    edges = sorted(r.edge for r in cut.select("edge").collect())  # at most BINS + 1
    held = _ranged(sized, edges).groupBy("bin").agg(F.sum("bytes").alias("bytes"))
    parts = F.when(F.col("bytes") <= 2 * shard_bytes, 1).otherwise(F.ceil(F.col("bytes") / shard_bytes)).cast("long")
    earlier = Window.orderBy("bin").rowsBetween(Window.unboundedPreceding, -1)  # at most BINS + 2 rows
    bins = durable(held.select("bin", parts.alias("parts")).withColumn("first", F.coalesce(F.sum("parts").over(earlier), F.lit(0))))
    return edges, bins, bins.agg(F.sum("parts")).first()[0] or 1


def write(pages: DataFrame, folder: str, shard_bytes: int = 16 << 20, roll_bytes: int = 1 << 30, least: int = 100) -> DataFrame:
    """Writes the archives below ``folder`` and returns the manifest, which it stores there too.

    Of equal payloads of ``least`` bytes or more the one with the smallest ``page_id`` is written, the others revisit it.
    """
    spark = pages.sparkSession
    ship(spark)
    body = F.coalesce("html", F.lit(""))
    rows = pages.select("page_id", "url", body.cast("binary").alias("payload"), F.sha2(body.cast("binary"), 256).alias("digest"), F.octet_length(body).cast("long").alias("size"))
    meta = durable(rows.select("page_id", "digest", "size"))
    again = durable(meta.where(F.col("size") >= least).groupBy("digest").agg(F.min("page_id").alias("first_page"), F.count("*").alias("n")).where("n > 1").drop("n"))
    edges, bins, count = _shards(meta, shard_bytes)
    revisit = F.col("first_page").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first_page"))
    placed = (
        _ranged(rows.join(again, "digest", "left"), edges)
        .join(F.broadcast(bins), "bin")  # at most BINS + 2 rows
        .select(
            (F.col("first") + F.pmod(F.xxhash64("page_id", "digest", "url"), F.col("parts"))).alias("shard"),
            "page_id",
            "url",
            F.when(~revisit, F.col("payload")).alias("payload"),
            "size",
            "digest",
            F.when(revisit, F.col("first_page")).alias("refers_to"),
        )
    )
    tasks = min(count, max(TASKS, int(spark.conf.get("spark.sql.shuffle.partitions"))))
    placed = placed.repartitionById(tasks, F.pmod("shard", F.lit(tasks)).cast("int")).sortWithinPartitions("shard", "page_id", "digest", "url")

    def run(batches):
        file, shard, roll = None, None, 0
        for batch in batches:
            for i in range(batch.num_rows):
                place, page_id, url, payload, size, digest, refers_to = (c[i].as_py() for c in batch.columns)
                if file is None or place != shard or file.bytes >= roll_bytes:
                    if file is not None:
                        yield file.close()
                    roll = roll + 1 if place == shard else 0
                    shard = place
                    file = _File(folder, f"pages-{shard:08d}-{roll:04d}.warc.gz")
                file.put(record(page_id, url, payload, size, digest, refers_to))
        if file is not None:
            yield file.close()

    files = durable(placed.mapInArrow(run, FILES))

    def commit(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, temporary in zip(batch.column("name").to_pylist(), batch.column("temporary").to_pylist()):
                if fs.get_file_info(temporary).type == pafs.FileType.File:
                    fs.move(temporary, f"{base}/{name}")
                elif fs.get_file_info(f"{base}/{name}").type != pafs.FileType.File:
                    raise FileNotFoundError(f"neither {temporary} nor {name} is there")
            yield batch.select(["name", "records", "bytes", "sha256"])

    moved = files.repartition("name").mapInArrow(commit, "name string, records long, bytes long, sha256 string")
    moved.write.parquet(f"{folder}/manifest")
    return spark.read.schema(moved.schema).parquet(f"{folder}/manifest")


def members(stream, chunk: int = 1 << 20) -> Iterator[bytes]:
    """The gzip members of a file one after the other; holds one member at a time."""
    z, out, data = zlib.decompressobj(31), [], b""
    while data or (data := stream.read(chunk)):
        out.append(z.decompress(data))
        data = z.unused_data
        if z.eof:
            yield b"".join(out)
            z, out = zlib.decompressobj(31), []
    if any(out):
        raise EOFError("the archive ends within a record")


def parse(data: bytes) -> dict | None:
    """A row of ``RECORDS`` from a record, whose digests must hold; None for other records."""
    head, _, rest = data.partition(b"\r\n\r\n")
    fields = dict(line.split(": ", 1) for line in head.decode().split("\r\n")[1:])
    if fields["WARC-Type"] not in ("response", "revisit"):
        return None
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    size = int(next(v for k, v in (x.split(": ", 1) for x in http.decode().split("\r\n")[1:]) if k == "Content-Length"))
    digest, response = fields["WARC-Payload-Digest"].removeprefix("sha256:"), fields["WARC-Type"] == "response"
    if hashlib.sha256(block).hexdigest() != fields["WARC-Block-Digest"].removeprefix("sha256:") or response and (len(payload), hashlib.sha256(payload).hexdigest()) != (size, digest):
        raise ValueError(f"a digest of record {fields['WARC-Record-ID']} is wrong")
    number = lambda name: int(fields[name]) if fields.get(name, "None") != "None" else None
    return {
        "page_id": number("Page-Id"),
        "url": fields.get("WARC-Target-URI"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("Refers-To-Page-Id"),
        "payload_bytes": size,
        "payload_digest": digest,
        "payload": payload if response else None,
    }


def read(spark: SparkSession, folder: str, manifest: DataFrame | None = None, batch_bytes: int = 8 << 20) -> DataFrame:
    """The records of the archives that the manifest names, in rows of ``RECORDS``."""
    ship(spark)
    manifest = spark.read.parquet(f"{folder}/manifest") if manifest is None else manifest
    schema = pa.schema([("page_id", pa.int64()), ("url", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary())])

    def run(batches):
        fs, base = pafs.FileSystem.from_uri(folder)
        for batch in batches:
            for name in batch.column(0).to_pylist():
                rows, held = [], 0
                with fs.open_input_stream(f"{base}/{name}", compression=None) as stream:
                    for data in members(stream):
                        if (row := parse(data)) is not None:
                            rows.append(row)
                            held += len(data)
                        if held >= batch_bytes:
                            yield pa.RecordBatch.from_pylist(rows, schema)
                            rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, schema)

    return manifest.select("name").repartition(max(1, manifest.count()), "name").mapInArrow(run, RECORDS)  # a task per file
