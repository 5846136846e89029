"""WARC archives by a deterministic sharded writer, and their reader.

Records are range-sorted by a hash of the page id, the payload and the url: shard n holds the n-th of
`shards` equal ranges of hash values, and is sorted by hash, id and digest, so files depend on the
records alone, not on how Spark dealt them.  A shard rolls to a new file once the compressed size of the
current one reaches `roll_bytes`; a shard holds several times that.  Headers and digests are made anew
from the payload.  A file is written under a temporary name of its attempt, in a folder for such, and
renamed when complete.  What a shard's task has committed is told in the manifest, a table beside the
files that is itself written under a temporary name and renamed last; then the folder of temporary files
goes, with whatever lost attempts have left there.  Only files named in the manifest count.

Of records with equal payloads of at least LEAST_BYTES bytes, the one with the largest page id is a
response and the others are revisits of it without a payload.

Defined results: a null html is an empty payload.  Rows that repeat the largest id with the same payload
are all responses; a null id is below all others.  An empty table gives a manifest without files and no
row.  Payloads of any length are written whole.  Only id, url and html are read, so other columns may
have any name.  Rows equal in id, url and html share a shard.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from linkloom.llm.tables import lookup, read, scratch, small_batches, stage

LEAST_BYTES = 1000
#: Payload of a shard (a task), compressed size at which a file ends: markup shrinks to about a fifth, so a shard makes about two files.
SHARD_BYTES, ROLL_BYTES = 64 << 20, 8 << 20
MAX_SHARDS = 1 << 20
MANIFEST, TEMPORARY = "manifest", "_temporary-files"
#: Field names and texts of the WARC 1.1 format.
_DATE, _PROFILE = "1970-01-01T00:00:00Z", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
_NAMESPACE = uuid.UUID(int=0x6C696E6B6C6F6F6D)


def plan(pages: DataFrame, key: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES) -> tuple[DataFrame, int]:
    """What is to be written: shard, order, id, url, payload (null for revisits), bytes, digest, refers; and the number of shards."""
    payload = F.coalesce(F.col(html), F.lit("")).cast("binary")
    rows = pages.select(F.col(key).cast("long").alias("id"), F.col(url).cast("string").alias("url"), payload.alias("payload"))
    known = stage(rows.select("id", F.length("payload").cast("long").alias("bytes"), F.unhex(F.sha2("payload", 256)).alias("same")), "warc-ids")
    largest = stage(known.where(F.col("bytes") >= LEAST_BYTES).groupBy("same").agg(F.max("id").alias("largest"), F.count(F.lit(1)).alias("n")).where("n > 1").select("same", "largest"), "warc-largest")
    total = known.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]
    shards = max(1, min(MAX_SHARDS, -(-total // shard_bytes)))
    refers = stage(lookup(known.where(F.col("bytes") >= LEAST_BYTES), largest, "same").where(~F.col("largest").eqNullSafe(F.col("id")) & F.col("largest").isNotNull()).select(F.col("id").alias("rid"), F.col("same").alias("rsame"), F.col("largest").alias("refers")).distinct(), "warc-refers")
    full = rows.withColumns({"order": F.xxhash64("id", "payload", "url"), "bytes": F.length("payload").cast("long"), "digest": F.sha1("payload"), "same": F.unhex(F.sha2("payload", 256))})
    full = full.join(refers, F.col("id").eqNullSafe(F.col("rid")) & (F.col("same") == F.col("rsame")), "left")
    # The top 32 bits of the hash, from 0 to 2^32, times the shards over 2^32.
    place = F.shiftright((F.shiftright("order", 32) + F.lit(1 << 31)) * F.lit(shards), 32).cast("int")
    return full.select(place.alias("shard"), "order", "id", "url", F.when(F.col("refers").isNull(), F.col("payload")).alias("payload"), "bytes", "digest", "refers"), shards


def record(id_: int | None, url: str | None, payload: bytes | None, size: int, digest: str, refers: int | None) -> bytes:
    """One WARC record; a payload of None makes a revisit."""
    block = _HTTP + (payload or b"")
    name = lambda x: f"<urn:uuid:{uuid.uuid5(_NAMESPACE, str(x))}>"
    fields = [
        ("WARC-Type", "response" if payload is not None else "revisit"),
        ("WARC-Record-ID", name(f"{id_}/{digest}")),
        ("WARC-Date", _DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Block-Digest", f"sha1:{hashlib.sha1(block).hexdigest()}"),
        ("X-Page-ID", "" if id_ is None else str(id_)),
        ("X-Payload-Length", str(size)),
        *([] if payload is not None else [("WARC-Profile", _PROFILE), ("WARC-Refers-To", name(f"{refers}/{digest}")), ("X-Refers-To-Page-ID", str(refers))]),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields) + "\r\n"
    return gzip.compress(head.encode() + block + b"\r\n\r\n", compresslevel=6, mtime=0)


def _open(uri: str) -> tuple[pa.fs.FileSystem, str]:
    return pa.fs.FileSystem.from_uri(_address(uri))


class _Roller:
    """Writes the files of one shard after another and tells what it has committed."""

    def __init__(self, folder: str, roll_bytes: int) -> None:
        self.fs, self.root = _open(folder)
        self.roll, self.attempt, self.shard, self.part, self.out = roll_bytes, uuid.uuid4().hex, None, 0, None
        self.done: list[tuple] = []

    def close(self) -> None:
        if self.out is not None:
            self.out.close()
            name = f"shard-{self.shard:07d}-{self.part:05d}.warc.gz"
            self.fs.move(self.temporary, f"{self.root}/{name}")
            self.done.append((self.shard, name, self.records, self.size, self.sha.hexdigest()))
            self.out = None
            self.part += 1

    def add(self, shard: int, data: bytes) -> None:
        if shard != self.shard:
            self.close()
            self.shard, self.part = shard, 0
        if self.out is None:
            self.fs.create_dir(f"{self.root}/{TEMPORARY}", recursive=True)
            self.temporary = f"{self.root}/{TEMPORARY}/{self.attempt}-{shard:07d}-{self.part:05d}"
            self.out, self.records, self.size, self.sha = self.fs.open_output_stream(self.temporary), 0, 0, hashlib.sha1()
        self.out.write(data)
        self.records, self.size = self.records + 1, self.size + len(data)
        self.sha.update(data)
        if self.size >= self.roll:
            self.close()


def _writer(folder: str, roll_bytes: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        roller = _Roller(folder, roll_bytes)
        for batch in batches:
            for shard, *row in zip(*(batch.column(n) for n in ("shard", "id", "url", "payload", "bytes", "digest", "refers")), strict=True):
                roller.add(shard.as_py(), record(*(x.as_py() for x in row)))
        roller.close()
        columns = list(zip(*roller.done, strict=True)) or [[]] * 5
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()), strict=True)], names=["shard", "file", "records", "bytes", "sha1"])

    return run


def _move(spark: SparkSession, old: str, new: str | None) -> None:
    """Renames a folder, over another if there is one, or removes it."""
    path = lambda p: spark._jvm.org.apache.hadoop.fs.Path(p)
    fs = path(old).getFileSystem(spark._jsc.hadoopConfiguration())
    if new is None:
        fs.delete(path(old), True)
        return
    fs.delete(path(new), True)
    if not fs.rename(path(old), path(new)):
        raise OSError(f"{old} could not be renamed")


def _address(folder: str) -> str:
    return folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"


def write(pages: DataFrame, folder: str, key: str = "page_id", url: str = "url", html: str = "html", shard_bytes: int = SHARD_BYTES, roll_bytes: int = ROLL_BYTES) -> DataFrame:
    """Writes the archives and their manifest to folder (any address that both pyarrow and Spark open, or a shared path); gives the manifest."""
    spark, root = pages.sparkSession, _address(folder)
    small_batches(spark)
    _move(spark, f"{root}/{TEMPORARY}", None)
    _move(spark, f"{root}/{MANIFEST}", None)  # of an earlier run: its files no longer count
    rows, shards = plan(pages, key, url, html, shard_bytes)
    rows = rows.repartitionById(shards, F.col("shard")).sortWithinPartitions("shard", "order", "id", "digest", "url")
    told = rows.mapInArrow(_writer(folder, roll_bytes), "shard int, file string, records long, bytes long, sha1 string")
    new = f"{root}/{MANIFEST}-{uuid.uuid4().hex}.new"
    told.write.parquet(new)
    _move(spark, new, f"{root}/{MANIFEST}")
    _move(spark, f"{root}/{TEMPORARY}", None)
    return manifest(spark, folder)


def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The files that count in a folder that write() has committed."""
    return spark.read.schema("shard int, file string, records long, bytes long, sha1 string").parquet(f"{_address(folder)}/{MANIFEST}")


def parse(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields, block) of each record of an open archive, one at a time."""
    with gzip.GzipFile(fileobj=stream) as f, io.BufferedReader(f, 1 << 16) as lines:
        while line := lines.readline():
            if not line.strip():
                continue
            fields: dict[str, str] = {}
            while (line := lines.readline()).strip():
                k, _, v = line.decode().partition(":")
                fields[k.strip()] = v.strip()
            block = lines.read(int(fields["Content-Length"]))
            if len(block) != int(fields["Content-Length"]):
                raise ValueError("an archive ends within a record")
            yield fields, block


def _reader(folder: str, payloads: bool):
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", *(["payload"] if payloads else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()][: len(names)]
        fs, root = _open(folder)
        number = lambda s: int(s) if s else None

        def batch_of(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

        for batch in batches:
            for file in batch.column("file"):
                rows, held = [], 0
                with fs.open_input_stream(f"{root}/{file.as_py()}", compression=None) as stream:
                    for fields, block in parse(stream):
                        if f"sha1:{hashlib.sha1(block).hexdigest()}" != fields["WARC-Block-Digest"]:
                            raise ValueError(f"{file}: a record's block has another digest")
                        payload = block.partition(b"\r\n\r\n")[2]
                        if fields["WARC-Type"] == "response":  # measured anew; a revisit only has what its header says
                            size, digest = len(payload), hashlib.sha1(payload).hexdigest()
                        else:
                            size, digest = int(fields["X-Payload-Length"]), fields["WARC-Payload-Digest"].removeprefix("sha1:")
                        rows.append((number(fields["X-Page-ID"]), size, digest, fields["WARC-Type"], number(fields.get("X-Refers-To-Page-ID")), payload))
                        held += len(payload) if payloads else 200
                        if held > 8_000_000:
                            yield batch_of(rows)
                            rows, held = [], 0
                yield batch_of(rows)

    return run


def read_archives(files: DataFrame, folder: str, payloads: bool = False) -> DataFrame:
    """A row per record of the files that a manifest names; the files are dealt over all tasks."""
    files = files.select("file").repartition(max(1, min(MAX_SHARDS, files.count())), "file")  # a count keeps Spark from joining these few rows to one task
    kind = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long" + ", payload binary" * payloads
    return files.mapInArrow(_reader(folder, payloads), kind)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{scratch(spark)}/warc-{uuid.uuid4().hex}"
    write(read(spark, sf_dir, "pages"), folder)
    return read_archives(manifest(spark, folder), folder)


SQL = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages)
, d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, CASE WHEN strlen(html) >= {LEAST_BYTES} THEN max(page_id) OVER (PARTITION BY html) ELSE page_id END AS largest FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN largest = page_id THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN largest <> page_id THEN largest END AS refers_to FROM d
"""
