"""WARC archives: written as whole-file gzip streams, normalised to one gzip member per record.

``write_archives`` lets Spark's own text writer produce the archives, one gzip stream per file.
``normalise`` inflates each file once as a stream, rewrites every record as its own gzip member
and writes the offset index as a sidecar file (JSON lines) beside each archive. ``read_members`` reads
records back through the sidecars.

Defined results: a null payload is empty and a null URL is written as an empty target. Of records
with equal payloads (same SHA-1 and length) the one with the largest id is the response; rows that
repeat that id are responses too, as are rows with a null id. Payloads under ``least_bytes`` are
always responses. Extra columns are ignored. An empty table gives no records.
"""

from __future__ import annotations

import json
import os
import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tripsearch.ship import ship
from tripsearch.storage import durable, new_folder

BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
END = "\r\n\r\n"
CHUNK = 1 << 20

INDEX = "archive string, member_offset long, member_length long, record_id string, record_type string, target_uri string, payload_digest string"
RECORDS = "page_id long, target_uri string, record_type string, refers_to long, payload_bytes long, payload_digest string, payload binary"


def base32_of_sha1(digest: Column) -> Column:
    """Upper-case base32 of a SHA-1 in hex: 5 hex digits are 4 base-32 digits."""
    letters = []
    for group in range(8):
        bits = F.conv(F.substring(digest, 5 * group + 1, 5), 16, 10).cast("int")
        letters += [F.substr(F.lit(BASE32), F.shiftright(bits, s).bitwiseAND(F.lit(31)) + 1, F.lit(1)) for s in (15, 10, 5, 0)]
    return F.concat(*letters)


def with_roles(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """page_id, url, payload, payload_bytes, digest, refers_to (null for a response)."""
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"),
        F.regexp_replace(F.coalesce("url", F.lit("")), r"[\r\n]", " ").alias("url"),
        F.coalesce("html", F.lit("")).alias("payload"),
    ).withColumn("sha1", F.sha1("payload")).withColumn("payload_bytes", F.octet_length("payload").cast("long"))
    keepers = (
        rows.filter(F.col("payload_bytes") >= least_bytes)
        .groupBy("sha1", "payload_bytes").agg(F.max("page_id").alias("keeper"), F.count("*").alias("copies"))
        .filter("copies > 1").drop("copies")
    )
    return rows.join(keepers, ["sha1", "payload_bytes"], "left").select(
        "page_id", "url", "payload", "payload_bytes", base32_of_sha1(F.col("sha1")).alias("digest"),
        F.when(F.col("page_id") < F.col("keeper"), F.col("keeper")).alias("refers_to"),
    )


def record_text() -> Column:
    """One WARC record without the blank lines that end it."""
    crlf = F.lit("\r\n")
    revisit = F.col("refers_to").isNotNull()
    http = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "),
        F.col("payload_bytes"), crlf, crlf,
    )
    urn = lambda c: F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))
    block = F.concat(http, F.when(revisit, "").otherwise(F.col("payload")))
    return F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: "), urn(F.col("page_id")),
        F.lit("\r\nWARC-Target-URI: "), F.col("url"),
        F.when(revisit, F.concat(
            F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: "),
            urn(F.col("refers_to")),
        )).otherwise(""),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.octet_length(block), crlf, crlf, block,
    )


def write_archives(pages: DataFrame, path: str, least_bytes: int = 0) -> None:
    """One whole-file gzip stream per partition, written by Spark."""
    (
        with_roles(pages, least_bytes).select(record_text().alias("value"))
        .write.option("compression", "gzip").option("lineSep", END).text(path)
    )


def inflated(content: bytes) -> Iterator[bytes]:
    """The bytes of a gzip file, a chunk at a time, over all of its members."""
    view, at, engine = memoryview(content), 0, zlib.decompressobj(31)
    while at < len(view):
        data: bytes = bytes(view[at : at + CHUNK])
        at += len(data)
        while data:
            yield engine.decompress(data)
            data = engine.unused_data
            if engine.eof:
                engine = zlib.decompressobj(31)
    yield engine.flush()


def records(stream: Iterator[bytes]) -> Iterator[bytes]:
    """Whole records, header, block and closing blank lines, read by their Content-Length."""
    held, more = bytearray(), True
    while True:
        head = held.find(b"\r\n\r\n")
        size = None
        if head >= 0:
            length = re.search(rb"(?im)^Content-Length: *(\d+)", held[:head])
            if not held.startswith(b"WARC/") or not length:
                raise ValueError("not a WARC record")
            size = head + 8 + int(length[1])
        if size is not None and len(held) >= size:
            yield bytes(held[:size])
            del held[:size]
            continue
        if not more:
            if held:
                raise ValueError("a WARC record is cut off")
            return
        more = False
        # take what the record still lacks in one go: no search through a long block again
        while (size is None and not more) or (size is not None and len(held) < size):
            piece = next(stream, None)
            if piece is None:
                break
            held += piece
            more = True


def fields(record: bytes) -> tuple[dict[str, str], bytes]:
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")[1:]
    return {k.lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}, rest[:-4]


def normalise(spark: SparkSession, source: str, target: str, level: int = 6) -> DataFrame:
    """Rewrite the archives under ``source`` into ``target``; the sidecar index, as a table.

    Each task writes its files under its own attempt's name first, so a repeated attempt replaces
    whole files only.
    """
    ship(spark)

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        store.create_dir(root, recursive=True)
        attempt = TaskContext.get().taskAttemptId()
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                name = os.path.basename(path).split(".")[0]
                offset, count, draft = 0, 0, f"{root}/.{name}.{attempt}"
                with store.open_output_stream(draft, compression=None) as out, store.open_output_stream(f"{draft}.index", compression=None) as side:
                    for record in records(inflated(content.as_py())):
                        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
                        member = packer.compress(record) + packer.flush()
                        out.write(member)
                        at = fields(record)[0]
                        row = (f"{name}.warc.gz", offset, len(member), at["warc-record-id"], at["warc-type"], at["warc-target-uri"], at["warc-payload-digest"])
                        side.write((json.dumps(dict(zip(names, row))) + "\n").encode())
                        offset, count = offset + len(member), count + 1
                store.move(draft, f"{root}/{name}.warc.gz")
                store.move(f"{draft}.index", f"{root}/{name}.cdxj")
                yield pa.RecordBatch.from_arrays([pa.array([f"{name}.warc.gz"]), pa.array([count])], ["archive", "members"])

    names = [x.split()[0] for x in INDEX.split(", ")]
    archives = spark.read.format("binaryFile").option("pathGlobFilter", "*.gz").load(source).select("path", "content")
    durable(archives.mapInArrow(rewrite, "archive string, members long"), "warc-files")
    return spark.read.schema(INDEX).option("pathGlobFilter", "*.cdxj").json(target)


def read_members(spark: SparkSession, target: str) -> DataFrame:
    """Every record that the sidecars list, each inflated alone from its offset."""
    ship(spark)

    def open_members(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, root = fs.FileSystem.from_uri(target)
        for batch in batches:
            for path, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                sidecar = f"{root}/{os.path.basename(path).split('.')[0]}.cdxj"
                with store.open_input_stream(sidecar, compression=None) as side:
                    members = [json.loads(line) for line in side.read().splitlines()]
                data, rows, held = memoryview(content.as_py()), [], 0
                for m in members:
                    record = zlib.decompress(data[m["member_offset"] : m["member_offset"] + m["member_length"]], 31)
                    at, block = fields(record)
                    http, _, payload = block.partition(b"\r\n\r\n")
                    number = lambda urn: int(m[0]) if (m := re.search(r"-?\d+", urn or "")) else None
                    rows.append((
                        number(at["warc-record-id"]), at["warc-target-uri"], at["warc-type"], number(at.get("warc-refers-to")),
                        int(re.search(rb"(?i)Content-Length: *(\d+)", http)[1]), at["warc-payload-digest"].removeprefix("sha1:"), payload,
                    ))
                    held += len(payload)
                    if held > 4 * CHUNK:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)
                        rows, held = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names)

    names = [x.split()[0] for x in RECORDS.split(", ")]
    kinds = {"long": pa.int64(), "string": pa.string(), "binary": pa.binary()}
    types = [kinds[x.split()[1]] for x in RECORDS.split(", ")]
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(target)
    return files.select("path", "content").mapInArrow(open_members, RECORDS)


def round_trip(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Write, normalise and read back; the records with their payloads."""
    spark = pages.sparkSession
    folder = new_folder(spark, "warc")
    write_archives(pages, f"{folder}/streams", least_bytes)
    target = f"{folder}/members" if ":/" in folder else f"file://{folder}/members"
    normalise(spark, f"{folder}/streams", target)
    return read_members(spark, target)
