"""WARC archives, index first.

Writing: each task writes one archive of gzip members, one per record, into the shared folder and returns an index
row per record (archive, offset, length, URL, digest). The index is a table of its own. Reading: selected index rows
are sorted by archive and offset and dealt by range; adjacent records are coalesced into one byte-range read of up
to `READ_BYTES`, and each record is cut out of it, checked against its digest and parsed.

An archive's name carries the task attempt, so a repeated task writes another file and the index names only the
files of the attempts that succeeded. Files are opened through pyarrow.fs by the folder's own URI.

Equal payloads of at least `MIN_REVISIT` bytes are stored once: the record with the smallest page_id is the
response, the others are revisit records that refer to it.

Defined results: a null html is an empty payload, a null url the empty URI; a null page_id counts as the largest;
rows that repeat the smallest page_id and its payload are responses all; an empty table gives an empty result; extra
columns are ignored.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import batch_rows, shared_dir, table, written

MIN_REVISIT = 100
READ_BYTES = 4 << 20
#: Unused bytes between two records that one read may span.
GAP_BYTES = 64 << 10

INDEX = "archive string, offset long, length long, url string, digest string, page_id long, record_type string"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary"


def marked(pages: DataFrame) -> DataFrame:
    """(page_id, url, payload, digest, refers_to); refers_to is null for what is to be a response."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    first = rows.filter(F.octet_length("payload") >= MIN_REVISIT).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n")).filter("n > 1 and first is not null").drop("n")
    both = rows.join(first, "digest", "left")
    return both.withColumn("refers_to", F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))).drop("first")


def record(page_id, url: str, payload: bytes, digest: str, refers_to) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit record carries the payload's digest and size but no payload."""
    revisit = refers_to is not None
    head = [
        "WARC/1.1",
        f"WARC-Type: {'revisit' if revisit else 'response'}",
        f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {url.replace(chr(13), '%0D').replace(chr(10), '%0A')}",
        f"WARC-Payload-Digest: sha256:{digest}",
        f"X-Payload-Length: {len(payload)}",
        "Content-Type: text/html; charset=utf-8",
    ]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", "WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"]
    body = b"" if revisit else payload
    head.append(f"Content-Length: {len(body)}")
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress("\r\n".join(head).encode() + b"\r\n\r\n" + body + b"\r\n\r\n") + z.flush()


def parse(member: bytes) -> tuple:
    """A RECORD row of one gzip member; the digest is checked against a stored payload."""
    data = zlib.decompress(member, 31)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    field = dict(x.split(": ", 1) for x in lines[1:])
    number = lambda name: int(x) if (x := field[name][10:-1]) else None
    body, digest = rest[: int(field["Content-Length"])], field["WARC-Payload-Digest"].removeprefix("sha256:")
    revisit = field["WARC-Type"] == "revisit"
    if not revisit:
        found = hashlib.sha256(body).hexdigest()
        if found != digest:
            raise ValueError(f"digest of {field['WARC-Record-ID']}")
        size = len(body)
    else:
        size = int(field["X-Payload-Length"])
    return number("WARC-Record-ID"), field["WARC-Target-URI"], size, digest, field["WARC-Type"], number("WARC-Refers-To") if revisit else None, None if revisit else body


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    cols = list(zip(*rows, strict=True)) or [()] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(cols, schema, strict=True)], schema=schema)


def _schema(ddl: str) -> pa.Schema:
    kinds = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}
    return pa.schema([(n, kinds[k]) for n, k in (x.split() for x in ddl.split(", "))])


def write_archives(pages: DataFrame, folder: str) -> DataFrame:
    """Writes the archives and returns their index, itself written in the shared folder."""
    spark, schema = pages.sparkSession, _schema(INDEX)

    def write(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        store.create_dir(path, recursive=True)
        name = f"part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
        out, at = None, 0
        try:
            for b in batches:
                rows = []
                for r in b.to_pylist():
                    if out is None:
                        out = store.open_output_stream(f"{path}/{name}", compression=None)
                    data = record(r["page_id"], r["url"], r["payload"], r["digest"], r["refers_to"])
                    out.write(data)
                    rows.append((name, at, len(data), r["url"], r["digest"], r["page_id"], "response" if r["refers_to"] is None else "revisit"))
                    at += len(data)
                yield _batch(rows, schema)
        finally:
            if out is not None:
                out.close()

    batch_rows(spark, 500)
    return written(marked(pages).select("page_id", "url", "payload", "digest", "refers_to").mapInArrow(write, INDEX), "warc-index")


def read_archives(index: DataFrame, folder: str, payloads: bool = True) -> DataFrame:
    """RECORD rows of the records that the index rows select."""
    schema = _schema(RECORD)

    def read(batches):
        store, path = pafs.FileSystem.from_uri(folder)
        name, file = None, None
        for b in batches:
            todo = list(zip(*(b.column(i).to_pylist() for i in range(3)), strict=True))
            k = 0
            while k < len(todo):
                archive, at, size = todo[k]
                end, last = at + size, k + 1
                while last < len(todo) and todo[last][0] == archive and 0 <= todo[last][1] - end <= GAP_BYTES and todo[last][1] + todo[last][2] - at <= READ_BYTES:
                    end, last = todo[last][1] + todo[last][2], last + 1
                if archive != name:
                    if file is not None:
                        file.close()
                    name, file = archive, store.open_input_file(f"{path}/{archive}")
                file.seek(at)
                block = file.read(end - at)
                rows = [parse(block[o - at : o - at + n]) for _, o, n in todo[k:last]]
                yield _batch(rows if payloads else [(*r[:-1], None) for r in rows], schema)
                k = last
        if file is not None:
            file.close()

    parts = int(index.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    where = index.select("archive", "offset", "length").repartitionByRange(parts, "archive", "offset").sortWithinPartitions("archive", "offset")
    return where.mapInArrow(read, RECORD)


def op7_warc_index_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    index = write_archives(table(spark, sf_dir, "pages"), folder)
    return read_archives(index, folder, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


OP7_SQL = """
with p as (select page_id, octet_length(encode(coalesce(html, ''))) as n, sha256(coalesce(html, '')) as d from pages),
f as (select d, min(page_id) as first from p where n >= 100 group by d)
select page_id, cast(n as bigint) as payload_bytes, d as payload_digest,
       case when first is null or page_id is not distinct from first then 'response' else 'revisit' end as record_type,
       case when page_id is distinct from first then first end as refers_to
from p left join f using (d)
"""
