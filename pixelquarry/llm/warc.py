"""WARC archives as a chunked record table.

Writing: one record a page; the payload of a record over ``segment_bytes`` goes on in continuation
records. Records with equal payloads become revisits of the one with the largest id. The archives are written by
Spark's text writer, whose line separator is the two line ends that close a record.

Reading: Spark's text reader inflates a file as a stream and cuts it at line ends, which are put back; the payloads come out as
rows of record identifier, chunk number and chunk bytes with the count and digest of the payload so far. A task holds
an Arrow batch of the stream, which Spark bounds by bytes, and never a file or a record; the longest line is one segment.

Defined results: null html is an empty payload; a null url has no target line; line ends within a url are
percent-encoded; a row with a null id is a response of its own; repeated rows with the id that the others
revisit are all responses; an empty table makes no records; other columns aren't read. A very long payload is one value in the table
it comes from and goes on in segments; as the larger id is the response, equal payloads have no ties.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .tables import new_folder, stored, table

SEGMENT_BYTES = 1 << 20
CHUNK_BYTES = 1 << 16
END = "\r\n"
_BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def base32(hexed: Column) -> Column:
    """Base32 of a 160-bit digest given in hexadecimal: five digits are four letters."""

    def letters(i: Column) -> Column:
        bits = F.conv(F.substring(hexed, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*[F.substring(F.lit(_BASE32), F.shiftright(bits, shift).bitwiseAND(31) + 1, F.lit(1)) for shift in (15, 10, 5, 0)])

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), letters), "")


def write(pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = SEGMENT_BYTES) -> None:
    """Archives of ``page_id``, ``url``, ``html`` in the folder ``path``."""
    keyed = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("payload"))
    keyed = keyed.withColumns({"size": F.length("payload").cast("long"), "sha": F.sha1("payload")})
    # Which id the others revisit is worked out on ids and digests alone; a payload moves once, by its own id.
    ids = keyed.where((F.col("size") >= min_revisit_bytes) & F.col("page_id").isNotNull()).select("page_id", "sha", "size")
    holders = ids.groupBy("sha", "size").agg(F.max("page_id").alias("holder"), F.count("*").alias("n")).where("n > 1")
    roles = ids.join(holders, ["sha", "size"]).where("page_id <> holder").select("page_id", "sha", "holder").distinct()
    rows = keyed.join(roles, ["page_id", "sha"], "left").withColumn("digest", base32(F.col("sha")))

    # Only segment numbers are generated, and each segment is cut out of the payload in the same stage: no row holds all of them.
    revisit = F.col("holder").isNotNull()
    count = F.greatest(F.lit(1), F.ceil(F.when(revisit, 0).otherwise(F.col("size")) / segment_bytes)).cast("int")
    numbered = rows.select("page_id", "url", "digest", "holder", "payload", count.alias("segments"), F.explode(F.sequence(F.lit(1), count)).alias("number"))
    segment = F.when(revisit, F.lit(b"")).otherwise(F.substring("payload", (F.col("number") - 1) * segment_bytes + 1, F.lit(segment_bytes)))
    parts = numbered.select("page_id", "url", "digest", "holder", "segments", "number", segment.alias("bytes"))

    number, total = F.col("number"), F.col("segments")
    urn = lambda i: F.concat(F.lit("<urn:page:"), F.coalesce(i.cast("string"), F.lit("null")), F.lit(">"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(END))
    origin = urn(F.col("page_id"))
    head = F.concat(
        F.lit("WARC/1.1" + END),
        line("WARC-Type", F.when(F.col("holder").isNotNull(), "revisit").when(number > 1, "continuation").otherwise("response")),
        F.when(number > 1, line("WARC-Record-ID", F.concat(F.lit("<urn:page:"), F.coalesce(F.col("page_id").cast("string"), F.lit("null")), F.lit(":"), number.cast("string"), F.lit(">")))).otherwise(line("WARC-Record-ID", origin)),
        F.lit("WARC-Date: 1970-01-01T00:00:00Z" + END),
        F.coalesce(line("WARC-Target-URI", F.replace(F.replace(F.col("url"), F.lit("\r"), F.lit("%0D")), F.lit("\n"), F.lit("%0A"))), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("digest"))),
        F.coalesce(F.concat(line("WARC-Refers-To", urn(F.col("holder"))), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" + END)), F.lit("")),
        F.when(total > 1, line("WARC-Segment-Number", number.cast("string"))).otherwise(""),
        F.when(number > 1, line("WARC-Segment-Origin-ID", origin)).otherwise(""),
        F.when((total > 1) & (number == total), line("WARC-Segment-Total-Number", total.cast("string"))).otherwise(""),
        F.lit("Content-Type: text/html; charset=utf-8" + END),
        line("Content-Length", F.length("bytes").cast("string")),
        F.lit(END),
    )
    record = F.concat(head.cast("binary"), F.col("bytes")).cast("string")
    parts.select(record.alias("value")).write.option("lineSep", END * 2).option("compression", "gzip").text(path)


def chunks_of(source: Iterator[bytes], chunk_bytes: int = CHUNK_BYTES) -> Iterator[tuple[dict[str, str], int, bytes, int, str, bool]]:
    """Of each payload of an archive's bytes, in turn: the first record's fields, chunk number, chunk, bytes and hex digest so far, and whether it is the last.

    The segments of one payload follow each other in a file, so one digest runs through them.
    """
    buffer = b""

    def more() -> bool:
        nonlocal buffer
        piece = next(source, None)
        if piece is None:
            return False
        buffer += piece
        return True

    fields: dict[str, str] | None = None
    digest, done, number, held = hashlib.sha1(), 0, 0, b""
    while True:
        while (at := buffer.find(b"\r\n\r\n")) < 0 and more():
            pass
        if at < 0:
            break
        lines = buffer[:at].decode("utf-8", "replace").split(END)
        buffer = buffer[at + 4 :]
        head = {k.strip().lower(): v.strip() for k, v in (x.split(":", 1) for x in lines[1:] if ":" in x)}
        if head.get("warc-type") != "continuation":
            if fields is not None:
                digest.update(held)
                done += len(held)
                yield fields, number, held, done, digest.hexdigest(), True
            fields, digest, done, number, held = head, hashlib.sha1(), 0, 0, b""
        left = int(head["content-length"])
        while left:
            if not buffer and not more():
                raise ValueError("the archive ends within a record")
            take = buffer[: min(left, chunk_bytes)]
            buffer, left = buffer[len(take) :], left - len(take)
            if held:
                digest.update(held)
                done += len(held)
                yield fields, number, held, done, digest.copy().hexdigest(), False
                number += 1
            held = take
        while len(buffer) < 4 and more():
            pass
        buffer = buffer[4:]
    if fields is not None:
        digest.update(held)
        done += len(held)
        yield fields, number, held, done, digest.hexdigest(), True


def _stretches(batches: Iterator[pa.RecordBatch], step: int) -> Iterator[tuple[str, bytes]]:
    """The bytes of each file, with the line ends that the reader took away, at most ``step`` at a time."""
    for batch in batches:
        if not batch.num_rows:
            continue
        names, lines = batch.column(0), batch.column(1)
        runs = pc.run_end_encode(names)
        first = 0
        for name, end in zip(runs.values.to_pylist(), runs.run_ends.to_pylist(), strict=True):
            data = END.encode().join([*lines.slice(first, end - first).to_pylist(), b""])
            first = end
            for at in range(0, len(data), step):
                yield name, data[at : at + step]


def read_chunks(spark: SparkSession, path: str, chunk_bytes: int = CHUNK_BYTES, with_bytes: bool = True) -> DataFrame:
    """The chunked record table of all gzip archives in ``path``: a file is read in one task, in order, as gzip can't be split."""
    lines = spark.read.option("pathGlobFilter", "*.gz").option("lineSep", END).text(path).select(F.col("_metadata.file_path").alias("path"), F.col("value").cast("binary").alias("line"))
    names = ["archive", "record_id", "warc_type", "target_uri", "refers_to", "chunk_no", "chunk", "bytes_so_far", "digest_so_far", "is_last"]
    kinds = ["string", "string", "string", "string", "string", "long", "binary", "long", "string", "boolean"]
    types = {"string": pa.string(), "long": pa.int64(), "binary": pa.binary(), "boolean": pa.bool_()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []
        held = 0

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, types[k]) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for name, stream in groupby(_stretches(batches, chunk_bytes), key=lambda x: x[0]):
            for head, number, chunk, done, digest, last in chunks_of((piece for _, piece in stream), chunk_bytes):
                rows.append((name, head.get("warc-record-id"), head.get("warc-type"), head.get("warc-target-uri"), head.get("warc-refers-to"), number, chunk if with_bytes else None, done, base64.b32encode(bytes.fromhex(digest)).decode(), last))
                held += len(chunk) if with_bytes else 0
                if len(rows) >= 4096 or held > 8_000_000:
                    yield batch_of()
                    rows, held = [], 0
        if rows:
            yield batch_of()

    return lines.mapInArrow(run, ", ".join(f"{n} {k}" for n, k in zip(names, kinds, strict=True)))


def read_records(spark: SparkSession, path: str) -> DataFrame:
    """``page_id``, ``payload_bytes``, ``payload_digest``, ``record_type``, ``refers_to``: a revisit has its response's payload."""
    ends = read_chunks(spark, path, with_bytes=False).where("is_last")
    page = lambda c: F.regexp_extract(c, r"urn:page:(-?\d+)>", 1)
    records = ends.select(
        F.nullif(page("record_id"), F.lit("")).cast("long").alias("page_id"),
        F.col("bytes_so_far").alias("payload_bytes"),
        F.col("digest_so_far").alias("payload_digest"),
        F.col("warc_type").alias("record_type"),
        F.nullif(page("refers_to"), F.lit("")).cast("long").alias("refers_to"),
    )
    records = stored(records, "warc-records")  # read twice below: the archives are parsed once
    held = records.where("record_type = 'response'").groupBy(F.col("page_id").alias("refers_to")).agg(F.max(F.struct("payload_bytes", "payload_digest")).alias("held"))
    revisits = records.where("record_type = 'revisit'").select("page_id", "record_type", "refers_to").join(held, "refers_to", "left")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return records.where("record_type = 'response'").select(columns).unionByName(revisits.select("page_id", "held.payload_bytes", "held.payload_digest", "record_type", "refers_to"))


def op2_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_folder(spark, "warc")
    write(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    return read_records(spark, path)
