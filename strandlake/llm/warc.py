"""Content-addressed WARC archive.

An archive is a folder with two tables. ``payloads`` holds each payload once,
under its SHA-256; ``headers`` holds, for every record, the exact bytes of its
WARC header and the digest it points at. A record is put together again by
joining the two, so copies cost one header. ``records`` verifies every payload
against its address when it is read, and ``read_back`` takes all that it says
from the bytes of the rebuilt records.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, bounded_batches

#: Payloads of fewer bytes are never replaced by a revisit.
LEAST_BYTES = 1000
#: Fixed values of the WARC 1.1 format.
VERSION = "WARC/1.1"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"


def _base32(hexadecimal: Column) -> Column:
    """Base 32 of a SHA-1 in hex, as archives label payload digests."""
    bits = F.concat(*(F.lpad(F.conv(F.substring(hexadecimal, 1 + 5 * k, 5), 16, 2), 20, "0") for k in range(8)))
    letters = F.lit("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")
    return F.concat(*(F.substring(letters, F.conv(F.substring(bits, 1 + 5 * k, 5), 2, 10).cast("int") + 1, F.lit(1)) for k in range(32)))


def _uuid(*parts: Column) -> Column:
    """A name that a rerun gives again."""
    h = F.md5(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts)))
    return F.concat(F.lit("<urn:uuid:"), F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)))), F.lit(">"))


def write_archive(pages: DataFrame, path: str, least_bytes: int = LEAST_BYTES, date: str = "1970-01-01T00:00:00Z") -> None:
    """Writes ``pages`` (page_id, url, html) as an archive; every row gives one record with an id of its own.

    Of equal payloads of ``least_bytes`` or more the row with the largest
    page_id is the response, the others revisit it. A null html is an empty
    payload; a null url leaves out the target line. A null page_id gets a
    record of its own that is never another's response while a row with an id
    has the same payload. Rows with the same page_id and payload are each a
    record; all of them are responses if that id is the largest. Extra columns
    are ignored and an empty table gives an empty archive.

    Groups are found on the digests alone, with map-side combining, and are
    written before their joins, so a crowded digest can be split there.
    """
    space = Workspace(pages.sparkSession, "warc-rows")
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    full = pages.select("page_id", "url", payload.alias("payload"))
    full = full.select("page_id", "url", F.sha2("payload", 256).alias("sha256"), "payload")
    light = full.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").cast("long").alias("payload_bytes"), F.monotonically_increasing_id().alias("row"))
    light = space.save(light, "light")
    several = space.save(light.groupBy("sha256").agg(F.count(F.lit(1)).alias("n"), F.max("page_id").alias("first")).filter("n > 1").select("sha256", "first"), "several")
    rows = light.join(several.withColumn("shared", F.lit(True)), "sha256", "left")
    # Rows that repeat an id and its payload: all but the first have their row in the record's id.
    again = rows.filter("shared").groupBy("sha256", "page_id").agg(F.min("row").alias("least"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    again, seen = space.counted(again.select(F.col("sha256").alias("of"), F.col("page_id").alias("id"), "least"), "again", F.count(F.lit(1)).alias("n"))
    if seen["n"]:
        rows = rows.join(again, (F.col("sha256") == F.col("of")) & F.col("page_id").eqNullSafe(F.col("id")), "left")
        rows = rows.withColumn("place", F.when(F.col("row") > F.col("least"), F.col("row"))).drop("of", "id", "least")
    else:
        rows = rows.withColumn("place", F.lit(None).cast("long"))
    revisit = (F.col("payload_bytes") >= least_bytes) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    header = F.concat(
        F.lit(VERSION + CRLF),
        line("WARC-Type", F.when(revisit, "revisit").otherwise("response")),
        line("WARC-Record-ID", _uuid(F.col("page_id"), F.col("sha256"), F.col("place"))),
        line("WARC-Date", F.lit(date)),
        F.coalesce(line("WARC-Target-URI", F.regexp_replace("url", "[\r\n]", "")), F.lit("")),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), _base32(F.col("sha1")))),
        F.when(revisit, F.concat(line("WARC-Profile", F.lit(PROFILE)), line("WARC-Refers-To", _uuid(F.col("first"), F.col("sha256"), F.lit(None))))).otherwise(F.lit("")),
        line("Content-Type", F.lit("text/html; charset=UTF-8")),
        line("Content-Length", F.when(revisit, F.lit("0")).otherwise(F.col("payload_bytes").cast("string"))),
        F.lit(CRLF),
    )
    rows.select("page_id", "sha256", F.encode(header, "UTF-8").alias("header")).write.option("compression", "zstd").parquet(f"{path}/headers")
    # Payloads that nothing else shares stay where they are; of each group the response's goes on.
    marked = full.join(several.withColumn("shared", F.lit(True)), "sha256", "left")
    alone, kept = marked.filter("shared is null"), marked.filter(F.col("shared") & F.col("page_id").eqNullSafe(F.col("first")))
    once = alone.unionByName(kept.dropDuplicates(["sha256"])) if seen["n"] else alone.unionByName(kept)
    once.select("sha256", "payload").write.option("compression", "zstd").parquet(f"{path}/payloads")
    space.drop("light", "several", "again")


def read_payloads(spark: SparkSession, path: str) -> DataFrame:
    """sha256, payload: each address once, checked against the bytes."""
    stored = spark.read.parquet(f"{path}/payloads").filter(F.col("sha256").isNotNull())
    wrong = F.raise_error(F.concat(F.lit("payload does not match its address "), F.col("sha256")))
    checked = F.when(F.sha2("payload", 256) == F.col("sha256"), F.col("payload")).otherwise(wrong.cast("binary"))
    return stored.select("sha256", checked.alias("payload"))


def records(spark: SparkSession, path: str) -> DataFrame:
    """page_id, sha256, payload, record: every record of an archive with its bytes as a WARC file has them.

    A revisit's record ends with its header, so its payload is null here and no
    payload is moved for it.
    """
    heads = spark.read.parquet(f"{path}/headers")
    bare = F.instr(F.decode("header", "UTF-8"), f"{CRLF}WARC-Type: revisit{CRLF}") > 0
    whole = heads.filter(~bare).join(read_payloads(spark, path), "sha256")
    end = F.encode(F.lit(CRLF + CRLF), "UTF-8")
    whole = whole.select("page_id", "sha256", "payload", F.concat("header", "payload", end).alias("record"))
    return whole.unionByName(heads.filter(bare).select("page_id", "sha256", F.lit(None).cast("binary").alias("payload"), F.concat("header", end).alias("record")))


def _read(batches):
    for batch in batches:
        out = []
        for record in batch.column("record").to_pylist():
            (fields, _, block), *rest = parse(record)
            if rest:
                raise ValueError("a record's bytes hold several records")
            digest, label = hashlib.sha1(block).hexdigest(), base64.b32decode(fields["WARC-Payload-Digest"].removeprefix("sha1:")).hex()
            if fields["WARC-Type"] == "response" and digest != label:
                raise ValueError(f"the payload of {fields['WARC-Record-ID']} does not match its label")
            out.append((fields["WARC-Record-ID"], fields["WARC-Type"], fields.get("WARC-Refers-To"), len(block), label))
        columns = [pa.array(list(c), t) for c, t in zip(zip(*out), (pa.string(), pa.string(), pa.string(), pa.int64(), pa.string()))]
        if out:
            yield pa.RecordBatch.from_arrays([batch.column("page_id").cast(pa.int64()), *columns], ["page_id", "record_id", "record_type", "refers_to", "payload_bytes", "payload_digest"])


def read_back(spark: SparkSession, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to (a page_id) of every record of an archive.

    Each record is rebuilt from header and payload and parsed; what a revisit
    refers to is found by the ids in the headers, and its payload's size is that
    response's. A label that a response's bytes do not have is an error, and so
    is a revisit whose response has another label or is not there.
    """
    bounded_batches(spark)
    space = Workspace(spark, "warc-read")
    schema = "page_id long, record_id string, record_type string, refers_to string, payload_bytes long, payload_digest string"
    found = space.save(records(spark, path).select("page_id", "record").mapInArrow(_read, schema), "found")
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    first = found.filter("record_type != 'revisit'")
    target = first.select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("to"), F.col("payload_bytes").alias("size"), F.col("payload_digest").alias("label"))
    again = found.filter("record_type = 'revisit'").join(target, "refers_to", "left")
    lost = F.raise_error(F.concat(F.lit("no response with this payload for "), F.col("record_id")))
    again = again.select("page_id", F.when(F.col("label") == F.col("payload_digest"), F.col("size")).otherwise(lost.cast("long")).alias("payload_bytes"), "payload_digest", "record_type", F.col("to").alias("refers_to"))
    return first.withColumn("refers_to", F.lit(None).cast("long")).select(*columns).unionByName(again)


def export(spark: SparkSession, path: str, to: str) -> None:
    """Writes the archive's records as rows of raw bytes."""
    records(spark, path).select("page_id", "record").write.parquet(to)


_HEAD = re.compile(rb"(WARC/[\d.]+)\r\n(.*?)\r\n\r\n", re.S)


def parse(data: bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """(header fields, header bytes, block) of each record of an uncompressed WARC file's bytes."""
    at = 0
    while at < len(data):
        m = _HEAD.match(data, at)
        if not m:
            raise ValueError(f"no WARC record at byte {at}")
        fields = dict(x.split(": ", 1) for x in m[2].decode("utf-8", "replace").split(CRLF) if ": " in x)
        n = int(fields["Content-Length"])
        yield fields, m[0], data[m.end() : m.end() + n]
        at = m.end() + n + 4


def read_warc_files(spark: SparkSession, pattern: str) -> DataFrame:
    """type, target, header, block of the records of uncompressed WARC files; one file is one row of the scan."""
    bounded_batches(spark)

    def run(batches):
        for batch in batches:
            for data in batch.column("content").to_pylist():
                rows = list(parse(data))
                yield pa.RecordBatch.from_arrays([pa.array([f.get("WARC-Type") for f, _, _ in rows], pa.string()), pa.array([f.get("WARC-Target-URI") for f, _, _ in rows], pa.string()), pa.array([h for _, h, _ in rows], pa.binary()), pa.array([b for _, _, b in rows], pa.binary())], ["type", "target", "header", "block"])

    return spark.read.format("binaryFile").load(pattern).select("content").mapInArrow(run, "type string, target string, header binary, block binary")


def round_trip(pages: DataFrame, least_bytes: int = LEAST_BYTES) -> DataFrame:
    """Writes an archive of ``pages`` into the shared folder and reads it back."""
    spark = pages.sparkSession
    path = Workspace(spark, "warc").path
    write_archive(pages, path, least_bytes)
    return read_back(spark, path)
