"""A content-addressed WARC archive: payload bytes once by verified digest, record headers apart.

`write_archive` makes two Parquet tables under a root: `payloads` (sha256, payload) holds every distinct
payload once; `headers` (page_id, sha256, header) holds each record's exact header block. Both are bucketed
alike by digest, so the join that rebuilds whole records (`read_records`) moves no payload. Records of a payload
that more than `CHUNK` records share are dealt to chunks, each with a copy of the payload, so that no task
rebuilds a large group alone. `read_index` describes the rebuilt records, a row each. Digests are recomputed from
the stored bytes, and a mismatch stops the reader. Copies collapse before the writer's shuffle (partial
aggregation by digest).

Nulls: a null html is an empty payload, a null url an empty target. A null page_id is written as `none` in the
header and read back as null; it is a revisit if a page with an id has the payload, else a response. Rows
repeating a page_id and a payload are records of their own with equal fields. Very long payloads are rows like
others. An empty table gives an empty archive. Other columns are ignored.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, parts, small_table, text_or_empty

ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
DATE = "2024-01-01T00:00:00Z"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CRLF = "\r\n"
NONE = "none"
CHUNK = 4096
TABLES = {"headers": "page_id long, sha256 string, header string", "payloads": "sha256 string, payload binary"}


def base32(hex_digest: Column) -> Column:
    """Base32 of a 160-bit digest in hex: each 5 hex digits are 4 characters."""

    def four(i: Column) -> Column:
        v = F.conv(F.substring(hex_digest, i * 5 + 1, F.lit(5)), 16, 10).cast("int")
        return F.concat(*(F.substring(F.lit(ALPHABET), F.shiftright(v, s).bitwiseAND(31) + 1, F.lit(1)) for s in (15, 10, 5, 0)))

    return F.array_join(F.transform(F.sequence(F.lit(0), F.lit(7)), four), "")


def record_id(page_id: Column) -> Column:
    h = F.md5(F.concat(F.lit("page:"), F.coalesce(page_id.cast("string"), F.lit(NONE))))
    return F.concat(F.lit("<urn:uuid:"), F.regexp_replace(h, "(.{8})(.{4})(.{4})(.{4})(.{12})", "$1-$2-$3-$4-$5"), F.lit(">"))


def _table(root: str, name: str) -> str:
    return f"warc_{hashlib.md5(root.encode()).hexdigest()[:20]}_{name}"


def _write(rows: DataFrame, root: str, name: str, buckets: int) -> None:
    to = rows.write.format("parquet").option("compression", "zstd").option("path", f"{root}/{name}")
    to.bucketBy(buckets, "sha256").sortBy("sha256").saveAsTable(_table(root, name))


def write_archive(pages: DataFrame, root: str, least: int = 0) -> None:
    """least: payloads shorter than this are all responses (they are stored once all the same)."""
    spark = pages.sparkSession
    buckets = parts(spark)
    body = F.encode(text_or_empty("html"), "UTF-8")
    rows = pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("payload"))
    rows = rows.withColumn("sha256", F.sha2("payload", 256))
    _write(rows.select("sha256", "payload").dropDuplicates(["sha256"]), root, "payloads", buckets)
    named = rows.select("page_id", "url", "sha256", F.sha1("payload").alias("sha1"), F.octet_length("payload").alias("n"))
    first = named.groupBy("sha256").agg(F.min("page_id").alias("first"))
    joined = named.join(first, "sha256").withColumn("response", F.col("first").isNull() | F.col("page_id").eqNullSafe(F.col("first")) | (F.col("n") < least))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value, F.lit(CRLF))
    digest = F.concat(F.lit("sha1:"), base32(F.col("sha1")))
    header = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("response"), "response").otherwise("revisit")),
        line("WARC-Record-ID", record_id(F.col("page_id"))),
        line("WARC-Date", F.lit(DATE)),
        line("WARC-Target-URI", F.regexp_replace("url", "[\\r\\n]", "%0A")),
        line("WARC-Payload-Digest", digest),
        F.when(F.col("response"), "").otherwise(F.concat(line("WARC-Profile", F.lit(REVISIT)), line("WARC-Refers-To", record_id(F.col("first"))), line("X-Refers-To-Page", F.col("first").cast("string")))),
        line("X-Page", F.coalesce(F.col("page_id").cast("string"), F.lit(NONE))),
        line("Content-Length", F.when(F.col("response"), F.col("n")).otherwise(0).cast("string")),
        F.lit(CRLF),
    )
    _write(joined.select("page_id", "sha256", header.alias("header")), root, "headers", buckets)
    small_table(spark, [(buckets,)], "buckets int").write.parquet(f"{root}/layout")


def _read(spark: SparkSession, root: str, name: str) -> DataFrame:
    """A table of the archive with its buckets, in any session."""
    table = _table(root, name)
    if not spark.catalog.tableExists(table):
        buckets = spark.read.schema("buckets int").parquet(f"{root}/layout").first()[0]
        spark.sql(f"CREATE TABLE {table} ({TABLES[name]}) USING parquet CLUSTERED BY (sha256) SORTED BY (sha256) INTO {buckets} BUCKETS LOCATION '{root}/{name}'")
    return spark.table(table)


def _field(name: str) -> Column:
    found = F.regexp_extract("header", f"\\r\\n{name}: ([^\\r\\n]*)\\r\\n", 1)
    return F.when(found != "", found)


def _verified(payloads: DataFrame) -> DataFrame:
    same = F.sha2("payload", 256) == F.col("sha256")
    return payloads.withColumn("payload", F.when(same, F.col("payload")).otherwise(F.raise_error(F.concat(F.lit("damaged payload "), "sha256"))))


def read_records(spark: SparkSession, root: str) -> DataFrame:
    """page_id, header, record (header, payload unless it is a revisit, and two line ends), payload: the archive's original records."""
    headers, payloads = _read(spark, root, "headers"), _verified(_read(spark, root, "payloads"))
    many = materialize(headers.groupBy("sha256").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > CHUNK).select("sha256", F.ceil(F.col("n") / CHUNK).cast("int").alias("chunks")), "warc-groups")
    few = headers.join(many, "sha256", "left_anti").join(payloads, "sha256")
    dealt = headers.join(many, "sha256").withColumn("chunk", F.pmod(F.xxhash64("page_id", "header"), F.col("chunks")).cast("int"))
    copies = payloads.join(many, "sha256").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
    large = dealt.drop("chunks").join(copies.drop("chunks"), ["sha256", "chunk"]).drop("chunk")
    body = F.when(_field("WARC-Type") == "response", F.col("payload")).otherwise(F.lit(b""))
    end = F.encode(F.lit(CRLF * 2), "UTF-8")
    return few.unionByName(large).select("page_id", "header", F.concat(F.encode("header", "UTF-8"), body, end).alias("record"), "payload")


def read_index(spark: SparkSession, root: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every rebuilt record; a response's come from its own bytes."""
    head = F.octet_length(F.encode("header", "UTF-8"))
    own = F.substring("record", head + 1, F.octet_length("record") - head - 2 * len(CRLF))
    data = F.when(_field("WARC-Type") == "response", own).otherwise(F.col("payload"))
    rows = read_records(spark, root).select(_field("X-Page").try_cast("long").alias("page_id"), "header", F.octet_length(own).alias("length"), F.octet_length(data).cast("long").alias("payload_bytes"), base32(F.sha1(data)).alias("found"))
    agrees = (_field("WARC-Payload-Digest") == F.concat(F.lit("sha1:"), F.col("found"))) & (_field("Content-Length") == F.col("length").cast("string"))
    return rows.select(
        "page_id",
        "payload_bytes",
        F.when(agrees, F.col("found")).otherwise(F.raise_error(F.lit("header and payload disagree"))).alias("payload_digest"),
        _field("WARC-Type").alias("record_type"),
        _field("X-Refers-To-Page").cast("long").alias("refers_to"),
    )
