"""WARC archives as tables of chunks.

An archive is a table of rows (archive, record_id, chunk_no, n_chunks, data): the data of an
archive's rows in the order of record and chunk are the bytes of a WARC 1.1 file. A payload
over CHUNK bytes takes several rows, so that neither writer nor reader needs a record in one
piece: the reader goes through the rows of a record in order and updates its digest by chunk.
Records of one chunk, nearly all, are read where they lie; only longer ones are shuffled.
"""

from __future__ import annotations

import base64
import hashlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kestrel.llm.common import payload, table_path

CHUNK = 1 << 18
#: The alphabet of base32.
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
SCHEMA = "record_id string, page_id long, url string, record_type string, refers_to long, payload_bytes long, payload_digest string"


def base32(hexadecimal: Column) -> Column:
    """Upper-case base32 of a hexadecimal SHA-1: five digits at a time are four letters."""
    letters = []
    for k in range(8):
        value = F.conv(F.substring(hexadecimal, 5 * k + 1, 5), 16, 10).cast("int")
        for shift in (15, 10, 5, 0):
            letters.append(F.substr(F.lit(BASE32), F.shiftright(value, shift).bitwiseAND(31) + 1, F.lit(1)))
    return F.concat(*letters)


def later(rows: DataFrame) -> DataFrame:
    """page_id, digest and refers_to of the rows whose payload an earlier page has: of the rows with
    equal digests those with the smallest page_id are not among them, others name it."""
    first = rows.groupBy("digest").agg(F.min("page_id").alias("refers_to"))
    seen = rows.select("page_id", "digest").distinct()
    return seen.join(first, "digest").where(F.col("page_id") > F.col("refers_to"))


def chunks(pages: DataFrame, size: int = CHUNK, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """The rows of the chunk table: the first chunk of a record holds its headers, the last one its
    end. Null html is an empty payload.

    Payloads are cut where they are read, and move in chunks, once, by page_id; the smallest id
    of a payload is found on digests alone, reduced before the shuffle. Rows without a page_id
    never refer and are never referred to, unless all of their payload's rows have none. Rows
    that repeat the smallest id and payload are all responses.
    """
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload(F.col(html_col)).alias("payload"))
    rows = rows.withColumns({"digest": F.sha1("payload"), "length": F.octet_length("payload")})
    number = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    # Rows that repeat a page stay apart by their place in the table.
    cut = rows.withColumn("record_id", F.concat(F.lit("urn:page:"), number, F.lit("/"), F.monotonically_increasing_id().cast("string")))
    cut = cut.withColumn("n_chunks", F.greatest(F.lit(1), F.ceil(F.col("length") / size)).cast("int"))
    cut = cut.withColumn("chunk_no", F.explode(F.sequence(F.lit(0), F.col("n_chunks") - 1)))
    cut = cut.withColumn("part", F.substr("payload", F.col("chunk_no") * size + 1, F.lit(size))).drop("payload")
    found = cut.join(later(rows), ["page_id", "digest"], "left")
    revisit, first = F.col("refers_to").isNotNull(), F.col("chunk_no") == 0
    found = found.where(first | ~revisit).withColumn("n_chunks", F.when(revisit, 1).otherwise(F.col("n_chunks")))
    clean = F.regexp_replace("url", r"[\r\n]", "%0A")
    http = F.concat(F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: "), F.col("length").cast("string"), F.lit("\r\n\r\n"))
    found = found.withColumns({"http": http, "stored": F.when(revisit, 0).otherwise(F.col("length"))})
    head = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.when(revisit, "revisit").otherwise("response"),
        F.lit("\r\nWARC-Record-ID: <urn:page:"), number, F.lit(">\r\nWARC-Date: 2024-01-01T00:00:00Z"),
        F.coalesce(F.concat(F.lit("\r\nWARC-Target-URI: "), clean), F.lit("")),
        F.lit("\r\nWARC-Payload-Digest: sha1:"), base32(F.col("digest")),
        F.when(revisit, F.concat(F.lit("\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest\r\nWARC-Refers-To: <urn:page:"), F.col("refers_to").cast("string"), F.lit(">"))).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        (F.octet_length("http") + F.col("stored")).cast("string"), F.lit("\r\n\r\n"), F.col("http"),
    )
    start = F.when(first, F.encode(head, "UTF-8")).otherwise(F.lit(b""))
    part = F.when(revisit, F.lit(b"")).otherwise(F.col("part"))
    end = F.when(F.col("chunk_no") == F.col("n_chunks") - 1, F.lit(b"\r\n\r\n")).otherwise(F.lit(b""))
    return found.select(F.spark_partition_id().alias("archive"), "record_id", "chunk_no", "n_chunks", F.concat(start, part, end).alias("data"))


def write_archives(pages: DataFrame, path: str, size: int = CHUNK, **columns: str) -> None:
    """Write pages as a chunk table at path; columns as in chunks()."""
    chunks(pages, size, **columns).write.option("compression", "zstd").parquet(path)


class _Reader:
    """Reads one record after the other from chunks in order."""

    def start(self, record_id: str, data: bytes) -> bytes:
        head, _, rest = data.partition(b"\r\n\r\n")
        lines = head.decode("utf-8").split("\r\n")
        fields = {k.lower(): v for k, _, v in (x.partition(": ") for x in lines[1:])}
        http, _, body = rest.partition(b"\r\n\r\n")
        length = next(int(x.partition(b": ")[2]) for x in http.split(b"\r\n") if x.lower().startswith(b"content-length"))
        page = fields["warc-record-id"].strip("<>").rpartition(":")[2]
        refers = fields.get("warc-refers-to")
        self.row = (record_id, None if page == "null" else int(page), fields.get("warc-target-uri"), fields["warc-type"], refers and int(refers.strip("<>").rpartition(":")[2]), length)
        self.named, self.left, self.digest = fields["warc-payload-digest"].partition(":")[2], int(fields["content-length"]) - len(http) - 4, hashlib.sha1()
        if fields["warc-type"] == "response" and self.left != length:
            raise ValueError(f"{record_id}: the lengths of record and payload differ")
        return body

    def feed(self, data: bytes) -> None:
        used = min(self.left, len(data))
        self.digest.update(memoryview(data)[:used])
        self.left -= used

    def end(self) -> tuple:
        digest = base64.b32encode(self.digest.digest()).decode() if self.row[3] == "response" else self.named
        if self.left or digest != self.named:
            raise ValueError(f"{self.row[0]}: the record is cut off or its digest differs")
        return (*self.row, digest)


def _read(batches):
    reader, names = _Reader(), [x.split()[0] for x in SCHEMA.split(", ")]
    types = [pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    for batch in batches:
        done = []
        for i in range(batch.num_rows):
            record, no, n, data = (batch.column(c)[i].as_py() for c in ("record_id", "chunk_no", "n_chunks", "data"))
            reader.feed(reader.start(record, data) if no == 0 else data)
            if no == n - 1:
                done.append(reader.end())
        columns = zip(*done) if done else [[]] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """One row for each record of the chunk table at path, its digest computed anew from the
    stored bytes (revisits: as named); a damaged record is an error."""
    rows = spark.read.parquet(path).select("record_id", "chunk_no", "n_chunks", "data")
    short = rows.where("n_chunks = 1").mapInArrow(_read, SCHEMA)
    long = rows.where("n_chunks > 1").repartition("record_id").sortWithinPartitions("record_id", "chunk_no").mapInArrow(_read, SCHEMA)
    return short.union(long)


def payloads(spark: SparkSession, path: str) -> DataFrame:
    """The stored bytes by record and chunk: record_id, chunk_no and data, for copying out."""
    return spark.read.parquet(path).select("archive", "record_id", "chunk_no", "data")


def archived(pages: DataFrame, size: int = CHUNK, **columns: str) -> DataFrame:
    """Write pages to archives in the shared folder and read them back: page_id,
    payload_bytes, payload_digest, record_type and refers_to for each row."""
    spark = pages.sparkSession
    path = table_path(spark, "warc")
    write_archives(pages, path, size, **columns)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def archived_sql() -> str:
    """DuckDB SQL for archived(pages)."""
    letters = " || ".join(
        f"substr('{BASE32}', ((('0x' || substr(h, {5 * k + 1}, 5))::INTEGER >> {s}) & 31) + 1, 1)" for k in range(8) for s in (15, 10, 5, 0)
    )
    return f"""
    WITH p AS (SELECT page_id, coalesce(html, '') AS t, sha1(coalesce(html, '')) AS h FROM pages),
    f AS (SELECT h, min(page_id) AS first FROM p GROUP BY h)
    SELECT page_id, strlen(t)::BIGINT AS payload_bytes, {letters} AS payload_digest,
      CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
      CASE WHEN page_id > first THEN first END AS refers_to
    FROM p JOIN f USING (h)"""
