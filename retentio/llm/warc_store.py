"""Content-addressed WARC archive: payload bytes once, exact record headers apart, records by joins.

``write`` turns pages into WARC records and stores two tables in a folder that all executors share:

* ``payloads`` (digest, payload): the bytes of every distinct payload once, under their SHA-256;
* ``headers`` (record, page_id, url, header, http): the exact header text of every record and of
  the HTTP response inside it.

Of records with equal payloads of at least ``least_bytes`` bytes the one with the smallest page_id
is a response and the others are revisits of it; all smaller payloads are responses. ``records``
rebuilds every record: the digest is read from its header, the payload is joined by it and must
hash to that digest. ``export`` writes the records as WARC files.

The payload is the html as UTF-8; null counts as empty. A null page_id counts as the largest.
Rows that agree in page_id and payload are ordered by url (null first), then by place in the
input: one is the response, the others revisit it. Rows are never merged: each has its record,
also repeated ones. A url with white space or control characters stands percent-encoded in the
header, and exactly in the column ``url``. Texts of any length are one value in one row, hashed
in place; no step gathers several. A payload held by very many pages is dealt in parts
(``hot_join``). Only page_id, url and html are read, so other columns cannot clash. An empty
table gives an empty archive.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from retentio.llm.common import Scratch
from retentio.operators.hot_join import join_hot

LEAST_BYTES = 100
DATE = "1970-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
EOL = "\r\n"


@dataclass
class Archive:
    """The two tables; ``kind`` is the type of page_id."""
    headers: DataFrame
    payloads: DataFrame
    kind: str

    @classmethod
    def open(cls, spark: SparkSession, folder: str) -> Archive:
        headers = spark.read.parquet(f"{folder}/headers")
        return cls(headers, spark.read.parquet(f"{folder}/payloads"), headers.schema["page_id"].dataType.simpleString())


def _payload(html: str) -> Column:
    return F.coalesce(F.col(html).cast("binary"), F.lit(b""))


def _record_id(page_id: Column, record: Column) -> Column:
    return F.concat(F.lit("<urn:x-page:"), F.coalesce(F.url_encode(page_id.cast("string")), F.lit("")), F.lit(":"),
                    record.cast("string"), F.lit(">"))


def _line(name: str, value: Column) -> Column:
    """One header line; none for a null value."""
    return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(EOL)), F.lit(""))


def write(pages: DataFrame, scratch: Scratch, least_bytes: int = LEAST_BYTES, date: str = DATE,
          id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> Archive:
    """Store one record for each page under the folder of ``scratch``."""
    source = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).alias("url"), _payload(html_col).alias("payload"))
    hashed = source.withColumn("digest", F.sha2("payload", 256))
    # Narrow rows decide who is a response; payloads travel once, copies meet in the tasks that read them.
    rows = scratch.store(hashed.select("page_id", "url", "digest", F.octet_length("payload").cast("long").alias("n"),
                                       F.monotonically_increasing_id().alias("record")), "rows")
    payloads = scratch.store(hashed.groupBy("digest").agg(F.first("payload").alias("payload")), "payloads")
    rank = F.struct(F.col("page_id").isNull().alias("none"), "page_id", "url", "record")
    firsts = rows.filter(F.col("n") >= least_bytes).groupBy("digest").agg(F.min(rank).alias("first")).select(
        "digest", F.col("first.page_id").alias("first_page"), F.col("first.record").alias("first_record"))
    typed = join_hot(rows, firsts, ["digest"], F.col("record"))
    revisit = F.coalesce(F.col("first_record") != F.col("record"), F.lit(False))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{EOL}Content-Type: text/html; charset=utf-8{EOL}Content-Length: "),
                    F.col("n").cast("string"), F.lit(EOL + EOL))
    length = F.octet_length("http") + F.when(revisit, F.lit(0)).otherwise(F.col("n"))
    uri = F.when(F.col("url").rlike(r"[\x00-\x20\x7F]"), F.url_encode("url")).otherwise(F.col("url"))
    header = F.concat(
        F.lit(f"WARC/1.1{EOL}"),
        _line("WARC-Type", F.when(revisit, F.lit("revisit")).otherwise(F.lit("response"))),
        _line("WARC-Record-ID", _record_id(F.col("page_id"), F.col("record"))),
        _line("WARC-Date", F.lit(date)),
        _line("WARC-Target-URI", uri),
        _line("WARC-Profile", F.when(revisit, F.lit(PROFILE))),
        _line("WARC-Refers-To", F.when(revisit, _record_id(F.col("first_page"), F.col("first_record")))),
        _line("WARC-Payload-Digest", F.concat(F.lit("sha256:"), F.col("digest"))),
        _line("Content-Type", F.lit("application/http; msgtype=response")),
        _line("Content-Length", length.cast("string")),
        F.lit(EOL))
    headers = scratch.store(typed.withColumn("http", http).select("record", "page_id", "url", header.alias("header"), "http"),
                            "headers")
    scratch.drop("rows")
    return Archive(headers, payloads, headers.schema["page_id"].dataType.simpleString())


def field(name: str) -> Column:
    """A field of a record's header; null where it has none."""
    value = F.regexp_extract("header", rf"(?m)^{name}: ([^\r\n]*)", 1)
    return F.when(value != "", value)


def records(archive: Archive) -> DataFrame:
    """Every record again: page_id, url, header, http, payload, and ``block``, its bytes after the header.

    A payload that is missing or does not hash to its digest is an error. A revisit's block has
    the HTTP header alone; its payload is the one that it refers to.
    """
    intact = F.when(F.sha2("payload", 256) == F.col("digest"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("stored payload does not match its digest "), F.col("digest"))).cast("binary"))
    stored = archive.payloads.select("digest", intact.alias("payload"), F.lit(True).alias("_stored"))
    rows = archive.headers.withColumn("digest", F.regexp_extract("header", r"(?m)^WARC-Payload-Digest: sha256:([0-9a-f]{64})", 1))
    joined = join_hot(rows, stored, ["digest"], F.col("record"))
    payload = F.when(F.col("_stored"), F.col("payload")).otherwise(
        F.raise_error(F.concat(F.lit("no payload is stored under "), F.col("digest"))).cast("binary"))
    found = joined.withColumn("payload", payload).drop("_stored")
    body = F.when(field("WARC-Type") == "revisit", F.lit(b"")).otherwise(F.col("payload"))
    return found.withColumn("block", F.concat(F.col("http").cast("binary"), body))


def report(archive: Archive) -> DataFrame:
    """What the rebuilt records say: payload size and digest, type, and the page that a revisit refers to."""
    target = F.url_decode(F.regexp_extract(F.coalesce(field("WARC-Refers-To"), F.lit("")), r"^<urn:x-page:(.*):\d+>$", 1))
    referred = F.when(target != "", target.try_cast(archive.kind))
    return records(archive).select(
        "page_id", F.octet_length("payload").cast("long").alias("payload_bytes"), F.col("digest").alias("payload_digest"),
        field("WARC-Type").alias("record_type"), referred.alias("refers_to"))


def export(archive: Archive, folder: str) -> None:
    """The records as WARC files (``part-*.txt``), each ended by two line ends as the format wants."""
    whole = records(archive).select(F.concat(F.col("header").cast("binary"), F.col("block")).cast("string").alias("value"))
    whole.write.option("lineSep", EOL + EOL).text(folder)
