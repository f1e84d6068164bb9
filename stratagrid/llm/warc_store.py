"""Content-addressed WARC archive: payload bytes once by digest, exact record headers apart.

Two tables make an archive. `payloads` holds each distinct payload once, under its SHA-256; `headers` holds,
for each record, the exact bytes of its WARC and HTTP headers and the address of its payload. Joining them
gives the original records again, and reading is parsing the bytes of those records. Payloads are dealt into
buckets by address when they are written, so the join moves headers to them and they stay where they are.
Everything here is DataFrame operations.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_dir, written

CRLF = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


#: Payloads below so many bytes are not deduplicated into revisits by default, so many records may share one.
SMALL = 1000
#: An address is hot when more than one in so many records has it, so there are fewer hot addresses than this.
HOT = 1000


@dataclass(frozen=True)
class Archive:
    headers: DataFrame
    payloads: DataFrame


def _clean(c: Column) -> Column:
    """A header value on one line."""
    return F.regexp_replace(c, "[\r\n]", " ")


def _bucketed(df: DataFrame, column: str) -> DataFrame:
    """df as a table in the shared folder, in as many buckets by a column as the session shuffles into."""
    spark = df.sparkSession
    name = f"warc_payloads_{uuid.uuid4().hex}"
    df.write.partitionBy("small").bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), column).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    return spark.table(name)


def _hot(payloads: DataFrame) -> DataFrame:
    """The facts of hot addresses: fewer than HOT rows whatever the archive."""
    records = payloads.agg(F.sum("copies")).first()[0] or 0
    return payloads.where(F.col("copies") > records // HOT)


def _joined(rows: DataFrame, facts: DataFrame, hot: DataFrame, on: list[str], spread: Column) -> DataFrame:
    """rows with the facts of their keys, each key once in facts; rows without facts go.

    Rows of the hot keys take their facts from a broadcast copy and go through the other join under keys that nothing
    has, dealt by `spread`. So no task meets all rows of a key, and rows are read once. The last key is a string."""
    names, last = [c for c in facts.columns if c not in on], on[-1]
    marked = rows.join(F.broadcast(hot.select(*on, F.struct(*names).alias("near"))), on, "left")
    nothing = F.concat(F.lit("hot "), F.pmod(spread, F.lit(1 << 16)).cast("string"))
    marked = marked.withColumn("key", F.when(F.col("near").isNull(), F.col(last)).otherwise(nothing))
    far = facts.select(*on[:-1], F.col(last).alias("key"), F.struct(*names).alias("far"))
    met = marked.join(far, [*on[:-1], "key"], "left").where("near is not null or far is not null")
    return met.select(*rows.columns, *(F.coalesce("near", "far")[n].alias(n) for n in names))


def write_archive(pages: DataFrame, least_bytes: int = 1000, date: str = "1970-01-01T00:00:00Z") -> Archive:
    """A record for each row of pages(page_id, url, html); a null html is the empty payload.

    Of records with equal payloads of at least least_bytes bytes, the one with the largest page_id is the
    response and the others revisit it; rows that repeat that page_id are responses too. Smaller payloads
    are all responses. A null url leaves its header line out; a null page_id sorts below all others.
    A payload of any length is one value. Other columns are not read. An empty table gives an empty archive.
    """
    payload = F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), payload.alias("payload"))
    rows = rows.withColumns({"address": F.sha2("payload", 256), "n": F.octet_length("payload").cast("long")})
    # one row for each address: copies meet in the partial aggregation before the shuffle
    stored = rows.groupBy("address").agg(F.max("page_id").alias("owner"), F.count("*").alias("copies"), F.first("payload").alias("payload"))
    payloads = _bucketed(stored.withColumns({"sha1": F.sha1("payload"), "small": F.octet_length("payload") < SMALL}), "address")
    facts = ("address", "owner", "sha1")
    found = _joined(rows.drop("payload"), payloads.select(*facts), _hot(payloads).select(*facts), ["address"], F.xxhash64("page_id", "url"))
    revisit = (F.col("n") >= least_bytes) & ~F.col("page_id").eqNullSafe(F.col("owner"))
    http = F.concat(F.lit(f"HTTP/1.1 200 OK{CRLF}Content-Type: text/html; charset=utf-8{CRLF}Content-Length: "), F.col("n").cast("string"), F.lit(CRLF + CRLF))
    body = F.when(F.col("revisit"), F.lit(0)).otherwise(F.col("n"))

    def line(name: str, value: Column) -> Column:
        return F.coalesce(F.concat(F.lit(f"{name}: "), value, F.lit(CRLF)), F.lit(""))

    def urn(c: Column) -> Column:
        return F.concat(F.lit("<urn:page:"), F.coalesce(c.cast("string"), F.lit("")), F.lit(">"))

    warc = F.concat(
        F.lit(f"WARC/1.1{CRLF}"),
        line("WARC-Type", F.when(F.col("revisit"), "revisit").otherwise("response")),
        line("WARC-Record-ID", urn(F.col("page_id"))),
        line("WARC-Date", F.lit(date)),
        line("WARC-Target-URI", _clean(F.col("url"))),
        line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), F.col("sha1"))),
        line("WARC-Profile", F.when(F.col("revisit"), PROFILE)),
        line("WARC-Refers-To", F.when(F.col("revisit"), urn(F.col("owner")))),
        line("Content-Type", F.lit("application/http;msgtype=response")),
        line("Content-Length", (F.octet_length("http") + body).cast("string")),
        F.lit(CRLF))
    headers = found.withColumn("revisit", revisit).withColumn("http", http).select(
        "address", "n", F.concat(warc.cast("binary"), F.col("http").cast("binary")).alias("header"))
    return Archive(written(headers, "warc-headers"), payloads)


def _field(header: Column, name: str) -> Column:
    """The value of a header field; null where there is none."""
    found = F.regexp_extract(header, rf"\r\n{name}: ([^\r\n]*)\r\n", 1)
    return F.nullif(found, F.lit(""))


def _page(value: Column) -> Column:
    return F.nullif(F.regexp_extract(value, r"<urn:page:(-?\d*)>", 1), F.lit("")).cast("long")


def _parts(archive: Archive) -> tuple[DataFrame, DataFrame]:
    """The records of responses and of revisits, rebuilt by joins."""
    end, revisit = F.lit(CRLF + CRLF).cast("binary"), _field(F.decode("header", "ISO-8859-1"), "WARC-Type") == "revisit"
    intact = F.assert_true(F.sha2("payload", 256) == F.col("address"), F.lit("a stored payload does not match its address"))

    def stored(found: DataFrame, small: bool) -> DataFrame:
        return found.where(F.col("small") == small).select("address", "payload", intact.alias("checked")).where("checked is null").drop("checked")

    first = archive.headers.where(~revisit)
    # large payloads have one response each; of small ones many records may share one (hot ones are under a megabyte in all)
    large = first.where(F.col("n") >= SMALL).join(stored(archive.payloads, False), "address")
    small = _joined(first.where(F.col("n") < SMALL), stored(archive.payloads, True), stored(_hot(archive.payloads), True), ["address"], F.xxhash64("header"))
    whole = F.concat("header", "payload", end).alias("record")
    return large.select(whole).unionByName(small.select(whole)), archive.headers.where(revisit).select(F.concat("header", end).alias("record"))


def records(archive: Archive) -> DataFrame:
    """(record) of all original records: header, payload (none in a revisit) and the closing blank lines.

    A stored payload whose SHA-256 is not its address fails the job."""
    first, again = _parts(archive)
    return first.unionByName(again)


def _parsed(found: DataFrame) -> DataFrame:
    """What the bytes of records say: header fields, and the payload behind the HTTP header."""
    # one character a byte, so places in the text are places in the record; the second blank line ends the headers
    head = F.substring_index(F.decode("record", "ISO-8859-1"), CRLF + CRLF, 2)
    return found.withColumn("head", head).select(
        _page(_field(F.col("head"), "WARC-Record-ID")).alias("page_id"),
        _field(F.col("head"), "WARC-Type").alias("record_type"),
        _page(_field(F.col("head"), "WARC-Refers-To")).alias("refers_to"),
        _field(F.col("head"), "WARC-Payload-Digest").alias("named"),
        F.expr("substring(record, length(head) + 5, octet_length(record) - length(head) - 8)").alias("body"))


def read_archive(archive: Archive) -> DataFrame:
    """What each record says of itself, with payloads measured anew: every record is rebuilt and its bytes parsed.

    A response's payload_bytes and payload_digest are those of the bytes behind its HTTP header; a revisit, which
    has none, takes those of the record that it refers to. A response whose bytes do not have the digest that
    its header names fails the job."""
    first, again = map(_parsed, _parts(archive))
    first = first.withColumns({"payload_bytes": F.octet_length("body").cast("long"), "payload_digest": F.sha1("body")})
    right = F.assert_true(F.col("named") == F.concat(F.lit("sha1:"), F.col("payload_digest")), F.lit("a payload does not have the digest that its header names"))
    first = written(first.withColumn("checked", right).where("checked is null").drop("checked", "body"), "warc-responses")
    owners = first.groupBy(F.col("page_id").alias("refers_to"), "named").agg(F.first("payload_bytes").alias("payload_bytes"), F.first("payload_digest").alias("payload_digest"))
    hot = _hot(archive.payloads).select(F.col("owner").alias("refers_to"), F.concat(F.lit("sha1:"), F.col("sha1")).alias("named"))
    again = _joined(again.drop("body"), owners, owners.join(F.broadcast(hot), ["refers_to", "named"], "left_semi"), ["refers_to", "named"], F.xxhash64("page_id"))
    columns = ("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
    return first.select(*columns).unionByName(again.select(*columns))
