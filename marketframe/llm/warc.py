"""WARC archives with resolved revisits.

Records are keyed by the SHA-1 of their payload. resolve() shuffles headers only: per digest the winner (largest page_id) is an
aggregate, so a payload that a third of all records share costs one row per task. write() joins the winners back on the
digest, renders one gzip member per record (revisits carry headers and no payload) and writes the members with Spark's text
writer; the separator between them is an empty gzip member, so each file is a plain .warc.gz that any WARC reader splits into
records. read() takes the archives back from whole files of about ARCHIVE_MB payload each, checks lengths and digests, and
restores() the payload of revisits by joining them to the responses they refer to.

expand() takes records from other archives that already hold revisits, joins each to its original by digest, and gives full
payloads, so that fresh headers never point to records outside the new archives.

Defined cases: a null html is an empty payload; a null url is written as an empty target; records smaller than least bytes are all
responses; rows that repeat page_id and payload are written alike (several responses if they win); a null page_id counts as
smaller than any other and such records revisit a winner that has an id, or are responses if none has; an empty table writes an
archive with no records. Payloads keep every byte. Other columns are ignored, so names may clash.
"""
from __future__ import annotations

import base64
import gzip
import hashlib
import io
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm.registry import query, table
from marketframe.session import shared_dir

#: payload megabytes per archive file, and bytes from which equal payloads are revisits
ARCHIVE_MB, LEAST = 16, 0
DATE = "2024-01-01T00:00:00Z"
#: a gzip member of no bytes
SEPARATOR = gzip.compress(b"", mtime=0).decode("latin-1")
READ = ("page_id long, url string, record_type string, payload_digest string, payload_bytes long, refers_to long, refers_to_uri string, "
        "html string, intact boolean")


def digest(payload: Column) -> Column:
    """Upper-case base32 of the SHA-1: five hexadecimal digits are four of base 32."""
    parts = [F.lpad(F.conv(F.substring(F.sha1(payload), 5 * i + 1, 5), 16, 32), 4, "0") for i in range(8)]
    return F.translate(F.upper(F.concat(*parts)), "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")


def records(pages: DataFrame) -> DataFrame:
    """page_id, url, html, payload_digest, payload_bytes of every row."""
    body = F.coalesce("html", F.lit(""))
    return pages.select("page_id", F.coalesce("url", F.lit("")).alias("url"), body.alias("html"),
                        digest(body.cast("binary")).alias("payload_digest"), F.octet_length(body).cast("long").alias("payload_bytes"))


def winners(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """payload_digest, winner, winner_url: the record that equal payloads of at least least bytes refer to."""
    return (rows.where((F.col("payload_bytes") >= least) & F.col("page_id").isNotNull()).groupBy("payload_digest")
            .agg(F.max(F.struct("page_id", "url")).alias("w")).select("payload_digest", F.col("w.page_id").alias("winner"), F.col("w.url").alias("winner_url")))


def resolve(rows: DataFrame, least: int = LEAST) -> DataFrame:
    """rows with record_type, refers_to and refers_to_uri."""
    won = winners(rows.select("page_id", "url", "payload_digest", "payload_bytes"), least)
    revisit = (F.col("payload_bytes") >= least) & F.col("winner").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("winner"))
    return rows.join(won, "payload_digest", "left").select(
        *rows.columns, F.when(revisit, "revisit").otherwise("response").alias("record_type"),
        F.when(revisit, F.col("winner")).alias("refers_to"), F.when(revisit, F.col("winner_url")).alias("refers_to_uri"))


def record_id(page_id: int | None) -> str:
    return f"<urn:uuid:{uuid.UUID(bytes=hashlib.md5(f'page {page_id}'.encode()).digest())}>"


def _line(text: str | None) -> str:
    """A header value stays on its line."""
    return (text or "").replace("\r", "%0D").replace("\n", "%0A")


def render(page_id, url, kind, sha, refers_to, refers_to_uri, payload: bytes) -> bytes:
    """One record with fresh headers; Content-Length counts the block that follows."""
    head = [f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id)}", f"WARC-Date: {DATE}", f"WARC-Target-URI: {_line(url)}",
            f"WARC-Payload-Digest: sha1:{sha}", f"X-Page-ID: {'' if page_id is None else page_id}", f"X-Payload-Length: {len(payload)}"]
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    block = http + payload
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}",
                 f"WARC-Refers-To-Target-URI: {_line(refers_to_uri)}", f"X-Refers-To-Page: {refers_to}"]
        block = http
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return ("WARC/1.1\r\n" + "\r\n".join(head) + "\r\n\r\n").encode() + block + b"\r\n\r\n"


def _members(batches):
    for batch in batches:
        head = list(zip(*(batch.column(c).to_pylist() for c in ("page_id", "url", "record_type", "payload_digest", "refers_to", "refers_to_uri"))))
        html, out, size = batch.column("html"), [], 0
        for i, fields in enumerate(head):
            out.append(gzip.compress(render(*fields, (html[i].as_py() or "").encode()), 4, mtime=0))
            size += len(out[-1])
            if size > 1 << 22 or i == len(head) - 1:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["member"])
                out, size = [], 0


def write(resolved: DataFrame, path: str, per_file: int) -> None:
    """Write the records as gzip archives of at most per_file records; resolved: the columns of resolve()."""
    held = resolved.select("page_id", "url", "record_type", "payload_digest", "refers_to", "refers_to_uri", "html")
    members = held.mapInArrow(_members, "member binary").select(F.col("member").cast("string").alias("value"))
    members.write.mode("overwrite").option("maxRecordsPerFile", per_file).option("lineSep", SEPARATOR).option("encoding", "ISO-8859-1").text(path)


def _headers(head: bytes) -> dict[str, str]:
    return dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:] if ": " in x)


def parse(stream) -> list[tuple[dict[str, str], bytes]]:
    """(headers, block) of every record, by Content-Length."""
    while True:
        line = stream.readline()
        if not line:
            return
        head = [line.rstrip(b"\r\n")]
        if not head[0].startswith(b"WARC/"):
            raise ValueError(f"no record where one was expected: {line[:40]!r}")
        while (line := stream.readline()) not in (b"\r\n", b""):
            head.append(line.rstrip(b"\r\n"))
        fields = _headers(b"\r\n".join(head))
        block = stream.read(int(fields["Content-Length"]))
        if stream.read(4) != b"\r\n\r\n":
            raise ValueError(f"record {fields.get('WARC-Record-ID')} is cut")
        yield fields, block


def _records(batches, payloads: bool):
    names = [x.split()[0] for x in READ.split(", ")]
    types = {"page_id": pa.int64(), "payload_bytes": pa.int64(), "refers_to": pa.int64(), "intact": pa.bool_()}

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(x, types.get(n, pa.string())) for n, x in zip(names, zip(*rows))], names=names)
    for batch in batches:
        for content in batch.column("content"):
            rows, held = [], 0
            for fields, block in parse(gzip.GzipFile(fileobj=io.BytesIO(content.as_buffer()))):
                kind = fields["WARC-Type"]
                body = block.split(b"\r\n\r\n", 1)[1]
                own = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                intact = kind == "revisit" or (base64.b32encode(hashlib.sha1(body).digest()).decode() == own and len(body) == int(fields["X-Payload-Length"]))
                rows.append((int(fields["X-Page-ID"]) if fields["X-Page-ID"] else None, fields["WARC-Target-URI"], kind, own, int(fields["X-Payload-Length"]),
                             int(fields["X-Refers-To-Page"]) if kind == "revisit" else None, fields.get("WARC-Refers-To-Target-URI"),
                             body.decode("utf-8", "replace") if payloads and kind == "response" else None, intact))
                held += len(body) if payloads else 0
                if len(rows) >= 2000 or held > 1 << 22:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)


def read(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """The records of the archives under path; html is null for revisits (and for all without payloads)."""
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(lambda b: _records(b, payloads), READ)


def expand(found: DataFrame) -> DataFrame:
    """Records with revisits joined to their original responses by digest: every row has its payload, or null if none was found."""
    originals = (found.where("record_type = 'response'").groupBy("payload_digest").agg(F.max_by("html", "page_id").alias("__html")))
    return (found.join(originals, "payload_digest", "left")
            .withColumn("html", F.when(F.col("record_type") == "revisit", F.col("__html")).otherwise(F.col("html"))).drop("__html"))


def archive(pages: DataFrame, path: str, least: int = LEAST, archive_mb: int = ARCHIVE_MB, payloads: bool = True) -> DataFrame:
    """Write pages as deduplicated archives under path, of about archive_mb of payload each, and read them back."""
    mean = pages.agg(F.avg(F.octet_length("html"))).first()[0] or 1.0
    write(resolve(records(pages), least), path, max(1, int((archive_mb << 20) / max(mean, 1.0))))
    found = read(pages.sparkSession, path, payloads)
    cut = F.raise_error(F.concat(F.lit("payload differs from its digest: "), F.col("payload_digest")))
    return found.withColumn("record_type", F.when(F.col("intact"), F.col("record_type")).otherwise(cut.cast("string")))


SQL = """
WITH r AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
g AS (SELECT *, [CAST(concat('0x', substr(h, 5 * CAST(i AS INTEGER) + 1, 5)) AS BIGINT) for i in range(0, 8)] AS v FROM r),
d AS (SELECT page_id, payload_bytes, array_to_string(list_transform(v, lambda x: concat(
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x // 32768 AS INTEGER) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x // 1024 AS INTEGER) % 32 + 1, 1),
        substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x // 32 AS INTEGER) % 32 + 1, 1), substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', CAST(x AS INTEGER) % 32 + 1, 1))), '') AS payload_digest
      FROM g),
w AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest) AS winner FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id = winner THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> winner THEN winner END AS refers_to
FROM w
"""


@query("op8_warc_revisits", SQL)
def op8_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{shared_dir(spark).rstrip('/')}/warc-{uuid.uuid4().hex}"
    return archive(table(spark, sf_dir, "pages"), path, payloads=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
