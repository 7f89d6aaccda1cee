"""Web archives: written record by record with revisits of equal payloads, read back past damage.

The writer gives each payload one response record and each further capture of it a revisit, one gzip member a record, or
plain records. The reader checks lengths, digests and member checksums. Where a check fails it searches for the next gzip
member or version line from which a whole record can be read, goes on there, and returns the bytes between as a gap with
the reason. A file is read by one task; the writer's files are as large as a shuffle partition, RECORDS records at most."""

from __future__ import annotations

import base64
import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

VERSION = re.compile(rb"WARC/\d\.\d+\r\n")
MEMBER = b"\x1f\x8b\x08"
#: Where reading can go on.
NEXT = re.compile(rb"\x1f\x8b\x08|WARC/\d\.\d+\r\n")
#: A header line, and the fields that a record has once.
FIELD, SINGLE = re.compile(rb"([!-9;-~]+):[ \t]*([^\x00-\x08\x0a-\x1f\x7f]*?)[ \t]*"), ("warc-type", "warc-record-id", "content-length")
#: Largest header of a record, bytes fed to a decompressor at once, records of a file, and bytes of an output batch.
HEADER, FEED, RECORDS, BATCH = 1 << 16, 1 << 14, 20_000, 8 << 20
#: Fixed value: the profile of a revisit by equal digest.
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
#: A group of captures of one payload counts as hot above this share of all: fewer than 1000 groups are.
HOT = 1000


class Damaged(ValueError):
    """What is wrong at a place, and the records before it that passed their own checks."""

    def __init__(self, reason: str, records: list | None = None):
        super().__init__(reason)
        self.records = records or []


def sha1_32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def bare(value: str) -> str:
    """A header value without line breaks or other control characters, which are percent-encoded."""
    return re.sub(r"[\x00-\x1f\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, fields: list[tuple[str, str]], block: bytes) -> bytes:
    """A whole record but for the two line ends behind its block."""
    lines = [("WARC-Type", kind), *fields, ("WARC-Block-Digest", f"sha1:{sha1_32(block)}"), ("Content-Length", str(len(block)))]
    return "".join(["WARC/1.1\r\n", *(f"{k}: {bare(v)}\r\n" for k, v in lines), "\r\n"]).encode() + block


def gzip_member(data: bytes) -> bytes:
    z = zlib.compressobj(6, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def member(data: bytes, at: int) -> tuple[bytes, int]:
    """The content of the gzip member at a place, and its end."""
    z, out, pos = zlib.decompressobj(31), [], at
    try:
        while not z.eof:
            if pos >= len(data):
                raise zlib.error("cut off")
            out.append(z.decompress(data[pos : pos + FEED]))
            pos += FEED
    except zlib.error as e:
        raise Damaged(f"gzip member: {str(e).rpartition(': ')[2]}", trusted(b"".join(out))) from None
    return b"".join(out), min(pos, len(data)) - len(z.unused_data)


def trusted(data: bytes) -> list[dict]:
    """Records at the start of a damaged member that their own digest proves."""
    out, at = [], 0
    try:
        while at < len(data):
            r, at = plain(data, at)
            if not r["proved"]:
                break
            out.append(r)
    except Damaged:
        pass
    return out


def plain(data: bytes, at: int) -> tuple[dict, int]:
    """The record at a version line, and its end; lengths and digests are checked."""
    line = VERSION.match(data, at)
    if not line:
        raise Damaged("no version line")
    stop = data.find(b"\r\n\r\n", line.end() - 2, line.end() + HEADER)
    if stop < 0:
        raise Damaged("header without end")
    fields: dict[str, str] = {}
    for one in re.sub(rb"\r\n[ \t]+", b" ", data[line.end() : stop]).split(b"\r\n"):
        line = FIELD.fullmatch(one)
        if not line or (name := line[1].lower().decode()) in fields and name in SINGLE:
            raise Damaged("header with a broken line")  # or two records' headers run together
        fields.setdefault(name, line[2].decode("utf-8", "replace"))
    size = fields.get("content-length", "")
    if not re.fullmatch("[0-9]{1,18}", size):
        raise Damaged("no length")
    first, end = stop + 4, stop + 4 + int(size)
    if end + 4 > len(data) or data[end : end + 4] != b"\r\n\r\n":
        raise Damaged("length does not hold")
    block = data[first:end]
    head, parted, payload = block.partition(b"\r\n\r\n")
    http = fields.get("content-type", "").startswith("application/http")
    if not (http and parted):
        head, payload = b"", block
    revisit = fields.get("warc-type") == "revisit"
    proved = False
    for name, part in (("warc-block-digest", block), ("warc-payload-digest", None if revisit else payload)):
        how, _, digest = fields.get(name, "").partition(":")
        if how.lower() == "sha1" and part is not None:
            if sha1_32(part) != digest.upper():
                raise Damaged(f"{name} does not hold")
            proved = True
    length = re.search(rb"(?im)^content-length:\s*([0-9]{1,18})\s*$", head)
    n = int(length[1]) if revisit and length else len(payload)
    given = fields.get("warc-payload-digest", "").rpartition(":")[2].upper()
    r = {
        "record_type": fields.get("warc-type"),
        "record_id": fields.get("warc-record-id"),
        "refers_to": fields.get("warc-refers-to"),
        "target_uri": fields.get("warc-target-uri"),
        "warc_date": fields.get("warc-date"),
        "payload": None if revisit else payload,
        "payload_bytes": n,
        "payload_digest": given if revisit else sha1_32(payload),
        "proved": proved,
    }
    return r, end + 4


def unit(data: bytes, at: int) -> tuple[list[dict], int]:
    """The records of the member or the plain record at a place, and its end."""
    if not data.startswith(MEMBER, at):
        r, end = plain(data, at)
        return [r], end
    inner, end = member(data, at)
    out, pos = [], 0
    while pos < len(inner):
        try:
            r, pos = plain(inner, pos)
        except Damaged as e:
            raise Damaged(f"in a member: {e}", out) from None
        out.append(r)
    return out, end


def salvage(data: bytes) -> Iterator[dict]:
    """The rows of a file: its records in order, and the gaps between them that hold no whole record."""
    at, bad, reason = 0, None, None
    while at < len(data):
        try:
            found, end = unit(data, at)
        except Damaged as e:
            if bad is None:
                bad, reason = at, str(e)
            yield from ({"kind": "record", "start": at, "end": None} | r for r in e.records)
            ahead = NEXT.search(data, at + 1)
            at = ahead.start() if ahead else len(data)
            continue
        if bad is not None:
            yield {"kind": "gap", "start": bad, "end": at, "reason": reason}
            bad = None
        yield from ({"kind": "record", "start": at, "end": end} | r for r in found)
        at = end
    if bad is not None:
        yield {"kind": "gap", "start": bad, "end": len(data), "reason": reason}


SCHEMA = (
    "path string, kind string, start long, end long, reason string, record_type string, record_id string, refers_to string, "
    "target_uri string, warc_date string, payload_bytes long, payload_digest string"
)


def read_warc(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """Rows of kind record or gap of all files below path, gzipped or plain or both in one file.

    A record: its place, header fields, payload (if asked for), size and digest; those of a revisit are what its header says
    of the full payload. `end` is null for a record out of a damaged member, whose bytes are in a gap, too. A gap: the bytes
    [start, end) that hold no whole record, and why. An empty file has no rows. Where a version line stands inside the
    payload of a damaged record, a whole record behind it is taken as one."""
    schema = SCHEMA + ", payload binary" * payloads
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterator) -> Iterator:
        import pandas as pd

        for b in batches:
            for path, content in zip(b["path"], b["content"]):
                rows, size = [], 0
                for r in salvage(bytes(content)):
                    rows.append([path, *(r.get(n) for n in names[1:])])
                    size += 300 + (len(r.get("payload") or b"") if payloads else 0)
                    if size > BATCH:
                        yield frame(pd, rows, names)
                        rows, size = [], 0
                yield frame(pd, rows, names)

    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "content")
    return files.mapInPandas(run, schema)


def frame(pd, rows: list, names: list[str]):
    out = pd.DataFrame(rows, columns=names)
    return out.astype({n: "Int64" for n in ("start", "end", "payload_bytes")})


def records(read: DataFrame) -> DataFrame:
    return read.filter("kind = 'record'").drop("kind", "reason")


def gaps(read: DataFrame) -> DataFrame:
    """The log of quarantined bytes: path, start, end, reason."""
    return read.filter("kind = 'gap'").select("path", "start", "end", "reason")


def record_id(kind: str, key, uri, digest: str, copy: str) -> str:
    """An id that says which row the record stands for; copy tells repeated rows apart."""
    name = "" if key is None else str(key)
    return f"<urn:page:{name}:{uuid.uuid5(uuid.NAMESPACE_URL, repr((kind, name, uri, digest, copy)))}>"


def key_of(record_id: Column) -> Column:
    return F.nullif(F.regexp_extract(record_id, "^<urn:page:(.*):[^:]*>$", 1), F.lit(""))


def entries(date: str, compressed: bool):
    """Rows of captures() to the bytes of records."""
    end = b"\r\n\r\n"

    def run(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for b in batches:
            out, size = [], 0
            for r in zip(*(b.column(i) for i in range(b.num_columns))):
                key, uri, sha1, n, payload, to, to_uri, copy = (x.as_py() for x in r)
                digest = base64.b32encode(bytes.fromhex(sha1)).decode()
                revisit = payload is None
                kind = "revisit" if revisit else "response"
                head = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % n
                fields = [("WARC-Record-ID", record_id(kind, key, uri, digest, copy)), ("WARC-Date", date)]
                fields += [("WARC-Target-URI", uri)] * (uri is not None)
                fields += [("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
                if revisit:
                    fields += [("WARC-Profile", PROFILE), ("WARC-Refers-To", record_id("response", to, to_uri, digest, ""))]
                    fields += [("WARC-Refers-To-Target-URI", to_uri)] * (to_uri is not None)
                made = record(kind, fields, head + (payload or b""))
                out.append(gzip_member(made + end) if compressed else made)
                size += len(out[-1])
                if size > BATCH:
                    yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])
                    out, size = [], 0
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], names=["record"])

    return run


def captures(pages: DataFrame, key: str, uri: str, payload: str) -> DataFrame:
    """key, uri, sha1, n, payload, to, to_uri, copy: the response of each payload with it, and the further rows without.

    Payloads go through one shuffle in which each task has sent its own copies once; which rows revisit is found on rows
    without payloads. The few hot groups are broadcast (fewer than HOT rows), so no join key has more than 1/HOT of all."""
    body = F.coalesce(F.col(payload).cast("binary"), F.lit("").cast("binary"))
    rows = pages.select(F.col(key).alias("key"), F.col(uri).alias("uri"), F.sha1(body).alias("sha1"), F.octet_length(body).cast("long").alias("n"), body.alias("payload"))
    same = ["sha1", "n"]
    first = F.max(F.struct("key", "uri")).alias("first")
    response = rows.groupBy(*same).agg(first, F.any_value("payload").alias("payload"))
    none = F.lit(None)
    response = response.select("first.key", "first.uri", *same, "payload", none.cast(rows.schema["key"].dataType).alias("to"), none.cast("string").alias("to_uri"), F.lit("").alias("copy"))

    # each task counts its repeated rows; the written numbers of tasks hold for all that follows
    count = rows.select("key", "uri", *same).withColumn("task", F.spark_partition_id())
    count = materialize(count.groupBy("key", "uri", *same, "task").agg(F.count("*").alias("rows")), "captures")
    group = count.groupBy(*same).agg(F.max(F.struct("key", "uri", "task")).alias("first"), F.sum("rows").alias("size")).filter("size > 1")
    total = count.agg(F.sum("rows")).first()[0] or 0
    hot, rest = group.filter(F.col("size") > total / HOT), group.filter(F.col("size") <= total / HOT)
    often = F.broadcast(hot)
    met = count.join(often, same).unionByName(count.join(often.select(*same), same, "left_anti").join(rest, same))
    left = F.col("rows") - F.struct("key", "uri", "task").eqNullSafe(F.col("first")).cast("long")
    more = met.withColumn("left", left).filter("left > 0").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("left"))))
    revisit = more.select("key", "uri", *same, F.lit(None).cast("binary").alias("payload"), F.col("first.key").alias("to"), F.col("first.uri").alias("to_uri"), F.concat_ws("-", "task", "i").alias("copy"))
    return response.unionByName(revisit)


def write_warc(pages: DataFrame, path: str, key: str = "page_id", uri: str = "url", payload: str = "html", compressed: bool = True, date: str = "1970-01-01T00:00:00Z") -> None:
    """A record for each row of pages below path, by Spark's own text writer, so committed by task attempts.

    Of rows with equal payloads the one with the largest key is the response; the others revisit it. Defined results: a null
    payload is empty; a null key is the smallest; of equal keys the larger uri is the response, and of rows equal in both
    any one, the others revisiting it under the same key; control characters in a uri are percent-encoded; an empty table
    gives files without records. Other columns are ignored, so that their names can't clash.

    What parts records in a file is the two line ends that close a plain record, or an empty gzip member, which adds nothing
    to what the others unpack to."""
    made = captures(pages, key, uri, payload).mapInArrow(entries(date, compressed), "record binary")
    part = gzip_member(b"").decode("latin-1") if compressed else "\r\n\r\n"
    out = made.select(F.col("record").cast("string").alias("value")).write.option("lineSep", part).option("encoding", "ISO-8859-1")
    out.option("maxRecordsPerFile", RECORDS).text(path)


def op11_warc(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    path = f"{shared_dir(spark)}/warc-{uuid.uuid4().hex}"
    write_warc(pages, path)
    read = records(read_warc(spark, path, payloads=False))
    page = lambda c: key_of(F.col(c)).cast(pages.schema["page_id"].dataType)
    return read.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", "record_type", page("refers_to").alias("refers_to"))


OP11_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS n, sha1(b) AS h FROM p),
g AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM d)
SELECT page_id, n AS payload_bytes,
  array_to_string(list_transform(range(4), lambda i: array_to_string(list_transform(range(8), lambda j:
    'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[((('0x' || h[i * 10 + 1:i * 10 + 10])::BIGINT >> (35 - 5 * j)) & 31) + 1]), '')), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> last THEN last END AS refers_to
FROM g
"""
