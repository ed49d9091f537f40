"""WARC archives: writing, reading back, and resolving equal payloads to revisit records."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docketry.llm.common import written
from docketry.session import scratch_path

RECORDS_A_FILE = 2_000  # and FILE_BYTES bound an archive
LARGE_BYTES = 1 << 16  # payloads from here on are written apart
FILE_BYTES = 1 << 27
READ_BYTES = 1 << 20  # of an archive that are unpacked at once
FAST = {"zlib.compress.level": "BEST_SPEED"}  # for archives that are rewritten soon

# Parts of the record format, and the base-32 digits of a payload digest.
VERSION = "WARC/1.1"
LINE = "\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
HTTP_HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"

_DIGITS = "0123456789ABCDEFGHIJKLMNOPQRSTUV"


def payload_digest(payload: Column) -> Column:
    """Bare base-32 SHA-1. Five hex digits are four base-32 digits."""
    sha = F.sha1(payload.cast("binary"))
    groups = [F.lpad(F.conv(F.substring(sha, 1 + 5 * k, 5), 16, 32), 4, "0") for k in range(8)]
    return F.translate(F.concat(*groups), _DIGITS, BASE32)


def _field(name: str, value: Column) -> Column:
    """A header line, or nothing for a null; control characters of a value are percent-encoded."""
    safe = value.cast("string")
    for code in (13, 10, 0):
        safe = F.replace(safe, F.lit(chr(code)), F.lit(f"%{code:02X}"))
    return F.coalesce(F.concat(F.lit(f"{name}: "), safe, F.lit(LINE)), F.lit(""))


def record_text(kind: Column, record_id: Column, page: Column, url: Column, payload: Column, digest: Column, size: Column, date: Column,
                refers_to: Column | None = None, refers_page: Column | None = None, refers_url: Column | None = None,
                refers_date: Column | None = None) -> Column:
    """One record up to, not including, the two line ends that close it."""
    block = F.when(kind == "revisit", F.lit(HTTP_HEAD)).otherwise(F.concat(F.lit(HTTP_HEAD), payload))
    none = F.lit(None).cast("string")
    return F.concat(
        F.lit(VERSION + LINE),
        _field("WARC-Type", kind), _field("WARC-Record-ID", F.concat(F.lit("<urn:uuid:"), record_id, F.lit(">"))),
        _field("WARC-Date", date), _field("WARC-Target-URI", url), _field("WARC-Page-ID", page),
        _field("WARC-Payload-Digest", F.concat(F.lit("sha1:"), digest)), _field("WARC-Payload-Length", size),
        _field("WARC-Profile", F.when(kind == "revisit", F.lit(PROFILE))),
        _field("WARC-Refers-To", F.concat(F.lit("<urn:uuid:"), refers_to, F.lit(">")) if refers_to is not None else none),
        _field("WARC-Refers-To-Page-ID", refers_page if refers_page is not None else none),
        _field("WARC-Refers-To-Target-URI", refers_url if refers_url is not None else none),
        _field("WARC-Refers-To-Date", refers_date if refers_date is not None else none),
        _field("Content-Type", F.lit("application/http;msgtype=response")), _field("Content-Length", F.octet_length(block)),
        F.lit(LINE), block,
    )


def _uuid(*parts: Column) -> Column:
    """A name that a repeated task gives again."""
    h = F.md5(F.concat_ws("/", *[F.coalesce(p.cast("string"), F.lit("-")) for p in parts]).cast("binary"))
    return F.concat_ws("-", *[F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))])


def _small(size: Column) -> Column:
    return F.coalesce(size, F.lit(0)) < LARGE_BYTES


def _write(records: Callable[[Callable[[Column], Column]], DataFrame], path: str, largest: int, **options: str) -> None:
    """``records`` gives the rows with a ``value`` whose payload's bytes pass a test; the closing line ends are the line separator.

    Large records have archives of their own with so few of them that none is beyond ``FILE_BYTES`` by much.
    """
    options = {"lineSep": 2 * LINE, "compression": "gzip", **options}
    records(_small).select("value").write.options(**options, maxRecordsPerFile=RECORDS_A_FILE).mode("append").text(path)
    if largest >= LARGE_BYTES:
        few = max(1, FILE_BYTES // largest)
        records(lambda size: ~_small(size)).select("value").write.options(**options, maxRecordsPerFile=few).mode("append").text(path)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    """Write every page as a response record into gzipped archives below ``path``.

    A null text is an empty payload, a null url or id leaves its header out. Archives are
    written by Spark's own text writer, so any store it reaches will do and lost tasks
    are repeated cleanly.
    """
    plain = pages.select(pages[id_col].cast("long").alias("p"), pages[url_col].cast("string").alias("u"), F.coalesce(pages[html_col], F.lit("")).alias("t"))
    marked = plain.withColumn("r", _uuid(F.col("p"), F.monotonically_increasing_id()))
    record = record_text(
        F.lit("response"), F.col("r"), F.col("p"), F.col("u"), F.col("t"), payload_digest(F.col("t")), F.octet_length("t"), F.lit(date)
    )
    largest = plain.agg(F.max(F.octet_length("t"))).first()[0] or 0
    sized = marked.select(record.alias("value"), F.octet_length("t").alias("size"))
    _write(lambda of: sized.where(of(F.col("size"))), path, largest, **FAST)


RECORD = (
    "kind string, record_id string, page_id long, url string, date string, digest string, payload_bytes long, refers_to string, "
    "refers_page long, refers_url string, refers_date string, head binary, payload binary"
)


def unpacked(raw: bytes, step: int = READ_BYTES) -> Iterator[bytes]:
    """An archive's bytes in pieces: as they are, or of all members of a gzip file, of which there may be one a record."""
    if raw[:2] != b"\x1f\x8b":
        yield from (raw[k : k + step] for k in range(0, len(raw), step))
        return
    view, at = memoryview(raw), 0
    while at < len(raw) and raw[at] != 0:  # zeros may fill up the file's end
        member = zlib.decompressobj(31)
        while not member.eof:
            sent = member.unconsumed_tail or view[at : at + (1 << 16)]
            if not len(sent):
                raise ValueError("archive ends inside a gzip member")
            at += 0 if member.unconsumed_tail else len(sent)
            yield member.decompress(sent, step)
        at -= len(member.unused_data)


def parsed(pieces: Iterator[bytes] | bytes) -> Iterator[tuple[dict[str, str], bytes, bytes]]:
    """Headers (names in lower case), their bytes, and the block of every record of an uncompressed archive.

    Takes the whole of it or its pieces in order, and holds one record and a piece at a time.
    """
    source = iter([pieces] if isinstance(pieces, bytes) else pieces)
    held = bytearray()

    def filled(n: int) -> bool:
        while len(held) < n:
            piece = next(source, None)
            if piece is None:
                return False
            held.extend(piece)
        return True

    while filled(1):
        seen = 0
        while (end := held.find(b"\r\n\r\n", seen)) < 0:
            seen = max(0, len(held) - 3)
            if not filled(len(held) + 1):
                raise ValueError("archive ends inside a header")
        head = bytes(held[:end])
        lines = head.decode("utf-8", "replace").split(LINE)
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"no record where one should start: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        if not filled(end + size + 8) or held[end + 4 + size : end + size + 8] != b"\r\n\r\n":
            raise ValueError(f"record {headers.get('warc-record-id')} is not closed")
        block = bytes(held[end + 4 : end + 4 + size])
        del held[: end + size + 8]
        yield headers, head, block


def _number(text: str | None) -> int | None:
    return int(text) if text is not None else None


def read_archives(spark: SparkSession, path: str, payloads: bool = True) -> DataFrame:
    """One row per record of the archives below ``path``: headers, and the payload unless switched off.

    Archives may be gzipped, in one member or many, or plain. Digest and length of a response are worked out from its payload
    and must agree with its headers where it has them; a revisit has those of its headers. Records of other kinds,
    like ``warcinfo`` or ``request``, come with their block as payload and their headers' bytes as ``head``. A task
    reads one archive at a time and unpacks it in pieces.
    """
    import base64
    import hashlib

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [c.split()[0] for c in RECORD.split(", ")]
        kinds = [{"long": pa.int64(), "binary": pa.binary()}.get(c.split()[1], pa.string()) for c in RECORD.split(", ")]
        for batch in batches:
            for content in batch.column(0):
                rows, held = [], 0
                for headers, head, block in parsed(unpacked(content.as_py())):
                    kind, said = headers["warc-type"], headers.get("warc-payload-digest", "").removeprefix("sha1:") or None
                    size, body, start = _number(headers.get("warc-payload-length")), None, None
                    if kind == "response":
                        body = block.partition(b"\r\n\r\n")[2] if headers.get("content-type", "").startswith("application/http") else block
                        found = base64.b32encode(hashlib.sha1(body).digest()).decode()
                        if said not in (None, found):
                            raise ValueError(f"payload of {headers['warc-record-id']} differs from its digest")
                        said, size = found, len(body)
                    elif kind != "revisit":
                        body, start, size = block, head, len(block)
                    rows.append(
                        (
                            kind, headers["warc-record-id"][10:-1], _number(headers.get("warc-page-id")), headers.get("warc-target-uri"),
                            headers.get("warc-date"), said, size, headers["warc-refers-to"][10:-1] if "warc-refers-to" in headers else None,
                            _number(headers.get("warc-refers-to-page-id")), headers.get("warc-refers-to-target-uri"),
                            headers.get("warc-refers-to-date"), start if payloads else None, body if payloads else None,
                        )
                    )
                    held += len(block)
                    if held > 1 << 24:
                        yield _table(rows, names, kinds)
                        rows, held = [], 0
                if rows:
                    yield _table(rows, names, kinds)

    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(run, RECORD)


def _table(rows: list[tuple], names: list[str], kinds: list[pa.DataType]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def resolve_revisits(spark: SparkSession, archives: str, out: str, least_bytes: int = 0) -> None:
    """Rewrite archives so that each payload is stored once; every other record of it revisits that one.

    Headers without payloads are shuffled by digest. Of the responses with equal
    payloads of at least ``least_bytes`` bytes the one with the largest page id stays (a
    null id last, then the larger record id); the others, and revisits that the archives
    already hold, refer to it by record, address and date. A revisit whose response is not there keeps its
    reference. Payloads move once, and only for responses that stay. Records of other kinds go through unchanged.
    """
    heads = written(read_archives(spark, archives, payloads=False).drop("payload", "head"), "heads")
    largest = heads.agg(F.max("payload_bytes")).first()[0] or 0
    paged = F.col("kind").isin("response", "revisit")
    order = F.struct(F.coalesce("page_id", F.lit(-(1 << 63))).alias("o"), "record_id", "page_id", "url", "date")
    originals = (
        heads.where((F.col("kind") == "response") & (F.col("payload_bytes") >= least_bytes))
        .groupBy("digest").agg(F.max(order).alias("original"))
    )
    joined = heads.where(paged).join(originals, "digest", "left")
    own = F.col("original.record_id")
    stays = (F.col("kind") == "response") & (own.isNull() | (own == F.col("record_id")))

    def referred(found: str, held: str) -> Column:
        return F.when(~stays, F.when(own.isNull(), F.col(held)).otherwise(F.col(f"original.{found}"))).alias(held)

    decided = joined.select(
        "record_id", "page_id", "url", "date", "digest", "payload_bytes", F.when(stays, F.lit("response")).otherwise("revisit").alias("kind"),
        referred("record_id", "refers_to"), referred("page_id", "refers_page"), referred("url", "refers_url"), referred("date", "refers_date"),
    )
    decided = written(decided, "decided")
    every_body = read_archives(spark, archives)
    payload = F.col("payload").cast("string").alias("payload")  # its bytes, whatever they are
    c = F.col
    fresh = _uuid(c("record_id"), F.lit("resolved"))
    record = record_text(
        c("kind"), fresh, c("page_id"), c("url"), c("payload"), c("digest"), c("payload_bytes"), c("date"), _uuid(c("refers_to"), F.lit("resolved")),
        c("refers_page"), c("refers_url"), c("refers_date"),
    )
    own_reference = F.when(c("kind") == "revisit", record).otherwise(
        record_text(c("kind"), fresh, c("page_id"), c("url"), c("payload"), c("digest"), c("payload_bytes"), c("date"))
    )

    def every(of: Callable[[Column], Column]) -> DataFrame:
        """The records of that size; only their payloads move."""
        bodies = every_body.where(F.col("kind") == "response").where(of(F.col("payload_bytes"))).select("record_id", payload)
        kept = decided.where(F.col("kind") == "response").where(of(F.col("payload_bytes"))).join(bodies, "record_id")
        rest = decided.where(F.col("kind") == "revisit").where(of(F.lit(None).cast("long")))
        return kept.unionByName(rest.withColumn("payload", F.lit("")).select(*kept.columns)).select(own_reference.alias("value"))

    _write(every, out, largest)
    if not heads.where(~paged).isEmpty():
        others = every_body.where(~paged).select(
            F.concat(c("head").cast("string"), F.lit(2 * LINE), c("payload").cast("string")).alias("value"), c("payload_bytes").alias("size")
        )
        _write(lambda of: others.where(of(F.col("size"))), out, largest)


def deduplicated_archive(pages: DataFrame, least_bytes: int = 0, path: str | None = None, **columns) -> DataFrame:
    """Write pages as WARC, resolve revisits, and read the resolved archives back.

    Returns a row per page: ``page_id, payload_bytes, payload_digest, record_type,
    refers_to``, the last the page id of the response for revisits. Archives go to
    ``path`` or to the shared folder. A null text is an empty payload; repeated rows are
    records of their own, one of which is the response; an empty table gives no rows;
    other columns are ignored.
    """
    spark = pages.sparkSession
    raw, out = scratch_path(spark, "llm-warc"), path or scratch_path(spark, "llm-warc-resolved")
    write_archives(pages, raw, **columns)
    resolve_revisits(spark, raw, out, least_bytes)
    return read_archives(spark, out, payloads=False).where(F.col("kind").isin("response", "revisit")).select(
        "page_id", "payload_bytes", F.col("digest").alias("payload_digest"), F.col("kind").alias("record_type"), F.col("refers_page").alias("refers_to")
    )
