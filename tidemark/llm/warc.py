"""WARC archives: writing with revisits and segments, reading with reassembly.

Records are composed in Spark expressions and written by Spark's text writer, whose line
separator is the two CRLFs behind a record, so archives go to any store that Spark
reaches.  Reading parses ``Content-Length`` framing, file by file; records that are
segmented are grouped by their origin's id, put in order by segment number, checked
against the total length and only then decoded (HTTP headers, chunked transfer framing).
"""

from __future__ import annotations

import zlib

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import partitions, saved, scratch_path, tidy

#: Characters of a chunk, and of a record's segment.
CHUNK = 1 << 16
SEGMENT = 1 << 20
#: Payloads from this many bytes on are stored once.
REVISIT_BYTES = 1000
#: Records of a file, and bytes of one before compression, on average; a file is read as one cell.
FILE_RECORDS, FILE_BYTES = 4096, 1 << 28
#: Repeated payloads up to which their digests (some 200 bytes each) are broadcast; beyond,
#: pages that may repeat one are joined.
BROADCAST_PAYLOADS = 50_000
DATE = "2024-01-01T00:00:00Z"
HEAD = "HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"


def _cut(text: Column, width: int) -> Column:
    """The text in pieces of ``width`` characters; none of an empty text."""
    count = F.ceil(F.char_length(text) / F.lit(width)).cast("int")
    places = F.when(count > 0, F.sequence(F.lit(1), F.greatest(count, F.lit(1)))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda k: F.substring(text, (k - 1) * width + 1, F.lit(width)))


def _record_id(kind: Column) -> Column:
    """A name that equal pages share: of rows that are the same in id, url and text."""
    return F.concat(F.lit("<urn:md5:"), F.md5(F.to_json(F.struct(kind, "__id", "__url", "__sha")).cast("binary")), F.lit(">"))


def repeated(pages: DataFrame, least: int = REVISIT_BYTES) -> DataFrame:
    """Payloads of ``least`` bytes or more that occur twice: the page with the largest id."""
    groups = pages.where(F.col("__bytes") >= least).groupBy("__sha").agg(F.max(F.struct("__id", "__url")).alias("__top"), F.count("*").alias("__n"))
    return groups.where("__n > 1 and __top.__id is not null").select("__sha", F.col("__top.__id").alias("__first"), F.col("__top.__url").alias("__first_url"))


def composed(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", segment: int = SEGMENT, chunk: int = CHUNK, least: int = REVISIT_BYTES) -> DataFrame:
    """``(value)``: one WARC record or segment per row, without the closing CRLFs.

    A null text is an empty payload, a null url an empty one, and a page with a null id has
    no ``X-Page-Id``; other columns are left out.
    """
    text = F.coalesce(F.col(text_col), F.lit(""))
    url = F.regexp_replace(F.coalesce(F.col(url_col), F.lit("")), r"[\r\n]", "%0A")
    rows = pages.select(F.col(id_col).cast("long").alias("__id"), url.alias("__url"), text.alias("__text"))
    rows = rows.withColumns({"__sha": F.sha2(F.col("__text").cast("binary"), 256), "__sha1": F.sha1(F.col("__text").cast("binary")), "__bytes": F.octet_length("__text")})
    # Digests are found on slim rows and come back to the pages; payloads stay where they are.
    firsts = saved(repeated(rows.drop("__text"), least), "repeated")
    few = firsts.count() <= BROADCAST_PAYLOADS
    if few:
        rows = rows.join(F.broadcast(firsts), "__sha", "left")
    else:  # small and empty payloads, which repeat most, are dealt by their page
        key = F.when(F.col("__bytes") >= least, F.col("__sha")).otherwise(F.concat(F.lit("page "), F.col("__id").cast("string")))
        rows = rows.withColumn("__key", key).join(firsts.withColumnRenamed("__sha", "__key"), "__key", "left")
    again = F.col("__first").isNotNull() & ~F.col("__id").eqNullSafe(F.col("__first"))
    rows = rows.withColumn("__again", again)
    own = _record_id(F.when(F.col("__again"), "revisit").otherwise("response").alias("k"))
    target = F.concat(F.lit("<urn:md5:"), F.md5(F.to_json(F.struct(F.lit("response").alias("k"), F.col("__first").alias("__id"), F.col("__first_url").alias("__url"), "__sha")).cast("binary")), F.lit(">"))
    pieces = F.transform(_cut(F.col("__text"), chunk), lambda c: F.concat(F.lower(F.conv(F.octet_length(c).cast("string"), 10, 16)), F.lit("\r\n"), c, F.lit("\r\n")))
    block = F.when(F.col("__again"), F.lit("HTTP/1.1 200 OK\r\n\r\n")).otherwise(F.concat(F.lit(HEAD), F.array_join(pieces, ""), F.lit("0\r\n\r\n")))
    rows = rows.select("*", own.alias("__own"), F.when(F.col("__again"), target).alias("__target"), block.alias("__block"))
    rows = rows.select("*", F.octet_length("__block").alias("__total"), F.posexplode(_cut(F.col("__block"), segment)).alias("__k", "__part"), (F.char_length("__block") > segment).alias("__many"), F.ceil(F.char_length("__block") / F.lit(segment)).alias("__parts"))
    line = lambda name, value: F.concat(F.lit(f"{name}: "), value.cast("string"))
    head = F.col("__k") == 0
    lines = [
        F.lit("WARC/1.1"),
        line("WARC-Type", F.when(~head, "continuation").when(F.col("__again"), "revisit").otherwise("response")),
        line("WARC-Record-ID", F.when(head, F.col("__own")).otherwise(F.concat(F.substring("__own", 1, 41), F.lit("."), F.col("__k").cast("string"), F.lit(">")))),
        line("WARC-Date", F.lit(DATE)),
        F.when(head, line("WARC-Target-URI", F.col("__url"))),
        F.when(head, line("WARC-Payload-Digest", F.concat(F.lit("sha1:"), "__sha1"))),
        F.when(head & F.col("__id").isNotNull(), line("X-Page-Id", F.col("__id"))),
        F.when(F.col("__again"), F.lit("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")),
        F.when(F.col("__again"), line("WARC-Refers-To", F.col("__target"))),
        F.when(F.col("__many"), line("WARC-Segment-Number", F.col("__k") + 1)),
        F.when(~head, line("WARC-Segment-Origin-ID", F.col("__own"))),
        F.when(F.col("__many") & (F.col("__k") + 1 == F.col("__parts")), line("WARC-Segment-Total-Length", F.col("__total"))),
        F.lit("Content-Type: application/http; msgtype=response"),
        line("Content-Length", F.octet_length("__part")),
    ]
    return rows.select(F.concat(F.concat_ws("\r\n", *lines), F.lit("\r\n\r\n"), "__part").alias("value"))


def write_warc(pages: DataFrame, path: str, **how) -> None:
    """Archives below ``path``, gzip-compressed, ``FILE_RECORDS`` records each at most, and so
    few that a file of records of mean size has ``FILE_BYTES``.  Nulls are as in ``composed``."""
    text = how.get("text_col", "html")
    size = pages.agg(F.avg(F.coalesce(F.octet_length(F.col(text)), F.lit(0)))).first()[0] or 0
    records = max(1, min(FILE_RECORDS, int(FILE_BYTES / (size + 1000))))
    composed(pages, **how).write.mode("overwrite").option("lineSep", "\r\n\r\n").option("compression", "gzip").option("maxRecordsPerFile", records).text(path)


def _plain(content, step: int = 1 << 20):
    """The bytes of a file, gzip members unpacked, piece by piece."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[i : i + step]) for i in range(0, len(view), step))
        return
    unpack = zlib.decompressobj(31)
    for i in range(0, len(view), step):
        data = bytes(view[i : i + step])
        while data:
            yield unpack.decompress(data)
            data = unpack.unused_data
            if unpack.eof:
                unpack = zlib.decompressobj(31)
    if tail := unpack.flush():
        yield tail


def parsed(content) -> list[tuple[dict[str, str], bytes]]:
    """Headers (lower-cased names) and block of each record in a file, one at a time."""
    held = bytearray()
    pieces = _plain(content)

    def more() -> bool:
        for piece in pieces:
            if piece:
                held.extend(piece)
                return True
        return False

    while True:
        while held[:2] == b"\r\n":
            del held[:2]
        while (end := held.find(b"\r\n\r\n")) < 0:
            if not more():
                if held.strip():
                    raise ValueError("a WARC record breaks off in its header")
                return
            while held[:2] == b"\r\n":
                del held[:2]
        lines = bytes(held[:end]).decode("utf-8").split("\r\n")
        if not lines[0].startswith("WARC/"):
            raise ValueError(f"not a WARC record: {lines[0][:40]!r}")
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines[1:])}
        size = int(headers["content-length"])
        while len(held) < end + 4 + size:
            if not more():
                raise ValueError("a WARC record breaks off in its block")
        yield headers, bytes(held[end + 4 : end + 4 + size])
        del held[: end + 4 + size]


def http_payload(block: bytes) -> bytes:
    """The body of an HTTP message, chunked framing undone."""
    head, found, body = block.partition(b"\r\n\r\n")
    if not found:
        raise ValueError("an HTTP message without an end of its headers")
    fields = {k.strip().lower(): v.strip().lower() for k, _, v in (x.partition(b":") for x in head.split(b"\r\n")[1:])}
    if fields.get(b"transfer-encoding") != b"chunked":
        return body
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        size = int(body[at:end].split(b";")[0], 16)
        if not size:
            return b"".join(out)
        out.append(body[end + 2 : end + 2 + size])
        if len(out[-1]) < size or body[end + 2 + size : end + 4 + size] != b"\r\n":
            raise ValueError("a chunk breaks off")
        at = end + 4 + size


FIELDS = "record_id string, type string, page_id long, target_uri string, digest string, refers_to string, payload binary"
_RAW = FIELDS + ", origin string, segment int, total long"


def _records(spark: SparkSession, path: str) -> DataFrame:
    """Records and segments as they lie in the archives; segments have no payload of their own,
    but the bytes of the block that they carry."""

    def row(headers: dict[str, str], block: bytes) -> tuple:
        kind, number = headers["warc-type"], headers.get("warc-segment-number")
        payload = block if number else None if kind == "revisit" else http_payload(block)
        page = headers.get("x-page-id")
        return (
            headers["warc-record-id"], kind, int(page) if page else None, headers.get("warc-target-uri"), headers.get("warc-payload-digest"), headers.get("warc-refers-to"), payload,
            headers.get("warc-segment-origin-id", headers["warc-record-id"]), int(number) if number else None, int(headers["warc-segment-total-length"]) if "warc-segment-total-length" in headers else None,
        )

    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary(), pa.string(), pa.int32(), pa.int64()]
    names = [x.split()[0] for x in _RAW.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def parse(batches):
        for batch in batches:
            for cell in batch.column(0):
                rows, size = [], 0
                for headers, block in parsed(cell.as_buffer()):
                    rows.append(row(headers, block))
                    size += len(block)
                    if size > 1 << 22:
                        yield table(rows)
                        rows, size = [], 0
                if rows:
                    yield table(rows)

    return spark.read.format("binaryFile").load(path).select("content").mapInArrow(tidy(parse), _RAW)


def _reassembled(segments: DataFrame) -> DataFrame:
    """Records of segments ``(FIELDS, origin, segment, total)``, grouped by origin and in order."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.binary()]
    names = [x.split()[0] for x in FIELDS.split(", ")]

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    def whole(parts: list[dict]) -> list[tuple]:
        """Records of one origin; a record that was written n times has n of each segment."""
        by: dict[int, list[dict]] = {}
        for p in parts:
            by.setdefault(p["segment"], []).append(p)
        if sorted(by) != list(range(1, len(by) + 1)) or len({len(x) for x in by.values()}) != 1:
            raise ValueError(f"segments of {parts[0]['origin']} are missing")
        block = b"".join(by[k][0]["payload"] for k in range(1, len(by) + 1))
        if by[len(by)][0]["total"] != len(block):
            raise ValueError(f"{parts[0]['origin']}: {len(block)} bytes, not {by[len(by)][0]['total']}")
        first = by[1][0]
        return [(*(first[n] for n in names[:6]), http_payload(block))] * len(by[1])

    def reassemble(batches):
        held: list[dict] = []
        for batch in batches:
            for part in batch.to_pylist():
                if held and held[-1]["origin"] != part["origin"]:
                    yield table(whole(held))
                    held = []
                held.append(part)
        if held:
            yield table(whole(held))

    dealt = segments.repartition(partitions(segments.sparkSession), "origin").sortWithinPartitions("origin", "segment")
    return dealt.mapInArrow(tidy(reassemble), FIELDS)


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per record: ``record_id, type, page_id, target_uri, digest, refers_to, payload``.

    A revisit has a null payload.  A missing segment, a wrong total length or broken
    framing raises ValueError; records that were written twice are read twice.  Archives are
    unpacked and parsed once: what they hold is saved as a table.
    """
    raw = saved(_records(spark, path), "parsed")
    return raw.where("segment is null").select(*[x.split()[0] for x in FIELDS.split(", ")]).unionByName(_reassembled(raw.where("segment is not null")))


def archived(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", text_col: str = "html", path: str | None = None, **how) -> DataFrame:
    """Write ``pages`` as WARC, read the archives back and resolve revisits.

    ``(page_id, payload_bytes, payload_digest, record_type, refers_to)``, one row per page:
    a null text is an empty payload, rows that tie in page id and payload are all
    responses, a null id never is what others refer to; other columns are left out; no rows
    give none.
    """
    spark = pages.sparkSession
    path = path or scratch_path(spark, "warc")
    write_warc(pages, path, id_col=id_col, url_col=url_col, text_col=text_col, **how)
    # Archives are parsed once: of whole records the sums are kept, of segments the bytes.
    whole, slim = F.col("segment").isNull(), ["record_id", "type", "page_id", "refers_to"]
    sums = {"payload_bytes": F.octet_length("payload").cast("long"), "payload_digest": F.sha1("payload")}
    raw = saved(_records(spark, path).withColumns({c: F.when(whole, v) for c, v in sums.items()}).withColumn("payload", F.when(~whole, F.col("payload"))), "records")
    joined = _reassembled(raw.where("segment is not null").drop(*sums)).select(*slim, *[v.alias(c) for c, v in sums.items()])
    records = raw.where("segment is null").select(*slim, *sums).unionByName(saved(joined, "reassembled"))
    responses = records.where("type = 'response'")
    known = responses.dropDuplicates(["record_id"]).select(F.col("record_id").alias("refers_to"), F.col("page_id").alias("__page"), F.col("payload_bytes").alias("__bytes"), F.col("payload_digest").alias("__digest"))
    again = records.where("type = 'revisit'").join(known, "refers_to", "left")
    again = again.select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), F.col("type").alias("record_type"), F.col("__page").alias("refers_to"))
    return responses.select("page_id", "payload_bytes", "payload_digest", F.col("type").alias("record_type"), F.lit(None).cast("long").alias("refers_to")).unionByName(again)
