"""WARC archives: responses, revisits of equal payloads, and segmented records.

Writing: each page is an HTTP message with chunked transfer framing in a WARC/1.1 record; pages whose
payload equals an earlier one's are revisit records. Records longer than ``segment_bytes`` are cut into a
first record and continuation records. Spark's text writer puts records, with their separator between
them, into gzip archives, so that files commit with their task and any Hadoop store will do.

Reading: archives, these or others', are inflated and parsed as a stream, member by member, by content
length; continuation records are grouped by origin identifier, ordered by segment number and verified
against the total length; then the transfer framing is decoded. Payload digests are checked, and so is what
revisits announce against the records they name.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from panelloom.llm.common import stored, table
from panelloom.sources.scratch import new_path

EOL = b"\r\n"
END = b"\r\n\r\n"
RECORDS_A_FILE = 2000
#: Bytes that are inflated at once.
STEP = 1 << 20
#: Record types with a payload of their own; others (requests, metadata, information on the archive) are passed over.
KINDS = ("response", "resource", "revisit", "continuation")


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def whole_chars(data: bytes, at: int) -> int:
    """The last place up to ``at`` that does not cut a UTF-8 character (text writers need whole ones)."""
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at -= 1
    return at


def chunked(data: bytes, size: int) -> bytes:
    """HTTP/1.1 chunked transfer framing, without cutting UTF-8 characters."""
    out, at = [], 0
    while at < len(data):
        to = whole_chars(data, min(len(data), at + size))
        part = data[at : to if to > at else at + size]
        out += [b"%x" % len(part), EOL, part, EOL]
        at += len(part)
    return b"".join([*out, b"0", END])


def dechunked(data: bytes) -> bytes:
    """Inverse of chunked; extensions and trailers are allowed, ValueError if the framing is broken."""
    out, at = [], 0
    while True:
        end = data.find(EOL, at)
        head = data[at:end].split(b";")[0].strip() if end >= 0 else b""
        if not re.fullmatch(rb"[0-9A-Fa-f]+", head):
            raise ValueError("broken chunk header")
        size, at = int(head, 16), end + 2
        if not size:
            return b"".join(out)
        if data[at + size : at + size + 2] != EOL:
            raise ValueError("broken chunk")
        out.append(data[at : at + size])
        at += size + 2


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """A record without the separator after it."""
    lines = [f"{k}: {v}" for k, v in [*headers, ("Content-Length", str(len(block)))]]
    return EOL.join([b"WARC/1.1", *(x.encode() for x in lines), b"", block])


def record_name(page_id, digest: str, copy: int, segment: int = 1) -> str:
    """Identifier of a page's record, the same in every run: rows that repeat a page and payload differ by ``copy``."""
    return f"<urn:page:{'null' if page_id is None else page_id}:{digest}:{copy}:{segment}>"


def page_records(page_id, url: str | None, payload: bytes, refers_to, copy: str, segment_bytes: int, chunk_bytes: int) -> list[bytes]:
    """The records of one page: a response and its continuations, or a revisit of page ``refers_to``."""
    digest = sha1_base32(payload)
    common = [("WARC-Date", "1970-01-01T00:00:00Z"), ("WARC-Payload-Digest", f"sha1:{digest}"), ("Content-Type", "application/http; msgtype=response")]
    if url is not None:
        common.append(("WARC-Target-URI", re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url)))
    ident = lambda k: record_name(page_id, digest, copy, k)
    http = [b"HTTP/1.1 200 OK", b"Content-Type: text/html; charset=utf-8"]
    if refers_to is not None:
        block = EOL.join([*http, b"Content-Length: %d" % len(payload), b"", b""])
        return [record([("WARC-Type", "revisit"), ("WARC-Record-ID", ident(1)), ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"), ("WARC-Refers-To", record_name(refers_to, digest, 1)), *common], block)]
    block = EOL.join([*http, b"Transfer-Encoding: chunked", b"", b""]) + chunked(payload, chunk_bytes)
    if len(block) <= segment_bytes:
        return [record([("WARC-Type", "response"), ("WARC-Record-ID", ident(1)), *common], block)]
    out, at, k = [], 0, 1
    while at < len(block):
        to = whole_chars(block, min(len(block), at + segment_bytes))
        headers = [("WARC-Type", "response" if k == 1 else "continuation"), ("WARC-Record-ID", ident(k)), ("WARC-Segment-Number", str(k)), *common]
        if k > 1:
            headers.append(("WARC-Segment-Origin-ID", ident(1)))
        if to == len(block):
            headers.append(("WARC-Segment-Total-Length", str(len(block))))
        out.append(record(headers, block[at:to]))
        at, k = to, k + 1
    return out


def inflated(content: bytes) -> Iterator[bytes]:
    """Parts of an archive, gzip members one after the other or plain; ValueError if it is cut off."""
    view = memoryview(content)
    if bytes(view[:2]) != b"\x1f\x8b":
        yield from (bytes(view[k : k + STEP]) for k in range(0, len(view), STEP))
        return
    at, member = 0, zlib.decompressobj(31)
    while at < len(view) or member.unconsumed_tail:
        part = member.unconsumed_tail
        if not part:
            part, at = view[at : at + STEP], min(len(view), at + STEP)
        try:
            out = member.decompress(part, STEP)
        except zlib.error as broken:
            raise ValueError(f"broken gzip member before byte {at}") from broken
        if out:
            yield out
        if member.eof:
            at -= len(member.unused_data)
            while at < len(view) and view[at] == 0:
                at += 1
            if at == len(view):
                return
            member = zlib.decompressobj(31)
    raise ValueError("archive ends inside a gzip member")


def parse_records(parts: bytes | Iterable[bytes]) -> Iterator[tuple[dict[str, str], bytes]]:
    """(headers by lower-case name, block) of each record of an uncompressed archive, by content length."""
    parts = iter([parts] if isinstance(parts, bytes) else parts)
    held, at, before = bytearray(), 0, 0

    def more() -> bool:
        nonlocal at, before
        part = next(parts, None)
        if part is not None:
            before += at
            del held[:at]
            held.extend(part)
            at = 0
        return part is not None

    while True:
        while held.startswith(EOL, at):
            at += 2
        if len(held) - at < 8:
            if more():
                continue
            if at < len(held):
                raise ValueError("archive ends inside a record")
            return
        if not held.startswith(b"WARC/", at):
            raise ValueError(f"no WARC record at byte {before + at}")
        seen = 0
        while (end := held.find(END, at + max(0, seen - 3))) < 0:
            seen = len(held) - at
            if not more():
                raise ValueError("archive ends inside a record's headers")
        lines = held[at:end].decode("utf-8", "replace").split("\r\n")[1:]
        headers = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
        if not headers.get("content-length", "").isdigit():
            raise ValueError(f"a record at byte {before + at} has no length")
        head, size = end + 4 - at, int(headers["content-length"])
        while len(held) - at < head + size:
            if not more():
                raise ValueError("archive ends inside a record")
        yield headers, bytes(held[at + head : at + head + size])
        at += head + size


def open_message(block: bytes) -> tuple[int, bytes]:
    """(declared length or -1, payload) of an HTTP message; chunked framing is decoded. Other blocks are payloads."""
    if not block.startswith(b"HTTP/"):
        return -1, block
    head, _, body = block.partition(END)
    fields = {k.strip().lower(): v.strip() for k, _, v in (x.partition(b":") for x in head.split(EOL)[1:])}
    if fields.get(b"transfer-encoding", b"").lower() == b"chunked" and body:
        body = dechunked(body)
    length = fields.get(b"content-length", b"-1")
    return int(length) if length.isdigit() else -1, body


def _writer(segment_bytes: int, chunk_bytes: int):
    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            out: list[str] = []
            for page_id, url, html, refers, copy in zip(f["page_id"], f["url"], f["html"], f["refers_to"], f["copy"], strict=True):
                null = lambda v: None if v is None or v != v else v
                page_id, refers = (None if null(v) is None else int(v) for v in (page_id, refers))
                out += [r.decode() for r in page_records(page_id, null(url), (null(html) or "").encode(), refers, copy, segment_bytes, chunk_bytes)]
                if len(out) >= 500:
                    yield pd.DataFrame({"value": out})
                    out = []
            if out:
                yield pd.DataFrame({"value": out})

    return run


def write_archives(spark: SparkSession, pages: DataFrame, path: str, min_revisit_bytes: int = 0, segment_bytes: int = 1 << 14, chunk_bytes: int = 1 << 12) -> None:
    """Write ``pages`` (page_id, url, html) as gzip WARC files below ``path``.

    Of equal payloads of at least ``min_revisit_bytes`` bytes the one with the least page_id is the
    response (every row of that page_id, if rows repeat one); null html is an empty payload; rows
    without page_id are responses; an empty table gives archives without records. Spark's text writer
    makes one gzip member a file, of at most RECORDS_A_FILE records.
    """
    html = F.coalesce(F.col("html").cast("string"), F.lit(""))
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"))
    sums = rows.where("page_id is not null").select("page_id", F.sha2(F.col("html").cast("binary"), 256).alias("same"), F.octet_length("html").alias("size")).where(F.col("size") >= min_revisit_bytes)
    first = sums.groupBy("same").agg(F.min("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    revisits = sums.join(first, "same").where("page_id <> refers_to").groupBy("page_id", "same").agg(F.min("refers_to").alias("refers_to"))
    # rows without page_id are spread by their url; one shuffle serves the join and the numbering of repeats
    rows = rows.withColumn("same", F.sha2(F.col("html").cast("binary"), 256)).withColumn("at", F.coalesce("page_id", F.xxhash64("url"))).alias("r")
    revisits = revisits.withColumn("at", F.col("page_id")).hint("shuffle_merge").alias("v")
    out = rows.join(revisits, (F.col("r.at") == F.col("v.at")) & (F.col("r.same") == F.col("v.same")) & (F.col("r.page_id") == F.col("v.page_id")), "left").select("r.*", "v.refers_to")
    repeat = F.row_number().over(Window.partitionBy("at", "same", "page_id").orderBy("url"))
    copy = F.when(F.col("page_id").isNotNull(), repeat.cast("string")).otherwise(F.concat_ws(".", F.lower(F.hex(F.xxhash64("url"))), repeat.cast("string")))
    out = out.withColumn("copy", copy).select("page_id", "url", "html", "refers_to", "copy").mapInPandas(_writer(segment_bytes, chunk_bytes), "value string")
    out.write.option("lineSep", END.decode()).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


PARSED = "record_id string, origin string, segment int, total long, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to_record string, block binary"
ANSWER = "record_id string, target_uri string, payload_bytes long, payload_digest string, record_type string, refers_to_record string"


def _answer(name: str, uri, announced: str | None, kind: str, refers, block: bytes) -> tuple:
    """ANSWER of one whole record; a SHA-1 that isn't its payload's is refused."""
    declared, payload = open_message(block)
    method, _, value = (announced or "").partition(":")
    if kind == "revisit":
        return name, uri, None if declared < 0 else declared, value.upper() if method.lower() == "sha1" else None, kind, refers
    digest = sha1_base32(payload)
    if method.lower() == "sha1" and value.upper() != digest:
        raise ValueError(f"payload digest of {name} is {digest}, its record says {announced}")
    return name, uri, len(payload), digest, kind, None


def _frame(rows: list[tuple], schema: str) -> pd.DataFrame:
    names = [x.split() for x in schema.split(", ")]
    return pd.DataFrame(rows, columns=[n for n, _ in names]).astype({n: {"int": "Int32", "long": "Int64"}[k] for n, k in names if k in ("int", "long")})


def _parser(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        for content in f["content"]:
            out, held = [], 0
            for h, block in parse_records(inflated(content)):
                kind, name, digest = h.get("warc-type", ""), h.get("warc-record-id", ""), h.get("warc-payload-digest")
                if kind not in KINDS:
                    continue
                if "warc-segment-number" in h:
                    out.append((name, h.get("warc-segment-origin-id", name), int(h["warc-segment-number"]), int(h.get("warc-segment-total-length", -1)), h.get("warc-target-uri"), None, digest, kind, None, block))
                    held += len(block)
                else:
                    a = _answer(name, h.get("warc-target-uri"), digest, kind, h.get("warc-refers-to"), block)
                    out.append((a[0], None, None, None, *a[1:], None))
                if len(out) >= RECORDS_A_FILE or held >= 8 * STEP:
                    yield _frame(out, PARSED)
                    out, held = [], 0
            yield _frame(out, PARSED)


def reassembled(segments: list) -> bytes:
    """The block of a segmented record; ValueError unless numbers and total length fit."""
    parts = sorted(segments, key=lambda s: s["segment"])
    if [s["segment"] for s in parts] != list(range(1, len(parts) + 1)):
        raise ValueError("segments are missing")
    block = b"".join(bytes(s["block"]) for s in parts)
    if parts[-1]["total"] != len(block):
        raise ValueError(f"{len(block)} bytes in segments, {parts[-1]['total']} announced")
    return block


def _joiner(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for f in frames:
        yield _frame([_answer(o, u, d, k or "response", None, reassembled(s)) for o, u, d, k, s in zip(f["origin"], f["target_uri"], f["payload_digest"], f["record_type"], f["segments"], strict=True)], ANSWER)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """ANSWER of each record with a payload in the archives below ``path``, with page_id and refers_to of this writer's names.

    Archives are gzip (of one member or many) or plain and at most 2 GB each, the bound of a binary value;
    they may be anybody's: page_id is null for records that this module didn't write, digests other than
    SHA-1 aren't checked, payload_digest is the payload's SHA-1 always (a revisit's is what it announces).
    ValueError for broken archives, missing segments, wrong digests, and revisits that announce another
    digest or length than the record they name has. Empty folders of archives give no rows.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    parsed = stored(spark, files.mapInPandas(_parser, PARSED), "warc-parsed")
    whole = parsed.where("segment is null").select("record_id", "target_uri", "payload_bytes", "payload_digest", "record_type", "refers_to_record")
    begins = lambda c: F.max(F.when(F.col("segment") == 1, F.col(c))).alias(c)
    groups = parsed.where("segment is not null").groupBy("origin").agg(begins("target_uri"), begins("payload_digest"), begins("record_type"), F.collect_list(F.struct("segment", "total", "block")).alias("segments"))
    found = stored(spark, whole.unionByName(groups.mapInPandas(_joiner, ANSWER)), "warc-records")
    # what revisits announce is summed up by the record they name before it meets that record
    claims = found.where("record_type = 'revisit'").groupBy(F.col("refers_to_record").alias("record_id")).agg(*(g(c).alias(f"{n}_{c}") for c in ("payload_bytes", "payload_digest") for n, g in (("least", F.min), ("most", F.max))))
    wrong = " or ".join(f"{n}_{c} <> {c}" for c in ("payload_bytes", "payload_digest") for n in ("least", "most"))
    bad = found.where("record_type <> 'revisit'").join(claims, "record_id").where(wrong).select("record_id").limit(3).collect()
    if bad:
        raise ValueError(f"revisits announce other payloads than {', '.join(r[0] for r in bad)} have")
    number = lambda c: F.expr(f"try_cast(regexp_extract({c}, '^<urn:page:(-?[0-9]+):', 1) as bigint)")
    return found.withColumn("page_id", number("record_id")).withColumn("refers_to", number("refers_to_record"))


def op5_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages into archives and back."""
    path = new_path(spark, "warc")
    write_archives(spark, table(spark, sf_dir, "pages"), path)
    return read_archives(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


ORACLE = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
f AS (SELECT html, min(page_id) AS first FROM p GROUP BY html),
h AS (SELECT p.page_id, p.html, first, sha1(p.html) AS hex FROM p JOIN f USING (html))
SELECT page_id, octet_length(encode(html))::BIGINT AS payload_bytes,
  array_to_string(list_transform(range(32), lambda k: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + ((('0x' || substr(hex, ((k // 4) * 5 + 1)::INT, 5))::INT >> (15 - 5 * (k % 4))::INT) & 31), 1)), '') AS payload_digest,
  CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to
FROM h
"""
