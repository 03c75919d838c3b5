"""WARC archives: writing with segments, chunks and revisits; reading back with segment reassembly.

Writing: the payload of a page goes as a chunked HTTP response into a WARC record; a block longer than
``SEGMENT`` bytes goes on in continuation records with the origin's id and their segment numbers, the last
with the total length. Of records with equal payloads of at least ``LEAST_REVISIT`` bytes the one with the
smallest page_id is the response and the others are revisits that refer to it. Spark's text sink writes
the records, the closing blank lines of a record being its line separator, so any store that Spark
writes to will do; files hold at most ``RECORDS_A_FILE`` records.

Reading: files are parsed record by record as streams; continuation records are grouped with their origin
by its id, ordered by segment number, checked for gaps and against the total length, and the chunked
framing is decoded. A record that fails a check comes back with a null payload and the reason in
``problem``; where a file breaks off or a record's length is unknown, that record is the last of its file.
Revisits take the payload's size and digest from the response they refer to.

Defined results: a null html is an empty payload; a null url is ``about:blank``; repeated page ids give one
record each; of repeated rows of the smallest page_id all are responses; a null page_id is always a
response; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import gzip
import io
import re
import zlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from runledger.llm.common import columns, new_path, stored

SEGMENT = 16_384
CHUNK = 4_096
LEAST_REVISIT = 100
RECORDS_A_FILE = 2_000
#: Fixed value: what ends a WARC record.
RECORD_END = "\r\n\r\n"
_HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nTransfer-Encoding: chunked\r\n\r\n"
_HEX = re.compile(rb"[0-9A-Fa-f]+")
_BATCH_BYTES = 4_000_000
_RAW = "record_id string, origin_id string, segment int, total long, kind string, page_id long, refers_to string, digest string, problem string, block binary"


def chunked(payload: bytes, size: int = CHUNK) -> bytes:
    parts = (payload[at : at + size] for at in range(0, len(payload), size))
    return b"".join(b"%x\r\n%s\r\n" % (len(p), p) for p in parts) + b"0\r\n\r\n"


def dechunked(body: bytes) -> bytes:
    """The payload of a chunked body; ValueError where the framing is broken."""
    out, at = [], 0
    while True:
        end = body.index(b"\r\n", at)
        said = body[at:end].split(b";")[0].strip(b" \t")
        if not _HEX.fullmatch(said):
            raise ValueError("a chunk without its size")
        size = int(said, 16)
        at = end + 2
        if size == 0:
            return b"".join(out)
        if body[at + size : at + size + 2] != b"\r\n":
            raise ValueError("a chunk doesn't end where its size says")
        out.append(body[at : at + size])
        at += size + 2


def _header(fields: dict[str, object], block: bytes) -> bytes:
    lines = ["WARC/1.1", *(f"{k}: {v}" for k, v in fields.items()), f"Content-Length: {len(block)}"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block


def records_of(record_id: str, page_id: int | None, url: str, digest: str, payload: bytes, refers_to: str | None, segment: int = SEGMENT) -> list[bytes]:
    """The records of a page, without the blank lines that end each."""
    common = {"WARC-Target-URI": url, "WARC-Date": "1970-01-01T00:00:00Z"}
    own = {"WARC-Payload-Digest": f"sha256:{digest}", "Content-Type": "application/http; msgtype=response"}
    own |= {} if page_id is None else {"X-Page-ID": page_id}
    if refers_to is not None:
        kind = {"WARC-Type": "revisit", "WARC-Record-ID": f"<{record_id}>", "WARC-Refers-To": f"<{refers_to}>", "WARC-Profile": "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"}
        return [_header(kind | common | own, _HTTP)]
    block = _HTTP + chunked(payload)
    parts = [block[at : at + segment] for at in range(0, len(block), segment)]
    first = {"WARC-Type": "response", "WARC-Record-ID": f"<{record_id}>"} | common | own
    if len(parts) == 1:
        return [_header(first, block)]
    out = [_header(first | {"WARC-Segment-Number": 1}, parts[0])]
    for n, part in enumerate(parts[1:], 2):
        more = {"WARC-Type": "continuation", "WARC-Record-ID": f"<{record_id}-{n}>", "WARC-Segment-Origin-ID": f"<{record_id}>", "WARC-Segment-Number": n} | common
        out.append(_header(more | ({"WARC-Segment-Total-Length": len(block)} if n == len(parts) else {}), part))
    return out


def _write(batches: Iterator[pa.RecordBatch], segment: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        out, held = [], 0
        for row in zip(*(batch.column(c).to_pylist() for c in ("record_id", "page_id", "url", "digest", "payload", "refers_to")), strict=True):
            found = records_of(*row, segment=segment)
            out += found
            held += sum(map(len, found))
            if held >= _BATCH_BYTES:
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])
                out, held = [], 0
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])


def _record_id(*parts):
    """urn:uuid made of what tells a page's row from others."""
    h = F.sha2(F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("-")) for p in parts)), 256)
    return F.concat(F.lit("urn:uuid:"), *(x for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12)) for x in ((F.lit("-"), F.substring(h, at, n)) if at > 1 else (F.substring(h, at, n),))))


def write_archives(pages: DataFrame, path: str, segment: int = SEGMENT) -> None:
    """Write pages (page_id, url, html) as gzipped WARC files into the folder path.

    What refers to what is decided on digests alone; the payloads are shuffled once.
    """
    own = columns(pages, page_id="page_id", url="url", html="html").select(
        F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("page"), F.regexp_replace(F.coalesce("url", F.lit("about:blank")), r"[\r\n]", " ").alias("url"), F.coalesce("html", F.lit("")).cast("binary").alias("payload")
    )
    keys = ["page", "url", "digest"]
    own = own.withColumn("digest", F.sha2("payload", 256))
    light = own.where(F.octet_length("payload") >= LEAST_REVISIT).where("page <> ''").select(*keys).distinct()
    first = light.groupBy("digest").agg(F.min(F.struct(F.col("page").cast("long").alias("id"), "url")).alias("first"), F.count_distinct("page").alias("n")).where("n > 1")
    again = light.join(first, "digest").where(F.col("page") != F.col("first.id").cast("string"))
    again = again.select(*keys, _record_id(F.col("first.id"), F.col("first.url"), F.col("digest"), F.lit(1)).alias("refers_to"))
    rows = own.join(again, keys, "left").withColumn("copy", F.row_number().over(W.partitionBy(*keys).orderBy("refers_to")))
    rows = rows.withColumn("record_id", _record_id(F.nullif("page", F.lit("")), F.col("url"), F.col("digest"), F.col("copy"))).withColumn("page_id", F.nullif("page", F.lit("")).cast("long"))
    records = rows.select("record_id", "page_id", "url", "digest", "payload", "refers_to").mapInArrow(partial(_write, segment=segment), "record binary")
    records.select(F.col("record").cast("string").alias("value")).write.option("lineSep", RECORD_END).option("compression", "gzip").option("maxRecordsPerFile", RECORDS_A_FILE).text(path)


class BrokenRecord(ValueError):
    """A record that can't be read, with the fields of its header; nothing behind it can be found."""

    def __init__(self, reason: str, fields: dict[str, str]) -> None:
        super().__init__(reason)
        self.fields = fields


def parsed(stream) -> Iterator[tuple[dict[str, str], bytes]]:
    """(fields by lower-case name, block) of each record of an open archive."""
    while True:
        line = stream.readline()
        if not line:
            return
        if line == b"\r\n":
            continue
        if not line.startswith(b"WARC/"):
            raise BrokenRecord(f"no record starts with {line[:40]!r}", {})
        fields: dict[str, str] = {}
        while (line := stream.readline()) not in (b"\r\n", b""):
            name, _, value = line.decode("utf-8", "replace").partition(":")
            fields[name.strip().lower()] = value.strip()
        size = fields.get("content-length", "")
        if not size.isdigit():
            raise BrokenRecord("a record without its length", fields)
        try:
            block = stream.read(int(size))
        except (OSError, EOFError, zlib.error) as e:
            raise BrokenRecord("the archive ends within a record", fields) from e
        if len(block) != int(size):
            raise BrokenRecord("the archive ends within a record", fields)
        yield fields, block


def _readable(stream) -> Iterator[tuple[dict[str, str], bytes | None, str | None]]:
    """(fields, block, problem) of each record; a broken one, without block, is the last."""
    try:
        for fields, block in parsed(stream):
            yield fields, block, None
    except BrokenRecord as e:
        yield e.fields, None, str(e)
    except (OSError, EOFError, zlib.error) as e:  # the compression breaks off between records
        yield {}, None, f"the archive can't be read on: {type(e).__name__}"


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names, kinds = zip(*(c.split() for c in _RAW.split(", ")), strict=True)
    kinds = [{"string": pa.string(), "int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}[k] for k in kinds]
    bare = lambda x: x.strip("<>") if x else None
    for batch in batches:
        for content in batch.column("content"):
            raw = content.as_buffer()
            stream = io.BufferedReader(gzip.GzipFile(fileobj=pa.BufferReader(raw))) if raw[:2].to_pybytes() == b"\x1f\x8b" else pa.BufferReader(raw)
            stream = stream if hasattr(stream, "peek") else io.BufferedReader(io.BytesIO(raw.to_pybytes()))
            rows, held = [], 0
            for f, block, problem in _readable(stream):
                numbers = {}
                for field, most in (("warc-segment-number", 1 << 31), ("warc-segment-total-length", 1 << 63), ("x-page-id", 1 << 63)):
                    try:
                        numbers[field] = int(f[field]) if f.get(field) else None
                        if numbers[field] is not None and not -most <= numbers[field] < most:
                            raise ValueError
                    except ValueError:
                        numbers[field], problem = None, problem or f"{field} is no number"
                own = bare(f.get("warc-record-id"))
                digest = f.get("warc-payload-digest", "").removeprefix("sha256:") or None
                rows.append((own, bare(f.get("warc-segment-origin-id")) or own, *list(numbers.values())[:2], f.get("warc-type"), numbers["x-page-id"], bare(f.get("warc-refers-to")), digest, problem, block))
                held += len(block or b"")
                if held >= _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], list(names))


def reassembled(segments: list[tuple[int | None, int | None, bytes]]) -> bytes:
    """The block of a record from its (segment number, total length or None, bytes); ValueError where a check fails."""
    order = sorted(segments, key=lambda s: s[0] or 1)
    if [s[0] or 1 for s in order] != list(range(1, len(order) + 1)):
        raise ValueError("segments are missing or repeated")
    block, total = b"".join(s[2] for s in order), order[-1][1]
    if len(order) > 1 and total is None:
        raise ValueError("the last segment is missing")
    if total is not None and total != len(block):
        raise ValueError("the total length differs")
    return block


def _payloads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["record_id", "kind", "page_id", "refers_to", "digest"]
    for batch in batches:
        meta = [batch.column(c) for c in names]
        at = 0
        payloads: list[bytes | None] = []
        problems: list[str | None] = []
        held = 0

        def made(to: int) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([*(m.slice(at, to - at) for m in meta), pa.array(payloads, pa.binary()), pa.array(problems, pa.string())], [*names, "payload", "problem"])

        for i, segments in enumerate(batch.column("segments")):
            payload, problem = None, None
            try:
                if found := batch.column("problem")[i].as_py():
                    raise ValueError(found)
                block = reassembled([(s["segment"].as_py(), s["total"].as_py(), s["block"].as_py()) for s in segments])
                head, gap, body = block.partition(b"\r\n\r\n")
                if not gap:
                    raise ValueError("no end of the HTTP header")
                if batch.column("kind")[i].as_py() == "response":
                    payload = dechunked(body) if b"transfer-encoding: chunked" in head.lower() else body
            except ValueError as e:
                problem = str(e)
            payloads.append(payload)
            problems.append(problem)
            held += len(payload or b"")
            if held >= _BATCH_BYTES:
                yield made(i + 1)
                at, payloads, problems, held = i + 1, [], [], 0
        if payloads:
            yield made(batch.num_rows)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """(record_id, kind, page_id, refers_to, digest, payload, problem) of each record in the folder, segments joined.

    Only records in several segments are shuffled; for that the files are parsed twice.
    """
    raw = spark.read.format("binaryFile").load(path).select("content").mapInArrow(_read, _RAW)
    names = ("kind", "page_id", "refers_to", "digest")
    part = F.struct("segment", "total", "block")
    whole = raw.where("segment IS NULL").select("record_id", *names, F.array(part).alias("segments"), "problem")
    meta = [F.max(F.when(F.col("kind") != "continuation", F.col(c))).alias(c) for c in names]
    joined = raw.where("segment IS NOT NULL").groupBy(F.col("origin_id").alias("record_id")).agg(*meta, F.collect_list(part).alias("segments"), F.max("problem").alias("problem"))
    return whole.unionByName(joined).mapInArrow(_payloads, "record_id string, kind string, page_id long, refers_to string, digest string, payload binary, problem string")


def round_trip(pages: DataFrame) -> DataFrame:
    """Write pages to archives in the shared folder, read them back: (page_id, payload_bytes, payload_digest, record_type, refers_to, problem)."""
    spark = pages.sparkSession
    path = new_path(spark, "warc")
    write_archives(pages, path)
    back = read_archives(spark, path)
    light = stored(back.select("record_id", "kind", "page_id", F.col("refers_to").alias("to"), F.col("digest").alias("said"), F.octet_length("payload").cast("long").alias("bytes"), F.sha2("payload", 256).alias("own"), "problem"), "warc-records")
    target = light.where("kind = 'response'").select(F.col("record_id").alias("to"), F.col("page_id").alias("to_page"), F.col("bytes").alias("to_bytes"), F.col("own").alias("to_own"))
    full = light.join(target, "to", "left")
    own = F.when(F.col("kind") == "revisit", F.col("to_own")).otherwise(F.col("own"))
    problem = F.coalesce("problem", F.when(F.coalesce(own != F.col("said"), F.lit(True)), F.lit("the payload differs from its digest")))
    return full.select("page_id", F.when(F.col("kind") == "revisit", F.col("to_bytes")).otherwise(F.col("bytes")).alias("payload_bytes"), own.alias("payload_digest"), F.col("kind").alias("record_type"), F.when(F.col("kind") == "revisit", F.col("to_page")).alias("refers_to"), problem.alias("problem"))
