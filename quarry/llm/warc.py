"""Web archives in Zstandard: a dictionary in a leading skippable frame, then one frame for each record.

Archives are plain files that Spark writes and reads, so they may lie in any store: a task's archive is the rows of a text file
whose separator is an empty skippable frame. A writer's file system must show a folder's files only when the job is done, as Spark's
committers see to.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.common import keep, ship, utf8

#: Skippable frames: the one that holds a dictionary, and an empty one, whose bytes are all ASCII.
DICTIONARY_MAGIC, SEPARATOR = b"\x5d\x2a\x4d\x18", "P*M\x18\0\0\0\0"
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
DICTIONARY_BYTES, TRAINED_ON = 16_384, 400
LEVEL = 3
#: Records with equal payloads of so many bytes revisit the one with the smallest page_id.
LEAST_SHARED = 100
#: Payload bytes of an archive, about; parts into which the rows of a payload that others share are dealt.
ARCHIVE, SALTS = 256 << 20, 16
#: Payload bytes for which an archive more is worth a task of its own, up to the session's number of shuffle partitions.
LEAST_ARCHIVE = 1 << 20
DATE = "2024-01-01T00:00:00Z"


def skippable(content: bytes) -> bytes:
    return DICTIONARY_MAGIC + len(content).to_bytes(4, "little") + content


def trained(samples: list[bytes]) -> zstandard.ZstdCompressionDict:
    """A dictionary for records like these; few or small samples are one themselves."""
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, samples)
    except zstandard.ZstdError:
        raw = b"".join(samples)[:DICTIONARY_BYTES]
        return zstandard.ZstdCompressionDict(raw.ljust(16), dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """A record: headers, a block of the page's HTTP headers and, if it is no revisit, the payload."""
    block = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode() + (b"" if revisit else payload)
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Date: {DATE}", f"WARC-Payload-Digest: sha256:{digest}", "Content-Type: application/http; msgtype=response"]
    if page_id is not None:
        head.append(f"WARC-Record-ID: <urn:page:{page_id}>")
    if url:
        head.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    if revisit:
        head.append("WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest")
        if refers_to is not None:
            head.append(f"WARC-Refers-To: <urn:page:{refers_to}>")
    return "\r\n".join(head).encode() + f"\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def decided(pages: DataFrame) -> tuple[DataFrame, int]:
    """page_id, digest, first of the rows whose payload others share, and the bytes of all payloads.

    Only ids, digests and lengths are exchanged. The rows of a digest are dealt into SALTS parts, as many may share it.
    """
    payload = utf8("html")
    thin = keep(pages.select("page_id", F.sha2(payload, 256).alias("digest"), F.octet_length(payload).cast("long").alias("n")), "digests")
    large = thin.where(F.col("n") >= LEAST_SHARED).select("page_id", "digest").groupBy("page_id", "digest").count()
    shared = large.groupBy("digest").agg(F.min("page_id").alias("first"), F.sum("count").alias("copies")).where("copies > 1")
    salts = F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))
    parts = shared.select("digest", "first", salts.alias("salt"))
    told = large.withColumn("salt", F.pmod(F.xxhash64("page_id"), F.lit(SALTS)).cast("int")).join(parts, ["digest", "salt"]).select("page_id", "digest", "first")
    return told, thin.agg(F.sum("n")).first()[0] or 0


def write(pages: DataFrame, path: str) -> None:
    """Archives of all rows of page_id, url, html under `path`, each of about ARCHIVE payload bytes (or one longer record).

    Null html is an empty payload. Of records with equal payloads of LEAST_SHARED bytes or more, those with the smallest
    page_id are responses, the others revisit it; a row without an id revisits, unless no row of its payload has one. Repeated
    rows stay. Other columns are left out. Rows are dealt by id and digest, so that equal payloads do not meet in one task.
    """
    ship(pages.sparkSession)
    told, size = decided(pages)
    # a null id as a text of its own, so that one exchange serves the archives' sizes and the join
    key = F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key")
    rows = pages.select(key, "page_id", utf8("url").alias("url"), utf8("html").alias("payload")).withColumn("digest", F.sha2("payload", 256))
    few = min(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // LEAST_ARCHIVE))
    rows = rows.repartition(max(1, few, -(-size // ARCHIVE)), "key", "digest")
    told = rows.join(told.select(key, "digest", "first"), ["key", "digest"], "left").select("page_id", "url", "payload", "digest", "first", (F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))).alias("revisit"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def records(b: pa.RecordBatch) -> list[bytes]:
            return [record(p, u.decode("utf-8", "replace"), x, len(x), d, f, r) for p, u, x, d, f, r in zip(*(c.to_pylist() for c in b.columns), strict=True)]

        compressor = None
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                some = records(whole.slice(at, 500))
                out = []
                if compressor is None:
                    dictionary = trained(some[:TRAINED_ON])
                    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_content_size=True, write_checksum=True)
                    out.append(skippable(zstandard.compress(dictionary.as_bytes())))
                out += [compressor.compress(x) for x in some]
                yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["frame"])

    frames = told.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value"))
    frames.write.option("lineSep", SEPARATOR).option("compression", "none").text(path)


def frame_end(data: memoryview, at: int) -> int:
    """Where the frame that begins at `at` ends: its header's and its blocks' sizes say so."""
    flags = data[at + 4]
    single = flags >> 5 & 1
    end = at + 5 + (1 - single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    last = False
    while not last:
        block = int.from_bytes(data[end : end + 3], "little")
        last = bool(block & 1)
        end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
    return end + 4 * (flags >> 2 & 1)


def frames(data: bytes) -> Iterator[bytes]:
    """The content of each frame of an archive."""
    view, at, decompressor = memoryview(data), 0, zstandard.ZstdDecompressor()
    while at < len(view):
        magic = bytes(view[at : at + 4])
        if magic[1:] == DICTIONARY_MAGIC[1:] and magic[0] & 0xF0 == 0x50:
            size = int.from_bytes(view[at + 4 : at + 8], "little")
            content = bytes(view[at + 8 : at + 8 + size])
            if len(content) != size:
                raise ValueError(f"the skippable frame at byte {at} is cut short")
            if magic == DICTIONARY_MAGIC:
                if at:
                    raise ValueError(f"a dictionary at byte {at} is not the archive's first frame")
                raw = zstandard.decompress(content) if content[:4] == FRAME_MAGIC else content
                decompressor = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
            at += 8 + size
        elif magic == FRAME_MAGIC:
            end = frame_end(view, at)
            if end > len(view):
                raise ValueError(f"the frame at byte {at} is cut short")
            yield decompressor.decompress(view[at:end])
            at = end
        else:
            raise ValueError(f"no frame begins at byte {at}")


def parsed(content: bytes) -> tuple[int | None, int, str, str, int | None, bytes]:
    """page_id, payload's size, its digest, type, refers_to, payload; raises ValueError for a record that breaks the format."""
    head, gap, rest = content.partition(b"\r\n\r\n")
    version, *lines = head.decode("utf-8").split("\r\n")
    fields = dict(line.split(": ", 1) for line in lines)
    if not gap or not version.startswith("WARC/1."):
        raise ValueError("no WARC record")
    length = int(fields["Content-Length"])
    if len(rest) != length + 4 or rest[length:] != b"\r\n\r\n":
        raise ValueError(f"a record's block has {len(rest) - 4} bytes, its header says {length}")
    http, gap, payload = rest[:length].partition(b"\r\n\r\n")
    size = int(re.search(rb"\r\nContent-Length: (\d+)", http)[1])
    digest = fields["WARC-Payload-Digest"].removeprefix("sha256:")
    kind = fields["WARC-Type"]
    if kind == "response" and (len(payload) != size or hashlib.sha256(payload).hexdigest() != digest):
        raise ValueError("a payload does not match its length or digest")
    number = lambda name: int(m[1]) if (m := re.fullmatch(r"<urn:page:(-?\d+)>", fields.get(name, ""))) else None
    return number("WARC-Record-ID"), size, digest, kind, number("WARC-Refers-To"), payload


def read_archives(spark, path: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to, payload (empty for a revisit) of all records under `path`.

    A record that breaks the format, or whose payload does not match its length or digest, fails the job. An archive is
    held whole by the task that reads it; `write` bounds them.
    """
    ship(spark)
    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "payload"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            some: list[tuple] = []
            size = 0
            for x in chain.from_iterable(map(frames, (c.as_py() for c in b.column(0)))):
                some.append(parsed(x))
                size += len(x)
                if size > 4 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)
                    some, size = [], 0
            if some:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*some, strict=True), types, strict=True)], names)

    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path).select("content")
    return files.mapInArrow(run, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary")
