"""WARC archives in Zstandard: one frame per record, the dictionary in a leading skippable frame."""

from __future__ import annotations

import base64
import hashlib
import re
import struct
import uuid
from collections.abc import Iterator
from urllib.parse import quote, unquote_to_bytes

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from feedspark.llm.shared import prepare, tidy, written

#: Magic of the skippable frame that holds the dictionary.
DICT_MAGIC = 0x184D2A5D
FRAME_MAGIC = b"\x28\xb5\x2f\xfd"
#: An archive is closed once it has as many bytes, before or after compression.
ARCHIVE_BYTES = 4 << 20
ARCHIVE_RAW_BYTES = 32 << 20
#: The dictionary is trained on at most so many payloads, of at most so many bytes each, chosen by a hash of their ids.
DICT_PAGES = 192
DICT_PAGE_BYTES = 16 << 10
DICT_BYTES = 16 << 10
LEVEL = 3
_DATE = "2024-01-01T00:00:00Z"
_VERSION = b"WARC/1.1\r\n"


class WarcError(ValueError):
    """An archive or record that isn't as the format says."""


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record_id(page_id: object) -> str:
    return f"<urn:uuid:{uuid.uuid5(uuid.NAMESPACE_URL, f'page:{page_id}')}>"


def _clean(value: str) -> str:
    return re.sub(r"[\r\n]+", " ", value)


def _id_text(page_id: object) -> str:
    """An id as a header's value: percent-encoded, so that spaces, line ends and other scripts come back as they were."""
    return quote(str(page_id).encode("utf-8", "surrogatepass"), safe="")


def _id_of(value: str | None) -> str | None:
    return None if value is None else unquote_to_bytes(value).decode("utf-8", "surrogatepass")


def build_record(kind: str, page_id: object, url: str | None, payload: bytes, payload_digest: str, refers_to: object = None) -> bytes:
    """One WARC record: an HTTP response with its payload, or a revisit with the headers alone."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [
        f"WARC-Type: {kind}",
        f"WARC-Record-ID: {record_id(page_id)}",
        f"WARC-Date: {_DATE}",
        *([] if page_id is None else [f"WARC-Page-ID: {_id_text(page_id)}"]),
        f"WARC-Target-URI: {_clean(url or '')}",
        f"WARC-Payload-Digest: sha1:{payload_digest}",
        f"WARC-Block-Digest: sha1:{digest(block)}",
    ]
    if kind == "revisit":
        head += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: {record_id(refers_to)}", f"WARC-Refers-To-Page-ID: {_id_text(refers_to)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return _VERSION + "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse_record(data: bytes) -> dict:
    """Headers, HTTP headers and payload of one record; :class:`WarcError` where a header or a length is wrong."""
    if not data.startswith(_VERSION):
        raise WarcError("no WARC/1.1 version line")
    end = data.find(b"\r\n\r\n")
    if end < 0:
        raise WarcError("the header block has no end")
    head: dict[str, str] = {}
    for line in data[len(_VERSION) : end].split(b"\r\n"):
        name, colon, value = line.partition(b":")
        key = name.decode("ascii", "replace").strip().lower()
        if not colon or not key or key in head:
            raise WarcError(f"bad header line {line[:60]!r}")
        head[key] = value.strip().decode("utf-8", "surrogatepass")
    for key in ("warc-type", "warc-record-id", "warc-date", "content-length"):
        if key not in head:
            raise WarcError(f"no {key}")
    if head["warc-type"] not in ("response", "revisit", "warcinfo", "request", "resource", "metadata"):
        raise WarcError(f"unknown record type {head['warc-type']}")
    if not head["content-length"].isdigit():
        raise WarcError("bad content-length")
    size = int(head["content-length"])
    block = data[end + 4 : end + 4 + size]
    if len(block) != size or data[end + 4 + size :] != b"\r\n\r\n":
        raise WarcError("the record isn't as long as its content-length says")
    if "warc-block-digest" in head and head["warc-block-digest"] != f"sha1:{digest(block)}":
        raise WarcError("the block digest is wrong")
    out = {"headers": head, "block": block, "payload": block, "http_length": None}
    if head.get("content-type", "").startswith("application/http"):
        at = block.find(b"\r\n\r\n")
        if at < 0:
            raise WarcError("the HTTP header has no end")
        out["payload"] = block[at + 4 :]
        if m := re.search(rb"(?i)\r\ncontent-length:\s*(\d+)\r\n", block[: at + 4]):
            out["http_length"] = int(m[1])
        if head["warc-type"] == "response":
            if out["http_length"] is not None and out["http_length"] != len(out["payload"]):
                raise WarcError("the payload isn't as long as HTTP's content-length says")
            if "warc-payload-digest" in head and head["warc-payload-digest"] != f"sha1:{digest(out['payload'])}":
                raise WarcError("the payload digest is wrong")
        elif head["warc-type"] == "revisit" and out["payload"]:
            raise WarcError("a revisit has a payload")
    return out


def dictionary_frame(dictionary: bytes) -> bytes:
    return struct.pack("<II", DICT_MAGIC, len(dictionary)) + dictionary


def train_dictionary(samples: list[bytes], size: int = DICT_BYTES) -> bytes:
    """A Zstandard dictionary; samples too few to train on serve as a raw dictionary, none as the empty one."""
    try:
        return zstandard.train_dictionary(size, samples).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b"".join(samples)[-size:]


def _dict(data: bytes) -> zstandard.ZstdCompressionDict | None:
    return zstandard.ZstdCompressionDict(data) if len(data) >= 8 else None


class Writer:
    """An archive in memory: the dictionary's frame, then one frame for each record."""

    def __init__(self, dictionary: bytes, compressor: zstandard.ZstdCompressor | None = None) -> None:
        self.compressor = compressor or self.make(dictionary)
        self.parts = [dictionary_frame(dictionary)]
        self.size, self.raw, self.records = len(self.parts[0]), 0, 0

    @staticmethod
    def make(dictionary: bytes) -> zstandard.ZstdCompressor:
        d = _dict(dictionary)
        return zstandard.ZstdCompressor(level=LEVEL, write_content_size=True, write_checksum=True, **({"dict_data": d} if d else {}))

    def add(self, record: bytes) -> None:
        frame = self.compressor.compress(record)
        self.parts.append(frame)
        self.size += len(frame)
        self.raw += len(record)
        self.records += 1

    def full(self) -> bool:
        return self.size >= ARCHIVE_BYTES or self.raw >= ARCHIVE_RAW_BYTES

    def content(self) -> bytes:
        return b"".join(self.parts)


def read_archive(data: bytes) -> Iterator[dict]:
    """The records of an archive, one decoded frame at a time.

    The dictionary comes from the leading skippable frame (it may itself be
    compressed); other skippable frames are passed over. A frame that is cut short,
    fails its checksum, has trailing bytes or isn't one whole record raises :class:`WarcError`.
    """
    view, at, dictionary = memoryview(data), 0, b""
    if len(data) >= 8 and struct.unpack_from("<I", data)[0] == DICT_MAGIC:
        size = struct.unpack_from("<I", data, 4)[0]
        if 8 + size > len(data):
            raise WarcError("the dictionary's frame is cut short")
        dictionary, at = bytes(view[8 : 8 + size]), 8 + size
        if dictionary[:4] == FRAME_MAGIC:
            dictionary = zstandard.ZstdDecompressor().decompressobj().decompress(dictionary)
    d = _dict(dictionary)
    decoder = zstandard.ZstdDecompressor(**({"dict_data": d} if d else {}))
    while at < len(data):
        if len(data) - at < 8:
            raise WarcError("trailing bytes")
        magic = struct.unpack_from("<I", data, at)[0]
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", data, at + 4)[0]
            if at > len(data):
                raise WarcError("a skippable frame is cut short")
            continue
        if bytes(view[at : at + 4]) != FRAME_MAGIC:
            raise WarcError(f"no frame at byte {at}")
        one = decoder.decompressobj()
        pieces, to, step = [], at, 1 << 16
        try:
            while not one.eof:
                if to >= len(data):
                    raise WarcError("a frame is cut short")
                pieces.append(one.decompress(view[to : to + step]))
                to += step
        except zstandard.ZstdError as e:
            raise WarcError(f"a frame can't be decoded: {e}") from e
        end = min(to, len(data)) - len(one.unused_data)
        yield {**parse_record(b"".join(pieces)), "offset": at, "length": end - at}
        at = end


def write_archives(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", dedup_from: int = 0) -> DataFrame:
    """Archives of all pages as rows (archive string, records bigint, content binary).

    Payloads are the UTF-8 text (null: empty). Of records with equal payloads of at
    least ``dedup_from`` bytes the one with the smallest id is a response and the
    others revisit it. Digests are compared by a partial aggregation, so copies of
    one payload never meet in one task. A null id is written as a response of its own.
    An archive has at most about ``ARCHIVE_BYTES`` bytes; an empty table gives none.
    """
    spark = prepare(pages.sparkSession)
    src = pages.select(F.col(id_col).alias("id"), F.col(url_col).cast("string").alias("url"), F.coalesce(F.col(payload_col).cast("string"), F.lit("")).alias("body"))
    # Equal payloads: of one digest, length and second hash.
    same = ["sha", "size", "check"]
    src = src.withColumns({"sha": F.sha1(F.encode("body", "UTF-8")), "size": F.octet_length("body"), "check": F.xxhash64("body")})
    equal = src.where(F.col("id").isNotNull() & (F.col("size") >= dedup_from)).groupBy(*same).agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select(*same, "first")
    joined = src.join(equal, same, "left").select("id", "url", "body", F.when(F.col("size") >= dedup_from, F.col("first")).alias("first"))
    chosen = pages.where(F.col(id_col).isNotNull()).select(F.xxhash64(F.col(id_col)).alias("h"), F.col(id_col).alias("id")).distinct().orderBy("h", "id").limit(DICT_PAGES)
    chosen = [r.id for r in chosen.collect()]
    body = F.substring(F.col(payload_col).cast("string"), 1, DICT_PAGE_BYTES)
    samples = pages.where(F.col(id_col).isin(chosen)).groupBy(F.col(id_col).alias("id")).agg(F.min(body).alias("body")).orderBy("id").collect()
    samples = [(r.body or "").encode("utf-8", "surrogatepass")[:DICT_PAGE_BYTES] for r in samples]
    shared = spark.sparkContext.broadcast(train_dictionary([x for x in samples if x]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        dictionary = shared.value
        compressor = Writer.make(dictionary)
        w, name = Writer(dictionary, compressor), None

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([name], pa.string()), pa.array([w.records], pa.int64()), pa.array([w.content()], pa.binary())], names=["archive", "records", "content"])

        for b in batches:
            for pid, url, body, first in zip(*(c.to_pylist() for c in b.columns), strict=True):
                payload = body.encode("utf-8", "surrogatepass")
                name = name or f"pages-{pid}-{uuid.uuid5(uuid.NAMESPACE_URL, str(url))}.warc.zst"
                again = first is not None and pid is not None and first != pid
                w.add(build_record("revisit" if again else "response", pid, url, payload, digest(payload), first if again else None))
                if w.full():
                    yield out()
                    w, name = Writer(dictionary, compressor), None
        if w.records:
            yield out()

    return joined.mapInArrow(tidy(run), "archive string, records bigint, content binary")


def read_archives(archives: DataFrame, content_col: str = "content", payload: bool = True) -> DataFrame:
    """All records of archives (rows of :func:`write_archives`, or of Spark's ``binaryFile`` source).

    Returns record_type, page_id (string; null where the record names none), url,
    payload_digest (bare), http_length (the full payload's, as HTTP's header gives it),
    refers_to (string), byte_offset, byte_length and the payload (null for revisits).
    A malformed archive fails the job with a :class:`WarcError`.
    """
    prepare(archives.sparkSession)
    names = ["record_type", "page_id", "url", "payload_digest", "http_length", "refers_to", "byte_offset", "byte_length", "payload"]
    kinds = [pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.binary()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for data in b.column(0):
                if not data.is_valid:
                    continue
                rows, size = [], 0
                for r in read_archive(data.as_py()):
                    h = r["headers"]
                    pid, ref = h.get("warc-page-id"), h.get("warc-refers-to-page-id")
                    rows.append((h["warc-type"], _id_of(pid), h.get("warc-target-uri"), h.get("warc-payload-digest", "").removeprefix("sha1:") or None, r["http_length"], _id_of(ref), r["offset"], r["length"], r["payload"] if payload and h["warc-type"] != "revisit" else None))
                    size += len(r["payload"])
                    if len(rows) >= 512 or size >= 8 << 20:
                        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)

    schema = "record_type string, page_id string, url string, payload_digest string, http_length bigint, refers_to string, byte_offset bigint, byte_length bigint, payload binary"
    return archives.select(F.col(content_col).alias("content")).mapInArrow(tidy(run), schema)


def roundtrip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` as archives in the shared folder, read them back, and list the records."""
    archives = written(write_archives(pages), "warc")
    kind = pages.schema["page_id"].dataType
    return read_archives(archives, payload=False).select(
        F.col("page_id").cast(kind).alias("page_id"),
        F.col("http_length").alias("payload_bytes"),
        "payload_digest",
        "record_type",
        F.col("refers_to").cast(kind).alias("refers_to"),
    )
