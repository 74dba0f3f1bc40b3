"""WARC writing and sequential reading.

Every record is a gzip member of its own. The reader inflates a member
incrementally, frames the block by Content-Length while it does, needs the record
to end where its length says, and verifies block and payload digests. An archive is a
row (archive, content): whole archives of bounded size live in a Parquet table
of the shared folder, and ``read_archives`` takes files read by ``binaryFile``
just as well.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

#: Payloads below this many bytes are always written in full.
MIN_REVISIT = 100
#: Compressed bytes at which an archive is closed.
ARCHIVE_BYTES = 4 << 20
#: Bytes that a WARC header has at most.
MAX_HEAD = 1 << 20
DATE = "2000-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_EMPTY = base64.b32encode(hashlib.sha1(b"").digest()).decode()


def record_uri(number: int) -> str:
    return f"<urn:uuid:{uuid.UUID(int=number & (1 << 128) - 1)}>"


def _number(uri: str | None) -> int | None:
    """The page that a record URI of :func:`record_uri` stands for; None for any other URI."""
    try:
        n = uuid.UUID((uri or "").strip("<> ").rpartition(":")[2]).int
    except ValueError:
        return None
    n = n - (1 << 128) if n >> 127 else n
    return n if -(1 << 63) <= n < 1 << 63 else None


def write_record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, level: int = 6) -> bytes:
    """One record as one gzip member; ``refers_to`` makes it a revisit."""
    revisit = refers_to is not None
    block = b"" if revisit else payload
    head = [
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", record_uri(page_id) if page_id is not None else f"<urn:uuid:{uuid.uuid4()}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", "".join(c for c in url or "" if c >= " ")),
        ("Content-Type", "text/html; charset=utf-8"),
        ("WARC-Block-Digest", "sha1:" + (base64.b32encode(hashlib.sha1(block).digest()).decode() if block else _EMPTY)),
        ("WARC-Payload-Digest", "sha256:" + digest),
        ("X-Payload-Length", str(len(payload))),
    ]
    if page_id is not None:
        head.append(("X-Page-Id", str(page_id)))
    if revisit:
        head += [("WARC-Profile", _REVISIT), ("WARC-Refers-To", record_uri(refers_to))]
    head.append(("Content-Length", str(len(block))))
    raw = b"WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in head).encode() + b"\r\n" + block + b"\r\n\r\n"
    gz = zlib.compressobj(level, zlib.DEFLATED, 31)
    return gz.compress(raw) + gz.flush()


class WarcError(ValueError):
    """A record that is cut short, badly framed, or fails a digest."""


def records(data: bytes | memoryview, step: int = 1 << 16) -> Iterator[tuple[dict[str, str], bytes]]:
    """Headers (lower-case names) and block of the records of an archive in order.

    A gzip member is inflated step by step. Once its header is complete,
    Content-Length frames the record: a member that goes on beyond is given up
    there, one that ends before is cut short. Digests are verified."""
    view, at = memoryview(data), 0
    while at < len(view):
        gz, raw, head, stop = zlib.decompressobj(31), bytearray(), None, 0
        try:
            while not gz.eof:
                if at >= len(view) and not gz.unconsumed_tail:
                    raise WarcError("the archive ends inside a member")
                if gz.unconsumed_tail:
                    raw += gz.decompress(gz.unconsumed_tail, 1 << 20)
                else:
                    raw += gz.decompress(view[at : at + step], 1 << 20)
                    at += min(step, len(view) - at)
                if head is None and (end := raw.find(b"\r\n\r\n")) >= 0:
                    head, start = _header(bytes(raw[:end])), end + 4
                    stop = start + _length(head)
                if head is None and len(raw) > MAX_HEAD:
                    raise WarcError("no end of the WARC header")
                if head is not None and len(raw) > stop + 4:
                    raise WarcError("the record does not end where Content-Length says")
        except zlib.error as e:
            raise WarcError(f"not a gzip member: {e}") from None
        at -= len(gz.unused_data)
        if head is None:
            raise WarcError("no WARC header")
        if raw[stop:] != b"\r\n\r\n":
            raise WarcError("the record does not end where Content-Length says")
        block = bytes(raw[start:stop])
        _verify(head, block)
        yield head, block


def _header(raw: bytes) -> dict[str, str]:
    if not raw.startswith(b"WARC/"):
        raise WarcError("no WARC header")
    try:
        lines = raw.decode().split("\r\n")[1:]
    except UnicodeDecodeError:
        lines = raw.decode("latin-1").split("\r\n")[1:]
    head, last = {}, None
    for line in lines:
        if line[:1] in (" ", "\t") and last:  # a folded line
            head[last] += " " + line.strip()
            continue
        name, colon, value = line.partition(":")
        if not colon:
            raise WarcError("a header line without a colon")
        last = name.strip().lower()
        head[last] = value.strip()
    if "warc-type" not in head:
        raise WarcError("no WARC-Type")
    return head


def _length(head: dict[str, str]) -> int:
    value = head.get("content-length", "")
    if not (value.isascii() and value.isdigit()):
        raise WarcError("no Content-Length")
    return int(value)


def payload_of(head: dict[str, str], block: bytes) -> bytes:
    """What follows the HTTP header of a captured response, else the block."""
    if head.get("content-type", "").lower().startswith("application/http"):
        for gap in (b"\r\n\r\n", b"\n\n"):
            _, found, body = block.partition(gap)
            if found:
                return body
    return block


def same_digest(want: str, data: bytes) -> bool:
    """Whether a labelled digest (md5, sha1, sha256 or sha512, as base 32 or hex)
    is that of ``data``; one by another algorithm cannot be judged and passes."""
    name, _, value = want.partition(":")
    if name.lower().replace("-", "") not in ("md5", "sha1", "sha256", "sha512"):
        return True
    own = hashlib.new(name.lower().replace("-", ""), data, usedforsecurity=False)
    return value.lower() == own.hexdigest() or value.upper().rstrip("=") == base64.b32encode(own.digest()).decode().rstrip("=")


def _verify(head: dict[str, str], block: bytes) -> None:
    if (want := head.get("warc-block-digest")) and not same_digest(want, block):
        raise WarcError("block digest")
    # a revisit's payload is elsewhere; a segment has a part of it only
    if head["warc-type"] in ("response", "resource") and "warc-segment-number" not in head:
        if (want := head.get("warc-payload-digest")) and not same_digest(want, payload_of(head, block)):
            raise WarcError("payload digest")


def _plan(pages: DataFrame, min_revisit: int) -> DataFrame:
    """Pages with digest, and the page that a revisit refers to. Only digests
    that repeat are joined, and groups are reduced before the join."""
    html = F.coalesce(F.col("html"), F.lit(""))
    rows = pages.select(
        F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), html.alias("html"), F.sha2(html, 256).alias("digest")
    )
    repeated = (
        rows.filter(F.octet_length("html") >= min_revisit)
        .groupBy("digest")
        .agg(F.min("page_id").alias("first"), F.count("*").alias("n"))
        .filter("n > 1 and first is not null")
        .select(F.col("digest").alias("_digest"), "first")
    )
    repeated = materialize(pages.sparkSession, repeated, "repeated-payloads")
    joined = rows.join(repeated.hint("merge"), F.col("digest") == F.col("_digest"), "left")
    refers = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    return joined.select("page_id", "url", "html", "digest", refers.alias("refers_to"))


def write_archives(pages: DataFrame, min_revisit: int = MIN_REVISIT, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """Write every row of ``pages`` as a record; returns (archive, content).

    Of pages with equal payloads of at least ``min_revisit`` bytes the smallest
    page_id is a response (each row of it, should it repeat) and the others,
    among them rows without an id, revisit it. A null html is an empty payload;
    an empty table gives no archive; only page_id, url and html are read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own: list[bytes] = []
        size = 0
        for batch in batches:
            for page_id, url, html, digest, refers in zip(*(c for c in batch.columns)):
                r = refers.as_py()
                own.append(write_record(page_id.as_py(), url.as_py(), html.as_py().encode(), digest.as_py(), r))
                size += len(own[-1])
                if size >= archive_bytes:
                    yield _archive(own)
                    own, size = [], 0
        if own:
            yield _archive(own)

    return materialize(pages.sparkSession, _plan(pages, min_revisit).mapInArrow(run, "archive string, content binary"), "warc")


def _archive(records: list[bytes]) -> pa.RecordBatch:
    data = b"".join(records)
    name = f"{hashlib.sha256(data).hexdigest()[:32]}.warc.gz"
    return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([data], pa.binary())], names=["archive", "content"])


RECORD = (
    "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, "
    "record_id string, refers_to_uri string, archive string, payload binary, error string"
)


def _whole(value: str | None) -> int | None:
    return int(value) if value and value.lstrip("-").isascii() and value.lstrip("-").isdigit() and len(value) < 19 else None


def read_archives(archives: DataFrame, with_payload: bool = True, strict: bool = True) -> DataFrame:
    """The records of archives (archive, content), one row each, of any type.

    Archives may be this module's own or a crawler's: ``page_id`` and
    ``refers_to`` are null for records that it did not write, whose URIs are in
    ``record_id`` and ``refers_to_uri``. payload_bytes is the length of the
    payload; ``payload_digest`` is the header's, without its label. A null or
    empty content has no records. A broken record fails the read, or with
    ``strict=False`` becomes a row with only archive and error; what follows a
    broken member cannot be framed. Only archive and content are read.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.schema(
            [("page_id", pa.int64()), ("url", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
             ("refers_to", pa.int64()), ("record_id", pa.string()), ("refers_to_uri", pa.string()), ("archive", pa.string()), ("payload", pa.binary()),
             ("error", pa.string())]
        )
        for batch in batches:
            for name, content in zip(batch.column(0).to_pylist(), batch.column(1)):
                rows, size = [], 0
                try:
                    for head, block in records(content.as_buffer() or b""):
                        payload, refers = payload_of(head, block), head.get("warc-refers-to")
                        own = _whole(head.get("x-payload-length"))
                        rows.append(
                            {
                                "page_id": _whole(head.get("x-page-id")),
                                "url": head.get("warc-target-uri"),
                                "payload_bytes": len(payload) if own is None else own,
                                "payload_digest": head.get("warc-payload-digest", "").partition(":")[2],
                                "record_type": head["warc-type"],
                                "refers_to": _number(refers),
                                "record_id": head.get("warc-record-id"),
                                "refers_to_uri": refers,
                                "archive": name,
                                "payload": payload if with_payload else None,
                                "error": None,
                            }
                        )
                        size += len(payload) if with_payload else 200
                        if size > 8 << 20:
                            yield pa.RecordBatch.from_pylist(rows, schema=kind)
                            rows, size = [], 0
                except WarcError as e:
                    if strict:
                        raise
                    rows.append({"archive": name, "error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=kind)

    return archives.select("archive", "content").mapInArrow(run, RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write ``pages`` and read the archives back, without payloads."""
    return read_archives(write_archives(pages), with_payload=False).drop("payload", "error")
