"""Zstandard-compressed WARC archives (.warc.zst): reader, and a writer to make them.

Such a file starts with a skippable frame that holds a dictionary (itself
compressed or not), followed by one Zstandard frame for each record. The reader
loads the dictionary, finds the frames' ends by walking their block headers
without decompressing, decodes one record at a time and checks its header and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docparity.llm.common import cut, new_folder, open_stream, write_whole

DICTIONARY_MAGIC = 0x184D2A5D
_SKIPPABLE = range(0x184D2A50, 0x184D2A60)
_FRAME_MAGIC = 0xFD2FB528
_REQUIRED = ("WARC-Type", "WARC-Record-ID", "WARC-Date", "Content-Length")
#: Bytes of the largest record, decoded, that is given with its payload: about what one value of a row holds.
LARGEST_RECORD = 2_000_000_000
#: Records whose texts train a file's dictionary, and its size. The dictionary only affects the ratio.
DICTIONARY_SAMPLE, DICTIONARY_BYTES = 256, 32_768

SCHEMA = (
    "path string, frame_offset long, frame_bytes long, record_id string, warc_type string, warc_date string, target_uri string, "
    "headers map<string,string>, content_length long, http_status int, http_headers string, payload binary, error string"
)
_ARROW = pa.schema(
    [
        ("path", pa.string()), ("frame_offset", pa.int64()), ("frame_bytes", pa.int64()), ("record_id", pa.string()), ("warc_type", pa.string()), ("warc_date", pa.string()),
        ("target_uri", pa.string()), ("headers", pa.map_(pa.string(), pa.string())), ("content_length", pa.int64()), ("http_status", pa.int32()), ("http_headers", pa.string()),
        ("payload", pa.binary()), ("error", pa.string()),
    ]
)


class Truncated(ValueError):
    """The bytes end within a frame."""


class _Window:
    """Bytes of a stream by their offset, read forward only."""

    def __init__(self, stream, step: int):
        self.stream, self.step, self.buf, self.start = stream, step, bytearray(), 0

    def _more(self, n: int) -> bool:
        data = self.stream.read(max(n, self.step))
        self.buf += data
        return bool(data)

    def read(self, at: int, n: int) -> bytes:
        while at + n > self.start + len(self.buf):
            if not self._more(at + n - self.start - len(self.buf)):
                raise Truncated
        return bytes(self.buf[at - self.start : at - self.start + n])

    def drop(self, upto: int) -> None:
        """Forget what comes before ``upto``, reading on where it lies ahead."""
        while upto > self.start + len(self.buf):
            self.start += len(self.buf)
            self.buf.clear()
            if not self._more(0):
                raise Truncated
        if upto - self.start > self.step:
            del self.buf[: upto - self.start]
            self.start = upto

    def ended(self, at: int) -> bool:
        return at >= self.start + len(self.buf) and not self._more(0)


def _frame_end(window: _Window, at: int, most: int) -> tuple[int, bool]:
    """End of the frame that starts at ``at`` and whether it is a skippable one, from its header and block headers only. Of a frame of more than ``most`` bytes nothing is held."""
    magic = int.from_bytes(window.read(at, 4), "little")
    if magic in _SKIPPABLE:
        end = at + 8 + int.from_bytes(window.read(at + 4, 4), "little")
        if end - at > most:
            window.drop(end)
        return end, True
    if magic != _FRAME_MAGIC:
        raise ValueError(f"no Zstandard frame at byte {at}")
    flags = window.read(at + 4, 1)[0]
    single = flags >> 5 & 1
    p = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + (single, 2, 4, 8)[flags >> 6]
    while True:
        block = int.from_bytes(window.read(p, 3), "little")
        p += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
        if p - at > most:
            window.drop(p)
        if block & 1:
            break
    p += 4 * (flags >> 2 & 1)
    if p - at > most:
        window.drop(p)
    return p, False


def frames(stream, step: int = 1 << 20, most: int = LARGEST_RECORD) -> Iterator[tuple[int, int, bytes | None, bool]]:
    """(offset, size, bytes, skippable) of each frame of a stream; holds one frame and a step of input. A frame of more than ``most`` bytes is walked past and has no bytes."""
    window, at = _Window(stream, step), 0
    while not window.ended(at):
        try:
            end, skippable = _frame_end(window, at, most)
            data = window.read(at, end - at) if end - at <= most else None
        except Truncated:
            raise Truncated(f"the file ends within the frame at byte {at}") from None
        yield at, end - at, data, skippable
        window.drop(end)
        at = end


def dictionary_of(frame: bytes) -> zstandard.ZstdCompressionDict | None:
    """The dictionary in a leading skippable frame; None if the frame is another kind of skippable one."""
    if int.from_bytes(frame[:4], "little") != DICTIONARY_MAGIC:
        return None
    data = frame[8:]
    if data[:4] == _FRAME_MAGIC.to_bytes(4, "little"):
        data = zstandard.ZstdDecompressor().decompressobj().decompress(data)
    return zstandard.ZstdCompressionDict(data)


def parse_record(data: bytes) -> dict:
    """Fields of one decoded record; ``error`` tells what is wrong with it, and then there is no payload."""
    out: dict = {"headers": [], "error": None}
    head, blank, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not re.fullmatch(rb"WARC/\d+\.\d+", lines[0]):
        return out | {"error": "no WARC version line"}
    if not blank:
        return out | {"error": "header without end"}
    headers: list[tuple[str, str]] = []
    for line in lines[1:]:
        if line[:1] in (b" ", b"\t") and headers:
            headers[-1] = (headers[-1][0], headers[-1][1] + " " + line.strip().decode("utf-8", "replace"))
            continue
        name, colon, value = line.partition(b":")
        if not colon or not name.strip():
            return out | {"error": "header line without a name"}
        headers.append((name.strip().decode("utf-8", "replace"), value.strip().decode("utf-8", "replace")))
    by = {k.lower(): v for k, v in reversed(headers)}
    out["headers"] = list({k: v for k, v in reversed(headers)}.items())
    out |= {"record_id": by.get("warc-record-id"), "warc_type": by.get("warc-type"), "warc_date": by.get("warc-date"), "target_uri": by.get("warc-target-uri")}
    missing = [h for h in _REQUIRED if h.lower() not in by]
    if missing:
        return out | {"error": f"missing {', '.join(missing)}"}
    if not re.fullmatch(r"\d{1,18}", by["content-length"]):
        return out | {"error": "Content-Length is no number"}
    n = out["content_length"] = int(by["content-length"])
    if len(rest) < n + 4:
        return out | {"error": f"Content-Length {n}, but {max(0, len(rest) - 4)} bytes of content"}
    if rest[n : n + 4] != b"\r\n\r\n":
        return out | {"error": "content does not end where Content-Length says"}
    if len(rest) > n + 4:
        return out | {"error": "more than one record in the frame"}
    block = rest[:n]
    digest = by.get("warc-block-digest", "")
    if digest.lower().startswith("sha1:") and base64.b32encode(hashlib.sha1(block).digest()).decode() != digest[5:].upper():
        return out | {"error": "block digest does not match"}
    out["payload"] = block
    if by["warc-type"].lower() == "response" and by.get("content-type", "").lower().startswith("application/http"):
        http, blank, body = block.partition(b"\r\n\r\n")
        status = re.match(rb"HTTP/\S+ (\d{3})", http)
        if not status or not blank:
            return out | {"error": "no HTTP response in a response record", "payload": None}
        out |= {"http_status": int(status[1]), "http_headers": http.decode("utf-8", "replace"), "payload": body}
    return out


def _decoded(decoder: zstandard.ZstdDecompressor, frame: bytes | None, most: int) -> bytes:
    """The record in a frame; ``ValueError`` if it is larger than ``most``, whatever its header declares."""
    if frame is None or (size := zstandard.frame_content_size(frame)) > most:
        raise ValueError(f"record of more than {most} bytes")
    if size >= 0:
        return decoder.decompress(frame)
    with decoder.stream_reader(frame) as stream:
        parts, left = [], most + 1
        while left and (part := stream.read(min(left, 1 << 20))):
            parts.append(part)
            left -= len(part)
    if not left:
        raise ValueError(f"record of more than {most} bytes")
    return b"".join(parts)


def read_records(path: str, stream, most: int = LARGEST_RECORD) -> Iterator[dict]:
    """Records of one archive in order. A broken frame gives a row with ``error``; a file that cannot be walked on ends with one.

    A record of more than ``most`` bytes gives a row with ``error`` and no payload, and the next one follows.
    """
    decoder = zstandard.ZstdDecompressor()
    first = True
    try:
        # what does not compress takes a little more than its own length
        for offset, size, frame, skippable in frames(stream, most=most + (most >> 6) + (1 << 16)):
            if skippable:
                if first and frame is not None and (found := dictionary_of(frame)):
                    decoder = zstandard.ZstdDecompressor(dict_data=found)
                first = False
                continue
            first = False
            where = {"path": path, "frame_offset": offset, "frame_bytes": size}
            try:
                yield where | parse_record(_decoded(decoder, frame, most))
            except zstandard.ZstdError as e:
                yield where | {"headers": [], "error": f"frame does not decode: {e}"}
            except ValueError as e:
                yield where | {"headers": [], "error": str(e)}
    except (ValueError, zstandard.ZstdError) as e:
        yield {"path": path, "headers": [], "error": str(e)}


def _batch(rows: list[dict]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r.get(f.name) for r in rows], f.type) for f in _ARROW], schema=_ARROW)


def _read_rows(most: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path in batch.column("path").to_pylist():
                rows, size = [], 0
                with open_stream(path) as stream:
                    for row in read_records(path, stream, most):
                        rows.append(row)
                        size += len(row.get("payload") or b"")
                        if size > 4 << 20 or len(rows) >= 2000:
                            yield _batch(rows)
                            rows, size = [], 0
                if rows:
                    yield _batch(rows)

    return run


def read_warc_zst(paths: DataFrame, largest_record: int = LARGEST_RECORD) -> DataFrame:
    """Records of the archives listed in column ``path`` (null paths are skipped), one task a file; columns as in ``SCHEMA``.

    Every frame but skippable ones gives a row; what is wrong with it is in ``error``, null if
    nothing is. A record of more than ``largest_record`` bytes is such an error, and those after it are
    read; only bytes that are no frame, or end within one, end a file. An empty file gives no rows; a
    file listed twice is read twice. Other columns of ``paths`` are not read.
    """
    files = paths.where("path is not null").select("path")
    n = files.count()
    return files.repartition(max(1, min(n, 10_000)), F.monotonically_increasing_id()).mapInArrow(_read_rows(largest_record), SCHEMA)


# --- writer ---


def record_of(page_id: int | None, url: str | None, html: str | None) -> bytes:
    """A response record of a page. Nulls are told apart from empty values by missing headers; a URL that a header cannot hold as it is, with line ends or white space at an end, stands in Base64 besides."""
    raw = (url or "").encode()
    odd = re.search(rb"[\r\n]", raw) or raw.strip() != raw
    body = (html or "").encode()
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n" + (b"X-No-Body: 1\r\n" if html is None else b"") + b"\r\n" + body
    digest = base64.b32encode(hashlib.sha1(http).digest()).decode()
    head = [
        "WARC/1.1", "WARC-Type: response", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", "WARC-Date: 2024-01-01T00:00:00Z",
        *([] if url is None else [f"WARC-Target-URI: {re.sub(r'[\r\n]', ' ', url)}"]), *([f"X-Target-URI-Base64: {base64.b64encode(raw).decode()}"] if odd else []),
        "Content-Type: application/http; msgtype=response", f"WARC-Block-Digest: sha1:{digest}", f"Content-Length: {len(http)}",
    ]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + http + b"\r\n\r\n"


def archive(records: Iterator[bytes], level: int = 3) -> Iterator[bytes]:
    """An archive with a dictionary trained on its first records, in parts."""
    sample: list[bytes] = []
    for r in records:
        sample.append(r)
        if len(sample) >= DICTIONARY_SAMPLE:
            break
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, [r[:8192] for r in sample])
    except zstandard.ZstdError:  # too little to train on: the texts themselves
        trained = zstandard.ZstdCompressionDict(b"".join(sample)[:DICTIONARY_BYTES] or b"WARC/1.1\r\n", dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    data = trained.as_bytes()
    packed = zstandard.ZstdCompressor().compress(data)
    yield DICTIONARY_MAGIC.to_bytes(4, "little") + len(packed).to_bytes(4, "little") + packed
    writer = zstandard.ZstdCompressor(level=level, dict_data=trained, write_checksum=True, write_content_size=True)
    for r in sample:
        yield writer.compress(r)
    for r in records:
        yield writer.compress(r)


def write_warc_zst(pages: DataFrame, folder: str) -> DataFrame:
    """One archive for each partition of ``pages`` (page_id, url, html); their ``path`` and size. Files appear whole or not at all."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        def records() -> Iterator[bytes]:
            for batch in batches:
                for lo in range(0, batch.num_rows, 200):
                    part = batch.slice(lo, 200)
                    yield from map(record_of, *(part.column(c).to_pylist() for c in ("page_id", "url", "html")))

        path = f"{folder}/part-{TaskContext.get().partitionId():06d}.warc.zst"
        size = write_whole(path, archive(records()))
        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([size], pa.int64())], ["path", "bytes"])

    return cut(pages.select(F.col("page_id").cast("long").alias("page_id"), "url", "html").mapInArrow(run, "path string, bytes long"))


def pages_of(records: DataFrame) -> DataFrame:
    """(page_id, url, html) of the sound records :func:`write_warc_zst` made."""
    return records.where("error is null").select(
        F.nullif(F.regexp_extract("record_id", r"^<urn:page:(-?\d*)>$", 1), F.lit("")).cast("long").alias("page_id"),
        F.coalesce(F.decode(F.unbase64(F.col("headers")["X-Target-URI-Base64"]), "UTF-8"), "target_uri").alias("url"),
        F.when(~F.contains("http_headers", F.lit("X-No-Body: 1")), F.decode("payload", "UTF-8")).alias("html"),
    )


def round_trip(spark: SparkSession, pages: DataFrame) -> DataFrame:
    """Write all pages as archives into the shared folder and read them back: (page_id, url, html).

    Nulls, empty values, repeated rows and line ends in URLs come back as they were; a page without
    ``page_id`` too. Other columns of ``pages`` are not read. An empty table gives an empty result.
    """
    return pages_of(read_warc_zst(write_warc_zst(pages, new_folder(spark, "warc"))))
