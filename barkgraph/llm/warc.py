"""WARC archives: writing with revisit records, and reading by boundary-chain verification.

Writing. Every page becomes a record whose payload is its html in UTF-8. Of records with equal payloads of at
least REVISIT_FROM bytes, those with the largest page_id are responses and the others are revisits that
refer to it; smaller payloads are always responses. A task writes archives of at most ARCHIVE_BYTES under names of
its own attempt; only names that a finished task returns count, so lost or repeated tasks leave nothing that
is read. Records are gzip members (.warc.gz) or plain (.warc).

Reading. Archives are scanned in ranges of SPLIT_BYTES, dealt evenly to tasks. Wherever a range has a record's magic a task parses what
stands there and emits the candidate with its successor's offset; the magic may as well stand inside a
payload. Per archive, pointer jumping from offset 0 then marks the candidates that the chain of records
reaches, in a logarithmic number of array steps, and all others go. An archive whose chain doesn't end at its
last byte is an error.

A null html is the empty payload, a null url the empty URI. Repeated rows with the largest page_id are
responses each. Where every page_id of a payload is null, all are responses. Other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship
from .common import arrow_map, cut, scratch

REVISIT_FROM = 1000
ARCHIVE_BYTES = 256 << 20
SPLIT_BYTES = 8 << 20
#: Ranges that a task reads at most, where there are more of them than twice the cores.
RANGES_PER_TASK = 16
#: Payloads that occur again, up to which their digests are sent to all tasks (about 100 bytes each).
BROADCAST_ROWS = 100_000
LEVEL = 3

_GZIP = b"\x1f\x8b\x08"
_PLAIN = b"WARC/1."
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
_URN = "urn:page:"


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    """One WARC record; a revisit keeps the HTTP head, and so the payload's length."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if refers_to is not None else http + payload
    uri = re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m.group()):02X}", url or "")
    head = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{_URN}{'' if page_id is None else page_id}>",
        "WARC-Date: 1970-01-01T00:00:00Z",
        f"WARC-Target-URI: {uri}",
        f"WARC-Payload-Digest: sha1:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(block)}",
    ]
    if refers_to is not None:
        head[2:2] = [f"WARC-Refers-To: <{_URN}{refers_to}>", f"WARC-Profile: {_PROFILE}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def parse(data: bytes) -> tuple[dict, int] | None:
    """(fields, length) of the plain record at the start of data; None where there is none, or not all of it."""
    end = data.find(b"\r\n\r\n")
    if end < 0 or not data.startswith(_PLAIN):
        return None
    lines = data[:end].decode("utf-8", "replace").split("\r\n")[1:]
    head = {k.strip().lower(): v.strip() for k, _, v in (x.partition(":") for x in lines)}
    size = head.get("content-length", "")
    if not size.isdigit() or len(size) > 15:
        return None
    start, stop = end + 4, end + 4 + int(size)
    if data[stop : stop + 4] != b"\r\n\r\n":
        return None
    block = data[start:stop]
    http, _, payload = block.partition(b"\r\n\r\n")
    revisit = head.get("warc-type") == "revisit"
    length = re.search(rb"(?i)content-length: *([0-9]+)", http)
    page = lambda v: int(v) if (v := v.strip("<>").removeprefix(_URN)) else None
    try:
        fields = {
            "page_id": page(head.get("warc-record-id", "")),
            "payload_bytes": int(length[1]) if revisit and length else len(payload),
            "payload_digest": head.get("warc-payload-digest", "").removeprefix("sha1:") if revisit else hashlib.sha1(payload).hexdigest(),
            "record_type": head.get("warc-type", ""),
            "refers_to": page(head.get("warc-refers-to", "")) if revisit else None,
        }
    except ValueError:
        return None
    return fields, stop + 4


def _join_decisions(pages: DataFrame) -> DataFrame:
    """pages with refers_to: the response's page_id for revisits."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", F.sha1("payload"))
    long = rows.where(F.length("payload") >= REVISIT_FROM)
    again = cut(long.groupBy("digest").agg(F.max("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null").select("digest", "first"))
    # few repeated payloads go to every task; more of them are met by a join that splits hot digests
    side = F.broadcast(again) if again.count() <= BROADCAST_ROWS else again
    joined = rows.join(side, "digest", "left")
    revisit = (F.length("payload") >= REVISIT_FROM) & F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"))


def write_archives(pages: DataFrame, folder: str, compressed: bool = True) -> DataFrame:
    """(path, bytes, records) of the archives written below folder, a URI that all executors share."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(folder)
        out, path, size, count = None, "", 0, 0

        def close():
            out.close()
            return pa.record_batch([pa.array([path]), pa.array([size], pa.int64()), pa.array([count], pa.int64())], names=["path", "bytes", "records"])

        for batch in batches:
            for page, url, payload, digest, refers in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                data = record(page, url, payload, digest, refers)
                if compressed:
                    z = zlib.compressobj(LEVEL, zlib.DEFLATED, 31)
                    data = z.compress(data) + z.flush()
                if out is not None and size + len(data) > ARCHIVE_BYTES:
                    yield close()
                    out = None
                if out is None:
                    store.create_dir(base, recursive=True)
                    name = f"{uuid.uuid4().hex}.warc{'.gz' if compressed else ''}"
                    path, size, count = f"{folder}/{name}", 0, 0
                    out = store.open_output_stream(f"{base}/{name}", compression=None)
                out.write(data)
                size += len(data)
                count += 1
        if out is not None:
            yield close()

    # the table that cut() writes holds what finished attempts returned, and later reads repeat nothing
    return cut(arrow_map(_join_decisions(pages), run, "path string, bytes long, records long"))


class _Range:
    """Bytes of a file from `start` on, read as far as they are asked for."""

    def __init__(self, file, start: int, stop: int, size: int):
        self.file, self.size, self.start = file, size, start
        file.seek(start)
        self.data = bytearray(file.read(min(stop + 1024, size) - start))

    def more(self) -> bool:
        at = self.start + len(self.data)
        if at >= self.size:
            return False
        self.file.seek(at)
        self.data += self.file.read(min(max(1 << 16, len(self.data)), self.size - at))
        return True


def _candidate(r: _Range, at: int, compressed: bool) -> tuple[dict, int] | None:
    """The record that may start at `at` (within the range) and its length."""
    if not compressed:
        while (found := parse(bytes(r.data[at : at + (1 << 16)]))) is None:
            head = r.data.find(b"\r\n\r\n", at, at + (1 << 16))
            m = re.search(rb"(?i)\r\ncontent-length: *([0-9]{1,15})\r\n", r.data[at : head + 2]) if head >= 0 else None
            if m is None:
                if head < 0 and len(r.data) < at + (1 << 16) and r.more():
                    continue
                return None
            need = head + 8 + int(m[1])
            if r.start + need > r.size:
                return None
            while len(r.data) < need and r.more():
                pass
            return parse(bytes(r.data[at:need]))
        return found
    z, out, i, step = zlib.decompressobj(31), [], at, 1 << 14
    try:
        while not z.eof:
            if i >= len(r.data) and not r.more():
                return None
            part = bytes(r.data[i : i + step])
            out.append(z.decompress(part))
            i += len(part)
            if len(out) == 1 and not out[0].startswith(_PLAIN[: len(out[0])]):
                return None
    except zlib.error:
        return None
    used = i - len(z.unused_data) - at
    found = parse(b"".join(out))
    return (found[0], used) if found and found[1] == sum(map(len, out)) else None


_RECORD = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"
_NAMES = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
_TYPES = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]


def candidates(archives: DataFrame) -> DataFrame:
    """(path, bytes, offset, next, fields of the record) for every place that may start a record."""
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col("bytes") - 1, F.lit(0)), F.lit(SPLIT_BYTES).cast("long"))
    splits = archives.where("bytes > 0").select("path", "bytes", F.explode(starts).alias("start"))
    # a stated number, which adaptive execution leaves alone: the rows are tiny, what they name is not
    ranges = archives.agg(F.sum(F.ceil(F.col("bytes") / SPLIT_BYTES))).first()[0] or 1
    least = 2 * archives.sparkSession.sparkContext.defaultParallelism
    splits = splits.repartition(max(min(ranges, least), -(-ranges // RANGES_PER_TASK)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, size, start in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                compressed = path.endswith(".gz")
                magic = _GZIP if compressed else _PLAIN
                store, name = fs.FileSystem.from_uri(path)
                rows = []
                with store.open_input_file(name) as file:
                    stop = min(start + SPLIT_BYTES, size)
                    r = _Range(file, start, stop, size)
                    at = r.data.find(magic)
                    while 0 <= at < stop - start:
                        found = _candidate(r, at, compressed)
                        if found:
                            rows.append((start + at, start + at + found[1], *found[0].values()))
                        at = r.data.find(magic, at + 1)
                if rows:
                    c = list(zip(*rows, strict=True))
                    yield pa.record_batch([pa.array([path] * len(rows)), pa.array([size] * len(rows), pa.int64()), *(pa.array(x, t) for x, t in zip(c, [pa.int64()] * 2 + _TYPES, strict=True))], names=["path", "bytes", "offset", "next", *_NAMES])

    return arrow_map(splits, run, f"path string, bytes long, offset long, next long, {_RECORD}")


def reached(offset: np.ndarray, following: np.ndarray, end: int) -> np.ndarray:
    """Which candidates the chain from offset 0 meets; offsets sorted. Pointer jumping: the reached set and the
    pointers double their reach in every step."""
    n = len(offset)
    at = np.searchsorted(offset, following)
    ok = at < n
    ok[ok] = offset[at[ok]] == following[ok]
    jump = np.append(np.where(ok, at, n), n)  # n: no candidate follows
    mask = np.zeros(n + 1, bool)
    mask[0] = n > 0 and offset[0] == 0
    while True:
        grown = mask.copy()
        grown[jump[mask]] = True
        grown[n] = False
        if (grown == mask).all():
            break
        mask, jump = grown, jump[jump]
    last = np.flatnonzero(mask[:n])
    if not len(last) or following[last[-1]] != end:
        raise ValueError("an archive's chain of records does not end at its last byte")
    return mask[:n]


def read_archives(archives: DataFrame) -> DataFrame:
    """The records of the archives (path, bytes): page_id, payload_bytes, payload_digest, record_type, refers_to."""

    def keep(table: pa.Table) -> pa.Table:
        table = table.sort_by("offset")
        mask = reached(table["offset"].to_numpy(), table["next"].to_numpy(), table["bytes"][0].as_py())
        return table.filter(pa.array(mask)).select(_NAMES)

    # a group is one archive, whose size ARCHIVE_BYTES bounds
    ship(archives.sparkSession)
    return candidates(archives).groupBy("path").applyInArrow(keep, _RECORD)


def round_trip(pages: DataFrame) -> DataFrame:
    """Write the pages to archives in the shared scratch folder and read them back."""
    return read_archives(write_archives(pages, scratch(pages.sparkSession)))
