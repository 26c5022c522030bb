"""Media columns: motion-JPEG in AVI, from bytes to timed clips.

A payload is stored as gray 24 x 24 frames of nine 8 x 8 blocks. The format's own unit is the quantised DCT
coefficient, and each payload byte b is one of them, value b - 128 below 128 and b - 127 from there on (never
zero, -128 to 128). JPEG keeps quantised coefficients exactly, so the round trip is lossless. The Huffman tables
give a coefficient of s bits a code of 9 - s bits (10 - s for the DC differences), so every coefficient has the
same length: frames are valid baseline JPEG for any decoder, and here whole documents are coded and decoded
with array operations. Other frames go through a general baseline decoder, which takes the luma of colour frames.

Reading parses the RIFF chunks and the idx1 index, takes the frames by the index, decodes them to pixels
(each with its own quantisation table), and finds shots by the pixels' histograms: a frame starts a shot where the distance between its histogram and its predecessor's exceeds the mean plus
three deviations of the distances before it in the same shot. Clips are rows of (first frame, frames, start and
end in seconds).

A null text is the empty text: one frame of padding. Equal texts give equal rows. Very long texts are
coded FRAMES_AT_ONCE frames at a time. A null doc_id stays null, and other columns are ignored.
"""

from __future__ import annotations

import hashlib
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_batches

SIDE, BLOCKS, UNIT = 24, 9, 576
FPS = 25
FRAMES_AT_ONCE = 256
TAIL = 32  # bytes at the payload's end with a checksum of their own
#: Shots: deviations above the mean, least distance, and bins of the histogram.
DEVIATIONS, LEAST, BINS = 3.0, 0.08, 32

#: The order in which JPEG stores an 8 x 8 block's coefficients.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))


def _canonical(lengths: dict[int, int]) -> dict[int, tuple[int, int]]:
    """Symbol to (code, length), codes given by length, then symbol."""
    out, code, last = {}, 0, 0
    for symbol, n in sorted(lengths.items(), key=lambda x: (x[1], x[0])):
        code <<= n - last
        out[symbol], last = (code, n), n
        code += 1
    return out


_DC_LENGTHS = {s: 10 - s for s in range(10)}
_AC_LENGTHS = {s: 9 - s for s in range(1, 9)} | {0: 9}  # 0 closes a block; no block here needs it
_DC, _AC = _canonical(_DC_LENGTHS), _canonical(_AC_LENGTHS)


def _coded(value: int, table: dict[int, tuple[int, int]]) -> int:
    """The code of a coefficient's size and its bits after it."""
    s = abs(value).bit_length()
    code, _ = table[s]
    return code << s | (value if value > 0 else value + (1 << s) - 1)


_VALUES = np.array([b - 128 if b < 128 else b - 127 for b in range(256)])
_AC_CODE = np.array([_coded(int(v), _AC) for v in _VALUES], ">u2")
_DC_CODE = np.array([_coded(d, _DC) for d in range(-256, 257)], ">u2")
_AC_BYTE = np.full(512, -1, np.int16)
_AC_BYTE[_AC_CODE.astype(int)] = np.arange(256)
_DC_DIFF = np.full(1024, 9999, np.int16)
_DC_DIFF[_DC_CODE.astype(int)] = np.arange(-256, 257)
_BLOCK_BITS = 10 + 63 * 9
_FRAME_BYTES = -(-BLOCKS * _BLOCK_BITS // 8)


def _segment(marker: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, marker, len(body) + 2) + body


def _dht(kind: int, lengths: dict[int, int]) -> bytes:
    counts = bytes(sum(n == k for n in lengths.values()) for k in range(1, 17))
    return bytes([kind]) + counts + bytes(s for s, _ in sorted(lengths.items(), key=lambda x: (x[1], x[0])))


_HEAD = (
    b"\xff\xd8"
    + _segment(0xDB, b"\0" + b"\1" * 64)
    + _segment(0xC0, struct.pack(">BHHB", 8, SIDE, SIDE, 1) + b"\1\x11\0")
    + _segment(0xC4, _dht(0x00, _DC_LENGTHS) + _dht(0x10, _AC_LENGTHS))
    + _segment(0xDA, b"\1\1\0\0\x3f\0")
)
_END = b"\xff\xd9"


def encode_frames(payload: bytes) -> list[bytes]:
    """A JPEG for each UNIT bytes of the payload."""
    frames = np.frombuffer(payload, np.uint8).reshape(-1, BLOCKS, 64)
    out = []
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[i : i + FRAMES_AT_ONCE]
        n = len(part)
        bits = np.ones((n, _FRAME_BYTES * 8), np.uint8)
        blocks = bits[:, : BLOCKS * _BLOCK_BITS].reshape(n, BLOCKS, _BLOCK_BITS)
        dc = _VALUES[part[:, :, 0]]
        diff = np.diff(dc, axis=1, prepend=0) + 256
        codes = np.unpackbits(_DC_CODE[diff].view(np.uint8).reshape(n, BLOCKS, 2), axis=2)
        blocks[:, :, :10] = codes[:, :, 6:]
        codes = np.unpackbits(_AC_CODE[part[:, :, 1:]].view(np.uint8).reshape(n, BLOCKS, 63, 2), axis=3)
        blocks[:, :, 10:] = codes[:, :, :, 7:].reshape(n, BLOCKS, 567)
        for row in np.packbits(bits, axis=1):
            out.append(b"".join((_HEAD, row.tobytes().replace(b"\xff", b"\xff\0"), _END)))
    return out


def _chunk(name: bytes, body: bytes) -> bytes:
    return name + struct.pack("<I", len(body)) + body + b"\0" * (len(body) % 2)


def write_avi(frames: list[bytes], fps: int = FPS) -> bytes:
    """An AVI file with one MJPG stream and an idx1 index."""
    largest = max(map(len, frames), default=0)
    avih = struct.pack("<14I", 1_000_000 // fps, largest * fps, 0, 0x10, len(frames), 0, 1, largest, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIII4H", b"vids", b"MJPG", 0, 0, 0, 0, 1, fps, 0, len(frames), largest, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 24, b"MJPG", SIDE * SIDE * 3, 0, 0, 0, 0)
    hdrl = _chunk(b"LIST", b"hdrl" + _chunk(b"avih", avih) + _chunk(b"LIST", b"strl" + _chunk(b"strh", strh) + _chunk(b"strf", strf)))
    parts, index, at = [b"movi"], [], 4
    for f in frames:
        parts.append(b"00dc" + struct.pack("<I", len(f)) + f + b"\0" * (len(f) % 2))
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(f)))
        at += len(parts[-1])
    movi = b"".join(parts)
    body = b"AVI " + hdrl + b"LIST" + struct.pack("<I", len(movi)) + movi + _chunk(b"idx1", b"".join(index))
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """(frames a second, frames in the index's order). Files without idx1 are walked chunk by chunk."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("not an AVI file")
    at, end, fps, movi, index = 12, min(len(data), 8 + struct.unpack_from("<I", data, 4)[0]), float(FPS), None, None
    while at + 8 <= end:
        name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
        if name == b"LIST" and data[at + 8 : at + 12] == b"movi":
            movi = at + 8
            movi_end = at + 8 + size
        elif name == b"LIST" and data[at + 8 : at + 12] == b"hdrl":
            where = data.find(b"strh", at, at + 8 + size)
            scale, rate = struct.unpack_from("<II", data, where + 8 + 20)
            fps = rate / scale if scale else fps
        elif name == b"idx1":
            index = data[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if movi is None:
        raise ValueError("no movi list")
    frames = []
    if index:
        for name, _, offset, size in struct.iter_unpack("<4sIII", index):
            if name[2:] in (b"dc", b"db"):
                s = movi + offset
                if data[s : s + 4] != name:  # some writers count from the file's start
                    s = offset
                frames.append(data[s + 8 : s + 8 + size])
    else:
        at = movi + 4
        while at + 8 <= movi_end:
            name, size = data[at : at + 4], struct.unpack_from("<I", data, at + 4)[0]
            if name[2:] in (b"dc", b"db"):
                frames.append(data[at + 8 : at + 8 + size])
            at += 8 + size + size % 2
    return fps, frames


def decode_frames(frames: list[bytes]) -> np.ndarray:
    """Coefficients as stored (frames x blocks x 64, zigzag order) of frames with this module's tables."""
    out = []
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[i : i + FRAMES_AT_ONCE]
        raw = b"".join(f[len(_HEAD) : -2].replace(b"\xff\0", b"\xff") for f in part)
        bits = np.unpackbits(np.frombuffer(raw, np.uint8).reshape(len(part), _FRAME_BYTES), axis=1)
        blocks = bits[:, : BLOCKS * _BLOCK_BITS].reshape(len(part), BLOCKS, _BLOCK_BITS)
        padded = np.zeros((len(part), BLOCKS, 63, 16), np.uint8)
        padded[:, :, :, 7:] = blocks[:, :, 10:].reshape(len(part), BLOCKS, 63, 9)
        ac = np.packbits(padded, axis=3).view(">u2")[..., 0]
        head = np.zeros((len(part), BLOCKS, 16), np.uint8)
        head[:, :, 6:] = blocks[:, :, :10]
        diff = _DC_DIFF[np.packbits(head, axis=2).view(">u2")[..., 0]]
        dc = np.cumsum(diff.astype(np.int64), axis=1)
        values = np.empty((len(part), BLOCKS, 64), np.int16)
        values[:, :, 0] = dc
        values[:, :, 1:] = _VALUES[_AC_BYTE[ac]]
        out.append(values)
    return np.concatenate(out) if out else np.empty((0, BLOCKS, 64), np.int16)


def payload_of(values: np.ndarray) -> bytes:
    """The payload's bytes from their coefficients."""
    return (np.where(values < 0, values + 128, values + 127)).astype(np.uint8).tobytes()


_K = np.arange(8)
_BASIS = np.cos((2 * _K[None, :] + 1) * _K[:, None] * np.pi / 16) * np.where(_K == 0, np.sqrt(1 / 8), 0.5)[:, None]
#: From a block's coefficients in zigzag order to its pixels.
_INVERSE = np.ascontiguousarray(np.kron(_BASIS, _BASIS)[ZIGZAG])


def pixels(values: np.ndarray, quant: np.ndarray | None = None) -> np.ndarray:
    """Gray frames by dequantisation and the inverse DCT; blocks row by row."""
    flat = (values if quant is None else values.astype(np.int64) * quant).reshape(-1, 64).astype(float) @ _INVERSE
    flat += 128.5 + 1e-6  # halves go up, however the sum was ordered
    return np.clip(np.floor(flat, out=flat), 0, 255, out=flat).astype(np.uint8).reshape(*values.shape[:2], 8, 8)


def _huffman(counts: bytes, symbols: bytes) -> dict[tuple[int, int], int]:
    """(length, code) to symbol."""
    table, code, p = {}, 0, 0
    for n, c in enumerate(counts, 1):
        for _ in range(c):
            table[n, code] = symbols[p]
            code, p = code + 1, p + 1
        code <<= 1
    return table


#: The standard's tables (Annex K), which frames in AVI may leave out.
_DEFAULT_TABLES = {
    kind: _huffman(bytes.fromhex(counts), bytes.fromhex(symbols))
    for kind, counts, symbols in (
        (0x00, "00010501010101010100000000000000", "000102030405060708090a0b"),
        (0x01, "00030101010101010101010000000000", "000102030405060708090a0b"),
        (0x10, "0002010303020403050504040000017d", "01020300041105122131410613516107227114328191a1082342b1c11552d1f02433627282090a161718191a25262728292a3435363738393a434445464748494a535455565758595a636465666768696a737475767778797a838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae1e2e3e4e5e6e7e8e9eaf1f2f3f4f5f6f7f8f9fa"),
        (0x11, "00020102040403040705040400010277", "000102031104052131061241510761711322328108144291a1b1c109233352f0156272d10a162434e125f11718191a262728292a35363738393a434445464748494a535455565758595a636465666768696a737475767778797a82838485868788898a92939495969798999aa2a3a4a5a6a7a8a9aab2b3b4b5b6b7b8b9bac2c3c4c5c6c7c8c9cad2d3d4d5d6d7d8d9dae2e3e4e5e6e7e8e9eaf2f3f4f5f6f7f8f9fa"),
    )
}


def _entropy_coded(data: bytes, at: int) -> tuple[bytes, list[int], int]:
    """A scan's bytes without stuffing, where its restart intervals begin in them, and where the next marker is."""
    scan, marks = bytearray(), []
    while at < len(data):
        stop = data.find(b"\xff", at)
        if stop < 0 or stop + 1 >= len(data):
            scan += data[at : len(data) if stop < 0 else stop]
            return bytes(scan), marks, len(data)
        scan += data[at:stop]
        if data[stop + 1] == 0:
            scan.append(0xFF)
        elif 0xD0 <= data[stop + 1] <= 0xD7:
            marks.append(len(scan))
        elif data[stop + 1] == 0xFF:  # a filling byte
            at = stop + 1
            continue
        else:
            return bytes(scan), marks, stop
        at = stop + 2
    return bytes(scan), marks, at


def decode_luma(data: bytes) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Coefficients of the first component (block rows x block columns x 64, zigzag order), its quantisation table,
    height and width, of any baseline JPEG: code by code."""
    at, tables, quants, restart, parts = 2, dict(_DEFAULT_TABLES), {}, 0, None
    while True:
        while data[at + 1] == 0xFF:
            at += 1
        marker, size = data[at + 1], struct.unpack_from(">H", data, at + 2)[0]
        body = data[at + 4 : at + 2 + size]
        at += 2 + size
        if marker == 0xC4:
            while body:
                n = sum(body[1:17])
                tables[body[0]] = _huffman(body[1:17], body[17 : 17 + n])
                body = body[17 + n :]
        elif marker == 0xDB:
            while body:
                wide = body[0] >> 4
                quants[body[0] & 15] = np.frombuffer(body[1 : 65 + 64 * wide], ">u2" if wide else np.uint8).astype(np.int64)
                body = body[65 + 64 * wide :]
        elif marker in (0xC0, 0xC1):
            if body[0] != 8:
                raise ValueError("samples of eight bits only")
            height, width, n = struct.unpack_from(">HHB", body, 1)
            parts = [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]
        elif 0xC2 <= marker <= 0xCF and marker != 0xCC:
            raise ValueError("baseline frames only")
        elif marker == 0xDD:
            restart = struct.unpack(">H", body)[0]
        elif marker == 0xDA:
            scan, marks, following = _entropy_coded(data, at)
            chosen = [(body[1 + 2 * i], body[2 + 2 * i]) for i in range(body[0])]
            if parts[0][0] in [c for c, _ in chosen]:
                break
            at = following  # a scan of colour alone
    shape = {c: (h, v) for c, h, v, _ in parts}
    h_most, v_most = max(h for h, _ in shape.values()), max(v for _, v in shape.values())
    luma, h, v, quant = parts[0]
    height, width = -(-height * v // v_most), -(-width * h // h_most)
    if len(chosen) == 1:
        rows, columns, units = -(-height // 8), -(-width // 8), [(luma, 1, 1)]
        across = columns
    else:
        across, down = -(-width // (8 * h)), -(-height // (8 * v))
        rows, columns, units = down * v, across * h, [(c, *shape[c]) for c, _ in chosen]
    step_h, step_v = units[0][1:] if len(chosen) == 1 else (h, v)
    bits, pos, dc = np.unpackbits(np.frombuffer(scan, np.uint8)).tolist(), 0, {}
    coded_by = {c: (tables[t >> 4], tables[0x10 | t & 15]) for c, t in chosen}

    def symbol(table):
        nonlocal pos
        code = 0
        for n in range(1, 17):
            code = code << 1 | bits[pos]
            pos += 1
            if (n, code) in table:
                return table[n, code]
        raise ValueError("bad code")

    def extra(s):
        nonlocal pos
        v = int("".join(map(str, bits[pos : pos + s])), 2) if s else 0
        pos += s
        return v if not s or v >> (s - 1) else v - (1 << s) + 1

    out, unused = np.zeros((rows, columns, 64), np.int16), np.zeros(64, np.int16)
    for unit in range(rows * columns // (step_h * step_v)):
        if restart and unit and unit % restart == 0:
            dc, pos = {}, 8 * marks[unit // restart - 1]
        for part, wide, high in units:
            dc_table, ac_table = coded_by[part]
            for place in range(wide * high):
                block = out[unit // across * high + place // wide, unit % across * wide + place % wide] if part == luma else unused
                dc[part] = dc.get(part, 0) + extra(symbol(dc_table))
                block[0], k = dc[part], 1
                while k < 64:
                    s = symbol(ac_table)
                    if s == 0:
                        break
                    k += s >> 4
                    if s & 15:
                        value = extra(s & 15)
                        block[k] = value
                    k += 1
    return out, quants[quant], height, width


def decode_jpeg(data: bytes) -> np.ndarray:
    """Coefficients (blocks x 64, zigzag order) of the first component of any baseline JPEG."""
    return decode_luma(data)[0].reshape(-1, 64)


def coefficients(frames: list[bytes]) -> np.ndarray:
    """As decode_frames, by the general decoder where a frame has other tables."""
    if all(f.startswith(_HEAD) for f in frames):
        return decode_frames(frames)
    return np.stack([decode_jpeg(f) for f in frames])


def histograms(frames: np.ndarray) -> np.ndarray:
    """Shares of BINS grades of gray for each frame."""
    n = len(frames)
    grades = (frames.reshape(n, -1) // (256 // BINS)).astype(np.int64)
    return np.bincount((grades + BINS * np.arange(n)[:, None]).ravel(), minlength=n * BINS).reshape(n, BINS) / max(grades.shape[1], 1)


def decoded(frames: list[bytes]):
    """(payload, histograms) of the frames, FRAMES_AT_ONCE at a time."""
    for i in range(0, len(frames), FRAMES_AT_ONCE):
        part = frames[i : i + FRAMES_AT_ONCE]
        if all(f.startswith(_HEAD) for f in part):
            values = decode_frames(part)
            yield payload_of(values), histograms(pixels(values))
            continue
        for f in part:
            values, quant, height, width = decode_luma(f)
            rows, columns = values.shape[:2]
            image = pixels(values, quant).swapaxes(1, 2).reshape(8 * rows, 8 * columns)[:height, :width]
            yield payload_of(values), histograms(image[None])


def shots(values: np.ndarray, quant: np.ndarray | None = None) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot of frames given by their coefficients."""
    return cut_shots(histograms(pixels(values, quant))) if len(values) else []


def cut_shots(hist: np.ndarray) -> list[tuple[int, int]]:
    """(first frame, frames) of each shot, by adaptive differences of the frames' histograms."""
    n = len(hist)
    if n == 0:
        return []
    d = np.abs(np.diff(hist, axis=0)).sum(axis=1) / 2
    cuts, count, mean, square = [0], 0, 0.0, 0.0
    for i, x in enumerate(d.tolist()):
        spread = max(square / count, 0.0) ** 0.5 if count else 0.0
        if count >= 2 and x > max(LEAST, mean + DEVIATIONS * spread):
            cuts.append(i + 1)
            count, mean, square = 0, 0.0, 0.0
            continue
        count += 1
        delta = x - mean
        mean += delta / count
        square += delta * (x - mean)
    return [(a, b - a) for a, b in zip(cuts, [*cuts[1:], n], strict=True)]


def padded(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode("utf-8", "surrogatepass")
    return len(raw), raw + b"\xff" * (-len(raw) % UNIT or (UNIT if not raw else 0))


def encode_media(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): the texts as AVI files."""

    def start():
        def step(batch):
            for i in range(0, batch.num_rows, 64):
                part = batch.slice(i, 64)
                sizes, files = [], []
                for t in part.column(1).to_pylist():
                    n, payload = padded(t)
                    sizes.append(n)
                    files.append(write_avi(encode_frames(payload)))
                yield pa.record_batch([part.column(0), pa.array(sizes, pa.int64()), pa.array(files, pa.binary())], names=["doc_id", "n_bytes", "media"])

        return lambda batch: list(step(batch))

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return map_batches(rows, "doc_id long, n_bytes long, media binary", start)


def decode_media(files: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media digest and size, payload digest and size, clips): what the stored bytes hold."""
    clip = pa.struct([("first_frame", pa.int64()), ("frames", pa.int64()), ("start_sec", pa.float64()), ("end_sec", pa.float64())])

    def start():
        def step(batch):
            rows = []
            for data in batch.column(2).to_pylist():
                fps, frames = read_avi(data)
                parts = list(decoded(frames))
                payload = b"".join(p for p, _ in parts)
                hist = np.concatenate([h for _, h in parts]) if parts else np.empty((0, BINS))
                clips = [{"first_frame": s, "frames": n, "start_sec": s / fps, "end_sec": (s + n) / fps} for s, n in cut_shots(hist)]
                rows.append((len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-TAIL:]), len(data), hashlib.sha256(data).hexdigest(), clips))
            c = list(zip(*rows, strict=True)) or [[]] * 6
            types = (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.list_(clip))
            names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "clips"]
            return pa.record_batch([batch.column(0), batch.column(1), *(pa.array(x, t) for x, t in zip(c, types, strict=True))], names=names)

        return step

    schema = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, clips array<struct<first_frame:long,frames:long,start_sec:double,end_sec:double>>"
    return map_batches(files, schema, start)


def clips(decoded: DataFrame) -> DataFrame:
    """One row for each timed clip."""
    return decoded.select("doc_id", F.posexplode("clips").alias("clip", "c")).select("doc_id", "clip", "c.*")


def digests(decoded: DataFrame) -> DataFrame:
    feature = F.concat(F.lit("shots="), F.size("clips"), F.lit(";frames="), F.array_join(F.transform("clips", lambda c: c["frames"].cast("string")), ","))
    return decoded.select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", feature.alias("feature"))
