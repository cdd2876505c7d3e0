"""AVI motion-JPEG media: bytes as lossless grey frames, and shots from adaptive histogram differences.

A frame is 24 x 24 samples of 8 bits, coded as lossless JPEG (ITU-T T.81, process 14, start of frame 3, predictor 1). Its
Huffman table gives category s a code of 9 - s bits, so any sample takes 9 bits and whole batches pack and unpack as
arrays. Frames lie in an AVI file: RIFF headers, a movi list of 00dc chunks and an idx1 index, which reading goes by.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tickloom.llm.common import text_of

SIDE, FPS, BINS = 24, 25, 16
FRAME = SIDE * SIDE
PACKED = FRAME * 9 // 8


def _tables() -> tuple[np.ndarray, np.ndarray]:
    """The 9-bit field of each difference (at 255 + difference), and the difference of each field."""
    to, back = np.zeros(511, np.uint16), np.zeros(512, np.int16)
    for d in range(-255, 256):
        s = abs(d).bit_length()
        field = ((((1 << (8 - s)) - 1) << 1) << s) | (d if d >= 0 else d + (1 << s) - 1)
        to[255 + d], back[field] = field, d
    return to, back


FIELD, DIFFERENCE = _tables()


def _segment(mark: int, body: bytes) -> bytes:
    return struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body


HEAD = (
    b"\xff\xd8"
    + _segment(0xC3, struct.pack(">BHHBBBB", 8, SIDE, SIDE, 1, 1, 0x11, 0))
    + _segment(0xC4, bytes([0, *[1] * 9, *[0] * 7, *range(8, -1, -1)]))
    + _segment(0xDA, bytes([1, 1, 0, 1, 0, 0]))
)
TAIL = b"\xff\xd9"


def pack_frames(samples: np.ndarray) -> np.ndarray:
    """(n, 576) samples to (n, 648) bytes of entropy-coded data, before byte stuffing."""
    x = samples.reshape(-1, SIDE, SIDE).astype(np.int16)
    d = np.empty_like(x)
    d[:, :, 1:] = x[:, :, 1:] - x[:, :, :-1]
    d[:, 1:, 0] = x[:, 1:, 0] - x[:, :-1, 0]
    d[:, 0, 0] = x[:, 0, 0] - 128
    f = FIELD[d.reshape(-1, 8) + 255]
    out = np.empty((len(f), 9), np.uint8)
    out[:, 0] = f[:, 0] >> 1
    for k in range(1, 8):
        out[:, k] = (f[:, k - 1] << (8 - k)) | (f[:, k] >> (k + 1))
    out[:, 8] = f[:, 7]
    return out.reshape(-1, PACKED)


def unpack_frames(packed: np.ndarray) -> np.ndarray:
    b = packed.reshape(-1, 9).astype(np.uint16)
    f = np.empty((len(b), 8), np.uint16)
    for k in range(8):
        f[:, k] = ((b[:, k] << (k + 1)) | (b[:, k + 1] >> (7 - k))) & 511
    d = DIFFERENCE[f].astype(np.uint8).reshape(-1, SIDE, SIDE)
    d[:, :, 0] = np.add.accumulate(d[:, :, 0], axis=1, dtype=np.uint8)
    return (np.add.accumulate(d, axis=2, dtype=np.uint8) + np.uint8(128)).reshape(-1, FRAME)


def write_avi(jpegs: list[bytes]) -> bytes:
    chunks, index, at = [], [], 4
    for j in jpegs:
        index.append(struct.pack("<4sIII", b"00dc", 0x10, at, len(j)))
        chunks.append(struct.pack("<4sI", b"00dc", len(j)) + j + b"\0" * (len(j) & 1))
        at += len(chunks[-1])
    most = max(map(len, jpegs), default=0)
    avih = struct.pack("<14I", 1_000_000 // FPS, most * FPS, 0, 0x10, len(jpegs), 0, 1, most, SIDE, SIDE, 0, 0, 0, 0)
    strh = struct.pack("<4s4sIHHIIIIIIIIhhhh", b"vids", b"MJPG", 0, 0, 0, 0, 1, FPS, 0, len(jpegs), most, 0xFFFFFFFF, 0, 0, 0, SIDE, SIDE)
    strf = struct.pack("<IiiHH4sIiiII", 40, SIDE, SIDE, 1, 8, b"MJPG", FRAME, 0, 0, 0, 0)
    chunk = lambda name, body: struct.pack("<4sI", name, len(body)) + body
    strl = chunk(b"LIST", b"strl" + chunk(b"strh", strh) + chunk(b"strf", strf))
    hdrl = chunk(b"LIST", b"hdrl" + chunk(b"avih", avih) + strl)
    movi = chunk(b"LIST", b"movi" + b"".join(chunks))
    return chunk(b"RIFF", b"AVI " + hdrl + movi + chunk(b"idx1", b"".join(index)))


def read_avi(data: bytes) -> tuple[float, list[bytes]]:
    """Frames a second and the frames, found through the RIFF index (offsets count from the movi tag)."""
    if data[:4] != b"RIFF" or data[8:12] != b"AVI ":
        raise ValueError("no AVI file")
    found: dict[bytes, tuple[int, int]] = {}

    def walk(at: int, end: int) -> None:
        while at + 8 <= end:
            name, size = struct.unpack_from("<4sI", data, at)
            if name == b"LIST":
                kind = data[at + 8 : at + 12]
                found[kind] = (at + 8, size)
                if kind != b"movi":
                    walk(at + 12, at + 8 + size)
            else:
                found.setdefault(name, (at + 8, size))
            at += 8 + size + (size & 1)

    walk(12, 8 + struct.unpack_from("<I", data, 4)[0])
    scale, rate = struct.unpack_from("<II", data, found[b"strh"][0] + 20)
    base, (at, size) = found[b"movi"][0], found[b"idx1"]
    frames = []
    for name, _, offset, length in struct.iter_unpack("<4sIII", data[at : at + size]):
        if name[2:] == b"dc":
            frames.append(data[base + offset + 8 : base + offset + 8 + length])
    return rate / scale, frames


def packed_of(frame: bytes) -> bytes | None:
    """The entropy-coded data of a frame with this module's own header, without byte stuffing; None for any other frame."""
    return frame[len(HEAD) : frame.rindex(TAIL)].replace(b"\xff\x00", b"\xff") if frame.startswith(HEAD) else None


def read_jpeg(frame: bytes) -> np.ndarray:
    """(rows, columns) of any lossless grey JPEG of 8 bits, by its own Huffman table and predictor. Others are an error."""
    if frame[:2] != b"\xff\xd8":
        raise ValueError("no JPEG frame")
    at, size, tables = 2, None, {}
    while True:
        mark, length = frame[at + 1], struct.unpack_from(">H", frame, at + 2)[0]
        body, at = frame[at + 4 : at + 2 + length], at + 2 + length
        if mark == 0xC3:
            bits, rows, columns, parts = struct.unpack_from(">BHHB", body)
            if bits != 8 or parts != 1:
                raise ValueError("only grey samples of 8 bits are read")
            size = rows, columns
        elif mark == 0xC4:
            while body:
                counts, values, code, table = body[1:17], body[17 : 17 + sum(body[1:17])], 0, {}
                name, body = body[0] & 15, body[17 + len(values) :]
                for width, n in enumerate(counts, 1):
                    for v in values[:n]:
                        table[width, code] = v
                        code += 1
                    values, code = values[n:], code << 1
                tables[name] = table
        elif mark == 0xDA:
            break
        elif 0xC0 <= mark <= 0xCF or (mark == 0xDD and any(body)):
            raise ValueError("only lossless JPEG without restarts is read")
    if size is None or body[0] != 1 or body[5] & 15 or not 1 <= body[3] <= 7 or body[2] >> 4 not in tables:
        raise ValueError("the scan isn't one of lossless grey JPEG")
    table, predictor = tables[body[2] >> 4], body[3]
    data = frame[at : frame.rindex(TAIL)].replace(b"\xff\x00", b"\xff")
    bits = np.unpackbits(np.frombuffer(data, np.uint8)).tolist()
    place, out = 0, [[0] * size[1] for _ in range(size[0])]

    def take(n: int) -> int:
        nonlocal place
        value = int("".join(map(str, bits[place : place + n])) or "0", 2)
        place += n
        return value

    for i in range(size[0]):
        for j in range(size[1]):
            width, code = 0, 0
            while (width, code) not in table:
                if width == 16:
                    raise ValueError("a code that the table doesn't have")
                width, code = width + 1, code << 1 | take(1)
            s = table[width, code]
            extra = 32768 if s == 16 else take(s)
            d = extra if not s or extra >> (s - 1) else extra - (1 << s) + 1
            left, above = out[i][j - 1], out[i - 1][j]
            if not i or not j:
                guess = left if j else above if i else 128
            else:
                corner = out[i - 1][j - 1]
                guess = (left, above, corner, left + above - corner, left + ((above - corner) >> 1), above + ((left - corner) >> 1), (left + above) >> 1)[predictor - 1]
            out[i][j] = (guess + d) & 255
    return np.array(out, np.uint8)


def encode(payloads: list[bytes]) -> list[bytes]:
    """An AVI file for each payload, whose length is a multiple of 576."""
    packed = pack_frames(np.frombuffer(b"".join(payloads), np.uint8))
    counts = np.cumsum([0, *[len(p) // FRAME for p in payloads]])
    stuffed = np.cumsum([0, *(packed == 255).sum(1)]) + np.arange(len(packed) + 1) * PACKED
    flat = packed.ravel()
    body = np.insert(flat, np.flatnonzero(flat == 255) + 1, 0).tobytes()
    ends = stuffed.tolist()
    jpegs = [HEAD + body[a:b] + TAIL for a, b in zip(ends[:-1], ends[1:], strict=True)]
    return [write_avi(jpegs[a:b]) for a, b in zip(counts[:-1], counts[1:], strict=True)]


def decode(files: list[bytes]) -> tuple[list[float], list[np.ndarray]]:
    """Frames a second of each file, and its samples, a row for each frame. Frames of this module's header go in batches."""
    rates, frames = zip(*map(read_avi, files), strict=True) if files else ((), ())
    packed = [[packed_of(j) for j in f] for f in frames]
    own = [None not in p for p in packed]
    samples = unpack_frames(np.frombuffer(b"".join(j for p, ok in zip(packed, own, strict=True) if ok for j in p), np.uint8))
    ends = np.cumsum([0, *[len(p) * ok for p, ok in zip(packed, own, strict=True)]])
    return list(rates), [samples[a:b] if ok else np.stack([read_jpeg(j).ravel() for j in f]) for f, ok, a, b in zip(frames, own, ends[:-1], ends[1:], strict=True)]


def shots(samples: np.ndarray, reach: int = 12, factor: float = 2.0, floor: float = 0.1) -> list[tuple[int, int]]:
    """Half-open frame ranges of the shots.

    A cut stands before a frame whose histogram differs from the one before it (half the L1 distance, of 1) by more than
    floor and by more than the mean plus factor deviations of the differences up to reach frames away.
    """
    n = len(samples)
    if n < 2:
        return [(0, n)] if n else []
    hist = np.bincount((np.arange(n)[:, None] * BINS + (samples >> 4)).ravel(), minlength=n * BINS).reshape(n, BINS)
    d = np.abs(np.diff(hist, axis=0)).sum(1) / (2 * samples.shape[1])
    one, two = np.concatenate([[0], np.cumsum(d)]), np.concatenate([[0], np.cumsum(d * d)])
    lo, hi = np.maximum(np.arange(n - 1) - reach, 0), np.minimum(np.arange(n - 1) + reach + 1, n - 1)
    mean = (one[hi] - one[lo]) / (hi - lo)
    deviation = np.sqrt(np.maximum((two[hi] - two[lo]) / (hi - lo) - mean * mean, 0))
    cuts = (np.flatnonzero((d > floor) & (d > mean + factor * deviation)) + 1).tolist()
    return list(zip([0, *cuts], [*cuts, n], strict=True))


def payload_of(text: str) -> tuple[bytes, int]:
    """UTF-8 and bytes 255 up to a positive multiple of 576; the length without them."""
    raw = text.encode("utf-8", "surrogatepass")
    return raw + b"\xff" * ((-len(raw)) % FRAME or (0 if raw else FRAME)), len(raw)


def batches_of(batch: pa.RecordBatch, most: int = 4 << 20) -> Iterator[tuple[list, list[str]]]:
    """Keys and texts in groups of about most characters, so memory is bounded by that and the longest text."""
    keys, texts, size = [], [], 0
    for k, t in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
        keys.append(k)
        texts.append(t)
        size += len(t)
        if size > most:
            yield keys, texts
            keys, texts, size = [], [], 0
    if keys:
        yield keys, texts


def to_media(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes and media, an AVI file of each text. Null text: empty; every row is kept, repeated or not."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for keys, texts in batches_of(batch):
                payloads, sizes = zip(*map(payload_of, texts), strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(sizes, pa.int64()), pa.array(encode(list(payloads)), pa.binary())], ["doc_id", "n_bytes", "media"])

    return docs.select("doc_id", text_of().alias("text")).mapInArrow(run, "doc_id long, n_bytes long, media binary")


def clips(media: DataFrame) -> DataFrame:
    """A row for each shot of each AVI file in media: doc_id, clip, first_frame, end_frame, start_ms and end_ms."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for key, file in zip(batch.column("doc_id").to_pylist(), batch.column("media").to_pylist(), strict=True):
                (rate,), (samples,) = decode([file])
                rows += [(key, i, a, b, round(a * 1000 / rate), round(b * 1000 / rate)) for i, (a, b) in enumerate(shots(samples))]
            cols = zip(*rows, strict=True) if rows else [[]] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in cols], ["doc_id", "clip", "first_frame", "end_frame", "start_ms", "end_ms"])

    return media.mapInArrow(run, "doc_id long, clip long, first_frame long, end_frame long, start_ms long, end_ms long")


def features(media: DataFrame) -> DataFrame:
    """Decodes each file of media (doc_id, n_bytes, media) and sums it up; feature lists the shots as start-end in ms."""
    names = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, sizes, media = (batch.column(n) for n in ("doc_id", "n_bytes", "media"))
            for lo in range(0, batch.num_rows, 64):
                files, rows = media[lo : lo + 64].to_pylist(), []
                for key, size, file, rate, samples in zip(keys[lo : lo + 64].to_pylist(), sizes[lo : lo + 64].to_pylist(), files, *decode(files), strict=True):
                    raw = samples.tobytes()
                    feature = ",".join(f"{round(a * 1000 / rate)}-{round(b * 1000 / rate)}" for a, b in shots(samples))
                    rows.append((key, size, len(raw), hashlib.sha256(raw).hexdigest(), zlib.crc32(raw[-32:]), len(file), hashlib.sha256(file).hexdigest(), feature))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return media.mapInArrow(run, "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string")


def digests(docs: DataFrame) -> DataFrame:
    """features of the media column that to_media makes of each text."""
    return features(to_media(docs))
