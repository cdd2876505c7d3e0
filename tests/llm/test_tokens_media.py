import hashlib
import random
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tickloom.llm import media_avi, token_store
from tickloom.llm.fast_encode import encoder

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["", " ", "a", "a b", "a  b\n\nc ", " x   y z", "it's 's  's\t\n 12 345!?", "<|endoftext|> a <|endoftext|>b", "\x1c!\x1cb \x85c", "é́ß 漢字 😀😀", None, "x" * 5000 + " " * 300 + "1" * 2000, "a b", "\r\n\r\n a"]


TEXTS += ["it's_x Ünd,ßx2 a²b c½ d.e\u0301f don't I'LL", "naïve\u0394x,y", "a,b\n,c\td ,e", "a" * 200 + ", " + "!" * 100]


def rows(spark, extra=()):
    return spark.createDataFrame([(i, t, "z") for i, t in enumerate(TEXTS)] + list(extra), "doc_id long, text string, ids string")


def test_pieces_encode_as_whole_texts():
    own, whole = encoder(PATH), Tokenizer.from_file(PATH)
    texts = [t or "" for t in TEXTS]
    for t, got in zip(texts, own.encode(texts), strict=True):
        assert np.frombuffer(got, own.dtype).tolist() == whole.encode(t, add_special_tokens=False).ids


def test_pieces_that_leave_the_cache_encode_the_same(monkeypatch):
    from tickloom.llm import fast_encode

    monkeypatch.setattr(fast_encode, "MOST_CACHED", 3)
    own, whole = fast_encode.PieceEncoder(PATH), Tokenizer.from_file(PATH)
    for batch in (["a b c d"], ["e f a b"], [], ["", "g a"], ["b c " + "z" * 99]):
        assert [np.frombuffer(x, own.dtype).tolist() for x in own.encode(batch)] == [whole.encode(t, add_special_tokens=False).ids for t in batch]


def test_store_round_trip(spark):
    docs = rows(spark, [(3, "a b", "y"), (None, "n", None)])
    path = token_store.write_store(docs, PATH, end_id=2)
    got = sorted(token_store.read_store(spark, path, digest=True).collect(), key=lambda r: r.start)
    whole = Tokenizer.from_file(PATH)
    want, start = [], 0
    for key, text in sorted([(-1, "n"), (3, "a b"), *enumerate(TEXTS)], key=lambda r: (r[0], r[1] or "")):
        ids = [*whole.encode(text or "", add_special_tokens=False).ids, 2]
        want.append((None if key < 0 else key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert [tuple(r) for r in got] == want
    ids = {r.doc_id: np.frombuffer(r.ids, "<u2").tolist() for r in token_store.read_store(spark, path).where("doc_id > 3").collect()}
    assert ids[5] == [*whole.encode(TEXTS[5], add_special_tokens=False).ids, 2]
    few = token_store.read_store(spark, path, [5, 11]).collect()
    assert sorted(r.doc_id for r in few) == [5, 11] and token_store.read_store(spark, path, [99]).count() == 0
    empty = token_store.write_store(docs.limit(0), PATH, end_id=2)
    assert token_store.read_store(spark, empty).count() == 0


def test_frames_are_lossless():
    rng = np.random.default_rng(1)
    parts = [rng.integers(0, 256, 576 * 5, dtype=np.uint8).tobytes(), b"\xff" * 576, b"\x00\xff" * 288, bytes(range(256)) * 9]
    files = media_avi.encode(parts)
    _, samples = media_avi.decode(files)
    assert [s.tobytes() for s in samples] == parts
    assert files[0][:4] == b"RIFF" and media_avi.read_avi(files[1])[1][0][:2] == b"\xff\xd8"


def test_shots():
    dark, light = np.full((20, 576), 10, np.uint8), np.full((15, 576), 200, np.uint8)
    assert media_avi.shots(np.concatenate([dark, light])) == [(0, 20), (20, 35)]
    assert media_avi.shots(dark) == [(0, 20)] and media_avi.shots(dark[:0]) == []


def test_media_rows(spark):
    docs = rows(spark, [(None, "a b", None)])
    got = {(r.doc_id, r.payload_sha256): r for r in media_avi.digests(docs).collect()}
    assert len(got) == len(TEXTS) + 1
    for i, t in enumerate(TEXTS):
        raw = (t or "").encode()
        pad = raw + b"\xff" * (576 if not raw else -len(raw) % 576)
        r = got[i, hashlib.sha256(pad).hexdigest()]
        assert (r.n_bytes, r.payload_bytes, r.tail_crc32) == (len(raw), len(pad), zlib.crc32(pad[-32:]))
    media = media_avi.to_media(docs)
    assert media_avi.clips(media).where("doc_id = 11").count() >= 1
    assert media_avi.digests(docs.limit(0)).count() == 0 and media_avi.clips(media.limit(0)).count() == 0


def lossless_jpeg(image, predictor):
    """A frame by another encoder: four-bit codes for all categories, and any predictor."""
    bits = ""
    for i, row in enumerate(image):
        for j, v in enumerate(row):
            left, above, corner = row[j - 1], image[i - 1][j], image[i - 1][j - 1]
            if not i or not j:
                guess = left if j else above if i else 128
            else:
                guess = {1: left, 2: above, 3: corner, 4: left + above - corner, 5: left + (above - corner) // 2, 6: above + (left - corner) // 2, 7: (left + above) // 2}[predictor]
            d = v - guess
            s = abs(d).bit_length()
            bits += f"{s:04b}" + (f"{d if d > 0 else d + 2**s - 1:0{s}b}" if s else "")
    bits += "1" * (-len(bits) % 8)
    data = int(bits, 2).to_bytes(len(bits) // 8, "big").replace(b"\xff", b"\xff\x00")
    table = bytes([0, 0, 0, 0, 10, *[0] * 12, *range(10)])
    frame = struct.pack(">BHHBBBB", 8, len(image), len(image[0]), 1, 1, 0x11, 0)
    segment = lambda mark, body: struct.pack(">BBH", 0xFF, mark, len(body) + 2) + body
    return b"\xff\xd8" + segment(0xFE, b"note") + segment(0xC3, frame) + segment(0xC4, table) + segment(0xDA, bytes([1, 1, 0, predictor, 0, 0])) + data + b"\xff\xd9"


def test_frames_of_another_encoder():
    rng = random.Random(2)
    for predictor in range(1, 8):
        image = [[rng.choice([0, 255, 7, 128, rng.randrange(256)]) for _ in range(11)] for _ in range(9)]
        file = media_avi.write_avi([lossless_jpeg(image, predictor)] * 2)
        (_,), (samples,) = media_avi.decode([file])
        assert samples.tolist() == [[v for row in image for v in row]] * 2
    (_,), (own,) = media_avi.decode(media_avi.encode([bytes(range(256)) * 9]))
    read = [media_avi.read_jpeg(f).ravel().tolist() for f in media_avi.read_avi(media_avi.encode([bytes(range(256)) * 9])[0])[1]]
    assert read == own.tolist()
    frame = lossless_jpeg([[1]], 1)
    for bad in (frame.replace(b"\xff\xc3", b"\xff\xc0"), b"no frame", frame.replace(b"\xff\xc3\x00\x0b\x08", b"\xff\xc3\x00\x0b\x0c")):
        with pytest.raises(ValueError):
            media_avi.read_jpeg(bad)


def test_shots_against_plain_loops():
    rng = random.Random(6)
    frames = [[rng.choice(part) for _ in range(576)] for part in ([10, 20], [200, 210, 250], [10, 90]) for _ in range(15)]
    hist = [[sum(v >> 4 == b for v in f) for b in range(16)] for f in frames]
    d = [sum(abs(a - b) for a, b in zip(x, y, strict=True)) / 1152 for x, y in zip(hist[:-1], hist[1:], strict=True)]
    cuts = []
    for i, x in enumerate(d):
        near = d[max(0, i - 12) : i + 13]
        mean = sum(near) / len(near)
        deviation = (sum(v * v for v in near) / len(near) - mean**2) ** 0.5
        if x > 0.1 and x > mean + 2 * deviation:
            cuts.append(i + 1)
    assert cuts == [15, 30]
    assert media_avi.shots(np.array(frames, np.uint8)) == list(zip([0, *cuts], [*cuts, 45], strict=True))
