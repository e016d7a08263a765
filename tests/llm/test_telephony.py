import hashlib
import random
import zlib

import numpy as np

from tessera.llm import telephony as t


def test_tables():
    # fixed points of the two codings
    assert t.MULAW[0] == -32124 and t.MULAW[0x7F] == 0 and t.MULAW[0x80] == 32124 and t.MULAW[0xFF] == 0 and t.MULAW[0xF0] == 120
    assert t.ALAW[0x55] == -8 and t.ALAW[0xD5] == 8 and t.ALAW[0x2A] == -32256 and t.ALAW[0xAA] == 32256
    assert (np.diff(t.MULAW[:128].astype(int)) > 0).all() and (t.MULAW[128:] == -t.MULAW[:128]).all()


def test_adpcm_equals_one_block_at_a_time():
    rng = np.random.default_rng(1)
    blocks = rng.integers(0, 256, (7, t.BLOCK), np.uint8)
    got = t.adpcm(blocks)
    for b, out in zip(blocks, got, strict=True):
        value, place = int(np.frombuffer(b[:2].tobytes(), "<i2")[0]), min(int(b[2]), 88)
        want = [value]
        for byte in b[4:].tolist():
            for code in (byte & 15, byte >> 4):
                step = int(t.STEPS[place])
                change = (step >> 3) + (step if code & 4 else 0) + ((step >> 1) if code & 2 else 0) + ((step >> 2) if code & 1 else 0)
                value = max(-32768, min(32767, value - change if code & 8 else value + change))
                place = max(0, min(88, place + int(t.MOVES[code & 7])))
                want.append(value)
        assert out.tolist() == want


def test_wav_round_trip():
    for codec in t.CODECS:
        for n in (1, 3):
            payload = random.Random(n).randbytes(t.BLOCK * n)
            assert t.unwav(t.wav(payload, codec)) == (codec, payload)
    assert t.resample(np.array([1, 3, -5, -6, 9], np.int16)).tolist() == [2, -6, 9]


def test_described(docs, clash, odd):
    rows = [(1, "text " * 200), (2, "text " * 200), (3, None), (4, ""), (5, "é" * 288), (6, "b"), (7, "c"), (8, "d")]
    media = t.store(clash(docs(rows)))
    got = {r.doc_id: r for r in t.described(media).collect()}
    for d, text in rows:
        raw = (text or "").encode()
        payload = raw + b"\xff" * (-len(raw) % 576 or 576 * (not raw))
        r = got[d]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]))
    assert got[1].feature == got[2].feature and got[1].media_sha256 == got[2].media_sha256
    assert len({r.feature.split(";")[0] for r in got.values()}) > 1
    sounds = {r.doc_id: r for r in t.pcm(media).collect()}
    assert all(len(sounds[d].pcm) == 2 * int(got[d].feature.split(";")[1]) and sounds[d].rate == 4000 for d, _ in rows)
    assert t.described(t.store(odd)).count() == 9 and t.described(t.store(docs([]))).count() == 0
