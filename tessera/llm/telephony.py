"""Media columns: telephony audio.

Payloads are kept byte for byte as the samples of WAV files in one of three telephony codings: mu-law and A-law (expanded
by lookup tables) and IMA ADPCM (blocks of BLOCK bytes, decoded with numpy across all blocks at once). Decoded sound is
16-bit PCM, resampled to half the rate by the mean of each two samples and stored too; features come from the stored sound.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import steps, table, written

BLOCK = 576
PAD = b"\xff"
RATE = 8000
#: WAV format tags.
TAGS = {"alaw": 6, "mulaw": 7, "adpcm": 17}
CODECS = ["mulaw", "alaw", "adpcm"]
SAMPLES = 2 * (BLOCK - 4) + 1  # of an ADPCM block
# fixed values of IMA ADPCM: quantizer steps, and how a code moves the place among them
STEPS = np.array([7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


def _mulaw() -> np.ndarray:
    code = ~np.arange(256) & 255
    size = (((code & 15) << 3) + 132 << ((code >> 4) & 7)) - 132
    return np.where(code & 128, -size, size).astype(np.int16)


def _alaw() -> np.ndarray:
    code = np.arange(256) ^ 0x55
    part, low = (code >> 4) & 7, (code & 15) << 4
    size = np.where(part == 0, low + 8, (low + 264) << np.maximum(part - 1, 0))
    return np.where(code & 128, size, -size).astype(np.int16)


MULAW, ALAW = _mulaw(), _alaw()


def adpcm(blocks: np.ndarray) -> np.ndarray:
    """(blocks, BLOCK) bytes -> (blocks, SAMPLES) PCM. One step handles a sample of every block; places beyond the table count as its ends."""
    head = blocks[:, :4]
    value = np.ascontiguousarray(head[:, :2]).view("<i2")[:, 0].astype(np.int32)
    place = np.minimum(head[:, 2].astype(np.int32), len(STEPS) - 1)
    codes = np.empty((2 * (blocks.shape[1] - 4), len(blocks)), np.uint8)
    codes[0::2], codes[1::2] = (blocks[:, 4:] & 15).T, (blocks[:, 4:] >> 4).T
    out = np.empty((len(codes) + 1, len(blocks)), np.int16)
    out[0] = value
    for k, code in enumerate(codes, 1):
        step, size = STEPS[place], code & 7
        change = (step >> 3) + np.where(code & 4, step, 0) + np.where(code & 2, step >> 1, 0) + np.where(code & 1, step >> 2, 0)
        value = np.clip(np.where(code & 8, value - change, value + change), -32768, 32767)
        place = np.clip(place + MOVES[size], 0, len(STEPS) - 1)
        out[k] = value
    return np.ascontiguousarray(out.T)


def wav(payload: bytes, codec: str) -> bytes:
    bits, align, samples = (4, BLOCK, len(payload) // BLOCK * SAMPLES) if codec == "adpcm" else (8, 1, len(payload))
    form = struct.pack("<HHIIHHHH", TAGS[codec], 1, RATE, RATE * align // (SAMPLES if codec == "adpcm" else 1), align, bits, 2, SAMPLES if codec == "adpcm" else 1)
    body = b"WAVE" + b"fmt " + struct.pack("<I", len(form)) + form + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(payload)) + payload
    return b"RIFF" + struct.pack("<I", len(body)) + body


def unwav(media: bytes) -> tuple[str, bytes]:
    """Codec and payload of a WAV file."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE" or struct.unpack_from("<I", media, 4)[0] != len(media) - 8:
        raise ValueError("not a whole WAV file")
    at, codec, payload = 12, "", None
    while at + 8 <= len(media):
        name, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if name == b"fmt ":
            tag = struct.unpack_from("<H", media, at + 8)[0]
            codec = next(k for k, v in TAGS.items() if v == tag)
        elif name == b"data":
            payload = media[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    if payload is None:
        raise ValueError("a WAV file without data")
    return codec, payload


def decode(codec: str, payloads: list[bytes]) -> list[np.ndarray]:
    """PCM of each payload of one coding, all in one go."""
    data = np.frombuffer(b"".join(payloads), np.uint8)
    if codec == "adpcm":
        sound, cut = adpcm(data.reshape(-1, BLOCK)).ravel(), [len(p) // BLOCK * SAMPLES for p in payloads]
    else:
        sound, cut = (MULAW if codec == "mulaw" else ALAW)[data], [len(p) for p in payloads]
    return np.split(sound, np.cumsum(cut)[:-1])


def resample(sound: np.ndarray) -> np.ndarray:
    """Half the rate: the mean of each two samples, down; an odd last one stays."""
    even = sound[: len(sound) // 2 * 2].astype(np.int32).reshape(-1, 2).sum(axis=1) >> 1
    return np.append(even, sound[len(even) * 2 :]).astype(np.int16)


def feature(codec: str, sound: np.ndarray) -> str:
    """Of resampled PCM: coding, samples, peak, root mean square, sign changes, CRC-32 of the samples."""
    wide = sound.astype(np.int64)
    power = int(np.sqrt((wide * wide).sum() / max(1, len(wide))))
    changes = int(np.count_nonzero(np.diff(np.signbit(sound))))
    return f"{codec};{len(sound)};{int(np.abs(wide).max(initial=0))};{power};{changes};{zlib.crc32(sound.astype('<i2').tobytes())}"


#: Compression of stored media and sound: sound packs less well at the usual level.
LEVEL = {"parquet.compression.codec.zstd.level": "9"}


def store(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media: each whole text's bytes (null: none), padded with 255 to whole blocks, in a coding that the payload's CRC-32 picks."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches):
            out = []
            for text in batch.column("text").cast(pa.binary()).to_pylist():
                raw = text or b""
                payload = raw + PAD * (-len(raw) % BLOCK or BLOCK * (not raw))
                out.append((len(raw), wav(payload, CODECS[zlib.crc32(payload) % 3])))
            n, media = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(media, pa.binary())], ["doc_id", "n_bytes", "media"])

    return written(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").mapInArrow(run, "doc_id bigint, n_bytes bigint, media binary"), **LEVEL)


def _sounds(batch: pa.RecordBatch) -> tuple[list[str], list[bytes], list[np.ndarray]]:
    codecs, payloads = zip(*map(unwav, batch.column("media").to_pylist()), strict=True)
    sounds: list = [None] * len(codecs)
    for codec in set(codecs):
        own = [i for i, c in enumerate(codecs) if c == codec]
        for i, s in zip(own, decode(codec, [payloads[i] for i in own]), strict=True):
            sounds[i] = resample(s)
    return list(codecs), list(payloads), sounds


def pcm(media: DataFrame) -> DataFrame:
    """The stored media's resampled sound as a table: doc_id, codec, rate, pcm (16-bit little-endian), and of the media's bytes
    n_bytes, payload_bytes, payload_sha256, tail_crc32, media_bytes, media_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "media", 2 << 20):
            codecs, payloads, sounds = _sounds(batch)
            files = batch.column("media").to_pylist()
            sha = lambda x: pa.array([hashlib.sha256(y).digest() for y in x], pa.binary())
            columns = [batch.column("doc_id"), pa.array(codecs), pa.array([RATE // 2] * len(files), pa.int32()), pa.array([s.astype("<i2").tobytes() for s in sounds], pa.binary())]
            columns += [batch.column("n_bytes"), pa.array([len(p) for p in payloads], pa.int64()), sha(payloads), pa.array([zlib.crc32(p[-32:]) for p in payloads], pa.int64()), pa.array([len(f) for f in files], pa.int64()), sha(files)]
            yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    schema = "doc_id bigint, codec string, rate int, pcm binary, n_bytes bigint, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary"
    return written(media.select("doc_id", "n_bytes", "media").mapInArrow(run, schema), **LEVEL)


def described(media: DataFrame) -> DataFrame:
    """Digests of stored media, and features of their resampled sound, which is stored and read back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in steps(batches, "pcm", 2 << 20):
            sounds = [np.frombuffer(s, "<i2") for s in batch.column("pcm").to_pylist()]
            said = pa.array(list(map(feature, batch.column("codec").to_pylist(), sounds)))
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in same), said], [*same, "feature"])

    same = ["doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256"]
    out = pcm(media).mapInArrow(run, "doc_id bigint, n_bytes bigint, payload_bytes bigint, payload_sha256 binary, tail_crc32 bigint, media_bytes bigint, media_sha256 binary, feature string")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")})


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows that repeat a doc_id each have their own row; a null doc_id stays null."""
    return described(store(table(spark, sf_dir, "documents")))
