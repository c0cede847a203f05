"""Media columns: telephony audio (operator 7).

``store`` keeps byte payloads losslessly as 8-bit companded samples in a WAV
container; ``read`` reads such a column back and gives features and, to be stored,
the sound as resampled 16-bit PCM.  Mu-law and A-law go through 256-entry tables made from the G.711
rule; IMA ADPCM is decoded step by step over all blocks of a batch at once, so
numpy's width is the number of blocks.

Nulls and empty values count as an empty payload, which is padded to one frame.
Rows that repeat give equal values; other columns of the input are not read.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ripple.llm.common import fields, lean, quote, slices, small_batches

FRAME = 576
RATE, RATE_OUT = 8000, 16000
MULAW, ALAW, ADPCM = 7, 6, 17  # format tags of RIFF WAVE

# The step sizes and index changes of the IMA ADPCM format.
IMA_STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118, 130, 143,
    157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166, 1282, 1411, 1552,
    1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845, 8630, 9493, 10442, 11487,
    12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], dtype=np.int32)
IMA_INDEX = np.array([-1, -1, -1, -1, 2, 4, 6, 8], dtype=np.int32)


def mulaw_table() -> np.ndarray:
    """G.711 mu-law: byte to 16-bit sample."""
    code = ~np.arange(256, dtype=np.int32) & 0xFF
    size = (((code & 0x0F) << 3) + 0x84 << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


def alaw_table() -> np.ndarray:
    """G.711 A-law: byte to 16-bit sample."""
    code = np.arange(256, dtype=np.int32) ^ 0x55
    segment = (code >> 4) & 7
    size = ((code & 0x0F) << 4) + 8
    size = np.where(segment > 0, (size + 0x100) << np.maximum(segment - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def adpcm_blocks(blocks: np.ndarray) -> np.ndarray:
    """Decode IMA ADPCM mono blocks, one a row of bytes, to 16-bit samples.

    A block is a little-endian 16-bit first sample, a step index (held to
    0..88), a spare byte and nibbles, the low one first.
    """
    head = blocks[:, :4].astype(np.int32)
    value = ((head[:, 0] | head[:, 1] << 8) ^ 0x8000) - 0x8000
    index = np.minimum(head[:, 2], 88)
    body = np.ascontiguousarray(blocks[:, 4:].T)
    out = np.empty((1 + 2 * len(body), len(blocks)), dtype=np.int16)
    out[0] = value
    for k in range(2 * len(body)):
        nibble = (body[k >> 1] >> (4 * (k & 1))) & 15
        step = IMA_STEPS[index]
        change = (step >> 3) + (step >> 2) * (nibble & 1) + (step >> 1) * ((nibble >> 1) & 1) + step * ((nibble >> 2) & 1)
        value = np.clip(np.where(nibble & 8, value - change, value + change), -32768, 32767)
        index = np.clip(index + IMA_INDEX[nibble & 7], 0, 88)
        out[k + 1] = value
    return out.T


def resample(pcm: np.ndarray, rate: int, to: int) -> np.ndarray:
    """Linear interpolation in whole numbers; the last sample is held."""
    if not len(pcm):
        return pcm
    if to == 2 * rate:
        out = np.empty(2 * len(pcm), dtype=np.int16)
        out[::2] = pcm
        out[1:-1:2] = (pcm[:-1].astype(np.int32) + pcm[1:]) >> 1
        out[-1] = pcm[-1]
        return out
    at = np.arange(len(pcm) * to // rate, dtype=np.int64) * rate
    left, part = at // to, at % to
    right = np.minimum(left + 1, len(pcm) - 1)
    return ((pcm[left].astype(np.int64) * (to - part) + pcm[right].astype(np.int64) * part) // to).astype(np.int16)


def wav(payload: bytes, tag: int = MULAW, rate: int = RATE) -> bytes:
    """A mono WAV file that holds ``payload`` as its samples (or ADPCM blocks), unchanged."""
    if tag == ADPCM:
        per_block = 2 * (FRAME - 4) + 1
        fmt = struct.pack("<HHIIHHHH", tag, 1, rate, rate * FRAME // per_block, FRAME, 4, 2, per_block)
        samples = len(payload) // FRAME * per_block
    else:
        fmt = struct.pack("<HHIIHHH", tag, 1, rate, rate, 1, 8, 0)
        samples = len(payload)
    fact = struct.pack("<I", samples)
    chunks = b"".join(k + struct.pack("<I", len(v)) + v + b"\0" * (len(v) & 1) for k, v in ((b"fmt ", fmt), (b"fact", fact), (b"data", payload)))
    return b"RIFF" + struct.pack("<I", 4 + len(chunks)) + b"WAVE" + chunks


def unwav(media: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, samples or blocks) of a file made by ``wav``; ValueError for anything else."""
    if media[:4] != b"RIFF" or media[8:12] != b"WAVE":
        raise ValueError("not a RIFF WAVE file")
    at, tag, rate = 12, 0, 0
    while at + 8 <= len(media):
        kind, size = media[at : at + 4], struct.unpack_from("<I", media, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", media, at + 8)
        elif kind == b"data":
            return tag, rate, media[at + 8 : at + 8 + size]
        at += 8 + size + (size & 1)
    raise ValueError("no data chunk")


_TABLES = {MULAW: mulaw_table(), ALAW: alaw_table()}


def decode(media: bytes) -> tuple[int, np.ndarray]:
    """(rate, 16-bit samples) of a mu-law, A-law or IMA ADPCM file."""
    tag, rate, data = unwav(media)
    raw = np.frombuffer(data, np.uint8)
    if tag in _TABLES:
        return rate, _TABLES[tag][raw]
    if tag == ADPCM:
        return rate, adpcm_blocks(raw[: len(raw) // FRAME * FRAME].reshape(-1, FRAME)).ravel()
    raise ValueError(f"unknown format tag {tag}")


def store(docs: DataFrame, key: str, payload: str, tag: int = MULAW) -> DataFrame:
    """Store a string or binary column as audio: (key, n_bytes, media).

    The bytes, padded with 255 to a positive multiple of 576, are the samples of
    a WAV file (for ADPCM its blocks), so that nothing is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "payload"):
            raw = batch.column("payload").fill_null(b"").to_pylist()
            files = [wav(x + b"\xff" * (-len(x) % FRAME if x else FRAME), tag) for x in raw]
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array([len(x) for x in raw], pa.int64()), pa.array(files, pa.binary())], names=[key, "n_bytes", "media"])

    small_batches(docs.sparkSession)
    kinds = fields(**{key: docs.schema[key].dataType, "n_bytes": "long", "media": "binary"})
    return docs.select(F.col(quote(key)).alias("key"), F.col(quote(payload)).cast("binary").alias("payload")).mapInArrow(lean(run), kinds)


def _stats(pcm: np.ndarray, starts: np.ndarray, counts: np.ndarray) -> list[np.ndarray]:
    """For each stretch: root mean square, peak, and number of sign changes."""
    wide = pcm.astype(np.int64)
    rms = np.sqrt(np.add.reduceat(wide * wide, starts) / counts)
    peak = np.maximum.reduceat(np.abs(wide), starts)
    sign = pcm < 0
    flips = np.empty(len(pcm), dtype=np.int64)
    flips[1:] = sign[1:] != sign[:-1]
    flips[starts] = 0
    return [rms, peak, np.add.reduceat(flips, starts)]


def features(payloads: Sequence[bytes]) -> tuple[list[str], list[np.ndarray]]:
    """Features of 8-bit payloads (each a positive multiple of 576 bytes), as text; and the mu-law signals, resampled.

    The bytes are expanded by either law and decoded as ADPCM blocks; each
    signal gives root mean square, peak and sign changes, and the mu-law signal
    resampled to 16 kHz its number of samples and checksum.
    """
    counts = np.array([len(x) for x in payloads], dtype=np.int64)
    starts = np.cumsum(counts) - counts
    raw = np.frombuffer(b"".join(payloads), np.uint8)
    mu = _TABLES[MULAW][raw]
    parts = [_stats(mu, starts, counts), _stats(_TABLES[ALAW][raw], starts, counts)]
    blocks = adpcm_blocks(raw.reshape(-1, FRAME))
    parts.append(_stats(blocks.ravel(), starts // FRAME * blocks.shape[1], counts // FRAME * blocks.shape[1]))
    out, sounds = [], [resample(mu[a : a + n], RATE, RATE_OUT) for a, n in zip(starts.tolist(), counts.tolist(), strict=True)]
    for i, pcm in enumerate(sounds):
        said = [f"{name}:rms={p[0][i]:.2f},peak={p[1][i]},flips={p[2][i]}" for name, p in zip(("mulaw", "alaw", "adpcm"), parts, strict=True)]
        out.append(";".join([*said, f"pcm16k:n={len(pcm)},crc={zlib.crc32(pcm):08x}"]))
    return out, sounds


def read(stored: DataFrame, key: str, media: str = "media", pcm: bool = False) -> DataFrame:
    """Read a stored column back: payload digests, media digests and features; with ``pcm`` also the resampled 16-bit samples."""
    extra = [f"pcm{RATE_OUT // 1000}k"] if pcm else []

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "media"):
            files = batch.column("media").to_pylist()
            tags, rates, payloads = zip(*map(unwav, files), strict=True)
            said, sounds = features(payloads)
            columns = [
                batch.column("key"),
                batch.column("n_bytes"),
                pa.array([len(x) for x in payloads], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in payloads]),
                pa.array([zlib.crc32(x[-32:]) for x in payloads], pa.int64()),
                pa.array([len(x) for x in files], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in files]),
                pa.array(said),
            ]
            if pcm:  # what was read as mu-law above is there already
                for i, (tag, rate) in enumerate(zip(tags, rates, strict=True)):
                    if (tag, rate) != (MULAW, RATE):
                        sounds[i] = resample(decode(files[i])[1], rate, RATE_OUT)
                columns.append(pa.array([x.tobytes() for x in sounds], pa.binary()))
            yield pa.RecordBatch.from_arrays(columns, names=[key, "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature", *extra])

    kinds = {key: stored.schema[key].dataType, "n_bytes": "long", "payload_bytes": "long", "payload_sha256": "string", "tail_crc32": "long", "media_bytes": "long", "media_sha256": "string", "feature": "string"}
    return stored.select(F.col(quote(key)).alias("key"), "n_bytes", F.col(quote(media)).alias("media")).mapInArrow(lean(run), fields(**kinds, **{x: "binary" for x in extra}))
