"""Telephony audio columns: 8-bit samples in a container, expanded to PCM."""

from __future__ import annotations

import hashlib
import struct
import zlib
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame

from fluxlens.llm.common import by_texts, texts_of

#: Payloads are padded with spaces to a positive multiple of this.
UNIT_BYTES = 192
#: Bytes of an ADPCM block: a header of four and two samples in each other byte.
BLOCK_BYTES = 192
MU_LAW, A_LAW, ADPCM, PCM = 7, 6, 17, 1

# Fixed values of the IMA ADPCM format: quantiser steps, and how a code moves the step.
STEPS = np.array([
    7, 8, 9, 10, 11, 12, 13, 14, 16, 17, 19, 21, 23, 25, 28, 31, 34, 37, 41, 45, 50, 55, 60, 66, 73, 80, 88, 97, 107, 118,
    130, 143, 157, 173, 190, 209, 230, 253, 279, 307, 337, 371, 408, 449, 494, 544, 598, 658, 724, 796, 876, 963, 1060, 1166,
    1282, 1411, 1552, 1707, 1878, 2066, 2272, 2499, 2749, 3024, 3327, 3660, 4026, 4428, 4871, 5358, 5894, 6484, 7132, 7845,
    8630, 9493, 10442, 11487, 12635, 13899, 15289, 16818, 18500, 20350, 22385, 24623, 27086, 29794, 32767,
], np.int32)
MOVES = np.array([-1, -1, -1, -1, 2, 4, 6, 8], np.int32)


@lru_cache(maxsize=1)
def mu_law_table() -> np.ndarray:
    """16-bit value of each mu-law code: sign, three bits of exponent, four of mantissa, all inverted."""
    code = 255 - np.arange(256)
    size = ((((code & 15) << 3) + 0x84) << ((code >> 4) & 7)) - 0x84
    return np.where(code & 0x80, -size, size).astype(np.int16)


@lru_cache(maxsize=1)
def a_law_table() -> np.ndarray:
    """16-bit value of each A-law code; even bits are inverted."""
    code = np.arange(256) ^ 0x55
    exponent, size = (code >> 4) & 7, ((code & 15) << 4) + 8
    size = np.where(exponent > 0, (size + 0x100) << np.maximum(exponent - 1, 0), size)
    return np.where(code & 0x80, size, -size).astype(np.int16)


def decode_adpcm(blocks: np.ndarray) -> np.ndarray:
    """Decodes IMA ADPCM blocks (one row of bytes each) to rows of 16-bit samples.

    All blocks advance together, a code at a time.  Step numbers over 88 in a
    header, which no encoder writes, count as 88.
    """
    value = (blocks[:, 0].astype(np.int32) | blocks[:, 1].astype(np.int32) << 8).astype(np.uint16).view(np.int16).astype(np.int32)
    at = np.minimum(blocks[:, 2].astype(np.int32), 88)
    data = blocks[:, 4:]
    out = np.empty((1 + 2 * data.shape[1], len(blocks)), np.int16)
    out[0] = value
    columns = np.ascontiguousarray(data.T)
    # What a code adds, by step and code; where it leads.
    codes, steps = np.arange(16), STEPS[:, None]
    adds = (steps >> 3) + np.where(codes & 4, steps, 0) + np.where(codes & 2, steps >> 1, 0) + np.where(codes & 1, steps >> 2, 0)
    adds = np.where(codes & 8, -adds, adds).astype(np.int32).ravel()
    leads = np.clip(np.arange(89)[:, None] + MOVES[codes & 7], 0, 88).astype(np.int32).ravel()
    for k, column in enumerate(columns):
        for half, code in enumerate((column & 15, column >> 4)):
            both = at * 16 + code
            value = np.clip(value + adds[both], -32768, 32767)
            at = leads[both]
            out[1 + 2 * k + half] = value
    return out.T


def doubled(pcm: np.ndarray) -> np.ndarray:
    """The samples at twice their rate: those between come from a four-tap half-band filter."""
    x = np.concatenate((pcm[:1], pcm, pcm[-1:], pcm[-1:])).astype(np.int32)
    out = np.empty(2 * len(pcm), np.int16)
    out[::2] = pcm
    out[1::2] = np.clip((9 * (x[1:-2] + x[2:-1]) - x[:-3] - x[3:] + 8) >> 4, -32768, 32767)
    return out


def wav(data: bytes, tag: int = MU_LAW, rate: int = 8000) -> bytes:
    """A RIFF/WAVE file of one channel around the data of a format tag."""
    bits, align, samples = {MU_LAW: (8, 1, len(data)), A_LAW: (8, 1, len(data)), PCM: (16, 2, len(data) // 2), ADPCM: (4, BLOCK_BYTES, len(data) // BLOCK_BYTES * (1 + 2 * (BLOCK_BYTES - 4)))}[tag]
    speed = rate * align if tag != ADPCM else rate * BLOCK_BYTES // (1 + 2 * (BLOCK_BYTES - 4))
    head = struct.pack("<HHIIHHH", tag, 1, rate, speed, align, bits, 0)
    body = b"WAVEfmt " + struct.pack("<I", len(head)) + head + b"fact" + struct.pack("<II", 4, samples) + b"data" + struct.pack("<I", len(data)) + data + b"\0" * (len(data) % 2)
    return b"RIFF" + struct.pack("<I", len(body)) + body


def read_wav(file: bytes) -> tuple[int, int, bytes]:
    """(format tag, rate, data) of a file; chunks it doesn't know are skipped."""
    if file[:4] != b"RIFF" or file[8:12] != b"WAVE":
        raise ValueError("no RIFF/WAVE file")
    at, tag, rate = 12, None, None
    while at + 8 <= len(file):
        kind, size = file[at : at + 4], struct.unpack_from("<I", file, at + 4)[0]
        if kind == b"fmt ":
            tag, _, rate = struct.unpack_from("<HHI", file, at + 8)
        elif kind == b"data":
            if tag is None:
                raise ValueError("data before its format")
            return tag, rate, file[at + 8 : at + 8 + size]
        at += 8 + size + size % 2
    raise ValueError("no data in the file")


def to_pcm(tag: int, data: bytes) -> np.ndarray:
    """16-bit samples of the data of a format tag."""
    raw = np.frombuffer(data, np.uint8)
    if tag == MU_LAW:
        return mu_law_table()[raw]
    if tag == A_LAW:
        return a_law_table()[raw]
    if tag == ADPCM:
        return decode_adpcm(raw[: len(raw) // BLOCK_BYTES * BLOCK_BYTES].reshape(-1, BLOCK_BYTES)).ravel()
    if tag == PCM:
        return np.frombuffer(data, "<i2")
    raise ValueError(f"format tag {tag}")


def measures(pcm: np.ndarray) -> str:
    """Peak, root mean square and sign changes of samples."""
    wide = pcm.astype(np.int32)
    changes = int(np.count_nonzero(np.diff(wide < 0)))
    return f"{int(np.abs(wide).max())},{np.sqrt(np.mean(wide.astype(np.float64) ** 2)):.3f},{changes}"


def payload_of(text: bytes) -> bytes:
    """The bytes with spaces up to a positive multiple of the unit."""
    return text.ljust(max(1, -(-len(text) // UNIT_BYTES)) * UNIT_BYTES, b" ")


def audio_columns(docs: DataFrame, *, keep_media: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Stores the bytes of texts as telephony audio, reads them back and measures them.

    The UTF-8 bytes, padded with spaces to a multiple of 192, become the 8-bit
    mu-law samples of a WAVE file.  The file is parsed again; its samples are
    expanded by table and stored at twice the rate as 16-bit PCM.  The same
    bytes are also read as A-law samples and as ADPCM blocks, the blocks of
    many rows together.  ``feature`` has peak, root mean square and sign
    changes of the three, and the CRC-32 of the resampled PCM.

    Returns doc_id, n_bytes, payload_bytes, payload_sha256, tail_crc32,
    media_bytes, media_sha256, feature, and with ``keep_media`` the WAVE files
    ``media`` and ``pcm``.  Null and empty texts give one unit of spaces;
    equal texts give equal values; null and repeated ids keep a row for each
    row; other columns play no part; an empty table gives no rows.
    """
    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"doc_id {kind}, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string"

    def store(batch) -> dict:
        raw = [t.encode() for t in texts_of(batch)]
        files = [wav(payload_of(x)) for x in raw]
        parsed = [read_wav(x) for x in files]
        data = [x[2] for x in parsed]
        joined = np.frombuffer(b"".join(data), np.uint8).reshape(-1, BLOCK_BYTES)
        adpcm, row = decode_adpcm(joined), 0
        features, pcms = [], []
        for tag, rate, x in parsed:
            pcm = doubled(to_pcm(tag, x)).astype("<i2")
            blocks = len(x) // BLOCK_BYTES
            features.append(f"mulaw:{measures(pcm)};alaw:{measures(to_pcm(A_LAW, x))};adpcm:{measures(adpcm[row : row + blocks].ravel())};pcm:{zlib.crc32(pcm.tobytes())}")
            row += blocks
            if keep_media:
                pcms.append(wav(pcm.tobytes(), PCM, 2 * rate))
        out = {
            "doc_id": batch.column(0),
            "n_bytes": [len(x) for x in raw],
            "payload_bytes": [len(x) for x in data],
            "payload_sha256": [hashlib.sha256(x).hexdigest() for x in data],
            "tail_crc32": [zlib.crc32(x[-16:]) for x in data],
            "media_bytes": [len(x) for x in files],
            "media_sha256": [hashlib.sha256(x).hexdigest() for x in files],
            "feature": features,
        }
        return out | ({"media": files, "pcm": pcms} if keep_media else {})

    return by_texts(docs, [id_col, text_col], store, schema + ", media binary, pcm binary" * keep_media)
