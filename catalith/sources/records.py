"""The byte formats of segments and of their indexes."""

from __future__ import annotations

import struct
import zlib
from functools import lru_cache

import numpy as np

from catalith.operators.ordered import FOOTER, MAGIC, RECORD_OVERHEAD

#: Header is magic and size, both u32 little-endian; a CRC-32C follows the payload.
HEADER = struct.Struct("<II")
FOOTER_MAGIC = 0x464F4F54
_FOOT = struct.Struct("<IQ16xI")
#: One row of an index file, its footer, the footer's magic number and version.
INDEX_ROW = np.dtype([("offset", "<i8"), ("stored_size", "<u4"), ("logical_size", "<u4"), ("magic", "<u4"), ("hash", "V32"), ("supplier_id", "<u4"), ("dict_id", "<u4")])
_INDEX_FOOT = struct.Struct("<IQqI4xI")
INDEX_MAGIC, INDEX_VERSION = 0x49445846, 1
_POLYNOMIAL = 0x82F63B78  # CRC-32C, reflected
_KNOWN = frozenset(MAGIC.values())


_BLOCK = 512


@lru_cache
def _tables() -> np.ndarray:
    """Remainders of all bytes followed by 0 to 7 zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = (first >> 1) ^ np.where(first & 1, np.uint32(_POLYNOMIAL), np.uint32(0))
    tables = [first]
    for _ in range(7):
        tables.append((tables[-1] >> 8) ^ first[tables[-1] & 255])
    return np.stack(tables)


def _bytewise(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    return tables[0][crc & 255] ^ tables[1][crc >> 8 & 255] ^ tables[2][crc >> 16 & 255] ^ tables[3][crc >> 24]


@lru_cache
def _shift(power: int) -> np.ndarray:
    """What 2 ** power zero bytes make of a remainder, by its four bytes."""
    values = np.arange(256, dtype=np.uint32) << (np.arange(4, dtype=np.uint32) * np.uint32(8))[:, None]
    if power == 0:
        return (values >> 8) ^ _tables()[0][values & 255]
    half = _shift(power - 1)
    return _bytewise(half, _bytewise(half, values))


def crc32c_many(payloads: list) -> np.ndarray:
    """CRC-32C of each of many bytes-like objects.

    Each is cut into blocks, the first filled up with zeros in front, which do not change a remainder that starts at
    zero. All blocks are worked through together, eight bytes a step, then joined in their order; what the start value
    contributes depends on the length alone.
    """
    sizes = np.array([len(p) for p in payloads], np.int64)
    if sizes.sum() > 1 << 26 and len(payloads) > 1:
        half = len(payloads) // 2
        return np.concatenate([crc32c_many(payloads[:half]), crc32c_many(payloads[half:])])
    blocks = np.maximum(1, -(-sizes // _BLOCK))
    ends = np.cumsum(blocks)
    data = np.zeros(int(ends[-1] if len(ends) else 0) * _BLOCK, np.uint8)
    for p, size, end in zip(payloads, sizes.tolist(), (ends * _BLOCK).tolist()):
        data[end - size : end] = np.frombuffer(p, np.uint8)
    words, t = data.view("<u4").reshape(-1, _BLOCK // 4).T.copy(), _tables()
    crc = np.zeros(words.shape[1], np.uint32)
    for a, b in zip(words[::2], words[1::2]):
        crc = _bytewise(t[7:3:-1], a ^ crc) ^ _bytewise(t[3::-1], b)
    first = ends - blocks
    out = crc[first]
    for i in range(1, int(blocks.max(initial=1))):
        more = np.flatnonzero(blocks > i)
        out[more] = _bytewise(_shift(_BLOCK.bit_length() - 1), out[more]) ^ crc[first[more] + i]
    start = np.full(len(sizes), 0xFFFFFFFF, np.uint32)
    for power in range(int(sizes.max(initial=0)).bit_length()):
        longer = np.flatnonzero(sizes >> power & 1)
        start[longer] = _bytewise(_shift(power), start[longer])
    return out ^ start ^ np.uint32(0xFFFFFFFF)


def crc32c(data: bytes) -> int:
    return int(crc32c_many([data])[0])


def encode_records(magics: list[int], payloads: list[bytes]) -> list[bytes]:
    return [HEADER.pack(m, len(p)) + p + struct.pack("<I", c) for m, p, c in zip(magics, payloads, crc32c_many(payloads).tolist())]


def encode_record(magic: int, payload: bytes) -> bytes:
    return HEADER.pack(magic, len(payload)) + payload + struct.pack("<I", crc32c(payload))


def encode_record(magic: int, payload: bytes) -> bytes:
    return encode_records([magic], [payload])[0]


def encode_footer(records: int, size: int) -> bytes:
    return _FOOT.pack(records, size, FOOTER_MAGIC)


def read_footer(data: bytes) -> tuple[int, int] | None:
    """records and size of the footer that ends data, None if none does."""
    if len(data) < FOOTER:
        return None
    records, size, magic = _FOOT.unpack_from(data, len(data) - FOOTER)
    return (records, size) if magic == FOOTER_MAGIC else None


def decode_records(raw: list[bytes]) -> list[tuple[int, bytes, bool]]:
    """magic, payload and crc_ok of whole records; one that is cut off is not ok and comes out empty."""
    raw = [r if len(r) >= RECORD_OVERHEAD else bytes(RECORD_OVERHEAD - 1) + b"\1" for r in raw]
    heads = [HEADER.unpack_from(r) for r in raw]
    payloads = [r[HEADER.size : HEADER.size + size] for r, (_, size) in zip(raw, heads)]
    sums = [struct.unpack_from("<I", r, len(r) - 4)[0] for r in raw]
    return [(magic, p, c == s and len(p) == size) for (magic, size), p, s, c in zip(heads, payloads, sums, crc32c_many(payloads).tolist())]


def scan_segment(data: bytes):
    """offset, magic, payload, crc_ok of the records of a segment, up to the first place where none can begin.

    Footers are skipped wherever they stand, and a record without payload is one. A record whose checksum is wrong
    comes out with crc_ok false, and the scan goes on behind it.
    """
    at, places = 0, []
    while len(data) - at >= HEADER.size:
        magic, size = HEADER.unpack_from(data, at)
        end = at + RECORD_OVERHEAD + size
        if magic in _KNOWN and end <= len(data):
            places.append((at, end))
            at = end
        elif len(data) - at >= FOOTER and _FOOT.unpack_from(data, at)[2] == FOOTER_MAGIC:
            at += FOOTER
        else:
            break
    return [(at, *r) for (at, _), r in zip(places, decode_records([data[a:b] for a, b in places]))]


def encode_index(rows: np.ndarray) -> bytes:
    """An index file of rows of INDEX_ROW."""
    entries = rows.astype(INDEX_ROW).tobytes()
    last = int(rows["offset"][-1]) if len(rows) else 0
    return entries + _INDEX_FOOT.pack(INDEX_VERSION, len(rows), last, zlib.crc32(entries), INDEX_MAGIC)


def decode_index(data: bytes) -> np.ndarray:
    """The rows of an index file; one without footer, with a wrong checksum or of a wrong length is an error."""
    if len(data) < _INDEX_FOOT.size:
        raise ValueError("the index has no footer")
    version, count, _, checksum, magic = _INDEX_FOOT.unpack_from(data, len(data) - _INDEX_FOOT.size)
    entries = data[: -_INDEX_FOOT.size]
    if magic != INDEX_MAGIC or version != INDEX_VERSION:
        raise ValueError("the index has no footer")
    if len(entries) != count * INDEX_ROW.itemsize:
        raise ValueError("the index is not as long as its footer says")
    if zlib.crc32(entries) != checksum:
        raise ValueError("the index has a wrong checksum")
    return np.frombuffer(entries, INDEX_ROW)
