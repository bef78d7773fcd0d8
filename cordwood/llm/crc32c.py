"""CRC-32C of many byte strings at once, and the mask that record files put on it."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

# Fixed values of the checksum and of the record format's mask.
POLYNOMIAL = 0x82F63B78
MASK_DELTA = 0xA282EAD8

_ROW = 512  # bytes that are taken through the tables together


@lru_cache(maxsize=1)
def _byte_tables() -> np.ndarray:
    """tables[k][b]: the remainder of byte b followed by k zero bytes."""
    first = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        first = np.where(first & 1, (first >> 1) ^ np.uint32(POLYNOMIAL), first >> 1).astype(np.uint32)
    tables = [first]
    for _ in range(3):
        tables.append(first[tables[-1] & 255] ^ (tables[-1] >> 8))
    return np.stack(tables)


def _through(tables: np.ndarray, state: np.ndarray) -> np.ndarray:
    return (
        tables[0][state & 255]
        ^ tables[1][(state >> 8) & 255]
        ^ tables[2][(state >> 16) & 255]
        ^ tables[3][state >> 24]
    )


@lru_cache(maxsize=64)
def _zeros(power: int) -> np.ndarray:
    """Four tables that take a remainder past 2**power zero bytes."""
    if power:
        half = _zeros(power - 1)
        return np.stack([_through(half, half[k]) for k in range(4)])
    step = _byte_tables()[0]
    values = [np.arange(256, dtype=np.uint32) << np.uint32(8 * k) for k in range(4)]
    return np.stack([step[v & 255] ^ (v >> 8) for v in values])


def crc32c(values: list[bytes]) -> np.ndarray:
    """The checksum of each byte string, as unsigned 32-bit integers.

    Strings are cut into rows, padded in front with zeros that leave an empty remainder as
    it is. All rows go through the tables together and are then joined per string.
    """
    sizes = np.array([len(v) for v in values], dtype=np.int64)
    if not len(sizes):
        return np.zeros(0, dtype=np.uint32)
    rows = -(-sizes // _ROW)
    ends = np.cumsum(rows)
    block = np.zeros((int(ends[-1]), _ROW), dtype=np.uint8)
    flat = block.reshape(-1)
    for value, end in zip(values, ends * _ROW, strict=True):
        flat[end - len(value) : end] = np.frombuffer(value, dtype=np.uint8)
    words = np.ascontiguousarray(block.view("<u4").T)
    tables = _byte_tables()[::-1]
    state = np.zeros(words.shape[1], dtype=np.uint32)
    for word in words:
        state = _through(tables, state ^ word)
    past_row = _zeros(_ROW.bit_length() - 1)
    total = np.zeros(len(sizes), dtype=np.uint32)
    starts = ends - rows
    for k in range(int(rows.max())):
        on = np.flatnonzero(rows > k)
        total[on] = _through(past_row, total[on]) ^ state[starts[on] + k]
    begin = np.full(len(sizes), 0xFFFFFFFF, dtype=np.uint32)
    for bit in range(int(sizes.max()).bit_length()):
        on = np.flatnonzero((sizes >> bit) & 1)
        begin[on] = _through(_zeros(bit), begin[on])
    return total ^ begin ^ np.uint32(0xFFFFFFFF)


def masked(checksums: np.ndarray) -> np.ndarray:
    """The rotated and shifted form that is stored."""
    turned = (checksums >> np.uint32(15)) | (checksums << np.uint32(17))
    return turned + np.uint32(MASK_DELTA)
