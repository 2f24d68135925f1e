"""Static range asymmetric numeral coding of token ids in independent blocks of interleaved lanes."""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np

SCALE_BITS = 20
LANES = 32
BLOCK = 16_384
#: Bytes of a packed checkpoint: offset, number of words (u64 each), crc32 of the words (u32).
_CHECKPOINT = np.dtype([("offset", "<u8"), ("words", "<u8"), ("crc", "<u4")])
_LOW = np.uint64(1 << 31)
_U = np.uint64


@dataclass(frozen=True)
class Table:
    """Symbols in ascending order and their frequencies, which add up to 2^SCALE_BITS."""

    symbols: np.ndarray
    freqs: np.ndarray

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.nonzero(counts)[0]
        counts = counts[symbols]
        if len(symbols) > 1 << (SCALE_BITS - 1):
            raise ValueError("too many symbols for the scale")
        # One each, the rest in proportion; the most frequent one takes what rounding leaves.
        freqs = 1 + (counts.astype(np.float64) / max(1, len(ids)) * ((1 << SCALE_BITS) - len(symbols))).astype(np.int64)
        if len(freqs):
            freqs[np.argmax(counts)] += (1 << SCALE_BITS) - freqs.sum()
        return cls(symbols.astype(np.uint32), freqs.astype(np.uint32))

    def pack(self) -> bytes:
        """Gaps between symbols, then frequencies, as little-endian unsigned 32-bit integers, deflated."""
        gaps = np.diff(self.symbols, prepend=np.uint32(0)).astype("<u4")
        return zlib.compress(gaps.tobytes() + self.freqs.astype("<u4").tobytes(), 6)

    @classmethod
    def unpack(cls, data: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(data), "<u4")
        half = len(both) // 2
        return cls(np.cumsum(both[:half], dtype=np.uint64).astype(np.uint32), both[half:].astype(np.uint32))

    def starts(self) -> np.ndarray:
        return np.concatenate([[0], np.cumsum(self.freqs.astype(np.int64))[:-1]]).astype(np.uint64) if len(self.freqs) else np.empty(0, np.uint64)


def _steps(n: int) -> tuple[int, int]:
    """Blocks of n ids, and positions per lane in a block."""
    return -(-n // BLOCK), BLOCK // LANES


def encode(ids: np.ndarray, table: Table) -> tuple[bytes, bytes]:
    """Payload and packed checkpoints. All blocks advance together, lane by lane, so a step is one vector operation.

    A block is its lanes' final states (u64) followed by the 32-bit words that a decoder takes in turn. The last
    block is filled up with the most frequent symbol, which costs next to nothing; the reader knows the length.
    """
    n = len(ids)
    if not n:
        return b"", b""
    blocks, steps = _steps(n)
    place_of = np.zeros(int(table.symbols[-1]) + 1, np.int64)
    place_of[table.symbols] = np.arange(len(table.symbols))
    place = place_of[ids]
    filled = np.full(blocks * BLOCK, int(np.argmax(table.freqs)), np.int64)
    filled[:n] = place
    grid = filled.reshape(blocks, steps, LANES)
    freqs, starts = table.freqs.astype(np.uint64), table.starts()
    state = np.full((blocks, LANES), _LOW, np.uint64)
    words = np.empty((blocks, steps, LANES), np.uint32)
    sent = np.zeros((blocks, steps, LANES), bool)
    for i in range(steps - 1, -1, -1):
        f, c = freqs[grid[:, i]], starts[grid[:, i]]
        full = state >= (f << _U(63 - SCALE_BITS))
        words[:, i] = state.astype(np.uint32)
        sent[:, i] = full
        state = np.where(full, state >> _U(32), state)
        quotient = state // f
        state = (quotient << _U(SCALE_BITS)) + (state - quotient * f) + c
    parts, marks, offset = [], np.zeros(blocks, _CHECKPOINT), 0
    for b in range(blocks):
        body = state[b].astype("<u8").tobytes() + words[b][sent[b]].astype("<u4").tobytes()
        marks[b] = offset, (len(body) - 8 * LANES) // 4, zlib.crc32(body)
        parts.append(body)
        offset += len(body)
    return b"".join(parts), marks.tobytes()


def decode(payload: bytes, checkpoints: bytes, table: Table, n: int, first: int = 0, last: int | None = None) -> np.ndarray:
    """Ids of blocks first..last (all by default); a block whose checksum differs raises ValueError."""
    if not n:
        return np.empty(0, np.uint32)
    marks = np.frombuffer(checkpoints, _CHECKPOINT)
    blocks, steps = _steps(n)
    if len(marks) != blocks:
        raise ValueError("checkpoints don't fit the number of ids")
    last = blocks if last is None else last
    count = last - first
    state = np.empty((count, LANES), np.uint64)
    streams = []
    for b in range(first, last):
        at, size = int(marks["offset"][b]), 8 * LANES + 4 * int(marks["words"][b])
        body = payload[at : at + size]
        if len(body) != size or zlib.crc32(body) != marks["crc"][b]:
            raise ValueError(f"block {b} is damaged")
        state[b - first] = np.frombuffer(body, "<u8", LANES)
        streams.append(np.frombuffer(body, "<u4", -1, 8 * LANES))
    lengths = np.array([len(s) for s in streams], np.int64)
    stream = np.concatenate([*streams, np.zeros(LANES, np.uint32)]).astype(np.uint64)
    pointer = np.concatenate([[0], np.cumsum(lengths)[:-1]])[:, None]
    freqs, starts = table.freqs.astype(np.uint64), table.starts()
    owner = np.repeat(np.arange(len(freqs), dtype=np.uint32), table.freqs)
    mask = _U((1 << SCALE_BITS) - 1)
    out = np.empty((count, steps, LANES), np.uint32)
    for i in range(steps):
        slot = state & mask
        s = owner[slot.astype(np.int64)]
        out[:, i] = s
        state = freqs[s] * (state >> _U(SCALE_BITS)) + slot - starts[s]
        short = state < _LOW
        order = np.cumsum(short, axis=1)
        taken = stream[np.minimum(pointer + order - 1, len(stream) - 1)]
        state = np.where(short, (state << _U(32)) | taken, state)
        pointer = pointer + order[:, -1:]
    return table.symbols[out.reshape(-1)[: n - first * BLOCK if last == blocks else count * BLOCK]]
