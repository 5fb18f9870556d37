"""Static range asymmetric numeral system for token ids, in numpy.

A *segment* holds the ids of some documents: one frequency table shared by all its blocks, a document index, and
independent blocks. A block interleaves ``LANES`` coders: id i belongs to lane i mod LANES, and one numpy step codes one
id of every lane. The state is 64 bits and moves 32-bit words; word order is lane order within a step. Half way through
a block a checkpoint keeps the position in the words and all lane states, so a reader can begin there, and both halves
can be decoded side by side. Each block has a CRC32 of its words and one of its ids.

Layout (little-endian): magic ``RNS1``; six int64: documents, ids, blocks, table length, index length, ids of all
segments before it in its file; zlib of the index (doc_id int64s, lengths int64s, a byte each that is 1 where the doc_id is null); zlib of the table (symbols, then
frequencies, uint32); then each block: seven int64 (ids, words, checkpoint step, checkpoint word, crc of words, crc of
ids, bytes of states), states at the start, states at the checkpoint, words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"RNS1"
SCALE = 20
TOTAL = 1 << SCALE
LOW = 1 << 31
LANES = 2048
BLOCK = 1 << 20
U = np.uint64


def quantised(counts: np.ndarray) -> np.ndarray:
    """Frequencies of at least 1 that sum to TOTAL, for counts of at least 1."""
    freq = np.maximum(1, counts * TOTAL // counts.sum()).astype(np.int64)
    gap = TOTAL - int(freq.sum())
    order = np.argsort(-freq, kind="stable")
    if gap > 0:
        freq[order[0]] += gap
    for i in order:
        if gap >= 0:
            break
        take = min(int(freq[i]) - 1, -gap, max(1, int(freq[i]) // 2))
        freq[i] -= take
        gap += take
    while gap < 0:
        big = np.flatnonzero(freq > 1)[: -gap]
        freq[big] -= 1
        gap += len(big)
    return freq


class Table:
    def __init__(self, symbols: np.ndarray, freq: np.ndarray):
        self.symbols, self.freq = symbols.astype(np.uint32), freq.astype(np.uint64)
        self.start = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)

    @classmethod
    def of(cls, ids: np.ndarray) -> Table:
        counts = np.bincount(ids)
        symbols = np.flatnonzero(counts)
        return cls(symbols, quantised(counts[symbols]))

    def to_bytes(self) -> bytes:
        return zlib.compress(self.symbols.astype("<u4").tobytes() + self.freq.astype("<u4").tobytes(), 6)

    @classmethod
    def from_bytes(cls, raw: bytes) -> Table:
        both = np.frombuffer(zlib.decompress(raw), "<u4")
        return cls(both[: len(both) // 2], both[len(both) // 2 :])

    def dense(self) -> tuple[np.ndarray, np.ndarray]:
        """Frequency and start of every id up to the largest."""
        size = int(self.symbols[-1]) + 1 if len(self.symbols) else 1
        freq, start = np.zeros(size, np.uint64), np.zeros(size, np.uint64)
        freq[self.symbols], start[self.symbols] = self.freq, self.start
        return freq, start

    def slots(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Which symbol (by number) each of the TOTAL slots has; id, frequency and first slot of each symbol."""
        kind = np.uint16 if len(self.symbols) < 1 << 16 else np.uint32
        return np.repeat(np.arange(len(self.symbols), dtype=kind), self.freq.astype(np.int64)), self.symbols, self.freq, self.start


def encode_block(ids: np.ndarray, dense: tuple[np.ndarray, np.ndarray]) -> bytes:
    freq, start = dense
    steps = -(-len(ids) // LANES)
    half = steps // 2
    x = np.full(LANES, LOW, np.uint64)
    words: list[np.ndarray] = []
    middle, after = x.copy(), 0
    most, word, scale = U(LOW >> SCALE << 32), U(32), U(SCALE)
    for t in range(steps - 1, -1, -1):
        s = ids[t * LANES : (t + 1) * LANES]
        f, y = freq[s], x[: len(s)]
        full = np.flatnonzero(y >= f * most)
        if len(full):
            out = y[full]
            words.append(out.astype(np.uint32))
            y[full] = out >> word
        q = y // f
        y -= q * f
        q <<= scale
        y += q
        y += start[s]
        if t == half:
            middle, after = x.copy(), sum(map(len, words))
    flat = np.concatenate(words[::-1]).astype("<u4") if words else np.empty(0, "<u4")
    if half == 0:
        middle, after = x.copy(), len(flat)
    body = flat.tobytes()
    states = x.astype("<u8").tobytes() + middle.astype("<u8").tobytes()
    head = struct.pack("<7q", len(ids), len(flat), half, len(flat) - after, zlib.crc32(body), zlib.crc32(np.ascontiguousarray(ids, "<u4")), len(states))
    return head + states + body


def decode_steps(x: np.ndarray, words: np.ndarray, at: int, first: int, last: int, n: int, slots) -> np.ndarray:
    """Ids of steps first to last (exclusive) from lane states ``x`` and word position ``at``."""
    number, symbol, freq, start = slots
    out = np.empty(max(0, min(n, last * LANES) - first * LANES), np.uint32)
    mask, low, wide, scale, word = U(TOTAL - 1), U(LOW), words.astype(np.uint64), U(SCALE), U(32)
    for t in range(first, last):
        m = min(LANES, n - t * LANES)
        y = x[:m]
        slot = y & mask
        s = number[slot]
        out[(t - first) * LANES : (t - first) * LANES + m] = symbol[s]
        y >>= scale
        y *= freq[s]
        y += slot
        y -= start[s]
        need = np.flatnonzero(y < low)
        if len(need):
            y[need] = (y[need] << word) | wide[at : at + len(need)]
            at += len(need)
    return out


def decode_block(raw: memoryview, slots, from_checkpoint: bool = False) -> np.ndarray:
    n, count, half, after, crc, crc_ids, size = struct.unpack("<7q", raw[:56])
    states = np.frombuffer(raw[56 : 56 + size], "<u8").astype(np.uint64).reshape(2, LANES)
    body = raw[56 + size : 56 + size + 4 * count]
    if zlib.crc32(body) != crc:
        raise ValueError("a block's words do not match their checksum")
    words, steps = np.frombuffer(body, "<u4"), -(-n // LANES)
    second = decode_steps(states[1].copy(), words, after, half, steps, n, slots)
    if from_checkpoint:
        return second
    ids = np.concatenate([decode_steps(states[0].copy(), words, 0, 0, half, n, slots), second])
    if zlib.crc32(ids.astype("<u4").tobytes()) != crc_ids:
        raise ValueError("a block's ids do not match their checksum")
    return ids


def encode_segment(doc_ids: np.ndarray, lengths: np.ndarray, ids: np.ndarray, before: int, null: np.ndarray | None = None) -> bytes:
    table = Table.of(ids) if len(ids) else Table(np.empty(0, np.uint32), np.empty(0, np.int64))
    dense = table.dense()
    blocks = [encode_block(ids[i : i + BLOCK], dense) for i in range(0, len(ids), BLOCK)]
    none = np.zeros(len(doc_ids), np.uint8) if null is None else null.astype(np.uint8)
    index = zlib.compress(doc_ids.astype("<i8").tobytes() + lengths.astype("<i8").tobytes() + none.tobytes(), 1)
    packed = table.to_bytes()
    return b"".join([MAGIC, struct.pack("<6q", len(doc_ids), len(ids), len(blocks), len(packed), len(index), before), index, packed, *blocks])


def read_segment(raw: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, int, np.ndarray]:
    """(doc_ids, lengths, ids, ids before it in its file, which doc_ids are null); ValueError if anything does not fit
    its checksum."""
    if raw[:4] != MAGIC:
        raise ValueError("no segment")
    docs, n, blocks, table, index, before = struct.unpack("<6q", raw[4:52])
    view, at = memoryview(raw), 52
    flat = zlib.decompress(view[at : at + index])
    both, null = np.frombuffer(flat[: 16 * docs], "<i8"), np.frombuffer(flat[16 * docs :], np.uint8) > 0
    at += index
    slots = Table.from_bytes(view[at : at + table]).slots() if n else None
    at += table
    out = []
    for _ in range(blocks):
        _, count, *_, size = struct.unpack("<7q", view[at : at + 56])
        end = at + 56 + size + 4 * count
        out.append(decode_block(view[at:end], slots))
        at = end
    return both[:docs], both[docs:], np.concatenate(out) if out else np.empty(0, np.uint32), before, null
