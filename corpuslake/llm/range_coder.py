"""Adaptive context-mixing range coder for token ids, and a file format of frames and blocks.

Ids are cut into blocks of equal length, each coded from a fresh model and with its own checksum.  Three predictions
drive the coder: the id that last followed the two previous ids, the id that last followed the previous one, and
adaptive magnitudes of ids (order 0, seen from the magnitude before).  Their weights adapt by how often each
prediction has come true in its context.  All blocks of a frame are coded in lockstep, one id of every block a step.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4096
_SLOTS = 1 << 12
_CLASSES = 18
_CONTEXTS = 32
_TOP = np.uint64(1 << 32)
_MASK = np.uint64((1 << 48) - 1)
_16, _32, _48 = np.uint64(16), np.uint64(32), np.uint64(48)
_MAGIC = b"CMRF0001"


class _Model:
    """State of every block's model; the first ``m`` blocks are active in a step.

    Counts are flat arrays: ``flags[kind * n + context]`` for which prediction comes true, ``sizes[row * classes + size]``
    for magnitudes, each with running totals.
    """

    def __init__(self, lanes: int):
        self.lane = np.arange(lanes)
        self.table2, self.table1 = (np.zeros(lanes * _SLOTS, np.int64) for _ in range(2))  # guess * 4 + trust
        self.n = lanes * _CONTEXTS
        self.flags = np.repeat(np.array([2, 2, 4]), self.n)
        self.sizes = np.ones((lanes * _CLASSES, _CLASSES), np.int64)
        self.flat_sizes, self.size_totals = self.sizes.reshape(-1), np.full(lanes * _CLASSES, _CLASSES)
        self.last = np.zeros(lanes, np.int64)
        self.before = np.zeros(lanes, np.int64)

    def predict(self, m: int) -> None:
        last, lane = self.last[:m], self.lane[:m]
        mixed = last * 40503
        base = lane * _SLOTS
        self.at1 = base + ((mixed >> 4) & (_SLOTS - 1))
        self.at2 = base + (((mixed ^ (self.before[:m] * 30011)) >> 3) & (_SLOTS - 1))
        cell1, cell2 = self.table1.take(self.at1), self.table2.take(self.at2)
        self.guess1, self.guess2, self.sure1, self.sure2 = cell1 >> 2, cell2 >> 2, cell1 & 3, cell2 & 3
        self.context = lane * _CONTEXTS + ((self.sure2 << 3) | (self.sure1 << 1) | (self.guess1 == self.guess2))
        self.first, self.second = self.flags.take(self.context), self.flags.take(self.context + self.n)
        self.both = self.first + self.second
        self.total = self.both + self.flags.take(self.context + 2 * self.n)

    def share(self, kind: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``(start, frequency)`` of which prediction comes true."""
        start = np.where(kind == 0, 0, np.where(kind == 1, self.first, self.both))
        return start.astype(np.uint64), self.flags.take(self.context + kind * self.n).astype(np.uint64)

    def size_rows(self, some: np.ndarray) -> np.ndarray:
        """Rows of magnitude counts for the blocks ``some``."""
        return some * _CLASSES + magnitude(self.last.take(some))

    def update(self, m: int, ids: np.ndarray, kind: np.ndarray, rows: np.ndarray, size: np.ndarray) -> None:
        self.flags[self.context + kind * self.n] += 24
        full = np.flatnonzero(self.total > 4000)
        if len(full):
            for k in range(3):
                at = self.context[full] + k * self.n
                self.flags[at] = (self.flags[at] + 1) >> 1
        if len(rows):
            self.flat_sizes[rows * _CLASSES + size] += 24
            total = self.size_totals.take(rows) + 24
            heavy = np.flatnonzero(total > 8000)
            if len(heavy):
                self.sizes[rows[heavy]] = (self.sizes[rows[heavy]] + 1) >> 1
                total[heavy] = self.sizes[rows[heavy]].sum(axis=1)
            self.size_totals[rows] = total
        for table, at, guess, sure in ((self.table1, self.at1, self.guess1, self.sure1), (self.table2, self.at2, self.guess2, self.sure2)):
            right = guess == ids
            kept = right | (sure > 1)
            table[at] = (np.where(kept, guess, ids) << 2) | np.where(right, np.minimum(sure + 1, 3), np.where(kept, sure - 1, 0))
        self.before[:m], self.last[:m] = self.last[:m], ids


_MAGNITUDE = np.array([i.bit_length() for i in range(1 << 17)], np.int64)


_HALF = np.array([1 << max(i - 1, 0) for i in range(_CLASSES)], np.uint64)  # ids of one magnitude
_ONE = np.uint64(1)


def magnitude(ids: np.ndarray) -> np.ndarray:
    """Bits of each id."""
    return _MAGNITUDE.take(ids)


class _Writer:
    def __init__(self, lanes: int, words: int):
        self.out = np.zeros((lanes, words), np.uint32)
        self.flat = self.out.reshape(-1)
        self.end = np.arange(lanes) * words          # where each block writes next
        self.first = self.end.copy()
        self.low = np.zeros(lanes, np.uint64)
        self.range = np.full(lanes, 1 << 48, np.uint64)

    def put(self, who, start: np.ndarray, freq: np.ndarray, total) -> None:
        """Narrow the range of the blocks ``who`` to ``[start, start + freq)`` of ``total``."""
        step = self.range[who] // total
        low = self.low[who] + step * start
        width = step * freq
        carry = np.flatnonzero(low > _MASK)
        end = self.end[who]
        if len(carry):
            self.flat[end[carry] - 1] += 1
            low &= _MASK
        out = np.flatnonzero(width < _TOP)
        if len(out):
            self.flat[end[out]] = low[out] >> _32
            low[out] = (low[out] << _16) & _MASK
            width[out] <<= _16
            end[out] += 1
            self.end[who] = end
        self.low[who], self.range[who] = low, width

    def finish(self) -> list[bytes]:
        for shift in (_32, _16, np.uint64(0)):
            self.flat[self.end] = (self.low >> shift) & np.uint64(0xFFFF)
            self.end += 1
        while True:
            carry = self.out >> 16
            if not carry.any():
                break
            self.out &= 0xFFFF
            self.out[:, :-1] += carry[:, 1:]
        words = self.out.astype(">u2")
        return [words[i, :n].tobytes() for i, n in enumerate((self.end - self.first).tolist())]


class _Reader:
    def __init__(self, payloads: list[bytes]):
        self.flat = np.frombuffer(b"".join(payloads) + b"\0" * 16, ">u2").astype(np.uint64)
        sizes = np.fromiter((len(p) // 2 for p in payloads), np.int64, len(payloads))
        self.at = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.code = np.zeros(len(payloads), np.uint64)
        for _ in range(3):
            self.code = (self.code << _16) | self.flat[self.at]
            self.at += 1
        self.range = np.full(len(payloads), 1 << 48, np.uint64)

    def peek(self, who, total) -> np.ndarray:
        """Which of ``total`` parts the code of each block lies in."""
        self.step = self.range[who] // total
        return np.minimum(self.code[who] // self.step, total - np.uint64(1))

    def take(self, who, start: np.ndarray, freq: np.ndarray) -> None:
        code, width = self.code[who] - self.step * start, self.step * freq
        more = np.flatnonzero(width < _TOP)
        if len(more):
            at = self.at[who]
            code[more] = (code[more] << _16) | self.flat[np.minimum(at[more], len(self.flat) - 1)]
            width[more] <<= _16
            at[more] += 1
            self.at[who] = at
        self.code[who], self.range[who] = code, width


def _lengths(n: int) -> list[int]:
    return [min(BLOCK, n - a) for a in range(0, n, BLOCK)]


def encode_blocks(ids: np.ndarray) -> list[bytes]:
    """Code ids as independent blocks of ``BLOCK`` ids (the last may be shorter)."""
    lengths = _lengths(len(ids))
    lanes = len(lengths)
    padded = np.zeros(lanes * BLOCK, np.int64)
    padded[:len(ids)] = ids
    grid = np.ascontiguousarray(padded.reshape(lanes, BLOCK).T)
    model, coder = _Model(lanes), _Writer(lanes, 3 * BLOCK + 8)
    for step in range(BLOCK if lanes else 0):
        m = lanes - (lengths[-1] <= step)
        if not m:
            break
        now = grid[step, :m]
        model.predict(m)
        kind = np.where(model.guess2 == now, 0, np.where(model.guess1 == now, 1, 2))
        coder.put(slice(0, m), *model.share(kind), model.total.astype(np.uint64))
        some = np.flatnonzero(kind == 2)
        rows = size = some
        if len(some):
            value = now.take(some)
            size, rows = magnitude(value), model.size_rows(some)
            at = np.arange(0, len(some) * _CLASSES, _CLASSES) + size
            table = model.sizes.take(rows, axis=0)
            freq = table.reshape(-1).take(at)
            end = table.cumsum(axis=1).reshape(-1).take(at)
            coder.put(some, (end - freq).astype(np.uint64), freq.astype(np.uint64), model.size_totals.take(rows).astype(np.uint64))
            half = _HALF.take(size)
            coder.put(some, value.astype(np.uint64) & (half - _ONE), _ONE, half)
        model.update(m, now, kind, rows, size)
    return coder.finish()


def decode_blocks(payloads: list[bytes], n: int) -> np.ndarray:
    """The ``n`` ids of ``encode_blocks``."""
    lengths = _lengths(n)
    lanes = len(lengths)
    grid = np.zeros((BLOCK, lanes), np.int64)
    if not lanes:
        return np.empty(0, np.int64)
    model, coder = _Model(lanes), _Reader(payloads)
    for step in range(BLOCK):
        m = lanes - (lengths[-1] <= step)
        if not m:
            break
        every = slice(0, m)
        model.predict(m)
        place = coder.peek(every, model.total.astype(np.uint64)).astype(np.int64)
        kind = (place >= model.first).astype(np.int64) + (place >= model.both)
        coder.take(every, *model.share(kind))
        now = np.where(kind == 0, model.guess2, model.guess1)
        some = np.flatnonzero(kind == 2)
        rows = size = some
        if len(some):
            rows = model.size_rows(some)
            table = model.sizes.take(rows, axis=0)
            ends = table.cumsum(axis=1)
            place = coder.peek(some, model.size_totals.take(rows).astype(np.uint64)).astype(np.int64)
            size = (place[:, None] >= ends).sum(axis=1)
            at = np.arange(0, len(some) * _CLASSES, _CLASSES) + size
            freq = table.reshape(-1).take(at)
            coder.take(some, (ends.reshape(-1).take(at) - freq).astype(np.uint64), freq.astype(np.uint64))
            half = _HALF.take(size)
            rest = coder.peek(some, half)
            coder.take(some, rest, _ONE)
            now[some] = np.where(size > 0, (half + rest).astype(np.int64), 0)
        model.update(m, now, kind, rows, size)
        grid[step, :m] = now
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def pack_frame(documents: list[tuple[int | None, bytes]]) -> bytes:
    """A frame of whole documents, each an id and its token ids as little-endian 32-bit bytes.

    Layout: magic, document and id counts; per document its id, a null mark and its length; per block its payload size
    and the checksum of its ids; payloads; a checksum of all that goes before.
    """
    ids = np.frombuffer(b"".join(t for _, t in documents), "<u4").astype(np.int64)
    payloads = encode_blocks(ids)
    head = [_MAGIC, struct.pack("<QQ", len(documents), len(ids))]
    head += [struct.pack("<qBQ", 0 if d is None else d, d is None, len(t) // 4) for d, t in documents]
    raw = ids.astype("<u4")
    head += [struct.pack("<II", len(p), zlib.crc32(raw[a:a + BLOCK].tobytes())) for a, p in zip(range(0, len(ids), BLOCK), payloads)]
    body = b"".join([*head, *payloads])
    return body + struct.pack("<I", zlib.crc32(body))


def unpack_frame(frame: bytes) -> list[tuple[int | None, bytes]]:
    """The documents of a frame; raises ``ValueError`` if a checksum is wrong."""
    if frame[:8] != _MAGIC or zlib.crc32(frame[:-4]) != struct.unpack("<I", frame[-4:])[0]:
        raise ValueError("the frame is damaged")
    n_docs, n_ids = struct.unpack_from("<QQ", frame, 8)
    at = 24
    table = list(struct.iter_unpack("<qBQ", frame[at:at + 17 * n_docs]))
    at += 17 * n_docs
    blocks = list(struct.iter_unpack("<II", frame[at:at + 8 * len(_lengths(n_ids))]))
    at += 8 * len(blocks)
    payloads = []
    for size, _ in blocks:
        payloads.append(frame[at:at + size])
        at += size
    raw = decode_blocks(payloads, n_ids).astype("<u4").tobytes()
    for i, (_, checksum) in enumerate(blocks):
        if zlib.crc32(raw[4 * i * BLOCK:4 * (i + 1) * BLOCK]) != checksum:
            raise ValueError(f"block {i} of the frame is damaged")
    out, start = [], 0
    for doc, null, n in table:
        out.append((None if null else doc, raw[4 * start:4 * (start + n)]))
        start += n
    return out
