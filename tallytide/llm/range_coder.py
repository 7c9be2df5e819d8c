"""Adaptive context-mixing range coder for token ids.

A block of ids is coded with nothing but its own history. Order 2 and order 1 each predict one
id, the one that last followed the same two ids or the same one, with a confidence from 0 to 3:
how often it did so in a row. Order 0 gives every id a probability from the counts of its upper
byte in the block, taken over after 16 ids, 32, 64 and so on. For each pair of confidences,
adaptive weights say how often order 2 was right, and order 1 where order 2 was not; they mix
the three predictions into one interval of the range coder.

Blocks are independent, so many of them are coded side by side: every step codes the next id
of all blocks in array operations. All totals are powers of two, so that shifts stand for
divisions; the one quotient, below 2**18, is exact in floating point.
"""

from __future__ import annotations

import numpy as np

IDS = 1 << 16

# The range stays within 32 and 48 bits; what leaves it goes out in words of 16 bits.
_WINDOW, _LEAST = 48, 1 << 32
_CONTEXTS_1, _CONTEXTS_2 = 1 << 10, 1 << 11
# Weights of 12 bits stay within 31 and 4064, so that an interval has at least 2**-32 of the range.
_WEIGHT_BITS, _WEIGHT_STEP, _RIGHT, _WRONG = 12, 5, 4064, 31
# Slots of order 0 for the upper byte; each upper byte has one at least.
_SLOT_BITS = 10
_SLOTS = 1 << _SLOT_BITS
_REFRESH = 16
_HASH_1, _HASH_2 = np.int32(-1640531535), np.int32(5)


class _Model:
    """Predictions for ``n`` blocks; the state after a step is the same in both directions."""

    def __init__(self, n: int, steps: int):
        lanes = np.arange(n, dtype=np.int64)
        self.at1, self.at2 = lanes * _CONTEXTS_1, lanes * _CONTEXTS_2
        self.at_w, self.at_h, self.at_s = lanes * 16, lanes * 256, lanes * _SLOTS
        self.first = np.zeros(n * _CONTEXTS_1, np.int32)
        self.second = np.zeros(n * _CONTEXTS_2, np.int32)
        # By confidences: how often order 2 was right, and order 1 where order 2 was not.
        self.weight2 = np.full(n * 16, 1 << _WEIGHT_BITS - 1, np.int64)
        self.weight1 = np.full(n * 16, 1 << _WEIGHT_BITS - 1, np.int64)
        self.counts = np.zeros((n, 256), np.int32)
        self.hash1, self.hash2 = np.zeros(n, np.int32), np.zeros(n, np.int32)
        self.ids = np.zeros((steps, n), np.uint16)
        self.taken, self.next = 0, _REFRESH
        self.spread(n)

    def refresh(self, step: int, n: int) -> None:
        """Take over the counts of upper bytes now and then; in between they stay as they are."""
        if step == self.next:
            for at in range(self.taken, step, 128):
                upper = (self.ids[at : min(at + 128, step), :n] >> 8) + self.at_h[:n]
                found = np.bincount(upper.ravel(), minlength=n * 256)
                self.counts[:n] += found.reshape(n, 256).astype(np.int32)
            self.taken, self.next = step, 2 * step
            self.spread(n)

    def spread(self, n: int) -> None:
        """Deal out the slots of order 0 in proportion to the counts, and one to each upper byte."""
        counts = self.counts[:n] if self.taken else np.ones((n, 256), np.int32)
        ends = counts.cumsum(1, dtype=np.int32) * np.int32(_SLOTS - 256)
        ends = (ends / counts.sum(1, keepdims=True)).astype(np.int32)
        ends += np.arange(1, 257, dtype=np.int32)
        sizes = np.diff(ends, axis=1, prepend=np.int32(0))
        self.slots = np.repeat(np.tile(np.arange(256, dtype=np.uint8), n), sizes.ravel())
        # The first slot of an upper byte, and the number of its slots.
        self.shares = ((ends - sizes) << 16 | sizes).ravel()

    def predict(self, n: int, size: np.ndarray) -> None:
        self.slot1 = (self.hash1[:n] >> 13 & _CONTEXTS_1 - 1) + self.at1[:n]
        self.slot2 = (self.hash2[:n] >> 13 & _CONTEXTS_2 - 1) + self.at2[:n]
        self.entry1, self.entry2 = self.first.take(self.slot1), self.second.take(self.slot2)
        self.sure1, self.sure2 = self.entry1 & 3, self.entry2 & 3
        self.row = (self.sure2 * 4 + self.sure1) + self.at_w[:n]
        self.share2, self.share1 = self.weight2.take(self.row), self.weight1.take(self.row)
        # The intervals: order 2, then order 1, then all else.
        self.size2 = (size >> _WEIGHT_BITS) * self.share2
        rest = size - self.size2
        self.size1 = (rest >> _WEIGHT_BITS) * self.share1
        self.size0 = rest - self.size1
        self.end1 = self.size2 + self.size1

    def learn(self, n: int, ids: np.ndarray, right2: np.ndarray, right1: np.ndarray) -> None:
        """``right1``: order 1 was right and order 2 was not."""
        self.weight2[self.row] = self.share2 + (right2 * (_RIGHT - _WRONG) + _WRONG - self.share2 >> _WEIGHT_STEP)
        moved = right1 * (_RIGHT - _WRONG) + _WRONG - self.share1 >> _WEIGHT_STEP
        moved *= ~right2
        self.weight1[self.row] = self.share1 + moved
        fresh = ids << 2
        self.second[self.slot2] = np.where(right2, self.entry2 + (self.sure2 < 3), fresh)
        same = self.entry1 - self.sure1 == fresh
        self.first[self.slot1] = np.where(same, self.entry1 + (self.sure1 < 3), fresh)
        hashed = (ids + np.int32(1)) * _HASH_1
        self.hash2[:n] = self.hash1[:n] * _HASH_2 + hashed
        self.hash1[:n] = hashed


def _ordered(lengths: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Blocks by falling length, and how many of them reach each step."""
    sizes = np.asarray(lengths, np.int64)
    order = np.argsort(-sizes, kind="stable")
    steps = int(sizes.max(initial=0))
    return order, len(sizes) - np.searchsorted(np.sort(sizes), np.arange(steps), side="right")


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """The code of each block of ids below ``IDS``."""
    order, active = _ordered([len(b) for b in blocks])
    n, steps = len(blocks), len(active)
    model = _Model(n, steps)
    for lane, block in enumerate(order):
        model.ids[: len(blocks[block]), lane] = blocks[block]
    low, size = np.zeros(n, np.int64), np.full(n, 1 << _WINDOW, np.int64)
    # At most two words of output for an id; the 17th bit of a word is a carry.
    words = np.zeros((2 * steps + 3) * n, np.uint32)
    at = np.arange(n, dtype=np.int64)
    for step in range(steps):
        k = int(active[step])
        model.refresh(step, k)
        low_k, size_k, at_k = low[:k], size[:k], at[:k]
        model.predict(k, size_k)
        x = model.ids[step, :k].astype(np.int32)
        right2 = model.entry2 - model.sure2 == x << 2
        right1 = (model.entry1 - model.sure1 == x << 2) & ~right2
        np.copyto(size_k, np.where(right2, model.size2, model.size1))
        low_k += model.size2 * right1
        rest = np.flatnonzero(~(right2 | right1))
        if len(rest):
            ids = x[rest]
            place = model.at_h[rest] + (ids >> 8)
            share = model.shares.take(place)
            high = share & 0xFFFF
            unit = model.size0.take(rest) >> _SLOT_BITS + 8
            inner = (share >> 16 << 8) + (ids & 255) * high
            low_k[rest] += model.end1.take(rest) + inner * unit
            size_k[rest] = unit * high
        model.learn(k, x, right2, right1)
        out = np.flatnonzero(size_k < _LEAST)
        while len(out):
            low_out, size_out, at_out = low_k.take(out), size_k.take(out), at_k.take(out)
            words[at_out] = (low_out >> _WINDOW - 16).astype(np.uint32)
            at_k[out] = at_out + n
            low_k[out] = (low_out & _LEAST - 1) << 16
            size_out <<= 16
            size_k[out] = size_out
            out = out[size_out < _LEAST]
    for shift in (32, 16, 0):
        words[at] = low >> shift if shift == 32 else low >> shift & 0xFFFF
        at += n
    words, ends = words.reshape(-1, n), at // n
    over = np.zeros(n, np.uint32)
    for row in words[: int(ends.max(initial=0))][::-1]:
        row += over
        np.right_shift(row, 16, out=over)
    words = words.astype(np.uint16)
    codes: list[bytes] = [b""] * n
    for lane, block in enumerate(order):
        codes[block] = words[: ends[lane], lane].astype("<u2").tobytes()
    return codes


def decode(codes: list[bytes], lengths: list[int]) -> list[np.ndarray]:
    """The ids of each block."""
    order, active = _ordered(lengths)
    n, steps = len(codes), len(active)
    # A damaged code may ask for more words than there are: it reads those of other blocks.
    found = [np.frombuffer(codes[block], "<u2") for block in order]
    words = np.concatenate([*found, np.zeros(8, "<u2")]).astype(np.uint16)
    sizes = np.array([len(f) for f in found], np.int64)
    at, last = sizes.cumsum() - sizes, len(words) - 1
    model = _Model(n, steps)
    size, value = np.full(n, 1 << _WINDOW, np.int64), np.zeros(n, np.int64)
    for _ in range(3):
        value = value << 16 | words[np.minimum(at, last)]
        at += 1
    for step in range(steps):
        k = int(active[step])
        model.refresh(step, k)
        size_k, value_k, at_k = size[:k], value[:k], at[:k]
        model.predict(k, size_k)
        right2 = value_k < model.size2
        either = value_k < model.end1
        right1 = right2 ^ either
        x = np.where(right2, model.entry2, model.entry1) >> 2
        np.copyto(size_k, np.where(right2, model.size2, model.size1))
        value_k -= model.size2 * right1
        rest = np.flatnonzero(~either)
        if len(rest):
            inside = value_k.take(rest) - model.end1.take(rest)
            unit = model.size0.take(rest) >> _SLOT_BITS + 8
            # What the shift cuts off the interval is never used.
            inner = np.minimum((inside / unit).astype(np.int64), (_SLOTS << 8) - 1)
            upper = model.slots.take(model.at_s.take(rest) + (inner >> 8))
            place = model.at_h.take(rest) + upper
            share = model.shares.take(place)
            high, base = share & 0xFFFF, share >> 16 << 8
            lower = ((inner - base) / high).astype(np.int64)
            x[rest] = upper.astype(np.int32) << 8 | lower.astype(np.int32)
            value_k[rest] = inside - (base + lower * high) * unit
            size_k[rest] = unit * high
        model.ids[step, :k] = x
        model.learn(k, x, right2, right1)
        out = np.flatnonzero(size_k < _LEAST)
        while len(out):
            size_out, at_out = size_k.take(out) << 16, at_k.take(out)
            value_k[out] = value_k.take(out) << 16 | words.take(np.minimum(at_out, last))
            at_k[out] = at_out + 1
            size_k[out] = size_out
            out = out[size_out < _LEAST]
    blocks: list[np.ndarray] = [np.empty(0, np.int32)] * n
    for lane, block in enumerate(order):
        blocks[block] = model.ids[: lengths[block], lane].copy()
    return blocks
