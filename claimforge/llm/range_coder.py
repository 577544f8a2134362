"""Adaptive context-mixing range coder for token ids, in blocks that decode on their own.

Within a block the ids are cut into lanes that advance together, one id each a step, so every step is a
few array operations. All lanes share one model, which learns each step's ids after they are coded:

* order 2 and order 1 tables predict one id for a context, with a confidence;
* order 0 is the count of every id so far, starting from small counts that fall with the id (vocabularies
  list common tokens first); its shares are set anew every few steps.

The coded distribution mixes them: an id predicted by order 2, then one by order 1, and the rest goes to all
ids by count. The weights are learnt: for each pair of confidences, how often order 2 was right, and how often
order 1 was where order 2 was not. Each lane drives a carry-less range coder of 64 bits that puts out 32-bit
words; what a lane costs beside its ids is its last word and the number of its words.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

MAGIC = b"CMR2"
LANES = 8192
LEAST_STEPS = 128
BLOCK_IDS = 1 << 21
HEADER = struct.Struct("<4sIIIIII")  # magic, ids, steps, alphabet, bytes of a lane's size, crc32 of the ids, crc32 of what follows
TOTAL_BITS = 27
TOTAL = 1 << TOTAL_BITS
WORD = np.uint64(1 << 32)
LOW_MASK = np.uint64((1 << 32) - 1)
U32 = np.uint64(32)
SHIFT = np.uint64(TOTAL_BITS)
#: Order 0 shares its part in 2^22 units, at least one for each id; predictions leave it as much.
BASE_BITS = 22
#: The decoder keeps the id at every 2^10th unit.
JUMP_BITS = 10
JUMPS = np.arange((1 << BASE_BITS - JUMP_BITS) + 1, dtype=np.int32) << JUMP_BITS
CONTEXTS = 1 << 18
LEVEL_BITS = 4
LEVELS = 1 << LEVEL_BITS
#: One occurrence counts as much as this; the counts an id starts with are ``START / (id + START_OFFSET)`` and one.
ONE = 16
START, START_OFFSET = 4096, 64
#: Steps after which order 0 shares anew, but for the first ones.
EVERY = 4


class Model:
    """What coder and decoder know before a step; ``learn`` takes the step's ids."""

    def __init__(self, alphabet: int, lanes: int):
        self.alphabet = alphabet
        self.counts = START // (np.arange(alphabet, dtype=np.int64) + START_OFFSET) + 1
        self.floor = np.arange(alphabet + 1, dtype=np.int32)
        self.padded = np.full(2 << alphabet.bit_length(), 2**31 - 1, np.int32)
        self.starts = self.padded[: alphabet + 1]
        self.step = 0
        self.share()
        # Predicted id and, in the low bits, confidence; confidence 0 is no prediction, which no id equals.
        self.tables = [np.full(n, alphabet << LEVEL_BITS, np.int32) for n in (alphabet + 1, CONTEXTS)]
        # By order 2's confidence, order 1's, and whether both predict the same.
        cells = 2 * LEVELS * LEVELS
        self.tries, self.hits2, self.hits1 = np.full(cells, 4.0), np.ones(cells), np.ones(cells)
        level2, level1 = np.arange(cells) >> LEVEL_BITS & (LEVELS - 1), np.arange(cells) & (LEVELS - 1)
        self.may2, self.may1 = level2 > 0, (level1 > 0) & (np.arange(cells) < cells // 2)
        self.last = np.full(lanes, alphabet, np.int64)
        self.before = np.full(lanes, alphabet, np.int64)

    def share(self) -> None:
        """Where each id's part of order 0 starts."""
        upto = np.cumsum(self.counts)
        self.starts[0] = 0
        np.add(self.floor[1:], (upto * (((1 << BASE_BITS) - self.alphabet) / upto[-1])).astype(np.int32), out=self.starts[1:])
        self.starts[-1] = 1 << BASE_BITS
        self.jumps = None

    def predict(self, lanes: int) -> None:
        """Predicted ids of the first ``lanes`` lanes and where their shares end; order 0 has the rest."""
        self.n = lanes
        last = self.last[:lanes]
        self.keys = (last, (last * 2654435761 + self.before[:lanes] * 40503) & (CONTEXTS - 1))
        one, two = self.found = tuple(table[key] for table, key in zip(self.tables, self.keys, strict=True))
        self.one, self.two = one >> LEVEL_BITS, two >> LEVEL_BITS
        self.levels = (one & (LEVELS - 1), two & (LEVELS - 1))
        self.cell = (self.levels[1] << LEVEL_BITS) + self.levels[0] + (self.one == self.two) * (LEVELS * LEVELS)
        right2 = np.where(self.may2, self.hits2 / self.tries, 0.0)
        right1 = np.where(self.may1, self.hits1 / (self.tries - self.hits2 + 1.0), 0.0)
        most = TOTAL - (1 << BASE_BITS)
        end2 = (right2 * most).astype(np.int64)
        self.end2 = end2[self.cell]
        self.end1 = (end2 + (right1 * (most - end2)).astype(np.int64))[self.cell]
        self.rest = TOTAL - self.end1

    def base(self, ids: np.ndarray) -> np.ndarray:
        return self.starts[ids] * self.rest >> BASE_BITS

    def interval(self, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Start and size of each id's share: order 2's prediction first, order 1's next, then all ids by count."""
        low = self.base(ids)
        size = self.base(ids + 1) - low
        low += self.end1
        self.hits = (self.one == ids, self.two == ids)
        # A prediction that has no share yet is coded with the rest.
        hit = np.flatnonzero(self.hits[0] & (self.end1 > self.end2))
        low[hit] = self.end2[hit]
        size[hit] = self.end1[hit] - self.end2[hit]
        hit = np.flatnonzero(self.hits[1] & (self.end2 > 0))
        low[hit] = 0
        size[hit] = self.end2[hit]
        return low.view(np.uint64), size.view(np.uint64)

    def find(self, at: np.ndarray) -> np.ndarray:
        """The ids whose shares hold ``at``."""
        ids = np.where(at < self.end2, self.two, self.one).astype(np.int64)
        by_count = np.flatnonzero(at >= self.end1)
        rest = at[by_count] - self.end1[by_count]
        asked = ((((rest + 1) << BASE_BITS) - 1) // self.rest[by_count]).astype(np.int32)
        if self.jumps is None:
            self.jumps = np.searchsorted(self.starts, JUMPS, "right") - 1
            self.span = int(np.diff(self.jumps).max()).bit_length()
        # The last id that starts at or before ``asked``: from that of its jump, all lanes halve what is left.
        place = self.jumps[asked >> JUMP_BITS]
        for bit in range(self.span - 1, -1, -1):
            place += (self.padded[place + (1 << bit)] <= asked).astype(np.int64) << bit
        ids[by_count] = place
        return ids

    def learn(self, ids: np.ndarray) -> None:
        fresh = (ids.astype(np.int32) << LEVEL_BITS) + 1
        for order in (0, 1):
            found, level, hit = self.found[order], self.levels[order], self.hits[order]
            missed = np.where(level > 1, found - level + (level >> 1), fresh)
            self.tables[order][self.keys[order]] = np.where(hit, found + (level < LEVELS - 1), missed)
        cells = len(self.tries)
        self.tries += np.bincount(self.cell, minlength=cells)
        self.hits2 += np.bincount(self.cell[self.hits[1]], minlength=cells)
        self.hits1 += np.bincount(self.cell[self.hits[0] & ~self.hits[1]], minlength=cells)
        np.add.at(self.counts, ids, ONE)
        self.step += 1
        if self.step < EVERY or self.step % EVERY == 0:
            self.share()
        self.before[: self.n] = self.last[: self.n]
        self.last[: self.n] = ids


def layout(n: int) -> tuple[int, int]:
    """Steps and lanes of a block; at step t the lanes ``0 .. ceil((n - t) / steps)`` have an id."""
    steps = max(1, min(n, LEAST_STEPS), -(-n // LANES))
    return steps, -(-n // steps)


def settle(low: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Which lanes must move 32 bits; their range is cut at the next word where it is small but straddles it."""
    same = (low ^ (low + size - np.uint64(1))) < WORD
    small = (size < WORD) & ~same
    if small.any():
        size[small] = (np.uint64(0) - low[small]) & LOW_MASK
    return np.flatnonzero(same | small)


def encode_block(ids: np.ndarray, alphabet: int) -> bytes:
    """One block. Ids are below ``alphabet``, which is at most 2^19."""
    n = len(ids)
    if alphabet > 1 << 19 or n > BLOCK_IDS or (n and int(ids.max()) >= alphabet):
        raise ValueError("ids beyond the alphabet, or a block or alphabet beyond the coder's precision")
    steps, lanes = layout(n)
    grid = np.zeros(steps * lanes, np.int64)
    grid[:n] = ids
    grid = grid.reshape(lanes, steps).T.copy()  # a step's ids side by side
    model = Model(alphabet, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    out_lane, out_word = [], []
    for t in range(steps if n else 0):
        k = -(-(n - t) // steps)
        now = grid[t, :k]
        model.predict(k)
        start, share = model.interval(now)
        unit = size[:k] >> SHIFT
        low[:k] += unit * start
        size[:k] = unit * share
        moved = settle(low[:k], size[:k])
        out_lane.append(moved)
        out_word.append((low[moved] >> U32).astype("<u4"))
        low[moved] <<= U32
        size[moved] <<= U32
        model.learn(now)
    if n:
        out_lane.append(np.arange(lanes))
        out_word.append(((low + LOW_MASK) >> U32).astype("<u4"))
    lane = np.concatenate([*out_lane, np.zeros(0, np.int64)])
    words = np.concatenate([*out_word, np.zeros(0, "<u4")])[np.argsort(lane, kind="stable")]
    sizes = np.bincount(lane, minlength=lanes)
    width = next(w for w in (1, 2, 4) if sizes.max(initial=0) < 1 << 8 * w)
    body = sizes.astype(f"<u{width}").tobytes() + words.astype("<u4").tobytes()
    return HEADER.pack(MAGIC, n, steps, alphabet, width, zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode_block(block: bytes) -> np.ndarray:
    """The ids of one block; a damaged one raises."""
    magic, n, steps, alphabet, width, ids_crc, body_crc = HEADER.unpack_from(block)
    body = block[HEADER.size :]
    if magic != MAGIC or zlib.crc32(body) != body_crc:
        raise ValueError("damaged block")
    if not n:
        return np.zeros(0, "<u4")
    lanes = -(-n // steps)
    sizes = np.frombuffer(body, f"<u{width}", lanes).astype(np.int64)
    words = np.concatenate([np.frombuffer(body, "<u4", offset=width * lanes), np.zeros(2, "<u4")]).astype(np.uint64)
    ends = np.cumsum(sizes)
    at = ends - sizes
    last = len(words) - 1  # a zero: what a lane reads past its end

    def following(which: np.ndarray) -> np.ndarray:
        place = np.where(at[which] < ends[which], at[which], last)
        at[which] += 1
        return words[place]

    every = np.arange(lanes)
    code = following(every) << U32
    code |= following(every)
    model = Model(alphabet, lanes)
    low, size = np.zeros(lanes, np.uint64), np.full(lanes, 2**64 - 1, np.uint64)
    grid = np.zeros((steps, lanes), np.int64)
    for t in range(steps):
        k = -(-(n - t) // steps)
        model.predict(k)
        unit = size[:k] >> SHIFT
        now = model.find(((code[:k] - low[:k]) // unit).astype(np.int64))
        start, share = model.interval(now)
        low[:k] += unit * start
        size[:k] = unit * share
        moved = settle(low[:k], size[:k])
        low[moved] <<= U32
        size[moved] <<= U32
        code[moved] = (code[moved] << U32) | following(moved)
        grid[t, :k] = now
        model.learn(now)
    ids = grid.T.reshape(-1)[:n].astype("<u4")
    if zlib.crc32(ids.tobytes()) != ids_crc:
        raise ValueError("damaged block")
    return ids
