"""Adaptive range coder of token ids that mixes predictions of orders 0 to 2.

A block of ids is coded on its own, from a fresh state, so any block can be read
without others. The ids of a block are dealt over lanes, runs of LANE_IDS ids
that are coded in lockstep: step t codes the t-th id of every lane with array
operations, and all lanes share one model that learns from every earlier step.

The probability of an id x after the ids b, a is the mixture

    P(x) = u2 [x = c2(b, a)] + u1 [x = c1(a)] + u0 f(x) / F

f / F are the counts of the ids so far (order 0; one for each id of the block
at the start). c1 and c2 are the ids that followed the order-1 and the order-2
context most, kept with a confidence: it rises with each hit, and a miss halves
it until another id takes the place. The weights u adapt: each id adds the share
that each order had in its probability to the sums of its pair of confidences
(the expectation step of a mixture), and u are the shares of these sums.

The coder narrows its range to "c2", "c1" or "another" by their mixed
probabilities, and in the last case by the order-0 counts. Only single
additions, multiplications and divisions of floats take part, so every machine
computes the same numbers.

A coded block: ids, bytes of the alphabet (u32 each), the alphabet (zstandard
over the differences of the sorted distinct ids), words of 16 bits of each lane
(u16), and the lanes' words. Ids are any unsigned 32-bit numbers.
"""

from __future__ import annotations

import struct

import numpy as np
import zstandard as zstd

#: Ids of a lane at most, and of a block (those at the end have up to half as many more).
LANE_IDS, BLOCK_IDS = 512, 1 << 21
#: The range is kept in 62 bits and at least 46; words of 16 leave it.
_TOP, _LEAST, _OUT = 62, 46, 46
_MASK = np.int64((1 << _TOP) - 1)
#: Totals of the first choice (as power of two) and, about, of order 0; weight of a new id.
_KIND, _ORDER0, _STEP = 15, 1 << 18, 32
_CONF = 15
_CELLS = (_CONF + 1) ** 2
_HEAD = struct.Struct("<II")
_TOP_KIND = np.float32((1 << _KIND) - 64)
#: What a confidence, plus 16 after a hit, changes by; at 0 and 1 a miss changes the id.
_CHANGE = np.append(-((np.arange(_CONF + 1) + 1) >> 1), np.arange(_CONF + 1) < _CONF).astype(np.int32)


def _lanes(n: int) -> tuple[int, int]:
    """(lanes, steps); all lanes but the last ones have `steps` ids."""
    lanes = max(1, -(-n // LANE_IDS))
    return lanes, -(-n // lanes) if n else 0


class _Model:
    """What both sides know before step t. Candidates are held as id << 4 |
    confidence; -16 is none, whose probability in order 0 is the 0 after p0's end."""

    def __init__(self, symbols: int, lanes: int, n: int, slots: bool):
        self.v = symbols
        self.count = np.zeros(symbols, np.int64)
        self.bits = max(10, min(21, int(n).bit_length()))
        self.t1 = np.full(symbols + 1, -16, np.int32)
        self.t2 = np.full(1 << self.bits, -16, np.int32)
        self.a = np.zeros(lanes, np.int64)  # symbol + 1, 0 at the start of a lane
        self.b = np.zeros(lanes, np.int64)
        grade = np.arange(_CONF + 1) / (_CONF + 2)
        two, one = np.repeat(grade, _CONF + 1), np.tile(grade, _CONF + 1)
        # Sums of the shares of the orders 2, 1 and 0 by pair of confidences.
        self.sums = np.stack([two * 0.8, (1 - two * 0.8) * one * 0.6, 1 - two * 0.8 - (1 - two * 0.8) * one * 0.6]) * 8
        self.weights = np.zeros((_CELLS, 4), np.float32)
        self.slots, self.seen, self.next = slots, 0, 0
        self.steps: list[np.ndarray] = []

    def order0(self, t: int) -> None:
        """Take the ids of the steps since the last time into the counts."""
        if t < self.next:
            return
        self.next = t + max(1, min(16, t // 4))
        if self.steps:
            new = np.concatenate(self.steps)
            self.steps = []
            self.count += np.bincount(new, minlength=self.v)
            self.seen += len(new)
        self.f = self.count * _ORDER0 // max(self.seen, _ORDER0 // _STEP) + 1
        self.cum = np.zeros(self.v + 1, np.int64)
        np.cumsum(self.f, out=self.cum[1:])
        self.total = int(self.cum[-1])
        self.p0 = np.append(self.f / self.total, 0).astype(np.float32)
        if self.slots:
            self.of = np.repeat(np.arange(self.v, dtype=np.int32), self.f)

    def predict(self, k: int) -> None:
        """Candidates and mixture of the first k lanes."""
        a, b = self.a[:k], self.b[:k]
        self.h2 = ((a * 0x9E3779B1 + b * 0x85EBCA77) & 0xFFFFFFFF) >> (32 - self.bits)
        self.e1, self.e2 = e1, e2 = self.t1.take(a), self.t2.take(self.h2)
        self.k1, self.k2 = e1 & _CONF, e2 & _CONF
        self.c1, self.c2 = e1 >> 4, e2 >> 4
        self.cell = cell = ((self.k2 << 4) | self.k1).astype(np.int64)
        # Four floats in one: the shares of a cell are taken at once.
        self.weights[:, :3] = (self.sums / self.sums.sum(axis=0)).T
        self.u = u = self.weights.view(np.complex128).ravel().take(cell).view(np.float32).reshape(k, 4)
        u2, u1, u0 = u[:, 0], u[:, 1], u[:, 2]
        pa, pb = self.p0.take(self.c2, mode="wrap"), self.p0.take(self.c1, mode="wrap")
        pa *= u0
        pb *= u0
        pa += u2
        pb += u1
        same = (self.c1 == self.c2).nonzero()[0]
        pa[same] += u1[same]
        pb[same] = 0
        # A part is never empty, so that its candidate can be coded.
        pa *= _TOP_KIND
        pb *= _TOP_KIND
        self.fa, self.fb = pa.astype(np.int32).astype(np.int64) + 1, pb.astype(np.int32).astype(np.int64) + 1

    def learn(self, k: int, s: np.ndarray) -> None:
        """s: the ids, as int32."""
        m2, m1 = self.c2 == s, self.c1 == s
        hit = (m2 | m1).nonzero()[0]
        cell = self.cell.take(hit)
        share = self.u.view(np.complex128).ravel().take(hit).view(np.float32).reshape(len(hit), 4)
        two, one = share[:, 0] * m2.take(hit), share[:, 1] * m1.take(hit)
        p = two + one + share[:, 2] * self.p0.take(s.take(hit))
        two, one = np.bincount(cell, two / p, _CELLS), np.bincount(cell, one / p, _CELLS)
        self.sums[0] += two
        self.sums[1] += one
        self.sums[2] += np.bincount(self.cell, minlength=_CELLS) - two - one
        new = (s << 4) | 1
        for table, at, e, x, m in ((self.t1, self.a[:k], self.e1, self.k1, m1), (self.t2, self.h2, self.e2, self.k2, m2)):
            x |= m.astype(np.int32) << 4
            e += _CHANGE.take(x)
            table[at] = np.where(x > 1, e, new)
        self.b[:k] = self.a[:k]
        self.a[:k] = s
        self.a[:k] += 1
        self.steps.append(s)


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """np.unique(ids, return_inverse=True), without sorting for usual vocabularies."""
    top = int(ids.max()) + 1
    if top > max(1 << 18, len(ids)):
        return np.unique(ids, return_inverse=True)
    seen = np.zeros(top, bool)
    seen[ids] = True
    return np.flatnonzero(seen), (np.cumsum(seen, dtype=np.int32) - 1)[ids]


def _turned(grid: np.ndarray) -> np.ndarray:
    """The transpose of a grid in memory, by tiles."""
    out = np.empty(grid.shape[::-1], grid.dtype)
    for i in range(0, len(grid), 256):
        for j in range(0, len(out), 64):
            out[j : j + 64, i : i + 256] = grid[i : i + 256, j : j + 64].T
    return out


def encode(ids: np.ndarray) -> bytes:
    """One block of ids."""
    n = len(ids)
    if not n:
        return _HEAD.pack(0, 0)
    alphabet, symbols = _distinct(ids)
    names = zstd.compress(np.diff(alphabet.astype("<u4"), prepend=np.uint32(0)).astype("<u4").tobytes(), 3)
    lanes, steps = _lanes(n)
    grid = np.zeros(lanes * steps, np.int32)
    grid[:n] = symbols
    grid = _turned(grid.reshape(lanes, steps))
    model = _Model(len(alphabet), lanes, n, False)
    low, span = np.zeros(lanes, np.int64), np.full(lanes, _MASK)
    # Words of all lanes side by side. A word is written where the next one goes and
    # counts once `pos` is past it; carries are added to words and handed on at the end.
    out, pos = np.zeros((steps * 3 + 8) * lanes, np.int32), np.arange(lanes, dtype=np.int64)
    for t in range(steps):
        k = _going(n, lanes, steps, t)
        s = grid[t, :k]
        model.order0(t)
        model.predict(k)
        fa, fb = model.fa, model.fb
        is_a = model.c2 == s
        r = span[:k] >> _KIND
        ab = fa + fb
        lo = ab * r
        q = ((r << _KIND) - lo) // model.total
        at = s.astype(np.int64)
        lo += model.cum.take(at) * q
        sp = model.f.take(at) * q
        a, b = is_a.nonzero()[0], ((model.c1 == s) & ~is_a).nonzero()[0]
        lo[a], sp[a] = 0, fa[a] * r[a]
        r = r[b]
        lo[b], sp[b] = fa[b] * r, fb[b] * r
        lo += low[:k]
        out[pos[(lo > _MASK).nonzero()[0]] - lanes] += 1
        lo &= _MASK
        out[pos[:k]] = (lo >> _OUT).astype(np.int32)
        short = (sp < (1 << _LEAST)).astype(np.int64)
        pos[:k] += short * lanes
        short <<= 4
        lo <<= short
        lo &= _MASK
        sp <<= short
        w = (sp < (1 << _LEAST)).nonzero()[0]
        while w.size:
            lw, sw, pw = lo[w], sp[w] << 16, pos[w]
            out[pw] = lw >> _OUT
            pos[w] = pw + lanes
            lo[w] = (lw << 16) & _MASK
            sp[w] = sw
            w = w[sw < (1 << _LEAST)]
        low[:k], span[:k] = lo, sp
        model.learn(k, s)
    # One more word names a number in the range; what follows it counts as zeros.
    lo = low + ((1 << _OUT) - 1)
    out[pos[lo > _MASK] - lanes] += 1
    out[pos] = (lo & _MASK) >> _OUT
    sizes = pos // lanes + 1
    most = int(sizes.max())
    words = _turned(out[: most * lanes].reshape(most, lanes))[np.arange(most) < sizes[:, None]]
    while (over := np.flatnonzero(words > 0xFFFF)).size:
        words[over] &= 0xFFFF
        words[over - 1] += 1
    return _HEAD.pack(n, len(names)) + names + sizes.astype("<u2").tobytes() + words.astype("<u2").tobytes()


def _going(n: int, lanes: int, steps: int, t: int) -> int:
    """Lanes that have more than t ids: all but some last ones."""
    return min(lanes, (n - t + steps - 1) // steps)


def decode(coded: bytes) -> np.ndarray:
    """The ids that encode() was given."""
    n, size = _HEAD.unpack_from(coded)
    if not n:
        return np.zeros(0, np.uint32)
    names = np.frombuffer(zstd.decompress(coded[_HEAD.size : _HEAD.size + size]), "<u4")
    alphabet = np.cumsum(names, dtype=np.uint32)
    lanes, steps = _lanes(n)
    sizes = np.frombuffer(coded, "<u2", lanes, _HEAD.size + size).astype(np.int64)
    words = np.frombuffer(coded, "<u2", int(sizes.sum()), _HEAD.size + size + 2 * lanes)
    # Each lane's words with zeros after them; cut two bits later, as the first 62 bits of four words start the code.
    width = int(sizes.max()) + 6
    raw = np.zeros((lanes, width), np.int32)
    raw[np.arange(width) < sizes[:, None]] = words
    code = raw[:, 0].astype(np.int64) << 46 | raw[:, 1].astype(np.int64) << 30 | raw[:, 2] << 14 | raw[:, 3] >> 2
    raw[:, :-1] = (raw[:, :-1] & 3) << 14 | raw[:, 1:] >> 2
    raw = _turned(raw).ravel()  # of all lanes side by side
    pos = np.arange(lanes, dtype=np.int64) + 3 * lanes
    model = _Model(len(alphabet), lanes, n, True)
    span = np.full(lanes, _MASK)
    grid = np.zeros((steps, lanes), np.int32)
    for t in range(steps):
        k = _going(n, lanes, steps, t)
        model.order0(t)
        model.predict(k)
        fa, fb = model.fa, model.fb
        r = span[:k] >> _KIND
        c = code[:k]
        ra = fa * r
        rab = ra + fb * r
        is_a = c < ra
        own = (c >= rab).nonzero()[0]
        s = grid[t, :k]
        s[:] = np.where(is_a, model.c2, model.c1)
        start = np.where(is_a, 0, ra)
        sp = np.where(is_a, ra, rab - ra)
        ro = rab.take(own)
        qo = ((r.take(own) << _KIND) - ro) // model.total
        so = model.of.take(np.minimum((c.take(own) - ro) // qo, model.total - 1))
        s[own] = so
        so = so.astype(np.int64)
        start[own] = ro + model.cum.take(so) * qo
        sp[own] = model.f.take(so) * qo
        c -= start
        w = (sp < (1 << _LEAST)).nonzero()[0]
        while w.size:
            sw, pw = sp.take(w) << 16, pos.take(w)
            c[w] = c.take(w) << 16 | raw.take(pw)
            pos[w] = pw + lanes
            sp[w] = sw
            w = w[sw < (1 << _LEAST)]
        span[:k] = sp
        model.learn(k, s)
    return alphabet[_turned(grid).ravel()[:n]]
