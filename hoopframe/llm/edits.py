"""Bounded edit distances: of one pair with bits of whole numbers, of many pairs side by side with numpy."""

from __future__ import annotations

import numpy as np

LONGEST = 1 << 16  # characters of both texts up to which pairs go side by side
SHORT = 320  # and up to which a pair's edit table goes cell by cell, not 64 cells at a time
LETTERS = 256  # different characters of texts whose tables go 64 cells at a time
FEWEST = 24  # pairs that go side by side; fewer go one by one
MOST = 4096
CHARACTERS, BY_WORDS = 1 << 19, 1 << 21  # of the pairs that go side by side, about
PAUSE = 32  # diagonals after which pairs that are too far apart go


def within(a: str, b: str, most: int) -> bool:
    """Whether at most so many edits of single characters turn a into b.

    What both start and end with goes first. The columns of the edit table
    are the bits of two whole numbers: where it rises and where it falls.
    """
    if abs(len(a) - len(b)) > most:
        return False
    x, y = (np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32) for s in (a, b))
    short = min(len(x), len(y))
    other = np.flatnonzero(x[:short] != y[:short])
    head = int(other[0]) if len(other) else short
    other = np.flatnonzero(x[::-1][: short - head] != y[::-1][: short - head])
    tail = int(other[0]) if len(other) else short - head
    a, b = a[head : len(a) - tail], b[head : len(b) - tail]
    if max(len(a), len(b)) <= most:
        return True
    places: dict[str, int] = {}
    for i, c in enumerate(a):
        places[c] = places.get(c, 0) | 1 << i
    whole = (1 << len(a)) - 1
    top, up, down, edits, left = 1 << max(len(a) - 1, 0), whole, 0, len(a), len(b)
    for c in b:
        left -= 1
        same = places.get(c, 0)
        across = (((same & up) + up) ^ up) | same
        plus, minus = down | ~(across | up) & whole, up & across
        if plus & top:
            edits += 1
            if edits - left > most:
                return False
        elif minus & top:
            edits -= 1
        plus, minus = (plus << 1 | 1) & whole, minus << 1 & whole
        across = same | down
        up, down = minus | ~(across | plus) & whole, plus & across
    return edits <= most


class Texts:
    """Texts whose pairs are compared side by side."""

    def __init__(self, texts: list[str]):
        self.texts, self.size = texts, np.array([len(t) for t in texts], np.int64)
        self.start = np.cumsum(self.size) - self.size
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        top = int(codes.max(initial=0))
        self.codes = codes.astype(np.uint8) if top < 1 << 8 else codes.astype(np.uint16) if top < 1 << 16 else codes

    def within(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """For pairs of places (a, b): whether at most so many edits turn one text into the other."""
        out = np.abs(self.size[a] - self.size[b]) <= most
        left = np.flatnonzero(out & (np.minimum(self.size[a], self.size[b]) > 0))
        both = (self.size[a] + self.size[b])[left]
        long = both > LONGEST
        alone, lo = [left[long]], 0
        left, both = left[~long], both[~long]
        apart = np.abs(self.size[a] - self.size[b])[left]
        order = np.lexsort((apart, -np.floor(8 * np.log2(np.maximum(both, 1)))))  # of about one length, those of one band together
        left, both = left[order], both[order]
        while lo < len(left):
            short = both[lo] <= SHORT
            own = left[lo : lo + min(MOST, max(FEWEST, (CHARACTERS if short else BY_WORDS) // max(int(both[lo]), 1)))]
            own = own[: int((both[lo : lo + len(own)] * 2 >= both[lo]).sum())]  # lengths fall, but for an eighth of a power of two
            lo += len(own)
            if len(own) < FEWEST:
                alone.append(own)
            else:
                out[own] = (self._by_cells if short else self._by_words)(a[own], b[own], most[own])
        for k in np.concatenate(alone):
            out[k] = within(self.texts[a[k]], self.texts[b[k]], int(most[k]))
        return out

    def _by_cells(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The edit tables of all pairs, a column each, by diagonals of cells (i, t - i), in the band that so many edits leave.

        A cell depends on those before it only, so what follows a text in its column does no harm.
        """
        shorter = self.size[a] <= self.size[b]
        a, b = np.where(shorter, a, b), np.where(shorter, b, a)
        rows, n_b = self.size[a], int(self.size[b].max())
        total, apart, n_a = rows + self.size[b], self.size[b] - rows, int(rows.max())
        low, high = -int(((most - apart) // 2).max()), int(((most + apart) // 2).max())
        small = int(most.max()) < 250
        far, kind = (253, np.uint8) if small else (65000, np.uint16)  # over any number of edits allowed
        x = self.codes.take(self.start[a] + np.arange(n_a)[:, None], mode="clip")
        y = self.codes.take(self.start[b] + np.arange(n_b)[::-1, None], mode="clip")
        before, last, now = (np.full((n_a + 3, len(a)), far, kind) for _ in range(3))  # cell i at i + 1
        last[1] = 0
        out, place = np.zeros(len(a), bool), np.arange(len(a))
        differ, ends = np.empty((n_a + 3, len(a)), bool), set(total.tolist())
        for t in range(1, int(total.max()) + 1):
            first, stop = max(0, t - n_b, -((high - t) // 2)), min(n_a, t, (t - low) // 2)
            i, j = max(first, 1), min(stop, t - 1) + 1
            if i < j:
                cell, over, new = now[i + 1 : j + 1], before[i:j], differ[: j - i]
                np.minimum(last[i:j], last[i + 1 : j + 1], out=cell)
                np.minimum(cell, far, out=cell)
                cell += 1
                np.not_equal(x[i - 1 : j - 1], y[n_b - t + i : n_b - t + j], out=new)
                over += new.view(np.uint8)  # nobody reads this diagonal after that
                np.minimum(cell, over, out=cell)
            if first == 0:
                now[1] = min(t, far)
            if stop == t:
                now[t + 1] = min(t, far)
            now[first], now[stop + 2] = far, far
            if t in ends:
                ended = np.flatnonzero(total == t)
                out[place[ended]] = now[rows[ended] + 1, ended] <= most[ended]
            before, last, now = last, now, before
            if t % PAUSE == 0:
                edge = slice(max(first - 1, 0), stop + 3)
                alive = (np.minimum(last[edge].min(axis=0), before[edge].min(axis=0)) <= most) & (total > t)
                if not alive.any():
                    break
                if alive.mean() < 0.75:
                    place, rows, total, most = place[alive], rows[alive], total[alive], most[alive]
                    x, y, before, last, now = (np.ascontiguousarray(v[:, alive]) for v in (x, y, before, last, now))
                    differ = np.empty((n_a + 3, len(place)), bool)
        return out

    def _by_words(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """The edit tables of all pairs, 64 rows of a column in the bits of two words: where it rises and where it falls.

        At each step a word is one column behind the word above it, whose last
        row it goes on from. Words outside the band that so many edits leave
        are taken to rise, which makes no cell smaller.
        """
        shorter = self.size[a] <= self.size[b]
        a, b = np.where(shorter, a, b), np.where(shorter, b, a)
        rows, columns = self.size[a], self.size[b]
        n_b, apart = int(columns.max()), columns - rows
        low, high = -int(((most - apart) // 2).max()), int(((most + apart) // 2).max())
        high = max(high, low + 1)  # so that a word starts while the one above goes on
        words = -(-int(rows.max()) // 64)
        y = self.codes.take(self.start[b] + np.arange(n_b)[:, None], mode="clip")
        texts, own = np.unique(a, return_inverse=True)
        x = self.codes.take(self.start[texts][:, None] + np.arange(64 * words), mode="clip")
        letters = np.flatnonzero(np.bincount(y.ravel())) if y.itemsize < 4 else np.unique(y)
        if len(letters) > LETTERS:
            return self._by_cells(a, b, most)
        equal = np.empty((len(texts), words, len(letters)), np.uint64)
        for k, letter in enumerate(letters):
            equal[:, :, k] = np.packbits(x == letter, axis=1, bitorder="little").view(np.uint64)
        equal = equal.ravel()
        at = np.zeros(int(letters[-1]) + 1, np.int64)
        at[letters] = np.arange(len(letters))
        where = at[y] + own * (words * len(letters))
        n, one, all_ones = len(a), np.uint64(1), ~np.uint64(0)
        up, down = np.full((words, n), all_ones), np.zeros((words, n), np.uint64)
        rise, fall = np.ones((words + 1, n), np.uint64), np.zeros((words + 1, n), np.uint64)  # of the last row of the word before
        score = np.zeros((words + 1, n), np.int64)  # of the last row of the word before
        score[1:] = 64 * np.arange(1, words + 1)[:, None]
        last, ends = (rows - 1) // 64, columns + (rows - 1) // 64  # the word and the step of the last cell
        out, place, stops, started, retired = np.zeros(n, bool), np.arange(n), set(ends.tolist()), 0, 0
        offsets = (np.arange(words) * len(letters))[:, None]
        buffers = [np.empty((words, n), np.uint64) for _ in range(4)]
        for s in range(1, int(ends.max()) + 1):
            first, stop = max(0, s - n_b, -((64 + high - s) // 65)), min(words - 1, s - 1, (s - 1 - low) // 65) + 1
            while started < stop:  # from the word above, as it was a column before
                if started:
                    score[started + 1] = score[started] - rise[started].view(np.int64) + fall[started].view(np.int64) + 64
                started += 1
            w = slice(first, stop)
            eq, xv, t, h = (v[: stop - first] for v in buffers)
            pv, mv, over, under = up[w], down[w], rise[w], fall[w]
            np.take(equal, where[s - stop : s - first][::-1] + offsets[w], out=eq, mode="clip")
            np.bitwise_or(eq, mv, out=xv)
            np.bitwise_or(eq, under, out=eq)
            np.bitwise_and(eq, pv, out=t)
            np.add(t, pv, out=t)
            np.bitwise_xor(t, pv, out=t)
            np.bitwise_or(t, eq, out=t)
            np.bitwise_or(t, pv, out=h)
            np.invert(h, out=h)
            np.bitwise_or(h, mv, out=h)  # rises to the right
            np.bitwise_and(t, pv, out=t)  # falls to the right
            np.right_shift(h, np.uint64(63), out=pv)
            np.right_shift(t, np.uint64(63), out=mv)
            np.left_shift(h, one, out=h)
            np.bitwise_or(h, over, out=h)
            np.left_shift(t, one, out=t)
            np.bitwise_or(t, under, out=t)
            after = slice(first + 1, stop + 1)
            rise[after], fall[after] = pv, mv
            score[after] += pv.view(np.int64)
            score[after] -= mv.view(np.int64)
            np.bitwise_or(xv, h, out=pv)
            np.invert(pv, out=pv)
            np.bitwise_or(pv, t, out=pv)
            np.bitwise_and(h, xv, out=mv)
            while retired < first:
                retired += 1
                rise[retired], fall[retired] = 1, 0
            if s in stops:
                ended = np.flatnonzero(ends == s)
                r, beyond = last[ended], all_ones << ((rows[ended] - 1) % 64).astype(np.uint64) << one
                below = np.bitwise_count(up[r, ended] & beyond).astype(int) - np.bitwise_count(down[r, ended] & beyond)
                out[place[ended]] = score[r + 1, ended] - below <= most[ended]
            if s % PAUSE == 0:
                ends_at = score[first + 1 : stop + 1]
                least = ends_at[0] - 64 if len(ends_at) == 1 else np.minimum(ends_at[0] - 64, (ends_at[:-1] + ends_at[1:] - 65).min(axis=0) // 2)
                alive = (least <= most) & (ends > s)
                if not alive.any():
                    break
                if alive.mean() < 0.75:
                    place, rows, most, last, ends = (v[alive] for v in (place, rows, most, last, ends))
                    where, up, down, rise, fall, score = (np.ascontiguousarray(v[:, alive]) for v in (where, up, down, rise, fall, score))
                    buffers = [np.empty((words, len(place)), np.uint64) for _ in range(4)]
        return out
