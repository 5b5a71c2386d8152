"""Levenshtein's distance of long sequences, exact, in bands of bit vectors that follow where a cheapest way can be."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Columns after which the band is chosen anew; edits beyond those that the symbols' numbers ask for which are tried
#: first at least, else a SHAREth of the length; bits of a block's places that are made at once.
STEP, LEAST, SHARE, BITS = 512, 64, 64, 1 << 22


def edits(one: Sequence, two: Sequence) -> int:
    """The least number of insertions, deletions and replacements that make one of two.

    Ways of more edits than a limit are left out, so what is found within the limit is exact; else the limit rises,
    until it is what the ways along the diagonal take."""
    rows, columns = _codes(one, two)
    n = min(len(rows), len(columns))
    start = _alike(rows[:n], columns[:n])
    rows, columns = rows[start:], columns[start:]
    n -= start
    end = _alike(rows[::-1][:n], columns[::-1][:n])
    rows, columns = rows[: len(rows) - end], columns[: len(columns) - end]
    if len(rows) < len(columns):
        rows, columns = columns, rows
    m, n = len(rows), len(columns)
    most = m - n + int(np.count_nonzero(rows[:n] != columns))
    ways = _Ways(rows, columns)
    least = int(ways.ahead(0, 0, 0)[0])
    spare = max(LEAST, m // SHARE)
    while least < most:
        found = ways.within(min(most, least + spare))
        if found is not None:
            return found
        spare *= 2
    return most


def _codes(one: Sequence, two: Sequence) -> tuple[np.ndarray, np.ndarray]:
    """Both with a number from 0 on for each of their symbols."""
    if isinstance(one, str):
        both = np.frombuffer((one + two).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        seen = np.zeros(int(both.max(initial=0)) + 1, dtype=bool)
        seen[both] = True
        codes = (np.cumsum(seen) - 1)[both]
    else:
        known: dict = {}
        codes = np.fromiter((known.setdefault(x, len(known)) for s in (one, two) for x in s), dtype=np.int64, count=len(one) + len(two))
    return codes[: len(one)], codes[len(one) :]


def _alike(one: np.ndarray, two: np.ndarray) -> int:
    """The number of symbols before the first that differs."""
    apart = one != two
    return int(apart.argmax()) if apart.any() else len(apart)


class _Ways:
    """The ways through the table of rows and columns, which stands for the edits that make one of the other."""

    def __init__(self, rows: np.ndarray, columns: np.ndarray):
        self.rows, self.columns = rows, columns
        self.kinds = int(max(rows.max(initial=-1), columns.max(initial=-1))) + 1
        # How many of a row's symbol there are from that row on.
        ends = np.cumsum(np.bincount(rows, minlength=self.kinds))
        order = np.argsort(rows.astype(np.uint16) if self.kinds <= 1 << 16 else rows, kind="stable")
        self.left = np.empty(len(rows), dtype=np.int64)
        self.left[order] = ends[rows[order]] - np.arange(len(rows))

    def ahead(self, low: int, high: int, at: int) -> np.ndarray:
        """For each of low to high rows that are done when at columns are: the edits that what is left needs at least,
        as each makes at most one symbol of a side one of the other."""
        rows, have = self.rows, np.bincount(self.columns[at:], minlength=self.kinds)
        shared = np.empty(high - low + 1, dtype=np.int64)
        shared[-1] = np.minimum(np.bincount(rows[high:], minlength=self.kinds), have).sum()
        shared[:-1] = np.cumsum((self.left[low:high] <= have[rows[low:high]])[::-1])[::-1] + shared[-1]
        return np.maximum(len(rows) - np.arange(low, high + 1), len(self.columns) - at) - shared

    def within(self, limit: int) -> int | None:
        """The cost of the cheapest way, if it is no more than limit.

        Myers's bit vectors over the rows that a way within the limit can come through in each STEP of columns: a
        way's cost so far and what it needs ahead tell whether it can.  Rows above count one more with each column and
        rows below one more with each row, neither of which is ever too little."""
        m, n = len(self.rows), len(self.columns)
        # The first and number of the band's rows, and the first and costs of those of them that can be on a way.
        base = size = low = plus = minus = 0
        costs = np.zeros(1, dtype=np.int64)
        for at in range(0, n, STEP):
            own = self.columns[at : at + STEP]
            # The costs of neighbours differ by 1 at most, so a row costs what the one on its diagonal did at least, or
            # what the nearest did and the rows between.
            high = low + len(costs) - 1
            reach = min(m, high + len(own) + max(0, limit - int(costs[-1])))
            ahead = self.ahead(low, reach, at + len(own))
            came = np.arange(low, reach + 1) - len(own)
            near = np.clip(came, low, high)
            can = np.flatnonzero(costs[near - low] + np.abs(came - near) + ahead <= limit)
            if not len(can):
                return None
            gone, kept, size = low - base, size - (low - base), int(can[-1])
            mask = (1 << size) - 1
            plus, minus, base = plus >> gone & mask, minus >> gone & mask, low
            plus |= mask >> kept << kept
            for here in map(self._places(own, low, low + size).__getitem__, own.tolist()):
                here |= minus
                same = ((((here & plus) + plus) ^ plus) | here) & mask
                up = (minus | (same | plus) ^ mask) << 1 | 1
                plus = ((plus & same) << 1 | (same | up) ^ mask) & mask
                minus = up & same
            costs = int(costs[0]) + len(own) + np.concatenate([[0], np.cumsum(_bits(plus, size) - _bits(minus, size))])
            can = np.flatnonzero(costs + ahead[: size + 1] <= limit)
            if not len(can):
                return None
            low, costs = base + int(can[0]), costs[can[0] : can[-1] + 1]
        return int(costs[-1]) if low + len(costs) - 1 == m else None

    def _places(self, own: np.ndarray, low: int, high: int) -> dict[int, int]:
        """For each symbol of own, a bit for each of the rows from low to before high that have it."""
        part, kinds, out = self.rows[low:high], np.unique(own), []
        for at in range(0, len(kinds), each := max(1, BITS // max(1, len(part)))):
            out += [int.from_bytes(x.tobytes(), "little") for x in np.packbits(kinds[at : at + each, None] == part, axis=1, bitorder="little")]
        return dict(zip(kinds.tolist(), out, strict=True))


def _bits(x: int, n: int) -> np.ndarray:
    return np.unpackbits(np.frombuffer(x.to_bytes(n // 8 + 1, "little"), dtype=np.uint8), bitorder="little", count=n).astype(np.int8)
