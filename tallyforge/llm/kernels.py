"""NumPy kernels over the byte buffers of Arrow string columns."""

from __future__ import annotations

import numpy as np

_U = np.uint64


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambler of 64-bit words."""
    x = x ^ (x >> _U(30))
    x = x * _U(0xBF58476D1CE4E5B9)
    x ^= x >> _U(27)
    x = x * _U(0x94D049BB133111EB)
    x ^= x >> _U(31)
    return x


def stream(seed: int, n: int) -> np.ndarray:
    """n fixed pseudorandom 64-bit words of a seed."""
    with np.errstate(over="ignore"):
        return mix(np.arange(1, n + 1, dtype=_U) * _U(0x9E3779B97F4A7C15) + _U(seed))


def utf8(column) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of an Arrow string array: the bytes, and where each row begins and ends in them (null: empty)."""
    wide = str(column.type).startswith("large")
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    begin, end = at[:-1], at[1:].copy()
    if column.null_count:
        valid = np.asarray(column.is_valid())
        end[~valid] = begin[~valid]
    return raw, begin, end


#: Bytes that are worked on at a time, and rows beyond which a text is cut between words for that.
SLICE = 1 << 18


def pieces(data: np.ndarray, begin: int, end: int, most: int = SLICE):
    """Cuts a text [begin, end) behind white space into ranges of about `most` bytes (a longer word stays whole)."""
    space = ~space_table()
    while end - begin > most:
        found = np.flatnonzero(space[data[begin + most // 2 : begin + most]])
        if len(found):
            cut = begin + most // 2 + int(found[-1]) + 1
        else:
            cut = begin + most
            while cut < end and not len(found := np.flatnonzero(space[data[cut : cut + most]])):
                cut += most
            cut = cut + int(found[0]) + 1 if cut < end else end
        yield begin, cut
        begin = cut
    yield begin, end


def slices(begin: np.ndarray, end: np.ndarray, most: int):
    """Row ranges [i, j) whose bytes come to about `most`, at least one row each."""
    i, n = 0, len(begin)
    while i < n:
        j = max(i + 1, int(np.searchsorted(end, begin[i] + most, side="right")))
        yield i, min(j, n)
        i = min(j, n)


def runs(inside: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the maximal runs of True that do not cross a cut (the first byte of a row)."""
    n = len(inside)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    first = inside.copy()
    first[1:] &= ~inside[:-1]
    cuts = cuts[(cuts > 0) & (cuts < n)]
    first[cuts] = inside[cuts]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[cuts - 1] = inside[cuts - 1]
    return np.flatnonzero(first), np.flatnonzero(last) + 1


class Spans:
    """64-bit hashes of byte spans: sums of random byte values times powers of an odd base, scrambled.

    Spans are hashed window by window: memory hangs on WINDOW, however long the data or one span is.
    """

    BASE = 0x9E3779B97F4A7C15 | 1
    WINDOW = 1 << 16

    def __init__(self, seed: int):
        self.values = stream(seed, 256)
        base, back = _U(self.BASE), _U(pow(self.BASE, -1, 1 << 64))
        with np.errstate(over="ignore"):
            self.powers = np.concatenate([np.ones(1, _U), np.cumprod(np.full(self.WINDOW, base))])
            self.inverse = np.concatenate([np.ones(1, _U), np.cumprod(np.full(self.WINDOW, back))])

    def _sums(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Of spans in data (one window at most): each byte's value times the power of its place in the span."""
        sums = np.zeros(len(data) + 1, _U)
        np.cumsum(self.values[data] * self.powers[: len(data)], out=sums[1:])
        return (sums[end] - sums[begin]) * self.inverse[begin]

    def __call__(self, data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
        """begin ascends."""
        out = np.zeros(len(begin), _U)
        with np.errstate(over="ignore"):
            at = 0
            while at < len(begin):
                lo = int(begin[at])
                to = at + max(1, int(np.searchsorted(begin[at:], lo + self.WINDOW)))
                inside = np.flatnonzero(end[at:to] <= lo + self.WINDOW) + at
                out[inside] = self._sums(data[lo : lo + self.WINDOW], begin[inside] - lo, end[inside] - lo)
                for k in np.flatnonzero(end[at:to] > lo + self.WINDOW) + at:
                    out[k] = self._long(data, int(begin[k]), int(end[k]))
                at = to
            return mix(out + (end - begin).astype(_U))

    def _long(self, data: np.ndarray, begin: int, end: int) -> np.uint64:
        total, power = 0, 1
        for lo in range(begin, end, self.WINDOW):
            hi = min(end, lo + self.WINDOW)
            total += power * int((self.values[data[lo:hi]] * self.powers[: hi - lo]).sum(dtype=_U))
            power = power * pow(self.BASE, hi - lo, 1 << 64) % (1 << 64)
        return _U(total % (1 << 64))


def lower_table() -> np.ndarray:
    out = np.arange(256, dtype=np.uint8)
    out[65:91] += 32
    return out


def space_table() -> np.ndarray:
    """True for bytes that are no white space."""
    out = np.ones(256, bool)
    out[[32, 9, 10, 11, 12, 13]] = False
    return out
