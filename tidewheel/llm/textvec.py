"""Vectorised word scanning over the UTF-8 bytes of whole Arrow text columns.

A batch is cut into chunks of whole rows (about ``CHUNK`` bytes; one longer row makes a chunk of its own), and
inside a chunk everything is a handful of numpy passes: no Python object is made per word.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1 << 18
BASE = 0x9E3779B97F4A7C13  # 3 mod 8, so that powers differ in their low bits
#: Base and prime of a second hash: sums mod 2^64 alone are equal for texts that can be written down, whatever the base.
SECOND, PRIME = 1_103_515_249, (1 << 31) - 1
_U = np.uint64

#: Separators of words: space and \t \n \v \f \r.
SPACE = np.zeros(256, bool)
SPACE[[0x20, 9, 10, 11, 12, 13]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64, elementwise."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * _U(0xD1342543DE82EF95))
#: A byte's number in hashes that ignore the case of A-Z.
_BYTE_LOWER = _BYTE.copy()
_BYTE_LOWER[65:91] = _BYTE[97:123]


class _Powers:
    """Powers of BASE and of its inverse mod 2^64, and of SECOND and its inverse mod PRIME, grown on demand."""

    def __init__(self) -> None:
        self.clear()

    def clear(self) -> None:
        self.up = np.ones(1, np.uint64)
        self.down = np.ones(1, np.uint64)
        self.up2 = np.ones(1, np.uint64)
        self.down2 = np.ones(1, np.uint64)

    def upto(self, n: int) -> None:
        if len(self.up) <= n:
            size = 1 << int(n).bit_length()
            inverse = pow(BASE, -1, 1 << 64)
            for name, base in (("up", BASE), ("down", inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.cumprod(steps, dtype=np.uint64))
            for name, base in (("up2", SECOND), ("down2", pow(SECOND, -1, PRIME))):
                own = np.ones(1, np.uint64)
                while len(own) < size:  # twice as many each time
                    own = np.concatenate([own, own * _U(pow(base, len(own), PRIME)) % _U(PRIME)])
                setattr(self, name, own)

    def shrink(self) -> None:
        """Forget tables that one very long text has grown."""
        if len(self.up) > 4 * CHUNK:
            self.clear()


_powers = _Powers()


def fresh(columns: list[str], *names: str) -> list[str]:
    """The names, each with underscores after it until no column has it."""
    taken = {c.lower() for c in columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def unused(columns: list[str], *names: str) -> None:
    """Refuse names of new columns that a table has already: two of one name couldn't be told apart."""
    taken = {c.lower() for c in columns}
    clash = [n for n in names if n.lower() in taken]
    if clash:
        raise ValueError(f"the table has columns {', '.join(clash)} already: choose other names for the new ones")


def buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = pc.fill_null(column, "")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw, at.astype(np.int64)


def chunks(column: pa.Array, limit: int = CHUNK) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, offsets from 0) of runs of whole rows."""
    raw, at = buffers(column)
    row, n = 0, len(at) - 1
    while row < n:
        end = max(row + 1, int(np.searchsorted(at, at[row] + limit, "right")) - 1)
        yield row, end, raw[at[row] : at[end]], at[row : end + 1] - at[row]
        row = end


def words(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, first word of each row and the number of words) of ``[^\\x20\\x09-\\x0D]+``."""
    solid = ~SPACE[data]
    start, end = solid.copy(), solid.copy()
    start[1:] &= ~solid[:-1]
    end[:-1] &= ~solid[1:]
    edges = offsets[1:-1]
    edges = edges[(edges > 0) & (edges < len(data))]
    start[edges] = solid[edges]
    end[edges - 1] = solid[edges - 1]
    starts, ends = np.flatnonzero(start), np.flatnonzero(end) + 1
    return starts, ends, np.searchsorted(starts, offsets)


def prefix(data: np.ndarray, lower: bool) -> np.ndarray:
    """Prefix hashes: the difference of two is the hash of what is between, times a power of BASE."""
    _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_LOWER if lower else _BYTE)[data] * _powers.up[: len(data)], out=total[1:])
    return total


def spans(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte ranges [start, end)."""
    return mix((total[ends] - total[starts]) * _powers.down[starts] + (ends - starts).astype(np.uint64))


def prefix2(data: np.ndarray, lower: bool) -> np.ndarray:
    """The like of ``prefix`` mod PRIME."""
    _powers.upto(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    value = (_BYTE_LOWER if lower else _BYTE)[data] >> _U(34)
    np.cumsum(value * _powers.up2[: len(data)] % _U(PRIME), out=total[1:])
    return total


def spans2(total: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return (total[ends] - total[starts]) % _U(PRIME) * _powers.down2[starts] % _U(PRIME)


def hash_spans(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = True) -> np.ndarray:
    """64-bit hashes of byte ranges from two independent sums."""
    return mix(spans(prefix(data, lower), starts, ends) + mix(spans2(prefix2(data, lower), starts, ends) + _U(1)))


def word_hashes(data: np.ndarray, offsets: np.ndarray, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each word, first word of each row and the number of words)."""
    starts, ends, rows = words(data, offsets)
    return hash_spans(data, starts, ends, lower), rows


def hash_word(word: bytes, lower: bool = True) -> int:
    """The hash that ``word_hashes`` gives one word."""
    data = np.frombuffer(word, np.uint8)
    return int(hash_spans(data, np.array([0]), np.array([len(data)]), lower)[0])


def windows(hashes: np.ndarray, w: int) -> np.ndarray:
    """Hash of each run of ``w`` values (over row ends too; callers cut there)."""
    n = len(hashes) - w + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for i in range(w):
        total = mix(total + hashes[i : i + n] + _U(i + 1))
    return total


def row_shingles(hashes: np.ndarray, rows: np.ndarray, w: int) -> Iterator[np.ndarray]:
    """The sorted distinct shingle hashes of each row; of fewer than ``w`` words, the whole sequence is one."""
    all_windows = windows(hashes, w)
    for a, b in zip(rows[:-1].tolist(), rows[1:].tolist(), strict=True):
        if b - a >= w:
            yield np.unique(all_windows[a : b - w + 1])
        elif b > a:
            yield windows(hashes[a:b], b - a)
        else:
            yield np.zeros(0, np.uint64)
