"""Content-defined cuts, equal-byte runs and similarity fingerprints of byte strings, vectorised with numpy."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np


@dataclass(frozen=True)
class CdcProfile:
    """Parameters of the cutter; the defaults are the first public profile."""

    sequence: int = 6
    skip_trigger: int = 50
    skip_bytes: int = 1024
    least: int = 16 * 1024
    most: int = 256 * 1024

    def __post_init__(self):
        if min(self.sequence, self.skip_trigger, self.skip_bytes, self.least, self.most) < 1 or self.sequence > 32 or self.least > self.most:
            raise ValueError("a profile needs positive parameters, a sequence of at most 32 and least <= most")

    def canonical(self) -> str:
        return f"seqcdc;sequence={self.sequence};trigger={self.skip_trigger};skip={self.skip_bytes};least={self.least};most={self.most}"


def cuts(raw: bytes, profile: CdcProfile = CdcProfile(), slab: int = 4 << 20) -> list[int]:
    """Ends of the chunks of an object.

    Rises and falls of neighbouring bytes are found for a slab of the object at once. A chunk ends at the byte that completes
    ``sequence`` rises without a fall between; ``skip_trigger`` falls without such an end skip ``skip_bytes`` bytes. Both next events are looked up
    in sorted positions, so the work after the slab's passes goes with the number of skips, not of bytes.
    """
    n, p = len(raw), profile
    data, out, base = np.frombuffer(raw, np.uint8), [], 0
    slab = max(slab, 2 * p.most)
    while base < n:
        start, stop = base, min(n, base + slab)
        begins, ends, falls = _events(data[start:stop], p.sequence)
        last = n if stop == n else stop - p.most  # chunks that begin before it end inside the slab
        while base < last or (base < n and stop == n):
            limit = min(base + p.most, n)
            at, end = base + p.least, limit
            while n - base >= p.least and at < limit:
                i = int(np.searchsorted(begins, at - start))
                cut = int(ends[i]) + start if i < len(ends) else n
                j = int(np.searchsorted(falls, at - start)) + p.skip_trigger - 1
                turn = int(falls[j]) + start if j < len(falls) else n
                if cut < turn:
                    end = min(cut, limit)
                    break
                at = turn + 1 + p.skip_bytes
            out.append(end)
            base = end
    return out


def _events(data: np.ndarray, sequence: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first rise, last rise) of each run of ``sequence`` rises without a fall between, and the falls."""
    up, down = data[1:] > data[:-1], data[1:] < data[:-1]
    rises, falls = np.flatnonzero(up) + 1, np.flatnonzero(down) + 1
    before = np.cumsum(down, dtype=np.int32)[rises - 1]
    k = sequence - 1
    whole = np.flatnonzero(before[k:] == before[: len(before) - k]) if len(rises) > k else np.zeros(0, np.int64)
    return rises[whole], rises[whole + k], falls


def equal_runs(raw: bytes, least: int = 65536) -> list[tuple[int, int, int]]:
    """(begin, end, value) of the maximal runs of one byte of at least ``least`` bytes."""
    if len(raw) < least:
        return []
    b = np.frombuffer(raw, np.uint8)
    edge = np.flatnonzero(b[1:] != b[:-1]) + 1
    begin, end = np.concatenate([[0], edge]), np.concatenate([edge, [len(b)]])
    long = np.flatnonzero(end - begin >= least)
    return [(int(x), int(y), int(b[x])) for x, y in zip(begin[long], end[long])]


def segments(raw: bytes, profile: CdcProfile = CdcProfile(), fill: int | None = 65536) -> list[tuple[str, int, int, int | None]]:
    """(kind, begin, end, fill value): FILL runs, and DATA chunks of what lies between; cutting starts anew after a run."""
    out, at = [], 0
    for begin, end, value in [*(equal_runs(raw, fill) if fill else []), (len(raw), len(raw), 0)]:
        last = at
        for c in cuts(raw[at:begin], profile):
            out.append(("DATA", last, at + c, None))
            last = at + c
        if end > begin:
            out.append(("FILL", begin, end, value))
        at = end
    return out


# Fixed values of the first similarity profile.
SHINGLE, SPAN = 32, 64
BYTE_SEED = 0x6A09E667F3BCC909
FEATURE_SEEDS = (0xBB67AE8584CAA73B, 0x3C6EF372FE94F82B, 0xA54FF53A5F1D36F1, 0x510E527FADE682D1)
SKETCH_SEEDS = (0x9B05688C2B3E6C1F, 0x1F83D9ABFB41BD6B, 0x5BE0CD19137E2179, 0xCBBB9D5DC1059ED8, 0x629A292A367CD507, 0x9159015A3070DD17, 0x152FECD8F70E5939, 0x67332667FFC00B31)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _rotate(x: np.ndarray, k: int) -> np.ndarray:
    return x if k == 0 else (x << np.uint64(k)) | (x >> np.uint64(64 - k))


def fingerprint(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    """(4 superfeatures, 8 sketch words) of a non-empty byte string, as unsigned words.

    The shingle at i is the exclusive or of its bytes' hashes, each turned by its distance from the end; all shingles come from
    those of half the width, shifted and turned. Every SPAN shingles give their smallest; features are the smallest mixed values, sketch bits majority votes.
    """
    data, table = np.frombuffer(raw, np.uint8), _turned()
    width = min(SHINGLE, len(data))
    n = len(data) - width + 1
    if width == SHINGLE:  # two shingles side by side make one of twice the width
        shingles, k = table[0][data], 1
        while k < SHINGLE:
            shingles, k = _rotate(shingles[:-k], k) ^ shingles[k:], 2 * k
    else:
        shingles = np.zeros(n, np.uint64)
        for k in range(width):
            shingles ^= table[width - 1 - k][data[k : k + n]]
    least = np.minimum.reduceat(shingles, np.arange(0, n, SPAN))
    mixed = _mix(least[None, :] ^ np.array(FEATURE_SEEDS + SKETCH_SEEDS, np.uint64)[:, None])
    bits = np.unpackbits(mixed[len(FEATURE_SEEDS) :].view(np.uint8).reshape(len(SKETCH_SEEDS), len(least), 8), axis=2, bitorder="little")
    votes = 2 * bits.sum(axis=1, dtype=np.int64) > len(least)
    return mixed[: len(FEATURE_SEEDS)].min(axis=1), np.packbits(votes, axis=1, bitorder="little").view(np.uint64).ravel()


@lru_cache(maxsize=1)
def _turned() -> np.ndarray:
    """Hashes of all bytes turned by 0 .. SHINGLE - 1 bits."""
    h = _mix(np.uint64(BYTE_SEED) ^ np.arange(256, dtype=np.uint64))
    return np.stack([_rotate(h, k) for k in range(SHINGLE)])


def delta_runs(base: bytes, target: bytes) -> list[tuple[int, bytes]] | None:
    """(offset, exclusive or) of the runs where two strings of one length differ; None for different lengths."""
    if len(base) != len(target):
        return None
    x = np.frombuffer(base, np.uint8) ^ np.frombuffer(target, np.uint8)
    at = np.flatnonzero(x)
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1) + 1
    return [(int(r[0]), x[r[0] : r[-1] + 1].tobytes()) for r in np.split(at, cut)]


def delta_cost(runs: list[tuple[int, bytes]]) -> int:
    """Bytes of a delta: the dependency, the number of runs, an entry for each run and its bytes."""
    return 32 + 4 + sum(8 + len(x) for _, x in runs)


def delta_size(base: bytes, target: bytes) -> int:
    """``delta_cost`` of the ``delta_runs`` of two strings of one length, without the runs."""
    if len(base) != len(target):
        raise ValueError("a delta is between strings of one length")
    x = np.frombuffer(base, np.uint8) != np.frombuffer(target, np.uint8)
    runs = np.count_nonzero(x[:1]) + np.count_nonzero(x[1:] & ~x[:-1])
    return 32 + 4 + 8 * int(runs) + int(np.count_nonzero(x))


def delta_apply(base: bytes, runs: list[tuple[int, bytes]]) -> bytes:
    """The target of a delta; runs must be ordered, apart and without zero bytes."""
    out, last = bytearray(base), -1
    for offset, x in runs:
        if offset <= last or not x or 0 in x or offset + len(x) > len(base):
            raise ValueError("a delta's runs must be ordered, apart, inside the base and without zero bytes")
        out[offset : offset + len(x)] = bytes(a ^ b for a, b in zip(out[offset : offset + len(x)], x))
        last = offset + len(x)
    return bytes(out)
