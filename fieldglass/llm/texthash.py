"""Hashes of words and other byte runs, for many texts at once, with numpy."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SEGMENT = 1 << 18  # bytes hashed together; a longer text is cut between words
_BASE = 0x9E3779B97F4A7C15 | 1
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers whose output bits look random."""
    x = x.astype(np.uint64, copy=True)
    x += np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def seed_number(seed: int) -> np.uint64:
    return mix(np.array([seed], np.uint64))[0]


_BYTE = mix(np.arange(256, dtype=np.uint64) + np.uint64(7))
_powers = _inverse = np.ones(1, np.uint64)


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _powers, _inverse
    if len(_powers) < n:
        size = max(n, SEGMENT + 1)

        def table(base: int) -> np.ndarray:
            out = np.full(size, base, np.uint64)
            out[0] = 1
            return np.multiply.accumulate(out)

        _powers, _inverse = table(_BASE), table(pow(_BASE, -1, 1 << 64))
    return _powers, _inverse


def run_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run data[start:end], equal for equal runs wherever they lie."""
    powers, inverse = _power_tables(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * powers[: len(data)], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def groups_of_texts(sizes: list[int], limit: int = SEGMENT) -> Iterator[tuple[int, int]]:
    """Ranges of rows whose sizes add up to about the limit; a larger row stands alone."""
    start = total = 0
    for i, size in enumerate(sizes):
        if total and total + size > limit:
            yield start, i
            start, total = i, 0
        total += size + 1
    if start < len(sizes):
        yield start, len(sizes)


def _segments(data: bytes) -> list[bytes]:
    """Cut between words into pieces of about SEGMENT bytes."""
    out, at = [], 0
    while len(data) - at > SEGMENT:
        cut = at + SEGMENT
        view = np.frombuffer(data, np.uint8, offset=cut)
        stop = cut
        for lo in range(0, len(view), SEGMENT):
            found = np.flatnonzero(_SPACE[view[lo: lo + SEGMENT]])
            if len(found):
                stop = cut + lo + int(found[0])
                break
        else:
            break
        out.append(data[at:stop])
        at = stop
    out.append(data[at:])
    return out


def _words(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    data = np.frombuffer(b" ".join(pieces) + b" ", np.uint8)
    space = _SPACE[data]
    before = np.empty_like(space)
    before[0], before[1:] = True, space[:-1]
    starts = np.flatnonzero(before & ~space)
    ends = np.flatnonzero(space & ~before)
    firsts = np.zeros(len(pieces) + 1, np.int64)
    np.cumsum([len(p) + 1 for p in pieces], out=firsts[1:])
    return run_hashes(data, starts, ends), np.searchsorted(starts, firsts)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the lower-cased words of all texts, in order, and each text's place among them.

    Words are runs of anything but ASCII white space; text i has the hashes [place[i], place[i + 1]).
    """
    encoded = [t.lower().encode() for t in texts]
    parts, places, total = [], [np.zeros(1, np.int64)], 0
    for lo, hi in groups_of_texts([len(e) for e in encoded]):
        if hi - lo == 1 and len(encoded[lo]) > SEGMENT:
            count = 0
            for piece in _segments(encoded[lo]):
                hashes, _ = _words([piece])
                parts.append(hashes)
                count += len(hashes)
            places.append(np.array([total + count]))
        else:
            hashes, place = _words(encoded[lo:hi])
            parts.append(hashes)
            places.append(total + place[1:])
        total = int(places[-1][-1])
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.concatenate(places)
