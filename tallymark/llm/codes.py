"""Texts as arrays of code points: splitting and hashing of whole batches without a loop over words."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points that are worked on at once; a longer text is a batch of its own.
BATCH_CHARS = 1 << 18
BATCH_ROWS = 1 << 14
_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """The 64-bit finalizer of splitmix; a bijection."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def slices(batch: pa.RecordBatch, text_col: str, chars: int = BATCH_CHARS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch with at most ``chars`` characters and BATCH_ROWS rows, or one row."""
    lengths = pc.fill_null(pc.utf8_length(batch.column(batch.schema.get_field_index(text_col))), 0).to_numpy(zero_copy_only=False)
    ends, start = np.cumsum(lengths), 0
    while start < batch.num_rows:
        room = (ends[start - 1] if start else 0) + chars
        stop = min(max(start + 1, int(np.searchsorted(ends, room, "right"))), start + BATCH_ROWS)
        yield batch.slice(start, stop - start)
        start = stop


def points(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """All code points, and where each text begins and the last ends; null is empty."""
    texts = [t or "" for t in texts]
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum(np.fromiter(map(len, texts), np.int64, len(texts)), out=offsets[1:])
    return np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32), offsets


def word_spans(cps: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs without ASCII white space; no run crosses texts."""
    inner = ~((cps == 32) | ((cps >= 9) & (cps <= 13)))
    begins = inner.copy()
    begins[1:] &= ~inner[:-1]
    firsts = offsets[:-1][offsets[:-1] < offsets[1:]]
    begins[firsts] = inner[firsts]
    stops = inner.copy()
    stops[:-1] &= ~inner[1:]
    lasts = offsets[1:][offsets[:-1] < offsets[1:]] - 1
    stops[lasts] = inner[lasts]
    return np.flatnonzero(begins), np.flatnonzero(stops) + 1


def run_hashes(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each run: the sum over its signs of what sign and place together are mixed to.

    No product carries over from one sign to the next, so that patterns such as the Thue-Morse
    sequence do not cancel out. Runs come in order and do not overlap.
    """
    out = np.zeros(len(starts), np.uint64)
    low = 0
    while low < len(starts):  # in parts, so that a long text needs no long arrays
        high = max(low + 1, int(np.searchsorted(ends, starts[low] + BATCH_CHARS, "right")))
        base, s, e = starts[low], starts[low:high] - starts[low], ends[low:high] - starts[low]
        place = np.zeros(e[-1], np.int64)
        place[s] = np.diff(s, prepend=0)
        np.cumsum(place, out=place)
        np.subtract(np.arange(e[-1]), place, out=place)
        keyed = place.view(np.uint64)
        keyed *= _ODD
        keyed += cps[base : base + e[-1]]
        sums = np.zeros(e[-1] + 1, np.uint64)
        np.cumsum(mixed(keyed), out=sums[1:])
        out[low:high] = mixed(sums[e] - sums[s] + (e - s).astype(np.uint64))
        low = high
    return out


def distinct_runs(cps: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(a run of each kind, the kind of each run, hashes): two runs are of one kind only if all their signs are equal.

    Equal hashes are compared sign by sign; if ever two runs with one hash differ, all are told apart by their signs.
    """
    hashes = run_hashes(cps, starts, ends)
    _, first, which = np.unique(hashes, return_index=True, return_inverse=True)
    size, twin = ends - starts, first[which]
    other = np.flatnonzero(twin != np.arange(len(starts)))
    alike = (size[other] == size[twin[other]]).all()
    for i in range(0, len(other), BATCH_ROWS) if alike else ():
        part = other[i : i + BATCH_ROWS]
        at, n = flat_ranges(size[part]), size[part]
        if (cps[np.repeat(starts[part], n) + at] != cps[np.repeat(starts[twin[part]], n) + at]).any():
            alike = False
            break
    if not alike:
        known: dict[bytes, int] = {}
        which = np.array([known.setdefault(cps[s:e].tobytes(), len(known)) for s, e in zip(starts.tolist(), ends.tolist(), strict=True)], np.int64)
        _, first = np.unique(which, return_index=True)
    return first, which, hashes


def owner(offsets: np.ndarray, at: np.ndarray) -> np.ndarray:
    """The text that each place is in."""
    return np.searchsorted(offsets, at, "right") - 1


def flat_ranges(counts: np.ndarray) -> np.ndarray:
    """0..c-1 for each count, one after the other."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - counts, counts)
