"""Words without punctuation, as hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from podium.llm.common import BASE, INVERSE, blocks, group_rows, hashed_words, mix, powers, text_bytes

_PUNCTUATION = [c for c in range(33, 127) if not chr(c).isalnum()]
_CLASSES = np.ones(256, np.uint8)
_CLASSES[_PUNCTUATION] = 2
_CLASSES[[*range(9, 14), 32]] = 0
#: Bytes of text that are cut into words at a time, so that what is made on the way stays in the processor's cache.
_PIECE_BYTES = 100_000
#: Groups whose numbers are looked through at a time.
_GROUPS = 64


def content_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """For each text its number of words, and the hashes of all of them.

    Lower-cased, split at white space and ASCII punctuation; punctuation itself is no word.
    """
    counts, hashes = [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
    for piece in blocks([pa.RecordBatch.from_arrays([texts], ["text"])], "text", _PIECE_BYTES):
        lower = pc.utf8_lower(pc.fill_null(piece.column("text"), ""))
        found, hashed, starts, _ = hashed_words(lower, _CLASSES)
        word = _CLASSES[text_bytes(lower)[0][starts]] == 1
        counts.append(np.bincount(group_rows(found)[word], minlength=len(lower)))
        hashes.append(hashed[word])
    return np.concatenate(counts), np.concatenate(hashes)


def running_sums(hashes: np.ndarray) -> np.ndarray:
    """What ``sequences`` takes its hashes from, to be made once for several calls."""
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(hashes * powers(BASE, len(hashes)), out=sums[1:])
    return sums


def sequences(hashes: np.ndarray, starts: np.ndarray, lengths: np.ndarray, sums: np.ndarray | None = None) -> np.ndarray:
    """Hashes of the sequences of ``lengths`` words that begin at ``starts``; the same wherever the same words stand."""
    sums = running_sums(hashes) if sums is None else sums
    return mix((sums[starts + lengths] - sums[starts]) * powers(INVERSE, len(hashes) + 1)[starts] + lengths.astype(np.uint64))


def distinct_buckets(counts: np.ndarray, buckets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """For each text the number of its distinct buckets (0 to n - 1), and all of these, sorted by text."""
    pairs = np.unique(group_rows(counts) * np.int64(n) + buckets)
    return np.bincount(pairs // n, minlength=len(counts)).astype(np.int64), pairs % n


def last_places(groups: np.ndarray, numbers: np.ndarray, n: int) -> np.ndarray:
    """Marks where each number (0 to n - 1) stands last in its group; groups are numbered in ascending order."""
    last = np.zeros(len(groups), bool)
    seen = np.zeros(_GROUPS * n, np.int32)  # what it holds of other groups is never read
    bounds = np.searchsorted(groups, np.arange(0, groups[-1] + 1 + _GROUPS, _GROUPS)) if len(groups) else []
    for k, (low, high) in enumerate(zip(bounds[:-1], bounds[1:])):
        pairs, places = (groups[low:high] - k * _GROUPS) * n + numbers[low:high], np.arange(high - low, dtype=np.int32)
        seen[pairs] = places  # of equal pairs the last one stays
        last[low:high] = seen[pairs] == places
    return last
