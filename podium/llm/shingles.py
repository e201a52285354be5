"""Word shingles of texts as sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

from podium.llm.common import hashed_words, mix

_FACTORS = np.random.default_rng(6).integers(1, 2**63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(texts: pa.Array, words: int = 5) -> list[np.ndarray]:
    """For each text its distinct shingles, sorted. Words are split at ASCII white space, with A-Z lower-cased.

    A text of fewer words has one shingle, the sequence of all of them; one without words has none.
    """
    counts, hashes, _, _ = hashed_words(pc.ascii_lower(pc.fill_null(texts, "")))
    ends = np.cumsum(counts)
    joined = np.zeros(max(len(hashes) - words + 1, 0), np.uint64)
    for k in range(words):
        joined += hashes[k : len(joined) + k] * _FACTORS[k]
    joined = mix(joined)
    out = []
    for begin, end in zip((ends - counts).tolist(), ends.tolist()):
        if end - begin >= words:
            out.append(np.unique(joined[begin : end - words + 1]))
        else:
            few = hashes[begin:end]
            whole = (few * _FACTORS[8 : 8 + len(few)]).sum(dtype=np.uint64) + np.uint64(len(few))
            out.append(mix(np.array([whole] * bool(len(few)), np.uint64)))
    return out


def set_class(shingles: np.ndarray) -> int:
    """A signed 64-bit hash that equal sets share."""
    return int(np.array(xxhash.xxh3_64_intdigest(shingles.tobytes()), np.uint64).view(np.int64))
