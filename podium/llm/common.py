"""Helpers that several operators of this subpackage share."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession



def _return_memory():
    """Have this process give freed blocks back to the system at once, as its workers live on from stage to stage.

    The C library otherwise raises the size from which it does so with every large block that is freed, and Arrow's own pool
    keeps what it has. Where the C library has no such setting, nothing is changed.
    """
    try:
        mallopt = ctypes.CDLL(None).mallopt
    except (AttributeError, OSError):
        return
    for setting, value in ((-3, 4 << 20), (-1, 8 << 20), (-8, 2)):  # mmap threshold, trim threshold, arenas
        mallopt(setting, value)
    pa.set_memory_pool(pa.system_memory_pool())


_return_memory()

#: Bytes of text that a task holds as words and hashes at a time. A longer text is a block of its own.
BLOCK_BYTES = 1_000_000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame, *keys: str) -> DataFrame:
    """Dealt out by the keys over all shuffle partitions, for rows that are small and mean much work each."""
    return rows.repartition(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def blocks(batches: Iterator[pa.RecordBatch], column: str, size: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in slices that hold about ``size`` bytes of ``column``."""
    for batch in batches:
        lengths = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        begin, held = 0, 0
        for row, length in enumerate(lengths.tolist()):
            if held and held + length > size:
                yield batch.slice(begin, row - begin)
                begin, held = row, 0
            held += length
        if begin < batch.num_rows:
            yield batch.slice(begin)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of all texts, one after the other, and where each text begins; a null is empty."""
    texts = pc.fill_null(texts, "")
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    data = texts.buffers()[2]
    whole = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return whole[offsets[0] : offsets[-1]], offsets - offsets[0]


_RANDOM = np.random.default_rng(5)
_BYTE_VALUES = _RANDOM.integers(1, 2**63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
BASE, INVERSE = 0x2545F4914F6CDD1D, pow(0x2545F4914F6CDD1D, -1, 2**64)
_POWERS: dict[int, np.ndarray] = {}


def powers(base: int, n: int) -> np.ndarray:
    """``base`` to the powers 0 to n - 1, modulo 2^64; as many as a block of text needs are kept for the next call."""
    kept = _POWERS.get(base, np.ones(1, np.uint64))
    while len(kept) < n:
        step = pow(base, len(kept), 2**64)
        kept = np.concatenate([kept, kept * np.uint64(step)])
    _POWERS[base] = kept if len(kept) <= BLOCK_BYTES else kept[:BLOCK_BYTES].copy()
    return kept[:n]


def hashed_words(
    texts: pa.Array, classes: np.ndarray | None = None
) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ASCII-white-space separated words of each text as 64-bit hashes of their bytes.

    Returns the number of words of each text, the hashes, and the first byte and the end of each
    word in ``text_bytes``. The hash is a polynomial over random byte values, taken from sums of
    prefixes, so no word is touched on its own. ``classes`` gives each of the 256 bytes a class;
    words are then also cut between bytes of different classes above 0.
    """
    data, offsets = text_bytes(texts)
    n = len(data)
    if not n:
        none = np.zeros(0, np.int64)
        return np.zeros(len(texts), np.int64), np.zeros(0, np.uint64), none, none
    solid = (data != 32) & ((data < 9) | (data > 13))
    begins, ends = solid.copy(), solid.copy()
    begins[1:] &= ~solid[:-1]
    ends[:-1] &= ~solid[1:]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] |= solid[inner]
    ends[inner - 1] |= solid[inner - 1]
    if classes is not None:
        kinds = classes[data]
        cuts = 1 + np.flatnonzero((kinds[1:] != kinds[:-1]) & (kinds[1:] > 0) & (kinds[:-1] > 0))
        begins[cuts] = True
        ends[cuts - 1] = True
    starts, stops = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_BYTE_VALUES[data] * powers(BASE, n), out=sums[1:])
    hashes = mix((sums[stops] - sums[starts]) * powers(INVERSE, n)[starts])
    return np.diff(np.searchsorted(starts, offsets)), hashes, starts, stops


def word_codes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words as in ``hashed_words``, as indices into the array of distinct words, which is the third result."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    offsets = lists.offsets.to_numpy().astype(np.int64)
    coded = lists.flatten().dictionary_encode()
    codes, distinct = coded.indices.to_numpy(), coded.dictionary.to_numpy(zero_copy_only=False)
    offsets = offsets - offsets[0]
    empty = np.flatnonzero(distinct == "")
    if len(empty):  # pieces before the first and after the last word
        real = codes != empty[0]
        return np.diff(np.concatenate([[0], np.cumsum(real)])[offsets]), codes[real], distinct
    return np.diff(offsets), codes, distinct


def mix(values: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit over all others."""
    values = values ^ (values >> np.uint64(32))
    values = values * np.uint64(0x9E3779B97F4A7C15)
    values = values ^ (values >> np.uint64(29))
    values = values * np.uint64(0xBF58476D1CE4E5B9)
    return values ^ (values >> np.uint64(32))


def group_rows(counts: np.ndarray) -> np.ndarray:
    """For groups that lie one after the other, the group of each row."""
    return np.repeat(np.arange(len(counts)), counts)


def sums_per_group(values: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Sums of ``values`` (rows) over groups of ``counts`` rows that lie one after the other."""
    out = np.zeros((len(counts), *values.shape[1:]), np.float64)
    full = np.flatnonzero(counts)
    if len(full):
        starts = (np.cumsum(counts) - counts)[full]
        out[full] = np.add.reduceat(values, starts, axis=0)
    return out
