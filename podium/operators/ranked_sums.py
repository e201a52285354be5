"""Sums over ranked lists for all cutoffs, as one scan of hits that are sorted by query.

Arrow batches hold the lists one after the other; a list that goes on in the next batch waits for it. Each term is
added up per (list, interval between cutoffs), and the sums of a cutoff are running totals over the intervals.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Terms that are given for every cutoff: from the gain order the first three, from the reading order the last.
AT_CUTOFF = ("dcg", "found", "precision", "hole")


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode(null_encoding="encode").indices.to_numpy(zero_copy_only=False)


def _changes(columns: list[pa.Array], rows: int) -> np.ndarray:
    """Whether a row differs from the one before it in any of the columns; the first one does."""
    changed = np.zeros(rows, bool)
    changed[:1] = True
    for column in columns:
        codes = _codes(column)
        changed[1:] |= codes[1:] != codes[:-1]
    return changed


def whole_lists(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole lists, about as large as the batches."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held:
            last = [pa.concat_arrays([held[-1].column(k).slice(held[-1].num_rows - 1), batch.column(k)]) for k in keys]
            starts = np.flatnonzero(_changes(last, batch.num_rows + 1)[1:])
        else:
            starts = np.flatnonzero(_changes([batch.column(k) for k in keys], batch.num_rows))
        if not len(starts):
            held.append(batch)
            continue
        cut = int(starts[-1])
        whole = [*held, batch.slice(0, cut)] if cut else held
        if whole:
            yield pa.Table.from_batches(whole).combine_chunks()
        held = [batch.slice(cut)]
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _tied_order(table: pa.Table, first: np.ndarray) -> np.ndarray | None:
    """The rows in the order in which equal scores of a list stand by document id, the largest first; None if none are equal."""
    level = [table[name].combine_chunks() for name in ("_self", "score")]
    runs = np.cumsum(first | _changes(level, len(table)))
    tied = np.flatnonzero(np.bincount(runs)[runs] > 1)
    if not len(tied):
        return None
    among = pa.table({"run": runs[tied], "doc_id": table["doc_id"].combine_chunks().take(pa.array(tied))})
    order = pc.sort_indices(among, [("run", "ascending"), ("doc_id", "descending")]).to_numpy()
    out = np.arange(len(table))
    out[tied] = tied[order]
    return out


def _before(factors: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """For each row the product of the factors of the rows before it in its list. Lists of like length are done together."""
    out = np.ones(len(factors))
    kind = np.ceil(np.log2(np.maximum(sizes, 1))).astype(int)
    for k in np.unique(kind):
        some = np.flatnonzero(kind == k)
        place = np.arange(int(sizes[some].max()))
        inside = place < sizes[some][:, None]
        at = np.where(inside, starts[some][:, None] + place, 0)
        products = np.cumprod(np.where(inside, factors[at], 1.0), axis=1)
        shifted = np.concatenate([np.ones((len(some), 1)), products[:, :-1]], axis=1)
        out[at[inside]] = shifted[inside]
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table[name].combine_chunks().to_numpy(zero_copy_only=False).astype(np.float64)


def list_sums(table: pa.Table, keys: list[str], ks: list[int], ps: list[float], by_document: bool) -> dict[str, pa.Array]:
    """One entry per list: its keys, the terms at every cutoff, the place of the first relevant hit, ERR and RBP sums.

    The rows are sorted by list and in reading order, with rel, hole and the list's max_rel. ``by_document``: gains are counted in the
    order in which equal scores stand by document id instead.
    """
    first = _changes([table[k].combine_chunks() for k in keys], len(table))
    starts = np.flatnonzero(first)
    sizes = np.diff(np.append(starts, len(table)))
    group = np.repeat(np.arange(len(starts)), sizes)
    place = np.arange(len(table)) - starts[group] + 1.0
    rel, hole, top = _numbers(table, "rel"), _numbers(table, "hole"), _numbers(table, "max_rel")
    width = len(ks) + 1
    cell = group * width + np.searchsorted(ks, place)

    def at_cutoffs(values):
        sums = np.bincount(cell, values, len(starts) * width).reshape(len(starts), width)
        total = np.cumsum(sums, axis=1)[:, :-1]
        return pa.ListArray.from_arrays(pa.array(np.arange(len(starts) + 1, dtype=np.int32) * (width - 1)), pa.array(total.ravel()))

    order = _tied_order(table, first) if by_document else None
    gain = rel if order is None else rel[order]  # lists stay where they are, only tied hits change places
    hit = (gain > 0).astype(np.float64)
    so_far = np.cumsum(hit)
    so_far -= (so_far - hit)[starts][group]
    relevant = np.where(rel > 0, place, np.inf)
    nearest = np.minimum.reduceat(relevant, starts)
    stop = np.exp2(rel - top) - np.exp2(-top)  # (2^rel - 1) / 2^max, in a form that no grade overflows
    out = {
        "dcg": at_cutoffs(gain / np.log2(place + 1)),
        "found": at_cutoffs(hit),
        "precision": at_cutoffs(hit * so_far / place),
        "hole": at_cutoffs(hole),
        "first": pa.array(nearest, mask=np.isinf(nearest)),
        "err": pa.array(np.bincount(group, _before(1 - stop, starts, sizes) * stop / place)),
    }
    norm = np.divide(rel, top, out=np.zeros(len(rel)), where=top > 0)
    for i, p in enumerate(ps):
        out[f"rbp{i}"] = pa.array(np.bincount(group, norm * p ** (place - 1)))
    at = pa.array(starts)
    return {k: table[k].combine_chunks().take(at) for k in keys} | out
