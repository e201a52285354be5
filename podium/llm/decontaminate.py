"""Benchmark passages in documents, by latent semantic retrieval.

Words are hashed into buckets and weighted by how few documents have them. A randomised SVD of the
TF-IDF matrix of all passages gives the latent space: tasks add up their part of A'(A R) for a random
matrix R, which is a table of fixed size, and the driver takes its singular vectors. They are divided by their
singular values, so that what most passages share does not decide. Every window of every document, and every
benchmark passage, is projected, with each of its words once however often it is repeated there; windows whose cosine with a
passage reaches ``cosine`` are candidates, and so are those that hold a passage word by word, whatever their cosine. A candidate counts if its longest common word sequence with the passage
covers ``share`` of it, and ``answer_share`` of its last quarter, where the answer is.

Windows that hold too few of the rarer words of every passage to share ``share`` of it with any are not projected: a sequence of m of the L words
of a passage has at least k of any L - m + k of them. No passage is lost by that.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.llm import tables
from podium.llm.common import blocks, group_rows
from podium.llm.features import content_words, last_places, running_sums, sequences
from podium.session import ship_package


@dataclass(frozen=True)
class LeakConfig:
    bucket_bits: int = 13
    rank: int = 128
    passes: int = 1  # over the corpus, for the SVD; more sharpen it
    passage: int = 256  # words of the passages that the SVD sees
    cosine: float = 0.3
    share: float = 0.6
    answer_share: float = 0.5
    probe: int = 96  # longer benchmark passages are cut into parts of so many words
    least_words: int = 5  # shorter benchmark passages are found word by word only
    groups: int = 64  # of passages, for which rarer words in a window are counted
    probes_at_once: int = 20_000  # of the benchmark, per pass over the documents
    seed: int = 3


_BYTES = 500_000
#: Words whose vectors are gathered at a time, so that they stay in the processor's cache.
_WORDS = 1024
#: Passages that are added up on their own, so that a small number is not added to a large one each time.
_PASSAGES = 2048
#: Units of windows whose rarer words are counted at a time.
_UNITS = 4096
#: Bits of a hash by which most of what is not looked for is told.
_MARK_BITS = 16


def _buckets(hashes: np.ndarray, bits: int) -> np.ndarray:
    return (hashes >> np.uint64(64 - bits)).astype(np.int64)


def _few_tasks(rows: DataFrame) -> DataFrame:
    """In a few tasks per core, as each of them makes a whole table."""
    return rows.coalesce(4 * rows.sparkSession.sparkContext.defaultParallelism)


def weights(texts: DataFrame, config: LeakConfig) -> np.ndarray:
    """Weight of each bucket: the logarithm of documents per document that has it."""
    n = 1 << config.bucket_bits

    def run(batches):
        found = np.zeros(2 * n, np.int64)
        for batch in blocks(batches, "text", _BYTES):
            counts, hashes = content_words(batch.column("text"))
            buckets = _buckets(hashes, config.bucket_bits)
            found[:n] += np.bincount(buckets[last_places(group_rows(counts), buckets, n)], minlength=n)
            found[n] += np.count_nonzero(counts)
        yield tables.partial(found)

    found = tables.total(_few_tasks(texts).mapInArrow(run, tables.SHAPE), 2 * n, "<i8")
    return np.log((1 + found[n]) / (1 + found[:n])).astype(np.float32)


def _product(batches, table: np.ndarray, config: LeakConfig) -> np.ndarray:
    """A'(A T) for the passages A of these batches, a row of buckets each, 1 where the passage has the bucket.

    A passage touches as many rows of the tables as it has different buckets.
    """
    out, some, held = np.zeros_like(table), np.zeros_like(table), 0
    for batch in blocks(batches, "text", _BYTES):
        counts, hashes = content_words(batch.column("text"))
        per_text = -(-counts // config.passage)
        places = np.arange(len(hashes)) - np.repeat(np.cumsum(counts) - counts, counts)
        passage = np.repeat(np.cumsum(per_text) - per_text, counts) + places // config.passage
        buckets = _buckets(hashes, config.bucket_bits)
        once = last_places(passage, buckets, len(table))
        buckets, sizes = buckets[once], np.bincount(passage[once])
        ends = np.cumsum(sizes)
        for begin, end in zip((ends - sizes).tolist(), ends.tolist()):
            words = buckets[begin:end]  # all different
            some[words] = some.take(words, axis=0) + table.take(words, axis=0).sum(axis=0)
        held += len(sizes)
        if held >= _PASSAGES:
            out += some
            some[:], held = 0, 0
    return out + some


def latent_space(texts: DataFrame, weight: np.ndarray, config: LeakConfig) -> np.ndarray:
    """Right singular vectors (buckets x rank) of the weighted passages by a randomised SVD, over their squared singular values."""
    n = len(weight)
    basis = np.random.default_rng(config.seed).normal(size=(n, config.rank)).astype(np.float32)
    for _ in range(config.passes):
        sent = texts.sparkSession.sparkContext.broadcast(weight[:, None] * basis)

        def run(batches, sent=sent):
            yield tables.partial((weight[:, None] * _product(batches, sent.value, config)).ravel())

        table = tables.total(_few_tasks(texts).mapInArrow(run, tables.SHAPE), n * config.rank, "<f4")
        left, size, _ = np.linalg.svd(table.reshape(n, config.rank).astype(np.float64), full_matrices=False)
        good = size > size.max(initial=0) * 1e-6
        basis = (left * good).astype(np.float32)
    return (basis / np.where(good, size / max(size.max(initial=0), 1e-30), 1)).astype(np.float32)


def longest_common(masks: dict[int, int], length: int, words: list[int]) -> int:
    """Length of the longest common subsequence of ``words`` and a sequence whose places are in ``masks``."""
    ones = (1 << length) - 1
    row = ones
    for word in words:
        hit = row & masks.get(word, 0)
        row = ((row + hit) | (row - hit)) & ones
    return length - row.bit_count()


def _masks(words: list[int]) -> dict[int, int]:
    masks: dict[int, int] = {}
    for place, word in enumerate(words):
        masks[word] = masks.get(word, 0) | 1 << place
    return masks


def _mark(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(64 - _MARK_BITS)).astype(np.int64)


def _marks(hashes: np.ndarray) -> np.ndarray:
    """A table that tells of any hash whether it may be among these."""
    found = np.zeros(1 << _MARK_BITS, bool)
    found[_mark(hashes)] = True
    return found


class Probes:
    """Parts of benchmark passages, by window length, with all that a task needs to look for them."""

    def __init__(self, items: list[tuple[int, str | None]], weight: np.ndarray, basis: np.ndarray, config: LeakConfig):
        self.config, self.bits = config, config.bucket_bits
        self.table = np.concatenate([weight[:, None] * basis, np.zeros((1, basis.shape[1]), np.float32)])
        counts, hashes = content_words(pa.array([t for _, t in items], pa.string()))
        self.parts, ends = [], np.cumsum(counts)
        short: dict[int, list[tuple[int, int]]] = {}
        for (item, _), begin, end in zip(items, ends - counts, ends):
            for at in range(begin, end, config.probe):
                at = max(begin, min(at, end - config.probe))
                words = hashes[at : min(at + config.probe, end)]
                if len(words) >= config.least_words:
                    self.parts.append((item, words.tolist()))
                else:
                    whole = sequences(words, np.array([0]), np.array([len(words)]))[0]
                    short.setdefault(len(words), []).append((int(whole), item))
        self.short = {n: self._sorted(some) for n, some in short.items()}
        self.by_length: dict[int, list[int]] = {}
        length, longest = 8, max((len(w) for _, w in self.parts), default=0)
        bounds = [length]
        while bounds[-1] < longest:
            bounds.append(bounds[-1] * 3 // 2)
        for i, (_, words) in enumerate(self.parts):
            self.by_length.setdefault(next(b for b in bounds if b >= len(words)), []).append(i)
        self.vectors = {k: self._unit(np.stack([self._sum(self.parts[i][1]) for i in some])) for k, some in self.by_length.items()}
        self.masks = [(_masks(w), _masks(self.answer(w))) for _, w in self.parts]
        self.anchors = {k: self._anchors(some, weight) for k, some in self.by_length.items()}
        self.marked = {k: _marks(found[0]) for k, found in self.anchors.items()}
        self.rare = {k: self._rare(some, weight) for k, some in self.by_length.items()}

    @staticmethod
    def _sorted(some: list[tuple[int, int]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        known, numbers = np.array([h for h, _ in some], np.uint64), np.array([i for _, i in some], np.int64)
        order = np.argsort(known, kind="stable")
        return known[order], numbers[order], _marks(known)

    def _rare(self, some: list[int], weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """The rarer words of these parts, sorted, with where each one's groups begin and end in the groups of all; and how many words each group asks of a window.

        A common sequence of at least m of a part's L words has at least k of its L - m + k rarest.
        """
        pairs, need = set(), np.full(min(self.config.groups, len(some)), np.iinfo(np.int64).max)
        for place, i in enumerate(some):
            words, group = np.array(self.parts[i][1], np.uint64), place % len(need)
            least = max(int(np.ceil(self.config.share * len(words) - 1e-6)), 0)
            k = min(least, max(1, len(words) // 4))
            rarest = np.argsort(-weight[_buckets(words, self.bits)], kind="stable")[: len(words) - least + k]
            pairs.update((word, group) for word in words[rarest].tolist())
            need[group] = min(need[group], k)
        words, groups = np.array(sorted(pairs), np.uint64).reshape(-1, 2).T
        known, first = np.unique(words, return_index=True)
        return known, np.append(first, len(words)), groups.astype(np.int64), need

    def _hopeful(self, length: int, hashes: np.ndarray, text: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """The windows with enough rarer words of a group of parts; windows are three units, which begin at ``begins``."""
        known, bounds, groups, need = self.rare[length]
        some = np.flatnonzero(_marks(known)[_mark(hashes)])
        at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
        some, at = some[known[at] == hashes[some]], at[known[at] == hashes[some]]
        unit, n, hopeful = np.searchsorted(begins, some, "right") - 1, len(need), np.zeros(len(begins), bool)
        kind = np.min_scalar_type(3 * max(length // 2, 1))  # a window holds no more words
        need = need.astype(kind)
        for first in range(0, len(begins), _UNITS):  # with the two units after them
            last = min(first + _UNITS + 2, len(begins))
            low, high = np.searchsorted(unit, [first, last])
            word = at[low:high]
            each = bounds[word + 1] - bounds[word]
            group = groups[np.repeat(bounds[word] - np.cumsum(each) + each, each) + np.arange(each.sum())]
            cells = np.repeat(unit[low:high] - first, each) * n + group
            found = np.bincount(cells, minlength=(last - first) * n).reshape(-1, n).astype(kind)
            total = found.copy()
            for shift in (1, 2):
                total[:-shift] += found[shift:] * (text[first + shift : last] == text[first : last - shift])[:, None]
            hopeful[first : first + _UNITS] = (total >= need).any(axis=1)[:_UNITS]
        return np.flatnonzero(hopeful)

    def _anchors(self, some: list[int], weight: np.ndarray) -> tuple[np.ndarray, ...]:
        """For each of these parts its rarest ``least_words`` words in a row, as a hash; sorted, with their place, the number of words and the hash of all."""
        n, found = self.config.least_words, []
        for i in some:
            words = np.array(self.parts[i][1], np.uint64)
            rare = np.convolve(weight[_buckets(words, self.bits)], np.ones(n), "valid")
            at, whole = np.array([rare.argmax()]), np.array([len(words)])
            found.append((sequences(words, at, np.array([n]))[0], at[0], len(words), sequences(words, np.array([0]), whole)[0], i))
        found.sort(key=lambda f: f[0])
        return tuple(np.array(column, kind) for column, kind in zip(zip(*found), (np.uint64, np.int64, np.int64, np.uint64, np.int64)))

    def _exact(self, length: int, counts: np.ndarray, hashes: np.ndarray, anchors: np.ndarray, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First words and numbers of the parts that stand in the texts word by word; ``anchors``: hashes of ``least_words`` words in a row."""
        known, shift, size, whole, number = self.anchors[length]
        hits = np.flatnonzero(self.marked[length][_mark(anchors)])
        low, high = np.zeros(len(anchors), np.int64), np.zeros(len(anchors), np.int64)
        low[hits], high[hits] = np.searchsorted(known, anchors[hits]), np.searchsorted(known, anchors[hits], "right")
        hits, ends, found = hits[high[hits] > low[hits]], np.cumsum(counts), []
        for hit in np.array_split(hits, (high - low).sum() // 1_000_000 + 1):
            each = (high - low)[hit]
            place = np.repeat(hit, each)
            which = np.repeat(low[hit] - np.cumsum(each) + each, each) + np.arange(len(place))
            text = np.searchsorted(ends, place, "right")
            starts = place - shift[which]
            inside = (starts >= (ends - counts)[text]) & (starts + size[which] <= ends[text])
            starts, which = starts[inside], which[inside]
            same = sequences(hashes, starts, size[which], sums) == whole[which]
            found.append((starts[same], number[which[same]]))
        return tuple(map(np.concatenate, zip(*found)))

    def _short(self, counts: np.ndarray, hashes: np.ndarray, sums: np.ndarray, found: list[dict]):
        """Passages under ``least_words`` words, where they stand word by word."""
        ends = np.cumsum(counts)
        for n, (known, items, marked) in self.short.items():
            places = np.arange(max(len(hashes) - n + 1, 0))
            every = sequences(hashes, places, np.full(len(places), n), sums)
            places = np.flatnonzero(marked[_mark(every)])
            low, high = np.searchsorted(known, every[places]), np.searchsorted(known, every[places], "right")
            text = np.searchsorted(ends, places, "right")
            inside = (high > low) & (places + n <= ends[text])
            pairs, first = np.unique(text[inside] * len(known) + low[inside], return_index=True)  # where it stands first
            for pair, place, last in zip(pairs.tolist(), places[inside][first].tolist(), high[inside][first].tolist()):
                row, number = divmod(pair, len(known))
                for item in items[number:last].tolist():
                    found[row][item] = max(found[row].get(item, (0.0, 0.0, 0)), (1.0, 1.0, int(place - (ends - counts)[row])))

    @staticmethod
    def answer(words: list[int]) -> list[int]:
        return words[-max(1, len(words) // 4) :]

    @staticmethod
    def _unit(vectors: np.ndarray) -> np.ndarray:
        return vectors / np.maximum(np.sqrt(np.einsum("ij,ij->i", vectors, vectors)), 1e-12)[:, None]

    def _sum(self, words: list[int]) -> np.ndarray:
        return self.table[_buckets(np.unique(np.array(words, np.uint64)), self.bits)].sum(axis=0)

    @staticmethod
    def _windows(counts: np.ndarray, step: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The windows of three steps that begin at every step of each text: first word, end and text."""
        ends, units = np.cumsum(counts), -(-counts // step)
        text = np.repeat(np.arange(len(counts)), units)
        starts = (ends - counts)[text] + step * (np.arange(len(text)) - np.repeat(np.cumsum(units) - units, units))
        return starts, np.minimum(starts + 3 * step, ends[text]), text

    def _vectors(self, hashes: np.ndarray, starts: np.ndarray, stops: np.ndarray, width: int) -> np.ndarray:
        """Sums of the vectors of the different words of windows of at most ``width`` words."""
        zeros = len(self.table) - 1  # a row of zeros
        out = np.zeros((len(starts), self.table.shape[1]), np.float32)
        for k in np.array_split(np.arange(len(starts)), len(starts) * width // _WORDS + 1):
            places = starts[k][:, None] + np.arange(width)
            words = np.sort(hashes[np.where(places < stops[k][:, None], places, starts[k][:, None])], axis=1)
            buckets = _buckets(words, self.bits)
            buckets[:, 1:][words[:, 1:] == words[:, :-1]] = zeros
            out[k] = self.table[buckets].sum(axis=1)
        return out

    def search(self, counts: np.ndarray, hashes: np.ndarray) -> list[dict[int, tuple[float, float, int]]]:
        """For each text of ``counts`` words: the items in it, with share, answer share and first word of the best window.

        A window is three steps of half the probe length, so one of them holds the whole passage wherever it begins. A word
        counts once in it, whatever stands before the window.
        """
        found: list[dict[int, tuple[float, float, int]]] = [{} for _ in counts]
        if not len(hashes):
            return found
        ends, n, sums = np.cumsum(counts), self.config.least_words, running_sums(hashes)
        self._short(counts, hashes, sums, found)
        anchors = np.arange(max(len(hashes) - n + 1, 0))
        anchors = sequences(hashes, anchors, np.full(len(anchors), n), sums)
        for length, some in self.by_length.items():
            step = max(length // 2, 1)
            starts, stops, text = self._windows(counts, step)
            begins = (ends - counts)[text]
            at, numbers = self._exact(length, counts, hashes, anchors, sums)
            exact = np.unique(np.column_stack([np.searchsorted(starts, at, "right") - 1, numbers]), axis=0)
            for w, number in exact.tolist():
                self._look(found[text[w]], number, hashes, starts[w], stops[w], begins[w])
            hopeful = self._hopeful(length, hashes, text, starts)
            for at in range(0, len(hopeful), 20_000):
                windows = hopeful[at : at + 20_000]
                vectors = self._vectors(hashes, starts[windows], stops[windows], 3 * step)
                size = np.sqrt(np.einsum("ij,ij->i", vectors, vectors))
                size[size <= 1e-12 * size.max()] = np.inf  # nothing in it counts
                near = vectors @ self.vectors[length].T >= self.config.cosine * size[:, None]
                for w, p in np.argwhere(near).tolist():
                    w = windows[w]
                    self._look(found[text[w]], some[p], hashes, starts[w], stops[w], begins[w])
        return found

    def _look(self, found: dict, number: int, hashes: np.ndarray, start: int, stop: int, begin: int):
        """Compare the words of a window with those of a probe."""
        (item, words), (every, last) = self.parts[number], self.masks[number]
        seen = hashes[start:stop].tolist()
        if sum(map(every.__contains__, seen)) < self.config.share * len(words):
            return  # no common sequence can be long enough
        share = longest_common(every, len(words), seen) / len(words)
        if share >= self.config.share:
            answer = len(self.answer(words))
            known = longest_common(last, answer, seen) / answer
            if known >= self.config.answer_share:
                found[item] = max(found.get(item, (0.0, 0.0, 0)), (share, known, int(start - begin)))


def _items(benchmark: DataFrame, config: LeakConfig):
    """The benchmark in blocks of bounded size, so that any benchmark fits the tasks."""
    held, words = [], 0
    for r in benchmark.select("item_id", "text").where("item_id is not null").orderBy("item_id", "text").toLocalIterator():
        held.append((r["item_id"], r["text"]))
        words += 1 + len(r["text"] or "") // (config.probe * 6)
        if words >= config.probes_at_once:
            yield held
            held, words = [], 0
    if held:
        yield held


def screened(documents: DataFrame, benchmark: DataFrame, config: LeakConfig = LeakConfig(), text_column: str = "text") -> DataFrame:
    """The documents in a struct ``row``, with ``leaks``: an array of (item_id, share, answer_share, at).

    ``share`` is the longest common word sequence over the words of the benchmark passage (or of a
    part of ``probe`` words), ``at`` the first word of the window. Case and punctuation do not
    matter. Null and empty texts have no leaks, and neither have tables whose benchmark is empty;
    benchmark rows without an id or without words are not looked for, those with fewer than ``least_words`` words
    are found where they stand word by word (``at`` is then their first word). Repeated rows are all kept.
    """
    ship_package(documents.sparkSession)
    texts = documents.select(F.col(text_column).alias("text"))
    weight = weights(texts, config)
    basis = latent_space(texts, weight, config)
    shape = "array<struct<item_id: long, share: double, answer_share: double, at: long>>"
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("share", pa.float64()), ("answer_share", pa.float64()), ("at", pa.int64())]))
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    row = rows.schema["row"].dataType.simpleString()
    place = documents.columns.index(text_column)
    out = rows.withColumn("leaks", F.array().cast(shape))
    for items in _items(benchmark, config):
        probes = documents.sparkSession.sparkContext.broadcast(Probes(items, weight, basis, config))

        def run(batches, probes=probes):
            for batch in batches:
                whole = batch.column("row")
                texts = whole.field(place)
                part = pa.RecordBatch.from_arrays([whole, texts, batch.column("leaks")], ["row", "text", "leaks"])
                for piece in blocks([part], "text", _BYTES):
                    counts, hashes = content_words(piece.column("text"))
                    found = []
                    for hits, before in zip(probes.value.search(counts, hashes), piece.column("leaks").to_pylist()):
                        found.append(before + [dict(item_id=i, share=s, answer_share=a, at=w) for i, (s, a, w) in sorted(hits.items())])
                    yield pa.RecordBatch.from_arrays([piece.column("row"), pa.array(found, kind)], ["row", "leaks"])

        out = out.mapInArrow(run, f"row {row}, leaks {shape}")
    return out
