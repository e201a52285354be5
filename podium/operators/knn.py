"""Exact top-k similarity search between query vectors and document vectors.

Documents stay where they are: ``mapInArrow`` tasks multiply Arrow batches of them with the
query matrix and keep the best ``k`` per query, so only candidates are shuffled. The query
matrix is broadcast while its size, which is counted first, is within a bound. Beyond the
bound, the documents are broadcast in parts unless there are far more of them, and the queries go past them; else the queries
are broadcast in parts, one pass over the documents after the other. When that
would take more than ``MAX_PASSES`` passes, both sides are shuffled into blocks and every pair of blocks is
searched by one task.

What a task holds is bounded: the vectors of one part, documents up to ``BUFFER_BYTES``, a tile of scores of which each query
keeps ``k`` at most, however many are equal, and ``HELD_ROWS`` candidates, beyond which they are handed over.

Tiles are multiplied in single precision first. Only cells that may reach the k-th best score so far, given a bound of the
error, are computed in double precision, and only those scores are compared and returned.
"""

from __future__ import annotations

from math import ceil

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.functions.text import as_id
from podium.operators.topk import top_per_group
from podium.session import materialize, new_folder, ship_package

BROADCAST_BYTES = 256 * 1024 * 1024
PASS_BYTES = 32 * 1024 * 1024
MAX_PASSES = 64
BLOCK_BYTES = 128 * 1024 * 1024
MERGE_ROWS = 200_000_000
FLOOR_SHARE = 0.01
TASK_PRODUCTS = 50_000_000
TILE_CELLS = 1_000_000
BUFFER_BYTES = 16 * 1024 * 1024
HELD_ROWS = 500_000
SLICE_ROWS = 512
EXACT_ROWS = 16_384
#: Documents are sent if there are up to so many times as many as queries.
DOC_SHARE = 4
SENT_ROWS = 50_000


def to_matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Arrow list column to a row-major double matrix; all lists must have ``dim`` numbers."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if len(column) == 0:
        return np.zeros((0, dim))
    widths = pc.list_value_length(column)
    if column.null_count or pc.min(widths).as_py() != dim or pc.max(widths).as_py() != dim:
        raise ValueError(f"vectors must all have {dim} numbers")
    matrix = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
    if np.isnan(matrix).any():
        raise ValueError("a vector holds NaN, which has no similarity to anything")
    return matrix


def cosine(queries: np.ndarray, docs: np.ndarray, eps: float, lengths: np.ndarray | None = None) -> np.ndarray:
    """``lengths``: those of the documents, if they are known."""
    bound = np.outer(np.linalg.norm(queries, axis=1), np.linalg.norm(docs, axis=1) if lengths is None else lengths)
    np.maximum(bound, eps, out=bound)
    return np.divide(queries @ docs.T, bound, out=bound)


def inner(queries: np.ndarray, docs: np.ndarray, eps: float, lengths: np.ndarray | None = None) -> np.ndarray:
    return queries @ docs.T


SIMILARITIES = {"cosine": cosine, "ip": inner}


def _spread(lengths: np.ndarray) -> tuple[float, float]:
    """The least length above 0 and the largest one."""
    some = lengths[lengths > 0]
    return (float(some.min()), float(lengths.max())) if len(some) else (1.0, 1.0)


def _inverse(lengths: np.ndarray) -> np.ndarray:
    return np.divide(1.0, lengths, out=np.zeros_like(lengths), where=lengths > 0)


class QueryBlock:
    """The query vectors one task searches for, with the score each query must reach."""

    def __init__(self, table: pa.Table, dim: int):
        self.ids = table["query_id"].combine_chunks()
        self.matrix = to_matrix(table["vector"], dim)
        floor = table["floor"].to_numpy()
        self.floor = np.where(np.isnan(floor), np.finfo(np.float64).min, floor)
        self.lengths = np.linalg.norm(self.matrix, axis=1)
        self.spread = _spread(self.lengths)


class DocBlock:
    """Document vectors in the order of their ids, with their lengths; in single precision if that loses nothing."""

    def __init__(self, ids: pa.Array, matrix: np.ndarray):
        order = pc.sort_indices(ids, sort_keys=[("", "ascending")], null_placement="at_start")
        self.ids = ids.take(order)
        matrix = matrix[order.to_numpy()]
        self.lengths = np.linalg.norm(matrix, axis=1)
        self.spread = _spread(self.lengths)
        with np.errstate(over="ignore"):
            single = matrix.astype(np.float32)
        self.matrix = single if np.array_equal(single, matrix) else matrix


def best_of_rows(tile: np.ndarray, reach: np.ndarray, k: int) -> np.ndarray:
    """Which cells are among the ``k`` best of their row and not below ``reach``, which rises to the k-th best.

    Of equal cells the first ones are taken, so a row never has more than ``k``, however many are equal.
    """
    hits = tile >= reach[:, None]
    crowded = np.flatnonzero(np.count_nonzero(hits, axis=1) > k)
    if len(crowded):
        some, place = tile if len(crowded) == len(tile) else tile[crowded], tile.shape[1] - k
        reach[crowded] = np.maximum(reach[crowded], np.partition(some, place, axis=1)[:, place])
        hits[crowded] = some >= reach[crowded][:, None]
        for row in crowded[np.count_nonzero(hits[crowded], axis=1) > k].tolist():
            above = tile[row] > reach[row]
            tied = np.flatnonzero(tile[row] == reach[row])
            above[tied[: k - np.count_nonzero(above)]] = True
            hits[row] = above
    return hits


def _places(hits: np.ndarray) -> np.ndarray:
    """Where the few cells are that hold true: eight are looked at together."""
    if hits.size % 8:
        return np.flatnonzero(hits)
    eights = np.flatnonzero(hits.reshape(-1).view(np.uint64))
    eight, place = np.nonzero(hits.reshape(-1, 8)[eights])
    return eights[eight] * 8 + place


def _kth_best(row: np.ndarray, score: np.ndarray, sizes: np.ndarray, k: int) -> np.ndarray:
    """The ``k``-th best score of each row, which has ``sizes`` of them; of a row with fewer no bound."""
    order = np.argsort(row.astype(np.uint16), kind="stable")
    place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    table = np.full((len(sizes), max(k, int(sizes.max()))), -np.inf)
    table[row[order], place] = score[order]
    return np.partition(table, table.shape[1] - k, axis=1)[:, table.shape[1] - k]


def cut_to_best(row: np.ndarray, doc: np.ndarray, score: np.ndarray, reach: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The ``k`` best candidates of each row, the first documents of equal ones; ``reach`` rises to the k-th best."""
    sizes = np.bincount(row, minlength=len(reach))
    if not len(row) or sizes.max() <= k:
        return row, doc, score
    if len(reach) * sizes.max() <= 4 * len(row):  # not if a few rows have most of the candidates
        np.maximum(reach, _kth_best(row, score, sizes, k), out=reach)
        good = np.flatnonzero(score >= reach[row])
        row, doc, score = row[good], doc[good], score[good]
        sizes = np.bincount(row, minlength=len(reach))
    if sizes.max() > k:
        order = np.lexsort((doc, -score, row))
        place = np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = order[place == k - 1]
        reach[row[last]] = np.maximum(reach[row[last]], score[last])
        good = order[place < k]
        row, doc, score = row[good], doc[good], score[good]
    return row, doc, score


class BestHits:
    """Candidates of one task. ``reach`` rises as better ones are found."""

    def __init__(self, block: QueryBlock, settings: dict):
        self.block = block
        self.settings = settings
        self.reach = block.floor.copy()
        self.parts: list[pa.Table] = []
        self.rows = 0
        self.offered = 0  # document blocks that the candidates held come from

    def offer(self, vectors: np.ndarray, ids: pa.Array):
        for _ in self.tiles(DocBlock(ids, vectors)):
            pass

    def tiles(self, docs: DocBlock):
        """Adds the best of these documents for some queries after others: at most ``k`` per query. Candidates may be taken after every step."""
        step = max(1, min(SLICE_ROWS, HELD_ROWS // (4 * self.settings["k"])))
        self.offered += 1
        for start in range(0, len(self.block.matrix), step):
            query, doc, score = self._best(docs, slice(start, min(start + step, len(self.block.matrix))))
            if len(query):
                columns = [pa.array((query + start).astype(np.int32)), pa.array(score), docs.ids.take(pa.array(doc))]
                self.parts.append(pa.table(columns, names=["query", "score", "doc_id"]))
                self.rows += len(query)
            yield start

    def _best(self, docs: DocBlock, some: slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query, document and score of the ``k`` best of these documents for some queries, tile by tile."""
        k, reach, held, rows = self.settings["k"], self.reach[some], [], 0
        width = max(1, TILE_CELLS // len(reach))
        width = width // 8 * 8 or width
        fast = self._safe(docs)
        for start in range(0, len(docs.ids), width):
            part = slice(start, min(start + width, len(docs.ids)))
            found = self._filtered(docs, some, part, reach) if fast else None
            if found is None:
                found = self._dense(docs, some, part, reach)
            held.append((found[0], found[1] + start, found[2]))
            rows += len(found[0])
            if rows > 2 * k * len(reach):
                held = [cut_to_best(*map(np.concatenate, zip(*held)), reach, k)]
                rows = len(held[0][0])
        return cut_to_best(*map(np.concatenate, zip(*held)), reach, k)

    def _safe(self, docs: DocBlock) -> bool:
        """Whether unit vectors in single precision say where scores are: no length is extreme, nor a cosine's divisor below its bound."""
        (least, most), (doc_least, doc_most) = self.block.spread, docs.spread
        if self.settings["similarity"] == "cosine" and least * doc_least < self.settings["eps"]:
            return False
        return min(least, doc_least) > 1e-100 and max(most, doc_most) < 1e100

    def _filtered(self, docs: DocBlock, some: slice, part: slice, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
        """Candidates of a tile by single precision, scored in double precision; None if there are so many that all may be scored."""
        k, digits, matrix, dim = self.settings["k"], self.settings["digits"], docs.matrix[part], docs.matrix.shape[1]
        lengths, asked = docs.lengths[part], self.block.lengths[some]
        cosine_like = self.settings["similarity"] == "cosine"
        if cosine_like:
            scale, units = np.ones(len(asked)), _inverse(lengths).astype(matrix.dtype)
        else:  # by the largest length of the tile
            largest = max(float(lengths.max()), 1e-100)
            scale, units = np.where(asked > 0, asked, 1.0) * largest, np.full(len(lengths), 1 / largest, matrix.dtype)
        queries = (self.block.matrix[some] * _inverse(asked)[:, None]).astype(np.float32)
        rough = queries @ (matrix * units[:, None]).astype(np.float32, copy=False).T
        # each number and each sum is off by some 2^-24 of the lengths, which are 1 at most; twice that, and what rounding adds
        error, unit = (dim + 8) * 2.0**-23, 10.0**-digits if digits is not None else 0.0
        with np.errstate(over="ignore"):
            least = ((reach - unit) / scale - error).astype(np.float32)
        hits = rough >= least[:, None]
        crowded = np.flatnonzero(np.count_nonzero(hits, axis=1) > k)
        if len(crowded):
            place = rough.shape[1] - k
            kth = np.partition(rough[crowded], place, axis=1)[:, place].astype(np.float64)
            reach[crowded] = np.maximum(reach[crowded], (kth - error) * scale[crowded] - unit)
            least[crowded] = ((reach[crowded] - unit) / scale[crowded] - error).astype(np.float32)
            hits[crowded] = rough[crowded] >= least[crowded][:, None]
        cells = _places(hits)
        if 4 * len(cells) > hits.size:
            return None
        row, doc = np.divmod(cells, hits.shape[1])
        score = np.empty(len(cells))
        for start in range(0, len(cells), EXACT_ROWS):
            now = slice(start, start + EXACT_ROWS)
            score[now] = np.einsum("ij,ij->i", self.block.matrix[some][row[now]], matrix[doc[now]].astype(np.float64))
        if cosine_like:
            score /= np.maximum(asked[row] * lengths[doc], self.settings["eps"])
        if digits is not None:
            np.round(score, digits, out=score)
        good = np.flatnonzero(score >= reach[row])
        return row[good], doc[good], score[good]

    def _dense(self, docs: DocBlock, some: slice, part: slice, reach: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All scores of a tile in double precision, and the best of them."""
        similarity, digits = SIMILARITIES[self.settings["similarity"]], self.settings["digits"]
        tile = similarity(self.block.matrix[some], docs.matrix[part].astype(np.float64), self.settings["eps"], docs.lengths[part])
        if digits is not None:
            np.round(tile, digits, out=tile)
        if np.isnan(tile.sum()):
            tile[np.isnan(tile)] = -np.inf
        row, doc = np.divmod(np.flatnonzero(best_of_rows(tile, reach, self.settings["k"])), tile.shape[1])
        return row, doc, tile[row, doc]

    def found(self, docs: DocBlock):
        """Adds the best of these documents, and hands over what is held whenever that becomes too much."""
        for _ in self.tiles(docs):
            if self.rows > HELD_ROWS:
                if self.offered > 1:
                    self.shrink()
                if self.rows > HELD_ROWS // 2:
                    yield self.take()

    def shrink(self):
        """Cut the candidates to the best ``k`` per query and raise ``reach`` to the k-th."""
        k = self.settings["k"]
        table = pa.concat_tables(self.parts)
        order = [("query", "ascending"), ("score", "descending"), ("doc_id", "ascending")]
        table = table.take(pc.sort_indices(table, sort_keys=order, null_placement="at_start"))
        query = table["query"].to_numpy()
        starts = np.flatnonzero(np.r_[True, query[1:] != query[:-1]])
        place = np.arange(len(query)) - np.repeat(starts, np.diff(np.r_[starts, len(query)]))
        last = np.flatnonzero(place == k - 1)
        self.reach[query[last]] = np.maximum(self.reach[query[last]], table["score"].to_numpy()[last])
        self.parts = [table.filter(pa.array(place < k))]
        self.rows = len(self.parts[0])

    def take(self) -> pa.Table | None:
        """Hand over the candidates held so far; ``reach`` stays."""
        if not self.rows:
            return None
        if self.offered > 1:  # those of one document block are cut already
            self.shrink()
        table = pa.concat_tables(self.parts).combine_chunks()
        self.parts, self.rows, self.offered = [], 0, min(self.offered, 1)
        ids = self.block.ids.take(table["query"].combine_chunks())
        return pa.table([ids, table["doc_id"], table["score"]], names=["query_id", "doc_id", "score"])


def _with_group(table: pa.Table, group: tuple, by: list[str], schema: pa.Schema) -> pa.Table:
    columns = [pa.array([value] * len(table), type=schema.field(name).type) for name, value in zip(by, group)]
    return pa.table([*columns, *table.columns], names=[*by, *table.column_names])


def _groups(table, by: list[str]):
    """Rows of an Arrow table or batch by the values of ``by``."""
    if not by or not table.num_rows:
        if not by:
            yield (), table
        return
    codes = np.zeros(table.num_rows, np.int64)
    for name in by:
        column = table.column(name)
        column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
        coded = column.dictionary_encode(null_encoding="encode")
        codes = codes * len(coded.dictionary) + coded.indices.to_numpy()
    _, first, codes = np.unique(codes, return_index=True, return_inverse=True)
    for number, row in enumerate(first.tolist()):
        yield tuple(table.column(name)[row].as_py() for name in by), table.filter(pa.array(codes == number))


def _send(queries: pa.Table, docs: DataFrame, by: list[str], dim: int):
    return docs.sparkSession.sparkContext.broadcast({group: QueryBlock(part, dim) for group, part in _groups(queries, by)})


def _sent(found: pa.Table, group: tuple, by: list[str], schema: pa.Schema):
    """Batches of bounded size: one is copied several times on its way out of the worker."""
    return _with_group(found, group, by, schema).to_batches(max_chunksize=SENT_ROWS)


def _search_broadcast(shared, docs: DataFrame, by: list[str], settings: dict, schema) -> DataFrame:
    """Hits of the queries that ``_send`` has sent. A task holds documents up to ``BUFFER_BYTES`` and compares them at once."""
    dim = settings["dim"]
    key_schema = docs.select(by).limit(0).toArrow().schema if by else pa.schema([])

    def score(batches):
        searches, waiting, held = {}, {}, 0

        def search():
            for group, parts in waiting.items():
                if group not in searches:
                    searches[group] = BestHits(shared.value[group], settings)
                table = pa.Table.from_batches(parts)
                docs = DocBlock(table["doc_id"].combine_chunks(), to_matrix(table["vector"], dim))
                for found in searches[group].found(docs):
                    yield from _sent(found, group, by, key_schema)
            waiting.clear()

        for batch in batches:
            for rows in range(0, batch.num_rows, most):
                for group, part in _groups(batch.slice(rows, most), by):
                    if group in shared.value:
                        waiting.setdefault(group, []).append(part.select(["doc_id", "vector"]))
                        held += part.num_rows
                if held >= most:
                    yield from search()
                    held = 0
        yield from search()
        for group, hits in searches.items():
            found = hits.take()
            if found is not None:
                yield from _sent(found, group, by, key_schema)

    most = max(1, BUFFER_BYTES // (dim * 8))
    return docs.mapInArrow(score, schema)


def _search_doc_parts(queries: DataFrame, docs: DataFrame, by: list[str], settings: dict, schema, parts: int) -> DataFrame:
    """Documents in ``parts`` parts that are broadcast, and the queries go past each of them: a task gives ``k`` hits per query."""
    dim = settings["dim"]
    key_schema = docs.select(by).limit(0).toArrow().schema if by else pa.schema([])

    def against(shared):
        def score(batches):
            for batch in batches:
                for group, part in _groups(batch, by):
                    if group not in shared.value:
                        continue
                    hits = BestHits(QueryBlock(pa.Table.from_batches([part]), dim), settings)
                    for found in hits.found(shared.value[group]):
                        yield from _sent(found, group, by, key_schema)
                    found = hits.take()
                    if found is not None:
                        yield from _sent(found, group, by, key_schema)

        return queries.mapInArrow(score, schema)

    part = F.pmod(F.xxhash64("doc_id"), F.lit(parts))
    context, found = docs.sparkSession.sparkContext, None
    for number in range(parts):
        table = (docs if parts == 1 else docs.where(part == number)).toArrow()
        blocks = {g: DocBlock(t["doc_id"].combine_chunks(), to_matrix(t["vector"], dim)) for g, t in _groups(table, by)}
        hits = against(context.broadcast(blocks))
        found = hits if found is None else found.unionByName(hits)
    return found


def _search_passes(queries: DataFrame, docs: DataFrame, by: list[str], settings: dict, schema, best, bound: int, least: int) -> DataFrame:
    """Queries in at least ``least`` parts of at most ``bound`` bytes, each searched in a pass of its own over the documents, which stay in their splits.

    A pass stores its best hits, and its queries are dropped everywhere, before the next part is sent. None, if one id has more
    than ``bound`` bytes of rows.
    """
    most, passes = max(1, bound // (settings["dim"] * 8)), least
    queries = materialize(queries, "knn-queries")
    while True:  # the parts are cut by a hash: count them, and cut finer if one is too large
        part = F.pmod(F.xxhash64(*by, "query_id"), F.lit(passes))
        sizes = {r["part"]: r["count"] for r in queries.groupBy(part.alias("part")).count().collect()}
        if max(sizes.values()) <= most:
            break
        if passes >= 4 * least:
            return None
        passes += -(-least // 4)
    folder = new_folder(docs.sparkSession, "knn-passes")
    for number in sorted(sizes):
        shared = _send(queries.where(part == number).toArrow(), docs, by, settings["dim"])
        found = best(_search_broadcast(shared, docs, by, settings, schema))
        found.write.mode("append").parquet(folder)
        shared.destroy()
    return docs.sparkSession.read.schema(found.schema).parquet(folder)


def _pairs_of_blocks(n_queries: int, k: int, sizes: dict, wanted: int) -> tuple[int, int]:
    """How many blocks of queries and of documents: at least ``wanted`` pairs, and as little moved as that allows."""

    def moved(query_blocks, doc_blocks):
        return query_blocks * sizes["doc_bytes"] + doc_blocks * (sizes["query_bytes"] + 50 * n_queries * k)

    least = max(1, ceil(sizes["query_bytes"] / sizes["block_bytes"]))
    choices = [(max(least, ceil(wanted / d)), d) for d in range(1, max(1, wanted) + 1)]
    return min(choices, key=lambda c: moved(*c))


def _search_blocks(queries: DataFrame, docs: DataFrame, by: list[str], settings: dict, schema, blocks: tuple[int, int]) -> DataFrame:
    """Both sides in shuffled blocks, a partition for each pair of them. A task holds the queries of one pair and reads the documents."""
    dim, (query_blocks, doc_blocks) = settings["dim"], blocks
    key_schema = docs.select(by).limit(0).toArrow().schema if by else pa.schema([])

    def block_of(column, blocks):
        return F.pmod(F.xxhash64(column), F.lit(blocks)).cast("int")

    def every(blocks):
        return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))

    left = queries.select(
        *by, F.col("query_id").alias("id"), "vector", "floor", F.lit(0).alias("_side"), block_of("query_id", query_blocks).alias("_q"), every(doc_blocks).alias("_d")
    )
    right = docs.select(
        *by, F.col("doc_id").alias("id"), "vector", F.lit(None).cast("double").alias("floor"), F.lit(1).alias("_side"), every(query_blocks).alias("_q"), block_of("doc_id", doc_blocks).alias("_d")
    )
    pair = F.col("_q") * doc_blocks + F.col("_d")
    both = left.unionByName(right).repartitionById(query_blocks * doc_blocks, pair).sortWithinPartitions("_side", *by)
    most = max(1, BUFFER_BYTES // (dim * 8))

    def score(batches):
        asked, searches, waiting, held = {}, {}, {}, 0

        def search():
            for group, parts in waiting.items():
                if group not in searches:
                    searches[group] = BestHits(QueryBlock(pa.Table.from_batches(asked.pop(group)).rename_columns(["query_id", "vector", "floor"]), dim), settings)
                table = pa.Table.from_batches(parts)
                docs = DocBlock(table["id"].combine_chunks(), to_matrix(table["vector"], dim))
                for found in searches[group].found(docs):
                    yield from _sent(found, group, by, key_schema)
            waiting.clear()

        for batch in batches:
            for (side, *group), part in _groups(batch, ["_side", *by]):
                group = tuple(group)
                if side == 0:
                    asked.setdefault(group, []).append(part.select(["id", "vector", "floor"]))
                elif group in asked or group in searches:
                    waiting.setdefault(group, []).append(part.select(["id", "vector"]))
                    held += part.num_rows
            if held >= most:
                yield from search()
                held = 0
        yield from search()
        for group, hits in searches.items():
            found = hits.take()
            if found is not None:
                yield from _sent(found, group, by, key_schema)

    return both.mapInArrow(score, schema)


def _length(vector: str):
    squares = F.transform(vector, lambda x: x.cast("double") * x.cast("double"))
    return F.sqrt(F.aggregate(squares, F.lit(0.0), lambda a, b: a + b))


def knn(
    queries: DataFrame,
    docs: DataFrame,
    k: int = 1000,
    similarity: str = "cosine",
    *,
    vector: str = "embedding",
    by: tuple[str, ...] = (),
    score_digits: int | None = None,
    eps: float = 1e-6,
    broadcast_bytes: int = PASS_BYTES,
    block_bytes: int = BLOCK_BYTES,
    max_passes: int = MAX_PASSES,
    merge_rows: int = MERGE_ROWS,
    floor_share: float = FLOOR_SHARE,
    floor_docs: DataFrame | None = None,
) -> DataFrame:
    """The ``k`` most similar documents of every query: ``(*by, query_id, doc_id, score, rank)``.

    Every query is compared with every document, or with those of its own ``by`` group. Equal
    scores rank by document id; ``score_digits`` rounds scores before they are ranked. Rows with a null
    vector take no part, NaN in a vector is an error; a query gets fewer rows when there are fewer documents. Document ids
    must be unique.

    Each task may pass on ``k`` rows per query. When that could exceed ``merge_rows`` in all, a
    part of the documents is searched first: its k-th best score is a lower bound of the final
    k-th, and anything below it is dropped inside the tasks. The result is the same. The part
    is ``floor_docs``, any rows of ``docs`` that are cheap to read, such as some of their files
    (``read_vectors_part``); left out, a hashed share is taken, which reads the vectors twice.

    Counting both sides, and collecting the bounded query side, run when this is called, and so do
    the passes, which store their hits in the shared folder, if the queries are above ``broadcast_bytes``.
    """
    if similarity not in SIMILARITIES:
        raise ValueError(f"similarity must be one of {sorted(SIMILARITIES)}")
    if k < 1:
        raise ValueError("k must be positive")
    ship_package(docs.sparkSession)
    by = list(by)
    query_side = queries.where(F.col(vector).isNotNull()).select(
        *by, as_id("query_id").alias("query_id"), F.col(vector).alias("vector")
    )

    def vectors_of(rows):
        return rows.where(F.col(vector).isNotNull()).select(*by, as_id("doc_id").alias("doc_id"), F.col(vector).alias("vector"))

    doc_side = vectors_of(docs)
    schema = doc_side.select(*by, F.col("doc_id").alias("query_id"), "doc_id", F.lit(0.0).alias("score")).schema
    query_size = query_side.agg(F.lit("queries").alias("side"), F.count("*").alias("n"), F.max(F.size("vector")).alias("dim"))
    # Rows are counted without the vector column: file footers hold the number.
    doc_size = docs.agg(F.lit("docs").alias("side"), F.count("*").alias("n"), F.lit(None).cast("int").alias("dim"))
    measured = {row.side: row for row in query_size.unionByName(doc_size).collect()}
    n_queries, n_docs, dim = measured["queries"].n, measured["docs"].n, measured["queries"].dim
    if not n_queries or not n_docs:
        empty = docs.sparkSession.createDataFrame([], schema)
        return empty.withColumn("rank", F.lit(0))
    settings = {"k": k, "dim": dim, "similarity": similarity, "digits": score_digits, "eps": eps}
    # One input split may be all there is of a small corpus; spread the multiplications then.
    cores, shares = docs.sparkSession.sparkContext.defaultParallelism, ceil(n_queries * n_docs * dim / TASK_PRODUCTS)
    wanted, pairs = min(cores, shares), min(3 * cores, shares)
    if wanted > ceil(n_docs * dim * 4 / BLOCK_BYTES):
        doc_side = doc_side.repartition(wanted, "doc_id")
    sizes = {"query_bytes": n_queries * dim * 8, "doc_bytes": n_docs * dim * 8, "block_bytes": block_bytes}

    # Parts by a hash are not all of one size: a ninth is left free in each.
    passes = 1 if sizes["query_bytes"] <= broadcast_bytes else ceil(sizes["query_bytes"] * 9 / 8 / max(broadcast_bytes, 1))

    def best(found):
        return top_per_group(found, [*by, "query_id"], [F.desc("score"), F.asc("doc_id")], k)

    def parts_of(doc_bytes):
        """In how many parts the documents are sent; 0 if they stay. A part gives ``k`` hits a query, a pass as many for each ``BUFFER_BYTES``."""
        few = doc_bytes < sizes["query_bytes"] or (broadcast_bytes >= PASS_BYTES and doc_bytes <= DOC_SHARE * sizes["query_bytes"])
        most = block_bytes if block_bytes >= BLOCK_BYTES else block_bytes // 2
        parts = 1 if doc_bytes <= most else ceil(doc_bytes * 9 / 8 / most)
        return parts if passes > 1 and few and broadcast_bytes and parts <= max_passes else 0

    def search(query_rows, doc_rows, doc_bytes):
        if passes <= 1:
            return best(_search_broadcast(_send(query_rows.toArrow(), doc_rows, by, dim), doc_rows, by, settings, schema))
        doc_parts = parts_of(doc_bytes)
        if doc_parts:
            return best(_search_doc_parts(query_rows.repartition(pairs), doc_rows, by, settings, schema, doc_parts))
        if passes <= max_passes:
            found = _search_passes(query_rows, doc_rows, by, settings, schema, best, broadcast_bytes, passes)
            if found is not None:
                return found
        blocks = _pairs_of_blocks(n_queries, k, {**sizes, "doc_bytes": doc_bytes}, pairs)
        return best(_search_blocks(query_rows, doc_rows, by, settings, schema, blocks))

    no_floor = query_side.withColumn("floor", F.lit(None).cast("double"))
    tasks = ceil(sizes["doc_bytes"] / block_bytes)
    # the k-th best of a share is of rank k / share at best: of documents in few parts it would drop nothing
    in_few = merge_rows >= MERGE_ROWS and 0 < parts_of(sizes["doc_bytes"]) * floor_share < 1
    if n_queries * k * tasks > merge_rows and not in_few:
        share = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < int(floor_share * 1_000_000)
        first_docs = doc_side.where(share) if floor_docs is None else vectors_of(floor_docs)
        part = search(no_floor, first_docs, sizes["doc_bytes"] * floor_share)
        # The same product may differ between two passes by the rounding of its sum: by this share of both lengths.
        share_lost = 4 * (dim + 2) * float(np.finfo(np.float64).eps)
        slack = F.lit(2 * 10.0**-score_digits if score_digits is not None else 0.0)
        if similarity == "ip":
            longest = first_docs.agg(F.max(_length("vector"))).first()[0] or 0.0
            lengths = query_side.select(*by, "query_id", _length("vector").alias("_length"))
            part = part.where(F.col("rank") == k).join(lengths, [*by, "query_id"])
            slack = slack + F.col("_length") * longest * share_lost
        else:
            slack = slack + share_lost
        floors = part.where(F.col("rank") == k).select(*by, "query_id", (F.col("score") - slack).alias("floor"))
        return search(query_side.join(floors, [*by, "query_id"], "left"), doc_side, sizes["doc_bytes"])
    return search(no_floor, doc_side, sizes["doc_bytes"])
