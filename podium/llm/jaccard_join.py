"""Join of texts whose sets of word shingles are similar, by count vectors in R-trees.

Two sets link when their Jaccard similarity reaches a threshold. The shingles are hashed into
groups; a set's counts per group are a point. Two sets share at most the sum of the smaller
coordinates, and a set shares with any set of a tree node at most the sum of the minima of its point and
the node's upper corner, so whole subtrees are left out. Pairs that survive are verified on the sets.

How the work is spread:

* Equal sets are one class. Each class is put into a block for each of its rarest shingles, as many as
  two linked sets cannot both miss. How rare a shingle is comes from a table of fixed size with
  counts over all documents. Blocks of one class, and blocks with the same classes, are dropped.
* In each block every class is paired with the block's pivot, which takes one pass over sorted
  rows. Linked pairs make components; a large group of near copies is one component after that.
* What is left are pairs of one block in different components. Blocks are dealt out in cells of bounded
  size (the largest component against the rest, and the rest against itself), and each cell is searched with an R-tree.

Every link joins two classes that are in one component at the end, so the components are exact.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm import tables
from podium.llm.common import blocks, mix
from podium.llm.components import components
from podium.llm.shingles import set_class, shingle_sets
from podium.session import materialize, ship_package


@dataclass(frozen=True)
class JoinConfig:
    words: int = 5
    percent: int = 80  # 100 * shared >= percent * union
    groups: int = 1024
    coarse: int = 128  # groups that tree nodes compare, each of several of the others
    rounds: int = 2  # of pivots
    table_bits: int = 18  # of the table of shingle counts
    cell: int = 1024  # classes of one side of a cell
    leaf: int = 32


#: Bits of the table that tells which documents are wanted, before a join makes sure.
_WANTED_BITS = 22


def point(shingles: np.ndarray, groups: int) -> bytes:
    """Counts per group, in the narrowest of one, two or four bytes each, packed."""
    counts = np.bincount((shingles & np.uint64(groups - 1)).astype(np.int64), minlength=groups)
    narrow = counts.astype("<u1" if counts.max() < 256 else "<u2" if counts.max() < 65536 else "<u4")
    return zlib.compress(narrow.tobytes(), 1)


def points(packed: list[bytes], groups: int) -> np.ndarray:
    kinds = {groups: "<u1", 2 * groups: "<u2", 4 * groups: "<u4"}
    plain = [zlib.decompress(p) for p in packed]
    return np.stack([np.frombuffer(p, kinds[len(p)]).astype(np.int32) for p in plain])


def may_link(shared: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Whether so many shared shingles are enough for sets of these sizes together."""
    return shared * (100 + percent) >= sizes * percent


class RTree:
    """Points with set sizes, packed by splitting at the median of the widest coordinate.

    Nodes and leaves compare coarse points, whose groups are each the sum of several; pairs that are
    left are compared by all groups.
    """

    def __init__(self, points: np.ndarray, sizes: np.ndarray, leaf: int = 32, coarse: int = 128):
        self.fine, self.sizes, self.leaf = points, sizes, leaf
        self.coarse = min(coarse, points.shape[1])
        self.points = self._folded(points)
        self.root = self._node(np.arange(len(points)))

    def _folded(self, points: np.ndarray) -> np.ndarray:
        return points.reshape(len(points), -1, self.coarse).sum(axis=1)

    def _node(self, rows: np.ndarray) -> tuple:
        own = self.points[rows]
        corner, least, most = own.max(axis=0), self.sizes[rows].min(), self.sizes[rows].max()
        spread = corner - own.min(axis=0)
        if len(rows) <= self.leaf or not spread.any():
            return corner, least, most, rows, None
        order = np.argsort(own[:, spread.argmax()], kind="stable")
        halves = rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]
        return corner, least, most, None, [self._node(half) for half in halves]

    def search(self, points: np.ndarray, sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
        """All (query, row) whose bound allows a link."""
        fine, points = points, self._folded(points)
        found, waiting = [], [(self.root, np.arange(len(points)))]
        while waiting:
            (corner, least, most, rows, children), some = waiting.pop()
            n = sizes[some]
            some = some[(100 * n >= percent * least) & (100 * most >= percent * n)]
            n = sizes[some]
            bound = np.minimum(points[some], corner).sum(axis=1)
            some = some[may_link(bound, n + np.maximum(least, (percent * n + 99) // 100), percent)]
            if not len(some):
                continue
            if children:
                waiting += [(child, some) for child in children]
                continue
            for row in rows:
                n, m = sizes[some], self.sizes[row]
                shared = np.minimum(points[some], self.points[row]).sum(axis=1)
                good = some[may_link(shared, n + m, percent) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))]
                shared = np.minimum(fine[good], self.fine[row]).sum(axis=1)
                good = good[may_link(shared, sizes[good] + self.sizes[row], percent)]
                found.append((good, np.full(len(good), row)))
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def describe(rows: DataFrame, config: JoinConfig) -> DataFrame:
    """Rows (doc_id, n, class, point) for each row (doc_id, text), and rows of the table of shingle counts."""
    schema = pa.schema(
        [("doc_id", pa.int64()), ("n", pa.int64()), ("class", pa.int64()), ("point", pa.binary())]
        + tables.FIELDS
    )

    def run(batches):
        counts = np.zeros(1 << config.table_bits, np.int64)
        for batch in blocks(batches, "text"):
            sets = shingle_sets(batch.column("text"), config.words)
            every = np.concatenate([*sets, np.zeros(0, np.uint64)])
            counts += np.bincount((every >> np.uint64(64 - config.table_bits)).astype(np.int64), minlength=len(counts))
            columns = {
                "doc_id": batch.column("doc_id"),
                "n": pa.array(map(len, sets), pa.int64()),
                "class": pa.array([set_class(s) for s in sets], pa.int64()),
                "point": pa.array([point(s, config.groups) for s in sets], pa.binary()),
            }
            none = {f.name: pa.nulls(len(sets), f.type) for f in list(schema)[4:]}
            yield pa.RecordBatch.from_pydict(columns | none, schema=schema)
        last = tables.partial(counts)
        none = [pa.nulls(last.num_rows, f.type) for f in list(schema)[:4]]
        yield pa.RecordBatch.from_arrays([*none, *last.columns], schema=schema)

    return rows.mapInArrow(run, f"doc_id long, n long, class long, point binary, {tables.SHAPE}")


def _rarest(rows: DataFrame, table: np.ndarray, config: JoinConfig) -> DataFrame:
    """(shingle, class, n) for the rarest shingles of each text, of which linked sets share one at least."""
    shared = rows.sparkSession.sparkContext.broadcast(np.minimum(table, 2**31 - 1).astype(np.int32))
    shift = np.uint64(64 - config.table_bits)

    def run(batches):
        for batch in blocks(batches, "text"):
            counts, tokens, classes, sizes = shared.value, [], [], []
            for s in shingle_sets(batch.column("text"), config.words):
                if len(s):
                    order = np.argsort(counts[(s >> shift).astype(np.int64)], kind="stable")
                    tokens.append(s[order[: len(s) - (config.percent * len(s) + 99) // 100 + 1]])
                    classes.append(np.full(len(tokens[-1]), set_class(s)))
                    sizes.append(np.full(len(tokens[-1]), len(s), np.int32))
            if tokens:
                columns = [np.concatenate(tokens).view(np.int64), np.concatenate(classes), np.concatenate(sizes)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["shingle", "class", "n"])

    return rows.mapInArrow(run, "shingle long, class long, n int")


def _blocks(rarest: DataFrame) -> DataFrame:
    """(block, class, n): the classes of each shingle that several classes have.

    Rows come sorted by shingle and class. A shingle whose rows lie in one Arrow batch is named by
    a hash of its classes, so that shingles with the same classes become one block.
    """

    def run(batches: Iterator[pa.RecordBatch]):
        held = np.zeros((0, 3), np.int64)
        split = None  # a shingle some of whose rows have been given away
        last = None  # the class given away last
        for batch in batches:
            own = np.stack([c.to_numpy().astype(np.int64) for c in batch.columns], axis=1)
            held = np.concatenate([held, own])
            cut = np.searchsorted(held[:, 0], held[-1, 0]) if len(held) else 0
            if cut == 0 and len(held) > 200_000:  # one shingle: its rows go on as they are
                split, cut = held[-1, 0], len(held) - 1
            yield from named(held[:cut], split, last)
            last = held[cut - 1, 1] if cut and held[cut - 1, 0] == split else last
            held = held[cut:]
        yield from named(held, split, last)

    def named(rows, split, last):
        if not len(rows):
            return
        again = np.zeros(len(rows), bool)
        again[1:] = (rows[1:, :2] == rows[:-1, :2]).all(axis=1)
        again[0] = rows[0, 0] == split and rows[0, 1] == last
        rows = rows[~again]
        if not len(rows):
            return
        starts = np.flatnonzero(np.concatenate([[True], rows[1:, 0] != rows[:-1, 0]]))
        sizes = np.diff(np.concatenate([starts, [len(rows)]]))
        names = np.add.reduceat(mix(rows[:, 1].astype(np.uint64)), starts)
        names = mix(names + sizes.astype(np.uint64)).view(np.int64)
        keep = sizes > 1
        if split is not None:
            parts = rows[starts, 0] == split
            names[parts], keep = split, keep | parts
        of = np.repeat(np.arange(len(starts)), sizes)
        some = keep[of]
        columns = [names[of][some], rows[some, 1], rows[some, 2]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["block", "class", "n"])

    found = rarest.repartition("shingle").sortWithinPartitions("shingle", "class")
    return found.mapInArrow(run, "block long, class long, n long").distinct()


def _pivot_pairs(members: DataFrame, percent: int, number: int) -> DataFrame:
    """(a, b) for each row (block, class, n, label) and its block's pivot, if their labels differ and sizes allow a link."""
    turn = F.xxhash64("class", F.lit(number))

    def run(batches):
        block = pivot = n = label = None
        for batch in batches:
            names, classes, sizes, labels = (c.to_numpy() for c in batch.columns[:4])
            starts = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]])) if len(names) else []
            of = np.repeat(np.arange(len(starts)), np.diff(np.concatenate([starts, [len(names)]]).astype(np.int64)))
            if not len(names):
                continue
            heads = classes[starts].copy(), sizes[starts].copy(), labels[starts].copy()
            if names[0] == block:
                heads[0][0], heads[1][0], heads[2][0] = pivot, n, label
            block, pivot, n, label = names[-1], heads[0][-1], heads[1][-1], heads[2][-1]
            small, large = np.minimum(sizes, heads[1][of]), np.maximum(sizes, heads[1][of])
            good = (heads[2][of] != labels) & (100 * small >= percent * large)
            yield pa.RecordBatch.from_arrays([pa.array(classes[good]), pa.array(heads[0][of][good])], ["a", "b"])

    rows = members.select("block", "class", "n", "label").repartition("block").sortWithinPartitions("block", turn, "class")
    return rows.mapInArrow(run, "a long, b long").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def _bounded(pairs: DataFrame, classes: DataFrame, config: JoinConfig) -> DataFrame:
    """The pairs that the sum of minima leaves."""
    side = lambda k: classes.select(F.col("class").alias(k), F.col("n").alias(f"n_{k}"), F.col("point").alias(f"p_{k}"))

    def run(batches):
        for batch in batches:
            if batch.num_rows:
                sizes = batch.column("n_a").to_numpy() + batch.column("n_b").to_numpy()
                p, q = (points(batch.column(k).to_pylist(), config.groups) for k in ("p_a", "p_b"))
                good = may_link(np.minimum(p, q).sum(axis=1), sizes, config.percent)
                yield batch.select(["a", "b"]).filter(pa.array(good))

    return pairs.join(side("a"), "a").join(side("b"), "b").mapInArrow(run, "a long, b long")


def _wanted_sets(rows: DataFrame, pairs: DataFrame, classes: DataFrame, config: JoinConfig) -> DataFrame:
    """(class, shingles) of the classes in pairs, from one document of each.

    A table of fixed size tells which documents may be wanted, so only their shingles are made again and
    moved; the join makes sure.
    """
    need = pairs.select(F.explode(F.array("a", "b")).alias("class")).distinct().join(classes.select("class", "doc_id"), "class")
    need = materialize(need, "wanted")
    sent = rows.sparkSession.sparkContext.broadcast(tables.marked(need.select("doc_id"), _WANTED_BITS))

    def run(batches):
        for batch in batches:
            hit = sent.value[tables.place(batch.column("doc_id"), _WANTED_BITS)]
            for part in blocks([batch.filter(pa.array(hit))], "text"):
                sets = shingle_sets(part.column("text"), config.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array([set_class(s) for s in sets], pa.int64()),
                        pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "class", "shingles"],
                )

    made = rows.mapInArrow(run, "doc_id long, class long, shingles array<long>")
    same = (made["class"] == need["class"]) & made.doc_id.eqNullSafe(need.doc_id)
    return materialize(made.join(need, same, "left_semi").dropDuplicates(["class"]).select("class", "shingles"), "sets")


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) that link."""
    side = lambda k: sets.select(F.col("class").alias(k), F.col("shingles").alias(f"s_{k}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("s_a", "s_b"))
    return both.where(100 * shared >= percent * (F.size("s_a") + F.size("s_b") - shared)).select("a", "b")


def _labelled(members: DataFrame, links: DataFrame | None) -> DataFrame:
    if links is None:
        return members.withColumn("label", F.col("class"))
    labels = components(links).select(F.col("node").alias("class"), "label")
    return members.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))


def _cells(members: DataFrame, cell: int) -> DataFrame:
    """The rows (block, class, label) of blocks with several labels, dealt out to the cells in which their pairs meet.

    A row of the block's largest label is on side 1 of the cells of its part and every part of the
    rest; a row of the rest is on side 0 of these, and in cells with every other part of the rest.
    """
    sizes = members.groupBy("block", "label").agg(F.count(F.lit(1)).alias("size"))
    sizes = sizes.groupBy("block").agg(
        F.max(F.struct("size", "label")).alias("most"), F.sum("size").alias("all"), F.count(F.lit(1)).alias("labels")
    )
    sizes = sizes.where("labels > 1").select(
        "block", F.col("most.label").alias("main"), F.ceil(F.col("most.size") / cell).cast("int").alias("m"),
        F.ceil((F.col("all") - F.col("most.size")) / cell).cast("int").alias("u"),
    )
    rows = members.join(sizes, "block")
    main = F.col("label") == F.col("main")
    part = F.pmod(F.xxhash64("class"), F.when(main, F.col("m")).otherwise(F.col("u"))).cast("int")
    rows = rows.withColumn("part", part)
    every = lambda n, f: F.transform(F.sequence(F.lit(0), F.col(n) - 1), f)
    place = lambda i, j, kind, side: F.struct(i.alias("i"), j.alias("j"), F.lit(kind).alias("kind"), side.alias("side"))
    zero, one = F.lit(0), F.lit(1)
    of_main = every("u", lambda i: place(i, F.col("part"), 0, one))
    of_rest = F.concat(
        every("m", lambda j: place(F.col("part"), j, 0, zero)),
        F.when(
            F.col("u") > 0,
            every("u", lambda j: place(F.least("part", j), F.greatest("part", j), 1, F.when(F.col("part") <= j, zero).otherwise(one))),
        ),
    )
    spread = F.explode(F.when(main, of_main).otherwise(of_rest)).alias("at")
    return rows.select("block", "class", "label", spread).select("block", "class", "label", "at.*")


def _tree_pairs(members: DataFrame, classes: DataFrame, config: JoinConfig) -> DataFrame:
    """(a, b) for all pairs of a block with different labels that the bound leaves."""
    rows = _cells(members.select("block", "class", "label"), config.cell)
    rows = rows.join(classes.select("class", "n", "point"), "class")
    key = ["block", "kind", "i", "j"]
    rows = rows.select(*key, "side", "class", "label", "n", "point").repartition(*key).sortWithinPartitions(*key, "side", "class")

    def pairs(cell: pa.Table) -> pa.RecordBatch:
        side, ids, labels, n = (cell.column(k).to_numpy() for k in ("side", "class", "label", "n"))
        p = points(cell.column("point").to_pylist(), config.groups)
        queries = np.flatnonzero(side == 0)
        others = queries if cell.column("kind")[0].as_py() and cell.column("i")[0].as_py() == cell.column("j")[0].as_py() else np.flatnonzero(side == 1)
        a = b = np.zeros(0, np.int64)
        if len(queries) and len(others):
            x, y = RTree(p[others], n[others], config.leaf, config.coarse).search(p[queries], n[queries], config.percent)
            a, b = queries[x], others[y]
            good = labels[a] != labels[b]
            a, b = ids[a[good]], ids[b[good]]
        return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])

    def run(batches):
        held, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            names = np.stack([batch.column(k).to_numpy().astype(np.int64) for k in key], axis=1)
            cuts = (1 + np.flatnonzero((names[1:] != names[:-1]).any(axis=1))).tolist()
            if held and (names[0] != np.array([held[0].column(k)[0].as_py() for k in key])).any():
                yield pairs(pa.Table.from_batches(held))
                held = []
            for begin, end in zip([0, *cuts], [*cuts, batch.num_rows]):
                if held and begin:
                    yield pairs(pa.Table.from_batches(held))
                    held = []
                held.append(batch.slice(begin, end - begin))
        if held:
            yield pairs(pa.Table.from_batches(held))

    return rows.mapInArrow(run, "a long, b long").distinct()


def similar_documents(
    documents: DataFrame, config: JoinConfig = JoinConfig(), id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row per document: doc_id, n_shingles, class, label, component_id (the smallest doc_id that links reach).

    ``class`` is the same for equal sets, ``label`` for all sets of a component.

    A null or empty text, or one of white space only, has no shingles and is a component of its own. Equal sets, such as those of
    repeated rows, are one class. A row without an id is linked like others; a component of such rows
    only has no id. A document of any length counts whole; other columns are ignored.
    """
    ship_package(documents.sparkSession)
    rows = documents.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text"))
    described = materialize(describe(rows, config), "described")
    table = tables.total(described.where("slice is not null").select("slice", "part", "numbers"), 1 << config.table_bits, "<i8")
    described = described.where("slice is null").select("doc_id", "n", "class", "point")
    members = materialize(_blocks(_rarest(rows, table, config)), "blocks")
    classes = described.where("n > 0").groupBy("class").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("point").alias("point"))
    classes = materialize(classes.join(members.select("class").distinct(), "class", "left_semi"), "classes")

    links = None
    for number in range(config.rounds + 1):
        labelled = materialize(_labelled(members, links), "labelled")
        if number < config.rounds:
            pairs = _bounded(_pivot_pairs(labelled, config.percent, number), classes, config)
        else:
            pairs = _tree_pairs(labelled, classes, config)
        pairs = materialize(pairs, "pairs")
        found = materialize(_verified(pairs, _wanted_sets(rows, pairs, classes, config), config.percent), "found")
        links = found if links is None else links.union(found)

    labels = components(links).select(F.col("node").alias("class"), "label")
    own = described.join(labels, "class", "left").withColumn("label", F.coalesce("label", "class"))
    smallest = own.where("n > 0").groupBy("label").agg(F.min("doc_id").alias("component_id"))
    linked = own.where("n > 0").join(smallest, "label").select("doc_id", F.col("n").alias("n_shingles"), "class", "label", "component_id")
    alone = own.where("n = 0").select("doc_id", F.col("n").alias("n_shingles"), "class", "label", F.col("doc_id").alias("component_id"))
    return linked.unionByName(alone)


def one_of_each(documents: DataFrame, config: JoinConfig = JoinConfig(), id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The documents without those that are linked with one of smaller id, directly or over others.

    Documents without shingles all stay. Rows without an id stay only if their whole group has none; of
    rows that repeat an id and a set, one stays. Columns are those of ``documents``.
    """
    found = materialize(similar_documents(documents, config, id_column, text_column), "similar")
    found = found.where("n_shingles > 0")
    ordered = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "class")
    groups = found.groupBy("label").agg(F.min(ordered).alias("stays"), F.count(F.lit(1)).alias("size")).where("size > 1")
    groups = materialize(groups, "groups")
    members = found.join(groups.select("label"), "label", "left_semi").select("doc_id")
    sent = documents.sparkSession.sparkContext.broadcast(tables.marked(members, _WANTED_BITS))
    rows = documents.select(F.struct(*documents.columns).alias("row"))
    id_place, text_place = documents.columns.index(id_column), documents.columns.index(text_column)

    def part(member: bool):
        """The rows whose id may be that of a member of a group, with their classes; or all others."""

        def run(batches):
            for batch in batches:
                whole = batch.column("row")
                ids = whole.field(id_place).cast(pa.int64())
                some = pa.RecordBatch.from_arrays([whole, ids, whole.field(text_place)], ["row", "id", "text"])
                some = some.filter(pa.array(sent.value[tables.place(ids, _WANTED_BITS)] == member))
                for piece in blocks([some], "text"):
                    sets = shingle_sets(piece.column("text"), config.words) if member else []
                    classes = pa.array([set_class(s) if len(s) else None for s in sets] if member else [None] * piece.num_rows, pa.int64())
                    yield pa.RecordBatch.from_arrays([piece.column("row"), piece.column("id"), classes], ["row", "id", "class"])

        return rows.mapInArrow(run, f"row {rows.schema['row'].dataType.simpleString()}, id long, class long")

    maybe = part(True)
    first = groups.select("stays.doc_id", F.col("stays.class").alias("of"), F.lit(True).alias("stays"))
    # rows of no group: their class is in none
    grouped = found.join(groups.select("label"), "label", "left_semi").select(F.col("class").alias("of")).distinct().withColumn("grouped", F.lit(True))
    maybe = maybe.join(grouped, maybe["class"] == grouped["of"], "left").drop("of")
    maybe = maybe.join(first, (maybe["class"] == first["of"]) & maybe["id"].eqNullSafe(first["doc_id"]), "left").drop("of", "doc_id")
    alone = maybe.where("grouped is null").select("row")
    order = Window.partitionBy("class", "id").orderBy(F.lit(1))
    kept = maybe.where("stays").withColumn("turn", F.row_number().over(order)).where("turn = 1").select("row")
    return part(False).select("row").union(alone).union(kept).select("row.*")
