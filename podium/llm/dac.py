"""Token ids in directly addressable codes.

An id is split into chunks of eight bits, lowest first. Level 0 holds the first chunk of every
id, level 1 the second chunk of the ids that have one, and so on. Each level has a bitmap that
tells which of its entries go on in the next level, and a rank directory that counts the set
bits before every 512th one. The place of an entry in the next level is the rank of its bit, so
any token is read by one lookup per level; no block is decoded.

One file holds whole documents, one after the other, up to about ``file_tokens`` ids:

    "PDAC0001", u64 documents, u64 tokens, u64 levels
    i64 document id, u8 is null, u64 first token           per document; one more first token
    per level: u64 entries, entries x u8 chunk, bitmap (bit i of byte i / 8), u64 rank per 512 bits
"""

from __future__ import annotations

import os
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from podium.llm.common import blocks, group_rows, hashed_words, spread, text_bytes
from podium.llm.files import new_file, open_file
from podium.session import new_folder, ship_package

MAGIC = b"PDAC0001"
RANK_BITS = 512
#: Ids in a file before it is closed; a task holds one file at a time.
FILE_TOKENS = 1_000_000
#: Distinct pieces of text whose ids a Python worker keeps, some 30 bytes each, and those that are encoded at a time.
KEPT_PIECES, PORTION = 1_000_000, 4_000

_CLASSES = np.zeros(256, np.uint8)
_CLASSES[[*range(65, 91), *range(97, 123)]] = 1
_CLASSES[[c for c in range(33, 127) if not chr(c).isalnum() and chr(c) != "'"]] = 2


class Encoder:
    """Ids of texts by a ``tokenizers`` file.

    ``independent``: the tokenizer drops white space, lower-cases, and never joins an ASCII letter
    with ASCII punctuation other than the apostrophe. Its ids of a text are then those of the
    pieces between such places, so each distinct piece is encoded once and its ids are looked up
    by its 64-bit hash afterwards. Texts in which a special token of the vocabulary may occur are
    encoded as they are.
    """

    def __init__(self, path: str, independent: bool = False):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.independent = independent
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self._forget()

    def _forget(self, keep: np.ndarray | None = None):
        """Keep the pieces that are marked only."""
        keep = np.zeros(0, np.int64) if keep is None else np.flatnonzero(keep)
        hashes, counts, uses = (getattr(self, n)[keep] if len(keep) else np.zeros(0, k) for n, k in self.ARRAYS)
        ids = self._ids(keep) if len(keep) else np.zeros(0, np.uint32)
        self.hashes, self.counts, self.uses, self.ids = hashes, counts, uses // 2, ids
        self.starts = (np.cumsum(counts) - counts).astype(np.int32)

    ARRAYS = (("hashes", np.uint64), ("counts", np.int32), ("uses", np.int32))

    def _ids(self, at: np.ndarray) -> np.ndarray:
        """The ids of the pieces at these places, one after the other."""
        starts, counts = self.starts[at], self.counts[at]
        within = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
        return self.ids[np.repeat(starts, counts) + within]

    def direct(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, hashes: np.ndarray, piece):
        """Add pieces whose hashes are new and sorted; before there are too many, those that few blocks of text use go."""
        if len(self.hashes) and len(self.hashes) + len(hashes) > KEPT_PIECES:
            self._forget(self.uses > max(1, np.partition(self.uses, len(self.uses) // 2)[len(self.uses) // 2]))
            if len(self.hashes) + len(hashes) > KEPT_PIECES:
                self._forget()
        counts, ids = [], []
        for begin in range(0, len(hashes), PORTION):
            found = self.direct(piece(slice(begin, begin + PORTION)))
            counts.append(np.fromiter(map(len, found), np.int32, len(found)))
            ids.append(np.fromiter((i for f in found for i in f), np.uint32, int(counts[-1].sum())))
        counts = np.concatenate(counts)
        at = np.searchsorted(self.hashes, hashes)
        starts = (len(self.ids) + np.cumsum(counts) - counts).astype(np.int32)
        self.starts, self.counts = np.insert(self.starts, at, starts), np.insert(self.counts, at, counts)
        self.hashes, self.uses = np.insert(self.hashes, at, hashes), np.insert(self.uses, at, 0)
        self.ids = np.concatenate([self.ids, *ids])

    def _known(self, hashes: np.ndarray, begins: np.ndarray, ends: np.ndarray, data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of at most ``KEPT_PIECES`` pieces, and all ids; new pieces are learned."""
        distinct, first, slots = np.unique(hashes, return_index=True, return_inverse=True)
        for turn in range(3):
            at = np.minimum(np.searchsorted(self.hashes, distinct), max(len(self.hashes) - 1, 0))
            new = np.ones(len(distinct), bool) if not len(self.hashes) else self.hashes[at] != distinct
            if not new.any():
                break
            if turn:  # pieces of this block had to go: only they are kept
                self._forget()
                new[:] = True
            own = first[new]
            self._learn(distinct[new], lambda some: [data[begins[i] : ends[i]].tobytes().decode() for i in own[some]])
        self.uses[at] += 1
        at = at[slots]
        return self.counts[at], self._ids(at)

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each text, and all ids; a null text has none."""
        texts = pc.fill_null(texts, "")
        if not self.independent:
            found = self.direct(texts.to_pylist())
            counts = np.fromiter(map(len, found), np.int64, len(found))
            return counts, np.fromiter((i for ids in found for i in ids), np.uint32, int(counts.sum()))
        lower = pc.ascii_lower(texts)
        odd = np.zeros(len(texts), bool)
        for token in self.special:
            odd |= pc.match_substring(lower, token.lower()).to_numpy(zero_copy_only=False)
        # pieces as they are written: some letters and marks compose only if they are lower-cased before
        plain = pc.if_else(pa.array(odd), "", texts) if odd.any() else texts
        per_text, hashes, begins, ends = hashed_words(plain, _CLASSES)
        data = text_bytes(plain)[0]
        found = [self._known(hashes[at : at + KEPT_PIECES], begins[at:], ends[at:], data) for at in range(0, len(hashes), KEPT_PIECES)]
        counts = np.concatenate([np.zeros(0, np.int64), *(c for c, _ in found)])
        ids = np.concatenate([np.zeros(0, np.uint32), *(i for _, i in found)])
        lengths = np.bincount(group_rows(per_text), counts, len(texts)).astype(np.int64)
        if not odd.any():
            return lengths, ids
        parts, at = [], np.concatenate([[0], np.cumsum(lengths)])
        for row in range(len(texts)):
            own = ids[at[row] : at[row + 1]]
            if odd[row]:
                own = np.asarray(self.direct([texts[row].as_py()])[0], np.uint32)
                lengths[row] = len(own)
            parts.append(own)
        return lengths, np.concatenate(parts)


_ENCODERS: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, independent: bool) -> Encoder:
    """The one encoder of this Python worker, which outlives a task."""
    if (path, independent) not in _ENCODERS:
        _ENCODERS.clear()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        _ENCODERS[path, independent] = Encoder(path, independent)
    return _ENCODERS[path, independent]


def pack(doc_ids: list[int | None], counts: np.ndarray, ids: np.ndarray) -> bytes:
    """One file of documents with ``counts`` ids each."""
    out, levels, rest = [], 0, np.asarray(ids, np.uint32)
    while len(rest) or not levels:
        goes_on = (rest >> np.uint32(8)) > 0
        bits = np.packbits(goes_on, bitorder="little")
        blocks_set = np.add.reduceat(goes_on, np.arange(0, len(rest), RANK_BITS), dtype=np.uint64) if len(rest) else []
        ranks = np.concatenate([[0], np.cumsum(blocks_set)[:-1]]) if len(rest) else np.zeros(0)
        out += [struct.pack("<Q", len(rest)), (rest & np.uint32(255)).astype(np.uint8).tobytes(), bits.tobytes()]
        out.append(ranks.astype("<u8").tobytes())
        rest = (rest >> np.uint32(8))[goes_on]
        levels += 1
    null = np.array([d is None for d in doc_ids], np.uint8)
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    firsts = np.concatenate([[0], np.cumsum(counts)]).astype("<u8")
    head = MAGIC + struct.pack("<QQQ", len(doc_ids), int(firsts[-1]), levels)
    return b"".join([head, known.tobytes(), null.tobytes(), firsts.tobytes(), *out])


class TokenFile:
    """A file that has been read into memory or mapped into it."""

    def __init__(self, data: bytes):
        if data[:8] != MAGIC:
            raise ValueError("not a token file")
        n, self.n_tokens, levels = struct.unpack_from("<QQQ", data, 8)
        self.at, self.data, self.levels = 32, data, []
        known, null = self._take("<i8", n), self._take(np.uint8, n)
        self.doc_ids = [None if bad else int(d) for d, bad in zip(known, null)]
        self.firsts = self._take("<u8", n + 1).astype(np.int64)
        for _ in range(levels):
            size = int(self._take("<u8", 1)[0])
            chunks, bits = self._take(np.uint8, size), self._take(np.uint8, -(-size // 8))
            self.levels.append((chunks, bits, self._take("<u8", -(-size // RANK_BITS))))
        if self.at != len(data):
            raise ValueError("a token file of another length than it says")

    def _take(self, kind, n: int) -> np.ndarray:
        found = np.frombuffer(self.data, kind, n, self.at)
        self.at += found.nbytes
        return found

    def token(self, i: int) -> int:
        """The id at place ``i`` of the file: one lookup and one rank per level."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        value, shift = 0, 0
        for chunks, bits, ranks in self.levels:
            value |= int(chunks[i]) << shift
            if not bits[i // 8] >> (i % 8) & 1:
                break
            block = i // RANK_BITS
            before = int.from_bytes(bits[block * RANK_BITS // 8 : i // 8 + 1].tobytes(), "little")
            before &= (1 << (i - block * RANK_BITS)) - 1
            i, shift = int(ranks[block]) + before.bit_count(), shift + 8
        return value

    def tokens(self) -> np.ndarray:
        """All ids."""
        rest = np.zeros(0, np.uint32)
        for chunks, bits, _ in reversed(self.levels):
            own = chunks.astype(np.uint32)
            own[np.flatnonzero(np.unpackbits(bits, count=len(chunks), bitorder="little"))] |= rest << np.uint32(8)
            rest = own
        return rest


def write_tokens(
    documents: DataFrame,
    tokenizer_path: str,
    folder: str | None = None,
    end_id: int | None = 1,
    independent: bool = False,
    id_column: str = "doc_id",
    text_column: str = "text",
    file_tokens: int = FILE_TOKENS,
) -> DataFrame:
    """Write the ids of all texts in ascending order of ``id_column``; the list of files is returned.

    ``folder`` is a new one below the shared folder by default. The list has file (its name),
    folder, n_docs, n_tokens and start, the ids in all files before it; it is stored, so files are
    written once. ``end_id`` ends each document. A null text has the end id only; rows without an
    id come first; equal ids stand in the order of a hash of their texts; an empty table gives an
    empty list. Other columns are ignored. The tokenizer file must be found by every executor.
    """
    spark = documents.sparkSession
    ship_package(spark)
    folder = folder or new_folder(spark, "tokens")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, part, number = encoder(tokenizer_path, independent), TaskContext.get().partitionId(), 0
        doc_ids, counts, ids, held = [], [], [], 0

        def close():
            nonlocal doc_ids, counts, ids, held, number
            data = pack(doc_ids, np.concatenate(counts), np.concatenate(ids))
            with new_file(folder, "dac") as (name, stream):
                stream.write(data)
            row = {"part": part, "number": number, "file": name, "n_docs": len(doc_ids), "n_tokens": held}
            doc_ids, counts, ids, held, number = [], [], [], 0, number + 1
            return pa.RecordBatch.from_pylist([row], schema=listed)

        for batch in blocks(batches, "text"):
            lengths, found = own.encode(batch.column("text"))
            if end_id is not None:
                found = np.insert(found, np.cumsum(lengths), end_id)
                lengths = lengths + 1
            doc_ids += batch.column("id").to_pylist()
            counts.append(lengths)
            ids.append(found)
            held += len(found)
            if held >= file_tokens:
                yield close()
        if doc_ids:
            yield close()

    listed = pa.schema(
        [("part", pa.int32()), ("number", pa.int32()), ("file", pa.string()), ("n_docs", pa.int64()), ("n_tokens", pa.int64())]
    )
    ordered = (
        documents.select(F.col(id_column).cast("long").alias("id"), F.col(text_column).alias("text"))
        .repartitionByRange("id")
        .sortWithinPartitions("id", F.xxhash64("text"))
    )
    path = new_folder(spark, "token-files")
    ordered.mapInArrow(write, "part int, number int, file string, n_docs long, n_tokens long").write.parquet(path)
    files = spark.read.parquet(path)
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per task
    parts = files.groupBy("part").agg(F.sum("n_tokens").alias("all")).select("part", F.sum("all").over(before).alias("base"))
    earlier = Window.partitionBy("part").orderBy("number").rowsBetween(Window.unboundedPreceding, -1)
    start = F.coalesce("base", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(earlier), F.lit(0))
    return files.join(parts, "part").select("file", F.lit(folder).alias("folder"), "n_docs", "n_tokens", start.alias("start"))


def read_tokens(files: DataFrame, with_ids: bool = False) -> DataFrame:
    """One row per document of the files: doc_id, start, n_tokens, ids_crc32 and, if asked for, ids."""
    ship_package(files.sparkSession)
    fields = [("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]
    fields += [("ids", pa.list_(pa.int64()))] * with_ids
    schema = pa.schema(fields)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with open_file(row["folder"], row["file"]) as stream:
                    data = TokenFile(stream.read())
                ids, firsts = data.tokens().astype("<u4"), data.firsts
                spans = list(zip(firsts[:-1].tolist(), firsts[1:].tolist()))
                columns = [
                    pa.array(data.doc_ids, pa.int64()),
                    pa.array(firsts[:-1] + row["start"]),
                    pa.array(np.diff(firsts)),
                    pa.array([zlib.crc32(ids[a:b].tobytes()) for a, b in spans], pa.int64()),
                ]
                if with_ids:
                    columns.append(pa.ListArray.from_arrays(pa.array(firsts.astype(np.int32)), pa.array(ids.astype(np.int64))))
                yield pa.RecordBatch.from_arrays(columns, schema=schema)

    shape = "doc_id long, start long, n_tokens long, ids_crc32 long" + ", ids array<long>" * with_ids
    return spread(files.select("folder", "file", "start"), "file").mapInArrow(read, shape)
