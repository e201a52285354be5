"""The scan over sorted hits against sums taken list by list, however the batches are cut."""

import math
import random

import pyarrow as pa
import pytest

from podium.operators.ranked_sums import list_sums, whole_lists

KS, PS = [1, 3, 10], [0.7, 0.9]


def hits(seed):
    """Lists of 1 to 40 hits with tied scores, sorted as read."""
    dice = random.Random(seed)
    rows = []
    for q in range(30):
        mine = [(dice.randrange(5), f"d{dice.randrange(10**6)}") for _ in range(dice.choice([1, 2, 7, 40]))]
        top = dice.choice([0, 1, 4, 1000])
        for place, (score, doc) in enumerate(sorted(mine, key=lambda m: -m[0]), 1):
            rows.append((None if q == 3 else f"q{q:02}", place == len(mine) and q % 4 == 0, float(score), doc, dice.randint(0, top), dice.randrange(2), top))
    return rows


def batches(rows, sizes):
    names = ["query_id", "_self", "score", "doc_id", "rel", "hole", "max_rel"]
    kinds = [pa.string(), pa.bool_(), pa.float64(), pa.string(), pa.int32(), pa.int32(), pa.int32()]
    at = 0
    while at < len(rows):
        part = rows[at : at + next(sizes)]
        at += len(part)
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in part], kinds[i]) for i in range(7)], names=names)


def plain(rows, by_document):
    lists = {}
    for row in rows:
        lists.setdefault(row[0], []).append(row)
    for q, read in lists.items():
        gain = read
        if by_document:
            gain = sorted(sorted(read, key=lambda r: r[3], reverse=True), key=lambda r: (r[1], -r[2]))
        at = lambda values: [sum(values[:k]) for k in KS]
        hit = [r[4] > 0 for r in gain]
        relevant = [i for i, r in enumerate(read, 1) if r[4] > 0]
        reach, err = 1.0, 0.0
        for i, r in enumerate(read, 1):
            stop = 2.0 ** (r[4] - r[6]) - 2.0 ** -r[6]
            err, reach = err + reach * stop / i, reach * (1 - stop)
        norm = [r[4] / r[6] if r[6] else 0.0 for r in read]
        yield {
            "query_id": q,
            "dcg": at([r[4] / math.log2(i + 1) for i, r in enumerate(gain, 1)]),
            "found": at(hit),
            "precision": at([h * sum(hit[:i]) / i for i, h in enumerate(hit, 1)]),
            "hole": at([r[5] for r in read]),
            "first": min(relevant) if relevant else None,
            "err": err,
            "rbp0": sum(n * 0.7**i for i, n in enumerate(norm)),
            "rbp1": sum(n * 0.9**i for i, n in enumerate(norm)),
        }


@pytest.mark.parametrize("by_document", [False, True])
@pytest.mark.parametrize("largest", [1, 5, 100, 10_000])
def test_sums_of_lists(largest, by_document):
    rows, dice = hits(largest), random.Random(largest)
    sizes = iter(lambda: dice.randint(0 if largest > 1 else 1, largest), -1)
    found = []
    for table in whole_lists(batches(rows, sizes), ["query_id"]):
        found += pa.Table.from_pydict(list_sums(table, ["query_id"], KS, PS, by_document)).to_pylist()
    expected = list(plain(rows, by_document))
    assert [f["query_id"] for f in found] == [e["query_id"] for e in expected]
    for f, e in zip(found, expected):
        for name, value in e.items():
            assert f[name] == (value if name in ("query_id", "first") else pytest.approx(value, rel=1e-12, abs=1e-12)), name


def test_no_hits():
    assert list(whole_lists(iter([]), ["query_id"])) == []
