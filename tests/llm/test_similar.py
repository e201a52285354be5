"""N-gram Jaccard join, exact duplicates and components, against brute force."""

import hashlib
import random
import re
from collections import defaultdict

import numpy as np
import pytest

from podium.llm import exact_dedup, jaccard_join
from podium.llm.components import components
from podium.llm.jaccard_join import JoinConfig, RTree, may_link
from podium.llm.queries import QUERIES


def shingles(text, k=5):
    found = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(found[i : i + k]) for i in range(len(found) - k + 1)) if len(found) >= k else frozenset([tuple(found)] if found else [])


def linked_groups(rows):
    """For each row its smallest linked id, by comparing all pairs."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if sets[a] and 100 * shared >= 80 * len(sets[a] | sets[b]):
                parent[find(a)] = find(b)
    groups = defaultdict(list)
    for i in range(len(rows)):
        groups[find(i)].append(rows[i][0])
    smallest = {g: min((i for i in ids if i is not None), default=None) for g, ids in groups.items()}
    return [(rows[i][0], len(sets[i]), smallest[find(i)]) for i in range(len(rows))]


def found_groups(df):
    return [(r.doc_id, r.n_shingles, r.component_id) for r in df.collect()]


def ordered(rows):
    return sorted(rows, key=str)


def test_whole_table(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()]
    assert ordered(found_groups(QUERIES["op1_ngram_jaccard"](spark, sf_dir))) == ordered(linked_groups(rows))


@pytest.mark.parametrize("config", [JoinConfig(), JoinConfig(rounds=0, cell=3, leaf=2), JoinConfig(rounds=1, groups=8, cell=2)])
def test_odd_rows_and_chains(spark, words, odd_rows, config):
    """Chains of near copies, loose groups and boilerplate, with every kind of cell."""
    dice = random.Random(4)
    rows = list(odd_rows)
    boiler = dice.choices(words, k=60)
    for family in range(4):
        text = dice.choices(words, k=dice.choice([30, 80, 150]))
        for _ in range(9):
            text = list(text)
            for _ in range(dice.randint(0, 3)):
                text[dice.randrange(len(text))] = dice.choice(words)
            rows.append((len(rows) + 100, " ".join(text + (boiler if family % 2 else []))))
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    assert ordered(found_groups(jaccard_join.similar_documents(frame, config))) == ordered(linked_groups(rows))


def test_one_of_each_keeps_columns(odd_documents, odd_rows):
    kept = jaccard_join.one_of_each(odd_documents)
    assert kept.columns == odd_documents.columns
    got = sorted(((r.doc_id, r.text) for r in kept.collect()), key=str)
    empty = [r for r in odd_rows if not shingles(r[1])]
    sets = {}
    for row in sorted(odd_rows, key=lambda r: (r[0] is None, r[0] or 0)):
        if shingles(row[1]):
            group = next((k for k in sets if 100 * len(k & shingles(row[1])) >= 80 * len(k | shingles(row[1]))), None)
            sets.setdefault(group or shingles(row[1]), row)
    assert len(got) == len(empty) + len(sets)
    assert {i for i, t in got if shingles(t)} == {i for i, _ in sets.values()}


def test_empty_table(no_documents):
    assert found_groups(jaccard_join.similar_documents(no_documents)) == []
    assert jaccard_join.one_of_each(no_documents).collect() == []


def test_tree_finds_all_that_the_bound_allows():
    rng = np.random.default_rng(0)
    base = rng.integers(0, 9, (40, 16))
    points = np.concatenate([base, np.maximum(base + rng.integers(-1, 2, base.shape), 0)])
    sizes = points.sum(axis=1)
    x, y = RTree(points, sizes, leaf=4, coarse=4).search(points, sizes, 80)
    small, large = np.minimum.outer(sizes, sizes), np.maximum.outer(sizes, sizes)
    shared = np.minimum(points[:, None], points[None]).sum(axis=2)
    want = np.argwhere(may_link(shared, sizes[:, None] + sizes[None], 80) & (100 * small >= 80 * large))
    assert {tuple(p) for p in want.tolist()} == set(zip(x.tolist(), y.tolist()))


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101), (7, 7)], "a long, b long")
    labels = {r.node: r.label for r in components(links).collect()}
    assert labels == {i: 0 for i in range(51)} | {100: 100, 101: 100}
    assert components(links.where("false")).collect() == []


def exact_brute(rows):
    groups = defaultdict(list)
    for i, t in rows:
        groups[re.sub(r"[\x20\x09-\x0D]", "", t or "")].append((i, t or ""))
    out = []
    for whole, members in groups.items():
        longest = max(len(t) for _, t in members)
        keep = min((i for i, t in members if len(t) == longest and i is not None), default=None)
        for i, _ in members:
            out.append((i, keep, len(members), hashlib.sha256(whole.encode()).hexdigest()))
    return ordered(out)


def test_exact_duplicates(spark, odd_documents, odd_rows, no_documents, stored):
    found = exact_dedup.exact_duplicates(spark, stored(odd_documents)).collect()
    assert ordered([(r.doc_id, r.keep_id, r.group_size, r.text_sha256) for r in found]) == exact_brute(odd_rows)
    kept = defaultdict(int)
    for r in found:
        kept[r.text_sha256] += r.kept
    assert set(kept.values()) == {1}
    assert all(r.doc_id == r.keep_id for r in found if r.kept)
    assert exact_dedup.exact_duplicates(spark, stored(no_documents)).collect() == []


def test_state_goes_on_with_new_files(spark, tmp_path):
    path, state = str(tmp_path / "docs"), str(tmp_path / "state")
    spark.createDataFrame([(5, "a b"), (6, "c")], "doc_id long, text string").coalesce(1).write.parquet(path)
    first = {r.group_size for r in exact_dedup.fold_state(spark, path, state).collect()}
    spark.createDataFrame([(2, "ab "), (9, "c")], "doc_id long, text string").coalesce(1).write.mode("append").parquet(path)
    second = sorted((r.group_size, ~r.keep.not_id) for r in exact_dedup.fold_state(spark, path, state).collect())
    assert first == {1} and second == [(2, 2), (2, 6)]


def test_native_plan(spark, sf_dir):
    plan = QUERIES["op4_exact_dedup"](spark, sf_dir)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan
