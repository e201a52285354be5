"""Records cut in parallel against parsing whole files, for splits of any size."""

import csv
import io
import json
import random

import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.sources import keyed_json, tables
from podium.sources.records import OBJECT_ENTRIES, QUOTED_LINES, read_records, transitions

HARD = '"\\{}[],: \n\té😀ab'


@pytest.fixture(params=[7, 64, 1 << 20])
def split_bytes(request, spark):
    settings = {"spark.sql.files.maxPartitionBytes": str(request.param), "spark.sql.files.openCostInBytes": "1"}
    for name, value in settings.items():
        spark.conf.set(name, value)
    yield request.param
    for name in settings:
        spark.conf.unset(name)


def any_value(dice, depth=0):
    kind = dice.randrange(7 if depth < 3 else 5)
    if kind == 5:
        return [any_value(dice, depth + 1) for _ in range(dice.randrange(4))]
    if kind == 6:
        return {any_text(dice): any_value(dice, depth + 1) for _ in range(dice.randrange(4))}
    return [None, True, dice.randrange(-50, 50), 1.5, any_text(dice)][kind]


def any_text(dice):
    return "".join(dice.choices(HARD, k=dice.randrange(12)))


def test_objects_of_any_shape(spark, tmp_path, split_bytes):
    """Nested values, escapes, any spacing and line breaks."""
    dice = random.Random(split_bytes)
    data = {}
    for k in range(12):
        name = f"f{k}.json"
        data[name] = {any_text(dice) + str(j): any_value(dice) for j in range(dice.choice([0, 1, 2, 30]))}
        layout = dice.choice([{}, {"indent": 2}, {"separators": (",", ":")}, {"ensure_ascii": False, "separators": (" ,\n", " : ")}])
        (tmp_path / name).write_text(dice.choice(["", "\n "]) + json.dumps(data[name], **layout) + dice.choice(["", "\n\n"]))
    rows = sorted((r.file, r.start, r.place, r.text, r.first, r.last) for r in read_records(spark, str(tmp_path), OBJECT_ENTRIES).collect())
    for name, value in data.items():
        mine = [r for r in rows if r[0].endswith("/" + name)]
        assert json.loads(",".join(r[3] for r in mine)) == value and len(mine) == max(len(value), 1)
        assert [r[4] for r in mine] == [True] + [False] * (len(mine) - 1) and [r[5] for r in mine] == [False] * (len(mine) - 1) + [True]


def test_keyed_json_equals_whole_files(spark, tmp_path, split_bytes):
    dice = random.Random(split_bytes + 1)
    for k in range(5):
        data = {f"{any_text(dice)}{j % 20}": {"t": any_text(dice), "n": {"a": dice.choice([None, [1, 2]])}} for j in range(40)}
        (tmp_path / f"f{k}.json").write_text(json.dumps(data, indent=dice.choice([None, 1])))
    read = lambda splittable: sorted(
        map(str, keyed_json.read_keyed_corpus(spark, str(tmp_path), "t string, n struct<a:array<int>>", splittable).collect())
    )
    assert read(True) == read(False)


def test_many_tasks_read_one_line(spark, tmp_path):
    data = {f"k{j}": {"t": "}, \"" * (j % 5)} for j in range(500)}
    (tmp_path / "f.json").write_text(json.dumps(data))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
    spark.conf.set("spark.sql.files.openCostInBytes", "1")
    try:
        rows = read_records(spark, str(tmp_path / "f.json"), OBJECT_ENTRIES).collect()
        assert len(rows) == 500 and len({r.start for r in rows}) > 10
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
        spark.conf.unset("spark.sql.files.openCostInBytes")


def test_unfinished_files_are_errors(spark, tmp_path):
    for text in ['{"a": {"b": 1}', '{"a": "b}', '{"a": 1}}']:
        (tmp_path / "f.json").write_text(text)
        with pytest.raises(ValueError, match="f.json"):
            read_records(spark, str(tmp_path), OBJECT_ENTRIES)


def test_quoted_lines(spark, tmp_path, split_bytes):
    """Against the standard library: quotes, separators and line breaks in fields, blank lines and \\r\\n."""
    dice = random.Random(split_bytes + 2)
    expected = []
    for k in range(6):
        out = io.StringIO()
        writer = csv.writer(out, lineterminator=dice.choice(["\n", "\r\n"]))
        writer.writerow(["id", "a b", "c"])
        for j in range(dice.choice([0, 1, 25])):
            row = [f"{k}-{j}", "".join(dice.choices('",\n é;x', k=dice.randrange(8))) + "y", "".join(dice.choices('"\n z', k=3)) + "."]
            writer.writerow(row)
            expected.append(tuple(row))
            if dice.random() < 0.1:
                out.write("\n")
        (tmp_path / f"f{k}.csv").write_text(out.getvalue(), newline="")
    found = tables.read_triplets(spark, str(tmp_path), na_values=())
    assert found.columns == ["id", "a b", "c"]
    assert sorted(tuple(r) for r in found.collect()) == sorted(expected)


def test_lines_without_quotes(spark, tmp_path, split_bytes):
    (tmp_path / "f.txt").write_text("one\n\ntwo\nthree")
    rows = sorted((r.start, r.place, r.text) for r in read_records(spark, str(tmp_path), QUOTED_LINES).collect())
    assert [r[2] for r in rows] == ["one", "", "two", "three"]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.text(alphabet='"\\{}[]a', max_size=12), max_size=6), st.booleans())
def test_transitions(texts, quoted):
    quotes, outside, inside = transitions(pa.array(texts, pa.string()), OBJECT_ENTRIES)
    for text, n, out, into in zip(texts, quotes, outside, inside):
        seen, deep, at = 0, {False: 0, True: 0}, 0
        while at < len(text):
            c = text[at]
            run = at - len(text[:at].rstrip("\\"))
            if c == '"' and run % 2 == 0:
                seen += 1
            elif c in "{}[]":
                deep[seen % 2 == 1] += 1 if c in "{[" else -1
            at += 1
        assert (n, out, into) == (seen, deep[False], deep[True])
