import json

import pytest
from pyspark.sql import functions as F

from podium.plans import report
from podium.sources import csv_tree, keyed_json, stages, tables


def write(path, text):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text(text)
    return str(path)


def test_read_triplets(spark, tmp_path):
    text = 'query,product_id,title,score_linear\nred shoe,1,"a ""big"", one",3\nhat,2,NA,\nbag,3,n/a,1.5\n'
    path = write(tmp_path / "t.csv", text)
    df = tables.read_triplets(spark, path, "score_linear double, product_id string")
    assert df.columns == ["query", "product_id", "title", "score_linear"]
    assert [tuple(r) for r in df.sort("product_id").collect()] == [
        ("red shoe", "1", 'a "big", one', 3.0), ("hat", "2", None, None), ("bag", "3", None, 1.5),
    ]
    with pytest.raises(ValueError, match="price"):
        tables.read_triplets(spark, path, "price double")


def test_quoted_line_breaks(spark, tmp_path):
    plain = write(tmp_path / "a.csv", 'id,t\n1,"x ""y"""\n2,z\n')
    broken = write(tmp_path / "b.csv", 'id,t\n1,"x\ny"\n2,z\n')
    assert not tables.has_multiline_fields(spark, plain) and tables.has_multiline_fields(spark, broken)
    assert [r.t for r in tables.read_csv_text(spark, broken).sort("id").collect()] == ["x\ny", "z"]
    assert [r.t for r in tables.read_csv_text(spark, plain).sort("id").collect()] == ['x "y"', "z"]


def test_bad_number_is_an_error(spark, tmp_path, fails):
    assert "CAST_INVALID_INPUT" in fails(tables.read_triplets(spark, write(tmp_path / "t.csv", "q,w\na,heavy\n"), "w double"))


def test_unique_ids(spark, tmp_path):
    path = str(tmp_path / "d")
    spark.createDataFrame([("a",), ("b",), ("a",)], "doc_id string").write.parquet(path)
    assert tables.read_columnar(spark, path).count() == 3
    with pytest.raises(ValueError, match="'a' occurs 2 times"):
        tables.read_columnar(spark, path, unique="doc_id")


def test_vector_size(spark, tmp_path, fails):
    path = str(tmp_path / "v")
    tables.write_vectors(spark.createDataFrame([("a", [1.0, 2.0]), ("b", [1.0])], "id string, embedding array<double>"), path)
    assert "expected 2 numbers, found 1" in fails(tables.read_vectors(spark, path, 2))


CORPUS = {
    "d1": {"title": 'says "hi" \\ there', "image_local": "/a/1.jpg"},
    "d é": {"title": None, "image_local": "/a/2.jpg"},
    "d3": {"title": "plain", "image_local": "/a/3.jpg"},
}


def corpus_rows(df):
    return {r.doc_id: {"title": r.title, "image_local": r.image_local} for r in df.collect()}


@pytest.mark.parametrize("splittable", [False, True])
def test_keyed_corpus(spark, tmp_path, splittable):
    path = write(tmp_path / "c.json", json.dumps(CORPUS))
    assert corpus_rows(keyed_json.read_keyed_corpus(spark, path, ["title", "image_local"], splittable)) == CORPUS


@pytest.mark.parametrize("splittable", [False, True])
@pytest.mark.parametrize("title", ['ends in }, "d9": {"title": "x"', 'brace }, "', "{}}", 'a {"b"'])
def test_entry_break_inside_a_text(spark, tmp_path, splittable, title):
    corpus = {**CORPUS, "d4": {"title": title, "image_local": "/a/4.jpg"}, "d5": {"title": "last", "image_local": ""}}
    path = write(tmp_path / "c.json", json.dumps(corpus))
    assert corpus_rows(keyed_json.read_keyed_corpus(spark, path, ["title", "image_local"], splittable)) == corpus


@pytest.mark.parametrize("splittable", [False, True])
def test_other_spacing(spark, tmp_path, splittable):
    path = write(tmp_path / "c.json", json.dumps(CORPUS, indent=1))
    assert corpus_rows(keyed_json.read_keyed_corpus(spark, path, ["title", "image_local"], splittable)) == CORPUS


@pytest.mark.parametrize("splittable", [False, True])
def test_last_of_repeated_keys_counts(spark, tmp_path, splittable):
    path = write(tmp_path / "c.json", '{"a": {"t": "1"}, "b": {"t": "2"}, "a": {"t": "3"}}')
    rows = keyed_json.read_keyed_corpus(spark, path, ["t"], splittable).collect()
    assert sorted((r.doc_id, r.t) for r in rows) == [("a", "3"), ("b", "2")]


def test_many_splits_of_one_file(spark, tmp_path):
    corpus = {f"d{i}": {"title": f"text number {i}"} for i in range(5000)}
    path = write(tmp_path / "c.json", json.dumps(corpus))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        df = keyed_json.read_keyed_corpus(spark, path, ["title"], splittable=True)
        assert {r.doc_id: {"title": r.title} for r in df.collect()} == corpus
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_corpus_is_written_as_whole_objects(spark, tmp_path):
    df = spark.createDataFrame([(k, *v.values()) for k, v in CORPUS.items()], "doc_id string, title string, image_local string")
    keyed_json.write_corpus_json(df.repartition(2), str(tmp_path / "out"))
    merged = {}
    for part in (tmp_path / "out").glob("part-*"):
        merged.update(json.loads(part.read_text()))
    assert merged == CORPUS


def test_run_and_judgments(spark, tmp_path):
    run = {"q1": {"b": 0.5, "a": 0.9, "c": 0.5}, "q2": {"x": 1.0}}
    got = keyed_json.read_run_json(spark, write(tmp_path / "r.json", json.dumps(run))).sort("query_id", "rank").collect()
    assert [tuple(r) for r in got] == [("q1", "a", 0.9, 1), ("q1", "b", 0.5, 2), ("q1", "c", 0.5, 3), ("q2", "x", 1.0, 1)]
    qrels = {"q1": {"a": 3, "b": 0}, "q2": {"x": 1}}
    got = keyed_json.read_qrels_json(spark, write(tmp_path / "g.json", json.dumps(qrels)), splittable=True)
    assert sorted(tuple(r) for r in got.collect()) == [("q1", "a", 3), ("q1", "b", 0), ("q2", "x", 1)]


def test_rewrite_csv_tree(spark, tmp_path):
    root, new_root = tmp_path / "in", tmp_path / "out"
    write(root / "a" / "one.csv", "id,image_local\n1,/x/1.jpg\n2,/x/y/2.jpg\n")
    write(root / "a" / "b" / "two+x.csv", 'image_local,note\n/z/3.jpg,"two\nlines"\n')
    write(root / "three.csv", "id,other\n1,2\n")
    write(root / "empty.csv", "")
    write(root / "ignored.txt", "image_local\n/x/9.jpg\n")
    counts = csv_tree.rewrite_csv_tree(spark, str(root), str(new_root), "/img//")
    assert tuple(counts.first()) == (4, 2)
    written = {p.parent.name: p.read_text() for p in new_root.rglob("part-*")}
    assert written["source_file=a%2Fone.csv"] == '"id","image_local"\n"1","/img/1.jpg"\n"2","/img/2.jpg"\n'
    assert '"/img/3.jpg","two\nlines"' in next(t for name, t in written.items() if "two" in name)
    assert len(written) == 2


def test_tree_of_many_layouts(spark, tmp_path):
    """One pass for all: quotes, missing and surplus fields, Windows line ends; a file that ends inside quotes is left out."""
    for k in range(8):
        names = [f"c{j}" for j in range(k)] + ["image_local"]
        row = ['"a ""b"", c"'] * k + ["/x/y.jpg"]
        write(tmp_path / "in" / f"f{k}.csv", ",".join(names) + "\r\n" + ",".join(row) + "\r\n" + ",".join(row) + ",more\r\n,\r\n")
    write(tmp_path / "in" / "bad.csv", 'image_local\n"/x/y.jpg\n')
    counts = csv_tree.rewrite_csv_tree(spark, str(tmp_path / "in"), str(tmp_path / "out"), "/img")
    assert tuple(counts.first()) == (9, 8)
    written = {p.parent.name: p.read_text() for p in (tmp_path / "out").rglob("part-*")}
    for k in range(8):
        line = ",".join(['"a ""b"", c"'] * k + ['"/img/y.jpg"']) + "\n"
        header = ",".join([f'"c{j}"' for j in range(k)] + ['"image_local"']) + "\n"
        empty = ",".join(['""'] * (k + 1)) + "\n"
        assert written[f"source_file=f{k}.csv"] == header + line * 2 + empty


def test_rewrite_corpus_paths(spark, tmp_path):
    path = write(tmp_path / "c.json", json.dumps(CORPUS))
    csv_tree.rewrite_corpus_paths(spark, path, str(tmp_path / "new"), "/img", ["title", "image_local"])
    got = corpus_rows(keyed_json.read_keyed_corpus(spark, str(tmp_path / "new"), ["title", "image_local"]))
    assert got == {k: {**v, "image_local": v["image_local"].replace("/a/", "/img/")} for k, v in CORPUS.items()}


def test_images(spark, tmp_path):
    (tmp_path / "img").mkdir()
    (tmp_path / "img" / "1.jpg").write_bytes(b"\x01\x02")
    files = tables.read_binary_images(spark, str(tmp_path / "img"), "*.jpg")
    rows = [("a", f"{tmp_path}/img/1.jpg", None), ("b", "none", (bytearray(b"\x09"), "x")), ("c", "none", None)]
    df = spark.createDataFrame(rows, "id string, image_local string, image struct<bytes: binary, path: string>")
    got = {r.id: r.image_bytes for r in tables.attach_images(df, files, "image_local", "image").collect()}
    assert got == {"a": bytearray(b"\x01\x02"), "b": bytearray(b"\x09"), "c": None}


def test_images_of_two_stores(spark):
    """Equal paths in two buckets are two files; a record stays one row."""
    files = spark.createDataFrame(
        [("s3a://one/a/1.jpg", bytearray(b"1")), ("s3a://two/a/1.jpg", bytearray(b"2")), ("file:/b/2.jpg", bytearray(b"3")), ("file:/b/2.jpg", bytearray(b"3"))],
        "path string, content binary",
    )
    rows = [("a", "s3a://two/a/1.jpg"), ("b", "/a/1.jpg"), ("c", "file:///b/2.jpg"), ("d", "/b/2.jpg"), ("e", "s3a://three/a/1.jpg"), ("f", None)]
    df = spark.createDataFrame(rows, "id string, image_local string")
    got = [(r.id, r.image_bytes) for r in tables.attach_images(df, files).collect()]
    assert sorted(got) == [("a", b"2"), ("b", b"1"), ("c", b"3"), ("d", b"3"), ("e", None), ("f", None)]


def test_cached_stage(spark, tmp_path):
    source, root = tmp_path / "src", str(tmp_path / "stages")
    write(source / "a.txt", "one")
    before = stages.files_fingerprint(spark, str(source))
    assert before == stages.files_fingerprint(spark, str(source))
    calls = []

    def build():
        calls.append(1)
        return spark.range(len(calls))

    key = stages.fingerprint(before, {"k": 1})
    assert stages.cached_stage(spark, root, build, key).count() == 1
    assert stages.cached_stage(spark, root, build, key).count() == 1 and len(calls) == 1
    assert stages.cached_stage(spark, root, build, key, overwrite=True).count() == 2
    write(source / "b.txt", "two")
    assert stages.files_fingerprint(spark, str(source)) != before
    assert stages.cached_stage(spark, root, build, stages.fingerprint(before, {"k": 2})).count() == 3


def test_experiments_and_leaderboard(spark, tmp_path, fails):
    for name, value in (("first", 0.2), ("second", 0.3)):
        content = {"mAP": {"MAP@1": value, "MAP@10": 0.5}, "summary": {"MAP@1": [9.0], "mrr@10": [0.4], "mERR": value / 2}}
        write(tmp_path / name / "output.json", json.dumps(content))
    metrics, summaries = report.read_experiments(spark, [str(tmp_path / "first"), str(tmp_path / "second")])
    merged = report.merge_metrics(metrics, summaries)
    board = report.leaderboard(merged, ("MAP@1", "mERR", "mrr@10"))
    # A metric wins over a summary value of the same name.
    assert [tuple(r) for r in board.sort("experiment").collect()] == [("first", 0.2, 0.1, 0.4), ("second", 0.3, 0.15, 0.4)]
    gain = report.relative_gain(board, "first").sort("experiment").collect()
    assert gain[1]["MAP@1"] == pytest.approx(0.5) and gain[0]["mERR"] == 0
    assert "no P@10 for experiment" in fails(report.leaderboard(merged, ("MAP@1", "P@10")))


def test_split_files(spark, tmp_path):
    for q in (0, 1):
        for d in (0, 1):
            name = f"query_{q}_product_id_{d}"
            write(tmp_path / f"{name}.csv", f"query,product_id,score_linear\nq{q},d{d},{q + d + 1}\n")
            write(tmp_path / f"{name}_gt_dev.json", json.dumps({f"q{q}": {f"d{d}": 1}}))
            write(tmp_path / f"{name}_gt_test.json", json.dumps({f"q{q}": {f"d{d}": 2}}))
    for d in (0, 1):
        write(tmp_path / f"corpus_{d + 1}.json", json.dumps({f"d{d}": {"title": f"t{d}"}}))
    triplets, corpus = tables.load_all_splits(spark, str(tmp_path), "score_linear double", ["title"])
    assert sorted((r.query, r.product_id, r.q_split, r.d_split) for r in triplets.collect()) == [
        (f"q{q}", f"d{d}", q, d) for q in (0, 1) for d in (0, 1)
    ]
    assert sorted((r.doc_id, r.title, r.d_split) for r in corpus.collect()) == [("d0", "t0", 0), ("d1", "t1", 1)]
    _, _, judged = tables.load_split(spark, str(tmp_path), 1, 0, None, ["title"], with_judgments=True)
    assert sorted((r.query_id, r.doc_id, r.rel, r.part) for r in judged.select(F.col("*")).collect()) == [
        ("q1", "d0", 1, "dev"), ("q1", "d0", 2, "test"),
    ]
