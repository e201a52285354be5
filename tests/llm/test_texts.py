"""Language, licences, mixing and decontamination."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from podium.llm import decontaminate, features, langid, licenses, mixing
from podium.llm.queries import QUERIES, TARGETS


def test_language_accuracy(spark, sf_dir):
    sf_dir = sf_dir.replace("sf0.001", "sf0.01")  # 200 documents are too few to learn four languages well
    found = QUERIES["op7_language_id"](spark, sf_dir)
    known = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang")
    rows = found.join(known, "doc_id").collect()
    assert len(rows) == known.count()
    held = [r for r in rows if r.held_out]
    assert len(held) > 20 and sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert all(0 <= r.score <= 1 for r in rows)


@pytest.fixture(scope="module")
def model(spark, sf_dir):
    return langid.train(langid.learning_rows(spark.read.parquet(f"{sf_dir}/documents.parquet")))


def test_language_of_odd_rows(odd_documents, odd_rows, no_documents, model):
    found = langid.identified(odd_documents, model)
    got = found.select("row.*", "lang_pred", "score", "rejected").collect()
    assert len(got) == len(odd_rows)
    for r in got:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == (not letters) and (letters or (r.score == 0 and r.rejected))
    assert langid.identify(no_documents, model).collect() == []


def test_language_does_not_depend_on_batches(spark, model):
    texts = [("the quick " * k + "brown fox was with them") for k in range(1, 30)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    one, many = (sorted(map(tuple, langid.identify(rows.repartition(n), model).collect())) for n in (1, 7))
    assert [(a[0], a[1], round(a[2], 9)) for a in one] == [(a[0], a[1], round(a[2], 9)) for a in many]


def test_labels_of_held_out_rows_are_not_used(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert langid.learning_rows(rows).where(langid.held_out(rows["doc_id"])).isEmpty()


def licence_rows(spark):
    notice = "Licensed under the Apache License, Version 2.0."
    grant, condition = licenses.SENTENCES["mit-grant"][0], licenses.SENTENCES["mit-condition"][0]
    warranty = licenses.SENTENCES["mit-warranty"][0]
    rows = [
        (1, f"prose before\n{notice}\nprose after"), (2, "# licensed UNDER the apache   license, version 2.0!"), (3, "Licensed under the Apache License, Version 3.0."),
        (4, f"{grant}\nunknown sentence in between.\n{condition} {warranty}"), (5, f"{condition}\n{grant}"), (6, None), (7, ""),
        (8, "x " * 50_000 + "\nAll rights reserved."), (9, "Released under the MIT License. Released under the MIT License."),
        (None, "Licensed under CC BY-NC 4.0."), (10, "We all like licences."),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_licenses(spark, odd_documents, odd_rows, no_documents):
    found = {r.doc_id: r for r in licenses.scan(licence_rows(spark)).collect()}
    assert {i: r.licenses for i, r in found.items()} == {
        1: ["Apache-2.0"], 2: ["Apache-2.0"], 3: [], 4: ["MIT"], 5: [], 6: [], 7: [], 8: ["proprietary"], 9: ["MIT"], None: ["CC-BY-NC-4.0"], 10: [],
    }
    assert found[4].rules == ["mit-text"] and found[5].sentence_ids == ["mit-condition", "mit-grant"]
    assert found[9].sentence_ids == ["mit-notice"] * 2 and found[6].n_sentences == 0 and found[1].n_sentences == 3
    plan = licenses.scan(licence_rows(spark))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Exchange" not in plan
    assert licenses.scan(odd_documents).count() == len(odd_rows) and licenses.scan(no_documents).collect() == []


MIT = '''Copyright (c) 2020 Someone

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE.'''
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""


def test_wrapped_licences(spark):
    whole = {"mit-text": MIT, "bsd-text": BSD, "apache-header": APACHE, "gpl3-header": GPL}
    ways = [lambda t: t, lambda t: t.replace("\n", "\r\n"), lambda t: "\n\n".join(" ".join(p.split()) for p in t.split("\n\n")), lambda t: "\n".join(t.split())]
    ways += [lambda t, m=m: f"code();\n/*\n{m}" + t.replace("\n", "\n" + m) + "\n*/\nmore();" for m in ("# ", "// ", " * ", "    ", "dnl ", "REM ", "-- ", ";; ")]
    rows = [(k, way(text), rule) for rule, text in whole.items() for k, way in enumerate(ways)]
    rows += [(90, GPL.replace("version 3", "version 2"), None), (91, MIT.replace("free of charge", "for a charge"), None)]
    found = licenses.scan(spark.createDataFrame([(i, t) for i, (_, t, _) in enumerate(rows)], "doc_id long, text string")).collect()
    assert {r.doc_id: r.rules for r in found} == {i: [rule] if rule else [] for i, (_, _, rule) in enumerate(rows)}


def test_licences_that_are_alike_are_told_apart(spark):
    endorse = licenses.SENTENCES["bsd-endorse"][0]
    free, warranty = licenses.SENTENCES["gpl-free"][0], licenses.SENTENCES["gpl-warranty"][0]
    cases = [
        (f"Copyright 2020. All rights reserved.\n{BSD}", ["BSD-2-Clause"]), (f"All rights reserved.\n{BSD}\n3. {endorse}", ["BSD-3-Clause"]),
        (f"All rights reserved.\n{BSD}\n{endorse}", ["BSD-3-Clause"]), ("All rights reserved.", ["proprietary"]), (f"{free} {warranty}", ["GPL"]),
        ("x. The code is released under the MIT License. y", ["MIT"]), ("# MIT License\n\n" + MIT, ["MIT"]), ("MIT License", ["MIT"]),
        ("// SPDX-License-Identifier: Apache-2.0\ncode", ["Apache-2.0"]), ("/* SPDX-License-Identifier: GPL-2.0-only */", ["GPL-2.0-only"]),
        (licenses.SENTENCES["mpl-notice"][0], ["MPL-2.0"]), ("\n".join(licenses.SENTENCES["lgpl21-free"][0].split("; ")), ["LGPL-2.1"]),
        (licenses.SENTENCES["isc-grant"][0], ["ISC"]),
    ]
    rows = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string")
    assert [r.licenses for r in licenses.scan(rows).orderBy("doc_id").collect()] == [want for _, want in cases]


def test_an_ambiguous_sentence_is_an_error(spark):
    with pytest.raises(ValueError, match="two identifiers"):
        licenses.known_sentences(spark, {"a": ["Same text."], "b": ["same  TEXT"]})


def test_language_rejects_what_is_no_language(spark, sf_dir):
    documents = spark.read.parquet(sf_dir.replace("sf0.001", "sf0.01") + "/documents.parquet")
    model = langid.train(langid.learning_rows(documents))
    strange = ["xqz vvkw jjq zzx", "これは日本語のテキストです", "Это русский текст о погоде", "aaaa", "这是中文", "zxcv qwrt plkj mnbv hgfd", "12 34", None]
    known = ["Und der das nicht mit", "le la les et des que", "the and of to in that"]
    rows = spark.createDataFrame(list(enumerate(strange + known)), "doc_id long, text string")
    found = [r.rejected for r in langid.identify(rows, model).orderBy("doc_id").collect()]
    assert found == [True] * len(strange) + [False] * len(known)
    assert langid.identify(documents, model).where("rejected").isEmpty()


def test_language_equals_plain_prediction(spark, sf_dir, model):
    """Each subword by itself, without any of the operator's array code."""
    rows = spark.read.parquet(f"{sf_dir}/documents.parquet").orderBy(F.length("text")).limit(40).select("doc_id", "text").collect()
    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame(rows), model).collect()}
    bits = len(model.table).bit_length() - 1
    for doc_id, text in rows:
        kept = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in (" " + text.lower()).encode())
        kept = b" ".join(p for p in kept.split(b" ") if p)
        kept = (b" " + kept + (b" " if not (text[-1].isalpha() or ord(text[-1]) > 127) else b"")) if kept else b" "
        total, number = np.zeros(len(model.bias)), 0
        for size in (2, 3, 4):
            for at in range(len(kept) - size + 1):
                value = 0
                for c in kept[at : at + size]:
                    value = (value * 257 + c) % 2**32
                bucket = ((value * 2654435769 + size * 40503) * 2246822519) % 2**32 >> (32 - bits)
                total, number = total + model.table[bucket], number + 1
        z = (total / max(number, 1) + model.bias) / model.temperature
        chances = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
        best = int(chances[:-1].argmax())
        assert got[doc_id].lang_pred == model.languages[best] and abs(got[doc_id].score - chances[best]) < 1e-4


def test_language_without_labels(spark, odd_documents, no_documents):
    none = langid.train(no_documents.select("doc_id", "lang", "text"))
    rows = langid.identify(odd_documents, none).collect()
    assert len(rows) == odd_documents.count() and {(r.lang_pred, r.score, r.rejected) for r in rows} == {("und", 0.0, True)}
    unlabelled = langid.train(odd_documents.selectExpr("doc_id", "cast(null as string) as lang", "text"))
    assert unlabelled.languages == [] and langid.identified(no_documents, unlabelled).collect() == []


def test_mixing_reaches_targets(spark, sf_dir):
    rows = QUERIES["op3_source_mixing"](spark, sf_dir).collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    assert np.allclose(p.sum(axis=1), 1) and (r >= 0).all() and len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    usual, reached = (p * t[:, None]).sum(axis=0) / t.sum(), (p * (r * t)[:, None]).sum(axis=0) / t.sum()
    goal = np.array([TARGETS[d] for d in ("good", "poor", "toxic")])
    assert np.abs(reached - goal).max() < np.abs(usual - goal).max() / 2
    assert all(abs(x.copies - x.rate) < 1 for x in rows)


def reached_shares(rows, steps):
    some = rows.withColumn("r", mixing.rate_of(rows.posterior, steps)).collect()
    p, t, r = np.array([x.posterior for x in some]), np.array([x.n_tokens for x in some]), np.array([x.r for x in some])
    assert (r >= 0).all()
    return (p * (r * t)[:, None]).sum(axis=0) / t.sum()


@pytest.mark.parametrize("domains, goal", [(3, [0.4, 0.3, 0.3]), (3, [0.6, 0.1, 0.3]), (10, [0.19] + [0.09] * 9)])
def test_rates_of_soft_posteriors_meet_the_tolerance(spark, domains, goal):
    rng = np.random.default_rng(5)
    p, t = rng.dirichlet(9 * np.array(([5, 3, 2] if domains == 3 else [1] * 10)) / 10, 400), rng.integers(0, 500, 400)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, posterior array<double>").coalesce(2).cache()
    steps = mixing.fit_rates(rows, goal)
    assert np.abs(reached_shares(rows, steps) - goal).max() <= 1e-3


def test_targets_that_cannot_be_met_are_reported(spark):
    rows = spark.createDataFrame([(10, [0.5, 0.5]), (20, [0.6, 0.4])], "n_tokens long, posterior array<double>").coalesce(1)
    with pytest.warns(UserWarning, match="no rates"):
        finished = mixing.fit_rates(rows, [1.0, 0.0])
    # the least of the weighted squares: all from the second row
    usual, (a, b) = np.array([17 / 30, 13 / 30]), (0.6, 0.4)
    scale = a / usual[0] / (a * a / usual[0] + b * b / usual[1])
    assert np.allclose(reached_shares(rows, finished), [a * scale, b * scale], atol=2e-3)


def test_registered_mixing_meets_the_tolerance(spark, sf_dir):
    rows = QUERIES["op3_source_mixing"](spark, sf_dir).collect()
    p, t, r = np.array([x.posterior for x in rows]), np.array([x.n_tokens for x in rows]), np.array([x.rate for x in rows])
    goal = np.array([TARGETS[d] for d in ("good", "poor", "toxic")])
    assert np.abs((p * (r * t)[:, None]).sum(axis=0) / t.sum() - goal).max() <= mixing.MixConfig().tolerance


def test_rates_equal_descent_on_one_machine(spark):
    rng = np.random.default_rng(3)
    p = rng.dirichlet([0.3, 0.5, 0.2], 200)
    t = rng.integers(0, 500, 200)
    rows = spark.createDataFrame([(int(n), x.tolist()) for n, x in zip(t, p)], "n_tokens long, posterior array<double>").repartition(5)
    goal, config = np.array([0.5, 0.4, 0.1]), mixing.MixConfig(steps=25, stored=7, tolerance=1e-9)
    steps = mixing.fit_rates(rows, goal.tolist(), config)
    got = {tuple(r.posterior): r.r for r in rows.withColumn("r", mixing.rate_of(rows.posterior, steps)).collect()}
    usual = (p * t[:, None]).sum(axis=0) / t.sum()
    gram = (p * t[:, None]).T @ p / t.sum()
    pace = 1 / np.linalg.eigvalsh(gram / np.sqrt(usual)[:, None] / np.sqrt(usual)).max()
    rate, shares = np.ones(200), usual
    for i in range(len(steps)):
        moved = np.maximum(0, rate - p @ (pace * (shares - goal) / usual))
        after = (p * (moved * t)[:, None]).sum(axis=0) / t.sum()
        slope, length = (after - shares) / usual, (t * (moved - rate) ** 2).sum() / t.sum()
        pace = slope @ gram @ slope and (length / ((after - shares) @ slope) if i % 2 == 0 else (after - shares) @ slope / (slope @ gram @ slope))
        rate, shares = moved, after
    assert max(abs(got[tuple(x)] - r) for x, r in zip(p.tolist(), rate)) < 1e-9
    assert np.abs((p * (rate * t)[:, None]).sum(axis=0) / t.sum() - goal).max() < 0.01


def test_mixing_of_odd_rows(spark, odd_documents, odd_rows, no_documents):
    known = spark.createDataFrame([(1, "good"), (12, "poor"), (13, "toxic"), (99, "good"), (None, "good"), (2, None)], "doc_id long, domain string")
    rows = mixing.mix_sources(odd_documents, known, {"good": 1.0}).collect()
    assert len(rows) == len(odd_rows) and all(len(r.posterior) == 3 and r.rate >= 0 for r in rows)
    assert all(r.n_tokens == 0 for r in rows if not (r.row.text or "").strip(" \t\n\r\x0b\x0c"))
    assert mixing.mix_sources(no_documents, known, {"good": 1.0}).collect() == []
    rows = mixing.mix_sources(odd_documents, known.where("false"), {"good": 1.0}).collect()
    assert len(rows) == len(odd_rows) and all((r.posterior, r.rate, r.copies) == ([], 1.0, 1) for r in rows)
    rows = mixing.mix_sources(odd_documents, known, {"unknown": 1.0}).collect()
    assert all(r.rate == 1.0 for r in rows)


@pytest.fixture(scope="module")
def leak_case(spark, words):
    """Documents with benchmark passages as they are, cut short, in other words, or not at all."""
    dice = random.Random(8)
    items = [(i, " ".join(dice.choices(words, k=dice.randint(12, 60)))) for i in range(30)] + [(50, " ".join(dice.choices(words, k=300))), (51, "too short"), (52, None)]
    prose = lambda n: dice.choices(words, k=n)
    docs, want = [], set()
    for i, text in items[:31]:
        cut = text.split()
        docs.append((2 * i, " ".join(prose(dice.randint(0, 300)) + cut + prose(dice.randint(0, 300)))))
        want.add((2 * i, i))
        changed = [w if k % 6 else dice.choice(words) for k, w in enumerate(cut)]
        docs.append((1000 + i, " ".join(prose(90) + changed + prose(90)).upper().replace(" ", ", ")))
        want.add((1000 + i, i))
        docs.append((2000 + i, " ".join(prose(50) + cut[: len(cut) // 4] + prose(200))))
        docs.append((3000 + i, " ".join(prose(dice.randint(1, 400)))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    return frame, spark.createDataFrame(items, "item_id long, text string"), want


def leaks(frame, benchmark, **changes):
    found = decontaminate.screened(frame, benchmark, decontaminate.LeakConfig(**changes))
    return {(r.row.doc_id, x.item_id) for r in found.collect() for x in r.leaks}


@pytest.mark.parametrize("changes", [{}, {"passes": 2}, {"probes_at_once": 7}])
def test_leaks(leak_case, changes):
    frame, benchmark, want = leak_case
    assert leaks(frame, benchmark, **changes) == want


@pytest.mark.parametrize("around", ["its words before", "twice before", "few words", "corrupted copy"])
def test_leaks_among_repeated_words(spark, words, around):
    """Passages whose words also stand shortly before them, or among few very frequent words."""
    dice = random.Random(9)
    items = [(i, " ".join(dice.choices(words, k=dice.randint(8, 90)))) for i in range(25)]
    few, docs = words[:12], []
    for i, text in items:
        own = text.split()
        mixed = dice.sample(own, len(own))
        before = {
            "its words before": mixed + dice.choices(words, k=45), "twice before": mixed + dice.choices(words, k=60) + mixed + dice.choices(words, k=30),
            "few words": dice.choices(few, k=300), "corrupted copy": [w for w in own if dice.random() < 0.4] + dice.choices(words, k=20),
        }[around]
        docs.append((i, " ".join(before + own + dice.choices(few if around == "few words" else words, k=100))))
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    benchmark = spark.createDataFrame(items, "item_id long, text string")
    assert leaks(frame, benchmark) == {(i, i) for i, _ in items}
    assert leaks(frame, benchmark, cosine=2.0) == {(i, i) for i, _ in items}  # word by word, whatever the cosine


def test_a_window_counts_each_word_once():
    rng = np.random.default_rng(4)
    config = decontaminate.LeakConfig(bucket_bits=8, rank=5)
    weight, basis = np.ones(256, np.float32), rng.normal(size=(256, 5)).astype(np.float32)
    probes = decontaminate.Probes([(1, "a passage of the benchmark")], weight, basis, config)
    counts, hashes = decontaminate.content_words(pa.array([" ".join(f"w{k}" for k in rng.integers(0, 15, n)) for n in (70, 3, 0, 41)]))
    starts, stops, text = probes._windows(counts, 6)
    vectors, ends = probes._vectors(hashes, starts, stops, 18), np.cumsum(counts)
    assert starts.tolist() == [at for end, n in zip(ends, counts) for at in range(end - n, end, 6)]
    want = [probes._sum(hashes[at : min(at + 18, ends[k])].tolist()) for at, k in zip(starts, text)]
    assert np.allclose(vectors, want, atol=1e-4)


@pytest.mark.parametrize("groups", [1, 3, 64])
def test_skipped_windows_hold_no_passage(words, groups):
    """Every window with ``share`` of a passage, in order, is among those that are projected."""
    dice, rng = random.Random(groups), np.random.default_rng(groups)
    config = decontaminate.LeakConfig(bucket_bits=8, rank=4, groups=groups)
    weight, basis = rng.random(256).astype(np.float32), rng.normal(size=(256, 4)).astype(np.float32)
    items = [(i, " ".join(dice.choices(words[:80], k=dice.randint(5, 30)))) for i in range(40)]
    probes = decontaminate.Probes(items, weight, basis, config)
    texts = []
    for _, text in items:
        kept = [w for w in text.split() if dice.random() < 0.7]
        texts.append(" ".join(dice.choices(words, k=dice.randint(0, 40)) + kept + dice.choices(words, k=dice.randint(0, 40))))
    counts, hashes = decontaminate.content_words(pa.array([*texts, "", None]))
    held = 0
    for length, some in probes.by_length.items():
        starts, stops, text = probes._windows(counts, length // 2)
        hopeful = set(probes._hopeful(length, hashes, text, starts).tolist())
        for w, (start, stop) in enumerate(zip(starts, stops)):
            seen = hashes[start:stop].tolist()
            best = max(decontaminate.longest_common(probes.masks[i][0], len(probes.parts[i][1]), seen) / len(probes.parts[i][1]) for i in some)
            held += best >= config.share
            assert best < config.share or w in hopeful
    assert held >= 20


def test_words_do_not_depend_on_pieces(words):
    dice = random.Random(2)
    texts = [" ".join(dice.choices([*words, "Ünïcode", "ß,x;y", "--"], k=dice.choice([0, 1, 30, 400]))) for _ in range(200)]
    texts = [None, "", *texts, "A long, long text. " * 20_000, None, "end", ""]
    counts, hashes = features.content_words(pa.array(["first", *texts], pa.string()).slice(1))
    one = [features.content_words(pa.array([t], pa.string())) for t in texts]
    assert counts.tolist() == [int(c[0]) for c, _ in one] and counts.sum() == len(hashes)
    assert (hashes == np.concatenate([h for _, h in one])).all()
    none = features.content_words(pa.array([], pa.string()))
    assert [len(x) for x in none] == [0, 0] and none[1].dtype == np.uint64


def test_words_are_cut_in_small_pieces(words):
    """What is made per byte on the way is a multiple of a piece, not of all texts; made anew for all of them it costs twice the time."""
    texts = pa.array([" ".join(words[k % 50 :][:60]) for k in range(6000)])
    features.content_words(texts.slice(0, 500))
    tracemalloc.start()
    features.content_words(texts)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 6 * texts.nbytes


def test_last_places():
    rng = np.random.default_rng(3)
    for size, groups, n in [(0, 1, 4), (1, 1, 4), (500, 3, 8), (4000, 200, 16), (50, 5000, 8)]:
        group, number = np.sort(rng.integers(0, groups, size)), rng.integers(0, n, size)
        last = {pair: k for k, pair in enumerate(zip(group.tolist(), number.tolist()))}
        assert np.flatnonzero(features.last_places(group, number, n)).tolist() == sorted(last.values())


def test_product_of_passages_touches_only_their_words(words, monkeypatch):
    dice, rng = random.Random(4), np.random.default_rng(4)
    config = decontaminate.LeakConfig(rank=6, passage=20)
    texts = [" ".join(dice.choices(words, k=dice.choice([0, 5, 20, 21, 130]))) for _ in range(150)]
    table, rows = rng.normal(size=(1 << 13, 6)).astype(np.float32), []
    for text in texts:
        _, hashes = features.content_words(pa.array([text]))
        buckets = decontaminate._buckets(hashes, 13)
        for k in range(0, len(buckets), 20):
            rows.append(np.zeros(1 << 13))
            rows[-1][buckets[k : k + 20]] = 1
    batches = [pa.RecordBatch.from_pydict({"text": pa.array(some, pa.string())}) for some in (texts[:70], [None, ""], texts[70:])]
    for held in (2048, 50):
        monkeypatch.setattr(decontaminate, "_PASSAGES", held)
        assert np.allclose(decontaminate._product(batches, table, config), np.array(rows).T @ (np.array(rows) @ table), atol=1e-3)
    tracemalloc.start()
    decontaminate._product(batches, table, config)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 8_000_000  # a whole row of buckets for each of 512 passages would be 16 MB
    assert not decontaminate._product([], table, config).any()


def test_paraphrases_are_found_as_by_comparing_every_window(leak_case):
    frame, benchmark, want = leak_case
    every = leaks(frame, benchmark, cosine=-1.0)
    assert want <= every and len(leaks(frame, benchmark) & every) >= 0.9 * len(every)


def test_short_passages_are_found_word_by_word(spark):
    docs = [(1, "Well, that is Forty-Two indeed"), (2, "forty two"), (3, "two forty forty"), (4, "and forty"), (5, "two"), (6, None)]
    items = [(7, "forty two"), (8, "Forty, two!"), (9, "indeed"), (10, "a b c d"), (11, "!")]
    found = decontaminate.screened(
        spark.createDataFrame(docs, "doc_id long, text string").coalesce(1), spark.createDataFrame(items, "item_id long, text string")
    )
    got = {(r.row.doc_id, x.item_id, x.share, x.at) for r in found.collect() for x in r.leaks}
    assert got == {(1, 7, 1.0, 3), (1, 8, 1.0, 3), (1, 9, 1.0, 5), (2, 7, 1.0, 0), (2, 8, 1.0, 0)}


def test_every_exact_passage_is_found(spark, sf_dir):
    plain = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    docs = [(r.doc_id, f" {plain(r.text)} ") for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    items = [(r.item_id, f" {plain(r.text)} ") for r in spark.read.parquet(f"{sf_dir}/benchmark.parquet").collect()]
    want = {(d, i) for d, t in docs for i, p in items if p.strip() and p in t}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op10_decontaminate"](spark, sf_dir).collect()}
    assert want and got == want


def test_leaks_of_odd_rows(spark, odd_documents, odd_rows, no_documents):
    benchmark = spark.createDataFrame([(1, odd_rows[12][1]), (None, odd_rows[0][1]), (3, None), (4, "")], "item_id long, text string")
    found = decontaminate.screened(odd_documents, benchmark).select("row.*", "leaks").drop("leaks")
    assert decontaminate.screened(odd_documents, benchmark).count() == len(odd_rows) and found.columns
    assert leaks(odd_documents, benchmark) == {(13, 1)}
    assert leaks(no_documents, benchmark) == set() and leaks(odd_documents, benchmark.where("false")) == set()


def test_longest_common_sequence():
    dice = random.Random(5)
    for _ in range(200):
        a, b = ([dice.randint(0, 5) for _ in range(dice.randint(1, 20))] for _ in range(2))
        table = np.zeros((len(a) + 1, len(b) + 1), int)
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1, j + 1] = table[i, j] + 1 if x == y else max(table[i, j + 1], table[i + 1, j])
        assert decontaminate.longest_common(decontaminate._masks(a), len(a), b) == table[-1, -1]


def test_repeated_notices_take_linear_time(spark):
    """A rule that never completes, begun thousands of times."""
    import time

    notice = "Licensed under the Apache License, Version 2.0.\nyou may not use this file except in compliance with the License.\n"
    rows = spark.createDataFrame([(1, notice * 4000), (2, notice + "You may obtain a copy of the License at\n")], "doc_id long, text string")
    start = time.time()
    found = {r.doc_id: r.rules for r in licenses.scan(rows).collect()}
    assert found == {1: ["apache-notice"], 2: ["apache-header"]} and time.time() - start < 30
