"""Personal data against plain patterns and checks, and in time on texts made to be slow."""

import hashlib
import re
import time

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from podium.llm import personal_data

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    doubled = [int(d) * (1 + k % 2) for k, d in enumerate(reversed(digits))]
    return sum(d // 10 + d % 10 for d in doubled) % 10 == 0


def passes(kind, span):
    digits = re.sub("[^0-9]", "", span)
    if kind == "ip":
        return all(int(part) <= 255 for part in span.split("."))
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 9 <= len(digits) <= 15


def base_spans(text):
    found = [(k, m.start(), m.end()) for k, p in PLAIN.items() for m in re.finditer(p, text or "", re.ASCII) if passes(k, m[0])]
    return [f"{k}:{a}:{b}" for k, a, b in found]


def found_spans(spark, texts, name="base_spans"):
    frame = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    rows = personal_data.with_spans(frame).select("doc_id", personal_data.listed(F.col(name)).alias("s")).collect()
    return [r.s.split(",") if r.s else [] for r in sorted(rows)]


HARD = [
    None, "", "a@b.c_d@e.f g@h..i j@k.l.", "..@a.b", "é@b.co ü1.2.3.4ö", "😀 x@y.z 😀 1.2.3.4", "999.1.1.1.1.1.1.1", "1.2.3.4.5.6.7.8", "007.0255.000256.1",
    "4785380592391139", "x4785 3805-9239 1139y", "4785  380592391139", "1 4785380592391139", "47853805923911390000000", "0000000000000", "+1 (523) 555-1055",
    "+1..", "+1 555", "+123456789012345", "+1234567890123456", "++1 523 555 1055+", "+1 (523) 555-1055) 9 +4 4", "a@b@c.d", "a@-.-", "@a.b", "%@1.1",
    "1.1.1.1@2.2.2.2", "4785380592391139.1.1.1", "-4785380592391139-", "5-5 5 5-5555555555554444",
]


def test_hard_texts(spark):
    assert found_spans(spark, HARD) == [base_spans(t) for t in HARD]


@settings(max_examples=6, deadline=None)
@given(st.lists(st.text(alphabet="aZ09 .-@+(_%é😀4", max_size=60), min_size=100, max_size=100))
def test_any_text(spark, texts):
    assert found_spans(spark, texts) == [base_spans(t) for t in texts]


def test_many_spans_in_one_text(spark):
    text = " ".join(f"u{k}@x.org 10.0.0.{k % 300} é" for k in range(3000))
    assert found_spans(spark, [text]) == [base_spans(text)]


@pytest.mark.parametrize("unit", ["a", "1", "1.", "1 ", "a@", "a.", "+1", "+1 ", "A1", "AB12", "1-", "a@b.", "(123) ", "123-"])
def test_time_grows_with_the_text_only(spark, unit):
    frame = spark.createDataFrame([(1, unit * (400_000 // len(unit)))], "doc_id long, text string")
    start = time.time()
    assert len(personal_data.with_spans(frame).select("base_spans", "added_spans").collect()) == 1
    assert time.time() - start < 20


def test_added_kinds(spark):
    texts = [
        "IBAN GB82 WEST 1234 5698 7654 32.", "DE89370400440532013000", "DE88370400440532013000", "xDE89370400440532013000", "my ssn is 123-45-6789.",
        "123-45-6789", "ssn 000-45-6789", "ssn 9123-45-6789", "call (523) 555-1055 now", "(523) 555-1055", "phone +1 (523) 555-1055", "tel 523-555-1055-1",
        "phone 523.555.1055", "hotel 523-555-1055",
    ]
    expected = [
        ["iban:5:32"], ["iban:0:22"], [], [], ["ssn:10:21"], [], [], [], ["phone_national:5:19"], [], [], [], ["phone_national:6:18"], [],
    ]
    assert found_spans(spark, texts, "added_spans") == expected


def test_scores(spark):
    rows = [(1, "reach me by mail: a@b.org"), (2, "a@b.org"), (3, "card 4785380592391139")]
    found = personal_data.with_spans(spark.createDataFrame(rows, "doc_id long, text string")).orderBy("doc_id").collect()
    assert [round(r.base_spans[0].score, 2) for r in found] == [1.0, 0.9, 1.0]


def test_odd_documents(spark, odd_documents, odd_rows, no_documents):
    found = personal_data.with_spans(odd_documents)
    assert found.columns == [*odd_documents.columns, "base_spans", "added_spans"]
    assert sorted(((r.doc_id, r.text) for r in found.collect()), key=str) == sorted(odd_rows, key=str)
    assert personal_data.with_spans(no_documents).collect() == []
    again = personal_data.with_spans(found.withColumn("m0", F.lit(1)).withColumn("text", F.lit("a@b.c")))
    assert all([s.kind for s in r.base_spans] == ["email"] for r in again.collect())


def test_whole_table(spark, sf_dir):
    from podium.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = QUERIES["op13_personal_data"](spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = base_spans(texts[r.doc_id])
        counts = [sum(s.startswith(k + ":") for s in spans) for k in PLAIN]
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == counts and r.spans.split(",")[: len(spans)] == (spans or [""])[: len(spans)]
        assert r.base_sha256 == hashlib.sha256(",".join(spans).encode()).hexdigest()
