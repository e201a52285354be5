"""Personal data: patterns propose spans, checksums confirm them, words nearby adjust the score.

Every kind has a pattern that finds its spans from left to right, a test that a span must pass, and a score: what the form alone
says, more for a checksum that holds, more for a word before the span that names the kind. Spans of the base kinds stay whatever
their score; those of the added kinds need ``least_score``. The patterns never go back over what they have read, so
a text costs time in proportion to its length, however it is made. All of it is expressions on one row.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def luhn(digits: Column) -> Column:
    """Whether the check digit at the end of a text of digits is right."""
    doubled = lambda d, i: F.when(i % 2 == 1, d * 2 - F.when(d > 4, 9).otherwise(0)).otherwise(d)
    each = F.transform(F.split(F.reverse(digits), ""), lambda c, i: doubled(F.ascii(c) - 48, i))
    return F.aggregate(each, F.lit(0), lambda total, d: total + d) % 10 == 0


def mod97(account: Column) -> Column:
    """Whether the two check digits after the country are right: letters count 10 to 35, the first four characters come last."""
    turned = F.split(F.concat(F.substr(account, F.lit(5)), F.substring(account, 1, 4)), "")
    value = lambda c: F.when(F.ascii(c) < 58, F.ascii(c) - 48).otherwise(F.ascii(c) - 55)
    step = lambda rest, c: (rest * F.when(F.ascii(c) < 58, 10).otherwise(100) + value(c)) % 97
    return F.aggregate(turned, F.lit(0), step) == 1


def digits_of(span: Column) -> Column:
    return F.regexp_replace(span, "[^0-9]", "")


_PART = "0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"


@dataclass(frozen=True)
class Kind:
    name: str
    pattern: str
    passes: Callable[[Column], Column]  # of the span's text
    prior: float  # score of the form alone
    checked: float = 0.0  # added where ``passes`` includes a checksum
    named: float = 0.3  # added if a word of ``words`` stands shortly before
    words: str = ""
    apart: tuple[str, str] | None = None  # what must not stand right before and right after
    holds: str = ""  # a text that every span holds: texts without it are not searched


#: The base kinds. Each pattern starts only where a span can start, and possessive quantifiers keep what they have read;
#: the matches are those of the plain patterns named in the comments.
BASE = (
    # [A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+
    Kind(
        "email",
        r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
        lambda s: F.lit(True), 0.9, words="mail|correo|courriel|contact|kontakt", holds="@",
    ),
    # [0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+), each part at most 255
    Kind(
        "ip",
        r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
        lambda s: s.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"), 0.6, words="ip|address|host|server|adresse|dirección",
    ),
    # [0-9]([\x20-]?[0-9])+ with 13 to 19 digits
    Kind(
        "card",
        r"(?<![0-9])(?<![0-9][ -])[0-9](?:[ -]?+[0-9]){12,18}+(?![ -]?[0-9])",
        lambda s: luhn(digits_of(s)), 0.4, checked=0.4, words="card|visa|credit|debit|karte|carte|tarjeta",
    ),
    # \+[0-9][\x20().0-9-]+[0-9] with 9 to 15 digits
    Kind(
        "phone",
        r"\+[0-9][ ().0-9-]+[0-9]",
        lambda s: F.length(digits_of(s)).between(9, 15), 0.7, words="phone|tel|call|fax|mobil|llam", holds="+",
    ),
)

#: Kinds that the method adds. Their spans never touch a span of their own kind, and stand apart from other numbers.
ADDED = (
    Kind(
        "iban",
        r"[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?",
        lambda s: F.length(F.replace(s, F.lit(" "), F.lit(""))).between(15, 34) & mod97(F.replace(s, F.lit(" "), F.lit(""))),
        0.4, checked=0.5, words="iban|account|konto|compte|cuenta", apart=("[A-Za-z0-9]$", "^[A-Za-z0-9]"),
    ),
    Kind(
        "ssn",
        r"[0-9]{3}-[0-9]{2}-[0-9]{4}",
        lambda s: ~s.rlike("^(?:000|666|9)|-00-|-0000$"),
        0.5, words="ssn|social security", apart=(r"[0-9][ -]?$|[A-Za-z._%+@-]$|\+[0-9 ().-]*$", "^[ -]?[0-9]|^[A-Za-z_%+@-]"), holds="-",
    ),
    Kind(
        "phone_national",
        r"\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4}",
        lambda s: F.lit(True),
        0.5, words="phone|tel|call|fax|mobil|llam", apart=(r"[0-9][ .()-]*$|[A-Za-z._%+@-]$|\+[0-9 ().-]*$", "^[ .-]?[0-9]|^[A-Za-z_%+@-]"),
    ),
)


#: Code points before a span in which its words count.
NEAR = 40
_RUN = 512


def running_starts(steps: Column) -> Column:
    """For numbers of an array, the sums of those before each. Sums are taken run by run, so that long arrays are not copied for each number."""

    def within(run):
        start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<long>").alias("out"))
        return F.aggregate(
            run, start, lambda a, v: F.struct((a.total + v).alias("total"), F.concat(a.out, F.array(a.total)).alias("out"))
        )

    runs = F.transform(
        F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / _RUN).cast("int")), lambda r: within(F.slice(steps, r * _RUN + 1, F.lit(_RUN)))
    )
    start = F.struct(F.lit(0).cast("long").alias("total"), F.array().cast("array<array<long>>").alias("out"))
    moved = F.aggregate(
        runs,
        start,
        lambda a, r: F.struct(
            (a.total + r.total).alias("total"), F.concat(a.out, F.array(F.transform(r.out, lambda v: v + a.total))).alias("out")
        ),
        lambda a: F.flatten(a.out),
    )
    return F.when(F.size(steps) > 0, moved).otherwise(F.array().cast("array<long>"))


def _step(rows: DataFrame, **columns: Column) -> DataFrame:
    """The rows with the columns computed, once: what is built on them later is not merged with their expressions."""
    return rows.select("*", F.inline(F.array(F.struct(*(c.alias(name) for name, c in columns.items())))))


SPAN = "struct<kind:string,start:long,end:long,score:double>"


def with_spans(
    documents: DataFrame, base: tuple[Kind, ...] = BASE, added: tuple[Kind, ...] = ADDED, least_score: float = 0.75, text_column: str = "text"
) -> DataFrame:
    """The rows with ``base_spans`` and ``added_spans``: arrays of kind, start, end (code points, end exclusive) and score.

    Kinds stand in the order given, spans of a kind by their start. A null text counts as empty and has none; repeated
    rows are searched one by one; a table without rows gives none. Columns of the two names are replaced.
    """
    kept = [c for c in documents.columns if c not in ("base_spans", "added_spans")]
    row = F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row")
    rows = documents.select(row, F.coalesce(F.col(f"`{text_column}`"), F.lit("")).alias("text"))
    none = F.array().cast("array<string>")
    kinds = (*base, *added)
    # the matches of each kind and, where there are any, what stands around them
    matches = {}
    for i, kind in enumerate(kinds):
        every = F.regexp_extract_all("text", F.lit(kind.pattern), F.lit(0))
        matches[f"m{i}"] = F.when(F.col("text").contains(kind.holds), every).otherwise(none) if kind.holds else every
    rows = _step(rows, **matches)
    rows = _step(rows, **{f"g{i}": F.when(F.size(f"m{i}") > 0, F.split("text", k.pattern, -1)).otherwise(none) for i, k in enumerate(kinds)})
    rows = rows.drop("text")
    lengths = {}
    for i in range(len(kinds)):
        pairs = F.zip_with(f"g{i}", f"m{i}", lambda g, m: F.length(g) + F.coalesce(F.length(m), F.lit(0)))
        lengths[f"s{i}"] = running_starts(F.slice(pairs, 1, F.size(f"m{i}")))
    rows = _step(rows, **lengths)
    found = {"base_spans": [], "added_spans": []}
    for i, kind in enumerate(kinds):
        spans = _spans(kind, F.col(f"m{i}"), F.col(f"g{i}"), F.col(f"s{i}"), kind in base, least_score)
        found["base_spans" if kind in base else "added_spans"].append(spans)
    empty = F.array().cast(f"array<{SPAN}>")
    rows = _step(rows, **{name: F.concat(*arrays) if arrays else empty for name, arrays in found.items()})
    return rows.select("row.*", "base_spans", "added_spans")


def _spans(kind: Kind, matches: Column, gaps: Column, starts: Column, keep_all: bool, least_score: float) -> Column:
    def judged(m: Column, i: Column) -> Column:
        before = F.substring(gaps[i], -NEAR, NEAR)
        passes = kind.passes(m)
        if kind.apart is not None:  # only at the ends of the text may nothing stand around it
            after = F.substring(gaps[i + 1], 1, 2)
            alone = (F.length(before) > 0) | (i == 0)
            alone = alone & ((F.length(after) > 0) | (i == F.size(matches) - 1))
            passes = passes & alone & ~before.rlike(kind.apart[0]) & ~after.rlike(kind.apart[1])
        named = F.lower(before).rlike(rf"(?<![\p{{L}}])(?:{kind.words})") if kind.words else F.lit(False)
        score = F.least(F.lit(1.0), F.lit(kind.prior + kind.checked) + F.when(named, kind.named).otherwise(0.0))
        start = starts[i] + F.length(gaps[i])
        return F.when(
            passes, F.struct(F.lit(kind.name).alias("kind"), start.alias("start"), (start + F.length(m)).alias("end"), score.alias("score"))
        )

    spans = F.filter(F.transform(matches, judged), lambda s: s.isNotNull())
    return spans if keep_all else F.filter(spans, lambda s: s["score"] >= least_score)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def count_of(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("long")
