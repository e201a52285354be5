"""Token files, archives, chat and pages."""

import base64
import hashlib
import io
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from podium.llm import chat, dac, html_text, warc
from podium.llm.dom import Page
from podium.llm.queries import QUERIES, tokenizer_path


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(tokenizer_path())


def token_brute(tokenizer, rows):
    out, start = [], 0
    for i, text in rows:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [1]
        out.append((i, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


def test_token_codes(spark, sf_dir, tokenizer):
    rows = sorted(tuple(r) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect())
    got = sorted(map(tuple, QUERIES["op5_token_codes"](spark, sf_dir).collect()))
    assert got == token_brute(tokenizer, rows)


@pytest.mark.parametrize("independent, size", [(True, 50), (False, 10**6)])
def test_tokens_of_odd_rows(spark, odd_documents, odd_rows, no_documents, tokenizer, independent, size):
    files = dac.write_tokens(odd_documents, tokenizer_path(), independent=independent, file_tokens=size)
    got = dac.read_tokens(files, with_ids=True).collect()
    assert sorted(((r.doc_id, r.n_tokens, r.ids_crc32) for r in got), key=str) == sorted(((a, c, d) for a, _, c, d in token_brute(tokenizer, odd_rows)), key=str)
    got = sorted(got, key=lambda r: r.start)
    assert [r.start for r in got] == np.cumsum([0] + [r.n_tokens for r in got])[:-1].tolist()
    ids = [r.doc_id for r in got]
    assert ids == sorted(ids, key=lambda i: (i is not None, i or 0))
    assert all(len(r.ids) == r.n_tokens and r.ids[-1] == 1 for r in got)
    assert dac.read_tokens(dac.write_tokens(no_documents, tokenizer_path())).collect() == []


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1) | st.integers(0, 300), max_size=1200))
def test_any_token_is_read_directly(ids):
    data = dac.TokenFile(dac.pack([3, None], np.array([len(ids), 0]), np.array(ids, np.uint32)))
    assert data.tokens().tolist() == ids and [data.token(i) for i in range(len(ids))] == ids
    assert data.doc_ids == [3, None]
    with pytest.raises(IndexError):
        data.token(len(ids))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("aB'é 1.,<|>\t̸ ß#s endoftx"), max_size=30), max_size=6))
def test_pieces_have_the_ids_of_the_text(tokenizer, texts):
    import pyarrow as pa

    counts, ids = dac.Encoder(tokenizer_path(), independent=True).encode(pa.array(texts, pa.string()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text(st.sampled_from("HJTWYAhjtwy\u0331\u030c\u0308\u0344\u030a\u0301 .'1"), max_size=20), max_size=6))
def test_capitals_and_marks_have_the_ids_of_the_text(tokenizer, texts):
    import pyarrow as pa

    texts = [*texts, *(f"{a}{b} x{a}{b}y" for a in "ABCDEFGHIJKLMNOPQRSTUVWXYZ" for b in "\u0331\u030c\u0308\u0344\u030a")]
    counts, ids = dac.Encoder(tokenizer_path(), independent=True).encode(pa.array(texts, pa.string()))
    want = [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


@pytest.mark.parametrize("kept", [1, 7, 1000])
def test_a_text_of_more_pieces_than_are_kept(tokenizer, monkeypatch, kept):
    import pyarrow as pa

    monkeypatch.setattr(dac, "KEPT_PIECES", kept)
    texts = [" ".join(f"{k * 7919}x{k}" for k in range(1500)), None, "a b", "c " * 50, "<|endoftext|> d"]
    own = dac.Encoder(tokenizer_path(), independent=True)
    for _ in range(2):
        counts, ids = own.encode(pa.array(texts, pa.string()))
        want = [tokenizer.encode(t or "", add_special_tokens=False).ids for t in texts]
        assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
        assert len(own.hashes) <= kept


def archive_brute(pages, least=0):
    first = {}
    for i, _, h in pages:
        if i is not None:
            first[h or ""] = max(first.get(h or "", i), i)
    out = []
    for i, _, h in pages:
        data, keep = (h or "").encode(), first.get(h or "")
        revisit = len(data) >= least and keep is not None and keep != i
        digest = base64.b32encode(hashlib.sha1(data).digest()).decode()
        out.append((i, len(data), digest, "revisit" if revisit else "response", keep if revisit else None))
    return sorted(out, key=str)


def archive_rows(df):
    return sorted(((r.page_id, r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in df.collect()), key=str)


def test_archives(spark, sf_dir):
    pages = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/pages.parquet").select("page_id", "url", "html").collect()]
    assert archive_rows(QUERIES["op8_warc"](spark, sf_dir)) == archive_brute(pages)


@pytest.mark.parametrize("least", [0, 4])
def test_archives_of_odd_pages(spark, monkeypatch, least):
    monkeypatch.setattr(warc, "ARCHIVE_BYTES", 2000)
    pages = [(1, "u", "same"), (2, None, "same"), (3, "a\r\nb", None), (4, "u", ""), (None, "u", "same"), (5, "u", "x\r\n\r\ny" * 30_000), (6, "ü", "é"), (7, "u", "é")]
    pages += [(None, None, None), (8, "u", "other"), (8, "u", "other")]
    frame = spark.createDataFrame([(*p, "clash", 1) for p in pages], "page_id long, url string, html string, key string, first int").repartition(3)
    files = warc.write_archives(frame, least_bytes=least)
    assert archive_rows(warc.read_archives(files)) == archive_brute(pages, least)
    payloads = {r.page_id: r.payload.decode() for r in warc.read_archives(files, with_payload=True).collect() if r.record_type == "response"}
    assert payloads[5] == pages[5][2] and payloads[7] == "é"
    assert warc.read_archives(warc.write_archives(frame.where("false"))).collect() == []


class Slow(io.BytesIO):
    """Gives a few bytes at a time."""

    def read(self, n=-1):
        return super().read(min(n, 7) if n > 0 else n)


def test_reader_goes_member_by_member():
    pages = [(i, f"u{i}", b"payload %d" % i * i) for i in range(30)]
    data = b"".join(warc.record(i, u, p, None, False) for i, u, p in pages)
    assert [r.payload for r in warc.read_records(Slow(data))] == [p for _, _, p in pages]
    one = warc.record(1, "u", b"text", None, False)
    plain = zlib.decompress(one, 31)
    packed = lambda b: (lambda z: z.compress(b) + z.flush())(zlib.compressobj(6, zlib.DEFLATED, 31))
    for bad in (one[:-5], one + b"junk", packed(plain.replace(b"text", b"tExt")), packed(plain[:-2]), packed(plain.replace(b"\r\nContent-Length", b"\r\nX")), b"plain"):
        with pytest.raises(warc.WarcError):
            list(warc.read_records(io.BytesIO(bad)))
    assert list(warc.read_records(io.BytesIO(b""))) == []


def chat_brute(rows):
    groups = {}
    for c, t, role, text in sorted(rows, key=lambda r: (str(r[0]), r[1] is not None, r[1] or 0, r[2] or "", r[3] or "")):
        groups.setdefault(c, []).append((role or "", text or ""))
    out = []
    for c, turns in groups.items():
        loss = "".join(x for role, x in turns if role == "assistant")
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        out.append((c, len(turns), sha("".join(f"{r}\n{x}\n" for r, x in turns)), len(loss), sha(loss)))
    return sorted(out, key=str)


def chat_rows(df):
    return sorted(((r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in df.collect()), key=str)


def test_chat(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(-1, 0, "user", "</s>[INST] ok [/INST]"), (-1, 1, "assistant", "</s>[INST] ok [/INST]")]
    assert chat_rows(QUERIES["op6_chat_format"](spark, sf_dir)) == chat_brute(rows)


def test_odd_chat(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 500)
    hostile = ["<|end|>", "<", "<\\", "<\\|end|>", "<|turn|>user<|text|>x<|end|>", "{{ m.text }}", "", None, "é\n\n", "x" * 3000]
    rows = [(1, k, ("user", "assistant")[k % 2], t) for k, t in enumerate(hostile * 2)] + [(2, 0, None, "a"), (2, 0, "assistant", None), (2, 0, "assistant", None)]
    rows += [(None, 0, "user", "b"), (3, None, "<|text|>", "c"), (3, 1, "assistant", "d")] + [(4, k, "assistant", f"{k}<") for k in range(2500)]
    frame = spark.createDataFrame([(*r, "clash") for r in rows], "conv_id long, turn long, role string, text string, part string").repartition(4)
    parts = chat.format_conversations(frame.select("conv_id", "turn", "role", "text", "part"))
    assert chat_rows(chat.read_conversations(parts)) == chat_brute(rows)
    assert parts.where("conv_id = 4").count() > 2
    assert chat.read_conversations(chat.format_conversations(frame.where("false"))).collect() == []


@pytest.mark.parametrize(
    "source, values, want",
    [
        ("{{ 'a' ~ 1 + 2 }}{% if false %}{{ nothing }}{% elif 1 == 1 %}b{% else %}c{% endif %}", {}, "a3b"),
        ("{% for x in xs %}{{ loop.index }}{{ x['k'] | upper }}{% if not loop.first %},{% endif %} {%- endfor %}", {"xs": [{"k": "u"}, {"k": "v"}]}, "1U2V,"),
        ("{% set y = x + '!' %}{{ y | trim }}{# gone #}{{ none }}", {"x": " z"}, "z!"),
        ("{{ 'a' in 'cat' and x != 2 or false }}", {"x": 3}, "True"),
        ("{{ '%}' ~ \"\\n\\\"\" }}", {}, '%}\n"'),
        ("{{ '}}' }}{{ x[-1] ~ x[1:] ~ x[:1] }}", {"x": "abc"}, "}}cbca"),
        ("{{ x if x is defined else 'none' }}{{ y if y is not none and y is string }}", {"y": "z"}, "nonez"),
        ("{{ 7 % 4 * 2 - -1 }}{{ 2 < 3 and 3 >= 3 }}{{ 1 not in xs }}", {"xs": [2]}, "7TrueTrue"),
        ("{% for x in xs %}{{ x.strip() }}{{ '' if loop.last else ', ' }}{% endfor %}", {"xs": [" a", "b "]}, "a, b"),
        ("{% set s = namespace(n=0) %}{% for x in xs %}{% set s.n = s.n + x %}{% set y = x %}{% endfor %}{{ s.n }}{{ y is defined }}", {"xs": [1, 2]}, "3False"),
    ],
)
def test_templates(source, values, want):
    assert "".join(t for t, _ in chat.Template(source).render(**values).pieces) == want


#: Shapes of templates in common use, and what they make of the turns below.
TURNS = [{"role": "system", "content": "S"}, {"role": "user", "content": " u "}, {"role": "assistant", "content": "a"}]
SHAPES = [
    (
        "{% for message in messages %}{{ '<|im_start|>' + message['role'] + '\\n' + message['content'] + '<|im_end|>' + '\\n' }}{% endfor %}"
        "{% if add_generation_prompt %}{{ '<|im_start|>assistant\\n' }}{% endif %}",
        "<|im_start|>system\nS<|im_end|>\n<|im_start|>user\n u <|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n",
    ),
    (
        "{% if messages[0]['role'] == 'system' %}{% set rest = messages[1:] %}{% set system = messages[0]['content'] %}{% else %}{% set rest = messages %}"
        "{% set system = false %}{% endif %}{% for m in rest %}{% if (m['role'] == 'user') != (loop.index0 % 2 == 0) %}{{ raise_exception('roles') }}{% endif %}"
        "{% if loop.index0 == 0 and system != false %}{% set content = '<<SYS>>' + system + '<</SYS>>' + m['content'] %}{% else %}"
        "{% set content = m['content'] %}{% endif %}{% if m['role'] == 'user' %}{{ bos + '[INST] ' + content.strip() + ' [/INST]' }}{% else %}"
        "{{ ' ' + content.strip() + ' ' + eos }}{% endif %}{% endfor %}",
        "<s>[INST] <<SYS>>S<</SYS>> u [/INST] a </s>",
    ),
    (
        "{% for m in messages %}{% set content = '<|h|>' + m['role'] + '<|/h|>' + m['content'] | trim %}{% if loop.index0 == 0 %}"
        "{% set content = bos + content %}{% endif %}{{ content }}{% endfor %}",
        "<s><|h|>system<|/h|>S<|h|>user<|/h|>u<|h|>assistant<|/h|>a",
    ),
    (
        "{%- set ns = namespace(found=false) -%}{%- for m in messages -%}{%- if m['role'] == 'system' -%}{%- set ns.found = true -%}{%- endif -%}"
        "{%- endfor -%}{%- if not ns.found -%}{{- 'no' -}}{%- endif -%}{%- for m in messages if_any -%}{%- endfor -%}",
        None,
    ),
    (
        "{%- set ns = namespace(found=false) -%}{%- for m in messages -%}{%- if m['role'] == 'system' -%}{%- set ns.found = true -%}{%- endif -%}"
        "{%- endfor -%}{{- 'yes' if ns.found else 'no' -}}{%- if tools is defined -%}{{ tools | tojson }}{%- endif -%} ({{ messages | length }})",
        "yes(3)",
    ),
]


@pytest.mark.parametrize("source, want", SHAPES)
def test_common_templates(source, want):
    if want is None:
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render(messages=TURNS)
        return
    made = chat.Template(source).render(messages=TURNS, add_generation_prompt=True, bos="<s>", eos="</s>")
    assert "".join(t for t, _ in made.pieces) == want


def test_loops_go_on_through_long_conversations(spark, monkeypatch):
    monkeypatch.setattr(chat, "PART_CHARS", 300)
    rows = spark.createDataFrame([(c, k, "user", f"t{k}") for c, n in ((1, 10), (2, 3000)) for k in range(n)], "conv_id long, turn long, role string, text string")
    for extra, passes in (("", True), ("{{ messages | length }}", False)):
        source = "{% set n = 5 %}{% for m in messages %}{{ loop.index + n }}{{ m.text }}{% if loop.first %}F{% endif %}{% if loop.last %}L{% endif %};{% endfor %}" + extra
        assert chat.Template(source).in_one_pass == passes
        parts = chat.format_conversations(rows, source).orderBy("conv_id", "part").collect()
        for c, n in ((1, 10), (2, 3000)):
            want = "".join(f"{k + 6}t{k}{'F' * (k == 0)}{'L' * (k == n - 1)};" for k in range(n)) + (str(n) if extra else "")
            assert "".join(r.text for r in parts if r.conv_id == c) == want
        assert sum(r.conv_id == 2 for r in parts) > 10


@pytest.mark.parametrize("source", ["{% for x %}{% endfor %}", "{% if x %}", "{{ x.__class__ + }}", "{{ open('f') }}", "{% nope %}", "{{ x | nope }}", "{% endif %}", "{{ (1 }}", "{{ @ }}"])
def test_wrong_templates(source):
    with pytest.raises(chat.TemplateError):
        chat.Template(source)


def test_templates_cannot_reach_python():
    for source in ("{{ x.__class__ }}", "{{ x['__class__'] }}", "{{ y }}"):
        with pytest.raises(chat.TemplateError):
            chat.Template(source).render(x={"a": 1})


def test_constants_are_folded():
    pieces = chat.Template("a{{ 'b' }}{% if 1 == 2 %}{{ x }}{% endif %}{{ 'c' | upper }}").render().pieces
    assert "".join(t for t, _ in pieces) == "abC"


def article(html):
    page = Page(html)
    inside, out = set(), []
    for i, tag in enumerate(page.tag):
        if tag == "article" or page.parent[i] in inside:
            inside.add(i)
    for block, text, _ in page.texts():
        if block in inside:
            out.append(text)
    return "\n".join(out)


def test_pages(spark, sf_dir):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{sf_dir}/pages.parquet").collect()}
    found = QUERIES["op9_html_text"](spark, sf_dir).collect()
    assert len(found) == len(pages) and all(r.n_chars == len(r.text) for r in found)
    assert sum(r.text == article(pages[r.page_id]) for r in found) >= 0.99 * len(found)


@pytest.fixture(scope="module")
def trees(spark, sf_dir):
    return html_text.learn_pages(spark.read.parquet(f"{sf_dir}/pages.parquet"))


PROSE = ["The first sentence of a story that goes on, and on.", "Second paragraph: more words, with a clause or two, and an end.", "Third one is about the weather of the north and its people."]
AROUND = "<nav><ul><li><a href=/a>Home</a></li><li><a href=/b>About</a></li></ul></nav><div class='cookie-notice'>We use cookies.</div>"
AFTER = "<div class='ad'>Buy now!</div><aside><p>Other stories of the week are here.</p></aside><div class='comments'><p>Nice story, I liked it very much indeed.</p><p>Me too, thank you for it.</p></div><form><label>Mail</label><input><button>Send</button></form><footer>&copy; 2020 Someone</footer>"


@pytest.mark.parametrize("home", ["article", "main", "div class='content'", "section class='story'"])
def test_main_text(spark, trees, home):
    body = "".join(f"<p>{t}</p>" for t in PROSE)
    html = f"<html><head><title>T</title><script>var x = '<p>no</p>';</script></head><body>{AROUND}<{home}><h1>A &amp; B</h1>{body}</{home.split()[0]}>{AFTER}</body></html>"
    found = html_text.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), trees).first()
    assert found.text == "\n".join(["A & B", *PROSE])


@pytest.mark.parametrize(
    "html, want",
    [
        ("<head><title>T</title><meta name=a><body><p>a</p><p>b</p>", ["a", "b"]), ("<head><title>T</title><p>a<p>b", ["a", "b"]),
        ("<html><head><title>T</title>plain <b>text</b>", ["plain text"]), ("<head><script>no</script><link><span>a</span>", ["a"]),
        ("<head><noscript><p>no</p></noscript><title>T</title></head><body>a", ["a"]), ("<head><template><p>no</p></template><body>a", ["a"]),
        ("<body><svg><path><text>no</text><p>a</p>", ["a"]), ("<svg><title>no</title><text>no</text></svg><p>a</p>", ["a"]),
        ("<svg><foreignObject><p>no</p></foreignObject></svg>a", ["a"]), ("<section><video>no</section><p>a</p>", ["a"]),
        ("<body><audio>no</body>a", ["a"]), ("<p>x <math><mi>y</mi></math> z</p>", ["x y z"]), ("<p><object>a</object> b</p>", ["a b"]),
    ],
)
def test_omitted_end_tags(html, want):
    assert [text for _, text, _ in Page(html).texts()] == want


def test_main_text_without_end_of_head(spark, trees):
    body = "".join(f"<p>{t}" for t in PROSE)
    html = f"<html><head><title>T</title><meta charset=utf-8><body>{AROUND}<article><h1>A &amp; B</h1>{body}</article>{AFTER}"
    found = html_text.extract(spark.createDataFrame([(1, "u", html)], "page_id long, url string, html string"), trees).first()
    assert found.text == "\n".join(["A & B", *PROSE])


def test_odd_pages(spark, trees):
    long = "<article>" + "".join(f"<p>Sentence {k} of a long story, with words.</p>" for k in range(5000)) + "</article>"
    pages = [(1, "u", None), (2, None, ""), (3, "u", "<<<>>& &#0; <p"), (4, "u", long), (4, "u", long), (None, "u", "<article><p>a&nbsp;b\n c<br>d"), (5, "u", "<div>" * 3000 + "deep")]
    frame = spark.createDataFrame([(*p, "clash") for p in pages], "page_id long, url string, html string, text string").repartition(2)
    found = html_text.extract(frame, trees).collect()
    assert len(found) == len(pages)
    by = {r.page_id: r for r in found}
    assert by[1].text == by[2].text == "" and by[1].n_chars == 0
    assert by[4].text.count("\n") == 4999 and by[None].text == "a b c d"
    assert html_text.extract(frame.where("false"), trees).collect() == []
    assert html_text.learn_pages(frame.where("false")).base is not None


def test_decoding_is_the_best_choice():
    import itertools

    rng = np.random.default_rng(1)
    for _ in range(30):
        n = 8
        parent = [-1] + [int(rng.integers(0, i)) for i in range(1, n)]
        logits, own = rng.normal(size=n), rng.integers(0, 4, n)
        keep = html_text.chosen(parent, logits.copy(), own)
        gain = logits * np.maximum(own, 1)
        gain[0] = 0
        best = max(
            sum(gain[i] for i in range(n) if c[i])
            for c in itertools.product([False, True], repeat=n)
            if c[0] and all(not c[i] or c[parent[i]] for i in range(1, n))
        )
        assert np.isclose(gain[keep].sum(), best) and all(not keep[i] or keep[parent[i]] for i in range(1, n))


def test_pages_of_open_or_unmatched_tags_take_linear_time():
    from time import monotonic

    from podium.llm.dom import Page

    begin = monotonic()
    for html in (
        "<div>" * 200_000 + "end", "<span>" * 50_000 + "</b>" * 150_000 + "end", "<svg>" + "<g>" * 300_000 + "</svg>end",
        "<!-- >" * 150_000 + "end", "<!--" * 250_000 + "end", "<a b='" * 150_000 + "end",
    ):
        assert Page(html).texts()[-1][1].endswith("end")
    assert monotonic() - begin < 60


def test_text_behind_the_last_tag_is_kept():
    from podium.llm.dom import Page

    assert [text for _, text, _ in Page("<p>a<div>b</div>c &amp; d").texts()] == ["a", "b", "c & d"]
    assert [text for _, text, _ in Page("5 &lt; 6 and no tag").texts()] == ["5 < 6 and no tag"]
    assert [text for _, text, _ in Page("<p>a<!-- b --><p>c<!-- d <b>e").texts()][0] == "a"
