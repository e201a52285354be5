"""Chat formatting by compiled templates.

A small template language is parsed into a syntax tree, constants are folded, and each node becomes
a Python closure that yields pieces of text. Templates can only read the values they are given: there is no attribute access
beyond mapping keys, no call but of the filters and functions below, and no unbounded loop.

    {{ expression }}   {% for x in expression %}...{% endfor %}   {% set x = expression %}   {% set space.x = expression %}
    {% if e %}...{% elif e %}...{% else %}...{% endif %}   {% generation %}...{% endgeneration %}
    expressions: 'text', 12, true, false, none, name, a.key, a['key'], a[-1], a[1:], a | filter, a if b else c, not, and, or,
    ==, !=, <, <=, >, >=, in, not in, is [not] defined / none / string / mapping, +, -, *, %, ~, ( )
    namespace(x=1), raise_exception(text), and of texts: strip lstrip rstrip upper lower title startswith endswith replace split

Loops have ``loop.index``, ``index0``, ``first``, ``last``, and what is set inside ends with them, but for namespaces.
``generation`` marks what a model is to produce: the renderer gives the places of its text.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from podium.session import new_folder, ship_package


class TemplateError(ValueError):
    """A template that cannot be parsed, or asks for something that is not there."""


class MissingValue(TemplateError):
    """A name or an item that is not there."""


_QUOTED = r"'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\""
_PIECE = re.compile(rf"\{{\{{-?((?:{_QUOTED}|.)*?)-?\}}\}}|\{{%(-?)((?:{_QUOTED}|.)*?)(-?)%\}}|\{{#.*?#\}}", re.S)
_TOKEN = re.compile(rf"\s*(?:({_QUOTED})|(\d+)|([A-Za-z_]\w*)|(==|!=|<=|>=|[-+*%<>~|.,:=()\[\]]))")
_METHODS = set("strip lstrip rstrip upper lower title startswith endswith replace split".split())
_TESTS: dict[str, Callable] = {
    "none": lambda v: v is None, "string": lambda v: isinstance(v, str), "mapping": lambda v: isinstance(v, dict),
    "true": lambda v: v is True, "false": lambda v: v is False, "number": lambda v: isinstance(v, int) and not isinstance(v, bool),
}
_FILTERS: dict[str, Callable] = {"trim": lambda v: str(v).strip(), "upper": lambda v: str(v).upper(), "lower": lambda v: str(v).lower(), "length": len}
_FILTERS |= {"string": str, "tojson": lambda v: json.dumps(v, ensure_ascii=False)}
_CONSTANTS = {"true": True, "false": False, "none": None}
_ESCAPES = {"n": "\n", "t": "\t", "\\": "\\", "'": "'", '"': '"'}


@dataclass(frozen=True)
class Const:
    value: object


@dataclass(frozen=True)
class Op:
    kind: str
    args: tuple


class _Expression:
    """Recursive descent, loosest operators first; constants are folded as nodes are made."""

    def __init__(self, text: str, extra: dict[str, Callable]):
        self.filters, self.tokens, at = _FILTERS | extra, [], 0
        text = text.strip()
        while at < len(text):
            m = _TOKEN.match(text, at)
            if not m:
                raise TemplateError(f"cannot read {text[at:at + 20]!r}")
            self.tokens.append((m.lastindex, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def parse(self):
        node = self.chosen()
        if self.at < len(self.tokens):
            raise TemplateError(f"{self.tokens[self.at][1]!r} is left over")
        return node

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) else None

    def accept(self, *words: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != 1 and self.peek() in words:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def made(self, kind: str, *args):
        node = Op(kind, args)
        if all(isinstance(a, Const) or isinstance(a, str) for a in args) and kind != "name":
            try:
                return Const(_closure(node, self.filters)({}))
            except (TypeError, ZeroDivisionError) as wrong:
                raise TemplateError(f"constants that do not go together: {wrong}") from wrong
        return node

    def need(self, word: str):
        if not self.accept(word):
            raise TemplateError(f"{word} is missing")

    def chosen(self):
        node = self.either()
        while self.accept("if"):
            test = self.either()
            other = self.chosen() if self.accept("else") else Const(None)
            node = (node if test.value else other) if isinstance(test, Const) else Op("choice", (test, node, other))
        return node

    def either(self):
        node = self.both()
        while self.accept("or"):
            node = self.made("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.accept("and"):
            node = self.made("and", node, self.negated())
        return node

    def negated(self):
        return self.made("not", self.negated()) if self.accept("not") else self.compared()

    def compared(self):
        node = self.joined()
        while word := self.accept("==", "!=", "<", "<=", ">", ">=", "in", "not", "is"):
            if word == "is":
                wanted, name = not self.accept("not"), self.peek()
                self.at += 1
                if name != "defined" and name not in _TESTS:
                    raise TemplateError(f"no test {name!r}")
                node = Op("defined", (node,)) if name == "defined" else self.made("test", node, name)
                node = node if wanted else self.made("not", node)
                continue
            if word == "not":
                self.need("in")
                node = self.made("not", self.made("in", node, self.joined()))
            else:
                node = self.made(word, node, self.joined())
        return node

    def joined(self):
        node = self.added()
        while self.accept("~"):
            node = self.made("~", node, self.added())
        return node

    def added(self):
        node = self.multiplied()
        while word := self.accept("+", "-"):
            node = self.made(word, node, self.multiplied())
        return node

    def multiplied(self):
        node = self.signed()
        while word := self.accept("*", "%"):
            node = self.made(word, node, self.signed())
        return node

    def signed(self):
        return self.made("-", Const(0), self.signed()) if self.accept("-") else self.filtered()

    def arguments(self) -> tuple[list, dict]:
        """What stands between the parentheses of a call, the first of which has been read."""
        given, named = [], {}
        while not self.accept(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == 3 and self.tokens[self.at + 1][1] == "=":
                name, self.at = self.peek(), self.at + 2
                named[name] = self.chosen()
            else:
                given.append(self.chosen())
            if self.peek() != ")":
                self.need(",")
        return given, named

    def filtered(self):
        node = self.atom()
        while word := self.accept("|", ".", "["):
            if word == "[":
                first = Const(None) if self.peek() == ":" else self.chosen()
                if self.accept(":"):
                    node = self.made("slice", node, first, Const(None) if self.peek() == "]" else self.chosen())
                else:
                    node = self.made("item", node, first)
                self.need("]")
                continue
            name = self.peek()
            if name is None or self.tokens[self.at][0] != 3:
                raise TemplateError(f"a name has to follow {word}")
            self.at += 1
            if word == "|" and name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            if word == "|":
                node = self.made("filter", node, name)
            elif self.accept("("):
                given, named = self.arguments()
                if name not in _METHODS or named:
                    raise TemplateError(f"no method {name!r} with these arguments")
                node = self.made("method", node, name, *given)
            else:
                node = self.made("item", node, Const(name))
        return node

    def atom(self):
        if self.accept("("):
            node = self.chosen()
            self.need(")")
            return node
        if self.at == len(self.tokens):
            raise TemplateError("an expression ends too early")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == 1:
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[0]), word[1:-1], flags=re.S))
        if kind == 2:
            return Const(int(word))
        if kind == 3 and word in ("namespace", "raise_exception") and self.accept("("):
            given, named = self.arguments()
            if word == "namespace" and given or word == "raise_exception" and (named or len(given) != 1):
                raise TemplateError(f"{word} with these arguments")
            return Op(word, (*given, *named.values(), tuple(named)))
        if kind == 3:
            return Const(_CONSTANTS[word]) if word in _CONSTANTS else Op("name", (word,))
        raise TemplateError(f"{word!r} in the wrong place")


def _closure(node, filters: dict[str, Callable]) -> Callable[[dict], object]:
    if isinstance(node, Const):
        value = node.value
        return lambda scope: value
    if node.kind == "name":
        name = node.args[0]

        def look(scope):
            if name not in scope:
                raise MissingValue(f"no value {name!r}")
            return scope[name]

        return look
    if node.kind == "filter":
        inner, use = _closure(node.args[0], filters), filters[node.args[1]]
        return lambda scope: use(inner(scope))
    parts = [_closure(a, filters) for a in node.args if isinstance(a, (Const, Op))]
    if node.kind == "not":
        return lambda scope: not parts[0](scope)
    if node.kind == "defined":

        def defined(scope):
            try:
                parts[0](scope)
            except MissingValue:
                return False
            return True

        return defined
    if node.kind == "test":
        holds = _TESTS[node.args[1]]
        return lambda scope: holds(parts[0](scope))
    if node.kind == "choice":
        test, one, other = parts
        return lambda scope: one(scope) if test(scope) else other(scope)
    if node.kind == "namespace":
        return lambda scope: _Space(zip(node.args[-1], (part(scope) for part in parts)))
    if node.kind == "raise_exception":

        def fail(scope):
            raise TemplateError(str(parts[0](scope)))

        return fail
    if node.kind == "method":
        name = node.args[1]

        def method(scope):
            owner, *given = (part(scope) for part in parts)
            if not isinstance(owner, str):
                raise TemplateError(f"{name} of what is no text")
            return getattr(owner, name)(*given)

        return method
    if node.kind == "slice":

        def cut(scope):
            owner, begin, end = (part(scope) for part in parts)
            if not isinstance(owner, (list, str)):
                raise TemplateError("a slice of what is no list or text")
            return owner[begin:end]

        return cut
    left, right = parts
    if node.kind == "item":

        def item(scope):
            owner, key = left(scope), right(scope)
            if isinstance(owner, dict) and key in owner or isinstance(owner, (list, str)) and isinstance(key, int) and -len(owner) <= key < len(owner):
                return owner[key]
            raise MissingValue(f"no item {key!r}")

        return item
    return {
        "or": lambda scope: left(scope) or right(scope),
        "and": lambda scope: left(scope) and right(scope),
        "==": lambda scope: left(scope) == right(scope),
        "!=": lambda scope: left(scope) != right(scope),
        "<": lambda scope: left(scope) < right(scope),
        "<=": lambda scope: left(scope) <= right(scope),
        ">": lambda scope: left(scope) > right(scope),
        ">=": lambda scope: left(scope) >= right(scope),
        "in": lambda scope: left(scope) in right(scope),
        "+": lambda scope: left(scope) + right(scope),
        "-": lambda scope: left(scope) - right(scope),
        "*": lambda scope: _number(left(scope)) * _number(right(scope)),
        "%": lambda scope: _number(left(scope)) % _number(right(scope)),
        "~": lambda scope: str(left(scope)) + str(right(scope)),
    }[node.kind]


def _number(value) -> int:
    if not isinstance(value, int):
        raise TemplateError(f"{value!r} is no number")
    return value


class _Space(dict):
    """A namespace: what a template may set from inside a loop."""


@dataclass
class Rendered:
    """Pieces of text in order, each with whether a model is to generate it."""

    pieces: list[tuple[str, bool]] = field(default_factory=list)


class _Mode:
    """Whether what is rendered now is to be generated."""

    generated = False


_END = object()


class Template:
    """A compiled template. ``render`` gives pieces of text, each with whether it is to be generated."""

    def __init__(self, source: str, filters: dict[str, Callable] | None = None):
        self.filters = filters or {}
        self.pieces, at, strip = [], 0, False
        for m in _PIECE.finditer(source):
            text = source[at : m.start()]
            text = text.lstrip() if strip else text
            strip = m[4] == "-" or m[0].endswith("-}}")
            text = text.rstrip() if m[2] == "-" or m[0].startswith("{{-") else text
            self.pieces.append(("text", text))
            if m[1] is not None:
                self.pieces.append(("value", m[1]))
            elif m[3] is not None:
                self.pieces.append(("tag", m[3].strip()))
            at = m.end()
        self.pieces.append(("text", source[at:].lstrip() if strip else source[at:]))
        self.at = self.depth = self.loops = 0
        self.uses = sum(len(re.findall(r"\bmessages\b", text)) for kind, text in self.pieces if kind != "text")
        self.body, last = self._block(())
        if last is not None:
            raise TemplateError(f"{last!r} ends nothing")

    def _expression(self, text: str):
        return _Expression(text, self.filters).parse()

    def _run(self, text: str) -> Callable:
        return _closure(self._expression(text), _FILTERS | self.filters)

    def _block(self, ends: tuple[str, ...]):
        """Closures up to one of the tags ``ends``; adjacent constant texts become one."""
        steps: list = []

        def constant(text: str):
            if steps and isinstance(steps[-1], str):
                steps[-1] += text
            elif text:
                steps.append(text)

        while self.at < len(self.pieces):
            kind, text = self.pieces[self.at]
            self.at += 1
            if kind == "text":
                constant(text)
            elif kind == "value":
                node = self._expression(text)
                if isinstance(node, Const):
                    constant("" if node.value is None else str(node.value))
                else:
                    steps.append(self._value(_closure(node, _FILTERS | self.filters)))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return self._chain(steps), text
                steps.append(self._tag(word, rest))
        if ends:
            raise TemplateError(f"one of {', '.join(ends)} is missing")
        return self._chain(steps), None

    def _chain(self, steps: list) -> Callable:
        run = [(lambda text: lambda scope, mode: ((text, mode.generated),))(s) if isinstance(s, str) else s for s in steps]

        def chain(scope, mode):
            for step in run:
                yield from step(scope, mode)

        return run[0] if len(run) == 1 else chain

    def _value(self, get: Callable) -> Callable:
        def value(scope, mode):
            found = get(scope)
            if found is not None and found != "":
                yield str(found), mode.generated

        return value

    def _tag(self, word: str, rest: str) -> Callable:
        if word == "set":
            name, _, text = rest.partition("=")
            get, (space, dot, key) = self._run(text), name.strip().partition(".")

            def assign(scope, mode):
                if not dot:
                    scope[space] = get(scope)
                elif isinstance(scope.get(space), _Space):
                    scope[space][key] = get(scope)
                else:
                    raise TemplateError(f"no namespace {space!r}")
                return ()

            return assign
        if word == "generation":
            body, _ = self._block(("endgeneration",))

            def generation(scope, mode):
                before, mode.generated = mode.generated, True
                yield from body(scope, mode)
                mode.generated = before

            return generation
        if word == "for":
            m = re.fullmatch(r"(\w+)\s+in\s+(.*)", rest.strip(), re.S)
            if not m:
                raise TemplateError(f"cannot read the loop {rest!r}")
            name, get = m[1], self._run(m[2])
            self.depth += 1
            body, _ = self._block(("endfor",))
            self.depth -= 1
            outermost = not self.depth
            if outermost and m[2].strip() == "messages":
                self.loops += 1

            def loop(scope, mode):
                items, i = iter(get(scope)), 0
                item = next(items, _END)
                while item is not _END:
                    after = next(items, _END)
                    inner = scope | {name: item, "loop": {"index0": i, "index": i + 1, "first": i == 0, "last": after is _END}}
                    yield from body(inner, mode)
                    if outermost:
                        yield None  # what is rendered may be cut here
                    item, i = after, i + 1

            return loop
        if word == "if":
            branches, test, end = [], rest, None
            while end != "endif":
                body, end = self._block(("elif", "else", "endif") if test is not None else ("endif",))
                node = Const(True) if test is None else self._expression(test)
                if not (isinstance(node, Const) and not node.value):  # a branch that is never taken is left out
                    branches.append((_closure(node, _FILTERS | self.filters), body))
                word, _, rest = end.partition(" ")
                test, end = (rest if word == "elif" else None), word

            def choose(scope, mode):
                for holds, body in branches:
                    if holds(scope):
                        return body(scope, mode)
                return ()

            return choose
        raise TemplateError(f"no tag {word!r}")

    @property
    def in_one_pass(self) -> bool:
        """Whether ``messages`` are only gone through once, by a loop that is not inside another one."""
        return self.loops == self.uses == 1

    def stream(self, **values) -> Iterator[tuple[str, bool] | None]:
        """Pieces as they are rendered; None after each round of an outermost loop."""
        return iter(self.body(dict(values), _Mode()))

    def render(self, **values) -> Rendered:
        return Rendered([piece for piece in self.stream(**values) if piece])


#: Control strings of the formatted text. ``<`` inside a text is written ``<\\``, so none of them can occur in one.
BEGIN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"


def escape(text: str) -> str:
    return text.replace("<", "<\\")


def unescape(text: str) -> str:
    return text.replace("<\\", "<")


TEMPLATE = (
    "{% for m in messages %}" + BEGIN + "{{ m.role | escape }}" + TEXT + "{% if m.role == 'assistant' %}"
    "{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}" + END + "{% endfor %}"
)
#: Characters after which a stored part of a conversation ends, at the end of the turn.
PART_CHARS = 1_000_000


def format_conversations(conversations: DataFrame, template: str = TEMPLATE, folder: str | None = None) -> DataFrame:
    """Format (conv_id, turn, role, text); the stored parts (conv_id, part, text, spans) are returned.

    Turns come by number, those of equal number by role and text. A conversation is rendered in one go, whatever its length; its parts belong one after
    the other. A template that goes through ``messages`` by one loop takes turns as they come, so that a worker holds one turn and one part; for any
    other use of ``messages`` it holds the turns of one conversation. ``spans`` are the begins and ends, in
    characters of the part, of what a model is to generate. A null text or role is empty; rows without a
    conv_id are one conversation; repeated rows are turns of their own; an empty table has no parts.
    """
    ship_package(conversations.sparkSession)
    Template(template, {"escape": escape})  # a wrong template fails here
    shape = pa.schema([("conv_id", pa.int64()), ("part", pa.int64()), ("text", pa.string()), ("spans", pa.list_(pa.list_(pa.int64())))])

    def run(batches):
        made = Template(template, {"escape": escape})
        rows = (row for batch in batches for row in batch.to_pylist())
        out, held = [], 0
        for conv_id, turns in groupby(rows, key=lambda row: row["conv_id"]):
            messages = ({"role": row["role"], "text": row["text"], "content": row["text"]} for row in turns)
            part, text, spans, at = 0, [], [], 0
            for piece in made.stream(messages=messages if made.in_one_pass else list(messages)):
                if piece:
                    if piece[1]:
                        spans.append([at, at + len(piece[0])])
                    text.append(piece[0])
                    at += len(piece[0])
                elif at > PART_CHARS:
                    out.append({"conv_id": conv_id, "part": part, "text": "".join(text), "spans": spans})
                    yield pa.RecordBatch.from_pylist(out, schema=shape)
                    part, text, spans, at, out, held = part + 1, [], [], 0, [], 0
            if at or not part:
                out.append({"conv_id": conv_id, "part": part, "text": "".join(text), "spans": spans})
                held += at
            if len(out) >= 1000 or held > PART_CHARS:
                yield pa.RecordBatch.from_pylist(out, schema=shape)
                out, held = [], 0
            for _ in turns:  # what the template left unread
                pass
        yield pa.RecordBatch.from_pylist(out, schema=shape)

    rows = conversations.select(
        F.col("conv_id").cast("long"), F.col("turn").cast("long"), F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    path = folder or new_folder(conversations.sparkSession, "chat")
    rows.select("conv_id", "role", "text").mapInArrow(run, "conv_id long, part long, text string, spans array<array<long>>").write.parquet(path)
    return conversations.sparkSession.read.parquet(path)


def parse_turns(text: str) -> Iterator[tuple[str, str, int, int]]:
    """The turns of a formatted text: role, text, and where the text begins and ends in its escaped form."""
    at = 0
    while at < len(text):
        if not text.startswith(BEGIN, at):
            raise ValueError("a turn does not begin where the last one ended")
        middle = text.index(TEXT, at)
        end = text.index(END, middle)
        begin = middle + len(TEXT)
        yield unescape(text[at + len(BEGIN) : middle]), unescape(text[begin:end]), begin, end
        at = end + len(END)


def read_conversations(parts: DataFrame) -> DataFrame:
    """One row per conversation: conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    From the stored parts alone: turns are parsed and unescaped, the loss text is what the spans cover. A
    conversation's parts are read in order and one at a time, so its length does not matter.
    """
    ship_package(parts.sparkSession)
    shape = pa.schema(
        [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64())]
        + [("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]
    )

    def run(batches):
        conv, state = (), None

        def row():
            n, turns, chars, loss, formatted = state
            return {
                "conv_id": conv[0], "n_turns": n, "turns_sha256": turns.hexdigest(), "loss_chars": chars,
                "loss_sha256": loss.hexdigest(), "formatted_chars": formatted,
            }

        for batch in batches:
            out = []
            for part in batch.to_pylist():
                if (part["conv_id"],) != conv:
                    if state:
                        out.append(row())
                    conv, state = (part["conv_id"],), [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                for role, text, _, _ in parse_turns(part["text"]):
                    state[0] += 1
                    state[1].update(f"{role}\n{text}\n".encode())
                for begin, end in part["spans"]:
                    text = unescape(part["text"][begin:end])
                    state[2] += len(text)
                    state[3].update(text.encode())
                state[4] += len(part["text"])
            yield pa.RecordBatch.from_pylist(out, schema=shape)
        if state:
            yield pa.RecordBatch.from_pylist([row()], schema=shape)

    rows = parts.select("conv_id", "part", "text", "spans").repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return rows.mapInArrow(
        run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
