"""Operator 8: chat formatting by a compiled template language.

A template is parsed into a syntax tree, constants are folded, and the tree becomes Python closures that yield the rendered
text piece by piece, with generation markers telling what a model is to learn. The language is sandboxed: names come from the
context, fields from messages, there are no calls beyond the named filters, and nothing of Python can be reached.

    {{ expression }}   {% for m in messages %} {% endfor %}   {% if x %} {% elif y %} {% else %} {% endif %}
    {% set name = expression %}   {% generation %} {% endgeneration %}   {# comment #}
    'text' 12 true false none  name.field  loop.index loop.first   == != in and or not + ~  | escape trim upper lower length

The default TEMPLATE marks turns with control strings. escape puts a backslash before each control string and each backslash
inside a text, so that a reader finds the marks again and gets the texts back exactly, whatever they contain.

A task reads the turns of its conversations in order and never holds more than a turn and a part of the output.

Defined results: null texts and roles count as empty; turns are ordered by turn, then role, then text (nulls first), so ties
and repeated rows have one order and each is a turn; a null conv_id is a conversation; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CONTROLS = ("[INST]", "[/INST]", "[ROLE]", "[/ROLE]", "</s>")
TEMPLATE = (
    "{# turns of the two sides, then any other role by name #}"
    "{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{{ '<' + '/s>' }}"
    "{% else %}[ROLE]{{ m.role | escape }}[/ROLE]{{ m.text | escape }}</s>{% endif %}"
    "{% endfor %}"
)
_MARK = re.compile(r"\\|" + "|".join(map(re.escape, CONTROLS)))
_SCAN = re.compile(r"\\(?:\\|" + "|".join(map(re.escape, CONTROLS)) + ")|(" + "|".join(map(re.escape, CONTROLS)) + ")")
_ESCAPED = re.compile(r"\\(\\|" + "|".join(map(re.escape, CONTROLS)) + ")")


def escape(text: str) -> str:
    return _MARK.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: m[1], text)


class TemplateError(ValueError):
    pass


@dataclass
class Node:
    """kind: text, out, for, if, set, generation; const, name, field, unary, binary, filter."""

    kind: str
    value: object = None
    parts: list = field(default_factory=list)


_PIECE = re.compile(r"\{#.*?#\}|\{\{(.*?)\}\}|\{%-?\s*(.*?)\s*-?%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\d+)|([A-Za-z][A-Za-z_0-9]*)|(==|!=|[|.+~()]))")
FILTERS: dict[str, Callable] = {"escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower, "length": len}
_CONSTANTS = {"true": True, "false": False, "none": None}


class _Expression:
    """Recursive descent: or, and, not, comparison, sum, filter, field, atom."""

    def __init__(self, source: str):
        self.tokens, at = [], 0
        while source[at:].strip():
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"can't read {source[at:]!r}")
            self.tokens.append(next((k, g) for k, g in zip(("text", "number", "name", "sign"), m.groups(), strict=True) if g is not None))
            at = m.end()
        self.at = 0

    def next(self, *values: str) -> str | None:
        if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" and self.tokens[self.at][1] in values:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def whole(self) -> Node:
        out = self.either()
        if self.at != len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _chain(self, below: Callable[[], Node], *signs: str) -> Node:
        out = below()
        while sign := self.next(*signs):
            out = Node("binary", sign, [out, below()])
        return out

    def either(self) -> Node:
        return self._chain(lambda: self._chain(self.negated, "and"), "or")

    def negated(self) -> Node:
        return Node("unary", "not", [self.negated()]) if self.next("not") else self._chain(lambda: self._chain(self.filtered, "+", "~"), "==", "!=", "in")

    def filtered(self) -> Node:
        out = self.atom()
        while sign := self.next("|", "."):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or sign == "|" and name not in FILTERS:
                raise TemplateError(f"no such {'filter' if sign == '|' else 'field'}: {name!r}")
            self.at += 1
            out = Node("filter" if sign == "|" else "field", name, [out])
        return out

    def atom(self) -> Node:
        if self.next("("):
            out = self.either()
            if not self.next(")"):
                raise TemplateError("a ) is missing")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Node("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "number":
            return Node("const", int(value))
        if kind == "name" and value not in ("and", "or", "not", "in"):
            return Node("const", _CONSTANTS[value]) if value in _CONSTANTS else Node("name", value)
        raise TemplateError(f"unexpected {value!r}")


def parse(template: str) -> list[Node]:
    """The syntax tree: a list of statements."""
    root: list[Node] = []
    stack: list[tuple[str, list[Node], Node | None]] = [("", root, None)]
    at = 0
    for m in _PIECE.finditer(template):
        if m.start() > at:
            stack[-1][1].append(Node("text", template[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            stack[-1][1].append(Node("out", None, [_Expression(m[1]).whole()]))
        elif m[2] is not None:
            word, _, rest = m[2].partition(" ")
            if word == "for":
                f = re.fullmatch(r"([A-Za-z]\w*)\s+in\s+(.+)", rest, re.S)
                if not f:
                    raise TemplateError("for name in expression")
                node = Node("for", f[1], [_Expression(f[2]).whole(), []])
                stack[-1][1].append(node)
                stack.append(("for", node.parts[1], node))
            elif word in ("if", "generation"):
                node = Node("if", None, [[_Expression(rest).whole(), []]]) if word == "if" else Node("generation", None, [[]])
                stack[-1][1].append(node)
                stack.append((word, node.parts[0][1] if word == "if" else node.parts[0], node))
            elif word in ("elif", "else") and stack[-1][0] == "if":
                _, _, node = stack.pop()
                branch = [_Expression(rest).whole() if word == "elif" else Node("const", True), []]
                node.parts.append(branch)
                stack.append(("if", branch[1], node))
            elif word == "set":
                name, eq, value = rest.partition("=")
                if not eq or not re.fullmatch(r"[A-Za-z]\w*", name.strip()):
                    raise TemplateError("set name = expression")
                stack[-1][1].append(Node("set", name.strip(), [_Expression(value).whole()]))
            elif word.startswith("end") and stack[-1][0] == word[3:]:
                stack.pop()
            else:
                raise TemplateError(f"unexpected {word!r}")
    if at < len(template):
        stack[-1][1].append(Node("text", template[at:]))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} isn't closed")
    return root


def _apply(sign: str, a, b):
    if sign == "==":
        return a == b
    if sign == "!=":
        return a != b
    if sign == "in":
        return a in b
    return a + b if sign == "+" and isinstance(a, int) and isinstance(b, int) else f"{_text(a)}{_text(b)}"


def _text(x) -> str:
    return "" if x is None else str(x)


def _fold(n: Node) -> Node:
    """An expression with its constant parts computed."""
    parts = [_fold(p) for p in n.parts]
    if n.kind in ("unary", "filter", "binary") and all(p.kind == "const" for p in parts):
        return Node("const", _expression(Node(n.kind, n.value, parts))({}))
    if n.kind == "binary" and n.value in ("and", "or") and parts[0].kind == "const":
        return parts[1] if bool(parts[0].value) == (n.value == "and") else parts[0]
    return Node(n.kind, n.value, parts)


def fold(block: list[Node]) -> list[Node]:
    """A tree with constants folded, branches that can't be taken left out, and neighbouring texts joined."""
    out: list[Node] = []

    def put(n: Node) -> None:
        if n.kind == "text" and out and out[-1].kind == "text":
            out[-1] = Node("text", out[-1].value + n.value)
        elif n.kind != "text" or n.value:
            out.append(n)

    for n in block:
        if n.kind == "out":
            e = _fold(n.parts[0])
            put(Node("text", _text(e.value)) if e.kind == "const" else Node("out", None, [e]))
        elif n.kind == "for":
            put(Node("for", n.value, [_fold(n.parts[0]), fold(n.parts[1])]))
        elif n.kind == "set":
            put(Node("set", n.value, [_fold(n.parts[0])]))
        elif n.kind == "generation":
            put(Node("generation", None, [fold(n.parts[0])]))
        elif n.kind == "if":
            branches = []
            for test, body in n.parts:
                test = _fold(test)
                if test.kind != "const" or test.value:
                    branches.append([test, fold(body)])
                if test.kind == "const" and test.value:
                    break
            if branches and branches[0][0].kind == "const":
                for x in branches[0][1]:
                    put(x)
            elif branches:
                put(Node("if", None, branches))
        else:
            put(n)
    return out


def _expression(n: Node) -> Callable[[dict], object]:
    if n.kind == "const":
        return lambda c, v=n.value: v
    if n.kind == "name":
        return lambda c, k=n.value: c.get(k)
    of = [_expression(p) for p in n.parts]
    if n.kind == "field":

        def get(c: dict):
            x = of[0](c)
            return x.get(n.value) if type(x) is dict else None

        return get
    if n.kind == "filter":
        f = FILTERS[n.value]
        return lambda c: f(_text(of[0](c)))
    if n.kind == "unary":
        return lambda c: not of[0](c)
    if n.value == "and":
        return lambda c: of[0](c) and of[1](c)
    if n.value == "or":
        return lambda c: of[0](c) or of[1](c)
    return lambda c, s=n.value: _apply(s, of[0](c), of[1](c))


Piece = tuple[str, bool]  # rendered text, whether it is to be learned


def _block(nodes: list[Node], learned: bool = False) -> Callable[[dict], Iterator[Piece]]:
    steps = [_statement(n, learned) for n in nodes]

    def run(c: dict) -> Iterator[Piece]:
        for s in steps:
            yield from s(c)

    return run


def _statement(n: Node, learned: bool) -> Callable[[dict], Iterable[Piece]]:
    if n.kind == "text":
        return lambda c, out=((n.value, learned),): out
    if n.kind == "out":
        e = _expression(n.parts[0])
        return lambda c: ((_text(e(c)), learned),)
    if n.kind == "generation":
        return _block(n.parts[0], True)
    if n.kind == "set":
        e = _expression(n.parts[0])

        def put(c: dict) -> Iterable[Piece]:
            c[n.value] = e(c)
            return ()

        return put
    if n.kind == "if":
        branches = [(_expression(t), _block(b, learned)) for t, b in n.parts]

        def choose(c: dict) -> Iterable[Piece]:
            return next((body(c) for test, body in branches if test(c)), ())

        return choose
    items, body = _expression(n.parts[0]), _block(n.parts[1], learned)

    def loop(c: dict) -> Iterator[Piece]:
        for i, x in enumerate(items(c) or ()):
            yield from body({**c, n.value: x, "loop": {"index": i + 1, "first": i == 0}})

    return loop


def compile_template(template: str) -> Callable[[Iterable[dict]], Iterator[Piece]]:
    """A function from messages (any iterable of dicts, read once) to rendered pieces."""
    run = _block(fold(parse(template)))
    return lambda messages: run({"messages": messages})


#: Characters after which a part of a conversation's output is closed.
PART = 1 << 16
FORMATTED = "conv_id long, part int, text string, starts array<int>, ends array<int>"
_FORMATTED = pa.schema([("conv_id", pa.int64()), ("part", pa.int32()), ("text", pa.string()), ("starts", pa.list_(pa.int32())), ("ends", pa.list_(pa.int32()))])


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """turns (conv_id, turn, role, text) to parts of formatted conversations, in order, with the spans of a part to be learned."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        out: dict[str, list] = {f.name: [] for f in _FORMATTED}
        held = 0

        def messages() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "role", "text")], strict=True)

        for key, own in groupby(messages(), key=lambda r: r[0]):
            part, size, text, starts, ends = 0, 0, [], [], []
            for piece, learned in render({"role": r[1], "text": r[2]} for r in own):
                if learned and piece:
                    starts.append(size)
                    ends.append(size + len(piece))
                text.append(piece)
                size += len(piece)
                if size >= PART:
                    for k, v in zip(out, (key, part, "".join(text), starts, ends), strict=True):
                        out[k].append(v)
                    held, part, size, text, starts, ends = held + size, part + 1, 0, [], [], []
                if held >= 16 * PART:
                    yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)
                    out, held = {f.name: [] for f in _FORMATTED}, 0
            if text or not part:
                for k, v in zip(out, (key, part, "".join(text), starts, ends), strict=True):
                    out[k].append(v)
                held += size
        if out["text"]:
            yield pa.RecordBatch.from_pydict(out, schema=_FORMATTED)

    empty = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    rows = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(run, FORMATTED)


class Reader:
    """Turns and learned texts of one conversation, read back part by part."""

    def __init__(self):
        self.rest = ""
        self.n_turns = self.loss_chars = self.chars = 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, text: str, spans: list[tuple[int, int]]) -> None:
        self.chars += len(text)
        for a, b in spans:
            plain = unescape(text[a:b])
            self.loss_chars += len(plain)
            self.loss.update(plain.encode())
        self.rest = text = self.rest + text
        marks = [(m.start(), m[1]) for m in _SCAN.finditer(text) if m[1]]
        at = k = 0
        while True:
            first = marks[k][1] if k < len(marks) and marks[k][0] == at else ""
            need = {"[INST]": 2, "[ROLE]": 3}.get(first, 1)
            if k + need > len(marks):
                break
            last = marks[k + need - 1]
            if first == "[INST]":
                self._turn("user", text[at + 7 : last[0] - 1])
            elif first == "[ROLE]":
                self._turn(unescape(text[at + 6 : marks[k + 1][0]]), text[marks[k + 1][0] + 7 : last[0]])
            else:
                self._turn("assistant", text[at : last[0]])
            at, k = last[0] + len(last[1]), k + need
        self.rest = text[at:]

    def _turn(self, role: str, text: str) -> None:
        self.n_turns += 1
        self.turns.update(f"{role}\n{unescape(text)}\n".encode())


def read_back(parts: DataFrame) -> DataFrame:
    """What the formatted parts hold, per conversation; parts as format_conversations() returns them, in its order."""
    names = [("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[tuple]:
            for b in batches:
                yield from zip(*[b.column(c).to_pylist() for c in ("conv_id", "text", "starts", "ends")], strict=True)

        out: dict[str, list] = {k: [] for k, _ in names}
        for key, own in groupby(rows(), key=lambda r: r[0]):
            r = Reader()
            for _, text, starts, ends in own:
                r.add(text, list(zip(starts, ends, strict=True)))
            if r.rest:
                raise ValueError(f"conversation {key} doesn't end with a mark")
            for k, v in zip(out, (key, r.n_turns, r.turns.hexdigest(), r.loss_chars, r.loss.hexdigest(), r.chars), strict=True):
                out[k].append(v)
            if len(out["conv_id"]) >= 4096:
                yield pa.RecordBatch.from_pydict(out, schema=pa.schema(names))
                out = {k: [] for k, _ in names}
        if out["conv_id"]:
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema(names))

    return parts.mapInArrow(run, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
