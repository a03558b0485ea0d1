"""Operator 2, chat formatting: a template compiler.

A sandboxed template language is parsed to a syntax tree, constants are folded, and the tree becomes nested Python
closures; rendering runs no interpreter and no ``eval``. Templates can only read the variables they are given:

    {{ expression }}                      output
    {% for x in expression %} ... {% endfor %}       with loop.index0, loop.first
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}         marks what the model should have said (the loss mask)

Expressions: strings, integers, true, false, none, names, a.b and a['b'] on mappings, + (joins), ==, !=, and, or, not,
parentheses, and filters ``x | f`` from a fixed table. Rendering is a stream of pieces, so that a conversation of any
length is formatted in bounded memory.

``CHAT_TEMPLATE`` marks turns with control strings. Where a role or text holds one, ``escape`` puts a backslash after
its first character, or one more where there are some, which ``unescape`` takes away; nothing else is changed, so
reading back gives every role and text exactly.

Defined results: null role or text count as empty; turns that tie are ordered by role, then text; repeated rows are
turns of their own; rows with null conv_id are one conversation with a null id; an empty table gives no conversation;
further columns are ignored. A conversation's rows are streamed in order through one task and never held together: a
digest of an ordered text is one chain.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ringside.llm.arrays import lean
from ringside.llm.session import partitions, small_batches

CHAT_TEMPLATE = (
    "{% for m in messages %}<s>[INST]{{ m.role | escape }}[/INST]"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "</s>{{ '\\n' }}{% endfor %}"
)
CONTROL = r"s>|/s>|INST\]|/INST\]"
#: Characters of one segment of a formatted conversation.
SEGMENT = 1 << 20

Piece = tuple[str, bool]
Render = Callable[[dict, bool], Iterator[Piece]]
Value = Callable[[dict], Any]


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return re.sub(rf"([<\[])(\\*)(?={CONTROL})", r"\1\\\2", text)


def unescape(text: str) -> str:
    return re.sub(rf"([<\[])\\(\\*)(?={CONTROL})", r"\1\2", text)


FILTERS: dict[str, Callable[[Any], Any]] = {"escape": lambda x: escape(str(x)), "trim": lambda x: str(x).strip(), "upper": lambda x: str(x).upper(), "lower": lambda x: str(x).lower(), "length": len}
TOKEN = re.compile(r"\s*(?:(\d+)|('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\w+)|(==|!=|[+.|()\[\]]))")
ESCAPES = {"n": "\n", "t": "\t"}


@dataclass(frozen=True)
class Node:
    """kind: const, name, item, add, eq, ne, and, or, not, filter; out, for, if, generation, body."""

    kind: str
    value: Any = None
    parts: tuple = ()


class Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str) -> None:
        self.tokens: list[tuple[str, str]] = []
        at = 0
        while source[at:].strip():
            if not (m := TOKEN.match(source, at)):
                raise TemplateError(f"bad expression: {source!r}")
            kind = ("int", "str", "word", "op")[(m.lastindex or 1) - 1]
            self.tokens.append((kind, m[m.lastindex]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] in ("word", "op") else ""

    def take(self, *what: str) -> bool:
        if self.peek() in what:
            self.at += 1
            return True
        return False

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"{what} expected")

    def whole(self) -> Node:
        node = self.either()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]}")
        return node

    def either(self) -> Node:
        node = self.both()
        while self.take("or"):
            node = Node("or", parts=(node, self.both()))
        return node

    def both(self) -> Node:
        node = self.negation()
        while self.take("and"):
            node = Node("and", parts=(node, self.negation()))
        return node

    def negation(self) -> Node:
        return Node("not", parts=(self.negation(),)) if self.take("not") else self.comparison()

    def comparison(self) -> Node:
        node = self.sum()
        while self.peek() in ("==", "!="):
            kind = "eq" if self.take("==") else "ne"
            self.take("!=")
            node = Node(kind, parts=(node, self.sum()))
        return node

    def sum(self) -> Node:
        node = self.filtered()
        while self.take("+"):
            node = Node("add", parts=(node, self.filtered()))
        return node

    def filtered(self) -> Node:
        node = self.atom()
        while self.peek() in ("|", ".", "["):
            if self.take("|"):
                if (name := self.word()) not in FILTERS:
                    raise TemplateError(f"no filter {name}")
                node = Node("filter", name, (node,))
            elif self.take("."):
                node = Node("item", parts=(node, Node("const", self.word())))
            else:
                self.need("[")
                node = Node("item", parts=(node, self.either()))
                self.need("]")
        return node

    def word(self) -> str:
        if self.at >= len(self.tokens) or self.tokens[self.at][0] != "word":
            raise TemplateError("a name expected")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def atom(self) -> Node:
        if self.take("("):
            node = self.either()
            self.need(")")
            return node
        if self.at >= len(self.tokens):
            raise TemplateError("an expression ends early")
        kind, text = self.tokens[self.at]
        self.at += 1
        if kind == "int":
            return Node("const", int(text))
        if kind == "str":
            return Node("const", re.sub(r"\\(.)", lambda m: ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "word":
            constants = {"true": True, "false": False, "none": None}
            return Node("const", constants[text]) if text in constants else Node("name", text)
        raise TemplateError(f"unexpected {text}")


def parse(source: str) -> Node:
    """A template's syntax tree."""
    parts = re.split(r"(\{\{.*?\}\}|\{%.*?%\})", source, flags=re.S)
    at = 0

    def body(*ends: str) -> tuple[Node, str, str]:
        nonlocal at
        nodes: list[Node] = []
        while at < len(parts):
            part = parts[at]
            at += 1
            if part.startswith("{{"):
                nodes.append(Node("out", parts=(Expression(part[2:-2]).whole(),)))
            elif part.startswith("{%"):
                word, _, rest = part[2:-2].strip().partition(" ")
                if word in ends:
                    return Node("body", parts=tuple(nodes)), word, rest
                nodes.append(statement(word, rest))
            elif part:
                nodes.append(Node("out", parts=(Node("const", part),)))
        if ends:
            raise TemplateError(f"{ends[-1]} missing")
        return Node("body", parts=tuple(nodes)), "", ""

    def statement(word: str, rest: str) -> Node:
        if word == "for":
            if not (m := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest.strip(), re.S)):
                raise TemplateError(f"bad for: {rest}")
            return Node("for", m[1], (Expression(m[2]).whole(), body("endfor")[0]))
        if word == "generation":
            return Node("generation", parts=(body("endgeneration")[0],))
        if word == "if":
            test = Expression(rest).whole()
            then, end, more = body("elif", "else", "endif")
            other = statement("if", more) if end == "elif" else body("endif")[0] if end == "else" else Node("body")
            return Node("if", parts=(test, then, other))
        raise TemplateError(f"unknown statement {word}")

    return body()[0]


OPERATIONS: dict[str, Callable[..., Any]] = {
    "add": lambda a, b: a + b,
    "eq": lambda a, b: a == b,
    "ne": lambda a, b: a != b,
    "and": lambda a, b: a and b,
    "or": lambda a, b: a or b,
    "not": lambda a: not a,
}


def fold(node: Node) -> Node:
    """The same tree with constant expressions computed, decided branches chosen and neighbouring output joined."""
    parts = tuple(fold(p) for p in node.parts)
    constant = all(p.kind == "const" for p in parts)
    if node.kind in OPERATIONS and constant:
        return Node("const", OPERATIONS[node.kind](*(p.value for p in parts)))
    if node.kind == "filter" and constant:
        return Node("const", FILTERS[node.value](parts[0].value))
    if node.kind == "if" and parts[0].kind == "const":
        return parts[1] if parts[0].value else parts[2]
    if node.kind == "body":
        flat: list[Node] = []
        for p in parts:
            for q in p.parts if p.kind == "body" else (p,):
                both = (*(flat[-1:]), q)
                if len(both) == 2 and all(x.kind == "out" and x.parts[0].kind == "const" for x in both):
                    flat[-1] = Node("out", parts=(Node("const", "".join(shown(x.parts[0].value) for x in both)),))
                else:
                    flat.append(q)
        parts = tuple(flat)
    return Node(node.kind, node.value, parts)


def shown(value: Any) -> str:
    return "" if value is None else str(value)


def item(of: Any, key: Any) -> Any:
    """Sandboxed access: mappings only, never attributes of Python objects."""
    if not isinstance(of, dict):
        raise TemplateError("only mappings have items")
    return of.get(key)


def value_of(node: Node) -> Value:
    if node.kind == "const":
        return lambda env, v=node.value: v
    if node.kind == "name":
        return lambda env, name=node.value: env.get(name)
    inner = [value_of(p) for p in node.parts]
    if node.kind == "item":
        return lambda env, a=inner[0], b=inner[1]: item(a(env), b(env))
    if node.kind == "filter":
        return lambda env, f=FILTERS[node.value], a=inner[0]: f(a(env))
    if node.kind == "and":
        return lambda env, a=inner[0], b=inner[1]: a(env) and b(env)
    if node.kind == "or":
        return lambda env, a=inner[0], b=inner[1]: a(env) or b(env)
    if node.kind == "not":
        return lambda env, a=inner[0]: not a(env)
    return lambda env, f=OPERATIONS[node.kind], a=inner[0], b=inner[1]: f(a(env), b(env))


def render_of(node: Node) -> Render:
    if node.kind == "out":
        value = value_of(node.parts[0])

        def out(env: dict, marked: bool) -> Iterator[Piece]:
            yield shown(value(env)), marked

        return out
    if node.kind == "body":
        steps = [render_of(p) for p in node.parts]

        def sequence(env: dict, marked: bool) -> Iterator[Piece]:
            for step in steps:
                yield from step(env, marked)

        return sequence
    if node.kind == "generation":
        inside = render_of(node.parts[0])
        return lambda env, marked: inside(env, True)
    if node.kind == "if":
        test, then, other = value_of(node.parts[0]), render_of(node.parts[1]), render_of(node.parts[2])
        return lambda env, marked: (then if test(env) else other)(env, marked)
    over, each = value_of(node.parts[0]), render_of(node.parts[1])

    def loop(env: dict, marked: bool, name: str = node.value) -> Iterator[Piece]:
        for i, x in enumerate(over(env) or ()):
            yield from each(env | {name: x, "loop": {"index0": i, "first": i == 0}}, marked)

    return loop


def compile_template(source: str) -> Callable[..., Iterator[Piece]]:
    """A renderer: called with the template's variables, it yields (text, under the loss mask) pieces."""
    render = render_of(fold(parse(source)))
    return lambda **variables: render(variables, False)


def conversations_of(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Each conversation with a lazy row of its messages, from rows sorted by conversation and turn."""
    rows = ({"id": i, "role": r or "", "text": t or ""} for b in batches for i, r, t in zip(*(c.to_pylist() for c in b.columns), strict=True))
    ahead = next(rows, None)

    def own(name: int | None) -> Iterator[dict]:
        nonlocal ahead
        while ahead is not None and ahead["id"] == name:
            row, ahead = ahead, next(rows, None)
            yield row

    while ahead is not None:
        name = ahead["id"]
        messages = own(name)
        yield name, messages
        for _ in messages:
            continue


def _format(template: str) -> Callable:
    """Formatted conversations in segments: conv_id, segment, text, and the loss mask's spans in it."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        held: list[tuple] = []
        size = 0

        def batch() -> pa.RecordBatch:
            ids, numbers, texts, masks = zip(*held, strict=True)
            spans = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            return pa.record_batch([pa.array(ids, pa.int64()), pa.array(numbers, pa.int32()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in m] for m in masks], spans)], ["conv_id", "segment", "text", "loss"])

        for name, messages in conversations_of(batches):
            number, pieces, mask, at = 0, [], [], 0
            for text, marked in render(messages=messages):
                pieces.append(text)
                if marked:
                    mask.append((at, at + len(text)))
                at += len(text)
                if at >= SEGMENT:
                    held.append((name, number, "".join(pieces), mask))
                    size += at
                    number, pieces, mask, at = number + 1, [], [], 0
                if size >= SEGMENT:
                    yield batch()
                    held, size = [], 0
            held.append((name, number, "".join(pieces), mask))
            size += at
            if size >= SEGMENT or len(held) >= 1024:
                yield batch()
                held, size = [], 0
        if held:
            yield batch()

    return run


TURN = re.compile(r"<s>\[INST\](.*?)\[/INST\](.*?)</s>\n", re.S)


class Reader:
    """Reads one formatted conversation back, segment by segment."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n_turns, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self.rest = self.marked = ""

    def take(self, text: str, spans: list[dict]) -> None:
        self.chars += len(text)
        for span in spans:
            said = unescape(text[span["start"] : span["end"]])
            self.loss_chars += len(said)
            self.loss.update(said.encode())
        self.rest += text
        end = 0
        for turn in TURN.finditer(self.rest):
            if turn.start() != end:
                raise ValueError("a formatted conversation has text outside its turns")
            role, said = unescape(turn[1]), unescape(turn[2])
            self.turns.update(f"{role}\n{said}\n".encode())
            self.n_turns += 1
            end = turn.end()
        self.rest = self.rest[end:]

    def row(self, name: int | None) -> tuple:
        if self.rest:
            raise ValueError("a formatted conversation ends inside a turn")
        return name, self.n_turns, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


READ = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def _read_back(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
    names = [x.split()[0] for x in READ.split(", ")]
    rows: list[tuple] = []
    reader, current = None, None
    for batch in batches:
        for name, number, text, spans in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if number == 0:
                if reader is not None:
                    rows.append(reader.row(current))
                reader, current = Reader(), name
            reader.take(text, spans)
        if len(rows) >= 4096:
            yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)
            rows = []
    if reader is not None:
        rows.append(reader.row(current))
    if rows:
        yield pa.record_batch([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)


def format_conversations(conversations: DataFrame, template: str = CHAT_TEMPLATE) -> DataFrame:
    """conv_id, segment (from 0), text, loss (spans of the text under the loss mask), a conversation's rows in order.

    A segment ends after the piece that fills it, so short conversations have one, and no mask crosses its end.
    """
    compile_template(template)
    small_batches(conversations.sparkSession)
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", *(F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition(partitions(conversations.sparkSession), "conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    return rows.select("conv_id", "role", "text").mapInArrow(lean(_format(template)), "conv_id long, segment int, text string, loss array<struct<start:int,end:int>>")


def read_back(formatted: DataFrame) -> DataFrame:
    """Digests of the turns and of what the loss mask covers, parsed from formatted conversations as they come."""
    return formatted.mapInArrow(lean(_read_back), READ)
