"""Chat formatting by a template compiler.

A small sandboxed template language is tokenised, parsed into a syntax tree, simplified
(constant expressions are computed, constant branches chosen, neighbouring texts
joined), and compiled into Python closures. Templates see only the values given to
them: there are no attributes of Python objects, no calls but the filters listed here,
and loops only over the messages. Rendering goes turn by turn through a generator, so
that a conversation of any length is formatted in bounded memory.

    text {{ expression }} {% if e %} {% elif e %} {% else %} {% endif %}
    {% for message in messages %} {% endfor %}      {% set name = e %}
    {% generation %} {% endgeneration %}            what is rendered here is under the loss mask
    {# comment #}        a dash inside a mark trims white space on that side

Expressions: strings, integers, true, false, none, names, message.role and
message['role'], loop.first, loop.index, ==, !=, <, >, <=, >=, +, ~, %, in, not, and,
or, brackets, and filters: trim, upper, lower, escape, length, default(x).

The filter `escape` makes control strings inside texts ordinary: in `<` followed by any
number of `!` and a `|`, one `!` is put behind the `<`, so that no text holds `<|`, the
start of every control string; taking one `!` away undoes it. Roles are also kept on one
line (line feeds, carriage returns and `%` are percent-encoded).

Edge cases: a null text or role is empty; rows with a null conv_id make a conversation
of their own (id null); turns are taken in the order of turn (nulls first), ties by role
and text; repeated rows are repeated turns; other columns are ignored; an empty table
gives no rows.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as C

TEMPLATE = (
    "{% for message in messages %}"
    "{{ '<|im_' ~ 'start|>' }}{{ message.role | role }}{{ '\n' }}"
    "{% if message.role == 'assistant' %}{% generation %}{{ message.text | escape }}{% endgeneration %}"
    "{% else %}{{ message.text | escape }}{% endif %}"
    "{{ '<|im_' ~ 'end|>' ~ '\n' }}"
    "{% endfor %}"
)
RESULT = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class TemplateError(ValueError):
    """The template doesn't parse, or asks for something that the sandbox doesn't have."""


def escape(text: str) -> str:
    return re.sub(r"<(!*)\|", r"<!\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<!(!*)\|", r"<\1|", text)


def role_line(role: str) -> str:
    return escape(role.replace("%", "%25").replace("\n", "%0A").replace("\r", "%0D"))


def role_of(line: str) -> str:
    return unescape(line).replace("%0D", "\r").replace("%0A", "\n").replace("%25", "%")


FILTERS: dict[str, Callable] = {
    "trim": lambda x: str(x).strip(),
    "upper": lambda x: str(x).upper(),
    "lower": lambda x: str(x).lower(),
    "length": len,
    "escape": escape,
    "role": role_line,
    "default": lambda x, y: y if x is None or x == "" else x,
}
BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, ">": lambda a, b: a > b,
    "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "+": lambda a, b: a + b, "%": lambda a, b: a % b,
    "~": lambda a, b: shown(a) + shown(b), "in": lambda a, b: a in b,
}
LEVELS = (("==", "!=", "<=", ">=", "<", ">", "in"), ("+", "~"), ("%",))
MARK = re.compile(r"\{\{-?(.*?)-?\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.S)
LEXEME = re.compile(r"\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~%|().,\[\]=]))")


def shown(x: Any) -> str:
    return "" if x is None else str(x).lower() if isinstance(x, bool) else str(x)


# -- syntax tree: tuples (kind, ...) ------------------------------------------------


class Parser:
    """Expressions by descent; kinds: const, name, field, not, and, or, op, filter."""

    def __init__(self, source: str):
        self.items: list[tuple[str, str]] = []
        at, source = 0, source.strip()
        while at < len(source):
            if not (m := LEXEME.match(source, at)):
                raise TemplateError(f"can't read {source[at:]!r}")
            self.items.append((m.lastgroup or "", m[m.lastgroup or 0]))
            at = m.end()
        self.at = 0

    def peek(self) -> str:
        return self.items[self.at][1] if self.at < len(self.items) else ""

    def take(self, *wanted: str) -> str | None:
        if self.at < len(self.items) and self.items[self.at][0] != "str" and self.peek() in wanted:
            self.at += 1
            return self.items[self.at - 1][1]
        return None

    def need(self, wanted: str) -> None:
        if not self.take(wanted):
            raise TemplateError(f"{wanted!r} expected before {self.peek()!r}")

    def name(self) -> str:
        if self.at >= len(self.items) or self.items[self.at][0] != "name":
            raise TemplateError(f"a name expected before {self.peek()!r}")
        self.at += 1
        return self.items[self.at - 1][1]

    def whole(self) -> tuple:
        tree = self.either()
        if self.at < len(self.items):
            raise TemplateError(f"unexpected {self.peek()!r}")
        return tree

    def either(self) -> tuple:
        tree = self.both()
        while self.take("or"):
            tree = ("or", tree, self.both())
        return tree

    def both(self) -> tuple:
        tree = self.negated()
        while self.take("and"):
            tree = ("and", tree, self.negated())
        return tree

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.binary(0)

    def binary(self, level: int) -> tuple:
        if level == len(LEVELS):
            return self.filtered()
        tree = self.binary(level + 1)
        while op := self.take(*LEVELS[level]):
            tree = ("op", op, tree, self.binary(level + 1))
        return tree

    def filtered(self) -> tuple:
        tree = self.atom()
        while self.take("|"):
            name, args = self.name(), []
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.either())
                    self.take(",")
            tree = ("filter", name, tree, *args)
        return tree

    def atom(self) -> tuple:
        if self.take("("):
            tree = self.either()
            self.need(")")
        elif self.at < len(self.items) and self.items[self.at][0] in ("str", "int"):
            kind, text = self.items[self.at]
            self.at += 1
            escapes = {"n": "\n", "t": "\t", "r": "\r"}
            tree = ("const", int(text) if kind == "int" else re.sub(r"\\(.)", lambda m: escapes.get(m[1], m[1]), text[1:-1], flags=re.S))
        else:
            name = self.name()
            tree = ("const", {"true": True, "false": False, "none": None}[name]) if name in ("true", "false", "none") else ("name", name)
        while mark := self.take(".", "["):
            if mark == ".":
                tree = ("field", tree, self.name())
            else:
                key = self.either()
                self.need("]")
                if key[0] != "const" or not isinstance(key[1], str):
                    raise TemplateError("a field needs a constant name")
                tree = ("field", tree, key[1])
        return tree


def parse(template: str) -> list[tuple]:
    """Nodes: text, put, if, for, set, generation."""
    marks: list[tuple[str, str]] = []
    at = 0
    for m in MARK.finditer(template):
        before = template[at : m.start()]
        if marks and marks[-1][0] == "trim":
            marks.pop()
            before = before.lstrip()
        marks.append(("text", before.rstrip() if template[m.start() + 2] == "-" else before))
        if m[1] is not None:
            marks.append(("put", m[1]))
        elif m[2] is not None:
            marks.append(("tag", m[2].strip()))
        if template[m.end() - 3] == "-":
            marks.append(("trim", ""))
        at = m.end()
    rest = template[at:]
    if marks and marks[-1][0] == "trim":
        marks.pop()
        rest = rest.lstrip()
    marks.append(("text", rest))
    where = iter(marks)

    def body(ends: tuple[str, ...]) -> tuple[list[tuple], str, str]:
        out: list[tuple] = []
        for kind, source in where:
            if kind == "text":
                out.append(("text", source))
            elif kind == "put":
                out.append(("put", Parser(source).whole()))
            else:
                word, _, more = source.partition(" ")
                if word in ends:
                    return out, word, more
                if word == "if":
                    out.append(branch(more))
                elif word == "for":
                    p = Parser(more)
                    name = p.name()
                    p.need("in")
                    if p.name() != "messages":
                        raise TemplateError("loops go over messages only")
                    out.append(("for", name, body(("endfor",))[0]))
                elif word == "set":
                    p = Parser(more)
                    name = p.name()
                    p.need("=")
                    out.append(("set", name, p.whole()))
                elif word == "generation":
                    out.append(("generation", body(("endgeneration",))[0]))
                else:
                    raise TemplateError(f"unknown tag {source!r}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return out, "", ""

    def branch(condition: str) -> tuple:
        test = Parser(condition).whole()
        then, word, more = body(("elif", "else", "endif"))
        other: list[tuple] = []
        if word == "elif":
            other = [branch(more)]
        elif word == "else":
            other = body(("endif",))[0]
        return ("if", test, then, other)

    return body(())[0]


def fold(tree: tuple) -> tuple:
    """An expression with its constant parts computed."""
    kind = tree[0]
    if kind in ("const", "name"):
        return tree
    if kind == "field":
        return ("field", fold(tree[1]), tree[2])
    head = 2 if kind in ("op", "filter") else 1
    parts = [fold(x) for x in tree[head:]]
    new = (*tree[:head], *parts)
    if kind in ("and", "or") and parts[0][0] == "const":
        return parts[1] if bool(parts[0][1]) == (kind == "and") else parts[0]
    if all(p[0] == "const" for p in parts):
        try:
            return ("const", compiled(new)({}))
        except Exception as e:
            raise TemplateError(str(e)) from e
    return new


def simplify(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "put":
            node = ("put", fold(node[1]))
            if node[1][0] == "const":
                node = ("text", shown(node[1][1]))
        elif node[0] == "if":
            test = fold(node[1])
            then, other = simplify(node[2]), simplify(node[3])
            if test[0] == "const":
                for inner in then if test[1] else other:
                    join(out, inner)
                continue
            node = ("if", test, then, other)
        elif node[0] == "for":
            node = ("for", node[1], simplify(node[2]))
        elif node[0] == "set":
            node = ("set", node[1], fold(node[2]))
        elif node[0] == "generation":
            node = ("generation", simplify(node[1]))
        join(out, node)
    return out


def join(out: list[tuple], node: tuple) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


# -- closures -----------------------------------------------------------------------


def compiled(tree: tuple) -> Callable[[dict], Any]:
    """An expression as a closure over the names in scope."""
    kind = tree[0]
    if kind == "const":
        value = tree[1]
        return lambda scope: value
    if kind == "name":
        name = tree[1]

        def look(scope):
            if name not in scope:
                raise TemplateError(f"no name {name!r}")
            return scope[name]

        return look
    if kind == "field":
        owner, key = compiled(tree[1]), tree[2]

        def field(scope):
            value = owner(scope)
            if not isinstance(value, dict) or key not in value:
                raise TemplateError(f"no field {key!r}")
            return value[key]

        return field
    if kind == "not":
        inner = compiled(tree[1])
        return lambda scope: not inner(scope)
    if kind in ("and", "or"):
        a, b = compiled(tree[1]), compiled(tree[2])
        return (lambda scope: a(scope) and b(scope)) if kind == "and" else (lambda scope: a(scope) or b(scope))
    if kind == "op":
        f, a, b = BINARY[tree[1]], compiled(tree[2]), compiled(tree[3])
        return lambda scope: f(a(scope), b(scope))
    f, a, *more = FILTERS[tree[1]], *map(compiled, tree[2:])
    return lambda scope: f(a(scope), *[m(scope) for m in more])


Piece = tuple[str, bool]
Render = Callable[[dict], Iterator[Piece]]


def block(nodes: list[tuple], learnt: bool = False) -> Render:
    """Nodes as a closure that yields (text, under the loss mask)."""
    parts = [statement(n, learnt) for n in nodes]
    if len(parts) == 1:
        return parts[0]

    def run(scope):
        for p in parts:
            yield from p(scope)

    return run


def statement(node: tuple, learnt: bool) -> Render:
    kind = node[0]
    if kind == "text":
        piece = (node[1], learnt)

        def text(scope):
            yield piece

        return text
    if kind == "put":
        value = compiled(node[1])

        def put(scope):
            yield shown(value(scope)), learnt

        return put
    if kind == "if":
        test, then, other = compiled(node[1]), block(node[2], learnt), block(node[3], learnt)
        return lambda scope: then(scope) if test(scope) else other(scope)
    if kind == "set":
        name, new = node[1], compiled(node[2])

        def assign(scope):
            scope[name] = new(scope)
            return
            yield

        return assign
    if kind == "generation":
        return block(node[1], True)
    name, inner = node[1], block(node[2], learnt)

    def loop(scope):
        for k, message in enumerate(scope["messages"]):
            scope[name], scope["loop"] = message, {"first": k == 0, "index": k + 1}
            yield from inner(scope)

    return loop


class Template:
    """A compiled template; render() yields pieces of text with whether each is learnt."""

    def __init__(self, source: str = TEMPLATE):
        self.tree = simplify(parse(source))
        self.run = block(self.tree)

    def render(self, messages, **names: Any) -> Iterator[Piece]:
        return self.run({"messages": messages, **names})


def read_back(pieces: Iterator[Piece]) -> Iterator[tuple[str, str, str]]:
    """(role, text, learnt text) of each turn in formatted output, which comes piece by piece."""
    start, end = "<|im_start|>", "<|im_end|>\n"
    held, learnt, mask = "", "", ""
    for text, own in pieces:
        held += text
        learnt += text if own else ""
        if end in text:
            while (at := held.find(end)) >= 0:
                turn, held = held[:at], held[at + len(end) :]
                if not turn.startswith(start):
                    raise ValueError("formatted output without a start of turn")
                role, _, body = turn[len(start) :].partition("\n")
                mask, learnt = learnt, ""
                yield role_of(role), unescape(body), unescape(mask)
    if held:
        raise ValueError("formatted output ends within a turn")


def format_conversations(rows: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """Digests of the formatted output of conversations(conv_id, turn, role, text), read back from it: see RESULT.

    A task streams over its conversations in order, one turn at a time, so a conversation
    of any number of turns is neither gathered nor rendered as a whole."""
    C.ship(rows.sparkSession)
    order = [F.col("conv_id").asc_nulls_first(), F.col("turn").asc_nulls_first(), F.col("role").asc_nulls_first(), F.col("text").asc_nulls_first()]
    dealt = rows.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", "role", "text").repartition("conv_id").sortWithinPartitions(*order).select("conv_id", "role", "text")

    def formatted(batches):
        compiled_template = Template(template)

        def turns():
            for batch in batches:
                yield from zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)

        stream = turns()
        ahead = next(stream, None)
        out = []
        while ahead is not None:
            conv = ahead[0]

            def own():
                nonlocal ahead
                while ahead is not None and ahead[0] == conv:  # noqa: B023
                    yield {"role": ahead[1] or "", "text": ahead[2] or ""}
                    ahead = next(stream, None)

            chars = n = loss_chars = 0
            said, loss = hashlib.sha256(), hashlib.sha256()

            def counted():
                nonlocal chars
                for piece in compiled_template.render(own()):
                    chars += len(piece[0])
                    yield piece

            for role, text, learnt in read_back(counted()):
                n += 1
                said.update(f"{role}\n{text}\n".encode())
                loss.update(learnt.encode())
                loss_chars += len(learnt)
            out.append((conv, n, said.hexdigest(), loss_chars, loss.hexdigest(), chars))
            if len(out) == 4096:
                yield batch_of(out)
                out = []
        if out:
            yield batch_of(out)

    def batch_of(out):
        types = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"])

    return dealt.mapInArrow(formatted, RESULT)


def formatted_text(messages: list[dict], template: str = TEMPLATE) -> tuple[str, list[tuple[int, int]]]:
    """One conversation's formatted text, and its spans under the loss mask."""
    at, text, spans = 0, [], []
    for piece, learnt in Template(template).render(messages):
        if learnt and piece:
            spans.append((at, at + len(piece)))
        at += len(piece)
        text.append(piece)
    return "".join(text), spans
