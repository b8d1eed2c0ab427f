"""Chat formatting by a small compiled template language.

A template is text with ``{{ expression }}`` and ``{% tag %}``: ``for x in messages``,
``if``/``else``, ``generation`` and their ``end…``. Expressions have string literals,
names, ``name.field``, ``==``, ``!=``, ``not``, ``and``, ``or``, ``~`` (joining) and the
filters in ``FILTERS``. Nothing else can be reached: no calls, attributes or imports of
Python. The template is parsed to a syntax tree, constant parts are folded, and the
tree becomes nested Python closures that write a conversation's parts in order and note
where each generation starts and ends.

A conversation is formatted message by message as its sorted rows come by; only its own
output is held.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

START, END = "<|im_start|>", "<|im_end|>"
#: Marks turns; the loss mask covers the assistant's texts and nothing else.
TEMPLATE = (
    "{% for m in messages %}{{ '<|im_' ~ 'start|>' }}{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}{{ '<|im_end|>' }}\n{% endfor %}"
)


def escape(text: str) -> str:
    """No control string is left: every ``<|`` gets a backslash inside, every backslash another."""
    return text.replace("\\", "\\\\").replace("<|", "<\\|")


def escape_line(text: str) -> str:
    """As ``escape``, and on one line."""
    return escape(text).replace("\n", "\\n")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: "\n" if m[1] == "n" else m[1], text)


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "escape_line": escape_line, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}


class TemplateError(ValueError):
    """The template can't be read."""


@dataclass(frozen=True)
class Text:
    value: str


@dataclass(frozen=True)
class Name:
    name: str
    field: str | None = None


@dataclass(frozen=True)
class Apply:
    op: str
    args: tuple


@dataclass(frozen=True)
class Output:
    value: object


@dataclass(frozen=True)
class Block:
    """``if`` (test, then, else), ``for`` (name, source, body) or ``generation`` (body)."""

    kind: str
    parts: tuple


_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(r"\s*(?:('(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(\w+(?:\.\w+)?)|(==|!=|~|\||\(|\)))")
_STRING = re.compile(r"\\(.)", re.S)


def _tokens(source: str) -> list[str]:
    out, at, source = [], 0, source.rstrip()
    while at < len(source):
        if not (m := _TOKEN.match(source, at)):
            raise TemplateError(f"can't read {source[at:]!r}")
        out.append(m[1] or m[2] or m[3])
        at = m.end()
    return out


class _Expression:
    """Recursive descent: or, and, not, comparison, joining, filters, values."""

    def __init__(self, source: str):
        self.left = _tokens(source)

    def take(self, *wanted: str) -> str | None:
        return self.left.pop(0) if self.left and self.left[0] in wanted else None

    def read(self):
        value = self.either()
        if self.left:
            raise TemplateError(f"unexpected {self.left[0]!r}")
        return value

    def either(self):
        value = self.both()
        while self.take("or"):
            value = fold(Apply("or", (value, self.both())))
        return value

    def both(self):
        value = self.negated()
        while self.take("and"):
            value = fold(Apply("and", (value, self.negated())))
        return value

    def negated(self):
        return fold(Apply("not", (self.negated(),))) if self.take("not") else self.compared()

    def compared(self):
        value = self.joined()
        if op := self.take("==", "!="):
            return fold(Apply(op, (value, self.joined())))
        return value

    def joined(self):
        value = self.filtered()
        while self.take("~"):
            value = fold(Apply("~", (value, self.filtered())))
        return value

    def filtered(self):
        value = self.single()
        while self.take("|"):
            name = self.left.pop(0) if self.left else ""
            if name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            value = fold(Apply(name, (value,)))
        return value

    def single(self):
        if self.take("("):
            value = self.either()
            if not self.take(")"):
                raise TemplateError("a parenthesis is open")
            return value
        token = self.left.pop(0) if self.left else ""
        if token[:1] in ("'", '"'):
            return Text(_STRING.sub(lambda m: "\n" if m[1] == "n" else m[1], token[1:-1]))
        if not re.fullmatch(r"[A-Za-z_]\w*(\.[A-Za-z_]\w*)?", token) or token in ("or", "and", "not"):
            raise TemplateError(f"a value is expected, not {token!r}")
        return Name(*token.split("."))


_OPS: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "~": lambda a, b: a + b,
    "and": lambda a, b: a and b, "or": lambda a, b: a or b, "not": lambda a: not a, **FILTERS,
}


@dataclass(frozen=True)
class Constant:
    """The value of a folded test."""

    value: object


def _known(node) -> bool:
    return isinstance(node, (Text, Constant))


def fold(node):
    """The tree with everything that depends on no name worked out."""
    if isinstance(node, Apply) and all(map(_known, node.args)):
        value = _OPS[node.op](*(a.value for a in node.args))
        return Text(value) if isinstance(value, str) else Constant(value)
    return node


def merged(nodes: list) -> tuple:
    """Neighbouring constant texts as one; empty ones and dead branches gone."""
    out: list = []
    for node in nodes:
        if isinstance(node, Output) and _known(node.value):
            node = Text(str(node.value.value))
        if isinstance(node, Block) and node.kind == "if" and _known(node.parts[0]):
            chosen = node.parts[1] if node.parts[0].value else node.parts[2]
        else:
            chosen = (node,)
        for one in chosen:
            if isinstance(one, Text) and out and isinstance(out[-1], Text):
                out[-1] = Text(out[-1].value + one.value)
            elif one != Text(""):
                out.append(one)
    return tuple(out)


def parse(source: str) -> tuple:
    """The folded syntax tree of a template."""
    root: list = []
    open_: list[list] = [["", root]]  # each: tag, current body, then what the tag holds
    at = 0
    for m in _TAG.finditer(source):
        open_[-1][1].append(Text(source[at : m.start()]))
        at = m.end()
        if m[1] is not None:
            open_[-1][1].append(Output(_Expression(m[1]).read()))
            continue
        words = m[2].split(None, 1)
        tag, rest = (words + ["", ""])[:2]
        if tag == "for" and (head := re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+([A-Za-z_]\w*)\s*", rest)):
            open_.append([tag, [], head[1], head[2]])
        elif tag == "if":
            open_.append([tag, [], _Expression(rest).read(), None])
        elif tag == "generation" and not rest.strip():
            open_.append([tag, []])
        elif tag == "else" and open_[-1][0] == "if" and open_[-1][3] is None:
            open_[-1][3], open_[-1][1] = open_[-1][1], []
        elif tag == f"end{open_[-1][0]}" and len(open_) > 1:
            kind, body, *held = open_.pop()
            if kind == "if":
                then, other = (body, []) if held[1] is None else (held[1], body)
                parts = (held[0], merged(then), merged(other))
            else:
                parts = (*held, merged(body))
            open_[-1][1].append(Block(kind, parts))
        else:
            raise TemplateError(f"unexpected tag {m[2].strip()!r}")
    if len(open_) > 1:
        raise TemplateError(f"{open_[-1][0]!r} isn't ended")
    root.append(Text(source[at:]))
    return merged(root)


class Page:
    """What a rendering has written: its parts, their length, and the generations."""

    def __init__(self):
        self.parts, self.length, self.spans = [], 0, []

    def write(self, text: str) -> None:
        self.parts.append(text)
        self.length += len(text)


def _value(node) -> Callable[[dict], object]:
    if _known(node):
        return lambda names, value=node.value: value
    if isinstance(node, Name):
        if node.field is None:
            return lambda names: names.get(node.name, "")
        return lambda names: (names.get(node.name) or {}).get(node.field, "")
    args, run = [_value(a) for a in node.args], _OPS[node.op]
    if len(args) == 1:
        return lambda names, one=args[0]: run(one(names))
    if node.op in ("and", "or"):
        first, second = args
        stop = node.op == "or"
        return lambda names: a if bool(a := first(names)) == stop else second(names)
    return lambda names, a=args[0], b=args[1]: run(a(names), b(names))


def _body(nodes: tuple) -> Callable[[dict, Page], None]:
    steps = [_step(n) for n in nodes]

    def run(names: dict, page: Page) -> None:
        for step in steps:
            step(names, page)

    return run


def _step(node) -> Callable[[dict, Page], None]:
    if isinstance(node, Text):
        return lambda names, page: page.write(node.value)
    if isinstance(node, Output):
        value = _value(node.value)
        return lambda names, page: page.write(value(names))
    if node.kind == "if":
        test, then, other = _value(node.parts[0]), _body(node.parts[1]), _body(node.parts[2])
        return lambda names, page: (then if test(names) else other)(names, page)
    if node.kind == "generation":
        body = _body(node.parts[0])

        def generate(names: dict, page: Page) -> None:
            start = page.length
            body(names, page)
            page.spans.append((start, page.length))

        return generate
    name, source, body = node.parts[0], node.parts[1], _body(node.parts[2])

    def loop(names: dict, page: Page) -> None:
        for item in names.get(source) or ():
            body({**names, name: item}, page)

    return loop


def compiled(source: str) -> Callable[..., Page]:
    """A function from ``messages`` (any iterable, read once) to a finished page."""
    run = _body(parse(source))

    def render(messages, **names: str) -> Page:
        page = Page()
        run({**names, "messages": messages}, page)
        return page

    return render


def read_back(formatted: str) -> Iterator[tuple[str, str]]:
    """Role and text of each turn of a page written with ``TEMPLATE``."""
    at = 0
    while at < len(formatted):
        head = formatted.index("\n", at)
        end = formatted.index(END, head)
        yield unescape(formatted[at + len(START) : head]), unescape(formatted[head + 1 : end])
        at = end + len(END) + 1


def format_conversations(df: DataFrame, conv_id: str, turn: str, role: str, text: str, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, formatted, spans (start, end of generations).

    Rows are taken by turn, then role, then text; missing turns come first, missing roles
    and texts count as empty, repeated rows are repeated turns. Rows without a
    conversation id form one conversation without id. Positions are code points.
    """
    rows = df.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"),
        F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"), F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
    )
    kind = dict(rows.dtypes)["conv_id"]
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")
    spans = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compiled(template)
        flat = ((b.schema.field(0).type, r) for b in batches for r in zip(*(c.to_pylist() for c in b.columns)))
        row = next(flat, None)

        def messages(ident) -> Iterator[dict]:
            nonlocal row
            while row is not None and row[1][0] == ident:
                yield {"role": row[1][1], "text": row[1][2]}
                row = next(flat, None)

        while row is not None:
            of, (ident, *_) = row
            page = render(mine := messages(ident))
            for _ in mine:  # a template needn't read all messages
                pass
            marks = [{"start": a, "end": b} for a, b in page.spans]
            yield pa.RecordBatch.from_arrays(
                [pa.array([ident], of), pa.array(["".join(page.parts)], pa.string()), pa.array([marks], spans)],
                ["conv_id", "formatted", "spans"],
            )

    return dealt.mapInArrow(run, f"conv_id {kind}, formatted string, spans array<struct<start: bigint, end: bigint>>")
