"""Chat formatting with compiled templates.

A small template language is parsed into a syntax tree, constant parts are folded, and the tree is turned into
Python closures. It is sandboxed by what it lacks: names stand for the given values only, a dot or brackets read a
key or an index, filters come from a fixed table, and nothing can be called or assigned.

    {{ expression | filter }}                          output
    {% for x in expression %} ... {% endfor %}         loop; loop.index, loop.first and loop.last are known inside
    {% if e %} ... {% elif e %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}           what is written in here is under the loss mask
    {# comment #}

Expressions: strings, whole numbers, true/false/none, names, a.b, a["b"], a[0], not, and, or, ==, !=, in, + and ~
(joins texts).
"""

from __future__ import annotations

import hashlib
import itertools
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"


class TemplateError(ValueError):
    pass


# Control strings start with "<|". Inside a text one backslash is put between the two characters, and one more where
# backslashes stand there already, so that no control string is left and the way back is unique.
def escape(text: str) -> str:
    return re.sub(r"<(\\*)\|", r"<\\\1|", text)


def unescape(text: str) -> str:
    return re.sub(r"<\\(\\*)\|", r"<\1|", text)


def escape_line(text: str) -> str:
    """For a text that has to stay on one line."""
    return escape(text.replace("\\", "\\\\").replace("\n", "\\n"))


def unescape_line(text: str) -> str:
    return re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], unescape(text))


FILTERS: dict[str, Callable[[Any], Any]] = {
    "escape": lambda v: escape(shown(v)), "escape_line": lambda v: escape_line(shown(v)), "trim": lambda v: shown(v).strip(),
    "upper": lambda v: shown(v).upper(), "lower": lambda v: shown(v).lower(), "length": len,
}


def shown(value: Any) -> str:
    return "" if value is None else value if isinstance(value, str) else str(value)


# ---- syntax tree -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Item:
    of: Any
    key: Any


@dataclass(frozen=True)
class Filtered:
    of: Any
    name: str


@dataclass(frozen=True)
class Operation:
    sign: str
    parts: tuple


@dataclass(frozen=True)
class Output:
    of: Any


@dataclass(frozen=True)
class Loop:
    name: str
    over: Any
    body: tuple


@dataclass(frozen=True)
class Choice:
    branches: tuple  # of (condition, body)


@dataclass(frozen=True)
class Generation:
    body: tuple


_PIECE = re.compile(r"\{\{(.*?)\}\}|\{%-?(.*?)-?%\}|\{#.*?#\}", re.DOTALL)
_TOKEN = re.compile(r"""\s*(?:("(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*')|(\d+)|([A-Za-z_]\w*)|(==|!=|[\[\].|()+~]))""")
_ESCAPED = {"n": "\n", "t": "\t"}


def _tokens(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        found = _TOKEN.match(source, at)
        if not found:
            raise TemplateError(f"cannot read {source[at:]!r}")
        kind = ("text", "number", "name", "sign")[found.lastindex - 1]
        out.append((kind, found[found.lastindex]))
        at = found.end()
    return out


class _Expression:
    """Precedence, loosest first: or, and, not, comparison, sum, filter, item."""

    def __init__(self, source: str):
        self.tokens, self.at = _tokens(source), 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "text" else None

    def take(self, *wanted: str) -> str | None:
        if (now := self.peek()) is not None and now in wanted:
            self.at += 1
            return now
        return None

    def whole(self) -> Any:
        out = self.any_of()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def any_of(self) -> Any:
        parts = [self.all_of()]
        while self.take("or"):
            parts.append(self.all_of())
        return parts[0] if len(parts) == 1 else Operation("or", tuple(parts))

    def all_of(self) -> Any:
        parts = [self.negated()]
        while self.take("and"):
            parts.append(self.negated())
        return parts[0] if len(parts) == 1 else Operation("and", tuple(parts))

    def negated(self) -> Any:
        return Operation("not", (self.negated(),)) if self.take("not") else self.compared()

    def compared(self) -> Any:
        left = self.joined()
        sign = self.take("==", "!=", "in")
        return Operation(sign, (left, self.joined())) if sign else left

    def joined(self) -> Any:
        left = self.filtered()
        while sign := self.take("+", "~"):
            left = Operation(sign, (left, self.filtered()))
        return left

    def filtered(self) -> Any:
        out = self.items()
        while self.take("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "nothing")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no such filter: {name}")
            self.at += 1
            out = Filtered(out, name)
        return out

    def items(self) -> Any:
        out = self.atom()
        while sign := self.take(".", "["):
            if sign == ".":
                kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "nothing")
                if kind != "name":
                    raise TemplateError(f"a name is wanted after the dot, not {name!r}")
                self.at += 1
                out = Item(out, Const(name))
            else:
                out = Item(out, self.any_of())
                if not self.take("]"):
                    raise TemplateError("missing ]")
        return out

    def atom(self) -> Any:
        if self.take("("):
            out = self.any_of()
            if not self.take(")"):
                raise TemplateError("missing )")
            return out
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too early")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "text":
            return Const(re.sub(r"\\(.)", lambda m: _ESCAPED.get(m[1], m[1]), value[1:-1], flags=re.DOTALL))
        if kind == "number":
            return Const(int(value))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            return Const(fixed[value]) if value in fixed else Name(value)
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> tuple:
    """The syntax tree of a template."""
    pieces: list[tuple[str, str]] = []
    at = 0
    for found in _PIECE.finditer(source):
        if found.start() > at:
            pieces.append(("plain", source[at : found.start()]))
        if found[1] is not None:
            pieces.append(("output", found[1]))
        elif found[2] is not None:
            pieces.append(("tag", found[2].strip()))
        at = found.end()
    if at < len(source):
        pieces.append(("plain", source[at:]))
    place = 0

    def body(*ends: str) -> tuple[tuple, str]:
        nonlocal place
        out = []
        while place < len(pieces):
            kind, text = pieces[place]
            place += 1
            if kind == "plain":
                out.append(Output(Const(text)))
            elif kind == "output":
                out.append(Output(_Expression(text).whole()))
            else:
                word, _, rest = text.partition(" ")
                if word in ends:
                    return tuple(out), text
                if word == "for":
                    head = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+(.*)", rest.strip(), re.DOTALL)
                    if not head or head[1] == "loop":
                        raise TemplateError(f"cannot read the loop {rest!r}")
                    inner, _ = body("endfor")
                    out.append(Loop(head[1], _Expression(head[2]).whole(), inner))
                elif word == "if":
                    branches, condition = [], _Expression(rest).whole()
                    while True:
                        inner, end = body("elif", "else", "endif")
                        branches.append((condition, inner))
                        if end == "endif":
                            break
                        condition = Const(True) if end == "else" else _Expression(end.partition(" ")[2]).whole()
                    out.append(Choice(tuple(branches)))
                elif word == "generation":
                    inner, _ = body("endgeneration")
                    out.append(Generation(inner))
                else:
                    raise TemplateError(f"unknown tag: {text!r}")
        if ends:
            raise TemplateError(f"missing {ends[-1]}")
        return tuple(out), ""

    return body()[0]


# ---- constant folding --------------------------------------------------------------------------------------------


def _apply(sign: str, parts: list[Any]) -> Any:
    if sign == "not":
        return not parts[0]
    if sign == "==":
        return parts[0] == parts[1]
    if sign == "!=":
        return parts[0] != parts[1]
    if sign == "in":
        return parts[0] in (parts[1] or ())
    if sign == "~":
        return shown(parts[0]) + shown(parts[1])
    return parts[0] + parts[1]


def _folded(e: Any) -> Any:
    if isinstance(e, Item):
        return Item(_folded(e.of), _folded(e.key))
    if isinstance(e, Filtered):
        of = _folded(e.of)
        return Const(FILTERS[e.name](of.value)) if isinstance(of, Const) else Filtered(of, e.name)
    if isinstance(e, Operation):
        parts = tuple(_folded(p) for p in e.parts)
        if e.sign in ("and", "or"):
            kept = []
            for p in parts:  # constants that cannot decide fall out, one that does ends the chain
                if not isinstance(p, Const):
                    kept.append(p)
                elif bool(p.value) is (e.sign == "or"):
                    kept.append(p)
                    break
                elif p is parts[-1]:
                    kept.append(p)
            return kept[0] if len(kept) == 1 else Operation(e.sign, tuple(kept))
        if all(isinstance(p, Const) for p in parts):
            return Const(_apply(e.sign, [p.value for p in parts]))
        return Operation(e.sign, parts)
    return e


def fold(body: tuple) -> tuple:
    """Constant expressions become values, branches that cannot be taken go, neighbouring constant texts are one."""
    out: list[Any] = []
    for node in body:
        if isinstance(node, Output):
            of = _folded(node.of)
            if isinstance(of, Const):
                text = shown(of.value)
                if out and isinstance(out[-1], Output) and isinstance(out[-1].of, Const):
                    out[-1] = Output(Const(out[-1].of.value + text))
                elif text:
                    out.append(Output(Const(text)))
            else:
                out.append(Output(of))
        elif isinstance(node, Loop):
            out.append(Loop(node.name, _folded(node.over), fold(node.body)))
        elif isinstance(node, Generation):
            out.append(Generation(fold(node.body)))
        else:
            branches = []
            for condition, inner in node.branches:
                condition = _folded(condition)
                if isinstance(condition, Const) and not condition.value:
                    continue
                branches.append((condition, fold(inner)))
                if isinstance(condition, Const):
                    break
            if branches and isinstance(branches[0][0], Const):
                for one in branches[0][1]:
                    if out and all(isinstance(x, Output) and isinstance(x.of, Const) for x in (out[-1], one)):
                        out[-1] = Output(Const(out[-1].of.value + one.of.value))
                    else:
                        out.append(one)
            elif branches:
                out.append(Choice(tuple(branches)))
    return tuple(out)


# ---- closures ----------------------------------------------------------------------------------------------------


def _read(of: Any, key: Any) -> Any:
    """A key of a mapping or an index of a list; nothing else can be read, and what is missing is none."""
    if isinstance(of, dict):
        return of.get(key)
    if isinstance(of, (list, tuple)) and isinstance(key, int) and -len(of) <= key < len(of):
        return of[key]
    return None


def _value(e: Any) -> Callable[[dict], Any]:
    if isinstance(e, Const):
        return lambda names, value=e.value: value
    if isinstance(e, Name):
        return lambda names, name=e.name: names.get(name)
    if isinstance(e, Item):
        of, key = _value(e.of), _value(e.key)
        return lambda names: _read(of(names), key(names))
    if isinstance(e, Filtered):
        of, apply = _value(e.of), FILTERS[e.name]
        return lambda names: apply(of(names))
    parts = [_value(p) for p in e.parts]
    if e.sign in ("and", "or"):
        stop = e.sign == "or"

        def chain(names: dict) -> Any:
            value = None
            for part in parts:
                value = part(names)
                if bool(value) is stop:
                    break
            return value

        return chain
    return lambda names, sign=e.sign: _apply(sign, [p(names) for p in parts])


Writer = Callable[[dict, Callable[[str, bool], None], bool], None]


def _body(body: tuple) -> Writer:
    writers = [_writer(node) for node in body]

    def write(names: dict, put: Callable[[str, bool], None], masked: bool) -> None:
        for one in writers:
            one(names, put, masked)

    return write


def _writer(node: Any) -> Writer:
    if isinstance(node, Output):
        of = _value(node.of)
        return lambda names, put, masked: put(shown(of(names)), masked)
    if isinstance(node, Generation):
        inner = _body(node.body)
        return lambda names, put, masked: inner(names, put, True)
    if isinstance(node, Loop):
        over, inner = _value(node.over), _body(node.body)

        def loop(names: dict, put: Callable[[str, bool], None], masked: bool) -> None:
            items = over(names) or ()
            for i, item in enumerate(items):
                own = {"index": i + 1, "first": i == 0, "last": i == len(items) - 1}
                inner({**names, node.name: item, "loop": own}, put, masked)

        return loop
    branches = [(_value(c), _body(b)) for c, b in node.branches]

    def choose(names: dict, put: Callable[[str, bool], None], masked: bool) -> None:
        for condition, inner in branches:
            if condition(names):
                inner(names, put, masked)
                break

    return choose


def compile_template(source: str) -> Callable[[dict], tuple[str, list[tuple[int, int]]]]:
    """A function from the template's names to the text and the (start, end) spans under the loss mask."""
    write = _body(fold(parse(source)))

    def render(names: dict) -> tuple[str, list[tuple[int, int]]]:
        pieces: list[str] = []
        spans: list[tuple[int, int]] = []
        at = 0

        def put(text: str, masked: bool) -> None:
            nonlocal at
            if text:
                pieces.append(text)
                if masked:
                    spans.append((at, at + len(text)))
                at += len(text)

        write(names, put, False)
        return "".join(pieces), spans

    return render


# ---- conversations -----------------------------------------------------------------------------------------------

CHAT = (
    "{% for m in messages %}" + OPEN + "{{ m.role | escape_line }}\n"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}"
    "{% else %}{{ m.text | escape }}{% endif %}" + CLOSE + "\n{% endfor %}"
)
_TURN = re.compile(re.escape(OPEN) + r"([^\n]*)\n(.*?)" + re.escape(CLOSE) + r"\n", re.DOTALL)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """The (role, text) turns of a text written by the ``CHAT`` template."""
    turns, at = [], 0
    for found in _TURN.finditer(formatted):
        if found.start() != at:
            raise ValueError("the text was not written by the template")
        turns.append((unescape_line(found[1]), unescape(found[2])))
        at = found.end()
    if at != len(formatted):
        raise ValueError("the text was not written by the template")
    return turns


def formatted(conversations: DataFrame, template: str = CHAT) -> DataFrame:
    """(conv_id, formatted, mask): one training text for each conversation, and its spans under the loss mask.

    Turns are dealt by conversation and sorted by turn (rows of one turn by role and text) inside the partitions,
    and a task formats one conversation after the other, so it holds one conversation at a time: the row it writes
    anyway. Null texts and roles count as empty; rows of a null conv_id are one conversation. No rows give no rows.
    """
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")
    )
    dealt = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").select("conv_id", "role", "text")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        turns = (t for batch in batches for t in zip(*(batch[c].to_pylist() for c in ("conv_id", "role", "text")), strict=True))
        done: list[tuple] = []
        size = 0

        def batch_of() -> pa.RecordBatch:
            span = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
            ids, texts, masks = zip(*done, strict=True) if done else ((), (), ())
            return pa.RecordBatch.from_arrays(
                [pa.array(ids, pa.int64()), pa.array(texts, pa.string()), pa.array([[{"start": a, "end": b} for a, b in m] for m in masks], span)],
                ["conv_id", "formatted", "mask"],
            )

        for conv_id, group in itertools.groupby(turns, key=lambda t: t[0]):
            text, spans = render({"messages": [{"role": role, "text": said} for _, role, said in group]})
            done.append((conv_id, text, spans))
            size += len(text)
            if len(done) >= 2000 or size > 4_000_000:
                yield batch_of()
                done, size = [], 0
        yield batch_of()

    return dealt.mapInArrow(write, "conv_id long, formatted string, mask array<struct<start:int,end:int>>")


def digests(written: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations: turns and the text under the loss mask."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[list] = [[] for _ in range(6)]
            for conv_id, text, mask in zip(*(batch[c].to_pylist() for c in ("conv_id", "formatted", "mask")), strict=True):
                turns = read_back(text)
                loss = "".join(unescape(text[s["start"] : s["end"]]) for s in mask)
                row = (
                    conv_id, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode("utf-8", "surrogatepass")).hexdigest(),
                    len(loss), hashlib.sha256(loss.encode("utf-8", "surrogatepass")).hexdigest(), len(text),
                )
                for column, value in zip(out, row, strict=True):
                    column.append(value)
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64())
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(out, kinds, strict=True)],
                ["conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"],
            )

    return written.mapInArrow(
        read, "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"
    )
