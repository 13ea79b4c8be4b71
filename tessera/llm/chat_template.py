"""A small sandboxed template language for chat formats, compiled to Python closures.

    {%- for m in messages -%}
    {%- if m.role == 'assistant' -%}{% generation %}{{ m.text | guard }}{% endgeneration %}</s>
    {%- else -%}[INST] {{ m.text | guard }} [/INST]{%- endif -%}
    {%- endfor -%}

Source is split into texts and tags, parsed into a syntax tree, folded (constant
expressions are evaluated, branches with a known condition chosen, neighbouring texts
joined) and turned into closures.  A rendered template is a stream of pieces, each
under the generation mark or not, so a conversation is never held as a whole.

Statements: for/endfor, if/elif/else/endif, generation/endgeneration; a minus beside a
brace trims blanks; {# comments #}.  Expressions: strings, whole numbers, true, false, none,
names, a.b and a['b'], not, and, or, == != < <= > >= in, + (of two strings or
numbers), ~ (of anything as text), x if c else y, x is defined, filters with |.

Sandbox: names stand for the given variables, the message of the loop and `loop` (index,
index0, first, last) only, and a.b is a key of a message, never an attribute of a Python
object; nothing is called but the filters listed here.  A template has one loop at most,
over messages, and no assignments, so its output and its time are linear in the
messages.  What is missing is none and prints as nothing.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass
from typing import Any

#: Characters of a template and depth of its tree at most.
SOURCE, DEPTH = 100_000, 60
_TAGS = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_TOKEN = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d{1,18})|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[<>+~|.\[\]()-]))""")
_WORDS = {"and", "or", "not", "in", "is", "if", "else", "true", "false", "none", "True", "False", "None"}
_CONSTANTS = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
_ESCAPES = {"n": "\n", "t": "\t"}


class TemplateError(ValueError):
    """The template is not in the language, or asks for what values can't do."""


# ---- syntax tree ----------------------------------------------------------------


@dataclass(frozen=True)
class Const:
    value: Any


@dataclass(frozen=True)
class Name:
    name: str


@dataclass(frozen=True)
class Op:
    """An operator or filter over expressions: get, not, and, or, ==, in, +, ~, if, defined, |trim ..."""

    op: str
    of: tuple


@dataclass(frozen=True)
class Text:
    text: str


@dataclass(frozen=True)
class Out:
    value: Any


@dataclass(frozen=True)
class If:
    branches: tuple  # (condition, body)


@dataclass(frozen=True)
class For:
    name: str
    body: tuple


@dataclass(frozen=True)
class Generation:
    body: tuple


# ---- values -----------------------------------------------------------------------


def _shown(v: Any) -> str:
    if v is None:
        return ""
    if isinstance(v, bool):
        return "true" if v else "false"
    if isinstance(v, str | int):
        return str(v)
    raise TemplateError("a message can't be printed as a whole")


def _key(v: Any, k: Any) -> Any:
    if v is None:
        return None
    if not isinstance(v, dict):
        raise TemplateError("only messages have keys")
    return v.get(k) if isinstance(k, str) else None


def _less(a: Any, b: Any) -> bool:
    if type(a) is not type(b) or not isinstance(a, str | int):
        raise TemplateError("only two strings or two numbers have an order")
    return a < b


def _added(a: Any, b: Any) -> Any:
    if type(a) is type(b) and isinstance(a, str) or type(a) is type(b) is int:
        return a + b
    raise TemplateError("+ adds two strings or two numbers")


def _within(a: Any, b: Any) -> bool:
    if isinstance(b, dict):
        return isinstance(a, str) and a in b
    if isinstance(a, str) and isinstance(b, str):
        return a in b
    raise TemplateError("in looks for a string in a string or in a message's keys")


_OPERATORS: dict[str, Callable] = {
    "get": _key,
    "not": lambda a: not a,
    "==": lambda a, b: type(a) is type(b) and a == b,
    "!=": lambda a, b: not (type(a) is type(b) and a == b),
    "<": _less,
    ">": lambda a, b: _less(b, a),
    "<=": lambda a, b: not _less(b, a),
    ">=": lambda a, b: not _less(a, b),
    "in": _within,
    "+": _added,
    "~": lambda a, b: _shown(a) + _shown(b),
    "defined": lambda a: a is not None,
    "|trim": lambda a: _shown(a).strip(),
    "|upper": lambda a: _shown(a).upper(),
    "|lower": lambda a: _shown(a).lower(),
    "|default": lambda a, b: b if a is None else a,
}


class Guard:
    """Control strings, and a reversible way to have none of them in a text.

    A control string in a text gets a backslash behind its first character; where there
    are some already, one more.  So guarded texts hold no control string, all else stays
    as it is, and taking one backslash from each gives the text back.
    """

    def __init__(self, control: Iterable[str]) -> None:
        self.control = tuple(control)
        for c in self.control:
            if len(c) < 2 or "\\" in c:
                raise TemplateError(f"no control string: {c!r}")
            for d in self.control:
                if any(d.startswith(c[i:]) for i in range(1, len(c))) or c != d and d in c:
                    raise TemplateError(f"{c!r} and {d!r} may overlap")
        either = lambda slashes: "|".join(re.escape(c[0]) + slashes + re.escape(c[1:]) for c in self.control) or r"(?!)"
        self._given, self._guarded = re.compile(either(r"\\*")), re.compile(either(r"\\+"))
        self.markers = re.compile(either(""))

    def guard(self, text: str) -> str:
        return self._given.sub(lambda m: f"{m[0][0]}\\{m[0][1:]}", text)

    def bare(self, text: str) -> str:
        return self._guarded.sub(lambda m: m[0][0] + m[0][2:], text)


# ---- parser -------------------------------------------------------------------------


class _Expression:
    """A recursive-descent parser of one expression."""

    def __init__(self, source: str, names: set[str], filters: set[str]) -> None:
        self.names, self.filters, self.depth, self.at = names, filters, 0, 0
        self.tokens: list[tuple[str, str]] = []
        pos, source = 0, source.rstrip()
        while pos < len(source):
            m = _TOKEN.match(source, pos)
            if not m:
                raise TemplateError(f"not an expression: {source!r}")
            kind = m.lastgroup or ""
            self.tokens.append(("op" if kind == "name" and m[kind] in _WORDS else kind, m[kind]))
            pos = m.end()

    def whole(self) -> Any:
        out = self._choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def _peek(self) -> str:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "op" else ""

    def _took(self, *ops: str) -> str:
        if (op := self._peek()) in ops and op:
            self.at += 1
            return op
        return ""

    def _need(self, op: str) -> None:
        if not self._took(op):
            raise TemplateError(f"{op!r} is missing")

    def _choice(self) -> Any:
        self.depth += 1
        if self.depth > DEPTH:
            raise TemplateError("nested too deeply")
        value = self._either()
        if self._took("if"):
            condition = self._either()
            self._need("else")
            value = Op("if", (condition, value, self._choice()))
        self.depth -= 1
        return value

    def _either(self) -> Any:
        left = self._both()
        while self._took("or"):
            left = Op("or", (left, self._both()))
        return left

    def _both(self) -> Any:
        left = self._negated()
        while self._took("and"):
            left = Op("and", (left, self._negated()))
        return left

    def _negated(self) -> Any:
        n = 0
        while self._took("not"):
            n += 1
        value = self._compared()
        return Op("not", (value,)) if n % 2 else Op("not", (Op("not", (value,)),)) if n else value

    def _compared(self) -> Any:
        left = self._sum()
        if op := self._took("==", "!=", "<", "<=", ">", ">=", "in"):
            return Op(op, (left, self._sum()))
        if self._took("not"):
            self._need("in")
            return Op("not", (Op("in", (left, self._sum())),))
        if self._took("is"):
            negated = self._took("not")
            if self.at >= len(self.tokens) or self.tokens[self.at] != ("name", "defined"):
                raise TemplateError("is what?")
            self.at += 1
            test = Op("defined", (left,))
            return Op("not", (test,)) if negated else test
        return left

    def _sum(self) -> Any:
        left = self._filtered()
        while op := self._took("+", "~"):
            left = Op(op, (left, self._filtered()))
        return left

    def _filtered(self) -> Any:
        value = self._item()
        while self._took("|"):
            kind, name = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
            if kind != "name" or name not in self.filters:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            args = ()
            if self._took("("):
                args = (self._choice(),)
                self._need(")")
            if (name == "default") != bool(args):
                raise TemplateError(f"{name} takes {'one value' if name == 'default' else 'no values'}")
            value = Op(f"|{name}", (value, *args))
        return value

    def _item(self) -> Any:
        if self.at >= len(self.tokens):
            raise TemplateError("an expression is missing")
        kind, word = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            value: Any = Const(re.sub(r"\\(.)", lambda m: _ESCAPES.get(m[1], m[1]), word[1:-1], flags=re.S))
        elif kind == "int":
            value = Const(int(word))
        elif word in _CONSTANTS:
            value = Const(_CONSTANTS[word])
        elif kind == "name":
            if word not in self.names:
                raise TemplateError(f"no name {word!r} here")
            value = Name(word)
        elif word == "(":
            value = self._choice()
            self._need(")")
        else:
            raise TemplateError(f"unexpected {word!r}")
        while op := self._took(".", "["):
            if op == ".":
                kind, word = self.tokens[self.at] if self.at < len(self.tokens) else ("", "")
                if kind != "name":
                    raise TemplateError("a key is missing")
                self.at += 1
                value = Op("get", (value, Const(word)))
            else:
                value = Op("get", (value, self._choice()))
                self._need("]")
        return value


def _parts(source: str) -> list[tuple[str, str]]:
    """("text" | "out" | "tag", content), blanks trimmed where a tag asks for it."""
    out: list[tuple[str, str]] = []
    trim = False
    for k, part in enumerate(_TAGS.split(source)):
        if k % 2 == 0:
            out.append(("text", part.lstrip() if trim else part))
            continue
        inner, trim = part[2:-2], False
        if inner.startswith("-"):
            inner = inner[1:]
            out[-1] = ("text", out[-1][1].rstrip())
        if inner.endswith("-"):
            inner, trim = inner[:-1], True
        if part[1] != "#":
            out.append(("out" if part[1] == "{" else "tag", inner.strip()))
    return [p for p in out if p != ("text", "")]


class _Parser:
    def __init__(self, source: str, variables: Iterable[str], filters: set[str]) -> None:
        if len(source) > SOURCE:
            raise TemplateError(f"a template has {SOURCE} characters at most")
        self.parts, self.at, self.filters, self.names = _parts(source), 0, filters, set(variables)
        self.loops = 0

    def _expression(self, source: str) -> Any:
        return _Expression(source, self.names, self.filters).whole()

    def tree(self) -> tuple:
        body, end = self._body((), 0, True)
        if end:
            raise TemplateError(f"unexpected {end!r}")
        return body

    def _body(self, ends: tuple[str, ...], depth: int, loop: bool, mark: bool = True) -> tuple[tuple, str]:
        """Nodes up to one of the tags `ends`; loop, mark: whether a loop, a generation mark may stand here."""
        if depth > DEPTH:
            raise TemplateError("nested too deeply")
        nodes: list = []
        while self.at < len(self.parts):
            kind, inner = self.parts[self.at]
            self.at += 1
            if kind == "text":
                nodes.append(Text(inner))
            elif kind == "out":
                nodes.append(Out(self._expression(inner)))
            else:
                word, _, rest = inner.partition(" ")
                if word in ends:
                    return tuple(nodes), inner
                if word == "if":
                    nodes.append(self._if(rest, depth, loop, mark))
                elif word == "for":
                    nodes.append(self._for(rest, depth, loop, mark))
                elif word == "generation" and not rest and mark:
                    body, _ = self._body(("endgeneration",), depth + 1, False, False)
                    nodes.append(Generation(body))
                else:
                    raise TemplateError(f"unexpected {inner!r}")
        if ends:
            raise TemplateError(f"{ends[-1]!r} is missing")
        return tuple(nodes), ""

    def _if(self, condition: str, depth: int, loop: bool, mark: bool) -> If:
        branches, tag = [], f"if {condition}"
        while not tag.startswith("endif"):
            word, _, rest = tag.partition(" ")
            test = Const(True) if word == "else" else self._expression(rest)
            body, tag = self._body(("endif",) if word == "else" else ("elif", "else", "endif"), depth + 1, loop, mark)
            branches.append((test, body))
        return If(tuple(branches))

    def _for(self, rest: str, depth: int, loop: bool, mark: bool) -> For:
        m = re.fullmatch(r"([A-Za-z_]\w*)\s+in\s+messages", rest.strip())
        if not m or m[1] in _WORDS or m[1] == "loop":
            raise TemplateError("a loop is: for NAME in messages")
        self.loops += 1
        if self.loops > 1 or not loop:
            raise TemplateError("a template has one loop, outside of generation marks")
        before, self.names = self.names, self.names | {m[1], "loop"}
        body, _ = self._body(("endfor",), depth + 1, False, mark)
        self.names = before
        return For(m[1], body)


# ---- folding and code ---------------------------------------------------------------


def _folded(x: Any, operators: dict[str, Callable]) -> Any:
    """An expression with its constant parts evaluated; ones that fail are left to fail when they are met."""
    if not isinstance(x, Op):
        return x
    of = tuple(_folded(y, operators) for y in x.of)
    if x.op in ("and", "or") and isinstance(of[0], Const):
        return of[1] if bool(of[0].value) == (x.op == "and") else of[0]
    if x.op == "if" and isinstance(of[0], Const):
        return of[1] if of[0].value else of[2]
    if x.op in operators and all(isinstance(y, Const) for y in of):
        try:
            return Const(operators[x.op](*(y.value for y in of)))
        except TemplateError:
            pass
    return Op(x.op, of)


def fold(body: tuple, operators: dict[str, Callable] = _OPERATORS) -> tuple:
    """A body without constant outputs and branches that are never or always taken."""
    out: list = []

    def add(node: Any) -> None:
        if isinstance(node, Text) and out and isinstance(out[-1], Text):
            out[-1] = Text(out[-1].text + node.text)
        elif node != Text(""):
            out.append(node)

    for node in body:
        if isinstance(node, Out):
            value = _folded(node.value, operators)
            add(Text(_shown(value.value)) if isinstance(value, Const) else Out(value))
        elif isinstance(node, If):
            kept = []
            for test, inner in node.branches:
                test = _folded(test, operators)
                if isinstance(test, Const) and not test.value:
                    continue
                kept.append((test, fold(inner, operators)))
                if isinstance(test, Const):
                    break
            if kept and isinstance(kept[0][0], Const):
                for inner in kept[0][1]:
                    add(inner)
            elif kept:
                add(If(tuple(kept)))
        elif isinstance(node, For):
            add(For(node.name, fold(node.body, operators)))
        elif isinstance(node, Generation):
            if inner := fold(node.body, operators):
                add(Generation(inner))
        else:
            add(node)
    return tuple(out)


Scope = dict[str, Any]
Pieces = Iterator[tuple[str | None, bool]]


def _value(x: Any, operators: dict[str, Callable]) -> Callable[[Scope], Any]:
    """The closure of an expression."""
    if isinstance(x, Const):
        return lambda scope, v=x.value: v
    if isinstance(x, Name):
        return lambda scope, n=x.name: scope.get(n)
    of = [_value(y, operators) for y in x.of]
    if x.op == "and":
        return lambda scope, a=of[0], b=of[1]: a(scope) and b(scope)
    if x.op == "or":
        return lambda scope, a=of[0], b=of[1]: a(scope) or b(scope)
    if x.op == "if":
        return lambda scope, c=of[0], a=of[1], b=of[2]: a(scope) if c(scope) else b(scope)
    f = operators[x.op]
    if len(of) == 1:
        return lambda scope, f=f, a=of[0]: f(a(scope))
    return lambda scope, f=f, a=of[0], b=of[1]: f(a(scope), b(scope))


def _looped(messages: Iterable[dict]) -> Iterator[tuple[dict, dict]]:
    """Each message and what `loop` says of it; one message is read ahead."""
    it, k = iter(messages), 0
    now = next(it, None)
    while now is not None:
        after = next(it, None)
        yield now, {"index": k + 1, "index0": k, "first": k == 0, "last": after is None}
        now, k = after, k + 1


def _body(nodes: tuple, operators: dict[str, Callable], mark: bool = False) -> Callable[[Scope], Pieces]:
    """The closure of a body: a stream of (piece, under the mark), and (None, False) behind each message."""
    steps = [_step(n, operators, mark) for n in nodes]

    def run(scope: Scope) -> Pieces:
        for s in steps:
            yield from s(scope)

    return run


def _step(node: Any, operators: dict[str, Callable], mark: bool) -> Callable[[Scope], Pieces]:
    if isinstance(node, Text):
        pieces = ((node.text, mark),)
        return lambda scope: pieces
    if isinstance(node, Out):
        value = _value(node.value, operators)
        return lambda scope: ((_shown(value(scope)), mark),)
    if isinstance(node, Generation):
        return _body(node.body, operators, True)
    if isinstance(node, If):
        branches = [(_value(t, operators), _body(b, operators, mark)) for t, b in node.branches]

        def choose(scope: Scope) -> Pieces:
            return next((b(scope) for t, b in branches if t(scope)), iter(()))

        return choose
    inner = _body(node.body, operators, mark)

    def each(scope: Scope) -> Pieces:
        for message, loop in _looped(scope["messages"]):
            yield from inner(scope | {node.name: message, "loop": loop})
            yield None, False

    return each


class Template:
    """A compiled template.  control: the strings that the filter `guard` keeps out of texts."""

    def __init__(self, source: str, control: Iterable[str] = (), variables: Iterable[str] = ()) -> None:
        given = tuple(variables)
        if {"messages", "loop"} & set(given):
            raise TemplateError("messages and loop are names of the language")
        self.guard = Guard(control)
        operators = _OPERATORS | {"|guard": lambda v: self.guard.guard(_shown(v))}
        self.tree = fold(_Parser(source, given, {f[1:] for f in operators if f[0] == "|"}).tree(), operators)
        self._run, self._given = _body(self.tree, operators), set(given)

    def stream(self, messages: Iterable[dict], **variables: Any) -> Pieces:
        """(piece, under the generation mark); (None, False) behind each message."""
        if set(variables) - self._given:
            raise TemplateError("variables that the template was not compiled for")
        return self._run({**variables, "messages": messages})

    def render(self, messages: Iterable[dict], **variables: Any) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans (start, stop) under the mark, in code points."""
        return joined(self.stream(messages, **variables))


def joined(pieces: Pieces) -> tuple[str, list[tuple[int, int]]]:
    """One text of pieces; spans without anything between are one."""
    out, spans, at = [], [], 0
    for piece, mark in pieces:
        if not piece:
            continue
        if mark:
            if spans and spans[-1][1] == at:
                spans[-1] = (spans[-1][0], at + len(piece))
            else:
                spans.append((at, at + len(piece)))
        out.append(piece)
        at += len(piece)
    return "".join(out), spans
