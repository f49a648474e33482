"""Chat formatting by a template compiler.

Templates are in the usual language of chat templates: text, ``{{ expression }}``,
``{% statement %}`` and ``{# comment #}``, with ``-`` to trim. Statements: for (with
else, and ``if``), if / elif / else, set (names, and fields of a namespace), break,
continue, and generation, whose output is marked as spans of the rendered text. The
language is parsed into a syntax tree, constants are folded, and each node becomes a
Python closure. It is sandboxed: there is no attribute access but lookup in mappings,
no call but the listed filters, tests, methods and functions, and a render may take
only so many steps and characters as grow with its conversation. A newline right after a statement is dropped, and
blanks before a statement at the start of its line.

Defined results: a conversation is the rows of an id, a null id being one of its own.
Turns are ordered by number (null last), then role and text; repeated rows are turns
each. A null role or text is rendered as an empty string, but the row stays. A render
that fails gives null text and its error; a template that fails to compile raises
TemplateError on the driver. Extra columns take no part. Empty tables give no rows.
"""

from __future__ import annotations

import functools
import json
import operator
import re

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Loop rounds and calls that a render may take, and characters that it may give: so many, and so many more for each
#: turn and for each character of the conversation. Both are parameters of render; they end templates that run away.
MAX_STEPS, STEPS_PER_TURN = 10_000_000, 10_000
MAX_CHARS, CHARS_PER_CHAR = 1 << 30, 64

TEMPLATE = """{% for message in messages %}
{% if message.role == 'assistant' %}
<|im_start|>assistant
{% generation %}{{ message.content | trim }}<|im_end|>{% endgeneration %}

{% else %}
{{ '<' ~ '|im_start|>' ~ message['role'] }}
{{ message.content | trim }}<|im_end|>
{% endif %}
{% endfor %}
"""


class TemplateError(ValueError):
    """The template is wrong, or a render breaks a rule."""


class _Undefined:
    def __bool__(self):
        return False

    def __eq__(self, other):
        return isinstance(other, _Undefined)

    __hash__ = object.__hash__

    def __iter__(self):
        return iter(())


UNDEFINED = _Undefined()
_TOKEN = re.compile(r"\{#.*?#\}|\{\{-?|\{%-?", re.S)
_LEX = re.compile(r"""\s*(?:(?P<num>\d+(?:\.\d+)?)|(?P<str>'(?:\\.|[^'\\])*'|"(?:\\.|[^"\\])*")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|//|\*\*|[-+*/%~<>=()\[\]{},.:|]))""", re.S)
_ESCAPES = {"n": "\n", "t": "\t", "r": "\r", "\\": "\\", "'": "'", '"': '"'}


# --- parsing: nodes are tuples (kind, ...) ---


def _lex(source: str) -> list[tuple[str, object]]:
    out, at = [], 0
    while source[at:].strip():
        m = _LEX.match(source, at)
        if not m:
            raise TemplateError(f"can't read {source[at:][:30]!r}")
        at, kind, value = m.end(), m.lastgroup, m[m.lastgroup]
        if kind == "num":
            value = float(value) if "." in value else int(value)
        elif kind == "str":
            value = re.sub(r"\\(.)", lambda x: _ESCAPES.get(x[1], "\\" + x[1]), value[1:-1], flags=re.S)
        out.append((kind, value))
    return out


class _Expr:
    """A recursive-descent parser of one tag's content."""

    def __init__(self, source: str):
        self.tokens, self.at = _lex(source), 0

    def peek(self, *values) -> bool:
        return self.at < len(self.tokens) and self.tokens[self.at][0] in ("op", "name") and self.tokens[self.at][1] in values

    def take(self, *values) -> bool:
        if self.peek(*values):
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} is missing")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("a name is missing")

    def end(self) -> None:
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")

    def whole(self):
        e = self.expression()
        self.end()
        return e

    def expression(self):
        e = self.either()
        if self.take("if"):
            test = self.either()
            return ("cond", test, e, self.expression() if self.take("else") else ("const", UNDEFINED))
        return e

    def either(self):
        e = self.both()
        while self.take("or"):
            e = ("or", e, self.both())
        return e

    def both(self):
        e = self.negation()
        while self.take("and"):
            e = ("and", e, self.negation())
        return e

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        e, chain = self.concat(), []
        while True:
            if self.peek("==", "!=", "<", ">", "<=", ">=", "in"):
                self.at += 1
                chain.append((self.tokens[self.at - 1][1], self.concat()))
            elif self.peek("not") and self.at + 1 < len(self.tokens) and self.tokens[self.at + 1] == ("name", "in"):
                self.at += 2
                chain.append(("not in", self.concat()))
            else:
                break
        if chain:
            parts, left = [], e
            for op, right in chain:
                parts.append(("binary", op, left, right))
                left = right
            e = functools.reduce(lambda a, b: ("and", a, b), parts)
        return e

    def concat(self):
        e = self.sum()
        while self.take("~"):
            e = ("binary", "~", e, self.sum())
        return e

    def sum(self):
        e = self.product()
        while self.peek("+", "-"):
            self.at += 1
            e = ("binary", self.tokens[self.at - 1][1], e, self.product())
        return e

    def product(self):
        e = self.unary()
        while self.peek("*", "/", "//", "%"):
            self.at += 1
            e = ("binary", self.tokens[self.at - 1][1], e, self.unary())
        return e

    def unary(self):
        if self.take("-"):
            return ("unary", "-", self.unary())
        if self.take("+"):
            return ("unary", "+", self.unary())
        return self.filtered(self.postfix(self.atom()))

    def filtered(self, e):
        while True:
            if self.take("|"):
                name = self.name()
                if name not in FILTERS:
                    raise TemplateError(f"no such filter: {name}")
                e = ("filter", name, e, *(self.arguments() if self.take("(") else ((), ())))
            elif self.take("is"):
                negated = self.take("not")
                name = self.name()
                if name not in TESTS:
                    raise TemplateError(f"no such test: {name}")
                args = self.arguments()[0] if self.take("(") else ()
                e = ("test", name, e, args)
                e = ("not", e) if negated else e
            else:
                return e

    def postfix(self, e):
        while True:
            if self.take("."):
                name = self.name()
                if self.take("("):
                    if name not in METHODS:
                        raise TemplateError(f"no such method: {name}")
                    e = ("method", name, e, *self.arguments())
                else:
                    e = ("item", e, ("const", name))
            elif self.take("["):
                parts = [None if self.peek(":", "]") else self.expression()]
                while self.take(":"):
                    parts.append(None if self.peek(":", "]") else self.expression())
                self.need("]")
                if len(parts) > 3 or parts == [None]:
                    raise TemplateError("wrong index")
                e = ("item", e, parts[0]) if len(parts) == 1 else ("slice", e, *[("const", None) if p is None else p for p in (parts + [None])[:3]])
            elif self.peek("(") and e[0] == "name":
                self.at += 1
                if e[1] not in FUNCTIONS:
                    raise TemplateError(f"no such function: {e[1]}")
                e = ("call", e[1], *self.arguments())
            else:
                return e

    def arguments(self):
        args, named = [], []
        while not self.take(")"):
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.tokens[self.at + 1] == ("op", "="):
                key = self.name()
                self.need("=")
                named.append((key, self.expression()))
            else:
                args.append(self.expression())
            if not self.take(","):
                self.need(")")
                break
        return tuple(args), tuple(named)

    def atom(self):
        if self.at >= len(self.tokens):
            raise TemplateError("the expression ends too soon")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind in ("num", "str"):
            return ("const", value)
        if kind == "name":
            constants = {"true": True, "True": True, "false": False, "False": False, "none": None, "None": None}
            return ("const", constants[value]) if value in constants else ("name", value)
        if value == "(":
            e = self.expression()
            if self.peek(","):
                items = [e]
                while self.take(",") and not self.peek(")"):
                    items.append(self.expression())
                e = ("list", tuple(items))
            self.need(")")
            return e
        if value == "[":
            items = []
            while not self.take("]"):
                items.append(self.expression())
                if not self.take(","):
                    self.need("]")
                    break
            return ("list", tuple(items))
        if value == "{":
            pairs = []
            while not self.take("}"):
                key = self.expression()
                self.need(":")
                pairs.append((key, self.expression()))
                if not self.take(","):
                    self.need("}")
                    break
            return ("dict", tuple(pairs))
        raise TemplateError(f"unexpected {value!r}")


def _end_of(source: str, at: int, close: str) -> int:
    """Where a tag's closing mark begins, strings skipped."""
    quote = ""
    while at < len(source):
        c = source[at]
        if quote:
            at += c == "\\"
            quote = "" if c == quote else quote
        elif c in "'\"":
            quote = c
        elif source.startswith(close, at):
            return at
        at += 1
    raise TemplateError(f"{close} is missing")


def _pieces(source: str) -> list[tuple[str, str]]:
    """(text | expression | statement, content), white space being trimmed."""
    out: list[tuple[str, str]] = []
    at, trim, newline = 0, False, False

    def text(x: str, before: str) -> None:
        x = x.lstrip() if trim else x[1:] if newline and x.startswith("\n") else x
        if before.endswith("-"):
            x = x.rstrip()
        elif before in ("{%", "{#"):
            x = re.sub(r"(^|\n)[ \t]*\Z", r"\1", x) if "\n" in x or start_of_line else x
        if x:
            out.append(("text", x))

    while m := _TOKEN.search(source, at):
        start_of_line = not out or (newline and not trim)
        opening = m[0][:2] if m[0].startswith("{#") else m[0]
        text(source[at : m.start()], opening)
        if opening == "{#":
            at, trim, newline = m.end(), False, True
            continue
        kind, close = ("expression", "}}") if opening.startswith("{{") else ("statement", "%}")
        z = _end_of(source, m.end(), close)
        body = source[m.end() : z]
        trim, newline = body.endswith("-"), kind == "statement"
        out.append((kind, body[:-1] if trim else body))
        at = z + 2
    start_of_line = False
    text(source[at:], "")
    return out


_ENDS = {"for": ("else", "endfor"), "if": ("elif", "else", "endif"), "generation": ("endgeneration",)}


def parse(source: str):
    """The syntax tree of a template: a block node."""
    pieces = _pieces(source)
    at = 0

    def block(ends: tuple[str, ...], loop: bool):
        nonlocal at
        nodes = []
        while at < len(pieces):
            kind, body = pieces[at]
            at += 1
            if kind == "text":
                nodes.append(("text", body))
                continue
            if kind == "expression":
                nodes.append(("out", _Expr(body).whole()))
                continue
            e = _Expr(body)
            word = e.name()
            if word in ends:
                return ("block", nodes), word, e
            if word == "for":
                names = [e.name()]
                while e.take(","):
                    names.append(e.name())
                e.need("in")
                over, test = e.either(), None
                if e.take("if"):
                    test = e.expression()
                e.end()
                inner, stop, _ = block(_ENDS["for"], True)
                other = block(("endfor",), loop)[0] if stop == "else" else ("block", [])
                nodes.append(("for", tuple(names), over, test, inner, other))
            elif word == "if":
                arms, test = [], e.whole()
                while True:
                    inner, stop, e = block(_ENDS["if"], loop)
                    arms.append((test, inner))
                    if stop == "elif":
                        test = e.whole()
                        continue
                    nodes.append(("if", arms, block(("endif",), loop)[0] if stop == "else" else ("block", [])))
                    break
            elif word == "set":
                name = e.name()
                field = e.name() if e.take(".") else None
                e.need("=")
                nodes.append(("set", name, field, e.whole()))
            elif word == "generation":
                e.end()
                nodes.append(("generation", block(_ENDS["generation"], loop)[0]))
            elif word in ("break", "continue") and loop:
                e.end()
                nodes.append((word,))
            else:
                raise TemplateError(f"unexpected statement: {word}")
        if ends:
            raise TemplateError(f"{ends[-1]} is missing")
        return ("block", nodes), "", None

    return block((), False)[0]


# --- what expressions may do ---


def _text(x) -> str:
    return "" if isinstance(x, _Undefined) else x if isinstance(x, str) else str(x)


def _item(x, k):
    if isinstance(x, dict):
        return x.get(k, UNDEFINED) if isinstance(k, (str, int, float, bool)) else UNDEFINED
    if isinstance(x, (list, tuple, str)) and isinstance(k, int) and not isinstance(k, bool):
        return x[k] if -len(x) <= k < len(x) else UNDEFINED
    if isinstance(x, _Undefined):
        raise TemplateError(f"{k!r} of something undefined")
    return UNDEFINED


def _add(a, b):
    if isinstance(a, _Undefined) or isinstance(b, _Undefined):
        raise TemplateError("something undefined is added")
    return a + b


def _times(a, b):
    for x, n in ((a, b), (b, a)):
        if isinstance(x, (str, list, tuple)) and (not isinstance(n, int) or len(x) * max(n, 0) > 1 << 20):
            raise TemplateError("too long a repetition")
    return a * b


def _mod(a, b):
    if isinstance(a, str):
        raise TemplateError("% formats no text here")
    return a % b


BINARY = {"+": _add, "-": operator.sub, "*": _times, "/": operator.truediv, "//": operator.floordiv, "%": _mod, "~": lambda a, b: _text(a) + _text(b), "==": operator.eq, "!=": operator.ne, "<": operator.lt, ">": operator.gt, "<=": operator.le, ">=": operator.ge, "in": lambda a, b: a in b, "not in": lambda a, b: a not in b}
UNARY = {"-": operator.neg, "+": operator.pos}
FILTERS = {
    "trim": lambda x: _text(x).strip(), "upper": lambda x: _text(x).upper(), "lower": lambda x: _text(x).lower(), "title": lambda x: _text(x).title(), "capitalize": lambda x: _text(x).capitalize(),
    "length": lambda x: len(list(x)) if isinstance(x, _Undefined) else len(x), "count": len, "string": _text, "int": lambda x, default=0: _int(x, default), "list": list, "first": lambda x: next(iter(x), UNDEFINED), "last": lambda x: next(reversed(list(x)), UNDEFINED),
    "join": lambda x, sep="": sep.join(map(_text, x)), "replace": lambda x, a, b: _text(x).replace(a, b), "default": lambda x, d="", all_false=False: d if isinstance(x, _Undefined) or (all_false and not x) else x,
    "tojson": lambda x, indent=None: json.dumps(x, ensure_ascii=False, indent=indent), "items": lambda x: list(x.items()), "reverse": lambda x: x[::-1], "unique": lambda x: list(dict.fromkeys(x)), "sort": sorted, "abs": abs, "round": round,
    "selectattr": lambda x, k, test="true", *a: [y for y in x if (bool(_item(y, k)) if test == "true" else TESTS[test](_item(y, k), *a))], "rejectattr": lambda x, k, test="true", *a: [y for y in x if not (bool(_item(y, k)) if test == "true" else TESTS[test](_item(y, k), *a))],
    "map": lambda x, attribute=None: [_item(y, attribute) for y in x],
}
TESTS = {
    "defined": lambda x: not isinstance(x, _Undefined), "undefined": lambda x: isinstance(x, _Undefined), "none": lambda x: x is None, "string": lambda x: isinstance(x, str), "mapping": lambda x: isinstance(x, dict), "number": lambda x: isinstance(x, (int, float)) and not isinstance(x, bool), "boolean": lambda x: isinstance(x, bool), "integer": lambda x: isinstance(x, int) and not isinstance(x, bool),
    "iterable": lambda x: isinstance(x, (str, list, tuple, dict)), "sequence": lambda x: isinstance(x, (str, list, tuple)), "true": lambda x: x is True, "false": lambda x: x is False, "odd": lambda x: x % 2 == 1, "even": lambda x: x % 2 == 0, "divisibleby": lambda x, n: x % n == 0, "equalto": operator.eq, "eq": operator.eq, "ne": operator.ne, "in": lambda x, y: x in y,
}
METHODS = {name: str for name in ("strip", "lstrip", "rstrip", "split", "rsplit", "startswith", "endswith", "upper", "lower", "title", "capitalize", "replace", "find", "count", "join", "splitlines")} | {name: dict for name in ("items", "keys", "values", "get")}


def _int(x, default):
    try:
        return int(x)
    except (TypeError, ValueError):
        return default


def _raise(message=""):
    raise TemplateError(_text(message))


def _range(*a):
    r = range(*a)
    if len(r) > 1 << 20:
        raise TemplateError("too long a range")
    return list(r)


FUNCTIONS = {"raise_exception": _raise, "range": _range, "namespace": lambda **k: dict(k), "dict": lambda **k: dict(k)}
_IMPURE = {"raise_exception", "namespace", "dict"}  # each call of the latter two gives a mapping of its own


def _method(name: str, x, *args, **named):
    if not isinstance(x, METHODS[name]):
        raise TemplateError(f"{name} of {type(x).__name__}")
    if name == "replace" and len(args) >= 2 and len(x) * max(1, len(args[1])) > 1 << 28:
        raise TemplateError("too long a replacement")
    out = getattr(METHODS[name], name)(x, *args, **named)
    return list(out) if METHODS[name] is dict and name != "get" else out


# --- folding ---


def _const(e) -> bool:
    return e[0] == "const"


def fold_expr(e):
    """e with its constant parts computed. What fails to compute is left to fail when it is rendered."""
    kind = e[0]
    if kind in ("const", "name"):
        return e
    if kind in ("and", "or", "cond"):
        parts = [fold_expr(x) for x in e[1:]]
        if _const(parts[0]):
            truth = bool(parts[0][1])
            return (parts[1] if truth else parts[2]) if kind == "cond" else (parts[1] if truth == (kind == "and") else parts[0])
        return (kind, *parts)
    if kind == "list":
        items = tuple(map(fold_expr, e[1]))
        return ("list", items)
    if kind == "dict":
        return ("dict", tuple((fold_expr(k), fold_expr(v)) for k, v in e[1]))
    if kind in ("binary", "unary"):
        new = (kind, e[1], *map(fold_expr, e[2:]))
        parts = new[2:]
    elif kind in ("item", "slice", "not"):
        new = (kind, *map(fold_expr, e[1:]))
        parts = new[1:]
    elif kind == "test":
        new = (kind, e[1], fold_expr(e[2]), tuple(map(fold_expr, e[3])))
        parts = (new[2], *new[3])
    elif kind == "call":
        return (kind, e[1], tuple(map(fold_expr, e[2])), tuple((k, fold_expr(v)) for k, v in e[3]))
    else:
        new = (kind, e[1], fold_expr(e[2]), tuple(map(fold_expr, e[3])), tuple((k, fold_expr(v)) for k, v in e[4]))
        parts = (new[2], *new[3], *(v for _, v in new[4]))
    if all(map(_const, parts)):
        try:
            value = expr(new)(None)
        except Exception:  # noqa: BLE001 - the same error comes up where it is rendered, if it is
            return new
        if value is None or isinstance(value, (str, int, float, bool, _Undefined)):
            return ("const", value)
    return new


def fold(node):
    kind = node[0]
    if kind == "block":
        out: list = []
        for x in map(fold, node[1]):
            more = x[1] if x[0] == "block" else [x]
            for y in more:
                if y[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + y[1])
                elif y != ("text", ""):
                    out.append(y)
        return ("block", out)
    if kind == "out":
        e = fold_expr(node[1])
        return ("text", _text(e[1])) if _const(e) else ("out", e)
    if kind == "if":
        arms, other = [], fold(node[2])
        for test, body in node[1]:
            test = fold_expr(test)
            if _const(test):
                if test[1]:
                    other = fold(body)
                    break
                continue
            arms.append((test, fold(body)))
        return ("if", arms, other) if arms else other
    if kind == "for":
        return ("for", node[1], fold_expr(node[2]), node[3] and fold_expr(node[3]), fold(node[4]), fold(node[5]))
    if kind == "set":
        return ("set", node[1], node[2], fold_expr(node[3]))
    if kind == "generation":
        return ("generation", fold(node[1]))
    return node


# --- closures ---


class _State:
    __slots__ = ("scopes", "out", "length", "spans", "steps", "most_steps", "most_chars")

    def __init__(self, names: dict, most_steps: float, most_chars: float):
        self.most_steps, self.most_chars = most_steps, most_chars
        self.scopes, self.out, self.length, self.spans, self.steps = [names], [], 0, [], 0

    def write(self, x: str) -> None:
        self.out.append(x)
        self.length += len(x)
        if self.length > self.most_chars:
            raise TemplateError("too much output")

    def step(self) -> None:
        self.steps += 1
        if self.steps > self.most_steps:
            raise TemplateError("too many steps")

    def find(self, name: str):
        for scope in reversed(self.scopes):
            if name in scope:
                return scope[name]
        return UNDEFINED


class _Break(Exception):
    pass


class _Continue(Exception):
    pass


def expr(e):
    """An expression as a closure over the state."""
    kind = e[0]
    if kind == "const":
        value = e[1]
        return lambda s: value
    if kind == "name":
        name = e[1]
        return lambda s: s.find(name)
    if kind == "and":
        a, b = map(expr, e[1:])
        return lambda s: a(s) and b(s)
    if kind == "or":
        a, b = map(expr, e[1:])
        return lambda s: a(s) or b(s)
    if kind == "not":
        a = expr(e[1])
        return lambda s: not a(s)
    if kind == "cond":
        t, a, b = map(expr, e[1:])
        return lambda s: a(s) if t(s) else b(s)
    if kind == "binary":
        op, a, b = BINARY[e[1]], expr(e[2]), expr(e[3])
        return lambda s: op(a(s), b(s))
    if kind == "unary":
        op, a = UNARY[e[1]], expr(e[2])
        return lambda s: op(a(s))
    if kind == "item":
        a, k = expr(e[1]), expr(e[2])
        return lambda s: _item(a(s), k(s))
    if kind == "slice":
        a, *ends = map(expr, e[1:])
        return lambda s: a(s)[slice(*(x(s) for x in ends))]
    if kind == "list":
        items = list(map(expr, e[1]))
        return lambda s: [x(s) for x in items]
    if kind == "dict":
        pairs = [(expr(k), expr(v)) for k, v in e[1]]
        return lambda s: {k(s): v(s) for k, v in pairs}
    if kind == "test":
        test, a, args = TESTS[e[1]], expr(e[2]), list(map(expr, e[3]))
        return lambda s: test(a(s), *(x(s) for x in args))
    if kind == "call":
        call, first, args, named = FUNCTIONS[e[1]], [], list(map(expr, e[2])), [(k, expr(v)) for k, v in e[3]]
    else:
        call = FILTERS[e[1]] if kind == "filter" else functools.partial(_method, e[1])
        first, args, named = [expr(e[2])], list(map(expr, e[3])), [(k, expr(v)) for k, v in e[4]]

    def run(s):
        if s is not None:
            s.step()
        return call(*(x(s) for x in (*first, *args)), **{k: v(s) for k, v in named})

    return run


def statement(node):
    """A node as a closure that writes to the state."""
    kind = node[0]
    if kind == "text":
        text = node[1]
        return lambda s: s.write(text)
    if kind == "out":
        e = expr(node[1])
        return lambda s: s.write(_text(e(s)))
    if kind == "block":
        parts = list(map(statement, node[1]))
        if len(parts) == 1:
            return parts[0]

        def block(s):
            for p in parts:
                p(s)

        return block
    if kind == "if":
        arms, other = [(expr(t), statement(b)) for t, b in node[1]], statement(node[2])

        def branch(s):
            for test, body in arms:
                if test(s):
                    return body(s)
            return other(s)

        return branch
    if kind == "set":
        name, field, e = node[1], node[2], expr(node[3])

        def assign(s):
            if field is None:
                s.scopes[-1][name] = e(s)
            else:
                space = s.find(name)
                if not isinstance(space, dict):
                    raise TemplateError(f"{name} is no namespace")
                space[field] = e(s)

        return assign
    if kind == "generation":
        body = statement(node[1])

        def mark(s):
            start = s.length
            body(s)
            if s.length > start:
                s.spans.append((start, s.length))

        return mark
    if kind in ("break", "continue"):
        what = _Break if kind == "break" else _Continue

        def leave(s):
            raise what

        return leave
    names, over, test, body, other = node[1], expr(node[2]), node[3] and expr(node[3]), statement(node[4]), statement(node[5])

    def loop(s):
        scope: dict = {}

        def bind(x):
            if len(names) == 1:
                scope[names[0]] = x
            else:
                scope.update(zip(names, x, strict=True))

        items = over(s)
        if items is None:
            raise TemplateError("none can't be looped over")
        items = list(items)
        s.scopes.append(scope)
        try:
            if test is not None:
                kept = []
                for x in items:
                    s.step()
                    bind(x)
                    if test(s):
                        kept.append(x)
                items = kept
            n = len(items)
            for k, x in enumerate(items):
                s.step()
                scope.clear()
                bind(x)
                scope["loop"] = {"index": k + 1, "index0": k, "first": k == 0, "last": k == n - 1, "length": n, "revindex": n - k, "revindex0": n - k - 1, "previtem": items[k - 1] if k else UNDEFINED, "nextitem": items[k + 1] if k + 1 < n else UNDEFINED}
                try:
                    body(s)
                except _Continue:
                    continue
                except _Break:
                    break
        finally:
            s.scopes.pop()
        if not items:
            other(s)

    return loop


class Template:
    """A compiled template."""

    def __init__(self, source: str):
        self.tree = fold(parse(source))
        self.run = statement(self.tree)

    def render(self, *, max_steps: int = MAX_STEPS, max_chars: int = MAX_CHARS, **names) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of it (in characters) that generation blocks gave. max_steps and max_chars are what a render may take, beside what each turn of messages adds."""
        turns = names.get("messages") or ()
        chars = sum(len(v) for m in turns if isinstance(m, dict) for v in m.values() if isinstance(v, str))
        s = _State(names, max_steps + STEPS_PER_TURN * len(turns), max_chars + CHARS_PER_CHAR * chars)
        self.run(s)
        return "".join(s.out), s.spans


@functools.lru_cache(16)
def compiled(source: str) -> Template:
    return Template(source)


_SPANS = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))


def render(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", max_steps: int = MAX_STEPS, max_chars: int = MAX_CHARS, **names) -> DataFrame:
    """One row for each conversation: (conv_id, n_turns, text, spans, error), spans holding (start, end) in characters of what generation blocks gave. names are given to the template beside messages; max_steps and max_chars are the sandbox's bounds, beside what each turn adds."""
    compiled(template)
    own = turns.select(*[F.col(f"`{c}`").alias(a) for c, a in ((id_col, "conv_id"), (turn_col, "turn"), (role_col, "role"), (text_col, "text"))])
    id_type = own.schema["conv_id"].dataType.simpleString()
    clean = own.select("conv_id", F.struct(F.col("turn").isNull().alias("last"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("content")).alias("m"))
    talks = clean.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("m")).select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["content"].alias("content"))).alias("messages"))

    def run(batches):
        t = compiled(template)
        for batch in batches:
            text, spans, error = [], [], []
            talks = batch.column(1).to_pylist()
            for messages in talks:
                try:
                    x, found = t.render(messages=messages, max_steps=max_steps, max_chars=max_chars, **names)
                    text.append(x)
                    spans.append([{"start": a, "end": b} for a, b in found])
                    error.append(None)
                except (TemplateError, TypeError, ValueError, ArithmeticError, AttributeError, RecursionError) as e:
                    text.append(None)
                    spans.append(None)
                    error.append(f"{type(e).__name__}: {e}")
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(list(map(len, talks)), pa.int32()), pa.array(text, pa.string()), pa.array(spans, _SPANS), pa.array(error, pa.string())], names=["conv_id", "n_turns", "text", "spans", "error"])

    return talks.mapInArrow(run, f"conv_id {id_type}, n_turns int, text string, spans array<struct<start:int,end:int>>, error string")


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Spans are written as start:end, so that SQL can compare them."""
    found = render(spark.read.parquet(f"{sf_dir}/conversations.parquet"))
    return found.select("conv_id", "n_turns", "text", F.array_join(F.transform("spans", lambda x: F.concat_ws(":", x["start"], x["end"])), " ").alias("spans"), "error")


SQL = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS content,
    CASE WHEN role = 'assistant' THEN '<|im_start|>assistant' || chr(10) ELSE '<|im_start|>' || coalesce(role, '') || chr(10) END AS head,
    trim(coalesce(text, ''), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) || '<|im_end|>' AS body
  FROM conversations),
placed AS (
  SELECT *, coalesce(sum(length(head) + length(body) + 1) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT + length(head) AS start
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS LAST, role, content))
SELECT conv_id, count(*)::INT AS n_turns,
  string_agg(head || body || chr(10), '' ORDER BY turn NULLS LAST, role, content) AS text,
  coalesce(string_agg(start || ':' || (start + length(body)), ' ' ORDER BY start) FILTER (role = 'assistant'), '') AS spans,
  NULL::VARCHAR AS error
FROM placed GROUP BY conv_id
"""
