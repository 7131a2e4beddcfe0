"""A sandboxed template language for conversations, compiled to Python closures.

Text with ``{{ expression }}``, ``{% for x in xs %}``, ``{% if %}/{% elif %}/{% else %}``, ``{% set x = e %}``,
``{% generation %}`` (what it encloses is under the loss mask) and ``{# comment #}``. Expressions: strings, integers,
true/false/none, names, ``a.b`` and ``a['b']`` (entries of mappings only), ``+ ~ == != < <= > >= in not and or``,
``a if c else b``, and filters. Nothing reaches Python attributes, builtins or calls.

Source -> tokens -> syntax tree (tuples) -> tree with constants folded -> closures. A compiled template yields
(text, under_mask) piece by piece and reads its messages as a stream, one ahead, so a conversation of any length takes bounded memory.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable, Iterator, Mapping

#: Strings that steer a model; a text that holds one is escaped. Each starts with the only "<" or "[" that it has.
CONTROL = ("<|turn|>", "<|text|>", "<|end|>", "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]", "[/INST]")
_ESCAPED = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\*(?={re.escape(c[1:])})" for c in CONTROL))
_UNESCAPE = re.compile("|".join(f"(?<={re.escape(c[0])})\\\\+(?={re.escape(c[1:])})" for c in CONTROL))

CHAT = (
    "{% for m in messages %}<|turn|>{{ m.role | escape }}<|text|>"
    "{% if m.role == 'assistant' %}{% generation %}{{ m.text | escape }}{% endgeneration %}{% else %}{{ m.text | escape }}{% endif %}"
    "<|end|>\n{% endfor %}"
)


def escape(text: str) -> str:
    """One more backslash after the first character of each control string, however many it has already."""
    return _ESCAPED.sub(lambda m: m[0] + "\\", text)


def unescape(text: str) -> str:
    return _UNESCAPE.sub(lambda m: m[0][1:], text)


class TemplateError(ValueError):
    pass


FILTERS: dict[str, Callable] = {
    "escape": lambda x: escape(_text(x)),
    "trim": lambda x: _text(x).strip(),
    "upper": lambda x: _text(x).upper(),
    "lower": lambda x: _text(x).lower(),
    "length": lambda x: len(x),
    "string": lambda x: _text(x),
    "default": lambda x, other="": other if x is None else x,
}


def _text(x) -> str:
    return "" if x is None else "true" if x is True else "false" if x is False else str(x)


_TAG = re.compile(r"(\{\{.*?\}\}|\{%.*?%\}|\{#.*?#\})", re.S)
_LEX = re.compile(r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<int>\d+)|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>.|()\[\],=]))""", re.S)
_LITERAL = {"true": True, "false": False, "none": None, "True": True, "False": False, "None": None}


class _Expression:
    """Recursive descent over one tag's tokens."""

    def __init__(self, source: str):
        self.tokens, at, source = [], 0, source.strip()
        while at < len(source):
            if not (m := _LEX.match(source, at)):
                raise TemplateError(f"unexpected {source[at:at + 20]!r}")
            self.tokens.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self) -> str | None:
        return self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] != "str" else None

    def take(self, *want: str) -> str | None:
        if self.peek() in want:
            self.at += 1
            return self.tokens[self.at - 1][1]
        return None

    def need(self, what: str) -> None:
        if not self.take(what):
            raise TemplateError(f"expected {what!r}")

    def name(self) -> str:
        if self.at < len(self.tokens) and self.tokens[self.at][0] == "name":
            self.at += 1
            return self.tokens[self.at - 1][1]
        raise TemplateError("expected a name")

    def whole(self) -> tuple:
        out = self.choice()
        if self.at < len(self.tokens):
            raise TemplateError(f"unexpected {self.tokens[self.at][1]!r}")
        return out

    def choice(self) -> tuple:
        a = self.either()
        if self.take("if"):
            c = self.either()
            return ("choice", c, a, self.choice() if self.take("else") else ("const", None))
        return a

    def either(self) -> tuple:
        a = self.both()
        while self.take("or"):
            a = ("or", a, self.both())
        return a

    def both(self) -> tuple:
        a = self.negated()
        while self.take("and"):
            a = ("and", a, self.negated())
        return a

    def negated(self) -> tuple:
        return ("not", self.negated()) if self.take("not") else self.compared()

    def compared(self) -> tuple:
        a = self.sum()
        while op := self.take("==", "!=", "<", "<=", ">", ">=", "in", "not"):
            if op == "not":
                self.need("in")
                a = ("not", ("in", a, self.sum()))
            else:
                a = (op, a, self.sum())
        return a

    def sum(self) -> tuple:
        a = self.filtered()
        while op := self.take("+", "-", "~"):
            a = (op, a, self.filtered())
        return a

    def filtered(self) -> tuple:
        a = self.atom()
        while self.take("|"):
            f, args = self.name(), []
            if f not in FILTERS:
                raise TemplateError(f"unknown filter {f!r}")
            if self.take("("):
                while not self.take(")"):
                    args.append(self.choice())
                    self.take(",")
            a = ("filter", f, a, *args)
        return a

    def atom(self) -> tuple:
        if self.at >= len(self.tokens):
            raise TemplateError("unexpected end of expression")
        kind, value = self.tokens[self.at]
        self.at += 1
        if kind == "str":
            a = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t", "r": "\r"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        elif kind == "int":
            a = ("const", int(value))
        elif kind == "name":
            a = ("const", _LITERAL[value]) if value in _LITERAL else ("name", value)
        elif value == "(":
            a = self.choice()
            self.need(")")
        else:
            raise TemplateError(f"unexpected {value!r}")
        while op := self.take(".", "["):
            if op == ".":
                a = ("item", a, ("const", self.name()))
            else:
                a = ("item", a, self.choice())
                self.need("]")
        return a


def parse(source: str) -> tuple:
    """The syntax tree: ("block", node, ...)."""
    stack: list[list] = [["block"]]  # each open tag: its head, then the nodes of its body so far

    def close(kind: str) -> list:
        if not stack or stack[-1][0] != kind:
            raise TemplateError(f"end of {kind} without its start")
        return stack.pop()

    for part in _TAG.split(source):
        if part.startswith("{{"):
            stack[-1].append(("print", _Expression(part[2:-2]).whole()))
        elif part.startswith("{%"):
            e = _Expression(part[2:-2])
            tag = e.name()
            if tag == "for":
                var = e.name()
                e.need("in")
                stack += [["for", var, e.whole()], ["block"]]
            elif tag == "if":
                stack += [["if", e.whole()], ["block"]]
            elif tag in ("elif", "else"):
                body = close("block")
                if stack[-1][0] != "if":
                    raise TemplateError(f"{tag} outside if")
                stack[-1] += [tuple(body), e.whole() if tag == "elif" else ("const", True)]
                stack.append(["block"])
            elif tag == "set":
                var = e.name()
                e.need("=")
                stack[-1].append(("set", var, e.whole()))
            elif tag == "generation":
                stack += [["generation"], ["block"]]
            elif tag.startswith("end"):
                body = tuple(close("block"))
                node = (*close(tag[3:]), body)
                stack[-1].append(node)
            else:
                raise TemplateError(f"unknown tag {tag!r}")
        elif part and not part.startswith("{#"):
            stack[-1].append(("text", part))
    if len(stack) > 1:
        raise TemplateError(f"{stack[-2][0]} is not closed")
    return tuple(stack[0])


_BINARY: dict[str, Callable] = {
    "==": lambda a, b: a == b, "!=": lambda a, b: a != b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b,
    "in": lambda a, b: a in b, "+": lambda a, b: a + b if isinstance(a, int) and isinstance(b, int) else _text(a) + _text(b), "-": lambda a, b: a - b, "~": lambda a, b: _text(a) + _text(b),
}


def _item(a, key):
    if isinstance(a, Mapping):
        return a.get(key)
    if isinstance(a, list | tuple) and isinstance(key, int):
        return a[key] if -len(a) <= key < len(a) else None
    if a is None:
        return None
    raise TemplateError(f"no item {key!r} there")


def fold(node: tuple) -> tuple:
    """The tree with constant expressions computed, constant branches chosen, and neighbouring texts joined."""
    kind = node[0]
    if kind in ("const", "name", "text"):
        return node
    if kind == "print":
        e = fold(node[1])
        return ("text", _text(e[1])) if e[0] == "const" else ("print", e)
    if kind == "block":
        out: list[tuple] = []
        for child in map(fold, node[1:]):
            for x in child[1:] if child[0] == "block" else [child]:
                if x[0] == "text" and out and out[-1][0] == "text":
                    out[-1] = ("text", out[-1][1] + x[1])
                elif x != ("text", ""):
                    out.append(x)
        return ("block", *out)
    if kind == "if":
        arms = []
        for cond, body in zip(node[1::2], node[2::2], strict=True):
            cond = fold(cond)
            if cond[0] != "const" or cond[1]:
                arms += [cond, fold(body)]
            if cond[0] == "const" and cond[1]:
                break
        return arms[1] if arms and arms[0][0] == "const" else ("if", *arms) if arms else ("block",)
    if kind in ("for", "set"):
        return (kind, node[1], *map(fold, node[2:]))
    if kind == "filter":
        out = ("filter", node[1], *map(fold, node[2:]))
        return ("const", FILTERS[node[1]](*(x[1] for x in out[2:]))) if all(x[0] == "const" for x in out[2:]) else out
    out = (kind, *map(fold, node[1:]))
    if kind != "generation" and all(x[0] == "const" for x in out[1:]):
        return ("const", _value(out)({}))
    return out


def _value(node: tuple) -> Callable[[dict], object]:
    """A closure from the variables to the expression's value."""
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, n=node[1]: env.get(n)
    if kind == "filter":
        f, args = FILTERS[node[1]], [_value(x) for x in node[2:]]
        if len(args) == 1:
            return lambda env, a=args[0]: f(a(env))
        return lambda env: f(*(a(env) for a in args))
    a, *rest = [_value(x) for x in node[1:]]
    if kind == "not":
        return lambda env: not a(env)
    b = rest[0]
    if kind == "and":
        return lambda env: a(env) and b(env)
    if kind == "or":
        return lambda env: a(env) or b(env)
    if kind == "choice":
        return lambda env, c=rest[1]: b(env) if a(env) else c(env)
    if kind == "item":
        return lambda env: _item(a(env), b(env))
    op = _BINARY[kind]
    return lambda env: op(a(env), b(env))


Pieces = Iterator[tuple[str, bool]]


def _emit(node: tuple, masked: bool) -> Callable[[dict], Pieces]:
    """A closure from the variables to the node's pieces of output."""
    kind = node[0]
    if kind == "text":
        piece = (node[1], masked)
        return lambda env: iter((piece,))
    if kind == "print":
        value = _value(node[1])
        return lambda env: iter(((_text(value(env)), masked),))
    if kind == "set":
        value = _value(node[2])

        def assign(env: dict) -> Pieces:
            env[node[1]] = value(env)
            return iter(())

        return assign
    if kind == "generation":
        return _emit(node[1], True)
    if kind == "if":
        arms = [(_value(c), _emit(b, masked)) for c, b in zip(node[1::2], node[2::2], strict=True)]

        def branch(env: dict) -> Pieces:
            return next((body(env) for cond, body in arms if cond(env)), iter(()))

        return branch
    if kind == "for":
        var, items, body = node[1], _value(node[2]), _emit(node[3], masked)

        def loop(env: dict) -> Pieces:
            rest, nothing = iter(items(env) or ()), object()
            x, i = next(rest, nothing), 0
            while x is not nothing:
                after = next(rest, nothing)
                yield from body(env | {var: x, "loop": {"index": i + 1, "index0": i, "first": i == 0, "last": after is nothing}})
                x, i = after, i + 1

        return loop
    steps = [_emit(x, masked) for x in node[1:]]

    def block(env: dict) -> Pieces:
        for step in steps:
            yield from step(env)

    return block


class Template:
    def __init__(self, source: str):
        self.source, self.tree = source, fold(parse(source))
        self._run = _emit(self.tree, False)

    def __reduce__(self):
        return Template, (self.source,)

    def stream(self, messages: Iterable[Mapping], **variables) -> Pieces:
        return self._run(variables | {"messages": messages})

    def render(self, messages: Iterable[Mapping], **variables) -> tuple[str, list[tuple[int, int]]]:
        """The text, and the spans of code points under the loss mask."""
        out, spans, at = [], [], 0
        for text, masked in self.stream(messages, **variables):
            if masked and text:
                if spans and spans[-1][1] == at:
                    spans[-1] = (spans[-1][0], at + len(text))
                else:
                    spans.append((at, at + len(text)))
            out.append(text)
            at += len(text)
        return "".join(out), spans
