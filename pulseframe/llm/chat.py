"""Chat formatting by a small sandboxed template language compiled to Python closures.

Template text is cut into output, `{{ expression }}` and `{% statement %}` parts, parsed into a
syntax tree, folded where operands are constants, and turned into nested closures. There is no
attribute or function access beyond the names below, no loops but over the given sequences, and
no imports; a template can only read the values it is given.

Statements: for/endfor, if/elif/else/endif, set, generation/endgeneration.
Expressions: literals, names, item access with `.name` or `['name']`, + ~ == != < > <= >=, in,
not, and, or, parentheses, `a if c else b`, filters `| trim`, `| escape`, `| upper`, `| lower`,
`| length`, and `loop.first`, `loop.last`, `loop.index`, `loop.index0`.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

# Control strings of the format below.
CONTROLS = ("<s>", "</s>", "[INST]", "[/INST]", "[SYS]", "[/SYS]")
# A control string inside a text is broken up after its first character; so is the breaker itself.
ESCAPE = "\\"

TEMPLATE = (
    "<s>{% for m in messages %}"
    "{% if m.role == 'user' %}[INST] {{ m.text | escape }} [/INST]"
    "{% elif m.role == 'assistant' %} {% generation %}{{ m.text | escape }}{% endgeneration %}</s>"
    "{% else %}[SYS] {{ m.role | escape }}\n{{ m.text | escape }} [/SYS]{% endif %}"
    "{% endfor %}"
)


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    """Put a backslash before every character that starts a control string, and before every backslash."""
    return re.sub(r"[\\<\[]", lambda m: ESCAPE + m[0], text)


def unescape(text: str) -> str:
    return re.sub(r"\\(.)", r"\1", text, flags=re.S)


FILTERS: dict[str, Callable] = {"trim": str.strip, "escape": escape, "upper": str.upper, "lower": str.lower, "length": len}
_PART = re.compile(r"(\{\{.*?\}\}|\{%.*?%\})", re.S)
_WORD = re.compile(r"\s*(?:(?P<num>\d+)|(?P<str>'(?:[^'\\]|\\.)*'|\"(?:[^\"\\]|\\.)*\")|(?P<name>[A-Za-z_]\w*)|(?P<op>==|!=|<=|>=|[-+~<>()\[\].|,]))", re.S)


def _words(source: str) -> list[tuple[str, str]]:
    out, at, source = [], 0, source.strip()
    while at < len(source):
        m = _WORD.match(source, at)
        if not m:
            raise TemplateError(f"cannot read {source[at:at + 20]!r}")
        out.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    return out


class _Expression:
    """Words to a syntax tree of tuples: ('const', v), ('name', n), ('item', e, key), ('filter', f, e), ('op', o, a, b), ..."""

    def __init__(self, words: list[tuple[str, str]]) -> None:
        self.words, self.at = words, 0

    def peek(self) -> str | None:
        return self.words[self.at][1] if self.at < len(self.words) and self.words[self.at][0] in ("op", "name") else None

    def take(self, *values: str) -> bool:
        if self.peek() in values:
            self.at += 1
            return True
        return False

    def need(self, value: str) -> None:
        if not self.take(value):
            raise TemplateError(f"{value!r} expected")

    def whole(self):
        node = self.choice()
        if self.at < len(self.words):
            raise TemplateError(f"unexpected {self.words[self.at][1]!r}")
        return node

    def choice(self):
        node = self.either()
        if self.take("if"):
            test = self.either()
            self.need("else")
            return ("choice", test, node, self.choice())
        return node

    def either(self):
        node = self.both()
        while self.take("or"):
            node = ("op", "or", node, self.both())
        return node

    def both(self):
        node = self.negation()
        while self.take("and"):
            node = ("op", "and", node, self.negation())
        return node

    def negation(self):
        return ("not", self.negation()) if self.take("not") else self.comparison()

    def comparison(self):
        node = self.joined()
        while (o := self.peek()) in ("==", "!=", "<", ">", "<=", ">=", "in"):
            self.at += 1
            node = ("op", o, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while (o := self.peek()) in ("+", "~"):
            self.at += 1
            node = ("op", o, node, self.filtered())
        return node

    def filtered(self):
        node = self.item()
        while self.take("|"):
            kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
            if kind != "name" or name not in FILTERS:
                raise TemplateError(f"no filter {name!r}")
            self.at += 1
            node = ("filter", name, node)
        return node

    def item(self):
        node = self.atom()
        while True:
            if self.take("."):
                kind, name = self.words[self.at] if self.at < len(self.words) else ("", "")
                if kind != "name" or name.startswith("_"):
                    raise TemplateError(f"no item {name!r}")
                self.at += 1
                node = ("item", node, ("const", name))
            elif self.take("["):
                key = self.choice()
                self.need("]")
                node = ("item", node, key)
            else:
                return node

    def atom(self):
        if self.at >= len(self.words):
            raise TemplateError("expression ends too early")
        kind, value = self.words[self.at]
        self.at += 1
        if kind == "num":
            return ("const", int(value))
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), value[1:-1], flags=re.S))
        if kind == "name":
            fixed = {"true": True, "false": False, "none": None}
            if value in fixed:
                return ("const", fixed[value])
            if value.startswith("_"):
                raise TemplateError(f"no name {value!r}")
            return ("name", value)
        if value == "(":
            node = self.choice()
            self.need(")")
            return node
        raise TemplateError(f"unexpected {value!r}")


def parse(source: str) -> list:
    """Syntax tree of a template: ('text', s), ('out', e), ('set', n, e), ('if', [(e, body)], body), ('for', n, e, body), ('gen', body)."""
    root: list = []
    stack: list[list] = [["root", root]]
    for i, part in enumerate(_PART.split(source)):
        body = stack[-1][-1]
        if i % 2 == 0:
            if part:
                body.append(("text", part))
        elif part.startswith("{{"):
            body.append(("out", _Expression(_words(part[2:-2])).whole()))
        else:
            words = _words(part[2:-2].strip("-"))
            head = words[0][1] if words else ""
            if head == "for":
                if len(words) < 4 or words[1][0] != "name" or words[2][1] != "in":
                    raise TemplateError("for NAME in EXPRESSION expected")
                node = ["for", words[1][1], _Expression(words[3:]).whole(), []]
                stack.append(node)
            elif head == "if":
                stack.append(["if", [(_Expression(words[1:]).whole(), first := [])], first])
            elif head in ("elif", "else") and stack[-1][0] == "if":
                test = _Expression(words[1:]).whole() if head == "elif" else ("const", True)
                new: list = []
                stack[-1][1].append((test, new))
                stack[-1][-1] = new
            elif head == "generation":
                stack.append(["gen", []])
            elif head == "set" and len(words) > 3 and words[1][0] == "name" and part.count("="):
                raise TemplateError("set is written {% set NAME EXPRESSION %}")
            elif head == "set" and len(words) >= 3 and words[1][0] == "name":
                body.append(("set", words[1][1], _Expression(words[2:]).whole()))
            elif head in ("endfor", "endif", "endgeneration") and stack[-1][0] == {"endfor": "for", "endif": "if", "endgeneration": "gen"}[head]:
                done = stack.pop()
                node = ("if", done[1]) if done[0] == "if" else tuple(done)
                stack[-1][-1].append(node)
            else:
                raise TemplateError(f"unexpected statement {head!r}")
    if len(stack) > 1:
        raise TemplateError(f"{stack[-1][0]} is not ended")
    return root


_OPERATIONS: dict[str, Callable] = {
    "+": lambda a, b: a + b, "~": lambda a, b: f"{a}{b}", "==": lambda a, b: a == b, "!=": lambda a, b: a != b,
    "<": lambda a, b: a < b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, ">=": lambda a, b: a >= b, "in": lambda a, b: a in b,
}


def fold_expression(e):
    """Work out what depends on constants only."""
    kind = e[0]
    if kind == "op":
        a, b = fold_expression(e[2]), fold_expression(e[3])
        if e[1] in ("and", "or"):
            if a[0] == "const":
                return b if bool(a[1]) == (e[1] == "and") else a
        elif a[0] == b[0] == "const":
            return ("const", _OPERATIONS[e[1]](a[1], b[1]))
        return ("op", e[1], a, b)
    if kind == "not":
        a = fold_expression(e[1])
        return ("const", not a[1]) if a[0] == "const" else ("not", a)
    if kind == "filter":
        a = fold_expression(e[2])
        return ("const", FILTERS[e[1]](a[1])) if a[0] == "const" else ("filter", e[1], a)
    if kind == "choice":
        t, a, b = map(fold_expression, e[1:])
        return (a if t[1] else b) if t[0] == "const" else ("choice", t, a, b)
    if kind == "item":
        return ("item", fold_expression(e[1]), fold_expression(e[2]))
    return e


def fold(body: list) -> list:
    """Fold expressions, drop branches that cannot be taken and join neighbouring texts."""
    out: list = []
    for node in body:
        kind = node[0]
        if kind == "out":
            e = fold_expression(node[1])
            node = ("text", _shown(e[1])) if e[0] == "const" else ("out", e)
        elif kind == "set":
            node = ("set", node[1], fold_expression(node[2]))
        elif kind == "for":
            node = ("for", node[1], fold_expression(node[2]), fold(node[3]))
        elif kind == "gen":
            node = ("gen", fold(node[1]))
        elif kind == "if":
            arms = []
            for test, arm in node[1]:
                test = fold_expression(test)
                if test[0] == "const" and not test[1]:
                    continue
                arms.append((test, fold(arm)))
                if test[0] == "const":
                    break
            if not arms:
                continue
            if arms[0][0][0] == "const":
                for x in arms[0][1]:
                    _append(out, x)
                continue
            node = ("if", arms)
        _append(out, node)
    return out


def _append(out: list, node) -> None:
    if node[0] == "text" and out and out[-1][0] == "text":
        out[-1] = ("text", out[-1][1] + node[1])
    elif node != ("text", ""):
        out.append(node)


def _shown(v) -> str:
    return "" if v is None else v if isinstance(v, str) else str(v)


def _compile_expression(e) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        v = e[1]
        return lambda env: v
    if kind == "name":
        n = e[1]
        return lambda env: env.get(n)
    if kind == "item":
        of, key = _compile_expression(e[1]), _compile_expression(e[2])

        def item(env):
            x, k = of(env), key(env)
            if isinstance(x, dict):
                return x.get(k)
            return x[k] if isinstance(x, (list, tuple, str)) and isinstance(k, int) and -len(x) <= k < len(x) else None

        return item
    if kind == "filter":
        f, a = FILTERS[e[1]], _compile_expression(e[2])
        return (lambda env: f(a(env))) if e[1] == "length" else lambda env: f(_shown(a(env)))
    if kind == "not":
        a = _compile_expression(e[1])
        return lambda env: not a(env)
    if kind == "choice":
        t, a, b = map(_compile_expression, e[1:])
        return lambda env: a(env) if t(env) else b(env)
    a, b = _compile_expression(e[2]), _compile_expression(e[3])
    if e[1] == "and":
        return lambda env: a(env) and b(env)
    if e[1] == "or":
        return lambda env: a(env) or b(env)
    o = _OPERATIONS[e[1]]
    return lambda env: o(a(env), b(env))


# A closure yields (text, whether it is inside generation markers).
Part = Callable[[dict, bool], Iterator[tuple[str, bool]]]


def _compile(body: list) -> Part:
    steps: list[Part] = [_compile_node(n) for n in body]

    def run(env: dict, gen: bool):
        for s in steps:
            yield from s(env, gen)

    return run


def _compile_node(node) -> Part:
    kind = node[0]
    if kind == "text":
        text = node[1]

        def constant(env, gen):
            yield text, gen

        return constant
    if kind == "out":
        e = _compile_expression(node[1])

        def output(env, gen):
            yield _shown(e(env)), gen

        return output
    if kind == "set":
        name, e = node[1], _compile_expression(node[2])

        def assign(env, gen):
            env[name] = e(env)
            return
            yield

        return assign
    if kind == "gen":
        inner = _compile(node[1])
        return lambda env, gen: inner(env, True)
    if kind == "if":
        arms = [(_compile_expression(t), _compile(b)) for t, b in node[1]]

        def branch(env, gen):
            for test, arm in arms:
                if test(env):
                    yield from arm(env, gen)
                    return

        return branch
    name, e, inner = node[1], _compile_expression(node[2]), _compile(node[3])

    def loop(env, gen):
        # One item is read ahead, so the sequence may be an iterator of any length.
        items, done = iter(e(env) or ()), object()
        at, cur = 0, next(items, done)
        while cur is not done:
            nxt = next(items, done)
            yield from inner({**env, name: cur, "loop": {"index": at + 1, "index0": at, "first": at == 0, "last": nxt is done}}, gen)
            at, cur = at + 1, nxt

    return loop


@lru_cache(maxsize=32)
def compile_template(source: str) -> Part:
    return _compile(fold(parse(source)))


def render(source: str, messages: Iterable[dict], **values) -> Iterator[tuple[str, bool]]:
    """(text, under the loss mask) parts of the formatted conversation, in order."""
    return compile_template(source)(dict(values, messages=messages), False)


class Reader:
    """Reads output of TEMPLATE back, piece by piece: turns (role, text) and the text under the loss mask.

    Control strings are found by a backslash-aware scan; only the turn being read is buffered.
    """

    _CONTROL = re.compile(r"\\.|" + "|".join(re.escape(c) for c in CONTROLS), re.S)

    def __init__(self) -> None:
        self._rest, self._open = "", None
        self.started = False

    def feed(self, piece: str) -> Iterator[tuple[str, str]]:
        self._rest += piece
        at = body = 0
        for m in self._CONTROL.finditer(self._rest):
            c = m[0]
            if c[0] == ESCAPE:
                continue
            text = self._rest[body : m.start()]
            if c == "[/INST]" and self._open == "[INST]":
                yield "user", unescape(text[1:-1])
            elif c == "[/SYS]" and self._open == "[SYS]":
                role, _, said = text[1:-1].partition("\n")
                yield unescape(role), unescape(said)
            elif c == "</s>" and self._open is None:
                yield "assistant", unescape(text[1:])
            elif c == "<s>" and not self.started:
                self.started = True
            elif c in ("[INST]", "[SYS]") and self._open is None:
                self._open = c
                at = body = m.end()
                continue
            else:
                raise ValueError(f"unexpected {c}")
            self._open = None
            at = body = m.end()
        if at:
            # Keep the unread tail, with its opening control string put back by the state.
            self._rest = self._rest[at:]


class Digest:
    """Digests of one conversation, read back from its formatted text as it is made."""

    def __init__(self) -> None:
        self.turns, self.loss, self.n, self.loss_chars, self.chars = hashlib.sha256(), hashlib.sha256(), 0, 0, 0
        self._reader, self._tail, self._held = Reader(), "", []

    def add(self, text: str, masked: bool) -> None:
        self.chars += len(text)
        if masked:
            said = unescape(text)
            self.loss_chars += len(said)
            self.loss.update(said.encode("utf-8", "surrogatepass"))
        self._held.append(text)
        # A turn ends with one of these; reading waits for it, so long texts are scanned once.
        if text.endswith(("[/INST]", "[/SYS]", "</s>")) or "[/INST]" in text or "</s>" in text or "[/SYS]" in text:
            self._read()

    def _read(self) -> None:
        piece, self._held = "".join(self._held), []
        for role, said in self._reader.feed(piece):
            self.n += 1
            self.turns.update(f"{role}\n{said}\n".encode("utf-8", "surrogatepass"))

    def result(self) -> tuple:
        self._read()
        return self.n, self.turns.hexdigest(), self.loss_chars, self.loss.hexdigest(), self.chars


def _ordered(turns: DataFrame, id_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    rows = turns.select(F.col(id_col).cast("long").alias("id"), F.col(turn_col).cast("long").alias("turn"), F.coalesce(F.col(role_col), F.lit("")).alias("role"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.repartition("id").sortWithinPartitions(F.col("id").asc_nulls_first(), F.col("turn").asc_nulls_first(), "role", "text").select("id", "role", "text")


def _grouped(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, Iterator[dict]]]:
    """Conversations of rows sorted by id, streamed: no conversation is held whole."""
    def rows():
        for b in batches:
            yield from zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist())

    source = rows()
    ahead = next(source, None)
    while ahead is not None:
        key = ahead[0]

        def messages():
            nonlocal ahead
            while ahead is not None and ahead[0] == key:
                cur, ahead = ahead, next(source, None)
                yield {"role": cur[1], "text": cur[2]}

        yield key, messages()


def format_conversations(turns: DataFrame, template: str = TEMPLATE, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """One row per conversation: id, text (formatted) and loss_spans, [start, end) code points under the loss mask.

    Turns are taken in the order of the turn number (null first; ties by role, then text; repeated
    rows are turns of their own). A null text or role counts as empty; a null id is a conversation
    of its own. Other columns are ignored. No rows give no rows. One shuffle, by conversation.
    """
    def run(batches):
        for key, messages in _grouped(batches):
            parts, spans, at = [], [], 0
            for text, masked in render(template, messages):
                if masked and text:
                    spans.append([at, at + len(text)])
                parts.append(text)
                at += len(text)
            yield pa.RecordBatch.from_arrays([pa.array([key], pa.int64()), pa.array(["".join(parts)]), pa.array([spans], pa.list_(pa.list_(pa.int64())))], names=["id", "text", "loss_spans"])

    out = _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(run, "id long, text string, loss_spans array<array<long>>")
    return out.withColumnRenamed("id", id_col)


def conversation_digests(turns: DataFrame, id_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text", per_batch: int = 4096) -> DataFrame:
    """What the formatted conversations say when read back: id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars.

    As format_conversations with TEMPLATE, but the formatted text is read back while it is made, so
    even a conversation with very many turns takes the memory of one turn.
    """
    names = ["id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256", "formatted_chars"]
    schema = pa.schema(list(zip(names, (pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()))))

    def run(batches):
        rows = []
        for key, messages in _grouped(batches):
            d = Digest()
            for text, masked in render(TEMPLATE, messages):
                d.add(text, masked)
            rows.append((key, *d.result()))
            if len(rows) >= per_batch:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)
                rows = []
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), schema.types)], schema=schema)

    out = _ordered(turns, id_col, turn_col, role_col, text_col).mapInArrow(run, "id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
    return out.withColumnRenamed("id", id_col)
