"""Chat formatting: a small sandboxed template language compiled to Python closures.

Template language::

    {{ expression }}
    {% for turn in turns %} ... {% endfor %}
    {% if expression %} ... {% elif expression %} ... {% else %} ... {% endif %}
    {% generation %} ... {% endgeneration %}     text below it is under the loss mask

Expressions: string literals, ``turn.role``, ``turn.text``, ``loop.first``,
``loop.last``, ``loop.index0``, ``a + b`` (text), ``==``, ``!=``, ``not``,
``and``, ``or``, parentheses and the filters ``escape``, ``trim``, ``upper``,
``lower``. Nothing else can be named: there are no attributes of Python objects,
calls, indexing or imports, so a template can neither reach the interpreter nor
loop beyond the turns.

Source -> tokens -> syntax tree -> folded tree -> closures. Folding evaluates
constant expressions, drops branches with a constant condition and joins
neighbouring literal text.

``escape`` makes texts unable to hold a marker and is reversible: ``\\`` becomes
``\\\\``, ``<`` becomes ``\\l`` and ``>`` becomes ``\\g``. Every marker of the default
template stands between ``<`` and ``>``, so no text or role can imitate one.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_TEMPLATE = (
    "{% for turn in turns %}<turn {{ turn.role | escape }}>\n"
    "{% if turn.role == 'assistant' %}{% generation %}{{ turn.text | escape }}{% endgeneration %}"
    "{% else %}{{ turn.text | escape }}{% endif %}</turn>\n{% endfor %}"
)
NAMES = {"turn.role", "turn.text", "loop.first", "loop.last", "loop.index0"}


class TemplateError(ValueError):
    pass


def escape(text: str) -> str:
    return text.replace("\\", "\\\\").replace("<", "\\l").replace(">", "\\g")


_ESCAPED = re.compile(r"\\(.)", re.S)


def unescape(text: str) -> str:
    return _ESCAPED.sub(lambda m: {"l": "<", "g": ">"}.get(m[1], m[1]), text) if "\\" in text else text


FILTERS: dict[str, Callable[[str], str]] = {
    "escape": escape, "trim": str.strip, "upper": str.upper, "lower": str.lower,
}

# ---- syntax tree: tuples whose first item names the node -----------------------------------

_TAG = re.compile(r"\{\{(.*?)\}\}|\{%(.*?)%\}", re.S)
_TOKEN = re.compile(
    r"""\s*(?:(?P<str>'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*")|(?P<name>[A-Za-z_][A-Za-z_0-9]*(?:\.[A-Za-z_][A-Za-z_0-9]*)?)|(?P<op>==|!=|[()|+]))"""
)
_LITERAL_ESCAPES = {"n": "\n", "t": "\t"}


class _Expression:
    """Recursive descent over ``or < and < not < == < + < filter``."""

    def __init__(self, source: str):
        self.items, at = [], 0
        source = source.rstrip()
        while at < len(source):
            m = _TOKEN.match(source, at)
            if not m:
                raise TemplateError(f"cannot read {source[at:]!r}")
            self.items.append((m.lastgroup, m[m.lastgroup]))
            at = m.end()
        self.at = 0

    def peek(self):
        return self.items[self.at] if self.at < len(self.items) else (None, None)

    def take(self, value=None):
        kind, text = self.peek()
        if kind is None or value is not None and text != value:
            raise TemplateError(f"expected {value or 'an operand'}, found {text!r}")
        self.at += 1
        return kind, text

    def parse(self):
        node = self.either()
        if self.peek()[0] is not None:
            raise TemplateError(f"unexpected {self.peek()[1]!r}")
        return node

    def either(self):
        node = self.both()
        while self.peek() == ("name", "or"):
            self.take()
            node = ("or", node, self.both())
        return node

    def both(self):
        node = self.negated()
        while self.peek() == ("name", "and"):
            self.take()
            node = ("and", node, self.negated())
        return node

    def negated(self):
        if self.peek() == ("name", "not"):
            self.take()
            return ("not", self.negated())
        return self.compared()

    def compared(self):
        node = self.joined()
        if self.peek()[1] in ("==", "!=") and self.peek()[0] == "op":
            op = self.take()[1]
            node = (op, node, self.joined())
        return node

    def joined(self):
        node = self.filtered()
        while self.peek() == ("op", "+"):
            self.take()
            node = ("+", node, self.filtered())
        return node

    def filtered(self):
        node = self.operand()
        while self.peek() == ("op", "|"):
            self.take()
            name = self.take()[1]
            if name not in FILTERS:
                raise TemplateError(f"unknown filter {name!r}")
            node = ("filter", name, node)
        return node

    def operand(self):
        kind, text = self.take()
        if kind == "str":
            return ("const", re.sub(r"\\(.)", lambda m: _LITERAL_ESCAPES.get(m[1], m[1]), text[1:-1], flags=re.S))
        if kind == "name":
            if text not in NAMES:
                raise TemplateError(f"unknown name {text!r}")
            return ("name", text)
        if text == "(":
            node = self.either()
            self.take(")")
            return node
        raise TemplateError(f"unexpected {text!r}")


def parse(source: str) -> list[tuple]:
    """Template source -> list of nodes."""
    pieces, at = [], 0
    for m in _TAG.finditer(source):
        if m.start() > at:
            pieces.append(("text", source[at : m.start()]))
        pieces.append(("print", m[1].strip()) if m[1] is not None else ("tag", m[2].strip()))
        at = m.end()
    if at < len(source):
        pieces.append(("text", source[at:]))
    pos = 0

    def block(until: tuple[str, ...], inside: str) -> tuple[list[tuple], str]:
        nonlocal pos
        nodes: list[tuple] = []
        while pos < len(pieces):
            kind, text = pieces[pos]
            pos += 1
            if kind == "text":
                nodes.append(("text", text))
            elif kind == "print":
                nodes.append(("print", _Expression(text).parse()))
            else:
                word = text.split(None, 1)[0] if text else ""
                if word in until:
                    return nodes, text
                if word == "for":
                    if text.split() != ["for", "turn", "in", "turns"] or inside:
                        raise TemplateError("only one level of 'for turn in turns'")
                    body, _ = block(("endfor",), "for")
                    nodes.append(("for", body))
                elif word == "if":
                    nodes.append(branch(text, inside))
                elif word == "generation":
                    body, _ = block(("endgeneration",), inside)
                    nodes.append(("generation", body))
                else:
                    raise TemplateError(f"unexpected tag {text!r}")
        if until:
            raise TemplateError(f"missing {until[-1]}")
        return nodes, ""

    def branch(text: str, inside: str) -> tuple:
        test = _Expression(text.split(None, 1)[1] if " " in text else "").parse()
        body, stop = block(("elif", "else", "endif"), inside)
        if stop.startswith("elif"):
            return ("if", test, body, [branch(stop, inside)])
        other = block(("endif",), inside)[0] if stop.startswith("else") else []
        return ("if", test, body, other)

    return block((), "")[0]


# ---- constant folding ----------------------------------------------------------------------


def fold_expression(node: tuple) -> tuple:
    kind = node[0]
    if kind in ("const", "name"):
        return node
    if kind == "filter":
        inner = fold_expression(node[2])
        return ("const", FILTERS[node[1]](_text(inner[1]))) if inner[0] == "const" else ("filter", node[1], inner)
    if kind == "not":
        inner = fold_expression(node[1])
        return ("const", not inner[1]) if inner[0] == "const" else ("not", inner)
    a, b = fold_expression(node[1]), fold_expression(node[2])
    if kind in ("and", "or") and a[0] == "const":
        return b if bool(a[1]) == (kind == "and") else a
    if a[0] == b[0] == "const":
        return ("const", {"==": a[1] == b[1], "!=": a[1] != b[1], "+": _text(a[1]) + _text(b[1])}.get(kind))
    return (kind, a, b)


def fold(nodes: list[tuple]) -> list[tuple]:
    out: list[tuple] = []

    def add(node: tuple) -> None:
        if node[0] == "text" and out and out[-1][0] == "text":
            out[-1] = ("text", out[-1][1] + node[1])
        elif node[0] != "text" or node[1]:
            out.append(node)

    for node in nodes:
        if node[0] == "print":
            e = fold_expression(node[1])
            add(("text", _text(e[1])) if e[0] == "const" else ("print", e))
        elif node[0] == "if":
            test = fold_expression(node[1])
            if test[0] == "const":
                for x in fold(node[2] if test[1] else node[3]):
                    add(x)
            else:
                add(("if", test, fold(node[2]), fold(node[3])))
        elif node[0] in ("for", "generation"):
            add((node[0], fold(node[1])))
        else:
            add(node)
    return out


def _text(value) -> str:
    return value if isinstance(value, str) else str(value).lower() if isinstance(value, bool) else str(value)


# ---- closures ------------------------------------------------------------------------------


def _value(node: tuple) -> Callable[[dict], object]:
    kind = node[0]
    if kind == "const":
        return lambda env, v=node[1]: v
    if kind == "name":
        return lambda env, k=node[1]: env.get(k, "")
    if kind == "filter":
        f, inner = FILTERS[node[1]], _value(node[2])
        return lambda env: f(_text(inner(env)))
    if kind == "not":
        inner = _value(node[1])
        return lambda env: not inner(env)
    a, b = _value(node[1]), _value(node[2])
    return {
        "==": lambda env: a(env) == b(env),
        "!=": lambda env: a(env) != b(env),
        "+": lambda env: _text(a(env)) + _text(b(env)),
        "and": lambda env: a(env) and b(env),
        "or": lambda env: a(env) or b(env),
    }[kind]


def _writer(nodes: list[tuple]) -> Callable[[dict, list], None]:
    """Closure that appends ``(text, under the loss mask)`` pieces for one turn (or for the text around the loop)."""
    steps: list[Callable[[dict, list], None]] = []
    for node in nodes:
        if node[0] == "text":
            steps.append(lambda env, out, t=node[1]: out.append((t, False)))
        elif node[0] == "print":
            steps.append(lambda env, out, v=_value(node[1]): out.append((_text(v(env)), False)))
        elif node[0] == "if":

            def choose(env, out, test=_value(node[1]), yes=_writer(node[2]), no=_writer(node[3])):
                (yes if test(env) else no)(env, out)

            steps.append(choose)
        elif node[0] == "generation":

            def masked(env, out, body=_writer(node[1])):
                inner: list = []
                body(env, inner)
                out.append(("".join(t for t, _ in inner), True))

            steps.append(masked)
        else:
            raise TemplateError("'for' must stand at the top level")

    def write(env: dict, out: list) -> None:
        for step in steps:
            step(env, out)

    return write


Rendered = tuple[str, list[tuple[int, int]]]


class ChatTemplate:
    """A compiled template. ``render`` yields formatted text in chunks with the loss spans inside each chunk."""

    def __init__(self, source: str = DEFAULT_TEMPLATE):
        self.tree = fold(parse(source))
        loops = [k for k, node in enumerate(self.tree) if node[0] == "for"]
        if len(loops) != 1:
            raise TemplateError("a template has exactly one 'for turn in turns'")
        at = loops[0]
        self._head, self._turn, self._tail = (
            _writer(self.tree[:at]), _writer(self.tree[at][1]), _writer(self.tree[at + 1 :]),
        )

    @staticmethod
    def _chunk(write, env: dict) -> Rendered:
        pieces: list = []
        write(env, pieces)
        spans, n = [], 0
        for text, masked in pieces:
            if masked and text:
                spans.append((n, n + len(text)))
            n += len(text)
        return "".join(t for t, _ in pieces), spans

    def render(self, turns: Iterable[tuple[str | None, str | None]]) -> Iterator[Rendered]:
        """One chunk for the text before the loop, one per turn, one after it. Memory: one turn (and the next)."""
        yield self._chunk(self._head, {})
        ahead, k = iter(turns), 0
        current = next(ahead, None)
        while current is not None:
            after = next(ahead, None)
            env = {
                "turn.role": current[0] or "", "turn.text": current[1] or "",
                "loop.first": k == 0, "loop.last": after is None, "loop.index0": k,
            }
            yield self._chunk(self._turn, env)
            current, k = after, k + 1
        yield self._chunk(self._tail, {})


# ---- the Spark operator ---------------------------------------------------------------------

PART_CHARS = 1 << 20
FORMATTED = "conv_id long, part long, last boolean, formatted string, loss_spans array<struct<start:long,end:long>>"


def format_conversations(
    conversations: DataFrame, template: str = DEFAULT_TEMPLATE, part_chars: int = PART_CHARS
) -> DataFrame:
    """Render every conversation: rows ``conv_id, part, last, formatted, loss_spans``.

    The formatted text of a conversation is the concatenation of its parts; a part ends after the
    turn with which it reaches ``part_chars`` characters, ``last`` marks the final part, and
    ``loss_spans`` are code-point ranges inside the part. Turns are ordered by (turn, role, text), so
    repeated rows and ties give one defined result. Null text or role: empty; rows with a null
    conv_id form a conversation of their own. Other columns are ignored. An empty table gives no rows.

    One shuffle by conv_id. A task streams its sorted rows and holds one turn and one part, so a
    conversation with any share of all rows needs no more memory than a short one. The parts of a
    conversation follow one another in the output.
    """
    ChatTemplate(template)  # a bad template fails here, not in a task
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text")
    schema = pa.schema([
        ("conv_id", pa.int64()), ("part", pa.int64()), ("last", pa.bool_()), ("formatted", pa.string()),
        ("loss_spans", pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))),
    ])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compiled = ChatTemplate(template)
        for out in _grouped_parts(compiled, batches, part_chars):
            yield pa.RecordBatch.from_pylist(out, schema=schema)

    return ordered.mapInArrow(run, FORMATTED)


def _grouped_parts(compiled: ChatTemplate, batches, part_chars: int) -> Iterator[list[dict]]:
    flat = (
        (c, r, t)
        for b in batches
        for c, r, t in zip(b.column("conv_id").to_pylist(), b.column("role").to_pylist(), b.column("text").to_pylist(), strict=True)
    )
    pending: list = []  # the first row of the next conversation

    def turns_of(first):
        yield first[1], first[2]
        for row in flat:
            if row[0] != first[0]:
                pending.append(row)
                return
            yield row[1], row[2]

    rows: list[dict] = []
    held = 0
    first = next(flat, None)
    while first is not None:
        text: list[str] = []
        spans: list[dict] = []
        n = part = 0
        for chunk, marks in compiled.render(turns_of(first)):
            if n >= part_chars:
                rows.append({"conv_id": first[0], "part": part, "last": False, "formatted": "".join(text), "loss_spans": spans})
                held, part, n, text, spans = held + n, part + 1, 0, [], []
                if held >= part_chars:
                    yield rows
                    rows, held = [], 0
            spans += [{"start": n + a, "end": n + b} for a, b in marks]
            text.append(chunk)
            n += len(chunk)
        rows.append({"conv_id": first[0], "part": part, "last": True, "formatted": "".join(text), "loss_spans": spans})
        held += n
        if held >= part_chars or len(rows) >= 2000:
            yield rows
            rows, held = [], 0
        first = pending.pop() if pending else None
    if rows:
        yield rows


def read_turns(formatted: str) -> list[tuple[str, str]]:
    """Parse text formatted by ``DEFAULT_TEMPLATE`` back into (role, text) turns."""
    out, at = [], 0
    while at < len(formatted):
        head = formatted.index(">", at)
        end = formatted.index("</turn>\n", head)
        out.append((unescape(formatted[at + len("<turn ") : head]), unescape(formatted[head + 2 : end])))
        at = end + len("</turn>\n")
    return out


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


def read_back(formatted: DataFrame) -> DataFrame:
    """Digest rows per conversation, read from the output of ``format_conversations``.

    Runs in the same stage (the parts of a conversation follow one another in order). SHA-256 of an
    ordered text is a chain, so one task streams a conversation's parts; it holds one part at a time.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        turns, loss = hashlib.sha256(), hashlib.sha256()
        n_turns = loss_chars = chars = 0
        for b in batches:
            out = []
            for row in b.to_pylist():
                text = row["formatted"]
                for role, said in read_turns(text):
                    turns.update(f"{role}\n{said}\n".encode())
                    n_turns += 1
                for span in row["loss_spans"]:
                    said = unescape(text[span["start"] : span["end"]])
                    loss.update(said.encode())
                    loss_chars += len(said)
                chars += len(text)
                if row["last"]:
                    out.append((row["conv_id"], n_turns, turns.hexdigest(), loss_chars, loss.hexdigest(), chars))
                    turns, loss = hashlib.sha256(), hashlib.sha256()
                    n_turns = loss_chars = chars = 0
            cols = list(zip(*out, strict=True)) if out else [[]] * 6
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64()]
            names = [x.split()[0] for x in DIGESTS.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds, strict=True)], names=names)

    return formatted.mapInArrow(run, DIGESTS)
