"""Chat formatting with a small sandboxed template language, compiled to Python closures."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import batches_of, lean

#: The template of the production query. Tags: {% for x in turns %}, {% if a == b %}, {% else %}, {% generation %},
#: {% end %}; values: {{ expression }} with names, x.field, 'text', + and | filters.
TEMPLATE = """{% for m in turns %}{{ '##' + '# ' }}{% if m.role == 'assistant' %}Assistant: {% generation %}{{ m.text | guard }}{% end %}{% else %}@{{ m.role | guard }}: {{ m.text | guard }}{% end %} </turn>{{ '\\n' }}{% end %}"""

_TOKEN = re.compile(r"\s*(?:(?P<text>'(?:[^'\\]|\\.)*')|(?P<name>[A-Za-z_]\w*)|(?P<op>==|[.+|()]))")
_TAG = re.compile(r"\{%\s*(.*?)\s*%\}|\{\{\s*(.*?)\s*\}\}", re.S)
_MARKED = re.compile(r"[\\<#:]")
_GUARDED = re.compile(r"\\(.)", re.S)


def guard(text: str) -> str:
    """Puts a backslash before every character with which a control string or an escape begins."""
    return _MARKED.sub(r"\\\g<0>", text)


def unguard(text: str) -> str:
    return _GUARDED.sub(r"\1", text)


#: The only calls that a template can make.
FILTERS: dict[str, Callable[[str], str]] = {"guard": guard, "title": str.title, "upper": str.upper, "lower": str.lower, "strip": str.strip}


def parse(template: str) -> list[tuple]:
    """Syntax tree: ("text", s), ("value", e), ("for", name, e, body), ("if", e, body, other), ("generation", body)."""
    stack: list[tuple[list, list[tuple]]] = [(["top"], [])]
    at = 0
    for m in _TAG.finditer(template):
        if m.start() > at:
            stack[-1][1].append(("text", template[at : m.start()]))
        at = m.end()
        if m[2] is not None:
            stack[-1][1].append(("value", expression(m[2])))
            continue
        word, _, rest = m[1].partition(" ")
        if word == "for" and (f := re.fullmatch(r"(\w+)\s+in\s+(.+)", rest, re.S)):
            stack.append((["for", f[1], expression(f[2])], []))
        elif word == "if" and rest:
            stack.append((["if", expression(rest)], []))
        elif word == "else" and stack[-1][0][0] == "if":
            head, body = stack.pop()
            stack.append((["else", head[1], body], []))
        elif word == "generation":
            stack.append((["generation"], []))
        elif word == "end" and len(stack) > 1:
            head, body = stack.pop()
            node = ("if", head[1], head[2], body) if head[0] == "else" else ("if", head[1], body, []) if head[0] == "if" else (*head, body)
            stack[-1][1].append(node)
        else:
            raise ValueError(f"unknown or misplaced tag: {m[0]}")
    if at < len(template):
        stack[-1][1].append(("text", template[at:]))
    if len(stack) > 1:
        raise ValueError(f"{stack[-1][0][0]} is not ended")
    return stack[0][1]


def expression(source: str) -> tuple:
    """("const", s), ("name", n), ("get", e, field), ("call", filter, e), ("add", a, b) or ("eq", a, b).

    Fields that begin with an underscore and unknown filters are refused.
    """
    tokens, at = [], 0
    while at < len(source.rstrip()):
        if not (m := _TOKEN.match(source, at)):
            raise ValueError(f"cannot read {source[at:]!r}")
        tokens.append((m.lastgroup, m[m.lastgroup]))
        at = m.end()
    tokens.append(("end", ""))

    def take(value: str | None = None, kind: str | None = None) -> str:
        k, v = tokens.pop(0)
        if (value is not None and v != value) or (kind is not None and k != kind):
            raise ValueError(f"unexpected {v!r} in {source!r}")
        return v

    def atom() -> tuple:
        kind, v = tokens.pop(0)
        if kind == "text":
            e = ("const", re.sub(r"\\(.)", lambda m: {"n": "\n", "t": "\t"}.get(m[1], m[1]), v[1:-1]))
        elif kind == "name":
            e = ("name", v)
        elif v == "(":
            e = compare()
            take(")")
        else:
            raise ValueError(f"unexpected {v!r} in {source!r}")
        while tokens[0][1] == ".":
            take(".")
            field = take(kind="name")
            if field.startswith("_"):
                raise ValueError(f"field {field} is not open to templates")
            e = ("get", e, field)
        return e

    def piped() -> tuple:
        e = atom()
        while tokens[0] == ("op", "|"):
            take("|")
            name = take(kind="name")
            if name not in FILTERS:
                raise ValueError(f"unknown filter {name}")
            e = ("call", name, e)
        return e

    def added() -> tuple:
        e = piped()
        while tokens[0] == ("op", "+"):
            take("+")
            e = ("add", e, piped())
        return e

    def compare() -> tuple:
        e = added()
        if tokens[0] == ("op", "=="):
            take("==")
            e = ("eq", e, added())
        return e

    e = compare()
    take(kind="end")
    return e


def folded(e: tuple) -> tuple:
    """Constant subexpressions become constants."""
    if e[0] == "get":
        return ("get", folded(e[1]), e[2])
    if e[0] == "call":
        x = folded(e[2])
        return ("const", FILTERS[e[1]](x[1])) if x[0] == "const" else ("call", e[1], x)
    if e[0] in ("add", "eq"):
        a, b = folded(e[1]), folded(e[2])
        if a[0] == b[0] == "const":
            return ("const", a[1] + b[1] if e[0] == "add" else a[1] == b[1])
        return (e[0], a, b)
    return e


def fold(nodes: list[tuple]) -> list[tuple]:
    """Folds expressions, decides constant ifs and joins neighbouring texts."""
    out: list[tuple] = []
    for node in nodes:
        if node[0] == "value":
            e = folded(node[1])
            new = [("text", str(e[1]))] if e[0] == "const" else [("value", e)]
        elif node[0] == "if":
            e = folded(node[1])
            new = fold(node[2] if e[1] else node[3]) if e[0] == "const" else [("if", e, fold(node[2]), fold(node[3]))]
        elif node[0] == "for":
            new = [("for", node[1], folded(node[2]), fold(node[3]))]
        elif node[0] == "generation":
            new = [("generation", fold(node[1]))]
        else:
            new = [node]
        for x in new:
            if x[0] == "text" and out and out[-1][0] == "text":
                out[-1] = ("text", out[-1][1] + x[1])
            else:
                out.append(x)
    return out


def _value(e: tuple) -> Callable[[dict], object]:
    kind = e[0]
    if kind == "const":
        return lambda env, v=e[1]: v
    if kind == "name":
        return lambda env, n=e[1]: env[n]
    if kind == "get":
        inner, field = _value(e[1]), e[2]
        return lambda env: inner(env)[field]
    if kind == "call":
        f, inner = FILTERS[e[1]], _value(e[2])
        return lambda env: f(inner(env))
    a, b = _value(e[1]), _value(e[2])
    return (lambda env: a(env) + b(env)) if kind == "add" else (lambda env: a(env) == b(env))


def _writer(nodes: list[tuple], marked: bool = False) -> Callable[[dict, list], None]:
    parts: list[Callable[[dict, list], None]] = []
    for node in nodes:
        if node[0] == "text":
            parts.append(lambda env, out, s=node[1]: out.append((s, marked)))
        elif node[0] == "value":
            parts.append(lambda env, out, v=_value(node[1]): out.append((v(env), marked)))
        elif node[0] == "if":
            parts.append(lambda env, out, c=_value(node[1]), a=_writer(node[2], marked), b=_writer(node[3], marked): (a if c(env) else b)(env, out))
        elif node[0] == "generation":
            parts.append(_writer(node[1], True))
        else:

            def loop(env: dict, out: list, name=node[1], over=_value(node[2]), body=_writer(node[3], marked)) -> None:
                for x in over(env):
                    body(env | {name: x}, out)

            parts.append(loop)

    def write(env: dict, out: list) -> None:
        for p in parts:
            p(env, out)

    return write


def compile_template(template: str) -> Callable[[list[dict]], tuple[str, list[tuple[int, int]]]]:
    """turns -> (text, spans under the generation mark), by closures over the folded tree."""
    write = _writer(fold(parse(template)))

    def render(turns: list[dict]) -> tuple[str, list[tuple[int, int]]]:
        out: list[tuple[str, bool]] = []
        write({"turns": turns}, out)
        spans, at = [], 0
        for s, marked in out:
            if marked:
                spans.append((at, at + len(s)))
            at += len(s)
        return "".join(s for s, _ in out), spans

    return render


def format_conversations(turns: DataFrame, template: str = TEMPLATE) -> DataFrame:
    """One row per conversation: conv_id, n_turns, formatted, loss_spans (array of start, end in code points).

    Turns are dealt by conv_id and streamed in the order of turn (ties by role, then text), so a task holds one
    conversation at a time. Null text or role counts as empty; rows without conv_id form the conversation null; an
    empty table gives an empty result; extra columns are ignored.
    """
    batches_of(turns.sparkSession, 2000)
    schema = "conv_id long, n_turns long, formatted string, loss_spans array<struct<start:int,end:int>>"
    rows = turns.selectExpr("cast(conv_id as long) conv_id", "cast(turn as long) turn", "coalesce(role, '') role", "coalesce(text, '') text")
    return rows.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "role", "text").mapInArrow(lean(_formatter(template)), schema)


def _formatter(template: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        render = compile_template(template)
        kind = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("formatted", pa.string()), ("loss_spans", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))])
        open_id, held, done = object(), [], []

        def close() -> None:
            if held:
                text, spans = render(held)
                done.append({"conv_id": open_id, "n_turns": len(held), "formatted": text, "loss_spans": [{"start": a, "end": b} for a, b in spans]})

        for b in batches:
            for r in b.to_pylist():
                if r["conv_id"] != open_id:
                    close()
                    open_id, held = r["conv_id"], []
                held.append({"role": r["role"], "text": r["text"]})
            if done:
                yield pa.RecordBatch.from_pylist(done, schema=kind)
                done.clear()
        close()
        if done:
            yield pa.RecordBatch.from_pylist(done, schema=kind)

    return run


_TURN = re.compile(r"### ((?:[^\\<#:]|\\.)*): ((?:[^\\<#:]|\\.)*) </turn>\n", re.S)


def read_back(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn in the output of TEMPLATE."""
    out, at = [], 0
    while at < len(formatted):
        m = _TURN.match(formatted, at)
        if not m:
            raise ValueError("not the output of this template")
        out.append(("assistant" if m[1] == "Assistant" else unguard(m[1][1:]), unguard(m[2])))
        at = m.end()
    return out


def formatted_digests(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256, formatted_chars, read back from formatted texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for r in b.to_pylist():
                turns = read_back(r["formatted"])
                loss = [unguard(r["formatted"][s["start"] : s["end"]]) for s in r["loss_spans"]]
                digest = lambda parts: hashlib.sha256("".join(parts).encode()).hexdigest()
                rows.append({"conv_id": r["conv_id"], "n_turns": len(turns), "turns_sha256": digest(f"{role}\n{text}\n" for role, text in turns), "loss_chars": sum(map(len, loss)), "loss_sha256": digest(loss), "formatted_chars": len(r["formatted"])})
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())]))

    return formatted.mapInArrow(lean(run), "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long")
