"""Secret scans (operator 3).

Three patterns give the base spans. The method then lexes source and configuration syntax
into pairs of a name and a literal: ``NAME = "x"``, ``"name": "x"``, ``export NAME=x``,
``<name>x</name>``, ``--name x``, with escapes, triple quotes, YAML blocks and literals that
``+``, ``.`` or plain adjacency put together; also literals with prefixes (``f"x"``), annotated
names and subscripts, ``key``/``name`` beside ``value``, ``#define``, setters, names asked for with
a default, credentials after a header's scheme, and passwords in URLs. Names within braces or under an indented parent
know the names around them. Names bound to other names form a graph; how sensitive a name is
goes against its edges to a fixed point, so that a literal counts for every name that it
reaches, wherever they stand. Literals are scored by the most sensitive of these and by how
random they look; those of a sufficient score are spans of kind ``named``. Comments are lexed
like other text, as secrets stand there too.

Rows are independent: no shuffle.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

#: Base patterns and the kinds' order. Fixed values.
KINDS = ("assign", "access", "hex", "named")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weights of the parts of a target name.
SENSITIVE = {
    "password": 3.0, "passwd": 3.0, "pwd": 3.0, "pass": 2.0, "passphrase": 3.0, "secret": 3.0, "token": 2.5, "apikey": 3.0,
    "credential": 2.5, "credentials": 2.5, "private": 1.5, "auth": 1.5, "authorization": 2.0, "bearer": 2.5, "access": 1.0,
    "api": 1.0, "key": 1.5, "signature": 1.5, "salt": 1.5, "session": 1.0, "cookie": 1.5, "client": 0.5, "account": 0.5, "connection": 0.5,
}
#: Words that show a literal to be a placeholder.
PLACEHOLDERS = {"example", "changeme", "placeholder", "your", "none", "null", "true", "false", "xxxx", "todo", "redacted"}

#: Names that only say that their parent's value follows.
CARRIERS = {"value", "data", "content", "raw", "text", "string", "default", "literal", "stringdata"}

# Lengths have no bound: names, blanks and literals exclude what ends them, so they never give back what they took.
_NAME = r"[A-Za-z_][A-Za-z0-9_.\-]*+"
_DQ, _SQ = r"(?:[^\"\\\r\n]|\\.)++", r"(?:[^'\\\r\n]|\\.)++"
#: Letters before a quote, and a type between a name and its literal.
_PREFIX = r"(?:[rRbBuUfF]{1,2}|[@$L])?+"
_TYPE = rf"""(?::[\x20\t]*+[A-Za-z_][A-Za-z0-9_.\[\]|]*+[\x20\t]++(?==[\x20\t]*+{_PREFIX}["']))?+"""
_TOKEN = re.compile(
    rf"""(?<![A-Za-z0-9_.\-])["'`]?(?P<name>{_NAME})["'`]?\]?+[\x20\t]*+{_TYPE}(?::=|=>|[:=])[\x20\t]*+"""
    rf"""(?:{_PREFIX}(?:\"\"\"(?P<tq>(?:[^"\\]|\\.|"(?!""))++)\"\"\"|"(?P<dq>{_DQ})"|'(?P<sq>{_SQ})')|`(?P<bq>[^`\r\n]++)`"""
    rf"""|[|>][+-]?[\x20\t]*+\r?\n(?P<block>(?:[\x20\t]++[^\s][^\r\n]*+(?:\r?\n|\Z))++)"""
    rf"""|(?P<bare>[^\s"'<>,;(){{}}\[\]`]++)|(?P<brace>\{{)|(?P<under>(?=[\r\n])))"""
    rf"""|<(?P<tag>{_NAME})>(?P<body>[^<\r\n]++)</"""
    rf"""|(?<!\S)--?(?P<flag>{_NAME})[\x20\t](?P<value>[^\s"'-]\S{{5,}}+)"""
    rf"""|(?:\#define[\x20\t]++(?P<defined>{_NAME})[\x20\t]++|(?<![A-Za-z0-9_])(?P<setter>set_?[A-Za-z][A-Za-z0-9_]*+)\([\x20\t]*+"""
    rf"""|\([\x20\t]*+["'](?P<asked>{_NAME})["'][\x20\t]*+,[\x20\t]*+){_PREFIX}(?:"(?P<edq>{_DQ})"|'(?P<esq>{_SQ})')"""
    rf"""|(?P<left>\{{)|(?P<right>\}})"""
)
#: What joins a literal to the one before it, and that literal.
_MORE = re.compile(rf"""[\x20\t]*+(?:\\\r?\n[\x20\t]*+|(?:\r?\n[\x20\t]*+)?[+.][\x20\t]*+(?:\\?\r?\n[\x20\t]*+)?)?{_PREFIX}(?:"(?P<dq>{_DQ})"|'(?P<sq>{_SQ})')""")
_BLANKS = re.compile(r"[\x20\t]*+(?:-[\x20\t]++)?")
#: How a header names its scheme before the credential, and the password in a URL.
_SCHEME = re.compile(r"(?:bearer|basic|token)(?:[\x20\t]++|\Z)", re.I)
_CREDENTIAL = re.compile(r"""[\x20\t]++([^\s"',;]++)""")
_USERINFO = re.compile(r"""://[^\s/:@"'<>]*+:([^\s/:@"'<>]{6,}+)@""")
_ESCAPE = re.compile(r"\\(.)", re.S)
#: Labels of a key on one line; their blanks don't make it prose.
_LABEL = re.compile(r"-----(?:BEGIN|END) [A-Z0-9 ]++-----")
_PLACEHOLDER = re.compile(rf"(?<![a-z])(?:{'|'.join(sorted(PLACEHOLDERS))})(?![a-z])")
_PART = re.compile(r"[A-Z]+(?![a-z])|[A-Z]?[a-z]+|[0-9]+")


def _sensitivity(name: str) -> float:
    return sum(SENSITIVE.get(part, 0.0) for part in {p.lower() for p in _PART.findall(name)} | {name.lower()})


def _entropy(literal: str) -> float:
    """Bits a character."""
    n = len(literal)
    return -sum(c / n * math.log2(c / n) for c in Counter(literal).values())


def _looks_random(literal: str) -> float:
    kinds = sum(bool(re.search(p, literal)) for p in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]"))
    return min(_entropy(literal), 4.5) / 4.5 + 0.25 * (kinds - 1)


def _weight(sensitivity: float, literal: str) -> float:
    literal = _LABEL.sub("", literal)
    if len(literal) < 6 or any(c in literal for c in " \t") or _PLACEHOLDER.search(literal.lower()) or literal[0] in "$%{<":
        return 0.0
    return sensitivity * _looks_random(literal)


def score(names: set[str], literal: str) -> float:
    """Sensitivity of the most sensitive target, times how random the literal looks."""
    return _weight(max(map(_sensitivity, names), default=0.0), literal)


def pairs(text: str) -> list[tuple[str, str, tuple[int, int], str]]:
    """``(name, kind, span, literal)`` of all assignments in order; a carrier's name is its parent's."""
    out = []
    around: list[tuple[int, str]] = []  # parents: (indent, name); braces have indent -1
    at = line = 0
    entry = (-1, "")  # where the last ``key`` or ``name`` ended, and what it said
    first = _BLANKS.match(text).end()
    while m := _TOKEN.search(text, at):
        end = m.end()
        start = text.rfind("\n", at, m.start()) + 1
        if start > line:
            line, first = start, _BLANKS.match(text, start).end()
        if m["left"] or m["right"]:
            if m["left"]:
                around.append((-1, around[-1][1] if around else ""))
            else:
                while around and around.pop()[0] >= 0:
                    pass
            at = end
            continue
        name = m["name"] or m["tag"] or m["flag"] or m["defined"] or m["setter"] or m["asked"]
        if m.start() <= first + 1 and m.start() >= line and (not around or around[-1][0] >= 0):
            while around and around[-1][0] >= first - line:
                around.pop()
        if name.lower() == "value" and entry[0] >= 0 and not text[entry[0] : m.start()].strip(" \t\r\n,;"):
            name = entry[1]
        elif around and name.lower() in CARRIERS:
            name = around[-1][1] or name
        if m["brace"] is not None or m["under"] is not None:
            around.append((-1, name) if m["brace"] is not None else (first - line, name))
            at = end
            continue
        kind = m.lastgroup
        low, high = m.span(kind)
        literal = m[kind]
        if scheme := _SCHEME.match(literal):
            if kind == "bare" and (told := _CREDENTIAL.match(text, end)):
                (low, high), literal, end = told.span(1), told[1], told.end()
            elif scheme.end() < len(literal):
                low, literal = low + scheme.end(), literal[scheme.end() :]
        if kind in ("dq", "sq", "edq", "esq"):
            literal = _ESCAPE.sub(r"\1", literal) if "-----" not in literal else literal
            while more := _MORE.match(text, end):
                _, high = more.span(more.lastgroup)
                literal += _ESCAPE.sub(r"\1", more[more.lastgroup])
                end = more.end()
        elif kind in ("tq", "block"):
            literal = "".join(x.strip() for x in literal.splitlines())
            low, high = low + len(text[low:high]) - len(text[low:high].lstrip()), low + len(text[low:high].rstrip())
        out.append((name, kind, (low, high), literal))
        entry = (end, literal) if name.lower() in ("key", "name") else (-1, "")
        at = end if end > at else at + 1
    if "://" in text:
        out += [("password", "userinfo", m.span(1), m[1]) for m in _USERINFO.finditer(text)]
    return out


def _named(text: str, least: float) -> list[tuple[int, int]]:
    """Spans of literals that sensitive names take, also by way of other names."""
    found = pairs(text)
    bound = {name for name, *_ in found}
    sources: dict[str, set[str]] = {}  # what a name is bound to, of other names
    literals: dict[tuple[int, int], tuple[str, set[str]]] = {}
    for name, kind, span, literal in found:
        other = literal.rstrip(".")
        other = next((x for x in (other, other.rsplit(".", 1)[-1]) if x in bound), None) if kind == "bare" else None
        if other is not None and other != name:
            sources.setdefault(name, set()).add(other)
        else:
            literals.setdefault(span, (literal, set()))[1].add(name)
    reach = {name: _sensitivity(name) for name in bound}
    done: set[str] = set()
    for name in sorted(sources, key=lambda x: -reach[x]):  # the most sensitive first: each name is reached once
        todo = [name]
        while todo:
            for other in sources.get(todo.pop(), ()):
                if other not in done and reach[other] < reach[name]:
                    reach[other] = reach[name]
                    done.add(other)
                    todo.append(other)
    return [span for span, (literal, names) in literals.items() if _weight(max(reach[n] for n in names), literal) >= least]


def find(text: str | None, least: float = 2.5) -> list[tuple[str, int, int]]:
    """Spans ``(kind, start, end)`` in code points, by start and then the kinds' order."""
    text = text or ""
    spans = []
    if "=" in text or ":" in text:
        spans += [("assign", *m.span()) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= 6]
    if "AKIA" in text:
        spans += [("access", *m.span()) for m in ACCESS.finditer(text)]
    spans += [("hex", *m.span()) for m in HEX.finditer(text)]
    if "=" in text or ":" in text or "</" in text or "--" in text or "#define" in text or "(" in text:
        spans += [("named", *span) for span in _named(text, least)]
    order = {k: i for i, k in enumerate(KINDS)}
    return sorted(spans, key=lambda s: (s[1], order[s[0]], s[2]))


def scan(df: DataFrame, text: str = "text", spans: str = "secrets", least: float = 2.5) -> DataFrame:
    """Add ``spans``: array of (kind, start, end) found in each whole text.

    Null and empty texts have an empty array; other columns and repeated rows stay as they
    are; a column that has the result's name already is an error.
    """
    if spans.lower() in (c.lower() for c in df.columns):
        raise ValueError(f"column {spans} exists already")
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches):
        for batch in batches:
            found = [[{"kind": k, "start": a, "end": b} for k, a, b in find(t, least)] for t in batch.column(text).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], names=[*batch.schema.names, spans])

    made = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(spans, T.ArrayType(made))]))


def masked(text: str | None, least: float = 2.5, mask: str = "[SECRET]") -> str | None:
    """The text with every span replaced; spans that touch become one mask."""
    if text is None:
        return None
    out, at = [], 0
    for _, start, end in find(text, least):
        if start >= at:
            out += [text[at:start], mask]
        at = max(at, end)
    return "".join([*out, text[at:]])


def digests(docs: DataFrame) -> DataFrame:
    """The contract's row per document, from :func:`scan`'s spans by built-in functions."""
    base = "filter(secrets, x -> x.kind <> 'named')"
    told = "concat_ws(',', transform({}, x -> concat(x.kind, ':', x.start, ':', x.end)))"
    count = "cast(size(filter(secrets, x -> x.kind = '{}')) as long) as n_{}"
    return scan(docs.select("doc_id", "text")).selectExpr(
        "doc_id", *(count.format(k, k) for k in KINDS), f"sha2({told.format(base)}, 256) as base_sha256", f"{told.format('secrets')} as spans"
    )


def spans_digest(spans: list[tuple[str, int, int]]) -> str:
    """base_sha256 of plain spans, for comparison."""
    return hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans if k != "named").encode()).hexdigest()
