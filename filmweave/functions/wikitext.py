"""The wikitext parser: templates and links of a text, and what templates read as.

One left-to-right pass over the delimiters keeps a stack of open templates and
links; what never closes stays text. Comments and ``nowiki`` spans are opaque.
This is the only parser in Python; everything that can be said of its output in
column expressions is said there.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import functions as F, types as Y
from pyspark.sql.pandas.types import to_arrow_type

TOKEN = re.compile(r"<!--.*?-->|<nowiki>.*?</nowiki>|\{\{|\}\}|\[\[|\]\]|\||=", re.S | re.I)

#: Markup that clean_text replaces, in this order (Java and Python read these alike).
MARKUP: tuple[tuple[str, str], ...] = (
    (r"<br\s*/?>", ", "),
    (r"(?is)<ref[^>]*>.*?</ref>", ""),
    (r"<ref[^>]*/?>", ""),
    (r"<[^>]+>", ""),
    (r"\[\[[^\]|]+\|([^\]]+)\]\]", "$1"),
    (r"\[\[([^\]]+)\]\]", "$1"),
    (r"\[https?://[^\s\]]+ ([^\]]+)\]", "$1"),
    (r"\[https?://[^\]]+\]", ""),
    (r"(?s)<!--.*?-->", ""),
)

#: Markup that an infobox value loses after its links and templates, in this order.
DISPLAY_MARKUP = ((r"(?s)<ref[^>]*>.*?</ref>", ""), (r"(?s)<!--.*?-->", ""), (r"<br\s*/?>", ", "), (r"<[^>]+>", ""), (r"'{2,}", ""), (r"&[a-z]+;", " "), (r"\s+", " "))

BRACE = re.compile(r"([{}])")

# Names that templates go by.
COUNTRIES = {"vie": "Việt Nam", "us": "Hoa Kỳ", "nor": "Na Uy"}
BIRTH = ("ngày sinh", "năm sinh", "birth date", "birth year")
LISTS = ("hlist", "ubl", "plainlist")
CITATIONS = ("chú thích", "citation", "cite")


PARAM = Y.StructType([Y.StructField("k", Y.StringType()), Y.StructField("v", Y.StringType())])
TEMPLATES = Y.ArrayType(
    Y.StructType([Y.StructField("name", Y.StringType()), Y.StructField("params", Y.ArrayType(PARAM)), Y.StructField("top", Y.BooleanType()), Y.StructField("raw", Y.StringType())])
)


@dataclass
class Node:
    """A template or link: where it stands and its parts between top-level pipes."""

    kind: str
    start: int
    cuts: list[int] = field(default_factory=list)
    equals: dict[int, int] = field(default_factory=dict)
    end: int = -1
    depth: int = 0

    def parts(self, text: str) -> list[str]:
        edges = [self.start + 2, *self.cuts]
        return [text[a:b] for a, b in zip(edges, [*(c - 1 for c in self.cuts), self.end - 2], strict=True)]


def parse(text: str) -> list[Node]:
    """Closed templates and links of ``text`` by their start, outer before inner."""
    open_: list[Node] = []
    found: list[Node] = []
    for m in TOKEN.finditer(text):
        t = m.group()
        if t in ("{{", "[["):
            open_.append(Node(t, m.start(), depth=len(open_)))
        elif t in ("}}", "]]"):
            want = "{{" if t == "}}" else "[["
            at = next((i for i in range(len(open_) - 1, -1, -1) if open_[i].kind == want), None)
            if at is None or (t == "]]" and at != len(open_) - 1):
                continue
            node = open_[at]
            del open_[at:]
            node.end = m.end()
            found.append(node)
        elif open_:
            top = open_[-1]
            if t == "|":
                top.cuts.append(m.end())
            elif t == "=" and top.cuts:
                top.equals.setdefault(len(top.cuts), m.start())
    return sorted(found, key=lambda n: n.start)


def template(text: str, node: Node) -> dict:
    """Name and parameters; those without a name are numbered from 1."""
    name, *rest = node.parts(text)
    params, number = [], 0
    for k, part in enumerate(rest, 1):
        if k in node.equals:
            cut = node.equals[k] - node.cuts[k - 1]
            params.append({"k": part[:cut].strip(), "v": part[cut + 1 :].strip()})
        else:
            number += 1
            params.append({"k": str(number), "v": part.strip()})
    return {"name": re.sub(r"(?s)<!--.*?-->", "", name).strip(), "params": params, "top": node.depth == 0, "raw": text[node.start : node.end]}


def templates_of(text: str | None) -> list[dict] | None:
    return None if text is None else [template(text, n) for n in parse(text) if n.kind == "{{"]


#: Texts that are Python objects at once; the rest of a batch, whatever its rows, is Arrow's buffers.
AT_ONCE = 64


def by_slices(texts: pa.Array, read: Callable[[str], object], to: pa.DataType) -> pa.Array:
    """``read`` of every text that isn't null, a few at a time, so memory goes with the batch's bytes alone."""
    told = lambda part: pa.array([None if t is None else read(t) for t in part.to_pylist()], to)
    return pa.concat_arrays([told(texts.slice(i, AT_ONCE)) for i in range(0, len(texts), AT_ONCE)] or [pa.array([], to)])


@F.arrow_udf(TEMPLATES)
def templates(texts: pa.Array) -> pa.Array:
    """All templates of a text in order, outer before inner."""
    return by_slices(texts, templates_of, to_arrow_type(TEMPLATES))


def plain(text: str) -> str:
    """clean_text in Python, for values inside templates."""
    for pattern, to in MARKUP:
        text = re.sub(pattern, to.replace("$", "\\"), text)
    text = re.sub(r"\s+", " ", fold(text))
    return re.sub(r"\s*,\s*,\s*", ", ", text).strip(" ,")


def _dates(params: list[str]) -> str:
    n = re.findall(r"\d+", " ".join(params))
    return f"{n[0]}-{n[1].zfill(2)}-{n[2].zfill(2)}" if len(n) >= 3 else n[0] if n else ""


def _marriage(params: list[str]) -> str:
    if not params:
        return ""
    year = re.search(r"\d{4}", params[1]) if len(params) > 1 else None
    return plain(params[0]) + (f" ({year.group()})" if year else "")


def _measure(params: list[str]) -> str:
    number = re.sub(r"[^\d.,]", "", params[0]) if params else ""
    return number + "m" * ("m" in "".join(params[1:2]).lower())


def _height(params: list[str]) -> str:
    return next((p.split("=")[1] + "m" for p in params if "m=" in p), "")


READ = {"marriage": _marriage, "convert": _measure, "height": _height} | dict.fromkeys(LISTS, lambda ps: ", ".join(filter(None, map(plain, ps))))
READ |= {"small": lambda ps: f"({ps[0]})" if ps else ""} | {k: lambda ps, v=v: v for k, v in COUNTRIES.items()} | dict.fromkeys(CITATIONS, lambda ps: "")


def read_template(inner: str) -> str:
    """What the inside of an innermost template reads as."""
    name, *params = (p.strip() for p in inner.split("|"))
    name = name.lower()
    if any(b in name for b in BIRTH):
        return _dates(params)
    return READ.get(name, ", ".join)(params)


def replace_innermost(text: str, reads: Callable[[str], str], empty: bool = False) -> str:
    """Replace innermost templates (``empty``: also those without content) by what ``reads`` makes of their inside,
    then what thereby became innermost, until none is left or none closes.

    One pass: pieces without braces and single braces go on a stack, and whenever two closing braces end a piece that
    two opening ones precede, the five are one piece. Pieces are joined only when they are read.
    """
    stack: list[str | list[str]] = []  # a brace, or the parts of a piece

    def add(piece: str) -> None:
        if piece:
            if stack and isinstance(stack[-1], list):
                stack[-1].append(piece)
            else:
                stack.append([piece])

    for piece in BRACE.split(text):
        if piece not in ("{", "}"):
            add(piece)
            continue
        stack.append(piece)
        if stack[-2:] == ["}", "}"]:
            filled = len(stack) > 4 and isinstance(stack[-3], list)
            first = len(stack) - (5 if filled else 4)
            if first >= 0 and stack[first : first + 2] == ["{", "{"] and (filled or empty):
                inside = "".join(stack[-3]) if filled else ""
                del stack[first:]
                add(reads(inside))
    return "".join(x if isinstance(x, str) else "".join(x) for x in stack)


def fold(text: str) -> str:
    """Every template that closes, read."""
    return replace_innermost(text, read_template)


@F.arrow_udf(Y.StringType())
def fold_templates(texts: pa.Array) -> pa.Array:
    return by_slices(texts, fold, pa.string())


def labels(text: str) -> str:
    """Links replaced by their labels, or targets without one, in one pass over the delimiters.

    An open link holds its parts between pipes; the pipes of an inner label part the link around it. Templates are
    kept as they are, and what never closes stays text.
    """
    open_: list[tuple[str, list[list[str]]]] = [("", [[]])]

    def put(string: str, parted: bool = False) -> None:
        first, *more = string.split("|") if parted and open_[-1][0] == "[[" else [string]
        open_[-1][1][-1].append(first)
        open_[-1][1].extend([x] for x in more)

    def as_text(upto: int) -> None:
        while len(open_) > upto:
            kind, parts = open_.pop()
            put(kind + "|".join("".join(p) for p in parts), parted=True)

    end = 0
    for m in TOKEN.finditer(text):
        put(text[end : m.start()])
        end, token = m.end(), m.group()
        if token in ("{{", "[["):
            open_.append((token, [[]]))
        elif token == "]]" and open_[-1][0] == "[[":
            target, *label = ("".join(p) for p in open_.pop()[1])
            put("|".join(label) or target, parted=True)
        elif token == "}}" and any(kind == "{{" for kind, _ in open_):
            as_text(max(i for i, (kind, _) in enumerate(open_) if kind == "{{") + 1)
            put("{{" + "".join(open_.pop()[1][0]) + "}}")
        else:
            put(token, parted=token == "|")
    put(text[end:])
    as_text(1)
    return "".join(open_[0][1][0])


def infobox_value(text: str) -> str:
    """An infobox value for display: labels of links, readings of a few templates, no markup."""
    text = replace_innermost(labels(text), _display, empty=True)
    for pattern, to in DISPLAY_MARKUP:
        text = re.sub(pattern, to, text)
    return text.strip()


@F.arrow_udf(Y.StringType())
def display(texts: pa.Array) -> pa.Array:
    return by_slices(texts, infobox_value, pa.string())


def _display(inside: str) -> str:
    t = templates_of("{{" + inside + "}}")
    if not t:
        return ""
    name, first = t[0]["name"].lower(), {p["k"]: p["v"] for p in t[0]["params"]}
    if name in ("vie", "vi", "vietnam"):
        return "Việt Nam"
    if name.startswith("birth date"):
        ymd = [first.get(k) for k in "123"]
        return "" if None in ymd else "-".join([ymd[0], ymd[1].zfill(2), ymd[2].zfill(2)])
    if name in ("flatlist", *LISTS):
        return re.sub(r"[\n*]", " ", first.get("1", "")).strip()
    return first.get("1", "") if name == "flag" else ""
