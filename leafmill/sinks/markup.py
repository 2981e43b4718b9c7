"""Markup as stream bytes: HTML and structured JSON become text and style controls of a body."""

from __future__ import annotations

import html
import json
import re
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from leafmill.sinks.packages import BREAK, HALF, HALF_END, cells

# Fixed values.
BLOCKS = {
    "address", "article", "blockquote", "dd", "details", "div", "dl", "dt", "figcaption", "figure", "h1", "h2", "h3", "h4", "h5", "h6", "header", "footer", "li", "main", "nav", "ol", "p", "pre", "section",
    "summary", "table", "tbody", "td", "tfoot", "th", "thead", "tr", "ul",
}
EMPTY = {"br", "rn", "wbr", "hr"}
#: style -> (tags, declarations, start, end)
STYLES = {
    "bold": ({"b", "strong"}, ("font-weight:bold", "fontweight:bold"), b"\x1f\xe0\x00\x00", b"\x1f\xe1"),
    "sub": ({"sub"}, ("vertical-align:sub",), b"\x1f\x06", b"\x1f\x07"),
    "sup": ({"sup", "rt"}, ("vertical-align:super", "vertical-align:top"), b"\x1f\x0e", b"\x1f\x0f"),
    "italic": ({"i"}, (), b"\x1f\x10", b"\x1f\x11"),
    "em": ({"em"}, (), b"\x1f\x12", b"\x1f\x13"),
    "literal": ({"code", "kbd", "pre", "samp"}, (), b"\x1f\x0b", b"\x1f\x0c"),
}


class _Body(HTMLParser):
    """Collects the bytes of a body; breaks never stand twice in a row or at its ends."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.out: list[bytes] = []
        self.open: list[tuple[str, list[bytes]]] = []

    def line(self) -> None:
        if any(part != BREAK for part in self.out) and self.out[-1] != BREAK:
            self.out.append(BREAK)

    def text(self, text: str) -> None:
        if shown := re.sub(r"[ \t\r\n]+", " ", text):
            if shown != " " or (self.out and self.out[-1] != BREAK):
                self.out.append(HALF + cells(shown) + HALF_END)

    def start(self, tag: str, attrs: dict[str, str]) -> None:
        if tag in BLOCKS:
            self.line()
        if tag == "li":
            self.out.append(cells("・"))
        if tag in ("td", "th"):
            self.out.append(cells("　"))
        if tag in EMPTY:
            self.line()
            return
        if tag in ("img", "object"):
            if label := attrs.get("alt") or attrs.get("title") or attrs.get("src") or attrs.get("data") or "":
                self.out.append(cells("［") + HALF + cells(label) + HALF_END + cells("］"))
            if tag == "img":
                return
        style = attrs.get("style", "").replace(" ", "").lower()
        ends = []
        for tags, declared, begin, end in STYLES.values():
            if tag in tags or any(d in style for d in declared):
                self.out.append(begin)
                ends.append(end)
        self.open.append((tag, ends[::-1]))

    def end(self, tag: str) -> None:
        if any(t == tag for t, _ in self.open):
            while self.open:
                last, ends = self.open.pop()
                self.out += ends
                if last == tag:
                    break
        if tag in BLOCKS:
            self.line()

    def bytes(self) -> bytes:
        while self.open:
            self.end(self.open[-1][0])
        while self.out and self.out[-1] == BREAK:
            self.out.pop()
        return b"".join(self.out)

    def handle_starttag(self, tag, attrs):
        self.start(tag.lower(), {k.lower(): v or "" for k, v in attrs})

    def handle_endtag(self, tag):
        self.end(tag.lower())

    def handle_data(self, data):
        self.text(data)


def _from_html(source: str) -> bytes:
    body = _Body()
    body.feed(source)
    body.close()
    return body.bytes()


def _as_html(node) -> str:
    """Structured content as HTML: strings are markup or text, lists go one after the other, objects are elements."""
    if node is None:
        return ""
    if isinstance(node, str):
        return node if "<" in node and ">" in node else html.escape(node)
    if isinstance(node, list):
        return "".join(map(_as_html, node))
    if not isinstance(node, dict):
        return html.escape(str(node))
    if node.get("type") == "structured-content":
        return _as_html(node.get("content"))
    if node.get("type") == "image":
        return f'<img alt="{html.escape(str(node.get("title") or node.get("description") or node.get("path") or ""))}">'
    tag = str(node.get("tag") or "").lower()
    style = ";".join(f"{k}:{v}" for k, v in node["style"].items()) if isinstance(node.get("style"), dict) else ""
    alt = f' alt="{html.escape(str(node.get("alt") or node.get("title") or node.get("src") or node.get("path") or ""))}"' if tag in ("img", "object") else ""
    inner = _as_html(node.get("content"))
    return f'<{tag} style="{html.escape(style)}"{alt}>{inner}</{tag}>' if tag else inner


def _from_json(source: str) -> bytes:
    try:
        return _from_html(_as_html(json.loads(source)))
    except ValueError:
        return _from_html(html.escape(source))


def _scalar(value) -> str:
    if value is None:
        return ""
    if isinstance(value, str):
        return " ".join(value.split())
    if isinstance(value, list):
        return ", ".join(part for part in map(_scalar, value) if part)
    if isinstance(value, dict):
        for name in ("displayValue", "value"):
            if name in value and (shown := _scalar(value[name])):
                return shown
        return " ".join(json.dumps(value, ensure_ascii=False, sort_keys=True, separators=(",", ":")).split())
    return str(value)


def _scalar_json(source: str) -> str:
    try:
        return _scalar(json.loads(source))
    except ValueError:
        return _scalar(source)


def _each(f, text: Column, kind: str) -> Column:
    def mapped(values: pd.Series) -> pd.Series:
        return values.map(lambda v: f(v) if isinstance(v, str) else None)

    return F.pandas_udf(mapped, kind)(text)


def html_body(markup: Column) -> Column:
    """HTML as body bytes: blocks and breaks as line ends, styles as controls, images as their label."""
    return _each(_from_html, markup, "binary")


def structured_body(content: Column) -> Column:
    """Structured JSON content as body bytes; what isn't JSON is text."""
    return _each(_from_json, content, "binary")


def scalar_text(value: Column) -> Column:
    """A JSON value as one line of text: an object by its displayValue or value, else compact with sorted keys; a list's parts joined."""
    return _each(_scalar_json, value, "string")
