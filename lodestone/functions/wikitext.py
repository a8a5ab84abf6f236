"""A small wikitext reader: lead text, links and external links.

A documented subset: comments, ``nowiki``, ``ref`` and other tags, nested templates, tables and links, bold and italic quotes, headings.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Namespaces by the prefix of a title.
NAMESPACES = {
    "": 0, "Talk": 1, "User": 2, "User talk": 3, "Wikipedia": 4, "Wikipedia talk": 5, "File": 6, "File talk": 7, "MediaWiki": 8,
    "MediaWiki talk": 9, "Template": 10, "Template talk": 11, "Help": 12, "Help talk": 13, "Category": 14, "Category talk": 15,
    "Portal": 100, "Portal talk": 101, "Draft": 118, "Draft talk": 119, "MOS": 126, "MOS talk": 127, "TimedText": 710,
    "TimedText talk": 711, "Module": 828, "Module talk": 829, "Event": 1728, "Event talk": 1729,
}

#: Templates that put a page into a category, by name without spaces, hyphens and plus signs.
CATEGORY_TEMPLATES = (
    "commonscategory", "commonscategoryinline", "commonscategorymulti", "commonscat", "commonscatinline", "commonscatmulti", "commonscats",
    "commonsandcategory", "commonsandcategoryinline",
)
#: Links that embed files.
FILE_PREFIXES = ("File:", "Image:", "file:", "image:")

_COMMENT = re.compile(r"<!--.*?(?:-->|\Z)", re.S)
_NOWIKI = re.compile(r"<nowiki\s*/>|<nowiki>(.*?)(?:</nowiki>|\Z)", re.S | re.I)
_REF = re.compile(r"<ref\b[^>]*?/>|<ref\b[^>]*>.*?(?:</ref\s*>|\Z)", re.S | re.I)
_TAG = re.compile(r"</?[a-zA-Z][^<>]*>")
_HEADING = re.compile(r"^=+[^\n]*=+[ \t]*$", re.M)
_URL = r"(?:https?:|ftp:)?//[^\s\[\]<>\"|{}]+"
_BRACKETED = re.compile(rf"\[({_URL})(?:[ \t]+([^\]\n]*))?\]")
_BARE = re.compile(r"(?<![\[\w/:])(?:https?|ftp)://[^\s\[\]<>\"|{}]+")
_TOKEN = re.compile(r"\{\{|\}\}|\[\[|\]\]|\{\||\|\}|\|")
_OPENS = {"}}": "{{", "]]": "[[", "|}": "{|"}
#: Characters of a link's target or a template's name that are looked at; titles have at most 255 bytes.
_NAME = 1024


def namespace_title(link: Column) -> Column:
    """``struct<ns, title>`` of a link's target, natively: the prefix up to the first colon if it names a namespace, exactly; the title
    keeps it, but for an empty one."""
    known = F.create_map(*[x for k, v in NAMESPACES.items() for x in (F.lit(k), F.lit(v))])
    prefix = F.when(F.instr(link, ":") > 0, F.substring_index(link, ":", 1))
    ns = F.coalesce(F.try_element_at(known, prefix), F.lit(0))
    return F.struct(ns.alias("ns"), F.when(link.startswith(":"), F.substr(link, F.lit(2))).otherwise(link).alias("title"))


def _cleared(text: str) -> tuple[str, list[str]]:
    """Text without comments and with ``nowiki`` contents put aside."""
    aside: list[str] = []

    def keep(m: re.Match) -> str:
        aside.append(m[1] or "")
        return f"\ue000{len(aside) - 1}\ue001"

    return _NOWIKI.sub(keep, _COMMENT.sub("", text)), aside


class _Open:
    """A pair that is open: its kind, its place, its first two bars and, for reading text, what it shows part by part."""

    __slots__ = ("kind", "start", "bars", "parts")

    def __init__(self, kind: str, start: int):
        self.kind, self.start, self.bars, self.parts = kind, start, [], [[]]

    def as_text(self) -> list:
        """What an opening without its close shows: itself, as ordinary text."""
        out: list = [self.kind]
        for i, part in enumerate(self.parts):
            out += ["|", part] if i else [part]
        return out


def _pairs(body: str, shown: list | None = None) -> Iterator[tuple[str, int, int, list[int]]]:
    """``kind, start, stop, bars`` of balanced ``{{``, ``[[`` and ``{|`` pairs as they close, with the places of their first two own bars.

    ``shown`` is filled with the reading text in nested lists of pieces (joining them at each level would read deep ones again and again):
    nothing of templates, tables and files, of links their last part. An opening without its close is ordinary text.
    """
    stack: list[_Open] = []
    at: dict[str, list[int]] = {"{{": [], "[[": [], "{|": []}
    last = 0

    def put(piece: str | list) -> None:
        if shown is not None and piece:
            (stack[-1].parts[-1] if stack else shown).append(piece)

    for m in _TOKEN.finditer(body):
        token = m[0]
        put(body[last : m.start()])
        last = m.end()
        if token in at:
            at[token].append(len(stack))
            stack.append(_Open(token, m.start()))
        elif token == "|" or (token == "|}" and not at["{|"]):
            if not stack:
                put(token)
                continue
            top = stack[-1]
            if len(top.bars) < 2:
                top.bars.append(m.start())
            top.parts.append([])
            if token == "|}":
                put("}")
        elif not at[_OPENS[token]]:
            put(token)
        else:
            i = at[_OPENS[token]][-1]
            while len(stack) > i + 1:
                lost = stack.pop()
                at[lost.kind].pop()
                if shown is not None:
                    put(lost.as_text())
            one = stack.pop()
            at[one.kind].pop()
            if shown is not None and one.kind == "[[":
                target = body[one.start + 2 : min(one.bars[0] if one.bars else m.start(), one.start + 2 + _NAME)].strip()
                if not target.startswith(FILE_PREFIXES):
                    part = one.parts[-1]
                    put(part if one.bars or not all(isinstance(x, str) for x in part) else "".join(part).strip().removeprefix(":"))
            yield one.kind, one.start, m.end(), one.bars
    put(body[last:])
    while stack and shown is not None:
        put(stack.pop().as_text())


def _joined(shown: list) -> str:
    out, left = [], [iter(shown)]
    while left:
        for x in left[-1]:
            if isinstance(x, str):
                out.append(x)
            else:
                left.append(iter(x))
                break
        else:
            left.pop()
    return "".join(out)


def _links(body: str, ns: int, title: str) -> list[str]:
    out: dict[str, None] = {}
    for kind, start, stop, bars in _pairs(body):
        end = bars[0] if bars else stop - 2
        if kind == "{|" or end - start - 2 > _NAME:
            continue
        name = body[start + 2 : end].strip()
        if kind == "[[":
            out.setdefault(name)
        elif re.sub(r"[ +-]", "", name.lower()) in CATEGORY_TEMPLATES:
            first = body[bars[0] + 1 : bars[1] if len(bars) > 1 else stop - 2].split("=", 1)[-1].strip() if bars else ""
            if first or ns != 14:
                out.setdefault(f"Category:{first or title}")
    return [x for x in out if x]


def links(text: str | None, ns: int, title: str) -> list[str]:
    """Targets of all links of a page, once each, and the categories that its templates name."""
    return _links(_cleared(text or "")[0], ns, title)


def _address(found: str) -> str:
    """A bare address without the punctuation after it; a closing bracket that it opens itself is its own."""
    while found:
        last = found[-1]
        if last in ".,;:!?'" or (last == ")" and found.count(")") > found.count("(")):
            found = found[:-1]
        else:
            break
    return found


def _addresses(body: str) -> list[str]:
    return list(dict.fromkeys([*[m[1] for m in _BRACKETED.finditer(body)], *[_address(m[0]) for m in _BARE.finditer(body)]]))


def external_links(text: str | None) -> list[str]:
    """Addresses of a page's external links, bracketed or bare, once each."""
    return _addresses(_cleared(text or "")[0])


def plain(text: str) -> str:
    """Wikitext as reading text."""
    return _plain(*_cleared(text))


def _plain(body: str, aside: list[str]) -> str:
    shown: list = []
    for _ in _pairs(_REF.sub("", body), shown):
        pass
    body = _joined(shown)
    body = _BRACKETED.sub(lambda m: m[2] or "", body)
    body = _TAG.sub("", body)
    body = re.sub(r"'{2,5}", "", body)
    body = re.sub("\ue000(\\d+)\ue001", lambda m: aside[int(m[1])], body)
    return html.unescape(body)


def _lead(body: str, aside: list[str]) -> str:
    m = _HEADING.search(body)
    return re.sub(r"\n{3,}", "\n\n", _plain(body[: m.start()] if m else body, aside)).strip()


def lead(text: str | None) -> str:
    """The reading text before the first heading."""
    return _lead(*_cleared(text or ""))


def read(text: str | None, ns: int, title: str) -> tuple[str, list[str], list[str]]:
    """A page's lead, links and external addresses, in time that grows with its text."""
    body, aside = _cleared(text or "")
    return _lead(body, aside), _links(body, ns, title), _addresses(body)


def read_once(pages: DataFrame) -> DataFrame:
    """``id, ns, title, redirect, lead, links, urls`` of ``pages(id, ns, title, redirect, text)``: one stage for all that is in the texts, which end there."""

    def each(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ns, title, text = (batch.column(k).to_pylist() for k in (1, 2, 4))
            found = [read(t, n, x or "") for t, n, x in zip(text, ns, title, strict=True)]
            columns = [pa.array([f[0] for f in found], pa.string()), *[pa.array([f[k] for f in found], pa.list_(pa.string())) for k in (1, 2)]]
            yield pa.RecordBatch.from_arrays([*batch.columns[:4], *columns], names=["id", "ns", "title", "redirect", "lead", "links", "urls"])

    rows = pages.select(F.col("id").cast("long"), F.col("ns").cast("int"), "title", "redirect", "text")
    return rows.mapInArrow(each, "id long, ns int, title string, redirect string, lead string, links array<string>, urls array<string>")
