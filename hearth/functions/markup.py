"""Elements of HTML pages, however they are nested: one pass over a page finds all that is asked for.

A page is read tag by tag with a stack of what is open, in time that grows with its length.
Comments, declarations and what scripts and styles hold are no elements and no text.  An end
tag ends the nearest open element of its name with all that is open inside; one that has
none, or an inline one behind an open block, is left out.  A paragraph, list item, option,
table row or cell that begins directly inside another of its kind ends it.  What is open at
the page's end ends there.  An element belongs to the innermost open one that asks for it, so
a card that was never closed takes nothing from the next.
"""

from __future__ import annotations

import html
import re
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
INLINE = frozenset("a abbr b em font i s small span strong sub sup u".split())
ENDS_ITS_KIND = frozenset("p li option dt dd tr td th".split())
RAW = {name: re.compile(rf"(?i)</{name}\b") for name in ("script", "style")}
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"

# no part of these goes back, and a tag that isn't closed ends at the next "<", so a page is read once
_TAG = re.compile(r"""(?s)<(?:/(?P<end>[A-Za-z][^\s/<>]*+)[^<>]*+>|(?P<begin>[A-Za-z][^\s/<>]*+)(?P<attrs>(?:[^'"<>]++|"[^"]*+"|'[^']*+')*+)>|!--.*?(?:-->|\Z)|[!?][^<>]*+>)""")
_ATTRIBUTE = re.compile(r"""([^\s"'<>/=]++)(?:\s*+=\s*+(?:"([^"]*+)"|'([^']*+)'|([^\s"'<>]++)))?""")
#: Attributes of so many tags of a name, of so many characters at most, are kept with what they fit.
KEPT_TAGS, KEPT_LENGTH = 1000, 200
PAGES_AT_ONCE = 16
_REFERENCE = re.compile(r"&(?:#[0-9]+|#[xX][0-9a-fA-F]+|[A-Za-z][A-Za-z0-9]*);")


@dataclass(frozen=True)
class Select:
    """Elements by tag, and by class (the whole attribute, or a part of it), attributes they have and lack.

    Each gives ``text`` (character references decoded, trimmed; a line break is ``breaks``),
    ``attrs`` (those named, null if absent), what is ``inside`` of it, and of each of ``after``
    the nearest sibling before it, as lists in the order of the page.
    """

    tag: str
    css: str | None = None
    part: bool = False
    attrs: tuple[str, ...] = ()
    has: tuple[str, ...] = ()
    lacks: tuple[str, ...] = ()
    text: bool = True
    breaks: str = ""
    inside: dict[str, Select] = field(default_factory=dict)
    after: dict[str, Select] = field(default_factory=dict)

    def fits(self, attrs: dict[str, str]) -> bool:
        css = attrs.get("class", "")
        named = self.css is None or (self.css in css if self.part else css == self.css)
        return named and all(attrs.get(a) for a in self.has) and not any(a in attrs for a in self.lacks)

    def kind(self) -> T.StructType:
        fields = [T.StructField("text", T.StringType())] if self.text else []
        fields += [T.StructField(a, T.StringType()) for a in self.attrs]
        return T.StructType(fields + [T.StructField(n, T.ArrayType(s.kind())) for n, s in {**self.inside, **self.after}.items()])

    def arrow(self) -> pa.DataType:
        fields = [("text", pa.string())] if self.text else []
        fields += [(a, pa.string()) for a in self.attrs]
        return pa.struct(fields + [(n, pa.list_(s.arrow())) for n, s in {**self.inside, **self.after}.items()])


def _attributes(source: str) -> dict[str, str]:
    """By name in small letters; the first of a name counts, and references need their semicolon."""
    out: dict[str, str] = {}
    for name, *values in _ATTRIBUTE.findall(source):
        value = next((v for v in values if v), "")
        out.setdefault(name.lower(), _REFERENCE.sub(lambda m: html.unescape(m[0]), value) if "&" in value else value)
    return out


def _closed(source: str) -> bool:
    """Whether a tag ends in a slash that is no part of a value without quotes."""
    return source == "/" or (source.endswith("/") and source[-2] in " \t\r\n\f\"'")


class _Entry(NamedTuple):
    """A selection and where its results go: into those of the entry ``owner``, or the page's if that is -1."""

    name: str
    select: Select
    owner: int
    before: bool
    inside: tuple[str, ...]
    after: dict[str, int]


class _Fit(NamedTuple):
    """An entry that a tag's attributes fit, and the values that it asks for."""

    entry: int
    values: dict[str, str | None]


class _Page:
    """What is asked for by tag, and what tags that came before fitted; pages are read one by one."""

    def __init__(self, wanted: dict[str, Select]) -> None:
        self.names = tuple(wanted)
        self.entries: list[_Entry] = []
        # by tag: entries of one class by its name, all others under None
        self.by_tag: dict[str, dict[str | None, list[int]]] = defaultdict(lambda: defaultdict(list))
        for name, select in wanted.items():
            self._add(name, select, -1)
        self.fits: dict[str, dict[str, list[_Fit]]] = {tag: {} for tag in self.by_tag}  # by tag and its attributes

    def _add(self, name: str, select: Select, owner: int, before: bool = False) -> int:
        number, after = len(self.entries), {}
        self.entries.append(_Entry(name, select, owner, before, tuple(select.inside), after))
        self.by_tag[select.tag][None if select.part else select.css].append(number)
        for inner, child in select.inside.items():
            self._add(inner, child, number)
        for inner, child in select.after.items():
            after[inner] = self._add(inner, child, number, True)
        return number

    def _fitting(self, tag: str, source: str) -> list[_Fit]:
        """The entries that a tag fits; kept for the next tag of these attributes, as most come again and again."""
        attrs, numbers, kept = _attributes(source), self.by_tag[tag], self.fits[tag]
        asked = (*numbers.get(attrs.get("class", ""), ()), *numbers.get(None, ()))
        out = [_Fit(k, {a: attrs.get(a) for a in self.entries[k].select.attrs}) for k in asked if self.entries[k].select.fits(attrs)]
        if len(kept) >= KEPT_TAGS:
            kept.clear()
        if len(source) <= KEPT_LENGTH:
            kept[source] = out
        return out

    def read(self, page: str) -> dict[str, list]:
        found: dict[str, list] = {name: [] for name in self.names}
        entries, fits = self.entries, self.fits
        chunks: list[str | None] = []  # None is a line break
        texts = 0  # open results that want their text; between them text isn't kept
        stack: list[tuple[str, list | None]] = []
        places: dict[str, list[int]] = defaultdict(list)  # of a tag's open elements in the stack
        blocks: list[int] = []  # of open elements that aren't inline
        holders: list[list[dict]] = [[] for _ in entries]  # open results by what they were selected by
        siblings: dict[int, dict[int, dict]] = {}  # last results for "after", by how deep their parent lies

        def close(results: list) -> None:
            for k, out, first in results:
                select = entries[k].select
                if select.text:
                    text = "".join([select.breaks if c is None else c for c in chunks[first:]])
                    out["text"] = (html.unescape(text) if "&" in text else text).strip(SPACE)

        def pop() -> int:
            """The number of texts that end with the innermost open element."""
            if siblings:
                siblings.pop(len(stack), None)
            tag, results = stack.pop()
            places[tag].pop()
            if tag not in INLINE:
                blocks.pop()
            if not results:
                return 0
            for k, _, _ in results:
                holders[k].pop()
            close(results)
            return sum(entries[k].select.text for k, _, _ in results)

        at, going = 0, True
        while going:
            going = False
            for tag in _TAG.finditer(page, at):
                first, after = tag.span()
                if texts and first > at:
                    chunks.append(page[at:first])
                at = after
                end, name, source = tag.groups()
                if end:
                    end = end.lower()
                    held = places.get(end)
                    if held and not (end in INLINE and blocks and blocks[-1] > held[-1]):
                        for _ in range(len(stack) - held[-1]):
                            texts -= pop()
                elif name:
                    name = name.lower()
                    if name in ENDS_ITS_KIND and stack and stack[-1][0] == name:
                        texts -= pop()
                    results: list | None = None
                    kept = fits.get(name)
                    if kept is not None:
                        known = kept.get(source)
                        for k, values in self._fitting(name, source) if known is None else known:
                            _, select, owner, before, inside, earlier = entries[k]
                            if owner >= 0 and not before and not holders[owner]:
                                continue
                            out: dict = values.copy()
                            for inner in inside:
                                out[inner] = []
                            for inner, child in earlier.items():
                                last = siblings.get(len(stack), {}).get(child)
                                out[inner] = [] if last is None else [last]
                            if before:
                                siblings.setdefault(len(stack), {})[k] = out
                            else:
                                (holders[owner][-1] if owner >= 0 else found)[entries[k].name].append(out)
                            if results is None:
                                results = []
                            results.append((k, out, len(chunks)))
                    if name == "br":
                        chunks.append(None)
                    closed = source[-1:] == "/" and _closed(source)
                    if name in VOID or closed:
                        if results:
                            close(results)
                    else:
                        if results:
                            for k, out, _ in results:
                                holders[k].append(out)
                                texts += entries[k].select.text
                        depth = len(stack)
                        if name not in INLINE:
                            blocks.append(depth)
                        places[name].append(depth)
                        stack.append((name, results))
                    if name in RAW and not closed:
                        ended = RAW[name].search(page, at)
                        at, going = ended.start() if ended else len(page), True
                        break
        if texts:
            chunks.append(page[at:])
        while stack:
            pop()
        return found


def elements(page: Column, **wanted: Select) -> Column:
    """A struct with a list for each selection, in the order of the page; null and empty pages give empty lists."""
    kind = T.StructType([T.StructField(n, T.ArrayType(s.kind())) for n, s in wanted.items()])
    arrow = pa.struct([(n, pa.list_(s.arrow())) for n, s in wanted.items()])

    def read(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        reader = _Page(wanted)
        for batch in batches:
            # what is found is Arrow's after some pages, so that a batch of large pages isn't held as objects
            parts = (batch.slice(at, PAGES_AT_ONCE) for at in range(0, len(batch), PAGES_AT_ONCE))
            yield pa.concat_arrays([pa.array([], type=arrow), *(pa.array([reader.read(x.as_py() or "") for x in part], type=arrow) for part in parts)])

    return F.arrow_udf(read, returnType=kind)(page)
