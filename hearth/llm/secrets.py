"""Secret scans: known forms of secrets, and random strings by their token efficiency.

Three base forms are found by pattern.  The method adds strings that a subword
vocabulary compresses badly: a run of base64 or identifier characters with both a
letter and a digit that gets fewer than ``max_ratio`` characters a token looks random.
Known digests (hexadecimal of usual lengths), UUIDs and identifiers (parts of only
letters or only digits between separators) are left out, as is what a base span covers.

A whole run that no base span touches has the kind ``random``.  Readable names in a run
would hide its random part, so a run that passes as a whole is tested again by its worst
stretches between separators, and so is what base spans leave of a run that they touch;
these spans have the kind ``part``.

Defined results: a null or empty text has no spans.  Offsets are code points, the end is
exclusive.  Repeated rows each get a row; other columns are ignored by ``scan`` and kept
by ``redact``.
"""

from __future__ import annotations

import base64
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import share, slices, small_batches, texts

#: The kinds of spans in their order (fixed values).
KINDS = ("assign", "access", "hex", "random", "part")
#: Base forms (fixed patterns); on bytes, so only ASCII letters have two cases.
ASSIGN = re.compile(rb"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""")
ACCESS = re.compile(rb"AKIA[A-Z0-9]+")
HEX = re.compile(rb"[0-9a-f]+")
#: Words of which one is in every assignment, in lower case.
_KEYS = (b"passw", b"secret", b"token", b"api")
_CANDIDATE = re.compile(rb"[A-Za-z0-9+/=_-]+")
_IDENTIFIER = re.compile(rb"(?:[A-Za-z]+|[0-9]+)(?:[-_/=+]+(?:[A-Za-z]+|[0-9]+))*[-_/=+]*")
_UUID = re.compile(rb"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}")
#: What a run is cut into: UUIDs, separators, and what is between those.
_ATOM = re.compile(rb"(?<![A-Za-z0-9])" + _UUID.pattern + rb"(?![A-Za-z0-9])|[A-Za-z0-9]+|[+/=_-]+")
_HEXADECIMAL = re.compile(rb"[0-9a-f]+|[0-9A-F]+")
#: Lengths of usual digests in hexadecimal: MD5, SHA-1, SHA-224, SHA-256, SHA-384, SHA-512 (fixed values).
DIGEST_LENGTHS = (32, 40, 56, 64, 96, 128)
#: How a byte-level BPE of 50 thousand tokens cuts a text before merging (fixed pattern).
PIECES = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Maps bytes to classes, so that a plain search finds long runs of one class.
_HEX_RUN = bytes(104 if chr(b) in "0123456789abcdef" else 32 for b in range(256))
_TOKEN_RUN = bytes(116 if _CANDIDATE.fullmatch(bytes([b])) else 32 for b in range(256))


def _mixed(found: bytes) -> bool:
    """Whether there are letters and digits, and not as parts of an identifier."""
    return not _IDENTIFIER.fullmatch(found) and bool(re.search(rb"[0-9]", found)) and bool(re.search(rb"[A-Za-z]", found))


def _known(found: bytes) -> bool:
    """Whether it is a UUID or a usual digest."""
    return bool(_UUID.fullmatch(found)) or len(found) in DIGEST_LENGTHS and bool(_HEXADECIMAL.fullmatch(found))


def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int]]:
    """(start, end) of what spans cover, in order and disjoint."""
    out: list[tuple[int, int]] = []
    for s, _, e in sorted(spans):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


class Scanner:
    """Finds the spans of one text; holds one tokenizer of fixed size."""

    def __init__(self, ranks: bytes, min_chars: int, max_ratio: float):
        self.ranks, self.min_chars, self.max_ratio = ranks, min_chars, max_ratio
        self._encoding = None

    def __getstate__(self):
        return self.ranks, self.min_chars, self.max_ratio

    def __setstate__(self, state):
        self.__init__(*state)

    def tokens(self, text: str) -> int:
        if self._encoding is None:
            merges = {base64.b64decode(a): int(b) for a, b in map(bytes.split, self.ranks.splitlines())}
            self._encoding = tiktoken.Encoding("ranks", pat_str=PIECES, mergeable_ranks=merges, special_tokens={})
        return len(self._encoding.encode_ordinary(text))

    def chars_per_token(self, text: str) -> float:
        return len(text) / max(1, self.tokens(text))

    def base(self, text: bytes) -> list[tuple[int, int, int]]:
        """(start, kind, end) in bytes.  A failing match of a form is consumed all the same."""
        out = []
        lower = text.lower()
        if any(k in lower for k in _KEYS):
            out += [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 6]
        if b"AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20]
        if b"h" * 24 in text.translate(_HEX_RUN):
            out += [(m.start(), 2, m.end()) for m in HEX.finditer(text) if m.end() - m.start() >= 24]
        return out

    def is_random(self, found: bytes) -> bool:
        return _mixed(found) and not _known(found) and self.chars_per_token(found.decode()) < self.max_ratio

    def parts(self, run: bytes) -> list[tuple[int, int]]:
        """The random stretches (begin, end) of a run, each from separator to separator.

        An atom scores the characters that its tokens would hold at ``max_ratio``, less those
        that they hold.  Stretches are the disjoint ones of highest score (Ruzzo and Tompa, in
        linear time), so atoms that are random by themselves always lie in one.  UUIDs and
        known digests end a stretch.
        """
        if len(run) < self.min_chars or not _mixed(run):
            return []
        out: list[tuple[int, int]] = []
        open_: list[tuple[float, float, int, int, int]] = []  # score before and after, begin, end, the last stretch before with a lower score before

        def close() -> None:
            for _, _, a, b, _ in open_:
                b = a + len(run[a:b].rstrip(b"+/=_-"))
                a = b - len(run[a:b].lstrip(b"+/=_-"))
                if b - a >= self.min_chars and self.is_random(run[a:b]):
                    out.append((a, b))
            open_.clear()

        total = 0.0
        for m in _ATOM.finditer(run):
            if _known(m[0]):
                close()
                continue
            before = total
            total += self.max_ratio * self.tokens(m[0].decode()) - len(m[0])
            if total <= before:
                continue
            begin = m.start()
            while True:
                j = len(open_) - 1
                while j >= 0 and open_[j][0] >= before:
                    j = open_[j][4]
                if j < 0 or open_[j][1] >= total:
                    break
                before, begin = open_[j][0], open_[j][2]
                del open_[j:]
            if j < 0:
                close()
            open_.append((before, total, begin, m.end(), j))
        close()
        return out

    def _parts_of(self, text: bytes, a: int, b: int) -> list[tuple[int, int, int]]:
        return [(a + s, 4, a + e) for s, e in self.parts(text[a:b])] if b > a else []

    def scan(self, text: bytes) -> list[tuple[int, int, int]]:
        """All spans as (start, kind, end), sorted, in code points."""
        out = self.base(text)
        if b"t" * self.min_chars in text.translate(_TOKEN_RUN):
            taken = _joined(out)
            ends = [e for _, e in taken]
            for m in _CANDIDATE.finditer(text):
                a, b = m.span()
                if b - a < self.min_chars:
                    continue
                k = bisect_right(ends, a)
                touched = k < len(taken) and taken[k][0] < b
                if not touched and self.is_random(m[0]):
                    out.append((a, 3, b))
                    continue
                while k < len(taken) and taken[k][0] < b:
                    out += self._parts_of(text, a, taken[k][0])
                    a = taken[k][1]
                    k += 1
                out += self._parts_of(text, a, b)
        if out and not text.isascii():
            points: dict[int, int] = {}
            before = at = 0
            for x in sorted({x for s, _, e in out for x in (s, e)}):
                at += len(text[before:x].decode())
                points[x], before = at, x
            out = [(points[s], k, points[e]) for s, k, e in out]
        return sorted(out)


def _scanner(docs: DataFrame, ranks_path: str, min_chars: int, max_ratio: float):
    small_batches(docs)
    with open(ranks_path, "rb") as f:  # a vocabulary file, about 1 MB
        return share(docs.sparkSession.sparkContext, Scanner(f.read(), min_chars, max_ratio))


def scan(docs: DataFrame, ranks_path: str, doc_id: str = "doc_id", text: str = "text", min_chars: int = 20, max_ratio: float = 2.2) -> DataFrame:
    """One row for each row of ``docs``: its id and spans (kind, begin, end), sorted by begin and kind."""
    shared = _scanner(docs, ranks_path, min_chars, max_ratio)
    kind = docs.schema[doc_id].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [[{"kind": KINDS[k], "begin": s, "end": e} for s, k, e in shared.value.scan(x)] for x in texts(batch)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int64()), ("end", pa.int64())])))], [doc_id, "spans"])

    return docs.select(F.col(doc_id), F.col(text).alias("text")).mapInArrow(run, f"`{doc_id}` {kind}, spans array<struct<kind:string,begin:long,end:long>>")


def redact(docs: DataFrame, ranks_path: str, text: str = "text", length: str | None = None, mark: str = "[SECRET]", min_chars: int = 20, max_ratio: float = 2.2) -> DataFrame:
    """``docs`` with all columns, each run of overlapping spans in its text replaced by ``mark``.

    length: a column with the text's number of code points, set anew where a text changes.
    """
    shared = _scanner(docs, ranks_path, min_chars, max_ratio)
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            changed = {}
            for i, x in enumerate(texts(batch, text)):
                if spans := shared.value.scan(x):
                    changed[i] = replaced(x.decode(), spans, mark)
            if changed:
                at = names.index(text)
                column = batch.column(at).to_pylist()
                for i, x in changed.items():
                    column[i] = x
                batch = batch.set_column(at, batch.schema.field(at), pa.array(column, batch.schema.field(at).type))
                if length is not None:
                    at = names.index(length)
                    sizes = batch.column(at).to_pylist()
                    for i, x in changed.items():
                        sizes[i] = len(x)
                    batch = batch.set_column(at, batch.schema.field(at), pa.array(sizes, batch.schema.field(at).type))
            yield batch

    return docs.mapInArrow(run, docs.schema)


def replaced(text: str, spans: list[tuple[int, int, int]], mark: str) -> str:
    out, at = [], 0
    for s, _, e in spans:
        if s >= at:
            out += [text[at:s], mark]
        at = max(at, e)
    return "".join([*out, text[at:]])
