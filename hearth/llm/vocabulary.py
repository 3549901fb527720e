"""Reading a SentencePiece model file without its library.

The file is a protocol buffer; only the fields that the operators need are read:
pieces (text, score, type), the model type, byte fallback, the marker options and
the normaliser's name and precompiled map.
"""

from __future__ import annotations

import struct
from dataclasses import dataclass, field

#: Piece types of the file format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
#: Model types of the file format (fixed values).
UNIGRAM, BPE = 1, 2
#: U+2581 stands for a space inside pieces.
MARK = "▁"


@dataclass
class Model:
    pieces: list[str] = field(default_factory=list)
    scores: list[float] = field(default_factory=list)
    kinds: list[int] = field(default_factory=list)
    model_type: int = UNIGRAM
    byte_fallback: bool = False
    normaliser: str = ""
    charsmap: bytes = b""
    add_dummy_prefix: bool = True
    remove_extra_whitespaces: bool = True
    escape_whitespaces: bool = True

    @property
    def unk_id(self) -> int:
        return self.kinds.index(UNKNOWN)

    def byte_ids(self) -> list[int]:
        """The ids of the 256 byte pieces, in the order of the bytes; empty without fallback."""
        found = {p: i for i, (p, k) in enumerate(zip(self.pieces, self.kinds, strict=True)) if k == BYTE}
        return [found[f"<0x{b:02X}>"] for b in range(256)] if len(found) == 256 else []


def _varint(data: bytes, at: int) -> tuple[int, int]:
    value = shift = 0
    while True:
        byte = data[at]
        at += 1
        value |= (byte & 127) << shift
        if byte < 128:
            return value, at
        shift += 7


def fields(data: bytes):
    """Yield (field number, value) of one protocol buffer message."""
    at = 0
    while at < len(data):
        key, at = _varint(data, at)
        kind = key & 7
        if kind == 0:
            value, at = _varint(data, at)
        elif kind == 1:
            value, at = data[at : at + 8], at + 8
        elif kind == 2:
            n, at = _varint(data, at)
            value, at = data[at : at + n], at + n
        elif kind == 5:
            value, at = data[at : at + 4], at + 4
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield key >> 3, value


def read_model(path: str) -> Model:
    """Parse a model file (a few MB at most)."""
    with open(path, "rb") as f:
        return parse_model(f.read())


def parse_model(data: bytes) -> Model:
    model = Model()
    for number, value in fields(data):
        if number == 1:
            piece, score, kind = "", 0.0, NORMAL
            for n, v in fields(value):
                if n == 1:
                    piece = v.decode()
                elif n == 2:
                    score = struct.unpack("<f", v)[0]
                elif n == 3:
                    kind = v
            model.pieces.append(piece)
            model.scores.append(score)
            model.kinds.append(kind)
        elif number == 2:
            for n, v in fields(value):
                if n == 3:
                    model.model_type = v
                elif n == 35:
                    model.byte_fallback = bool(v)
        elif number == 3:
            for n, v in fields(value):
                if n == 1:
                    model.normaliser = v.decode()
                elif n == 2:
                    model.charsmap = v
                elif n == 3:
                    model.add_dummy_prefix = bool(v)
                elif n == 4:
                    model.remove_extra_whitespaces = bool(v)
                elif n == 5:
                    model.escape_whitespaces = bool(v)
    return model
