"""SentencePiece encoding and decoding on the Tokenizers library.

The model file is parsed here (``vocabulary``); normaliser, word mark, merges or unigram
scores, and byte fallback are rebuilt as one tokenizer.  Texts are cut where no piece can
reach across (before a run of word marks, around a line end if no piece holds one); each
distinct unit is encoded once in a multithreaded batch and its ids are put together.
Parity: every such unit is also encoded by the SentencePiece library and decoded again.

Defined results: a null text gives null ids, false flags stay null too; an empty one gives
no ids.  Repeated rows each get a row.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from itertools import chain
from operator import ne

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Regex, Tokenizer, decoders, models, normalizers, pre_tokenizers

from .common import share, slices, small_batches
from .vocabulary import BYTE, MARK, NORMAL, UNIGRAM, USER_DEFINED, Model, parse_model

#: Units that a task holds, and their ids in all; beyond it only those units stay that several batches had.
CACHE_UNITS, CACHE_IDS = 200_000, 8 << 20
#: Units that the libraries get at once and as one text, and bytes of text that are cut at once.
BATCH_UNITS, JOINED_UNITS, BATCH_BYTES = 20_000, 500, 512 << 10
#: Field 3 (normaliser) with no dummy prefix (3) and white space kept (4): added to a
#: model file, these override its own, so that units are encoded as they stand.
_AS_IT_STANDS = bytes([0x1A, 4, 0x18, 0, 0x20, 0])


def merges_of(model: Model) -> list[tuple[str, str]]:
    """The pairs that a BPE model merges, best first: a pair counts as the piece that it makes."""
    ids = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
    found = []
    for piece, i in ids.items():
        for cut in range(1, len(piece)):
            left, right = piece[:cut], piece[cut:]
            if left in ids and right in ids:
                found.append((-model.scores[i], ids[left], ids[right], left, right))
    return [(left, right) for *_, left, right in sorted(found)]


def build_tokenizer(model: Model) -> Tokenizer:
    unknown = model.pieces[model.unk_id]
    if model.model_type == UNIGRAM:
        core = models.Unigram(list(zip(model.pieces, model.scores, strict=True)), model.unk_id, model.byte_fallback)
    else:
        core = models.BPE({p: i for i, p in enumerate(model.pieces)}, merges_of(model), unk_token=unknown, fuse_unk=True, byte_fallback=model.byte_fallback)
    tokenizer = Tokenizer(core)
    tokenizer.normalizer = build_normaliser(model)
    if pattern := unit_pattern(model):
        tokenizer.pre_tokenizer = pre_tokenizers.Split(Regex(pattern), "isolated")
    ends = [decoders.Strip(" ", 1, 0)] if model.add_dummy_prefix else []
    tokenizer.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse(), *ends])
    return tokenizer


def build_normaliser(model: Model) -> normalizers.Normalizer:
    steps: list = [normalizers.Precompiled(model.charsmap)] if model.charsmap else []
    if model.remove_extra_whitespaces:
        steps += [normalizers.Replace(Regex("^ +| +$"), ""), normalizers.Replace(Regex(" {2,}"), " ")]
    if model.add_dummy_prefix:
        steps.append(normalizers.Prepend(MARK))
    if model.escape_whitespaces:
        steps.append(normalizers.Replace(" ", MARK))
    return normalizers.Sequence(steps)


def unit_pattern(model: Model) -> str | None:
    """What a unit is; None if some piece has a word mark behind another character.

    Only BPE pieces are cut so: no merge crosses a unit's end.
    """
    pieces = [p for p, k in zip(model.pieces, model.kinds, strict=True) if k in (NORMAL, USER_DEFINED)]
    if model.model_type == UNIGRAM or any(MARK in p.lstrip(MARK) for p in pieces):
        return None
    if any("\n" in p for p in pieces):
        return f"{MARK}+[^{MARK}]*|[^{MARK}]+"
    return f"\n|{MARK}+[^{MARK}\n]*|[^{MARK}\n]+"


class _Units:
    """Distinct units with their ids and checks, in arrays of a fixed size: ``CACHE_UNITS`` units and ``CACHE_IDS`` ids, or what one text needs."""

    def __init__(self):
        self.at: dict[str, int] = {}
        self.start = np.zeros(1, dtype=np.int64)
        self.ids = np.zeros(0, dtype=np.int32)
        self.batches, self.differs, self.changed = (np.zeros(0, dtype=kind) for kind in (np.int32, bool, bool))

    def add(self, units: list[str], ids: np.ndarray, lengths: np.ndarray, differs: list[bool] | bool, changed: list[bool] | bool) -> None:
        """Units with their ids, one unit after the other."""
        n, m = len(self.at), int(self.start[len(self.at)])
        self.start = _roomy(self.start, n + 1 + len(units), CACHE_UNITS + 1)
        self.ids = _roomy(self.ids, m + len(ids), CACHE_IDS)
        self.start[n + 1 : n + 1 + len(units)] = m + np.cumsum(lengths)
        self.ids[m : m + len(ids)] = ids
        for name, values in (("batches", 0), ("differs", differs), ("changed", changed)):
            column = _roomy(getattr(self, name), n + len(units), CACHE_UNITS)
            column[n : n + len(units)] = values
            setattr(self, name, column)
        self.at.update(zip(units, range(n, n + len(units)), strict=True))

    def full(self, units: int, size: int) -> bool:
        """Whether so many more units, of so many bytes, may not find room (a piece has a byte at least)."""
        return bool(self.at) and (len(self.at) + units > CACHE_UNITS or self.start[len(self.at)] + size > CACHE_IDS)

    def renewed(self) -> _Units:
        """A table of the units that several batches had, if these leave half of the room; else an empty one."""
        out, n = _Units(), len(self.at)
        keep = np.flatnonzero(self.batches[:n] > 1)
        where, lengths = self.gather(keep)
        if keep.size and 2 * keep.size <= CACHE_UNITS and 2 * where.size <= CACHE_IDS:
            names = list(self.at)
            out.add([names[k] for k in keep], self.ids[where], lengths, self.differs[keep], self.changed[keep])
        return out

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the ids of the units ``at`` are, one unit after the other, and their numbers."""
        lengths = self.start[at + 1] - self.start[at]
        ends = np.cumsum(lengths)
        return np.repeat(self.start[at] - ends + lengths, lengths) + np.arange(ends[-1] if ends.size else 0), lengths


def _roomy(values: np.ndarray, size: int, usual: int) -> np.ndarray:
    """``values``, or a copy in a larger array if ``size`` don't fit."""
    if len(values) >= size:
        return values
    out = np.zeros(max(size, usual), dtype=values.dtype)
    out[: len(values)] = values
    return out


class Codec:
    """One model's encoder and decoder, built from the bytes of its file in each worker."""

    def __init__(self, data: bytes, threads: int = 2):
        self.data, self.threads = data, threads
        self._ready = False

    def __getstate__(self):
        return self.data, self.threads

    def __setstate__(self, state):
        self.__init__(*state)

    def _prepare(self) -> None:
        if self._ready:
            return
        os.environ.setdefault("RAYON_NUM_THREADS", str(self.threads))
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "true")
        self.model = parse_model(self.data)
        self.normaliser = build_normaliser(self.model)
        pattern = unit_pattern(self.model)
        self.pattern = re.compile(pattern) if pattern else None
        # units are normalised already and decode with their leading space
        self.units = build_tokenizer(self.model)
        self.units.normalizer = None
        self.units.pre_tokenizer = None
        self.units.decoder = decoders.Sequence([decoders.Replace(MARK, " "), decoders.ByteFallback(), decoders.Fuse()])
        self.reference = sentencepiece.SentencePieceProcessor(model_proto=self.data + _AS_IT_STANDS)
        self.piece_bytes = np.array([1 if k == BYTE else len(p.encode()) for p, k in zip(self.model.pieces, self.model.kinds, strict=True)])
        self.known = _Units()
        self._ready = True

    def normalise(self, text: str) -> str:
        self._prepare()
        return self.normaliser.normalize_str(text) if text else ""

    def cut(self, normalised: str) -> list[str]:
        return self.pattern.findall(normalised) if self.pattern else [normalised] if normalised else []

    def learn(self, units: list[str]) -> np.ndarray:
        """Where the distinct units are in the table; new ones are encoded by both libraries and decoded again."""
        known = self.known
        fresh = [u for u in units if u not in known.at]
        if known.full(len(fresh), sum(map(len, fresh)) * 4) or not self.pattern:
            known = self.known = known.renewed() if self.pattern else _Units()
            fresh = [u for u in units if u not in known.at]
        for begin in range(0, len(fresh), BATCH_UNITS):
            self._encode_units(fresh[begin : begin + BATCH_UNITS])
        at = np.fromiter(map(known.at.__getitem__, units), dtype=np.int64, count=len(units))
        known.batches[at] += 1
        return at

    def _encode_units(self, units: list[str]) -> None:
        """Both libraries get a few hundred units at a time as one text; only where that differs each unit is looked at."""
        groups = [units[i : i + JOINED_UNITS] for i in range(0, len(units), JOINED_UNITS)] if self.pattern else []
        joined = ["".join(g) for g in groups]
        ids = [np.array(e.ids, dtype=np.int32) for e in self.units.encode_batch_fast(groups, is_pretokenized=True, add_special_tokens=False)]
        backs = self.units.decode_batch(ids, skip_special_tokens=False)
        single = [] if self.pattern else units
        for group, text, own, other, back in zip(groups, joined, ids, self.reference.encode(joined, num_threads=self.threads), backs, strict=True):
            # a unit ends where its bytes do: its pieces tile them
            ends = np.cumsum(np.fromiter((len(u.encode()) for u in group), dtype=np.int64, count=len(group)))
            reached = np.cumsum(self.piece_bytes[own])
            at = np.searchsorted(reached, ends)
            if back == text.replace(MARK, " ") and np.array_equal(own, other) and reached[-1] == ends[-1] and np.array_equal(reached[at], ends):
                self.known.add(group, own, np.diff(at, prepend=-1), False, False)
            else:
                single = single + group
        if single:
            ids = [e.ids for e in self.units.encode_batch_fast(single, add_special_tokens=False)]
            differs = list(map(ne, ids, self.reference.encode(single, num_threads=self.threads)))
            backs = self.units.decode_batch(ids, skip_special_tokens=False)
            changed = [x.replace(MARK, " ") != y for x, y in zip(single, backs, strict=True)]
            lengths = np.fromiter(map(len, ids), dtype=np.int64, count=len(ids))
            self.known.add(single, np.fromiter(chain.from_iterable(ids), dtype=np.int32, count=int(lengths.sum())), lengths, differs, changed)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, list[bool | None], list[bool | None]]:
        """All ids, how many each text has, whether both libraries agree on it, and whether decoding gives it back."""
        self._prepare()
        normal = ["" if x is None else self.normalise(x) for x in texts]
        units = [self.cut(x) for x in normal]
        sizes = np.fromiter(map(len, units), dtype=np.int64, count=len(units))
        coded = pa.array(chain.from_iterable(units), pa.string(), size=int(sizes.sum())).dictionary_encode()
        at = self.learn(coded.dictionary.to_pylist())[coded.indices.to_numpy()]
        where, lengths = self.known.gather(at)

        def by_text(values: np.ndarray) -> np.ndarray:
            ends = np.concatenate([[0], np.cumsum(values)])
            return np.diff(ends[np.concatenate([[0], np.cumsum(sizes)])])

        differ, change = by_text(self.known.differs[at]), by_text(self.known.changed[at])
        parity = [None if x is None else not d for x, d in zip(texts, differ, strict=True)]
        same = [None if x is None else not c and self._plain(n) == x for x, n, c in zip(texts, normal, change, strict=True)]
        return self.known.ids[where], by_text(lengths), parity, same

    def _plain(self, normalised: str) -> str:
        plain = normalised.replace(MARK, " ")
        return plain[1:] if self.model.add_dummy_prefix and plain.startswith(" ") else plain

    def decode(self, ids: list[list[int]]) -> list[str]:
        self._prepare()
        found = self.units.decode_batch(ids, skip_special_tokens=False)
        return [x.removeprefix(" ") for x in found] if self.model.add_dummy_prefix else found


def _codec(df: DataFrame, model_path: str, threads: int):
    small_batches(df)
    with open(model_path, "rb") as f:  # a vocabulary file, about 1 MB
        return share(df.sparkSession.sparkContext, Codec(f.read(), threads))


def encode(docs: DataFrame, model_path: str, text: str = "text", ids: str = "ids", parity: str = "parity", round_trip: str = "round_trip", threads: int = 2) -> DataFrame:
    """``docs`` with all columns, then the ids, whether both libraries agree, whether decoding gives the text back.

    A column of ``docs`` with a name of the three new ones is replaced.
    """
    shared = _codec(docs, model_path, threads)
    docs = docs.drop(ids, parity, round_trip)
    schema = T.StructType([*docs.schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType())), T.StructField(parity, T.BooleanType()), T.StructField(round_trip, T.BooleanType())])
    names = [*docs.columns, ids, parity, round_trip]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BATCH_BYTES):
            at = batch.schema.get_field_index(text)
            values, sizes, agree, same = shared.value.encode(batch.column(at).to_pylist())
            lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), pa.array(values), mask=batch.column(at).is_null())
            yield pa.RecordBatch.from_arrays([*batch.columns, lists, pa.array(agree, pa.bool_()), pa.array(same, pa.bool_())], names)

    return docs.mapInArrow(run, schema)


def decode(encoded: DataFrame, model_path: str, ids: str = "ids", text: str = "decoded", threads: int = 2) -> DataFrame:
    """``encoded`` with the column ``text`` decoded from its ids; null stays null."""
    shared = _codec(encoded, model_path, threads)
    encoded = encoded.drop(text)
    schema = T.StructType([*encoded.schema.fields, T.StructField(text, T.StringType())])
    names = [*encoded.columns, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(batch.schema.get_field_index(ids)).to_pylist()
            found = iter(shared.value.decode([x for x in lists if x is not None]))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([None if x is None else next(found) for x in lists], pa.string())], names)

    return encoded.mapInArrow(run, schema)


def counted(encoded: DataFrame, ids: str = "ids") -> DataFrame:
    """``encoded`` with ``n_ids``, the number of ids (0 for null)."""
    return encoded.withColumn("n_ids", F.greatest(F.size(ids), F.lit(0)).cast("long"))
