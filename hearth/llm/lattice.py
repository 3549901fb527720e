"""Segmentation lattices over a fixed vocabulary, for many words at once.

A word is scored by the sum over all its segmentations into vocabulary pieces of the
product of the piece probabilities.  The lattices of a few ten thousand words are laid
out in numpy arrays: one node for each position, one arc for each piece that fits.
Several models (columns of log probabilities) share the arcs.
"""

from __future__ import annotations

import numpy as np

from .vocabulary import BPE, BYTE, MARK, NORMAL, USER_DEFINED, Model

#: A code point takes 21 bits in an edge's key.
_BITS = 21


class Vocabulary:
    """A trie of the pieces, as arrays; a few MB for 32 thousand pieces.

    A character that no piece of its own covers gets an arc made of its UTF-8 bytes'
    pieces (``byte_ids``); these always exist here: without byte pieces in the file,
    256 are added behind the last id.
    """

    def __init__(self, pieces: dict[str, int], byte_ids: list[int], size: int):
        child: dict[int, int] = {}
        piece_of = [-1]
        for piece, at in pieces.items():
            node = 0
            for ch in piece:
                key = node << _BITS | ord(ch)
                if key not in child:
                    child[key] = len(piece_of)
                    piece_of.append(-1)
                node = child[key]
            if node:
                piece_of[node] = at
        keys = np.fromiter(child, dtype=np.int64, count=len(child))
        order = np.argsort(keys)
        self.keys = np.append(keys[order], np.iinfo(np.int64).max)
        self.child = np.append(np.fromiter(child.values(), dtype=np.int32, count=len(child))[order], 0)
        self.piece_of = np.array(piece_of, dtype=np.int32)
        self.first = np.zeros(1 << 16, dtype=np.int32)
        low = (self.keys < 1 << 16) & (self.keys >= 0)
        self.first[self.keys[low]] = self.child[low]
        self.byte_ids = np.array(byte_ids, dtype=np.int64)
        self.size = size

    @classmethod
    def of(cls, model: Model) -> Vocabulary:
        pieces = {p: i for i, (p, k) in enumerate(zip(model.pieces, model.kinds, strict=True)) if k in (NORMAL, USER_DEFINED)}
        size, byte_ids = len(model.pieces), model.byte_ids()
        if not byte_ids:
            byte_ids, size = list(range(size, size + 256)), size + 256
        return cls(pieces, byte_ids, size)

    def _next(self, node: np.ndarray, code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        key = node.astype(np.int64) << _BITS | code
        at = np.searchsorted(self.keys, key)
        return self.child[at], self.keys[at] == key


class Lattice:
    """The arcs of ``words`` (each one not empty)."""

    def __init__(self, vocabulary: Vocabulary, words: list[str]):
        self.vocabulary = vocabulary
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.int64)
        lengths = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        ends = np.cumsum(lengths)
        word = np.repeat(np.arange(len(words)), lengths)
        end_of = ends[word]
        at = np.arange(len(codes))
        node = np.where(codes < 1 << 16, vocabulary.first[np.minimum(codes, (1 << 16) - 1)], 0)
        if (high := np.flatnonzero(codes >= 1 << 16)).size:
            reached, ok = vocabulary._next(np.zeros(high.size, dtype=np.int64), codes[high])
            node[high] = np.where(ok, reached, 0)
        start, stop, piece = [], [], []
        single = np.zeros(len(codes), dtype=bool)
        ok, length = node > 0, 1
        while True:
            at, node = at[ok], node[ok]
            if not at.size:
                break
            is_piece = vocabulary.piece_of[node] >= 0
            start.append(at[is_piece])
            stop.append(at[is_piece] + length)
            piece.append(vocabulary.piece_of[node[is_piece]])
            if length == 1:
                single[at[is_piece]] = True
            inside = at + length < end_of[at]
            at, node = at[inside], node[inside]
            node, ok = vocabulary._next(node, codes[at + length])
            length += 1
        bare = np.flatnonzero(~single)
        #: The characters without a piece; arcs of them have ids from ``vocabulary.size`` on.
        self.chars, which = np.unique(codes[bare], return_inverse=True)
        start = np.concatenate([*start, bare])
        stop = np.concatenate([*stop, bare + 1])
        self.piece = np.concatenate([*piece, vocabulary.size + which.ravel()]).astype(np.int64)
        # word w begins at node ends[w] - lengths[w] + w
        self.begin = ends - lengths + np.arange(len(words))
        self.end = self.begin + lengths
        self.source, self.target = start + word[start], stop + word[start]
        self.word = word[start]
        self.nodes = len(codes) + len(words)

    def _weights(self, logp: np.ndarray) -> np.ndarray:
        if not self.chars.size:
            return logp
        own = [logp[self.vocabulary.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))]].sum(axis=0) for c in self.chars]
        return np.concatenate([logp, np.array(own)])

    def _run(self, weight: np.ndarray, step: np.ndarray, source: np.ndarray, target: np.ndarray, origin: np.ndarray) -> np.ndarray:
        """Log sums over the paths from ``origin``, one step of distance after the other."""
        out = np.full((self.nodes, weight.shape[1]), -np.inf)
        out[origin] = 0
        order = np.lexsort((target, step))
        step, source, target = step[order], source[order], target[order]
        fresh = np.flatnonzero(np.diff(target, prepend=-1))
        bounds = np.searchsorted(step[fresh], np.arange(1, (step[-1] if step.size else 0) + 2))
        edges = np.append(fresh, len(step))
        weight = weight[order]
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if a < b:
                i, j = edges[a], edges[b]
                out[target[fresh[a:b]]] = np.logaddexp.reduceat(out[source[i:j]] + weight[i:j], fresh[a:b] - i, axis=0)
        return out

    def score(self, logp: np.ndarray) -> np.ndarray:
        """Natural log of the marginal probability of each word under each column of ``logp``."""
        return self._forward(self._weights(logp)[self.piece])[self.end]

    def _forward(self, weight: np.ndarray) -> np.ndarray:
        return self._run(weight, self.target - self.begin[self.word], self.source, self.target, self.begin)

    def expected(self, logp: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of each piece (one model), each word counting ``counts`` times."""
        weight = self._weights(logp[:, None])[self.piece]
        ahead = self._forward(weight)
        back = self._run(weight, self.end[self.word] - self.source, self.target, self.source, self.end)
        use = np.exp(ahead[self.source] + weight + back[self.target] - ahead[self.end[self.word]])[:, 0] * counts[self.word]
        v = self.vocabulary
        total = np.bincount(self.piece, weights=use, minlength=v.size + len(self.chars))
        out = total[: v.size].copy()
        for c, n in zip(self.chars, total[v.size :], strict=False):
            np.add.at(out, v.byte_ids[list(chr(c).encode("utf-8", "surrogatepass"))], n)
        return out


def chunks(words: list[str], max_chars: int = 300_000):
    """Cut a list of words so that the lattices of one part stay small."""
    part, size = [], 0
    for w in words:
        part.append(w)
        size += len(w)
        if size >= max_chars:
            yield part
            part, size = [], 0
    if part:
        yield part


def score_words(vocabulary: Vocabulary, logp: np.ndarray, words: list[str]) -> np.ndarray:
    """Log probabilities of words, each one with the word mark before it."""
    found = [Lattice(vocabulary, [MARK + w for w in part]).score(logp) for part in chunks(words)]
    return np.concatenate(found) if found else np.zeros((0, logp.shape[1]))


def expected_uses(vocabulary: Vocabulary, logp: np.ndarray, words: list[str], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece over words with their counts, under one model."""
    out, at = np.zeros(vocabulary.size), 0
    for part in chunks(words):
        out += Lattice(vocabulary, [MARK + w for w in part]).expected(logp, counts[at : at + len(part)])
        at += len(part)
    return out


def prior(model: Model, size: int) -> np.ndarray:
    """Log probabilities from the scores in a model file.

    A unigram model's scores are log probabilities.  A BPE model's scores are minus the
    rank of a merge; the piece of rank r gets a probability in proportion to 1 / (r + 1).
    Pieces without such a score (controls, bytes beside a BPE) get the least one.
    """
    scores = np.full(size, np.nan)
    used = np.array([k in (NORMAL, USER_DEFINED) or k == BYTE and model.model_type != BPE for k in model.kinds])
    scores[: len(used)][used] = np.array(model.scores)[used]
    if model.model_type == BPE:
        scores = -np.log1p(np.maximum(0, -scores))
    scores = np.where(np.isnan(scores), np.nanmin(scores), scores)
    return scores - np.logaddexp.reduce(scores)
