"""Exact encoding of texts with the tokenizers library, each distinct piece encoded once per worker.

Neither pre-tokenizer used here joins characters across a single space between two other characters, so a
text splits there into pieces whose ids, put together, are the ids of the text. Pieces are remembered; only
unseen ones reach the library, many in one string. A text where white space stands beside a space, or a
space at an end, goes to the library as it is. Empty texts have no ids; callers pass null texts as empty ones.
"""

from __future__ import annotations

import functools
import itertools
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

#: Pieces a worker remembers at most (about 200 bytes each); then it starts anew. For counts, which have seconds to spare, fewer.
MEMO_PIECES, MEMO_COUNTS = 800_000, 400_000
#: Pieces that go to the library in one string.
TOGETHER = 300
_WHITE = "\x85"


@functools.lru_cache(maxsize=4)
def tokenizer(path: str) -> Tokenizer:
    found = Tokenizer.from_file(path)
    found.no_truncation()
    found.no_padding()
    return found


def cut(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
    """Pieces of all texts between spaces, and the place of each text's first one, with the end."""
    lists = pc.split_pattern(pa.array(texts, pa.large_string()), " ")
    return lists.values, lists.offsets.to_numpy().astype(np.int64)


class Pieces:
    """What the library gives for distinct pieces."""

    def __init__(self, path: str):
        self.library = tokenizer(path)
        added = self.library.get_added_tokens_decoder()
        self.mark_id, mark = max((i, t.content) for i, t in added.items())
        self.mark, self.added = mark, [t.content for t in added.values()]
        self.dtype = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        if hasattr(self.library.model, "_resize_cache"):
            self.library.model._resize_cache(0)  # pieces come once
        self.reset()

    def most(self) -> int:
        return MEMO_PIECES

    def reset(self) -> None:
        self.numbers, self.sizes = defaultdict(itertools.count().__next__), np.zeros(0, np.int64)  # in the order in which they were met

    def ids(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, self.dtype) for e in self.library.encode_batch_fast(texts, add_special_tokens=False)] if texts else []

    def number(self, pieces: pa.Array) -> np.ndarray:
        """Numbers of pieces; new ones are learnt. Python sees each distinct one once."""
        if len(self.numbers) > self.most():
            self.reset()
        found = pieces.dictionary_encode()
        distinct = found.dictionary.to_numpy(zero_copy_only=False).tolist()  # to_pylist takes four times as long
        known = np.fromiter(map(self.numbers.__getitem__, distinct), np.int64, len(distinct))
        new = [*itertools.islice(reversed(self.numbers), len(self.numbers) - len(self.sizes))][::-1]
        if new:
            self.sizes = np.concatenate([self.sizes, self.learn(new)])
        return known[found.indices.to_numpy()]


class PieceIds(Pieces):
    """For byte-level BPE: the ids of a piece are those of the piece after a space, and only its first one starts with that space."""

    def __init__(self, path: str):
        super().__init__(path)
        self.starts = np.zeros(self.library.get_vocab_size(), bool)
        self.starts[[i for t, i in self.library.get_vocab().items() if t.startswith("Ġ")]] = True

    def reset(self) -> None:
        super().reset()
        self.begin, self.flat, self.used = np.zeros(0, np.int64), np.zeros(1 << 16, self.dtype), 0

    def learn(self, pieces: list[str]) -> np.ndarray:
        """Keeps the ids of new pieces and gives their numbers; -1 for one that must not be cut off from its neighbours."""
        cuttable = [p != "" and p.strip() == p for p in pieces]  # "\x85" is white space here as well
        if any(a in x for x in (" ".join(pieces),) for a in self.added):
            cuttable = [c and not any(a in p for a in self.added) for c, p in zip(cuttable, pieces, strict=True)]
        good = [*itertools.compress(pieces, cuttable)]
        lines = [" " + " ".join(good[i : i + TOGETHER]) for i in range(0, len(good), TOGETHER)]
        ids = np.concatenate([np.zeros(0, self.dtype), *(x for i in range(0, len(lines), 64) for x in self.ids(lines[i : i + 64]))])
        first = np.flatnonzero(self.starts[ids])
        if len(first) != len(good):
            raise RuntimeError("pieces and their first ids don't match")
        sizes, begin = np.full(len(pieces), -1, np.int64), np.zeros(len(pieces), np.int64)
        at = np.flatnonzero(cuttable)
        sizes[at], begin[at] = np.diff(first, append=len(ids)), first + self.used
        self.begin = np.concatenate([self.begin, begin])
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.used += len(ids)
        return sizes

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text."""
        pieces, first = cut(texts)
        head = np.zeros(len(pieces), bool)
        head[first[:-1]] = True  # the first piece has no space before it
        heads = pieces.filter(pa.array(head)).to_pylist()
        counts = np.diff(first) - 1
        number = self.number(pieces.filter(pa.array(~head)))
        sizes = self.sizes[number]
        owner = np.repeat(np.arange(len(texts)), counts)
        whole = np.bincount(owner[sizes < 0], minlength=len(texts)) > 0
        whole |= [not h or h[-1].isspace() or h[-1] == _WHITE or any(a in h for a in self.added) for h in heads]
        sizes[whole[owner]] = 0
        ends = np.cumsum(sizes)
        ids = self.flat[np.repeat(self.begin[number] - (ends - sizes), sizes) + np.arange(int(ends[-1]) if len(ends) else 0)]
        rest = np.split(ids, np.concatenate([[0], ends])[np.cumsum(counts)][:-1])
        begun = self.ids([t if w else h for t, h, w in zip(texts, heads, whole.tolist(), strict=True)])
        return [b if w else np.concatenate([b, r]) for b, r, w in zip(begun, rest, whole.tolist(), strict=True)]


class PieceCounts(Pieces):
    """For tokenizers that drop white space: any space is a boundary."""

    def most(self) -> int:
        return MEMO_COUNTS

    def learn(self, pieces: list[str]) -> np.ndarray:
        """How many ids each new piece has."""
        out = np.zeros(len(pieces), np.int64)
        odd = [any(a in p for a in self.added) for p in pieces] if any(a in x for x in (" ".join(pieces),) for a in self.added) else [False] * len(pieces)
        plain, alone = ([i for i, o in enumerate(odd) if o is kind] for kind in (False, True))
        lines = [self.mark.join(pieces[i] for i in plain[k : k + TOGETHER]) for k in range(0, len(plain), TOGETHER)]
        sizes = []
        for i in range(0, len(lines), 64):
            for ids in self.ids(lines[i : i + 64]):
                sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(ids == self.mark_id), [len(ids)]])) - 1)
        out[plain] = np.concatenate([np.zeros(0, np.int64), *sizes])
        out[alone] = [len(x) for x in self.ids([pieces[i] for i in alone])]
        return out

    def count(self, texts: list[str]) -> list[int]:
        """Number of ids of each text."""
        pieces, first = cut(texts)  # one piece of each text at least
        number = self.number(pieces)
        return np.add.reduceat(self.sizes[number], first[:-1]).tolist() if len(texts) else []


@functools.lru_cache(maxsize=2)
def piece_ids(path: str) -> PieceIds:
    return PieceIds(path)


@functools.lru_cache(maxsize=2)
def piece_counts(path: str) -> PieceCounts:
    return PieceCounts(path)
