"""SentencePiece encoding by sampling segmentations, and lossless decoding.

A text, with a space before it, is cut before each run of spaces into units; no piece of the model goes on over such a place
but those of spaces alone. Over the pieces inside a unit stands a lattice; forward filtering gives each
position the total weight of the ways to it, and backward sampling draws one way from the end, a uniform number
per step from (seed, row key, unit, step). A unit longer than UNIT characters is filtered by logarithms, STRETCH characters
at a time with the sums carried on, and sampled backwards in the same stretches, whose edges are then found again: memory
is bounded but for a number a character, and no stretch changes a result. So a row's segmentation depends on its key and text alone, never on
its partition. Weights: a BPE model stores merge ranks, not probabilities, so a piece of rank r weighs as Zipf's
law has it, (1 / (r + 2)) ** sharpness. Characters without a piece, and the space mark itself where the text
holds it, are spelt in byte pieces, which makes decoding exact for every text.

Null texts are empty and get no pieces; null keys count as 0; repeated rows get the same pieces; further columns stay.
"""

from __future__ import annotations

import functools
import itertools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import hold, mix, slices

SPACE = "▁"
#: Characters of a unit whose lattice is kept; of a longer unit's that are looked at together; of units whose lattices are made together.
UNIT, STRETCH, BATCH = 64, 1 << 15, 1 << 18
#: Units whose lattices a worker keeps; then it starts anew.
UNITS = 120_000
_GRID = float(1 << 24)
_CUT = re.compile(" +[^ ]*")
_BASE = 0x9E3779B97F4A7C15
_SCALE = 1000.0  # per character, against underflow
_RARE = 1e-7


class Lattices:
    """Sampler for one model; keeps the lattices of the units seen."""

    def __init__(self, path: str, sharpness: float):
        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        self.byte = np.zeros(256, np.int64)
        self.bytes: list[bytes] = []
        self.weight: dict[str, tuple[int, float]] = {}
        total = sum((1 / (r + 2)) ** sharpness for r in range(size))
        for i in range(size):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.byte[int(piece[1:-1], 16)] = i
                self.bytes.append(bytes([int(piece[1:-1], 16)]))
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes.append(b"")
            else:
                rank = min(-model.get_score(i), size)
                self.weight[piece.replace(SPACE, " ")] = i, (1 / (rank + 2)) ** sharpness / total * _SCALE ** len(piece)
                self.bytes.append(piece.replace(SPACE, " ").encode())
        self.tables = self._tables()
        self.reset()

    def _tables(self) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per length: hashes of the beginnings of pieces in order; id (-1: no piece) and weight; whether a longer piece begins so."""
        levels: list[dict[int, list]] = [{} for _ in range(max(map(len, self.weight)))]
        for piece, (i, w) in self.weight.items():
            h, last = 0, len(piece) - 1
            for k, c in enumerate(piece):
                h = (h * _BASE + ord(c) + 1) % (1 << 64)
                entry = levels[k].setdefault(h, [-1, 0.0, False])
                if k < last:
                    entry[2] = True
                else:
                    entry[:2] = i, w
        out = []
        for level in levels:
            known = sorted(level)
            rows = [level[h] for h in known]
            out.append((np.array(known, np.uint64), np.array([r[0] for r in rows], np.int32), np.array([r[1] for r in rows]), np.array([r[2] for r in rows], bool)))
        return out

    def reset(self) -> None:
        self.units: dict[str, int] = {}
        self.first, self.last = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.nodes = 0
        self.head = np.zeros(0, np.int32)
        self.until, self.back, self.piece = np.zeros(0), np.zeros(0, np.int32), np.zeros(0, np.int32)

    def edges(self, codes: np.ndarray, left: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Pieces in a text of characters: where they begin, length, id, weight; by end, long pieces first. left: characters that a piece may have from each place."""
        parts = []
        at = np.arange(len(codes))  # where a piece of this length may begin
        hashes = np.zeros(len(codes), np.uint64)
        for k, (known, ids, weights, more) in enumerate(self.tables, 1):
            hashes = hashes * np.uint64(_BASE) + codes[at + k - 1] + np.uint64(1)
            found = np.minimum(np.searchsorted(known, hashes), len(known) - 1)
            begins = known[found] == hashes
            hit = begins & (ids[found] >= 0)
            own = found[hit]
            parts.append((at[hit], np.full(len(own), k), ids[own], weights[own]))
            if k == 1:
                alone = at[~hit]
                parts.append((alone, np.ones(len(alone), np.int64), -codes[alone].astype(np.int32) - 1, np.full(len(alone), _RARE * _SCALE)))
            on = begins & more[found] & (left[at] > k)
            at, hashes = at[on], hashes[on]
            if not len(at):
                break
        at, length, piece, weight = (np.concatenate(x) for x in zip(*parts[::-1], strict=True))
        order = np.argsort(at + length, kind="stable")  # by end, then start, as long pieces come first; nodes are characters plus one per unit before
        at, length, piece, weight = at[order], length[order], piece[order], weight[order]
        return at, length, piece, weight

    def add(self, units: list[str]) -> None:
        """Lattices of new units, all at once. A unit of n characters has n + 1 nodes; an edge is a piece between two."""
        sizes = np.array([len(u) for u in units], np.int64)
        codes = np.frombuffer("".join(units).encode("utf-32-le"), np.uint32).astype(np.uint64)
        owner = np.repeat(np.arange(len(units)), sizes)
        starts = np.cumsum(sizes) - sizes
        left = np.repeat(starts + sizes, sizes) - np.arange(len(codes))  # characters from here to the end of the unit
        local = np.arange(len(codes)) - np.repeat(starts, sizes)
        at, length, piece, weight = self.edges(codes, left)
        start = at + owner[at]
        end = start + length
        step = local[at] + length
        forward = np.zeros(len(codes) + len(units))
        forward[starts + np.arange(len(units))] = 1.0
        by_step = np.argsort(step.astype(np.uint8), kind="stable")  # a unit has at most UNIT steps
        bounds = np.searchsorted(step[by_step], np.arange(1, int(sizes.max(initial=0)) + 2))
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            e = by_step[a:b]
            np.add.at(forward, end[e], forward[start[e]] * weight[e])
        share = forward[start] * weight / forward[end]
        group = np.cumsum(np.concatenate([[True], end[1:] != end[:-1]])) - 1 if len(end) else np.zeros(0, np.int64)
        head = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(end) else np.zeros(0, np.int64)
        rank = np.arange(len(end)) - head[group]
        table = np.zeros((len(head), int(rank.max(initial=0)) + 1))
        table[group, rank] = share
        until = np.floor(np.cumsum(table, axis=1)[group, rank] * _GRID + 0.5) / _GRID  # on a grid, so that sums are exact anywhere
        tail = np.concatenate([head[1:], [len(end)]]) - 1 if len(end) else head
        until[tail] = 1.0
        self.units.update(zip(units, range(len(self.first), len(self.first) + len(units)), strict=True))
        first = starts + np.arange(len(units)) + self.nodes
        self.first, self.last = np.concatenate([self.first, first]), np.concatenate([self.last, first + sizes])
        heads = np.zeros(len(forward), np.int64)
        heads[end[head]] = head + len(self.until)
        self.head = np.concatenate([self.head, heads.astype(np.int32)])
        self.until = np.concatenate([self.until, until])
        self.back = np.concatenate([self.back, (start + self.nodes).astype(np.int32)])
        self.piece = np.concatenate([self.piece, piece])
        self.nodes += len(codes) + len(units)

    def long(self, unit: str, seed: np.uint64) -> np.ndarray:
        """Pieces drawn for one unit of any length, as `draw` does for short ones."""
        codes = np.frombuffer(unit.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n, most = len(codes), len(self.tables)
        forward = np.full(n + 1, -np.inf)  # log of the total weight of the ways to each place
        forward[0] = 0.0

        def stretch(a: int, b: int) -> tuple[np.ndarray, ...]:
            """Edges that end in a+1 .. b: start, end, id, log weight, and the first edge of each end."""
            base = max(0, a - most)
            at, length, piece, weight = self.edges(codes[base:b], b - base - np.arange(b - base))
            keep = at + length + base > a
            start, end = at[keep] + base, (at + length)[keep] + base
            return start, end, piece[keep], np.log(weight[keep]), np.searchsorted(end, np.arange(a + 1, b + 2))

        for a in range(0, n, STRETCH):
            b = min(n, a + STRETCH)
            start, _, _, weight, first = stretch(a, b)
            for k in range(b - a):
                ways = forward[start[first[k] : first[k + 1]]] + weight[first[k] : first[k + 1]]
                top = ways.max()
                forward[a + k + 1] = top + np.log(np.exp(ways - top).sum())
        out, at, step = [], n, 0
        for a in reversed(range(0, n, STRETCH)):
            if at <= a:
                continue
            b = min(n, a + STRETCH)
            start, _, piece, weight, first = stretch(a, b)
            numbers = ((mix(seed + np.arange(step + 1, step + at - a + 1, dtype=np.uint64)) >> np.uint64(40)).astype(np.float64) + 0.5) / _GRID
            base = step
            while at > a:
                i, j = first[at - a - 1], first[at - a]
                share = np.cumsum(np.exp(forward[start[i:j]] + weight[i:j] - forward[at]))
                pick = min(int(np.searchsorted(np.floor(share * _GRID + 0.5) / _GRID, numbers[step - base], "right")), j - i - 1)
                out.append(piece[i + pick])
                at, step = int(start[i + pick]), step + 1
        return np.array(out[::-1], np.int64)

    def draw(self, units: list[str], seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces drawn for units, one after the other, and how many each has."""
        far = [i for i, u in enumerate(units) if len(u) > UNIT]
        short = units if not far else ["" if len(u) > UNIT else u for u in units]
        wanted = set(short) - {""}
        missing = wanted - self.units.keys()
        if len(self.units) + len(missing) > UNITS:
            self.reset()
            missing = wanted
        if missing:
            self.add(sorted(missing))
        near = np.array([i for i, u in enumerate(short) if u], np.int64) if far else np.arange(len(units))
        unit = np.fromiter((self.units[short[i]] for i in near.tolist()), np.int64, len(near)) if far else np.fromiter(map(self.units.__getitem__, units), np.int64, len(units))
        seed = seeds[near]
        first, at = self.first[unit], self.last[unit]
        live, steps = np.arange(len(unit)), []
        while len(live):
            u = ((mix(seed[live] + np.uint64(len(steps) + 1)) >> np.uint64(40)).astype(np.float64) + 0.5) / _GRID
            edge = self.head[at[live]]
            wait = np.flatnonzero(self.until[edge] <= u)
            while len(wait):  # a node has few edges
                edge[wait] += 1
                wait = wait[self.until[edge[wait]] <= u[wait]]
            steps.append((near[live], self.piece[edge]))
            at[live] = self.back[edge]
            live = live[at[live] != first[live]]
        length = np.zeros(len(units), np.int64)
        for who, _ in steps:
            length[who] += 1
        whole = {i: self.long(units[i], seeds[i]) for i in far}
        for i, own in whole.items():
            length[i] = len(own)
        ends = np.cumsum(length)
        ids = np.zeros(int(ends[-1]) if len(ends) else 0, np.int64)
        for k, (who, own) in enumerate(steps):
            ids[ends[who] - 1 - k] = own
        for i, own in whole.items():
            ids[ends[i] - len(own) : ends[i]] = own
        return ids, length

    def sample(self, texts: list[str], seeds: np.ndarray) -> list[np.ndarray]:
        """Piece ids of each text."""
        cut = [_CUT.findall(" " + t) if t else [] for t in texts]
        counts = np.array([len(c) for c in cut], np.int64)
        units = [*itertools.chain.from_iterable(cut)]
        begin = np.cumsum(counts) - counts
        place = np.arange(len(units)) - np.repeat(begin, counts)
        seed = mix(np.repeat(seeds, counts) + place.astype(np.uint64) * np.uint64(0xD1342543DE82EF95))
        sizes = np.fromiter(map(len, units), np.int64, len(units))
        blocks = np.searchsorted(np.cumsum(sizes), np.arange(BATCH, int(sizes.sum()), BATCH)) if len(units) else []
        drawn = [self.draw(units[a:b], seed[a:b]) for a, b in zip([0, *blocks], [*blocks, len(units)], strict=True)]
        ids, length = (np.concatenate(x) for x in zip(*drawn, strict=True))
        bounds = np.concatenate([[0], np.cumsum(length)])[np.cumsum(counts)]
        return [self.spell(part) for part in np.split(ids, bounds[:-1])]

    def spell(self, ids: np.ndarray) -> np.ndarray:
        """Byte pieces for the characters that have none of their own."""
        if len(ids) and ids.min() < 0:
            rare, code = ids < 0, -ids - 1
            sizes = np.where(rare, 1 + (code >= 0x80) + (code >= 0x800) + (code >= 0x10000), 1)
            raw = "".join(map(chr, code[rare].tolist())).encode()
            ids, rare = np.repeat(ids, sizes), np.repeat(rare, sizes)
            ids[rare] = self.byte[np.frombuffer(raw, np.uint8)]
        return ids.astype(np.int32)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.bytes.__getitem__, ids))[1:]


@functools.lru_cache(maxsize=2)
def lattices(path: str, sharpness: float) -> Lattices:
    return Lattices(path, sharpness)


def _sampled(model: Lattices, keys: pa.Array, texts: list[bytes], seed: int) -> list[np.ndarray]:
    own = keys.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
    return model.sample([t.decode("utf-8", "replace") for t in texts], mix(own + np.uint64(seed)))


def _lists(ids: list[np.ndarray]) -> pa.Array:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([np.zeros(0, np.int32), *ids])))


def encode(docs: DataFrame, model_path: str, key: str = "doc_id", seed: int = 11, sharpness: float = 2.0) -> DataFrame:
    """docs with `pieces`, the sampled ids of text; a column of that name is replaced."""
    docs = docs.drop("pieces")
    columns = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(columns))])  # no name can clash
    body, own = columns.index("text"), columns.index(key)
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_path, sharpness)
        hold("pieces", model.reset)
        for rows, texts in slices(batches, f"c{body}", budget=1 << 20):
            ids = _sampled(model, rows.column(own), texts, seed)
            yield pa.RecordBatch.from_arrays([*rows.columns, _lists(ids)], names=[*rows.schema.names, "pieces"])

    return held.mapInArrow(run, f"{fields}, pieces array<int>").toDF(*columns, "pieces")


def decode(rows: DataFrame, model_path: str, sharpness: float = 2.0) -> DataFrame:
    """rows with `decoded`, the text of pieces; a column of that name is replaced."""
    rows = rows.drop("decoded")
    columns = rows.columns
    held = rows.toDF(*[f"c{i}" for i in range(len(columns))])
    own = columns.index("pieces")
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in held.schema.fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_path, sharpness)
        hold("pieces", model.reset)
        for batch in batches:
            for i in range(0, batch.num_rows, 500):
                part = batch.slice(i, 500)
                texts = [model.decode(x or []) for x in part.column(own).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary()).cast(pa.string())], names=[*part.schema.names, "decoded"])

    return held.mapInArrow(run, f"{fields}, decoded string").toDF(*columns, "decoded")


def encoded_report(docs: DataFrame, model_path: str, seed: int = 11, sharpness: float = 2.0) -> DataFrame:
    """(doc_id, n_pieces, pieces, lossless): `encode`, and in the same pass whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattices(model_path, sharpness)
        hold("pieces", model.reset)
        for rows, texts in slices(batches, budget=1 << 20):
            keys, ids = rows.column("doc_id"), _sampled(model, rows.column("doc_id"), texts, seed)
            same = [model.decode(i.tolist()) == t for i, t in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([keys, pa.array([len(i) for i in ids], pa.int64()), _lists(ids), pa.array(same)], names=["doc_id", "n_pieces", "pieces", "lossless"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_pieces long, pieces array<int>, lossless boolean")
