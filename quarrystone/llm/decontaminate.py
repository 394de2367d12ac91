"""Benchmark decontamination: MinHash containment search, partitioned by item size.

Words are lower-cased with all but letters and digits removed, so that decoration doesn't hide a passage; a
shingle is 5 such words (an item of fewer words is one shingle of its own width). An item is found in a document
that holds at least `least` of its distinct shingles, wherever they stand.

Items are partitioned by size, and each size n has its own signature length: the n - ceil(least * n) + 1 smallest
hashes of the item under a fixed permutation. A document that holds enough of the item must hold one of these, so
probing documents of any length with the signatures misses nothing. Candidates are verified by exact containment
of all shingles.

Items are held in blocks of at most BLOCK bytes, each a pass over the documents, so no broadcast outgrows a bound.
Null or wordless texts match nothing, repeated rows are each reported, equal items too; an empty table gives none.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import WordIds, hold, mix, shingles, slices

WIDTH, LEAST = 5, 0.8
BLOCK = 16 << 20
_DROP = re.compile(r"[\W_]+")


class PlainIds(WordIds):
    """Ids of words without case and punctuation; 0 for what has neither letters nor digits."""

    def make(self, word: bytes) -> int:
        plain = _DROP.sub("", word.decode("utf-8", "replace").lower()).encode()
        return super().make(plain) or 1 if plain else 0

    def of(self, words: list[bytes]) -> np.ndarray:
        ids = super().of(words)
        return ids[ids != 0]


_IDS = PlainIds()


class Items:
    """A block of items, ready to be searched for."""

    def __init__(self, rows: list[tuple[int, str | None]], least: float = LEAST):
        self.least, self.items, self.widths = least, [], {}
        signatures: dict[int, list[tuple[int, int]]] = {}
        for item_id, text in rows:
            words = _IDS.of((text or "").encode().split())
            if len(words):
                width = min(WIDTH, len(words))
                own = np.unique(shingles(words, width))
                need = math.ceil(least * len(own) - 1e-9)
                order = own[np.argsort(mix(own ^ np.uint64(0xA5A5A5A5)))]
                signatures.setdefault(width, []).extend((int(h), len(self.items)) for h in order[: len(own) - need + 1])
                self.items.append((item_id, own, need))
        for width, pairs in signatures.items():
            pairs.sort()
            self.widths[width] = np.array([h for h, _ in pairs], np.uint64), np.array([i for _, i in pairs], np.int64)

    def search(self, words: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item id, its shingles, those found) for each item that a text of these word ids holds."""
        for width, (hashes, owners) in self.widths.items():
            if len(words) < width:
                continue
            own = shingles(words, width)
            low = np.searchsorted(hashes, own)
            hit = own[hashes[np.minimum(low, len(hashes) - 1)] == own]
            if not len(hit):
                continue
            near = {i for h in np.unique(hit) for i in owners[np.searchsorted(hashes, h) : np.searchsorted(hashes, h, "right")].tolist()}
            have = np.unique(own)
            for i in sorted(near):
                item_id, all_, need = self.items[i]
                shared = int((have[np.minimum(np.searchsorted(have, all_), len(have) - 1)] == all_).sum())
                if shared >= need:
                    yield item_id, len(all_), shared


def _search(items: Items):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontaminate", _IDS.clear)
        for rows, texts in slices(batches):
            out = [(d, *found) for d, t in zip(rows.column("doc_id").to_pylist(), texts, strict=True) for found in items.search(_IDS.of(t.split()))]
            columns = [*zip(*out, strict=True)] or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], names=["doc_id", "item_id", "n_item", "n_shared"])

    return run


def find_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """(doc_id, item_id, n_item, n_shared, containment) of every item found in a document."""
    search = lambda items: docs.select("doc_id", "text").mapInArrow(_search(items), "doc_id long, item_id long, n_item long, n_shared long")
    return reduce(DataFrame.unionByName, map(search, _blocks(benchmark, least))).withColumn("containment", F.col("n_shared") / F.col("n_item"))


def _blocks(benchmark: DataFrame, least: float) -> Iterator[Items]:
    """The items in blocks of about BLOCK / 2 bytes, by hash of id and text, so that one repeated id is no block of its own."""
    size = benchmark.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0)) + 16 * F.count("*")).first()[0]
    blocks = max(1, math.ceil(2 * size / BLOCK))
    for b in range(blocks):
        rows = benchmark.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b).select("item_id", "text").orderBy("item_id").collect()
        yield Items([(r[0], r[1]) for r in rows], least)


def drop_leaks(docs: DataFrame, benchmark: DataFrame, least: float = LEAST) -> DataFrame:
    """docs without the rows that hold an item, whatever their doc_id: rows are tested as they pass, and none is moved."""
    columns = docs.columns
    body = columns.index("text")
    for items in _blocks(benchmark, least):
        docs = docs.mapInArrow(_without(items, columns[body]), docs.schema)
    return docs


def _without(items: Items, column: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hold("decontaminate", _IDS.clear)
        for rows, texts in slices(batches, column):
            yield rows.filter(pa.array([next(items.search(_IDS.of(t.split())), None) is None for t in texts], pa.bool_()))

    return run
