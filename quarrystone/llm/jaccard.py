"""N-gram Jaccard self-join with adaptive multi-match prefixes, as components of linked documents.

A document's set is its distinct word shingles. Two documents link when 100 * intersection >= percent * union.
Equal sets make one class, and only a class's smallest document goes on.

Shingles are ordered from rare to frequent (the heaviest are counted over all documents; the order changes costs
only). With at least `need` shingles to share, a document's prefix for l matches is its first n - need + l shingles:
linked documents share l of them at least. Each document picks l by its estimated cost, the rows it emits against
the candidates it would verify, so one in crowded shingles lengthens its prefix and asks for more shared shingles.
A pair needs the smaller of both numbers, counted over the shorter prefixes of both.

A group of near copies must not become all its pairs. So it is joined in rounds first: in each shingle's rows by length, a
document is paired with the first of its band of lengths and with the few rows before it, as far as they are in
different components; these pairs are verified, components merged, shingles of one component dropped, and the next
round orders rows of like length anew. A round makes a fixed number of pairs a row. Then pairs are formed
between different components alone. Documents of one component that stand alike under a shingle (same length, same
place of the shingle in the prefix) form one bundle (of BUNDLE documents at most); bundles are joined, and only bundles that can still link are
unfolded into pairs, counted where they arise. They can if the lengths allow it, the places do (shingles before the first one that two documents share
cannot be shared, which bounds their intersection) and their sketches do. A sketch has a bit per hash value, set if an
odd number of the document's shingles have it: what two sets share cancels out, so where sketches differ, at least as
many shingles are in one set only. A bundle holds the bits set in all of its sketches and those set in any. Every pair
that could link two components is verified by exact intersection, so none is lost.

Null and wordless texts have an empty set and link with nothing. A text of fewer words than a shingle is one
shingle. The class graph is of sets, each known by one row that has it; doc_ids come in when components are named. There,
rows with one doc_id count as one document, linked by any of its texts; null ids have no component.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, WordIds, hold, mix, numbered, shingles, slices, staged
from .graph import components

#: Shingles whose counts order prefixes: the HEAVY most frequent. Others count as rare.
HEAVY = 200_000
#: Shingles a task gathers before it counts them; counts under LEAST in such a block are left out.
BLOCK, LEAST = 3_000_000, 3
#: Most matches asked for; costs of a verification and of a joined row against an emitted row; joined rows per rare shingle.
MATCHES, VERIFY, SCAN, CHANCE = 4, 50.0, 10.0, 0.1
_BITS = 23
#: Rounds of pairs with neighbours, and neighbours before a row.
ROUNDS, BACK = 3, 3
#: Documents in a bundle at most, and pairs that a task holds at once.
BUNDLE, PAIRS = 64, 200_000
#: Longs of a sketch. With more bits, sketches of long documents tell more; results are the same.
SKETCH = 4
_MARKS = [f"mark{i}" for i in range(SKETCH)]
_IDS = WordIds()


def shingle_set(text: bytes, width: int) -> np.ndarray:
    """Distinct shingles of the words of a text (A-Z lower-cased), ascending."""
    return np.unique(shingles(_IDS.of(text.lower().split()), width))


def digest_of(own: np.ndarray) -> bytes | None:
    """Digest of a set; none for the empty one."""
    return hashlib.blake2b(own.tobytes(), digest_size=16).digest() if len(own) else None


def _heavy(width: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(sets: list[np.ndarray]) -> pa.RecordBatch:
            value, n = np.unique(np.concatenate(sets), return_counts=True)
            big = n >= LEAST
            return pa.RecordBatch.from_arrays([pa.array(value[big].view(np.int64)), pa.array(n[big])], names=["h", "n"])

        hold("jaccard", _IDS.clear)
        held: list[np.ndarray] = []
        size = 0
        for _, texts in slices(batches):
            for t in texts:
                held.append(shingle_set(t, width))
                size += len(held[-1])
            if size > BLOCK:
                yield counted(held)
                held, size = [], 0
        if held:
            yield counted(held)

    return run


def need_of(n: int, percent: int) -> int:
    """Shingles that a set of n must share with any set it links to."""
    return -(-percent * n // 100)


def sketch(own: np.ndarray) -> np.ndarray:
    """SKETCH longs: a bit is set if an odd number of the shingles hash to it."""
    at = (mix(own ^ np.uint64(0x5C5C5C5C)) % np.uint64(64 * SKETCH)).astype(np.int64)
    return np.packbits((np.bincount(at, minlength=64 * SKETCH) & 1).astype(np.uint8)).view(np.int64)


def prefix(own: np.ndarray, weight: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """The prefix in order and the length of the one-match prefix; weight: frequencies, 1 where unknown."""
    n = len(own)
    need = need_of(n, percent)
    base = n - need + 1
    order = np.lexsort((own, weight))[: min(n, base + MATCHES - 1)]
    cost = np.cumsum(weight[order] - 1 + CHANCE)
    most = max(1, min(MATCHES, need, len(order) - base + 1))
    matches = 1 + int(np.argmin([(VERIFY / m**2 + SCAN) * cost[base + m - 2] + base + m for m in range(1, most + 1)]))
    return own[order[: base + matches - 1]], base


def _features(width: int, percent: int, heavy):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        values, counts = heavy.value
        hold("jaccard", _IDS.clear)
        row = TaskContext.get().partitionId() << 36
        for rows, texts in slices(batches):
            n, digest, tokens, bases, marks = [], [], [], [], []
            for t in texts:
                own = shingle_set(t, width)
                n.append(len(own))
                digest.append(digest_of(own))
                if len(own) and len(values):
                    at = np.minimum(np.searchsorted(values, own), len(values) - 1)
                    first, base = prefix(own, np.where(values[at] == own, counts[at], 1), percent)
                else:
                    first, base = prefix(own, np.ones(len(own)), percent) if len(own) else (own, 0)
                tokens.append(first.view(np.int64))
                bases.append(base)
                marks.append(sketch(own))
            offsets = np.concatenate([[0], np.cumsum([len(x) for x in tokens])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(tokens)))
            numbers = pa.array(range(row, row + len(texts)), pa.int64())
            row += len(texts)
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), numbers, pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(bases, pa.int32()), lists, *map(pa.array, np.stack(marks, 1))], names=["doc_id", "row", "n", "digest", "base", "prefix", *_MARKS])

    return run


def _repeated(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by token, without tokens that have one row; a partition's first and last token stay, as they may go on elsewhere."""
    before = None  # the last row so far, while it isn't known whether its token goes on
    first = None
    for batch in batches:
        if not batch.num_rows:
            continue
        if before is not None:
            batch = pa.Table.from_batches([before, batch]).combine_chunks().to_batches()[0]
        tokens = batch.column(0).to_numpy()
        first = tokens[0] if first is None else first
        same = tokens[1:] == tokens[:-1]
        keep = np.concatenate([[False], same]) | np.concatenate([same, [False]]) | (tokens == first)
        if before is not None:
            keep[0] |= known
        known, before = keep[-1], batch.slice(batch.num_rows - 1)
        keep[-1] = False
        yield batch.filter(pa.array(keep))
    if before is not None:
        yield before


def _far(n_a: np.ndarray, n_b: np.ndarray, marks_a: np.ndarray, marks_b: np.ndarray, percent: int) -> np.ndarray:
    """Whether lengths and sketches show that two sets don't link."""
    small, large = np.minimum(n_a, n_b), np.maximum(n_a, n_b)
    apart = np.bitwise_count((marks_a ^ marks_b).view(np.uint64)).sum(1, dtype=np.int64)
    return (100 * small < percent * large) | ((100 + percent) * apart > (100 - percent) * (n_a + n_b))


def _neighbours(percent: int):
    """Pairs (a, b) among rows sorted by (token, n, order), of each row with the first of its token and band of lengths and with the
    BACK rows before it: under how many tokens they met here, and the shared tokens they need."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the leader, then the last BACK rows
        for batch in batches:
            if not batch.num_rows:
                continue
            token, doc, n, matches, comp = (batch.column(i).to_numpy() for i in range(5))
            marks = np.stack([batch.column(i).to_numpy() for i in range(5, 5 + SKETCH)], 1)
            rows = [token, doc, n, matches, comp, marks]
            fresh = 0 if held is None else len(held[0])
            token, doc, n, matches, comp, marks = rows = [np.concatenate([h, r]) for h, r in zip(held, rows, strict=True)] if held else rows
            band = np.floor(np.log(n) / np.log(100 / percent)).astype(np.int64)
            opens = np.concatenate([[True], (token[1:] != token[:-1]) | (band[1:] != band[:-1])])
            opens[1:fresh] = False  # rows seen before, behind the leader
            if fresh and len(token) > fresh:
                opens[fresh] = token[fresh] != token[fresh - 1] or band[fresh] != band[fresh - 1]
            leader = np.maximum.accumulate(np.where(opens, np.arange(len(token)), 0))
            at = np.arange(fresh, len(token))
            pairs = [(leader[at], at)] + [(at[at >= k + (fresh > 0)] - k, at[at >= k + (fresh > 0)]) for k in range(1, BACK + 1)]
            left, right = (np.concatenate(x) for x in zip(*pairs, strict=True))
            good = (token[left] == token[right]) & (comp[left] != comp[right])
            left, right = left[good], right[good]
            good = ~_far(n[left], n[right], marks[left], marks[right], percent)
            left, right = left[good], right[good]
            met = np.unique(np.stack([np.minimum(doc[left], doc[right]), np.maximum(doc[left], doc[right]), np.minimum(matches[left], matches[right]), token[left]], 1), axis=0)
            both, shared = np.unique(met[:, :3], axis=0, return_counts=True)
            yield pa.RecordBatch.from_arrays([*map(pa.array, both.T), pa.array(shared)], names=["a", "b", "least", "shared"])
            last = np.concatenate([[leader[-1]], np.arange(max(0, len(token) - BACK), len(token))])
            held = [x[last] for x in rows]

    return run


def _sets(width: int, wanted):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = wanted.value
        hold("jaccard", _IDS.clear)
        for batch in batches:
            ids = batch.column(0).fill_null(0).to_numpy().astype(np.int64)
            near = batch.filter(pa.array(bits[(mix(ids.view(np.uint64)) >> np.uint64(64 - _BITS)).astype(np.int64)]))
            for _, texts in slices([near]):
                sets = [shingle_set(t, width) for t in texts]
                yield pa.RecordBatch.from_arrays([pa.array([f(x) for x in sets], pa.binary()) for f in (digest_of, np.ndarray.tobytes)], names=["digest", "own"])

    return run


def _linked(percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            good = np.zeros(len(a), bool)
            for i in range(len(a)):
                x, y = (np.frombuffer(batch.column(k)[i].as_buffer(), np.uint64) for k in (2, 3))
                small, large = (x, y) if len(x) < len(y) else (y, x)
                shared = int(np.count_nonzero(large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small)) if len(small) else 0
                good[i] = shared and 100 * shared >= percent * (len(x) + len(y) - shared)
            keep = batch.select([0, 1]).filter(pa.array(good))
            yield pa.RecordBatch.from_arrays(keep.columns, names=["a", "b"])

    return run


def _bits(ids: DataFrame) -> np.ndarray:
    """A bit per hash of the doc_ids in ids: 2**_BITS at most, whatever the number of documents."""

    def spots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = np.unique(mix(batch.column(0).to_numpy().view(np.uint64)) >> np.uint64(64 - _BITS)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(at)], names=["at"])

    out = np.zeros(1 << _BITS, bool)
    out[np.array(ids.mapInArrow(spots, "at long").distinct().toArrow().column(0).to_numpy(), np.int64)] = True
    return out


def verify(pairs: DataFrame, docs: DataFrame, nodes: DataFrame, width: int, percent: int, scratch: Scratch) -> DataFrame:
    """The pairs (a, b) of nodes that link, by exact intersection of their sets. nodes: doc, digest, doc_id; a set is read from the rows of its node's doc_id."""
    spark, own = pairs.sparkSession, Scratch(pairs.sparkSession)
    ids = pairs.select(F.explode(F.array("a", "b")).alias("doc")).distinct()
    named = own.staged(nodes.join(ids, "doc", "left_semi"), "nodes")
    wanted = spark.sparkContext.broadcast(_bits(named.select("doc_id")))
    sets = docs.select("doc_id", "text").mapInArrow(_sets(width, wanted), "digest binary, own binary")
    sets = own.staged(sets.join(named.select("digest", "doc").hint("shuffle_merge"), "digest").dropDuplicates(["digest"]).select("doc", "own"), "sets")
    left = pairs.join(sets.select(F.col("doc").alias("a"), F.col("own").alias("x")).hint("shuffle_merge"), "a")
    right = left.join(sets.select(F.col("doc").alias("b"), F.col("own").alias("y")).hint("shuffle_merge"), "b")
    links = scratch.staged(right.select("a", "b", "x", "y").mapInArrow(_linked(percent), "a long, b long"), "links")
    own.clear()
    wanted.destroy()
    return links


def between(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows (token, doc, ...) with their components, without tokens whose rows are all in one."""
    placed = rows.drop("comp").join(known.select(F.col("node").alias("doc"), "component"), "doc", "left")
    placed = placed.withColumn("comp", F.coalesce("component", "doc")).drop("component")
    mixed = placed.groupBy("token").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("token")
    return placed.join(mixed, "token", "left_semi")


def _unfold(percent: int):
    """Pairs (a, b) of members of two bundles whose sketches allow a link: under how many tokens, and the shared tokens they need."""

    def told(found: list[np.ndarray]) -> pa.RecordBatch:
        met = np.unique(np.concatenate(found), axis=0) if found else np.zeros((0, 4), np.int64)
        both, shared = np.unique(met[:, :3], axis=0, return_counts=True)
        return pa.RecordBatch.from_arrays([*map(pa.array, both.T), pa.array(shared)], names=["a", "b", "least", "shared"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            token, least, n_a, n_b = (batch.column(i).to_numpy().astype(np.int64) for i in range(4))
            lists = [batch.column(4), batch.column(5)]
            sizes = [x.value_lengths().to_numpy().astype(np.int64) for x in lists]
            begin = [np.cumsum(k) - k for k in sizes]
            parts = [[c.to_numpy() for c in x.flatten().flatten()] for x in lists]
            docs, marks = [p[0] for p in parts], [np.stack(p[1:], 1) for p in parts]
            every = sizes[0] * sizes[1]
            ends, row, found, held = np.cumsum(every), 0, [], 0
            while row < len(token):
                till = max(row + 1, int(np.searchsorted(ends, (ends[row - 1] if row else 0) + PAIRS, "right")))
                own = np.repeat(np.arange(row, till), every[row:till])
                place = np.arange(len(own)) - np.repeat(ends[row:till] - every[row:till] - (ends[row] - every[row]), every[row:till])
                left, right = begin[0][own] + place // sizes[1][own], begin[1][own] + place % sizes[1][own]
                good = ~_far(n_a[own], n_b[own], marks[0][left], marks[1][right], percent)
                a, b = docs[0][left[good]], docs[1][right[good]]
                found.append(np.stack([np.minimum(a, b), np.maximum(a, b), least[own[good]], token[own[good]]], 1))
                held += len(a)
                if held > PAIRS:
                    yield told(found)
                    found, held = [], 0
                row = till
            yield told(found)

    return run


def cross_pairs(rows: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of documents in different components that share enough of their prefixes. rows: token, doc, n, at, matches, comp, marks."""
    key = ["token", "comp", "n", "at", "matches"]
    part = F.floor((F.row_number().over(Window.partitionBy(*key).orderBy("doc")) - 1) / BUNDLE)  # a bundle of many documents is several
    bounds = [f(m).alias(f"{kind}_{m}") for m in _MARKS for kind, f in (("all", F.bit_and), ("any", F.bit_or))]
    bundles = rows.withColumn("part", part).groupBy(*key, "part").agg(*bounds, F.collect_list(F.struct("doc", *_MARKS)).alias("members")).drop("part")
    side = lambda k: bundles.select("token", *[F.col(c).alias(f"{c}_{k}") for c in bundles.columns if c != "token"])
    least = F.least("matches_a", "matches_b")
    level = lambda k: F.greatest(F.lit(1), F.col(f"at_{k}") + F.expr(f"(({percent} * n_{k} + 99) div 100)") - F.col(f"n_{k}") + 1)
    shared = F.least(F.col("n_a") - F.col("at_a"), F.col("n_b") - F.col("at_b")) + least - 1
    once = (F.col("n_a") < F.col("n_b")) | ((F.col("n_a") == F.col("n_b")) & (F.col("comp_a") < F.col("comp_b")))
    can = (100 * F.col("n_a") >= percent * F.col("n_b")) & (100 * shared >= percent * (F.col("n_a") + F.col("n_b") - shared)) & (F.greatest(level("a"), level("b")) <= least)
    only = lambda m, k, other: F.col(f"all_{m}_{k}").bitwiseAND(F.bitwise_not(F.col(f"any_{m}_{other}")))
    apart = reduce(Column.__add__, [F.bit_count(only(m, "a", "b").bitwiseOR(only(m, "b", "a"))) for m in _MARKS])
    can = can & ((100 + percent) * apart <= (100 - percent) * (F.col("n_a") + F.col("n_b")))
    met = side("a").join(side("b"), "token").where((F.col("comp_a") != F.col("comp_b")) & once & can)
    near = met.repartitionByRange("comp_a", "comp_b", "n_a", "n_b", "token").sortWithinPartitions("comp_a", "comp_b", "n_a", "n_b")  # so that a pair's tokens come together
    counted = near.select("token", least, "n_a", "n_b", "members_a", "members_b").mapInArrow(_unfold(percent), "a long, b long, least long, shared long")
    return counted.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b")


def similar(docs: DataFrame, width: int = 4, percent: int = 85) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every row of docs (doc_id, text)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession)
    texts = docs.select("doc_id", "text")
    heavy = texts.mapInArrow(_heavy(width), "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "h").limit(HEAVY).toArrow()
    values, counts = heavy.column(0).to_numpy().view(np.uint64), heavy.column(1).to_numpy()
    order = np.argsort(values)
    shared = spark.sparkContext.broadcast((values[order], counts[order]))  # at most HEAVY rows
    features = scratch.staged(texts.mapInArrow(_features(width, percent, shared), "doc_id long, row long, n long, digest binary, base int, prefix array<long>, " + ", ".join(f"{m} long" for m in _MARKS)), "features")
    filled = features.where("digest IS NOT NULL AND doc_id IS NOT NULL")
    reps = filled.groupBy("digest").agg(F.min(F.struct("doc_id", "row", "n", "base", "prefix")).alias("r"))
    nodes = filled.select(F.col("row").alias("doc"), "digest", "doc_id")
    tokens = reps.select(F.posexplode("r.prefix").alias("at", "token"), F.col("r.row").alias("doc"), F.col("r.n").alias("n"), F.col("r.base").alias("base"), F.size("r.prefix").alias("size"))
    rows = tokens.select("token", "doc", "n", "at", (F.col("size") - F.col("base") + 1).cast("int").alias("matches"))
    names = "token long, doc long, n long, at int, matches int"
    runs = rows.repartitionByRange("token", "n", "doc").sortWithinPartitions("token").mapInArrow(_repeated, names)
    sketches = filled.select(F.col("row").alias("doc"), *_MARKS)
    live = scratch.staged(runs.join(sketches, "doc"), "live")
    links: list[DataFrame] = []
    known = spark.createDataFrame([], "node long, component long")
    for k in range(ROUNDS):
        live = scratch.staged(between(live, known), "live")
        order = F.xxhash64("doc", F.lit(k))
        ranged = live.withColumn("order", order).repartitionByRange("token", "n", "order").sortWithinPartitions("token", "n", "order")
        near = ranged.select("token", "doc", "n", F.col("matches").cast("long"), "comp", *_MARKS).mapInArrow(_neighbours(percent), "a long, b long, least long, shared long")
        near = scratch.staged(near.groupBy("a", "b").agg(F.sum("shared").alias("shared"), F.min("least").alias("least")).where("shared >= least").select("a", "b"), "near")
        links.append(verify(near, texts, nodes, width, percent, scratch))
        known = components(reduce(DataFrame.union, links), scratch)
        if 10 * links[-1].count() < near.count():
            break
    live = scratch.staged(between(live, known), "live")
    links.append(verify(scratch.staged(cross_pairs(live, percent), "pairs"), texts, nodes, width, percent, scratch))
    every = known.select(F.col("node").alias("a"), F.col("component").alias("b")).union(links[-1])
    for k in ("a", "b"):
        every = every.join(nodes.select(F.col("doc").alias(k), F.col("doc_id").alias(f"{k}_id")), k)
    owners = filled.groupBy("digest").agg(F.min("doc_id").alias("rep"))
    again = filled.groupBy("doc_id").count().where("count > 1").select("doc_id")
    own = filled.select("doc_id", "digest").join(again, "doc_id", "left_semi").join(owners, "digest")
    final = components(every.select(F.col("a_id").alias("a"), F.col("b_id").alias("b")).union(own.select("doc_id", "rep")), scratch)
    named = owners.join(final.withColumnRenamed("node", "rep"), "rep", "left").select("digest", F.coalesce("component", "rep").alias("component_id"))
    members = features.select("doc_id", "n", "digest").join(named, "digest", "left")
    out = staged(members.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id")), "similar")
    scratch.clear()
    return out


def drop_similar(docs: DataFrame, width: int = 5, percent: int = 80) -> DataFrame:
    """docs with one row of each component of linked rows: that of the smallest doc_id, null ids last. Rows that share a
    doc_id or have none count by their own texts."""
    columns = docs.columns
    rows = numbered(docs.toDF(*[f"c{i}" for i in range(len(columns))]))  # no name can clash
    doc_id, text = (F.col(f"c{columns.index(c)}") for c in ("doc_id", "text"))
    near = similar(rows.select(F.col("_row").alias("doc_id"), text.alias("text")), width, percent).select(F.col("doc_id").alias("_row"), "component_id")
    named = near.join(rows.select("_row", doc_id.alias("doc_id"), F.xxhash64(text).alias("_hash")), "_row")
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "_hash", "_row"))
    kept = named.groupBy("component_id").agg(first.alias("_first")).select("_first._row")
    return rows.join(kept, "_row", "left_semi").drop("_row").toDF(*columns)
