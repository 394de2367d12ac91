"""Content-addressed store of token ids.

Documents become id streams, each ended by END. A rolling hash over the ids cuts a stream into chunks, so equal
passages give equal chunks wherever they stand. Three tables are written:

    kind=chunk   digest, n, data         unique chunks, once each; data: ids as little-endian uint16 (or uint32)
    kind=recipe  doc_id, row, seq, digest, n, tail   chunks of each document in order; tail: ids after the chunk
    manifest     doc_id, row, n, root, start, rank   documents in ascending doc_id order; root: Merkle root over
                 the chunk digests; start: ids of all documents before

Above the manifest stands a Merkle tree over blocks of document roots in order of rank. Chunks and recipes come
from one pass over the texts and one exchange, in which copies of a chunk leave each task once. `read_store`
takes every chunk from the files, checks its digest, and gives each document's length and crc32 from its chunks
without moving ids again: crc32 of a whole is the exclusive or of the chunks' crc32s, each shifted by the bytes
that follow. Null texts are empty (only END); rows with the same doc_id stay separate by `row`; an empty table
gives no documents. Chunks are in an order that follows from their digests, as they are found by content; the manifest is in ascending
order of doc_id (nulls first, equal ones by `row`), and with the recipes gives the ids in that order.
"""

from __future__ import annotations

import functools
import hashlib
import itertools
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, shared_path, slices, write_table
from .encoding import piece_ids
from .ordering import running_total

END = 0
WINDOW, LEAST, MOST, MASK = 16, 64, 2048, np.uint64(0x1FF)
#: Ids whose rolling hashes are found at once.
SPAN = 1 << 18
#: Documents under one node of the manifest's tree.
FAN = 4096
_ODD = 0x9E3779B97F4A7C15
_ROWS = "kind string, key long, digest binary, n int, data binary, doc_id long, row long, seq int, tail long, root binary"


def merkle(leaves: list[bytes]) -> bytes:
    """Root over leaves in order; an odd one at the end moves up alone."""
    level = [hashlib.blake2b(b"\0" + x, digest_size=16).digest() for x in leaves] or [b"\0" * 16]
    while len(level) > 1:
        level = [hashlib.blake2b(b"\1" + b"".join(level[i : i + 2]), digest_size=16).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0]


@functools.lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    up, down = np.ones(SPAN, np.uint64), np.ones(SPAN, np.uint64)
    up[1:], down[1:] = np.uint64(_ODD), np.uint64(pow(_ODD, -1, 1 << 64))
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def marks(ids: np.ndarray) -> np.ndarray:
    """Places in a stream whose WINDOW ids before have a rolling hash that ends a chunk."""
    up, down = _powers()
    found = []
    for a in range(0, max(0, len(ids) - WINDOW + 1), SPAN - WINDOW + 1):
        own = ids[a : a + SPAN]
        n = len(own)
        sums = np.cumsum(mix(own.astype(np.uint64) + np.uint64(1)) * up[:n], dtype=np.uint64)
        rolling = (sums[WINDOW - 1 :] - np.concatenate([np.zeros(1, np.uint64), sums[:-WINDOW]])) * down[WINDOW - 1 : n]
        found.append(np.flatnonzero((mix(rolling) & MASK) == 0) + (a + WINDOW))
    return np.concatenate([np.zeros(0, np.int64), *found])


def _ends(n: int, at: list[int]) -> list[int]:
    """Ends of the chunks of a stream of n ids, from the marks in it."""
    out: list[int] = []
    if n > LEAST:
        start = 0
        for end in at:
            while end - start > MOST:
                start += MOST
                out.append(start)
            if end - start >= LEAST:
                out.append(end)
                start = end
        while n - start > MOST:
            start += MOST
            out.append(start)
    return out if out and out[-1] == n else [*out, n]


def cuts(ids: np.ndarray) -> list[int]:
    """Ends of the chunks of one id stream. They depend on the WINDOW ids before each end and on LEAST and MOST alone."""
    return _ends(len(ids), marks(ids).tolist())


def _encode(path: str):
    kinds = pa.schema([("kind", pa.string()), ("key", pa.int64()), ("digest", pa.binary()), ("n", pa.int32()), ("data", pa.binary()), ("doc_id", pa.int64()), ("row", pa.int64()), ("seq", pa.int32()), ("tail", pa.int64()), ("root", pa.binary())])

    def rows_of(kind: str, size: int, **columns) -> pa.RecordBatch:
        own = {"kind": pa.array([kind] * size, pa.string()), **columns}
        return pa.RecordBatch.from_arrays([own[f.name].cast(f.type) if f.name in own else pa.nulls(size, f.type) for f in kinds], schema=kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = piece_ids(path)
        row = TaskContext.get().partitionId() << 36
        seen: set[bytes] = set()
        for rows, texts in slices(batches):
            ids = pieces.encode([t.decode("utf-8", "replace") for t in texts])
            width = pieces.dtype.itemsize
            end = np.full(1, END, pieces.dtype)
            stream = np.concatenate([x for own in ids for x in (own, end)])
            sizes = np.array([len(own) + 1 for own in ids], np.int64)
            begin = np.cumsum(sizes) - sizes
            at, raw = marks(stream), stream.tobytes()
            low, high = np.searchsorted(at, begin + WINDOW).tolist(), np.searchsorted(at, begin + sizes, "right").tolist()
            ends = [_ends(n, (at[a:b] - s).tolist()) for n, s, a, b in zip(sizes.tolist(), begin.tolist(), low, high, strict=True)]
            counts = np.array([len(e) for e in ends])
            owner = np.repeat(np.arange(len(ids)), counts)
            stop = np.fromiter(itertools.chain.from_iterable(ends), np.int64, int(counts.sum())) + begin[owner]
            start = np.concatenate([[0], stop[:-1]])  # chunks cover the stream without gaps
            data = [raw[a:b] for a, b in zip((start * width).tolist(), (stop * width).tolist(), strict=True)]
            digests = [hashlib.blake2b(x, digest_size=16).digest() for x in data]
            first = []
            for i, digest in enumerate(digests):
                if digest not in seen:
                    first.append(i)
                    if len(seen) < 1_000_000:
                        seen.add(digest)
            n = pa.array(stop - start)
            own, place = pa.array(digests, pa.binary()), row + np.arange(len(ids))
            key = np.frombuffer(b"".join(digests), np.int64)[::2]
            yield rows_of("chunk", len(first), key=pa.array(key[first]), digest=own.take(pa.array(first, pa.int64())), n=n.take(pa.array(first, pa.int64())), data=pa.array([data[i] for i in first], pa.binary()))
            doc_id = rows.column("doc_id").cast(pa.int64())
            seq, tail = np.arange(len(owner)) - (np.cumsum(counts) - counts)[owner], (begin + sizes)[owner] - stop
            yield rows_of("recipe", len(owner), key=pa.array(place[owner]), digest=own, n=n, doc_id=doc_id.take(pa.array(owner)), row=pa.array(place[owner]), seq=pa.array(seq), tail=pa.array(tail))
            bounds = np.concatenate([[0], np.cumsum(counts)]).tolist()
            roots = [merkle(digests[a:b]) for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            yield rows_of("document", len(ids), key=pa.array(place), n=pa.array(sizes), doc_id=doc_id, row=pa.array(place), root=pa.array(roots, pa.binary()))
            row += len(ids)

    return run


def _once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Drops chunks whose digest equals the one before; equal digests stand together."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        digest = batch.column(2)
        before = pa.concat_arrays([pa.array([last], digest.type), digest.slice(0, len(digest) - 1)])
        again = pc.and_(pc.equal(batch.column(0), "chunk"), pc.fill_null(pc.equal(digest, before), False))
        last = digest[len(digest) - 1].as_py() if batch.column(0)[-1].as_py() == "chunk" else None
        yield batch.filter(pc.invert(again))


def write_store(docs: DataFrame, tokenizer_path: str, path: str | None = None) -> str:
    """Encodes docs (doc_id, text) and writes the store's tables to `path`."""
    path = path or shared_path(docs.sparkSession, "store")
    rows = docs.select("doc_id", "text").mapInArrow(_encode(tokenizer_path), _ROWS)
    # one long to sort by: strings of one kind, or digests alone, would be compared row by row
    place = F.when(F.col("kind") == "chunk", 0).when(F.col("kind") == "document", 1).otherwise(2).cast("long")
    order = F.shiftleft(place, 61).bitwiseOR(F.shiftrightunsigned("key", 3))
    dealt = rows.repartition("key").withColumn("order", order).sortWithinPartitions("order", "digest").drop("order")
    write_table(dealt.mapInArrow(_once, _ROWS).drop("key"), f"{path}/rows", "kind")
    parts = docs.sparkSession.read.schema(f"{_ROWS.replace('key long, ', '')}").parquet(f"{path}/rows")
    manifest = running_total(parts.where("kind = 'document'").select("doc_id", "row", F.col("n").cast("long").alias("n"), "root"), ["doc_id", "row"], "n", "start", "rank")
    write_table(manifest, f"{path}/manifest")
    return path


def _crcs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        digests, sizes, crcs = batch.column(0).to_pylist(), batch.column(1).to_pylist(), []
        for digest, n, data in zip(digests, sizes, batch.column(2).to_pylist(), strict=True):
            if hashlib.blake2b(data, digest_size=16).digest() != digest:
                raise ValueError(f"chunk {digest.hex()} is damaged")
            crcs.append(zlib.crc32(np.frombuffer(data, f"<u{len(data) // n}").astype("<u4").tobytes()))
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(crcs, pa.int64())], names=["digest", "stored", "crc"])


@functools.lru_cache(maxsize=1)
def _shifts() -> np.ndarray:
    """For each power of two of zero bytes after a message: what its crc32's four bytes turn into."""
    poly = 0xEDB88320
    one = [poly] + [1 << i for i in range(31)]  # a zero bit after
    apply = lambda m, v: functools.reduce(lambda a, i: a ^ m[i] if v >> i & 1 else a, range(32), 0)
    bits = one
    for _ in range(3):
        bits = [apply(bits, x) for x in bits]
    tables = []
    for _ in range(40):
        tables.append([[apply(bits, v << 8 * b) for v in range(256)] for b in range(4)])
        bits = [apply(bits, x) for x in bits]
    return np.array(tables, np.uint32)


def shift_crc(crc: np.ndarray, zeros: np.ndarray) -> np.ndarray:
    """What crc adds to the crc32 of a message that goes on for `zeros` bytes."""
    crc, zeros = crc.astype(np.uint32), zeros.copy()
    for table in _shifts():
        if not zeros.any():
            break
        hit = (zeros & 1).astype(bool)
        c = crc[hit]
        crc[hit] = table[0][c & 255] ^ table[1][c >> 8 & 255] ^ table[2][c >> 16 & 255] ^ table[3][c >> 24]
        zeros >>= 1
    return crc


def _shifted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        crc, tail = batch.column(5).to_numpy(), batch.column(4).to_numpy()
        yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(shift_crc(crc, 4 * tail).astype(np.int64))], names=batch.schema.names)


def _roots(digests: pa.Array) -> list[bytes]:
    return [merkle([x["digest"] for x in one]) for one in digests.to_pylist()]


def _verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for doc_id, root, own in zip(batch.column(0).to_pylist(), batch.column(5).to_pylist(), _roots(batch.column(6)), strict=True):
            if root != own:
                raise ValueError(f"document {doc_id} doesn't match its manifest")
        yield batch.select([0, 1, 2, 3, 4])


def read_store(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32, rank) per document, from the written chunks; raises if any is damaged or missing."""
    parts = spark.read.schema(_ROWS.replace("key long, ", "")).parquet(f"{path}/rows")
    chunks = parts.where("kind = 'chunk'").select("digest", "n", "data").mapInArrow(_crcs, "digest binary, stored int, crc long")
    recipes = parts.where("kind = 'recipe'").select("digest", "row", "seq", "tail")
    crcs = recipes.join(chunks, "digest").select("row", "seq", "digest", F.col("stored").cast("long").alias("n"), "tail", "crc")
    moved = crcs.mapInArrow(_shifted, "row long, seq int, digest binary, n long, tail long, crc long")
    built = moved.groupBy("row").agg(F.sum("n").alias("n_tokens"), F.bit_xor("crc").alias("ids_crc32"), F.sort_array(F.collect_list(F.struct("seq", "digest"))).alias("digests"))
    manifest = spark.read.parquet(f"{path}/manifest")
    rows = manifest.join(built, "row", "left").select("doc_id", "start", "n_tokens", "ids_crc32", "rank", "root", "digests")
    return rows.mapInArrow(_verify, "doc_id long, start long, n_tokens long, ids_crc32 long, rank long")


def read_ids(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, ids) of every document, put together from its chunks."""
    parts = spark.read.schema(_ROWS.replace("key long, ", "")).parquet(f"{path}/rows")

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [np.frombuffer(b"".join(c["data"] for c in one), f"<u{len(one[0]['data']) // one[0]['n']}").astype(np.int64).tolist() for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "ids"])

    joined = parts.where("kind = 'recipe'").select("digest", "doc_id", "row", "seq").join(parts.where("kind = 'chunk'").select("digest", "n", "data"), "digest")
    whole = joined.groupBy("doc_id", "row").agg(F.sort_array(F.collect_list(F.struct("seq", "n", "data"))).alias("chunks"))
    return whole.select("doc_id", "chunks").mapInArrow(unpack, "doc_id long, ids array<long>")


def store_root(spark: SparkSession, path: str) -> bytes:
    """Root of the tree over all documents in order: nodes of FAN children, level by level."""

    def node(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            roots = [merkle([x["root"] for x in one]) for one in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(roots, pa.binary())], names=["rank", "root"])

    level = spark.read.parquet(f"{path}/manifest").select("rank", "root")
    n = level.count()
    while n > 1:
        groups = level.groupBy(F.floor(F.col("rank") / FAN).alias("rank")).agg(F.sort_array(F.collect_list(F.struct(F.col("rank").alias("at"), "root"))).alias("roots"))
        level, n = groups.mapInArrow(node, "rank long, root binary"), -(-n // FAN)
    return next((bytes(r["root"]) for r in level.collect()), merkle([]))
