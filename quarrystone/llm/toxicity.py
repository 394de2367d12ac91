"""Toxicity: a support vector machine over a gap-weighted subsequence kernel.

The kernel compares two words by the three-letter subsequences they share: an occurrence that spans s letters
weighs DECAY ** s, spans over SPAN letters weigh nothing, and the kernel is normalised by both lengths. So a gap or
an inserted character only lowers a likeness. A Nystroem map over landmark words turns the kernel into a finite
space, in which a linear machine with squared hinge loss is trained. As the kernel is an inner product of
subsequence weights, landmarks and machine fold into one weight per subsequence, and scoring a word costs its
own subsequences only.

Labels stand on documents, not on sentences. A labelled sentence's evidence is in its words: all words whose documents are
toxic far more often than chance allows (a bound that grows with the number of words tried) are positive examples, words
of documents without that label are negative ones. The first CHUNK of those are drawn by hash; then those inside the margin
join, CHUNK at a time, for ROUNDS rounds or until none is left. (Machines trained on whole sentences were measured and are
worse, see the README.) A document scores by its highest words and the share of words above the margin, through a logistic
curve whose slopes are never negative, so more evidence never lowers a score. The curve is fitted on evidence from machines that did
not see a document: each half of the sample is judged by a machine trained on the other one.

Letters are taken in lower case and without accents, other scripts by code point; other characters inside a word are
skipped; runs of single letters are read as one word; a word over LONG letters is read in overlapping parts, BLOCK letters at a
time, so that memory is bounded for words of any length.

Training takes at most SAMPLE labelled documents (by hash of doc_id), copies and near copies once, as a text that is copied a
hundred times makes each of its words look telling. Null, empty and wordless texts get the score of no
evidence. Repeated rows score alike; without labels of both kinds every score is 0. Columns of any name pass `drop_toxic`.
"""

from __future__ import annotations

import math
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, WordIds, fold, hold, mix, shingles, slices

DECAY, SPAN, LONG = 0.7, 6, 24
SAMPLE, CHUNK, LANDMARKS, ROUNDS = 8000, 3000, 256, 3
#: Letters that are compared at once.
BLOCK = 1 << 13
HELD_OUT, THRESHOLD = 2, 0.3
FEATURES, TOP = 3, 2.0
#: Words whose scores a worker remembers.
MEMO = 400_000

_GAPS = [(d, e) for d in range(1, SPAN) for e in range(1, SPAN) if d + e < SPAN]
_BEGIN, _STOP = 26, 27
#: Codes of letters. Those of alphabets have one each; ideographs share them.
_CODES = 1 << 13
_DIM = _CODES**3
_OTHER = bytes(c for c in range(128) if not chr(c).isalpha())


def letters(word: bytes) -> str:
    """Lower case, without accents and what is no letter."""
    if word.isascii():
        return word.lower().translate(None, _OTHER).decode()
    text = unicodedata.normalize("NFKD", word.decode("utf-8", "replace").lower())
    return text if text.isalpha() else "".join(filter(str.isalpha, text))


def parts_of(word: str) -> list[str]:
    """A word as it is compared: whole between marks, or in overlapping parts."""
    return [f"^{word}$"] if len(word) <= LONG else [word[k : k + LONG] for k in range(0, len(word) - LONG // 2, LONG // 2)]


def _codes(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Letters of each part as numbers, in rows; which word each row belongs to."""
    parts, owner = [], []
    for i, w in enumerate(words):
        own = parts_of(w)
        parts += own
        owner += [i] * len(own)
    return _numbers(parts), np.array(owner, np.int64)


def _numbers(parts: list[str]) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts), default=1)), -1, np.int64)
    flat = np.frombuffer("".join(parts).encode("utf-32-le"), np.uint32).astype(np.int64)
    code = np.where((flat >= 97) & (flat < 123), flat - 97, 28 + flat % (_CODES - 28))
    code = np.where(flat == ord("^"), _BEGIN, np.where(flat == ord("$"), _STOP, code))
    lengths = np.array([len(p) for p in parts], np.int64)
    rows = np.repeat(np.arange(len(parts)), lengths)
    out[rows, np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)] = code
    return out


def subsequences(words: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Normalised weights in compressed rows: (row, subsequence, weight), and the word of each row."""
    codes, owner = _codes(words)
    return *_weights(codes), owner


def _weights(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    keys, weights = [], []
    for d, e in _GAPS:
        n = codes.shape[1] - d - e
        if n > 0:
            a, b, c = codes[:, :n], codes[:, d : d + n], codes[:, d + e : d + e + n]
            row, col = np.nonzero(c >= 0)
            keys.append(row.astype(np.int64) * _DIM + (a[row, col] * _CODES + b[row, col]) * _CODES + c[row, col])
            weights.append(np.full(len(row), DECAY ** (d + e + 1)))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
    key, weight = np.concatenate(keys), np.concatenate(weights)
    order = np.argsort(key)
    key, weight = key[order], weight[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    key, weight = key[first], np.add.reduceat(weight, first) if len(first) else weight[:0]
    row = key // _DIM
    norm = np.sqrt(np.bincount(row, weight**2, len(codes)))
    return row, key % _DIM, weight / norm[row]


def _keys(words: list[str]) -> np.ndarray:
    return np.unique(subsequences(words)[1])


def _places(sub: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which subsequences are among keys, and where there."""
    if not len(keys):
        return np.zeros(len(sub), bool), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(keys, sub), len(keys) - 1)
    held = keys[at] == sub
    return held, at[held]


def _dense(words: list[str], keys: np.ndarray) -> np.ndarray:
    """Weights of the subsequences in keys."""
    row, sub, weight, owner = subsequences(words)
    held, at = _places(sub, keys)
    out = np.zeros((len(owner), len(keys)), np.float32)
    out[row[held], at] = weight[held]
    return out


def kernel(left: list[str], right: list[str]) -> np.ndarray:
    """The kernel between words of at most LONG letters."""
    keys = _keys(right)
    return _dense(left, keys) @ _dense(right, keys).T


@dataclass
class Machine:
    keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int64))
    weights: np.ndarray = field(default_factory=lambda: np.zeros(0))
    bias: float = -1.0
    curve: tuple[float, ...] = (0.0, 0.0, 0.0, -40.0)

    def words(self, words: list[str]) -> np.ndarray:
        """Decision values of words; words that have no subsequence get the bias."""
        out = np.full(len(words), -np.inf)
        parts: list[str] = []
        owner: list[int] = []
        held = 0

        def done() -> None:
            row, sub, weight = _weights(_numbers(parts))
            known, at = _places(sub, self.keys)
            np.maximum.at(out, owner, np.bincount(row[known], weight[known] * self.weights[at], len(parts)) + self.bias)

        for i, word in enumerate(words):
            if len(word) <= LONG:
                parts.append(f"^{word}$")
                owner.append(i)
                held += len(word)
            else:
                for k in range(0, len(word) - LONG // 2, LONG // 2):
                    parts.append(word[k : k + LONG])
                    owner.append(i)
                    if len(parts) * LONG >= BLOCK:
                        done()
                        parts, owner, held = [], [], 0
            if held >= BLOCK:
                done()
                parts, owner, held = [], [], 0
        if parts:
            done()
        return out

    def score(self, evidence: np.ndarray) -> np.ndarray:
        at = evidence @ np.array(self.curve[:-1]) + self.curve[-1]
        return 1 / (1 + np.exp(-np.clip(at, -40, 40)))


def _svm(x: np.ndarray, y: np.ndarray, cost: np.ndarray, ridge: float = 0.05) -> np.ndarray:
    """Squared hinge loss by Newton steps; the last weight is the bias."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    keep = np.eye(x.shape[1]) * ridge
    keep[-1, -1] = 1e-6
    for _ in range(30):
        active = y * (x @ w) < 1
        a = x[active] * cost[active, None]
        new = np.linalg.solve(keep + a.T @ x[active], a.T @ y[active])
        if np.abs(new - w).max() < 1e-8:
            break
        w = new
    return w


def train_words(good: list[str], bad: list[str]) -> Machine:
    """The machine that tells `bad` words (toxic) from `good` ones."""
    marks = (bad + good)[:LANDMARKS] if len(bad) < LANDMARKS // 2 else bad[: LANDMARKS // 2] + good[: LANDMARKS // 2]
    keys = _keys(marks)
    base = _dense(marks, keys)
    values, vectors = np.linalg.eigh((base @ base.T).astype(np.float64))
    keep = values > 1e-6
    root = vectors[:, keep] / np.sqrt(values[keep])
    words = bad + good
    near = np.vstack([_dense(words[i : i + 256], keys) @ base.T for i in range(0, len(words), 256)]).astype(np.float64)
    y = np.concatenate([np.ones(len(bad)), -np.ones(len(good))])
    cost = np.where(y > 0, math.sqrt(len(good) / max(1, len(bad))), 1.0)
    w = _svm(near @ root, y, cost)
    return Machine(keys, base.T.astype(np.float64) @ (root @ w[:-1]), float(w[-1]))


class Scorer:
    """Evidence per text, remembering words."""

    def __init__(self, machine: Machine):
        self.machine, self.memo = machine, {}

    def texts(self, texts: list[bytes]) -> np.ndarray:
        """Per text: value of its highest distinct word, of the second (both between -TOP and TOP), and the log share of words over 0."""
        cut = [t.split() for t in texts]
        wanted = set().union(*cut)
        missing = wanted - self.memo.keys()
        if len(self.memo) + len(missing) > MEMO:
            self.memo.clear()
            missing = wanted
        new = [*missing]
        self.memo.update(zip(new, self.of(new), strict=True))
        get = self.memo.__getitem__
        out = np.array([self.evidence(np.fromiter(map(get, words), np.float64, len(words)), self.spelt(words)) for words in cut]).reshape(len(texts), FEATURES)
        for word in [w for w in new if len(w) > 256]:  # not remembered
            del self.memo[word]
        return out

    def evidence(self, values: np.ndarray, spelt: list[str]) -> tuple[float, float, float]:
        if spelt:
            values = np.concatenate([values, self.machine.words(spelt)])
        bias = self.machine.bias
        first = values.max(initial=bias)
        second = values[values < first].max(initial=bias)
        over = (1 / (1 + np.exp(-np.clip(8 * values, -40, 40)))).sum()  # counts words over 0, softly
        return float(np.clip(first, -TOP, TOP)), float(np.clip(second, -TOP, TOP)), math.log((over + 0.2) / (len(values) + 20))

    def of(self, words: list[bytes]) -> list[float]:
        plain = [letters(w) for w in words]
        once = [*set(plain)]
        return [*map(dict(zip(once, self.machine.words(once).tolist(), strict=True)).__getitem__, plain)]

    @staticmethod
    def spelt(words: list[bytes]) -> list[str]:
        """Words spelt as runs of three single letters or more."""
        sizes = np.fromiter(map(len, words), np.int32, len(words))
        one = sizes == 1
        wide = [] if all(map(bytes.isascii, words)) else np.flatnonzero((sizes > 1) & (sizes < 8)).tolist()
        for k in wide:  # a letter of several bytes, or with its accent beside it
            if not words[k].isascii():
                one[k] = len(unicodedata.normalize("NFC", words[k].decode("utf-8", "replace"))) == 1
        edges = np.flatnonzero(np.diff(np.concatenate([[0], one.view(np.int8), [0]])))
        return [w for a, b in edges.reshape(-1, 2).tolist() if b - a > 2 and len(w := letters(b"".join(words[a:b]))) > 2]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the smallest hash of a text's five-word shingles, under two hashes; 0 without words."""
    for rows, texts in slices(batches):
        sets = [shingles(WordIds().of(t.lower().split()), 5) for t in texts]
        least = [[int(mix(own ^ np.uint64(salt)).min(initial=(1 << 64) - 1) >> np.uint64(1)) if len(own) else 0 for own in sets] for salt in (0x1F1F, 0x2E2E)]
        yield pa.RecordBatch.from_arrays([*rows.columns, *(pa.array(x, pa.int64()) for x in least)], names=["toxic", "text", "first", "second"])


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows, texts in slices(batches):
        words = [sorted({y for x in map(letters, set(t.split())) if len(x) > 2 for y in ([x] if len(x) <= LONG else parts_of(x))}) for t in texts]
        yield pa.RecordBatch.from_arrays([*(rows.column(i) for i in range(2)), pa.array(words, pa.list_(pa.string()))], names=["toxic", "half", "words"])


def _told(counts: DataFrame, halves: tuple[int, ...], n: dict[tuple[int, int], int]) -> tuple[list[str], DataFrame]:
    """Words that tell toxic documents of these halves, and the words of the others. n: documents by (toxic, half)."""
    bad, good = (reduce(lambda a, b: a + b, [F.col(f"{kind}{h}") for h in halves]) for kind in ("bad", "good"))
    own = counts.select("word", bad.alias("bad"), good.alias("good")).where("bad + good > 0")
    n_bad, n_all = sum(n.get((1, h), 0) for h in halves), sum(n.get((y, h), 0) for y in (0, 1) for h in halves)
    rate = n_bad / max(1, n_all)
    share = F.col("bad") / (F.col("bad") + F.col("good"))
    gain = F.col("bad") * F.log(share / rate) + F.when(F.col("good") > 0, F.col("good") * F.log((1 - share) / (1 - rate))).otherwise(0.0)
    told = own.where((F.col("bad") > 0) & (share > rate)).withColumn("gain", gain) if 0 < rate < 1 else own.limit(0).withColumn("gain", F.lit(0.0))
    bound = math.log(max(2, own.count())) + 2
    bad = [r["word"] for r in told.where((F.col("gain") > bound) & (share > 0.7)).orderBy(F.desc("gain"), "word").collect()]  # from at most SAMPLE documents
    return bad or [r["word"] for r in told.orderBy(F.desc("gain"), "word").limit(5).collect()], own.where("good > 0").select("word")


def _machine(counts: DataFrame, halves: tuple[int, ...], n: dict[tuple[int, int], int], rounds: int) -> Machine:
    bad, calm = _told(counts, halves, n)
    known = set(bad)
    good = [r["word"] for r in calm.orderBy(F.xxhash64("word"), "word").limit(CHUNK).collect() if r["word"] not in known]
    if not bad or not good:
        return Machine()
    machine = train_words(good, bad)
    for _ in range(rounds - 1):
        known |= set(good)
        worst = _top(calm, machine).where("value > -1").orderBy(F.desc("value"), "word").limit(CHUNK + len(known)).collect()
        new = [r["word"] for r in worst if r["word"] not in known][:CHUNK]
        if not new:
            break
        good = new + good
        machine = train_words(good, bad)
    return machine


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """The machine, from labelled documents outside the held-out fold."""
    scratch = Scratch(docs.sparkSession)
    known = labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold() != HELD_OUT)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    chosen = F.broadcast(known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE))  # at most SAMPLE rows
    told = scratch.staged(docs.select("doc_id", "text").join(chosen, "doc_id").select("toxic", "text"), "labelled")
    # copies and near copies count once: of those with one smallest shingle hash, under each of two hashes, one stays
    rows = told.mapInArrow(_signed, "toxic int, text string, first long, second long")
    for key in ("first", "second"):
        rows = rows.groupBy("toxic", key).agg(F.min(F.struct(F.xxhash64("text"), "text", "first" if key == "second" else "second")).alias("r")).select("toxic", key, "r.*")
    rows = scratch.staged(rows.select("toxic", F.pmod(F.xxhash64("second", F.lit("half")), F.lit(2)).cast("int").alias("half"), "text"), "once")
    n = {(r["toxic"], r["half"]): r["n"] for r in rows.groupBy("toxic", "half").agg(F.count("*").alias("n")).collect()}
    machine = Machine()
    if len({y for y, _ in n}) == 2:
        words = rows.mapInArrow(_words, "toxic int, half int, words array<string>").select("toxic", "half", F.explode("words").alias("word"))
        sums = [F.sum(F.when((F.col("half") == h) & (F.col("toxic") == y), 1).otherwise(0)).alias(f"{kind}{h}") for h in (0, 1) for y, kind in enumerate(("good", "bad"))]
        counts = scratch.staged(words.groupBy("word").agg(*sums), "words")
        machine = _machine(counts, (0, 1), n, ROUNDS)
        seen = []
        for h in (0, 1):
            other = _machine(counts, (1 - h,), n, ROUNDS)
            seen += score_rows(rows.where(F.col("half") == h), other, "toxic").collect()  # at most as many rows as the sample has documents
        machine.curve = _logistic(np.array([r["evidence"] for r in seen]), np.array([r["toxic"] for r in seen], float))
    scratch.clear()
    return machine


def _top(words: DataFrame, machine: Machine) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            own = batch.column(0).to_pylist()
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(machine.words(own), pa.float64())], names=["word", "value"])

    return words.select("word").mapInArrow(run, "word string, value double")


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, ...]:
    """Slopes and base of a logistic curve, with a slight pull of the slopes to 0. Slopes that would be negative are 0: the most
    negative one is left out until none is."""
    mean, scale = x.mean(0), x.std(0) + 1e-9
    on = np.ones(x.shape[1], bool)
    while True:
        w = _newton(np.hstack([((x - mean) / scale)[:, on], np.ones((len(x), 1))]), y)
        if not on.any() or w[:-1].min() >= 0:
            break
        on[np.flatnonzero(on)[w[:-1].argmin()]] = False
    slopes = np.zeros(x.shape[1])
    slopes[on] = w[:-1]
    slopes /= scale
    return (*slopes.tolist(), float(w[-1] - slopes @ mean))


def _newton(a: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Newton steps, halved until the loss falls."""
    pull = np.full(a.shape[1], 0.1)
    pull[-1] = 1e-6
    loss = lambda w: np.logaddexp(0, a @ w).sum() - y @ (a @ w) + (pull * w * w).sum() / 2
    w = np.zeros(a.shape[1])
    for _ in range(100):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -40, 40)))
        step = np.linalg.solve(a.T @ (a * (p * (1 - p))[:, None]) + np.diag(pull), a.T @ (p - y) + pull * w)
        size = 1.0
        while size > 1e-6 and loss(w - size * step) > loss(w):
            size /= 2
        w = w - size * step
        if np.abs(size * step).max() < 1e-9:
            break
    return w


_SCORERS: dict[int, Scorer] = {}


def score_rows(docs: DataFrame, machine: Machine, *keep: str) -> DataFrame:
    """(keep, evidence, score) of every row: what its words show, and the probability."""
    shared = docs.sparkSession.sparkContext.broadcast(machine)  # a weight per subsequence of the landmarks
    mark = xxhash.xxh64_intdigest(machine.keys.tobytes() + machine.weights.tobytes() + np.float64([machine.bias, *machine.curve]).tobytes())
    fields = ", ".join(f"`{k}` {docs.schema[k].dataType.simpleString()}" for k in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = _SCORERS.get(mark)
        if scorer is None:
            _SCORERS.clear()
            scorer = _SCORERS[mark] = Scorer(shared.value)
        hold("toxicity", scorer.memo.clear)
        for rows, texts in slices(batches):
            values = scorer.texts(texts)
            own = [rows.column(rows.schema.get_field_index(k)) for k in keep]
            yield pa.RecordBatch.from_arrays([*own, pa.array(values.tolist(), pa.list_(pa.float64())), pa.array(scorer.machine.score(values))], names=[*keep, "evidence", "score"])

    return docs.select(*keep, *([] if "text" in keep else ["text"])).mapInArrow(run, f"{fields}, evidence array<double>, score double")


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    scored = score_rows(docs, train(docs, labels), "doc_id")
    return scored.select("doc_id", (fold() == HELD_OUT).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs that the machine doesn't call toxic."""
    columns = docs.columns
    held = docs.toDF(*[f"c{i}" for i in range(len(columns))]).withColumnRenamed(f"c{columns.index('text')}", "text")  # no name can clash
    scored = score_rows(held, train(docs, labels), *[c for c in held.columns if c != "text"], "text")
    return scored.where(F.col("score") < THRESHOLD).select(*held.columns).toDF(*columns)
