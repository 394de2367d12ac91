"""Personal data: base patterns, and identifiers found by bootstrapped contexts.

Base matches (email, ip, card, phone) are seeds. The words around a seed make lexical patterns: the two words
before it, and the word on each side. Tokens with a digit that no base match covers are candidates, with the same
patterns; tokens of digits that single spaces join are one candidate. Tokens without digits are none: a context's score
can't tell them from ordinary words, which would be masked.

Pattern-instance edges form a graph that is scored in rounds, to a fixed point. A pattern scores the share of its distinct
instances that are known, each by its own score (seeds: 1). Patterns with SUPPORT known instances and a score of `accept` are
good. A candidate of good patterns becomes known, with the noisy-or of their scores, which it then keeps; so it counts as a
seed in its other patterns, and a chain of discoveries weakens from step to step. Candidates that good patterns surround
become spans of kind `id`. Base spans are never changed.

Null texts hold nothing, repeated rows are told apart by their place, equal values are one instance, empty tables give empty
results; other columns than doc_id and text are ignored by `find_pii`, and kept by `redact`, whatever their names.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, numbered, slices, staged

KINDS = ("email", "ip", "card", "phone", "id")
SUPPORT, ACCEPT = 3, 0.5

# Fixed forms.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
_CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

_HINT = re.compile(rb"[0-9@]")
_TOKEN = re.compile(r"[^\s\"'(),;:=<>]+")
_DIGIT = re.compile("[0-9]")
_GROUP = re.compile("[0-9][0-9./-]*")
_SPAN = pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("value", pa.string()), ("before", pa.string()), ("around", pa.string())])
_ROWS = "doc_id long, row long, spans array<struct<kind:string,start:long,end:long,value:string,before:string,around:string>>"


def luhn(digits: str) -> bool:
    twice = [(2 * int(d) - 9 if d > "4" else 2 * int(d)) for d in digits[-2::-2]]
    return (sum(twice) + sum(map(int, digits[::-2]))) % 10 == 0


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Base matches, leftmost and non-overlapping per kind, in code points."""
    out = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append(("email", start, m.end()))
            done = m.end()
        at = text.find("@", at + 1)
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(p.lstrip("0")) < 4 and int(p.lstrip("0")[-3:] or 0) < 256 for p in m[0].split("."))]
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 9 <= len(_DIGIT.findall(m[0])) <= 15]
    return out


def _context(text: str, start: int, end: int) -> tuple[str, str]:
    """The two words before, and the word on each side; digits count alike."""
    shape = lambda w: _DIGIT.sub("0", w.lower())
    reach, before, after = 64, [], []
    while len(before) < 3 and reach < 2 * start + 128:  # a third word, so that the second is whole
        before, reach = text[max(0, start - reach) : start].split(), 2 * reach
    reach = 64
    while len(after) < 2 and reach < 2 * (len(text) - end) + 128:
        after, reach = text[end : end + reach].split(), 2 * reach
    two = " ".join(map(shape, before[-2:])) if len(before) > 1 else ""
    return two, f"{shape(before[-1])} _ {shape(after[0])}" if before and after else ""


def mentions(text: str) -> list[dict]:
    spans = base_spans(text)
    taken = sorted((a, b) for _, a, b in spans)
    free, next_, reach, joins = [], 0, 0, -1  # joins: where a group of digits that goes on would begin
    for m in _TOKEN.finditer(text):
        word = m[0].rstrip(".!?#*$%&|")
        if not _DIGIT.search(word):
            continue
        a, b = m.start(), m.start() + len(word)
        while next_ < len(taken) and taken[next_][0] < b:  # reach: how far the spans that start before b go
            reach = max(reach, taken[next_][1])
            next_ += 1
        if reach <= a:
            group = _GROUP.fullmatch(word)
            free.append(("id", free.pop()[1] if group and a == joins else a, b))
            joins = b + 1 if group and text[b : b + 1] == " " else -1
    return [{"kind": k, "start": a, "end": b, "value": text[a:b].lower(), "before": two, "around": one} for k, a, b in spans + free for two, one in (_context(text, a, b),)]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    row = TaskContext.get().partitionId() << 36
    for rows, texts in slices(batches):
        found = [mentions(t.decode("utf-8", "replace")) if _HINT.search(t) else [] for t in texts]
        ids = pa.array(range(row, row + len(texts)), pa.int64())
        row += len(texts)
        yield pa.RecordBatch.from_arrays([rows.column("doc_id"), ids, pa.array(found, pa.list_(_SPAN))], names=["doc_id", "row", "spans"])


def _patterns(edge: str = "") -> F.Column:
    return F.array(F.concat(F.lit("B "), f"{edge}before"), F.concat(F.lit("A "), f"{edge}around"))


def score_patterns(rows: DataFrame, accept: float = ACCEPT, scratch: Scratch | None = None) -> DataFrame:
    """(pattern, score, support) of the good patterns of mentions, at the fixed point."""
    scratch = scratch or Scratch(rows.sparkSession)
    m = rows.select(F.explode("spans").alias("s")).select("s.*")
    named = m.select("value", (F.col("kind") != "id").alias("seed"), F.explode(_patterns()).alias("pattern")).where(F.length("pattern") > 2)
    every = named.groupBy("pattern", "value").agg(F.max("seed").alias("seed"))
    size = every.groupBy("pattern").agg(F.count("*").alias("n")).where(F.col("n") >= SUPPORT)  # others can't be good
    edges = scratch.staged(every.join(size, "pattern"), "edges")
    known = scratch.staged(edges.groupBy("value").agg(F.max("seed").alias("seed")).where("seed").select("value", F.lit(1.0).alias("score")), "known")
    while True:
        seen = edges.join(known, "value").groupBy("pattern", "n").agg(F.sum("score").alias("mass"), F.count("*").alias("support"))
        scored = seen.select("pattern", (F.col("mass") / F.col("n")).alias("score"), "support")
        good = scratch.staged(scored.where((F.col("support") >= SUPPORT) & (F.col("score") >= accept)), "good")
        fresh = edges.join(good.select("pattern", F.col("score").alias("p")), "pattern").join(known, "value", "left_anti")
        miss = F.exp(F.sum(F.log1p(-F.least(F.col("p"), F.lit(0.999)))))
        new = scratch.staged(fresh.groupBy("value").agg((1 - miss).alias("score")), "known")
        if not new.head(1):
            return good
        known = known.union(new)


def find_pii(docs: DataFrame, accept: float = ACCEPT) -> DataFrame:
    """(doc_id, row, spans) per row of docs; spans (kind, start, end) by start, then kind."""
    scratch = Scratch(docs.sparkSession)
    scanned = staged(docs.select("doc_id", "text").mapInArrow(_scan, _ROWS), "mentions")
    hits = scanned.where(F.size("spans") > 0)
    good = score_patterns(hits, accept, scratch).select("pattern")
    free = hits.select("row", F.explode(F.filter("spans", lambda s: s["kind"] == "id")).alias("s"))
    tried = free.select("row", "s.start", "s.end", F.explode(_patterns("s.")).alias("pattern"))
    found = tried.join(good, "pattern", "left_semi").groupBy("row").agg(F.collect_set(F.struct(F.lit("id").alias("kind"), "start", "end")).alias("found"))
    found = staged(found, "found")
    scratch.clear()
    base = F.transform(F.filter("spans", lambda s: s["kind"] != "id"), lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    place = lambda s: F.struct(s["start"].alias("start"), F.array_position(F.array(*map(F.lit, KINDS)), s["kind"]).alias("place"), s["end"].alias("end"), s["kind"].alias("kind"))
    every = F.sort_array(F.transform(F.concat(base, F.coalesce("found", F.array().cast("array<struct<kind:string,start:bigint,end:bigint>>"))), place))
    back = F.transform(every, lambda s: F.struct(s["kind"].alias("kind"), s["start"].alias("start"), s["end"].alias("end")))
    return scanned.join(found, "row", "left").select("doc_id", "row", back.alias("spans"))


def pii_report(docs: DataFrame) -> DataFrame:
    rows = find_pii(docs)
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.sha2(line(F.filter("spans", lambda s: s["kind"] != "id")), 256).alias("base_sha256")
    return rows.select("doc_id", *map(count, KINDS[:4]), base, line(F.col("spans")).alias("spans"), count("id"))


def redact(docs: DataFrame) -> DataFrame:
    """docs with every span replaced by its kind in angle brackets; n_chars follows where it is a column."""
    columns = docs.columns
    rows = numbered(docs.toDF(*[f"c{i}" for i in range(len(columns))]))  # no name can clash
    body, length = (f"c{columns.index(c)}" if c in columns else None for c in ("text", "n_chars"))
    spans = find_pii(rows.select(F.col("_row").alias("doc_id"), F.col(body).alias("text"))).select(F.col("doc_id").alias("_row"), F.col("spans").alias("_spans")).where(F.size("_spans") > 0)
    text = F.coalesce(body, F.lit(""))

    def put(d, s):
        begin = F.greatest(s["start"], d["at"])
        mark = F.when(s["start"] >= d["at"], F.concat(F.lit("<"), F.upper(s["kind"]), F.lit(">"))).otherwise(F.lit(""))
        kept = F.substring(text, (d["at"] + 1).cast("int"), (begin - d["at"]).cast("int"))
        return F.struct(F.greatest(s["end"], d["at"]).alias("at"), F.concat(d["out"], F.array(F.concat(kept, mark))).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("out"))
    done = F.aggregate("_spans", start, put, lambda d: F.concat(F.array_join(d["out"], ""), F.substring(text, (d["at"] + 1).cast("int"), 2**31 - 1)))
    out = rows.join(spans, "_row", "left").withColumn(body, F.when(F.col("_spans").isNotNull(), done).otherwise(F.col(body)))
    if length:
        out = out.withColumn(length, F.length(body).cast(docs.schema["n_chars"].dataType))
    return out.select(*[f"c{i}" for i in range(len(columns))]).toDF(*columns)
