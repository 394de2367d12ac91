"""Quality rules: a ledger of failure bits and measurements, by Spark expressions only.

`ledger` evaluates every rule once per document and stores one bit per failed rule beside the measured
values. Policies are masks over the bits, with a version each: applying one, or asking what leaving a
rule out would change, reads the stored bits and never the texts. `quality` writes the ledger, then reads it for the policy and
for the ablation, which it writes beside it. Null and empty texts measure 0 everywhere and fail `few_words`. Repeated rows
are judged alike, further columns are kept; one that has the name of a measurement is replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shared_path, write_table

_SPACES = " \t\n\x0b\x0c\r"
_SYMBOLS = "#*$%&|<>"

#: Rules in the order of their bits: name, and the condition under which a document fails.
RULES: tuple[tuple[str, str], ...] = (
    ("few_words", "n_words < 50"),
    ("repeated_words", "100 * n_repeat_words > 50 * n_words"),
    ("symbols", "20 * n_symbols > word_chars"),
    ("upper_case", "10 * n_upper > 4 * word_chars"),
    ("exclamations", "20 * n_exclaim > word_chars"),
    ("duplicate_lines", "n_dup_lines >= 3 and 10 * n_dup_lines > 6 * n_lines"),
    ("long_words", "word_chars > 40 * n_words"),
)
BITS = {name: 1 << i for i, (name, _) in enumerate(RULES)}
BASE = BITS["few_words"] | BITS["repeated_words"]
#: Which rules reject a document, by version of the policy.
POLICIES = {"base": BASE, "v1": BASE | BITS["symbols"] | BITS["upper_case"] | BITS["exclamations"] | BITS["duplicate_lines"] | BITS["long_words"]}



def _let(value: Column, body) -> Column:
    """body(value), with value computed once."""
    return F.transform(F.array(value), body)[0]


def _covered(places: Column) -> Column:
    """Positions that 3-word windows starting at `places` (ascending) cover."""
    start = F.struct(F.lit(-3).alias("last"), F.lit(0).cast("long").alias("n"))
    step = lambda d, p: F.struct(p.alias("last"), (d["n"] + F.least(F.lit(3), p - d["last"])).alias("n"))
    return F.aggregate(places, start, step, lambda d: d["n"])


def _repeats_by_pairs(windows: Column) -> Column:
    """Positions of windows found twice or more, from sorted (window, position) pairs."""
    pairs = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

    def places(s: Column) -> Column:
        twice = lambda p, j: ((j > 0) & (F.get(s, j - 1)["h"] == p["h"])) | F.coalesce(F.get(s, j + 1)["h"] == p["h"], F.lit(False))
        return F.transform(F.filter(s, twice), lambda p: p["i"])

    return F.sort_array(_let(pairs, places))


def _count_repeats(windows: Column) -> Column:
    """Words in windows that are found twice or more. Most texts repeat none, which distinct counts show at once."""
    return F.when(F.size(F.array_distinct(windows)) == F.size(windows), F.lit(0).cast("long")).otherwise(_covered(_repeats_by_pairs(windows)))


def measure(docs: DataFrame) -> DataFrame:
    """Adds the measurements the rules use."""
    text = F.coalesce(F.col("text"), F.lit(""))
    flat = docs.withColumn("_rules_flat", F.translate(text, _SPACES, " " * len(_SPACES)))
    split = flat.withColumn("_rules_words", F.filter(F.split("_rules_flat", " "), lambda w: w != "")).withColumn("_rules_lines", F.filter(F.split(text, "\n"), lambda x: F.translate(x, _SPACES, "") != ""))
    counted = split.withColumns({
        "n_words": F.size("_rules_words").cast("long"),
        "n_lines": F.size("_rules_lines").cast("long"),
        "n_dup_lines": (F.size("_rules_lines") - F.size(F.array_distinct("_rules_lines"))).cast("long"),
        "word_chars": F.length(F.translate("_rules_flat", " ", "")).cast("long"),
        "n_symbols": (F.length(text) - F.length(F.translate(text, _SYMBOLS, ""))).cast("long"),
        "n_exclaim": (F.length(text) - F.length(F.translate(text, "!", ""))).cast("long"),
        "n_upper": (F.length(text) - F.length(F.regexp_replace(text, r"\p{Lu}+", ""))).cast("long"),
    })
    word = lambda i: F.get(F.col("_rules_words"), i)
    starts = F.when(F.size("_rules_words") >= 3, F.sequence(F.lit(0), F.size("_rules_words") - 3)).otherwise(F.array().cast("array<int>"))
    windows = counted.withColumn("_rules_windows", F.transform(starts, lambda i: F.xxhash64(word(i), word(i + 1), word(i + 2))))
    return windows.withColumn("n_repeat_words", _count_repeats(F.col("_rules_windows"))).drop("_rules_flat", "_rules_words", "_rules_lines", "_rules_windows")


def ledger(docs: DataFrame) -> DataFrame:
    """docs without text, with the measurements and `failed`, the bits of the rules they fail."""
    bits = [F.when(F.expr(rule), F.lit(BITS[name])).otherwise(F.lit(0)) for name, rule in RULES]
    failed = bits[0]
    for bit in bits[1:]:
        failed = failed.bitwiseOR(bit)
    return measure(docs).withColumn("failed", failed.cast("long")).drop("text")


def apply_policy(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Adds base_failed and kept, by the stored bits."""
    hit = lambda mask: F.col("failed").bitwiseAND(F.lit(mask)) != 0
    return rows.withColumn("base_failed", hit(BASE)).withColumn("kept", ~hit(POLICIES[version] | BASE))


def ablation(rows: DataFrame, version: str = "v1") -> DataFrame:
    """Per rule of the policy: documents failing it, failing it alone, and kept if it were left out."""
    mask = POLICIES[version]
    own = F.col("failed").bitwiseAND(F.lit(mask))
    per = [F.struct(F.lit(n).alias("rule"), F.lit(b).cast("long").alias("bit")) for n, b in BITS.items() if b & mask]
    cut = rows.select(own.alias("own")).groupBy("own").agg(F.count("*").alias("n"))  # at most 2**rules rows
    one = cut.select(F.explode(F.array(*per)).alias("r"), "own", "n")
    hit = lambda test: F.sum(F.when(test, F.col("n")).otherwise(0))
    fails = F.col("own").bitwiseAND(F.col("r.bit")) != 0
    rest = F.col("own").bitwiseAND(F.bitwise_not(F.col("r.bit"))) == 0
    return one.groupBy(F.col("r.rule").alias("rule"), F.col("r.bit").alias("bit")).agg(hit(fails).alias("failing"), hit(fails & rest).alias("failing_alone"), hit(rest).alias("kept_without"), F.bit_or("own").alias("all_bits"))


def write_ledger(docs: DataFrame, path: str | None = None, version: str = "v1") -> str:
    """Writes the ledger of docs to `path`/ledger, and from that the ablation of a policy to `path`/ablation-`version`."""
    path = path or shared_path(docs.sparkSession, "ledger")
    write_table(ledger(docs), f"{path}/ledger")
    write_table(ablation(docs.sparkSession.read.parquet(f"{path}/ledger"), version), f"{path}/ablation-{version}")
    return path


def quality(docs: DataFrame, version: str = "v1") -> DataFrame:
    """Measurements and verdicts per document, from the written ledger."""
    names = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    spark = docs.sparkSession
    return apply_policy(spark.read.parquet(f"{write_ledger(docs, version=version)}/ledger"), version).select("doc_id", *names, "base_failed", "kept", "failed")
