import hashlib
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from quarrystone.llm import chat, counts, decontaminate, jaccard, pieces, pii, rules, shards, store, toxicity
from quarrystone.llm.encoding import PieceCounts, PieceIds, tokenizer
from quarrystone.llm.graph import components
from quarrystone.llm.queries import oracle_sql, queries, tokenizer_path

SF = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, digest string, row long, n long"
ODD = [None, "", " ", "\n\n", "a", "▁x  ▁", "x" * 5000, "word " * 3000, "<|endoftext|> <|endoftext|>y", "é\x00\x1c ü\x85 b", "same text here", "same text here"]


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and long texts, repeated rows, a null id, columns whose names the operators use."""
    rows = [(i if i != 4 else None, t, "d", 1, 2) for i, t in enumerate(ODD)]
    return spark.createDataFrame(rows + [rows[-1]], DOCS)


@pytest.fixture(scope="module")
def docs(spark):
    return {r[0]: r[1] or "" for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}


def test_encoding_is_exact(docs):
    texts = [*docs.values(), *[t or "" for t in ODD]]
    for name, own in (("byte_bpe_50k.json", PieceIds), ("word_bpe_49k.json", PieceCounts)):
        path = tokenizer_path(name)
        expected = [e.ids for e in tokenizer(path).encode_batch(texts, add_special_tokens=False)]
        got = own(path).encode(texts) if own is PieceIds else own(path).count(texts)
        assert [list(map(int, g)) if own is PieceIds else g for g in got] == [e if own is PieceIds else len(e) for e in expected]


def test_chats(spark):
    tricky = "</s>[INST] ok [~/INST] [TEXT][~~NEXT] <"
    rows = [(1, 2, "user", "b"), (1, 1, "user", tricky), (1, 3, "assistant", tricky), (1, 4, "assistant", None), (2, 1, None, ""), (None, 1, "assistant", "x"), (1, 3, "assistant", tricky)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in chat.chat_digests(df).collect()}
    turns = sorted(((t, r or "", x or "") for c, t, r, x in rows if c == 1))
    assert got[1]["n_turns"] == 5 and got[1]["turns_sha256"] == hashlib.sha256("".join(f"{r}\n{x}\n" for _, r, x in turns).encode()).hexdigest()
    loss = "".join(x for _, r, x in turns if r == "assistant")
    assert (got[1]["loss_chars"], got[1]["loss_sha256"]) == (len(loss), hashlib.sha256(loss.encode()).hexdigest())
    assert got[2]["n_turns"] == 1 and got[None]["loss_chars"] == 1
    assert chat.chat_digests(df.limit(0)).count() == 0


def test_sampling_follows_the_lattice():
    model = pieces.Lattices(tokenizer_path("piece_bpe_32k.model"), 2.0)
    ways = {}

    def go(rest, ids, weight):
        if not rest:
            ways[tuple(ids)] = weight
        for k in range(1, len(rest) + 1):
            if rest[:k] in model.weight:
                i, w = model.weight[rest[:k]]
                go(rest[k:], [*ids, i], weight * w)

    go(" thener", [], 1.0)
    drawn = Counter(tuple(x.tolist()) for x in model.sample(["thener"] * 8000, np.arange(8000, dtype=np.uint64) * np.uint64(7919)))
    total = sum(ways.values())
    assert all(abs(drawn[k] / 8000 - w / total) < 0.03 for k, w in ways.items())


def test_pieces_are_lossless_and_keyed(spark, odd):
    path = tokenizer_path("piece_bpe_32k.model")
    rows = pieces.decode(pieces.encode(odd, path), path).collect()
    assert all(r["decoded"] == (r["text"] or "") for r in rows)
    again = pieces.encoded_report(odd.repartition(5), path).collect()
    assert all(r["lossless"] for r in again)
    assert sorted((r["doc_id"] or 0, tuple(r["pieces"])) for r in rows) == sorted((r["doc_id"] or 0, tuple(r["pieces"])) for r in again)


@pytest.mark.parametrize("n", [0, 1, 64, 65, 5000, 20000])
def test_cuts(n):
    ids = np.random.default_rng(n).integers(0, 50000, n + 1).astype(np.uint16)
    ends = store.cuts(ids)
    sizes = np.diff([0, *ends])
    assert ends[-1] == n + 1 and max(sizes) <= store.MOST and min(sizes) > 0
    if n == 20000:
        moved = store.cuts(np.concatenate([ids[:100][::-1], ids]))
        assert len({n + 1 - e for e in ends} & {n + 101 - e for e in moved}) > len(ends) // 2


def test_store(spark, odd):
    path = tokenizer_path("byte_bpe_50k.json")
    where = store.write_store(odd, path)
    got = sorted(map(tuple, store.read_store(spark, where).select("start", "doc_id", "n_tokens", "ids_crc32").collect()))
    rows = sorted(((r["doc_id"], r["text"] or "") for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0))
    at = 0
    for (doc_id, text), row in zip(rows, got, strict=True):
        ids = np.array([*tokenizer(path).encode(text, add_special_tokens=False).ids, store.END], "<u4")
        assert row == (at, doc_id, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)
    assert store.read_ids(spark, where).count() == len(rows) and len(store.store_root(spark, where)) == 16
    assert store.read_store(spark, store.write_store(odd.limit(0), path)).count() == 0


def test_shift_crc():
    a, b = b"some bytes", b"and more of them" * 9
    moved = store.shift_crc(np.array([zlib.crc32(a)]), np.array([len(b)]))
    assert int(moved[0]) ^ zlib.crc32(b) == zlib.crc32(a + b)


def test_decontamination(spark, docs):
    bench = {r[0]: r[1] for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()}
    plain = lambda t: [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in WORD.findall(t)) if x]
    grams = lambda w: {tuple(w[i : i + 5]) for i in range(len(w) - 4)}
    items = {i: grams(plain(t)) for i, t in bench.items()}
    expected = {(d, i) for d, t in docs.items() for i, s in items.items() if len(s & grams(plain(t))) >= 0.8 * len(s)}
    got = decontaminate.find_leaks(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet"))
    assert {(r["doc_id"], r["item_id"]) for r in got.collect()} == expected and expected
    few = spark.createDataFrame([(1, None), (2, ""), (3, "only three words")], "item_id long, text string")
    some = spark.createDataFrame([(1, "ONLY three** words"), (2, None), (2, "and only three words here")], "doc_id long, text string")
    assert sorted((r["doc_id"], r["item_id"]) for r in decontaminate.find_leaks(some, few).collect()) == [(1, 3), (2, 3)]
    assert decontaminate.drop_leaks(some, few.limit(0)).count() == 3


def _joined(texts, width, percent):
    sets = {}
    for i, t in texts:
        w = (t or "").encode().lower().split()
        sets[i] = {tuple(w[k : k + width]) for k in range(max(1, len(w) - width + 1))} if w else set()
    parent = {i: i for i in sets}

    def find(x):
        return x if parent[x] == x else find(parent[x])

    for a in sets:
        for b in sets:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {(i, len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize("width,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, docs, width, percent):
    draw = np.random.default_rng(5)
    texts = [*docs.items()][:120] + [(10**6 + i, t) for i, t in enumerate(ODD)]
    base = [f"w{i}" for i in range(60)]
    for i in range(60):  # near copies around both sides of the threshold
        own = list(base)
        for k in draw.integers(0, 60, draw.integers(0, 4)):
            own[k] = f"x{draw.integers(0, 9)}"
        texts.append((2 * 10**6 + i, " ".join(own)))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    assert set(map(tuple, jaccard.similar(df, width, percent).collect())) == _joined(texts, width, percent)


def test_jaccard_edges(spark, odd):
    got = jaccard.similar(odd).collect()
    assert len(got) == len(ODD) + 1 and {r["component_id"] for r in got if r["doc_id"] in (10, 11)} == {10}
    assert jaccard.drop_similar(odd).count() == len(ODD) - 1
    assert jaccard.similar(odd.limit(0)).count() == 0


def test_jaccard_reads_every_text_of_a_doc_id(spark):
    draw = np.random.default_rng(11)
    texts = [(1, " ".join(f"p{i}" for i in range(80))), (1, " ".join(f"q{i}" for i in range(80))), (2, " ".join(f"p{i}" for i in range(79))), (3, " ".join(f"q{i}" for i in range(79)))]
    for family in range(20):
        for _ in range(4):
            own = [f"f{family}w{i}" for i in range(60)]
            for k in draw.integers(0, 60, draw.integers(0, 4)):
                own[k] = f"x{draw.integers(0, 9)}"
            texts.append((10 + int(draw.integers(0, 70)), " ".join(own)))
    links = _joined([*enumerate(t for _, t in texts)], 4, 85)
    groups = {first: {texts[r][0] for r, _, f in links if f == first} for _, _, first in links}
    name = {i: i for i, _ in texts}
    for _ in texts:
        for ids in groups.values():
            least = min(name[i] for i in ids)
            name.update(dict.fromkeys(ids, least))
    expected = sorted((texts[r][0], n, name[texts[r][0]]) for r, n, _ in links)
    got = jaccard.similar(spark.createDataFrame(texts, "doc_id long, text string")).collect()
    assert sorted(map(tuple, got)) == expected and name[2] == name[3] == 1 and len(set(name.values())) > 10


def test_drops_go_by_row(spark):
    one, two, item = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30)), "one two three four five six"
    rows = [(1, one), (1, two), (2, one), (None, two), (3, "x " + item), (3, "clean"), (None, item + " y"), (None, "also clean")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    order = lambda out: sorted(map(tuple, out), key=repr)
    assert order(decontaminate.drop_leaks(df, bench).collect()) == order(r for r in rows if item not in r[1])
    assert order(jaccard.drop_similar(df).collect()) == order(r for r in rows if r not in [(2, one), (None, two)])


def test_components(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(50, 60), (60, 55), (7, 7)], "a long, b long")
    got = dict(map(tuple, components(edges).collect()))
    assert got == {i: 0 for i in range(21)} | {50: 50, 55: 50, 60: 50}
    assert components(edges.limit(0)).count() == 0


def test_kernel_tolerates_gaps():
    near = toxicity.kernel(["idiot", "idxiot", "stone"], ["idiot"])[:, 0]
    assert near[0] == pytest.approx(1, abs=1e-4) and near[1] > 0.5 > 2 * near[2]


def test_toxicity(spark):
    sf = "/root/testdata/sf0.01"
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    rows = toxicity.toxicity(docs, labels).join(labels, "doc_id").where("held_out").toPandas()
    assert ((rows.predicted == 0) | (rows.toxic == 1)).mean() > 0.97 and rows.predicted[rows.toxic == 1].mean() > 0.5
    odd = spark.createDataFrame([(1, None), (2, ""), (3, "!!")], "doc_id long, text string")
    assert {r["predicted"] for r in toxicity.toxicity(odd, labels.limit(0)).collect()} == {0}


def test_machine_reads_spelt_words():
    machine = toxicity.train_words(["stone", "water", "there", "listen"], ["idiot", "moron"])
    values = toxicity.Scorer(machine).texts([b"you i d i o t now", b"you are here now", b"an id.i.ot", b""])[:, 0]
    assert values[0] > 0 > values[1] and values[2] > 0 and values[3] < 0


def test_machine_reads_accents_and_other_scripts():
    machine = toxicity.train_words(["stone", "water", "there", "listen", "привет", "спасибо", "хорошо"], ["idiot", "moron", "дурак", "болван"])
    values = toxicity.Scorer(machine).texts([t.encode() for t in ("an ïdíot", "you i d \u00ef o\u0301 t now", "ты дурак", "ты хорошо", "ты д у р а к")])[:, 0]
    assert (values[[0, 1, 2, 4]] > 0).all() and values[3] < 0
    assert toxicity.kernel(["дурак"], ["привет", "дурак", "здураки"])[0, 0] < 0.05 and toxicity.kernel(["\u0434\u0443\u0440"], ["\u0438\u0447\u0444"])[0, 0] < 0.6


def _base(text):
    out = [("email", *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [("ip", *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) < 256 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = [int(c) for c in m[0] if c.isdigit()][::-1]
        if 12 <= len(d) <= 19 and sum(x if i % 2 == 0 else x * 2 - 9 * (x > 4) for i, x in enumerate(d)) % 10 == 0:
            out.append(("card", *m.span()))
    return sorted(out + [("phone", *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15])


@pytest.mark.parametrize("text", ["a@b.c@d.e x@y @z.w a..b@c.d.e-f", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.255", "4111 1111 1111 1111 4111-1111-1111-1112", "+1 (555) 010-9999 +12 + 3 +1((((", "é@b.co ü+49 30 1234567."])
def test_base_spans(text):
    assert sorted(pii.base_spans(text)) == _base(text)


def test_pii(spark, docs, odd):
    rows = pii.pii_report(spark.read.parquet(f"{SF}/documents.parquet")).collect()
    order = ["email", "ip", "card", "phone"]
    for r in rows:
        spans = sorted(_base(docs[r["doc_id"]]), key=lambda s: (s[1], order.index(s[0])))
        assert r["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()
    assert pii.pii_report(odd).count() == len(ODD) + 1 and pii.pii_report(odd.limit(0)).count() == 0


def test_contexts_find_unseen_identifiers(spark):
    texts = [(i, f"please call number: +1 202 555 01{i:02d} today") for i in range(20)] + [(90, "please call number: 77-1234-99 today"), (91, "version 12345 only")]
    df = spark.createDataFrame([(i, t, "en", len(t)) for i, t in texts], "doc_id long, text string, lang string, n_chars long")
    found = {r["doc_id"]: r for r in pii.pii_report(df).collect()}
    assert found[90]["n_id"] == 1 and found[91]["n_id"] == 0 and found[0]["n_phone"] == 1
    masked = {r["doc_id"]: r for r in pii.redact(df).collect()}
    assert masked[90]["text"] == "please call number: <ID> today" and masked[0]["text"] == "please call number: <PHONE> today" and masked[91]["text"] == texts[-1][1]
    assert masked[0]["n_chars"] == len(masked[0]["text"])


def test_contexts_find_short_and_grouped_identifiers(spark):
    texts = [(i, f"please call number: +1 202 555 01{i:02d} today") for i in range(20)] + [(90, "please call number: AB-123 today"), (91, "please call number: 77 1234 99 today"), (92, "version 7 only, 12 34")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    masked = {r["doc_id"]: r["text"] for r in pii.redact(df).collect()}
    assert masked[90] == masked[91] == "please call number: <ID> today" and masked[92] == texts[-1][1]
    found = lambda t: [t[s["start"] : s["end"]] for s in pii.mentions(t) if s["kind"] == "id"]
    assert found("a 1 22. 333 x4 5  6 7, 8 (9 10) +1 202 555 0123, 11") == ["1 22", "333", "x4", "5", "6 7", "8", "9 10", "11"]


def test_counts_use_the_cache(spark, odd):
    path = tokenizer_path("word_bpe_49k.json")
    cache = counts.CountCache(spark)
    first = sorted(map(tuple, counts.token_counts(odd, path, cache=cache).collect()), key=str)
    n = spark.read.parquet(cache.path).count()
    assert n == len({t or "" for t in ODD}) and sorted(map(tuple, counts.token_counts(odd, path, cache=cache).collect()), key=str) == first
    assert spark.read.parquet(cache.path).count() == n and len(first) == len(ODD) + 1
    assert counts.token_counts(odd.limit(0), path).count() == 0


def test_matrix():
    m = shards.communication_matrix([5, 0, 7, 100], 8, 3)
    assert m.sum(1).tolist() == [5, 0, 7, 100] and m.sum(0).max() - m.sum(0).min() <= 1


def test_shards(spark, odd):
    rows = shards.shard_report(odd.repartition(4)).collect()
    sizes = Counter(r["shard"] for r in rows)
    assert len(rows) == len(ODD) + 1 and max(sizes.values()) - min(sizes.values()) <= 1
    assert all(sorted(r["slot"] for r in rows if r["shard"] == s) == [*range(n)] for s, n in sizes.items())
    assert shards.shard_report(odd.limit(0)).count() == 0


def test_rules(spark, docs, odd):
    texts = docs | {10**6 + i: t or "" for i, t in enumerate(ODD)} | {10**7: "a b c a b c a b c d"}
    df = spark.createDataFrame([*texts.items()], "doc_id long, text string")
    for r in rules.quality(df).collect():
        text = texts[r["doc_id"]]
        words = WORD.findall(text)
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        seen, lines, dup = Counter(windows), set(), 0
        covered = {i + k for i, w in enumerate(windows) if seen[w] > 1 for k in range(3)}
        for line in text.split("\n"):
            if WORD.search(line):
                dup += line in lines
                lines.add(line)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(covered))
        assert r["base_failed"] == (len(words) < 50 or 100 * len(covered) > 50 * len(words)) and not (r["base_failed"] and r["kept"])
    book = rules.ledger(odd)
    assert {r["rule"]: r["failing"] for r in rules.ablation(book).collect()}["few_words"] == len(ODD)
    assert rules.quality(odd.limit(0)).count() == 0


def test_pipeline(spark):
    import corpus_pipeline

    rows = corpus_pipeline.run(spark, SF).collect()
    assert 0 < len(rows) <= 200 and all(r["lossless"] for r in rows)
    assert set(queries()) == {n for n in queries() if re.match(r"op([1-9]|10)_", n)} and len(queries()) == 10


def test_pipeline_keeps_what_brute_force_keeps(spark, docs):
    import corpus_pipeline

    table = lambda name: spark.read.parquet(f"{SF}/{name}.parquet")
    calm = {r["doc_id"] for r in toxicity.toxicity(table("documents"), table("labels")).collect() if not r["predicted"]}
    apart = {i for i, _, first in _joined([(i, docs[i]) for i in sorted(calm)], 5, 80) if i == first}
    plain = lambda t: [x for x in (re.sub(r"[\W_]+", "", w.lower()) for w in WORD.findall(t)) if x]
    grams = lambda w, k: {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}
    items = [(min(5, len(w)), grams(w, min(5, len(w)))) for r in table("benchmark").collect() if (w := plain(r["text"] or ""))]
    clean = {i for i in apart if not any(len(s & grams(plain(docs[i]), k)) >= 0.8 * len(s) for k, s in items)}
    assert clean < apart < calm < set(docs)
    rows = corpus_pipeline.run(spark, SF).collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(clean)


@pytest.mark.parametrize("name", sorted(oracle_sql()))
def test_sql_agrees(spark, name):
    base = duckdb.connect()
    for table in ("documents", "benchmark", "conversations"):
        base.execute(f"CREATE VIEW {table} AS FROM '{SF}/{table}.parquet'")
    got, expected = queries()[name](spark, SF).toPandas(), base.execute(oracle_sql()[name]).fetch_df()
    columns = sorted(got.columns)
    assert columns == sorted(expected.columns) and len(got)
    rows = lambda df: sorted(map(repr, df[columns].astype(object).values.tolist()))
    assert rows(got) == rows(expected)


def test_sketches_bound_differences():
    draw = np.random.default_rng(3)
    for n, k in ((40, 3), (300, 40), (5000, 900)):
        a = np.unique(draw.integers(0, 1 << 62, n).astype(np.uint64))
        b = np.concatenate([a[k:], np.unique(draw.integers(0, 1 << 62, k).astype(np.uint64))])
        apart = sum(int(x).bit_count() for x in (jaccard.sketch(a) ^ jaccard.sketch(b)).view(np.uint64))
        assert 0 < apart <= len(set(a.tolist()) ^ set(b.tolist()))
    assert not jaccard.sketch(np.zeros(0, np.uint64)).any()


def test_discoveries_are_seeds(spark):
    values = [f"QX-{i}7{i}" for i in range(10)]
    texts = [f"please call number: +1 202 555 01{i:02d} today" for i in range(20)] + [f"please call number: {v} today" for v in values]
    texts += [f"the member known as {v} has joined" for v in values] + ["the member known as ZZ-1 has joined", "the version is 12 now", "the version is 13 now", "the version is 14 now"]
    df = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string")
    found = {r["doc_id"]: r["n_id"] for r in pii.pii_report(df).collect()}
    assert all(found[i] == (20 <= i <= 40) for i in found)


def _known_by_brute_force(texts):
    edges = {}
    for t in texts:
        for m in pii.mentions(t):
            for p in ("B " + m["before"], "A " + m["around"]):
                if len(p) > 2:
                    seeds = edges.setdefault(p, {})
                    seeds[m["value"]] = seeds.get(m["value"], False) or m["kind"] != "id"
    known = {v: 1.0 for own in edges.values() if len(own) >= pii.SUPPORT for v, seed in own.items() if seed}
    while True:
        share = {p: (sum(known.get(v, 0) for v in own) / len(own), sum(v in known for v in own)) for p, own in edges.items() if len(own) >= pii.SUPPORT}
        good = {p: s for p, (s, n) in share.items() if n >= pii.SUPPORT and s >= pii.ACCEPT}
        new = {}
        for p, s in good.items():
            for v in edges[p].keys() - known.keys():
                new[v] = 1 - (1 - new.get(v, 0)) * (1 - min(s, 0.999))
        if not new:
            return good
        known |= new


def test_pattern_scores_agree_with_brute_force(spark, docs):
    draw = np.random.default_rng(2)
    frames = ["call {} now", "dial number {} please", "the room {} is", "my card {} was", "ref {} sent"]
    seeds = [f"+1 202 555 {i:04d}" for i in range(30)] + [f"a{i}@b.co" for i in range(10)]
    own = [f"K{i}" for i in range(25)]
    texts = [frames[draw.integers(5)].format((seeds + own)[draw.integers(65)]) for _ in range(300)] + [*docs.values()]
    rows = spark.createDataFrame([*enumerate(texts)], "doc_id long, text string").select("doc_id", "text").mapInArrow(pii._scan, pii._ROWS)
    got = {r["pattern"]: r["score"] for r in pii.score_patterns(rows).collect()}
    assert got == pytest.approx(_known_by_brute_force(texts)) and len(got) > 3


def test_splits_beyond_numpy():
    sizes = [10**9, 5 * 10**8, 15 * 10**8, 0, 7]
    m = shards.communication_matrix(sizes, 8, 3)
    assert m.sum(1).tolist() == sizes and m.sum(0).max() - m.sum(0).min() <= 1 and (m >= 0).all()
    assert 0 < abs(m[0] - 10**9 / 8).max() < 10**5


def test_split_has_the_hypergeometric_law(monkeypatch):
    left, n, tries = np.array([6, 3, 3]), 5, 6000
    monkeypatch.setattr(shards, "LARGE", 0)
    drawn = Counter(tuple(shards.split(left, n, np.random.default_rng(i)).tolist()) for i in range(tries))
    from math import comb

    law = {(a, b, n - a - b): comb(6, a) * comb(3, b) * comb(3, n - a - b) / comb(12, n) for a in range(6) for b in range(4) if 0 <= n - a - b <= 3}
    assert set(drawn) <= set(law)
    chi = sum((drawn[k] - tries * p) ** 2 / (tries * p) for k, p in law.items())
    assert chi < 3 * len(law)


def test_shuffle_is_uniform(spark):
    counts = np.zeros((12, 4))
    for seed in range(40):
        rows = shards.read_shards(df := spark.range(12).select(F.col("id").alias("doc_id")).coalesce(3), shards.write_shards(df, 4, seed)).collect()
        for r in rows:
            counts[r["doc_id"], r["shard"]] += 1
    assert ((counts - 10) ** 2 / 10).sum() < 80  # 33 degrees of freedom


def test_shard_columns_match_the_texts(spark, odd):
    texts = Counter((r["doc_id"], len((r["text"] or "").encode()) + 1, zlib.crc32((r["text"] or "").encode())) for r in odd.collect())
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in shards.shard_report(odd).collect()) == texts


def test_count_query_agrees_with_the_library(spark, docs):
    from quarrystone.llm.encoding import tokenizer

    own = tokenizer(tokenizer_path("word_bpe_49k.json"))
    for r in queries()["op8_token_counts"](spark, SF).collect():
        n = len(own.encode(docs[r["doc_id"]], add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"], r["over_limit"]) == (len(docs[r["doc_id"]].encode()), n, n > 2048)


def test_ledger_is_written_and_read(spark, odd):
    path = rules.write_ledger(odd)
    book, cut = (spark.read.parquet(f"{path}/{t}") for t in ("ledger", "ablation-v1"))
    assert "text" not in book.columns and book.count() == len(ODD) + 1
    for r in cut.collect():
        own = [x["failed"] & rules.POLICIES["v1"] for x in book.collect()]
        expected = (sum(bool(f & r["bit"]) for f in own), sum(f == r["bit"] for f in own), sum(not f & ~r["bit"] for f in own))
        assert (r["failing"], r["failing_alone"], r["kept_without"]) == expected


def test_long_units_follow_the_lattice(monkeypatch):
    """One way of filtering and sampling long units, whatever the stretches; pieces across place 64 come at their exact rate."""
    path = tokenizer_path("piece_bpe_32k.model")
    model = pieces.Lattices(path, 2.0)
    word = "thener" * 12
    whole = [model.sample([word], np.array([i], np.uint64))[0].tolist() for i in range(20)]
    monkeypatch.setattr(pieces, "STRETCH", 17)
    assert whole == [model.sample([word], np.array([i], np.uint64))[0].tolist() for i in range(20)]
    monkeypatch.setattr(pieces, "UNIT", 90)
    assert whole == [pieces.Lattices(path, 2.0).sample([word], np.array([i], np.uint64))[0].tolist() for i in range(20)]
    assert all(model.decode(x) == word.encode() for x in whole)
    monkeypatch.setattr(pieces, "UNIT", 3)
    ways = Counter(tuple(model.sample(["thener"], np.array([i * 7919], np.uint64))[0].tolist()) for i in range(4000))
    monkeypatch.setattr(pieces, "UNIT", 64)
    short = Counter(tuple(x.tolist()) for x in pieces.Lattices(path, 2.0).sample(["thener"] * 4000, np.arange(4000, dtype=np.uint64) * np.uint64(7919)))
    assert ways == short


def test_many_words_and_long_runs_in_bounded_blocks(monkeypatch):
    monkeypatch.setattr(pieces, "BATCH", 100)
    model = pieces.Lattices(tokenizer_path("piece_bpe_32k.model"), 2.0)
    texts = [" ".join(f"w{i}x" for i in range(500)), "", "漢字" * 300 + " end", "a" * 99 + "  " + "é\U0001f600" * 80]
    assert [model.decode(x) for x in model.sample(texts, np.arange(4, dtype=np.uint64))] == [t.encode() for t in texts]


def test_pieces_beside_clashing_columns(spark):
    path = tokenizer_path("piece_bpe_32k.model")
    df = spark.createDataFrame([(1, "some text", "x", 3, "y")], "doc_id long, text string, pieces string, c0 int, decoded string")
    r = pieces.decode(pieces.encode(df, path), path).first()
    assert (r["decoded"], r["c0"], r["doc_id"]) == ("some text", 3, 1)


def test_long_conversations(spark):
    """Time and memory go with the turns, not their square."""
    rows = spark.range(100_000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("turn é "), F.col("id")).alias("text"))
    from time import perf_counter

    began = perf_counter()
    r = chat.chat_digests(rows).first()
    took = perf_counter() - began
    loss = "".join(f"turn é {i}" for i in range(100_000) if i % 3)
    assert (r["n_turns"], r["loss_sha256"]) == (100_000, hashlib.sha256(loss.encode()).hexdigest())
    assert r["turns_sha256"] == hashlib.sha256("".join(f"{'assistant' if i % 3 else 'user'}\nturn é {i}\n" for i in range(100_000)).encode()).hexdigest()
    assert took < 30


def test_stages_take_clashing_columns_and_odd_rows(spark):
    rows = [(i, t, "en", "s", len(t or ""), 1.5, "e", 2, 3, 4, "x") for i, t in enumerate([None, "", "same text of six words here", "same text of six words here", "mail me at a@b.co now please", "a b"])]
    names = ["doc_id", "text", "lang", "source", "n_chars", "score", "evidence", "_row", "row", "shard", "_spans"]
    df = spark.createDataFrame(rows, names)
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    bench = spark.createDataFrame([(1, "not there at all in any of them")], "item_id long, text string")
    calm = toxicity.drop_toxic(df, labels)
    apart = jaccard.drop_similar(df)
    clean = decontaminate.drop_leaks(df, bench)
    masked = pii.redact(df)
    assert (calm.columns, apart.columns, clean.columns, masked.columns) == (names,) * 4
    assert (calm.count(), apart.count(), clean.count()) == (6, 5, 6)
    assert {r["doc_id"]: r["text"] for r in masked.collect()}[4] == "mail me at <EMAIL> now please"
    assert pii.redact(df.limit(0)).count() == toxicity.drop_toxic(df.limit(0), labels).count() == decontaminate.drop_leaks(df, bench.limit(0)).count() - 6 == 0


def test_evidence_only_raises_scores():
    curve = toxicity._logistic(np.array([[0.0, 1, 2], [1, 0, 1], [0.5, 1, 0], [2, 0, 1]] * 5), np.array([0.0, 1, 0, 1] * 5))
    assert min(curve[:3]) >= 0
    machine = toxicity.train_words(["stone", "water", "there", "listen", "garden", "river", "evening"], ["idiot", "moron"])
    machine.curve = (1.0, 1.0, 1.0, 3.0)
    scorer = toxicity.Scorer(machine)
    score = lambda t: machine.score(scorer.texts([t]))[0]
    clean = b"the garden near the river in the evening there"
    assert all(score(clean + extra) > score(clean) for extra in (b" idiot", b" idxiot", b" i d i o t"))


def test_scores_agree_with_the_kernel():
    """A word's value, from folded weights, is the machine's weighted sum of kernels with the landmarks."""
    good, bad = ["stone", "water", "there", "listen"], ["idiot", "moron"]
    machine = toxicity.train_words(good, bad)
    words = ["idiot", "idxiot", "waters", "stony"]
    marks = bad + good
    gram = toxicity.kernel(marks, marks).astype(float)
    values, vectors = np.linalg.eigh(gram)
    root = vectors / np.sqrt(values)
    x, y = toxicity.kernel(words + marks, marks).astype(float) @ root, np.array([1.0, 1, -1, -1, -1, -1])
    w = toxicity._svm(x[4:], y, np.where(y > 0, 2**0.5, 1.0))
    assert machine.words(words) == pytest.approx(x[:4] @ w[:-1] + w[-1], abs=1e-3)


def test_slices_give_memory_back(monkeypatch):
    import pyarrow as pa

    from quarrystone.llm import common

    given = []
    monkeypatch.setattr(common, "give_back", lambda: given.append(1), raising=False)
    batches = [pa.RecordBatch.from_arrays([pa.array(["abc"] * 5)], names=["text"])] * 3
    assert sum(len(texts) for _, texts in common.slices(iter(batches), budget=6)) == 15 and given == [1]
    monkeypatch.undo()
    common.give_back()


def test_counts_cut_little_text_at_once(monkeypatch):
    import pyarrow as pa

    sizes = []
    own = type("Own", (), {"count": staticmethod(lambda texts: sizes.append(sum(map(len, texts))) or [7] * len(texts))})
    monkeypatch.setattr(counts, "piece_counts", lambda path: own)
    batch = pa.RecordBatch.from_arrays([pa.array([str(i).encode() for i in range(3000)]), pa.array(["x" * 2000] * 3000)], names=["digest", "text"])
    found = [*counts._count("p", "v")(iter([batch]))]
    assert sum(b.num_rows for b in found) == 3000 and sum(sizes) == 6_000_000 and max(sizes) <= 1 << 20


def test_counts_that_start_anew_are_the_same(monkeypatch, docs):
    from quarrystone.llm import encoding

    texts = [t for t in docs.values()][:60]
    whole = PieceCounts(tokenizer_path("word_bpe_49k.json")).count(texts)
    monkeypatch.setattr(encoding, "MEMO_COUNTS", 50, raising=False)
    small, most = PieceCounts(tokenizer_path("word_bpe_49k.json")), max(len(set(t.split(" "))) for t in texts)
    for text, n in zip(texts, whole, strict=True):
        assert small.count([text]) == [n] and len(small.numbers) <= 50 + most


def test_long_words_in_bounded_memory():
    import tracemalloc

    machine = toxicity.train_words(["stone", "water"], ["idiot"])
    tracemalloc.start()
    toxicity.Scorer(machine).texts([b"ab" * 500_000])
    assert tracemalloc.get_traced_memory()[1] < 200 << 20
    tracemalloc.stop()


def test_a_shared_folder_is_asked_for(spark, monkeypatch):
    from quarrystone.llm import common

    class Far:
        master = "spark://somewhere"

    class Session:
        conf = type("C", (), {"get": staticmethod(lambda key, default=None: default)})
        sparkContext = Far

    with pytest.raises(ValueError):
        common.shared_path(Session, "x")
