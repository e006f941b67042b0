"""Word-level operators against brute force."""

import hashlib
import random
import re

import pytest
from pyspark.sql import functions as F

from quern.llm import decontaminate, neardup, substring
from quern.llm.textscan import BLANK, NON_ALNUM, scan

BLANKS = re.compile(r"[^\x20\x09-\x0D]+")
ITEM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return t.translate({c: c + 32 for c in range(65, 91)})


def corpus(seed, n=60, vocab=12):
    """Texts with shared passages, copies, near copies, repeated words, odd blanks, empties and nulls."""
    r = random.Random(seed)
    word = lambda: r.choice(["the", "The", "é", "Straße", "a1", "x-y", "日本", *[f"w{i}" for i in range(vocab)]])
    shared = [[word() for _ in range(45)] for _ in range(3)]
    out = []
    for _ in range(n):
        w = [word() for _ in range(r.randrange(0, 90))]
        if r.random() < 0.4:
            at = r.randrange(len(w) + 1)
            w[at:at] = r.choice(shared)
        if out and r.random() < 0.3:
            w = BLANKS.findall(r.choice(out) or "")
            if w and r.random() < 0.7:
                w[r.randrange(len(w))] = word()
        out.append("".join(x + r.choice([" ", "\n", " \t", "  "]) for x in w))
    return [*out, None, "", " \n ", "was " * 80, "short one", "Short  one"]


def frame(spark, texts, extra=True):
    rows = [(i, t, "clash", 7) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, kept string, n_words int").repartition(3)


@pytest.mark.parametrize("table,pattern", [(BLANK, BLANKS), (NON_ALNUM, ITEM)])
def test_scan_finds_the_words(table, pattern):
    texts = corpus(1)
    s = scan([t.encode() if t is not None else None for t in texts], table, lower=table is NON_ALNUM)
    for i, t in enumerate(texts):
        got = [s.raw[s.start[w] : s.end[w]].decode() for w in range(s.first[i], s.first[i + 1])]
        assert got == pattern.findall(lower(t or "") if table is NON_ALNUM else t or "")
    h = s.hashes()
    names = [s.raw[a:b] for a, b in zip(s.start, s.end, strict=True)]
    assert len(set(zip(names, h.tolist(), strict=True))) == len(set(names)) == len(set(h.tolist()))


def brute_repeats(texts, width):
    words = [BLANKS.findall(t or "") for t in texts]
    n = {}
    for w in words:
        for i in range(len(w) - width + 1):
            n[tuple(w[i : i + width])] = n.get(tuple(w[i : i + width]), 0) + 1
    out = {}
    for d, w in enumerate(words):
        gone = {j for i in range(len(w) - width + 1) if n[tuple(w[i : i + width])] > 1 for j in range(i, i + width)}
        out[d] = (len(w), len(gone), " ".join(x for j, x in enumerate(w) if j not in gone))
    return out


@pytest.mark.parametrize("seed,width", [(1, 35), (2, 35), (3, 8)])
def test_repeats(spark, seed, width, monkeypatch):
    if seed == 2:
        monkeypatch.setattr(substring, "UNIT", 500)
        monkeypatch.setattr(substring, "LONGEST", 5)
    texts = corpus(seed)
    got = {r.doc_id: (r.r.n_words, r.r.n_removed, r.r.kept) for r in substring.remove_repeats(frame(spark, texts), width, out="r").collect()}
    assert got == brute_repeats(texts, width)


def test_repeats_of_repeated_rows_and_null_ids(spark):
    t = " ".join(f"a{i}" for i in range(40))
    df = spark.createDataFrame([(1, t), (1, t), (None, t + " z"), (None, "b " * 3), (2, None)], "doc_id long, text string")
    got = sorted((r.r.n_words, r.r.n_removed, r.r.kept) for r in substring.remove_repeats(df, out="r").collect())
    assert got == [(0, 0, ""), (3, 0, "b b b"), (40, 40, ""), (40, 40, ""), (41, 40, "z")]
    assert substring.remove_repeats(df.limit(0), out="text2").count() == 0


def test_common_seeds_rank_last():
    import numpy as np

    texts = [(" ".join(f"q{i}{j}" for j in range(40)) + " the common line of all texts " + " ".join(f"r{i}{j}" for j in range(40))).encode() for i in range(5)]
    s = scan(texts)
    line = scan([b"the common line of all"]).hashes()
    common = substring.runs(line, substring.SEED)
    assert (substring.seeds_of(s, common) >> np.uint64(63)).sum() == 5
    first, count, _ = substring.super_kmers(s, 35, common)
    assert count.sum() == sum(len(t.split()) - 34 for t in texts)


def brute_near(texts, ids):
    sets = {}
    for i, t in zip(ids, texts, strict=True):
        w = BLANKS.findall(lower(t or ""))
        sets[i] = {tuple(w[k : k + 3]) for k in range(len(w) - 2)} if len(w) > 2 else ({tuple(w)} if w else set())
    comp = {i: i for i in ids}

    def root(x):
        while comp[x] != x:
            x = comp[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
                x, y = root(a), root(b)
                comp[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), root(i), root(i) == i) for i in ids}


def near_texts(seed):
    """Copies with more and more words changed, so that links, chains and misses occur around one base."""
    r = random.Random(seed)
    base = [f"b{r.randrange(400)}" for _ in range(150)]
    out = []
    for _ in range(60):
        w = list(base)
        for _ in range(r.randrange(0, 9)):
            w[r.randrange(len(w))] = f"n{r.randrange(10**6)}"
        out.append(" ".join(w))
    return [*out, *corpus(seed, 40, 200)]


@pytest.mark.parametrize("seed", [3, 5])
def test_near_duplicates(spark, seed):
    texts = near_texts(seed)
    random.Random(seed).shuffle(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_near(texts, list(range(len(texts))))


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_that_differ_alike(spark, seed):
    """Changes at few places by few words, so that nodes far from the central one are near to each other or to its copies."""
    r = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    texts = []
    for _ in range(70):
        w = list(base)
        for at in r.sample(range(5, 150, 12), r.randrange(0, 9)):
            w[at] = f"n{r.randrange(2)}"
        texts.append(" ".join(w))
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in neardup.near_duplicates(frame(spark, texts)).collect()}
    assert got == brute_near(texts, list(range(len(texts))))


def test_strangers_in_a_bucket_of_copies_make_few_pairs(spark, monkeypatch):
    """Pairs of nodes of one component are not made, also not to be dropped by a join's condition."""
    tried, join = [], type(spark.range(1)).join

    def counting(self, other, on=None, how=None):
        if on is not None and not isinstance(on, (str, list)):  # the pairs within buckets; all other joins are on names
            by = ["top_id", "h"] if "h" in self.columns else ["key"]
            sizes = [x.groupBy(*(F.col(b) for b in by)).agg(F.count("*").alias(n)) for x, n in ((self, "a"), (other, "b"))]
            tried.append(join(*sizes, by).agg(F.coalesce(F.sum(F.col("a") * F.col("b")), F.lit(0))).first()[0])
        return join(self, other, on, how)

    monkeypatch.setattr(type(spark.range(1)), "join", counting)
    base = [f"b{i}" for i in range(150)]

    def text(changes):
        return " ".join(changes.get(i, w) for i, w in enumerate(base))

    copies = [text({(7 * i) % 149: f"c{i}"}) for i in range(120)]
    strangers = [text({20 * j + 10: f"s{j}" for j in range(6)} | {35 + 20 * i: f"t{i}"}) for i in range(3)]  # near to each other
    got = neardup.near_duplicates(frame(spark, [*copies, *strangers]))
    assert {(x.doc_id, x.component_id) for x in got.collect()} == {(i, 0 if i < 120 else 120) for i in range(123)}
    assert len(tried) == 1 and tried[0] < 5 * 123  # 123 ** 2 in each bucket that holds a stranger, if all pairs are made


def test_near_duplicates_of_repeated_and_null_ids(spark):
    a, b = " ".join(f"a{i}" for i in range(30)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(5, a), (5, b), (7, a), (9, b), (None, a), (11, None), (12, "")], "doc_id long, text string")
    got = {(r.doc_id, r.component_id, r.kept) for r in neardup.near_duplicates(df).collect()}
    assert got == {(5, 5, True), (7, 5, False), (9, 5, False), (None, None, True), (11, 11, True), (12, 12, True)}
    assert neardup.near_duplicates(df.limit(0)).count() == 0


def brute_hits(texts, items, width=10):
    windows = {}
    for i, t in items:
        w = ITEM.findall(lower(t or ""))
        for k in range(max(1, len(w) - width + 1)) if w else ():
            windows.setdefault(tuple(w[k : k + width]), set()).add(str(i))
    out = {}
    for d, t in enumerate(texts):
        w, hit, own = ITEM.findall(lower(t or "")), set(), set()
        for n in {len(x) for x in windows}:
            for k in range(len(w) - n + 1):
                if (x := tuple(w[k : k + n])) in windows:
                    hit.update(range(k, k + n))
                    own |= windows[x]
        out[d] = (len(w), len(hit), sorted(own), bool(hit))
    return out


@pytest.mark.parametrize("seed,part", [(1, 1 << 20), (2, 300)])
def test_decontamination(spark, seed, part, monkeypatch):
    monkeypatch.setattr(decontaminate, "LANE", 64)
    texts = corpus(seed)
    r = random.Random(seed)
    items = [(i, " ".join(ITEM.findall(t or "")[(k := r.randrange(30)) : k + r.randrange(4, 30)]).upper()) for i, t in enumerate(texts[:25])]
    items += [(100, None), (101, ""), (102, "..."), (103, "w1"), (104, "W1"), (9, items[3][1])]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.decontaminate(frame(spark, texts), bench, out="kept", shard_bytes=part)
    assert {x.doc_id: (x.kept.n_words, x.kept.n_hit, x.kept["items"], x.kept.contaminated) for x in got.collect()} == brute_hits(texts, items)


def test_decontamination_without_items_or_documents(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    none = spark.createDataFrame([], "item_id long, text string")
    r = {x.doc_id: (x.d.n_words, x.d.n_hit, x.d.contaminated) for x in decontaminate.decontaminate(docs, none, out="d").collect()}
    assert r == {1: (2, 0, False), 2: (0, 0, False)}
    assert decontaminate.decontaminate(docs.limit(0), none).count() == 0
    assert docs.select(F.sha2(F.array_join(F.array().cast("array<string>"), ","), 256)).first()[0] == hashlib.sha256(b"").hexdigest()


def test_ids_of_any_type_or_none(spark):
    """Texts of names and of nothing lose the same words as those of numbers; texts without an id are told apart."""
    passage = " ".join(f"p{i}" for i in range(40))
    texts = [f"{passage} tail{i}" if i % 2 else f"alone{i} " * 50 + f"end{i}" for i in range(12)]
    texts = [t if i % 2 else " ".join(f"s{i}x{j}" for j in range(60)) for i, t in enumerate(texts)]
    want = None
    for ids in (range(12), [f"doc-{i}" for i in range(12)], [None] * 12):
        df = spark.createDataFrame(list(zip(ids, texts, strict=True)), f"doc_id {'long' if ids == range(12) else 'string'}, text string")
        got = sorted((r.text, r.dedup.n_removed, r.dedup.kept) for r in substring.remove_repeats(df).collect())
        want = want or got
        assert got == want and sum(n for _, n, _ in got) == 6 * 40


def test_items_without_an_id_are_hit(spark):
    words = [f"w{i}" for i in range(12)]
    bench = spark.createDataFrame([(None, " ".join(words)), ("7", " ".join(words[:10]))], "item_id string, text string")
    docs = spark.createDataFrame([(1, "a " + " ".join(words) + " b")], "doc_id long, text string")
    r = decontaminate.decontaminate(docs, bench).first().decontamination
    assert (r.n_hit, r["items"], r.contaminated) == (12, ["7"], True)


def test_decontamination_by_parts_keeps_columns_and_copies(spark):
    """Columns of any name stay, copies of one text all get the hits of all parts, and the parts' tables are gone by then."""
    items = [(i, " ".join(f"i{i}w{j}" for j in range(12))) for i in range(6)]
    texts = [items[i % 6][1] + " and " + items[(i + 1) % 6][1] for i in range(6)] * 3 + ["clean text", None]
    docs = spark.createDataFrame([(i, t, i, i, i) for i, t in enumerate(texts)], "doc_id long, text string, _key int, _spans int, _part int")
    got = decontaminate.decontaminate(docs.repartition(3), spark.createDataFrame(items, "item_id long, text string"), shard_bytes=60)
    assert got.columns == [*docs.columns, "decontamination"]
    for r in got.collect():
        d = r.decontamination
        assert r._key == r._spans == r._part == r.doc_id
        assert (d.n_hit, d["items"]) == ((24, sorted({str(r.doc_id % 6), str((r.doc_id + 1) % 6)})) if r.doc_id < 18 else (0, []))


def test_a_cut_leaves_no_shuffle_files(spark):
    """Nor do the many steps of near-duplicate detection, which ran out of disk with them."""
    import time

    from quern.operators.lineage import cut

    def files():
        found = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString("\n").split("\n")
        return {f for f in found if "/shuffle_" in f and f.endswith(".data")}

    def left(before):
        for _ in range(50):  # files go in the background
            if not files() - before:
                break
            time.sleep(0.2)
        return files() - before

    setting = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    spark.conf.set(setting, "false")
    try:
        before = files()
        counted = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).agg(F.count("*").alias("n"))
        assert counted.count() == 7 and files() - before
        before = files()
        kept = cut(counted)
        assert not left(before) and sorted(x.n for x in kept.collect()) == [142] + [143] * 6 and counted.count() == 7
        assert spark.conf.get(setting) == "false"
    finally:
        spark.conf.unset(setting)
    before = files()
    docs = spark.createDataFrame([(i, " ".join(f"w{(i % 5) * 100 + j}" for j in range(40 + i // 5 % 2))) for i in range(40)], "doc_id long, text string")
    got = neardup.near_duplicates(docs)
    assert len(left(before)) < 40  # those of plain counts; the steps left none
    assert {(x.doc_id, x.component_id) for x in got.collect()} == {(i, i % 5) for i in range(40)}
