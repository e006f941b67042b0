"""Classifiers by held-out accuracy, and the pipeline against its own operators."""

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quern.llm import langid, quality, toxicity
from quern.llm.queries import oracle_sql, queries

SF = "/root/testdata/sf0.01"
BIG = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    return langid.fit(langid.training_rows(docs, F.lit(True)), docs, per_label=100)


def test_language_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    got = queries()["op2_language_id"](spark, SF).join(docs.select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in got if r.held_out]
    assert len(got) == docs.count() and len(held) > 100
    assert sum(r.lang == r.lang_pred for r in held) >= 0.97 * len(held)
    assert sum(r.rejected for r in got) <= 0.01 * len(got)


def test_language_of_odd_texts(spark, languages):
    texts = [None, "", "123 !!", "Привет, как дела, друзья мои", "zzqx kkvj wwxq", "the " * 5000]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.language for r in langid.identify(df, languages).orderBy("doc_id").collect()]
    assert [g.lang for g in got[:3]] == ["und"] * 3 and all(g.rejected for g in got[:4])
    assert got[5].lang == "en" and not got[5].rejected
    assert all(0 <= g.score <= 1 for g in got)


def test_no_labels(spark):
    docs = spark.createDataFrame([(1, "a b", None), (2, None, "en")], "doc_id long, text string, lang string")
    m = langid.fit(langid.training_rows(docs, F.lit(True)), docs)
    assert [r.language.lang for r in langid.identify(docs, m).collect()] == ["und", "und"]
    none = spark.createDataFrame([], "doc_id long, quality int")
    assert all(0 <= r.quality_score <= 1 for r in quality.rank(docs, quality.fit(none, docs)).collect())
    assert all(0 <= r.toxicity <= 1 for r in toxicity.judge(docs, toxicity.fit(none, docs)).collect())


@pytest.mark.parametrize("name,label,good", [("op9_quality", "quality", 0.97), ("op7_toxicity", "toxic", 0.97)])
def test_held_out_accuracy(spark, name, label, good):
    labels = spark.read.parquet(f"{BIG}/labels.parquet")
    got = queries()[name](spark, BIG)
    held = got.join(labels, "doc_id").filter("held_out").select(F.col(label).alias("y"), "predicted", "score").collect()
    assert sum(r.y == r.predicted for r in held) >= good * len(held)
    assert all(0 <= r.score <= 1 for r in held)
    if name == "op7_toxicity":
        bad = [r for r in held if r.y == 1]
        assert sum(r.predicted for r in bad) >= 0.85 * len(bad)
        assert sum(r.predicted for r in held if r.y == 0) <= 0.01 * len(held)


def test_automaton_against_edit_distance():
    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            row, last = [i], row
            for j, y in enumerate(b, 1):
                row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
        return row[-1]

    words, stems = ["idiot", "moron", "morons", "scum"], ["lowei"]
    a = toxicity.Automaton(words, stems)
    import random

    r = random.Random(1)
    probes = [*words, "loweixyz", "lowe", "scam", "mor"]
    for w in words * 30:
        w = list(w)
        for _ in range(r.randrange(3)):
            k = r.randrange(len(w) + 1)
            w[k : k + r.randrange(2)] = r.choice(["", "x", "o", "s"])
        probes.append("".join(w))
    for p in probes:
        near = min([distance(p, w) if len(w) >= toxicity.FUZZY else (0 if p == w else 9) for w in words] + [0 if p.startswith(s) else 9 for s in stems])
        assert a.run(p) == (near if near <= 1 else None), p


def test_quotation_counts_less():
    m = toxicity.ToxicityModel({"idiot": 5.0}, {})
    m.weights[5] = -1.0
    free, quoted = m.score(["you are an idiot today"])[0], m.score(['he wrote "you are an idiot" in court'])[0]
    assert free > 0.5 > quoted
    assert m.score(["you are an idi0t"])[0] > m.score(["you are fine"])[0]


def test_queries_have_names_and_sql():
    q = queries()
    assert {k.split("_")[0] for k in q} == {f"op{n}" for n in range(1, 11)}
    assert set(oracle_sql()) <= set(q)


def test_pipeline(spark, tmp_path):
    docs = spark.read.parquet(f"{SF}/documents.parquet").filter("doc_id < 120")
    extra = spark.createDataFrame([(9001, "12 34", "en", "x", 5), (9002, None, "en", "x", None), (9003, docs.filter("doc_id = 5").first().text, "en", "x", 1), (9003, docs.filter("doc_id = 5").first().text, "en", "x", 1)], docs.schema)
    now, kept = docs.union(extra), {}
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, now, SF)
        assert out.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
        out.write.parquet(f"{tmp_path}/{name}")
        now = spark.read.parquet(f"{tmp_path}/{name}")
        kept[name] = {r.doc_id for r in now.select("doc_id").collect()}
    assert not {9001, 9002} & kept["language_id"] and len(kept["language_id"]) == 121
    assert 9003 not in kept["near_duplicates"] and 5 in kept["near_duplicates"]
    assert kept["substring_dedup"] == kept["near_duplicates"]
    assert kept["sentencepiece"] == kept["decontamination"] <= kept["substring_dedup"]
    assert now.filter("piece_ids is null").count() == 0


def test_pipeline_near_copies_on_both_sides(spark):
    """Five words and 0.8: a block of 22 words more is 96 / 118 = 0.81 there, 25 single changes in 1000 words are 0.78."""
    words = [f"w{i}" for i in range(1000)]
    spread = [f"x{i}" if i % 40 == 20 else w for i, w in enumerate(words)]
    block = [f"y{i}" for i in range(122)]
    edge = [f"z{i}" for i in range(125)]
    texts = [words, spread, block[:100], block, edge[:100], edge]  # 96 / 121 = 0.79 is below
    df = spark.createDataFrame([(i, " ".join(t), "en", "x", len(" ".join(t))) for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    assert {r.doc_id for r in corpus_pipeline.near_duplicates(spark, df, SF).collect()} == {0, 1, 2, 4, 5}


def test_apostrophes_are_no_quotations():
    q = toxicity.quotations
    assert q("they don’t and can’t and 'so'") == [] and q("the dogs’ food isn't") == []
    assert q('a "b" c “d” e „f“ g «h» i ‘j’') == [(2, 4), (8, 10), (14, 16), (20, 22), (26, 28)]
    assert q("“open") == [] and q("»x«") == [(0, 2)]
    m = toxicity.ToxicityModel({"idiot": 5.0}, {})
    typed, plain = m.score(["you don’t see what an idiot you can’t be"])[0], m.score(["you don't see what an idiot you can't be"])[0]
    assert typed == plain > 0.5 > m.score(["they said “you are an idiot” and left"])[0]


def test_misspelled_terms_carry_their_odds():
    m = toxicity.ToxicityModel({"worthless": 4.0, "scum": 5.0}, {"wort": 2.0})
    assert m.known_as("worthless") == (0, 4.0) and m.known_as("scun") is None
    assert toxicity.ToxicityModel({"worthless": 4.0}, {}).known_as("worthlss") == (1, 4.0 - toxicity.COST)
    text = "such a worthless thing"
    m = toxicity.ToxicityModel({"worthless": 4.0}, {})
    assert m.misspelled(text) != text and m.score([m.misspelled(text)])[0] > m.score(["such a fine thing"])[0]
    assert toxicity.ToxicityModel({"worthless": 4.0}, {}, loose={}).known_as("worthlss") is None


def test_held_out_toxic_texts_with_misspelled_terms(spark):
    """Fitted weights: one letter of each term changed in the held-out toxic texts of the largest table."""
    from quern.llm.labelled import remainder

    docs, labels = spark.read.parquet(f"{BIG}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{BIG}/labels.parquet").select("doc_id", "toxic").dropna()
    fold = remainder("doc_id", 5)
    m = toxicity.fit(labels.filter(fold != 0), docs)
    assert (m.weights[[0, 1, 2, 3, 6, 7, 9]] >= 0).all() and m.weights[5] <= 0
    held = docs.join(labels.filter(fold == 0), "doc_id").dropna().collect()
    bad, fine = [r.text for r in held if r.toxic == 1], [r.text for r in held if r.toxic == 0]
    caught, wrong = (m.score(bad) >= 0.5).mean(), (m.score(fine) >= 0.5).mean()
    assert caught >= 0.9 and wrong <= 0.02 and (m.score([m.misspelled(t) for t in bad]) >= 0.5).mean() >= 0.75
