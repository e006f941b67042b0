import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from quern.functions import chunking, dates, text
from quern.operators import extract, fulltext, hierarchy, mutate, patterns, sequence, similarity, vector
from quern.operators.components import connected_components
from quern.schema import violations
from quern.sources import html


def rows(df):
    return sorted(tuple(r) for r in df.collect())


@pytest.mark.parametrize("seed", [0, 1, 2])
def test_components_against_union_find(spark, seed):
    r = random.Random(seed)
    n = 60
    edges = [(i, i + 1) for i in range(n - 1)] if seed == 2 else [(r.randrange(n), r.randrange(n)) for _ in range(35)]
    r.shuffle(edges)
    up = list(range(n))

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = dict(rows(connected_components(spark.createDataFrame([*edges, *edges[:3]], "src long, dst long"))))
    assert got == {x: root(x) for e in edges for x in e}


def test_components_of_nothing(spark):
    assert connected_components(spark.createDataFrame([], "src long, dst long")).count() == 0
    assert rows(connected_components(spark.createDataFrame([(3, 3), (None, 1)], "src long, dst long"))) == [(3, 3)]


def test_sequence_and_neighbours(spark):
    c = spark.createDataFrame([(f"c{i}", dt.date(2000, 1, 1 + i // 2)) for i in range(9)], "chunk_id string, date date")
    s = sequence.with_sequence(c.repartition(3), [F.col("date"), F.col("chunk_id")])
    assert [r.sequence for r in s.orderBy("chunk_id").collect()] == list(range(9))
    assert sequence.next_edges(s).count() == 8
    a = s.filter("chunk_id = 'c1'").select(F.col("chunk_id").alias("anchor"), "sequence")
    assert [r.chunk_id for r in sequence.preceding(s, a, 5).collect()] == ["c0"]
    assert sequence.around(s, a, 3, 3).count() == 5
    assert sequence.around(s, a, 3, 3, zero=False).count() == 4


def test_optional_keeps_rows_and_filters_the_pattern(spark):
    a = spark.createDataFrame([(1,), (2,)], "k int")
    b = spark.createDataFrame([(1, True), (2, False)], "k int, ok boolean")
    assert rows(patterns.optional(a, b, "k", F.col("ok")))[0] == (1, True)
    assert patterns.optional(a, b, "k", F.col("ok")).count() == 2


def test_dates_between_anchor(spark):
    e = spark.createDataFrame([(1, dt.date(2000, 1, 1)), (2, dt.date(2000, 3, 1)), (3, None)], "dst long, date date")
    one = spark.createDataFrame([(dt.date(2000, 3, 1),)], "d date")
    assert rows(patterns.dated(e, one, upper="d").select("dst")) == [(1,)]
    assert rows(patterns.dated(e, one, lower="d - INTERVAL 2 MONTH", upper="d", strict=False).select("dst")) == [(1,), (2,)]
    assert patterns.dated(e, one.limit(0), upper="d").count() == 0


def test_closure_and_chain(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d")], "child string, parent string")
    want = [("a", "b", 1), ("a", "c", 2), ("a", "d", 3), ("b", "c", 1), ("b", "d", 2), ("c", "d", 1)]
    assert rows(hierarchy.closure(p)) == want
    assert rows(hierarchy.closure_recursive(p)) == want
    x = spark.createDataFrame([(1, "F", None, "g")], "k int, f string, o string, g string")
    c = hierarchy.rank_chain([("family", F.col("f")), ("order", F.col("o")), ("genus", F.col("g"))])
    assert set(rows(hierarchy.chain_edges(x, "k", c).na.fill("-"))) == {(1, "family", "F", "-", "-"), (1, "genus", "g", "family", "F")}


def test_queries_of_whole_tables(spark):
    """Orders beyond 200, parts beyond 50, customers of any name, documents of any language, against plain Python."""
    from quern.plans import catalogue

    sf = "/root/testdata/sf0.001"
    t = {n: [r.asDict() for r in spark.read.parquet(f"{sf}/{n}.parquet").collect()] for n in ("customer", "nation", "region", "orders", "lineitem", "part", "documents")}
    q = {n: catalogue.QUERIES[n](spark, sf) for n in ("closure_recursive", "chunk_entities", "rank_chain_gaps", "document_chunks")}
    nation = {n["n_nationkey"]: n for n in t["nation"]}
    region = {r["r_regionkey"]: r["r_name"] for r in t["region"]}
    want = [(n["n_name"], region[n["n_regionkey"]], 1) for n in t["nation"]]
    for c in t["customer"]:
        n = nation[c["c_nationkey"]]
        want += [(c["c_name"], n["n_name"], 1), (c["c_name"], region[n["n_regionkey"]], 2)]
    assert rows(q["closure_recursive"]) == sorted(want)
    part = {p["p_partkey"]: p for p in t["part"]}
    named = {o["o_orderkey"]: set() for o in t["orders"]}
    for li in t["lineitem"]:
        if li["l_partkey"] % 2 == 0 and li["l_partkey"] in part and li["l_orderkey"] in named:
            named[li["l_orderkey"]].add(f"Part:{part[li['l_partkey']]['p_name']}")
    assert rows(q["chunk_entities"]) == sorted((k, ",".join(sorted(v))) for k, v in named.items())
    links = set()
    for k, p in part.items():
        chain = [("type", p["p_type"]), *([("brand", p["p_brand"])] if k % 3 else []), ("name", p["p_name"])]
        links |= {(k, *x, *up) for x, up in zip(chain, [(None, None), *chain], strict=False)}
    assert {tuple(r) for r in q["rank_chain_gaps"].collect()} == links and q["rank_chain_gaps"].count() == len(links)
    # each document with a text gives segments from 0 on, whatever its language
    got = q["document_chunks"].groupBy("author").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens")).collect()
    want = chunking.chunks_of(spark.createDataFrame([(d["doc_id"], d["source"], None, d["text"]) for d in t["documents"]], "entry_no long, author string, date date, body string"), 200, r"\n", "\n")
    assert {tuple(r) for r in got} == {tuple(r) for r in want.groupBy("author").agg(F.count("*"), F.sum("token_count")).collect()}
    assert len({d["lang"] for d in t["documents"]}) > 1


def test_wide_closure(spark):
    p = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "d"), ("x", "c"), ("x", "a"), ("y", None)], "child string, parent string")
    assert rows(hierarchy.closure(p)) == rows(hierarchy.closure(p))


def test_vectors(spark):
    v = spark.createDataFrame([(1, [1.0, 0.0], 0), (2, [1.0, 1.0], 0), (3, [0.0, 0.0], 1), (4, [1.0, 0.0], 1)], "vec_id long, embedding array<float>, label int")
    assert [(r.vec_id, r.score) for r in vector.top_k(v, [2.0, 0.0], 9).collect()] == [(1, 1.0), (4, 1.0), (2, 0.707107)]
    assert {r.vec_id for r in vector.top_per_label(v, [1.0, 0.0]).collect()} == {1, 4}
    assert vector.top_per_label(v, [1.0, 0.0], keep=F.col("vec_id") == 2).count() == 0


def test_fulltext(spark):
    d = spark.createDataFrame([(1, "red fox"), (2, "red red hen"), (3, None)], "id long, t string")
    got = fulltext.search(fulltext.index(d, "id", F.col("t")), "Fox!", fulltext.corpus_size(d, F.col("t")), 5).collect()
    assert [r.id for r in got] == [1]
    assert fulltext.search(fulltext.index(d, "id", F.col("t")), "", fulltext.corpus_size(d, F.col("t"))).count() == 0


def test_fulltext_any_script_and_stored(spark, tmp_path):
    d = spark.createDataFrame([(1, "Lange Straße"), (2, "Большой дом"), (3, "stra e"), (4, "東京 タワー"), (5, "हिन्दी भाषा"), (6, "")], "id long, t string")
    fulltext.store(d, "id", F.col("t"), str(tmp_path))
    for query, want in (("STRAßE", [1]), ("ДОМ", [2]), ("stra", [3]), ("タワー", [4]), ("हिन्दी", [5]), ("nothing", [])):
        postings, size = fulltext.stored(spark, str(tmp_path))
        stored = fulltext.search(postings, query, size).collect()
        assert [r.id for r in stored] == want
        assert stored == fulltext.search(fulltext.index(d, "id", F.col("t")), query, fulltext.corpus_size(d, F.col("t"))).collect()


def test_jaro_winkler_against_duckdb():
    import duckdb

    r = random.Random(4)
    words = ["".join(r.choice("abcde") for _ in range(r.randrange(1, 9))) for _ in range(60)]
    for a, b in zip(words, words[30:], strict=False):
        want = duckdb.execute("select jaro_winkler_similarity(?, ?)", [a, b]).fetchone()[0]
        assert similarity.jaro_winkler_of(a, b) == pytest.approx(want, abs=1e-9)


def test_sounds():
    assert similarity.sounds("Knight")[0] == "N"
    assert similarity.sounds("Philip")[0] == "F"
    assert similarity.sounds("Smith") == similarity.sounds("Smyth")
    assert similarity.sounds("") == ""


def test_name_candidates(spark):
    n = spark.createDataFrame([("P", "John Hopper"), ("P", "Captain John Hopper"), ("P", "Jon Hopper"), ("P", "Big White Chief"), ("P", "Big White"), ("Q", "John Hopper"), ("P", "")], "label string, name string")
    spelled = rows(similarity.spelling_candidates(n, 0.92, ["captain"]))
    assert ("P", "Captain John Hopper", "John Hopper") in spelled
    assert ("P", "John Hopper", "Jon Hopper") in spelled
    assert ("P", "Big White", "Big White Chief") in rows(similarity.containment_candidates(n))
    a = spark.createDataFrame([("P", "Ann", ["The Cook"]), ("P", "Bea", ["the cook"]), ("P", "Cid", ["ann"]), ("P", "Dan", None)], "label string, name string, aliases array<string>")
    assert rows(similarity.alias_candidates(a)) == [("P", "Ann", "Bea"), ("P", "Ann", "Cid")]


def test_node_similarity_against_numpy(spark):
    import numpy as np

    r = random.Random(1)
    w = np.zeros((8, 8))
    pairs = []
    for a in range(8):
        for b in range(a + 1, 8):
            if r.random() < 0.5:
                w[a, b] = w[b, a] = r.randrange(2, 6)
                pairs.append((a, b, int(w[a, b])))
    got = {(a, b): s for a, b, s in rows(similarity.node_similarity(spark.createDataFrame(pairs, "a long, b long, weight long"), 0.5, 10))}
    for a in range(8):
        for b in range(8):
            n = np.linalg.norm(w[a]) * np.linalg.norm(w[b])
            c = round(float(w[a] @ w[b] / n), 6) if n else 0
            if a != b and c >= 0.5:
                assert got[a, b] == pytest.approx(c, abs=2e-6)


def test_matched_characters_against_difflib():
    from difflib import SequenceMatcher

    r = random.Random(6)
    for _ in range(300):
        q, p = ("".join(r.choice("abc é") for _ in range(r.randrange(n))) for n in (30, 90))
        assert similarity.matched_characters(q, p) == sum(m.size for m in SequenceMatcher(None, q, p, autojunk=False).get_matching_blocks())


def test_quote_passages_against_brute_force(spark, tmp_path):
    """Items from 10 on, documents from 40 on, matches beyond character 200 and ids of unequal remainders."""
    from difflib import SequenceMatcher

    from quern.plans.q_text import quote_passages

    r = random.Random(8)
    words = lambda n: " ".join("".join(r.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    quotes = [(i, words(20)) for i in range(14)] + [(14, "Two words!"), (15, None), (16, "?!"), (17, words(9))]
    docs = [(i, words(60)) for i in range(50)] + [(50, None), (None, quotes[12][1]), (51, "")]
    docs += [(60 + i, f"{words(50)} {q.upper()}. {words(30)}") for i, q in quotes[:12:2]]
    docs += [(81, " ".join([words(80), *quotes[13][1].split()[:7], words(2), *quotes[13][1].split()[7:]])), (80, words(50) + " it is two, words"), (70, docs[-1][1])]
    spark.createDataFrame(quotes, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    norm = lambda t: " ".join("".join(c if c.isalnum() else " " for c in t.lower()).split())
    want = []
    for i, t in quotes:
        q = norm(t or "")
        n = min(5, len(q.split()))
        keys = [" ".join(q.split()[k : k + n]) for k in range(len(q.split()) - n + 1)] if q else []
        of = []
        for j, u in docs:
            p = norm(u or "")
            if j is not None and any(f" {k} " in f" {p} " for k in keys):
                of.append((sum(m.size for m in SequenceMatcher(None, q, p, autojunk=False).get_matching_blocks()) / len(q), -j))
        if of and max(of)[0] >= 0.25:
            want.append((i, -max(of)[1], round(max(of)[0], 6)))
    assert {i for i, _, _ in want} == {0, 2, 4, 6, 8, 10, 13, 14}
    assert rows(quote_passages(spark, str(tmp_path)).select("item_id", "doc_id", "score")) == want


def test_node_similarity_ranks_within_a_label(spark):
    """Two persons whose 12 nearest are places: the pair is among the ten best of its label alone, as in the reference's filter."""
    from quern.operators import resolve
    from quern.schema import GraphState

    # all meet node 100 in chunks of their own; each person also meets a node that nobody else does
    ids = [(i, "Place", f"Old Place {i}") for i in range(12)] + [(50, "Person", "Ann Reed"), (51, "Person", "Zoe Moss"), (100, "River", "R"), (101, "River", "S"), (102, "River", "T")]
    times = {**{(i, 100): 4 for i in range(12)}, (50, 100): 4, (50, 101): 3, (51, 100): 4, (51, 102): 3}
    m = [(n, f"{a}-{b}-{k}") for (a, b), count in times.items() for k in range(count) for n in (a, b)]
    mentions = spark.createDataFrame(m, "node_id long, chunk_id string")
    nodes = spark.createDataFrame([(i, lab, n.upper(), n, []) for i, lab, n in ids], "node_id long, label string, canonical_name string, name string, aliases array<string>")
    cosine = 16 / (5 * 5)  # norms over all neighbours; places are at 16 / (5 * 4)
    pairs = similarity.co_occurrence(mentions)
    plain = {(a, b) for a, b, _ in rows(similarity.node_similarity(pairs).select("a", "b", "similarity"))}
    assert len([1 for a, _ in plain if a == 50]) == 10 and not {(50, 51), (51, 50)} & plain
    got = {(a, b): s for a, b, s in rows(similarity.node_similarity(pairs, labels=nodes.filter("label = 'Person'")).select("a", "b", "similarity"))}
    assert got == {(50, 51): cosine, (51, 50): cosine}
    state = GraphState(nodes, None, mentions, None)
    assert ("Person", "Ann Reed", "Zoe Moss") in rows(resolve.candidates(state, ["Person"], [], []))


def test_merge(spark):
    n = spark.createDataFrame([(1, "P", "ANN", "Ann", ["A"]), (2, "P", "ANNE", "Anne", None), (3, "P", "BO", "Bo", [])], "node_id long, label string, canonical_name string, name string, aliases array<string>")
    remap = spark.createDataFrame([(2, 1)], "old_id long, new_id long")
    assert rows(mutate.merge_nodes(n, remap).select("node_id", "name", F.array_join("aliases", ","))) == [(1, "Ann", "A,Anne"), (3, "Bo", "")]
    e = spark.createDataFrame([(1, 2), (3, 3), (2, 3), (1, 3)], "src long, dst long")
    assert rows(mutate.remap_edges(e, remap)) == [(1, 3), (1, 3), (3, 3)]


def test_direction(spark):
    s = spark.createDataFrame([("OWNS", ["P"], ["T"])], "rel_type string, src_labels array<string>, dst_labels array<string>")
    e = spark.createDataFrame([(1, "OWNS", 2, ["P"], ["T"]), (3, "OWNS", 4, ["T"], ["P"]), (5, "OWNS", 6, ["X"], ["T"]), (7, "HAS", 8, ["P"], ["T"])], "src long, rel_type string, dst long, src_l array<string>, dst_l array<string>")
    once = mutate.check_direction(e, s)
    assert rows(once.select("src", "dst", "flipped")) == [(1, 2, False), (4, 3, True)]
    assert rows(mutate.check_direction(once.drop("flipped"), s).select("src", "dst", "flipped")) == [(1, 2, False), (4, 3, False)]


def test_upserts_and_mentions(spark):
    old, new = spark.createDataFrame([(1, "a")], "k long, v string"), spark.createDataFrame([(1, "b"), (2, "c"), (2, "d")], "k long, v string")
    assert rows(mutate.upsert_last(old, new, ["k"])) == [(1, "b"), (2, "d")]
    assert rows(mutate.upsert_first(old, new, ["k"], "v")) == [(1, "a"), (2, "c")]
    m = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y")], "node_id long, chunk_id string")
    r = spark.createDataFrame([(1, "x", 2)], "node_id long, chunk_id string, new_id long")
    assert rows(mutate.reroute_mentions(m, r)) == [(1, "y"), (2, "x")]
    assert violations(old.union(old), ["k"]).count() == 1


def test_three_valued_flags(spark):
    x = spark.createDataFrame([(True,), (False,), (None,)], "f boolean")
    assert x.filter("f = true").count() == 1
    assert x.filter(~F.col("f")).count() == 1
    assert x.filter(~F.coalesce("f", F.lit(False))).count() == 2
    b = spark.createDataFrame([("a", None), ("b", True), ("c", None)], "n string, c boolean")
    assert [r[0] for r in b.select(mutate.flagged(F.col("n"), ["a", "b"], ["b"], F.col("c"))).collect()] == [True, False, False]


def one(spark, c):
    return spark.range(1).select(c.alias("x")).first().x


def test_text_functions(spark):
    assert one(spark, text.title_after_nonletters(F.lit("MARIA'S RIVER"))) == "Maria'S River"
    assert one(spark, text.title_after_blanks(F.lit("MARIA'S RIVER"))) == "Maria's River"
    assert one(spark, text.display_species(F.lit("ANAS SP."))) == "Anas sp."
    assert one(spark, text.scientific_name(F.lit("ANAS SP."))) == "Anas"
    assert one(spark, text.scientific_name(F.lit("ursus ARCTOS"))) == "Ursus arctos"
    assert one(spark, text.distinct_ignoring_case(F.array(*map(F.lit, ["Ab", "aB", "x", "Cd", "own"])), [F.lit("OWN")])) == ["Ab", "Cd"]
    assert one(spark, text.describe(F.lit("n"), F.lit("c"), F.array(F.lit("a"), F.lit("b")))) == "n — c. Also known as: a, b"
    q, who = text.split_last_dash(F.lit("a — b — Mason"))
    assert (one(spark, q), one(spark, who)) == ("a — b", "Mason")
    assert one(spark, text.passage(F.lit(None).cast("string"), F.lit("1804-05-14").cast("date"), F.lit("t"))) == "1804-05-14\nt"
    assert one(spark, text.escaped_query(F.lit("a+b"))) == "a\\+b"


def test_dates(spark):
    assert one(spark, dates.strict_date(F.lit("May 14, 1804"))) == dt.date(1804, 5, 14)
    assert one(spark, dates.tolerant_date(F.lit("1-nov-1804"))) == dt.date(1804, 11, 1)
    assert one(spark, dates.tolerant_date(F.lit("soon"))) is None


def test_packing(spark):
    pack = lambda t, n: one(spark, chunking.pack_text(F.lit(t), n))
    assert pack("a b c\n\nd e f g\n\nh i j k l", 7) == ["a b c\n\nd e f g", "h i j k l"]
    assert pack("a b\n\nc d e. f g h. i\n\nj", 4) == ["a b", "c d e.", "f g h.", "i", "j"]
    assert pack("a b c d e f", 3) == ["a b c d e f"]
    assert pack("", 3) == [""]


def test_chunks_have_unique_ids(spark):
    e = spark.createDataFrame([(1, "x", None, "a b\n\nc d"), (2, None, None, "e"), (3, "y", None, None)], "entry_no long, author string, date date, body string")
    c = chunking.chunks_of(e, 2)
    assert [(r.sequence, r.text) for r in c.orderBy("sequence").collect()] == [(0, "a b"), (1, "c d"), (2, "e")]
    assert violations(c, ["chunk_id"]).count() == 0


def test_html(spark):
    page = "<p>lost</p><h2 class='toc x'>Contents</h2><script>var a='<p>no</p>'</script><H2>May &amp; June</H2><p>one<br>two<p class=toc>no</p><p></p><h2>Empty</h2><h2>Last</h2><p>three</p>"
    b = html.blocks(spark.createDataFrame([(1, page)], "page_id long, html string"), ("h2", "p"))
    e = html.entries(b, F.col("tag") == "h2", F.col("tag") == "p").orderBy("entry_no").collect()
    assert [(r.header, r.body) for r in e] == [("May & June", "one two"), ("Last", "three")]
    f = spark.createDataFrame([(1, 0, None), (1, 1, "a"), (1, 2, None)], "id int, pos int, date string")
    assert [r.date for r in html.filled_dates(f).orderBy("pos").collect()] == [None, "a", "a"]
    q = html.quotes(spark.createDataFrame([("x — Carter",), ("y",)], "text string")).collect()
    assert [(r.quote, r.diarist) for r in q] == [("x", "Carter"), ("y", "unknown")]


def test_person_rules_hold_for_persons_alone(spark):
    """Titles go and single words are refused for persons; other labels keep both."""
    from quern.operators import resolve
    from quern.schema import GraphState

    none = []
    n = spark.createDataFrame([(1, "Person", "Hopper", "HOPPER", none), (2, "Person", "Hoper", "HOPER", none), (3, "Place", "Rivertown", "RIVERTOWN", none), (4, "Place", "Rivertowne", "RIVERTOWNE", none), (5, "Person", "Captain Ann Lee", "CAPTAIN ANN LEE", none), (6, "Person", "Ann Lee", "ANN LEE", none), (7, "Place", "Captain Creek Bend", "CAPTAIN CREEK BEND", none), (8, "Place", "Creek Bend", "CREEK BEND", none)], "node_id long, label string, name string, canonical_name string, aliases array<string>")
    empty = spark.createDataFrame([], "node_id long, chunk_id long")
    got = rows(resolve.candidates(GraphState(n, None, empty, None), ["Person", "Place"], ["captain"], [], graph=False))
    assert ("Place", "Rivertown", "Rivertowne") in got and ("Person", "Ann Lee", "Captain Ann Lee") in got
    assert not any("Hopper" in g or "Hoper" in g for g in got)
    assert [t for t in rows(n.select("node_id", similarity.name_tokens(F.col("name"), ["captain"], F.col("label") == "Person").alias("t"))) if t[0] in (5, 7)] == [(5, ["ann", "lee"]), (7, ["captain", "creek", "bend"])]


def test_sound_codes_of_three_signs(spark):
    """Short codes pair with nothing, whatever the length of their words; names of any script have tokens."""
    n = spark.createDataFrame([("P", x) for x in ("cow", "key", "guy", "Ann Chabonah", "Bob Charbonneau", "Chabono")], "label string, name string")
    want = set()
    names = [r.name for r in n.collect()]
    for a in names:
        for b in names:
            x, y = similarity.sounds(a.split()[-1]), similarity.sounds(b.split()[-1])
            if a < b and min(len(x), len(y)) >= 3 and x[0] == y[0] and similarity.jaro_winkler_of(x, y) >= 0.85:
                want.add(("P", a, b))
    assert set(rows(similarity.sound_candidates(n))) == want and want
    u = spark.createDataFrame([("José Ñu",), ("Иван Грозный",), ("A.B. Smith",)], "name string")
    assert [r.t for r in u.select(similarity.name_tokens(F.col("name")).alias("t")).collect()] == [["josé", "ñu"], ["иван", "грозный"], ["ab", "smith"]]


def test_spelling_candidates_against_all_pairs(spark):
    import itertools

    r = random.Random(8)
    names = sorted({"".join(r.choice("abc ") for _ in range(r.randrange(1, 12))).strip() for _ in range(120)} - {""})
    plain = {x: " ".join(x.split()) for x in names}
    for cutoff in (0.8, 0.92):
        want = {("P", a, b) for a, b in itertools.combinations(names, 2) if plain[a][0] == plain[b][0] and similarity.jaro_winkler_of(plain[a], plain[b]) >= cutoff}
        assert set(rows(similarity.spelling_candidates(spark.createDataFrame([("P", x) for x in names], "label string, name string"), cutoff))) == want


def test_closure_of_any_depth_and_cycles(spark):
    chain = [(f"n{i:02}", f"n{i + 1:02}") for i in range(12)] + [("x", "y"), ("y", "x")]
    got = rows(hierarchy.closure(spark.createDataFrame(chain, "child string, parent string")))
    assert len(got) == 12 * 13 // 2 + 4 and ("n00", "n12", 12) in got and ("x", "x", 2) in got
    assert rows(hierarchy.closure(spark.createDataFrame(chain, "child string, parent string"), depth=2)) == [g for g in got if g[2] <= 2]


def test_aliases_of_persons_are_plausible(spark):
    n = spark.createDataFrame([(1, "Person", "Serjeant", "JOHN ORD"), (1, "Person", "Mr. Ord", "JOHN ORD"), (1, "Person", "Zed", "JOHN ORD"), (1, "Place", "Big Mud", "CLEAR CREEK"), (1, "Person", "The Cook", "ANN O'FALLON")], "chunk_id long, label string, name string, canonical_name string")
    lex = spark.createDataFrame([("the cook", "Ann O'Fallon")], "raw string, canonical string")
    got = {r.canonical_name: r.aliases for r in extract.node_upserts(n, ["serjeant", "mr"], lex).collect()}
    assert got == {"JOHN ORD": ["Mr. Ord"], "CLEAR CREEK": ["Big Mud"], "ANN O'FALLON": ["The Cook"]}


def test_character_references(spark):
    from quern.sources import html

    df = spark.createDataFrame([("a&mdash;b &#233;&#x4E2D;&#128512; &amp;#65; &#xD800; &#9999999; x & y",)], "h string")
    assert df.select(html.plain(F.col("h")).alias("t")).first().t == "a—b é中😀 &#65; &#xD800; &#9999999; x & y"


def test_tasks_grow_in_number_instead_of_size(spark, monkeypatch):
    """Tasks get a fixed number of rows: of joined edges, of mentions, and of the pairs that they make."""
    from quern.operators import spread
    from quern.plans import q_graph, q_text
    from quern.sources.tables import observed

    monkeypatch.setattr(spread, "ROWS", 300)
    sf = "/root/testdata/sf0.001"  # 6,000 lines
    assert observed(spark, sf).rdd.getNumPartitions() == 20
    assert q_text.edge_upserts(spark, sf).rdd.getNumPartitions() == 20
    kinds = q_graph.type_disjunction(spark, sf)
    assert "hashpartitioning(chunk_id" in (plan := kinds._jdf.queryExecution().toString()) and ", 20), REPARTITION_BY_NUM" in plan.replace("#", ""), plan
    r = random.Random(1)
    m = [(r.randrange(40), c) for c in range(700) for _ in range(r.randrange(10))] + [(None, 1), (1, None)]
    mentions = spark.createDataFrame(m, "node_id long, chunk_id long")
    got = similarity.co_occurrence(mentions)
    assert got.rdd.getNumPartitions() >= 5
    sets = {}
    for n, c in m:
        if n is not None and c is not None:
            sets.setdefault(c, set()).add(n)
    want = {}
    for s in sets.values():
        for a in s:
            for b in s:
                if a < b:
                    want[a, b] = want.get((a, b), 0) + 1
    assert rows(got) == sorted((a, b, w) for (a, b), w in want.items() if w >= 2)


def test_alias_pairs_are_made_once_without_a_shuffle(spark, monkeypatch):
    """Names that share several keys give one pair; blocks of a key meet each other; the pairs themselves are not dealt out anew."""
    monkeypatch.setattr(similarity, "BLOCK", 3)
    r = random.Random(2)
    data = [(r.choice("XY"), f"{r.choice('ab')}{r.randrange(25)}", [r.choice("abAB") + str(r.randrange(25)) if r.random() < 0.8 else None for _ in range(r.randrange(4))] if r.random() < 0.9 else None) for _ in range(120)]
    data += [("X", f"n{i}", ["One", "TWO"]) for i in range(20)] + [("X", None, ["one"]), (None, "n1", ["one"]), ("X", "A1", []), ("X", "a1", [])]
    df = spark.createDataFrame(data, "label string, name string, aliases array<string>")
    keys = {(lab, n, a.upper(), al) for lab, n, aliases in data if lab and n for a, al in [(n, False), *((x, True) for x in aliases or [] if x)]}
    want = sorted({(p[0], p[1], q[1]) for p in keys for q in keys if p[0] == q[0] and p[1] < q[1] and p[2] == q[2] and (p[3] or q[3])})
    found = similarity.alias_candidates(df)
    assert rows(found) == want
    top = found._jdf.queryExecution().optimizedPlan()
    assert "Join" in top.toString() and "Aggregate" not in top.toString().split("Join")[0]
