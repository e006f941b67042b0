"""Sharding, search, URL rules and pieces against brute force."""

import math
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.llm import pieces, sharding, topk, urlfilter
from quern.llm.q_pieces import MODEL


def test_shards(spark):
    r = random.Random(3)
    rows = [(i % 70 if i % 9 else None, r.choice([None, "", "é" * r.randrange(90), "x" * r.randrange(400)]), 5) for i in range(200)]
    rows += [(1, "same", 5)] * 60
    got = sharding.shard_by_bytes(spark.createDataFrame(rows, "doc_id long, text string, size int").repartition(5), 8).collect()
    size = lambda t: len((t or "").encode()) + 1
    assert sorted((x.doc_id or -1, x.size, x.text_crc32) for x in got) == sorted((i or -1, size(t), zlib.crc32((t or "").encode())) for i, t, _ in rows)
    by = {k: sorted((x.slot, x.doc_id if x.doc_id is not None else -1, x.size) for x in got if x.shard == k) for k in range(8)}
    total, most = sum(size(t) for _, t, _ in rows), max(size(t) for _, t, _ in rows)
    ids = []
    for k in range(8):
        assert [s for s, _, _ in by[k]] == list(range(len(by[k])))
        assert abs(sum(z for _, _, z in by[k]) - total / 8) <= most
        ids += [i for _, i, _ in by[k]]
    assert ids == sorted(ids)


def test_shards_of_little(spark):
    df = spark.createDataFrame([(1, None)], "doc_id long, text string")
    assert [(x.size, x.slot) for x in sharding.shard_by_bytes(df).collect()] == [(1, 0)]
    assert sharding.shard_by_bytes(df.limit(0)).count() == 0


@pytest.mark.parametrize("scale", [256, 1 << 20])
def test_top_k(spark, scale):
    r = np.random.default_rng(1)
    v = r.normal(size=(300, 16)).astype(np.float32)
    v[200:240] = v[100:140]
    v[0] = 0
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(300, None), (350, [1.0, None]), (400, [math.nan] * 16), (450, [math.inf] * 16), (500, [1.0, 2.0]), (501, [1.0, 3.0]), (550, []), (None, v[1].tolist()), (50, v[50].tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(4)
    got = {}
    for x in topk.top_k(df, F.col("vec_id") % 50 == 0, 5, scale).collect():
        got.setdefault(x.query_id, set()).add((x["rank"], x.vec_id, x.score))
    ok = [(i, [math.floor(scale * float(np.float32(y))) for y in x]) for i, x in rows if i is not None and x is not None and all(y is not None and math.isfinite(y) for y in x)]
    for i, q in ok:
        if i % 50 or i == 50:
            continue
        s = sorted(((sum(a * b for a, b in zip(q, c, strict=True)), -j) for j, c in ok if j != i and len(c) == len(q)), reverse=True)[:5]
        assert {(score, j) for _, j, score in got.get(i, set())} == {(a, -b) for a, b in s}
        assert [k for k, _, _ in sorted(got.get(i, set()))] == list(range(1, len(s) + 1))
    assert all(j != 50 for _, j, _ in got[50]) and len(got[50]) == 5


def test_search_stops_early_and_exactly():
    r = np.random.default_rng(2)
    c = np.floor(256 * r.normal(size=(2000, 8)) / 3).astype(np.int64)
    c[:20] *= 6
    q = c[5:9]
    a, w, s = topk.search_block(np.arange(5, 9), q, np.arange(2000), c, 5)
    full = q @ c.T
    for i in range(4):
        full[i, 5 + i] = -(10**9)
        assert sorted(s[a == i].tolist()) == sorted(full[i].tolist())[-5:]


RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]


def test_url_rules(spark):
    urls = ["http://A.Example.COM/en/7?x", "https://a.com/en/", "http://xcom/en/", "http://com/en/1", "http://example.net/de/81#a", "http://b.example.net/de/7", "ftp://o.org/es/?q", "no scheme/en/", None, "http://h.org", "a://b://c/d", "http://h.com?/en/", "http://u.com/EN/"]
    df = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    none = spark.createDataFrame([], "rule_id string, tokens array<string>, index_token string, confidence double, support bigint")
    got = {r.page_id: (r.j.host, r.j.path, r.j.rule, r.j.verdict) for r in urlfilter.judge(df, none, RULES, out="j").collect()}
    assert got[0] == ("a.example.com", "/en/7", "example.com/en/7", "allow")
    assert got[1] == ("a.com", "/en/", "com/en/", "block")
    assert got[2][2] is None and got[3][2] == "com/en/"
    assert got[4] == ("example.net", "/de/81", "example.net/de/8", "block")
    assert got[5][2:] == ("net/de/", "allow") and got[6][2:] == ("org/es/", "block")
    assert got[7] == ("", "", None, "allow") == got[8]
    assert got[9] == ("h.org", "", None, "allow") and got[10][:2] == ("b:", "//c/d") and got[11][:2] == ("h.com", "") and got[12][2] is None


def test_mined_rules(spark):
    rows = [(f"http://spam-farm.org/buy/{i}", True) for i in range(40)] + [(f"http://news.org/buy/{i}", False) for i in range(60)] + [(f"http://www.spam-farm.org/about/{i}", True) for i in range(30)]
    df = spark.createDataFrame(rows, "url string, bad boolean").select("url", "bad", urlfilter.tokens_of(F.col("url")).alias("tokens"))
    rules = urlfilter.mine(df)
    assert all("h:spam-farm" in r.tokens or "s:spam-farm.org" in r.tokens or "h:www" in r.tokens or "p:about" in r.tokens for r in rules.collect())
    probe = spark.createDataFrame([("http://x.spam-farm.org/new",), ("http://news.org/buy/1",), (None,), ("http://x.spam-farm.org/new",)], "url string")
    got = [(r.url, r.judged.verdict) for r in urlfilter.judge(probe, rules, []).collect()]
    assert sorted(map(str, got)) == sorted(map(str, [("http://x.spam-farm.org/new", "block")] * 2 + [("http://news.org/buy/1", "allow"), (None, "allow")]))
    assert urlfilter.mine(df.filter("not bad")).count() == 0 and urlfilter.mine(df.limit(0)).count() == 0


TEXTS = ["", " ", "  two  blanks ", "a\n b\tc", "Hello, world! It's 12345.", "cé漢字 😀 x", "»quoted«, he said.”", "x" * 300, "日本語のテキスト、漢字。" * 10, "ab▁c", "\x00\x01 \u0301e", "def f(x):\n    return  x", "word " * 200]


def test_pieces_equal_the_library(spark):
    import sentencepiece

    model = pieces.load(MODEL)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    df = spark.createDataFrame([*((i, t, 3) for i, t in enumerate(TEXTS)), (99, None, 1), (2, TEXTS[2], 3)], "doc_id long, text string, word int")
    out = pieces.decode(pieces.encode(df, model), model).collect()
    assert len(out) == len(TEXTS) + 2
    for r in out:
        if r.text is None:
            assert r.piece_ids is None and r.decoded is None
            continue
        assert r.piece_ids == sp.encode(r.text), r.text
        assert r.decoded == r.text.replace("▁", " ")
    assert pieces.encode(df.limit(0), model).count() == 0


def test_unigram_lattice(spark):
    r = random.Random(5)
    own = sorted({"".join(r.choice("ab▁") if j == 0 else r.choice("ab") for j in range(r.randrange(1, 5))) for _ in range(25)} | {"a"})
    model = pieces.PieceModel(["<unk>", *own], [0.0, *[-round(r.uniform(1, 9), 3) for _ in own]], [False, *[True] * len(own)], False, -1, 0, True)
    words = ["".join(r.choice("abc") for _ in range(r.randrange(1, 9))) for _ in range(40)]
    df = spark.createDataFrame([(0, w) for w in set(words)], "g int, word string")
    got = {x.word: x.ids for x in pieces.encode_words(df, model, ["g"]).collect()}

    def total(ids, w):
        return sum(model.scores[i] if i else min(model.scores) - 10 for i in ids)

    for w in set(words):
        assert total(got[w], w) == pytest.approx(total(model.encode_word(w), w))
        assert sum(len(model.pieces[i]) if i else 1 for i in got[w]) == len(w)


def test_long_stretches_without_blanks(spark):
    import sentencepiece

    model, sp, r = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(4)
    wide = "的一是不了在人有我他这中大来上国和说们为子日本語テキスト、。ーйцукенбю"
    texts = ["".join(r.choice(wide) for _ in range(20_000)), "".join(r.choice("abeinorst") for _ in range(20_000)), "a" * 20_000, "é漢" * 3_000, "-" * 500 + "=" * 500]
    df = spark.createDataFrame([(i, t, "clash", [1]) for i, t in enumerate([*texts, "", None, *texts])], "doc_id long, text string, word string, gids array<int>")
    out = pieces.encode(df, model, group_bytes=30_000).collect()
    assert len(out) == 2 * len(texts) + 2 and all(x.word == "clash" and x.gids == [1] for x in out)
    for x in out:
        assert x.piece_ids == (None if x.text is None else sp.encode(x.text))
    # most of a wide text is cut where no piece crosses, so that the lattice takes it
    import pyarrow as pa

    words = model.words_of(pa.array(texts[:1]))[0].to_pylist()
    assert "".join(words) == "▁" + texts[0] and max(map(len, words)) <= pieces.LONGEST


def test_a_unigram_model_equals_the_library(spark, tmp_path):
    """Pieces and scores are set here, none are trained."""
    import sentencepiece
    from sentencepiece import sentencepiece_model_pb2

    r = random.Random(6)
    m = sentencepiece_model_pb2.ModelProto()
    m.trainer_spec.model_type, m.trainer_spec.unk_id = m.trainer_spec.UNIGRAM, 0
    m.trainer_spec.bos_id = m.trainer_spec.eos_id = m.trainer_spec.pad_id = -1
    m.normalizer_spec.name, m.normalizer_spec.add_dummy_prefix, m.normalizer_spec.remove_extra_whitespaces = "identity", True, False
    own = sorted({"".join(r.choice("abcé") for _ in range(r.randrange(1, 6))) for _ in range(60)} | {"▁", "a", "b", "c", "▁a", "▁ab", "▁▁"})
    for p, score, kind in [("<unk>", 0.0, m.SentencePiece.UNKNOWN), *((p, -r.uniform(1, 9), m.SentencePiece.NORMAL) for p in own)]:
        m.pieces.add(piece=p, score=score, type=kind)
    path = tmp_path / "own.model"
    path.write_bytes(m.SerializeToString())
    model, sp = pieces.load(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    texts = [" ".join("".join(r.choice("abcé") for _ in range(r.randrange(1, 12))) for _ in range(r.randrange(1, 30))) for _ in range(40)] + ["zz ab", "  a  b ", "abcxyzabc", "ab" * 200]
    for x in pieces.encode(spark.createDataFrame([(t,) for t in texts], "text string"), model).collect():
        score = lambda ids: sum(m.pieces[i].score for i in ids)  # noqa: E731  equal scores may part a text in several ways
        want = sp.encode(x.text)
        assert x.piece_ids == want or score(x.piece_ids) == pytest.approx(score(want), abs=1e-3), x.text


def test_round_trip_of_the_query(spark, tmp_path):
    from quern.llm.q_pieces import op4_sentencepiece

    spark.createDataFrame([(i, t) for i, t in enumerate([*TEXTS, None])], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in op4_sentencepiece(spark, str(tmp_path)).collect()}
    assert len(got) == len(TEXTS) + 1 and got[len(TEXTS)].round_trip is None
    assert all(got[i].round_trip == ("▁" not in t) for i, t in enumerate(TEXTS))


def test_mining_against_counts_of_all_sets(spark):
    """Every set of tokens that is frequent, confident and beyond chance is covered by a mined rule; every rule counts right."""
    import itertools

    r = random.Random(11)
    rows = []
    for _ in range(400):
        t = [x for x in "abcdef" if r.random() < 0.4] + (["g"] if r.random() < 0.5 else [])
        t += ["twin"] if "a" in t else []
        bad = r.random() < (0.95 if {"a", "b"} <= set(t) else 0.85 if "c" in t and "d" in t else 0.1)
        rows.append((t, bad))
    got = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_rows=20, longest=3).collect()
    base, n = sum(b for t, b in rows if t) / sum(1 for t, _ in rows if t), sum(1 for t, _ in rows if t)
    count = lambda s: (sum(s <= set(t) for t, _ in rows), sum(b for t, b in rows if s <= set(t)))
    assert got
    for x in got:
        total, bad = count(set(x.tokens))
        assert (x.support, x.confidence) == (bad, pytest.approx(bad / total)) and bad >= 20 and x.index_token in x.tokens
        assert not any(set(y.tokens) < set(x.tokens) and y.confidence >= x.confidence for y in got)
    for k in (1, 2, 3):
        for s in map(set, itertools.combinations("abcdefg", k)):
            total, bad = count(s)
            if bad >= max(20, 0.002 * n) and bad / total >= 0.7 and bad - base * total >= 3 * math.sqrt(base * (1 - base) * total):
                assert any(set(x.tokens) <= s and x.confidence >= bad / total - 1e-12 for x in got), s


def test_matching_against_all_rules(spark):
    r = random.Random(12)
    urls = sorted({"http://" + ".".join(r.choice("xyz") for _ in range(2)) + "/" + "/".join(r.choice(["buy", "now", "a", "1"]) for _ in range(r.randrange(4))) for _ in range(80)})
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    tokens = {x.url: set(x.t) for x in df.select("url", urlfilter.tokens_of(F.col("url")).alias("t")).collect()}
    every = sorted(set().union(*tokens.values()))
    rules = [(" ".join(t), t, r.choice(t), r.random(), r.randrange(9)) for t in (sorted(r.sample(every, r.randrange(1, 4))) for _ in range(40))]
    table = spark.createDataFrame(rules, "rule_id string, tokens array<string>, index_token string, confidence double, support bigint")
    got = {x.url: x.mined for x in urlfilter.match(df, table).collect()}
    for u in urls:
        fits = [(c, s, i) for i, t, _, c, s in rules if set(t) <= tokens[u]]
        assert got.get(u) == (max(fits)[2] if fits else None)


def test_equal_and_nearly_equal_long_urls_end(spark):
    words = [f"w{i}x" for i in range(40)]
    rows = [(f"http://long.org/{'/'.join(words)}", True)] * 30 + [(f"http://near.org/{'/'.join(w for j, w in enumerate(words) if j != i % 40)}", True) for i in range(60)] + [(f"http://fine.org/a/{i}", False) for i in range(200)]
    df = spark.createDataFrame(rows, "url string, bad boolean").select("bad", urlfilter.tokens_of(F.col("url")).alias("tokens"))
    rules = urlfilter.mine(df)
    assert {x.verdict for x in urlfilter.judge(spark.createDataFrame([(rows[0][0],), (rows[31][0],)], "url string"), rules, []).select("judged.verdict").collect()} == {"block"}


def test_rules_hold_where_the_list_is_silent(spark):
    rows = [(["h:a", "p:x"], True, True)] * 60 + [(["h:a", "p:y"], i % 4 == 0, False) for i in range(40)] + [(["h:b"], False, False)] * 60
    df = spark.createDataFrame(rows, "tokens array<string>, bad boolean, decided boolean")
    assert sorted(tuple(x.tokens) for x in urlfilter.mine(df.drop("decided"), min_confidence=0.65).collect()) == [("h:a",), ("p:x",)]
    assert [tuple(x.tokens) for x in urlfilter.mine(df, min_confidence=0.65).collect()] in ([("p:x",)], [("h:a", "p:x"), ("p:x",)])


def test_all_tokens_of_long_urls_are_mined(spark):
    """Twenty and more tokens a URL: rules of two and three of those that say least by themselves are found, too, and count right."""
    import itertools

    r = random.Random(13)
    rows = []
    for _ in range(600):
        bad = r.random() < 0.4
        t = [f"t{i:02}" for i in range(18) if r.random() < (0.75 if bad else 0.55)]
        t += [x for x in "abcd" if r.random() < 0.5]
        rows.append((t, bad or {"a", "b", "c"} <= set(t)))
    assert sum(len(t) > 12 for t, _ in rows) > 200
    got = urlfilter.mine(spark.createDataFrame(rows, "tokens array<string>, bad boolean"), min_rows=30, longest=3).collect()
    base, n = sum(b for _, b in rows) / len(rows), len(rows)
    held = {x: sum(1 << i for i, (t, _) in enumerate(rows) if x in t) for x in sorted({x for t, _ in rows for x in t})}
    marked, want, best = sum(1 << i for i, (_, b) in enumerate(rows) if b), {}, {}
    for k in (1, 2, 3):
        for s in itertools.combinations(held, k):
            fits = held[s[0]]
            for x in s[1:]:
                fits &= held[x]
            total, bad = fits.bit_count(), (fits & marked).bit_count()
            beat = max((best.get(p, 0.0) for p in itertools.combinations(s, k - 1)), default=0.0)
            rule = bad >= 30 and bad / total >= 0.7 and bad - base * total >= 3 * math.sqrt(base * (1 - base) * total)
            if rule and bad / total > beat:
                want[s] = (bad, bad / total)
            best[s] = max(beat, bad / total if rule else 0.0)
    assert ("a", "b", "c") in want and len(want) > 20 and n == 600
    assert {tuple(x.tokens): (x.support, x.confidence) for x in got} == want
    assert all(x.index_token == min(x.tokens, key=lambda t: (held[t].bit_count(), t)) for x in got)


def test_a_group_is_encoded_in_little_memory(spark):
    """What is made meanwhile does not grow with the words or the texts of a group; ids, order and nulls stay."""
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa
    import sentencepiece

    model, sp, r = pieces.load(MODEL), sentencepiece.SentencePieceProcessor(model_file=MODEL), random.Random(7)
    vocabulary = ["".join(r.choice("abcdefghinorst") for _ in range(8)) for _ in range(50_000)]
    texts = [" ".join(vocabulary[i : i + 1000]) for i in range(0, 50_000, 1000)] + [None, "", "x", " ".join(vocabulary[:40_000]), None]
    known = ["▁" + w for w in sorted(set(vocabulary))]

    def cuts(w):
        out, at = 1, 0
        for i in model.encode_word(w):
            at += len(model.pieces[i])
            out |= 1 << at
        return out

    rows = pa.record_batch({"doc_id": pa.array(range(len(texts)), pa.int64()), "text": pa.array(texts, pa.string())})
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, rows.schema) as w:
        w.write_batch(rows)
    left = pa.table({"gid": [0], "pack": pa.array([sink.getvalue().to_pybytes()], pa.binary())})
    right = pa.table({"group": [0] * len(known), "word": pa.array(known, pa.string()), "folded": pa.array([cuts(w) for w in known], pa.int64())})
    work = pieces._group_encoder(SimpleNamespace(value=model), ["doc_id", "text", "piece_ids"], "text", False)
    model.words_of(pa.array(["a"]))
    tracemalloc.start()
    got = work(None, left, right)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < 30 << 20
    assert got.column("text").to_pylist() == texts and got.column("doc_id").to_pylist() == list(range(len(texts)))
    assert got.column("piece_ids").to_pylist() == [None if t is None else sp.encode(t) for t in texts]
