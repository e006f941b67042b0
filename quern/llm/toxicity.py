"""Toxicity: Levenshtein automata run along a trie of learned terms, with windows of context around each hit.

The lexicon is learned from labelled texts: words, and stems (beginnings of words), that toxic texts hold far more often
than others, and too often for chance (a bound on the binomial tail, divided by the number of terms tried).  Stems match
beginnings exactly; whole words of at least ``FUZZY`` letters also match with one edit, so that misspelled ones are caught.
The automaton of all terms is the product of trie and edit counts, made deterministic state by state as words need it;
most words leave it after two or three letters.

An exact hit carries its term's log-odds.  One with an edit carries the log-odds of its term against the share of clean
texts that hold such a misspelling, less ``COST``: terms that ordinary words come near to say little or nothing that way.
A hit counts by its context: whether it is quoted (within ``WINDOW`` words of an opening mark and of the closing one that
belongs to it) and whether further hits stand near.  A logistic regression over these counts, fitted to the labels and to
copies of toxic training texts with one letter of each term changed, gives the score; no weight of a hit can be negative.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import bounded_sample
from quern.llm.udfs import text_udf
from quern.operators.lineage import cut

STEMS, FUZZY, WINDOW, COST = (4, 5, 6, 7), 5, 8, 0.5
#: Fixed: the marks that close a quotation, by the mark that opens it.
QUOTES = {'"': '"', "“": "”", "„": "“”", "«": "»", "»": "«", "‘": "’"}
_MARK = re.compile(r"(?<![^\W_])[\"“”„«»‘’]|[\"“”„«»‘’](?![^\W_])")
_WORD = re.compile(r"[^\W_]+")
_DEAD = -1


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


class Automaton:
    """States are sets of (trie node, edits so far); ``run`` gives 0 for an exact hit, 1 for one with an edit, else None."""

    def __init__(self, words: list[str], stems: list[str]):
        self.child: list[dict[str, int]] = [{}]
        self.whole, self.term, self.stem, self.loose = {}, {}, set(), [False]
        for term, kind in [(w, "word") for w in words] + [(s, "stem") for s in stems]:
            node, path = 0, [0]
            for ch in term:
                if ch not in self.child[node]:
                    self.child[node][ch] = len(self.child)
                    self.child.append({})
                    self.loose.append(False)
                node = self.child[node][ch]
                path.append(node)
            if kind == "stem":
                self.stem.add(node)
            else:
                fuzzy = len(term) >= FUZZY
                self.whole[node] = fuzzy
                self.term[node] = term
                if fuzzy:  # edits are worth following only on the way to such a word
                    for n in path:
                        self.loose[n] = True
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.moves: list[dict[str, int]] = []
        self.ends: list[int | None] = []
        self.start = self._state(frozenset({(0, 0)}))

    def __getstate__(self):
        return {"child": self.child, "whole": self.whole, "term": self.term, "stem": self.stem, "loose": self.loose}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.states, self.sets, self.moves, self.ends = {}, [], [], []
        self.start = self._state(frozenset({(0, 0)}))

    def _state(self, of: frozenset) -> int:
        """The state of a set closed under skipped letters of a term; _DEAD for none, -2 once a stem is met."""
        todo, closed = list(of), set(of)
        while todo:
            node, e = todo.pop()
            if not e and self.loose[node]:
                for nxt in self.child[node].values():
                    if self.loose[nxt] and (nxt, 0) not in closed and (nxt, 1) not in closed:
                        closed.add((nxt, 1))
        if not closed:
            return _DEAD
        if any(e == 0 and node in self.stem for node, e in closed):
            return -2
        key = frozenset(closed)
        if key not in self.states:
            self.states[key] = len(self.sets)
            self.sets.append(key)
            self.moves.append({})
            hit = [e for node, e in key if node in self.whole and (e == 0 or self.whole[node])]
            self.ends.append(min(hit) if hit else None)
        return self.states[key]

    def _move(self, s: int, ch: str) -> int:
        out = set()
        for node, e in self.sets[s]:
            nxt = self.child[node].get(ch)
            if nxt is not None and (e == 0 or self.loose[nxt]):
                out.add((nxt, e))
            if e == 0 and self.loose[node]:
                out.add((node, 1))  # a letter too many
                out.update((n, 1) for n in self.child[node].values() if self.loose[n])  # another letter
        out = {(n, e) for n, e in out if e == 0 or (n, 0) not in out}
        t = self.moves[s][ch] = self._state(frozenset(out))
        return t

    def _end(self, word: str) -> int:
        s, moves = self.start, self.moves
        for ch in word:
            t = moves[s].get(ch)
            if t is None:
                t = self._move(s, ch)
            if t < 0:
                return t
            s = t
        return s

    def run(self, word: str) -> int | None:
        s = self._end(word)
        return self.ends[s] if s >= 0 else 0 if s == -2 else None

    def near(self, word: str) -> list[str]:
        """The terms that the word is with one edit."""
        s = self._end(word)
        return sorted(self.term[n] for n, e in self.sets[s] if e == 1 and self.whole.get(n)) if s >= 0 else []


NAMES = ["evidence", "strongest", "exact", "any_exact", "rate", "quoted", "fuzzy", "any_fuzzy", "fuzzy_quoted", "near"]
#: What a hit is believed to say before any label is seen, and the constant.  No labels tell quotations; their weights stay near these.
PRIOR = np.array([0.3, 0.5, 0.5, 2.5, 0.0, -1.0, 0.0, 0.0, -0.5, 0.5, -3.0])
#: A hit never speaks for a clean text, a quoted one never more for a toxic one.
LOW = np.array([0.0, 0.0, 0.0, 0.0, 0.0, -9.0, 0.0, 0.0, -9.0, 0.0, -30.0])
HIGH = np.array([9.0, 9.0, 9.0, 9.0, 9.0, 0.0, 9.0, 9.0, 0.0, 9.0, 0.0])
_KEPT = 200_000


def quotations(text: str) -> list[tuple[int, int]]:
    """(opening, closing) places of the quotations of a text; a mark between two letters is an apostrophe, not one of them."""
    out, opened = [], None
    for m in _MARK.finditer(text):
        ch = m.group()
        if opened and ch in QUOTES[opened[0]]:
            out.append((opened[1], m.start()))
            opened = None
        elif ch in QUOTES and (not opened or opened[0] != '"'):
            opened = (ch, m.start())
    return out


@dataclass
class ToxicityModel:
    words: dict[str, float]  # a term's log-odds for toxic texts
    stems: dict[str, float]
    weights: np.ndarray = field(default_factory=lambda: PRIOR.copy())
    loose: dict[str, float] | None = None  # the same of its misspellings, as far as they say anything

    def __post_init__(self):
        if self.loose is None:
            self.loose = {w: o - COST for w, o in self.words.items() if len(w) >= FUZZY and o > COST}
        self.automaton, self.known = Automaton(list(self.words), list(self.stems)), {}

    def __getstate__(self):
        return {"words": self.words, "stems": self.stems, "weights": self.weights, "loose": self.loose}

    def __setstate__(self, state):
        self.__dict__ |= state
        self.__post_init__()

    def known_as(self, word: str) -> tuple[int, float] | None:
        """(edits, log-odds) of a word that hits."""
        e = self.automaton.run(word)
        if e is None:
            return None
        if e:
            odds = max((self.loose[t] for t in self.automaton.near(word) if t in self.loose), default=0.0)
            return (1, odds) if odds > 0 else None
        return 0, max([self.words.get(word, -9.0), *(self.stems[word[:k]] for k in STEMS if word[:k] in self.stems)])

    def hits(self, text: str) -> tuple[list[tuple[int, int, float]], int]:
        """(word number, edits, log-odds) of each hit, and the number of words."""
        words, known, out = words_of(text), self.known, []
        for i, w in enumerate(words):
            e = known.get(w, -1)
            if e == -1:
                if len(known) > _KEPT:  # what is known of words is kept for speed only
                    known.clear()
                e = known[w] = self.known_as(w)
            if e is not None:
                out.append((i, *e))
        return out, len(words)

    def features(self, text: str | None) -> np.ndarray:
        x = np.zeros(len(NAMES))
        hits, n = self.hits(text) if text else ([], 0)
        if not hits:
            return x
        quoted = self._quoted(text, hits)
        odds = [o for (*_, o), q in zip(hits, quoted, strict=True) if not q]
        fuzzy = [q for (_, e, _), q in zip(hits, quoted, strict=True) if e]
        x[0], x[1] = min(20.0, sum(odds)) / 5, max(odds, default=0.0) / 5
        x[2], x[3], x[4], x[5] = np.log1p(len(odds)), len(odds) > 0, np.sqrt(len(hits) / n), np.log1p(len(hits) - len(odds))
        loose = sum(not q for q in fuzzy)
        x[6], x[7], x[8] = np.log1p(loose), loose > 0, np.log1p(len(fuzzy) - loose)
        at = [i for i, *_ in hits]
        x[9] = np.log1p(sum(b - a <= WINDOW for a, b in zip(at, at[1:], strict=False)))
        return x

    @staticmethod
    def _quoted(text: str, hits: list[tuple]) -> list[bool]:
        said = quotations(text.lower())
        if not said:
            return [False] * len(hits)
        starts = [m.start() for m in _WORD.finditer(text.lower())]
        out = []
        for i, *_ in hits:
            k = bisect_right(said, (starts[i], 0)) - 1
            a, z = said[k] if k >= 0 else (0, 0)
            inside = k >= 0 and a < starts[i] < z
            out.append(inside and i - bisect_right(starts, a) < WINDOW and bisect_right(starts, z) - 1 - i < WINDOW)
        return out

    def misspelled(self, text: str) -> str:
        """The text with one letter changed in every exact hit of enough letters, always the same way."""
        lower, out, last = text.lower(), [], 0
        for m in _WORD.finditer(lower):
            w = m.group()
            if len(w) >= FUZZY and w in self.words:
                k = zlib.crc32(f"{w} {m.start()}".encode()) % (len(w) - 1) + 1
                out += [lower[last : m.start()], w[:k], "x" if w[k] != "x" else "z", w[k + 1 :]]
                last = m.end()
        return "".join([*out, lower[last:]])

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([self.features(t) for t in texts]).reshape(-1, len(NAMES))
        return 1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -40, 40)))

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray, steps: int = 60, pull: float = 0.02) -> None:
        """Newton steps of a weighted logistic regression, pulled towards ``PRIOR``, within LOW and HIGH; without rows the prior stays."""
        if not len(y):
            return
        z, w, n = np.column_stack([x, np.ones(len(x))]), PRIOR.copy(), weight.sum()
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ w, -40, 40)))
            grad = z.T @ (weight * (p - y)) / n + pull / n**0.5 * (w - PRIOR)
            hess = (z * (weight * p * (1 - p))[:, None]).T @ z / n + pull / n**0.5 * np.eye(len(w))
            step = np.linalg.solve(hess, grad)
            w = np.clip(w - step * min(1.0, 2 / (np.abs(step).max() + 1e-9)), LOW, HIGH)
        self.weights = w


def learn_lexicon(sample: DataFrame, min_rows: int = 3, lift: float = 8.0, risk: float = 0.05) -> tuple[dict[str, float], dict[str, float]]:
    """Words and stems with their log-odds from rows (id, label, text).

    Those in ``min_rows`` toxic texts and ``lift`` times as often as in others, unless chance may do that: the chance that
    a term falls on so many toxic texts, times the number of terms tried, is at most ``risk``.  The bound on their number
    is that of such terms in the sample, whose size is a parameter of ``fit``.
    """

    def work(texts):
        out = []
        for t in texts:
            words = set(words_of((t or b"").decode("utf-8", "replace")))
            terms = {f"={w}" for w in words if len(w) >= STEMS[0]} | {f"^{w[:k]}" for w in words for k in STEMS if len(w) > k}
            out.append(sorted(terms))
        return pa.array(out, pa.list_(pa.string()))

    n = {r[0]: (r[1], r[2] or 0) for r in sample.groupBy("label").agg(F.count("*"), F.sum(F.length("text"))).collect()}  # one row for each label
    (toxic, much), (clean, little) = n.get(1, (0, 0)), n.get(0, (0, 0))
    if not toxic:
        return {}, {}
    # chance deals a term to toxic texts by their share of texts or, if they are the longer ones, of all that is written
    q = max(toxic / (toxic + clean), much / max(1, much + little))
    terms = sample.select("label", F.explode(text_udf("array<string>", work)("text")).alias("term"))
    df = terms.groupBy("term").agg(F.sum((F.col("label") == 1).cast("long")).alias("t"), F.sum((F.col("label") == 0).cast("long")).alias("c"))
    rate = F.col("t") / (F.col("c") + 0.5) * ((1 - q + 0.5 / (toxic + clean)) / q)
    tried = cut(df.filter(F.col("t") >= min_rows))
    share, n_ = F.col("t") / (F.col("t") + F.col("c")), F.col("t") + F.col("c")
    rest = F.when(share < 1, (1 - share) * F.log((1 - share) / F.lit(1 - q))).otherwise(0.0)
    surprise = n_ * (share * F.log(share / F.lit(q)) + rest)  # the tail is at most exp(-surprise)
    limit = math.log(max(1, tried.count()) / risk)
    sure = surprise >= limit if clean else F.lit(True)
    found = tried.filter((rate >= lift) & sure).withColumn("r", F.log(rate)).collect()
    # copies of one toxic text are no further evidence: a term counts as often as different words stand before it
    before = _contexts(sample, {r.term for r in found})
    good = [r for r in found if before.get(r.term, 0) >= min_rows and (not clean or _surprise(min(r.t, before[r.term]), r.c, q) >= limit)]
    words = {r.term[1:]: r for r in good if r.term[0] == "="}
    stems = {r.term[1:]: r for r in good if r.term[0] == "^" and r.r >= math.log(3 * lift)}
    # a stem says more than its word only where it stands for several; the shortest stem covers longer ones
    kept: dict[str, float] = {}
    for s in sorted(stems, key=len):
        whole = max((r.t for w, r in words.items() if w.startswith(s)), default=0)
        if not any(s.startswith(k) for k in kept) and whole < 0.8 * stems[s].t:
            kept[s] = float(stems[s].r)
    # words that a stem covers stay for their misspellings
    return {w: float(r.r) for w, r in sorted(words.items()) if len(w) >= FUZZY or not any(w.startswith(k) for k in kept)}, kept


def _surprise(t: int, c: int, q: float) -> float:
    share = t / (t + c)
    return (t + c) * (share * math.log(share / q) + ((1 - share) * math.log((1 - share) / (1 - q)) if share < 1 else 0.0)) if share > q else 0.0


def _contexts(sample: DataFrame, terms: set[str]) -> dict[str, int]:
    """For each term the number of different words before it in toxic texts."""
    shared = sample.sparkSession.sparkContext.broadcast(terms)

    def work(texts):
        out, own = [], shared.value
        for t in texts:
            words, got = words_of((t or b"").decode("utf-8", "replace")), set()
            for last, w in zip(["", *words], words, strict=False):
                got |= {f"{x} {last}" for x in (f"={w}", *(f"^{w[:k]}" for k in STEMS if len(w) > k)) if x in own}
            out.append(sorted(got))
        return pa.array(out, pa.list_(pa.string()))

    pairs = sample.filter("label = 1").select(F.explode(text_udf("array<string>", work)("text")).alias("p")).distinct()
    return {r[0]: r[1] for r in pairs.groupBy(F.substring_index("p", " ", 1).alias("term")).count().collect()}  # the terms alone


def fit(labelled: DataFrame, docs: DataFrame, per_label: int = 4000, id_col: str = "doc_id", text_col: str = "text") -> ToxicityModel:
    """A model from ``labelled`` (id, 0 or 1); ``per_label`` bounds the sample of either label."""
    counts = {r[0]: r[1] for r in labelled.groupBy(labelled.columns[1]).count().collect() if r[0] is not None}  # one row for each label
    sample = cut(bounded_sample(labelled, docs, per_label, id_col, text_col))
    model = ToxicityModel(*learn_lexicon(sample))
    model.loose = _loose(sample, model)
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        out, m = [], shared.value
        for t in texts:
            text = t.decode("utf-8", "replace") if t is not None else ""
            out.append([*m.features(text).tolist(), *m.features(m.misspelled(text)).tolist()])
        return pa.array(out, pa.list_(pa.float64()))

    rows = sample.select("id", "label", text_udf("array<double>", work)("text").alias("f")).orderBy("id").toArrow()
    x, y = np.array(rows.column("f").to_pylist(), float).reshape(-1, 2 * len(NAMES)), np.array(rows.column("label").to_pylist(), float)
    total, have = max(1, sum(counts.values())), {k: max(1, int((y == k).sum())) for k in (0, 1)}
    weight = np.where(y == 1, counts.get(1, 0) / have[1], counts.get(0, 0) / have[0]) * len(y) / total
    # toxic texts once as they are and once misspelled
    edited = (y == 1) & (x[:, : len(NAMES)] != x[:, len(NAMES) :]).any(1)
    model.fit(np.vstack([x[:, : len(NAMES)], x[edited, len(NAMES) :]]), np.concatenate([y, y[edited]]), np.concatenate([np.where(edited, weight / 2, weight), weight[edited] / 2]))
    return model


def _loose(sample: DataFrame, model: ToxicityModel) -> dict[str, float]:
    """Log-odds of each word's misspellings: its share of toxic texts against the share of clean ones that seem to misspell it."""
    shared = sample.sparkSession.sparkContext.broadcast(model)

    def work(texts):
        out, near = [], shared.value.automaton
        for t in texts:
            words = set(words_of((t or b"").decode("utf-8", "replace")))
            out.append(sorted({x for w in words if near.run(w) for x in near.near(w)}))
        return pa.array(out, pa.list_(pa.string()))

    n = sample.filter("label = 0").count()
    clean = sample.filter("label = 0").select(F.explode(text_udf("array<string>", work)("text")).alias("term")).groupBy("term").count().collect()  # the lexicon's size
    seen = {r[0]: r[1] for r in clean}
    # what a term's own odds say of its share of toxic texts, against the misspellings of clean ones
    odds = {w: min(o, o - math.log((seen.get(w, 0) + 0.5) / 0.5)) - COST for w, o in model.words.items() if len(w) >= FUZZY}
    return {w: o for w, o in odds.items() if o > 0 and seen.get(w, 0) <= 0.01 * n}


def judge(docs: DataFrame, model: ToxicityModel, text_col: str = "text", out: str = "toxicity") -> DataFrame:
    """``docs`` with a double column ``out``, 0 to 1.

    A null or empty text, and one without a hit, gets the model's constant.  Equal texts score alike; a column already
    called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the lexicon is bounded, see learn_lexicon

    def work(texts):
        return pa.array(shared.value.score([t.decode("utf-8", "replace") if t is not None else None for t in texts]), pa.float64())

    return docs.withColumn(out, text_udf("double", work)(F.col(text_col)))
