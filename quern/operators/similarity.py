"""Names that may mean the same: blocked candidate generators and the measures behind them."""

from __future__ import annotations

from difflib import SequenceMatcher
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

from quern.operators.lineage import cut
from quern.operators.spread import dealt


def jaro(a: str, b: str) -> float:
    if a == b:
        return 1.0 if a else 0.0
    if not a or not b:
        return 0.0
    reach = max(len(a), len(b)) // 2 - 1
    used, hits = [False] * len(b), []
    for i, ch in enumerate(a):
        for j in range(max(0, i - reach), min(len(b), i + reach + 1)):
            if not used[j] and b[j] == ch:
                used[j] = True
                hits.append(ch)
                break
    if not hits:
        return 0.0
    other = [b[j] for j in range(len(b)) if used[j]]
    turned = sum(x != y for x, y in zip(hits, other, strict=True)) // 2
    m = len(hits)
    return (m / len(a) + m / len(b) + (m - turned) / m) / 3


def jaro_winkler_of(a: str | None, b: str | None, scale: float = 0.1) -> float | None:
    if a is None or b is None:
        return None
    s, same = jaro(a, b), 0
    while same < min(4, len(a), len(b)) and a[same] == b[same]:
        same += 1
    return s + same * scale * (1 - s) if s > 0.7 else s


@F.pandas_udf(DoubleType())
def jaro_winkler(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([jaro_winkler_of(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def matching_blocks_ratio(a: str, b: str) -> float:
    return SequenceMatcher(None, a, b).ratio()


@F.pandas_udf(DoubleType())
def sequence_ratio(a: pd.Series, b: pd.Series) -> pd.Series:
    """2 * matched characters / all characters of both, by longest matching blocks."""
    return pd.Series([None if x is None or y is None else matching_blocks_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


def matched_characters(q: str, p: str) -> int:
    """Characters of the matching blocks of ``SequenceMatcher(None, q, p, autojunk=False)``, by the same rules, a row of p at a time."""
    if q in p:
        return len(q)
    a, b = (np.frombuffer(x.encode("utf-32-le", "surrogatepass"), np.uint32) for x in (q, p))
    total, todo = 0, [(0, len(a), 0, len(b))]
    while todo:
        alo, ahi, blo, bhi = todo.pop()
        if alo == ahi or blo == bhi:
            continue
        part, run, i, j, k = b[blo:bhi], np.zeros(bhi - blo + 1, np.int32), 0, 0, 0
        for at in range(alo, ahi):
            run[1:] = (run[:-1] + 1) * (part == a[at])
            end = int(run.argmax())
            if run[end] > k:  # the first of the longest, as there
                k = int(run[end])
                i, j = at - k + 1, blo + end - k
        if k:
            total += k
            todo += [(alo, i, blo, j), (i + k, ahi, j + k, bhi)]
    return total


@F.pandas_udf(DoubleType())
def block_overlap(quote: pd.Series, passage: pd.Series) -> pd.Series:
    """Share of the quote's characters inside matching blocks of the passage; 0 for an empty quote."""

    def one(q, p):
        if q is None or p is None:
            return None
        return matched_characters(q, p) / len(q) if q else 0.0

    return pd.Series([one(q, p) for q, p in zip(quote, passage, strict=True)], dtype="float64")


def word_runs(s: Column, width: int) -> Column:
    """The distinct runs of ``width`` words of a normalised text; none if it has fewer."""
    none = F.array().cast("array<string>")
    # the outer transform binds the words, so a text is split once
    runs = F.transform(F.array(F.split(s, " ")), lambda w: F.when(F.size(w) >= width, F.transform(F.sequence(F.lit(1), F.size(w) - (width - 1)), lambda i: F.array_join(F.slice(w, i, width), " "))).otherwise(none))
    return F.array_distinct(F.flatten(runs))


def best_passages(quotes: DataFrame, passages: DataFrame, width: int = 5, cutoff: float = 0.25, decimals: int = 6) -> DataFrame:
    """(item_id, doc_id, score): each quote's passage of the highest ``block_overlap`` of at least ``cutoff`` (ties by id).

    ``quotes`` is (item_id, quote), ``passages`` (doc_id, passage), both of whole normalised texts.  A quote's candidates
    are the passages that share a run of ``width`` words with it, or all its words in a row if it has fewer.
    """
    q = quotes.filter("quote <> ''").withColumn("n", F.least(F.size(F.split("quote", " ")), F.lit(width)))
    lengths = sorted(r[0] for r in q.select("n").distinct().collect())  # at most ``width`` numbers
    if not lengths:
        lengths = [width]
    p = passages.filter("doc_id is not null and passage is not null").withColumn("h", F.xxhash64("passage"))
    own = F.coalesce(*[F.when(F.col("n") == n, word_runs(F.col("quote"), n)) for n in lengths])
    wanted = q.select("item_id", F.explode(own).alias("run")).distinct()
    met = p.select("doc_id", "h", F.explode(F.flatten(F.array(*[word_runs(F.col("passage"), n) for n in lengths]))).alias("run")).join(wanted, "run").select("item_id", "doc_id", "h").distinct()
    both = met.join(q.select("item_id", "quote"), "item_id").join(p, ["doc_id", "h"])
    # dealt by pair: the quotes of one long passage, and the passages of one common quote, are scored apart
    s = both.repartition("item_id", "doc_id").withColumn("score", block_overlap("quote", "passage")).filter(F.col("score") >= cutoff)
    return s.groupBy("item_id").agg(F.max_by("doc_id", F.struct(F.col("score"), -F.col("doc_id"))).alias("doc_id"), F.round(F.max("score"), decimals).alias("score"))


def sounds(word: str) -> str:
    """A code of a word's consonants as they sound in English, after the published Metaphone rules (primary code)."""
    w = "".join(ch for ch in word.upper() if "A" <= ch <= "Z")
    for lead in ("KN", "GN", "PN", "WR", "PS"):
        if w.startswith(lead):
            w = w[1:]
    if w.startswith("X"):
        w = "S" + w[1:]
    out, i, n, vowels = [], 0, len(w), "AEIOUY"
    if n and w[0] in vowels:
        out.append("A")
        i = 1
    simple = {"B": "P", "F": "F", "K": "K", "L": "L", "M": "M", "N": "N", "P": "P", "Q": "K", "R": "R", "V": "F", "Z": "S"}
    while i < n:
        ch, nxt, rest = w[i], w[i + 1] if i + 1 < n else "", w[i:]
        step = 2 if nxt == ch and ch != "C" else 1
        if ch in vowels:
            step = 1
        elif ch == "C":
            if rest.startswith("CH"):
                out.append("K" if i == 0 and rest[2:3] in ("L", "R", "N", "M") else "X")
                step = 2
            elif rest.startswith("CIA"):
                out.append("X")
            elif nxt and nxt in "IEY":
                out.append("S")
            else:
                out.append("K")
                step = 2 if nxt in ("C", "K", "Q") and nxt else 1
        elif ch == "D":
            if nxt == "G" and rest[2:3] in ("I", "E", "Y") and rest[2:3]:
                out.append("J")
                step = 3
            else:
                out.append("T")
                step = 2 if nxt in ("T", "D") and nxt else 1
        elif ch == "G":
            if nxt == "H":
                out.append("K" if i == 0 or w[i - 1] not in vowels else "")
                step = 2
            elif nxt == "N":
                out.append("N" if i + 2 >= n else "KN")
                step = 2
            else:
                out.append("J" if nxt and nxt in "EIY" else "K")
        elif ch == "H":
            if nxt and nxt in vowels and (i == 0 or w[i - 1] in vowels):
                out.append("H")
        elif ch == "J":
            out.append("J")
        elif ch == "P" and nxt == "H":
            out.append("F")
            step = 2
        elif ch == "S":
            if nxt == "H":
                out.append("X")
                step = 2
            elif rest[:3] in ("SIO", "SIA"):
                out.append("X")
                step = 3
            elif rest.startswith("SCH"):
                out.append("SK")
                step = 3
            else:
                out.append("S")
                step = 2 if nxt in ("S", "Z") and nxt else 1
        elif ch == "T":
            if rest[:4] == "TION" or rest[:3] in ("TIA", "TCH"):
                out.append("X")
                step = 3
            elif nxt == "H":
                out.append("0")
                step = 2
            else:
                out.append("T")
                step = 2 if nxt in ("T", "D") and nxt else 1
        elif ch == "W":
            if nxt and nxt in vowels and i == 0:
                out.append("A")
        elif ch == "X":
            out.append("KS")
        else:
            out.append(simple.get(ch, ""))
        i += step
    return "".join(out)


@F.pandas_udf(StringType())
def metaphone(word: pd.Series) -> pd.Series:
    return pd.Series([None if w is None else sounds(w) for w in word], dtype="object")


def name_tokens(name: Column, titles: list[str] | None = None, titled: Column | None = None) -> Column:
    """Lower-cased words between blanks, without dots, in any script; a leading title goes if anything is left.

    ``titled`` says of which names titles are stripped; of all by default.
    """
    toks = F.filter(F.transform(F.split(F.lower(name), " "), lambda x: F.trim(F.replace(x, F.lit("."), F.lit("")))), lambda x: x != "")
    if not titles:
        return toks
    leads = (F.size(toks) > 1) & F.array_contains(F.array(*map(F.lit, titles)), F.get(toks, F.lit(0)))
    return F.when(leads if titled is None else leads & titled, F.slice(toks, F.lit(2), F.size(toks))).otherwise(toks)


def _titled(labels: list[str] | None) -> Column | None:
    return None if labels is None else F.col("label").isin(labels)


def _pairs(left: DataFrame, on: list[str]) -> DataFrame:
    """(name1 < name2, …): a self equi-join on block keys."""
    b = left.select(*on, *[F.col(c).alias(f"{c}2") for c in left.columns if c not in on])
    return left.join(b, on).filter(F.col("name") < F.col("name2"))


def spelling_candidates(names: DataFrame, cutoff: float = 0.92, titles: list[str] | None = None, titled: list[str] | None = None) -> DataFrame:
    """(label, name1, name2) of equal first character and Jaro-Winkler of the title-stripped names of at least ``cutoff``.

    ``names`` is (label, name).  Blocks are (label, first character); empty names pair with nothing.
    """
    n = names.select("label", "name", F.array_join(name_tokens(F.col("name"), titles, _titled(titled)), " ").alias("plain")).filter("plain <> ''").distinct()
    p = _pairs(n.withColumn("key", F.left("plain", F.lit(1))).withColumn("size", F.length("plain")), ["label", "key"])
    # a prefix of four adds 0.4 of what is missing at most, and of unlike lengths only the shorter's characters can agree
    least = 3 * (cutoff - 0.4) / 0.6 - 2
    p = p.filter(F.least("size", "size2") >= (least - 1e-9) * F.greatest("size", "size2"))
    return p.filter(jaro_winkler("plain", "plain2") >= cutoff).select("label", F.col("name").alias("name1"), F.col("name2")).distinct()


def containment_candidates(names: DataFrame, least_tokens: int = 2, least_length: int = 3, titles: list[str] | None = None, titled: list[str] | None = None) -> DataFrame:
    """(label, name1, name2) where all tokens of the shorter name, enough and long enough ones, are in the longer.

    The shorter name's rarest token is the block, so a common token does not pair everything.
    """
    n = names.select("label", "name", F.array_distinct(name_tokens(F.col("name"), titles, _titled(titled))).alias("t")).distinct()
    n = n.filter(F.size("t") > 0)
    each = n.select("label", "name", "t", F.explode("t").alias("key"))
    often = each.groupBy("label", "key").agg(F.count("*").alias("often"))
    short = n.filter((F.size("t") >= least_tokens) & F.forall("t", lambda x: F.length(x) >= least_length))
    rare = short.select("label", "name", "t", F.explode("t").alias("key")).join(often, ["label", "key"])
    rare = rare.groupBy("label", "name", "t").agg(F.min_by("key", F.struct("often", "key")).alias("key"))
    longer = each.select("label", "key", F.col("name").alias("other"), F.col("t").alias("u"))
    hit = rare.join(longer, ["label", "key"]).filter((F.col("name") != F.col("other")) & (F.size("u") >= F.size("t")) & (F.size(F.array_except("t", "u")) == 0))
    return hit.select("label", F.least("name", "other").alias("name1"), F.greatest("name", "other").alias("name2")).distinct()


def sound_candidates(names: DataFrame, cutoff: float = 0.85, least_length: int = 3, titles: list[str] | None = None, titled: list[str] | None = None) -> DataFrame:
    """(label, name1, name2) whose last tokens sound alike: codes of ``least_length`` signs with the same first one and Jaro-Winkler of ``cutoff``."""
    n = names.select("label", "name", F.try_element_at(name_tokens(F.col("name"), titles, _titled(titled)), F.lit(-1)).alias("last")).dropna()
    codes = n.select("last").distinct().withColumn("code", metaphone("last")).filter(F.length("code") >= least_length)
    n = n.distinct().join(codes, "last")
    p = _pairs(n.withColumn("key", F.left("code", F.lit(1))), ["label", "key"])
    return p.filter(jaro_winkler("code", "code2") >= cutoff).select("label", F.col("name").alias("name1"), F.col("name2")).distinct()


PAIRS, BLOCK = 50_000_000, 2_000


def alias_candidates(names: DataFrame) -> DataFrame:
    """(label, name1, name2) that share an alias, or where one's alias is the other's name, whatever the case.

    ``names`` is (label, name, aliases); null alias lists are empty.  The pairs grow with the square of the names of one key, so
    each is made once, at the first key that makes it, and none is shuffled: the names of a key meet in blocks.  Each row
    carries the earlier keys that its name shares, so a name of very many shared aliases is dear.
    """
    none = F.array().cast("array<string>")
    alias = names.select("label", "name", F.explode(F.coalesce("aliases", none)).alias("a")).select("label", "name", F.upper("a").alias("key"), F.lit(True).alias("al"))
    own = names.select("label", "name", F.upper("name").alias("key"), F.lit(False).alias("al"))
    keyed = alias.unionByName(own).dropna().groupBy("label", "name", "key").agg(F.max("al").alias("al"))
    size = keyed.groupBy("label", "key").agg(F.count("*").alias("n"), F.max("al").alias("any")).filter("n > 1 and any").drop("any")
    keyed = cut(keyed.join(size, ["label", "key"]))
    work = keyed.agg(F.sum(F.col("n").cast("double"))).first()[0] or 0.0
    all_ = keyed.groupBy("label", "name").agg(F.collect_list("key").alias("all"), F.collect_list(F.when(F.col("al"), F.col("key"))).alias("als"))
    before = lambda c: F.filter(c, lambda k: k < F.col("key")).alias(c)
    k = keyed.join(all_, ["label", "name"]).select("label", "key", "name", "al", before("all"), before("als"), F.ceil(F.col("n") / BLOCK).alias("blocks"))
    left = k.withColumn("block", F.pmod(F.xxhash64("name"), F.col("blocks"))).drop("blocks")
    right = k.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1))).drop("blocks")
    on = ["label", "key", "block"]
    left, right = (t.repartition(max(names.sparkSession.sparkContext.defaultParallelism, int(work / PAIRS)), *on) for t in (left, right))
    right = right.select(*on, *[F.col(c).alias(f"{c}2") for c in right.columns if c not in on])
    met = left.join(right.hint("merge"), on).filter((F.col("name") < F.col("name2")) & (F.col("al") | F.col("al2")))
    again = (F.size("all") > 0) & (F.size("all2") > 0) & (F.arrays_overlap("als", "all2") | F.arrays_overlap("all", "als2"))
    return met.filter(~again).select("label", F.col("name").alias("name1"), F.col("name2"))


def all_candidates(*generated: DataFrame) -> DataFrame:
    """The union of pair tables, each pair once, smaller name first."""
    flat = [g.select("label", F.least("name1", "name2").alias("name1"), F.greatest("name1", "name2").alias("name2")) for g in generated]
    return reduce(DataFrame.unionByName, flat).distinct()


def admissible(pairs: DataFrame, unambiguous: list[str]) -> DataFrame:
    """Pairs of two names of several words, or with either in ``unambiguous``."""
    many = F.col("name1").contains(" ") & F.col("name2").contains(" ")
    return pairs.filter(many | F.col("name1").isin(unambiguous) | F.col("name2").isin(unambiguous))


def co_occurrence(mentions: DataFrame, least: int = 2, node: str = "node_id", chunk: str = "chunk_id") -> DataFrame:
    """(a, b, weight), a < b: number of chunks that mention both, at least ``least``. Repeated mentions count once.

    Mentions, then pairs, are counted first and dealt out by that, so a task holds as many of them at any size of the input.
    """
    (m,) = dealt(mentions.count(), mentions.select(F.col(node).alias("a"), F.col(chunk).alias("c")), by=["c"])
    n = m.dropna().groupBy("c").agg(F.count("*").alias("n")).agg(F.sum((F.col("n") * (F.col("n") - 1) / 2).cast("double"))).first()[0]  # repeats included: at least the pairs
    m = m.distinct()
    pairs = m.join(m.select(F.col("a").alias("b"), "c"), "c").filter("a < b").select("a", "b")
    (pairs,) = dealt(int(n or 0) // 2, pairs, by=["a", "b"])  # pairs are short
    return pairs.groupBy("a", "b").agg(F.count("*").alias("weight")).filter(F.col("weight") >= least)


def mirrored(pairs: DataFrame) -> DataFrame:
    return pairs.select("a", "b", "weight").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "weight"))


def node_similarity(pairs: DataFrame, cutoff: float = 0.5, top: int = 10, decimals: int = 6, labels: DataFrame | None = None) -> DataFrame:
    """(a, b, similarity): cosine of weighted neighbourhoods, each node's ``top`` best of at least ``cutoff`` (ties by id).

    With ``labels`` (node_id, label), which adds the column label, only nodes of equal label are compared and ranked;
    neighbourhoods and norms stay whole.
    A sparse product: nodes meet at shared neighbours, products are summed before they are ranked.
    """
    both = mirrored(cut(pairs))  # read four times below
    norm = both.groupBy("a").agg(F.sqrt(F.sum((F.col("weight") * F.col("weight")).cast("double"))).alias("norm"))
    left, right = both.select("a", F.col("b").alias("via"), F.col("weight").alias("w")), both.select(F.col("a").alias("b"), F.col("b").alias("via"), F.col("weight").alias("v"))
    on, by = ["via"], ["a", "b"]
    if labels is not None:
        of = labels.select(F.col("node_id").alias("a"), "label").distinct()
        left, right = left.join(of, "a"), right.join(of.withColumnRenamed("a", "b"), "b")
        on, by = ["via", "label"], ["a", "b", "label"]
    dots = left.join(right, on).filter("a <> b").groupBy(*by).agg(F.sum(F.col("w") * F.col("v")).alias("dot"))
    sim = dots.join(norm, "a").join(norm.select(F.col("a").alias("b"), F.col("norm").alias("norm2")), "b")
    sim = sim.select(*by, F.round(F.col("dot") / (F.col("norm") * F.col("norm2")), decimals).alias("similarity")).filter(F.col("similarity") >= cutoff)
    rank = F.row_number().over(Window.partitionBy("a", *by[2:]).orderBy(F.desc("similarity"), "b"))
    return sim.withColumn("r", rank).filter(F.col("r") <= top).drop("r")
