"""URL filters: a rule list first, association rules mined from labelled URLs for the rest.

A URL is a transaction of tokens (host labels, host suffixes, path words, names of parameters; numbers are left out, they
identify single pages).  FP-growth mines the frequent sets of tokens that occur together with the mark of a bad page; rules
``tokens => bad`` are kept by support and confidence, if the confidence is above the share of bad pages beyond chance (a
normal bound of ``SURE`` deviations), and only while no shorter rule is as confident.  A rule is filed in an inverted index
under its rarest token, so a URL meets only rules that share it, and must hold all tokens.

All tokens of a URL take part, however many.  Sets grow as in FP-growth, from the rarest token on by conditional pattern
bases: what stands before the last token of a set in the transactions that hold it, equal ones merged with their counts.
Here the bases of all sets of one size are rows of one table, so that sets grow no longer than asked for (Spark's own
FP-growth makes all of them, two to the power of a URL's tokens).  Left out is only what cannot be kept: infrequent sets,
sets that fit the same rows as one of their parts (the shorter rule is as confident), and what is longer than a rule
without an exception.  Tokens of the same URLs are one.
"""

from __future__ import annotations

from functools import reduce
from math import ceil

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.lineage import cut

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_SPLIT = r"(?s)^.*?://([^/?#]*)([^?#]*)"
BAD = "label:bad"
#: Deviations by which a rule must be better than the share of bad pages.
SURE = 3.0


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(url, _SPLIT, 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, _SPLIT, 2), F.lit(""))


def listed(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """(rule, verdict) of the longest of ``rules`` (verdict, ``host/path``) that fits, else nulls; equal lengths go by text."""
    rule = verdict = F.lit(None).cast("string")
    for v, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        h, slash, p = text.partition("/")
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(slash + p)
        rule, verdict = F.when(fits, F.lit(text)).otherwise(rule), F.when(fits, F.lit(v)).otherwise(verdict)
    return rule, verdict


def tokens_of(url: Column) -> Column:
    """Distinct tokens of a URL; none for a null."""
    labels = F.filter(F.split(host_of(url), r"\."), lambda x: x != "")
    # label and the last two labels tell a site from its subdomains
    site = F.array_join(F.slice(labels, -2, 2), ".")
    words = F.filter(F.split(F.translate(path_of(url), _UPPER, _LOWER), r"[^a-z0-9_\-\x80-\x{10FFFF}]+"), lambda x: ~x.rlike(r"^[0-9]*$"))
    names = F.regexp_extract_all(F.regexp_extract(url, r"(?s)\?([^#]*)", 1), F.lit(r"(?:^|&)([^=&]+)"), 1)
    host = F.transform(labels, lambda x: F.concat(F.lit("h:"), x))
    got = F.concat(host, F.when(F.size(labels) >= 2, F.array(F.concat(F.lit("s:"), site))).otherwise(F.array().cast("array<string>")), F.transform(words, lambda x: F.concat(F.lit("p:"), x)), F.transform(names, lambda x: F.concat(F.lit("q:"), x)))
    return F.coalesce(F.array_distinct(got), F.array().cast("array<string>"))


def mine(labelled: DataFrame, min_support: float = 0.002, min_rows: int = 20, min_confidence: float = 0.7, longest: int = 4) -> DataFrame:
    """(rule_id, tokens, index_token, confidence, support) from rows (tokens, bad), and ``decided`` where labels come from two sources.

    A rule must then hold on the rows that are not ``decided``, too, which are those that it is for.

    Rows with null tokens or label, or without tokens, teach nothing.  No labelled or no bad rows: no rules.  Rules have up to
    ``longest`` tokens and fit ``min_rows`` bad rows and a share of ``min_support`` of all rows at least.
    """
    rows = cut(labelled.filter("tokens is not null and bad is not null and size(tokens) > 0").select("tokens", "bad", (F.col("decided") if "decided" in labelled.columns else F.lit(True)).alias("decided")).withColumn("row", F.monotonically_increasing_id()))
    n, n_bad = rows.agg(F.count("*"), F.count_if("bad")).first()
    if not n_bad:
        return rows.sparkSession.createDataFrame([], "rule_id string, tokens array<string>, index_token string, confidence double, support bigint")
    base = n_bad / n
    least = ceil(min(n, max(min_support * n, min_rows)) - 1e-9)
    counts = ["total", "of_bad", "free", "free_bad"]
    sums = [F.sum(c).alias(c) for c in counts]

    def judged(sets: DataFrame) -> DataFrame:
        """``sets`` (set, counts, beat: the best confidence of a rule of fewer of the same tokens) with confidence, kept and open_ (may grow)."""
        sets = sets.withColumn("confidence", F.col("of_bad") / F.col("total"))
        sure = F.col("of_bad") - F.lit(base) * F.col("total") >= F.lit(SURE * (base * (1 - base)) ** 0.5) * F.sqrt("total")
        there = F.when(F.col("free") > 0, F.col("free_bad") / F.col("free")).otherwise(1.0)
        rule = (F.col("confidence") >= min_confidence) & sure & (there >= min_confidence)
        sets = sets.withColumn("best", F.greatest("beat", F.when(rule, F.col("confidence")).otherwise(0.0)))
        return cut(sets.withColumn("kept", rule & (F.col("confidence") > F.col("beat"))).withColumn("open_", F.col("best") < 1.0))

    each = rows.select("row", "bad", "decided", F.explode(F.array_distinct("tokens")).alias("t")).filter("t is not null")
    h = lambda seed: F.sum(F.pmod(F.xxhash64("row", F.lit(seed)), F.lit(1 << 40)))  # noqa: E731  the same URLs, the same sums
    own = [F.count("*").alias("total"), F.count_if("bad").alias("of_bad"), F.count_if(~F.col("decided")).alias("free"), F.count_if(~F.col("decided") & F.col("bad")).alias("free_bad")]
    often = each.groupBy("t").agg(*own, h(1).alias("h1"), h(2).alias("h2")).filter(F.col("of_bad") >= least)
    single = often.groupBy(*counts, "h1", "h2").agg(F.min("t").alias("t"))
    found = [judged(single.select(F.array("t").alias("set"), *counts, F.lit(0.0).alias("beat")))]
    # the most frequent token first, so a set begins with its rarest
    items = F.transform(F.reverse(F.array_sort(F.collect_list(F.struct("all", "t")))), lambda x: x.t)
    lists = each.join(found[0].filter("open_").select(F.col("set")[0].alias("t"), F.col("total").alias("all")), "t").groupBy("row", "bad", "decided").agg(items.alias("before"))
    bases = lists.groupBy("before").agg(*own).withColumn("set", F.array().cast("array<string>"))
    for size in range(1, longest + 1):
        grown = bases.select("set", "before", F.posexplode("before").alias("p", "t"), *counts)
        grown = grown.select(F.array_append("set", F.col("t")).alias("set"), F.slice("before", F.lit(1), F.col("p")).alias("before"), *counts)
        # no set grows from the last size, only counts are needed
        grown = cut(grown.groupBy("set", "before").agg(*sums) if size < longest else grown.groupBy("set").agg(*sums))
        if size > 1:
            many = grown.groupBy("set").agg(*sums).filter(F.col("of_bad") >= least)
            parts = many.select("set", *counts, F.explode(F.transform(F.sequence(F.lit(1), F.size("set")), lambda i: F.concat(F.slice("set", F.lit(1), i - 1), F.slice("set", i + 1, F.lit(size))))).alias("part"))
            known = found[-1].filter("open_").select(F.col("set").alias("part"), F.col("total").alias("of_part"), "best")
            parts = parts.join(known, "part").filter("total < of_part").groupBy("set", *counts).agg(F.max("best").alias("beat"), F.count("*").alias("n"))
            found.append(judged(parts.filter(F.col("n") == size).drop("n")))
        if size == longest or found[-1].filter("open_").isEmpty():
            break
        bases = grown.join(found[-1].filter("open_").select("set"), "set", "left_semi").filter(F.size("before") > 0)
    rules = reduce(DataFrame.unionByName, found).filter("kept").select(F.array_sort("set").alias("tokens"), F.col("set")[0].alias("index_token"), "confidence", F.col("of_bad").alias("support"))
    return cut(rules.select(F.array_join("tokens", " ").alias("rule_id"), "tokens", "index_token", "confidence", "support"))


def match(urls: DataFrame, rules: DataFrame, url_col: str = "url") -> DataFrame:
    """(url, mined, confidence): for each distinct url that some mined rule fits, the most confident one (ties: larger support, then text)."""
    u = urls.select(F.col(url_col).alias("url")).dropna().distinct().withColumn("has", tokens_of(F.col("url")))
    met = u.withColumn("index_token", F.explode("has")).join(rules, "index_token").filter(F.size(F.array_except("tokens", "has")) == 0)
    best = met.groupBy("url").agg(F.max(F.struct("confidence", "support", "rule_id")).alias("b"))
    return best.select("url", F.col("b.rule_id").alias("mined"), F.col("b.confidence").alias("confidence"))


def judge(pages: DataFrame, mined: DataFrame, rules: list[tuple[str, str]], url_col: str = "url", out: str = "judged") -> DataFrame:
    """``pages`` with a struct column ``out``: host, path, rule (of the list, or null), mined (rule, or null), verdict.

    A null url or one without ``://`` has an empty host and path, fits no rule and is allowed.  The list overrules mined
    rules.  Repeated rows are judged alike; a column already called ``out`` is replaced.
    """
    pages = pages.drop(out) if out in pages.columns else pages
    url = F.col(url_col)
    found = match(pages, mined, url_col).select(F.col("url").alias("_url"), F.col("mined").alias("_mined"))
    host, path = host_of(url), path_of(url)
    rule, verdict = listed(host, path, rules)
    both = pages.join(found, url == F.col("_url"), "left")
    method = F.when(F.col("_mined").isNotNull(), F.lit("block")).otherwise(F.lit("allow"))
    return both.withColumn(out, F.struct(host.alias("host"), path.alias("path"), rule.alias("rule"), F.col("_mined").alias("mined"), F.coalesce(verdict, method).alias("verdict"))).drop("_url", "_mined")
