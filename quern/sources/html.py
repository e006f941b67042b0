"""HTML to ordered blocks and entries, in built-in functions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed: the named character references that are decoded, besides numeric ones; &amp; last.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&nbsp;", " "), ("&mdash;", "—"), ("&ndash;", "–"), ("&hellip;", "…"), ("&lsquo;", "‘"), ("&rsquo;", "’"), ("&ldquo;", "“"), ("&rdquo;", "”"), ("&amp;", "&")]


def _numeric(text: Column) -> Column:
    """Numeric character references as characters; one that is no character stays."""
    parts = F.regexp_extract_all(text, F.lit(r"(&#(?:[0-9]{1,7}|[xX][0-9a-fA-F]{1,6});|&|[^&]+)"), F.lit(1))

    def one(x: Column) -> Column:
        digits = F.when(F.lower(F.substring(x, 3, 1)) == "x", F.conv(F.regexp_extract(x, "^&#[xX]([0-9a-fA-F]+);$", 1), 16, 10)).otherwise(F.regexp_extract(x, "^&#([0-9]+);$", 1)).try_cast("int")
        char = F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")
        return F.when(digits.between(32, 55295) | digits.between(57344, 1114111), char).otherwise(x)

    return F.when(text.contains("&#"), F.array_join(F.transform(parts, one), "")).otherwise(text)


def plain(html: Column) -> Column:
    """Text of a fragment: tags are blanks, references are characters, blanks are one."""
    text = reduce(lambda c, e: F.replace(c, F.lit(e[0]), F.lit(e[1])), ENTITIES, _numeric(F.regexp_replace(html, "<[^>]*>", " ")))
    return F.trim(F.regexp_replace(text, r"[ \t\n\r]+", " "))


def blocks(pages: DataFrame, tags: tuple[str, ...] = ("h1", "h2", "p"), skip_class: str = "toc", id_col: str = "page_id", html_col: str = "html") -> DataFrame:
    """(id, pos, tag, text) of the wanted elements in document order; scripts, styles and comments are dropped first.

    An element ends where it is closed or where the next one opens.  Elements of class ``skip_class`` are left out.
    """
    bare = F.regexp_replace(F.col(html_col), r"(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->", "")
    names = "|".join(tags)
    got = F.regexp_extract_all(bare, F.lit(rf"(?is)<(?:{names})(?=[\s>]).*?(?=<(?:{names})[\s>]|</(?:{names})>|$)"), F.lit(0))
    out = pages.select(F.col(id_col).alias("id"), F.posexplode(got).alias("pos", "raw"))
    tag = F.lower(F.regexp_extract("raw", r"^<([A-Za-z0-9]+)", 1))
    skip = F.regexp_extract("raw", r"""(?is)^<[^>]*\bclass\s*=\s*["']?([^"'>]*)""", 1)
    return out.filter(~F.array_contains(F.split(skip, r"\s+"), skip_class)).select("id", "pos", tag.alias("tag"), plain(F.regexp_replace("raw", r"(?s)^<[^>]*>", "")).alias("text"))


def entries(found: DataFrame, is_header: Column, is_body: Column, joiner: str = "\n\n") -> DataFrame:
    """(id, entry_no, header, body): a header opens an entry, bodies after it are joined; entries without a body are dropped.

    What stands before a page's first header belongs to none.
    """
    w = Window.partitionBy("id").orderBy("pos")
    numbered = found.withColumn("_h", is_header).withColumn("entry_no", F.sum(F.col("_h").cast("int")).over(w)).filter("entry_no > 0")
    body = F.array_sort(F.collect_list(F.when(~F.col("_h") & is_body & (F.col("text") != ""), F.struct("pos", "text"))))
    g = numbered.groupBy("id", "entry_no").agg(F.max(F.when(F.col("_h"), F.col("text"))).alias("header"), body.alias("b"))
    return g.filter(F.size("b") > 0).select("id", F.col("entry_no").cast("bigint").alias("entry_no"), "header", F.array_join(F.transform("b", lambda x: x["text"]), joiner).alias("body"))


def filled_dates(rows: DataFrame, order: str = "pos", key: str = "id") -> DataFrame:
    """``date`` where it is missing is the last one seen."""
    w = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn("date", F.last("date", ignorenulls=True).over(w))


def quotes(rows: DataFrame, text: str = "text") -> DataFrame:
    """With (quote, diarist): split at the last em dash, an unknown diarist is 'unknown'."""
    from quern.functions.text import split_last_dash

    q, who = split_last_dash(F.col(text))
    return rows.withColumns({"quote": q, "diarist": F.coalesce(who, F.lit("unknown"))})


def unmatched_dropped(matches: DataFrame, least: int = 80) -> DataFrame:
    """Answers of a taxonomy lookup that are good enough: matched, confident, and below a kingdom."""
    ranks = [c for c in ("phylum", "class", "order", "family", "genus", "species") if c in matches.columns]
    below = reduce(lambda a, b: a | b, [F.col(f"`{c}`").isNotNull() for c in ranks], F.lit(False))
    return matches.filter((F.col("matchType") != "NONE") & (F.col("confidence") >= least) & below)


def dated_quotes(found: DataFrame, header: str = "h3", body: str = "blockquote", slug: str = r"([0-9]{4}-[0-9]{2}-[0-9]{2})") -> DataFrame:
    """(id, entry_no, title, date, quote, diarist) of blocks (id, pos, tag, text, link) of pages.

    A header opens an entry.  Its date is that of its link, else that in its text (month day, year), else the last one
    seen on the page.  Each body is one quote, split at the last em dash; an unknown diarist is 'unknown'.
    """
    w = Window.partitionBy("id").orderBy("pos")
    head = F.col("tag") == header
    own = F.coalesce(F.try_to_date(F.nullif(F.regexp_extract(F.coalesce("link", F.lit("")), slug, 1), F.lit(""))), F.try_to_date(F.nullif(F.regexp_extract("text", r"([A-Z][a-z]+ [0-9]{1,2}, [0-9]{4})", 1), F.lit("")), "MMMM d, yyyy"))
    rows = found.withColumns({"entry_no": F.sum(head.cast("int")).over(w), "date": F.when(head, own), "title": F.when(head, F.col("text"))})
    rows = filled_dates(rows).withColumn("title", F.last("title", ignorenulls=True).over(w)).filter((F.col("tag") == body) & (F.col("entry_no") > 0))
    return quotes(rows).select("id", F.col("entry_no").cast("bigint").alias("entry_no"), "title", "date", "quote", "diarist")
