"""Cutting texts into pieces of bounded size, inside the expression engine: no Python, no shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.operators.sequence import with_sequence


def token_count(text: Column) -> Column:
    """Runs of word characters, and single other signs."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]"), F.lit(0)))


def paragraphs(text: Column, separator: str = r"\n\s*\n") -> Column:
    return F.filter(F.transform(F.split(text, separator), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+"), lambda x: x != "")


def _bound(value: Column, use) -> Column:
    """``use(value)`` with ``value`` computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def pack_text(text: Column, most: int = 500, separator: str = r"\n\s*\n", joiner: str = "\n\n") -> Column:
    """Paragraphs packed greedily to ``most`` tokens.

    A paragraph beyond ``most`` closes the piece before it and is packed by sentences, whose last piece does not take the
    next paragraph; a sentence beyond ``most`` is a piece.  A text without paragraphs, or null, is one piece, itself.

    Units (a paragraph, or each sentence of a large one, with that paragraph's number) are counted once; the fold sees
    numbers alone and keeps where pieces begin, so no string is copied before the pieces are joined.
    """
    unit = lambda t, n, p: F.struct(t.alias("t"), n.alias("n"), p.alias("p"))

    def of_paragraph(x, i):
        by_sentence = F.transform(sentences(x), lambda s: unit(s, token_count(s), i))
        return _bound(token_count(x), lambda n: F.when(n > most, by_sentence).otherwise(F.array(unit(x, n, F.lit(-1)))))

    def step(a, u):
        fresh = (a["p"] != u["p"]) | (a["n"] + u["n"] > most)
        return F.struct(F.when(fresh, F.array_append(a["starts"], a["i"])).otherwise(a["starts"]).alias("starts"), u["p"].alias("p"), F.when(fresh, u["n"]).otherwise(a["n"] + u["n"]).alias("n"), (a["i"] + 1).alias("i"))

    def pieces(units):
        def piece(a, start, k):
            part = F.slice(units, start + 1, F.coalesce(F.get(a["starts"], k + 1), a["i"]) - start)
            words = F.transform(part, lambda u: u["t"])
            return F.when(F.get(units, start)["p"] < 0, F.array_join(words, joiner)).otherwise(F.array_join(words, " "))

        start = F.struct(F.array().cast("array<int>").alias("starts"), F.lit(-2).alias("p"), F.lit(0).alias("n"), F.lit(0).alias("i"))
        cut = lambda a: F.when(a["i"] > 0, F.transform(a["starts"], lambda s, k: piece(a, s, k))).otherwise(F.array(text))
        return F.aggregate(units, start, step, cut)

    return F.coalesce(_bound(F.flatten(F.transform(paragraphs(text, separator), of_paragraph)), pieces), F.array(text))


def chunk_id(sequence: Column, author: Column, date: Column, segment: Column) -> Column:
    """The first 16 hexadecimal digits of the SHA-1 of the parts joined by |; nulls are empty."""
    text = F.array_join(F.transform(F.array(sequence.cast("string"), author.cast("string"), date.cast("string"), segment.cast("string")), lambda x: F.coalesce(x, F.lit(""))), "|")
    return F.substring(F.sha1(text), 1, 16)


def chunks_of(entries: DataFrame, most: int = 500, separator: str = r"\n\s*\n", joiner: str = "\n\n") -> DataFrame:
    """(chunk_id, text, author, date, sequence, token_count, segment) from entries (entry_no, author, date, body).

    The sequence runs over entries and pieces; the id is made from it, so ids are unique.  Null bodies give no chunk.
    """
    e = entries.filter("body is not null").select("entry_no", "author", "date", F.posexplode(pack_text(F.col("body"), most, separator, joiner)).alias("segment", "text"))
    n = with_sequence(e, [F.col("entry_no"), F.col("segment")])
    return n.select(chunk_id(F.col("sequence"), F.col("author"), F.col("date"), F.col("segment")).alias("chunk_id"), "text", "author", "date", "sequence", token_count(F.col("text")).alias("token_count"), "segment")
