"""Names and descriptions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_STRINGS = "array<string>"


def strip(s: Column) -> Column:
    """Without white space at either end, newlines too."""
    return F.regexp_replace(s, r"^\s+|\s+$", "")


def title_after_nonletters(s: Column) -> Column:
    """Upper case after every non-letter, lower elsewhere (ASCII letters): ANNA'S HILL -> Anna'S Hill."""
    runs = F.regexp_extract_all(F.lower(s), F.lit("([a-z]+|[^a-z]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))), "")


def title_after_blanks(s: Column) -> Column:
    """Upper case after white space alone: Anna's Hill."""
    return F.initcap(F.lower(s))


def title_at_word_starts(s: Column) -> Column:
    """Upper case of each first ASCII letter of a word of letters, digits and _; the rest as it is."""
    runs = F.regexp_extract_all(s, F.lit("([A-Za-z0-9_]+|[^A-Za-z0-9_]+)"), F.lit(1))
    return F.array_join(F.transform(runs, lambda x: F.concat(F.upper(F.left(x, F.lit(1))), F.substring(x, 2, 1 << 30))), "")


def display_species(s: Column) -> Column:
    return F.replace(title_after_nonletters(s), F.lit(" Sp."), F.lit(" sp."))


def is_genus_only(s: Column) -> Column:
    return F.upper(s).rlike(r" SP\.?$")


def scientific_name(s: Column) -> Column:
    """Genus capitalised, second word lower-cased, a trailing SP. removed."""
    words = F.split(F.regexp_replace(F.upper(F.trim(s)), r" SP\.?$", ""), r"\s+")
    second = F.get(words, F.lit(1))
    return F.concat_ws(" ", F.initcap(F.lower(F.get(words, F.lit(0)))), F.lower(second))


def normalised(s: Column) -> Column:
    """Lower case, signs to blanks, blanks to one."""
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(s), r"[^\w\s]", " "), r"\s+", " "))


def clean_tokens(s: Column, titles: list[str], least: int) -> Column:
    """Lower-cased words, signs within them left out, that are no titles and have ``least`` characters: O'Fallon is ofallon."""
    t = F.split(F.regexp_replace(F.lower(s), r"[^a-z0-9\s]", ""), r"\s+")
    return F.filter(t, lambda x: (F.length(x) >= least) & ~x.isin(titles) if titles else F.length(x) >= least)


def distinct_ignoring_case(values: Column, but: list[Column], least: int = 2, most: int = 8) -> Column:
    """The first of each spelling that differs in case alone, in order; without ``but`` and short ones; the first ``most``."""
    own = F.transform(F.filter(F.array(*but), lambda x: x.isNotNull()), lambda x: F.lower(x))
    empty = F.array().cast(_STRINGS)
    start = F.struct(empty.alias("seen"), empty.alias("kept"))

    def step(acc, v):
        seen, kept = acc.getField("seen"), acc.getField("kept")
        new = v.isNotNull() & (F.length(v) >= least) & ~F.array_contains(own, F.lower(v)) & ~F.array_contains(seen, F.lower(v))
        return F.when(F.coalesce(new, F.lit(False)), F.struct(F.array_append(seen, F.lower(v)).alias("seen"), F.array_append(kept, v).alias("kept"))).otherwise(acc)

    return F.slice(F.aggregate(F.coalesce(values, empty), start, step, lambda a: a.getField("kept")), 1, most)


def describe(name: Column, context: Column, aliases: Column) -> Column:
    """name — context. Also known as: a, b"""
    known = F.when(F.size(aliases) > 0, F.concat(F.lit(". Also known as: "), F.array_join(aliases, ", "))).otherwise(F.lit(""))
    return F.concat(name, F.lit(" — "), context, known)


def split_last_dash(s: Column) -> tuple[Column, Column]:
    """(before, after) of the last em dash; without one the whole and null."""
    has = s.contains("—")
    return F.when(has, F.trim(F.regexp_extract(s, "(?s)^(.*)—(.*)$", 1))).otherwise(F.trim(s)), F.when(has, F.trim(F.regexp_extract(s, "(?s)^(.*)—(.*)$", 2)))


def passage(author: Column, date: Column, text: Column) -> Column:
    """author · date, a newline, the text; what is null is left out."""
    return F.concat_ws("\n", F.concat_ws(" · ", author, date.cast("string")), text)


def escaped_query(s: Column) -> Column:
    """Signs with a meaning in full-text query languages, with a backslash before each."""
    return F.regexp_replace(s, r'([+\-&|!(){}\[\]^"~*?:\\/])', r"\\$1")
