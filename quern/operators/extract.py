"""From nested extraction results to upserts: validation, canonical names, aliases, typed edges."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.functions.text import clean_tokens, strip, title_after_nonletters
from quern.operators.mutate import check_direction, edge_upsert
from quern.operators.similarity import sequence_ratio


def parsed(df: DataFrame, column: str, schema) -> DataFrame:
    """``column`` of JSON text as a struct; what does not parse is null."""
    return df.withColumn(column, F.from_json(F.col(column), schema))


def plausible(raw: Column, canonical: Column, titles: list[str], cutoff: float = 0.65, least: int = 3) -> tuple[Column, Column]:
    """Token arrays whose pairs decide whether an alias is plausible (see ``plausible_rows``)."""
    return clean_tokens(raw, titles, least), clean_tokens(canonical, titles, least)


def plausible_rows(rows: DataFrame, raw: str, canonical: str, titles: list[str], out: str = "plausible", cutoff: float = 0.65) -> DataFrame:
    """``rows`` with a boolean: some token of the one equals, begins or nearly spells a token of the other.

    Without tokens on either side nothing speaks for it: false.
    """
    a, b = plausible(F.col(raw), F.col(canonical), titles, cutoff)
    keyed = rows.withColumn("_k", F.monotonically_increasing_id())
    distinct = rows.select(raw, canonical).distinct()
    pairs = distinct.select(raw, canonical, F.explode(a).alias("x"), b.alias("ys")).select(raw, canonical, "x", F.explode("ys").alias("y"))
    easy = (F.col("x") == F.col("y")) | F.col("x").startswith(F.col("y")) | F.col("y").startswith(F.col("x"))
    good = pairs.withColumn("e", easy).withColumn("s", sequence_ratio(F.when(~F.col("e"), F.col("x")), "y")).filter(F.col("e") | (F.col("s") >= cutoff)).select(F.col(raw).alias("_r"), F.col(canonical).alias("_c")).distinct()
    return keyed.join(good, (F.col(raw) == F.col("_r")) & (F.col(canonical) == F.col("_c")), "left").withColumn(out, F.col("_r").isNotNull()).drop("_k", "_r", "_c")


def extracted_nodes(results: DataFrame, labels: list[str], lexicon: DataFrame, placeholders: list[str], titles: list[str], person: str = "Person") -> DataFrame:
    """(chunk_id, date, local_id, label, name, canonical_name) of the valid nodes of ``results`` (chunk_id, date, result).

    Valid: a known label and a name that is not blank.  The canonical name is the upper-cased given one, or the name; the
    lexicon (raw, canonical) reroutes it by the lower-cased name; a person's that is not plausible falls back to its own
    cleaned name.  Placeholders and bare initials go.  Of a repeated local id the last node counts.
    """
    n = results.select("chunk_id", "date", F.posexplode("result.nodes").alias("pos", "n"))
    n = n.groupBy("chunk_id", "date", F.col("n.id").alias("local_id")).agg(F.max_by("n", "pos").alias("n")).select("chunk_id", "date", "local_id", F.col("n.label").alias("label"), F.col("n.name").alias("name"), F.col("n.canonicalName").alias("given"))
    n = n.filter(F.col("label").isin(labels) & (strip(F.col("name")) != ""))
    n = n.withColumn("canonical_name", F.upper(strip(F.coalesce("given", "name"))))
    lex = lexicon.select(F.lower(F.trim("raw")).alias("_raw"), F.upper("canonical").alias("_to")).dropDuplicates(["_raw"])
    n = n.join(F.broadcast(lex), F.lower(strip(F.col("name"))) == F.col("_raw"), "left")  # a list written by hand
    n = plausible_rows(n, "name", "canonical_name", titles)
    own = F.upper(F.array_join(clean_tokens(F.col("name"), titles, 2), " "))
    doubtful = (F.col("label") == person) & ~F.col("plausible") & (own != "")
    n = n.withColumn("canonical_name", F.when(F.col("_to").isNotNull(), F.col("_to")).when(doubtful, own).otherwise(F.col("canonical_name")))
    n = n.filter(~F.col("canonical_name").isin([p.upper() for p in placeholders]) & ~F.col("canonical_name").rlike(r"^[A-Z]{1,2}\.?$"))
    return n.select("chunk_id", "date", "local_id", "label", "name", "canonical_name")


def extracted_edges(results: DataFrame, nodes: DataFrame, rel_schema: DataFrame) -> DataFrame:
    """(src_label, src, rel_type, dst_label, dst, date, chunk_id): ends by canonical name.

    Relationships join the nodes of their own chunk by local id; unknown types and missing ends go, reversed ones turn,
    invalid ones go; one edge for each (ends, type, chunk).
    """
    r = results.select("chunk_id", "date", F.explode("result.relationships").alias("r")).select("chunk_id", "date", F.col("r.start_node_id").alias("s"), F.col("r.end_node_id").alias("d"), F.col("r.type").alias("rel_type"))
    end = lambda k, p: nodes.select("chunk_id", F.col("local_id").alias(k), F.col("canonical_name").alias(p), F.array("label").alias(f"{p}_l"))
    e = r.join(end("s", "src"), ["chunk_id", "s"]).join(end("d", "dst"), ["chunk_id", "d"]).select("src", "rel_type", "dst", "date", "chunk_id", "src_l", "dst_l")
    good = check_direction(e, rel_schema)
    keyed = good.select(F.struct(F.col("src_l")[0].alias("label"), F.col("src").alias("name")).alias("src"), "rel_type", F.struct(F.col("dst_l")[0].alias("label"), F.col("dst").alias("name")).alias("dst"), "date", "chunk_id")
    return edge_upsert(keyed).select(F.col("src.label").alias("src_label"), F.col("src.name").alias("src"), "rel_type", F.col("dst.label").alias("dst_label"), F.col("dst.name").alias("dst"), "date", "chunk_id")


def node_upserts(nodes: DataFrame, titles: list[str] = (), lexicon: DataFrame | None = None, person: str = "Person") -> DataFrame:
    """(label, canonical_name, name, aliases): the display name is the title-cased canonical one, other spellings are aliases.

    A person's spelling must be plausible for the canonical name (see ``plausible_rows``), so a bare title is no alias,
    unless the lexicon (raw, canonical) says that it is meant.
    """
    display = title_after_nonletters(F.col("canonical_name"))
    rows = plausible_rows(nodes.withColumn("name", strip(F.col("name"))), "name", "canonical_name", list(titles))
    sure = F.lit(False)
    if lexicon is not None:
        said = lexicon.select(F.lower(F.trim("raw")).alias("_raw"), F.upper("canonical").alias("_to")).dropDuplicates(["_raw"])
        rows = rows.join(said, F.lower("name") == F.col("_raw"), "left")
        sure = F.coalesce(F.col("_to") == F.col("canonical_name"), sure)
    alias = (F.col("name") != "") & (F.col("name") != display) & (F.upper("name") != F.col("canonical_name")) & ~F.col("name").contains("&")
    alias = alias & ((F.col("label") != person) | sure | F.col("plausible"))
    return rows.groupBy("label", "canonical_name").agg(F.array_sort(F.collect_set(F.when(alias, F.col("name")))).alias("aliases")).select("label", "canonical_name", title_after_nonletters(F.col("canonical_name")).alias("name"), "aliases")


def mention_upserts(nodes: DataFrame) -> DataFrame:
    return nodes.select("label", "canonical_name", "chunk_id").distinct()


def unprocessed(chunks: DataFrame, done: DataFrame) -> DataFrame:
    """Chunks not yet in ``done`` (chunk_id), in sequence."""
    return chunks.join(done.select("chunk_id"), "chunk_id", "left_anti").orderBy("sequence")


def resolve_mentions(mentions: DataFrame, nodes: DataFrame, chunks: DataFrame, decide, skip: list[str] = (), reach: int = 3, label: str = "Person") -> DataFrame:
    """(node_id, chunk_id, new_id) of single-word person mentions that ``decide`` resolved to a candidate nearby.

    Candidates are persons of longer names that hold the word, mentioned within ``reach`` chunks.  ``decide`` maps rows
    (node_id, chunk_id, name, candidates) to (node_id, chunk_id, full_name); names that are no candidates are refused.
    """
    from quern.operators.sequence import around

    people = nodes.filter(F.col("label") == label).select("node_id", "name", "canonical_name", "aliases")
    single = people.filter(~F.col("name").contains(" ") & ~F.col("name").isin(list(skip)))
    at = mentions.join(single.select("node_id", "name"), "node_id").join(chunks.select("chunk_id", "sequence"), "chunk_id")
    anchors = at.select(F.struct("node_id", "chunk_id", "name").alias("anchor"), "sequence")
    near = around(chunks.select("chunk_id", "sequence"), anchors, reach, reach).select("anchor", F.col("chunk_id").alias("near_chunk"))
    full = people.filter(F.col("name").contains(" ")).select(F.col("node_id").alias("full_id"), F.col("name").alias("full_name"), F.concat(F.coalesce("aliases", F.array().cast("array<string>")), F.array("name", "canonical_name")).alias("all"))
    m = mentions.select(F.col("node_id").alias("full_id"), F.col("chunk_id").alias("near_chunk"))
    cand = near.join(m, "near_chunk").join(full, "full_id").filter(F.exists("all", lambda x: F.contains(F.upper(x), F.upper("anchor.name"))))
    cand = cand.select(F.col("anchor.node_id").alias("node_id"), F.col("anchor.chunk_id").alias("chunk_id"), F.col("anchor.name").alias("name"), "full_id", "full_name").distinct()
    asked = cand.groupBy("node_id", "chunk_id", "name").agg(F.array_sort(F.collect_set("full_name")).alias("candidates"))
    return decide(asked).join(cand, ["node_id", "chunk_id", "full_name"]).groupBy("node_id", "chunk_id").agg(F.min("full_id").alias("new_id"))


def only_candidate(asked: DataFrame) -> DataFrame:
    """The decider without a model: resolved if there is one candidate alone."""
    return asked.filter(F.size("candidates") == 1).select("node_id", "chunk_id", F.col("candidates")[0].alias("full_name"))


def generic_places(nodes: DataFrame, classify=None, label: str = "Place") -> DataFrame:
    """(canonical_name, generic) by a classifier over distinct names; without one nothing is generic."""
    names = nodes.filter(F.col("label") == label).select("canonical_name").distinct()
    return classify(names) if classify else names.withColumn("generic", F.lit(False))


def taxonomy(species: DataFrame, lookups: list[DataFrame], key: str = "canonical_name") -> DataFrame:
    """The first lookup that answers, in order: each is (canonical_name, match struct)."""
    out, names = species, []
    for i, t in enumerate(lookups):
        out = out.join(t.select(F.col(key), F.col("match").alias(f"_m{i}")), key, "left")
        names.append(f"_m{i}")
    return out.withColumn("match", F.coalesce(*names)).drop(*names)
