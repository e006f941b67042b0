"""Building and maintenance of the graph as queries: extraction, scans, upserts, renames, counts, text functions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.functions import text
from quern.operators import extract, mutate, scan, similarity, vector
from quern.operators.spread import dealt
from quern.sources import html
from quern.sources.tables import mentions, table

_PERSON, _PLACE = "Person", "Place"


def _results(spark, d) -> DataFrame:
    """What an extractor might answer for each order: a person, its nation, a place without a name, a bare initial, a stranger."""
    o = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    node = lambda i, label, name, given=None: F.struct(F.lit(i).alias("id"), F.lit(label).alias("label"), name.alias("name"), (F.lit(None).cast("string") if given is None else given).alias("canonicalName"))
    rel = lambda a, b, t: F.struct(F.lit(a).alias("start_node_id"), F.lit(b).alias("end_node_id"), F.lit(t).alias("type"))
    name = F.lower(F.col("c_name"))
    nodes = F.array(node("p", _PERSON, F.when(F.col("o_orderkey") % 7 == 0, F.lit("captain")).otherwise(name), F.col("c_name")), node("n", _PLACE, F.concat(F.lit(" "), F.initcap("n_name"))), node("b", _PLACE, F.lit("  ")), node("i", _PERSON, F.lit("J."), F.lit("j.")), node("x", "Idea", F.lit("peace")))
    return o.select(F.col("o_orderkey").alias("chunk_id"), F.to_date("o_orderdate").alias("date"), F.struct(nodes.alias("nodes"), F.array(rel("p", "n", "LIVES_IN"), rel("n", "p", "VISITED"), rel("p", "b", "LIVES_IN"), rel("p", "n", "UNKNOWN")).alias("relationships")).alias("result"))


def _extracted(spark, d) -> DataFrame:
    lexicon = spark.createDataFrame([("germany", "Deutschland")], "raw string, canonical string")
    return extract.extracted_nodes(_results(spark, d), [_PERSON, _PLACE], lexicon, ["unknown"], ["captain"])


def extraction_nodes(spark, d):
    return _extracted(spark, d).select("chunk_id", "date", "label", "canonical_name")


def extraction_edges(spark, d):
    schema = spark.createDataFrame([(t, [_PERSON], [_PLACE]) for t in ("LIVES_IN", "VISITED")], "rel_type string, src_labels array<string>, dst_labels array<string>")
    return extract.extracted_edges(_results(spark, d), _extracted(spark, d), schema)


def extraction_upserts(spark, d):
    return extract.node_upserts(_extracted(spark, d), ["captain"]).select("label", "canonical_name", "name", F.array_join("aliases", ",").alias("aliases"))


def extraction_mentions(spark, d):
    return extract.mention_upserts(_extracted(spark, d))


def unprocessed_chunks(spark, d):
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("sequence"))
    return extract.unprocessed(o, table(spark, d, "lineitem").filter("l_linenumber = 4").select(F.col("l_orderkey").alias("chunk_id"))).select("chunk_id")


def mention_resolution(spark, d):
    """Every tenth customer is known by its last digits alone, and resolved where one longer name nearby holds them."""
    c = table(spark, d, "customer")
    none = F.array().cast("array<string>")
    short = c.filter("c_custkey % 10 = 0").select((F.col("c_custkey") + 10_000_000).alias("node_id"), F.substring("c_name", -9, 9).alias("name"))
    full = c.select(F.col("c_custkey").alias("node_id"), F.replace("c_name", F.lit("#"), F.lit(" ")).alias("name"))
    n = short.union(full).select("node_id", F.lit(_PERSON).alias("label"), "name", F.upper("name").alias("canonical_name"), none.alias("aliases"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("node_id"), F.col("o_orderkey").alias("chunk_id"))
    at = o.union(o.filter("node_id % 10 = 0").select(F.col("node_id") + 10_000_000, "chunk_id"))
    chunks = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderkey").alias("sequence"))
    return extract.resolve_mentions(at, n, chunks, extract.only_candidate, reach=3)


def mentions_rerouted(spark, d):
    m = mentions(spark, d)
    return mutate.reroute_mentions(m, m.filter("node_id % 5 = 0").select("node_id", "chunk_id", (F.col("node_id") - 1).alias("new_id")))


def _orphans(spark, d) -> tuple[DataFrame, DataFrame, DataFrame]:
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_size")
    li = table(spark, d, "lineitem")
    return n, li.select(F.col("l_partkey").alias("src"), F.col("l_suppkey").alias("dst")), li.filter("l_quantity > 45").select(F.col("l_partkey").alias("node_id")).distinct()


def unmentioned_dropped(spark, d):
    n, e, m = _orphans(spark, d)
    nodes, edges = mutate.drop_unmentioned(n, e, m, F.col("p_size") > 25)
    return nodes.join(edges.groupBy(F.col("src").alias("node_id")).agg(F.count("*").alias("n")), "node_id", "left").select("node_id", F.coalesce("n", F.lit(0)).alias("n"))


def first_writer(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("at"))
    return mutate.upsert_first(o.filter("k % 2 = 0").groupBy("k").agg(F.max("v").alias("v"), F.max("at").alias("at")), o, ["k"], "at")


def second_label(spark, d):
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), "p_size", F.when(F.col("p_partkey") % 3 != 0, F.array(F.lit("Thing"))).alias("labels"))
    return mutate.with_label(n, F.col("p_size") > 25, "Large").select("node_id", F.array_join("labels", ",").alias("labels"))


def _kinds(spark, d) -> DataFrame:
    """Nodes by label and name: every type of part as a place, those of a large part as water, too."""
    p = table(spark, d, "part")
    place = p.groupBy("p_type").agg(F.min("p_partkey").alias("node_id")).select("node_id", F.lit(_PLACE).alias("label"), F.initcap(F.lower("p_type")).alias("name"), F.upper("p_type").alias("canonical_name"), F.array(F.lit("a")).alias("aliases"))
    water = p.filter("p_size > 40").groupBy("p_type").agg((F.min("p_partkey") + 10_000_000).alias("node_id")).select("node_id", F.lit("Water").alias("label"), F.lower("p_type").alias("name"), F.upper("p_type").alias("canonical_name"), F.array(F.lit("b")).alias("aliases"))
    return place.union(water)


def label_conflicts(spark, d):
    n = _kinds(spark, d)
    out = mutate.absorb_nodes(n, mutate.conflicting(n, _PLACE, "Water"))
    return out.select("label", "canonical_name", "name", F.array_join("aliases", ",").alias("aliases"))


def rename_or_merge(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit("S").alias("label"), F.upper("s_name").alias("canonical_name"), F.col("s_name").alias("name"), F.array(F.lit("z")).alias("aliases"))
    new = s.filter("node_id % 2 = 0 and node_id > 0").select("node_id", F.when(F.col("node_id") % 4 == 0, F.concat(F.lit("SUPPLIER#"), F.lpad((F.col("node_id") - 1).cast("string"), 9, "0"))).otherwise(F.concat(F.lit("NEW "), "canonical_name")).alias("new_name"))
    nodes, _ = mutate.rename_or_merge(s, new)
    return nodes.select("node_id", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


def fixed_node(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.lit("S").alias("label"), F.col("s_name").alias("name"), F.upper("s_name").alias("canonical_name"), F.array(F.lit("z")).alias("aliases"))
    n = mutate.fixed_node(s, 0, "S", "Supplier One", "SUPPLIER#000000001", ["Number one", "SUPPLIER#000000001"])
    n = mutate.fixed_node(n, -1, "S", "The First", "FIRST", ["One"])
    return n.select("node_id", "name", "canonical_name", F.array_join("aliases", ",").alias("aliases"))


def descriptions_written(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.col("p_comment" if "p_comment" in table(spark, d, "part").columns else "p_type").alias("description"))
    new = table(spark, d, "part").filter("p_size > 25").select(F.col("p_partkey").alias("node_id"), F.concat_ws(" ", "p_brand", "p_name").alias("description"), F.lit("done").alias("state"))
    return mutate.written_back(p, new)


def mutation_counts(spark, d):
    before = table(spark, d, "orders").filter("o_orderkey % 3 <> 0").select("o_orderkey", "o_orderstatus", "o_custkey")
    after = table(spark, d, "orders").filter("o_orderkey % 5 <> 0").select("o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, F.lit("X")).otherwise(F.col("o_orderstatus")).alias("o_orderstatus"), "o_custkey")
    return mutate.counts(before, after, ["o_orderkey"])


def label_scan(spark, d):
    p = table(spark, d, "part")
    n = p.select(F.col("p_partkey").alias("node_id"), F.array_compact(F.array(F.lit("Species"), F.when(F.col("p_size") > 25, F.lit("Animal")), F.when(F.col("p_size") < 5, F.lit("Plant")))).alias("labels"), F.when(F.col("p_partkey") % 4 != 0, F.col("p_name")).alias("name"), F.upper("p_name").alias("canonical_name"), "p_brand")
    return scan.labelled(n, ["Animal", "Plant"], F.when(F.col("p_brand") != "Brand#12", F.col("p_brand") == "Brand#11"))


def first_chunks(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("sequence"), F.col("o_orderstatus").alias("text"))
    return scan.first_chunk(mentions(spark, d), c)


def chunks_on_dates(spark, d):
    c = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.to_date("o_orderdate").alias("date"))
    return scan.on_dates(c, table(spark, d, "lineitem").filter("l_linenumber = 7").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.to_date("o_orderdate").alias("date")))


def first_with_alias(spark, d):
    p = table(spark, d, "part").select("p_brand", "p_name", "p_partkey", "p_size")
    return scan.first_of_each(p, "p_brand", ["p_name", "p_partkey"], F.col("p_size") > 25).select("p_brand", "p_partkey")


def quote_dates(spark, d):
    """A page for each brand of part: a header for every part, with a date in its link, in its text or none, and a quote."""
    p = table(spark, d, "part").select("p_brand", "p_partkey", "p_name")
    day = F.date_add(F.lit("2000-01-01").cast("date"), F.col("p_partkey").cast("int"))
    kind = F.col("p_partkey") % 4
    link = F.when(kind == 0, F.concat(F.lit("/notes/"), F.date_format(day, "yyyy-MM-dd"), F.lit("-x")))
    title = F.when(kind == 1, F.concat(F.lit("Written "), F.date_format(day, "MMMM d, yyyy"))).otherwise(F.col("p_name"))
    heads = p.select(F.col("p_brand").alias("id"), (F.col("p_partkey") * 2).alias("pos"), F.lit("h3").alias("tag"), title.alias("text"), link.alias("link"))
    said = F.when(kind == 3, F.col("p_name")).otherwise(F.concat(F.col("p_name"), F.lit(" — so — "), F.col("p_brand")))
    bodies = p.select(F.col("p_brand").alias("id"), (F.col("p_partkey") * 2 + 1).alias("pos"), F.lit("blockquote").alias("tag"), said.alias("text"), F.lit(None).cast("string").alias("link"))
    return html.dated_quotes(heads.union(bodies))


def species_names(spark, d):
    p = table(spark, d, "part").select("p_partkey", "p_size", F.concat(F.lit(" "), F.upper("p_type"), F.when(F.col("p_size") > 25, F.lit(" SP.")).otherwise(F.lit(""))).alias("x"))
    return p.select("p_partkey", text.strip(F.concat(F.lit("\n"), "x", F.lit("\t "))).alias("stripped"), text.is_genus_only(F.col("x")).alias("genus_only"), text.scientific_name(F.concat_ws(" ", F.element_at(F.split(F.trim("x"), " "), 1), F.lit("Rubra"), F.when(F.col("p_size") > 25, F.lit("SP.")))).alias("scientific"))


def text_helpers(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.lit("Sir O'"), "s_name", F.lit(" & co")).alias("x"))
    return s.select("s_suppkey", F.array_join(text.clean_tokens(F.col("x"), ["sir"], 3), ",").alias("tokens"), text.normalised(F.col("x")).alias("plain"), text.escaped_query(F.col("x")).alias("escaped"), text.passage(F.col("x"), F.lit("2001-02-03").cast("date"), F.when(F.col("s_suppkey") % 2 == 0, "even")).alias("passage"), F.lit("2001-02-03").cast("date").cast("string").alias("iso"))


def alias_plausible(spark, d):
    """Whether a supplier's name could mean another's: equal or beginning tokens, or none."""
    s = table(spark, d, "supplier").select("s_suppkey", F.when(F.col("s_suppkey") % 3 == 0, F.lit("Captain")).when(F.col("s_suppkey") % 3 == 1, F.lit("zzz qqq")).otherwise(F.lower("s_name")).alias("raw"), F.upper("s_name").alias("canonical"))
    return extract.plausible_rows(s, "raw", "canonical", ["captain"]).select("s_suppkey", "plausible")


def species_lookup(spark, d):
    """Answers of a first table, else of a second one, as far as they are good enough; a binomial, then its genus alone."""
    p = table(spark, d, "part").select(F.col("p_type").alias("canonical_name")).distinct()
    genus = F.element_at(F.split("canonical_name", " "), 1)
    answer = p.select("canonical_name", F.when(F.length("canonical_name") % 3 == 0, "NONE").otherwise("EXACT").alias("matchType"), (F.length("canonical_name") * 4).alias("confidence"), F.when(F.length("canonical_name") % 2 == 0, F.col("canonical_name")).alias("species"), genus.alias("genus"))
    good = html.unmatched_dropped(answer)
    full = good.filter("species is not null").select("canonical_name", F.struct(F.col("species").alias("name")).alias("match"))
    by_genus = p.select("canonical_name", F.struct(genus.alias("name")).alias("match")).filter("match.name <> 'PROMO'")
    return extract.taxonomy(p, [full, by_genus]).select("canonical_name", F.col("match.name").alias("found"))


def generic_flags(spark, d):
    """A classifier for distinct names alone; its answers come back to all nodes, names without an answer say nothing."""
    n = table(spark, d, "part").select(F.lit(_PLACE).alias("label"), F.col("p_type").alias("canonical_name"), "p_partkey")
    flags = extract.generic_places(n, lambda names: names.filter("length(canonical_name) % 2 = 0").withColumn("generic", F.col("canonical_name").contains("STEEL")))
    return n.join(flags, "canonical_name", "left").select("p_partkey", F.coalesce("generic", F.lit(False)).alias("generic"))


def dated_context(spark, d):
    """Passages of each customer's orders in the order of dates, those without one first."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderkey") % 5 != 0, F.to_date("o_orderdate")).alias("date"))
    p = o.withColumn("p", F.concat_ws(" · ", F.coalesce(F.col("date").cast("string"), F.lit("")), F.col("o_orderkey").cast("string")))
    return p.groupBy("o_custkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct(F.coalesce(F.col("date").cast("string"), F.lit("")).alias("at"), "o_orderkey", "p"))), lambda x: x["p"]), "; ").alias("context"))


def kept_first_and_last(spark, d):
    """Line numbers repeat within an order; of equal ones the line that the files hold first counts. Unknown numbers and parts are passed over."""
    li = table(spark, d, "lineitem")
    at = F.struct("_metadata.file_path", "_metadata.row_index").alias("at")
    (li,) = dealt(li.count(), li.select("l_orderkey", "l_linenumber", "l_partkey", at), by=["l_orderkey"])
    known = F.col("l_linenumber").isNotNull() & F.col("l_partkey").isNotNull()
    ends = {"first_part": F.col("l_linenumber"), "last_part": -F.col("l_linenumber").cast("long")}
    return li.groupBy("l_orderkey").agg(*[F.min_by("l_partkey", F.when(known, F.struct(n.alias("n"), "at"))).alias(c) for c, n in ends.items()])


def not_equal_drops_null(spark, d):
    p = table(spark, d, "part").select(F.when(F.col("p_size") > 10, F.col("p_brand")).alias("b"))
    return p.filter(F.col("b") != "Brand#11").groupBy("b").agg(F.count("*").alias("n"))


def text_embeddings(spark, d):
    e = vector.embedded(table(spark, d, "documents"), "doc_id", F.col("text"), 16)
    return e.select(F.col("id").alias("doc_id"), F.array_join(F.transform("embedding", lambda x: F.round(x * 1000).cast("int").cast("string")), ",").alias("embedding"))


def person_rules(spark, d):
    """Titles are stripped and single words refused for persons alone."""
    s = table(spark, d, "supplier").select(F.when(F.col("s_suppkey") % 2 == 0, _PERSON).otherwise(_PLACE).alias("label"), F.col("s_suppkey"))
    name = F.when(F.col("s_suppkey") % 4 < 2, F.concat(F.lit("captain n"), F.col("s_suppkey").cast("string"), F.lit(" abc"))).otherwise(F.concat(F.lit("n"), F.col("s_suppkey").cast("string"), F.lit(" abc")))
    n = s.select("label", name.alias("name"))
    return n.select("label", "name", F.array_join(similarity.name_tokens(F.col("name"), ["captain"], F.col("label") == _PERSON), " ").alias("plain"))


QUERIES = {f.__name__: f for f in (extraction_nodes, extraction_edges, extraction_upserts, extraction_mentions, unprocessed_chunks, mention_resolution, mentions_rerouted, unmentioned_dropped, first_writer, second_label, label_conflicts, rename_or_merge, fixed_node, descriptions_written, mutation_counts, label_scan, first_chunks, chunks_on_dates, first_with_alias, quote_dates, species_names, text_helpers, alias_plausible, species_lookup, generic_flags, dated_context, kept_first_and_last, not_equal_drops_null, text_embeddings, person_rules)}

_X = "x AS (SELECT o_orderkey AS chunk_id, CAST(o_orderdate AS DATE) AS date, c_name, upper(CASE WHEN n_name = 'GERMANY' THEN 'DEUTSCHLAND' ELSE n_name END) AS place, CASE WHEN o_orderkey % 7 = 0 THEN 'captain' ELSE lower(c_name) END AS said, upper(c_name) AS canon, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey)"
_TITLE = "upper({0}[1]) || lower({0}[2:])"
_WORDS = "array_to_string(list_transform(string_split(lower({0}), ' '), lambda w: upper(w[1]) || w[2:]), ' ')"
SQL = {
    "extraction_nodes": f"WITH {_X} SELECT chunk_id, date, 'Person' AS label, canon AS canonical_name FROM x UNION ALL SELECT chunk_id, date, 'Place', place FROM x",
    "extraction_edges": f"WITH {_X} SELECT 'Person' AS src_label, canon AS src, t AS rel_type, 'Place' AS dst_label, place AS dst, date, chunk_id FROM x, (VALUES ('LIVES_IN'), ('VISITED')) AS r(t)",
    "extraction_upserts": f"WITH {_X} SELECT DISTINCT 'Person' AS label, canon AS canonical_name, {_TITLE.format('canon')} AS name, '' AS aliases FROM x UNION ALL SELECT DISTINCT 'Place', place, {_WORDS.format('place')}, CASE WHEN n_name = 'GERMANY' THEN 'Germany' ELSE '' END FROM x",
    "extraction_mentions": f"WITH {_X} SELECT 'Person' AS label, canon AS canonical_name, chunk_id FROM x UNION SELECT 'Place', place, chunk_id FROM x",
    "unprocessed_chunks": "SELECT o_orderkey AS chunk_id FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_linenumber = 4)",
    "mention_resolution": "SELECT DISTINCT o_custkey + 10000000 AS node_id, o_orderkey AS chunk_id, o_custkey AS new_id FROM orders WHERE o_custkey % 10 = 0",
    "mentions_rerouted": "SELECT DISTINCT CASE WHEN l_partkey % 5 = 0 THEN l_partkey - 1 ELSE l_partkey END AS node_id, l_orderkey AS chunk_id FROM lineitem",
    "unmentioned_dropped": "WITH gone AS (SELECT p_partkey FROM part WHERE p_size > 25 AND p_partkey NOT IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 45)), e AS (SELECT l_partkey, count(*) AS n FROM lineitem WHERE l_suppkey NOT IN (SELECT p_partkey FROM gone) GROUP BY 1) SELECT p_partkey AS node_id, coalesce(n, 0) AS n FROM part LEFT JOIN e ON l_partkey = p_partkey WHERE p_partkey NOT IN (SELECT p_partkey FROM gone)",
    "first_writer": "SELECT o_custkey AS k, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderstatus) ELSE arg_min(o_orderstatus, o_orderkey) END AS v, CASE WHEN o_custkey % 2 = 0 THEN max(o_orderkey) ELSE min(o_orderkey) END AS at FROM orders GROUP BY o_custkey",
    "second_label": "SELECT p_partkey AS node_id, CASE WHEN p_partkey % 3 <> 0 AND p_size > 25 THEN 'Thing,Large' WHEN p_partkey % 3 <> 0 THEN 'Thing' WHEN p_size > 25 THEN 'Large' END AS labels FROM part",
    "label_conflicts": f"WITH t AS (SELECT p_type, max(p_size) > 40 AS water FROM part GROUP BY 1) SELECT 'Place' AS label, upper(p_type) AS canonical_name, {_WORDS.format('p_type')} AS name, 'a' AS aliases FROM t WHERE NOT water UNION ALL SELECT 'Water', upper(p_type), lower(p_type), {_WORDS.format('p_type')} || ',a,b' FROM t WHERE water",
    "rename_or_merge": "SELECT s_suppkey AS node_id, CASE WHEN s_suppkey % 4 = 2 THEN 'NEW ' ELSE '' END || upper(s_name) AS canonical_name, CASE WHEN s_suppkey % 4 = 2 THEN upper(s_name) || ',z' WHEN s_suppkey % 4 = 3 AND s_suppkey + 1 IN (SELECT s_suppkey FROM supplier) THEN (SELECT max(upper(b.s_name) || ',' || b.s_name) FROM supplier b WHERE b.s_suppkey = supplier.s_suppkey + 1) || ',z' ELSE 'z' END AS aliases FROM supplier WHERE s_suppkey % 4 <> 0 OR s_suppkey = 0",
    "fixed_node": "SELECT s_suppkey AS node_id, CASE WHEN s_suppkey = 1 THEN 'Supplier One' ELSE s_name END AS name, upper(s_name) AS canonical_name, CASE WHEN s_suppkey = 1 THEN 'Number one,z' ELSE 'z' END AS aliases FROM supplier UNION ALL SELECT -1, 'The First', 'FIRST', 'One'",
    "descriptions_written": "SELECT p_partkey AS node_id, CASE WHEN p_size > 25 THEN p_brand || ' ' || p_name ELSE p_type END AS description, CASE WHEN p_size > 25 THEN 'done' END AS state FROM part",
    "mutation_counts": "SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0 AND o_orderkey % 5 <> 0) AS created, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 = 0) AS updated, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 = 0) AS deleted, count(*) FILTER (WHERE o_orderkey % 3 <> 0 AND o_orderkey % 5 <> 0 AND o_orderkey % 2 <> 0) AS kept FROM orders",
    "label_scan": "SELECT p_partkey AS node_id, CASE WHEN p_size > 25 THEN 'Animal' ELSE 'Plant' END AS label, CASE WHEN p_partkey % 4 <> 0 THEN p_name ELSE upper(p_name) END AS name FROM part WHERE (p_size > 25 OR p_size < 5) AND p_brand <> 'Brand#11'",
    "first_chunks": "SELECT l_partkey AS node_id, arg_min(o_orderstatus, (o_orderdate, o_orderkey)) AS text FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "chunks_on_dates": "SELECT o_orderkey AS chunk_id, CAST(o_orderdate AS DATE) AS date FROM orders WHERE CAST(o_orderdate AS DATE) IN (SELECT CAST(o_orderdate AS DATE) FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE l_linenumber = 7)",
    "first_with_alias": "SELECT p_brand, arg_min(p_partkey, (p_name, p_partkey)) AS p_partkey FROM part WHERE p_size > 25 GROUP BY 1",
    "quote_dates": "WITH p AS (SELECT *, DATE '2000-01-01' + CAST(p_partkey AS INTEGER) AS day, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS e FROM part) SELECT p_brand AS id, e AS entry_no, CASE WHEN p_partkey % 4 = 1 THEN strftime(day, 'Written %B %-d, %Y') ELSE p_name END AS title, CAST(last_value(CASE WHEN p_partkey % 4 < 2 THEN day END IGNORE NULLS) OVER (PARTITION BY p_brand ORDER BY p_partkey) AS DATE) AS date, CASE WHEN p_partkey % 4 = 3 THEN p_name ELSE p_name || ' — so' END AS quote, CASE WHEN p_partkey % 4 = 3 THEN 'unknown' ELSE p_brand END AS diarist FROM p",
    "species_names": "SELECT p_partkey, upper(p_type) || CASE WHEN p_size > 25 THEN ' SP.' ELSE '' END AS stripped, p_size > 25 AS genus_only, upper(p_type[1]) || lower(string_split(p_type, ' ')[1][2:]) || ' rubra' AS scientific FROM part",
    "alias_plausible": "SELECT s_suppkey, s_suppkey % 3 = 2 AS plausible FROM supplier",
    "species_lookup": "WITH t AS (SELECT DISTINCT p_type AS c FROM part) SELECT c AS canonical_name, CASE WHEN length(c) % 3 <> 0 AND length(c) * 4 >= 80 AND length(c) % 2 = 0 THEN c WHEN string_split(c, ' ')[1] <> 'PROMO' THEN string_split(c, ' ')[1] END AS found FROM t",
    "generic_flags": "SELECT p_partkey, length(p_type) % 2 = 0 AND contains(p_type, 'STEEL') AS generic FROM part",
    "dated_context": "WITH o AS (SELECT o_custkey, o_orderkey, CASE WHEN o_orderkey % 5 <> 0 THEN CAST(CAST(o_orderdate AS DATE) AS VARCHAR) ELSE '' END AS day FROM orders) SELECT o_custkey, string_agg(day || ' · ' || o_orderkey, '; ' ORDER BY day, o_orderkey) AS context FROM o GROUP BY 1",
    "kept_first_and_last": "SELECT l_orderkey, arg_min(l_partkey, l_linenumber) AS first_part, arg_max(l_partkey, l_linenumber) AS last_part FROM lineitem GROUP BY 1",
    "not_equal_drops_null": "SELECT p_brand AS b, count(*) AS n FROM part WHERE p_size > 10 AND p_brand <> 'Brand#11' GROUP BY 1",
    "text_embeddings": r"WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '[\p{L}\p{N}]+')) AS token FROM documents), b AS (SELECT doc_id, CAST(('0x' || md5(token)[1:8]) AS BIGINT) % 16 AS b, count(*) AS n FROM t GROUP BY 1, 2), m AS (SELECT doc_id, sqrt(CAST(sum(n * n) AS DOUBLE)) AS norm FROM b GROUP BY 1), g AS (SELECT d.doc_id, i, d.text IS NULL AS no FROM documents d, range(16) AS r(i)) SELECT g.doc_id, CASE WHEN any_value(no) THEN NULL ELSE string_agg(CAST(CAST(round(coalesce(n / norm, 0) * 1000) AS INTEGER) AS VARCHAR), ',' ORDER BY i) END AS embedding FROM g LEFT JOIN b ON b.doc_id = g.doc_id AND b.b = i LEFT JOIN m ON m.doc_id = g.doc_id GROUP BY g.doc_id",
    "person_rules": "WITH n AS (SELECT s_suppkey % 2 = 0 AS person, s_suppkey % 4 < 2 AS titled, 'n' || s_suppkey || ' abc' AS bare FROM supplier) SELECT CASE WHEN person THEN 'Person' ELSE 'Place' END AS label, CASE WHEN titled THEN 'captain ' ELSE '' END || bare AS name, CASE WHEN titled AND NOT person THEN 'captain ' ELSE '' END || bare AS plain FROM n",
}
SQL["text_helpers"] = "SELECT s_suppkey, 'o' || lower(replace(s_name, '#', '')) AS tokens, 'sir o ' || lower(replace(s_name, '#', ' ')) || ' co' AS plain, 'Sir O''' || s_name || ' \\& co' AS escaped, 'Sir O''' || s_name || ' & co · 2001-02-03' || CASE WHEN s_suppkey % 2 = 0 THEN chr(10) || 'even' ELSE '' END AS passage, '2001-02-03' AS iso FROM supplier"
