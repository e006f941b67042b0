"""Graph query shapes on order data: customers observe parts, orders are the chunks that mention them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quern.operators import hierarchy, patterns, sequence
from quern.sources.tables import mentions, observed, places, table

_OBS = "obs AS (SELECT o_custkey AS src, l_partkey AS dst, l_suppkey AS supplier, CAST(o_orderdate AS DATE) AS date, o_orderkey AS chunk_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey)"
_SEQ = "ch AS (SELECT o_orderkey AS chunk_id, CAST(o_orderdate AS DATE) AS date, row_number() OVER (ORDER BY o_orderdate, o_orderkey) - 1 AS sequence FROM orders)"
_PART5 = "first5 AS (SELECT min(date) AS d FROM obs WHERE dst = 5)"


def hop_distinct_targets(spark, d):
    c = table(spark, d, "customer").filter("c_mktsegment = 'BUILDING'").select(F.col("c_custkey").alias("node_id"))
    return patterns.distinct_targets(patterns.hop(c, observed(spark, d))).select(F.col("dst").alias("part"))


def bound_source_targets(spark, d):
    e = observed(spark, d)
    source = e.agg(F.min("src").alias("src"))
    return patterns.having(e, source, "src").select(F.col("dst").alias("part")).distinct()


def cooccur_chunk_join(spark, d):
    e = observed(spark, d)
    with_supplier = mentions(spark, d, "l_suppkey").filter("node_id = 1").select("chunk_id")
    flagged = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.when(F.col("c_acctbal") > 0, True).alias("flag")).filter("flag = true").select("src")
    return patterns.having(patterns.co_mentioned(e, with_supplier), flagged, "src").select("src", "dst").distinct()


def near_comention(spark, d):
    own = observed(spark, d).filter("src = 1").select("dst", "chunk_id")
    third = mentions(spark, d, "l_suppkey").filter("node_id % 3 = 0").select(F.col("node_id").alias("supplier"), "chunk_id")
    return patterns.co_mentioned(own, third).select("dst", "supplier").distinct().orderBy("dst", "supplier").limit(30)


def group_by_ancestor(spark, d):
    up = hierarchy.closure(places(spark, d), depth=3)
    under = up.filter("ancestor = 'ASIA'").select("node")
    nations = table(spark, d, "nation").select(F.col("n_name").alias("ancestor"))
    inner = patterns.having(up, under, "node").join(nations, "ancestor")
    return inner.groupBy("ancestor").agg(F.countDistinct("node").alias("n"))


def collect_targets(spark, d):
    e = observed(spark, d).select("src", "supplier").distinct()
    s = table(spark, d, "supplier").join(table(spark, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("s_suppkey").alias("supplier"), "n_name")
    return e.join(s, "supplier").groupBy("src").agg(F.array_join(F.array_sort(F.collect_set("n_name")), ",").alias("nations"))


def not_generic_filter(spark, d):
    from quern.operators.mutate import flagged

    names = [r[0] for r in table(spark, d, "part").select("p_name").distinct().orderBy("p_name").limit(10).collect()]  # ten names, the lexicon of the caller
    p = table(spark, d, "part").withColumn("is_generic", flagged(F.col("p_name"), names, names[5:]))
    e = observed(spark, d).join(p.filter(~F.col("is_generic")).select(F.col("p_partkey").alias("dst"), "p_name"), "dst")
    return e.select("src", "p_name").distinct().orderBy("src", "p_name").limit(25)


def top_mentions_multiset(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.count("l_orderkey").alias("n")).orderBy(F.desc("n"), "part").limit(10)


def top_mentions_distinct(spark, d):
    return table(spark, d, "lineitem").groupBy(F.col("l_partkey").alias("part")).agg(F.countDistinct("l_orderkey").alias("n")).orderBy(F.desc("n"), "part").limit(10)


def ancestor_path(spark, d):
    h = places(spark, d)
    up = hierarchy.closure(h, depth=3).join(h.select(F.col("parent").alias("ancestor"), "rank").distinct(), "ancestor")
    c = table(spark, d, "customer").select(F.col("c_name").alias("node"))
    lists = patterns.having(up, c, "node").groupBy("node").agg(F.array_sort(F.collect_list(F.struct("depth", F.concat_ws(": ", "rank", "ancestor").alias("t")))).alias("l"))
    return lists.select("node", F.array_join(F.transform("l", lambda x: x["t"]), " | ").alias("path"))


def type_disjunction(spark, d):
    e = observed(spark, d)
    both = e.select("src", F.lit("OBSERVED").alias("rel_type"), F.col("dst")).union(e.select("src", F.lit("BOUGHT_FROM"), "supplier")).union(e.select("src", F.lit("OTHER"), "supplier"))
    return patterns.of_type(both, "OBSERVED", "BOUGHT_FROM").select("rel_type", "dst").distinct()


def count_distinct_targets(spark, d):
    return observed(spark, d).agg(F.countDistinct("dst").alias("n"))


def _first5(e: DataFrame) -> DataFrame:
    return patterns.first_mention(e.filter("dst = 5")).withColumnRenamed("first_date", "d")


def before_first_mention(spark, d):
    e = observed(spark, d)
    return patterns.first_mention(patterns.dated(e, _first5(e), upper="d"), "dst").withColumnRenamed("first_date", "first_date")


def after_anchor_date(spark, d):
    e = observed(spark, d).filter(F.col("date") > F.lit("2000-06-01").cast("date"))
    return patterns.first_mention(e, "dst").orderBy("first_date", "dst").limit(20)


def window_months_before(spark, d):
    e = observed(spark, d)
    return patterns.first_mention(patterns.dated(e, _first5(e), lower="d - INTERVAL 2 MONTH", upper="d", strict=False), "dst")


def window_days_after(spark, d):
    e = observed(spark, d)
    return patterns.first_mention(patterns.dated(e, _first5(e), lower="d", upper="d + INTERVAL 7 DAY", strict=False), "dst")


def node_properties(spark, d):
    return table(spark, d, "part").filter("p_partkey = 5").select("p_partkey", "p_name", "p_brand", F.array_join(F.array("p_name", "p_type"), "; ").alias("aliases"))


def _asian(spark, d):
    up = hierarchy.closure(places(spark, d), depth=3).filter("ancestor = 'ASIA'")
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("src"), F.col("c_name").alias("node"))
    return patterns.having(c, up, "node")


def descendants_semi(spark, d):
    return patterns.having(_asian(spark, d), observed(spark, d), "src").select("src", "node")


def descendants_before_first(spark, d):
    e = observed(spark, d)
    return patterns.first_mention(patterns.having(patterns.dated(e, _first5(e), upper="d"), _asian(spark, d), "src"), "src")


def descendants_after_first(spark, d):
    e = observed(spark, d)
    return patterns.first_mention(patterns.having(patterns.dated(e, _first5(e), lower="d"), _asian(spark, d), "src"), "src")


def two_counts(spark, d):
    m = table(spark, d, "lineitem").join(table(spark, d, "part"), F.col("l_partkey") == F.col("p_partkey"))
    kinds = sorted(r[0] for r in table(spark, d, "part").select("p_type").distinct().collect())  # six types
    return m.agg(F.countDistinct(F.when(F.col("p_type") == kinds[0], F.col("l_orderkey"))).alias("first_n"), F.countDistinct(F.when(F.col("p_type") == kinds[1], F.col("l_orderkey"))).alias("second_n"))


def between_first_mentions(spark, d):
    e = observed(spark, d)
    a = e.filter("dst in (5, 7)").groupBy("dst").agg(F.min("date").alias("f")).agg(F.min("f").alias("lo"), F.max("f").alias("hi"))
    return patterns.dated(e, a, lower="lo", upper="hi", strict=False).groupBy("date").agg(F.count("*").alias("n"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("chunk_id"), F.col("o_orderdate").alias("at"))
    return sequence.with_sequence(o, [F.col("at"), F.col("chunk_id")]).select("chunk_id", F.to_date("at").alias("date"), "sequence")


def _anchors(c: DataFrame) -> DataFrame:
    return c.filter("chunk_id in (10, 20, 30)").select(F.col("chunk_id").alias("anchor"), "sequence")


def sequence_prev_k(spark, d):
    c = chunks(spark, d)
    return sequence.preceding(c, _anchors(c), 5).select("anchor", "chunk_id", "sequence")


def sequence_neighbours(spark, d):
    c = chunks(spark, d)
    return sequence.around(c, _anchors(c), 3, 3).select("anchor", "chunk_id", F.col("distance").cast("int").alias("distance"))


def sequence_context(spark, d):
    from quern.plans.retrieval import sequence_context as context

    c = chunks(spark, d)
    return context(c, _anchors(c), 5, 8).select("chunk_id", "date", "sequence")


def next_chunk_edges(spark, d):
    return sequence.next_edges(chunks(spark, d))


def _entities(spark, d, orders: DataFrame) -> DataFrame:
    from quern.plans.retrieval import chunk_entities as entities

    o = orders.select(F.col("o_orderkey").alias("chunk_id"))
    m = mentions(spark, d).filter("node_id % 2 = 0")
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.lit("Part").alias("label"), F.col("p_name").alias("canonical_name"), F.lit(None).cast("string").alias("name"))
    got = entities(o, m, n)
    return got.select("chunk_id", F.array_join(F.transform("entities", lambda e: F.concat_ws(":", e["label"], e["name"])), ",").alias("entities"))


def chunk_entities(spark, d):
    return _entities(spark, d, table(spark, d, "orders"))


def chunk_relations(spark, d):
    from quern.plans.retrieval import chunk_relations as relations

    o = table(spark, d, "orders").filter("o_orderkey in (1, 2, 3)").select(F.col("o_orderkey").alias("chunk_id"))
    e = observed(spark, d)
    m = mentions(spark, d).union(mentions(spark, d, "l_suppkey").select("node_id", "chunk_id"))
    return relations(o, m, e.select(F.col("dst").alias("src"), F.lit("SOLD_BY").alias("rel_type"), F.col("supplier").alias("dst")), 30)


def closure_recursive(spark, d):
    return hierarchy.closure(places(spark, d)).select("node", "ancestor", F.col("depth").cast("int").alias("depth"))


def alias_rollup(spark, d):
    up = hierarchy.closure(places(spark, d), depth=3)
    a = table(spark, d, "customer").select(F.col("c_name").alias("node"), F.col("c_mktsegment").alias("alias"))
    return hierarchy.alias_rollup(up, a).select("ancestor", F.array_join("aliases", ",").alias("aliases"))


def _gaps(p: DataFrame) -> DataFrame:
    chain = hierarchy.rank_chain([("type", F.col("p_type")), ("brand", F.when(F.col("p_partkey") % 3 != 0, F.col("p_brand"))), ("name", F.col("p_name"))])
    return hierarchy.chain_edges(p, "p_partkey", chain)


def rank_chain_gaps(spark, d):
    return _gaps(table(spark, d, "part"))


def set_ops(spark, d):
    li = table(spark, d, "lineitem")
    a, b, c = (li.filter(f"l_linenumber = {i}").select(F.col("l_partkey").alias("part")).distinct() for i in (1, 2, 3))
    return a.union(b).distinct().intersect(c).union(a.exceptAll(b)).distinct()


def anti_missing_members(spark, d):
    from quern.operators.mutate import missing_members

    n = table(spark, d, "customer").select(F.col("c_name").alias("canonical_name"))
    wanted = table(spark, d, "supplier").select(F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("canonical_name")).union(table(spark, d, "nation").select("n_name"))
    return missing_members(n, wanted)


def tri_state_flag(spark, d):
    c = table(spark, d, "customer").select(F.when(F.col("c_acctbal") > 5000, True).when(F.col("c_acctbal") < 0, False).alias("flag"))
    return c.agg(F.count(F.when(F.col("flag"), 1)).alias("is_true"), F.count(F.when(~F.col("flag"), 1)).alias("not_flag"), F.count(F.when(~F.coalesce("flag", F.lit(False)), 1)).alias("not_coalesced"))


def rollup_counts(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).rollup("n_name", "c_mktsegment").agg(F.count("*").alias("n"))


QUERIES = {f.__name__: f for f in (hop_distinct_targets, bound_source_targets, cooccur_chunk_join, near_comention, group_by_ancestor, collect_targets, not_generic_filter, top_mentions_multiset, top_mentions_distinct, ancestor_path, type_disjunction, count_distinct_targets, before_first_mention, after_anchor_date, window_months_before, window_days_after, node_properties, descendants_semi, descendants_before_first, descendants_after_first, two_counts, between_first_mentions, sequence_prev_k, sequence_neighbours, sequence_context, next_chunk_edges, chunk_entities, chunk_relations, closure_recursive, alias_rollup, rank_chain_gaps, set_ops, anti_missing_members, tri_state_flag, rollup_counts)}

_ASIA = "asia AS (SELECT c_custkey AS src, c_name AS node FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA')"
_PLACES = "places AS (SELECT c_name AS child, n_name AS parent, 'nation' AS rank FROM customer JOIN nation ON c_nationkey = n_nationkey UNION ALL SELECT n_name, r_name, 'region' FROM nation JOIN region ON n_regionkey = r_regionkey)"
SQL = {
    "hop_distinct_targets": f"WITH {_OBS} SELECT DISTINCT dst AS part FROM obs JOIN customer ON src = c_custkey WHERE c_mktsegment = 'BUILDING'",
    "bound_source_targets": f"WITH {_OBS} SELECT DISTINCT dst AS part FROM obs WHERE src = (SELECT min(src) FROM obs)",
    "cooccur_chunk_join": f"WITH {_OBS} SELECT DISTINCT src, dst FROM obs JOIN customer ON src = c_custkey WHERE c_acctbal > 0 AND chunk_id IN (SELECT l_orderkey FROM lineitem WHERE l_suppkey = 1)",
    "near_comention": f"WITH {_OBS} SELECT DISTINCT a.dst, l.l_suppkey AS supplier FROM obs a JOIN lineitem l ON l.l_orderkey = a.chunk_id WHERE a.src = 1 AND l.l_suppkey % 3 = 0 ORDER BY 1, 2 LIMIT 30",
    "group_by_ancestor": "SELECT n_name AS ancestor, count(DISTINCT c_name) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' GROUP BY n_name",
    "collect_targets": f"WITH {_OBS}, x AS (SELECT DISTINCT src, n_name FROM obs JOIN supplier ON supplier = s_suppkey JOIN nation ON s_nationkey = n_nationkey) SELECT src, string_agg(n_name, ',' ORDER BY n_name) AS nations FROM x GROUP BY src",
    "not_generic_filter": f"WITH {_OBS}, names AS (SELECT DISTINCT p_name FROM part ORDER BY p_name LIMIT 5) SELECT DISTINCT src, p_name FROM obs JOIN part ON dst = p_partkey WHERE p_name NOT IN (SELECT p_name FROM names) ORDER BY 1, 2 LIMIT 25",
    "top_mentions_multiset": "SELECT l_partkey AS part, count(l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, part LIMIT 10",
    "top_mentions_distinct": "SELECT l_partkey AS part, count(DISTINCT l_orderkey) AS n FROM lineitem GROUP BY 1 ORDER BY n DESC, part LIMIT 10",
    "ancestor_path": "SELECT c_name AS node, 'nation: ' || n_name || ' | region: ' || r_name AS path FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey",
    "type_disjunction": f"WITH {_OBS} SELECT 'OBSERVED' AS rel_type, dst FROM obs UNION SELECT 'BOUGHT_FROM', supplier FROM obs",
    "count_distinct_targets": f"WITH {_OBS} SELECT count(DISTINCT dst) AS n FROM obs",
    "before_first_mention": f"WITH {_OBS}, {_PART5} SELECT dst, min(date) AS first_date FROM obs, first5 WHERE date < d GROUP BY dst",
    "after_anchor_date": f"WITH {_OBS} SELECT dst, min(date) AS first_date FROM obs WHERE date > DATE '2000-06-01' GROUP BY dst ORDER BY 2, 1 LIMIT 20",
    "window_months_before": f"WITH {_OBS}, {_PART5} SELECT dst, min(date) AS first_date FROM obs, first5 WHERE date >= d - INTERVAL 2 MONTH AND date <= d GROUP BY dst",
    "window_days_after": f"WITH {_OBS}, {_PART5} SELECT dst, min(date) AS first_date FROM obs, first5 WHERE date >= d AND date <= d + INTERVAL 7 DAY GROUP BY dst",
    "node_properties": "SELECT p_partkey, p_name, p_brand, p_name || '; ' || p_type AS aliases FROM part WHERE p_partkey = 5",
    "descendants_semi": f"WITH {_OBS}, {_ASIA} SELECT src, node FROM asia WHERE src IN (SELECT src FROM obs)",
    "descendants_before_first": f"WITH {_OBS}, {_PART5}, {_ASIA} SELECT src, min(date) AS first_date FROM obs, first5 WHERE date < d AND src IN (SELECT src FROM asia) GROUP BY src",
    "descendants_after_first": f"WITH {_OBS}, {_PART5}, {_ASIA} SELECT src, min(date) AS first_date FROM obs, first5 WHERE date > d AND src IN (SELECT src FROM asia) GROUP BY src",
    "two_counts": "WITH k AS (SELECT p_type, row_number() OVER (ORDER BY p_type) AS r FROM (SELECT DISTINCT p_type FROM part)) SELECT count(DISTINCT CASE WHEN r = 1 THEN l_orderkey END) AS first_n, count(DISTINCT CASE WHEN r = 2 THEN l_orderkey END) AS second_n FROM lineitem JOIN part ON l_partkey = p_partkey JOIN k USING (p_type)",
    "between_first_mentions": f"WITH {_OBS}, f AS (SELECT min(date) AS f FROM obs WHERE dst IN (5, 7) GROUP BY dst), a AS (SELECT min(f) AS lo, max(f) AS hi FROM f) SELECT date, count(*) AS n FROM obs, a WHERE date BETWEEN lo AND hi GROUP BY date",
    "sequence_prev_k": f"WITH {_SEQ} SELECT a.chunk_id AS anchor, b.chunk_id, b.sequence FROM ch a JOIN ch b ON b.sequence BETWEEN a.sequence - 5 AND a.sequence - 1 WHERE a.chunk_id IN (10, 20, 30)",
    "sequence_neighbours": f"WITH {_SEQ} SELECT a.chunk_id AS anchor, b.chunk_id, CAST(b.sequence - a.sequence AS INTEGER) AS distance FROM ch a JOIN ch b ON abs(a.sequence - b.sequence) <= 3 WHERE a.chunk_id IN (10, 20, 30)",
    "sequence_context": f"WITH {_SEQ} SELECT DISTINCT b.chunk_id, b.date, b.sequence FROM ch a JOIN ch b ON b.sequence BETWEEN a.sequence - 5 AND a.sequence - 1 WHERE a.chunk_id IN (10, 20, 30) ORDER BY date, sequence LIMIT 8",
    "next_chunk_edges": f"WITH {_SEQ} SELECT a.chunk_id AS src, b.chunk_id AS dst FROM ch a JOIN ch b ON b.sequence = a.sequence + 1",
    "chunk_relations": f"WITH {_OBS}, ids AS (SELECT l_partkey AS i FROM lineitem WHERE l_orderkey IN (1, 2, 3) UNION SELECT l_suppkey FROM lineitem WHERE l_orderkey IN (1, 2, 3)) SELECT DISTINCT dst AS src, 'SOLD_BY' AS rel_type, supplier AS dst FROM obs WHERE dst IN (SELECT i FROM ids) AND supplier IN (SELECT i FROM ids) ORDER BY 2, 1, 3 LIMIT 30",
    "alias_rollup": "WITH x AS (SELECT n_name, r_name, trim(c_mktsegment) AS a FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), y AS (SELECT DISTINCT n_name AS ancestor, a FROM x UNION SELECT DISTINCT r_name, a FROM x) SELECT ancestor, string_agg(a, ',' ORDER BY a) AS aliases FROM y WHERE length(a) >= 2 GROUP BY ancestor",
    "set_ops": "WITH a AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_linenumber = 1), b AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_linenumber = 2), c AS (SELECT DISTINCT l_partkey AS part FROM lineitem WHERE l_linenumber = 3) ((SELECT * FROM a UNION SELECT * FROM b) INTERSECT SELECT * FROM c) UNION (SELECT * FROM a EXCEPT SELECT * FROM b)",
    "anti_missing_members": "SELECT DISTINCT w AS canonical_name FROM (SELECT replace(s_name, 'Supplier', 'Customer') AS w FROM supplier UNION ALL SELECT n_name FROM nation) WHERE w NOT IN (SELECT c_name FROM customer)",
    "tri_state_flag": "WITH c AS (SELECT CASE WHEN c_acctbal > 5000 THEN true WHEN c_acctbal < 0 THEN false END AS flag FROM customer) SELECT count(*) FILTER (WHERE flag) AS is_true, count(*) FILTER (WHERE NOT flag) AS not_flag, count(*) FILTER (WHERE NOT coalesce(flag, false)) AS not_coalesced FROM c",
    "rollup_counts": "SELECT n_name, c_mktsegment, count(*) AS n FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_name, c_mktsegment)",
    "chunk_entities": "WITH e AS (SELECT DISTINCT l_orderkey AS chunk_id, p_name FROM lineitem JOIN part ON l_partkey = p_partkey WHERE l_partkey % 2 = 0) SELECT o_orderkey AS chunk_id, coalesce(string_agg('Part:' || p_name, ',' ORDER BY p_name), '') AS entities FROM orders LEFT JOIN e ON e.chunk_id = o_orderkey GROUP BY 1",
    "closure_recursive": f"WITH RECURSIVE {_PLACES}, up AS (SELECT child AS node, parent AS ancestor, 1 AS depth FROM places UNION ALL SELECT up.node, p.parent, up.depth + 1 FROM up JOIN places p ON p.child = up.ancestor) SELECT node, ancestor, CAST(min(depth) AS INTEGER) AS depth FROM up GROUP BY node, ancestor",
    "rank_chain_gaps": "SELECT p_partkey, 'type' AS rank, p_type AS name, NULL::VARCHAR AS parent_rank, NULL::VARCHAR AS parent_name FROM part UNION ALL SELECT p_partkey, 'brand', p_brand, 'type', p_type FROM part WHERE p_partkey % 3 <> 0 UNION ALL SELECT p_partkey, 'name', p_name, CASE WHEN p_partkey % 3 <> 0 THEN 'brand' ELSE 'type' END, CASE WHEN p_partkey % 3 <> 0 THEN p_brand ELSE p_type END FROM part",
}
