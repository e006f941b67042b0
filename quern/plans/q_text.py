"""Text, vector, resolution and mutation operators as queries."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import chunking, dates, text
from quern.operators import fulltext, mutate, similarity, vector
from quern.operators.components import connected_components
from quern.operators.spread import dealt
from quern.sources import html
from quern.sources.tables import observed, table

TITLES = ["part", "sir", "captain"]


def _query_vector(spark, d) -> list[float]:
    return table(spark, d, "embeddings").filter("vec_id = 0").first().embedding  # one vector


def vector_topk(spark, d):
    v = table(spark, d, "embeddings").filter("vec_id <> 0")
    return vector.top_k(v, _query_vector(spark, d), 8).select("vec_id", "score")


def vector_topk_by_label(spark, d):
    v = table(spark, d, "embeddings").filter("vec_id <> 0")
    return vector.top_per_label(v, _query_vector(spark, d)).select("label", "vec_id", "score")


def vector_postfilter(spark, d):
    v = table(spark, d, "embeddings").filter("vec_id <> 0")
    return vector.top_per_label(v, _query_vector(spark, d), keep=F.col("vec_id") % 2 == 0).select("label", "vec_id", "score")


def fulltext_topk(spark, d):
    docs = table(spark, d, "documents")
    body, word = F.col("text"), fulltext.ASCII
    return fulltext.search(fulltext.index(docs, "doc_id", body, word), "the that worthless idiot", fulltext.corpus_size(docs, body, word), 10, word=word)


def fulltext_any_script(spark, d):
    docs, body = table(spark, d, "documents"), F.col("text")
    return fulltext.search(fulltext.index(docs, "doc_id", body), "für être", fulltext.corpus_size(docs, body), 10)


def chunk_ids(spark, d):
    o = table(spark, d, "orders")
    return o.select("o_orderkey", chunking.chunk_id(F.col("o_orderkey"), F.col("o_orderpriority"), F.to_date("o_orderdate"), F.lit(0)).alias("chunk_id"))


def text_chunking(spark, d):
    docs = table(spark, d, "documents").select("doc_id", chunking.pack_text(F.col("text"), 120, r"\n", "\n").alias("p"))
    return docs.select("doc_id", F.posexplode("p").alias("segment", "text")).select("doc_id", "segment", chunking.token_count(F.col("text")).alias("tokens"), F.sha1("text").alias("sha1"))


def document_chunks(spark, d):
    e = table(spark, d, "documents").select(F.col("doc_id").alias("entry_no"), F.col("source").alias("author"), F.lit(None).cast("date").alias("date"), F.col("text").alias("body"))
    return chunking.chunks_of(e, 200, r"\n", "\n").select("chunk_id", "author", "sequence", "token_count", "segment")


def html_blocks(spark, d):
    return html.blocks(table(spark, d, "pages")).select("id", "pos", "tag", F.length("text").alias("n_chars"))


def html_entries(spark, d):
    b = html.blocks(table(spark, d, "pages"))
    e = html.entries(b, F.col("tag").isin("h1", "h2"), F.col("tag") == "p")
    return e.select("id", "entry_no", "header", F.sha1("body").alias("body_sha1"))


def _co_occurrence(spark, d, least: int = 2) -> DataFrame:
    li = table(spark, d, "lineitem")
    return similarity.co_occurrence(li, least, "l_partkey", "l_orderkey")


def cooccurrence_edges(spark, d):
    return _co_occurrence(spark, d)


def node_similarity_topk(spark, d):
    return similarity.node_similarity(_co_occurrence(spark, d), 0.5, 10)


def _names(spark, d) -> DataFrame:
    return table(spark, d, "part").select(F.lit("Part").alias("label"), F.col("p_name").alias("name")).distinct()


def jw_candidates(spark, d):
    return similarity.spelling_candidates(_names(spark, d), 0.85).select("name1", "name2")


def token_containment(spark, d):
    n = _names(spark, d)
    longer = n.filter("name < 'c'").select("label", F.concat_ws(" ", F.lit("great"), "name").alias("name"))
    return similarity.containment_candidates(n.union(longer), 2, 3).select("name1", "name2")


def alias_candidates(spark, d):
    c = table(spark, d, "customer").select(F.lit("X").alias("label"), F.col("c_name").alias("name"), F.array(F.concat(F.lit("nr "), (F.col("c_custkey") % 500).cast("string"))).alias("aliases"))
    s = table(spark, d, "supplier").select(F.lit("X").alias("label"), F.col("s_name").alias("name"), F.array(F.concat(F.lit("NR "), F.col("s_suppkey").cast("string")), F.replace("s_name", F.lit("Supplier"), F.lit("CUSTOMER"))).alias("aliases"))
    return similarity.alias_candidates(c.union(s)).select("name1", "name2")


def metaphone_candidates(spark, d):
    return similarity.sound_candidates(_names(spark, d), 0.85).select("name1", "name2")


def candidate_union(spark, d):
    n = _names(spark, d)
    every = similarity.all_candidates(similarity.spelling_candidates(n, 0.85), similarity.containment_candidates(n))
    return similarity.admissible(every, ["x"]).select("name1", "name2")


def _pairs(spark, d) -> DataFrame:
    pairs = _co_occurrence(spark, d, 3)
    return pairs.select(F.col("a").alias("src"), F.col("b").alias("dst"))


def components(spark, d):
    return connected_components(_pairs(spark, d))


def merge_nodes(spark, d):
    remap = mutate.remap_of(connected_components(_pairs(spark, d)))
    e = table(spark, d, "lineitem").select(F.col("l_partkey").alias("src"), F.lit("SOLD_BY").alias("rel_type"), F.col("l_suppkey").alias("dst"))
    (moved,) = dealt(e.count(), mutate.remap_edges(e, remap), by=["src", "dst"])
    return moved.groupBy("src", "dst").agg(F.count("*").alias("n"))


def merged_aliases(spark, d):
    remap = mutate.remap_of(connected_components(_pairs(spark, d)))
    n = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.upper("p_name").alias("canonical_name"), F.col("p_name").alias("name"), F.array("p_brand").alias("aliases"))
    return mutate.merge_nodes(n, remap).select("node_id", "name", F.array_join("aliases", ",").alias("aliases"))


def mode_canonical(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("component"), F.col("o_orderpriority").alias("canonical"))
    n = table(spark, d, "customer").select(F.col("c_custkey").alias("component"), F.col("c_name").alias("name"))
    return mutate.chosen_names(o, n)


def schema_validate_flip(spark, d):
    li = table(spark, d, "lineitem")
    customer, part, nothing = F.array(F.lit("Person")), F.array(F.lit("Thing")), F.array(F.lit("Place"))
    kind = F.col("l_orderkey") % 3
    e = li.select(F.col("l_partkey").alias("src"), F.when(F.col("l_linenumber") == 1, "OWNS").otherwise("MEETS").alias("rel_type"), F.col("l_suppkey").alias("dst"), F.when(kind == 0, customer).when(kind == 1, part).otherwise(nothing).alias("src_l"), F.when(kind == 0, part).when(kind == 1, customer).otherwise(part).alias("dst_l"))
    schema = spark.createDataFrame([("OWNS", ["Person"], ["Thing", "Animal"])], "rel_type string, src_labels array<string>, dst_labels array<string>")
    return mutate.check_direction(e, schema).groupBy("src", "rel_type", "dst", "flipped").agg(F.count("*").alias("n"))


def edge_upserts(spark, d):
    e = observed(spark, d).select("src", F.lit("OBSERVED").alias("rel_type"), "dst", "date", "chunk_id")
    return mutate.edge_upsert(e)


def upsert_orders(spark, d):
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("k"), F.col("o_orderstatus").alias("v"), F.col("o_orderkey").alias("at"))
    old, new = o.filter("at % 2 = 0").groupBy("k").agg(F.min("v").alias("v"), F.min("at").alias("at")), o.filter("at % 2 = 1")
    return mutate.upsert_last(old, new, ["k"], [F.desc("at")])


def relabel_places(spark, d):
    p = table(spark, d, "part").select(F.col("p_partkey").alias("node_id"), F.when(F.col("p_partkey") % 10 == 0, "WaterBody").otherwise("Place").alias("label"), F.upper("p_name").alias("canonical_name"))
    return mutate.relabel(p, "Place", "WaterBody", ["blue", "sea"])


def precedence_flags(spark, d):
    p = table(spark, d, "part")
    return p.select("p_partkey", mutate.flagged(F.col("p_brand"), ["Brand#11", "Brand#12"], ["Brand#12", "Brand#13"], F.when(F.col("p_size") > 25, F.col("p_brand") == "Brand#13")).alias("is_generic"))


def append_aliases(spark, d):
    n = table(spark, d, "supplier").select(F.col("s_suppkey").alias("node_id"), F.col("s_name").alias("name"), F.upper("s_name").alias("canonical_name"), F.array(F.lit("first")).alias("aliases"))
    a = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("node_id"), F.concat(F.col("l_returnflag"), F.when(F.col("l_linenumber") == 1, "&").otherwise(""), F.col("l_linestatus")).alias("alias"))
    return mutate.append_aliases(n, a, ["node_id"]).select("node_id", F.array_join("aliases", ",").alias("aliases"))


def title_case(spark, d):
    s = table(spark, d, "supplier").select("s_suppkey", F.concat(F.upper("s_name"), F.lit("'S O'FALLON SP. "), F.lower("s_name")).alias("x"))
    return s.select("s_suppkey", text.title_after_nonletters(F.col("x")).alias("nonletters"), text.display_species(F.col("x")).alias("species"), text.title_at_word_starts(F.lower("x")).alias("word_starts"))


def alias_dedupe(spark, d):
    p = table(spark, d, "part").groupBy(F.col("p_type")).agg(F.array_sort(F.collect_set("p_brand")).alias("b"))
    both = F.concat("b", F.transform("b", lambda x: F.upper(x)), F.array(F.lit("x"), F.lit("Brand#11")))
    kept = text.distinct_ignoring_case(both, [F.lit("brand#11")], 2, 8)
    return p.select("p_type", F.array_join(kept, ",").alias("aliases"))


def describe_entity(spark, d):
    p = table(spark, d, "part")
    a = text.distinct_ignoring_case(F.array("p_brand", "p_type", F.upper("p_brand")), [F.col("p_name")])
    return p.select("p_partkey", text.describe(F.col("p_name"), F.lit("a part"), a).alias("description"))


def parse_dates(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.col("o_orderdate").alias("t"))
    return o.select("o_orderkey", dates.strict_date(F.date_format("t", "MMMM d, yyyy")).alias("strict"), dates.tolerant_date(F.when(F.col("o_orderkey") % 2 == 0, F.lower(F.date_format("t", "d-MMM-yyyy"))).otherwise("soon")).alias("tolerant"))


def json_props(spark, d):
    e = table(spark, d, "events").select("event_id", F.from_json("props", "k bigint").alias("p"))
    return e.select("event_id", F.col("p.k").alias("k"), F.to_json("p").alias("again"))


def history_last6(spark, d):
    w = Window.partitionBy("conv_id").orderBy(F.desc("turn"))
    c = table(spark, d, "conversations").withColumn("r", F.row_number().over(w)).filter("r <= 6")
    return c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), ",").alias("roles"))


def quote_passages(spark, d):
    b = table(spark, d, "benchmark").select("item_id", text.normalised(F.col("text")).alias("quote"))
    p = table(spark, d, "documents").select("doc_id", text.normalised(F.col("text")).alias("passage"))
    return similarity.best_passages(b, p)


def event_windows(spark, d):
    e = table(spark, d, "events")
    return e.groupBy(F.window("ts", "1 day"), "event_type").agg(F.count("*").alias("n")).select(F.to_date("window.start").alias("day"), "event_type", "n")


def event_sessions(spark, d):
    e = table(spark, d, "events")
    s = e.groupBy(F.session_window("ts", "2 hours"), "user_id").agg(F.count("*").alias("n"))
    return s.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


QUERIES = {f.__name__: f for f in (vector_topk, vector_topk_by_label, vector_postfilter, fulltext_topk, fulltext_any_script, chunk_ids, text_chunking, document_chunks, html_blocks, html_entries, cooccurrence_edges, node_similarity_topk, jw_candidates, token_containment, alias_candidates, metaphone_candidates, candidate_union, components, merge_nodes, merged_aliases, mode_canonical, schema_validate_flip, edge_upserts, upsert_orders, relabel_places, precedence_flags, append_aliases, title_case, alias_dedupe, describe_entity, parse_dates, json_props, history_last6, quote_passages, event_windows, event_sessions)}

_COS = "v AS (SELECT e.vec_id, e.label, round(list_cosine_similarity(CAST(e.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score FROM embeddings e, embeddings q WHERE q.vec_id = 0 AND e.vec_id <> 0)"
_CO = "m AS (SELECT DISTINCT l_partkey AS n, l_orderkey AS c FROM lineitem), co AS (SELECT p.n AS a, q.n AS b, count(*) AS weight FROM m p JOIN m q ON p.c = q.c AND p.n < q.n GROUP BY 1, 2)"
_COMP = f"{_CO}, e AS (SELECT a, b FROM co WHERE weight >= 3 UNION ALL SELECT b, a FROM co WHERE weight >= 3), reach AS (SELECT DISTINCT a AS node, a AS r FROM e UNION SELECT e.b, reach.r FROM reach JOIN e ON e.a = reach.node), comp AS (SELECT node, min(r) AS component FROM reach GROUP BY node)"
_BEST = "b AS (SELECT label, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY score DESC, vec_id) AS r FROM v) WHERE r = 1)"
_TOK = "regexp_extract_all(lower(text), '[a-z0-9]+')"
_NAMES = "n AS (SELECT DISTINCT p_name AS name FROM part)"
_TOKEN = r"\w+|[^\w\s]"
_PLAIN = r"""trim(regexp_replace(replace(replace(replace(replace(replace(replace(regexp_replace(regexp_replace(x, '(?s)^[^>]*>', ''), '<[^>]*>', ' ', 'g'), '&lt;', '<'), '&gt;', '>'), '&quot;', '"'), '&#39;', ''''), '&nbsp;', ' '), '&amp;', '&'), '[ \t\n\r]+', ' ', 'g'))"""
_BLOCKS = rf"""bare AS (SELECT page_id AS id, string_split(regexp_replace(regexp_replace(html, '(?is)<script\b.*?</script>|<style\b.*?</style>|<!--.*?-->', '', 'g'), '(?i)<(h1|h2|p)([\s>])', chr(1) || '\1\2', 'g'), chr(1)) AS parts FROM pages),
part AS (SELECT id, CAST(generate_subscripts(parts[2:], 1) - 1 AS INTEGER) AS pos, regexp_replace(unnest(parts[2:]), '(?is)</(?:h1|h2|p)>.*$', '') AS x FROM bare),
blocks AS (SELECT id, pos, lower(regexp_extract(x, '^([A-Za-z0-9]+)', 1)) AS tag, {_PLAIN} AS text FROM part)"""
# paragraphs are lines; one beyond 120 tokens is a group of its own, of sentences
_PACKED = rf"""lines AS (SELECT doc_id, generate_subscripts(l, 1) AS i, unnest(l) AS p FROM (SELECT doc_id, list_filter(list_transform(string_split(text, chr(10)), lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '') AS l FROM documents)),
sized AS (SELECT *, len(regexp_extract_all(p, '{_TOKEN}')) > 120 AS large FROM lines),
units AS (SELECT doc_id, i, 1 AS j, p AS u, large FROM sized WHERE NOT large
          UNION ALL SELECT doc_id, i, generate_subscripts(s, 1), unnest(s), true FROM (SELECT doc_id, i, list_filter(string_split(regexp_replace(p, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)), lambda x: x <> '') AS s FROM sized WHERE large)),
numbered AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY i, j) AS r, len(regexp_extract_all(u, '{_TOKEN}')) AS n, CASE WHEN large THEN i ELSE 0 END AS g FROM units),
fold AS (SELECT doc_id, r, 0 AS segment, n AS total, g FROM numbered WHERE r = 1
         UNION ALL SELECT b.doc_id, b.r, CASE WHEN b.g <> f.g OR f.total + b.n > 120 THEN f.segment + 1 ELSE f.segment END, CASE WHEN b.g <> f.g OR f.total + b.n > 120 THEN b.n ELSE f.total + b.n END, b.g FROM fold f JOIN numbered b ON b.doc_id = f.doc_id AND b.r = f.r + 1),
pieces AS (SELECT doc_id, segment, CASE WHEN large THEN string_agg(u, ' ' ORDER BY r) ELSE string_agg(u, chr(10) ORDER BY r) END AS text FROM fold JOIN numbered USING (doc_id, r) GROUP BY doc_id, segment, large),
packed AS (SELECT * FROM pieces UNION ALL SELECT doc_id, 0, text FROM documents WHERE text IS NOT NULL AND doc_id NOT IN (SELECT doc_id FROM lines))"""
SQL = {
    "vector_topk": f"WITH {_COS} SELECT vec_id, score FROM v ORDER BY score DESC, vec_id LIMIT 8",
    "vector_topk_by_label": f"WITH {_COS}, {_BEST} SELECT * FROM b",
    "vector_postfilter": f"WITH {_COS}, {_BEST} SELECT * FROM b WHERE vec_id % 2 = 0",
    "fulltext_topk": f"""WITH d AS (SELECT doc_id, {_TOK} AS t FROM documents), p AS (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM d),
tf AS (SELECT doc_id, length, token, count(*) AS tf FROM p WHERE token IN ('the', 'that', 'worthless', 'idiot') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS m FROM d)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score FROM tf JOIN df USING (token), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 10""",
    "fulltext_any_script": r"""WITH d AS (SELECT doc_id, regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}]+') AS t FROM documents), p AS (SELECT doc_id, len(t) AS length, unnest(t) AS token FROM d),
tf AS (SELECT doc_id, length, token, count(*) AS tf FROM p WHERE token IN ('für', 'être') GROUP BY ALL), df AS (SELECT token, count(*) AS df FROM tf GROUP BY token), s AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(len(t)) AS m FROM d)
SELECT doc_id AS id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * length / m))), 6) AS score FROM tf JOIN df USING (token), s GROUP BY doc_id ORDER BY score DESC, id LIMIT 10""",
    "chunk_ids": "SELECT o_orderkey, substr(sha1(o_orderkey || '|' || o_orderpriority || '|' || CAST(CAST(o_orderdate AS DATE) AS VARCHAR) || '|0'), 1, 16) AS chunk_id FROM orders",
    "cooccurrence_edges": f"WITH {_CO} SELECT a, b, weight FROM co WHERE weight >= 2",
    "node_similarity_topk": f"""WITH {_CO}, w AS (SELECT a, b, weight FROM co WHERE weight >= 2 UNION ALL SELECT b, a, weight FROM co WHERE weight >= 2), n AS (SELECT a, sqrt(CAST(sum(weight * weight) AS DOUBLE)) AS norm FROM w GROUP BY a),
s AS (SELECT x.a, y.a AS b, round(CAST(sum(x.weight * y.weight) AS DOUBLE) / (any_value(p.norm) * any_value(q.norm)), 6) AS similarity FROM w x JOIN w y ON x.b = y.b AND x.a <> y.a JOIN n p ON p.a = x.a JOIN n q ON q.a = y.a GROUP BY x.a, y.a)
SELECT a, b, similarity FROM (SELECT *, row_number() OVER (PARTITION BY a ORDER BY similarity DESC, b) AS r FROM s WHERE similarity >= 0.5) WHERE r <= 10""",
    "jw_candidates": f"WITH {_NAMES} SELECT p.name AS name1, q.name AS name2 FROM n p JOIN n q ON p.name < q.name AND lower(p.name[1]) = lower(q.name[1]) AND jaro_winkler_similarity(lower(p.name), lower(q.name)) >= 0.85",
    "token_containment": f"WITH {_NAMES}, a AS (SELECT name FROM n UNION SELECT 'great ' || name FROM n WHERE name < 'c'), t AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS t FROM a) SELECT DISTINCT least(p.name, q.name) AS name1, greatest(p.name, q.name) AS name2 FROM t p JOIN t q ON p.name <> q.name AND len(p.t) <= len(q.t) AND len(p.t) >= 2 AND list_has_all(q.t, p.t) AND len(list_filter(p.t, lambda x: length(x) < 3)) = 0",
    "alias_candidates": "WITH k AS (SELECT c_name AS name, 'NR ' || (c_custkey % 500) AS key, true AS al FROM customer UNION SELECT s_name, 'NR ' || s_suppkey, true FROM supplier UNION SELECT s_name, upper(replace(s_name, 'Supplier', 'CUSTOMER')), true FROM supplier UNION SELECT c_name, upper(c_name), false FROM customer UNION SELECT s_name, upper(s_name), false FROM supplier) SELECT DISTINCT p.name AS name1, q.name AS name2 FROM k p JOIN k q ON p.key = q.key AND p.name < q.name AND (p.al OR q.al)",
    "components": f"WITH RECURSIVE {_COMP} SELECT node, component FROM comp",
    "merge_nodes": f"WITH RECURSIVE {_COMP}, x AS (SELECT l_partkey AS s, l_suppkey AS d, coalesce(c.component, l_partkey) AS src, coalesce(f.component, l_suppkey) AS dst FROM lineitem LEFT JOIN comp c ON c.node = l_partkey LEFT JOIN comp f ON f.node = l_suppkey) SELECT src, dst, count(*) AS n FROM x WHERE src <> dst OR s = d GROUP BY src, dst",
    "merged_aliases": f"WITH RECURSIVE {_COMP}, g AS (SELECT p_partkey, p_name, p_brand, coalesce(component, p_partkey) AS id FROM part LEFT JOIN comp ON node = p_partkey), top AS (SELECT id, arg_min(p_name, p_partkey) AS name FROM g GROUP BY id), al AS (SELECT id, p_brand AS a FROM g UNION SELECT id, p_name FROM g) SELECT top.id AS node_id, top.name, coalesce(string_agg(a, ',' ORDER BY a) FILTER (WHERE a <> top.name), '') AS aliases FROM top JOIN al ON al.id = top.id GROUP BY top.id, top.name",
    "mode_canonical": "WITH v AS (SELECT o_custkey AS c, o_orderpriority AS p, count(*) AS n FROM orders GROUP BY 1, 2), b AS (SELECT c, p FROM (SELECT *, row_number() OVER (PARTITION BY c ORDER BY n DESC, length(p) DESC, p DESC) AS r FROM v) WHERE r = 1) SELECT coalesce(c, c_custkey) AS component, coalesce(p, c_name) AS canonical_name FROM customer FULL JOIN b ON c = c_custkey",
    "schema_validate_flip": "SELECT CASE WHEN l_orderkey % 3 = 0 THEN l_partkey ELSE l_suppkey END AS src, 'OWNS' AS rel_type, CASE WHEN l_orderkey % 3 = 0 THEN l_suppkey ELSE l_partkey END AS dst, l_orderkey % 3 = 1 AS flipped, count(*) AS n FROM lineitem WHERE l_linenumber = 1 AND l_orderkey % 3 < 2 GROUP BY ALL",
    "edge_upserts": "SELECT o_custkey AS src, 'OBSERVED' AS rel_type, l_partkey AS dst, min(CAST(o_orderdate AS DATE)) AS date, o_orderkey AS chunk_id FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1, 3, 5",
    "upsert_orders": "WITH n AS (SELECT o_custkey AS k, arg_max(o_orderstatus, o_orderkey) AS v, max(o_orderkey) AS at FROM orders WHERE o_orderkey % 2 = 1 GROUP BY 1), o AS (SELECT o_custkey AS k, min(o_orderstatus) AS v, min(o_orderkey) AS at FROM orders WHERE o_orderkey % 2 = 0 GROUP BY 1) SELECT * FROM n UNION ALL SELECT * FROM o WHERE k NOT IN (SELECT k FROM n)",
    "relabel_places": "WITH p AS (SELECT p_partkey AS node_id, CASE WHEN p_partkey % 10 = 0 THEN 'WaterBody' ELSE 'Place' END AS label, upper(p_name) AS canonical_name FROM part) SELECT node_id, CASE WHEN label = 'Place' AND (contains(lower(canonical_name), 'blue') OR contains(lower(canonical_name), 'sea')) AND canonical_name NOT IN (SELECT canonical_name FROM p WHERE label = 'WaterBody') THEN 'WaterBody' ELSE label END AS label, canonical_name FROM p",
    "precedence_flags": "SELECT p_partkey, (p_brand IN ('Brand#11', 'Brand#12') OR (p_size > 25 AND p_brand = 'Brand#13')) AND p_brand NOT IN ('Brand#12', 'Brand#13') AS is_generic FROM part",
    "append_aliases": "WITH a AS (SELECT DISTINCT l_suppkey, l_returnflag || l_linestatus AS a FROM lineitem WHERE l_linenumber <> 1) SELECT s_suppkey AS node_id, 'first' || coalesce(',' || string_agg(a, ',' ORDER BY a), '') AS aliases FROM supplier LEFT JOIN a ON l_suppkey = s_suppkey GROUP BY 1",
    "describe_entity": "SELECT p_partkey, p_name || ' — a part. Also known as: ' || p_brand || ', ' || p_type AS description FROM part",
    "parse_dates": "SELECT o_orderkey, CAST(o_orderdate AS DATE) AS strict, CASE WHEN o_orderkey % 2 = 0 THEN CAST(o_orderdate AS DATE) END AS tolerant FROM orders",
    "json_props": """SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, '{"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' AS again FROM events""",
    "history_last6": "SELECT conv_id, string_agg(role, ',' ORDER BY turn, role) AS roles FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS r FROM conversations) WHERE r <= 6 GROUP BY conv_id",
    "event_windows": "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "event_sessions": "WITH g AS (SELECT user_id, ts, CASE WHEN ts >= lag(ts) OVER w + INTERVAL 2 HOUR OR lag(ts) OVER w IS NULL THEN 1 ELSE 0 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)), s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS s FROM g), c AS (SELECT user_id, s, count(*) AS n FROM s GROUP BY 1, 2) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY user_id",
    "candidate_union": f"WITH {_NAMES}, t AS (SELECT name, list_distinct(string_split(lower(name), ' ')) AS t FROM n), c AS (SELECT p.name AS name1, q.name AS name2 FROM n p JOIN n q ON p.name < q.name AND lower(p.name[1]) = lower(q.name[1]) AND jaro_winkler_similarity(lower(p.name), lower(q.name)) >= 0.85 UNION SELECT least(p.name, q.name), greatest(p.name, q.name) FROM t p JOIN t q ON p.name <> q.name AND len(p.t) <= len(q.t) AND len(p.t) >= 2 AND list_has_all(q.t, p.t) AND len(list_filter(p.t, lambda x: length(x) < 3)) = 0) SELECT * FROM c WHERE contains(name1, ' ') AND contains(name2, ' ')",
    "title_case": "SELECT s_suppkey, s_name || '''S O''Fallon Sp. ' || s_name AS nonletters, s_name || '''S O''Fallon sp. ' || s_name AS species, s_name || '''S O''Fallon Sp. ' || s_name AS word_starts FROM supplier",
    "alias_dedupe": "WITH b AS (SELECT p_type, list_sort(list_distinct(list(p_brand))) AS b FROM part GROUP BY p_type) SELECT p_type, array_to_string(list_filter(b, lambda x: x <> 'Brand#11')[1:8], ',') AS aliases FROM b",
    "html_blocks": f"WITH {_BLOCKS} SELECT id, pos, tag, CAST(length(text) AS INTEGER) AS n_chars FROM blocks",
    "html_entries": f"""WITH {_BLOCKS}, n AS (SELECT *, sum(CASE WHEN tag <> 'p' THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY pos) AS e FROM blocks)
SELECT id, CAST(e AS BIGINT) AS entry_no, max(text) FILTER (WHERE tag <> 'p') AS header, sha1(string_agg(text, chr(10) || chr(10) ORDER BY pos) FILTER (WHERE tag = 'p' AND text <> '')) AS body_sha1 FROM n WHERE e > 0 GROUP BY id, e HAVING count(*) FILTER (WHERE tag = 'p' AND text <> '') > 0""",
    "text_chunking": f"WITH RECURSIVE {_PACKED} SELECT doc_id, CAST(row_number() OVER (PARTITION BY doc_id ORDER BY segment) - 1 AS INTEGER) AS segment, CAST(len(regexp_extract_all(text, '{_TOKEN}')) AS INTEGER) AS tokens, sha1(text) AS sha1 FROM packed",
}
