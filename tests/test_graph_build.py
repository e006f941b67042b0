import datetime as dt
import json

from pyspark.sql import functions as F

from quern import schema
from quern.operators import extract, mutate, resolve
from quern.plans import agent, retrieval
from quern.streaming import ingest

D = dt.date(1804, 5, 14)


def rows(df):
    return sorted(map(str, map(tuple, df.collect())))


def results(spark):
    r = {
        "nodes": [
            {"id": "1", "label": "Person", "name": "Capt. Miller", "canonicalName": "ADA MILLER"}, {"id": "2", "label": "Place", "name": " ", "canonicalName": None},
            {"id": "3", "label": "Supply", "name": "keel boat", "canonicalName": None}, {"id": "4", "label": "Alien", "name": "x", "canonicalName": "X"},
            {"id": "5", "label": "Person", "name": "J.", "canonicalName": "J."}, {"id": "6", "label": "Person", "name": "Dubois", "canonicalName": "MARCEL"},
            {"id": "7", "label": "Person", "name": "dewboy", "canonicalName": "DEWBOY"}, {"id": "3", "label": "Supply", "name": "canoe", "canonicalName": "CANOE"},
        ],
        "relationships": [
            {"start_node_id": "1", "end_node_id": "3", "type": "USED"}, {"start_node_id": "3", "end_node_id": "7", "type": "USED"}, {"start_node_id": "1", "end_node_id": "6", "type": "USED"},
            {"start_node_id": "1", "end_node_id": "3", "type": "LOVED"}, {"start_node_id": "1", "end_node_id": "99", "type": "USED"}, {"start_node_id": "1", "end_node_id": "3", "type": "USED"},
        ],
    }
    df = spark.createDataFrame([("c1", D, json.dumps(r)), ("c2", D, "not json")], "chunk_id string, date date, result string")
    return extract.parsed(df, "result", schema.EXTRACTION)


def test_extraction(spark):
    lex = spark.createDataFrame([("Dewboy", "Pierre Dubois")], "raw string, canonical string")
    n = extract.extracted_nodes(results(spark), ["Person", "Place", "Supply"], lex, ["unknown"], ["capt"])
    got = {r.local_id: r.canonical_name for r in n.collect()}
    assert got == {"1": "ADA MILLER", "3": "CANOE", "6": "DUBOIS", "7": "PIERRE DUBOIS"}
    s = spark.createDataFrame([("USED", ["Person"], ["Supply"])], schema.REL_SCHEMA)
    e = extract.extracted_edges(results(spark), n, s)
    assert {(r.src, r.rel_type, r.dst) for r in e.collect()} == {("ADA MILLER", "USED", "CANOE"), ("PIERRE DUBOIS", "USED", "CANOE")}
    u = {r.canonical_name: (r.name, r.aliases) for r in extract.node_upserts(n).collect()}
    assert u["ADA MILLER"] == ("Ada Miller", ["Capt. Miller"]) and u["CANOE"] == ("Canoe", [])
    assert extract.mention_upserts(n).count() == 4
    assert extract.unprocessed(spark.createDataFrame([("c1", 0), ("c2", 1)], "chunk_id string, sequence long"), spark.createDataFrame([("c1",)], "chunk_id string")).first().chunk_id == "c2"


def state(spark):
    n = [(1, "Person", "JOHN HOPPER", "John Hopper", ["Hopper"]), (2, "Person", "JON HOPPER", "Jon Hopper", None), (3, "Person", "HOPPER", "Hopper", None), (4, "Place", "FORT ALDER", "Fort Alder", None), (5, "Person", "JOHN CARTER", "John Carter", None)]
    nodes = spark.createDataFrame([(i, lab, [lab], c, m, a, None, False, None, [float(i), 1.0]) for i, lab, c, m, a in n], schema.NODES)
    edges = spark.createDataFrame([(1, "VISITED", 4, D, "c1"), (2, "VISITED", 4, D, "c2"), (1, "MET", 2, D, "c1")], schema.EDGES)
    mentions = spark.createDataFrame([(1, "c1"), (2, "c2"), (3, "c3"), (4, "c1"), (4, "c2"), (2, "c1")], schema.MENTIONS)
    chunks = spark.createDataFrame([(f"c{i}", f"text {i}", "Mason", D + dt.timedelta(days=i), i, 2, [float(i), 1.0]) for i in range(1, 6)], schema.CHUNKS)
    return schema.GraphState(nodes, edges, mentions, chunks)


def test_disambiguation(spark):
    s = resolve.disambiguate(state(spark), ["Person"], ["captain"], [], resolve.by_score(0.93), passes=1)
    people = {r.node_id: (r.canonical_name, r.aliases) for r in s.nodes.filter("label = 'Person'").collect()}
    assert people[1] == ("JOHN HOPPER", ["Hopper", "Jon Hopper"]) and 2 not in people and 5 in people
    assert rows(s.edges.select("src", "rel_type", "dst")) == ["(1, 'VISITED', 4)"] * 2  # parallel edges stay, the loop goes
    assert s.mentions.filter("node_id = 1").count() == 3
    assert schema.violations(s.nodes, ["label", "canonical_name"]).count() == 0


def test_mentions_are_resolved_nearby(spark):
    s = state(spark)
    r = extract.resolve_mentions(s.mentions, s.nodes, s.chunks, lambda asked: asked.select("node_id", "chunk_id", F.explode(F.array(F.col("candidates")[0], F.lit("Nobody"))).alias("full_name")))
    assert rows(r) == ["(3, 'c3', 1)"]
    m = mutate.reroute_mentions(s.mentions, r)
    nodes, edges = mutate.drop_unmentioned(s.nodes, s.edges, m, F.col("name") == "Hopper")
    assert nodes.count() == 4 and edges.count() == 3


def test_retrieval(spark):
    s = state(spark)
    e = {r.chunk_id: [(x.label, x.name) for x in r.entities] for r in retrieval.chunk_entities(s.chunks, s.mentions, s.nodes).collect()}
    assert e["c1"] == [("Person", "JOHN HOPPER"), ("Person", "JON HOPPER"), ("Place", "FORT ALDER")] and e["c5"] == [(None, "")]
    assert retrieval.chunk_relations(s.chunks.filter("chunk_id = 'c1'"), s.mentions, s.edges).count() == 3
    got = retrieval.vector_with_context(s.chunks, [5.0, 1.0], 2, 1, 2)
    assert {(r.chunk_id, r.retrieval) for r in got.collect()} == {("c5", "vector"), ("c4", "vector"), ("c3", "sequence")}
    assert retrieval.value_enrichment(spark.createDataFrame([("Fort Alder", 1)], "a string, n int"), s.nodes).count() == 1
    assert retrieval.context_text(s.chunks.limit(2), F.col("sequence")).first().context.count("---") == 1


def test_agent(spark):
    s = state(spark)
    visited = agent.Template("visitors", r"who visited (?P<place>[\w ]+)\?", {"place": "Place"}, lambda g, p: g.nodes.filter(F.col("canonical_name") == p["place"]).select(F.col("node_id").alias("dst")).join(g.edges, "dst").select("src").distinct())
    broken = agent.Template("broken", r"break", {}, lambda g, p: g.nodes.select("nothing"))
    a = agent.Agent(s, [visited, broken], lambda t: [float(len(t)), 1.0])
    c = a.run("Who visited fort alder?")
    assert c.params == {"place": "FORT ALDER"} and rows(c.rows) == ["(1,)", "(2,)"]
    assert a.run("break it").error
    assert a.route("what led up to it") == "sequence" and a.run("what led up to it").rows.count() > 0
    lines = [json.loads(x) for x in a.events("tell me of boats")]
    assert lines[0]["tool"] == "vector" and lines[-1] == {"type": "done"} and len(lines) == 7
    assert a.resolve(agent.Slot("d", "date", ""), [1.0, 1.0]) == D + dt.timedelta(days=1)
    v = agent.hashed_embedder(8)("a b a")
    assert abs(sum(x * x for x in v) - 1) < 1e-9


def test_streams(spark, tmp_path):
    src, out, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    kind = "entry_no long, author string, date date, body string"
    spark.createDataFrame([(1, "a", None, "x y\n\nz"), (2, "a", None, None)], kind).write.parquet(src)
    for text in (None, "new"):
        if text:
            spark.createDataFrame([(1, "a", None, text)], kind).write.mode("append").parquet(src)
        q = ingest.upsert_stream(ingest.chunk_stream(spark.readStream.schema(kind).parquet(src), 2), out, cp, ["entry_no", "segment"])
        q.awaitTermination(60)
    got = ingest.latest(spark.read.parquet(out), ["entry_no", "segment"])
    assert {(r.segment, r.text) for r in got.collect()} == {(0, "new"), (1, "z")}
    e = spark.createDataFrame([(dt.datetime(2024, 1, 1, 0, m), "u") for m in (0, 1, 30)], "ts timestamp, u string")
    w = ingest.windowed(e, "ts", "10 minutes", "5 minutes", None, ["u"], [F.count("*").alias("n")])
    assert sorted(r.n for r in w.collect()) == [1, 2]
    assert sorted(r.n for r in ingest.sessions(e, "ts", "10 minutes", "5 minutes", ["u"], [F.count("*").alias("n")]).collect()) == [1, 2]


def test_kept_first_and_last_of_equal_line_numbers(spark, tmp_path):
    """Of equal line numbers the line that the file holds first counts, as in the SQL read by one thread; null keys and numbers as there."""
    import duckdb

    from quern.plans import q_build

    at, con = str(tmp_path / "lineitem.parquet"), duckdb.connect()
    con.sql("set threads = 1")
    con.sql(f"copy (select * from (select i % 997 as l_orderkey, (hash(i) % 100000)::bigint as l_partkey, case when i % 997 = 5 or i % 11 = 0 then null else (i % 3)::int end as l_linenumber from range(40000) t(i)) union all select null, 7, 1) to '{at}' (row_group_size 2048)")
    con.sql(f"create view lineitem as select * from '{at}'")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "40k")  # the lines of an order come from many tasks
    try:
        got = rows(q_build.kept_first_and_last(spark, str(tmp_path)).select("l_orderkey", "first_part", "last_part"))
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was)
    assert got == sorted(map(str, con.sql(q_build.SQL["kept_first_and_last"]).fetchall()))
    assert rows(retrieval.deduplicated(spark.createDataFrame([(1, 2), (1, 1)], "k int, v int"), ["k"], [F.asc("v")])) == ["(1, 1)"]
