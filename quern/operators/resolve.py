"""Entity resolution: candidates, decisions, components, merge."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import mutate
from quern.operators import similarity as S
from quern.operators.components import connected_components
from quern.schema import GraphState


def by_score(cutoff: float = 0.95):
    """A decider without a model: the same if the names are spelled alike enough; the longer name is canonical."""

    def decide(pairs: DataFrame) -> DataFrame:
        same = S.jaro_winkler(F.lower("name1"), F.lower("name2")) >= cutoff
        longer = F.when(F.length("name2") > F.length("name1"), F.col("name2")).otherwise(F.col("name1"))
        return pairs.select("label", "name1", "name2", same.alias("same_entity"), F.upper(longer).alias("canonical_name"))

    return decide


def candidates(state: GraphState, labels: list[str], titles: list[str], unambiguous: list[str], graph: bool = True, persons: tuple[str, ...] = ("Person",)) -> DataFrame:
    """(label, name1, name2) from spelling, containment, sound, aliases and, if ``graph``, shared neighbourhoods.

    Titles are stripped from, and single words refused for, names of the labels ``persons`` alone.
    """
    n = state.nodes.filter(F.col("label").isin(labels))
    names = n.select("label", "name")
    found = [*[f(names, titles=titles, titled=list(persons)) for f in (S.spelling_candidates, S.containment_candidates, S.sound_candidates)], S.alias_candidates(n.select("label", "name", "aliases"))]
    if graph:
        sim = S.node_similarity(S.co_occurrence(state.mentions), labels=n)
        a = n.select(F.col("node_id").alias("a"), "label", F.col("name").alias("name1"))
        b = n.select(F.col("node_id").alias("b"), "label", F.col("name").alias("name2"))
        found.append(sim.join(a, ["a", "label"]).join(b, ["b", "label"]).select("label", "name1", "name2"))
    every = S.all_candidates(*found)
    person = F.col("label").isin(list(persons))
    return S.admissible(every.filter(person), unambiguous).unionByName(every.filter(~person))


def merge_pairs(state: GraphState, pairs: DataFrame) -> GraphState:
    """Nodes linked by ``pairs`` (label, name1, name2, canonical_name) become one, chosen name included.

    A node outside a component that owns its chosen name is taken in, so (label, canonical_name) stays unique.
    """
    ids = state.nodes.select("node_id", "label", "name")
    e = pairs.join(ids.select(F.col("node_id").alias("src"), "label", F.col("name").alias("name1")), ["label", "name1"]).join(ids.select(F.col("node_id").alias("dst"), "label", F.col("name").alias("name2")), ["label", "name2"])
    comp = connected_components(e)
    votes = e.join(comp.withColumnRenamed("node", "src"), "src").select("component", F.col("canonical_name").alias("canonical"))
    names = comp.join(state.nodes.select(F.col("node_id").alias("node"), F.upper("name").alias("name")), "node").select("component", "name")
    chosen = mutate.chosen_names(votes, names)
    more = mutate.absorb(comp, chosen, state.nodes)
    links = comp.select(F.col("node").alias("src"), F.col("component").alias("dst")).unionByName(more)
    whole = connected_components(links)
    name_of = chosen.join(whole.select(F.col("node").alias("component"), F.col("component").alias("new_id")), "component").groupBy("new_id").agg(F.max_by("canonical_name", F.struct(F.length("canonical_name"), "canonical_name")).alias("canonical_name"))
    remap = mutate.remap_of(whole)
    nodes = mutate.merge_nodes(state.nodes, remap, name_of)
    moved = state.mentions.join(remap.withColumnRenamed("old_id", "node_id"), "node_id", "left").select(F.coalesce("new_id", "node_id").alias("node_id"), *[c for c in state.mentions.columns if c != "node_id"])
    return GraphState(nodes, mutate.remap_edges(state.edges, remap), moved, state.chunks)


def disambiguate(state: GraphState, labels: list[str], titles: list[str], unambiguous: list[str], decide=None, passes: int = 2, persons: tuple[str, ...] = ("Person",)) -> GraphState:
    """Names and aliases first, then also the graph, whose neighbourhoods the first merges have brought together."""
    decide = decide or by_score()
    for p in range(passes):
        decided = decide(candidates(state, labels, titles, unambiguous, graph=p > 0, persons=persons)).filter("same_entity")
        state = merge_pairs(state, decided)
    return state
