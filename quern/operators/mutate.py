"""Changes to the graph's tables, as functions from tables to tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_NONE = F.array


def upsert_last(old: DataFrame, new: DataFrame, keys: list[str], order: list[Column] | None = None) -> DataFrame:
    """Rows of ``new`` replace those of ``old`` with the same key; of several new ones the last in ``order`` wins."""
    order = order or [F.col(c).desc() for c in new.columns if c not in keys]
    last = new.withColumn("_r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("_r = 1").drop("_r")
    return old.join(last.select(*keys), keys, "left_anti").unionByName(last)


def upsert_first(old: DataFrame, new: DataFrame, keys: list[str], order: str) -> DataFrame:
    """Rows of ``new`` whose key ``old`` lacks are added; of several the first by ``order`` (ON CREATE SET)."""
    first = new.groupBy(*keys).agg(F.min_by(F.struct(*[F.col(c) for c in new.columns if c not in keys]), F.struct(F.col(order), *[F.col(c) for c in sorted(new.columns) if c not in keys])).alias("_v"))
    first = first.select(*keys, "_v.*").select(*new.columns)
    return old.unionByName(first.join(old.select(*keys), keys, "left_anti"))


def edge_upsert(edges: DataFrame) -> DataFrame:
    """One edge for each (src, rel_type, dst, chunk_id), with the date of the first writer."""
    return edges.groupBy("src", "rel_type", "dst", "chunk_id").agg(F.min("date").alias("date")).select("src", "rel_type", "dst", "date", "chunk_id")


def with_label(nodes: DataFrame, when: Column, label: str) -> DataFrame:
    return nodes.withColumn("labels", F.when(when, F.array_union(F.coalesce("labels", F.array().cast("array<string>")), F.array(F.lit(label)))).otherwise(F.col("labels")))


def append_aliases(nodes: DataFrame, aliases: DataFrame, keys: list[str], plausible: Column | None = None) -> DataFrame:
    """Aliases (*keys, alias) join their node's list, each once, sorted behind the old ones.

    Left out: blank ones, the display name, the canonical name whatever the case, and those with an "&".
    """
    guard = (F.trim("alias") != "") & ~F.col("alias").contains("&")
    a = aliases.filter(guard if plausible is None else guard & plausible)
    kept = nodes.select(*keys, "name", "canonical_name").join(a, keys).filter((F.col("alias") != F.col("name")) & (F.upper("alias") != F.col("canonical_name")))
    more = kept.groupBy(*keys).agg(F.array_sort(F.collect_set("alias")).alias("_more"))
    none = F.array().cast("array<string>")
    return nodes.join(more, keys, "left").withColumn("aliases", F.array_union(F.coalesce("aliases", none), F.coalesce("_more", none))).drop("_more")


def reroute_mentions(mentions: DataFrame, resolved: DataFrame) -> DataFrame:
    """Mentions (node_id, chunk_id) move as ``resolved`` (node_id, chunk_id, new_id) says; what coincides is one."""
    return mentions.join(resolved, ["node_id", "chunk_id"], "left").select(F.coalesce("new_id", "node_id").alias("node_id"), "chunk_id").distinct()


def drop_unmentioned(nodes: DataFrame, edges: DataFrame, mentions: DataFrame, when: Column, reroute: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Nodes where ``when`` holds and no mention is left go, with every edge of theirs.

    ``reroute`` (old_id, new_id) saves their edges: they move to the new node.
    """
    gone = nodes.filter(when).join(mentions, "node_id", "left_anti").select("node_id")
    kept = nodes.join(gone, "node_id", "left_anti")
    if reroute is not None:
        edges = remap_edges(edges, reroute)
    for end in ("src", "dst"):
        edges = edges.join(gone.select(F.col("node_id").alias(end)), end, "left_anti").select(*edges.columns)
    return kept, edges


def relabel(nodes: DataFrame, source: str, target: str, terms: list[str]) -> DataFrame:
    """``source`` nodes whose name holds one of ``terms`` (as a substring) become ``target``, unless one of that name exists."""
    has = F.lit(False)
    for t in terms:
        has = has | F.contains(F.lower("canonical_name"), F.lit(t))
    taken = nodes.filter(F.col("label") == target).select("canonical_name", F.lit(True).alias("_taken")).distinct()
    return nodes.join(taken, "canonical_name", "left").withColumn("label", F.when((F.col("label") == source) & has & F.col("_taken").isNull(), F.lit(target)).otherwise(F.col("label"))).select(*nodes.columns)


def flagged(name: Column, block: list[str], safe: list[str], classified: Column | None = None) -> Column:
    """Blocked or so classified, and not safe: the safe list is applied last. Null classifications say nothing."""
    hit = name.isin(block) if block else F.lit(False)
    if classified is not None:
        hit = hit | F.coalesce(classified, F.lit(False))
    return hit & ~(name.isin(safe) if safe else F.lit(False))


def membership(nodes: DataFrame, members: DataFrame, flag: str = "flag") -> DataFrame:
    """``flag`` true for members (canonical_name), absent for others: stale flags are cleared."""
    m = members.select("canonical_name", F.lit(True).alias("_m")).distinct()
    return nodes.drop(flag).join(m, "canonical_name", "left").withColumn(flag, F.col("_m")).drop("_m")


def missing_members(nodes: DataFrame, members: DataFrame) -> DataFrame:
    return members.select("canonical_name").distinct().join(nodes.select("canonical_name"), "canonical_name", "left_anti").orderBy("canonical_name")


def remap_edges(edges: DataFrame, remap: DataFrame) -> DataFrame:
    """Both ends follow ``remap`` (old_id, new_id).

    An edge that *became* a loop goes; one that was a loop stays.  Parallel edges stay: edges are a multiset.
    """
    a, b = (remap.select(F.col("old_id").alias(e), F.col("new_id").alias(f"_{e}")) for e in ("src", "dst"))
    moved = edges.join(a, "src", "left").join(b, "dst", "left")
    moved = moved.withColumns({"_s": F.coalesce("_src", "src"), "_d": F.coalesce("_dst", "dst")})
    moved = moved.filter((F.col("_s") != F.col("_d")) | (F.col("src") == F.col("dst")))
    return moved.withColumns({"src": F.col("_s"), "dst": F.col("_d")}).select(*edges.columns)


def merge_nodes(nodes: DataFrame, remap: DataFrame, canonical: DataFrame | None = None) -> DataFrame:
    """Members of a group become its new_id: aliases are the union of all names and aliases but the display name.

    Other properties are those of the smallest id.  ``canonical`` (new_id, canonical_name) renames groups.
    """
    none = F.array().cast("array<string>")
    n = nodes.join(remap.withColumnRenamed("old_id", "node_id"), "node_id", "left").withColumn("new_id", F.coalesce("new_id", "node_id"))
    rest = [c for c in nodes.columns if c not in ("node_id", "aliases")]
    g = n.groupBy("new_id").agg(F.min_by(F.struct(*rest), "node_id").alias("v"), F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", none), F.array("name"))))).alias("all"), F.count("*").alias("size"))
    out = g.select(F.col("new_id").alias("node_id"), "v.*", "all", "size")
    if canonical is not None:
        out = out.join(canonical.select(F.col("new_id").alias("node_id"), F.col("canonical_name").alias("_c")), "node_id", "left").withColumn("canonical_name", F.coalesce("_c", "canonical_name")).drop("_c")
    merged = F.array_sort(F.filter(F.array_except("all", F.array("name")), lambda x: x.isNotNull()))
    return out.withColumn("aliases", merged).drop("all", "size").select(*nodes.columns)


def remap_of(components: DataFrame) -> DataFrame:
    """(old_id, new_id) from (node, component): components of one node change nothing."""
    return components.filter("node <> component").select(F.col("node").alias("old_id"), F.col("component").alias("new_id"))


def chosen_names(votes: DataFrame, names: DataFrame) -> DataFrame:
    """(component, canonical_name): the most voted name (then longest, then last by text), else the longest of the members.

    ``votes`` is (component, canonical), ``names`` (component, name).
    """
    v = votes.dropna().groupBy("component", "canonical").agg(F.count("*").alias("n"))
    v = v.groupBy("component").agg(F.max_by("canonical", F.struct("n", F.length("canonical"), "canonical")).alias("voted"))
    longest = names.dropna().groupBy("component").agg(F.max_by("name", F.struct(F.length("name"), "name")).alias("longest"))
    return longest.join(v, "component", "full_outer").select("component", F.coalesce("voted", "longest").alias("canonical_name"))


def absorb(components: DataFrame, chosen: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (src, dst) that pull a node that already owns a component's chosen name into it, so that names stay unique."""
    owner = nodes.select("node_id", "label", "canonical_name")
    label = components.join(nodes.select(F.col("node_id").alias("node"), "label"), "node").groupBy("component").agg(F.min("label").alias("label"))
    want = chosen.join(label, "component")
    return want.join(owner, ["label", "canonical_name"]).filter("node_id <> component").select(F.col("component").alias("src"), F.col("node_id").alias("dst"))


def check_direction(edges: DataFrame, rel_schema: DataFrame) -> DataFrame:
    """Edges with (src_labels, dst_labels) columns ``src_l``, ``dst_l``: valid ones stay, those valid only reversed turn, others go.

    ``rel_schema`` is (rel_type, src_labels, dst_labels); an unknown type is not valid either way.
    """
    e = edges.join(F.broadcast(rel_schema), "rel_type", "left")  # one row for each type of the schema
    no = F.lit(False)
    ok = F.coalesce(F.arrays_overlap("src_l", "src_labels") & F.arrays_overlap("dst_l", "dst_labels"), no)
    back = F.coalesce(F.arrays_overlap("dst_l", "src_labels") & F.arrays_overlap("src_l", "dst_labels"), no)
    e = e.withColumns({"_ok": ok, "_back": back}).filter("_ok or _back")
    turn = ~F.col("_ok")
    swap = {a: F.when(turn, F.col(b)).otherwise(F.col(a)) for a, b in (("src", "dst"), ("dst", "src"), ("src_l", "dst_l"), ("dst_l", "src_l"))}
    return e.withColumns(swap).withColumn("flipped", turn).select(*edges.columns, "flipped")


def conflicting(nodes: DataFrame, source: str, target: str) -> DataFrame:
    """(old_id, new_id): ``source`` nodes whose canonical name a ``target`` node has, to be merged into it."""
    a = nodes.filter(F.col("label") == source).select(F.col("node_id").alias("old_id"), "canonical_name")
    b = nodes.filter(F.col("label") == target).groupBy("canonical_name").agg(F.min("node_id").alias("new_id"))
    return a.join(b, "canonical_name").select("old_id", "new_id")


def absorb_nodes(nodes: DataFrame, remap: DataFrame) -> DataFrame:
    """Nodes of ``remap`` (old_id, new_id) go; what they were called joins the aliases of their new node, which keeps the rest."""
    none = F.array().cast("array<string>")
    gone = nodes.join(remap.withColumnRenamed("old_id", "node_id"), "node_id")
    more = gone.groupBy("new_id").agg(F.array_distinct(F.flatten(F.collect_list(F.concat(F.coalesce("aliases", none), F.array("name", "canonical_name"))))).alias("_more"))
    kept = nodes.join(remap.select(F.col("old_id").alias("node_id")), "node_id", "left_anti").join(more.withColumnRenamed("new_id", "node_id"), "node_id", "left")
    all_ = F.array_sort(F.filter(F.array_except(F.array_union(F.coalesce("aliases", none), "_more"), F.array("name", "canonical_name")), lambda x: x.isNotNull()))
    return kept.withColumn("aliases", F.when(F.col("_more").isNull(), F.col("aliases")).otherwise(all_)).select(*nodes.columns)


def rename_or_merge(nodes: DataFrame, renames: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, remap) after ``renames`` (node_id, new_name) of canonical names.

    The old name joins the aliases.  Where another node of the label has the new name already, the renamed one is merged
    into it (``remap`` is old_id, new_id, for edges and mentions); of several renamed alike the smallest id takes the name.
    """
    none = F.array().cast("array<string>")
    r = nodes.select("node_id", "label", "canonical_name").join(renames, "node_id").filter("new_name <> canonical_name")
    owner = nodes.join(r.select("node_id"), "node_id", "left_anti").groupBy("label", F.col("canonical_name").alias("new_name")).agg(F.min("node_id").alias("_owner"))
    first = r.groupBy("label", "new_name").agg(F.min("node_id").alias("_first"))
    to = r.join(owner, ["label", "new_name"], "left").join(first, ["label", "new_name"]).withColumn("new_id", F.coalesce("_owner", "_first"))
    remap = to.filter("new_id <> node_id").select(F.col("node_id").alias("old_id"), "new_id")
    named = to.filter("new_id = node_id").select("node_id", "new_name")
    n = nodes.join(named, "node_id", "left")
    n = n.withColumn("aliases", F.when(F.col("new_name").isNull(), F.col("aliases")).otherwise(F.array_sort(F.array_except(F.array_union(F.coalesce("aliases", none), F.array("canonical_name")), F.array("new_name")))))
    n = n.withColumn("canonical_name", F.coalesce("new_name", "canonical_name")).select(*nodes.columns)
    return absorb_nodes(n, remap), remap


def fixed_node(nodes: DataFrame, node_id, label: str, name: str, canonical_name: str, aliases: list[str]) -> DataFrame:
    """One node is there, with these aliases besides those that it had, but its own names."""
    here = (F.col("label") == label) & (F.col("canonical_name") == canonical_name)
    own, more = F.array(F.lit(name), F.lit(canonical_name)), F.array(*map(F.lit, aliases)).cast("array<string>")
    none = F.array().cast("array<string>")
    old = nodes.filter(here)
    new = nodes.sparkSession.createDataFrame([(node_id, label, name, canonical_name)], "node_id long, label string, name string, canonical_name string").withColumn("aliases", none)
    both = old.unionByName(new.join(old.select("label", "canonical_name"), ["label", "canonical_name"], "left_anti"), allowMissingColumns=True)
    both = both.withColumns({"name": F.lit(name), "aliases": F.array_sort(F.array_except(F.array_union(F.coalesce("aliases", none), more), own))})
    return nodes.filter(~F.coalesce(here, F.lit(False))).unionByName(both.select(*nodes.columns))


def written_back(nodes: DataFrame, values: DataFrame, key: str = "node_id") -> DataFrame:
    """Columns of ``values`` (one row for a key) overwrite those of ``nodes``, or are added; other nodes keep theirs."""
    names = [c for c in values.columns if c != key]
    v = values.select(key, F.lit(True).alias("_has"), *[F.col(c).alias(f"_{c}") for c in names])
    out = nodes.join(v, key, "left")
    for c in names:
        old = F.col(c) if c in nodes.columns else F.lit(None)
        out = out.withColumn(c, F.when(F.col("_has"), F.col(f"_{c}")).otherwise(old))
    return out.drop("_has", *[f"_{c}" for c in names])


def counts(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """(created, updated, deleted, kept): what a mutation did to rows of unique ``keys``."""
    rest = [c for c in before.columns if c not in keys]
    a = before.select(*keys, F.struct(*rest).alias("_a"), F.lit(True).alias("_in"))
    b = after.select(*keys, F.struct(*rest).alias("_b"), F.lit(True).alias("_out"))
    both = a.join(b, keys, "full_outer")
    same = F.col("_a").eqNullSafe(F.col("_b"))
    stays = F.col("_in").isNotNull() & F.col("_out").isNotNull()
    return both.agg(F.count_if(F.col("_in").isNull()).alias("created"), F.count_if(stays & ~same).alias("updated"), F.count_if(F.col("_out").isNull()).alias("deleted"), F.count_if(stays & same).alias("kept"))
