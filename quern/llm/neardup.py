"""Near-duplicates by MinHash with tensored banding, confirmed on full shingle sets, joined into groups.

Banding of ``k`` minhashes in ``L`` tables needs ``k * L`` hash functions.  Tensoring needs about the root of that: two
collections of ``GROUPS`` groups of ``PER_GROUP`` minhashes each, and a table for every pair of a group of the one with a
group of the other, so ``GROUPS ** 2`` tables of ``2 * PER_GROUP`` minhashes from ``2 * GROUPS * PER_GROUP`` functions.
Two sets of similarity s meet in a table with probability ``(1 - (1 - s**PER_GROUP)**GROUPS)**2``: 0.9998 at s = 0.85.

No pairs are made within a table's bucket before it is known what they are for:

1. equal sets are one node (a star to the smallest id);
2. for nodes in buckets of three or more, the shingles that no other such node has are counted: the fewer, the more
   central a node, and no shared set can be larger than the rest;
3. each node is compared with the most central node of its buckets, and components are formed;
4. nodes whose component still differs from that of another bucket's most central node are compared with that;
5. what is left in a bucket are nodes of different components of which neither is the most central. The differences of
   their sets to the central one give a pair's own difference exactly. One of a pair is further from the central set
   than a link reaches, so if the pair is linked, about half of the other's differences are its differences too, and of
   its own at most ``n * (100 - percent) / percent`` are not the other's. A node's rarest differences, one more than may
   be missing, thus hold one that a linked node has among its own: pairs are made by these, never of two nodes of the
   component that most nodes with a difference are in, and compared exactly, unless the counts of 2. or sizes rule them out.

So a bucket of n copies costs n comparisons, also if a few strangers are in it, and every pair that meets in a bucket is
compared, linked or ruled out.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.llm.textscan import BLANK, chunks, mix, scan
from quern.llm.udfs import text_udf
from quern.operators.components import connected_components
from quern.operators.lineage import cut

GROUPS, PER_GROUP = 10, 3
_SLICE = 1 << 15
U = np.uint64
_HASHES = 2 * GROUPS * PER_GROUP
_A = mix(np.arange(1, _HASHES + 1, dtype=U) * U(0x2545F4914F6CDD1D)) | U(1)
_B = mix(np.arange(1, _HASHES + 1, dtype=U) * U(0x9E3779B97F4A7C15) + U(77))
_C = (U(0x9E3779B97F4A7C15), U(0xC2B2AE3D27D4EB4F), U(0x165667B19E3779F9))


def shingle_sets(texts: list[bytes | None], width: int) -> list[np.ndarray]:
    """Each text's distinct shingles as sorted 64-bit hashes."""
    out: list[np.ndarray] = []
    for lo, hi in chunks(texts):
        s = scan(texts[lo:hi], BLANK, lower=True)
        h = s.hashes()
        full = np.full(max(0, len(h) - width + 1), U(width))
        for j in range(width):
            full = mix(full * _C[0] + h[j : len(h) - width + 1 + j] + U(j))
        for a, b in zip(s.first[:-1].tolist(), s.first[1:].tolist(), strict=True):
            n = b - a
            if n >= width:
                out.append(np.unique(full[a : b - width + 1]))
            elif n:
                x = np.full(1, n, U) * _C[1]
                for j in range(a, b):
                    x = mix(x * _C[2] + h[j : j + 1])
                out.append(x)
            else:
                out.append(np.empty(0, U))
    return out


def signature(of: np.ndarray) -> np.ndarray:
    """``2 * GROUPS`` group hashes of a non-empty set."""
    low = np.full(_HASHES, ~U(0))
    for i in range(0, len(of), _SLICE):
        part = of[i : i + _SLICE]
        for j in range(_HASHES):
            low[j] = min(low[j], (part * _A[j] + _B[j]).min())
    g = low.reshape(2 * GROUPS, PER_GROUP)
    out = np.arange(1, 2 * GROUPS + 1, dtype=U)
    for j in range(PER_GROUP):
        out = mix(out * _C[0] + g[:, j])
    return out.view(np.int64)


_SKETCH = "struct<n:bigint,a:bigint,b:bigint,sig:array<bigint>>"
_SKETCH_ARROW = pa.struct([("n", pa.int64()), ("a", pa.int64()), ("b", pa.int64()), ("sig", pa.list_(pa.int64()))])


def _sketcher(width: int):
    def work(texts: list[bytes | None]) -> pa.Array:
        out = []
        for s in shingle_sets(texts, width):
            if len(s):
                out.append({"n": len(s), "a": int(s.sum(dtype=U).view(np.int64)), "b": int(np.bitwise_xor.reduce(mix(s)).view(np.int64)), "sig": signature(s)})
            else:
                out.append({"n": 0, "a": 0, "b": 0, "sig": []})
        return pa.array(out, _SKETCH_ARROW)

    return work


def _compared(pairs: DataFrame, texts: DataFrame, width: int, percent: int) -> DataFrame:
    """(x, y, shared, total) of pairs (x, y); ``texts`` is (id, text). An id with several texts is as near as the nearest."""
    both = pairs.join(texts.select(F.col("id").alias("x"), F.col("text").alias("tx")), "x")
    both = both.join(texts.select(F.col("id").alias("y"), F.col("text").alias("ty")), "y")

    def work(tx: pa.Array, ty: pa.Array) -> pa.Array:
        @lru_cache(64)
        def sets(t: bytes) -> np.ndarray:
            return shingle_sets([t], width)[0]

        out = []
        for a, b in zip(tx.cast(pa.binary()).to_pylist(), ty.cast(pa.binary()).to_pylist(), strict=True):
            p, q = sets(a), sets(b)
            shared = len(np.intersect1d(p, q, assume_unique=True))
            out.append({"shared": shared, "total": len(p) + len(q) - shared})
        return pa.array(out, pa.struct([("shared", pa.int64()), ("total", pa.int64())]))

    work.__annotations__ = {"tx": pa.Array, "ty": pa.Array, "return": pa.Array}
    got = both.select("x", "y", F.arrow_udf(work, "struct<shared:bigint,total:bigint>").asNondeterministic()("tx", "ty").alias("r")).select("x", "y", "r.shared", "r.total")
    nearest = F.max_by(F.struct("shared", "total"), F.col("shared") / F.col("total")).alias("r")
    return cut(got.groupBy("x", "y").agg(nearest).select("x", "y", "r.shared", "r.total", (100 * F.col("r.shared") >= percent * F.col("r.total")).alias("linked")))


def _differences(pairs: DataFrame, texts: DataFrame, width: int) -> DataFrame:
    """(id, top_id, n, top_n, diff): sizes of both sets, and the shingles that one of the two has and the other has not.

    An id with several texts gives a row for each, all against the other's smallest text.
    """
    one = texts.groupBy("id").agg(F.min("text").alias("ty")).select(F.col("id").alias("top_id"), "ty")
    both = pairs.join(texts.select("id", F.col("text").alias("tx")), "id").join(one, "top_id")

    def work(tx: pa.Array, ty: pa.Array) -> pa.Array:
        @lru_cache(64)
        def sets(t: bytes) -> np.ndarray:
            return shingle_sets([t], width)[0]

        rows = zip(tx.cast(pa.binary()).to_pylist(), ty.cast(pa.binary()).to_pylist(), strict=True)
        return pa.array([{"n": len(sets(a)), "top_n": len(sets(b)), "diff": np.setxor1d(sets(a), sets(b), assume_unique=True).view(np.int64)} for a, b in rows], pa.struct([("n", pa.int64()), ("top_n", pa.int64()), ("diff", pa.list_(pa.int64()))]))

    work.__annotations__ = {"tx": pa.Array, "ty": pa.Array, "return": pa.Array}
    return both.select("id", "top_id", F.arrow_udf(work, "struct<n:bigint,top_n:bigint,diff:array<bigint>>").asNondeterministic()("tx", "ty").alias("r")).select("id", "top_id", "r.*")


def near_duplicates(docs: DataFrame, width: int = 3, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) for each row of ``docs``.

    Words are runs of other than x20 and x09-x0D, A-Z lower-cased; a set is the distinct ``width``-word shingles, or the
    whole sequence if it is shorter.  Documents are linked if ``100 * shared >= percent * total`` of their full sets;
    ``component_id`` is the smallest id reachable, ``kept`` says that it is the row's own.  Null, empty and blank texts
    have empty sets and are linked with nothing.  Rows with the same id are one document, with the links of all its texts.
    A null id takes no part: its component is null and it is kept.  An empty table gives no rows.
    """
    rows = docs.select(F.col(id_col).alias("id"), text_udf(_SKETCH, _sketcher(width))(F.col(text_col)).alias("s"))
    rows = cut(rows.select("id", "s.n", "s.a", "s.b", "s.sig"))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).dropna()
    linkable = rows.filter("id is not null and n > 0")
    # 1. one node for each distinct set; its other ids hang on the smallest
    nodes = linkable.groupBy("a", "b", "n").agg(F.min("id").alias("id"), F.first("sig").alias("sig"))
    nodes = cut(nodes)
    same = linkable.select("id", "a", "b", "n").join(nodes.select(F.col("id").alias("rep"), "a", "b", "n"), ["a", "b", "n"]).filter("id <> rep").select(F.col("id").alias("src"), F.col("rep").alias("dst")).distinct()
    edges = cut(same)
    i, j = F.lit(GROUPS - 1), F.lit(2 * GROUPS - 1)
    keys = F.flatten(F.transform(F.sequence(F.lit(0), i), lambda p: F.transform(F.sequence(F.lit(GROUPS), j), lambda q: F.xxhash64(p, q, F.element_at("sig", p + 1), F.element_at("sig", q + 1)))))
    by_key = Window.partitionBy("key").orderBy("id")
    met = nodes.select("id", "n", F.explode(keys).alias("key"))
    met = met.withColumn("_a", F.lag("id").over(by_key)).withColumn("_z", F.lead("id").over(by_key))
    met = met.filter("_a is not null or _z is not null")  # only what shares a bucket is stored
    bucket = Window.partitionBy("key")
    shared = cut(met.select("key", "id", "n", F.count("*").over(bucket).alias("size"), F.min("n").over(bucket).alias("least_n")))
    fits = lambda p, q: 100 * F.least(p, q) >= percent * F.greatest(p, q)  # noqa: E731  necessary, from the sizes alone
    # texts are needed of nodes in buckets alone; they are looked up once
    involved = shared.select("id").distinct()
    texts = cut(texts.join(involved, "id", "left_semi").distinct())
    # 2. shingles of one node alone
    crowd = shared.filter("size > 2").select("id").distinct()
    hashed = texts.join(crowd, "id", "left_semi").select("id", F.explode(text_udf("array<bigint>", lambda t: pa.array([x.view(np.int64) for x in shingle_sets(t, width)], pa.list_(pa.int64())))("text")).alias("h"))
    alone = hashed.groupBy("h").agg(F.min("id").alias("id"), F.max("id").alias("_z")).filter("id = _z").groupBy("id").agg(F.count("*").alias("u"))
    alone = cut(alone)
    central = Window.partitionBy("key").orderBy("u", "id").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    ranked = shared.join(alone, "id", "left").withColumn("u", F.coalesce("u", F.lit(0)))
    ranked = ranked.withColumn("top", F.first(F.struct("u", "id", "n")).over(central))
    member = cut(ranked.filter("top.id <> id"))
    star = member.filter(fits(F.col("n"), F.col("top.n"))).select(F.col("id").alias("x"), F.col("top.id").alias("y"), F.col("top.u").alias("yu")).distinct()
    star = cut(star)

    def labelled(of: DataFrame, comp: DataFrame, col: str, name: str) -> DataFrame:
        c = comp.select(F.col("node").alias(col), F.col("component").alias(name))
        return of.join(c, col, "left").withColumn(name, F.coalesce(name, col))

    def linked(done: DataFrame) -> DataFrame:
        return done.filter("linked").select(F.col("x").alias("src"), F.col("y").alias("dst"))

    # 3. one comparison for each node
    done = _compared(star.groupBy("x").agg(F.min_by("y", F.struct("yu", "y")).alias("y")), texts, width, percent)
    edges = edges.union(linked(done))
    comp = connected_components(edges)
    # 4. the other buckets' central nodes, where that could still join something
    more = labelled(labelled(star.select("x", "y"), comp, "x", "cx"), comp, "y", "cy").filter("cx <> cy").select("x", "y").join(done.select("x", "y"), ["x", "y"], "left_anti")
    extra = _compared(more, texts, width, percent)
    done = done.union(extra)
    if not extra.filter("linked").isEmpty():
        edges = edges.union(linked(extra))
        comp = connected_components(edges)
    # 5. members of a bucket that are in different components
    reach = F.col("n") - F.col("u")
    held = member.filter((F.col("size") > 2) & (100 * reach >= percent * (F.col("n") + F.greatest("least_n", reach) - reach)))
    held = labelled(held.select("key", "id", F.col("top.id").alias("top_id"), reach.alias("e")), comp, "id", "c")
    held = held.withColumn("_a", F.min("c").over(bucket)).withColumn("_z", F.max("c").over(bucket)).filter("_a <> _z")
    held = cut(held.groupBy("id", "top_id", "c").agg(F.max("e").alias("e")))
    # sets differ from each other by what their differences to the central set do not share: exact, and short for copies
    diffs = _differences(held.select("id", "top_id"), texts, width).join(held, ["id", "top_id"])
    # 100 * shared >= percent * total, with total = shared + differing and 2 * shared = sizes - differing
    far = F.size("diff") * (100 + percent) > (100 - percent) * (F.col("n") + F.col("top_n"))
    diffs = cut(diffs.select("*", far.alias("far"), F.size("diff").alias("d"), F.monotonically_increasing_id().alias("row")))
    straight = labelled(diffs.filter("not far").select("id", "top_id", "c"), comp, "top_id", "top_c").filter("c <> top_c").select(F.col("id").alias("src"), F.col("top_id").alias("dst"))
    # a node that is not far shares more than (d + (100 - percent) / (100 + percent) * (top_n - n)) / 2 differences with one that is
    common = F.floor((F.col("d") * (100 + percent) + (100 - percent) * (F.col("top_n") - F.col("n"))) / (2 * (100 + percent)))
    enough = F.when(F.col("far"), F.floor(F.col("n") * (100 - percent) / percent) + 1).otherwise(F.col("d") - common)
    same_h = Window.partitionBy("top_id", "h")
    first = diffs.select("row", "top_id", "id", "c", "n", "e", "d", "far", enough.alias("enough"), F.explode("diff").alias("h"))
    first = first.select("*", F.count("*").over(same_h).alias("m"), F.min("c").over(same_h).alias("_a"), F.max("c").over(same_h).alias("_z"))
    first = first.withColumn("r", F.row_number().over(Window.partitionBy("row").orderBy("m", "h"))).filter("r <= enough and _a <> _z")
    first = cut(first.select("top_id", "id", "c", "n", "e", "d", "far", "h"))
    most_in = first.groupBy("top_id", "h", "c").agg(F.count("*").alias("m")).groupBy("top_id", "h").agg(F.count("*").alias("m"), F.max_by("c", F.struct("m", "c")).alias("most_c"))
    first = cut(first.join(most_in.filter("m > 1").drop("m"), ["top_id", "h"]))
    p, q = first.filter("c <> most_c").alias("p"), first.alias("q")
    most = F.least("p.e", "q.e")
    could = 100 * most >= percent * (F.col("p.n") + F.col("q.n") - most)
    allowed = (100 - percent) * (F.col("p.n") + F.col("q.n"))
    near = F.abs(F.col("p.d") - F.col("q.d")) * (100 + percent) <= allowed
    apart = (F.col("p.c") != F.col("q.c")) & (F.col("p.far") | F.col("q.far"))
    once = (F.col("q.c") == F.col("q.most_c")) | (F.col("p.id") > F.col("q.id"))
    last = p.join(q, (F.col("p.top_id") == F.col("q.top_id")) & (F.col("p.h") == F.col("q.h")) & apart & once & could & near)
    last = last.select("p.top_id", F.col("p.id").alias("x"), F.col("q.id").alias("y")).distinct()
    p, q = (diffs.select("top_id", F.col("id").alias(i), "n", "diff").alias(a) for i, a in (("x", "p"), ("y", "q")))
    last = last.join(p, ["top_id", "x"]).join(q, ["top_id", "y"])
    differing = F.size("p.diff") + F.size("q.diff") - 2 * F.size(F.array_intersect("p.diff", "q.diff"))
    last = last.filter(differing * (100 + percent) <= allowed).select(F.col("x").alias("src"), F.col("y").alias("dst"))
    last = cut(last.union(straight).distinct())
    if not last.isEmpty():
        comp = connected_components(edges.union(last))
    out = labelled(rows.select("id", "n"), comp, "id", "component_id")
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), "component_id", F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"))
