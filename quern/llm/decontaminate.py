"""Benchmark decontamination by Wu-Manber multi-pattern search.

Patterns are the benchmark's windows as byte strings `` w1 w2 ... w10 `` in the texts' own canonical form (A-Z
lower-cased, words joined by one space, a space at both ends), so an occurrence of the bytes is an occurrence of the word
sequence.  For each class of lengths a shift table over blocks of bytes says how far the search may jump; where it says
0, the block's bucket gives the patterns whose first ``m`` bytes end in it, and these are compared directly.

The scan is vectorised over lanes: a text is cut into stretches that are searched side by side, each in jumps.
"""

from __future__ import annotations

import functools
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textscan import LOWER, NON_ALNUM, chunks
from quern.llm.udfs import text_udf
from quern.operators.lineage import cut

_TABLE = bytes(32 if NON_ALNUM[b] else b for b in LOWER)
_HASH = np.uint64(0x9E3779B97F4A7C15)
LANE = 2048
SALTS = 16


def words_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def windows_of(text: bytes | None, width: int) -> list[bytes]:
    w = words_of(text or b"")
    return [b" " + b" ".join(w[i : i + width]) + b" " for i in range(max(1, len(w) - width + 1))] if w else []


def _blocks(data: np.ndarray, size: int) -> np.ndarray:
    """The little-endian number in each ``size`` bytes from each place on."""
    if size == 8:
        return np.ndarray((max(0, len(data) - 7),), "<u8", data.tobytes(), strides=(1,))
    out = np.zeros(max(0, len(data) - size + 1), np.uint64)
    for i in range(size):
        out |= data[i : i + len(out)].astype(np.uint64) << np.uint64(8 * i)
    return out


@dataclass
class WuManber:
    """Patterns whose shortest has ``m`` bytes. ``shift`` goes by a hash of a block, buckets are runs of equal ``keys``."""

    patterns: list[bytes]
    bits: int = 0
    m: int = 0
    block: int = 0
    shift: np.ndarray = field(default=None)
    keys: np.ndarray = field(default=None)
    members: np.ndarray = field(default=None)
    lead: np.ndarray = field(default=None)

    def __post_init__(self):
        self.m = min(map(len, self.patterns))
        self.block = min(8, max(2, self.m // 2))
        self.bits = int(np.clip(np.ceil(np.log2(len(self.patterns) * 64 + 1)), 12, 24))
        far = self.m - self.block + 1
        self.shift = np.full(1 << self.bits, min(far, 255), np.uint8)  # a jump too short loses nothing
        heads = np.frombuffer(b"".join(p[: self.m] for p in self.patterns), np.uint8).reshape(-1, self.m)
        for at in range(far):  # the block that begins at ``at`` lets the window jump far - 1 - at
            keys = self.key(sum(heads[:, at + i].astype(np.uint64) << np.uint64(8 * i) for i in range(self.block)))
            self.shift[keys] = np.minimum(self.shift[keys], min(far - 1 - at, 255))
        order = np.argsort(keys, kind="stable")
        self.members, self.keys = order.astype(np.int32), keys[order].astype(np.int32)
        self.lead = sum(heads[:, i].astype(np.uint64) << np.uint64(8 * i) for i in range(self.block))

    def key(self, blocks: np.ndarray) -> np.ndarray:
        return ((blocks * _HASH) >> np.uint64(64 - self.bits)).astype(np.int64)

    def find(self, raw: bytes, data: np.ndarray) -> list[tuple[int, int]]:
        """(place, pattern) of every occurrence."""
        last = len(data) - self.m
        if last < 0:
            return []
        blocks, off = _blocks(data, self.block), self.m - self.block
        at = np.arange(0, last + 1, LANE)
        end = np.minimum(at + LANE, last + 1)
        hits = []
        while len(at):
            keys = self.key(blocks[at + off])
            jump = self.shift[keys].astype(np.int64)
            zero = jump == 0
            if zero.any():
                hits.append((at[zero], keys[zero]))
            at = at + np.maximum(jump, 1)
            open_ = at < end
            at, end = at[open_], end[open_]
        if not hits:
            return []
        place, keys = (np.concatenate(x) for x in zip(*hits, strict=True))
        keys = keys.astype(np.int32)
        first = np.searchsorted(self.keys, keys, "left")
        sizes = np.searchsorted(self.keys, keys, "right") - first
        which = np.repeat(first - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        place, pattern = np.repeat(place, sizes), self.members[which]
        same = blocks[place] == self.lead[pattern]
        found = []
        for a, p in zip(place[same].tolist(), pattern[same].tolist(), strict=True):
            s = self.patterns[p]
            if raw[a : a + len(s)] == s:
                found.append((a, p))
        return found


@dataclass
class Matcher:
    """Wu-Manber tables by class of length: a short pattern must not shorten the jumps of the long ones."""

    patterns: list[bytes]
    owners: list[tuple[str, ...]]

    def __post_init__(self):
        classes: dict[int, list[int]] = {}
        for i, p in enumerate(self.patterns):
            classes.setdefault(min(5, (len(p) - 1).bit_length()), []).append(i)
        self.parts = [(np.array(ids), WuManber([self.patterns[i] for i in ids])) for _, ids in sorted(classes.items())]

    def search(self, texts: list[bytes | None]) -> list[tuple[int, list[tuple[int, int]], list[str]]]:
        """For each text: its words, the maximal spans of words inside occurrences, the items that occur."""
        out = []
        for lo, hi in chunks(texts):
            out += self._chunk(texts[lo:hi])
        return out

    def _chunk(self, texts):
        # \x01 separates words, so no canonical text or pattern has it: no occurrence crosses two texts
        raw = b"\x01".join(b" " + (t or b"").translate(_TABLE) + b" " for t in texts)
        data = np.frombuffer(raw, np.uint8)
        space = data == 32
        keep = np.ones(len(data), bool)
        keep[1:] = ~(space[1:] & space[:-1])
        data = np.ascontiguousarray(data[keep])
        raw = data.tobytes()
        bound = np.concatenate(([-1], np.flatnonzero(data == 1), [len(data)]))
        gaps = np.flatnonzero(data == 32)
        n_gap = np.searchsorted(gaps, bound)  # gaps before each text
        counts = np.maximum(np.diff(n_gap) - 1, 0)
        spans: dict[int, list[tuple[int, int]]] = {}
        items: dict[int, set[str]] = {}
        for ids, part in self.parts:
            found = part.find(raw, data)
            if not found:
                continue
            place = np.array([a for a, _ in found])
            doc = np.searchsorted(bound, place, "right") - 1
            first = np.searchsorted(gaps, place) - n_gap[doc]
            for d, w, (_, p) in zip(doc.tolist(), first.tolist(), found, strict=True):
                s = self.patterns[ids[p]]
                spans.setdefault(d, []).append((w, w + s.count(b" ") - 1))
                items.setdefault(d, set()).update(self.owners[ids[p]])
        return [(int(n), _union(spans.get(i, [])), sorted(items.get(i, ()))) for i, n in enumerate(counts)]


def _union(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


_PART = "struct<n_words:bigint,spans:array<struct<first:bigint,last:bigint>>,items:array<string>>"
_ARROW = pa.struct([("n_words", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("items", pa.list_(pa.string()))])


def _searcher(tables):
    def search(texts: list[bytes | None]) -> pa.Array:
        got = tables.value.search(texts)
        return pa.array([{"n_words": n, "spans": [{"first": a, "last": b} for a, b in s], "items": i} for n, s, i in got], _ARROW)

    return search


def _matcher(items: DataFrame, width: int) -> Matcher | None:
    """Tables of the windows of items (i, t); None without a window.  Equal windows are one, owned by all their items."""
    owners: dict[bytes, tuple[str, ...] | set[str]] = {}
    for i, t in items.toLocalIterator():
        own = () if i is None else (i,)
        for w in windows_of(t.encode(), width):
            held = owners.setdefault(w, own)
            if isinstance(held, set):
                held.update(own)
            elif held is not own:
                owners[w] = {*held, *own}
    return Matcher(list(owners), [tuple(sorted(x)) for x in owners.values()]) if owners else None


def decontaminate(docs: DataFrame, benchmark: DataFrame, width: int = 10, text_col: str = "text", item_id: str = "item_id", item_text: str = "text", out: str = "decontamination", shard_bytes: int = 4 << 20) -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_hit, spans (words from ``first`` up to before ``last``), items, contaminated.

    A window is ``width`` consecutive words of an item; an item of fewer words is one window; one without words (or null)
    has none; the windows of an item without an id are hit, but it is not among the items.  A null or empty text has no words and no hits.  Items repeated or with equal windows all count.  No
    benchmark rows: nothing is hit.  A column already called ``out`` is replaced.

    Tables of the benchmark go to every task, so its size is taken first: items are dealt into as many parts of about
    ``shard_bytes`` (and an item) as it takes, and one part's tables are alive at a time.  The first part is searched in
    the plan of the result; each other one in a pass of its own, whose hits (by digest of the text) are written to the
    checkpoint folder before its tables are freed, and are joined to the documents at the end.
    """
    items = benchmark.select(F.col(item_id).cast("string").alias("i"), F.col(item_text).alias("t")).filter("t is not null")
    size = items.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    parts = max(1, -(-int(size) // shard_bytes))
    sc, others = docs.sparkSession.sparkContext, []
    for k in range(parts - 1, 0, -1):
        matcher = _matcher(items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == k), width)
        if matcher is None:
            continue
        tables = sc.broadcast(matcher)
        del matcher
        hits = docs.select(F.col(text_col).alias("t")).filter("t is not null").withColumn("r", text_udf(_PART, _searcher(tables))(F.col("t"))).filter(F.size("r.spans") > 0)
        others.append(cut(hits.select(F.sha2("t", 256).alias("_key"), "r.spans", "r.items").dropDuplicates(["_key"])))
        tables.destroy()
    first = _matcher(items if parts == 1 else items.filter(F.pmod(F.xxhash64("i", "t"), F.lit(parts)) == 0), width)
    tables = sc.broadcast(first or Matcher([], []))
    if docs.columns.count(out):
        docs = docs.drop(out)
    free = "_"
    while any(c.lower().startswith(free) for c in docs.columns):
        free += "_"
    part, whole, owners, more, whose, key, salt = (free + n for n in ("part", "spans", "items", "more", "whose", "key", "salt"))
    docs = docs.withColumn(part, text_udf(_PART, _searcher(tables))(F.col(text_col)))
    spans, items_ = F.col(f"{part}.spans"), F.col(f"{part}.items")
    if others:  # copies of one text are dealt over SALTS keys, each with the text's hits
        all_ = functools.reduce(DataFrame.unionAll, others).withColumnRenamed("_key", key).groupBy(key).agg(F.flatten(F.collect_list("spans")).alias(more), F.flatten(F.collect_list("items")).alias(whose))
        all_ = all_.withColumn(salt, F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        docs = docs.withColumn(key, F.sha2(F.col(text_col), 256)).withColumn(salt, F.pmod(F.spark_partition_id(), F.lit(SALTS))).join(all_, [key, salt], "left").drop(key, salt)
        none = lambda c: F.coalesce(F.col(c), F.array().cast(docs.schema[c].dataType))
        spans, items_ = F.array_sort(F.concat(spans, none(more))), F.array_sort(F.array_distinct(F.concat(items_, none(whose))))
    docs = docs.withColumn(whole, spans).withColumn(owners, items_)
    covered = f"aggregate({whole}, named_struct('n', 0L, 'to', 0L), (a, s) -> named_struct('n', a.n + greatest(0L, s.last - greatest(s.first, a.to)), 'to', greatest(a.to, s.last)), a -> a.n)"
    hit = F.expr(covered)
    return docs.withColumn(out, F.struct(F.col(f"{part}.n_words").alias("n_words"), hit.alias("n_hit"), F.col(whole).alias("spans"), F.col(owners).alias("items"), (hit > 0).alias("contaminated"))).drop(part, whole, owners, more, whose)

