"""Exact substring deduplication by super-k-mers.

A window is ``width`` consecutive words.  Its minimiser is the smallest hash of the runs of ``SEED`` words in it, so equal
windows have equal minimisers.  Consecutive windows that share a minimiser travel as one packed string (a super-k-mer: 34
words more than it has windows) to the bucket of that minimiser.  In a bucket, sorting the windows of all strings counts
them exactly; equal hashes are confirmed on the words.

What is frequent is met before the shuffle: equal strings of a task's unit of work travel once, and since all their
windows repeat, their places are marked at once.  Runs of words that a sample shows in many texts rank last as minimisers,
so that a common line does not draw its surroundings of all texts into one bucket.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.textscan import BLANK, Scan, chunks, mix, runs, scan

SEED = 5
UNIT = 32 << 20
LONGEST = 256
#: A run of words counts as common if it is in more than this share of the sampled texts; at most so many are kept.
COMMON, MOST_COMMON = 0.01, 4096
U = np.uint64
_TO_BLANK = bytes(32 if BLANK[b] else b for b in range(256))
_ZSTD = pa.Codec("zstd", compression_level=5)


def canonical(texts: list[bytes | None]) -> list[bytes]:
    """Each text's words joined by one space."""
    return [b" ".join((t or b"").translate(_TO_BLANK).split()) for t in texts]


def seeds_of(s: Scan, common: np.ndarray) -> np.ndarray:
    """The rank of the ``SEED`` words from each word on; common ones rank behind all others."""
    h = runs(s.hashes(), SEED)
    late = np.isin(h, common)
    h = mix(h) >> U(1)
    h[late] |= U(1 << 63)
    return h


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    have = 1
    while have * 2 <= width:
        x = np.minimum(x[:-have], x[have:])
        have *= 2
    rest = width - have
    return np.minimum(x[: len(x) - rest], x[rest:]) if rest else x


def super_kmers(s: Scan, width: int, common: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first window, number of windows, minimiser) of each super-k-mer of the scanned texts."""
    none = np.empty(0, np.int64)
    if len(s.start) < width:
        return none, none, none.astype(U)
    of = s.doc_of()
    valid = np.flatnonzero(of[width - 1 :] == of[: len(of) - width + 1])
    if not len(valid):
        return none, none, none.astype(U)
    least = sliding_min(seeds_of(s, common), width - SEED + 1)[valid]
    new = np.ones(len(valid), bool)
    new[1:] = (np.diff(valid) != 1) | (least[1:] != least[:-1])
    # long runs (repeated words) are cut; each window still goes to its minimiser's bucket
    at = np.flatnonzero(new)
    within = np.arange(len(valid)) - np.repeat(at, np.diff(np.append(at, len(valid))))
    new |= within % LONGEST == 0
    at = np.flatnonzero(new)
    return valid[at], np.diff(np.append(at, len(valid))), least[at]


_ROW = "bucket int, blob binary"
_ROW_ARROW = pa.schema([("bucket", pa.int32()), ("blob", pa.binary())])
_MARK = "k1 bigint, k2 int, first int, last int"
_MARK_ARROW = pa.schema([("k1", pa.int64()), ("k2", pa.int32()), ("first", pa.int32()), ("last", pa.int32())])


def _packed(*arrays: np.ndarray, text: bytes = b"") -> bytes:
    raw = b"".join(np.ascontiguousarray(a).tobytes() for a in arrays) + text
    return len(arrays[0]).to_bytes(4, "little") + len(raw).to_bytes(8, "little") + _ZSTD.compress(raw, asbytes=True)


def _unpacked(blob: bytes, kinds: list) -> tuple[list[np.ndarray], bytes]:
    n, size = int.from_bytes(blob[:4], "little"), int.from_bytes(blob[4:12], "little")
    raw, at, out = _ZSTD.decompress(blob[12:], size, asbytes=True), 0, []
    for k in kinds:
        out.append(np.frombuffer(raw, k, n, at))
        at += n * np.dtype(k).itemsize
    return out, raw[at:]


_PLACES, _STRINGS = [np.int64, np.int32, np.int32, np.int32], [np.int64, np.int32, np.int32, np.uint32, np.uint8]


def _mapper(width: int, buckets: int, common: np.ndarray):
    """Rows (k1, k2, text) to blobs: strings by bucket, and marks (bucket -1 - x: any task may pass them on)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, list] = {}
        marks: list[tuple[int, int, int, int]] = []
        size = turn = 0

        def flush() -> Iterator[pa.RecordBatch]:
            nonlocal seen, marks, size, turn
            by: dict[int, list] = {}
            for text, e in seen.items():
                by.setdefault(e[0], []).append((text, e))
            for b, group in by.items():
                # within a bucket in the order met: neighbours of one text compress well
                a = [np.array([e[i] for _, e in group], k) for i, k in ((1, np.int64), (2, np.int32), (3, np.int32))]
                blob = _packed(*a, np.array([len(t) for t, _ in group], np.uint32), np.array([e[4] for _, e in group], np.uint8), text=b"".join(t for t, _ in group))
                yield pa.RecordBatch.from_arrays([pa.array([b], pa.int32()), pa.array([blob], pa.binary())], schema=_ROW_ARROW)
            if marks:
                turn += 1
                m = np.array(marks, np.int64)
                blob = _packed(m[:, 0], *(m[:, i].astype(np.int32) for i in (1, 2, 3)))
                yield pa.RecordBatch.from_arrays([pa.array([-1 - turn % 64], pa.int32()), pa.array([blob], pa.binary())], schema=_ROW_ARROW)
            seen, marks, size = {}, [], 0

        for batch in batches:
            k1, k2 = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            texts = canonical(batch.column(2).cast(pa.binary()).to_pylist())
            for lo, hi in chunks(texts):
                s = scan(texts[lo:hi])
                first, count, least = super_kmers(s, width, common)
                bucket = (mix(least) % U(buckets)).astype(np.int64).tolist()
                doc = np.searchsorted(s.first, first, "right") - 1
                at = (first - s.first[doc]).tolist()
                begin, end = s.start[first].tolist(), s.end[first + count + width - 2].tolist()
                for d, a, n, b, x, y in zip(doc.tolist(), at, count.tolist(), bucket, begin, end, strict=True):
                    text = s.raw[x:y]
                    e = seen.get(text)
                    if e is None:
                        seen[text] = [b, k1[lo + d], k2[lo + d], a, 1]
                        size += y - x
                        continue
                    if e[4] == 1:  # the first place, held back until now
                        marks.append((e[1], e[2], e[3], e[3] + n + width - 1))
                        e[4] = 2
                    marks.append((k1[lo + d], k2[lo + d], a, a + n + width - 1))
                if size > UNIT or len(marks) > 1 << 18:
                    yield from flush()
        yield from flush()

    return run


def _counted(strings: list[bytes], twice: np.ndarray, width: int) -> Iterator[tuple[int, int, int]]:
    """(string, first word, last word + 1) of runs of windows that occur elsewhere, for strings not met ``twice``."""
    hashes, which, place, text = [], [], [], []
    for lo, hi in chunks(strings):
        s = scan(strings[lo:hi])
        of = s.doc_of()
        if len(of) < width:
            continue
        valid = np.flatnonzero(of[width - 1 :] == of[: len(of) - width + 1])
        hashes.append(runs(s.hashes(), width)[valid])
        which.append(of[valid] + lo)
        place.append(valid - s.first[of[valid]])
        base = np.concatenate(([0], np.cumsum([len(x) + 1 for x in strings[lo:hi]])))[of[valid]]
        text.append(np.column_stack([s.start[valid] - base, s.end[valid + width - 1] - base]).astype(np.int32))
    if not hashes:
        return
    hashes, which, place, text = (np.concatenate(x) for x in (hashes, which, place, text))
    order = np.argsort(hashes, kind="stable")
    same = hashes[order][1:] == hashes[order][:-1]
    edge = np.flatnonzero(np.concatenate(([True], ~same, [True])))
    dup = np.zeros(len(hashes), bool)
    for a, b in zip(edge[:-1][np.diff(edge) > 1].tolist(), edge[1:][np.diff(edge) > 1].tolist(), strict=True):
        own = order[a:b]
        if twice[which[own]].all():
            continue
        words = [strings[w][x:y] for w, (x, y) in zip(which[own].tolist(), text[own].tolist(), strict=True)]
        if len(set(words)) == 1:
            dup[own] = True
        else:  # a collision of hashes: the words decide
            n = Counter(words)
            dup[own] = [n[x] > 1 for x in words]
    hit = np.flatnonzero(dup & ~twice[which])
    if not len(hit):
        return
    cuts = np.flatnonzero(np.concatenate(([True], (np.diff(which[hit]) != 0) | (np.diff(place[hit]) != 1), [True])))
    for a, b in zip(cuts[:-1], cuts[1:], strict=True):
        yield int(which[hit[a]]), int(place[hit[a]]), int(place[hit[b - 1]]) + width


def _reducer(width: int):
    """Blobs, sorted by bucket, to marks. Holds one bucket's distinct strings at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, out = None, {}, []

        def batch(rows: list) -> pa.RecordBatch:
            m = np.array(rows, np.int64).reshape(-1, 4)
            return pa.RecordBatch.from_arrays([pa.array(m[:, 0]), *(pa.array(m[:, i].astype(np.int32)) for i in (1, 2, 3))], schema=_MARK_ARROW)

        def close() -> None:
            strings = list(held)
            twice = np.array([held[t][3] > 1 for t in strings], bool)
            for i, a, b in _counted(strings, twice, width):
                k1, k2, at, _ = held[strings[i]]
                out.append((k1, k2, at + a, at + b))
            held.clear()

        for got in batches:
            for b, blob in zip(got.column(0).to_pylist(), got.column(1).to_pylist(), strict=True):
                if b < 0:
                    (k1, k2, x, y), _ = _unpacked(blob, _PLACES)
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(x), pa.array(y)], schema=_MARK_ARROW)
                    continue
                if b != now:
                    close()
                    now = b
                (k1, k2, at, size, n), text = _unpacked(blob, _STRINGS)
                x = 0
                for a, c, p, s, m in zip(k1.tolist(), k2.tolist(), at.tolist(), size.tolist(), n.tolist(), strict=True):
                    t = text[x : x + s]
                    x += s
                    e = held.get(t)
                    if e is None:
                        held[t] = [a, c, p, m]
                        continue
                    words = t.count(b" ") + 1
                    if e[3] == 1:
                        out.append((e[0], e[1], e[2], e[2] + words))
                        e[3] = 2
                    if m == 1:
                        out.append((a, c, p, p + words))
                if len(out) > 1 << 16:
                    yield batch(out)
                    out = []
        close()
        if out:
            yield batch(out)

    return run


def common_seeds(docs: DataFrame, text_col: str, sample: int = 2000) -> np.ndarray:
    """Hashes of the runs of ``SEED`` words that many of about ``sample`` texts, picked by their content, hold."""
    n = docs.count()
    if not n:
        return np.empty(0, U)
    some = docs.select(F.col(text_col).alias("text")).filter(F.col("text").isNotNull())
    if n > sample:
        some = some.filter(F.pmod(F.xxhash64(F.substring("text", 1, 200), F.octet_length("text")), F.lit(n // sample)) == 0)

    def work(batches):
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            for lo, hi in chunks(texts):
                s = scan(texts[lo:hi])
                h, of = runs(s.hashes(), SEED), s.doc_of()
                for d in range(hi - lo):
                    a, z = int(s.first[d]), int(s.first[d + 1]) - SEED + 1
                    if z > a:
                        yield pa.RecordBatch.from_arrays([pa.array(np.unique(h[a:z]).view(np.int64))], names=["h"])

    counts = some.mapInArrow(work, "h bigint").groupBy("h").count().filter(F.col("count") > max(5, COMMON * min(n, sample)))
    top = counts.orderBy(F.desc("count"), "h").limit(MOST_COMMON).collect()  # at most MOST_COMMON numbers
    return np.array([r.h for r in top], np.int64).view(U)


def bucket_count(docs: DataFrame, each: int = 8 << 20) -> int:
    """Enough buckets for about ``each`` bytes of strings in each: about 3.5 times the texts, whose bytes are summed first."""
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    return int(max(16, 7 * size // 2 // each))


_RESULT = pa.struct([("n_words", pa.int64()), ("n_removed", pa.int64()), ("spans", pa.list_(pa.struct([("first", pa.int64()), ("last", pa.int64())]))), ("kept", pa.string())])


def _cut_words(text: pa.Array, first: pa.Array, last: pa.Array) -> pa.Array:
    out = []
    for t, a, b in zip(text.cast(pa.binary()).to_pylist(), first.to_pylist(), last.to_pylist(), strict=True):
        words = (t or b"").translate(_TO_BLANK).split()
        kept, spans, at = [], [], 0
        for x, y in sorted(zip(a or (), b or (), strict=True)):
            if spans and x <= spans[-1]["last"]:
                spans[-1]["last"] = max(spans[-1]["last"], y)
            else:
                spans.append({"first": x, "last": y})
        for s in spans:
            kept += words[at : s["first"]]
            at = s["last"]
        kept += words[at:]
        out.append({"n_words": len(words), "n_removed": len(words) - len(kept), "spans": spans, "kept": b" ".join(kept).decode()})
    return pa.array(out, _RESULT)


_cut_words.__annotations__ = {"text": pa.Array, "first": pa.Array, "last": pa.Array, "return": pa.Array}


def remove_repeats(docs: DataFrame, width: int = 35, id_col: str = "doc_id", text_col: str = "text", out: str = "dedup") -> DataFrame:
    """``docs`` with a struct column ``out``: n_words, n_removed, spans (words from ``first`` up to before ``last``), kept.

    Words are runs of other than x20 and x09-x0D.  A word is removed if it lies in a window of ``width`` words whose sequence
    also starts anywhere else, the same text included; ``kept`` are the other words, joined by one space.  A null or blank
    text has no words and an empty ``kept``; texts of fewer words than ``width`` keep all.  Repeated rows repeat each other.
    Ids need be neither unique nor present, and may be of any type that has a text; a column already called ``out`` is replaced.
    """
    if width < SEED:
        raise ValueError(f"width must be at least {SEED}")
    docs = docs.drop(out) if out in docs.columns else docs
    text = F.col(text_col)
    # rows equal in id and text are marked alike, so they may share a key
    # ids that are no numbers are hashed; rows without one are told apart by 95 bits of hashes of their texts
    name = F.col(id_col).cast("string")
    k1 = F.coalesce(name.try_cast("bigint"), F.xxhash64(name, F.when(name.isNull(), text)))
    k2 = (F.xxhash64(F.col(id_col).isNull(), text).bitwiseAND(0x7FFFFFFF)).cast("int")
    keyed = docs.select(k1.alias("k1"), k2.alias("k2"), text.alias("text")).filter("text is not null")
    common = common_seeds(docs, text_col)
    blobs = keyed.mapInArrow(_mapper(width, bucket_count(keyed), common), _ROW)
    marks = blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_reducer(width), _MARK)
    # spans of one text: bounded by its length
    spans = marks.groupBy("k1", "k2").agg(F.collect_list("first").alias("_first"), F.collect_list("last").alias("_last"))
    both = docs.withColumns({"_k1": k1, "_k2": k2}).join(spans.withColumnsRenamed({"k1": "_m1", "k2": "_m2"}), (F.col("_k1") == F.col("_m1")) & (F.col("_k2") == F.col("_m2")), "left")
    cutter = F.arrow_udf(_cut_words, "struct<n_words:bigint,n_removed:bigint,spans:array<struct<first:bigint,last:bigint>>,kept:string>").asNondeterministic()
    return both.withColumn(out, cutter(text, "_first", "_last")).drop("_k1", "_k2", "_m1", "_m2", "_first", "_last")
