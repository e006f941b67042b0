"""SentencePiece encoding and decoding on a relational lattice.

Texts are dealt into groups and packed; the distinct words of each group form a table of (group, word).  Each distinct
word of the whole input explodes once into its substrings of bounded length, an equi-join to the piece table keeps those
that are pieces (the edges of the word's lattice), edges are grouped by word, and a higher-order ``aggregate`` folds each
lattice: for a unigram model by Viterbi, for a BPE model by applying the merges that the lattice holds, best score first.
Characters that are no piece fall back to their bytes.  The folded words go back to the groups that hold them.

Words are cut where no piece can cross, which the piece table proves: before a blank sign, if no piece mixes letters with
signs, between these, and in words of more than ``LONGEST`` characters between any two characters that no piece holds side
by side.  What is still longer (one character repeated, say) is folded in Python by the same rules.
"""

from __future__ import annotations

import ctypes
import heapq
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

BLANK = "▁"
#: A lattice's boundaries are the bits of one number, so a word of it has so many characters at most.
LONGEST = 60
#: Two classes of characters that cover all but the blank sign: ASCII letters and most other scripts; signs.
_LETTER = r"[A-Za-z\u00AA\u00B5\u00BA\u00C0-\u1FFF\u2C00-" + chr(0x10FFFF) + "]"
_SIGN = r"[\x00-\x40\x5B-\x60\x7B-\x7F\u0080-\u00A9\u00AB-\u00B4\u00B6-\u00B9\u00BB-\u00BF\u2000-\u2580\u2582-\u2BFF]"


@dataclass
class PieceModel:
    """A model's pieces by id, with scores; ``byte0`` is the id of byte 0 (bytes follow each other), or -1."""

    pieces: list[str]
    scores: list[float]
    usable: list[bool]
    bpe: bool
    byte0: int
    unknown: int
    dummy_prefix: bool

    def __post_init__(self):
        self.longest = max((len(p) for p, u in zip(self.pieces, self.usable, strict=True) if u), default=1)
        pure = re.compile(f"{BLANK}*(?:{_LETTER}*|{_SIGN}*)")
        own = [p for p, u in zip(self.pieces, self.usable, strict=True) if u]
        if any(BLANK in p.lstrip(BLANK) for p in own):
            raise ValueError("pieces with a blank sign after other characters are not supported")
        #: whether words are cut between letters and signs, too
        self.fine = all(pure.fullmatch(p) for p in own)
        self.ids = {p: i for i, (p, u) in enumerate(zip(self.pieces, self.usable, strict=True)) if u}

    def _classes(self) -> np.ndarray:
        """0 for the blank sign, 1 for letters, 2 for signs (if no piece mixes these, else 1), by code point."""
        if "_class" not in self.__dict__:
            of = np.ones(0x110000, np.uint8)
            if self.fine:
                low = "".join(map(chr, range(0x2C00)))
                of[[ord(c) for c in re.findall(_SIGN, low)]] = 2
            of[ord(BLANK)] = 0
            self._class = of
        return self._class

    def table(self) -> PieceTable:
        if "_edges" not in self.__dict__:
            self._edges = PieceTable(self)
        return self._edges

    def _side_by_side(self) -> set[str]:
        if "_pairs" not in self.__dict__:
            self._pairs = {p[i : i + 2] for p in self.ids for i in range(len(p) - 1)}
        return self._pairs

    def words_of(self, texts: pa.StringArray) -> tuple[pa.StringArray, np.ndarray]:
        """The words of all ``texts`` (no nulls), one after the other, and the number of words up to the end of each text."""
        marked = [(BLANK if self.dummy_prefix and t else "") + t.replace(" ", BLANK) for t in texts.to_pylist()]
        stop = np.cumsum(np.fromiter(map(len, marked), np.int64, len(marked)))
        whole = "".join(marked)
        del marked
        if not whole:
            return pa.array([], pa.string()), np.zeros(len(texts), np.int64)
        raw, place, of = _utf8(whole)
        of = self._classes()[of]
        start = np.empty(len(of) + 1, bool)
        # a blank sign starts a word after anything else; anything else does after another class, but for blank signs
        start[1:-1] = (of[1:] != of[:-1]) & ((of[1:] == 0) | (of[:-1] != 0))
        start[0] = start[-1] = True
        start[stop] = True
        at = np.flatnonzero(start)
        size = np.diff(at)
        if size.max() > LONGEST:
            more = []
            for i in np.flatnonzero(size > LONGEST).tolist():
                more += (at[i] + np.cumsum([len(x) for x in self._parts(whole[at[i] : at[i + 1]])])).tolist()
            at = np.union1d(at, np.array(more, np.int64))
        return _slices(raw, place, at[:-1], at[1:]), np.searchsorted(at, stop)

    def _parts(self, word: str) -> list[str]:
        near, a, out = self._side_by_side(), 0, []
        for i in range(1, len(word)):
            if word[i - 1 : i + 1] not in near:
                out.append(word[a:i])
                a = i
        return [*out, word[a:]]

    def fallback(self, ch: str) -> list[int]:
        return [self.byte0 + b for b in ch.encode()] if self.byte0 >= 0 else [self.unknown]

    def encode_word(self, word: str) -> list[int]:
        """The rules of the fold, for one word of any length."""
        return self._merged(word) if self.bpe else self._viterbi(word)

    def _out(self, parts: list[str]) -> list[int]:
        out, ids = [], self.ids
        for p in parts:
            i = ids.get(p)
            if i is None:
                out += self.fallback(p)
            else:
                out.append(i)
        return out

    def _merged(self, word: str) -> list[int]:
        n = len(word)
        end, prev, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap: list[tuple[float, int, int]] = []

        def offer(a: int) -> None:
            if a >= 0 and end[a] < n and (i := self.ids.get(word[a : end[end[a]]])) is not None:
                heap.append((-self.scores[i], a, end[end[a]])) if not heap else heapq.heappush(heap, (-self.scores[i], a, end[end[a]]))

        for a in range(n - 1):
            offer(a)
        while heap:
            _, a, z = heapq.heappop(heap)
            if not alive[a] or end[a] >= n or end[end[a]] != z:
                continue
            b = end[a]
            alive[b], end[a] = False, z
            if z < n:
                prev[z] = a
            offer(a)
            offer(prev[a])
        out, a = [], 0
        while a < n:
            out.append(word[a : end[a]])
            a = end[a]
        return self._out(out)

    def _viterbi(self, word: str) -> list[int]:
        worst = min(self.scores) - 10
        best: list[tuple[float, int]] = [(0.0, 0)]
        for z in range(1, len(word) + 1):
            options = [(best[a][0] + self.scores[self.ids[p]], a) for a in range(max(0, z - self.longest), z) if (p := word[a:z]) in self.ids]
            if word[z - 1] not in self.ids:
                options.append((best[z - 1][0] + worst, z - 1))
            best.append(max(options))
        out, z = [], len(word)
        while z:
            out.append(word[best[z][1] : z])
            z = best[z][1]
        return self._out(out[::-1])

    def between(self, words: pa.StringArray, cuts: np.ndarray) -> pa.ListArray:
        """The ids of the pieces of each word; ``cuts`` has its boundaries as bits of one number."""
        if not len(words):
            return pa.array([], pa.list_(pa.int32()))
        whole = "".join(words.to_pylist())
        raw, place, _ = _utf8(whole)
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        first = np.cumsum(size) - size
        row, bit = np.nonzero((cuts[:, None] >> np.arange(LONGEST + 1)) & 1)
        inner = row[1:] == row[:-1]
        at = first[row] + bit
        a, z, row = at[:-1][inner], at[1:][inner], row[:-1][inner]
        coded = _slices(raw, place, a, z).dictionary_encode()
        own = [self._out([p]) for p in coded.dictionary.to_pylist()]
        each = pa.ListArray.from_arrays(np.cumsum([0, *map(len, own)]).astype(np.int32), pa.array([i for x in own for i in x], pa.int32())).take(coded.indices)
        ids = np.zeros(len(words) + 1, np.int64)
        np.add.at(ids, row + 1, pc.list_value_length(each).to_numpy())
        return pa.ListArray.from_arrays(np.cumsum(ids).astype(np.int32), each.flatten())

    def settled(self, ids: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts that end at ``ends``: unknown characters that follow each other are one, without bytes to fall back to."""
        if self.byte0 >= 0 or not len(ids):
            return ids, ends
        keep = np.ones(len(ids), bool)
        keep[1:] = (ids[1:] != self.unknown) | (ids[:-1] != self.unknown)
        keep[ends[ends < len(ids)]] = True
        return ids[keep], np.concatenate([[0], np.cumsum(keep)])[ends]

    def decode(self, ids: pa.ListArray) -> list[bytes | None]:
        if "_table" not in self.__dict__:
            table = [p.replace(BLANK, " ").encode() for p in self.pieces]
            if self.byte0 >= 0:
                table[self.byte0 : self.byte0 + 256] = [bytes([b]) for b in range(256)]
            self._table = pa.array(table, pa.binary())
        size = pc.fill_null(pc.list_value_length(ids), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        own = pa.ListArray.from_arrays(np.concatenate([[0], np.cumsum(size)]).astype(np.int32), self._table.take(ids.flatten()))
        raw = pc.binary_join(own, pa.scalar(b"", pa.binary())).to_pylist()
        return [None if null else x[1:] if self.dummy_prefix and x[:1] == b" " else x for null, x in zip(ids.is_null().to_pylist(), raw, strict=True)]


def _utf8(whole: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a text, where each character (and the end) begins in them, and the characters' numbers."""
    of = np.frombuffer(whole.encode("utf-32-le"), np.uint32)
    place = np.zeros(len(of) + 1, np.int32)
    np.cumsum(1 + (of > 0x7F).astype(np.int8) + (of > 0x7FF) + (of > 0xFFFF), out=place[1:])
    return np.frombuffer(whole.encode(), np.uint8), place, of


def _slices(raw: np.ndarray, place: np.ndarray, a: np.ndarray, z: np.ndarray) -> pa.StringArray:
    """The stretches of characters from ``a`` up to ``z``, each of which begins where the one before ends."""
    return pa.StringArray.from_buffers(len(a), pa.py_buffer(np.concatenate([place[a], place[z[-1:]]])), pa.py_buffer(raw))


def load(path: str) -> PieceModel:
    """A model file on the driver. Only the identity normalisation is supported, without removal of extra blanks."""
    from sentencepiece import sentencepiece_model_pb2

    m = sentencepiece_model_pb2.ModelProto()
    with open(path, "rb") as f:
        m.ParseFromString(f.read())
    spec = m.normalizer_spec
    if spec.precompiled_charsmap or spec.remove_extra_whitespaces:
        raise ValueError("only models with identity normalisation are supported")
    kind = m.SentencePiece
    byte0 = next((i for i, p in enumerate(m.pieces) if p.type == kind.BYTE), -1)
    usable = [p.type in (kind.NORMAL, kind.USER_DEFINED) for p in m.pieces]
    return PieceModel([p.piece for p in m.pieces], [p.score for p in m.pieces], usable, m.trainer_spec.model_type == m.trainer_spec.BPE, byte0, m.trainer_spec.unk_id, spec.add_dummy_prefix)


_STEP, _SPREAD, _BITS = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), 20


class PieceTable:
    """The pieces that an edge can be, and which of a text's substrings are among them.

    Substrings are told by a filter of ``2 ** _BITS`` bits over their rolling hashes first; those that pass meet the pieces
    themselves in an equi-join (a hash join of Arrow).
    """

    def __init__(self, model: PieceModel):
        self.shortest, self.longest = 2 if model.bpe else 1, model.longest  # what is never merged needs no edge
        own = sorted(p for p in model.ids if self.shortest <= len(p))
        self.pieces = pa.array(own, pa.string())
        place = {s: k for k, s in enumerate(sorted(set(model.scores), reverse=True))}
        self.ids = np.array([model.ids[p] for p in own], np.int32)
        self.scores = np.array([model.scores[i] for i in self.ids.tolist()])
        self.place = np.array([place[model.scores[i]] for i in self.ids.tolist()], np.int64)
        self.filter = np.zeros(1 << _BITS, bool)
        for n in sorted({len(p) for p in own}):
            h = np.zeros(sum(len(p) == n for p in own), np.uint64)
            of = np.frombuffer("".join(p for p in own if len(p) == n).encode("utf-32-le"), np.uint32).reshape(-1, n).astype(np.uint64)
            for j in range(n):
                h = (h + of[:, j] + np.uint64(1)) * _STEP
            self.filter[self._slot(h)] = True

    @staticmethod
    def _slot(h: np.ndarray) -> np.ndarray:
        return ((h ^ (h >> np.uint64(29))) * _SPREAD) >> np.uint64(64 - _BITS)

    def edges(self, words: pa.StringArray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(number of the word, start, end, number of the piece) of every edge."""
        size = pc.utf8_length(words).to_numpy().astype(np.int64)
        raw, place, of = _utf8("".join(words.to_pylist()))
        stop, row = np.repeat(np.cumsum(size), size), np.repeat(np.arange(len(words)), size)
        at, h, found = np.arange(len(of)), np.zeros(len(of), np.uint64), []
        of = of.astype(np.uint64)
        for k in range(1, self.longest + 1):
            inside = at + k <= stop[at]
            at, h = at[inside], h[inside]
            if not len(at):
                break
            h = (h + of[at + k - 1] + np.uint64(1)) * _STEP
            if k >= self.shortest:
                got = at[self.filter[self._slot(h)]]
                found.append(np.stack([got, got + k]))
        if not found:
            return (np.zeros(0, np.int64),) * 4
        a, z = np.concatenate(found, axis=1)
        n = place[z] - place[a]
        last = np.cumsum(n, dtype=np.int64)
        own = raw[np.repeat(place[a] - (last - n), n) + np.arange(last[-1] if len(last) else 0)]
        text = pa.StringArray.from_buffers(len(a), pa.py_buffer(np.concatenate([[0], last]).astype(np.int32)), pa.py_buffer(own))
        which = pc.index_in(text, value_set=self.pieces)
        ok = which.is_valid().to_numpy(zero_copy_only=False)
        a, z, first = a[ok], z[ok], np.cumsum(size) - size
        r = row[a]
        return r, a - first[r], z - first[r], which.drop_null().to_numpy()


def _lattice(shared) -> Callable:
    """Words to their edges, in the form that the folds take."""

    def work(words: pa.Array) -> pa.Array:
        model, out = shared.value, []
        for i in range(0, len(words), 2_000):
            part = words.slice(i, 2_000)
            row, a, z, which = model.table().edges(part)
            if model.bpe:  # best first, the leftmost of equals
                by = np.lexsort((z, a, model.table().place[which], row))
                row, a, z = row[by], a[by], z[by]
                value = pa.StructArray.from_arrays([pa.array((1 << a) | (1 << z)), pa.array((1 << z) - (1 << (a + 1)))], ["ends", "mid"])
            else:
                by = np.argsort(row, kind="stable")
                row, a, z, which = row[by], a[by], z[by], which[by]
                own = pa.StructArray.from_arrays([pa.array(model.table().scores[which]), pa.array(model.table().ids[which])], ["score", "id"])
                value = pa.StructArray.from_arrays([pa.array((a * 1024 + z - a).astype(np.int32)), own], ["at", "piece"])
            out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(row, np.arange(len(part) + 1)).astype(np.int32)), value))
        return pa.concat_arrays(out) if out else pa.array([], pa.list_(pa.struct([])))

    work.__annotations__ = {"words": pa.Array, "return": pa.Array}
    return work


def _fallback_sql(model: PieceModel) -> str:
    if model.byte0 < 0:
        return f"array({model.unknown})"
    h = "hex(encode(substring(word, s + 1, 1), 'UTF-8'))"
    return f"transform(sequence(0, length({h}) div 2 - 1), k -> cast(conv(substring({h}, 2 * k + 1, 2), 16, 10) as int) + {model.byte0})"


def _fold_merges() -> str:
    """SQL from ``word`` and ``edges`` (best first; both ends, and all between them, as bits) to the word's cuts, for BPE.

    The state is the set of boundaries between pieces, as bits of one number, which is the result.  An edge can merge if both its ends are
    boundaries with just one between them; each step takes the edge of the best score, the leftmost of equals.

    One pass over the edges by score does it, unless an edge was met whose ends were boundaries with more than one between
    them, so that a later merge might still complete it: such words are folded step by step.
    """
    start, open_ = "shiftleft(1L, length(word) + 1) - 1", "shiftleft(1L, 61)"
    one = "((b & x.mid) & ((b & x.mid) - 1)) = 0"
    fits = f"(b & x.ends) = x.ends and (b & x.mid) <> 0 and {one}"
    step = f"get(transform(slice(filter(edges, x -> {fits}), 1, 1), x -> b & ~x.mid), 0)"
    steps = f"aggregate(sequence(1, length(word)), {start}, (b, _) -> coalesce({step}, b))"
    once = f"aggregate(edges, {start}, (b, x) -> case when (b & x.ends) <> x.ends then b when {one} then b & ~x.mid else b | {open_} end)"
    return f"get(transform(array({once}), f -> case when (f & {open_}) = 0 then f else {steps} end), 0)"


def _fold_paths(model: PieceModel) -> str:
    """SQL from ``word`` and ``edges`` (map of start * 1024 + length to score, id) to piece ids: Viterbi."""
    edge = "try_element_at(edges, cast({a} * 1024 + ({z}) - ({a}) as int))"
    worst = min(model.scores) - 10
    # state: best score and best last cut of each prefix
    cand = (
        f"transform(sequence(greatest(0, z - {model.longest}), z - 1), a -> named_struct('s', t[a].s + "
        f"coalesce({edge.format(a='a', z='z')}.score, case when a = z - 1 then {worst}D end), 'a', a))"
    )
    table = f"aggregate(sequence(1, length(word)), array(named_struct('s', 0D, 'a', 0)), (t, z) -> array_append(t, array_max(filter({cand}, c -> c.s is not null))))"
    back = "aggregate(sequence(1, length(word)), array(length(word)), (b, _) -> case when b[0] = 0 then b else array_prepend(b, t[b[0]].a) end)"
    bounds = f"get(transform(array({table}), t -> {back}), 0)"
    got = edge.format(a="s", z="e")
    ids = f"flatten(transform(sequence(0, size(b) - 2), i -> get(transform(array(named_struct('s', b[i], 'e', b[i + 1])), p -> get(transform(array(p.s), s -> get(transform(array(p.e), e -> coalesce(case when {got} is not null then array({got}.id) end, {_fallback_sql(model)})), 0)), 0)), 0)))"
    return f"get(transform(array({bounds}), b -> {ids}), 0)"


def encode_words(words: DataFrame, model: PieceModel, keys: list[str]) -> DataFrame:
    """What the fold makes of rows (*keys, word) with words of 1 to LONGEST characters.

    (*keys, word, ids) for a unigram model.  (*keys, word, cuts) for a BPE model: bit i is set where a piece begins or ends
    at character i.
    """
    shared = words.sparkSession.sparkContext.broadcast(model)  # the model's size, whatever the data
    edge = "struct<ends:bigint,mid:bigint>" if model.bpe else "struct<at:int,piece:struct<score:double,id:int>>"
    lattice = words.select(*keys, "word", F.arrow_udf(_lattice(shared), f"array<{edge}>").asNondeterministic()("word").alias("edges"))
    if model.bpe:
        return lattice.select(*keys, "word", F.expr(_fold_merges()).alias("cuts"))
    return lattice.withColumn("edges", F.map_from_entries("edges")).select(*keys, "word", F.expr(_fold_paths(model)).alias("ids"))


_PACK, _ROWS, _SHARE = 2 << 20, 50_000, 4096
#: Words and bytes of text that are worked on at a time: what is made meanwhile is many times their size.
_WORDS, _TEXT = 4_000, 256 << 10


def _spans(texts: pa.StringArray) -> Iterator[tuple[int, int]]:
    """Stretches of about ``_TEXT`` bytes of ``texts``, a longer text alone."""
    end = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(end, (int(end[at - 1]) if at else 0) + _TEXT, "right")))
        yield at, to
        at = to


def _tidy() -> None:
    """What is free goes back to the system: workers live long, and an executor's memory has room for little else beside its heap."""
    pa.default_memory_pool().release_unused()
    if trim := getattr(_libc(), "malloc_trim", None):
        trim(0)


@lru_cache(1)
def _libc() -> ctypes.CDLL | None:
    try:
        return ctypes.CDLL(None)
    except (OSError, TypeError):
        return None


def _packer(text_col: str, groups: int) -> Callable:
    """Rows to packs of about ``_PACK`` bytes of text, compressed, dealt to groups in turn."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gid = TaskContext.get().partitionId() * 7919 % groups
        for b in batches:
            size = pc.fill_null(pc.binary_length(b.column(text_col)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
            end = np.cumsum(size + 64)
            at = 0
            while at < b.num_rows:
                before = int(end[at - 1]) if at else 0
                to = max(at + 1, int(np.searchsorted(end, before + _PACK, "right")))
                part = b.slice(at, to - at)
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, part.schema, options=pa.ipc.IpcWriteOptions(compression=pa.Codec("zstd", 6))) as w:
                    w.write_batch(part)
                yield pa.RecordBatch.from_arrays([pa.array([gid], pa.int64()), pa.array([sink.getvalue().to_pybytes()], pa.binary())], names=["gid", "pack"])
                gid, at = (gid + 1) % groups, to

    return run


def _unpacked(pack: pa.Scalar) -> pa.RecordBatch:
    with pa.ipc.open_stream(pack.as_buffer()) as r:
        return r.read_next_batch()


def _word_lister(shared, text_col: str) -> Callable:
    """The distinct words (as far as the lattice takes them) of each group, from packs in the order of groups."""

    def rows(gid: int, held: list[pa.StringArray]) -> Iterator[pa.RecordBatch]:
        if not held:
            return
        words = pa.chunked_array(held, pa.string()).unique()
        size = pc.utf8_length(words)
        # what is never merged needs no lattice
        words = words.filter(pc.and_(pc.greater(size, 1 if shared.value.bpe else 0), pc.less_equal(size, LONGEST)))
        words = words.take(pc.array_sort_indices(words))  # in order they are stored in less
        for i in range(0, len(words), _ROWS):
            part = words.slice(i, _ROWS)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(part), gid)), part], names=["gid", "word"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held = None, []
        for b in batches:
            for gid, pack in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                if gid != now:
                    yield from rows(now, held)
                    now, held = gid, []
                texts = _unpacked(pack).column(text_col).drop_null()
                held.append(pa.chunked_array([shared.value.words_of(texts.slice(a, z - a))[0].unique() for a, z in _spans(texts)], pa.string()).unique())
                del texts
                _tidy()
        yield from rows(now, held)
        del held
        _tidy()

    return run


def _texts(model: PieceModel, ids: pa.ListArray) -> pa.StringArray:
    out = [pa.array([], pa.string())]
    for i in range(0, len(ids), 300):  # a few rows at a time: their pieces are many times their size
        out.append(pa.array([t if t is None else t.decode("utf-8", "replace") for t in model.decode(ids.slice(i, 300))], pa.string()))
    pa.default_memory_pool().release_unused()
    return pa.concat_arrays(out)


def _group_encoder(shared, names: list[str], text_col: str, decoded: bool) -> Callable:
    def run(key, left: pa.Table, right: pa.Table) -> pa.Table:
        model, done = shared.value, []
        known = right.column("word").combine_chunks()
        known = pa.concat_arrays(known.chunks) if isinstance(known, pa.ChunkedArray) else known
        folded = pa.concat_arrays(right.column("folded").chunks) if right.num_rows else None
        if folded is None:
            lists = pa.array([], pa.list_(pa.int32()))
        elif model.bpe:
            lists = pa.concat_arrays([model.between(known.slice(i, _WORDS), folded.slice(i, _WORDS).to_numpy()) for i in range(0, len(known), _WORDS)])
        else:
            lists = folded
        for pack in left.column("pack"):
            whole = _unpacked(pack)
            spans = list(_spans(whole.column(text_col)))
            parted = [model.words_of(whole.column(text_col).slice(a, z - a).drop_null()) for a, z in spans]
            words = pa.concat_arrays([w for w, _ in parted]).dictionary_encode()
            distinct, first = words.dictionary, 0
            at = pc.index_in(distinct, value_set=known)
            # without an edge of several characters, or longer than the lattice takes
            new = at.is_null().to_numpy(zero_copy_only=False)
            more = pa.array([model.encode_word(w) for w in distinct.filter(at.is_null()).to_pylist()], pa.list_(pa.int32()))
            place = np.where(new, len(new) - new.sum() + np.cumsum(new) - 1, np.cumsum(~new) - 1)
            coding = pa.concat_arrays([lists.take(at.drop_null()), more]).take(pa.array(place))
            for (a, z), (listed, ends) in zip(spans, parted, strict=True):
                rows = whole.slice(a, z - a)
                valid = rows.column(text_col).is_valid()
                own = coding.take(words.indices.slice(first, len(listed)))
                first += len(listed)
                size = np.concatenate([[0], np.cumsum(pc.list_value_length(own).to_numpy())]).astype(np.int64)
                ids, stop = model.settled(own.flatten().to_numpy(), size[ends])
                last = np.zeros(rows.num_rows + 1, np.int64)
                last[1:][valid.to_numpy(zero_copy_only=False)] = np.diff(stop, prepend=0)
                made = pa.ListArray.from_arrays(pa.array(np.cumsum(last), pa.int32()), pa.array(ids, pa.int32()), mask=pc.invert(valid))
                done.append(pa.RecordBatch.from_arrays([*rows.columns, made, *([_texts(model, made)] if decoded else [])], names=names))
            del whole, rows, parted, listed, words, distinct, coding, own, ids, made
            _tidy()
        del lists, known, folded
        _tidy()
        return pa.Table.from_batches(done)

    return run


def encode(docs: DataFrame, model: PieceModel, text_col: str = "text", out: str = "piece_ids", decoded: str | None = None, group_bytes: int = 24 << 20) -> DataFrame:
    """``docs`` with a column ``out`` of piece ids (array of int); ``decoded`` names one of the texts that the ids give back.

    A null text gives null, an empty one no ids.  Equal texts get equal ids, repeated rows stay.  A column already called
    ``out`` or ``decoded`` is replaced; other columns stay as they are, whatever their names.  An empty table gives no rows.  Texts of any
    length are whole; a group is about ``group_bytes`` of text, or one text that is longer.  Texts go once through a
    shuffle, compressed, to groups dealt by place, never by content, so copies spread.  A word travels once from and to
    each group that holds it, and is folded once for every ``_SHARE`` groups.
    """
    made = [StructField(out, ArrayType(IntegerType())), *([StructField(decoded, StringType())] if decoded else [])]
    docs = docs.drop(*[f.name for f in made if f.name in docs.columns])
    shared = docs.sparkSession.sparkContext.broadcast(model)  # the model's size, whatever the data
    size = docs.agg(F.sum(F.coalesce(F.octet_length(F.col(text_col)), F.lit(0)) + F.lit(64)).alias("n")).first().n or 0
    # read twice, exchanged once: both uses take all columns
    packed = docs.mapInArrow(_packer(text_col, size // group_bytes + 1), "gid bigint, pack binary").repartition("gid")
    held = packed.sortWithinPartitions("gid").mapInArrow(_word_lister(shared, text_col), "gid bigint, word string").repartition("word")
    # the groups of a word are at most _SHARE numbers in one row, however common it is
    words = held.groupBy("word", F.expr(f"gid div {_SHARE}").alias("share")).agg(F.collect_list("gid").alias("gids"))
    folded = encode_words(words, model, ["gids"])
    coded = folded.select(F.explode("gids").alias("group"), "word", F.col(folded.columns[-1]).alias("folded"))
    schema = StructType([*docs.schema.fields, *made])
    return packed.groupBy("gid").cogroup(coded.groupBy("group")).applyInArrow(_group_encoder(shared, schema.names, text_col, bool(decoded)), schema)


def decode(coded: DataFrame, model: PieceModel, ids_col: str = "piece_ids", out: str = "decoded") -> DataFrame:
    """``coded`` with a text column ``out``; null ids give null, bytes that are no UTF-8 become replacement characters."""
    shared = coded.sparkSession.sparkContext.broadcast(model)

    def work(ids: pa.Array) -> pa.Array:
        return _texts(shared.value, ids)

    work.__annotations__ = {"ids": pa.Array, "return": pa.Array}
    return coded.withColumn(out, F.arrow_udf(work, "string").asNondeterministic()(F.col(ids_col)))


__all__ = ["PieceModel", "decode", "encode", "encode_words", "load"]
