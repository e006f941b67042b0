"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the mean of the embeddings of its byte n-grams (2 to 4, inside words and at their edges), hashed into
``BUCKETS``; a linear layer and a softmax give the language.  Trained by stochastic gradient descent in numpy on a bounded
sample of labelled texts whose features were counted on the executors.  Probabilities are calibrated by a temperature on a
part kept from training, and the rejection threshold is the confidence that all but ``REJECT`` of that part exceed.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quern.llm.labelled import bounded_sample
from quern.llm.textscan import LOWER, chunks
from quern.llm.udfs import text_udf

BUCKETS, DIM, REJECT = 1 << 16, 16, 0.001
#: Letters as they are, everything else in ASCII a blank.
_LETTERS = bytes(b if 97 <= b <= 122 or b >= 128 else 32 for b in LOWER)


def _grams(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of the n-grams from each place (BUCKETS where there is none), three rows; where each text starts."""
    parts = [b" " + (t or b"").decode("utf-8", "replace").lower().encode().translate(_LETTERS) + b"   " for t in texts]
    at = np.zeros(len(parts), np.int64)
    np.cumsum([len(p) for p in parts[:-1]], out=at[1:])
    d = np.frombuffer(b"".join(parts), np.uint8)
    n = len(d) - 3
    blank = d == 32
    w = [d[i : i + n].astype(np.uint32) for i in range(4)]
    b = [blank[i : i + n] for i in range(4)]
    two = w[0] << 8 | w[1]
    three = two << 8 | w[2]
    four = three << 8 | w[3]
    out = np.full((3, len(d)), BUCKETS, np.int32)
    for row, (gram, ok) in enumerate(((two, ~(b[0] & b[1])), (three, ~b[1] & ~(b[0] & b[2])), (four, ~(b[1] | b[2])))):
        key = ((gram + np.uint32(row * 0x51ED27)) * np.uint32(0x9E3779B1)) >> np.uint32(16)
        out[row, :n] = np.where(ok, key, BUCKETS)
    return out, at


def features(texts: list[bytes | None]) -> list[tuple[np.ndarray, np.ndarray]]:
    """(buckets, counts) of each text; at most BUCKETS of them however long the text."""
    out = []
    for t in texts:
        got = np.bincount(_grams([t])[0].ravel(), minlength=BUCKETS + 1)[:BUCKETS]
        ids = np.flatnonzero(got)
        out.append((ids.astype(np.int32), got[ids].astype(np.int32)))
    return out


@dataclass
class LanguageModel:
    langs: list[str]
    table: np.ndarray  # a logit for each language and bucket; the last bucket stands for no n-gram
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes | None]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.langs)))
        for lo, hi in chunks(texts, 1 << 19):
            grams, at = _grams(texts[lo:hi])
            n = sum(np.add.reduceat((g != BUCKETS).astype(np.int64), at) for g in grams)
            for k in range(len(self.langs)):
                total = sum(np.add.reduceat(self.table[k][g], at, dtype=np.float64) for g in grams)
                out[lo:hi, k] = total / np.maximum(n, 1) + self.bias[k]
        return out

    def predict(self, texts: list[bytes | None]) -> list[tuple[str, float, bool]]:
        """(language or ``und``, calibrated probability, rejected) of each text."""
        if not self.langs:
            return [("und", 0.0, True)] * len(texts)
        p = _softmax(self.logits(texts) / self.temperature)
        best = p.argmax(1)
        out = []
        for t, k, q in zip(texts, best.tolist(), p[np.arange(len(p)), best].tolist(), strict=True):
            known = t is not None and any(map(str.isalpha, t.decode("utf-8", "replace")))
            out.append((self.langs[k], float(min(1.0, max(0.0, q))), q < self.threshold) if known else ("und", 0.0, True))
        return out


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(axis=-1, keepdims=True))
    return x / x.sum(axis=-1, keepdims=True)


def train(rows: list[tuple[str, np.ndarray, np.ndarray]], epochs: int = 4, rate: float = 2.0, seed: int = 7) -> LanguageModel:
    """From (language, buckets, counts); every fifth row calibrates instead of teaching (all do both if there are few)."""
    langs = sorted({r[0] for r in rows})
    rng = np.random.default_rng(seed)
    e, w, b = rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS + 1, DIM)), np.zeros((len(langs), DIM)), np.zeros(len(langs))
    if not langs:
        return LanguageModel([], np.zeros((0, BUCKETS + 1), np.float32), b)
    y = [langs.index(r[0]) for r in rows]
    few = len(rows) < 50
    learn = [i for i in range(len(rows)) if few or i % 5]
    check = [i for i in range(len(rows)) if few or not i % 5]
    seen = np.zeros(BUCKETS + 1, bool)
    steps = epochs * len(learn)
    for step, i in enumerate(np.concatenate([rng.permutation(learn) for _ in range(epochs)])):
        _, ids, counts = rows[i]
        if not len(ids):
            continue
        seen[ids] = True
        share = counts / counts.sum()
        hidden = share @ e[ids]
        g = _softmax(w @ hidden + b)
        g[y[i]] -= 1
        lr = rate * (1 - step / steps)
        back = w.T @ g
        w -= lr * np.outer(g, hidden)
        b -= 0.1 * lr * g
        e[ids] -= lr * np.outer(share * len(ids) ** 0.5, back)
    e[~seen] = 0  # an n-gram never met says nothing
    table = (w @ e.T).astype(np.float32)
    logits = np.array([table[:, rows[i][1]] @ (rows[i][2] / max(1, rows[i][2].sum())) + b for i in check])
    target = np.array([y[i] for i in check])
    scales = np.geomspace(1, 20, 60)  # never sharper than trained: what was never met must stay uncertain
    loss = [-np.log(np.maximum(_softmax(logits / s)[np.arange(len(target)), target], 1e-12)).mean() for s in scales]
    s = float(scales[int(np.argmin(loss))])
    sure = np.sort(_softmax(logits / s).max(1))
    return LanguageModel(langs, table, b, s, float(min(0.5, sure[int(REJECT * len(sure))])))


def fit(labelled: DataFrame, docs: DataFrame, per_label: int = 600, id_col: str = "doc_id", text_col: str = "text") -> LanguageModel:
    """A model from ``labelled`` (id, language); ``per_label`` bounds the sample of each language."""
    sample = bounded_sample(labelled, docs, per_label, id_col, text_col)

    def work(texts):
        got = features(texts)
        return pa.array([{"ids": i, "counts": c} for i, c in got], pa.struct([("ids", pa.list_(pa.int32())), ("counts", pa.list_(pa.int32()))]))

    rows = sample.select("id", "label", text_udf("struct<ids:array<int>,counts:array<int>>", work)("text").alias("f")).orderBy(F.xxhash64("id"), "id").toArrow()
    f = rows.column("f").combine_chunks()
    ids, counts = f.field("ids"), f.field("counts")
    return train([(lab, ids[i].values.to_numpy(), counts[i].values.to_numpy()) for i, lab in enumerate(rows.column("label").to_pylist())])


def identify(docs: DataFrame, model: LanguageModel, text_col: str = "text", out: str = "language") -> DataFrame:
    """``docs`` with a struct column ``out``: lang, score (0 to 1), rejected.

    A null text or one without a letter is ``und`` with score 0 and rejected, as is everything if the model has no
    language.  Equal texts are judged alike, whatever their length; a column already called ``out`` is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)  # languages x BUCKETS numbers

    def work(texts):
        got = shared.value.predict(texts)
        return pa.array([{"lang": a, "score": s, "rejected": r} for a, s, r in got], pa.struct([("lang", pa.string()), ("score", pa.float64()), ("rejected", pa.bool_())]))

    return docs.withColumn(out, text_udf("struct<lang:string,score:double,rejected:boolean>", work)(F.col(text_col)))


def training_rows(docs: DataFrame, learns: Column, id_col: str = "doc_id", lang_col: str = "lang", text_col: str = "text") -> DataFrame:
    return docs.filter(learns & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(id_col, lang_col)
