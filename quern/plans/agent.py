"""Answering a question without a language model: a router, a registry of typed query templates, parameter resolution."""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.operators import fulltext, vector
from quern.plans import retrieval
from quern.schema import GraphState

#: Labels whose names are proper nouns: looked up as text first.
PROPER = ("Person", "Place", "WaterBody", "NativeNation")


@dataclass(frozen=True)
class Slot:
    """A parameter: ``label`` is a node label or ``date``; ``query`` the phrase to look up."""

    name: str
    label: str
    query: str


@dataclass(frozen=True)
class Template:
    """``make(state, params)`` for questions that ``pattern`` matches; its named groups fill ``slots`` (name -> label)."""

    name: str
    pattern: str
    slots: dict[str, str]
    make: Callable[[GraphState, dict], DataFrame]

    def plan(self, question: str) -> list[Slot] | None:
        m = re.search(self.pattern, question, re.I)
        return [Slot(k, v, (m.groupdict().get(k) or "").strip()) for k, v in self.slots.items()] if m else None


@dataclass
class Call:
    tool: str
    rows: DataFrame | None
    params: dict = field(default_factory=dict)
    error: str | None = None


@dataclass
class Agent:
    state: GraphState
    templates: list[Template]
    embed: Callable[[str], list[float]]
    k: int = 8

    def route(self, question: str) -> str:
        """``query`` if a template fits, ``sequence`` for what led up to something, else ``vector``."""
        if any(t.plan(question) is not None for t in self.templates):
            return "query"
        return "sequence" if re.search(r"\b(before|lead(ing)? up|led up|preced)", question, re.I) else "vector"

    def resolve(self, slot: Slot, question_vector: list[float]):
        """A date (that of the nearest dated chunk, by the question's own vector), or a node's canonical name, or None.

        Proper nouns go by full text and, without a hit, by vector; concepts by vector alone.  A generic node is no answer.
        """
        if slot.label == "date":
            top = vector.top_k(self.state.chunks, question_vector, 3, id_col="chunk_id").filter("date is not null").orderBy(F.desc("score"), "chunk_id").first()
            return top.date if top else None
        own = self.state.nodes.filter(F.col("label") == slot.label)
        if slot.label in PROPER:
            text = F.concat_ws(" ", "canonical_name", "name", F.array_join(F.coalesce("aliases", F.array().cast("array<string>")), " "))
            hit = fulltext.search(fulltext.index(own, "node_id", text), slot.query, fulltext.corpus_size(own, text), 1).first()
            if hit:
                return own.filter(F.col("node_id") == hit.id).first().canonical_name
        best = vector.top_k(own.filter("embedding is not null"), self.embed(slot.query), 1, id_col="node_id").filter("not coalesce(is_generic, false)").first()
        return best.canonical_name if best else None

    def query(self, question: str) -> Call:
        """The first template that fits, tried once more if it fails; parameters that resolve to nothing are left out."""
        t, slots = next((t, s) for t in self.templates if (s := t.plan(question)) is not None)
        v = self.embed(question)
        params = {s.name: r for s in slots if (r := self.resolve(s, v)) is not None}
        error = None
        for _ in range(2):
            try:
                rows = t.make(self.state, params)
                rows.schema  # noqa: B018  analysis errors show here
                return Call("query", rows, params)
            except Exception as e:  # noqa: BLE001  a failed query is reported, not raised
                error = str(e)
        return Call("query", None, params, error)

    def run(self, question: str) -> Call:
        tool = self.route(question)
        if tool == "query":
            return self.query(question)
        v = self.embed(question)
        if tool == "vector":
            return Call(tool, vector.top_k(self.state.chunks, v, self.k, id_col="chunk_id"))
        anchors = vector.top_k(self.state.chunks, v, 3, id_col="chunk_id").select(F.col("chunk_id").alias("anchor"), "sequence")
        return Call(tool, retrieval.sequence_context(self.state.chunks, anchors))

    def events(self, question: str, most: int = 12) -> Iterator[str]:
        """NDJSON lines: the tool, its rows (scores to 3 decimals), the end."""
        call = self.run(question)
        yield json.dumps({"type": "tool", "tool": call.tool, "params": {k: str(v) for k, v in call.params.items()}})
        if call.error:
            yield json.dumps({"type": "error", "message": call.error.splitlines()[0]})
        if call.rows is not None:
            rows = call.rows.drop("embedding") if "embedding" in call.rows.columns else call.rows
            if "score" in rows.columns:
                rows = rows.withColumn("score", F.round("score", 3))
            for line in rows.limit(most).toJSON().collect():  # at most ``most`` rows
                yield json.dumps({"type": "row", "row": json.loads(line)})
        yield json.dumps({"type": "done"})


def hashed_embedder(dim: int = 64) -> Callable[[str], list[float]]:
    """A deterministic stand-in for an embedding model: word counts in hashed places, of unit length."""
    import hashlib

    def embed(text: str) -> list[float]:
        v = [0.0] * dim
        for w in re.findall(r"\w+", text.lower()):
            v[int.from_bytes(hashlib.sha1(w.encode()).digest()[:4], "big") % dim] += 1.0
        n = sum(x * x for x in v) ** 0.5
        return [x / n for x in v] if n else v

    return embed
