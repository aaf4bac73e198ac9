"""Steps that ask a language model: extraction, completion, merges, aliases by text windows, types.

``make`` is a function without arguments that gives a back end in the Python worker. What the model answers is only
proposed: deterministic operators apply it. One graph's calls are in order in one task, graphs are spread over tasks.
"""

from __future__ import annotations

import json
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import chunks_of
from . import graphs
from .graphs import WIDE, Builder, Graphs, map_groups
from .resolve import UNKNOWN

MOST_KNOWN, MOST_RECENT, BATCH, WINDOW = 200, 20, 50, 20_000
SCOPES = {
    "impersonation": "Find names in the text that one and the same character uses as a borrowed identity.",
    "broad": "Find names, borrowed identities and descriptions in the text that stand for one and the same entity.",
}
EXTRACT = "Extract the entities, the moments in narrative order with their transition, and the facts of the passage as JSON."
COMPLETE = "Name entities, relations and attributes of the text that the graph lacks, as JSON."
MERGE = "Group the names that stand for one and the same entity, as JSON."
TYPE = "Give each entity a type: personnage, lieu, organisation, objet, document or autre, as JSON."


def schema(*required: str) -> dict:
    return {"type": "object", "properties": {k: {"type": "array"} for k in required}, "required": list(required)}


def chunk_prompt(chunk: str, b: Builder) -> str:
    """Known entities (the first ``MOST_KNOWN``), the moments read last, and the chunk."""
    known = [e["name"] for e in b.names.own.values()][:MOST_KNOWN]
    recent = sorted(b.moments.items(), key=lambda m: m[1][:2])[-MOST_RECENT:]
    parts = ["Known entities: " + ", ".join(known)] if known else []
    parts += ["Recent moments:\n" + "\n".join(f"M{i}: {summary}" for i, (_, _, summary) in recent)] if recent else []
    return "\n\n".join([*parts, "Passage:\n" + chunk])


def listing(b: Builder, kind: str | None = None, most: int = 5) -> str:
    """A line for each entity (of type ``kind`` only): type, aliases, and at most ``most`` relations."""
    about: dict[str, list[str]] = {}
    names = {k: e["name"] for k, e in b.names.own.items()}
    for name, source, target in b.relations.values():
        line = f"{names[source]} --{name}--> {names[target]}"
        for key in dict.fromkeys((source, target)):
            about.setdefault(key, []).append(line)
    lines = []
    for key, e in b.names.own.items():
        if kind in (None, e["type"]):
            lines.append(f"- {e['name']} ({e['type']})" + (f", also {', '.join(e['aliases'])}" if e["aliases"] else "") + (f"; {'; '.join(about[key][:most])}" if key in about else ""))
    return "\n".join(lines)


def extract(texts: DataFrame, make: Callable, chunk_size: int = 8000) -> Graphs:
    """texts (graph_id, text): each is read chunk by chunk, with what is known so far in the prompt."""

    def solve(key, rows):
        b, model = Builder(), make()
        for i, chunk in enumerate(chunks_of(rows[0][1], chunk_size)):
            b.chunk(i, model.complete(EXTRACT, chunk_prompt(chunk, b), schema("entities", "moments")))
        return list(b.rows(key[0]))

    return Graphs.from_rows(map_groups(texts.select("graph_id", "text"), ["graph_id"], [], solve, f"graph_id {dict(texts.dtypes)['graph_id']}, tbl string, {WIDE}"))


def asked(g: Graphs, make: Callable, ask: Callable, texts: DataFrame | None = None) -> Graphs:
    """``g`` after ``ask(builder, model, text)`` in a fold of each graph; ``text`` is '' without ``texts`` (graph_id, text)."""
    ops = graphs.ops_of(g)
    if texts is not None:
        ops = ops.unionByName(texts.select("graph_id", F.lit(99).alias("stage"), F.lit(0).cast("long").alias("seq"), F.col("text").alias("op")))

    def solve(key, rows):
        b, text = Builder(), ""
        for _, stage, _, op in rows:
            if stage == 99:
                text = op or ""
            else:
                b.do(json.loads(op))
        ask(b, make(), text)
        return list(b.rows(key[0]))

    rows = map_groups(ops.select("graph_id", "stage", "seq", "op"), ["graph_id"], ["stage", "seq", "op"], solve, f"graph_id {dict(ops.dtypes)['graph_id']}, tbl string, {WIDE}")
    return Graphs.from_rows(rows)


def complete(g: Graphs, texts: DataFrame, make: Callable) -> Graphs:
    def ask(b, model, text):
        found = model.complete(COMPLETE, f"Text:\n{text}\n\nGraph:\n{listing(b)}", schema("entities", "relations"))
        pairs = lambda x: {a["name"]: a["value"] for a in x.get("attributes") or () if (a.get("name") or "").strip()}
        for e in found["entities"]:
            b.entity(e.get("name"), e.get("type"), e.get("aliases"), pairs(e))
        for r in found["relations"]:
            b.relation(r.get("name"), r.get("source"), r.get("target"), pairs(r))

    return asked(g, make, ask, texts)


def merging(b, model, text) -> None:
    if len(b.names.own) > 1:
        b.groups(model.complete(MERGE, listing(b), schema("groups"))["groups"])


def aliasing(scope: str = "impersonation", window: int = WINDOW) -> Callable:
    if scope not in SCOPES:
        raise ValueError(f"unknown scope: {scope!r}")

    def ask(b, model, text):
        known, found = listing(b), []
        for part in chunks_of(text, window):
            found += model.complete(SCOPES[scope], f"Text:\n{part}\n\nEntities:\n{known}", schema("groups"))["groups"]
        b.groups(found)

    return ask


def typing(batch: int = BATCH) -> Callable:
    def ask(b, model, text):
        while todo := [e["name"] for e in b.names.own.values() if e["type"] == UNKNOWN]:
            for i in range(0, len(todo), batch):
                b.types(model.complete(TYPE, f"Entities: {', '.join(todo[i : i + batch])}\n\n{listing(b)}", schema("types"))["types"])
            if sum(e["type"] == UNKNOWN for e in b.names.own.values()) == len(todo):
                break

    return ask


def canonicalize(g: Graphs, make: Callable) -> Graphs:
    """One call for each graph of two entities or more; the groups that it proposes are merged."""
    return asked(g, make, merging)


def resolve_aliases(g: Graphs, texts: DataFrame, make: Callable, scope: str = "impersonation", window: int = WINDOW) -> Graphs:
    """One call for each window of the text, each with the whole listing; the groups of all windows are applied once."""
    return asked(g, make, aliasing(scope, window), texts)


def type_unknown(g: Graphs, make: Callable, batch: int = BATCH) -> Graphs:
    """Asks for the types of unknown entities, ``batch`` at a time, again until a turn fills none."""
    return asked(g, make, typing(batch))


def refine(g: Graphs, texts: DataFrame, make: Callable, scope: str = "impersonation") -> Graphs:
    """Merges by names, then aliases by the text, then types: one fold of each graph."""
    steps = [merging, aliasing(scope), typing()]

    def ask(b, model, text):
        for step in steps:
            step(b, model, text)

    return asked(g, make, ask, texts)
