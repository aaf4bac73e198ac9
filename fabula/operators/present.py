"""Answers about whole graphs: export, payload of the page, listings, details, tracks. A document for each graph.

The set-based queries of ``state`` serve many graphs' rows; what is assembled here is one graph's, so it is a fold.
"""

from __future__ import annotations

import json
from bisect import bisect_right
from collections.abc import Callable

from pyspark.sql import DataFrame

from .graphs import Graphs, folded, ops_of
from .state import UNDATED
from .timeline import BEFORE, order_moments


class View:
    """A finished graph with the names, ranks and indexes that answers need."""

    def __init__(self, b):
        self.b = b
        self.name = {k: e["name"] for k, e in b.names.own.items()}
        self.rank, self.day, _ = order_moments([(i, c, s) for i, (c, s, _) in b.moments.items()], [(x, r, y, d) for x, r, y, _, d in b.constraints])
        self.story = sorted(b.moments, key=self.rank.get)
        self.facts = list(b.journal.values())  # entity key, relation, attribute, value, moment, chunk

    def at(self, moment) -> int:
        return self.rank.get(moment, UNDATED)

    def firsts(self) -> dict[tuple, dict[str, str]]:
        out: dict[tuple, dict[str, str]] = {}
        for e, r, attribute, value, *_ in self.facts:
            if attribute:
                out.setdefault((e, r), {}).setdefault(attribute, value)
        return out

    def history(self, about) -> dict[str, list[str]]:
        """Dated values of each attribute in story order, without repeats in a row."""
        out: dict[str, list[str]] = {}
        for _, _, attribute, value, *_ in sorted((f for f in self.facts if f[0] == about and f[4] is not None), key=lambda f: self.at(f[4])):
            values = out.setdefault(attribute, [])
            if values[-1:] != [value]:
                values.append(value)
        return out

    def involved(self) -> dict[str, dict[int, list]]:
        """For each entity its moments, by presence or by a dated fact about it or a relation of its, with those facts."""
        out: dict[str, dict[int, list]] = {k: {} for k in self.name}
        for moment, key in self.b.present:
            out[key].setdefault(moment, [])
        for f in self.facts:
            if f[4] is not None:
                for key in {f[0]} if f[0] else set(f[1][1:]):
                    out[key].setdefault(f[4], []).append(f)
        return out


def fact(v: View, f: tuple) -> dict:
    relation = v.b.relations[f[1]] if f[1] else ("", None, None)
    return {"entity": v.name.get(f[0], ""), "relation_name": relation[0], "relation_source": v.name.get(relation[1], ""), "relation_target": v.name.get(relation[2], ""), "attribute": f[2], "value": f[3], "moment_id": f[4], "chunk_index": f[5]}


def export(v: View) -> dict:
    """All six collections."""
    first, there = v.firsts(), {}
    for moment, key in v.b.present:
        there.setdefault(str(moment), []).append(v.name[key])
    return {
        "entities": [{"name": e["name"], "type": e["type"], "aliases": e["aliases"], "attributes": first.get((k, None), {})} for k, e in v.b.names.own.items()],
        "relations": [{"name": n, "source": v.name[s], "target": v.name[t], "attributes": first.get((None, i), {})} for i, (n, s, t) in v.b.relations.items()],
        "moments": [{"id": i, "chunk_index": c, "seq": s, "summary": text, "resolved_order": v.rank[i], "resolved_days": v.day[i]} for i, (c, s, text) in v.b.moments.items()],
        "constraints": [{"source_id": a, "relation": r, "target_id": b, "gap": {"text": text, "days": days}} for a, r, b, text, days in v.b.constraints],
        "appearances": {k: sorted(x) for k, x in there.items()},
        "assertions": [fact(v, f) for f in v.facts],
    }


def runs(ranks: list[int]) -> list[list[int]]:
    out: list[list[int]] = []
    for r in ranks:
        if out and out[-1][1] + 1 == r:
            out[-1][1] = r
        else:
            out.append([r, r])
    return out


def values_by_rank(v: View) -> dict[tuple, dict[str, tuple[list[int], list]]]:
    """For each subject and attribute the ranks at which a value begins to hold, and the fact that says so."""
    found: dict[tuple, dict[str, dict[int, tuple]]] = {}
    for f in v.facts:
        if f[2]:
            found.setdefault(f[:2], {}).setdefault(f[2], {}).setdefault(v.at(f[4]), f)
    return {about: {a: (sorted(x), [x[r] for r in sorted(x)]) for a, x in of.items()} for about, of in found.items()}


def payload(v: View) -> dict:
    """What the page shows: entities, relations with their assertions, moments, gaps, tracks and the state at each moment."""
    base, of_relation = export(v), {i: [] for i in v.b.relations}
    for f in v.facts:
        if f[1] and f[2]:
            of_relation[f[1]].append({"attribute": f[2], "value": f[3], "moment_id": f[4]})
    seen: dict = {}
    for moment, key in v.b.present:
        seen[key] = min(seen.get(key, v.at(moment)), v.at(moment))
    for f in v.facts:
        for about in [f[0]] if f[0] else [f[1], *f[1][1:]]:
            seen[about] = min(seen.get(about, v.at(f[4])), v.at(f[4]))
    seen_first = {k: seen.get(k, UNDATED) for k in v.name}
    linked_first = [max(seen.get(i, UNDATED), seen_first[i[1]], seen_first[i[2]]) for i in v.b.relations]
    held = values_by_rank(v)

    def state(about, at) -> dict:
        out = {}
        for attribute, (ranks, facts) in held.get(about, {}).items():
            if k := bisect_right(ranks, at):
                out[attribute] = facts[k - 1]
        return out

    states = []
    for m in v.story:
        at = v.rank[m]
        states.append({
            "entities": [v.name[k] for k, r in seen_first.items() if r <= at],
            "relations": [i for i, r in enumerate(linked_first) if r <= at],
            "attributes": {v.name[k]: {a: f[3] for a, f in state((k, None), at).items()} for k in v.name},
            "rel_attributes": [{a: {"value": f[3], "moment_id": f[4]} for a, f in state((None, i), at).items()} for i in v.b.relations],
        })
    gaps = {str(v.rank[a]): days for a, r, b, _, days in v.b.constraints if r == BEFORE and days is not None and v.rank[b] == v.rank[a] + 1}
    tracks = [{"entity": v.name[k], "count": len(x), "runs": runs(sorted(v.rank[m] for m in x))} for k, x in v.involved().items() if x]
    return {
        "entities": base["entities"],
        "relations": [r | {"assertions": of_relation[i]} for r, i in zip(base["relations"], v.b.relations, strict=True)],
        "moments": [{"id": m, "order": v.rank[m], "days": v.day[m], "summary": v.b.moments[m][2]} for m in v.story],
        "gaps": gaps, "tracks": sorted(tracks, key=lambda t: (-t["count"], t["entity"])), "states": states,
    }


def tracks(v: View) -> list[tuple]:
    """(entity, place, moment, rank, facts as JSON) of all entities, in story order."""
    out = []
    for key, moments in v.involved().items():
        for place, m in enumerate(sorted(moments, key=v.rank.get)):
            out.append((v.name[key], place, m, v.rank[m], json.dumps([fact(v, f) for f in moments[m]], ensure_ascii=False)))
    return out


def show(v: View) -> str:
    first = v.firsts()
    lines = [f"{len(v.name)} entities, {len(v.b.relations)} relations"]
    lines += [f"  {e['name']} ({e['type']}): {len(first.get((k, None), {}))} attributes" for k, e in sorted(v.b.names.own.items(), key=lambda x: x[1]["name"].lower())]
    return "\n".join([*lines, *(f"  {v.name[s]} --{n}--> {v.name[t]}" for n, s, t in v.b.relations.values())])


def detail(v: View, name: str) -> str:
    e = v.b.names.find(name)
    if e is None:
        return f"No such entity: {name}"
    lines = [f"{e['name']} ({e['type']})"] + ([f"  alias: {', '.join(e['aliases'])}"] if e["aliases"] else [])
    history, first = v.history(e["key"]), v.firsts()
    for attribute, value in sorted(first.get((e["key"], None), {}).items()):
        lines.append(f"  {attribute}: {value}")
        if len(history.get(attribute, ())) > 1:
            lines.append(f"    history: {' → '.join(history[attribute])}")
    for i, (n, s, t) in v.b.relations.items():
        if e["key"] in (s, t):
            own = ", ".join(f"{a}={x}" for a, x in first.get((None, i), {}).items())
            lines.append(f"  {v.name[s]} --{n}--> {v.name[t]}" + (f" [{own}]" if own else ""))
    return "\n".join(lines)


def timeline(v: View) -> str:
    if not v.story:
        return "no moments"
    lines = [f"M{m} · order {v.rank[m]} · chunk {v.b.moments[m][0]}" + ("" if v.day[m] is None else f" · day {v.day[m]:.0f}") + f" — {v.b.moments[m][2]}" for m in v.story]
    return "\n".join([*lines, f"{len(lines)} moments, {len(v.b.constraints)} constraints"])


def answered(g: Graphs, answer: Callable[[View], object]) -> DataFrame:
    """(graph_id, answer) of each graph: a string as it is, else as JSON."""

    def finish(graph, b):
        found = answer(View(b))
        return [(graph, found if isinstance(found, str) else json.dumps(found, ensure_ascii=False))]

    return folded(ops_of(g), finish, "answer string")


def all_tracks(g: Graphs) -> DataFrame:
    return folded(ops_of(g), lambda graph, b: [(graph, *t) for t in tracks(View(b))], "entity string, place int, moment_id long, resolved_order int, facts string")


PAGE = """<!doctype html><meta charset="utf-8"><title>Graph</title><style>body{font:14px sans-serif;display:flex;gap:2em}section{min-width:18em}</style>
<section><input id="find" placeholder="name"><label><input id="alone" type="checkbox"> hide single</label><input id="at" type="range" min="0"><p id="moment"></p><ul id="entities"></ul></section><section><ul id="relations"></ul></section>
<script>const data = __DATA__;
const safe = s => String(s).replace(/&/g, "&amp;").replace(/</g, "&lt;").replace(/>/g, "&gt;"), by = id => document.getElementById(id);
by("at").max = Math.max(0, data.moments.length - 1);
function draw() {
  const k = +by("at").value, m = data.moments[k], state = data.states[k], find = by("find").value.toLowerCase(), linked = new Set(data.relations.flatMap(r => [r.source, r.target]));
  by("moment").innerHTML = m ? safe("M" + m.id + " " + m.summary) : "";
  const shown = data.entities.filter(e => (!state || state.entities.includes(e.name)) && (!by("alone").checked || linked.has(e.name)) && [e.name, ...e.aliases].some(n => n.toLowerCase().includes(find)));
  by("entities").innerHTML = shown.map(e => "<li>" + safe(e.name) + " (" + safe(e.type) + ") " + Object.entries((state ? state.attributes[e.name] : e.attributes) || {}).map(([a, x]) => safe(a + ": " + x)).join(", ")).join("");
  by("relations").innerHTML = data.relations.filter((r, i) => !state || state.relations.includes(i)).map(r => "<li>" + safe(r.source + " " + r.name + " " + r.target)).join("");
}
for (const id of ["find", "alone", "at"]) by(id).addEventListener("input", draw);
draw();</script>
"""


def page(payload_json: str) -> str:
    """A page of its own; no value can end the script that holds the data, as every < is escaped."""
    return PAGE.replace("__DATA__", payload_json.replace("<", "\\u003c"))
