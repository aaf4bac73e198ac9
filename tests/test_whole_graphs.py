"""Whole graphs: identity, extraction, stores, refinement, timelines against a plain implementation, answers."""

from __future__ import annotations

import json
import random
import sqlite3

import pytest
from pyspark.sql import functions as F

from fabula import cli
from fabula.operators import graphs, present, refine, timeline
from fabula.operators.graphs import Builder, Graphs
from fabula.operators.grouped import BYTES, batches_of, map_groups
from fabula.sources import backends, stores


def names(b):
    return [(e["name"], e["type"], e["aliases"]) for e in b.names.own.values()]


def test_a_name_finds_its_entity_with_title_alias_or_bare():
    b = Builder()
    b.entity("Vautier", "personnage")
    b.entity("le docteur Vautier", "")
    b.entity("DOCTEUR  Vautier")
    assert names(b) == [("Vautier", "personnage", [])]
    b.entity("M. Orsel", "personnage", ["le Borgne"])
    assert b.names.find("Orsel")["name"] == "M. Orsel" and b.names.find("le borgne")["name"] == "M. Orsel"
    b.entity("Mme Orsel", "personnage")
    assert b.names.find("Orsel") is None and len(b.names.own) == 3
    b.entity("Borgne", "lieu", ["Vautier", "la tour"])  # the alias's bare form; a name that is another entity's is no alias
    assert b.names.find("Borgne")["name"] == "M. Orsel" and b.names.find("Vautier")["name"] == "Vautier"


def test_types_and_relations():
    b = Builder()
    assert b.relation("knows", "Ada", "Pont‑Neuf") == ("knows", "ada", "pont-neuf") and b.relation("KNOWS", "ada", "Pont-Neuf")
    assert len(b.relations) == 1 and [t for _, t, _ in names(b)] == ["inconnu", "inconnu"]
    b.entity("Ada", "Personnage")
    b.entity("Pont-Neuf", "INCONNU")
    b.entity("Pont-Neuf", "lieu")
    b.entity("Ada", "objet")
    assert [t for _, t, _ in names(b)] == ["personnage", "lieu"]
    assert b.entity("  ") is None and b.relation("x", "Ada", "") is None and b.skipped == 2
    assert b.fact("Ada", attribute=" age ", value=" 8 ") == ["ada"] and b.fact("ADA", attribute="age", value="8", moment=99) == []
    assert b.fact("Ada", attribute="") == [] and b.fact(relation="knows", source="Ada", target="Pont-Neuf", attribute="since", value="1") == ["ada", "pont-neuf"]


def moment(ref="", kind="suite", target="", value=0, unit="", present=(), facts=(), summary=""):
    return {"ref": ref, "summary": summary, "transition": {"type": kind, "target": target, "gap_value": value, "gap_unit": unit}, "entities_present": list(present), "facts": list(facts)}


CASES = [
    ([[moment()], [moment(kind="ellipse", value=10, unit="années")]], [(1, "avant", 2, 3650.0)]),
    ([[moment(), moment(kind="flashback")]], [(2, "avant", 1, None)]),
    ([[moment()], [moment(kind="flashback"), moment(kind="retour", target="M1")]], [(2, "avant", 1, None), (1, "avant", 3, None)]),
    ([[moment(), moment(), moment("m1"), moment("m2", "retour", "m2")]], [(1, "avant", 2, None), (2, "avant", 3, None), (3, "avant", 4, None)]),
    ([[moment("a"), moment(kind="parallèle", target="a"), moment(kind="parallèle")]], [(2, "simultané", 1, None)]),
    ([[moment("a")], [moment(kind="parallèle", target="a"), moment(kind="odd")]], [(2, "avant", 3, None)]),
]


@pytest.mark.parametrize("chunks, want", CASES)
def test_transitions_of_extracted_moments(chunks, want):
    b = Builder()
    for i, moments in enumerate(chunks):
        b.chunk(i, {"moments": moments})
    assert [(a, r, c, d) for a, r, c, _, d in b.constraints] == want


def story(spark):
    age = lambda x: {"entity": "Ada", "attribute": "age", "value": x}
    knows = {"relation": "knows", "source": "Ada", "target": "Bo", "attribute": "how", "value": "well"}
    replies = [
        {"entities": [{"name": "Ada", "type": "personnage", "aliases": ["A."]}, {"name": " "}], "moments": [moment(present=["A."], facts=[age("8"), {"entity": "Ada"}], summary="</script><b>")]},
        {"entities": [], "moments": [moment(kind="ellipse", value=10, unit="ans", facts=[age("18"), knows]), moment(facts=[age("18")])]},
    ]
    made = []

    def make():
        made.append(backends.Scripted(replies))
        return made[-1]

    texts = spark.createDataFrame([("g", "First part.\n\nSecond part.")], "graph_id string, text string")
    return refine.extract(texts, make, 13)


def test_extraction_and_answers(spark, tmp_path, capsys):
    g = story(spark)
    assert [tuple(r) for r in g["moments"].orderBy("id").select("id", "resolved_order", "resolved_days").collect()] == [(1, 0, 0.0), (2, 1, 3650.0), (3, 2, None)]
    assert {(r[1], r[2]) for r in g["appearances"].collect()} == {(1, 1), (2, 1), (2, 2), (3, 1)}
    page = json.loads(present.answered(g, present.payload).first()["answer"])
    assert page["gaps"] == {"0": 3650.0} and page["tracks"] == [{"entity": "Ada", "count": 3, "runs": [[0, 2]]}, {"entity": "Bo", "count": 1, "runs": [[1, 1]]}]
    assert [s["entities"] for s in page["states"]] == [["Ada"], ["Ada", "Bo"], ["Ada", "Bo"]] and [s["relations"] for s in page["states"]] == [[], [0], [0]]
    assert [s["attributes"]["Ada"] for s in page["states"]] == [{"age": "8"}, {"age": "18"}, {"age": "18"}]
    assert page["states"][1]["rel_attributes"] == [{"how": {"value": "well", "moment_id": 2}}]
    html = present.page(json.dumps(page))
    assert "</script><b>" not in html and "\\u003c/script>\\u003cb>" in html
    assert "history: 8 → 18" in present.answered(g, lambda v: present.detail(v, "a.")).first()["answer"]
    path = str(tmp_path / "g.sqlite")
    stores.write_sqlite(g, path)
    again = stores.read_sqlite(spark, path)
    for t, columns in graphs.TABLES.items():
        order = sorted(columns)
        assert sorted(map(str, again[t].select(order).collect())) == sorted(map(str, g[t].select(order).collect())), t
    db = sqlite3.connect(path)
    assert db.execute("SELECT name, value FROM entity_attributes").fetchall() == [("age", "8")]
    assert cli.main(["timeline", path], spark) == 0 and "day 3650" in capsys.readouterr().out
    assert cli.main(["show", path, "--entity", "Ada"], spark) == 0 and cli.main(["viz", path, "-o", str(tmp_path / "g.html")], spark) == 0
    assert "Ada (personnage)" in capsys.readouterr().out and (tmp_path / "g.html").stat().st_size > 1000
    g.write(str(tmp_path / "p"))
    assert Graphs.read(spark, str(tmp_path / "p")).violations().isEmpty()
    broken = Graphs(g.tables | {"assertions": g["assertions"].unionByName(g["assertions"].withColumn("entity_id", F.lit(7).cast("long")).withColumn("relation_id", F.lit(1).cast("long")))})
    assert {r["rule"] for r in broken.violations().collect()} == {"assertions: id unique", "assertions: entity_id in entities", "assertions: entity or relation"}


def test_older_files(spark, tmp_path):
    path = str(tmp_path / "old.sqlite")
    db = sqlite3.connect(path)
    db.executescript("""CREATE TABLE entities (id INTEGER PRIMARY KEY, name TEXT, type TEXT); CREATE TABLE entity_aliases (entity_id INTEGER, alias TEXT);
    CREATE TABLE entity_attributes (entity_id INTEGER, name TEXT, value TEXT); CREATE TABLE relations (id INTEGER PRIMARY KEY, name TEXT, source_id INTEGER, target_id INTEGER);
    CREATE TABLE relation_attributes (relation_id INTEGER, name TEXT, value TEXT);
    INSERT INTO entities VALUES (4, 'Ada', 'personnage'), (9, 'Bo', 'lieu'); INSERT INTO entity_aliases VALUES (4, 'A.'); INSERT INTO entity_attributes VALUES (4, 'age', '8');
    INSERT INTO relations VALUES (2, 'in', 4, 9); INSERT INTO relation_attributes VALUES (2, 'since', '1')""")
    db.close()
    g = stores.read_sqlite(spark, path)
    assert [tuple(r)[1:] for r in g["entities"].orderBy("id").collect()] == [(1, "Ada", "personnage"), (2, "Bo", "lieu")]
    assert [(r["entity_id"], r["relation_id"], r["attribute"], r["value"], r["moment_id"]) for r in g["assertions"].orderBy("id").collect()] == [(1, None, "age", "8", None), (None, 1, "since", "1", None)]


def test_json_files(spark, tmp_path):
    (tmp_path / "g.json").write_text(json.dumps({"entities": [{"name": "Ada", "type": "x", "aliases": [], "attributes": {"age": "8"}}, {"name": ""}], "relations": [{"name": "in", "source": "Ada", "target": "Bo", "attributes": {}}, {"name": "in", "source": "", "target": "Bo"}]}))
    g, skipped = stores.read_saved(spark, str(tmp_path / "g.json"))
    assert skipped.first()["skipped"] == 2 and g["entities"].count() == 2 and g["assertions"].first()["value"] == "8"
    (tmp_path / "r.json").write_text(json.dumps({"text": "t", "entities": [{"name": "Ada", "type": "x", "variants": ["A."], "level": "core"}], "relations": [{"pair": ["Ada", "Bo"], "level": "optional"}], "required_merges": [[["Ada"], ["A."]]]}))
    r = stores.read_references(spark, str(tmp_path / "r.json")).first()
    assert r["entities"][0]["variants"] == ["A."] and r["required_merges"] == [[["Ada"], ["A."]]] and r["forbidden_merges"] is None


def test_merges_rebuild_identities_and_replay_the_journal():
    b = Builder()
    for name, kind in (("Ada", "personnage"), ("The Fox", "inconnu"), ("Dover", "lieu"), ("Bo", "personnage")):
        b.entity(name, kind)
    b.relation("knows", "Bo", "The Fox")
    b.relation("knows", "Bo", "Ada")
    b.moment(1)
    b.appearance(1, "The Fox")
    b.fact("The Fox", attribute="age", value="8", moment=1, chunk=0)
    b.fact("Ada", attribute="age", value="8", moment=1, chunk=0)
    b.groups([{"canonical": "Ada", "members": ["The Fox", "Ada", "Dover", "nobody"]}, {"canonical": "Bo", "members": ["Bo", "Ada"]}])
    assert names(b)[0] == ("Ada", "personnage", ["The Fox"])
    assert [n for n, *_ in names(b)] == ["Ada", "Dover", "Bo"] and len(b.relations) == 1
    assert list(b.present) == [(1, "ada")] and len(b.journal) == 1 and next(iter(b.journal.values()))[-2:] == (1, 0)


def test_windows_batches_and_turns(spark):
    g = story(spark)
    asked = []

    def answer(system, user):
        asked.append(user)
        return {"groups": [{"canonical": "Ada", "members": ["Ada", "Bo"]}]}

    b, model = Builder(), backends.Scripted(answer)
    b.entity("Ada")
    b.entity("Bo")
    refine.aliasing("broad", 8)(b, model, "Alpha.\n\nBeta.\n\nGamma.")
    assert len(asked) == 3 and all("Bo" in u for u in asked) and [n for n, *_ in names(b)] == ["Ada"]
    with pytest.raises(ValueError):
        refine.aliasing("wide")
    b = Builder()
    for i in range(5):
        b.entity(f"n{i}")
    one = backends.Scripted(lambda s, u: {"types": [{"name": u.split("\n")[0].removeprefix("Entities: ").split(", ")[0], "type": "lieu"}]})
    refine.typing(2)(b, one, "")
    assert {t for _, t, _ in names(b)} == {"lieu"} and len(one.asked) == 5
    b = Builder()
    b.entity("n")
    none = backends.Scripted(lambda s, u: {"types": []})
    refine.typing()(b, none, "")
    assert len(none.asked) == 1
    done = refine.refine(g, spark.createDataFrame([("g", "text")], "graph_id string, text string"), lambda: backends.Scripted(lambda s, u: {"groups": [], "types": [{"name": "Bo", "type": "lieu"}]}))
    assert {r["name"]: r["type"] for r in done["entities"].collect()} == {"Ada": "personnage", "Bo": "lieu"}


def test_back_ends():
    with pytest.raises(ValueError):
        backends.make_backend("other")
    with pytest.raises(ValueError):
        backends.make_backend("anthropic", temperature=0.0)
    server = backends.make_backend("openai", "m", "http://localhost:1/v1/", 0.0)
    body = server.request("s", "u", {"type": "object"})
    assert server.url == "http://localhost:1/v1/chat/completions" and body["temperature"] == 0.0 and body["response_format"]["type"] == "json_schema"
    for bad in ("", None, "no json", "[]", "{}"):
        with pytest.raises(RuntimeError):
            backends.Scripted([bad]).complete("s", "u", refine.schema("groups"))


def plain_timeline(moments, constraints):
    """By repeated scans: blocks by merging sets, the earliest block without open predecessors next, days by a list as stack."""
    reading = [m[0] for m in sorted(moments, key=lambda m: m[1:])]
    sets = [{x} for x in reading]
    for a, r, b, _ in constraints:
        if r != "avant":
            x, y = next(s for s in sets if a in s), next(s for s in sets if b in s)
            if x is not y:
                x |= y
                sets = [s for s in sets if s is not y]
    sets.sort(key=lambda s: min(map(reading.index, s)))
    of = {x: i for i, s in enumerate(sets) for x in s}
    edges = [(of[a], of[b], d) for a, r, b, d in constraints if r == "avant" and of[a] != of[b]]
    left, order = list(range(len(sets))), []
    while left:
        free = [x for x in left if not any(b == x and a in left for a, b, _ in edges)]
        order.append((free or left)[0])
        left.remove(order[-1])
    ranked = [x for s in order for x in sorted(sets[s], key=reading.index)]
    day, stack = {order[0]: 0.0}, [order[0]]
    while stack:
        here = stack.pop()
        for a, b, d in edges:
            for other, step in ((b, d), (a, None if d is None else -d)):
                if step is not None and here in (a, b) and here != other and other not in day:
                    day[other] = day[here] + step
                    stack.append(other)
    return {x: i for i, x in enumerate(ranked)}, {x: day.get(of[x]) for x in reading}


def test_timelines_with_cycles_ties_and_branches():
    rng = random.Random(3)
    cycles = 0
    for _ in range(400):
        n = rng.randint(1, 9)
        moments = [(10 + i, rng.randint(0, 2), i) for i in range(n)]
        constraints = [(10 + rng.randrange(n), rng.choice(["avant", "avant", "avant", "simultané", "pendant"]), 10 + rng.randrange(n), rng.choice([None, 1.0, 5.0])) for _ in range(rng.randint(0, 10))]
        rank, day, notes = timeline.order_moments(moments, constraints)
        assert (rank, day) == plain_timeline(moments, constraints)
        cycles += any(x.startswith("cycle") for x in notes)
    assert cycles > 20
    assert timeline.order_moments([(1, 0, 0)], [(1, "avant", 2, 1.0)]) == ({1: 0}, {1: 0.0}, ["unknown:1:2"])


def test_groups_keep_nulls_and_long_numbers(spark):
    big = 2**53 + 1
    rows = spark.createDataFrame([(None, big, "x"), (None, 1, None), (3, big, "y"), (3, None, "z")], "k long, v long, s string")
    got = map_groups(rows, ["k"], ["v"], lambda key, rows: [(key[0], [r[1] for r in rows].count(big), len(rows))], "k long, n long, rows long").collect()
    assert sorted(map(tuple, got), key=str) == [(3, 1, 2), (None, 1, 2)]
    assert map_groups(rows.limit(0), ["k"], ["v"], lambda key, rows: [], "k long, n long").count() == 0


def test_files_pass_in_batches_of_bounded_bytes(spark):
    import pyarrow as pa

    schema = pa.schema([("n", pa.int64()), ("content", pa.binary())])
    got = list(batches_of(((i, b"x" * 1_000_000 if i % 2 else None) for i in range(60)), schema))
    assert max(b.nbytes for b in got) < BYTES + 1_100_000 and [n for b in got for n in b.column(0).to_pylist()] == list(range(60))
    chunk = json.dumps({"moments": [moment(present=["Ada"])]})
    payloads = spark.range(600).select(F.col("id").alias("graph_id"), F.lit(0).alias("chunk_index"), F.lit(chunk).alias("payload"))
    files = stores.to_files(graphs.extracted(payloads))
    assert files.agg(F.max(F.length("content"))).first()[0] < 32_000
    rows = stores.of_files(files).rows().groupBy("tbl").count().collect()
    assert {r["tbl"]: r["count"] for r in rows} == {"entities": 600, "moments": 600, "appearances": 600}


def test_graphs_are_built_again_without_joins(spark):
    reply = {
        "entities": [{"name": "Ada", "type": "personnage", "aliases": ["zz", "A.", "m b"]}, {"name": "M. Bo", "type": "", "aliases": ["B.", "aa"]}, {"name": "Dover", "type": "lieu"}],
        "moments": [moment(present=["Dover", "A."], facts=[{"entity": "Bo", "attribute": "age", "value": "8"}, {"relation": "knows", "source": "Ada", "target": "Bo", "attribute": "how", "value": "well"}], summary="s"), moment(kind="ellipse", value=10, unit="jours", present=["Bo"])],
    }
    payloads = spark.range(40).select(F.col("id").alias("graph_id"), F.lit(0).alias("chunk_index"), F.lit(json.dumps(reply)).alias("payload"))
    g = graphs.extracted(payloads)
    lost = Graphs(g.tables | {"appearances": g["appearances"].unionByName(spark.sql("select 1L graph_id, 1L moment_id, 77L entity_id"))})
    for given in (g, lost):
        ops = graphs.ops_of(given)
        assert "Join" not in ops._jdf.queryExecution().optimizedPlan().toString()
        again = graphs.fold(ops)
        for t, columns in graphs.TABLES.items():
            order = ["graph_id", *columns]
            assert sorted(map(str, again[t].select(order).collect())) == sorted(map(str, g[t].select(order).collect())), t
    first = json.loads(present.answered(g, present.export).first()["answer"])
    assert [e["aliases"] for e in first["entities"]] == [["zz", "A.", "m b"], ["B.", "aa"], []] and first["relations"][0]["attributes"] == {"how": "well"}
