"""Graph files: SQLite databases (current and older schema), saved graphs and references in JSON, whole texts.

SQLite files are read through Spark's binary file source, so that any store that Spark reads will do, and opened in
memory in the Python worker: one file is one graph, and files are spread over tasks.
"""

from __future__ import annotations

import sqlite3
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graphs import TABLES, WIDE, Builder, Graphs, fold, folded, op, wide
from ..operators.grouped import map_groups, map_rows

#: The schema of a graph file.
DDL = """
CREATE TABLE entities (id INTEGER PRIMARY KEY, name TEXT NOT NULL UNIQUE, type TEXT NOT NULL);
CREATE TABLE entity_aliases (entity_id INTEGER NOT NULL REFERENCES entities(id), alias TEXT NOT NULL, UNIQUE (entity_id, alias));
CREATE TABLE relations (id INTEGER PRIMARY KEY, name TEXT NOT NULL, source_id INTEGER NOT NULL REFERENCES entities(id), target_id INTEGER NOT NULL REFERENCES entities(id), UNIQUE (name, source_id, target_id));
CREATE TABLE moments (id INTEGER PRIMARY KEY, chunk_index INTEGER NOT NULL, seq INTEGER NOT NULL, summary TEXT NOT NULL DEFAULT '', resolved_order INTEGER, resolved_days REAL);
CREATE TABLE moment_constraints (id INTEGER PRIMARY KEY, source_id INTEGER NOT NULL REFERENCES moments(id), relation TEXT NOT NULL, target_id INTEGER NOT NULL REFERENCES moments(id), gap_text TEXT NOT NULL DEFAULT '', gap_days REAL);
CREATE TABLE appearances (moment_id INTEGER NOT NULL REFERENCES moments(id), entity_id INTEGER NOT NULL REFERENCES entities(id), UNIQUE (moment_id, entity_id));
CREATE TABLE assertions (id INTEGER PRIMARY KEY, entity_id INTEGER REFERENCES entities(id), relation_id INTEGER REFERENCES relations(id), attribute TEXT NOT NULL DEFAULT '', value TEXT NOT NULL DEFAULT '', moment_id INTEGER REFERENCES moments(id), chunk_index INTEGER, CHECK ((entity_id IS NULL) <> (relation_id IS NULL)));
CREATE VIEW entity_attributes AS SELECT entity_id, attribute AS name, value FROM (SELECT *, min(id) AS first FROM assertions WHERE entity_id IS NOT NULL AND attribute <> '' GROUP BY entity_id, attribute);
CREATE VIEW relation_attributes AS SELECT relation_id, attribute AS name, value FROM (SELECT *, min(id) AS first FROM assertions WHERE relation_id IS NOT NULL AND attribute <> '' GROUP BY relation_id, attribute);
"""


def database_rows(graph, content: bytes) -> Iterator[tuple]:
    """The rows of a graph file. An older one has no journal: its attributes become undated assertions."""
    db = sqlite3.connect(":memory:")
    try:
        db.deserialize(content)
        has = {name for (name,) in db.execute("SELECT name FROM sqlite_master")}
        if "assertions" in has:
            for table, columns in TABLES.items():
                for row in db.execute(f"SELECT {', '.join(columns)} FROM {table} ORDER BY rowid"):
                    yield wide(graph, table, *row)
            return
        old = Builder()
        names, aliases = {}, {}
        for i, alias in db.execute("SELECT entity_id, alias FROM entity_aliases"):
            aliases.setdefault(i, []).append(alias)
        of = {kind: {} for kind in ("entity", "relation")}
        for kind, found in of.items():
            for i, name, value in db.execute(f"SELECT {kind}_id, name, value FROM {kind}_attributes"):
                found.setdefault(i, {})[name] = value
        for i, name, kind in db.execute("SELECT id, name, type FROM entities ORDER BY id"):
            names[i] = name
            old.entity(name, kind, aliases.get(i), of["entity"].get(i))
        for i, name, source, target in db.execute("SELECT id, name, source_id, target_id FROM relations ORDER BY id"):
            old.relation(name, names[source], names[target], of["relation"].get(i))
        yield from old.rows(graph)
    finally:
        db.close()


def of_files(files: DataFrame) -> Graphs:
    """Graphs of files (graph_id, content binary)."""
    kind = dict(files.dtypes)["graph_id"]
    rows = map_rows(files.select("graph_id", "content"), lambda row: database_rows(row[0], bytes(row[1])), f"graph_id {kind}, tbl string, {WIDE}")
    return Graphs.from_rows(rows, keep=False)


def read_sqlite(spark: SparkSession, path: str) -> Graphs:
    """All graph files under a path or pattern; a file's path is its graph_id."""
    return of_files(spark.read.format("binaryFile").load(path).select(F.col("path").alias("graph_id"), "content"))


def to_files(graphs: Graphs) -> DataFrame:
    """(graph_id, content): each graph as a SQLite file. Small pages, as a small graph fills few of its tables."""

    def empty() -> bytes:
        db = sqlite3.connect(":memory:")
        db.executescript("PRAGMA page_size = 1024;" + DDL)
        content = db.serialize()
        db.close()
        return content

    start = empty()

    def save(key, rows):
        db = sqlite3.connect(":memory:")
        db.deserialize(start)
        for table, columns in TABLES.items():
            at = [names.index(c) for c in columns]
            db.executemany(f"INSERT INTO {table} ({', '.join(columns)}) VALUES ({', '.join('?' * len(columns))})", ([r[i] for i in at] for r in rows if r[1] == table))
        db.commit()
        content = db.serialize()
        db.close()
        return [(key[0], content)]

    rows = graphs.rows()
    names = rows.columns
    return map_groups(rows, ["graph_id"], ["tbl", "id", "moment_id", "entity_id"], save, f"graph_id {dict(rows.dtypes)['graph_id']}, content binary")


def write_sqlite(graphs: Graphs, path: str) -> None:
    """One graph as a file of the driver's; many are better kept as ``to_files`` gives them."""
    rows = to_files(graphs).limit(2).collect()
    if len(rows) != 1:
        raise ValueError(f"a file holds one graph, not {'several' if rows else 'none'}")
    with open(path, "wb") as f:
        f.write(bytes(rows[0]["content"]))


ATTRIBUTES = "map<string,string>"
SAVED = f"entities array<struct<name:string,type:string,aliases:array<string>,attributes:{ATTRIBUTES}>>, relations array<struct<name:string,source:string,target:string,attributes:{ATTRIBUTES}>>"
LEVELLED = "name string, type string, variants array<string>, level string"
REFERENCE = "text string, entities array<struct<name:string,type:string,variants:array<string>,level:string>>, relations array<struct<pair:array<string>,level:string>>, required_merges array<array<array<string>>>, forbidden_merges array<array<array<string>>>"


def saved_ops(saved: DataFrame) -> DataFrame:
    """Operations of saved graphs (graph_id, entities, relations); other collections are not read."""
    e = saved.select("graph_id", F.posexplode("entities").alias("pos", "x")).select("graph_id", F.lit(0).alias("stage"), F.col("pos").cast("long").alias("seq"), op("entity", name=F.col("x.name"), type=F.col("x.type"), aliases=F.col("x.aliases"), attributes=F.col("x.attributes")).alias("op"))
    r = saved.select("graph_id", F.posexplode("relations").alias("pos", "x")).select("graph_id", F.lit(1).alias("stage"), F.col("pos").cast("long").alias("seq"), op("relation", name=F.col("x.name"), source=F.col("x.source"), target=F.col("x.target"), attributes=F.col("x.attributes")).alias("op"))
    return e.unionByName(r)


def of_saved(saved: DataFrame) -> tuple[Graphs, DataFrame]:
    """The graphs, and (graph_id, skipped): how many records had a blank name or end."""
    ops = saved_ops(saved)
    return fold(ops), folded(ops, lambda graph, b: [(graph, b.skipped)], "skipped long")


def read_saved(spark: SparkSession, path: str) -> tuple[Graphs, DataFrame]:
    return of_saved(spark.read.schema(SAVED).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("graph_id"), "entities", "relations"))


def read_references(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(REFERENCE).json(path, multiLine=True).select(F.col("_metadata.file_path").alias("reference_id"), "*")


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """(path, text): whole files as UTF-8."""
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
