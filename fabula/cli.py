"""Command line: extract, show, export, timeline, viz, score. A graph is a SQLite file or a folder of Parquet tables."""

from __future__ import annotations

import argparse
import os
import sys


def parser() -> argparse.ArgumentParser:
    out = argparse.ArgumentParser(prog="fabula")
    verbs = out.add_subparsers(dest="verb", required=True)
    for verb in ("extract", "show", "export", "timeline", "viz", "score"):
        p = verbs.add_parser(verb)
        p.add_argument("text" if verb == "extract" else "graph")
        if verb in ("extract", "export", "viz"):
            p.add_argument("-o", "--output", required=True)
    e = verbs.choices["extract"]
    e.add_argument("--provider", default="openai")
    e.add_argument("--model")
    e.add_argument("--base-url")
    e.add_argument("--temperature", type=float)
    e.add_argument("--chunk-size", type=int, default=8000)
    verbs.choices["show"].add_argument("--entity")
    verbs.choices["score"].add_argument("gold", help="Parquet: key (an entity's name), gold (its referent)")
    return out


def load(spark, path: str):
    from .operators.graphs import Graphs
    from .sources import stores

    return Graphs.read(spark, path) if os.path.isdir(path) else stores.read_sqlite(spark, path)


def main(argv: list[str] | None = None, spark=None) -> int:
    args = parser().parse_args(argv)
    from pyspark.sql import SparkSession
    from pyspark.sql import functions as F

    from .operators import metrics, present, refine
    from .sources import backends, stores

    spark = spark or SparkSession.builder.appName("fabula").getOrCreate()
    if args.verb == "extract":
        made = (args.provider, args.model, args.base_url, args.temperature)
        backends.make_backend(*made)  # wrong settings end here
        texts = stores.read_texts(spark, args.text).select(F.col("path").alias("graph_id"), "text")
        found = refine.extract(texts, lambda: backends.make_backend(*made), args.chunk_size)
        stores.write_sqlite(found, args.output)
        return 0
    g = load(spark, args.graph)
    if args.verb == "score":
        own = g["entities"].select(F.col("name").alias("key"), F.col("id").alias("pred")).join(spark.read.parquet(args.gold), "key")
        for name, table in (("B3", metrics.bcubed(own)), ("LEA", metrics.lea(own))):
            r = table.first()
            print(f"{name}: P {r['p']:.3f} R {r['r']:.3f} F1 {r['f1']:.3f}")
        print(f"{metrics.confusion_pairs(own).count()} pairs merged too much, {metrics.confusion_pairs(own, over=False).count()} too little")
        return 0
    name = getattr(args, "entity", None)
    answers = {"show": (lambda v: present.detail(v, name)) if name else present.show, "export": present.export, "timeline": present.timeline, "viz": present.payload}
    for row in present.answered(g, answers[args.verb]).toLocalIterator():
        if args.verb in ("show", "timeline"):
            print(row["answer"])
            continue
        with open(args.output, "w", encoding="utf-8") as f:
            f.write(present.page(row["answer"]) if args.verb == "viz" else row["answer"])
    return 0


if __name__ == "__main__":
    sys.exit(main())
