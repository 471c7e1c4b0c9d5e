"""Command line: python -m quillwork.cli COMMAND ... (see --help). Inputs are JSON lines, CSV or Parquet."""

from __future__ import annotations

import argparse
import json
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.keys import keyed
from quillwork.operators import graph, itemsets, recommend, similar, stats
from quillwork.sources import readers, writers


def _read(spark: SparkSession, path: str, csv, js=None) -> DataFrame:
    if path.rstrip("/").endswith(".parquet"):
        return spark.read.parquet(path)
    return js(spark, path) if js and path.endswith((".json", ".jsonl")) else csv(spark, path)


def run_stats(spark, a):
    row = stats.summary(_read(spark, a.review, readers.reviews_json), a.top).first()
    top = lambda s: [[k, int(n)] for k, n in json.loads(s)]
    writers.write_json(
        {
            "n_review_useful": row.n_useful, "n_review_5_star": row.n_five_star, "n_characters": row.longest, "n_user": row.n_users, "top20_user": top(row.top_users),
            "n_business": row.n_businesses, "top20_business": top(row.top_businesses),
        },
        a.output,
    )


def run_averages(spark, a):
    review, business = _read(spark, a.review, readers.ratings_csv, readers.reviews_json), _read(spark, a.business, readers.business_csv, readers.business_json)
    df = stats.state_average(review, business)
    began = time.perf_counter()
    all_states = df.count()
    whole = time.perf_counter() - began
    began = time.perf_counter()
    df.limit(5).collect()
    writers.state_stars(df, a.output)
    writers.timings(whole, time.perf_counter() - began, f"all {all_states} states against a bounded top 5; the second run may reuse what the first left in memory", a.timings)


def run_itemsets(spark, a):
    baskets = itemsets.orient(_read(spark, a.pairs, readers.pairs_csv), a.case)
    if a.larger_than is not None:
        baskets = itemsets.larger_baskets(baskets, a.larger_than)
    found = itemsets.frequent_itemsets(baskets, a.support).cache()
    writers.itemset_report(found, found, a.output)


def run_similar(spark, a):
    """Pairs of representatives of equal sets; any other member of a class is listed once, beside its representative."""
    sets = similar.characteristic(keyed(_read(spark, a.pairs, readers.pairs_csv), "user_id", "business_id"), "business_id", "user_id")
    groups, near = similar.near_classes(sets, a.threshold)
    members = groups.filter("item <> rep").select(F.col("rep").alias("business_id_1"), F.col("item").alias("business_id_2"), F.lit(1.0).alias("similarity"))
    writers.similar_pairs_csv(near.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), "similarity").union(members), a.output)


def run_predict(spark, a):
    train, test = (recommend.ratings(_read(spark, p, readers.ratings_csv)) for p in (a.train, a.test))
    if a.case == 1:
        out = recommend.als_predictions(train, test)
    else:
        only = similar.near_classes(similar.characteristic(train, "business_id", "user_id"), a.threshold) if a.case == 4 else None
        out = recommend.neighbour_predictions(train, test, "user" if a.case == 2 else "item", min_overlap=a.gate, clipped=a.clip, only=only)
    writers.predictions_csv(out, a.output)


def run_graph(spark, a):
    edges = graph.co_review_edges(keyed(_read(spark, a.pairs, readers.pairs_csv), "user_id", "business_id"), a.least)
    writers.betweenness_txt(graph.edge_betweenness(edges), a.betweenness)
    writers.communities_txt(graph.girvan_newman(edges), a.communities)


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="quillwork")
    sub = p.add_subparsers(dest="command", required=True)

    def command(name, run, *arguments):
        c = sub.add_parser(name)
        for names, kw in arguments:
            c.add_argument(*names, **kw)
        c.set_defaults(run=run)

    path = lambda n: ((n,), {})
    command("stats", run_stats, path("review"), path("output"), (("--top",), {"type": int, "default": 20}))
    command("averages", run_averages, path("review"), path("business"), path("output"), path("timings"))
    command("itemsets", run_itemsets, (("case",), {"type": int, "choices": (1, 2)}), (("support",), {"type": int}), path("pairs"), path("output"), (("--larger-than",), {"type": int}))
    command("similar", run_similar, path("pairs"), path("output"), (("--threshold",), {"type": float, "default": 0.5}))
    command("predict", run_predict, path("train"), path("test"), (("case",), {"type": int, "choices": (1, 2, 3, 4)}), path("output"),
            (("--clip",), {"action": "store_true"}), (("--gate",), {"type": int, "help": "least common ratings of neighbours"}), (("--threshold",), {"type": float, "default": 0.5}))
    command("graph", run_graph, (("least",), {"type": int}), path("pairs"), path("betweenness"), path("communities"))
    return p


def main(args: list[str] | None = None) -> None:
    a = parser().parse_args(args)
    spark = SparkSession.builder.appName("quillwork").getOrCreate()
    a.run(spark, a)


if __name__ == "__main__":
    main()
