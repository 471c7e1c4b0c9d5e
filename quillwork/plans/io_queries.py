"""Queries through every source and sink: a table is written in the format, read back, and what came back is the
result. Files lie in the folder all executors share and are removed when the program ends."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillwork.functions.durable import shared_path, written
from quillwork.operators import graph, itemsets, similar, stats
from quillwork.plans import core_queries as core
from quillwork.sources import readers, writers
from quillwork.sources.readers import table
from quillwork.streaming import running


def lines_of(s, path: str) -> DataFrame:
    """(line, text) of a report, lines from 1; the last line end closes a line."""
    whole = s.read.text(path, wholetext=True).select(F.split(F.rtrim(F.col("value"), F.lit("\n")), "\n").alias("l"))
    return whole.select(F.posexplode("l").alias("line", "text")).select((F.col("line") + 1).alias("line"), "text")


def json_scan(s, d):
    """All reviews as JSON lines and back."""
    path = shared_path(s)
    table(s, d, "review").select("review_id", "user_id", "business_id", "stars", "useful", "text").write.json(path)
    return stats.summary(readers.reviews_json(s, path))


def business_json_scan(s, d):
    path = shared_path(s)
    table(s, d, "business").select("business_id", "biz_name", "state").write.json(path)
    rows = readers.business_json(s, path)
    return rows.groupBy("state").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("business_id").alias("n_businesses"))


def csv_scan(s, d):
    """Ratings as CSV with a header and back; repeats stay."""
    path = shared_path(s)
    writers.table_csv(table(s, d, "ratings_train").select("user_id", "business_id", "stars"), path)
    rows = readers.ratings_csv(s, path)
    return rows.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("stars"), 6).alias("stars"))


def csv_scan_header_by_name(s, d):
    """The same with the header as a row of the data, dropped by its first field."""
    path = shared_path(s)
    head = s.createDataFrame([("user_id", "business_id")], readers.PAIR)
    head.union(table(s, d, "user_business").select("user_id", "business_id")).write.csv(path)
    return readers.headerless_csv(s, path, "user_id", readers.PAIR).groupBy("business_id").agg(F.count(F.lit(1)).alias("n"))


def partition_control(s, d):
    """Two partitions at most, nothing lost."""
    rows = readers.partitioned(table(s, d, "user_business"), 2).withColumn("p", F.spark_partition_id())
    return rows.agg(F.count(F.lit(1)).alias("n"), (F.count_distinct("p") <= 2).alias("two_at_most"))


def sampled_rows(s, d):
    """A sampling operator: the limit is the feature. What is drawn is random, how much is not."""
    rows = table(s, d, "review").select("review_id", "user_id")
    drawn = written(readers.sample_rows(rows, 300))
    return drawn.agg(F.count(F.lit(1)).alias("n")).unionByName(drawn.join(rows, ["review_id", "user_id"], "left_anti").agg(F.count(F.lit(1)).alias("n"))).groupBy().agg(F.max("n").alias("n_drawn"), F.min("n").alias("n_unknown"))


def json_document(s, d):
    """The statistics as one JSON document."""
    path, row = shared_path(s), stats.summary(table(s, d, "review")).first()
    writers.write_json({"n_review_useful": row.n_useful, "n_characters": row.longest, "n_user": row.n_users}, path)
    return s.read.schema("n_review_useful long, n_characters long, n_user long").json(path)


def state_stars_report(s, d):
    path = shared_path(s)
    writers.state_stars(core.state_avg_stars(s, d), path)
    rows = lines_of(s, path).filter("line > 1")
    return rows.select("line", F.split("text", ",")[0].alias("state"), F.round(F.split("text", ",")[1].cast("double"), 6).alias("stars"))


def timing_report(s, d):
    path = shared_path(s)
    writers.timings(2.0, 0.5, f"{table(s, d, 'business').count()} rows", path)
    return s.read.schema("m1 double, m2 double, explanation string").json(path)


def itemset_report(s, d):
    """Candidates and frequent itemsets, by size, then item by item; itemsets with their line and place in it."""
    path = shared_path(s)
    tried = written(itemsets.itemset_levels(itemsets.orient(table(s, d, "user_business"), 1), core.support(s, d)))
    writers.itemset_report(tried, tried.filter("frequent"), path)
    text = lines_of(s, path).select("line", F.posexplode(F.split(F.regexp_replace("text", r"\),\(", ")\n("), "\n")).alias("at", "text"))
    return text.select("line", (F.col("at") + 1).alias("place"), "text")


def similar_pairs_report(s, d):
    path = shared_path(s)
    writers.similar_pairs_csv(core.similar_pairs_lsh(s, d), path)
    part = F.split("text", ",")
    rows = lines_of(s, path).filter("line > 1")
    return rows.select("line", part[0].alias("business_id_1"), part[1].alias("business_id_2"), F.round(part[2].cast("double"), 6).alias("similarity"))


def predictions_report(s, d):
    path = shared_path(s)
    writers.predictions_csv(core.user_cf(s, d), path)
    part = F.split("text", ",")
    rows = lines_of(s, path).filter("line > 1")
    return rows.select("line", part[0].alias("user_id"), part[1].alias("business_id"), F.round(part[2].cast("double"), 5).alias("prediction"))


def betweenness_report(s, d):
    path = shared_path(s)
    writers.betweenness_txt(graph.edge_betweenness(core._edges(s, d)), path)
    quoted = F.split("text", "'")
    return lines_of(s, path).select("line", quoted[1].alias("src"), quoted[3].alias("dst"), F.round(F.regexp_extract("text", r", ([^ ]+)$", 1).cast("double"), 6).alias("betweenness"))


def communities_report(s, d):
    """The components of the graph as communities: by size, then first member."""
    path = shared_path(s)
    groups = graph.connected_components(core._edges(s, d)).groupBy("component").agg(F.array_sort(F.collect_list("node")).alias("members"))
    writers.communities_txt(groups, path)
    return lines_of(s, path)


def table_lines(s, d):
    """A text table written where its rows lie."""
    path = shared_path(s)
    writers.table_lines(table(s, d, "business").select("business_id", "added_at"), F.concat_ws("|", "business_id", F.date_format("added_at", "yyyy-MM-dd")), path)
    return s.read.text(path).groupBy(F.col("value").alias("text")).agg(F.count(F.lit(1)).alias("n"))


def _streamed(s, d, make, mode: str) -> DataFrame:
    """What a stream over the reviews has written once it has read all there is. The rows go to a table in the shared
    folder batch by batch; in complete mode a batch takes the place of the one before."""
    out = shared_path(s)
    rows = make(readers.table_stream(s, d, "review"))

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    run = rows.writeStream.foreachBatch(keep).outputMode(mode).option("checkpointLocation", shared_path(s)).trigger(availableNow=True).start()
    run.awaitTermination()
    return s.read.schema(rows.schema).parquet(out)


def stream_state_average(s, d):
    """The running state averages after all reviews; rows delivered twice count once, as long as none is late."""
    found = _streamed(s, d, lambda r: running.running_state_average(r, table(s, d, "business")), "complete")
    return found.select("state", F.round("stars", 6).alias("stars"), "n")


def stream_days(s, d):
    """Reviews of each day that the watermark has closed."""
    found = _streamed(s, d, running.reviews_by_window, "append")
    return found.select(F.to_date("start").alias("day"), "n", F.round("stars", 6).alias("stars"))


def band_chooser(s, d):
    """(hashes, bands, rows) for families of several sizes at a similarity of 0.5."""
    return s.createDataFrame([(n, *similar.choose_bands(n)) for n in (6, 12, 20, 28, 60, 120)], "hashes int, bands int, rows int")


def lsh_pairs_of_other_family(s, d):
    """Similar pairs by a family of hashes drawn by the multiplier generator, in as many bands as the chooser says."""
    sets, idx = core._indexed(s, d)
    bands, _ = similar.choose_bands(20)
    sigs = similar.signatures(sets.join(idx, "member"), idx.count(), similar.multipliers(20))
    reps = written(similar.classes(sets).filter("item = rep").select("item", "n"))
    pairs = similar.bucket_pairs(similar.banded(sigs.join(reps.select("item"), "item", "left_semi"), bands), reps, core.NEAR)
    found = similar.jaccard(pairs, sets).filter("similarity >= 0.5")
    return found.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), F.round("similarity", 6).alias("similarity"))


def queries():
    own = [
        json_scan, business_json_scan, csv_scan, csv_scan_header_by_name, partition_control, sampled_rows, json_document, state_stars_report, timing_report, itemset_report,
        similar_pairs_report, predictions_report, betweenness_report, communities_report, table_lines, stream_state_average, stream_days, band_chooser, lsh_pairs_of_other_family,
    ]
    return {f.__name__: f for f in own}
