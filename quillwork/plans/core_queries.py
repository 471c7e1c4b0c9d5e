"""The registered queries of the core: each takes (spark, folder) and runs over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.durable import written
from quillwork.functions.keys import keyed
from quillwork.operators import encode, graph, itemsets, metrics, orphans, recommend, similar, stats
from quillwork.sources import readers
from quillwork.sources.readers import table

EDGE_LEAST = 3
NEAR = 0.5
GATE = 2

Query = Callable[[SparkSession, str], DataFrame]


def _review(s: SparkSession, d: str) -> DataFrame:
    return table(s, d, "review")


def _pairs(s: SparkSession, d: str) -> DataFrame:
    return keyed(table(s, d, "user_business"), "user_id", "business_id")


def support(s: SparkSession, d: str) -> int:
    """A thousandth of all rows, 3 at least."""
    return max(3, table(s, d, "user_business").count() // 1000)


def state_avg_stars(s, d):
    out = stats.state_average(_review(s, d), table(s, d, "business"))
    return out.select("state", F.round("stars", 6).alias("stars"))


def state_top5(s, d):
    return stats.state_average(_review(s, d), table(s, d, "business")).select("state", F.round("stars", 6).alias("stars")).orderBy(F.desc("stars"), "state").limit(5)


def review_summary(s, d):
    return stats.summary(_review(s, d))


def useful_count(s, d):
    return _review(s, d).agg(stats.useful_count().alias("n"))


def five_star_count(s, d):
    return _review(s, d).agg(stats.five_star_count().alias("n"))


def longest_text(s, d):
    return _review(s, d).agg(stats.longest_text().alias("n"))


def distinct_users(s, d):
    return stats.distinct_keys(_review(s, d), "user_id")


def distinct_businesses(s, d):
    return stats.distinct_keys(_review(s, d), "business_id")


def top20_users(s, d):
    return stats.top_keys(_review(s, d), "user_id")


def top20_businesses(s, d):
    return stats.top_keys(_review(s, d), "business_id")


def baskets_by_user(s, d):
    return itemsets.basket_sizes(itemsets.orient(table(s, d, "user_business"), 1))


def baskets_by_business(s, d):
    return itemsets.basket_sizes(itemsets.orient(table(s, d, "user_business"), 2))


def basket_size_filter(s, d):
    rows = itemsets.larger_baskets(itemsets.orient(table(s, d, "user_business"), 1), 3)
    return itemsets.basket_sizes(rows)


def frequent_singles(s, d):
    return itemsets.frequent_singles(itemsets.orient(table(s, d, "user_business"), 1), support(s, d))


def _sets(s, d, case=1):
    return itemsets.frequent_itemsets(itemsets.orient(table(s, d, "user_business"), case), support(s, d))


def _listed(df: DataFrame) -> DataFrame:
    return df.select(F.concat_ws(",", "items").alias("items"), "size", "n")


def frequent_pairs(s, d):
    return _listed(_sets(s, d).filter("size = 2"))


def frequent_triples(s, d):
    return _listed(_sets(s, d).filter("size = 3"))


def frequent_itemsets(s, d):
    return _listed(_sets(s, d))


def frequent_itemsets_of_users(s, d):
    return _listed(_sets(s, d, 2))


def itemset_levels(s, d):
    return _listed(itemsets.itemset_levels(itemsets.orient(table(s, d, "user_business"), 1), support(s, d)).filter("frequent"))


def itemset_candidates(s, d):
    tried = itemsets.itemset_levels(itemsets.orient(table(s, d, "user_business"), 1), support(s, d))
    return tried.select(F.concat_ws(",", "items").alias("items"), "size", "n", "frequent")


def itemsets_of_larger_baskets(s, d):
    rows = itemsets.larger_baskets(itemsets.orient(table(s, d, "user_business"), 1), 3)
    return _listed(itemsets.frequent_itemsets(rows, support(s, d)))


def dense_index(s, d):
    return encode.dense_index(_pairs(s, d), "user_id")


def _characteristic(s, d):
    return similar.characteristic(_pairs(s, d), "business_id", "user_id")


def characteristic_sets(s, d):
    sets = _characteristic(s, d)
    return sets.groupBy(F.col("item").alias("business_id")).agg(F.count(F.lit(1)).alias("n"), F.min("member").alias("first"), F.max("member").alias("last"))


def _indexed(s, d):
    sets = written(_characteristic(s, d))
    return sets, encode.dense_index(sets, "member")


def _signatures(s, d):
    sets, idx = _indexed(s, d)
    return sets, similar.signatures(sets.join(idx, "member"), idx.count())


def minhash_signatures(s, d):
    return _signatures(s, d)[1].select(F.col("item").alias("business_id"), F.concat_ws(",", F.transform("sig", lambda x: x.cast("string"))).alias("sig"))


def lsh_bands_small_family(s, d):
    sets = _characteristic(s, d)
    idx = encode.dense_index(sets, "member")
    rows = similar.banded(similar.signatures(sets.join(idx, "member"), idx.count(), similar.ODD_MULTIPLIERS), 10)
    return rows.select(F.col("item").alias("business_id"), "band", F.element_at("part", 1).alias("r1"), F.element_at("part", 2).alias("r2"))


def lsh_bands(s, d):
    rows = similar.banded(_signatures(s, d)[1])
    return rows.select(F.col("item").alias("business_id"), "band", F.element_at("part", 1).alias("r1"), F.element_at("part", 2).alias("r2"))


def set_classes(s, d):
    return similar.classes(_characteristic(s, d)).select(F.col("item").alias("business_id"), F.col("rep").alias("class_id"), "n")


def _rep_candidates(s, d, least=NEAR):
    sets, sigs = _signatures(s, d)
    reps = written(similar.classes(sets).filter("item = rep").select("item", "n"))
    own = similar.banded(sigs.join(reps.select("item"), "item", "left_semi"))
    return sets.join(reps.select("item"), "item", "left_semi"), similar.bucket_pairs(own, reps, least)


def lsh_candidates(s, d):
    """Of every two sets, whatever their sizes."""
    return _rep_candidates(s, d, 0.0)[1].select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"))


def similar_pairs_lsh(s, d):
    sets, candidates = _rep_candidates(s, d)
    found = similar.jaccard(candidates, sets).filter("similarity >= 0.5")
    return found.select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), F.round("similarity", 6).alias("similarity"))


def _exact_pairs(s, d):
    return similar.exact_pairs(similar.representatives(_characteristic(s, d)), NEAR)


def jaccard_exact_pairs(s, d):
    return _exact_pairs(s, d).select(F.col("a").alias("business_id_1"), F.col("b").alias("business_id_2"), F.round("similarity", 6).alias("similarity"))


def lsh_precision_recall(s, d):
    sets, candidates = _rep_candidates(s, d)
    found = similar.jaccard(candidates, sets).filter("similarity >= 0.5")
    out = metrics.precision_recall(found, _exact_pairs(s, d), "a", "b")
    return out.select(F.round("precision", 6).alias("precision_"), F.round("recall", 6).alias("recall_"))


def similar_pairs_confirmed(s, d):
    """Pairs that banding and the exact join both find."""
    sets, candidates = _rep_candidates(s, d)
    found = similar.jaccard(candidates, sets).filter("similarity >= 0.5").select("a", "b")
    return metrics.common_rows(found, _exact_pairs(s, d).select("a", "b")).toDF("business_id_1", "business_id_2")


def _train(s, d):
    return recommend.ratings(table(s, d, "ratings_train"))


def _test(s, d):
    return recommend.ratings(table(s, d, "ratings_test"))


def group_means(s, d):
    t = _train(s, d)
    users = recommend.group_means(t, "user_id").select(F.lit("user").alias("side"), F.col("user_id").alias("id"), "mean")
    items = recommend.group_means(t, "business_id").select(F.lit("business").alias("side"), F.col("business_id").alias("id"), "mean")
    return users.union(items).select("side", "id", F.round("mean", 6).alias("mean"))


def cold_rows(s, d):
    train, test = _train(s, d), _test(s, d)
    return recommend.cold_rows(test, train, "user_id").select("user_id", "business_id", F.lit("user").alias("cold")).union(
        recommend.cold_rows(test, train, "business_id").select("user_id", "business_id", F.lit("business").alias("cold"))
    )


def union_ratings(s, d):
    return recommend.union_ratings(_train(s, d), _test(s, d)).select("user_id", "business_id", F.round("stars", 6).alias("stars"))


def train_test_split(s, d):
    whole = recommend.union_ratings(_train(s, d), _test(s, d))
    train, test = readers.split_ratings(whole)
    sides = train.select("*", F.lit(0).alias("side")).union(test.select("*", F.lit(1).alias("side")))
    by_row = sides.groupBy(*whole.columns).agg(F.count_distinct("side").alias("sides"), F.count(F.lit(1)).alias("c"), F.sum("side").alias("t"))
    share = F.sum("t") / F.sum("c")
    return by_row.agg(F.sum("c").alias("n"), F.count_if(F.col("sides") > 1).alias("n_on_both_sides"), share.between(0.2, 0.27).alias("share_as_asked"))


def user_similarity(s, d):
    return recommend.similarity(_train(s, d), "user", 2).select("a", "b", F.round("similarity", 6).alias("similarity"), "n")


def item_similarity(s, d):
    return recommend.similarity(_train(s, d), "item", 2).select("a", "b", F.round("similarity", 6).alias("similarity"), "n")


def _predicted(df: DataFrame) -> DataFrame:
    return df.select("user_id", "business_id", F.round("stars", 6).alias("stars"), F.round("prediction", 5).alias("prediction"))


def user_cf(s, d):
    return _predicted(recommend.neighbour_predictions(_train(s, d), _test(s, d), "user"))


def item_cf(s, d):
    return _predicted(recommend.neighbour_predictions(_train(s, d), _test(s, d), "item", min_overlap=GATE))


def item_cf_default_gate(s, d):
    """At the gate of 60 common raters."""
    return _predicted(recommend.neighbour_predictions(_train(s, d), _test(s, d), "item"))


def user_cf_clipped(s, d):
    return _predicted(recommend.neighbour_predictions(_train(s, d), _test(s, d), "user", clipped=True))


def user_cf_uncentred(s, d):
    return _predicted(recommend.neighbour_predictions(_train(s, d), _test(s, d), "user", centre=False))


def item_cf_lsh(s, d):
    train = _train(s, d)
    groups, near = similar.near_classes(similar.characteristic(train, "business_id", "user_id"), NEAR)
    return _predicted(recommend.neighbour_predictions(train, _test(s, d), "item", min_overlap=GATE, only=(groups, near)))


def cf_rmse(s, d):
    train, test = _train(s, d), _test(s, d)
    out = []
    for by, gate in (("user", None), ("item", GATE)):
        p = recommend.neighbour_predictions(train, test, by, min_overlap=gate)
        out.append(written(metrics.rmse(p).select(F.lit(by).alias("by_"), F.round("rmse", 5).alias("rmse"))))
    return out[0].union(out[1])


def als_predictions(s, d):
    return _predicted(recommend.als_predictions(_train(s, d), _test(s, d)))


def als_check(s, d):
    """(what, n): rows predicted, cold ones at 3.0, and factors that break the conditions a fitted model must meet."""
    return recommend.als_check(_train(s, d), _test(s, d))


def als_rmse(s, d):
    return metrics.rmse(recommend.als_predictions(_train(s, d), _test(s, d)))


def _edges(s, d, least=EDGE_LEAST):
    return graph.co_review_edges(_pairs(s, d), least)


def co_visit_edges(s, d):
    return _edges(s, d)


def adjacency(s, d):
    return graph.adjacency(_edges(s, d))


def vertices(s, d):
    return graph.vertices(_edges(s, d))


def graph_degrees(s, d):
    return graph.degrees(_edges(s, d))


def connected_components(s, d):
    return graph.connected_components(_edges(s, d))


def edge_betweenness(s, d):
    return graph.edge_betweenness(_edges(s, d)).select("src", "dst", F.round("betweenness", 6).alias("betweenness"))


def modularity(s, d):
    """Of the edges without the strongest one."""
    e = written(_edges(s, d))
    top = written(graph.edge_betweenness(e).orderBy(F.desc("betweenness"), "src", "dst").limit(1))
    return graph.modularity(e, e.join(top, ["src", "dst"], "left_anti")).select(F.round("q", 9).alias("q"))


def girvan_newman(s, d):
    return graph.girvan_newman(_edges(s, d)).select("community", F.concat_ws(",", "members").alias("members"), "size")


def girvan_newman_check(s, d):
    """(what, n): nodes placed, and what must not be: nodes in two communities, communities that the graph does not
    connect, a division of lower modularity than the components."""
    e = written(_edges(s, d))
    return graph.check_communities(e, written(graph.girvan_newman(e)))


def _orphans(s, d):
    return orphans.orphan_references(_review(s, d), table(s, d, "business"), "business_id", "business_id", "reviewed_at", "added_at", "removed_at", keep=("review_id",))


def p3_found(s, d):
    return _orphans(s, d).select("review_id").distinct()


def p3_orphans_by_month(s, d):
    once = _orphans(s, d).dropDuplicates(["review_id"])
    return orphans.orphans_by_period(once, "review")


def daily_counts(s, d):
    return stats.daily_counts(_review(s, d)).select("day", "n", F.round("stars", 6).alias("stars"), "total")


def queries() -> dict[str, Query]:
    own = [
        state_avg_stars, state_top5, review_summary, useful_count, five_star_count, longest_text, distinct_users, distinct_businesses, top20_users,
        top20_businesses, baskets_by_user, baskets_by_business, basket_size_filter, frequent_singles, frequent_pairs, frequent_triples, frequent_itemsets,
        frequent_itemsets_of_users, itemset_levels, itemset_candidates, itemsets_of_larger_baskets, dense_index, characteristic_sets, minhash_signatures, lsh_bands, lsh_bands_small_family,
        set_classes, lsh_candidates, similar_pairs_lsh, jaccard_exact_pairs, similar_pairs_confirmed, lsh_precision_recall, group_means, cold_rows, union_ratings, train_test_split,
        user_similarity, item_similarity, user_cf, item_cf, item_cf_default_gate, user_cf_clipped, user_cf_uncentred, item_cf_lsh, cf_rmse, als_predictions,
        als_check, als_rmse, co_visit_edges, adjacency, vertices, graph_degrees, connected_components, edge_betweenness, modularity, girvan_newman, girvan_newman_check, daily_counts,
        p3_found, p3_orphans_by_month,
    ]
    return {f.__name__: f for f in own}
