"""The registered queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillwork.functions.durable import written
from quillwork.functions.keys import clean_key
from quillwork.functions.skew import heavy_keys, with_facts
from quillwork.llm import distinct, grouping, heavy, leaks, packing, pii, residue, setjoin, topn
from quillwork.operators import stats
from quillwork.sources.readers import table

SHARE = 0.01
TOP = 5
LEAST_USERS = 5
SIMILAR = 0.5
GROUPINGS = {"day": ["day"], "state": ["state"], "day_state": ["day", "state"], "all": []}


def _pairs1(s, d):
    return setjoin.similar_set_pairs(table(s, d, "review").select("business_id", "user_id"), "business_id", "user_id", SIMILAR, LEAST_USERS)


def p1_found(s, d):
    return _pairs1(s, d).select(F.col("key_1").alias("business_id_1"), F.col("key_2").alias("business_id_2"))


def p2_found(s, d):
    rows = table(s, d, "pengxiang_xu_task1").filter(F.col("similarity").between(0.5, 1.0) & ~F.isnan("similarity"))
    matches = rows.select(clean_key("business_id_1").alias("a"), clean_key("business_id_2").alias("b"))
    return grouping.match_groups(matches, "a", "b").select("group_id", F.col("member").alias("business_id"))


def _columns4():
    return {"user_id": clean_key("user_id"), "business_id": clean_key("business_id")}


def p4_found(s, d):
    review = table(s, d, "review").select("user_id", "business_id")
    likely = heavy.frequent_items(review, _columns4(), SHARE)
    exact = heavy.exact_counts(review, _columns4(), likely)
    return exact.join(F.broadcast(likely.select("field", "item", "n_rows")), ["field", "item"]).filter(F.col("n") >= F.col("n_rows") * SHARE).select("field", "item")


def p4_intervals(s, d):
    return heavy.frequent_items(table(s, d, "review").select("user_id", "business_id"), _columns4(), SHARE)


def p4_intervals_check(s, d):
    """Of each item at or above the share: whether its interval holds its count, and is as narrow as promised."""
    review = table(s, d, "review").select("user_id", "business_id")
    likely = heavy.frequent_items(review, _columns4(), SHARE)
    both = heavy.exact_counts(review, _columns4(), likely).join(F.broadcast(likely), ["field", "item"]).filter(F.col("n") >= F.col("n_rows") * SHARE)
    return both.select("field", "item", F.col("n").between(F.col("n_low"), F.col("n_high")).alias("within"), (F.col("n_high") - F.col("n_low") <= F.col("n_rows") * heavy.ERROR).alias("narrow"))


def p5_found(s, d):
    a, b = clean_key("business_id_1"), clean_key("business_id_2")
    rows = table(s, d, "pengxiang_xu_task1").select(a.alias("a"), b.alias("b"), "similarity")
    rows = rows.filter((F.col("a") != F.col("b")) & F.col("similarity").between(0.0, 1.0) & ~F.isnan("similarity"))
    rows = rows.select(F.least("a", "b").alias("business_id_1"), F.greatest("a", "b").alias("business_id_2"), "similarity")
    return topn.top_items(rows, "business_id_1", "business_id_2", "similarity", TOP).select("business_id_1", "business_id_2")


def _partials6(s, d):
    """The partial results of both fields. A business is folded to its days before its state is attached."""
    keys = [clean_key("user_id").alias("user_id"), clean_key("business_id").alias("business_id"), F.to_date("reviewed_at").alias("day")]
    review, states = table(s, d, "review").select(*keys), stats.business_states(table(s, d, "business"))
    users = with_facts(review.filter("user_id is not null"), states, "business_id")
    businesses = review.select("business_id", "day").distinct().join(states, "business_id", "left")
    groups, heavy = ["day", "state"], heavy_keys(review, "user_id")  # looked for before the join, not after it
    return [distinct.partial(users, "user_id", F.col("user_id"), groups, heavy), distinct.partial(businesses, "business_id", F.col("business_id"), groups, [])]


def p6_distinct_counts(s, d):
    users, businesses = (distinct.counts(p, GROUPINGS) for p in _partials6(s, d))
    return users.union(businesses)


def p7_found(s, d):
    found = pii.redact(table(s, d, "review"), "review_id", "text").select("review_id", F.explode("kinds").alias("kind"))
    return found.distinct()


def _once(s, d):
    """Reviews by id; rows delivered twice hold the same text."""
    return table(s, d, "review").select("review_id", "text").dropDuplicates(["review_id"])


def p7_spans_check(s, d):
    reviews = written(_once(s, d))
    return pii.check(reviews, pii.redact(reviews, "review_id", "text"), "review_id", "text")


# items of a form that leaves no doubt, by kind
PLAIN_ITEMS = {"email": r"[\w.+\-]+@[\w\-]+(\.[\w\-]+)+", "phone": r"\([0-9]{3}\) [0-9]{3}-[0-9]{4}", "address": r"P\.?O\.? Box [0-9]+"}


def p7_plain_items(s, d):
    """(review_id, kind): reviews in which the operator found an item written in the plain form of its kind."""
    reviews = _once(s, d)
    items = pii.redact(reviews, "review_id", "text").select("review_id", F.explode("items").alias("x")).select("review_id", "x.*")
    item = F.substring("text", F.col("first") + 1, F.col("last") - F.col("first"))
    found = items.join(reviews, "review_id").select("review_id", "kind", item.alias("item"))
    plain = reduce(lambda a, b: a | b, [(F.col("kind") == k) & F.col("item").rlike(p) for k, p in PLAIN_ITEMS.items()])
    return found.filter(plain).select("review_id", "kind").distinct()


def p7_redacted(s, d):
    return pii.redact(table(s, d, "review"), "review_id", "text").select("review_id", F.col("redacted").alias("text"), "n_items")


def _packed(s, d):
    lengths = written(packing.token_counts(table(s, d, "documents"), "doc_id", "text"))
    return packing.pack(lengths, "doc_id")


def p8_containers(s, d):
    return _packed(s, d)


def p8_containers_check(s, d):
    lengths = written(packing.token_counts(table(s, d, "documents"), "doc_id", "text"))
    return packing.check(written(packing.pack(lengths, "doc_id")), lengths, "doc_id")


def p8_fill(s, d):
    return packing.fill(_packed(s, d))


def _leaks(s, d):
    return leaks.leaked_passages(table(s, d, "documents"), "doc_id", "text", table(s, d, "benchmark"), "item_id", "text")


def p9_found(s, d):
    return _leaks(s, d).select("doc_id", "item_id").distinct()


def p9_passages(s, d):
    return _leaks(s, d)


def _residue(s, d):
    return residue.residue_texts(table(s, d, "documents"), "doc_id", "text")


def p10_found(s, d):
    return _residue(s, d).select("doc_id").distinct()


# lines that leave no doubt
PLAIN_LINES = r"(?im)^(lorem ipsum dolor sit amet[a-z ,.]*|[0-9]{3} (not found|forbidden|bad gateway|service unavailable|internal server error))$"


def p10_plain_lines(s, d):
    """Documents with a line that leaves no doubt, as far as the operator found them."""
    plain = table(s, d, "documents").filter(F.col("text").rlike(PLAIN_LINES)).select("doc_id")
    return p10_found(s, d).join(plain, "doc_id", "left_semi")


def p10_reasons(s, d):
    return _residue(s, d).groupBy("doc_id", "reason").agg(F.count(F.lit(1)).alias("n"), F.min("message").alias("example"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    own = [p1_found, p2_found, p4_found, p4_intervals, p4_intervals_check, p5_found, p6_distinct_counts, p7_found, p7_redacted, p7_spans_check, p7_plain_items, p8_containers, p8_containers_check, p8_fill, p9_found, p9_passages, p10_found, p10_plain_lines, p10_reasons]
    return {f.__name__: f for f in own}
