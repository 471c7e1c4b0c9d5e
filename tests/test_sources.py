import json

from quillwork.sources import readers, writers


def test_json(spark, tmp_path):
    p = tmp_path / "r.json"
    p.write_text(json.dumps({"review_id": "1", "user_id": "u", "stars": 4.0, "extra": {"a": 1}}) + "\n" + "{broken\n")
    got = readers.reviews_json(spark, str(p)).collect()
    assert (got[0].user_id, got[0].stars, got[0].text) == ("u", 4.0, None) and got[1].user_id is None
    b = tmp_path / "b.json"
    b.write_text('{"business_id": "b", "name": "x, \\"state\\": \\"y\\"", "state": "AZ"}\n')
    assert readers.business_json(spark, str(b)).first().state == "AZ"


def test_csv(spark, tmp_path):
    p = tmp_path / "p.csv"
    p.write_text('user_id, business_id, stars\nu,"b,1",4.5\n')
    assert tuple(readers.ratings_csv(spark, str(p)).first()) == ("u", "b,1", 4.5)
    assert tuple(readers.pairs_csv(spark, str(p)).first())[0] == "u"
    assert readers.truth_csv(spark, str(p)).count() == 1
    assert readers.headerless_csv(spark, str(p), "user_id", "user_id string, business_id string, stars double").count() == 1


def test_split_and_sample(spark):
    df = spark.range(1000)
    a, b = readers.split_ratings(df)
    assert a.count() + b.count() == 1000 and 150 < b.count() < 320
    assert readers.sample_rows(df, 30).count() == 30
    assert readers.partitioned(df, 2).rdd.getNumPartitions() <= 2


def test_reports(rows, tmp_path):
    p = str(tmp_path / "out")
    read = lambda: open(p, encoding="utf-8").read()
    writers.state_stars(rows("state string, stars double", [("AZ", 4.0), ("NV", 3.5)]), p)
    assert read() == "state,stars\nAZ,4.0\nNV,3.5\n"
    items = rows("items array<string>", [(["b"],), (["a"],), (["a", "b"],)])
    writers.itemset_report(items, items.limit(0), p)
    assert read() == "Candidates:\n('a'),('b')\n\n('a', 'b')\n\nFrequent Itemsets:\n"
    writers.similar_pairs_csv(rows("business_id_1 string, business_id_2 string, similarity double", [("b", "c", 0.5), ("a", "c", 1.0)]), p)
    assert read() == "business_id_1, business_id_2, similarity\na,c,1.0\nb,c,0.5\n"
    writers.predictions_csv(rows("user_id string, business_id string, prediction double", [("u", "b", 3.0)]), p)
    assert read() == "user_id, business_id, prediction\nu,b,3.0\n"
    writers.betweenness_txt(rows("src string, dst string, betweenness double", [("a", "b", 1.0), ("b", "c", 2.5)]), p)
    assert read() == "('b', 'c'), 2.5\n('a', 'b'), 1.0\n"
    writers.communities_txt(rows("members array<string>", [(["d", "e", "f"],), (["a", "b"],)]), p)
    assert read() == "'a', 'b'\n'd', 'e', 'f'\n"
    writers.timings(1.0, 0.5, "why", p)
    assert json.loads(read()) == {"m1": 1.0, "m2": 0.5, "explanation": "why"}
    writers.table_csv(items.selectExpr("items[0] as a"), str(tmp_path / "t"))
    assert (tmp_path / "t").is_dir()


def test_entry_contract(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns == ["state", "stars"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
