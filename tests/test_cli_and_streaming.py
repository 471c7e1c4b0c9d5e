import json
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from quillwork import cli
from quillwork.streaming import running


@pytest.fixture
def files(tmp_path):
    pairs = [(u, b) for u in "xyz" for b in "abc"] + [("w", "a"), ("w", "d")]
    (tmp_path / "pairs.csv").write_text("user_id,business_id\n" + "".join(f"{u},{b}\n" for u, b in pairs))
    (tmp_path / "train.csv").write_text("user_id,business_id,stars\n" + "".join(f"{u},{b},{1 + (i * 7) % 5}\n" for i, (u, b) in enumerate(pairs)))
    (tmp_path / "test.csv").write_text("user_id,business_id,stars\nw,b,3\nnew,new,1\n")
    (tmp_path / "review.json").write_text("".join(json.dumps({"user_id": u, "business_id": b, "stars": 4.0, "useful": 1, "text": "hi"}) + "\n" for u, b in pairs))
    (tmp_path / "business.json").write_text("".join(json.dumps({"business_id": b, "state": s}) + "\n" for b, s in zip("abcd", ["AZ", "NV", "AZ", "NV"])))
    return lambda name: str(tmp_path / name)


def test_commands(spark, files):
    read = lambda n: open(files(n), encoding="utf-8").read()
    cli.main(["stats", files("review.json"), files("o.json")])
    got = json.loads(read("o.json"))
    assert got["n_user"] == 4 and got["n_review_useful"] == 11 and got["top20_user"][0] == ["x", 3]
    cli.main(["averages", files("review.json"), files("business.json"), files("a.txt"), files("b.json")])
    assert read("a.txt") == "state,stars\nAZ,4.0\nNV,4.0\n" and set(json.loads(read("b.json"))) == {"m1", "m2", "explanation"}
    cli.main(["itemsets", "1", "3", files("pairs.csv"), files("i.txt"), "--larger-than", "2"])
    assert "('a', 'b', 'c')" in read("i.txt")
    cli.main(["similar", files("pairs.csv"), files("s.csv")])
    assert read("s.csv").splitlines()[1:] == ["a,b,0.75", "b,c,1.0"]  # c equals b
    for case in ("1", "2", "3", "4", "3 --gate 2", "4 --gate 1 --clip"):
        cli.main(["predict", files("train.csv"), files("test.csv"), *case.split()[:1], files("p.csv"), *case.split()[1:]])
        assert "new,new,3.0" in read("p.csv") and len(read("p.csv").splitlines()) == 3
    cli.main(["graph", "3", files("pairs.csv"), files("bet.txt"), files("com.txt")])
    assert read("bet.txt").splitlines()[0] == "('x', 'y'), 1.0" and read("com.txt").strip() == "'x', 'y', 'z'"


def test_streams(spark, rows, tmp_path):
    data = rows("review_id long, business_id string, stars double, reviewed_at timestamp", [(i, "a" if i % 2 else " b", float(i % 5), datetime(2024, 1, 1 + i % 3)) for i in range(20)] + [(3, "a", 3.0, datetime(2024, 1, 1)), (50, "a", 1.0, None)])
    data.write.parquet(str(tmp_path / "in"))
    business = rows("business_id string, state string", [("a", "AZ"), ("b", "NV")])
    stream = spark.readStream.schema(data.schema).parquet(str(tmp_path / "in"))
    for name, df, mode in (("avg", running.running_state_average(stream, business), "complete"), ("win", running.reviews_by_window(stream), "append")):
        q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
        q.awaitTermination(120)
    got = {r.state: r.n for r in spark.table("avg").collect()}
    assert got == {"AZ": 10, "NV": 10}
    assert spark.table("win").select(F.count("*")).first()[0] >= 0


def test_registered_streams_over_a_folder_and_zoneless_times(spark, rows, tmp_path):
    from quillwork.plans import io_queries

    days = [datetime(2024, 1, 1), datetime(2024, 1, 2, 12), datetime(2024, 3, 1)]
    data = rows("review_id long, user_id string, business_id string, stars double, reviewed_at timestamp_ntz", [(i % 7, "u", " a", float(1 + i % 7 % 5), days[i % 7 % 3]) for i in range(21)] + [(9, "u", "a", 1.0, None)])
    data.repartition(3).write.parquet(str(tmp_path / "review.parquet"))
    rows("business_id string, state string", [("a", "AZ")]).write.parquet(str(tmp_path / "business.parquet"))
    got = io_queries.stream_state_average(spark, str(tmp_path)).collect()
    assert [(r.state, r.n) for r in got] == [("AZ", 7)]
    assert {(r.day.day, r.n) for r in io_queries.stream_days(spark, str(tmp_path)).collect()} == {(1, 3), (2, 2)}
