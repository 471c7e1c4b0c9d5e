import pytest

from quillwork.functions import durable, skew


def test_heavy_keys_and_both_ways_to_join(rows):
    df = rows("k string, id long", [("hot" if i % 3 == 0 else None if i % 7 == 0 else f"k{i}", i) for i in range(3000)])
    heavy = skew.heavy_keys(df, "k")
    assert heavy == ["hot"] and skew.heavy_keys(df.limit(0), "k") == []
    facts = rows("k string, v int", [("hot", 1), ("k1", 2), ("nobody", 3)])
    want = {(i, 1 if i % 3 == 0 else 2 if i == 1 else None) for i in range(3000)}
    assert {(r.id, r.v) for r in skew.with_facts(df, facts, "k").collect()} == want
    joined = skew.salted(df, "k", heavy, ["id"]).join(skew.replicated(facts, "k", heavy), ["k", "_salt"], "left")
    assert {(r.id, r.v) for r in joined.collect()} == want and joined.filter("v = 1").select("_salt").distinct().count() == skew.SALTS


def test_no_local_folder_on_a_cluster(spark, monkeypatch):
    class Nothing:
        def isEmpty(self):
            return True

    class Context:
        master = "spark://host:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: Nothing()})()})()

    class Session:
        sparkContext = Context()
        conf = type("C", (), {"get": lambda self, *_: None})()

    with pytest.raises(ValueError, match="checkpoint"):
        durable.shared_folder(Session())
