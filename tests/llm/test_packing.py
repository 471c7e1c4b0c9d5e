import random

import pytest
from pyspark.sql import functions as F

from quillwork.llm import packing


def test_plan_is_whole_and_tight():
    r = random.Random(1)
    for capacity in (7, 100, 2048):
        hist = {n: r.randint(1, 60) for n in r.sample(range(1, capacity + 1), min(capacity, 40))}
        room, seen = {}, {}
        for length, rank, items, first, each, base in packing.plan(hist, capacity):
            for k in range(items):
                assert (length, rank + k) not in seen
                seen[length, rank + k] = first + k // each
                start = base + k % each * length
                spans = room.setdefault(first + k // each, [])
                assert start + length <= capacity and all(start >= e or start + length <= s for s, e in spans)
                spans.append((start, start + length))
        assert {(n, k) for n, c in hist.items() for k in range(c)} == set(seen)
        assert sorted(room) == list(range(len(room)))
        assert len(room) <= 1.25 * sum(n * c for n, c in hist.items()) / capacity + 2


def test_pack(rows):
    r = random.Random(2)
    lengths = {i: r.choice([0, 1, 5, 40, 40, 40, 99, 100, 101, 250, 300]) for i in range(400)}
    df = rows("doc_id long, n_tokens int, length int, piece string", [(i, n, 1, "x") for i, n in lengths.items()])
    out = packing.pack(df.repartition(5), "doc_id", 100, rows_a_salt=50)
    got = out.collect()
    by_doc, by_box = {}, {}
    for x in got:
        by_doc.setdefault(x.doc_id, []).append(x)
        if x.container_id is not None:
            by_box.setdefault(x.container_id, []).append((x.first_token, x.first_token + x.n_tokens))
    for i, n in lengths.items():
        assert sum(x.n_tokens for x in by_doc[i]) == n and sorted(x.piece for x in by_doc[i]) == list(range(max(1, -(-n // 100))))
        assert n > 0 or by_doc[i][0].container_id is None
    for spans in by_box.values():
        spans.sort()
        assert spans[-1][1] <= 100 and all(a[1] <= b[0] for a, b in zip(spans, spans[1:]))
    again = {(x.doc_id, x.piece): x.container_id for x in packing.pack(df.repartition(3), "doc_id", 100, rows_a_salt=50).collect()}
    assert again == {(x.doc_id, x.piece): x.container_id for x in got}
    f = packing.fill(out, 100).first()
    assert f.n_containers == len(by_box) and f.n_tokens == sum(lengths.values()) and f.fullest <= 100 and f.used > 0.9


def test_token_counts(rows):
    pytest.importorskip("public_tokenizers")
    df = rows("doc_id long, text string", [(1, None), (2, ""), (3, "a b c"), (4, "word " * 5000), (5, "<|endoftext|>")])
    got = {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()}
    assert got[1] == got[2] == 0 and got[3] == 3 and got[4] >= 5000 and got[5] > 1


def test_empty(rows):
    df = rows("doc_id long, n_tokens int")
    assert packing.pack(df, "doc_id").count() == 0
    assert packing.fill(packing.pack(df, "doc_id")).select(F.col("used").isNull()).first()[0]


def test_counts_by_word_are_those_of_whole_texts(rows):
    from tokenizers import Tokenizer

    path = packing.default_tokenizer()
    t = Tokenizer.from_file(path)
    t.encode_special_tokens = True
    texts = ["", " ", "a  b\n\n c\t", "I'm here, they'LL don't <|endoftext|> x", "naïve Straße ещё 漢字 \U0001f600\u200d ½ ²", "x" * 5000, "1234 5,6.7%% --- ...", "\r\n \u00a0 e\u0301"]
    texts += ["".join(random.Random(i).choice("aé 'sD1\n漢!  ") for _ in range(300)) for i in range(40)]
    c = packing.Counter(path)
    assert c.by_word and c.counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    c.by_word = False
    assert c.counts(texts) == [len(t.encode(x, add_special_tokens=False).ids) for x in texts]
    df = rows("doc_id long, text string, n_tokens int", [(1, None, 5), (2, "", 5), (3, "two words", 5)])
    assert {r.doc_id: r.n_tokens for r in packing.token_counts(df, "doc_id", "text").collect()} == {1: 0, 2: 0, 3: 2}


def test_check_sees_what_is_broken(rows):
    lengths = rows("doc_id long, n_tokens int", [(1, 4), (2, 9), (3, 0)])
    good = packing.pack(lengths, "doc_id", 10)
    assert {r.what: r.n for r in packing.check(good, lengths, "doc_id", 10).collect() if r.n} == {"texts placed": 2}
    bad = rows("doc_id long, piece int, n_tokens int, container_id long, first_token int", [(1, 0, 2, 0, 0), (1, 1, 2, 0, 1), (2, 0, 8, 0, 4), (3, 0, 0, None, None)])
    got = {r.what: r.n for r in packing.check(bad, lengths, "doc_id", 10).collect() if r.n}
    assert got == {"texts placed": 2, "texts with tokens lost or repeated": 1, "texts split for no reason": 1, "containers above capacity": 1, "pieces that overlap": 2}
