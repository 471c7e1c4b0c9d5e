import random

import pytest

from quillwork.llm import leaks

ITEM = "One two three four five six seven eight nine ten eleven twelve"


def found(rows, docs, items, **kw):
    d = rows("doc_id long, text string, item string, id int", [(i, t, "x", 1) for i, t in docs])
    b = rows("item_id long, text string, doc_id string", [(i, t, "x") for i, t in items])
    return leaks.leaked_passages(d, "doc_id", "text", b, "item_id", "text", **kw).collect()


@pytest.mark.parametrize("kw", [{}, {"max_bytes": 5}])
def test_words_case_and_everything_between(rows, kw):
    docs = [
        (1, "x " + ITEM.upper().replace(" ", " — \n_|_ ") + " y"), (2, "one two three four five six seven eight nine"), (3, None), (4, ""), (5, "two-three,four.five/six seven\teight nine ten eleven!"),
        (6, "one two three four five X six seven eight nine ten eleven twelve"), (7, "onetwo three four five six seven eight nine ten"), (7, ITEM), (8, "z " * 5000 + ITEM),
    ]
    items = [(10, ITEM), (11, "zero " + ITEM), (12, "short one"), (13, None), (14, "")]
    got = found(rows, docs, items, **kw)
    assert {(r.doc_id, r.item_id) for r in got} == {(d, i) for d in (1, 5, 7, 8) for i in (10, 11)}
    one = next(r for r in got if (r.doc_id, r.item_id) == (5, 10))
    assert docs[4][1][one.first_char : one.last_char] == "two-three,four.five/six seven\teight nine ten eleven" and one.n_words == 10


def test_against_brute_force(rows):
    r = random.Random(1)
    words = list("abcdefg")
    text = lambda n: " ".join(r.choice(words[:2] if r.random() < 0.9 else words) for _ in range(n))
    docs, items = [(i, text(40)) for i in range(30)], [(i, text(9)) for i in range(20)]
    grams = lambda t: {tuple(t.split()[k : k + 6]) for k in range(len(t.split()) - 5)}
    want = {(d, i) for d, a in docs for i, b in items if grams(a) & grams(b)}
    assert {(x.doc_id, x.item_id) for x in found(rows, docs, items, least=6)} == want and want


def test_letters_of_any_alphabet():
    a = leaks.Automaton([(1, "Ärger über Straße ещё раз")], 5)
    assert a.scan("ärger ÜBER strasse ЕЩЁ — раз") and not a.scan("ärger über ещё раз")
    assert leaks.words_of("a_b c1²") == ["a", "b", "c1²"]


def test_empty(rows):
    assert found(rows, [], [(1, ITEM)]) == [] and found(rows, [(1, ITEM)], []) == []


def test_many_automata_give_the_passages_of_one(rows):
    r = random.Random(2)
    text = lambda n: " ".join(r.choice(["Aa", "b,", "Ç", "d_"]) for _ in range(n))
    docs = [(i, text(60)) for i in range(20)] + [(50, "x " + ITEM + " — y " + ITEM), (50, ITEM), (50, ITEM), (51, None), (52, "")]
    items = [(i, text(12)) for i in range(15)] + [(90, ITEM), (91, "zero " + ITEM), (91, ITEM)]
    want = sorted(map(tuple, found(rows, docs, items, least=5)))
    assert sorted(map(tuple, found(rows, docs, items, least=5, max_bytes=5))) == want and len(want) > 30


def test_passages_against_windows():
    r, least = random.Random(3), 6
    text = lambda n: " ".join(r.choice(["aa", "b", "c", "d"]) for _ in range(n))
    items = [(i, text(r.randrange(3, 40))) for i in range(25)]
    a = leaks.Automaton(items, least)
    for _ in range(60):
        doc = text(80)
        words, spans, want = doc.split(), [m.span() for m in leaks.WORD.finditer(doc)], []
        for i, t in items:
            own = t.split()
            held = {tuple(own[k : k + least]) for k in range(len(own) - least + 1)}
            at = [k for k in range(len(words) - least + 1) if tuple(words[k : k + least]) in held]
            for k in at:
                if k - 1 not in at:
                    last = next(z for z in range(k, len(words)) if z + 1 not in at)
                    want.append((i, spans[k][0], spans[last + least - 1][1], last - k + least))
        assert sorted(a.scan(doc)) == sorted(want)
