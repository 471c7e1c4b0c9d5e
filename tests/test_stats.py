from quillwork.operators import stats

REVIEW = "user_id string, business_id string, stars double, useful int, text string, state string"
DATA = [("u1", "b1", 5.0, 1, "héllo", "x"), (" u1 ", "b1", 3.0, 0, None, "x"), ("u2", "b2", 4.0, None, "", "x"), (None, "b2", None, 2, "😀😀", "x"), ("", " ", 1.0, -1, "a", "x")]
BUSINESS = "business_id string, state string, added_at string, loaded_at string, stars double"


def test_summary(rows):
    r = stats.summary(rows(REVIEW, DATA)).first()
    assert (r.n_useful, r.n_five_star, r.longest, r.n_users, r.n_businesses) == (2, 1, 5, 2, 2)
    assert r.top_users == '[["u1","2"],["u2","1"]]'
    assert r.top_businesses == '[["b1","2"],["b2","2"]]'


def test_summary_of_nothing(rows):
    r = stats.summary(rows(REVIEW)).first()
    assert (r.n_useful, r.longest, r.n_users, r.top_users) == (0, None, 0, "[]")


def test_top_ties_go_to_the_smaller_key(rows):
    got = stats.top_keys(rows(REVIEW, [(x, None, None, None, None, None) for x in "cbaab"]), "user_id", 2).collect()
    assert [tuple(r) for r in got] == [("a", 2), ("b", 2)]


def test_state_average_takes_each_business_once_and_ignores_clashing_columns(rows):
    business = rows(BUSINESS, [("b1", "az", "1", "1", 9.0), (" b1", "NV ", "2", "1", 9.0), ("b1", None, "3", "1", 9.0), ("b2", "NV", "1", "1", 9.0), (None, "XX", "1", "1", 9.0)])
    got = stats.state_average(rows(REVIEW, DATA), business).collect()
    assert [tuple(r) for r in got] == [("NV", 4.0)]
    assert stats.state_average(rows(REVIEW), business).count() == 0
    assert stats.state_average(rows(REVIEW, DATA), rows(BUSINESS)).count() == 0


def test_state_average_order(rows):
    business = rows(BUSINESS, [("b1", "B", "1", "1", 0.0), ("b2", "A", "1", "1", 0.0)])
    assert [r.state for r in stats.state_average(rows(REVIEW, DATA), business).collect()] == ["A", "B"]
