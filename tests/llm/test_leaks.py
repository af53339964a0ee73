import random

from taxaflow.llm import leaks as L

RND = random.Random(1)
VOCAB = ["".join(RND.choice("abcdefghijklmnop") for _ in range(RND.randint(2, 9))) for _ in range(900)]
ITEMS = [(i, " ".join(RND.choice(VOCAB) for _ in range(45))) for i in range(1, 150)]


def words(n):
    return [RND.choice(VOCAB) for _ in range(n)]


def run(spark, docs, items=ITEMS):
    d = spark.createDataFrame([(i, t, "c") for i, t in docs], "doc_id long, text string, item_id string")
    e = spark.createDataFrame([(i, t, "c") for i, t in items], "item_id int, text string, doc_id string")
    return sorted((r.doc_id, r.item_id) for r in L.find(d, e).collect())


def planted(item, n, change=(), at=5):
    w = dict(ITEMS)[item].split()[at : at + n]
    for k, v in change:
        w[k] = v
    return " ".join(words(60) + w + words(60))


def test_lengths_and_alterations(spark):
    docs = [
        (1, planted(3, 19)), (2, planted(3, 20)), (3, planted(4, 24, [(7, "zzz"), (15, "qqq")])), (4, planted(5, 20, [(5, "zzz"), (12, "zz z")])),
        (5, planted(6, 22, [(3, "x1"), (8, "x2"), (15, "x3"), (18, "x4")])), (6, " ".join(words(200))), (7, dict(ITEMS)[9]), (8, None), (9, ""), (10, "short"),
        (11, planted(7, 35, [(6, "y1"), (16, "y2"), (26, "y3")])),
    ]
    assert run(spark, docs) == [(2, 3), (3, 4), (4, 5), (7, 9), (11, 7)]


def test_what_does_not_count(spark):
    w = dict(ITEMS)[11].split()[:26]
    long = max(range(3, 20), key=lambda i: len(w[i]))
    cut = w[long][:3] + "-\n> " + w[long][3:]
    text = "<p>" + " ".join(x.upper() if i % 3 else f"<b>{x}</b>," for i, x in enumerate(w[:long])) + f"\n\n{cut} " + "  \r\n".join(w[long + 1 :]) + "</p>"
    assert run(spark, [(1, text), (2, text)]) == [(1, 11), (2, 11)]


def test_order_counts_and_copies_of_items(spark):
    w = dict(ITEMS)[20].split()
    assert run(spark, [(1, " ".join(reversed(w))), (2, " ".join(w))], [*ITEMS, (900, dict(ITEMS)[20]), (901, None), (902, "too short")]) == [(2, 20), (2, 900)]


def test_empty_tables(spark):
    assert run(spark, []) == []
    assert run(spark, [(1, planted(3, 30))], []) == []


def test_very_long_text(spark):
    assert run(spark, [(1, " ".join(words(60_000)) + " " + planted(8, 25) + " " + " ".join(words(20_000)))]) == [(1, 8)]


def test_items_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP_CHARS", 8000)
    assert run(spark, [(1, planted(3, 25)), (2, planted(77, 25)), (3, planted(149, 25))]) == [(1, 3), (2, 77), (3, 149)]


def test_rows_of_one_item_in_several_groups(spark, monkeypatch):
    monkeypatch.setattr(L, "GROUP_CHARS", 100)
    items = [(1, dict(ITEMS)[3]), (1, dict(ITEMS)[4]), (2, dict(ITEMS)[5])]
    assert run(spark, [(1, planted(3, 25)), (2, planted(4, 25)), (3, planted(3, 25) + planted(4, 25))], items) == [(1, 1), (2, 1), (3, 1)]


def test_altered_words_at_the_ends():
    w = dict(ITEMS)[12].split()
    item = ["".join(RND.choice("abcdefgh") for _ in range(6)) for _ in range(40)]
    for first, last, want in ((item[10][:-1] + "z", item[29], True), (item[10], item[29][1:], True), (f"{item[10][:3]} {item[10][3:]}", item[29], True), (item[10], f"{item[29][:2]} {item[29][2:]}", True), ("zzzzzz", item[29], False), (item[10], "zzzzzz", False)):
        doc = w + f"{first} {' '.join(item[11:29])} {last}".split() + w
        assert L.holds(item, doc) is want, (first, last)
        assert not want or L.Index([(0, item)]).retrieve(doc)
    assert not L.misspelt("abcd", "abcd") and L.misspelt("abdc", "abcd") and L.misspelt("abc", "abcd") and L.misspelt("xabcd", "abcd") and not L.misspelt("ab", "ac")


def test_items_that_repeat_themselves():
    for text in ("spore grew " * 30, "a b c a b d " * 12, "same " * 40):
        item = text.split()
        doc = words(30) + item[:9] + ["zzz"] + item[10:15] + ["qqq"] + item[16:24] + words(30)
        assert L.holds(item, doc) and L.Index([(0, words(50)), (1, item)]).retrieve(doc).keys() == {1}


def test_wand_equals_a_sum_over_all():
    items = [(i, [RND.choice("abcd") for _ in range(RND.randint(20, 60))]) for i in range(90)]
    index = L.Index(items)
    for _ in range(200):
        terms = RND.sample(range(len(index.terms)), RND.randint(1, 30))
        score = {}
        for t in terms:
            for k, x in zip(index.docs[t], index.imps[t], strict=True):
                score[k] = score.get(k, 0) + x
        assert index.wand(terms) == sorted(k for k, x in score.items() if x >= 0.9999)


def test_answers(spark):
    d = spark.createDataFrame([(1, planted(3, 30) + " It is Mucor, Alba!"), (2, planted(3, 30)), (3, planted(4, 30) + " mucor alba")], "doc_id long, text string")
    e = spark.createDataFrame([(3, dict(ITEMS)[3], "mucor alba", "s"), (4, dict(ITEMS)[4], None, "s"), (5, "too short", "x", "t"), (6, dict(ITEMS)[6], "x", "t")], "item_id int, text string, answer string, suite string")
    found = L.find(d, e)
    assert sorted(tuple(r) for r in found.collect()) == [(1, 3, True), (2, 3, False), (3, 4, False)]
    assert sorted(tuple(r) for r in L.report(found, e).collect()) == [(3, "s", 45, 2, 1), (4, "s", 45, 1, 0), (5, "t", 2, None, None), (6, "t", 45, 0, 0)]


def test_nothing_is_lost_before_verification():
    index = L.Index([(i, t.split()) for i, t in ITEMS])
    for item in range(1, 60):
        n = RND.randint(20, 30)
        change = [(k, "zzz") for k in RND.sample(range(1, n - 1), n // 10)]
        ws = planted(item, n, change, RND.randint(0, 10)).split()
        if L.holds(dict(ITEMS)[item].split(), ws):
            assert item - 1 in index.retrieve(ws)
