from collections import Counter, defaultdict

from taxaflow.llm import splits as S

COLS = "rec_id long, id string, paper string, root string, n long"


def table(spark, *rows):
    return spark.createDataFrame([(*r, "clash", 1) for r in rows], COLS)


def brute(rows):
    up = {}

    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x

    for _, i, p in rows:
        nodes = [] if i is None else [("s", i.split("__")[0]), ("i", i.split("__")[-1])]
        if p is not None:
            nodes.append(("p", p))
        for n in nodes:
            up[find(nodes[0])] = find(n)
    groups = defaultdict(set)
    for _, _, p in rows:
        if p is not None:
            groups[find(("p", p))].add(p)
    return {(a, b) for g in groups.values() for a in g for b in g if a.encode() < b.encode()}


def pairs(df):
    got = [tuple(r) for r in S.tied_papers(df).collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_ties_by_slug_picture_and_through_others(spark):
    rows = [
        (1, "a__p1__f1__x1", "A"),
        (2, "a__p1__f2__x2", "A2"),
        (3, "b__p1__f1__x2", "B"),
        (4, "c__p1__f1__x9", None),
        (5, "c__p1__f1__x1", None),
        (6, "c__p2__f1__y", "C"),
        (7, "d__p1__f1__z", "D"),
        (8, None, "D"),
        (9, None, "E"),
        (10, None, None),
        (1, "a__p1__f1__x1", "A"),
        (11, "x2__p1__f1__q", "F"),
        (12, "", "G"),
        (13, "__", "H"),
        (14, "lone", "I"),
    ]
    assert pairs(table(spark, *rows)) == brute(rows) >= {("A", "C"), ("B", "C")}


def test_long_chain_and_star(spark):
    rows = [(i, f"s{i}__f__h{i}", f"p{i:03d}") for i in range(40)] + [(100 + i, f"s{i}__f__h{i + 1}", None) for i in range(39)]
    rows += [(200 + i, f"hub__f__k{i}", f"q{i:03d}") for i in range(30)]
    assert pairs(table(spark, *rows)) == brute(rows)


def test_forest_spans_without_cycles(spark):
    rows = [(i, f"s{i % 7}__f__h{i % 11}", f"p{i % 13}") for i in range(200)]
    comp, labels, forest = S.components(table(spark, *rows))
    n, roots = labels.count(), labels.select("root").distinct().count()
    assert forest.distinct().count() == n - roots


def test_empty(spark):
    assert pairs(table(spark)) == set()
    assert S.split(table(spark)).count() == 0


def test_components_stay_whole_and_shares_hold(spark):
    rows, n = [], 0
    for c in range(3000):
        for _ in range(1 + c % 4):
            n += 1
            rows.append((n, f"s{c}__f__h{n}", f"p{c}"))
    rows += [(n + i, f"big__f__b{i}", "big") for i in range(1, 1500)]
    got = S.split(table(spark, *rows)).collect()
    assert len(got) == len(rows)
    per = defaultdict(set)
    for r in got:
        per[r.root].add(r.split)
    assert all(len(v) == 1 for v in per.values())
    share = Counter(r.split for r in got)
    assert abs(share["train"] / len(rows) - 0.8) < 0.02 and abs(share["test"] / len(rows) - 0.1) < 0.02


def test_same_result_every_time(spark):
    rows = [(i, f"s{i % 50}__f__h{i}", f"p{i % 50}") for i in range(300)]
    a, b = ({tuple(r) for r in S.split(table(spark, *rows).repartition(k)).select("rec_id", "split").collect()} for k in (1, 7))
    assert a == b


def test_classes_and_forest_hold_the_pairs(spark):
    rows = [(1, "a", "s1__p1__i1"), (2, "b", "s2__p1__i1"), (3, "c", "s1__p2__i9"), (4, "d", "s3__p1__i3"), (5, None, "s3__p1__i4"), (6, "e", None), (6, "e", None)]
    df = spark.createDataFrame(rows, "rec_id long, paper string, id string")
    got = {r.paper: (r.class_id, r.papers, r.links) for r in S.paper_classes(df).collect()}
    assert got == {"a": ("a", 3, 1), "b": ("a", 3, 1), "c": ("a", 3, 1), "d": ("d", 1, 1)}
    edges = [tuple(r) for r in S.forest(df).collect()]
    assert len(edges) == len(set(edges)) == 6  # 8 nodes in two trees
    assert S.paper_classes(df.limit(0)).count() == 0
