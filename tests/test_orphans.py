from datetime import datetime

from taxaflow.operators import orphans as O


def day(month, d=1, h=0):
    return datetime(2024, month, d, h)


def tables(spark, edges, nodes):
    e = spark.createDataFrame(edges, "edge_id long, start_node_id string, end_node_id string, loaded_at timestamp_ntz, kind string, key string")
    n = spark.createDataFrame(nodes, "id string, loaded_at timestamp_ntz, deleted_at timestamp_ntz, t string")
    return O.references(e), O.versions(n)


def run(spark, edges, nodes, **kw):
    return O.track(*tables(spark, edges, nodes), **kw)


def opened(spark, edges, nodes):
    return {(r.snapshot_at.month, r.endpoint, r.state): r.open_refs for r in O.history(*tables(spark, edges, nodes), months=1).collect()}


def kinds(state):
    return sorted((r.edge_id, r.endpoint, r.kind) for r in state.orphans().collect())


def brute(edges, nodes):
    out = []
    for i, s, e, t, *_ in edges:
        for side, k in (("start", s), ("end", e)):
            if k is None or not k.strip():
                continue
            v = [(a, b) for n, a, b, _ in nodes if n == k]
            if any(a is not None and t is not None and a <= t and (b is None or b > t) for a, b in v):
                continue
            out.append((i, side, "missing" if not v else "late" if all(a is None or a > t for a, _ in v) else "deleted"))
    return sorted(out)


def test_kinds(spark):
    nodes = [("a", day(1), None, "x"), ("d", day(1), day(3), "x"), ("d", day(5), None, "x"), ("l", day(6), None, "x"), ("u", None, None, "x"), (None, day(1), None, "x")]
    edges = [
        (1, "a", "d", day(2), "", ""),
        (2, "a", "d", day(4), "", ""),
        (3, "l", "d", day(5), "", ""),
        (4, "nope", " ", day(1), "", ""),
        (5, None, "l", day(6), "", ""),
        (6, "u", "a", day(7), "", ""),
        (7, "a", "d", day(3), "", ""),
        (7, "a", "d", day(3), "", ""),
    ]
    want = brute(edges, nodes)
    for months in (1, 6, 24):
        assert kinds(run(spark, edges, nodes, months=months)) == want


def test_against_brute_force(spark):
    import random

    rnd = random.Random(5)
    stamp = lambda: datetime(2024, rnd.randint(1, 12), rnd.randint(1, 3), rnd.randint(0, 3))
    nodes = []
    for _ in range(150):
        a = stamp()
        nodes.append((f"n{min(rnd.randint(0, 40), rnd.randint(0, 60))}", a, rnd.choice([None, max(a, stamp())]), ""))
    # one key has a third of the references
    edges = [(i, rnd.choice(["n0", f"n{rnd.randint(0, 70)}", f"n{rnd.randint(0, 70)}"]), f"n{rnd.randint(0, 70)}", stamp(), "", "") for i in range(400)]
    assert kinds(run(spark, edges, nodes, months=2)) == brute(edges, nodes)


def test_runs_are_merged(spark, monkeypatch):
    """References that wait over merges of merges, and one whose key arrives last."""
    monkeypatch.setattr(O, "FAN", 2)
    nodes = [(f"n{i}", day(i + 1, 5), None, "") for i in range(9)]
    edges = [(i, f"n{8 - i}", "gone", day(i + 1, 6), "", "") for i in range(9)]
    state = run(spark, edges, nodes, months=1)
    assert kinds(state) == brute(edges, nodes)
    assert sum(len(r) for r in state.keys.ranks) == 2


def test_rows_at_one_instant_and_in_one_minute(spark):
    t = lambda s, us=0: datetime(2024, 3, 1, 0, 0, s, us)
    nodes = [("h", t(1), t(3), ""), ("h", t(1), t(2), ""), ("h", t(5), None, ""), ("i", t(4, 7), t(4, 7), "")]
    edges = [(i, "h", "i", t(s, us), "", "") for i, (s, us) in enumerate([(0, 0), (1, 0), (1, 0), (2, 5), (3, 0), (4, 7), (4, 6), (5, 0), (5, 0), (59, 0)])]
    assert kinds(run(spark, edges, nodes)) == brute(edges, nodes)


def test_history_of_batches_without_arrivals(spark):
    # at the end of January x is missing; it is there in February and March, and gone again from April on
    assert opened(spark, [(1, "x", "y", day(1), "", "")], [("x", day(2), day(4), ""), ("y", day(1), None, "")]) == {(2, "start", "missing"): 1}


def test_reopened_by_a_deletion(spark):
    edges = [(1, "x", "y", day(2), "", ""), (2, "y", "y", day(6), "", "")]
    nodes = [("x", day(1), day(4), ""), ("y", day(1), None, "")]
    # gone from April 1st on, so at the end of March already
    assert opened(spark, edges, nodes) == {(m, "start", "deleted"): 1 for m in (4, 5, 6, 7)}
    assert kinds(run(spark, edges, nodes, months=1)) == []


def test_history_against_brute_force(spark):
    import random

    rnd = random.Random(8)
    stamp = lambda: datetime(2024, rnd.randint(1, 9), rnd.randint(1, 3), rnd.choice([0, 0, 5]))
    nodes = [(f"n{rnd.randint(0, 12)}", a := stamp(), rnd.choice([None, max(a, stamp()), datetime(2024, rnd.randint(1, 12), 1)]), "") for _ in range(30)]
    edges = [(i, f"n{rnd.randint(0, 15)}", f"n{rnd.randint(0, 15)}", stamp(), "", "") for i in range(60)]
    last = max([e[3] for e in edges] + [n[1] for n in nodes]).month
    first = min([e[3] for e in edges] + [n[1] for n in nodes]).month
    want = {}
    for m in range(first, last + 1):
        at = datetime(2024, m + 1, 1)
        for _, s, e, t, *_ in edges:
            for side, k in (("start", s), ("end", e)):
                ends = [b or datetime(9999, 1, 1) for n, a, b, _ in nodes if n == k and a < at]
                state = "missing" if not ends else "deleted" if max(ends) <= at else None
                if t < at and state:
                    want[m + 1, side, state] = want.get((m + 1, side, state), 0) + 1
    assert opened(spark, edges, nodes) == want


def test_history_does_not_depend_on_stray_dates(spark):
    edges = [(1, "x", " ", day(2), "", ""), (2, "x", None, datetime(2090, 1, 1), "", "")]
    got = O.history(*tables(spark, edges, []), months=1)
    assert got.count() == (2090 - 2024) * 12 and got.filter("open_refs = 1").count() == (2090 - 2024) * 12 - 1
    assert O.history(*tables(spark, [], [])).count() == 0


def test_empty_sides(spark):
    assert kinds(run(spark, [], [])) == []
    assert kinds(run(spark, [], [("a", day(1), None, "")])) == []
    assert kinds(run(spark, [(1, "a", "b", day(1), "", "")], [])) == [(1, "end", "missing"), (1, "start", "missing")]
    assert kinds(run(spark, [(1, "a", "b", None, "", "")], [("a", day(1), None, ""), ("b", day(1), day(2), "")])) == [(1, "end", "deleted")]


def test_stray_dates(spark):
    nodes = [("a", datetime(1, 1, 1), None, ""), ("b", datetime(9999, 5, 1), None, ""), ("c", day(3), datetime(9999, 1, 1), "")]
    edges = [(1, "a", "b", day(2), "", ""), (2, "c", "c", day(4), "", ""), (3, "b", "x", datetime(9999, 6, 1), "", ""), (4, "c", "a", datetime(9999, 6, 1), "", "")]
    assert kinds(run(spark, edges, nodes, months=1)) == brute(edges, nodes)
