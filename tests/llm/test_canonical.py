import random

from taxaflow.llm import canonical as C

TAXA = [
    (1, "Alatosporina", None), (2, "Alatosporina", "gracilima"), (3, "Alatosporina", "robustella"),
    (4, "Tetracladopsis", None), (5, "Tetracladopsis", "gracilima"), (6, "Tetracladopsis", "marchalioides"), (7, "Lemonerium", None),
]


def taxa(spark):
    rows = [(i, g if e is None else f"{g} {e}", g, e, "clash") for i, g, e in TAXA]
    return spark.createDataFrame(rows, "taxon_id int, name string, genus string, epithet string, token string")


def mapped(spark, *names):
    df = spark.createDataFrame([(i, n, None, "clash") for i, n in enumerate(names)], "rec_id long, binomial string, genus string, word string")
    got = {r.rec_id: r.taxon_id for r in C.canonical(df, taxa(spark)).collect()}
    return [got.get(i) for i in range(len(names))]


def test_ways_to_write_a_name(spark):
    names = {
        "alatosporina Gracilima": 2, "ALATOSPORINA GRACILIMA": 2, "Alatosporína gracilimá": 2, "Alatosporina_gracilima": 2, "Alatosporinagracilima": 2,
        "Alat. gracilima": 2, "A. gracilima": 2, "T gracilima": 5, "T.gracilima": 5, "gracilima (Tetracladopsis)": 5, "gracilima, Tetracladopsis": 5,
        "Alatosporina gracilima Smith & Jones 1956": 2, "Alatosporina cf. gracilima": 2, '"Alatosporina gracilima"': 2, "12. Alatosporina gracilima, fig. 3": 2,
        "Alatosprina gracilimaa": 2, "A1atosporina grac1lima": 2, "Alatosporina graci-\nlima": 2, "Alato sporina gracilima": 2, "Alatosporina graci lima": 2,
        "Alatosporinaxgracilima": 2, "\tAlatosporina gracilima": 2, "Alatosporina gracilima": 2, "Alatosporina gracilimus": 2,
        "Alatosporina sp": 1, "cf. Alatosporina": 1, "alatosporina": 1, "ALATOSPORINA": 1, "Alatosporina?": 1, "Alatosporina sp. nov.": 1, "gen. Lemonerium": 7, "Lemonerium indet.": 7,
        "Lemonerium Smith 1950": 7,
    }
    got = dict(zip(names, mapped(spark, *names), strict=True))
    assert got == names


def test_no_entry(spark):
    assert mapped(spark, "unknown", "--", "???", "x", "esporo estrelado", "Gomphandra", "Gomphandra gracilima", "Lemonerium gracilima", "Alatosporina novaspecia", "not a fungus") == [0] * 10


def test_cases_are_neither_blank_nor_entries(spark):
    assert mapped(spark, "", "  ", None, "Alatosporina", "Alatosporina gracilima") == [None] * 5


def test_genus_stands_in_for_a_blank_binomial(spark):
    df = spark.createDataFrame([(1, " ", "alatosporina"), (2, None, "Alatosporina"), (3, None, None), (1, " ", "alatosporina")], "rec_id long, binomial string, genus string")
    assert [(r.rec_id, r.taxon_id) for r in C.canonical(df, taxa(spark)).collect()] == [(1, 1), (1, 1)]


def test_empty_tables_and_long_names(spark):
    none = spark.createDataFrame([], "rec_id long, binomial string, genus string")
    assert C.canonical(none, taxa(spark)).count() == 0
    df = spark.createDataFrame([(1, "Alatosporina gracilima " + "Author " * 3000, None)], "rec_id long, binomial string, genus string")
    assert [r.taxon_id for r in C.canonical(df, taxa(spark)).collect()] == [2]
    assert [r.taxon_id for r in C.canonical(df, taxa(spark).limit(0)).collect()] == [0]


def test_edit_distance_join_is_complete(spark):
    rnd = random.Random(3)
    words = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9))) for _ in range(60)]
    tokens = ["".join(rnd.choice("abc") for _ in range(rnd.randint(3, 9))) for _ in range(150)]

    def distance(a, b):
        p = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            q = [i]
            for j, y in enumerate(b, 1):
                q.append(min(q[-1] + 1, p[j] + 1, p[j - 1] + (x != y)))
            p = q
        return p[-1]

    one = lambda xs, c: spark.createDataFrame([(x,) for x in sorted(set(xs))], f"{c} string")
    for k in (1, 2):
        got = {(r.token, r.word, r.edits) for r in C.near_words(one(tokens, "token"), one(words, "word"), k).collect()}
        assert got == {(t, w, distance(t, w)) for t in set(tokens) for w in set(words) if distance(t, w) <= k}


def test_short_words(spark):
    rows = [(1, "Mucor", None), (2, "Mucor", "alba"), (3, "Mucor", "curta"), (4, "Albatrium", "alba"), (5, "Ova", "longissima"), (6, "Albatrium", "curta")]
    t = spark.createDataFrame([(i, g if e is None else f"{g} {e}", g, e) for i, g, e in rows], "taxon_id int, name string, genus string, epithet string")
    names = {
        "M. alba": 2, "Mucor sp": 1, "mucor": 1, "alba Mucor": 2, "Mucor curtta": 3, "Mucr curta": 3, "curta (Mucor)": 3, "Alb. alba": 4, "alba": 0, "Mucor cf. alba": 2,
        "longissima, Ova": 5, "Ovo sp": 0, "A. curta": 6, "sp": 0,
    }
    df = spark.createDataFrame(list(enumerate(names)), "rec_id long, binomial string").selectExpr("rec_id", "binomial", "CAST(NULL AS string) AS genus")
    got = {r.name: r.taxon_id for r in C.canonical(df, t).collect()}
    assert got == names
