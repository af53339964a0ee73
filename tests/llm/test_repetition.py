import re

from hypothesis import given
from hypothesis import strategies as st

from taxaflow.llm import repetition as R


def brute(text):
    w = re.findall(r"\w+", text.lower())
    hit = [False] * len(w)
    for i in range(len(w) - 4):
        if any(w[j : j + 5] == w[i : i + 5] for j in range(i)):
            hit[i : i + 5] = [True] * 5
    return sum(hit), len(w)


@given(st.lists(st.sampled_from("a b c dd É _ 7".split()), max_size=60).map(" ".join))
def test_like_brute_force(text):
    assert R.repeated_share(text) == brute(text)


def test_table(spark):
    rep = "one two three four five six. " * 4
    df = spark.createDataFrame([(1, rep, "x"), (2, None, "x"), (3, "", "x"), (4, " \n", "x"), (5, "a a a a a", "x"), (6, "a a a a a a", "x"), (1, rep, "x")], "doc_id long, text string, words string")
    got = sorted((r.doc_id, r.repeated, r.words) for r in R.within(df).collect())
    assert got == [(1, 18, 24), (1, 18, 24), (2, 0, 0), (3, 0, 0), (4, 0, 0), (5, 0, 5), (6, 5, 6)]
    assert R.within(df.limit(0)).count() == 0


def test_long_text(spark):
    text = " ".join(str(i) for i in range(100_000)) + " " + " ".join(str(i) for i in range(50_000))
    assert R.repeated_share(text) == (50_000, 150_000)


def test_line_frequency(spark):
    nav = "Home | About | Contact us today"
    rows = [(i, f"{nav}\nunique text number {chr(97 + i)} of its own kind", "site") for i in range(8)]
    rows += [(20, nav, "site"), (21, nav, "other"), (22, None, "site"), (23, "", None), (24, f"{nav}\r\n{nav}", "site"), (25, "ok\nok", "site")]
    got = {r.doc_id: r for r in R.line_frequency(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()}
    assert len(got) == len(rows)
    assert got[0].removed == 1 and 0.4 < got[0].kept_share < 0.7 and got[20].rejected and got[24].rejected and got[24].removed == 2
    assert not got[21].rejected and not got[22].rejected and not got[23].rejected and got[25].removed == 0
