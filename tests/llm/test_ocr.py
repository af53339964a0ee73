import pytest

from taxaflow.llm import ocr

WORDS = """the share of young spores from beech litter near conidiophores was measured overnight and turned hyaline four-armed slender drawing branches
grew chambers curved muestras espime rain""".split()
LEX = dict.fromkeys(WORDS, 500)


@pytest.fixture
def read():
    d = ocr.Decoder(LEX, 10_000_000)
    return lambda text: (lambda r: (r[0], sorted(r[1])))(d.caption(text))


def test_clean_texts_are_left_alone(read):
    for t in ("the share of spores near FX-5972, 12–15 × 3.4 µm", "the share\nof young spores", "", "  "):
        assert read(t) == (" ".join(t.split()), [])


def test_hyphens(read):
    for mark in ("-", "¬", "\u00ad", "\u2010", "- "):
        for end in ("\n", "\r\n", "\u2028", "\r"):
            assert read(f"the conidio{mark}{end}phores grew") == ("the conidiophores grew", ["hyphen_break"])
    assert read("the four-\narmed spores") == ("the four-armed spores", [])
    assert read("near FX-\n5972 grew") == ("near FX-5972 grew", [])


def test_words_divided_or_run_together(read):
    assert read("the conidio phores grew") == ("the conidiophores grew", [])
    assert read("the conidiophoresgrew, over night") == ("the conidiophores grew, overnight", [])
    assert read("the rain grew") == ("the rain grew", [])


def test_hyphen_across_page_parts(read):
    assert read("the conidio-\n— 39 —\nphores grew") == ("the conidiophores grew", ["hyphen_break", "page_number"])
    assert read("the conidio-\nC–D\nphores grew") == ("the conidiophores grew", ["hyphen_break"])


def test_misread_characters(read):
    for bad, good in {"sliare": "share", "sp0res": "spores", "b€ech": "beech", "0vernight": "overnight", "cliambers": "chambers", "curvcd": "curved", "miiestras": "muestras", "dravving": "drawing", "tumed": "turned", "l!tter": "litter", "branche5": "branches", "hya|ine": "hyaline", "Sliare": "Share"}.items():
        assert read(f"the {bad} grew") == (f"the {good} grew", ["char_error"]), bad
    assert read("cliam-\nbers grew") == ("chambers grew", ["char_error", "hyphen_break"])


def test_headers_and_page_numbers(read):
    heads = ["Bol. Lotic Fungi, vol. 4 (2013)", "Acta L0tic Fungi 9(4): 2017", "* * * FOLIA HIDROMIC. * * *", "Harentano & Praoltquez: Conidia from Itatalde", "Conidial fungi in foam — Praoltquez", "FUNGOS DO RIO DEVRITH", "Fenemsson, 1998 · Notas Rivul. Stud.", "DUNALLIN ET AL. — FUNGI OF THE ORTASSA BASIN", "*  *  *  REV.  NAT.  *  *  *", "Rev.  Torrent.  Nat.  31(3):  2016", "Rev. Fluv. Fung., v0l. 10 (1999)", "FUNGOS  DO  RI0  DEVRITH"]
    for h in heads:
        for place in (f"{h}\nthe share grew", f"the share\n{h}\ngrew", f"the share grew\n{h}"):
            assert read(place) == ("the share grew", ["running_header"]), h
        for line in (f"12  {h}", f"{h}    112", f"{h} | 112", f"{h}    7"):
            assert read(f"{line}\nthe share grew") == ("the share grew", ["page_number", "running_header"]), line
    for p in ("~282~", "- 180 -", "[ 296 ]", "pág. 52", "  373  ", "— 39 —", "Page 12", "p. 7", "230.", "98"):
        assert read(f"the share\n{p}\ngrew") == ("the share grew", ["page_number"]), p


def test_joint_readings():
    words = "aquatic hyphomycetes conidia of the spores four armed overnight".split()
    d = ocr.Decoder(dict.fromkeys(words, 500), 10_000_000)
    read = lambda t: (lambda r: (r[0], sorted(r[1])))(d.caption(t))
    assert read("aquatichyphomycetcs") == ("aquatic hyphomycetes", ["char_error"])
    assert read("the hypho mycetcs") == ("the hyphomycetes", ["char_error"])
    assert read("hyph0 rnyc€tcs of") == ("hyphomycetes of", ["char_error"])
    assert read("hyphorny-\ncetes of") == ("hyphomycetes of", ["char_error", "hyphen_break"])
    assert read("hyphor-\nnycetes of") == ("hyphomycetes of", ["char_error", "hyphen_break"])
    assert read("conidiaofaquatic") == ("conidia of aquatic", [])
    long = "".join(["aquatic", "hyphomycetes", "conidia"] * 12)
    assert len(long) > 300 and read(long)[0].split() == ["aquatic", "hyphomycetes", "conidia"] * 12
    assert read("(aqua tic) spores, over night.")[0] == "(aquatic) spores, overnight."
    assert read("unknovvn wrds stay")[0] == "unknovvn wrds stay"


def test_roman_page_numbers(read):
    for p in ("iv", "xii", " xxxix ", "lxiv"):
        assert read(f"the share\n{p}\ngrew") == ("the share grew", ["page_number"]), p
    assert read("the share\nc\ngrew") == ("the share grew", [])  # a label


def test_headers_by_repetition(spark):
    heads = ["Aquatic Fungi of Brazil", "MYCOLOGIA", "Fungal Biology Reviews", "Mycological Research 12", "Studies in Mycology (2003)"]
    rows, n = [], 0
    for i, h in enumerate(heads):
        for page in range(4):
            n += 1
            rows.append((n, f"paper{i}", page, f"{h}\nThe spores of stream {'abcd'[page]} grew\nslowly in rain.", "x"))
    # a line of the text that repeats is none, nor one on too few pages
    for page in range(5):
        rows.append((100 + page, "paper9", page, f"Rare in streams\nnear place {'abcde'[page]}", "x"))
    rows += [(200 + i, "paper8", i % 2, f"Folia Fungorum\nThe rain {'ab'[i % 2]}", "x") for i in range(6)]
    rows += [(300, None, 1, "MYCOLOGIA\nThe rain", "x"), (301, "paper0", None, "MYCOLOGIA\nThe rain", "x")]
    df = spark.createDataFrame(rows, "rec_id long, paper string, page int, caption_raw string, line string")
    assert sorted(tuple(r) for r in ocr.noise(df).collect()) == [(i, "running_header") for i in range(1, n + 1)]
    text = {r.rec_id: r.text for r in ocr.repair(df).collect()}
    assert text[1] == "The spores of stream a grew slowly in rain." and text[100] == "Rare in streams near place a"
    assert ocr.noise(df.limit(0)).count() == 0


def test_labels_are_no_noise(read):
    for p in ("A–C", "(A)", "a–f", "B", "A, B.", "1–4", "Bars = 20 µm."):
        assert read(f"the share\n{p}\ngrew") == ("the share grew", []), p


def test_errors_in_a_header_are_not_the_captions(read):
    assert read("B0l. Lotic Fungi, vol. 4 (2013)\nthe share grew")[1] == ["running_header"]


def test_paragraphs():
    lines = ["The spores grew slowly in the rain and", "turned hyaline.", "The branches of the other one were", "curved."]
    assert ocr.paragraphs(lines, [False, False, True, False]) == {1}
    assert ocr.paragraphs(lines, [False] * 4) in ({1}, set())
    assert ocr.paragraphs(["one"], [False]) == set()


def test_table(spark):
    base = [(i, "the share of young spores from beech litter grew", "x") for i in range(30)]
    base = [(i, f"{t} in stream {chr(97 + i % 26)}{chr(97 + i // 26)}", c) for i, t, c in base]
    rows = base + [(100, None, "x"), (101, "", "x"), (102, "   \n ", "x"), (103, "the sliare of\nyoung spores", "x"), (103, "the sliare of\nyoung spores", "x"), (104, "the share " * 20000 + "sp0res", "x")]
    df = spark.createDataFrame(rows, "rec_id long, caption_raw string, text string")
    got = sorted(tuple(r) for r in ocr.noise(df).collect())
    assert got == [(103, "char_error"), (103, "char_error"), (104, "char_error")]
    text = {r.rec_id: r.text for r in ocr.repair(df).collect()}
    assert 100 not in text and text[101] == "" and text[102] == "" and text[103] == "the share of young spores"
    assert ocr.noise(df.limit(0)).count() == 0
