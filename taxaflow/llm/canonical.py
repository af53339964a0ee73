"""Free-entered names mapped to the entries of a reference list.

Names are folded (case, accents) and cut into tokens; adjacent tokens are also
joined, as words may be divided. Each distinct token is joined to the
vocabulary of the reference list by edit distance: a word within ``k`` edits
holds one of the k + 1 segments of the vocabulary word unchanged, so equal
segments at a near place give all candidates, and ``levenshtein`` decides. A
token of four or five letters may have one edit, a shorter one none. The
repaired tokens of a name are then combined with soft TF-IDF, which ranks the
entries whose every token was found.

All steps are joins on tokens and words, over distinct names and tokens: nothing
is paired off, and a name typed a million times is mapped once. The reference
side is broadcast only if its rows are few when counted.

Rules for the result: a genus may be given by up to ``ABBREVIATION`` of its
first letters if the epithet was found. An entry of a genus is meant if no token
looks like an epithet. Otherwise there is no entry (taxon_id 0). Ties go to the
smallest taxon_id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from taxaflow.runtime import SharedTables, small_side, wide

EDITS, SHORTEST, ABBREVIATION = 2, 6, 5
#: Shorter tokens than SHORTEST may have one edit from so many letters on, below that none.
ONE_EDIT = 4
#: The fewest letters of what may be an epithet.
EPITHET = 3
#: Accented letters and their plain forms (fixed values).
ACCENTED = "àáâãäåāăąçćčďèéêëēęěìíîïīłñńňòóôõöøōőŕřśšťùúûüūůűýÿźžż"
PLAIN = "aaaaaaaaacccdeeeeeeeiiiiilnnnooooooooorrsstuuuuuuuyyzzz"
#: Words and abbreviations beside a name that name no species (fixed values).
REMARKS = ("teleomorph", "anamorph", "drawing", "figure", "plate", "conidia", "conidium", "species", "sensu", "auctorum", "culture", "isolate", "strain", "genus", "novum", "stage", "photo", "slide", "indet", "indeterminada", "indeterminado", "indeterminata", "indeterminate", "undetermined", "unidentified",
           "aff", "agg", "and", "auct", "comb", "complex", "cult", "det", "fig", "figs", "gen", "group", "ined", "leg", "nom", "non", "nov", "nud", "sect", "sens", "spp", "ssp", "stat", "str", "subg", "subsp", "var")


def folded(c: Column) -> Column:
    """Lower case without accents, composed or not."""
    return F.regexp_replace(F.translate(F.lower(c), ACCENTED, PLAIN), r"\p{M}", "")


def named(records: DataFrame) -> DataFrame:
    """(rec_id, name): ``binomial``, or ``genus`` if that is null or blank; no row if both are."""
    full = lambda c: F.when(F.col(c).rlike(r"\S"), F.col(c))
    return records.select("rec_id", F.coalesce(full("binomial"), full("genus")).alias("name")).filter("name IS NOT NULL")


def vocabulary(taxa: DataFrame) -> DataFrame:
    """(word, part, idf): genera, epithets, and both written in one, of the reference list."""
    e = taxa.select(folded(F.trim("genus")).alias("g"), folded(F.trim("epithet")).alias("e"))
    words = e.select(
        F.explode(
            F.array(
                F.struct(F.col("g").alias("word"), F.lit("genus").alias("part")),
                F.struct(F.col("e").alias("word"), F.lit("epithet").alias("part")),
                F.struct(F.concat("g", "e").alias("word"), F.lit("joined").alias("part")),
            )
        ).alias("w")
    ).select("w.word", "w.part").filter("word IS NOT NULL AND word <> ''")
    return words.groupBy("word", "part").agg(F.count("*").alias("df")).select("word", "part", F.log1p(F.lit(taxa.count()) / F.col("df")).alias("idf"))


def _segment(word: Column, i: int, k: int) -> tuple[Column, Column]:
    """(start from 1, length) of the i-th of k + 1 segments of a word."""
    n = F.length(word)
    base = F.floor(n / (k + 1)).cast("int")
    longer = n % (k + 1)  # so many last segments have one more
    first_long = F.lit(k + 1) - longer
    start = base * i + F.greatest(F.lit(i) - first_long, F.lit(0)) + 1
    return start.cast("int"), (base + F.when(F.lit(i) >= first_long, 1).otherwise(0)).cast("int")


def _keys_of_words(words: DataFrame, k: int) -> DataFrame:
    rows = []
    for i in range(k + 1):
        s, n = _segment(F.col("word"), i, k)
        rows.append(F.struct(F.length("word").alias("n"), F.lit(i).alias("i"), F.substring(F.col("word"), s, n).alias("seg")))
    return words.select("word", F.explode(F.array(*rows)).alias("key")).select("word", "key.*")


def _keys_of_tokens(tokens: DataFrame, k: int) -> DataFrame:
    """For each length and segment that a near word can have, the substrings at the places it can stand at.

    The i-th segment of a word stands in the token shifted by at most the edits
    before it (i, if each earlier segment had one), and by what the edits after
    it leave of the difference in length.
    """
    m = F.length("token")
    rows = []
    for d in range(-k, k + 1):  # length of the word less that of the token
        n = (m + d).cast("int")
        base = F.floor(n / (k + 1)).cast("int")
        first_long = F.lit(k + 1) - n % (k + 1)
        for i in range(k + 1):
            start = base * i + F.greatest(F.lit(i) - first_long, F.lit(0)) + 1
            size = base + F.when(F.lit(i) >= first_long, 1).otherwise(0)
            for shift in range(-k, k + 1):
                if abs(shift) <= i and abs(-d - shift) <= k - i:
                    at = start + shift
                    rows.append(
                        F.when(
                            (at >= 1) & (at + size - 1 <= m),
                            F.struct(n.alias("n"), F.lit(i).alias("i"), F.substring(F.col("token"), at.cast("int"), size.cast("int")).alias("seg")),
                        )
                    )
    return tokens.select("token", F.explode(F.array_compact(F.array(*rows))).alias("key")).select("token", "key.*")


def near_words(tokens: DataFrame, words: DataFrame, k: int = EDITS) -> DataFrame:
    """(token, word, edits) of all pairs within ``k`` edits; both sides distinct, longer than k."""
    keys = small_side(_keys_of_words(words.filter(F.length("word") > k), k))
    pairs = _keys_of_tokens(tokens.filter(F.length("token") > k), k).join(keys, ["n", "i", "seg"]).select("token", "word")
    edits = F.levenshtein(F.col("token"), F.col("word"), k)
    return pairs.withColumn("edits", edits).filter("edits >= 0").distinct()


def _near(tokens: DataFrame, words: DataFrame) -> DataFrame:
    """``near_words`` with as many edits as a token of its length may have."""
    n = F.length("token")
    same = tokens.filter(n < ONE_EDIT).join(small_side(words.filter(F.length("word") < ONE_EDIT)), F.col("token") == F.col("word")).select("token", "word", F.lit(0).alias("edits"))
    return near_words(tokens.filter(n >= SHORTEST), words).union(near_words(tokens.filter((n >= ONE_EDIT) & (n < SHORTEST)), words, 1)).union(same)


def map_names(names: DataFrame, taxa: DataFrame) -> DataFrame:
    """(name, taxon_id, score) of each distinct ``name``; taxon_id 0 and score 0 if no entry is meant.

    Very long names are taken whole. An empty reference list maps all to 0.
    """
    tables = SharedTables(names.sparkSession, "canonical")
    taxa = taxa.select("taxon_id", folded(F.trim("genus")).alias("g"), folded(F.trim("epithet")).alias("e"), "genus", "epithet")
    vocab = tables.save(vocabulary(taxa.select("genus", "epithet")), "vocabulary")
    # a hyphen before a line end divides a word; other signs divide tokens
    text = F.regexp_replace("name", r"(\p{L})[-\u2010\u2011¬]\s*[\r\n]+\s*(?=\p{Ll})", "$1")
    raw = F.filter(F.split(text, r"[^\p{L}\p{M}\p{N}]+"), lambda t: t != "")
    toks = F.transform("raw", lambda t: F.struct(folded(t).alias("t"), t.rlike(r"^\p{Lu}\P{Lu}*$").alias("cap")))
    d = names.select("name").distinct().select("name", raw.alias("raw")).select("name", toks.alias("toks"))
    d = tables.save(d, "names")
    size = F.size("toks")
    pairs = F.when(size > 1, F.transform(F.sequence(F.lit(0), size - 2), lambda i: F.struct(i.alias("at"), F.lit(2).alias("span"), F.concat(F.get("toks", i)["t"], F.get("toks", i + 1)["t"]).alias("token"))))
    ones = F.transform("toks", lambda x, i: F.struct(i.alias("at"), F.lit(1).alias("span"), x["t"].alias("token")))
    spans = d.select("name", F.explode(F.concat(ones, F.coalesce(pairs, F.array_except(ones, ones)))).alias("s")).select("name", "s.*")
    spans = spans.filter((F.col("span") == 1) | (F.length("token") >= SHORTEST))
    # a token makes some dozens of keys: few rows, much work for each
    tokens = tables.save(wide(spans.select("token").distinct(), "token"), "tokens")
    hits = _near(tokens, vocab.select("word").distinct())
    hits = tables.save(hits.join(small_side(vocab), "word").select("token", "word", "part", "idf", "edits"), "hits").hint("merge")
    sim = 1 - F.col("edits") / F.length("word")
    found = spans.join(hits, "token").select("name", "at", "span", "word", "part", "idf", sim.alias("sim"))
    # of each word, its best place in the name
    found = found.groupBy("name", "word", "part").agg(F.max(F.struct("sim", (-F.col("span")).alias("s"), (-F.col("at")).alias("a"), "idf")).alias("m")).select("name", "word", "part", "m.sim", "m.idf", (-F.col("m.a")).alias("at"), (-F.col("m.s")).alias("span"))
    # what grows with the names is joined by shuffles at any size; only the reference side is broadcast, if it is small
    found, d = tables.save(found, "found").hint("merge"), d.hint("merge")
    part = lambda p: found.filter(F.col("part") == p)
    species = small_side(taxa.filter("e IS NOT NULL AND e <> ''").select("taxon_id", "g", "e", F.concat("g", "e").alias("j")))
    genera = part("genus").select("name", F.col("word").alias("g"), F.col("sim").alias("sim_g"), F.col("idf").alias("idf_g"))
    short = F.col("toks")
    by_epithet = (
        part("epithet")
        .withColumnRenamed("word", "e")
        .join(species, "e")
        .join(genera, ["name", "g"], "left")
        .join(d, "name")
        .withColumn(
            "abbreviated",
            # the epithet's own token stands for no genus
            F.array_max(F.transform(F.filter(short, lambda t, i: ((i < F.col("at")) | (i >= F.col("at") + F.col("span"))) & (F.length(t["t"]) <= ABBREVIATION) & (F.length(t["t"]) >= 1) & F.startswith("g", t["t"])), lambda t: F.length(t["t"]))),
        )
        .filter("sim_g IS NOT NULL OR abbreviated IS NOT NULL")
    )
    full_g = F.coalesce(F.col("sim_g"), 0.5 + 0.05 * F.col("abbreviated"))
    weight_g = F.coalesce(F.col("idf_g"), F.lit(1.0))
    # soft TF-IDF: similarities of the paired tokens by the weights of both sides, over the entry's norm
    by_epithet = by_epithet.select("name", "taxon_id", ((F.col("sim") * F.col("idf") ** 2 + full_g * weight_g**2) / (F.col("idf") ** 2 + weight_g**2)).alias("score"))
    by_both = part("joined").withColumnRenamed("word", "j").join(species, "j").select("name", "taxon_id", F.col("sim").alias("score"))
    best = by_epithet.union(by_both).groupBy("name").agg(F.max(F.struct("score", (-F.col("taxon_id")).alias("t"))).alias("m")).select("name", (-F.col("m.t")).alias("taxon_id"), "m.score")
    # a genus alone: no other token that looks like an epithet
    rest = F.filter(
        "toks",
        lambda t, i: (F.length(t["t"]) >= EPITHET) & t["t"].rlike(r"^\p{L}+$") & ~t["t"].isin(*REMARKS) & ~((i >= F.col("at")) & (i < F.col("at") + F.col("span"))) & (~t["cap"] | (i < F.col("at"))),
    )
    alone = (
        part("genus")
        .join(d, "name")
        .filter(F.size(rest) == 0)
        .withColumnRenamed("word", "g")
        .join(small_side(taxa.filter("e IS NULL OR e = ''").select("taxon_id", "g")), "g")
        .groupBy("name")
        .agg(F.max(F.struct(F.col("sim").alias("score"), (-F.col("taxon_id")).alias("t"))).alias("m"))
        .select("name", (-F.col("m.t")).alias("genus_id"), F.col("m.score").alias("genus_score"))
    )
    return (
        d.select("name")
        .join(best, "name", "left")
        .join(alone, "name", "left")
        .select("name", F.coalesce("taxon_id", "genus_id", F.lit(0)).cast("int").alias("taxon_id"), F.coalesce("score", "genus_score", F.lit(0.0)).alias("score"))
    )


def canonical(records: DataFrame, taxa: DataFrame) -> DataFrame:
    """(rec_id, name, taxon_id, score) of each record whose name is not blank and not an entry as it stands.

    Rows of a null or blank name give none; repeated rows give one each.
    """
    cases = named(records).join(small_side(taxa.select("name").filter("name IS NOT NULL").distinct()), "name", "left_anti")
    return cases.join(map_names(cases, taxa), "name").select("rec_id", "name", "taxon_id", "score")


def unmatched(mapped: DataFrame) -> DataFrame:
    """(name, records): the names that mean no entry, with how many records have them."""
    return mapped.filter("taxon_id = 0").groupBy("name").agg(F.count("*").alias("records"))

