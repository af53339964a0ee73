"""References to records that do not exist, kept as incremental state.

References and parents' versions arrive in batches by time. A batch

* probes the parent index with its references, at the instant of each one;
* lets arriving parents resolve the references that wait for them;
* adds what it brought to the state, which it doesn't rewrite.

The state is the parent index, one row per key (``first_loaded``;
``alive_until``, the largest end among the versions loaded so far), and the
waiting references. Both are kept as runs: a batch writes a run of its own
arrivals, and runs of like age are merged FAN by FAN, so that a row is written
again as often as the logarithm of the batches, and old runs are dropped. A
reference waits until the first version of its key arrives, so each is resolved
by one batch at most; merging leaves the resolved ones out.

The probe is a running maximum in two steps over distinct (key, instant) pairs:
(key, minute) groups are aggregated and scanned per key, then instants within
their minute. A key that holds a third of all rows is spread over its minutes,
and any number of its rows at one instant are one pair; the references then meet
the pairs in a join, in which a hot side can be divided.

``history`` counts the open references at the end of each calendar period from
opening and closing events per key, so deletions reopen them, and its grid
doesn't depend on the batches.

A version is alive from ``loaded_at`` (included) to ``deleted_at`` (excluded); a
null ``deleted_at`` is never. A version with a null ``loaded_at`` is there from
no known time on: it makes references to it ``late``. A reference with a null
time is judged after all batches.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from taxaflow.runtime import SharedTables, has_rows

FOREVER, NEVER = "9999-12-31 00:00:00", "0001-01-01 00:00:00"
#: Runs of like age that are merged into one.
FAN = 4
#: More periods with arrivals are gathered in batches of several, which doesn't change the orphans.
MOST = 64
REFS = "edge_id long, endpoint string, key string, t timestamp_ntz"
KEYS = "key string, first_loaded timestamp_ntz, alive_until timestamp_ntz"
FACTS = REFS + ", kind string"


def references(edges: DataFrame) -> DataFrame:
    """(edge_id, endpoint, key, t): both ids of each edge, without null and blank ones."""
    ends = F.array(
        F.struct(F.lit("start").alias("endpoint"), F.col("start_node_id").alias("key")),
        F.struct(F.lit("end").alias("endpoint"), F.col("end_node_id").alias("key")),
    )
    return (
        edges.select(F.col("edge_id").cast("long"), F.explode(ends).alias("e"), F.col("loaded_at").cast("timestamp_ntz").alias("t"))
        .select("edge_id", "e.endpoint", "e.key", "t")
        .filter(F.col("key").rlike(r"\S"))
    )


def versions(*tables: DataFrame) -> DataFrame:
    """(key, loaded_at, deleted_at) of all rows of the parent tables with a non-null id."""
    out = None
    for t in tables:
        v = t.filter("id IS NOT NULL").select(
            F.col("id").alias("key"), *(F.col(c).cast("timestamp_ntz").alias(c) for c in ("loaded_at", "deleted_at"))
        )
        out = v if out is None else out.union(v)
    return out


def _month(c: Column) -> Column:
    return F.year(c) * 12 + F.month(c) - 1


def _stamp(v) -> Column:
    return F.lit(v).cast("timestamp_ntz")


def _end(c: Column) -> Column:
    return F.coalesce(c, _stamp(FOREVER))


class Runs:
    """A table kept as runs in the shared folder: adding one writes its rows only, and FAN of a rank are merged into one of the next."""

    def __init__(self, tables: SharedTables, name: str, schema: str, merge):
        self.tables, self.name, self.merge, self.n = tables, name, merge, 0
        self.empty = tables.spark.createDataFrame([], T._parse_datatype_string(schema))
        self.ranks: list[list[tuple[str, DataFrame]]] = []

    def save(self, df: DataFrame) -> tuple[str, DataFrame]:
        self.n += 1
        name = f"{self.name}{self.n}"
        return name, self.tables.save(df, name)

    def add(self, df: DataFrame, name: str = "") -> None:
        """Adds a run that is written already: as the table ``name``, or, without one, as a part of tables that stay."""
        run, rank = (name, df), 0
        while True:
            if rank == len(self.ranks):
                self.ranks.append([])
            self.ranks[rank].append(run)
            if len(self.ranks[rank]) < FAN:
                return
            old, self.ranks[rank] = self.ranks[rank], []
            run = self.save(self.merge(_union([d for _, d in old])))
            for name in [n for n, _ in old if n]:
                self.tables.drop(name)
            rank += 1

    def all(self) -> DataFrame:
        """The rows of all runs; a key may stand in several."""
        runs = [d for rank in self.ranks for _, d in rank]
        return _union(runs) if runs else self.empty


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def _of_key(rows: DataFrame) -> DataFrame:
    return rows.groupBy("key").agg(F.min("first_loaded").alias("first_loaded"), F.max("alive_until").alias("alive_until"))


class OrphanState:
    """The state between batches, as tables in the shared folder."""

    def __init__(self, spark: SparkSession):
        self.spark, self.n = spark, 0
        self.tables = SharedTables(spark, "orphans")
        self.keys = Runs(self.tables, "keys", KEYS, _of_key)
        self.waiting = Runs(self.tables, "waiting", REFS, self._still)
        self.facts: list[DataFrame] = []

    def _still(self, waiting: DataFrame) -> DataFrame:
        """The waiting references whose key hasn't arrived."""
        return waiting.join(self.keys.all().select("key"), "key", "left_anti").select(*waiting.columns)

    def _probe(self, refs: DataFrame, parents: DataFrame, known: DataFrame) -> DataFrame:
        """Adds ``until``: the largest end among the versions loaded up to the reference, null if there are none."""
        refs = refs.withColumn("at", _end(F.col("t")))
        events = (
            refs.select("key", "at", F.lit(None).cast("timestamp_ntz").alias("until"), F.lit(True).alias("asked"))
            .union(parents.select("key", "loaded_at", _end(F.col("deleted_at")), F.lit(False)))
            # what the index knows stands before all minutes of the batch
            .union(known.select("key", _stamp(NEVER), "alive_until", F.lit(False)))
        )
        instants = events.groupBy("key", "at").agg(F.max("until").alias("until"), F.max("asked").alias("asked"))
        instants = instants.withColumns({"day": F.col("at").cast("date"), "minute": F.hour("at") * 60 + F.minute("at")})
        slot = ["key", "day", "minute"]
        minutes = instants.groupBy(*slot).agg(F.max("until").alias("of_minute"))
        before = F.max("of_minute").over(W.partitionBy("key").orderBy("day", "minute").rowsBetween(W.unboundedPreceding, -1))
        minutes = minutes.select(*slot, before.alias("before"))
        running = F.max("until").over(W.partitionBy(*slot).orderBy("at").rowsBetween(W.unboundedPreceding, 0))
        asked = instants.withColumn("running", running).filter("asked").join(minutes, slot).select("key", "at", F.greatest("running", "before").alias("until"))
        return refs.join(asked, ["key", "at"]).select("edge_id", "endpoint", "key", "t", "until")

    def step(self, refs: DataFrame, parents: DataFrame) -> None:
        """Takes the references and versions that arrived since the last batch."""
        arrived = parents.select("key", F.col("loaded_at").alias("first_loaded"), _end(F.col("deleted_at")).alias("alive_until"))
        name, arrived = self.keys.save(_of_key(arrived))
        touched = refs.select("key").union(parents.select("key")).distinct()
        known = _of_key(self.keys.all().join(touched, "key", "left_semi"))
        probed = self.tables.save(self._probe(refs, parents, known), f"probed{self.n}")
        # t null: after all batches, when only versions without an end are alive
        at = F.coalesce("t", _stamp("9998-12-31 00:00:00"))
        self.facts.append(probed.filter(F.col("until") <= at).select("edge_id", "endpoint", "key", "t", F.lit("deleted").alias("kind")))
        waiting = probed.filter("until IS NULL").select("edge_id", "endpoint", "key", "t")
        # keys that arrive for the first time resolve what waits for them, also from this batch
        fresh = arrived.join(self.keys.all().select("key"), "key", "left_anti").select("key")
        waits = self.waiting.all().union(waiting)
        self.facts.append(self.tables.save(waits.join(fresh, "key", "left_semi").select("edge_id", "endpoint", "key", "t", F.lit("late").alias("kind")), f"late{self.n}"))
        self.keys.add(arrived, name)
        self.waiting.add(waiting)
        self.n += 1

    def orphans(self) -> DataFrame:
        """All orphans so far (columns of FACTS); what still waits is ``missing``."""
        missing = self._still(self.waiting.all()).select("edge_id", "endpoint", "key", "t", F.lit("missing").alias("kind"))
        return _union([missing, *self.facts])


def batches(refs: DataFrame, parents: DataFrame, months: int) -> tuple[int, int, list[int]]:
    """(first month, months of a batch, numbers of the batches with arrivals).

    If periods of ``months`` make more than MOST batches, as stray dates can,
    batches are made longer while there are too many.
    """
    at = refs.select(_month(F.col("t")).alias("m")).union(parents.select(_month(F.col("loaded_at")))).filter("m IS NOT NULL")
    met = sorted(r[0] for r in at.distinct().collect())  # a month each, of the 120,000 that dates can name
    if not met:
        return 0, months, []
    while len(numbers := sorted({(m - met[0]) // months for m in met})) > MOST:
        months *= 2
    return met[0], months, numbers


def track(refs: DataFrame, parents: DataFrame, months: int = 12) -> OrphanState:
    """Runs all of ``refs`` and ``parents`` through the state, in batches of ``months`` months."""
    state = OrphanState(refs.sparkSession)
    first, months, numbers = batches(refs, parents, months)
    if numbers:
        # each batch is then read alone, instead of the whole table for every batch
        number = lambda c: F.floor((_month(F.col(c)) - first) / months).cast("int")
        r = state.tables.save(refs.filter("t IS NOT NULL").withColumn("batch", number("t")), "refs", "batch")
        p = state.tables.save(parents.filter("loaded_at IS NOT NULL").withColumn("batch", number("loaded_at")), "parents", "batch")
        for i in numbers:
            state.step(r.filter(F.col("batch") == i).drop("batch"), p.filter(F.col("batch") == i).drop("batch"))
    undated_refs, undated = refs.filter("t IS NULL"), parents.filter("loaded_at IS NULL")
    if has_rows(undated_refs):
        state.step(undated_refs, parents.limit(0))
    if has_rows(undated):
        state.step(refs.limit(0), undated.withColumn("loaded_at", _stamp(FOREVER)))
    return state


def history(refs: DataFrame, parents: DataFrame, months: int = 6) -> DataFrame:
    """(snapshot_at, endpoint, state, open_refs): references open at the end of each period of ``months`` months, from the first to the last arrival.

    A reference counts from the period it was loaded in; it is open while no
    version of its key was loaded (``missing``), or all versions loaded so far
    have ended (``deleted``). Undated references and versions don't count.
    Periods with nothing open have no row. Each (key, column) is brought down to
    one row per period in which something changes, however many rows it has.
    """
    refs, parents = refs.filter("t IS NOT NULL"), parents.filter("loaded_at IS NOT NULL")
    span = refs.select(_month(F.col("t")).alias("m")).union(parents.select(_month(F.col("loaded_at")))).agg(F.min("m").alias("lo"), F.max("m").alias("hi")).collect()[0]
    if span["lo"] is None:
        return refs.sparkSession.createDataFrame([], "snapshot_at timestamp_ntz, endpoint string, state string, open_refs long")
    lo, last = span["lo"], (span["hi"] - span["lo"]) // months
    # the period in whose end the time has passed: an end at the very start of a period has passed with the one before
    period = lambda c: F.floor((_month(c) - lo) / months).cast("int")
    inside = (_month(F.col("until")) - lo) % months + F.when(F.col("until") == F.col("until").cast("date").cast("timestamp_ntz"), F.dayofmonth("until") - 1).otherwise(1) > 0
    passed = F.when(inside, period(F.col("until"))).otherwise(period(F.col("until")) - 1)
    loads = parents.groupBy("key", period(F.col("loaded_at")).alias("p")).agg(F.max(_end(F.col("deleted_at"))).alias("until"))
    by_key = W.partitionBy("key").orderBy("p")
    steps = loads.select("key", "p", F.max("until").over(by_key).alias("until"), F.lead("p", 1, last + 1).over(by_key).alias("next"), F.row_number().over(by_key).alias("n"))
    opened = steps.select("key", F.greatest(F.col("p"), passed).alias("from"), F.col("next").alias("to"), F.lit("deleted").alias("state"))
    missing = steps.filter("n = 1").select("key", F.lit(0).alias("from"), F.col("p").alias("to"), F.lit("missing").alias("state"))
    spells = opened.union(missing).filter("from < to")  # of a key that has versions
    loaded = refs.groupBy("key", "endpoint", period(F.col("t")).alias("p")).agg(F.count("*").alias("n"))
    never = loaded.join(parents.select("key").distinct(), "key", "left_anti").select("endpoint", F.lit("missing").alias("state"), "p", F.col("n").alias("d"))
    # references of a period before the spell are open from its beginning on, those within it from their own
    within = loaded.join(spells, "key").filter(F.col("p") < F.col("to"))
    ends = F.array(F.struct(F.greatest("p", "from").alias("p"), F.col("n").alias("d")), F.struct(F.col("to").alias("p"), (-F.col("n")).alias("d")))
    deltas = never.union(within.select("endpoint", "state", F.explode(ends).alias("e")).select("endpoint", "state", "e.p", "e.d"))
    deltas = deltas.groupBy("endpoint", "state", "p").agg(F.sum("d").alias("d"))
    grid = deltas.select("endpoint", "state").distinct().select("endpoint", "state", F.explode(F.sequence(F.lit(0), F.lit(last))).alias("p"))
    total = F.sum(F.coalesce("d", F.lit(0))).over(W.partitionBy("endpoint", "state").orderBy("p"))
    counts = grid.join(deltas, ["endpoint", "state", "p"], "left").select("endpoint", "state", "p", total.alias("open_refs")).filter("open_refs > 0")
    month = F.lit(lo) + (F.col("p") + 1) * months
    ended = F.when(month < 120_000, F.make_date((month / 12).cast("int"), month % 12 + 1, F.lit(1))).otherwise(F.lit("9999-12-31").cast("date"))
    return counts.select(ended.cast("timestamp_ntz").alias("snapshot_at"), "endpoint", "state", "open_refs")


def report(orphans: DataFrame) -> DataFrame:
    """(endpoint, load_month, kind, orphans): counts per referring column and month."""
    return (
        orphans.groupBy("endpoint", F.date_format("t", "yyyy-MM").alias("load_month"), "kind").agg(F.count("*").alias("orphans"))
    )
