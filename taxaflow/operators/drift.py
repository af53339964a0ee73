"""Schemas that drift between files: every change of shape, and one consistent table.

Shapes (paths with the JSON types met there) are gathered per file with partial
aggregation. Each file is set against the one before it in its series. Which
field became which is found by similarity flooding: the two schema graphs
(nesting edges, names and types as start values) give pairs of paths, whose
scores flow along equal edges until they no longer change. Pairs of a gone and a
new path under the same parent are then checked exactly: the values of all ids
that have both must be equal. Only those paths' values are read, in a second
pass over the files concerned. Where no id has both, the scores alone decide:
each path must be the other's best partner in the whole of the other schema. The
scores also choose among pairs that qualify, so that each path is used once.

Records are never grouped by file: only shapes (as many rows as a schema has
paths) and checked values (joined on the id) are.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from taxaflow.runtime import SharedTables

KINDS = ("string", "number", "boolean", "object", "array")
BITS = {k: 1 << i for i, k in enumerate(KINDS)}
#: A schema has at most so many fields; beyond that, keys are data and the schema is refused, not cut.
MOST_FIELDS = 20_000
#: The least score of a pair of paths that is matched without values to confirm it (the largest score of two schemas is 1).
MATCHED = 0.3


def _kind(v) -> int:
    if isinstance(v, str):
        return BITS["string"]
    if isinstance(v, bool):
        return BITS["boolean"]
    if isinstance(v, (int, float)):
        return BITS["number"]
    return BITS["object"] if isinstance(v, dict) else BITS["array"]


def readable(line: str | None) -> dict | None:
    """The record of a line; None for a line that is blank, cut, or no JSON object."""
    if not line or not line.strip():
        return None
    try:
        v = json.loads(line)
    except (ValueError, RecursionError):
        return None
    return v if isinstance(v, dict) else None


def shape(v, path: str, out: dict[str, int]) -> None:
    """Adds the types of each path of ``v`` that holds a non-null value."""
    todo = [(v, path)]
    while todo:
        v, path = todo.pop()
        if v is None:
            continue
        if path:
            out[path] = out.get(path, 0) | _kind(v)
        if isinstance(v, dict):
            todo += [(x, f"{path}.{k}" if path else k) for k, x in v.items()]
        elif isinstance(v, list):
            todo += [(x, f"{path}[]") for x in v]


def _plain(v):
    if isinstance(v, bool) or v is None or isinstance(v, str):
        return v
    if isinstance(v, (int, float)):
        return float(v) if abs(v) < 1e300 else str(v)
    if isinstance(v, dict):
        return {k: _plain(x) for k, x in v.items()}
    return [_plain(x) for x in v]


def value_at(record: dict, path: str):
    """The value at a path; for a path through arrays, the values of all elements in order."""
    at = [record]
    for step in path.replace("[]", "\0[]").replace(".", "\0").split("\0"):
        if step == "[]":
            at = [x for v in at if isinstance(v, list) for x in v]
        else:
            at = [v[step] for v in at if isinstance(v, dict) and step in v]
    at = [v for v in at if v is not None]
    return at or None


def _hash(v) -> int:
    text = json.dumps(_plain(v), sort_keys=True, ensure_ascii=False)
    return int.from_bytes(hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=8).digest(), "little", signed=True)


def parent(path: str) -> str:
    return path[:-2] if path.endswith("[]") else path.rpartition(".")[0]


def shapes(raw: DataFrame) -> DataFrame:
    """(series, file_seq, file_name, path, types): types is a bit set in the order of KINDS."""

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            files: dict[tuple, dict[str, int]] = {}
            for key, line in zip(zip(b["series"], b["file_seq"], b["file_name"], strict=True), b["record_json"], strict=True):
                if (v := readable(line)) is not None:
                    shape(v, "", files.setdefault(key, {}))
            rows = [(*key, p, t) for key, paths in files.items() for p, t in paths.items()]
            yield pd.DataFrame(rows, columns=["series", "file_seq", "file_name", "path", "types"]).astype({"file_seq": "Int64"})

    parts = raw.select("series", "file_seq", "file_name", "record_json").mapInPandas(
        gather, "series string, file_seq long, file_name string, path string, types long"
    )
    return parts.groupBy("series", "file_seq", "file_name", "path").agg(F.bit_or("types").alias("types"))


def _bigrams(s: str) -> set[str]:
    s = f"^{s.lower().replace('_', '')}$"
    return {s[i : i + 2] for i in range(len(s) - 1)}


def flood(old: dict[str, int], new: dict[str, int], eps: float = 1e-4, most: int = 200) -> pd.DataFrame:
    """Similarity flooding of two schema graphs: a score for each (old, new) pair of paths.

    Start values compare names (bigrams) and types; in each step a pair gets,
    beside its start value, the scores of its parents' pair and of its
    children's pairs, each shared out over as many; scores are divided by the
    largest, until none moves by more than ``eps``.
    """
    a, b = sorted(old), sorted(new)
    if not a or not b:
        return pd.DataFrame(0.0, index=a, columns=b)
    ga, gb = [_bigrams(p.rpartition(".")[2]) for p in a], [_bigrams(p.rpartition(".")[2]) for p in b]
    start = np.array(
        [
            [0.6 * 2 * len(x & y) / (len(x) + len(y)) + 0.4 * (bin(old[p] & new[q]).count("1") / bin(old[p] | new[q]).count("1")) for q, y in zip(b, gb, strict=True)]
            for p, x in zip(a, ga, strict=True)
        ]
    )

    def up(paths: list[str]) -> np.ndarray:
        at = {p: i + 1 for i, p in enumerate(paths)}
        m = np.zeros((len(paths), len(paths) + 1))
        for i, p in enumerate(paths):
            m[i, at.get(parent(p), 0)] = 1
        return m

    ua, ub = up(a), up(b)
    na, nb = ua.sum(0), ub.sum(0)
    share = 1 / np.maximum(np.outer(na, nb), 1)
    s = start.copy()
    for _ in range(most):
        wide = np.zeros((len(a) + 1, len(b) + 1))
        wide[1:, 1:] = s
        wide[0, 0] = 1  # the two records themselves
        down = ua @ (wide * share) @ ub.T
        back = (ua.T @ s @ ub)[1:, 1:] * share[1:, 1:]
        t = start + s + down + back
        t /= t.max() or 1
        moved, s = np.abs(t - s).max(), t
        if moved < eps:
            break
    return pd.DataFrame(s, index=a, columns=b)


def compare(old: dict[str, int], new: dict[str, int]) -> tuple[list[tuple], list[tuple]]:
    """(changes that are certain, candidates for a renaming): (old path, new path, kind) and (old path, new path, score, matched).

    Two paths are matched if each is the other's best partner, the score is not
    under MATCHED, and their names have something in common.
    """
    if max(len(old), len(new)) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} paths in a file: keys seem to be data")
    kept = {p for p in old if p in new}
    retyped = {p for p in kept if old[p] != new[p]}

    def open_(p: str) -> bool:
        """Its parents are in both shapes, with the same types up to the top."""
        q = parent(p)
        while q:
            if q not in kept or q in retyped:
                return False
            q = parent(q)
        return True

    fixed = [(p, p, "retyped") for p in sorted(retyped) if open_(p)]
    gone = [p for p in sorted(old) if p not in new and not p.endswith("[]") and open_(p)]
    come = [p for p in sorted(new) if p not in old and not p.endswith("[]") and open_(p)]
    under: dict[str, list[str]] = {}
    for p in come:
        under.setdefault(parent(p), []).append(p)
    scores = flood(old, new) if any(parent(p) in under for p in gone) else None
    pairs = []
    if scores is not None:
        to_new, to_old = scores.max(axis=1), scores.max(axis=0)
        for p in gone:
            for q in under.get(parent(p), ()):
                x = float(scores.at[p, q])
                alike = not _bigrams(p.rpartition(".")[2]).isdisjoint(_bigrams(q.rpartition(".")[2]))
                pairs.append((p, q, x, alike and x >= MATCHED and x >= max(to_new[p], to_old[q])))
    return fixed + [(p, "", "removed") for p in gone] + [("", p, "added") for p in come], pairs


def _file() -> Column:
    """One key of a file: a name may be used again in another series."""
    return F.to_json(F.struct("series", "file_seq", "file_name")).alias("file")


def _pairs_of_files(raw: DataFrame, shaped: DataFrame) -> DataFrame:
    """(file, old_file, new_shape, old_shape) of each file that has one before it in its series."""
    files = raw.select("series", "file_seq", "file_name").distinct()
    whole = shaped.groupBy(_file()).agg(F.collect_list(F.struct("path", "types")).alias("shape"))
    by_series = W.partitionBy("series").orderBy("file_seq", "file_name")
    order = files.select(_file(), F.lag(_file()).over(by_series).alias("old_file")).filter("old_file IS NOT NULL")
    return (
        order.join(whole, "file", "left")
        .withColumnRenamed("shape", "new_shape")
        .join(whole.select(F.col("file").alias("old_file"), F.col("shape").alias("old_shape")), "old_file", "left")
    )


def _compared(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    cols = ["file", "old_file", "old_path", "new_path", "change", "score", "matched"]
    for b in batches:
        rows = []
        for f, o, x, y in zip(b["file"], b["old_file"], b["old_shape"], b["new_shape"], strict=True):
            old = {} if x is None else {r["path"]: int(r["types"]) for r in x}
            new = {} if y is None else {r["path"]: int(r["types"]) for r in y}
            fixed, pairs = compare(old, new)
            rows += [(f, o, p, q, c, None, False) for p, q, c in fixed] + [(f, o, p, q, "renamed", s, m) for p, q, s, m in pairs]
        yield pd.DataFrame(rows, columns=cols).astype({"score": "float64", "matched": "bool"})


def _wanted_values(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for b in batches:
        rows = []
        for line, n, wanted in zip(b["record_json"], b["line_no"], b["wanted"], strict=True):
            v = readable(line)
            if v is None or not isinstance(v.get("id"), str):
                continue
            for w in wanted:
                if (x := value_at(v, w["path"])) is not None:
                    rows.append((w["pair"], bool(w["is_old"]), w["path"], v["id"], n, _hash(x)))
        yield pd.DataFrame(rows, columns=["pair", "is_old", "path", "id", "line_no", "value"])


def changes_by_series(raw: DataFrame) -> DataFrame:
    """(f, old_path, new_path, change) of every file f (series, file_seq, file_name) against the one before it in its series.

    Unreadable lines are skipped; a file without readable lines has an empty
    shape. If an id stands in several lines of a file its last value counts.
    Values are equal if they are the same JSON, a null member being other than
    an absent one; numbers are compared by value. If several pairs qualify as
    renamings, those that values confirm come before those that scores alone
    matched, then larger scores, each path once.
    """
    tables = SharedTables(raw.sparkSession, "drift")
    raw = raw.select("series", F.col("file_seq").cast("long").alias("file_seq"), "file_name", F.col("line_no").cast("long").alias("line_no"), "record_json")
    raw = raw.withColumn("file", _file())
    found = tables.save(
        _pairs_of_files(raw, shapes(raw)).mapInPandas(
            _compared, "file string, old_file string, old_path string, new_path string, change string, score double, matched boolean"
        ),
        "compared",
    )
    pairs = found.filter("change = 'renamed'")
    one = lambda file, path, is_old: pairs.select(F.col(file).alias("file"), F.struct(F.col("file").alias("pair"), F.col(path).alias("path"), F.lit(is_old).alias("is_old")).alias("w"))
    wanted = one("old_file", "old_path", True).union(one("file", "new_path", False)).groupBy("file").agg(F.collect_set("w").alias("wanted"))
    values = (
        raw.join(wanted, "file")
        .select("record_json", "line_no", "wanted")
        .mapInPandas(_wanted_values, "pair string, is_old boolean, path string, id string, line_no long, value long")
        .groupBy("pair", "is_old", "path", "id")
        .agg(F.max_by("value", "line_no").alias("value"))
    )
    values = tables.save(values, "values")
    old = values.filter("is_old").select(F.col("pair").alias("file"), F.col("path").alias("old_path"), "id", F.col("value").alias("old_value"))
    new = values.filter("NOT is_old").select(F.col("pair").alias("file"), F.col("path").alias("new_path"), "id", F.col("value").alias("new_value"))
    compared = (
        pairs.select("file", "old_path", "new_path")
        .join(old, ["file", "old_path"])
        .join(new, ["file", "new_path", "id"])
        .groupBy("file", "old_path", "new_path")
        .agg(F.bool_and(F.col("old_value") == F.col("new_value")).alias("same"))
    )
    # no id with both values: the scores decide
    able = pairs.join(compared, ["file", "old_path", "new_path"], "left").filter(F.coalesce("same", "matched"))
    order = F.struct(F.col("same").isNull().alias("unconfirmed"), (-F.col("score")).alias("s"), "old_path", "new_path")
    taken = able.groupBy("file").agg(F.array_sort(F.collect_list(order)).alias("c"))

    def choose(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for f, c in zip(b["file"], b["c"], strict=True):
                seen: set[tuple] = set()
                for r in c:
                    o, n = r["old_path"], r["new_path"]
                    if not {(0, o), (1, n)} & seen:
                        seen |= {(0, o), (1, n)}
                        rows.append((f, o, n))
            yield pd.DataFrame(rows, columns=["file", "old_path", "new_path"])

    renamed = tables.save(taken.mapInPandas(choose, "file string, old_path string, new_path string"), "renamed")
    rest = found.filter("change <> 'renamed'")
    gone = rest.join(renamed.select("file", "old_path", F.lit("removed").alias("change")), ["file", "old_path", "change"], "left_anti")
    left = gone.join(renamed.select("file", "new_path", F.lit("added").alias("change")), ["file", "new_path", "change"], "left_anti")
    cols = ["old_path", "new_path", "change"]
    every = left.select("file", *cols).union(renamed.withColumn("change", F.lit("renamed")).select("file", *cols))
    return every.select(F.from_json("file", "series string, file_seq long, file_name string").alias("f"), *cols)


def changes(raw: DataFrame) -> DataFrame:
    """``changes_by_series`` as (file_name, old_path, new_path, change)."""
    return changes_by_series(raw).select("f.file_name", "old_path", "new_path", "change")


# --- the one consistent table ------------------------------------------------


LONG, DOUBLE, BOOLEAN = 1, 2, 4
TRUE, FALSE = {"true", "t", "yes", "y", "1"}, {"false", "f", "no", "n", "0"}
_NUMBER = re.compile(r"[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?", re.ASCII)


def _unmarked(path: str) -> str:
    """The path without marks of arrays: a field keeps its names whether it stands alone or in an array."""
    return path.replace("[]", "")


def _renamed(v: dict, path: str, names: dict[str, str]) -> Iterator[tuple[str, str, object]]:
    """(first name, path as it stands, value) of each field; a first name that the object has anew is not taken from it."""
    for k, x in v.items():
        p = f"{path}.{k}" if path else k
        name = names.get(p, k)
        yield (k if name != k and name in v else name), p, x


def _rewritten(v, path: str, names: dict[str, str]):
    """The value with its fields named as in the first file of the series that had them."""
    if isinstance(v, dict):
        return {name: _rewritten(x, p, names) for name, p, x in _renamed(v, path, names)}
    if isinstance(v, list):
        return [_rewritten(x, path, names) for x in v]
    return v


def _held(text: str):
    """The JSON object or array that a text holds, else None."""
    if text.lstrip()[:1] not in ("{", "["):
        return None
    try:
        return json.loads(text)
    except (ValueError, RecursionError):
        return None


def _number(text: str) -> int | float | None:
    t = text.strip()
    if not _NUMBER.fullmatch(t):
        return None
    if t.lstrip("+-").isdigit():
        return int(t) if len(t) < 400 else None
    return x if math.isfinite(x := float(t)) else None


def _fits(v) -> int:
    """Which types hold a single value without loss."""
    if isinstance(v, bool):
        return LONG | DOUBLE | BOOLEAN
    if isinstance(v, str):
        flag = BOOLEAN if v.strip().lower() in TRUE | FALSE else 0
        n = _number(v)
        return flag if n is None else flag | _fits(n) & ~BOOLEAN
    if isinstance(v, float):
        return DOUBLE | (BOOLEAN if v in (0, 1) else 0)
    return (LONG if -(2**63) <= v < 2**63 else 0) | (DOUBLE if abs(v) <= 2**53 else 0) | (BOOLEAN if v in (0, 1) else 0)


def _meet(v, path: tuple, at: str, depth: int, via: tuple | None, names: dict[str, str], out: dict[tuple, list[int]]) -> None:
    """Adds to out[path, via, plain] what stands at each path: [strings, numbers, booleans, objects, depth of arrays, types that fit].

    ``via`` is the path of the text that holds the value, if one does; a text
    that holds an object or array is not plain, and counts as text only where
    no object or array stands otherwise.
    """
    if v is None:
        return
    held = _held(v) if isinstance(v, str) else None
    f = out.setdefault((path, via, held is None), [0, 0, 0, 0, 0, LONG | DOUBLE | BOOLEAN])
    f[4] = max(f[4], depth)
    if isinstance(v, dict):
        f[3] += 1
        for name, p, x in _renamed(v, at, names):
            _meet(x, (*path, name), p, 0, via, names, out)
    elif isinstance(v, list):
        f[4] = max(f[4], depth + 1)
        for x in v:
            _meet(x, path, at, depth + 1, via, names, out)
    else:
        f[0 if isinstance(v, str) else 2 if isinstance(v, bool) else 1] += 1
        f[5] &= _fits(v)
    if held is not None:
        _meet(held, path, at, depth, path, names, out)


def _as_type(path: tuple, facts: dict[tuple, list], below: dict[tuple, list[tuple]]) -> T.DataType:
    votes, objects, depth, fits = facts[path]
    if objects and path in below:
        t = T.StructType(_fields(path, facts, below))
    else:
        kind = max(range(3), key=lambda i: (votes[i], (0, 2, 1)[i]))  # of equals a number, then a boolean
        t = T.StringType()
        if not objects and kind == 1 and fits & (LONG | DOUBLE):
            t = T.LongType() if fits & LONG else T.DoubleType()
        elif not objects and kind == 2 and fits & BOOLEAN:
            t = T.BooleanType()
        if not sum(votes):
            t = T.StringType()
    for _ in range(depth):
        t = T.ArrayType(t)
    return t


def _fields(path: tuple, facts: dict[tuple, list], below: dict[tuple, list[tuple]]) -> list[T.StructField]:
    return [T.StructField(p[-1], _as_type(p, facts, below)) for p in below.get(path, ())]


def schema_of(lines: DataFrame) -> T.StructType:
    """The schema of all records, of lines (series, file_seq, record_json, names): the union of their fields under their first names.

    A path with an object anywhere is a struct, one with an array anywhere an
    array, also where other files hold the same as text or as a single element.
    A single value has the type it had in the first file of its series that had
    it (of several series, what most have) if every value met can be cast to
    it, else it is a string. Names that differ in case only are one field, under
    the spelling that is last in byte order (lower case).
    Only one row per path comes to the driver.
    """
    cols = ["series", "file_seq", "path", "via", "plain", "strings", "numbers", "booleans", "objects", "depth", "fits"]

    def gather(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, str]] = {}
        for b in batches:
            files: dict[tuple, dict[tuple, list[int]]] = {}
            for key, line, names in zip(zip(b["series"], b["file_seq"], strict=True), b["record_json"], b["names"], strict=True):
                if (v := readable(line)) is not None:
                    _meet(v, (), "", 0, None, _names(known, names), files.setdefault(key, {}))
            rows = [
                (*key, json.dumps(path), None if via is None else json.dumps(via), plain, *f) for key, out in files.items() for (path, via, plain), f in out.items() if path
            ]
            yield pd.DataFrame(rows, columns=cols).astype({"file_seq": "Int64", "plain": "bool"})

    met = lines.select("series", "file_seq", "record_json", "names").mapInPandas(
        gather, "series string, file_seq long, path string, via string, plain boolean, strings long, numbers long, booleans long, objects long, depth int, fits int"
    )
    sums = [F.sum(c).alias(c) for c in ("strings", "numbers", "booleans", "objects")] + [F.max("depth").alias("depth"), F.bit_and("fits").alias("fits")]
    of_file = met.groupBy("series", "file_seq", "path", "via", "plain").agg(*sums)
    single = F.col("strings") + F.col("numbers") + F.col("booleans") > 0
    # greatest of structs: the kind that most values of the file have, of equals a number, then a boolean
    kind = F.greatest(*(F.struct(F.col(c).alias("n"), F.lit(o).alias("o"), F.lit(i).alias("i")) for c, o, i in (("strings", 0, 0), ("numbers", 2, 1), ("booleans", 1, 2))))["i"]
    first = F.min_by(F.when(single, kind), F.when(single, F.col("file_seq"))).alias("first")
    of_series = of_file.groupBy("series", "path", "via", "plain").agg(first, F.sum("objects").alias("objects"), F.max("depth").alias("depth"), F.bit_and("fits").alias("fits"))
    votes = [F.count_if(F.col("first") == i).alias(f"v{i}") for i in range(3)]
    rows = of_series.groupBy("path", "via", "plain").agg(*votes, F.sum("objects").alias("objects"), F.max("depth").alias("depth"), F.bit_and("fits").alias("fits")).limit(MOST_FIELDS + 1).collect()
    if len(rows) > MOST_FIELDS:
        raise ValueError(f"more than {MOST_FIELDS} fields: keys seem to be data")

    spelling: dict[tuple, str] = {}
    raw_rows = [(tuple(json.loads(r["path"])), None if r["via"] is None else tuple(json.loads(r["via"])), r) for r in rows]
    for path, _, _ in raw_rows:
        low = tuple(x.lower() for x in path)
        spelling[low] = max(spelling.get(low, ""), path[-1])
    holds: set[tuple] = set()
    facts: dict[tuple, list] = {}
    todo = sorted(((tuple(x.lower() for x in p), v and tuple(x.lower() for x in v), r) for p, v, r in raw_rows), key=lambda x: (len(x[0]), x[0]))
    for _ in range(len(todo) + 1):  # texts within texts: again until nothing more is found to hold objects
        more = {p for p, v, r in todo if (v is None or v in holds) and (v != p or p in holds) and (r["objects"] or r["depth"])} - holds
        holds |= more
        if not more:
            break
    for low, via, r in todo:
        if (via is not None and via not in holds) or (not r["plain"] and low in holds):
            continue
        f = facts.setdefault(low, [[0, 0, 0], 0, 0, LONG | DOUBLE | BOOLEAN])
        f[0] = [x + r[f"v{i}"] for i, x in enumerate(f[0])]
        f[1] += r["objects"]
        f[2] = max(f[2], r["depth"])
        f[3] &= r["fits"]
    named = {tuple(spelling[low[: i + 1]] for i in range(len(low))): f for low, f in facts.items()}
    below: dict[tuple, list[tuple]] = {}
    for p in sorted(named):
        below.setdefault(p[:-1], []).append(p)
    return T.StructType(_fields((), named, below) or [T.StructField("id", T.StringType())])


def _names(known: dict[str, dict[str, str]], names: str | None) -> dict[str, str]:
    if not names:
        return {}
    if names not in known:
        known[names] = json.loads(names)
    return known[names]


def _whole(v, t: T.DataType) -> int | None:
    n = _number(v) if isinstance(v, str) else v
    if isinstance(n, float):
        n = int(n) if n.is_integer() else None
    bits = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}[type(t)]
    return int(n) if n is not None and -(2**bits) <= n < 2**bits else None


def _fitted(v, t: T.DataType, path: str, names: dict[str, str]):
    """The value as the type wants it, under first names; None if it can't be cast."""
    if v is None:
        return None
    if isinstance(t, T.ArrayType):
        if isinstance(v, str):
            held = _held(v)
            v = [x.strip() for x in v.split(";") if x.strip()] if held is None else held
        if isinstance(v, list):
            out = [_fitted(x, t.elementType, path, names) for x in v]
            return out if not v or any(x is not None for x in out) or all(x is None for x in v) else None
        one = _fitted(v, t.elementType, path, names)
        return None if one is None else [one]
    if isinstance(t, T.StructType):
        v = _held(v) if isinstance(v, str) else v
        v = v[0] if isinstance(v, list) and len(v) == 1 else v
        if not isinstance(v, dict):
            return None
        exact, out = {f.name: f for f in t}, {}
        folded = {f.name.lower(): f for f in t}
        for name, p, x in sorted(_renamed(v, path, names), key=lambda r: r[0] not in exact):
            f = exact.get(name) or folded.get(name.lower())
            if f is not None and out.get(f.name) is None:
                out[f.name] = _fitted(x, f.dataType, p, names)
        return out
    if isinstance(t, T.StringType):
        return v if isinstance(v, str) else json.dumps(_rewritten(v, path, names), ensure_ascii=False)
    if isinstance(v, (dict, list)):
        return v if isinstance(t, (T.MapType, T.VariantType)) else None
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return _whole(v, t)
    if isinstance(t, (T.DoubleType, T.FloatType)):
        n = _number(v) if isinstance(v, str) else v
        return None if n is None or isinstance(n, int) and abs(n) >= 10**308 else float(n)
    if isinstance(t, T.BooleanType):
        if isinstance(v, str):
            return True if v.strip().lower() in TRUE else False if v.strip().lower() in FALSE else None
        return bool(v) if v in (0, 1) else None
    return v


def first_names(raw: DataFrame, change: DataFrame) -> DataFrame:
    """(series, file_seq, file_name, names): of each file after a renaming, which path had which name in its series' first file.

    The renamings of a series (one row each, not its records) are put in order
    and carried from file to file, their paths without marks of arrays.
    """
    files = raw.select("series", F.col("file_seq").cast("long").alias("file_seq"), "file_name").distinct()
    renamed = change.filter("change = 'renamed'").select("f.series", "f.file_seq", "f.file_name", "old_path", "new_path")
    per_file = renamed.groupBy("series", "file_seq", "file_name").agg(F.array_sort(F.collect_list(F.struct("old_path", "new_path"))).alias("r"))
    of_series = per_file.groupBy("series").agg(F.array_sort(F.collect_list(F.struct("file_seq", "file_name", "r"))).alias("steps"))

    def carry(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for s, steps in zip(b["series"], b["steps"], strict=True):
                names: dict[str, str] = {}
                for step in steps:
                    for r in step["r"]:
                        o, n = _unmarked(r["old_path"]), _unmarked(r["new_path"])
                        names[n] = names.pop(o, o.rpartition(".")[2])
                        for p in [p for p in names if p.startswith(o + ".")]:
                            names[n + p[len(o) :]] = names.pop(p)
                    rows.append((s, step["file_seq"], step["file_name"], json.dumps(names)))
            yield pd.DataFrame(rows, columns=["series", "file_seq", "file_name", "names"])

    steps = of_series.mapInPandas(carry, "series string, file_seq long, file_name string, names string")
    # each file has the names of the last step up to it
    upto = W.partitionBy("series").orderBy("file_seq", "file_name").rowsBetween(W.unboundedPreceding, 0)
    key = ["series", "file_seq", "file_name"]
    return files.join(steps, key, "left").select(*key, F.last("names", ignorenulls=True).over(upto).alias("names")).filter("names IS NOT NULL")


def unify(raw: DataFrame, change: DataFrame | None = None, schema: str | T.StructType | None = None) -> DataFrame:
    """One row per readable line: (raw_id, series, file_name, id, record, rest), record cast to ``schema``, by default ``schema_of`` all lines.

    ``change`` is ``changes_by_series`` of the same lines, if it is known already.

    Renamed fields get back the name they had in the first file of their series.
    Values are cast: numbers and booleans from text and back, objects and arrays
    from the JSON text that holds them, arrays from a single element or from a
    text with ``;`` between the elements. A value that can't be cast is null in
    ``record`` and kept in ``rest`` (the JSON text under first names, values as
    they came), where also fields outside the schema stay, and the second of two
    fields of an object whose names differ in case only.
    """
    tables = SharedTables(raw.sparkSession, "unify")
    names = tables.save(first_names(raw, changes_by_series(raw) if change is None else change), "names")
    lines = raw.select("raw_id", "series", F.col("file_seq").cast("long").alias("file_seq"), "file_name", "record_json").join(names, ["series", "file_seq", "file_name"], "left")
    t = schema_of(lines) if schema is None else schema if isinstance(schema, T.StructType) else T._parse_datatype_string(schema)

    def rewrite(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[str, dict[str, str]] = {}
        text = lambda x: json.dumps(x, ensure_ascii=False)
        for b in batches:
            out = []
            for rid, s, f, line, names in zip(b["raw_id"], b["series"], b["file_name"], b["record_json"], b["names"], strict=True):
                v = readable(line)
                if v is None:
                    continue
                n = _names(known, names)
                w = _rewritten(v, "", n)
                out.append((rid, s, f, w.get("id") if isinstance(w.get("id"), str) else None, text(_fitted(v, t, "", n)), text(w)))
            yield pd.DataFrame(out, columns=["raw_id", "series", "file_name", "id", "record", "rest"])

    rows = lines.select("raw_id", "series", "file_name", "record_json", "names").mapInPandas(rewrite, "raw_id long, series string, file_name string, id string, record string, rest string")
    return rows.select("raw_id", "series", "file_name", "id", F.from_json("record", t).alias("record"), "rest")
