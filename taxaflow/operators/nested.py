"""Deeply nested records as related flat tables, by Merkle identities of their objects.

Every object (a struct column, or a struct in an array, at any depth) is put
into a canonical text bottom-up: the names, types and values of its non-null
fields in the order of their names, and in place of each array of objects the
identities of that array's elements in order. The identity of an object is a
hash of that text. So equal objects have equal identities wherever they stand
and whatever else their schema allows, and are stored once. Each occurrence is
kept in a bridge row with the identity of its parent and its ordinals.
``flat_table`` gives the objects of one level as a table of typed columns, keyed
by the record and the ordinals, which are the keys of its parent and one more.

An object without a non-null value at any depth (null, ``{}``, an empty array,
arrays of nulls or of such objects) has no identity, and no rows; its place in
an array still counts. An empty string is a value. All of it is one narrow pass
of JVM expressions: no shuffle is needed for the bridge, and the object table
takes one aggregation on the identity.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from taxaflow.functions.columns import let


def _child_arrays(t: T.StructType, at: tuple = ()) -> list[tuple[tuple, T.StructType]]:
    """Paths of the arrays of structs reachable through structs alone."""
    out = []
    for f in t.fields:
        if isinstance(f.dataType, T.StructType):
            out += _child_arrays(f.dataType, (*at, f.name))
        elif isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType):
            out.append(((*at, f.name), f.dataType.elementType))
    return out


def _tag(t: T.DataType) -> str:
    """The type of a value in its canonical text: widths of numbers don't count."""
    if isinstance(t, T.IntegralType):
        return "int"
    return "float" if isinstance(t, (T.FractionalType, T.DecimalType)) else t.typeName()


def _canonical(c: Column, t: T.DataType, at: tuple = (), nodes: dict | None = None) -> Column:
    """Canonical text of a value, null if it holds no non-null value.

    ``nodes`` gives, by path, the identities of the elements of an array of objects.
    """
    if isinstance(t, T.StructType):
        if not t.fields:
            return F.lit(None).cast("string")
        parts = [_canonical(c.getField(f.name), f.dataType, (*at, f.name), nodes).alias(f"{f.name}:{_tag(f.dataType)}") for f in sorted(t.fields, key=lambda f: f.name)]
        return F.when(F.coalesce(*parts).isNotNull(), F.to_json(F.struct(*parts)))
    if isinstance(t, T.ArrayType):
        items = nodes[at] if nodes and at in nodes else F.transform(c, lambda x: _canonical(x, t.elementType))
        return F.when(F.exists(items, lambda x: x.isNotNull()), F.to_json(items))
    if isinstance(t, T.MapType):
        entry = T.StructType([T.StructField("key", t.keyType), T.StructField("value", t.valueType)])
        return F.when(F.size(c) > 0, F.to_json(F.array_sort(F.transform(F.map_entries(c), lambda e: _canonical(e, entry)))))
    if isinstance(t, T.VariantType):
        return F.to_json(c)
    return c.cast("string")


def _tree(c: Column, t: T.StructType) -> Column:
    """Struct (node, content, c0, c1 ...) of an object, with the trees of its child arrays."""
    arrays = _child_arrays(t)

    def build(kids: Column | None) -> Column:
        nodes = {p: F.transform(kids[f"c{i}"], lambda x: x["node"]) for i, (p, _) in enumerate(arrays)}
        return let(
            _canonical(c, t, (), nodes),
            lambda text: F.struct(
                F.substring(F.sha2(text, 256), 1, 32).alias("node"),
                text.alias("content"),
                *(kids[f"c{i}"].alias(f"c{i}") for i in range(len(arrays))),
            ),
        )

    if not arrays:
        return build(None)
    kids = []
    for i, (path, e) in enumerate(arrays):
        arr = c
        for name in path:
            arr = arr.getField(name)
        kids.append(F.transform(arr, _subtree(e)).alias(f"c{i}"))
    return let(F.struct(*kids), build)


def _subtree(e: T.StructType):
    return lambda x: _tree(x, e)


def _rows(name: str, tree: Column, t: T.StructType, parent: Column, ordinals: Column, labels: dict) -> Column:
    """Array of the bridge structs of an object and of all objects below it."""
    one = F.array(
        F.struct(
            F.lit(labels.get(name, name)).alias("child"),
            tree["node"].alias("node"),
            parent.alias("parent"),
            ordinals.alias("ordinals"),
            tree["content"].alias("content"),
        )
    )
    none = F.filter(one, lambda _: F.lit(False))
    below = []
    for i, (path, e) in enumerate(_child_arrays(t)):
        full = ".".join((name, *path)) + "[]"

        def step(x: Column, at: Column, full: str = full, e: T.StructType = e) -> Column:
            return _rows(full, x, e, tree["node"], F.concat(ordinals, F.array((at + 1).cast("int"))), labels)

        below.append(F.coalesce(F.flatten(F.transform(tree[f"c{i}"], _two(step))), none))
    return F.concat(one, *below)


def _two(f):
    return lambda x, i: f(x, i)


def _rows_of(name: str, t: T.StructType, labels: dict):
    return lambda tree: _rows(name, tree, t, F.lit(None).cast("string"), F.array().cast("array<int>"), labels)


def occurrences(df: DataFrame, key: str, columns: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Bridge rows (key, child, node, parent, ordinals, content) of all objects in ``columns``.

    ``child`` is the object's dotted path (``resolution.candidates[]``) or its
    label; ``node`` and ``parent`` are identities (``parent`` null at the top);
    ``ordinals`` are the positions, from 1, in the arrays on the way. Rows with
    a null key keep it. Other columns of ``df`` are not read.
    """
    parts = []
    for name in columns:
        t = df.schema[name].dataType
        if not isinstance(t, T.StructType):
            raise TypeError(f"{name} is {t.simpleString()}, not a struct")
        rows = _rows_of(name, t, labels or {})
        parts.append(let(_tree(F.col(f"`{name}`"), t), rows))
    out = df.select(F.col(f"`{key}`").alias("_key"), F.explode(F.concat(*parts)).alias("_o"))
    return out.select(F.col("_key").alias(key), "_o.*").filter("node IS NOT NULL")


def bridge(df: DataFrame, key: str, columns: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """The parent-child links: ``occurrences`` without content."""
    return occurrences(df, key, columns, labels).drop("content")


def objects(df: DataFrame, key: str, columns: list[str], labels: dict[str, str] | None = None) -> DataFrame:
    """Each distinct object once: node, content, the levels (``child``) and the number of places it stands in."""
    o = occurrences(df, key, columns, labels)
    return o.groupBy("node").agg(F.min("content").alias("content"), F.array_sort(F.collect_set("child")).alias("children"), F.count("*").alias("places"))


def _holds(c: Column, t: T.DataType) -> Column:
    """Whether a value holds a non-null value at any depth."""
    if isinstance(t, T.StructType):
        out = F.lit(False)
        for f in t.fields:
            out = out | _holds(c.getField(f.name), f.dataType)
        return out
    if isinstance(t, T.ArrayType):
        return F.coalesce(F.exists(c, lambda x: _holds(x, t.elementType)), F.lit(False))
    return F.coalesce(F.size(c) > 0, F.lit(False)) if isinstance(t, T.MapType) else c.isNotNull()


def _values(c: Column, t: T.StructType, at: str = "") -> list[tuple[str, Column]]:
    """(name, value) of the fields of an object but arrays of objects; names of objects within it go before those of their fields."""
    out = []
    for f in t.fields:
        name, v = f"{at}{f.name}", c.getField(f.name)
        if isinstance(f.dataType, T.StructType):
            out += _values(v, f.dataType, f"{name}_")
        elif not (isinstance(f.dataType, T.ArrayType) and isinstance(f.dataType.elementType, T.StructType)):
            out.append((name, v))
    return out


def flat_table(df: DataFrame, key: str, path: str, identities: bool = False) -> DataFrame:
    """The objects at ``path`` (``resolution.candidates[]``) as rows: key, one position per array on the way, typed fields.

    The positions are called ``<array>_pos`` and count from 1 over all elements.
    With ``identities`` come ``node`` and ``parent`` as in ``bridge``. A field
    whose name is taken gets ``_`` behind it. Objects that hold nothing have no
    row. One narrow pass; only the fields at the path and on the way are read.
    """
    first, *arrays = path.split("[]")[:-1] if path.endswith("[]") else [path]
    steps = first.split(".")
    name, inner = steps[0], steps[1:]
    out = df.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{name}`").alias("_c"), *([F.lit(None).cast("string").alias("_node")] if identities else []))
    t: T.DataType = df.schema[name].dataType
    keys, levels = [], [inner] + [a.lstrip(".").split(".") for a in arrays]
    for i, names in enumerate(levels):
        if i or inner:
            c, u = F.col("_c"), t
            for x in names:
                c, u = c.getField(x), u[x].dataType
            pos = f"{names[-1]}_pos"
            carried = [F.col("_key"), *(F.col(k) for k in keys)]
            if identities:
                out = out.withColumn("_node", let(_tree(F.col("_c"), t), lambda x: x["node"]))
                carried.append(F.col("_node"))
            if isinstance(u, T.ArrayType):
                out = out.select(*carried, F.posexplode(c).alias(pos, "_c")).withColumn(pos, F.col(pos) + 1)
                keys.append(pos)
                u = u.elementType
            else:
                out = out.select(*carried, c.alias("_c"))
            t = u
    taken, cols = {key, *keys, *(("node", "parent") if identities else ())}, []
    for n, v in _values(F.col("_c"), t):
        while n in taken:
            n += "_"
        taken.add(n)
        cols.append(v.alias(n))
    ids = [let(_tree(F.col("_c"), t), lambda x: x["node"]).alias("node"), F.col("_node").alias("parent")] if identities else []
    return out.filter(_holds(F.col("_c"), t)).select(F.col("_key").alias(key), *keys, *ids, *cols)
