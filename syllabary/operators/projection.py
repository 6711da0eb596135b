"""Projection with nested relations.

Rows and nested structs with to-many lists have a column ``part``, at every size: the lists of a row are the union of
those of its parts, from 0 on, each of at most about ``max_list`` elements. Part 0 is always there, and ``part = 0`` is each row
once. Parts repeat the row's own columns and hold disjoint elements, so no task has to hold an unbounded group and nothing is left out.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from syllabary.catalog import Relation
from syllabary.store import Store

MAX_LIST = 10_000
PART = "part"


@dataclass
class Projection:
    """Which columns and relations of an entity are put out."""

    everything: bool = False
    fields: set[str] = field(default_factory=set)
    relations: dict[str, "Projection"] = field(default_factory=dict)

    def child(self, name: str) -> "Projection":
        return self.relations.setdefault(name, Projection())


def projection(
    store: Store, entity: str, fields: Sequence[str] | None = None, include: Sequence[str] | None = None
) -> Projection:
    """The tree for ``fields`` (exact dot paths) or else all columns plus the ``include`` paths.

    ``fields`` overrides ``include``. A field path ending on a relation takes all its columns.
    """
    root = Projection()
    if not fields:
        root.everything = True
        for path in include or ():
            node, current = root, entity
            for name in path.split("."):
                current = store.catalog.relation(current, name).target
                node = node.child(name)
                node.everything = True
        return root
    for path in fields:
        node, current = root, entity
        *steps, last = path.split(".")
        for name in steps:
            current = store.catalog.relation(current, name).target
            node = node.child(name)
        if store.catalog.has_relation(current, last):
            node.child(last).everything = True
        elif last in store.columns(current):
            node.fields.add(last)
        else:
            raise ValueError(f"{current} has no field {last!r}")
    return root


def project(
    store: Store, df: DataFrame, entity: str, tree: Projection, keep: Sequence[str] = (),
    max_list: int = MAX_LIST, restrict: bool = True, by: Mapping[str, Column] | None = None,
) -> DataFrame:
    """Shape rows of an entity: own columns, then ``part`` if a relation is to-many, then one column per relation.

    ``keep`` names columns of ``df`` to carry along (sort keys, join keys). ``restrict`` reduces the
    links to those of the given rows first; switch it off when the rows are the whole table. ``by`` has the order in
    which the caller sorts the rows, by names out of ``keep``: their lists are then put together where the sort wants them.
    """
    own = store.columns(entity) if tree.everything else sorted(tree.fields)
    own = [c for c in own if c not in tree.relations]
    carried = [c for c in keep if c not in own]
    rels = {name: store.catalog.relation(entity, name) for name in tree.relations}
    needed = [r.near if r.link is None else "id" for r in rels.values()]
    base = df.select(*[F.col(c) for c in own], *[F.col(c) for c in carried], *[
        F.col(c).alias(f"_near_{c}") for c in sorted(set(needed))
    ])
    lists: dict[str, Links] = {}
    for name, rel in rels.items():
        near = f"_near_{rel.near if rel.link is None else 'id'}"
        if rel.many:
            keys = base.select(F.col(near).alias("_key")).distinct() if restrict else None
            lists[name] = _links(store, rel, tree.relations[name], near, keys, max_list, restrict)
    ones = [name for name, rel in rels.items() if not rel.many]
    if by and len({links.near for links in lists.values()}) == 1:
        # Rows are sent once, so what belongs to them alone joins first. A related row in parts would repeat them.
        narrow = [name for name in ones if PART not in _output_names(store, rels[name].target, tree.relations[name])]
        for name in narrow:
            base = _with_one(store, base, rels[name], tree.relations[name], name, max_list)
        base = _gathered(base, lists, by, max_list)
        ones = [name for name in ones if name not in narrow]
    elif lists:
        base = _with_lists(base, lists)
    for name in ones:
        base = _with_one(store, base, rels[name], tree.relations[name], name, max_list)
    part = [F.col("_slot").alias(PART)] if lists else []
    return base.select(*own, *carried, *part, *rels)


def include(
    store: Store, df: DataFrame, entity: str, paths: Sequence[str], max_list: int = MAX_LIST, restrict: bool = True
) -> DataFrame:
    return project(store, df, entity, projection(store, entity, include=paths), max_list=max_list, restrict=restrict)


def _with_one(
    store: Store, base: DataFrame, rel: Relation, tree: Projection, name: str, max_list: int
) -> DataFrame:
    shaped = project(store, store[rel.target], rel.target, tree, keep=[rel.far], max_list=max_list, restrict=False)
    names = _output_names(store, rel.target, tree)
    one = shaped.select(F.col(rel.far).alias("_far"), F.struct(*[F.col(c) for c in names]).alias(name))
    near = f"_near_{rel.near}"
    return base.join(one, F.col(near) == F.col("_far"), "left").drop("_far")


def _output_names(store: Store, entity: str, tree: Projection) -> list[str]:
    own = store.columns(entity) if tree.everything else sorted(tree.fields)
    part = [PART] if any(store.catalog.relation(entity, name).many for name in tree.relations) else []
    return [c for c in own if c not in tree.relations] + part + list(tree.relations)


@dataclass(frozen=True)
class Links:
    """A to-many relation of the rows at hand: ``near`` is their key column, ``rows`` has (parent key, part, child key), ``long`` the
    parents that need several parts, and ``shaped`` each child's key and value."""

    near: str
    rows: DataFrame
    long: DataFrame
    shaped: DataFrame


def _links(store: Store, rel: Relation, tree: Projection, near: str, keys: DataFrame | None, max_list: int, restrict: bool) -> Links:
    target = store[rel.target]
    if rel.link is None:
        pairs = target.select(F.col(rel.far).alias("_near"), F.col("id").alias("_far"))
    else:
        pairs = store[rel.link].select(F.col(rel.near).alias("_near"), F.col(rel.far).alias("_far")).distinct()
    # Rows that belong to nobody would all be gathered in the list of the missing key.
    pairs = pairs.where(F.col("_near").isNotNull() & F.col("_far").isNotNull())
    if keys is not None:
        pairs = pairs.join(keys, F.col("_near") == F.col("_key"), "left_semi")
        wanted = pairs.select(F.col("_far").alias("_key")).distinct()
        target = target.join(wanted, F.col("id") == F.col("_key"), "left_semi")
    # At most 1/max_list of the links can be such parents; usually there is none.
    long = (
        pairs.groupBy("_near")
        .agg(F.count(F.lit(1)).alias("_n"))
        .where(F.col("_n") > max_list)
        .select(F.col("_near").alias("_long"), F.ceil(F.col("_n") / F.lit(max_list)).cast("int").alias("_parts"))
    )
    child = project(store, target, rel.target, tree, keep=["id"], max_list=max_list, restrict=restrict)
    value = F.struct(*[F.col(c) for c in _output_names(store, rel.target, tree)])
    rows = (
        pairs.join(long, F.col("_near") == F.col("_long"), "left")
        .withColumn("_part", F.when(F.col("_parts").isNull(), 0).otherwise(_spread(F.col("_far"), F.col("_parts"))))
        .select("_near", "_part", "_far")
    )
    return Links(near, rows, long, child.select(F.col("id").alias("_id"), value.alias("_value")))


def _by_id(a: Column, b: Column) -> Column:
    return F.when(a["_id"] < b["_id"], -1).when(a["_id"] > b["_id"], 1).otherwise(0)


def _spread(key: Column, parts: Column) -> Column:
    return F.pmod(F.xxhash64(key), parts).cast("int")


def _slotted(base: DataFrame, lists: Mapping[str, Links]) -> DataFrame:
    """The rows once for each of their parts, numbered in ``_slot``."""
    parts = [F.lit(1)]
    for i, links in enumerate(lists.values()):
        long = links.long.select(F.col("_long").alias(f"_long{i}"), F.col("_parts").alias(f"_parts{i}"))
        base = base.join(long, F.col(links.near) == F.col(f"_long{i}"), "left")
        parts.append(F.coalesce(F.col(f"_parts{i}"), F.lit(1)))
    return base.withColumn("_slot", F.explode(F.sequence(F.lit(0), F.greatest(*parts, F.lit(1)) - 1)))


def _with_lists(base: DataFrame, lists: Mapping[str, Links]) -> DataFrame:
    base = _slotted(base, lists)
    for name, links in lists.items():
        rows = links.rows.join(links.shaped, F.col("_far") == F.col("_id"))
        sorted_list = F.array_sort(F.collect_list(F.struct("_id", "_value")), _by_id)
        grouped = rows.groupBy("_near", "_part").agg(F.transform(sorted_list, lambda x: x["_value"]).alias(name))
        side = grouped.select(F.col("_near").alias("_k"), F.col("_part").alias("_p"), F.col(name))
        base = base.join(side, (F.col(links.near) == F.col("_k")) & (F.col("_slot") == F.col("_p")), "left").drop("_k", "_p")
        base = base.withColumn(name, F.coalesce(F.col(name), F.array().cast(side.schema[name].dataType)))
    return base


def _gathered(base: DataFrame, lists: Mapping[str, Links], by: Mapping[str, Column], max_list: int) -> DataFrame:
    """`_with_lists` for rows that are sorted next: rows and related values are dealt by ranges of the order, each once, and meet there.

    The links take the sort columns from their rows while both are narrow, so links of other rows go before they get a value.
    """
    (near,) = {links.near for links in lists.values()}
    keys = list(dict.fromkeys([*by, near]))
    base = base.select(*keys, F.struct(F.lit(True).alias("_here"), *[F.col(c) for c in base.columns if c not in keys]).alias("_row"))
    # Rows that share a key share the lists. They meet in groups of about max_list; rows without a key have no list and stay alone.
    crowds = base.where(F.col(near).isNotNull()).groupBy(F.col(near).alias("_crowd")).agg(F.count(F.lit(1)).alias("_n"))
    crowds = crowds.where(F.col("_n") > max_list).select("_crowd", F.ceil(F.col("_n") / F.lit(max_list)).alias("_groups"))
    number = F.monotonically_increasing_id()
    group = F.when(F.col(near).isNull(), number).otherwise(F.coalesce(F.pmod(number, "_groups"), F.lit(0)))
    sent = _slotted(base, lists).join(crowds, F.col(near) == F.col("_crowd"), "left").select(*keys, "_slot", group.alias("_group"), "_row")
    ends = base.where(F.col(near).isNotNull()).select(*keys).distinct().join(crowds, F.col(near) == F.col("_crowd"), "left")
    ends = ends.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce("_groups", F.lit(1)) - 1)).alias("_group"))
    values = {}
    for name, links in lists.items():
        shaped, values[name] = _packed(links.shaped)
        rows = links.rows.join(ends, F.col("_near") == F.col(near)).select(*keys, F.col("_part").alias("_slot"), "_group", "_far")
        rows = rows.join(shaped, F.col("_far") == F.col("_id"))
        rows = rows.select(*keys, "_slot", "_group", F.struct("_id", "_value").alias(f"_value_{name}"))
        sent = sent.unionByName(rows, allowMissingColumns=True)
    dealt = sent.repartitionByRange(*by.values(), F.col("_slot").asc_nulls_first())
    sorted_lists = [F.array_sort(F.collect_list(f"_value_{name}"), _by_id).alias(f"_values_{name}") for name in lists]
    met = dealt.groupBy(*keys, "_slot", "_group").agg(F.collect_list("_row").alias("_rows"), *sorted_lists)
    whole = [F.transform(f"_values_{name}", values[name]).alias(name) for name in lists]
    own = met.select(*keys, "_slot", *whole, F.explode("_rows").alias("_row"))
    return own.select(*keys, "_slot", *lists, "_row.*").drop("_here")


def _packed(shaped: DataFrame) -> tuple[DataFrame, Callable[[Column], Column]]:
    """Values that travel with one array per column of a nested list, which is less than a row per element, and their way back."""
    fields = shaped.schema["_value"].dataType.fields
    nested = {f.name: f.dataType.elementType.fields for f in fields if _is_list(f.dataType)}

    def sent(f: T.StructField) -> Column:
        value = F.col("_value")[f.name]
        return F.struct(*[value[c.name].alias(c.name) for c in nested[f.name]]) if f.name in nested else value

    def zipped(value: Column, name: str) -> Column:
        as_named = T.StructType([T.StructField(c.name, c.dataType) for c in nested[name]])
        return F.arrays_zip(*[value[name][c.name] for c in nested[name]]).cast(T.ArrayType(as_named, False))

    def back(x: Column) -> Column:
        value = x["_value"]
        columns = [(F.lit(f.name), zipped(value, f.name) if f.name in nested else value[f.name]) for f in fields]
        return F.named_struct(*[part for column in columns for part in column])

    return shaped.select("_id", F.struct(*[sent(f).alias(f.name) for f in fields]).alias("_value")), back


def _is_list(t: T.DataType) -> bool:
    """A list of rows none of which is missing, as those of a relation are."""
    return isinstance(t, T.ArrayType) and not t.containsNull and isinstance(t.elementType, T.StructType)
