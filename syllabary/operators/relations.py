"""Joins along the relations of a catalogue."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from syllabary.catalog import LINKS
from syllabary.store import Store

Predicate = Callable[[DataFrame], Column]


def keys_reaching(store: Store, entity: str, path: str, matches: Predicate | None = None) -> tuple[str, DataFrame]:
    """The key column of ``entity`` and the distinct key values that reach a matching row over ``path``.

    Built from the innermost relation outwards. Each step is deduplicated before it is joined on: the
    partial aggregation shrinks hot keys ahead of the exchange, which the join after it then reuses.
    """
    first, _, rest = path.partition(".")
    relation = store.catalog.relation(entity, first)
    target = store[relation.target]
    if rest:
        column, keys = keys_reaching(store, relation.target, rest, matches)
        target = target.where(target[column].isNotNull()).join(keys, target[column] == keys["_key"], "left_semi")
        bare = matches is None or column == "id"
    else:
        column, bare = "id", matches is None
        if matches is not None:
            target = target.where(matches(target))
    if relation.link is None:
        return relation.near, target.select(F.col(relation.far).alias("_key")).where("_key is not null").distinct()
    links = store[relation.link]
    if not rest and bare:
        return "id", links.select(F.col(relation.near).alias("_key")).distinct()
    ids = (keys if rest and column == "id" else target.select(F.col("id").alias("_key"))).alias("ids")
    kept = links.join(ids, links[relation.far] == F.col("ids._key"), "left_semi")
    return "id", kept.select(F.col(relation.near).alias("_key")).distinct()


def where_related(
    store: Store, df: DataFrame, entity: str, path: str, matches: Predicate | None = None, negate: bool = False
) -> DataFrame:
    """Rows with (or, negated, without) a related row over 1 to n relations for which ``matches`` holds."""
    column, keys = keys_reaching(store, entity, path, matches)
    if negate:
        return df.join(keys, df[column] == keys["_key"], "left_anti")
    # Rows without a key cannot match; left in, they would all meet in one partition.
    return df.where(df[column].isNotNull()).join(keys, df[column] == keys["_key"], "left_semi")


def related_rows(store: Store, entity: str, relation_path: str, parent_id) -> DataFrame:
    """Rows of the last relation's target that hang on one parent row (one or more hops)."""
    names = relation_path.split(".")
    hops = []
    current = entity
    for name in names:
        relation = store.catalog.relation(current, name)
        hops.append(relation)
        current = relation.target
    relation = hops[0]
    parents = store[entity].where(F.col("id") == F.lit(parent_id))
    for relation in hops:
        target = store[relation.target]
        near = parents.select(F.col(relation.near if relation.link is None else "id").alias("_key"))
        if relation.link is None:
            parents = target.join(near, target[relation.far] == near["_key"], "left_semi")
        else:
            links = store[relation.link]
            far = links.join(near, links[relation.near] == near["_key"], "left_semi").select(
                F.col(relation.far).alias("_key")
            )
            parents = target.join(far, target["id"] == far["_key"], "left_semi")
    return parents


def by_id(store: Store, entity: str, key) -> DataFrame:
    """One row, or an empty result for "not found"."""
    return store[entity].where(F.col("id") == F.lit(key))


def inner_to_one(store: Store, df: DataFrame, entity: str, relation: str, matches: Predicate) -> DataFrame:
    """Inner join along a foreign key with a condition on its target; only the own columns remain."""
    rel = store.catalog.relation(entity, relation)
    target = store[rel.target]
    kept = target.where(matches(target)).select(F.col(rel.far).alias("_key"))
    return df.where(df[rel.near].isNotNull()).join(kept, df[rel.near] == kept["_key"]).drop("_key")


def fan_out(store: Store, df: DataFrame, entity: str, relation: str, matches: Predicate) -> DataFrame:
    """Inner join along a to-many foreign key: a row repeats per matching child, and is counted so."""
    return inner_to_one(store, df, entity, relation, matches)


def linked(store: Store, link: str, first: str, second: str) -> DataFrame:
    """entity x link x entity with prefixed columns."""
    near, far = LINKS[link]
    pairs = store[link].select(F.col(near).alias("_near"), F.col(far).alias("_far"))
    left = store[first].select([F.col(c).alias(f"{first}_{c}") for c in store.columns(first)])
    right = store[second].select([F.col(c).alias(f"{second}_{c}") for c in store.columns(second)])
    joined = pairs.join(left, F.col("_near") == F.col(f"{first}_id")).join(right, F.col("_far") == F.col(f"{second}_id"))
    return joined.drop("_near", "_far")


def shared_groups(links: DataFrame, group: str | Sequence[str], member: str) -> DataFrame:
    """Members that share a group with others: one row per (group, member) of each shared group.

    This holds every pair of members in factored form: two rows with the same group are a pair, so
    the result grows with the links and not with the square of the largest group. ``n_members`` is the
    size of the group, ``n_pairs`` (on each row) the number of unordered pairs in it.
    """
    groups = [group] if isinstance(group, str) else list(group)
    distinct = links.select(*groups, member).where(F.col(member).isNotNull()).distinct()
    sizes = distinct.groupBy(*groups).agg(F.count(F.lit(1)).alias("n_members")).where("n_members > 1")
    n = F.col("n_members")
    return distinct.join(sizes, groups).withColumn("n_pairs", F.expr("n_members * (n_members - 1) div 2")).select(
        *groups, member, n, "n_pairs"
    )


def partners(links: DataFrame, group: str | Sequence[str], member: str, chosen: DataFrame) -> DataFrame:
    """The pairs of the chosen members: (member, partner, group) with partner <> member.

    ``chosen`` has one column, ``member``. The result is linear in the groups of the chosen members.
    """
    groups = [group] if isinstance(group, str) else list(group)
    distinct = links.select(*groups, member).distinct()
    picked = distinct.join(chosen.select(F.col(member).alias("_chosen")).distinct(), F.col(member) == F.col("_chosen"))
    picked = picked.select(*groups, "_chosen")
    others = distinct.withColumnRenamed(member, "partner")
    return (
        picked.join(others, groups)
        .where(F.col("partner") != F.col("_chosen"))
        .select(F.col("_chosen").alias(member), "partner", *groups)
    )


def without_links(df: DataFrame, key: str, links: Sequence[tuple[DataFrame, str]]) -> DataFrame:
    """Rows whose key occurs in none of the link tables: one anti join per table."""
    for table, column in links:
        keys = table.select(F.col(column).alias("_key")).distinct()
        df = df.join(keys, df[key] == keys["_key"], "left_anti")
    return df


def missing_from(source: DataFrame, target: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Rows of the source whose (null-safe) keys are not in the target."""
    right = target.select([F.col(k).alias(f"_r_{k}") for k in keys]).distinct()
    condition = None
    for k in keys:
        term = source[k].eqNullSafe(right[f"_r_{k}"])
        condition = term if condition is None else condition & term
    return source.join(right, condition, "left_anti")
