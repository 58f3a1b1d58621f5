"""Schemas over log positions: as-of and interval joins, diffs, verdicts.

Versions, intervals and routes are small beside the changes: Spark broadcasts such a side by its known size, or by its
size at run time, and shuffles by the key where it is large.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranges import dealt


def validity(log: DataFrame, keys: Sequence[str], order: str = "valid_from") -> DataFrame:
    """W1. ``valid_to``: where the next version of the key begins, NULL for the last."""
    return log.withColumn("valid_to", F.lead(order).over(Window.partitionBy(*keys).orderBy(order)))


def asof(changes: DataFrame, log: DataFrame, keys: Sequence[str], at: str = "lsn", order: str = "valid_from") -> DataFrame:
    """J1, J2. Each change with the version of its key that is in force at ``at``; the version's columns are NULL before the first.

    An equi join on the key with the interval as a further condition.
    """
    spans = validity(log, keys, order)
    right = spans.select(*[F.col(k).alias(f"_{k}") for k in keys], *[c for c in spans.columns if c not in keys])
    on = None
    for k in keys:
        same = F.col(k) == F.col(f"_{k}")
        on = same if on is None else on & same
    on &= (F.col(at) >= F.col(order)) & (F.col("valid_to").isNull() | (F.col(at) < F.col("valid_to")))
    return changes.join(right, on, "left").drop(*[f"_{k}" for k in keys])


def asof_outcome(kind: str = "kind", target_db: int | None = None) -> Column:
    """J1. Present, Dropped, Retired, NotCovered, or ForeignDb for a change of another database (``db``)."""
    found = F.coalesce(F.col(kind), F.lit("NotCovered"))
    return found if target_db is None else F.when(F.col("db") != target_db, "ForeignDb").otherwise(found)


def asof_where(changes: DataFrame, log: DataFrame, keys: Sequence[str], predicate: Column, at: str = "lsn", order: str = "valid_from") -> DataFrame:
    """J6. As-of over the versions that ``predicate`` holds for, the others skipped."""
    return asof(changes, log.filter(predicate), keys, at, order)


def asof_with_pending(changes: DataFrame, log: DataFrame, pending: DataFrame, keys: Sequence[str], value: str) -> DataFrame:
    """J5, B4. ``value`` by what the change's own transaction (top_xid) has done so far, else by the committed log."""
    own = asof(changes, pending.withColumnRenamed(value, "_own"), [*keys, "top_xid"]).drop("valid_from", "valid_to")
    both = asof(own, log.select(*keys, "valid_from", value), keys).drop("valid_from", "valid_to")
    return both.withColumn(value, F.coalesce("_own", value)).withColumn("is_pending", F.col("_own").isNotNull()).drop("_own")


def with_inside(points: DataFrame, intervals: DataFrame, scopes: dict[str, str], name: str = "inside", at: str = "lsn") -> DataFrame:
    """J3. ``name``: whether a point is inside [from_lsn, through_lsn) of an interval (scope, key, from_lsn, through_lsn).

    scopes: the column of the points that an interval's key of that scope means. Each scope is an equi join by its key,
    with the key's intervals as one short array, so points are neither doubled nor compared with all intervals.
    """
    inside = F.lit(False)
    for scope, column in scopes.items():
        own = intervals.filter(F.col("scope") == scope).groupBy(F.col("key").alias(f"_key_{scope}")).agg(F.collect_list(F.struct("from_lsn", "through_lsn")).alias(f"_in_{scope}"))
        points = points.join(own, F.col(column) == F.col(f"_key_{scope}"), "left")
        inside |= F.coalesce(F.exists(f"_in_{scope}", lambda i: (F.col(at) >= i.from_lsn) & (F.col(at) < i.through_lsn)), F.lit(False))
    return points.withColumn(name, inside).drop(*(f"_{x}_{scope}" for scope in scopes for x in ("key", "in")))


def with_overlap(spans: DataFrame, intervals: DataFrame, scopes: dict[str, str], name: str = "overlaps") -> DataFrame:
    """J4. ``name``: whether [first_lsn, last_lsn) overlaps an interval of its key, as in ``with_inside``."""
    overlaps = F.lit(False)
    for scope, column in scopes.items():
        own = intervals.filter(F.col("scope") == scope).groupBy(F.col("key").alias(f"_key_{scope}")).agg(F.collect_list(F.struct("from_lsn", "through_lsn")).alias(f"_in_{scope}"))
        spans = spans.join(own, F.col(column) == F.col(f"_key_{scope}"), "left")
        overlaps |= F.coalesce(F.exists(f"_in_{scope}", lambda i: (F.col("first_lsn") < i.through_lsn) & (i.from_lsn < F.col("last_lsn"))), F.lit(False))
    return spans.withColumn(name, overlaps).drop(*(f"_{x}_{scope}" for scope in scopes for x in ("key", "in")))


def schema_events(log: DataFrame) -> DataFrame:
    """W3. Added, Changed, Dropped or Kept for each version, against the one before of the same oid."""
    before = Window.partitionBy("oid").orderBy("captured_at")
    rows = log.withColumns({"prev_kind": F.lag("kind").over(before), "prev_version": F.lag("version").over(before)})
    event = F.when(F.col("kind") != "Present", "Dropped").when(F.col("prev_kind").isNull() | (F.col("prev_kind") != "Present"), "Added").when(F.col("version") != F.col("prev_version"), "Changed").otherwise("Kept")
    return rows.withColumn("event", event)


def schema_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """D7. A row for each change of a column (rel, attnum): added, dropped, renamed, retyped (type or typmod) or renullable.

    Columns: ``rel, attnum, name, type_oid, typmod, not_null, dropped``. One column may be renamed and retyped at once;
    columns that stay the same, or are dropped on both sides, give no row. Both tables are counted first.
    """
    n = old.count() + new.count()
    fields = ("name", "type_oid", "typmod", "not_null")
    side = lambda df, x: dealt(df.filter("NOT dropped").select("rel", "attnum", *[F.col(c).alias(f"{x}_{c}") for c in fields]), n, "rel", "attnum")
    both = side(old, "old").join(side(new, "new"), ["rel", "attnum"], "full_outer")
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    kept = F.array_compact(F.array(F.when(differs("name"), "renamed"), F.when(differs("type_oid") | differs("typmod"), "retyped"), F.when(differs("not_null"), "renullable")))
    changes = F.when(F.col("old_name").isNull(), F.array(F.lit("added"))).when(F.col("new_name").isNull(), F.array(F.lit("dropped"))).otherwise(kept)
    return both.withColumn("change", F.explode(changes)).select("rel", "attnum", "change", "old_name", "new_name")


def ddl_plan(diff: DataFrame) -> DataFrame:
    """O7, D5. The statements of a diff in order: renames, then additions, then drops; a retyped column is ``rejected``, nullability follows no statement."""
    rank = F.element_at(F.create_map(*[x for k, c in enumerate(("renamed", "added", "dropped", "retyped")) for x in (F.lit(c), F.lit(k))]), F.col("change"))
    rows = diff.filter(F.col("change") != "renullable").withColumn("_rank", rank)
    place = F.row_number().over(Window.partitionBy("rel").orderBy("_rank", "attnum"))
    what = F.element_at(F.array(*map(F.lit, ("rename", "add", "drop", "rejected"))), F.col("_rank") + 1)
    return rows.select("rel", place.alias("position"), what.alias("statement"), "attnum", "old_name", "new_name")


def derived_mapping(attributes: DataFrame, keys: DataFrame) -> DataFrame:
    """P9. A relation's destination columns: all that are not dropped, in order, members of the key (rel, attnum) never nullable."""
    own = attributes.filter("NOT dropped").join(keys.select("rel", "attnum", F.lit(True).alias("_key")), ["rel", "attnum"], "left")
    place = F.row_number().over(Window.partitionBy("rel").orderBy("attnum"))
    return own.select("rel", place.alias("position"), "attnum", "name", "type_oid", (~F.coalesce("_key", F.lit(False)) & ~F.col("not_null")).alias("nullable"))


def folded_mapping(mapping: DataFrame, diff: DataFrame) -> DataFrame:
    """P10. A mapping (rel, attnum, name) after a diff: a column is renamed only if it still has its old name; dropped ones go, added ones come behind.

    The diff (at most one of added, dropped and renamed for a column) is joined once; both tables are counted first.
    """
    changes = diff.filter(F.col("change").isin("added", "dropped", "renamed"))
    n = mapping.count() + changes.count()
    own = mapping.select("rel", "attnum", "name", F.lit(True).alias("_own"))
    both = dealt(own, n, "rel", "attnum").join(dealt(changes.select("rel", "attnum", "change", "old_name", "new_name"), n, "rel", "attnum"), ["rel", "attnum"], "full_outer")
    renamed = (F.col("change") == "renamed") & (F.col("name") == F.col("old_name"))
    entry = lambda late, name: F.struct(F.lit(late).alias("late"), name.alias("name"))
    kept = F.when(F.col("_own") & ~F.coalesce(F.col("change") == "dropped", F.lit(False)), entry(0, F.when(renamed, F.col("new_name")).otherwise(F.col("name"))))
    rows = both.select("rel", "attnum", F.explode(F.array_compact(F.array(kept, F.when(F.col("change") == "added", entry(1, F.col("new_name")))))).alias("_e"))
    place = F.row_number().over(Window.partitionBy("rel").orderBy("_e.late", "attnum"))
    return dealt(rows, n, "rel").select("rel", place.alias("position"), "attnum", "_e.name")


def compatible_reader(old: DataFrame, new: DataFrame, old_attributes: DataFrame, new_attributes: DataFrame) -> DataFrame:
    """D8. Can the ``new`` descriptor of a relation read rows that were written under the ``old``?

    A row a relation: ``rel``, ``verdict`` (equal, benign or physical) and ``why``, the first check that fails, physical ones
    before benign ones. Relations: ``rel, node, kind, persistence, toast``; attributes, dropped ones included: ``rel, attnum,
    dropped, type_oid, typmod, not_null, missing, len, align, byval, storage``. Names, nullability of old columns and the
    identity do not matter for reading; a dropped column only has to keep its place and width.
    """
    before = lambda df, x, skip=("rel",): df.select("rel", *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in skip])
    differs = lambda c: ~F.col(f"old_{c}").eqNullSafe(F.col(f"new_{c}"))
    relations = before(old, "old").join(before(new, "new"), "rel")
    whole = (
        F.when(differs("node"), "node rotated")
        .when(differs("kind"), "kind change")
        .when(differs("persistence"), "persistence change")
        .when((F.col("old_toast") != 0) & differs("toast"), "large value relation change")
    )
    keys = ("rel", "attnum")
    side = lambda df, x: df.select(*keys, F.lit(True).alias(f"{x}_here"), *[F.col(c).alias(f"{x}_{c}") for c in df.columns if c not in keys])
    slots = side(old_attributes, "old").join(side(new_attributes, "new"), list(keys), "full_outer")
    appended = F.when(~F.col("new_dropped") & F.col("new_not_null") & F.col("new_missing").isNull(), "appended not-null column without missing value")
    alive = F.when(differs("type_oid"), "type change").when(differs("missing"), "missing value change")
    physical = (
        F.when(F.col("new_here").isNull(), "columns are gone")
        .when(F.col("old_here").isNull(), appended)
        .when(differs("len") | differs("align") | differs("byval"), "width change")
        .when(F.col("old_dropped") & ~F.col("new_dropped"), "dropped column is back")
        .when(~F.col("new_dropped"), alive)
    )
    benign = F.when(F.col("old_here") & F.col("new_here") & ~F.col("new_dropped"), F.when(differs("typmod"), "typmod change").when(differs("storage"), "storage change"))
    # the first of a relation: columns that are gone, then by attnum
    place = F.when(F.col("new_here").isNull(), 0).otherwise(F.col("attnum"))
    found = slots.groupBy("rel").agg(F.min_by(physical, F.when(physical.isNotNull(), place)).alias("physical"), F.min_by(benign, F.when(benign.isNotNull(), place)).alias("benign"))
    both = relations.withColumn("whole", whole).join(found, "rel", "left")
    worst = F.coalesce("whole", "physical")
    return both.select("rel", F.when(worst.isNotNull(), "physical").when(F.col("benign").isNotNull(), "benign").otherwise("equal").alias("verdict"), F.coalesce(worst, "benign").alias("why"))


def ambiguity(verdicts: DataFrame) -> DataFrame:
    """D9. Physical changes in place fence [first_touch, least of covered and the next version) of their relation."""
    return verdicts.filter("verdict = 'physical' AND NOT rotated").select("rel", F.col("first_touch").alias("from_lsn"), F.least("covered", F.coalesce("next_from", "covered")).alias("through_lsn")).filter("from_lsn < through_lsn")


def collect_garbage(log: DataFrame, keys: Sequence[str], floor: int) -> DataFrame:
    """D11. Versions from the floor on, and of those before it each key's last, if that one is Present."""
    rows = validity(log, keys)
    active = (F.col("valid_from") < floor) & (F.col("valid_to").isNull() | (F.col("valid_to") > floor)) & (F.col("kind") == "Present")
    return rows.filter((F.col("valid_from") >= floor) | active)


def assemble_descriptors(classes: DataFrame, attributes: DataFrame, namespaces: DataFrame, keys: DataFrame) -> DataFrame:
    """J9. One row a relation: its namespace, columns in order of attnum, and key attnums. A relation or column that is there twice fails the job."""
    once = lambda n, what: F.when((n > 1) & (F.rand() + 1 >= 1), F.raise_error(F.concat(F.lit(f"{what} twice: "), F.col("oid").cast("string"))).cast("boolean")).otherwise(True)
    columns = attributes.groupBy("oid").agg(F.sort_array(F.collect_list(F.struct("attnum", "name", "type_oid", "not_null"))).alias("attributes"), (F.count(F.lit(1)) - F.countDistinct("attnum") + 1).alias("_columns"))
    own_keys = keys.groupBy("oid").agg(F.sort_array(F.collect_list("attnum")).alias("key_attnums"))
    single = classes.groupBy(*classes.columns).agg(F.count(F.lit(1)).alias("_times"))
    of_oid = single.groupBy("oid").agg(F.sum("_times").alias("_classes"))
    rows = single.drop("_times").join(of_oid, "oid").join(namespaces, "ns_oid").join(columns, "oid").join(own_keys, "oid", "left")
    rows = rows.filter(once(F.col("_classes"), "relation") & once(F.col("_columns"), "column")).drop("_classes", "_columns")
    return rows.withColumn("key_attnums", F.coalesce("key_attnums", F.array().cast("array<int>")))


def catalog_union(**catalogs: DataFrame) -> DataFrame:
    """U7. Several catalogs as one table: ``catalog`` (its name), and all columns, NULL where a catalog lacks one."""
    out = None
    for name, rows in catalogs.items():
        own = rows.withColumn("catalog", F.lit(name))
        out = own if out is None else out.unionByName(own, allowMissingColumns=True)
    return out
