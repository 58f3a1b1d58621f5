"""Routes, projections, coercions and runtime configuration (J10, F11, P*, B3, G*, D6, S12)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .timeline import asof

# Destination defaults of absent or NULL fields of columns that are not nullable.
DEFAULTS = {"string": "", "boolean": False, "tinyint": 0, "smallint": 0, "int": 0, "bigint": 0, "float": 0.0, "double": 0.0, "date": "1970-01-01", "timestamp": "1970-01-01 00:00:00", "binary": ""}
# Bytes of destination types of one width.
_FIXED_WIDTH = {"Bool": 1, "Int8": 1, "UInt8": 1, "Int16": 2, "UInt16": 2, "Int32": 4, "UInt32": 4, "Float32": 4, "Date32": 4, "Int64": 8, "UInt64": 8, "Float64": 8, "DateTime64": 8, "Time64": 8, "UUID": 16, "Int128": 16, "UInt128": 16, "Int256": 32, "UInt256": 32}


def routed(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """J10, F11. Changes with the ``target`` of their relation (rel); those without a route are left out before any decoding."""
    return changes.join(routes.filter("target IS NOT NULL"), "rel")


def unmapped_counts(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """F11. How many changes of each relation have no route."""
    return changes.join(routes.filter("target IS NOT NULL").select("rel"), "rel", "left_anti").groupBy("rel").agg(F.count(F.lit(1)).alias("n"))


def route_whole_transactions(changes: DataFrame, routes: DataFrame) -> DataFrame:
    """B3. Routes in force at the commit, so that a transaction never mixes two of them (changes have ``commit_lsn``)."""
    return asof(changes, routes, ["rel"], at="commit_lsn").filter("target IS NOT NULL").drop("valid_from", "valid_to")


def project(column: str, op: str = "op") -> Column:
    """P1. The new value, for deletes the old one."""
    return F.when(F.col(op) == "D", F.col(f"old.{column}")).otherwise(F.col(f"new.{column}"))


def coerce(value: Column, present: Column, kind: str, nullable: bool) -> Column:
    """P2. An absent or NULL field is NULL in a nullable column, else the type's default."""
    own = F.when(present, value)
    return own if nullable else F.coalesce(own, F.lit(DEFAULTS[kind]).cast(kind))


def with_missing_default(value: Column, attnum: int, n_atts: Column, default: Column | None) -> Column:
    """P4. A column added after the row was written has the catalog's default; a physical NULL stays NULL."""
    return F.when(n_atts < attnum, default if default is not None else F.lit(None)).otherwise(value)


def raised_if(bad: Column, message: Column) -> Column:
    """True, or an error where ``bad``. Spark moves a filter of fixed value below joins and other filters, to rows that those would
    take away; one with a random part stays where it is."""
    return F.when(bad & (F.rand() + 1 >= 1), F.raise_error(message).cast("boolean")).otherwise(True)


def without_partial(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """P7. Rows of transactions (``top_xid``) that the log has whole, and all rows of those of which it has a row only in part."""
    torn = rows.filter("partial").select("top_xid").distinct()
    return rows.join(torn, "top_xid", "left_anti"), rows.join(torn, "top_xid", "left_semi")


def reject_partial(rows: DataFrame) -> DataFrame:
    """P7. Fails the job on a mapped row of which the log has only a part."""
    return rows.filter(raised_if(F.col("partial"), F.concat(F.lit("partial row at "), F.col("lsn").cast("string"))))


def synthetic(rows: DataFrame) -> DataFrame:
    """P3. ``_lsn, _xid, _commit_ts, _is_deleted`` behind the mapped columns."""
    return rows.withColumns({"_lsn": F.col("lsn"), "_xid": F.col("xid"), "_commit_ts": F.col("commit_ts"), "_is_deleted": F.col("op") == "D"})


def override_allowed(default: str, asked: str) -> Column:
    """P8. Whether a column may have another destination type: what stays the same on the wire.

    Columns with type names as text. Decimals go to decimals, strings or signed integers of scale 0; strings to strings;
    fixed widths to the same width.
    """
    width = lambda c: F.element_at(F.create_map(*[x for k, v in _FIXED_WIDTH.items() for x in (F.lit(k), F.lit(v))]), F.regexp_extract(c, r"^(\w+)", 1))
    decimal = lambda c: F.col(c).startswith("Decimal(")
    scale0 = F.regexp_extract(default, r", *(\d+)\)", 1) == "0"
    to_integer = F.col(asked).isin("Int32", "Int64", "Int128", "Int256")
    return F.coalesce(F.when(decimal(default), decimal(asked) | (F.col(asked) == "String") | (to_integer & scale0)).when(F.col(default) == "String", F.col(asked) == "String").otherwise(~decimal(asked) & (width(default) == width(asked))), F.lit(False))


def config_events(changes: DataFrame) -> DataFrame:
    """G1, P11. Full images of configuration rows: the new value, else the old; deletes take the old."""
    image = lambda c: F.when(F.col("op") == "D", F.col(f"old.{c}")).otherwise(F.coalesce(F.col(f"new.{c}"), F.col(f"old.{c}")))
    return changes.select("lsn", "rel_name", (F.col("op") == "D").alias("removed"), image("scope").alias("scope"), image("key").alias("key"), image("value").alias("value"))


def layered(defaults: DataFrame, file: DataFrame, overlay: DataFrame, cli: DataFrame, valid: Column) -> DataFrame:
    """G2, G4, U6. Settings by key: the command line over the overlay over the file over the defaults.

    A value that ``valid`` (over ``key, value``) refuses is skipped, and the next layer's stays.
    """
    out = defaults.select("key", F.col("value").alias("v0"))
    for k, layer in enumerate((file, overlay, cli), 1):
        out = out.join(layer.filter(valid).select("key", F.col("value").alias(f"v{k}")), "key", "left")
    source = F.when(F.col("v3").isNotNull(), "cli").when(F.col("v2").isNotNull(), "overlay").when(F.col("v1").isNotNull(), "file").otherwise("default")
    return out.select("key", F.coalesce("v3", "v2", "v1", "v0").alias("value"), source.alias("source"))


def config_layer(settings: DataFrame, namespaces: DataFrame, tables: DataFrame, columns: DataFrame) -> DataFrame:
    """S12. The four configuration tables as one overlay of settings (key, value) for ``layered``; NULL settings are left out.

    Keys are ``name`` for the global row, ``ns.<namespace>.name``, ``rel.<namespace>.<relation>.name`` and
    ``col.<namespace>.<relation>.<column>.name``. Columns behind the key columns are settings, whatever they are called.
    """

    def settings_of(rows: DataFrame, kind: str, keys: list[str]) -> DataFrame:
        names = [c for c in rows.columns if c not in keys and c != "id"]
        prefix = F.concat_ws(".", F.lit(kind), *keys) if keys else F.lit(None)
        pairs = F.explode(F.array(*[F.struct(F.concat_ws(".", prefix, F.lit(c)).alias("key"), F.col(c).cast("string").alias("value")) for c in names]))
        return rows.select(pairs.alias("s")).select("s.key", "s.value").filter("value IS NOT NULL")

    own = [settings_of(settings, "", []), settings_of(namespaces, "ns", ["namespace"]), settings_of(tables, "rel", ["namespace", "relname"]), settings_of(columns, "col", ["namespace", "relname", "attname"])]
    return own[0].unionByName(own[1]).unionByName(own[2]).unionByName(own[3])


def opt_in_out(relations: DataFrame, choices: DataFrame, excluded: DataFrame) -> DataFrame:
    """G3. ``replicated``, ``excluded``, ``derived`` or ``parked`` for each relation or choice.

    choices: (rel_name, replicate true/false/NULL); a choice for an unknown relation waits; exclusion wins over all.
    """
    both = relations.select("rel_name", F.lit(True).alias("known")).join(choices, "rel_name", "full_outer").join(excluded.select("rel_name").withColumn("out", F.lit(True)), "rel_name", "left")
    state = F.when(F.coalesce("out", F.lit(False)), "excluded").when(F.col("known").isNull(), "parked").when(F.col("replicate").isNull(), "derived").when(F.col("replicate"), "replicated").otherwise("excluded")
    return both.select("rel_name", state.alias("state"))


def drop_strategy(dropped: DataFrame, by_namespace: DataFrame, default: str = "retain") -> DataFrame:
    """D6. retain, warn or drop for each dropped table, its namespace's choice before the general one."""
    return dropped.join(by_namespace, "rel_ns", "left").select("rel_ns", "rel_name", F.coalesce("strategy", F.lit(default)).alias("strategy"))
