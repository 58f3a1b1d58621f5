"""Record filters: classes, routes, scopes, dirty transactions, boundaries (F*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Resource managers whose records are special, and the first object id that is not the catalog's.
SPECIAL_MANAGERS = ("Xlog", "Xact", "Clog", "MultiXact", "Standby", "RelMap", "CommitTs", "ReplOrigin", "Dbase", "Tblspc", "Smgr")
FIRST_NORMAL_OID = 16384
# Heap operations that change no row, and relation kinds with rows of their own (all, and those that can be truncated).
ROWLESS_OPERATIONS = ("LOCK", "INPLACE", "CONFIRM")
ROW_KINDS, TRUNCATE_KINDS = ("r", "p", "m", "t"), ("r", "p")


def record_class(manager: str = "rmgr", blocks: str = "blocks") -> Column:
    """F1. Special by the resource manager; else Catalog if any block is of the catalog, User if any is of a relation, else Empty.

    blocks: array of relation nodes.
    """
    catalog = F.exists(blocks, lambda b: (b > 0) & (b < FIRST_NORMAL_OID))
    user = F.exists(blocks, lambda b: b >= FIRST_NORMAL_OID)
    return F.when(F.col(manager).isin(*SPECIAL_MANAGERS), "Special").when(catalog, "Catalog").when(user, "User").otherwise("Empty")


def with_tracked(records: DataFrame, moved: DataFrame) -> DataFrame:
    """F3. ``tracked``: a block, or the relation that the record's own data names (``located``), is of a node that holds a catalog since ``valid_from`` (node, valid_from, db); db 0 holds for all."""
    first = moved.groupBy("node", "db").agg(F.min("valid_from").alias("valid_from"))
    hits = records.select("lsn", F.col("db").alias("_db"), F.explode(F.concat("blocks", F.array(F.coalesce("located", F.lit(0).cast("bigint"))))).alias("node")).join(first, "node").filter("valid_from <= lsn AND (db = 0 OR db = _db)").select("lsn").distinct()
    return records.join(hits.withColumn("tracked", F.lit(True)), "lsn", "left").withColumn("tracked", F.coalesce("tracked", F.lit(False)))


def route(klass: str = "class", tracked: str = "tracked", located: str = "located") -> Column:
    """F2. User records go to the decoder unless their node holds a catalog; all others are kept, an empty one by where its data points."""
    located_user = F.coalesce(F.col(located), F.lit(0)) >= FIRST_NORMAL_OID
    return F.when(F.col(tracked), "ToShadow").when((F.col(klass) == "User") | ((F.col(klass) == "Empty") & located_user), "ToDecoder").otherwise("ToShadow")


def in_scope(target_db: int, shared: bool = False) -> Column:
    """F4. Of the target database, or with ``shared`` of none."""
    own = F.col("db") == target_db
    return own | (F.col("db") == 0) if shared else own


def yields_rows(manager: str = "rmgr", operation: str = "operation") -> Column:
    """F9. Whether a heap record changes rows: locks, in-place updates and confirmations don't, nor do Heap2 records but multi-inserts."""
    heap = (F.col(manager) == "Heap") & ~F.col(operation).isin(*ROWLESS_OPERATIONS)
    return heap | ((F.col(manager) == "Heap2") & (F.col(operation) == "MULTI_INSERT"))


def eligible(oid: str = "oid", kind: str = "kind", *, truncate: bool = False) -> Column:
    """F15. Whether a relation has rows to follow (or, with ``truncate``, can be emptied): no catalog, and of a kind with rows."""
    return (F.col(oid) >= FIRST_NORMAL_OID) & F.col(kind).isin(*(TRUNCATE_KINDS if truncate else ROW_KINDS))


def explode_multi_insert(records: DataFrame, tuples: str = "tuples") -> DataFrame:
    """F10. A record of several rows becomes as many inserts of the same lsn and xid, numbered by ``tuple_idx``."""
    return records.select("lsn", "xid", "rel", F.posexplode(tuples).alias("tuple_idx", "tuple")).withColumn("op", F.lit("I"))


def dirty_deferred(changes: DataFrame) -> DataFrame:
    """F6, A4, W2. ``deferred``: the change's tree touched the catalog (``is_catalog``) at a lower lsn."""
    first = changes.filter("is_catalog").groupBy("top_xid").agg(F.min("lsn").alias("dirty_from"))
    return changes.join(first, "top_xid", "left").withColumn("deferred", F.coalesce(F.col("lsn") > F.col("dirty_from"), F.lit(False)))


def statistics_only(changes: DataFrame) -> DataFrame:
    """F5. Transactions whose catalog writes are all of opaque (statistics) relations."""
    return changes.filter("is_catalog").groupBy("xid").agg(F.bool_and("is_opaque").alias("statistics_only"))


def boundaries(changes: DataFrame, ends: DataFrame, invalidations: DataFrame) -> DataFrame:
    """F7, U3. Commits of trees that touched the catalog: the oids touched or invalidated, and whether all must be captured.

    Statistics-only trees are none.
    """
    touched = changes.filter("is_catalog AND NOT is_opaque").groupBy("top_xid").agg(F.collect_set("oid").alias("touched"), F.bool_or("capture_all").alias("capture_all"))
    told = invalidations.groupBy("top_xid").agg(F.collect_set("oid").alias("told"))
    both = ends.filter("outcome = 'commit'").join(touched, "top_xid").join(told, "top_xid", "left")
    return both.select("top_xid", "commit_lsn", F.array_sort(F.array_union("touched", F.coalesce("told", F.array().cast("array<bigint>")))).alias("oids"), "capture_all")


def split_config(changes: DataFrame, schema: str) -> tuple[DataFrame, DataFrame]:
    """F12. Writes to ``<schema>.config_*`` apart from all other rows."""
    own = (F.col("rel_ns") == schema) & F.col("rel_name").startswith("config_")
    return changes.filter(own), changes.filter(~own)


def catalog_skew(records: DataFrame, targets: DataFrame, start: int, end: int) -> DataFrame:
    """F19. Catalog writes or truncates of a target relation inside the gap; any row means that a load must stop."""
    return records.filter(F.col("lsn").between(start, end) & (F.col("is_catalog") | (F.col("op") == "T"))).join(targets, "rel", "left_semi")


def preflight(settings: dict[str, str], relations: DataFrame) -> DataFrame:
    """F20, J16. All findings at once: (check, subject). Settings: server_version, catalog_version, wal_level, slot."""
    findings = []
    if int(settings["server_version"]) < 160000:
        findings.append(("version", settings["server_version"]))
    if int(settings["server_version"]) // 10000 != int(settings["catalog_version"]) // 10000:
        findings.append(("major", settings["catalog_version"]))
    if settings["wal_level"] != "logical":
        findings.append(("wal_level", settings["wal_level"]))
    if not settings.get("slot"):
        findings.append(("slot", ""))
    spark = relations.sparkSession
    own = spark.createDataFrame(findings, "check string, subject string")
    keyless = relations.filter("identity = 'nothing' OR (identity = 'default' AND NOT has_pk)").select(F.lit("row_key").alias("check"), F.col("rel_name").alias("subject"))
    return own.unionByName(keyless)


def verdict() -> Column:
    """X9, X10. Why a mapped change can't be applied, or ``apply``; the first reason that holds.

    Columns: ``ambiguous, image_only, malformed, supported, shape`` (the schema version it decodes under), ``partial,
    generation_complete``. One refused change refuses its whole transaction.
    """
    return (
        F.when(F.col("ambiguous"), "ambiguous_interval")
        .when(F.col("image_only"), "image_only_insert")
        .when(F.col("malformed"), "malformed")
        .when(~F.col("supported"), "unsupported_operation")
        .when(F.col("shape").isNull(), "missing_verdict")
        .when(F.col("partial"), "partial_update")
        .when(~F.col("generation_complete"), "incomplete_generation")
        .otherwise("apply")
    )


def split_refused(changes: DataFrame, reason: str = "verdict") -> tuple[DataFrame, DataFrame]:
    """X10, X11. Changes of transactions without a refused one, and all others, for quarantine or for failing the job."""
    refused = changes.filter(F.col(reason) != "apply").select("top_xid").distinct()
    return changes.join(refused, "top_xid", "left_anti"), changes.join(refused, "top_xid", "left_semi")
