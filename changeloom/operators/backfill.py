"""Initial loads: visibility of tuples, gaps, staging."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .ranges import TASK_ROWS
from .routing import raised_if

#: Rows of one xid from which on they are spread over many join keys.
FREQUENT = 100_000


def xid_status(rows: DataFrame, log: DataFrame, patch: DataFrame, tail: int, oldest: int, xid: str = "xid", name: str = "status") -> DataFrame:
    """J11. ``name``, the status of each row's ``xid``: Committed, Aborted, InProgress or Unknown."""
    return xid_statuses(rows, log, patch, tail, oldest, {xid: name})


def xid_statuses(rows: DataFrame, log: DataFrame, patch: DataFrame, tail: int, oldest: int, names: dict[str, str]) -> DataFrame:
    """J11. The status of each of the xid columns in ``names``, under the name given there.

    The patch (xid, committed) outranks the base log (xid, bits); 1 and 2 are committed; at or beyond ``tail`` all are in
    progress, below ``oldest`` unknown. Patch and log are one table, joined by the xid, so that rows need not be reduced to
    xids before. An xid of very many rows, such as the 0 of tuples that nobody deleted, is spread over several keys.
    """
    known = patch.select("xid", F.col("committed").alias("_p")).join(log.select("xid", F.col("bits").alias("_b")), "xid", "full_outer")
    base, n = rows, rows.count()
    for xid, name in names.items():
        own = F.col(xid)
        both = _spread_join(rows, base, n, known.withColumnRenamed("xid", xid), xid)
        status = (
            F.when(own.isin(1, 2), "Committed")
            .when(F.col("_p"), "Committed")
            .when(~F.col("_p"), "Aborted")
            .when(own >= tail, "InProgress")
            .when(own < oldest, "Unknown")
            .when(F.col("_b") == 1, "Committed")
            .when(F.col("_b") == 2, "Aborted")
            .otherwise("InProgress")
        )
        rows = both.withColumn(name, status).drop("_p", "_b")
    return rows


def _spread_join(rows: DataFrame, counted: DataFrame, n: int, right: DataFrame, key: str) -> DataFrame:
    """``rows`` left join ``right`` by ``key``; a key with over ``FREQUENT`` of the ``n`` rows in ``counted`` is dealt to many tasks.

    Such a key's rows get one of several salts, and its rows of ``right`` are there once for each. There are few of these
    keys, as each has so many rows. The join has more tasks where the rows are many.
    """
    tasks = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-n // TASK_ROWS))
    salts = 16 * tasks
    often = F.broadcast(counted.groupBy(key).agg(F.count(F.lit(1)).alias("_n")).filter(F.col("_n") > FREQUENT).select(key, F.lit(True).alias("_often")))
    spread = rows.join(often, key, "left").withColumn("_salt", F.when(F.col("_often") | F.col(key).isNull(), F.floor(F.rand(7) * salts).cast("int")).otherwise(0)).drop("_often")
    copies = F.sequence(F.lit(0), F.when(F.col("_often"), salts - 1).otherwise(0))
    right = right.join(often, key, "left").withColumn("_salt", F.explode(copies)).drop("_often")
    return spread.repartition(tasks, key, "_salt").join(right, [key, "_salt"], "left").drop("_salt")


def multixact_updater(offsets: DataFrame, members: DataFrame) -> DataFrame:
    """J12. Of each multixact (mxid, start) the first member (pos, xid, kind) in its range with kind above 3; NULL if all only lock.

    Ids are dense: a range ends where that of mxid + 1 starts, and the last one is open and left out.
    """
    after = offsets.select((F.col("mxid") - 1).alias("mxid"), F.col("start").alias("stop"))
    inside = offsets.join(after, "mxid").withColumn("pos", F.explode(F.sequence("start", F.col("stop") - 1)))
    hit = inside.join(members, "pos", "left").withColumn("_u", F.when(F.col("kind") > 3, F.col("xid")))
    return hit.groupBy("mxid").agg(F.min_by("_u", F.when(F.col("_u").isNotNull(), F.col("pos"))).alias("updater"))


def visibility(xmin: str = "xmin", xmax: str = "xmax", mask: str = "infomask", min_status: str = "xmin_status", max_status: str = "xmax_status", updater: str = "updater_status", has_log: Column | None = None) -> Column:
    """F14. Emit, Skip, Defer or Unresolvable for a tuple, by its hint bits, then by the outcomes of its xmin, and of its xmax or its updater.

    ``updater``: Covered, LockOnly or Unresolvable of a multixact, or its updater's status; NULL without multixact data.
    Without a transaction log (``has_log``, true by default) what the hint bits leave open is deferred; so is a tuple whose
    status is NULL where one is asked for. An Unknown xmin counts as committed, and so does an Unknown xmax.
    """
    log = F.lit(True) if has_log is None else has_log
    bit = lambda b: F.col(mask).bitwiseAND(F.lit(b)) != 0
    frozen = (F.col(mask).bitwiseAND(F.lit(0x0300)) == 0x0300) | ((F.col(xmin) > 0) & (F.col(xmin) < 3))
    unhinted = ~frozen & ~bit(0x0100)
    gone = lambda c: F.col(c).isin("Aborted", "InProgress")
    open_ = lambda c: ~log | F.col(c).isNull()
    lock_only = bit(0x0080) | (F.col(mask).bitwiseAND(F.lit(0x1050)) == 0x0040)
    multi = F.when(~log, "Defer").when(F.col(updater).isNull() | (F.col(updater) == "Unresolvable"), "Unresolvable").when(F.col(updater).isin("Covered", "LockOnly", "Aborted", "InProgress"), "Emit").otherwise("Skip")
    return (
        F.when(~frozen & bit(0x0200), "Skip")
        .when(unhinted & open_(min_status), "Defer")
        .when(unhinted & gone(min_status), "Skip")
        .when((F.col(xmax) == 0) | bit(0x0800) | lock_only, "Emit")
        .when(bit(0x1000), multi)
        .when(bit(0x0400), "Skip")
        .when(open_(max_status), "Defer")
        .when(gone(max_status), "Emit")
        .otherwise("Skip")
    )


def baseline(snapshot: DataFrame, lsn: int) -> DataFrame:
    """L1, L2, S9. Snapshot rows as inserts at one lsn, with no commit time."""
    return snapshot.withColumns({"_lsn": F.lit(lsn).cast("long"), "_xid": F.lit(0).cast("long"), "_commit_ts": F.lit(0).cast("long"), "_is_deleted": F.lit(False)})


def gap_window(changes: DataFrame, after: int, upto: int) -> DataFrame:
    """F16. Changes that committed in (after, upto], to be replayed onto a backup taken at ``after``."""
    return changes.filter((F.col("commit_lsn") > after) & (F.col("commit_lsn") <= upto))


def copy_back(live: DataFrame, loaded_at: int, version: str = "_lsn") -> DataFrame:
    """F17. Live rows newer than the load, to be taken over when the staging table becomes the table."""
    return live.filter(F.col(version) > loaded_at)


def gated_load(tuples: DataFrame, lsn: int, verdict: Column | None = None) -> DataFrame:
    """L3. The visible tuples of a page-level backup (with the columns of ``visibility``) as a baseline at ``lsn``.

    A tuple that the backup can't decide fails the job: taking it could bring a dead version back, leaving it could lose a
    live row. Deferred ones fail too, as a load has its log.
    """
    verdict = visibility() if verdict is None else verdict
    decided = raised_if(verdict.isin("Unresolvable", "Defer"), F.concat(F.lit("undecided tuple of xmin "), F.col("xmin").cast("string")))
    return baseline(tuples.filter(decided).filter(verdict == "Emit"), lsn)


def object_store_load(base: DataFrame, committed: DataFrame, live: DataFrame, *, redo: int, opt_in: int) -> DataFrame:
    """L4. A backup taken at ``redo`` for a table that is opted in at ``opt_in``: its rows at the lower of both, what committed
    in between, and the live rows after. A latest state over them takes each key's newest.

    base: key and value columns; committed and live: those, ``_lsn`` and ``_is_deleted``, committed with ``commit_lsn`` too.
    """
    names = [*base.columns, "_lsn", "_is_deleted"]
    loaded = baseline(base, min(redo, opt_in)).select(*names)
    return loaded.unionByName(gap_window(committed, redo, opt_in).select(*names)).unionByName(copy_back(live, opt_in).select(*names))


def shared_columns(destination: DataFrame, staging: DataFrame) -> list[str]:
    """J17, U5. Columns of both, in the destination's order."""
    return [c for c in destination.columns if c in set(staging.columns)]


def same_shape(a: DataFrame, b: DataFrame) -> bool:
    """J18. Equal names and types in equal order."""
    return [(f.name, f.dataType) for f in a.schema] == [(f.name, f.dataType) for f in b.schema]


def publish_staged(staged: DataFrame, live: DataFrame | None, path: str, loaded_at: int) -> str:
    """L5. The staged load and the live rows after it as a new version folder under ``path``; returns the folder.

    The shapes must be equal. Readers take the folder that the caller's pointer names, so the change is at once.
    """
    if live is not None and not same_shape(staged, live):
        raise ValueError("the staged table has another shape")
    folder = f"{path}/version-{uuid.uuid4().hex}"
    rows = staged if live is None else staged.unionByName(copy_back(live, loaded_at))
    rows.write.parquet(folder)
    return folder
