"""Large values out of line: reassembly, as-of fetch, misses, tombstones (A3, J13-J15, J19, V*)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def chunk_rows(changes: DataFrame, chunk_rels: DataFrame) -> tuple[DataFrame, DataFrame]:
    """V1. Changes of chunk relations (``rel``) as rows of a chunk store, and all other changes.

    An insert whose three columns are a value's id, its seq and the bytes (``new``: map of attnum to text) is a chunk; a
    delete is a tombstone of its tuple position (``blkno, offnum``). Anything else there has no effect on the store.
    """
    mine = changes.join(chunk_rels.select("rel"), "rel", "left_semi")
    part = lambda k: F.try_element_at("new", F.lit(k))
    dead = F.col("op") == "D"
    chunk = (F.col("op") == "I") & part(1).try_cast("long").isNotNull() & part(2).try_cast("int").isNotNull() & part(3).isNotNull()
    store = mine.filter((dead | chunk) & F.col("blkno").isNotNull() & F.col("offnum").isNotNull())
    born = lambda k, kind: F.when(~dead, part(k).try_cast(kind))
    store = store.select(F.col("rel").alias("relid"), "blkno", "offnum", born(1, "long").alias("chunk_id"), born(2, "int").alias("seq"), F.when(~dead, part(3)).alias("body"), "lsn", dead.alias("is_deleted"))
    return store, changes.join(chunk_rels.select("rel"), "rel", "left_anti")


def reassemble(chunks: DataFrame, keys: list[str], expected: str = "stored_size") -> DataFrame:
    """A3, V2. ``value`` and ``status`` of each key's chunks (``seq, body`` and the expected size).

    Assembled if seq is dense from 0 and the sizes add up, else Mismatch: a gap, a chunk too many or too few, or one twice. A
    key without any chunk has no row here; to its reader it is Missing. The body is text or binary. One value is one
    group, so hold values to the cap (V5) before.
    """
    own = chunks.groupBy(*keys).agg(F.expr("listagg(body) WITHIN GROUP (ORDER BY seq)").alias("value"), F.count(F.lit(1)).alias("n"), F.countDistinct("seq").alias("n_seq"), F.max("seq").alias("top"), F.min("seq").alias("low"), F.sum(F.octet_length("body")).alias("size"), F.max(expected).alias("_expected"))
    whole = (F.col("low") == 0) & (F.col("top") == F.col("n") - 1) & (F.col("n") == F.col("n_seq")) & (F.col("size") == F.col("_expected"))
    return own.select(*keys, F.when(whole, "Assembled").otherwise("Mismatch").alias("status"), F.when(whole, F.col("value")).alias("value"))


def live_positions(store: DataFrame, upto: Column) -> DataFrame:
    """J14, J15. ``relid, blkno, offnum, chunk_id, seq, lsn`` of the newest row of each tuple position with ``lsn <= upto``, if it is no tombstone.

    Reduced map-side to one row a position, without its body; a position that another value took over falls out only because
    all rows of a position compete, so values must be picked after this, not before.
    """
    last = store.filter(F.col("lsn") <= upto).groupBy("relid", "blkno", "offnum").agg(F.max(F.struct("lsn", "is_deleted", "chunk_id", "seq")).alias("c"))
    return last.filter("NOT c.is_deleted").select("relid", "blkno", "offnum", "c.chunk_id", "c.seq", "c.lsn")


def fetch_asof(store: DataFrame, pointers: DataFrame, cap: int = 64 << 20) -> DataFrame:
    """J14, V3, V5, V7. The value of each distinct pointer (relid, chunk_id, stored_size) as of its position ``at``.

    Positions in the store that ever held the value are its candidates; of each the newest row up to ``at`` counts, and only
    if it still holds that value. Bodies are joined last, for the rows that count. ``status``: Assembled, Mismatch, Missing (no
    live chunk), or TooLarge, for a pointer beyond ``cap`` bytes, of which nothing is read.
    """
    keys, place = ["relid", "chunk_id", "stored_size", "at"], ["relid", "blkno", "offnum"]
    wanted = pointers.select(*keys).distinct()
    values = wanted.filter(F.col("stored_size") <= cap)
    spots = store.filter("chunk_id IS NOT NULL").select(*place, "chunk_id").distinct().join(values, ["relid", "chunk_id"]).withColumnRenamed("chunk_id", "wanted")
    rows = store.select(*place, "lsn", "is_deleted", "chunk_id", "seq").join(spots, place).filter(F.col("lsn") <= F.col("at"))
    last = rows.groupBy(*place, "wanted", "stored_size", "at").agg(F.max(F.struct("lsn", "is_deleted", "chunk_id", "seq")).alias("c"))
    alive = last.filter("NOT c.is_deleted AND c.chunk_id = wanted")
    newest = alive.groupBy("relid", F.col("wanted").alias("chunk_id"), "stored_size", "at", F.col("c.seq").alias("seq")).agg(F.max(F.struct("c.lsn", "blkno", "offnum")).alias("c"))
    newest = newest.select(*keys, "seq", "c.lsn", "c.blkno", "c.offnum")
    bodies = store.filter("NOT is_deleted").select(*place, "lsn", "body").join(newest.select(*place, "lsn"), [*place, "lsn"], "left_semi").dropDuplicates([*place, "lsn"])  # replays are equal
    got = reassemble(newest.join(bodies, [*place, "lsn"]), keys)
    missing = F.when(F.col("stored_size") > cap, "TooLarge").otherwise("Missing")
    return wanted.join(got, keys, "left").withColumn("status", F.coalesce("status", missing))


def fetch_in_transaction(chunks: DataFrame, pointers: DataFrame) -> DataFrame:
    """J13, V2. Pointers (top_xid, relid, chunk_id, stored_size) with chunks of their own transaction, put together from those."""
    wanted = pointers.select("top_xid", "relid", "chunk_id", "stored_size").distinct()
    return reassemble(chunks.join(wanted, ["top_xid", "relid", "chunk_id"]), ["top_xid", "relid", "chunk_id", "stored_size"])


def residual(store: DataFrame, born: DataFrame, marker: Column) -> DataFrame:
    """J15, B5, U4. Positions alive at a rewrite's ``marker`` that the new generation did not write again: to be tombstoned."""
    return live_positions(store, marker).select("relid", "blkno", "offnum").join(born.filter(F.col("lsn") > marker).select("relid", "blkno", "offnum").distinct(), ["relid", "blkno", "offnum"], "left_anti")


def miss_policy(enabled: Column, in_transaction: Column, status: Column, has_mirror: Column) -> Column:
    """V4. What becomes of a pointer: filled, filled_default, filled_superseded, filled_mismatch, or an error.

    A value of which the own transaction holds chunks, but not all, is an error; so are one beyond the cap and a lost mirror.
    """
    return (
        F.when(status == "Assembled", "filled")
        .when(status == "TooLarge", "error_too_large")
        .when(in_transaction, "error_gap")
        .when(~enabled, "filled_default")
        .when(~has_mirror, "error_no_mirror")
        .when(status == "Mismatch", "filled_mismatch")
        .otherwise("filled_superseded")
    )


def over_cap(raw_size: str, stored_size: str, cap: int = 64 << 20) -> Column:
    """V5."""
    return F.greatest(raw_size, stored_size) > cap


def due_retires(pending: DataFrame, floor: int) -> DataFrame:
    """J19, V6. Dropped mirrors whose drop the resume floor has passed."""
    return pending.filter(F.col("commit_lsn") <= floor)
