"""Where rows go (K1-K3, K6-K8)."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F


def append(rows: DataFrame, path: str, batch: int) -> None:
    """K1, T6, T7. A batch's rows in a folder of their own: written again, it is replaced, so retries leave one copy."""
    rows.write.mode("overwrite").parquet(f"{path}/batch={batch}")


def discard(rows: DataFrame) -> None:
    """K2. Run the plan for its metrics alone."""
    rows.write.format("noop").mode("overwrite").save()


def mirror_chunks(chunks: DataFrame, path: str) -> None:
    """K3. Append chunks to their relation's folder; ``relid`` prunes the read."""
    chunks.write.mode("append").partitionBy("relid").parquet(path)


def fan_out(rows: DataFrame, sinks: Sequence[Callable[[DataFrame], None]]) -> None:
    """K6. Several sinks in order over one computation; the first error stops the rest."""
    rows = rows.persist()
    try:
        for sink in sinks:
            sink(rows)
    finally:
        rows.unpersist()


def observed(rows: DataFrame, name: str = "rows") -> tuple[DataFrame, Observation]:
    """K7, A12. Rows by operation, counted while another action runs."""
    seen = Observation(name)
    counts = [F.count_if(F.col("op") == op).alias(label) for op, label in (("I", "inserts"), ("U", "updates"), ("H", "hot_updates"), ("D", "deletes"), ("T", "truncates"))]
    return rows.observe(seen, F.count(F.lit(1)).alias("rows"), *counts), seen


def metrics_text(values: dict[str, float], prefix: str = "changeloom") -> str:
    """K8. Gauges in the text form that scrapers read."""
    return "".join(f"# TYPE {prefix}_{k} gauge\n{prefix}_{k} {v}\n" for k, v in sorted(values.items()))
