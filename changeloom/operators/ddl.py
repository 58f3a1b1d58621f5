"""Tables that follow their source's schema.

A column's physical name is its attnum (``c1``), so renames and drops change the logical schema alone, and files written
before a column came are read with its default.
"""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DataType, StructField, StructType


@dataclass(frozen=True)
class Column:
    attnum: int
    name: str
    kind: str
    nullable: bool = True
    default: object = None


@dataclass(frozen=True)
class Table:
    """Columns in the order of attnum, and the key's attnums; ``dropped`` ones stay known, as attnums are never used again."""

    columns: tuple[Column, ...]
    keys: tuple[int, ...] = ()
    dropped: tuple[int, ...] = ()

    def schema(self) -> StructType:
        """D1. The logical schema, key columns first and not nullable."""
        ordered = sorted(self.columns, key=lambda c: (c.attnum not in self.keys, c.attnum))
        return StructType([StructField(c.name, DataType.fromDDL(c.kind), c.nullable and c.attnum not in self.keys, {"attnum": c.attnum}) for c in ordered])

    def changes_to(self, new: Table) -> list[tuple[str, Column]]:
        """O7. Renames, then additions, then drops; a changed type is ``rejected``."""
        mine, theirs = ({c.attnum: c for c in t.columns} for t in (self, new))
        renamed = [("rename", theirs[k]) for k in mine if k in theirs and theirs[k].name != mine[k].name]
        rejected = [("rejected", theirs[k]) for k in mine if k in theirs and theirs[k].kind != mine[k].kind]
        return renamed + [("add", c) for k, c in theirs.items() if k not in mine] + [("drop", c) for k, c in mine.items() if k not in theirs] + rejected

    def folded(self, new: Table) -> Table:
        """P10, D2-D5. This table after the changes to ``new``; columns of a rejected type keep the old one."""
        columns = {c.attnum: c for c in self.columns}
        taken = {c.name for c in self.columns}
        for what, c in self.changes_to(new):
            if what == "rename" and c.name not in taken:
                columns[c.attnum] = replace(columns[c.attnum], name=c.name)
            elif what == "add":
                columns[c.attnum] = c
            elif what == "drop":
                del columns[c.attnum]
        return Table(tuple(columns[k] for k in sorted(columns)), new.keys or self.keys, tuple(sorted({*self.dropped, *(c.attnum for w, c in self.changes_to(new) if w == "drop")})))


def to_physical(rows: DataFrame, table: Table) -> DataFrame:
    return rows.select(*[F.col(c.name).cast(c.kind).alias(f"c{c.attnum}") for c in table.columns])


def to_logical(files: DataFrame, table: Table) -> DataFrame:
    """Rows of files of any age under the current schema; a column that a file lacks has its default.

    files: read with all physical columns of the table, absent ones as missing. ``_present`` (array of attnums) tells
    a NULL from an absent value where both occur in one read.
    """
    known = set(files.columns)

    def value(c: Column):
        default = F.lit(c.default).cast(c.kind)
        if f"c{c.attnum}" not in known:
            return default
        own = F.col(f"c{c.attnum}").cast(c.kind)
        return F.when(F.array_contains("_present", c.attnum), own).otherwise(default) if "_present" in known else own

    return files.select(*[value(c).alias(c.name) for c in sorted(table.columns, key=lambda c: (c.attnum not in table.keys, c.attnum))])


def quote_name(name: str) -> str:
    """N16."""
    return "`" + name.replace("`", "``") + "`"


def literal(value: object) -> str:
    """P12. A value as a SQL literal."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return "TRUE" if value else "FALSE"
    if isinstance(value, (bytes, bytearray)):
        return f"X'{value.hex().upper()}'"
    if isinstance(value, (int, float)):
        return repr(value)
    return "'" + str(value).replace("\\", "\\\\").replace("'", "\\'") + "'"
