"""Hash numbers that Spark and DuckDB agree on, in place of random ones, so every run draws alike."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def draw(*parts: Column | int | str) -> Column:
    """A number below 2 ** 48 from the parts' text."""
    text = F.concat_ws("-", *(p.cast("string") if isinstance(p, Column) else F.lit(str(p)) for p in parts))
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 12), 16, 10).cast("long")


def draw_sql(*parts: str) -> str:
    """The same in DuckDB, of SQL expressions."""
    return f"('0x' || substr(md5(concat_ws('-', {', '.join(f'({p})::VARCHAR' for p in parts)})), 1, 12))::BIGINT"
