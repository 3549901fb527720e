"""Exports: CSV with quoting by need, and ordered pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BOM = "﻿"


def csv_field(value: Column) -> Column:
    """Quoted only if it holds a comma, a quote or a line end; null is empty."""
    text = F.coalesce(value.cast("string"), F.lit(""))
    quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
    return F.when(text.rlike('[",\n]'), quoted).otherwise(text)


def csv_line(*values: Column) -> Column:
    return F.concat_ws(",", *(csv_field(v) for v in values))


def csv_rows(rows: DataFrame, columns: list[str], key: str = "id") -> DataFrame:
    return rows.select(F.col(key), csv_line(*(F.col(c) for c in columns)).alias("line"))


def write_csv(rows: DataFrame, columns: dict[str, str], path: str, order: list[Column]) -> None:
    """Files of lines that end in CRLF; each begins with a byte order mark and the header (``columns``: header -> column)."""
    lines = rows.orderBy(*order).select(csv_line(*(F.col(c) for c in columns.values())).alias("value"))

    def with_header(parts):
        import pyarrow as pa

        head = BOM + ",".join(f'"{h}"' if "," in h else h for h in columns)
        begun = False
        for part in parts:
            if part.num_rows and not begun:
                begun = True
                yield pa.RecordBatch.from_arrays([pa.array([head], pa.string())], ["value"])
            yield pa.RecordBatch.from_arrays([part.column(0)], ["value"])

    lines.mapInArrow(with_header, "value string").write.mode("overwrite").option("lineSep", "\r\n").text(path)
