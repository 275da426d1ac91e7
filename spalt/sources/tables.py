"""Results as JSON lines, CSV or text, written by Spark where the rows are."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CELL = 64


def json_lines(df: DataFrame) -> DataFrame:
    """One column `value`: a JSON object for each row, NULLs written out."""
    return df.select(F.to_json(F.struct(*(F.col(f"`{c}`") for c in df.columns)), {"ignoreNullFields": "false"}).alias("value"))


def csv_lines(df: DataFrame) -> DataFrame:
    """One column `value`: comma-separated cells; quotes, commas and line ends are quoted, NULL is an empty cell."""
    def cell(name: str):
        text = F.col(f"`{name}`").cast("string")
        quoted = F.concat(F.lit('"'), F.replace(text, F.lit('"'), F.lit('""')), F.lit('"'))
        return F.coalesce(F.when(text.rlike('[",\r\n]') | (text == ""), quoted).otherwise(text), F.lit(""))

    return df.select(F.concat_ws(",", *(cell(c) for c in df.columns)).alias("value"))


def write_lines(lines: DataFrame, path: str) -> None:
    lines.write.text(path)


def text_table(df: DataFrame, rows: int = 20) -> str:
    """The first rows as an aligned table, cells cut to CELL characters, for a terminal."""
    head = [tuple("NULL" if v is None else str(v) for v in r) for r in df.limit(rows).collect()]
    cut = [[c if len(c) <= CELL else c[: CELL - 1] + "…" for c in r] for r in [tuple(df.columns), *head]]
    wide = [max(len(r[i]) for r in cut) for i in range(len(df.columns))]
    lines = [" | ".join(c.ljust(w) for c, w in zip(r, wide, strict=True)).rstrip() for r in cut]
    return "\n".join([lines[0], "-+-".join("-" * w for w in wide), *lines[1:]])
