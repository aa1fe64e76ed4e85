"""Writers for texts and tables.  Spark writes part files to any file system it
reaches; a folder is the unit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillstone.operators import tables


def write_texts(df: DataFrame, path: str, text: str = "text", by: str | None = None) -> None:
    """One column of texts as text files, in folders by ``by`` if given."""
    out = df.select(*([by] if by else []), text)
    (out.write.partitionBy(by) if by else out.write).text(path)


def write_table_csv(df: DataFrame, path: str, rows: str = "rows", by: str = "table_id") -> None:
    """Each table as CSV text in a folder of its own."""
    df.select(by, tables.csv_text(F.col(rows)).alias("value")).write.partitionBy(by).text(path)
