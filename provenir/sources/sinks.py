"""Sinks: named split files, appended lines, tables and matrices for papers, readable dumps and draws.

Files come whole or not at all: Spark writes them beside their place and moves them there when the job commits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Decimals of a figure in a table for a paper.
DECIMALS = 4


def write_csv(df: DataFrame, path: str, compression: str = "none") -> None:
    """CSV with a header and doubled quotes in place of what stood there; '' stays '' and null is an empty field."""
    df.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", '""').option("compression", compression).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    """JSON lines in place of what stood there; null fields are kept."""
    df.write.mode("overwrite").option("ignoreNullFields", False).json(path)


def append_jsonl(df: DataFrame, path: str) -> None:
    """Further JSON lines; a job that fails adds none."""
    df.write.mode("append").option("ignoreNullFields", False).json(path)


def write_named_splits(df: DataFrame, root: str, dataset: str, column: str = "split", names: tuple[str, ...] = ("train", "dev", "test")) -> None:
    """<root>/<dataset>/<split>_ as CSV for each of the names; rows of other splits are an error."""
    other = df.where(~F.coalesce(F.col(column).isin(*names), F.lit(False))).limit(1).count()
    if other:
        raise ValueError(f"rows outside of {names}")
    for name in names:
        write_csv(df.where(F.col(column) == name).drop(column), f"{root}/{dataset}/{name}_")


def write_draws(df: DataFrame, path: str) -> None:
    """Every draw as gzip CSV; figures in their shortest form that reads back to the same number."""
    write_csv(df, path, "gzip")


def tex_escaped(text: Column | str) -> Column:
    """Backslashes and underscores as TeX prints them."""
    return F.replace(F.replace(text if isinstance(text, Column) else F.col(text), F.lit("\\"), F.lit("\\textbackslash{}")), F.lit("_"), F.lit("\\_"))


def tex_figure(value: Column | str, best: Column | None = None) -> Column:
    """A figure with DECIMALS decimals, bold where best holds, two dashes for null and not a number."""
    v = value if isinstance(value, Column) else F.col(value)
    shown = F.format_string(f"%.{DECIMALS}f", v)
    if best is not None:
        shown = F.when(best, F.concat(F.lit("\\textbf{"), shown, F.lit("}"))).otherwise(shown)
    return F.when(v.isNull() | F.isnan(v), "--").otherwise(shown)


def tex_rows(df: DataFrame, label: str, values: list[str]) -> DataFrame:
    """A table row (label, line) per row, each column's greatest figures bold; the greatest are a one-row table."""
    top = df.agg(*(F.max(F.when(~F.isnan(v), F.round(v, DECIMALS))).alias(f"_{v}") for v in values))
    cells = [tex_figure(v, F.round(v, DECIMALS) == F.col(f"_{v}")) for v in values]
    return df.crossJoin(F.broadcast(top)).select(label, F.concat(F.concat_ws(" & ", tex_escaped(label), *cells), F.lit(" \\\\")).alias("line"))


def tex_matrix(cells: DataFrame, row: str, column: str, value: str) -> DataFrame:
    """A matrix row (label, line) per row name; its columns follow in their names' order."""
    listed = F.sort_array(F.collect_list(F.struct(F.col(column).alias("c"), tex_figure(value).alias("v"))))
    return cells.groupBy(row).agg(F.concat(F.concat_ws(" & ", tex_escaped(F.col(row)), F.transform(listed, lambda x: x["v"])), F.lit(" \\\\")).alias("line"))


def readable(df: DataFrame, title: str, fields: list[str]) -> DataFrame:
    """(title, text): each field under its own rule, nulls as empty."""
    parts = [F.concat(F.lit(f"--- {f} ---\n"), F.coalesce(F.col(f).cast("string"), F.lit("")), F.lit("\n")) for f in fields]
    return df.select(title, F.concat(F.lit("=== "), F.col(title).cast("string"), F.lit(" ===\n"), *parts).alias("text"))
