"""Text files in and out: CSV and JSON with declared columns, candidate logs, summaries and Markdown tables."""

from __future__ import annotations

import json
import math
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Texts that a CSV reader takes for missing.
MISSING = ("", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null")
#: Files that hold reviewed data; candidates must not be written over them.
PROTECTED = ("benchmarks.csv", "benchmark_aliases.csv", "benchmark_facets.csv", "models.csv")


def read_csv(spark: SparkSession, path: str, columns: Sequence[str], optional: Sequence[str] = (), required: bool = False, blank_missing: bool = True) -> DataFrame:
    """The string columns of a CSV file with a header, missing texts as "". Quoted fields may hold line breaks and doubled quotes; a byte-order mark is skipped.

    A missing file gives an empty table, or an error if `required`, as does a file without rows. Columns that are not there raise, `optional` ones are filled with
    "". blank_missing: whether texts such as NA count as missing.
    """
    wanted = [*columns, *optional]
    schema = ", ".join(f"`{c}` string" for c in wanted)
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        if required:
            raise FileNotFoundError(path)
        return spark.createDataFrame([], schema)
    raw = spark.read.csv(path, header=True, quote='"', escape='"', multiLine=True, inferSchema=False)
    raw = raw.toDF(*[c.lstrip("﻿") for c in raw.columns])
    if lost := [c for c in columns if c not in raw.columns]:
        raise ValueError(f"{path} lacks the columns {', '.join(lost)}")
    text = lambda c: F.coalesce(F.when(~F.col(f"`{c}`").isin(*MISSING), F.col(f"`{c}`")) if blank_missing else F.col(f"`{c}`"), F.lit("")).alias(c)
    out = raw.select(*[text(c) if c in raw.columns else F.lit("").alias(c) for c in wanted])
    if required and out.isEmpty():
        raise ValueError(f"{path} holds no rows")
    return out


def write_csv(df: DataFrame, path: str, columns: Sequence[str], order: Sequence[str]) -> None:
    """df as one CSV file folder with a header, in this order of columns and rows; dates as ISO texts. For result tables of report size."""
    df.select(*columns).orderBy(*order).coalesce(1).write.mode("overwrite").csv(path, header=True, dateFormat="yyyy-MM-dd", escape='"')


def summary_json(df: DataFrame) -> str:
    """The one row of df as JSON; numbers that are not finite raise."""
    rows = df.limit(2).collect()
    if len(rows) != 1:
        raise ValueError("a summary is one row")
    values = rows[0].asDict(recursive=True)
    if bad := [k for k, v in values.items() if isinstance(v, float) and not math.isfinite(v)]:
        raise ValueError(f"not finite: {', '.join(bad)}")
    return json.dumps(values, indent=2, default=str, allow_nan=False, ensure_ascii=False)


def append_candidates(candidates: DataFrame, path: str, key: Sequence[str]) -> int:
    """Appends to the JSON lines at `path` the candidates whose key is not there yet, so that a broken run can be taken up again; returns how many."""
    name = path.rstrip("/").rsplit("/", 1)[-1]
    if name in PROTECTED:
        raise ValueError(f"{name} holds reviewed data")
    spark = candidates.sparkSession
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fresh = candidates.dropDuplicates(list(key))
    if hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).exists(hadoop):
        done = spark.read.schema(candidates.schema).json(path).select(*key).distinct()
        fresh = fresh.join(done, list(key), "left_anti")
    n = fresh.count()
    if n:
        fresh.write.mode("append").json(path)
    return n


def markdown_table(df: DataFrame, columns: Sequence[str], order: Sequence[str], rows: int = 50) -> str:
    """The first rows of df as a Markdown table; missing values as a dash."""
    cell = lambda v: "—" if v is None or v == "" else str(v).replace("|", "\\|").replace("\n", " ")
    got = df.select(*columns).orderBy(*order).limit(rows).collect()
    lines = ["| " + " | ".join(columns) + " |", "|" + " --- |" * len(columns)]
    return "\n".join(lines + ["| " + " | ".join(cell(v) for v in r) + " |" for r in got])


def fill_template(template: str, values: dict[str, object]) -> str:
    """A text with its {{KEY}} marks filled; a mark without a value raises."""
    import re

    def value(m: re.Match) -> str:
        if m[1] not in values:
            raise KeyError(f"no value for {m[1]}")
        return "—" if values[m[1]] is None else str(values[m[1]])

    return re.sub(r"\{\{([A-Za-z0-9_]+)\}\}", value, template)


def write_manifest(spark: SparkSession, path: str, files: Sequence[str], **facts: object) -> str:
    """Writes a JSON manifest of the files that a run made, sorted, and further facts; returns its text."""
    text = json.dumps({"files": sorted(files), **facts}, indent=2, default=str, allow_nan=False, ensure_ascii=False, sort_keys=True)
    spark.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)
    return text


def review_packet(spark: SparkSession, path: str, sections: dict[str, tuple[str, Sequence[str]]], title: str = "Review", rows: int = 500) -> str:
    """A Markdown packet for reviewers from a JSON file: for each section (heading: field of the file, columns) a table of the field's objects, or a line that there are none. A missing
    file raises. rows: lines of a table at most; what is left out is counted."""
    doc = spark.read.text(path, wholetext=True)
    out = [f"# {title}"]
    for heading, (name, columns) in sections.items():
        listed = doc.select(F.posexplode(F.from_json(F.get_json_object("value", f"$.{name}"), "array<map<string,string>>")).alias("at", "m"))
        table = listed.select("at", *[F.col("m")[c].alias(c) for c in columns])
        n = table.count()
        out += ["", f"## {heading}", "", markdown_table(table, columns, ["at"], rows) if n else "None."]
        if n > rows:
            out.append(f"\n{n - rows} more.")
    return "\n".join(out) + "\n"
