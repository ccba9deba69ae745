"""Other formats in and out: JSON lines, CSV, XML, YAML-like documents, HTML pages and repaired JSON."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from sparklode.functions.text import formula_safe


def read_json_lines(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Lines that don't parse are dropped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def first_of_each(df: DataFrame, id_col: str) -> DataFrame:
    """(id, position): the queue's ids without repeats, numbered from 1 by their first appearance: files in order of their names, lines in
    order. df comes right from a reader of files; however those are split over tasks, a line's place is its file, the block
    it was read from and its turn there."""
    from sparklode.operators.ranking import places

    at = F.struct(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("turn"))
    first = df.select(id_col, at.alias("__at")).groupBy(id_col).agg(F.min("__at").alias("__at"))
    return places(first, [F.asc("__at")]).select(id_col, F.col("place").alias("position"))


def read_csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    return spark.read.schema(schema).option("header", True).option("multiLine", True).option("escape", '"').csv(path)


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Fixed columns; text cells that a spreadsheet would run are defused."""
    kinds = dict(df.dtypes)
    cells = [formula_safe(F.col(c)).alias(c) if kinds[c] == "string" else F.col(c) for c in columns]
    df.select(*cells).write.mode("overwrite").option("header", True).option("escape", '"').option("quoteAll", True).csv(path)


def read_xml(spark: SparkSession, path: str, row_tag: str, schema: str) -> DataFrame:
    return spark.read.format("xml").option("rowTag", row_tag).schema(schema).load(path)


def write_json_portions(df: DataFrame, path: str, portions: int) -> None:
    df.repartition(portions).write.mode("overwrite").json(path)


def repaired_json(raw: str | None) -> str | None:
    """The first JSON object or array of a text as a compact string: fences go, a cut-off tail is closed; null if nothing parses."""
    if not raw:
        return None
    body = raw.strip()
    if body.startswith("```"):
        body = body.split("\n", 1)[-1].rsplit("```", 1)[0]
    starts = [k for k in (body.find("{"), body.find("[")) if k >= 0]
    if not starts:
        return None
    body = body[min(starts) :]
    closing: list[str] = []
    quoted = escaped = False
    cuts = []
    for k, c in enumerate(body):
        if escaped:
            escaped = False
        elif c == "\\":
            escaped = quoted
        elif c == '"':
            quoted = not quoted
        elif not quoted:
            if c in "{[":
                closing.append("}" if c == "{" else "]")
            elif c in "}]":
                if not closing or closing.pop() != c:
                    return None
                if not closing:
                    body = body[: k + 1]
                    break
            elif c == ",":
                cuts.append((k, "".join(reversed(closing))))
    candidates = [body + ('"' if quoted else "") + "".join(reversed(closing)), *(body[:k] + tail for k, tail in reversed(cuts))]
    for text in candidates:
        try:
            return json.dumps(json.loads(text), ensure_ascii=False, separators=(",", ":"))
        except ValueError:
            continue
    return None


@F.pandas_udf(StringType())
def repair_json(raw: pd.Series) -> pd.Series:
    return raw.map(lambda t: repaired_json(t) if isinstance(t, str) else None)


def nested_values(doc: str | None) -> tuple[dict[str, str], list[str]]:
    """The leaves of a document of `key: value` lines by their paths, and all its errors.

    Deeper indentation nests below the key before it, with a dot between; items of a list (`- value`) are numbered. Values may be
    quoted. Comments and blank lines are passed over; what is no key, comes twice, is indented by a tab or below a value is an error."""
    found: dict[str, str] = {}
    errors: list[str] = []
    #: Open levels: indentation, path, and how many list items stand there.
    open_: list[list] = [[-1, "", 0]]
    last: tuple[int, str] | None = None
    for n, raw in enumerate((doc or "").split("\n"), 1):
        line = raw.rstrip()
        body = line.lstrip(" ")
        if not body or body.startswith("#"):
            continue
        if body.startswith("\t"):
            errors.append(f"line {n}: tab")
            continue
        indent = len(line) - len(body)
        while indent <= open_[-1][0]:
            open_.pop()
        if last is not None and indent > last[0]:
            if last[1] in found:
                errors.append(f"line {n}: below a value")
                continue
            open_.append([last[0], last[1], 0])
        prefix = open_[-1][1]
        if body.startswith("- ") or body == "-":
            path, value = f"{prefix}[{open_[-1][2]}]", body[1:].strip()
            open_[-1][2] += 1
        else:
            key, colon, value = body.partition(":")
            key, value = key.strip(), value.strip()
            if not colon or not key:
                errors.append(f"line {n}: no key")
                continue
            path = f"{prefix}.{key}" if prefix else key
        if path in found:
            errors.append(f"line {n}: {path} again")
            continue
        if len(value) > 1 and value[0] == value[-1] and value[0] in "\"'":
            value = value[1:-1]
        elif not value and not body.startswith("-"):
            last = (indent, path)
            continue
        found[path] = value
        last = (indent, path)
    return found, errors


def key_values(rows: DataFrame, text: str = "text") -> DataFrame:
    """(fields, errors): documents of keys and values as maps from path to value, with all errors of a document in one array."""

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            read = [nested_values(doc if isinstance(doc, str) else None) for doc in batch["text"]]
            yield pd.DataFrame({"fields": [f for f, _ in read], "errors": [e for _, e in read]})

    return rows.select(F.col(text).alias("text")).mapInPandas(parse, "fields map<string,string>, errors array<string>")
