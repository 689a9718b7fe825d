"""Markdown to sections and tables, text by text."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, table_likely, uwords

#: The line that announces a table.
TABLE_MARK = "<!-- TABLE -->"


_NEW_LINE = re.compile(r"\r?\n")


def _kinds(text: str) -> Iterator[tuple[str, str, str]]:
    """(kind, line without outer blanks, line) of every line: mark, caption or row of an announced table, heading or text."""
    in_table = False
    for raw in _NEW_LINE.split(text):
        line = raw.strip(BLANKS)
        if line == TABLE_MARK:
            in_table = True
            yield "mark", line, raw
            continue
        caption = line.startswith("Caption:")
        in_table = in_table and (caption or line.startswith("|") or line.startswith("---"))
        yield ("caption" if caption else "row") if in_table else "heading" if line.startswith("#") else "text", line, raw


def sections_of(text: str) -> list[tuple[str, int, str]]:
    """(heading, level, content) of the sections of a Markdown text."""
    found: list[tuple[str, int, str]] = []
    heading, level, held = "", 1, []

    def close() -> None:
        content = "\n\n".join(held).strip(BLANKS)
        if content:
            found.append((heading, level, content))
        held.clear()

    for kind, line, _ in _kinds(text):
        if kind == "text":
            held.append(line)
        elif kind in ("mark", "heading"):
            close()
            if kind == "heading":
                bare = line.lstrip("#")
                heading, level = bare.strip(BLANKS), min(6, len(line) - len(bare))
    close()
    whole = text.strip(BLANKS)
    return found or ([("", 1, whole)] if whole else [])


def tables_of(text: str) -> list[tuple[str, str]]:
    """(caption, markdown) of the announced tables of a text that have rows."""
    found: list[tuple[str, list[str]]] = []
    for kind, line, raw in _kinds(text):
        if kind == "mark":
            found.append(("", []))
        elif kind == "caption":
            found[-1] = (re.sub("^(?:Caption:)+", "", line).strip(BLANKS), found[-1][1])
        elif kind == "row":
            found[-1][1].append(raw)
    return [(caption, "\n".join(rows)) for caption, rows in found if rows]


def _mapped(texts: DataFrame, key: list[str], text: str, parse: Callable[[str], list[tuple]], fields: list[tuple[str, pa.DataType, str]]) -> DataFrame:
    """(key..., pos, fields...): what ``parse`` makes of each text, a map in which texts and keys stay in their row; null texts give nothing."""
    rows = texts.where(F.col(text).isNotNull()).select(F.col(text).alias("_text"), *key)
    names = [*key, "pos", *[n for n, *_ in fields]]
    schema = ", ".join([f"`{k}` {dict(rows.dtypes)[k]}" for k in key] + ["pos int"] + [f"{n} {t}" for n, _, t in fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, pos, values = [], [], []
            for k, value in enumerate(batch.column(0).to_pylist()):
                made = parse(value)
                at += [k] * len(made)
                pos += range(len(made))
                values += made
            keys = [batch.column(1 + k).take(pa.array(at, pa.int32())) for k in range(len(key))]
            columns = [pa.array([v[k] for v in values], t) for k, (_, t, _) in enumerate(fields)]
            yield pa.RecordBatch.from_arrays([*keys, pa.array(pos, pa.int32()), *columns], names=names)

    return rows.mapInArrow(run, schema)


def markdown_sections(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., pos, heading, level, content): one row per section with content, in order.

    A heading or a table mark closes a section; text before the first heading has an
    empty one. Lines are trimmed and joined by blank lines. A text that gives no
    section at all is one section, a blank one gives none.
    """
    return _mapped(texts, key, text, sections_of, [("heading", pa.string(), "string"), ("level", pa.int32(), "int"), ("content", pa.string(), "string")])


def markdown_tables(texts: DataFrame, key: list[str], text: str = "text") -> DataFrame:
    """(key..., pos, caption, markdown): one row per announced table with rows; the last caption line before the rows end holds."""
    return _mapped(texts, key, text, tables_of, [("caption", pa.string(), "string"), ("markdown", pa.string(), "string")])


def sufficient(outputs: DataFrame, key: list[str]) -> DataFrame:
    """(key..., sufficient): whether a parse may be kept: enough text, and tables where the text looks like one."""
    sections = F.coalesce(F.col("sections"), F.array().cast("array<struct<heading:string,level:int,content:string>>"))
    total = F.aggregate(sections, F.lit(0), lambda n, s: n + F.coalesce(F.octet_length(s["content"]), F.lit(0)))
    no_tables = F.coalesce(F.size("tables"), F.lit(0)) <= 0
    likely = F.exists(sections, lambda s: F.coalesce(table_likely(s["content"]), F.lit(False)))
    return outputs.select(*key, (~(no_tables & ((total < 50) | likely))).alias("sufficient"))


def word_count(text: str = "text"):  # noqa: ANN201
    return F.size(uwords(F.col(text)))
