"""Chunkers as folds over tokens that are made without state."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import BLANKS, byte_offset, utrim

#: Bytes of a hybrid chunk and of its overlap, of a section chunk, of a full-document chunk.
MAX_CHUNK, OVERLAP, MAX_SECTION, MAX_DOCUMENT = 1500, 200, 3000, 100_000

_BLANKS = re.compile(f"[{BLANKS}]+")


def _size(text: str) -> int:
    return len(text) if text.isascii() else len(text.encode("utf-8", "surrogatepass"))


def _words(text: str) -> list[str]:
    return [w for w in _BLANKS.split(text) if w]


def _tokens(text: str, limit: int) -> Iterator[tuple[str, str]]:
    """Pieces of a text in order: 'p' may be joined, 'c' closes the chunk before an overlong piece, 'h' is a chunk of its own."""
    for paragraph in text.split("\n\n"):
        paragraph = paragraph.strip(BLANKS)
        if not paragraph:
            continue
        sentences = paragraph.split(". ") if _size(paragraph) > limit else [paragraph]
        pieces = [f"{s}. " for s in sentences[:-1]] + sentences[-1:] if len(sentences) > 1 else [f"{paragraph}\n\n"]
        for piece in pieces:
            if _size(piece) <= limit:
                yield piece, "p"
                continue
            yield "", "c"
            for word in _words(piece):
                if _size(word) <= limit:
                    yield f"{word} ", "p"
                else:
                    yield from ((word[at : at + limit], "h") for at in range(0, len(word), limit))


def _tail(current: str, overlap: int) -> str:
    """The last words of a chunk that fit the overlap, a blank behind each; nothing of a chunk no longer than it."""
    if _size(current) <= overlap:
        return ""
    last, left = [], overlap
    for word in reversed(_words(current[-4 * overlap - 4 :] if overlap else "")):
        left -= _size(word) + 1
        if left < 0:
            break
        last.append(f"{word} ")
    return "".join(reversed(last))


def pack(text: str, limit: int = MAX_CHUNK, overlap: int = OVERLAP) -> list[str]:
    """The chunks of a text over ``limit`` bytes: one pass over its pieces, whose sizes are added up."""
    out: list[str] = []
    held: list[str] = []
    size = 0
    for piece, kind in _tokens(text, limit):
        more = _size(piece)
        if size and (kind != "p" or size + more > limit):
            current = "".join(held)
            out.append(current.strip(BLANKS))
            rest = _tail(current, overlap)
            held, size = [rest], _size(rest)
        if kind == "h":
            out.append(piece)
            held, size = [], 0
        else:
            held.append(piece)
            size += more
    last = "".join(held).strip(BLANKS)
    return [*out, last] if last else out


def packed(text: Column, limit: int = MAX_CHUNK, overlap: int = OVERLAP) -> Column:
    """array<string>: paragraphs, sentences and words packed up to ``limit`` bytes, each chunk led by the last words of the one before.

    A text within the limit is its own single chunk and stays in the JVM. A chunk may
    exceed the limit by the overlap; a word over the limit is cut into blocks of that
    many characters. Long texts go through Python in Arrow batches, as a fold of
    strings in the JVM takes time that grows with the square of a text.
    """

    @F.pandas_udf("array<string>")
    def packs(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: pack(t, limit, overlap), na_action="ignore")

    long = F.octet_length(text) > limit
    return F.when(long, packs(F.when(long, text))).otherwise(F.when(text.isNotNull(), F.array(text)))


def packed_json(text: Column, limit: int = MAX_CHUNK) -> Column:
    """array<string>: items of a JSON array, or entries of an object in key order, packed into valid JSON up to ``limit`` bytes.

    A single oversized item is a chunk of its own; an empty container gives '{}';
    null for a text that is no JSON container.
    """
    variant = F.try_parse_json(text)
    kind = F.substring(utrim(text), 1, 1)
    items = F.transform(F.variant_get(variant, "$", "array<variant>"), lambda v: F.to_json(v))
    entries = F.transform(F.array_sort(F.map_entries(F.variant_get(variant, "$", "map<string,variant>"))["key"]), lambda k: k)
    pairs = F.transform(entries, lambda k: F.concat(F.to_json(F.map_from_arrays(F.array(k), F.array(F.element_at(F.variant_get(variant, "$", "map<string,variant>"), k))))))
    bodies = F.transform(pairs, lambda p: F.substring(p, F.lit(2), F.length(p) - 2))

    def fold(parts: Column, a: str, b: str) -> Column:
        start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"), F.lit(2).alias("n"))

        def add(x: Column, s: Column) -> Column:
            size = F.octet_length(s) + 2  # its comma and blank, or its own braces
            full = (x["cur"] != "") & (x["n"] + size > limit)
            out = F.when(full, F.array_append(x["out"], F.concat(F.lit(a), x["cur"], F.lit(b)))).otherwise(x["out"])
            cur = F.when(full | (x["cur"] == ""), s).otherwise(F.concat(x["cur"], F.lit(","), s))
            return F.struct(out.alias("out"), cur.alias("cur"), (F.when(full, 2).otherwise(x["n"]) + size).alias("n"))

        def close(x: Column) -> Column:
            return F.when(x["cur"] != "", F.array_append(x["out"], F.concat(F.lit(a), x["cur"], F.lit(b)))).otherwise(F.array(F.lit("{}")))

        return F.aggregate(parts, start, add, close)

    whole = F.when(F.octet_length(text) <= limit, F.array(text))
    return F.coalesce(whole, F.when(kind == "[", fold(items, "[", "]")).when(kind == "{", fold(bodies, "{", "}")))


def balanced(text: Column, limit: int = MAX_SECTION) -> Column:
    """array<string>: a text over ``limit`` bytes in parts of about equal size, cut at paragraphs, lines, then characters."""
    n = F.octet_length(text)
    target = F.floor(n / F.ceil(n / limit))
    threshold = F.least(target + F.floor(target * 0.15), F.lit(limit)).cast("int")
    kind = lambda s, join, cost: F.struct(s.alias("s"), F.lit(join).alias("j"), F.lit(cost).alias("c"))
    slices = lambda s: F.transform(F.sequence(F.lit(0), F.floor((F.length(s) - 1) / limit).cast("int")), lambda i: kind(F.substring(s, i * limit + 1, F.lit(limit)), "", 0))
    lines = lambda p: F.flatten(F.transform(F.split(p, "\n"), lambda s: F.when(F.octet_length(s) > limit, slices(s)).otherwise(F.array(kind(s, "\n", 1)))))
    tokens = F.flatten(F.transform(F.split(text, "\n\n"), lambda p: F.when(F.octet_length(p) > limit, lines(p)).otherwise(F.array(kind(p, "\n\n", 2)))))
    start = F.struct(F.array().cast("array<string>").alias("out"), F.lit("").alias("cur"))

    def add(a: Column, t: Column) -> Column:
        full = (a["cur"] != "") & (F.octet_length(a["cur"]) + F.octet_length(t["s"]) + t["c"] > threshold)
        cur = F.when(full | (a["cur"] == ""), t["s"]).otherwise(F.concat(a["cur"], t["j"], t["s"]))
        return F.struct(F.when(full, F.array_append(a["out"], a["cur"])).otherwise(a["out"]).alias("out"), cur.alias("cur"))

    def close(a: Column) -> Column:
        return F.when(a["cur"] != "", F.array_append(a["out"], a["cur"])).otherwise(a["out"])

    return F.when(n <= limit, F.array(text)).otherwise(F.aggregate(tokens, start, add, close))


def hybrid_chunks(files: DataFrame, key: list[str], text: str = "text", limit: int = MAX_CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(key..., ordinal, content, start, end): JSON containers by items, other texts packed; null texts give no chunk.

    ``start`` is the byte offset of the chunk's first verbatim occurrence, 0 if it
    has none. Texts within the limit skip the fold.
    """
    content = F.col(text)
    json_like = (F.octet_length(content) > limit) & utrim(content).rlike(r"^[\[{]")
    rows = files.where(content.isNotNull()).select(*key, content.alias("_text"), F.when(json_like, packed_json(content, limit)).alias("_json"))
    other = packed(F.when(F.col("_json").isNull(), F.col("_text")), limit, overlap)
    rows = rows.select(*key, "_text", F.posexplode(F.coalesce("_json", other)).alias("ordinal", "content"))
    start = byte_offset(F.col("_text"), F.col("content"))
    return rows.select(*key, "ordinal", "content", start.alias("start"), (start + F.octet_length("content")).alias("end"))


def document_chunks(outputs: DataFrame, key: list[str]) -> DataFrame:
    """(key..., ordinal, kind, level, confidence, content) of parsed documents: sections, then tables, then the whole document.

    The first section with content is led by the title and an outline of the
    headings. Sections over 3,000 bytes come in balanced parts. The whole document is
    cut at 100,000 bytes, then back to the last blank line before.
    """
    sections = F.coalesce(F.col("sections"), F.array().cast("array<struct<heading:string,level:int,content:string>>"))
    tables = F.coalesce(F.col("tables"), F.array().cast("array<struct<caption:string,markdown:string>>"))
    blank = lambda c: F.coalesce(utrim(c), F.lit("")) == ""
    text = lambda c: F.coalesce(c, F.lit(""))
    heads = F.filter(sections, lambda s: text(s["heading"]) != "")
    hashes = lambda s: F.concat(F.repeat(F.lit("#"), F.coalesce(s["level"], F.lit(1))), F.lit(" "), s["heading"])
    outline = F.array_join(F.transform(heads, hashes), "\n")
    prefix = F.concat(F.lit("# "), text(F.col("title")), F.lit("\n\n## Document Structure\n"), outline, F.lit("\n\n---\n\n"))
    rows = outputs.select(*key, sections.alias("_s"), tables.alias("_t"), prefix.alias("_prefix"))
    sections, tables = F.col("_s"), F.col("_t")

    full = F.filter(F.transform(sections, lambda s, i: F.struct(i.alias("i"), s["heading"].alias("heading"), s["level"].alias("level"), s["content"].alias("content"))), lambda s: ~blank(s["content"]))
    one = rows.select(*key, "_prefix", F.posexplode(full).alias("place", "s"))
    header = F.concat(F.when(F.col("place") == 0, F.col("_prefix")).otherwise(""), F.when(text(F.col("s.heading")) != "", F.concat(hashes(F.col("s")), F.lit("\n\n"))).otherwise(""))
    parts = one.select(*key, "place", header.alias("_header"), "s", F.posexplode(balanced(F.col("s.content"))).alias("part", "content"), (F.octet_length("s.content") > MAX_SECTION).alias("split"))
    continued = F.when(text(F.col("s.heading")) != "", F.concat(F.lit("[cont. "), F.col("s.heading"), F.lit("]\n\n"), F.col("content"))).otherwise(F.col("content"))
    shown = F.when(F.col("part") == 0, F.concat("_header", "content")).otherwise(continued)
    of_sections = parts.select(
        *key, F.lit(0).alias("g"), "place", "part", F.when(F.col("part") == 0, "Section").otherwise("Paragraph").alias("kind"), F.lit(2).alias("level"),
        F.when(F.col("split"), 0.90).otherwise(0.95).alias("confidence"), F.when(F.col("split"), utrim(shown)).otherwise(shown).alias("content"),
    )
    named = lambda t: F.concat(F.when(text(t["caption"]) != "", F.concat(F.lit("Table: "), t["caption"], F.lit("\n\n"))).otherwise(""), t["markdown"])
    kept = F.filter(tables, lambda t: ~blank(t["markdown"]))
    of_tables = rows.select(*key, F.posexplode(F.transform(kept, named)).alias("place", "content")).select(
        *key, F.lit(1).alias("g"), "place", F.lit(0).alias("part"), F.lit("Table").alias("kind"), F.lit(4).alias("level"), F.lit(0.95).alias("confidence"), "content"
    )
    whole_section = lambda s: F.concat(
        F.when(text(s["heading"]) != "", F.concat(hashes(s), F.lit("\n\n"))).otherwise(""), F.when(~blank(s["content"]), F.concat(s["content"], F.lit("\n\n"))).otherwise("")
    )
    joined = F.concat(F.array_join(F.transform(sections, whole_section), ""), F.array_join(F.transform(kept, lambda t: F.concat(named(t), F.lit("\n\n"))), ""))
    whole = rows.select(*key, joined.alias("content")).where(~blank(F.col("content")))
    head = F.regexp_replace(F.decode(F.substring(F.encode("content", "UTF-8"), 1, MAX_DOCUMENT), "UTF-8"), "�+$", "")
    cut = F.when(head.contains("\n\n"), F.regexp_extract(head, r"(?s)^(.*)\n\n", 1)).otherwise(head)
    of_whole = whole.select(
        *key, F.lit(2).alias("g"), F.lit(0).alias("place"), F.lit(0).alias("part"), F.lit("DocumentOverview").alias("kind"), F.lit(1).alias("level"), F.lit(0.85).alias("confidence"),
        F.when(F.octet_length("content") > MAX_DOCUMENT, cut).otherwise(F.col("content")).alias("content"),
    )
    order = F.struct("g", "place", "part")
    return of_sections.unionByName(of_tables).unionByName(of_whole).select(*key, order.alias("ordinal"), "kind", "level", "confidence", "content")
