"""Noise of scanned pages: cut words, misread characters, running headers and page numbers."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut, small
from .vocab import TOKENIZERS, ranks

#: A form is misread if another form of its skeleton is so many times as frequent, and has at least that count.
RATIO, LEAST = 8, 12
#: Where the document itself has another form of the skeleton, that one need only be so many times as frequent; forms of fewer letters are left to the first rule.
NEAR_RATIO, NEAR_LETTERS = 2, 4

# Glyphs that are taken for one another, as (misread for, skeleton), in the order of application.
_GLYPHS = (("ﬁ", "fi"), ("ﬂ", "fl"), ("ﬀ", "ff"), ("rn", "m"), ("nn", "m"), ("vv", "w"), ("0", "o"), ("5", "s"), ("8", "b"), ("q", "g"), ("c", "e"), ("1", "l"), ("i", "l"), ("|", "l"), ("!", "l"), ("u", "ll"), ("h", "ll"))

_HYPHENS = "-‐­"
_CUT = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*\r?\n")
_CUT_INLINE = re.compile(rf"(?<=[^\W\d_])[{_HYPHENS}] (?!(?:and|or|to|und|oder|bis|et|ou|y|o|e|и|или)\b)[a-zà-ÿ]{{2,}}")
_TORN = re.compile(r"(?<=[^\W\d_])~[^\W\d_]")
_SPACED = re.compile(r"(?<![\w.'’])[^\W\d_](?: [^\W\d_]){3,}(?![\w'’])")
_SINGLES = re.compile(r"\s\w \w \w\b")
_LOWER_WORD = re.compile(r"(?:^|\s)[^\W\d_A-ZÀ-ÞА-ЯЁ]")
_LIGATURE = re.compile("[ﬀ-ﬆ]")
_ROMAN = re.compile(r"(?=[ivxlc])c{0,3}(?:xc|xl|l?x{0,3})(?:ix|iv|v?i{0,3})")
_PAGE = re.compile(
    r"(?i)[ \t]*(?:[-–—][ \t]*\d{1,4}[ \t]*[-–—]|\[\d{1,4}\]|(?:page|seite|página|pagina|pág\.|pag\.|p\.|pp\.|стр\.|страница|s\.)[ \t]*\d{1,4}(?:[ \t]*(?:of|von|de|di|sur|из|/)[ \t]*\d{1,4})?|\d{1,4}[ \t]*/[ \t]*\d{1,4}|\d{1,4})[ \t\f\r]*"
)
_TITLE_PAGE = re.compile(
    r"(?ix)^\s*(?:[-–—]\s*\d{1,4}\s*[-–—]\s+(?=\S) | \d{1,4}\s*\n | \[\d{1,4}\]\s+ | (?:page|seite|p\.)\s*\d{1,4}\s*\n | (?-i:[ivxlc]{1,7})(?:\s{2,}|\s*\n)) "
    r"| (?:\.{3,}\s*\d{1,4} | \s{2,}\d{1,4} | \s\[\d{1,4}\] | \s{2,}\d{1,4}\s*/\s*\d{1,4} | \s{2,}[-–—]\s*\d{1,4}\s*[-–—] | \s+[-–—]\s\d{1,4}\s[-–—] | (?:\n|\s{2,})\s*(?:page|seite|p\.)\s*\d{1,4}(?:\s*(?:of|von|/)\s*\d{1,4})? | \n\s*\d{1,4}(?:\s*/\s*\d{1,4})? | \n\s*\[\d{1,4}\] | \n\s*[-–—]\s*\d{1,4}\s*[-–—] | (?:\s{2,}|\n)\s*(?-i:[ivxlc]{1,7}))[\s\f]*$"
)
_WORD = re.compile(r"(?<![\w~])[^\W_]{2,}+(?![\w~])")
_ENDED = re.compile(r"[.!?:;…。！？\"”»)\]}>|]\s*$")
_HEAD_WORD = re.compile(r"[A-ZÀ-ÞА-Я0-9][\w.&/-]*$")


@lru_cache(2)
def plain_words(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> frozenset[str]:
    """Lower-case words of the public vocabulary that stand with a blank before them; these are never suspected."""
    found = set()
    for piece in ranks(name, folder):
        if piece[:1] == b" " and piece[1:].isalpha() and len(piece) > 3:
            found.add(piece[1:].decode().lower())
    return frozenset(found)


def skeleton(form: Column) -> Column:
    """The form with every group of confusable glyphs as one, so that a word and its misreadings agree."""
    out = F.lower(form)
    for a, b in _GLYPHS:
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


@lru_cache(1 << 17)
def _skeleton(form: str) -> str:
    """``skeleton`` of one lower-case form."""
    for a, b in _GLYPHS:
        form = form.replace(a, b)
    return form


def near_forms(parts: list[set[str]], known: frozenset[str]) -> dict[str, str]:
    """For each form of a document that isn't in the vocabulary the other form of its skeleton that most parts hold, of equal ones the greatest."""
    held = Counter(w for own in parts for w in own if len(w) >= NEAR_LETTERS)
    groups: dict[str, list[str]] = {}
    for w in held:
        groups.setdefault(_skeleton(w), []).append(w)
    out = {}
    for group in groups.values():
        if len(group) > 1:
            for w in group:
                others = [(held[g], g) for g in group if g != w and g.isalpha()]
                if w not in known and others:
                    out[w] = max(others)[1]
    return out


def is_page_number(line: str) -> bool:
    """Whether a line is nothing but a page number."""
    if len(line) > 40:
        return False
    return bool(_PAGE.fullmatch(line)) or bool(0 < len(line.strip()) < 8 and _ROMAN.fullmatch(line.strip()))


def _masked(line: str) -> str:
    return re.sub(r"[\d\s]+", "0", line.strip()).translate(str.maketrans("OoIlSsEe", "000055FF")).casefold()


def _head_shaped(line: str) -> bool:
    if len(line) > 80 or _LOWER_WORD.search(line):
        return False
    words = line.split()
    return 2 <= len(words) <= 9 and not _ENDED.search(line) and all(_HEAD_WORD.match(w) for w in words) and sum(c.isalpha() for c in line) >= 6


def noise_lines(text: str, repeated: frozenset[str] = frozenset()) -> dict[int, str]:
    """Numbers (from 0) of the lines that are page numbers or running headers, with which of the two.

    A running header is a short line of capitalised words without a stop that
    interrupts a sentence, stands next to a page number or page break, carries a
    field set off by blanks, or comes back, digits masked, in another part of the
    document (``repeated``). Capital headings do none of that.
    """
    lines = text.split("\n")
    found = {k: "page" for k, line in enumerate(lines) if line and is_page_number(line)}
    for k, line in enumerate(lines):
        if k in found or not line or not line[:1].strip() or not _head_shaped(line.rstrip("\r\f")):
            continue
        before = lines[k - 1].rstrip() if k else ""
        after = lines[k + 1] if k + 1 < len(lines) else ""
        if re.match(r"[=~-]{3,}\s*$", after):
            continue
        cut = bool(before) and k - 1 not in found and not _ENDED.search(before) and not _head_shaped(before) or after[:1].islower()
        beside = k - 1 in found or k + 1 in found or "\f" in before + line or after.startswith("\f")
        field = bool(re.search(r"\S {2,}(?:REV\b|\d|[A-Z])", line))
        if cut or beside or field or _masked(line) in repeated:
            found[k] = "header"
    return found


def repeated_heads(texts: list[str]) -> frozenset[str]:
    """Masked head-shaped lines that occur in more than one part of a document."""
    seen: Counter[str] = Counter()
    for text in texts:
        seen.update({_masked(line) for line in text.split("\n") if _head_shaped(line.rstrip("\r\f"))})
    return frozenset(m for m, n in seen.items() if n > 1)


def has_broken_word(text: str) -> bool:
    """A word cut at a line end, torn apart by a stray sign, or spaced out letter by letter."""
    if "~" in text and _TORN.search(text) or _SINGLES.search(text) and _SPACED.search(text):
        return True
    return bool(_LIGATURE.search(text) or _CUT_INLINE.search(text) or any(True for _ in _cuts(text)))


def _cuts(text: str) -> Iterator[re.Match[str]]:
    if not any(h in text for h in _HYPHENS):
        return
    for m in _CUT.finditer(text):
        at = m.end()
        while at < len(text):  # past noise lines and blank ones
            end = text.find("\n", at)
            line = text[at : len(text) if end < 0 else end]
            if line.strip() and not is_page_number(line) and not _head_shaped(line.rstrip("\r\f")):
                break
            at += len(line) + 1
        if text[at : at + 1].islower():
            yield m


def words(text: str) -> set[str]:
    """Lower-case forms of a text, without hexadecimal and mostly numeric tokens."""
    found = set()
    for w in _WORD.findall(text):
        low = w.lower()
        digits = sum(c.isdigit() for c in low)
        if digits * 2 < len(low) and not (digits > 1 and len(low) > 5 and re.fullmatch(r"[0-9a-f]+", low)):
            found.add(low)
    return found


def _texts(outputs: DataFrame, output_id: str) -> DataFrame:
    return outputs.select(
        F.col(output_id).alias("output_id"), F.coalesce("title", F.lit("")).alias("title"),
        F.coalesce(F.transform("sections.content", lambda c: F.coalesce(c, F.lit(""))), F.array().cast("array<string>")).alias("contents"),
    )


def _scan(outputs: DataFrame, output_id: str, folder: str, every: bool = False) -> DataFrame:
    """(output_id, part_kind, part_pos, fault, form, n): rule faults and suspected forms of each part, with ``every`` only the forms, of all parts; counts of forms without a part."""
    rows = _texts(outputs, output_id)
    kind = rows.schema["output_id"].dataType.simpleString()
    schema = f"output_id {kind}, part_kind string, part_pos int, fault boolean, form string, n bigint, near string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = plain_words(folder=folder)
        for batch in batches:
            rows: list[tuple] = []
            counts: Counter[str] = Counter()
            for key, title, contents in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                repeated = frozenset() if every else repeated_heads(contents)
                texts = [("title", 0, title), *(("section", k, c) for k, c in enumerate(contents))]
                forms = [words(text) if text else set() for _, _, text in texts]
                near = near_forms(forms, known)
                for (part, pos, text), own in zip(texts, forms, strict=True):
                    if not text:
                        continue
                    counts.update(own)
                    fault = not every and (has_broken_word(text) or (bool(_TITLE_PAGE.search(text)) if part == "title" else bool(noise_lines(text, repeated))))
                    if fault:
                        rows.append((key, part, pos, True, None, None, None))
                    if every or not fault:
                        rows.extend((key, part, pos, fault, w, None, near.get(w)) for w in own if w not in known and len(w) > 2)
            rows.extend((None, None, None, None, w, n, None) for w, n in counts.items())
            for at in range(0, len(rows), 8192):
                columns = list(zip(*rows[at : at + 8192], strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (batch.schema.field(0).type, pa.string(), pa.int32(), pa.bool_(), pa.string(), pa.int64(), pa.string()), strict=True)], names=["output_id", "part_kind", "part_pos", "fault", "form", "n", "near"])

    return rows.mapInArrow(run, schema)


def misread_forms(counts: DataFrame) -> DataFrame:
    """(form, better) of the misread forms in (form, n).

    Forms are grouped by skeleton; the frequent form of a group is the better one
    of all forms that are ``RATIO`` times rarer. The groups are aggregates, of one
    row per form, with map-side combine.
    """
    forms = counts.groupBy("form").agg(F.sum("n").alias("n")).withColumn("skeleton", skeleton(F.col("form")))
    groups = forms.groupBy("skeleton").agg(F.max(F.struct("n", "form")).alias("top"), F.count("*").alias("forms")).where(F.col("forms") > 1)
    groups = groups.where((F.col("top.n") >= LEAST) & F.col("top.form").rlike(r"^\p{L}+$"))
    both = forms.join(groups, "skeleton").where((F.col("form") != F.col("top.form")) & (F.col("n") * RATIO <= F.col("top.n")))
    return both.select("form", F.col("top.form").alias("better"))


def misread_near(scanned: DataFrame) -> DataFrame:
    """Rows of ``_scan`` whose form is a misreading of the ``near`` form of its document, by the counts of both in all documents; with ``better``."""
    rows = scanned.where("near IS NOT NULL").drop("n")
    pairs = rows.select("form", "near").distinct()
    forms = small(cut(pairs.select(F.explode(F.array("form", "near")).alias("form")).distinct()))
    counts = cut(scanned.where("part_kind IS NULL").join(forms, "form", "left_semi").groupBy("form").agg(F.sum("n").alias("count")))
    other = counts.select(F.col("form").alias("near"), F.col("count").alias("near_count"))
    wrong = pairs.join(counts, "form").join(other, "near").where(F.col("count") * NEAR_RATIO <= F.col("near_count")).select("form", "near")
    return rows.join(small(cut(wrong)), ["form", "near"], "left_semi").withColumn("better", F.col("near"))


def faulty_parts(outputs: DataFrame, output_id: str = "output_id", folder: str = TOKENIZERS) -> DataFrame:
    """(output_id, part_kind, part_pos) of the titles and sections with a fault of scanning, without repeats.

    One pass finds what rules can tell inside a document and counts the forms of
    all documents; forms outside the public vocabulary are looked up by a join with
    the misread ones. A form is misread if another one of its skeleton is far more
    frequent in all documents, or more frequent and used in the same document. Null or empty titles, sections and contents give nothing;
    repeated rows count once in the result.
    """
    scanned = cut(_scan(outputs, output_id, folder))
    counts = scanned.where("part_kind IS NULL").select("form", "n")
    wrong = small(cut(misread_forms(counts).select("form")))
    suspects = scanned.where("part_kind IS NOT NULL AND NOT fault").select("output_id", "part_kind", "part_pos", "form")
    by_word = suspects.join(wrong, "form", "left_semi").select("output_id", "part_kind", "part_pos")
    by_near = misread_near(scanned).where("NOT fault").select("output_id", "part_kind", "part_pos")
    by_rule = scanned.where("fault AND form IS NULL").select("output_id", "part_kind", "part_pos")
    return by_rule.unionByName(by_word).unionByName(by_near).distinct()


def repaired_parts(outputs: DataFrame, output_id: str = "output_id", folder: str = TOKENIZERS) -> DataFrame:
    """(output_id, part_kind, part_pos, text): every title and section as continuous paragraphs.

    Noise lines fall away in one map, which also joins cut words and mends torn ones.
    The misread forms of a part are found on the narrow table of forms and come back
    as a small map beside its text, which is shuffled once. Lines then become rows; a
    window over the part tells where a paragraph begins (after a blank line, at list
    items and headings) and what is code, and the lines of a paragraph are joined. Code,
    between fences or indented by four blanks, keeps its lines as they are.
    """
    rows = _texts(outputs, output_id)
    kind = rows.schema["output_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: list[tuple] = []
            for key, title, contents in zip(*[batch.column(i).to_pylist() for i in range(3)], strict=True):
                repeated = repeated_heads(contents)
                for part, pos, text in [("title", 0, title), *(("section", k, c) for k, c in enumerate(contents))]:
                    if text:
                        out.append((key, part, pos, mended(text, part == "title", repeated)))
            for at in range(0, len(out), 1024):
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out[at : at + 1024], strict=True), (batch.schema.field(0).type, pa.string(), pa.int32(), pa.string()), strict=True)], names=["output_id", "part_kind", "part_pos", "text"])

    # One struct is the key of a part in every step, so that its text is shuffled once; nulls in it are equal.
    key = F.struct("output_id", "part_kind", "part_pos").alias("part")
    part = ["part"]
    scanned = cut(_scan(outputs, output_id, folder, every=True))
    wrong = small(cut(misread_forms(scanned.where("part_kind IS NULL").select("form", "n"))))
    fixes = scanned.where("form IS NOT NULL AND part_kind IS NOT NULL").select(key, "form").join(wrong, "form")
    fixes = fixes.select("part", "form", "better").unionByName(misread_near(scanned).select(key, "form", "better"))
    fixes = fixes.groupBy("part", "form").agg(F.min("better").alias("better")).groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("form", "better"))).alias("fixes"))
    texts = rows.mapInArrow(run, f"output_id {kind}, part_kind string, part_pos int, text string").select(key, "text")
    texts = texts.groupBy("part").agg(F.min("text").alias("text")).join(fixes, "part", "left")
    lines = texts.select("part", "fixes", F.posexplode(F.split("text", r"\r?\n")).alias("line", "text"))
    own = Window.partitionBy("part").orderBy("line")
    fence = F.col("text").rlike(r"^\s*(?:```|~~~)")
    lines = lines.withColumn("fences", F.coalesce(F.count_if(fence).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    lines = lines.withColumn("code", fence | (F.col("fences") % 2 == 1) | F.col("text").rlike(r"^(?: {4}|\t)"))
    before = F.lag("text").over(own)
    starts = before.isNull() | F.col("code") | F.lag("code").over(own) | (F.trim("text") == "") | (F.trim(before) == "") | F.col("text").rlike(r"^\s*(?:[-*+#>|]|\d+[.)]\s)") | before.rlike(r"^\s*#")
    lines = lines.withColumn("paragraph", F.sum(starts.cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    tokens = F.split("text", r"(?<=\s)|(?=\s)|(?<=[\p{L}\p{N}])(?=[^\p{L}\p{N}])|(?<=[^\p{L}\p{N}])(?=[\p{L}\p{N}])")

    def right(token: Column) -> Column:
        better = F.element_at("fixes", F.lower(token))
        upper = F.substring(token, 1, 1) != F.lower(F.substring(token, 1, 1))
        return F.when(better.isNull(), token).when(upper, F.initcap(better)).otherwise(better)

    text = F.when(F.col("code"), F.col("text")).when(F.col("fixes").isNull(), F.trim("text")).otherwise(F.trim(F.array_join(F.transform(tokens, right), "")))
    joined = lines.groupBy(*part, "paragraph").agg(F.array_sort(F.collect_list(F.struct("line", text.alias("text")))).alias("rows")).select(*part, "paragraph", F.array_join("rows.text", " ").alias("text"))
    return joined.groupBy(*part).agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("rows")).select("part.*", F.array_join("rows.text", "\n").alias("text"))


_FENCED = re.compile(r"(?ms)^[ \t]*(```|~~~).*?(?:^[ \t]*\1[^\n]*$|\Z)")


def mended(text: str, title: bool = False, repeated: frozenset[str] = frozenset()) -> str:
    """The text without noise lines, with cut and torn words whole again; line breaks elsewhere and fenced code stay."""
    if "```" in text or "~~~" in text:
        out, at = [], 0
        for m in _FENCED.finditer(text):
            out += [mended(text[at : m.start()], title, repeated), m[0]]
            at = m.end()
        return "".join([*out, mended(text[at:], title, repeated)]) if out else _mended(text, title, repeated)
    return _mended(text, title, repeated)


def _mended(text: str, title: bool, repeated: frozenset[str]) -> str:
    if title:
        text = _TITLE_PAGE.sub("", text)
    else:
        gone = noise_lines(text, repeated)
        if gone:
            text = "\n".join(line for k, line in enumerate(text.split("\n")) if k not in gone)
    text = text.replace("\f", "")
    text = re.sub(rf"(?<=[^\W\d_])[{_HYPHENS}][ \t]*\r?\n(?=[^\W\d_A-Z])", "", text)
    text = re.sub(rf"(?<=[^\W\d_])[{_HYPHENS}] (?!(?:and|or|to|und|oder|bis|et|ou|y|o|e)\b)(?=[a-zà-ÿ]{{2}})", "", text)
    text = re.sub(r"(?<!\w)([^\W\d_]{1,20}) ([^\W\d_]{1,20})~([^\W\d_]+)", r"\1\2\3", text)
    text = _SPACED.sub(lambda m: m[0].replace(" ", ""), text)
    return _LIGATURE.sub(lambda m: {"ﬀ": "ff", "ﬁ": "fi", "ﬂ": "fl", "ﬃ": "ffi", "ﬄ": "ffl", "ﬅ": "st", "ﬆ": "st"}[m[0]], text)
