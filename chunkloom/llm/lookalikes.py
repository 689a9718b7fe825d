"""Texts that look the same, brought to one form of characters."""

from __future__ import annotations

import hashlib
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import TOKENIZERS, ranks

# Letters of other alphabets and the Latin letters of the same shape, pairwise in order.
_SAME_SHAPE = (
    ("аеорсухіјѕһԁԛԝӏвкмнт", "aeopcyxijshdqwl" + "вкмнт"),  # small Cyrillic; those behind the palochka have no twin
    ("АВЕКМНОРСТУХІЈЅԚԜӀҮүѵѴԌզ", "ABEKMHOPCTYXIJSQWIYyvVGq"),
    ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοοναιρϲϹϳͿ", "ABEZHIKMNOPTYXoovaipcCjJ"),
    ("օսՍՕՏհ", "ouUOSh"),
    ("ᎠᎡᎢᎪᎫᎬᎳᎷᎻᎽᏀᏃᏏᏒᏔᏙᏚᏞᏟᏢᏦᏴ", "DRTAJEWMHYGZbRWVSLCPKB"),
    ("ꓐꓑꓓꓔꓖꓗꓙꓚꓜꓝꓠꓡꓢꓣꓦꓧꓪꓫꓬꓮꓰꓲꓳꓴꓟ", "BPDTGKJCZFNLSRVHWXYAEIOUM"),
    ("ɡɑꞬ", "gaG"),
)
_LATIN = {a: b for left, right in _SAME_SHAPE for a, b in zip(left, right, strict=True) if a != b}

# Characters without a glyph of their own, besides those of category Cf.
_NO_GLYPH = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D, 0x180F, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)}
# Characters of category Cf that are seen.
_SEEN = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x08E2, 0x110BD, 0x110CD}

_PARTS = re.compile(r"\S+|\s+")
_ZWJ = "‍"


def _pictograph(c: str) -> bool:
    return c >= "\U0001f000" or unicodedata.category(c) == "So" or c in "️⃣"


@lru_cache(1 << 14)
def _glyphs(c: str) -> str:
    """The letters a character is drawn with: none for an invisible one, several for a ligature."""
    kind = unicodedata.category(c)
    if kind == "Cf" and ord(c) not in _SEEN or ord(c) in _NO_GLYPH:
        return ""
    if kind == "Zs":
        return " "
    tag, _, to = unicodedata.decomposition(c).partition(" ")
    name = unicodedata.name(c, "")
    if tag in ("<wide>", "<narrow>") or tag == "<compat>" and ("LIGATURE" in name or "DIGRAPH" in name or "ROMAN NUMERAL" in name or re.match(r"LATIN (SMALL|CAPITAL) LETTER (DZ|LJ|NJ|D WITH|L WITH|N WITH)", name)):
        return "".join(_glyphs(x) for x in unicodedata.normalize("NFKD", c))
    return _LATIN.get(c, c)


def _drawn(token: str) -> str:
    """Decomposed, each character replaced by its glyphs; a joiner stays where it joins pictographs."""
    split = unicodedata.normalize("NFD", token)
    out = []
    for k, c in enumerate(split):
        if c == _ZWJ and 0 < k < len(split) - 1 and _pictograph(split[k - 1]) and _pictograph(split[k + 1]):
            out.append(c)
        else:
            out.append(_glyphs(c))
    return "".join(out)


@lru_cache(1 << 14)
def _readings(c: str) -> str:
    """The trie letters that a raw character is read as at no cost: none for an ignorable one, several for a ligature or a joined accent."""
    return "".join(map(_glyphs, unicodedata.normalize("NFD", c)))


class Trie:
    """Words of a public vocabulary, searched by an edit automaton in which look-alikes and ignorables cost nothing.

    An edge stands for a shape: letters of the same shape share it. A word is held if
    it is its own table form, so that a look has one spelling whether the trie or the
    table gives it.
    """

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        self.root: dict = {}
        for piece, rank in sorted(ranks(name, folder).items(), key=lambda x: x[1]):
            try:
                word = unicodedata.normalize("NFD", piece.decode().strip())
            except UnicodeDecodeError:
                continue
            if len(word) > 1 and word[0].isalpha() and all(c.isalpha() or unicodedata.combining(c) for c in word) and by_table(word) == unicodedata.normalize("NFC", word):
                node = self.root
                for c in word:
                    node = node.setdefault(_glyphs(c), {})
                node.setdefault("", (rank, word))

    def spelling(self, token: str, budget: int = 0) -> str | None:
        """The word of lowest cost, then rank, that the raw ``token`` can be read as within ``budget``.

        The automaton takes the token as it is, character by character. A character
        follows the edges of its shape at 0, an ignorable one stays where it is at 0, and
        another letter in its place costs 1. With budget 0 only words of the very same
        look remain.
        """
        states: dict[int, tuple[int, dict]] = {id(self.root): (0, self.root)}
        for raw in token:
            for shape in _readings(raw):
                following: dict[int, tuple[int, dict]] = {}
                for cost, node in states.values():
                    options = [(cost, node[shape])] if shape in node else []
                    if cost < budget:
                        options += [(cost + 1, n) for k, n in node.items() if k and k != shape]
                    for price, to in options:
                        if id(to) not in following or following[id(to)][0] > price:
                            following[id(to)] = (price, to)
                states = following
                if not states:
                    return None
        ends = [(cost, *node[""]) for cost, node in states.values() if "" in node]
        return min(ends)[2] if ends else None


@lru_cache(2)
def trie(name: str, folder: str) -> Trie:
    return Trie(name, folder)


def _own_script(drawn: str) -> str:
    """Back to Cyrillic or Greek where a letter without a Latin twin shows that the token is written in it."""
    for first, last, rows in (("Ѐ", "ԯ", _SAME_SHAPE[:2]), ("Ͱ", "Ͽ", _SAME_SHAPE[2:3])):
        if any(first <= c <= last for c in drawn):
            back: dict[str, str] = {}
            for left, right in rows:
                for a, b in zip(left, right, strict=True):
                    if first <= a <= last and a != b:
                        back.setdefault(b, a)
            return "".join(back.get(c, c) for c in drawn)
    return drawn


def by_table(token: str) -> str:
    """The spelling of a token the vocabulary doesn't know: shapes by table, in the script its letters show."""
    return unicodedata.normalize("NFC", _own_script(_drawn(token)))


@lru_cache(1 << 17)
def canonical_token(token: str, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> str:
    """One spelling for all tokens of a look: the vocabulary's if it has one, else by the table."""
    known = trie(name, folder).spelling(token)
    return by_table(token) if known is None else unicodedata.normalize("NFC", known)


def canonical(text: str) -> str:
    """The text with every token in its one spelling and every kind of blank as a plain one.

    Two texts get the same result exactly if they look the same. Text of plain
    characters only is its own form; line breaks and tabs stay as they are.
    """
    if text.isascii():
        return text
    out = []
    for part in _PARTS.findall(text):
        if part.isascii():
            out.append(part)
        elif part.isspace():
            out.append("".join(" " if unicodedata.category(c) == "Zs" else c for c in part))
        else:
            out.append(canonical_token(part))
    return "".join(out)


def canonical_texts(documents: DataFrame, text: str = "text") -> DataFrame:
    """All rows with ``text`` in its canonical form; nulls stay null."""

    @F.pandas_udf("string")
    def one(texts):  # noqa: ANN001, ANN202
        return texts.map(canonical, na_action="ignore")

    return documents.withColumn(text, one(F.col(text)))


def _digest(text: str) -> bytes:
    return hashlib.blake2b(text.encode("utf-8", "surrogatepass"), digest_size=16).digest()


def look_digests(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, look, spelling): digests of 128 bits of the canonical form and of the text itself, in one map.

    Null texts and texts without a visible character are left out.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, looks, spellings = [], [], []
            for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                form = canonical(value)
                if form.isspace() or not form:
                    continue
                own = _digest(value)
                ids.append(key)
                spellings.append(own)
                looks.append(own if form == value else _digest(form))
            yield pa.RecordBatch.from_arrays([pa.array(ids, batch.schema.field(0).type), pa.array(looks, pa.binary()), pa.array(spellings, pa.binary())], names=["doc", "look", "spelling"])

    rows = documents.select(F.col(doc_id).alias("doc"), F.col(text).alias("text")).where("doc IS NOT NULL AND text IS NOT NULL")
    kind = rows.schema["doc"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc {kind}, look binary, spelling binary")


def same_looks(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b, of all documents that look the same and differ as strings.

    Copies of a text are counted before anything is joined: only looks with more than
    one spelling go on, spellings are paired with one another, and rows are multiplied
    only as the result demands it. Null texts and texts without a visible character
    are left out; repeated rows count once.
    """
    return pairs_of_spellings(look_digests(documents, doc_id, text))


def look_classes(documents: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, look_id, spellings): one row per document whose look has several spellings, however many share it.

    ``look_id`` is the least document of the look, ``spellings`` the number of texts
    that differ as strings. The form to take where a look is so common that its pairs
    would outgrow everything else.
    """
    from ..session import cut

    rows = cut(look_digests(documents, doc_id, text).distinct())
    spelled = rows.groupBy("look", "spelling").agg(F.min("doc").alias("least")).groupBy("look").agg(F.min("least").alias("look_id"), F.count("*").alias("spellings"))
    return rows.join(spelled.where("spellings > 1"), "look").select(F.col("doc").alias(doc_id), "look_id", "spellings")


def pairs_of_spellings(digests: DataFrame) -> DataFrame:
    """(doc_a, doc_b) from (doc, look, spelling): equal look, other spelling."""
    from ..session import cut

    digests = cut(digests)
    mixed = digests.groupBy("look").agg(F.min("spelling").alias("a"), F.max("spelling").alias("b")).where("a <> b").select("look")
    kept = digests.join(mixed, "look", "left_semi").distinct()
    spellings = kept.select("look", "spelling").distinct()
    other = spellings.withColumnRenamed("spelling", "other")
    pairs = spellings.join(other, "look").where("spelling < other").select("spelling", "other")
    left = kept.select(F.col("doc").alias("x"), "spelling")
    right = kept.select(F.col("doc").alias("y"), F.col("spelling").alias("other"))
    both = pairs.join(left, "spelling").join(right, "other")
    return both.where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()
