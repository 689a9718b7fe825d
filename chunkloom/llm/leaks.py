"""Evaluation texts in training text: q-gram lemma filtering in diagonal bands, then banded alignment."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Characters of a q-gram.
Q = 10
#: Consecutive words that make a leak.
WORDS = 12
#: q-grams of a text that are looked up at a time, besides the length of the longest item.
WINDOW = 1 << 15
#: Characters of item text that one pass over the documents carries; more items take more passes.
BLOCK_CHARS = 16_000_000

_NO_WORD = re.compile(r"[\W_]+")
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def plain_words(text: str) -> str:
    """The words of a text (runs of letters and digits) in lower case, one blank before each and one after the last."""
    return f" {_NO_WORD.sub(' ', text.lower()).strip()} "


def gram_codes(letters: np.ndarray, q: int = Q) -> np.ndarray:
    """A 64-bit code of the q-gram at every place of an array of code points."""
    n = len(letters) - q + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    code = np.zeros(n, np.uint64)
    for k in range(q):
        code *= _MULTIPLIER
        code += letters[k : k + n]
    code ^= code >> np.uint64(29)
    code *= _MIX
    return code


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.uint64)


class Items:
    """The q-grams of a block of items, with the bound each item's regions must meet."""

    def __init__(self, items: list[tuple], words: int = WORDS, edits: int = 0, q: int = Q) -> None:
        self.words, self.edits = words, edits
        self.ids, self.texts, self.bounds = [], [], []
        codes, owners, places, shortest = [], [], [], []
        for key, text in items:
            plain = plain_words(text or "")
            starts = [m.start() for m in re.finditer(" ", plain)]
            if len(starts) <= words:
                continue
            self.ids.append(key)
            self.texts.append(plain)
            shortest.append(min(b - a for a, b in zip(starts, starts[words:], strict=False)) + 1)
        # Short passages take shorter q-grams, so that the bound of the lemma stays above zero.
        self.q = q = max(1, min([q, *(m // (edits + 1) for m in shortest)]))
        for k, plain in enumerate(self.texts):
            own = gram_codes(_points(plain), q)
            codes.append(own)
            owners.append(np.full(len(own), k, np.int64))
            places.append(np.arange(len(own), dtype=np.int64))
            # The lemma: m characters with e edits share at least m + 1 - q (e + 1) q-grams.
            self.bounds.append(max(1, shortest[k] + 1 - q * (edits + 1)))
        self.longest = max(map(len, self.texts), default=0)
        flat = np.concatenate(codes) if codes else np.empty(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.codes = flat[order]
        self.owners = np.concatenate(owners)[order] if codes else np.empty(0, np.int64)
        self.places = np.concatenate(places)[order] if codes else np.empty(0, np.int64)
        self.bits = min(26, max(16, int(len(flat)).bit_length() + 5))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.codes >> np.uint64(64 - self.bits)).astype(np.int64)] = True

    def regions(self, letters: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(item, least diagonal, greatest diagonal) of the bands that share enough q-grams with a text.

        The text is taken in windows that overlap by the longest item, in one of which
        each region lies whole; so what is held doesn't grow with the text. A region may
        come more than once.
        """
        codes = gram_codes(letters, self.q)
        reach = self.longest + self.edits + 1
        for start in range(0, max(1, len(codes) - reach), WINDOW):
            yield from self._regions(codes[start : start + WINDOW + reach], start, len(letters))

    def _regions(self, codes: np.ndarray, start: int, length: int) -> Iterator[tuple[int, int, int]]:
        at = np.flatnonzero(self.filter[(codes >> np.uint64(64 - self.bits)).astype(np.int64)])
        if not len(at):
            return
        low = np.searchsorted(self.codes, codes[at], "left")
        count = np.searchsorted(self.codes, codes[at], "right") - low
        at, low, count = at[count > 0] + start, low[count > 0], count[count > 0]
        if not len(at):
            return
        pick = np.repeat(low - np.concatenate([[0], np.cumsum(count)[:-1]]), count) + np.arange(count.sum())
        owner, diagonal = self.owners[pick], np.repeat(at, count) - self.places[pick]
        width = 2 * (self.edits + 1)
        shift = length + width  # keeps band numbers positive
        longest = self.longest + width
        span = (shift + longest) // width + 2
        for half in (0, width // 2):  # each region of edits + 1 diagonals lies whole in one of the two
            key = owner * span + (diagonal + longest + half) // width
            bands, counts = np.unique(key, return_counts=True)
            for band in bands[counts >= np.asarray(self.bounds)[bands // span]]:
                least = int(band % span) * width - longest - half
                yield int(band // span), least, least + width - 1

    def near(self, item: int, letters: np.ndarray, low: int, high: int) -> bool:
        """Whether ``words`` consecutive words of the item stand in the text near the diagonals low to high with at most ``edits`` characters put in, left out or changed.

        A banded alignment of each such passage of the item: its cells are the
        characters of the passage times the diagonals of the band, widened by the edits.
        """
        plain = self.texts[item]
        own = _points(plain)
        starts = [m.start() for m in re.finditer(" ", plain)]
        slack = self.edits
        first = low - slack
        band = np.arange(first, high + slack + 1)
        far = np.iinfo(np.int32).max // 2
        for a, b in zip(starts, starts[self.words :], strict=False):
            cost = np.zeros(len(band), np.int32)
            for k in range(a, b + 1):
                at = k + band
                inside = (at >= 0) & (at < len(letters))
                equal = np.zeros(len(band), bool)
                equal[inside] = letters[at[inside]] == own[k]
                step = cost + np.where(inside, ~equal, far)  # the same or another letter
                left_out = np.append(cost[1:], far) + 1
                now = np.minimum(step, left_out)
                # A letter put in costs one a diagonal: the least of all before, by their distance.
                cost = np.minimum.accumulate(now - np.arange(len(band))) + np.arange(len(band))
                if cost.min() > slack:
                    break
            else:
                return True
        return False

    def aligned(self, item: int, text: str, low: int, high: int) -> bool:
        """Whether a run of at least ``words`` words of the item stands in ``text`` near the diagonals low to high, letter by letter.

        The alignment without edits, over words: a word of the item is set against the
        words of the text whose start differs by the band's diagonals; the run is broken
        by any other word.
        """
        plain = self.texts[item]
        row: dict[int, int] = {}
        place = 0
        while place < len(plain) - 1:
            end = plain.index(" ", place + 1)
            word = plain[place : end + 1]
            now: dict[int, int] = {}
            for start in range(max(0, place + low), place + high + 1):
                if text.startswith(word, start):
                    run = now[start + len(word) - 1] = row.get(start, 0) + 1
                    if run >= self.words:
                        return True
            row, place = now, end
        return False

    def leaked(self, text: str | None) -> list:
        """Ids of the items that leaked into a text."""
        if not text:
            return []
        plain = plain_words(text)
        found: set[int] = set()
        letters = _points(plain)
        for item, low, high in self.regions(letters):
            if item not in found and (self.near(item, letters, low, high) if self.edits else self.aligned(item, plain, low, high)):
                found.add(item)
        return [self.ids[i] for i in sorted(found)]


def _blocks(items: DataFrame, chars: int) -> Iterator[list[tuple]]:
    """The items in blocks of bounded text, taken to the driver one partition at a time."""
    block, size = [], 0
    for row in items.toLocalIterator():
        block.append((row[0], row[1]))
        size += len(row[1] or "")
        if size >= chars:
            yield block
            block, size = [], 0
    if block:
        yield block


def leaks(documents: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", words: int = WORDS, block_chars: int = BLOCK_CHARS, edits: int = 0) -> DataFrame:
    """(doc_id, item_id): the document holds ``words`` consecutive words of the item, with at most ``edits`` characters changed, put in or left out, without repeats.

    The item set is the stated query set: it goes to the tasks in blocks of at most
    ``block_chars`` characters and all documents stream past each block, so neither
    side is shuffled. Null or short items and null texts match nothing; a text of
    any length is searched whole; repeated rows are reported once.
    """
    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).where("text IS NOT NULL")
    wanted = items.select(F.col(item_id), F.col(item_text)).where(F.col(item_text).isNotNull()).distinct()
    kinds = rows.schema["doc_id"].dataType.simpleString(), items.schema[item_id].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}"
    context = documents.sparkSession.sparkContext
    out = None
    for block in _blocks(wanted, block_chars):
        sent = context.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:  # noqa: ANN001
            own = Items(sent.value, words, edits)
            for batch in batches:
                docs, found = [], []
                for key, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                    for item in own.leaked(value):
                        docs.append(key)
                        found.append(item)
                if docs:
                    yield pa.RecordBatch.from_pydict({"doc_id": docs, "item_id": found})

        part = rows.mapInArrow(run, schema)
        out = part if out is None else out.unionByName(part)
    return out.distinct() if out is not None else documents.sparkSession.createDataFrame([], schema)
