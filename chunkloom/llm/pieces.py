"""Oversized items cut at natural boundaries, with overlap."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrow import flat_rows

#: Bytes of UTF-8 that a piece of a chunk and of a section may have, and that it may share with the one before.
CHUNK_LIMIT, SECTION_LIMIT, OVERLAP = 1500, 3000, 200

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?;"]] = True


def boundaries(data: np.ndarray) -> list[np.ndarray]:
    """Sorted byte offsets at which a piece may begin, best kind first: paragraphs, lines, sentences, words, characters."""
    n = len(data)
    space = _SPACE[data]
    words = np.flatnonzero(space[:-1] & ~space[1:]) + 1
    breaks = np.flatnonzero(data == 10) + 1
    lines = breaks[breaks < n]
    starts = np.concatenate([[0], breaks])
    # A line is blank if no visible byte lies in it: the running number of visible bytes stands still.
    seen = np.concatenate([[0], np.cumsum(~space)])
    blank = seen[starts[1:]] == seen[starts[:-1]]
    paragraphs = starts[1:][blank]
    paragraphs = paragraphs[paragraphs < n]
    ends = words[_STOP[data[_last_visible(space, words)]]] if len(words) else words
    wide = np.flatnonzero((data[:-2] == 0xE3) & (data[1:-1] == 0x80) & (data[2:] == 0x82)) + 3 if n > 2 else np.empty(0, np.int64)
    full = np.flatnonzero((data[:-2] == 0xEF) & (data[1:-1] == 0xBC) & ((data[2:] == 0x81) | (data[2:] == 0x9F))) + 3 if n > 2 else np.empty(0, np.int64)
    sentences = np.unique(np.concatenate([ends, wide[wide < n], full[full < n]]))
    characters = np.flatnonzero((data & 0xC0) != 0x80)
    characters = characters[(characters == 0) | ~((data[characters - 1] == 13) & (data[characters] == 10))]
    return [paragraphs, lines, sentences, words, characters]


def _last_visible(space: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Offset of the last byte before each word start that isn't white space."""
    at = np.where(space, 0, np.arange(len(space)))
    return np.maximum.accumulate(at)[words - 1]


def cut(data: np.ndarray, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Byte ranges (start, end) of the pieces of a text, each of at most ``limit`` bytes.

    Of each kind of boundary the last one under the limit is found by binary
    search; the best kind that fills half the limit is taken, and a text without
    any is cut hard between two characters. The next piece starts at the first word,
    or else character, within ``overlap`` bytes before the cut.
    """
    n = len(data)
    if n <= limit:
        return [(0, n)]
    if not 0 <= overlap <= limit // 3 or limit < 16:
        raise ValueError("overlap must be at most a third of a limit of 16 or more bytes")
    kinds = boundaries(data)
    out, start = [], 0
    while n - start > limit:
        end = 0
        for kind in kinds:
            at = int(np.searchsorted(kind, start + limit, "right")) - 1
            if at >= 0 and kind[at] > start + (limit // 2 if kind is not kinds[-1] else 0):
                end = int(kind[at])
                break
        if not end:  # no character begins in the second part of the window: the bytes are no UTF-8
            end = start + limit
        out.append((start, end))
        start = end
        if overlap:
            for kind in (kinds[3], kinds[4]):
                at = int(np.searchsorted(kind, end - overlap, "left"))
                if at < len(kind) and kind[at] < end:
                    start = int(kind[at])
                    break
    out.append((start, n))
    return out


def oversized(chunks: DataFrame, outputs: DataFrame, chunk_limit: int = CHUNK_LIMIT, section_limit: int = SECTION_LIMIT) -> DataFrame:
    """(item_kind, item_id, item_pos, content, start_line, end_line, bound) of the items over their limit.

    Sizes are compared before a text leaves its scan. A repeated row gives its items
    again, with the same pieces, so queries take distinct rows. Null contents and
    arrays give nothing.
    """
    from_chunks = chunks.where(F.octet_length("content") > chunk_limit).select(
        F.lit("chunk").alias("item_kind"), F.col("chunk_id").cast("string").alias("item_id"), F.lit(0).alias("item_pos"), "content", "start_line", "end_line", F.lit(chunk_limit).alias("bound")
    )
    sections = outputs.select(F.col("output_id").cast("string").alias("item_id"), F.posexplode(F.col("sections.content")).alias("item_pos", "content"))
    from_sections = sections.where(F.octet_length("content") > section_limit).select(
        F.lit("section").alias("item_kind"), "item_id", "item_pos", "content", F.lit(None).cast("int").alias("start_line"), F.lit(None).cast("int").alias("end_line"), F.lit(section_limit).alias("bound")
    )
    return from_chunks.unionByName(from_sections)


def pieces(items: DataFrame, overlap: int = OVERLAP, texts: bool = True) -> DataFrame:
    """Ordered pieces of the items over their bound.

    (item_kind, item_id, item_pos, piece_no, pieces, start_byte, end_byte, shared,
    start_line, end_line, piece): ``shared`` bytes are those of the piece before. A
    piece of a chunk carries the lines it covers, counted from the chunk's first;
    lines are null where they were null, and (0, 0) where the range was lost.
    """

    def one(kind: str, key: str, pos: int, content: str, first: int | None, last: int | None, bound: int) -> Iterator[tuple]:
        data = np.frombuffer(content.encode("utf-8", "surrogatepass"), np.uint8)
        spans = cut(data, bound, overlap)
        lost = first is None or first == 0 and not last
        before = np.concatenate([[0], np.cumsum(data == 10)])
        until = 0
        for k, (a, b) in enumerate(spans):
            start = first if lost else first + int(before[a])
            end = last if lost else first + int(before[max(a, b - 1)])
            yield kind, key, pos, k, len(spans), a, b, max(0, until - a), start, end, bytes(data[a:b]).decode("utf-8", "replace") if texts else None
            until = b

    schema = "item_kind string, item_id string, item_pos int, piece_no int, pieces int, start_byte int, end_byte int, shared int, start_line int, end_line int, piece string"
    return flat_rows(items, ["item_kind", "item_id", "item_pos", "content", "start_line", "end_line", "bound"], schema, one)
