"""Token ids of whole corpora by a public byte-level vocabulary, through a sentencepiece model made from it."""

from __future__ import annotations

import struct
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .vocab import PRE_TOKEN, TOKENIZERS, ranks

#: Pre-tokens a worker remembers; a full cache is emptied, which costs time and changes nothing.
CACHED = 400_000


def byte_letters() -> list[str]:
    """A printable letter for every byte: itself where it prints, else the next letter from 256 on."""
    prints = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in prints]
    to = {b: chr(b) for b in prints} | {b: chr(256 + k) for k, b in enumerate(rest)}
    return [to[b] for b in range(256)]


def _field(number: int, value: bytes | int | float) -> bytes:
    """One protocol buffer field: a length-delimited, float or varint one by the value's type."""
    if isinstance(value, float):
        return _varint(number << 3 | 5) + struct.pack("<f", value)
    if isinstance(value, bytes):
        return _varint(number << 3 | 2) + _varint(len(value)) + value
    return _varint(number << 3) + _varint(value)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def model_bytes(vocabulary: dict[bytes, int]) -> bytes:
    """A serialised BPE model whose piece ids are the ranks.

    Pieces are the byte strings in byte letters with the negative rank as score, so
    that the best-scored pair is the one of the lowest rank. The normaliser is the
    identity: no prefix, no collapsed or escaped white space. The obligatory
    unknown piece gets the id behind the last rank and can't be reached, as all
    256 bytes are pieces.
    """
    letter = byte_letters()
    by_rank = sorted(vocabulary.items(), key=lambda x: x[1])
    if [r for _, r in by_rank] != list(range(len(by_rank))):
        raise ValueError("ranks must be consecutive from 0")
    pieces = [_field(1, _field(1, "".join(letter[b] for b in piece).encode()) + _field(2, float(-rank)) + _field(3, 1)) for piece, rank in by_rank]
    unknown = _field(1, _field(1, b"<unk>") + _field(2, 0.0) + _field(3, 2))
    trainer = _field(3, 2) + _field(4, len(by_rank) + 1) + _field(40, len(by_rank)) + _field(41, -1) + _field(42, -1) + _field(43, -1)
    normaliser = _field(1, b"identity") + _field(3, 0) + _field(4, 0) + _field(5, 0)
    return b"".join([*pieces, unknown, _field(2, trainer), _field(3, normaliser)])


class Codec:
    """Texts to ids and back by one vocabulary."""

    def __init__(self, name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> None:
        import regex
        import sentencepiece

        vocabulary = ranks(name, folder)
        self.model = sentencepiece.SentencePieceProcessor(model_proto=model_bytes(vocabulary))
        self.split = regex.compile(PRE_TOKEN).findall
        self.letters = dict(enumerate(byte_letters()))
        self.bytes = {v: k for k, v in self.letters.items()}
        self.known: dict[str, list[int]] = {}

    def encode(self, texts: Iterable[str | None]) -> list[list[list[int]]]:
        """For each text the id lists of its pre-tokens; none for an empty or a null text."""
        split = [self.split(t) if t else [] for t in texts]
        if len(self.known) > CACHED:
            self.known.clear()
        known = self.known
        new = [p for p in dict.fromkeys(chain.from_iterable(split)) if p not in known]
        mapped = [p.encode("utf-8").decode("latin-1").translate(self.letters) for p in new]
        known.update(zip(new, self.model.encode(mapped, out_type=int, num_threads=1), strict=True))
        return [[known[p] for p in pre] for pre in split]

    def decode(self, ids: Iterable[int]) -> str:
        """The text of ids by the inverse letters; bytes that are no UTF-8 become replacement characters."""
        text = "".join(self.model.id_to_piece(i) for i in map(int, ids))
        return bytes(self.bytes[c] for c in text).decode("utf-8", "replace")


@lru_cache(2)
def codec(name: str, folder: str) -> Codec:
    return Codec(name, folder)


def token_ids(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, ids array<int>) of every row, without special tokens.

    Null and empty texts give an empty list. Strings of special tokens are ordinary
    text. One row comes out for each that goes in, repeated ones too; other columns
    aren't read. The work is a map without a shuffle: rows stream through in batches
    of bounded size, and a text of any length is encoded whole.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = codec(name, folder)
        for whole in batches:
            for at in range(0, whole.num_rows, 512):
                batch = whole.slice(at, 512)
                lists = own.encode(batch.column(1).to_pylist())
                flat = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int32)
                sizes = np.fromiter((sum(map(len, pre)) for pre in lists), np.int64, len(lists))
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                ids = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], names=["doc_id", "ids"])

    rows = documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, ids array<int>")


def texts_of(tokens: DataFrame, doc_id: str = "doc_id", ids: str = "ids", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """(doc_id, text): the ids decoded; an empty or null list gives an empty text."""

    @F.pandas_udf("string")
    def decode(lists):  # noqa: ANN001, ANN202
        own = codec(name, folder)
        return lists.map(lambda x: "" if x is None else own.decode(x))

    return tokens.select(F.col(doc_id).alias("doc_id"), decode(F.col(ids)).alias("text"))
