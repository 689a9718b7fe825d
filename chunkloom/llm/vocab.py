"""Files of public tokenizers; the folder is a parameter, nothing is copied."""

from __future__ import annotations

import base64
import os
from functools import lru_cache

#: Folder of the vocabulary files unless a caller names another one.
TOKENIZERS = os.environ.get("PUBLIC_TOKENIZERS", "/opt/tokenizers")

#: The public pre-token pattern of the vocabulary (fixed value).
PRE_TOKEN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


@lru_cache(4)
def ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """Ranks of a byte-level vocabulary, by its bytes."""
    with open(f"{folder}/{name}.tiktoken", "rb") as f:
        return {base64.b64decode(piece): int(rank) for piece, rank in map(bytes.split, f)}


@lru_cache(4)
def encoding(name: str = "byte_bpe_50k", folder: str = TOKENIZERS):
    """A tiktoken encoding of the vocabulary, built once a worker."""
    import tiktoken

    return tiktoken.Encoding(name, pat_str=PRE_TOKEN, mergeable_ranks=ranks(name, folder), special_tokens={})
