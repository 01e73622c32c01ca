"""Public tokenizers by path; nothing is trained or copied here."""

from __future__ import annotations

import base64
import functools
from array import array

#: Where the vocabulary lies on every executor; each operator takes another path as a parameter.
TOKENIZER = "/opt/tokenizers/byte_bpe_multi_50k.tiktoken"
#: An id that the vocabulary leaves free; it ends each packed document.
END_ID = 50256
#: The vocabulary's own split pattern with possessive repeats: the same pieces, found faster.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}++| ?\p{N}++| ?[^\s\p{L}\p{N}]++|\s++$|\s+(?!\S)|\s"


@functools.lru_cache(2)
def encoder(path: str):
    """The byte-level BPE of a file of base64 ranks."""
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    return tiktoken.Encoding("vocabulary", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@functools.lru_cache(2)
def id_kind(path: str = TOKENIZER) -> str:
    """How an id is written: in two bytes if all ids and the free one after them fit, else in four."""
    return "H" if encoder(path).max_token_value < (1 << 16) - 1 else "I"


def encode(text: str | None, path: str = TOKENIZER) -> array:
    """The ids of a text as unsigned integers of ``id_kind(path)``; none for null and empty texts."""
    return array(id_kind(path), encoder(path).encode_ordinary(text)) if text else array(id_kind(path))


def decode(ids, path: str = TOKENIZER) -> str:
    return encoder(path).decode_bytes([int(i) for i in ids]).decode("utf-8", "replace")
