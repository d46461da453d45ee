"""Byte-level BPE ids of whole texts.

The vocabulary file ``byte_bpe_50k`` exists for two libraries with equal ids; texts are encoded with the
faster one (tests compare the two). Files are read on the executors and never copied. Strings of special
tokens inside a text are ordinary text.
"""

from __future__ import annotations

import base64
import functools

import numpy as np

DEFAULT_VOCABULARY = "byte_bpe_50k.tiktoken"


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def vocabulary(name: str = DEFAULT_VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def ids_of(text: str | None, path: str) -> np.ndarray:
    """Ids of one text (null: none)."""
    return np.asarray(encoder(path).encode_ordinary(text or ""), dtype=np.uint32)
