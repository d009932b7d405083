"""Public tokenizers, opened once per Python worker (``path`` is a parameter)."""

from __future__ import annotations

import base64
import functools
import os
from collections.abc import Callable

import numpy as np


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@functools.cache
def byte_pair_encoder(path: str) -> Callable[[str], np.ndarray]:
    """Token ids as ``tokenizers`` gives them for the byte-level BPE at
    ``path`` (a .json).  The merges run in tiktoken, on the ranks beside the
    file, where those exist: equal ids (see the tests) at several times the
    speed; otherwise the file's own library."""
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(path)
    ranks_file = os.path.splitext(path)[0] + ".tiktoken"
    if not os.path.exists(ranks_file):
        return lambda text: np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
    import public_tokenizers
    import tiktoken

    with open(ranks_file, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    special = {t.content: i for i, t in own.get_added_tokens_decoder().items()}
    fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if any(s in text for s in special):
            return np.array(own.encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        return fast.encode_to_numpy(text, disallowed_special=())

    return encode


@functools.cache
def sentence_pieces(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)
