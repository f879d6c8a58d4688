"""Token ids of a public vocabulary file, inside tasks."""

from __future__ import annotations

import base64
import os
from functools import cache

import numpy as np


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Ids as the ``tokenizers`` file at ``path`` gives them without added special tokens.

    Where the same vocabulary lies beside it as ranks (``.tiktoken``), those give the same ids four times as fast; a text that
    holds the string of a special token goes to ``tokenizers``, which reads it as that token.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.whole = Tokenizer.from_file(path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ranks = f"{path.removesuffix('.json')}.tiktoken"
        self.fast = None
        if os.path.exists(ranks):
            import public_tokenizers
            import tiktoken

            with open(ranks, "rb") as lines:
                of = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
            self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=of, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.empty(0, np.uint32)
        if self.fast is None or any(s in text for s in self.special):
            return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)
        return np.array(self.fast.encode_ordinary(text), np.uint32)


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)


def pieces(length: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of one document: whole if it fits, else full pieces behind a shorter first one."""
    if length <= capacity:
        return [(0, length)]
    first = length % capacity
    return ([(0, first)] if first else []) + [(at, capacity) for at in range(first, length, capacity)]
