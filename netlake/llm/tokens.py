"""Token ids of a byte-level BPE vocabulary; tokenizer files are found by path and never copied."""
from __future__ import annotations

import base64
from functools import lru_cache

import numpy as np


class Tokeniser:
    """Ids of the ``tokenizers`` file at ``json_path`` without added special tokens.

    ``ranks_path`` may name the same vocabulary as ``tiktoken`` ranks (with the
    split ``pattern``): the ids are equal and come several times faster.  Texts
    that hold a special token's string always go through ``tokenizers``.
    """

    def __init__(self, json_path: str, ranks_path: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(json_path)
        self._special = [t.content for t in self._slow.get_added_tokens_decoder().values()]
        self._fast = None
        if ranks_path:
            import tiktoken

            with open(ranks_path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            self._fast = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})

    def ids(self, text: str | None) -> np.ndarray:
        """Ids as unsigned 32-bit integers; none for null or empty text."""
        if not text:
            return np.zeros(0, np.uint32)
        if self._fast is None or any(s in text for s in self._special):
            return np.array(self._slow.encode(text, add_special_tokens=False).ids, np.uint32)
        return self._fast.encode_to_numpy(text, disallowed_special=())


@lru_cache(maxsize=4)
def tokeniser(json_path: str, ranks_path: str | None = None, pattern: str | None = None) -> Tokeniser:
    """One tokeniser per worker process and file."""
    return Tokeniser(json_path, ranks_path, pattern)


def public_bpe() -> tuple[str, str, str]:
    """Paths and pattern of the public 50k byte-level vocabulary (the default of the registered queries)."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN
