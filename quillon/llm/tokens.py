"""Token ids of a public byte-level BPE vocabulary.

The two files hold one vocabulary for two libraries, which give equal ids; the faster one encodes, except texts that hold a special
token's string, whose ids the first library's file defines, and texts that the faster one can't encode: it panics on some million white
space characters in a row. One encoder is kept in each Python worker.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

JSON, RANKS = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")

#: A run of white space that the faster library isn't given, far below what it fails on.
LONG_SPACE = 100_000
_SPACES = re.compile(rf"\s{{{LONG_SPACE}}}")

_held: dict[tuple[str, str], Encoder] = {}


class Encoder:
    def __init__(self, json_path: str, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.whole = Tokenizer.from_file(json_path)
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]

    def ids(self, text: str | None) -> np.ndarray:
        if not text:
            return np.zeros(0, np.uint32)
        if not any(s in text for s in self.special) and not (len(text) >= LONG_SPACE and _SPACES.search(text)):
            try:
                return np.array(self.fast.encode_ordinary(text), np.uint32)
            except (KeyboardInterrupt, SystemExit, MemoryError):
                raise
            except BaseException:  # noqa: BLE001  a panic of the library is no Exception
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


def encoder(json_path: str = JSON, ranks_path: str = RANKS) -> Encoder:
    key = (json_path, ranks_path)
    if key not in _held:
        _held[key] = Encoder(*key)
    return _held[key]
