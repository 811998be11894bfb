"""Ids of a byte-level BPE vocabulary, equal to what the tokenizers library gives."""

from __future__ import annotations

import base64
import json
import re
from array import array
from functools import cached_property, lru_cache

import numpy as np
import public_tokenizers

#: Letters, marks and signs on which all Unicode versions of the two libraries agree about the pattern's classes.
SETTLED = re.compile("[^\x00-\x1b\x20-\x84\x86-ȳ‐-‧‰-⁞]")


#: White space of so many characters: the pattern tries each of them again there, and several hundred thousand are beyond tiktoken.
LONG_SPACE = re.compile("\\s{4096}")


class Ids:
    """ids(text) as the tokenizers library gives them without added special tokens, special strings in a text handled as is its default.

    The same ranks under tiktoken are several times faster. A text with a special string, with characters outside the settled
    ranges, or with very long white space goes to the tokenizers library itself."""

    def __init__(self, json_path: str, ranks_path: str):
        import tiktoken

        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.fast = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        with open(json_path, "rb") as f:
            model = json.load(f)
        self.special = tuple(t["content"] for t in model["added_tokens"])
        self.size = max(*model["model"]["vocab"].values(), *(t["id"] for t in model["added_tokens"])) + 1
        self.json_path = json_path

    @cached_property
    def slow(self):
        """The library itself, loaded by the first text that needs it."""
        from tokenizers import Tokenizer

        found = Tokenizer.from_file(self.json_path)
        found.no_truncation()
        found.no_padding()
        return found

    def ids(self, text: str) -> np.ndarray:
        if SETTLED.search(text) or LONG_SPACE.search(text) or any(s in text for s in self.special):
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4")
        return np.frombuffer(array("I", self.fast.encode_ordinary(text)), "<u4")


@lru_cache(maxsize=1)
def ids_of(vocabulary: str = "byte_bpe_50k") -> Ids:
    return Ids(public_tokenizers.path(f"{vocabulary}.json"), public_tokenizers.path(f"{vocabulary}.tiktoken"))
