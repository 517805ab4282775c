"""Token ids of whole texts by a byte-level BPE file."""

from __future__ import annotations

import base64
import os
import re
from array import array


def hugging(path: str):
    """The tokenizers library's encoder of a file, with its default treatment of special strings, uncut and unpadded."""
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.no_truncation()
    tok.no_padding()
    return tok


def specials(tok) -> set[str]:
    return {t.content for t in tok.get_added_tokens_decoder().values()}


def any_of(strings: set[str]) -> re.Pattern:
    return re.compile("|".join(map(re.escape, sorted(strings))) or r"(?!)")


def ranked(path: str, pattern: str):
    """tiktoken's encoder of a ranks file that holds the same vocabulary: ids of a text without special strings."""
    import tiktoken

    with open(path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("same", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary


class IdEncoder:
    """Ids as native 32-bit values in bytes.

    With ``ranks``, tiktoken merges what holds no special string: it has the same vocabulary and pattern (tests compare
    them code point by code point) and is about three times as fast.  Texts with a special string, and all texts if no ranks
    are given, go to the tokenizers library.
    """

    def __init__(self, path: str, ranks: str | None, pattern: str | None):
        self.hf = hugging(path)
        self.special = any_of(specials(self.hf)).search
        self.fast = ranked(ranks, pattern) if ranks else None

    def ids(self, text: str) -> bytes:
        if self.fast and not self.special(text):
            return array("I", self.fast(text)).tobytes()
        return array("I", self.hf.encode(text, add_special_tokens=False).ids).tobytes()


_encoders: dict = {}


def id_encoder(path: str, ranks: str | None, pattern: str | None) -> IdEncoder:
    """One encoder for each Python worker."""
    key = (path, ranks, pattern)
    if key not in _encoders:
        _encoders[key] = IdEncoder(*key)
    return _encoders[key]
