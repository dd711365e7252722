"""Ordinary byte-level BPE encoding by the tiktoken library, for texts with any white space.

The library's pattern engine overflows its stack on very long runs of white space. Such a
run is one pre-token (without its last character, if text follows, which then goes with
that text), so it is encoded as a single piece and the text around it as usual.
"""

from __future__ import annotations

import re
from collections.abc import Callable

import numpy as np
import tiktoken

from .bpe import PATTERN

LONG_SPACE = 1000        # characters of white space that are encoded as a piece of their own
_SPACES = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{%d,}" % LONG_SPACE)


def ordinary_encoder(ranks: dict[bytes, int]) -> Callable[[str], np.ndarray]:
    """``text -> ids`` (uint32) of a rank table; special tokens' strings are ordinary text."""
    encoding = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        parts, at = [], 0
        for run in _SPACES.finditer(text):
            parts.append(encoding.encode_ordinary(text[at:run.start()]))
            at = run.end() - (run.end() < len(text))
            parts.append(encoding._encode_single_piece(text[run.start():at]))
        parts.append(encoding.encode_ordinary(text[at:] if at else text))
        return np.array(parts[0] if len(parts) == 1 else [i for p in parts for i in p], np.uint32)

    return encode
