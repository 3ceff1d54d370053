"""Token ids of the public byte-level BPE vocabulary, as the tokenizers library gives them.

`Encoder` uses the same vocabulary as merge ranks, and treats the special token's string in a
text as that token.
"""

from __future__ import annotations

import base64
import re

import numpy as np
import public_tokenizers
import tiktoken

VOCABULARY = "byte_bpe_50k"
SPECIAL, SPECIAL_ID = "<|endoftext|>", 50256
#: Long runs of white space (Unicode's, as the splitting pattern sees it), which the pattern would
#: match by one step of backtracking for each character.
_RUN = re.compile("[\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]{4096,}")
_made: dict[str, Encoder] = {}


def encoder(name: str = VOCABULARY) -> Encoder:
    """One encoder for each Python worker."""
    if name not in _made:
        _made[name] = Encoder(public_tokenizers.path(f"{name}.tiktoken"))
    return _made[name]


class Encoder:
    def __init__(self, ranks_path: str):
        with open(ranks_path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.plain = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.bytes_of = [b""] * (max(ranks.values()) + 2)
        for token, i in ranks.items():
            self.bytes_of[i] = token
        self.bytes_of[SPECIAL_ID] = SPECIAL.encode()
        self.sizes = np.array([len(x) for x in self.bytes_of], np.int64)

    def ids(self, text: str) -> bytes:
        """Ids of a text as little-endian unsigned 32-bit integers."""
        if SPECIAL in text:
            mark = np.array([SPECIAL_ID], "<u4").tobytes()
            return mark.join(self.raw(x).tobytes() for x in text.split(SPECIAL))
        return self.raw(text).tobytes()

    def raw(self, text: str) -> np.ndarray:
        """Ids of a text in which the special token's string is ordinary text."""
        found = []
        start = 0
        for m in _RUN.finditer(text):
            # a run is one piece, but for its last character if anything follows
            end = m.end() - (m.end() < len(text))
            found += self.plain.encode_ordinary(text[start : m.start()])
            found += self.plain._encode_single_piece(text[m.start() : end])
            start = end
        found += self.plain.encode_ordinary(text[start:] if start else text)
        return np.array(found, "<u4")

    def decode(self, ids: bytes) -> str:
        of = self.bytes_of
        return b"".join([of[i] for i in np.frombuffer(ids, "<u4").tolist()]).decode("utf-8", "replace")
