"""Token ids of whole texts by a byte-level BPE file of the ``tokenizers`` library.

The merges of such a file are applied by ``tiktoken``, whose ranks are the file's
own vocabulary: it gives the same ids several times faster.  A text that holds
one of the file's special tokens literally, and any text the fast encoder
refuses, goes through ``tokenizers`` itself.
"""

from __future__ import annotations

import functools
import json

import numpy as np

#: Fixed value: the public pattern that byte-level BPE files of this kind split text with.
SPLIT = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


def _byte_alphabet() -> dict[str, int]:
    """The characters that byte-level vocabularies write bytes with: printable ones stand for themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


class ByteBpe:
    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self._slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or (spec.get("pre_tokenizer") or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} is not a byte-level BPE file")
        self.specials = [t["content"] for t in spec.get("added_tokens", [])]
        alphabet = _byte_alphabet()
        self.bytes_of = {
            i: bytes(alphabet[c] for c in token)
            for token, i in spec["model"]["vocab"].items()
            if token not in self.specials
        }
        ranks = {b: i for i, b in self.bytes_of.items()}
        self._fast = tiktoken.Encoding("byte-level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.size = max(self.bytes_of) + 1 + len(self.specials)

    def ids(self, text: str) -> np.ndarray:
        """Ids of a whole text, without special tokens added (little-endian unsigned 32 bit)."""
        if not any(s in text for s in self.specials):
            try:
                return self._fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False)
            except (ValueError, RuntimeError, UnicodeError):
                pass
        return np.array(self._slow.encode(text, add_special_tokens=False).ids, "<u4")

    def sentence_ends(self) -> np.ndarray:
        """By id: whether its token closes a sentence or a line."""
        ends = np.zeros(self.size, bool)
        for i, b in self.bytes_of.items():
            ends[i] = b"\n" in b or b.rstrip(b"\"')]").endswith((b".", b"!", b"?"))
        return ends


@functools.lru_cache(maxsize=4)
def load(path: str) -> ByteBpe:
    """The tokenizer of a file, read once a Python worker."""
    return ByteBpe(path)
