"""Token ids of whole texts by a public tokenizer file, in the form the ``tokenizers`` library reads.

Where the file holds a plain byte-level BPE whose merges stand in the order of their ids, the same merges are applied by a faster library
(about four times, with equal ids: the tests compare them). Any other file, and any text that contains a special token's string or a very long run
without a space, is encoded by ``tokenizers`` itself.
"""

from __future__ import annotations

import json
import os
import re
from functools import lru_cache

import numpy as np

# Fixed value: the pattern by which byte-level tokenizers cut a text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_LONG = re.compile(r"[^ ]{4000}| {4000}")


def _byte_of() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: itself if printable in Latin-1, else 256 and on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def _ranks(spec: dict) -> dict[bytes, int] | None:
    """Ranks of a plain byte-level BPE, or None if the file is of another kind."""
    model, pre = spec["model"], spec.get("pre_tokenizer") or {}
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
    if not plain or spec.get("normalizer") or pre.get("type") != "ByteLevel" or pre.get("add_prefix_space") or not pre.get("use_regex", True):
        return None
    byte, added = _byte_of(), {t["content"] for t in spec.get("added_tokens", [])}
    ranks = {bytes(byte[c] for c in t): i for t, i in model["vocab"].items() if t not in added}
    merged = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    ids = [model["vocab"][t] for t in merged]
    in_order = all(a < b for a, b in zip(ids, ids[1:], strict=False)) and len(ids) + 256 == len(ranks) and all(bytes([b]) in ranks for b in range(256))
    return ranks if in_order else None


class Encoder:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        added = sorted((t["content"] for t in spec.get("added_tokens", [])), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, added))) if added else None
        self.fast = None
        if ranks := _ranks(spec):
            import tiktoken

            self.fast = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})._core_bpe

    def __call__(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian unsigned 32-bit bytes; no special tokens are added."""
        return [self.one(t) for t in texts]

    def one(self, text: str) -> bytes:
        if self.fast is None or self.special and self.special.search(text) or len(text) >= 4000 and _LONG.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        ids = self.fast.encode_to_tiktoken_buffer(text, set())
        return ids if isinstance(ids, bytes) else bytes(ids)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
