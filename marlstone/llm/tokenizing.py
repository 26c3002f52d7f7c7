"""Token ids of a byte-level BPE vocabulary file, at the speed a whole corpus needs.

The vocabulary is read from the JSON file of the ``tokenizers`` library. Ids are
made by ``tiktoken`` from the same vocabulary, which gives the same ids about
five times as fast; texts it refuses go to ``tokenizers`` itself. Texts are cut at
strings of added tokens, which have ids of their own, as in the library.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable
from functools import lru_cache

import numpy as np

# fixed values of the byte-level BPE format: how it splits text, and the bytes that stand for themselves in the file
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
PLAIN = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]


def byte_of_character() -> dict[str, int]:
    out = {chr(b): b for b in PLAIN}
    others = [b for b in range(256) if chr(b) not in out]
    return out | {chr(256 + i): b for i, b in enumerate(others)}


@lru_cache(maxsize=2)
def encoder(path: str) -> Callable[[str], np.ndarray]:
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    added = spec.get("added_tokens", [])
    special = {t["content"]: t["id"] for t in added}
    cut = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
    # tokens that look at what is around them, or that may meet in normalized text, are left to the library
    simple = not spec.get("normalizer") and not any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip"))
    of = byte_of_character()
    ranks = {bytes(of[c] for c in token): number for token, number in spec["model"]["vocab"].items() if token not in special}
    fast = tiktoken.Encoding("byte_level", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def encode(text: str) -> np.ndarray:
        if cut is None or not cut.search(text):
            return plain(text)
        if not simple:
            return np.array(slow(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)
        parts = [np.array([special[part]], dtype=np.uint32) if i % 2 else plain(part) for i, part in enumerate(cut.split(text))]
        return np.concatenate(parts)

    def plain(text: str) -> np.ndarray:
        try:
            return np.array(fast.encode_ordinary(text), dtype=np.uint32)
        except BaseException as e:  # the splitter gives up on very long runs of space with a panic, which is no Exception
            if type(e).__name__ not in ("PanicException", "ValueError", "RuntimeError"):
                raise
            return np.array(slow(path).encode(text, add_special_tokens=False).ids, dtype=np.uint32)

    return encode


@lru_cache(maxsize=2)
def slow(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)
