"""Byte-level BPE ids of whole texts, with a word cache.

A single space between two characters that are not white space always begins a
new piece of the pre-tokenizer, so a text can be cut there and each part encoded
on its own. Parts repeat, so their ids are kept; a text that cannot be cut this
way is encoded whole. Ids equal those of the ``tokenizers`` library with the
JSON file of the same vocabulary, its added tokens included (the tests compare them).
"""

from __future__ import annotations

import base64
import json
import re
from array import array

KEEP = 1_000_000  # parts kept per task; beyond it the cache starts anew, results are the same


def vocabulary_path(name: str) -> str:
    """Place of a public vocabulary file on the machine that calls."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """Ids as little-endian unsigned 32-bit bytes. ``path``: a rank file, found on the executor."""

    def __init__(self, name: str = "byte_bpe_50k.tiktoken", path: str | None = None) -> None:
        import public_tokenizers
        import tiktoken

        with open(path or vocabulary_path(name), "rb") as file:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, file)}
        encoding = tiktoken.Encoding(name, pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self._encode = encoding.encode_ordinary
        self._cache: dict[str, bytes] = {}
        with open((path or vocabulary_path(name)).removesuffix(".tiktoken") + ".json", encoding="utf-8") as file:
            self._added = {t["content"]: array("I", [t["id"]]).tobytes() for t in json.load(file)["added_tokens"]}
        self._cut = re.compile("(" + "|".join(map(re.escape, sorted(self._added, key=len, reverse=True))) + ")") if self._added else None

    def _whole(self, text: str) -> bytes:
        return array("I", self._encode(text)).tobytes()

    def __call__(self, text: str) -> bytes:
        if self._cut is None or not self._cut.search(text):
            return self._plain(text)
        parts = self._cut.split(text)  # an added token keeps its own id; what lies between is encoded on its own
        return b"".join(self._added[p] if i % 2 else self._plain(p) for i, p in enumerate(parts))

    def _plain(self, text: str) -> bytes:
        parts = text.split(" ")
        cache = self._cache
        known = list(map(cache.get, parts[1:]))
        if None in known:
            if len(cache) > KEEP:
                cache.clear()
            for i, ids in enumerate(known):
                if ids is None:
                    part = parts[i + 1]
                    if not part or part[0].isspace() or part[-1].isspace():
                        return self._whole(text)
                    known[i] = cache[part] = self._whole(" " + part)
        first = parts[0]
        if first == "" or first[-1].isspace():
            return self._whole(text)
        return self._whole(first) + b"".join(known)
