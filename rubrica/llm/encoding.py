"""Encoding texts with the public tokenizers, fast enough for whole corpora.

A tokenizer file is named by its path; by default it is the one the installed `public_tokenizers` module gives.
"""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

#: The word tokenizer lower-cases and cuts at white space, so the ids of a text are those of its chunks in a row.
#: This holds for the characters below U+0180; texts with others, or with its special tokens, are encoded whole.
ODD = re.compile("[\x1c-\x1fƀ-\U0010ffff]")
LETTER, NUMBER = "a-zªµºß-öø-ſ", "0-9²³¹¼½¾"
#: How the tokenizer cuts a chunk into words, for these characters.
WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[{NUMBER}]|[^\t-\r \x85\xa0{LETTER}{NUMBER}]+")
#: Words, and chunks, remembered in each of two generations at most.
REMEMBERED = 250_000


class _Memory(dict):
    """What was computed lately: two generations, of which the older one goes when the newer one is full, so that what
    is used often stays and a worker's memory is bounded."""

    def __init__(self):
        self.older: dict = {}

    def __missing__(self, key: str) -> bytes:
        value = self.older.get(key)
        if value is None:
            value = self.compute(key)
        if len(self) >= REMEMBERED:
            self.older = dict(self)
            self.clear()
        self[key] = value
        return value


class _Words(_Memory):
    def __init__(self, tokenizer):
        from tokenizers import pre_tokenizers

        super().__init__()
        self.model = tokenizer.model
        as_bytes = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.mapped = {c: as_bytes.pre_tokenize_str(chr(c))[0][0] for c in range(0x180)}

    def compute(self, word: str) -> bytes:
        mapped = word if word.isascii() and word.isprintable() else word.translate(self.mapped)
        return array("H", [t.id for t in self.model.tokenize(mapped)]).tobytes()


class _Chunks(_Memory):
    def __init__(self, tokenizer):
        super().__init__()
        self.words = _Words(tokenizer)

    def compute(self, chunk: str) -> bytes:
        words = self.words
        if chunk.isascii() and chunk.isalpha():
            return words.compute(chunk)  # one word, remembered as a chunk
        return b"".join([words[w] for w in WORDS.findall(chunk)])


class WordEncoder:
    """Ids of `word_bpe_49k.json` as little-endian 16-bit bytes; equal to the tokenizer's own, word by word from memory."""

    def __init__(self, path: str | None = None):
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("word_bpe_49k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.chunks = _Chunks(self.tokenizer)

    def encode(self, text: str) -> bytes:
        if "<|" in text or ODD.search(text):
            return array("H", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        return b"".join(map(self.chunks.__getitem__, text.lower().split()))


@lru_cache(maxsize=1)
def word_encoder(path: str | None = None) -> WordEncoder:
    """The encoder of this worker, kept with its memory from task to task."""
    return WordEncoder(path)


def byte_encoder(path: str | None = None):
    """The byte-level tokenizer whose ids `encode_ordinary` gives."""
    import public_tokenizers
    import tiktoken

    with open(path or public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("corpus", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
