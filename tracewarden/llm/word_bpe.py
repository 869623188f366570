"""Token ids of whole texts from a word-level BPE file of the tokenizers library.

The file's rules make every run of non-space characters independent of its neighbours, so ids are kept per word and
a text costs one look-up for each of its words.  Words of letters go straight to the file's merge model, also if marks
follow, whose ids are kept apart (an apostrophe may start a piece with letters and is none of them); anything else, and any text with separators that Python and the file's rules see differently, goes through the whole encoder.

That holds for files with the rules below only.  With any other file every text goes through the whole encoder.
"""

from __future__ import annotations

import json
import os
import re
import sys
import unicodedata
from array import array

import numpy as np

from tracewarden.llm.common import kept_in_worker

MAX_WORDS = 700_000  # words whose ids a worker keeps; after that it starts afresh
CONTROL_SPACE = "\x1c\x1d\x1e\x1f"
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
# The rules of a vocabulary file under which words can be encoded one by one.
WORD_RULES = {
    "normalizer": {"type": "Sequence", "normalizers": [
        {"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {"type": "Sequence", "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]},
    "post_processor": None, "truncation": None, "padding": None,
}


def follows_word_rules(path: str) -> bool:
    with open(path, encoding="utf-8") as file:
        rules = json.load(file)
    added = all(
        not t.get("single_word") and not t.get("normalized") and not re.search(r"\s", t["content"]) and not t["content"][:1].isalpha()
        for t in rules.get("added_tokens", []))
    return added and rules.get("model", {}).get("type") == "BPE" and all(rules.get(name) == value for name, value in WORD_RULES.items())


def byte_letters() -> dict[int, str]:
    """The printable character for every byte in byte-level vocabularies: itself if visible, else one from 256 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {b: chr(b) for b in visible} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _packed(ids: list[int]) -> bytes:
    packed = array("I", ids)
    if sys.byteorder == "big":
        packed.byteswap()
    return packed.tobytes()


def _lower(text: str) -> str:
    """Character by character, as the file's rules do it: ``str.lower`` looks at what surrounds a capital sigma."""
    return text.lower() if "\u03a3" not in text else "".join(c.lower() for c in text)


class WordIds(dict):
    """Word to its ids as little-endian unsigned 32-bit integers, filled on demand."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = byte_letters()
        self.by_word = follows_word_rules(path)
        self.stems: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def highest(self) -> int:
        """The largest id of the vocabulary, added tokens included."""
        return max(self.tokenizer.get_vocab(with_added_tokens=True).values(), default=0)

    def _stem(self, stem: str) -> bytes:
        ids = self.stems.get(stem)
        if ids is None:
            word = stem if stem.isascii() else "".join(map(self.letters.__getitem__, stem.encode()))
            ids = self.stems[stem] = _packed([t.id for t in self.model.tokenize(word)])
        return ids

    def __missing__(self, word: str) -> bytes:
        stem = word.rstrip(MARKS)
        ids = None
        if stem.isalpha():
            plain = stem.lower() if stem.isascii() else _lower(unicodedata.normalize("NFC", stem))
            if plain.isalpha():
                ids = self._stem(plain)
                if len(stem) < len(word):
                    ids += self[word[len(stem):]]
        if ids is None:
            ids = self.whole(word)
        self[word] = ids
        return ids

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.by_word or any(c in text for c in CONTROL_SPACE):
            return self.whole(text)
        if len(self) > MAX_WORDS:
            self.clear()
            self.stems.clear()
        return b"".join(map(self.__getitem__, text.split()))


def encoder(path: str) -> WordIds:
    """The worker's encoder for a vocabulary file, made once."""
    return kept_in_worker("word ids", path, lambda: WordIds(path))
