"""Ids of whole texts by a tokenizer file, with the ids of different words remembered."""

from __future__ import annotations

import json
import os
import re
import struct
from contextlib import suppress

import numpy as np

REMEMBERED = 300_000  # words whose ids a Python worker keeps, and as many older ones
LONG_WORD = 64  # longer words are not remembered
_ENCODERS: dict[str, "Encoder"] = {}  # one for each file in a worker, so that its tasks share the words


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones as themselves, the others from U+0100 on, in order."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b) if b in plain else chr(next(others)) for b in range(256)}


class Encoder:
    """Ids of whole texts, as the tokenizer of ``path`` gives them without special tokens.

    Where the file says that it lower-cases, drops white space and splits by one expression into words that are encoded each
    on their own, texts of ASCII and Latin letters are split here by that expression, and each different word is encoded
    once and remembered. Any other text, and any other kind of file, is given to the tokenizer whole. The ids are the same.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks use the cores
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            stated = json.load(f)
        self.size = max([*self.tokenizer.get_vocab(with_added_tokens=True).values(), 0]) + 1
        self.added = [t["content"] for t in stated.get("added_tokens") or []]
        split = self._splitter(stated)
        self.parts = re.compile(split).findall if split else None
        letters = [chr(c) for c in range(0xC0, 0x180) if chr(c).isalpha() and len(chr(c).lower()) == 1]
        self.plain = {*map(chr, range(0x1C)), *map(chr, range(0x20, 0x80)), *letters} - set("ŉſ")
        self.letters = _byte_letters()
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @staticmethod
    def _splitter(stated: dict) -> str | None:
        """The file's expression for words, for plain texts; None where words are not encoded each on their own."""
        normal = [n["type"] for n in (stated.get("normalizer") or {}).get("normalizers", [])]
        cut = (stated.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if normal != ["NFC", "Replace", "Lowercase"] or [c["type"] for c in cut] != ["Split", "ByteLevel"] or stated["model"]["type"] != "BPE":
            return None
        spaces, (split, level) = stated["normalizer"]["normalizers"][1], cut
        if spaces["pattern"] != {"Regex": "\\s+"} or spaces["content"] != " " or stated["model"].get("dropout") or stated.get("post_processor"):
            return None
        if (split["behavior"], split["invert"], level["add_prefix_space"], level["use_regex"]) != ("Removed", True, False, False):
            return None
        pattern = split["pattern"].get("Regex", "").replace("\\p{L}", "a-zß-öø-ſ").replace("\\p{N}", "0-9")
        return None if "\\p" in pattern or not pattern else pattern

    def _word(self, word: str) -> bytes:
        """Ids of one word that the expression cut, straight from the vocabulary's merges."""
        if not word.isascii():
            word = "".join(map(self.letters.__getitem__, word.encode()))
        ids = [t.id for t in self.tokenizer.model.tokenize(word)]
        return struct.pack(f"<{len(ids)}I", *ids)

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype="<u4").tobytes()

    def _find(self, chunk: str) -> bytes:
        """Ids of a chunk that was unknown when its text was begun; they are known from now on."""
        ids = self.known.get(chunk) or self.older.get(chunk)
        if ids is None:
            words = self.parts(chunk)
            ids = self._word(chunk) if len(words) == 1 else b"".join(map(self._find, words))
        if len(chunk) <= LONG_WORD:
            self.known[chunk] = ids
        return ids

    @staticmethod
    def _unknown(ids: list[bytes | None]):
        """Places of None, in order; the list's own search is several times faster than a loop over all."""
        at = -1
        with suppress(ValueError):
            while True:
                at = ids.index(None, at + 1)
                yield at

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit numbers."""
        out = []
        for text in texts:
            if self.parts is None or not self.plain.issuperset(text) or any(a in text for a in self.added):
                out.append(self._whole(text))
                continue
            if len(self.known) > REMEMBERED:  # what is used again is taken over
                self.known, self.older = {}, self.known
            chunks = text.lower().split()
            ids = [*map(self.known.get, chunks)]
            for at in self._unknown(ids):
                ids[at] = self._find(chunks[at])
            out.append(b"".join(ids))
        return out


def encoder(path: str) -> Encoder:
    """The worker's encoder for this file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def in_bounds(texts: list[bytes | None], most: int = 1 << 21):
    """The texts, decoded, in runs of about ``most`` bytes; a longer text is a run of its own."""
    run, size = [], 0
    for t in texts:
        run.append((t or b"").decode("utf-8", "replace"))
        size += len(t or b"")
        if size >= most:
            yield run
            run, size = [], 0
    if run:
        yield run


