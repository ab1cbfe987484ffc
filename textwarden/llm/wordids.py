"""Token ids of texts by a tokenizers file, at the price of its distinct words.

The vocabulary's pre-tokenizer drops white space and never joins across it, so a text's ids are those of its
words in order. Each task keeps the ids of the words it has met (a cache bounded in bytes) and gathers them with numpy. Texts for which
that doesn't hold (strings of added tokens; letters that a mark follows), and tokenizers of other make, go through the library whole.
"""

from __future__ import annotations

import json
import re
from array import array
from functools import lru_cache

import numpy as np
import regex
from tokenizers import Tokenizer

from .shared import ranges

#: Bytes that a task's cache of words and ids may take; beyond it the cache starts anew. WORD_BYTES: of an entry, besides its word and ids.
CACHE_BYTES, WORD_BYTES = 64 << 20, 160
#: The make of tokenizer whose ids are those of its words: parts of its file.
NORMALIZER = {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": "\\s+"}, "content": " "}, {"type": "Lowercase"}]}
PRE_TOKENIZER = {
    "type": "Sequence",
    "pretokenizers": [
        {"type": "Split", "pattern": {"Regex": "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"}, "behavior": "Removed", "invert": True},
        {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
    ],
}
#: Where lower case before the normalizer would be seen: a mark composes with an upper case letter otherwise than with a lower case one.
_MARKED = regex.compile(r"[A-Z]\p{M}").search


#: Words that need neither the normalizer nor the pre-tokenizer: letters of ASCII and Latin-1, then ASCII punctuation.
#: Their lower case is one letter for each, is composed, and the two runs are the pre-tokens.
_PLAIN = re.compile(r"([a-zA-Z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]*)([!-/:-@\[-`{-~]*)").fullmatch


def byte_alphabet() -> dict[int, str]:
    """The byte-level alphabet, for Latin-1 letters: printable bytes stand for themselves, others for U+0100 and on."""
    printable = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    of = {b: chr(b) if b in printable else chr(next(rest)) for b in range(256)}
    return {c: "".join(of[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


_BYTES = byte_alphabet()


class _Pieces(dict):
    """Ids of a pre-token in the vocabulary's alphabet."""

    def __init__(self, tokenizer: Tokenizer):
        self.tokenize = tokenizer.model.tokenize

    def __missing__(self, piece: str) -> list[int]:
        ids = self[piece] = [t.id for t in self.tokenize(piece)]
        return ids


class _Words(dict):
    """The number of a word (bytes without ASCII white space); its ids go to the ragged arrays."""

    def __init__(self, tokenizer: Tokenizer, end_id: int):
        self.tokenizer = tokenizer
        self.normalize = tokenizer.normalizer.normalize_str if tokenizer.normalizer else str
        self.split = tokenizer.pre_tokenizer.pre_tokenize_str if tokenizer.pre_tokenizer else None
        self.pieces = _Pieces(tokenizer)
        self.flat, self.start, self.length, self.held = array("I", [end_id]), array("q", [0]), array("q", [1]), 0

    def added(self, at: int) -> int:
        """The number of what has been put to `flat` from `at` on."""
        self.start.append(at)
        self.length.append(len(self.flat) - at)
        self.held += WORD_BYTES + 4 * self.length[-1]
        return len(self.start) - 1

    def whole(self, text: str) -> int:
        """The number of a text that the library encodes."""
        at = len(self.flat)
        self.flat.extend(self.tokenizer.encode(text, add_special_tokens=False).ids)
        return self.added(at)

    def __missing__(self, word: bytes) -> int:
        text = word.decode("utf-8", "replace")
        at = len(self.flat)
        if plain := _PLAIN(text):
            letters, signs = plain.groups()
            if letters:
                self.flat.extend(self.pieces[letters if letters.isascii() else letters.lower().translate(_BYTES)])
            if signs:
                self.flat.extend(self.pieces[signs])
        else:
            for piece, _ in self.split(self.normalize(text)):
                self.flat.extend(self.pieces[piece])
        code = self[word] = self.added(at)
        self.held += 2 * len(word)  # here, and in pieces
        return code


class WordEncoder:
    """Encodes texts as Tokenizer.encode(text, add_special_tokens=False) does, then adds end_id.

    Strings of added tokens in a text are those tokens, as the library has it.
    """

    def __init__(self, path: str, end_id: int):
        self.tokenizer = Tokenizer.from_file(path)
        self.end_id = end_id
        self.size = self.tokenizer.get_vocab_size()
        made = json.loads(self.tokenizer.to_str())
        model = made["model"]
        self.by_words = (made["normalizer"], made["pre_tokenizer"]) == (NORMALIZER, PRE_TOKENIZER) and model["type"] == "BPE" and not model["dropout"] and not made["truncation"]
        self.added = [t["content"] for t in made["added_tokens"]]
        self.words = _Words(self.tokenizer, end_id)

    def encode(self, docs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order (unsigned 32-bit) and the number of ids of each text."""
        if self.words.held > CACHE_BYTES:
            self.words = _Words(self.tokenizer, self.end_id)
        words, codes, ends = self.words, array("q"), array("q")
        number = words.__getitem__
        for doc in docs:
            if not self.by_words or any(t in doc for t in self.added) or (not doc.isascii() and _MARKED(doc)):
                codes.append(words.whole(doc))
            else:
                # Lower case is the vocabulary's; for ASCII it is taken here already, so that fewer words differ.
                codes.extend(map(number, doc.encode("utf-8", "replace").lower().split()))
            codes.append(0)
            ends.append(len(codes))
        code = np.frombuffer(codes, dtype=np.int64)
        length = np.frombuffer(words.length, dtype=np.int64)[code]
        ids = np.frombuffer(words.flat, dtype=np.uint32)[ranges(np.frombuffer(words.start, dtype=np.int64)[code], length)]
        total = np.concatenate([[0], np.cumsum(length)])
        return ids, np.diff(total[np.frombuffer(ends, dtype=np.int64)], prepend=0)


@lru_cache(maxsize=2)
def word_encoder(path: str, end_id: int) -> WordEncoder:
    return WordEncoder(path, end_id)
