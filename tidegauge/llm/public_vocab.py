"""Public tokenizer files by path, and the ids of single words.

Paths are parameters; the files stay where they are and are read by each Python worker once.
"""

from __future__ import annotations

import json
import os
import re

import numpy as np

from .common import held

#: Entries of a generation of a worker's cache. When one is full it becomes the old one, from which words that are met
#: again move on, and the old one goes: memory stays bounded, and frequent words stay.
CACHE_WORDS = 200_000
#: Words encoded in one call.
CALL = 20_000

#: ASCII letters in lower case and Latin ones up to U+017E that no normalisation takes apart (U+0130 is left out).
LATIN = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf]|\xc4[\x80-\xaf\xb1-\xbf]|\xc5[\x80-\xbe])+")


def _kind(byte: int) -> int:
    """x: white space, digits, Latin letters and their bytes; p: other ASCII; o: what may be anything."""
    if byte in b" \t\n\v\f\r" or byte < 0x80 and chr(byte).isalnum() or 0x80 <= byte < 0xC0 or byte in b"\xc3\xc4\xc5":
        return ord("x")
    return ord("p" if byte < 0x80 else "o")


KINDS = bytes(map(_kind, range(256)))
#: Multiplication and division sign, and the capital I with dot, which lower-cases to a letter and a mark.
NOT_PLAIN = (b"\xc3\x97", b"\xc3\xb7", b"\xc4\xb0")


def default_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _byte_letters() -> dict[int, str]:
    """The letters by which byte-level pieces write bytes: printable Latin-1 as itself, the others from U+0100 on, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(rest) if b != 0x20} | {0x20: " "}


class WordIds(dict):
    """bytes of a word -> its ids as little-endian bytes, for words that fill() was last asked for.

    Splitting on ASCII white space is exact for tokenizers that drop white space and whose pieces and special strings
    hold none of it: normalisation, pre-tokenisation and merges never look across it. Where the tokenizer lower-cases,
    takes runs of letters as pre-tokens and ends each with a marked piece, words() also sets apart full stops and commas
    that touch no other sign, and lower-cases ASCII, in texts of Latin letters; and many words of Latin letters, which
    need no normalisation, go through the tokenizer's merges in one call and are parted at the marked pieces. All other
    words are given to the whole tokenizer one by one.
    """

    def __init__(self, path: str):
        super().__init__()
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.dtype = np.dtype("<u2" if self.tokenizer.get_vocab_size() <= 1 << 16 else "<u4")
        told = json.loads(self.tokenizer.to_str())
        steps = json.dumps(told["pre_tokenizer"])
        self.by_letters = told["model"].get("end_of_word_suffix") == "</w>" and "Lowercase" in str(told["normalizer"]) and r"[\\p{L}]+" in steps and "ByteLevel" in steps
        vocabulary = self.tokenizer.get_vocab()
        self.final = np.zeros(max(vocabulary.values()) + 1, bool)
        self.final[[i for p, i in vocabulary.items() if p.endswith("</w>")]] = True
        if self.by_letters:
            self.merges = Tokenizer(self.tokenizer.model)
            self.merges.normalizer, self.merges.pre_tokenizer = normalizers.Sequence([]), pre_tokenizers.WhitespaceSplit()
        self.letters = _byte_letters()
        self.old: dict[bytes, bytes] = {}

    def words(self, text: bytes) -> list[bytes]:
        """Words of a text whose ids, one after the other, are the text's."""
        if self.by_letters:
            kinds = text.translate(KINDS)
            if b"pp" not in kinds and b"o" not in kinds and not any(x in text for x in NOT_PLAIN):
                return text.lower().replace(b".", b" . ").replace(b",", b" , ").split()
        return text.split()

    def _several(self, words: list[bytes]) -> list[bytes]:
        return [np.array(e.ids, self.dtype).tobytes() for e in self.tokenizer.encode_batch_fast([w.decode("utf-8", "replace") for w in words], add_special_tokens=False)]

    def _latin(self, words: list[bytes]) -> list[bytes]:
        text = b" ".join(words).decode().lower()
        if not text.isascii():
            text = text.encode().decode("latin-1").translate(self.letters)
        ids = np.array(self.merges.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.dtype)
        stop = np.flatnonzero(self.final[ids]) + 1
        if len(stop) != len(words):
            return self._several(words)
        raw, at = ids.tobytes(), (stop * ids.itemsize).tolist()
        return [raw[a:b] for a, b in zip([0, *at[:-1]], at)]

    def fill(self, words: set[bytes]) -> None:
        new = [w for w in words if w not in self]
        if len(self) + len(new) > CACHE_WORDS:
            self.old = dict(self)
            self.clear()
            new = list(words)
        old = self.old
        ascii_, latin, others = [], [], []
        for w in new:
            if (x := old.get(w)) is not None:
                self[w] = x
            elif self.by_letters and w.isalpha():
                ascii_.append(w)
            elif self.by_letters and LATIN.fullmatch(w.lower()):
                latin.append(w)
            else:
                others.append(w)
        for encode, own in ((self._latin, ascii_), (self._latin, latin), (self._several, others)):
            for at in range(0, len(own), CALL):
                part = own[at : at + CALL]
                self.update(zip(part, encode(part)))


_word_ids: dict[str, WordIds] = held({})


def word_ids(path: str) -> WordIds:
    """This worker's WordIds for path."""
    if path not in _word_ids:
        _word_ids[path] = WordIds(path)
    return _word_ids[path]
