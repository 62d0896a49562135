"""Fast exact tokenising: encode each distinct pre-token once and look the rest up.

A tokenizer of this kind never merges across pre-tokens, so a text's ids are those of its
pre-tokens in a row. Texts that hold a character outside plain Latin text, or something that may
be a special token, go to the library whole, so the result is the library's in every case.
"""

from __future__ import annotations

import re
from array import array

import numpy as np

_LETTER = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-ſ"
#: Characters whose class (letter, digit, space, other) and case all parties agree on.
_PLAIN = re.compile("[\t-\r -~\xa1-\xac\xae-\xb1\xb4\xb6-\xb8\xbb\xbf\xaa\xb5\xba\xc0-įı-ž]*").fullmatch
#: The fixed patterns of the two vocabularies, with letters and digits spelt out for plain text.
_BYTE_LEVEL = f"'(?:[stmd]|re|ve|ll)| ?[{_LETTER}]+| ?[0-9]+| ?[^\\s{_LETTER}0-9]+|\\s+(?!\\S)|\\s+"
_WORD_LEVEL = f"[{_LETTER}]+|[0-9]|'(?:[stmd]|re|ve|ll)|[^\\s{_LETTER}0-9]+"
#: Fixed descriptions, as the library gives them, of the normalizers and pre-tokenizers that the two patterns stand for.
_KNOWN_AS = {
    ("None", "ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=True)"): _BYTE_LEVEL,
    (
        'Sequence(normalizers=[NFC(), Replace(pattern=Regex("\\s+"), content=" "), Lowercase()])',
        'Sequence(pretokenizers=[Split(pattern=Regex("\'s|\'t|\'re|\'ve|\'m|\'ll|\'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"), behavior=Removed, invert=True), ByteLevel(add_prefix_space=False, trim_offsets=True, use_regex=False)])',
    ): _WORD_LEVEL,
}
#: White space after which a text can't be cut at single spaces and line ends without the pattern.
_ODD = ("  ", "\n\n", " \n", "\n ", "\t", "\r", "\x0b", "\x0c")
#: Entries after which a worker's table of known pre-tokens starts anew; bounds memory, never results.
MOST_KNOWN = 1_000_000

_tokenizers: dict[str, object] = {}


def tokenizer(path: str):
    if path not in _tokenizers:
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        _tokenizers[path] = Tokenizer.from_file(path)
    return _tokenizers[path]


class _Known(dict):
    def __init__(self, make):
        super().__init__()
        self.make = make

    def __missing__(self, key):
        if len(self) >= MOST_KNOWN:
            self.clear()
        self[key] = value = self.make(key)
        return value


def _visible() -> dict[int, str]:
    """The fixed stand-in characters that byte-level vocabularies use: printable bytes as they are, the rest from 256 up."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


class Encoder:
    """Counts or ids of texts as the library gives them, without added special tokens."""

    def __init__(self, path: str):
        self.lib = t = tokenizer(path)
        pattern = _KNOWN_AS.get((repr(t.normalizer), repr(t.pre_tokenizer)))
        #: Vocabularies of another kind go to the library whole.
        self.known = pattern is not None
        self.lower = pattern is _WORD_LEVEL
        self.find = re.compile(pattern or "").findall
        self.specials = [x.content for x in t.get_added_tokens_decoder().values()]
        self.visible = _visible()
        self.model = t.model
        self.parts = _Known(self._part)
        self.counts = _Known(lambda unit: sum(len(self.parts[x]) for x in self.find(unit)) // 4)
        self.codes = _Known(lambda unit: b"".join([self.parts[x] for x in self.find(unit)]))

    def _part(self, pretoken: str) -> bytes:
        shown = pretoken.encode().decode("latin-1").translate(self.visible)
        return array("I", [y.id for y in self.model.tokenize(shown)]).tobytes()

    def _ids(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _split(self, text: str):
        """Units of whole pre-tokens, or None if only the library may do it."""
        if not self.known or _PLAIN(text) is None or any(s in text for s in self.specials):
            return None
        if self.lower:
            return text.lower().split()
        if text[:1] in (" ", "\n") or text[-1:] in (" ", "\n") or any(s in text for s in _ODD) or "\0" in text:
            return self.find(text)
        return text.replace(" ", "\0 ").replace("\n", "\0\n\0").split("\0")

    def count(self, text: str) -> int:
        parts = self._split(text)
        return len(self.lib.encode(text, add_special_tokens=False).ids) if parts is None else sum(map(self.counts.__getitem__, parts))

    def ids(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        parts = self._split(text)
        return self._ids(text) if parts is None else b"".join(map(self.codes.__getitem__, parts))


class Pieces:
    """Counts or ids of texts by a sentencepiece model, without begin and end."""

    def __init__(self, path: str):
        import sentencepiece

        self.lib = sentencepiece.SentencePieceProcessor(model_file=path)

    def count(self, text: str) -> int:
        return len(self.lib.encode(text))

    def ids(self, text: str) -> bytes:
        return np.asarray(self.lib.encode(text), "<u4").tobytes()


_encoders: dict[str, Encoder | Pieces] = {}


def encoder(path: str) -> Encoder | Pieces:
    """One encoder a worker and file; .model files are sentencepiece's."""
    if path not in _encoders:
        _encoders[path] = Pieces(path) if path.endswith(".model") else Encoder(path)
    return _encoders[path]
