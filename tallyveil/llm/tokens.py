"""Token ids of whole texts with a public tokenizer file, cached word by word inside each Python worker."""

from __future__ import annotations

import re
from array import array
from itertools import chain

WORD_BPE = "word_bpe_49k.json"
CACHE_WORDS = 100_000  # of each of two generations
# Words of printable ASCII signs and Latin letters, which are their own normal form, and the pre-tokenizer's
# pattern for them in lower case. Some capitals (Ɓ, Ə, Ⱥ ...) have their small letter outside these ranges, so
# both a word and its lower case have to be plain.
_PLAIN = re.compile(r"[!-~À-ÖØ-öø-įı-ɏ]+")
_PIECES = re.compile(r"[a-zÀ-ÖØ-öø-ɏ]+|'(?:s|t|re|ve|m|ll|d)|[0-9]|[^\sa-z0-9À-ÖØ-öø-ɏ]+")
# Of Latin-1: what texts of white space, printable ASCII signs and letters do not have.
_ODD = bytes(set(range(256)) - {9, 10, 11, 12, 13, *range(32, 127), *range(0xC0, 0xD7), *range(0xD8, 0xF7), *range(0xF8, 0x100)})


def _byte_letters() -> dict[int, str]:
    """The letter that byte-level vocabularies write for each byte: itself if printable, else from 256 on."""
    shown = set(chain(range(33, 127), range(161, 173), range(174, 256)))
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


_LETTERS = _byte_letters()


def vocabulary_path(name: str = WORD_BPE) -> str:
    """Where the installed vocabulary package keeps ``name`` on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class _Cache(dict):
    """Key -> ids by ``make``; when full it becomes the old generation, from which used entries come back."""

    def __init__(self, make):
        self.make, self.old = make, {}

    def __missing__(self, key):
        ids = self.old.get(key)
        if ids is None:
            ids = self.make(key)
        if len(key) <= 64:
            if len(self) >= CACHE_WORDS:
                self.old = dict(self)
                self.clear()
            self[key] = ids
        return ids


class WordTokens:
    """Ids of texts as little-endian unsigned 32-bit integers, from caches of bounded size.

    Right for tokenizers that drop white space, lower the case and never join what white space separates. Texts
    of plain Latin-1 letters and ASCII signs are cut by the pre-tokenizer's pattern at once; others word by word,
    and words with other signs go through the whole tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parts, self.words = _Cache(self._part), _Cache(self._word)

    def _part(self, part: str) -> bytes:
        spelled = part if part.isascii() else part.encode().decode("latin-1").translate(_LETTERS)
        return array("I", [t.id for t in self.model.tokenize(spelled)]).tobytes()

    def _word(self, word: bytes) -> bytes:
        text = word.decode()
        if _PLAIN.fullmatch(text) and "<|" not in text and _PLAIN.fullmatch(low := text.lower()):
            return b"".join(map(self.parts.__getitem__, _PIECES.findall(low)))
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        """All ids of a text; none for null."""
        if not text:
            return b""
        try:
            plain = "<|" not in text and len(latin := text.encode("latin-1")) == len(latin.translate(None, _ODD))
        except UnicodeEncodeError:
            plain = False
        if plain:
            return b"".join(map(self.parts.__getitem__, _PIECES.findall(text.lower())))
        return b"".join(map(self.words.__getitem__, text.encode().split()))


_loaded: dict[str, WordTokens] = {}


def forget() -> None:
    """Give the caches' memory back at the end of a task: workers live on for other operators."""
    _loaded.clear()


def word_tokens(name: str) -> WordTokens:
    """The task's cache for a vocabulary file: a name of the installed package, or a path."""
    if name not in _loaded:
        _loaded[name] = WordTokens(name if "/" in name else vocabulary_path(name))
    return _loaded[name]
