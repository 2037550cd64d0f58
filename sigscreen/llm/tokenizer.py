"""What a byte-pair tokenizer file says: its words, symbols and merges.

Two kinds of file are known, told apart by what they declare: byte-level words with their leading
space, and lower-case words with an end mark. Words of common letters are found with ``re``; texts
with other characters go through the library's own normalizer and splitter.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

# The two splitting patterns, fixed values of the file formats.
LOWER_WORDS = r"[L]+|'s|'t|'re|'ve|'m|'ll|'d|[N]|[^SLN]+"
SPACED_WORDS = r" ?[L]+|'s|'t|'re|'ve|'m|'ll|'d| ?[N]+| ?[^SLN]+|[S]+(?![^S])|[S]+"
COMMON = 0x250          # code points below this are split here


def _classes() -> dict[str, str]:
    """The letters, numbers and white space among common code points, as inner parts of [...]."""
    of = {"L": [], "N": [], "S": []}
    for i in range(COMMON):
        kind = unicodedata.category(chr(i))[0]
        if kind in "LN":
            of[kind].append(i)
        elif kind == "Z" or 9 <= i <= 13 or i == 0x85:
            of["S"].append(i)
    return {k: "".join(f"\\u{i:04x}" for i in v) for k, v in of.items()}


def _pattern(template: str) -> re.Pattern:
    parts = _classes()
    return re.compile(re.sub(r"[LNS]", lambda m: parts[m[0]], template))


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in a byte-level vocabulary."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = iter(range(256, 512))
    return [chr(i) if i in shown else chr(next(hidden)) for i in range(256)]


class Tokenizer:
    """Built on each worker from the text of the file."""

    def __init__(self, text: str):
        from tokenizers import Tokenizer as Library

        spec = json.loads(text)
        model = spec["model"]
        self.library = Library.from_str(text)
        self.vocab: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**self.vocab, **self.special}.items()}
        self.lowers = bool(self.end)
        letters = byte_letters()
        self.letters = letters
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.end] for c in letters]
        self.byte_of = {c: i for i, c in enumerate(letters)}
        # (left, right) -> (rank, merged)
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.merges.setdefault((self.vocab[a], self.vocab[b]), (rank, self.vocab[a + b]))
        self.split = _pattern(LOWER_WORDS if self.lowers else SPACED_WORDS).findall
        self.rare = re.compile(f"[^\\u0000-\\u{COMMON - 1:04x}]").search
        self.parts = re.compile("(" + "|".join(map(re.escape, self.special)) + ")").split

    def words(self, text: str) -> list[str]:
        """The words of a text; a special string inside it is a word of its own."""
        if "<|" in text and any(s in text for s in self.special):
            out: list[str] = []
            for i, part in enumerate(self.parts(text)):
                out += [part] if i % 2 else self._plain(part)
            return out
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        plain = text.lower() if self.lowers else text
        if not self.rare(plain):
            return self.split(plain)
        lib = self.library
        if lib.normalizer:
            text = lib.normalizer.normalize_str(text)
        # the library's words are in byte letters; back to text by way of the bytes
        return [bytes(map(self.byte_of.__getitem__, w)).decode("utf-8", "surrogateescape")
                for w, _ in lib.pre_tokenizer.pre_tokenize_str(text)]

    def symbols(self, word: str) -> list[int]:
        """The ids of a word before any merge."""
        if word in self.special:
            return [self.special[word]]
        raw = word.encode("utf-8", "surrogateescape")
        ids = [self.first[b] for b in raw]
        if ids:
            ids[-1] = self.last[raw[-1]]
        return ids


def cached(text: str, make: Callable[[str], object], _made: dict = {}) -> object:
    """One object per worker process and file; later tasks of the process find it ready."""
    key = (make, hash(text))
    if key not in _made:
        _made[key] = make(text)
    return _made[key]


def read_file(path: str) -> str:
    """The tokenizer file, read on the driver; at a few MB it travels with the tasks as a broadcast."""
    with open(path, encoding="utf-8") as f:
        return f.read()
