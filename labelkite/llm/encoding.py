"""Token ids of whole texts by a public tokenizer file, as bytes of little-endian unsigned 32-bit ids.

Both tokenizers here encode each stretch between two places in a text on its own, so equal stretches always give equal
ids. A worker keeps the ids of stretches that it meets again (at most ``MEMO`` of them) and has the library encode only the
others. Texts with control characters that the libraries' white space classes disagree about are encoded whole, and so are
texts that hold a special token's own string, which the library takes for that token.
"""

from __future__ import annotations

import re
from array import array

from labelkite.llm.common import only

#: Unicode white space, the characters that both libraries agree on.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
ODD = re.compile(r"[\x1c-\x1f\u180e\u200b\ufeff]")
#: A byte-level vocabulary keeps one space with the word after it; the other drops all white space.
STRETCHES = {
    "byte_bpe_50k.json": re.compile(rf" ?[^{WHITE}]+|[{WHITE}]+(?![^{WHITE}])|[{WHITE}]+"),
    "word_bpe_49k.json": re.compile(rf"[^{WHITE}]+"),
}
#: Texts without these may be lower-cased beforehand, as each of their letters has a lower-case letter of its own.
UNSURE = re.compile(r"[^\x00-\u012f\u0131-\u017f]")
#: Letters, then marks, that every class agrees on: two runs that are encoded apart.
PLAIN = re.compile(r"( ?[A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff]+)([!-&(-/:-@\[-`{-~]*)")
#: Stretches kept, once they have been met twice; others that have been met once.
MEMO = 350_000
ONCE = 250_000
#: Characters of text whose stretches are held at once.
CHUNK = 1_000_000

_encoders: dict = {}


def letters() -> list[str]:
    """The letter that a byte-level vocabulary has for each byte: printable bytes stand for themselves, the others, in order, for
    the characters from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    letter = {b: chr(b) for b in printable} | {b: chr(256 + k) for k, b in enumerate(others)}
    return [letter[b] for b in range(256)]


def byte_letters() -> dict[int, str]:
    """Characters to the letters of their bytes."""
    letter = letters()
    return {c: "".join(letter[b] for b in chr(c).encode()) for c in range(256)}


def spaced(text: str) -> list[str]:
    """The stretches of a byte-level vocabulary, without the pattern where lines have single spaces between their words alone."""
    out: list[str] = []
    for line in text.split("\n"):
        words = line.split()
        if not words or " ".join(words) != line:
            return STRETCHES["byte_bpe_50k.json"].findall(text)
        if out:
            out.append("\n")
        out.append(words[0])
        out += [" " + w for w in words[1:]]
    return out


class Encoder:
    def __init__(self, name: str, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(name)
        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.find = spaced if name == "byte_bpe_50k.json" else str.split  # as STRETCHES, on texts that aren't odd
        self.lower = name == "word_bpe_49k.json"
        self.bytes = byte_letters()
        self.once: set[str] = set()
        self.marks: dict[str, list[int]] = {"": []}
        self.memo: dict[str, bytes] = {}

    def library(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, all by the library."""
        import numpy as np

        return [np.array(x.ids, "<u4").tobytes() for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _run(self, x: str) -> list[int]:
        return [t.id for t in self.tokenizer.model.tokenize(x.translate(self.bytes))]

    def _stretches(self, new: set[str]) -> dict[str, bytes]:
        """The ids of each stretch: plain ones by the library's model directly, others by all of the library."""
        out, others, marks, tokenize, lower, space = {}, [], self.marks, self.tokenizer.model.tokenize, self.lower, self.bytes[32]
        for x in new:
            word = x[1:] if x[0] == " " else x
            if word.isascii() and word.isalpha():  # most are, and their letters stand for themselves
                if lower:
                    word = word.lower()
                out[x] = array("I", [t.id for t in tokenize(word if x[0] != " " else space + word)]).tobytes()
                continue
            plain = PLAIN.fullmatch(x)
            if not plain:
                others.append(x)
                continue
            letters, after = plain.groups()
            ids = self._run(letters.lower() if lower else letters)
            if after not in marks:
                if len(marks) > 10_000:
                    marks.clear()
                marks[after] = self._run(after) if after else []
            out[x] = array("I", ids + marks[after]).tobytes()
        out.update(zip(others, self.library(others), strict=True))
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """The ids of each text."""
        memo, get = self.memo, self.memo.get
        out: list = [None] * len(texts)
        wait, new, units, odd = [], set(), 0, []
        for k, t in enumerate(texts):
            if ODD.search(t) or any(x in t for x in self.special):
                odd.append(k)
                continue
            if self.lower and (t.isascii() or not UNSURE.search(t)):
                t = t.lower()
            found = self.find(t)
            units += len(found)
            ids = list(map(get, found))
            if None in ids:
                missing = [i for i, x in enumerate(ids) if x is None]
                new.update([found[i] for i in missing])
                wait.append((k, found, ids, missing))
            else:
                out[k] = b"".join(ids)
        if new:
            fresh = self._stretches(new)
            for k, found, ids, missing in wait:
                for i in missing:
                    ids[i] = fresh[found[i]]
                out[k] = b"".join(ids)
            if len(memo) >= MEMO and len(new) > units / 4:
                memo.clear()  # other texts than before
            if len(memo) < MEMO:
                again = new & self.once
                memo.update((x, fresh[x]) for x in again)
                self.once |= new - again
                if len(self.once) > ONCE:
                    self.once.clear()
        for k, ids in zip(odd, self.library([texts[k] for k in odd]), strict=True):
            out[k] = ids
        return out


def encoder(name: str, path: str | None = None) -> Encoder:
    """One encoder for each worker process and file."""
    if (name, path) not in _encoders:
        only("encoders", _encoders.clear)
        _encoders[name, path] = Encoder(name, path)
    return _encoders[name, path]


def chunks(texts: list[str]):
    """(first, last) places of runs of texts of about ``CHUNK`` characters."""
    begin, size = 0, 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield begin, i + 1
            begin, size = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)
