"""Whole-text token ids of a byte-level BPE file, by the tokenizers library.

The library splits a text with one public pattern and merges bytes inside each split. A blank that follows
a character other than white space always begins a split, and what lies between two such blanks is split alike
wherever it stands. So a text is cut there, and each distinct cut is encoded by the library once and remembered,
up to a bound; the ids are those of the whole text. Some megabytes of texts are cut together, and only
their distinct cuts are looked up. Texts in which white space precedes a blank go through
the library as they are. Strings of special tokens in a text are ordinary text.
"""

from __future__ import annotations

import contextlib
import ctypes
import threading
import time
from array import array
from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Cuts remembered by a worker at most, the longest unused ones going first; about 200 bytes each.
REMEMBERED = 1_500_000
#: Seconds without use after which a worker, which outlives its tasks, gives their memory back.
IDLE_S = 2.0
#: Characters of texts that are cut at once, but for a longer single text.
TOGETHER = 4 << 20
MARKS = ".,;:!?"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class _Cuts(dict):
    """Ids by cut, learned when first asked for. When it is half full, what it holds grows old and is dropped at the next turn unless it is used."""

    def __init__(self, most: int, learn: Callable[[str], bytes]):
        self.half, self.old, self.learn = most // 2, {}, learn

    def __missing__(self, cut: str) -> bytes:
        ids = self.old.get(cut)
        if ids is None:
            ids = self.learn(cut)
        self[cut] = ids
        return ids

    def turn(self) -> None:
        if len(self) > self.half:
            self.old = dict(self)
            self.clear()


class Encoder:
    """ids(text) -> bytes of little-endian unsigned 32-bit ids, without an end id; many(texts): those of each."""

    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.library = _library(path)
        model = _library(path).model
        model._resize_cache(0)  # a cut is asked for once; whole texts have the other one's cache of words
        self.merge = model.tokenize
        self.remembered, self.used = remembered, time.monotonic()
        self.in_cuts = type(self.library.pre_tokenizer).__name__ == "ByteLevel" and self.library.normalizer is None
        self.alphabet = _byte_alphabet()
        self.split = _split_pattern()
        self.forget()

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    def forget(self) -> None:
        """Gives remembered cuts back. Texts that are being encoded meanwhile keep those they use."""
        self.cuts, self.heads = _Cuts(self.remembered, self._after_blank), _Cuts(self.remembered // 4, self._alone)

    def _merged(self, split: str) -> bytes:
        letters = split if split.isascii() and split.isalpha() else split.encode().decode("latin-1").translate(self.alphabet)
        return array("I", [t.id for t in self.merge(letters)]).tobytes()

    def _after_blank(self, cut: str) -> bytes:
        """The ids of a cut and the blank before it; none where the blank that ends the cut begins no split.

        Most cuts are a word, or a word and a mark: the model merges their bytes directly.
        """
        if cut.isalpha():
            if not cut.isascii():
                return self._merged(" " + cut)
            return array("I", [t.id for t in self.merge(self.alphabet[32] + cut)]).tobytes()
        if not cut or cut[-1].isspace():
            return b""
        if cut[-1] in MARKS and cut[:-1].isalpha():
            return self.cuts[cut[:-1]] + self.heads[cut[-1]]
        if "\n" in cut:
            first, *lines = cut.split("\n")
            # A line's end between characters other than white space is a split of its own.
            if first and not first[-1].isspace() and all(s and not s[0].isspace() and not s[-1].isspace() for s in lines):
                return self.cuts[first] + b"".join([self.heads["\n"] + self.heads[s] for s in lines])
        return self._cut(" " + cut)

    def _alone(self, cut: str) -> bytes:
        """The ids of a cut with no blank before it."""
        if cut.isalpha():
            return self._merged(cut)
        if cut[-1] in MARKS and cut[:-1].isalpha():
            return self.heads[cut[:-1]] + self.heads[cut[-1]]
        splits = self.split.findall(cut)
        return self._merged(cut) if len(splits) == 1 else b"".join([self.heads[s] for s in splits])

    def _cut(self, text: str) -> bytes:
        return b"".join([self.cuts[s[1:]] if s[0] == " " and s[1:].isalpha() else self._merged(s) for s in self.split.findall(text)])

    def ids(self, text: str) -> bytes:
        return self.many([text])[0]

    def many(self, texts: list[str]) -> list[bytes]:
        out, some, size = [], [], 0
        for text in texts:
            if some and size + len(text) > TOGETHER:
                out += self._some(some)
                some, size = [], 0
            some.append(text)
            size += len(text)
        return out + self._some(some) if some else out

    def _some(self, texts: list[str]) -> list[bytes]:
        self.used = time.monotonic()
        cuts = self.cuts
        begins, inner, ends = [], [], []
        for text in texts:
            first, _, rest = text.partition(" ") if self.in_cuts else ("", "", "")
            inside, blank, last = rest.rpartition(" ")
            begins.append(first)
            inner.append(inside if blank else None)
            ends.append(last)
        lists = pc.split_pattern(pa.array(inner, pa.large_string()), " ")
        coded = lists.flatten().dictionary_encode()
        known = list(map(cuts.__getitem__, coded.dictionary.to_numpy(zero_copy_only=False)))  # each distinct cut is looked up once
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        starts, ids = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(known), "<u4")
        at = coded.indices.to_numpy()
        n = sizes[at]
        stops = np.cumsum(n)
        total = int(stops[-1]) if len(stops) else 0
        body = ids[np.repeat(starts[at] - (stops - n), n) + np.arange(total)].tobytes()
        bounds = lists.offsets.to_numpy()
        place = np.concatenate([[0], 4 * stops])[bounds].tolist()
        broken = np.concatenate([[0], np.cumsum(n == 0)])[bounds]
        broken = (broken[1:] > broken[:-1]).tolist()  # white space before a blank
        out = []
        for k, text in enumerate(texts):
            if not text:
                out.append(b"")
            elif broken[k] or begins[k][-1:].isspace() or not self.in_cuts or len(begins[k]) == len(text):
                out.append(self.whole(text))
            else:
                # What ends the text may be white space, or nothing after the last blank.
                out.append(self._begin(begins[k]) + body[place[k] : place[k + 1]] + (cuts[ends[k]] or self._cut(" " + ends[k])))
        for kept in (cuts, self.heads):
            kept.turn()
        return out

    def _begin(self, cut: str) -> bytes:
        return self.heads[cut] if cut else b""


def _library(path: str):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    library.encode_special_tokens = True
    return library


def _byte_alphabet() -> dict[int, str]:
    """The byte-level model's letters for bytes: printable ones stand for themselves, the others for those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    return {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}


def _split_pattern():
    import regex

    #: Fixed value: the public split pattern of the byte-level vocabulary.
    return regex.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+""")


_encoders: dict[str, Encoder] = {}


def _release() -> None:
    """Watches a worker's encoders: what later stages do not use shall not take their memory."""
    while True:
        time.sleep(IDLE_S / 4)
        for own in list(_encoders.values()):
            if (own.cuts or own.cuts.old) and time.monotonic() - own.used > IDLE_S:
                own.forget()
                with contextlib.suppress(OSError, AttributeError):  # only where the C library can
                    ctypes.CDLL(None).malloc_trim(0)


def encoder(path: str) -> Encoder:
    """This worker's encoder for a tokenizer file."""
    if path not in _encoders:
        if not _encoders:
            threading.Thread(target=_release, daemon=True).start()
        _encoders[path] = Encoder(path)
    return _encoders[path]
