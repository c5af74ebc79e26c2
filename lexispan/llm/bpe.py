"""Token ids of whole texts by the tokenizers library, each distinct chunk of text encoded once.

Both public tokenizers cut a text into pieces before they merge pairs, and no piece runs from a
character that isn't white space into one that is. So a text cut before a single space or line feed
gives the same ids in chunks as at once, and chunks repeat often enough to be worth remembering.
Texts with runs of white space are encoded as they are.

A new chunk that is letters before a few ASCII marks is the ids of the letters, then those of the marks,
as pieces end where letters do; and for a tokenizer that lowers its input, letters that have a plain lower
form share its ids. Letters alone are one piece, so they go straight to the tokenizer's model.
"""

from __future__ import annotations

import os
from itertools import chain

import numpy as np

from .common import begin

MARKS = ".,;:!?"
#: Chunks in one call for ids; more calls cost more than they bring.
GROUP = 16


def visible_bytes() -> dict[int, int]:
    """How byte-level models spell bytes: visible characters of Latin-1 as they are, the others from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + k for k, b in enumerate(hidden)}


_HIDDEN = visible_bytes()


def spelt(word: str) -> str:
    return word.encode().decode("latin-1").translate(_HIDDEN)


class Numbers(dict):
    """Numbers its keys in the order in which they are first asked for; new: those since it was last emptied."""

    def __init__(self):
        super().__init__()
        self.new: list = []

    def __missing__(self, key):
        self[key] = n = len(self)
        self.new.append(key)
        return n


class Encoder:
    """ids(texts) with a memory of chunks. end: an id that each text gets at its end, or None."""

    #: Chunks remembered; letters of either case are one where the tokenizer lowers them, so fewer do.
    MOST = 1_200_000
    MOST_LOWERED = 500_000

    def __init__(self, path: str, spaces_dropped: bool, end: int | None = 0):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.spaces_dropped, self.end = Tokenizer.from_file(path), spaces_dropped, end
        self.model = self.tokenizer.model
        self.forget()

    def forget(self) -> None:
        self.number = Numbers()
        self.flat = np.zeros(1 << 16, np.uint32)
        self.at = np.zeros(1 << 12, np.int64)
        self.length = np.zeros(1 << 12, np.int64)
        self.used = 0

    def keep(self, numbers: np.ndarray, ids: np.ndarray, lengths: np.ndarray) -> None:
        """Keeps ids that stand one after another, for a number each."""
        n = len(ids)
        while self.used + n > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.flat[self.used : self.used + n] = ids
        self.length[numbers] = lengths
        self.at[numbers] = self.used + np.cumsum(lengths) - lengths
        self.used += n

    def merge(self, numbers: list[int], keys: list[str]) -> None:
        """Gets the ids of keys, each of which is one piece, from the library's model."""
        if keys:
            tokenize = self.model.tokenize
            ids = [[x.id for x in tokenize(k if k.isascii() and k[0] != " " else spelt(k))] for k in keys]
            lengths = np.fromiter(map(len, ids), np.int64, len(ids))
            self.keep(np.array(numbers), np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum())), lengths)

    def encode(self, numbers: list[int], keys: list[str]) -> None:
        """Gets the ids of keys from the library, each on its own."""
        for i in range(0, len(keys), 64 * GROUP):
            some = keys[i : i + 64 * GROUP]
            groups = [some[j : j + GROUP] for j in range(0, len(some), GROUP)]
            made = self.tokenizer.encode_batch(groups, is_pretokenized=True, add_special_tokens=False)
            ids = np.concatenate([np.array(x.ids, np.uint32) for x in made])
            lengths = np.concatenate([np.bincount(np.array(x.word_ids, np.int64), minlength=len(g)) for x, g in zip(made, groups, strict=True)])
            self.keep(np.array(numbers[i : i + 64 * GROUP]), ids, lengths)

    def resolve(self) -> None:
        """Finds the ids of all new keys."""
        number, lower = self.number, self.spaces_dropped
        plain, plain_at, rest, rest_at, same, joint = [], [], [], [], [], []
        at = len(number) - len(number.new)
        ended = None
        for n, c in enumerate(number.new, at):  # stems and marks that are new join the list meanwhile
            if c is None:
                ended = n
                continue
            stem = c.rstrip(MARKS)
            word = stem[1:] if stem[:1] == " " else stem
            if not word.isalpha() or lower and not word.isascii() and (max(word) >= "\u0180" or "\u0130" in word):
                rest.append(c)
                rest_at.append(n)
                continue
            low = stem.lower() if lower else stem
            if len(stem) < len(c):
                joint.append((n, number[low], number[c[len(stem) :]]))
            elif low != stem:
                same.append((n, number[low]))
            else:
                plain.append(c)
                plain_at.append(n)
        while len(number) > len(self.at):
            self.at, self.length = (np.concatenate([x, np.zeros_like(x)]) for x in (self.at, self.length))
        if ended is not None:
            self.keep(np.array([ended]), np.array([self.end], np.uint32), np.array([1]))
        self.merge(plain_at, plain)
        self.encode(rest_at, rest)
        if same:
            to, of = np.array(same).T
            self.at[to], self.length[to] = self.at[of], self.length[of]
        if joint:
            to, *of = np.array(joint).T
            of = np.stack(of, axis=1)
            self.keep(to, self.spread(of.ravel()), self.length[of].sum(axis=1))
        number.new = []

    def spread(self, which: np.ndarray) -> np.ndarray:
        """The ids of numbers, one after another."""
        length = self.length[which]
        ends = np.cumsum(length)
        return self.flat[np.repeat(self.at[which] - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]

    def chunks(self, text: str) -> list[str]:
        if self.spaces_dropped:
            return [x for x in text.replace("\n", " ").split(" ") if x]
        if "\0" in text or "  " in text or " \n" in text or "\n " in text or "\n\n" in text:
            return [text]
        return text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids in one array, and where each text starts (with the end of the last)."""
        if len(self.number) > (self.MOST_LOWERED if self.spaces_dropped else self.MOST):
            self.forget()
        chunks: list[str | None] = []
        counts = []
        for t in texts:
            own = self.chunks(t)
            chunks += own
            if self.end is not None:
                chunks.append(None)
            counts.append(len(own) + (self.end is not None))
        which = np.fromiter(map(self.number.__getitem__, chunks), np.int64, len(chunks))
        if self.number.new:
            self.resolve()
        ends = np.cumsum(self.length[which])
        bounds = np.concatenate([[0], ends])[np.concatenate([[0], np.cumsum(counts, dtype=np.int64)])]
        return self.spread(which), bounds


def encoder(name: str, spaces_dropped: bool, end: int | None = 0) -> Encoder:
    """One encoder for each Python worker, for as long as no other operator runs there. name: a path, or a file name of the public tokenizers, which is found where the worker runs."""

    def make() -> Encoder:
        path = name
        if "/" not in name:
            import public_tokenizers

            path = public_tokenizers.path(name)
        return Encoder(path, spaces_dropped, end)

    return begin((name, spaces_dropped, end), make)
