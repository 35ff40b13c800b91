"""Token ids by the `tokenizers` library, with a cache of what it returns for the chunks of a text.

A BPE model works inside each piece that its pre-tokenizer cuts, and no piece goes on over a single space between two
other characters. So a text's ids are those of the chunks between such spaces, one after another. Arrow splits a batch
and numbers its distinct chunks; those not seen before go to the library in one text, a control token between them; the
ids of all are gathered by numpy. Runs of white space, which the byte-level cut ends by what follows them, become chunks
of their own. Texts with a control string of the vocabulary go to the library whole. All ways give the library's own ids
(tests compare them with a tokenizer opened afresh).
"""

from __future__ import annotations

import os
import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Code points of Unicode's white space (Python's \s has four control characters more).
WHITE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
_RUN = re.compile("[" + "".join(map(chr, WHITE)) + "]{2,}")
#: Marks in front of a chunk, which never begins with two white spaces: no space stands before it; it is white space
#: itself, given by its code points. A chunk without a mark stands for a space and itself.
BARE, RUN = "\r\r", "\t\t"
#: A letter and the ASCII signs after it at a chunk's end: they are pieces of their own, so the word is known without them.
SIGNS = r"([A-Za-z])([!-/:-@\[-`{-~]+)( |$)"
#: Chunks kept by a worker, and the longest of them.
CACHE_CHUNKS, CACHED_CHARS = 200_000, 64


class _Places(dict):
    def __missing__(self, chunk: str) -> int:
        return -1


class Encoder:
    """A vocabulary file's tokenizer. `control_as_text` reads control strings inside texts as ordinary text; else, as in
    the library, they are the ids of their control tokens."""

    def __init__(self, path: str, control_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker a core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = control_as_text
        self.joiner = Tokenizer.from_file(path) if control_as_text else self.tokenizer  # here control tokens part the chunks
        self.control = {t.content: i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        self.as_text = control_as_text
        self.drops_spaces = self.tokenizer.normalizer is not None
        self.size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        tokens = sorted(self.tokenizer.get_vocab(with_added_tokens=True).items(), key=lambda t: t[1])
        self.edge = np.zeros(tokens[-1][1] + 1, bool)
        self.edge[[i for t, i in tokens if (t.endswith("</w>") if self.drops_spaces else t.startswith("Ġ"))]] = True
        self._forget()

    def _forget(self) -> None:
        self.place = _Places()
        self.names: list[str] = []
        self.hits = np.empty(0, np.int32)
        self.first, self.count, self.store = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, np.uint32)

    def by_library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _regular(self, text: str) -> str:
        """The text such that its chunks are what stands between spaces."""
        if self.drops_spaces:
            return text.replace("\n", " ")

        def piece(signs: str) -> str:
            return f" {RUN}{",".join(str(ord(c)) for c in signs)}"

        def run(m: re.Match) -> str:  # all but the last sign is one piece, unless the text ends here
            signs = m[0]
            if m.end() == len(text):
                return piece(signs)
            return piece(signs[:-1]) + (" " if signs[-1] == " " else f"{piece(signs[-1])} {BARE}")

        if _RUN.search(text):
            text = _RUN.sub(run, text)
        return BARE + text.replace("\n", " \n")

    def _text(self, chunk: str) -> str:
        if self.drops_spaces:
            return f" {chunk}"
        if chunk[:1] == "\n":
            return chunk
        if chunk.startswith(RUN):
            return "".join(chr(int(n)) for n in chunk[2:].split(","))
        return chunk[2:] if chunk.startswith(BARE) else f" {chunk}"

    def _words(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts that are one word each: all in one text, cut where the vocabulary's tokens begin or end a word."""
        ids = np.array(self.tokenizer.encode_batch_fast(["".join(texts)], add_special_tokens=False)[0].ids, np.uint32)
        at = np.flatnonzero(self.edge[ids])
        rows = np.split(ids, at + 1)[:-1] if self.drops_spaces else np.split(ids, at)[1:]
        return rows if len(rows) == len(texts) else self.by_library(texts)

    def _ids_of(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what is no plain word is joined by a control token, unless it holds one."""
        out: list[np.ndarray] = [np.empty(0, np.uint32)] * len(texts)
        word = [len(t) > 1 and t[0] == " " and t[1:].isalpha() and max(t) < "\u0100" for t in texts]
        other = [i for i, w in enumerate(word) if not w]
        sign, mark = next(iter(self.control.items()), ("", 0))
        held = [i for i in other if not sign or (self.as_text and any(c in texts[i] for c in self.control))]
        parted = sorted(set(other).difference(held))
        ids = np.array(self.joiner.encode_batch_fast([sign.join(["", *(texts[i] for i in parted)])], add_special_tokens=False)[0].ids, np.uint32)
        words = [i for i, w in enumerate(word) if w]
        for group, rows in ((words, self._words([texts[i] for i in words])), (held, self.by_library([texts[i] for i in held])), (parted, [r[1:] for r in np.split(ids, np.flatnonzero(ids == mark))[1:]])):
            for i, row in zip(group, rows, strict=True):
                out[i] = row
        return out

    def _learn(self, chunks: list[str]) -> None:
        rows = self._ids_of([self._text(c) for c in chunks])
        ids, counts = np.concatenate(rows), np.array([len(r) for r in rows], np.int64)
        self.place.update(zip(chunks, range(len(self.names), len(self.names) + len(chunks)), strict=True))
        self.names += chunks
        self.first = np.append(self.first, len(self.store) + np.cumsum(counts) - counts)
        self.count, self.store = np.append(self.count, counts), np.append(self.store, ids)
        self.hits = np.append(self.hits, np.zeros(len(chunks), np.int32))

    def _trim(self) -> None:
        """Beyond its bound the cache keeps the chunks that came in several batches, the longest gone."""
        often = np.flatnonzero(self.hits > 1)
        keep = often[np.argsort(-self.hits[often], kind="stable")[: CACHE_CHUNKS // 2]]
        names = [self.names[i] for i in keep]
        short = np.array([len(n) <= CACHED_CHARS for n in names], bool)
        keep, names = keep[short], [n for n, s in zip(names, short, strict=True) if s]
        first, count, store, hits = self.first[keep], self.count[keep], self.store, self.hits[keep]
        self._forget()
        self.names, self.place = names, _Places(zip(names, range(len(names)), strict=True))
        self.store, self.first, self.count, self.hits = store[_spread(first, count)], np.cumsum(count) - count, count, hits // 2

    def encode_batch(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where each text's end."""
        if len(self.names) > CACHE_CHUNKS:
            self._trim()
        whole = [] if self.as_text else [i for i, t in enumerate(texts) if any(c in t for c in self.control)]
        regular = [self._regular(t) for t in texts]
        for i in whole:
            regular[i] = ""
        parted = pc.replace_substring_regex(pa.array(regular, pa.string()), SIGNS, rf"\1 {'' if self.drops_spaces else BARE}\2\3")
        split = pc.split_pattern(parted, " ")
        chunks = split.values.dictionary_encode()
        names = chunks.dictionary.to_numpy(zero_copy_only=False).tolist()
        place = np.fromiter(map(self.place.__getitem__, names), np.int64, len(names))
        if len(new := np.flatnonzero(place < 0)):
            place[new] = np.arange(len(self.names), len(self.names) + len(new))
            self._learn([names[i] for i in new])
        self.hits[place] += 1
        place = place[chunks.indices.to_numpy()]
        count = self.count[place]
        ids = self.store[_spread(self.first[place], count)]
        ends = np.append(0, np.cumsum(count))[split.offsets.to_numpy()[1:]]
        if whole:
            rows = np.split(ids, ends[:-1])
            for i, own in zip(whole, self.by_library([texts[i] for i in whole]), strict=True):
                rows[i] = own
            ids, ends = np.concatenate(rows), np.cumsum([len(r) for r in rows])
        return ids, ends

    def encode(self, text: str) -> np.ndarray:
        return self.encode_batch([text])[0]


def _spread(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first, first + 1, ... of each, one after another."""
    return np.repeat(first - (np.cumsum(count) - count), count) + np.arange(count.sum())


_OPEN: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, control_as_text: bool = False) -> Encoder:
    """One encoder per worker process and vocabulary file."""
    if (path, control_as_text) not in _OPEN:
        _OPEN[path, control_as_text] = Encoder(path, control_as_text)
    return _OPEN[path, control_as_text]


def vocabulary_file(name: str) -> str:
    """The place of a public vocabulary file."""
    import public_tokenizers

    return str(public_tokenizers.path(name))
