"""Byte-level BPE ids of whole texts through the tokenizers library, at the cost of distinct words.

A byte-level BPE never merges across pre-tokens, and a space that follows a non-space always begins a pre-token.
Texts are therefore cut at such spaces; every distinct cut is encoded by the library once per worker process
and the ids of a text are gathered from that table. The result is the library's own, id for id. A text that holds
the string of one of the file's added tokens is encoded whole by the library, which puts that token's id in its place.
"""

from __future__ import annotations

import gc
import json
import re
from array import array

import numpy as np

_SPACED = re.compile(r"\s ")
_CUT = re.compile(r"(?<=\S) ")
#: Where Python's classes and the tokenizer's may differ, the library itself cuts.
_RARE = re.compile("[\x1c-\x1f\x85\u00b2\u00b3\u00b9\u00bc-\u00be\u0250-\U0010ffff]")
_PLAIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")


def byte_alphabet() -> dict[int, str]:
    """Byte-level models write each byte as a printable character: itself if printable in Latin-1, else from 256 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in set(printable)]
    return {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(others)}


class WordCoder:
    """Encodes batches of texts; keeps at most ``limit`` distinct words (about 200 bytes each) between batches."""

    def __init__(self, path: str, limit: int = 1_000_000):
        from tokenizers import Tokenizer
        from tokenizers.models import BPE

        whole = Tokenizer.from_file(path)
        spec = json.loads(whole.to_str())["model"]
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["merges"]]
        self.model = BPE(spec["vocab"], merges, cache_capacity=0)  # words reach it once, so its own cache only costs
        self.cut = whole.pre_tokenizer.pre_tokenize_str
        self.whole = whole
        self.added = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.alphabet, self.limit = byte_alphabet(), limit
        self.inner: dict[str, int] = {}  # words after a space, without it
        self.first: dict[str, int] = {}  # beginnings of texts
        self.parts: dict[str, list[int]] = {}  # pre-tokens within other words
        self.flat, self.starts = array("I"), array("q", [0])

    def _forget(self) -> None:
        """Keep the words seen first, which are the frequent ones."""
        kept = min(self.limit // 6, len(self.starts) - 1)
        self.inner = {k: v for k, v in self.inner.items() if v < kept}
        self.first, self.parts = {}, {}
        del self.flat[self.starts[kept] :]
        del self.starts[kept + 1 :]

    def _piece(self, raw: str) -> list[int]:
        if raw.isascii() and raw[1:].isalpha():
            mapped = "\u0120" + raw[1:] if raw[0] == " " else raw
        else:
            mapped = raw.encode().decode("latin-1").translate(self.alphabet)
        return [t.id for t in self.model.tokenize(mapped)]

    def _part(self, raw: str) -> list[int]:
        if raw[0] == " " and (known := self.inner.get(raw[1:])) is not None:
            return self.flat[self.starts[known] : self.starts[known + 1]]
        ids = self.parts.get(raw)
        if ids is None:
            ids = self._piece(raw)
            if len(raw) < 40:
                self.parts[raw] = ids
        return ids

    def _add(self, table: dict[str, int], key: str, raw: str) -> None:
        if key.isalpha():
            ids = self._piece(raw)
        elif not _RARE.search(raw):
            ids = [i for part in _PLAIN.findall(raw) for i in self._part(part)]
        else:
            ids = [t.id for mapped, _ in self.cut(raw) for t in self.model.tokenize(mapped)]
        table[key] = len(self.starts) - 1
        self.flat.extend(ids)
        self.starts.append(len(self.flat))

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts one after another, and each text's bounds in them (one more than texts)."""
        gc.disable()  # the table holds many small objects and no cycles
        try:
            return self._encode(texts)
        finally:
            gc.freeze()
            gc.enable()

    def _encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.starts) + len(self.parts) > self.limit or len(self.flat) > 20 * self.limit:
            self._forget()
        inner, first = self.inner, self.first
        rows: list[int] = []
        counts: list[int] = []
        for text in texts:
            if not text:
                counts.append(0)
                continue
            if any(t in text for t in self.added):
                counts.append(1)
                rows.append(len(self.starts) - 1)
                self.flat.extend(self.whole.encode(text, add_special_tokens=False).ids)
                self.starts.append(len(self.flat))
                continue
            cuts = _CUT.split(text) if _SPACED.search(text) or text[0] == " " else text.split(" ")
            counts.append(len(cuts))
            if cuts[0] not in first:
                self._add(first, cuts[0], cuts[0])
            rows.append(first[cuts[0]])
            del cuts[0]
            known = [*map(inner.get, cuts)]
            if None in known:
                for k, word in enumerate(cuts):
                    if known[k] is None:
                        if word not in inner:
                            self._add(inner, word, " " + word)
                        known[k] = inner[word]
            rows += known
        index = np.array(rows, dtype=np.int64)
        starts, flat = np.frombuffer(self.starts, dtype=np.int64), np.frombuffer(self.flat, dtype=np.uint32) if self.flat else np.zeros(0, np.uint32)
        begin, lengths = starts[index], starts[index + 1] - starts[index]
        ends = np.concatenate(([0], np.cumsum(lengths)))
        ids = flat[np.repeat(begin - ends[:-1], lengths) + np.arange(ends[-1])]
        bounds = ends[np.concatenate(([0], np.cumsum(np.array(counts, dtype=np.int64))))]
        del starts, flat
        return ids, bounds


_CODERS: dict[tuple, WordCoder] = {}


def coder(path: str, limit: int = 1_000_000) -> WordCoder:
    """One coder for each worker process and vocabulary file."""
    if (path, limit) not in _CODERS:
        _CODERS[path, limit] = WordCoder(path, limit)
    return _CODERS[path, limit]
