"""Token ids of whole texts by the tokenizers library, memoised by word.

The vocabulary is byte-level BPE: a text is first cut into pieces, and every
piece is encoded by itself.  A blank that is followed by a non-space character
always starts a piece, so a text without runs of white space is the sequence
of its blank-separated chunks, each encoded with its blank.  Chunks repeat, so
their ids are kept in a bounded table of the worker process; only chunks not
in it go through the library.  Texts that the cut does not fit (runs of white
space) go through the library whole.  Special tokens written in a text become
their ids, as the library has it.
"""

from __future__ import annotations

import os
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

VOCABULARY = "byte_bpe_50k.json"
END_ID = 0
_CLOSERS = ".,;:!?"
_MOST = 700_000  # entries kept by a worker


class _Irregular(Exception):
    """The text has white space that the cut into chunks does not fit."""


class _Known(dict):
    """Chunk -> its ids as little-endian unsigned 32-bit integers."""

    def __init__(self, owner: TextEncoder, lead: str):
        super().__init__()
        self.owner, self.lead = owner, lead

    def __missing__(self, chunk: str) -> bytes:
        if not chunk or chunk[0].isspace():
            raise _Irregular
        if "\n" in chunk:
            return self._lines(chunk)
        body = chunk.rstrip(_CLOSERS)
        if body != chunk and body and (body[-1].isalpha() or body[-1] in "0123456789"):
            # A letter or digit ends a piece before a closer, whatever comes after.
            ids = self[body] + self.owner.closer(chunk[len(body) :])
        elif chunk.isalpha():
            ids = self.owner.piece(self.lead + chunk)
        else:
            ids = self.owner.library(self.lead + chunk)
        if len(self) < _MOST:
            self[chunk] = ids
        return ids

    def _lines(self, chunk: str) -> bytes:
        head, *rest = chunk.split("\n")
        if not head or head[-1].isspace() or any(not x or x[0].isspace() or x[-1].isspace() for x in rest):
            return self.owner.library(self.lead + chunk)
        # A lone line feed between other characters is a piece of its own.
        feed = self.owner.closer("\n")
        return feed.join([self[head], *(self.owner.bare[x] for x in rest)])


def _alphabet() -> dict[int, int]:
    """Byte -> character of the vocabulary: printable Latin-1 stays, the others follow from 256."""
    stays = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    moved = (b for b in range(256) if b not in stays)
    return {b: b for b in stays} | {b: 256 + k for k, b in enumerate(moved)}


class TextEncoder:
    """ids(text): all ids of a text, the end id not included, as bytes (<u4)."""

    def __init__(self, path: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path(VOCABULARY)
        self._tokenizer = Tokenizer.from_file(path)
        self._model, self._alphabet = self._tokenizer.model, _alphabet()
        self.spaced, self.bare, self._closers = _Known(self, " "), _Known(self, ""), {}
        self._seen = self._missed = 0

    def library(self, text: str) -> bytes:
        self._missed += 1
        return array("I", self._tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def piece(self, text: str) -> bytes:
        """Ids of letters with or without a blank before them, which are one piece."""
        self._missed += 1
        mapped = text.encode().decode("latin-1").translate(self._alphabet)
        return array("I", [x.id for x in self._model.tokenize(mapped)]).tobytes()

    def closer(self, text: str) -> bytes:
        if (ids := self._closers.get(text)) is None:
            ids = self.library(text)
            if len(self._closers) < 10_000:
                self._closers[text] = ids
        return ids

    def ids(self, text: str | None) -> bytes:
        return self.batch(pa.array([text], pa.string()))[0].tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a batch of texts, end to end, and the offsets of each text in them.

        The chunks of the whole batch are made distinct by Arrow, looked up
        once each, and the ids gathered by one take().
        """
        texts = pc.fill_null(texts, "")
        chunks = pc.split_pattern(texts, " ")
        starts = chunks.offsets.to_numpy().astype(np.int64)
        coded = chunks.values.dictionary_encode()
        codes = coded.indices.to_numpy().astype(np.int64)
        table, odd = [], []
        known = self.spaced
        for k, chunk in enumerate(coded.dictionary.to_pylist()):
            try:
                table.append(known[chunk])
            except _Irregular:
                table.append(b"")
                odd.append(k)
        n = len(table)
        heads = coded.dictionary.take(pa.array(codes[starts[:-1]])).to_pylist()
        whole: set[int] = set()
        if odd:
            flags = np.zeros(n, dtype=bool)
            flags[odd] = True
            hit = flags[codes]
            hit[starts[:-1]] = False  # a first chunk has no blank before it
            whole = set((np.searchsorted(starts, np.flatnonzero(hit), side="right") - 1).tolist())
        for d, head in enumerate(heads):
            if d in whole:
                codes[starts[d] : starts[d + 1]] = n + d
                codes[starts[d] + 1 : starts[d + 1]] = n + len(heads)
                table.append(self.library(texts[d].as_py()))
                continue
            codes[starts[d]] = n + d
            try:
                table.append(self.bare[head] if head else b"")
            except _Irregular:
                table.append(self.library(head))
        table.append(b"")
        taken = pa.array(table, pa.binary()).take(pa.array(codes))
        ends = np.frombuffer(taken.buffers()[1], dtype=np.int32, count=len(codes) + 1).astype(np.int64)
        ids = np.frombuffer(taken.buffers()[2], dtype="<u4", count=int(ends[-1]) // 4) if ends[-1] else np.zeros(0, "<u4")
        self._seen += len(codes)
        if self._seen > 3_000_000:  # texts of another kind: start afresh
            if self._missed > 0.3 * self._seen:
                self.spaced.clear()
                self.bare.clear()
            self._seen = self._missed = 0
        return ids, ends[starts] // 4


@lru_cache(maxsize=2)
def encoder(path: str | None = None) -> TextEncoder:
    """One encoder for each worker process."""
    return TextEncoder(path)
