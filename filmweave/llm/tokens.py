"""Memoised encoding with a public tokenizer.

A text is split only where the tokenizer always splits it: for a word BPE at
ASCII blanks, for a byte-level BPE before a space that a non-blank follows and
around a lone line break, for both before ASCII punctuation that closes such a
piece after a letter or digit. A batch of texts is split and its pieces are told
apart and looked up in Arrow; unknown ones are encoded by the tokenizers library,
many in one call with a special token between them, and remembered, and one gather
lays all ids out. A text whose blanks are of another
shape, or that holds the opening of a special token, goes to the library whole.
Ids equal those of encoding the whole text, which the tests check.
"""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from filmweave.llm.common import chunks, keep

#: A space before a blank or the end; a line break beside a blank.
SPACE, BREAK = re.compile(r" (?:\s|\Z)"), re.compile(r"\n(?:(?<=\s\n)|(?=\s))")
#: What closes a piece: punctuation (no apostrophe, which may begin a suffix) after a letter or digit.
CLOSING = r"([\pL\pN])([!-&(-/:-@\[-`{-~]+)"
#: Pieces that a worker remembers; pieces in one call of the library; bytes of text that are told apart together.
CACHE_PIECES, CALL, TOGETHER = 1_000_000, 1000, 8 << 20


def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


class Encoder:
    """Texts -> ids as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, spaced: bool, limit: int | None = None):
        """``spaced``: a piece's leading space is part of it (byte-level BPE); else blanks and ASCII case don't matter."""
        self.raw, self.spaced, self.limit = tokenizer(path), spaced, limit or CACHE_PIECES
        special = [(i, t.content) for i, t in self.raw.get_added_tokens_decoder().items() if t.special and t.content.startswith("<|")]
        self.mark = min(special, default=None)
        #: Known pieces by place; a piece's ids are ``flat[start : start + size]``.
        self.known = pa.array([], pa.string())
        self.flat, self.start, self.size, self.used = np.empty(1 << 16, "<u4"), np.empty(1 << 14, np.int64), np.empty(1 << 14, np.int64), 0

    def whole(self, text: str) -> np.ndarray:
        return np.asarray(self.raw.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def divisible(self, text: str) -> bool:
        """Whether the ids of a text are those of its pieces."""
        return "<|" not in text and not (self.spaced and ("\0" in text or SPACE.search(text) or BREAK.search(text)))

    def pieces(self, texts: pa.Array) -> pa.ListArray:
        if self.spaced:
            marked = pc.replace_substring(pc.replace_substring(texts, "\n", "\0\n\0"), " ", "\0 ")
            return pc.split_pattern(pc.replace_substring_regex(marked, CLOSING + r"(\x00|$)", "\\1\0\\2\\3"), "\0")
        return pc.ascii_split_whitespace(pc.replace_substring_regex(pc.ascii_lower(texts), CLOSING + r"([ \t\n\v\f\r]|$)", r"\1 \2\3"))

    def encode_pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of pieces one after the other, and how many each has, by one call for many."""
        if self.mark is None:
            found = [self.whole(t) for t in texts]
            return np.concatenate(found), np.fromiter(map(len, found), np.int64, len(found))
        number, content = self.mark
        ids, sizes = [], []
        for words in chunks(texts, CALL):
            got = np.asarray(self.raw.encode_batch_fast([content.join(words)], add_special_tokens=False)[0].ids, dtype="<u4")
            mark = got == number
            sizes.append(np.diff(np.concatenate([[-1], np.flatnonzero(mark), [len(got)]])) - 1)
            ids.append(got[~mark])
        return np.concatenate(ids), np.concatenate(sizes)

    def learn(self, new: list[str]) -> np.ndarray:
        """Places of new pieces, whose ids are laid down after those known."""
        ids, sizes = self.encode_pieces(new)
        first, end = len(self.known), self.used + len(ids)
        self.flat, self.start, self.size = _room(self.flat, end), _room(self.start, first + len(new)), _room(self.size, first + len(new))
        self.start[first : first + len(new)] = self.used + np.cumsum(sizes) - sizes
        self.size[first : first + len(new)] = sizes
        self.flat[self.used : end] = ids
        self.used = end
        return np.arange(first, first + len(new))

    def batch(self, texts: pa.Array | Sequence[str | None]) -> list[bytes]:
        """Ids of texts; only distinct pieces are looked up, so many texts at a time cost less."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(texts, pa.string())
        texts = pc.fill_null(texts, "")
        alone = {k: self.whole(t) for k, t in enumerate(texts.to_pylist()) if not self.divisible(t)}
        if alone:
            divided = np.ones(len(texts), bool)
            divided[list(alone)] = False
            texts = pc.if_else(pa.array(divided), texts, "")
        split = self.pieces(texts)
        coded = split.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        place = pc.index_in(distinct, value_set=self.known)
        unknown = pc.is_null(place)
        known, before = pc.fill_null(place, -1).to_numpy().astype(np.int64), self.used
        new = distinct.filter(unknown)
        if len(new):
            known[unknown.to_numpy(zero_copy_only=False)] = self.learn(new.to_pylist())
        sizes = self.size[known][at]
        ends = np.cumsum(sizes)
        step = np.repeat(self.start[known][at] - ends + sizes, sizes)
        step += np.arange(len(step))
        ids = self.flat[step]
        cuts = np.concatenate([[0], ends])[split.offsets.to_numpy() - split.offsets[0].as_py()].tolist() if len(texts) else [0]
        if len(self.known) + len(new) <= self.limit:
            self.known = pa.concat_arrays([self.known, new]) if len(new) else self.known
        else:  # what there is no room to remember is forgotten
            self.used = before
        raw = memoryview(ids).cast("B")
        return [alone[k].tobytes() if k in alone else bytes(raw[4 * a : 4 * b]) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]


def _room(held: np.ndarray, size: int) -> np.ndarray:
    """``held``, or a copy of twice its length if ``size`` entries don't fit."""
    while len(held) < size:
        held = np.concatenate([held, np.empty_like(held)])
    return held


def together(batches: Iterator[pa.RecordBatch], column: int, size: int = TOGETHER) -> Iterator[pa.RecordBatch]:
    """Batches joined until their texts (``column``) come to ``size`` bytes."""
    held, total = [], 0
    for b in batches:
        held.append(b)
        total += b.column(column).nbytes
        if total >= size:
            yield pa.concat_batches(held)
            held, total = [], 0
    if held:
        yield pa.concat_batches(held)


def encoder(path: str, spaced: bool, limit: int | None = None) -> Callable[[pa.Array | Sequence[str | None]], list[bytes]]:
    return keep(f"encoder {path} {spaced} {limit}", lambda: Encoder(path, spaced, limit)).batch


def place(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
