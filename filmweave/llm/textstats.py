"""Counts over whole texts that quality rules and the quality model share.

Words are ``[^\\x20\\x09-\\x0D]+``, which is how bytes split at ASCII blanks.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Sequence
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as Y

from filmweave.llm.common import stage, text_rows

BLANKS = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
UPPER = bytes(range(65, 91))
LOWER = bytes(range(97, 123))
DIGITS = bytes(range(48, 58))
PUNCTUATION = b"!?"

FIELDS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_lower", "n_digits", "n_marks", "n_distinct", "n_single", "n_stops", "top_word", "dup_line_chars")


def repeat_words(words: list[bytes]) -> tuple[int, int, int]:
    """(words in 3-word windows found twice or more, distinct words, count of the most frequent word)."""
    if not words:
        return 0, 0, 0
    number = defaultdict(count().__next__)
    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
    size = len(number)
    top = int(np.bincount(ids).max())
    if len(ids) < 4:
        return 0, size, top
    pair = ids[:-1] * size + ids[1:]
    if size > 2_000_000:  # keep the window number inside 63 bits
        pair = np.unique(pair, return_inverse=True)[1]
    window = pair[:-1] * size + ids[2:]
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    if not same.any():
        return 0, size, top
    again = np.zeros(len(window), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    covered = np.zeros(len(ids), bool)
    for k in range(3):
        covered[k : len(ids) - 2 + k] |= again
    return int(covered.sum()), size, top


def text_stats(text: str | None) -> tuple[int, ...]:
    """The counts of FIELDS for one text (null: all 0)."""
    raw = text.encode("utf-8", "surrogatepass") if text else b""
    words = raw.split()
    repeats, distinct, top = repeat_words(words)
    lines = [x for x in raw.split(b"\n") if x.strip(BLANKS)]
    duplicate = duplicate_chars = 0
    if len(lines) > 1 and len(set(lines)) < len(lines):
        copies = {x: n for x, n in Counter(lines).items() if n > 1}
        duplicate = sum(copies.values()) - len(copies)
        duplicate_chars = sum(len(x) * (n - 1) for x, n in copies.items())
    size = len(raw)
    without = lambda which: size - len(raw.translate(None, which))
    return (
        len(words),
        len(text) - without(BLANKS) if text else 0,
        without(SYMBOLS),
        duplicate,
        repeats,
        len(lines),
        without(UPPER),
        without(LOWER),
        without(DIGITS),
        without(PUNCTUATION),
        distinct,
        sum(1 for w in words if len(w) == 1),
        without(b".,"),
        top,
        duplicate_chars,
    )


STATS = Y.StructType([Y.StructField(f, Y.LongType()) for f in FIELDS])


@F.arrow_udf(STATS)
def stats_of(texts: pa.Array) -> pa.Array:
    """The counts of FIELDS for every text; a row's other columns don't pass through Python."""
    rows = [text_stats(x.as_py()) for x in texts]
    columns = zip(*rows, strict=True) if rows else [()] * len(FIELDS)
    return pa.StructArray.from_arrays([pa.array(c, pa.int64()) for c in columns], names=FIELDS)


def with_stats(docs: DataFrame, carry: Sequence[str] = ("doc_id",)) -> DataFrame:
    """(carried columns, counts...) of every row of ``docs`` (text and those); staged."""
    told = stage(text_rows(docs).select(*carry, stats_of("text").alias("_stats")), "text-stats")
    return told.select(*carry, "_stats.*")
