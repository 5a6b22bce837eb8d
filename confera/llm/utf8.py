"""Words of Arrow text columns as places in their UTF-8 bytes, found by table lookups and differences, block by block.

A class table of 256 entries says of each byte whether it belongs to words (0: no) and gives it in lower case. Bytes from 128
on all belong to words, so no character is ever cut. Blocks hold whole texts; a text longer than a block comes in pieces that
end between words. A single word longer than a block makes its block longer.

Defined results: null and empty texts have no block. An empty column gives nothing. Words don't cross texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are worked on at once; arrays over their words take about twenty times as much.
BLOCK = 1 << 20


def byte_classes(digits: bool) -> np.ndarray:
    """Letters, and digits if told so, and all bytes from 128 on; A-Z as a-z; 0 for the rest."""
    out = np.arange(256, dtype=np.uint8)
    out[ord("A") : ord("Z") + 1] += 32
    word = np.zeros(256, dtype=bool)
    word[ord("a") : ord("z") + 1] = word[ord("A") : ord("Z") + 1] = word[128:] = True
    word[ord("0") : ord("9") + 1] = digits
    return np.where(word, out, 0).astype(np.uint8)


@dataclass
class Block:
    """rows: numbers of the column's rows; low: their bytes, classified; starts, ends: places of words; of: the word's row here.

    seen: the first word was in the block before, and comes again for what follows it. part: one piece of a long text.
    """

    rows: np.ndarray
    low: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    of: np.ndarray
    seen: bool = False
    part: bool = False


def word_places(low: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where words start and end in classified bytes; rows: where texts start, as a word ends with its text."""
    inside = low != 0
    turns = np.diff(inside.view(np.int8), prepend=0, append=0)
    starts, ends = turns[:-1] == 1, turns[1:] == -1
    first = rows[(rows > 0) & (rows < len(low))]
    joined = first[inside[first] & inside[first - 1]]
    starts[joined] = True
    ends[joined - 1] = True
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def pieces(low: np.ndarray, block: int = BLOCK) -> Iterator[tuple[np.ndarray, bool]]:
    """A long text in blocks that end between words; each but the first begins with the last word of the one before."""
    at, seen, n = 0, False, len(low)
    while True:
        end = min(at + block, n)
        while end < n:
            # The block ends after its last gap, if that leaves a word before the gap to go on from.
            inside = low[at:end] != 0
            gaps = np.flatnonzero(~inside)
            words = np.flatnonzero(inside[: gaps[-1]]) if len(gaps) else gaps
            if len(words):
                back = np.flatnonzero(~inside[: words[-1]])
                begin = at + (back[-1] + 1 if len(back) else 0)
                if begin > at or not seen:
                    break
            end = min(n, end + block)
        if end == n:
            yield low[at:], seen
            return
        yield low[at : at + gaps[-1]], seen
        at, seen = begin, True


def _block(rows: np.ndarray, low: np.ndarray, row_starts: np.ndarray, seen: bool, part: bool) -> Block:
    starts, ends = word_places(low, row_starts)
    return Block(rows, low, starts, ends, np.searchsorted(row_starts, starts, side="right") - 1, seen, part)


def word_blocks(column: pa.Array, classes: np.ndarray, block: int = BLOCK) -> Iterator[Block]:
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    if not len(column) or offsets[-1] == offsets[0]:
        return
    data = np.frombuffer(column.buffers()[2], np.uint8)
    lengths = np.diff(offsets)
    if column.null_count:
        lengths = np.where(column.is_null().to_numpy(zero_copy_only=False), 0, lengths)
    at = 0
    while at < len(lengths):
        if lengths[at] > block:
            for low, seen in pieces(classes[data[offsets[at] : offsets[at] + lengths[at]]], block):
                yield _block(np.array([at]), low, np.zeros(1, np.int64), seen, True)
            at += 1
            continue
        upto = max(at + 1, int(np.searchsorted(offsets, offsets[at] + block, side="right")) - 1)
        rows = np.arange(at, upto)[lengths[at:upto] > 0]  # texts without bytes are left out, so every start is another place
        if len(rows):
            yield _block(rows, classes[data[offsets[at] : offsets[upto]]], offsets[rows] - offsets[at], False, False)
        at = upto


def as_strings(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> pa.Array:
    """The words at these places, which follow each other, as one Arrow array."""
    offsets = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(ends - starts, out=offsets[1:])
    # Outside the words all bytes are 0, so what isn't is the words one after the other.
    bytes_ = low[starts[0] : ends[-1]] if len(starts) else low[:0]
    return pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(bytes_[bytes_ != 0])))
