"""Words of UTF-8 texts by byte translation, for the tasks of Arrow operators.

A 256-byte table lower-cases A-Z and blanks every ASCII byte that is neither a
digit nor a letter; bytes from 0x80 on, the parts of other characters, stay.
``bytes.split`` then yields the words without decoding a text.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa

#: byte -> lower-cased byte, or a blank for a separator
TABLE = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c >= 128 else 32
              for c in range(256))

#: Rows whose texts a task holds as Python objects at once.
ROWS = 1024


def words(text: bytes) -> list[bytes]:
    return text.translate(TABLE).split()


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The batches in pieces of at most ``ROWS`` rows."""
    for b in batches:
        for at in range(0, b.num_rows, ROWS):
            yield b.slice(at, ROWS)


def raw(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null is empty."""
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


class Memo(dict):
    """What ``fn`` gives for a word; forgotten as a whole beyond ``bound`` words,
    so that its memory does not follow the vocabulary."""

    def __init__(self, fn, bound: int = 1 << 19):
        super().__init__()
        self.fn, self.bound = fn, bound

    def __missing__(self, word: bytes):
        if len(self) >= self.bound:
            self.clear()
        value = self[word] = self.fn(word)
        return value
