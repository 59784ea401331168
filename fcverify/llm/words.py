"""Words and byte n-grams of whole texts, in bounded memory.

A word is a run of bytes other than space and the controls 9 to 13, which is what
``bytes.split`` cuts at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np

_GAP = re.compile(rb"[\x20\x09-\x0D]")
BLOCK = 1 << 20


def utf8(text: str | None) -> bytes:
    return b"" if text is None else text.encode("utf-8", "surrogatepass")


def word_blocks(data: bytes, size: int = BLOCK) -> Iterator[list[bytes]]:
    """The words in order, in lists from about ``size`` bytes of text each."""
    at = 0
    while at < len(data):
        gap = _GAP.search(data, at + size) if len(data) - at > size else None
        end = gap.start() if gap else len(data)
        words = data[at:end].split()
        if words:
            yield words
        at = end + 1


# Letters of ASCII become lower case, its other characters a space; the rest stays.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[:128] = [c if 97 <= c <= 122 else c + 32 if 65 <= c <= 90 else 32 for c in range(128)]
_PLAIN = np.arange(256, dtype=np.uint8)


def gram_counts(data: bytes, buckets: int, sizes: tuple[int, ...], fold: bool = True) -> np.ndarray:
    """Counts of hashed byte n-grams of the given sizes over the whole text; ``buckets`` is a power of two.

    A space at both ends marks the first and the last word.
    """
    shift = np.uint32(32 - (buckets.bit_length() - 1))
    counts = np.zeros(buckets, dtype=np.int64)
    table, most = (_FOLD if fold else _PLAIN), max(sizes)
    whole = np.frombuffer(b" " + data + b" ", dtype=np.uint8)
    for at in range(0, len(whole), BLOCK):
        part = table[whole[at:at + BLOCK + most - 1]].astype(np.uint32)
        for n in sizes:
            # every gram belongs to the block that its first byte is in
            m = min(BLOCK, len(whole) - at, len(part) - n + 1)
            if m <= 0:
                continue
            code = part[:m].copy()
            for i in range(1, n):
                code = code * np.uint32(0x01000193) ^ part[i:i + m]
            code = (code + np.uint32(n)) * np.uint32(0x9E3779B1)
            counts += np.bincount(code >> shift, minlength=buckets)
    return counts


# Terms: A-Z become lower case; digits, a-z and all bytes beyond ASCII stay; anything else is a gap.
_TERMS = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def term_blocks(text: str | None, size: int = BLOCK) -> Iterator[list[bytes]]:
    """Runs of ASCII letters (lower-cased), ASCII digits and characters beyond ASCII, in lists as ``word_blocks``."""
    return word_blocks(utf8(text).translate(_TERMS), size)
