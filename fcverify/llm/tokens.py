"""Token ids of whole texts by a public tokenizer file, with a bounded memo of words.

A text is cut only where the tokenizer itself always cuts, and every piece is encoded by
the ``tokenizers`` library, so the ids are those of the whole text. Pieces repeat: those
seen first are kept, up to ``MEMO`` of them.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np
import public_tokenizers

# Kept pieces, and the length up to which one is kept.
MEMO, KEEP = 700_000, 40
_LATIN = "A-Za-zÀ-ÖØ-öø-ÿ"
# Cuts are set before spaces, line feeds, commas and full stops. Not so in texts where two
# white spaces meet or a comma or full stop follows anything but a Latin letter or a digit.
_GAPS = re.compile(r"\s\s")
_ODD_MARK = re.compile(rf"(?<![0-9{_LATIN}])[,.]")
_BEFORE_SPACE = re.compile(r"(?<=\S)(?= )")
# One word of Latin letters is one input of the merges, whatever stands around it.
_WORD = re.compile(rf"[ \n]?([{_LATIN}]+)")
# How byte-level vocabularies write bytes: those that print as themselves, the others from U+0100 on, in order.
_PRINTS = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_AS_CHARS = str.maketrans({b: chr(b) if b in _PRINTS else chr(0x100 + sum(x not in _PRINTS for x in range(b))) for b in range(256)})


class Encoder(dict):
    """``ids(text)`` as unsigned 32-bit numbers; itself the memo of pieces.

    ``folds``: the vocabulary lower-cases and drops white space.
    """

    def __init__(self, path: str, folds: bool):
        super().__init__({"": b""})
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole, self.folds = Tokenizer.from_file(path), folds
        self.merges = self.whole.model

    def pieces(self, text: str) -> list[str]:
        if _GAPS.search(text) or _ODD_MARK.search(text) or "\0" in text:
            return _BEFORE_SPACE.split(text)
        for mark in " \n,.":
            text = text.replace(mark, "\0" + mark)
        return text.split("\0")

    def __missing__(self, piece: str) -> bytes:
        word = _WORD.fullmatch(piece)
        if word and (self.folds or piece[0] != "\n"):
            form = word[1].lower() if self.folds else piece
            ids = [t.id for t in self.merges.tokenize(form.encode().decode("latin-1").translate(_AS_CHARS))]
        else:
            ids = self.whole.encode(piece, add_special_tokens=False).ids
        out = np.array(ids, dtype="<u4").tobytes()
        if len(piece) <= KEEP and len(self) < MEMO:
            self[piece] = out
        return out

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(b"".join(map(self.__getitem__, self.pieces(text))), dtype="<u4")


@lru_cache(maxsize=4)
def encoder(name: str) -> Encoder:
    """The encoder of a public tokenizer file; one for each Python worker, so its memo serves later tasks too."""
    path = name if os.sep in name else public_tokenizers.path(name)
    return Encoder(path, folds=os.path.basename(path).startswith("word_"))
