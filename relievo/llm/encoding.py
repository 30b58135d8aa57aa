"""Token ids of whole texts, with a bounded memory of the pieces already encoded.

A byte-level BPE first splits a text by a fixed pattern and then merges inside each piece, so
the ids of a text are the ids of its pieces in order.  Pieces repeat far more than texts; a
worker therefore keeps the ids of the pieces it has met, and encodes only new ones.
"""

from __future__ import annotations

import base64
import json
import os
import re
from functools import cached_property, lru_cache

import numpy as np

#: Letters of Latin-1, and the splitting pattern for texts of nothing but printable ASCII, these letters, tab and line ends.
LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\xff"
LATIN_PIECES = rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s0-9{LETTERS}]+|\s+(?!\S)|\s+"
NOT_LATIN = rf"[^\x20-\x7e\t\n\r{LETTERS}]"
#: Pieces that a worker remembers; the memory starts anew beyond it.
MOST_PIECES = 200_000


def tokenizer_path(name: str) -> str:
    """The place of a tokenizer file: a path as given, or a name of the installed collection."""
    if os.path.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


class _Pieces(dict):
    """Piece to ids in four bytes each, encoded on first sight."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> bytes:
        if len(self) >= MOST_PIECES:
            self.clear()
        ids = self[piece] = np.array(self.encode(piece), dtype="<u4").tobytes()
        return ids


class ByteBpe:
    """``ids(text)``: the ids as little-endian unsigned 32-bit numbers, as the tokenizers library gives them.

    New pieces are encoded by that library, or, where ``ranks`` names a file of the same
    vocabulary as ranks, by tiktoken's faster merge of the same pieces.  A text that holds the
    string of a special token goes to the library whole.
    """

    def __init__(self, name: str, ranks: str | None = None):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.path = tokenizer_path(name)
        with open(self.path, encoding="utf-8") as f:
            self.special = [t["content"] for t in json.load(f)["added_tokens"]]
        self.latin, self.odd = re.compile(LATIN_PIECES), re.compile(NOT_LATIN)
        import public_tokenizers
        import regex

        self.general = regex.compile(public_tokenizers.PATTERN)
        if ranks:
            import tiktoken

            table = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(tokenizer_path(ranks), "rb"))}
            core = tiktoken.Encoding(ranks, pat_str=public_tokenizers.PATTERN, mergeable_ranks=table, special_tokens={})._core_bpe
            self.pieces = _Pieces(lambda piece: core.encode_single_piece(piece.encode()))
        else:
            self.pieces = _Pieces(lambda piece: self.library.encode(piece, add_special_tokens=False).ids)

    @cached_property
    def library(self):
        """The tokenizers library's own, loaded when first needed."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def ids(self, text: str) -> bytes:
        if any(s in text for s in self.special):
            return np.array(self.library.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        found = (self.general if self.odd.search(text) else self.latin).findall(text)
        return b"".join(map(self.pieces.__getitem__, found))


@lru_cache(maxsize=4)
def encoder(name: str, ranks: str | None = None) -> ByteBpe:
    """One encoder for all tasks of a worker."""
    return ByteBpe(name, ranks)
