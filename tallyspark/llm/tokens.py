"""Token ids of whole texts by a public tokenizer, with a cache over white-space separated chunks.

The tokenizer splits at white space and drops it, so a text's ids are its chunks' ids joined, and a
chunk of letters with trailing punctuation is those two runs' ids joined: of what are letters after
NFC and lower-casing, as the tokenizer splits after them.
"""

from __future__ import annotations

import unicodedata

import numpy as np

from .common import worker_cache

#: Chunks in each of a worker's two cache generations; both together take some 280 MB.
CACHE_ENTRIES = 700_000
#: ASCII marks that the tokenizer keeps together as a run of their own after letters (no apostrophe: it starts contractions).
TRAILING = b'.,!?;:*%$#&|()"-'


def default_path() -> str:
    """The word-level BPE file of the installed public vocabularies."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _letters(stem: bytes) -> bool:
    """Whether the tokenizer keeps ``stem`` as one run of letters; NFC and lower-casing can give letters a combining mark."""
    return stem.isalpha() if stem.isascii() else unicodedata.normalize("NFC", stem.decode("utf-8", "replace")).lower().isalpha()


class ChunkEncoder(dict):
    """Maps a chunk (UTF-8 bytes without white space) to its ids (little-endian uint32 bytes).

    When the young generation is full it becomes the old one; chunks found there are moved back, so
    frequent ones stay and memory is bounded.
    """

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        from tokenizers import Tokenizer

        super().__init__()
        self.entries = entries
        self.old: dict[bytes, bytes] = {}
        self.tokenizer = Tokenizer.from_file(path)

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.old.get(chunk)
        if ids is None:
            stem = chunk.rstrip(TRAILING)
            if stem and len(stem) < len(chunk) and _letters(stem):
                ids = self[stem] + self[chunk[len(stem) :]]
            else:
                ids = np.array(self.tokenizer.encode(chunk.decode("utf-8", "replace"), add_special_tokens=False).ids, dtype="<u4").tobytes()
        if len(chunk) <= 64:
            if len(self) >= self.entries:
                self.old = dict(self)
                self.clear()
            self[chunk] = ids
        return ids

    def encode(self, text: bytes | None) -> bytes:
        """The ids of a whole UTF-8 text as little-endian uint32 bytes; null is the empty text."""
        if not text:
            return b""
        # the tokenizer lower-cases all but its special tokens, which begin with these two marks
        return b"".join(map(self.__getitem__, (text if b"<|" in text else text.lower()).split()))


def encoder(path: str, entries: int = CACHE_ENTRIES) -> ChunkEncoder:
    """The worker's encoder for a file; tasks that reuse the worker share its cache."""
    return worker_cache(("tokens", path, entries), lambda: ChunkEncoder(path, entries))
