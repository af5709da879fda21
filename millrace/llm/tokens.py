"""Token ids by a public tokenizer, for whole documents, with bounded memory.

The vocabulary file is a parameter: a path, or a name that the installed ``public_tokenizers`` package resolves on each
worker. Vocabularies of the ``word_bpe`` kind lower-case, drop white space and never merge across a piece of text (a
run of letters, one digit, a run of signs, an English clitic), so the ids of a text are the ids of its pieces put
together. Pieces recur: each worker keeps bounded tables of the packed ids of chunks (between blanks) and of pieces.
Texts beyond Latin-1 are cut at blanks only, and their chunks go through the tokenizer's own steps.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable

VOCABULARY = "word_bpe_49k.json"
#: Entries of each half of a table that a worker keeps; a full half replaces the other. Longer keys are never kept.
MOST_KEPT, LONGEST_KEPT = 120_000, 32

# The tokenizer's pieces within Latin-1, lower case: fixed values of the vocabulary's own pre-tokenizer.
LETTERS = "a-zªµºß-öø-ÿ"
DIGITS = "0-9²³¹¼½¾"
BLANKS = r"\t\n\x0b\x0c\r\x20\x85\xa0"
PIECE = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[{DIGITS}]|[^{LETTERS}{DIGITS}{BLANKS}]+")
CUTS = str.maketrans(dict.fromkeys("\n\t\r", " "))


class _Kept(dict):
    """A bounded table that makes what it lacks; entries in use move from the old half to the new one, others go."""

    def __init__(self, make):
        super().__init__()
        self.make, self.old = make, {}

    def __missing__(self, key: str) -> bytes:
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(key) <= LONGEST_KEPT:
            if len(self) >= MOST_KEPT:
                self.old = dict(self)
                self.clear()
            self[key] = value
        return value


class Encoder:
    """Packed little-endian unsigned 32-bit ids of whole texts, without special tokens."""

    def __init__(self, vocabulary: str = VOCABULARY):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        if not os.path.exists(vocabulary):
            import public_tokenizers

            vocabulary = public_tokenizers.path(vocabulary)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.bpe = self.tokenizer.model
        # byte-level spelling within Latin-1, asked of the tokenizer itself
        self.spelled = {i: found[0][0] for i in range(256) if (found := self.tokenizer.pre_tokenizer.pre_tokenize_str(chr(i)))}
        self.latin = _Kept(self._latin)
        self.other = _Kept(self._chunk)

    def _piece(self, piece: str) -> bytes:
        found = self.bpe.tokenize(piece.translate(self.spelled))
        return b"".join([t.id.to_bytes(4, "little") for t in found])

    def _latin(self, chunk: str) -> bytes:
        """Chunks and their pieces share a table, as a piece is a chunk with one piece."""
        found = PIECE.findall(chunk)
        if found == [chunk]:
            return self._piece(chunk)
        return b"".join(map(self.latin.__getitem__, found))

    def _chunk(self, chunk: str) -> bytes:
        return b"".join([i.to_bytes(4, "little") for i in self.tokenizer.encode(chunk, add_special_tokens=False).ids])

    def encode(self, text: str | None) -> bytes:
        """The packed ids; a null text counts as empty."""
        if not text:
            return b""
        if "<|" in text:  # may hold a special token's string, which can span chunks
            return self._chunk(text)
        try:
            text.encode("latin-1")
        except UnicodeEncodeError:
            return b"".join(map(self.other.__getitem__, text.translate(CUTS).split(" ")))
        return b"".join(map(self.latin.__getitem__, text.lower().translate(CUTS).split(" ")))

    def encode_many(self, texts):
        """For an Arrow array of texts: all ids one after another, and the offsets of the texts in them."""
        import numpy as np
        import pyarrow as pa
        import pyarrow.compute as pc

        texts = pc.fill_null(texts, "")
        odd = pc.match_substring_regex(texts, r"<\||[^\x00-\x{ff}]")
        words = pc.ascii_split_whitespace(pc.utf8_lower(pc.if_else(odd, "", texts)))
        coded = words.flatten().dictionary_encode()
        packed = list(map(self.latin.__getitem__, coded.dictionary.to_pylist()))
        sizes = np.fromiter(map(len, packed), dtype="int64", count=len(packed)) // 4
        lists = pa.LargeListArray.from_arrays(np.concatenate([[0], np.cumsum(sizes)]), pa.array(np.frombuffer(b"".join(packed), dtype="<u4")))
        ids = lists.take(coded.indices).flatten().to_numpy()
        ends = np.concatenate([[0], np.cumsum(sizes[coded.indices.to_numpy()])])
        offsets = ends[words.offsets.to_numpy() - words.offsets[0].as_py()]
        if pc.any(odd).as_py():
            parts = [np.frombuffer(self.encode(texts[i].as_py()), dtype="<u4") if x else ids[offsets[i] : offsets[i + 1]] for i, x in enumerate(odd.to_pylist())]
            ids, offsets = np.concatenate(parts), np.concatenate([[0], np.cumsum([len(x) for x in parts])])
        return ids, offsets


def encoder(vocabulary: str, kept: dict[str, Encoder] = {}) -> Encoder:  # noqa: B006
    """One encoder for each worker process and vocabulary."""
    if vocabulary not in kept:
        kept[vocabulary] = Encoder(vocabulary)
    return kept[vocabulary]
