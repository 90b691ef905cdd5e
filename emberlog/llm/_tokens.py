"""Token ids of whole texts by the tokenizers library, for use inside tasks.

A byte-level BPE never merges across its pre-tokens, and a space with a non-space on either side
always begins one. So a text is cut there and the ids of each piece are remembered: the library
encodes each frequent piece once, and the ids are those of the whole text.
"""

from __future__ import annotations

import os
import re
from functools import lru_cache

import numpy as np

_CUT = re.compile(r"(?<=\S) (?=\S)")
#: A space next to white space, or at an end: there the text is not cut.
_UNEVEN = re.compile(r" (?:(?=\s)|(?<=\s )|\Z)")
#: A Latin word and the signs after it: two pre-tokens, whose ids the BPE model gives directly.
_PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: Parts with one line break between them, which is then a pre-token.
_BROKEN = re.compile(r"\S+(?:\n\S+)+")
#: Pieces that are remembered, by length and number: some 160 bytes each.
_LONGEST, _MOST = 48, 600_000


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[int, str]:
    """The letter that a byte-level BPE has for each byte, taken from the library."""
    from tokenizers.pre_tokenizers import ByteLevel

    level, known = ByteLevel(add_prefix_space=False, use_regex=False), {}
    for c in [chr(i) for i in [*range(128), *range(128, 0x300)]]:
        ((letters, _),) = level.pre_tokenize_str(c)
        known.update(zip(c.encode(), letters, strict=True))
    return known


class Pieces(dict):
    """The ids of pieces that follow ``before`` (a space or nothing), kept for those met first."""

    def __init__(self, tokenizer, before: str, plain: bool, first: Pieces | None = None):
        super().__init__()
        self.first = self if first is None else first
        self.tokenizer, self.before, self.plain = tokenizer, before, plain
        self.model, self.letters = tokenizer.model, byte_letters()

    def of_model(self, pre_token: str) -> bytes:
        letters = pre_token.encode().decode("latin-1").translate(self.letters)
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def __missing__(self, piece: str) -> bytes:
        if self.plain and (m := _PLAIN.fullmatch(piece)):
            word, sign = m.groups()
            ids = self[word] + self.of_model(sign) if sign else self.of_model(self.before + word)
        elif self.plain and _BROKEN.fullmatch(piece):
            one, *more = piece.split("\n")
            ids = self.of_model("\n").join([self[one], *map(self.first.__getitem__, more)])
        else:
            ids = np.array(self.tokenizer.encode(self.before + piece, add_special_tokens=False).ids, "<u4").tobytes()
        if len(piece) <= _LONGEST and len(self) < _MOST:
            self[piece] = ids
        return ids


class Encoder:
    """``batch(texts)``: each text's ids as little-endian unsigned 32-bit integers."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = t = Tokenizer.from_file(path)
        #: A text that holds one of these is encoded whole: the library takes it out before the pre-tokens.
        self.added = [x.content for x in t.get_added_tokens_decoder().values()]
        pre = t.pre_tokenizer
        # Cutting and the direct way hold for byte-level BPE without normaliser; else whole texts are encoded.
        self.cuts = type(pre).__name__ == "ByteLevel" and not pre.add_prefix_space and t.normalizer is None
        self.plain = self.cuts and type(t.model).__name__ == "BPE"
        self.first = Pieces(t, "", self.plain)
        self.rest = Pieces(t, " ", self.plain, self.first)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if not self.cuts or any(x in text for x in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        first, *rest = _CUT.split(text) if _UNEVEN.search(text) else text.split(" ")
        return self.first[first] + b"".join(map(self.rest.__getitem__, rest))


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    return Encoder(path)
