"""Token ids of texts by the tokenizers library, with a memo of what words become.

A byte-level BPE never merges across the pieces that its pre-tokenizer cuts, and
a cut always falls before a space that some other character follows. So a text
is cut there, and what each part becomes is kept for the next time. Parts that
are new are gathered for a batch of texts, cut into the pre-tokenizer's pieces in
one pass, and pieces that are new go to the library's model; parts with unusual
characters go through the library's own pre-tokenizer. Texts that hold an added
token (such as ``<|endoftext|>``) go to the library whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from functools import lru_cache

import numpy as np

from .common import dropped_by_others

#: Parts and pieces kept for each worker process, and their longest; once full, further ones are encoded anew for each batch.
MEMO_PARTS, MEMO_WORDS, MEMO_CHARS = 350_000, 150_000, 64
CUT = re.compile(r" (?=\S)")
#: For all other characters Python's classes are the same as the tokenizer's, so its pattern can be run here.
UNUSUAL = re.compile(r"[^\x21-\x7e\nÀ-ÖØ-öø-ɏ]")
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?[^\W\d_]+| ?\d+| ?(?:[^\s\w]|_)+|\s+(?!\S)|\s+")


def _byte_characters() -> dict[int, str]:
    """The printable character that byte-level BPE writes for each byte: itself, or the next one from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    rest = [b for b in range(256) if b not in set(own)]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(rest)}


class Encoder:
    """Ids as little-endian unsigned 32-bit integers in bytes."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenize = self.tokenizer.model.tokenize
        self.table = _byte_characters()
        self.raw = [k.to_bytes(4, "little") for k in range(self.tokenizer.get_vocab_size())]
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parts: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def word(self, piece: str) -> bytes:
        """One piece of the pre-tokenizer."""
        out = self.words.get(piece)
        if out is None:
            raw = self.raw
            out = b"".join([raw[t.id] for t in self.tokenize(piece.encode().decode("latin-1").translate(self.table))])
            if len(self.words) < MEMO_WORDS and len(piece) < MEMO_CHARS:
                self.words[piece] = out
        return out

    def fresh(self, parts: Iterable[str]) -> dict[str, bytes]:
        """What parts become, each behind a space."""
        usual, out = [], {}
        for p in parts:
            if UNUSUAL.search(p):
                out[p] = self.whole(" " + p)
            else:
                usual.append(p)
        if usual:
            pieces = PIECE.findall(" " + " ".join(usual))
            at = [k for k, w in enumerate(pieces) if w[0] == " "]
            ids = list(map(self.word, pieces))
            out.update((p, ids[a] if z == a + 1 else b"".join(ids[a:z])) for p, a, z in zip(usual, at, [*at[1:], len(ids)], strict=True))
        return out

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text; a null one is empty."""
        find, out, todo, new = self.parts.get, [], [], set()
        for k, text in enumerate(texts):
            if not text or any(x in text for x in self.added):
                out.append(self.whole(text) if text else b"")
                continue
            cut = text.split(" ")
            got = list(map(find, cut))
            got[0] = b""
            holes = [i for i, x in enumerate(got) if x is None]
            if any(not cut[i] or cut[i][0].isspace() for i in holes):  # white space follows a space, or nothing does
                cut = CUT.split(text)
                got = list(map(find, cut))
                got[0] = b""
                holes = [i for i, x in enumerate(got) if x is None]
            if cut[0]:
                got[0] = self.whole(cut[0])
            out.append(b"" if holes else b"".join(got))
            if holes:
                new.update([cut[i] for i in holes])
                todo.append((k, cut, got, holes))
        if todo:
            extra = self.fresh(new)
            room = MEMO_PARTS - len(self.parts)
            if room > 0:
                self.parts.update([x for x in extra.items() if len(x[0]) < MEMO_CHARS][:room])
            for k, cut, got, holes in todo:
                for i in holes:
                    got[i] = extra[cut[i]]
                out[k] = b"".join(got)
        return out

    def encode(self, text: str | None) -> bytes:
        return self.encode_many([text])[0]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker process and vocabulary."""
    return Encoder(path)


dropped_by_others(encoder.cache_clear)


def vocabulary(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)
