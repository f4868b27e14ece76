"""Ids of whole texts by a word-level BPE vocabulary, with a bounded table of words seen before.

The vocabulary's rules treat what lies between white space on its own: white space is dropped, no pre-token has any
inside, and neither normalisation nor lower-casing looks beyond it. So each such stretch is encoded once and remembered.
Stretches of printable ASCII and Latin letters need no normalisation but lower case and fall into pre-tokens by a
plain expression, and the library's model encodes these; all others, and whole texts with control characters that Python
and the library class differently, go through the library's complete pipeline.
"""

from __future__ import annotations

import os
import re
from array import array
from itertools import islice

import numpy as np

from .byte_bpe import byte_characters

#: Longer stretches are not remembered.
LONGEST = 64
#: Characters that Python but not the library takes for white space.
ODD = "\x1c\x1d\x1e\x1f"
LOWER = re.compile("[a-zß-öø-ÿ]+").fullmatch
SIMPLE = re.compile("[!-&(-~À-ÖØ-öø-ÿ]+").fullmatch
PARTS = re.compile("[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+").findall


def _part(tokenize, code: str, chars: dict[int, str]):
    """Ids of one lower-case pre-token."""

    def ids(part: str) -> bytes:
        return array(code, [t.id for t in tokenize(part if part.isascii() else part.encode().decode("latin-1").translate(chars))]).tobytes()

    return ids


class _Parts(dict):
    """Ids of pre-tokens, learnt when they are first asked for."""

    def __init__(self, part) -> None:
        super().__init__()
        self.part = part

    def __missing__(self, part: str) -> bytes:
        found = self.part(part)
        if len(part) <= LONGEST:
            self[part] = found
        return found


class _Units(dict):
    """Ids of stretches, learnt when they are first asked for. What it holds must not hold it: a cycle would keep the
    tables of ended tasks until the collector comes by, which counts objects, not bytes."""

    def __init__(self, part, parts: _Parts, whole) -> None:
        super().__init__()
        self.part, self.parts, self.whole = part, parts, whole

    def __missing__(self, unit: str) -> bytes:
        if LOWER(unit):
            found = self.part(unit)
        elif not SIMPLE(unit) or "<|" in unit:
            found = self.whole(unit)
        else:
            # Letters are looked up as stretches of their own, so a word is encoded once whatever stands around it.
            found = b"".join([self[p] if p[0].isalpha() else self.parts[p] for p in PARTS(unit.lower())])
        if len(unit) <= LONGEST:
            self[unit] = found
        return found


class WordEncoder:
    """``most`` bounds the tables of stretches and of marks between letters, of LONGEST characters at most each: some 200
    bytes an entry, 500 at most. A full one keeps the half that came first, in which frequent ones are."""

    def __init__(self, path: str, most: int = 250_000) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        made = Tokenizer.from_file(path)
        made.no_truncation()
        made.no_padding()
        code = "I" if made.get_vocab_size() > 65_536 else "H"
        self.kind = np.dtype("<u4" if code == "I" else "<u2")
        self.ids = lambda text: array(code, made.encode_batch_fast([text], add_special_tokens=False)[0].ids).tobytes()
        part = _part(made.model.tokenize, code, dict(enumerate(byte_characters())))
        self.parts = _Parts(part)
        self.units = _Units(part, self.parts, self.ids)
        self.most = most

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, as numbers of :attr:`kind`, the narrowest that holds them all."""
        for table in (self.units, self.parts):
            if len(table) >= self.most:
                kept = list(islice(table.items(), self.most // 2))
                table.clear()
                table.update(kept)
        out, get = [], self.units.__getitem__
        for text in texts:
            if text and any(c in text for c in ODD):
                out.append(self.ids(text))
            else:
                out.append(b"".join(map(get, text.split())) if text else b"")
        return out
