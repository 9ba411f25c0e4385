"""Byte-level BPE ids of whole texts with the ``tokenizers`` library."""

from __future__ import annotations

import numpy as np
from tokenizers import Tokenizer

from lodestar.llm.units import UnitEncoder, unicode_space

_encoders: dict[str, UnitEncoder] = {}
_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[x for x in range(0x21, 0x7F) if not chr(x).isalnum() and chr(x) not in "'<|"]] = True


def letter_then_mark(data: np.ndarray) -> np.ndarray:
    """Where an ASCII mark follows a letter of ASCII or Latin-1: a cut of every byte-level pattern.

    The apostrophe (contractions) and the outer marks of ``<|special|>`` tokens stay with their word.
    """
    after = np.zeros(len(data), bool)
    after[1:] = _LETTER[data[:-1]]
    if len(data) > 2:
        after[2:] |= (data[:-2] == 0xC3) & (data[1:-1] >= 0x80) & (data[1:-1] != 0x97) & (data[1:-1] != 0xB7)
    return after & _MARK[data]


def _byte_letters() -> list[str]:
    """The printable stand-in of every byte in byte-level BPE vocabularies."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def encoder(path: str) -> UnitEncoder:
    """The unit encoder for a byte-level ``tokenizer.json`` without prefix space; one for each worker.

    Words of letters alone take the short way to the library's BPE model;
    every other unit passes the library's whole pipeline.  Special tokens in
    a text count as the library's default has it.
    """
    if path in _encoders:
        return _encoders[path]
    whole = Tokenizer.from_file(path)
    model, letters = whole.model, _byte_letters()
    table = {b: x for b, x in enumerate(letters)}
    blank = letters[0x20]

    def encode(units: list[bytes], first: list[bool]) -> list[list[int]]:
        tokenize, out, rest = model.tokenize, [], []
        for raw in units:
            text = raw.decode("utf-8", "replace")
            spaced = text[0] == " "
            if (text[1:] if spaced else text).isalpha():
                if not text.isascii():
                    text = raw.decode("latin-1").translate(table)
                elif spaced:
                    text = blank + text[1:]
                out.append([x.id for x in tokenize(text)])
            else:
                rest.append(len(out))
                out.append(text)
        done = whole.encode_batch_fast([out[i] for i in rest], add_special_tokens=False)
        for i, x in zip(rest, done, strict=True):
            out[i] = x.ids
        return out

    _encoders[path] = UnitEncoder(encode, unicode_space, split=letter_then_mark)
    return _encoders[path]
