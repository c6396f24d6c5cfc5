"""Splitting texts into the pre-tokens of a tokenizers file, with a quick path for common characters.

The quick path covers texts whose characters all lie in QUICK; there a plain regular expression gives the same pre-tokens as the library's own steps (tests compare them). Every other text goes through the library's normalizer and pre-tokenizer.
"""

from __future__ import annotations

import functools
import json
import os
import re
import unicodedata

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

QUICK = [*range(0x00, 0x180), *range(0x2010, 0x2028)]
_OTHER = re.compile("[^\\x00-\\u017f\\u2010-\\u2027]")


def _set(pick) -> str:
    return "".join(re.escape(chr(c)) for c in QUICK if pick(chr(c)))


def _space(c: str) -> bool:
    return c in "\t\n\x0b\x0c\r \x85\xa0"


_L, _N, _S = (_set(lambda c: unicodedata.category(c)[0] == "L"), _set(lambda c: unicodedata.category(c)[0] == "N"), _set(_space))
BYTE_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
LOWER_WORDS = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")


@functools.lru_cache(maxsize=4)
def load(path: str):
    """The library's tokenizer, without truncation and padding."""
    from tokenizers import Tokenizer

    out = Tokenizer.from_file(path)
    out.no_truncation()
    out.no_padding()
    return out


@functools.lru_cache(maxsize=4)
def splitter(path: str):
    """A function from a text to its pre-tokens; an added token stands as (id,)."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    tok = load(path)
    added = {x["content"]: (x["id"],) for x in spec["added_tokens"]}
    assert not any(x["normalized"] or x["lstrip"] or x["rstrip"] or x["single_word"] for x in spec["added_tokens"])
    specials = re.compile("(" + "|".join(map(re.escape, sorted(added, key=len, reverse=True))) + ")") if added else None
    marks = [x[:2] for x in added]
    lower = spec["normalizer"] is not None
    pattern = LOWER_WORDS if lower else BYTE_WORDS

    def slow(text: str) -> list:
        if tok.normalizer is not None:
            text = tok.normalizer.normalize_str(text)
        return [("raw", x) for x, _ in tok.pre_tokenizer.pre_tokenize_str(text)]

    def plain(text: str) -> list:
        if not text.isascii() and (_OTHER.search(text) or lower and "İ" in text):
            return slow(text)
        return pattern.findall(text.lower() if lower else text)

    def split(text: str) -> list:
        if any(m in text for m in marks):
            out = []
            for k, part in enumerate(specials.split(text)):
                out += [added[part]] if k % 2 else plain(part) if part else []
            return out
        return plain(text)

    return split


@functools.lru_cache(maxsize=4)
def encoder(path: str):
    """A function from distinct pre-tokens to their id lists."""
    tok = load(path)

    def encode(found: list) -> list[list[int]]:
        out: list = [None] * len(found)
        plain = []
        for k, x in enumerate(found):
            if isinstance(x, str):
                plain.append(k)
            elif x[0] == "raw":
                out[k] = [t.id for t in tok.model.tokenize(x[1])]
            else:
                out[k] = list(x)
        for first in range(0, len(plain), 4096):
            part = plain[first : first + 4096]
            for k, e in zip(part, tok.encode_batch_fast([found[k] for k in part], add_special_tokens=False), strict=True):
                out[k] = e.ids
        return out

    return encode
