"""Text helpers the operators share."""

from __future__ import annotations

import os

from pyspark.sql import Column, functions as F

# white space of the contracts: space, tab, line feed, vertical tab, form feed, return
SPACES = r"[\x20\x09-\x0D]+"


def whole(text: str | Column) -> Column:
    """The text, null as the empty text."""
    return F.coalesce(F.col(text) if isinstance(text, str) else text, F.lit(""))


def one_spaced(text: str | Column) -> Column:
    """Every run of white space as one space."""
    return F.regexp_replace(whole(text), SPACES, " ")


def word_list(text: str | Column) -> Column:
    return F.array_remove(F.split(whole(text), SPACES), "")


def tokenizer_path(name: str, folder: str | None = None) -> str:
    """A public vocabulary file: in ``folder``, or where the public_tokenizers package lies."""
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_names() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = (b for b in range(256) if b not in plain)
    names = {b: chr(b) for b in plain} | {b: chr(256 + n) for n, b in enumerate(others)}
    return [names[b] for b in range(256)]
