"""Sizes of texts: the tokenizer-free size of the queries, and sizes in tokens of public tokenizers.

The tokenizer-free size counts one per longest run of letters and digits (Unicode L or N) and one
per other character that is not whitespace. Characters are classified with a table over all code
points, so a batch of texts is counted by a few numpy passes over its characters.
"""

from __future__ import annotations

import base64
import functools
import unicodedata
from collections.abc import Callable, Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

SPACE, WORD, OTHER = 0, 1, 2
#: Characters handled at once; longer texts are counted window by window.
WINDOW = 4_000_000


@functools.cache
def character_classes() -> np.ndarray:
    """Class of every code point."""
    table = np.full(0x110000, OTHER, np.uint8)
    for code in range(0x110000):
        c = chr(code)
        if c.isspace():
            table[code] = SPACE
        elif unicodedata.category(c)[0] in "LN":
            table[code] = WORD
    return table


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def token_starts(classes: np.ndarray, after_word: bool = False) -> np.ndarray:
    """True where a unit of size begins."""
    word = classes == WORD
    before = np.empty_like(word)
    before[1:] = word[:-1]
    if len(before):
        before[0] = after_word
    return (word & ~before) | (classes == OTHER)


def windows(texts: Iterable[str]) -> Iterable[list[str]]:
    """Consecutive texts in lists of at most ``WINDOW`` characters, a longer text alone."""
    held, chars = [], 0
    for t in texts:
        if held and chars + len(t) > WINDOW:
            yield held
            held, chars = [], 0
        held.append(t)
        chars += len(t)
    if held:
        yield held


def _long_size(text: str) -> int:
    total, after_word = 0, False
    for at in range(0, len(text), WINDOW):
        classes = character_classes()[code_points(text[at : at + WINDOW])]
        total += int(token_starts(classes, after_word).sum())
        after_word = bool(classes[-1] == WORD)
    return total


def text_sizes(texts: Sequence[str | None]) -> np.ndarray:
    """Tokenizer-free sizes; None has 0."""
    out = []
    for part in windows("" if t is None else t for t in texts):
        if len(part) == 1 and len(part[0]) > WINDOW:
            out.append(np.array([_long_size(part[0])]))
            continue
        # A line end between texts keeps runs of neighbouring texts apart.
        starts = token_starts(character_classes()[code_points("\n".join(part))])
        ends = np.cumsum([len(t) + 1 for t in part]) - 1
        running = np.r_[0, np.cumsum(starts)]
        out.append(np.diff(np.r_[0, running[ends]]))
    return np.concatenate(out).astype(np.int64) if out else np.empty(0, np.int64)


@functools.cache
def _tokenizer(kind: str, path: str) -> Callable[[list[str]], list[int]]:
    if kind == "tokenizers":
        from tokenizers import Tokenizer

        t = Tokenizer.from_file(path)
        t.encode_special_tokens = True
        return lambda texts: [len(e.ids) for e in t.encode_batch(texts, add_special_tokens=False)]
    if kind == "sentencepiece":
        import sentencepiece

        p = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(e) for e in p.encode(texts, num_threads=1)]
    if kind == "tiktoken":
        import public_tokenizers
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        return lambda texts: [len(e.encode_ordinary(t)) for t in texts]
    raise ValueError("kind is one of tokenizers, sentencepiece, tiktoken")


def sizer(tokenizer: tuple[str, str] | None = None) -> Callable[[Sequence[str | None]], np.ndarray]:
    """The size function: tokenizer-free, or tokens of ``(kind, path of its vocabulary file)``."""
    if tokenizer is None:
        return text_sizes
    kind, path = tokenizer
    return lambda texts: np.array(_tokenizer(kind, path)(["" if t is None else t for t in texts]), np.int64)


def text_size(text: Column | str, tokenizer: tuple[str, str] | None = None) -> Column:
    """The size of a text column as bigint; NULL text has 0."""

    @F.arrow_udf("bigint")
    def size(texts: pa.Array) -> pa.Array:
        return pa.array(sizer(tokenizer)(texts.to_pylist()), pa.int64())

    return size(text)
