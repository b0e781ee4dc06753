"""Cutting oversized texts at natural boundaries by recursive bisection.

A text above the limit is cut at the strongest boundary near its midpoint (paragraph, line,
sentence, word, then any unit), and its halves again while they exceed the limit minus the
overlap. Then every piece but the first gets the ``overlap`` units before it put in front (all of
the piece before, should that be smaller), so no piece exceeds the limit. Cuts lie only between units of size, and the pieces without their
overlaps join to the exact text.

Sizes are the tokenizer-free sizes of ``sizes.py``; ``Splitter`` also takes unit offsets of any
tokenizer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidegraph.llm.sizes import SPACE, WINDOW, character_classes, code_points, token_starts

LIMIT, OVERLAP = 400, 40
BOUNDARIES = ("none", "word", "sentence", "line", "paragraph")
SENTENCE_ENDS = np.array([ord(c) for c in ".!?…。！？؟।"], np.uint32)
CLOSERS = np.array([ord(c) for c in "\"'”’»)]"], np.uint32)
#: Output rows and characters after which a batch is passed on.
BATCH_ROWS, BATCH_CHARS = 5_000, 4_000_000


@dataclass
class Units:
    """Character offset of every unit of a text, and the strength (0..4) of the boundary before it."""

    starts: np.ndarray
    strength: np.ndarray


def _window_units(text: str) -> Units:
    codes = code_points(text)
    classes = character_classes()[codes]
    starts = np.flatnonzero(token_starts(classes))
    strength = np.zeros(len(starts), np.int8)
    if len(starts) > 1:
        following = np.r_[codes[1:], np.uint32(0)]
        line_ends = np.cumsum((codes == 10) | ((codes == 13) & (following != 10)))
        between = np.diff(line_ends[starts])
        gap = classes[starts[1:] - 1] == SPACE
        first = codes[starts]
        ends = np.isin(first, SENTENCE_ENDS)
        closed = np.isin(first, CLOSERS)
        closed[1:] &= ends[:-1]
        closed[0] = False
        sentence = (ends | closed)[:-1] & (gap | (first[:-1] > 0x3000))
        strength[1:] = np.select([between >= 2, between == 1, sentence, gap], [4, 3, 2, 1], 0)
    return Units(starts, strength)


def units_of(text: str) -> Units:
    """Units of a text of any length, found window by window with two units of context."""
    if len(text) <= WINDOW:
        return _window_units(text)
    starts, strength, at, width = [], [], 0, WINDOW
    while True:
        part = _window_units(text[at : at + width])
        final = at + width >= len(text)
        if not final and len(part.starts) < 8 and len(part.starts) > 0 and width < len(text):
            width *= 2
            continue
        skip = 2 if any(map(len, starts)) else 0
        keep = len(part.starts) if final else max(skip, len(part.starts) - 1)
        starts.append(part.starts[skip:keep] + at)
        strength.append(part.strength[skip:keep])
        if final:
            return Units(np.concatenate(starts), np.concatenate(strength))
        at, width = (int(part.starts[keep - 2] + at), WINDOW) if keep >= 2 else (at, width * 2)


def bisect(strength: np.ndarray, limit: int, overlap: int) -> list[int]:
    """The unit numbers at which a text is cut, in order; none if it is not above the limit."""
    n = len(strength)
    if n <= limit:
        return []
    most, cuts, todo = limit - overlap, [], [(0, n)]
    while todo:
        a, b = todo.pop()
        if b - a <= most:
            continue
        middle, reach = (a + b) // 2, max(1, (b - a) // 4)
        low, high = max(a + 1, middle - reach), min(b - 1, middle + reach)
        window = strength[low : high + 1]
        strongest = np.flatnonzero(window == window.max()) + low
        cut = int(strongest[np.argmin(np.abs(strongest - middle))])
        cuts.append(cut)
        todo += [(a, cut), (cut, b)]
    return sorted(cuts)


@dataclass(frozen=True)
class Splitter:
    limit: int = LIMIT
    overlap: int = OVERLAP

    def __post_init__(self):
        if self.overlap < 0 or self.limit - self.overlap < 1:
            raise ValueError("overlap must be from 0 to limit - 1")

    def pieces(self, text: str, units: Units | None = None) -> list[tuple[int, int, int, int, str, int, int]]:
        """``(start, core_start, end, size, boundary, paragraph, paragraph size)`` per piece, in characters and units.

        ``text[core_start:end]`` of all pieces join to the text; ``text[start:core_start]`` repeats
        the overlap. ``boundary`` names what the piece begins at ("start" for the first), and the
        paragraph (numbered from 1; 0 in a text without units) is the one its core begins in.
        """
        units = units or units_of(text)
        edges = [0, *bisect(units.strength, self.limit, self.overlap), len(units.starts)]
        number = np.cumsum(units.strength == 4)
        sizes = np.bincount(number) if len(number) else np.zeros(1, np.int64)
        out = []
        for i in range(len(edges) - 1):
            a, b = edges[i], edges[i + 1]
            front = max(0, a - self.overlap) if i else 0
            at = int(number[a]) if len(number) else -1
            out.append(
                (
                    int(units.starts[front]) if i else 0,
                    int(units.starts[a]) if i else 0,
                    int(units.starts[b]) if b < len(units.starts) else len(text),
                    b - front,
                    BOUNDARIES[units.strength[a]] if i else "start",
                    at + 1,
                    int(sizes[at]),
                )
            )
        return out


def split_documents(df: DataFrame, doc_id: str, text: str, splitter: Splitter = Splitter()) -> DataFrame:
    """``(doc_id, piece_no, start, core_start, end, size, boundary, paragraph_no, paragraph_size, piece)`` of every document.

    Offsets count characters (code points). A NULL text has no piece; an empty or blank one has one
    piece of size 0. Repeated ids are split separately. Documents stay in their partition: no shuffle.
    """
    chosen = df.select(F.col(doc_id), F.col(text).alias("__text")).filter("__text IS NOT NULL")
    longs = lambda *names: [T.StructField(c, T.LongType()) for c in names]
    schema = T.StructType(
        [chosen.schema[doc_id], *longs("piece_no", "start", "core_start", "end", "size"), T.StructField("boundary", T.StringType()), *longs("paragraph_no", "paragraph_size"), T.StructField("piece", T.StringType())]
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows, chars = b.column(0), [], 0
            for i, x in enumerate(b.column(1)):
                t = x.as_py()
                for no, (start, core, end, *rest) in enumerate(splitter.pieces(t)):
                    rows.append((i, no, start, core, end, *rest, t[start:end]))
                    chars += end - start
                    if len(rows) >= BATCH_ROWS or chars >= BATCH_CHARS:
                        yield _batch(ids, rows, schema.names)
                        rows, chars = [], 0
            if rows:
                yield _batch(ids, rows, schema.names)

    return chosen.mapInArrow(run, schema)


def cut_paragraphs(pieces: DataFrame, doc_id: str) -> DataFrame:
    """``(doc_id, paragraph_no, paragraph_size)`` of every paragraph that a cut went through, out of the pieces.

    Only paragraphs with a piece that begins inside them are left, so the distinct rows are few.
    """
    inside = pieces.filter(~F.col("boundary").isin("start", "paragraph"))
    return inside.select(doc_id, "paragraph_no", "paragraph_size").distinct()


def _batch(ids: pa.Array, rows: list[tuple], names: list[str]) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), *(pa.array(c) for c in columns[1:])], names=names)
