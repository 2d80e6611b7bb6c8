"""Compression bands: zstandard ratios of whole documents and of fixed chunks.

A text is kept if it passes the base counts and its ratio (bytes / compressed bytes) lies in the band of its length,
and no more than half of its chunks lie outside the band of a chunk. Repetitive text is above a band, noise below it.
A null text has no words; it is rejected. Rows are independent: ties and repeated rows give repeated rows, an empty table gives none.
A text of any length is read whole, a very long one as a step of its own. Columns of the counts' names among the given ones are not read.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common as c


@dataclass(frozen=True)
class Bands:
    """rows: (from this many bytes on, least ratio, largest ratio). chunk: bytes of a chunk. share: of chunks outside that reject."""

    rows: tuple[tuple[int, float, float], ...] = ((0, 0.0, 3.0), (256, 1.0, 3.6), (1024, 1.15, 4.5), (4096, 1.3, 6.0), (16384, 1.4, 8.0))
    chunk: int = 4096
    share: float = 0.5
    level: int = 3

    def of(self, n: int) -> tuple[float, float]:
        return next((lo, hi) for least, lo, hi in reversed(self.rows) if n >= least)


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, ratio double, n_chunks long, n_chunks_outside long"

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_FOLLOWS = np.zeros(256, bool)
_FOLLOWS[0x80:0xC0] = True
_NO_WORD = " \t\n\x0b\x0c\r"


def duplicate_lines(text: str) -> int:
    if "\n" not in text:
        return 0
    lines = [x for x in text.split("\n") if x.strip(_NO_WORD)]
    return len(lines) - len(set(lines))


def repeated_words(row: np.ndarray, h: np.ndarray, n_rows: int) -> np.ndarray:
    """Words of each row that lie in a 3-word window which the row has twice or more."""
    if len(h) < 4:
        return np.zeros(n_rows, np.int64)
    at = np.flatnonzero(row[:-2] == row[2:])
    window = c.mix(h[at] + c.mix(h[at + 1] + c.mix(h[at + 2] + row[at].astype(np.uint64) * np.uint64(0xA24BAED4963EE407))))
    order = np.argsort(window, kind="stable")
    same = window[order][1:] == window[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(h), bool)
    for k in range(3):
        covered[at[twice] + k] = True
    return np.bincount(row[covered], minlength=n_rows)


def band_verdict(text: bytes, z: zstandard.ZstdCompressor, bands: Bands) -> tuple[bool, float, int, int]:
    """Inside its bands?; the ratio; chunks; chunks outside."""
    if not text:
        return False, 0.0, 0, 0
    ratio = len(text) / len(z.compress(text))
    lo, hi = bands.of(len(text))
    if len(text) <= bands.chunk:
        return lo <= ratio <= hi, ratio, 0, 0
    lo_c, hi_c = bands.of(bands.chunk)
    # a short tail counts with the chunk before it, so that every chunk has at least the chunk's length
    cuts = [*range(0, len(text) - bands.chunk + 1, bands.chunk), len(text)]
    outside = sum(not lo_c <= (b - a) / len(z.compress(text[a:b])) <= hi_c for a, b in zip(cuts[:-1], cuts[1:], strict=True))
    n = len(cuts) - 1
    return lo <= ratio <= hi and outside <= bands.share * n, ratio, n, outside


def _measure(ids: pa.Array, column: pa.Array, z: zstandard.ZstdCompressor, bands: Bands):
    data, offsets = c.byte_view(column)
    for lo, hi in c.slices(offsets):
        own, off = data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        n = hi - lo
        row, start, end = c.words(own, off)
        n_words = np.bincount(row, minlength=n)
        repeat = repeated_words(row, c.word_hashes(own, start, end, lower=False), n)
        # words hold every byte that is not a space; a code point is a byte that does not follow another
        chars = c.per_row(~(c._SPACE[own] | _FOLLOWS[own]), off)
        part = column.slice(lo, n)
        dup = np.array([duplicate_lines(t) for t in part.to_pylist()], np.int64)
        failed = (n_words < 50) | (100 * repeat > 50 * n_words)
        raw = own.tobytes()
        verdict = [band_verdict(raw[off[i] : off[i + 1]], z, bands) for i in range(n)]
        kept = ~failed & np.array([v[0] for v in verdict], bool)
        arrays = [ids.slice(lo, n), n_words, chars, c.per_row(_SYMBOL[own], off), dup, repeat, failed, kept, [v[1] for v in verdict], [v[2] for v in verdict], [v[3] for v in verdict]]
        kinds = [pa.int64()] * 6 + [pa.bool_(), pa.bool_(), pa.float64(), pa.int64(), pa.int64()]
        yield pa.RecordBatch.from_arrays([pa.array(a, k) if not isinstance(a, pa.Array) else a.cast(k) for a, k in zip(arrays, kinds, strict=True)], names=[f.split()[0] for f in SCHEMA.split(", ")])


def compression_bands(docs: DataFrame, bands: Bands = Bands(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:  # noqa: B008
    """The counts and the verdict of every document; SCHEMA."""

    def run(batches):
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            yield from _measure(b.column(0), c.texts(b.column(1)), z, bands)

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(c.lean(run), SCHEMA)


def keep_good(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:  # noqa: B008
    """The documents that pass, with all their columns. The verdict is made where the row is: no join, so ids may repeat or be null."""
    from pyspark.sql import types as T

    schema = T.StructType([*docs.schema.fields])
    at = docs.columns.index("text")

    def run(batches):
        z = zstandard.ZstdCompressor(level=bands.level)
        for b in batches:
            n = b.num_rows
            if n:
                kept = pa.concat_arrays([m.column(7) for m in _measure(pa.nulls(n, pa.int64()), c.texts(b.column(at)), z, bands)])
                yield b.filter(kept)

    return docs.mapInArrow(c.lean(run), schema)
