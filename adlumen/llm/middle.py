"""Fill-in-the-middle transformation, its cuts located on a wavelet matrix of character classes.

A text is a row of *units*: a run of ASCII letters, or any other single code point.  Every UTF-8 byte has a class that
says what it begins: nothing (a letter within a run; a later byte of a code point) or a unit (the first letter of a run,
a digit, white space, another ASCII character, the first byte of a longer code point).  The wavelet matrix of these
classes (Claude, Navarro and Ordonez, 2015) counts any class in any prefix by one rank query a level, and sums of ranks
are what the transformation asks for: units begun among the first i bytes, code points among the first i bytes.  The
place where k units end is found by bisection on the former.  A block of texts has one matrix, and the queries of all
its texts are answered together.

A row is transformed in its own task without any shuffle; memory is that of one Arrow batch, or of one text if longer.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from adlumen.llm.common import small_batches

# Classes by the first value that belongs to the next group: nothing begins below FIRST, no code point at LATER_BYTE.
WITHIN_RUN, LATER_BYTE, FIRST_LETTER, DIGIT, WHITE, OTHER_ASCII, FIRST_BYTE = range(7)
LEVELS = 3
BEGINS_UNIT = (FIRST_LETTER, DIGIT, WHITE, OTHER_ASCII, FIRST_BYTE)
MARKS = {"prefix": "<P>", "suffix": "<S>", "middle": "<M>"}
PLAIN_SHARE, SPM_SHARE = 10, 20
BLOCK_BYTES = 4 << 20

_CLASS = np.full(256, FIRST_BYTE, dtype=np.uint8)
_CLASS[:128] = OTHER_ASCII
_CLASS[128:192] = LATER_BYTE
_CLASS[48:58] = DIGIT
_CLASS[[9, 10, 11, 12, 13, 32]] = WHITE
_CLASS[65:91] = _CLASS[97:123] = FIRST_LETTER


def classes(data: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """The class of every byte of texts that follow each other and start at ``starts``."""
    out = _CLASS[data]
    letter = out == FIRST_LETTER
    run_on = np.zeros(len(data), dtype=bool)
    run_on[1:] = letter[1:] & letter[:-1]
    run_on[starts[starts < len(data)]] = False
    out[run_on] = WITHIN_RUN
    return out


class WaveletMatrix:
    """Ranks of symbols below ``2 ** levels`` in prefixes of a sequence.

    Each level holds one bit of every symbol, packed in words with running counts, in the order that the bits above
    leave: zeros first, then ones, each in their earlier order.
    """

    def __init__(self, symbols: np.ndarray, levels: int = LEVELS):
        self.size, self.levels = len(symbols), []
        for level in reversed(range(levels)):
            bit = (symbols >> level & 1).astype(bool)
            packed = np.packbits(bit, bitorder="little")
            words = np.zeros(len(bit) // 64 + 1, dtype="<u8")
            words.view(np.uint8)[: len(packed)] = packed
            counts = np.zeros(len(words), dtype=np.int64)
            np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:])
            self.levels.append((words, counts, self.size - int(bit.sum())))
            symbols = np.concatenate((symbols[~bit], symbols[bit]))

    @staticmethod
    def _ones(words: np.ndarray, counts: np.ndarray, at: np.ndarray) -> np.ndarray:
        """Set bits before each place."""
        word = at >> 6
        below = (np.uint64(1) << (at & 63).astype(np.uint64)) - np.uint64(1)
        return counts[word] + np.bitwise_count(words[word] & below)

    def rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        """How often ``symbol`` stands before each place of ``at``."""
        lo, hi = np.zeros_like(at), at
        for i, (words, counts, zeros) in enumerate(self.levels):
            a, b = self._ones(words, counts, lo), self._ones(words, counts, hi)
            lo, hi = (zeros + a, zeros + b) if symbol >> (len(self.levels) - 1 - i) & 1 else (lo - a, hi - b)
        return hi - lo


class Texts:
    """Unit and code point counts of many texts over one wavelet matrix; places are bytes from each text's start."""

    def __init__(self, texts: list[bytes]):
        self.length = np.array([len(t) for t in texts], dtype=np.int64)
        self.start = np.cumsum(self.length) - self.length
        data = np.frombuffer(b"".join(texts), dtype=np.uint8)
        self.matrix = WaveletMatrix(classes(data, self.start))
        self._before = {c: self.matrix.rank(c, self.start) for c in (*BEGINS_UNIT, LATER_BYTE)}

    def _rank(self, symbol: int, at: np.ndarray) -> np.ndarray:
        return self.matrix.rank(symbol, self.start + at) - self._before[symbol]

    def units(self, at: np.ndarray) -> np.ndarray:
        """Units that begin before each text's place."""
        return sum(self._rank(c, at) for c in BEGINS_UNIT)

    def code_points(self, at: np.ndarray) -> np.ndarray:
        return at - self._rank(LATER_BYTE, at)

    def end_of(self, units: np.ndarray) -> np.ndarray:
        """Where the first ``units`` units of each text end: before the next one begins, or at the end of the text."""
        lo, hi = np.zeros_like(self.length), self.length.copy()
        while (open_ := lo < hi).any():
            # The largest place before which no further unit begins.
            middle = np.where(open_, (lo + hi + 1) >> 1, hi)
            fits = self.units(middle) <= units
            lo, hi = np.where(open_ & fits, middle, lo), np.where(open_ & ~fits, middle - 1, hi)
        return lo


def _blocks(texts: list[bytes]) -> Iterator[slice]:
    """Runs of texts of about ``BLOCK_BYTES`` together."""
    first = size = 0
    for i, t in enumerate(texts):
        size += len(t)
        if size >= BLOCK_BYTES:
            yield slice(first, i + 1)
            first, size = i + 1, 0
    if first < len(texts):
        yield slice(first, len(texts))


def drawn(id_column: str, seed: int = 1) -> Column:
    """Four numbers below 2^32 for each id, from the SHA-256 of ``seed:id``; a null id counts as an empty one."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_column).cast("string"), F.lit(""))), 256)
    return F.array(*[F.conv(F.substring(digest, 8 * i + 1, 8), 16, 10).cast("long") for i in range(4)])


def transformed(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", seed: int = 1) -> DataFrame:
    """``doc_id, n, form, prefix_chars, middle_chars, output`` for each row.

    ``n`` counts the units; two hashes modulo ``n + 1`` are the cuts, the smaller one first.  A text stays *plain* where
    it is empty (or null), holds a mark or is drawn for it (``PLAIN_SHARE`` in 100); of the rest ``SPM_SHARE`` in 100 are
    *spm* (suffix, prefix, middle), the others *psm*.  Plain rows have null lengths.  Rows that repeat an id or a text are
    transformed alike, each for itself; a null id draws as an empty one.  Extra columns are ignored, whatever their
    names; an empty table gives an empty result.
    """
    marks = [m.encode() for m in MARKS.values()]
    p, s, m = marks

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            every = [t or b"" for t in batch.column(1).cast(pa.large_binary()).to_pylist()]
            draws = np.array(batch.column(2).to_pylist(), dtype=np.int64).reshape(-1, 4)
            for part in _blocks(every):
                texts, (h1, h2, h3, h4) = every[part], draws[part].T
                counted = Texts(texts)
                n = counted.units(counted.length)
                first, second = counted.end_of(np.minimum(h1 % (n + 1), h2 % (n + 1))), counted.end_of(np.maximum(h1 % (n + 1), h2 % (n + 1)))
                before, until = counted.code_points(first), counted.code_points(second)
                form, out = [], []
                for t, a, b, x, y in zip(texts, first.tolist(), second.tolist(), h3.tolist(), h4.tolist()):
                    if not t or x % 100 >= 100 - PLAIN_SHARE or any(mark in t for mark in marks):
                        form.append("plain")
                        out.append(t)
                    elif y % 100 < SPM_SHARE:
                        form.append("spm")
                        out.append(b"".join((s, t[b:], p, t[:a], m, t[a:b])))
                    else:
                        form.append("psm")
                        out.append(b"".join((p, t[:a], s, t[b:], m, t[a:b])))
                plain = np.array([f == "plain" for f in form])
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(part.start, len(texts)), pa.array(n, pa.int64()), pa.array(form, pa.string()),
                        pa.array(before, pa.int64(), mask=plain), pa.array(until - before, pa.int64(), mask=plain),
                        pa.array(out, pa.binary()).cast(pa.string()),
                    ],
                    names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"],
                )

    small_batches(docs.sparkSession)
    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"), drawn(id_column, seed).alias("draws"))
    return rows.mapInArrow(run, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(form: Column, output: Column) -> Column:
    """The text that an output was made of: a transformed text holds no mark, so each mark stands in it once."""
    parts = F.split(output, "<[PSM]>", -1)
    return F.when(form == "plain", output).when(form == "psm", F.concat(parts[1], parts[3], parts[2])).otherwise(F.concat(parts[2], parts[3], parts[1]))


def checked(docs: DataFrame, **options) -> DataFrame:
    """:func:`transformed` with digests of the output and of the text rebuilt from it in place of the output."""
    out = transformed(docs, **options)
    return out.select(
        "doc_id", "n", "form", "prefix_chars", "middle_chars",
        F.sha2("output", 256).alias("output_sha256"), F.sha2(restored(F.col("form"), F.col("output")), 256).alias("restored_sha256"),
    )
