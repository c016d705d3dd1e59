"""Packing of tokenised documents into sequences of fixed length: first-fit decreasing in randomised groups.

Documents are cut into pieces of at most one sequence.  Pieces are dealt to groups at random, so that each group holds a
mix of all lengths and no source or document fills one.  In a group, pieces go by falling length into the first sequence
with room, found by descending a tournament tree over the capacities left.
"""

from __future__ import annotations

import base64
import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from adlumen.llm.common import small_batches, stored

SEQUENCE = 2048
END_ID = 1
GROUP_PIECES = 8192
_OTHER_CHARACTER = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-\u017f\u0391-\u03a1\u03a3-\u03ff\u0410-\u044f\u2010-\u2026\u20ac]")
_PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit numbers, by ``tokenizers`` and the vocabulary at ``path``.

    ``ranks`` names the same vocabulary for ``tiktoken``, which takes a third of the time.  It is used for texts of
    common European letters, digits and marks only, where both libraries class every character alike (tested), and without
    a special token's string.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        # Their strings in a text are single ids, which the quick way would not make.
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.quick = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                table = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.quick = tiktoken.Encoding("quick", pat_str=pattern, mergeable_ranks=table, special_tokens={})

    def __call__(self, text: str) -> bytes:
        if self.quick and not _OTHER_CHARACTER.search(text) and not any(t in text for t in self.special):
            return np.array(self.quick.encode_ordinary(text), dtype="<u4").tobytes()
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()


def pieces(docs: DataFrame, tokenizer: tuple[str, ...], sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each document's ids and its end, cut every ``sequence`` ids; ``deal`` is a random number for each piece.

    ``tokenizer`` holds the arguments of :class:`Encoder`; its files are read on the executors.
    """
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encode, order = Encoder(*tokenizer), 0
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = encode(text or "") + end
                total = len(ids) // 4
                for start in range(0, total, sequence):
                    part = ids[4 * start : 4 * (start + sequence)]
                    order += 1
                    deal = zlib.crc32(f"{doc}:{start}:{order}".encode())
                    out.append((doc, start, len(part) // 4, zlib.crc32(part), total, deal, part if with_ids else None))
            kinds = [pa.int64()] * 6 + [pa.binary()]
            yield pa.RecordBatch.from_arrays(
                [pa.array([o[i] for o in out], k) for i, k in enumerate(kinds)],
                names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "deal", "ids"],
            )

    rows = docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).cast("string").alias("text"))
    return rows.mapInArrow(run, f"{_PIECE}, deal long, ids binary")


def first_fit(lengths: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of each item, items in falling order; bins are opened in order from 0."""
    leaves = 1 << max(len(lengths) - 1, 0).bit_length()
    tree = [capacity] * (2 * leaves)
    out = np.empty(len(lengths), dtype=np.int64)
    for i, n in enumerate(lengths.tolist()):
        node = 1
        while node < leaves:
            node *= 2
            if tree[node] < n:
                node += 1
        out[i] = node - leaves
        tree[node] -= n
        while node > 1:
            node //= 2
            best = tree[2 * node] if tree[2 * node] >= tree[2 * node + 1] else tree[2 * node + 1]
            if tree[node] == best:
                break
            tree[node] = best
    return out


def packed(docs: DataFrame, tokenizer: tuple[str, ...], sequence: int = SEQUENCE, end_id: int = END_ID, with_ids: bool = False,
           id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """A row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, sequence_tokens, padded_to``.

    ``with_ids`` adds ``ids`` (little-endian unsigned 32-bit).  A sequence is padded to ``sequence`` tokens, or stays as it
    is at a power of two.  A null or empty text is a document of its end alone.  Rows with equal or null ids are packed
    each for itself; extra columns are ignored; an empty table gives an empty result.
    """
    small_batches(docs.sparkSession)
    cut = stored(pieces(docs, tokenizer, sequence, end_id, with_ids, id_column, text_column))
    groups = max(1, math.ceil(cut.count() / GROUP_PIECES))
    extra = ["ids"] if with_ids else []

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "deal", "doc_id", "start"], ascending=[False, True, True, True], kind="stable", ignore_index=True)
        length = pdf["length"].to_numpy()
        full = int((length == sequence).sum())
        place = np.concatenate((np.arange(full), full + first_fit(length[full:], sequence)))
        order = np.argsort(place, kind="stable")
        pdf, place, length = pdf.iloc[order], place[order], length[order]
        total = np.bincount(place, weights=length).astype(np.int64)
        first = np.searchsorted(place, place)
        before = np.cumsum(length) - length
        used = total[place]
        pdf["sequence_id"] = (pdf["bin_group"].to_numpy() << 32) + place
        pdf["offset"] = before - before[first]
        pdf["sequence_tokens"] = used
        pdf["padded_to"] = np.where(used & (used - 1) == 0, used, sequence)
        return pdf.drop(columns=["deal", "bin_group"])

    kind = f"{_PIECE}, " + "ids binary, " * with_ids + "sequence_id long, offset long, sequence_tokens long, padded_to long"
    rows = cut.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", *extra, "deal", F.pmod("deal", F.lit(groups)).alias("bin_group"))
    return rows.groupBy("bin_group").applyInPandas(run, kind)
