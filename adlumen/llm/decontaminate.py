"""Benchmark decontamination by spaced-seed hashing, with DataFrame operations only.

Texts are lower-cased runs of letters and digits.  A seed is the hash of the tokens a mask selects from ``SPAN`` tokens in a
row, so a substituted token at an ignored place leaves it as it is.  Seeds of the benchmark are joined with those of every
position of every document; around each hit, up to ``WINDOW`` tokens of the item are compared with the document's on the
same diagonal, and the hit counts if ``SHARE`` of them are equal.

A benchmark grows with the number of tests, not with the corpus.  Its seeds are broadcast after being counted; beyond
``BROADCAST_SEEDS`` the join shuffles, with the same result.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from adlumen.llm.common import stored

# Masks of one span, 7 of 11 tokens each.
MASKS = ("11101011001", "11010011101", "10110100111")
SPAN = 11
WINDOW = 20
SHARE = 0.8
# Shorter items say too little to be told from ordinary text.
LEAST_TOKENS = 8
BROADCAST_SEEDS = 250_000
# Documents with hits of which the ids are broadcast to fetch their texts; beyond, the join shuffles.
LISTED = 200_000


def tokens(text: Column) -> Column:
    """Lower-cased runs of letters and digits; a text that begins or ends otherwise has an empty token there."""
    return F.split(F.lower(F.coalesce(text.cast("string"), F.lit(""))), r"[^\p{L}\p{N}]+")


def _hashed(words: Column) -> Column:
    return F.transform(words, lambda w: F.xxhash64(w))


def _seed(mask: str) -> Callable[[Column], Column]:
    chosen = [i for i, bit in enumerate(mask) if bit == "1"]
    return lambda p: F.xxhash64(F.lit(mask), *[F.get("h", p + i) for i in chosen])


def _seeds(rows: DataFrame, masks: list[str]) -> DataFrame:
    """A row per position and mask for rows with ``h``: ``p`` (from 0) and ``seed``; ``h`` itself is not carried along.

    Masks of equal length are tried together; whole-item masks, being shorter, fit at more positions.
    """
    out = None
    rest = [c for c in rows.columns if c != "h"]
    for length in sorted({len(m) for m in masks}):
        places = F.sequence(F.lit(0), F.size("h") - length)
        every = F.flatten(F.array(*[F.transform(places, _seed(m)) for m in masks if len(m) == length]))
        each = rows.filter(F.size("h") >= length).select(*rest, (F.size("h") - length + 1).alias("n"), F.posexplode(every).alias("at", "seed"))
        each = each.select(*rest, (F.col("at") % F.col("n")).alias("p"), "seed")
        out = each if out is None else out.unionByName(each)
    return out


def windows(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> tuple[DataFrame, list[str]]:
    """``seed, back, window, item_id, items``: the tokens around each seed, and by how many tokens they precede it.

    Items that share a window count as one, the smallest id; items without id come last.  Also the masks: those of full
    span, and one of ones for each shorter length that occurs.
    """
    items = benchmark.select(
        F.col(id_column).cast("long").alias("item_id"), F.filter(tokens(F.col(text_column)), lambda w: w != "").alias("words")
    ).filter(F.size("words") >= LEAST_TOKENS)
    items = items.groupBy("words").agg(F.min("item_id").alias("item_id"), F.count("*").alias("copies")).withColumn("h", _hashed(F.col("words"))).drop("words")
    # At most SPAN - LEAST_TOKENS lengths.
    short = [r[0] for r in items.filter(F.size("h") < SPAN).select(F.size("h").alias("n")).distinct().collect()]
    items = items.withColumn("item", F.col("h"))
    every = _seeds(items.filter(F.size("h") >= SPAN), list(MASKS))
    for n in sorted(short):
        every = every.unionByName(_seeds(items.filter(F.size("h") == n), ["1" * n]))
    width = F.least(F.lit(WINDOW), F.size("item"))
    first = F.least(F.greatest(F.col("p") - F.lit((WINDOW - SPAN) // 2), F.lit(0)), F.size("item") - width)
    cut = every.select("seed", (F.col("p") - first).alias("back"), F.slice("item", first + 1, width).alias("window"), "item_id", "copies")
    found = cut.groupBy("seed", "back", "window").agg(F.min("item_id").alias("item_id"), F.sum("copies").alias("items"))
    return stored(found), [*MASKS, *["1" * n for n in sorted(short)]]


def contaminated(
    docs: DataFrame, benchmark: DataFrame, share: float = SHARE, id_column: str = "doc_id", text_column: str = "text",
    item_id_column: str = "item_id", item_text_column: str = "text", broadcast_seeds: int = BROADCAST_SEEDS,
) -> DataFrame:
    """``uid, doc_id, item_id, n_hits, first_token, overlap``: a row per document and benchmark window it holds, best first.

    ``uid`` names a row's id and text (repeated rows are reported once), ``item_id`` is the smallest item with the window,
    ``first_token`` counts from 0 and ``overlap`` is the largest share of equal tokens.  Null and empty texts hold nothing;
    items under ``LEAST_TOKENS`` tokens are not looked for, those under ``SPAN`` must occur whole and unchanged.
    """
    found, masks = windows(benchmark, item_id_column, item_text_column)
    if found.count() <= broadcast_seeds:
        found = F.broadcast(found)
    doc, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    rows = docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("uid"), text.alias("text"))
    hashed = rows.select("uid", _hashed(tokens(F.col("text"))).alias("h"))
    hits = _seeds(hashed, masks).join(found, "seed").select("uid", (F.col("p") - F.col("back")).alias("start"), "window", "item_id").filter("start >= 0").distinct()
    # A document's hits, each a window's place and tokens: no more than it has places, times items that share a seed there.
    per_row = stored(hits.groupBy("uid").agg(F.collect_list(F.struct("start", "window", "item_id")).alias("hits")))
    held = per_row if per_row.limit(LISTED + 1).count() > LISTED else F.broadcast(per_row.select("uid"))
    some = rows.join(held.select("uid"), "uid", "left_semi").select("uid", "doc_id", _hashed(tokens(F.col("text"))).alias("h")).dropDuplicates(["uid"])

    def overlap(hit: Column) -> Column:
        there = F.slice("h", hit["start"] + 1, F.size(hit["window"]))
        equal = F.aggregate(F.zip_with(hit["window"], there, lambda a, b: F.coalesce((a == b).cast("int"), F.lit(0))), F.lit(0), lambda s, x: s + x)
        return F.struct(hit["item_id"].alias("item_id"), hit["start"].alias("first_token"), (equal / F.size(hit["window"])).alias("overlap"), (hit["start"] + F.size(hit["window"]) <= F.size("h")).alias("inside"))

    checked = some.join(per_row, "uid").select("uid", "doc_id", F.explode(F.transform("hits", overlap)).alias("o")).select("uid", "doc_id", "o.*")
    checked = checked.filter(F.col("inside") & (F.col("overlap") >= share))
    return checked.groupBy("uid", "doc_id", "item_id").agg(
        F.countDistinct("first_token").alias("n_windows"), F.min("first_token").alias("first_token"), F.max("overlap").alias("overlap")
    )


def clean(docs: DataFrame, benchmark: DataFrame, id_column: str = "doc_id", text_column: str = "text", **options) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no benchmark window."""
    bad = contaminated(docs, benchmark, id_column=id_column, text_column=text_column, **options).select(F.col("uid").alias("_uid")).distinct()
    doc, text = docs[id_column].cast("long"), F.coalesce(docs[text_column].cast("string"), F.lit(""))
    return docs.join(bad, F.xxhash64(doc, text) == bad["_uid"], "left_anti")
