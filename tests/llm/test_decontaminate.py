"""Spaced seeds against plain loops over all windows."""

import random
import re

from adlumen.llm import decontaminate as d

SCHEMA = "doc_id long, text string, item_id string, uid string, h string"


def tokens(text):
    return re.split(r"[^\w]+", (text or "").lower().replace("_", " "))


def brute(docs, items):
    """(doc_id, item_id, windows, first, overlap) by comparing the window of every seed of every item with every place."""
    seeds = {}
    by_text = {}
    for i, t in items:
        w = tuple(x for x in tokens(t) if x)
        if len(w) >= d.LEAST_TOKENS:
            by_text[w] = min(i, by_text.get(w, i))
    for w, i in by_text.items():
        for mask in d.MASKS if len(w) >= d.SPAN else ["1" * len(w)]:
            for p in range(len(w) - len(mask) + 1):
                size = min(d.WINDOW, len(w))
                first = min(max(p - (d.WINDOW - d.SPAN) // 2, 0), len(w) - size)
                key = (mask, tuple(w[p + k] for k, b in enumerate(mask) if b == "1"))
                win = (p - first, w[first : first + size])
                held = seeds.setdefault(key, {})
                held[win] = min(i, held.get(win, i))
    masks = {m for m, _ in seeds}
    out = {}
    for doc, t in docs:
        w = tokens(t)
        for mask in masks:
            for p in range(len(w) - len(mask) + 1):
                for (back, win), item in seeds.get((mask, tuple(w[p + k] for k, b in enumerate(mask) if b == "1")), {}).items():
                    s = p - back
                    if s >= 0 and s + len(win) <= len(w):
                        share = sum(a == b for a, b in zip(win, w[s:])) / len(win)
                        if share >= d.SHARE:
                            out.setdefault((doc, item), {}).setdefault(s, []).append(share)
    return [(doc, item, len(x), min(x), max(max(v) for v in x.values())) for (doc, item), x in out.items()]


def data():
    r = random.Random(3)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(4))
    items = [(i, " ".join(word() for _ in range(r.choice([8, 9, 10, 11, 14, 25, 60])))) for i in range(12)]
    items += [(20, items[3][1].upper() + "!"), (21, ""), (22, None), (23, "too short"), (24, items[5][1] + " more words here")]
    docs = []
    for i in range(40):
        parts = [word() for _ in range(r.randrange(0, 50))]
        if i % 2:
            w = items[r.randrange(12)][1].split()
            for _ in range(r.randrange(0, 4)):
                w[r.randrange(len(w))] = word()
            at = r.randrange(len(parts) + 1)
            parts[at:at] = w
        docs.append((i, (", " if i % 3 else " ").join(parts)))
    return docs + [(100, None), (101, ""), (102, items[0][1] * 1), (None, items[6][1])], items


def test_against_brute_force(spark):
    docs, items = data()
    df = spark.createDataFrame([(*x, "a", "b", "c") for x in docs], SCHEMA).repartition(3)
    bench = spark.createDataFrame([(*x, "z") for x in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    for limit in (0, 10**6):
        got = d.contaminated(df, bench, broadcast_seeds=limit).select("doc_id", "item_id", "n_windows", "first_token", "overlap").collect()
        key = lambda r: tuple((v is None, v or 0) for v in r)
        assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    bad = {doc for doc, *_ in want}
    assert None in bad and 102 in bad and not bad & set(range(0, 40, 2))
    clean = d.clean(df, bench)
    assert clean.columns == df.columns and sorted(map(str, (r["doc_id"] for r in clean.collect()))) == sorted(str(i) for i, _ in docs if i not in bad)


def test_substitutions_are_tolerated(spark):
    words = [f"tok{i}" for i in range(40)]
    noisy = [w if i % 8 != 4 else "changed" for i, w in enumerate(words)]
    docs = spark.createDataFrame([(1, "before " + " ".join(noisy) + " after"), (2, " ".join(reversed(words)))], "doc_id long, text string")
    bench = spark.createDataFrame([(7, " ".join(words))], "item_id long, text string")
    assert {(r["doc_id"], r["item_id"]) for r in d.contaminated(docs, bench).collect()} == {(1, 7)}


def test_empty(spark):
    docs, bench = spark.createDataFrame([], SCHEMA), spark.createDataFrame([(1, "a " * 30)], "item_id long, text string")
    assert d.contaminated(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a " * 30)], "doc_id long, text string")
    assert d.clean(some, bench.limit(0)).count() == 1
