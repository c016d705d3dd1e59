"""The suffix tree: exact base, scores of a plain tree, held-out gain."""

import math
import random
import zlib
from collections import Counter

import pytest

from adlumen.llm import suffixtree
from plain import words

SCHEMA = "doc_id long, text string, uid string, score string"


def rows():
    r = random.Random(2)
    vocabulary = ["the", "Of", "and", "river", "stone", "märz", "zz9"]
    out = [(i, " ".join(r.choice(vocabulary) for _ in range(r.randrange(0, 60)))) for i in range(150)]
    return out + [(200, None), (201, ""), (202, " \n "), (None, "the river"), (3, "same id"), (3, "same id"), (204, "Unseen 中文 words")]


def test_base_and_counts(spark):
    data = rows()
    got = suffixtree.scored(spark.createDataFrame([(*x, "a", "b") for x in data], SCHEMA)).collect()
    held = [i is not None and zlib.crc32(str(i).encode()) % 7 == 2 for i, _ in data]
    tokens = [words(t) + [None] for _, t in data]
    c = Counter(w for x, h in zip(tokens, held) if not h for w in x)
    n, v = sum(c.values()), len(c)
    want = [(i, h, len(x), sum(c[w] > 0 for w in x), n, sum(math.log10((c[w] + 1) / (n + v + 1)) for w in x)) for (i, _), h, x in zip(data, held, tokens)]
    a, b = (sorted(x, key=lambda r: str(tuple(r)[:4])) for x in (want, [tuple(g)[:6] for g in got]))
    assert [x[:5] for x in a] == [x[:5] for x in b]
    assert [x[5] for x in a] == pytest.approx([x[5] for x in b])
    assert all(g["score"] < 0 for g in got)


def chained(n=120, seed=5):
    """Texts from a chain over word pairs, some repeated, some held out; ids are their places."""
    r = random.Random(seed)
    after = {}
    out = []
    for i in range(n):
        text = ["a", "b"]
        for _ in range(r.randrange(5, 60)):
            choices = after.setdefault(tuple(text[-2:]), [r.choice("abcdefghij") + r.choice(["", "x", "y"]) for _ in range(3)])
            text.append(r.choice(choices))
        out.append((i, " ".join(text)))
    return out + [(n + i, out[i][1]) for i in range(5)] + [(n + 10, "a never seen"), (n + 11, "")]


class Plain:
    """The tree from its definition, with dictionaries; contexts are tuples of words, the latest last.

    ``every`` are the texts held out as well, by which contexts are hot.
    """

    def __init__(self, texts, every=(), hot=2.0, share=0.0):
        self.one, self.after, self.kept, self.all = Counter(), {}, {}, Counter()
        for part, learn in ((texts, True), (every, False)):
            for text in part:
                s = [None, None, *text, None]
                for i in range(2, len(s)):
                    self.one[s[i]] += learn
                    for context in ((s[i - 1],), (s[i - 2], s[i - 1])):
                        self.after.setdefault(context, Counter())[s[i]] += learn
                        if not learn:
                            self.all[context] += 1
                            self.all[context, s[i]] += 1
        self.one, self.after = +self.one, {k: +c for k, c in self.after.items()}
        self.n, self.v = sum(self.one.values()), len(self.one)
        total = sum(len(t) + 1 for t in every)
        self.limit = max(share * total, 1)
        self.hot = {c: {} for c in self.after if self.all[c] >= max(hot * total, 8)}
        for c, listed in self.hot.items():
            listed.update({w: k for w, k in self.after[c].items() if k >= self.limit and self.all[c, w] >= max(share * total, 8)})

    def resolved(self, context, w):
        """Whether a single word's hot context has a share of its own for the word."""
        return context not in self.hot or w in self.hot[context]

    def retained(self, context):
        if context not in self.kept:
            c = self.after.get(context, {})
            x = sum(c.values())
            keep = x >= suffixtree.LEAST
            if keep and len(context) == 2:
                below = lambda w: self.p(context[1:], w) if self.resolved(context[1:], w) else min(self.limit / (sum(self.after[context[1:]].values()) + 1), 1)
                gain = sum(k * math.log(k / x / below(w)) for w, k in c.items())
                keep = gain > 0.5 * len(c) * math.log(max(self.n, 2))
            self.kept[context] = keep
        return self.kept[context]

    def p(self, context, w):
        if not context:
            return (self.one[w] + 1) / (self.n + self.v + 1)
        c = self.after.get(context, {})
        x, kinds = sum(c.values()), len(c)
        if context in self.hot:
            listed = self.hot[context]
            return listed[w] / (x + 1) if w in listed else (x - sum(listed.values()) + 1) / (x + 1) * self.p(context[1:], w)
        if not self.retained(context):
            return self.p(context[1:], w)
        if w in c:
            return c[w] / (x + kinds)
        taken = sum(self.p(context[1:], v) for v in c if self.resolved(context[1:], v)) if len(context) == 2 else 0.0
        return kinds / (x + kinds) * self.p(context[1:], w) / (1 - min(taken, 1 - 1e-9))

    def score(self, text):
        s = [None, None, *text, None]
        return sum(math.log10(self.p((s[i - 2], s[i - 1]), s[i])) for i in range(2, len(s)))


def held_out(i):
    return zlib.crc32(str(i).encode()) % 7 == 2


def test_equals_plain_tree(spark):
    data = chained()
    plain = Plain([words(t) for i, t in data if not held_out(i)])
    got = {r["doc_id"]: r for r in suffixtree.scored(spark.createDataFrame(data, "doc_id long, text string")).collect()}
    assert set(got) == {i for i, _ in data}
    assert any(plain.retained(c) for c in list(plain.after) if len(c) == 2)
    assert any(not plain.retained(c) for c in list(plain.after) if len(c) == 2 and sum(plain.after[c].values()) >= suffixtree.LEAST)
    for i, t in data:
        assert got[i]["score"] == pytest.approx(plain.score(words(t)), rel=1e-6), t


def test_probabilities_add_up_to_at_most_one():
    plain = Plain([words(t) for i, t in chained()])
    every = [*plain.one, "unseen"]
    sums = [sum(plain.p(c, w) for w in every) for c in [(), *plain.after]]
    assert sums[0] == pytest.approx(1) and max(sums) <= 1 + 1e-9


def test_beats_base_on_held_out_rows(spark):
    got = suffixtree.scored(spark.createDataFrame(chained(400), "doc_id long, text string")).filter("held_out").collect()
    assert sum(r["score"] for r in got) > 0.8 * sum(r["base_score"] for r in got)


@pytest.mark.parametrize("hot", [0.02, 0.2])
def test_hot_contexts(spark, hot):
    """Hot words and pairs, known everywhere: the base stays exact, and scores equal those of the definition."""
    data = chained(200) + [(1000 + i, " ".join(["buy now"] * 40)) for i in range(60)]
    # One portion, so that candidates are those of the whole.
    frame = spark.createDataFrame(data, "doc_id long, text string").coalesce(1)
    plain = Plain([words(t) for i, t in data if not held_out(i)], [words(t) for _, t in data], hot, 0.001)
    assert {len(c) for c in plain.hot} == {1, 2}
    known = suffixtree.hot_contexts(suffixtree.learning_rows(frame, "doc_id", "text", 7, 2), hot, 1, 0.001)
    counts = Counter(w for i, t in data if not held_out(i) for w in [*words(t), None])
    assert known["positions"] == sum(counts.values()) and len(known["pair"]["name"])
    assert set(known["word"]["n"].tolist()) <= set(counts.values()) and max(known["word"]["n"]) == max(counts.values())
    for kind in ("word", "pair"):
        assert (known[kind]["left"] >= 0).all() and len(known[kind]["name"]) <= 1 / hot
        assert known[kind]["left"].sum() + known[kind]["times"].sum() == known[kind]["n"].sum()
    usual = {r["doc_id"]: r for r in suffixtree.scored(frame).collect()}
    got = {r["doc_id"]: r for r in suffixtree.scored(frame, hot=hot, hot_least=1, share=0.001).collect()}
    for i, r in usual.items():
        assert got[i][:5] == r[:5] and got[i]["base_score"] == pytest.approx(r["base_score"])
        assert got[i]["score"] == pytest.approx(plain.score(words(dict(data)[i])), rel=1e-6)
    contexts = [c for c in plain.after if len(c) == 1 or c in plain.hot]
    assert max(sum(plain.p(c, w) for w in [*plain.one, "unseen"]) for c in contexts) <= 1 + 1e-9


@pytest.mark.parametrize("hot", [0.005, 0.02, 0.12])
def test_hot_contexts_do_not_matter(spark, monkeypatch, hot):
    """Scores are the plain tree's whatever is hot: the size of the table switches nothing."""
    data = chained(200) + [(1000 + i, " ".join(["buy now"] * 40)) for i in range(60)] + [(2000 + i, f"buy now k{i % 40} a b j{i}") for i in range(120)]
    frame = spark.createDataFrame(data, "doc_id long, text string").repartition(3)
    monkeypatch.setattr(suffixtree, "SHARE", 0.003)
    monkeypatch.setattr(suffixtree, "FLUSH", 3000)
    known = suffixtree.hot_contexts(suffixtree.learning_rows(frame, "doc_id", "text", 7, 2), hot, 1)
    assert len(known["word"]["name"]) and (len(known["pair"]["name"]) and len(known["word"]["after"]) or hot > 0.1)
    plain = Plain([words(t) for i, t in data if not held_out(i)])
    texts = dict(data)
    for r in suffixtree.scored(frame, hot=hot, hot_least=1).collect():
        assert r["score"] == pytest.approx(plain.score(words(texts[r["doc_id"]])), rel=1e-6)


def test_buckets_do_not_matter(spark, monkeypatch):
    data = spark.createDataFrame(chained(60), "doc_id long, text string")
    first = {r["doc_id"]: r["score"] for r in suffixtree.scored(data).collect()}
    monkeypatch.setattr(suffixtree, "bucket_count", lambda *a: 23)
    monkeypatch.setattr(suffixtree, "FLUSH", 200)
    again = {r["doc_id"]: r["score"] for r in suffixtree.scored(data.repartition(5)).collect()}
    assert again == pytest.approx(first)


def test_long_text_and_clashing_names(spark):
    data = [(1, "one two three " * 50_000, 1, 2), (2, "x" * 300_000, 3, 4), (3, "one two four", 5, 6)]
    got = {r["doc_id"]: r for r in suffixtree.scored(spark.createDataFrame(data, "doc_id long, text string, score int, held_out int")).collect()}
    assert [got[i]["n_tokens"] for i in (1, 2, 3)] == [150_001, 2, 4]
    plain = Plain([words(t) for i, t, *_ in data if not held_out(i)])
    assert got[3]["score"] == pytest.approx(plain.score(["one", "two", "four"]), rel=1e-6)


def test_nothing_to_learn_from(spark):
    out = next(i for i in range(100) if held_out(i))
    row = suffixtree.scored(spark.createDataFrame([(out, "some words")], "doc_id long, text string")).first()
    assert tuple(row) == (out, True, 3, 0, 0, 0.0, 0.0)


def test_empty(spark):
    assert suffixtree.scored(spark.createDataFrame([], SCHEMA)).count() == 0
