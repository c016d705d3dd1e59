"""Personal data against plain regular expressions, and terms that reveal an entity."""

import math
import random
import re

from adlumen.llm import sanitize

SCHEMA = "doc_id long, text string, uid string, spans string"
PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(digits):
    total = 0
    for i, c in enumerate(reversed(digits)):
        n = int(c) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def holds(kind, value):
    digits = re.sub("[^0-9]", "", value)
    if kind == "ip":
        return all(int(x) <= 255 for x in value.split("."))
    if kind == "card":
        return 16 <= len(digits) <= 19 and luhn(digits)
    return kind == "email" or 8 <= len(digits) <= 15


def brute(text):
    return [(k, m.start(), m.end()) for k, p in PATTERNS.items() for m in re.finditer(p, text or "", re.A) if holds(k, m.group())]


PARTS = ["a", "b.c", "@", ".", " ", "1", "22", "255", "256", "00", "+", "-", "é", "🙂", "4111 1111 1111 1111", "+1 (017) 555-7713", "x@y.zz", "(", ")", "\n", "_", "4929348385146305"]


def test_base_spans(spark):
    r = random.Random(5)
    rows = [(i, "".join(r.choice(PARTS) for _ in range(r.randrange(0, 14)))) for i in range(1500)]
    rows += [(7000, None), (7001, ""), (7002, "a" * 2000 + "@b.cc"), (7003, "1.2" * 900), (7004, "1" * 2000), (7005, "+1" + "(" * 2000), (None, "x@y.zz"), (3, rows[9][1]), (4, rows[4][1])]
    got = sanitize.marked(spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA).repartition(3)).collect()
    want = sorted(((i, ",".join(f"{k}:{a}:{b}" for k, a, b in brute(t)), sum(k == "card" for k, *_ in brute(t))) for i, t in rows), key=str)
    assert sorted(((g["doc_id"], g["base"], g["n_card"]) for g in got), key=str) == want


def test_long_runs_are_scanned_once(spark):
    long = [(1, "a" * 400_000), (2, "1" * 400_000), (3, "1." * 200_000), (4, "+1" + "(" * 400_000), (5, "a@b" + ".c" * 200_000)]
    got = {g["doc_id"]: g["base"] for g in sanitize.marked(spark.createDataFrame(long, "doc_id long, text string")).collect()}
    assert got == {1: "", 2: "", 3: "ip:0:7,ip:8:15", 4: "", 5: "email:0:400003"} or got[5] == "email:0:400003"


def test_terms_that_reveal(spark):
    r = random.Random(1)
    filler = lambda n: " ".join(r.choice(["river", "stone", "cloud", "amber", "north", "paper", "green", "under"]) for _ in range(n))
    rows = [(i, f"{filler(9)} Quixley {filler(2)} quentin@site.org {filler(9)} Quixley again") for i in range(5)]
    rows += [(10 + i, f"{filler(20)} {filler(3)} other{i}@site.org {filler(9)}") for i in range(5)] + [(50 + i, filler(30)) for i in range(60)]
    docs = spark.createDataFrame([(*x, "a", "b") for x in rows], SCHEMA)
    got = {g["doc_id"]: g for g in sanitize.marked(docs).collect()}
    texts = dict(rows)
    for i in range(5):
        spans = [s.split(":") for s in got[i]["spans"].split(",")]
        assert {texts[i][int(a) : int(b)] for k, a, b in spans if k == "term"} == {"Quixley"} and got[i]["n_email"] == 1 and got[i]["n_term"] == 2
    assert all(got[i]["n_term"] == 0 for i in got if i >= 10)
    clean = {g["doc_id"]: g["text"] for g in sanitize.sanitised(docs).collect()}
    assert "quentin" not in clean[0] and "Quixley" not in clean[0] and "[EMAIL]" in clean[0] and clean[50] == texts[50]
    kept = {g["doc_id"]: g["text"] for g in sanitize.sanitised(docs, remove=1.1).collect()}
    assert kept[0].count("[TERM]") == 2


def test_disclosure_against_plain_counts(spark):
    """Every term of every document, by the same estimate over plain counts."""
    r = random.Random(4)
    vocabulary = [a + b for a in ("alp", "bet", "gam", "del", "eps") for b in ("ha", "on", "ix", "um", "or", "ett", "ing", "az")]
    owners = [f"u{i}@d{i % 3}.org" for i in range(6)] + ["10.1.2.3", "10.1.9.9", "+1 (017) 555-7713"]
    texts = []
    for i in range(300):
        words = [r.choice(vocabulary[: r.choice([4, 20, 40])]) for _ in range(r.randrange(1, 25))]
        if i % 3 == 0:
            at = r.randrange(len(words) + 1)
            words[at:at] = [f"name{'abcdefghi'[i % 9]}", owners[i % 9], r.choice(["", "ligature"])]
        texts.append(" ".join(words))
    texts += [texts[0]] * 4 + [f"lone thing solo{'x' * 3} zed@only.net beside", None, ""]
    words_of = lambda t: [w for w in re.findall("[a-z]{3,}", t.lower())]
    n = len(texts)
    df_t, df_e, df_te, contexts, near_of = {}, {}, {}, {}, {}
    for i, t in enumerate(texts):
        for w in set(words_of(t or "")):
            df_t[w] = df_t.get(w, 0) + 1
        for kind, a, b in brute(t):
            value, left, right = t[a:b], t[:a][-160:], t[b:][:160]
            digits = re.sub("[^0-9]", "", value)
            names = {"email": (value, value.split("@")[-1]), "ip": (value, ".".join(value.split(".")[:2])), "phone": (digits, digits[:4])}[kind]
            for e in ((kind, names[0]), (kind, "of", names[1])):
                df_e.setdefault(e, set()).add(i)
                near_of.setdefault(i, set()).add(e)
                for w in set(words_of(left)[::-1][:5]) | set(words_of(right)[:5]):
                    df_te.setdefault((e, w), set()).add(i)
                    contexts.setdefault((e, w), set()).add((left, right))
    want = {}
    for (e, w), docs in df_te.items():
        c = len(contexts[e, w])
        likely = len(docs) / df_t[w] * c / (c + sanitize.DOUBT)
        d = math.log2(likely * n / len(df_e[e])) / math.log2(n / len(df_e[e]))
        if d >= 0.8:
            for i in df_e[e]:
                want[i, w] = max(want.get((i, w), 0), d)
    rows = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    docs = sanitize.documents(rows, "doc_id", "text")
    found = sanitize.disclosing_terms(docs, sanitize.base_spans(docs)).join(docs.select("uid", "doc_id"), "uid").collect()
    got = {(f["doc_id"], f["term"]): f["disclosure"] for f in found}
    assert {k: round(v, 9) for k, v in got.items()} == {k: round(v, 9) for k, v in want.items()}
    assert any(i == 304 for i, _ in got) and len(got) > 20


def test_other_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, "to x@y.zz now", 1, 2, 3, 4)], "doc_id long, text string, _cuts int, _uid int, cuts int, Uid int")
    out = sanitize.sanitised(df)
    assert out.columns == df.columns and tuple(out.first()) == (1, "to [EMAIL] now", 1, 2, 3, 4)


def test_sanitised_keeps_rows(spark):
    rows = [(1, None), (2, ""), (3, "é x@y.zz +1 (017) 555-7713 and 4111 1111 1111 1111 end"), (3, "é x@y.zz +1 (017) 555-7713 and 4111 1111 1111 1111 end"), (None, "1.2.3.4")]
    df = spark.createDataFrame([(*x, "u", "s") for x in rows], SCHEMA)
    out = sanitize.sanitised(df)
    assert out.columns == df.columns
    line = "é [EMAIL] [PHONE] and [CARD] end"
    assert sorted(((r["doc_id"], r["text"], r["uid"]) for r in out.collect()), key=str) == sorted(
        [(1, None, "u"), (2, "", "u"), (3, line, "u"), (3, line, "u"), (None, "[IP]", "u")], key=str
    )
    assert sanitize.sanitised(df.limit(0)).count() == 0 and sanitize.marked(df.limit(0)).count() == 0
