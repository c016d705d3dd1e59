"""Information-theoretic sanitisation of personal data (after Sanchez and Batet, 2016), with DataFrame operations only.

Entities are what the base patterns find, as they are and by what several share: the domain of an email address, the
first half of a network address, the issuer of a card, the first digits of a phone number.  Over the whole corpus, a term
that stands near an entity reveals it as strongly as their pointwise mutual information says, measured against the
information content of the entity itself:

    disclosure(t, e) = log2(p(e | t) N / df(e)) / log2(N / df(e)),   p(e | t) = df(t, e) / df(t) * c / (c + ``DOUBT``),

where c counts the different surroundings they were seen in: copies of one passage are one, and one is a third of a proof, so
the measure holds for entities of a single document too.  Terms at or over ``GENERALISE`` are marked in the documents of
that entity, and generalised to a placeholder, or removed at ``REMOVE`` and more.

Places come from pieces between the matches: their lengths add up in a window over one document's matches.  The patterns
are written with possessive quantifiers, so a long run of any character is scanned once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from adlumen.llm.common import fresh, stored

# The base patterns by kind, in the order of the spans.
KINDS = ("email", "ip", "card", "phone", "term")
_PATTERNS = {
    "email": r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
_MAY_HOLD = {"email": r"@", "ip": r"[0-9]\.[0-9]", "card": r"[0-9]", "phone": r"\+[0-9]"}
_PART = r"0*(?:[0-9]{1,2}|1[0-9]{2}|2[0-4][0-9]|25[0-5])"
NEAR_WORDS, NEAR_CHARACTERS = 5, 160
LEAST_LETTERS = 3
GENERALISE, REMOVE, DOUBT = 0.8, 0.999, 2.0
WORD = rf"\p{{L}}{{{LEAST_LETTERS},}}"
SPAN_LIST_BYTES = 32 << 20


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn(digits: Column) -> Column:
    """Whether a string of digits passes the Luhn check; digits count from the right, every second doubled."""
    n = F.length(digits)

    def weight(total: Column, i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        twice = F.when(d > 4, 2 * d - 9).otherwise(2 * d)
        return total + F.when(i % 2 == 1, twice).otherwise(d)

    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), weight) % 10 == 0


def _valid(kind: Column, value: Column) -> Column:
    digits = _digits(value)
    card = (F.length(digits) >= 16) & (F.length(digits) <= 19)
    return (
        F.when(kind == "email", F.lit(True))
        .when(kind == "ip", value.rlike(rf"^{_PART}(?:\.{_PART}){{3}}$"))
        .when(kind == "card", F.when(card, _luhn(digits)).otherwise(False))
        .otherwise((F.length(digits) >= 8) & (F.length(digits) <= 15))
    )


def _placed(found: DataFrame) -> DataFrame:
    """Start and end (code points) of matches given as ``uid, group, at, before (characters), value``."""
    order = Window.partitionBy("uid", "group").orderBy("at")
    end = F.sum(F.col("before") + F.length("value")).over(order)
    return found.withColumn("end", end).withColumn("start", F.col("end") - F.length("value"))


def documents(docs: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """``doc_id, uid, text`` with null texts empty; ``uid`` names a row's id and text."""
    doc, text = F.col(id_column).cast("long"), F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    return docs.select(doc.alias("doc_id"), F.xxhash64(doc, text).alias("uid"), text.alias("text"))


def base_spans(rows: DataFrame) -> DataFrame:
    """``uid, kind, start, end, value, left, right`` of each distinct row's matches that hold; left and right: what is near."""
    each = []
    for kind, pattern in _PATTERNS.items():
        may = F.col("text").rlike(_MAY_HOLD[kind])
        each.append(
            F.struct(
                F.lit(kind).alias("group"), F.when(may, F.regexp_extract_all("text", F.lit(pattern), 0)).alias("values"),
                F.when(may, F.split("text", pattern, -1)).alias("pieces"),
            )
        )
    kinds = rows.select("uid", F.explode(F.array(*each)).alias("k")).select("uid", "k.*").filter(F.size("values") > 0)
    zipped = F.arrays_zip(
        "values", F.transform("pieces", lambda p: F.length(p)).alias("before"), F.transform("pieces", lambda p: F.right(p, F.lit(NEAR_CHARACTERS))).alias("left"),
        F.transform(F.slice("pieces", 2, F.size("values")), lambda p: F.left(p, F.lit(NEAR_CHARACTERS))).alias("right"),
    )
    found = kinds.select("uid", "group", F.posexplode(zipped).alias("at", "m")).select(
        "uid", "group", "at", F.col("m").getField("values").alias("value"), *[F.col("m").getField(c).alias(c) for c in ("before", "left", "right")]
    ).filter("value is not null")
    # Rows alike in id and text give the same matches.
    found = found.dropDuplicates(["uid", "group", "at"])
    return _placed(found).filter(_valid(F.col("group"), F.col("value"))).select(
        "uid", F.col("group").alias("kind"), "start", "end", "value", "left", "right"
    )


def _words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(WORD), 0)


def _entities(kind: Column, value: Column) -> Column:
    """An entity's name, and that of the group it belongs to."""
    digits = _digits(value)
    own = F.when(kind.isin("card", "phone"), digits).otherwise(F.lower(value))
    shared = (
        F.when(kind == "email", F.substring_index(F.lower(value), "@", -1)).when(kind == "ip", F.substring_index(value, ".", 2))
        .when(kind == "card", F.substring(digits, 1, 6)).otherwise(F.substring(digits, 1, 4))
    )
    return F.array(F.concat_ws(":", kind, own), F.concat_ws(":", kind, F.lit("of"), shared))


def disclosing_terms(rows: DataFrame, spans: DataFrame, generalise: float = GENERALISE, doubt: float = DOUBT) -> DataFrame:
    """``uid, term, disclosure``: the terms to be marked in each document."""
    copies = rows.groupBy("uid").agg(F.count("*").alias("n"))
    near = F.array_union(F.slice(F.reverse(_words(F.col("left"))), 1, NEAR_WORDS), F.slice(_words(F.col("right")), 1, NEAR_WORDS))
    held = spans.withColumns({"near": near, "context": F.xxhash64("left", "right")}).join(copies, "uid")
    held = held.select("uid", "n", "context", "near", F.explode(_entities(F.col("kind"), F.col("value"))).alias("entity"))
    of_entity = held.select("uid", "n", "entity").distinct().groupBy("entity").agg(F.sum("n").alias("df_e"))
    pair = held.select("uid", "n", "entity", "context", F.explode("near").alias("term")).groupBy("entity", "term", "uid").agg(F.first("n").alias("n"), F.min("context").alias("context"))
    both = stored(pair.groupBy("entity", "term").agg(F.sum("n").alias("df_te"), F.count_distinct("context").alias("c")))
    total = rows.count()
    terms = both.select("term").distinct()
    # Every term is counted, folded in each task, before the wanted ones are picked.
    of_term = rows.select(F.explode(F.array_distinct(_words(F.col("text")))).alias("term")).groupBy("term").agg(F.count("*").alias("df_t")).join(terms, "term")
    scored = both.join(of_entity, "entity").join(of_term, "term").withColumn("total", F.lit(total))
    likely = F.col("df_te") / F.col("df_t") * (F.col("c") / (F.col("c") + F.lit(doubt)))
    value = F.log2(likely * F.col("total") / F.col("df_e")) / F.log2(F.col("total") / F.col("df_e"))
    strong = scored.filter(F.col("df_e") < F.col("total")).withColumn("disclosure", value).filter(F.col("disclosure") >= generalise)
    documents_of = held.select("uid", "entity").distinct()
    return documents_of.join(strong.select("entity", "term", "disclosure"), "entity").groupBy("uid", "term").agg(F.max("disclosure").alias("disclosure"))


def term_spans(rows: DataFrame, terms: DataFrame, spans: DataFrame) -> DataFrame:
    """``uid, kind, start, end, disclosure`` of every occurrence of a document's terms outside the base spans."""
    pattern = F.concat(F.lit(r"(?iu)(?<!\p{L})\Q"), F.col("term"), F.lit(r"\E(?!\p{L})"))
    texts = rows.join(terms, "uid").dropDuplicates(["uid", "term"])
    zipped = F.arrays_zip(
        F.regexp_extract_all("text", pattern, F.lit(0)).alias("value"), F.transform(F.split("text", pattern, -1), lambda p: F.length(p)).alias("before")
    )
    found = texts.select("uid", "disclosure", F.col("term").alias("group"), F.posexplode(zipped).alias("at", "m")).select(
        "uid", "disclosure", "group", "at", *[F.col("m").getField(c).alias(c) for c in ("value", "before")]
    ).filter("value is not null")
    placed = _placed(found).select("uid", F.lit("term").alias("kind"), "start", "end", "disclosure")
    base = spans.select(F.col("uid").alias("u"), F.col("start").alias("s"), F.col("end").alias("e"))
    return placed.join(base, (placed["uid"] == base["u"]) & (placed["start"] < base["e"]) & (base["s"] < placed["end"]), "left_anti")


def spans_by_row(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``uid, spans``: all spans of each row that has some, by kind as listed in ``KINDS``, then start.

    A span has ``k`` (place in ``KINDS``), ``start``, ``end`` and ``disclosure`` (null for base spans).
    """
    rows = documents(docs, id_column, text_column)
    base = stored(base_spans(rows))
    terms = stored(disclosing_terms(rows, base))
    more = term_spans(rows, terms, base)
    every = base.select("uid", "kind", "start", "end", F.lit(None).cast("double").alias("disclosure")).unionByName(more)
    place = F.array_position(F.array(*map(F.lit, KINDS)), F.col("kind")).cast("int") - 1
    return stored(
        every.select("uid", F.struct(place.alias("k"), F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"), "disclosure").alias("s"))
        .groupBy("uid").agg(F.array_sort(F.collect_list("s")).alias("spans"))
    )


def _of_kind(k: int) -> Callable[[Column], Column]:
    return lambda s: s["k"] == k


def _joined(spans: Column) -> Column:
    return F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", F.element_at(F.array(*map(F.lit, KINDS)), s["k"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ","
    )


def marked(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Each row's ``doc_id, n_email, n_ip, n_card, n_phone, n_term, base, spans``.

    ``base`` lists the base spans and ``spans`` all as ``kind:start:end``, by kind and start, places in code points.  A null
    text is empty and has no spans; rows alike in id and text have the same; extra columns are ignored; an empty table gives
    an empty result.
    """
    rows = documents(docs, id_column, text_column).select("doc_id", "uid")
    spans = F.coalesce("spans", F.expr("array()").cast("array<struct<k:int,start:long,end:long,disclosure:double>>"))
    out = rows.join(spans_by_row(docs, id_column, text_column), "uid", "left").withColumn("spans", spans)
    counts = [F.size(F.filter("spans", _of_kind(k))).cast("long").alias(f"n_{kind}") for k, kind in enumerate(KINDS)]
    return out.select("doc_id", *counts, _joined(F.filter("spans", lambda s: s["k"] < 4)).alias("base"), _joined(F.col("spans")).alias("spans"))


def sanitised(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", remove: float = REMOVE) -> DataFrame:
    """The rows of ``docs``, all columns, with placeholders for what was found in ``text_column``.

    Spans that overlap become one placeholder, of the kind that starts first.  Terms at ``remove`` or more vanish.  Texts
    without spans stay as they are, nulls too.  Other columns may have any names; an empty table gives an empty result.
    """
    spans = spans_by_row(docs, id_column, text_column)
    by_start = F.array_sort(F.transform("spans", lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"), s["disclosure"].alias("disclosure"))))

    def fold(done: Column, s: Column) -> Column:
        last = F.element_at(done, -1)
        wider = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["k"].alias("k"), last["disclosure"].alias("disclosure"))
        return F.when((F.size(done) > 0) & (s["start"] < last["end"]), F.concat(F.slice(done, 1, F.size(done) - 1), F.array(wider))).otherwise(F.concat(done, F.array(s)))

    kind = "array<struct<start:long,end:long,k:int,disclosure:double>>"
    merged = stored(spans.select("uid", F.aggregate(by_start, F.expr("array()").cast(kind), fold).alias("cuts")))
    size = merged.agg(F.sum(F.size("cuts") * 40 + 32).alias("n")).first()["n"] or 0
    if size <= SPAN_LIST_BYTES:
        merged = F.broadcast(merged)
    uid_name, cuts = fresh("uid", docs.columns), fresh("cuts", docs.columns)
    merged = merged.select(F.col("uid").alias(uid_name), F.col("cuts").alias(cuts))
    text = docs[text_column].cast("string")
    uid = F.xxhash64(docs[id_column].cast("long"), F.coalesce(text, F.lit("")))
    joined = docs.join(merged, uid == merged[uid_name], "left")

    def piece(s: Column, i: Column) -> Column:
        before = F.when(i == 0, F.lit(0)).otherwise(F.element_at(F.col(cuts), F.greatest(i, F.lit(1)))["end"])
        place = F.element_at(F.array(*[F.lit(f"[{k.upper()}]") for k in KINDS]), s["k"] + 1)
        return F.concat(F.substring(text, (before + 1).cast("int"), (s["start"] - before).cast("int")), F.when(F.coalesce(s["disclosure"] >= remove, F.lit(False)), "").otherwise(place))

    end = F.element_at(F.col(cuts), -1)["end"]
    changed = F.concat(F.array_join(F.transform(cuts, piece), ""), F.substring(text, (end + 1).cast("int"), F.length(text)))
    columns = [F.when(F.col(cuts).isNotNull(), changed).otherwise(text).alias(c) if c == text_column else docs[c] for c in docs.columns]
    return joined.select(*columns)
