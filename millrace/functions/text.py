"""Scalar functions on text, JSON and vectors, as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

TRIPLES = "array<struct<subject_kind:string,subject:string,predicate:string,object_kind:string,object:string,confidence:double,evidence:string>>"


def cosine(a: Column, b: Column) -> Column:
    """0 where lengths differ or a norm is zero; null where a vector is null."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    norm = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(a.isNull() | b.isNull(), None).when((F.size(a) != F.size(b)) | (norm == 0), 0.0).otherwise(dot(a, b) / norm)


def cosine_to(a: Column, query: list[float]) -> Column:
    """cosine() with a vector that is known: its norm is computed once, so each row takes two passes, not five."""
    q = [float(x) for x in query]
    norm = sum(x * x for x in q) ** 0.5
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda u, v: u.cast("double") * v.cast("double")), F.lit(0.0), lambda s, v: s + v)
    own = F.sqrt(dot(a, a))
    return F.when(a.isNull(), None).when((F.size(a) != len(q)) | (own == 0) | F.lit(norm == 0), 0.0).otherwise(dot(a, F.array(*[F.lit(x) for x in q])) / (own * norm))


def value_shape(text: Column, cap: int = 64) -> Column:
    """Letters become a, digits d, the rest stays; longer shapes end with a tilde."""
    shape = F.regexp_replace(F.regexp_replace(text, "[A-Za-z]", "a"), "[0-9]", "d")
    return F.when(F.length(shape) > cap, F.concat(F.substring(shape, 1, cap), F.lit("~"))).otherwise(shape)


def normalise_label(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def normalise_predicate(text: Column) -> Column:
    return F.regexp_replace(normalise_label(text), " ", "_")


def label_similarity(a: Column, b: Column) -> Column:
    """1 if equal once normalised, 0.86 if one holds the other, else the share of common words."""
    x, y = normalise_label(a), normalise_label(b)
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    shared = F.size(F.array_intersect(u, v)) / F.size(F.array_union(u, v))
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).when(x.contains(y) | y.contains(x), 0.86).otherwise(shared)


def merge_similarity(a: Column, b: Column) -> Column:
    """1 if equal once normalised, else the greater of 0.86 if one holds the other and a share of matched words.

    A word of a matches if b has it, or one of four letters or more that it begins with or that begins with
    it; the share is of the longer list of distinct words. At most 0.99 unless equal.
    """
    x, y = normalise_label(a), normalise_label(b)
    u, v = F.array_distinct(F.split(x, " ")), F.array_distinct(F.split(y, " "))
    begins = lambda p, q: (F.length(p) >= 4) & (F.length(q) >= 4) & (p.startswith(q) | q.startswith(p))
    matches = F.size(F.filter(u, lambda p: F.exists(v, lambda q: (p == q) | begins(p, q))))
    share = matches / F.greatest(F.size(u), F.size(v))
    held = F.when(x.contains(y) | y.contains(x), 0.86).otherwise(0.0)
    return F.when((x == "") | (y == ""), 0.0).when(x == y, 1.0).otherwise(F.least(F.greatest(share, held), F.lit(0.99)))


def text_evidence(text: Column, query: str, top: int = 3) -> Column:
    """The sentences that hold most of the query's words (10 for each distinct one, 1 for each hit), in text order."""
    words = sorted({w for w in query.lower().split() if len(w) >= 2})
    sentences = F.filter(F.transform(F.split(text, r"(?<=[.!?])\s+|\n+"), lambda s: F.trim(s)), lambda s: s != "")
    found = lambda s, w: F.array_size(F.filter(F.split(F.lower(s), r"[^\p{L}\p{N}]+"), lambda t: t == w))

    def score(s: Column) -> Column:
        hits = [found(s, w) for w in words]
        return reduce(lambda p, q: p + q, [F.when(h > 0, h + 10).otherwise(0) for h in hits], F.lit(0))

    scored = F.filter(F.transform(sentences, lambda s, i: F.struct((-score(s)).alias("score"), i.alias("at"), s.alias("s"))), lambda r: r["score"] < 0)
    best = F.slice(F.array_sort(scored), 1, top)
    return F.transform(F.array_sort(F.transform(best, lambda r: F.struct(r["at"], r["s"]))), lambda r: r["s"])


def yes_no(output: Column) -> Column:
    return F.upper(F.ltrim(output)).rlike("^(YES|TRUE|1)")


def score_0_1(output: Column) -> Column:
    """The first number, held between 0 and 1."""
    number = F.regexp_extract(output, r"-?[0-9]+(?:\.[0-9]+)?", 0)
    return F.least(F.greatest(number.try_cast("double"), F.lit(0.0)), F.lit(1.0))


def extract_int(text: Column) -> Column:
    return F.regexp_extract(text, "-?[0-9]+", 0).try_cast("bigint")


def first_non_empty_line(text: Column) -> Column:
    return F.element_at(F.filter(F.transform(F.split(text, "\n"), lambda s: F.trim(s)), lambda s: s != ""), 1)


def validate_one_of(text: Column, options: list[str], default: str | None = None) -> Column:
    known = F.create_map(*[F.lit(x) for o in options for x in (o.lower(), o)])
    return F.coalesce(F.try_element_at(known, F.lower(F.trim(text))), F.lit(default))


def triples_of(output: Column) -> Column:
    """Valid triples of a JSON array; rows without subject, predicate or object go."""
    rows = F.from_json(output, TRIPLES)
    ok = lambda r: (F.coalesce(F.trim(r["subject"]), F.lit("")) != "") & (F.coalesce(F.trim(r["predicate"]), F.lit("")) != "") & (F.coalesce(F.trim(r["object"]), F.lit("")) != "")
    return F.filter(rows, ok)


def chunks(text: Column, limit: int = 1200) -> Column:
    """Paragraphs packed in order into chunks of at most limit characters; a longer one stands alone."""
    paragraphs = F.filter(F.transform(F.split(text, r"\n\s*\n"), lambda s: F.trim(s)), lambda p: p != "")
    last = lambda c: F.element_at(c, -1)

    def add(c: Column, p: Column) -> Column:
        fits = (F.size(c) > 0) & (F.length(F.try_element_at(c, F.lit(-1))) + F.length(p) + 2 <= limit)
        return F.when(fits, F.concat(F.slice(c, 1, F.greatest(F.size(c) - 1, F.lit(0))), F.array(F.concat(last(c), F.lit("\n\n"), p)))).otherwise(F.concat(c, F.array(p)))

    return F.aggregate(paragraphs, F.array().cast("array<string>"), add)


def url_host(url: Column) -> Column:
    return F.regexp_replace(url, r"^https?://(?:www\.)?([^/]+)/.*$", "$1")
