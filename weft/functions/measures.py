"""Similarity, distance and score functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def dot(a: Column, b: Column) -> Column:
    """Dot product in double precision."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    """Euclidean length."""
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column, eps: float = 1e-9) -> Column:
    """Cosine with a small constant under the line."""
    return dot(a, b) / (norm(a) * norm(b) + eps)


def unit(a: Column, eps: float = 1e-9) -> Column:
    """Vector divided by its length (eps at least)."""
    n = F.greatest(norm(a), F.lit(eps))
    return F.transform(a, lambda x: x.cast("double") / n)


def word_set(c: Column) -> Column:
    """Distinct lower-case words, letters of all scripts."""
    return F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0)))


def token_f1(a: Column, b: Column) -> Column:
    """F1 of two word sets, rounded to 4; 0 where one is empty."""
    both, na, nb = F.size(F.array_intersect(a, b)), F.size(a), F.size(b)
    p, r = both / F.greatest(na, F.lit(1)), both / F.greatest(nb, F.lit(1))
    return F.when((na == 0) | (nb == 0), 0.0).otherwise(F.round(2 * p * r / (p + r + 1e-9), 4))


def jaccard(a: Column, b: Column, empty: float = 0.0) -> Column:
    """Shared part of two sets; ``empty`` where both are."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, empty).otherwise(F.size(F.array_intersect(a, b)) / F.when(union != 0, union))


def lexical_distance(a: Column, b: Column, empty: float) -> Column:
    """1 - Jaccard; ``empty`` where both sets are."""
    return 1 - jaccard(a, b, 1 - empty)


def semantic_distance(similarity: Column, lexical: Column) -> Column:
    """1 - cosine where known, else the lexical distance, within 0 and 2."""
    return F.greatest(F.lit(0.0), F.least(F.lit(2.0), F.coalesce(1 - similarity, lexical)))


def recovery(clean: Column, corrupt: Column, patched: Column, low: float = 0.0, high: float = 1.0) -> Column:
    """Part of the lost score that a patch restores, within bounds; 0 where nothing was lost."""
    lost = clean - corrupt
    return F.when(F.abs(lost) < 1e-9, 0.0).otherwise(F.greatest(F.lit(low), F.least(F.lit(high), (patched - corrupt) / F.when(F.abs(lost) >= 1e-9, lost))))


def set_prf(found: Column, ref: Column) -> tuple[Column, Column]:
    """Precision and recall of a set; an empty reference gives 1 and 1."""
    hit, n, m = F.size(F.array_intersect(found, ref)), F.size(found), F.size(ref)
    return F.when(m == 0, 1.0).when(n == 0, 0.0).otherwise(hit / F.when(n != 0, n)), F.when(m == 0, 1.0).otherwise(hit / F.when(m != 0, m))


def clamped_score(c: Column, low: float = 0.0, high: float = 5.0) -> Column:
    """A number read from text, within bounds; null if it is none."""
    return F.greatest(F.lit(low), F.least(F.lit(high), c.try_cast("double")))


def stable_hash(*parts: Column) -> Column:
    """First 16 hex digits of the sha1 of the parts."""
    return F.substring(F.sha1(F.concat_ws("|", *parts)), 1, 16)


#: Words that tell of causes and mechanisms.
MECHANISM_TERMS = [
    "causes", "cause", "mechanism", "mechanisms", "due", "results", "leads", "because",
    "therefore", "consequently", "induces", "drives", "enables", "inhibits", "increases",
    "decreases", "affects", "mediates", "modulates", "triggers", "pathway", "via",
    "through", "activates", "suppresses", "regulates", "controls", "determines",
]


def set_f1(a: Column, b: Column) -> Column:
    """F1 of two arrays of distinct values, to four places; 0 where either is empty."""
    shared = F.size(F.array_intersect(a, b))
    p, r = shared / F.size(a), shared / F.size(b)
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(F.round(2 * p * r / (p + r + 1e-9), 4))


def mechanism_words(c: Column) -> Column:
    """Distinct words of a text that tell of a mechanism."""
    return F.array_intersect(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b\w+\b"), F.lit(0)), F.array(*map(F.lit, MECHANISM_TERMS)))


def mechanism_f1(a: Column, b: Column) -> Column:
    """F1 of two texts over the words that tell of a mechanism."""
    return set_f1(mechanism_words(a), mechanism_words(b))


def graph_support(answer: Column, graph_text: Column) -> Column:
    """Part of a graph's words of two letters and more that an answer has, to four places; 0 for a graph without words."""
    tokens = lambda c: F.array_distinct(F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\b[A-Za-z]\w+\b"), F.lit(0)))
    asked = tokens(graph_text)
    return F.when(F.size(asked) > 0, F.round(F.size(F.array_intersect(asked, tokens(answer))) / F.size(asked), 4)).otherwise(0.0)


def entity_overlap(clean: Column, corrupt: Column) -> Column:
    """Part of the ends of clean edges ``a|r|b`` that the corrupt ones have too, whatever their direction, to four places."""
    ends = lambda c: F.array_distinct(F.flatten(F.transform(c, lambda e: F.array(F.substring_index(e, "|", 1), F.substring_index(e, "|", -1)))))
    return F.round(F.size(F.array_intersect(ends(clean), ends(corrupt))) / (F.size(ends(clean)) + 1e-9), 4)
