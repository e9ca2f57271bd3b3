"""n-gram sets and multisets, overlap scores and the longest common subsequence, as Column expressions over token arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Cannot occur in a token.
SEP = "\u0001"


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def ngrams(tokens: Column | str, n: int) -> Column:
    """All runs of n tokens joined by SEP, repeats kept; empty for fewer tokens."""
    t = _col(tokens)
    if n == 1:
        return t
    runs = F.transform(F.sequence(F.lit(1), F.greatest(F.size(t) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(t, i, n), SEP))
    return F.when(F.size(t) >= n, runs).otherwise(F.array().cast("array<string>"))


def ngram_set(tokens: Column | str, n: int) -> Column:
    return F.array_distinct(ngrams(tokens, n))


def novel_ngram_ratio(summary: Column | str, source: Column | str, n: int = 2) -> Column:
    """Share of the summary's distinct n-grams that the source lacks; 0 without any."""
    own = ngram_set(summary, n)
    return F.coalesce(F.try_divide(F.size(F.array_except(own, ngrams(source, n))), F.size(own)), F.lit(0.0))


def multiset_overlap(a: Column | str, b: Column | str) -> Column:
    """Size of the multiset intersection. Both sides are sorted once; each distinct gram is then counted by position, so
    repeats cost no nested scan of the whole lists per occurrence."""
    a, b = _col(a), _col(b)
    common = F.array_intersect(a, b)
    in_a, in_b = F.filter(a, lambda g: F.array_contains(common, g)), F.filter(b, lambda g: F.array_contains(common, g))
    return F.aggregate(
        common, F.lit(0), lambda s, g: s + F.least(F.size(F.filter(in_a, lambda x: x == g)), F.size(F.filter(in_b, lambda x: x == g)))
    )


def f1(overlap: Column, predicted: Column, wanted: Column) -> Column:
    """Harmonic mean of precision and recall; 0 without overlap."""
    return F.when(overlap == 0, F.lit(0.0)).otherwise(2.0 * overlap / (predicted + wanted))


def rouge_n(prediction: Column | str, reference: Column | str, n: int) -> Column:
    p, r = ngrams(prediction, n), ngrams(reference, n)
    return f1(multiset_overlap(p, r), F.size(p), F.size(r))


def lcs_length(a: Column | str, b: Column | str) -> Column:
    """Length of the longest common subsequence by a row-wise fold. Meant for sides of at most some hundred tokens; longer ones belong in
    ``operators.metrics.rouge_l``."""
    a, b = _col(a), _col(b)
    start = F.array_repeat(F.lit(0), F.size(b) + 1)

    def row(above: Column, token: Column) -> Column:
        step = F.aggregate(
            F.sequence(F.lit(1), F.size(b)),
            F.array(F.lit(0)),
            lambda acc, j: F.concat(acc, F.array(F.when(F.get(b, j - 1) == token, F.get(above, j - 1) + 1).otherwise(F.greatest(F.get(above, j), F.element_at(acc, -1))))),
        )
        return F.when(F.size(b) > 0, step).otherwise(above)

    return F.element_at(F.aggregate(a, start, row), -1)
