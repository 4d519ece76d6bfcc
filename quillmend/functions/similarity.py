"""How alike a reading and a term are, as Column expressions. The order (reading, term) matters."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

ADOPT, SUGGEST, CODE_FLOOR, LINES_ALIKE = 0.72, 0.34, 0.60, 0.80


def bigrams(text: Column) -> Column:
    """Distinct pairs of neighbouring characters; a single character is its own."""
    n = F.length(text)
    pairs = F.transform(F.sequence(F.lit(1), n - 1), lambda i: F.substring(text, i, F.lit(2)))
    return F.when(n >= 2, F.array_distinct(pairs)).when(n == 1, F.array(text)).otherwise(F.array().cast("array<string>"))


def dice_of(a: Column, b: Column) -> Column:
    """Dice coefficient of two arrays of distinct items."""
    return F.coalesce(F.try_divide(2.0 * F.size(F.array_intersect(a, b)), F.size(a) + F.size(b)), F.lit(0.0))


def dice(a: Column, b: Column) -> Column:
    return dice_of(bigrams(a), bigrams(b))


def partial(reading: Column, term: Column) -> Column:
    """Best 1 - edits / length of the term against windows of its own length, or two more, of a longer reading."""
    n, m = F.length(reading), F.length(term)

    def window(i: Column) -> Column:
        exact = F.substring(reading, i, m)
        wide = F.substring(reading, i, F.least(m + 2, n - i + 1))
        return F.greatest(1.0 - F.levenshtein(exact, term) / m, 1.0 - F.levenshtein(wide, term) / F.greatest(F.length(wide), m))

    slid = F.array_max(F.transform(F.sequence(F.lit(1), n - m + 1), window))
    return F.when((n == 0) | (m == 0), 0.0).when(m > n, F.greatest(F.lit(0.0), 1.0 - F.levenshtein(reading, term) / m)).otherwise(F.greatest(F.lit(0.0), slid))


def components_of(pairs: Iterable[tuple[str, str]]) -> dict[str, str]:
    """Each glyph of the confusable pairs to one glyph of its group; groups join where pairs share a glyph."""
    group: dict[str, set[str]] = {}
    for a, b in pairs:
        joined = group.get(a, {a}) | group.get(b, {b})
        for c in joined:
            group[c] = joined
    return {c: min(g) for c, g in group.items()}


def canonical(text: Column, groups: dict[str, str]) -> Column:
    """Confusable glyphs to their group's glyph."""
    moved = {c: r for c, r in groups.items() if c != r}
    return F.translate(text, "".join(moved), "".join(moved.values())) if moved else text


def similarity(reading: Column, term: Column, groups: dict[str, str] | None = None) -> Column:
    """Likeness of two match forms, 0 to 1, rounded to four places.

    The better of the bigram coefficient (with a bonus where the reading holds
    the term) and the partial likeness; equal canonical forms give at least
    0.90, and one edit between canonical forms of six characters or more 0.85.
    """
    held = F.when(F.contains(reading, term), 0.55 + 0.35 * F.length(term) / F.length(reading)).otherwise(0.0)
    best = F.greatest(dice(reading, term), held, partial(reading, term))
    if groups:
        a, b = canonical(reading, groups), canonical(term, groups)
        near = (F.least(F.length(a), F.length(b)) >= 6) & (F.abs(F.length(a) - F.length(b)) <= 1) & F.levenshtein(a, b, 1).between(0, 1)
        best = F.when(best >= 0.95, best).when(a == b, F.greatest(best, F.lit(0.90))).when(near, F.greatest(best, F.lit(0.85))).otherwise(best)
    return F.when((reading == "") | (term == ""), 0.0).when(reading == term, 1.0).otherwise(F.round(best, 4))


# Marks that carry no meaning.
FILLERS = r"[\s　.,、。・:：;；!！?？'\"“”「」『』（）()\[\]【】/／\\|ー\-—–]+"


def is_shortening(reading: Column, term: Column) -> Column:
    """Whether the term stands inside the reading and something of meaning would be lost with the rest."""
    at = F.instr(reading, term)
    rest = F.concat(F.substring(reading, F.lit(1), at - 1), F.substring(reading, at + F.length(term), F.length(reading)))
    bare = F.regexp_replace(rest, FILLERS, "")
    return (at > 0) & (term != "") & (bare != "")
