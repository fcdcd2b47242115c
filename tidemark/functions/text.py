"""Tokens, n-grams and a small polarity lexicon."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column
from pyspark.sql import functions as F

TOKEN = r"[\p{L}\p{N}_]{2,}"

# Polarity of common market words, our own list (its scores are not those of other
# lexicons).
POLARITY = {
    "beat": 1.8, "beats": 1.8, "best": 2.2, "boost": 1.7, "bullish": 2.1, "gain": 1.6, "gains": 1.6,
    "good": 1.9, "great": 2.3, "growth": 1.4, "high": 0.8, "outperform": 1.9, "profit": 1.6,
    "rally": 1.7, "record": 1.0, "rise": 1.3, "rises": 1.3, "soar": 2.2, "soars": 2.2, "strong": 1.6,
    "surge": 2.0, "surges": 2.0, "up": 0.7, "upgrade": 1.8, "upgraded": 1.8, "win": 1.9, "wins": 1.9,
    "bad": -1.9, "bankruptcy": -2.8, "bearish": -2.1, "crash": -2.6, "cut": -1.1, "cuts": -1.1,
    "decline": -1.5, "down": -0.7, "downgrade": -1.8, "downgraded": -1.8, "drop": -1.5, "drops": -1.5,
    "fall": -1.4, "falls": -1.4, "fraud": -2.7, "lawsuit": -1.8, "loss": -1.8, "losses": -1.8,
    "low": -0.8, "miss": -1.6, "misses": -1.6, "plunge": -2.3, "plunges": -2.3, "slump": -2.0,
    "weak": -1.6, "worst": -2.5,
}
#: Words that turn the polarity of one of the next three words, and by how much.
NEGATIONS = ("not", "no", "never", "without", "neither", "nor", "cannot", "don", "doesn", "didn", "isn", "wasn", "aren", "hardly")
TURNED = -0.74
#: Words that move the polarity of the next word away from zero, or towards it.
DEGREES = {"very": 0.3, "sharply": 0.3, "strongly": 0.3, "deeply": 0.3, "record": 0.3, "hugely": 0.3, "slightly": -0.3, "somewhat": -0.3, "barely": -0.3, "almost": -0.3}


def tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(TOKEN), F.lit(0))


def ngrams(words: Column, first: int, last: int) -> Column:
    """The words' n-grams for n from ``first`` to ``last``, joined by a space."""
    grams = []
    for n in range(first, last + 1):
        if n == 1:
            grams.append(words)
            continue
        at = F.when(F.size(words) >= n, F.sequence(F.lit(1), F.size(words) - n + 1)).otherwise(F.expr("cast(array() AS array<int>)"))
        grams.append(_joined(words, at, n))
    return F.concat(*grams) if len(grams) > 1 else grams[0]


def _joined(words: Column, at: Column, n: int) -> Column:
    return F.transform(at, lambda i: F.array_join(F.slice(words, i, n), " "))


def _table(values: Mapping[str, float]) -> Column:
    return F.create_map(*(F.lit(x) for k in sorted(values) for x in (k, float(values[k]))))


def polarity(words: Column, lexicon: Mapping[str, float] = POLARITY) -> Column:
    """Sum s of the words' polarities squashed to s / sqrt(s * s + 15), 0 without any.

    A degree right before a word adds to its polarity or takes from it; a negation among the three
    words before turns it. Words outside the lexicon are sorted out by a hash set, so that its
    size costs nothing for them.
    """
    table, degrees = _table(lexicon), _table(DEGREES)

    def of(w: Column) -> Column:
        def value(i: Column) -> Column:
            own, before = F.element_at(table, F.get(w, i)), F.get(w, i - 1)
            pushed = own + F.when(before.isin(*DEGREES), F.signum(own) * F.try_element_at(degrees, before)).otherwise(0.0)
            turned = F.exists(F.slice(w, F.greatest(i - 2, F.lit(1)), F.least(i, F.lit(3))), lambda x: x.isin(*NEGATIONS))
            return F.when(turned, pushed * TURNED).otherwise(pushed)

        found = F.filter(F.transform(w, lambda x, i: F.when(x.isin(*lexicon), i)), lambda i: i.isNotNull())
        total = F.aggregate(found, F.lit(0.0), lambda a, i: a + value(i))
        return total / F.sqrt(total * total + F.lit(15.0))

    return F.transform(F.array(words), of)[0]  # so that the words are worked out once and not at each place
