"""Text analyzers as Columns: text to array of terms. Any function from Column to Column can serve as one.

Fixed values (the results depend on them): the stop words below, the letter-or-digit pattern and the CJK ranges.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

Analyzer = Callable[[Column], Column]

#: English and Chinese stop words.
ENGLISH_STOP_WORDS = (
    "the", "a", "an", "is", "are", "was", "were", "be", "been", "being", "have", "has", "had", "do", "does", "did",
    "will", "would", "could", "should", "may", "might", "shall", "can", "need", "dare", "ought", "used", "to", "of",
    "in", "for", "on", "with", "at", "by", "from", "as", "into", "through", "during", "before", "after", "above",
    "below", "between", "out", "off", "over", "under", "again", "further", "then", "once", "here", "there", "when",
    "where", "why", "how", "all", "any", "both", "each", "few", "more", "most", "other", "some", "such", "no", "nor",
    "not", "only", "own", "same", "so", "than", "too", "very", "and", "but", "or", "because", "until", "while", "it",
    "its",
)
CHINESE_STOP_WORDS = (
    "的", "了", "在", "是", "我", "有", "和", "就", "不", "人", "都", "一", "一个", "上", "也", "很", "到", "说", "要", "去", "你", "会",
    "着", "没有", "看", "好", "自己", "这", "他", "她", "它",
)
#: Runs of letters and digits; one ideograph; a run of ideographs.
WORDS, IDEOGRAPH, IDEOGRAPHS = "([\\p{L}\\p{N}]+)", "[\\u4e00-\\u9fff\\u3400-\\u4dbf\\uf900-\\ufaff]", "([\\u4e00-\\u9fa5]+)"


def _grams(characters: Column, n: int) -> Column:
    """All runs of n of an array of characters, joined."""
    places = F.when(F.size(characters) >= n, F.sequence(F.lit(1), F.size(characters) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.array_join(F.slice(characters, i, n), ""))


def _not_stopped(terms: Column, stop: tuple[str, ...]) -> Column:
    return F.filter(terms, lambda t: ~t.isin(*stop))  # a hash set


def simple(text: Column) -> Column:
    """Lower-cased words without stop words and single characters.

    A word with ideographs gives its ideographs (without stop words) and then the pairs of neighbours among them.
    """
    words = F.filter(_not_stopped(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 1), ENGLISH_STOP_WORDS + CHINESE_STOP_WORDS), lambda t: F.length(t) > 1)

    def terms(word: Column) -> Column:
        signs = F.regexp_extract_all(word, F.lit(f"({IDEOGRAPH})"), 1)
        return F.when(F.size(signs) > 0, F.concat(_not_stopped(signs, CHINESE_STOP_WORDS), _grams(signs, 2))).otherwise(F.array(word))

    mixed = F.when(text.rlike(IDEOGRAPH), F.flatten(F.transform(words, terms))).otherwise(words)  # most texts have no ideographs
    return F.coalesce(mixed, F.array().cast("array<string>"))


def ngrams(text: Column) -> Column:
    """Runs of 2 to 4 ideographs without Chinese stop words, and all lower-cased words of over one character."""
    runs = F.regexp_extract_all(text, F.lit(IDEOGRAPHS), 1)

    def pieces(run: Column) -> Column:
        signs = F.regexp_extract_all(run, F.lit("(.)"), 1)
        return F.concat(*[_grams(signs, n) for n in (2, 3, 4)])

    grams = _not_stopped(F.flatten(F.transform(runs, pieces)), CHINESE_STOP_WORDS)
    words = F.filter(F.regexp_extract_all(F.lower(text), F.lit(WORDS), 1), lambda t: F.length(t) > 1)
    return F.coalesce(F.concat(grams, _not_stopped(words, CHINESE_STOP_WORDS)), F.array().cast("array<string>"))


ANALYZERS: dict[str, Analyzer] = {"simple": simple, "ngrams": ngrams}
