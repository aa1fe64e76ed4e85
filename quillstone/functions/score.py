"""Scores of recognised text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from quillstone.functions import text as T
from quillstone.functions import values as V

# Parts of the patterns that count tokens of a text.  A token is a run of
# non-space; marks at its ends do not count.  All repeats are possessive and all
# matches begin at a token, so any text takes linear time.
_L = "A-Za-zÀ-ỹĐđ"
_E = "()\\[\\]{}\"'“”‘’.,;:!?"
_AT = rf"(?U)(?<!\S)(?=[^\s{_L}]*+[{_L}])"
_ALPHA = rf"(?U)(?<!\S)[^\s{_L}]*+[{_L}]\S*+"
_MIXED = rf"(?U)(?<!\S)\S*?(?:[{_L}][0-9]|[0-9][{_L}])\S*+"
_SHOUTED = rf"(?U)(?<!\S)[{_E}]*+[A-ZĐÀ-Ỵ]{{14,}}+[{_E}]*+(?!\S)"
_ENDLESS = _AT + rf"[{_E}]*+\p{{L}}{{18,}}+[{_E}]*+(?!\S)"
_QUOTED = _AT + rf"[{_E}]*+(?>[^\s{_E}][^\s'’]*+['’])[{_E}]*+[^\s{_E}]"
_COMMON = rf"(?U)(?<!\S)[{_E}]*+(?:{'|'.join(V.QUALITY_WORDS)})[{_E}]*+(?!\S)"


def _clamp(c: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), c))


def text_quality(c: Column | str) -> Column:
    """From 0 to 1: penalties for suspicious, mixed, shouted and quoted tokens,
    rewards for frequent words and Vietnamese letters."""

    def count(text: Column, pattern: str) -> Column:
        return F.regexp_count(text, F.lit(pattern))

    def of_alpha(text: Column, n: Column) -> Column:
        # a look for what a kind of token has spares most texts its pattern
        hints = [(r"[0-9]", _MIXED), (r"[A-ZĐÀ-Ỵ]{14}", _SHOUTED), (r"\p{L}{18}", _ENDLESS), (r"['’]", _QUOTED)]
        mixed, shouted, endless, quoted = (F.when(text.rlike(hint), count(text, p)).otherwise(0) for hint, p in hints)
        common = count(F.lower(text), _COMMON)
        marks = T.count_in(text, V.VIETNAMESE_LOWER + V.VIETNAMESE_UPPER) / F.greatest(F.lit(1), F.length(T.letters_only(text)))
        counts = F.array(mixed, shouted, endless, quoted, common)

        def total(k: Column) -> Column:
            return _clamp(
                F.lit(1.0)
                - (k[0] + k[1] + k[2]) / n * 1.2
                - k[0] / n * 1.4
                - k[1] / n * 0.9
                - k[3] / n * 0.35
                + F.least(F.lit(0.2), k[4] / n * 0.35)
                + F.least(F.lit(0.15), marks * 0.5)
            )

        return T.let(counts, total)

    def of_text(text: Column) -> Column:
        score = T.let(count(text, _ALPHA), lambda n: F.when(n == 0, 0.2).otherwise(of_alpha(text, n)))
        return F.when(text == "", 0.0).otherwise(score)

    return T.let(F.coalesce(T.normalize(c), F.lit("")), of_text)


def line_score(c: Column | str, confidence: Column | str) -> Column:
    """The score by which the best engine of a line is picked."""
    c, conf = T.strip(c), T.col(confidence)
    n = F.length(c)
    marks = T.count_in(c, V.VIETNAMESE_LOWER + V.VIETNAMESE_UPPER)
    share = marks / F.greatest(n, F.lit(1))
    score = (
        F.when(n < 3, -20).when(n < 5, n).otherwise(F.least(n, F.lit(50)) * 2)
        + conf * 50
        + F.when((share >= 0.05) & (share <= 0.6), marks * 5).when(share > 0.8, -20).otherwise(0)
        + F.when(T.distinct_chars(c) < n / 3, -40).otherwise(0)
        + F.when(F.contains(c, F.lit(" ")), 10).otherwise(0)
    )
    return F.when(T.is_garbage(c), -1000.0).when(conf < 0.2, -500.0).otherwise(score.cast("double"))


def vi_score(c: Column | str, confidence: Column | str) -> Column:
    """The score by which variants of one image are compared."""
    c, conf = T.col(c), T.col(confidence)
    low, n = F.lower(c), F.greatest(F.length(c), F.lit(1))
    dense, count = F.length(F.replace(c, F.lit(" "), F.lit(""))), F.size(T.words(c))
    ratio = F.length(T.letters_only(c)) / n
    score = conf * 20 + T.count_in(c, V.VIETNAMESE_LOWER + V.VIETNAMESE_UPPER) * 5
    score += F.when((dense >= 10) & (dense <= 100), dense * 0.5).when(dense < 5, -20).otherwise(0)
    score += F.when(F.contains(c, F.lit(" ")) & (count >= 2) & (count <= 20), count * 3).otherwise(0)
    score += F.when(ratio > 0.7, 15).when(ratio < 0.4, -30).otherwise(0)
    for part in V.GARBAGE:
        score -= F.when(F.contains(low, F.lit(part)), 100).otherwise(0)
    score -= F.when(T.distinct_chars(low) / n < 0.3, 50).otherwise(0)
    return F.when(F.coalesce(c, F.lit("")) == "", -1000.0).otherwise(score.cast("double"))


def variant_score(c: Column | str, confidence: Column | str) -> Column:
    c = T.col(c)
    n = F.length(c)
    score = T.col(confidence) + T.count_in(F.lower(c), V.VIETNAMESE_LOWER) * 0.05
    score += F.when((n >= 5) & (n <= 200), 0.1).otherwise(0.0)
    score += F.when(F.contains(c, F.lit(" ")), 0.1).otherwise(0.0)
    return score - F.when(F.length(T.letters_only(c)) / F.greatest(n, F.lit(1)) < 0.5, 0.2).otherwise(0.0)


def lm_confidence(c: Column | str) -> Column:
    """60 % coverage by known words, 40 % Vietnamese letters; 0 without words."""
    own = T.words(F.lower(T.col(c)))
    known = F.size(F.filter(own, lambda w: w.isin(V.MODEL_WORDS)))
    marks = T.count_in(F.lower(T.col(c)), V.VIETNAMESE_LOWER)
    return F.when(F.size(own) > 0, known / F.size(own) * 0.6 + marks / F.length(T.col(c)) * 0.4).otherwise(0.0)


def pseudo_confidence(c: Column | str, engine: Column | str) -> Column:
    """What engines without scores of their own are taken to be sure of."""
    engine, n = T.col(engine), F.length(T.col(c)) / 100
    return (
        F.when(engine == "vietocr", F.least(F.lit(0.95), 0.75 + n))
        .when(engine == "trocr", F.least(F.lit(0.90), 0.70 + n))
        .when(engine == "protonx", 0.85)
        .when(engine == "tesseract", 0.80)
        .when(engine == "crnn", 0.65)
        .otherwise(0.70)
    )


def cer(predicted: Column | str, truth: Column | str) -> Column:
    """Edit distance over the truth's length; for an empty truth 0 or 1."""
    p, t = T.col(predicted), T.col(truth)
    return F.when(F.length(t) == 0, F.when(F.length(p) > 0, 1.0).otherwise(0.0)).otherwise(F.levenshtein(p, t) / F.length(t))


def wer_compat(predicted: Column | str, truth: Column | str) -> Column:
    """Edit distance of the words joined by spaces over the number of words;
    not the usual word error rate, which counts words."""
    p, t = T.words(predicted), T.words(truth)
    distance = F.levenshtein(F.array_join(p, " "), F.array_join(t, " "))
    return F.when(F.size(t) == 0, F.when(F.size(p) > 0, 1.0).otherwise(0.0)).otherwise(distance / F.size(t))
