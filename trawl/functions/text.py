"""Text to sparse vectors, in column functions: tokens, saturated term frequencies, pruning.

Everything happens within a row: a row's tokens are sorted, runs are counted, weighted and cut to the heaviest, so
building vectors takes no shuffle. Tokens are strings, with a prefix of one `#` per channel where channels share a slot.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

K1, B = 1.2, 0.75
QUERY_AVGDL, DEFAULT_AVGDL = 5.0, 50.0
WORD_WEIGHT, STEM_WEIGHT = 4.0, 8.0
LENGTH_BOOST = 0.5

#: Word bounds for scripts that separate words: letters and digits with the marks between them that don't end a word.
WORD = (r"[\p{L}\p{N}\p{M}_]+(?:(?<=\p{L})['’.:·](?=\p{L})[\p{L}\p{N}\p{M}_]+"
        r"|(?<=\p{N})['’.,;](?=\p{N})[\p{L}\p{N}\p{M}_]+)*")

STOPWORD_LANGUAGES = {
    "en": "english", "es": "spanish", "fr": "french", "it": "italian", "de": "german", "pt": "portuguese", "nl": "dutch", "ru": "russian",
    "tr": "turkish", "sv": "swedish", "da": "danish", "no": "norwegian", "fi": "finnish", "hu": "hungarian",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), with value made once a row, however often body's own lambdas use it."""
    return F.transform(F.array(value), body)[0]


@lru_cache(maxsize=None)
def stopwords(language: str) -> tuple[str, ...]:
    """The stopwords of a language; none for one without a list."""
    if language not in STOPWORD_LANGUAGES:
        return ()
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(STOPWORD_LANGUAGES[language]))


def preprocessed(text: Column) -> Column:
    """Lower case, runs of Unicode white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"(?U)\s+", " "))


def without_stopwords(tokens: Column, stop: tuple[str, ...]) -> Column:
    kept = F.filter(tokens, lambda t: t != "")
    return F.filter(kept, lambda t: ~t.isin(*stop)) if stop else kept


def whitespace_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    return without_stopwords(F.split(preprocessed(text), " "), stop)


def grams(text: Column, pad: int) -> Column:
    """Character trigrams of a text with `pad` spaces on each side; none of an empty text."""
    def cut(chars: Column) -> Column:
        made = F.transform(F.sequence(F.lit(0), F.greatest(F.size(chars) - 3, F.lit(0))), lambda i: F.concat(F.get(chars, i), F.get(chars, i + 1), F.get(chars, i + 2)))
        return F.filter(made, lambda g: F.size(chars) > 2 * pad)

    return let(F.split(F.concat(F.lit(" " * pad), text, F.lit(" " * pad)), "", -1), cut)  # by characters, each found at once


def trigram_tokens(text: Column) -> Column:
    return grams(preprocessed(text), 2)


def word_tokens(text: Column, stop: tuple[str, ...] = ()) -> Column:
    """Words with at least one letter or digit, before stemming."""
    found = F.regexp_extract_all(preprocessed(text), F.lit(WORD), F.lit(0))
    return without_stopwords(F.filter(found, lambda t: t.rlike(r"[\p{L}\p{N}]")), stop)


def counted(tokens: Column) -> Column:
    """array<struct<token, tf>> of an array of tokens, by token."""
    def runs(ordered: Column) -> Column:
        n = F.size(ordered)
        first = F.filter(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: (n > 0) & ((i == 1) | (F.get(ordered, i - 1) != F.get(ordered, i - 2))))
        return let(first, lambda starts: F.transform(starts, lambda a, k: F.struct(F.get(ordered, a - 1).alias("token"), (F.coalesce(F.get(starts, k + 1), n + 1) - a).alias("tf"))))

    return let(F.sort_array(tokens), runs)


def saturated(tf: Column, length: Column, avgdl: Column | float, base: Column | float = 1.0) -> Column:
    avgdl = avgdl if isinstance(avgdl, Column) else F.lit(float(avgdl))
    base = base if isinstance(base, Column) else F.lit(float(base))
    tf = tf.cast("double")
    return base * tf * F.lit(K1 + 1) / (tf + F.lit(K1) * (F.lit(1 - B) + F.lit(B) * length.cast("double") / avgdl))


def heaviest(weighted: Column, k: int) -> Column:
    """The k heaviest of array<struct<token, weight>>, ties to the smaller token."""
    ranked = F.sort_array(F.transform(weighted, lambda x: F.struct((-x["weight"]).alias("less"), x["token"].alias("token"))))
    return F.transform(F.slice(ranked, 1, k) if k > 0 else F.slice(ranked, 1, 0), lambda x: F.struct(x["token"].alias("token"), (-x["less"]).alias("weight")))


def sparse_vector(tokens: Column, avgdl: Column | float, top_k: int, prefix: str = "") -> Column:
    """array<struct<token, weight>>: saturated term frequencies, pruned."""
    def weighted(made: Column) -> Column:
        n = F.size(made)
        return F.transform(counted(made), lambda x: F.struct(F.concat(F.lit(prefix), x["token"]).alias("token"), saturated(x["tf"], n, avgdl).alias("weight")))

    return heaviest(let(tokens, weighted), top_k)


def pruned_length(tokens: Column, top_k: int) -> Column:
    """The number of distinct tokens that pruning leaves: what average lengths are of."""
    return F.least(F.size(F.array_distinct(tokens)), F.lit(top_k))


def multilevel_vector(text: Column, stemmed: Column, avgdl: Column | float, top_k: int, word_ratio: int, trigram_weight: Column | float, stop: tuple[str, ...] = ()) -> Column:
    """Three channels in one vector: words as written (#), stemmed words (##) and trigrams (###).

    text: preprocessed. stemmed: the stemmed words of the text. Words as written count only where no stem equals them;
    word channels get a boost by the share that a word has of the text's length.
    """
    def vector(x: Column) -> Column:
        stems, words = x["stems"], x["words"]
        both = F.concat(F.transform(words, lambda t: F.struct(t.alias("t"), F.lit(0).alias("stem"))), F.transform(stems, lambda t: F.struct(t.alias("t"), F.lit(1).alias("stem"))))
        plain_of = lambda x: F.struct(x["token"]["t"].alias("token"), x["tf"].alias("tf"))
        # sorted by token, a word stands right before the equal stem
        runs = F.struct(counted(both).alias("all"))
        apart = let(runs, lambda r: F.struct(
            F.transform(F.filter(r["all"], lambda x, i: (x["token"]["stem"] == 0) & ~F.coalesce(F.get(r["all"], i + 1)["token"]["t"] == x["token"]["t"], F.lit(False))), plain_of).alias("rest"),
            F.transform(F.filter(r["all"], lambda x: x["token"]["stem"] == 1), plain_of).alias("stems")))
        tri = F.filter(grams(F.array_join(words, " "), 1), lambda g: F.size(words) > 0)
        n, chars = x["n"], x["chars"]
        most = F.lit(LENGTH_BOOST) * F.least(F.lit(1.0), 1 / F.greatest(F.lit(1.0), F.log10(chars)))

        def channel(runs: Column, prefix: str, base: Column | float, boosted: bool) -> Column:
            def weigh(x: Column) -> Column:
                weight = saturated(x["tf"], n, avgdl, base)
                size = F.octet_length(x["token"])
                if boosted:
                    weight = weight + F.when(size >= 3, size.cast("double") / chars * most).otherwise(F.lit(0.0))
                return F.struct(F.concat(F.lit(prefix), x["token"]).alias("token"), weight.alias("weight"))
            return F.transform(runs, weigh)

        word_k = top_k * word_ratio // 100
        return F.concat(heaviest(let(apart, lambda x: F.concat(channel(x["rest"], "#", WORD_WEIGHT, True), channel(x["stems"], "##", STEM_WEIGHT, True))), word_k),
                        heaviest(channel(counted(tri), "###", trigram_weight, False), top_k - word_k))

    made = F.struct(F.length(text).cast("double").alias("chars"), F.size(stemmed).alias("n"), stemmed.alias("stems"), without_stopwords(F.split(text, " "), stop).alias("words"))
    return F.when(text != "", let(made, vector)).otherwise(F.array().cast("array<struct<token:string,weight:double>>"))


def idf(n_docs: Column, n_with: Column) -> Column:
    n, m = n_docs.cast("double"), n_with.cast("double")
    return F.ln(1 + (n - m + 0.5) / (m + 0.5))
