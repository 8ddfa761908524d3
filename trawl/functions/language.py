"""The language of a text at ingestion, in column functions: by the share of its words that are a language's stopwords."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trawl.config import ConfigError
from trawl.functions import text as texts



def detected(text: Column, languages: tuple[str, ...] = tuple(texts.STOPWORD_LANGUAGES)) -> Column:
    """(language, confidence): the language most of whose stopwords stand in the text, ties by name, and its lead over the next, from 0 to 1.

    Both are null for a text in which none stands.
    """
    words = texts.whitespace_tokens(text)

    def held(w: Column, language: str) -> Column:
        stop = texts.stopwords(language)
        return F.size(F.filter(w, lambda x: x.isin(*stop))) if stop else F.lit(0)

    def best(w: Column) -> Column:
        counts = F.array(*[F.struct((-held(w, lang)).alias("less"), F.lit(lang).alias("language")) for lang in sorted(languages)])
        return F.transform(F.array(F.array_sort(counts)), lambda x: F.when(x[0]["less"] < 0, F.struct(
            x[0]["language"].alias("language"), ((x[0]["less"] - x[1]["less"]) / x[0]["less"]).cast("double").alias("confidence"))))[0]

    return F.transform(F.array(words), best)[0]


def language_code(text: Column, *, detect: bool, confidence: float, default: str | None, languages: tuple[str, ...] = tuple(texts.STOPWORD_LANGUAGES)) -> Column:
    """The detected language if its confidence suffices, else the default; a row for which there is neither is an error."""
    if not detect and not default:
        raise ConfigError("no language: detect it, or give a default")
    other = F.lit(default) if default else F.raise_error(F.lit("no language could be determined, and there is no default")).cast("string")
    if not detect:
        return other
    return F.transform(F.array(detected(text, languages)), lambda x: F.when(x["confidence"] >= confidence, x["language"]).otherwise(other))[0]
