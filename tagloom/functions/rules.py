"""N-gram rules over words with their part of speech: which grammars make a type, in which order, and what text a fact has.

The part of speech comes from a hook (``tagger``); the default goes by endings and stands in for an analyser, whose parity
isn't claimed. Grammars of a type are concatenated in their fixed order before positions are counted.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tagloom.functions import text as T

ADJECTIVE, VERB, ADVERB, NOUN = "A", "V", "D", "N"
ENDINGS = {ADJECTIVE: "(ый|ий|ой|ая|яя|ое|ее|ые|ие)$", VERB: "(ть|ти|чь)$", ADVERB: "(о|ly)$"}


def by_ending(word: Column) -> Column:
    """A part of speech by the word's ending; whatever has none of these is a noun."""
    out = F.when(word.rlike(ENDINGS[ADJECTIVE]), ADJECTIVE).when(word.rlike(ENDINGS[VERB]), VERB).when(word.rlike(ENDINGS[ADVERB]), ADVERB)
    return out.otherwise(NOUN)


def tagged(words: Column, tagger: Callable[[Column], Column] = by_ending) -> Column:
    """An array of ``w`` and ``p`` from an array of words."""
    return F.transform(words, lambda w: F.struct(w.alias("w"), tagger(w).alias("p")))


def single(kinds: str) -> Callable[[Column], Column]:
    """The words of these parts of speech."""
    return lambda items: F.transform(F.filter(items, lambda x: x["p"].isin(*kinds)), lambda x: x["w"])


def sequence(kinds: str, order: list[int]) -> Callable[[Column], Column]:
    """Neighbours of these parts of speech; the fact's text names them in ``order``, the head first."""
    n = len(kinds)

    def facts(items: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(items) - n + 1, F.lit(1)))
        fit = lambda i: (F.size(items) >= n) & F.array_join(F.transform(F.slice(items, i, n), lambda x: x["p"]), "").eqNullSafe(kinds)
        return F.transform(F.filter(starts, fit), lambda i: F.concat_ws(" ", *(F.element_at(items, (i + k).cast("int"))["w"] for k in order)))

    return facts


#: The grammars of each type, in order: single words; adjective and noun either way, noun and noun, verb and adverb either way; two adjectives and a noun.
GRAMMARS: dict[int, list[Callable[[Column], Column]]] = {
    1: [single(ADJECTIVE + NOUN + VERB + ADVERB)],
    2: [sequence("AN", [1, 0]), sequence("NA", [0, 1]), sequence("NN", [0, 1]), sequence("VD", [0, 1]), sequence("DV", [1, 0])],
    3: [sequence("AAN", [0, 1, 2])],
}


def facts(words: Column, kind: int, tagger: Callable[[Column], Column] = by_ending, grammars: dict | None = None) -> Column:
    """The n-grams of a type, grammar after grammar, repeats included."""
    chosen = (grammars or GRAMMARS)[kind]
    return T.bound(tagged(words, tagger), lambda items: F.concat(*(g(items) for g in chosen)))


def rule_postings(posts: DataFrame, id_column: str, text: Column, kind: int, stop: list[str] = T.STOP_WORDS, tagger=by_ending, lemma: T.Lemma = T.same, grammars: dict | None = None) -> DataFrame:
    """``post_id, ngram, uses_str, uses_cnt`` of the grammars' n-grams; only single words are lemmatised."""
    words = T.words_of(text, lemma if kind == 1 else T.same)
    return T.positioned(posts.select(F.col(id_column).alias("post_id"), T.without(facts(words, kind, tagger, grammars), stop).alias("items")))
