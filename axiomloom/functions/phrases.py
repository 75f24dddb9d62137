"""Normalising phrases for search: punctuation, sub-phrases, stop words."""

from __future__ import annotations

from pyspark.sql import functions as F

from .porter import stem

#: Words of which a sub-phrase may not wholly consist, as such or stemmed; fixed values.
PLAIN_STOP_WORDS = """
    i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her
    hers herself it its itself they them their theirs themselves what which who whom this that these
    those am is are was were be been being have has had having do does did doing a an the and but if or
    because as until while of at by for with about against between into through during before after
    above below to from up down in out on off over under again further then once here there when where
    why how all any both each few more most other some such no nor not only own same so than too very s
    t can will just dont should now d ll m o re ve y aint arent couldnt didnt doesnt hadnt hasnt havent
    isnt ma mightnt mustnt neednt shant shouldnt wasnt werent wont wouldnt
""".split()
STOP_WORDS = frozenset(PLAIN_STOP_WORDS) | frozenset(map(stem, PLAIN_STOP_WORDS))
_SIGNS = r"""[!"#$%&'()*+,\-./:;<=>?@\[\]^_`{|}~“”’]"""


def depunctuate(col):
    """Column: possessive endings within the text become a space, then ASCII punctuation and curly quotes go; a backslash stays."""
    spaced = F.regexp_replace(col, r"(?:['’]s |['’] )", " ")
    return F.regexp_replace(spaced, _SIGNS, "")


def phrase_words(col):
    """Column: the words of a phrase, split at white space."""
    return F.filter(F.split(F.trim(col), r"\s+"), lambda w: w != "")


def sub_phrases(words, stop_words=STOP_WORDS, longest: int | None = None):
    """Column: all runs of ``words`` (an array) shorter than the whole that have a word outside ``stop_words``, as arrays.

    With ``longest``, only runs of up to so many words: no index entry is longer.
    """
    stops = F.array(*[F.lit(w) for w in sorted(stop_words)])
    n = F.size(words)
    most = n - 1 if longest is None else F.least(n - 1, F.lit(longest))

    def of_length(k):
        return F.transform(F.sequence(F.lit(1), n - k + 1), lambda i: F.slice(words, i, k))

    runs = F.when(most < 1, F.array().cast("array<array<string>>")).otherwise(F.flatten(F.transform(F.sequence(F.lit(1), F.greatest(most, F.lit(1))), of_length)))
    return F.array_distinct(F.filter(runs, lambda run: F.exists(run, lambda w: ~F.array_contains(stops, w))))
