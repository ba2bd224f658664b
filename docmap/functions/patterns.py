"""Many fixed patterns searched in one pass over each text.

One automaton holds all words of all groups; a text is read once however many
words there are, instead of one scan per word.  Each word counts once.
"""

from __future__ import annotations

from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_AUTOMATA: dict[tuple, Callable[[str], set]] = {}


def finder(words: tuple[str, ...]) -> Callable[[str], set[int]]:
    """text -> places in ``words`` of those that it contains; the automaton of
    the last word lists is kept by the worker."""
    if words not in _AUTOMATA:
        import ahocorasick
        if len(_AUTOMATA) >= 8:
            _AUTOMATA.clear()
        found_by: dict[str, list[int]] = {}
        for i, w in enumerate(words):
            if w:
                found_by.setdefault(w, []).append(i)
        always = {i for i, w in enumerate(words) if not w}  # the empty word is in every text
        automaton = ahocorasick.Automaton()
        for w, places in found_by.items():
            automaton.add_word(w, places)
        automaton.make_automaton()

        def find(text: str) -> set[int]:
            out = set(always)
            if found_by:
                for _, places in automaton.iter(text):
                    out.update(places)
            return out
        _AUTOMATA[words] = find
    return _AUTOMATA[words]


def group_counts(groups: list[list[str]]) -> Callable[[str | None], list[int] | None]:
    """text -> per group how many of its distinct entries the text contains."""
    words = tuple(w for g in groups for w in g)
    group_of = [k for k, g in enumerate(groups) for _ in g]

    def count(text: str | None) -> list[int] | None:
        if text is None:
            return None
        out = [0] * len(groups)
        for i in finder(words)(text):
            out[group_of[i]] += 1
        return out
    return count


def contained_counts(text: Column, groups: list[list[str]]) -> Column:
    """Array with, per group of words, how many of them ``text`` contains."""
    @F.pandas_udf("array<int>")
    def counts(texts: pd.Series) -> pd.Series:
        count = group_counts(groups)
        return pd.Series([count(t) for t in texts], dtype="object")
    return counts(text)
