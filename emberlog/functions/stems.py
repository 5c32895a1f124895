"""Stems by endings: tables of own making, applied by the longest ending that leaves enough of a word. No library, no Python row by row.

Meant for search, where case forms and numbers of a word should meet; what is left is no word of any language.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from emberlog.functions.text import let

#: Endings of Russian and Ukrainian nouns and adjectives (case, number), verbs (person, tense) and reflexives, unaccented
#: and in lower case, each with what may follow it.
NOUNS = ["а", "я", "у", "ю", "ом", "ем", "ою", "ею", "ой", "ей", "е", "и", "ы", "і", "ї", "о", "ов", "ев", "ів", "їв", "єв", "ам", "ям", "ами", "ями", "ах", "ях", "ові", "еві", "єві", "ь", "й", "ию", "ия", "ие", "ии", "ий", "ія", "ії", "ію", "єю", "ій", "ью", "ям", "иям", "иями", "иях", "іям", "іями", "іях"]
ADJECTIVES = ["ый", "ий", "ой", "ая", "яя", "ое", "ее", "ые", "ие", "ого", "его", "ому", "ему", "ым", "им", "ом", "ем", "ой", "ей", "ую", "юю", "ых", "их", "ыми", "ими", "ою", "ею", "а", "я", "е", "є", "і", "ої", "ій", "їй", "им", "їм"]
VERBS = ["ть", "ти", "ешь", "ишь", "ет", "ит", "ем", "им", "ете", "ите", "ут", "ют", "ат", "ят", "ает", "яет", "аешь", "яешь", "аем", "яем", "аете", "яете", "ают", "яют", "ал", "ала", "ало", "али", "ил", "ила", "ило", "или", "ел", "ела", "ело", "ели", "ав", "ив", "ать", "ять", "ить", "еть", "ати", "яти", "ити", "іти", "еш", "єш", "иш", "їш", "емо", "ємо", "имо", "їмо", "ете", "єте", "уть", "ють", "ать", "ять", "ую", "юю"]
REFLEXIVE = ["", "ся", "сь"]
CYRILLIC = sorted({v + r for r in REFLEXIVE for v in VERBS} | {*NOUNS, *ADJECTIVES})
#: English plurals, verb forms and a few derivations; the same letters end many German, French and Spanish forms.
LATIN = ["s", "es", "ed", "ing", "ly", "er", "ers", "en", "em", "e", "a", "o", "as", "os", "ies", "y", "ment", "ments", "ness"]
#: Letters that must be left.
LEAST = 3


def pattern(endings: list[str], letters: str) -> str:
    """A word of these letters as a stem ($1), taken as short as the endings allow, and an ending. Both of Java's and RE2's dialect."""
    return f"^([{letters}]{{{LEAST},}}?)(?:{'|'.join(sorted(filter(None, endings), key=lambda e: (-len(e), e)))})$"


PATTERNS = [pattern(CYRILLIC, "а-яёіїєґ"), pattern(LATIN, "a-z")]
#: All of them for words on lines of their own, in Java's dialect: a word is of one alphabet, so one of them fits at most.
LINES = f"(?md)(?:{'|'.join(PATTERNS[::-1])})"


def stem(word: Column) -> Column:
    """A lower-case word without its ending; words of other letters, with digits, or too short stay as they are."""
    for p in PATTERNS:
        word = F.regexp_replace(word, p, "$1")
    return word


def stems(words: Column) -> Column:
    """For text.tokens(stem=...): the stems of an array of tokens, a line each of one text that is looked through once."""
    lines = F.split(F.regexp_replace(F.array_join(words, "\n", "\n"), LINES, "$1$2"), "\n", -1)
    # A null, a line end within a word and an empty array each give more lines than words.
    return let(lines, lambda found: F.when(F.size(found) == F.size(words), found).otherwise(F.transform(words, stem)))
