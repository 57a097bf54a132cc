"""English stems by Porter's algorithm, as scorers of summaries use it."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

# Suffixes and what they become. Exceptions, and the rules for words of four letters in -ies and -ied,
# are those that published scores of summaries are made with.
EXCEPTIONS = {
    "skies": "sky",
    "sky": "sky",
    "dying": "die",
    "lying": "lie",
    "tying": "tie",
    "news": "news",
    "innings": "inning",
    "inning": "inning",
    "outings": "outing",
    "outing": "outing",
    "cannings": "canning",
    "canning": "canning",
    "howe": "howe",
    "proceed": "proceed",
    "exceed": "exceed",
    "succeed": "succeed",
}
DERIVED = {
    "ational": "ate",
    "tional": "tion",
    "enci": "ence",
    "anci": "ance",
    "izer": "ize",
    "bli": "ble",
    "alli": "al",
    "entli": "ent",
    "eli": "e",
    "ousli": "ous",
    "ization": "ize",
    "ation": "ate",
    "ator": "ate",
    "alism": "al",
    "iveness": "ive",
    "fulness": "ful",
    "ousness": "ous",
    "aliti": "al",
    "iviti": "ive",
    "biliti": "ble",
    "fulli": "ful",
    "logi": "log",
}
SHORTENED = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
DROPPED = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def shape(word: str) -> str:
    """A letter ``c`` or ``v`` for each consonant and vowel; y is a vowel after a consonant."""
    out = ""
    for c in word:
        out += "v" if c in "aeiou" or (c == "y" and out.endswith("c")) else "c"
    return out


def measure(word: str) -> int:
    """How often consonants follow vowels."""
    return shape(word).count("vc")


def ends_short(word: str) -> bool:
    """Whether a word ends in consonant, vowel, consonant, but not w, x or y; or is a vowel and a consonant."""
    s = shape(word)
    return (s.endswith("cvc") and word[-1] not in "wxy") or s == "vc"


def suffix_of(word: str, table) -> str | None:
    """The longest suffix of a table that a word has."""
    found = [s for s in table if word.endswith(s)]
    return max(found, key=len) if found else None


def singular(w: str) -> str:
    if w.endswith("sses"):
        return w[:-2]
    if w.endswith("ies"):
        return w[:-1] if len(w) == 4 else w[:-2]
    return w[:-1] if w.endswith("s") and not w.endswith("ss") else w


def without_tense(w: str) -> str:
    if w.endswith("ied"):
        return w[:-1] if len(w) == 4 else w[:-2]
    if w.endswith("eed"):
        return w[:-1] if measure(w[:-3]) > 0 else w
    base = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s)), "")
    if "v" not in shape(base):
        return w
    if base.endswith(("at", "bl", "iz")):
        return base + "e"
    if len(base) > 1 and base[-1] == base[-2] and shape(base).endswith("c"):
        return base if base[-1] in "lsz" else base[:-1]
    return base + "e" if measure(base) == 1 and ends_short(base) else base


def derived(w: str) -> str:
    """Suffixes that are derived from others, when the rest has a consonant after a vowel."""
    while (s := suffix_of(w, DERIVED)) is not None:
        # The l of -logi counts for what is before it.
        rest = w[: -len(s)]
        if measure(rest + "l" if s == "logi" else rest) == 0:
            return w
        w = rest + DERIVED[s]
        if s != "alli":
            return w
    return w


def shortened(w: str) -> str:
    s = suffix_of(w, SHORTENED)
    return w[: -len(s)] + SHORTENED[s] if s and measure(w[: -len(s)]) > 0 else w


def dropped(w: str) -> str:
    s = suffix_of(w, DROPPED)
    if s is None or (s == "ion" and w[-4:-3] not in ("s", "t")):
        return w
    return w[: -len(s)] if measure(w[: -len(s)]) > 1 else w


def tidied(w: str) -> str:
    if w.endswith("e"):
        n = measure(w[:-1])
        if n > 1 or (n == 1 and not ends_short(w[:-1])):
            w = w[:-1]
    return w[:-1] if w.endswith("ll") and measure(w[:-1]) > 1 else w


def stem(word: str) -> str:
    """The stem of a lower-case word; words of one or two letters are their own."""
    if word in EXCEPTIONS or len(word) <= 2:
        return EXCEPTIONS.get(word, word)
    w = without_tense(singular(word))
    if w.endswith("y") and len(w) > 2 and shape(w[:-1]).endswith("c"):
        w = w[:-1] + "i"
    return tidied(dropped(shortened(derived(w))))


class Stems(dict):
    """Stems of the words asked for, each worked out once."""

    def __init__(self, longer_than: int):
        self.longer_than = longer_than

    def __missing__(self, word: str) -> str:
        self[word] = found = stem(word) if len(word) > self.longer_than else word
        return found


def stems(words: Column, longer_than: int = 3) -> Column:
    """The stems of arrays of lower-case words, those of ``longer_than`` letters or fewer unchanged; each distinct word of a batch is worked out once."""

    def run(lists: pd.Series) -> pd.Series:
        known = Stems(longer_than)
        return lists.map(lambda ws: None if ws is None else [known[w] for w in ws])

    return F.pandas_udf(run, "array<string>")(words)
