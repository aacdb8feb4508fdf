"""Porter's stemmer (1980), for lower-case ASCII words of more than two letters; others stay as they are.

A word's measure is the number of its changes from vowels to consonants. Each step is a list of
endings, of which the longest that fits is replaced if what stands before it is long enough.
"""

from __future__ import annotations

import re

# The endings of steps 2, 3 and 4 of the published algorithm, with what replaces them.
STEP2 = {
    "ational": "ate", "tional": "tion", "enci": "ence", "anci": "ance", "izer": "ize", "abli": "able", "alli": "al", "entli": "ent", "eli": "e", "ousli": "ous",
    "ization": "ize", "ation": "ate", "ator": "ate", "alism": "al", "iveness": "ive", "fulness": "ful", "ousness": "ous", "aliti": "al", "iviti": "ive", "biliti": "ble",
}
STEP3 = {"icate": "ic", "ative": "", "alize": "al", "iciti": "ic", "ical": "ic", "ful": "", "ness": ""}
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()

_WORD = re.compile("[a-z]{3,}")


def _kinds(word: str) -> str:
    """c and v for each letter: y is a vowel behind a consonant."""
    out = ""
    for letter in word:
        out += "v" if letter in "aeiou" or (letter == "y" and out.endswith("c")) else "c"
    return out


def measure(stem: str) -> int:
    return len(re.findall("v+c+", _kinds(stem)))


def _short(stem: str) -> bool:
    """Ends in consonant, vowel, consonant, the last not w, x or y."""
    return _kinds(stem).endswith("cvc") and stem[-1] not in "wxy"


def _double(word: str) -> bool:
    return len(word) > 1 and word[-1] == word[-2] and _kinds(word)[-1] == "c"


def _longest(word: str, endings) -> str | None:
    return max((e for e in endings if word.endswith(e)), key=len, default=None)


def _plural(word: str) -> str:
    if word.endswith(("sses", "ies")):
        return word[:-2]
    return word[:-1] if word.endswith("s") and not word.endswith("ss") else word


def _past(word: str) -> str:
    if word.endswith("eed"):
        return word[:-1] if measure(word[:-3]) > 0 else word
    for ending in ("ed", "ing"):
        stem = word.removesuffix(ending)
        if stem != word:
            if "v" not in _kinds(stem):
                return word
            if stem.endswith(("at", "bl", "iz")):
                return stem + "e"
            if _double(stem) and stem[-1] not in "lsz":
                return stem[:-1]
            return stem + "e" if measure(stem) == 1 and _short(stem) else stem
    return word


def stem(word: str) -> str:
    if not _WORD.fullmatch(word):
        return word
    word = _past(_plural(word))
    if word.endswith("y") and "v" in _kinds(word[:-1]):
        word = word[:-1] + "i"
    for endings in (STEP2, STEP3):
        ending = _longest(word, endings)
        if ending and measure(word.removesuffix(ending)) > 0:
            word = word.removesuffix(ending) + endings[ending]
    ending = _longest(word, STEP4)
    if ending:
        left = word.removesuffix(ending)
        if measure(left) > 1 and (ending != "ion" or left.endswith(("s", "t"))):
            word = left
    if word.endswith("e"):
        left = word[:-1]
        if measure(left) > 1 or (measure(left) == 1 and not _short(left)):
            word = left
    return word[:-1] if _double(word) and word.endswith("l") and measure(word) > 1 else word
