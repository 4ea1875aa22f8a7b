"""The Porter stemmer, from its published description (Porter, 1980)."""

from __future__ import annotations

import re

_CONS, _VOW = "[^aeiou]", "[aeiouy]"
_C, _V = f"{_CONS}[^aeiouy]*", f"{_VOW}[aeiou]*"
_M1 = re.compile(f"^({_C})?{_V}{_C}")
_M1_ONLY = re.compile(f"^({_C})?{_V}{_C}({_V})?$")
_M2 = re.compile(f"^({_C})?{_V}{_C}{_V}{_C}")
_HAS_VOWEL = re.compile(f"^({_C})?{_VOW}")
_CVC = re.compile(f"^{_C}{_VOW}[^aeiouwxy]$")

# The suffix tables of steps 2, 3 and 4.
STEP2 = (("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("bli", "ble"),
         ("alli", "al"), ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"),
         ("ator", "ate"), ("alism", "al"), ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"),
         ("iviti", "ive"), ("biliti", "ble"), ("logi", "log"))
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


def _swap(w: str, table) -> str:
    for suffix, new in sorted(table, key=lambda x: -len(x[0])):
        if w.endswith(suffix):
            stem = w[: len(w) - len(suffix)]
            return stem + new if _M1.match(stem) else w
    return w


def porter(word: str) -> str:
    w = word
    if len(w) < 3:
        return w
    y = w[0] == "y"
    if y:
        w = "Y" + w[1:]
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _M1.match(w[:-3]) else w
    else:
        for suffix in ("ed", "ing"):
            if w.endswith(suffix) and _HAS_VOWEL.match(w[: -len(suffix)]):
                w = w[: -len(suffix)]
                if w.endswith(("at", "bl", "iz")):
                    w += "e"
                elif re.search(r"([^aeiouylsz])\1$", w):
                    w = w[:-1]
                elif _CVC.match(w):
                    w += "e"
                break
    if w.endswith("y") and _HAS_VOWEL.match(w[:-1]):
        w = w[:-1] + "i"
    w = _swap(_swap(w, STEP2), STEP3)
    for suffix in sorted(STEP4 + ("sion", "tion"), key=lambda x: -len(x)):
        if w.endswith(suffix):
            stem = w[: len(w) - (3 if suffix in ("sion", "tion") else len(suffix))]
            w = stem if _M2.match(stem) else w
            break
    if w.endswith("e"):
        stem = w[:-1]
        if _M2.match(stem) or (_M1.match(stem) and not (_M1_ONLY.match(stem) and _CVC.match(stem))):
            w = stem
    if w.endswith("ll") and _M2.match(w):
        w = w[:-1]
    return "y" + w[1:] if y else w
