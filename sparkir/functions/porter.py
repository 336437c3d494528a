"""Porter's stemmer (An algorithm for suffix stripping, 1980) with the departures that common toolkits make by default:
words of one or two letters stay, -ies and -ied of short words become -ie, -y turns to -i after a consonant that is not
the first letter, -bli and -logi are suffixes, -alli and -fulli are stripped further, and a few words are exceptions."""

from __future__ import annotations

import re
from functools import lru_cache

# Words whose stems the rules would miss.
IRREGULAR = {
    "sky": "sky", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "news": "news", "innings": "inning", "inning": "inning",
    "outings": "outing", "outing": "outing", "cannings": "canning", "canning": "canning", "howe": "howe", "proceed": "proceed", "exceed": "exceed", "succeed": "succeed",
}
# The suffixes of steps 2 to 4 of the paper, with what replaces them.
STEP2 = dict(s.split(":") for s in "ational:ate tional:tion enci:ence anci:ance izer:ize bli:ble alli:al entli:ent eli:e ousli:ous ization:ize ation:ate ator:ate alism:al iveness:ive fulness:ful ousness:ous aliti:al iviti:ive biliti:ble fulli:ful".split())
STEP3 = dict(s.split(":") for s in "icate:ic ative: alize:al iciti:ic ical:ic ful: ness:".split())
STEP4 = "al ance ence er ic able ible ant ement ment ent ion ou ism ate iti ous ive ize".split()


def _shape(w: str) -> str:
    """v and c for each letter; a y is a vowel after a consonant."""
    out = ""
    for ch in w:
        out += "v" if ch in "aeiou" or (ch == "y" and out.endswith("c")) else "c"
    return out


def _measure(w: str) -> int:
    return len(re.findall("v+c+", _shape(w)))


def _double(w: str) -> bool:
    return len(w) > 1 and w[-1] == w[-2] and _shape(w)[-1] == "c"


def _short_end(w: str) -> bool:
    s = _shape(w)
    return (s[-3:] == "cvc" and w[-1] not in "wxy") or (len(w) == 2 and s == "vc")


def _longest(w: str, table) -> str | None:
    return next((s for s in sorted(table, key=len, reverse=True) if w.endswith(s)), None)


@lru_cache(1 << 17)
def stem(word: str) -> str:
    w = word.lower()
    if w in IRREGULAR:
        return IRREGULAR[w]
    if len(w) <= 2:
        return w
    # 1a: plurals
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith("ies"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    # 1b: -ed and -ing
    if w.endswith("ied"):
        w = w[:-1] if len(w) == 4 else w[:-2]
    elif w.endswith("eed"):
        w = w[:-1] if _measure(w[:-3]) > 0 else w
    else:
        base = next((w[: -len(s)] for s in ("ed", "ing") if w.endswith(s) and "v" in _shape(w[: -len(s)])), None)
        if base is not None:
            if base.endswith(("at", "bl", "iz")):
                w = base + "e"
            elif _double(base) and base[-1] not in "lsz":
                w = base[:-1]
            elif _measure(base) == 1 and _short_end(base):
                w = base + "e"
            else:
                w = base
    # 1c
    if w.endswith("y") and len(w) > 2 and _shape(w[:-1])[-1] == "c":
        w = w[:-1] + "i"
    # 2
    s = _longest(w, STEP2)
    if w.endswith("alli") and _measure(w[:-4]) > 0:
        w = w[:-4] + "al"
        s = _longest(w, STEP2)
    if s:
        if _measure(w[: -len(s)]) > 0:
            w = w[: -len(s)] + STEP2[s]
    elif w.endswith("logi") and _measure(w[:-3]) > 0:
        w = w[:-1]
    # 3
    s = _longest(w, STEP3)
    if s and _measure(w[: -len(s)]) > 0:
        w = w[: -len(s)] + STEP3[s]
    # 4
    s = _longest(w, STEP4)
    if s and _measure(w[: -len(s)]) > 1 and (s != "ion" or w[: -len(s)].endswith(("s", "t"))):
        w = w[: -len(s)]
    # 5
    if w.endswith("e"):
        base = w[:-1]
        if _measure(base) > 1 or (_measure(base) == 1 and not _short_end(base)):
            w = base
    if w.endswith("ll") and _measure(w[:-1]) > 1:
        w = w[:-1]
    return w
