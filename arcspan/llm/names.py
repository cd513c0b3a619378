"""Names of places cut into cores, which are compared, and additions that tell sister places apart."""

from __future__ import annotations

import re
import unicodedata
from functools import lru_cache

#: fixed values: additions to a name, each with the form in which it is compared
_DIRECTIONS = {"north": "n", "nord": "n", "norte": "n", "northern": "n", "south": "s", "sud": "s", "sur": "s", "süd": "s", "southern": "s", "east": "e", "est": "e", "este": "e", "ost": "e", "eastern": "e", "west": "w", "ouest": "w", "oeste": "w", "ovest": "w", "western": "w", "e": "e", "n": "n", "s": "s", "w": "w"}
_LEVELS = {"upper": "up", "lower": "low", "superior": "up", "inferior": "low", "inférieur": "low", "supérieur": "up", "unter": "low", "upr": "up", "lwr": "low", "up": "up", "low": "low"}
_ROMAN = {"i": "1", "ii": "2", "iii": "3", "iv": "4", "v": "5", "vi": "6", "vii": "7", "viii": "8"}
#: articles, prepositions and words for numbers, which say nothing
_EMPTY = frozenset("de la le les du des of the el los las al di da del della von am an der das die no nr num nos st saint san santa sankt ste sainte".split())

_SOUNDS = (("sch", "s"), ("skh", "sk"), ("tch", "c"), ("ph", "f"), ("qu", "k"), ("ck", "k"), ("kh", "k"), ("ch", "k"), ("sh", "s"), ("th", "t"), ("gh", "g"), ("q", "k"), ("c", "k"), ("z", "s"), ("w", "v"), ("y", "i"), ("j", "i"), ("ou", "u"), ("oo", "u"), ("ie", "i"), ("ei", "i"), ("ai", "e"), ("ae", "a"), ("oe", "o"), ("ue", "u"))


def plain(text: str) -> str:
    t = text.casefold().replace("ß", "ss").replace("ı", "i").replace("ø", "o").replace("ł", "l").replace("æ", "ae")
    t = "".join(ch for ch in unicodedata.normalize("NFKD", t) if not unicodedata.combining(ch))
    return re.sub(r"['’ʻʼ`´]", "", t)


def sound(core: str) -> str:
    """A spelling that is the same for usual variants of writing a sound."""
    for a, b in _SOUNDS:
        core = core.replace(a, b)
    return re.sub(r"(.)\1+", r"\1", core)


_ADDITIONS = {plain(k): v for k, v in (_DIRECTIONS | _LEVELS | _ROMAN).items()}


def addition(token: str) -> str | None:
    if token in _ADDITIONS:
        return _ADDITIONS[token]
    if token.isdigit():
        return str(int(token)) if len(token) < 6 else None
    return f"#{token}" if token in ("a", "b", "c", "d") else None


def tokens(name: str) -> list[str]:
    """Words of letters and digits, umlauts as single vowels however they are written."""
    return [w.replace("ae", "a").replace("oe", "o").replace("ue", "u") for w in re.findall(r"[a-z0-9]+", plain(name))]


def bare(word: str, generic: frozenset[str], longest: int) -> str:
    """The word without a generic word, of which none is longer than given, that is written together with it."""
    for n in range(4, min(len(word) - 2, longest + 1)):
        if word[:n] in generic:
            word = word[n:]
            break
    for n in range(4, min(len(word) - 2, longest + 1)):
        if word[-n:] in generic:
            return word[:-n]
    return word


@lru_cache(8)
def _longest(generic: frozenset[str]) -> int:
    return max(map(len, generic), default=0)


def parts(name: str | None, generic: frozenset[str]) -> tuple[list[str], list[str], str]:
    """The cores of a name's aliases as written and by sound, and its additions, sorted and joined.

    generic: words so common among names that they tell little; they are left out unless nothing else is there.
    """
    if not name or not name.strip():
        return [], [], ""
    cores: list[str] = []
    found: set[str] = set()
    fallback: list[str] = []
    for alias in re.split(r"[/=\[\](){};|]|\s+(?:or|ou|oder|alias|aka)\s+", name):
        kept = []
        for w in tokens(alias):
            if (add := addition(w)) is not None:
                found.add(add)
            elif w not in _EMPTY and len(w) > 1:
                fallback.append(w)
                if w not in generic:
                    kept.append(w)
        for core in ("".join(kept), "".join(bare(w, generic, _longest(generic)) for w in kept)) if kept else ():
            if core not in cores:
                cores.append(core)
    if not cores and fallback:
        cores.append("".join(fallback))
    return cores, [sound(c) for c in cores], " ".join(sorted(found))
