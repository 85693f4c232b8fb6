"""Snowball stemmers as published, as an Arrow-batched column function.

English, Danish, Norwegian, Swedish and Dutch are built; ``SUPPORTED`` names them. Stem a dictionary's terms rather than texts
where possible: a term is stemmed once then.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that share the English stem "and".
FAMILY = ("and", "ands", "anded", "anding", "andedly", "andingly", "ande")

_V = "aeiouy"


def _after(word: str, vowels: str, start: int = 0) -> int:
    """Where the region begins that follows the first consonant after a vowel."""
    for i in range(start + 1, len(word)):
        if word[i] not in vowels and word[i - 1] in vowels:
            return i + 1
    return len(word)


# ---- English
_EXCEPTIONS = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl"} | {w: w for w in ("sky", "news", "howe", "atlas", "cosmos", "bias", "andes")}
_STOP_AFTER_1A = {"inning", "outing", "canning", "herring", "earring", "proceed", "exceed", "succeed"}
_STEP2 = [("ization", "ize"), ("ational", "ate"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble"), ("ogi", "og"), ("li", "")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ative", ""), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = ("ement", "ance", "ence", "able", "ible", "ment", "ant", "ent", "ism", "ate", "iti", "ous", "ive", "ize", "ion", "al", "er", "ic")


def _short_end(w: str) -> bool:
    """A short syllable at the end: consonant, vowel, consonant but w, x, Y; or a vowel and a consonant alone."""
    if len(w) == 2:
        return w[0] in _V and w[1] not in _V
    return len(w) > 2 and w[-1] not in _V and w[-1] not in "wxY" and w[-2] in _V and w[-3] not in _V


def _english(word: str) -> str:
    if len(word) <= 2:
        return word
    if word in _EXCEPTIONS:
        return _EXCEPTIONS[word]
    w = word[1:] if word[0] == "'" else word
    w = re.sub(r"^y|(?<=[aeiouy])y", "Y", w)
    prefix = re.match(r"gener|commun|arsen", w)
    r1 = prefix.end() if prefix else _after(w, _V)
    r2 = _after(w, _V, r1)
    w = re.sub(r"'s'$|'s$|'$", "", w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and re.search(r"[aeiouy]", w[:-2]):
        w = w[:-1]
    if w in _STOP_AFTER_1A:
        return w
    m = re.search(r"(eedly|eed)$", w)
    if m:
        if m.start() >= r1:
            w = w[: m.start()] + "ee"
    else:
        m = re.search(r"(ingly|edly|ing|ed)$", w)
        if m and re.search(r"[aeiouy]", w[: m.start()]):
            w = w[: m.start()]
            if w.endswith(("at", "bl", "iz")):
                w += "e"
            elif re.search(r"(bb|dd|ff|gg|mm|nn|pp|rr|tt)$", w):
                w = w[:-1]
            elif _short_end(w) and r1 >= len(w):
                w += "e"
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _V:
        w = w[:-1] + "i"
    for suffix, to in _STEP2:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ogi" or w[at - 1 : at] == "l") and (suffix != "li" or w[at - 1 : at] in tuple("cdeghkmnrt")):
                w = w[:at] + to
            break
    for suffix, to in _STEP3:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r1 and (suffix != "ative" or at >= r2):
                w = w[:at] + to
            break
    for suffix in _STEP4:
        if w.endswith(suffix):
            at = len(w) - len(suffix)
            if at >= r2 and (suffix != "ion" or w[at - 1 : at] in ("s", "t")):
                w = w[:at]
            break
    if w.endswith("e") and (len(w) - 1 >= r2 or len(w) - 1 >= r1 and not _short_end(w[:-1])) or w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


# ---- Danish, Norwegian, Swedish: one region, endings, consonant pairs
def _nordic(word: str, vowels: str, endings: str, s_ending: str) -> tuple[str, int]:
    """After the first step, and where the region begins."""
    r1 = max(3, _after(word, vowels))
    for e in sorted(endings.split(), key=len, reverse=True):
        if word.endswith(e) and len(word) - len(e) >= r1:
            return word[: -len(e)], r1
    if word.endswith("s") and len(word) - 1 >= r1 and re.search(f"(?:{s_ending})$", word[:-1]):
        return word[:-1], r1
    return word, r1


def _ends_in(word: str, pairs: str, r1: int) -> bool:
    return any(word.endswith(p) and len(word) - len(p) >= r1 for p in pairs.split())


def _danish(word: str) -> str:
    w, r1 = _nordic(word, "aeiouyæåø", "hed ethed ered e erede ende erende ene erne ere en heden eren er heder erer heds es endes erendes enes ernes eres ens hedens erens ers ets erets et eret", "[abcdfghjklmnoprtvyzå]")
    if _ends_in(w, "gd dt gt kt", r1):
        w = w[:-1]
    if w.endswith("igst"):
        w = w[:-2]
    if _ends_in(w, "løst", r1):
        w = w[:-1]
    else:
        for e in ("elig", "els", "lig", "ig"):
            if _ends_in(w, e, r1):
                w = w[: -len(e)]
                if _ends_in(w, "gd dt gt kt", r1):
                    w = w[:-1]
                break
    if len(w) >= 2 and w[-1] == w[-2] and w[-1] not in "aeiouyæåø" and len(w) - 2 >= r1:
        w = w[:-1]
    return w


def _norwegian(word: str) -> str:
    r1 = max(3, _after(word, "aeiouyæåø"))
    for e in ("erte", "ert"):
        if word.endswith(e) and len(word) - len(e) >= r1:
            word, w = "", word[: -len(e)] + "er"
            break
    else:
        w, r1 = _nordic(word, "aeiouyæåø", "a e ede ande ende ane ene hetene en heten ar er heter as es edes endes enes hetenes ens hetens ers ets et het ast", "[bcdfghjlmnoprtvyz]|[^aeiouyæåø]k")
    if _ends_in(w, "dt vt", r1):
        w = w[:-1]
    for e in ("hetslov", "elegg", "elov", "slov", "leg", "eig", "lig", "els", "lov", "ig"):
        if _ends_in(w, e, r1):
            return w[: -len(e)]
    return w


def _swedish(word: str) -> str:
    w, r1 = _nordic(word, "aeiouyäåö", "a arna erna heterna orna ad e ade ande arne are aste en anden aren heten ern ar er heter or as arnas ernas ornas es ades andes ens arens hetens erns at andet het ast", "[bcdfghjklmnoprtvy]")
    if _ends_in(w, "dd gd nn dt gt kt tt", r1):
        w = w[:-1]
    for e, to in (("fullt", "full"), ("löst", "lös"), ("lig", ""), ("els", ""), ("ig", "")):
        if _ends_in(w, e, r1):
            return w[: -len(e)] + to
    return w


# ---- Dutch (the Porter variant)
def _dutch(word: str) -> str:
    vowels = "aeiouyè"
    w = word.translate(str.maketrans("äëïöüáéíóú", "aeiouaeiou"))
    w = re.sub(r"^y|(?<=[aeiouyè])y", "Y", w)
    w = re.sub(r"(?<=[aeiouyè])i(?=[aeiouyè])", "I", w)
    r1 = max(3, _after(w, vowels))
    r2 = _after(w, vowels, _after(w, vowels))

    def undouble(x: str) -> str:
        return x[:-1] if x.endswith(("kk", "dd", "tt")) else x

    def en_ending(x: str, suffix: str) -> str:
        stem = x[: -len(suffix)]
        return undouble(stem) if len(stem) >= r1 and stem and stem[-1] not in vowels and not stem.endswith("gem") else x

    e_found = False
    if w.endswith("heden"):
        if len(w) - 5 >= r1:
            w = w[:-5] + "heid"
    elif w.endswith(("ene", "en")):
        w = en_ending(w, "ene" if w.endswith("ene") else "en")
    elif w.endswith(("se", "s")):
        at = len(w) - (2 if w.endswith("se") else 1)
        if at >= r1 and at and w[at - 1] not in vowels + "j":
            w = w[:at]
    if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in vowels:
        w, e_found = undouble(w[:-1]), True
    if w.endswith("heid") and len(w) - 4 >= r2 and w[-5] != "c":
        w = w[:-4]
        if w.endswith("en"):
            w = en_ending(w, "en")
    for e in ("lijk", "baar", "end", "ing", "bar", "ig"):
        if w.endswith(e):
            if len(w) - len(e) >= r2:
                if e in ("end", "ing"):
                    w = w[: -len(e)]
                    w = w[:-2] if w.endswith("ig") and len(w) - 2 >= r2 and w[-3:-2] != "e" else undouble(w)
                elif e == "ig":
                    w = w[:-2] if w[-3:-2] != "e" else w
                elif e == "lijk":
                    w = w[:-4]
                    if w.endswith("e") and len(w) - 1 >= r1 and w[-2] not in vowels:
                        w = undouble(w[:-1])
                elif e == "baar" or e_found:
                    w = w[: -len(e)]
            break
    if re.search(r"[^aeiouyèI](?:aa|ee|oo|uu)[^aeiouyèI]$", w):
        w = w[:-2] + w[-1]
    return w.lower()


SUPPORTED = {"english": _english, "danish": _danish, "norwegian": _norwegian, "swedish": _swedish, "dutch": _dutch}


def stem_word(word: str, language: str = "english") -> str:
    """The stem of one lower-case word."""
    if language not in SUPPORTED:
        raise ValueError(f"no stemmer for {language!r}; there are {', '.join(SUPPORTED)}")
    return SUPPORTED[language](word)


def stem(term: Column, language: str = "english") -> Column:
    """The stems of a column of lower-case terms."""
    stem_word("", language)

    @F.pandas_udf("string")
    def run(terms: pd.Series) -> pd.Series:
        one = SUPPORTED[language]
        known = {t: one(t) for t in terms.dropna().unique()}
        return terms.map(known)

    return run(term)


def stop_words(language: str) -> tuple[str, ...]:
    """Spark's own list of a language's stop words (those of ``StopWordsRemover``)."""
    from pyspark.ml.feature import StopWordsRemover

    return tuple(StopWordsRemover.loadDefaultStopWords(language))
