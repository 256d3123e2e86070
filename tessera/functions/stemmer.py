"""The Porter stemmer: the 1980 rules, without the customary exception for words of one or two letters.

`stem` works by regular expressions on the word with its consonant y's written Y; `stem_column` applies it to Arrow batches
and is meant for columns of distinct words. `Rules` states the same steps as SQL text, one CASE each, for checking against
other engines: over a thousand references to its word make it far slower to plan in Spark than the batches are to run.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

# fixed values: the suffix tables of the algorithm, in the order they are tried
STEP2 = (
    ("ational", "ate"), ("tional", "tion"), ("enci", "ence"), ("anci", "ance"), ("izer", "ize"), ("abli", "able"), ("alli", "al"),
    ("entli", "ent"), ("eli", "e"), ("ousli", "ous"), ("ization", "ize"), ("ation", "ate"), ("ator", "ate"), ("alism", "al"),
    ("iveness", "ive"), ("fulness", "ful"), ("ousness", "ous"), ("aliti", "al"), ("iviti", "ive"), ("biliti", "ble"),
)
STEP3 = (("icate", "ic"), ("ative", ""), ("alize", "al"), ("iciti", "ic"), ("ical", "ic"), ("ful", ""), ("ness", ""))
STEP4 = ("al", "ance", "ence", "er", "ic", "able", "ible", "ant", "ement", "ment", "ent", "ou", "ism", "ate", "iti", "ous", "ive", "ize")


_M1, _M2 = re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]"), re.compile("[^aeiouy]*[aeiouy]+[^aeiouy]+[aeiouy]+[^aeiouy]")
_VOWEL, _CVC, _CONSONANT = re.compile("[aeiouy]"), re.compile("[^aeiouy][aeiouy][^aeiouywxY]$"), re.compile("[^aeiouy]$")


def marked(word: str) -> str:
    """word with its consonant y's written Y: at the start, and wherever a vowel comes before."""
    out, vowel = [], False
    for i, c in enumerate(word):
        c = "Y" if c == "y" and (i == 0 or vowel) else c
        vowel = c in "aeiouy"
        out.append(c)
    return "".join(out)


def _over(stem_: str, n: int) -> bool:
    return bool((_M2 if n else _M1).match(marked(stem_)))


def _cvc(stem_: str) -> bool:
    return bool(_CVC.search(marked(stem_)))


def _tidied(s: str) -> str:
    if s.endswith(("at", "bl", "iz")):
        return s + "e"
    if len(s) > 1 and s[-1] == s[-2] and s[-1] not in "lsz" and _CONSONANT.search(marked(s)):
        return s[:-1]
    return s + "e" if _over(s, 0) and not _over(s, 1) and _cvc(s) else s


def _by_table(w: str, table, n: int) -> str:
    """The first suffix that the word ends in decides, even where its stem is too short."""
    for suffix, put in table:
        if w.endswith(suffix):
            s = w[: len(w) - len(suffix)]
            return s + put if _over(s, n) else w
    return w


def stem(w: str) -> str:
    if w.endswith(("sses", "ies")):
        w = w[:-2]
    elif w.endswith("s") and not w.endswith("ss"):
        w = w[:-1]
    if w.endswith("eed"):
        w = w[:-1] if _over(w[:-3], 0) else w
    elif found := next((x for x in ("ed", "ing") if w.endswith(x)), None):
        s = w[: -len(found)]
        w = _tidied(s) if _VOWEL.search(marked(s)) else w
    if w.endswith("y") and _VOWEL.search(marked(w[:-1])):
        w = w[:-1] + "i"
    w = _by_table(_by_table(w, STEP2, 0), STEP3, 0)
    if w.endswith("ion"):
        w = w[:-3] if w.endswith(("sion", "tion")) and _over(w[:-3], 1) else w
    else:
        w = _by_table(w, [(x, "") for x in STEP4], 1)
    if w.endswith("e"):
        if _over(w[:-1], 1) or (_over(w[:-1], 0) and not _cvc(w[:-1])):
            return w[:-1]
    elif w.endswith("ll") and _over(w[:-1], 1):
        return w[:-1]
    return w


@F.pandas_udf(StringType())
def stem_column(words: pd.Series) -> pd.Series:
    return words.map(stem, na_action="ignore")


@dataclass(frozen=True)
class Dialect:
    matches: str
    group: str
    everywhere: str


DUCKDB = Dialect("regexp_matches", r"\1", ", 'g'")


class Rules:
    def __init__(self, dialect: Dialect):
        self.d = dialect

    def marked(self, s: str) -> str:
        """s with its consonant y's written Y: at the start, after a vowel, or after another y."""
        for pattern, put in (("^y", "Y"), ("([aeiou])y", f"{self.d.group}Y"), ("yy", "yY")):
            s = f"regexp_replace({s}, '{pattern}', '{put}'{self.d.everywhere})"
        return s

    def has(self, s: str, pattern: str) -> str:
        return f"{self.d.matches}({self.marked(s)}, '{pattern}')"

    def m_over(self, s: str, n: int) -> str:
        """More than n vowel-consonant sequences."""
        return self.has(s, "^[^aeiouy]*" + "[aeiouy]+[^aeiouy]+" * n + "[aeiouy]+[^aeiouy]")

    def vowel(self, s: str) -> str:
        return self.has(s, "[aeiouy]")

    def cvc(self, s: str) -> str:
        return self.has(s, "[^aeiouy][aeiouy][^aeiouywxY]$")

    @staticmethod
    def cut(w: str, n: int) -> str:
        return f"substring({w}, 1, length({w}) - {n})"

    def steps(self, w: str) -> list[str]:
        """Each step as an expression over the word column w."""
        ends = lambda x: f"{w} LIKE '%{x}'"
        first = f"CASE WHEN {ends('sses')} OR {ends('ies')} THEN {self.cut(w, 2)} WHEN {ends('ss')} THEN {w} WHEN {ends('s')} THEN {self.cut(w, 1)} ELSE {w} END"

        def tidy(s: str) -> str:
            double = f"(length({s}) >= 2 AND right({s}, 1) = left(right({s}, 2), 1) AND {self.has(s, '[^aeiouy]$')} AND right({s}, 1) NOT IN ('l', 's', 'z'))"
            short = f"({self.m_over(s, 0)} AND NOT {self.m_over(s, 1)} AND {self.cvc(s)})"
            return f"CASE WHEN {s} LIKE '%at' OR {s} LIKE '%bl' OR {s} LIKE '%iz' THEN concat({s}, 'e') WHEN {double} THEN {self.cut(s, 1)} WHEN {short} THEN concat({s}, 'e') ELSE {s} END"

        past = "CASE " + f"WHEN {ends('eed')} THEN CASE WHEN {self.m_over(self.cut(w, 3), 0)} THEN {self.cut(w, 1)} ELSE {w} END "
        for suffix in ("ed", "ing"):
            s = self.cut(w, len(suffix))
            past += f"WHEN {ends(suffix)} THEN CASE WHEN {self.vowel(s)} THEN {tidy(s)} ELSE {w} END "
        past += f"ELSE {w} END"
        y = f"CASE WHEN {ends('y')} AND {self.vowel(self.cut(w, 1))} THEN concat({self.cut(w, 1)}, 'i') ELSE {w} END"

        def table(pairs, n: int, before: str = "") -> str:
            rows = "".join(f"WHEN {ends(x)} THEN CASE WHEN {self.m_over(self.cut(w, len(x)), n)} THEN concat({self.cut(w, len(x))}, '{put}') ELSE {w} END " for x, put in pairs)
            return f"CASE {before}{rows}ELSE {w} END"

        ion = f"WHEN {ends('ion')} THEN CASE WHEN {self.m_over(self.cut(w, 3), 1)} AND ({ends('sion')} OR {ends('tion')}) THEN {self.cut(w, 3)} ELSE {w} END "
        e = self.cut(w, 1)
        last = f"CASE WHEN {ends('e')} AND ({self.m_over(e, 1)} OR ({self.m_over(e, 0)} AND NOT {self.cvc(e)})) THEN {e} WHEN {ends('ll')} AND {self.m_over(e, 1)} THEN {e} ELSE {w} END"
        return [first, past, y, table(STEP2, 0), table(STEP3, 0), table([(x, "") for x in STEP4], 1, ion), last]

    def query(self, source: str, word: str = "token") -> str:
        """SELECT word, stem over a table of words."""
        inner = f"(SELECT {word}, {word} AS w FROM {source})"
        for k, step in enumerate(self.steps("w")):
            inner = f"(SELECT {word}, {step} AS w FROM {inner} AS s{k})"
        return f"SELECT {word}, w AS stem FROM {inner} AS stems"
