"""Text functions as Column expressions, and the analyser: normalise, tokenise, drop stopwords, stem."""

from __future__ import annotations

import unicodedata

import pandas as pd
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.stemmer import stem
from tessera.plans.config import AnalyzerConfig

# fixed values: the stopwords. Those with an apostrophe never match, as normalising turns it into a space.
STOPWORDS = """
a about above after again against all am an and any are aren't as at be because been before being below between both but by
can can't cannot could couldn't did didn't do does doesn't doing don't down during each few for from further had hadn't has
hasn't have haven't having he he'd he'll he's her here here's hers herself him himself his how how's i i'd i'll i'm i've if in
into is isn't it it's its itself just me more most mustn't my myself of off on once only or other ought our ours ourselves out
over own same shan't she she'd she'll she's should shouldn't so some such than that that's the their theirs them themselves
then there there's these they they'd they'll they're they've this those through to too under until up very was wasn't we we'd
we'll we're we've were weren't what what's when when's where where's which while who who's whom why why's with won't would
wouldn't you you'd you'll you're you've your yours yourself yourselves also may might must shall will can could amongst upon
within without
""".split()
# fixed values: words that turn a statement around
NEGATORS = "not no nor neither never none without against".split()
# fixed values: words that finance texts need
FINANCE_KEEP = "up down over under above below own will out against".split()


def _bases() -> tuple[str, str]:
    """Lower-case letters whose compatibility decomposition is one letter and marks, and that letter; then the marks, to drop."""
    pairs = []
    for c in map(chr, range(0xA0, 0xFFFF)):
        bare = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x)).casefold()
        if c == c.lower() and len(bare) == 1 and bare != c and bare.isalnum() and not 0xD800 <= ord(c) < 0xE000:
            pairs.append((c, bare))
    return "".join(a for a, _ in pairs) + "".join(map(chr, range(0x300, 0x370))), "".join(b for _, b in pairs)


ACCENTED, PLAIN = _bases()
#: Lower-case letters that fold to several.
SEVERAL = (("ß", "ss"), ("ﬃ", "ffi"), ("ﬄ", "ffl"), ("ﬀ", "ff"), ("ﬁ", "fi"), ("ﬂ", "fl"))
_TABLE = str.maketrans(dict(zip(ACCENTED, PLAIN.ljust(len(ACCENTED), "\0"), strict=True))) | {ord(c): None for c in ACCENTED[len(PLAIN) :]}
# fixed values: the formats of finance tokens
FINANCE_NUMBER, FINANCE_TICKER = r"^\$?[0-9][0-9,.]*[BMKbmk%]?$", r"^\$?[A-Za-z]{1,5}$"
FINANCE_PERIOD, FINANCE_FILING = "^([Qq][1-4]|[Ff][Yy][0-9]{2,4}|[Hh]1|[Hh]2)$", "^[0-9]{1,2}-[KkQq]$"
NUMERIC_CLAIM = r"^\$?[0-9][0-9,.]*[BMKmM%]?$"
SENTENCE_BREAK = r"(?<=[.!?])\s+(?=[A-Z0-9(])"
#: What is between words, without and with finance mode.
KEPT = (r"[^\p{L}\p{N}_]+", r"[^\p{L}\p{N}_$%/-]+")
BLANKS = " \t\n\x0b\x0c\r"


def fold(text: Column) -> Column:
    """Case, accents and compatibility forms folded, for all letters that fold to one letter and for SEVERAL."""
    out = F.lower(F.coalesce(text, F.lit("")))
    for letter, letters in SEVERAL:
        out = F.replace(out, F.lit(letter), F.lit(letters))
    return F.translate(out, ACCENTED, PLAIN)


def normalize(text: Column, finance: bool = False) -> Column:
    """Folded words of letters, digits and underscores ($ % - / too in finance mode) with single spaces between."""
    return F.trim(F.regexp_replace(fold(text), KEPT[finance], " "))


def _dropped(config: AnalyzerConfig) -> list[str]:
    return sorted(set(STOPWORDS) - set(NEGATORS if config.keep_negators else ()) - set(FINANCE_KEEP if config.finance_mode else ())) if config.remove_stopwords else []


def analyze_text(text: str | None, config: AnalyzerConfig = AnalyzerConfig()) -> list[str]:
    """The analysed terms of one short text, on the driver: what analyze gives for its row."""
    folded = (text or "").lower()
    for letter, letters in SEVERAL:
        folded = folded.replace(letter, letters)
    dropped = set(_dropped(config))
    words = [t for t in regex.sub(KEPT[config.finance_mode], " ", folded.translate(_TABLE)).split(" ") if t and t not in dropped]
    known = stems_of(config.finance_mode)
    return [known[t] for t in words] if config.stemming else words


def _finance_words() -> regex.Pattern:
    """What finance mode never stems."""
    return regex.compile("|".join(f"(?:{p})" for p in (FINANCE_NUMBER, FINANCE_TICKER, FINANCE_PERIOD, FINANCE_FILING, r"^\$", "[0-9]")))


def tokens(text: Column, config: AnalyzerConfig = AnalyzerConfig()) -> Column:
    """The unstemmed tokens, stopwords dropped as configured."""
    dropped = _dropped(config)
    words = F.split(normalize(text, config.finance_mode), " ")
    return F.filter(words, lambda t: (t != "") & ~t.isin(dropped) if dropped else t != "")


def is_finance_token(token: Column) -> Column:
    return token.rlike(FINANCE_NUMBER) | token.rlike(FINANCE_TICKER) | token.rlike(FINANCE_PERIOD) | token.rlike(FINANCE_FILING)


class _Stems(dict):
    """The stems of the words a worker has seen, up to a bound."""

    def __init__(self, finance: bool):
        self.kept = _finance_words() if finance else None

    def __missing__(self, word: str) -> str:
        if len(self) > 500_000:
            self.clear()
        self[word] = out = word if self.kept and self.kept.search(word) else stem(word)
        return out


_stems: dict[bool, _Stems] = {}


def stems_of(finance: bool) -> _Stems:
    if finance not in _stems:
        _stems[finance] = _Stems(finance)
    return _stems[finance]


def _stem_arrays(finance: bool):
    @F.pandas_udf("array<string>")
    def run(words: pd.Series) -> pd.Series:
        known = stems_of(finance)
        return words.map(lambda ws: [known[w] for w in ws], na_action="ignore")

    return run


def analyze(rows: DataFrame, keys: list[str], text: str, config: AnalyzerConfig = AnalyzerConfig()) -> DataFrame:
    """keys, pos, term: the analysed terms of each row's text. Nothing is shuffled: workers remember the stems of words."""
    words = tokens(F.col(text), config)
    cut = rows.select(*keys, (_stem_arrays(config.finance_mode)(words) if config.stemming else words).alias("_terms"))
    return cut.select(*keys, F.posexplode("_terms").alias("pos", "term"))


def sentences(text: Column) -> Column:
    """Cut at white space after . ! or ? and before a capital, a digit or a parenthesis."""
    parts = F.split(F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS)), SENTENCE_BREAK)
    return F.filter(F.transform(parts, lambda s: F.btrim(s, F.lit(BLANKS))), lambda s: s != "")


def query_words(text: Column) -> Column:
    """Distinct lower-case words of ASCII letters and digits over one character, sorted: for highlighting."""
    return F.array_sort(F.array_distinct(F.filter(F.transform(F.regexp_extract_all(text, F.lit("[A-Za-z0-9]+"), F.lit(0)), F.lower), lambda w: F.length(w) > 1)))


def highlight(text: Column, words: list[str], before: str = "<mark>", after: str = "</mark>") -> Column:
    """Whole words marked, longest first, whatever their case."""
    if not words:
        return text
    return F.regexp_replace(text, r"(?i)\b(" + "|".join(sorted(words, key=lambda w: (-len(w), w))) + r")\b", f"{before}$1{after}")


def excerpt(text: Column, words: Column, radius: int = 70) -> Column:
    """The text around the earliest of the words, with … where it was cut; its beginning if none occurs."""
    hits = F.filter(F.transform(words, lambda w: F.instr(F.lower(text), w)), lambda p: p > 0)
    at = F.coalesce(F.array_min(hits) - 1, F.lit(0))
    begin, end = F.greatest(F.lit(0), at - radius), F.least(F.length(text), at + radius)
    return F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), F.trim(F.substring(text, begin + 1, end - begin)), F.when(end < F.length(text), F.lit("…")).otherwise(F.lit("")))


def escaped(text: Column) -> Column:
    """Text as it may stand in a page."""
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def snippet(text: Column, words: list[str], length: int = 240, before: int = 60) -> Column:
    """A piece of a text for a page, words marked: it begins a little before the first of the words that occurs, the words tried in
    their order; … stands where more follows or went before. A text that is short enough stays whole."""
    at = F.get(F.filter(F.array(*[F.instr(F.lower(text), F.lit(w)) for w in words]).cast("array<int>"), lambda p: p > 0), F.lit(0)) - 1
    begin = F.greatest(F.lit(0), F.coalesce(at, F.lit(0)) - before)
    marked = lambda t: highlight(escaped(t), words, '<mark class="hit">')
    cut = F.concat(F.when(begin > 0, F.lit("…")).otherwise(F.lit("")), marked(F.substring(text, begin + 1, F.lit(length))), F.lit("…"))
    return F.when(F.length(text) <= length, marked(text)).otherwise(cut)


def citations(text: Column, n_sources: int | Column) -> Column:
    """The source numbers [n] of a sentence that exist, or the first source."""
    found = F.filter(F.transform(F.regexp_extract_all(text, F.lit(r"\[(\d+)\]"), F.lit(1)), lambda x: F.substring(x, 1, 18).cast("bigint")), lambda n: (n >= 1) & (n <= n_sources))
    return F.when(F.size(found) == 0, F.array(F.lit(1).cast("bigint"))).otherwise(found)


def without_citations(text: Column) -> Column:
    return F.btrim(F.regexp_replace(text, r"\s*\[\d+\]", ""), F.lit(BLANKS))
