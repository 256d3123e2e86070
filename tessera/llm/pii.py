"""Operator 5: format-preserving Feistel pseudonyms for personal data, in built-in expressions only.

Card numbers (Luhn-valid), phone numbers, IPv4 addresses, US social security numbers, IBANs (mod 97) and calendar dates
are recognised by format, validated, and put through a keyed Feistel permutation of their own format: digits stay digits,
separators stay where they were, a card still passes the Luhn test, a date is still a date. As the permutation is keyed
and has no state, equal values get equal pseudonyms in every document. Emails and secrets have no numeric format to
permute; their local part or body is replaced by a keyed digest of the same alphabet.

Cards are read after all else, in what no other value took. A stretch of digit groups may hold several cards, or a card
beside a quantity or an expiry, so every reading of a usual grouping in it is validated; failing all, the whole stretch.

Dates are read as year-month-day, day-month-year or, where that is no date, month-day-year, with -, / or . between; one day
in two formats gets one pseudonym in two formats. The key has no default: whoever has it can undo the permutation.

Defined cases: a null text stays null with counts of zero; texts without a hit are returned unchanged, byte for byte; values
and texts may be of any length; repeated rows get equal results; an empty table gives an empty table; other columns pass
through, but for those named like a count, which the counts replace. A value that fails its validation (a 16-digit number
with a wrong check digit, the 31st of February) is left alone. Nothing is shuffled.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.common import fresh, let, others, quoted

#: The session setting that holds the key of the registered query and of the pipeline (Spark redacts "secret" in its pages).
KEY = "spark.tessera.pii.secret"
_DAY = r"(?:0[1-9]|[12]\d|3[01]|[1-9])"
_YEAR = r"(?:18|19|20|21)\d\d"
_DATES = "|".join(rf"{_YEAR}{s}(?:0[1-9]|1[0-2]){s}(?:0[1-9]|[12]\d|3[01])|{_DAY}{s}{_DAY}{s}{_YEAR}" for s in ("-", "/", r"\."))
#: kind -> pattern. The alternatives are tried in this order, but for cards; none spans lines.
PATTERNS = {
    "email": r"(?<![\w.+-])[A-Za-z0-9_][\w.+-]*+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "secret": r"(?<![A-Za-z0-9_-])(?:(?:sk|pk|rk|ghp|gho|ghs|xox[abprs])(?:[_-]|(?=[A-Za-z0-9_-]*[0-9]))[A-Za-z0-9_-]{16,}+|AKIA[0-9A-Z]{12,}+(?![a-z]))"
    r"|(?<![0-9A-Za-z])(?=[0-9a-f]*[a-f])(?=[0-9a-f]*[0-9])[0-9a-f]{32,}+(?![0-9A-Za-z])|(?<![0-9A-Za-z])(?=[0-9A-F]*[A-F])(?=[0-9A-F]*[0-9])[0-9A-F]{32,}+(?![0-9A-Za-z])",
    "iban": r"(?<![0-9A-Za-z])[A-Z]{2}[0-9]{2}(?: ?[0-9A-Z]{4}){2,7}(?: ?[0-9A-Z]{1,3})?(?![0-9A-Za-z])",
    "date": rf"(?<![\d./-])(?:{_DATES})(?![\d./-]*\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-]*\d)",
    "ip": r"(?<![\d.])(?:25[0-5]|2[0-4]\d|1?\d?\d)(?:\.(?:25[0-5]|2[0-4]\d|1?\d?\d)){3}(?!\.?\d)",
    "phone": r"(?<![\w+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)[ .-]?)?\d{2,4}(?:[ .-]?\d{2,4}){1,4}(?!\d)|(?<![\w(])\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\w.-])\d{3}[-.]\d{3}[-.]\d{4}(?![\w-])",
    "card": r"(?<![\d.-])(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++)*+",
}
KINDS = tuple(PATTERNS)
OTHERS = tuple(k for k in KINDS if k != "card")
ANY = "|".join(f"(?:{PATTERNS[k]})" for k in OTHERS)
#: The groupings of card numbers, longer before shorter; each is looked for at every place.
GROUPINGS = (r"\d{13,19}", *(rf"\d{{{first}}}([ -])" + r"\2".join(rf"\d{{{n}}}" for n in rest) for first, *rest in ((4, 4, 4, 4, 3), (4, 4, 4, 4), (4, 4, 4, 1), (4, 6, 5), (4, 6, 4))))
#: Stands for the values already replaced while cards are read.
MARK = "\ue000"
#: A cheap test that every hit passes: an at sign, or four characters of digits and separators.
HINT = r"@|[0-9][0-9. ()-]{3}|[0-9a-f]{16}|AKIA|[A-Za-z0-9_-]{18}"
ROUNDS = 8


def _prf(key: str, kind: str, turn: Column, value: Column) -> Column:
    """52 bits of a keyed digest, as a long."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), turn.cast("string"), value.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long")


def _feistel(left: Column, right: Column, m_left: Column, m_right: Column, key: str, kind: str) -> Column:
    """struct(a, b): a keyed permutation of the pairs of residues modulo (m_left, m_right)."""
    begin = F.struct(left.cast("long").alias("a"), right.cast("long").alias("b"))

    def turn(s, i):
        a = F.when(i % 2 == 0, F.pmod(s["a"] + F.pmod(_prf(key, kind, i, s["b"]), m_left), m_left)).otherwise(s["a"])
        b = F.when(i % 2 == 1, F.pmod(s["b"] + F.pmod(_prf(key, kind, i, s["a"]), m_right), m_right)).otherwise(s["b"])
        return F.struct(a.cast("long").alias("a"), b.cast("long").alias("b"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), begin, turn)


def permuted_digits(digits: Column, key: str, kind: str) -> Column:
    """A keyed permutation of the digit strings of one length (2 to 34 digits)."""
    n = F.length(digits)
    half = F.floor(n / 2).cast("int")
    m = lambda k: F.rpad(F.lit("1"), (k + 1).cast("int"), F.lit("0")).cast("long")  # noqa: E731  ten to the power k
    done = _feistel(digits.substr(F.lit(1), half), digits.substr(half + 1, n), m(half), m(n - half), key, kind)
    return let(done, lambda s: F.concat(F.lpad(s["a"].cast("string"), half, F.lit("0")), F.lpad(s["b"].cast("string"), (n - half).cast("int"), F.lit("0"))))


def _only_digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def _luhn_sum(digits: Column) -> Column:
    """The Luhn sum, the last digit counting once."""
    each = F.split(F.reverse(digits), "")
    return F.aggregate(
        F.sequence(F.lit(1), F.length(digits)), F.lit(0),
        lambda t, i: t + let(F.element_at(each, i).cast("int"), lambda d: F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)),
    )


def _refill(shape: Column, digits: Column) -> Column:
    """shape with its digits replaced, in turn, by those of digits."""
    done = F.aggregate(
        F.split(shape, ""), F.struct(F.lit("").alias("out"), F.lit(1).alias("at")),
        lambda s, c: F.when(c.rlike("[0-9]"), F.struct(F.concat(s["out"], digits.substr(s["at"], F.lit(1))).alias("out"), (s["at"] + 1).alias("at"))).otherwise(F.struct(F.concat(s["out"], c).alias("out"), s["at"].alias("at"))),
    )
    return done["out"]


def _card(value: Column, key: str) -> Column:
    def body(digits):
        free = permuted_digits(digits.substr(F.lit(1), F.length(digits) - 1), key, "card")
        return let(free, lambda x: F.concat(x, F.pmod(10 - F.pmod(_luhn_sum(F.concat(x, F.lit("0"))), F.lit(10)), F.lit(10)).cast("string")))

    return let(_only_digits(value), lambda d: F.when((F.pmod(_luhn_sum(d), F.lit(10)) == 0) & ~d.rlike(r"^(\d)\1*$"), let(body(d), lambda x: _refill(value, x))))


def _cards(stretch: Column, key: str) -> Column:
    """struct(out, n): a stretch of digit groups with its cards replaced, and their number."""
    every = F.concat(*[F.regexp_extract_all(stretch, F.lit(rf"(?<!\d)(?=({g})(?!\d))"), F.lit(1)) for g in GROUPINGS])
    whole = F.when(F.length(_only_digits(stretch)).between(13, 19), F.array(stretch)).otherwise(F.array().cast("array<string>"))
    found = F.filter(F.transform(F.array_distinct(F.concat(every, whole)), lambda v: F.struct(v.alias("value"), _card(v, key).alias("put"))), lambda c: c["put"].isNotNull())

    def put(s, c):
        # a reading that overlaps an earlier one is no longer there
        once = F.regexp_replace(s["out"], F.concat(F.lit(r"(?<!\d)"), c["value"], F.lit(r"(?!\d)")), c["put"])
        return let(once, lambda x: F.struct(x.alias("out"), (s["n"] + F.when(x == s["out"], 0).otherwise(F.regexp_count(s["out"], F.concat(F.lit(r"(?<!\d)"), c["value"], F.lit(r"(?!\d)"))))).cast("int").alias("n")))

    return F.aggregate(found, F.struct(stretch.alias("out"), F.lit(0).alias("n")), put)


def _phone(value: Column, key: str) -> Column:
    """The country code stays; the national digits are permuted."""
    code = F.regexp_extract(value, r"^\+\d{1,3}(?=\D)", 0)
    rest = value.substr(F.length(code) + 1, F.length(value))
    return let(_only_digits(rest), lambda d: F.when(F.length(_only_digits(value)).between(7, 15), F.concat(code, _refill(rest, permuted_digits(d, key, "phone")))))


def _ip(value: Column, key: str) -> Column:
    part = lambda i: F.split(value, r"\.")[i].cast("long")
    done = _feistel(part(0) * 256 + part(1), part(2) * 256 + part(3), F.lit(65536), F.lit(65536), key, "ip")
    return let(done, lambda s: F.concat_ws(".", *[x.cast("string") for x in (F.floor(s["a"] / 256), s["a"] % 256, F.floor(s["b"] / 256), s["b"] % 256)]))


def _ssn(value: Column, key: str) -> Column:
    """Valid: area not 000, 666 or 900 up, group not 00, serial not 0000. Serials are permuted among the valid ones."""
    area, group, serial = (value.substr(a, n).cast("long") for a, n in ((1, 3), (5, 2), (8, 4)))
    index = area - 1 - F.when(area > 666, 1).otherwise(0)
    done = _feistel(index, (group - 1) * 9999 + serial - 1, F.lit(898), F.lit(99 * 9999), key, "ssn")

    def text(s):
        a = s["a"] + 1 + F.when(s["a"] + 1 >= 666, 1).otherwise(0)
        return F.concat_ws("-", F.lpad(a.cast("string"), 3, "0"), F.lpad((F.floor(s["b"] / 9999) + 1).cast("string"), 2, "0"), F.lpad((s["b"] % 9999 + 1).cast("string"), 4, "0"))

    return F.when(area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0), let(done, text))


def _date(value: Column, key: str) -> Column:
    """Days of 1800-2199, one whole cycle of the calendar: 146,097 = 189 * 773 days. A pseudonym keeps its value's format."""
    first = F.lit("1800-01-01").cast("date")

    def moved(day):
        return let(_feistel(F.floor(day / 773), day % 773, F.lit(189), F.lit(773), key, "date"), lambda s: F.date_add(first, (s["a"] * 773 + s["b"]).cast("int")))

    out = F.lit(None).cast("string")
    for sep in ("-", "/", "."):
        padded, short = F.length(value) == 10, F.length(value) < 10
        forms = [(padded, f"yyyy{sep}MM{sep}dd"), (padded, f"dd{sep}MM{sep}yyyy"), (padded, f"MM{sep}dd{sep}yyyy"), (short, f"d{sep}M{sep}yyyy"), (short, f"M{sep}d{sep}yyyy")]
        for fits, form in reversed(forms):
            day = F.when(fits & F.contains(value, F.lit(sep)), F.datediff(F.try_to_date(value, form), first))
            out = F.when(day.isNotNull(), F.date_format(moved(day), form)).otherwise(out)
    return out


def _mod97(value: Column) -> Column:
    return F.aggregate(F.split(value, ""), F.lit(0), lambda t, c: F.when(c == "", t).when(c.rlike("[0-9]"), (t * 10 + c.cast("int")) % 97).otherwise((t * 100 + F.ascii(c) - 55) % 97).cast("int"))


def _iban(value: Column, key: str) -> Column:
    """The country and the letters stay; the account digits are permuted and the check digits made anew."""
    def body(x):
        account = x.substr(F.lit(5), F.length(x))

        def checked(new):
            check = F.lpad((98 - _mod97(F.concat(new, x.substr(1, 2), F.lit("00")))).cast("string"), 2, "0")
            return F.concat(check, _only_digits(new))

        new = let(_only_digits(account), lambda d: F.when(F.length(d).between(6, 34), _refill(account, permuted_digits(d, key, "iban"))))
        return let(new, lambda n: F.when(n.isNotNull(), _refill(value, checked(n))))

    return let(F.replace(value, F.lit(" "), F.lit("")), lambda x: F.when(F.length(x).between(15, 34) & (_mod97(F.concat(x.substr(F.lit(5), F.length(x)), x.substr(1, 4))) == 1), body(x)))


def _email(value: Column, key: str) -> Column:
    return F.concat(F.lit("user"), F.substring(F.sha2(F.concat_ws("|", F.lit(key), F.lit("email"), F.lower(value)), 256), 1, 16), F.lit("@mail.invalid"))


def _secret(value: Column, key: str) -> Column:
    """As long as the value; beyond 128 characters the digest goes round."""
    digest = F.concat(*[F.sha2(F.concat_ws("|", F.lit(key), F.lit(f"secret{i}"), value), 256) for i in range(2)])
    return let(digest, lambda d: F.rpad(d, F.length(value), d))


def _kind(value: Column) -> Column:
    """The first kind whose pattern the whole hit has."""
    found = F.lit(None).cast("string")
    for kind in reversed(OTHERS):
        found = F.when(value.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(found)
    return found


def _replaced(value: Column, kind: Column, key: str) -> Column:
    """The pseudonym of a hit, null where its validation fails."""
    out = F.lit(None).cast("string")
    for name, f in (("phone", _phone), ("ip", _ip), ("ssn", _ssn), ("date", _date), ("iban", _iban), ("email", _email), ("secret", _secret)):
        out = F.when(kind == name, f(value, key)).otherwise(out)
    return out


def key_of(spark: SparkSession) -> str:
    """The session's key; where none is set, a random one for the life of the session, so nothing can be undone later."""
    found = spark.conf.get(KEY, None)
    if not found:
        found = secrets.token_hex(32)
        spark.conf.set(KEY, found)
    return found


def pseudonymise(docs: DataFrame, key: str, text: str = "text") -> DataFrame:
    """docs with text pseudonymised, and n_<kind> for each kind. key: the secret of the permutation."""
    if not key:
        raise ValueError("pseudonyms need a key")
    own = others(docs, *[f"n_{k}" for k in KINDS])
    hits, mark, left, cards = fresh(docs, "hits", "mark", "left", "cards")
    whole = F.col(quoted(text))
    none = F.array().cast("array<struct<value:string,kind:string,put:string>>")
    read = F.when(
        whole.rlike(HINT),
        F.transform(F.regexp_extract_all(whole, F.lit(ANY), F.lit(0)), lambda v: let(_kind(v), lambda k: F.struct(v.alias("value"), k.alias("kind"), _replaced(v, k, key).alias("put")))),
    ).otherwise(none)
    marked = F.when(F.contains(whole, F.lit(MARK)), F.concat(F.lit(MARK), F.sha2(whole, 256), F.lit(MARK))).otherwise(F.lit(MARK))
    found = docs.select(*own, F.coalesce(read, none).alias(hits), marked.alias(mark))

    def joined(whole, pattern, put):
        return F.array_join(F.zip_with(F.split(whole, pattern, -1), put, lambda gap, p: F.concat(gap, F.coalesce(p, F.lit("")))), "")

    # cards are read in the text that is left when the values replaced are taken out
    rest = F.when(F.size(hits) == 0, whole).otherwise(joined(whole, ANY, F.transform(hits, lambda h: F.when(h["put"].isNotNull(), F.col(mark)).otherwise(h["value"]))))
    found = found.select("*", rest.alias(left))
    none = F.array().cast("array<struct<out:string,n:int>>")
    read = F.when(F.col(left).rlike(PATTERNS["card"]), F.transform(F.regexp_extract_all(left, F.lit(PATTERNS["card"]), F.lit(0)), lambda v: _cards(v, key))).otherwise(none)
    found = found.select("*", F.coalesce(read, none).alias(cards))
    carded = F.when(F.size(cards) == 0, F.col(left)).otherwise(joined(F.col(left), PATTERNS["card"], F.transform(cards, lambda c: c["out"])))
    done = F.filter(F.transform(hits, lambda h: h["put"]), lambda p: p.isNotNull())
    new = F.when(F.size(done) == 0, carded).otherwise(joined(carded, F.col(mark), done))

    def count(kind):
        if kind == "card":
            return F.aggregate(cards, F.lit(0).cast("long"), lambda t, c: t + c["n"])
        return F.size(F.filter(hits, lambda h: (h["kind"] == kind) & h["put"].isNotNull())).cast("long")

    return found.select(*[new.alias(text) if c == quoted(text) else c for c in own], *[count(k).alias(f"n_{k}") for k in KINDS])


def op5_pii(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return pseudonymise(docs, key_of(spark))
