"""Plain-Python versions of what the operators compute, one text at a time."""

import datetime
import hashlib
import re
from collections import Counter

from tessera.llm import pii, quality

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SPACE = " \t\n\x0b\x0c\r"


# ---- pseudonyms ----


def prf(key, kind, turn, value):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{value}".encode()).hexdigest()[:13], 16)


def feistel(a, b, m, n, key, kind):
    for turn in range(8):
        if turn % 2 == 0:
            a = (a + prf(key, kind, turn, b) % m) % m
        else:
            b = (b + prf(key, kind, turn, a) % n) % n
    return a, b


def digits(d, key, kind):
    h = len(d) // 2
    a, b = feistel(int(d[:h] or 0), int(d[h:]), 10**h, 10 ** (len(d) - h), key, kind)
    return str(a).zfill(h) + str(b).zfill(len(d) - h)


def only(value):
    return re.sub("[^0-9]", "", value)


def refill(shape, new):
    turn = iter(new)
    return "".join(next(turn) if c in "0123456789" else c for c in shape)


def luhn(d):
    return sum(int(c) if i % 2 == 0 else int(c) * 2 - 9 * (int(c) > 4) for i, c in enumerate(reversed(d))) % 10


def card(value, key):
    d = only(value)
    if luhn(d) or len(set(d)) == 1:
        return None
    body = digits(d[:-1], key, "card")
    return refill(value, body + str(-luhn(body + "0") % 10))


def date(value, key):
    first = datetime.date(1800, 1, 1)
    for sep in "-/.":
        if sep not in value:
            continue
        parts = value.split(sep)
        orders = ["ymd", "dmy", "mdy"] if len(value) == 10 else ["dmy", "mdy"]
        for order in orders:
            if len(parts[order.index("y")]) != 4:
                continue
            y, m, d = (int(parts[order.index(c)]) for c in "ymd")
            try:
                n = (datetime.date(y, m, d) - first).days
            except ValueError:
                continue
            a, b = feistel(n // 773, n % 773, 189, 773, key, "date")
            new = first + datetime.timedelta(a * 773 + b)
            wide = 2 if len(value) == 10 else 1
            return sep.join(str(getattr(new, {"y": "year", "m": "month", "d": "day"}[c])).zfill(1 if c == "y" else wide) for c in order)
    return None


def ssn(value, key):
    area, group, serial = map(int, value.split("-"))
    if not 1 <= area <= 899 or area == 666 or not group or not serial:
        return None
    a, b = feistel(area - 1 - (area > 666), (group - 1) * 9999 + serial - 1, 898, 99 * 9999, key, "ssn")
    return f"{a + 1 + (a + 1 >= 666):03}-{b // 9999 + 1:02}-{b % 9999 + 1:04}"


def ip(value, key):
    p = [int(x) for x in value.split(".")]
    a, b = feistel(p[0] * 256 + p[1], p[2] * 256 + p[3], 65536, 65536, key, "ip")
    return f"{a // 256}.{a % 256}.{b // 256}.{b % 256}"


def phone(value, key):
    if not 7 <= len(only(value)) <= 15:
        return None
    code = (re.match(r"\+\d{1,3}(?=\D)", value, re.A) or [""])[0]
    rest = value[len(code) :]
    return code + refill(rest, digits(only(rest), key, "phone"))


def iban(value, key):
    x = value.replace(" ", "")
    number = lambda t: int("".join(str(int(c, 36)) for c in t))
    d = only(x[4:])
    if not 15 <= len(x) <= 34 or number(x[4:] + x[:4]) % 97 != 1 or not 6 <= len(d) <= 34:
        return None
    account = refill(x[4:], digits(d, key, "iban"))
    return refill(value, f"{98 - number(account + x[:2] + '00') % 97:02}" + only(account))


def email(value, key):
    return "user" + hashlib.sha256(f"{key}|email|{value.lower()}".encode()).hexdigest()[:16] + "@mail.invalid"


def secret(value, key):
    body = "".join(hashlib.sha256(f"{key}|secret{i}|{value}".encode()).hexdigest() for i in range(2))
    return (body * (len(value) // 128 + 1))[: len(value)]


PUT = {"email": email, "secret": secret, "iban": iban, "date": date, "ssn": ssn, "ip": ip, "phone": phone}


def cards(stretch, key, seen):
    found = [m[1] for g in pii.GROUPINGS for m in re.finditer(rf"(?<!\d)(?=({g})(?!\d))", stretch, re.A)]
    found += [stretch] if 13 <= len(only(stretch)) <= 19 else []
    for v in dict.fromkeys(found):
        if put := card(v, key):
            new, n = re.subn(rf"(?<!\d){v}(?!\d)", put, stretch)
            if new != stretch:
                seen["card"] += n
            stretch = new
    return stretch


def pseudonymised(text, key):
    """The text, and how many of each kind were replaced."""
    seen: Counter = Counter()
    if text is None:
        return None, seen
    kept, left, at = [], [], 0
    for m in re.finditer(pii.ANY, text, re.A):
        kind = next(k for k in pii.OTHERS if re.fullmatch(pii.PATTERNS[k], m[0], re.A))
        put = PUT[kind](m[0], key)
        left.append(text[at : m.start()])
        at = m.end()
        if put is None:
            left.append(m[0])
        else:
            seen[kind] += 1
            kept.append(put)
            left.append("\0")
    whole = "".join([*left, text[at:]])
    whole = re.sub(pii.PATTERNS["card"], lambda m: cards(m[0], key, seen), whole, flags=re.A)
    turn = iter(kept)
    return re.sub("\0", lambda m: next(turn), whole), seen


# ---- quality ----

RULES = quality.QualityRules()
MENU = re.compile(rf"(?:(?:{quality.NAVIGATION})(?:[ \t\n\x0b\f\r|/>»›•·-]+|$))+", re.I)


def line_fails(line):
    x = line.strip(SPACE)
    count = lambda characters: sum(x.count(c) for c in characters)
    return bool(
        (len(x) <= RULES.max_chars_boilerplate and re.search(quality.BOILERPLATE, x, re.I))
        or count("|»›•·") * 100 > len(x) * RULES.max_separators_percent
        or MENU.fullmatch(x)
        or (len(x) < RULES.min_chars_unmarked and not re.search(r"[.!?…。！？؟।:;]", x))
        or count(quality.SYMBOLS) * 100 > len(x) * RULES.max_symbol_percent
    )


def judged(text):
    """(kept, clean text) of the quality rules."""
    words = WORDS.findall(text or "")
    wins = Counter(zip(words, words[1:], words[2:], strict=False))
    repeated = {j for k in range(len(words) - 2) if wins[tuple(words[k : k + 3])] > 1 for j in (k, k + 1, k + 2)}
    lines = [x for x in (text or "").split("\n") if x.strip(SPACE)]
    good = [x for x in lines if not line_fails(x)]
    total, left = sum(map(len, words)), sum(map(len, WORDS.findall("\n".join(good))))
    failed = len(words) < RULES.min_words or 100 * len(repeated) > RULES.max_repeat_percent * len(words)
    return not failed and (total - left) * 100 <= RULES.max_lost_percent * total, "\n".join(good)


# ---- duplicates ----


def similar_groups(texts):
    """texts: {id: text} -> {id: least id of its group}, by comparing all sets of five-word shingles."""
    sets = {}
    for i, t in texts.items():
        w = (t or "").lower().split()
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    ids = sorted(texts)
    root = {i: i for i in ids}
    for a in ids:
        for b in ids:
            if a < b and root[a] != root[b] and (sets[a] == sets[b] or 10 * len(sets[a] & sets[b]) >= 8 * len(sets[a] | sets[b])):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    return root


def without_repeats(texts, window=35):
    """{id: text} without the words of windows that start anywhere else; a removed word goes with the white space before it."""
    rows = {i: WORDS.findall(t or "") for i, t in texts.items()}
    starts = Counter(tuple(w[k : k + window]) for w in rows.values() for k in range(len(w) - window + 1))
    out = {}
    for i, w in rows.items():
        gone = {j for k in range(len(w) - window + 1) if starts[tuple(w[k : k + window])] > 1 for j in range(k, k + window)}
        if not gone:
            out[i] = texts[i]
            continue
        parts, at = [], 0
        for j, m in enumerate(WORDS.finditer(texts[i])):
            if j not in gone:
                parts.append(texts[i][at : m.end()])
            at = m.end()
        out[i] = "".join(parts).strip(SPACE)
    return out
