"""Personal data by a semi-Markov conditional random field.

Base spans come from the rules below and always stay. The field works on regions: stretches of text around
digits, at signs and what announces a secret, as far as the next white space. A region's atoms are runs of digits, runs of ASCII letters, and single other
characters. Candidate segments are runs of at most ATOMS atoms, or whole keys, that could be of a kind at all; features
of the whole segment (digit count, check digits, separators, what borders on it, words before it)
score it, and so does the kind of the entity before it in the region. Dynamic programming over (place, kind of the last entity) weighs all ways to divide the region into
segments and single outside atoms in which the base spans are segments. The best division's other segments are spans too, where
their probability is at least SURE. So it finds what rules with greedy matching lose, as two numbers in a row, and kinds that have no base rule: keys and passwords (secret), bank accounts (iban).

train() learns the weights by maximum likelihood from at most SAMPLE regions (those of least hash over
all documents) in which the rules dropped nothing; each phone is also shown without its
country code, each card with a wrong check digit, as an account number and as one with wrong check digits, and each address with too large a part. What the patterns
of seeds() find counts as secrets and accounts there; each announced secret is also shown with made-up keys of five alphabets, bare and in quotes, and the same keys under names that
announce nothing, each card with made-up numbers of other lengths and beginnings, right and wrong, so that the field learns what announces a key and what a key looks like, not the pattern. How well it finds what neither pattern nor training has made is a test of its own.

Nulls count as empty texts, which have no spans. Repeated rows give repeated rows, an empty table gives none. A text is held whole in its task; the
work is linear in its length.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
import string
import zlib
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plansift.llm.common import map_rows, slices, text_or_empty

SAMPLE, ATOMS, SURE, EPOCHS, RATE = 1200, 24, 0.9, 6, 0.3
#: The kinds with base rules, then those that the field alone finds.
KINDS = ("email", "ip", "card", "phone", "secret", "iban")
BASE_KINDS = 4

_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
_LOCAL = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789._%+-")
# a run of digits that can't begin a match can't begin one in its middle either
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")
# What announces a secret, and how known keys begin.
_SAID = r"(?i:token|secret|passwo?r?d|passphrase|api[_-]?key|access[_-]?key|private[_-]?key)"
_ASSIGNED = re.compile(_SAID + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?\Z")
_KNOWN = re.compile(r"AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}|xox[bp]-[A-Za-z0-9-]{20,}|AIza[A-Za-z0-9_-]{35}")
_KEY = re.compile(r"[A-Za-z0-9+/_-]{8,}={0,2}")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}")
_HIT = re.compile(r"[0-9@]+")
_ANNOUNCED = re.compile(_SAID + r"[\"']?\s{0,3}[=:]\s{0,3}[\"']?(?=[A-Za-z+/_-])")
_STEMS = ("token", "secret", "pass", "key")  # one of them is in all that announces a secret
_ATOM = re.compile(r"[0-9]+|[A-Za-z]+|.", re.S)
# Words that announce a kind.
CUES = {"email": ("mail", "contact", "write"), "ip": ("ip", "host", "server", "addr"), "card": ("card", "visa", "credit", "pay"), "phone": ("tel", "phone", "call", "fax", "mobile"), "secret": ("key", "auth", "login"), "iban": ("iban", "account", "bank")}

Span = tuple[int, int, int]  # kind, start, end


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def checked(account: str) -> bool:
    """Whether an account number's check digits (ISO 13616) are right."""
    return int("".join(str(int(c, 36)) for c in account[4:] + account[:4])) % 97 == 1


def account(digits: str, country: str = "DE") -> str:
    """An account number with right check digits."""
    return f"{country}{98 - int(''.join(str(int(c, 36)) for c in digits + country) + '00') % 97:02d}{digits}"


def seeds(text: str) -> list[Span]:
    """Secrets and accounts that are plain to see: what training takes for true."""
    out = []
    for m in _KEY.finditer(text):
        if _ASSIGNED.search(text, max(0, m.start() - 40), m.start()) or _KNOWN.fullmatch(m[0]):
            out.append((4, m.start(), m.end()))
        elif _IBAN.fullmatch(m[0]) and checked(m[0]):
            out.append((5, m.start(), m.end()))
    return out


def base(text: str) -> tuple[list[Span], bool]:
    """The rules' spans, by kind and start; whether a rule dropped a match."""
    out: list[Span] = []
    dropped = False
    if "@" in text:
        end = 0
        at = text.find("@")
        while at >= 0:
            start = at
            while start > end and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                out.append((0, start, m.end()))
                end = m.end()
            at = text.find("@", max(at + 1, end))
    if not _DIGITS.search(text):
        return out, dropped
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m[0].split(".")):
            out.append((1, m.start(), m.end()))
        else:
            dropped = True
    for m in _CARD.finditer(text):
        if m.end() - m.start() < 13:
            continue
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, m.start(), m.end()))
        elif len(digits) > 12:
            dropped = True
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= sum(map(m[0].count, "0123456789")) <= 15:
                out.append((3, m.start(), m.end()))
            else:
                dropped = True
    return out, dropped


def regions(text: str):
    """(start, end) of the stretches around digits, at signs and announced secrets, chunks with one blank or bracket between taken together."""
    hits = [m.span() for m in _HIT.finditer(text)]
    if "=" in text or ":" in text:
        low = text.lower()
        if any(s in low for s in _STEMS):
            hits = sorted(hits + [m.span() for m in _ANNOUNCED.finditer(text)])
    start = end = -1
    for a, b in hits:
        if b <= end:
            continue
        low = max(0, end)
        while a > low and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        if end >= 0 and a - end <= 1:
            end = b
            continue
        if end >= 0:
            yield start, end
        start, end = a, b
    if end >= 0:
        yield start, end


def _candidates(text: str, start: int, end: int):
    """Atoms' bounds, and by last atom the (first atom, kind, features) of each candidate segment."""
    spans = [m.span() for m in _ATOM.finditer(text, start, end)]
    kinds = ["d" if text[a].isascii() and text[a].isdigit() else "a" if text[a].isascii() and text[a].isalpha() else text[a] for a, _ in spans]
    before = text[max(0, start - 24) : start].lower()
    found: list[list[tuple[int, int, tuple[str, ...]]]] = [[] for _ in spans]
    first, last = {a: k for k, (a, _) in enumerate(spans)}, {b: k for k, (_, b) in enumerate(spans)}
    for m in _KEY.finditer(text, start, end):
        s, cued = m[0], bool(_ASSIGNED.search(text, max(0, m.start() - 40), m.start()))
        if not cued and (len(s) < 15 or not _DIGITS.search(s)):
            continue
        i, j = first.get(m.start()), last.get(m.end())
        if i is None or j is None:  # an edge within a run of other letters
            continue
        around = text[m.start() - 1] if m.start() else "", text[m.end()] if m.end() < len(text) else ""
        for kind in (4, 5) if _IBAN.fullmatch(s) else (4,):
            found[j].append((i, kind, _key_features(kind, s, cued, *around, (before + text[start : m.start()].lower())[-24:])))
    for i, (a, _) in enumerate(spans):
        if kinds[i] not in "da+(._%-":
            continue
        digits = ats = dots = letters = blanks = other = 0
        for j in range(i, min(len(spans), i + ATOMS)):
            b = spans[j][1]
            k = kinds[j]
            if k == "d":
                digits += b - spans[j][0]
            elif k == "a":
                letters += 1
            elif k == "@":
                ats += 1
            elif k == ".":
                dots += 1
            elif k.isspace():
                blanks += 1
                if k != " ":
                    break
            elif k not in "+()-_%":
                other += 1
            if other or ats > 1 or blanks > 4 or digits > 19 and not ats and letters == 0:
                break
            if k not in "da":
                continue
            for kind in range(BASE_KINDS):
                if kind == 0 and (ats != 1 or blanks or not dots or j == i):
                    continue
                if kind == 1 and (letters or ats or dots != 3 or blanks or kinds[i] != "d" or k != "d" or j - i != 6):
                    continue
                if kind == 2 and (letters or ats or dots or not 12 <= digits <= 19 or kinds[i] != "d" or k != "d" or "(" in kinds[i : j + 1] or "+" in kinds[i : j + 1]):
                    continue
                if kind == 3 and (letters or ats or not 7 <= digits <= 15 or kinds[i] not in "d+(" or k != "d"):
                    continue
                s = text[a:b]
                f = _features(kind, s, digits, text[a - 1] if a else "", text[b] if b < len(text) else "", before + text[start:a].lower()[-24:])
                found[j].append((i, kind, f))
    return spans, found


def _key_features(kind: int, s: str, cued: bool, prev: str, nxt: str, before: str) -> tuple[str, ...]:
    n = KINDS[kind]
    f = [n, f"{n} announced {cued}", f"{n} quoted {bool(prev) and prev == nxt and prev in chr(34) + chr(39)}", f"{n} cue {any(c in before for c in CUES[n])}"]
    if kind == 5:
        return (*f, f"iban check {checked(s)}")
    hexed = all(c in "0123456789abcdefABCDEF" for c in s)
    digits = sum(c.isdigit() for c in s)
    return (*f, f"secret known {bool(_KNOWN.fullmatch(s))}", f"secret hex {hexed}", f"secret long {min(len(s) // 8, 6)}", f"secret digits {min(3, 8 * digits // len(s))}", f"secret case {s.lower() != s and s.upper() != s}", f"secret marks {any(c in '/_-+' for c in s)}")


def _features(kind: int, s: str, digits: int, prev: str, nxt: str, before: str) -> tuple[str, ...]:
    n = KINDS[kind]
    f = [n, f"{n} left {'edge' if not prev or prev.isspace() or prev in '([<:;,=' + chr(34) else 'word' if prev.isalnum() else 'mark'}", f"{n} right {'edge' if not nxt or nxt.isspace() or nxt in ')]>:;,.!?' + chr(34) else 'word' if nxt.isalnum() else 'mark'}"]
    if kind:
        f.append(f"{n} digits {digits}")
    if any(c in before[-24:] for c in CUES[n]):
        f.append(f"{n} cue")
    if kind == 0:
        local, _, domain = s.partition("@")
        last = domain.rpartition(".")[2]
        f += [f"email last {'letters' if last.isalpha() else 'other'} {min(len(last), 5)}", f"email local {'good' if local and local[0].isalnum() and local[-1].isalnum() else 'odd'}", f"email domain {'good' if all(domain.split('.')) and domain[0].isalnum() else 'odd'}"]
    elif kind == 1:
        f.append(f"ip parts {'good' if all(len(p) <= 3 and int(p) < 256 for p in s.split('.')) else 'odd'}")
    elif kind == 2:
        groups = re.split(r"[ -]", s)
        f += [f"card check {luhn(re.sub('[^0-9]', '', s))}", f"card groups {'one' if len(groups) == 1 else 'four' if all(len(g) == 4 for g in groups[:-1]) else 'odd'}", f"card first {s[0]}"]
    else:
        groups = re.findall(r"[0-9]+", s)
        shape = "-".join(str(len(g)) for g in groups[-2:]) if len(groups) <= 5 else "many"
        f += [f"phone plus {s[0] == '+'}", f"phone brackets {'(' in s and ')' in s}", f"phone shape {shape}", f"phone even {s.count('(') == s.count(')')}", f"phone marks {bool(re.search('[ ().-]', s))}"]
    return tuple(f)


# States of the dynamic programs: 0 before the first entity, k + 1 after one of kind k.
_STATES = range(len(KINDS) + 1)
_NONE = float("-inf")


def _sum(parts: list[float]) -> float:
    top = max(parts)
    return top if top == _NONE else top + math.log(sum(math.exp(p - top) for p in parts))


def _scored(found, w: dict[str, float]):
    """By last atom: (first atom, kind, score from each state) of each segment."""
    after = [[w.get(f"{s} > {k}", 0.0) for s in _STATES] for k in range(len(KINDS))]
    return [[(i, kind, [sum(w.get(x, 0.0) for x in f) + t for t in after[kind]]) for i, kind, f in c] for c in found]


def _forward(n: int, scored, inside=frozenset()):
    """By place and state, log sums over all divisions of what comes before. inside: atoms that must lie in a segment."""
    alpha = [[0.0 if s == 0 else _NONE for s in _STATES]]
    for j in range(n):
        parts = [[_NONE if j in inside else a] for a in alpha[j]]
        for i, kind, score in scored[j]:
            parts[kind + 1] += [a + x for a, x in zip(alpha[i], score) if a != _NONE]
        alpha.append([_sum(p) for p in parts])
    return alpha


def _backward(n: int, scored, inside=frozenset()):
    """By place and state, log sums over all divisions of what comes after."""
    starts: list[list] = [[] for _ in range(n)]
    for j in range(n):
        for i, kind, score in scored[j]:
            starts[i].append((j, kind, score))
    beta = [[0.0] * len(_STATES) for _ in range(n + 1)]
    for i in range(n - 1, -1, -1):
        beta[i] = [_sum([_NONE if i in inside else beta[i + 1][s], *(score[s] + beta[j + 1][kind + 1] for j, kind, score in starts[i])]) for s in _STATES]
    return beta


def _marginals(n: int, found, w: dict[str, float], inside=frozenset()):
    """By last atom: each segment's probability with each state before it."""
    scored = _scored(found, w)
    alpha, beta = _forward(n, scored, inside), _backward(n, scored, inside)
    whole = _sum(alpha[n])
    return [[[math.exp(min(0.0, a + x + beta[j + 1][kind + 1] - whole)) if a != _NONE else 0.0 for a, x in zip(alpha[i], score)] for i, kind, score in scored[j]] for j in range(n)]


def _best(n: int, found, w: dict[str, float], inside=frozenset()):
    """(first atom, last atom, kind, index in found) of the best division's segments."""
    top, back = [[0.0 if s == 0 else _NONE for s in _STATES]], []
    for j, c in enumerate(_scored(found, w)):
        here = [_NONE] * len(_STATES) if j in inside else list(top[j])
        came: list = [None] * len(_STATES)
        for k, (i, kind, score) in enumerate(c):
            x, s = max((a + y, s) for s, (a, y) in enumerate(zip(top[i], score)))
            if x > here[kind + 1]:
                here[kind + 1], came[kind + 1] = x, (i, j, kind, k, s)
        top.append(here)
        back.append(came)
    out, j = [], n
    state = max(_STATES, key=lambda s: top[n][s])
    while j > 0:
        if came := back[j - 1][state]:
            out.append(came[:4])
            j, state = came[0], came[4]
        else:
            j -= 1
    return out[::-1]


#: Alphabets of made-up keys, and what stands between a name and its value.
_ALPHABETS = (string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", string.ascii_lowercase + string.digits, string.ascii_letters + "_-", string.digits + "abcdef")
_GIVEN = ("=", ": ", " = ", '="', ": '", " = \"")


def _numbers(like: str) -> list[tuple[str, bool]]:
    """Made-up card numbers of other lengths and beginnings, each with its check digit right and wrong, in groups or not."""
    r, out = random.Random(zlib.crc32(like.encode())), []
    for n in (13, 14, 15, 16, 19):
        head = r.choice("3456") + "".join(r.choice(string.digits) for _ in range(n - 2))
        check = next(c for c in string.digits if luhn(head + c))
        for c in (check, str((int(check) + 1 + r.randrange(9)) % 10)):
            number = head + c
            out.append((r.choice(("", " ", "-")).join(number[k : k + 4] for k in range(0, n, 4)), c == check))
    return out


def _keys(text: str, end: int, gold: list[Span], x: Span) -> list[tuple[str, list[Span]]]:
    """A region with a secret, with made-up keys in its place, bare and in quotes: true where a name announces them, not where the name is that of something else, nor where the value is a plain word."""
    a = x[1]
    m = _ASSIGNED.search(text, max(0, a - 40), a)
    if not m:
        return []
    rest = [g for g in gold if g[2] <= m.start()]  # what comes after the secret isn't shown
    r, out = random.Random(zlib.crc32(text.encode("utf-8", "surrogatepass"))), []
    name = re.match(_SAID, m[0])[0]
    for alphabet in _ALPHABETS:
        given = r.choice(_GIVEN)
        key = r.choice(string.ascii_letters) + "".join(r.choice(alphabet) for _ in range(r.randint(15, 47)))
        quote = given[-1] if given[-1] in "\"'" else ""
        for said, value, true in ((r.choice((name, name.upper(), "my_" + name)), key, True), (r.choice(("colour", "revision", "file", "digest")), key, False), (name, r.choice(("none", "required", "changed", "optional", "disabled")), False)):
            lead = text[: m.start()] + said + given
            out.append((lead + value + quote + text[end:], rest + [(4, len(lead), len(lead) + len(value))] * true))
    return out


def learn(samples: list[tuple[str, int, int]], epochs: int = EPOCHS, rate: float = RATE) -> dict[str, float]:
    """Weights from (text, start, end) regions, in the order given."""
    cases = []
    for text, start, end in samples:
        gold, dropped = base(text)
        if dropped:
            continue
        held = [(a, b) for _, a, b in gold]
        gold = gold + [g for g in seeds(text) if not any(g[1] < b and g[2] > a for a, b in held)]
        shown = [(text, gold)]
        for x in gold:
            kind, a, b = x

            def put(new: str, mine: list[Span] = (), a=a, b=b, x=x) -> None:
                """Shows the region with other text in the span's place, and what of it is true."""
                off = len(new) - (b - a)
                others = [(k, c, d) if d <= a else (k, c + off, d + off) for k, c, d in gold if (k, c, d) != x]
                shown.append((text[:a] + new + text[b:], others + [(k, a + c, a + d) for k, c, d in mine]))

            if kind == 3 and (m := re.match(r"\+[0-9]{1,3}[ -](?=\()", text[a:b])):
                put(text[a + m.end() : b], [(3, 0, b - a - m.end())])
            elif kind == 2:
                put(text[a : b - 1] + str((int(text[b - 1]) + 3) % 10))  # the check digit no longer fits
                good = account(re.sub("[^0-9]", "", text[a:b]))
                put(good, [(5, 0, len(good))])
                put(f"{good[:2]}{(int(good[2:4]) + 1) % 100:02d}{good[4:]}")
                for number, true in _numbers(text[a:b]):
                    put(number, [(2, 0, len(number))] * true)
            elif kind == 1:
                put(text[a:b] + "77")
            elif kind == 4:
                shown += _keys(text, end, gold, x)
        for t, want in shown:
            spans, found = _candidates(t, start, end + len(t) - len(text))
            marks = [[(kind, spans[i][0], spans[j][1]) in want for i, kind, _ in c] for j, c in enumerate(found)]
            if any(found):
                cases.append((len(spans), found, marks))
    w = {n: -1.0 for n in KINDS}
    for e in range(epochs):
        step = rate / (1 + e)
        for n, found, marks in cases:
            state, before = 0, {}
            for j, (c, ms) in enumerate(zip(found, marks)):
                for k, ((_, kind, _), m) in enumerate(zip(c, ms)):
                    if m:
                        before[j, k], state = state, kind + 1
            for j, (c, ps) in enumerate(zip(found, _marginals(n, found, w))):
                for k, ((_, kind, f), p) in enumerate(zip(c, ps)):
                    # the segment's features, and its transition from each state
                    true = before.get((j, k))
                    pulls = [(f, (true is not None) - sum(p))]
                    pulls += [((f"{s} > {kind}",), (true == s) - x) for s, x in enumerate(p)]
                    for names, pull in pulls:
                        if abs(pull) > 1e-3:
                            for x in names:
                                w[x] = w.get(x, 0.0) + step * (pull - 1e-3 * w.get(x, 0.0))
    return w


def _touching(kinds: list[list[Span]], start: int, end: int) -> list[Span]:
    """The base spans that touch a stretch. kinds: each kind's spans in order; they don't overlap."""
    out = []
    for listed in kinds:
        k = bisect_right(listed, start, key=lambda s: s[2])
        while k < len(listed) and listed[k][1] < end:
            out.append(listed[k])
            k += 1
    return out


def spans(text: str, w: dict[str, float], sure: float = SURE) -> tuple[list[Span], list[Span]]:
    """(base spans, all spans), by kind and start."""
    held, _ = base(text)
    kinds, more = [[s for s in held if s[0] == k] for k in range(BASE_KINDS)], []
    for start, end in regions(text):
        at, found = _candidates(text, start, end)
        near = _touching(kinds, start, end)
        inside: set[int] = set()
        if near:
            # a base span is a segment, and no other lies across it; where base spans overlap none is asked for
            touched = [any(a < y and b > x for _, x, y in near) for a, b in at]
            where = lambda c, j: (c[1], at[c[0]][0], at[j][1])  # noqa: E731, B023
            found = [[c for c in cs if where(c, j) in near or not any(touched[c[0] : j + 1])] for j, cs in enumerate(found)]
            for s in {where(c, j) for j, cs in enumerate(found) for c in cs}.intersection(near):
                if not any(o != s and o[1] < s[2] and o[2] > s[1] for o in near):
                    inside.update(i for i, (a, b) in enumerate(at) if a >= s[1] and b <= s[2])
        if all((kind, at[i][0], at[j][1]) in near for j, cs in enumerate(found) for i, kind, _ in cs):
            continue
        p = None
        for i, j, kind, x in _best(len(at), found, w, inside):
            span = (kind, at[i][0], at[j][1])
            if span not in near:
                p = _marginals(len(at), found, w, inside) if p is None else p
                if sum(p[j][x]) >= sure:
                    more.append(span)
    return held, sorted(held + more)


def train(df: DataFrame, text_col: str = "text", sample: int = SAMPLE) -> dict[str, float]:
    """Weights from a bounded sample of the regions of all documents; the regions are short."""

    def run(batches):
        least: list[tuple] = []
        for rows in batches:
            out = set(least)
            for (text,) in rows:
                for a, b in regions(text):
                    if b - a <= 200:
                        lo = max(0, a - 40)
                        piece = text[lo : b + 1]
                        out.add((xxhash.xxh64_intdigest(piece.encode("utf-8", "surrogatepass")) >> 1, piece, a - lo, b - lo))
            # of one partition no more than the sample can be chosen
            least = sorted(out)[:sample]
        yield least

    found = map_rows(df.select(text_or_empty(text_col).alias("text")), run, "h long, piece string, a int, b int")
    chosen = found.distinct().orderBy("h", "piece").limit(sample).collect()
    return learn([(r["piece"], r["a"], r["b"]) for r in chosen])


def written(found: list[Span]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in found)


def find(df: DataFrame, weights: dict[str, float] | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, counts of base spans by kind, base_sha256, spans, n_spans (of all kinds), n_secret of every whole text."""
    w = train(df, text_col) if weights is None else weights

    def run(batches):
        for rows in batches:
            out = []
            for k, text in rows:
                held, every = spans(text, w)
                held = sorted(held)
                out.append((k, *(sum(s[0] == n for s in held) for n in range(BASE_KINDS)), hashlib.sha256(written(held).encode()).hexdigest(), written(every), len(every), sum(s[0] == 4 for s in every)))
            yield out

    rows = df.select(F.col(id_col).cast("long").alias("doc_id"), text_or_empty(text_col).alias("text"))
    return map_rows(rows, run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_spans long, n_secret long")


def redact(df: DataFrame, weights: dict[str, float] | None = None, text_col: str = "text") -> DataFrame:
    """df with every span of its text replaced by its kind in brackets, as [EMAIL]; a null text stays null."""
    w = train(df, text_col) if weights is None else weights

    def one(text):
        if text is None:
            return None
        parts, at = [], 0
        for a, b, k in sorted((a, b, k) for k, a, b in spans(text, w)[1]):
            if b <= at:
                continue
            if a >= at:
                parts += [text[at:a], f"[{KINDS[k].upper()}]"]
            at = b
        return "".join(parts) + text[at:] if parts else text

    @F.arrow_udf("string")
    def clean(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for t in texts:
            yield pa.concat_arrays([pa.array([one(x) for x in part.to_pylist()], pa.string()) for part in slices(t)])

    return df.withColumn(text_col, clean(F.col(text_col).cast("string")))
