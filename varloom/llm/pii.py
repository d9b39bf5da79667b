"""Personal data in texts: patterns propose spans, boosted trees choose among them, calibrated thresholds decide.

Four kinds have base patterns (e-mail, IP address, card number, phone number); their matches always stay.  High-recall
generators propose more, overlapping spans: every run of 7 to 19 digits (as phone, card or social security number, by its
length), numbers of four parts and IPv6 addresses, bank accounts, e-mail addresses written out, dates, street addresses,
names after a title, values assigned to a key, and any long mixed string.  Most of these are no personal data.  Each
candidate has features of its format and of the words around it; gradient-boosted trees of its kind (depth 2) score it,
the score is calibrated, and it becomes a span from the kind's threshold on.  Of overlapping chosen candidates the best
stays; one that overlaps a base span falls away.

The trees are trained on TRAIN_ROWS generated texts (`examples`), half of which fit the trees and half the calibration
and thresholds; no corpus data is needed, so results do not depend on the table.  A text's label says for what it was
made: a telephone number or an order number, a key or a checksum.  Numbers of both sorts are written alike, some texts
say what a number is and some do not, and some say something misleading; so a candidate without any context stays
uncertain and is left alone.

All patterns are matched in time linear in the text: a run of digits or letters is entered once only.  Positions are code
points.  Defined results: null and empty texts have no spans; equal rows have equal spans.
"""
from __future__ import annotations

import hashlib
import math
import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from varloom.llm.base import map_texts

#: Kinds in the order in which spans of one start are listed; the first four have base patterns.
KINDS = ("email", "ip", "card", "phone", "ssn", "iban", "secret", "birth", "address", "name")
EMAIL, IP, CARD, PHONE, SSN, IBAN, SECRET, BIRTH, ADDRESS, NAME = range(len(KINDS))
BASE = KINDS[:4]
TRAIN_ROWS = 12_000
SEED = 11
#: Share of chosen candidates that must be right on the calibration half.
PRECISION = 0.95
#: Characters before and after a candidate whose words count.
CONTEXT = 32

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT_OR_AT = re.compile("[0-9@]").search

# what generators look for
_RUN = re.compile(r"[0-9](?:[ ().-]{0,2}[0-9])++")
_FOUR = re.compile(r"(?<![0-9.])[0-9]{1,4}+(?:\.[0-9]{1,4}+){3}(?![0-9.]*[0-9])")
_SIX = re.compile(r"(?<![0-9A-Za-z:])[0-9A-Fa-f]{1,4}(?::{1,2}[0-9A-Fa-f]{1,4}){3,7}(?![0-9A-Za-z:])")
_IBAN = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])")
_SPELLED = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64} ?(?:[(\[]at[)\]]| at ) ?[A-Za-z0-9-]{1,63}(?: ?(?:\.|[(\[]dot[)\]]| dot ) ?[A-Za-z0-9-]{1,63}){1,4}", re.I)
_DATE = re.compile(
    r"(?<![0-9/.-])(?:[0-9]{1,2}([./-])[0-9]{1,2}\1(?:19|20)[0-9]{2}|(?:19|20)[0-9]{2}-[0-9]{2}-[0-9]{2}"
    r"|[0-9]{1,2}\.? (?:Jan|Feb|Mar|Apr|May|Jun|Jul|Aug|Sep|Oct|Nov|Dec)[a-z]{0,6} (?:19|20)[0-9]{2})(?![0-9/-])"
)
_STREET = re.compile(r"(?<![0-9A-Za-z])[0-9]{1,5} (?:[A-Z][a-z]{1,20} ){1,3}(?:Street|St|Avenue|Ave|Road|Rd|Lane|Ln|Drive|Dr|Boulevard|Blvd|Court|Square|Way)(?![A-Za-z])")
_TITLED = re.compile(r"(?<![A-Za-z])(?:Mr|Mrs|Ms|Dr|Prof|Herr|Frau|Mme|name is|name:|signed,|contact:) ?\.? ?((?:[A-Z][a-z]{1,20})(?: [A-Z][a-z]{1,20}){0,2})")
_ASSIGNED = re.compile(r"(?i)(?<![a-z])(?:access[_-]?|api[_-]?|auth[_-]?|secret[_-]?)?(?:token|secret|key|passwd|password|pwd)[\"']?[ \t]{0,3}[:=][ \t]{0,3}[\"']?([A-Za-z0-9_+/=.-]{12,}+)")
_MIXED = re.compile(r"[A-Za-z0-9_+/-]{20,}+={0,2}")
#: Characters of a word in which a mixed string may be.
MIXED_CHARS = 20

#: Stems of words that tell what stands beside them.
HINTS = {
    "phone": "phone tel call fax mobile cell sms whatsapp ring",
    "person": "ssn social passport licence tax insurance citizen patient",
    "bank": "iban account bank transfer payee swift sepa",
    "card": "card visa mastercard amex credit debit cvv expires",
    "mail": "mail contact write reach address send",
    "secret": "token secret key password passwd pwd credential bearer auth",
    "birth": "born birth dob birthday age",
    "home": "live lives home address resides deliver",
    "name": "name mr mrs ms dr signed sincerely",
    "net": "host server ip login client address",
    "number": "order invoice isbn item part serial page pages chapter figure table total sum article section ticket room",
    "digest": "commit sha md5 checksum etag digest hash build revision version release image",
    "event": "published released updated founded deadline meeting since until copyright press",
}
_HINTS = [re.compile(r"(?i)(?<![a-z])(?:" + "|".join(words.split()) + r")[a-z]{0,2}(?![a-z])") for words in HINTS.values()]


def emails(text: str) -> list[tuple[int, int]]:
    """Matches of `[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, found from their @."""
    out, done, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            done = m.end()
        else:
            # what stands before this @ cannot belong to a later match, as @ is in no part of one
            done = at + 1
        at = text.find("@", max(done, at + 1))
    return out


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def ips(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _IP.finditer(text) if all(map(_small, m[0].split(".")))]


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(sum(divmod(2 * int(d), 10)) for d in digits[-2::-2])
    return total % 10 == 0


def _digits(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def cards(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _CARD.finditer(text) if m.end() - m.start() < 40 and 12 <= len(d := _digits(m[0])) <= 19 and luhn(d)]


def phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        m = _PHONE.match(text, at)
        if m and 9 <= len(_digits(m[0])) <= 15:
            out.append(m.span())
        at = text.find("+", m.end() if m else at + 1)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of all base patterns' matches, in order."""
    if not _DIGIT_OR_AT(text):
        return []
    out = [(a, k, b) for k, find in enumerate((emails, ips, cards, phones)) for a, b in find(text)]
    return sorted(out)


def _pieces(text: str, start: int, end: int) -> Iterator[tuple[int, int, int]]:
    """(start, end, digits) of what may be one number in a run of digits and separators.

    The whole run if it has at most 19 digits; else each of its parts between spaces, and from a part with a + on the
    parts up to 9 digits.
    """
    if start and text[start - 1] in "+(":
        start -= 1 + (start > 1 and text[start - 1] == "(" and text[start - 2] == "+")
    n = len(_digits(text[start:end])) if end - start < 60 else 99
    if n <= 19:
        yield start, end, n
        return
    parts = [(m.start(), m.end(), len(_digits(m[0]))) for m in re.compile("[^ ]+").finditer(text, start, end)]
    for i, (a, b, n) in enumerate(parts):
        if n <= 19:
            yield a, b, n
        if text[a] == "+" and n < 9:
            for _, b, more in parts[i + 1 : i + 6]:
                n += more
                if n >= 9:
                    yield a, b, n
                    break


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind number, end) of what the generators propose; spans may overlap."""
    out = []
    if _DIGIT_OR_AT(text):
        for m in _RUN.finditer(text):
            if m.end() - m.start() < 7:
                continue
            for a, b, n in _pieces(text, *m.span()):
                if n < 7:
                    continue
                if n <= 15:
                    out.append((a, PHONE, b))
                if n == 9:
                    out.append((a, SSN, b))
                if n >= 12:
                    out.append((a, CARD, b))
        for kind, pattern in ((IP, _FOUR), (IBAN, _IBAN), (BIRTH, _DATE), (ADDRESS, _STREET)):
            out += [(m.start(), kind, m.end()) for m in pattern.finditer(text)]
        if text.count(":") > 2:
            out += [(m.start(), IP, m.end()) for m in _SIX.finditer(text)]
    if "(at)" in text or "[at]" in text or " dot " in text or "(AT)" in text or "[AT]" in text:
        out += [(m.start(), EMAIL, m.end()) for m in _SPELLED.finditer(text)]
    if "=" in text or ":" in text:
        out += [(m.start(1), SECRET, m.end(1)) for m in _ASSIGNED.finditer(text)]
    if any(t in text for t in ("Mr", "Ms", "Dr", "Prof", "Herr", "Frau", "Mme", "name", "signed", "contact:")):
        out += [(m.start(1), NAME, m.end(1)) for m in _TITLED.finditer(text)]
    at = 0
    for word in [w for w in text.split() if len(w) >= MIXED_CHARS]:
        at = text.index(word, at)
        for m in _MIXED.finditer(word):
            if any("0" <= c <= "9" for c in m[0]) and any(c.isalpha() for c in m[0]):
                out.append((at + m.start(), SECRET, at + m.end()))
        at += len(word)
    return list(dict.fromkeys(out))


# features and trees


def iban_ok(text: str) -> bool:
    s = text.replace(" ", "")
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


def format_features(text: str, start: int, kind: int, end: int) -> list[float]:
    span = text[start:end]
    before, after = text[max(0, start - CONTEXT) : start], text[end : end + CONTEXT]
    digits, letters = _digits(span), sum(c.isalpha() for c in span)
    groups = [len(g) for g in re.split(r"[ .()\[\]/:-]+", span.strip("+()[] ")) if g] or [0]
    counts = Counter(span)
    entropy = -sum(n / len(span) * math.log2(n / len(span)) for n in counts.values())
    shift = sum(a.isdigit() != b.isdigit() for a, b in zip(span, span[1:]))
    line = before.rpartition("\n")[2]
    return [
        len(span), len(digits), letters, len(digits) / len(span), len(counts), len(counts) / len(span), entropy, shift / len(span),
        len(groups), groups[0], groups[-1], max(groups), min(groups),
        *(float(c in span) for c in "+(-. /:"),
        float(span[:1] == "+"), float(digits[:1] in ("0", "1")), float(digits[:1] == "9"), float(len(set(digits)) <= 2),
        float(12 <= len(digits) <= 19 and luhn(digits)), float(kind == IBAN and iban_ok(span)), float(kind == IP and all(map(_small, span.split("."))) if kind == IP and "." in span else False),
        float(any(c.isupper() for c in span)), float(any(c.islower() for c in span)), float(all(c in "0123456789abcdefABCDEF" for c in span)),
        float(before[-1:].isalnum()), float(after[:1].isalnum()), float(before[-1:] in ('"', "'") and after[:1] == before[-1:]), float(before.rstrip(" \"'")[-1:] in ("=", ":")),
        *(float(bool(h.search(line))) for h in _HINTS), *(float(bool(h.search(after))) for h in _HINTS),
    ]


@dataclass
class Trees:
    """Boosted trees of depth 2 of one kind: features and cuts of three nodes, four values; calibration and threshold."""

    start: float
    nodes: list[tuple[tuple[int, float], tuple[int, float], tuple[int, float]]]
    values: list[np.ndarray]
    slope: float = 1.0
    shift: float = 0.0
    threshold: float = 1.1

    def raw(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for nodes, values in zip(self.nodes, self.values):
            out += values[_leaf(x, nodes)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.slope * self.raw(x) + self.shift)))


def _leaf(x: np.ndarray, nodes) -> np.ndarray:
    (f, c), (f0, c0), (f1, c1) = nodes
    return np.where(x[:, f] > c, 2 + (x[:, f1] > c1), x[:, f0] > c0).astype(np.int64)


def _best_cut(bins: np.ndarray, cuts: list[np.ndarray], residual: np.ndarray, weight: np.ndarray) -> tuple[int, float]:
    """The feature and cut of greatest gain, from sums by bin."""
    best, found = -1.0, (0, np.inf)
    total, total_w = residual.sum(), weight.sum()
    for f, edges in enumerate(cuts):
        if not len(edges):
            continue
        left = np.cumsum(np.bincount(bins[f], residual, len(edges) + 1))[:-1]
        left_w = np.cumsum(np.bincount(bins[f], weight, len(edges) + 1))[:-1]
        gain = left**2 / (left_w + 1) + (total - left) ** 2 / (total_w - left_w + 1)
        i = int(gain.argmax())
        if gain[i] > best + 1e-12:
            best, found = gain[i], (f, float(edges[i]))
    return found


def boost(x: np.ndarray, y: np.ndarray, rounds: int = 60, rate: float = 0.2) -> Trees:
    """Gradient boosting on logistic loss with second-order leaf values."""
    cuts, bins = [], np.empty((x.shape[1], len(x)), np.int64)
    for f in range(x.shape[1]):
        u = np.unique(x[:, f])
        mid = (u[1:] + u[:-1]) / 2
        cuts.append(mid if len(mid) <= 24 else np.unique(np.quantile(mid, np.linspace(0, 1, 24))))
        bins[f] = np.searchsorted(cuts[f], x[:, f], side="left")
    share = np.clip(y.mean(), 0.01, 0.99)
    model = Trees(float(np.log(share / (1 - share))), [], [])
    score = np.full(len(y), model.start)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-score))
        residual, weight = y - p, p * (1 - p)
        root = _best_cut(bins, cuts, residual, weight)
        right = x[:, root[0]] > root[1]
        nodes = (root, *(_best_cut(bins[:, m], cuts, residual[m], weight[m]) for m in (~right, right)))
        leaf = _leaf(x, nodes)
        values = rate * np.bincount(leaf, residual, 4) / (np.bincount(leaf, weight, 4) + 1)
        score += values[leaf]
        model.nodes.append(nodes)
        model.values.append(values)
    return model


def _calibrated(raw: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and shift of a logistic fit (Platt), by Newton's method with a small penalty."""
    a, b = 1.0, 0.0
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(a * raw + b, -30, 30)))
        g = np.array([((y - p) * raw).sum() - 1e-2 * (a - 1), (y - p).sum()])
        w = p * (1 - p)
        h = np.array([[(w * raw * raw).sum() + 1e-2, (w * raw).sum()], [(w * raw).sum(), w.sum() + 1e-6]])
        step = np.clip(np.linalg.solve(h, g), -2, 2)
        a, b = a + step[0], b + step[1]
    return float(a), float(b)


# generated texts

#: Words of generated texts.
_FIRST = "Anna Ben Carla David Elena Frank Grace Hugo Ines Jonas Karl Laura Marie Nico Olga Paul Rosa Stefan".split()
_LAST = "Smith Jones Garcia Martin Bauer Keller Moreau Lopez Weber Fischer Brown Clark Dubois Romero Novak Hansen".split()
_PROSE = "the and with from after some people house said that there was long under river light we had seen no one before it und der la de que les".split()


class _Maker:
    """Makes one text with one thing in it; `real` things are personal data, the others only look like it."""

    def __init__(self, seed: int):
        self.r = np.random.default_rng(seed)

    def pick(self, *x):
        return x[self.r.integers(len(x))]

    def some(self, n: int, letters: str) -> str:
        return "".join(self.r.choice(list(letters), n))

    def digits(self, n: int) -> str:
        return self.some(n, "0123456789")

    def n(self, low: int, high: int) -> int:
        return int(self.r.integers(low, high))

    def prose(self, low: int, high: int) -> str:
        return " ".join(self.r.choice(_PROSE, self.n(low, high)))

    def grouped(self) -> str:
        """Digits as telephones, parts lists and tables write them alike."""
        sep = self.pick(" ", "-", ".", "")
        shape = self.pick((3, 3, 4), (3, 3, 4), (3, 4), (2, 2, 2, 2, 2), (4, 6), (3, 7), (1, 3, 3, 4), (2, 3, 3, 4), (3, 2, 4))
        return sep.join(self.digits(k) for k in shape)

    def key(self) -> str:
        length = self.n(20, 64) if self.r.random() < 0.8 else self.n(64, 901)
        return self.some(length, self.pick("0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-"))

    def thing(self, kind: int, real: bool) -> tuple[str, list[str], list[str]]:
        """(text, words that say what it is, words that do not fit)."""
        pick, digits, r = self.pick, self.digits, self.r
        numbers = ["order", "invoice no.", "ISBN", "item", "part no.", "serial", "pages", "total", "ticket", "table", "article"]
        if kind == PHONE:
            if real:
                own = pick(self.grouped(), self.grouped(), f"({digits(3)}) {digits(3)}-{digits(4)}", f"+{self.n(1, 99)} {digits(3)} {digits(3)} {digits(4)}", f"+1 ({digits(3)}) {digits(3)}-{digits(4)}")
                return own, ["call", "tel", "phone:", "mobile", "fax", "ring me at", "cell:"], numbers
            return pick(self.grouped(), digits(self.n(7, 16)), digits(16), f"{digits(3)} {digits(3)} {digits(3)}"), numbers, ["call", "ring"]
        if kind == CARD:
            own = digits(15)
            for check in range(10):
                if luhn(own + str(check)) == real:
                    own += str(check)
                    break
            if r.random() < 0.4:
                own = pick(" ", "-", ".").join(own[i : i + 4] for i in range(0, 16, 4))
            return own, ["card", "visa", "credit card", "debit card:", "card no."] if real else numbers, numbers if real else ["card"]
        if kind == SSN:
            return (pick(f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)} {digits(2)} {digits(4)}", digits(9)), ["ssn", "social security", "SSN:", "passport", "tax id"], numbers) if real else (pick(digits(9), f"{digits(3)}-{digits(2)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(3)}"), numbers, ["social"])
        if kind == IBAN:
            body = self.some(4, "ABCDEFGHIKLMNOPQ") + digits(self.n(3, 5) * 4 - 2)
            country = pick("DE", "FR", "ES", "GB", "NL")
            check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
            own = f"{country}{check if real else (check + self.n(1, 90)) % 97:02d}{body}"
            return own if r.random() < 0.5 else " ".join(own[i : i + 4] for i in range(0, len(own), 4)), ["IBAN", "account", "transfer to", "bank:"] if real else numbers, ["bank"] if not real else numbers
        if kind == EMAIL:
            name, host = self.some(self.n(3, 10), "abcdefghijklmnoprstuvw"), self.some(self.n(3, 10), "abcdefghijklmnoprstuvw")
            if real:
                return pick(f"{name} (at) {host} (dot) {pick('com', 'org', 'net', 'de')}", f"{name}[at]{host}.{pick('com', 'org')}", f"{name} at {host} dot {pick('com', 'org', 'net')}"), ["mail", "contact:", "write to", "e-mail"], ["table"]
            return pick(f"look at this dot {name}", f"{name} (at) {digits(2)}.{digits(2)}", f"meet at noon dot {host}", f"x(at){digits(1)}.{digits(1)}"), ["chapter", "price"], ["write"]
        if kind == IP:
            if real:
                return pick(":".join(self.some(self.n(1, 5), "0123456789abcdef") for _ in range(8)), "2001:db8::" + ":".join(self.some(4, "0123456789abcdef") for _ in range(3)), ".".join(str(self.n(0, 256)) for _ in range(4))), ["host", "server", "login from", "client", "ip"], ["version"]
            return pick(".".join(str(self.n(0, 3000)) for _ in range(4)), ":".join(f"{self.n(0, 60):02d}" for _ in range(4)), f"{self.n(1, 9)}.{self.n(0, 30)}.{self.n(0, 30)}.{self.n(256, 5000)}"), ["version", "release", "build", "section", "chapter"], ["server"]
        if kind == BIRTH:
            year = self.n(1930, 2015) if real else self.n(1900, 2026)
            own = pick(f"{self.n(1, 29):02d}/{self.n(1, 13):02d}/{year}", f"{year}-{self.n(1, 13):02d}-{self.n(1, 29):02d}", f"{self.n(1, 29)}.{self.n(1, 13)}.{year}", f"{self.n(1, 29)} {pick('January', 'Mar', 'July', 'Oct')} {year}")
            event = ["published", "updated", "released", "since", "founded", "deadline", "copyright"]
            return (own, ["born", "date of birth", "DOB:", "birthday", "born on"], event) if real else (own, event, ["age"])
        if kind == ADDRESS:
            own = f"{pick(self.n(1, 40), self.n(1, 9999))} {self.pick(*_LAST)} {pick('Street', 'St', 'Avenue', 'Road', 'Lane', 'Drive')}" if real else f"{self.n(1, 20)} {pick('Great', 'New', 'Old', 'First')} {pick('Way', 'Drive', 'Court', 'Square')}"
            return own, ["lives at", "home address", "address:", "deliver to", "resides at"] if real else ["chapter", "total", "table", "section"], ["page"] if real else ["address"]
        if kind == NAME:
            own = f"{pick(*_FIRST)} {pick(*_LAST)}" if real else pick("The House", "Monday", "It", "Chapter Two", "January", "Total", "This Page")
            return own, ["Mr", "Mrs", "Dr", "my name is", "signed,"] if real else ["name:", "contact:", "signed,", "file name:"], ["contact:", "name:"]
        checksum = ["commit", "sha1", "md5", "checksum:", "etag", "build", "digest", "image"]
        if real:
            return self.key(), ['token = "', "api_key: ", 'key="', "password = ", "secret=", "Bearer", "access token"], ["build"]
        word = self.some(self.n(3, 8), "abcdefghijklmnoprstuv")
        return pick(self.key(), self.some(40, "0123456789abcdef"), f"{word}-{word}-{self.n(2, 99)}-{word}{word}", f"{word}/{word}/{word}{digits(2)}/{word}", f"{word}{word}{word}{digits(2)}{word}", "x" * 24 + "1"), checksum + ["https://", "page"], ["key = ", "token: "]

    def text(self, kind: int) -> tuple[str, int, int, bool]:
        """(text, start, end, real) of one thing."""
        real = bool(self.r.random() < 0.5)
        own, fits, strange = self.thing(kind, real)
        draw = self.r.random()
        lead = self.pick(*fits) if draw < 0.7 or kind == NAME else "" if draw < 0.97 else self.pick(*strange)
        glue = "" if lead.endswith(('"', "=", "/")) or not lead else self.pick(" ", " ", ": ", " is ") if kind != NAME else self.pick(" ", ". ") if len(lead) < 4 else " "
        head = self.prose(2, 9) + " " + lead + glue
        end = ('"' if lead.endswith('"') else "") + self.pick(" ", ".", ", ", "\n", "")
        return head + own + end + (" " + self.prose(1, 7) if self.r.random() < 0.8 else ""), len(head), len(head) + len(own), real


def examples(rows: int = TRAIN_ROWS, seed: int = SEED) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, kinds, labels) of the candidates that generators find in generated texts.

    A candidate is right if the text's thing is personal data of its kind and the candidate covers just that.
    """
    make = _Maker(seed)
    x, kinds, y = [], [], []
    for i in range(rows):
        kind = i % len(KINDS)
        text, start, end, real = make.text(kind)
        for c in candidates(text):
            if c[0] < end and start < c[2]:
                x.append(format_features(text, *c))
                kinds.append(c[1])
                y.append(float(real and c[1] == kind and abs(c[0] - start) <= 1 and abs(c[2] - end) <= 1))
    return np.array(x), np.array(kinds), np.array(y)


@cache
def train(rows: int = TRAIN_ROWS, seed: int = SEED) -> list[Trees]:
    """Trees of each kind; a process makes them once, as they are the same every time."""
    x, kinds, y = examples(rows, seed)
    models, fits = [], np.arange(len(y)) < len(y) // 2
    for k in range(len(KINDS)):
        own = kinds == k
        model = boost(x[own & fits], y[own & fits])
        rest, right = x[own & ~fits], y[own & ~fits]
        model.slope, model.shift = _calibrated(model.raw(rest), right)
        p = model.probability(rest)
        order = np.argsort(-p, kind="stable")
        good = np.flatnonzero(np.cumsum(right[order]) / np.arange(1, len(order) + 1) >= PRECISION)
        if len(good):
            model.threshold = max(0.5, float(p[order][good[-1]]))
        models.append(model)
    return models


# texts


class _Taken:
    """Places of a text that spans cover, as sorted parts without overlaps: whether a span is free takes one bisection."""

    def __init__(self, spans: list[tuple[int, int, int]] = ()):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for a, _, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(b, self.ends[-1])
            else:
                self.starts.append(a)
                self.ends.append(b)

    def free(self, a: int, b: int) -> bool:
        i = bisect_left(self.starts, b)
        return i == 0 or self.ends[i - 1] <= a

    def add(self, a: int, b: int) -> None:
        """Adds a span that is free."""
        i = bisect_left(self.starts, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def judged(models: list[Trees], texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[tuple[int, tuple[int, int, int], float]]]:
    """(base spans of each text, candidates that overlap none of them as (text, candidate, probability))."""
    base = [base_spans(t) for t in texts]
    proposed = []
    for i, t in enumerate(texts):
        taken = _Taken(base[i])
        proposed += [(i, c) for c in candidates(t) if taken.free(c[0], c[2])]
    if not proposed:
        return base, []
    kinds = np.array([c[1] for _, c in proposed])
    p = np.empty(len(proposed))
    for k in np.unique(kinds).tolist():
        at = np.flatnonzero(kinds == k)
        p[at] = models[k].probability(np.array([format_features(texts[i], *c) for i, c in (proposed[j] for j in at.tolist())]))
    return base, [(i, c, q) for (i, c), q in zip(proposed, p.tolist())]


def all_spans(models: list[Trees], texts: list[str]) -> tuple[list[list[tuple[int, int, int]]], list[list[tuple[int, int, int]]]]:
    """(base spans, all spans) of each text, each span as (start, kind number, end), in order."""
    base, scored = judged(models, texts)
    out, taken = [list(b) for b in base], {}
    for i, c, p in sorted((s for s in scored if s[2] >= models[s[1][1]].threshold), key=lambda s: (-s[2], s[0], s[1])):
        own = taken.setdefault(i, _Taken())
        if own.free(c[0], c[2]):
            own.add(c[0], c[2])
            out[i].append(c)
    return base, [sorted(o) for o in out]


def _listed(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, k, b in spans)


def _redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    out, at = [], 0
    for a, k, b in spans:
        if b <= at:
            continue
        if a >= at:
            out.append(text[at:a])
            out.append(f"[{KINDS[k].upper()}]")
        at = b
    return "".join([*out, text[at:]])


def find_spans(docs: DataFrame, text_col: str = "text", drop_text: bool = False) -> DataFrame:
    """Adds n_email, n_ip, n_card, n_phone (of base spans), base_sha256 and spans (all, as kind:start:end) to each row."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def make() -> Callable:
        model = shared.value

        def work(texts: list[str]) -> dict:
            base, every = all_spans(model, texts)
            out = {f"n_{kind}": [sum(s[1] == k for s in b) for b in base] for k, kind in enumerate(BASE)}
            out["base_sha256"] = [hashlib.sha256(_listed(b).encode()).hexdigest() for b in base]
            out["spans"] = [_listed(e) for e in every]
            return out

        return work

    return map_texts(docs, make, ", ".join(f"n_{k} long" for k in BASE) + ", base_sha256 string, spans string", text_col, drop_text)


def redact(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Each row with every span of its text replaced by its kind in brackets; all columns stay (null texts too)."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def make() -> Callable:
        model = shared.value

        def work(texts: list[str]) -> dict:
            _, every = all_spans(model, texts)
            return {"_redacted": [_redacted(t, e) if e else t for t, e in zip(texts, every)]}

        return work

    # all columns travel in one struct, whatever their names
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_doc"), F.col(f"`{text_col}`").alias("_text"))
    rows = map_texts(packed, make, "_redacted string", "_text", True)
    own = F.col("_doc").getField
    return rows.select(*[F.when(own(c).isNotNull(), F.col("_redacted")).alias(c) if c == text_col else own(c).alias(c) for c in docs.columns])
