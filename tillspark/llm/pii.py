"""Operator 11: personal data by a semi-Markov conditional random field over candidate spans.

1. Base spans (mail addresses, IPv4 addresses, cards, phones) come from expressions that take time in proportion
   to the text.
2. Around each digit or @ lies a chain: characters without space, and what follows a single space between
   digits or brackets.  Every run of at most ``MAX_TOKENS`` tokens of a chain that can be an entity at all is a
   candidate.  Features are of the whole span: its shape, counts, checksums (Luhn, IBAN), ranges of octets, the
   variety of its characters, the characters about it and cue words before it.
3. The field gives a segmentation of a chain into single outside tokens (score 0) and entities of bounded length
   the sum of its entities' scores.  Weights maximise the likelihood of labelled chains, with the sum over all
   segmentations by the forward and backward recursions.  Chains to learn from are made here, entities and look
   alikes in words of the corpus; besides, chains of at most ``SAMPLE_DOCS`` documents are labelled by their base
   spans (those with a cue before them are left out, as nothing says what they are).
4. Boundaries and types are decoded jointly: the best segmentation that holds all base spans.  Each further span
   must be worth ``CAUTION`` in log odds.

Kinds: the four base ones, of which the field finds further forms (phones without a plus sign, cards of 13 to 15
digits), then secret, iban and ssn.  Counts and ``base_sha256`` are of base spans, ``spans`` has all.

Cases: null texts count as empty; rows that repeat an id give a row each; ties go to the longer, earlier
entity; a text of any length is taken whole, its candidates a block at a time; an empty table gives an empty
result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import random
import re
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged
from .tokens import slices

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "secret", "iban", "ssn")
MAX_TOKENS = 16
CAUTION = 2.0
SAMPLE_DOCS = 2000
#: Chains that are made to learn from, steps of the fit, and its penalty on squared weights.
MADE, STEPS, PENALTY = 4000, 90, 5e-5
#: Candidates that are scored at a time.
BLOCK = 4000

Span = tuple[str, int, int]

# Base spans. A run is only entered at its start, and never given back.
_MAIL = r"[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+"
_MAIL_HERE, _MAIL_LATER = re.compile(_MAIL), re.compile(r"(?<![A-Za-z0-9._%+-])" + _MAIL)
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_NO_DIGIT = str.maketrans("", "", " ().-+")


def luhn(digits: str) -> bool:
    total = sum(map(int, digits[-1::-2])) + sum(2 * int(d) - 9 * (d > "4") for d in digits[-2::-2])
    return total % 10 == 0


def _octets(text: str) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or "0") <= 255 for p in text.split("."))


def _mails(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    while found := (_MAIL_HERE.match(text, at) if at else None) or _MAIL_LATER.search(text, at):
        yield found.span()
        at = found.end()


def base_spans(text: str) -> list[Span]:
    """kind, start and end (code points) by kind, then start."""
    out: list[Span] = []
    if "@" in text:
        out += [("email", s, e) for s, e in _mails(text)]
    if "." in text:
        out += [("ip", *m.span()) for m in _IP.finditer(text) if _octets(m[0])]
    for m in _CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := m[0].translate(_NO_DIGIT)) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= len(m[0].translate(_NO_DIGIT)) <= 15]
    return out


# Chains and candidates.
_ANCHOR = re.compile("[0-9@]")
_CHAIN = re.compile(r"\S++(?:(?<=[0-9)]) (?=[0-9(])\S++)*+")
_TOKEN = re.compile(r"[0-9A-Za-z]+|[^\W0-9A-Za-z_]+|.", re.S)
#: Words that tell what follows, by what it is.
CUES = {
    "secret": ("token", "secret", "password", "passwd", "pwd", "apikey", "api_key", "api-key", "access_key", "auth", "bearer"),
    "phone": ("phone", "tel", "mobile", "call", "fax"),
    "card": ("card", "visa", "amex", "mastercard"),
    "iban": ("iban", "account"),
    "ssn": ("ssn", "social security"),
    "number": ("isbn", "order", "invoice", "id", "no", "ref", "version", "commit", "page", "date"),
}
_CUE = {k: re.compile(r"(?:^|[^a-z])(?:" + "|".join(map(re.escape, words)) + r")[\s\"'.:=#-]{1,4}$") for k, words in CUES.items()}
_BEFORE = 32


def chains(text: str) -> Iterator[tuple[int, int]]:
    end, at = 0, _ANCHOR.search(text)
    while at:
        # back to the last space behind the chain before
        start = max((text.rfind(c, end, at.start()) + 1 for c in " \n\t\r"), default=0)
        start = max(start, end)
        found = _CHAIN.match(text, start)
        while found is None:  # a space of another kind
            start += 1
            found = _CHAIN.match(text, start)
        end = found.end()
        if end > at.start():
            yield start, end
            at = _ANCHOR.search(text, end)
        # else the anchor lies behind a space of another kind: once more from there


def _kind(token: str) -> str:
    if token.isascii() and token.isalnum():
        return "d" if token.isdigit() else "a" if token.isalpha() else "m"
    return token if len(token) == 1 else "w"


def _around(text: str, at: int) -> str:
    if not 0 <= at < len(text):
        return "none"
    c = text[at]
    return "d" if c in "0123456789" else "a" if c.isalpha() else "s" if c.isspace() else c


def _bucket(n: int, *bounds: int) -> int:
    return sum(n >= b for b in bounds)


def _iban(text: str) -> bool:
    bare = text.replace(" ", "").upper()
    if not re.fullmatch("[A-Z]{2}[0-9]{2}[0-9A-Z]{11,30}", bare):
        return False
    return int("".join(str(int(c, 36)) for c in bare[4:] + bare[:4])) % 97 == 1


class Candidate:
    """A span of a text and its features."""

    __slots__ = ("start", "end", "features")

    def __init__(self, start: int, end: int, features: list[str]) -> None:
        self.start, self.end, self.features = start, end, features


def _features(text: str, start: int, end: int, tokens: list[str], cues: list[str]) -> list[str]:
    span = text[start:end]
    kinds = [_kind(t) for t in tokens]
    n_digits, n_at = sum(c in "0123456789" for c in span), span.count("@")
    one = len(tokens) == 1
    n_letters = sum(c.isalpha() for c in span)
    shape = "".join(k + str(min(len(t), 9)) if k == "d" else k for k, t in zip(kinds, tokens, strict=True))
    digits = "".join(c for c in span if c in "0123456789")
    plain = not n_letters and all(k in "d -" for k in kinds)
    out = [
        "one", f"shape={shape}", f"digits={min(n_digits, 20)}", f"letters={_bucket(n_letters, 1, 3, 8, 20)}", f"at={n_at}", f"tokens={len(tokens)}",
        f"length={_bucket(len(span), 8, 11, 14, 17, 20, 28, 40, 64)}", f"first={kinds[0]}", f"last={kinds[-1]}", f"before={_around(text, start - 1)}", f"after={_around(text, end)}", f"edges={_around(text, start - 1)}{kinds[0]}{kinds[-1]}{_around(text, end)}",
        *(f"cue={c}" for c in cues or ["none"]), *(f"cue={c}&shape={shape}" for c in cues if c != "secret"),
    ]
    if n_at:
        out.append(f"mail={bool(_MAIL_HERE.fullmatch(span))}{kinds[-1]}")
    if kinds == ["d", ".", "d", ".", "d", ".", "d"]:
        out.append(f"octets={_octets(span)}")
    if plain and 13 <= n_digits <= 19:
        out.append(f"luhn={luhn(digits)}{_bucket(n_digits, 15, 16)}&lead={digits[0] in '3456'}")
    if kinds[0] in "am" and n_digits >= 10 and all(k in "dma " for k in kinds):
        out.append(f"iban={_iban(span)}")
    if one and n_letters:
        variety = len(set(span)) / min(len(span), 36)
        case = ("x" if re.fullmatch("[0-9a-fA-F]+", span) else "l") + kinds[0]
        out += [f"variety={_bucket(int(10 * variety), 3, 5)}", f"case={case}", *(f"cue={c}&case={case}&length={_bucket(len(span), 16, 24)}" for c in cues or ["none"])]
    return out


def _opens(text: str, at: int) -> bool:
    """Whether an entity can start here: not within a word, nor behind what joins it to one."""
    if at == 0:
        return True
    c = text[at - 1]
    return not (c.isalnum() or c == "_" or (c in ".-@+%/" and at > 1 and text[at - 2].isalnum()))


def _shuts(text: str, end: int) -> bool:
    if end == len(text):
        return True
    c = text[end]
    return not (c.isalnum() or c == "_" or (c in ".-@+%/" and end + 1 < len(text) and text[end + 1].isalnum()))


def candidates(text: str, start: int, end: int) -> Iterator[Candidate]:
    """The candidates of a chain: whole words of it that can be an entity at all.

    An entity has a domain behind an @, four octets, at least seven digits, or eight characters behind a cue; and
    numbers with points in them aren't joined by spaces.
    """
    held: list[tuple[str, int]] = []
    tokens = _TOKEN.finditer(text, start, end)
    first = 0
    ended = False
    while True:
        while len(held) < first + MAX_TOKENS and not ended:
            m = next(tokens, None)
            ended = m is None
            if m:
                held.append((m[0], m.start()))
        if first >= len(held):
            return
        token, at = held[first]
        if (token[0] in "+(" or (token.isascii() and token.isalnum())) and _opens(text, at):
            cues = None
            n_digits = n_at = n_dots = 0
            spaced = mailed = False
            for last in range(first, min(len(held), first + MAX_TOKENS)):
                word, begin = held[last]
                if not (word.isascii() and word.isalnum()):
                    n_at += word == "@"
                    n_dots += word == "."
                    mailed |= n_at == 1 and word == "."
                    spaced |= word == " "
                    if spaced and n_dots:
                        break
                    continue
                n_digits += sum(map(word.count, "0123456789"))
                stop = begin + len(word)
                if not (mailed or n_digits >= 7 or (n_digits >= 4 and n_dots == 3) or (last == first and len(word) >= 8)) or not _shuts(text, stop):
                    continue
                if cues is None:
                    before = text[max(0, at - _BEFORE) : at].lower()
                    cues = [k for k, p in _CUE.items() if p.search(before)]
                if mailed or n_digits >= 7 or n_dots == 3 or cues:
                    yield Candidate(at, stop, _features(text, at, stop, [t for t, _ in held[first : last + 1]], cues))
        first += 1
        if first == 4096:  # what lies before is no longer needed
            held, first = held[first:], 0


# The field.
class Field:
    """Weights of features by kind; a span's score is the sum of its features' weights."""

    def __init__(self, index: dict[str, int], weights: np.ndarray) -> None:
        self.index, self.weights = index, weights

    def rows(self, found: list[Candidate]) -> tuple[np.ndarray, np.ndarray]:
        """Features that are known, flat, and where each candidate's begin."""
        flat, begins = [], []
        for c in found:
            begins.append(len(flat))
            flat += [k for f in c.features if (k := self.index.get(f)) is not None]
        return np.array(flat, np.int64), np.array(begins, np.int64)

    def scores(self, found: list[Candidate]) -> np.ndarray:
        """Candidates by kinds; every candidate has a known feature."""
        flat, begins = self.rows(found)
        return np.add.reduceat(self.weights[flat], begins, axis=0) if len(found) else np.zeros((0, len(KINDS)))


def marginals(ends: list[tuple[int, int]], scores: list[float]) -> tuple[float, np.ndarray]:
    """Log of the sum over all segmentations, and the probability of each candidate (start, end; any places).

    Tokens outside entities score 0, so that only the places at which candidates start or end count.
    """
    places = sorted({p for span in ends for p in span})
    at = {p: k for k, p in enumerate(places)}
    opens: list[list[int]] = [[] for _ in places]
    closes: list[list[int]] = [[] for _ in places]
    for c, (s, e) in enumerate(ends):
        opens[at[s]].append(c)
        closes[at[e]].append(c)

    def total(values: list[float]) -> float:
        top = max(values)
        return top + math.log(sum(math.exp(v - top) for v in values))

    forward, backward = [0.0] * len(places), [0.0] * len(places)
    for k in range(1, len(places)):
        forward[k] = total([forward[k - 1], *(forward[at[ends[c][0]]] + scores[c] for c in closes[k])])
    for k in range(len(places) - 2, -1, -1):
        backward[k] = total([backward[k + 1], *(backward[at[ends[c][1]]] + scores[c] for c in opens[k])])
    whole = forward[-1] if places else 0.0
    return whole, np.array([math.exp(forward[at[s]] + x + backward[at[e]] - whole) for (s, e), x in zip(ends, scores, strict=True)])


def fit(labelled: Iterable[tuple[str, list[Span]]]) -> Field:
    """The field from texts and their entities, by full gradients with step sizes of Adam."""
    groups: list[list[Candidate]] = []
    gold: list[tuple[int, int]] = []
    n = 0
    for text, spans in labelled:
        wanted = {(s, e): KINDS.index(k) for k, s, e in spans}
        for a, b in chains(text):
            if found := list(candidates(text, a, b)):
                gold += [(n + k, wanted[c.start, c.end]) for k, c in enumerate(found) if (c.start, c.end) in wanted]
                groups.append(found)
                n += len(found)
    every = [c for g in groups for c in g]
    index: dict[str, int] = {}
    for c in every:
        for f in c.features:
            index.setdefault(f, len(index))
    weights = np.zeros((len(index), len(KINDS)))
    field = Field(index, weights)
    if not every:
        return field
    weights[index["one"]] = -3.0
    flat, begins = field.rows(every)
    of = np.repeat(np.arange(n), np.diff([*begins, len(flat)]))
    truth = np.zeros((n, len(KINDS)))
    for k, kind in gold:
        truth[k, kind] = 1
    first, second = np.zeros_like(weights), np.zeros_like(weights)
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(weights[flat], begins, axis=0)
        top = scores.max(axis=1)
        joint = top + np.log(np.exp(scores - top[:, None]).sum(axis=1))
        seen = np.empty(n)
        at = 0
        for g in groups:
            seen[at : at + len(g)] = marginals([(c.start, c.end) for c in g], joint[at : at + len(g)].tolist())[1]
            at += len(g)
        expected = seen[:, None] * np.exp(scores - joint[:, None])
        gradient = PENALTY * weights * len(groups)
        np.add.at(gradient, flat, (expected - truth)[of])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient**2
        weights -= 0.3 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.99**step)) + 1e-6)
    return field


def decode(base: list[Span], found: list[tuple[int, int, int, float]]) -> list[Span]:
    """The best segmentation with all ``base`` spans: of candidates (start, end, kind, score above 0) that meet
    none of them, those with the largest sum that don't overlap."""
    taken = sorted((s, e) for _, s, e in base)
    starts = [s for s, _ in taken]
    # base spans of several kinds may overlap: the furthest end up to each
    furthest = list(np.maximum.accumulate([e for _, e in taken])) if taken else []
    free = [c for c in found if not (k := int(np.searchsorted(starts, c[1]))) or furthest[k - 1] <= c[0]]
    free.sort(key=lambda c: (c[1], -c[0]))
    ends = [c[1] for c in free]
    best, choice = [0.0], []
    for c in free:
        before = int(np.searchsorted(ends, c[0], side="right"))
        with_it = best[before] + c[3]
        choice.append(with_it > best[-1])
        best.append(max(with_it, best[-1]))
    out: list[Span] = list(base)
    k = len(free)
    while k:
        if choice[k - 1]:
            s, e, kind, _ = free[k - 1]
            out.append((KINDS[kind], s, e))
            k = int(np.searchsorted(ends, s, side="right"))
        else:
            k -= 1
    return sorted(out, key=lambda x: (KINDS.index(x[0]), x[1]))


def spans(text: str, field: Field, base: list[Span] | None = None) -> list[Span]:
    """All spans of a text by kind, then start."""
    base = base_spans(text) if base is None else base
    good: list[tuple[int, int, int, float]] = []
    block: list[Candidate] = []

    def score() -> None:
        scores = field.scores(block) - CAUTION
        kind = scores.argmax(axis=1)
        for k in np.flatnonzero(scores.max(axis=1) > 0):
            good.append((block[k].start, block[k].end, int(kind[k]), float(scores[k, kind[k]])))
        block.clear()

    for a, b in chains(text):
        for c in candidates(text, a, b):
            block.append(c)
            if len(block) >= BLOCK:
                score()
    score()
    return decode(base, good)


# What is learned from.
def _digits(r: random.Random, n: int) -> str:
    return "".join(r.choice("0123456789") for _ in range(n))


def _checked(r: random.Random, n: int, good: bool) -> str:
    body = r.choice("3456") + _digits(r, n - 2)
    last = next(d for d in "0123456789" if luhn(body + d))
    return body + (last if good else str((int(last) + r.randint(1, 9)) % 10))


def _parted(text: str, by: str, *sizes: int) -> str:
    out, at = [], 0
    for n in sizes:
        out.append(text[at : at + n])
        at += n
    return by.join(p for p in out if p)


def _word(r: random.Random, words: list[str]) -> str:
    return r.choice(words)


def _name(r: random.Random) -> str:
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(3, 9)))


def _made_iban(r: random.Random, good: bool = True) -> str:
    country = r.choice(("DE", "FR", "GB", "ES"))
    body = ("" if country in ("DE", "ES") else "".join(r.choice("ABCDEFGHJKLM") for _ in range(4))) + _digits(r, r.choice((16, 18, 20)))
    check = 98 - int("".join(str(int(c, 36)) for c in body + country + "00")) % 97
    return country + f"{check if good else (check + r.randint(1, 60)) % 97:02d}" + body


_SECRET_CUES = ("token = ", "token: ", "secret = ", "password: ", "passwd=", "api_key = ", "apikey: ", "access_key=", "auth: ", "bearer ")


def _secret(r: random.Random) -> str:
    kind = r.random()
    letters = "0123456789abcdef" if kind < 0.5 else "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
    body = "".join(r.choice(letters) for _ in range(r.choice((16, 20, 24, 32, 36, 40, 48, 64))))
    return body if any(c.isdigit() for c in body) else body[:-1] + "7"


#: By kind: a maker of what stands before an entity, and the entity.
_ENTITIES: dict[str, Callable[[random.Random], tuple[str, str]]] = {
    "email": lambda r: ("", f"{_name(r)}{r.choice(('', '.' + _name(r), '.' + _digits(r, 2), '+' + _name(r)))}@{_name(r)}{r.choice(('', '-' + _name(r), _digits(r, 1)))}.{r.choice(('com', 'org', 'example.com', 'co.uk', 'de'))}"),
    "ip": lambda r: ("", ".".join(str(r.randint(0, 255)) for _ in range(4))),
    "card": lambda r: (r.choice(("", "", "card: ", "visa ")), r.choice((_checked(r, 16, True), _parted(_checked(r, 16, True), r.choice(" -"), 4, 4, 4, 4), _parted(_checked(r, 15, True), " ", 4, 6, 5), _checked(r, 15, True)))),
    "phone": lambda r: (r.choice(("", "", "", "tel: ", "phone: ", "call ")), r.choice((f"+1 ({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"({_digits(r, 3)}) {_digits(r, 3)}-{_digits(r, 4)}", f"+{r.choice((44, 49, 33, 34))} {_digits(r, 2)} {_digits(r, 4)} {_digits(r, 4)}", f"+{r.choice((44, 49, 33))}{_digits(r, 10)}"))),
    "secret": lambda r: (r.choice(_SECRET_CUES) + r.choice(('"', "'", "")), _secret(r)),
    "iban": lambda r: (r.choice(("", "iban: ", "account ")), (lambda x: _parted(x, " ", 4, 4, 4, 4, 4, 4) if x[4:].isdigit() and r.random() < 0.5 else x)(_made_iban(r))),
    "ssn": lambda r: (r.choice(("ssn: ", "ssn ", "social security: ")), f"{r.randint(100, 665)}-{r.randint(10, 99)}-{r.randint(1000, 9999)}"),
}
#: Look-alikes.
_OTHERS: list[Callable[[random.Random], str]] = [
    lambda r: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d}",
    lambda r: f"{r.randint(1900, 2030)}-{r.randint(1, 12):02d}-{r.randint(1, 28):02d} {r.randint(0, 23):02d}:{r.randint(0, 59):02d}:{r.randint(0, 59):02d}",
    lambda r: f"{r.randint(1, 28):02d}/{r.randint(1, 12):02d}/{r.randint(1900, 2030)}",
    lambda r: ".".join(str(r.randint(0, 40)) for _ in range(r.choice((2, 3)))),
    lambda r: f"{r.randint(1, 9999)}.{_digits(r, r.randint(1, 9))}",
    lambda r: f"{r.randint(1, 999)},{_digits(r, 3)},{_digits(r, 3)}",
    lambda r: f"isbn 978-{r.randint(0, 9)}-{_digits(r, 2)}-{_digits(r, 6)}-{r.randint(0, 9)}",
    lambda r: r.choice(("order ", "id ", "ref ", "", "")) + r.choice("12345789") + _digits(r, r.randint(6, 11)),
    lambda r: r.choice(("order ", "id ", "", "")) + _checked(r, r.choice((13, 14, 15, 16, 17, 19)), False),
    lambda r: _digits(r, r.randint(20, 40)),
    lambda r: r.choice(("commit ", "", "sha ")) + "".join(r.choice("0123456789abcdef") for _ in range(r.choice((8, 12, 16, 20, 32, 40, 64)))),
    lambda r: "-".join("".join(r.choice("0123456789abcdef") for _ in range(n)) for n in (8, 4, 4, 4, 12)),
    lambda r: f"{r.randint(1, 99)} + {r.randint(1, 99)} = {r.randint(1, 199)}",
    lambda r: f"{r.randint(1, 999)}-{r.randint(1, 9999)}",
    lambda r: f"{r.randint(-90, 90)}.{_digits(r, 4)}, {r.randint(-180, 180)}.{_digits(r, 6)}",
    lambda r: f"@{_name(r)}{_digits(r, 2)}",
    lambda r: f"{_name(r)}@{_name(r)}",
    lambda r: ".".join(str(r.choice((r.randint(256, 999), r.randint(0, 255)))) for _ in range(3)) + f".{r.randint(256, 999)}",
    lambda r: r.choice(_SECRET_CUES) + str(r.randint(0, 99999)),
    lambda r: f"{r.randint(2000, 2030)}{r.randint(1, 12):02d}{r.randint(1, 28):02d}{_digits(r, 6)}",
    lambda r: _made_iban(r, False),
    lambda r: f"{_digits(r, 3)}-{_digits(r, 2)}-{_digits(r, 4)}",
    lambda r: " ".join(_digits(r, r.randint(1, 5)) for _ in range(r.randint(2, 8))),
    lambda r: f"{_name(r)}{_digits(r, 2)}.{_name(r)}{_digits(r, 3)}.{_name(r)}",
]


def made(words: list[str], n: int, seed: int = 11) -> Iterator[tuple[str, list[Span]]]:
    """Texts with an entity or a look-alike among ``words``, and the entities."""
    r = random.Random(seed)
    kinds = list(_ENTITIES)
    for k in range(n):
        lead = " ".join(_word(r, words) for _ in range(r.randint(0, 3)))
        lead += " " if lead else ""
        tail = r.choice(("", ".", ",", '"', ")", "\n")) + " " + " ".join(_word(r, words) for _ in range(r.randint(0, 2)))
        if k % 2:
            yield lead + r.choice(_OTHERS)(r) + (tail if tail[:1] in ".,\n)" else " " + tail), []
        else:
            kind = kinds[k // 2 % len(kinds)]
            cue, entity = _ENTITIES[kind](r)
            quote = cue[-1] if cue[-1:] in ('"', "'") else ""
            start = len(lead) + len(cue)
            tail = quote + (tail if tail[:1] in ".,\n)" else " " + tail)
            yield lead + cue + entity + tail, [(kind, start, start + len(entity))]


_LATIN = re.compile("[A-Za-zÀ-ÿ]{2,12}")


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Chains with what stands about them, and where they have no cue, their base spans."""
    for batch in batches:
        for text in batch.column(0).to_pylist():
            base = base_spans(text)
            rows = []
            for a, b in chains(text):
                if b - a > 200 or len(rows) >= 20:
                    continue
                begin, end = max(0, a - _BEFORE), min(len(text), b + 1)
                own = [(k, s - begin, e - begin) for k, s, e in base if a <= s and e <= b]
                if not any(p.search(text[begin:m.start()].lower()) for p in _CUE.values() for m in _TOKEN.finditer(text, a, b)):
                    rows.append((text[begin:end], "\n".join(f"{k}:{s}:{e}" for k, s, e in own)))
            words = " ".join(m[0] for _, m in zip(range(20), _LATIN.finditer(text), strict=False))
            texts, found = zip(*rows, strict=True) if rows else ((), ())
            yield pa.RecordBatch.from_arrays([pa.array([words, *texts], pa.string()), pa.array([None, *found], pa.string())], ["text", "base"])


def trained(docs: DataFrame) -> Field:
    """The field for ``docs``; what it learns from is of bounded size."""
    ids = staged(docs.where("doc_id IS NOT NULL").select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE_DOCS).distinct(), "sample")
    some = docs.where("text IS NOT NULL").join(F.broadcast(ids), "doc_id", "left_semi").select("text")
    rows = some.mapInArrow(_sampled, "text string, base string").orderBy(F.xxhash64("text", "base"), "text", "base").limit(10 * SAMPLE_DOCS).collect()
    words = sorted({w for r in rows if r["base"] is None for w in r["text"].split()}) or ["and"]
    own = [(r["text"], [(k, int(s), int(e)) for k, s, e in (x.split(":") for x in r["base"].split("\n") if x)]) for r in rows if r["base"] is not None]
    return fit([*made(words, MADE), *own[:MADE]])


def _digest(found: Iterable[Span]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in found)


_NOTHING = hashlib.sha256(b"").hexdigest()


def _scanned(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*shared.value)
        for batch in batches:
            at = 0
            for part in slices(batch.column(1), 4_000_000):
                doc_ids = batch.column(0).slice(at, len(part))
                at += len(part)
                n = len(part)
                counts = np.zeros((4, n), np.int64)
                digest, shown = [_NOTHING] * n, [""] * n
                where = np.flatnonzero(pc.fill_null(pc.match_substring_regex(part, "[0-9@]"), False).to_numpy(zero_copy_only=False))
                for k, text in zip(where, part.take(pa.array(where)).to_pylist(), strict=True):
                    base = base_spans(text)
                    for kind, _, _ in base:
                        counts[BASE_KINDS.index(kind), k] += 1
                    digest[k] = hashlib.sha256(_digest(base).encode()).hexdigest()
                    shown[k] = _digest(spans(text, field, base))
                yield pa.RecordBatch.from_arrays([doc_ids, *map(pa.array, counts), pa.array(digest, pa.string()), pa.array(shown, pa.string())], ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    return run


def personal_data(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans."""
    field = trained(docs)
    shared = docs.sparkSession.sparkContext.broadcast((field.index, field.weights))
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return rows.mapInArrow(_scanned(shared), f"doc_id {kind}, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")
