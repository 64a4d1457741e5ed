"""Personal data, found by fixed patterns and by a semi-Markov conditional random field.

Only lines that hold what personal data need (seven digits, ``@``, or a spelled-out
one) are cut into tokens; as no segment crosses a line, the best segmentation is
that of the whole text.  The field scores whole candidate segments: shape of
the whole span, its digits, its separators, checksums and the words around it.
Dynamic programming over segments of bounded length chooses boundaries and types
together.  Weights are fitted by conditional likelihood to labelled sentences
written by a seeded generator.  Spans of the patterns always stay; the field
adds those that the patterns miss.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import random
import re
from functools import lru_cache

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_texts, table

KINDS = ("email", "ip", "card", "phone")

# The patterns of the base spans.
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        if i % 2:
            d = 2 * d - 9 * (d > 4)
        total += d
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches: a match starts where the run of local characters before an @ does."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > last and text[start - 1] in _LOCAL:
            start -= 1
        if start < at and (m := _DOMAIN.match(text, at + 1)):
            out.append((start, m.end()))
            last = m.end()
        at = text.find("@", max(at + 1, last))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four parts at a time of each run of numbers and dots."""
    out = []
    for m in _DOTTED.finditer(text):
        parts = m[0].split(".")
        at = m.start()
        for i in range(0, len(parts) - 3, 4):
            four = parts[i : i + 4]
            end = at + sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-4:].lstrip("0") or 0) <= 255 for p in four):
                out.append((at, end))
            at = end + 1
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for m in _CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append(m.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in _PHONE.finditer(text) if 9 <= sum(c.isdigit() for c in m[0]) <= 15]


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) by start, then by kind as listed."""
    out = []
    if "@" in text:
        out += [(*s, 0) for s in emails(text)]
    if _DIGIT.search(text):
        out += [(*s, 1) for s in ips(text)] + [(*s, 2) for s in cards(text)]
        if "+" in text:
            out += [(*s, 3) for s in phones(text)]
    return [(a, b, KINDS[k]) for a, b, k in sorted(out, key=lambda s: (s[0], s[2]))]


_DIGIT = re.compile(r"[0-9]")
_TOKEN = re.compile(r"[0-9]+|[A-Za-z]+|[^\s]|[ \t]+|\n")
#: What a line must hold for any segment in it to be a candidate.
_NEEDED = re.compile(r"@|[\[(](?i:at)[\])]|(?:[0-9][^0-9\n]*){7}")
_AT = re.compile(r"@|[\[(](?i:at)[\])]")
#: An address, its signs as such or spelled out.
_ADDRESS = re.compile(r"[A-Za-z0-9._%+-]+ ?(?:@|[\[(] ?(?i:at) ?[\])]) ?[A-Za-z0-9-]+(?:(?:[.]| ?[\[(] ?(?i:dot) ?[\])] ?)[A-Za-z0-9-]+)+")
#: Digits that a candidate without an at sign holds at least.
_DIGITS = 7
#: Tokens of the longest segment.
MAX_SEGMENT = 16
#: Characters of the longest segment.
MAX_CHARS = 320
_CUES = {
    "phone": frozenset("phone tel telephone call calling mobile cell fax whatsapp ring dial telefon telefonnummer handy mobil anrufen ruf rufnummer telefono teléfono móvil movil llamar llame téléphone tél portable appeler appelez".split()),
    "card": frozenset("card visa mastercard amex credit debit karte kreditkarte tarjeta crédito carte crédit bancaire".split()),
    "email": frozenset("email mail contact write e-mail reach kontakt schreiben schreib correo escribir escribe courriel écrire écrivez contacter".split()),
    "ip": frozenset("ip host server address ping addr adresse dirección".split()),
}


def lines_of_interest(text: str) -> list[tuple[int, int]]:
    """Lines in which a segment can be a candidate, without their line feeds."""
    out, at = [], 0
    while m := _NEEDED.search(text, at):
        a = text.rfind("\n", at, m.start()) + 1 or at
        b = text.find("\n", m.end())
        b = len(text) if b < 0 else b
        out.append((a, b))
        at = b + 1
    return out


def segment_features(text: str, toks: list[tuple[int, int]], i: int, j: int) -> list[str] | None:
    """Features of the span of tokens i..j-1 as a whole; None where no entity can begin and end so."""
    first, last = text[toks[i][0]], text[toks[j - 1][1] - 1]
    if not (first.isascii() and (first.isalnum() or first in "+(")) or not (last.isascii() and last.isalnum()):
        return None
    a, b = toks[i][0], toks[j - 1][1]
    if b - a > MAX_CHARS:
        return None
    before = text[a - 1] if a else " "
    after = text[b] if b < len(text) else " "
    if before.isalnum() or after.isalnum():
        return None
    span = text[a:b]
    if "\n" in span:
        return None
    digits = [c for c in span if c.isdigit() and c.isascii()]
    n = len(digits)
    at = _AT.search(span) is not None
    if n < _DIGITS and not at:
        return None
    words = tuple(re.findall(r"[a-zß-öø-ÿ-]+", text[max(0, a - 24) : a].lower())[-3:])
    return _features(span, before, after, after == "." and b + 1 < len(text) and text[b + 1].isalnum(), words)


@lru_cache(maxsize=1 << 16)
def _features(span: str, before: str, after: str, glued: bool, words: tuple[str, ...]) -> list[str]:
    """Features of a candidate, which nothing else depends on; dense texts ask for the same ones again."""
    first = span[0]
    digits = [c for c in span if c.isdigit() and c.isascii()]
    n = len(digits)
    at = _AT.search(span) is not None
    letters = sum(c.isalpha() for c in span)
    shape = re.sub(r"[A-Za-z]+", "a", re.sub(r"[0-9]+", "9", span))
    groups = [len(g) for g in re.findall(r"[0-9]+", span)]
    out = [
        "bias",
        f"at={at}",
        f"letters={letters > 0}",
        f"digits={n if n < 7 else '7-8' if n < 9 else '9-11' if n < 12 else '12-19' if n < 20 else '20+'}",
        f"plus={first == '+'}",
        f"paren={first == '('}",
        f"open={before in _OPENS or after in _CLOSES}",
        f"glued={glued}",
    ]
    if not at:
        # The shape of an address says as much as its separators could.
        out += [f"dots={min(shape.count('.'), 4)}", f"spaces={min(span.count(' '), 4)}", f"dashes={min(span.count('-'), 4)}"]
    if not letters and not at:
        out += [
            f"groups={'-'.join(map(str, groups[:6]))}",
            f"luhn={12 <= n <= 19 and luhn(''.join(digits))}",
            f"octets={len(groups) == 4 and all(int(g) <= 255 for g in re.findall(r'[0-9]{1,3}', span)) and shape.count('.') == 3}",
            f"one={len(groups) == 1}",
            f"odd={any(c not in '0123456789 ().+-/' for c in span)}",
            f"slashes={min(span.count('/'), 2)}",
        ]
    if at:
        mail = _ADDRESS.fullmatch(span) is not None
        spelled = "spelled" if mail and "@" not in span else "sign"
        out += [f"mail={mail}", f"ats={min(span.count('@'), 2)}"]
        out += [f"form={spelled}, {'dots' if '.' in span[_AT.search(span).end():] else 'spelled dots'}"] if mail else []
    return out + [f"cue={k}" for k, cues in _CUES.items() if any(w in cues for w in words)]


def lattice(text: str, start: int = 0, end: int | None = None) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[str]]]]:
    """Tokens of a text from start to end, and the candidate segments (first token, end token, features).

    Only token runs that hold enough digits or an at sign are looked at; no other
    run can be a candidate.
    """
    end = len(text) if end is None else end
    toks = [m.span() for m in _TOKEN.finditer(text, start, end)]
    n = len(toks)
    if not n:
        return [], []
    begins = np.array([a for a, _ in toks])
    firsts = [text[a] for a, _ in toks]
    digits = np.concatenate(([0], np.cumsum([b - a if "0" <= c <= "9" else 0 for (a, b), c in zip(toks, firsts, strict=True)])))
    enough = np.searchsorted(digits, digits[:-1] + _DIGITS)
    ats = [m.span() for m in _AT.finditer(text, start, end)]
    at_from = np.searchsorted(begins, [a for a, _ in ats], "right") - 1
    at_to = np.searchsorted(begins, [b - 1 for _, b in ats], "right")
    at_end = np.append(at_to, n + 1)[np.searchsorted(at_from, np.arange(n))]
    breaks = np.append([i for i, c in enumerate(firsts) if c == "\n"], n).astype(np.int64)
    last = np.minimum(np.arange(n) + MAX_SEGMENT, breaks[np.searchsorted(breaks, np.arange(n))])
    first = np.minimum(enough, at_end)
    segments = []
    plain = _Plain(text, toks, start)
    for i in np.flatnonzero(first <= last).tolist():
        with_at = int(at_end[i])
        for j in range(int(first[i]), int(last[i]) + 1):
            f = segment_features(text, toks, i, j) if j >= with_at else plain.features(i, j)
            if f is not None:
                segments.append((i, j, f))
    return toks, segments


class _Plain:
    """Features of token runs without an at sign, from running counts over the tokens; what segment_features() says of them."""

    def __init__(self, text: str, toks: list[tuple[int, int]], start: int):
        self.text, self.toks = text, toks
        digits, letters, dots, spaces, dashes, slashes, odd, gaps, groups = [0], [0], [0], [0], [0], [0], [0], [0], [0]
        self.sizes: list[int] = []
        before = start
        for a, b in toks:
            c = text[a]
            number = "0" <= c <= "9"
            if number:
                self.sizes.append(b - a)
            digits.append(digits[-1] + (b - a if number else 0))
            groups.append(groups[-1] + number)
            letters.append(letters[-1] + (0 if number else c.isalpha()))
            dots.append(dots[-1] + (c == "."))
            spaces.append(spaces[-1] + (text.count(" ", a, b) if c in " \t" else 0))
            dashes.append(dashes[-1] + (c == "-"))
            slashes.append(slashes[-1] + (c == "/"))
            odd.append(odd[-1] + (not number and c not in "().+-/" and text.count(" ", a, b) < b - a))
            gaps.append(gaps[-1] + (a > before))
            before = b
        self.digits, self.letters, self.dots, self.spaces, self.dashes, self.slashes, self.odd, self.gaps, self.groups = digits, letters, dots, spaces, dashes, slashes, odd, gaps, groups

    def features(self, i: int, j: int) -> list[str] | None:
        text = self.text
        a, b = self.toks[i][0], self.toks[j - 1][1]
        first, last = text[a], text[b - 1]
        if not (first.isascii() and (first.isalnum() or first in "+(")) or not (last.isascii() and last.isalnum()) or b - a > MAX_CHARS:
            return None
        before = text[a - 1] if a else " "
        after = text[b] if b < len(text) else " "
        n = self.digits[j] - self.digits[i]
        if before.isalnum() or after.isalnum() or n < _DIGITS:
            return None
        letters = self.letters[j] > self.letters[i]
        dots = self.dots[j] - self.dots[i]
        out = [
            "bias",
            "at=False",
            "letters=True" if letters else "letters=False",
            "digits=7-8" if n < 9 else "digits=9-11" if n < 12 else "digits=12-19" if n < 20 else "digits=20+",
            "plus=True" if first == "+" else "plus=False",
            "paren=True" if first == "(" else "paren=False",
            "open=True" if before in _OPENS or after in _CLOSES else "open=False",
            "glued=True" if after == "." and b + 1 < len(text) and text[b + 1].isalnum() else "glued=False",
            f"dots={min(dots, 4)}",
            f"spaces={min(self.spaces[j] - self.spaces[i], 4)}",
            f"dashes={min(self.dashes[j] - self.dashes[i], 4)}",
        ]
        if not letters:
            g, h = self.groups[i], self.groups[j]
            odd = self.odd[j] > self.odd[i] or self.gaps[j] > self.gaps[i + 1]
            digits = "".join([c for c in text[a:b] if "0" <= c <= "9"]) if 12 <= n <= 19 else ""
            out += [
                "groups=" + "-".join([str(x) for x in self.sizes[g : min(h, g + 6)]]),
                "luhn=True" if digits and luhn(digits) else "luhn=False",
                f"octets={h - g == 4 and dots == 3 and all(int(x) <= 255 for x in re.findall(r'[0-9]{1,3}', text[a:b]))}",
                "one=True" if h - g == 1 else "one=False",
                "odd=True" if odd else "odd=False",
                f"slashes={min(self.slashes[j] - self.slashes[i], 2)}",
            ]
        return out + _cues(text[max(0, a - 24) : a])


_OPENS, _CLOSES = "+@.-_/:=#$(", "@_/=-"


def _cues(before: str) -> list[str]:
    """The kinds that one of the three words before a span hints at."""
    words = re.findall(r"[a-zß-öø-ÿ-]+", before.lower())[-3:] if before.strip(" 0123456789") else []
    return [f"cue={k}" for k, cues in _CUES.items() if any(w in cues for w in words)] if words else []


class Field:
    """Weights by (feature, kind); a token outside all segments scores zero."""

    def __init__(self, weights: dict[str, np.ndarray] | None = None):
        self.weights = weights or {}
        self.rows: dict[str, int] = {}
        self.table: np.ndarray | None = None

    def scores(self, segments) -> np.ndarray:
        """Of each segment and kind, the sum of its features' weights."""
        if not segments:
            return np.zeros((0, len(KINDS)))
        if self.table is None:
            self.rows = {f: i for i, f in enumerate(self.weights)}
            self.table = np.array([*self.weights.values(), np.zeros(len(KINDS))])
        none = len(self.table) - 1
        get = self.rows.get
        flat = np.array([get(f, none) for _, _, fs in segments for f in fs])
        sizes = np.array([len(fs) for _, _, fs in segments])
        return np.add.reduceat(self.table[flat], np.cumsum(sizes) - sizes)

    def decode(self, text: str, start: int = 0, end: int | None = None) -> list[tuple[int, int, str]]:
        """Best segmentation of a text from start to end; what stands around that part counts as context."""
        toks, segments = lattice(text, start, end)
        if not segments:
            return []
        scores = self.scores(segments)
        kinds, values = scores.argmax(axis=1).tolist(), scores.max(axis=1).tolist()
        ending: dict[int, list[int]] = {}
        for s, (_, j, _) in enumerate(segments):
            ending.setdefault(j, []).append(s)
        best = [0.0] * (len(toks) + 1)
        back: list[tuple[int, int] | None] = [None] * (len(toks) + 1)
        for j in range(1, len(toks) + 1):
            best[j] = best[j - 1]
            for s in ending.get(j, ()):
                if (v := best[segments[s][0]] + values[s]) > best[j]:
                    best[j], back[j] = v, (s, kinds[s])
        out, j = [], len(toks)
        while j > 0:
            if back[j] is None:
                j -= 1
                continue
            s, k = back[j]
            i = segments[s][0]
            out.append((toks[i][0], toks[j - 1][1], KINDS[k]))
            j = i
        return out[::-1]


def expectations(n: int, segments, scores: np.ndarray) -> tuple[float, np.ndarray]:
    """Log partition and marginals of (segment, kind), by forward and backward sums over segment ends."""
    ending: dict[int, list[int]] = {}
    starting: dict[int, list[int]] = {}
    for s, (i, j, _) in enumerate(segments):
        ending.setdefault(j, []).append(s)
        starting.setdefault(i, []).append(s)
    total = np.logaddexp.reduce(scores, axis=1) if len(segments) else np.zeros(0)
    ahead = np.zeros(n + 1)
    for j in range(1, n + 1):
        v = [ahead[j - 1], *[ahead[segments[s][0]] + total[s] for s in ending.get(j, ())]]
        ahead[j] = v[0] if len(v) == 1 else np.logaddexp.reduce(v)
    behind = np.zeros(n + 1)
    for i in range(n - 1, -1, -1):
        v = [behind[i + 1], *[behind[segments[s][1]] + total[s] for s in starting.get(i, ())]]
        behind[i] = v[0] if len(v) == 1 else np.logaddexp.reduce(v)
    marginal = np.array(
        [np.exp(ahead[i] + scores[s] + behind[j] - ahead[n]) for s, (i, j, _) in enumerate(segments)]
    ).reshape(-1, len(KINDS))
    return float(ahead[n]), marginal


def labelled_sentences(n: int, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Sentences with personal data in many forms, and with numbers that are none."""
    rng = random.Random(seed)

    def digits(k: int) -> str:
        return "".join(rng.choice("0123456789") for _ in range(k))

    def word() -> str:
        return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(rng.randint(1, 9)))

    def checked(k: int) -> str:
        body = rng.choice("3456") + digits(k - 2)
        return next(body + c for c in "0123456789" if luhn(body + c))

    def unchecked(k: int) -> str:
        while luhn(d := digits(k)):
            pass
        return d

    def make(kind: str) -> tuple[str, str]:
        if kind == "email":
            at, dot = rng.choice([("@", "."), ("@", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), ("(at)", "(dot)"), (" (at) ", " (dot) "), (" (at) ", ".")])
            name = lambda: re.sub(r"[^a-z]", "x", word()) or "x"
            local = name() + rng.choice(["", "", rng.choice("._-") + name()]) + rng.choice(["", "", digits(2), digits(1)])
            host = rng.choice([name(), "mail", "example", "post-x"]) + rng.choice(["", "", digits(1)])
            return rng.choice(["", "", rng.choice(sorted(_CUES["email"])) + " "]), f"{local}{at}{host}{dot}{rng.choice(['com', 'org', 'de', 'net', 'co' + dot + 'uk'])}"
        if kind == "ip":
            return rng.choice(["", "ip "]), ".".join(str(rng.randint(0, 255)) for _ in range(4))
        if kind == "card":
            d = checked(rng.choice([15, 16, 16, 16, 19]))
            if rng.random() < 0.4:
                d = rng.choice(" -").join(d[i : i + 4] for i in range(0, len(d), 4))
            return rng.choice(["", "card ", "visa "]), d
        d = digits(10)
        form = rng.choice(["+1 ({}) {}-{}", "+49 {} {} {}", "({}) {}-{}", "{}-{}-{}", "+1-{}-{}-{}", "{} {} {}", "{}/{} {}", "{}/{}{}", "{}.{}.{}"])
        cue = "" if form[0] in "+(" else rng.choice(sorted(_CUES["phone"])) + rng.choice([" ", " ", ": ", ". "])
        return cue, form.format(d[:3], d[3:6], d[6:])

    def other() -> str:
        return rng.choice(
            [
                lambda: digits(rng.randint(1, 6)),
                lambda: unchecked(rng.choice([13, 16, 16])),
                lambda: digits(rng.choice([7, 8, 9, 10, 11, 20, 24])),
                lambda: f"20{digits(2)}-{digits(2)}-{digits(2)}",
                lambda: f"{digits(2)}.{digits(2)}.{digits(4)}",
                lambda: f"{digits(3)}-{digits(3)}-{digits(4)}",
                lambda: f"{digits(1)}.{digits(1)}.{digits(2)}",
                lambda: f"{digits(3)},{digits(3)},{digits(3)}",
                lambda: f"password={digits(3)}a{digits(4)}f{digits(5)}",
                lambda: f"{word()}@{word()}",
                lambda: f"{digits(4)} {digits(4)}",
                lambda: f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}",
                lambda: f"{digits(2)}, {digits(2)}, {digits(3)}, {digits(2)}",
                lambda: f"{digits(2)}/{digits(2)}/20{digits(2)}",
                lambda: f"{digits(3)}/{digits(3)} {digits(4)}",
                lambda: f"{word()} (at) {word()}",
                lambda: f"{digits(2)} [at] {digits(2)}",
                lambda: f"{word()} {word()} (at) {rng.choice(['noon', 'home', 'last'])}, {word()}",
            ]
        )()

    out = []
    for _ in range(n):
        text, spans = "", []
        for _ in range(rng.randint(2, 5)):
            text += " ".join(word() for _ in range(rng.randint(1, 3))) + " "
            r = rng.random()
            if r < 0.45:
                kind = rng.choice(KINDS)
                cue, body = make(kind)
                text += cue
                spans.append((len(text), len(text) + len(body), kind))
                text += body
            elif r < 0.9:
                text += other()
            text += rng.choice([" ", " ", ", ", ". ", "\n"])
        out.append((text, spans))
    return out


@lru_cache(maxsize=2)
def trained(sentences: int = 300, rounds: int = 40, seed: int = 11) -> Field:
    """A field fitted to generated sentences by gradient ascent on the penalised conditional likelihood."""
    data = []
    index: dict[str, int] = {}
    for text, spans in labelled_sentences(sentences, seed):
        toks, segments = lattice(text)
        gold = {(a, b): KINDS.index(k) for a, b, k in spans}
        truth = np.zeros((len(segments), len(KINDS)))
        for s, (i, j, _) in enumerate(segments):
            k = gold.get((toks[i][0], toks[j - 1][1]))
            if k is not None:
                truth[s, k] = 1
        ids = [[index.setdefault(f, len(index)) for f in fs] for _, _, fs in segments]
        if segments:
            flat = np.array([x for r in ids for x in r])
            owner = np.repeat(np.arange(len(ids)), [len(r) for r in ids])
            data.append((len(toks), segments, flat, owner, truth))
    w = np.zeros((len(index), len(KINDS)))
    m, v = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        g = -2e-2 * w
        for n, segments, flat, owner, truth in data:
            scores = np.zeros((len(segments), len(KINDS)))
            np.add.at(scores, owner, w[flat])
            _, marginal = expectations(n, segments, scores)
            np.add.at(g, flat, (truth - marginal)[owner])
        m = 0.9 * m + 0.1 * g
        v = 0.99 * v + 0.01 * g * g
        w += 0.15 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-8)
    return Field({f: w[i] for f, i in index.items()})


def field_spans(text: str, field: Field) -> list[tuple[int, int, str]]:
    """Spans of the best segmentation of a whole text, found line by line."""
    return [s for a, b in lines_of_interest(text) for s in field.decode(text, a, b)]


def find(text: str, field: Field) -> tuple[list[tuple[int, int, str]], list[tuple[int, int, str]]]:
    """Base spans, and all spans: the field's are added where they touch no base span."""
    base = base_spans(text)
    taken: list[list[int]] = []
    for a, b, _ in base:
        if taken and a <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], b)
        else:
            taken.append([a, b])
    starts = [a for a, _ in taken]
    added = []
    for a, b, k in field_spans(text, field):
        i = bisect.bisect_left(starts, b) - 1
        if i < 0 or taken[i][1] <= a:
            added.append((a, b, k))
    everything = sorted([*base, *added], key=lambda s: (s[0], KINDS.index(s[2])))
    return base, everything


def detect(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", field: Field | None = None) -> DataFrame:
    """One row per document: doc_id, base_spans and spans, both "kind:start:end" joined by commas.

    Offsets count code points, ends are exclusive, order is by start and then
    kind.  Null texts count as empty and have no spans; repeated rows give
    repeated results; an empty table gives an empty result.
    """
    field = field or trained()

    def make():
        def run(texts: list[str]) -> dict[str, list]:
            both = [find(t, field) for t in texts]
            return {
                "base_spans": [",".join([f"{k}:{a}:{b}" for a, b, k in x[0]]) for x in both],
                "spans": [",".join([f"{k}:{a}:{b}" for a, b, k in x[1]]) for x in both],
            }

        return run

    return map_texts(docs, [doc_id], text, make, "base_spans string, spans string")


def redact_text(text: str, spans: list[tuple[int, int, str]]) -> str:
    """The text with each span replaced by its kind in square brackets; overlapping spans become one."""
    out, at = [], 0
    for a, b, k in sorted(spans):
        if a >= at:
            out += [text[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, keep: list[str], text: str = "text", field: Field | None = None) -> DataFrame:
    """The columns ``keep``, the redacted text as ``redacted``; a null text stays null."""
    field = field or trained()

    def make():
        return lambda texts: {"redacted": [redact_text(t, find(t, field)[1]) for t in texts]}

    marked = docs.withColumn("text_is_null", F.col(text).isNull())
    out = map_texts(marked, [*keep, "text_is_null"], text, make, "redacted string")
    return out.withColumn("redacted", F.when(~F.col("text_is_null"), F.col("redacted"))).drop("text_is_null")


def op9_pii(spark, sf_dir: str) -> DataFrame:
    """Personal data in every document; see detect() for nulls, empty texts and repeats."""
    found = detect(table(spark, sf_dir, "documents"))
    listed = F.col("base_spans")
    return found.select(
        "doc_id",
        *[F.regexp_count(listed, F.lit(rf"\b{k}:")).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(listed, 256).alias("base_sha256"),
        "spans",
    )
