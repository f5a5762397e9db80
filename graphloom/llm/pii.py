"""Personal data: base patterns, and a semi-Markov conditional random field that scores whole candidate spans and chooses boundaries and types jointly."""

from __future__ import annotations

import random
import re
from bisect import bisect_left
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._shared import id_type

# The base patterns, in the order in which kinds are listed. Guards keep them linear on long runs and change no match.
KINDS = ("email", "ip", "card", "phone")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")

#: Label of what is in no entity; entities are labels 1 to 4 in the order of ``KINDS``.
OUTSIDE, LABELS = 0, 5
#: Tokens of an entity at most, digits or marks that make a stretch worth decoding, hashed features, made-up stretches learned from, rounds of learning.
LONGEST, LEAST_DIGITS, FEATURES, TRAIN, ROUNDS = 20, 7, 1 << 13, 600, 60
#: Rows whose words surround the made-up data, and words at most. What an entity must score beyond being left out.
TRAIN_ROWS, TRAIN_WORDS, MARGIN = 200, 2000, 2.0

_AT, _DOT = r"[(\[{]\x20?at\x20?[)\]}]", r"[(\[{]\x20?dot\x20?[)\]}]"
_TOKEN = re.compile(rf"{_AT}|{_DOT}|[0-9]+|[^\W\d_]+|\s|.", re.IGNORECASE | re.DOTALL)
_NUMBERS = re.compile(r"[+(]{0,2}[0-9](?:[ ().+/_:\[\]-]{0,3}[0-9]){%d,}" % (LEAST_DIGITS - 1))
_MARK = re.compile(rf"@|{_AT}|\bat\b(?=[^\n]{{1,40}}?(?:\bdot\b|{_DOT}))", re.IGNORECASE)
_BEFORE = re.compile(rf"[A-Za-z0-9_%+-]+(?:\x20?(?:\.|{_DOT}|\bdot\b)\x20?[A-Za-z0-9_%+-]+){{0,3}}\x20?\Z", re.IGNORECASE)
_AFTER = re.compile(rf"\x20?[A-Za-z0-9-]+(?:\x20?(?:\.|{_DOT}|\bdot\b)\x20?[A-Za-z0-9-]+){{0,6}}(?:\x20[A-Za-z]+)?", re.IGNORECASE)
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[^\w\n]{0,3}\Z")


def luhn(digits: str) -> bool:
    """Doubled digits from the right, as card numbers have it."""
    twice = (0, 2, 4, 6, 8, 1, 3, 5, 7, 9)
    return sum(int(c) if i % 2 == 0 else twice[int(c)] for i, c in enumerate(reversed(digits))) % 10 == 0


def _octet(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and part <= "255"


def base_spans(text: str) -> list[tuple[int, int, str]]:
    """Matches of the base patterns that pass their tests, leftmost and apart for each kind."""
    found, after = [], 0
    at = text.find("@")
    while at >= 0:
        piece = text[after:at]
        start, domain = at - len(piece) + len(piece.rstrip(LOCAL)), DOMAIN.match(text, at + 1)
        if domain and start < at:
            found.append((start, domain.end(), "email"))
        after = domain.end() if domain and start < at else at + 1
        at = text.find("@", after)
    found += [(m.start(), m.end(), "ip") for m in IP.finditer(text) if all(map(_octet, m[0].split(".")))]
    for m in CARD.finditer(text):
        if 12 <= m.end() - m.start() < 40:
            digits = m[0].replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19 and luhn(digits):
                found.append((m.start(), m.end(), "card"))
    found += [(m.start(), m.end(), "phone") for m in PHONE.finditer(text) if 9 <= sum(map(str.isdigit, m[0])) <= 15]
    return found


def stretches(text: str, base: list[tuple[int, int, str]]) -> list[tuple[int, int]]:
    """Parts of the text that may hold further entities: around numbers of ``LEAST_DIGITS`` digits or more and around marks of addresses, without base spans."""
    wide = [(m.start(), m.end()) for m in _NUMBERS.finditer(text)]
    for m in _MARK.finditer(text):
        a = _BEFORE.search(text, max(0, m.start() - 80), m.start()) if m.start() else None
        b = _AFTER.match(text, m.end(), m.end() + 120)
        if a and b:
            wide.append((a.start(), b.end()))
    if not wide:
        return []
    out: list[tuple[int, int]] = []
    for a, b in sorted(wide):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    taken = sorted((s[0], s[1]) for s in base)
    ends = np.maximum.accumulate([s[1] for s in taken]).tolist() if taken else []
    free = []
    for a, b in out:
        i = bisect_left(ends, a + 1)
        while i < len(taken) and taken[i][0] < b:
            if a < taken[i][0]:
                free.append((a, taken[i][0]))
            a, i = max(a, taken[i][1]), i + 1
        if a < b:
            free.append((a, b))
    return [(a, b) for a, b in free if sum(map(str.isdigit, text[a:b])) >= LEAST_DIGITS or _MARK.search(text, a, b)]


def _hashed(feature: str) -> int:
    return crc32(feature.encode()) % FEATURES


@dataclass
class Stretch:
    """Tokens of one part of a text (``ends`` of each, after ``start``) and its candidate segments by first token: that, length, features, allowed labels."""

    start: int
    ends: list[int]
    segments: Iterable[tuple[int, int, list[int], tuple[int, ...]]]


_SEPARATORS = frozenset(" ().+-/_:[]\t")
_ONLY_MAIL, _ONLY_NUMBERS = (1,), (2, 3, 4)


def candidates(text: str, start: int, end: int) -> Stretch:
    """The segments of ``text[start:end]`` that may be entities, with features of the whole span; and each token as a segment outside. They are made one by one, as a long stretch has many."""
    tokens = [(m.start(), m.end(), m[0]) for m in _TOKEN.finditer(text, start, end)]
    kind = ["d" if t[0] in "0123456789" else "@" if t == "@" or len(t) > 2 and t[1:-1].strip().lower() == "at" else "." if t == "." or len(t) > 3 and t[1:-1].strip().lower() == "dot" else "a" if t.isalpha() else t for _, _, t in tokens]
    said = _WORD_BEFORE.search(text, max(0, start - 32), start)
    return Stretch(start, [t[1] for t in tokens], _segments(text, tokens, kind, said[1].lower() if said else ""))


def _segments(text: str, tokens: list[tuple[int, int, str]], kind: list[str], word: str) -> Iterator[tuple[int, int, list[int], tuple[int, ...]]]:
    n = len(tokens)
    for i in range(n):
        a, _, t = tokens[i]
        left = "^" if a == 0 else "d" if text[a - 1].isdigit() else "a" if text[a - 1].isalpha() else text[a - 1]
        yield i, 1, [_hashed(f"o{kind[i]}{len(t) if kind[i] == 'd' else ''}"), _hashed("o" + left + kind[i])], (OUTSIDE,)
        if kind[i] not in "da+([":
            continue
        marks = digits = letters = 0
        shape, separators, groups = [], set(), []
        for j in range(i, min(n, i + LONGEST)):
            k, t = kind[j], tokens[j][2]
            if k == "d":
                digits += len(t)
                groups.append(t)
            elif k == "a":
                letters += 1
                marks += t.lower() == "at" and j > i
            elif k == "@":
                marks += 1
            elif k != "." and k not in _SEPARATORS:
                break
            else:
                separators.add(k)
            shape.append(f"d{len(t)}" if k == "d" else k)
            if digits > 24 or marks > 1:
                break
            if k not in "da":
                continue
            if marks and kind[i] in "da" and k == "a":
                allowed = _ONLY_MAIL
            elif not letters and not marks and digits >= 4:
                allowed = _ONLY_NUMBERS
            else:
                continue
            b = tokens[j][1]
            right = "$" if b == len(text) else "d" if text[b].isdigit() else "a" if text[b].isalpha() else text[b]
            said = ["b", "s" + "".join(shape[:16]), f"n{digits}", "x" + "".join(sorted(separators)), f"l{left}", f"r{right}", "w" + word, f"f{shape[0]}{shape[1] if len(shape) > 1 else ''}"]
            if allowed is _ONLY_MAIL:
                said += [f"m{shape.count('@')}{shape.count('.') > 0}", "t" + t.lower() if shape[-2:-1] in (["."], [" "]) else "t-", f"v{' ' in separators}", f"c{shape[: shape.index('@')].count(' ') if '@' in shape else 9}", f"a{'@' in shape}{sum(x.lower() == 'dot' for _, _, x in tokens[i : j + 1])}"]
            else:
                sizes = {len(g) for g in groups}
                said += [f"g{len(groups)}", f"e{len(sizes) == 1}", f"h{len(groups[0])},{len(groups[-1])}", f"z{'+' in shape}{'(' in shape}{shape.count('(') == shape.count(')')}"]
                said += [f"u{12 <= digits <= 19 and luhn(''.join(groups))}{12 <= digits <= 19}{max(sizes) <= 6 or len(groups) == 1}", f"i{len(groups) == 4 and all(map(_octet, groups))}{shape.count('.')}", f"p{9 <= digits <= 15}{groups[0][0] == '0'}"]
            yield i, j - i + 1, [_hashed(f) for f in said], allowed


def _total(x: np.ndarray, axis: int) -> np.ndarray:
    """Logarithm of the sum of exponentials; nothing stays minus infinity."""
    top = x.max(axis=axis, keepdims=True)
    top = np.where(np.isfinite(top), top, 0.0)
    with np.errstate(divide="ignore"):
        return np.log(np.exp(x - top).sum(axis=axis)) + np.squeeze(top, axis)


class SemiMarkov:
    """Weights of each label's span features and of a label after another."""

    def __init__(self, weights: np.ndarray | None = None, follows: np.ndarray | None = None):
        self.weights = np.zeros((LABELS, FEATURES)) if weights is None else weights
        self.follows = np.zeros((LABELS, LABELS)) if follows is None else follows

    def decode(self, s: Stretch, margin: float = MARGIN) -> list[tuple[int, int, str]]:
        """The entities of the best segmentation: position by position the best score for each last label, over segments of bounded length."""
        n = len(s.ends)
        best, back = np.full((n + 1, LABELS), -np.inf), {}
        best[0, OUTSIDE] = 0.0
        prior: dict[int, np.ndarray] = {}
        for first, length, features, allowed in s.segments:  # by first token, so all that end there are settled
            if first not in prior:
                prior[first] = best[first][:, None] + self.follows
            for y in allowed:
                before = int(prior[first][:, y].argmax())
                score = prior[first][before, y] + self.weights[y, features].sum() - (margin if y else 0.0)
                if score > best[first + length, y]:
                    best[first + length, y], back[first + length, y] = score, (first, before)
        out, at, y = [], n, int(best[n].argmax())
        starts = [s.start, *s.ends]
        while at:
            first, before = back[at, y]
            if y:
                out.append((starts[first], s.ends[at - 1], KINDS[y - 1]))
            at, y = first, before
        return out[::-1]

    def lattice(self, data: list[tuple[Stretch, set[tuple[int, int, int]]]]):
        """Arrays of all segments of the training stretches: where each stands, its features and whether it is right."""
        rows = [(b, i + length, length - 1, y, f, float((i, length, y) in gold)) for b, (s, gold) in enumerate(data) for i, length, f, allowed in s.segments for y in allowed]
        where = tuple(np.array([r[k] for r in rows]) for k in range(4))
        counts = np.array([len(r[4]) for r in rows])
        return where, np.repeat(np.arange(len(rows)), counts), np.concatenate([r[4] for r in rows]), np.array([r[5] for r in rows])

    def likelihood(self, data: list, where, owner, features, right) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean log-likelihood of the right segmentations and its gradients, by sums forwards and backwards over all segmentations."""
        b, e, length, y = where
        width, batch = max(len(s.ends) for s, _ in data), len(data)
        last = np.array([len(s.ends) for s, _ in data])
        score = np.bincount(owner, self.weights[y[owner], features], len(b))
        table = np.full((batch, width + 1, LONGEST, LABELS), -np.inf)
        table[where] = score
        ahead, into = np.full((batch, width + 1, LABELS), -np.inf), np.full((batch, width + 1, LABELS), -np.inf)
        ahead[:, 0, OUTSIDE] = 0.0
        for at in range(width + 1):
            if at:
                reach = min(at, LONGEST)
                ahead[:, at] = _total(into[:, at - reach : at][:, ::-1] + table[:, at, :reach], 1)
            into[:, at] = _total(ahead[:, at, :, None] + self.follows, 1)
        norm = _total(ahead[np.arange(batch), last], 1)
        behind, onward = np.full((batch, width + 1, LABELS), -np.inf), np.full((batch, width + 1, LABELS), -np.inf)
        behind[np.arange(batch), last] = 0.0
        for at in range(width - 1, -1, -1):
            reach = min(width - at, LONGEST)
            steps = np.arange(reach)
            onward[:, at] = _total(table[:, at + 1 + steps, steps] + behind[:, at + 1 + steps], 1)
            further = _total(self.follows + onward[:, at, None, :], 2)
            behind[:, at] = np.where((last > at)[:, None], further, behind[:, at])
        share = np.exp(into[b, e - length - 1, y] + score + behind[b, e, y] - norm[b])
        change = right - share
        grad = np.stack([np.bincount(features[chosen], change[owner[chosen]], FEATURES) for chosen in (y[owner] == label for label in range(LABELS))])
        pair = np.exp(ahead[:, :-1, :, None] + self.follows + onward[:, :-1, None, :] - norm[:, None, None, None]).sum(axis=(0, 1))
        seen, paths = np.zeros((LABELS, LABELS)), np.zeros(batch)
        np.add.at(paths, b[right > 0], score[right > 0])
        for k, (_, gold) in enumerate(data):
            path = [label for _, _, label in sorted(gold)]
            for one, two in zip([OUTSIDE, *path], path):
                seen[one, two] += 1
                paths[k] += self.follows[one, two]
        return float((paths - norm).mean()), grad / batch, (seen - pair) / batch

    def learn(self, data: list, rounds: int = ROUNDS, rate: float = 0.3, decay: float = 1e-3) -> SemiMarkov:
        """Gradient ascent with step sizes by each weight's own past gradients."""
        parts = self.lattice(data)
        past = [np.full(self.weights.shape, 1e-8), np.full(self.follows.shape, 1e-8)]
        for _ in range(rounds):
            _, *grads = self.likelihood(data, *parts)
            for values, grad, sums in zip((self.weights, self.follows), grads, past):
                grad = grad - decay * values
                sums += grad * grad
                values += rate * grad / np.sqrt(sums)
        return self


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def _card(rng: random.Random) -> str:
    n = rng.choice((16, 16, 16, 15, 13, 19))
    body = rng.choice("3456") + _digits(rng, n - 2)
    number = next(body + c for c in "0123456789" if luhn(body + c))
    cuts = {15: (4, 10)}.get(n, tuple(range(4, n, 4)))
    parts = [number[a:b] for a, b in zip((0, *cuts), (*cuts, n))]
    return rng.choice(("", "", " ", "-", ".", " - ", "/")).join(parts)


def _phone(rng: random.Random) -> str:
    a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
    return rng.choice((
        f"+{rng.randrange(1, 99)} ({a}) {b}-{c}", f"+1 {a} {b} {c}", f"({a}) {b}-{c}", f"({a}){b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"+{rng.randrange(20, 99)} {_digits(rng, 2)} {_digits(rng, 7)}",
        f"00{rng.randrange(20, 99)} {_digits(rng, 3)} {_digits(rng, 6)}", f"0{_digits(rng, 3)} {_digits(rng, 7)}", f"0{_digits(rng, 2)}/{_digits(rng, 7)}", f"1-{a}-{b}-{c}",
    ))


def _ip(rng: random.Random) -> str:
    return rng.choice((".", ".", " . ", "[.]", ". ")).join(str(rng.randrange(256)) for _ in range(4))


def _mail(rng: random.Random, words: list[str]) -> str:
    at, dot = rng.choice((("@", "."), (" @ ", "."), (" (at) ", " (dot) "), ("(at)", "."), (" [at] ", " [dot] "), ("[at]", "[dot]"), (" at ", " dot ")))
    name = rng.choice(("", "", rng.choice(words) + rng.choice((".", dot)))) + rng.choice(words) + rng.choice(("", f"{rng.randrange(99)}"))
    host = dot.join([*rng.choices(words, k=rng.randrange(1, 3)), rng.choice(("com", "org", "net", "de", "fr", "es", "edu", "info", "io"))])
    return name + at + host


def _other(rng: random.Random, words: list[str]) -> str:
    """Numbers and words that look like personal data and aren't."""
    y, m, d = rng.randrange(1900, 2040), rng.randrange(1, 13), rng.randrange(1, 29)
    wrong = next(n for n in iter(lambda: _digits(rng, rng.randrange(12, 20)), "") if not luhn(n))
    return rng.choice((
        f"{y}-{m:02}-{d:02} {rng.randrange(24):02}:{rng.randrange(60):02}:{rng.randrange(60):02}", f"{d:02}.{m:02}.{y}", f"{d:02}/{m:02}/{y}", f"{y}-{y + 3} {y + 5}-{y + 9}", wrong, wrong,
        f"978-{_digits(rng, 1)}-{_digits(rng, 2)}-{_digits(rng, 6)}-{_digits(rng, 1)}", f"{y}-{_digits(rng, 6)}", " ".join(_digits(rng, rng.randrange(1, 4)) for _ in range(rng.randrange(4, 12))),
        f"{_digits(rng, 3)}.{_digits(rng, rng.randrange(4, 9))}", _digits(rng, rng.randrange(7, 12)), _digits(rng, rng.randrange(20, 40)), " ".join(_digits(rng, 4) for _ in range(rng.randrange(2, 9)) ) + " 1",
        f"{rng.randrange(1, 99)}.{rng.randrange(99)}.{rng.randrange(99)}.{_digits(rng, 4)}", ".".join(str(rng.randrange(256, 999)) for _ in range(4)), ".".join(str(rng.randrange(99)) for _ in range(6)),
        f"{rng.choice(words)} at {rng.choice(words)} the dot {rng.choice(words)}", f"{rng.choice(words)} @ {rng.choice(words)}", f"@{rng.choice(words)} {_digits(rng, 8)}", f"{_digits(rng, 4)}-{_digits(rng, 4)}",
        f"{_digits(rng, 2)}:{_digits(rng, 2)}:{_digits(rng, 2)}.{_digits(rng, 6)}", " ".join(f"{_digits(rng, 2)}.{_digits(rng, 2)}" for _ in range(4)), f"{_digits(rng, 5)}-{_digits(rng, 4)}", f"({_digits(rng, 4)}) {_digits(rng, 4)}",
    ))


def made_up(words: list[str], n: int = TRAIN, seed: int = 11) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """``n`` texts with their spans: personal data in usual and unusual writing, alone or side by side, and look-alikes; the same for the same words."""
    rng = random.Random(seed)
    words = [w for w in words if w.isascii() and w.lower() not in ("at", "dot")] or ["word"]
    cues = {"phone": ("phone", "tel", "call", "mobile"), "card": ("card", "visa", "paid"), "ip": ("host", "ip", "server"), "email": ("mail", "contact", "write")}
    makers = {"phone": lambda: _phone(rng), "card": lambda: _card(rng), "ip": lambda: _ip(rng), "email": lambda: _mail(rng, words)}
    out = []
    for _ in range(n):
        text, spans = " ".join(rng.choices(words, k=rng.randrange(3))), []
        for _ in range(rng.choice((1, 1, 1, 2, 2, 3))):
            if rng.random() < 0.45:
                kind, piece = "", _other(rng, words)
            else:
                kind = rng.choice(KINDS)
                piece = makers[kind]()
            cue = rng.choice(cues[kind]) + rng.choice((" ", ": ")) if kind and rng.random() < 0.25 else ""
            text += (rng.choice((" ", " ", "\n", ", ", "; ")) if text else "") + cue
            if kind:
                spans.append((len(text), len(text) + len(piece), kind))
            text += piece
        out.append((text + rng.choice(("", "", ".", " " + rng.choice(words))), spans))
    return out


def labelled(texts: list[tuple[str, list[tuple[int, int, str]]]]) -> list[tuple[Stretch, set[tuple[int, int, int]]]]:
    """The stretches of labelled texts with their right segmentations, in tokens. Those whose spans don't fall on candidates are left out."""
    out = []
    for text, spans in texts:
        for a, b in stretches(text, []):
            s = candidates(text, a, b)
            if len(s.ends) > 2 * LONGEST:
                continue
            s.segments = list(s.segments)
            known = {(i, length, y) for i, length, _, allowed in s.segments for y in allowed}
            starts = {p: i for i, p in enumerate([a, *s.ends[:-1]])}
            stops = {p: i + 1 for i, p in enumerate(s.ends)}
            inside = [(starts.get(x, -1), stops.get(z, -1), KINDS.index(k) + 1) for x, z, k in spans if x < b and z > a]
            gold = {(i, j - i, y) for i, j, y in inside}
            if min([i for i, j, _ in inside] + [j for _, j, _ in inside], default=0) < 0 or not gold <= known:
                continue
            covered = {t for i, length, _ in gold for t in range(i, i + length)}
            out.append((s, gold | {(t, 1, OUTSIDE) for t in range(len(s.ends)) if t not in covered}))
    return out


def fit(docs: DataFrame, text_col: str = "text") -> SemiMarkov:
    """Learns from made-up data between words of a bounded sample: ``TRAIN_ROWS`` rows with the least text hashes, ``TRAIN_WORDS`` words at most."""
    hashed = docs.select(F.xxhash64(text_col).alias("_h"), F.col(text_col).cast("string").alias("_t"))
    edge = hashed.select("_h").orderBy("_h").limit(TRAIN_ROWS).agg(F.max("_h")).first()[0]
    words: list[str] = []
    if edge is not None:
        sample = hashed.filter(F.col("_h") <= edge).dropDuplicates(["_h"])
        word = sample.select(F.explode(F.regexp_extract_all("_t", F.lit(r"\b[A-Za-z][a-z]{1,14}\b"), F.lit(0))).alias("w")).distinct()
        words = sorted(r.w for r in word.orderBy(F.xxhash64("w"), "w").limit(TRAIN_WORDS).collect())
    return SemiMarkov().learn(labelled(made_up(words)))


def personal_spans(text: str, model: SemiMarkov) -> list[tuple[int, int, str, bool]]:
    """Start, end, kind and whether a base pattern found it, by start, then kind as listed."""
    base = base_spans(text)
    found = [(*s, True) for s in base]
    for a, b in stretches(text, base):
        found += [(*s, False) for s in model.decode(candidates(text, a, b))]
    return sorted(found, key=lambda s: (s[0], KINDS.index(s[2])))


def personal_data(docs: DataFrame, model: SemiMarkov | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of ``docs``: ``doc_id, spans`` with kind, start and end in code points, and ``base``; by start, then kind as listed.

    Base spans are the matches of the four base patterns that pass their tests (octets, Luhn, digits). The model adds spans of the same kinds in what base
    spans leave: numbers side by side that a pattern takes for one, other separators, addresses spelled out. Around numbers and marks all segments of up to
    ``LONGEST`` tokens compete by features of the whole span, and the best segmentation is taken, so added spans never overlap each other or base spans.

    Null or empty text: no spans. Equal rows: equal spans. Long texts: time and memory grow in proportion. Empty table: no rows.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(model or fit(docs, text_col))
    span = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [[{"kind": k, "start": a, "end": b, "base": base} for a, b, k, base in personal_spans(text.as_py() or "", shipped.value)] for text in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(rows, span)], names=["doc_id", "spans"])

    chosen = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return chosen.mapInArrow(scan, f"doc_id {id_type(chosen)}, spans array<struct<kind:string,start:long,end:long,base:boolean>>")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = personal_data(spark.read.parquet(f"{sf_dir}/documents.parquet"))

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def count(kind):
        return F.size(F.filter("spans", lambda s: s["base"] & (s["kind"] == kind))).cast("long").alias(f"n_{kind}")

    base, counts = F.filter("spans", lambda s: s["base"]), [count(kind) for kind in KINDS]
    added = F.size(F.filter("spans", lambda s: ~s["base"])).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"), added)
