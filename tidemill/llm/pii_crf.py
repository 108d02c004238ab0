"""Personal data: four strict patterns, and a linear-chain conditional random field over word shapes.

The patterns (email, ip, card, phone) report what is certain.  The field adds what they miss, such as
phone numbers without a country code, spaced or bracketed ones, and national ids: it labels the words of a
text by their shapes alone (letters and digits become classes), is trained by gradient ascent with
forward-backward sums from a small labelled table, and decodes by Viterbi in numpy batches.

Most words can't be part of personal data in any best labelling: whatever their neighbours are, calling
them "outside" scores more (``Field.certain``).  Given such words the chain falls apart, so only the runs
between them are decoded; the result is that of Viterbi over the whole text.

Defined results: a null text is empty; an empty text has no spans; added spans never overlap those of the
patterns; repeated rows are each returned; a null doc_id is kept as it is; very long texts take time and
memory in proportion to their length, however many spans they have; bytes that aren't UTF-8 count as one
replacement character each; ties of labellings go to the label listed first; an empty table gives an empty
result; other columns are ignored.  Positions are code points, ends exclusive.
"""

from __future__ import annotations

import functools
import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame

from .common import map_texts

KINDS = ("email", "ip", "card", "phone")

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_NOT_DIGIT = re.compile(r"[^0-9]+")
_NOT_LOCAL = re.compile(r"[^A-Za-z0-9._%+-]")


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost matches, found from their @, so that long runs of letters cost nothing."""
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        begin = at
        while begin > end and not _NOT_LOCAL.match(text, begin - 1):
            begin -= 1
        found = _DOMAIN.match(text, at + 1) if begin < at else None
        if found:
            out.append((begin, found.end()))
        # what lies before this @ can't belong to the next match either: its local part has no @
        end = found.end() if found else at + 1
        at = text.find("@", max(end, at + 1))
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind's number, start, end) of the four patterns, by kind, then start."""
    out = [(0, a, b) for a, b in emails(text)] if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        parts = [p.lstrip("0") for p in m[0].split(".")]
        if all(len(p) < 4 and int(p or 0) <= 255 for p in parts):
            out.append((1, *m.span()))
    for m in _CARD.finditer(text):
        digits = _NOT_DIGIT.sub("", m[0]) if len(m[0]) >= 13 else ""
        if 13 <= len(digits) <= 19 and luhn(digits):
            out.append((2, *m.span()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(_NOT_DIGIT.sub("", m[0])) <= 15:
                out.append((3, *m.span()))
    return out


# ---- the labelled table

TYPES = ("phone", "national", "mac")
LABELS = ["O", *(f"{p}-{t}" for t in TYPES for p in "BI")]


def labelled_table(rows: int = 450, seed: int = 11) -> list[list[tuple[str, str]]]:
    """Sentences of (word, label): invented words in four languages' shapes with personal data and look-alikes put in."""
    rng = np.random.default_rng(seed)
    letters = "abcdefghijklmnopqrstuvwxyzéüñß"

    def pick(*options: str) -> str:
        return options[rng.integers(len(options))]

    def digits(n: int) -> str:
        return "".join(map(str, rng.integers(0, 10, n)))

    def word() -> str:
        w = "".join(letters[k] for k in rng.integers(0, len(letters), rng.integers(1, 13)))
        w = w.capitalize() if rng.random() < 0.15 else w.upper() if rng.random() < 0.03 else w
        return w + pick(*[""] * 12, ",", ".", ";", "***", "%%%", "&&&", "###", "$$$", "?", ":")

    def phone() -> list[str]:
        a, b, c = digits(3), digits(3), digits(4)
        return pick(f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"({a}) {b} {c}", f"+{digits(1)} ({a}) {b}-{c}", f"+{digits(2)} {a} {b} {c}", f"1-{a}-{b}-{c}", f"({a}){b}-{c}").split()

    def national() -> list[str]:
        return [f"{digits(3)}-{digits(2)}-{digits(4)}"]

    def mac() -> list[str]:
        return [":".join("".join(rng.choice(list("0123456789abcdef"), 2)) for _ in range(6)).upper() if rng.random() < 0.5 else ":".join(digits(2) for _ in range(6))]

    def alike() -> list[str]:
        hexa = "".join(rng.choice(list("0123456789abcdef"), rng.integers(12, 41)))
        return pick(
            digits(4), digits(1), digits(2), digits(16), f"{digits(4)} {digits(4)} {digits(4)} {digits(4)}", f"{digits(2)}.{digits(1)}", f"{digits(4)}-{digits(2)}-{digits(2)}", f"{digits(2)}:{digits(2)}",
            hexa, f"password={hexa}", f'token = "{hexa}"', f"AKIA{hexa.upper()[:16]}", f"{word()}.{digits(2)}@mail{digits(1)}.example.com", ".".join(digits(2) for _ in range(4)), f"({digits(4)})", f"{digits(3)}-{digits(3)}",
            f"{digits(1)},{digits(3)}", f"{digits(2)}%", f"2.0.", f"ISBN {digits(3)}-{digits(1)}-{digits(2)}-{digits(6)}-{digits(1)}", f"({word()})", f"{digits(4)}-{digits(4)}", f"{digits(5)}-{digits(4)}", f"+{digits(1)}", f"{digits(3)}", f"{digits(10)}",
        ).split()

    makers = {"phone": phone, "national": national, "mac": mac}
    table = []
    for _ in range(rows):
        sentence: list[tuple[str, str]] = []
        for _ in range(rng.integers(1, 4)):
            sentence += [(word(), "O") for _ in range(rng.integers(0, 7))]
            kind = ("phone", "national", "mac", None, None, None)[rng.integers(6)]
            ws = makers[kind]() if kind else alike()
            if rng.random() < 0.3:
                ws[-1] += pick(",", ".", ";")
            sentence += [(w, f"{'I' if k else 'B'}-{kind}" if kind else "O") for k, w in enumerate(ws)]
        sentence += [(word(), "O") for _ in range(rng.integers(0, 4))]
        table.append(sentence)
    return table


# ---- shapes

#: Letters to x and X, digits to d, bytes of other characters to x, white space to the blank.
SHAPE = bytes(ord("X") if 65 <= b <= 90 else ord("x") if 97 <= b <= 122 or b >= 128 else ord("d") if 48 <= b <= 57 else 32 if 9 <= b <= 13 else b for b in range(256))


def features(shape: bytes) -> list[str]:
    """Features of a word, from its shape alone."""
    s = shape.decode()
    core = s.strip(".,;:!?\"'")
    short = re.sub(r"x{3,}", "xx", re.sub(r"X{3,}", "XX", core))
    n = core.count("d")
    marks = re.sub(r"[xXd]", "", core)
    return ["1", f"shape {short[:24]}", f"classes {re.sub(r'(.)\1+', r'\1', core)[:12]}", f"digits {min(n, 12)}", f"marks {marks[:6]}", f"first {core[:1]}", f"last {core[-1:]}", f"length {min(len(core), 20)}", f"letters {min(len(core) - n - len(marks), 4)}", f"end {s[len(s.rstrip('.,;:!?')):][:1]}"]


class Field:
    """A linear-chain conditional random field; before and after a text the label is O."""

    def __init__(self, index: dict[str, int], weights: np.ndarray, transitions: np.ndarray) -> None:
        self.index, self.weights, self.transitions = index, weights, transitions
        t = transitions
        # what calling a word O instead of k can lose at most in its two transitions
        self.loss = np.array([(t[:, 0] - t[:, k]).min() + (t[0, :] - t[k, :]).min() for k in range(len(t))])

    def emission(self, shape: bytes) -> np.ndarray:
        known = [self.index[f] for f in features(shape) if f in self.index]
        return self.weights[known].sum(axis=0)

    def certain(self, emission: np.ndarray) -> bool:
        """Whether a word of this emission is O in every best labelling, whatever its neighbours."""
        return bool((emission[..., :1] - emission[..., 1:] + self.loss[1:] > 0).all())

    def viterbi(self, emissions: np.ndarray) -> np.ndarray:
        """Best labels of runs of one length (runs x words x labels), each between two O words."""
        runs, n, _ = emissions.shape
        score = self.transitions[0] + emissions[:, 0]
        back = np.zeros((runs, n, len(self.transitions)), np.int8)
        for t in range(1, n):
            step = score[:, :, None] + self.transitions
            back[:, t] = step.argmax(axis=1)
            score = step.max(axis=1) + emissions[:, t]
        labels = np.zeros((runs, n), np.int64)
        labels[:, -1] = (score + self.transitions[:, 0]).argmax(axis=1)
        for t in range(n - 1, 0, -1):
            labels[:, t - 1] = back[np.arange(runs), t, labels[:, t]]
        return labels


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis=axis, keepdims=True)
    return np.log(np.exp(x - top).sum(axis=axis)) + top.squeeze(axis)


@functools.cache
def train(epochs: int = 100, rate: float = 0.15, decay: float = 1e-4) -> Field:
    """Fit on the labelled table: Adam on the log-likelihood of all sentences at once, padded with O words."""
    table = labelled_table()
    index: dict[str, int] = {}
    rows = [[[index.setdefault(f, len(index)) for f in features(w.encode().translate(SHAPE))] for w, _ in s] for s in table]
    n, length, k = len(table), max(map(len, table)), len(LABELS)
    width = max(len(f) for s in rows for f in s)
    padding = len(index)  # a feature that scores O alone
    at = np.full((n, length, width), padding)
    gold = np.zeros((n, length), np.int64)
    real = np.zeros((n, length), bool)
    for i, (s, fs) in enumerate(zip(table, rows)):
        for t, ((_, label), f) in enumerate(zip(s, fs)):
            at[i, t, : len(f)] = f
            gold[i, t] = LABELS.index(label)
            real[i, t] = True
    weights, transitions = np.zeros((padding + 1, k)), np.zeros((k, k))
    padded = np.zeros(k)
    padded[1:] = -30.0
    want = np.eye(k)[gold]
    moments = [[np.zeros_like(weights), np.zeros_like(weights)], [np.zeros_like(transitions), np.zeros_like(transitions)]]
    before = np.concatenate((np.zeros((n, 1), np.int64), gold), axis=1)
    after = np.concatenate((gold, np.zeros((n, 1), np.int64)), axis=1)
    pairs = np.zeros((k, k))
    np.add.at(pairs, (before, after), 1)
    for epoch in range(1, epochs + 1):
        weights[padding] = 0
        e = np.where(real[..., None], weights[at].sum(axis=2), padded)
        alpha = np.zeros((n, length, k))
        beta = np.zeros((n, length, k))
        alpha[:, 0] = transitions[0] + e[:, 0]
        beta[:, -1] = transitions[:, 0]
        for t in range(1, length):
            alpha[:, t] = _logsumexp(alpha[:, t - 1, :, None] + transitions, 1) + e[:, t]
        for t in range(length - 2, -1, -1):
            beta[:, t] = _logsumexp(transitions + (e[:, t + 1] + beta[:, t + 1])[:, None, :], 2)
        z = _logsumexp(alpha[:, -1] + beta[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None])
        edge = np.exp(alpha[:, :-1, :, None] + transitions + (e + beta)[:, 1:, None, :] - z[:, None, None, None]).sum(axis=(0, 1))
        edge[0] += node[:, 0].sum(axis=0)
        edge[:, 0] += node[:, -1].sum(axis=0)
        diff = np.where(real[..., None], want - node, 0)
        gradient = np.zeros_like(weights)
        for j in range(width):
            np.add.at(gradient, at[..., j].ravel(), diff.reshape(-1, k))
        for x, g, (m, v) in ((weights, gradient / n - decay * weights, moments[0]), (transitions, (pairs - edge) / n - decay * transitions, moments[1])):
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            x += rate * (m / (1 - 0.9**epoch)) / (np.sqrt(v / (1 - 0.99**epoch)) + 1e-8)
    weights[padding] = 0
    return Field(index, weights, transitions)


class Tagger:
    """Labels of whole texts; emissions are kept by shape."""

    def __init__(self, field: Field, limit: int = 200_000) -> None:
        self.field, self.limit = field, limit
        self.number: dict[bytes, int] = {}
        self.emissions = np.zeros((0, len(LABELS)))
        self.certain = np.zeros(0, bool)

    def _numbers(self, shapes: list[bytes]) -> np.ndarray:
        if len(self.number) > self.limit:
            self.number, self.emissions, self.certain = {}, self.emissions[:0], self.certain[:0]
        number = self.number
        new = [s for s in dict.fromkeys(shapes) if s not in number]
        if new:
            e = np.array([self.field.emission(s) for s in new])
            number.update(zip(new, range(len(number), len(number) + len(new))))
            self.emissions = np.concatenate((self.emissions, e))
            self.certain = np.concatenate((self.certain, [self.field.certain(x) for x in e]))
        return np.array([number[s] for s in shapes], np.int64)

    def labels(self, shapes: list[bytes], prune: bool = True) -> np.ndarray:
        """The label number of each word of a text."""
        out = np.zeros(len(shapes), np.int64)
        if not shapes:
            return out
        numbers = self._numbers(shapes)
        open_ = ~self.certain[numbers] if prune else np.ones(len(shapes), bool)
        edge = np.flatnonzero(np.diff(np.concatenate(([False], open_, [False])).view(np.int8)))
        begins, lengths = edge[::2], edge[1::2] - edge[::2]
        for n in np.unique(lengths):
            some = begins[lengths == n]
            at = some[:, None] + np.arange(n)
            out[at] = self.field.viterbi(self.emissions[numbers[at]])
        return out


_WORD = re.compile(rb"[^\x20\x09-\x0d]+")
_TRIM = b".,;:!?\"'"


def added_spans(text: bytes, tagger: Tagger) -> list[tuple[str, int, int]]:
    """(kind, start, end) that the field labels, in order of start; text is valid UTF-8, positions are code points."""
    labels = tagger.labels(text.translate(SHAPE).split())
    if not labels.any():
        return []
    places = [m.span() for m in _WORD.finditer(text)]
    spans: list[tuple[str, int, int]] = []
    open_ = ""
    for k in np.flatnonzero(labels):
        part, _, kind = LABELS[labels[k]].partition("-")
        begin, end = places[k]
        if part == "I" and open_ == kind and k and labels[k - 1]:
            spans[-1] = (*spans[-1][:2], end)
        else:
            spans.append((kind, begin, end))
        open_ = kind
    # code points before each byte: all bytes but those that continue one
    points = np.concatenate(([0], np.cumsum((np.frombuffer(text, np.uint8) & 0xC0) != 0x80)))
    out = []
    for kind, a, b in spans:
        word = text[a:b]
        a, b = a + len(word) - len(word.lstrip(_TRIM)), b - (len(word) - len(word.rstrip(_TRIM)))
        out.append((kind, int(points[a]), int(points[b])))
    return out


def apart(spans: list[tuple[str, int, int]], taken: list[tuple[int, int]]) -> list[tuple[str, int, int]]:
    """The spans that overlap none of those taken, in one pass over both in order."""
    out, ends, k = [], -1, 0
    taken = sorted(taken)
    for span in sorted(spans, key=lambda x: x[1:]):
        while k < len(taken) and taken[k][0] < span[2]:
            ends = max(ends, taken[k][1])
            k += 1
        if ends <= span[1]:
            out.append(span)
    return out


def find(text: bytes | None, tagger: Tagger) -> tuple[list[tuple[int, int, int]], list[tuple[str, int, int]]]:
    """The patterns' spans, and the field's that don't overlap them."""
    decoded = (text or b"").decode("utf-8", "replace")
    base = base_spans(decoded)
    return base, apart(added_spans(decoded.encode(), tagger), [(a, b) for _, a, b in base])


def scan(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_added."""
    shared = docs.sparkSession.sparkContext.broadcast(train())

    def make():
        tagger = Tagger(shared.value)

        def f(texts: list[bytes | None]) -> list[list]:
            out: list[list] = [[] for _ in range(7)]
            for text in texts:
                base, more = find(text, tagger)
                for k in range(4):
                    out[k].append(sum(x[0] == k for x in base))
                joined = [f"{KINDS[k]}:{a}:{b}" for k, a, b in base]
                out[4].append(hashlib.sha256(",".join(joined).encode()).hexdigest())
                out[5].append(",".join(joined + [f"crf_{k}:{a}:{b}" for k, a, b in sorted(more)]))
                out[6].append(len(more))
            return out

        return f

    return map_texts(docs, ["doc_id"], "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, n_added long", make)
