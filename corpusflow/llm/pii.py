"""Personal data: rules, and a character-level bidirectional LSTM with a CRF that adds to them.

The rules find e-mail addresses, IP addresses, card and phone numbers as they are usually written.
The model, trained in numpy on labelled spans, finds what rules do not: secrets, and addresses and
numbers that are spelled out, bracketed or oddly grouped. Its training windows come from a bounded
sample of documents, as they are with the spans of the rules and values assigned to names of secrets,
and with labelled spans of other forms planted into them, beside harmless look-alikes. A tag is O, or begin or inside of a kind.

Personal data always holds a character that plain prose lacks: a digit, an at sign, a bracket, an
underscore, a sign of assignment. The model reads windows around each of these, wherever they are in
a text; windows overlap by half, each decides on the spans whose middle is in its own middle half,
and what windows propose is reconciled over the whole text, surest first. The least certainty of a
span is calibrated on windows that the model was not trained on.
"""

from __future__ import annotations

import random
import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of the rules, and those that only the model finds.
KINDS = ("email", "ip", "card", "phone")
ALL_KINDS = (*KINDS, "secret")
LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
#: A match that begins inside a run of digits would also begin at the run's start.
IP = re.compile(r"(?<![0-9])[0-9]+(?:\.[0-9]+){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
DIGIT = re.compile(r"[0-9]")
AT_SIGN = re.compile(r"@|[\W_]at[\W_]", re.I)
DIGIT_OR_AT = re.compile(r"[0-9@]")
ANCHOR = re.compile(r"[0-9@_=+\[\](){}]|\b(?:at|dot)\b", re.I)

#: Windows that are decoded at once.
BLOCK = 4000
#: Spans of up to half a window are found.
WINDOW, HIDDEN = 96, 20
#: The model is trained on shorter windows, each with one span or anchor at a random place.
CROP = 64
TAGS = 1 + 2 * len(ALL_KINDS)
#: Bounds of what is fitted on: documents, and windows of each of three sorts (with spans of the rules,
#: with anchors but no span, with planted spans); a fifth of them calibrates.
SAMPLE_DOCS, SAMPLE_WINDOWS, EPOCHS = 3000, 900, 10
#: Least certainty of a span that the model adds (mean marginal probability of its characters, but twice
#: that of its ends at most): where it starts, what calibration may raise it to, and the precision that it asks for.
SURE, LEVELS, PRECISION = 0.5, (0.5, 0.6, 0.7, 0.75, 0.8, 0.85, 0.9, 0.95, 0.98), 0.95
# Least letters and digits of a span of the model, by kind.
LEAST = {"email": 5, "ip": 4, "card": 12, "phone": 7, "secret": 8}

Span = tuple[str, int, int]


def luhn(digits: str) -> bool:
    values = [int(c) for c in digits[::-1]]
    return (sum(values[::2]) + sum(sum(divmod(2 * v, 10)) for v in values[1::2])) % 10 == 0


def rule_spans(text: str) -> tuple[list[Span], list[tuple[int, int]]]:
    """Spans (kind, start, end) by start, then kind as listed; and what a rule matched but rejected."""
    found: list[Span] = []
    rejected: list[tuple[int, int]] = []
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in LOCAL:
            start -= 1
        domain = DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            found.append(("email", start, domain.end()))
            end = domain.end()
        at = text.find("@", max(at + 1, end))
    if DIGIT.search(text):
        for m in IP.finditer(text):
            ok = all(len(p := x.lstrip("0")) < 4 and int(p or 0) <= 255 for x in m.group().split("."))
            (found if ok else rejected).append(("ip", *m.span()) if ok else m.span())
        for m in CARD.finditer(text):
            digits = m.group().replace(" ", "").replace("-", "")
            if 12 <= len(digits) <= 19:
                ok = luhn(digits)
                (found if ok else rejected).append(("card", *m.span()) if ok else m.span())
        for m in PHONE.finditer(text) if "+" in text else ():
            ok = 9 <= sum(c.isdigit() for c in m.group()) <= 15
            (found if ok else rejected).append(("phone", *m.span()) if ok else m.span())
    return sorted(found, key=lambda s: (s[1], KINDS.index(s[0]))), rejected


# How names of secrets, at signs, dots and separators of digits are written by those who do not follow the rules' forms.
SECRET_NAMES = ("token", "api_key", "apikey", "api-key", "secret", "client_secret", "password", "passwd", "pwd", "access_key", "auth", "Bearer")
SECRET_HEADS = ("", "", "", "AKIA", "ghp_", "sk-", "xoxb-")
AT = (" (at) ", "(at)", " [at] ", "[at]", "{at}", " @ ", " at ")
DOT = (" (dot) ", " [dot] ", "[.]", "(dot)", " dot ", ".")
TOP = ("com", "net", "org", "de", "fr", "es")
HARMLESS = ("{0}-{1:02}-{2:02}", "{2:02}/{1:02}/{0}", "{0}.{1}", "v{1}.{2}.{1}", "({0})", "[{1}]", "{1}:{2:02}", "No. {3}", "x = {2}", "{0}_{1}", "{1} + {2} = {2}", "{3}{3}", "n={1}", "(see {2})", "[{0}: {1}]", "{1},{2}")


ASSIGNED = re.compile(rf"(?i)\b(?:{'|'.join(SECRET_NAMES)})[\"']?\s*[:=]{{1,2}}\s*[\"']?([A-Za-z0-9_+/=-]{{12,}})")


def natural_spans(text: str) -> list[Span]:
    """Labels of a text as it is: the spans of the rules, and long values assigned to names of secrets."""
    secrets = [("secret", *m.span(1)) for m in ASSIGNED.finditer(text)]
    base = rule_spans(text)[0]
    return base + [s for s in secrets if all(s[2] <= a or s[1] >= b for _, a, b in base)]


def _digits(rng: random.Random, n: int) -> str:
    return "".join(rng.choices("0123456789", k=n))


def card_number(rng: random.Random) -> str:
    base = rng.choice("3456") + _digits(rng, 14)
    return next(base + d for d in "0123456789" if luhn(base + d))


def other_form(rng: random.Random, words: list[str]) -> tuple[str, str, str, str]:
    """(before, span, after, kind) of something personal in a form that the rules miss."""
    kind = rng.choice(ALL_KINDS + ("secret",))
    word = lambda: re.sub(r"\W", "", rng.choice(words)).lower() or "name"
    if kind == "email":
        dot = rng.choice(DOT)
        at = rng.choice(AT[:-1] if dot == "." else AT)
        dot = dot if at != " @ " else rng.choice(DOT)
        name = word() + rng.choice(["", "", f".{word()}", f"_{word()}", _digits(rng, 2)])
        return rng.choice(["", "", "mail: ", "contact "]), f"{name}{at}{word()}{dot}{rng.choice(TOP)}", "", kind
    if kind == "ip":
        return rng.choice(["", "host ", "ip: "]), rng.choice(["[.]", "(.)", " . ", " dot ", "[dot]"]).join(str(rng.randrange(256)) for _ in range(4)), "", kind
    if kind == "card":
        n = card_number(rng)
        return rng.choice(["", "card ", "no. "]), rng.choice([".", "/", "_", "  ", ":"]).join(n[i : i + 4] for i in range(0, 16, 4)), "", kind
    if kind == "phone":
        a, b, c = _digits(rng, 3), _digits(rng, 3), _digits(rng, 4)
        form = rng.choice([f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"0{a} {b}{c}", f"00{a[:2]} {b} {c}", f"0{a}/{b}{c}", f"({a}){b} {c}"])
        return rng.choice(["", "", "tel ", "call ", "phone: "]), form, "", kind
    head = rng.choice(SECRET_HEADS)
    letters = rng.choice(["0123456789abcdef", "0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-+"])
    value = head + "".join(rng.choices(letters, k=rng.choice([16, 20, 24, 32, 36, 40, 40])))
    quote = rng.choice(['"', '"', "'", ""])
    name = rng.choice(SECRET_NAMES)
    joint = " " if name == "Bearer" else rng.choice([" = ", "=", ": ", ":", " := "])
    before = "" if head and rng.random() < 0.5 else name + joint
    return before + quote, value, quote, kind


def planted(texts: list[str], rng: random.Random) -> list[tuple[str, list[Span]]]:
    """The texts with one labelled span of another form in each, and some with a harmless look-alike."""
    out = []
    for text in texts:
        words = text.split() or ["text"]
        at = rng.randrange(len(words) + 1)
        numbers = (rng.randrange(1950, 2030), rng.randrange(1, 13), rng.randrange(1, 29), rng.randrange(1000, 10**8))
        look = " ".join(rng.choice(HARMLESS).format(*numbers) for _ in range(rng.choice((1, 1, 2, 3))))
        lead = " ".join([*words[:at][-12:], ""])
        trail = " ".join(["", *words[at:][:12]])
        if rng.random() < 0.35:
            whole = f"{lead}{look}{trail}"
            out.append((whole, natural_spans(whole)))
            continue
        before, span, after, kind = other_form(rng, words)
        start = len(lead) + len(before)
        more = f" {look}" if rng.random() < 0.3 else ""
        whole = f"{lead}{before}{span}{after}{rng.choice(['', '', '.', ','])}{more}{trail}"
        beside = [s for s in natural_spans(whole) if s[2] <= start or s[1] >= start + len(span)]
        out.append((whole, [*beside, (kind, start, start + len(span))]))
    return out


#: Character classes: letters of either case, digits as one, marks that shape personal data, the rest.
MARKS = "@._%+-()/:,;#=[]{}<>\"'*"
CLASSES = 4 + 26 + len(MARKS)


def char_classes(text: str) -> np.ndarray:
    table = np.full(128, 0, np.int64)
    table[[9, 10, 13, 32]] = 1
    table[48:58] = 2
    for i in range(26):
        table[97 + i] = table[65 + i] = 4 + i
    for i, c in enumerate(MARKS):
        table[ord(c)] = 30 + i
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    out = table[np.minimum(points, 127)]
    out[points >= 127] = 3
    return out


def window_starts(text: str) -> list[int]:
    """Windows of half-overlap that put every anchor character into some window's middle half."""
    half, starts = WINDOW // 2, []
    for m in ANCHOR.finditer(text):
        block = (m.start() + half // 2) // half
        for s in (block - 1, block):
            if not starts or s * half > starts[-1]:
                starts.append(s * half)
    return [s - half // 2 for s in starts]


class Model:
    """Parameters of both LSTM directions, the output layer and the CRF; one window is a row."""

    def __init__(self, seed: int = 11) -> None:
        self.sure = dict.fromkeys(ALL_KINDS, SURE)
        rng = np.random.default_rng(seed)
        h = HIDDEN
        self.p = {}
        for d in "fb":
            self.p[f"x{d}"] = rng.normal(0, 0.2, (CLASSES + 1, 4 * h))
            self.p[f"x{d}"][:, h : 2 * h] += 1.0  # the forget gate starts open
            self.p[f"h{d}"] = rng.normal(0, h**-0.5, (h, 4 * h))
        self.p["o"] = rng.normal(0, 0.1, (2 * h, TAGS))
        self.p["c"] = np.zeros(TAGS)
        self.p["t"] = np.zeros((TAGS, TAGS))

    def emissions(self, x: np.ndarray, train: bool = False) -> tuple[np.ndarray, tuple]:
        """Scores of tags. Both directions run side by side, the second over the windows turned round."""
        h, n, width = HIDDEN, *x.shape
        kind = self.p["o"].dtype
        hid, cell = np.zeros((2, n, h), kind), np.zeros((2, n, h), kind)
        out, kept = np.empty((2, n, width, h), kind), []
        given, onward = np.stack([self.p["xf"][x], self.p["xb"][x[:, ::-1]]]), np.stack([self.p["hf"], self.p["hb"]])
        for t in range(width):
            z = given[:, :, t] + hid @ onward
            gate = 1 / (1 + np.exp(-z[:, :, : 3 * h]))
            new = np.tanh(z[:, :, 3 * h :])
            before, cell = cell, gate[:, :, h : 2 * h] * cell + gate[:, :, :h] * new
            tall = np.tanh(cell)
            if train:
                kept.append((t, hid, gate, new, before, tall))
            hid = gate[:, :, 2 * h :] * tall
            out[:, :, t] = hid
        both = np.concatenate([out[0], out[1][:, ::-1]], axis=2)
        return both @ self.p["o"] + self.p["c"], (both, kept)

    def chain(self, e: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward log sums and log partition."""
        move = self.p["t"]
        a, b = np.empty_like(e), np.zeros_like(e)
        a[:, 0] = e[:, 0]
        ex = np.exp(move)
        for t in range(1, e.shape[1]):
            top = a[:, t - 1].max(axis=1, keepdims=True)
            a[:, t] = np.log(np.exp(a[:, t - 1] - top) @ ex + 1e-30) + top + e[:, t]
        for t in range(e.shape[1] - 2, -1, -1):
            nxt = b[:, t + 1] + e[:, t + 1]
            top = nxt.max(axis=1, keepdims=True)
            b[:, t] = np.log(np.exp(nxt - top) @ ex.T + 1e-30) + top
        top = a[:, -1].max(axis=1, keepdims=True)
        return a, b, top + np.log(np.exp(a[:, -1] - top).sum(axis=1, keepdims=True))

    def gradient(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean negative log likelihood of tags y, and its gradient."""
        n, width = x.shape
        e, (both, kept) = self.emissions(x, train=True)
        a, b, z = self.chain(e)
        rows, cols = np.arange(n)[:, None], np.arange(width)[None, :]
        gold = e[rows, cols, y].sum() + self.p["t"][y[:, :-1], y[:, 1:]].sum()
        g = {k: np.zeros_like(v) for k, v in self.p.items()}
        de = np.exp(a + b - z[:, :, None])
        de[rows, cols, y] -= 1
        pair = np.zeros_like(self.p["t"])
        for t in range(1, width):
            pair += np.exp(a[:, t - 1, :, None] + self.p["t"] + (e[:, t] + b[:, t])[:, None, :] - z[:, :, None]).sum(axis=0)
        np.subtract.at(pair, (y[:, :-1], y[:, 1:]), 1)
        g["t"] = pair
        g["c"] = de.sum(axis=(0, 1))
        g["o"] = both.reshape(-1, both.shape[2]).T @ de.reshape(-1, TAGS)
        dh_all = de @ self.p["o"].T
        h = HIDDEN
        part = np.stack([dh_all[:, :, :h], dh_all[:, ::-1, h:]])
        dh, dc = np.zeros((2, n, h), de.dtype), np.zeros((2, n, h), de.dtype)
        back = np.stack([self.p["hf"].T, self.p["hb"].T])
        dz, hids = np.empty((2, width, n, 4 * h), de.dtype), np.empty((2, width, n, h), de.dtype)
        for t, hid, gate, new, before, tall in reversed(kept):
            dh = dh + part[:, :, t]
            dc = dc + dh * gate[:, :, 2 * h :] * (1 - tall * tall)
            now = dz[:, t]
            now[:, :, :h], now[:, :, h : 2 * h], now[:, :, 2 * h : 3 * h] = dc * new, dc * before, dh * tall
            now[:, :, : 3 * h] *= gate * (1 - gate)
            now[:, :, 3 * h :] = dc * gate[:, :, :h] * (1 - new * new)
            hids[:, t] = hid
            dh = now @ back
            dc = dc * gate[:, :, h : 2 * h]
        for k, d in enumerate("fb"):
            seen = (x.T if d == "f" else x.T[::-1]).reshape(-1)
            flat = dz[k].reshape(-1, 4 * h)
            g[f"x{d}"] = (np.arange(CLASSES + 1)[:, None] == seen[None, :]).astype(de.dtype) @ flat
            g[f"h{d}"] = hids[k].reshape(-1, h).T @ flat
        return float((z.sum() - gold) / n), {k: v / n for k, v in g.items()}

    def train(self, x: np.ndarray, y: np.ndarray, epochs: int = 6, batch: int = 64, rate: float = 0.03) -> float:
        """Adam, with a rate that falls to a tenth."""
        rng, step, loss = np.random.default_rng(3), 0, 0.0
        steps = epochs * -(-len(x) // batch)
        m = {k: np.zeros_like(v) for k, v in self.p.items()}
        s = {k: np.zeros_like(v) for k, v in self.p.items()}
        for _ in range(epochs):
            order = rng.permutation(len(x))
            for i in range(0, len(x), batch):
                step += 1
                now = rate * (1 - 0.9 * step / steps)
                loss, g = self.gradient(x[order[i : i + batch]], y[order[i : i + batch]])
                for k in self.p:
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    s[k] = 0.999 * s[k] + 0.001 * g[k] ** 2
                    self.p[k] -= now * (m[k] / (1 - 0.9**step)) / (np.sqrt(s[k] / (1 - 0.999**step)) + 1e-8)
        return loss

    def decode(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Best tags by Viterbi, and the marginal probability of each."""
        e, _ = self.emissions(x)
        a, b, z = self.chain(e)
        p = np.exp(a + b - z[:, :, None])
        move, score, back = self.p["t"], e[:, 0], []
        for t in range(1, x.shape[1]):
            way = score[:, :, None] + move
            back.append(way.argmax(axis=1))
            score = way.max(axis=1) + e[:, t]
        tags = np.empty(x.shape, np.int64)
        tags[:, -1] = score.argmax(axis=1)
        for t in range(x.shape[1] - 2, -1, -1):
            tags[:, t] = back[t][np.arange(len(x)), tags[:, t + 1]]
        return tags, np.take_along_axis(p, tags[:, :, None], axis=2)[:, :, 0]


def cut(codes: np.ndarray, starts: list[int], fill: int, width: int = WINDOW) -> np.ndarray:
    """Windows of an array, with `fill` where they stick out."""
    at = np.array(starts)[:, None] + np.arange(width)[None, :]
    inside = (at >= 0) & (at < len(codes))
    return np.where(inside, codes[np.clip(at, 0, max(0, len(codes) - 1))] if len(codes) else fill, fill)


def plausible(kind: str, part: str) -> bool:
    """Whether a span of the model has the parts that its kind cannot be without."""
    numbers = re.findall("[0-9]+", part)
    digits = "".join(numbers)
    if kind == "ip":
        between = set(re.split("[0-9]+", part)[1:-1])
        return len(numbers) == 4 and len(between) == 1 and bool(between.pop().strip()) and all(len(n) < 4 and int(n) <= 255 for n in numbers)
    if kind == "card":
        return 12 <= len(digits) <= 19 and luhn(digits)
    if kind == "phone":
        return 7 <= len(digits) <= 15
    return sum(map(str.isalnum, part)) >= LEAST[kind] and (kind != "email" or AT_SIGN.search(part) is not None)


def model_spans(
    text: str, starts: list[int], tags: np.ndarray, sure: np.ndarray, taken: list[tuple[int, int]], least: dict[str, float] | None = None
) -> list[Span]:
    """What the windows of one text propose, are sure enough of, and nothing taken or surer overlaps."""
    quarter = WINDOW // 4
    proposals = []
    for w in np.flatnonzero((tags > 0).any(axis=1)):
        i = 0
        while i < WINDOW:
            tag = tags[w, i]
            j = i + 1
            if tag:
                inner = tag + tag % 2  # odd tags begin a kind, even ones go on with it
                while j < WINDOW and tags[w, j] == inner:
                    j += 1
                if quarter <= (i + j) // 2 < 3 * quarter and i and j < WINDOW:
                    proposals.append((float(min(sure[w, i:j].mean(), 2 * min(sure[w, i], sure[w, j - 1]))), ALL_KINDS[(tag - 1) // 2], starts[w] + i, starts[w] + j))
            i = j
    spans: list[Span] = []
    used = list(taken)
    for p, kind, a, b in sorted(proposals, key=lambda x: (-x[0], x[2], x[3])):
        part = text[max(0, a) : b]
        if p >= (least or {}).get(kind, SURE) and a >= 0 and b <= len(text) and plausible(kind, part) and all(b <= c or a >= d for c, d in used):
            spans.append((kind, a, b))
            used.append((a, b))
    return spans


def tags_of(text: str, spans: list[Span]) -> np.ndarray:
    """Tag of each character; of spans that overlap the first counts."""
    tags = np.zeros(len(text), np.int64)
    for kind, a, b in spans:
        if not tags[a:b].any():
            tags[a:b] = 2 + 2 * ALL_KINDS.index(kind)
            tags[a] -= 1
    return tags


def training_windows(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """All windows of texts as they are, labelled by the rules."""
    x, y = [np.empty((0, WINDOW), np.int64)], [np.empty((0, WINDOW), np.int64)]
    for text in texts:
        if starts := window_starts(text):
            x.append(cut(char_classes(text), starts, CLASSES))
            y.append(cut(tags_of(text, rule_spans(text)[0]), starts, 0))
    return np.concatenate(x), np.concatenate(y)


def crops(labelled: list[tuple[str, list[Span]]], rng: random.Random) -> tuple[np.ndarray, np.ndarray]:
    """One short window of each text, around one of its spans or, without any, one of its anchors."""
    x, y = [], []
    for text, spans in labelled:
        anchors = [m.start() for m in ANCHOR.finditer(text)] or [0]
        at = rng.choice(anchors)
        _, a, b = rng.choice(spans) if spans else ("", at, at + 1)
        slack = max(0, CROP - (b - a))
        start = [a - rng.randint(slack // 8, slack - slack // 8)]
        x.append(cut(char_classes(text), start, CLASSES, CROP))
        y.append(cut(tags_of(text, spans), start, 0, CROP))
    return np.concatenate(x), np.concatenate(y)


def find_spans(model: Model, texts: list[str], least: dict[str, float] | None = None) -> list[list[Span]]:
    """What the model adds to the rules in each text; windows are decoded in blocks of bounded size."""
    out: list[list[Span]] = [[] for _ in texts]
    held: list[tuple[int, list[int], np.ndarray]] = []

    def settle() -> None:
        tags, sure = model.decode(np.concatenate([x for _, _, x in held]))
        decoded, at = {}, 0
        for i, starts, _ in held:
            decoded.setdefault(i, []).append((starts, tags[at : at + len(starts)], sure[at : at + len(starts)]))
            at += len(starts)
        for i, parts in decoded.items():
            base, rejected = rule_spans(texts[i])
            taken = [(a, b) for _, a, b in base] + rejected + [(a, b) for _, a, b in out[i]]
            starts = [s for part in parts for s in part[0]]
            out[i] += model_spans(texts[i], starts, np.concatenate([p[1] for p in parts]), np.concatenate([p[2] for p in parts]), taken, least)
        held.clear()

    size = 0
    for i, text in enumerate(texts):
        starts = window_starts(text)
        classes = char_classes(text) if starts else None
        for k in range(0, len(starts), BLOCK):
            part = starts[k : k + BLOCK]
            held.append((i, part, cut(classes, part, CLASSES)))
            size += len(part)
            if size >= BLOCK:
                settle()
                size = 0
    if held:
        settle()
    return out


def calibrate(model: Model, labelled: list[tuple[str, list[Span]]]) -> dict[str, float]:
    """By kind, the least certainty at which nearly all that the model adds is labelled; the highest level if none is enough."""
    sure = dict.fromkeys(ALL_KINDS, LEVELS[-1])
    for least in reversed(LEVELS):
        found = find_spans(model, [t for t, _ in labelled], dict.fromkeys(ALL_KINDS, least))
        for kind in ALL_KINDS:
            mine = [(s in spans) for f, (_, spans) in zip(found, labelled, strict=True) for s in f if s[0] == kind]
            if mine and sum(mine) >= PRECISION * len(mine):
                sure[kind] = least
    return sure


def fit(docs: DataFrame) -> Model | None:
    """`docs` has id and text. Learns from at most SAMPLE_DOCS documents that hold an anchor.

    Documents and windows are chosen by hashes over all of them, so neither the first rows nor the
    beginnings of texts are preferred, and reruns agree.
    """
    anchored = docs.where(F.col("text").rlike("[0-9@]") & F.col("id").isNotNull()).select("id", F.xxhash64("id").alias("h"))
    ids = [(r[0],) for r in anchored.orderBy("h", "id").limit(SAMPLE_DOCS).select("id").collect()]
    if not ids:
        return None
    wanted = docs.sparkSession.createDataFrame(ids, "id long").distinct()
    around = docs.join(F.broadcast(wanted), "id").mapInArrow(_neighbourhoods, "has boolean, part string").withColumn("h", F.xxhash64("part"))
    pick = lambda has: [r["part"] for r in around.where(F.col("has") == has).distinct().orderBy("h", "part").limit(SAMPLE_WINDOWS).collect()]
    with_span, without = pick(True), pick(False)
    rng = random.Random(17)
    every = with_span + without
    natural = [(t, natural_spans(t)) for t in every]
    other = planted([rng.choice(every) for _ in range(4 * SAMPLE_WINDOWS)], rng)
    held = natural[::5] + other[::5]
    learn = [t for k, t in enumerate(natural) if k % 5] + [t for k, t in enumerate(other) if k % 5]
    model = Model()
    model.p = {k: v.astype(np.float32) for k, v in model.p.items()}
    model.train(*crops(learn, rng), epochs=EPOCHS)
    model.sure = calibrate(model, [(t, [s for s in spans if s not in rule_spans(t)[0]]) for t, spans in held])
    return model


def _neighbourhoods(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What windows around digits and at signs see, and whether something in it has a label."""
    for batch in batches:
        parts = []
        for text in batch.column("text").to_pylist():
            last = -WINDOW
            for m in DIGIT_OR_AT.finditer(text or ""):
                if m.start() >= last + WINDOW // 2:
                    last = m.start()
                    parts.append(text[max(0, last - WINDOW) : last + WINDOW])
        yield pa.record_batch({"has": pa.array([bool(natural_spans(p)) for p in parts], pa.bool_()), "part": pa.array(parts, pa.string())})


def find_personal_data(docs: DataFrame, fit_on: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: id_col, spans.

    spans is array<struct<kind, start, end, rule>> by start, then kind as in ALL_KINDS; offsets are code
    points, end exclusive; rule is false for what the model added. Spans of different rules may
    overlap, those of the model overlap none, nor what a rule matched but rejected. A null or empty text has no spans. `fit_on` has id and
    text and defaults to `docs`; without anything to learn from the rules stand alone. Repeated rows
    get equal results; an empty table gives an empty one; no other columns are read.
    """
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    model = fit(rows if fit_on is None else fit_on)

    def settle(texts: list[str]) -> list[list[dict]]:
        added = find_spans(model, texts, model.sure) if model else [[] for _ in texts]
        out = []
        for text, more in zip(texts, added, strict=True):
            every = [(k, a, b, True) for k, a, b in rule_spans(text)[0]] + [(k, a, b, False) for k, a, b in more]
            every.sort(key=lambda s: (s[1], ALL_KINDS.index(s[0]), s[2]))
            out.append([{"kind": k, "start": a, "end": b, "rule": r} for k, a, b, r in every])
        return out

    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("rule", pa.bool_())]))

    def find(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, len(batch), 500):
                part = batch.slice(i, 500)
                spans = settle([t or "" for t in part.column("text").to_pylist()])
                yield pa.record_batch({"id": part.column("id"), "spans": pa.array(spans, kind)})

    return rows.mapInArrow(find, "id long, spans array<struct<kind:string,start:int,end:int,rule:boolean>>").withColumnRenamed("id", id_col)
