"""Operator 8: personal data by fixed patterns and a character-level bidirectional LSTM with a CRF, trained in numpy.

The patterns find e-mail addresses, IPv4 addresses, card numbers and phone numbers; their spans always stay. The model adds
what the patterns have no form for: phones without a plus, cards of 13 to 15 digits, with other separators or beside other
digits, addresses of hosts that are defanged or of version 6, mail addresses that are spelt out or have other letters. It
learns from labelled spans of lines made of invented words, passages of texts and numbers that are no such data.

Every text is scored wherever a digit, an at sign or a bracketed "at" stands, since nothing else can be a span of these
kinds: overlapping windows around such places are decoded, spans cut by a window's edge are left to its neighbour, and what
the windows of a text say is reconciled over the whole text. A span of the model counts if it passes the checks that a
number or address of its kind must pass (a checksum, a range, an at and a dot) and meets no other span.

Training takes minutes, so ``load`` reads weights that ``python -m tilespark.llm.pii TABLE`` has made from a table of texts
and written beside this module; they are a few ten thousand numbers.
"""

from __future__ import annotations

import ipaddress
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import small_batches

KINDS = ("email", "ip", "card", "phone")
TAGS = 1 + 2 * len(KINDS)  # outside, then begin and inside of each kind
CHARS, OTHER, PAD = string.printable[:95], 95, 96

#: Where a span can be.
TRIGGER = re.compile(r"[0-9@]+|[\[({<]\x20?[aA][tT]\x20?[\])}>]")
WEIGHTS = Path(__file__).with_name("pii_weights.npz")
MAIL_LOCAL = frozenset(string.ascii_letters + string.digits + "._%+-")
MAIL_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else d * 2 - 9 * (d > 4)
    return total % 10 == 0


def digits_of(text: str) -> str:
    return "".join(c for c in text if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the patterns by kind, then start. Linear in the text: no place is the start of more than one long scan."""
    out, at, end = [], text.find("@"), 0
    while at >= 0:
        start = at
        while start > end and text[start - 1] in MAIL_LOCAL:
            start -= 1
        found = MAIL_DOMAIN.match(text, at + 1) if start < at else None
        if found:
            out.append(("email", start, end := found.end()))
        else:
            end = at + 1  # what stands before the sign cannot be part of a later address
        at = text.find("@", max(end, at + 1))
    for found in IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in found[0].split(".")):
            out.append(("ip", *found.span()))
    for kind, pattern, least, most in (("card", CARD, 16, 19), ("phone", PHONE, 8, 15)):
        for found in pattern.finditer(text):
            digits = digits_of(found[0])
            if least <= len(digits) <= most and (kind == "phone" or luhn(digits)):
                out.append((kind, *found.span()))
    return out


def codes(text: str) -> np.ndarray:
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    table = np.full(128, OTHER, np.int32)
    for i, ch in enumerate(CHARS):
        table[ord(ch)] = i
    return np.where(c < 128, table[np.minimum(c, 127)], OTHER).astype(np.int32)


# ---------------------------------------------------------------- labelled spans


class Draw:
    """Generated pieces: a text and the spans (kind, start, end) in it."""

    def __init__(self, seed):
        self.rng = np.random.default_rng(seed)

    def pick(self, xs):
        return xs[self.rng.integers(len(xs))]

    def digits(self, k: int) -> str:
        return "".join(map(str, self.rng.integers(0, 10, k)))

    def chars(self, alphabet: str, low: int, high: int) -> str:
        return "".join(self.rng.choice(list(alphabet), self.rng.integers(low, high)))

    def word(self) -> str:
        word = self.chars("aeionrstlhducmgb" + "éñüèß" * (self.rng.random() < 0.2), 2, 9)
        return word if self.rng.random() < 0.8 else self.pick([word.upper(), word.capitalize()])

    def name(self) -> str:
        return self.chars("aeionrstlhducmgb", 3, 10)

    def card(self) -> str:
        """A number with a right checksum."""
        size = int(self.pick([13, 14, 15, 15, 16, 16, 16, 19]))
        body = self.pick("3456") + self.digits(size - 2)
        number = next(body + c for c in "0123456789" if luhn(body + c))
        cuts = {15: (4, 6, 5), 14: (4, 6, 4), 13: (4, 3, 3, 3), 19: (4, 4, 4, 4, 3)}.get(size, (4, 4, 4, 4))
        ends = np.cumsum(cuts)
        sep = self.pick(["", " ", "-", ".", "  ", "\u00a0", "/"])
        return sep.join(number[e - c : e] for c, e in zip(cuts, ends))

    def phone(self) -> str:
        d, sep = self.digits, self.pick([" ", "-", "."])
        return self.pick([
            lambda: f"+{d(1)} ({d(3)}) {d(3)}-{d(4)}", lambda: f"({d(3)}) {d(3)}-{d(4)}", lambda: f"{d(3)}{sep}{d(3)}{sep}{d(4)}", lambda: f"+{d(2)} {d(3)} {d(3)} {d(4)}", lambda: f"0{d(1)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}{sep}{d(2)}",
            lambda: f"({d(3)}){d(3)}-{d(4)}", lambda: f"1-{d(3)}-{d(3)}-{d(4)}", lambda: f"00{self.pick(['49', '33', '44', '1'])} {d(2)} {d(4)} {d(4)}", lambda: f"(0{d(2)}) {d(4)} {d(3)}", lambda: f"0{d(3)}/{d(3)} {d(3)}",
        ])()

    def email(self) -> str:
        pick, name = self.pick, self.name
        local = f"{name()}{pick(['', '.', '_'])}{pick(['', name(), self.digits(2)])}".rstrip("._")
        host, top = f"{name()}{pick(['', self.digits(1)])}{pick(['', '-' + name()])}", pick(["com", "org", "net", "de", "fr", "es", "co.uk"])
        if self.rng.random() < 0.35:
            return f"{local}@{host}.{top}"
        if self.rng.random() < 0.2:
            accent = self.pick("éñüèß")
            return f"{local}{accent}@{host}.{top}"
        at, dot = pick([(" (at) ", " (dot) "), ("(at)", "(dot)"), (" [at] ", " [dot] "), ("[at]", "."), (" (at) ", "."), (" @ ", " . "), (" [AT] ", " [DOT] "), ("{at}", "{dot}"), (" @ ", ".")])
        return local + at + host + dot + top.replace(".", dot)

    def ip(self) -> str:
        draw = self.rng.random()
        if draw < 0.4:
            return self.pick([".", ".", "[.]", "(.)", "[dot]", " . "]).join(str(x) for x in self.rng.integers(0, 256, 4))
        groups = [self.chars("0123456789abcdef", 1, 5) for _ in range(8)]
        return ":".join(groups) if draw < 0.7 else ":".join(groups[: self.rng.integers(1, 4)]) + "::" + ":".join(groups[5 : 5 + self.rng.integers(1, 3)])

    def personal(self) -> tuple[str, list[tuple[int, int, int]]]:
        k = int(self.rng.integers(len(KINDS)))
        piece = getattr(self, KINDS[k])()
        lead = self.digits(self.rng.integers(1, 3)) + " " if KINDS[k] == "card" and self.rng.random() < 0.15 else ""
        return lead + piece, [(k, len(lead), len(lead) + len(piece))]

    def other(self) -> str:
        """Numbers and signs that are no personal data."""
        rng, d, pick = self.rng, self.digits, self.pick

        def wrong() -> str:
            while luhn(digits_of(number := self.card())):
                number = "".join(str(rng.integers(10)) if c.isdigit() else c for c in number)
                if not luhn(digits_of(number)):
                    return number
            return number

        return pick([
            lambda: f"{rng.integers(1900, 2030)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", lambda: f"{rng.integers(1, 29)}{pick('/.')}{rng.integers(1, 13)}{pick('/.')}{rng.integers(1990, 2030)}", lambda: f"{rng.integers(0, 24)}:{rng.integers(0, 60):02d}{pick(['', ':' + d(2)])}",
            lambda: f"${rng.integers(1, 999)}.{d(2)}", lambda: f"{rng.integers(0, 9)}.{rng.integers(0, 30)}.{rng.integers(0, 9)}", lambda: f"{rng.integers(0, 30)}.{rng.integers(0, 30)}", self.token, lambda: f"#{d(rng.integers(2, 9))}",
            lambda: d(rng.integers(1, 14)), lambda: "AKIA" + self.chars("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", 16, 17), lambda: f"{rng.integers(1, 99)}.", lambda: f"@{self.word()}", lambda: f"{d(2)},{d(3)}", lambda: f"password={d(9)}{self.word()}",
            lambda: f"978-{d(1)}-{d(5)}-{d(3)}-{d(1)}", lambda: f"{rng.integers(1990, 2030)}-{rng.integers(1990, 2030)}", lambda: f"{d(3)} {d(3)} {d(3)}", wrong, wrong, lambda: f'token = "{self.token()}"', lambda: f"({pick(['at', 'a', 'see', 'dot'])}) {self.word()}",
            lambda: f"{self.word()} @ {d(2)}", lambda: f"({d(4)})", lambda: f"{d(1)}:{d(2)}", lambda: f"[{d(2)}]", lambda: f"{self.word()}::{self.word()}", lambda: f"{d(2)}-{d(2)}",
        ])()

    def token(self) -> str:
        return self.chars("0123456789abcdef", 12, 41)


def labelled_lines(n: int, width: int, seed: int, passages: list[str] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Lines of ``width`` characters and their tags: personal data among invented words, other numbers and, where given,
    pieces of ``passages``, in which the spans of the patterns are labelled."""
    draw = Draw(seed)
    rng, order = draw.rng, {k: i for i, k in enumerate(KINDS)}

    def passage() -> tuple[str, list[tuple[int, int, int]]]:
        whole = draw.pick(passages)
        at = int(rng.integers(max(1, len(whole) - 40)))
        piece = whole[at : at + int(rng.integers(10, 60))].strip()
        return piece, [(order[k], s, t) for k, s, t in base_spans(piece)]

    x, y = np.full((n, width), PAD, np.int32), np.zeros((n, width), np.int64)
    for row in range(n):
        text, spans, near = "", [], False
        size = width if rng.random() < 0.7 else int(rng.integers(width // 3, width))
        while len(text) < size:
            chance = rng.random()
            near = chance < (0.4 if near else 0.2)  # such data often stands together
            if near:
                piece, own = draw.personal()
            elif chance < 0.42:
                piece, own = draw.other(), []
            elif passages and chance < 0.75:
                piece, own = passage()
            else:
                piece, own = draw.word(), []
            spans += [(k, s + len(text), t + len(text)) for k, s, t in own]
            text += piece + draw.pick([" ", " ", " ", ", ", ". ", "\n", ": ", "; ", "### ", "!! ", ") "])
        x[row, :size] = codes(text[:size])
        for k, s, t in spans:
            if t <= size:
                y[row, s], y[row, s + 1 : t] = 1 + 2 * k, 2 + 2 * k
    return x, y


# ---------------------------------------------------------------- the network


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * z))


def lstm_forward(xg: np.ndarray, wh: np.ndarray) -> tuple[np.ndarray, list]:
    """Hidden states (n, t, h) of gate inputs (n, t, 4h), and what the way back needs."""
    n, t, h4 = xg.shape
    h = h4 // 4
    hs, kept, state, cell = np.zeros((n, t, h), xg.dtype), [], np.zeros((n, h), xg.dtype), np.zeros((n, h), xg.dtype)
    for k in range(t):
        g = xg[:, k] + state @ wh
        s = sigmoid(g[:, : 3 * h])
        i, f, o, u = s[:, :h], s[:, h : 2 * h], s[:, 2 * h :], np.tanh(g[:, 3 * h :])
        before = cell
        cell = f * before + i * u
        tc = np.tanh(cell)
        kept.append((i, f, o, u, before, tc, state))
        state = hs[:, k] = o * tc
    return hs, kept


def lstm_backward(dh: np.ndarray, kept: list, wh: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the gate inputs and of the recurrent weights."""
    n, t, h = dh.shape
    dxg, dwh, back, dcell = np.zeros((n, t, 4 * h), dh.dtype), np.zeros_like(wh), np.zeros((n, h), dh.dtype), np.zeros((n, h), dh.dtype)
    for k in range(t - 1, -1, -1):
        i, f, o, u, before, tc, state = kept[k]
        d = dh[:, k] + back
        dc = dcell + d * o * (1 - tc * tc)
        g = np.concatenate((dc * u * i * (1 - i), dc * before * f * (1 - f), d * tc * o * (1 - o), dc * i * (1 - u * u)), 1)
        dxg[:, k], dcell = g, dc * f
        dwh += state.T @ g
        back = g @ wh.T
    return dxg, dwh


def logsumexp(z: np.ndarray, axis: int) -> np.ndarray:
    top = z.max(axis, keepdims=True)
    return (top + np.log(np.exp(z - top).sum(axis, keepdims=True))).squeeze(axis)


def crf_loss(emit: np.ndarray, trans: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    """Mean negative log-likelihood of the tags and its gradients."""
    n, t, k = emit.shape
    a, b = np.zeros_like(emit), np.zeros_like(emit)
    a[:, 0] = emit[:, 0]
    for s in range(1, t):
        a[:, s] = emit[:, s] + logsumexp(a[:, s - 1, :, None] + trans, 1)
    for s in range(t - 2, -1, -1):
        b[:, s] = logsumexp(trans + (emit[:, s + 1] + b[:, s + 1])[:, None, :], 2)
    z = logsumexp(a[:, -1], 1)
    rows, steps = np.arange(n)[:, None], np.arange(t)[None]
    gold = emit[rows, steps, y].sum(1) + trans[y[:, :-1], y[:, 1:]].sum(1)
    demit = np.exp(a + b - z[:, None, None])
    demit[rows, steps, y] -= 1
    pair = np.exp(a[:, :-1, :, None] + trans + (emit[:, 1:] + b[:, 1:])[:, :, None, :] - z[:, None, None, None])
    dtrans = pair.sum((0, 1))
    np.add.at(dtrans, (y[:, :-1], y[:, 1:]), -1)
    return float((z - gold).mean()), demit / n, dtrans / n


@dataclass
class Tagger:
    params: dict[str, np.ndarray]

    @classmethod
    def new(cls, dims: int, hidden: int, seed: int, kind: type = np.float32) -> Tagger:
        rng = np.random.default_rng(seed)
        p = {"embed": rng.normal(0, 0.3, (PAD + 1, dims)), "out": rng.normal(0, 0.2, (2 * hidden, TAGS)), "bias": np.zeros(TAGS), "trans": np.zeros((TAGS, TAGS))}
        for d in ("f", "b"):
            p |= {f"wx{d}": rng.normal(0, 0.3, (dims, 4 * hidden)), f"wh{d}": rng.normal(0, 0.3, (hidden, 4 * hidden)), f"c{d}": np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]}
        return cls({k: v.astype(kind) for k, v in p.items()})

    def emissions(self, x: np.ndarray) -> tuple[np.ndarray, dict]:
        p, kept = self.params, {}
        for d in ("f", "b"):
            xs = x if d == "f" else x[:, ::-1]
            gates = (p["embed"] @ p[f"wx{d}"] + p[f"c{d}"])[xs]
            hs, kept[d] = lstm_forward(gates, p[f"wh{d}"])
            kept["h" + d] = hs if d == "f" else hs[:, ::-1]
        h = np.concatenate((kept["hf"], kept["hb"]), 2)
        kept["h"] = h
        return h @ p["out"] + p["bias"], kept

    def gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        p = self.params
        emit, kept = self.emissions(x)
        loss, demit, dtrans = crf_loss(emit, p["trans"], y)
        dh = demit @ p["out"].T
        g = {"trans": dtrans, "bias": demit.sum((0, 1)), "out": np.einsum("nth,ntk->hk", kept["h"], demit), "embed": np.zeros_like(p["embed"])}
        hidden = dh.shape[2] // 2
        for d, own in (("f", dh[:, :, :hidden]), ("b", dh[:, ::-1, hidden:])):
            dxg, g[f"wh{d}"] = lstm_backward(own, kept[d], p[f"wh{d}"])
            xs = x if d == "f" else x[:, ::-1]
            by_char = np.zeros((PAD + 1, dxg.shape[2]), dxg.dtype)
            np.add.at(by_char, xs.ravel(), dxg.reshape(-1, dxg.shape[2]))
            g[f"c{d}"], g[f"wx{d}"] = by_char.sum(0), p["embed"].T @ by_char
            g["embed"] += by_char @ p[f"wx{d}"].T
        return loss, g

    def decode(self, x: np.ndarray) -> np.ndarray:
        """Best tags of each row (Viterbi)."""
        emit, trans = self.emissions(x)[0], self.params["trans"]
        n, t, k = emit.shape
        back, score = np.zeros((n, t, k), np.int8), emit[:, 0]
        for s in range(1, t):
            step = score[:, :, None] + trans
            back[:, s] = step.argmax(1)
            score = step.max(1) + emit[:, s]
        tags = np.zeros((n, t), np.int8)
        tags[:, -1] = score.argmax(1)
        for s in range(t - 1, 0, -1):
            tags[:, s - 1] = back[np.arange(n), s, tags[:, s]]
        return tags


def train(*, lines: int = 1600, width: int = 72, dims: int = 12, hidden: int = 16, rounds: int = 12, batch: int = 32, rate: float = 0.03, seed: int = 8, passages: list[str] | None = None) -> Tagger:
    """A tagger for these parameters; every round has lines of its own."""
    model, rng, step = Tagger.new(dims, hidden, seed), np.random.default_rng(seed), 0
    first, second = ({k: np.zeros_like(v) for k, v in model.params.items()} for _ in range(2))
    total = rounds * -(-lines // batch)
    for turn in range(rounds):
        x, y = labelled_lines(lines, width, (seed, turn), passages)
        order = rng.permutation(lines)
        for at in range(0, lines, batch):
            _, g = model.gradients(x[order[at : at + batch]], y[order[at : at + batch]])
            step += 1
            norm = np.sqrt(sum(float((v * v).sum()) for v in g.values()))
            now = rate * (1 - 0.95 * step / total) * min(1.0, 10 / max(norm, 1e-9))
            for k, v in g.items():
                first[k] += 0.1 * (v - first[k])
                second[k] += 0.01 * (v * v - second[k])
                model.params[k] -= (now * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.99**step)) + 1e-6)).astype(np.float32)
    return model


@lru_cache(maxsize=1)
def load() -> Tagger:
    """The tagger whose weights stand beside this module."""
    with np.load(WEIGHTS) as kept:
        return Tagger({k: kept[k] for k in kept.files})


# ---------------------------------------------------------------- whole texts


def windows(text: str, width: int = 128, overlap: int = 64, margin: int = 48) -> list[tuple[int, int]]:
    """Windows (start, end) that cover every trigger with ``margin`` characters around."""
    runs: list[list[int]] = []
    for found in TRIGGER.finditer(text):
        start, end = max(0, found.start() - margin), min(len(text), found.end() + margin)
        if runs and start <= runs[-1][1]:
            runs[-1][1] = end
        else:
            runs.append([start, end])
    out = []
    for start, end in runs:
        while end - start > width:
            out.append((start, start + width))
            start += width - overlap
        out.append((start, end))
    return out


def plausible(kind: str, text: str, start: int, end: int) -> bool:
    """Whether a span of the model stands free and passes what any number or address of its kind must pass."""
    span = text[start:end]
    if start and text[start - 1].isalnum() or end < len(text) and text[end].isalnum():
        return False
    if kind == "email":
        return re.search(r"[^\s@]\s?(?:@|[\[({<]\s?at\s?[\])}>])\s?[^\s@]+", span, re.I) is not None and re.search(r"\w\s?(?:\.|[\[({<]\s?dot\s?[\])}>])\s?\w", span, re.I) is not None
    if kind == "ip":
        try:
            return bool(ipaddress.ip_address(re.sub(r"\s|[\[({]|[\])}]", "", re.sub("dot", ".", span))))
        except ValueError:
            return False
    digits = digits_of(span)
    if kind == "card":
        return 13 <= len(digits) <= 19 and luhn(digits) and not any(c.isalpha() for c in span)
    return 7 <= len(digits) <= 15 and not any(c.isalpha() for c in span)


def model_spans(texts: list[str], bases: list[list[tuple[str, int, int]]], model: Tagger, width: int = 128) -> list[list[tuple[str, int, int]]]:
    """What the model adds to the spans of the patterns, for each text."""
    places = [(i, s, t) for i, text in enumerate(texts) for s, t in windows(text, width)]
    found: list[dict[tuple[int, int, int], int]] = [{} for _ in texts]
    places.sort(key=lambda p: p[2] - p[1])  # windows of like length go together
    for at in range(0, len(places), 512):
        part = places[at : at + 512]
        x = np.full((len(part), max(t - s for _, s, t in part)), PAD, np.int32)
        for row, (i, s, t) in enumerate(part):
            x[row, : t - s] = codes(texts[i][s:t])
        for (i, s, t), tags in zip(part, model.decode(x)):
            on = 0
            while on < t - s:
                tag = int(tags[on])
                if tag % 2 == 0:
                    on += 1
                    continue
                end = on + 1
                while end < t - s and tags[end] == tag + 1:
                    end += 1
                # cut by an edge that is not the edge of the text: the next window has it whole
                if (on > 0 or s == 0) and (end < t - s or t == len(texts[i])):
                    key = (s + on, s + end, tag // 2)
                    found[i][key] = found[i].get(key, 0) + 1
                on = end
    out = []
    for text, base, votes in zip(texts, bases, found):
        taken, kept = sorted((s, t) for _, s, t in base), []
        for (s, t, k), _ in sorted(votes.items(), key=lambda v: (-v[1], v[0][0] - v[0][1], v[0])):
            if all(t <= a or s >= b for a, b in taken) and plausible(KINDS[k], text, s, t):
                taken.append((s, t))
                kept.append((KINDS[k], s, t))
        out.append(kept)
    return out


def find(docs: DataFrame, model: Tagger, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, spans) per row of ``docs``; spans: array of (kind, start, end, base), by kind, then start; code points.

    Null and empty texts have no span. Base spans of different kinds may overlap; spans of the model overlap nothing.
    """
    small_batches(docs.sparkSession)
    order = {k: i for i, k in enumerate(KINDS)}

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            texts = [t or "" for t in rows["text"]]
            marked = [i for i, t in enumerate(texts) if TRIGGER.search(t)]
            bases = [base_spans(texts[i]) for i in marked]
            more = model_spans([texts[i] for i in marked], bases, model)
            spans: list[list[dict]] = [[] for _ in texts]
            for i, base, added in zip(marked, bases, more):
                every = [(*s, True) for s in base] + [(*s, False) for s in added]
                spans[i] = [dict(zip(("kind", "start", "end", "base"), s)) for s in sorted(every, key=lambda s: (order[s[0]], s[1]))]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "spans": spans})

    schema = "doc_id long, spans array<struct<kind:string,start:long,end:long,base:boolean>>"
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInPandas(run, schema)


def passages_of(path: str, most: int = 2000) -> list[str]:
    """Texts to train on: of the rows of a table whose crc32(doc_id as text) mod 5 is not 0, ``most`` at most, first ids first."""
    import zlib

    import pyarrow.dataset as ds

    rows = ds.dataset(path).to_table(columns=["doc_id", "text"]).sort_by("doc_id").to_pylist()
    return [r["text"] for r in rows if r["text"] and zlib.crc32(str(r["doc_id"]).encode()) % 5][:most]


if __name__ == "__main__":
    import sys

    tagger = train(lines=6000, width=96, dims=16, hidden=32, rounds=14, batch=32, rate=0.02, passages=passages_of(sys.argv[1]))
    np.savez_compressed(WEIGHTS, **tagger.params)
