"""Personal data and secrets by a semi-Markov conditional random field.

A text is cut into islands: runs of space-separated chunks that hold a digit, '@', '=', a secret word with its colon or the start of a key, with the whole
chunk on either side. In what lies between no segment has a feature that speaks for an entity, so the field decides each island by
itself and the rest is certain to be outside. An island's tokens are runs of letters and digits and single other
characters, a key with a known prefix or a web token being one. A segmentation divides them into entities of 1 to MAX_TOKENS tokens (of any number of characters, in one line), each of one type, and single tokens
outside. Whole-span features score each candidate segment: the shape of the span as a whole, checksum, digits, what
stands before and after it. Transition scores join the types of neighbouring segments (outside is a type here). The dynamic program over (end, length, type, type before) finds the best segmentation, boundaries and types at once;
training maximises the likelihood of whole segmentations by the forward-backward form of the same program (Sarawagi and
Cohen 2004), on sentences made here by a seeded generator, with numbers, versions, dates, prices and code among them
that are not personal.

Result: (doc_id, type, start, length): an entity's place in characters; its text is not copied.
Defined results: null and empty texts have no entity. Repeated rows and null doc_ids give rows like any other. Texts of any
length are searched as a whole; doc_id is an integer or what casts to one. Ties go to the segmentation with the shorter last segment, then to the type first in TYPES.
"""

from __future__ import annotations

import math
import random
import re
from collections.abc import Iterator
from functools import lru_cache
from heapq import merge

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import arrow_map

TYPES = ("EMAIL", "PHONE", "CARD", "IP", "SECRET", "SSN", "IBAN")
MAX_TOKENS = 16
_PREFIXED = r"(?:sk|pk|ghp|gho|xoxb|xoxp)[-_][A-Za-z0-9_-]{12,}"
_WEB_TOKEN = r"eyJ[A-Za-z0-9_-]{5,}\.eyJ[A-Za-z0-9_-]{5,}\.[A-Za-z0-9_-]{5,}"
_TOKEN = re.compile(rf"{_WEB_TOKEN}|{_PREFIXED}|[^\W_]+|[^\w\s]|_")
_CHUNK = re.compile(r"\S+")

#: Shapes of a whole span.
SHAPES = {
    "email": re.compile(r"[\w.+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"),
    "ip": re.compile(r"(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)"),
    "ip6": re.compile(r"(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}"),
    "ip6_short": re.compile(r"(?=[^\d]*\d)(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?::(?:[0-9A-Fa-f]{1,4}(?::[0-9A-Fa-f]{1,4}){0,5})?"),
    "phone_plus": re.compile(r"\+\d{1,3}[ .-]?\(?\d{1,4}\)?(?:[ .-]?\d{2,4}){2,4}"),
    "phone_local": re.compile(r"\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}"),
    "digits_grouped": re.compile(r"\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}"),
    "digits_13_19": re.compile(r"\d{13,19}"),
    "ssn": re.compile(r"\d{3}-\d{2}-\d{4}"),
    "iban": re.compile(r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"),
    "cloud_key": re.compile(r"(?:AKIA|ASIA)[A-Z0-9]{16}"),
    "prefixed_key": re.compile(_PREFIXED),
    "web_token": re.compile(_WEB_TOKEN),
    "hex_long": re.compile(r"(?=[a-f]*\d)(?=\d*[a-f])[0-9a-f]{12,}"),
    "date": re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{1,4}"),
}
_SECRET_WORD = re.compile(r"(?:password|passwd|pwd|secret|token|api_?key|key)\s*[=:]\s*[\"']?$", re.I)
#: Characters before a value in which its secret word is looked for.
_LEAD = 24
_TRIGGER = re.compile(r"[\d@=]+|::|A[KS]IA|[kpob][-_](?=[A-Za-z0-9_-]{12})|eyJ")


def luhn(s: str) -> bool:
    d = [int(c) for c in reversed(s) if c.isdigit()]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def span_features(text: str, start: int, end: int) -> list[str]:
    """Features of text[start:end] as a segment, whatever its type."""
    s = text[start:end]
    out = ["any"]
    for name, shape in SHAPES.items():
        if shape.fullmatch(s):
            out.append(name)
    if "digits_13_19" in out or "digits_grouped" in out:
        out.append("luhn" if luhn(s) else "not_luhn")
    before, after = text[start - 1 : start], text[end : end + 1]
    if before.isalnum() or before in ("_", "@", "+"):
        out.append("cut_left")
    if before in (".", "-", "/") and text[start - 2 : start - 1].isalnum():
        out.append("joined_left")
    if after.isalnum() or after in ("_", "@"):
        out.append("cut_right")
    if after in (".", "-", "/", "@") and text[end + 1 : end + 2].isalnum():
        out.append("joined_right")
    if after in (" ", "-") and text[end + 1 : end + 2].isdigit():
        out.append("more_digits")
    if before in ("(", "+"):
        out.append("opened_before")
    if _SECRET_WORD.search(text[max(0, start - _LEAD) : start]):
        out.append("after_secret_word")
        if len(s) >= 6 and s.isalnum():
            out.append("secret_value")
    return out


def triggers(text: str) -> Iterator[tuple[int, int]]:
    """(start, end) of what an island is made around, by start: without one of these no segment has a shape or secret_value. An IBAN may have chunks of letters only."""
    colons = (i for i in (m.end() for m in re.finditer(":", text)) if _SECRET_WORD.search(text, max(0, i - _LEAD), i))
    return merge((m.span() for m in _TRIGGER.finditer(text)), (m.span() for m in SHAPES["iban"].finditer(text)), ((i - 1, i) for i in colons))


def islands(text: str) -> list[tuple[int, int]]:
    """(start, end) of the islands."""
    out: list[tuple[int, int]] = []
    done = 0
    for first, last in triggers(text):
        if last <= done:
            continue
        floor = out[-1][1] if out else 0
        start = first
        while start > floor and not text[start - 1].isspace():
            start -= 1
        done = _CHUNK.match(text, last - 1).end()
        prev = start
        while prev > floor and text[prev - 1].isspace():
            prev -= 1
        while prev > floor and not text[prev - 1].isspace():
            prev -= 1
        nxt = _CHUNK.search(text, done)
        right = nxt.end() if nxt else done
        if out and prev <= floor:
            out[-1] = (out[-1][0], right)
        else:
            out.append((prev, right))
    return out


def tokens(text: str, start: int, end: int) -> list[tuple[int, int]]:
    return [m.span() for m in _TOKEN.finditer(text, start, end)]


OUT = len(TYPES)


class Field:
    """Weights of (type, feature) and of (type before, type), OUT being outside; outside tokens have no features."""

    def __init__(self, weights: dict[tuple, float]) -> None:
        self.weights = weights
        self.lists = {}
        self.trans = [[weights.get((a, b), 0.0) for b in range(OUT + 1)] for a in range(OUT + 1)]
        for (k, f), w in weights.items():
            if isinstance(f, str):
                self.lists.setdefault(f, [0.0] * OUT)[k] = w

    def scores(self, features: list[str]) -> list[float]:
        total = [0.0] * OUT
        for f in features:
            w = self.lists.get(f)
            if w:
                total = [a + b for a, b in zip(total, w)]
        return total


def segments(text: str, toks: list[tuple[int, int]]):
    """For each end, (tokens in it, features) of the candidate segments. Spans without a shape or a secret word before them are left out: their only feature is the bias."""
    out: list[list[tuple[int, list[str]]]] = [[] for _ in range(len(toks) + 1)]
    for j in range(1, len(toks) + 1):
        for n in range(1, min(MAX_TOKENS, j) + 1):
            a, b = toks[j - n][0], toks[j - 1][1]
            if "\n" in text[a:b]:
                break
            f = span_features(text, a, b)
            if any(x in SHAPES for x in f) or "secret_value" in f:
                out[j].append((n, f))
    return out


def decode(field: Field, text: str, toks: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """The best segmentation's entities as (first token, tokens, type). A text begins after an outside token."""
    cand, trans = segments(text, toks), field.trans
    best: list[dict[int, float]] = [{OUT: 0.0}]
    back: list[dict[int, tuple[int, int]]] = [{}]
    for j in range(1, len(toks) + 1):
        own, how = {}, {}
        for y, s in best[j - 1].items():
            s += trans[y][OUT]
            if OUT not in own or s > own[OUT]:
                own[OUT], how[OUT] = s, (1, y)
        for n, f in cand[j]:
            for k, w in enumerate(field.scores(f)):
                for y, s in best[j - n].items():
                    s += w + trans[y][k]
                    if k not in own or s > own[k]:
                        own[k], how[k] = s, (n, y)
        best.append(own)
        back.append(how)
    out, j = [], len(toks)
    y = max(best[j], key=lambda y: (best[j][y], y == OUT, -y))
    while j:
        n, before = back[j][y]
        if y != OUT:
            out.append((j - n, n, y))
        j, y = j - n, before
    return out[::-1]


def _lse(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs))


def edges_of(field: Field, cand, n_toks: int) -> list[list[tuple[int, int, int, float, list[str]]]]:
    """For each end j, (start, type before, type, score, features) of the last steps to it."""
    labels = [{OUT}, *({OUT} | ({*range(OUT)} if own else set()) for own in cand[1:])]
    out: list[list] = [[]]
    for j in range(1, n_toks + 1):
        own = [(j - 1, y, OUT, field.trans[y][OUT], []) for y in labels[j - 1]]
        for n, f in cand[j]:
            own += [(j - n, y, k, w + field.trans[y][k], f) for k, w in enumerate(field.scores(f)) for y in labels[j - n]]
        out.append(own)
    return out


def forward(edges, n_toks: int) -> list[dict[int, float]]:
    fwd: list[dict[int, float]] = [{OUT: 0.0}]
    for j in range(1, n_toks + 1):
        into: dict[int, list[float]] = {}
        for i, y, k, s, _ in edges[j]:
            into.setdefault(k, []).append(fwd[i][y] + s)
        fwd.append({k: _lse(x) for k, x in into.items()})
    return fwd


def gradient(field: Field, cand, n_toks: int, gold: set[tuple[int, int, int]]) -> dict[tuple, float]:
    """Observed less expected features and transitions of one island, by forward and backward sums over segmentations."""
    edges = edges_of(field, cand, n_toks)
    fwd = forward(edges, n_toks)
    outof: list[dict[int, list]] = [{} for _ in range(n_toks + 1)]
    for j in range(1, n_toks + 1):
        for i, y, k, s, f in edges[j]:
            outof[i].setdefault(y, []).append((j, k, s))
    bwd: list[dict[int, float]] = [{} for _ in range(n_toks)] + [dict.fromkeys(fwd[n_toks], 0.0)]
    for i in range(n_toks - 1, -1, -1):
        bwd[i] = {y: _lse([bwd[j][k] + s for j, k, s in own]) for y, own in outof[i].items()}
    total = _lse(list(fwd[n_toks].values()))
    # the gold segmentation: its entities that are candidates, all else outside
    starts = {i: (i + n, k) for i, n, k in gold if any(m == n for m, _ in cand[i + n])}
    taken, at, before = set(), 0, OUT
    while at < n_toks:
        end, k = starts.get(at, (at + 1, OUT))
        taken.add((at, end, before, k))
        at, before = end, k
    g: dict[tuple, float] = {}
    for j in range(1, n_toks + 1):
        for i, y, k, s, f in edges[j]:
            d = ((i, j, y, k) in taken) - math.exp(fwd[i][y] + s + bwd[j][k] - total)
            if abs(d) > 1e-12:
                g[y, k] = g.get((y, k), 0.0) + d
                for x in f:
                    g[k, x] = g.get((k, x), 0.0) + d
    return g


def sentences(n: int, seed: int = 5) -> list[tuple[str, list[tuple[int, int, int]]]]:
    """Made sentences with the places (start, end, type) of what is personal in them."""
    r = random.Random(seed)
    digits = lambda k: "".join(r.choice("0123456789") for _ in range(k))
    word = lambda a=2, b=9: "".join(r.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(r.randint(a, b)))
    hexa = lambda k: "".join(r.choice("0123456789abcdef") for _ in range(k))
    upper = lambda k: "".join(r.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789") for _ in range(k))

    def card() -> str:
        body = r.choice("3456") + digits(14)
        body += next(c for c in "0123456789" if luhn(body + c))
        sep = r.choice(["", "", "", " ", "-"])
        return sep.join(body[i : i + 4] for i in range(0, 16, 4))

    def number() -> str:
        while True:
            x = digits(r.choice([1, 2, 3, 4, 5, 6, 8, 12, 13, 16, 18]))
            if len(x) < 13 or not luhn(x):
                return x

    octet = lambda: str(r.randint(0, 255))

    def ip6() -> str:
        groups = [hexa(r.randint(1, 4)) for _ in range(8)]
        if r.random() < 0.4:
            return ":".join(groups)
        i = r.randint(1, 4)
        return ":".join(groups[:i]) + "::" + ":".join(groups[i : i + r.randint(0, 3)])

    personal = [
        (0, lambda: f"{word()}{r.choice(['', '.', '_', '-', '+'])}{word(1, 5)}{r.choice(['', '.' + digits(2), digits(2)])}@{word()}{r.choice(['', digits(1)])}.{r.choice(['', word() + '.'])}{r.choice(['com', 'org', 'net', 'de', 'fr', 'co.uk'])}"),
        (1, lambda: r.choice([f"+1 ({digits(3)}) {digits(3)}-{digits(4)}", f"+{digits(2)} {digits(3)} {digits(3)} {digits(4)}", f"({digits(3)}) {digits(3)}-{digits(4)}", f"{digits(3)}-{digits(3)}-{digits(4)}", f"+{digits(2)}-{digits(2)}-{digits(4)}-{digits(4)}"])),
        (2, card),
        (3, lambda: ".".join(octet() for _ in range(4)) if r.random() < 0.7 else ip6()),
        (4, lambda: r.choice(["AKIA" + upper(16), "sk-" + word(16, 24), "ghp_" + upper(24), hexa(r.randint(18, 40)) + "a1", ".".join(["eyJ" + upper(20), "eyJ" + upper(30), upper(24)])])),
        (5, lambda: f"{digits(3)}-{digits(2)}-{digits(4)}"),
        (6, lambda: f"{r.choice(['DE', 'FR', 'ES', 'GB'])}{digits(2)} {digits(4)} {digits(4)} {digits(4)} {digits(4)} {digits(2)}"),
    ]
    plain = [
        number, lambda: f"{digits(4)}-{digits(2)}-{digits(2)}", lambda: f"{digits(2)}.{digits(2)}.{digits(4)}", lambda: f"v{digits(1)}.{digits(1)}.{digits(2)}", lambda: f"{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}.{digits(1)}",
        lambda: f"${digits(3)},{digits(3)}.{digits(2)}", lambda: f"x = {digits(2)}", lambda: f"{word()}={word()}", lambda: f"@{word()}", lambda: f"{digits(2)}:{digits(2)}", lambda: f"{digits(2)}:{digits(2)}:{digits(2)}", lambda: f"{word()}::{word()}", lambda: f"{r.choice('abcdef')}::{r.choice('abcdef')}()", lambda: f"{digits(3)}-{digits(4)}", lambda: f"{word()}{digits(3)}", lambda: f"{digits(3)}.{digits(3)}.{r.randint(300, 999)}.{digits(2)}",
        lambda: f"{digits(1)}.{digits(1)}.", lambda: f"{word()}@", lambda: f"a={digits(2)}",
    ]
    out = []
    for _ in range(n):
        text, gold = " ".join(word() for _ in range(r.randint(0, 3))), []
        for _ in range(r.randint(1, 3)):
            text += " " if text else ""
            if r.random() < 0.55:
                kind, make = r.choice(personal)
                if kind == 4 and r.random() < 0.6:
                    lead = r.choice(["password=", 'token = "', "secret: ", "api_key="])
                    text += lead
                    x = r.choice([hexa(18), hexa(40), word(8, 14) + digits(2)])
                    gold.append((len(text), len(text) + len(x), 4))
                    text += x + ('"' if lead.endswith('"') else "")
                else:
                    x = make()
                    gold.append((len(text), len(text) + len(x), kind))
                    text += x
            else:
                text += r.choice(plain)()
            text += r.choice(["", "", ".", ","]) + " " + " ".join(word() for _ in range(r.randint(1, 3)))
        out.append((text, gold))
    return out


@lru_cache(maxsize=2)
def train(n: int = 500, epochs: int = 6, rate: float = 0.3, l2: float = 0.002, seed: int = 5) -> Field:
    """Stochastic gradient ascent on the log likelihood, AdaGrad steps; the same field each time."""
    cases = []
    for text, gold in sentences(n, seed):
        for a, b in islands(text):
            toks = tokens(text, a, b)
            starts, ends = {s: i for i, (s, _) in enumerate(toks)}, {e: i for i, (_, e) in enumerate(toks)}
            own = {(starts[s], ends[e] - starts[s] + 1, k) for s, e, k in gold if s in starts and e in ends}
            cases.append((segments(text, toks), len(toks), own))
    weights: dict[tuple, float] = {(k, "any"): -2.0 for k in range(len(TYPES))}
    seen: dict[tuple, float] = {}
    order = random.Random(seed)
    for _ in range(epochs):
        order.shuffle(cases)
        for cand, m, own in cases:
            if not any(cand):
                continue
            for key, g in gradient(Field(weights), cand, m, own).items():
                g -= l2 * weights.get(key, 0.0)
                seen[key] = seen.get(key, 1e-6) + g * g
                weights[key] = weights.get(key, 0.0) + rate * g / math.sqrt(seen[key])
    return Field(weights)


def entities(field: Field, text: str | None) -> list[tuple[str, int, int]]:
    """(type, start, length) of each entity of the text."""
    out = []
    for a, b in islands(text) if text else ():
        toks = tokens(text, a, b)
        for i, n, k in decode(field, text, toks):
            out.append((TYPES[k], toks[i][0], toks[i + n - 1][1] - toks[i][0]))
    return out


def redact(field: Field, text: str | None) -> str | None:
    """The text with each entity replaced by its type in brackets."""
    if not text:
        return text
    parts, at = [], 0
    for kind, start, length in entities(field, text):
        parts += [text[at:start], f"[{kind}]"]
        at = start + length
    return "".join([*parts, text[at:]])


def find_pii(docs: DataFrame, field: Field | None = None) -> DataFrame:
    """(doc_id, type, start, length) of every entity of every row of docs(doc_id, text)."""
    field = field or train()

    def each(b: pa.RecordBatch) -> pa.RecordBatch:
        found = [entities(field, t) for t in b.column("text").to_pylist()]
        row = np.repeat(np.arange(b.num_rows), [len(x) for x in found])
        flat = [e for x in found for e in x]
        return pa.RecordBatch.from_arrays([b.column("doc_id").cast(pa.int64()).take(pa.array(row)), pa.array([e[0] for e in flat], pa.string()), pa.array([e[1] for e in flat], pa.int64()), pa.array([e[2] for e in flat], pa.int64())], ["doc_id", "type", "start", "length"])

    return arrow_map(docs.select("doc_id", "text"), each, "doc_id long, type string, start long, length long")
