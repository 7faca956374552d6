"""Operator 6: secret scan, by patterns and a character convolutional network.

Patterns give the base findings. Every other string that could be a secret (a
long unbroken run with a digit) is a candidate, and a small convolutional
network reads it together with the text around it. The network is trained on
the corpus's own labelled findings: base findings are positive, candidates
outside them negative. Positives are also read without their surroundings, with
those of negatives and as a part of negatives, so that the network learns the
string and not the keyword before it, and finds it in a longer run. The corpus's secrets without a keyword are among the negatives, so
a first network only sorts them out: negatives that networks of other folds
score like a held-out positive are not shown to the network that is kept.
Scores are calibrated on findings kept out of training (Platt). The threshold
is ``least`` in probability or what lets next to no held-out negative pass,
whichever is more, lowered as far as it must be to recall ``recall`` of the
held-out positives in each of these forms.

Training reads every distinct labelled finding. They are dealt to parts of about
``PART`` findings a class; of a rarer class a part gets one that others get too.
In each round every part, a task of its own, goes through its findings once
(Adam) from the same parameters, and the mean of what the parts end with starts
the next round. Thresholds and calibration are set from counts of the scores of
all held-out findings, in steps of 1 / ``STEPS``. Only parameters and these
counts reach the driver. Scanning covers every candidate of every whole text.
Texts are read where they lie, nothing but findings is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenantscope.session import shared_path

from .blobs import text_buffer, tidied, with_text_columns
from .words import doc_slices

KINDS = ("assign", "access", "hex", "cnn")
#: The base patterns of the registered query.
ASSIGN = re.compile(r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.A)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]+")
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 6, 20, 24
_HINTS = (b"passw", b"secret", b"token", b"api")
#: Shortest candidate run, and how many of its characters must be digits.
RUN_LEAST, DIGITS_LEAST = 16, 2

#: Labelled findings of each class that one task trains on in a round, about.
PART = 3000
#: Characters read of a candidate and of each side of it. A longer candidate is
#: read in pieces of BODY characters that start STEP apart.
BODY, SIDE, STEP = 48, 16, 24
#: Pieces that are laid out for the network at a time.
PIECES = 1 << 14
WIDTH = BODY + 2 * SIDE
#: Share of held-out positives that the threshold must find; where that leaves
#: a choice, least probability of a finding and share of held-out negatives
#: that may pass.
RECALL, LEAST, FALSE_ALARMS = 0.95, 0.9, 0.001

_run = np.zeros(256, bool)
_run[list(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")] = True
_digit = np.zeros(256, bool)
_digit[list(b"0123456789")] = True
_hexes = np.zeros(256, bool)
_hexes[list(b"0123456789abcdef")] = True


def _runs(inside: np.ndarray, bound: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal runs of ``inside`` of at least ``least`` bytes; ``bound`` marks
    the first byte of each document."""
    prev = np.append(False, inside[:-1])[:len(inside)] & ~bound
    start = np.flatnonzero(inside & ~prev)
    nxt = np.append(inside[1:] & ~bound[1:], False)[:len(inside)]
    end = np.flatnonzero(inside & ~nxt) + 1
    long = end - start >= least
    return start[long], end[long]


def base_spans(text: str) -> list[tuple[int, int, int, int]]:
    """(start, kind, end, start of the secret itself) of the base findings in
    one text, sorted."""
    out = [(m.start(), 0, m.end(), m.start(2)) for m in ASSIGN.finditer(text) if m.end(2) - m.start(2) >= ASSIGN_LEAST]
    out += [(m.start(), 1, m.end(), m.start()) for m in ACCESS.finditer(text) if m.end() - m.start() >= ACCESS_LEAST]
    out += [(m.start(), 2, m.end(), m.start()) for m in HEX.finditer(text) if m.end() - m.start() >= HEX_LEAST]
    return sorted(out)


class Scan(NamedTuple):
    """Findings of a batch: base spans by document (code points) and strings
    (document, start, end in bytes of the batch): the secrets of the base
    findings (``known``) and the candidates, in pieces of at most BODY bytes;
    of the candidates those pieces that no base finding overlaps."""
    base: dict[int, list[tuple[int, int, int]]]
    doc: np.ndarray
    start: np.ndarray
    end: np.ndarray
    known: np.ndarray

    def part(self, rows) -> Scan:
        return Scan(self.base, *(x[rows] for x in self[1:]))


def _pieces(doc: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Strings of more than BODY bytes as pieces of BODY bytes that start STEP
    apart, the last one at the end; every byte is in one."""
    n = np.maximum(0, -((BODY + start - end) // STEP)) + 1
    row = np.repeat(np.arange(len(start)), n)
    at = start[row] + STEP * (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n))
    at = np.minimum(at, np.maximum(start, end - BODY)[row])
    return [doc[row], at, np.minimum(end[row], at + BODY)]


def scan(offsets: np.ndarray, data: np.ndarray) -> Scan:
    n = len(offsets) - 1
    bound = np.zeros(len(data) + 1, bool)
    bound[offsets] = True
    bound = bound[:-1]
    raw = data.tobytes()
    # A document is read by the patterns only if something in it can match.
    docs: set[int] = set()
    low = raw.lower()
    for text, hint in [(low, h) for h in _HINTS] + [(raw, b"AKIA")]:
        at = text.find(hint)
        while at >= 0:
            d = int(np.searchsorted(offsets, at, "right")) - 1
            docs.add(d)
            at = text.find(hint, int(offsets[d + 1]))
    hex_start, _ = _runs(_hexes[data], bound, HEX_LEAST)
    docs.update(np.unique(np.searchsorted(offsets, hex_start, "right") - 1).tolist())
    start, end = _runs(_run[data], bound, RUN_LEAST)
    digits = np.append(0, np.cumsum(_digit[data], dtype=np.int32))
    ok = digits[end] - digits[start] >= DIGITS_LEAST
    start, end = start[ok], end[ok]
    doc, start, end = _pieces(np.searchsorted(offsets, start, "right") - 1, start, end)
    base: dict[int, list[tuple[int, int, int]]] = {}
    new = np.ones(len(start), bool)
    first = np.searchsorted(doc, np.arange(n + 1))
    secrets: list[tuple[int, int, int]] = []
    for d in sorted(docs):
        body = raw[offsets[d]:offsets[d + 1]]
        text = body.decode("utf-8")
        spans = base_spans(text)
        if not spans:
            continue
        base[d] = [x[:3] for x in spans]
        place = _byte_places(text, body) + offsets[d]
        own = slice(first[d], first[d + 1])
        # No base finding that starts before a piece ends reaches into it.
        reach = np.append(0, np.maximum.accumulate(place[[x[2] for x in spans]]))
        new[own] = reach[np.searchsorted(place[[x[0] for x in spans]], end[own])] <= start[own]
        secrets += [(d, int(place[inner]), int(place[e])) for _, _, e, inner in spans]
    known = np.array(_pieces(*np.array(secrets, np.int64).reshape(-1, 3).T))
    doc, start, end = (np.concatenate([a, b[new]]) for a, b in zip(known, (doc, start, end), strict=True))
    return Scan(base, doc, start, end, np.arange(len(doc)) < known.shape[1])


def _byte_places(text: str, body: bytes) -> np.ndarray:
    """Byte offset of each code point, and of the end."""
    if len(text) == len(body):
        return np.arange(len(body) + 1)
    b = np.frombuffer(body, np.uint8)
    return np.append(np.flatnonzero((b & 0xC0) != 0x80), len(body))


def windows(s: Scan, offsets: np.ndarray, data: np.ndarray) -> np.ndarray:
    """The bytes the network reads: SIDE before, a piece of at most BODY bytes,
    SIDE behind; 0 where there is none."""
    body = s.start[:, None] + np.arange(BODY)[None, :]
    body = np.where(body < s.end[:, None], body, -1)
    before = s.start[:, None] - SIDE + np.arange(SIDE)[None, :]
    before = np.where(before >= offsets[s.doc][:, None], before, -1)
    behind = s.end[:, None] + np.arange(SIDE)[None, :]
    behind = np.where(behind < offsets[s.doc + 1][:, None], behind, -1)
    place = np.concatenate([before, body, behind], axis=1)
    return np.append(data, np.uint8(0))[place]  # place -1: the appended 0


# --- the network -----------------------------------------------------------

#: Byte -> symbol: 0 none, letters in both cases, digits, and signs one by one;
#: other ASCII and non-ASCII bytes share a symbol each.
_SYMBOL = np.full(256, 1, np.int64)
_SYMBOL[128:] = 2
_SYMBOL[0] = 0
for _i, _c in enumerate(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789 +/_=-.:\"',;()[]{}<>@#$%&*|\n"):
    _SYMBOL[_c] = 3 + _i
N_SYMBOLS = int(_SYMBOL.max()) + 1
EMBED, KERNEL, FILTERS = 12, 5, 32


class Network(NamedTuple):
    embed: np.ndarray
    conv: np.ndarray
    conv_bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray
    #: Platt calibration (slope, offset) and the threshold in probability.
    slope: float = 1.0
    offset: float = 0.0
    threshold: float = 0.5


def _forward(p, x: np.ndarray):
    """Logits and what the gradient needs. Pools the body and each side apart."""
    e = p[0][x]                                                     # n, W, E
    cols = np.lib.stride_tricks.sliding_window_view(e, KERNEL, axis=1)  # n, W-K+1, E, K
    cols = cols.reshape(len(x), WIDTH - KERNEL + 1, EMBED * KERNEL)
    h = cols @ p[1] + p[2]
    np.maximum(h, 0, out=h)
    cut = (SIDE, SIDE + BODY)
    tops = [h[:, :cut[0]].argmax(1), h[:, cut[0]:cut[1] - KERNEL + 1].argmax(1) + cut[0], h[:, cut[1] - KERNEL + 1:].argmax(1) + cut[1] - KERNEL + 1]
    pooled = [np.take_along_axis(h, t[:, None, :], 1)[:, 0] for t in tops] + [h[:, cut[0]:cut[1]].mean(1)]
    f = np.concatenate(pooled, axis=1)
    return f @ p[3] + p[4], (cols, h, tops, f, cut)


def logits(net: Network, x: np.ndarray, batch: int = 512) -> np.ndarray:
    out = [_forward(net[:5], _SYMBOL[x[i:i + batch]])[0] for i in range(0, len(x), batch)]
    return np.concatenate(out) if out else np.zeros(0)


def probability(net: Network, x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(net.slope * logits(net, x).astype(float) + net.offset, -60, 60)))


#: Folds of the negatives for sorting out secrets among them.
FOLDS = 3


def _alone(x: np.ndarray) -> np.ndarray:
    """Windows without what surrounds the string."""
    x = x.copy()
    x[:, :SIDE] = x[:, SIDE + BODY:] = 0
    return x


def _forms(x: np.ndarray, other: np.ndarray, rng: np.random.Generator) -> list[np.ndarray]:
    """Windows as they are, without what surrounds the string, with what
    surrounds one of ``other``, and with the string as a part of one of
    ``other``, between two signs."""
    there = other[rng.integers(len(other), size=len(x))].copy()
    inside, text = there.copy(), there[:, SIDE:SIDE + BODY].copy()
    body = there[:, SIDE:SIDE + BODY] = x[:, SIDE:SIDE + BODY]
    size = (body != 0).sum(1)[:, None]
    at = rng.integers(np.minimum((text != 0).sum(1)[:, None], BODY - size) + 1)
    j, row = np.arange(BODY)[None, :], np.arange(len(x))[:, None]
    own = (j >= at) & (j < at + size)
    whole = np.where(own, body[row, np.clip(j - at, 0, BODY - 1)], text[row, np.where(j < at, j, np.clip(j - size, 0, BODY - 1))])
    sign = np.frombuffer(b"/-_+", np.uint8)[rng.integers(4, size=(len(x), 1))]
    inside[:, SIDE:SIDE + BODY] = np.where(((j == at - 1) | (j == at + size)) & (whole != 0), sign, whole)
    return [x, _alone(x), there, inside]


class Part(NamedTuple):
    """Findings that one task trains on: windows, numbers (they say what is
    kept out) and whether this part is the first that a finding is dealt to."""
    number: int
    positive: np.ndarray
    positive_n: np.ndarray
    positive_own: np.ndarray
    negative: np.ndarray
    negative_n: np.ndarray
    negative_own: np.ndarray


#: One of HELD positives, and of the negatives of the last network, is kept out.
HELD = 4
#: Scores are counted in steps of 1 / STEPS of a logit, up to TOP either way.
STEPS, TOP = 256, 30
_SHAPES = ((N_SYMBOLS, EMBED), (EMBED * KERNEL, FILTERS), (FILTERS,), (4 * FILTERS,), ())
_CUTS = np.cumsum([0, *(int(np.prod(x)) for x in _SHAPES)])


def _parameters(flat: np.ndarray) -> list[np.ndarray]:
    return [flat[i:j].reshape(x) for i, j, x in zip(_CUTS[:-1], _CUTS[1:], _SHAPES, strict=True)]


def _network(state: np.ndarray) -> Network:
    return Network(*_parameters(state[:_CUTS[-1]].astype(np.float32)))


def _start(rng: np.random.Generator) -> np.ndarray:
    """Parameters, Adam's two moments and its number of steps, in one row."""
    f = lambda s, scale: (rng.standard_normal(s) * scale).ravel()
    p = [f(_SHAPES[0], 0.3), f(_SHAPES[1], (2 / (EMBED * KERNEL)) ** 0.5), np.zeros(FILTERS), f(_SHAPES[3], (1 / (4 * FILTERS)) ** 0.5)]
    return np.append(np.concatenate(p), np.zeros(2 + 2 * _CUTS[-1]))


def _round(part: Part, states: Sequence[np.ndarray], share: int, seed: tuple[int, ...], batch: int) -> list[np.ndarray]:
    """The states after one round over ``part``; network k does not read every
    ``share``-th negative from the k-th on."""
    positive = part.positive[part.positive_n % HELD != 0]
    out = []
    for k, state in enumerate(states):
        form, order = (np.random.default_rng((*x, k, part.number)) for x in (seed[:-1], seed))  # the last: the round
        out.append(_adam(state, positive, part.negative[part.negative_n % share != k], form, order, batch))
    return out


def _scores(part: Part, nets: Sequence[Network], share: int, seed: int) -> Counter:
    """How many findings kept out have a score: (network, form, step) -> n. The
    last form is the negatives."""
    held = part.positive[(part.positive_n % HELD == 0) & part.positive_own]
    held = _forms(held, part.negative, np.random.default_rng((seed, part.number)))
    out: Counter = Counter()
    for k, net in enumerate(nets):
        for form, x in enumerate([*held, part.negative[(part.negative_n % share == k) & part.negative_own]]):
            step, n = np.unique(np.floor(np.clip(logits(net, x), -TOP, TOP) * STEPS).astype(int), return_counts=True)
            out.update({(k, form, i): c for i, c in zip(step.tolist(), n.tolist(), strict=True)})
    return out


def _stays(part: Part, nets: Sequence[Network], reach: Sequence[float]) -> np.ndarray:
    """Negatives that do not score like a positive where they were kept out."""
    fold, stays = part.negative_n % len(nets), np.ones(len(part.negative), bool)
    for k, net in enumerate(nets):
        stays[fold == k] = logits(net, part.negative[fold == k]) < reach[k]
    return stays


class Here:
    """Findings in memory, in one part."""

    def __init__(self, positive: np.ndarray, negative: np.ndarray):
        n = lambda x: (np.arange(len(x)), np.ones(len(x), bool))
        self.part = Part(0, positive, *n(positive), negative, *n(negative))

    def round(self, states, *how) -> list[np.ndarray]:
        return _round(self.part, states, *how)

    def scores(self, *how) -> Counter:
        return _scores(self.part, *how)

    def sorted_out(self, nets, reach) -> Here:
        stays = _stays(self.part, nets, reach)
        return Here(self.part.positive, self.part.negative[stays]) if stays.sum() >= 8 else self

    def close(self) -> None:
        pass


def _counted(scores: Counter, net: int, form: int) -> tuple[np.ndarray, np.ndarray]:
    found = sorted((i, n) for (k, f, i), n in scores.items() if (k, f) == (net, form))
    return tuple(np.array(found, np.int64).reshape(-1, 2).T)


def _reach(scores: Counter, net: int, recall: float) -> float:
    """The highest logit that finds ``recall`` of the positives kept out, in each form."""
    points = []
    for form in range(4):
        step, n = _counted(scores, net, form)
        points.append(step[np.searchsorted(np.cumsum(n), int(np.floor((1 - recall) * n.sum())), "right")])
    return float(min(points)) / STEPS


def _learn(findings: Here | Spread, *, recall: float = RECALL, least: float = LEAST, epochs: int = 8, batch: int = 64, seed: int = 3) -> Network:
    """Sort out the negatives with networks of FOLDS folds, train the network
    that is kept, calibrate it and set its threshold."""
    rng = np.random.default_rng(seed)

    def trained(count: int, share: int) -> list[Network]:
        states = [_start(rng) for _ in range(count)]
        for i in range(epochs):
            states = findings.round(states, share, (seed, count, i), batch)
        return [_network(s) for s in states]

    try:
        nets = trained(FOLDS, FOLDS)
        scores = findings.scores(nets, FOLDS, seed)
        findings = findings.sorted_out(nets, [_reach(scores, k, recall) for k in range(FOLDS)])
        net, = trained(1, HELD)
        scores = findings.scores([net], HELD, seed)
    finally:
        findings.close()
    of = [_counted(scores, 0, form) for form in range(5)]
    step, n = (np.concatenate(x) for x in zip(*of, strict=True))
    z, y = (step + 0.5) / STEPS, np.repeat([1.0, 0.0], [sum(len(x) for x, _ in of[:4]), len(of[4][0])])
    slope, offset = _platt(z, y, n)
    slope = max(slope, 1e-3)  # classes alike: still more with a higher logit
    chance = lambda at: float(1 / (1 + np.exp(-np.clip(slope * at + offset, -60, 60))))
    step, n = of[4]
    clean = chance((step[np.searchsorted(np.cumsum(n), int(np.ceil((1 - FALSE_ALARMS) * (n.sum() - 1))), "right")] + 1) / STEPS)
    return net._replace(slope=slope, offset=offset, threshold=min(chance(_reach(scores, 0, recall)), max(least, clean)))


def train(positive: np.ndarray, negative: np.ndarray, *, seed: int = 3, **how) -> Network | None:
    """Fit the network on windows of both classes that are in memory; null when
    a class is too small to keep some out (fewer than 8)."""
    if len(positive) < 8 or len(negative) < 8:
        return None
    rng = np.random.default_rng(seed)
    return _learn(Here(positive[rng.permutation(len(positive))], negative[rng.permutation(len(negative))]), seed=seed, **how)


def _adam(state: np.ndarray, positive: np.ndarray, negative: np.ndarray, form: np.random.Generator,
          rng: np.random.Generator, batch: int) -> np.ndarray:
    """The state after one round of Adam over both classes, negatives with and
    without their surroundings."""
    x = _SYMBOL[np.concatenate([*_forms(positive, negative, form), negative, _alone(negative)])]
    y = np.repeat([1.0, 0.0], [4 * len(positive), 2 * len(negative)]).astype(np.float32)
    w = np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())).astype(np.float32)
    p, m, v = (_parameters(q) for q in state[:-1].astype(np.float32).reshape(3, -1))
    step = float(state[-1])
    order = rng.permutation(len(x))
    for i in range(0, len(order), batch):
        k = order[i:i + batch]
        z, (cols, h, tops, f, cut) = _forward(p, x[k])
        dz = ((1 / (1 + np.exp(-z)) - y[k]) * w[k] / len(k)).astype(np.float32)
        df = dz[:, None] * p[3]
        dh = np.zeros_like(h)
        for j, t in enumerate(tops):
            g = np.take_along_axis(dh, t[:, None, :], 1)[:, 0] + df[:, j * FILTERS:(j + 1) * FILTERS]
            np.put_along_axis(dh, t[:, None, :], g[:, None, :], 1)
        dh[:, cut[0]:cut[1]] += df[:, None, 3 * FILTERS:] / (cut[1] - cut[0])
        dh *= h > 0
        flat = dh.reshape(-1, FILTERS)
        dcols = (flat @ p[1].T).reshape(len(k), -1, EMBED, KERNEL)
        de = np.zeros((len(k), WIDTH, EMBED), np.float32)
        for j in range(KERNEL):
            de[:, j:j + dcols.shape[1]] += dcols[..., j]
        demb = np.zeros_like(p[0])
        np.add.at(demb, x[k].ravel(), de.reshape(-1, EMBED))
        grads = [demb, cols.reshape(-1, EMBED * KERNEL).T @ flat, flat.sum(0), f.T @ dz, dz.sum()]
        step += 1
        for q, (g, mm, vv) in enumerate(zip(grads, m, v, strict=True)):
            mm[...] = 0.9 * mm + 0.1 * g
            vv[...] = 0.999 * vv + 0.001 * g * g
            p[q] = p[q] - 0.003 * (mm / (1 - 0.9 ** step)) / (np.sqrt(vv / (1 - 0.999 ** step)) + 1e-8)
    return np.append(np.concatenate([q.ravel() for q in (*p, *m, *v)]).astype(float), step)


def _platt(z: np.ndarray, y: np.ndarray, n: np.ndarray) -> tuple[float, float]:
    """Slope and offset of the logistic fit of labels to logits, each counted
    ``n`` times (Newton steps, with the usual smoothed targets)."""
    n1, n0 = n[y > 0].sum(), n[y == 0].sum()
    t = np.where(y > 0, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        q = 1 / (1 + np.exp(-np.clip(a * z + b, -60, 60)))
        w = n * np.maximum(q * (1 - q), 1e-9)
        g = np.array([(n * (q - t) * z).sum(), (n * (q - t)).sum()])
        h = np.array([[(w * z * z).sum() + 1e-3, (w * z).sum()], [(w * z).sum(), w.sum() + 1e-3]])
        d = np.linalg.solve(h, g)
        a, b = a - d[0], b - d[1]
        if np.abs(d).max() < 1e-8:
            break
    return float(a), float(b)


# --- Spark -----------------------------------------------------------------

def labelled(docs: DataFrame) -> DataFrame:
    """Every candidate of the corpus: ``seen binary`` (what the network reads)
    and ``positive boolean``."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            offsets, data = text_buffer(b.column(0))
            for lo, hi in doc_slices(offsets):
                off, part = offsets[lo:hi + 1] - offsets[lo], data[offsets[lo]:offsets[hi]]
                found = scan(off, part)
                for i in range(0, len(found.doc), PIECES):
                    s = found.part(slice(i, i + PIECES))
                    x = windows(s, off, part)
                    yield pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary()), pa.array(s.known)],
                                          names=["seen", "positive"])
    return docs.select("text").where("text is not null").mapInArrow(tidied(run), "seen binary, positive boolean")


class Spread:
    """Findings (``seen``, ``positive``) dealt to parts, one a task. A class is
    numbered within groups of about ``size`` findings, in the order of their
    hashes, so any order of the rows gives the same parts. There are as many
    parts as the larger class has groups; part p reads of each class group p
    modulo their number."""

    def __init__(self, rows: DataFrame, count: dict[bool, int], size: int):
        self.size, self.found, self.count = size, rows, count
        groups = {c: -(-n // size) for c, n in count.items()}
        self.parts = max(groups.values())
        of = F.when(F.col("positive"), groups[True]).otherwise(groups[False]).cast("long")
        number = F.row_number().over(Window.partitionBy("positive", "group").orderBy("hash", "seen"))
        self.rows = (rows.withColumn("hash", F.xxhash64("seen")).withColumn("group", F.pmod("hash", of))
                     .withColumn("n", (number - 1).cast("long"))
                     .select("seen", "positive", "n", "group", F.explode(F.sequence("group", F.lit(self.parts - 1).cast("long"), of)).alias("part"))
                     .select("part", "positive", "n", "seen", (F.col("part") == F.col("group")).alias("own"))
                     .repartitionById(self.parts, F.col("part").cast("int")).sortWithinPartitions("positive", "n")
                     .persist(StorageLevel.DISK_ONLY))

    def _over(self, work, schema: str) -> DataFrame:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            of_part = [b for b in batches if b.num_rows]
            if of_part:
                yield work(_part(pa.Table.from_batches(of_part)))

        return self.rows.mapInArrow(tidied(run), schema)

    def round(self, states, *how) -> list[np.ndarray]:
        """The mean of the parts' states; sums in the order of the parts, some of
        them at a time."""
        def work(part: Part) -> pa.RecordBatch:
            new = _round(part, states, *how)
            return pa.record_batch([pa.array([part.number] * len(new)), pa.array(range(len(new)), pa.int64()), pa.array([s.tobytes() for s in new], pa.binary())],
                                   names=["part", "net", "state"])

        def added(t: pa.Table) -> pa.Table:
            t = t.sort_by("part")
            state = sum(np.frombuffer(s) for s in t["state"].to_pylist())
            return pa.table({"part": t["part"][:1], "net": t["net"][:1], "state": pa.array([state.tobytes()], pa.binary())})

        kind = "part long, net long, state binary"
        some = -(-self.parts // int(np.ceil(self.parts ** 0.5)))
        sums = self._over(work, kind).groupBy("net", F.floor(F.col("part") / some)).applyInArrow(added, kind).collect()
        sums.sort(key=lambda r: r["part"])
        return [sum(np.frombuffer(bytes(r["state"])) for r in sums if r["net"] == k) / self.parts for k in range(len(states))]

    def scores(self, *how) -> Counter:
        def work(part: Part) -> pa.RecordBatch:
            found = _scores(part, *how)
            cols = np.array([(*key, n) for key, n in found.items()], np.int64).reshape(-1, 4).T
            return pa.record_batch([pa.array(c) for c in cols], names=["net", "form", "step", "n"])

        total = self._over(work, "net long, form long, step long, n long").groupBy("net", "form", "step").agg(F.sum("n").alias("n")).toArrow()
        cols = [total[c].to_pylist() for c in ("net", "form", "step", "n")]
        return Counter(dict(zip(zip(*cols[:3], strict=True), cols[3], strict=True)))

    def sorted_out(self, nets, reach) -> Spread:
        def work(part: Part) -> pa.RecordBatch:
            x = part.negative[_stays(part, nets, reach) & part.negative_own]
            return pa.record_batch([pa.array([r.tobytes() for r in x], pa.binary())], names=["seen"])

        path = shared_path(self.rows.sparkSession, "negatives")
        self._over(work, "seen binary").write.parquet(path)
        stay = self.rows.sparkSession.read.parquet(path)
        n = stay.count()
        if n < 8:
            return self
        self.close()
        rows = self.found.where("positive").select("seen", "positive").unionByName(stay.withColumn("positive", F.lit(False)))
        return Spread(rows, {True: self.count[True], False: n}, self.size)

    def close(self) -> None:
        self.rows.unpersist()


def _part(t: pa.Table) -> Part:
    t = t.sort_by([("positive", "ascending"), ("n", "ascending")])
    positive, n, own = (t[c].to_numpy() for c in ("positive", "n", "own"))
    seen = np.frombuffer(b"".join(t["seen"].to_pylist()), np.uint8).reshape(-1, WIDTH)
    return Part(t["part"][0].as_py(), *(x[rows] for rows in (positive, ~positive) for x in (seen, n, own)))


def fit(docs: DataFrame, part: int = PART, **how) -> Network | None:
    """Train on every distinct labelled finding, about ``part`` of each class in
    a task; null when a class has fewer than 8."""
    path = shared_path(docs.sparkSession, "findings")
    labelled(docs).distinct().write.parquet(path)
    rows = docs.sparkSession.read.parquet(path)
    count = {r["positive"]: r["n"] for r in rows.groupBy("positive").agg(F.count("*").alias("n")).collect()}
    if min(count.get(c, 0) for c in (True, False)) < 8:
        return None
    return _learn(Spread(rows, count, part), **how)


def find_secrets(docs: DataFrame, net: Network | None, *, text: str = "text", keep_text: bool = True) -> DataFrame:
    """Adds ``secrets array<struct<kind: string, start: long, end: long>>`` to
    ``docs`` (replacing a column of that name): spans in code points, end
    exclusive, by start, then kind as in ``KINDS``. Base findings always stay;
    without a network they are all. Null and empty texts have none."""
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(offsets: np.ndarray, data: np.ndarray) -> list[pa.Array]:
        s = scan(offsets, data)
        spans = {d: list(x) for d, x in s.base.items()}
        new = s.part(~s.known)
        places: list[list[int]] = []  # document, start, end; pieces that meet are one
        for i in range(0, len(new.doc) if net is not None else 0, PIECES):
            s = new.part(slice(i, i + PIECES))
            for k in np.flatnonzero(probability(net, windows(s, offsets, data)) >= net.threshold).tolist():
                d, start, end = int(s.doc[k]), int(s.start[k]), int(s.end[k])
                if places and places[-1][0] == d and start <= places[-1][2]:
                    places[-1][2] = end
                else:
                    places.append([d, start, end])
        before, at, of = 0, 0, -1  # code points of document ``of`` up to byte ``before``
        for d, start, end in places:
            if d != of:
                before, at, of = int(offsets[d]), 0, d
            at += int(((data[before:start] & 0xC0) != 0x80).sum())
            before = start
            spans.setdefault(d, []).append((at, 3, at + end - start))
        return [pa.array([[{"kind": KINDS[x], "start": a, "end": e} for a, x, e in sorted(spans.get(d, ()))]
                          for d in range(len(offsets) - 1)], kind)]

    return with_text_columns(docs, text, "secrets array<struct<kind: string, start: long, end: long>>", find, doc_slices, keep_text)


def redact(text, secrets, mask: str = "[SECRET]"):
    """The text without its secrets: overlapping spans become one ``mask``
    (Column function)."""
    acc = "struct<at: long, parts: array<string>>"
    done = F.aggregate(
        secrets, F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<string>").alias("parts")).cast(acc),
        lambda a, s: F.when(s["start"] < a["at"], F.struct(F.greatest(a["at"], s["end"]).alias("at"), a["parts"].alias("parts")))
        .otherwise(F.struct(s["end"].alias("at"), F.concat(
            a["parts"], F.array(F.substring(text, a["at"].cast("int") + 1, (s["start"] - a["at"]).cast("int")), F.lit(mask))).alias("parts"))))
    return F.when(F.size(secrets) == 0, text).otherwise(
        F.concat(F.array_join(done["parts"], ""), F.substring(text, done["at"].cast("int") + 1, F.length(text))))


def joined(secrets):
    """``kind:start:end``, comma-joined."""
    return F.array_join(F.transform(secrets, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def op6_secret_scan(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256,
    spans, and n_cnn, the number of spans that the network adds."""
    net = fit(docs)
    found = find_secrets(docs.select("doc_id", "text"), net, keep_text=False)
    base = F.filter("secrets", lambda s: s["kind"] != "cnn")
    n = lambda k: F.size(F.filter("secrets", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *(n(k) for k in KINDS if k != "cnn"), F.sha2(joined(base), 256).alias("base_sha256"),
                        joined(F.col("secrets")).alias("spans"), n("cnn"))
