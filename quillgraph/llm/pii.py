"""Personal data by a skip-chain conditional random field.

Nodes of the field are the tokens that hold a digit or an ``@``. Every other
token is O by a hard potential; such a token separates the chain, so leaving
it out changes no marginal, and what it says enters as a feature of its
neighbours. Adjacent nodes share a transition potential. Each node is also
linked with the first one of its document that it repeats (equal letters and
digits), so that any clear mention is two links from all others however many
there are, and with the last one that is similar (equal shape), wherever they
are; these skip edges have potentials of their own, so that one clear mention
decides the doubtful ones. Marginals come from loopy sum-product message
passing over all documents of a slice at once, until no message changes by
more than ``TOLERANCE`` or ``ROUNDS`` are over; the same passing gives the
expected counts of the gradient that the field is trained with. A message is
one product of a matrix of beliefs with the potentials of its kind of edge. A
slice is about ``SLICE_CHARS`` characters, or one document if it is longer.

The training text is ``labelled_documents``, a seeded generator; ``DOCUMENTS``
is the documented bound of that sample. ``fit`` takes any other.

Defined results: null and empty texts have no entity; a null id is kept as
null; repeated rows are reported once each; offsets count code points; ties of
marginals go to the label that comes first in ``LABELS``. Extra columns are
ignored by ``entities``. An empty table gives an empty result.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import kernel

#: Documents of the training sample, steps of the optimiser, most rounds of message passing and the change that ends it, and damping.
DOCUMENTS, STEPS, ROUNDS, TOLERANCE, DAMPING, SEED = 700, 120, 60, 1e-3, 0.3, 11
SLICE_CHARS = 1 << 17

KINDS = ("EMAIL", "PHONE", "CARD", "IP", "ID")
LABELS = ("O", *[f"{b}-{k}" for k in KINDS for b in "BI"])
_L = len(LABELS)
#: Features are hashed into this many rows.
ROWS = 1 << 12

_T = r"\s|,;!#$%&*\"'`<>=\[\]{}?…"
_NODE = re.compile(rf"(?<![^{_T}])[^{_T}0-9@]*+[0-9@][^{_T}]*+")
_KEEP = re.compile(r"[^0-9a-z@]+")
_WORD_BEFORE = re.compile(r"([^\W\d_]+)[\W\d_]{0,4}$")
_EMAIL = re.compile(r"[\w.+-]+@[\w-]+(\.[\w-]+)+")
_IP = re.compile(r"(\d{1,3})\.(\d{1,3})\.(\d{1,3})\.(\d{1,3})")
_GAP = re.compile(r"[^\w]{1,8}")


@dataclass
class Nodes:
    """Nodes of some documents: spans, features (flat, with starts) and edges of three kinds."""

    doc: list[int]
    spans: list[tuple[int, int]]
    feats: list[list[int]]
    edges: list[list[tuple[int, int]]]  # chain, repeat, similar


def _luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def _shape(v: str) -> str:
    return re.sub(r"(.)\1{3,}", r"\1\1\1+", "".join("9" if c.isdigit() else "a" if c.isalpha() else c for c in v))


@lru_cache(maxsize=1 << 16)
def _row(name: str) -> int:
    return zlib.crc32(name.encode("utf-8", "replace")) % ROWS


def _features(text: str, start: int, end: int, before: str | None, after: str | None) -> list[int]:
    v = text[start:end]
    digits = "".join(c for c in v if "0" <= c <= "9")
    core = v.strip(".:-/+()")
    octets = _IP.fullmatch(core)
    names = [
        "bias",
        f"shape={_shape(v)}" if len(v) < 40 else "shape=long",
        f"digits={min(len(digits), 20)}",
        f"email={bool(_EMAIL.fullmatch(core))}",
        f"ip={octets is not None and all(int(o) < 256 for o in octets.groups())}",
        f"card={13 <= len(digits) <= 19 and digits == core} {_luhn(digits) if digits == core and len(digits) < 20 else ''}",
        f"alpha={any(c.isalpha() for c in v)} at={'@' in v} slash={'/' in v}",
        f"first={v[:1] if not v[:1].isalnum() else 'x'}",
        f"before={before is not None}",
        f"after={after is not None}",
    ]
    word = _WORD_BEFORE.search(text, max(0, start - 24), start)
    if word:
        names.append(f"word={word.group(1).lower()}")
    for what, other in (("p", before), ("n", after)):
        if other is not None:
            names.append(f"{what}={_shape(other) if len(other) < 24 else 'long'}")
    return [_row(n) for n in names]


def nodes(texts: list[str | None]) -> Nodes:
    out = Nodes([], [], [], [[], [], []])
    for d, text in enumerate(texts):
        if not text:
            continue
        spans = []
        for m in _NODE.finditer(text):
            s, e = m.span()
            while e > s and text[e - 1] in ".:-/":
                e -= 1
            if e > s:
                spans.append((s, e))
        base = len(out.spans)
        near = [_GAP.fullmatch(text, a[1], b[0]) is not None for a, b in zip(spans, spans[1:])]
        seen: tuple[dict, dict] = ({}, {})
        for i, (s, e) in enumerate(spans):
            v = text[s:e]
            before = text[slice(*spans[i - 1])] if i and near[i - 1] else None
            after = text[slice(*spans[i + 1])] if i + 1 < len(spans) and near[i] else None
            out.feats.append(_features(text, s, e, before, after))
            out.doc.append(d)
            if before is not None:
                out.edges[0].append((base + i - 1, base + i))
            same = _KEEP.sub("", v.lower())
            shape = (_shape(v), before is None, after is None)
            if (first := seen[0].setdefault(same, base + i)) != base + i:
                out.edges[1].append((first, base + i))
            elif shape in seen[1]:
                out.edges[2].append((seen[1][shape], base + i))
            seen[1][shape] = base + i
        out.spans += spans
    return out


@dataclass
class Field:
    """Log potentials: of features (rows x labels), and of the three kinds of edges (labels x labels)."""

    unary: np.ndarray
    pair: np.ndarray

    def potentials(self, feats: list[list[int]]) -> np.ndarray:
        at = np.concatenate(([0], np.cumsum([len(f) for f in feats])[:-1]))
        return np.add.reduceat(self.unary[np.concatenate(feats)], at, axis=0)

    def marginals(self, g: Nodes, rounds: int = ROUNDS, tolerance: float = 1e-7) -> tuple[np.ndarray, list[tuple]]:
        """Marginals of nodes, and for each kind of edge its sources and targets with their beliefs less the edge's own message."""
        theta = self.potentials(g.feats)
        ends = [np.array(e, np.int64).reshape(-1, 2) for e in g.edges]
        a, b = (np.concatenate([e[:, c] for e in ends]) for c in (0, 1))
        kinds = [slice(x, y) for x, y in zip(*(lambda n: (n[:-1], n[1:]))(np.concatenate(([0], np.cumsum([len(e) for e in ends])))))]
        right, left = (np.zeros((len(a), _L), theta.dtype) for _ in range(2))  # log messages a to b, and b to a
        belief = theta
        for _ in range(rounds if len(a) else 0):
            change = 0.0
            at_a, at_b = belief[a] - left, belief[b] - right
            for k, e in enumerate(kinds):
                for old, at, psi in ((right, at_a, self.pair[k]), (left, at_b, self.pair[k].T)):
                    new = _through(at[e], psi.astype(theta.dtype))
                    step = (1 - DAMPING) * (new - old[e])
                    change = max(change, float(np.abs(step).max(initial=0)))
                    old[e] += step
            belief = theta + _sums(b, right, len(theta)) + _sums(a, left, len(theta))
            if change < tolerance:
                break
        at_a, at_b = belief[a] - left, belief[b] - right
        return _softmax(belief), [(a[e], b[e], at_a[e], at_b[e]) for e in kinds]

    def edge_marginals(self, kind: int, at_a: np.ndarray, at_b: np.ndarray) -> np.ndarray:
        joint = self.pair[kind] + at_a[:, :, None] + at_b[:, None, :]
        joint = np.exp(joint - joint.max((1, 2), keepdims=True))
        return joint / joint.sum((1, 2), keepdims=True)


def _through(at: np.ndarray, psi: np.ndarray) -> np.ndarray:
    """Log messages through an edge from the log beliefs at one end, with a greatest value of 0."""
    top = psi.max()
    out = np.log(np.maximum(np.exp(at - at.max(1, keepdims=True)) @ np.exp(psi - top), 1e-30)) if len(at) else at
    return out - out.max(1, keepdims=True) if len(at) else out


def _sums(of: np.ndarray, values: np.ndarray, n: int) -> np.ndarray:
    """Sums of the rows of ``values`` for each of ``n`` nodes."""
    out = np.zeros((n, values.shape[1]), values.dtype)
    if len(of):
        order = np.argsort(of, kind="stable")
        s = of[order]
        at = np.flatnonzero(np.concatenate(([True], s[1:] != s[:-1])))
        out[s[at]] = np.add.reduceat(values[order], at, axis=0)
    return out


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def gold(g: Nodes, entities: list[list[tuple[int, int, str]]]) -> np.ndarray:
    """Label of each node from the entities of each document."""
    out = np.zeros(len(g.spans), int)
    for i, (d, (s, e)) in enumerate(zip(g.doc, g.spans)):
        for a, b, kind in entities[d]:
            if s < b and a < e:
                first = not any(g.doc[j] == d and g.spans[j][1] > a for j in range(max(0, i - 6), i))
                out[i] = LABELS.index(("B-" if first else "I-") + kind)
    return out


def fit(documents: list[tuple[str, list[tuple[int, int, str]]]], steps: int = STEPS, ridge: float = 2e-3) -> Field:
    """Gradient ascent (Adam) on the likelihood, expected counts from loopy message passing."""
    g = nodes([t for t, _ in documents])
    y = gold(g, [e for _, e in documents])
    field = Field(np.zeros((ROWS, _L)), np.zeros((3, _L, _L)))
    row, of = np.concatenate(g.feats), np.repeat(np.arange(len(g.feats)), [len(f) for f in g.feats])
    observed, truth = np.zeros((ROWS, _L)), np.eye(_L)[y]
    np.add.at(observed, row, truth[of])
    m = [np.zeros_like(field.unary), np.zeros_like(field.pair)]
    v = [np.zeros_like(field.unary), np.zeros_like(field.pair)]
    for step in range(1, steps + 1):
        p, ends = field.marginals(g, 4)
        expected = np.zeros((ROWS, _L))
        np.add.at(expected, row, p[of])
        pair = np.zeros((3, _L, _L))
        for k, (a, b, at_a, at_b) in enumerate(ends):
            pair[k] = (truth[a][:, :, None] * truth[b][:, None, :] - field.edge_marginals(k, at_a, at_b)).sum(0)
        for i, (w, grad) in enumerate(((field.unary, observed - expected), (field.pair, pair))):
            grad = grad / len(documents) - ridge * w
            m[i] = 0.9 * m[i] + 0.1 * grad
            v[i] = 0.99 * v[i] + 0.01 * grad * grad
            w += 0.15 * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-8)
    return field


def labelled_documents(n: int = DOCUMENTS, seed: int = SEED) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Invented texts with the spans and kinds of their personal data."""
    rng = random.Random(seed)
    some = lambda k, chars="0123456789": "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice("the er sch ing on que ch st ción ou ai en ly ha".split()) for _ in range(rng.randint(1, 4)))
    site = lambda: rng.choice(["mail", "post", "web", word()]) + some(rng.randint(0, 2)) + rng.choice([".example.com", ".com", ".org", ".co.uk", ".de"])

    def luhn(k: int) -> str:
        body = some(k - 1)
        return next(body + c for c in "0123456789" if _luhn(body + c))

    def private() -> tuple[str, str, str]:
        return rng.choice(
            [
                lambda: ("", f"{word()}.{some(2)}@{site()}", "EMAIL"),
                lambda: (rng.choice(["", "mail ", "email: "]), f"{word()}{rng.choice(['', '_', '.', '-'])}{word()}@{site()}", "EMAIL"),
                lambda: ("", f"+{rng.randint(1, 99)} ({some(3)}) {some(3)}-{some(4)}", "PHONE"),
                lambda: (rng.choice(["", "tel ", "call ", "phone: "]), f"+{rng.randint(1, 99)} {some(3)} {some(rng.randint(3, 4))} {some(4)}", "PHONE"),
                lambda: (rng.choice(["tel ", "call ", "phone: "]), f"({some(3)}) {some(3)}-{some(4)}", "PHONE"),
                lambda: (rng.choice(["", "phone "]), f"{some(3)}-{some(3)}-{some(4)}", "PHONE"),
                lambda: ("", rng.choice([some(16), luhn(16)]), "CARD"),
                lambda: (rng.choice(["", "card "]), rng.choice([" ", "-"]).join(some(4) for _ in range(4)), "CARD"),
                lambda: ("", ".".join(str(rng.randint(0, 255)) for _ in range(4)), "IP"),
                lambda: (rng.choice(["", "ssn "]), f"{some(3)}-{some(2)}-{some(4)}", "ID"),
                lambda: (rng.choice(["", "iban "]), rng.choice(["DE", "FR", "GB", "ES"]) + some(20), "ID"),
            ]
        )()

    def public() -> str:
        return rng.choice(
            [
                lambda: f"{rng.randint(1, 20)}.{rng.randint(0, 20)}",
                lambda: f"version {rng.randint(1, 9)}.{rng.randint(0, 9)}.{rng.randint(0, 99)}",
                lambda: str(rng.randint(0, 99999)),
                lambda: f"{rng.randint(1900, 2030)}",
                lambda: f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}",
                lambda: f"{rng.randint(10, 23)}:{some(2)}:{some(2)}",
                lambda: some(rng.choice([32, 40, 64]), "0123456789abcdef"),
                lambda: "AKIA" + some(16, "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"),
                lambda: f"{rng.choice(['order', 'isbn', 'build'])} {some(rng.choice([6, 8, 10, 13]))}",
                lambda: f"https://{site()}/{word()}/{some(4)}",
                lambda: f"/{word()}/{word()}{some(2)}.txt",
                lambda: f"@{word()}",
                lambda: f"{some(1)}/{some(1)}",
                lambda: f"{some(2)} {some(2)} {some(3)}",
                lambda: f"{rng.randint(1, 100)}.{some(2)} %",
                lambda: "-".join(some(k, "0123456789abcdef") for k in (8, 4, 4, 4, 12)),
            ]
        )()

    out = []
    for _ in range(n):
        text, found, pool = "", [], []
        junk = rng.choice(["", "", "", "!!", "###", "%%%", ","])
        for _ in range(rng.randint(1, 6)):
            text += " ".join(word() + (junk if rng.random() < 0.7 else "") for _ in range(rng.randint(0, 6))) + rng.choice([" ", " ", ". ", "\n", " | "])
            if rng.random() < 0.55:
                pre, v, kind = rng.choice(pool) if pool and rng.random() < 0.3 else private()
                pool.append((pre, v, kind))
                text += pre
                found.append((len(text), len(text) + len(v), kind))
                text += v + rng.choice([" ", ". ", ", ", f"{junk} "])
            else:
                text += public() + rng.choice([" ", ". ", ", ", f"{junk} "])
        case = rng.random()
        out.append((text.upper() if case < 0.12 else text, found))
    return out


@lru_cache(maxsize=1)
def field() -> Field:
    return fit(labelled_documents())


def find(texts: list[str | None], model: Field) -> list[tuple[int, int, int, str, float]]:
    """``(document, start, end, kind, score)``; the score is the least marginal of the tokens."""
    g = nodes(texts)
    if not g.spans:
        return []
    p = model.marginals(g, tolerance=TOLERANCE)[0]
    best = p.argmax(1)
    joined = {b for _, b in g.edges[0]}
    out: list[list] = []
    last = -2
    for i in np.flatnonzero(best).tolist():
        kind, score = LABELS[best[i]][2:], float(p[i, best[i]])
        s, e = g.spans[i]
        if out and last == i - 1 and i in joined and out[-1][3] == kind and LABELS[best[i]][0] == "I":
            out[-1][2], out[-1][4] = e, min(out[-1][4], score)
        else:
            out.append([g.doc[i], s, e, kind, score])
        last = i
    return [tuple(x) for x in out]


def entities(docs: DataFrame, model: Field | None = None) -> DataFrame:
    """``doc_id, start, end, kind, score`` of each piece of personal data."""
    model = field() if model is None else model
    unary, pair = model.unary.astype(np.float32), model.pair.astype(np.float32)
    names = ["doc_id", "start", "end", "kind", "score"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.float64()]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = Field(unary, pair)
        for batch in batches:
            ids, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            rows = [(ids[lo + d], *x) for lo, hi in kernel.slices(texts, SLICE_CHARS) for d, *x in find(texts[lo:hi], mine)]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    source = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(scan, "doc_id bigint, start bigint, end bigint, kind string, score double")
