"""Secret scans: candidates by pattern, false positives removed by a random forest.

A candidate is a run without blanks or quotes that holds a digit and eight
characters or more, the value of an assignment, or the body of a private key
block. A forest of decision trees, grown here on labelled findings, judges its
length, character transitions, dictionary coverage, whether it looks like a
path, and the words next to it. Findings at or above ``MIN_SCORE`` are secrets.

The forest is trained on ``labelled_findings``, a seeded generator of
credentials in common formats and of look-alikes (digests, identifiers,
numbers, addresses, paths, placeholders); its size is the documented bound of
the sample. ``fit`` takes any other labelled findings.

Defined results: null and empty texts have no finding; a null id is kept as
null; repeated rows are reported once each; offsets count code points.
``redact`` keeps every row and column and changes ``text`` (and ``n_chars``,
if there is one) of rows with findings only.
"""

from __future__ import annotations

import math
import random
import re
import string
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Labelled findings that train the forest, its trees and depth, and the score that makes a secret.
FINDINGS, TREES, DEPTH, MIN_SCORE, SEED = 4000, 40, 9, 0.5, 51

_RUN = re.compile(r"""(?<![^\s"'`=:<>()\[\]{},;|])[^\s"'`=:<>()\[\]{},;|0-9]*+[0-9][^\s"'`=<>()\[\]{},;|]*+""")
_ASSIGN = re.compile(r"""[:=]""")
_VALUE = re.compile(r"""[\s"'`]{0,3}([^\s"'`<>()\[\]{},;|=][^\s"'`<>()\[\]{},;|]{5,}=*)""")
_KEY_HEAD = r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----"
#: A key block up to its END; without one its fields and its lines of base64, never the text after them.
_KEY_BLOCK = re.compile(
    _KEY_HEAD + r"(?:(?:(?!-----).)*+-----END [A-Z ]{0,30}PRIVATE KEY-----"
    r"|(?:\s{0,4}+(?:Proc-Type|DEK-Info):[^\n]{0,100}+)*+(?:(?:\s|\\[rn]){0,4}+[A-Za-z0-9+/]{24,}+={0,2}+)++(?:(?:\s|\\[rn]){1,4}+[A-Za-z0-9+/]{2,}+={1,2})?)",
    re.S,
)
_WORD = re.compile(r"[^\W\d_]+")
_BEFORE = re.compile(r"""[^\W\d_]+(?=[\W\d_]{0,6}$)""")
_AFTER = re.compile(r"""^[\W\d_]{0,3}([^\W\d_]+)""")

SECRET_WORDS = frozenset(
    "password passwd passwort pwd pass secret token key apikey api auth bearer credential credentials access private clave contrasena contraseña"
    " motdepasse geheim signing client jwt login".split()
)
PLAIN_WORDS = frozenset(
    "commit sha md5 checksum digest hash uuid guid id version release build isbn order invoice phone tel call card account page line etag revision"
    " ip host address mail email path file url image section chapter since year serial part model room".split()
)
DICTIONARY = frozenset(
    "the and for are but not you all any can had her was one our out day get has him his how man new now old see two way who boy did its let put say"
    " she too use that with have this will your from they know want been good much some time very when come here just like long make many more only"
    " over such take than them well were what about after again could every first found great house large learn never other place plant point right"
    " small sound spell still study their there these thing think three water where which world would write example sample test demo change your"
    " replace placeholder dummy user users name home local share data file files image images index main module source config default value server"
    " client service version static assets public images docs document page section report invoice order number photo video audio backup archive"
    " der die das und ist von mit den für que los las una por con les des est une dans pour sur".split()
)
_PREFIX = re.compile(r"^(?:AKIA|ASIA|gh[opsru]_|github_pat_|sk-|sk_live|pk_live|rk_live|xox[abprs]-|eyJ|AIza|glpat-|hf_|npm_|SG\.|ya29\.|-----BEGIN)")
_PLACEHOLDER = re.compile(r"x{4,}|\*{3,}|\.{3}|example|sample|change|placeholder|your|dummy|test|0{6,}|1234567|abcdef|\$\{|<", re.I)
_DATE = re.compile(r"^\d{4}-\d\d-\d\d")
_CLASS = np.full(128, 3, np.int8)
for _k, _chars in enumerate((string.ascii_lowercase, string.ascii_uppercase, string.digits)):
    _CLASS[[ord(_c) for _c in _chars]] = _k


def proposals(text: str | None) -> list[tuple[int, int]]:
    """All spans of possible secrets, also those that lie in others or overlap them; longer ones first of equal start."""
    if not text:
        return []
    found = [(m.start(), m.end()) for m in _KEY_BLOCK.finditer(text)] if "-----BEGIN" in text else []
    found += [(m.start(), m.end()) for m in _RUN.finditer(text) if m.end() - m.start() >= 8]
    for a in _ASSIGN.finditer(text):
        before = _BEFORE.search(text, max(0, a.start() - 24), a.start())
        if before and before.group().lower() in SECRET_WORDS and (m := _VALUE.match(text, a.end())):
            found.append(m.span(1))
    out = set()
    for s, e in found:
        while e > s and text[e - 1] in ".!?…":
            e -= 1
        if e - s >= 6:
            out.add((s, e))
    return sorted(out, key=lambda x: (x[0], -x[1]))


def united(spans: list[tuple[int, int, float]]) -> list[tuple[int, int, float]]:
    """Ascending ``(start, end, score)`` with those that overlap made one, with the best score, so that no part of any is lost."""
    out: list[tuple[int, int, float]] = []
    for s, e, p in spans:
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]), max(p, out[-1][2]))
        else:
            out.append((s, e, p))
    return out


def candidates(text: str | None) -> list[tuple[int, int]]:
    """Spans of possible secrets, ascending and without overlap, whatever their score."""
    return [(s, e) for s, e, _ in united([(s, e, 0.0) for s, e in proposals(text)])]


def _coverage(value: str) -> float:
    """Part of the characters that lie in words of the dictionary, longest words first."""
    hit = 0
    for w in _WORD.findall(value.lower()):
        i = 0
        while i < len(w):
            n = next((n for n in range(min(12, len(w) - i), 2, -1) if w[i : i + n] in DICTIONARY), 0)
            hit += n
            i += n or 1
    return hit / max(len(value), 1)


def features(text: str, start: int, end: int) -> list[float]:
    v = text[start:end]
    codes = np.frombuffer(v.encode("ascii", "replace"), np.uint8)
    kind = _CLASS[codes]
    counts = np.bincount(codes, minlength=128)
    p = counts[counts > 0] / len(codes)
    before, after = text[max(0, start - 40) : start], text[end : end + 24]
    words = [w.lower() for w in _WORD.findall(before)[-3:]]
    following = _AFTER.match(after)
    near = words[-1] if words and _BEFORE.search(before) else ""
    pairs = kind[1:] * 4 + kind[:-1]
    letters = np.bincount(kind, minlength=4) / len(codes)
    digits = codes[kind == 2]
    return [
        float(min(len(v), 200)),
        float(-(p * np.log2(p)).sum()),
        float((kind[1:] != kind[:-1]).mean()) if len(v) > 1 else 0.0,
        *[float((pairs == a * 4 + b).mean()) if len(v) > 1 else 0.0 for a, b in ((0, 2), (2, 0), (1, 2), (2, 1), (0, 1), (1, 0))],
        *letters.tolist(),
        len(p) / len(v),
        float(all(c in "0123456789abcdef-" for c in v)),
        _coverage(v),
        float(max(map(len, _WORD.findall(v)), default=0)),
        float(v.count("/") + v.count("\\")),
        float(v.count(".")),
        float(v.count("-")),
        float("@" in v),
        float("://" in v or v.startswith(("/", "./", "~", "www."))),
        float(bool(_PREFIX.match(v))),
        float(bool(_PLACEHOLDER.search(v))),
        float(bool(_DATE.match(v))),
        float(len(digits) == len(v)),
        float(near in SECRET_WORDS),
        float(any(w in SECRET_WORDS for w in words)),
        float(near in PLAIN_WORDS),
        float(any(w in PLAIN_WORDS for w in words)),
        float(following is not None and following.group(1).lower() in PLAIN_WORDS),
        float(bool(re.search(r"[=:]\s*[\"'`]?$", before))),
        float(before[-1:] in "\"'`" and before != ""),
        float(before[-1:] == "+" or v[:1] == "+"),
    ]


@dataclass
class Forest:
    """Trees as parallel arrays: feature (-1 in leaves), cut, left and right child, share of secrets."""

    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.zeros(len(x))
        for feature, cut, left, right, share in self.trees:
            at = np.zeros(len(x), np.int64)
            while True:
                f = feature[at]
                inner = np.flatnonzero(f >= 0)
                if not len(inner):
                    break
                go = x[inner, f[inner]] <= cut[at[inner]]
                at[inner] = np.where(go, left[at[inner]], right[at[inner]])
            total += share[at]
        return total / len(self.trees)


def _split(x: np.ndarray, y: np.ndarray, tried: np.ndarray) -> tuple[float, int, float] | None:
    """The cut of least Gini impurity over some features."""
    best = None
    for f in tried:
        order = np.argsort(x[:, f], kind="stable")
        v, t = x[order, f], np.cumsum(y[order])
        at = np.flatnonzero(v[1:] != v[:-1])
        if not len(at):
            continue
        n, a = at + 1.0, t[at]
        m, b = len(y) - n, t[-1] - a
        g = 2 * a * (1 - a / n) + 2 * b * (1 - b / m)
        i = int(g.argmin())
        if best is None or g[i] < best[0]:
            best = (float(g[i]), int(f), float((v[at[i]] + v[at[i] + 1]) / 2))
    return best


def grow(x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, seed: int = SEED) -> Forest:
    """A forest on bootstrap samples, each split over a random square root of the features."""
    rng, out = np.random.default_rng(seed), []
    tried = max(1, math.isqrt(x.shape[1]) + 1)
    for _ in range(trees):
        pick = rng.integers(0, len(y), len(y))
        nodes: list[list[float]] = []

        def build(rows: np.ndarray, level: int) -> int:
            me, t = len(nodes), y[rows]
            nodes.append([-1, 0.0, 0, 0, float(t.mean())])
            if level < depth and len(rows) > 3 and 0 < t.mean() < 1:
                cut = _split(x[rows], t, rng.choice(x.shape[1], tried, replace=False))
                if cut:
                    go = x[rows, cut[1]] <= cut[2]
                    left, right = build(rows[go], level + 1), build(rows[~go], level + 1)
                    nodes[me][:4] = [cut[1], cut[2], left, right]
            return me

        build(pick, 0)
        n = np.array(nodes)
        out.append((n[:, 0].astype(int), n[:, 1], n[:, 2].astype(int), n[:, 3].astype(int), n[:, 4]))
    return Forest(out)


def labelled_findings(n: int = FINDINGS, seed: int = SEED) -> list[tuple[str, int, int, int]]:
    """Invented ``(text, start, end, is_secret)``; half of them secrets."""
    rng = random.Random(seed)
    alnum, b64, hexa = string.ascii_letters + string.digits, string.ascii_letters + string.digits + "+/", "0123456789abcdef"
    some = lambda chars, k: "".join(rng.choice(chars) for _ in range(k))
    word = lambda: "".join(rng.choice(["the", "er", "sch", "ing", "on", "que", "ch", "st", "ción", "ou", "ai", "en"]) for _ in range(rng.randint(1, 4)))
    key = lambda: rng.choice("password passwd pwd secret token api_key apikey auth_token access_key client_secret PASSWORD SECRET_KEY clave passwort".split())

    def assigned(v: str) -> tuple[str, str, str]:
        q = rng.choice(["", '"', "'"])
        return f"{key()}{rng.choice(['=', ' = ', ': ', ':', ' := '])}{q}", v, q

    def bare(v: str) -> tuple[str, str, str]:
        return rng.choice(["", "", "key ", "use ", "with "]), v, ""

    def secret() -> tuple[str, str, str]:
        return rng.choice(
            [
                lambda: bare(rng.choice(["AKIA", "ASIA"]) + some(string.ascii_uppercase + "234567890", 16)),
                lambda: bare(rng.choice(["ghp_", "gho_", "glpat-", "hf_", "npm_", "sk-", "sk_live_", "xoxb-"]) + some(alnum, rng.randint(20, 40))),
                lambda: bare("AIza" + some(alnum + "_-", 35)),
                lambda: bare("eyJ" + some(b64, 20) + ".eyJ" + some(b64, 40) + "." + some(alnum + "_-", 43)),
                lambda: assigned(some(hexa, rng.choice([16, 18, 20, 24, 32, 40, 64]))),
                lambda: assigned(some(alnum, rng.randint(10, 40))),
                lambda: assigned(some(b64, rng.randint(20, 60)) + rng.choice(["", "=", "=="])),
                lambda: assigned(some(alnum + "!@#$%^&*", rng.randint(8, 20))),
                lambda: assigned(rng.choice(["AKIA" + some(string.ascii_uppercase + string.digits, 16), "ghp_" + some(alnum, 36)])),
                lambda: bare("-----BEGIN RSA PRIVATE KEY-----\n" + some(b64, 200) + "\n-----END RSA PRIVATE KEY-----"),
                lambda: ("Authorization: Bearer ", some(alnum + "-_", rng.randint(24, 60)), ""),
            ]
        )()

    def plain() -> tuple[str, str, str]:
        digits = string.digits
        return rng.choice(
            [
                lambda: (rng.choice(["", "card ", "no. "]), some(digits, rng.choice([9, 10, 12, 13, 16])), ""),
                lambda: (rng.choice(["", "tel ", "call "]), f"+{some(digits, rng.randint(9, 12))}", ""),
                lambda: ("", f"{some(digits, 3)}-{some(digits, 4)}", ""),
                lambda: (rng.choice(["", "ip "]), ".".join(str(rng.randint(0, 255)) for _ in range(4)), ""),
                lambda: (rng.choice(["", "mail "]), f"{some(string.ascii_lowercase, 5)}.{some(digits, 2)}@mail{rng.randint(0, 9)}.example.com", ""),
                lambda: (rng.choice(["commit ", "sha ", "checksum: ", "md5 ", "digest=", "etag: "]), some(hexa, rng.choice([32, 40, 64])), ""),
                lambda: (rng.choice(["uuid ", "id: ", "guid=", ""]), "-".join(some(hexa, k) for k in (8, 4, 4, 4, 12)), ""),
                lambda: (rng.choice(["version ", "v", "release "]), f"{rng.randint(0, 20)}.{rng.randint(0, 20)}.{rng.randint(0, 99)}-rc{rng.randint(1, 9)}", ""),
                lambda: (rng.choice(["", "file ", "path: "]), "/" + "/".join(word() + some(digits, rng.randint(0, 2)) for _ in range(rng.randint(2, 5))) + ".txt", ""),
                lambda: ("", f"https://www.example.com/{word()}/{some(digits, 5)}?page={rng.randint(1, 9)}", ""),
                lambda: ("", f"{rng.randint(1990, 2030)}-{rng.randint(10, 12)}-{rng.randint(10, 28)}T{some(digits, 2)}:00", ""),
                lambda: assigned(rng.choice(["your_password_here1", "changeme123", "xxxxxxxxxxxx1", "example-token-1234567", "${TOKEN_1}", "test1234567", "00000000", "placeholder"])),
                lambda: (f"{rng.choice(['count', 'total', 'price', 'size', 'order', 'page'])}{rng.choice(['=', ': '])}", some(digits, rng.randint(8, 12)), ""),
                lambda: ("", word() + word() + some(digits, rng.randint(1, 3)) + word(), ""),
                lambda: (rng.choice(["secret ", "token ", "the key ", "password ", "password: ", "key = "]), word() + word() + word(), ""),
                lambda: ("", "-".join(word() for _ in range(3)) + "-" + some(digits, 4), ""),
            ]
        )()

    out = []
    for i in range(n):
        pre, v, post = (secret if i % 2 == 0 else plain)()
        left = " ".join(word() for _ in range(rng.randint(0, 8)))
        right = " ".join(word() for _ in range(rng.randint(0, 6)))
        head = f"{left}{rng.choice([' ', ' ', '. ', chr(10)])}{pre}"
        out.append((f"{head}{v}{post} {right}", len(head), len(head) + len(v), int(i % 2 == 0)))
    return out


def fit(findings: list[tuple[str, int, int, int]]) -> Forest:
    x = np.array([features(t, s, e) for t, s, e, _ in findings])
    return grow(x, np.array([y for *_, y in findings], float))


@lru_cache(maxsize=1)
def forest() -> Forest:
    return fit(labelled_findings())


def scan(text: str | None, model: Forest, least: float = MIN_SCORE) -> list[tuple[int, int, float]]:
    """``(start, end, score)`` of the secrets of a text; each proposal is judged, overlaps are resolved among the secrets only."""
    spans = proposals(text)
    if not spans:
        return []
    scores = model.score(np.array([features(text, s, e) for s, e in spans]))
    return united([(s, e, float(p)) for (s, e), p in zip(spans, scores) if p >= least])


def findings(docs: DataFrame, model: Forest | None = None, least: float = MIN_SCORE) -> DataFrame:
    """``doc_id, start, end, score, preview`` of each secret; the preview shows its first four characters."""
    model = forest() if model is None else model
    names = ["doc_id", "start", "end", "score", "preview"]
    kinds = [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.string()]

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [
                (d, s, e, p, t[s : s + 4] + "***")
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for s, e, p in scan(t, model, least)
            ]
            columns = list(zip(*rows)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    source = docs.where("text IS NOT NULL").select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    return source.mapInArrow(find, "doc_id bigint, start bigint, end bigint, score double, preview string")


def redact(docs: DataFrame, mark: str = "[SECRET]", model: Forest | None = None, least: float = MIN_SCORE) -> DataFrame:
    """``docs`` with every secret replaced by ``mark``."""
    model = forest() if model is None else model
    at = docs.columns.index("text")
    length = docs.columns.index("n_chars") if "n_chars" in docs.columns else None

    def replace(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, columns, changed = batch.column(at).to_pylist(), list(batch.columns), {}
            for i, t in enumerate(texts):
                if found := scan(t, model, least):
                    parts, last = [], 0
                    for s, e, _ in found:
                        parts += [t[last:s], mark]
                        last = e
                    texts[i] = changed[i] = "".join(parts) + t[last:]
            if changed:
                columns[at] = pa.array(texts, batch.schema.field(at).type)
                if length is not None:
                    n = columns[length].to_pylist()
                    for i, t in changed.items():
                        n[i] = len(t)
                    columns[length] = pa.array(n, batch.schema.field(length).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names)

    return docs.mapInArrow(replace, docs.schema)
