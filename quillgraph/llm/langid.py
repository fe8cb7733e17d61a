"""Language identification by string kernels.

A text is a set of character n-grams for each n of a blended spectrum; the
kernel of two texts is the mean over n of the cosine of their presence
vectors. Landmark texts give a Nyström map, and a kernel ridge regression per
language is solved in its coordinates. A score is then linear in the presence
vector of each n, so a batch is scored as one product of its presence matrix
with an (n-grams x languages) matrix: (X L') B = X (L' B).

Texts are folded before they are compared: lower case, digits to 0, runs of
anything that is not a letter or digit to one blank. Characters that no
landmark has share one symbol.

Defined results: null, empty and letterless texts have no language
(``language`` null, ``score`` 0) and are not accepted; the label column is
read for training only, from whole texts of any length that have a letter.
Extra columns pass through, in ``keep`` under any name; rows are never merged,
so repeated rows stay repeated. An empty table gives an empty result. Ties of
scores go to the language that sorts first.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

#: Bounds of the labelled sample, per language: rows that train, and how many of them are landmarks.
TRAIN_PER_LANGUAGE, LANDMARKS_PER_LANGUAGE = 300, 60
SPECTRUM = (1, 2, 3)
#: Accept a text if its best one-versus-rest score is at least this; targets are 1 and 0.
MIN_SCORE = 0.15
#: Reject a text if its declared language is another one that the model knows and loses by this margin.
MIN_MARGIN = 0.25

_TOP = 0x30000  # code points from here on are folded to blanks, like other symbols
_FOLDED: list[np.ndarray] = []


def _table() -> np.ndarray:
    """Code point -> folded code point: letters stay, digits become 0, the rest a blank."""
    if not _FOLDED:
        t = np.full(_TOP, 32, np.uint32)
        for cp in range(_TOP):
            c = chr(cp)
            if c.isalpha():
                t[cp] = cp
            elif c.isdigit():
                t[cp] = 48
        _FOLDED.append(t)
    return _FOLDED[0]


def fold(text: str | None) -> np.ndarray:
    """Code points of the folded text."""
    if not text:
        return np.zeros(0, np.uint32)
    cp = np.frombuffer(text.lower().encode("utf-32-le", "replace"), np.uint32)
    cp = _table()[np.minimum(cp, _TOP - 1)]
    keep = cp > 48
    same = cp[1:] != cp[:-1]
    keep[1:] |= same
    keep[:1] |= cp[:1] == 48
    cp = cp[keep]
    return cp[int(len(cp) > 0 and cp[0] == 32) : len(cp) - int(len(cp) > 1 and cp[-1] == 32)]


@dataclass
class Model:
    languages: list[str]
    alphabet: np.ndarray  # code points, sorted; symbol i+1; 0 is any other
    vocabulary: list[np.ndarray]  # sorted n-gram codes for each n
    weights: list[np.ndarray]  # (n-grams x languages) for each n, float32
    spectrum: tuple[int, ...] = SPECTRUM
    lookup: np.ndarray | None = None

    def symbols(self, folded: np.ndarray) -> np.ndarray:
        if self.lookup is None:
            self.lookup = np.zeros(_TOP, np.int32)
            self.lookup[self.alphabet] = np.arange(1, len(self.alphabet) + 1)
        return self.lookup[folded]

    def presence(self, folded: np.ndarray) -> list[np.ndarray]:
        """Distinct n-gram codes of a folded text, for each n."""
        base = len(self.alphabet) + 1
        s = self.symbols(folded)
        if base ** max(self.spectrum) >= 1 << 31:
            s = s.astype(np.int64)
        out, code = [], s
        for n in range(1, max(self.spectrum) + 1):
            if n > 1:
                code = code[:-1] * base + s[n - 1 :] if len(code) > 1 else code[:0]
            if n in self.spectrum:
                out.append(distinct(code, base**n))
        return out

    def scores(self, texts: list[str | None]) -> np.ndarray:
        """(texts x languages); rows of texts without n-grams are 0."""
        total = np.zeros((len(texts), len(self.languages)), np.float32)
        got = [self.presence(fold(t)) for t in texts]
        for k, (vocabulary, weights) in enumerate(zip(self.vocabulary, self.weights)):
            size = np.array([len(g[k]) for g in got], np.int64)
            if not size.sum():
                continue
            code = np.concatenate([g[k] for g in got])
            row = np.repeat(np.arange(len(texts)), size)
            i = np.searchsorted(vocabulary, code)
            i[i == len(vocabulary)] = 0
            hit = vocabulary[i] == code
            total += _product(row[hit], i[hit], weights, len(texts)) / np.sqrt(np.maximum(size, 1))[:, None]
        return total / len(self.vocabulary)


def distinct(code: np.ndarray, top: int) -> np.ndarray:
    """Sorted distinct codes below ``top``."""
    if top <= 1 << 17:
        seen = np.zeros(top, bool)
        seen[code] = True
        return np.flatnonzero(seen)
    if not len(code):
        return code
    s = np.sort(code)
    return s[np.concatenate(([True], s[1:] != s[:-1]))]


def _product(row: np.ndarray, col: np.ndarray, weights: np.ndarray, rows: int) -> np.ndarray:
    """X @ weights for the 0/1 matrix X that has its ones at (row, col), rows ascending."""
    out = np.zeros((rows, weights.shape[1]), np.float32)
    if len(row):
        at = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
        out[row[at]] = np.add.reduceat(weights[col], at, axis=0)
    return out


def kernel(model: Model, a: list[list[np.ndarray]], b: list[list[np.ndarray]]) -> np.ndarray:
    """Blended presence kernel of two lists of presence sets over the model's n-grams, in blocks of n-grams."""
    total = np.zeros((len(a), len(b)))
    for k, vocabulary in enumerate(model.vocabulary):
        places, norms = [], []
        for texts in (a, b):
            row = np.repeat(np.arange(len(texts)), [len(t[k]) for t in texts])
            flat = np.concatenate([t[k] for t in texts]) if texts else np.zeros(0, np.int64)
            at = np.searchsorted(vocabulary, flat)
            at[at == len(vocabulary)] = 0
            hit = vocabulary[at] == flat
            order = np.argsort(at[hit], kind="stable")
            places.append((row[hit][order], at[hit][order]))
            norms.append(np.sqrt(np.maximum([len(t[k]) for t in texts], 1)))
        both = np.zeros((len(a), len(b)))
        for lo in range(0, len(vocabulary), 4096):
            xs = []
            for (row, at), texts in zip(places, (a, b)):
                i, j = np.searchsorted(at, (lo, lo + 4096))
                x = np.zeros((len(texts), 4096), np.float32)
                x[row[i:j], at[i:j] - lo] = 1
                xs.append(x)
            both += xs[0] @ xs[1].T
        total += both / norms[0][:, None] / norms[1]
    return total / len(model.vocabulary)


def train(
    texts: list[str],
    labels: list[str],
    landmarks_per_language: int = LANDMARKS_PER_LANGUAGE,
    ridge: float = 1e-2,
    spectrum: tuple[int, ...] = SPECTRUM,
) -> Model:
    """Fit on labelled texts; the first texts of each language are its landmarks."""
    folded = [fold(t) for t in texts]
    languages = sorted(set(labels))
    left = {lang: landmarks_per_language for lang in languages}
    land = []
    for i, lang in enumerate(labels):
        if left[lang] > 0 and len(folded[i]):
            left[lang] -= 1
            land.append(i)
    alphabet = np.unique(np.concatenate([folded[i] for i in land] or [np.zeros(0, np.uint32)]))
    if not len(alphabet):
        raise ValueError("no labelled text has a letter")
    model = Model(languages, alphabet, [], [], spectrum)
    sets = [model.presence(t) for t in folded]
    for k in range(len(spectrum)):
        model.vocabulary.append(np.unique(np.concatenate([sets[i][k] for i in land])))
    landmark_sets = [sets[i] for i in land]
    kmm = kernel(model, landmark_sets, landmark_sets)
    value, vector = np.linalg.eigh(kmm)
    keep = value > 1e-6 * value.max()
    root = vector[:, keep] / np.sqrt(value[keep])  # K_mm^(-1/2) in its own basis
    z = kernel(model, sets, landmark_sets) @ root
    y = (np.array(labels)[:, None] == np.array(languages)[None, :]).astype(float)
    beta = root @ np.linalg.solve(z.T @ z + ridge * len(texts) / 100 * np.eye(z.shape[1]), z.T @ y)
    for k, vocabulary in enumerate(model.vocabulary):
        w = np.zeros((len(vocabulary), len(languages)), np.float32)
        for r, s in enumerate(landmark_sets):
            w[np.searchsorted(vocabulary, s[k])] += (beta[r] / np.sqrt(max(len(s[k]), 1))).astype(np.float32)
        model.weights.append(w)
    return model


def training_sample(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> list:
    """A sample of at most ``per_language`` different labelled texts of each language, those of the least hashes, not by place or length.

    The hashes below which a language has about four times as many are worked
    out first, so that few texts move, and copies of one are one before they do.
    """
    order = Window.partitionBy("lang").orderBy("h", "text")
    labelled = docs.where(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}")).select("lang", "text", F.xxhash64("text").alias("h"))
    sizes = labelled.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()  # one row for each language
    most = [(r.lang, min((1 << 63) - 1, -(1 << 63) + (1 << 64) * 4 * per_language // max(r.n, 1))) for r in sizes]
    bounds = docs.sparkSession.createDataFrame(most, "lang string, most bigint")
    low = labelled.join(F.broadcast(bounds), "lang").where("h <= most").groupBy("lang", "h").agg(F.min("text").alias("text"))
    return (
        low.withColumn("rank", F.row_number().over(order))
        .where(F.col("rank") <= per_language)
        .orderBy("lang", "rank")
        .select("lang", "text")
        .collect()
    )


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE) -> Model | None:
    """None if no row is labelled."""
    rows = training_sample(docs, per_language)
    return train([r.text for r in rows], [r.lang for r in rows]) if rows else None


def identify(docs: DataFrame, model: Model | None, text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``carry`` columns (all by default) with ``language``, ``score``, ``margin``.

    Clashing column names in ``docs`` are replaced.
    """
    new = ("language", "score", "margin")
    carry = [c for c in (docs.columns if carry is None else carry) if c not in new]
    schema = T.StructType([docs.schema[c] for c in carry])
    schema = schema.add("language", "string").add("score", "double").add("margin", "double")
    source = docs.select(*[F.col(f"`{c}`") for c in carry], F.col(f"`{text}`").alias("__text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.num_columns - 1).to_pylist()
            s = np.zeros((len(texts), max(1, len(model.languages) if model else 0)), np.float32)
            if model:
                for lo in range(0, len(texts), 256):
                    s[lo : lo + 256] = model.scores(texts[lo : lo + 256])
            best = s.argmax(1)
            top = s[np.arange(len(texts)), best].astype(np.float64)
            rest = np.sort(s, 1)[:, -2].astype(np.float64) if s.shape[1] > 1 else np.zeros(len(texts))
            known = (s != 0).any(1)
            names = [model.languages[b] if k else None for b, k in zip(best, known)]
            columns = [batch.column(i) for i in range(len(carry))]
            columns += [pa.array(names, pa.string()), pa.array(top), pa.array(top - rest)]
            yield pa.RecordBatch.from_arrays(columns, names=[*carry, *new])

    return source.mapInArrow(score, schema)


def keep(docs: DataFrame, model: Model | None = None, min_score: float = MIN_SCORE, min_margin: float = MIN_MARGIN) -> DataFrame:
    """The rows of ``docs`` that :func:`accept` takes, with their own columns, whatever these are called."""
    model = fit(docs) if model is None else model
    at, lang = docs.columns.index("text"), docs.columns.index("lang")

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, declared = batch.column(at).to_pylist(), batch.column(lang).to_pylist()
            ok = np.zeros(len(texts), bool)
            for lo in range(0, len(texts) if model else 0, 256):
                s = model.scores(texts[lo : lo + 256])
                best = s.argmax(1)
                top = s[np.arange(len(s)), best].astype(np.float64)
                rest = np.sort(s, 1)[:, -2].astype(np.float64) if s.shape[1] > 1 else np.zeros(len(s))
                other = np.array([d in model.languages and d != model.languages[b] for d, b in zip(declared[lo : lo + 256], best)], bool)
                ok[lo : lo + 256] = (s != 0).any(1) & (top >= min_score) & ~(other & (top - rest >= min_margin))
            yield batch.filter(pa.array(ok))

    return docs.mapInArrow(choose, docs.schema)


def accept(
    docs: DataFrame,
    model: Model | None = None,
    min_score: float = MIN_SCORE,
    min_margin: float = MIN_MARGIN,
    carry: list[str] | None = None,
) -> DataFrame:
    """The rows of :func:`identify` that are accepted; ``carry`` must hold ``lang``.

    Rejected are texts without a recognised language, texts that score below
    ``min_score`` and texts whose declared ``lang`` is a language of the model
    and is beaten by another by ``min_margin`` or more. A null or unknown
    declared language rejects nothing.
    """
    model = fit(docs) if model is None else model
    scored = identify(docs, model, carry=carry)
    known = model.languages if model else []
    contradicted = F.col("lang").isin(known) & (F.col("lang") != F.col("language")) & (F.col("margin") >= min_margin)
    return scored.where(
        F.col("language").isNotNull() & (F.col("score") >= min_score) & ~F.coalesce(contradicted, F.lit(False))
    )
