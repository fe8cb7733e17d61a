"""Small invented corpora for the tests."""

import random

DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
SYLLABLES = {
    "en": "the an ing er tion and re of th ed on st ly ha".split(),
    "de": "sch ein ung der ie keit und be ver ö ß lich ge".split(),
    "es": "ción os la que ar ñ de mente es ado rr ll ó".split(),
}


def words(rng, lang, n):
    s = SYLLABLES[lang]
    return ["".join(rng.choice(s) for _ in range(rng.randint(1, 4))) for _ in range(n)]


def text(rng, lang="en", n=60):
    return " ".join(words(rng, lang, n)).capitalize() + "."


def rows(seed=0, n=60):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        lang = rng.choice(list(SYLLABLES))
        t = text(rng, lang, rng.randint(40, 120))
        out.append((i, t, lang, f"src{i % 3}", len(t)))
    return out


def edited(rng, t, share=0.03):
    w = t.split()
    for k in range(len(w)):
        if rng.random() < share:
            w[k] = "edit%d" % rng.randint(0, 99)
    return " ".join(w)


def frame(spark, data):
    return spark.createDataFrame(data, DOCS)
