"""Extractive summaries against plain loops."""

import random
import re

import pytest

from quern.functions import text as tx
from quern.operators import summaries

WS = " \t\n\r\f"


def sentences(text):
    return [s for s in (p.strip(WS) for p in re.sub("([.!?])", "\\1\1", text).split("\1")) if len(s.encode()) > 5]


def scores(s):
    words = lambda x: [w for w in re.split(f"[{WS}]+", x) if w]
    clean = lambda x: [c for c in (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in words(x)) if c and c not in tx.STOP_WORDS]
    every = [c for x in s for c in clean(x)]
    out = []
    for i, x in enumerate(s):
        w, c = words(x), clean(x)
        place = 2.0 if i == 0 else 1.5 if i == len(s) - 1 else 1 - 0.5 * i / len(s)
        size = 0.3 if len(w) < 5 else 0.5 if len(w) > 40 else 1.0 if 10 <= len(w) <= 25 else 0.7
        common = min(sum(every.count(y) for y in c) / len(c) / 3, 1) if c else 0
        names = sum(y[0].isupper() and len(y.encode()) > 2 and y.lower() not in tx.STOP_WORDS for y in w) / max(1, len(w))
        out.append(round(0.3 * place + 0.2 * size + 0.3 * common + 0.1 * names + 0.1 * min(0.3 * sum(any(ch.isnumeric() for ch in y) for y in w), 1), 6))
    return out


def summary(text, most):
    s = sentences(text)
    if len(s) == 1 and len(s[0].encode()) > most:
        return re.sub(f"[{WS}]+[^{WS}]*$", "", s[0][: most - 3]) + "..."
    order, held, taken = sorted(range(len(s)), key=lambda i: (-scores(s)[i], i)), 0, []
    for i in order:
        n = len(s[i].encode())
        if held + n < most:
            taken.append(i)
            held += n + 1
        if held >= most * 90 // 100:
            break
    return " ".join(s[i] for i in sorted(taken or order[:1]))


def texts():
    rng = random.Random(4)
    pool = ["Plato", "the", "and", "love", "love", "Éros", "12", "a1", "beauty", "Symposium", "of", "speaks", "wine,", "(night)", "x"]
    made = [" ".join(" ".join(rng.choice(pool) for _ in range(rng.randint(1, 30))) + rng.choice([".", "!", "?", "..", ".\n"]) for _ in range(rng.randint(1, 12))) for _ in range(50)]
    return [*made, "", None, "ab.", "... ... !", "word " * 300, "one long sentence " * 40 + ". Short one here."]


@pytest.mark.parametrize("most", [60, 300])
def test_summaries(spark, most):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, total int")
    got = {r["doc_id"]: r["summary"] for r in summaries.summarize(frame, most).collect()}
    top = {r["doc_id"]: r["summary"] for r in summaries.best_sentences(frame, 3).collect()}
    own = {(r["doc_id"], r["at"]): r["score"] for r in summaries.scored(frame).collect()}
    for i, t in rows:
        s = sentences(t or "")
        assert (i in got) == bool(s) == (i in top)
        if s:
            assert all(abs(own[i, k + 1] - x) < 2e-6 for k, x in enumerate(scores(s))) and got[i] == summary(t, most)
            assert top[i] == " ".join(s[k] for k in sorted(sorted(range(len(s)), key=lambda k: (-scores(s)[k], k))[:3]))
