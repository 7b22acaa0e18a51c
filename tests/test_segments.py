"""Semantic chunks and persons against plain loops, the best segmentation against all of them."""

import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from quern.operators import chunks, persons, segments
from quern.operators import entities as en


def sentences(text):
    return [s.strip(" ") for s in re.sub(r"([.!?]+)[ \t\n\r\f]+", "\\1\1", text).split("\1") if s.strip(" ")]


def cut(d, limit, least, most, n):
    ends, start, out = [i + 1 for i, x in enumerate(d) if x > limit] + [n], 0, []
    for e in ends:
        if e - start >= least:
            out.append([start, e])
            start = e
    if start < n:
        if out:
            out[-1][1] = n
        else:
            out.append([start, n])
    return [(a, min(a + most, e)) for s, e in out for a in range(s, e, most or 10**9)] if most else [tuple(x) for x in out]


def texts(seed=1):
    rng = random.Random(seed)
    made = [" ".join(" ".join(rng.choice("abcdefgh") * rng.randint(1, 2) for _ in range(rng.randint(1, 6))) + rng.choice(". |! |? ".split("|")).strip() for _ in range(rng.randint(1, 40))) for _ in range(60)]
    return [*made, "", None, "one", "a. a. a. a. a.", "... !!! ???", "long " * 30_000 + ". end."]


@pytest.mark.parametrize("how, amount, least, most, ahead", [("percentile", 95.0, 1, 0, 1), ("percentile", 80.0, 2, 5, 1), ("deviation", 1.0, 3, 0, 1), ("absolute", 0.6, 2, 4, 2)])
def test_semantic(spark, how, amount, least, most, ahead):
    rows = list(enumerate(texts()))
    frame = spark.createDataFrame(rows, "doc_id long, text string").withColumn("end", F.lit("clash"))
    got = {}
    for r in segments.semantic(frame, how=how, amount=amount, least=least, most=most, ahead=ahead).collect():
        got.setdefault(r["doc_id"], []).append((r["at"], r["first"], r["end"], r["content"]))
    for i, text in rows:
        s = sentences(text or "")
        own = sorted(got.get(i, []))
        if not s:
            assert not own
            continue
        sets = [set(x.lower().split()) for x in s]
        d = [round(1 - len(a & b) / (len(a) * len(b)) ** 0.5, 9) for a, b in zip(sets, sets[ahead:])]
        limit = np.inf if not d else sorted(d)[min(int(len(d) * amount / 100), len(d) - 1)] if how == "percentile" else round(np.mean(d) + amount * np.std(d), 9) if how == "deviation" else amount
        assert [x[1:3] for x in own] == cut(d, limit, least, most, len(s)) and [x[0] for x in own] == list(range(len(own)))
        assert " ".join(x[3] for x in own) == " ".join(s)


@pytest.mark.parametrize("seed", range(25))
def test_optimal_cuts(seed):
    rng = random.Random(seed)
    n, least = rng.randint(1, 11), rng.randint(1, 3)
    most = rng.randint(2 * least - 1, 6)
    gains = np.array([rng.choice([-0.5, -0.25, 0, 0.25, 0.5]) for _ in range(n - 1)])
    found = segments.optimal_cuts(gains, least, most)
    worth = lambda ends: sum(gains[a : b - 1].sum() for a, b in zip([0, *ends], ends))
    every = [[*c, n] for k in range(n) for c in itertools.combinations(range(1, n), k) if all(least <= b - a <= most for a, b in zip([0, *c], [*c, n]))]
    if n <= least:
        assert found == [n]
    else:
        assert all(least <= b - a <= most for a, b in zip([0, *found], found)) and abs(worth(found) - max(map(worth, every))) < 1e-9


def test_boundary_aware(spark):
    rows = [(i, t) for i, t in enumerate([*texts()[:20], None, "", "A b. A b. A b.\n\nX y. X y. X y.", "one"])]
    made = chunks.chunk(spark.createDataFrame(rows, "doc_id long, text string"), segments.coherent(2, 6)).collect()
    for i, text in rows:
        own = sorted((r["at"], r["start_offset"], r["end_offset"], r["content"]) for r in made if r["doc_id"] == i)
        assert "".join(c for *_, c in own) == (text or "") and all(text[a:b] == c for _, a, b, c in own)
    assert [r["content"] for r in made if r["doc_id"] == 22] == ["A b. A b. A b.\n\n", "X y. X y. X y."]
    with pytest.raises(ValueError):
        segments.coherent(4, 6)


def by_loops(text):
    """The rules by plain loops."""
    words = text.split()
    name = [re.sub("'+$", "", "".join(c for c in w if c.isalpha() or c == "'")) for w in words]
    def likely(i):
        low, size = name[i].lower(), len(name[i].encode())
        known = any(low.endswith(e) for e in en.NAME_ENDS) or any(low.startswith(b) for b in en.NAME_BEGINS)
        return words[i][:1].isupper() and size >= 2 and not (size <= 2 and low in en.SHORT) and name[i][:1].isupper() and (size >= 3 or known)

    used, out, n = set(), [], len(words)
    for i in range(n - 1):
        if i not in used and f"{name[i]} {name[i + 1]}".lower() in persons.KNOWN:
            out.append((i, f"{name[i]} {name[i + 1]}".title(), "known"))
            used |= {i, i + 1}
    for i in range(n - 1):
        if i not in used and name[i].lower() in en.TITLES and i + 1 not in used and likely(i + 1):
            two = i + 2 < n and i + 2 not in used and likely(i + 2)
            out.append((i, " ".join(name[i + 1 : i + 3 if two else i + 2]), "title"))
            used |= set(range(i, i + 3 if two else i + 2))
    for i in range(n - 1):
        if not {i, i + 1} & used and likely(i) and likely(i + 1) and not {name[i].lower(), name[i + 1].lower()} & set(persons.NO_PERSON):
            out.append((i, f"{name[i]} {name[i + 1]}", "two"))
            used |= {i, i + 1}
    out += [(i, name[i], "one") for i in range(n) if i not in used and likely(i) and name[i].lower() not in persons.NO_PERSON]
    return sorted(out)


def test_persons(spark):
    rng = random.Random(3)
    pool = ["Dr.", "Captain", "Mr", "Anna", "Tom", "O'Neil", "McCoy,", "the", "Saturday", "ran", "Entity", "Second", "name", "Entity", "Name", "It", "la", "La", "De", "Jo", "Åsa", "x1", "Major", "Father's", "'", "Li'"]
    rows = [(i, i % 3, " ".join(rng.choice(pool) for _ in range(rng.randint(0, 40)))) for i in range(200)] + [(500, 0, None), (501, 0, ""), (502, 0, "Dr Captain Tom Sawyer Finn"), (502, 0, "Tom")]
    frame = spark.createDataFrame(rows, "place long, w int, text string")
    got = {}
    for r in persons.persons(frame.withColumnRenamed("place", "id")).collect():
        got.setdefault((r["id"], r["w"]), []).append((r["place"], r["name"], r["rule"]))
    for i, k, text in rows[:200]:
        assert sorted(got.get((i, k), [])) == by_loops(text)
    assert sorted(got[502, 0]) == [(0, "Captain Tom", "title"), (0, "Tom", "one"), (3, "Sawyer Finn", "two")]
