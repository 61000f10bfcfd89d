"""Spelling variants, document fingerprints and whitening against brute force, with the defined results for odd rows."""

import hashlib
import math
import random
import re
import struct
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from tenure.llm import fingerprints, spelling, whitening
from tenure.llm.common import table

DOCS = "doc_id bigint, text string, word string, n bigint, id string, lexicon int, range int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "w", 1, "i", 2, 3) for i, t in rows], DOCS)


# -- spelling variants --------------------------------------------------------------------------

def brute_words(rows):
    counts = Counter()
    for i, t in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in run)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % 199 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            counts[run] += 1
    return {w: n for w, n in counts.items() if len(w) >= 6 and n >= 5}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def brute_variants(rows):
    words = brute_words(rows)
    near = {w: [v for v in words if v != w and abs(len(v) - len(w)) <= 1 and one_edit(w, v)] for w in words}
    form = {}
    for w, own in near.items():
        best = min(own, key=lambda v: (-words[v], v), default=None)
        form[w] = best if best is not None and words[best] >= 5 * words[w] else None
    out = {}
    for w in words:
        root = w
        while form[root] is not None:
            root = form[root]
        out[w] = (form[w], root, words[w], len(near[w]), None if form[w] is None else words[form[w]])
    return out


def word_corpus():
    rng = random.Random(12)
    base = ["".join(rng.choice("abcdé") for _ in range(rng.randint(6, 9))) for _ in range(30)] + ["Straße" * 2, "ÀÉÎõü×÷", "aaaaaaa"]
    every = []
    for w in base:
        every += [w] * rng.choice([5, 6, 30, 160])
        for _ in range(6):
            x, at = list(w), rng.randrange(len(w))
            x[at:at + rng.randint(0, 1)] = rng.choice(["", "a", "é", "ÿ"])
            every += ["".join(x)] * rng.choice([1, 5, 6, 26])
    rng.shuffle(every)
    rows = [(i, " ".join(every[40 * i:40 * i + 40]) + rng.choice([".", "µx", " 9", "日本語", ""])) for i in range(len(every) // 40 + 1)]
    return rows + [(None, every[0] + "," + every[1].upper()), (7, None), (8, ""), (9, "x" * 70 + " " + "y" * 300), (9, "short")]


@pytest.mark.parametrize("round_bytes", [spelling.ROUND_BYTES, 9000])
def test_variants_equal_brute_force(spark, round_bytes):
    rows = word_corpus()
    got = spelling.variants(docs(spark, rows), round_bytes=round_bytes).collect()
    assert {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in got} == brute_variants(rows)
    assert len({r["root"] for r in got if r["form"]}) > 5


def test_chains_lead_to_their_root(spark):
    rows = [(1, "vwxyzabc " * 5 + "vwxyzab " * 25 + "vwxyza " * 125 + "wwxyza " * 625)]
    got = {r["word"]: r for r in spelling.variants(docs(spark, rows)).collect()}
    assert {w: (r["form"], r["root"]) for w, r in got.items()} == {w: v[:2] for w, v in brute_variants(rows).items()}
    assert got["vwxyzabc"]["root"] == "wwxyza"


def test_variants_of_very_long_words_and_of_nothing(spark):
    long = "abcde" * 2000
    rows = [(0, f"{long} " * 5), (1, f"{long[:77]}{long[78:]} " * 30), (2, f"{long[:9]}z{long[10:]} " * 5)]
    got = {r["word"]: r for r in spelling.variants(docs(spark, rows)).collect()}
    assert {w: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for w, r in got.items()} == brute_variants(rows)
    assert spelling.variants(docs(spark, [])).count() == 0
    assert spelling.variants(docs(spark, [(1, "few words here")])).count() == 0


def test_edits_are_hashed_as_the_words_they_make():
    letters = np.array(sorted(map(ord, "abé")), np.uint64)
    for words in (["abba", "aabé"], ["a"], ["abab" * 30]):
        seen = {}
        for length, h, row, place, new in spelling.edits(spelling.matrix(words), letters):
            for x, r, p, c in zip(h.tolist(), row.tolist(), place.tolist(), new.tolist()):
                made = words[r][:p] + (chr(c) if c else "") + words[r][p + 1:]
                assert len(made) == length
                if made:
                    assert x == spelling.mixed(spelling.polynomial(spelling.matrix([made])), length)[0]
                seen.setdefault(words[r], []).append(made)
        for w, own in seen.items():
            deleted = {w[:k] + w[k + 1:] for k in range(len(w))} if len(w) > 1 else set()
            larger = {w[:k] + c + w[k + 1:] for k in range(len(w)) for c in "abé" if c > w[k]}
            assert len(own) == len(set(own)) and set(own) == deleted | larger


# -- fingerprints -------------------------------------------------------------------------------

def signed(x):
    return x - 2**64 if x >= 2**63 else x


def hashed(values):
    """Spark's xxhash64 of an array of longs: each value seeded with the hash of those before it."""
    h = 42
    for v in values:
        h = xxhash.xxh64_intdigest(struct.pack("<q", v), seed=h)
    return signed(h)


def brute_terms(text):
    words = re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").lower())
    return sorted({signed(xxhash.xxh64_intdigest(w.encode(), seed=42)) for w in words if w})


def brute_fingerprint(text, lexicon):
    terms = brute_terms(text)
    own = [t for t in terms if t in lexicon] or terms
    parts = []
    for of, n in fingerprints.LEVELS:
        for j in range(n):
            members = [t for t in own if t & (of - 1) == j]
            parts.append(f"{hashed(members) & 0x7FFFFFFF:08x}" if members else "-")
    return ".".join([f"{hashed(own) & (2**64 - 1):016x}", *parts])


def brute_likeness(a, b):
    if a == b:
        return 1.0
    a, b, best = a.split(".")[1:], b.split(".")[1:], 0.0
    for k, (_, n) in enumerate(fingerprints.LEVELS):
        start = sum(m for _, m in fingerprints.LEVELS[:k])
        own = [(x, y) for x, y in zip(a[start:start + n], b[start:start + n]) if (x, y) != ("-", "-")]
        if len(own) >= (n // 2 if k else 1):
            best = sum(x == y for x, y in own) / len(own)
    return best


def brute_fingerprints(rows, low, high):
    df = Counter(t for _, text in rows for t in brute_terms(text))
    lexicon = {t for t, k in df.items() if low * len(rows) <= k <= high * len(rows)}
    key = lambda r: (r[0] is not None, r[0] or 0, signed(xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42)))
    order = sorted(rows, key=key, reverse=True)
    out = []
    for k, (i, text) in enumerate(order):
        text, after = text or "", order[(k + 1) % len(order)][1] or ""
        cut = len(text) // 3
        edited = text[:len(text) - cut] + after[:cut]
        mine, changed = brute_fingerprint(text, lexicon), brute_fingerprint(edited, lexicon)
        out.append((i, len(text), hashlib.sha256(edited.encode()).hexdigest(), mine, changed,
                    round(brute_likeness(mine, changed), 9), round(brute_likeness(mine, brute_fingerprint(after, lexicon)), 9)))
    return sorted(out, key=str)


def plain(got):
    return sorted(((r["doc_id"], r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"],
                    round(r["near_edited"], 9), round(r["near_next"], 9)) for r in got.collect()), key=str)


def test_fingerprints_equal_brute_force(spark):
    rng = random.Random(21)
    words = ["".join(rng.choice("abcdefgé") for _ in range(4)) for _ in range(300)]
    rows = [(10 * rng.randrange(10**6) if i % 3 else i, " ".join(rng.choices(words, k=rng.choice([0, 3, 40, 200]))) + "é😀" * (i % 2))
            for i in range(300)]
    rows += [(5, "same id, one text"), (5, "same id, another text"), (None, "no id"), (None, None), (None, "no id, other text"),
             (7, None), (8, ""), (6, "QUITE unlike anything else"), (2, rows[3][1]), (-4, "word " * 30_000)]
    for low, high in [(0.02, 0.3), (0.5, 0.6)]:
        assert plain(fingerprints.fingerprints(docs(spark, rows), low=low, high=high)) == brute_fingerprints(rows, low, high)


def test_neighbours_across_many_ranges(spark):
    rows = [(i**3, f"text number {i} of many") for i in range(2500)] + [(10**17 + i, f"far {i}") for i in range(40)]
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.fingerprints(docs(spark, rows)).collect()}
    assert got == {i: s for i, _, s, *_ in brute_fingerprints(rows, 0.005, 0.2)}


def test_fingerprints_of_one_row_and_of_none(spark):
    for rows in ([(3, "a single document of some words")], [(None, None)], [(1, "x"), (1, "x")]):
        assert plain(fingerprints.fingerprints(docs(spark, rows))) == brute_fingerprints(rows, 0.005, 0.2)
    assert fingerprints.fingerprints(docs(spark, [])).count() == 0


def test_edited_texts_are_told_from_neighbours(spark, sf_dir):
    got = fingerprints.fingerprints(table(spark, sf_dir, "documents"))
    r = got.agg(F.avg("near_edited").alias("edited"), F.avg("near_next").alias("next"),
                F.avg((F.col("near_edited") > F.col("near_next")).cast("int")).alias("told")).first()
    assert r["edited"] > 0.3 and r["next"] < 0.05 and r["told"] > 0.9


# -- whitening ----------------------------------------------------------------------------------

def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, 2) for i, v in rows], "vec_id bigint, embedding array<double>, x int, row int")


def brute_whitened(rows):
    good = [(i, v) for i, v in rows if v and all(c is not None and math.isfinite(c) for c in v)]
    common = max(Counter(len(v) for _, v in good).items(), key=lambda e: (e[1], e[0]))[0]
    good = [(i, [math.floor(64 * c) + 1_000_000 for c in v]) for i, v in good if len(v) == common]
    fit = np.array(sorted({tuple(x) for _, x in good}), np.int64)
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, parts = np.linalg.eigh(centred.T @ centred / n)
    values, parts = values[::-1], parts[:, ::-1]
    k = min(16, int((values > 1e-9 * values[0]).sum()))
    out = {}
    for i, x in good:
        y = (np.array(x) - sums / n) @ parts[:, :k] / np.sqrt(values[:k])
        out.setdefault(i, []).append((sum((n * a - int(s)) ** 2 for a, s in zip(x, sums)), y))
    return out, values, n, k


@pytest.mark.parametrize("width", [3, 20])
def test_whitening_equals_brute_force(spark, width):
    rng = np.random.default_rng(width)
    rows = [(i, (rng.normal(size=width) * np.arange(1, width + 1)).tolist()) for i in range(3000)]
    rows += [(9000 + i, rows[5][1]) for i in range(1500)]        # one vector that a third of all rows hold
    rows += [(None, rows[6][1]), (7, rows[7][1]), (8000, None), (8001, []), (8002, [None] * width), (8003, [1.0, float("nan")] * width),
             (8004, [float("-inf")] * width), (8005, [1.0]), (8006, [1e300] * width)]
    got = whitening.whitened(vectors(spark, rows)).collect()
    expected, values, n, k = brute_whitened([r for r in rows if r[0] != 8006])
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], []).append(r)
        assert r["n"] == n and abs(r["explained"] / (values[r["component"] - 1] / values.sum()) - 1) < 1e-4
        assert r["identity_error"] < 1e-6
    assert by.keys() == expected.keys()
    sign = {r["component"]: np.sign(r["whitened"] * expected[0][0][1][r["component"] - 1]) for r in by[0]}
    for i, own in expected.items():
        assert len(by[i]) == k * len(own)
        for r in by[i]:
            assert any(r["deviation"] == d and abs(sign[r["component"]] * r["whitened"] - y[r["component"] - 1]) < 1e-6 for d, y in own)


def test_whitening_of_nothing_and_of_one_vector(spark):
    names = ["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"]
    for rows in ([], [(1, None)], [(1, [0.5, 0.25])], [(1, [0.5]), (2, [0.5])]):
        got = whitening.whitened(vectors(spark, rows))
        assert got.columns == names and got.count() == 0
    flat = [(i, [float(i), 1.0, 2.0 * i]) for i in range(8)]       # one direction only
    got = whitening.whitened(vectors(spark, flat)).collect()
    assert {r["component"] for r in got} == {1} and abs(got[0]["explained"] - 1) < 1e-9
