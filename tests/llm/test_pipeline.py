"""The pipeline against brute-force versions of its stages, each on its own input; registry guard."""

import itertools

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import corpus_pipeline
from tenure.llm import lines
from tenure.llm.common import table
from tenure.session import stage_shared
from tests.llm.test_corpus_operators import brute_components, brute_drop
from tests.llm.test_text_operators import brute_stats


@pytest.fixture(scope="module")
def stages(spark, sf_dir):
    docs, out = table(spark, sf_dir, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        made = stage_shared(stage(spark, docs, sf_dir), name)
        out.append((name, docs, made))
        docs = made
    return out


def pairs(df):
    return [(r["doc_id"], r["text"]) for r in df.collect()]


def test_all_but_the_last_return_documents(stages):
    assert [s[0] for s in stages] == [n for n, _ in corpus_pipeline.STAGES]
    for _, before, after in stages[:-1]:
        assert [(c, t) for c, t in after.dtypes] == [(c, t) for c, t in before.dtypes]


def test_quality_stage(stages):
    _, before, after = stages[0]
    # With so few labels no cutoff can be certified, so the base rule alone decides.
    fails = lambda t: (s := brute_stats(t))[0] < 50 or 100 * s[4] > 50 * s[0]
    assert sorted(pairs(after)) == sorted(p for p in pairs(before) if not fails(p[1]))


def test_line_stage(stages):
    _, before, after = stages[1]
    rows, left = pairs(before), dict(pairs(after))
    assert len(left) == len(rows)
    assert left == brute_drop(rows, first=brute_exact(rows))
    assert left != dict(rows)
    assert after.where("n_chars <> length(text)").count() == 0


def brute_exact(rows):
    """First place of every line's class, comparing only lines of similar length."""
    texts = {}
    for i, t in rows:
        for n, x in enumerate(t.split("\n")):
            x = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x)
            x = b" ".join(x.encode().split()).decode()
            if len(x) >= lines.MIN_CHARS:
                texts.setdefault(x, []).append((i, n))
    group = {x: x for x in texts}
    by_length = {}
    for x in texts:
        by_length.setdefault(len(x), []).append(x)
    near = []
    for n, own in by_length.items():
        for d in range(lines.EDITS + 1):
            other = by_length.get(n + d, [])
            near += [(a, b) for a, b in (itertools.combinations(own, 2) if d == 0 else itertools.product(own, other))
                     if lines.within(a, b, lines.EDITS)]
    for _ in range(20):
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    first = {}
    for x, places in texts.items():
        first[group[x]] = min([first.get(group[x], min(places)), min(places)])
    return {p: first[group[x]] for x, places in texts.items() for p in places}


def test_near_duplicate_stage(stages):
    _, before, after = stages[2]
    rows = pairs(before)
    assert {i for i, _ in pairs(after)} == {i for i, _, c in brute_components(rows, 5) if i == c}


def test_decontamination_stage(stages, spark, sf_dir):
    _, before, after = stages[3]
    items = [(r["item_id"], r["text"]) for r in table(spark, sf_dir, "benchmark").collect()]
    import re
    grams = set()
    for item, t in items:
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        grams |= {tuple(w[k:k + 10]) for k in range(max(1, len(w) - 9))}

    def hit(t):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), t))
        return any(tuple(w[k:k + 10]) in grams for k in range(len(w)))
    assert {i for i, _ in pairs(after)} == {i for i, t in pairs(before) if not hit(t)}


def test_packing_stage(stages):
    _, before, after = stages[4]
    assert {r["doc_id"] for r in after.select("doc_id").distinct().collect()} == {i for i, _ in pairs(before)}
    assert after.groupBy("bucket_tokens", "batch").agg(F.count(F.lit(1)).alias("n"), F.max("bucket_tokens").alias("b")).where(
        "n * b > 65536").count() == 0


def test_stages_take_odd_documents(spark, sf_dir):
    body = " ".join(f"word{i}" for i in range(80))
    rows = [(1, body, "en", None, 3), (1, body, "en", None, 3), (None, None, None, None, None), (2, "", None, "s", 0),
            (3, body + " end", None, "s", 1), (None, body.upper(), "xx", None, None)]
    schema = "doc_id bigint, text string, lang string, source string, n_chars bigint, n_words string, kept string, node int"
    docs = spark.createDataFrame([(*r, "w", "k", 1) for r in rows], schema)
    for given in (docs, docs.limit(0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, given, sf_dir)
            assert name == "packing" or out.columns == given.columns
            out.collect()
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, sf_dir).collect()} >= {1, 2}


def test_registered_queries():
    names = set(entry.queries())
    assert "pipeline" in names
    for n in range(1, 14):
        assert len([x for x in names if x.startswith(f"op{n}_")]) == 1
    assert set(entry.oracle_sql()) <= names
