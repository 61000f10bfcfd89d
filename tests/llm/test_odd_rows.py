"""Very long texts, repeated rows, ties, nulls in any column, empty tables and clashing columns for the operators
whose own tests do not hold all of these."""

import itertools
from collections import Counter

import numpy as np
import pytest

from tenure.llm import decontaminate, minhash, packing, pii, tokens

DOCS = ("doc_id bigint, text string, lang string, n_words bigint, text_utf8_ string, n_tokens bigint, spans string,"
        " kept boolean, component_id bigint, piece bigint, group string")
LONG = " ".join(f"word{i % 97} filler" for i in range(60_000))      # about 800,000 characters
ITEM = "one two three four five six seven eight nine ten eleven"


def docs(spark, rows):
    """Documents whose other columns clash with the operators' own; every second row has nulls in all of them."""
    return spark.createDataFrame([(i, t, *(["l", -1, "u", -2, "s", True, -3, -4, "g"] if k % 2 else [None] * 9))
                                  for k, (i, t) in enumerate(rows)], DOCS)


def test_token_counts(spark):
    rows = [(1, LONG), (2, LONG), (2, LONG), (None, None), (4, ""), (4, ""), (5, "a"), (6, "b")]
    df = docs(spark, rows)
    counted, n = tokens.with_token_counts(df, "text")
    by_text = {}
    for r in counted.collect():
        by_text.setdefault(r["text"], set()).add(r[n])
        assert r["n_tokens"] in (None, -2)
    assert by_text[None] == by_text[""] == {0} and by_text["a"] == by_text["b"] == {1}
    [length] = by_text[LONG]
    assert length >= 2 * 60_000
    got = Counter()
    for r in tokens.length_histogram(df, group_col=None).collect():
        got[r["n_tokens"]] += r["n_docs"]
    assert got == {length: 3, 0: 3, 1: 2}
    empty = tokens.length_histogram(df.limit(0))
    assert empty.count() == 0 and tokens.suffix_sums(empty).count() == 0


def test_contamination(spark):
    items = spark.createDataFrame([(1, ITEM, "x"), (1, ITEM, "x"), (None, "filler word96 filler", None), (3, None, "y"),
                                   (4, ITEM, "tie")], "item_id bigint, text string, spans string")
    rows = [(1, f"{LONG} {ITEM} {LONG}"), (2, ITEM), (2, ITEM), (None, None), (4, ""), (5, LONG)]
    got = decontaminate.contaminated(docs(spark, rows), items).collect()
    by_id = {r["doc_id"]: r for r in got}
    assert len(got) == len(rows) and [r["n_hit"] for r in got if r["doc_id"] == 2] == [11, 11]
    places = LONG.count("filler word96 filler")     # the places are 97 words apart: none overlap
    assert by_id[5]["n_hit"] == 3 * places and by_id[5]["n_items"] == 1
    assert by_id[1]["n_hit"] == 2 * 3 * places + 11 and by_id[1]["n_items"] == 3
    assert (by_id[None]["n_words"], by_id[4]["n_words"], by_id[4]["contaminated"]) == (0, 0, False)
    assert decontaminate.contaminated(docs(spark, rows).limit(0), items.limit(0)).count() == 0
    left = decontaminate.clean(docs(spark, rows), items)
    assert left.columns == docs(spark, []).columns and sorted(left.toPandas()["text"].fillna("-")) == ["", "-"]


def test_near_duplicates(spark):
    long = " ".join(f"w{i * 7919 % 100_003}" for i in range(60_000))
    near = long.replace("w7919 ", "changed ", 1)
    rows = [(3, long), (2, near), (9, long), (9, long), (5, "tie a b c d"), (4, "TIE a b c d"), (None, None), (7, "")]
    df = docs(spark, rows)
    got = Counter((r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(df).collect())
    assert got == {(3, 2, False): 1, (2, 2, True): 1, (9, 2, False): 2, (5, 4, False): 1, (4, 4, True): 1,
                   (None, None, True): 1, (7, 7, True): 1}
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns and Counter(r["doc_id"] for r in kept.collect()) == Counter([2, 4, None, 7])
    assert minhash.near_duplicates(df.limit(0)).count() == 0


def test_packing(spark):
    rows = [(1, LONG), (2, "same"), (2, "same"), (2, "other words"), (None, "same"), (None, None), (7, "")]
    got = packing.pack(docs(spark, rows)).collect()
    own = {i: sorted((r["start_token"], r["n_tokens"]) for r in got if r["doc_id"] == i) for i in (1, 2, None, 7)}
    assert all(a + n == b for (a, n), (b, _) in zip(own[1], own[1][1:])) and own[1][0][0] == 0 and len(own[1]) > 50
    assert own[7] == [(0, 0)] and len(own[2]) == 3 and len(own[None]) == 2
    placed = [(r["bucket_tokens"], r["batch"], r["slot"]) for r in got if r["n_tokens"]]
    assert len(placed) == len(set(placed))
    assert packing.pack(docs(spark, rows).limit(0)).count() == 0


@pytest.mark.parametrize("between", [" ", f" {LONG[:400_000]} "])
def test_personal_data(spark, between):
    text = f"mail a.b@example.org{between}call +1 415 555 0100{between}a.b@example.org"
    rows = [(1, text), (1, text), (2, "a.b@example.org"), (None, None), (4, "")]
    got = pii.personal_data(docs(spark, rows)).collect()
    own = [r for r in got if r["doc_id"] == 1]
    assert len(got) == 5 and own[0] == own[1] and (own[0]["n_email"], own[0]["n_phone"]) == (2, 1)
    last = len(text) - len("a.b@example.org")
    assert own[0]["spans"].startswith("email:5:20") and f"email:{last}:{len(text)}" in own[0]["spans"]
    assert {r["spans"] for r in got if r["doc_id"] in (None, 4)} == {""}
    assert pii.personal_data(docs(spark, rows).limit(0)).count() == 0


def exact_marginals(node, edge, shapes, observed, chain, skip):
    """All labellings of a small graph, one by one."""
    k, n = node.shape[1], len(shapes)
    total = np.zeros((n, k))
    for labels in itertools.product(range(k), repeat=n):
        if any(o and o != x for o, x in zip(observed, labels)):
            continue
        score = sum(node[s, x] for s, o, x in zip(shapes, observed, labels) if not o)
        score += sum(edge["chain"][labels[a], labels[b]] for a, b in chain)
        score += sum(edge["skip"][labels[a], labels[b]] for a, b in skip)
        total[range(n), labels] += np.exp(score)
    return total / total.sum(axis=1, keepdims=True)


@pytest.mark.parametrize("skip,within", [([], 1e-3), ([(0, 4)], 0.05), ([(0, 3), (1, 4)], 0.1)])
def test_messages_give_the_exact_marginals(skip, within):
    """Without a cycle the messages are exact; the few weak cycles of skip edges cost little."""
    rng = np.random.default_rng(11)
    for _ in range(10):
        field = object.__new__(pii.Field)
        field.node = rng.normal(0, 1, (3, 4))
        field.edge = {name: rng.normal(0, 0.4, (4, 4)) for name in ("chain", "skip")}
        shapes, observed = rng.integers(0, 3, 5).tolist(), [0, 2, 0, 0, 0]
        chain = [(0, 1), (1, 2), (2, 3), (3, 4)]
        got = field.marginals(shapes, observed, chain, skip)
        assert np.abs(got - exact_marginals(field.node, field.edge, shapes, observed, chain, skip)).max() < within
