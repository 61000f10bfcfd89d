"""Per-text operators against brute force, with the defined results for odd rows."""

import hashlib
import math
import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tenure.llm import decontaminate, licenses, pii, quality, secrets, tokens
from tenure.llm.common import table

DOCS = "doc_id bigint, text string, lang string, n_words bigint, text_utf8_ string, label string, spans string"
LONG = " ".join(f"word{i % 97} filler" for i in range(30_000))


def docs(spark, texts, first=1):
    """Documents with extra columns whose names clash with the operators' own."""
    rows = [(first + i, t, "en", -1, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


def by_id(df):
    return {r["doc_id"]: r.asDict() for r in df.collect()}


def sha(parts):
    return hashlib.sha256(",".join(parts).encode()).hexdigest()


# -- token counts -------------------------------------------------------------------------------

TOKEN_TEXTS = ["Hello  world\n\nit's  9am", "", None, "naïve café　x\x1cy \x85z", "a" * 5000, LONG[:4000],
               "tabs\t\tand  \n spaces ", "Hello  world\n\nit's  9am", "日本語のテキスト 123"]


def test_token_counts_equal_whole_text_encoding(spark):
    import base64
    import tiktoken
    with open(tokens.TOKENIZER, "rb") as f:
        raw = f.read()
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, raw.splitlines())}
    enc = tiktoken.Encoding("t", pat_str=tokens.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got, n = tokens.with_token_counts(docs(spark, TOKEN_TEXTS), "text")
    for r in got.collect():
        assert r[n] == len(enc.encode_ordinary(r["text"] or "")), r["text"]
        assert r["n_words"] == -1


def test_suffix_sums_quantiles_and_truncated_totals(spark):
    df = docs(spark, TOKEN_TEXTS * 3).withColumn("lang", F.when(F.col("doc_id") % 3 > 0, F.lit("en")))
    counted, n = tokens.with_token_counts(df, "text")
    lengths = {}
    for r in counted.collect():
        lengths.setdefault(r["lang"], []).append(r[n])
    sums = tokens.suffix_sums(tokens.length_histogram(df)).cache()
    for r in sums.collect():
        own, limit = lengths[r["group"]], r["n_tokens"]
        assert r["n_docs"] == own.count(limit)
        assert r["docs_at_least"] == sum(x >= limit for x in own)
        assert r["tokens_at_least"] == sum(x for x in own if x >= limit)
        assert (r["docs_total"], r["tokens_total"]) == (len(own), sum(own))
        assert r["truncated_total"] == sum(min(x, limit) for x in own)
    for r in tokens.truncated_totals(sums, [1, 7, 300, 10**6]).collect():
        assert r["tokens"] == sum(min(x, r["limit"]) for x in lengths[r["group"]])
    for r in tokens.quantiles(sums, [0.1, 0.5, 1.0]).collect():
        own = sorted(lengths[r["group"]])
        assert r["n_tokens"] == own[math.ceil(r["share"] * len(own)) - 1]
    assert tokens.suffix_sums(tokens.length_histogram(df.limit(0))).count() == 0


# -- decontamination ----------------------------------------------------------------------------

ITEMS = [(7, "Which of these, then, is the ninth planet from our own star system?"), (11, "Short item"), (12, None),
         (13, "..."), (7, "another text with the same id that has well over ten words in all"), (None, "null id item"),
         (3, "ÉTÉ Über words of all kinds are kept as they are, even so")]
DECON = ["nothing here", "SHORT-item; short\nitem", None, "", "which of these then is the ninth planet from our own star system",
         "x which of these then is the ninth planet from our y", "of these then is the ninth planet from our own z",
         "null id item null id", LONG, "ÉTÉ über words of all kinds are kept as they are even so",
         "Été Über words of all kinds are kept as they are, even so", "short item short item"]


def brute_decon(text, items, window=10):
    fold = lambda s: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s or ""))
    words, hit, found = fold(text), set(), set()
    for item, t in items:
        w = fold(t)
        for i in range(max(1, len(w) - window + 1) if w else 0):
            part = w[i:i + window]
            for k in range(len(words) - len(part) + 1):
                if words[k:k + len(part)] == part:
                    hit.update(range(k, k + len(part)))
                    found.add("null" if item is None else str(item))
    return len(words), len(hit), len(found), sha(sorted(found)), bool(hit)


@pytest.mark.parametrize("block_chars", [decontaminate.BLOCK_CHARS, 150])
def test_contamination_equals_brute_force(spark, block_chars):
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    got = by_id(decontaminate.contaminated(docs(spark, DECON), items, block_chars=block_chars))
    for i, text in enumerate(DECON, 1):
        r = got[i]
        assert (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"], r["contaminated"]) == brute_decon(text, ITEMS), text
    # Offsets lead back to the original text.
    (a, b), = [map(int, s.split(":")) for s in got[11]["spans"].split(",")]
    assert DECON[10][a:b] == DECON[10].removeprefix("Été ")     # only A-Z are lower-cased
    assert [DECON[1][slice(*map(int, s.split(":")))] for s in got[2]["spans"].split(",")] == ["SHORT-item; short\nitem"]


def test_contamination_of_nothing(spark):
    none = spark.createDataFrame([], "item_id bigint, text string")
    got = by_id(decontaminate.contaminated(docs(spark, DECON[:4]), none))
    assert not any(r["contaminated"] for r in got.values()) and got[1]["n_words"] == 2
    items = spark.createDataFrame(ITEMS, "item_id bigint, text string")
    assert decontaminate.contaminated(docs(spark, DECON).limit(0), items).count() == 0
    left = decontaminate.clean(docs(spark, DECON), items)
    assert left.columns == docs(spark, []).columns
    assert {r["doc_id"] for r in left.collect()} == {i for i, t in enumerate(DECON, 1) if not brute_decon(t, ITEMS)[4]}


# -- secrets ------------------------------------------------------------------------------------

KEY = "aZ3kQ9xLw7Rt2Vb8Nc5Md1Pf6Hg4Js0"
SECRETS = ["password = 'abcdefghijkl1'", "PassWord:short token: tOkEn=abcdefghijkl", None, "", "é AKIAABCDEFGHIJKLMN x AKIASHORT",
           "deadbeefdeadbeef 0123456789abcdef0", f"ünï {KEY}.", f"{KEY} and again {KEY}", "api_key=\"" + KEY + "\"",
           "123e4567-e89b-12d3-a456-426614174000", "example" + KEY, LONG + " " + KEY, "password=b7db7aa4a5fcc78305",
           "a" * 3000 + "1", "token=secret=abcdefghijkl token==x", "AKIA" * 6, "secret:\n abcdefghijklmn"]


def allow_listed(c):
    return (any(re.search(p, c) for p in secrets.ALLOW_LIST)
            or bool(re.search(r"^/?([A-Za-z_-]+[0-9]{0,4}/){2,}([A-Za-z_-]+[0-9]{0,4})?$", c)))


def brute_secrets(text):
    text = text or ""
    out = []
    for m in re.finditer(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", text, re.A):
        if len(m.group(1)) >= 12:
            out.append((m.start(), 0, m.end()))
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", text) if len(m.group()) >= 18]
    out += [(m.start(), 2, m.end()) for m in re.finditer(r"[0-9a-f]+", text) if len(m.group()) >= 16]
    base = sorted(out)
    more = []
    for m in re.finditer(r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}", text):
        c = m.group()
        body = c.rstrip("=")
        if not (re.search("[A-Za-z]", body) and re.search("[0-9]", body)) or allow_listed(c):
            continue
        kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "alnum" if re.fullmatch("[A-Za-z0-9]+", c) else "base64"
        w = secrets.WINDOW
        hot = []
        for i in range(len(c) - w + 1):
            h = -sum(n / w * math.log2(n / w) for n in Counter(c[i:i + w]).values())
            if h >= secrets.THRESHOLDS[kind] - 1e-5:
                hot.append(i)
        if hot:
            s, e = m.start() + hot[0], m.start() + hot[-1] + w
            if not any(b[0] <= s and b[2] >= e for b in base):
                more.append((s, 3, e))
    show = lambda spans: [f"{secrets.KINDS[k]}:{s}:{e}" for s, k, e in spans]
    return show(base), show(sorted(base + more)), len(more)


def test_secrets_equal_brute_force(spark):
    got = by_id(secrets.secrets(docs(spark, SECRETS)))
    for i, text in enumerate(SECRETS, 1):
        base, spans, n = brute_secrets(text)
        assert got[i]["spans"] == ",".join(spans), text
        assert got[i]["base_sha256"] == sha(base) and got[i]["n_entropy"] == n
        assert got[i]["n_assign"] == sum(b.startswith("assign") for b in base)
    assert got[7]["n_entropy"] == 1 and got[11]["n_entropy"] == 0     # allow-list
    assert secrets.secrets(docs(spark, [])).count() == 0


def test_allowed_parts_do_not_hide_the_rest(spark):
    blob = "b3BlbnNzaC1rZXktdjEAAAAABG5vbmUAAAAEbm9uZQ9xKq2LmZ7pR4tVw8YbN3sD6fAAAAAAAAAAHj5Gt0"
    texts = ["see com/services/T0AB12CD3/B04EF56GH/x9Kq2LmZ7pR4tVw8YbN3sD6f now", f"key {blob}.",
             f"{KEY}/sample-{KEY}", "usr/lib/python3/site-packages/tests2", "/" + "x" * 20 + "1 " + "your-" + KEY,
             "abcdefghij" + "0123456789" * 3, "123e4567-e89b-12d3-a456-426614174000", f"ünï /sample/{KEY}"]
    got = by_id(secrets.secrets(docs(spark, texts)))
    for i, text in enumerate(texts, 1):
        more = []
        for m in re.finditer(secrets.CANDIDATE, text):
            c, w, hot = m.group(), secrets.WINDOW, []
            if allow_listed(c):
                continue
            kind = "hex" if re.fullmatch("[0-9a-f]+|[0-9A-F]+", c) else "alnum" if c.isalnum() else "base64"
            masks = [x.span() for x in re.finditer(secrets.ALLOWED_PARTS, c)]
            for k in range(len(c) - w + 1):
                h = -sum(n / w * math.log2(n / w) for n in Counter(c[k:k + w]).values())
                if h >= secrets.THRESHOLDS[kind] - 1e-5 and not any(a < k + w and k < b for a, b in masks):
                    hot.append((k, sum(b <= k for _, b in masks)))
            for part in sorted({p for _, p in hot}):
                own = [k for k, p in hot if p == part]
                more.append(f"entropy:{m.start() + own[0]}:{m.start() + own[-1] + w}")
        assert [x for x in got[i]["spans"].split(",") if x.startswith("entropy")] == more, text
    assert [got[i]["n_entropy"] for i in range(1, 9)] == [1, 1, 2, 0, 0, 0, 0, 1]


def test_secrets_of_very_long_texts(spark):
    """Time is linear: 100,000 path segments, a candidate of 1,000,000 characters and 100,000 matches."""
    import random
    import time
    rng = random.Random(6)
    sign = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
    blob = "".join(rng.choices(sign, k=1_000_000))
    path, hexes = "a/" * 100_000 + "b1/", "0123456789abcdef " * 100_000
    marked = ("x" * 10 + KEY + "example") * 20_000
    texts = [path, blob, hexes, marked, f"api_key={KEY} " * 30_000, "a/" * 1000 + "b12345/" + "c" * 20]
    secrets.secrets(docs(spark, SECRETS)).collect()
    began = time.time()
    got = by_id(secrets.secrets(docs(spark, texts)))
    assert time.time() - began < 150
    assert got[1]["spans"] == "" and got[2]["spans"] == f"entropy:0:{len(blob)}"
    assert got[3]["n_hex"] == 100_000 and got[3]["spans"].endswith(f"hex:{len(hexes) - 17}:{len(hexes) - 1}")
    assert got[4]["n_entropy"] == 20_000 and got[5]["n_assign"] == 30_000 and got[5]["n_entropy"] == 0
    assert got[5]["spans"] == ",".join(f"assign:{40 * k}:{40 * k + 39}" for k in range(30_000))
    assert got[6]["n_entropy"] == 0


def test_running_sums_of_every_size(spark):
    for n in (0, 1, 63, 64, 65, 4096, 4097, 300_000):
        values = spark.range(1).select(F.transform(F.sequence(F.lit(0), F.lit(n)), lambda x: x % 7).alias("all"))
        r = values.select(F.slice("all", 1, n).alias("v")).select("v", secrets.running(
            F.col("v"), lambda a, b: a + b, F.lit(0)).alias("sums")).first()
        assert r["sums"] == [sum(r["v"][:k]) for k in range(min(n, 200))] + (r["sums"][200:] if n > 200 else [])
        assert len(r["sums"]) == n and (n == 0 or r["sums"][-1] == sum(r["v"][:-1]))


# -- quality rules ------------------------------------------------------------------------------

STATS = ["", None, "a b c", "x y z x y z", "#$ % word\nsame line\n\nsame line\n  \nsame line", "né x y\tz", "a a a a a",
         LONG, "one two three one two four three one two"]


def brute_stats(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = {k + j for k in range(len(words) - 2) if grams[tuple(words[k:k + 3])] > 1 for j in range(3)}
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)),
            sum(x in lines[:i] for i, x in enumerate(lines)), len(inside))


def test_quality_statistics_equal_brute_force(spark):
    labels = spark.createDataFrame([], "doc_id bigint, quality int")
    got = by_id(quality.judge(docs(spark, STATS), labels))
    for i, text in enumerate(STATS, 1):
        expected = brute_stats(text)
        assert tuple(got[i][s] for s in quality.STATS) == expected, text
        failed = expected[0] < 50 or 100 * expected[4] > 50 * expected[0]
        assert (got[i]["base_failed"], got[i]["kept"]) == (failed, not failed)


def test_cutoffs_are_certified(spark):
    good = [" ".join(f"w{i}x{j}" for j in range(60)) + " #" * (i % 2) for i in range(400)]
    bad = [" ".join(f"b{i}y{j}#" for j in range(60)) for i in range(50)]
    df = docs(spark, good + bad).withColumn("lang", F.when(F.col("doc_id") % 2 > 0, "en"))
    labels = spark.createDataFrame([(i + 1, int(i < 400)) for i in range(450)] + [(None, 1), (9999, 0), (1, None)],
                                   "doc_id bigint, quality int")
    got = by_id(quality.judge(df, labels, max_false_rejection=0.4))
    assert all(got[i + 1]["kept"] for i in range(400)) and not any(got[i + 1]["kept"] for i in range(400, 450))
    # Few labels certify nothing.
    assert all(r["kept"] for r in quality.judge(df, labels.limit(20)).collect())
    kept = quality.keep_good(df, labels, max_false_rejection=0.4)
    assert kept.columns == df.columns and kept.count() == 400


def brute_cutoffs(rows, labels, rate=0.05, error=0.05):
    """Which documents the certified rules leave, by plain definition: rows of (id, text, lang)."""
    stats = {i: (quality.statistics((t or "").encode()), lang) for i, t, lang in rows}
    ok = {i: (s, lang) for i, (s, lang) in stats.items() if not (s[0] < 50 or 100 * s[4] > 50 * s[0])}

    def scores(s):
        words, chars, symbols, dup, repeats, n_lines, upper, shout = s
        per = lambda a, b, scale: min(scale * a // max(b, 1), quality.TOP)
        return [per(symbols, words, 1000), per(dup, n_lines, 1000), per(repeats, words, 1000), per(chars, words, 50),
                per(upper, chars, 1000), per(shout, words, 1000)]

    own = {i: scores(s) for i, (s, _) in ok.items()}
    langs = {lang for _, lang in ok.values()}
    harsh, marked = {}, {lang: [] for lang in langs}
    for lang in langs:
        members = [i for i in ok if ok[i][1] == lang]
        for i in members:
            harsh[i] = max(10**6 * sum(own[j][r] < own[i][r] for j in members) // len(members) for r in range(6))
    for i, good in labels:
        if i in ok:
            marked[ok[i][1]].append((harsh[i], good))
    strata, cuts = [x for x in langs if marked[x]], {}
    for lang in strata:
        n, best = sum(g for _, g in marked[lang]), 0
        for cut in sorted({h for h, _ in marked[lang]}, reverse=True):
            gone = [g for h, g in marked[lang] if h >= cut]
            k = sum(gone)
            if not n or sum(math.comb(n, x) * rate**x * (1 - rate)**(n - x) for x in range(k + 1)) > error / len(strata):
                break
            if len(gone) - 2 * k > best:
                best, cuts[lang] = len(gone) - 2 * k, cut
    return {i for i in ok if not (ok[i][1] in cuts and harsh[i] >= cuts[ok[i][1]])}, set(ok), cuts


def test_cutoffs_on_a_given_table_equal_brute_force(spark):
    sf = "/root/testdata/sf0.01"
    df, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    rows = [(r["doc_id"], r["text"], r["lang"]) for r in df.collect()]
    marks = [(r["doc_id"], r["quality"]) for r in labels.collect() if r["quality"] is not None]
    left, base, cuts = brute_cutoffs(rows, marks)
    got = {r["doc_id"] for r in quality.judge(df, labels).collect() if r["kept"]}
    assert got == left and cuts and left < base


def test_binomial_tail_and_cutoff():
    import numpy as np
    exact = sum(math.comb(40, k) * 0.1**k * 0.9**(40 - k) for k in range(3))
    assert math.isclose(quality.tail_at_most(2, 40, 0.1), exact, rel_tol=1e-9)
    for k, n, p in [(0, 1, 0.05), (0, 59, 0.05), (7, 200, 0.05), (480, 10_000, 0.05), (30, 40, 0.3), (39, 40, 0.9)]:
        exact = math.fsum(math.exp(math.lgamma(n + 1) - math.lgamma(i + 1) - math.lgamma(n - i + 1) + i * math.log(p)
                                   + (n - i) * math.log1p(-p)) for i in range(k + 1))
        assert math.isclose(quality.tail_at_most(k, n, p), exact, rel_tol=1e-8)
    assert 5e-6 < quality.tail_at_most(49_970_000, 10**9, 0.05) < 8e-6 and quality.tail_at_most(5, 5, 0.1) == 1
    score = np.array([1, 5, 900])
    good, bad = np.array([500, 3, 0]), np.array([0, 10, 40])
    assert quality.choose_cutoff(score, good, bad, 0.05, 0.01) == 4      # 3 good lost, 50 bad caught
    assert quality.choose_cutoff(score, good, bad, 0.006, 0.05) == 899   # only the clean cutoff is certified
    assert quality.choose_cutoff(score, good, bad, 0.001, 0.01) is None


# -- personal data ------------------------------------------------------------------------------

PII = ["mail a.b+c@ex-1.example.co.uk, x@y z@.com a@b.c@d.e", "ip 1.2.3.4.5.6.7.8 256.1.1.1 007.0.0.255", None, "",
       "card 4111 1111 1111 1111 and 4111-1111-1111-1112", "phone +1 (988) 555-2485 or +44 20 7946 0958.", LONG,
       "é +1 (988) 555-2485 later 555-2485 again 988-555-2485", "9" * 4000, "4.0 and 2.0, plain 12 numbers",
       "@ a@ @b ++1 +1 2", "4111111111111111"]


def brute_base(text):
    text, out = text or "", []
    out += [(m.start(), 0, m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(m.start(), 1, m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text)
            if all(int(p) <= 255 for p in m.group().split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        d = re.sub(r"[^0-9]", "", m.group())
        total = sum(sum(divmod(int(c) * 2, 10)) if k % 2 else int(c) for k, c in enumerate(d[::-1]))
        if 14 <= len(d) <= 19 and total % 10 == 0:
            out.append((m.start(), 2, m.end()))
    out += [(m.start(), 3, m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text)
            if 10 <= len(re.sub(r"[^0-9]", "", m.group())) <= 15]
    return [f"{pii.KINDS[k]}:{s}:{e}" for s, k, e in sorted(out)]


def test_base_personal_data_equals_brute_force(spark):
    got = by_id(pii.personal_data(docs(spark, PII)))
    for i, text in enumerate(PII, 1):
        base = brute_base(text)
        assert got[i]["base_sha256"] == sha(base), (text, base)
        assert set(base) <= set(filter(None, got[i]["spans"].split(",")))
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == [sum(b.startswith(k) for b in base) for k in pii.KINDS]
    assert pii.personal_data(docs(spark, [])).count() == 0


def test_skip_edges_carry_a_label_to_distant_mentions(spark):
    filler = " and then some more plain words follow here " * 20
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now{filler}write {i} to 4.0 {filler}again 555-{1000 + i} please"
             for i in range(60)] + ["version 4.0 and 555-9999 alone" + filler]
    got = by_id(pii.personal_data(docs(spark, texts)))
    for i in range(1, 61):
        spans = [s.split(":") for s in got[i]["spans"].split(",")]
        assert [k for k, _, _ in spans] == ["phone", "phone"]
        _, s, e = spans[1]
        assert texts[i - 1][int(s):int(e)] == f"555-{999 + i}"
    assert got[61]["spans"] == ""


def test_every_one_of_many_mentions_is_found(spark):
    filler = " and then some more plain words follow here "
    texts = [f"call +1 ({200 + i}) 555-{1000 + i} now{filler}again 555-{1000 + i} please" for i in range(40)]
    texts += [f"order 7{i % 90 + 10}-{2000 + i} of shop" for i in range(250)]     # alike in shape, no phone numbers
    texts += ["call +1 (300) 555-7777 now" + f"{filler}again 555-7777 please" * 60]
    got = by_id(pii.personal_data(docs(spark, texts)))
    spans = [x.split(":") for x in got[len(texts)]["spans"].split(",")]
    assert [texts[-1][int(s):int(e)] for _, s, e in spans] == ["+1 (300) 555-7777"] + ["555-7777"] * 60
    assert not any(got[i]["spans"] for i in range(41, 291))


def test_mentions_with_other_separators_are_found(spark):
    filler = " and then some more plain words follow here "
    forms = ["{a}{b}{c}", "{b} {c}", "0{a} {b} {c}", "{b}-{c}", "({a}) {b} {c}"]
    texts = []
    for i in range(60):
        part = {"a": 20 + i, "b": 7000 + 13 * i, "c": 1000 + 7 * i}
        whole = "+44 {a} {b} {c}".format(**part)
        texts.append((f"call {whole} now{filler}write " + filler.join(f"again {f.format(**part)} please" for f in forms),
                      whole, [f.format(**part).strip("(") for f in forms]))
    plain = f"call +44 20 7946 0958 now{filler}12 7946 11 0958 and 46 0958 of 2024 {filler} 4 5 6"
    card = f"card 4111 1111 1111 1111{filler}again 1111 1111 1111 please"
    # What the field learns from: whole numbers that come again, and other numbers that do.
    more = [f"call +44 {10 + i} 555 {2000 + i} now{filler}call +44 {10 + i} 555 {2000 + i} again" for i in range(60)]
    more += [f"order {700000 + i} of shop{filler}order {700000 + i} again" for i in range(60)]
    got = by_id(pii.personal_data(docs(spark, [t for t, _, _ in texts] + [plain, card] + more)))
    for i, (text, whole, found) in enumerate(texts, 1):
        spans = [x.split(":") for x in got[i]["spans"].split(",")]
        assert [(k, text[int(s):int(e)]) for k, s, e in spans] == [("phone", x) for x in [whole, *found]]
    assert got[61]["spans"].count(":") == 2
    assert pii.nodes_of(card, pii.base_spans(card), t := pii.tokens_of(card), pii.observe(t, pii.base_spans(card)))[0] == [
        (5, 24, "4111 1111 1111 1111"), (len(card) - 21, len(card) - 7, "1111 1111 1111")]


# -- licences -----------------------------------------------------------------------------------

LICENSES = ["This work is licensed under the GNU General Public License, version 3.", "All rights reserved. ALL RIGHTS RESERVED",
            None, "", "Licensed under CC BY-NC 4.0.", "cc by cc by cc bye", "Released under the MIT License.", LONG,
            "é Licensed under the Apache License, Version 2.0.", "apache license and mit words apart general public",
            "licensed under the very old apache license version 2 0"]


def labels_in_place(words):
    """Labels of every template that stands somewhere with its share of words and its phrases."""
    expected = set()
    for label, template, keys in licenses.TEMPLATES:
        t = template.split()
        for k in range(1 - len(t), len(words)):
            place = words[max(k, 0):k + len(t)]
            share = sum(a == b for a, b in zip(place, t[max(0, -k):])) / len(t)
            if share >= licenses.MIN_SHARE and all(f" {x} " in f" {' '.join(place)} " for x in keys):
                expected.add(label)
    return expected


def test_license_scan_equals_brute_force(spark):
    got = by_id(licenses.license_labels(docs(spark, LICENSES)))
    for i, text in enumerate(LICENSES, 1):
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
        places = sorted((k, label) for phrase, label in licenses.BASE_PHRASES.items() for k in range(len(words))
                        if words[k:k + len(phrase.split())] == phrase.split())
        r = got[i]
        assert (r["n_words"], r["n_base"]) == (len(words), len(places))
        assert r["first_word"] == (places[0][0] if places else None)
        assert r["last_word"] == (places[-1][0] if places else None)
        base = {p[1] for p in places}
        assert r["base_labels"] == ",".join(sorted(base))
        assert r["labels"] == ",".join(sorted(base | labels_in_place(words))), text
    assert got[9]["labels"] == "apache-2.0" and got[1]["labels"] == "gpl,gpl-3.0"
    assert licenses.license_labels(docs(spark, [])).count() == 0


def changed_notices():
    """Every template with some words replaced: as many as it bears and one more, at random places, and the rarest
    words first (those that an index of a few rare words would have relied on); some cut at either end."""
    rnd = random.Random(5)
    seen = Counter(w for _, t, _ in licenses.TEMPLATES for w in set(t.split()))
    out = []
    for _, template, _ in licenses.TEMPLATES:
        t = template.split()
        bears = len(t) - next(k for k in range(len(t) + 1) if k / len(t) >= licenses.MIN_SHARE)
        rarest = sorted(range(len(t)), key=lambda p: (seen[t[p]], t[p], p))
        for n in (bears, bears + 1):
            for places in (rarest[:n], rnd.sample(range(len(t)), n), rnd.sample(range(len(t)), n)):
                words = [rnd.choice(["zzz", "the", "license", "a"]) if p in places else w for p, w in enumerate(t)]
                out.append(" ".join(["before"] * rnd.randrange(3) + words + ["after", "the", "software"]))
        out += [" ".join(t[bears:]), " ".join(t[:len(t) - bears]), " ".join(t[:len(t) - bears - 1])]
    return out


def test_changed_notices_are_all_found(spark):
    texts = changed_notices()
    got = by_id(licenses.license_labels(docs(spark, texts)))
    matched = 0
    for i, text in enumerate(texts, 1):
        base = {label for phrase, label in licenses.BASE_PHRASES.items() if f" {phrase} " in f" {text} "}
        expected = labels_in_place(text.split())
        assert got[i]["labels"] == ",".join(sorted(base | expected)), text
        matched += bool(expected)
    assert matched > len(licenses.TEMPLATES)


def test_license_scan_of_long_texts_ties_and_repeats(spark):
    mit = licenses.TEMPLATES[-2][1]
    long = f"{LONG} {mit} {LONG}"
    got = by_id(licenses.license_labels(docs(spark, [long, mit, mit, LONG])))
    assert got[1]["labels"] == "mit" and got[1]["n_words"] == 2 * len(LONG.split()) + len(mit.split())
    assert {k: v for k, v in got[2].items() if k != "doc_id"} == {k: v for k, v in got[3].items() if k != "doc_id"}
    assert got[4]["labels"] == "" and f"mit:{len(LONG.split())}:" in got[1]["matches"]
    kept, names = licenses.scan(docs(spark, [mit]))
    assert (kept.first()["label"], kept.first()["spans"], kept.first()["n_words"]) == ("y", "z", -1)
    assert kept.first()[names["n_words"]] == len(mit.split())
