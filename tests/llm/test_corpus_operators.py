"""Operators over pairs, groups and files against brute force, with the defined results for odd rows."""

import base64
import hashlib
import itertools
import random
import re

import numpy as np
import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from tenure.llm import lines, minhash, packing, tokens, warc
from tenure.llm.common import table
from tenure.llm.groups import components

DOCS = "doc_id bigint, text string, node string, label string, text_key bigint, id string, block int"


def docs(spark, rows):
    """Documents with extra columns whose names clash with the operators' own."""
    return spark.createDataFrame([(i, t, "n", "l", 1, "i", 2) for i, t in rows], DOCS)


# -- MinHash ------------------------------------------------------------------------------------

def near_corpus():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out, shared = [], [word() for _ in range(30)]
    for g in range(12):
        base = [word() for _ in range(rng.randint(20, 90))]
        if g % 3 == 0:
            base = shared + base
        for _ in range(rng.randint(1, 7)):
            copy = list(base)
            for _ in range(rng.randint(0, 4)):
                copy[rng.randrange(len(copy))] = word()
            out.append(" ".join(copy))
    # A chain whose ends are not alike, and a large group of near copies.
    base = [word() for _ in range(60)]
    for k in range(0, 15, 2):
        out.append(" ".join(base[k:] + [f"t{j}" for j in range(k)]))
    base = [word() for _ in range(80)]
    for k in range(60):
        copy = list(base)
        copy[k] = word()
        out.append(" ".join(copy))
    out += ["", None, " \n\t", "one two", "ONE  two", "one two three", "x " * 500, "X " * 300, "é ü ñ ö ä"]
    rng.shuffle(out)
    return out


def shingle_set(text, n):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + n]) for i in range(max(1, len(words) - n + 1)))


def brute_components(rows, n, percent=80):
    sets = [(i, shingle_set(t, n)) for i, t in rows]
    root = {k: k for k in range(len(sets))}

    def find(k):
        while root[k] != k:
            k = root[k]
        return k
    for (a, (_, x)), (b, (_, y)) in itertools.combinations(enumerate(sets), 2):
        if x and y and 100 * len(x & y) >= percent * len(x | y):
            root[find(a)] = find(b)
    ids = {}
    for k, (i, _) in enumerate(sets):
        ids.setdefault(find(k), []).append(i)
    return [(i, len(s), min((x for x in ids[find(k)] if x is not None), default=None)) for k, (i, s) in enumerate(sets)]


@pytest.mark.parametrize("n", [4, 5])
def test_components_equal_brute_force(spark, n):
    rows = list(enumerate(near_corpus(), 10))
    got = minhash.near_duplicates(docs(spark, rows), words=n).collect()
    expected = {i: (size, c) for i, size, c in brute_components(rows, n)}
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in got} == expected
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in got)


def test_near_duplicates_odd_rows(spark):
    text = "the quick brown fox jumps over the lazy dog again and again"
    rows = [(5, text), (5, text), (None, text), (9, text.upper()), (None, "other words entirely in this one here"),
            (7, None), (7, None), (3, "")]
    df = docs(spark, rows)
    got = sorted(((r["doc_id"], r["n_shingles"], r["component_id"], r["kept"])
                  for r in minhash.near_duplicates(df).collect()), key=str)
    assert got == sorted([(5, 9, 5, True), (5, 9, 5, True), (None, 9, 5, False), (9, 9, 5, False),
                          (None, 4, None, True), (7, 0, 7, True), (7, 0, 7, True), (3, 0, 3, True)], key=str)
    kept = minhash.keep_one(df)
    assert kept.columns == df.columns
    assert sorted(((r["doc_id"], r["text"]) for r in kept.collect()), key=str) == sorted(
        [(5, text), (None, "other words entirely in this one here"), (7, None), (3, "")], key=str)
    assert minhash.near_duplicates(df.limit(0)).count() == 0 and minhash.keep_one(df.limit(0)).count() == 0


def test_circulant_signature_estimates_jaccard():
    a, b = np.arange(1, 3001, dtype=np.uint64), np.arange(601, 3601, dtype=np.uint64)
    mix = lambda x: np.unique(minhash._mix(x * minhash._M1))
    x, y = minhash.signature(mix(a), 512), minhash.signature(mix(b), 512)
    assert abs((x == y).mean() - 2400 / 3600) < 0.08
    # Coordinate k is the second permutation of the first one's value, shifted by k.
    s = mix(a[:5])
    first = minhash.scatter(s)
    for k in (0, 7, 100):
        x = first + np.uint32(k)
        second = minhash._permute(x, np.empty_like(x), 0x21F0AAAD, 0xD35A2D97)
        assert minhash.signature(s, 101)[k] == second.min()


def test_components_of_a_long_path(spark):
    order = list(range(200))
    random.Random(2).shuffle(order)
    edges = spark.createDataFrame([(order[i], order[i + 1]) for i in range(199)] + [(1000, 1001)], "a long, b long")
    got = {r["node"]: r["label"] for r in components(edges).collect()}
    assert len({got[k] for k in range(200)}) == 1 and got[1000] == got[1001] != got[0]


# -- lines --------------------------------------------------------------------------------------

def edit_distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a):
        new = [i + 1]
        for j, y in enumerate(b):
            new.append(min(row[j] + (x != y), row[j + 1] + 1, new[j] + 1))
        row = new
    return row[-1]


@settings(max_examples=300, deadline=None)
@given(st.text("abé", max_size=12), st.text("abé", max_size=12), st.integers(0, 3))
def test_banded_distance(a, b, k):
    assert lines.within(a, b, k) == (edit_distance(a, b) <= k)


@settings(max_examples=200, deadline=None)
@given(st.text("ab", min_size=6, max_size=14), st.data(), st.integers(1, 3))
def test_segments_lose_no_pair(a, data, k):
    b = list(a)
    for _ in range(data.draw(st.integers(0, k))):
        at = data.draw(st.integers(0, len(b)))
        b[at:at + data.draw(st.integers(0, 1))] = data.draw(st.text("ab", max_size=1))
    short, long = sorted((a, "".join(b)), key=len)
    if len(short) > k and edit_distance(short, long) <= k:
        row, role, key = lines.segment_keys([long, short], k)
        assert set(key[(row == 1) & (role == 0)].tolist()) & set(key[row == 0].tolist())


LINE = "this line is long enough to be compared with others"
LINE_DOCS = [(1, f"{LINE}\nshort\nunique line number one of the first document"), (2, f"{LINE.upper()}  \n{LINE}!"),
             (3, f"x{LINE}y\nshort\n{LINE[:-3]}"), (4, None), (5, ""), (6, "short\nshort"), (7, f"  {LINE}?!..\n{LINE}"),
             (7, f"é {LINE}\nnothing like any other line in here at all"), (8, LINE[:30] + "zz" + LINE[32:])]


def brute_lines(rows, k=lines.EDITS, least=lines.MIN_CHARS):
    every = [((i, n), " ".join(x.lower().split())) for i, t in rows for n, x in enumerate((t or "").split("\n"))]
    every = [e for e in every if len(e[1]) >= least]
    texts = sorted({t for _, t in every})
    near = {(a, b) for a, b in itertools.combinations(texts, 2) if edit_distance(a, b) <= k}
    group = {t: t for t in texts}
    for _ in texts:
        for a, b in near:
            group[a] = group[b] = min(group[a], group[b])
    first = {}
    for place, t in sorted(every):
        first.setdefault(group[t], place)
    return {(place, t): first[group[t]] for place, t in every}


def test_line_classes_equal_brute_force(spark):
    rows = [r for r in LINE_DOCS if r[0] != 7] + [(7, LINE_DOCS[6][1])]
    got = lines.line_classes(docs(spark, rows)).collect()
    expected = brute_lines(rows)
    assert {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in got} == {
        place: v for (place, _), v in expected.items()}
    assert all(r["kept"] == ((r["doc_id"], r["line_no"]) == (r["class_doc_id"], r["class_line_no"])) for r in got)


def test_lines_of_a_generated_corpus(spark):
    rng = random.Random(9)
    pool = ["".join(rng.choice("abcd ") for _ in range(rng.randint(22, 40))).strip() + "z" for _ in range(25)]
    rows = []
    for i in range(40):
        made = []
        for _ in range(rng.randint(1, 5)):
            x = list(rng.choice(pool))
            for _ in range(rng.randint(0, 3)):
                at = rng.randrange(len(x))
                x[at:at + rng.randint(0, 1)] = rng.choice(["", "q", "é"])
            made.append("".join(x))
        rows.append((i, "\n".join(made)))
    got = lines.line_classes(docs(spark, rows)).collect()
    assert {(r["doc_id"], r["line_no"]): (r["class_doc_id"], r["class_line_no"]) for r in got} == {
        place: v for (place, _), v in brute_lines(rows).items()}


def test_repeated_lines_go_and_copies_stay_whole(spark):
    rng = random.Random(4)
    own = [" ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(12)) for _ in range(48)]
    body = ["\n".join(own[8 * d:8 * d + 8]) for d in range(6)]
    rows = [(1, f"{LINE}\n{body[0]}"), (2, f"{body[1]}\n{LINE}!\nend"), (3, body[0]), (4, None), (5, ""), (None, f"{LINE}\n{body[2]}"),
            (6, f"{LINE}\n{body[3]}"), (6, f"{LINE}\n{body[4]}")]
    df = docs(spark, rows)
    out = lines.drop_repeats(df)
    assert out.columns == df.columns
    # The null id sorts first, so its line is the one kept; document 3 is a copy and stays.
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in out.collect()) == sorted(
        (str(i), str(t)) for i, t in [(1, body[0]), (2, f"{body[1]}\nend"), (3, body[0]), (4, None), (5, ""),
                                      (None, f"{LINE}\n{body[2]}"), (6, body[3]), (6, body[4])])
    assert lines.drop_repeats(df.limit(0)).count() == 0 and lines.line_classes(df.limit(0)).count() == 0


def brute_drop(rows, words=5, first=None):
    """Every repeated line goes, but a near copy of the document it repeats most keeps what it shares with it."""
    first = first or {place: f for (place, _), f in brute_lines(rows).items()}
    gone, source, text = {}, {}, dict(rows)
    for i, t in rows:
        gone[i] = {n for (d, n), f in first.items() if d == i and f != (d, n)}
        size = {}
        for n in gone[i]:
            size[first[i, n][0]] = size.get(first[i, n][0], 0) + len(" ".join(t.split("\n")[n].split()))
        size.pop(i, None)
        source[i] = max(size, key=lambda s: (size[s], s)) if size else None

    def rest(i, lost):
        return "\n".join(x for n, x in enumerate((text[i] or "").split("\n")) if n not in lost)

    near, other = set(), {}
    for i, s in source.items():
        other[i] = {n for n in gone[i] if first[i, n][0] != s}
        if s is not None:
            a, b = shingle_set(rest(i, other[i]), words), shingle_set(rest(s, gone[s]), words)
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                near.add(i)
    return {i: rest(i, other[i] if i in near and source[i] not in near else gone[i]) for i in gone}


def test_no_share_of_repeated_lines_is_left_in(spark):
    rng = random.Random(14)
    line = lambda: " ".join("".join(rng.choice("abcdefg") for _ in range(6)) for _ in range(12))
    own = [[line() for _ in range(10)] for _ in range(8)]
    rows = list(enumerate(own))
    for share in range(1, 10):      # ``share`` tenths of another document, in one piece and from several
        rows.append((10 + share, own[share % 8][:share] + [line() for _ in range(10 - share)]))
        rows.append((20 + share, [own[k % 8][k] for k in range(share)] + [line() for _ in range(10 - share)]))
    rows += [(30, [own[k % 8][k] for k in range(10)]),     # nothing but repeats, a copy of no single document
             (31, own[3]), (32, own[3][:9] + [line()]), (33, own[4][:5] + own[5][5:])]
    rows = [(i, "\n".join(x)) for i, x in rows]
    left = {r["doc_id"]: r["text"] for r in lines.drop_repeats(docs(spark, rows)).collect()}
    assert left == brute_drop(rows)
    assert left[31] == "\n".join(own[3]) and left[30] == left[33] == "" and len(left[25].split("\n")) == 5


# -- packing ------------------------------------------------------------------------------------

@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 30), st.integers(1, 9), max_size=8), st.integers(1, 5))
def test_bucket_boundaries_are_optimal(histogram, k):
    lengths = sorted(histogram)

    def padding(bounds):
        return sum(n * (min(b for b in bounds if b >= x) - x) for x, n in histogram.items())
    got = packing.choose_boundaries(np.array(lengths, np.int64), np.array([histogram[x] for x in lengths], np.int64), k)
    if not lengths:
        assert got == []
        return
    best = min(padding([*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], min(k, len(lengths)) - 1))
    assert got == sorted(set(got)) and got[-1] == lengths[-1] and len(got) <= k and padding(got) == best


def test_packing_places_every_piece_once(spark):
    rng = random.Random(3)
    rows = [(i, " ".join(rng.choice(["alpha", "beta", "x1"]) for _ in range(rng.randint(1, 120)))) for i in range(150)]
    rows += [(200, None), (201, ""), (None, "some text"), (0, rows[0][1]), (202, "long " * 900)]
    df = docs(spark, rows)
    counted, n = tokens.with_token_counts(df, "text")
    total = sum(r[n] for r in counted.collect())
    got = packing.pack(df, max_tokens=64, n_buckets=4, token_budget=256, block_rows=20).collect()
    full = [r for r in got if r["n_tokens"]]
    assert sum(r["n_tokens"] for r in got) == total and {r["doc_id"] for r in got} == {i for i, _ in rows}
    assert all(r["batch"] is None and r["bucket_tokens"] is None for r in got if not r["n_tokens"])
    assert all(r["start_token"] == 64 * r["piece"] for r in got)
    by_bucket = {}
    for r in full:
        by_bucket.setdefault(r["bucket_tokens"], []).append(r)
    bounds = sorted(by_bucket)
    for b, members in by_bucket.items():
        size = 256 // b
        assert all(max([x for x in bounds if x < b], default=0) < r["n_tokens"] <= b for r in members)
        assert sorted((r["batch"], r["slot"]) for r in members) == [divmod(i, size) for i in range(len(members))]
    assert packing.pack(df.limit(0)).count() == 0


# -- WARC ---------------------------------------------------------------------------------------

PAGE = "<html><body><p>page {} with some markup that repeats itself</p>{}</body></html>"


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows],
                                 "page_id bigint, url string, html string, digest string, archive string")


def brute_pages(rows, least=0):
    out = []
    for i, _, html in rows:
        payload = (html or "").encode()
        ids = [j for j, _, h in rows if (h or "").encode() == payload and j is not None]
        top = max(ids, default=None) if len(payload) >= least else None
        out.append((i, len(payload), base64.b32encode(hashlib.sha1(payload).digest()).decode(),
                    "response" if top is None or i == top else "revisit", None if i == top else top))
    return sorted(out, key=str)


@pytest.mark.parametrize("least", [0, 100])
def test_archives_round_trip(spark, tmp_path, least):
    rng = random.Random(1)
    rows = [(i, f"http://e.example/{i}", PAGE.format(i, "".join(rng.choice("abc<>") for _ in range(200)))) for i in range(120)]
    rows += [(200 + i, f"http://c.example/{i}\r\nX: y", PAGE.format(1, "copy")) for i in range(30)]
    rows += [(300, None, None), (301, "u", ""), (229, "again", PAGE.format(1, "copy")), (None, "n", PAGE.format(1, "copy")),
             (None, "n", "only here"), (302, "big", "é\r\n\r\n" * 100_000)]
    folder = str(tmp_path / "warc")
    got = warc.archived_pages(pages(spark, rows), folder=folder, min_bytes=least, archive_bytes=4000).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=str) == brute_pages(rows, least)
    assert len({r["archive"] for r in got}) > 2
    # Each archive opens with its dictionary in a skippable frame, and any record can be read at its offset.
    r = next(r for r in got if r["page_id"] == 5)
    raw = (tmp_path / "warc" / r["archive"]).read_bytes()
    assert int.from_bytes(raw[:4], "little") == warc.DICTIONARY_MAGIC
    shared = zstandard.ZstdCompressionDict(raw[8:8 + int.from_bytes(raw[4:8], "little")])
    record = zstandard.ZstdDecompressor(dict_data=shared).decompressobj().decompress(raw[r["offset"]:])
    assert record.startswith(b"WARC/1.1\r\nWARC-Type: response") and rows[5][2].encode() in record


def test_archives_are_readable_from_their_raw_bytes(spark, tmp_path):
    """Plain file reads: the dictionary's frame leads, frames follow each other, and each record's frame decodes alone."""
    folder, sf = str(tmp_path / "warc"), "/root/testdata/sf0.01"
    given = table(spark, sf, "pages")
    manifest = warc.write(given, folder, archive_bytes=100_000)
    placed = {(r["archive"], r["offset"]): r["id"] for r in warc.read(manifest, folder).collect()}
    html = {str(r["page_id"]): (r["html"] or "").encode() for r in given.collect()}
    seen = set()
    for r in manifest.collect():
        raw = (tmp_path / "warc" / r["archive"]).read_bytes()
        assert len(raw) == r["bytes"] and raw[:4] == warc.DICTIONARY_MAGIC.to_bytes(4, "little")
        at = 8 + int.from_bytes(raw[4:8], "little")
        shared = zstandard.ZstdCompressionDict(raw[8:at])
        assert shared.dict_id()
        for n in range(r["records"]):
            frame = zstandard.get_frame_parameters(raw[at:at + 18])
            assert frame.dict_id == shared.dict_id()
            one = zstandard.ZstdDecompressor(dict_data=shared).decompressobj()
            record = one.decompress(raw[at:])
            page = placed[r["archive"], at]
            assert f"<urn:page:{page}>".encode() in record and (b"\r\nWARC-Type: revisit" in record or html[page] in record)
            seen.add(page)
            at = len(raw) - len(one.unused_data)
        assert at == len(raw)
    assert seen == set(html)


def test_dictionary_of_records_that_cannot_be_trained_on():
    assert warc.train_dictionary([]) == b"" and warc.train_dictionary([b"one record"]) == b"one record"


def test_archives_of_few_or_no_pages(spark):
    few = [(1, "u", "tiny"), (2, "u", None)]
    got = warc.archived_pages(pages(spark, few)).collect()
    assert sorted(((r["page_id"], r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in got),
                  key=str) == brute_pages(few)
    assert warc.archived_pages(pages(spark, [])).count() == 0


def test_damage_is_noticed():
    raw = warc.record("1", "u", b"payload", None)
    assert warc.parse(raw)["payload_bytes"] == 7
    with pytest.raises(ValueError):
        warc.parse(raw.replace(b"payload\r", b"paXload\r"))


def test_large_buckets_are_resolved_block_by_block(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    base, spare = [word() for _ in range(70)], [word() for _ in range(3)]
    rows = []
    for i in range(150):       # variants that share their edits, so that no shingle is anyone's own
        copy = list(base)
        for _ in range(rng.randint(0, 9)):
            copy[rng.randrange(len(copy))] = rng.choice(spare)
        rows.append((i, " ".join(copy)))
    expected = {i: c for i, _, c in brute_components(rows, 4)}
    assert 1 < len(set(expected.values())) < 150
    for block in (1 << 21, 400):
        got = minhash.near_duplicates(docs(spark, rows), block_shingles=block).collect()
        assert {r["doc_id"]: r["component_id"] for r in got} == expected
