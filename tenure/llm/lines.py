"""Line dedup (operator 4): a segment-partition edit join of lines.

Lines are taken in a normal form (A-Z lower-cased, white-space runs as one
space, ends trimmed) and compared when they have at least ``MIN_CHARS``
characters.  Two lines are linked when their edit distance is at most
``EDITS``.  If a line is cut into ``EDITS + 1`` segments, a line within that
distance contains one of them unchanged, at a place that its length bounds: so
each line is indexed under its segments, and probes the index of every length
up to ``EDITS`` shorter with the substrings that could stand there
(multi-match-aware selection).  Candidates are verified by a banded
bit-parallel edit distance.  Connected lines form a class; its first line in
document order is kept.

Scale: texts are read twice.  The first pass makes every line's keys, a batch of
lines together (from running sums of a polynomial over their code points), and
finds the buckets that several lines share; keys are combined per bucket, so no
task sees a hot bucket's rows.  The second pass writes a row a line, and, for
lines with a key that a filter of these buckets lets through, their keys and
their content, where its task meets the line for the first time.  Lines under one
key are linked as ``groups`` describes: through hubs, and across components
only where lengths allow it and neither line has more substrings of its own
than the edits could explain (inside tasks, over blocks of bounded size, which
return links only).  So classes are exact without pairing all copies; the
number of links is not counted, as that would need every pair.  The identity
of a line is a 128-bit hash, and links between references are verified once
more between identities.

Defined results: a null or empty text has no lines, an empty table no rows;
shorter lines are never compared, dropped or counted as repeats; equal lines
(ties, repeated rows) are one class without a link; a null id sorts before
every other and lines of rows with equal ids are told apart by a hash of their
text, then by nothing (repeated rows share their lines' places); very long
texts and lines are taken whole; columns whose names clash pass through.
"""

from __future__ import annotations

import os
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm import minhash
from tenure.llm.common import LOWER, HashFilter, append_columns, fresh, small_side
from tenure.llm.groups import across_blocks, components, link, mixed_only
from tenure.session import stage_shared

EDITS = 2
GRAM = 6            # length of the substrings that tell a line with no link
BLOCK_CHARS = 1 << 22   # of a large bucket's lines that one task holds, twice
MIN_CHARS = 20
COPY_WORDS = 5      # near-dedup's shingles in the pipeline
SEEN_LINES = 200_000    # lines a task remembers, to make their keys and give their content once
KEY_CHARS = 1 << 19     # code points whose keys are made at once
MEMBER_BITS = 1 << 26   # of the filter of shared buckets (8 MB)

_BASE, _M1, _ONE = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.ones(1, np.uint64)


def normal_lines(text: bytes | None) -> list[bytes]:
    return [b" ".join(x.split()) for x in (text or b"").translate(LOWER).split(b"\n")]


def chars(line: bytes) -> int:
    return len(line) if line.isascii() else len(line.decode())


@lru_cache(4)
def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of the polynomial's base and of its inverse, modulo 2 to the power of 64."""
    return tuple(np.concatenate([_ONE, np.cumprod(np.full(n, base, np.uint64))]) for base in (int(_BASE), pow(int(_BASE), -1, 2**64)))


def running_hashes(codes: np.ndarray) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
    """A function of (starts, sizes) that hashes pieces of ``codes``, equal ones alike wherever they stand."""
    n = len(codes)
    power, inverse = powers(1 << n.bit_length())
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + _ONE[0]) * power[:n], dtype=np.uint64)])
    return lambda starts, sizes: (sums[starts + sizes] - sums[starts]) * inverse[starts]


def segment_keys(lines: list[str], edits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, role, key): role 0 for the keys that index a line, its ``edits + 1`` segments (as equal as can be, the
    longer ones last); role 1 for those that probe the index of lines up to ``edits`` shorter."""
    codes = np.frombuffer("".join(lines).encode("utf-32-le"), np.uint32).astype(np.uint64)
    size = np.array([len(x) for x in lines], np.int64)
    begin = np.cumsum(size) - size
    piece, rows, roles, keys = running_hashes(codes), [], [], []
    for shorter in range(edits + 1):
        length = size - shorter
        short, longer = np.divmod(length, edits + 1)
        for i in range(edits + 1):
            own = short + (i > edits - longer)
            start = i * short + np.maximum(0, i - (edits - longer + 1))
            # From the left, at most i edits can precede segment i; from the right, at most edits - i follow it.
            for moved in range(max(-i, shorter - (edits - i)), min(i, shorter + (edits - i)) + 1):
                at = start + moved
                row = np.nonzero((at >= 0) & (at + own <= size) & (own > 0))[0]
                h = piece(begin[row] + at[row], own[row]) + length[row].astype(np.uint64) * _M1 + np.uint64(i)
                rows.append(row)
                roles.append(np.full(len(row), int(shorter > 0 or moved != 0), np.int64))
                keys.append(minhash._mix(h).view(np.int64))
    return np.concatenate(rows), np.concatenate(roles), np.concatenate(keys)


def within(a: str, b: str, k: int) -> bool:
    """Whether the edit distance is at most ``k``: bit-parallel over the 2k + 1 diagonals of the band."""
    if abs(len(a) - len(b)) > k:
        return False
    n = len(os.path.commonprefix([a, b]))
    a, b = a[n:], b[n:]
    n = len(os.path.commonprefix([a[::-1], b[::-1]]))
    a, b = a[:len(a) - n], b[:len(b) - n]
    if not a or not b:
        return len(a) + len(b) <= k
    width = 2 * k + 1
    full, top, goal = (1 << width) - 1, 1 << (2 * k), len(a) - len(b) + k
    # Bit t of every vector is row j - k + t of column j.  Rows of a that hold each character:
    rows: dict[str, int] = {}
    for i, c in enumerate(a):
        rows[c] = rows.get(c, 0) | 1 << (i + k)
    plus, minus, distance = ((1 << k) - 1) << (k + 1), 0, abs(len(a) - len(b))
    for j, c in enumerate(b):
        plus, minus = plus >> 1 | (top if j + k < len(a) + k else 0), minus >> 1
        match = rows.get(c, 0) >> j & full
        same = (((match & plus) + plus) ^ plus | match | minus) & full
        right_plus = (minus | ~(same | plus)) & full
        right_minus = same & plus
        shifted = (right_plus << 1 | 1) & full
        plus = (right_minus << 1 | ~(same | shifted)) & full
        minus = same & shifted
        if j - k + goal >= 0 and not same >> goal & 1:     # the diagonal that ends in the corner
            distance += 1
            if distance > k:
                return False
    return distance <= k


def pieces(lines: list[str]) -> Iterator[tuple[int, list[str]]]:
    """(first, lines): runs of ``lines`` of about ``KEY_CHARS`` code points, or of one line that is longer."""
    first, size = 0, 0
    for k, x in enumerate(lines):
        size += len(x)
        if size >= KEY_CHARS or k == len(lines) - 1:
            yield first, lines[first:k + 1]
            first, size = k + 1, 0


def _reference(line: bytes) -> int:
    """A line's 64-bit reference, part of its identity, with its last bit free for the role."""
    return int.from_bytes(line[:8], "little", signed=True) & ~1


class Met:
    """Which lines a task has met, of the last ``SEEN_LINES`` at least."""

    def __init__(self):
        self.seen: set[bytes] = set()

    def new(self, line: bytes) -> bool:
        if line in self.seen:
            return False
        if len(self.seen) >= SEEN_LINES:
            self.seen.clear()
        self.seen.add(line)
        return True


def shared_buckets(docs: DataFrame, text_col: str, edits: int, min_chars: int) -> DataFrame:
    """(bucket) of the keys that several lines have, one of them as an index key (probing lines meet indexed ones only)."""
    def run(batches):
        met = Met()
        for batch in batches:
            texts, refs = [], []
            for text in batch.column(0).to_pylist():
                for x in normal_lines(text):
                    if len(x) >= min_chars and met.new(line := xxhash.xxh3_128_digest(x)) and len(x := x.decode()) >= min_chars:
                        texts.append(x)
                        refs.append(_reference(line))
            nodes = np.array(refs, np.int64)
            for first, part in pieces(texts):
                row, role, key = segment_keys(part, edits)
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(nodes[first + row] | role)], names=["bucket", "ref"])

    sent = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    node, role = F.col("ref").bitwiseAND(F.lit(-2)), F.col("ref").bitwiseAND(F.lit(1))
    return stage_shared(sent.mapInArrow(run, "bucket bigint, ref bigint").groupBy("bucket").agg(
        F.min(node).alias("lo"), F.max(node).alias("hi"), F.min(role).alias("role")).where("lo <> hi and role = 0").select(
        "bucket"), "shared_buckets")


def line_rows(docs: DataFrame, id_col: str, text_col: str, shared: DataFrame, edits: int, min_chars: int) -> DataFrame:
    """(id, text_key, line_no, line, n_chars, node, content, buckets) of every line long enough, written once.  ``line``
    is its identity, ``node`` a reference; the last two are given where a task first meets a line that may be in a bucket
    of ``shared``."""
    row = T.StructType([T.StructField("line_no", T.LongType()), T.StructField("line", T.BinaryType()),
                        T.StructField("n_chars", T.LongType()), T.StructField("node", T.LongType()),
                        T.StructField("content", T.StringType()), T.StructField("buckets", T.ArrayType(T.LongType()))])
    worth = HashFilter(shared, "bucket", MEMBER_BITS)

    def make():
        met, test = Met(), worth.mask()

        def rows_of(texts):
            out, fresh_rows, fresh_lines = [], [], []
            for text in texts:
                own = []
                for i, x in enumerate(normal_lines(text)):
                    if len(x) >= min_chars and (n := chars(x)) >= min_chars:
                        line = xxhash.xxh3_128_digest(x)
                        own.append({"line_no": i, "line": line, "n_chars": n, "node": _reference(line), "content": None, "buckets": None})
                        if met.new(line):
                            fresh_rows.append(own[-1])
                            fresh_lines.append(x.decode())
                out.append(own)
            for first, part in pieces(fresh_lines):
                which, _, key = segment_keys(part, edits)
                good = test(key)
                for k, bucket in zip(which[good].tolist(), key[good].tolist()):
                    r = fresh_rows[first + k]
                    if r["buckets"] is None:
                        r["content"], r["buckets"] = part[k], []
                    r["buckets"].append(bucket)
            return [out]
        return rows_of

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    found = append_columns(narrow, "text", [("lines", T.ArrayType(row))], make, keep_text=False)
    return stage_shared(found.select("id", "text_key", F.inline("lines")), "lines")


def checked(pairs: DataFrame, schema: str, edits: int) -> DataFrame:
    """The first two columns of the rows whose last two, texts, are within ``edits`` of each other."""
    def run(batches):
        for batch in batches:
            x, y = (c.to_pylist() for c in batch.columns[2:])
            good = pa.array([within(s, t, edits) for s, t in zip(x, y)], pa.bool_())
            yield batch.filter(good).select(batch.schema.names[:2])
    return pairs.mapInArrow(run, schema)


def verified(pairs: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """The pairs (a, b) of references whose lines are within ``edits``."""
    a = texts.select(F.col("node").alias("a"), F.col("content").alias("ca"))
    b = texts.select(F.col("node").alias("b"), F.col("content").alias("cb"))
    return checked(pairs.join(a, "a").join(b, "b").select("a", "b", "ca", "cb"), "a bigint, b bigint", edits).distinct()


def resolve(table: pa.Table, edits: int) -> pa.Table:
    """Links between lines of one bucket (or of two blocks of it) with different labels, as many as
    connect what is connected: lengths first, then the bounded edit distance."""
    nodes, texts = table["node"].to_pylist(), table["content"].to_pylist()
    label = np.unique(table["label"].to_numpy(), return_inverse=True)[1]
    block, size = table["block"].to_numpy(), np.array([len(t) for t in texts])
    one_block, out = table["i"][0] == table["j"][0], []
    for x in range(len(nodes) - 1):
        y = np.arange(x + 1, len(nodes))
        y = y[(label[y] != label[x]) & (one_block | (block[y] != block[x])) & (abs(size[y] - size[x]) <= edits)]
        for k in y:
            if label[k] != label[x] and within(texts[x], texts[k], edits):
                out.append((nodes[x], nodes[k]))
                label[label == label[k]] = label[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.int64()), "b": pa.array([b for _, b in out], pa.int64())})


def own_grams(labelled: DataFrame, texts: DataFrame, edits: int) -> DataFrame:
    """Members of mixed buckets that may still have a link across components.

    An edit changes at most ``GRAM`` of a line's substrings of that length.  So a line with more than
    ``edits`` times as many that no other line of a mixed bucket has is linked with none of them.
    """
    rest = mixed_only(labelled)
    nodes = stage_shared(rest.select("node").distinct(), "mixed_lines")

    def run(batches):
        for batch in batches:
            out_nodes, out_grams = [], []
            for node, text in zip(*(c.to_pylist() for c in batch.columns)):
                grams = {text[i:i + GRAM] for i in range(len(text) - GRAM + 1)}
                out_nodes += [node] * len(grams)
                out_grams += [xxhash.xxh3_64_intdigest(g.encode()) - (1 << 63) for g in grams]
            yield pa.RecordBatch.from_arrays([pa.array(out_nodes, pa.int64()), pa.array(out_grams, pa.int64())],
                                             names=["node", "gram"])

    grams = texts.join(nodes, "node", "left_semi").select("node", "content").mapInArrow(run, "node bigint, gram bigint")
    once = grams.groupBy("gram").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    alone = stage_shared(once.groupBy("node").agg(F.count(F.lit(1)).alias("own")).where(
        F.col("own") > edits * GRAM).select("node"), "lines_alone")
    return rest.join(alone, "node", "left_anti")


def links(rows: DataFrame, shared: DataFrame, edits: int = EDITS) -> DataFrame:
    """Links (a, b), by identity, between lines of ``rows`` within ``edits``: enough to connect every class."""
    held = rows.where("content is not null")
    found = stage_shared(held.select("node", F.explode("buckets").alias("bucket")).join(shared, "bucket", "left_semi").distinct(),
                         "bucket_members")
    buckets = stage_shared(found.join(found.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1"), "bucket"),
                           "segment_buckets")
    texts = stage_shared(held.select("node", "line", "content").join(buckets.select("node").distinct(), "node", "left_semi").distinct(),
                         "line_texts")
    lengths = texts.groupBy("node").agg(F.max(F.length("content")).alias("high"))
    members = stage_shared(buckets.join(lengths, "node"), "members")
    found = link(members, lambda pairs: verified(pairs, texts, edits), lambda labelled: own_grams(labelled, texts, edits),
                 lambda rest: across_blocks(rest, texts, F.col("high"), BLOCK_CHARS, lambda group: resolve(group, edits),
                                            "a bigint, b bigint"))
    # From references to identities; two lines that share a reference are told apart by verifying again.
    a = texts.select(F.col("node").alias("a"), F.col("line").alias("la"), F.col("content").alias("ca"))
    b = texts.select(F.col("node").alias("b"), F.col("line").alias("lb"), F.col("content").alias("cb"))
    named = found.join(a, "a").join(b, "b").select("la", "lb", "ca", "cb")
    return stage_shared(checked(named, "la binary, lb binary", edits).select(
        F.col("la").alias("a"), F.col("lb").alias("b")), "line_links")


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", edits: int = EDITS,
            min_chars: int = MIN_CHARS) -> DataFrame:
    """One row per line long enough: ``id``, ``text_key``, ``line_no``, ``n_chars``, ``first`` (struct of the
    class's first place) and ``kept`` (whether this is that place)."""
    shared = shared_buckets(docs, text_col, edits, min_chars)
    lines = line_rows(docs, id_col, text_col, shared, edits, min_chars)
    labels = components(links(lines, shared, edits)).select(F.col("node").alias("line"), "label")
    place = F.struct("id", "text_key", "line_no")
    per_line = lines.groupBy("line").agg(F.min(place).alias("place"), F.count(F.lit(1)).alias("n"))
    # Only lines with copies or links need to look their class up; any other is a class of its own.
    labelled = stage_shared(per_line.join(labels, "line", "left").where("n > 1 or label is not null").select(
        "line", "place", F.coalesce("label", "line").alias("label")), "labelled_lines")
    firsts = labelled.groupBy("label").agg(F.min("place").alias("first"))
    classed = stage_shared(labelled.join(firsts, "label").select("line", "first"), "line_classes")
    own = F.coalesce(F.col("first"), place)
    return lines.join(classed, "line", "left").select(
        "id", "text_key", "line_no", "n_chars", own.alias("first"), (own == place).alias("kept"))


def line_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per line long enough: its document and number, the class's first document and line, and
    whether it is the line that its class keeps."""
    found = classes(docs, id_col, text_col, **options)
    return found.select(F.col("id").alias(id_col), "line_no", "n_chars",
                        F.col("first.id").alias("class_doc_id"), F.col("first.line_no").alias("class_line_no"), "kept")


def shingled(docs: DataFrame, id_col: str, text_col: str, wanted: DataFrame, words: int, sets: bool) -> DataFrame:
    """(id, text_key, role, node, n) of the documents in ``wanted`` (id, text_key, role, gone) without their lines
    ``gone``, or (node, shingles) with ``sets``: near-dedup's shingle sets and their identity."""
    def run(batches):
        shingler = minhash.Shingler(words)
        for batch in batches:
            found = [shingler(t) for t in batch.column(3).to_pylist()]
            nodes = pa.array([minhash.node_of(s) if len(s) else None for s in found], pa.binary())
            if sets:
                yield pa.RecordBatch.from_arrays([nodes, pa.array([s.view(np.int64) for s in found], pa.list_(pa.int64()))],
                                                 names=["node", "shingles"])
            else:
                yield pa.RecordBatch.from_arrays([*batch.columns[:3], nodes, pa.array(map(len, found), pa.int64())],
                                                 names=["id", "text_key", "role", "node", "n"])

    text = F.col(f"`{text_col}`").cast("string")
    given = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(F.col(f"`{text_col}`")).alias("text_key"), text.alias("text"))
    held = given.join(small_side(wanted, 3 + F.size("gone")), ["id", "text_key"]).select(
        "id", "text_key", "role", without("text", "gone").cast("binary").alias("text"))
    of = docs.schema[id_col].dataType.simpleString()
    return held.mapInArrow(run, "node binary, shingles array<bigint>" if sets else
                           f"id {of}, text_key bigint, role string, node binary, n bigint")


def without(text: str, gone: str) -> Column:
    return F.array_join(F.filter(F.split(F.col(f"`{text}`"), "\n", -1),
                                 lambda x, i: ~F.array_contains(gone, i.cast("long"))), "\n")


def copies(docs: DataFrame, id_col: str, text_col: str, repeats: DataFrame, words: int, similarity: int) -> DataFrame:
    """(id, text_key) of the documents that near-dedup removes if they keep the lines that repeat their source.

    ``repeats`` names each document's source (``src_id``, ``src_key``), a document of smaller id.  The document
    without ``rest`` has to be a near copy of the source as it will be, without its own repeats; so a
    source that would itself stay as a copy does not count.  One comparison a document, no pairs.
    """
    own = repeats.where("src_id is not null")
    sources = own.select(F.col("src_id").alias("id"), F.col("src_key").alias("text_key")).distinct()
    wanted = stage_shared(own.select("id", "text_key", F.lit("copy").alias("role"), F.col("rest").alias("gone")).unionByName(
        sources.join(repeats.select("id", "text_key", "gone"), ["id", "text_key"], "left").select(
            "id", "text_key", F.lit("source").alias("role"),
            F.coalesce("gone", F.array().cast("array<bigint>")).alias("gone"))), "copies_wanted")
    sized = stage_shared(shingled(docs, id_col, text_col, wanted, words, False).where("node is not null").distinct(), "copies_sized")
    a = sized.where("role = 'copy'").select("id", "text_key", F.col("node").alias("a"), F.col("n").alias("na"))
    b = sized.where("role = 'source'").select(F.col("id").alias("src_id"), F.col("text_key").alias("src_key"),
                                              F.col("node").alias("b"), F.col("n").alias("nb"))
    pairs = stage_shared(own.select("id", "text_key", "src_id", "src_key").join(a, ["id", "text_key"]).join(
        b, ["src_id", "src_key"]).where(100 * F.least("na", "nb") >= similarity * F.greatest("na", "nb")), "copy_pairs")
    open_pairs = pairs.where("a <> b")
    worth = open_pairs.select("id", "text_key", F.lit("copy").alias("role")).unionByName(
        open_pairs.select(F.col("src_id").alias("id"), F.col("src_key").alias("text_key"), F.lit("source").alias("role")))
    again = stage_shared(wanted.join(worth.distinct(), ["id", "text_key", "role"], "left_semi"), "copies_again")
    sets = stage_shared(shingled(docs, id_col, text_col, again, words, True).where("node is not null").groupBy("node").agg(
        F.first("shingles").alias("shingles")), "copy_sets")
    near = stage_shared(minhash.confirmed(open_pairs.select("a", "b").distinct(), sets, similarity), "copies_near")
    found = stage_shared(pairs.where("a = b").unionByName(open_pairs.join(near, ["a", "b"], "left_semi")).select(
        "id", "text_key", "src_id", "src_key"), "copies_found")
    held = found.select(F.col("id").alias("src_id"), F.col("text_key").alias("src_key"))
    return found.join(held, ["src_id", "src_key"], "left_anti").select("id", "text_key")


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = COPY_WORDS,
                 similarity: int = minhash.SIMILARITY, **options) -> DataFrame:
    """``docs`` with repeated lines taken out of their texts; every document stays.

    Whatever share of a document repeats others, its repeated lines go.  Only a document that near-dedup
    (shingles of ``words`` words, ``similarity`` per cent) is going to remove as a near copy of the document
    that most of its repeats come from keeps the lines it shares with that one: without them it could not be
    recognised any more.
    """
    found = classes(docs, id_col, text_col, **options).where(~F.col("kept"))
    by_source = found.groupBy("id", "text_key", F.col("first.id").alias("src_id"), F.col("first.text_key").alias("src_key")).agg(
        F.sum("n_chars").alias("chars"), F.collect_set("line_no").alias("nos"))
    # Near-dedup keeps the smallest id, and never a null one.
    best = F.max(F.when(F.col("src_id") < F.col("id"), F.struct("chars", "src_id", "src_key")))
    per_doc = by_source.groupBy("id", "text_key").agg(
        F.collect_list(F.struct("src_id", "src_key", "nos")).alias("every"), best.alias("best"))
    other = F.filter("every", lambda x: ~(x["src_id"].eqNullSafe(F.col("best.src_id")) & x["src_key"].eqNullSafe(F.col("best.src_key"))))
    repeats = stage_shared(per_doc.select(
        "id", "text_key", F.flatten(F.transform("every", lambda x: x["nos"])).alias("gone"),
        F.flatten(F.transform(other, lambda x: x["nos"])).alias("rest"),
        F.col("best.src_id").alias("src_id"), F.col("best.src_key").alias("src_key")), "repeats")
    whole = copies(docs, id_col, text_col, repeats, words, similarity).distinct().withColumn("copy", F.lit(True))
    # Documents without an id have no source, and none is found for them here.
    out = stage_shared(repeats.join(whole, ["id", "text_key"], "left").select(
        "id", "text_key", F.when(F.col("copy"), F.col("rest")).otherwise(F.col("gone")).alias("gone")).where(
        F.size("gone") > 0), "repeated_lines")
    [key, gone, left, left_key] = fresh(docs, "text_key", "gone", "left_id", "left_key")
    text = F.col(f"`{text_col}`")
    joined = docs.withColumn(key, F.xxhash64(text)).join(
        small_side(out.select(F.col("id").alias(left), F.col("text_key").alias(left_key), F.col("gone").alias(gone)),
                   2 + F.size(gone)),
        F.col(f"`{id_col}`").eqNullSafe(F.col(left)) & (F.col(key) == F.col(left_key)), "left")
    return joined.withColumn(text_col, F.when(F.col(gone).isNull(), text).otherwise(without(text_col, gone))).select(
        *[F.col(f"`{c}`") for c in docs.columns])
