"""MinHash near-dedup (operator 3) with circulant signatures.

A document's set holds its distinct shingles of ``WORDS`` words (A-Z
lower-cased, words are runs of anything but ASCII white space).  Two fixed
permutations of the 32-bit universe generate all signature coordinates: the
first scatters a shingle, the second is applied after a circular shift by the
coordinate's number, so coordinate k is ``min over s of second(first(s) + k)``.
Coordinates are cut into bands; equal bands make candidates, and every link is
confirmed by the exact Jaccard similarity of the full sets.

Scale: documents with equal sets collapse into one node first, so copies cost
one row.  Buckets are then linked as ``groups`` describes: through hubs, and
across components only where shingles that no other candidate has, sizes and
the low bytes of the signatures allow a link (none is lost by that).  The
last comparison runs inside tasks, over blocks of bounded size, and returns
links only.  Components, labels and sets stay distributed.

With 40 bands of 5, a pair of similarity 0.8 shares no band with probability
(1 - 0.8^5)^40 = 1.3e-7.

Defined results: a null text, or one without words, has an empty set and is
linked with nothing; a text of fewer than ``WORDS`` words is one shingle; equal
rows are copies; a null id is in a component but is never its smallest id, and
a component without ids has id null.  Of rows that tie for the smallest id
``near_duplicates`` marks each as kept, while ``keep_one`` lets one row stay.  A
very long text gives its whole set; an empty table gives no rows; other input
columns pass ``keep_one`` unchanged, whatever their names.
"""

from __future__ import annotations


import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import LOWER, HashFilter, append_columns, fresh, small_side
from tenure.llm.groups import across_blocks, components, link, mixed_only
from tenure.session import stage_shared

BANDS, ROWS = 40, 5
WORDS = 4
SIMILARITY = 80     # per cent
CACHED_WORDS = 200_000
BLOCK_SHINGLES = 1 << 21    # of a large bucket's members that one task holds, twice
CHUNK = 256         # shingles permuted at once: the working set stays in the processor's cache
SLACK = 6           # standard deviations by which an estimate may fall short before a pair is not compared

_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


class Shingler:
    """Sorted distinct 64-bit shingle hashes of a text."""

    def __init__(self, words: int = WORDS):
        self.words = words
        self.known: dict[bytes, int] = {}

    def word_hashes(self, words: list[bytes]) -> np.ndarray:
        known, out = self.known, []
        for w in words:
            h = known.get(w)
            if h is None:
                h = xxhash.xxh3_64_intdigest(w)
                if len(known) < CACHED_WORDS:
                    known[w] = h
            out.append(h)
        return np.array(out, np.uint64)

    def __call__(self, text: bytes | None) -> np.ndarray:
        words = (text or b"").translate(LOWER).split()
        if not words:
            return np.empty(0, np.uint64)
        h = self.word_hashes(words)
        n = min(self.words, len(words))
        out = np.full(len(words) - n + 1, np.uint64(n))
        for i in range(n):      # order-dependent: every word is mixed into what came before
            out = _mix(out * _M1 + h[i:len(h) - n + 1 + i])
        return np.unique(out)


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def _permute(x: np.ndarray, spare: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit integers, in place: xor-shifts and odd multiplications."""
    for shift, factor in ((16, a), (15, b), (16, 1)):
        np.right_shift(x, shift, out=spare)
        np.bitwise_xor(x, spare, out=x)
        if factor != 1:
            np.multiply(x, np.uint32(factor), out=x)
    return x


def scatter(shingles: np.ndarray) -> np.ndarray:
    """The first permutation, of the shingles' upper 32 bits."""
    x = (shingles >> np.uint64(32)).astype(np.uint32)
    return _permute(x, np.empty_like(x), 0x7FEB352D, 0x846CA68B)


def signature(shingles: np.ndarray, size: int = BANDS * ROWS) -> np.ndarray:
    """Circulant MinHash of a non-empty set: ``size`` coordinates from two permutations."""
    scattered = scatter(shingles)
    shifts = np.arange(size, dtype=np.uint32)[None, :]
    best = np.full(size, 0xFFFFFFFF, np.uint32)
    moved, spare = np.empty((CHUNK, size), np.uint32), np.empty((CHUNK, size), np.uint32)
    for k in range(0, len(scattered), CHUNK):
        part = scattered[k:k + CHUNK, None]
        x, y = moved[:len(part)], spare[:len(part)]
        np.add(part, shifts, out=x)             # wraps round: the circular shift
        np.minimum(best, _permute(x, y, 0x21F0AAAD, 0xD35A2D97).min(axis=0), out=best)
    return best


def node_of(shingles: np.ndarray) -> bytes:
    """The identity of a set: a 128-bit hash of its sorted members."""
    return xxhash.xxh3_128_digest(shingles.tobytes())


def band_keys(sig: np.ndarray, bands: int, rows: int) -> list[int]:
    keys = np.arange(bands, dtype=np.uint64)
    for k in range(rows):
        keys = _mix(keys * _M1 + sig[k::rows].astype(np.uint64))
    return keys.view(np.int64).tolist()


def signatures(docs: DataFrame, id_col: str, text_col: str, words: int, bands: int, rows: int) -> DataFrame:
    """(id, text_key, n_shingles, node, bands, sketch) of every document, written once; node is null for
    empty sets.  The sketch is the low byte of every coordinate."""
    def make():
        shingler = Shingler(words)

        def values(texts):
            sizes, nodes, keys, sketches = [], [], [], []
            for t in texts:
                s = shingler(t)
                sig = signature(s, bands * rows) if len(s) else None
                sizes.append(len(s))
                nodes.append(node_of(s) if len(s) else None)
                keys.append(band_keys(sig, bands, rows) if len(s) else None)
                sketches.append(sig.astype(np.uint8).tobytes() if len(s) else None)
            return [sizes, nodes, keys, sketches]
        return values

    text = F.col(f"`{text_col}`")
    narrow = docs.select(F.col(f"`{id_col}`").alias("id"), F.xxhash64(text).alias("text_key"), text.alias("text"))
    return stage_shared(append_columns(
        narrow, "text", [("n_shingles", T.LongType()), ("node", T.BinaryType()),
                         ("bands", T.ArrayType(T.LongType())), ("sketch", T.BinaryType())], make, keep_text=False),
        "signatures")


def shingle_sets(docs: DataFrame, text_col: str, wanted: DataFrame, words: int) -> DataFrame:
    """(node, shingles) of the nodes in ``wanted`` (node, text_key): a second pass that only works on
    texts whose key is wanted."""
    worth = HashFilter(wanted, "text_key")

    def run(batches):
        shingler, test = Shingler(words), worth.test()
        for batch in batches:
            nodes, sets = [], []
            for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if text and test(key) and len(s := shingler(text)):
                    nodes.append(node_of(s))
                    sets.append(s.view(np.int64))
            yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(sets, pa.list_(pa.int64()))],
                                             names=["node", "shingles"])

    text = F.col(f"`{text_col}`")
    sent = docs.select(F.xxhash64(text).alias("text_key"), text.cast("string").cast("binary").alias("text"))
    found = sent.mapInArrow(run, "node binary, shingles array<bigint>")
    # Copies of one text come from several tasks: one is kept.
    return stage_shared(found.join(wanted.select("node").distinct(), "node", "left_semi").groupBy("node").agg(
        F.first("shingles").alias("shingles")), "sets")


def least_agreement(similarity: int, size: int) -> int:
    """In how many of ``size`` coordinates a pair at the threshold agrees, less ``SLACK`` standard
    deviations: a pair that agrees in fewer is a link with a chance of about 1e-9."""
    p = similarity / 100
    return int(size * p - SLACK * (size * p * (1 - p)) ** 0.5)


def resolve(table: pa.Table, similarity: int) -> pa.Table:
    """Links between the members of one bucket (or of two blocks of it) with different labels, as many as
    connect what is connected.

    A pair is looked at in the first bucket that its two nodes share, if sizes and sketches allow a
    link, and not once its labels are connected; what decides is the full sets' similarity.
    """
    nodes = table["node"].to_pylist()
    label = np.unique(np.array([x.hex() for x in table["label"].to_pylist()]), return_inverse=True)[1]
    n, block = table["n"].to_numpy(), table["block"].to_numpy()
    bands = np.stack(table["bands"].to_numpy())
    sketch = np.stack([np.frombuffer(x, np.uint8) for x in table["sketch"].to_pylist()])
    sets = [np.sort(x) for x in table["shingles"].to_numpy()]
    band = int((bands[0] == table["bucket"][0].as_py()).argmax())
    least, one_block = least_agreement(similarity, sketch.shape[1]), bool((table["i"][0] == table["j"][0]))
    out = []
    for x in range(len(nodes) - 1):
        y = np.arange(x + 1, len(nodes))
        y = y[(label[y] != label[x]) & (one_block | (block[y] != block[x]))
              & (100 * np.minimum(n[y], n[x]) >= similarity * np.maximum(n[y], n[x]))]
        y = y[(bands[y] == bands[x]).argmax(axis=1) == band]
        agree = (sketch[y] == sketch[x]).sum(axis=1)
        for k in y[np.argsort(-agree)][:int((agree >= least).sum())]:
            if label[k] == label[x]:
                continue
            common = np.intersect1d(sets[x], sets[k], assume_unique=True).size
            if 100 * common >= similarity * (n[x] + n[k] - common):
                out.append((nodes[x], nodes[k]))
                label[label == label[k]] = label[x]
    return pa.table({"a": pa.array([a for a, _ in out], pa.binary()), "b": pa.array([b for _, b in out], pa.binary())})


def confirmed(pairs: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs (a, b) whose sets are at least ``similarity`` per cent alike."""
    a = sets.select(F.col("node").alias("a"), F.col("shingles").alias("sa"))
    b = sets.select(F.col("node").alias("b"), F.col("shingles").alias("sb"))
    common = F.size(F.array_intersect("sa", "sb"))
    union = F.size("sa") + F.size("sb") - common
    return pairs.join(a, "a").join(b, "b").where(F.lit(100) * common >= F.lit(similarity) * union).select("a", "b")


def own_shingles(labelled: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """Members of mixed buckets that may still have a link across components, with ``own``.

    ``own`` counts a node's shingles that no other node of a mixed bucket has.  With c = n - own, a
    link to a node of m shingles has similarity c / (n + m - c) at most, m being at least c and
    the bucket's smallest size: where that falls short, the node is left out (and loses nothing).
    """
    rest = mixed_only(labelled, F.min("n").alias("smallest"))
    nodes = stage_shared(rest.select("node").distinct(), "mixed_nodes")
    once = sets.join(nodes, "node", "left_semi").select("node", F.explode("shingles").alias("shingle")).groupBy(
        "shingle").agg(F.count(F.lit(1)).alias("k"), F.min("node").alias("node")).where("k = 1")
    own = stage_shared(once.groupBy("node").agg(F.count(F.lit(1)).alias("own")), "own_shingles")
    counted = rest.join(own, "node", "left").withColumn("own", F.coalesce("own", F.lit(0)))
    common = F.col("n") - F.col("own")
    return counted.where(100 * common >= similarity * (F.col("n") + F.greatest("smallest", common) - common)).drop("smallest")


def cluster(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS,
            similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS,
            block_shingles: int = BLOCK_SHINGLES) -> tuple[DataFrame, DataFrame]:
    """The signatures of all documents, and (node, component) for every node: the component's smallest id."""
    sig = signatures(docs, id_col, text_col, words, bands, rows)
    nodes = stage_shared(sig.where("node is not null").groupBy("node").agg(
        F.min("id").alias("id"), F.min("text_key").alias("text_key"), F.first("n_shingles").alias("n"),
        F.first("bands").alias("bands"), F.first("sketch").alias("sketch")), "nodes")
    members = nodes.select("node", "n", F.explode("bands").alias("bucket"))
    sizes = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("k")).where("k > 1")
    shared = stage_shared(members.join(sizes, "bucket"), "buckets")       # buckets with several nodes, a row a member
    wanted = shared.select("node").distinct().join(nodes.select("node", "text_key"), "node")
    sets = shingle_sets(docs, text_col, stage_shared(wanted, "wanted"), words)

    held = nodes.select("node", "n", "bands", "sketch").join(sets, "node")
    labels = components(link(
        shared, lambda pairs: confirmed(pairs, sets, similarity), lambda labelled: own_shingles(labelled, sets, similarity),
        lambda rest: across_blocks(rest, held, F.col("n"), block_shingles, lambda group: resolve(group, similarity),
                                   "a binary, b binary")))
    whole = nodes.select("node", "id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
    smallest = whole.groupBy("label").agg(F.min("id").alias("component"))
    return sig, whole.join(smallest, "label").select("node", "component")


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: its id, ``n_shingles``, ``component_id`` and ``kept``."""
    return _decided(docs, id_col, text_col, **options).select(
        F.col("id").alias(id_col), "n_shingles", "component_id", "kept")


def _decided(docs: DataFrame, id_col: str, text_col: str, **options) -> DataFrame:
    sig, component = cluster(docs, id_col, text_col, **options)
    found = sig.select("id", "text_key", "n_shingles", "node").join(stage_shared(component, "components"), "node", "left")
    of = F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component"))
    return found.select("id", "text_key", "n_shingles", of.alias("component_id"), F.col("id").eqNullSafe(of).alias("kept"))


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """``docs`` without the documents whose component has a smaller id.  Rows that repeat a kept
    id stay once; documents with a null id stay only where no document of their component has an id."""
    decided = stage_shared(_decided(docs, id_col, text_col, **options), "decided")
    [gone_id, gone_key, again_id] = fresh(docs, "gone_id", "gone_key", "again_id")
    gone = small_side(stage_shared(decided.where("not kept").select(
        F.col("id").alias(gone_id), F.col("text_key").alias(gone_key)).distinct(), "gone"))
    key = F.xxhash64(F.col(f"`{text_col}`"))
    left = docs.join(gone, F.col(f"`{id_col}`").eqNullSafe(F.col(gone_id)) & (key == F.col(gone_key)), "left_anti")
    again = small_side(stage_shared(decided.where("kept and id is not null").groupBy(F.col("id").alias(again_id)).agg(
        F.count(F.lit(1)).alias("k")).where("k > 1").select(again_id), "again"))
    same = F.col(f"`{id_col}`") == F.col(again_id)
    return left.join(again, same, "left_anti").unionByName(
        left.join(again, same, "left_semi").dropDuplicates([id_col]))
