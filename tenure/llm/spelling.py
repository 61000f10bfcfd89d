"""Spelling variant grouping (operator 11): Bloom-guided neighbourhoods.

Words are maximal runs of letters (``A-Z``, ``a-z``, U+00C0 to U+00FF), A-Z
lower-cased, of whole texts; as the contract fixes, some runs lose a code
point (``damaged``).  Words of ``MIN_CHARS`` code points and ``MIN_COUNT``
occurrences overall are the vocabulary.  Two words are near if one code point
inserted, deleted or replaced turns one into the other.

Of every word all deletions, and all replacements by a larger code point, are
generated as hashes: a polynomial over the code points, so an edit's hash
follows from its word's by one addition.  That meets every near pair once,
from one of its sides.  The hashes are probed against broadcast blocked Bloom
filters, sharded by length; only edits that the filters let through become
strings, and an exact join with the vocabulary removes the false positives.

Scale: counts are combined in tasks before the one shuffle of words.  A filter
takes ``BITS_PER_WORD`` bits a word in blocks of 64 bits.  Shards (a length, and a
slice of its hashes where one length alone would be too large) are dealt into
rounds of at most ``ROUND_BYTES``: what is collected and broadcast at a time
is bounded, and a larger vocabulary takes more rounds, not a worse filter.
Following forms to their root doubles the step each round; a form has at least
``RATIO`` times its word's occurrences, so chains are short.

Defined results: a null or empty text has no words; a null id counts as an
empty one in the hash; repeated rows count each; ties between forms go to the
smallest in code-point order; very long words and texts are treated whole,
their edits generated in pieces of bounded size; an empty table, or one
without frequent words, gives no rows; other columns are not read, so their
names cannot clash.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tenure.llm.common import CONTINUATION
from tenure.session import stage_shared

MIN_CHARS, MIN_COUNT, RATIO = 6, 5, 5
DAMAGE = 199            # one of so many (document, run) pairs loses a code point
HELD_WORDS = 200_000    # different words a task counts before it hands them on
BITS_PER_WORD = 16
ROUND_BYTES = 8 << 20   # filters that are collected and broadcast at a time
LENGTHS = 48            # lengths with a shard of their own; longer words share ``MORE`` shards
MORE = 16
LEAST_BLOCKS = 1 << 10  # a small shard's filter is sparse, so that few edits of a long word become strings
PROBES = 1 << 18        # edits hashed at once
TASK_EDITS = 1 << 25    # edits of one task

# A-Z lower-cased; other ASCII that is no letter parts words.  Bytes above ASCII stay: U+00C0 to U+00FF are C3 80 to C3 BF.
_LETTERS = bytes((b + 32 if 0x41 <= b <= 0x5A else b if 0x61 <= b <= 0x7A or b >= 0x80 else 0x20) for b in range(256))
_OTHERS = re.compile(rb"[\xC2\xC4-\xF7][\x80-\xBF]+")

_BASE = np.uint64(0x9E3779B97F4A7C15)
_M2, _M3 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def runs(text: bytes | None) -> list[bytes]:
    """All letter runs of a text, A-Z lower-cased."""
    b = (text or b"").translate(_LETTERS)
    return (b if b.isascii() else _OTHERS.sub(b" ", b)).split()


def damaged(run: bytes, h: int) -> bytes:
    """``run`` without its code point ``h % length``."""
    s = run.decode()
    at = h % len(s)
    return (s[:at] + s[at + 1:]).encode()


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS) -> DataFrame:
    """(word, n) of all words of ``min_chars`` code points, over all texts."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[bytes] = Counter()

        def out() -> pa.RecordBatch:
            words = [w for w in total if len(w) - (0 if w.isascii() else len(w) - len(w.translate(None, CONTINUATION))) >= min_chars]
            counts = [total[w] for w in words]
            total.clear()
            return pa.RecordBatch.from_arrays([pa.array(words, pa.binary()).cast(pa.string()), pa.array(counts, pa.int64())],
                                              names=["word", "n"])

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                # A run of fewer bytes has too few code points, and only loses more.
                found = [w for w in runs(text) if len(w) >= min_chars]
                seed, own = crc32(f"{'' if doc is None else doc}:".encode()), Counter(found)
                hit = [w for w in own if not crc32(w, seed) % DAMAGE]
                for w, n in [(w, own.pop(w)) for w in hit]:
                    own[damaged(w, crc32(w, seed))] += n
                total.update(own)
                if len(total) >= HELD_WORDS:
                    yield out()
        yield out()

    sent = docs.select(F.col(f"`{id_col}`").cast("string").alias("id"),
                       F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return sent.mapInArrow(run, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n"))


# -- hashes ---------------------------------------------------------------------------------------

def matrix(words: list[str]) -> np.ndarray:
    """Code points of words of one length, a row a word."""
    return np.frombuffer("".join(words).encode("utf-32-le"), np.uint32).reshape(len(words), -1).astype(np.uint64)


def powers(length: int) -> np.ndarray:
    return np.cumprod(np.full(length, _BASE, np.uint64))


def polynomial(codes: np.ndarray) -> np.ndarray:
    return (codes * powers(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def mixed(x: np.ndarray, length: int) -> np.ndarray:
    """The probing hash of polynomials of words of ``length``."""
    x = x + np.uint64(length * int(_M3) % 2**64)
    x = (x ^ (x >> np.uint64(30))) * _M2
    x = (x ^ (x >> np.uint64(27))) * _M3
    return x ^ (x >> np.uint64(31))


def bits(h: np.ndarray) -> np.ndarray:
    """A key's four bits in its block of 64."""
    six, one = np.uint64(63), np.uint64(1)
    return (one << (h & six)) | (one << (h >> np.uint64(6) & six)) | (one << (h >> np.uint64(12) & six)) | (one << (h >> np.uint64(18) & six))


def block_of(h: np.ndarray, blocks: int) -> np.ndarray:
    return (h >> np.uint64(24)) % np.uint64(blocks)


def slice_of(h: np.ndarray, slices: int) -> np.ndarray:
    return (h >> np.uint64(44)) % np.uint64(slices)


def edits(codes: np.ndarray, letters: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Hashes of the edits of words of one length, at most about ``PROBES`` at a time: (edited length, hashes,
    word number, place, new code point; 0 where the place is deleted)."""
    n, length = codes.shape
    power, whole = powers(length + 1), polynomial(codes)
    none = np.zeros(1, np.uint64)
    # Words in chunks, and the places of a very long word in pieces.
    most = max(1, PROBES // (length * max(1, len(letters))))
    piece = max(1, PROBES // max(1, len(letters)))
    for lo in range(0, n, most):
        part, total = codes[lo:lo + most], whole[lo:lo + most]
        if length > 1:
            # Without place i: what stands before it keeps its powers, what follows is one power lower.
            terms = part * power[:length]
            before = np.concatenate([np.zeros((len(part), 1), np.uint64), np.cumsum(terms, axis=1, dtype=np.uint64)[:, :-1]], axis=1)
            lower = np.concatenate([np.zeros((len(part), 1), np.uint64), part[:, 1:] * power[:length - 1]], axis=1)
            after = np.cumsum(lower[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
            after = np.concatenate([after[:, 1:], np.zeros((len(part), 1), np.uint64)], axis=1)
            first = np.ones(part.shape, bool)       # deleting any of equal neighbours gives the same word
            first[:, 1:] = part[:, 1:] != part[:, :-1]
            row, place = np.nonzero(first)
            yield length - 1, mixed((before + after)[row, place], length - 1), row + lo, place, np.broadcast_to(none, row.shape)
        for at in range(0, length, piece):
            own = part[:, at:at + piece]
            row, place, letter = np.nonzero(letters[None, None, :] > own[:, :, None])
            new = letters[letter]
            h = total[row] + (new - own[row, place]) * power[at + place]
            yield length, mixed(h, length), row + lo, place + at, new


# -- filters --------------------------------------------------------------------------------------

def shard_of(length: int) -> int:
    return length if length <= LENGTHS else LENGTHS + 1 + length % MORE


def by_length(words: list[str]) -> dict[int, list[int]]:
    out: dict[int, list[int]] = {}
    for k, w in enumerate(words):
        out.setdefault(len(w), []).append(k)
    return out


def rounds_of(sizes: dict[int, int], round_bytes: int, bits_per_word: int = BITS_PER_WORD) -> list[dict[tuple[int, int], tuple[int, int]]]:
    """Rounds of filters: (shard, slice) -> (slices of the shard, 64-bit blocks of the filter)."""
    out, room = [], 0
    for shard, n in sorted(sizes.items()):
        blocks = max(LEAST_BLOCKS, -(-n * bits_per_word // 64))
        slices = -(-blocks * 8 // round_bytes)
        each = -(-blocks // slices)
        for k in range(slices):
            if not out or each * 8 > room:
                out.append({})
                room = round_bytes
            out[-1][shard, k] = (slices, each)
            room -= each * 8
    return out


def filters(vocabulary: DataFrame, plan: dict[tuple[int, int], tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
    """The blocked Bloom filters of one round, put together from the blocks that Spark combines."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {key: np.zeros(blocks, np.uint64) for key, (_, blocks) in plan.items()}
        for batch in batches:
            words = batch.column(0).to_pylist()
            for length, own in by_length(words).items():
                h = mixed(polynomial(matrix([words[k] for k in own])), length)
                for (shard, k), (slices, blocks) in plan.items():
                    if shard == shard_of(length):
                        g = h if slices == 1 else h[slice_of(h, slices) == k]
                        np.bitwise_or.at(held[shard, k], block_of(g, blocks), bits(g))
        for (shard, k), f in held.items():
            at = np.nonzero(f)[0]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(at), shard, np.int32)), pa.array(np.full(len(at), k, np.int32)),
                 pa.array(at.astype(np.int64)), pa.array(f[at].view(np.int64))], names=["shard", "slice", "block", "bits"])

    found = vocabulary.select("word").mapInArrow(run, "shard int, slice int, block bigint, bits bigint").groupBy(
        "shard", "slice", "block").agg(F.bit_or("bits").alias("bits")).toArrow()        # round_bytes / 8 rows at most
    out = {key: np.zeros(blocks, np.uint64) for key, (_, blocks) in plan.items()}
    shard, part, at, value = (found.column(k).to_numpy() for k in range(4))
    for key in out:
        mine = (shard == key[0]) & (part == key[1])
        out[key][at[mine]] = value[mine].view(np.uint64)
    return out


def guided(dealt: DataFrame, vocabulary: DataFrame, letters: list[int], plan: dict[tuple[int, int], tuple[int, int]]) -> DataFrame:
    """(word, n, edit): the edits of the words ``dealt`` that one round's filters let through."""
    shared = vocabulary.sparkSession.sparkContext.broadcast(
        {key: f.tobytes() for key, f in filters(vocabulary, plan).items()})      # ROUND_BYTES at most
    known = np.array(letters, np.uint64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = {key: np.frombuffer(f, np.uint64) for key, f in shared.value.items()}
        for batch in batches:
            words, counts = batch.column(0).to_pylist(), batch.column(1).to_numpy()
            for length, own in by_length(words).items():
                if not any(shard in (shard_of(length), shard_of(length - 1)) for shard, _ in held):
                    continue
                texts = [words[k] for k in own]
                for edited, h, row, place, new in edits(matrix(texts), known):
                    for (shard, k), f in held.items():
                        if shard != shard_of(edited):
                            continue
                        wanted = bits(h)
                        good = f[block_of(h, len(f))] & wanted == wanted
                        if plan[shard, k][0] > 1:
                            good &= slice_of(h, plan[shard, k][0]) == k
                        at = np.nonzero(good)[0]
                        if not len(at):
                            continue
                        which = row[at]
                        made = [f"{texts[r][:p]}{chr(c) if c else ''}{texts[r][p + 1:]}"
                                for r, p, c in zip(which.tolist(), place[at].tolist(), new[at].tolist())]
                        yield pa.RecordBatch.from_arrays(
                            [pa.array([texts[r] for r in which.tolist()], pa.string()),
                             pa.array(counts[np.array(own)[which]], pa.int64()), pa.array(made, pa.string())],
                            names=["word", "n", "edit"])

    return dealt.mapInArrow(run, "word string, n bigint, edit string")


# -- results --------------------------------------------------------------------------------------

def near_pairs(vocabulary: DataFrame, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """(word, n, other, other_n): every near pair of a written vocabulary (word, n), both ways round."""
    length = F.length("word")
    shard = F.when(length <= LENGTHS, length).otherwise(LENGTHS + 1 + length % MORE)
    per_shard = vocabulary.groupBy(shard.alias("shard")).agg(F.count(F.lit(1)).alias("n"), F.sum(length).alias("chars")).collect()
    sizes = {r["shard"]: r["n"] for r in per_shard}
    # At most the 90 code points that words are made of.
    letters = sorted(ord(r[0]) for r in vocabulary.select(F.explode(F.array_distinct(F.split("word", ""))).alias("c"))
                     .where("c <> ''").distinct().collect())
    exact = vocabulary.select(F.col("word").alias("other"), F.col("n").alias("other_n"))
    # The vocabulary is small beside its edits, so these decide how many tasks share the work.
    tasks = -(-sum(r["chars"] for r in per_shard) * (len(letters) + 1) // (2 * TASK_EDITS)) or 1
    dealt = vocabulary.repartition(tasks, "word")
    found = None
    for plan in rounds_of(sizes, round_bytes):
        pairs = guided(dealt, vocabulary, letters, plan).join(exact, F.col("edit") == F.col("other")).select("word", "n", "other", "other_n")
        found = pairs if found is None else found.unionByName(pairs)
    if found is None:
        return vocabulary.select("word", "n", F.col("word").alias("other"), F.col("n").alias("other_n")).limit(0)
    # Each pair was met from one side; an array of both needs no second reading.
    both = F.array(F.struct("word", "n", "other", "other_n"),
                   F.struct(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))
    return found.select(F.inline(both))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of words that have a form (word, form): the end of the chain, by doubling the step."""
    step = stage_shared(forms.select("word", F.col("form").alias("root")), "spelling_roots")
    while True:
        later = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = stage_shared(step.join(later, "root", "left").select(
            "word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling_roots")
        step = joined.drop("moved")
        if joined.where("moved").isEmpty():
            return step


def variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_chars: int = MIN_CHARS,
             min_count: int = MIN_COUNT, ratio: int = RATIO, round_bytes: int = ROUND_BYTES) -> DataFrame:
    """One row per vocabulary word: ``word``, ``form`` (its near word of most occurrences, if these are at least
    ``ratio`` times its own), ``root`` (the end of the chain of forms), ``n``, ``n_near``, ``form_n``."""
    vocabulary = stage_shared(word_counts(docs, id_col, text_col, min_chars).where(F.col("n") >= min_count), "vocabulary")
    best = F.min(F.struct((-F.col("other_n")).alias("less"), F.col("other").alias("form")))
    near = near_pairs(vocabulary, round_bytes).groupBy("word").agg(
        F.count(F.lit(1)).alias("n_near"), best.alias("best"), F.first("n").alias("n"))
    enough: Column = -F.col("best.less") >= ratio * F.col("n")
    formed = stage_shared(near.select("word", "n_near", F.when(enough, F.col("best.form")).alias("form"),
                                      F.when(enough, -F.col("best.less")).alias("form_n")), "spelling_forms")
    root = roots(formed.where("form is not null"))
    return vocabulary.join(formed, "word", "left").join(root, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), "form_n")
