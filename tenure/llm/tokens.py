"""Token counts (operator 1): an exact length histogram and its suffix sums.

Each document is encoded once and only its length kept.  Documents are then
aggregated by (group, length); suffix sums over the lengths answer, for any
context limit, how many documents and tokens lie at or over it, the total that
remains when every document is cut at the limit, and exact quantiles.  The
histogram is bounded by the distinct lengths, not by the documents; its suffix
sums are taken in two levels (within blocks of lengths, and over block totals),
so that no window spans all lengths.

A byte-level BPE never merges over the borders of its pre-token pattern, and
that pattern never joins a non-space character to anything after the next
white space.  So a text's count is the sum of the counts of its space-led
chunks, and a chunk seen before is not encoded again.

Defined results: a null or empty text has 0 tokens and is counted at length 0;
a null group is a group of its own; repeated rows count each time; documents of
equal length (ties) share a histogram row; a very long text is encoded whole; an
empty table has an empty histogram and no sums; input columns named like the
results keep their names and values in ``with_token_counts``, and the count gets a longer name.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections.abc import Callable

import tiktoken
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import append_columns, fresh
from tenure.session import stage_shared

TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the public byte-level BPE's pre-token pattern.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# Fixed value: Unicode's White_Space characters, the pattern's \s.
BLANK = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
CHUNK = re.compile(f" ?[^{BLANK}]+|[{BLANK}]+(?![^{BLANK}])|[{BLANK}]")
CACHED_CHUNKS, CACHED_LENGTH = 200_000, 40
BLOCK = 256         # lengths in a block of the suffix sums

_counters: dict[str, Callable[[bytes | None], int]] = {}    # per worker process


def vocabulary(docs: DataFrame, path: str = TOKENIZER) -> Broadcast:
    """The vocabulary file's bytes (about 1 MB, whatever the corpus), for all executors."""
    with open(path, "rb") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def counter(ranks_file: bytes) -> Callable[[bytes | None], int]:
    """A function from a UTF-8 text to its number of tokens."""
    ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, ranks_file.splitlines())}
    encode = tiktoken.Encoding("corpus", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    known: dict[str, int] = {}

    def count(text: bytes | None) -> int:
        total = 0
        for chunk in CHUNK.findall((text or b"").decode()):
            n = known.get(chunk)
            if n is None:
                n = len(encode(chunk))
                if len(known) < CACHED_CHUNKS and len(chunk) <= CACHED_LENGTH:
                    known[chunk] = n
            total += n
        return total
    return count


def with_token_counts(docs: DataFrame, text_col: str = "text", tokenizer: str = TOKENIZER,
                      keep_text: bool = True) -> tuple[DataFrame, str]:
    """``docs`` with a column of token counts, and the name it got."""
    shared, key = vocabulary(docs, tokenizer), uuid.uuid4().hex
    [name] = fresh(docs, "n_tokens")

    def make():
        if key not in _counters:
            _counters.clear()
            _counters[key] = counter(shared.value)
        return lambda texts: [list(map(_counters[key], texts))]

    return append_columns(docs, text_col, [(name, T.LongType())], make, keep_text), name


def length_histogram(docs: DataFrame, group_col: str | None = "lang", text_col: str = "text",
                     tokenizer: str = TOKENIZER) -> DataFrame:
    """(group, n_tokens, n_docs): how many documents have exactly that many tokens."""
    group = F.col(f"`{group_col}`").cast("string") if group_col else F.lit("all")
    narrow = docs.select(group.alias("group"), F.col(f"`{text_col}`").alias("text"))
    counted, n = with_token_counts(narrow, "text", tokenizer, keep_text=False)
    return counted.groupBy("group", F.col(n).alias("n_tokens")).agg(F.count(F.lit(1)).alias("n_docs"))


def suffix_sums(histogram: DataFrame) -> DataFrame:
    """The histogram with, for each length L taken as a context limit: ``docs_at_least`` and
    ``tokens_at_least`` (documents of L tokens or more), ``docs_total``, ``tokens_total``, and
    ``truncated_total`` (tokens left when every document is cut after L)."""
    written = stage_shared(histogram, "length_histogram").withColumn("block", F.expr(f"n_tokens div {BLOCK}"))
    tokens = F.col("n_tokens") * F.col("n_docs")
    blocks = written.groupBy("group", "block").agg(F.sum("n_docs").alias("docs"), F.sum(tokens).alias("tokens"))
    later = Window.partitionBy("group").orderBy(F.desc("block")).rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy("group")
    offsets = blocks.select(
        F.col("group").alias("g"), F.col("block").alias("b"),
        F.coalesce(F.sum("docs").over(later), F.lit(0)).alias("docs_later"),
        F.coalesce(F.sum("tokens").over(later), F.lit(0)).alias("tokens_later"),
        F.sum("docs").over(whole).alias("docs_total"), F.sum("tokens").over(whole).alias("tokens_total"))
    inside = Window.partitionBy("group", "block").orderBy(F.desc("n_tokens")).rowsBetween(
        Window.unboundedPreceding, Window.currentRow)
    summed = written.withColumn("docs_in", F.sum("n_docs").over(inside)).withColumn(
        "tokens_in", F.sum(tokens).over(inside))
    at_least = summed.join(offsets, F.col("group").eqNullSafe(F.col("g")) & (F.col("block") == F.col("b"))).select(
        "group", "n_tokens", "n_docs", (F.col("docs_in") + F.col("docs_later")).alias("docs_at_least"),
        (F.col("tokens_in") + F.col("tokens_later")).alias("tokens_at_least"), "docs_total", "tokens_total")
    return at_least.withColumn("truncated_total", F.col("tokens_total") - F.col("tokens_at_least")
                               + F.col("n_tokens") * F.col("docs_at_least"))


def truncated_totals(sums: DataFrame, limits: list[int]) -> DataFrame:
    """(group, limit, tokens): what remains of each group when documents are cut at each limit."""
    at = sums.withColumn("limit", F.explode(F.array(*[F.lit(x).cast("long") for x in limits])))
    over = F.col("n_tokens") >= F.col("limit")      # suffix sums of the first length at or over the limit
    best = at.groupBy("group", "limit").agg(
        F.max("tokens_total").alias("total"),
        F.min_by(F.when(over, F.col("tokens_at_least")), F.when(over, F.col("n_tokens"))).alias("t"),
        F.min_by(F.when(over, F.col("docs_at_least")), F.when(over, F.col("n_tokens"))).alias("d"))
    return best.select("group", "limit", (F.col("total") - F.coalesce("t", F.lit(0))
                                          + F.col("limit") * F.coalesce("d", F.lit(0))).alias("tokens"))


def quantiles(sums: DataFrame, shares: list[float]) -> DataFrame:
    """(group, share, n_tokens): the smallest length that at least that share of documents do not exceed."""
    at = sums.withColumn("share", F.explode(F.array(*[F.lit(float(x)) for x in shares])))
    up_to = F.col("docs_total") - F.col("docs_at_least") + F.col("n_docs")
    return at.where(up_to >= F.ceil(F.col("share") * F.col("docs_total"))).groupBy("group", "share").agg(
        F.min("n_tokens").alias("n_tokens"))
