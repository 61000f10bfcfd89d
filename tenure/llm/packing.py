"""Packing (operator 7): optimal length buckets and token-budget batches.

Documents are cut into pieces of at most ``max_tokens`` tokens; the global
histogram of piece lengths has at most ``max_tokens`` rows and is all that
reaches the driver.  Dynamic programming over it chooses ``n_buckets``
boundaries that minimise the padding when every piece is padded to its
bucket's boundary.  Inside a bucket, batches hold as many pieces as the token
budget admits at the boundary's length, and only a bucket's last batch may be
short.

Pieces are numbered within their bucket without a window over the bucket:
they are dealt by hash into small blocks, numbered inside (bucket, block), and
shifted by the counts of the bucket's earlier blocks.

Defined results: a document without tokens (null, empty) has one row with
``n_tokens`` 0 and neither bucket nor batch; repeated rows are packed each
time; fewer distinct lengths than buckets give a bucket per length; rows equal in
id and piece (ties) take their slots in any order, each its own; a very long
text has as many pieces as it needs; a null id is packed like any other; an empty
table gives no rows; other input columns are not read, whatever their names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tenure.llm.tokens import TOKENIZER, with_token_counts
from tenure.session import stage_shared

MAX_TOKENS = 2048
N_BUCKETS = 8
TOKEN_BUDGET = 65_536
BLOCK_ROWS = 20_000


def choose_boundaries(lengths: np.ndarray, counts: np.ndarray, n_buckets: int) -> list[int]:
    """Ascending boundaries (each an occurring length, the last the largest) of least total padding."""
    order = np.argsort(lengths)
    lengths, counts = np.asarray(lengths, np.int64)[order], np.asarray(counts, np.int64)[order]
    m, k = len(lengths), min(n_buckets, len(lengths))
    if not m:
        return []
    n = np.concatenate([[0], counts.cumsum()])
    tokens = np.concatenate([[0], (counts * lengths).cumsum()])
    # best[j]: least padding of the first j lengths; a bucket over lengths i..j-1 pads to lengths[j-1].
    best = np.concatenate([[0], lengths * n[1:] - tokens[1:]])
    cuts = [np.zeros(m + 1, np.int64)]
    for _ in range(1, k):
        better, cut = best.copy(), cuts[-1] * 0 - 1
        for j in range(1, m + 1):
            total = best[:j] + lengths[j - 1] * (n[j] - n[:j]) - (tokens[j] - tokens[:j])
            i = int(total.argmin())
            if total[i] < better[j]:
                better[j], cut[j] = total[i], i
        best = better
        cuts.append(cut)
    out, j = [], m
    for cut in reversed(cuts):
        if j == 0:
            break
        if cut[j] >= 0:         # -1: one bucket fewer is as good
            out.append(int(lengths[j - 1]))
            j = int(cut[j])
    return out[::-1]


def pieces(docs: DataFrame, id_col: str, text_col: str, tokenizer: str, max_tokens: int) -> DataFrame:
    """(id, piece, start_token, n_tokens) of every document, written once."""
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("document_text"))
    counted, n = with_token_counts(narrow, "document_text", tokenizer, keep_text=False)
    starts = F.sequence(F.lit(0).cast("long"), F.greatest(F.col(n) - 1, F.lit(0)), F.lit(max_tokens).cast("long"))
    cut = counted.select(F.col(id_col).alias("id"), F.col(n).alias("total"),
                         F.posexplode(starts).alias("piece", "start_token"))
    return stage_shared(cut.select("id", F.col("piece").cast("long").alias("piece"), "start_token", F.least(
        F.col("total") - F.col("start_token"), F.lit(max_tokens).cast("long")).alias("n_tokens")), "pieces")


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", tokenizer: str = TOKENIZER,
         max_tokens: int = MAX_TOKENS, n_buckets: int = N_BUCKETS, token_budget: int = TOKEN_BUDGET,
         block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row per piece: the document's id, ``piece``, ``start_token``, ``n_tokens``, ``bucket_tokens``
    (its bucket's boundary), ``batch`` (numbered within the bucket) and ``slot`` (within the batch)."""
    cut = pieces(docs, id_col, text_col, tokenizer, max_tokens)
    histogram = cut.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).where("n_tokens > 0").collect()
    boundaries = choose_boundaries(np.array([r["n_tokens"] for r in histogram], np.int64),
                                   np.array([r["n"] for r in histogram], np.int64), n_buckets)
    n_blocks = max(1, -(-sum(r["n"] for r in histogram) // block_rows))
    bucket = F.lit(None).cast("long")
    for b in reversed(boundaries):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(bucket)
    dealt = cut.withColumn("bucket_tokens", F.when(F.col("n_tokens") > 0, bucket)).withColumn(
        "block", F.pmod(F.xxhash64("id", "piece", "n_tokens"), F.lit(n_blocks)))
    sizes = dealt.where("n_tokens > 0").groupBy("bucket_tokens", "block").agg(F.count(F.lit(1)).alias("rows"))
    earlier = Window.partitionBy("bucket_tokens").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("bucket_tokens", "block", F.coalesce(F.sum("rows").over(earlier), F.lit(0)).alias("offset"))
    inside = Window.partitionBy("bucket_tokens", "block").orderBy("id", "piece")
    numbered = dealt.where("n_tokens > 0").withColumn("at", F.row_number().over(inside) - 1).join(
        offsets, ["bucket_tokens", "block"]).withColumn("at", F.col("at") + F.col("offset"))
    per_batch = F.greatest(F.lit(1), F.expr(f"{token_budget} div bucket_tokens"))
    placed = numbered.select("id", "piece", "start_token", "n_tokens", "bucket_tokens",
                             F.floor(F.col("at") / per_batch).cast("long").alias("batch"),
                             (F.col("at") % per_batch).cast("long").alias("slot"))
    none = F.lit(None).cast("long")
    empty = dealt.where("n_tokens = 0").select("id", "piece", "start_token", "n_tokens", "bucket_tokens",
                                               none.alias("batch"), none.alias("slot"))
    return placed.unionByName(empty).withColumnRenamed("id", id_col)
