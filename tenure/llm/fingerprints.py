"""Document fingerprints (operator 12): I-Match over randomised lexicon subsets, in DataFrame functions only.

A text's terms are its words (lower-cased runs of letters, digits and anything
above ASCII).  The lexicon keeps the terms that occur in a share of all
documents between ``LOW`` and ``HIGH``, a band of the inverse document
frequency: neither words that every text has nor names and slips of the pen.
A text's distinct terms in the lexicon are sorted and hashed; that is I-Match.
Beside it, the same is done for random subsets of the lexicon: four quarters
of it, and on each further level 16 subsets of a quarter of the size (1/16 of
the lexicon down to 1/1024), since a subset only survives an edit if it holds
no changed term: short texts are told by large subsets, long texts by small ones.

The likeness of two fingerprints is 1 if they are equal; else the share of
agreeing subsets, of those that hold a term of either text, on the last level
where these are at least half of the subsets (or on the first level).

Scale: one pass counts the documents of each term (as 64-bit hashes, combined
in tasks).  The lexicon goes to the tasks as one flat array of numbers in small
buckets (a row is given a copy of it, at memory speed): as a term of it is in ``LOW`` of all documents, there are at most
(distinct terms of a mean document) / ``LOW`` terms, whatever the corpus's
size.  A document meets its neighbour (the next one by falling id) in a window
over narrow ranges of ids; the first row of each range is a guest in the range
before it, so texts are shuffled once and no window spans the table.

Defined results: a null or empty text has no terms, no subset that holds one,
and the fingerprint of all such texts; a text whose terms all lie outside the
lexicon is told by all its distinct terms, as a whole and in the subsets; in an
empty table nothing is returned; a table of one row is its own neighbour; rows
with a null id come after all others, and rows of equal id, ties and repeated
rows in the order of a hash of their texts; very long texts are treated whole;
ids are whole numbers; other columns are not read, so their names cannot clash.
"""

from __future__ import annotations

from collections.abc import Callable
from itertools import accumulate

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tenure.functions.windows import range_id
from tenure.llm.common import small_side
from tenure.session import stage_shared

LOW, HIGH = 0.005, 0.2      # share of documents: a term's place in the band
LEVELS = [(4, 4), (16, 16), (64, 16), (256, 16), (1024, 16)]      # one lexicon term in so many, subsets of that size
BUCKETS = 1 << 12           # of the lexicon
RANGE_ROWS, RANGES, PARTS = 100, 64, 1024       # rows wanted in a range of ids; ranges by quantile, and parts of each

BREAKS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"      # what parts words once A-Z are lower-cased


def terms(text: Column) -> Column:
    """The distinct terms of a text, as sorted hashes."""
    words = F.filter(F.split(F.lower(text), BREAKS, -1), lambda w: w != "")
    return F.sort_array(F.array_distinct(F.transform(words, lambda w: F.xxhash64(w))))


def lexicon(docs: DataFrame, text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row, ``lexicon``: the terms (hashes) within the band, by bucket (a hash's last bits), after the place of
    each bucket's first term among them and their number."""
    n = docs.count()
    counts = docs.select(F.explode(terms(_text(text_col))).alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("k"))
    band = counts.where((F.col("k") >= low * n) & (F.col("k") <= high * n))
    # Each bucket once at least; collect_list leaves the null out.
    placed = band.select(F.pmod("term", F.lit(BUCKETS)).alias("bucket"), "term").unionByName(
        docs.sparkSession.range(BUCKETS).select(F.col("id").alias("bucket"), F.lit(None).cast("bigint").alias("term")))
    by = Window.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)        # over BUCKETS rows
    held = placed.groupBy("bucket").agg(F.collect_list("term").alias("terms")).withColumn(
        "first", F.coalesce(F.sum(F.size("terms")).over(by), F.lit(0).cast("bigint")))
    every = F.sort_array(F.collect_list(F.struct("bucket", "first", "terms")))
    return stage_shared(held.agg(every.alias("every")).select(F.concat(
        F.transform("every", lambda x: x["first"]), F.array(F.aggregate("every", F.lit(0).cast("bigint"), lambda n, x: n + F.size(x["terms"]))),
        F.flatten(F.transform("every", lambda x: x["terms"]))).alias("lexicon")), "lexicon")


def _within(term: Column, lexicon: Column) -> Column:
    bucket = F.pmod(term, F.lit(BUCKETS)).cast("int")
    first, last = F.get(lexicon, bucket).cast("int"), F.get(lexicon, bucket + 1).cast("int")
    return F.array_contains(F.slice(lexicon, first + (BUCKETS + 2), last - first), term)


def _text(text_col: str) -> Column:
    return F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))


def with_fingerprint(rows: DataFrame, text: str, held: DataFrame, name: str) -> DataFrame:
    """``rows`` with the column ``name``, struct(whole bigint, parts array<int>): the hash of the text's terms in the
    lexicon ``held``, and of those in each subset, level by level (null for a subset without terms)."""
    given = [F.col(c) for c in rows.columns]
    # The lexicon is a column of its own, as a lambda may not hold a subquery.
    found = rows.select(*given, terms(F.col(text)).alias("terms"), held.scalar().alias("lexicon")).select(
        *given, "terms", F.filter("terms", lambda t: _within(t, F.col("lexicon"))).alias("inside"))
    held_terms = found.select(*given, F.when(F.size("inside") > 0, F.col("inside")).otherwise(F.col("terms")).alias("members"))
    # A term is in subset j of a level if its hash's last bits are j, so each subset is filtered from the one
    # above it that holds it.
    step, above, parts = held_terms, {0: "members"}, []
    for of, n in LEVELS:
        own = {j: f"level{of}_{j}" for j in range(n)}
        step = step.select(*given, "members", *parts, *[F.filter(above[j % len(above)], _ends_with(of, j)).alias(c)
                                                       for j, c in own.items()])
        above, parts = own, [*parts, *own.values()]
    empty = F.xxhash64(F.array().cast("array<bigint>"))
    hashes = [F.nullif(F.xxhash64(c), empty).bitwiseAND(F.lit(0x7FFFFFFF)).cast("int") for c in parts]
    return step.select(*given, F.struct(F.xxhash64("members").alias("whole"), F.array(*hashes).alias("parts")).alias(name))


def _ends_with(of: int, j: int) -> Callable[[Column], Column]:
    return lambda term: term.bitwiseAND(F.lit(of - 1)) == j


def written(print_: Column) -> Column:
    """A fingerprint as a string: 16 hexadecimal digits for the whole, 8 for each subset (``-`` without terms)."""
    def digits(x: Column, n: int) -> Column:
        return F.lpad(F.lower(F.hex(x)), n, "0")
    return F.concat_ws(".", digits(print_["whole"], 16), F.array_join(F.transform(
        print_["parts"], lambda x: F.coalesce(digits(x.cast("bigint"), 8), F.lit("-"))), "."))


def with_likeness(rows: DataFrame, a: str, b: str, name: str) -> DataFrame:
    """``rows`` with the likeness (0 to 1) of the fingerprints ``a`` and ``b``."""
    given = [F.col(c) for c in rows.columns]
    starts = accumulate([n for _, n in LEVELS], initial=1)
    same = F.zip_with(f"{a}.parts", f"{b}.parts", lambda x, y: F.when(
        x.isNotNull() | y.isNotNull(), F.when(x.eqNullSafe(y), F.lit(1)).otherwise(F.lit(0))))
    counted = rows.select(*given, same.alias("same")).select(*given, *[F.filter(
        F.slice("same", start, n), lambda x: x.isNotNull()).alias(f"level{of}") for start, (of, n) in zip(starts, LEVELS)])
    shares = [F.when(F.size(f"level{of}") >= (n // 2 if k else 1), F.aggregate(
        f"level{of}", F.lit(0), lambda s, y: s + y) / F.size(f"level{of}")) for k, (of, n) in enumerate(LEVELS)]
    best = F.coalesce(*reversed(shares), F.lit(0.0))
    return counted.select(*given, F.when(F.col(a) == F.col(b), F.lit(1.0)).otherwise(best).alias(name))


def id_ranges(docs: DataFrame, n: int, id_col: str) -> Column:
    """A range number for ``id`` and ``h`` that never falls as (id, h) grows, null ids being smallest: quantiles
    of the ids, each cut into parts of equal width; null ids by ``h``."""
    wanted = max(1, min(RANGES * PARTS, -(-n // RANGE_ROWS)))
    ranges = min(RANGES, wanted)
    parts = -(-wanted // ranges)
    c = F.col(f"`{id_col}`").cast("bigint")
    points = docs.agg(F.percentile_approx(c, [k / ranges for k in range(ranges + 1)], 10 * RANGES)).first()[0] or []
    inner = sorted(set(points[1:-1]))
    edges = [float(x) for x in [points[0], *inner, points[-1] + 1]] if points else [0.0, 1.0]
    r = range_id(F.col("id"), inner)
    lo, hi = (F.get(F.array(*[F.lit(x) for x in own]), r) for own in (edges[:-1], edges[1:]))
    part = F.greatest(F.lit(0), F.least(F.lit(parts - 1), F.floor((F.col("id") - lo) / F.greatest(hi - lo, F.lit(1.0)) * parts)))
    return F.when(F.col("id").isNull(), F.shiftright("h", 56) - 128).otherwise(r * parts + part).cast("bigint")


def with_next(docs: DataFrame, id_col: str, rows: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``rows`` of (id, text, h) with ``next``, a struct of the row after it by falling id (after the last: the first).
    ``rows`` adds columns that the struct shall have."""
    keyed = docs.withColumn("h", F.xxhash64("text"))
    n = docs.count()
    keyed = keyed.withColumn("range", id_ranges(docs, n, id_col))
    # The first row of each range (the largest id), and the range before it: RANGES x PARTS + 256 rows at most.
    tops = stage_shared(keyed.groupBy("range").agg(F.max(F.struct("id", "h")).alias("top")), "range_tops")
    by = Window.orderBy(F.col("range").desc())
    hosts = stage_shared(tops.select("range", "top", F.coalesce(F.lag("range").over(by), F.min("range").over(
        Window.partitionBy())).alias("host")), "range_hosts")
    placed = rows(keyed).join(small_side(hosts), "range").withColumn("at", F.explode(F.when(
        F.struct("id", "h").eqNullSafe(F.col("top")),
        F.array(F.struct(F.col("range"), F.lit(False).alias("guest")), F.struct(F.col("host").alias("range"), F.lit(True).alias("guest")))
        ).otherwise(F.array(F.struct(F.col("range"), F.lit(False).alias("guest")))))).drop("top", "host", "range")
    order = Window.partitionBy("at.range").orderBy("at.guest", F.col("id").desc_nulls_last(), F.col("h").desc(), F.col("text").desc())
    own = [c for c in placed.columns if c not in ("at", "h", "id")]
    return placed.withColumn("next", F.lead(F.struct(*own)).over(order)).where(~F.col("at.guest")).drop("at", "h")


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", low: float = LOW, high: float = HIGH) -> DataFrame:
    """One row per document: its fingerprint, that of its edited text (the last third replaced by the next
    document's beginning), and how like its own are the edited text's and the next document's."""
    slim = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), _text(text_col).alias("text"))
    held = lexicon(slim, "text", low, high)
    found = with_next(slim, "id", lambda rows: with_fingerprint(rows, "text", held, "own"))
    n = F.length("text")
    cut = F.floor(n / 3).cast("int")
    edited = found.select("id", "own", F.col("next.own").alias("after"), n.cast("bigint").alias("n_chars"), F.concat(
        F.substring("text", F.lit(1), n - cut), F.substring("next.text", F.lit(1), cut)).alias("edited"))
    made = with_fingerprint(edited, "edited", held, "changed")
    compared = with_likeness(with_likeness(made, "own", "changed", "near_edited"), "own", "after", "near_next")
    return compared.select(
        F.col("id").cast(docs.schema[id_col].dataType).alias(id_col), "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        written(F.col("own")).alias("fingerprint"), written(F.col("changed")).alias("edited_fingerprint"),
        "near_edited", "near_next")
