"""Secret scans (operator 5), in DataFrame functions only.

Base secrets are found by pattern.  Beyond them, candidate strings (long runs
of key characters that hold a digit and a letter) are swept by a window of
``WINDOW`` characters: the count of each character is kept as the window
moves by one (one count up, one down), and with it the sum of ``c * log2(c)``,
from which the window's Shannon entropy follows.  The sum is held in
millionths as a whole number, so it never drifts.  A window is hot when its
entropy reaches the threshold of the candidate's character class (hex, alnum,
base64); the stretch from the first hot window's start to the last one's end is
a further span, unless an allow-list pattern matches the whole candidate or a base
match already covers the stretch.  Allowed parts of a candidate (placeholder words,
runs) suppress the windows that overlap them; what is left is swept part by part.

Everything is one pass over the rows: no shuffle, no Python on the executors.
Positions come from splitting the text at the pattern: the lengths of the
pieces and of the matches between them, summed up, are each match's offset.
These sums are built in blocks (``running``), the counts of a window are packed
into a few whole numbers, and no pattern repeats a group, so time and memory
are linear in a text's length, however long it, a candidate or its lists are.

Defined results: a null or empty text has no spans; an empty table no rows;
equal texts (repeated rows, ties) get equal spans; a very long text is scanned
whole; spans are in code points, end exclusive; only the id and text columns
are read, so no other column's name can clash.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The base patterns.
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_WORDS = ["password", "passwd", "secret", "token", "apikey", "api_key"]
ASSIGN_MIN = 12
ACCESS = r"AKIA[A-Z0-9]{14,}"        # 18 or more characters; a shorter run holds no longer one
HEX = r"[0-9a-f]{16,}"
KINDS = ["assign", "access", "hex", "entropy"]

WINDOW = 20
THRESHOLDS = {"hex": 3.0, "alnum": 3.6, "base64": 3.8}
CANDIDATE = r"(?<![A-Za-z0-9+/_-])(?=[0-9+/_-]*[A-Za-z])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}={0,2}"
# Candidates that are known, as a whole, not to be secrets: identifiers, placeholders, and paths of names
# (two or more segments like this, each with its slash; a first or last one may be empty).
ALLOW_LIST = [
    r"^[0-9A-Fa-f]{8}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{4}-[0-9A-Fa-f]{12}$",
    r"(?i)^(?:example|sample|dummy|placeholder|changeme|redacted|your[_-])[^/]*$",
]
PATH_SEGMENT = r"^[A-Za-z_-]+[0-9]{0,4}$"
# Parts of a candidate that are no part of a secret: placeholder words, runs of the alphabet or of one character.
ALLOWED_PARTS = (r"(?i:example|sample|dummy|placeholder|changeme|redacted|your[_-])|(?i:0123456789|abcdefghij)"
                 r"|(.)\1{5,}")
SCALE = 1_000_000
BLOCK, LEVELS = 64, 3               # of ``running``: linear up to 64 to the power of 4 entries
FIRST, SYMBOLS = ord("+"), ord("z") - ord("+") + 1      # codes of the candidates' characters
BITS, PER_LONG = 5, 12              # a packed count (a window holds at most 31 of a character), counts to a long


def bind(c: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that is computed once, however often ``f`` uses it."""
    return F.get(F.transform(F.array(c), f), F.lit(0))


def running(values: Column, merge: Callable[[Column, Column], Column], zero: Column, kind: str = "int",
            levels: int = LEVELS) -> Column:
    """For each entry of an array, ``merge`` of all entries before it (``zero`` for the first).

    Appending to an array copies it, so entries are taken in blocks of ``BLOCK`` and the blocks' totals are
    treated the same way a level up: a fixed number of copies for each entry.
    """
    none = F.array().cast(f"array<{kind}>")

    def direct(block: Column) -> Column:
        start = F.struct(zero.cast(kind).alias("at"), none.alias("out"))
        return F.aggregate(block, start, lambda acc, x: F.struct(
            merge(acc["at"], x).cast(kind).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")),
            lambda acc: acc["out"])

    if levels == 0:
        return direct(values)

    def in_blocks(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), ((F.size(v) - 1) / BLOCK).cast("int")),
                             lambda b: F.slice(v, b * BLOCK + 1, F.lit(BLOCK)))
        return bind(blocks, lambda bs: bind(
            running(F.transform(bs, lambda x: F.aggregate(x, zero.cast(kind), lambda acc, y: merge(acc, y).cast(kind))),
                    merge, zero, kind, levels - 1),
            lambda before: F.flatten(F.transform(bs, lambda x, i: F.transform(
                direct(x), lambda y: merge(F.get(before, i), y).cast(kind))))))

    return bind(values, lambda v: F.when(F.size(v) <= BLOCK, direct(v)).otherwise(in_blocks(v)))


def _sum(a: Column, b: Column) -> Column:
    return a + b


def places(text: Column, pattern: str, when: Column) -> Column:
    """Array of (start, end, match) of the leftmost non-overlapping matches, empty unless ``when``."""
    pieces, found = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    none = F.array().cast("array<struct<start:int,end:int,match:string>>")
    # (gap before, match) pairs; the piece after the last match has none.
    pairs = F.filter(F.zip_with(pieces, found, lambda p, m: F.struct(
        F.length(p).alias("gap"), F.length(m).alias("size"), m.alias("match"))), lambda x: x["match"].isNotNull())
    placed = bind(pairs, lambda xs: F.zip_with(
        xs, running(F.transform(xs, lambda x: x["gap"] + x["size"]), _sum, F.lit(0)), lambda x, at: F.struct(
            (at + x["gap"]).alias("start"), (at + x["gap"] + x["size"]).alias("end"), x["match"].alias("match"))))
    return F.when(when, placed).otherwise(none)


def _spans(kind: str, found: Column) -> Column:
    return F.transform(found, lambda m: F.struct(
        m["start"].alias("start"), F.lit(KINDS.index(kind)).alias("kind"), m["end"].alias("end")))


def parts(candidate: Column, pattern: str = ALLOWED_PARTS) -> Column:
    """Array of (at, part): what is left of a candidate between its allowed parts."""
    pairs = F.zip_with(F.split(candidate, pattern, -1), F.regexp_extract_all(candidate, F.lit(pattern), F.lit(0)),
                       lambda p, m: F.struct(p.alias("part"), (F.length(p) + F.coalesce(F.length(m), F.lit(0))).alias("size")))
    return bind(pairs, lambda xs: F.zip_with(
        xs, running(F.transform(xs, lambda x: x["size"]), _sum, F.lit(0)),
        lambda x, at: F.struct(at.alias("at"), x["part"].alias("part"))))


def most_sum(candidate: Column, window: int, thresholds: dict[str, float]) -> Column:
    """The largest sum of ``c * log2(c)``, in millionths, of a window whose entropy reaches the threshold of the
    candidate's character class: entropy = log2(window) - sum / window."""
    most = {k: math.floor(SCALE * window * (math.log2(window) - t)) for k, t in thresholds.items()}
    return (F.when(candidate.rlike(r"^([0-9a-f]+|[0-9A-F]+)$"), F.lit(most["hex"]))
            .when(candidate.rlike(r"^[A-Za-z0-9]+$"), F.lit(most["alnum"]))
            .otherwise(F.lit(most["base64"]))).cast("long")


def hot_stretch(part: Column, limit: Column, window: int = WINDOW) -> Column:
    """struct(lo, hi) of the hot stretch in a candidate, or in a part of one, in characters; lo = -1 if no
    window's sum is at most ``limit``.  A step moves the window by one character: one count up, one down."""
    if not 1 < window < 1 << BITS:
        raise ValueError(f"a window has 2 to {(1 << BITS) - 1} characters")
    weighted = F.array(*[F.lit(round(SCALE * c * math.log2(c)) if c else 0).cast("long") for c in range(window + 2)])
    longs = range(-(-SYMBOLS // PER_LONG))
    codes = F.transform(F.filter(F.split(part, "", -1), lambda c: c != ""), lambda c: F.ascii(c) - FIRST)
    # Each step has the character that enters and the one that leaves (-1: none).
    steps = F.filter(F.zip_with(codes, F.concat(F.array_repeat(F.lit(-1), window), codes),
                                lambda a, b: F.struct(a.alias("enter"), b.alias("leave"))), lambda x: x["enter"].isNotNull())
    state = F.struct(*[F.lit(0).cast("long").alias(f"c{j}") for j in longs], F.lit(0).cast("long").alias("sum"),
                     F.lit(0).alias("i"), F.lit(-1).alias("lo"), F.lit(-1).alias("hi"), limit.alias("limit"))

    def count(acc: Column, code: Column) -> Column:
        packed = F.lit(0).cast("long")
        for j in longs:
            packed = F.when(F.floor(code / PER_LONG) == j, acc[f"c{j}"]).otherwise(packed)
        return F.call_function("shiftright", packed, _shift(code)).bitwiseAND(F.lit((1 << BITS) - 1)).cast("int")

    def moved(acc: Column, x: Column) -> Column:
        same, leaves = x["enter"] == x["leave"], x["leave"] >= 0
        up, down = count(acc, x["enter"]), count(acc, x["leave"])
        total = acc["sum"] + F.when(same, F.lit(0).cast("long")).otherwise(
            F.get(weighted, up + 1) - F.get(weighted, up)
            + F.when(leaves, F.get(weighted, down - 1) - F.get(weighted, down)).otherwise(F.lit(0).cast("long")))
        one = F.lit(1).cast("long")
        more, less = F.call_function("shiftleft", one, _shift(x["enter"])), F.call_function("shiftleft", one, _shift(x["leave"]))
        none = F.lit(0).cast("long")
        counts = [(acc[f"c{j}"] + F.when(F.floor(x["enter"] / PER_LONG) == j, more).otherwise(none)
                   - F.when(leaves & (F.floor(x["leave"] / PER_LONG) == j), less).otherwise(none)).alias(f"c{j}") for j in longs]
        hot = (acc["i"] >= window - 1) & (total <= acc["limit"])
        return F.struct(*counts, total.alias("sum"), (acc["i"] + 1).alias("i"),
                        F.when(hot & (acc["lo"] < 0), acc["i"] - (window - 1)).otherwise(acc["lo"]).alias("lo"),
                        F.when(hot, acc["i"] + 1).otherwise(acc["hi"]).alias("hi"), acc["limit"].alias("limit"))

    return F.aggregate(steps, state, moved, lambda acc: F.struct(acc["lo"].alias("lo"), acc["hi"].alias("hi")))


def _shift(code: Column) -> Column:
    return (F.lit(BITS) * F.pmod(code, F.lit(PER_LONG))).cast("int")


def allowed(candidate: Column, allow_list: list[str]) -> Column:
    out = bind(F.split(candidate, "/", -1), lambda xs: (F.size(xs) > 2 + F.when(F.get(xs, F.lit(0)) == "", 1).otherwise(0))
               & F.forall(F.transform(xs, lambda x, i: F.when((i == 0) | (i == F.size(xs) - 1), (x == "") | x.rlike(PATH_SEGMENT))
                                      .otherwise(x.rlike(PATH_SEGMENT))), lambda good: good))
    for pattern in allow_list:
        out = out | candidate.rlike(pattern)
    return out


def uncovered(base: Column, hot: Column) -> Column:
    """The spans of ``hot`` that lie inside no span of ``base``: a running maximum over both, by start."""
    def marked(spans: Column, flag: bool) -> Column:
        return F.transform(spans, lambda s: F.struct(
            s["start"].alias("start"), F.lit(flag).alias("hot"), s["end"].alias("end"), s["kind"].alias("kind")))

    both = F.array_sort(F.concat(marked(base, False), marked(hot, True)))
    ends = lambda xs: F.transform(xs, lambda s: F.when(s["hot"], F.lit(-1)).otherwise(s["end"]))
    left = bind(both, lambda xs: F.filter(F.zip_with(
        xs, running(ends(xs), F.greatest, F.lit(-1)), lambda s, end: F.when(s["hot"] & (end < s["end"]), s)),
        lambda s: s.isNotNull()))
    return F.transform(left, lambda s: F.struct(s["start"].alias("start"), s["kind"].alias("kind"), s["end"].alias("end")))


def find(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW,
         thresholds: dict[str, float] | None = None, allow_list: list[str] | None = None) -> DataFrame:
    """(id, base, more): sorted arrays of (start, kind index, end), of the base and of the entropy spans."""
    allow_list = ALLOW_LIST if allow_list is None else allow_list
    text = F.col("text")
    rows = docs.select(F.col(f"`{id_col}`").alias(id_col),
                       F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    lowered = F.lower(text)
    has_assign = F.lit(False)
    for w in ASSIGN_WORDS:
        has_assign = has_assign | F.contains(lowered, F.lit(w))
    found = rows.select(
        id_col,
        places(text, ASSIGN, has_assign).alias("assign"),
        places(text, ACCESS, F.contains(text, F.lit("AKIA"))).alias("access"),
        places(text, HEX, text.rlike(HEX)).alias("hex"),
        places(text, CANDIDATE, text.rlike(CANDIDATE)).alias("candidate"))
    long_value = F.filter("assign", lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 2)) >= ASSIGN_MIN)
    base = F.array_sort(F.concat(_spans("assign", long_value), _spans("access", F.col("access")),
                                 _spans("hex", F.col("hex"))))
    sums = thresholds or THRESHOLDS
    # The limit depends on the whole candidate, and is found once for all of its parts.
    kept = F.transform(F.filter("candidate", lambda m: ~allowed(m["match"], allow_list)), lambda m: F.struct(
        m["start"].alias("start"), m["match"].alias("match"), most_sum(m["match"], window, sums).alias("limit")))
    swept = F.filter(F.flatten(F.transform(
        kept, lambda m: F.transform(F.filter(parts(m["match"]), lambda p: F.length(p["part"]) >= window), lambda p: F.struct(
            (m["start"] + p["at"]).alias("at"), hot_stretch(p["part"], m["limit"], window).alias("hot"))))),
        lambda h: h["hot"]["lo"] >= 0)
    stretches = F.transform(swept, lambda h: F.struct(
        (h["at"] + h["hot"]["lo"]).alias("start"), F.lit(KINDS.index("entropy")).alias("kind"),
        (h["at"] + h["hot"]["hi"]).alias("end")))
    spans = found.select(id_col, base.alias("base"), F.when(F.size("candidate") > 0, stretches).otherwise(
        F.array().cast("array<struct<start:int,kind:int,end:int>>")).alias("hot"))
    return spans.select(id_col, "base", F.when(F.size("hot") > 0, uncovered(F.col("base"), F.col("hot"))).otherwise(
        F.col("hot")).alias("more"))


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(
        ":", F.get(names, s["kind"]), s["start"].cast("string"), s["end"].cast("string"))))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """One row per document: base counts, the base spans' SHA-256, all ``spans`` and ``n_entropy``."""
    def number(kind: str) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == KINDS.index(kind))).cast("long").alias(f"n_{kind}")

    return find(docs, id_col, text_col, **options).select(
        id_col, number("assign"), number("access"), number("hex"),
        F.sha2(_joined(F.col("base")), 256).alias("base_sha256"),
        _joined(F.array_sort(F.concat("base", "more"))).alias("spans"), F.size("more").cast("long").alias("n_entropy"))
