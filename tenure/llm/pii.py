"""Personal data (operator 9): base patterns and a skip-chain conditional random field.

Base matches (email, ip, card, phone) are found by pattern and validated.
Beyond them, a document's candidate tokens (white-space tokens with a digit or
``@``) form a graph: neighbours in the text share a chain edge, and tokens
whose key (digits of a number, or lower-cased letters and digits) is equal
share a skip edge however far apart they stand, each mention with the nearest
base matches of its key too.  Loopy sum-product messages, passed until they
settle, then give every token a marginal over {none, email, ip, card, phone}.  Tokens
inside base matches are observed, a match being one node whose key is the whole
match's, and split numbers that end as a match does are one node too.  A token outside them whose marginal for one
kind reaches ``THRESHOLD`` becomes a further span: so a number written once in
full is also found where it is repeated without its prefix or separators.

The potentials are trained here from the whole corpus: one pass counts token
shapes (a finite set of coarse features) against base kinds, and the kinds at
both ends of chain and skip edges.  Base matches are positive examples; a token
outside them is a negative one unless a skip edge joins it to a match, when it
may be a mention that the patterns miss, and is left out.  Node weights are a softmax regression over
those counts; edge weights are smoothed pointwise mutual information.  This is
piecewise training: each potential is fitted on its own, not all of them by the
field's likelihood.

Defined results: a null or empty text has no spans; identical documents get
identical spans, repeated rows each their own; without any base match in the
corpus no span is added, and none to a document without a base match of its own; of
kinds with equal marginals the first in the kinds' order is taken; a very long text
is read whole; an empty table gives no rows; other input columns pass ``find``
unchanged, whatever their names.
Spans are in code points, end exclusive.
"""

from __future__ import annotations

import re
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tenure.llm.common import append_columns, fresh

KINDS = ["email", "ip", "card", "phone"]
THRESHOLD = 0.9
TOLERANCE, DAMPING = 1e-4, 0.3
MIN_KEY = 6         # characters of a key that a skip edge may join
TAIL = 7            # last digits of a number that are its second key

_HAS = re.compile(rb"[0-9@]")
_MAILBOX = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
# A match can only start at the start of a digit run; saying so keeps long runs linear.
_IP = re.compile(r"(?<![0-9])([0-9]++)\.([0-9]++)\.([0-9]++)\.([0-9]++)")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TOKEN = re.compile(r"[^\s]*[0-9@][^\s]*")
_GAP = re.compile(r"[ ().-]{1,3}")      # between the parts of one number
_EDGES = "\"'()[]{}<>,;:.!?"


def digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(number: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(number)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """Leftmost non-overlapping matches of mailbox@label(.label)+, found from each ``@`` outwards."""
    out, free, at = [], 0, text.find("@")
    while at >= 0:
        before = text[free:at]
        start = free + len(before.rstrip(_MAILBOX))
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, m.end()))
        free = m.end() if m else at + 1
        at = text.find("@", free)
    return out


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base matches, sorted."""
    out = [(s, 0, e) for s, e in emails(text)]
    out += [(m.start(), 1, m.end()) for m in _IP.finditer(text)
            if all(len(p := g.lstrip("0")) <= 3 and int(p or 0) <= 255 for g in m.groups())]
    for m in _CARD.finditer(text):
        number = digits(m.group())
        if 14 <= len(number) <= 19 and luhn(number):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        out += [(m.start(), 3, m.end()) for m in _PHONE.finditer(text) if 10 <= len(digits(m.group())) <= 15]
    return sorted(out)


def tokens_of(text: str) -> list[tuple[int, int, str]]:
    """(start, end, token) of the candidate tokens, without punctuation at their edges."""
    out = []
    for m in _TOKEN.finditer(text):
        token = m.group()
        left = len(token) - len(token.lstrip(_EDGES))
        token = token.strip(_EDGES)
        if token:
            out.append((m.start() + left, m.start() + left + len(token), token))
    return out


def numeric(token: str) -> bool:
    return all(c in "0123456789+-().  " for c in token)


def key_of(token: str) -> str:
    """What repeated or similar mentions have in common."""
    return digits(token) if numeric(token) else "".join(c for c in token.lower() if c.isalnum() or c == "@")


def shape(token: str) -> int:
    """A token's coarse features as one number below SHAPES."""
    n, number = len(token), digits(token)
    d = min(len(number), 17)
    letters = sum(c.isalpha() for c in token)
    email = 2 if "." in token.partition("@")[2] else 1 if "@" in token else 0
    parts = token.split(".")
    dotted = 2 if len(parts) == 4 and all(p.isascii() and p.isdigit() and len(p) <= 3 and int(p) <= 255
                                          for p in parts) else 1 if len(parts) > 1 else 0
    kind = 0 if letters == 0 else 1 if letters * 2 < n else 2
    card = int(14 <= len(number) <= 19 and letters == 0 and luhn(number))
    mark = 2 if token[0] == "+" else 1 if "-" in token else 0
    return ((((d * 3 + email) * 3 + dotted) * 3 + kind) * 2 + card) * 3 + mark


SHAPES = 18 * 3 * 3 * 3 * 2 * 3


def observe(tokens, spans) -> list[int]:
    """Per token: 1 + the kind of the base match that it touches, or 0."""
    out, k = [], 0
    for start, end, _ in tokens:
        while k < len(spans) and spans[k][2] <= start:
            k += 1
        out.append(next((1 + kind for s, kind, e in spans[k:k + 4] if s < end and start < e), 0))
    return out


def nodes_of(text, spans, tokens, kinds) -> tuple[list[tuple[int, int, str]], list[int]]:
    """The nodes of inference and 1 + the kind of each, or 0: every base match as a whole, and the tokens
    that touch none.  Adjacent tokens of digits are one node where together they are the end (``TAIL``
    digits or more, without leading zeros) of a card or phone match: a mention with other separators."""
    numbers = [digits(text[s:e]) for s, k, e in spans if KINDS[k] in ("card", "phone")]
    ends = {n[-size:] for n in numbers for size in range(TAIL, len(n) + 1)}
    longest = max(map(len, numbers), default=0)
    nodes = [(s, e, text[s:e], 1 + k) for s, k, e in spans]
    free, i = [t for t, k in zip(tokens, kinds) if not k], 0
    while i < len(free):
        start, end, token = free[i]
        at, j = end, i + 1
        number = digits(token) if ends and numeric(token) else ""
        i += 1
        while number and j < len(free) and len(number.lstrip("0")) < longest and j - i < 2 * longest:
            s, e, part = free[j]
            if s - at > 3 or not numeric(part) or not _GAP.fullmatch(text, at, s):
                break
            number, at, j = number + digits(part), e, j + 1
            if number.lstrip("0") in ends:
                end, i = at, j
        nodes.append((start, end, text[start:end], 0))
    nodes.sort(key=lambda n: (n[0], n[1], n[3]))
    return [n[:3] for n in nodes], [n[3] for n in nodes]


def places_of(tokens) -> list[list[int]]:
    """The occurrences of every key that a skip edge may join."""
    places: dict[str, list[int]] = {}
    for i, (_, _, token) in enumerate(tokens):
        key = key_of(token)
        if len(key) >= MIN_KEY:
            # A number's key also meets longer numbers that end in it: the last digits are its second key.
            for k in {key, key[-TAIL:]} if key.isdigit() else {key}:
                places.setdefault(k, []).append(i)
    return list(places.values())


def graph(tokens) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """Chain edges (adjacent candidate tokens with at most a space and punctuation between) and skip
    edges (each occurrence of a key with the one before it: linear, however often the key occurs)."""
    chain = [(i, i + 1) for i, (a, b) in enumerate(zip(tokens, tokens[1:])) if b[0] - a[1] <= 3]
    return chain, [e for own in places_of(tokens) for e in zip(own, own[1:])]


def far_edges(tokens, kinds) -> list[tuple[int, int]]:
    """Further skip edges for inference: each occurrence outside the base matches with the nearest match of
    its key on either side that is not its neighbour, however many mentions away.  At most two an occurrence."""
    out = set()
    for own in places_of(tokens):
        for way in (1, -1):
            match = None
            for at, i in enumerate(own[::way]):
                if kinds[i]:
                    match = at, i
                elif match and at - match[0] > 1:
                    out.add((min(i, match[1]), max(i, match[1])))
    return sorted(out)


def training_counts(docs: DataFrame, text_col: str = "text") -> list:
    """Counts over all documents: ("node", shape, kind), ("chain", kind, kind), ("skip", kind, kind).
    Their number is bounded by the features, not by the corpus."""
    def count(batches):
        seen: Counter = Counter()
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                if not raw or not _HAS.search(raw):
                    continue
                text = raw.decode()
                tokens = tokens_of(text)
                spans = base_spans(text)
                kinds = observe(tokens, spans)
                nodes, held = nodes_of(text, spans, tokens, kinds)
                chain, skip = graph(nodes)
                # Beside a base match, a token without one may be a mention that the patterns miss: no example.
                unsure = {n for i, j in skip if bool(held[i]) != bool(held[j]) for n in (i, j) if not held[n]}
                areas, at = [nodes[n] for n in sorted(unsure)], 0
                for (start, end, t), k in zip(tokens, kinds):
                    while at < len(areas) and areas[at][1] <= start:
                        at += 1
                    if k or at == len(areas) or areas[at][0] >= end:
                        seen["node", shape(t), k] += 1
                for name, edges in (("chain", chain), ("skip", skip)):
                    for i, j in edges:
                        if i not in unsure and j not in unsure:
                            seen[name, held[i], held[j]] += 1
                            seen[name, held[j], held[i]] += 1
        keys = list(seen)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k[0] for k in keys], pa.string()), pa.array([k[1] for k in keys], pa.int64()),
             pa.array([k[2] for k in keys], pa.int64()), pa.array([seen[k] for k in keys], pa.int64())],
            names=["part", "a", "b", "n"])

    sent = docs.select(F.col(f"`{text_col}`").cast("string").cast("binary").alias("text"))
    return sent.mapInArrow(count, "part string, a bigint, b bigint, n bigint").groupBy("part", "a", "b").agg(
        F.sum("n").alias("n")).collect()


class Field:
    """Trained potentials (log scale) and inference."""

    def __init__(self, counts):
        k = len(KINDS) + 1
        node = np.zeros((SHAPES, k))
        edges = {"chain": np.zeros((k, k)), "skip": np.zeros((k, k))}
        for r in counts:
            (node if r["part"] == "node" else edges[r["part"]])[r["a"], r["b"]] += r["n"]
        self.node = _softmax_regression(node)
        self.edge = {name: _association(c) for name, c in edges.items()}

    def marginals(self, shapes: list[int], observed: list[int], chain, skip) -> np.ndarray:
        """Loopy sum-product until no message moves by ``TOLERANCE``, or for as many rounds as a message
        needs along the longest path and back: one row per token, over none and the kinds."""
        k = self.node.shape[1]
        unary = self.node[np.asarray(shapes, np.int64)].copy()
        seen = np.asarray(observed, np.int64)
        held = np.flatnonzero(seen)
        unary[held] = -30.0
        unary[held, seen[held]] = 0.0
        pairs = np.array(list(chain) + list(skip), np.int64).reshape(-1, 2)
        if not len(pairs):
            return _normal(unary)
        weight = np.concatenate([np.broadcast_to(self.edge["chain"], (len(chain), k, k)),
                                 np.broadcast_to(self.edge["skip"], (len(skip), k, k))])
        # Both directions of every edge; the reverse of message m is m + len(pairs), and back.
        src, dst = np.concatenate([pairs[:, 0], pairs[:, 1]]), np.concatenate([pairs[:, 1], pairs[:, 0]])
        weight = np.concatenate([weight, weight.transpose(0, 2, 1)])
        back = np.roll(np.arange(len(src)), len(pairs))
        messages = np.zeros((len(src), k))
        for _ in range(2 * len(unary) + 10):
            belief = unary.copy()
            np.add.at(belief, dst, messages)
            sent = belief[src] - messages[back]
            new = (sent[:, :, None] + weight)
            top = new.max(axis=1)
            new = top + np.log(np.exp(new - top[:, None, :]).sum(axis=1))
            new -= new.max(axis=1, keepdims=True)
            moved = np.abs(new - messages).max()
            messages = DAMPING * messages + (1 - DAMPING) * new
            if moved < TOLERANCE:
                break
        belief = unary.copy()
        np.add.at(belief, dst, messages)
        return _normal(belief)

    def added_spans(self, text: str, spans) -> list[tuple[int, int, int]]:
        """Further (start, kind, end), outside the base matches."""
        tokens = tokens_of(text)
        touched = observe(tokens, spans)
        if not any(touched) or all(touched):
            return []       # nothing to be consistent with, or nothing to decide
        tokens, observed = nodes_of(text, spans, tokens, touched)
        chain, skip = graph(tokens)
        skip = skip + far_edges(tokens, observed)
        p = self.marginals([shape(t) for _, _, t in tokens], observed, chain, skip)
        best = p[:, 1:].argmax(axis=1)
        return [(s, int(best[i]), e) for i, (s, e, _) in enumerate(tokens)
                if not observed[i] and p[i, 1 + best[i]] >= THRESHOLD]


def _normal(log: np.ndarray) -> np.ndarray:
    e = np.exp(log - log.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _softmax_regression(counts: np.ndarray, steps: int = 300, rate: float = 1.0, ridge: float = 1e-3) -> np.ndarray:
    """Log-potentials of every shape, from the shape's one-hot features, by full-batch gradient ascent."""
    k = counts.shape[1]
    sizes = [18, 3, 3, 3, 2, 3]
    grid = np.stack(np.unravel_index(np.arange(len(counts)), sizes), axis=1)
    offsets = np.concatenate([[0], np.cumsum(sizes)[:-1]])
    x = np.zeros((len(counts), sum(sizes) + 1))
    np.put_along_axis(x, grid + offsets, 1.0, axis=1)
    x[:, -1] = 1.0
    total = counts.sum()
    w = np.zeros((x.shape[1], k))
    if total:
        used = counts.sum(axis=1) > 0
        xu, share = x[used], counts[used] / total
        for _ in range(steps):
            p = _normal(xu @ w)
            w += rate * (xu.T @ (share - share.sum(axis=1, keepdims=True) * p) - ridge * w)
    else:
        w[-1, 0] = 10.0     # nothing seen: none
    log = x @ w
    return log - log.max(axis=1, keepdims=True)


def _association(counts: np.ndarray) -> np.ndarray:
    """Smoothed pointwise mutual information of the kinds at an edge's ends."""
    p = (counts + 0.5) / (counts.sum() + 0.5 * counts.size)
    return np.log(p / (p.sum(axis=1, keepdims=True) * p.sum(axis=0, keepdims=True)))


def joined(spans) -> str:
    return ",".join(f"{KINDS[k]}:{s}:{e}" for s, k, e in spans)


def find(docs: DataFrame, text_col: str = "text", keep_text: bool = True) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with the spans found, and the column names these got: ``base`` and ``spans``
    (kind:start:end, by start then kind, comma-joined) and a count per kind of base matches."""
    field = Field(training_counts(docs, text_col))
    names = dict(zip(["base", "spans", *KINDS], fresh(docs, "base", "spans", *[f"n_{k}" for k in KINDS])))

    def row(raw):
        if not raw or not _HAS.search(raw):
            return "", "", 0, 0, 0, 0
        text = raw.decode()
        base = base_spans(text)
        every = sorted(set(base) | set(field.added_spans(text, base)))
        return joined(base), joined(every), *[sum(k == i for _, k, _ in base) for i in range(len(KINDS))]

    def make():
        return lambda texts: list(zip(*map(row, texts))) or [[]] * len(names)

    fields = [(names["base"], T.StringType()), (names["spans"], T.StringType())]
    fields += [(names[k], T.LongType()) for k in KINDS]
    return append_columns(docs, text_col, fields, make, keep_text), names


def personal_data(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: base counts, the base spans' SHA-256 and all ``spans``."""
    narrow = docs.select(F.col(f"`{id_col}`").alias(id_col), F.col(f"`{text_col}`").alias("document_text"))
    made, c = find(narrow, "document_text", keep_text=False)
    return made.select(id_col, *[F.col(c[k]).alias(f"n_{k}") for k in KINDS],
                       F.sha2(c["base"], 256).alias("base_sha256"), F.col(c["spans"]).alias("spans"))
