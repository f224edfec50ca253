"""Personal data: fixed patterns, and a skip-chain conditional random field over what resembles them.

Nodes of a document's field are its base spans, whose labels are given, and its candidates: runs of
digits and separators with ``LEAST_DIGITS`` digits or more, and words with an ``@``, that no base span
touches. A run of several numbers is cut where the digits of a base span of the document begin or end.
Linear edges join nodes that follow each other closely. Skip edges join each node to the next one with
the same key (the address, or the last ``KEY_DIGITS`` digits), however distant; similarity edges, with a
weight of their own, to the next one that only resembles it (the same user of another host, or the
same last ``LEAST_DIGITS`` digits, as of a local form and its full number). Nodes joined by an edge share a
Potts potential, and loopy belief propagation carries the evidence of one mention to the others of
its document. A candidate gets a label if its belief reaches ``BELIEF``.

Weights are fitted by pseudo-likelihood, with base spans as labels, on the nodes of all documents. A
candidate counts as no entity, but one that repeats or resembles a base span is left out, as nobody knows
its label. Equal nodes are counted first and fitted once with their count; a node has at most two
neighbours of each kind, so the distinct nodes are bounded whatever the number of documents.
"""

from __future__ import annotations

import bisect
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import release, text_parts
from .spans import SPAN_TYPE, by_start

KINDS = ["email", "ip", "card", "phone"]
LEAST_DIGITS = 7
KEY_DIGITS = 9
NEAR_CHARS = 24
BELIEF = 0.8
ROUNDS = 12
# Priors of the weights. Two mentions that share seven digits or a user by chance are about one in thousands or fewer.
_SKIP_MEAN, _LIKE_MEAN, _CHAIN_MEAN, _RIDGE = 8.0, 8.0, 0.0, 0.02

# The base patterns. An address is matched from its @ to the right, see _emails.
_AT_HOST = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_USER = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOTTED = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_DIGITS = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PLUS = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_CARD_DIGITS, _PHONE_DIGITS = (14, 19), (10, 15)

_NUMBER = re.compile(r"\(?[0-9](?:[\x20().-]{0,3}[0-9])*")
_GROUP = re.compile(r"[0-9]+")
#: Groups of digits of one number, at most.
_MOST_GROUPS = 8
_WORD = re.compile(r"[^\x20\x09-\x0D]*")
_ANY = re.compile(r"[0-9@]")
# Words whose company suggests a kind.
_CUES = {"email": "email e-mail mail contact write".split(), "ip": "ip host server address".split(), "card": "card visa mastercard credit account".split(), "phone": "phone tel call mobile fax telephone".split()}

Span = tuple[str, int, int, bool]


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost matches of user@host: the user part is read leftwards from each @, in linear time."""
    done, at = 0, text.find("@")
    while at != -1:
        start = at
        while start > done and text[start - 1] in _USER:
            start -= 1
        found = _AT_HOST.match(text, at) if start < at else None
        if found:
            yield start, found.end()
            done = found.end()
        else:
            done = at + 1
        at = text.find("@", done)


def _addresses(text: str) -> Iterator[tuple[int, int]]:
    """Leftmost groups of four in each run of numbers joined by dots."""
    for run in _DOTTED.finditer(text):
        parts, at = run.group().split("."), run.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            size = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + size
            at += size + 1


def base_spans(text: str) -> list[Span]:
    found: list[Span] = [("email", a, b, True) for a, b in _emails(text)] if "@" in text else []
    found += [("ip", a, b, True) for a, b in _addresses(text)]
    for m in _DIGITS.finditer(text):
        if m.end() - m.start() >= _CARD_DIGITS[0]:
            digits = m.group().replace(" ", "").replace("-", "")
            if _CARD_DIGITS[0] <= len(digits) <= _CARD_DIGITS[1] and luhn(digits):
                found.append(("card", *m.span(), True))
    if "+" in text:
        for m in _PLUS.finditer(text):
            if _PHONE_DIGITS[0] <= sum(map(str.isdigit, m.group())) <= _PHONE_DIGITS[1]:
                found.append(("phone", *m.span(), True))
    return found


def _digits(part: str) -> str:
    return "".join(c for c in part if "0" <= c <= "9")


def _known_endings(text: str, base: list[Span]) -> set[str]:
    """Every ending of ``LEAST_DIGITS`` digits or more of the document's cards and telephone numbers."""
    numbers = {_digits(text[a:b]) for k, a, b, _ in base if k in ("card", "phone")}
    return {n[-size:] for n in numbers for size in range(LEAST_DIGITS, len(n) + 1)}


def _cut_number(text: str, start: int, end: int, known: set[str]) -> list[tuple[int, int]]:
    """The run at ``start``, cut where some of its groups of digits make up a known number or its ending.

    The longest such stretch is taken first; what is left on either side stands on its own.
    """
    groups = [(start + m.start(), start + m.end()) for m in _GROUP.finditer(text[start:end])]
    out, i, left = [], 0, 0

    def rest(a: int, b: int) -> None:
        if b > a and sum(y - x for x, y in groups[a:b]) >= LEAST_DIGITS:
            out.append((start if a == 0 else groups[a][0], groups[b - 1][1]))

    while i < len(groups):
        for j in range(min(len(groups), i + _MOST_GROUPS), i, -1):
            # a number may carry a prefix that its other mention has not
            digits = "".join([text[x:y] for x, y in groups[i:j]])
            if digits in known or digits.lstrip("0") in known or len(digits) >= KEY_DIGITS and digits[-KEY_DIGITS:] in known:
                rest(left, i)
                out.append((start if i == 0 else groups[i][0], groups[j - 1][1]))
                i = left = j
                break
        else:
            i += 1
    rest(left, len(groups))
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """What resembles an entity and touches no base span, by start."""
    found = [m.span() for m in _NUMBER.finditer(text) if m.end() - m.start() >= LEAST_DIGITS and sum(map(str.isdigit, m.group())) >= LEAST_DIGITS]
    if found and (known := _known_endings(text, base)):
        found = [part for a, b in found for part in _cut_number(text, a, b, known)]
    at = text.find("@")
    while at != -1:
        start = at
        while start and not ("\t" <= text[start - 1] <= "\r" or text[start - 1] == " "):
            start -= 1
        end = _WORD.match(text, at).end()
        found.append((start, end))
        at = text.find("@", end)
    taken = sorted((a, b) for _, a, b, _ in base)
    reach = list(np.maximum.accumulate([b for _, b in taken])) if taken else []
    out: list[tuple[int, int]] = []
    for a, b in sorted(found):
        k = bisect.bisect_left(taken, (b, -1))
        if (not k or reach[k - 1] <= a) and (not out or out[-1][1] <= a):
            out.append((a, b))
    return out


FEATURES = ["bias", "at", "host", "digits7", "digits10", "digits14", "digits20", "plus", "paren", "four", "bytes", "luhn", "dash", *(f"cue_{k}" for k in KINDS)]


def features(text: str, start: int, end: int) -> list[bool]:
    part = text[start:end]
    digits = "".join(c for c in part if "0" <= c <= "9")
    n, at = len(digits), "@" in part
    numbers = part.split(".")
    four = not at and len(numbers) == 4 and all(p.isdigit() for p in numbers)
    company = text[max(0, start - NEAR_CHARS) : start].lower().split()
    host = at and "." in part.rpartition("@")[2].strip(".")
    return [
        True, at, host, not at and n < 10, not at and 10 <= n < 14, not at and 14 <= n < 20, not at and n >= 20, part[0] == "+", "(" in part,
        four, four and all(len(p) < 4 and int(p) < 256 for p in numbers), not at and 14 <= n < 20 and luhn(digits), "-" in part,
        *(any(w.strip(".,:;()") in _CUES[k] for w in company) for k in KINDS),
    ]


def _key(part: str) -> str:
    """Mentions with the same key are taken for the same thing."""
    if "@" in part:
        return part.lower().strip(".,:;()<>[]\"'")
    return part if part.count(".") == 3 else _digits(part)[-KEY_DIGITS:]


def _likeness(part: str) -> str:
    """Mentions of another key but the same likeness resemble each other; empty if it says nothing."""
    if "@" in part:
        return _key(part).partition("@")[0] + "@"
    return "" if part.count(".") == 3 else _digits(part)[-LEAST_DIGITS:]


@dataclass
class Field:
    """Nodes by start: spans, label (0: none, k + 1: KINDS[k]), whether it is given, features, and edges."""

    spans: list[tuple[int, int]]
    label: np.ndarray
    given: np.ndarray
    features: np.ndarray
    chain: np.ndarray
    skip: np.ndarray
    like: np.ndarray = field(default_factory=lambda: np.zeros((0, 2), np.int64))


def field_of(text: str, base: list[Span], loose: list[tuple[int, int]]) -> Field:
    nodes = sorted([(a, b, KINDS.index(k) + 1) for k, a, b, _ in base] + [(a, b, 0) for a, b in loose])
    chain = [(i, i + 1) for i in range(len(nodes) - 1) if nodes[i + 1][0] - nodes[i][1] <= NEAR_CHARS]
    skip, like, last = [], [], {}
    seen: dict[str, tuple[int, str]] = {}
    for i, (a, b, _) in enumerate(nodes):
        key, likeness = _key(text[a:b]), _likeness(text[a:b])
        if key in last:
            skip.append((last[key], i))
        last[key] = i
        if len(likeness) > 1:
            if likeness in seen and seen[likeness][1] != key:
                like.append((seen[likeness][0], i))
            seen[likeness] = (i, key)
    label = np.array([n[2] for n in nodes], np.int64)
    return Field(
        [(a, b) for a, b, _ in nodes], label, label > 0,
        np.array([features(text, a, b) for a, b, _ in nodes], np.float64).reshape(len(nodes), len(FEATURES)),
        np.array(chain, np.int64).reshape(-1, 2), np.array(skip, np.int64).reshape(-1, 2), np.array(like, np.int64).reshape(-1, 2),
    )


@dataclass(frozen=True)
class Weights:
    """unary: features x labels; chain, skip and like: what equal labels on an edge add."""

    unary: np.ndarray
    chain: float
    skip: float
    like: float = 0.0


def _log_sum(x: np.ndarray) -> np.ndarray:
    top = x.max(axis=1, keepdims=True)
    return top + np.log(np.exp(x - top).sum(axis=1, keepdims=True))


def beliefs(field: Field, weights: Weights) -> np.ndarray:
    """Posterior of each label at each node, by loopy sum-product in parallel rounds with damping."""
    unary = field.features @ weights.unary
    unary[field.given] = -50.0
    unary[field.given, field.label[field.given]] = 0.0
    one_way = np.concatenate([field.chain, field.skip, field.like])
    strength = np.repeat([weights.chain, weights.skip, weights.like], [len(field.chain), len(field.skip), len(field.like)])
    edges = np.concatenate([one_way, one_way[:, ::-1]])
    gain = np.expm1(np.concatenate([strength, strength]))[:, None]
    back = np.roll(np.arange(len(edges)), len(one_way))
    messages = np.zeros((len(edges), unary.shape[1]))
    for _ in range(ROUNDS):
        total = unary.copy()
        np.add.at(total, edges[:, 1], messages)
        sent = total[edges[:, 0]] - messages[back]
        share = np.exp(sent - _log_sum(sent)) if len(edges) else sent
        # a Potts factor: every label plus an extra for the same one
        new = np.log(np.maximum(1 + gain * share, 1e-12))
        messages = 0.5 * messages + 0.5 * (new - new.mean(axis=1, keepdims=True))
    total = unary.copy()
    np.add.at(total, edges[:, 1], messages)
    return np.exp(total - _log_sum(total))


def scan_text(text: str, weights: Weights) -> list[Span]:
    """Base spans and the candidates that the field labels, by start and kind."""
    if not _ANY.search(text):
        return []
    base = base_spans(text)
    loose = candidates(text, base)
    if loose:
        field = field_of(text, base, loose)
        posterior = beliefs(field, weights)
        best = posterior.argmax(axis=1)
        sure = ~field.given & (best > 0) & (posterior.max(axis=1) >= BELIEF)
        base += [(KINDS[best[i] - 1], *field.spans[i], False) for i in np.nonzero(sure)[0].tolist()]
    return by_start(base, KINDS)


def fit(
    unary: np.ndarray, near: np.ndarray, same: np.ndarray, label: np.ndarray, steps: int = 400, rate: float = 0.5,
    count: np.ndarray | None = None, alike: np.ndarray | None = None,
) -> Weights:
    """Pseudo-likelihood: each node given its neighbours' labels (counts by label along the kinds of edge).

    A row stands for ``count`` equal nodes, for one by default.
    """
    labels = len(KINDS) + 1
    weights, chain, skip, like = np.zeros((unary.shape[1], labels)), _CHAIN_MEAN, _SKIP_MEAN, _LIKE_MEAN
    alike = np.zeros_like(same) if alike is None else alike
    truth = np.eye(labels)[label]
    count = np.ones(len(label)) if count is None else count
    share = count[:, None] / max(1, count.sum())
    for _ in range(steps if len(label) else 0):
        score = unary @ weights + chain * near + skip * same + like * alike
        off = (np.exp(score - _log_sum(score)) - truth) * share
        weights -= rate * (unary.T @ off + _RIDGE / 10 * weights)
        chain -= rate * ((near * off).sum() + _RIDGE * (chain - _CHAIN_MEAN))
        skip -= rate * ((same * off).sum() + _RIDGE * (skip - _SKIP_MEAN))
        like -= rate * ((alike * off).sum() + _RIDGE * (like - _LIKE_MEAN))
    return Weights(weights, max(0.0, float(chain)), max(0.0, float(skip)), max(0.0, float(like)))


def train(docs: DataFrame, text_col: str = "text") -> Weights:
    """Weights from the nodes of all documents; without any node all weights are their priors'."""

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter[tuple[float, ...]] = Counter()
        for batch in batches:
            for text in (t for _, part in text_parts(batch.column(0)) for t in part):
                if not _ANY.search(text):
                    continue
                base = base_spans(text)
                field = field_of(text, base, candidates(text, base))
                eye = np.eye(len(KINDS) + 1)[field.label]
                sums = []
                for edges in (field.chain, field.skip, field.like):
                    total = np.zeros_like(eye)
                    np.add.at(total, edges[:, 0], eye[edges[:, 1]])
                    np.add.at(total, edges[:, 1], eye[edges[:, 0]])
                    sums.append(total)
                # a candidate that repeats or resembles a base span has no known label
                sure = field.given | ((sums[1] + sums[2])[:, 1:].sum(axis=1) == 0)
                counts.update(map(tuple, np.concatenate([field.features, *sums, field.label[:, None]], axis=1)[sure].tolist()))
            release()
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(counts), pa.list_(pa.float64())), pa.array(list(counts.values()), pa.int64())], ["node", "count"]
        )

    picked = docs.select(F.col(text_col).cast("string").alias("text"))
    found = picked.mapInArrow(nodes, "node array<double>, count bigint").groupBy("node").agg(F.sum("count").alias("count")).toArrow()
    # in one order, so that sums of doubles do not depend on the layout
    rows = sorted(zip(found.column("node").to_pylist(), found.column("count").to_pylist(), strict=True))
    labels = len(KINDS) + 1
    table = np.array([node for node, _ in rows], np.float64).reshape(-1, len(FEATURES) + 3 * labels + 1)
    unary, near, same, alike, label = np.split(table, np.cumsum([len(FEATURES), labels, labels, labels]), axis=1)
    return fit(unary, near, same, label[:, 0].astype(np.int64), count=np.array([n for _, n in rows], np.float64), alike=alike)


def find_personal_data(spark: SparkSession, text: Column, weights: Weights) -> Column:
    """Spans of ``text`` in code points; null and empty texts have none. Base spans have ``base`` true."""
    shared = spark.sparkContext.broadcast(weights)

    @F.arrow_udf(SPAN_TYPE)
    def scan(texts: pa.Array) -> pa.Array:
        rows = [[dict(zip(("kind", "start", "end", "base"), s, strict=True)) for s in scan_text(t, shared.value)] for _, part in text_parts(texts) for t in part]
        return pa.array(rows, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("base", pa.bool_())])))

    return scan(text.cast("string"))


def redact(spark: SparkSession, text: Column, weights: Weights) -> Column:
    """``text`` with ``<kind>`` in the place of each found span; spans that overlap share one mark. Null stays null."""
    shared = spark.sparkContext.broadcast(weights)

    def clean(text: str) -> str:
        out, done = [], 0
        for kind, a, b, _ in scan_text(text, shared.value):
            if a >= done:
                out += [text[done:a], f"<{kind}>"]
            done = max(done, b)
        return "".join([*out, text[done:]])

    @F.arrow_udf("string")
    def run(texts: pa.Array) -> pa.Array:
        cleaned = [clean(t) for _, part in text_parts(texts) for t in part]
        release()
        return pa.array(cleaned, pa.string(), mask=texts.is_null().to_numpy(zero_copy_only=False))

    return run(text.cast("string"))
