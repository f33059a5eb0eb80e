"""Quality rules: gradient-boosted trees over statistics of whole documents, beside two fixed rules.

``counts`` reads every text once and counts exactly; ``features`` makes shares of the counts; ``fit`` grows boosted trees with
logistic loss on histograms, and keeps the score from rising with chosen features: a split on one of them must leave the
right side no higher than the left, and both sides keep to their own side of the middle from there on. Trees are
flattened into arrays of nodes, so a batch of documents goes down all trees at once.

The trees are fitted on at most ``SAMPLE`` labelled documents, those of the least hashes of their ids; counts, rules and
scores cover all documents alike.

Cases: a null or empty text has no words and fails the fixed rules; texts of any length are counted whole, a few megabytes of
words at a time; repeated rows get equal verdicts; of a document with several labels each counts; null labels and labels of no
document don't count; ties of hashes go by id and then counts; with no labels, or labels of one kind alone, the trees pass all or none as the
labels say (all without any); an empty table gives no rows; other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, shared_dir, store, table

#: Labelled documents that the trees are fitted on at most.
SAMPLE = 20_000
WINDOW = 8
#: Words that are searched for repeated windows together, and bytes of a text that are cut into words at once.
GROUP, PIECE = 200_000, 4 << 20

SYMBOLS, WHITE = b"#*$%&|<>", b" \t\n\x0b\x0c\r"
UPPER, LOWER, DIGITS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789"
MARKS = bytes(b for b in range(33, 127) if b not in SYMBOLS + UPPER + LOWER + DIGITS)
INNER = bytes(range(0x80, 0xC0))  #: bytes that continue a character of UTF-8

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_marks", "n_upper", "n_letters", "n_digits", "n_distinct", "n_commonest", "n_same_again"]
FEATURES = ["log_words", "word_length", "symbols", "dup_lines", "repeats", "marks", "upper", "digits", "words_a_line", "distinct", "commonest", "same_again"]
#: The score never rises with these.
FALLING = ("symbols", "dup_lines", "repeats", "commonest", "same_again")


def _count(text: bytes, of: bytes) -> int:
    return len(text) - len(text.translate(None, of))


def _pieces(text: bytes) -> Iterator[bytes]:
    """The text, cut between words."""
    at = 0
    while len(text) - at > PIECE:
        end = at + PIECE
        while end < len(text) and text[end] not in WHITE:
            end += 1
        yield text[at:end]
        at = end
    yield text[at:] if at else text


def _word_ids(text: bytes, known: dict[bytes, int]) -> np.ndarray:
    parts = [np.fromiter((known.setdefault(w, len(known)) for w in piece.split()), np.int32) for piece in _pieces(text)]
    return parts[0] if len(parts) == 1 else np.concatenate(parts)


def repeated_words(ids: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """Which words stand in a window of ``WINDOW`` words that its document (``doc``, rising) has twice or more.

    Windows get their names by doubling: equal pairs of words, then of pairs, then of fours get equal numbers."""
    n = len(ids) - WINDOW + 1
    covered = np.zeros(len(ids), bool)
    if n < 2:
        return covered
    name = ids.astype(np.int64)
    for step in (1, 2, 4):
        name = np.unique(name[:-step] * (int(name.max()) + 1) + name[step:], return_inverse=True)[1].astype(np.int64)
    at = np.flatnonzero(doc[:n] == doc[WINDOW - 1 :])
    _, inverse, times = np.unique(doc[at].astype(np.int64) * (int(name.max()) + 1) + name[at], return_inverse=True, return_counts=True)
    edge = np.zeros(len(ids) + 1, np.int32)
    starts = at[times[inverse] > 1]
    edge[starts] += 1
    edge[starts + WINDOW] -= 1
    return np.cumsum(edge[:-1]) > 0


def _of_words(group: list[np.ndarray]) -> np.ndarray:
    """Of each text of a group, by its words' numbers: words in repeated windows, distinct words, the commonest word's
    number, words that equal the one before."""
    sizes = np.array([len(g) for g in group])
    ids, doc = np.concatenate(group), np.repeat(np.arange(len(group)), sizes)
    n = len(group)
    repeats = np.bincount(doc, repeated_words(ids, doc), n)
    pairs, times = np.unique(doc * (int(ids.max(initial=0)) + 1) + ids, return_counts=True)
    of = pairs // (int(ids.max(initial=0)) + 1)
    most = np.zeros(n, np.int64)
    np.maximum.at(most, of, times)
    again = np.bincount(doc[1:], (ids[1:] == ids[:-1]) & (doc[1:] == doc[:-1]), n)
    return np.stack([repeats, np.bincount(of, minlength=n), most, again], axis=1).astype(np.int64)


def _counted(texts: list[bytes | None]) -> np.ndarray:
    """``COUNTS`` of each text."""
    out = np.zeros((len(texts), len(COUNTS)), np.int64)
    group, known, first, held = [], {}, 0, 0
    for i, text in enumerate(texts):
        text = text or b""
        ids = _word_ids(text, known)
        lines = [x for x in text.split(b"\n") if not x.isspace() and x]
        upper = _count(text, UPPER)
        out[i, :4] = len(ids), len(text) - _count(text, INNER) - _count(text, WHITE), _count(text, SYMBOLS), len(lines) - len(set(lines))
        out[i, 5:10] = len(lines), _count(text, MARKS), upper, upper + _count(text, LOWER), _count(text, DIGITS)
        group.append(ids)
        held += len(ids)
        if held >= GROUP or i + 1 == len(texts):
            out[first : i + 1, [4, 10, 11, 12]] = _of_words(group)
            group, known, first, held = [], {}, i + 1, 0
    return out


def counts(docs: DataFrame) -> DataFrame:
    """(doc_id, COUNTS...) of whole texts."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, ends = 0, np.cumsum(pc.binary_length(batch.column(1)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
            while at < batch.num_rows:  # some megabytes of text at a time
                n = max(1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")) - at)
                found = _counted(batch.column(1).slice(at, n).cast(pa.large_binary()).to_pylist())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), *(pa.array(found[:, i]) for i in range(len(COUNTS)))], names=["doc_id", *COUNTS])
                at += n
        give_back()

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS))


def features(found: np.ndarray) -> np.ndarray:
    """``FEATURES`` of rows of ``COUNTS``."""
    c = dict(zip(COUNTS, found.T.astype(np.float64), strict=True))
    words, chars, lines, letters = (np.maximum(c[n], 1) for n in ("n_words", "word_chars", "n_lines", "n_letters"))
    return np.stack([np.log1p(c["n_words"]), chars / words, c["n_symbols"] / chars, c["n_dup_lines"] / lines, c["n_repeat_words"] / words, c["n_marks"] / chars, c["n_upper"] / letters, c["n_digits"] / chars, words / lines, c["n_distinct"] / words, c["n_commonest"] / words, c["n_same_again"] / words], axis=1)


class Forest:
    """Boosted trees as arrays of nodes; a leaf is its own child on both sides."""

    def __init__(self, start: float, depth: int):
        self.start, self.depth, self.roots = start, depth, np.empty(0, np.int32)
        self.feature, self.left, self.right = np.empty(0, np.int32), np.empty(0, np.int32), np.empty(0, np.int32)
        self.threshold, self.value = np.empty(0), np.empty(0)

    def add(self, nodes: list[dict]) -> None:
        base = len(self.feature)
        self.roots = np.append(self.roots, np.int32(base))
        for name, kind in (("feature", np.int32), ("left", np.int32), ("right", np.int32), ("threshold", float), ("value", float)):
            values = np.array([n[name] for n in nodes], kind) + (base if name in ("left", "right") else 0)
            setattr(self, name, np.concatenate((getattr(self, name), values.astype(kind))))

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log odds of each row, all trees at once."""
        at = np.tile(self.roots, (len(x), 1))
        rows = np.arange(len(x))[:, None]
        for _ in range(self.depth):
            at = np.where(x[rows, self.feature[at]] <= self.threshold[at], self.left[at], self.right[at])
        return self.start + self.value[at].sum(axis=1)

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))


def fit(x: np.ndarray, y: np.ndarray, falling: tuple[int, ...] = (), trees: int = 40, depth: int = 3, rate: float = 0.3, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Forest:
    """Trees for y (0 or 1) by rows of x; the score never rises with the columns ``falling``. Rows' order matters only to
    the last digits, equal rows in equal order give equal trees."""
    share = (y.sum() + 0.5) / (len(y) + 1) if len(y) and 0 < y.sum() < len(y) else (1 - 1e-9 if not len(y) or y.all() else 1e-9)
    forest = Forest(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.all() or not y.any():
        return forest
    edges = [np.unique(np.quantile(c, np.linspace(0, 1, bins + 1)[1:-1], method="lower")) for c in x.T]
    binned = np.stack([np.searchsorted(e, c) for e, c in zip(edges, x.T, strict=True)], axis=1)  # bin b: up to edge b
    margin = np.full(len(y), forest.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        nodes, leaf = [_leaf(g.sum(), h.sum(), ridge, rate, (-np.inf, np.inf), 0)], np.zeros(len(y), np.int64)
        bounds, level = [(-np.inf, np.inf)], [0]
        for _ in range(depth):
            following = []
            for k in level:
                rows = np.flatnonzero(leaf == k)
                best = _best_split(binned[rows], g[rows], h[rows], edges, falling, bounds[k], least, ridge, rate)
                if best is None:
                    continue
                j, b, (left, right) = best
                goes = binned[rows, j] <= b
                middle = (left + right) / 2
                low, high = bounds[k]
                inner = [(middle, high), (low, middle)] if j in falling else [(low, high)] * 2
                nodes[k] |= {"feature": j, "threshold": float(edges[j][b]), "left": len(nodes), "right": len(nodes) + 1}
                leaf[rows] = np.where(goes, len(nodes), len(nodes) + 1)
                following += [len(nodes), len(nodes) + 1]
                for value, bound in zip((left, right), inner, strict=True):
                    nodes.append({"feature": 0, "threshold": 0.0, "left": len(nodes), "right": len(nodes), "value": value})
                    bounds.append(bound)
            level = following
        forest.add(nodes)
        margin = margin + np.array([n["value"] for n in nodes])[leaf]
    return forest


def _leaf(g: float, h: float, ridge: float, rate: float, bound: tuple[float, float], at: int) -> dict:
    return {"feature": 0, "threshold": 0.0, "left": at, "right": at, "value": float(np.clip(-rate * g / (h + ridge), *bound))}


def _best_split(binned: np.ndarray, g: np.ndarray, h: np.ndarray, edges: list[np.ndarray], falling: tuple[int, ...], bound: tuple[float, float], least: int, ridge: float, rate: float):
    """(feature, bin, values of both sides) of the split that gains most within the node's bounds, or None."""
    best, found = 1e-9, None
    worth = lambda v, g, h: -(g * v + 0.5 * (h + ridge) * v * v)
    at_rest = worth(np.clip(-g.sum() / (h.sum() + ridge), bound[0] / rate, bound[1] / rate), g.sum(), h.sum())
    for j, e in enumerate(edges):
        size = len(e) + 1
        gs, hs, ns = (np.cumsum(np.bincount(binned[:, j], w, size)) for w in (g, h, None))
        gl, hl, nl = gs[:-1], hs[:-1], ns[:-1]
        left = np.clip(-gl / (hl + ridge), bound[0] / rate, bound[1] / rate)
        right = np.clip(-(gs[-1] - gl) / (hs[-1] - hl + ridge), bound[0] / rate, bound[1] / rate)
        gain = worth(left, gl, hl) + worth(right, gs[-1] - gl, hs[-1] - hl) - at_rest
        gain[(nl < least) | (ns[-1] - nl < least) | ((left < right) if j in falling else False)] = -np.inf
        if len(gain) and gain.max() > best:
            b = int(gain.argmax())
            best, found = gain[b], (j, b, (float(rate * left[b]), float(rate * right[b])))
    return found


def learn(counted: DataFrame, labels: DataFrame, most: int = SAMPLE) -> Forest:
    """Trees for ``quality`` (0 or 1) by ``labels`` (doc_id, quality), of at most ``most`` labelled documents."""
    both = counted.join(labels.where("quality is not null").select("doc_id", F.col("quality").cast("int").alias("quality")), "doc_id")
    n = both.count()
    if n > most:  # hashes under a bar that a few more than ``most`` are under, so that tasks needn't each send as many
        both = both.where(F.shiftrightunsigned(F.xxhash64("doc_id"), 32) <= int((most + 6 * most**0.5) / n * 2**32))
    sample = both.orderBy(F.shiftrightunsigned(F.xxhash64("doc_id"), 32), "doc_id", *COUNTS, "quality").limit(most).toPandas()
    return fit(features(sample[COUNTS].to_numpy(np.int64).reshape(-1, len(COUNTS))), (sample["quality"].to_numpy() > 0).astype(np.int64), tuple(FEATURES.index(f) for f in FALLING))


def judge(counted: DataFrame, forest: Forest) -> DataFrame:
    """``counted`` beside the trees' ``score``, the probability of good quality."""
    shared = counted.sparkSession.sparkContext.broadcast(forest)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.stack([batch.column(c).to_numpy() for c in COUNTS], axis=1)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(shared.value.score(features(found)))], names=[*batch.schema.names, "score"])

    kind = counted.schema["doc_id"].dataType.simpleString()
    return counted.select("doc_id", *COUNTS).mapInArrow(each, f"doc_id {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", score double")


def op11_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    counted = store(counts(table(spark, sf_dir, "documents")), f"{shared_dir(spark)}/counts")
    judged = judge(counted, learn(counted, table(spark, sf_dir, "labels").select("doc_id", "quality")))
    failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    return judged.select("doc_id", *COUNTS[:5], failed.alias("base_failed"), (~failed & (F.col("score") >= 0.5)).alias("kept"), "score")
