"""Document quality from a linear-chain conditional random field over lines.

Every line is good or bad.  Its features are shares of character and word classes, repetition, and those of the
lines before and after it.  The field has weights for the features and for the four transitions; it is trained by
gradient ascent on the likelihood of line labels taken from their document, on at most ``train_docs`` labelled
documents, the ones with the smallest digest of their id, as far as they have at most MOST_LINES lines: what the driver
holds for training is bounded by both.  Scores are of whole texts, whatever their lines.  A document's evidence is the mean of its lines' forward-backward
marginals, weighted by length; a logistic curve fitted on the same sample turns that evidence into a score.

Defined results: a null text counts as empty; an empty text is one empty line; labels that are null or contradict
each other for a doc_id are left out; without labels of both kinds the score is the share of good ones (0.5 without any);
repeated rows repeat, and count once in training; no rows give no rows.  Scores never depend on labels, lang, source or doc_id.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fieldloom.llm.common import keep_rows, tidy

TRAIN_DOCS, MOST_LINES = 4000, 250
THRESHOLD = 0.7

#: The byte classes that are counted in a line.
CLASSES = (
    ("lower", b"abcdefghijklmnopqrstuvwxyz"),
    ("upper", b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"),
    ("digit", b"0123456789"),
    ("stop", b".,;:?"),
    ("shout", b"!"),
    ("bar", b"|"),
    ("symbol", b"#$%&*@^~=+<>{}[]\\/_`"),
    ("quote", b"\"'()-"),
    ("beyond ASCII", bytes(range(128, 256))),
)
SPACE = b" \t\r\x0b\x0c"


def _tables() -> np.ndarray:
    out = np.zeros((len(CLASSES) + 1, 256), np.uint8)
    for n, (_, members) in enumerate((*CLASSES, ("space", SPACE))):
        out[n, list(members)] = 1
    return out


TABLES = _tables()
LAGS = (1, 2, 3)  # words apart at which repeats are counted
PLAIN = len(CLASSES) + 1 + 10 + len(LAGS)  # features of a line by itself


def line_features(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features of all lines, lines of each text, bytes of each line)."""
    lines: list[bytes] = []
    counts, again = [], []
    for text in texts:
        own = text.split(b"\n")
        seen: set[bytes] = set()
        counts.append(len(own))
        for line in own:
            again.append(line in seen and len(line) > 0)
            seen.add(line)
        lines += own
    sizes = np.fromiter(map(len, lines), np.int64, len(lines)) + 1
    data = np.frombuffer(b"\n".join(lines) + b"\n", np.uint8)
    start = np.cumsum(sizes) - sizes
    length = sizes - 1
    share = np.stack([np.add.reduceat(t[data], start, dtype=np.int32) for t in TABLES]).T.astype(np.float32)
    blank = TABLES[-1][data] | (data == 10)
    ends = np.flatnonzero(blank[1:] > blank[:-1])  # last byte of each word
    starts = np.flatnonzero(np.r_[True, blank[:-1] > 0] & (blank == 0))
    line_of = np.searchsorted(start, starts, side="right") - 1
    n_lines = len(lines)
    per = lambda w=None: np.bincount(line_of, weights=w, minlength=n_lines)
    words = np.maximum(per(), 1)
    width = ends - starts + 1
    last, symbol, shout, upper, lower, bar = data[ends], TABLES[6], TABLES[4], TABLES[1], TABLES[0], TABLES[5]
    tail_symbol, tail_shout = symbol[last] > 0, shout[last] > 0
    caps = (upper[data[starts]] > 0) & (upper[data[np.minimum(starts + 1, ends)]] > 0) & (width > 1)
    folded = data.astype(np.int64) + 32 * upper[data]
    low, high = np.r_[0, np.cumsum(folded)], np.r_[0, np.cumsum(folded * np.arange(len(data)))]
    plain = low[ends + 1] - low[starts]
    word = (plain * 1_000_003 + high[ends + 1] - high[starts] - starts * plain) * 64 + width  # equal words have equal numbers
    repeats = []
    for lag in LAGS:
        same = np.zeros(len(word), bool)
        same[lag:] = (word[lag:] == word[:-lag]) & (line_of[lag:] == line_of[:-lag])
        repeats.append(per(same) / words)
    long = np.maximum(length, 1)
    own = np.empty((n_lines, PLAIN), np.float32)
    own[:, : share.shape[1]] = share / long[:, None]
    rest = (
        np.log1p(length) / 8,
        per() == 0,
        np.log1p(per()) / 6,
        per(width) / words / 10,
        per(width <= 3) / words,
        per(width >= 12) / words,
        per(tail_symbol) / words,
        per(tail_shout) / words,
        per(caps) / words,
        per(bar[data[starts]] > 0) / words,
        *repeats,
    )
    for n, x in enumerate(rest):
        own[:, share.shape[1] + n] = x
    counts_a = np.array(counts)
    first = np.zeros(n_lines, bool)
    first[np.cumsum(counts_a) - counts_a] = True
    final = np.roll(first, -1)
    before = np.where(first[:, None], 0, np.roll(own, 1, axis=0))
    after = np.where(final[:, None], 0, np.roll(own, -1, axis=0))
    extra = np.stack([np.ones(n_lines), np.array(again, float), first, final], axis=1).astype(np.float32)
    return np.hstack([own, before, after, extra]), counts_a, length


def chain(unary: np.ndarray, counts: np.ndarray, moves: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Forward-backward over many chains at once.

    unary: log weight of 'good' of every line ('bad' has zero); moves: log weights of the transitions, [from, to].
    Gives each line's probability of 'good', the expected number of each transition, and the log of the weights' sum.
    """
    order = np.argsort(-counts, kind="stable")
    begin, size = (np.cumsum(counts) - counts)[order], counts[order]
    longest = int(size[0]) if len(size) else 0
    active = np.searchsorted(-size, -np.arange(1, longest + 1), side="right")  # chains with more than t lines
    scale = np.maximum(unary, 0)
    weight = np.stack([np.exp(-scale), np.exp(unary - scale)], axis=1)
    step = np.exp(moves)
    ahead = np.empty((len(unary), 2))
    norm = np.empty(len(unary))
    for t in range(longest):
        at = begin[: active[t]] + t
        a = weight[at] * (ahead[at - 1] @ step if t else 1.0)
        norm[at] = a.sum(axis=1)
        ahead[at] = a / norm[at][:, None]
    back = np.ones((len(unary), 2))
    pairs = np.zeros((2, 2))
    for t in range(longest - 1, 0, -1):
        at = begin[: active[t]] + t
        b = weight[at] * back[at] / norm[at][:, None]
        pairs += np.einsum("ni,nj->ij", ahead[at - 1], b) * step
        back[at - 1] = b @ step.T
    good = ahead[:, 1] * back[:, 1]
    return good / np.maximum(good + ahead[:, 0] * back[:, 0], 1e-300), pairs, float(np.log(norm).sum() + scale.sum())


@dataclass
class Field:
    """A trained field: feature scaling, weights, transitions, and the curve from evidence to score."""

    mean: np.ndarray
    spread: np.ndarray
    weights: np.ndarray
    moves: np.ndarray
    slope: float
    offset: float
    constant: float | None = None

    def evidence(self, features: np.ndarray, counts: np.ndarray, length: np.ndarray) -> np.ndarray:
        if not len(counts):
            return np.empty(0)
        good, _, _ = chain(((features - self.mean) / self.spread) @ self.weights, counts, self.moves)
        at = np.cumsum(counts) - counts
        weight = length + 1e-3
        return np.add.reduceat(good * weight, at) / np.add.reduceat(weight, at)

    def score(self, texts: list[bytes]) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(texts), self.constant)
        out = []
        for part in range(0, len(texts), 128):
            some = self.evidence(*line_features(texts[part : part + 128]))
            out.append(1 / (1 + np.exp(-np.clip(self.slope * some + self.offset, -30, 30))))
        return np.concatenate(out) if out else np.empty(0)


def train(features: np.ndarray, counts: np.ndarray, length: np.ndarray, label: np.ndarray, rounds: int = 120, ridge: float = 2.0) -> Field:
    """Fit a field to documents' labels (0 or 1)."""
    if not len(label) or label.min() == label.max():
        return Field(*[np.zeros(0)] * 4, 0, 0, float(label.mean()) if len(label) else 0.5)
    mean, spread = features.mean(axis=0), features.std(axis=0)
    fixed = spread < 1e-6
    mean[fixed], spread[fixed] = 0, 1
    x = (features - mean) / spread
    y = np.repeat(label, counts).astype(float)
    inner = np.ones(len(y), bool)
    inner[np.cumsum(counts) - counts] = False
    seen = np.array([[(inner & (y == 0)).sum(), 0], [0, (inner & (y == 1)).sum()]], float)
    theta = np.zeros(x.shape[1] + 4)
    m, v = np.zeros_like(theta), np.zeros_like(theta)
    for k in range(1, rounds + 1):  # Adam on the negative log likelihood
        good, pairs, _ = chain(x @ theta[:-4], counts, theta[-4:].reshape(2, 2))
        slope = np.r_[x.T @ (good - y), (pairs - seen).ravel()] + ridge * theta
        slope /= len(counts)
        m, v = 0.9 * m + 0.1 * slope, 0.99 * v + 0.01 * slope**2
        theta -= 0.1 * (1 - k / rounds / 1.2) * (m / (1 - 0.9**k)) / (np.sqrt(v / (1 - 0.99**k)) + 1e-8)
    found = Field(mean, spread, theta[:-4], theta[-4:].reshape(2, 2), 1.0, 0.0)
    e = found.evidence(features, counts, length)
    a, b = 1.0, 0.0
    for _ in range(60):  # Newton steps of the logistic curve
        p = 1 / (1 + np.exp(-np.clip(a * e + b, -30, 30)))
        w = np.maximum(p * (1 - p), 1e-6)
        g = np.array([((p - label) * e).sum() + 1e-2 * a, (p - label).sum()])
        h = np.array([[(w * e * e).sum() + 1e-2, (w * e).sum()], [(w * e).sum(), w.sum()]])
        da, db = np.linalg.solve(h, g)
        a, b = a - np.clip(da, -4, 4), b - np.clip(db, -4, 4)
    found.slope, found.offset = float(a), float(b)
    return found


def held_out(doc_id: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, train_docs: int = TRAIN_DOCS) -> Field:
    """Train on at most train_docs labelled documents that aren't held out; of rows of one doc_id the text with the smallest digest counts."""
    rows = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("y")).where("doc_id is not null and y in (0, 1)").where(~held_out())
    clear = rows.groupBy("doc_id").agg(F.min("y").alias("y"), F.max("y").alias("y2")).where("y = y2").select("doc_id", "y")
    some = clear.orderBy(F.md5(F.col("doc_id").cast("string"))).limit(train_docs)  # the bound of the broadcast below

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in range(0, batch.num_rows, 128):
                own = batch.slice(part, 128)
                x, counts, length = line_features([(t.as_py() or "").encode() for t in own.column(1)])
                ends = np.cumsum(counts)
                rows = [[x[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)], [length[e - c : e].tobytes() for e, c in zip(ends, counts, strict=True)]]
                yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), *[pa.array(r, pa.binary()) for r in rows]], ["doc_id", "y", "x", "length"])

    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    text = F.coalesce("text", F.lit(""))
    short = base.join(F.broadcast(some), "doc_id").where(F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) < MOST_LINES)
    once = short.groupBy("doc_id", "y").agg(F.min_by(text, F.xxhash64(text)).alias("text"))
    sample = once.select("doc_id", "text", "y").mapInArrow(tidy(run), "doc_id long, y int, x binary, length binary")
    got = sorted(sample.collect(), key=lambda r: (r["doc_id"], bytes(r["x"])))
    n = PLAIN * 3 + 4
    xs = [np.frombuffer(r["x"], np.float32).reshape(-1, n) for r in got]
    if not xs:
        return train(np.empty((0, n)), np.empty(0, int), np.empty(0), np.empty(0))
    return train(np.concatenate(xs).astype(float), np.array([len(x) for x in xs]), np.concatenate([np.frombuffer(r["length"], np.int64) for r in got]), np.array([r["y"] for r in got]))


def score(docs: DataFrame, field: Field) -> DataFrame:
    """(doc_id, score) of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = field.score([(t.as_py() or "").encode() for t in batch.column(1)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.float64())], ["doc_id", "score"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(tidy(run), "doc_id long, score double")


def keep_good(docs: DataFrame, field: Field, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of docs whose score reaches the threshold, with all their columns."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = field.score([(t.as_py() or "").encode() for t in batch.column(at)])
            yield batch.filter(pa.array(found >= threshold))

    return keep_rows(docs, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    from fieldloom.llm.common import table

    docs = table(spark, sf_dir, "documents")
    found = score(docs, fit(docs, table(spark, sf_dir, "labels")))
    return found.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
