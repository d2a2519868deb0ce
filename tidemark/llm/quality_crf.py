"""Quality rules by line labelling: a linear-chain CRF marks each line as content or boilerplate.

Viterbi decoding gives a document's best label sequence; the share of its words that stand on content lines decides
retention. The model is fitted here, on whole texts of a bounded sample of labelled documents (SAMPLE_DOCS of each class).
Only documents are labelled, so line labels are hidden: by turns, the labels' probabilities are worked out under the model
and shifted, document by document, until the expected content share is at least GOOD in a good document and at most BAD in a
bad one (posterior regularisation); and the weights move towards these probabilities. The share from which a document is kept
is fitted too: the highest that rejects at most LOST of the good documents in the sample. Counts and decoding cover every line
of every whole text.

Defined results: a null or empty text has no words, so it fails the base rules and is not kept; it has content share 0.
Repeated rows get equal results. Lines without a word carry no label. An empty table gives an empty table. Without
labels of both classes the fixed START model is used. An id with labels of both classes counts as bad. Columns other than id
and text are carried through untouched by `filter_documents` and ignored by `score_documents`.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import arrow_text as tx
from tidemark.llm.shared import configure, free_name

SAMPLE_DOCS = 300
#: Expected content shares of good documents (at least) and of bad ones (at most) while fitting, and the good ones that may be lost.
GOOD, BAD, LOST = 0.9, 0.1, 0.005
#: Turns of fitting, steps of a turn, their length, and the weight of the penalty on large weights.
TURNS, STEPS, RATE, RIDGE = 6, 15, 0.1, 1e-3
MIN_WORDS, MAX_REPEAT_PERCENT, REPEAT_WINDOW = 10, 20, 5

SYMBOLS = np.zeros(256, bool)
SYMBOLS[list(b"#*$%&|<>")] = True
_UPPER = np.zeros(256, bool)
_UPPER[ord("A") : ord("Z") + 1] = True
_DIGIT = np.zeros(256, bool)
_DIGIT[ord("0") : ord("9") + 1] = True
_PUNCT = np.zeros(256, bool)
_PUNCT[list(b"!?=~_^{}[]\\/@+")] = True
FEATURES = ("bias", "symbols", "upper case", "digits", "odd punctuation", "repeated words", "repeated line", "one-word line", "long words", "doubled words")


@dataclass(frozen=True)
class Crf:
    """Emission weights towards content, transition weights [from][to] with 0 boilerplate and 1 content, and the least share kept."""

    weights: np.ndarray
    moves: np.ndarray
    least_share: float


START = Crf(np.array([2.0, -12.0, -6.0, -4.0, -12.0, -3.0, -1.0, -0.3, -1.0, -6.0]), np.array([[0.8, -0.8], [-0.8, 0.8]]), 0.3)


def line_table(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """Counts by row, and the lines that have words with their features, for one chunk of texts."""
    n = len(at) - 1
    word = tx.WORD_BYTES[data]
    starts, ends = tx.spans(word, at)
    rows = tx.rows_of(starts, at)
    span = tx.SpanHashes(data)
    out = {"n_words": np.bincount(rows, minlength=n), "n_symbols": tx.per_row(SYMBOLS[data], at), "word_chars": tx.per_row(word & ((data & 0xC0) != 0x80), at)}
    hashes = span(starts, ends)
    first, keys = tx.window_hashes(hashes, rows, REPEAT_WINDOW)
    repeated = _repeated(keys, rows[first])
    cover = np.zeros(len(starts) + 1, np.int64)
    np.add.at(cover, first[repeated], 1)
    np.add.at(cover, np.minimum(first[repeated] + REPEAT_WINDOW, len(starts)), -1)
    covered = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(rows[covered], minlength=n)

    breaks = np.flatnonzero(data == 10)
    begin = np.concatenate([at[:-1], breaks + 1])
    row = np.concatenate([np.arange(n), tx.rows_of(breaks, at)])
    order = np.lexsort((begin, row))
    begin, row = begin[order], row[order]
    end = np.empty(len(begin), np.int64)
    end[:-1] = begin[1:] - 1
    final = np.append(row[1:] != row[:-1], True) if len(row) else np.zeros(0, bool)
    end[final] = at[row[final] + 1]
    low, high = np.searchsorted(starts, begin), np.searchsorted(starts, end)
    full = high > low
    begin, end, row, low, high = begin[full], end[full], row[full], low[full], high[full]
    dup = _seen_before(span(begin, end), row)
    out["n_dup_lines"] = np.bincount(row[dup], minlength=n)

    def share(flags: np.ndarray) -> np.ndarray:
        total = np.zeros(len(flags) + 1, np.int64)
        np.cumsum(flags, out=total[1:])
        return (total[end] - total[begin]) / np.maximum(end - begin, 1)

    words = high - low
    doubled = np.zeros(len(starts) + 1, np.int64)
    if len(starts) > 1:
        doubled[2:] = np.cumsum((hashes[1:] == hashes[:-1]) & (rows[1:] == rows[:-1]))
    cov = np.zeros(len(starts) + 1, np.int64)
    np.cumsum(covered, out=cov[1:])
    out |= {"line_row": row, "line_words": words}
    out["x"] = np.column_stack([np.ones(len(row)), np.minimum(1, 4 * share(SYMBOLS[data])), share(_UPPER[data]), share(_DIGIT[data]), np.minimum(1, 6 * share(_PUNCT[data])), (cov[high] - cov[low]) / np.maximum(words, 1), dup, words == 1, np.minimum(1, (end - begin) / np.maximum(words, 1) / 40), (doubled[high] - doubled[low]) / np.maximum(words, 1)]) if len(row) else np.zeros((0, len(FEATURES)))
    # A longer line is stronger evidence: its features count by the logarithm of its words.
    out["x"] *= 1 + np.log(np.maximum(words, 1))[:, None]
    return out


def _order(keys: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    own = tx.mix(keys ^ (rows.astype(np.uint64) * np.uint64(0xA24BAED4963EE407)))
    order = np.argsort(own, kind="stable")
    return order, own[order]


def _repeated(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """True where another entry of the same row has the same key."""
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order, own = _order(keys, rows)
        same = own[1:] == own[:-1]
        out[order[1:][same]] = True
        out[order[:-1][same]] = True
    return out


def _seen_before(keys: np.ndarray, rows: np.ndarray) -> np.ndarray:
    out = np.zeros(len(keys), bool)
    if len(keys) > 1:
        order, own = _order(keys, rows)
        out[order[1:][own[1:] == own[:-1]]] = True
    return out


def viterbi(scores: list[float], moves: list[list[float]]) -> list[int]:
    """The best 0/1 sequence; scores are for 1 against 0; ties go to content."""
    if not scores:
        return []
    (m00, m01), (m10, m11) = moves
    back, a, b = [], 0.0, scores[0]
    for s in scores[1:]:
        from0, from1 = a + m00, b + m10
        to0, to1 = a + m01, b + m11
        back.append((from1 >= from0, to1 >= to0))
        a, b = max(from0, from1), max(to0, to1) + s
    label = int(b >= a)
    out = [label]
    for step in reversed(back):
        label = int(step[label])
        out.append(label)
    return out[::-1]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products of 2 x 2 matrices of logarithms."""
    return np.logaddexp(a[:, :, :1] + b[:, :1, :], a[:, :, 1:] + b[:, 1:, :])


def _products(steps: np.ndarray, longest: int) -> np.ndarray:
    """At each place the product of the steps of at least the `longest` places up to it, by doubling."""
    out, width = steps, 1
    while width < longest:
        out = np.concatenate([out[:width], _times(out[:-width], out[width:])])
        width *= 2
    return out


def marginals(scores: np.ndarray, moves: np.ndarray, document: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances of label 1 of each line, and of each pair of labels [before][after] with the line before (0 at a document's start).

    scores are for 1 against 0; document numbers the lines' documents, in order. A document's first step forgets the label
    before it, so all documents go through the products at once.
    """
    n = len(scores)
    first = np.append(True, document[1:] != document[:-1])
    longest = int(np.diff(np.append(np.flatnonzero(first), n)).max(initial=1))
    emit = np.stack([np.zeros(n), scores], 1)
    step = np.where(first[:, None, None], 0.0, moves) + emit[:, None, :]
    forward = _products(step, longest)[:, 0]
    after = np.append(step[1:], np.zeros((1, 2, 2)), 0)
    after[np.append(first[1:], True)] = 0.0
    backward = _products(after[::-1].transpose(0, 2, 1), longest)[::-1][:, 0]
    both = forward + backward
    one = np.exp(both[:, 1] - np.logaddexp(both[:, 0], both[:, 1]))
    pair = np.concatenate([np.zeros((1, 2)), forward[:-1]])[:, :, None] + step + backward[:, None, :]
    pair = np.exp(pair - np.logaddexp.reduce(pair.reshape(n, 4), axis=1)[:, None, None])
    pair[first] = 0.0
    return one, pair


def _shifted(scores: np.ndarray, moves: np.ndarray, document: np.ndarray, words: np.ndarray, good: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The marginals after the least shift of each document's scores with which its expected content share keeps its bound."""
    total = np.bincount(document, words)

    def share(shift: np.ndarray) -> np.ndarray:
        return np.bincount(document, words * marginals(scores + shift[document], moves, document)[0]) / total

    now = share(np.zeros(len(good)))
    off = np.where(good, now < GOOD, now > BAD)
    low, high = np.zeros(len(good)), np.full(len(good), 64.0)
    for _ in range(12):
        middle = (low + high) / 2
        got = share(np.where(off, np.where(good, middle, -middle), 0.0))
        enough = np.where(good, got >= GOOD, got <= BAD)
        low, high = np.where(enough, low, middle), np.where(enough, middle, high)
    return marginals(scores + np.where(off, np.where(good, high, -high), 0.0)[document], moves, document)


def fit(x: np.ndarray, words: np.ndarray, document: np.ndarray, good: np.ndarray) -> Crf:
    """The model for lines with features x and `words` words; document numbers their documents, of which `good` are good."""
    width = len(FEATURES)
    theta = np.concatenate([START.weights, START.moves.ravel()])
    m = v = np.zeros_like(theta)
    for turn in range(TURNS):
        wanted, pairs = _shifted(x @ theta[:width], theta[width:].reshape(2, 2), document, words, good)
        for step in range(turn * STEPS + 1, (turn + 1) * STEPS + 1):
            one, pair = marginals(x @ theta[:width], theta[width:].reshape(2, 2), document)
            g = np.concatenate([x.T @ (wanted - one), (pairs - pair).sum(0).ravel()]) / len(x) - RIDGE * theta
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            theta = theta + RATE * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    moves = theta[width:].reshape(2, 2)
    scores, cuts = (x @ theta[:width]).tolist(), np.searchsorted(document, np.arange(len(good) + 1)).tolist()
    label = np.array([s for a, b in zip(cuts, cuts[1:], strict=False) for s in viterbi(scores[a:b], moves.tolist())], dtype=np.float64)
    share = np.sort((np.bincount(document, words * label) / np.bincount(document, words))[good])
    return Crf(theta[:width], moves, float(min(share[int(LOST * len(share))], 0.5)) if len(share) else START.least_share)


def train(documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> Crf:
    """The model from at most SAMPLE_DOCS documents of each quality class, chosen by a hash of the id.

    The sample is the only data that reaches the driver; its number of documents does not depend on the corpus.
    """
    lab = labels.where(F.col("quality").isin(0, 1) & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("i")).agg(F.min(F.col("quality").cast("int")).alias("q"))
    lab = lab.withColumn("h", F.xxhash64(F.lit("crf"), "i"))
    want = lab.where("q = 0").orderBy("h", "i").limit(SAMPLE_DOCS).unionByName(lab.where("q = 1").orderBy("h", "i").limit(SAMPLE_DOCS))
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t")).where(F.length("t") > 0)
    rows = docs.join(F.broadcast(want), "i").groupBy("i", "q", "h").agg(F.min("t").alias("t")).collect()  # at most 2 * SAMPLE_DOCS rows
    x, words, good = [], [], []
    for r in sorted(rows, key=lambda r: (r.h, str(r.i))):
        got = line_table(*tx.buffer_of(pa.array([r.t])))
        if len(got["x"]):
            x.append(got["x"])
            words.append(got["line_words"])
            good.append(r.q == 1)
    if len(set(good)) < 2:
        return START
    document = np.repeat(np.arange(len(x)), [len(a) for a in x])
    return fit(np.concatenate(x), np.concatenate(words).astype(np.float64), document, np.array(good))


def _verdicts(data: np.ndarray, at: np.ndarray, model: Crf) -> dict[str, np.ndarray]:
    got = line_table(data, at)
    n, moves = len(at) - 1, model.moves.tolist()
    scores, cuts = (got["x"] @ model.weights).tolist(), np.searchsorted(got["line_row"], np.arange(n + 1)).tolist()
    label = np.array([s for a, b in zip(cuts, cuts[1:], strict=False) for s in viterbi(scores[a:b], moves)], dtype=np.float64)
    content = np.bincount(got["line_row"], weights=label * got["line_words"], minlength=n)
    got["content_share"] = content / np.maximum(got["n_words"], 1)
    got["base_failed"] = (got["n_words"] < MIN_WORDS) | (100 * got["n_repeat_words"] > MAX_REPEAT_PERCENT * got["n_words"])
    got["kept"] = ~got["base_failed"] & (got["content_share"] >= model.least_share)
    return got


COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def score_documents(documents: DataFrame, model: Crf, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each document: id, counts, base_failed, kept, content_share."""
    configure(documents.sparkSession)
    docs = documents.select(F.col(id_col).alias("i"), F.col(text_col).alias("t"))
    kind = docs.schema["i"].dataType.simpleString()

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, "t"):
                got = _verdicts(data, at, model)
                yield pa.RecordBatch.from_arrays([tx.column(part, "i"), *(pa.array(got[c].astype(np.int64)) for c in COUNTS), pa.array(got["base_failed"]), pa.array(got["kept"]), pa.array(got["content_share"])], ["i", *COUNTS, "base_failed", "kept", "content_share"])

    out = docs.mapInArrow(run, f"i {kind}, " + ", ".join(f"{c} long" for c in COUNTS) + ", base_failed boolean, kept boolean, content_share double")
    return out.withColumnRenamed("i", id_col)


def filter_documents(documents: DataFrame, model: Crf, *, text_col: str = "text") -> DataFrame:
    """The documents that are kept, with all their columns."""
    configure(documents.sparkSession)
    text = free_name(documents, "t")
    docs = documents.withColumn(text, F.col(text_col))

    def run(batches):
        for batch in batches:
            for part, data, at in tx.chunks(batch, text):
                yield part.filter(pa.array(_verdicts(data, at, model)["kept"])).drop_columns([text])

    return docs.mapInArrow(run, documents.schema)


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train(documents, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return score_documents(documents, model)
