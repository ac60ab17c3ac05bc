"""Toxicity by subword bags: averaged n-gram embeddings into a linear softmax, trained jointly in numpy.

A word is the mean of the vectors of itself and of its byte n-grams (hashed into
``BUCKETS`` rows), so an unseen misspelling shares most of its vectors with the
word it comes from. Words are what Unicode white space separates; a run of over
``LONG`` bytes (a script without spaces, words joined by signs) is read as words
of ``PIECE`` bytes that overlap and cover all of it. A window is the mean of
``Setting.window`` neighbouring words; a linear softmax scores it, and a text
scores as its worst window, so that a few words weigh the same in a long text as
in a short one. Embeddings and softmax start at random and are trained together
by AdaGrad with a fixed seed, so reruns agree: first on whole texts, as one
window each, then on each text's worst window.

Results for odd input: null, empty and blank texts score as the softmax's bias
alone; rows without a label or an id are never learned from; several labels of
one document count as toxic if one is; several texts with one labelled id each
have its label; equal texts score alike, all returned; without labels of both
kinds every score is 0; an empty table gives an empty table; other columns are
not read, whatever their names.
"""

from __future__ import annotations

from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain
from zlib import crc32

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.llm.bpe import Memo
from quadrille.storage import bounded_batches, materialize



@dataclass(frozen=True)
class Setting:
    """Lengths of n-grams in bytes, and words in a window."""

    ngrams: tuple[int, ...] = (3, 5, 7)
    window: int = 2


SETTING = Setting()
BUCKETS = 1 << 18
DIMENSIONS = 8
#: Training reads at most about this many labelled rows, drawn by a hash of the row, and at most about FIT_TOTAL
#: characters of them, of texts up to FIT_CHARS characters: the model's bounds. Scoring has none.
FIT_ROWS = 4_000
FIT_CHARS = 200_000
FIT_TOTAL = 40_000_000
#: Bytes of the longest word read as one; longer runs are pieces of PIECE bytes, one every STEP, so each n-gram is whole in one.
LONG, PIECE, STEP = 256, 48, 32
THRESHOLD = 0.7
#: Means over a text are multiplied by WHOLE before the softmax, means over a window by SCALE for each of its words, so that one word can decide.
WHOLE, SCALE = 40.0, 4.0
#: Power of the classes' inverse shares by which rows are weighed.
BALANCE = 0.8
_STRIP = "".join(chr(c) for c in range(33, 127) if not chr(c).isalnum())


def split_words(texts: pa.Array) -> pa.Array:
    """Lists of words, for training and scoring alike."""
    return pc.utf8_split_whitespace(pc.utf8_trim_whitespace(texts.cast(pa.large_string()).fill_null("")))


def pieces(word: str) -> list[bytes]:
    """The word with its edges marked, or the pieces of a run of over LONG bytes."""
    b = b"<" + word.lower().strip(_STRIP).encode("utf-8", "surrogatepass") + b">"
    if len(b) <= LONG:
        return [b]
    return [b[i : i + PIECE] for i in range(0, len(b) - PIECE + STEP, STEP)]


def features(b: bytes, ngrams: tuple[int, ...]) -> list[int]:
    """Buckets of a piece: the whole of it and its byte n-grams."""
    if b == b"<>":
        return []
    found = [crc32(b) % BUCKETS]
    for n in ngrams:
        found += [crc32(b[i : i + n]) % BUCKETS for i in range(len(b) - n + 1)]
    return found


def window_means(values: np.ndarray, window: int) -> np.ndarray:
    """Means of every ``window`` neighbours; one mean of all if there are fewer."""
    width = min(window, len(values))
    sums = np.concatenate([[0.0], np.cumsum(values)])
    return (sums[width:] - sums[:-width]) / width


class Bags:
    """Texts as word numbers, words as feature lists (CSR), for training."""

    def __init__(self, texts: list[str | None], ngrams: tuple[int, ...]):
        number: dict[str | bytes, int] = {}
        self.docs = []
        for t in texts:
            words = split_words(pa.array([t], pa.large_string())).flatten().to_pylist()
            units = chain.from_iterable([w] if len(w) * 4 + 2 <= LONG else pieces(w) for w in words)
            self.docs.append(np.array([number.setdefault(u, len(number)) for u in units], np.int64))
        flat, sizes = array("i"), array("i")
        for u in number:
            found = features(u if isinstance(u, bytes) else pieces(u)[0], ngrams)
            flat.extend(found)
            sizes.append(len(found))
        self.sizes = np.array(sizes, np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.flat = np.frombuffer(flat, np.int32) if flat else np.zeros(0, np.int32)

    def word_scores(self, s: np.ndarray, words: np.ndarray) -> np.ndarray:
        """By word number, the mean of ``s`` over the features of ``words``."""
        out = np.zeros(len(self.sizes))
        for a in range(0, len(words), 1 << 16):
            part = words[a : a + (1 << 16)]
            ends = np.cumsum(self.sizes[part])
            total = np.concatenate([[0.0], np.cumsum(s[self.flat[self.expand(part)]])])
            out[part] = (total[ends] - total[ends - self.sizes[part]]) / np.maximum(self.sizes[part], 1)
        return out

    def expand(self, words: np.ndarray) -> np.ndarray:
        """Places in ``flat`` of the words' features, word after word."""
        sizes = self.sizes[words]
        return np.repeat(self.starts[words] - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())

    def spread(self, words: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """Per bucket, the sum of ``weights`` of words over their features."""
        used, inverse = np.unique(words, return_inverse=True)
        per_word = np.bincount(inverse, weights, len(used)) / np.maximum(self.sizes[used], 1)
        return np.bincount(self.flat[self.expand(used)], np.repeat(per_word, self.sizes[used]), BUCKETS)


class Model:
    """Per-bucket score (embedding times the difference of the softmax's two rows), bias and setting."""

    def __init__(self, scores: np.ndarray, bias: float, setting: Setting = SETTING, trained: bool = True):
        self.scores, self.bias, self.setting, self.trained = scores, bias, setting, trained


def train(texts: list[str | None], labels: list[int], setting: Setting = SETTING, epochs: tuple[int, int] = (3, 8), batch: int = 128, seed: int = 7) -> Model:
    """Fit embeddings E and softmax (U, b) by AdaGrad on the cross entropy of whole texts, then of each text's worst window."""
    y = np.array(labels, np.float64)
    if not len(y) or y.min() == y.max():
        return Model(np.zeros(BUCKETS, np.float32), 0.0, setting, False)
    rng = np.random.default_rng(seed)
    bags = Bags(texts, setting.ngrams)
    E, GE = rng.normal(0, 0.1, (BUCKETS, DIMENSIONS)), np.full(BUCKETS, 1e-3)
    U, GU = rng.normal(0, 0.5, (2, DIMENSIONS)), np.full((2, DIMENSIONS), 1e-2)
    b, Gb = np.array([0.0, -4.0]), np.full(2, 1e-2)
    weight = np.where(y == 1, 0.5 / y.mean(), 0.5 / (1 - y.mean())) ** BALANCE
    rounds = max(1, int(np.ceil(1000 / len(y))))
    for epoch in range(sum(epochs)):
        windowed = epoch >= epochs[0]
        scale = SCALE * setting.window if windowed else WHOLE
        order = rng.permutation(np.tile(np.arange(len(y)), rounds))
        for part in np.array_split(order, max(1, len(order) // batch)):
            du = U[1] - U[0]
            scores = bags.word_scores(E @ du, np.unique(np.concatenate([bags.docs[d] for d in part])))
            picked = []
            for d in part:
                words = bags.docs[d]
                if windowed and len(words) > setting.window:
                    k = int(np.argmax(window_means(scores[words], setting.window)))
                    words = words[k : k + setting.window]
                picked.append(words)
            spans = np.array([len(w) for w in picked])
            n, words, owner = np.maximum(spans, 1), np.concatenate(picked), np.repeat(np.arange(len(part)), spans)
            logit = scale * np.bincount(owner, scores[words], len(part)) / n + b[1] - b[0]
            p = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
            delta = (p - y[part]) * weight[part] / len(part)
            g = bags.spread(words, (scale * delta / n)[owner])  # gradient of E along du
            at = np.flatnonzero(g)
            GE[at] += g[at] ** 2
            gU = (g[at][:, None] * E[at]).sum(0)
            E[at] -= (0.1 * g[at] / np.sqrt(GE[at]))[:, None] * du
            gU = np.stack([-gU, gU])
            GU += gU**2
            U -= 0.02 * gU / np.sqrt(GU)
            gb = np.array([-delta.sum(), delta.sum()])
            Gb += gb**2
            b -= 0.2 * gb / np.sqrt(Gb)
    return Model((E @ (U[1] - U[0])).astype(np.float32), float(b[1] - b[0]), setting)


def compare_settings(ids: list[int], texts: list[str | None], labels: list[int], settings: list[Setting], folds: int = 4) -> list[dict]:
    """Recall and false alarms of each setting at THRESHOLD, by cross-validation inside the rows given (those to learn from)."""
    part = np.array([crc32(f"inner:{i}".encode()) % folds for i in ids])
    y, out = np.array(labels), []
    for setting in settings:
        found = np.zeros(len(y))
        for k in range(folds):
            learn = np.flatnonzero(part != k)
            scorer = Scorer(train([texts[i] for i in learn], y[learn].tolist(), setting))
            for i in np.flatnonzero(part == k):
                found[i] = scorer.score(pa.array([texts[i]], pa.large_string()))[0]
        hit = found >= THRESHOLD
        out.append({"setting": setting, "recall": float(hit[y == 1].mean()), "false_alarms": float(hit[y == 0].mean())})
    return out


class Scorer:
    def __init__(self, model: Model):
        self.table = model.scores.tolist()
        self.bias, self.setting, self.trained = model.bias, model.setting, model.trained
        self.words = Memo(self._word, 600_000)

    def _word(self, word: str) -> float | list[float]:
        """The word's score; of a run of over LONG bytes, those of its pieces."""
        found = [self._piece(b) for b in pieces(word)]
        return found[0] if len(found) == 1 else found

    def _piece(self, b: bytes) -> float:
        found = features(b, self.setting.ngrams)
        return sum(map(self.table.__getitem__, found)) / len(found) if found else 0.0

    def score(self, texts: pa.Array) -> np.ndarray:
        if not self.trained:
            return np.zeros(len(texts))
        words = split_words(texts)
        cuts = words.offsets.to_numpy()
        cuts = cuts - cuts[0]
        coded = words.flatten().dictionary_encode()
        each = [self.words[w] for w in coded.dictionary.to_pylist()]
        value = np.array([v for x in each for v in (x if isinstance(x, list) else (x,))], np.float64)
        at = coded.indices.to_numpy()
        if len(value) > len(each):  # each long run is replaced by its pieces
            sizes = np.array([len(x) if isinstance(x, list) else 1 for x in each])
            firsts, n = np.cumsum(sizes) - sizes, sizes[at]
            ends = np.cumsum(n)
            at = np.repeat(firsts[at] - (ends - n), n) + np.arange(n.sum())
            cuts = np.concatenate([[0], ends])[cuts]
        best = np.zeros(len(texts))
        for i, (a, e) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)):
            if e > a:
                best[i] = window_means(value[at[a:e]], self.setting.window).max()
        return 1 / (1 + np.exp(-np.clip(SCALE * self.setting.window * best + self.bias, -30, 30)))


def held_out_column(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 3 == 1, F.lit(False))


def _share(most: int, of: int) -> float:
    return 1.0 if of <= most else most / of


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS, setting: Setting = SETTING) -> Model:
    """Train on about ``fit_rows`` labelled documents outside the held-out fold."""
    spark = docs.sparkSession
    marks = (
        labels.select(F.col(id_col).alias("doc_id"), F.col(label_col).cast("int").alias("y"))
        .where(F.col("doc_id").isNotNull() & F.col("y").isNotNull() & ~held_out_column("doc_id"))
        .groupBy("doc_id")
        .agg(F.max("y").alias("y"))
    )
    span = 1 << 30
    draw = lambda seed, *c: F.xxhash64(F.lit(seed), *c).bitwiseAND(F.lit(span - 1))
    chosen = marks.where(draw("toxic", F.col("doc_id")) < int(span * _share(fit_rows, marks.count()))).toArrow()
    if chosen.num_rows > 2 * fit_rows:
        raise RuntimeError(f"{chosen.num_rows} labels drawn where about {fit_rows} were due")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).where(F.length("text") <= FIT_CHARS)
    # a list of checked length; ids that repeat make more rows of it, so rows and characters are bounded once more
    rows = materialize(texts.join(F.broadcast(spark.createDataFrame(chosen)), "doc_id"), "labelled")
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.length("text")), F.lit(0))).first()
    share = min(_share(fit_rows, n), _share(FIT_TOTAL, size))
    rows = rows.where(draw("row", F.col("doc_id"), F.col("text"), F.monotonically_increasing_id()) < int(span * share)) if share < 1 else rows
    found = rows.orderBy("doc_id", "text").toArrow()
    return train(found.column("text").to_pylist(), [int(v > 0) for v in found.column("y").to_pylist()], setting)


def score(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    bounded_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), held_out_column(id_col).alias("held_out"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([*picked.schema.fields[:2], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())])
    sent = docs.sparkSession.sparkContext.broadcast((model.scores, model.bias, model.setting, model.trained))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(Model(*sent.value))
        for batch in batches:
            s = scorer.score(batch.column(2))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(s), pa.array((s >= threshold).astype(np.int32))],
                ["doc_id", "held_out", "score", "predicted"],
            )

    return picked.mapInArrow(work, schema)


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return score(docs, fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))
