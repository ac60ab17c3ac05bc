"""Language identification with hyperdimensional profiles.

Every letter class has a random vector of +1 and -1. An n-gram's vector binds
(multiplies) its letters' vectors, each permuted (rotated) by its place; a text
is the bundle (sum) of its n-grams' vectors, a language the bundle of its
training texts, each scaled to length one. A text gets the language whose
prototype has the highest cosine with it.

Results for odd input: a null text, or one with no letter, is ``und`` with score
0; rows with a null language are never learned from; equal texts get equal
results, all returned; with nothing to learn from every row is ``und``; an empty
table gives an empty table.
"""

from __future__ import annotations

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrille.storage import bounded_batches

DIMENSIONS = 1024
NGRAM = 3
#: Training reads about this many labelled rows, drawn by a hash of the id: the model's only bound.
FIT_ROWS = 20_000
#: A filter also rejects documents whose best cosine is below this.
MIN_SCORE = 0.1
UNKNOWN = "und"
_CLASSES = 1 << 12
_MAX_GRAMS = 60_000


@lru_cache(maxsize=1)
def _letter_table() -> np.ndarray:
    """Class of every code point: 0 no letter, else 1 + lower-case code point modulo the number of classes."""
    table = np.zeros(0x110000, np.uint16)
    for c in range(0x110000):
        if unicodedata.category(chr(c))[0] in "LM" and not 0xD800 <= c < 0xE000:
            low = chr(c).lower()
            table[c] = 1 + (ord(low) if len(low) == 1 else c) % (_CLASSES - 1)
    return table


class Grams:
    """Vectors of n-grams, made when first met; bounded."""

    def __init__(self, dimensions: int = DIMENSIONS, seed: int = 8):
        rng = np.random.default_rng(seed)
        self.letters = rng.choice(np.array([-1, 1], np.int8), (_CLASSES, dimensions))
        self.rows: dict[int, int] = {}
        self.table = np.zeros((1024, dimensions), np.float32)

    def lookup(self, keys: np.ndarray) -> np.ndarray:
        """Row of ``table`` for each n-gram key."""
        if len(self.rows) + len(keys) > _MAX_GRAMS:
            self.rows.clear()
        out = np.empty(len(keys), np.int64)
        for i, k in enumerate(keys.tolist()):
            row = self.rows.get(k)
            if row is None:
                row = self.rows[k] = len(self.rows)
                if row >= len(self.table):
                    self.table = np.concatenate([self.table, np.zeros_like(self.table)])
                v = np.ones(self.letters.shape[1], np.int8)
                for place in range(NGRAM):
                    v = v * np.roll(self.letters[k // _CLASSES**place % _CLASSES], place)
                self.table[row] = v
            out[i] = row
        return out

    def bundle(self, text: str | None) -> np.ndarray | None:
        """Sum of the text's n-gram vectors, or None if it has no letter."""
        if not text:
            return None
        code = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
        classes = _letter_table()[code].astype(np.int64)
        if not classes.any():
            return None
        # runs of other characters become one blank, and the text is framed by blanks
        padded = np.concatenate([[0], classes, [0]])
        padded = padded[np.concatenate([[True], (padded[1:] != 0) | (padded[:-1] != 0)])]
        keys = padded[:-2] + _CLASSES * (padded[1:-1] + _CLASSES * padded[2:])
        seen, counts = np.unique(keys, return_counts=True)
        total = np.zeros(self.letters.shape[1], np.float32)
        for a in range(0, len(seen), 16_384):
            rows = self.lookup(seen[a : a + 16_384])
            total += counts[a : a + 16_384].astype(np.float32) @ self.table[rows]
        return total


@lru_cache(maxsize=1)
def grams() -> Grams:
    return Grams()


def _unit(v: np.ndarray) -> np.ndarray:
    n = float(np.linalg.norm(v))
    return v / n if n else v


class Model:
    """Language names and their prototypes (unit vectors)."""

    def __init__(self, languages: list[str], prototypes: np.ndarray):
        self.languages, self.prototypes = languages, prototypes

    def predict(self, text: str | None) -> tuple[str, float]:
        v = grams().bundle(text)
        if v is None or not self.languages:
            return UNKNOWN, 0.0
        cosines = self.prototypes @ _unit(v)
        best = int(np.argmax(cosines))
        return self.languages[best], float(min(1.0, max(0.0, cosines[best])))


def held_out_column(id_col: str) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS) -> Model:
    """Learn prototypes from about ``fit_rows`` labelled rows; each task sends one vector for each language."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].cast("string").alias("text"), docs[lang_col].cast("string").alias("lang"))
    rows = rows.where(F.col("lang").isNotNull() & ~held_out_column("doc_id"))
    n = rows.select("doc_id").count()
    if n > fit_rows:
        draw = F.xxhash64(F.lit("fit"), F.col("doc_id")).bitwiseAND(F.lit((1 << 30) - 1))
        rows = rows.where(draw < int((1 << 30) * fit_rows / n))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for text, lang in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                v = grams().bundle(text)
                if v is not None:
                    sums[lang] = sums.get(lang, 0) + _unit(v).astype(np.float64)
        names = list(sums)
        yield pa.RecordBatch.from_pydict({"lang": pa.array(names, pa.string()), "v": pa.array([sums[k].tolist() for k in names], pa.list_(pa.float64()))})

    parts = rows.mapInArrow(work, "lang string, v array<double>")
    summed = parts.select("lang", F.posexplode("v").alias("i", "x")).groupBy("lang", "i").agg(F.sum("x").alias("x"))
    vectors = summed.groupBy("lang").agg(F.array_sort(F.collect_list(F.struct("i", "x"))).alias("v")).orderBy("lang").collect()
    names = [r["lang"] for r in vectors]
    table = np.array([_unit(np.round([p["x"] for p in r["v"]], 6)) for r in vectors], np.float32).reshape(len(names), DIMENSIONS)
    return Model(names, table)


def _scorer(model: Model):
    packed = base64.b64encode(model.prototypes.tobytes()).decode()
    languages = model.languages

    def score(texts: list[str | None]) -> list[tuple[str, float]]:
        table = np.frombuffer(base64.b64decode(packed), np.float32).reshape(len(languages), DIMENSIONS)
        m = Model(languages, table)
        return [m.predict(t) for t in texts]

    return score


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    bounded_batches(docs.sparkSession)
    picked = docs.select(docs[id_col].alias("doc_id"), held_out_column(id_col).alias("held_out"), docs[text_col].cast("string").alias("text"))
    schema = T.StructType([*picked.schema.fields[:2], T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    score = _scorer(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(2).to_pylist())
            columns = [batch.column(0), batch.column(1), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "lang_pred", "score"])

    return picked.mapInArrow(work, schema)


def keep_known(docs: DataFrame, model: Model, text_col: str = "text", min_score: float = MIN_SCORE) -> DataFrame:
    """Documents in a learned language; same columns."""
    bounded_batches(docs.sparkSession)
    at = docs.columns.index(text_col)
    score = _scorer(model)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = score(batch.column(at).to_pylist())
            yield batch.filter(pa.array([lang != UNKNOWN and s >= min_score for lang, s in found], pa.bool_()))

    return docs.mapInArrow(work, docs.schema)


def op8_hyperdimensional_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, fit(docs))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return keep_known(docs, fit(docs))
