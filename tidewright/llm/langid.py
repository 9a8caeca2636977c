"""Language identification: sparse multinomial logistic regression on TF-IDF of character n-grams.

Document frequencies of the hashed n-grams are counted over all training documents. The classifier is fitted on a
bounded sample of labelled rows, at most about SAMPLE for each language, by follow-the-regularised-leader steps with
L1 and L2 penalties; a part of the sample that the steps don't see sets the temperature of its probabilities.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewright.llm.common import lean, rows_of

BUCKETS = 1 << 16
SAMPLE = 600
FOLDS = 5
EPOCHS, ALPHA, BETA, L1, L2, SCALE = 4, 0.5, 1.0, 0.02, 0.05, 20.0
PIECE = 1 << 18
UNKNOWN = "und"


def grams(text: str):
    """Buckets of the 1-, 2- and 3-grams of the lower-cased text, in pieces; runs of other ASCII than a-z count as spaces."""
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4")
    codes = np.where((codes < 97) | ((codes > 122) & (codes < 128)), np.uint32(32), codes)
    for at in range(0, len(codes) - 2, PIECE):
        c = codes[at : at + PIECE + 2]
        a, b, d = c[:-2] * np.uint32(0x9E3779B1), c[1:-1] * np.uint32(0x85EBCA77), c[2:] * np.uint32(0xC2B2AE3D)
        two = a + (b ^ (b >> np.uint32(15)))
        three = two * np.uint32(0x27D4EB2F) + (d ^ (d >> np.uint32(13)))
        yield np.concatenate([b >> np.uint32(16), (two ^ np.uint32(0x5BD1E995)) * np.uint32(0x165667B1) >> np.uint32(16), three * np.uint32(0x9E3779B1) >> np.uint32(16)])


@dataclass
class Model:
    """weights: buckets x languages, document frequencies and scale included; languages in order of code points."""

    languages: list[str]
    weights: np.ndarray
    bias: np.ndarray
    temperature: float

    def probabilities(self, text: str) -> np.ndarray:
        total, n = np.zeros(len(self.languages)), 0
        for h in grams(text):
            n += len(h)
            if len(h) > BUCKETS:
                total += np.bincount(h, minlength=BUCKETS) @ self.weights
            else:
                total += self.weights.take(h, axis=0).sum(axis=0, dtype=np.float64)
        return softmax((total / max(1, n) + self.bias) / self.temperature)

    def predict(self, text: str | None) -> tuple[str, float]:
        """(language, its probability); ties go to the first language. und and 0 without a letter or a language."""
        import regex

        if not text or not self.languages or not regex.search(r"\p{L}", text):
            return UNKNOWN, 0.0
        p = self.probabilities(text)
        best = int(p.argmax())
        return self.languages[best], float(min(1.0, p[best]))


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def fit(examples: list[tuple[str, np.ndarray, np.ndarray]], df: np.ndarray, n_docs: int) -> Model:
    """examples: (language, buckets, shares of the document's n-grams), in a fixed order."""
    languages = sorted({e[0] for e in examples})
    if not languages:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0), 1.0)
    k, idf = len(languages), np.log((1 + n_docs) / (1 + df)) + 1
    z, n, zb, nb = np.zeros((BUCKETS, k)), np.zeros((BUCKETS, k)), np.zeros(k), np.zeros(k)
    rows = [(languages.index(lang), i, share * idf[i] * SCALE) for lang, i, share in examples]
    learn, check = [r for at, r in enumerate(rows) if at % 5], rows[::5]
    rng = np.random.default_rng(7)

    def weights(z, n, l1):
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for at in rng.permutation(len(learn)):
            y, i, x = learn[at]
            zi, ni = z[i], n[i]
            w, b = weights(zi, ni, L1), weights(zb, nb, 0.0)
            error = softmax(x @ w + b)
            error[y] -= 1
            g = x[:, None] * error
            z[i] = zi + g - (np.sqrt(ni + g * g) - np.sqrt(ni)) / ALPHA * w
            n[i] = ni + g * g
            zb, nb = zb + error - (np.sqrt(nb + error * error) - np.sqrt(nb)) / ALPHA * b, nb + error * error
    w, b = weights(z, n, L1), weights(zb, nb, 0.0)
    logits, ys = np.array([x @ w[i] + b for _, i, x in check]).reshape(-1, k), np.array([r[0] for r in check], int)
    loss = lambda t: -np.log(softmax(logits / t)[np.arange(len(ys)), ys] + 1e-12).mean()
    temperature = min(np.exp(np.linspace(np.log(0.05), np.log(10), 107)), key=loss) if len(ys) else 1.0
    return Model(languages, (w * (idf * SCALE)[:, None]).astype(np.float32), b, float(temperature))


def fold_of(doc_id) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % FOLDS


def held_out(doc_id) -> Column:
    """Rows that are never learnt from; a null id's are."""
    return F.coalesce(fold_of(doc_id) == 0, F.lit(True))


def document_frequencies(texts: DataFrame) -> tuple[np.ndarray, int]:
    """(documents that hold each bucket, documents) over all rows of texts (text); BUCKETS numbers, however many rows."""
    import pyarrow as pa

    def count(batches):
        df, seen, n = np.zeros(BUCKETS + 1, np.int64), np.zeros(BUCKETS, bool), 0
        for (text,) in rows_of(batches, "text"):
            for h in grams(text or ""):
                seen[h] = True
            df[:-1] += seen
            seen[:] = False
            df[-1] += 1
        some = np.flatnonzero(df)
        yield pa.RecordBatch.from_pydict({"bucket": pa.array(some, pa.int32()), "n": pa.array(df[some])})

    found = texts.select("text").mapInArrow(lean(count), "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).toPandas()
    df = np.zeros(BUCKETS + 1, np.int64)
    df[found["bucket"]] = found["n"]
    return df[:-1], int(df[-1])


def train(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learns from text and non-null lang of rows that held_out leaves. The sample is those whose id hashes lowest.

    Null and empty texts of the sample say nothing; whole texts are read, however long. Rows that repeat an id, or id
    and text, are in the sample together, or not at all. Without a row to learn from, every prediction is und.
    """
    import pyarrow as pa

    rows = docs.where(~held_out(docs["doc_id"]) & docs["lang"].isNotNull()).select("doc_id", "lang", "text")
    df, n_docs = document_frequencies(rows)
    counts = rows.groupBy("lang").count()  # one row per language
    share = (F.xxhash64("doc_id", F.lit(41)).cast("double") / F.lit(2.0**64)) + 0.5
    chosen = rows.join(F.broadcast(counts), "lang").where(share < F.lit(float(sample)) / F.col("count")).select("doc_id", "lang", "text")

    def features(batches):
        for doc_id, lang, text in rows_of(batches, "doc_id", "lang", "text"):
            counts = np.zeros(BUCKETS, np.int64)
            for h in grams(text or ""):
                counts += np.bincount(h, minlength=BUCKETS)
            some = np.flatnonzero(counts)
            yield pa.RecordBatch.from_pydict({"doc_id": [doc_id], "lang": [lang], "buckets": [some.astype("<u2").tobytes()], "shares": [(counts[some] / max(1, counts.sum())).astype("<f4").tobytes()]})

    got = chosen.mapInArrow(lean(features), "doc_id long, lang string, buckets binary, shares binary").collect()
    got.sort(key=lambda r: (r["doc_id"], r["lang"], bytes(r["buckets"])))
    return fit([(r["lang"], np.frombuffer(r["buckets"], "<u2").astype(np.int64), np.frombuffer(r["shares"], "<f4").astype(np.float64)) for r in got], df, n_docs)


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """One row per row of docs: doc_id, held_out, lang_pred, score. Only the text decides; lang may be missing.

    A null text, or one without a letter, is und with score 0. Rows that repeat are judged each by itself; an empty
    table gives no rows.
    """
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)  # BUCKETS x languages numbers

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(text) for (text,) in rows_of([batch], "text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), held_out(docs["doc_id"]).alias("held_out"), docs["text"].cast("string").alias("text"))
    return rows.mapInArrow(lean(run), "doc_id long, held_out boolean, lang_pred string, score double")


def keep_identified(docs: DataFrame, model: Model, least: float) -> DataFrame:
    """The rows of docs, all columns, whose language is known with a score of at least `least`."""
    import pyarrow as pa

    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            found = [shared.value.predict(text) for (text,) in rows_of([batch], "text")]
            yield batch.filter(pa.array([lang != UNKNOWN and score >= least for lang, score in found], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)
