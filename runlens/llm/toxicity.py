"""Toxicity by compression distance: windows of a text under two zstandard dictionaries.

One dictionary is trained on ordinary windows. The other one has what toxic texts bring
along, in front of the same ordinary content and with the same entropy tables, so that both
treat ordinary words alike and a window's two compressed lengths differ only by what toxic
text explains. The difference of a window, in bytes, is its distance. On labelled texts that the
dictionaries have not seen, each distance gets its log-likelihood ratio, and a logistic
curve over the ratios of a text gets its threshold.
"""

from __future__ import annotations

import zlib
from collections import Counter
from collections.abc import Iterable, Iterator, Sequence
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from runlens.llm.common import written

# Labelled rows that the model is fit on, at most, and bytes of their whole texts, per label.
TOXIC_ROWS, ORDINARY_ROWS, SAMPLE_BYTES = 3_000, 6_000, 24_000_000
WINDOW = 16  # words
ORDINARY_BYTES, TOXIC_BYTES = 65_536, 8_192
# A word belongs to the toxic dictionary if it is in so many toxic texts, or this share of
# them, and in no ordinary one.
LEAST_TEXTS, LEAST_SHARE = 2, 0.005
LOW, HIGH = -6, 12  # distances beyond are counted with these
# A dictionary's entropy tables end with these three offsets (zstandard format, section on dictionaries).
FIRST_OFFSETS = b"\x01\0\0\0\x04\0\0\0\x08\0\0\0"


@dataclass(frozen=True)
class Model:
    """Two dictionaries, a weight per distance, and a logistic curve over four measures."""

    ordinary: bytes
    toxic: bytes
    ratios: tuple[float, ...]
    means: tuple[float, ...]
    scales: tuple[float, ...]
    weights: tuple[float, ...]


def words_of(text: str) -> list[str]:
    return text.lower().split()


def windows_of(text: str, n: int = WINDOW) -> list[bytes]:
    words = words_of(text)
    return [f" {' '.join(words[i : i + n])} ".encode("utf-8", "surrogatepass") for i in range(0, len(words), n)]


def compressor(dictionary: bytes) -> zstandard.ZstdCompressor:
    settings = zstandard.ZstdCompressionParameters(
        format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        compression_level=3,
        window_log=17,
        hash_log=17,
        chain_log=17,
        search_log=5,
        min_match=5,
        strategy=zstandard.STRATEGY_GREEDY,
        write_content_size=False,
        write_checksum=False,
        write_dict_id=False,
    )
    if not dictionary:
        return zstandard.ZstdCompressor(compression_params=settings)
    content = zstandard.ZstdCompressionDict(dictionary)
    content.precompute_compress(compression_params=settings)
    return zstandard.ZstdCompressor(dict_data=content, compression_params=settings)


class Distances:
    """Distances of windows under a pair of dictionaries."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.plain, self.other = compressor(ordinary).compress, compressor(toxic).compress

    def of(self, text: str) -> np.ndarray:
        """Whole bytes that the toxic dictionary saves in each window, from 0 for ``LOW``."""
        plain, other = self.plain, self.other
        saved = [len(plain(window)) - len(other(window)) for window in windows_of(text)]
        return np.clip(np.array(saved, dtype=np.int64), LOW, HIGH) - LOW


def measures(distances: np.ndarray, ratios: np.ndarray) -> list[float]:
    """Sum, mean and three largest ratios of a text's windows, and how many there are."""
    if not len(distances):
        return [0.0, 0.0, 0.0, 0.0]
    own = ratios[distances]
    return [float(own.sum()), float(own.mean()), float(np.sort(own)[-3:].sum()), float(np.log1p(len(own)))]


def texts_by_word(texts: Iterable[str]) -> Counter:
    found: Counter = Counter()
    for text in set(texts):  # copies count once
        found.update(set(words_of(text)))
    return found


def dictionaries(ordinary: Sequence[str], toxic: Sequence[str]) -> tuple[bytes, bytes]:
    """The two dictionaries; both are empty if zstandard finds too little to train on."""
    windows = sorted({w for text in ordinary for w in windows_of(text, 2 * WINDOW)}, key=zlib.crc32)
    try:
        plain = zstandard.train_dictionary(ORDINARY_BYTES, windows, k=48, d=6, f=20, accel=1).as_bytes()
    except zstandard.ZstdError:
        return b"", b""
    known, new = texts_by_word(ordinary), texts_by_word(toxic)
    least = max(LEAST_TEXTS, LEAST_SHARE * len(set(toxic)))
    own = sorted((n, word) for word, n in new.items() if n >= least and word not in known)
    content = b"".join(f" {word} ".encode("utf-8", "surrogatepass") for _, word in own)[-TOXIC_BYTES:]
    start = plain.find(FIRST_OFFSETS) + len(FIRST_OFFSETS)
    return plain, plain[:start] + content + plain[start:]


def fitted(rows: Sequence[tuple[str, int]], toxic_share: float) -> Model | None:
    """The model for texts with labels; ``toxic_share`` is that of all labelled rows.

    Two thirds of the texts, by a digest so that copies stay together, make the dictionaries,
    the others the weights. Without texts of both labels in both parts there is no model.
    """
    part = [zlib.crc32(text.encode("utf-8", "surrogatepass")) % 3 for text, _ in rows]
    learn = [row for row, p in zip(rows, part) if p]
    tune = [row for row, p in zip(rows, part) if not p]
    if any(len({label for _, label in some}) < 2 for some in (learn, tune)):
        return None
    ordinary, toxic = dictionaries([t for t, label in learn if not label], [t for t, label in learn if label])
    distances = Distances(ordinary, toxic)
    found = [distances.of(text) for text, _ in tune]
    label = np.array([label for _, label in tune], dtype=np.float64)
    counts = [
        np.bincount(np.concatenate([d for d, y in zip(found, label) if y == k]), minlength=HIGH - LOW + 1) + 1.0
        for k in (0, 1)
    ]
    ratios = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())
    rows_x = np.array([measures(d, ratios) for d in found])
    means, scales = rows_x.mean(axis=0), rows_x.std(axis=0) + 1e-9
    x = np.column_stack([(rows_x - means) / scales, np.ones(len(rows_x))])
    # Rows weigh as if labels were as frequent as among all labelled rows.
    share = label.mean()
    weight = np.where(label == 1, toxic_share / share, (1 - toxic_share) / (1 - share))
    return Model(ordinary, toxic, tuple(ratios), tuple(means), tuple(scales), tuple(logistic(x, label, weight)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, penalty: float = 0.1) -> np.ndarray:
    """Weights of a logistic curve by Newton's steps, halved until they no longer overshoot."""

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((weight * (np.logaddexp(0, z) - y * z)).sum() + penalty / 2 * (w @ w))

    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -500, 500)))
        slope = x.T @ (weight * (p - y)) + penalty * w
        bend = (x * (weight * p * (1 - p))[:, None]).T @ x + penalty * np.eye(len(w))
        step, size = np.linalg.solve(bend, slope), 1.0
        while loss(w - size * step) > loss(w) and size > 1e-6:
            size /= 2
        w = w - size * step
        if np.abs(step).max() < 1e-9:
            break
    return w


class Scorer:
    def __init__(self, model: Model):
        self.distances = Distances(model.ordinary, model.toxic)
        self.ratios, self.means = np.array(model.ratios), np.array(model.means)
        self.scales, self.weights = np.array(model.scales), np.array(model.weights)

    def score(self, text: str) -> float:
        x = (np.array(measures(self.distances.of(text), self.ratios)) - self.means) / self.scales
        return float(1 / (1 + np.exp(-np.clip(x @ self.weights[:-1] + self.weights[-1], -500, 500))))


@lru_cache(maxsize=2)
def scorer(model: Model) -> Scorer:
    """The scorer of this worker process."""
    return Scorer(model)


def held_out(doc_id: str) -> F.Column:
    """True for a fifth of the ids, by crc32 of the id as text; for null ids too."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit(""))), F.lit(5)) == 0


def sample(docs: DataFrame, labels: DataFrame, doc_id: str, text: str, label: str) -> tuple[list[tuple[str, int]], float]:
    """Whole labelled texts to fit on, up to the stated rows and bytes of each label, and the share of label 1."""
    usable = labels.select(F.col(doc_id).alias("id"), F.col(label).cast("int").alias("y")).filter("y IN (0, 1) AND id IS NOT NULL")
    usable = written(usable.filter(~held_out("id")), "toxic-labels")
    total, toxic = usable.agg(F.count("*"), F.coalesce(F.sum("y"), F.lit(0))).first()
    if not toxic or toxic == total:
        return [], 0.0
    chosen = None
    for y, most in ((0, ORDINARY_ROWS), (1, TOXIC_ROWS)):
        some = usable.filter(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(most)
        chosen = some if chosen is None else chosen.unionByName(some)
    rows = docs.select(F.col(doc_id).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    rows = rows.join(F.broadcast(chosen.dropDuplicates(["id", "y"])), "id")  # at most 9,000 ids
    # Ids may repeat in the documents, so rows are bounded anew.
    rows = rows.select("y", "text", F.xxhash64("text").alias("h"), F.octet_length("text").alias("n"))
    found: list[tuple[str, int]] = []
    for y, most in ((0, ORDINARY_ROWS), (1, TOXIC_ROWS)):
        few = rows.filter((F.col("y") == y) & (F.col("n") <= SAMPLE_BYTES)).orderBy("h", "text").limit(most)
        so_far = F.sum("n").over(Window.partitionBy("y").orderBy("h", "text").rowsBetween(Window.unboundedPreceding, 0))
        few = few.withColumn("so_far", so_far).filter(F.col("so_far") <= SAMPLE_BYTES).select("text")
        found += [(r.text, y) for r in few.toLocalIterator()]
    return found, toxic / total


def scored(
    docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "toxic"
) -> DataFrame:
    """One row per document: whether it is held out, its score from 0 to 1, and the prediction.

    The model is fit on labelled rows that are not held out, up to ``TOXIC_ROWS`` and
    ``ORDINARY_ROWS`` rows and ``SAMPLE_BYTES`` bytes of each label, chosen by hashes; labels that
    are null or beyond 0 and 1 are ignored. Every whole text is scored, long ones in all
    their windows. Null and empty texts have no windows and get the score of such a text. Null ids count
    as held out; rows that share an id and repeated rows each keep their row and score
    alike if their texts do; other columns are ignored. An empty table gives no rows. If there
    are no labels of both kinds to learn from, every score is 0.
    """
    rows, share = sample(docs, labels, doc_id, text, label)
    model = fitted(rows, share)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of = scorer(model).score if model else lambda _: 0.0
        for batch in batches:
            found = pa.array([of(value.as_py()) for value in batch.column("text")], pa.float64())
            yield pa.record_batch([batch.column("doc_id"), batch.column("held_out"), found], names=["doc_id", "held_out", "score"])

    kind = docs.schema[doc_id].dataType.simpleString()
    chosen = docs.select(
        F.col(doc_id).alias("doc_id"), held_out(doc_id).alias("held_out"), F.coalesce(F.col(text), F.lit("")).alias("text")
    )
    result = chosen.mapInArrow(score, f"doc_id {kind}, held_out boolean, score double")
    return result.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
