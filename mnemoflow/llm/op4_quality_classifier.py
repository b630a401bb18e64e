"""Quality classifier by co-training two views.

One view sees the text (hashed words and shape), the other the page's metadata (language, source,
size). Both are logistic regressions, first fitted on a bounded sample of labelled rows. In every round
each view scores all unlabelled documents and hands some that it is certain of, with its labels, to the
other view. Which of them is settled by a hash and not by how certain it is, as the most extreme
documents teach least. Tasks keep the first of their own, so a bounded number of rows leaves each, and
the fit's rows are bounded too. Each view is then calibrated by models that have not seen the row (four
folds of the labelled rows), and a logistic combination of the calibrated views scores every document
of the table in one pass.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from mnemoflow.llm.scratch import small_batches
from mnemoflow.llm.textkit import Words, column_words, tidied

#: Labelled rows of the fit at most. Rounds; documents a view hands over in a round; how sure it must be.
LABELLED, ROUNDS, HANDED, SURE = 12000, 2, 800, 0.95
#: Slices in which documents to hand over are ranked first.
SLICES = 16
HASHED, META_HASHED = 128, 64
_SYMBOL, _DIGIT, _UPPER, _SHOUT = (np.zeros(256, bool) for _ in range(4))
_SYMBOL[[b for b in range(33, 127) if not chr(b).isalnum() and chr(b) not in ".,;:!?'\"-()"]] = True
_DIGIT[48:58] = True
_UPPER[65:91] = True
_SHOUT[[33, 63]] = True


def text_features(w: Words) -> np.ndarray:
    """Shape of each text, then shares of hashed words; shares shrink towards usual values in texts of few words."""
    docs, n = len(w.first) - 1, w.counts()
    some = np.maximum(n, 1)
    h, row = w.hashes(lower=True), w.docs()
    length = w.end - w.start
    order = np.lexsort((h, row))
    new = np.ones(len(h), bool)
    new[1:] = (row[order][1:] != row[order][:-1]) | (h[order][1:] != h[order][:-1])
    starts = np.flatnonzero(new)
    runs = np.diff(np.append(starts, len(h)))
    top = np.zeros(docs)
    np.maximum.at(top, row[order][starts], runs)
    same = np.zeros(len(h), bool)
    same[1:] = (h[1:] == h[:-1]) & (row[1:] == row[:-1])
    total = lambda x: np.bincount(row, x, docs)

    def share(kind: np.ndarray) -> np.ndarray:
        sums = np.concatenate([[0], np.cumsum(kind[w.data])])
        return total(sums[w.end] - sums[w.start]) / np.maximum(total(length), 1)

    sure = np.minimum(1, n / 20)
    again = total(same) / (n + 5)
    shape = np.stack([np.sqrt(again), again > 0.1, share(_SHOUT), np.sqrt(share(_SYMBOL)), np.log1p(n), (total(length) + 100) / (n + 20), share(_SYMBOL), share(_DIGIT), share(_UPPER), np.bincount(row[order][starts], minlength=docs) / some * sure, top / some * sure, total(length == 1) / (n + 20), total(length > 25) / (n + 20)], 1)
    hashed = np.zeros((docs, HASHED))
    np.add.at(hashed, (row, (h >> np.uint64(40)).astype(np.int64) % HASHED), 1.0)
    return np.concatenate([shape, hashed / (n + 20)[:, None]], 1).astype(np.float32)


def meta_features(lang: list, source: list, chars: list) -> np.ndarray:
    out = np.zeros((len(lang), 2 * META_HASHED + 3), np.float32)
    slot = lambda x: zlib.crc32(("\0" if x is None else str(x)).encode()) % META_HASHED
    at = np.arange(len(lang))
    out[at, [slot(x) for x in lang]] = 1
    out[at, [META_HASHED + slot(x) for x in source]] = 1
    size = np.log1p(np.array([max(0, x or 0) for x in chars], float))
    out[:, -3], out[:, -2], out[:, -1] = size, size**2 / 10, [x is None for x in chars]
    return out


@dataclass
class Logistic:
    """Standardised logistic regression, fitted by Newton steps with an L2 penalty."""

    mean: np.ndarray
    scale: np.ndarray
    weight: np.ndarray

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, penalty: float = 0.5, steps: int = 12) -> Logistic:
        x = x.astype(float)
        mean, scale = x.mean(0), x.std(0)
        scale[scale < 1e-9] = 1
        z = np.concatenate([(x - mean) / scale, np.ones((len(x), 1))], 1)
        ridge = np.full(z.shape[1], penalty)
        ridge[-1] = 1e-3
        b = np.zeros(z.shape[1])
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(z @ b, -30, 30)))
            s = np.maximum(p * (1 - p), 1e-4)
            step = np.linalg.solve((z * s[:, None]).T @ z + np.diag(ridge), z.T @ (y - p) - ridge * b)
            b += step
            if np.abs(step).max() < 1e-5:
                break
        return Logistic(mean, scale, b)

    def logit(self, x: np.ndarray) -> np.ndarray:
        return np.clip(((x - self.mean) / self.scale) @ self.weight[:-1] + self.weight[-1], -30, 30)


def _p(logit: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-logit))


@dataclass
class CoTrained:
    """Two views, a calibration (a, b: a * logit + b) of each, and their combination."""

    text: Logistic
    meta: Logistic
    calibration: list[tuple[float, float]]
    combine: Logistic

    def score(self, text: np.ndarray, meta: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        views = np.stack([a * m.logit(x) + b for (a, b), m, x in zip(self.calibration, (self.text, self.meta), (text, meta), strict=True)], 1)
        return _p(views[:, 0]), _p(views[:, 1]), _p(self.combine.logit(views))


class CoTraining:
    """The rows that each view learns from, and the models of the last round."""

    def __init__(self, text: np.ndarray, meta: np.ndarray, y: np.ndarray) -> None:
        self.rows = [[(x, y)] for x in (text, meta)]
        self.share = float(np.mean(y))
        self.fit()

    def fit(self) -> None:
        self.models = [self._model(rows) for rows in self.rows]

    @staticmethod
    def _model(rows: list[tuple[np.ndarray, np.ndarray]]) -> Logistic:
        return Logistic.fit(np.concatenate([x for x, _ in rows]), np.concatenate([y for _, y in rows]))

    def _unseen(self, view: int) -> np.ndarray:
        """Logits of the labelled rows by models that were fitted without them; by the view's own where a fold leaves one label alone."""
        (x, y), *given = self.rows[view]
        out, fold = self.models[view].logit(x), np.arange(len(y)) % 4
        for f in range(4):
            if len(np.unique(y[fold != f])) == 2 and (fold == f).any():
                out[fold == f] = self._model([(x[fold != f], y[fold != f]), *given]).logit(x[fold == f])
        return out

    def quota(self, label: int) -> int:
        """Documents of a label that a view hands over in a round."""
        return round(HANDED * (self.share if label else 1 - self.share))

    def certain(self, text: np.ndarray, meta: np.ndarray) -> list[tuple[int, int, np.ndarray]]:
        """(view, label, how sure) for each view and label."""
        p = [_p(m.logit(x)) for m, x in zip(self.models, (text, meta), strict=True)]
        return [(view, label, p[view] if label else 1 - p[view]) for view in (0, 1) for label in (0, 1)]

    def learn(self, view: int, label: int, text: np.ndarray, meta: np.ndarray) -> None:
        """Documents that a view is certain of, for the other view."""
        self.rows[1 - view].append(((meta, text)[view], np.full(len(text), float(label))))

    def finish(self) -> CoTrained:
        y = self.rows[0][0][1]
        unseen, calibration = [self._unseen(view) for view in (0, 1)], []
        for z in unseen:
            c = Logistic.fit(z[:, None], y)
            a = float(c.weight[0] / c.scale[0])
            calibration.append((max(a, 0.0), float(c.weight[1] - a * c.mean[0])) if a > 0 else (0.0, float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))))
        stacked = np.stack([a * z + b for (a, b), z in zip(calibration, unseen, strict=True)], 1)
        return CoTrained(*self.models, calibration, Logistic.fit(stacked, y))


def _batches(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """Parts of batches (doc_id, text, lang, source, n_chars, ...) with the features of both views."""
    for batch in batches:
        for i, j, w in column_words(batch.column(1)):
            part = batch.slice(i, j - i)
            yield part, text_features(w), meta_features(*(part.column(c).to_pylist() for c in (2, 3, 4)))


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for part, text, meta in _batches(batches):
        yield pa.RecordBatch.from_arrays([part.column(0), part.column(5), pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary())], ["doc_id", "quality", "x", "m"])


def _certain(state: CoTraining, taken: list[np.ndarray]):
    """The first documents of a task, by their hash, that a view is certain of and has not handed over, with the features of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best: dict[tuple[int, int], tuple] = {}
        for part, text, meta in _batches(batches):
            ids, mixed = part.column(0).to_numpy(zero_copy_only=False), part.column(5).to_numpy()
            for view, label, sure in state.certain(text, meta):
                at = np.flatnonzero((sure >= SURE) & ~np.isin(ids, taken[view]))
                old = best.get((view, label))
                new = tuple(x[at] for x in (mixed, ids, text, meta))
                new = new if old is None else tuple(np.concatenate(x) for x in zip(old, new, strict=True))
                order = np.argsort(new[0], kind="stable")[: state.quota(label)]
                best[view, label] = tuple(x[order] for x in new)
        for (view, label), (mixed, ids, text, meta) in best.items():
            n = len(mixed)
            yield pa.RecordBatch.from_arrays([
                pa.array([view] * n, pa.int32()), pa.array([label] * n, pa.int32()), pa.array(mixed, pa.int64()), pa.array(ids, pa.int64()),
                pa.array([x.tobytes() for x in text], pa.binary()), pa.array([x.tobytes() for x in meta], pa.binary()),
            ], ["view", "label", "h", "doc_id", "x", "m"])

    return run


def _columns(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def _matrices(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    return tuple(np.frombuffer(b"".join(rows[c].to_pylist()), np.float32).reshape(rows.num_rows, -1) for c in ("x", "m"))


def train(docs: DataFrame, labels: DataFrame, labelled: int = LABELLED, rounds: int = ROUNDS) -> CoTrained | None:
    """Fits on at most ``labelled`` labelled documents, chosen by a hash of doc_id, and in each round on unlabelled documents that a view is certain of, out of all; null without labels of both kinds.

    docs: doc_id, text, lang, source, n_chars; labels: doc_id, quality (1 good, 0 bad). Documents whose
    doc_id is null or whose label is in the fit are never handed over; a doc_id that several rows have is
    one document of the fit, and several labels of one are averaged.
    """
    small_batches(docs.sparkSession)
    order = F.xxhash64(F.lit(29), "doc_id")
    labels = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("double").alias("quality")).dropna()
    known = labels.groupBy("doc_id").agg(F.round(F.avg("quality")).alias("quality")).orderBy(order, "doc_id").limit(labelled)
    # Bounded by the parameter, so it can be broadcast at any size of the corpus.
    rows = _columns(docs).join(F.broadcast(known), "doc_id").select("doc_id", "text", "lang", "source", "n_chars", "quality")
    rows = rows.mapInArrow(tidied(_features), "doc_id long, quality double, x binary, m binary")
    found = rows.groupBy("doc_id").agg(F.min(F.struct("quality", "x", "m")).alias("r")).select("doc_id", "r.*").toArrow().sort_by("doc_id")
    y = np.array(found["quality"].to_pylist(), float)
    if len(np.unique(y)) < 2:
        return None
    mixed = np.random.default_rng(11).permutation(found.num_rows)
    state = CoTraining(*(x[mixed] for x in _matrices(found)), y[mixed])
    free = _columns(docs).where("doc_id IS NOT NULL").join(F.broadcast(known.select("doc_id")), "doc_id", "left_anti").withColumn("h", order)
    taken = [np.zeros(0, np.int64), np.zeros(0, np.int64)]
    for _ in range(rounds):
        certain = free.mapInArrow(tidied(_certain(state, taken)), "view int, label int, h long, doc_id long, x binary, m binary")
        certain = certain.groupBy("view", "label", "doc_id").agg(F.min(F.struct("h", "x", "m")).alias("r"))
        # Ranked in slices first, so that the last rank sees at most SLICES * HANDED rows of a view and label, however many tasks there are.
        by = Window.partitionBy("view", "label", F.pmod(F.xxhash64(F.lit(31), "doc_id"), F.lit(SLICES))).orderBy("r", "doc_id")
        certain = certain.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= HANDED)
        rank = F.row_number().over(Window.partitionBy("view", "label").orderBy("r", "doc_id"))
        certain = certain.withColumn("rank", rank).where(F.col("rank") <= HANDED).select("view", "label", "rank", "doc_id", "r.x", "r.m").toArrow().sort_by("rank")
        for view in (0, 1):
            for label in (0, 1):
                own = certain.filter((pc.field("view") == view) & (pc.field("label") == label)).slice(0, state.quota(label))
                if own.num_rows:
                    taken[view] = np.concatenate([taken[view], own["doc_id"].to_numpy()])
                    state.learn(view, label, *_matrices(own))
        state.fit()
    return state.finish()


def classify(docs: DataFrame, model: CoTrained | None, least: float = 0.3, keep_rows: bool = False) -> DataFrame:
    """Scores all documents: doc_id, text_score, meta_score, score (of being good) and kept (score >= least); with ``keep_rows`` text, lang, source and n_chars too.

    docs: doc_id, text, lang, source, n_chars; other columns are not read. Null and empty texts have the
    features of no words, and nulls in the metadata are values of their own; rows with null or
    repeated doc_id are scored like others. Without a model every score is 1. An empty table gives no
    rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, text, meta in _batches(batches):
            scores = model.score(text, meta) if model else (np.ones(part.num_rows),) * 3
            yield pa.RecordBatch.from_arrays([part.column(0), *map(pa.array, scores), pa.array(scores[2] >= least), *(part.column(c) for c in extra)], names)

    extra = (1, 2, 3, 4) if keep_rows else ()
    names = ["doc_id", "text_score", "meta_score", "score", "kept", *(["text", "lang", "source", "n_chars"] if keep_rows else [])]
    schema = "doc_id long, text_score double, meta_score double, score double, kept boolean" + (", text string, lang string, source string, n_chars long" if keep_rows else "")
    small_batches(docs.sparkSession)
    return _columns(docs).mapInArrow(tidied(run), schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return classify(docs, train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")))


ORACLE_SQL = None
