"""Quality classifier: ordinal cumulative-link regression on graded ratings.

Grades are 0 (toxic), 1 (poor), 2 (good). One vector of weights over hashed text features is shared by all grades, and
ordered thresholds cut its score: P(grade <= k) = logistic(threshold k - score). Scoring gives the expected grade and the
tail probability P(grade >= 2), by which documents are selected.

Features are hashed into ``2 ** SIZE_BITS`` places: each distinct word (lower case, letters only), the first letters of
words, and the shapes of words (case and the marks behind the letters) by their share of the text. Whole texts are read.

The model is fitted on at most ``SAMPLE`` labelled documents, taken by a hash of their ids; these come to the driver as
hashed features. Of rows that share an id one is taken, that of the smallest text. All documents are scored, in tasks.

Defined results: null text is the empty text, scored by the thresholds alone. Labels with a null grade are left out; of
several labels of one document the lowest grade counts. Without labels of at least two grades there is no model: scores are
null and every document is kept. Rows are scored one by one, other columns pass through, and names of added columns replace
those of the input.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from labelkite.llm.common import bounded, only

SIZE_BITS = 18
SAMPLE = 10_000
GRADES = 3
STEPS = 100
RATE = 0.3
PENALTY = 0.03
SHAPE_WEIGHT = 8.0
KEEP = 0.5

#: Letters of a word's beginning that are a feature too, and the place of the share of words that repeat the one before.
PREFIX = 4
REPEATS = 0
#: Words that more of the sample has say nothing about a grade, nor do those in fewer documents.
COMMON = 0.5
LEAST = 5
LETTERS = re.compile(r"[^\W\d_]+")
MEMO = 150_000


class Features:
    """Words to places; words met before are kept in a dictionary of bounded size."""

    def __init__(self):
        self.memo: dict[str, tuple[int, int, int]] = {}

    def places(self, word: str) -> tuple[int, int, int]:
        """Of the word, its first letters and its shape."""
        from xxhash import xxh64_intdigest

        mask = (1 << SIZE_BITS) - 1
        found = LETTERS.search(word)
        core = found[0] if found else ""
        case = "A" if core.isupper() and len(core) > 1 else "a"
        marks = re.sub(r"\w", "", word)[-4:]
        shape = f"{case if core else '0'}{marks}"
        core = core.lower()
        if len(self.memo) >= MEMO:
            self.memo.clear()
        out = (xxh64_intdigest(core, 1) & mask, xxh64_intdigest(core[:PREFIX] if len(core) > PREFIX else core, 3) & mask, xxh64_intdigest(shape, 2) & mask)
        self.memo[word] = out
        return out

    def of(self, text: str | None):
        """(places, values) of a text."""
        import numpy as np

        found = (text or "").split()
        if not found:
            return np.zeros(0, "i4"), np.zeros(0, "f4")
        get, places = self.memo.get, self.places
        word, start, shape = zip(*[get(w) or places(w) for w in found])
        present = np.array(list({*word, *start}), "i4")
        shapes, counts = np.unique(np.array(shape, "i4"), return_counts=True)
        again = sum(map(str.__eq__, found, found[1:]))
        shapes, counts = np.append(shapes, REPEATS).astype("i4"), np.append(counts, again)
        values = np.concatenate([np.ones(len(present), "f4"), (SHAPE_WEIGHT * counts / len(found)).astype("f4")])
        return np.concatenate([present, shapes]), values


_features: list[Features] = []


def features() -> Features:
    if not _features:
        only("features", _features.clear)
        _features.append(Features())
    return _features[0]


def fit(rows: list[tuple], grades: int = GRADES, *, steps: int = STEPS, rate: float = RATE, penalty: float = PENALTY):
    """(weights, thresholds) by accelerated gradient steps; ``rows``: (grade, places, values).

    A step of a weight is scaled by how much of the sample has its feature, plus ``penalty``: rare words move little.
    """
    import numpy as np

    y = np.array([r[0] for r in rows])
    at = np.concatenate([r[1] for r in rows]).astype("i8")
    x = np.concatenate([r[2] for r in rows]).astype("f4")
    row = np.repeat(np.arange(len(rows)), [len(r[1]) for r in rows])
    n = len(rows)
    having = np.bincount(at, minlength=1 << SIZE_BITS)
    share = np.bincount(at, weights=x, minlength=1 << SIZE_BITS)
    # shapes have shares, of which a common one tells as much as a rare one
    use = ((having >= LEAST) & (having <= COMMON * n) | (share != having))[at]
    at, x, row = at[use], x[use], row[use]
    below = np.clip([(y <= k).mean() for k in range(grades - 1)], 1e-3, 1 - 1e-3)
    start = np.log(below / (1 - below))
    # the first threshold and the logarithms of the steps between them, so that they stay in order
    t = np.concatenate([start[:1], np.log(np.maximum(np.diff(start), 1e-2))])
    w = np.zeros(1 << SIZE_BITS)
    # rare grades count more, by the square root
    weight = (1 / np.maximum(np.bincount(y, minlength=grades), 1) ** 0.5)[y]
    weight /= weight.sum()
    scale = rate / (np.bincount(at, weights=weight[row] * x * x, minlength=len(w)) + penalty)
    pace = [np.zeros_like(w), np.zeros_like(t)]
    sigmoid = lambda z: 1 / (1 + np.exp(-np.clip(z, -40, 40)))
    for step in range(steps):
        theta = np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))
        s = np.bincount(row, weights=x * w[at], minlength=n)
        upper = np.where(y < grades - 1, sigmoid(theta[np.minimum(y, grades - 2)] - s), 1.0)
        lower = np.where(y > 0, sigmoid(theta[np.maximum(y - 1, 0)] - s), 0.0)
        p = np.maximum(upper - lower, 1e-9)
        up, low = upper * (1 - upper) / p, lower * (1 - lower) / p
        ds = weight * (up - low)
        dtheta = np.zeros(grades - 1)
        np.add.at(dtheta, np.minimum(y, grades - 2), -weight * up * (y < grades - 1))
        np.add.at(dtheta, np.maximum(y - 1, 0), weight * low * (y > 0))
        tail = np.cumsum(dtheta[::-1])[::-1]
        dt = np.concatenate([tail[:1], tail[1:] * np.exp(t[1:])])
        dw = np.bincount(at, weights=x * ds[row], minlength=len(w)) + penalty * 1e-2 * w
        keep = step / (step + 3)
        pace[0] = keep * pace[0] - scale * dw
        pace[1] = keep * pace[1] - dt * rate
        w += pace[0]
        t += pace[1]
    return w.astype("f4"), np.cumsum(np.concatenate([t[:1], np.exp(t[1:])]))


def graded(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, grade) from quality and toxic flags."""
    grade = F.when(F.col("toxic") == 1, 0).when(F.col("quality") == 0, 1).when(F.col("quality") == 1, 2)
    return labels.select(key, grade.alias("grade")).filter("grade is not null").groupBy(key).agg(F.min("grade").alias("grade"))


def train(docs: DataFrame, grades: DataFrame, key: str = "doc_id", text: str = "text", *, sample: int = SAMPLE):
    """A model from at most ``sample`` graded documents, or None where fewer than two grades occur."""
    taken = grades.filter(F.col(key).isNotNull()).orderBy(F.xxhash64(key), key).limit(sample)
    # at most `sample` rows of two numbers; of rows of one id the smallest text counts, so no more documents than that
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(taken.select(F.col(key).alias("key"), "grade")), "key")
    rows = rows.groupBy("key").agg(F.min("text").alias("text"), F.min("grade").alias("grade"))

    def run(batches):
        import pyarrow as pa

        for b in batches:
            found = [features().of(t) for t in b.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(1), pa.array([f[0] for f in found], pa.list_(pa.int32())), pa.array([f[1] for f in found], pa.list_(pa.float32()))], names=["grade", "places", "share"])

    import numpy as np

    got = bounded(rows.select("text", "grade")).mapInArrow(run, "grade int, places array<int>, share array<float>").toArrow()
    data = sorted(
        ((g, np.array(p.values.to_numpy()), np.array(v.values.to_numpy())) for g, p, v in zip(got["grade"].to_pylist(), got["places"], got["share"])),
        key=lambda r: (r[0], r[1].tobytes()),
    )
    if len({r[0] for r in data}) < 2:
        return None
    return fit(data)


def score(docs: DataFrame, model, text: str = "text", *, keep: float = KEEP) -> DataFrame:
    """``docs`` with ``expected_grade``, ``tail_probability`` and ``kept``."""
    names = [c for c in docs.columns if c not in ("expected_grade", "tail_probability", "kept")]
    kinds = dict(docs.dtypes)
    if model is None:
        return docs.select(*names, F.lit(None).cast("double").alias("expected_grade"), F.lit(None).cast("double").alias("tail_probability"), F.lit(True).alias("kept"))
    shared = docs.sparkSession.sparkContext.broadcast(model)  # of fixed size

    def run(batches):
        import numpy as np
        import pyarrow as pa

        w, theta = shared.value
        for b in batches:
            s = np.array([float(w[p] @ v) for p, v in (features().of(t) for t in b.column(text).to_pylist())])
            over = 1 / (1 + np.exp(np.clip(theta[None, :] - s[:, None], -40, 40))) if len(s) else np.zeros((0, len(theta)))
            columns = [pa.array(over.sum(1)), pa.array(over[:, -1].copy()), pa.array(over[:, -1] >= keep)]
            yield pa.RecordBatch.from_arrays([b.column(c) for c in names] + columns, names=[*names, "expected_grade", "tail_probability", "kept"])

    schema = ", ".join(f"`{c}` {kinds[c]}" for c in names) + ", expected_grade double, tail_probability double, kept boolean"
    return bounded(docs.select(*names)).mapInArrow(run, schema)


def op7_ordinal_quality(spark, sf_dir: str) -> DataFrame:
    from labelkite.session import table

    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = train(docs, graded(table(spark, sf_dir, "labels")))
    return score(docs, model).drop("text")
