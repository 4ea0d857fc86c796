"""Compression classifier: zstandard dictionaries of good and of bad labelled texts.

A text is compressed with either dictionary, in blocks: a long text would become a dictionary of its own, which
hides the difference. The difference of the two sizes over the text's length is
calibrated to a probability by a logistic regression of the label on it alone. So that a text of a few
bytes, whose sizes hardly can differ, isn't taken for a bad one, PRIOR bytes that differ as the calibration's
texts do on average are added to each text.

Dictionaries and calibration come from a bounded sample of labelled rows: `per_class` rows of each
class, of texts of 1 to `longest` bytes, by hash of the id. The first half of a class, whole texts end to
end, is the content of its dictionary, as far as they fit into `dictionary` bytes (zstandard hardly looks further back than some 3
MB at this level); all others fit the calibration, weighted to the classes' shares among all labelled rows. Every text is scored, whole.

Nulls: a null text is empty, and an empty text's score is the share of good labels; rows with a null
label are not learnt from; rows with a null id are in no held-out fold. A document labelled twice
is good if at least half of its labels are; of rows that repeat an id the least text is learnt from. Repeated
rows are scored alike. Without texts of both classes the score is the share of good labels, or 0.5 without
any labels. Extra columns are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from quizloom.llm.common import fold, forget, give_back

#: Bytes that are compressed by themselves, and bytes of average difference that are added to a text.
BLOCK, PRIOR = 2048, 32


class Model:
    """Two dictionaries and the calibration; a small picklable value."""

    def __init__(self, good: bytes, bad: bytes, share: float, level: int) -> None:
        self.good, self.bad, self.share, self.level = good, bad, share, level
        prior = np.log(share / (1 - share)) if 0 < share < 1 else (20.0 if share else -20.0)
        self.weights, self.mean = np.array([prior, 0.0]), 0.0
        self._by: list | None = None

    def __getstate__(self) -> dict:
        return self.__dict__ | {"_by": None}

    def compressors(self) -> list:
        import zstandard

        if self._by is None:
            self._by = []
            for raw in (self.good, self.bad):
                held = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                held.precompute_compress(level=self.level)
                self._by.append(zstandard.ZstdCompressor(dict_data=held, level=self.level, write_checksum=False, write_content_size=False, write_dict_id=False))
        return self._by

    def rest(self) -> None:
        """Lets go of what compressing takes, some tens of MB, until it is needed again."""
        self._by = None

    def saved(self, texts: list[bytes]) -> np.ndarray:
        """How many bytes the good dictionary saves beyond the bad one, over all blocks."""
        if not (self.good and self.bad and texts):
            return np.zeros(len(texts))
        sizes = lambda c, t: sum(len(c.compress(t[at : at + BLOCK])) for at in range(0, len(t), BLOCK))
        good, bad = (np.array([sizes(c, t) for t in texts], float) for c in self.compressors())
        return bad - good

    def differences(self, texts: list[bytes]) -> np.ndarray:
        """What the good dictionary saves beyond the bad one, in hundredths of a text's length and the prior's."""
        n = np.array([len(t) for t in texts], float)
        return (100 * self.saved(texts) + PRIOR * self.mean) / (n + PRIOR)

    def calibrate(self, texts: list[bytes], y: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> None:
        """Logistic regression of the label, by Newton's method, weighted to the classes' shares.

        A step is halved until the loss falls, so that it ends at the only minimum.
        """
        weight = np.where(y == 1, self.share / (y == 1).mean(), (1 - self.share) / (y == 0).mean())
        n = np.array([len(t) for t in texts], float)
        self.mean = float(np.average(100 * self.saved(texts) / np.maximum(n, 1), weights=weight))
        x = self.differences(texts)
        a, w, pull = np.stack([np.ones(len(x)), x], 1), np.zeros(2), np.array([0.0, ridge])

        def loss(w: np.ndarray) -> float:
            z = a @ w
            return float((weight * (np.logaddexp(0, z) - y * z)).sum() + (pull * w * w).sum() / 2)

        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.clip(a @ w, -500, 500)))
            slope = a.T @ (weight * (y - p)) - pull * w
            step = np.linalg.solve((a * (weight * p * (1 - p))[:, None]).T @ a + np.diag(pull + 1e-6), slope)
            now = loss(w)
            while np.abs(step).max() > 1e-9 and loss(w + step) > now:
                step /= 2
            w = w + step
            if np.abs(step).max() <= 1e-9:
                break
        self.weights = w

    def score(self, texts: list[bytes]) -> np.ndarray:
        """0 to 1; an empty text has the classes' share."""
        z = self.weights[0] + self.weights[1] * self.differences(texts)
        out = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
        out[[not t for t in texts]] = self.share
        return out


def fit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", learn: Column | None = None, per_class: int = 3000, longest: int = 1 << 14, dictionary: int = 2_500_000, level: int = 9) -> Model:
    """Learns from at most per_class rows of either class, among those where learn holds."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull())
    if learn is not None:
        known = known.where(learn)
    known = known.groupBy(F.col(id_col).cast("long").alias("id")).agg((F.avg(label_col) >= 0.5).cast("int").alias("label"))
    n, share = known.agg(F.count("*"), F.avg("label")).first()
    if not n:
        return Model(b"", b"", 0.5, level)
    # Ids with a text of a fit length come first, so that the sample is as large as it may be.
    fit_ids = docs.where(F.octet_length(text_col).between(1, longest)).select(F.col(id_col).cast("long").alias("id"))
    known = known.join(fit_ids.distinct(), "id", "left_semi").withColumn("order", F.xxhash64("id"))
    picked = known.where("label = 1").orderBy("order", "id").limit(per_class).unionByName(known.where("label = 0").orderBy("order", "id").limit(per_class))
    # At most 2 * per_class rows, so they can be sent to every task.
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).where(F.octet_length("text").between(1, longest))
    rows = texts.join(F.broadcast(picked), "id").groupBy("id").agg(F.min("label").alias("label"), F.min("text").alias("text"), F.min("order").alias("order")).toArrow()
    order = np.lexsort((rows["id"].to_numpy(), rows["order"].to_numpy()))
    label = rows["label"].to_numpy()[order]
    text = [t.encode() for t in rows["text"].take(pa.array(order)).to_pylist()]
    half = np.zeros(len(label), bool)
    for c in (0, 1):
        at = np.flatnonzero(label == c)
        at = at[: (len(at) + 1) // 2]
        half[at[np.cumsum([len(text[i]) + 1 for i in at]) <= dictionary + 1]] = True
    good, bad = (b"\n".join(text[i] for i in np.flatnonzero(half & (label == c))) for c in (1, 0))
    model = Model(good, bad, float(share), level)
    rest = np.flatnonzero(~half)
    if good and bad and len(set(label[rest])) == 2:
        model.calibrate([text[i] for i in rest], label[rest])
    return model


def with_score(docs: DataFrame, model: Model, text_col: str = "text", score_col: str = "score") -> DataFrame:
    """docs with score_col: the calibrated likelihood, 0 to 1, that a text is good."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.arrow_udf(DoubleType())
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        forget()
        for texts in batches:
            out = [shared.value.score([(t.as_py() or "").encode() for t in texts.slice(lo, 256)]) for lo in range(0, len(texts), 256)]
            yield pa.array(np.concatenate(out or [np.empty(0)]), pa.float64())
        shared.value.rest()
        give_back()

    return docs.withColumn(score_col, score(F.col(text_col)))


def learnable(id_col: str = "doc_id") -> Column:
    """Not in the held-out fold."""
    return fold(F.col(id_col), 4) != 2
