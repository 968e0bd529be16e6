"""Quality by ordinal regression on graded ratings: a cumulative-link (proportional odds) model over hashed text.

One weight per hashed feature is shared by all grades; ordered thresholds cut the score: P(grade <= k) = sigmoid(t_k - score).
The model is fitted on a sample of the ratings of bounded size (``SAMPLE``), over features that at least ``SEEN`` of its
texts have and that speak for a lower grade; every document is scored whole. Features are sets: words, their beginnings, the shapes of words, and how much
of a text repeats.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitegauge.llm.common import extended, materialised, without_collector, word_chunks

SAMPLE = 12_000
SEEN = 3
LIFT = 3.0
PENALTY = 0.02
ROUNDS = 80
SHAPES = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
EDGES = bytes(c for c in range(33, 127) if not chr(c).isalnum())
CACHED = 300_000
LONGEST_CACHED = 64


def word_features(word: bytes) -> tuple[int, ...]:
    """Hashes of the bare word, its first four and five bytes, and its shape with runs shortened."""
    bare, shape = word.strip(EDGES).lower(), bytearray()
    for c in word.translate(SHAPES):
        if shape[-2:] != bytes((c, c)):
            shape.append(c)
    out = [zlib.crc32(b"s" + shape[:12])]
    if bare:
        out.append(zlib.crc32(b"w" + bare))
        if len(bare) > 4:
            out.append(zlib.crc32(b"4" + bare[:4]))
        if len(bare) > 5:
            out.append(zlib.crc32(b"5" + bare[:5]))
    return tuple(out)


def _read(raw: bytes) -> tuple[set[bytes], int, int]:
    """Distinct words, and two features of the whole: how many words repeat, how many repeat the word before."""
    words, total, again, last = set(), 0, 0, None
    for some in word_chunks(raw):
        words.update(some)
        total += len(some)
        again += sum(map(bytes.__eq__, some, some[1:])) + (some[:1] == [last])
        last = some[-1] if some else last
    size = total.bit_length()
    return words, zlib.crc32(b"d%d %d" % (size, 8 * len(words) // max(1, total))), zlib.crc32(b"r%d" % (8 * again // max(1, total)))


def features(raw: bytes) -> set[int]:
    words, distinct, again = _read(raw)
    return {f for w in words for f in word_features(w)} | {distinct, again}


@dataclass
class Ordinal:
    """Weights by feature hash, and one threshold below each grade but the first."""

    weights: dict[int, float]
    thresholds: list[float]

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade >= k) for k = 1, 2, ... as columns."""
        return 1 / (1 + np.exp(np.clip(np.array(self.thresholds)[None, :] - score[:, None], -500, 500)))


def _likelihood(theta, weights, of, ends, grades, penalty):
    """Negative log likelihood a row with its gradient; theta is the first threshold, then logs of the gaps."""
    gaps = np.exp(theta[1:])
    cuts = np.concatenate([[-np.inf], theta[0] + np.concatenate([[0], np.cumsum(gaps)]), [np.inf]])
    starts = np.concatenate([[0], ends[:-1]])
    score = np.add.reduceat(np.append(weights[of], 0), starts) * (ends > starts)
    upper = 1 / (1 + np.exp(np.clip(score - cuts[grades + 1], -500, 500)))
    lower = 1 / (1 + np.exp(np.clip(score - cuts[grades], -500, 500)))
    p = np.maximum(upper - lower, 1e-12)
    d_upper, d_lower = upper * (1 - upper), lower * (1 - lower)
    by_score = (d_upper - d_lower) / p / len(grades)
    by_weight = np.bincount(of, weights=np.repeat(by_score, ends - starts), minlength=len(weights)) + penalty * weights / len(grades)
    by_cut = np.zeros(len(cuts))
    np.add.at(by_cut, grades + 1, -d_upper / p / len(grades))
    np.add.at(by_cut, grades, d_lower / p / len(grades))
    inner = by_cut[1:-1]
    by_theta = np.concatenate([[inner.sum()], [inner[k + 1 :].sum() * gaps[k] for k in range(len(gaps))]])
    value = -np.log(p).mean() + penalty * (weights @ weights) / 2 / len(grades)
    return value, np.concatenate([by_theta, by_weight])


def telling(found: list[np.ndarray], grades: np.ndarray, seen: int, lift: float) -> np.ndarray:
    """The features that at least ``seen`` texts have, and that some grade below the top has ``lift`` standard deviations too often.

    Features of ordinary text say nothing against it; left in, their number would make long texts look good whatever else
    they hold.
    """
    hashes, inverse, counts = np.unique(np.concatenate(found), return_inverse=True, return_counts=True)
    own = np.repeat(grades, [len(f) for f in found])
    tells = np.zeros(len(hashes), dtype=bool)
    for grade in range(int(grades.max())):
        share = (grades == grade).mean()
        have = np.bincount(inverse, weights=own == grade, minlength=len(hashes))
        tells |= have - counts * share > lift * np.sqrt(counts * share * (1 - share))
    return hashes[tells & (counts >= seen)]


def fit_rows(
    rows: list[tuple[np.ndarray, int]], seen: int = SEEN, lift: float = LIFT, penalty: float = PENALTY, rounds: int = ROUNDS
) -> Ordinal | None:
    """Fit by limited-memory quasi-Newton steps; None without rows. Grades run from 0; those that no row has get no room."""
    if not rows:
        return None
    grades = np.array([g for _, g in rows], dtype=np.int64)
    top = max(1, int(grades.max()))
    hashes = telling([f for f, _ in rows], grades, seen, lift)
    of, ends = [], []
    for f, _ in rows:
        at = np.searchsorted(hashes, f)
        at = at[np.append(hashes, -1)[at] == f]
        of.append(at)
        ends.append(len(at))
    of, ends = np.concatenate(of), np.cumsum(ends)
    x = np.zeros(top + len(hashes))
    share = np.clip([(grades < k).mean() for k in range(1, top + 1)], 1e-3, 1 - 1e-3)
    first = np.maximum.accumulate(np.log(share / (1 - share)) + 1e-2 * np.arange(top))
    x[0], x[1:top] = first[0], np.log(np.maximum(np.diff(first), 1e-2))
    call = lambda v: _likelihood(v[:top], v[top:], of, ends, grades, penalty)
    value, slope = call(x)
    steps: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        way, kept = -slope, []
        for s, y in reversed(steps):
            a = (s @ way) / (s @ y)
            kept.append(a)
            way = way - a * y
        if steps:
            s, y = steps[-1]
            way = way * (s @ y) / (y @ y)
        for (s, y), a in zip(steps, reversed(kept), strict=True):
            way = way + s * (a - (y @ way) / (s @ y))
        size, down = 1.0 if steps else 1 / max(1.0, np.abs(slope).sum()), slope @ way
        while size > 1e-10:
            value_, slope_ = call(x + size * way)
            if value_ <= value + 1e-4 * size * down:
                break
            size /= 2
        else:
            break
        s, y = size * way, slope_ - slope
        if s @ y > 1e-12:
            steps = [*steps[-9:], (s, y)]
        done = value - value_ < 1e-7 * max(1.0, abs(value))
        x, value, slope = x + s, value_, slope_
        if done:
            break
    cuts = x[0] + np.concatenate([[0], np.cumsum(np.exp(x[1:top]))])
    return Ordinal({int(h): float(w) for h, w in zip(hashes, x[top:], strict=True)}, cuts.tolist())


def fit(docs: DataFrame, ratings: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE) -> Ordinal | None:
    """Fit on about ``sample`` of the rated documents, drawn by the hash of their ids.

    ``ratings`` has (id, grade); of several grades of a document the lowest counts, null ids and grades are left out.
    """
    graded = ratings.select(F.col(ratings.columns[0]).alias("rated"), F.col(ratings.columns[1]).cast("int").alias("grade"))
    graded = graded.na.drop().groupBy("rated").agg(F.min("grade").alias("grade"))
    count = graded.count()
    if count > sample:
        graded = graded.where(F.pmod(F.xxhash64("rated"), F.lit(1 << 30)) < int((1 << 30) * sample / count))
    # The sample is of bounded size, so it may go to every task; only rated texts travel.
    texts = docs.select(F.col(f"`{id_col}`").alias("rated"), F.col(f"`{text_col}`").cast("binary").alias("raw"))
    rated = texts.join(F.broadcast(graded), "rated").select("raw", "grade")

    def read(batches):
        for batch in batches:
            found = [np.fromiter(features(x.as_py() or b""), dtype=np.int64) for x in batch["raw"]]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int64())), batch["grade"]], ["found", "grade"])

    drawn = materialised(rated.mapInArrow(read, "found array<bigint>, grade int"), "rated-features")
    hashes = np.array(sorted(r.feature for r in _telling_in(drawn, SEEN, LIFT).collect()), dtype=np.int64)

    def reduce(batches):
        for batch in batches:
            found = [x[np.isin(x, hashes)] for x in (np.array(f.as_py(), dtype=np.int64) for f in batch["found"])]
            sorted_ = pa.array([np.sort(f) for f in found], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([sorted_, batch["grade"]], ["found", "grade"])

    rows = drawn.mapInArrow(reduce, "found array<bigint>, grade int").collect()
    pairs = sorted((r["found"], r["grade"]) for r in rows)  # the order of tasks must not change the sums
    return fit_rows([(np.array(f, dtype=np.int64), g) for f, g in pairs])


def _telling_in(drawn: DataFrame, seen: int, lift: float) -> DataFrame:
    """(feature): the choice of ``telling``, made where the features are; only those chosen reach the driver."""
    numbers = {r["grade"]: r["count"] for r in drawn.groupBy("grade").count().collect()}
    total = sum(numbers.values())
    each = drawn.select(F.explode("found").alias("feature"), "grade")
    lower = sorted(numbers)[:-1]
    own = [F.count(F.when(F.col("grade") == g, 1)).alias(f"n{g}") for g in lower]
    counts = each.groupBy("feature").agg(F.count("*").alias("n"), *own).where(F.col("n") >= seen)
    tells = F.lit(False)
    for g in lower:
        share = numbers[g] / total
        tells |= F.col(f"n{g}") - F.col("n") * share > lift * F.sqrt(F.col("n") * (share * (1 - share)))
    return counts.where(tells).select("feature")


def score(docs: DataFrame, model: Ordinal | None, text_col: str = "text") -> DataFrame:
    """Every row and column of ``docs`` with ``expected_grade`` and ``tail_probability`` (of the highest grade).

    Null and empty texts are scored like any other, by the features they lack. Without a model (no ratings) both are null.
    Columns of these names in ``docs`` are replaced.
    """
    docs = docs.drop("expected_grade", "tail_probability")
    if model is None:
        return docs.withColumns({n: F.lit(None).cast("double") for n in ("expected_grade", "tail_probability")})
    weights, thresholds = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds)), model.thresholds

    def run(batches):
        of = weights.value[0]
        known: dict[bytes, tuple[int, ...]] = {}
        for batch in batches:
            scores = []
            for x in batch[batch.schema.get_field_index(text_col)]:
                words, distinct, again = _read((x.as_py() or "").encode())
                found = {f for f in (distinct, again) if f in of}
                if len(known) > CACHED:
                    known.clear()
                for w in words:
                    own = known.get(w)
                    if own is None:
                        own = tuple(f for f in word_features(w) if f in of)
                        if len(w) <= LONGEST_CACHED:
                            known[w] = own
                    found.update(own)
                scores.append(sum(of[f] for f in sorted(found)))
            tails = Ordinal({}, thresholds).tails(np.array(scores, dtype=np.float64))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(tails.sum(axis=1)), pa.array(tails[:, -1])],
                names=[*batch.schema.names, "expected_grade", "tail_probability"],
            )

    return docs.mapInArrow(without_collector(run), extended(docs, "expected_grade double, tail_probability double"))


def accepted(scored: DataFrame, least: float = 0.5):
    """Rows whose probability of the highest grade is at least ``least``; all rows if nothing was rated."""
    return F.coalesce(scored["tail_probability"] >= least, F.lit(True))
