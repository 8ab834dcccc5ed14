"""Toxicity from class-conditional Kneser-Ney models of how words are spelled.

One interpolated Kneser-Ney model for the words of toxic texts, one for those of ordinary texts, over the
characters of a word up to ORDER long: insults are met again in inflected forms that no list of whole words
holds. A word's ratio counts as far as it exceeds FLOOR: the plain difference of the log-likelihoods is dominated by
how often each class uses each language's words (the README has figures). Lower orders use continuation counts, and the lowest is shared by both models, so rare expressions
weigh nothing unless their class is known. A text's feature is the difference of its two log-likelihoods a
word; a logistic curve fitted on labelled texts that the models haven't seen turns it into a score.

All labelled rows outside the held-out fold are learned from: three folds count for the models, the fourth for the
curve. Counts, continuation counts and probabilities are Spark aggregates and joins, level by level, and so is each step
of the curve's fit. Both models are merged into one table of log-likelihood ratios with backoff differences, an entry
for each distinct run of up to ORDER characters: it grows as spellings do, by less than the texts, and is packed into
arrays for the scan that scores; every word of every text counts. A word's ratio is computed once a task.

FLOOR and RIDGE were chosen by cross-validation within folds 1 to 4.

Defined results: null, empty and wordless texts have feature 0. Labels that are null are left out, a repeated
label counts once, and of several texts with a labelled id the least is learned from. Without labelled rows of both classes every score is 0.0.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from corvane.llm.common import Workspace, alnum_words, blobs
from corvane.llm.labelled import labelled_rows

ORDER = 5
DISCOUNT = 0.75
#: Nats by which a word's ratio must differ from 0 to count, and by which it then counts less: spelling alone varies as much.
FLOOR = 5.0
RIDGE = 1e-5
#: Words a task keeps the ratios of; on reaching it the memory is emptied, results stay the same.
MEMORY = 1 << 20


class KneserNey:
    """Spelling model of one class. counts: {word: times}; base: shared probabilities of single characters."""

    def __init__(self, counts: dict[str, int], base: dict[str, float], order: int = ORDER, discount: float = DISCOUNT):
        self.base, self.order, self.discount = base, order, discount
        grams: list[Counter] = [Counter() for _ in range(order + 1)]
        before: list[dict[str, set]] = [defaultdict(set) for _ in range(order + 1)]
        for word, n in counts.items():
            s = f"\x02{word}\x03"
            for end in range(2, len(s) + 1):
                for m in range(2, order + 1):
                    start = end - m
                    if start < 0:
                        break
                    if m == order or start == 0:  # nothing can stand before a word's start
                        grams[m][s[start:end]] += n
                    else:
                        before[m][s[start:end]].add(s[start - 1])
        for m in range(2, order + 1):
            for g, seen in before[m].items():
                grams[m][g] += len(seen)
        self.grams = grams
        self.total: Counter = Counter()
        self.kinds: Counter = Counter()
        for level in grams:
            for g, n in level.items():
                self.total[g[:-1]] += n
                self.kinds[g[:-1]] += 1

    def keep(self, context: str) -> float:
        """Share of the probability that the context leaves to the shorter one."""
        total = self.total.get(context, 0)
        return min(1.0, self.discount * self.kinds[context] / total) if total else 1.0

    def probability(self, gram: str) -> float:
        if len(gram) == 1:
            return self.base.get(gram, self.base[""])
        total = self.total.get(gram[:-1], 0)
        lower = self.probability(gram[1:])
        if not total:
            return lower
        seen = self.grams[len(gram)].get(gram, 0)
        return max(seen - self.discount, 0) / total + self.keep(gram[:-1]) * lower


def shared_base(counts: list[dict[str, int]]) -> dict[str, float]:
    """Continuation shares of single characters over both classes; "" stands for any not seen."""
    before = defaultdict(set)
    for word in set(chain(*counts)):
        s = f"\x02{word}\x03"
        for i in range(1, len(s)):
            before[s[i]].add(s[i - 1])
    total = sum(map(len, before.values())) + len(before) + 1
    return {c: (len(v) + 1) / total for c, v in before.items()} | {"": 1 / total}


class Ratios:
    """log P(toxic) - log P(ordinary) of words, from one merged table.

    A run of characters is found from its last one leftwards: a level's keys, sorted, are the number of the run
    without its first character and that character. Runs without which no longer one occurs are all in the table.
    """

    def __init__(self, toxic: dict[str, int], ordinary: dict[str, int], order: int = ORDER):
        base = shared_base([toxic, ordinary])
        models = [KneserNey(c, base, order) for c in (toxic, ordinary)]
        table: dict[str, tuple[float, float]] = {}
        for gram in {c for c in base if c} | {"\x02"} | {g for k in models for level in k.grams for g in level}:
            p, q = (k.probability(gram) for k in models)
            table[gram] = (math.log(p) - math.log(q), math.log(models[0].keep(gram)) - math.log(models[1].keep(gram)))
        self._pack(list(table), np.array([x for x, _ in table.values()], float), np.array([x for _, x in table.values()], float), order)

    @classmethod
    def of_table(cls, grams: list[str], gap: np.ndarray, back: np.ndarray, order: int = ORDER) -> Ratios:
        """From the runs, their own ratios and the differences of what they leave to shorter ones."""
        made = cls.__new__(cls)
        made._pack(grams, gap, back, order)
        return made

    def _pack(self, grams: list[str], gap: np.ndarray, back: np.ndarray, order: int) -> None:
        self.order = order
        self.levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        sizes = np.array([len(g) for g in grams], np.int64)
        for m in range(1, order + 1):
            at = np.flatnonzero(sizes == m)
            codes = np.frombuffer("".join(grams[i] for i in at).encode("utf-32-le"), "<u4").astype(np.int64).reshape(-1, m)
            keys, found = codes[:, -1], np.zeros(len(at), np.int64)
            for k, (known, *_) in enumerate(self.levels, 1):
                found = self._find(known, keys)
                keys = found << 21 | codes[:, -1 - k]
            kept = np.argsort(keys)
            self.levels.append((keys[kept], gap[at][kept], back[at][kept]))

    @staticmethod
    def _find(known: np.ndarray, keys: np.ndarray) -> np.ndarray:
        """Places of keys, -1 for those that aren't there."""
        if not len(known):
            return np.full(len(keys), -1)
        at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
        return np.where(known[at] == keys, at, -1)

    def _gaps(self, codes: np.ndarray, depth: np.ndarray) -> np.ndarray:
        """The ratio of each character after those before it in its word, depth of them."""
        total, open_ = np.zeros(len(codes)), np.arange(len(codes))
        before = np.full(len(codes), -1)  # where the run that ends one character earlier stands, while it is known
        found = self._find(self.levels[0][0], codes)
        for m in range(2, self.order + 1):
            open_ = open_[depth[open_] >= m - 1]
            known, gap, _ = self.levels[m - 1]
            # What this level's context leaves to the shorter one counts until a longer run is found.
            before[1:] = found[:-1]
            context = before[open_]
            there = context >= 0
            back = self.levels[m - 2][2]
            total[open_[there]] += back[context[there]]
            longer = np.full(len(codes), -1)
            some = open_[found[open_] >= 0]
            longer[some] = self._find(known, found[some] << 21 | codes[some - m + 1])
            hit = some[longer[some] >= 0]
            total[hit] = gap[longer[hit]]
            found = longer
        return total

    def gram(self, gram: str, most: int) -> float:
        codes = np.frombuffer(gram[-most:].encode("utf-32-le"), "<u4").astype(np.int64)
        return float(self._gaps(codes, np.arange(len(codes)))[-1])

    def words(self, words: list[str]) -> np.ndarray:
        spelled = [f"\x02{w}\x03" for w in words]
        sizes = np.array([len(s) for s in spelled], np.int64)
        starts = np.cumsum(sizes) - sizes
        codes = np.frombuffer("".join(spelled).encode("utf-32-le"), "<u4").astype(np.int64)
        depth = np.arange(len(codes)) - np.repeat(starts, sizes)
        gap = np.add.reduceat(self._gaps(codes, depth), starts) if words else np.zeros(0)
        return np.where(gap > FLOOR, gap - FLOOR, np.where(gap < -FLOOR, gap + FLOOR, 0.0))

    def word(self, word: str) -> float:
        return float(self.words([word])[0])


class Scorer:
    def __init__(self, ratios: Ratios, slope: float = 1.0, offset: float = 0.0):
        self.ratios, self.slope, self.offset = ratios, slope, offset
        self.known: dict[bytes, float] = {}

    def features(self, texts: list[bytes]) -> Iterator[float]:
        for begin in range(0, len(texts), 64):
            split = [alnum_words(t) for t in texts[begin : begin + 64]]
            if len(self.known) > MEMORY:
                self.known.clear()
            new = list(set(chain.from_iterable(split)).difference(self.known))
            self.known.update(zip(new, self.ratios.words([w.decode("utf-8", "replace") for w in new]).tolist()))
            for words in split:
                yield sum(map(self.known.__getitem__, words)) / len(words) if words else 0.0

    def feature(self, text: bytes) -> float:
        return next(self.features([text]))

    def scores(self, texts: list[bytes]) -> Iterator[float]:
        for x in self.features(texts):
            z = self.slope * x + self.offset
            yield 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))

    def score(self, text: bytes) -> float:
        return next(self.scores([text]))


def fit_curve(x: np.ndarray, y: np.ndarray, ridge: float = RIDGE) -> tuple[float, float]:
    """Slope and offset of a logistic curve, both classes weighing the same."""
    scale = float(np.std(x)) or 1.0
    z = x / scale
    weight = np.where(y == 1, 0.5 / max((y == 1).sum(), 1), 0.5 / max((y == 0).sum(), 1))
    a = np.stack([z, np.ones_like(z)], 1)
    theta = np.zeros(2)
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a @ theta, -60, 60)))
        gradient = a.T @ (weight * (p - y)) + ridge * theta
        curve = (a * (weight * p * (1 - p))[:, None]).T @ a + ridge * np.eye(2)
        theta = theta - np.linalg.solve(curve, gradient)
    return float(theta[0] / scale), float(theta[1])


def fit_points(points: DataFrame, ridge: float = RIDGE) -> tuple[float, float] | None:
    """fit_curve over rows (y, x): each step is one aggregate. None unless both classes are there."""
    held = points.agg(F.stddev_pop("x"), F.sum(F.col("y")), F.sum(1 - F.col("y"))).first()
    if not held[1] or not held[2]:
        return None
    scale = held[0] or 1.0
    theta = np.zeros(2)
    z = F.col("x") / scale
    weight = F.when(F.col("y") == 1, 0.5 / held[1]).otherwise(0.5 / held[2])
    for _ in range(60):
        at = F.greatest(F.lit(-60.0), F.least(F.lit(60.0), z * float(theta[0]) + float(theta[1])))
        p = 1 / (1 + F.exp(-at))
        off, bend = weight * (p - F.col("y")), weight * p * (1 - p)
        g0, g1, h00, h01, h11 = points.agg(F.sum(off * z), F.sum(off), F.sum(bend * z * z), F.sum(bend * z), F.sum(bend)).first()
        step = np.linalg.solve(np.array([[h00, h01], [h01, h11]]) + ridge * np.eye(2), np.array([g0, g1]) + ridge * theta)
        theta = theta - step
        if np.abs(step).max() <= 1e-12 * max(1.0, np.abs(theta).max()):
            break
    return float(theta[0] / scale), float(theta[1])


def gram_counts(rows: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, toxic, ordinary): how often the classes' words hold each run of order characters, and each shorter run at a word's start."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words: tuple[Counter, Counter] = (Counter(), Counter())

        def grams() -> pa.RecordBatch:
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for y in (0, 1):
                for word, n in words[y].items():
                    s = f"\x02{word.decode('utf-8', 'replace')}\x03"
                    for end in range(2, len(s) + 1):
                        found[y][s[max(0, end - order) : end]] += n
                words[y].clear()
            both = list(found[0].keys() | found[1].keys())
            columns = [pa.array(both, pa.string()), *(pa.array([found[y][g] for g in both], pa.int64()) for y in (1, 0))]
            return pa.RecordBatch.from_arrays(columns, ["gram", "toxic", "ordinary"])

        for batch in batches:
            for y, text in zip(batch.column(0).to_pylist(), blobs(batch.column(1))):
                words[y].update(alnum_words(text))
                if len(words[0]) + len(words[1]) > MEMORY:
                    yield grams()
        yield grams()

    counted = rows.select("y", "text").mapInArrow(count, "gram string, toxic long, ordinary long")
    return counted.groupBy("gram").agg(F.sum("toxic").alias("toxic"), F.sum("ordinary").alias("ordinary"))


def ratio_table(space: Workspace, counts: DataFrame, order: int = ORDER, discount: float = DISCOUNT) -> DataFrame:
    """(gram, gap, back) of all runs, from gram_counts: the ratio of a run's last character after the others, and the difference
    of what the run leaves, as a context, to the shorter one."""
    kinds = ("toxic", "ordinary")
    seen = lambda k: F.sum((F.col(k) > 0).cast("long"))
    # A shorter run inside a word counts once for each character before it: for each run of one more that ends in it.
    levels = {order: space.save(counts.where(F.length("gram") == order), f"counts-{order}")}
    for m in range(order - 1, 1, -1):
        inner = levels[m + 1].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(*(seen(k).alias(k) for k in kinds))
        levels[m] = space.save(inner.unionByName(counts.where(F.length("gram") == m)), f"counts-{m}")
    ends = levels[2].groupBy(F.expr("substring(gram, 2)").alias("gram")).agg(F.count("*").alias("n"))
    total = ends.agg(F.sum("n") + F.count("*") + 1).first()[0]
    # Both classes share the lowest level. A word's start ends no run, but is a context.
    below = ends.select("gram", *((F.col("n") + 1).cast("double").__truediv__(total).alias(f"p_{k}") for k in kinds))
    start = levels[2].where("startswith(gram, '\x02')").limit(1).select(F.lit("\x02").alias("gram"), *(F.lit(1.0 / total).alias(f"p_{k}") for k in kinds))
    below = space.save(below.unionByName(start), "level-1")
    out = None
    for m in range(2, order + 2):
        gap = F.log("p_toxic") - F.log("p_ordinary")
        if m > order:
            return out.unionByName(below.select("gram", gap.alias("gap"), F.lit(0.0).alias("back")))
        sums = [F.sum(k).alias(f"n_{k}") for k in kinds] + [seen(k).alias(f"kinds_{k}") for k in kinds]
        left = levels[m].groupBy(F.expr(f"substring(gram, 1, {m - 1})").alias("context")).agg(*sums)
        keep = lambda k: F.when(F.col(f"n_{k}") > 0, F.least(F.lit(1.0), discount * F.col(f"kinds_{k}") / F.col(f"n_{k}"))).otherwise(1.0)
        left = space.save(left.select("context", "n_toxic", "n_ordinary", *(keep(k).alias(f"keep_{k}") for k in kinds)), f"contexts-{m}")
        back = F.coalesce(F.log("keep_toxic") - F.log("keep_ordinary"), F.lit(0.0))
        part = below.join(left, below.gram == left.context, "left").select("gram", gap.alias("gap"), back.alias("back"))
        out = part if out is None else out.unionByName(part)
        own = lambda k: F.when(F.col(f"n_{k}") > 0, F.greatest(F.col(k) - discount, F.lit(0.0)) / F.col(f"n_{k}")).otherwise(0.0)
        rows = levels[m].withColumn("context", F.expr(f"substring(gram, 1, {m - 1})")).withColumn("shorter", F.expr("substring(gram, 2)"))
        rows = rows.join(left, "context").join(below.withColumnRenamed("gram", "shorter"), "shorter")
        below = space.save(rows.select("gram", *((own(k) + F.col(f"keep_{k}") * F.col(f"p_{k}")).alias(f"p_{k}") for k in kinds)), f"level-{m}")


def train(spark: SparkSession, docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "toxic") -> Scorer | None:
    space = Workspace(spark, "toxicity")
    part = lambda f: F.when(f.isin(1, 2, 3), "fit").when(f == 4, "curve")
    rows = space.save(labelled_rows(docs, labels, label, part, id_col, text_col), "labelled", ("part",))
    counts = space.save(gram_counts(rows.where("part = 'fit'")), "counts")
    held = counts.agg(F.sum("toxic"), F.sum("ordinary")).first()
    if not held[0] or not held[1]:
        space.close()
        return None
    table = space.save(ratio_table(space, counts), "ratios").toArrow()
    scorer = Scorer(Ratios.of_table(table.column("gram").to_pylist(), *(table.column(k).to_numpy() for k in ("gap", "back"))))
    shared = spark.sparkContext.broadcast(scorer)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = list(shared.value.features(blobs(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(x, pa.float64())], ["y", "x"])

    # The folds that the models were fitted on are no measure of them; without the other, the offset is 0.
    points = space.save(rows.where("part = 'curve'").select("y", "text").mapInArrow(features, "y int, x double"), "points")
    if curve := fit_points(points):
        scorer.slope, scorer.offset = curve
    scorer.known.clear()
    space.close()
    return scorer


def score_texts(spark: SparkSession, docs: DataFrame, scorer: Scorer | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row_id, score) of every row."""
    kind = dict(docs.dtypes)[id_col]
    texts = docs.selectExpr(f"`{id_col}` AS row_id", f"cast(`{text_col}` AS string) AS text")
    if scorer is None:
        return texts.select("row_id", F.lit(0.0).alias("score"))
    shared = spark.sparkContext.broadcast(scorer)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = list(shared.value.scores(blobs(batch.column(1))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores, pa.float64())], ["row_id", "score"])

    return texts.mapInArrow(run, f"row_id {kind}, score double")


def keep_ordinary(spark: SparkSession, docs: DataFrame, scorer: Scorer | None, below: float = 0.5, text_col: str = "text") -> DataFrame:
    """The rows of docs, all their columns as they are, whose score is below the threshold."""
    if scorer is None:
        return docs
    shared = spark.sparkContext.broadcast(scorer)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array([x < below for x in shared.value.scores(blobs(batch.column(at)))], pa.bool_()))

    # Columns go by their places: mapInArrow can't take names with dots in them.
    plain = [f"c{k}" for k in range(len(docs.columns))]
    schema = StructType([StructField(name, f.dataType, f.nullable) for name, f in zip(plain, docs.schema.fields)])
    return docs.toDF(*plain).mapInArrow(run, schema).toDF(*docs.columns)
