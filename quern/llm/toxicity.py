"""Toxicity of texts by gradient-boosted trees over dense features, calibrated (operator 2).

Features of a whole text: densities of a fixed lexicon of insults and of a learned one (word stems), how
many hits stand near a second-person pronoun, the densest window, and rates of capitals,
punctuation and obfuscation (letters mixed with digits or signs; lexicon words that show only
after such signs are undone). The learned lexicon, the trees and the isotonic calibration come from a
bounded sample (``learning.SAMPLE_ROWS``) of labelled rows that are not held out; half of it
teaches stems and trees, half the calibration.

Null or empty text has the features of no words. Null doc_id: not held out. No usable label: every
score is 0.5 or the base rate. Repeated rows get equal scores.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quern.llm.learning import BoostedTrees, Isotonic, held_out, sample
from quern.llm.textual import batches

#: Insults that need no teaching.
INSULTS = frozenset("idiot moron stupid trash scum loser clown pathetic worthless disgusting dumb jerk fool garbage bastard imbecile".split())
SECOND_PERSON = frozenset("you your yours yourself du dich dir dein deine ihr euch tu te toi ton ta tes vous votre vos usted ustedes ti tus".split())
LEARNED_STEMS = 40
#: Lengths of the word beginnings that may become stems; the shortest first.
STEMS = (4, 5, 6)
NEAR, WINDOW = 5, 50
#: Signs that stand for letters.
UNDO = str.maketrans("013457@$!|", "oieastasil")

_word = re.compile(r"[^\W\d_]+")
#: A whole run of letters, digits and signs that has one of the latter; each place is read once, whatever the run's length.
_run = re.compile(r"(?<![\w@$!|*.-])[a-z]*+[0-9@$!|*._-][a-z0-9@$!|*._-]*+")
_inside = re.compile(r"[0-9@$!|*._-][a-z0-9@$!|*]")
_letter = re.compile("[a-z]")
_upper, _punct = bytes(range(65, 91)), b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
N_FEATURES = 16


class Lexicon:
    """Stems learned from labelled text: strong ones stand in toxic texts nearly alone, soft ones mostly."""

    def __init__(self, strong: frozenset[str] = frozenset(), soft: frozenset[str] = frozenset()):
        self.strong, self.soft = strong, soft
        self.heads = frozenset(x[: STEMS[0]] for x in strong | soft)

    def kind(self, word: str) -> int:
        """2 for a strong stem, 1 for a soft one, 0 for none."""
        if word[: STEMS[0]] not in self.heads:
            return 0
        own = {word[:n] for n in STEMS}
        return 2 if own & self.strong else 1 if own & self.soft else 0


def obfuscated(low: str) -> Iterator[str]:
    """Words of 3 to 31 signs that mix letters with digits or signs, full stops and dashes at their ends aside."""
    for run in _run.findall(low):
        word = run.strip("._-")
        if 3 <= len(word) <= 31 and _letter.search(word) and _inside.search(word):
            yield word


def features(text: str | None, lexicon: Lexicon) -> list[float]:
    text = text or ""
    data, low = text.encode("utf-8", "replace"), text.lower()
    words = _word.findall(low)
    n, size = max(1, len(words)), max(1, len(data))
    seed = [i for i, w in enumerate(words) if w in INSULTS]
    near_lexicon = [i for i, w in enumerate(words) if w[: STEMS[0]] in lexicon.heads]
    kinds = [(i, lexicon.kind(words[i])) for i in near_lexicon]
    strong, soft = [i for i, k in kinds if k == 2], [i for i, k in kinds if k == 1]
    undone = mixed = 0
    for m in obfuscated(low):
        mixed += 1
        plain = re.sub("[*._-]", "", m.translate(UNDO))
        undone += plain in INSULTS or lexicon.kind(plain) == 2
    hits = sorted({*seed, *strong, *soft})
    second = sum(w in SECOND_PERSON for w in words) if hits else 0
    near = sum(any(w in SECOND_PERSON for w in words[max(0, i - NEAR) : i + NEAR + 1]) for i in hits) if second else 0
    dense, lo = 0, 0
    for k, i in enumerate(hits):
        while hits[lo] < i - WINDOW:
            lo += 1
        dense = max(dense, k - lo + 1)
    count = lambda signs: len(data) - len(data.translate(None, signs))
    return [
        len(seed) / n, len(strong) / n, len(soft) / n, math.log1p(len(seed)), math.log1p(len(strong)), math.log1p(len(soft)),
        len({words[i] for i in seed}), len({words[i] for i in strong}), near / n, second / n, dense, undone, mixed / n,
        count(_upper) / size, count(_punct) / size, math.log1p(len(words)),
    ]


def _count_stems(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in it:
        bad, every = Counter(), Counter()
        for y, t in zip(b["label"].to_pylist(), b["text"].to_pylist(), strict=True):
            own = {w[:k] for w in set(_word.findall(t.lower())) for k in STEMS if len(w) >= k}
            every.update(own)
            if y:
                bad.update(own)
        if bad:
            yield pa.record_batch([pa.array(list(every)), pa.array([bad[w] for w in every], pa.int64()), pa.array(list(every.values()), pa.int64())], ["stem", "k", "n"])


def _learn_stems(half: DataFrame) -> Lexicon:
    """Stems that tell toxic texts, by the likelihood ratio of their counts over distinct texts."""
    texts = half.filter("text is not null").groupBy(F.xxhash64("text").alias("h")).agg(F.max("label").alias("label"), F.first("text").alias("text"))
    totals = texts.agg(F.sum("label").alias("bad"), F.count("*").alias("all")).first()
    bad, every = totals["bad"] or 0, totals["all"] or 0
    if not bad or bad == every:
        return Lexicon()
    share = bad / every
    counts = texts.select("label", "text").mapInArrow(_count_stems, "stem string, k long, n long").groupBy("stem").agg(F.sum("k").alias("k"), F.sum("n").alias("n"))
    part = lambda k, e: F.when(k > 0, k * F.log(k / e)).otherwise(0.0)
    k, n = F.col("k"), F.col("n")
    ratio = part(k, n * share) + part(n - k, n * (1 - share))
    top = counts.filter((k >= 5) & (k > 2 * share * n)).withColumn("gain", ratio).filter("gain > 6").orderBy(F.desc("gain"), "stem").limit(40 * LEARNED_STEMS).collect()
    strong, soft = set(), set()
    for r in top:
        own = strong if r["k"] >= 0.9 * r["n"] else soft
        if len(own) < LEARNED_STEMS and not any(r["stem"].startswith(x) for x in own) and not (own is soft and any(x.startswith(r["stem"]) for x in soft)):
            own.add(r["stem"])
    return Lexicon(frozenset(strong), frozenset(soft))


class ToxicityModel:
    def __init__(self, lexicon: Lexicon, trees: BoostedTrees, calibration: Isotonic):
        self.lexicon, self.trees, self.calibration = lexicon, trees, calibration

    def score(self, texts: list[str | None]) -> np.ndarray:
        x = np.array([features(t, self.lexicon) for t in texts]).reshape(-1, N_FEATURES)
        return self.calibration(self.trees.margin(x))


def fit(docs: DataFrame, labels: DataFrame, label: str = "toxic") -> ToxicityModel:
    batches(docs.sparkSession)
    rows = sample(docs, labels, label)
    lexicon = _learn_stems(rows.filter("fold = 0"))

    def measure(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            x = [features(t, lexicon) for t in b["text"].to_pylist()]
            yield pa.record_batch([b["label"], b["fold"], pa.array(x, pa.list_(pa.float64()))], ["label", "fold", "x"])

    got = rows.mapInArrow(measure, "label int, fold int, x array<double>").collect()
    y, fold = np.array([r.label for r in got], float), np.array([r.fold for r in got])
    x = np.array([r.x for r in got]).reshape(-1, N_FEATURES)
    order = np.lexsort((fold, y, *x.T))  # tasks end in any order
    x, y, fold = x[order], y[order], fold[order]
    trees = BoostedTrees().fit(x[fold == 0], y[fold == 0])
    return ToxicityModel(lexicon, trees, Isotonic(trees.margin(x[fold == 1]), y[fold == 1]))


def score(docs: DataFrame, model: ToxicityModel) -> DataFrame:
    """(doc_id, held_out, score, predicted) for every row of ``docs``."""

    def scored(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in it:
            yield pa.record_batch([b["doc_id"], b["held_out"], pa.array(model.score(b["text"].to_pylist()))], ["doc_id", "held_out", "score"])

    batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out().alias("held_out"), F.col("text").cast("string").alias("text"))
    out = rows.mapInArrow(scored, "doc_id long, held_out boolean, score double")
    return out.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))
