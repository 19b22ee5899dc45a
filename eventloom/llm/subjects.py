"""Subjects of documents, by one-versus-rest linear classifiers on hashed word n-grams.

Raters' labels, some of them wrong, and the descriptions of the subjects are the weak labels. Logistic
regressions on the n-grams of the senders' own texts give each n-gram a weight per subject; a document's
sentences are then scored one by one, each counting for the subject it scores highest for, since a text may
treat several subjects in turn and mention others in passing. How high a sentence must score for a subject,
and in how many sentences a document must treat it, is calibrated for each subject on labels that the
scoring model has not seen.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from eventloom.llm.mail import own_text
from eventloom.runtime import Stages

BUCKETS = 1 << 20
MOST_LABELLED = 8_000  # labelled documents, about, that the classifiers are fitted on; of more a share is drawn by hash
ROUNDS = 60
FOLDS = 3  # parts of the labelled documents, each scored by a model of the others
POOLED = 300  # labels of all subjects together that steady the thresholds of one
SCORES, SENTENCES = (0.5, 0.75, 1.0, 1.25, 1.5, 2.0, 2.5, 3.0), (1, 2, 3)  # thresholds to choose from
_WORD = re.compile(r"[^\W\d_]+")
_SENTENCE = re.compile(r"(?<=[.!?…。？！؟।])\s+|\n\s*\n")


def sentences(text: str) -> list[list[str]]:
    """Words of each sentence, lower case; a blank line ends a sentence too."""
    if not text.isascii():
        text = unicodedata.normalize("NFC", text)
    return [w for w in (_WORD.findall(s) for s in _SENTENCE.split(text.lower())) if w]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "replace")) % BUCKETS


def grams(words: list[str]) -> list[str]:
    """Words and pairs of neighbours."""
    return words + [f"{a} {b}" for a, b in zip(words, words[1:])]


@dataclass
class Model:
    subjects: list[str]
    kept: np.ndarray  # buckets with weights, sorted
    weights: np.ndarray  # (len(kept) + 1, subjects); the last row is zero, for all other buckets
    least_score: np.ndarray  # per subject
    least_sentences: np.ndarray


def fit(documents: list[list[int]], labels: np.ndarray, subjects: list[str]) -> Model:
    """Logistic regressions of all subjects at once, full batch with Adam, on presence of n-grams that at
    least two documents have. ``documents`` holds distinct buckets."""
    if not documents or not subjects:
        return _untuned(subjects, np.zeros(0, np.int64), np.zeros((1, len(subjects))))
    size = np.array([len(d) for d in documents])
    flat = np.concatenate([np.asarray(d, np.int64) for d in documents])
    names, at, often = np.unique(flat, return_inverse=True, return_counts=True)
    use = often >= 2
    kept = names[use]
    number = np.cumsum(use) - 1
    mask = use[at]
    feature = number[at][mask]
    doc = np.repeat(np.arange(len(size)), size)[mask]
    n, k = len(documents), len(subjects)
    w, bias = np.zeros((len(kept), k)), np.full(k, -2.0)
    m, v = np.zeros_like(w), np.zeros_like(w)
    starts = np.flatnonzero(np.diff(doc, prepend=-1))
    present = doc[starts] if len(doc) else doc
    for step in range(1, ROUNDS + 1):
        score = np.tile(bias, (n, 1))
        if len(feature):
            score[present] += np.add.reduceat(w[feature], starts, axis=0)
        error = 1 / (1 + np.exp(-np.clip(score, -30, 30))) - labels
        gradient = np.stack([np.bincount(feature, weights=error[doc, j], minlength=len(kept)) for j in range(k)], axis=1) + 0.3 * w
        m = 0.9 * m + 0.1 * gradient
        v = 0.99 * v + 0.01 * gradient**2
        w -= 0.1 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8)
        bias -= 0.5 * error.mean(axis=0)
    return _untuned(subjects, kept, np.vstack([w, np.zeros((1, k))]))


def _untuned(subjects: list[str], kept: np.ndarray, weights: np.ndarray) -> Model:
    return Model(subjects, kept, weights, np.full(len(subjects), 1.0), np.full(len(subjects), 2))


def sentence_scores(model: Model, texts: list[list[list[str]]], memo: dict[str, int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per sentence with any known n-gram: its document's position, best subject and that subject's score."""
    index: list[int] = []
    sentence: list[int] = []
    owner: list[int] = []
    none = len(model.kept)
    count = 0
    for d, text in enumerate(texts):
        for words in text:
            for g in grams(words):
                i = memo.get(g)
                if i is None:
                    b = bucket(g)
                    i = int(np.searchsorted(model.kept, b))
                    i = i if i < none and model.kept[i] == b else none
                    if len(memo) < 500_000:
                        memo[g] = i
                if i != none:
                    index.append(i)
                    sentence.append(count)
            owner.append(d)
            count += 1
    if not index:
        empty = np.zeros(0, np.int64)
        return empty, empty, np.zeros(0)
    at = np.array(sentence)
    starts = np.flatnonzero(np.diff(at, prepend=-1))
    score = np.add.reduceat(model.weights[np.array(index)], starts, axis=0)
    best = score.argmax(axis=1)
    return np.array(owner)[at[starts]], best, score[np.arange(len(best)), best]


Scores = tuple[np.ndarray, np.ndarray, np.ndarray]


def tallies(k: int, n: int, scores: Scores, least: np.ndarray | float) -> np.ndarray:
    """Sentences of each of k subjects in each of n documents that score at least their subject's threshold."""
    owner, best, value = scores
    fine = value >= np.broadcast_to(least, k)[best]
    return np.bincount(owner[fine] * k + best[fine], minlength=n * k).reshape(n, k)


def calibrate(model: Model, scores: Scores, labels: np.ndarray) -> Model:
    """Sets each subject's two thresholds to those of its highest F1 against the labels, its own counts joined by
    those of all subjects at the weight of POOLED labels, and F1 averaged over neighbouring scores, so that
    one wrong label moves no threshold far; of equal ones the stricter. Where no threshold finds any of
    the held-out labels, which are too few then, the model's own stay."""
    n, k = labels.shape
    settings = [(least, several) for least in SCORES for several in SENTENCES]
    weight = POOLED / max(1.0, labels.sum())
    f1 = np.zeros((len(settings), k))
    for i, (least, several) in enumerate(settings):
        got = tallies(k, n, scores, least) >= several
        hit, found, true = (got & (labels > 0)).sum(axis=0), got.sum(axis=0), labels.sum(axis=0)
        f1[i] = 2 * (hit + weight * hit.sum()) / np.maximum(1e-9, found + true + weight * (found.sum() + true.sum()))
    grid = np.pad(f1.reshape(len(SCORES), -1), ((1, 1), (0, 0)), "edge")
    f1 = ((grid[:-2] + 2 * grid[1:-1] + grid[2:]) / 4).reshape(f1.shape)
    best = len(settings) - 1 - f1[::-1].argmax(axis=0)
    some = f1.max(axis=0) > 0
    model.least_score = np.where(some, [settings[i][0] for i in best], model.least_score)
    model.least_sentences = np.where(some, [settings[i][1] for i in best], model.least_sentences)
    return model


def fitted(parsed: list[list[list[str]]], labels: np.ndarray, subjects: list[str], descriptions: list[list[list[str]]]) -> Model:
    """A model of the documents and descriptions, with thresholds from scores that each part of the documents
    gets by a model of the other parts."""
    k = len(subjects)
    held = [sorted({bucket(g) for s in t for g in grams(s)}) for t in parsed]
    told = [sorted({bucket(g) for s in t for g in grams(s)}) for t in descriptions]
    both = lambda rows: (([held[i] for i in rows] + told), np.vstack([labels[rows], np.eye(k)]))
    everything = np.arange(len(parsed))
    model = fit(*both(everything), subjects)
    folds = min(FOLDS, len(parsed))
    if folds < 2:
        return model
    parts = []
    for fold in range(folds):
        own = everything[everything % folds == fold]
        owner, best, value = sentence_scores(fit(*both(everything[everything % folds != fold]), subjects), [parsed[i] for i in own], {})
        parts.append((own[owner], best, value))
    return calibrate(model, tuple(np.concatenate(c) for c in zip(*parts)), labels)


def train(docs: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MOST_LABELLED) -> Model:
    """A model fitted on about ``most`` labelled documents: where there are more, those under a cut of the hash
    of their id.

    Labels with a subject that is not listed are ignored; a null subject means none. Documents' null and
    empty texts have no n-grams. Without labels only the descriptions are known."""
    listed = subjects.where("subject is not null").groupBy("subject").agg(F.max("description").alias("description")).collect() if "description" in subjects.columns else [(r[0], None) for r in subjects.select("subject").where("subject is not null").distinct().collect()]
    told = dict(tuple(r) for r in listed)
    names = sorted(told)
    known = labels.where("doc_id is not null")
    n = known.select(F.count_distinct("doc_id")).first()[0]
    if n > most:
        known = known.where(F.xxhash64("doc_id") < F.lit(-(1 << 63) + (1 << 64) * most // n))
    rated = known.groupBy("doc_id").agg(F.collect_set("subject").alias("subjects"))
    texts = docs.select("doc_id", "text").join(F.broadcast(rated), "doc_id")  # about `most` short rows
    rows = texts.mapInArrow(_own, "doc_id bigint, own string, subjects array<string>").dropDuplicates(["doc_id"]).orderBy("doc_id").toArrow()
    parsed = [sentences(t) for t in rows.column("own").to_pylist()]
    y = np.array([[s in set(x) for s in names] for x in rows.column("subjects").to_pylist()], float).reshape(len(parsed), len(names))
    return fitted(parsed, y, names, [sentences(told[n] or "") for n in names])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        own = pa.array([own_text(t).encode("utf-8", "replace").decode() for t in b.column(1).to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column(0), own, b.column(2)], names=["doc_id", "own", "subjects"])


def document_subjects(docs: DataFrame, labels: DataFrame, subjects: DataFrame, most: int = MOST_LABELLED) -> DataFrame:
    """doc_id, subject, n_sentences: the subjects that each document's own new text treats, in at least the
    calibrated number of sentences. Labelled documents are judged like all others.

    Null, empty and unreadable texts treat nothing. Repeated documents give each row once; extra columns
    are ignored; empty tables give an empty result. One pass over the documents; the model (a sparse
    matrix bounded by the labelled sample) goes to the tasks.
    """
    model = train(docs, labels, subjects, most)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo: dict[str, int] = {}
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                b = batch.slice(at, 512)
                parsed = [sentences(own_text(t)) for t in b.column(1).to_pylist()]
                n = tallies(len(model.subjects), len(parsed), sentence_scores(model, parsed, memo), model.least_score)
                row, subject = np.nonzero(n >= model.least_sentences)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(row)), pa.array([model.subjects[s] for s in subject], pa.string()), pa.array(n[row, subject].astype(np.int64))],
                    names=["doc_id", "subject", "n_sentences"],
                )

    return docs.select("doc_id", "text").mapInArrow(judge, "doc_id bigint, subject string, n_sentences bigint").distinct()


def composition(found: DataFrame, docs: DataFrame, subjects: DataFrame) -> DataFrame:
    """subject, n_documents, n_sentences, share (of all documents) for every listed subject, and for the
    documents that treat none (subject null)."""
    n = docs.select(F.count_distinct("doc_id").alias("n"))
    by = found.groupBy("subject").agg(F.count("*").alias("n_documents"), F.sum("n_sentences").alias("n_sentences"))
    listed = subjects.select("subject").distinct().join(by, "subject", "left").fillna(0, ["n_documents", "n_sentences"])
    some = found.select(F.count_distinct("doc_id").alias("some"))
    none = n.join(some, F.lit(True)).select(F.lit(None).cast("string").alias("subject"), (F.col("n") - F.col("some")).alias("n_documents"), F.lit(0).cast("bigint").alias("n_sentences"))
    total = n.select(F.col("n").alias("total"))  # one row
    return listed.unionByName(none).join(F.broadcast(total), F.lit(True)).select("subject", "n_documents", "n_sentences", (F.col("n_documents") / F.greatest("total", F.lit(1))).alias("share"))
