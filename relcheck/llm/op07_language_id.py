"""Language ID by multilingual mixture inference.

A model has for each language the log-probabilities of letter trigrams, hashed
into a table of a fixed size and counted over all documents to learn from. A
document is a sequence of words (runs of letters) and each word is in one of the
document's languages: its likelihood under a language is that of its trigrams.
Expectation-maximisation estimates the proportions of the languages. The set of
languages is chosen by penalised likelihood: from the likeliest single language
on, the languages of the greatest proportions are admitted one by one, as long as
the likelihood gained exceeds half a parameter's share of the logarithm of the
number of words, times `penalty`.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import column, pick, pieces

BUCKETS = 1 << 15
#: Added to every count; nothing is impossible.
SMOOTH = 0.5
ROUNDS, SET_ROUNDS = 12, 10
PENALTY = 4.0
UNKNOWN = "und"
#: Languages that a model may have: its size, which is sent to all tasks, is bounded by that. More labels are an error, as
#: a column with so many doesn't hold languages.
MOST_LANGUAGES = 512


@cache
def _letters() -> np.ndarray:
    return np.array([chr(i).isalpha() for i in range(0x110000)], dtype=bool)


def trigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of the letters' trigrams, the first trigram of each word, the first word of each text (n + 1)."""
    joined = "\n".join(t.decode("utf-8", "replace").lower().replace("\n", " ") for t in texts) + "\n"
    code = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    code = np.where(_letters()[code], code, np.where(code == 10, np.uint32(10), np.uint32(32)))
    full = code > 32
    padded = np.concatenate(([32], np.where(full, code, 32), [32])).astype(np.uint64)
    at = np.flatnonzero(full)
    mixed = padded[at] * np.uint64(0x9E3779B97F4A7C15) + padded[at + 1] * np.uint64(0xC2B2AE3D27D4EB4F) + padded[at + 2] * np.uint64(0x165667B19E3779F9)
    mixed ^= mixed >> np.uint64(29)
    bucket = ((mixed * np.uint64(0xBF58476D1CE4E5B9)) >> np.uint64(64 - 15)).astype(np.int64)
    first = np.flatnonzero(full & ~np.concatenate(([False], full[:-1])))
    ends = np.flatnonzero(code == 10)
    return bucket, np.searchsorted(at, first), np.concatenate(([0], np.searchsorted(first, ends)))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: dict[str, np.ndarray] = {}
    for rows, texts in pieces(batches, "text"):
        by_lang: dict[str, list[bytes]] = {}
        for lang, text in zip(column(rows, "lang").to_pylist(), texts, strict=True):
            by_lang.setdefault(lang, []).append(text)
        for lang, some in by_lang.items():
            total[lang] = total.get(lang, 0) + np.bincount(trigrams(some)[0], minlength=BUCKETS)
    for lang, n in total.items():
        at = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(n[at], pa.int64())], names=["lang", "bucket", "n"])


class Model:
    """languages, in order, and log-probabilities (BUCKETS x languages)."""

    def __init__(self, counts: dict[str, np.ndarray]):
        self.languages = sorted(counts)
        n = np.stack([counts[x] for x in self.languages], axis=1) + SMOOTH if counts else np.empty((BUCKETS, 0))
        self.logs = np.log(n / n.sum(0)).astype(np.float32)

    def mixtures(self, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """For each text its proportions (texts x languages, a row of nothing if it has no letter), and its words."""
        bucket, word, text = trigrams(texts)
        share = np.zeros((len(texts), len(self.languages)))
        n_words = np.diff(text)
        if self.languages and len(word):
            log = np.add.reduceat(self.logs[bucket], word, axis=0)
            own = np.flatnonzero(n_words)
            share[own] = _infer(log, text[:-1][own], n_words[own])
        return share, n_words


def _em(likely: np.ndarray, start: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int) -> np.ndarray:
    """Proportions after so many rounds, from share; languages of proportion 0 stay out."""
    for _ in range(rounds):
        part = likely * np.repeat(share, count, axis=0)
        part /= part.sum(1, keepdims=True)
        share = np.add.reduceat(part, start, axis=0) / count[:, None]
    return share


def _fit(likely: np.ndarray, start: np.ndarray, count: np.ndarray, share: np.ndarray) -> np.ndarray:
    return np.add.reduceat(np.log((likely * np.repeat(share, count, axis=0)).sum(1)), start)


def _infer(log: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The selected mixture of each text, from its words' log-likelihoods."""
    n, k = len(count), log.shape[1]
    top = log.max(1, keepdims=True)
    likely = np.exp(np.maximum(log - top, -60.0)).astype(np.float32)
    single = np.add.reduceat(np.maximum(log - top, -60.0), start, axis=0)
    best = single.argmax(1)
    out, value = np.eye(k, dtype=np.float32)[best], single.max(1)
    if k == 1:
        return out
    full = _em(likely, start, count, np.full((n, k), 1 / k, dtype=np.float32), ROUNDS)
    price = PENALTY / 2 * np.log(count + 1)
    # No set of languages fits better than all of them together.
    open_ = np.flatnonzero(_fit(likely, start, count, full) - value > price)
    order = np.argsort(-full, axis=1, kind="stable")
    for size in range(2, k + 1):
        if not len(open_):
            break
        words = np.repeat(start[open_] - np.cumsum(count[open_]) + count[open_], count[open_]) + np.arange(count[open_].sum())
        c = count[open_]
        share = np.zeros((len(open_), k), dtype=np.float32)
        np.put_along_axis(share, order[open_, :size], 1 / size, axis=1)
        begin = np.cumsum(c) - c
        share = _em(likely[words], begin, c, share, SET_ROUNDS)
        gained = _fit(likely[words], begin, c, share)
        better = gained - value[open_] > price[open_]
        out[open_[better]], value[open_[better]] = share[better], gained[better]
        open_ = open_[better]
    return out


def learn(docs: DataFrame) -> Model:
    """Count the trigrams of all docs(text string, lang string); rows with a null text or lang teach nothing.

    What comes to the driver is a table of MOST_LANGUAGES x BUCKETS at most; with more
    labels than that, ValueError. Repeated rows count as often as they occur; an
    empty table gives a model without languages.
    """
    labels = pick(docs, "lang").filter("lang is not null").distinct().limit(MOST_LANGUAGES + 1).count()
    if labels > MOST_LANGUAGES:
        raise ValueError(f"lang has more than {MOST_LANGUAGES} values")
    seen = pick(docs, "text", "lang").filter("text is not null and lang is not null").mapInArrow(_counts, "lang string, bucket int, n long")
    counts: dict[str, np.ndarray] = {}
    for row in seen.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect():
        counts.setdefault(row["lang"], np.zeros(BUCKETS))[row["bucket"]] = row["n"]
    return Model(counts)


def _predict(model: Model, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in pieces(batches, "text"):
            share, _ = model.mixtures(texts)
            found = share.sum(1) > 0
            best = share.argmax(1) if share.shape[1] else np.zeros(len(texts), dtype=np.int64)
            lang = [model.languages[b] if f else UNKNOWN for b, f in zip(best.tolist(), found.tolist(), strict=True)]
            score = np.clip(share.max(1, initial=0.0), 0, 1)
            mix = [[(model.languages[j], float(p[j])) for j in np.argsort(-p, kind="stable") if p[j] > 0] for p in share]
            yield pa.RecordBatch.from_arrays([*(column(rows, n) for n in names), pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(mix, pa.map_(pa.string(), pa.float64()))], names=[*names, "lang_pred", "score", "mixture"])

    return run


def languages(docs: DataFrame, model: Model, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns to keep of docs, and lang_pred, score, mixture of its whole text.

    lang_pred is the language of the greatest proportion, `und` for texts that are
    null or have no letter, or if the model has no languages; score is its
    proportion, 0 for `und`; mixture maps the selected languages to proportions.
    Ties go to the language that comes first in order. Repeated rows give repeated
    results, an empty table none; texts may be of any length. Other columns, whatever
    their names, aren't looked at.
    """
    keep = tuple(keep)
    docs = pick(docs, *dict.fromkeys([*keep, "text"]))
    schema = ", ".join(f"`{n}` {docs.schema[n].dataType.simpleString()}" for n in keep)
    return docs.mapInArrow(_predict(model, list(keep)), f"{schema}, lang_pred string, score double, mixture map<string, double>")


def held_out() -> Column:
    """Whether a document is kept from learning; a row without doc_id is learnt from."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): learn from the rows not held out, predict all."""
    model = learn(pick(docs, "doc_id", "text", "lang").filter(~held_out()))
    return languages(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
