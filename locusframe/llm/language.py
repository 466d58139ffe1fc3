"""Language identification by mixtures (operator 10).

A language is a distribution over hashed letter n-grams, learnt from labelled texts.  A document
is a mixture of languages: expectation-maximisation estimates its proportions, and languages are
added to the set one by one while the likelihood, less a penalty for each language, grows.  The
prediction is the language with the largest proportion; the score is that proportion.

Defined cases: a text that is null, empty or without letters is ``und`` with score 0; a null or
empty language label is not learnt from; where nothing was learnt every text is ``und``; ties go
to the language that comes first; repeated rows are predicted each for itself; an empty table
gives an empty table; other columns are not looked at.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ._common import map_pandas, packed, read_table, renamed_apart, ship_package

DIMS = 1 << 14
_BETWEEN = re.compile(r"[\W\d_]+")


def grams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Hashed byte n-grams (1 to 3, within blank-separated words) and their counts."""
    words = _BETWEEN.sub(" ", text.lower()).strip()
    if not any(map(str.isalpha, words)):  # what is left can be fractions or other numerals
        return np.zeros(0, np.int64), np.zeros(0)
    x = np.frombuffer(b" " + words.encode() + b" ", dtype=np.uint8).astype(np.uint32)
    two = x[:-1] * np.uint32(257) + x[1:]
    three = two[:-1] * np.uint32(263) + x[2:]
    keys = np.concatenate([x, two + np.uint32(1 << 20), three + np.uint32(1 << 28)])
    at = (keys * np.uint32(2654435761)) >> np.uint32(32 - 14)
    if len(at) < DIMS // 8:
        found, counts = np.unique(at, return_counts=True)
        return found.astype(np.int64), counts.astype(float)
    counts = np.bincount(at, minlength=DIMS)
    found = np.flatnonzero(counts)
    return found, counts[found].astype(float)


@dataclass
class LanguageModel:
    """Languages and their log-free gram probabilities, ``DIMS`` by languages."""

    languages: list[str]
    table: np.ndarray
    penalty: float = 8.0
    steps: int = 12

    def _mix(self, likely: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, float]:
        share = np.full(likely.shape[1], 1 / likely.shape[1])
        total = counts.sum()
        for _ in range(self.steps if likely.shape[1] > 1 else 0):
            weighted = likely * share
            share = (counts / weighted.sum(1)) @ weighted / total
        return share, float(counts @ np.log(likely @ share))

    def predict(self, text: str | None) -> tuple[str, float, dict[str, float]]:
        at, counts = grams(text or "")
        if not len(at) or not self.languages:
            return "und", 0.0, {}
        likely = self.table[at]
        single = counts @ np.log(likely)
        order = np.argsort(-single, kind="stable")
        chosen, best, shares = [int(order[0])], float(single[order[0]]), np.ones(1)
        while len(chosen) < len(self.languages):
            trials = []
            for k in order:
                if int(k) not in chosen:
                    share, value = self._mix(likely[:, [*chosen, int(k)]], counts)
                    trials.append((value, int(k), share))
            value, k, share = max(trials, key=lambda t: t[0])
            if value - self.penalty * np.log(counts.sum() + 1) <= best:
                break
            chosen, best, shares = [*chosen, k], value, share
        top = int(np.argmax(shares))
        return self.languages[chosen[top]], float(min(1.0, shares[top])), {self.languages[c]: float(s) for c, s in zip(chosen, shares, strict=True)}


def learn(labelled: DataFrame, smoothing: float = 0.5) -> LanguageModel:
    """Gram counts of all labelled texts; only the table of ``DIMS`` by languages reaches the driver."""

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            sums: dict[str, np.ndarray] = {}
            for text, lang in zip(pdf["text"], pdf["lang"], strict=True):
                at, n = grams(text)
                sums.setdefault(lang, np.zeros(DIMS))[at] += n
            for lang, total in sums.items():
                at = np.flatnonzero(total)
                yield pd.DataFrame({"lang": lang, "gram": at.astype(np.int32), "n": total[at].astype(np.int64)})

    known = renamed_apart(labelled, "text", "lang").where("text is not null and lang is not null and lang <> ''")
    rows = map_pandas(known, count, "lang string, gram int, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(rows["lang"].unique())
    table = np.full((DIMS, len(languages)), smoothing)
    for k, lang in enumerate(languages):
        part = rows[rows["lang"] == lang]
        table[part["gram"].to_numpy(), k] += part["n"].to_numpy()
    return LanguageModel(languages, table / table.sum(0))


def predict(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``doc_id, lang_pred, score, shares`` (proportions of the chosen languages) of every text."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # DIMS x languages numbers

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            found = [shared.value.predict(t) for t in pdf["text"]]
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "lang_pred": [x[0] for x in found], "score": [x[1] for x in found], "shares": [x[2] for x in found]})

    source = renamed_apart(docs, "doc_id", "text")
    kind = source.schema["doc_id"].dataType.simpleString()
    return map_pandas(source, run, f"doc_id {kind}, lang_pred string, score double, shares map<string,double>")


def predict_rows(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``row`` (a struct of all columns of ``docs``), ``lang_pred`` and ``score``."""
    ship_package(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang string, score double")
    def judge(texts: pd.Series) -> pd.DataFrame:
        found = [shared.value.predict(t) for t in texts]
        return pd.DataFrame({"lang": [x[0] for x in found], "score": [x[1] for x in found]})

    return docs.select(packed(docs), judge("text").alias("judged")).select("row", F.col("judged.lang").alias("lang_pred"), "judged.score")


def held_out(doc_id: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    model = learn(docs.where(~held_out()))
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
