"""Language identification by multilingual mixture inference.

A text's n-grams are drawn from a mixture of languages. Expectation
maximisation estimates the proportions of a language set; sets grow from the
best single language, and a language joins only if the log-likelihood grows by
more than a penalty. Texts for which no set can do so are recognised exactly
by the duality gap of the (concave) likelihood and need no iterations.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import held_out, ids_as_text, ids_back

#: Training texts of each language, about: those whose ids have small hashes.
TEXTS_PER_LANGUAGE = 1_000
#: N-grams are hashed to this many counts (a power of two).
BUCKETS_LOG2 = 16
BUCKETS = 1 << BUCKETS_LOG2
N = 3
SMOOTHING = 0.5
#: Neighbouring n-grams share bytes; a text counts as this share of its n-grams.
INDEPENDENT = 1 / N
#: A language joins a set if it adds more than this and half the log of the sample size.
PENALTY = 6.0
ITERATIONS = 30
#: Bytes handled at once, and text length from which n-grams are counted before use.
CHUNK = 1 << 20
LONG = 1 << 16

#: Bytes as the model sees them: small letters; one space for what is no letter in ASCII.
FOLD = np.array([i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256)], np.uint32)


def grams(data: bytes) -> np.ndarray:
    """Hashed byte n-grams of a text with a space on either side."""
    b = FOLD[np.frombuffer(b" " + data + b" ", np.uint8)]
    code = (b[:-2] << 16 | b[1:-1] << 8 | b[2:]) * np.uint32(2654435761)
    return code >> np.uint32(32 - BUCKETS_LOG2)


def fit(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang",
        texts: int = TEXTS_PER_LANGUAGE) -> tuple[list[str], np.ndarray]:
    """Languages in order and the log-probabilities (BUCKETS x languages).

    Only rows with a language, a text and an id outside the held-out part are
    used, ``texts`` of each language. Counts are summed in Spark; the driver
    gets BUCKETS numbers for each language."""
    usable = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & ~held_out(id_col))
    rows = {r.lang: r.n for r in usable.groupBy(F.col(lang_col).alias("lang")).agg(F.count(F.lit(1)).alias("n")).collect()}
    if not rows:
        return [], np.zeros((BUCKETS, 1), np.float32)
    # of each language the share of hashes that gives about ``texts`` rows: no language is gathered anywhere
    share = F.element_at(F.from_json(F.lit(json.dumps({k: min(1.0, texts / n) for k, n in rows.items()})), "map<string, double>"), F.col(lang_col))
    drawn = F.shiftrightunsigned(F.xxhash64(id_col), 11).cast("double") / float(2**53)
    sample = usable.where(drawn < share).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, text in zip(batch["lang"], batch["text"], strict=True):
                got = np.bincount(grams(text.encode()), minlength=BUCKETS)
                sums[lang] = sums[lang] + got if lang in sums else got
        for lang, got in sums.items():
            at = np.flatnonzero(got)
            yield pd.DataFrame({"lang": lang, "gram": at, "n": got[at]})

    counts = (sample.select("lang", "text").mapInPandas(count, "lang string, gram long, n long")
              .groupBy("lang", "gram").agg(F.sum("n").alias("n")).toPandas())
    names = sorted(counts["lang"].unique())
    table = np.full((BUCKETS, max(len(names), 1)), SMOOTHING)
    if names:
        table[counts["gram"].to_numpy(), counts["lang"].map({x: i for i, x in enumerate(names)}).to_numpy()] += counts["n"].to_numpy()
    return names, np.log(table / table.sum(axis=0)).astype(np.float32)


class Mixture:
    def __init__(self, names: list[str], logs: np.ndarray):
        self.names, self.logs = names, logs
        self.probs = np.exp(logs.astype(np.float64))

    def refine(self, gram: np.ndarray, weight: np.ndarray, start: int) -> dict[int, float]:
        """The language set and proportions of one text, grown from one language."""
        probs, total = self.probs[gram], weight.sum()
        penalty = PENALTY + 0.5 * np.log(max(total * INDEPENDENT, 1))
        chosen, theta = [start], np.ones(1)
        mix = probs[:, start]
        best = float(weight @ np.log(mix))
        while len(chosen) < len(self.names):
            slope = (weight / mix) @ probs - total  # how fast the likelihood grows as a language enters
            slope[chosen] = -np.inf
            enters = int(slope.argmax())
            if slope[enters] * INDEPENDENT <= penalty:
                break
            tried, part = [*chosen, enters], np.append(theta * 0.9, 0.1)
            p = probs[:, tried]
            for _ in range(ITERATIONS):
                new = part * ((weight / (p @ part)) @ p) / total
                moved = np.abs(new - part).max()
                part = new
                if moved < 1e-3:
                    break
            value = float(weight @ np.log(p @ part))
            if (value - best) * INDEPENDENT <= penalty:
                break
            chosen, theta, best, mix = tried, part, value, p @ part
        return dict(zip(chosen, theta, strict=True))

    def predict(self, texts: list[bytes]) -> list[tuple[str, float, str]]:
        """(language, its proportion, all proportions) of each text."""
        out: list = [None] * len(texts)
        at = 0
        while at < len(texts):
            stop, size = at, 0
            while stop < len(texts) and (stop == at or size + len(texts[stop]) <= CHUNK):
                size += len(texts[stop])
                stop += 1
            found = []
            for data in texts[at:stop]:
                g = grams(data)
                if len(data) > LONG:
                    counts = np.bincount(g, minlength=BUCKETS)
                    g = np.flatnonzero(counts)
                    found.append((g, counts[g].astype(np.float64)))
                else:
                    found.append((g, None))
            flat = np.concatenate([g for g, _ in found])
            starts = np.cumsum([0, *(len(g) for g, _ in found[:-1])])
            weights = None
            if any(w is not None for _, w in found):
                weights = np.concatenate([np.ones(len(g)) if w is None else w for g, w in found])
            logs = self.logs[flat]
            first = np.add.reduceat(logs if weights is None else logs * weights[:, None], starts, axis=0).argmax(axis=1)
            spans = np.append(starts, len(flat))
            ratio = np.exp(logs - np.take_along_axis(logs, np.repeat(first, np.diff(spans))[:, None], 1))
            sums = np.add.reduceat(ratio if weights is None else ratio * weights[:, None], starts, axis=0, dtype=np.float64)
            totals = np.diff(spans) if weights is None else np.add.reduceat(weights, starts)
            gap = (sums - totals[:, None]).max(axis=1) * INDEPENDENT
            settled = gap <= PENALTY + 0.5 * np.log(np.maximum(totals * INDEPENDENT, 1))
            for i, (g, w) in enumerate(found):
                parts = {int(first[i]): 1.0} if settled[i] else self.refine(g, np.ones(len(g)) if w is None else w, int(first[i]))
                top = max(parts, key=lambda x: (parts[x], -x))
                told = " ".join(f"{self.names[x]}:{parts[x]:.3f}" for x in sorted(parts, key=lambda x: (-parts[x], x)))  # noqa: B023
                out[at + i] = (self.names[top], min(1.0, float(parts[top])), told)
            at = stop
        return out


RESULT = "doc_id string, held_out boolean, lang_pred string, score double, languages string"


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """doc_id, held_out, lang_pred, score (the proportion of that language)
    and languages (every language of the chosen set with its proportion).

    Null texts, texts without a letter, and all texts if there is nothing to
    learn from, give `und` with score 0. Whole texts are read; equal
    likelihoods go to the language first in order; repeated rows repeat; null
    ids are not held out and never learned from. Texts stay where they are:
    the model (BUCKETS numbers for each language) is broadcast."""
    names, logs = fit(docs.where(F.col(id_col).isNotNull()), id_col=id_col, text_col=text_col, lang_col=lang_col)
    model = docs.sparkSession.sparkContext.broadcast((names, logs))

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        mixture = Mixture(*model.value)
        for batch in batches:
            ids, held, lettered, texts = (batch.iloc[:, i] for i in range(4))
            told: list = [("und", 0.0, "")] * len(batch)
            some = [i for i, x in enumerate(lettered) if x and mixture.names]
            for i, got in zip(some, mixture.predict([texts.iloc[i].encode() for i in some]), strict=True):
                told[i] = got
            yield pd.DataFrame({"doc_id": ids, "held_out": held, "lang_pred": [x[0] for x in told],
                                "score": [x[1] for x in told], "languages": [x[2] for x in told]})

    return ids_back(docs.select(ids_as_text(docs, id_col), held_out(id_col).alias("held_out"),
                        F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False)).alias("lettered"), F.col(text_col).alias("text"))
                    .mapInPandas(rows, RESULT))
