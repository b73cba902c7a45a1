"""Language identification by the nearest of several centroids per language.

A text is lower-cased, everything but letters becomes one space, and its byte
n-grams (1 to 4) are hashed to a fixed number of features. Counts are damped,
weighted by inverse document frequency and normalised. Each language has a few
centroids, found by spherical k-means; the language of the centroid with the
largest cosine is predicted. A text further from that centroid than anything it
was fitted on, by a margin, is rejected. So is a text of any length that is far
from the n-gram profile of every language: the share of its 4-grams that a
language's sampled rows have is below what those rows, each against the others,
lead to expect; texts under LEAST_BYTES are held against starts of rows.

The model is fitted on a bounded sample: ``per_lang`` labelled rows of each
language, those with the smallest hash of doc_id
(of the share of rows, known from the counts, that holds some four times as many). Its size does not depend on
the input's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, fresh, lean, narrow, small, trim

UNKNOWN = "und"
#: Hashed features, largest n-gram, centroids per language, labelled rows per language.
FEATURES, GRAMS, CENTROIDS, PER_LANG = 4096, 4, 4, 300
#: What a text may be further from its centroid than all that the centroid was fitted on.
MARGIN = 0.1
#: Bytes below which no text is rejected for its cosine (too few n-grams to tell), and its profile has a threshold of its own.
LEAST_BYTES = 200
#: Bits of the hash of a profile's n-grams; bytes of a sampled row that enter it, and of the starts that short texts are held against.
PROFILE_BITS, PROFILE_BYTES, START_BYTES = 18, 1 << 14, 64
#: The quantile of the sampled rows' known shares, and the part of it that a text needs.
PROFILE_QUANTILE, PROFILE_PART = 0.01, 0.5
#: Letters of one text that are counted at a time.
BLOCK = 1 << 20
#: Letters and the numerals that ``re`` takes for some.
_LETTER = re.compile(r"[^\W\d_]")
_SPACES = re.compile(rb" +")
_FOLD = bytes(c if c >= 128 or 97 <= c <= 122 else 32 for c in range(256))


def letters(text: str | None) -> bytes:
    """Lower-cased UTF-8 with every run of other ASCII characters as one space; empty if there is no letter."""
    if not text or not any(m[0].isalpha() for m in _LETTER.finditer(text)):
        return b""
    return _SPACES.sub(b" ", b" " + text.lower().encode("utf-8", "replace").translate(_FOLD) + b" ")


def counts(folded: bytes) -> np.ndarray:
    """How often each hashed n-gram occurs."""
    out = np.zeros(FEATURES, dtype=np.int64)
    shift = np.uint32(32 - FEATURES.bit_length() + 1)
    for at in range(0, len(folded), BLOCK):
        raw = np.frombuffer(folded[at : at + BLOCK + GRAMS - 1], dtype=np.uint8).astype(np.uint32)
        code = np.zeros(len(raw), dtype=np.uint32)
        for n in range(1, GRAMS + 1):
            code = code[: len(raw) - n + 1] * np.uint32(256) + raw[n - 1 :]
            own = code[:BLOCK]
            mixed = (own ^ (own >> np.uint32(15))) * np.uint32(2654435761) + np.uint32(n * 40503)
            out += np.bincount((mixed * np.uint32(2246822519)) >> shift, minlength=FEATURES)
    return out


def codes(folded: bytes) -> np.ndarray:
    """Hash of every 4-gram, in PROFILE_BITS bits."""
    raw = np.frombuffer(folded, dtype=np.uint8).astype(np.uint32)
    code = np.zeros(len(raw), dtype=np.uint32)
    for n in range(1, GRAMS + 1):
        code = code[: max(len(raw) - n + 1, 0)] * np.uint32(256) + raw[n - 1 :]
    mixed = (code ^ (code >> np.uint32(15))) * np.uint32(2654435761)
    return ((mixed ^ (mixed >> np.uint32(13))) * np.uint32(2246822519)) >> np.uint32(32 - PROFILE_BITS)


@dataclass
class Model:
    """Languages of the centroids, centroids (rows), inverse document frequencies, least cosines.

    ``known`` has a row of flags for each language, by code; ``shares`` the
    least known shares of its short and its other texts.
    """

    langs: list[str]
    centroids: np.ndarray
    idf: np.ndarray
    least: np.ndarray
    known: np.ndarray
    shares: np.ndarray

    def vectors(self, many: np.ndarray) -> np.ndarray:
        out = np.log1p(many) * self.idf
        return out / np.maximum(np.linalg.norm(out, axis=-1, keepdims=True), 1e-12)

    def strange(self, folded: bytes) -> bool:
        """Whether the text is far from the profile of every language; never if it has no 4-gram."""
        hits, n = np.zeros(len(self.known), dtype=np.int64), max(len(folded) - GRAMS + 1, 0)
        for at in range(0, n, BLOCK):
            hits += self.known[:, codes(folded[at : at + BLOCK + GRAMS - 1])].sum(axis=1)
        return n > 0 and bool((hits < n * self.shares[:, int(len(folded) >= LEAST_BYTES)]).all())

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        """Language, cosine, and whether the distance rejects it."""
        folded = letters(text)
        if not folded or not self.langs:
            return UNKNOWN, 0.0, True
        cosines = self.centroids @ self.vectors(counts(folded))
        best = int(np.argmax(cosines))
        score = float(np.clip(cosines[best], 0.0, 1.0))
        return self.langs[best], score, len(folded) >= LEAST_BYTES and bool(score < self.least[best]) or self.strange(folded)


def spherical_kmeans(x: np.ndarray, k: int, seed: int = 0, rounds: int = 20) -> tuple[np.ndarray, np.ndarray]:
    """Unit centroids of the rows of ``x`` and each row's centroid."""
    rng = np.random.default_rng(seed)
    centres = x[rng.choice(len(x), size=min(k, len(x)), replace=False)]
    for _ in range(rounds):
        own = np.argmax(x @ centres.T, axis=1)
        sums = np.array([x[own == c].sum(axis=0) if (own == c).any() else centres[c] for c in range(len(centres))])
        centres = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centres, np.argmax(x @ centres.T, axis=1)


def profile(rows: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Flags of the codes that a language's rows have, and its least known shares.

    A row is its distinct codes, their counts and the codes of its start. Its
    share is that of the codes which another row has too.
    """
    many = np.zeros(1 << PROFILE_BITS, dtype=np.int32)
    for own, _, _ in rows:
        many[own] += 1
    starts = [(many[start] > 1).mean() for _, _, start in rows if len(start)]
    wholes = [n[many[own] > 1].sum() / n.sum() for own, n, _ in rows if n.sum() + GRAMS > LEAST_BYTES]
    low = lambda x: PROFILE_PART * float(np.quantile(x, PROFILE_QUANTILE)) if x else 0.0
    return many > 0, np.array([low(starts), low(wholes or starts)])


def fit(labelled: DataFrame, per_lang: int = PER_LANG, centroids: int = CENTROIDS) -> Model:
    """Fit on at most ``per_lang`` rows of each language of ``labelled`` (doc_id, text, lang).

    Rows with a null text or lang are passed over. Only hashed counts of the
    sample come to the driver.
    """
    # a share by hash, known from the counts, leaves a few times the sample to rank
    labelled = labelled.select("doc_id", "text", "lang").where("text is not null and lang is not null")
    counted = labelled.groupBy(F.col("lang").alias("_lang")).agg(F.count("*").alias("_rows"))
    counted = cut(counted, "languages")
    drawn = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30))
    near = labelled.join(small(counted, counted.count()), F.col("lang") == F.col("_lang")).where(drawn * F.col("_rows") <= F.lit(4 * per_lang << 30))
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    sample = near.select("lang", "doc_id", "text").withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= per_lang)

    def featurise(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            folded = [letters(text) for text in part["text"]]
            rows = [(lang, doc, counts(text)) for lang, doc, text in zip(part["lang"], part["doc_id"], folded, strict=True)]
            grams = [np.unique(codes(text[:PROFILE_BYTES]), return_counts=True) for text in folded]
            sent = {"codes": [g[0].astype("<i4").tobytes() for g in grams], "times": [g[1].astype("<i2").tobytes() for g in grams], "start": [codes(text[:START_BYTES]).astype("<i4").tobytes() for text in folded]}
            yield pd.DataFrame({"lang": [r[0] for r in rows], "doc_id": [r[1] for r in rows], "at": [np.flatnonzero(r[2]).astype("<i2").tobytes() for r in rows], "n": [r[2][np.flatnonzero(r[2])].astype("<i4").tobytes() for r in rows], **sent})

    kind = labelled.schema["doc_id"].dataType.simpleString()
    got = sample.select("lang", "doc_id", "text").mapInPandas(lean(featurise), f"lang string, doc_id {kind}, at binary, n binary, codes binary, times binary, start binary").collect()
    got = sorted((r for r in got if len(r["at"])), key=lambda r: (r["lang"], str(r["doc_id"]), bytes(r["at"])))
    holders = np.zeros(FEATURES, dtype=np.int64)
    for r in got:
        holders[np.frombuffer(r["at"], "<i2")] += 1
    idf = np.log((1 + len(got)) / (1 + holders)) + 1
    model = Model([], np.zeros((0, FEATURES)), idf, np.zeros(0), np.zeros((0, 1 << PROFILE_BITS), dtype=bool), np.zeros((0, 2)))
    # the vectors of one language are held at a time
    for lang in sorted({r["lang"] for r in got}):
        drawn = [r for r in got if r["lang"] == lang]
        own, many = np.zeros((len(drawn), FEATURES)), np.zeros(FEATURES, dtype=np.float32)
        for row, r in zip(own, drawn, strict=True):
            many[:] = 0
            many[np.frombuffer(r["at"], "<i2")] = np.frombuffer(r["n"], "<i4")
            row[:] = model.vectors(many)
        centres, of = spherical_kmeans(own, centroids)
        cosines = np.array([np.einsum("ij,ij->i", own[k : k + 1], centres[of[k : k + 1]])[0] for k in range(len(own))])
        model.langs += [lang] * len(centres)
        model.centroids = np.vstack([model.centroids, centres])
        # no clustered centroid is stricter than the loosest of its language
        model.least = np.append(model.least, [max(0.0, cosines.min() - MARGIN)] * len(centres))
        rows = [(np.frombuffer(r["codes"], "<i4"), np.frombuffer(r["times"], "<i2"), np.frombuffer(r["start"], "<i4")) for r in drawn]
        known, shares = profile(rows)
        model.known, model.shares = np.vstack([model.known, known]), np.vstack([model.shares, shares])
    model.centroids, model.idf = model.centroids.astype(np.float32), idf.astype(np.float32)
    got = own = drawn = rows = None
    trim()
    return model


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """Add lang_pred, score and rejected to all of ``docs``, from whole texts alone.

    Texts that are null, empty or without a letter are ``und`` with score 0 and
    rejected. Equal rows get equal answers; other columns stay as they are.
    """
    narrow(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("lang_pred string, score double, rejected boolean")
    def predict(texts: pd.Series) -> pd.DataFrame:
        rows = [sent.value.predict(t) for t in texts]
        return pd.DataFrame({"lang_pred": [r[0] for r in rows], "score": [r[1] for r in rows], "rejected": [r[2] for r in rows]})

    named = [c for c in docs.columns if c not in ("lang_pred", "score", "rejected")]
    own = fresh(docs, "_language")
    # said to be non-deterministic, it is not evaluated again for a filter on its result
    found = docs.select(*[F.col(f"`{c}`") for c in named], predict.asNondeterministic()("text").alias(own))
    return found.select(*[F.col(f"`{c}`") for c in named], f"{own}.lang_pred", f"{own}.score", f"{own}.rejected")
