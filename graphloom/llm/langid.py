"""Language identification: multinomial naive Bayes over hashed character n-grams."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from graphloom.llm.common import bound_batches, id_crc, release, slices, table

#: Hash buckets of the feature space (a power of two) and the longest n-gram.
BUCKETS, LONGEST = 1 << 15, 3
#: About so many labelled documents of each language are learnt from: the bound of the training sample.
MOST_SAMPLED = 3_000
#: Languages that a model may have. With BUCKETS it bounds the broadcast matrix (32 MB).
MOST_LANGUAGES = 256
SMOOTHING = 0.5
#: Characters of a piece of a text, and numbers of the weights gathered at once (16 MB).
PIECE, GATHERED = 1 << 13, 1 << 22
OUT = "doc_id long, lang_pred string, score double"


@dataclass
class Model:
    languages: list[str]
    prior: np.ndarray  # log, one for each language
    weights: np.ndarray  # log P(bucket | language), (BUCKETS, languages) float32


def pieces(text: str) -> list[str]:
    """A text cut into pieces of PIECE characters at most, before a blank if there is one. No n-gram crosses a cut."""
    out, at = [], 0
    while len(text) - at > PIECE:
        cut = text.rfind(" ", at + 1, at + PIECE)
        out.append(text[at : (at := cut if cut > 0 else at + PIECE)])
    return [*out, text[at:]]


def features(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of lower-cased texts, side by side, and where each text's begin.

    Runs of letters are kept; anything else is one blank, so digits and marks are no evidence. A text begins and ends with
    a blank. Each place has LONGEST n-grams; those that would reach beyond the text repeat the single one.
    """
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join([f"\n{t}\n" for t in low]).encode("utf-32-le", "surrogatepass"), np.uint32)
    begins = np.concatenate([[0], np.cumsum([len(t) + 2 for t in low])]).astype(np.int64)
    high = codes >= 128
    letter = ((codes >= 97) & (codes <= 122)) | (high & (codes != 0xA0) & ~((codes >= 0x2000) & (codes < 0x2070)) & ~((codes >= 0xA1) & (codes < 0xC0)))
    x = np.where(letter, codes, np.uint32(32)).astype(np.uint64)
    keep = np.ones(len(x), bool)
    keep[1:] = (x[1:] != 32) | (x[:-1] != 32)
    keep[begins[:-1]] = True
    starts = np.concatenate([[0], np.cumsum(keep)])[begins]
    x = x[keep]
    left = np.repeat(starts[1:], np.diff(starts)) - np.arange(len(x))  # places to the end of the own text
    out = np.empty((len(x), LONGEST), np.int32)
    h = np.zeros(len(x), np.uint64)
    for n in range(1, LONGEST + 1):
        tail = np.concatenate([x[n - 1 :], np.zeros(min(n - 1, len(x)), np.uint64)])
        h = h * np.uint64(0x100000001B3) + tail + np.uint64(n)
        out[:, n - 1] = (h * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKETS.bit_length() + 1)
        if n > 1:
            out[:, n - 1] = np.where(left >= n, out[:, n - 1], out[:, 0])
    return out.ravel(), starts[:-1] * LONGEST


def _grouped(texts: list[str], most: int) -> Iterator[tuple[list[str], list[int]]]:
    """Pieces of texts with the number of the text they are of, in groups of ``most`` characters, or one piece."""
    held, own, n = [], [], 0
    for i, t in enumerate(texts):
        for x in pieces(t):
            if held and n + len(x) > most:
                yield held, own
                held, own, n = [], [], 0
            held.append(x)
            own.append(i)
            n += len(x)
    if held:
        yield held, own


def counts_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, bucket, n) and (lang, -1, documents), summed over a task."""
    held: dict[str, np.ndarray] = {}
    for batch in slices(batches, most=1 << 18):
        texts, langs = batch.column("text").to_pylist(), batch.column("lang").to_pylist()
        for lang in set(langs):
            own = [t for t, x in zip(texts, langs, strict=True) if x == lang]
            sums = held.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for group, _ in _grouped(own, GATHERED // LONGEST):
                sums[:BUCKETS] += np.bincount(features(group)[0], minlength=BUCKETS)
            sums[BUCKETS] += len(own)
    for lang, sums in held.items():
        at = np.nonzero(sums)[0]
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(np.where(at == BUCKETS, -1, at).astype(np.int32)), pa.array(sums[at])], ["lang", "bucket", "n"])


def fit(docs: DataFrame, most: int = MOST_SAMPLED) -> Model:
    """Learn from (doc_id, text, lang): rows whose lang is not null and whose text has a letter.

    About ``most`` documents of each language are used, chosen by their id's hash with a share that
    comes from exact counts of each language; languages are balanced, so the prior is uniform. No row to learn
    from gives a model without languages, which predicts ``und``. More than MOST_LANGUAGES languages are an error.
    """
    rows = docs.where("lang is not null").select(F.col("doc_id").cast("long"), "text", "lang")
    sizes = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MOST_LANGUAGES + 1).collect()}
    if len(sizes) > MOST_LANGUAGES:
        raise ValueError(f"over {MOST_LANGUAGES} languages")
    if not sizes:
        return Model([], np.zeros(0), np.zeros((BUCKETS, 0), np.float32))
    share = F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, most / n))])
    chosen = rows.where((F.pmod(F.xxhash64("doc_id", F.lit(5)), F.lit(1 << 30)) < share[F.col("lang")] * (1 << 30)) & F.col("text").rlike(r"\p{L}"))
    got = chosen.mapInArrow(counts_of, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    languages = sorted(got["lang"].unique())
    table_ = np.full((BUCKETS, len(languages)), SMOOTHING)
    for k, lang in enumerate(languages):
        own = got[(got["lang"] == lang) & (got["bucket"] >= 0)]
        table_[own["bucket"].to_numpy(), k] += own["n"].to_numpy()
    return Model(languages, np.full(len(languages), -np.log(max(1, len(languages)))), np.log(table_ / table_.sum(0)).astype(np.float32))


def score(model: Model, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(index of the likeliest language, its posterior probability) of each text.

    A batch is a sparse matrix of buckets by rows; its product with the weights is a sum of gathered rows, taken by pieces
    of texts, so that GATHERED numbers or those of one piece are gathered at once.
    """
    total = np.tile(model.prior.astype(np.float64), (len(texts), 1))
    for group, own in _grouped(texts, GATHERED // (LONGEST * len(model.languages))):
        index, starts = features(group)
        np.add.at(total, own, np.add.reduceat(model.weights[index], starts, axis=0, dtype=np.float64))
    total -= total.max(1, keepdims=True)
    p = np.exp(total)
    best = p.argmax(1)
    return best, 1 / p.sum(1)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """(doc_id, lang_pred, score) of each row's whole text; ``und`` with score 0 if it is null or has no letter.

    Ties go to the language that sorts first. Only the text is an input. Repeated rows and null ids are kept.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, most=1 << 18):
            lang, p = predicted(m, batch.column("text").to_pylist(), batch.column("lettered").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), lang, p], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text", F.col("text").rlike(r"\p{L}").alias("lettered")).mapInArrow(run, OUT)


def predicted(model: Model, texts: list, lettered: list) -> tuple[pa.Array, pa.Array]:
    at = [i for i, x in enumerate(lettered) if x] if model.languages else []
    lang, p = ["und"] * len(texts), np.zeros(len(texts))
    if at:
        best, sure = score(model, [texts[i] for i in at])
        p[at] = sure
        for i, k in zip(at, best, strict=True):
            lang[i] = model.languages[k]
    return pa.array(lang, pa.string()), pa.array(p)


def keep_known(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The rows of ``docs``, all columns, whose language is told with a posterior of ``least`` at least.

    Rejected: null texts, texts without a letter, and texts that no language explains better than the rest together.
    A model without languages rejects only the first two.
    """
    if not model.languages:
        return docs.where(F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False)))
    bound_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("boolean")
    def known(text, lettered):
        import pandas as pd

        keep = np.zeros(len(text), bool)
        for at in _runs(text):
            lang, p = predicted(shared.value, list(text.iloc[at]), list(lettered.iloc[at]))
            keep[at] = (np.array(lang.to_pylist()) != "und") & (p.to_numpy() >= least)
        release()
        return pd.Series(keep)

    return docs.where(known(F.col("text"), F.coalesce(F.col("text").rlike(r"\p{L}"), F.lit(False))))


def _runs(text) -> Iterator[slice]:
    at, held = 0, 0
    for i, t in enumerate(text):
        held += len(t or "")
        if held > 1 << 18:
            yield slice(at, i + 1)
            at, held = i + 1, 0
    yield slice(at, len(text))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document: doc_id, held_out, lang_pred, score. A null id counts as empty text in held_out; see ``fit`` and
    ``predict`` for null texts, ties, repeated rows and empty tables."""
    docs = table(spark, sf_dir, "documents")
    held_out = id_crc() % 3 == 1
    model = fit(docs.where(~held_out))
    return predict(docs, model).withColumn("held_out", held_out).select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {"op4_language_id": op4_language_id}
ORACLE: dict[str, str] = {}
