"""Language identification with language-bitmask n-gram filters.

All languages share one Bloom filter whose slots hold a bit per language, so one
look-up of an n-gram's slots, combined by AND, returns every language that
contains it. A text is decided by the count of each language's bits over its
n-grams, after taking off what the filter answers by chance.
"""

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from themeloom.plans.lineage import cut

GRAM = 4
UNDETERMINED = "und"
LETTER = r"\p{L}"
BITS = 7  # languages per row of slots
COUNTED_AT_ONCE = 2_000_000  # n-grams a task holds before it counts them
MULTIPLIERS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], np.uint32)  # odd, one per slot


@dataclass(frozen=True)
class LanguageOptions:
    """Bounds of the classifier; nothing else limits what is read.

    It is fitted on the whole texts of all labelled rows, keeps the ``grams`` most
    frequent n-grams of each language, and a language holds an n-gram only if its
    rate is at least ``shared`` of the highest rate of any language.
    ``slot_bits`` fixes the size of the filter.

    A text is trusted to be in a learnt language if the share of its n-grams that
    its language holds is at least ``slack`` of the share that all but a
    thousandth of the labelled rows reach.
    """

    grams: int = 30_000
    shared: float = 0.25
    slot_bits: int = 20
    slack: float = 0.5


@dataclass(frozen=True)
class LanguageModel:
    """The filter: ``masks`` has rows of slots, a bit per language in as many rows as it takes.

    ``noise`` is the chance of a false hit per language, ``least_known`` the share
    of known n-grams from which a text is trusted.
    """

    languages: list[str]
    masks: np.ndarray
    noise: np.ndarray
    fallback: int
    least_known: float = 0.0

    def predict(self, text: str) -> tuple[str, float, float]:
        """Language, score, and the share of n-grams that the language holds."""
        if not self.languages:
            return UNDETERMINED, 0.0, 0.0
        codes = gram_codes(text)
        if not len(codes):
            return self.languages[self.fallback], 0.0, 0.0
        share = self.hits(codes).sum(1) / len(codes)
        share = np.maximum(share - self.noise, 0) / (1 - self.noise)
        if not share.any():
            return self.languages[self.fallback], 0.0, 0.0
        best = int(share.argmax())
        return self.languages[best], float(share[best] / share.sum()), float(share[best])

    def hits(self, codes: np.ndarray) -> np.ndarray:
        """For every language whether the filter holds each n-gram."""
        places = list(slots(codes, self.masks.shape[1]))
        found = [np.bitwise_and.reduce([row[slot] for slot in places]) for row in self.masks]
        kind = self.masks.dtype.type
        return np.array([found[i // BITS] & kind(1 << i % BITS) != 0 for i in range(len(self.languages))])


def gram_codes(text: str) -> np.ndarray:
    """The lower-cased text's byte n-grams, with a margin of two spaces, as numbers."""
    data = np.frombuffer(b"  " + text.lower().encode("utf-8", "surrogatepass") + b"  ", np.uint8)
    wide = data.astype(np.uint32)
    return wide[:-3] << 24 | wide[1:-2] << 16 | wide[2:-1] << 8 | wide[3:]


def slots(codes: np.ndarray, size: int) -> Iterator[np.ndarray]:
    shift = np.uint32(32 - (size.bit_length() - 1))
    mixed = codes ^ codes >> np.uint32(15)
    for m in MULTIPLIERS:
        yield (mixed * m) >> shift


def fit(docs: DataFrame, key: str, text: str, lang: str, options: LanguageOptions) -> LanguageModel:
    """The model of the labelled rows of ``docs``; rows without text or language teach nothing."""
    labelled = docs.select(F.col(text).alias("t"), F.col(lang).alias("l")).where(
        "t is not null and l is not null"
    )
    counts = cut(labelled.groupBy("l").agg(F.count(F.lit(1)).alias("rows")))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            waiting: dict[str, list[np.ndarray]] = {}
            held = 0
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                codes = gram_codes(text.as_py())
                waiting.setdefault(label, []).append(codes)
                held += len(codes)
                if held >= COUNTED_AT_ONCE:
                    yield from counted(waiting)
                    waiting, held = {}, 0
            yield from counted(waiting)

    def counted(waiting: dict[str, list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for label, codes in waiting.items():
            seen, n = np.unique(np.concatenate(codes), return_counts=True)
            columns = [pa.array([label] * len(seen)), pa.array(seen.astype(np.int64)), pa.array(n.astype(np.int64))]
            yield pa.RecordBatch.from_arrays(columns, ["l", "gram", "n"])

    found = cut(
        labelled.select("l", "t").mapInArrow(run, "l string, gram long, n long")
        .groupBy("l", "gram").agg(F.sum("n").alias("n"))
    )
    totals = found.groupBy("l").agg(F.sum("n").alias("total"))  # a row per language
    grams = (
        found.join(F.broadcast(totals), "l")
        .withColumn("rate", F.col("n") / F.col("total"))
        .withColumn("highest", F.max("rate").over(W.partitionBy("gram")))
        .where(F.col("rate") >= options.shared * F.col("highest"))
        .withColumn("rank", F.row_number().over(W.partitionBy("l").orderBy(F.desc("n"), "gram")))
        .where(F.col("rank") <= options.grams)
    )
    # At most `grams` rows per language: the model, not the data.
    chosen = grams.select("l", "gram").toPandas()
    known = {r.l: r.rows for r in counts.collect()}
    languages = sorted(known)
    masks = np.zeros((-(-len(languages) // BITS), 1 << options.slot_bits), np.int8)
    noise = np.zeros(len(languages))
    for number, name in enumerate(languages):
        row, bit = masks[number // BITS], np.int8(1 << number % BITS)
        for slot in slots(chosen.gram[chosen.l == name].to_numpy(np.uint32), len(row)):
            row[slot] |= bit
        noise[number] = (np.count_nonzero(row & bit) / len(row)) ** len(MULTIPLIERS)
    fallback = max(range(len(languages)), key=lambda i: known[languages[i]], default=0)
    model = LanguageModel(languages, masks, noise, fallback)
    shares = labelled.where(F.col("t").rlike(LETTER)).select(predicted(docs.sparkSession, model, "t")["known"].alias("known"))
    usual = shares.agg(F.percentile_approx("known", 0.001, 100_000)).first()[0] or 0.0
    return replace(model, least_known=options.slack * usual)


def predicted(spark: SparkSession, model: LanguageModel, text: str | Column) -> Column:
    """Struct of ``lang_pred``, ``score``, ``known`` and ``trusted`` for whole texts.

    ``und`` with score 0 for null texts and texts without a letter; a text of
    which no n-gram is known gets the language of most training rows, score 0.
    ``known`` is the share of n-grams that the language holds; ``und`` and what
    has less than the model's least share is not trusted.
    """
    # Arrays and names of a fixed size; executors need no class to read them.
    plain = (model.languages, model.masks, model.noise, model.fallback, model.least_known)
    shared = spark.sparkContext.broadcast(plain)

    @F.pandas_udf("lang_pred string, score double, known double, trusted boolean")
    def run(texts: pd.Series) -> pd.DataFrame:
        held = LanguageModel(*shared.value)
        found = [held.predict(t) if t is not None else (UNDETERMINED, 0.0, 0.0) for t in texts]
        rows = [(*r, r[0] != UNDETERMINED and r[2] >= held.least_known and r[2] > 0) for r in found]
        return pd.DataFrame(rows, columns=["lang_pred", "score", "known", "trusted"])

    column = F.col(text) if isinstance(text, str) else text
    # Texts without a letter are told apart in the JVM.
    return run(F.when(column.rlike(LETTER), column))


def held_out(key: str) -> Column:
    """The fold that is never learnt from; null keys are in no fold."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(
    docs: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    options: LanguageOptions = LanguageOptions(),
) -> DataFrame:
    """``docs`` with ``held_out`` and the prediction ``p`` in a struct ``_language`` (which replaces a column so named).

    Learns from the rows outside the held-out fold and predicts all rows, from
    their text alone. Repeated rows are predicted alike; an empty table learns
    nothing and gives an empty result.
    """
    model = fit(docs.where(~held_out(key)), key, text, lang, options)
    return docs.withColumn(
        "_language",
        F.struct(held_out(key).alias("held_out"), predicted(docs.sparkSession, model, text).alias("p")),
    )
