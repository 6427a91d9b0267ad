"""Language identification by rank-order profiles.

A language's profile is its most frequent character n-grams in order of frequency. A document is compared by the
out-of-place distance: for each of its own most frequent n-grams, how far its rank is from the rank in the profile, or
the greatest distance where the profile lacks it. The nearest profile names the language.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from oriscope.llm._shared import give_back, slices, unused

SPACE = 32


@cache
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """For each code point: its lower-case form, or a space if it is no letter; and whether it is a letter."""
    low, letter = np.full(0x110000, SPACE, np.int64), np.zeros(0x110000, bool)
    for i in range(0x110000):
        c = chr(i)
        if c.isalpha():
            letter[i] = True
            small = c.lower()
            low[i] = ord(small) if len(small) == 1 else i
    return low, letter


SLICE = 1 << 20


def _pieces(codes: np.ndarray, letter: np.ndarray) -> Iterator[np.ndarray]:
    """The code points in pieces of about SLICE, which end at other characters than letters: no n-gram crosses these."""
    at, step = 0, SLICE
    while at + step < len(codes):
        end = at + step
        while end < len(codes) and letter[codes[end : end + SLICE]].all():
            end += SLICE
        if end >= len(codes):
            break
        end += int(np.argmin(letter[codes[end : end + SLICE]]))
        yield codes[at:end]
        at = end
    yield codes[at:]


def _count(codes: np.ndarray, low: np.ndarray, orders: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    x = np.r_[SPACE, low[codes], SPACE]
    gap = x == SPACE
    x = x[np.r_[True, ~(gap[1:] & gap[:-1])]]
    gap = x == SPACE
    grams = []
    for n in orders:
        size = len(x) - n + 1
        if size < 1:
            continue
        packed, inner = np.zeros(size, np.int64), np.zeros(size, bool)
        for i in range(n):
            packed = (packed << 21) | x[i : i + size]
            if 0 < i < n - 1 or n == 1:
                inner |= gap[i : i + size]
        grams.append(packed[~inner])
    return np.unique(np.concatenate(grams), return_counts=True)


def _summed(found: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """The sum of (n-grams, counts)."""
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found]), len(grams)).astype(np.int64)


def ngram_counts(text: str, orders: tuple[int, ...] = (1, 2, 3)) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of code points and their counts; other characters than letters part words, as one space.

    An n-gram is packed as 21 bits a character. Those that hold a space inside are left out, as they cross words. A
    text is counted in pieces of bounded size, unless it is one word.
    """
    low, letter = _tables()
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4")
    if not letter[codes].any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    total = None
    for piece in _pieces(codes, letter):
        if letter[piece].any():
            found = _count(piece, low, orders)
            total = found if total is None else _summed([total, found])
    return total


def _ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties by their own order."""
    if len(grams) > top:
        least = np.partition(counts, len(counts) - top)[len(counts) - top]
        keep = counts >= least
        grams, counts = grams[keep], counts[keep]
    return grams[np.lexsort((grams, -counts))][:top]


def learn_profiles(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 400, rows_per_lang: int = 4000) -> dict[str, np.ndarray]:
    """Ranked n-grams of each language, from a bounded sample of labelled rows.

    About rows_per_lang whole texts of each language are counted, chosen by a hash of id and text; the counts are summed
    by Spark and `top` n-grams a language come to the driver. Rows with a null text or language take no part.
    """
    labelled = labelled.filter(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull())
    sizes = {r[0]: r[1] for r in labelled.groupBy(lang_col).count().collect()}
    if not sizes:
        return {}
    share = F.element_at(F.create_map(*(x for k, n in sizes.items() for x in (F.lit(k), F.lit(min(1.0, rows_per_lang / n))))), F.col(lang_col))
    chosen = labelled.filter(F.pmod(F.xxhash64(id_col, text_col), F.lit(1 << 20)) < share * (1 << 20)).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            per: dict[str, list] = {}
            for lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                per.setdefault(lang, []).append(ngram_counts(text))
            for lang, found in per.items():
                grams, counts = _summed(found)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams, pa.int64()), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    counts = chosen.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))

    nth = F.row_number().over(Window.partitionBy("lang").orderBy(F.col("n").desc(), "gram"))
    found = counts.withColumn("nth", nth).filter(F.col("nth") <= top).toPandas().sort_values(["lang", "nth"])  # `top` rows a language
    return {lang: pdf["gram"].to_numpy(np.int64) for lang, pdf in found.groupby("lang")}


def identify(docs: DataFrame, profiles: dict[str, np.ndarray], text_col: str = "text", keep: tuple[str, ...] = (), top: int = 400, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """`keep` columns, lang_pred and score for each row of docs; `names` are those of the latter two, for tables that
    have such columns.

    score is 1 less the distance over the greatest possible one: 1 for a text that ranks its n-grams as the profile
    does, 0 for one that shares none. Null and empty texts and those without a letter are `und` with score 0, as all
    are if there are no profiles. Ties go to the language that sorts first. keep names other columns than text_col.
    """
    langs = sorted(profiles)
    grams = np.unique(np.concatenate([profiles[x] for x in langs])) if langs else np.zeros(0, np.int64)
    ranks = np.full((len(langs), len(grams) + 1), -1, np.int64)
    for i, lang in enumerate(langs):
        ranks[i, np.searchsorted(grams, profiles[lang])] = np.arange(len(profiles[lang]))

    def predict(text: str | None) -> tuple[str, float]:
        found = _ranked(*ngram_counts(text), top) if text and langs else ()
        if not len(found):
            return "und", 0.0
        at = np.searchsorted(grams, found)
        at[(at == len(grams)) | (grams[np.minimum(at, len(grams) - 1)] != found)] = len(grams)
        known = ranks[:, at]
        far = np.where(known < 0, top, np.minimum(np.abs(known - np.arange(len(found))), top)).sum(axis=1)
        return langs[int(far.argmin())], 1 - float(far.min()) / (top * len(found))

    @F.arrow_udf("lang string, score double")
    def predicted(texts: pa.Array) -> pa.Array:
        pairs = [predict(x.as_py()) for x in texts]
        give_back()
        return pa.StructArray.from_arrays([pa.array([x[0] for x in pairs], pa.string()), pa.array([x[1] for x in pairs], pa.float64())], ["lang", "score"])

    # Only texts go through Python; the other columns stay where they are.
    found = docs.select(*(F.col(f"`{c}`") for c in keep), predicted(F.col(f"`{text_col}`").cast("string")).alias(unused(docs, "found")))
    last = F.col(found.columns[-1])
    return found.select(*(F.col(f"`{c}`") for c in keep), last["lang"].alias(names[0]), last["score"].alias(names[1]))


def held_out(id_col: str = "doc_id"):
    """Whether a document is kept from learning: crc32 of its id as text, modulo 5, is 0. A null id counts as empty."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 5 == 0


def predict_languages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", top: int = 400, rows_per_lang: int = 4000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row; learnt from the rows that aren't held out."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"), held_out(id_col).alias("held_out"))
    profiles = learn_profiles(rows.filter("not held_out"), top=top, rows_per_lang=rows_per_lang)
    return identify(rows, profiles, keep=("doc_id", "held_out"), top=top)
