"""Language identification: multinomial naive Bayes over hashed character n-grams.

Counts of every training document's n-grams are summed by Spark; the log-probability matrix (languages by BUCKETS
floats) is broadcast in blocks of BLOCK languages at most, and batches are scored in numpy by gathering rows of it. With
more languages than a block holds, documents pass block after block and carry their best language so far along.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import documents, materialize, mix, slices, text_bytes

BUCKETS = 1 << 16
#: n-gram lengths, in characters.
ORDERS = (1, 2, 3)
#: Languages of one broadcast matrix.
BLOCK = 256
SMOOTHING = 0.5
#: Characters that count_and_score takes at once.
STEP_BYTES = 2 << 20
POINTS = 0x110000


def letters_and_folded() -> tuple[np.ndarray, np.ndarray]:
    """For every code point: whether it is a letter, and its lower-case form where that is one character (blank for all that is no letter)."""
    alpha, fold = np.zeros(POINTS, bool), np.full(POINTS, 32, np.uint32)
    for c in range(POINTS):
        if (ch := chr(c)).isalpha():
            alpha[c] = True
            low = ch.lower()
            fold[c] = ord(low) if len(low) == 1 else c
    return alpha, fold


_TABLES: list = []


def grams(raw: np.ndarray, offsets: np.ndarray) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """For each order the buckets of all n-grams and their rows; and whether each row has a letter.

    Anything but letters counts as a blank, runs of blanks as one; a row begins and ends with a blank. n-grams stay
    within a row."""
    if not _TABLES:
        _TABLES.extend(letters_and_folded())
    alpha, fold = _TABLES
    n = len(offsets) - 1
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), np.uint32)
    first = np.cumsum((raw & 0xC0) != 0x80)
    rows = np.searchsorted(np.concatenate([[0], first])[offsets], np.arange(len(points)), "right") - 1
    letter, values = alpha[points], fold[points].astype(np.uint64)
    has = np.zeros(n, bool)
    has[rows[letter]] = True
    keep = np.ones(len(points), bool)
    keep[1:] = (values[1:] != 32) | (values[:-1] != 32) | (rows[1:] != rows[:-1])
    values, rows = values[keep], rows[keep]
    out = []
    for k in ORDERS:
        if len(values) < k:
            out.append((np.zeros(0, np.int64), np.zeros(0, np.int64)))
            continue
        code = np.zeros(len(values) - k + 1, np.uint64)
        for i in range(k):
            code = code * np.uint64(1 << 21) + values[i : len(values) - k + 1 + i]
        same = rows[: len(rows) - k + 1] == rows[k - 1 :]
        bucket = (mix(code + np.uint64(k << 62 & (1 << 64) - 1) + np.uint64(k)) >> np.uint64(48)).astype(np.int64)
        out.append((bucket[same], rows[: len(rows) - k + 1][same]))
    return out, has


def count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of a whole partition's n-grams: lang, bucket, n."""
    sums: dict[str, np.ndarray] = {}
    for batch in batches:
        column, langs = batch.column("text"), np.array(batch.column("lang").to_pylist(), object)
        raw, offsets = text_bytes(column)
        for a, b in slices(np.diff(offsets), STEP_BYTES):
            found, _ = grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
            for lang in set(langs[a:b]):
                of = langs[a:b] == lang
                total = sums.setdefault(lang, np.zeros(BUCKETS, np.int64))
                for bucket, rows in found:
                    total += np.bincount(bucket[of[rows]], minlength=BUCKETS)
    for lang, total in sums.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at.astype(np.int32)), pa.array(total[at])], ["lang", "bucket", "n"])


def languages(train: DataFrame) -> tuple[list[str], dict[str, int]]:
    """The names of all languages in order, and the documents of each: a row for each language comes to the driver."""
    docs = {r["lang"]: r["n"] for r in train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    return sorted(docs), docs


def fit_language(train: DataFrame, block: int = BLOCK) -> Iterator[tuple[list[str], np.ndarray]]:
    """Blocks of languages in order, each with its matrix of log probabilities: the last column is the log prior. train:
    text, lang; rows where one is null don't count. Without languages there is no block."""
    rows = train.select(F.col("text").cast("string").alias("text"), F.col("lang").cast("string").alias("lang")).where("text IS NOT NULL AND lang IS NOT NULL")
    langs, docs = languages(rows)
    counts = rows.mapInArrow(count_grams, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    counts = counts if len(langs) <= block else materialize(counts)
    for i in range(0, len(langs), block):
        names = langs[i : i + block]
        some = counts if len(langs) <= block else counts.where(F.col("lang").between(names[0], names[-1]))
        some = some.toPandas()  # block x buckets rows at most
        table, at = np.zeros((len(names), BUCKETS)), {x: j for j, x in enumerate(names)}
        table[[at[x] for x in some["lang"]], some["bucket"].to_numpy(int)] = some["n"]
        table = np.log(table + SMOOTHING) - np.log(table.sum(1, keepdims=True) + SMOOTHING * BUCKETS)
        prior = np.log(np.array([docs[x] for x in names], float) / sum(docs.values()))
        yield names, np.hstack([table, prior.reshape(-1, 1)]).astype(np.float32)


SCORED = "best double, lang string, low double, mass double, letters boolean"


def _score(docs: DataFrame, names: list[str], matrix: np.ndarray) -> DataFrame:
    """docs with their best language so far (best: its log posterior over the square root of the n-grams' number; the
    first of equals), and the sum of exp(score - low) over languages. Columns doc_id, text and SCORED."""
    held = docs.sparkSession.sparkContext.broadcast((names, np.ascontiguousarray(matrix)))

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, table = held.value
        prior = table[:, -1].astype(float)
        for batch in batches:
            raw, offsets = text_bytes(batch.column("text"))
            best, low, mass = (batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("best", "low", "mass"))
            lang, letters = batch.column("lang").to_pylist(), np.zeros(len(best), bool)
            for a, b in slices(np.diff(offsets), STEP_BYTES):
                found, letters[a:b] = grams(raw[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                total, number = np.zeros((b - a, len(names))), np.zeros(b - a)
                for bucket, rows in found:
                    number += np.bincount(rows, minlength=b - a)
                    for j in range(len(names)):
                        total[:, j] += np.bincount(rows, table[j][bucket], minlength=b - a)
                soft = (total + prior) / np.sqrt(np.maximum(number, 1))[:, None]
                k = np.argmax(soft, 1)
                top = soft[np.arange(b - a), k]
                now = np.maximum(low[a:b], top)
                mass[a:b] = mass[a:b] * np.exp(low[a:b] - now) + np.exp(soft - now[:, None]).sum(1)
                low[a:b] = now
                for i in np.flatnonzero(top > best[a:b]):
                    lang[a + i], best[a + i] = names[k[i]], top[i]
            columns = [pa.array(best), pa.array(lang, pa.string()), pa.array(low), pa.array(mass), pa.array(letters)]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text"), *columns], ["doc_id", "text", "best", "lang", "low", "mass", "letters"])

    return docs.mapInArrow(look, f"doc_id long, text string, {SCORED}")


def predict_language(docs: DataFrame, blocks: Iterator[tuple[list[str], np.ndarray]]) -> DataFrame:
    """For every document: doc_id, lang_pred, score. Null texts and texts without a letter, or a model without
    languages, give `und` and 0; ties go to the language that sorts first; repeated rows are scored each for itself. score
    is the prediction's posterior, from the mean log-probability of an n-gram times the square root of their number, so
    that long texts don't all give 1. An empty table gives no rows."""
    least = F.lit(float(np.finfo(float).min))
    scored = documents(docs).select("doc_id", "text", least.alias("best"), F.lit(None).cast("string").alias("lang"), least.alias("low"), F.lit(0.0).alias("mass"), F.lit(False).alias("letters"))
    done = 0
    for names, matrix in blocks:
        scored = _score(materialize(scored) if done else scored, names, matrix)  # one matrix in a worker at a time
        done += 1
    sure = F.col("letters") & F.col("lang").isNotNull()
    score = F.exp(F.col("best") - F.col("low")) / F.col("mass")
    return scored.select("doc_id", F.when(sure, F.col("lang")).otherwise("und").alias("lang_pred"), F.when(sure, F.least(score, F.lit(1.0))).otherwise(0.0).alias("score"))


def identify_language(docs: DataFrame, block: int = BLOCK) -> DataFrame:
    """Learns from the documents whose crc32(doc_id) mod 4 is not 2, and predicts all: doc_id, held_out, lang_pred, score.
    A document without a doc_id is neither learned from nor held out."""
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2
    blocks = fit_language(docs.where(~held_out).select("text", "lang"), block)
    return predict_language(docs, blocks).select("doc_id", F.coalesce(held_out, F.lit(False)).alias("held_out"), "lang_pred", "score")
