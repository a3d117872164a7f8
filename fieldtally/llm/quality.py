"""Quality rules: counts of a document's words, lines and repeats, and a log-likelihood ratio of hashed n-grams.

The ratio compares two multinomials over hashed words and pairs of neighbouring words: one of trusted documents and one
of the whole corpus. A document's score is the mean ratio of its n-grams, so long and short documents compare; it is kept
when the score reaches a fixed threshold. Everything is DataFrame functions: no Python runs on the executors.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import documents, materialize

#: Hash buckets of the multinomials; the model is one array of so many doubles, whatever the corpus.
BUCKETS = 1 << 16
#: Trusted documents that the target multinomial is fitted on at most (those of the smallest id hashes).
TRUSTED_ROWS = 50_000
#: Mean log ratio from which a document is kept.
THRESHOLD = -0.05
#: Added to a bucket's trusted count and to the count that it would have if trusted documents were like all: buckets
#: that hold little evidence stay near a ratio of 1.
SMOOTHING = 10.0
#: Bits of a position beside a shortened hash in one long.
BITS = 20

BLANKS = " \t\n\x0b\x0c\r"


def words_of(text: Column) -> Column:
    """Runs of anything but blanks, as an array; none for null."""
    bare = F.btrim(F.coalesce(text, F.lit("")), F.lit(BLANKS))
    return F.when(bare == "", F.array().cast("array<string>")).otherwise(F.split(bare, r"[\x20\x09-\x0D]+", -1))


def _buckets(words: Column) -> Column:
    """The buckets of all words, then of all pairs of neighbours."""
    pairs = F.zip_with(F.slice(words, F.lit(1), F.greatest(F.size(words) - 1, F.lit(0))), F.slice(words, F.lit(2), F.size(words)), lambda v, w: F.pmod(F.hash(v, w), F.lit(BUCKETS)))
    return F.concat(F.transform(words, lambda w: F.pmod(F.hash(w), F.lit(BUCKETS))), pairs)


def _windows(words: Column) -> Column:
    """Hashes of the three-word windows; no window for fewer words."""
    return F.when(F.size(words) > 2, F.transform(F.slice(words, F.lit(1), F.size(words) - 2), lambda w, i: F.xxhash64(w, F.get(words, i + 1), F.get(words, i + 2)))).otherwise(F.array().cast("array<bigint>"))


def _covered(starts: Column) -> Column:
    """Words in windows of three that begin at the sorted starts."""
    return F.aggregate(starts, F.struct(F.lit(0).cast("long").alias("n"), F.lit(-3).cast("long").alias("end")), lambda s, p: F.struct((s["n"] + F.least(F.lit(3), p + 3 - s["end"])).cast("long").alias("n"), (p + 3).cast("long").alias("end")), lambda s: s["n"])


def _neighbours_agree(xs: Column, same) -> Column:
    """The elements of a sorted array that equal the one before or after."""
    return F.filter(xs, lambda x, i: F.coalesce(same(x, F.get(xs, i + 1)) | same(x, F.get(xs, i - 1)), F.lit(False)))


def with_repeated_words(df: DataFrame, bits: int = BITS) -> DataFrame:
    """Adds n_repeat_words: words in windows that occur twice or more. Drops windows.

    Windows are sorted with their positions, a shortened hash and a position in one long. Documents where shortened
    hashes collide, or too long for them, sort hash and position apart. Each array is a column of its own, as a lambda
    would otherwise make it again for every element.
    """
    rest = [c for c in df.columns if c != "windows"]
    none, at, high = F.array().cast("array<bigint>"), lambda x: x.bitwiseAND(F.lit((1 << bits) - 1)).cast("int"), lambda x: F.shiftright(x, bits)
    same = lambda x, y: F.coalesce(high(x) == high(y), F.lit(False))
    repeats = F.size(F.array_distinct("windows")) < F.size("windows")
    packed = F.when(repeats, F.sort_array(F.transform("windows", lambda h, i: h.bitwiseAND(F.lit(-1 << bits)).bitwiseOR(i.cast("long"))))).otherwise(none)
    df = df.select(*rest, "windows", packed.alias("packed"))
    clash = F.exists(F.sequence(F.lit(0), F.size("packed") - 1), lambda i: same(F.get("packed", i), F.get("packed", i + 1)) & (F.get("windows", at(F.get("packed", i))) != F.get("windows", at(F.get("packed", i + 1)))))
    hard = (F.size("packed") > 0) & ((F.size("packed") > 1 << bits) | clash)
    df = df.select(*rest, "packed", F.when(hard, F.sort_array(F.transform("windows", lambda h, i: F.struct(h.alias("h"), i.cast("long").alias("p"))))).alias("pairs"))
    exact = F.transform(_neighbours_agree(F.col("pairs"), lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))), lambda x: x["p"])
    usual = F.transform(_neighbours_agree(F.col("packed"), same), lambda x: at(x).cast("long"))
    df = df.select(*rest, F.sort_array(F.when(F.col("pairs").isNotNull(), exact).otherwise(usual)).alias("starts"))
    return df.select(*rest, _covered(F.col("starts")).alias("n_repeat_words"))


def log_ratios(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row with an array of BUCKETS log ratios, trusted against all. Counts cover every document; the trusted side
    is the documents of quality 1, at most TRUSTED_ROWS of them, so that their ids can be broadcast. No trusted
    documents: all ratios are 0, and every document that passes the base rules is kept."""
    trusted = labels.where(F.col("quality") == 1).select(F.col("doc_id").cast("long").alias("doc_id")).distinct()
    trusted = trusted.orderBy(F.xxhash64("doc_id"), "doc_id").limit(TRUSTED_ROWS).withColumn("trusted", F.lit(1))
    each = documents(docs).join(F.broadcast(trusted), "doc_id", "left").select(F.coalesce("trusted", F.lit(0)).alias("trusted"), words_of(F.col("text")).alias("words"))
    counts = each.select("trusted", F.explode(_buckets(F.col("words"))).alias("bucket")).groupBy("bucket").agg(F.sum("trusted").alias("t"), F.count(F.lit(1)).alias("r"))
    every = docs.sparkSession.range(BUCKETS).select(F.col("id").cast("int").alias("bucket"))
    dense = every.join(counts, "bucket", "left").select("bucket", F.coalesce("t", F.lit(0)).alias("t"), F.coalesce("r", F.lit(0)).alias("r"))
    expected = lambda x: x["r"] * F.col("nt") / F.greatest(F.col("nr"), F.lit(1))
    return (
        dense.agg(F.sum("t").alias("nt"), F.sum("r").alias("nr"), F.sort_array(F.collect_list(F.struct("bucket", "t", "r"))).alias("all"))
        .select(F.transform("all", lambda x: F.when(F.col("nt") == 0, F.lit(0.0)).otherwise(F.log((x["t"] + SMOOTHING) / (expected(x) + SMOOTHING)))).alias("ratios"))
    )


def score_quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """For every document: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, score.

    Null and empty texts have no words, a score of 0, and fail the base rules. Repeated rows are scored each for itself.
    Labels' rows of null doc_id or quality don't count. An empty table gives no rows. The result is written to the
    shared folder: a filter pushed into the scoring would work out its arrays inside their own lambdas.
    """
    # BUCKETS numbers come to the driver, and go out as a constant that the optimiser folds.
    model = ",".join(f"{x:.6f}" for x in log_ratios(docs, labels).first()["ratios"])
    ratios = F.split(F.lit(model), ",").cast("array<double>")
    text = F.coalesce(F.col("text"), F.lit(""))
    lines = F.filter(F.split(text, "\n", -1), lambda x: F.length(F.translate(x, BLANKS, "")) > 0)
    with_words = documents(docs).select("doc_id", text.alias("text"), words_of(F.col("text")).alias("words"), lines.alias("lines"))
    counted = with_words.select(
        "doc_id",
        F.size("words").cast("long").alias("n_words"),
        F.length(F.translate("text", BLANKS, "")).cast("long").alias("word_chars"),
        (F.length("text") - F.length(F.translate("text", "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        (F.size("lines") - F.size(F.array_distinct("lines"))).cast("long").alias("n_dup_lines"),
        _windows(F.col("words")).alias("windows"),
        F.aggregate(_buckets(F.col("words")), F.lit(0.0), lambda s, b: s + F.get(ratios, b)).alias("total"),
    )
    counted = with_repeated_words(counted)
    rated = counted.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words",
        F.when(F.col("n_words") > 0, F.col("total") / (2 * F.col("n_words") - 1)).otherwise(0.0).alias("score"),
    )
    failed = (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return materialize(rated.withColumn("base_failed", failed).withColumn("kept", ~failed & (F.col("score") >= threshold)))


def keep_good(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """The documents that score_quality keeps, with their own columns. Rows whose doc_id is null are dropped."""
    kept = score_quality(docs, labels, threshold).where("kept").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").select(docs.columns)
