"""License scans: ordered signature rules over a text's words, gated by keywords.

A rule is a keyword, a regex over the lower-cased words joined by single blanks, a label, and a priority. Only texts
that hold some rule's keyword are scanned, each only by the rules whose keyword it holds. Of overlapping detections,
one that lies inside another of the same or a better priority is suppressed. Everything is DataFrame functions: each
rule is a constant expression, and a document's detections stay in its own row, so nothing is shuffled.

A rule's places come from one pass: its matches are set between two control characters, which no word holds, and the
words that begin or end with one are where matches begin and end.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import documents
from fieldtally.llm.license_rules import SIGNATURES

#: Phrases that count as base places, and their labels.
BASE = [("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl")]

#: How sure a detection of each priority is.
CONFIDENCE = {1: 1.0, 2: 0.9, 3: 0.7, 4: 0.6}
NOT_WORDS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
PRIORITIES = (1, 2, 3, 4)
#: Words too common to gate by, where a keyword has another.
COMMON = frozenset("common developed development free general network open project public service software source standard style terms version young".split())
BEGIN, END = "\x01", "\x02"
#: Detections that are folded together; results of so many are copied at a step, not those of a whole text.
TOGETHER = 128
PLACES = "array<struct<start:int,neg_end:int,rank:int,label:string>>"


def rules() -> list[tuple[str, str, str, int]]:
    """(keyword, regex, label, priority), the best priority first."""
    fields = [line.split(" :: ") for line in SIGNATURES.strip().split("\n")]
    return sorted(((word, regex, label, int(rank)) for rank, label, word, regex in fields), key=lambda x: x[3])


def gates() -> list[str]:
    """A word of each keyword and each base phrase, the longest that is not common: a text that holds none of them is not
    scanned."""
    return sorted({gate(word) for word in [*(x[0] for x in rules()), *(x[0] for x in BASE)]})


def gate(keyword: str) -> str:
    return max(keyword.split(), key=lambda w: (w not in COMMON, len(w)))


def _marked(line: Column, regex: str, label: str, rank: int) -> Column:
    """A matching rule with the line's blanks and the marks of its matches: what else the words hold is left out. Null
    where the regex doesn't match."""
    pattern = F.lit(f" ((?:{regex}))(?= )")
    marks = F.regexp_replace(F.regexp_replace(line, pattern, F.lit(f" {BEGIN}$1{END}")), F.lit(f"[^ {BEGIN}{END}]+"), F.lit(""))
    return F.when(F.rlike(line, pattern), F.struct(F.lit(rank).alias("rank"), F.lit(label).alias("label"), marks.alias("marks")))


def _places(rule: Column) -> Column:
    """A marked rule's matches, as structs of word positions."""

    def of(words: Column) -> Column:
        starts = F.filter(F.transform(words, lambda w, i: F.when(F.startswith(w, F.lit(BEGIN)), i)), lambda i: i.isNotNull())
        ends = F.filter(F.transform(words, lambda w, i: F.when(F.endswith(w, F.lit(END)), i)), lambda i: i.isNotNull())
        return F.zip_with(starts, ends, lambda a, b: F.struct((a - 1).alias("start"), (-b).alias("neg_end"), rule["rank"].alias("rank"), rule["label"].alias("label")))

    return F.transform(F.array(F.split(rule["marks"], " ", -1)), of)[0]


def _matching(found: list[Column]) -> Column:
    return F.filter(F.array(*found), lambda x: x.isNotNull())


def _kept(found: Column) -> Column:
    """The detections that lie inside no other of the same or a better priority. Sorted by start, then the longest: what
    holds a detection stands before it, so the farthest ends so far decide. These are first taken over groups of
    detections, so that the fold over each group knows what came before it."""
    farthest = lambda xs, p: F.coalesce(F.array_max(F.transform(F.filter(xs, lambda x: x["rank"] == p), lambda x: -x["neg_end"])), F.lit(0)).alias(f"e{p}")
    more = lambda s, x, p: F.when(x["rank"] == p, F.greatest(s[f"e{p}"], -x["neg_end"])).otherwise(s[f"e{p}"]).alias(f"e{p}")
    inside = lambda s, x: (-x["neg_end"]) <= F.greatest(*[F.when(F.lit(p) <= x["rank"], s[f"e{p}"]).otherwise(0) for p in PRIORITIES])
    ends = ",".join(f"e{p}:int" for p in PRIORITIES)

    def of(xs: Column) -> Column:
        groups = F.transform(F.sequence(F.lit(0), F.call_function("div", F.size(xs) - 1, F.lit(TOGETHER)).cast("int")), lambda k: F.slice(xs, k * TOGETHER + 1, F.lit(TOGETHER)))
        start = F.struct(F.array().cast(f"array<struct<{ends}>>").alias("out"), *[F.lit(0).alias(f"e{p}") for p in PRIORITIES])
        before = F.aggregate(
            F.transform(groups, lambda g: F.struct(*[farthest(g, p) for p in PRIORITIES])),
            start,
            lambda s, g: F.struct(F.concat(s["out"], F.array(F.struct(*[s[f"e{p}"].alias(f"e{p}") for p in PRIORITIES]))).alias("out"), *[F.greatest(s[f"e{p}"], g[f"e{p}"]).alias(f"e{p}") for p in PRIORITIES]),
            lambda s: s["out"],
        )
        fold = lambda g, e: F.aggregate(
            g,
            F.struct(F.array().cast(PLACES).alias("kept"), *[e[f"e{p}"].alias(f"e{p}") for p in PRIORITIES]),
            lambda s, x: F.struct(F.when(inside(s, x), s["kept"]).otherwise(F.concat(s["kept"], F.array(x))).alias("kept"), *[more(s, x, p) for p in PRIORITIES]),
            lambda s: s["kept"],
        )
        return F.flatten(F.zip_with(groups, before, fold))

    return F.when(F.size(found) > 0, F.transform(F.array(F.sort_array(found)), of)[0]).otherwise(F.array().cast(PLACES))


def scan_licenses(docs: DataFrame) -> DataFrame:
    """For every document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, detections.

    detections are the rules' surviving matches (label, priority, first word and the one behind the last). score is the
    best confidence among base places and detections, 0 where there are none. Null and empty texts have no words. Repeated
    rows are scanned each for itself. An empty table gives no rows.
    """
    text = F.coalesce("text", F.lit(""))
    # Lower-casing more than A-Z changes no word's bounds and lets no keyword slip, so the count of words and the quick
    # gate may do it; texts that pass are lower-cased and joined exactly.
    parts = documents(docs).select("doc_id", text.alias("text")).select("doc_id", "text", F.split(F.lower("text"), NOT_WORDS, -1).alias("parts"))
    scanned = F.arrays_overlap("parts", F.array(*[F.lit(x) for x in gates()]))
    exact = F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    gated = parts.select(
        "doc_id",
        (F.size("parts") - (F.element_at("parts", 1) == "").cast("int") - ((F.size("parts") > 1) & (F.element_at("parts", -1) == "")).cast("int")).cast("long").alias("n_words"),
        F.when(scanned, F.concat(F.lit(" "), F.btrim(F.array_join(F.split(exact, NOT_WORDS, -1), " ")), F.lit(" "))).alias("line"),
    )
    line, by_word = F.col("line"), {}
    for word, regex, label, rank in rules():
        by_word.setdefault(word, []).append(_marked(line, regex, label, rank))
    found = F.flatten(_matching([F.when(F.contains(line, F.lit(word)), F.array(*of_word)) for word, of_word in by_word.items()]))
    base = _matching([F.when(F.contains(line, F.lit(phrase)), _marked(line, phrase, label, 0)) for phrase, label in BASE])
    places = lambda xs: F.flatten(F.transform(F.filter(xs, lambda x: x.isNotNull()), _places))
    seen = gated.select("doc_id", "n_words", places(found).alias("found"), places(base).alias("base"))
    out = seen.select("doc_id", "n_words", "base", F.transform("base", lambda x: x["start"].cast("long")).alias("starts"), _kept(F.col("found")).alias("kept"))
    labels = lambda xs: F.array_join(F.array_sort(F.array_distinct(xs)), ",")
    best = F.array_min(F.transform("kept", lambda x: x["rank"]))
    sure = F.greatest(F.when(F.size("base") > 0, F.lit(CONFIDENCE[3])).otherwise(0.0), *[F.when(best == p, F.lit(CONFIDENCE[p])).otherwise(0.0) for p in PRIORITIES])
    return out.select(
        "doc_id",
        "n_words",
        F.size("base").cast("long").alias("n_base"),
        F.array_min("starts").alias("first_word"),
        F.array_max("starts").alias("last_word"),
        labels(F.transform("base", lambda x: x["label"])).alias("base_labels"),
        labels(F.concat(F.transform("base", lambda x: x["label"]), F.transform("kept", lambda x: x["label"]))).alias("labels"),
        sure.alias("score"),
        F.transform("kept", lambda x: F.struct(x["label"].alias("label"), x["rank"].alias("priority"), x["start"].alias("first_word"), (-x["neg_end"]).alias("end_word"))).alias("detections"),
    )
