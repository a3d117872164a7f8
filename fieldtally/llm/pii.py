"""PII: personal data by pattern, and terms that give it away by their company.

Patterns find emails, IP addresses, card and phone numbers. Those values are the protected entities. Masking them is
not enough where a rare term keeps an entity's company: over all distinct texts, with df(x) the texts that hold x,

    disclosure(t, e) = PMI(t; e) / IC(e),   PMI(t; e) = log(df(t, e) N / (df(t) df(e))),   IC(e) = log(N / df(e)),

is 1 for a term that occurs with e only and 0 for one that doesn't care. Terms are the runs of letters of a text outside
its patterns' matches, at any distance from the entity. Those of GENERALISE and more are replaced by a class label and those of REMOVE and more are removed, in every text that
holds them, for a term gives its entity away where that isn't named; terms of fewer than SUPPORT common texts tell
nothing and stay (a parameter: with 1, every word that stands in one text only would disclose its entity).
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fieldtally.llm.common import documents, is_small, materialize
from fieldtally.llm.repeats import merge

SUPPORT = 3
GENERALISE = 0.95
REMOVE = 0.99
#: Documents that hold a disclosing term up to which their terms are broadcast.
BROADCAST_TERMS = 100_000

KINDS = ("email", "ip", "card", "phone")
#: The patterns. A run of digits is taken whole, and an email's name is found from its @ backwards, so that
#: no text makes them slow.
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
NAME_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
TERM = re.compile(r"[^\W\d_]+")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = int(c) * (1 + i % 2)
        total += d - 9 * (d > 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in NAME_CHARS:
            start -= 1
        found = DOMAIN.match(text, at + 1) if start < at else None
        if found:
            end = found.end()
            out.append((start, end))
        at = text.find("@", max(at + 1, end))
    return out


def ips(text: str) -> list[tuple[int, int]]:
    """Four numbers with dots between. After a match the search goes on behind it, so a fifth number begins anew."""
    out, at = [], 0
    while found := IP.search(text, at):
        at = found.end()
        parts = [x.lstrip("0") or "0" for x in found[0].split(".")]
        if all(len(x) <= 3 and int(x) <= 255 for x in parts):
            out.append(found.span())
    return out


def cards(text: str) -> list[tuple[int, int]]:
    out = []
    for found in CARD.finditer(text):
        if 16 <= len(digits := re.sub("[^0-9]", "", found[0])) <= 19 and luhn(digits):
            out.append(found.span())
    return out


def phones(text: str) -> list[tuple[int, int]]:
    return [x.span() for x in PHONE.finditer(text) if "+" in text and 8 <= sum(c.isdigit() for c in x[0]) <= 15] if "+" in text else []


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in characters, by kind as listed, then start."""
    return [(kind, a, b) for kind, find in zip(KINDS, (emails, ips, cards, phones), strict=True) for a, b in find(text)]


def entity(kind: str, value: str) -> str:
    """The same for all spellings of one value."""
    return f"{kind}:{value.lower() if kind in ('email', 'ip') else re.sub('[^0-9]', '', value)}"


def free_terms(text: str, spans: list[tuple[str, int, int]]) -> Iterator[re.Match]:
    """The terms outside all spans, in order."""
    taken = merge([(a, b) for _, a, b in spans])
    at = 0
    for found in TERM.finditer(text):
        while at < len(taken) and taken[at][1] <= found.start():
            at += 1
        if at == len(taken) or found.end() <= taken[at][0]:
            yield found


def text_terms(text: str) -> set[str]:
    """The distinct terms of a text, in lower case."""
    got = base_spans(text)
    return {w.lower() for w in (TERM.findall(text) if not got else (x[0] for x in free_terms(text, got)))}


def found_spans(docs: DataFrame) -> DataFrame:
    """doc_id, key (of the text), spans and entities of every document."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            spans, entities = [], []
            for text in batch.column("text"):
                text = text.as_py() or ""
                got = base_spans(text)
                spans.append([{"kind": k, "start": a, "end": b} for k, a, b in got])
                entities.append(sorted({entity(k, text[a:b]) for k, a, b in got}))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(spans, kind), pa.array(entities, pa.list_(pa.string()))], ["doc_id", "key", "spans", "entities"])

    kinds = "doc_id long, key long, spans array<struct<kind:string,start:long,end:long>>, entities array<string>"
    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(find, kinds)


def all_terms(docs: DataFrame) -> DataFrame:
    """doc_id, key and the distinct terms of every document, in lower case."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms = []
            for text in batch.column("text"):
                text = text.as_py() or ""
                terms.append(list(text_terms(text)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(terms, pa.list_(pa.string()))], ["doc_id", "key", "terms"])

    return docs.select("doc_id", "text", F.xxhash64("text").alias("key")).mapInArrow(find, "doc_id long, key long, terms array<string>")


def term_rows(docs: DataFrame, found: DataFrame, support: int) -> tuple[DataFrame, DataFrame] | None:
    """(entity, term, disclosure) of GENERALISE and more, and (key, term) of the texts that hold such a term or one that
    came near; None if there are no candidates. Counts are of distinct texts, so that copies are one."""
    total = found.agg(F.count_distinct("key").alias("n")).first()["n"]
    if not total:
        return None
    texts = found.where(F.size("entities") > 0).select("key", F.explode("entities").alias("entity")).distinct()
    df_e = materialize(texts.groupBy("entity").agg(F.count(F.lit(1)).alias("de")).where(F.col("de") >= support))

    def disclosure(both: Column, dt: Column) -> Column:
        ic = F.log(F.lit(float(total)) / F.col("de"))
        pmi = F.log(both * float(total) / (F.greatest(dt, both) * F.col("de")))
        return F.when(ic > 0, pmi / ic).otherwise(0.0)

    few = is_small(df_e)
    holders = materialize(texts.join(F.broadcast(df_e) if few else df_e, "entity").groupBy("key").agg(F.collect_list(F.struct("entity", "de")).alias("held")))
    if holders.isEmpty():
        return None
    keyed, keys = docs.withColumn("_key", F.xxhash64("text")), holders.select(F.col("key").alias("_key"))
    beside = all_terms(keyed.join(F.broadcast(keys) if is_small(keys) else keys, "_key", "left_semi")).select("key", "terms").dropDuplicates(["key"])
    beside = materialize(beside.join(holders, "key"))  # dealt by key already: only the holders move
    # dn, the entities' texts that hold a term, is at least `both` and at most dt, and de is at least `both`. By these
    # bounds common words are out before they are paired, and more of them before the corpus is searched for the rest.
    most = df_e.select(F.max("de").alias("de"))
    dn = beside.select(F.explode("terms").alias("term")).groupBy("term").agg(F.count(F.lit(1)).alias("dn")).where(F.col("dn") >= support)
    reach = lambda de: F.pow(de.cast("double"), GENERALISE) * F.pow(F.lit(float(total)), 1 - GENERALISE) * (1 + 1e-9)
    dn = materialize(dn.crossJoin(F.broadcast(most)).where(F.col("dn") <= reach(F.col("de"))).select("term", "dn"))
    few = is_small(dn)
    rare = beside.select("key", "held", F.explode("terms").alias("term"))
    rare = rare.join(F.broadcast(dn), "term") if few else rare.drop("held").join(dn, "term").join(holders, "key")
    rare = rare.select("term", "dn", F.explode(F.filter("held", lambda x: F.col("dn") <= reach(x["de"]))).alias("x"))
    both = rare.groupBy("x.entity", "x.de", "term", "dn").agg(F.count(F.lit(1)).alias("both")).where(F.col("both") >= support)
    pairs = materialize(both.where(disclosure(F.col("both"), F.col("dn")) >= GENERALISE).select("entity", "term", "both", "de"))
    terms = materialize(pairs.select("term").distinct())
    if terms.isEmpty():
        return None
    held = holders_of(docs, terms) if is_small(terms) else materialize(all_terms(docs).select("key", F.explode("terms").alias("term")).join(terms, "term").select("key", "term").distinct())
    df_t = held.groupBy("term").agg(F.count(F.lit(1)).alias("dt"))
    return pairs.join(df_t, "term").select("entity", "term", disclosure(F.col("both"), F.col("dt")).alias("disclosure")).where(F.col("disclosure") >= GENERALISE), held


def holders_of(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(key, term) of the texts that hold one of a few terms: tasks look for all of them, and what is shuffled, to take
    copies for one, is a row of their numbers for each text. terms: one column, written and small."""
    spark = docs.sparkSession
    numbers = {r["term"]: i for i, r in enumerate(terms.orderBy("term").collect())}
    wanted = spark.sparkContext.broadcast(numbers)

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, lists = [], []
            for key, text in zip(batch.column("key").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if mine := sorted(wanted.value[w] for w in text_terms(text or "") if w in wanted.value):
                    keys.append(key)
                    lists.append(mine)
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(lists, pa.list_(pa.int32()))], ["key", "numbers"])

    found = docs.select("text", F.xxhash64("text").alias("key")).mapInArrow(find, "key long, numbers array<int>")
    once = materialize(found.dropDuplicates(["key"]))
    names = spark.createDataFrame([(i, term) for term, i in numbers.items()], "number int, term string")
    return once.select("key", F.explode("numbers").alias("number")).join(F.broadcast(names), "number").select("key", "term")


def known_terms(docs: DataFrame, found: DataFrame, support: int = SUPPORT) -> DataFrame:
    """key, known: the disclosing terms of each text that holds one, beside their entity or without it, with whether to
    drop them (by the entity that they disclose most)."""
    rows = term_rows(docs, found, support)
    if rows is None:
        return docs.sparkSession.createDataFrame([], "key long, known array<struct<term:string,drop:boolean>>")
    terms, held = rows
    worst = materialize(terms.groupBy("term").agg((F.max("disclosure") >= REMOVE).alias("drop")))
    few = is_small(worst)
    of_text = held.join(F.broadcast(worst) if few else worst, "term")
    return materialize(of_text.groupBy("key").agg(F.collect_set(F.struct("term", "drop")).alias("known")))


def term_places(text: str, known: list[dict], spans: list[tuple[str, int, int]]) -> list[tuple[str, int, int]]:
    """(kind, start, end) of known terms outside the spans: `term` to generalise, then `drop` to remove, by start."""
    worst: dict[str, bool] = {}
    for x in known:
        worst[x["term"]] = worst.get(x["term"], False) or x["drop"]
    hit = [("drop" if worst[w] else "term", m.start(), m.end()) for m in free_terms(text, spans) if (w := m[0].lower()) in worst]
    return sorted(hit, key=lambda x: (x[0] != "term", x[1]))


def find_personal_data(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """For every document: doc_id, key, base (the patterns' spans) and spans as arrays of (kind, start, end): base kinds
    first, then `term` (generalised) and `drop` (removed), each by start; the term spans overlap no base span.

    A null text is empty and an empty table gives no rows. Rows of equal doc_id and text are one document and give equal
    results; a null doc_id is an id like any other."""
    docs = documents(docs).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    found = materialize(found_spans(docs))
    of_text = known_terms(docs, found, support).select(F.col("key").alias("_key"), "known")

    def places(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))
        for batch in batches:
            out = []
            for text, known in zip(batch.column("text").to_pylist(), batch.column("known").to_pylist(), strict=True):
                out.append([{"kind": k, "start": a, "end": b} for k, a, b in term_places(text, known, base_spans(text))])
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(out, kind)], ["doc_id", "key", "more"])

    of_text = F.broadcast(of_text) if is_small(of_text, BROADCAST_TERMS) else of_text
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("key"))
    touched = keyed.join(of_text, F.col("key") == F.col("_key")).select("doc_id", "key", "text", "known")
    more = touched.mapInArrow(places, "doc_id long, key long, more array<struct<kind:string,start:long,end:long>>").dropDuplicates(["doc_id", "key"])
    more = more.select(F.col("doc_id").alias("_id"), F.col("key").alias("_key"), "more")
    joined = found.join(more, found["doc_id"].eqNullSafe(F.col("_id")) & (found["key"] == F.col("_key")), "left")
    return joined.select("doc_id", "key", F.col("spans").alias("base"), F.when(F.col("more").isNull(), F.col("spans")).otherwise(F.concat("spans", "more")).alias("spans"))


def span_report(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans (kind:start:end, comma-joined), n_terms."""
    found = find_personal_data(docs, support)
    line = lambda xs: F.array_join(F.transform(xs, lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select("doc_id", *[count(k) for k in KINDS], F.sha2(line("base").cast("binary"), 256).alias("base_sha256"), line("spans").alias("spans"), (F.size("spans") - F.size("base")).cast("long").alias("n_terms"))


def masked(text: str, known: list[dict]) -> str:
    spans, rest, at = base_spans(text), [], 0
    for a, b, kind in sorted((a, -b, kind) for kind, a, b in spans + term_places(text, known, spans)):
        if a >= at:
            rest += [text[at:a], "" if kind == "drop" else f"[{kind.upper()}]"]
        at = max(at, -b)
    return "".join([*rest, text[at:]])


def sanitise(docs: DataFrame, support: int = SUPPORT) -> DataFrame:
    """The documents with their own columns, personal data and generalised terms as [KIND], removed terms gone. A null
    text stays null. Only the few documents that hold a disclosing term are looked up; patterns need no join."""
    texts = documents(docs).where("text IS NOT NULL")
    known = known_terms(texts, materialize(found_spans(texts)), support).select(F.col("key").alias("known_key"), F.col("known").alias("known_terms"))
    known = F.broadcast(known) if is_small(known, BROADCAST_TERMS) else known
    kinds, names = docs.schema, docs.columns
    joined = docs.join(known, F.xxhash64(docs["text"]) == F.col("known_key"), "left")

    def mask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if x is None else masked(x, k or []) for x, k in zip(batch.column("text").to_pylist(), batch.column("known_terms").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(texts, pa.string()) if n == "text" else batch.column(n) for n in names], names)

    return joined.select(*[docs[c] for c in names], "known_terms").mapInArrow(mask, kinds)
