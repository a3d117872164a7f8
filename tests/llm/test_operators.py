"""Each training-data operator against a brute-force version, on generated and awkward texts."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from fieldtally.llm import chunks, components, decontamination, jaccard, language, licenses, packing, pii, quality, repeats, tokens

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
BLANK = "[\x20\x09-\x0d]+"
LOWER = {i: i + 32 for i in range(65, 91)}


def word(rng):
    return "".join(rng.choice(["an", "re", "ti", "ou", "th", "é", "ing"]) for _ in range(rng.randint(1, 4)))


def prose(rng, n):
    return " ".join(word(rng).capitalize() + rng.choice(["", "", ".", ",\n"]) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    """Documents with copies, near copies, shared passages, nulls, empty, long and repeated rows."""
    rng = random.Random(7)
    passage, long = prose(rng, 60), prose(rng, 9000)
    texts = [prose(rng, rng.randint(5, 300)) for _ in range(40)]
    texts += [texts[0]] * 4 + [texts[1] + " one more", "first " + texts[1]] + [prose(rng, 30) + " " + passage + " " + prose(rng, 30) for _ in range(4)]
    near = prose(rng, 200).split(" ")
    for i in range(6):
        copy = list(near)
        copy[rng.randrange(len(copy))] = f"x{i}"
        texts.append(" ".join(copy))
    texts += [long, long[:20000] + "x" + long[20000:], "ab " * 400, "a" * 5000, None, "", " \n\t", "one", "one two three", "x | y | z\n" * 30, "12345 67", "日本語 テキスト " * 30]
    out = [(i, t, rng.choice(["en", "fr"]), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return out + [out[3], out[60]]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, COLUMNS).repartition(3)


@pytest.fixture(scope="module")
def labels(spark, rows):
    return spark.createDataFrame([(r[0], 1 if r[0] % 2 else 0, 0) for r in rows if r[0] < 30] + [(None, 1, 0)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], COLUMNS)


def words_of(text):
    return [w for w in re.split(BLANK, text or "") if w]


def test_quality_counts(docs, rows, labels, empty):
    found = {r["doc_id"]: r for r in quality.score_quality(docs, labels).collect()}
    assert len(found) == len({r[0] for r in rows})
    for doc_id, text, *_ in rows:
        words, r = words_of(text), found[doc_id]
        windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
        times = Counter(windows)
        covered = {i + j for i, w in enumerate(windows) if times[w] > 1 for j in range(3)}
        lines = [x for x in (text or "").split("\n") if words_of(x)]
        assert (r["n_words"], r["word_chars"], r["n_dup_lines"]) == (len(words), sum(map(len, words)), len(lines) - len(set(lines)))
        assert r["n_symbols"] == sum(c in "#*$%&|<>" for c in text or "")
        assert r["n_repeat_words"] == len(covered)
        assert r["base_failed"] == (len(words) < 50 or 100 * r["n_repeat_words"] > 50 * len(words))
        assert not (r["kept"] and r["base_failed"])
    assert quality.score_quality(empty, labels).count() == 0
    assert all(r["score"] == 0 for r in quality.score_quality(docs, labels.limit(0)).collect())


def test_quality_tells_junk_from_prose(spark):
    rng = random.Random(1)
    good = [(i, prose(rng, 120)) for i in range(60)]
    junk = [(100 + i, " | ".join(word(rng) + rng.choice(["###", "$$$"]) for _ in range(80))) for i in range(10)]
    table = spark.createDataFrame(good + junk, "doc_id long, text string")
    kept = {r["doc_id"] for r in quality.keep_good(table, spark.createDataFrame([(i, 1) for i in range(40)], "doc_id long, quality int")).collect()}
    assert kept == {i for i, _ in good}


def test_quality_scores_match_a_plain_version(spark, docs, rows, labels):
    """Score and verdict of every document from n-gram counts by hand; only the hash is Spark's."""
    trusted = {r["doc_id"] for r in labels.collect() if r["quality"] == 1}
    grams = {i: [(w,) for w in ws] + list(zip(ws, ws[1:], strict=False)) for i, (_, t, *_) in enumerate(rows) for ws in [words_of(t)]}
    every = sorted({g for x in grams.values() for g in x})
    table = spark.createDataFrame([(k, *g, *[None] * (2 - len(g))) for k, g in enumerate(every)], "k long, a string, b string")
    bucket = {every[r["k"]]: r["h"] for r in table.selectExpr("k", f"pmod(IF(b IS NULL, hash(a), hash(a, b)), {quality.BUCKETS}) AS h").collect()}
    raw = Counter(bucket[g] for x in grams.values() for g in x)
    good = Counter(bucket[g] for i, x in grams.items() if rows[i][0] in trusted for g in x)
    share = good.total() / raw.total()
    found = {r["doc_id"]: r for r in quality.score_quality(docs, labels).where("score > -1e9").collect()}
    for i, x in grams.items():
        ratios = [math.log((good[bucket[g]] + quality.SMOOTHING) / (raw[bucket[g]] * share + quality.SMOOTHING)) for g in x]
        r, score = found[rows[i][0]], sum(ratios) / len(ratios) if ratios else 0
        assert abs(r["score"] - score) < 1e-5 and r["kept"] == (not r["base_failed"] and r["score"] >= quality.THRESHOLD)


@pytest.mark.parametrize("bits", [2, 5, 20, 60])
def test_long_windows_take_the_exact_path(spark, bits):
    """Few bits for positions send a text the way of long texts, many the way of colliding hashes."""
    text = " ".join(["a", "b", "c"] * 20 + [f"w{i}" for i in range(60)] + ["q", "r", "s", "x", "q", "r", "s"])
    words = text.split()
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    expected = len({i + j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(3)})
    table = spark.createDataFrame([(1, words)], "doc_id long, words array<string>").select("doc_id", quality._windows(F.col("words")).alias("windows"))
    assert quality.with_repeated_words(table, bits).first()["n_repeat_words"] == expected


def reference_spans(text):
    out = []
    for kind, pattern in (("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"), ("card", r"[0-9]([\x20-]?[0-9])+"), ("phone", r"\+[0-9][\x20().0-9-]+[0-9]")):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m[0])
            if {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m[0].split(".")), "card": lambda: 16 <= len(d) <= 19 and pii.luhn(d), "phone": lambda: 8 <= len(d) <= 15}[kind]():
                out.append((kind, m.start(), m.end()))
    return out


def test_pii_patterns():
    rng = random.Random(2)
    for alphabet, n in (("a1.@+-% ()29_é", 8000), ("45 -", 3000), ("1.2", 2000)):
        for _ in range(n):
            text = "".join(rng.choice(alphabet) for _ in range(rng.randint(0, 50)))
            assert pii.base_spans(text) == reference_spans(text), text
    assert pii.base_spans("a" * 200_000 + "1" * 200_000) == []
    assert pii.base_spans("0" * 5000 + "1.1.1.1 " + "9" * 5000 + ".1.1.1") == [("ip", 0, 5007)]
    assert len(pii.base_spans("jo@x.example.com or " * 20_000)) == 20_000


def test_pii_disclosure_matches_a_plain_version(spark):
    """Disclosure counted over whole distinct texts by hand, for every pair of an entity and a term."""
    rng = random.Random(33)
    mails, terms = [f"m{i}@x.example.com" for i in range(4)], ["Quell", "Zorro", "vim", "ok", "Élan"]
    texts = []
    for i in range(300):
        who = rng.randrange(12)
        beside = [terms[who]] * (rng.random() < 0.95) if who < 4 else [rng.choice(terms)] * (rng.random() < 0.01)
        texts.append(" ".join(["and", *(["mail " + mails[who]] if who < 4 else []), *beside, *(str(rng.randrange(9)) for _ in range(8)), prose(rng, 5)]))
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[0]), (5, texts[5]), (400, None), (401, "")]
    distinct = {t or "" for _, t in rows}
    words = {t: {m[0].lower() for m in pii.free_terms(t, pii.base_spans(t))} for t in distinct}
    held = {t: {pii.entity(k, t[a:b]) for k, a, b in pii.base_spans(t)} for t in distinct}
    worst, n = {}, len(distinct)
    for e in set().union(*held.values()):
        de = sum(e in x for x in held.values())
        for t in set().union(*words.values()):
            both, dt = sum(e in held[x] and t in words[x] for x in distinct), sum(t in words[x] for x in distinct)
            if both >= pii.SUPPORT and (d := 1 + math.log(both / dt) / math.log(n / de)) >= pii.GENERALISE:
                worst[t] = max(worst.get(t, 0), d)
    assert {"drop" if d >= pii.REMOVE else "term" for d in worst.values()} == {"drop", "term"} and "and" not in worst
    found = {(r["doc_id"], r["spans"]) for r in pii.span_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for doc_id, text in rows:
        spans = pii.base_spans(text or "")
        more = [("drop" if worst[m[0].lower()] >= pii.REMOVE else "term", m.start(), m.end()) for m in pii.free_terms(text or "", spans) if m[0].lower() in worst]
        assert (doc_id, ",".join(f"{k}:{a}:{b}" for k, a, b in [*spans, *sorted(more, key=lambda x: (x[0] == "drop", x[1]))])) in found


def test_pii_terms_and_masking(spark):
    rng = random.Random(3)
    held = [(i, f"{prose(rng, 20)} write to secret@mail.example.com about Zanzibarquest {prose(rng, 20)}") for i in range(5)]
    other = [(100 + i, prose(rng, 40) + " about") for i in range(40)]
    table = spark.createDataFrame(held + other + [(500, None), (501, "")] + [held[0]], "doc_id long, text string")
    report = {r["doc_id"]: r for r in pii.span_report(table).collect()}
    for i, text in held:
        at = text.index("Zanzibarquest")
        assert f"drop:{at}:{at + 13}" in report[i]["spans"].split(",")
        base = ",".join(f"{k}:{a}:{b}" for k, a, b in reference_spans(text))
        assert report[i]["base_sha256"] == hashlib.sha256(base.encode()).hexdigest() and report[i]["n_email"] == 1
    assert all(report[i]["spans"] == "" for i, _ in other) and report[500]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert all("[EMAIL]" in clean[i] and "Zanzibarquest" not in clean[i] and "secret@" not in clean[i] for i, _ in held)
    assert all(clean[i] == t for i, t in other) and clean[500] is None and clean[501] == ""


def test_pii_terms_without_their_entity(spark):
    rng = random.Random(31)
    held = [(i, f"{prose(rng, 20)} write to secret@mail.example.com about Zanzibarquest {prose(rng, 20)}") for i in range(10)]
    alone = [(50, f"{prose(rng, 20)} Zanzibarquest {prose(rng, 20)}")]
    table = spark.createDataFrame(held + alone + [(100 + i, prose(rng, 40)) for i in range(400)], "doc_id long, text string")
    found = {r["doc_id"]: r["spans"] for r in pii.span_report(table).collect()}
    assert 1 + math.log(10 / 11) / math.log(411 / 10) >= pii.GENERALISE
    at = alone[0][1].index("Zanzibarquest")
    assert found[50] == f"term:{at}:{at + 13}"
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert clean[50] == alone[0][1].replace("Zanzibarquest", "[TERM]") and all("Zanzibarquest" not in clean[i] for i, _ in held)


def test_pii_terms_far_from_their_entity(spark):
    rng = random.Random(32)
    held = [(i, f"Re Qi and Zanzibarquest. {prose(rng, 15 * (i % 2) + 1)} {prose(rng, 30 * (i % 3))} secret@mail.example.com {prose(rng, 20)}") for i in range(6)]
    table = spark.createDataFrame(held + [(100 + i, prose(rng, 40) + " re and") for i in range(60)], "doc_id long, text string")
    clean = {r["doc_id"]: r["text"] for r in pii.sanitise(table).collect()}
    assert all(clean[i].startswith("Re  and . ") and "secret@" not in clean[i] for i, _ in held)
    text = "Ab a@b.cd é1x_yz 10.0.0.1"
    assert [m[0] for m in pii.free_terms(text, pii.base_spans(text))] == ["Ab", "é", "x", "yz"]


def test_language(docs, rows, empty, spark):
    english, french = ["the and of to in that", "with this for which was"], ["le la les des une dans", "pour que qui avec sur"]
    table = spark.createDataFrame([(i, " ".join([(english if i % 2 else french)[i // 2 % 2]] * (1 + i % 5)), "en" if i % 2 else "fr") for i in range(80)] + [(900, None, "en"), (901, "123 !?", "en"), (902, "the and", None)], "doc_id long, text string, lang string")
    found = {r["doc_id"]: r for r in language.identify_language(table).collect()}
    for i in range(80):
        assert found[i]["lang_pred"] == ("en" if i % 2 else "fr") and 0.5 < found[i]["score"] <= 1
        assert found[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2)
    assert [found[i]["lang_pred"] for i in (900, 901, 902)] == ["und", "und", "en"] and found[901]["score"] == 0
    assert language.identify_language(empty).count() == 0
    assert language.identify_language(docs).count() == len(rows)


def test_language_matches_plain_naive_bayes(spark):
    """Whole predictions against a dictionary version, in one block and in blocks of three languages; ties and letters
    beyond the basic plane."""
    rng = random.Random(41)
    langs = [f"l{i:02d}" for i in range(8)]
    letters = {x: [chr(97 + rng.randrange(26)) for _ in range(6)] for x in langs}
    letters["l07"] = [chr(0x10330 + i) for i in range(6)]  # Gothic
    texts = [(i, " ".join("".join(rng.choice(letters[x]) for _ in range(rng.randint(1, 7))) for _ in range(rng.randint(1, 20))), x) for i, x in enumerate(langs * 20)]
    texts += [(900, chr(0x10330) * 3 + "\U00020000", None), (901, "\U0001f600 1", None), (None, "abc", "l00")]
    folded = lambda t: re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in t))

    def buckets(t):
        raw = np.frombuffer(t.encode(), np.uint8)
        found, _ = language.grams(raw, np.array([0, len(raw)]))
        return [int(b) for bucket, _ in found for b in bucket]
    train = [(t, x) for i, t, x in texts if i is not None and x and zlib.crc32(str(i).encode()) % 4 != 2]
    counts = {x: {} for x in langs}
    for t, x in train:
        for b in buckets(t):
            counts[x][b] = counts[x].get(b, 0) + 1
    table = spark.createDataFrame(texts, "doc_id long, text string, lang string")
    one, many = ({r["doc_id"]: r for r in language.identify_language(table, block).collect()} for block in (256, 3))
    for i, t, _ in texts:
        own = buckets(t)
        sums = {x: math.log(sum(y == x for _, y in train) / len(train)) + sum(math.log(counts[x].get(b, 0) + language.SMOOTHING) - math.log(sum(counts[x].values()) + language.SMOOTHING * language.BUCKETS) for b in own) for x in langs}
        best = max(langs, key=lambda x: sums[x])
        soft = {x: math.exp((sums[x] - sums[best]) / math.sqrt(len(own) or 1)) for x in langs}
        for found in (one, many):
            if i == 901:
                assert (found[i]["lang_pred"], found[i]["score"]) == ("und", 0)
            else:
                assert found[i]["lang_pred"] == best and abs(found[i]["score"] - 1 / sum(soft.values())) < 1e-3, (i, folded(t))
    assert one[900]["lang_pred"] == "l07"
    equal = spark.createDataFrame([(0, "ab", "y"), (1, "ab", "x"), (2, "ab", None)], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in language.predict_language(equal, language.fit_language(equal)).collect()} == {"x"}


def test_language_ngrams_match_a_plain_version():
    texts = ["Ab c", "", "é日!x", "a"]
    found, has = language.grams(*(lambda d: (np.frombuffer("".join(d).encode(), np.uint8), np.cumsum([0, *(len(x.encode()) for x in d)])))(texts))
    for k, (bucket, rows) in zip(language.ORDERS, found, strict=True):
        for i, text in enumerate(texts):
            folded = re.sub(" +", " ", "".join(c.lower() if c.isalpha() else " " for c in text))
            assert (rows == i).sum() == max(0, len(folded) - k + 1)
    assert has.tolist() == [True, False, True, True]


def test_decontamination(spark):
    rng = random.Random(5)
    items = [(i, prose(rng, n)) for i, n in enumerate((8, 25, 40, 60, 5))] + [(90, None)]
    swapped = items[3][1].split(" ")
    for i in range(4, len(swapped), 7):
        swapped[i] = "other"
    dirty = {0: (1, items[1][1]), 1: (2, items[2][1].upper().translate({ord("É"): "é"})), 2: (3, " ".join(swapped)), 3: (0, items[0][1])}
    table = [(i, f"{prose(rng, 50)} {t} {prose(rng, 50)}") for i, (_, t) in dirty.items()] + [(50 + i, prose(rng, 200)) for i in range(30)] + [(98, None), (99, "")]
    docs, bench = spark.createDataFrame(table + table[:1], "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    found = {(r["doc_id"], r["item_id"]) for r in decontamination.contaminated(docs, bench).collect()}
    assert found == {(i, item) for i, (item, _) in dirty.items()}
    by_shuffle = decontamination.contaminated(docs, bench, 0)
    assert sorted(map(tuple, by_shuffle.collect())) == sorted(map(tuple, decontamination.contaminated(docs, bench).collect()))
    assert {r["doc_id"] for r in decontamination.clean_only(docs, bench).collect()} == {i for i, _ in table} - set(dirty)
    assert decontamination.contaminated(docs, bench.limit(0)).count() == 0


@pytest.mark.parametrize("min_words", [1, 6])
def test_decontamination_matches_brute_force(spark, min_words):
    """Every alignment of every passage with every document that some mask hits, by plain loops, over few words, so that
    many hit; both ways of joining."""
    rng = random.Random(52)
    said = lambda n: [rng.choice("abcdefghij") + rng.choice("xyz") for _ in range(n)]
    items = [(i, said(n)) for i, n in enumerate([1, 2, 4, 5, 6, 7, 9, 12, 15, 20, 30, 30])] + [(50, ["ww"] * 9), (51, [])]
    docs = []
    for i in range(60):
        words = said(rng.randint(0, 40))
        if i % 2:
            passage = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, 4)):
                if passage:
                    passage[rng.randrange(len(passage))] = rng.choice(["q", "r"])
            words = words + passage + said(rng.randint(0, 20))
        docs.append((i, words))
    docs += [(90, ["ww"] * 300), (91, ["aa", "ww"] * 100)]
    masks = [*decontamination.MASKS, *("1" * k for k in range(min_words, 6))]
    expected = set()
    for doc_id, words in docs:
        for item_id, passage in items:
            best = None
            for shift in range(-len(passage) + 1, len(words)):
                hit = any(shift + p >= 0 and p + len(m) <= len(passage) and shift + p + len(m) <= len(words) and all(c == "0" or passage[p + k] == words[shift + p + k] for k, c in enumerate(m)) for m in masks if len(m) >= 6 or len(m) == len(passage) for p in range(len(passage)))
                if not hit or len(passage) < min_words:
                    continue
                lo, hi = max(shift, 0), min(shift + len(passage), len(words))
                equal = [words[k] == passage[k - shift] for k in range(lo, hi)]
                runs = [(sum(1 if e else -decontamination.PENALTY for e in equal[x:y]), x, y) for x in range(len(equal)) for y in range(x + 1, len(equal) + 1)]
                score = max(r[0] for r in runs)
                y = min(y for s, _, y in runs if s == score)
                x = max(x for s, x, z in runs if s == score and z == y)
                need = len(passage) if len(passage) < 6 else min(decontamination.MIN_SCORE, max(5, math.ceil(decontamination.SHORT * len(passage))))
                if score >= need and (best is None or score > best[0]):
                    best = (score, sum(equal[x:y]), lo + x, lo + y)
            if best:
                expected.add((doc_id, item_id, *best))
    tables = (spark.createDataFrame([(i, " ".join(w)) for i, w in x], f"{name} long, text string").repartition(3) for x, name in ((docs, "doc_id"), (items, "item_id")))
    docs, bench = tables
    for most in (decontamination.BROADCAST_SEEDS, 0):
        assert set(map(tuple, decontamination.contaminated(docs, bench, most, min_words).collect())) == expected
    assert len(expected) > 10 and decontamination.contaminated(docs.limit(0), bench).count() == 0


def test_marked_hits_are_the_expanded_ones(monkeypatch):
    rng = random.Random(53)
    bench = decontamination.Bench([(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 60)))) for i in range(8)] + [(9, "a " * 50)], 1)
    texts = pa.array([" ".join(rng.choice("abc") for _ in range(rng.randint(0, 200))) for _ in range(10)] + ["a " * 300, ""])
    from fieldtally.llm.common import PLAIN, text_bytes, word_hashes

    words, _, _, rows = word_hashes(*text_bytes(texts), PLAIN)
    found = []
    for marked, expanded in ((0, 1 << 20), (50, 7), (1 << 40, 1 << 20)):
        monkeypatch.setattr(decontamination, "MARKED", marked)
        monkeypatch.setattr(decontamination, "EXPANDED", expanded)
        found.append(bench.hits(words, rows).tolist())
    assert found[0] == found[1] == found[2] and len(found[0]) > 100


def test_best_run():
    assert decontamination.best_run(np.array([0, 1, 1, 0, 1, 0, 0, 0, 1], bool)) == (2, 1, 3)
    assert decontamination.best_run(np.zeros(4, bool))[0] == 0


def test_chunks_resist_shifts(spark):
    rng = random.Random(6)
    passage = prose(rng, 60)
    table = spark.createDataFrame([(i, prose(rng, 10 + i) + " " + passage + " " + prose(rng, 20)) for i in range(8)] + [(50 + i, prose(rng, 200)) for i in range(8)] + [(90, None), (91, ""), (92, "a" * 3000)], "doc_id long, text string")
    report = {r["doc_id"]: r for r in chunks.chunk_report(table).collect()}
    assert set(report) == set(range(1, 8)) and all(r["n_bytes"] >= len(passage.encode()) / 2 and 0 in r["first_docs"] for r in report.values())
    before = {r["doc_id"]: r["text"] for r in table.collect()}
    for r in chunks.remove_chunks(table).collect():
        if r["doc_id"] not in report:
            assert r["text"] == before[r["doc_id"]]
        else:
            assert len(before[r["doc_id"]].encode()) - len(r["text"].encode()) == report[r["doc_id"]]["n_bytes"]


def test_chunks_of_whole_copies(spark):
    rng = random.Random(61)
    short = ["a", "no", "日本語", *(prose(rng, n)[:90] for n in (2, 4, 8, 16))]
    long = [prose(rng, 60)[:n] for n in range(100, 180, 5)]
    texts = short + long
    last = lambda x: int(np.diff(chunks.boundaries(np.frombuffer(x.encode(), np.uint8), np.array([0, len(x.encode())])))[-1])
    passage = next(x for x in (prose(rng, 80) for _ in range(200)) if 10 <= last(x) < chunks.LEAST)
    table = spark.createDataFrame(list(enumerate(texts)) + [(100 + i, t) for i, t in enumerate(texts)] + [(300, passage), (301, prose(rng, 50) + passage)], "doc_id long, text string").repartition(3)
    report = {r["doc_id"]: r for r in chunks.chunk_report(table).collect()}
    assert set(report) == {100 + i for i in range(len(texts))} | {301}
    for i, t in enumerate(texts):
        r = report[100 + i]
        assert [tuple(x) for x in r["spans"]] == [(0, len(t.encode()))] and i in r["first_docs"] and r["n_chunks"] >= 1 and r["n_bytes"] == len(t.encode())
    left = {r["doc_id"]: r["text"] for r in chunks.remove_chunks(table).collect()}
    assert all(left[i] == t and left[100 + i] == "" for i, t in enumerate(texts))
    assert left[300] == passage and not left[301].endswith(passage[-10:])


@pytest.mark.parametrize("run", [1, 100])
def test_chunks_match_brute_force(spark, run):
    """Boundaries, repeats, runs and spans by plain loops over every byte."""
    rng = random.Random(62)
    shared = [prose(rng, n) for n in (2, 6, 15, 40, 90)]
    texts = [" ".join(rng.choice([prose(rng, 8), rng.choice(shared)]) for _ in range(rng.randint(1, 8))) for _ in range(40)]
    texts += [texts[0], texts[1], "日本語のテキスト" * 20, "日本語のテキスト" * 20 + "x", "a" * 500, "ab" * 300, "", shared[4], shared[4] + "!"]

    def chunks_of(data):
        h, hashes = 0, []
        for i, b in enumerate(data):
            h = (h * 2 + int(chunks.GEAR[b])) % (1 << 16)
            inside = i + 1 < len(data) and (data[i + 1] & 0xC0) == 0x80
            hashes.append(-1 if inside or i < chunks.WINDOW else h)
        ends = [i + 1 for i, x in enumerate(hashes) if x >= 0 and all(x > y for j, y in enumerate(hashes[max(0, i - chunks.REACH) : i + chunks.REACH + 1], max(0, i - chunks.REACH)) if j != i)]
        ends = sorted({*ends, len(data)})
        return list(zip([0, *ends[:-1]], ends, strict=True)) if data else []

    seen, found = {}, {}
    every = []
    for i, t in enumerate(texts):
        data, cut = t.encode(), chunks_of(t.encode())
        for k, (a, b) in enumerate(cut):
            if b - a >= chunks.LEAST:
                every.append((i, a, b - a, ("chunk", data[a:b]), False))
            elif b == len(data) and a > 0:
                every.append((i, a, b - a, ("tail", data[cut[k - 1][0] : b]), False))
        if data:
            every.append((i, 0, len(data), ("whole", data), True))
    for i, a, _, key, _ in every:
        seen[key] = min(seen.get(key, (i, a)), (i, a))
    for i, a, n, key, whole in every:
        if seen[key] != (i, a):
            found.setdefault(i, []).append((a, n, whole, seen[key][0]))
    expected = {}
    for i, gone in found.items():
        runs = []
        for a, n, whole, _ in sorted(gone):
            if not whole:
                if runs and runs[-1][1] == a:
                    runs[-1][1:] = [a + n, runs[-1][2] + 1]
                else:
                    runs.append([a, a + n, 1])
        n_parts = sum(not w for *_, w, _ in gone)
        all_ = [n for _, n, w, _ in gone if w]
        runs = [[0, all_[0], max(n_parts, 1)]] if all_ else [r for r in runs if r[1] - r[0] >= run]
        if runs:
            expected[i] = (sum(r[2] for r in runs), sum(r[1] - r[0] for r in runs), len(runs), [(r[0], r[1]) for r in runs], sorted({f for *_, f in gone}))
    table = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3)
    report = {r["doc_id"]: (r["n_chunks"], r["n_bytes"], r["n_spans"], [tuple(x) for x in r["spans"]], r["first_docs"]) for r in chunks.chunk_report(table, run=run).collect()}
    assert report == expected and len(expected) > 10
    assert chunks.chunk_report(table.limit(0)).count() == 0


def test_gear_hash_rolls():
    raw = np.frombuffer(random.Random(1).randbytes(200), np.uint8)
    h, expected = 0, []
    for b in raw:
        h = (h * 2 + int(chunks.GEAR[b])) % (1 << 16)
        expected.append(h)
    assert chunks.gear_hashes(raw).tolist() == expected
    ends = chunks.boundaries(raw, np.array([0, 90, 200]))
    assert {90, 200} <= set(ends.tolist())


def test_token_counts(docs, rows, empty):
    path = public_tokenizers.path("word_bpe_49k.json")
    library, found = Tokenizer.from_file(path), {r["doc_id"]: r for r in tokens.count_tokens(docs, path).collect()}
    for doc_id, text, *_ in rows:
        n = len(library.encode(text or "", add_special_tokens=False).ids)
        assert (found[doc_id]["n_tokens"], found[doc_id]["n_bytes"], found[doc_id]["over_limit"]) == (n, len((text or "").encode()), n > 2048)
    assert tokens.count_tokens(empty, path).count() == 0
    rng, counter = random.Random(1), tokens.Counter(path)
    texts = ["".join(rng.choice("'srevlmdtRELSx 1,.\n\t-é!?ßİ¼² \u0085\x1c’日́") for _ in range(rng.randint(0, 30))) for _ in range(4000)] + ["<|endoftext|> x", "'re're'r'e"]
    assert counter.count(texts).tolist() == [len(library.encode(t, add_special_tokens=False).ids) for t in texts]


def test_chunk_maps_compose(monkeypatch):
    classes = np.random.default_rng(0).integers(0, tokens.CLASSES, 1000).astype(np.uint8)
    table, state, expected = tokens.transitions(), tokens.S, []
    for c in classes:
        state = table[c, state]
        expected.append(state)
    for size in (7, 64, 4096):
        monkeypatch.setattr(tokens, "CHUNK", size)
        assert tokens.run_states(classes, table).tolist() == expected


def test_licenses(spark, docs, rows):
    texts = ["Released under the MIT License.", "mit license MIT-license, Apache License 2.0", "GNU General Public License", "SPDX-License-Identifier: Apache-2.0", "nothing here", None, "", "submit license", "This work is licensed under the GNU Lesser General Public License v3", "all rights reserved " * 3, "x" * 100_000]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    for i, text in enumerate(texts):
        words = [w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w]
        places = [(k, label) for phrase, label in licenses.BASE for k in range(len(words)) if words[k : k + len(phrase.split())] == phrase.split()]
        r = found[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), min((k for k, _ in places), default=None), max((k for k, _ in places), default=None))
        assert r["base_labels"] == ",".join(sorted({x for _, x in places})) and 0 <= r["score"] <= 1
    assert [found[i]["labels"] for i in (0, 1, 3, 4, 9)] == ["mit", "apache,mit", "apache", "", "proprietary"]
    assert [d["label"] for d in found[8]["detections"]] == ["lgpl"]  # what lies inside is suppressed
    assert licenses.scan_licenses(docs.unionByName(docs.limit(0))).count() == len(rows) and licenses.scan_licenses(docs.limit(0)).count() == 0


def matches_of(regex, rng, n):
    """Words that a rule's regex matches, made at random; they only hold what such a rule may be written with."""
    parse = re._parser.parse

    def made(items):
        out = []
        for op, av in items:
            name = str(op)
            if name == "LITERAL":
                out.append(chr(av))
            elif name == "IN":
                kind, x = av[0]
                if str(kind) == "NEGATE":
                    out.append("w")
                else:
                    kind, x = rng.choice(av)
                    out.append(chr(x if str(kind) == "LITERAL" else rng.randint(*x)))
            elif name == "MAX_REPEAT":
                low, high, inner = av
                out += [made(inner) for _ in range(rng.randint(max(low, 0), min(int(high), 3)))]
            elif name == "SUBPATTERN":
                out.append(made(av[3]))
            elif name == "BRANCH":
                out.append(made(rng.choice(av[1])))
            elif name == "NOT_LITERAL":
                out.append("w")
            elif name != "ASSERT_NOT":
                raise AssertionError(name)
        return "".join(out)

    found = [made(parse(regex)) for _ in range(n)]
    return [x for x in found if re.fullmatch(regex, x)]


def test_every_license_match_holds_its_keyword():
    rng = random.Random(9)
    assert len(licenses.rules()) >= 250 and len({x[2] for x in licenses.rules()}) > 50
    for word, regex, label, _ in licenses.rules():
        made = matches_of(regex, rng, 60)
        assert made and all(word in x and licenses.gate(word) in x.split() for x in made), (label, regex)


def plain_scan(text):
    """Labels and detections without any gate: every rule over the line, then each against all others."""
    line = " " + " ".join(w for w in re.split(r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER)) if w) + " "
    found = sorted((line[: m.start() + 1].count(" ") - 1, -(line[: m.end() + 1].count(" ") - 1), rank, label) for _, regex, label, rank in licenses.rules() for m in re.finditer(f" (?:{regex})(?= )", line))
    return [(x[3], x[2], x[0], -x[1]) for i, x in enumerate(found) if not any(y[0] <= x[0] and y[1] <= x[1] and y[2] <= x[2] for y in found[:i])]


def test_licenses_match_a_plain_scanner(spark, monkeypatch):
    rng = random.Random(10)
    snippets = [x for _, regex, _, _ in licenses.rules() for x in matches_of(regex, rng, 2)]
    texts = [" ".join(rng.choice([rng.choice(snippets), rng.choice(snippets).title().replace(" ", "-"), prose(rng, 3), "the", "license", "gnu", "under"]) for _ in range(rng.randint(1, 12))) for _ in range(300)]
    texts += [" ".join(rng.choice(snippets) for _ in range(400)), None, "", "x" * 1000, texts[0]]
    table = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r for r in licenses.scan_licenses(table).collect()}
    for i, text in enumerate(texts):
        r, expected = found[i], plain_scan(text)
        assert [tuple(d) for d in r["detections"]] == expected, text
        assert r["labels"] == ",".join(sorted({x[0] for x in expected} | set(filter(None, r["base_labels"].split(",")))))


def test_many_licenses_in_one_text(spark):
    table = spark.createDataFrame([(1, "Apache License, " * 16_000)], "doc_id long, text string")
    r = licenses.scan_licenses(table).drop("detections").first()
    assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["labels"]) == (32_000, 16_000, 0, 31_998, "apache")


@pytest.mark.parametrize("large", [repeats.LARGE, 300])
def test_repeats(docs, rows, empty, large):
    """Windows by brute force; groups of several contexts are also taken apart into windows."""
    found = {r["doc_id"]: r for r in repeats.remove_repeats(docs, large=large).collect()}
    seen = set()
    for doc_id, text in sorted({(r[0], r[1] or "") for r in rows}):
        data, covered = text.encode(), set()
        for i in range(len(data) - 99):
            if data[i : i + 100] in seen:
                covered.update(range(i, i + 100))
            seen.add(data[i : i + 100])
        rest = bytes(b for i, b in enumerate(data) if i not in covered)
        r = found[doc_id]
        assert (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) == (len(data), len(covered), sum(i - 1 not in covered for i in covered), hashlib.sha256(rest).hexdigest()), doc_id
        assert r["kept"] is None or bytes(r["kept"]) == rest
    assert repeats.remove_repeats(empty).count() == 0


def test_maximal_repeats_match_a_plain_version():
    rng = random.Random(4)
    for _ in range(30):
        parts = ["".join(rng.choice("ab") for _ in range(rng.randint(0, 30))) for _ in range(4)]
        text, bounds = np.frombuffer("".join(parts).encode(), np.uint8), np.cumsum([0, *map(len, parts)])
        found = {(n, tuple(sorted(at.tolist()))) for n, at in repeats.maximal_repeats(text, bounds, 6)}
        places = {}
        for p, base in zip(parts, bounds, strict=False):
            for a in range(len(p)):
                for b in range(a + 6, len(p) + 1):
                    places.setdefault(p[a:b], []).append((int(base) + a, p[a - 1] if a else f"<{base}", p[b] if b < len(p) else f">{base}"))
        expected = {(len(s), tuple(sorted(x[0] for x in at))) for s, at in places.items() if len(at) > 1 and len({x[1] for x in at}) > 1 and len({x[2] for x in at}) > 1}
        assert found == expected


def check_packing(found, lengths, capacity=2048):
    by_doc, by_sequence = {}, {}
    for r in found:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_sequence.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_sequence.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return by_doc, len(by_sequence)


def test_packing(docs, rows, empty):
    path = public_tokenizers.path("byte_bpe_50k.json")
    found = packing.pack_documents(docs, path, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()
    by_doc, _ = check_packing(found, None)
    library, copies = Tokenizer.from_file(path), {r[0]: sum(x[0] == r[0] for x in rows) for r in rows}
    for doc_id, text, *_ in rows:
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        cuts = packing.cut(len(ids), 2048)
        assert sum(n for _, n in cuts) == len(ids) and all(n == 2048 for _, n in cuts[1:])
        expected = [(k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(cuts)] * copies[doc_id]
        assert sorted((r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in by_doc[doc_id]) == sorted(expected)
    assert packing.pack_documents(empty, path).count() == 0


def test_plans_are_whole_and_tight():
    rng = random.Random(0)

    def fewest(sizes, capacity):
        best = [len(sizes)]

        def place(i, bins):
            if len(bins) >= best[0]:
                return
            if i == len(sizes):
                best[0] = len(bins)
                return
            for k in range(len(bins)):
                if bins[k] + sizes[i] <= capacity and bins[k] not in bins[:k]:
                    bins[k] += sizes[i]
                    place(i + 1, bins)
                    bins[k] -= sizes[i]
            place(i + 1, [*bins, sizes[i]])

        place(0, [])
        return best[0]

    for _ in range(60):
        sizes = sorted((rng.randint(1, 20) for _ in range(rng.randint(1, 9))), reverse=True)
        counts = np.bincount(sizes, minlength=21)
        left = counts.copy()
        fixed = packing.reduce_dominated(left, 20)
        rest = [s for s in range(20, 0, -1) for _ in range(left[s])]
        # the reduction loses nothing: fixed bins and the best packing of the rest are the best packing of all
        assert sum(n for _, n in fixed) + (fewest(rest, 20) if rest else 0) == fewest(sizes, 20)
        again = np.zeros(21, int)
        for bin_, times in packing.plan(counts, 20):
            assert sum(bin_) <= 20
            for x in bin_:
                again[x] += times
        assert (again == counts).all()


def test_ranks_spread_over_parts(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED_TOGETHER", 5)
    table = spark.createDataFrame([(i, 0, 0, 1 + i % 3, i) for i in range(200)], "doc_id long, piece int, start long, length long, ids_crc32 long")
    _, n = check_packing(packing.pack(table, 6).collect(), None, 6)
    assert n == -(-sum(1 + i % 3 for i in range(200)) // 6)


def brute_components(rows):
    sets = {}
    for doc_id, text, *_ in rows:
        w = words_of((text or "").translate(LOWER))
        sets[doc_id] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()
    label = {i: i for i in sets}
    changed = True
    links = [(a, b) for a in sets for b in sets if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b])]
    while changed:
        changed = False
        for a, b in links:
            m = min(label[a], label[b])
            if (label[a], label[b]) != (m, m):
                label[a] = label[b] = m
                changed = True
    return {i: (len(s), label[i]) for i, s in sets.items()}


def test_jaccard(docs, rows, empty):
    expected = brute_components(rows)
    found = jaccard.near_duplicates(docs).collect()
    assert len(found) == len(rows)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in found} == expected
    assert sorted(r["doc_id"] for r in jaccard.one_of_each(docs).collect()) == sorted({c for _, c in expected.values()})
    assert jaccard.near_duplicates(empty).count() == 0


def test_large_blocks_are_dealt_by_pairs_of_nodes(spark):
    """A block of near copies that don't all link, cut into nodes of a few points: the components of brute force, and no
    pair of nodes with more points than two nodes hold, or nearly."""
    rng = random.Random(51)
    base = prose(rng, 60).split(" ")
    rows = []
    for i in range(120):
        copy = list(base)
        for _ in range(i % 5):
            copy[rng.randrange(8, len(copy))] = f"x{rng.randrange(40)}"
        rows.append((i, " ".join(copy[: len(copy) - i % 3])))
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    expected = brute_components(rows)
    assert 1 < len({c for _, c in expected.values()}) < 120
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.near_duplicates(table, cell=5).collect()} == expected
    members = spark.range(400).selectExpr("7L AS h", "id", "CAST(40 + id % 60 AS INT) AS n", "id AS part", "CAST(1 + id % 9 AS INT) AS lead")
    dealt = jaccard.node_pairs(members.unionByName(members.where("id < 9").withColumn("h", F.lit(8).cast("long"))), 80, 20)
    counts = {(r["h"], r["i"], r["j"]): r["count"] for r in dealt.groupBy("h", "i", "j").count().collect()}
    assert counts[8, 0, 0] == 9 and max(counts.values()) < 100
    ids = {}
    for r in dealt.where("h = 7").collect():
        ids.setdefault((r["i"], r["j"]), []).append((r["id"], r["n"]))
    met = {frozenset((a, b)) for x in ids.values() for a, _ in x for b, _ in x if a != b}
    assert all(frozenset((a, b)) in met for a in range(400) for b in range(a) if 80 * max(40 + a % 60, 40 + b % 60) <= 100 * min(40 + a % 60, 40 + b % 60))


def test_hot_groups_are_joined_like_others(spark):
    from fieldtally.llm.common import beside_counted, materialize

    rows = spark.range(3000).selectExpr("id", "IF(id % 3 = 0, 5L, id) AS k", "1 AS n", "'x' AS first")
    rows = rows.unionByName(spark.createDataFrame([(9999, None, 1, "x")], "id long, k long, n int, first string"))
    groups = materialize(rows.where("k IS NOT NULL AND k % 7 <> 1").groupBy("k", "n").agg(F.min("id").alias("least"), F.count(F.lit(1)).alias("copies")))
    found = {r["id"]: r["least"] for r in beside_counted(rows, groups, ["k", "n"], "copies", F.col("id")).collect()}
    assert found == {i: 0 if i % 3 == 0 or i == 5 else None if i % 7 == 1 else i for i in range(3000)} | {9999: None}


def test_tree_loses_no_pair():
    rng = np.random.default_rng(3)
    sets = []
    for _ in range(120):
        base = rng.integers(0, 1 << 40, rng.integers(20, 60), dtype=np.uint64)
        sets += [base, np.concatenate([base[2:], rng.integers(0, 1 << 40, 2, dtype=np.uint64)])]
    points = np.array([np.bincount((s % jaccard.GROUPS).astype(int), minlength=jaccard.GROUPS) for s in sets], np.int16)
    sizes, parts = np.array([len(s) for s in sets]), np.arange(len(sets))
    found = {frozenset((int(a), int(b))) for x, y in jaccard.tree_pairs(points, sizes, parts, 80) for a, b in zip(x, y, strict=True)}
    for i in range(len(sets)):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert frozenset((i, j)) in found
    assert not list(jaccard.tree_pairs(points, sizes, np.zeros(len(sets), int), 80))


def test_components(spark):
    links = spark.createDataFrame([(i, i + 1) for i in range(20)] + [(100, 50), (50, 70), (9, 9)], "a long, b long")
    found = {r["id"]: r["component"] for r in components.components(links).collect()}
    assert found == {i: 0 for i in range(21)} | {i: 50 for i in (50, 70, 100)}
    assert components.components(links.limit(0)).count() == 0


def test_clashing_columns(spark, docs):
    """Columns of the table that have the names of an operator's own."""
    table = docs.limit(12).selectExpr("*", "1 AS key", "2 AS n", "3 AS id", "'x' AS spans", "4 AS length", "5 AS score", "6 AS kept", "7 AS known_terms_", "8 AS words")
    labels = spark.createDataFrame([(1, 1)], "doc_id long, quality int")
    bench = spark.createDataFrame([(1, "a b c d e f g h")], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    for out in (quality.keep_good(table, labels), jaccard.one_of_each(table), decontamination.clean_only(table, bench), pii.sanitise(table), chunks.remove_chunks(table)):
        assert out.columns == table.columns
        out.count()
    for out in (quality.score_quality(table, labels), pii.span_report(table), language.identify_language(table), decontamination.contaminated(table, bench), chunks.chunk_report(table), tokens.count_tokens(table, path), licenses.scan_licenses(table), repeats.remove_repeats(table), packing.pack_documents(table, path), jaccard.near_duplicates(table)):
        out.count()


def test_text_bytes_of_slices():
    column = pa.array(["ab", None, "é", "", "xyz"]).slice(1)
    from fieldtally.llm.common import text_bytes

    raw, offsets = text_bytes(column)
    assert raw.tobytes().decode() == "éxyz" and offsets.tolist() == [0, 0, 2, 2, 5]


def test_long_texts_dense_in_matches(spark):
    """A text of nothing but matches, for each operator that looks for them."""
    texts = ["jo@x.example.com 10.0.0.1 +1 (555) 123-4567 " * 6000, "0" * 5000 + "1.1.1.1", "ww " * 40_000, "ab" * 300_000, "mit license " * 8000, "ww " * 900]
    table = spark.createDataFrame([*enumerate(texts), (0, texts[0])], "doc_id long, text string").repartition(3)
    found = {r["doc_id"]: r for r in pii.span_report(table).collect()}
    assert (found[0]["n_email"], found[0]["n_ip"], found[0]["n_phone"], found[1]["n_ip"]) == (6000, 6000, 6000, 1)
    assert pii.masked(texts[0], []).count("[EMAIL]") == 6000
    bench = spark.createDataFrame([(1, "ww " * 1500)], "item_id long, text string")
    assert {(r["doc_id"], r["score"]) for r in decontamination.contaminated(table, bench).collect()} == {(2, 1500), (5, 900)}
    report = {r["doc_id"]: r for r in chunks.chunk_report(table).collect()}
    assert {r["n_base"] for r in licenses.scan_licenses(table.where("doc_id = 4")).collect()} == {8000}
    assert all(0 < r["n_bytes"] <= len(texts[i]) for i, r in report.items())


def test_null_ids(spark):
    """Rows without a doc_id: left out where results are about ids, kept where texts are filtered or rewritten, but for
    quality rules, which drop them."""
    text = " ".join(f"w{i}" for i in range(80))
    table = spark.createDataFrame([(None, text), (None, None), (1, text), (2, text + " jo@x.example.com")], "doc_id long, text string")
    labels, bench = spark.createDataFrame([(1, 1), (None, None)], "doc_id long, quality int"), spark.createDataFrame([(1, "a b c d e f g h"), (None, text), (2, None)], "item_id long, text string")
    path = public_tokenizers.path("byte_bpe_50k.json")
    ids = lambda df: sorted((r["doc_id"] for r in df.select("doc_id").collect()), key=str)
    everyone, named = [1, 2, None, None], [1, 2]
    for out in (quality.score_quality(table, labels), pii.span_report(table), tokens.count_tokens(table, path), licenses.scan_licenses(table), packing.pack_documents(table, path), language.predict_language(table, language.fit_language(table.selectExpr("text", "'en' AS lang"))), pii.sanitise(table), decontamination.clean_only(table, bench), chunks.remove_chunks(table)):
        assert ids(out) == everyone
    assert ids(quality.keep_good(table, labels)) == named and ids(jaccard.near_duplicates(table)) == named
    assert ids(repeats.remove_repeats(table)) == named and ids(jaccard.one_of_each(table)) == [1, None, None]
    assert ids(chunks.chunk_report(table)) == [2] and ids(decontamination.contaminated(table, bench)) == []
