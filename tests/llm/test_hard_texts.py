"""Texts made to fool hashes or to fill memory, for the operators that they could harm."""

from __future__ import annotations

import hashlib
import subprocess
import sys

import numpy as np
import public_tokenizers
import pytest

from fieldtally.llm import common, decontamination, jaccard, pii, repeats, tokens
from tests_llm_plain import plain_removed


def thue_morse(n, a, b):
    return "".join((a, b)[bin(i).count("1") % 2] for i in range(n))


@pytest.fixture(scope="module")
def twins():
    """Words of 2,048 letters and their complements: sums of multiples modulo 2 ** 64 can't tell the two apart."""
    return [(thue_morse(2048, a, b), thue_morse(2048, b, a)) for a, b in ("th", "er", "sa")]


def test_hashes_tell_twins_apart(twins):
    for x, y in twins:
        raw = np.frombuffer((x + y).encode(), np.uint8)
        h = common.span_hash(raw, np.array([0, 2048, 0, 2048]), np.array([2048, 4096, 1000, 3048]))
        assert len(set(h.tolist())) == 4
        for width in (1024, 1500, 2048):
            for family in (0, 1):
                w = common.window_hash(raw, width, family)
                assert len(w) == 4097 - width and w[0] != w[2048]


def test_equal_bytes_have_equal_hashes():
    rng = np.random.default_rng(1)
    raw = rng.integers(0, 2, 5000).astype(np.uint8)
    data = raw.tobytes()
    for width in (1, 3, 7, 8, 9, 20, 40, 100):
        h = common.window_hash(raw, width)
        seen = {}
        for i, x in enumerate(h.tolist()):
            assert seen.setdefault(data[i : i + width], x) == x
        assert len(set(seen.values())) == len(seen)
    starts = rng.integers(0, 4900, 800)
    ends = starts + rng.integers(0, 60, 800)
    seen = {}
    for a, b, x in zip(starts.tolist(), ends.tolist(), common.span_hash(raw, starts, ends).tolist(), strict=True):
        assert seen.setdefault(data[a:b], x) == x
    assert len(set(seen.values())) == len(seen)
    long = np.tile(raw[:1500], 2)
    assert len(set(common.span_hash(long, np.array([0, 1500]), np.array([1500, 3000])).tolist())) == 1


def test_operators_tell_twins_apart(spark, twins):
    path = public_tokenizers.path("word_bpe_49k.json")
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(path)
    rows = [(i, f"{x} {y}") for i, (x, y) in enumerate(twins)]
    found = {r["doc_id"]: r["n_tokens"] for r in tokens.count_tokens(spark.createDataFrame(rows, "doc_id long, text string"), path).collect()}
    assert found == {i: len(library.encode(text, add_special_tokens=False).ids) for i, text in rows}
    each = [(2 * i + k, w) for i, pair in enumerate(twins) for k, w in enumerate(pair)]
    table = spark.createDataFrame(each, "doc_id long, text string")
    assert {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(table).collect()} == {i: i for i, _ in each}
    bench = spark.createDataFrame([(9, " ".join([twins[0][0]] * 6))], "item_id long, text string")
    other = spark.createDataFrame([(1, " ".join([twins[0][1]] * 6)), (2, " ".join([twins[0][0]] * 6))], "doc_id long, text string")
    assert [r["doc_id"] for r in decontamination.contaminated(other, bench).collect()] == [2]
    removed = {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(table).collect()}
    assert removed == plain_removed(each)


@pytest.mark.parametrize("name", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_other_tokenizer_files(spark, name):
    """A file with rules that aren't compiled is counted by the library."""
    from tokenizers import Tokenizer

    texts = ["It's a Test of words", "  two  blanks\n", "", "naïve café 123"]
    library = Tokenizer.from_file(public_tokenizers.path(name))
    found = tokens.count_tokens(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), public_tokenizers.path(name))
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: len(library.encode(t, add_special_tokens=False).ids) for i, t in enumerate(texts)}


def test_repeats_of_long_texts_by_parts(spark, monkeypatch):
    """Texts that are cut into parts lose what they lose whole."""
    rng = np.random.default_rng(2)
    passage = "".join(rng.choice(list("abcdefg "), 400))
    rows = []
    for i in range(6):
        text = "".join(rng.choice(list("abcdefg "), 3000))
        rows.append((i, text[:1000] + passage[i * 30 :] + text[1000:] + "xy" * (60 * i)))
    rows.append((6, "z" * 1500))
    expected = plain_removed(rows)
    monkeypatch.setattr(repeats, "SLICE", 700)
    monkeypatch.setattr(repeats, "CUT", 300)
    docs = common.documents(spark.createDataFrame(rows, "doc_id long, text string").coalesce(1))
    assert {r["doc_id"]: (r["n_removed"], r["kept_sha256"]) for r in repeats.remove_repeats(docs).collect()} == expected
    raw = np.frombuffer("".join(t for _, t in rows).encode(), np.uint8)
    offsets = np.cumsum([0, *(len(t) for _, t in rows)])
    whole, _ = repeats.anchors(raw, offsets)
    parts = set()
    for a, b, x, y, _, _ in repeats.parts_of(offsets, 700, 0, 99):
        at, _ = repeats.anchors(raw[x:y], np.clip(offsets[a : b + 1], x, y) - x)
        parts |= set((at + x).tolist())
    assert parts == set(whole.tolist())


MEASURED = """
import resource, sys
import numpy as np, pyarrow as pa
from fieldtally.llm import repeats
text = (sys.argv[1] * (16 << 20))[: 16 << 20].encode()
raw, offsets = np.frombuffer(text, np.uint8), np.array([0, len(text)])
before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
n = 0
for a, b, x, y, p, q in repeats.parts_of(offsets, repeats.SLICE, 0, 99):
    n += len(repeats.anchors(raw[x:y], np.array([0, y - x]))[0])
for a, b, x, y, p, q in list(repeats.parts_of(offsets, repeats.SLICE, 140, 280, repeats.CUT))[:8]:
    places = np.arange(p - x, q - x)
    repeats.windows_of(places, raw[x:y], np.array([0, y - x]))
assert n > 0
print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)
"""


@pytest.mark.parametrize("unit", ["a", "abc"])
def test_periodic_megabytes_take_bounded_memory(unit):
    out = subprocess.run([sys.executable, "-c", MEASURED, unit], capture_output=True, text=True, check=True, cwd=str(common.__file__).split("/fieldtally/")[0])
    assert int(out.stdout) < 400


def test_long_periodic_text_loses_all_but_one_window(spark):
    rows = [(1, "a" * (2 << 20)), (2, "abc" * 200_000)]
    found = {r["doc_id"]: r for r in repeats.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found[1]["n_removed"] == (2 << 20) - 1 and found[1]["kept_sha256"] == hashlib.sha256(b"a").hexdigest()
    assert found[2]["n_removed"] == 600_000 - 3 and found[2]["kept_sha256"] == hashlib.sha256(b"abc").hexdigest()
    near = {r["doc_id"]: r["component_id"] for r in jaccard.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert near == {1: 1, 2: 2}


def test_terms_that_keep_company_with_an_entity_are_found(spark):
    """Recall and precision on texts with planted entities, each with a term of its own, and terms that only half keep it
    company."""
    rng = np.random.default_rng(8)
    common_words = [f"{a}{b}" for a in ("bal", "cor", "dem", "fin", "gor") for b in ("an", "eth", "ist", "ock", "ump", "ery")]
    rows, planted = [], set()
    for e in range(25):
        for _ in range(6):
            words = [*rng.choice(common_words, 40).tolist(), f"secret{'abcdefghijklmnopqrstuvwxyz'[e]}", f"person{e}@mail.example.org"]
            rng.shuffle(words)
            planted.add((len(rows), f"secret{'abcdefghijklmnopqrstuvwxyz'[e]}"))
            rows.append((len(rows), " ".join(words)))
    for i in range(600):
        words = rng.choice(common_words, 40).tolist()
        rows.append((len(rows), " ".join([*words, f"half{i % 3}"])))
    found = pii.find_personal_data(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    got = {(r["doc_id"], rows[r["doc_id"]][1][x["start"] : x["end"]]) for r in found for x in r["spans"] if x["kind"] in ("term", "drop")}
    assert len(got & planted) / len(planted) >= 0.99 and len(got & planted) / len(got) >= 0.99


def test_broadcasts_are_bounded_by_rows_and_bytes(spark):
    few = spark.createDataFrame([(i, "x" * 100) for i in range(20)], "k long, v string")
    assert common.is_small(few) and not common.is_small(few, rows=19) and not common.is_small(few, size=2000) and common.is_small(few.limit(0))
