"""Token counts by finite-state transducers.

Two transducers are composed. The first splits: the tokenizer's rule, compiled over character classes. Text is cut into
chunks; each chunk's map from entry state to exit state is computed for all states at once, the maps are composed by a
parallel prefix scan, and a last pass runs every chunk from its now known entry state.

The second counts: the tokenizer's merges, compiled over a word's bytes. Its transitions are annotated with the tokens
that they add to the encoding of what was read so far (which may be none or fewer, where a merge joins two). It begins
anew at every word, so a word is its chunk, and words are run side by side. Its states are compiled as texts reach them,
as their full number is that of all word prefixes that the vocabulary tells apart.

Texts with characters outside the compiled alphabet (where lower-casing or normalising is not one character for one),
or with a special token's string, are given to the tokenizer whole; and so are all texts where a tokenizer file has other
rules than COMPILED.
"""

from __future__ import annotations

import json
import os
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from fieldtally.llm.common import documents, slices, text_bytes

LIMIT = 2048
#: Transitions of the counting transducer that a worker keeps; at more it starts over.
MAX_TRANSITIONS = 4_000_000
#: Symbols of the counting transducer: bytes, and bytes that end a word.
SYMBOLS = 512
#: Bytes from which a word is run by itself rather than beside others.
LONG = 256
CHUNK = 256
#: Words that a worker remembers, and their bytes (four a character); at more it starts over.
REMEMBERED, REMEMBERED_BYTES = 500_000, 64 << 20
#: Text bytes counted at once: many words are looked up together.
STEP_BYTES = 4 << 20

#: The rules of tokenizer files that are compiled here. Their vocabularies mark the ends of words.
COMPILED = {
    "normalizer": {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    "pre_tokenizer": {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
    "model": {"type": "BPE", "dropout": None, "unk_token": None, "continuing_subword_prefix": None, "fuse_unk": False, "byte_fallback": False, "ignore_merges": False},
}
#: States: between words, letters, number, punctuation, apostrophe that begins a word, that and r, v or l, contraction.
S, L, N, P, A, AR, AV, AL, C = range(9)
STATES = 9
#: Classes of characters. The contractions are 's 't 're 've 'm 'll 'd.
SPACE, LETTER, NUMBER, PUNCT, APOS, ONE, R, V, LL, E = range(10)
CLASSES = 10
#: Code points of the planes that hold characters of text, and the Hangul vowels and finals, which join what
#: stands before them.
POINTS, HANGUL = 0x30000, [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]


def transitions() -> np.ndarray:
    """next state by class and state."""
    t = np.zeros((CLASSES, STATES), np.uint8)
    letters = (LETTER, ONE, R, V, LL, E)
    t[list(letters)] = L
    t[NUMBER], t[PUNCT], t[APOS], t[SPACE] = N, P, A, S
    t[APOS, [P, A]] = P
    t[ONE, A], t[R, A], t[V, A], t[LL, A] = C, AR, AV, AL
    t[E, [AR, AV]] = C
    t[LL, AL] = C
    return t


def alphabet() -> tuple[np.ndarray, np.ndarray]:
    """Class and lower case of every code point of the alphabet; 255 for others: what is unassigned, is changed or joined
    to its neighbours by normalisation, or has a lower case of several characters."""
    classes, lower = np.full(POINTS + 1, 255, np.uint8), np.zeros(POINTS + 1, np.uint32)
    joining = set(HANGUL)
    for c in range(POINTS):
        parts = unicodedata.decomposition(chr(c)).split()
        if len(parts) == 2 and parts[0][0] != "<":
            joining.add(int(parts[1], 16))
    for c in range(POINTS):
        ch = chr(c)
        low, kind = ch.lower(), unicodedata.category(ch)
        if len(low) != 1 or kind in ("Cn", "Cs", "Co") or c in joining or unicodedata.combining(ch) or not unicodedata.is_normalized("NFC", ch):
            continue
        kind = unicodedata.category(low)[0]
        lower[c] = ord(low)
        classes[c] = SPACE if low.isspace() and not 0x1C <= c <= 0x1F else LETTER if kind == "L" else NUMBER if kind == "N" else PUNCT
    for chars, kind in (("'", APOS), ("stmdSTMD", ONE), ("rR", R), ("vV", V), ("lL", LL), ("eE", E)):
        classes[[ord(ch) for ch in chars]] = kind
    return classes, lower


def run_states(classes: np.ndarray, table: np.ndarray) -> np.ndarray:
    """The state after every character, from the state between words."""
    flat, n = table.ravel(), len(classes)
    k = -(-n // CHUNK)
    grid = np.full(k * CHUNK, SPACE, np.uint8)
    grid[:n] = classes
    rows = np.ascontiguousarray(grid.reshape(k, CHUNK).T).astype(np.intp) * STATES
    maps = np.tile(np.arange(STATES, dtype=np.uint8), (k, 1))
    for row in rows:
        maps = flat[row[:, None] + maps]
    step = 1
    while step < k:  # maps[i] becomes the map of all chunks up to i
        maps[step:] = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), 1)
        step *= 2
    state = np.concatenate([np.full(1, S, np.uint8), maps[:-1, S]])
    out = np.empty((CHUNK, k), np.uint8)
    for i, row in enumerate(rows):
        out[i] = state = flat[row + state]
    return out.T.ravel()[:n]


def word_bounds(states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words, from the states: a transition into a word that the one before was not in."""
    before = np.concatenate([[S], states[:-1]])
    after = np.concatenate([states[1:], [S]])
    half = (states == AR) | (states == AV) | (states == AL)
    begins = (states == N) | (states == A) | ((states == L) & ~np.isin(before, (L, AR, AV, AL))) | ((states == P) & ~np.isin(before, (P, A))) | (half & (after != C))
    starts = np.flatnonzero(begins)
    open_end = np.append(np.flatnonzero(begins | (states == S)), len(states))
    return starts, open_end[np.searchsorted(open_end, starts, "right")]


class Merges:
    """The counting transducer of a byte-pair vocabulary with word ends, compiled as it is used.

    The encoding of a prefix is that of a shorter one and a last token, and two neighbours stand in an encoding exactly
    where the two alone encode to themselves. So what decides the future is, for each place behind which the bytes read
    may still become a token: which bytes these are, the last token of the encoding up to that place, and how many tokens
    it has more than the whole (fewer, as a rule). A state is the tuple of these."""

    def __init__(self, model: dict):
        end, ids = model["end_of_word_suffix"], model["vocab"]
        plain = [c for c in range(256) if 33 <= c <= 126 or 161 <= c <= 172 or 174 <= c <= 255]
        symbol = {chr(c): c for c in plain} | {chr(256 + i): c for i, c in enumerate(c for c in range(256) if c not in set(plain))}
        pairs = [x.split(" ") if isinstance(x, str) else x for x in model["merges"]]
        self.joined = {}
        for rank, (a, b) in enumerate(pairs):
            self.joined[ids[a], ids[b]] = (rank, ids[a + b])
        self.spelled: dict[int, list[int]] = {}
        for text, i in ids.items():
            body = text.removesuffix(end)
            if body and all(c in symbol for c in body):
                self.spelled[i] = [symbol[c] for c in body]
                if body != text:
                    self.spelled[i][-1] += 256
        self.single = {x[0]: i for i, x in self.spelled.items() if len(x) == 1}
        # a tree of all tokens: node and symbol to node, tokens that end at a node, nodes that go on
        self.child: dict[int, int] = {}
        self.token, self.goes_on = [-1], [True]
        for i, spelled in self.spelled.items():
            node = 0
            for x in spelled:
                self.goes_on[node] = True
                key = node * SYMBOLS + x
                if key not in self.child:
                    self.child[key] = len(self.token)
                    self.token.append(-1)
                    self.goes_on.append(False)
                node = self.child[key]
            self.token[node] = i
        self.agree: dict[tuple[int, int], bool] = {}
        self.clear()

    def clear(self) -> None:
        start = ((0, -1, 0),)
        self.states, self.number = [start], {start: 0}
        self.keys, self.next, self.adds = (np.zeros(0, np.int64) for _ in range(3))

    def encode(self, ids: list[int]) -> list[int]:
        """Merges pairs by their rank, the first of equals first."""
        ids = list(ids)
        while len(ids) > 1:
            rank, at = min((self.joined.get((ids[i], ids[i + 1]), (len(self.joined) + 1,))[0], i) for i in range(len(ids) - 1))
            if rank > len(self.joined):
                break
            ids[at : at + 2] = [self.joined[ids[at], ids[at + 1]][1]]
        return ids

    def stands(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: a word's start)."""
        if (a, b) not in self.agree:
            own = ([a] if a >= 0 else []) + [b]
            self.agree[a, b] = self.encode([self.single[x] for i in own for x in self.spelled[i]]) == own
        return self.agree[a, b]

    def compiled(self, state: int, x: int) -> tuple[int, int]:
        """The transition of a state by a symbol: next state, tokens added. A word's end leads to the start."""
        reached = [(self.child.get(node * SYMBOLS + x), last, more) for node, last, more in self.states[state]]
        reached = [r for r in reached if r[0] is not None]
        token, adds = next((self.token[node], more + 1) for node, last, more in reached if self.token[node] >= 0 and self.stands(last, self.token[node]))
        if x >= 256:
            return 0, adds
        after = tuple([(node, last, more - adds) for node, last, more in reached if self.goes_on[node]] + [(0, token, 0)])
        if after not in self.number:
            self.number[after] = len(self.states)
            self.states.append(after)
        return self.number[after], adds

    def step(self, state: np.ndarray, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Next states and added tokens of many transitions; those that are new are compiled."""
        key = state * SYMBOLS + x
        at = np.searchsorted(self.keys, key)
        new = np.ones(len(key), bool) if not len(self.keys) else self.keys[np.minimum(at, len(self.keys) - 1)] != key
        if new.any():
            fresh = np.unique(key[new])
            made = np.array([self.compiled(k // SYMBOLS, k % SYMBOLS) for k in fresh.tolist()], np.int64)
            keys = np.concatenate([self.keys, fresh])
            order = np.argsort(keys, kind="stable")
            self.keys = keys[order]
            self.next, self.adds = np.concatenate([self.next, made[:, 0]])[order], np.concatenate([self.adds, made[:, 1]])[order]
            at = np.searchsorted(self.keys, key)
        return self.next[at], self.adds[at]

    def count(self, words: list[bytes]) -> np.ndarray:
        """Tokens of each word."""
        if len(self.keys) > MAX_TRANSITIONS:
            self.clear()
        size = np.array([len(w) for w in words])
        first = np.concatenate([[0], np.cumsum(size)])
        symbols = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        symbols[first[1:] - 1] += 256
        total, state = np.zeros(len(words), np.int64), np.zeros(len(words), np.int64)
        for i in np.flatnonzero(size > LONG).tolist():
            total[i] = self.count_one(symbols[first[i] : first[i + 1]].tolist())
        order = np.argsort(-np.where(size > LONG, 0, size), kind="stable")  # the longest first: the words that go on are the first so many
        order, size = order[: int((size <= LONG).sum())], size[order[: int((size <= LONG).sum())]]
        for j in range(int(size[0]) if len(size) else 0):
            on = order[: int(np.searchsorted(-size, -j, "left"))]
            state[on], adds = self.step(state[on], symbols[first[on] + j])
            total[on] += adds
        return total

    def count_one(self, symbols: list[int]) -> int:
        state, total, known = 0, 0, {}
        for x in symbols:
            if (state, x) not in known:
                known[state, x] = self.compiled(state, x)
            state, adds = known[state, x]
            total += adds
        return total


class Counter:
    """Counts tokens of texts by one tokenizer file. Lives in a worker; its memory is bounded by MAX_TRANSITIONS."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        rules = json.loads(self.tokenizer.to_str())
        self.compiled = all(rules[part] == COMPILED[part] for part in ("normalizer", "pre_tokenizer")) and all(rules["model"].get(k) == v for k, v in COMPILED["model"].items()) and bool(rules["model"]["end_of_word_suffix"])
        self.known, self.held = {}, 0
        if not self.compiled:
            return
        self.merges = Merges(rules["model"])
        self.table, (self.classes, self.lower) = transitions(), alphabet()

    def whole(self, texts: list[str]) -> list[int]:
        return [len(x.ids) for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def strange(self, texts: list[str], classes: np.ndarray, offsets: np.ndarray) -> list[int]:
        """The texts that are given to the tokenizer whole."""
        found = {int(i) for i in np.unique(np.searchsorted(offsets, np.flatnonzero(classes == 255), "right") - 1)}
        return sorted(found | {i for i, x in enumerate(texts) if any(s in x for s in self.special)})

    def count(self, texts: list[str]) -> np.ndarray:
        if not self.compiled:
            return np.array(self.whole(texts), np.int64)
        points = np.frombuffer("\n".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        offsets = np.concatenate([[0], np.cumsum([len(x) + 1 for x in texts])])[:-1]
        points = np.minimum(points, POINTS)
        classes = self.classes[points]
        strange = self.strange(texts, classes, offsets)
        classes[classes == 255] = PUNCT
        lower = self.lower[points]
        starts, ends = word_bounds(run_states(classes, self.table))
        rows = np.searchsorted(offsets, starts, "right") - 1
        if strange:
            usual = ~np.isin(rows, strange)
            starts, ends, rows = starts[usual], ends[usual], rows[usual]
        total = np.bincount(rows, self.of_words(lower, starts, ends), len(texts)).astype(np.int64)
        for i, n in zip(strange, self.whole([texts[i] for i in strange]), strict=True):
            total[i] = n
        return total

    def of_words(self, lower: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Tokens of every word; a word that the worker remembers isn't run again."""
        data = lower.astype("<u4").tobytes()
        words = [data[a:b] for a, b in zip((4 * starts).tolist(), (4 * ends).tolist(), strict=True)]
        fresh = {w for w in words if w not in self.known}
        size = sum(map(len, fresh))
        if len(self.known) + len(fresh) > REMEMBERED or self.held + size > REMEMBERED_BYTES:
            self.known, self.held, fresh = {}, 0, set(words)
            size = sum(map(len, fresh))
        if fresh:
            self.held += size
            self.known.update(zip(fresh, self.merges.count([w.decode("utf-32-le").encode() for w in fresh]).tolist(), strict=True))
        return np.array([self.known[w] for w in words], np.int64)


_COUNTERS: dict[str, Counter] = {}


def count_tokens(docs: DataFrame, tokenizer_path: str, limit: int = LIMIT) -> DataFrame:
    """For every document: doc_id, n_bytes, n_tokens, over_limit. Null and empty texts have none; repeated rows are
    counted each for itself. An empty table gives no rows."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _COUNTERS.get(tokenizer_path) or _COUNTERS.setdefault(tokenizer_path, Counter(tokenizer_path))
        for batch in batches:
            _, offsets = text_bytes(batch.column("text"))
            size = np.diff(offsets)
            found = [counter.count([x or "" for x in batch.column("text").slice(a, b - a).to_pylist()]) for a, b in slices(size, STEP_BYTES)]
            n = np.concatenate(found) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(size), pa.array(n), pa.array(n > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return documents(docs).mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")
