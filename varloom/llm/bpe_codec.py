"""BPE encoding by dynamic programming over prefixes, and decoding.

For every prefix of a word there is exactly one token that can be the last of its encoding.  The candidates for a prefix
are the vocabulary's tokens that end there: a suffix automaton of the whole vocabulary, fed with the word's symbols, is in
the state of the longest suffix that is part of a token, and its suffix links lead to all shorter ones.  A candidate is the
right one if the token stored for the prefix before it is compatible with it, that is, if merging by rank would never join
symbols across the border of the two.  Back-pointers from the whole word give the ids.  This takes time linear in the
word's length, however long the word is.  The new words of a batch go through their prefixes in lockstep, in numpy arrays.

Words come from the tokenizer file's own steps: special-token strings are cut out of the raw text; the rest is normalized
(NFC, lower case), white space falls away, and the file's pattern gives the words; each word's last byte is the symbol
with the word-end mark.

Defined results: null and empty texts have no ids and decode to ''; ids decode to their tokens joined by one space, as
the library does for a file without a decoder.
"""
from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from varloom.llm.base import map_texts
from varloom.llm.token_counts import byte_symbols

#: Remembered units and words of a worker; at twice as many the older half is forgotten, which only costs time.
CACHE_UNITS = 200_000
CACHE_WORDS = 100_000
#: Slots for remembered pairs of tokens (a power of two).
CACHE_PAIRS = 1 << 20
#: Words whose prefixes are settled together, and the bytes beyond which a word is encoded alone.
LOCKSTEP = 1 << 14
LONG = 256
#: Longest unit or word that is remembered.
CACHE_CHARS = 48

_FAR = 2**31 - 1


class Recent(dict):
    """Ids of recent strings, packed; those of the generation before are in `older`."""

    def __init__(self, size: int):
        super().__init__()
        self.size, self.older = size, {}

    def unknown(self, strings: set[str]) -> set[str]:
        """Those not remembered; others of the generation before are taken over into this one."""
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()
        missing = strings.difference(self)
        again = missing.intersection(self.older)
        self.update({s: self.older[s] for s in again})
        return missing - again


def suffix_automaton(strings: Iterable[tuple[int, ...]], width: int) -> tuple[dict[int, int], list[int], list[int]]:
    """Suffix automaton of several strings: transitions (state * width + symbol), suffix links, longest lengths."""
    step: list[dict[int, int]] = [{}]
    link, longest = [-1], [0]

    def clone(p: int, symbol: int, q: int) -> int:
        step.append(dict(step[q]))
        link.append(link[q])
        longest.append(longest[p] + 1)
        new = len(step) - 1
        link[q] = new
        while p >= 0 and step[p].get(symbol) == q:
            step[p][symbol] = new
            p = link[p]
        return new

    for string in strings:
        last = 0
        for symbol in string:
            q = step[last].get(symbol, -1)
            if q >= 0:
                last = q if longest[q] == longest[last] + 1 else clone(last, symbol, q)
                continue
            step.append({})
            link.append(0)
            longest.append(longest[last] + 1)
            new, p = len(step) - 1, last
            while p >= 0 and symbol not in step[p]:
                step[p][symbol] = new
                p = link[p]
            if p >= 0:
                q = step[p][symbol]
                link[new] = q if longest[q] == longest[p] + 1 else clone(p, symbol, q)
            last = new
    return {s * width + c: t for s, edges in enumerate(step) for c, t in edges.items()}, link, longest


class IntTable:
    """Numbers by keys (both not negative) in an open-addressed hash table; a key that is not there gives -1."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << int(np.ceil(np.log2(max(2, len(keys)) * 2.5)))) - 1
        self.keys, self.values = np.full(self.mask + 1, -1, np.int64), np.full(self.mask + 1, -1, np.int32)
        left, slot = np.arange(len(keys)), slots(keys, self.mask)
        while len(left):
            free = left[self.keys[slot[left]] < 0]
            _, one = np.unique(slot[free], return_index=True)
            put = free[one]
            self.keys[slot[put]], self.values[slot[put]] = keys[put], values[put]
            left = np.setdiff1d(left, put)
            slot[left] = (slot[left] + 1) & self.mask

    def get(self, keys: np.ndarray) -> np.ndarray:
        slot = slots(keys, self.mask)
        there = self.keys[slot]
        out = self.values[slot]
        out[there != keys] = -1
        open_ = np.flatnonzero((there != keys) & (there >= 0))
        while len(open_):
            slot[open_] = (slot[open_] + 1) & self.mask
            there = self.keys[slot[open_]]
            hit = there == keys[open_]
            out[open_[hit]] = self.values[slot[open_[hit]]]
            open_ = open_[~hit & (there >= 0)]
        return out


def slots(keys: np.ndarray, mask: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.int64) & mask


def _flat(lists: list[list[tuple[int, int]]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lists of pairs, one after another: where each begins (and the last ends), and both members."""
    at = np.cumsum([0, *map(len, lists)])
    both = np.fromiter(chain.from_iterable(chain.from_iterable(lists)), np.int64, 2 * int(at[-1])).reshape(-1, 2)
    return at, both[:, 0].astype(np.int32), np.minimum(both[:, 1], _FAR).astype(np.int32)


@dataclass
class PrefixTables:
    """What encoding needs of a tokenizer file; some tens of MB, bounded by the file."""

    step: IntTable  # state * 512 + symbol -> state
    link: np.ndarray
    longest: np.ndarray
    ends: tuple[np.ndarray, np.ndarray, np.ndarray]  # tokens that are suffixes in a state, longest first: length, id
    rank: IntTable  # of a pair of ids, a * size + b
    right: tuple[np.ndarray, np.ndarray, np.ndarray]  # a token's last parts and when each is merged away
    left: tuple[np.ndarray, np.ndarray, np.ndarray]
    size: int
    names: list[str]
    special: dict[str, int]
    pattern: str
    mark: str

    @staticmethod
    def load(path: str) -> PrefixTables:
        with open(path, encoding="utf-8") as f:
            data = json.load(f)
        model = data["model"]
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        special = {t["content"]: t["id"] for t in data.get("added_tokens", [])}
        size = max([*vocab.values(), *special.values()]) + 1
        names = [""] * size
        for name, i in [*vocab.items(), *special.items()]:
            names[i] = name
        byte = {s: b for b, s in enumerate(byte_symbols())}

        def symbols(token: str) -> tuple[int, ...]:
            end = bool(mark) and token.endswith(mark)
            body = [byte[c] for c in (token[: -len(mark)] if end else token)]
            return (*body[:-1], body[-1] + 256 * end)

        spelled = {i: symbols(t) for t, i in vocab.items()}
        rank, split, at = {}, {}, {}
        for r, (a, b) in enumerate(merges):
            ia, ib, whole = vocab[a], vocab[b], vocab[a + b]
            rank[ia * size + ib] = r
            if whole in split or max(at.get(ia, -1), at.get(ib, -1)) >= r:
                raise ValueError("the merges are not a list of one merge per token in order of need")
            split[whole], at[whole] = (ia, ib), r
        right, left = [[(i, _FAR)] for i in range(size)], [[(i, _FAR)] for i in range(size)]
        for whole in sorted(split, key=at.get):
            a, b = split[whole]
            right[whole] += [(x, min(up, at[whole])) for x, up in right[b]]
            left[whole] += [(x, min(up, at[whole])) for x, up in left[a]]
        def first_crossing(a: int, b: int) -> int:
            """Rank of the first merge across the border of tokens a and b, or far off."""
            found = [r for x, x_up in right[a] for y, y_up in left[b] if (r := rank.get(x * size + y, _FAR)) < x_up and r <= y_up]
            return min(found, default=_FAR)

        sound: set[int] = set(spelled) - set(split)  # tokens that encode to themselves; others never come out
        for whole in sorted(split, key=at.get):
            a, b = split[whole]
            if a in sound and b in sound and first_crossing(a, b) == at[whole]:
                sound.add(whole)
        step, link, longest = suffix_automaton((spelled[i] for i in sorted(sound)), 512)
        ends: list[list[tuple[int, int]]] = [[] for _ in link]
        for i in sound:
            state = 0
            for c in spelled[i]:
                state = step[state * 512 + c]
            ends[state].append((len(spelled[i]), i))
        for s in sorted(range(1, len(link)), key=longest.__getitem__):
            ends[s] = sorted(ends[s], reverse=True) + ends[link[s]]
        table = lambda d: IntTable(np.array(list(d), np.int64), np.array(list(d.values()), np.int32))
        return PrefixTables(table(step), np.array(link, np.int32), np.array(longest, np.int32), _flat(ends), table(rank), _flat(right), _flat(left), size, names, special, _pattern(data), mark)

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether no merge would join symbols across the border of tokens a and b, for many pairs.

        A merge across the border joins a last part of a with a first part of b; it happens if its rank comes before those
        at which the two parts are merged away (at equal ranks the pair further left is merged first).
        """
        right_at, right, right_up = self.right
        left_at, left, left_up = self.left
        wide = left_at[b + 1] - left_at[b]
        n = (right_at[a + 1] - right_at[a]) * wide
        pair = np.repeat(np.arange(len(a)), n)
        inner = np.arange(len(pair)) - np.repeat(np.cumsum(n) - n, n)
        x, y = right_at[a][pair] + inner // wide[pair], left_at[b][pair] + inner % wide[pair]
        rank = self.rank.get(right[x].astype(np.int64) * self.size + left[y])
        out = np.ones(len(a), bool)
        out[pair[(rank >= 0) & (rank < right_up[x]) & (rank <= left_up[y])]] = False
        return out

    @cached_property
    def plain(self) -> tuple[dict[int, int], list[int], list[int], list[list[tuple[int, int]]]]:
        """step, link, longest and ends as Python's own containers: faster for one long word."""
        there = np.flatnonzero(self.step.keys >= 0)
        at, sizes, ids = (x.tolist() for x in self.ends)
        both = list(zip(sizes, ids))
        return dict(zip(self.step.keys[there].tolist(), self.step.values[there].tolist())), self.link.tolist(), self.longest.tolist(), [both[i:j] for i, j in zip(at, at[1:])]


def _pattern(data: dict) -> str:
    for part in data["pre_tokenizer"].get("pretokenizers", []):
        if part["type"] == "Split":
            return part["pattern"]["Regex"]
    raise ValueError("the file has no pattern for words")


class Encoder:
    """Encodes texts unit by unit: units are what white space separates, and words are what the pattern finds in them."""

    def __init__(self, tables: PrefixTables):
        import regex

        self.t = tables
        self.kind = np.dtype(np.uint16 if tables.size <= 1 << 16 else np.uint32)
        self.find = regex.compile(tables.pattern).findall
        if self.find(" \n\t"):
            raise ValueError("the file's pattern finds words with white space")
        self.find_marked = regex.compile(tables.pattern + "|\n").findall
        marks = sorted(tables.special, key=len, reverse=True)
        self.special = regex.compile("(" + "|".join(map(regex.escape, marks)) + ")").split if marks else None
        self.marks = marks
        self.digits = [str(i) for i in range(tables.size)]
        self.pairs, self.answers = np.full(CACHE_PAIRS, -1, np.int64), np.zeros(CACHE_PAIRS, bool)
        self.words, self.units = Recent(CACHE_WORDS), Recent(CACHE_UNITS)
        self.odd = re.compile("[\x1c-\x1f]").search
        self.space = re.compile(r"[\x20\x09-\x0D\x85\xa0]+").split

    def joined(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`compatible`, with the last answers remembered by a hash of the pair."""
        key = a.astype(np.int64) * self.t.size + b
        slot = slots(key, len(self.pairs) - 1)
        out = self.answers[slot]
        new = np.flatnonzero(self.pairs[slot] != key)
        if len(new):
            different, back = np.unique(key[new], return_inverse=True)
            out[new] = self.t.compatible(different // self.t.size, different % self.t.size)[back]
            self.pairs[slot[new]] = key[new]
            # of several new pairs in one slot the last was stored
            own = new[self.pairs[slot[new]] == key[new]]
            self.answers[slot[own]] = out[own]
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Packed ids of words, LOCKSTEP words at a time and long ones alone."""
        data = [w.encode() for w in words]
        out = [b""] * len(data)
        order = sorted(range(len(data)), key=lambda i: -len(data[i]))
        long = sum(len(d) > LONG for d in data)
        for i in order[:long]:
            out[i] = self.long_word(data[i])
        for i in range(long, len(order), LOCKSTEP):
            part = order[i : i + LOCKSTEP]
            for j, ids in zip(part, self.lockstep([data[j] for j in part])):
                out[j] = ids
        return out

    def lockstep(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words, given by falling length: the prefixes of one length of all words are settled at once."""
        t, mark = self.t, 256 if self.t.mark else 0
        sizes = np.array([len(w) for w in words])
        begins = np.cumsum(sizes) - sizes
        flat = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        flat[begins + sizes - 1] += mark
        ends_at, ends_size, ends_id = t.ends
        # for each prefix: its last token, and the length of the prefix before that
        last, back = (np.zeros((sizes[0] + 1, len(words)), np.int32) for _ in range(2))
        states, lengths = np.zeros(len(words), np.int64), np.zeros(len(words), np.int32)
        for end in range(1, sizes[0] + 1):
            n = np.searchsorted(-sizes, -end, side="right")
            symbol, state, length = flat[begins[:n] + end - 1], states[:n], lengths[:n]
            to = t.step.get(state * 512 + symbol)
            stuck = np.flatnonzero(to < 0)
            while len(stuck):
                less = t.link[state[stuck]]
                if less.min() < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                state[stuck], length[stuck] = less, t.longest[less]
                to[stuck] = t.step.get(state[stuck] * 512 + symbol[stuck])
                stuck = stuck[to[stuck] < 0]
            state[:] = to
            length += 1
            open_, at = np.arange(n), ends_at[to]
            while len(open_):
                size, token = ends_size[at], ends_id[at]
                fits = size <= length[open_]
                right = fits & (size == end)
                test = np.flatnonzero(fits & (size < end))
                right[test] = self.joined(last[end - size[test], open_[test]], token[test])
                done = open_[right]
                last[end, done], back[end, done] = token[right], end - size[right]
                open_, at = open_[~right], at[~right] + 1
        return self._followed(sizes, last, back)

    def _followed(self, sizes: np.ndarray, last: np.ndarray, back: np.ndarray) -> list[bytes]:
        """Ids of all words by their back-pointers."""
        end, open_, steps = sizes.copy(), np.arange(len(sizes)), []
        while len(open_):
            at = end[open_]
            steps.append((open_, last[at, open_]))
            end[open_] = back[at, open_]
            open_ = open_[end[open_] > 0]
        words = np.concatenate([w for w, _ in steps])
        count = np.bincount(words, minlength=len(sizes))
        ends = np.cumsum(count)
        ids = np.empty(len(words), self.kind)
        for i, (w, token) in enumerate(steps):
            ids[ends[w] - 1 - i] = token
        data, at = ids.tobytes(), (ends * self.kind.itemsize).tolist()
        return [data[i:j] for i, j in zip([0, *at], at)]

    def long_word(self, word: bytes) -> bytes:
        """Packed ids of one word, prefix by prefix."""
        t = self.t
        step, link, longest, ends = t.plain
        symbols = [*word[:-1], word[-1] + (256 if t.mark else 0)]
        last, back, state, length = [-1], [0], 0, 0
        pairs: dict[tuple[int, int], bool] = {}
        for end, c in enumerate(symbols, 1):
            while (to := step.get(state * 512 + c, -1)) < 0:
                state = link[state]
                if state < 0:
                    raise ValueError("a byte is missing from the vocabulary")
                length = longest[state]
            state, length = to, length + 1
            for n, token in ends[state]:
                if n > length:
                    continue
                if n == end:
                    break
                pair = last[end - n], token
                if pair not in pairs:
                    pairs[pair] = bool(t.compatible(*(np.array([x]) for x in pair))[0])
                if pairs[pair]:
                    break
            last.append(token)
            back.append(end - n)
        ids = []
        while end:
            ids.append(last[end])
            end = back[end]
        return np.array(ids[::-1], self.kind).tobytes()

    def learn(self, texts: list[str]) -> None:
        """Encode all units of many texts that are not remembered."""
        units: set[str] = set()
        for text in texts:
            units.update(text.split())
        new = list(self.units.unknown({u for u in units if len(u) <= CACHE_CHARS}))
        self.units.update(zip(new, self.encode_units(new)))

    def encode_units(self, units: list[str]) -> list[bytes]:
        """Packed ids of units; their words are found in one pass and encoded together."""
        if not units:
            return []
        found = self.find_marked(self.normal("\n".join(units)))
        words = set(found)
        words.discard("\n")
        fresh = list(self.words.unknown(words))
        self.words.update(zip(fresh, self.encode_words(fresh)))
        known, out, held = self.words, [], []
        for w in found:
            if w == "\n":
                out.append(held[0] if len(held) == 1 else b"".join(held))
                held = []
            else:
                held.append(known[w])
        out.append(b"".join(held))
        for w in fresh:
            if len(w) > CACHE_CHARS:
                del known[w]
        return out

    @staticmethod
    def normal(text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # no final sigma when lower-casing
        return text.lower()

    def packed(self, text: str) -> bytes:
        """All ids of a text, packed; special strings are one id each."""
        if self.special and any(m in text for m in self.marks):
            special = self.t.special
            return b"".join([self.kind.type(special[p]).tobytes() if p in special else self.packed(p) for p in self.special(text) if p])
        units = self.space(text) if self.odd(text) else text.split()
        try:
            return b"".join(map(self.units.__getitem__, units))
        except KeyError:
            known = self.units
            new = [u for u in dict.fromkeys(units) if u not in known]
            own = dict(zip(new, self.encode_units(new)))
            return b"".join([known[u] if u in known else own[u] for u in units])

    def ids(self, text: str) -> np.ndarray:
        return np.frombuffer(self.packed(text), self.kind)

    def encode(self, text: str) -> list[int]:
        return self.ids(text).tolist()

    def decode(self, ids: Iterable[int]) -> str:
        return " ".join([self.t.names[i] for i in ids])


def _encoder(tables: PrefixTables) -> Encoder:
    """One encoder for each worker process: what it remembers serves all its tasks."""
    if not hasattr(tables, "encoder"):
        tables.encoder = Encoder(tables)
    return tables.encoder


def _broadcast(docs: DataFrame, vocabulary: str):
    return docs.sparkSession.sparkContext.broadcast(PrefixTables.load(vocabulary))


def encode(docs: DataFrame, vocabulary: str, text_col: str = "text", ids_col: str = "ids", drop_text: bool = False) -> DataFrame:
    """Adds the ids (array<int>) of each text."""
    tables = _broadcast(docs, vocabulary)

    def make() -> Callable:
        e = _encoder(tables.value)

        def work(texts: list[str]) -> dict:
            e.learn(texts)
            return {ids_col: _lists([e.ids(t) for t in texts])}

        return work

    return map_texts(docs, make, f"`{ids_col}` array<int>", text_col, drop_text)


def decode(rows: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the text of each row's ids (null: '')."""
    tables = _broadcast(rows, vocabulary)

    def make() -> Callable:
        names = tables.value.names
        return lambda lists: {out_col: [" ".join([names[i] for i in ids]) for ids in lists]}

    return map_texts(rows, make, f"`{out_col}` string", ids_col)


def _lists(ids: list[np.ndarray]) -> pa.Array:
    """Arrow lists of ids."""
    ends = np.cumsum([0, *map(len, ids)])
    values = np.concatenate([np.zeros(0, np.uint16), *ids]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values))


def codec_digests(docs: DataFrame, vocabulary: str, text_col: str = "text", drop_text: bool = False, with_ids: bool = False) -> DataFrame:
    """Adds n_tokens, ids_sha256 (of the decimal ids joined by a space) and decoded_sha256 to each row, and ids if asked."""
    tables = _broadcast(docs, vocabulary)

    def make() -> Callable:
        e = _encoder(tables.value)
        sha = lambda parts: hashlib.sha256(" ".join(parts).encode()).hexdigest()
        digits, names = e.digits.__getitem__, e.t.names.__getitem__

        def work(texts: list[str]) -> dict:
            n, digests, decoded, kept = [], [], [], []
            e.learn(texts)
            for t in texts:
                ids = e.ids(t)
                some = ids.tolist()
                n.append(len(some))
                digests.append(sha(map(digits, some)))
                decoded.append(sha(map(names, some)))
                if with_ids:
                    kept.append(ids)
            out = {"n_tokens": n, "ids_sha256": digests, "decoded_sha256": decoded}
            if with_ids:
                out["ids"] = _lists(kept)
            return out

        return work

    return map_texts(docs, make, "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids, text_col, drop_text)
