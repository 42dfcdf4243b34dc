"""Byte-pair encoding and decoding by speculation and verification.

A word's tokens are guessed by greedy longest match. The guess is what exact
merging gives if every token is one that merging can make by itself and no two
neighbours would have been merged across their border first; the borders of a
whole batch of words are tested at once with numpy. Only the words that fail
are merged exactly, rank by rank.

Cases: null and empty texts give no tokens and an empty decoded text; special
tokens that occur in a text are taken as such, as the tokenizers library does;
repeated rows are encoded alike; other columns are kept unless they clash with
the results, which win.
"""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from methgrid.llm.textnp import flat, pieces, span_hash, words

END = ""  # stands for the mark of a word's end while tokens are matched
MARK = "</w>"
NEVER = np.int64(1 << 40)
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
#: White space as the vocabulary's normaliser has it: without the separators U+001C to U+001F that str.split() takes too.
BLANK = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Runs whose tokens a worker keeps; beyond it the rarer ones are dropped, which bounds its memory.
KEPT_WORDS = 400_000


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies use for each byte."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return [chr(b) if b in set(plain) else chr(256 + rest.index(b)) for b in range(256)]


class Table:
    """Whole numbers to values: open addressing in a few arrays, each for what collides in the one before."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.shift = np.uint64(64 - 2 - int(len(keys)).bit_length())
        self.parts = []
        for factor in (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3):
            where = (keys.astype(np.uint64) * np.uint64(factor)) >> self.shift
            own, own_values = np.full(1 << int(64 - int(self.shift)), -1), np.zeros(1 << int(64 - int(self.shift)), np.int64)
            own[where] = keys
            held = own[where] == keys
            own_values[where[held]] = values[held]
            self.parts.append((np.uint64(factor), own, own_values))
            keys, values = keys[~held], values[~held]
        assert not len(keys), "a table needs another part"

    def find(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The values, 0 where there is none, and whether there is one."""
        (factor, own, own_values), *rest = self.parts
        where = (keys.astype(np.uint64) * factor) >> self.shift
        there = own[where]
        found = there == keys
        values = np.where(found, own_values[where], 0)
        open_ = np.flatnonzero(~found & (there >= 0))
        for factor, own, own_values in rest:
            if not len(open_):
                break
            where = (keys[open_].astype(np.uint64) * factor) >> self.shift
            there = own[where]
            hit = there == keys[open_]
            found[open_[hit]] = True
            values[open_[hit]] = own_values[where[hit]]
            open_ = open_[~hit & (there >= 0)]
        return values, found


class Vocabulary:
    """The merges of one vocabulary file, ready for matching and checking."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        assert model["type"] == "BPE" and model["end_of_word_suffix"] == MARK and spec["decoder"] is None, "another kind of vocabulary"
        vocab = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"] if t["special"]}
        self.text = {i: t for t, i in vocab.items()} | {i: t for t, i in self.special.items()}
        size = max(self.text) + 1
        self.letter = byte_letters()
        self.form: dict[str, int] = {}  # a token's letters, with END, to its id
        for letter in self.letter:
            self.form[letter] = vocab[letter]
            self.form[letter + END] = vocab[letter + MARK]
        shape = {i: f for f, i in self.form.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        age = np.full(size, -1, np.int64)  # rank of the merge that makes a token; -1: a letter
        left, right = np.arange(size), np.arange(size)
        for k, (a, b) in enumerate(pairs):
            x, y, made = vocab[a], vocab[b], vocab[a + b]
            self.rank[x, y] = (k, made)
            if age[made] < 0 and x in shape and y in shape and made not in shape:
                shape[made] = shape[x] + shape[y]
                self.form[shape[made]] = made
                age[made], left[made], right[made] = k, x, y
        self.age, self.left, self.right = age, left, right
        keys = np.array([x << 20 | y for x, y in self.rank], np.int64)
        self.pair_table = Table(keys, np.arange(len(keys)))
        self.pair_rank, self.pair_made = (np.array(x, np.int64) for x in zip(*self.rank.values()))
        nodes, arcs = {"": 0}, {}
        for f in self.form:
            for n in range(len(f)):
                letter = 511 if f[n] == END else ord(f[n])
                arcs[nodes[f[:n]] << 9 | letter] = nodes.setdefault(f[: n + 1], len(nodes))
        self.tree = Table(np.array([*arcs], np.int64), np.array([*arcs.values()]))
        self.node_token = np.array([self.form.get(f, -1) for f in nodes])
        self.letter_id = np.array([[vocab[x] for x in self.letter], [vocab[x + MARK] for x in self.letter]])
        self.marked = np.arange(size)
        self.marked[self.letter_id[0]] = self.letter_id[1]
        self.code = {c: b for b, c in enumerate(self.letter)}
        forms = [*self.form]
        ids, sizes = self.merge(forms)
        self.stable = np.zeros(size, bool)  # tokens that merging makes of their own letters
        made = np.array([self.form[f] for f in forms])
        self.stable[made] = (sizes == 1) & (ids[np.cumsum(sizes) - sizes] == made)

    def pairs(self, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The rank of merging each a with its b (NEVER if there is no such merge) and the place of the merge."""
        at, found = self.pair_table.find(a << 20 | b)
        return np.where(found, self.pair_rank[at], NEVER), at

    def merge(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Exact merging, all words side by side: in each round every word merges its pair of lowest rank, leftmost first among overlapping ones. The ids one after another, and how many each word has."""
        marked = np.fromiter((w.endswith(END) for w in words), bool, len(words))
        sizes = np.fromiter(map(len, words), np.int64, len(words)) - marked
        code = self.code
        ids = self.letter_id[0][np.fromiter((code[c] for w in words for c in w if c != END), np.int64, int(sizes.sum()))]
        last = np.cumsum(sizes) - 1
        ids[last[marked]] = self.marked[ids[last[marked]]]
        word = np.repeat(np.arange(len(words)), sizes)
        done_ids, done_word = [], []
        while len(ids):
            rank = np.full(len(ids), NEVER)
            place = np.zeros(len(ids), np.int64)
            inner = np.flatnonzero(word[1:] == word[:-1])
            rank[inner], place[inner] = self.pairs(ids[inner], ids[inner + 1])
            starts = np.flatnonzero(np.r_[True, word[1:] != word[:-1]])
            lengths = np.diff(np.r_[starts, len(ids)])
            least = np.repeat(np.minimum.reduceat(rank, starts), lengths)
            over = least == NEVER
            done_ids.append(ids[over])
            done_word.append(word[over])
            hit = np.flatnonzero((rank == least) & ~over)
            if not len(hit):
                break
            begins = np.r_[True, np.diff(hit) != 1]
            hit = hit[(np.arange(len(hit)) - np.flatnonzero(begins)[np.cumsum(begins) - 1]) % 2 == 0]
            ids[hit] = self.pair_made[place[hit]]
            keep = ~over
            keep[hit + 1] = False
            ids, word = ids[keep], word[keep]
        ids, word = np.concatenate(done_ids or [ids]), np.concatenate(done_word or [word])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def guess(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Greedy longest match, all words side by side: each walks down the tree of the tokens' letters and takes the last token that it passed when it falls out. The ids one after another, and how many each word has."""
        letters = np.frombuffer("".join(words).encode("utf-16-le"), np.uint16).astype(np.int64)
        letters = np.append(np.where(letters == ord(END), 511, letters), 0)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        stop = np.cumsum(sizes)
        begin = stop - sizes
        word, at, node, token, after = np.arange(len(words)), begin.copy(), np.zeros(len(words), np.int64), np.zeros(len(words), np.int64), begin.copy()
        out_word, out_ids = [], []
        while len(word):
            to, found = self.tree.find(node << 9 | letters[at])
            found &= at < stop[word]
            node, at = np.where(found, to, node), at + found
            full = found & (self.node_token[node] >= 0) & (at != stop[word] - 1)  # END never stands alone
            token, after = np.where(full, self.node_token[node], token), np.where(full, at, after)
            if (fell := ~found).any():
                out_word.append(word[fell])
                out_ids.append(token[fell])
                node, at = np.where(fell, 0, node), np.where(fell, after, at)
                if (over := fell & (after >= stop[word])).any():
                    word, at, node, token, after = (x[~over] for x in (word, at, node, token, after))
        ids, word = np.concatenate(out_ids or [word]), np.concatenate(out_word or [word])
        return ids[np.argsort(word, kind="stable")], np.bincount(word, minlength=len(words))

    def apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether neighbours a, b stay apart: unmake their merges, latest first, and see whether any pair that faces the border would have merged earlier."""
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), NEVER)  # ranks below it still could merge across the border
        good, open_ = np.ones(len(a), bool), np.arange(len(a))
        while len(open_):
            x, y, top = a[open_], b[open_], limit[open_]
            bad = self.pairs(x, y)[0] < top
            good[open_[bad]] = False
            age_x, age_y = self.age[x], self.age[y]
            ended = bad | ((age_x < 0) & (age_y < 0))
            of_x = age_x > age_y
            # Until the left token was made, a pair of its rank at the border came later (it lies to the right); for the right token it came first.
            limit[open_] = np.where(of_x, age_x, age_y + 1)
            a[open_], b[open_] = np.where(of_x, self.right[x], x), np.where(of_x, y, self.left[y])
            open_ = open_[~ended]
        return good

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray, int]:
        """The ids of words that end in END, one after another, how many each has, and how many words needed exact merging."""
        ids, sizes = self.guess(words)
        word = np.repeat(np.arange(len(words)), sizes)
        wrong = np.zeros(len(words), bool)
        wrong[word[~self.stable[ids]]] = True
        inner = np.flatnonzero(word[1:] == word[:-1])
        keys, back = np.unique(ids[inner] << 32 | ids[inner + 1], return_inverse=True)
        wrong[word[inner[~self.apart(keys >> 32, keys & 0xFFFFFFFF)[back]]]] = True
        failed = np.flatnonzero(wrong)
        if len(failed):
            exact, exact_sizes = self.merge([words[k] for k in failed])
            good = ~wrong[word]
            ids = np.concatenate([ids[good], exact])
            ids = ids[np.argsort(np.concatenate([word[good], np.repeat(failed, exact_sizes)]), kind="stable")]
            sizes[failed] = exact_sizes
        return ids, sizes, len(failed)


@cache
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


class Coder:
    """Encodes batches of texts; keeps the tokens of the runs of bytes between ASCII white space that it has met, by a 64-bit hash."""

    def __init__(self, path: str):
        self.v = vocabulary(path)
        self.split = re.compile("(" + "|".join(map(re.escape, sorted(self.v.special, key=len, reverse=True))) + ")")
        self.letters = {b: letter for b, letter in enumerate(self.v.letter)}
        self.failed = 0
        self.forget()
        names = [(self.v.text.get(i, "") + " ").encode() for i in range(max(self.v.text) + 1)]
        self.name_size = np.array([*map(len, names)])
        self.name_at = np.cumsum(self.name_size) - self.name_size
        self.names = np.frombuffer(b"".join(names), np.uint8)

    def forget(self) -> None:
        """Empties the store: sorted hashes, where their ids start in the pool and how many they are, and how often each was met."""
        self.known, self.begin, self.size, self.met, self.pool = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, "<u4")

    def parts(self, run: str) -> list[str]:
        """The words of one run, normalised as the vocabulary asks; special tokens are marked by a leading blank."""
        out: list[str] = []
        for k, part in enumerate(self.split.split(run) if any(x in run for x in self.v.special) else [run]):
            if k % 2:
                out.append(" " + part)
                continue
            part = unicodedata.normalize("NFC", part)
            part = (part.replace("Σ", "σ") if "Σ" in part else part).lower()
            for x in [part] if part.isascii() else BLANK.split(part):
                out += (x,) if x.isalpha() else WORD.findall(x)
        return out

    def learn(self, runs: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the runs, one after another, and how many each has."""
        number: dict[str, int] = {}
        own: list[int] = []
        counts: list[int] = []
        for run in runs:
            found = self.parts(run)
            counts.append(len(found))
            own += [number.setdefault(w, len(number)) for w in found]
        letters = self.letters
        plain = [w for w in number if w[0] != " "]
        ids, sizes, failed = self.v.encode_words([w.encode().decode("latin-1").translate(letters) + END for w in plain])
        self.failed += failed
        special = [w for w in number if w[0] == " "]
        slot = {w: k for k, w in enumerate([*plain, *special])}
        ids, sizes = np.r_[ids, [self.v.special[w[1:]] for w in special]].astype("<u4"), np.r_[sizes, np.ones(len(special), np.int64)].astype(np.int64)
        own_ = np.array([slot[w] for w in number], np.int64)[np.array(own, np.int64)] if own else np.zeros(0, np.int64)
        size = sizes[own_]
        return gather(ids, (np.cumsum(sizes) - sizes)[own_], size), np.r_[0, np.cumsum(size)][np.r_[0, np.cumsum(counts, dtype=np.int64)]]

    def encode(self, column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of a column of texts, one after another, and where those of each text start (one more entry at the end)."""
        data, offsets = flat(column)
        starts, ends, first = words(data, offsets)
        hashes, index, back = np.unique(span_hash(data, starts, ends), return_index=True, return_inverse=True)
        at = np.minimum(np.searchsorted(self.known, hashes), max(len(self.known) - 1, 0))
        new = self.known[at] != hashes if len(self.known) else np.ones(len(hashes), bool)
        if new.any():
            raw = data.tobytes()
            chosen = index[new]
            ids, where = self.learn([raw[a:b].decode() for a, b in zip(starts[chosen].tolist(), ends[chosen].tolist())])
            self.known = np.r_[self.known, hashes[new]]
            self.begin, self.size = np.r_[self.begin, len(self.pool) + where[:-1]], np.r_[self.size, np.diff(where)]
            self.met, self.pool = np.r_[self.met, np.zeros(len(chosen), np.int64)], np.r_[self.pool, ids]
            order = np.argsort(self.known)
            self.known, self.begin, self.size, self.met = self.known[order], self.begin[order], self.size[order], self.met[order]
            at = np.searchsorted(self.known, hashes)
        self.met[at] += 1
        run = at[back]
        size = self.size[run]
        out = gather(self.pool, self.begin[run], size), np.r_[0, np.cumsum(size)][first]
        if len(self.known) > KEPT_WORDS:
            self.thin()
        return out

    def thin(self) -> None:
        """Keeps the runs met most often, half of the store at most."""
        keep = np.sort(np.argsort(-self.met, kind="stable")[: KEPT_WORDS // 2])
        keep = keep[self.met[keep] > 1]
        size = self.size[keep]
        self.pool = gather(self.pool, self.begin[keep], size)
        self.known, self.begin, self.size, self.met = self.known[keep], np.cumsum(size) - size, size, self.met[keep] // 2

    def decode(self, ids: np.ndarray, where: np.ndarray) -> pa.Array:
        """The texts of ids that encode() gave: the tokens' own spellings joined by blanks, as the library does without a decoder."""
        size = self.name_size[ids]
        ends = np.r_[0, np.cumsum(size)][where]
        blank = np.diff(where) > 0  # the last token's blank goes
        data = gather(self.names, self.name_at[ids], size)
        keep = np.ones(len(data), bool)
        keep[ends[1:][blank] - 1] = False
        offsets = np.r_[0, np.cumsum(np.diff(ends) - blank)]
        return pa.LargeStringArray.from_buffers(len(where) - 1, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data[keep]))


def gather(pool: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The slices of ``pool`` that start at ``begin``, one after another."""
    ends = np.cumsum(size)
    return pool[np.repeat(begin - (ends - size), size) + np.arange(int(ends[-1]) if len(ends) else 0)]


_CODERS: dict[str, Coder] = {}


def encode_decode(docs: DataFrame, path: str, text: str = "text") -> DataFrame:
    """``docs`` without its text, plus ``n_tokens`` (long), ``ids`` (binary, little-endian unsigned 32-bit integers) and ``decoded`` (string)."""
    made = {"n_tokens", "ids", "decoded"}
    rest = [c for c in docs.columns if c != text and c not in made]
    slim = docs.select(*[docs[c] for c in rest], docs[text].alias("__text"))
    schema = T.StructType([f for f in slim.schema.fields[:-1]] + [T.StructField("n_tokens", T.LongType()), T.StructField("ids", T.BinaryType()), T.StructField("decoded", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _CODERS:
            _CODERS[path] = Coder(path)
        coder = _CODERS[path]
        for batch in pieces(batches, "__text"):
            ids, where = coder.encode(batch.column("__text"))
            packed = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(batch), [None, pa.py_buffer((where * 4).astype(np.int64)), pa.py_buffer(ids)])
            columns = [batch.column(c) for c in rest] + [pa.array(np.diff(where), pa.int64()), packed.cast(pa.binary()), coder.decode(ids, where).cast(pa.string())]
            yield pa.RecordBatch.from_arrays(columns, [*rest, "n_tokens", "ids", "decoded"])

    return slim.mapInArrow(run, schema)
