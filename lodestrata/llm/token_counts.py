"""Token counts under byte-level BPE by rank-synchronous merging of arrays.

Texts are cut into pre-tokens; the distinct new ones of a batch lie one after another in a ragged numpy array.
In each round every sequence applies its lowest-rank pair, at all its places at once, until no sequence has a
pair left; the surviving symbols are its tokens.  This equals merging pair by pair as long as a merge makes no
pair of a lower or equal rank, which is checked when the vocabulary is read."""

from __future__ import annotations

import heapq
import json
import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType
from tokenizers import Tokenizer

from .common import Guard, small_batches

# The pattern of this family of tokenizers, and Unicode's White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPACE = "\t\n\x0b\f\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"

#: Entries, and characters in them, of the cache of one worker; a full cache is emptied.
CACHE, CACHE_CHARS = 400_000, 8_000_000
#: Sequences above so many symbols are merged one by one, over lists of places by rank.
LONG = 192
NONE = np.iinfo(np.int32).max


class Pairs:
    """The merge of a pair of symbols, by open addressing."""

    def __init__(self, left: np.ndarray, right: np.ndarray):
        self.bits = max(4, int(len(left)).bit_length() + 2)
        self.keys = np.full(1 << self.bits, -1, dtype=np.int64)
        self.ranks = np.full(1 << self.bits, NONE, dtype=np.int32)
        key, todo = left.astype(np.int64) << 32 | right, np.arange(len(left))
        slot = self._slot(key)
        while len(todo):
            free = self.keys[slot] < 0
            _, first = np.unique(np.where(free, slot, -1 - np.arange(len(slot))), return_index=True)
            won = np.zeros(len(todo), dtype=bool)
            won[first] = True
            won &= free
            self.keys[slot[won]], self.ranks[slot[won]] = key[todo[won]], todo[won]
            todo, slot = todo[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def __call__(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE where no merge takes them."""
        key = left.astype(np.int64) << 32 | right
        slot = self._slot(key)
        found = self.keys[slot]
        out = np.where(found == key, self.ranks[slot], NONE)
        todo = np.flatnonzero((found != key) & (found >= 0))
        slot = slot[todo]
        while len(todo):
            slot = (slot + 1) & (len(self.keys) - 1)
            found = self.keys[slot]
            hit = found == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            rest = ~hit & (found >= 0)
            todo, slot = todo[rest], slot[rest]
        return out


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself if printable, else one from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(hidden)) for b in range(256)]


class ByteBpe:
    """A byte-level BPE vocabulary in the tokenizers library's JSON."""

    def __init__(self, content: str):
        spec = json.loads(content)
        model, before = spec["model"], spec["pre_tokenizer"] or {}
        plain = model["type"] == "BPE" and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if not plain or spec["normalizer"] or before.get("type") != "ByteLevel" or before["add_prefix_space"] or not before["use_regex"]:
            raise ValueError("only byte-level BPE without normaliser, prefix space, dropout or affixes is supported")
        vocab, letters = model["vocab"], byte_letters()
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.byte_id = np.array([vocab[x] for x in letters], dtype=np.int32)
        self.left = np.array([vocab[a] for a, _ in merges], dtype=np.int32)
        self.right = np.array([vocab[b] for _, b in merges], dtype=np.int32)
        self.made = np.array([vocab[a + b] for a, b in merges], dtype=np.int32)
        of_letter = {x: bytes([b]) for b, x in enumerate(letters)}
        self.surface = [b""] * (1 + max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]))
        for piece, i in vocab.items():
            self.surface[i] = b"".join(of_letter.get(x, x.encode()) for x in piece)
        born = np.full(len(self.surface), -1, dtype=np.int64)
        born[self.made] = np.arange(len(merges))
        if len(np.unique(self.made)) < len(merges) or (born[self.left] >= np.arange(len(merges))).any() or (born[self.right] >= np.arange(len(merges))).any():
            raise ValueError("merges must make each symbol once, after its parts")
        self.pairs = Pairs(self.left, self.right)
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in spec["added_tokens"]):
            raise ValueError("added tokens that look at their surroundings are not supported")
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.split_added = re.compile("|".join(map(re.escape, sorted(self.added, key=len, reverse=True)))).split if self.added else None
        # No pre-token crosses from one of these chunks into the next, and none looks past its chunk.
        self.chunks = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+").findall
        self.pretokens = regex.compile(PATTERN).findall
        self._library = Tokenizer.from_str(content).pre_tokenizer.pre_tokenize_str
        self.irregular = re.compile(f" [{SPACE}]").search
        self._counts: dict[str, dict] = {"": {}, " ": {}, "held": {}}
        self._ids: dict[str, dict] = {"": {}, " ": {}, "held": {}}

    def merge(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """The tokens of all words, one after another, and how many each has."""
        size = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
        flat = self.byte_id[np.frombuffer(b"".join(words), dtype=np.uint8)]
        count = np.zeros(len(words), dtype=np.int64)
        done: list[tuple[np.ndarray, np.ndarray]] = []  # the word of each token, tokens
        begin = np.cumsum(size) - size
        for k in np.flatnonzero(size > LONG).tolist():
            own = self._merge_long(flat[begin[k] : begin[k] + size[k]])
            count[k] = len(own)
            done.append((np.full(len(own), k), own))
        word = np.repeat(np.arange(len(words)), size)
        brief = size[word] <= LONG
        symbol, word = flat[brief], word[brief]
        rank = np.full(len(symbol), NONE, dtype=np.int32)
        inner = np.flatnonzero(word[1:] == word[:-1])
        rank[inner] = self.pairs(symbol[inner], symbol[inner + 1])
        while len(symbol):
            starts = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
            length = np.diff(np.append(starts, len(symbol)))
            lowest = np.minimum.reduceat(rank, starts)
            open_ = lowest < NONE
            if not open_.all():
                count[word[starts[~open_]]] = length[~open_]
                goes = np.repeat(~open_, length)
                done.append((word[goes], symbol[goes]))
                symbol, word, rank, length, lowest = symbol[~goes], word[~goes], rank[~goes], length[open_], lowest[open_]
                if not len(symbol):
                    break
            at = np.flatnonzero(rank == np.repeat(lowest, length))
            # Of overlapping places of one pair, which are a run of one symbol, every other one merges.
            fresh = np.concatenate([[True], at[1:] != at[:-1] + 1])
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            symbol[at] = self.made[rank[at]]
            stays = np.ones(len(symbol), dtype=bool)
            stays[at + 1] = False
            place = np.cumsum(stays) - 1
            symbol, word, rank, at = symbol[stays], word[stays], rank[stays], place[at]
            touched = np.zeros(len(symbol), dtype=bool)
            touched[at] = touched[np.maximum(at - 1, 0)] = True
            near = np.flatnonzero(touched)
            rank[near] = NONE
            near = near[near < len(symbol) - 1]
            near = near[word[near] == word[near + 1]]
            rank[near] = self.pairs(symbol[near], symbol[near + 1])
        of = np.concatenate([x for x, _ in done]) if done else np.zeros(0, dtype=np.int64)
        tokens = np.concatenate([x for _, x in done]) if done else np.zeros(0, dtype=np.int32)
        return tokens[np.argsort(of, kind="stable")], count

    def _merge_long(self, symbol: np.ndarray) -> np.ndarray:
        """The same for one long sequence, with the places of each rank in lists, so that a round costs what it
        merges and not the length."""
        n = len(symbol)
        after, before, lives = np.arange(1, n + 1), np.arange(-1, n - 1), np.ones(n, dtype=bool)
        places: dict[int, list[np.ndarray]] = {}
        queue: list[int] = []

        def push(at: np.ndarray) -> None:
            rank = self.pairs(symbol[at], symbol[after[at]])
            at, rank = at[rank < NONE], rank[rank < NONE]
            order = np.argsort(rank, kind="stable")
            at, rank = at[order], rank[order]
            cuts = np.flatnonzero(np.concatenate([[True], rank[1:] != rank[:-1]])) if len(rank) else []
            for k, part in zip(cuts, np.split(at, cuts[1:]) if len(rank) else [], strict=True):
                r = int(rank[k])
                if r not in places:
                    places[r] = []
                    heapq.heappush(queue, r)
                places[r].append(part)

        push(np.arange(n - 1))
        while queue:
            r = heapq.heappop(queue)
            at = np.unique(np.concatenate(places.pop(r)))
            at = at[lives[at] & (after[at] < n) & (symbol[at] == self.left[r])]
            at = at[symbol[after[at]] == self.right[r]]
            if not len(at):
                continue
            fresh = np.concatenate([[True], at[1:] != after[at[:-1]]])
            at = at[(np.arange(len(at)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]) % 2 == 0]
            gone = after[at]
            symbol[at], lives[gone], after[at] = self.made[r], False, after[gone]
            inner = after[at] < n
            before[after[at[inner]]] = at[inner]
            near = np.concatenate([before[at], at[inner]])
            push(np.unique(near[near >= 0]))
        return symbol[lives]

    def _cut(self, text: str) -> tuple[list[str], list[str]]:
        """What stands in a text without a space before it, and what follows its single spaces.

        A pre-token begins at each space that no white space follows, so such a text is cut there; any other is
        cut into chunks."""
        if self.irregular(text):
            return self.chunks(text), []
        first, *rest = text.split(" ")
        return [first] if first else [], rest

    def _words(self, text: str) -> list[str]:
        """The pre-tokens of a text.  What Python's Unicode doesn't know is cut by the library, by its own."""
        if text.isascii() or all(unicodedata.category(c) != "Cn" for c in text):
            return self.pretokens(text)
        return [text[a:b] for _, (a, b) in self._library(text)]

    def _fresh(self, pieces: list[str], lead: str) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """The pieces in another order, and of each, with lead before it: the number of its tokens; and the tokens
        of all, one after another, as places in the tokens of the distinct pre-tokens, which follow."""
        letters = [p for p in pieces if p.isalpha()]
        rest = [p for p in pieces if not p.isalpha()]
        solid = [p for p in rest if p.isascii() and p.split() == [p]]
        loose = [p for p in rest if not (p.isascii() and p.split() == [p])]
        # Solid pieces are cut in one go; line feeds, which none of them holds, keep them apart.
        found = self.pretokens("\n".join([lead + p for p in solid]))
        at = [k for k, w in enumerate(found) if w == "\n"]
        cut = [self._words(lead + p) for p in loose]
        size = [np.ones(len(letters), dtype=np.int64), np.diff([-1, *at, len(found)])[: len(solid)] - 1, np.array([len(x) for x in cut], dtype=np.int64)]
        every = [lead + p for p in letters] + [w for w in found if w != "\n"] + [w for x in cut for w in x]
        number = {w: k for k, w in enumerate(dict.fromkeys(every))}
        word = np.array(list(map(number.__getitem__, every)), dtype=np.int64)
        tokens, count = self.merge([w.encode() for w in number])
        begin, each = (np.cumsum(count) - count)[word], count[word]
        upto = np.concatenate([[0], np.cumsum(each)])
        ends = np.cumsum(np.concatenate(size))
        total = np.diff(upto[np.concatenate([[0], ends])])
        return letters + solid + loose, total, np.repeat(begin - upto[:-1], each) + np.arange(upto[-1]), tokens

    def _learn(self, cache: dict[str, dict], cut: list[tuple[list[str], list[str]]], value: str) -> None:
        """Takes the pieces that cache doesn't have into it: their counts, or their ids as bytes of an int32 array."""
        for k, lead in enumerate(("", " ")):
            new = list(set().union(*(x[k] for x in cut)).difference(cache[lead]))
            new, total, places, tokens = self._fresh(new, lead)
            if value == "count":
                cache[lead].update(zip(new, total.tolist(), strict=True))
            else:
                raw, ends = tokens[places].astype(np.int32).tobytes(), np.cumsum(total)
                cache[lead].update((p, raw[4 * a : 4 * b]) for p, a, b in zip(new, (ends - total).tolist(), ends.tolist(), strict=True))
            cache["held"][lead] = cache["held"].get(lead, 0) + sum(map(len, new))

    @staticmethod
    def _forget(cache: dict[str, dict]) -> None:
        for lead in ("", " "):
            if len(cache[lead]) > CACHE or cache["held"].get(lead, 0) > CACHE_CHARS:
                cache[lead].clear()
                cache["held"][lead] = 0

    def counts(self, texts: list[str | None]) -> list[int]:
        """How many tokens each text has; strings of added tokens count as one."""
        cut, extra, rows = [], [], []
        for k, text in enumerate(texts):
            parts = self.split_added(text or "") if self.split_added else [text or ""]
            extra.append(len(parts) - 1)
            cut += map(self._cut, parts)
            rows += [k] * len(parts)
        self._learn(self._counts, cut, "count")
        bare, spaced = (self._counts[lead].__getitem__ for lead in ("", " "))
        for k, (first, rest) in zip(rows, cut, strict=True):
            extra[k] += sum(map(bare, first)) + sum(map(spaced, rest))
        self._forget(self._counts)
        return extra

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; strings of added tokens are plain text."""
        cut = list(map(self._cut, texts))
        self._learn(self._ids, cut, "ids")
        bare, spaced = (self._ids[lead].__getitem__ for lead in ("", " "))
        out = [np.frombuffer(b"".join([*map(bare, first), *map(spaced, rest)]), dtype=np.int32) for first, rest in cut]
        self._forget(self._ids)
        return out


_LOADED: dict[int, ByteBpe] = {}


def loaded(content: str) -> ByteBpe:
    """One instance in each Python worker, so that tasks share its caches."""
    key = hash(content)
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = ByteBpe(content)
    return _LOADED[key]


def count(docs: DataFrame, tokenizer: str, limit: int = 1024) -> DataFrame:
    """docs with n_bytes (UTF-8), n_tokens, and over_limit (n_tokens > limit) of each whole text.

    tokenizer: the path of a byte-level BPE in the tokenizers library's JSON; counts are the library's without
    begin or end tokens, without truncation; strings of added tokens inside a text count as one token.  Null
    and empty texts count 0.  Rows are counted one by one: repeated rows stay and count alike, an empty table
    gives no rows, other columns pass through whatever their names, and columns named as the added ones are
    replaced.  Nothing is shuffled."""
    guard = Guard(docs, ["text"])
    spark = docs.sparkSession
    small_batches(spark, 500)
    with open(tokenizer, encoding="utf-8") as f:
        sent = spark.sparkContext.broadcast(f.read())
    added = StructType.fromDDL("n_bytes long, n_tokens long, over_limit boolean")
    schema = StructType([*guard.df.schema.fields, *added.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = loaded(sent.value)
        for batch in batches:
            text = batch.column("text")
            size = pc.fill_null(pc.binary_length(text), 0).cast(pa.int64())
            tokens = pa.array(bpe.counts(text.to_pylist()), pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, size, tokens, pc.greater(tokens, limit)], names=schema.names)

    return guard.restore(guard.df.mapInArrow(run, schema), added.names)
