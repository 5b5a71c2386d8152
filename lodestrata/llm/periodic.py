"""Runs of words: stretches that repeat with a period, by harmonic grid probing.

A run of period p that is three periods long holds two neighbouring multiples of p whose words each equal the
word p further on, so only the places jp are probed, about n ln n for all periods of n words.  What passes is
extended by array comparison in chunks of doubling size.  Grid points within a run already found of a period
that divides p are skipped: their stretch is that run again, whose smallest period is known."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import Guard, small_batches

#: Words and periods that a run has at least.
LEAST_WORDS, LEAST_PERIODS = 24, 3
#: Grid points that are probed at once.
PROBES = 1 << 20
RUNS = "array<struct<start:long,length:long,period:long>>"


def numbers(words: list[bytes]) -> np.ndarray:
    """The words as numbers that are equal where the words are."""
    known: dict[bytes, int] = {}
    for w in words:
        known.setdefault(w, len(known))
    return np.fromiter(map(known.__getitem__, words), dtype=np.int32, count=len(words))


def _reach(w: np.ndarray, at: int, p: int, step: int) -> int:
    """How many places from `at` on, in the direction of step, hold the word that stands p further on."""
    done, size = 0, 16
    while True:
        if step > 0:
            a, b = at + done, min(at + done + size, len(w) - p)
            same = w[a:b] == w[a + p : b + p] if b > a else np.zeros(0, dtype=bool)
        else:
            a, b = max(at - done - size + 1, 0), at - done + 1
            same = (w[a:b] == w[a + p : b + p])[::-1] if b > a else np.zeros(0, dtype=bool)
        if not same.all():
            return done + int(same.argmin())
        done += len(same)
        if len(same) < size:
            return done
        size *= 2


def _survivors(w: np.ndarray, first: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    """(period, place) of the grid points of periods first..last that may lie in a run, by period and place."""
    n = len(w)
    periods = np.arange(first, last + 1)
    count = (n - 1) // periods - 1  # jp with (j + 2)p <= n - 1
    period = np.repeat(periods, count)
    place = (np.arange(len(period)) - np.repeat(np.cumsum(count) - count, count)) * period
    found = np.flatnonzero(w[place] == w[place + period])
    period, place = period[found], place[found]
    found = np.flatnonzero(w[place + period] == w[place + 2 * period])
    period, place = period[found], place[found]
    for k in (1, 2, 3, 5, 7):  # the places up to the next grid point hold for the whole of a run
        if not len(period):
            break
        found = np.flatnonzero((k >= period) | (w[place + np.minimum(k, period)] == w[place + period + np.minimum(k, period)]))
        period, place = period[found], place[found]
    return period, place


def runs(w: np.ndarray, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> list[tuple[int, int, int]]:
    """(start, length, period) of each run of the numbers w by start, then period: a stretch with smallest period
    p, of max(least, times * p) words or more, that neither neighbour extends."""
    if times < 3:
        raise ValueError("the grid finds runs of three periods or more")
    n = len(w)
    if n < max(least, times):
        return []
    found: list[tuple[int, int, int]] = []
    last = n // times
    first = 1
    while first <= last:
        # As many periods as PROBES grid points allow.
        upto = first
        budget = PROBES - n // first
        while upto < last and budget >= n // (upto + 1):
            upto += 1
            budget -= n // upto
        period, place = _survivors(w, first, upto)
        cuts = np.flatnonzero(np.concatenate([[True], period[1:] != period[:-1]])) if len(period) else []
        for k, at in zip(cuts, np.split(place, cuts[1:]) if len(cuts) else [], strict=True):
            p = int(period[k])
            for s, length, q in found:
                if p % q == 0 and p <= length:
                    at = at[(at < s) | (at + p >= s + length)]
            while len(at):
                g = int(at[0])
                ahead = _reach(w, g, p, 1)
                start = g + 1 - _reach(w, g, p, -1)
                length = g + ahead - start + p
                if length >= max(least, times * p) and not any(p % q == 0 and s <= start and start + length <= s + m for s, m, q in found):
                    found.append((start, length, p))
                at = at[at >= g + max(ahead, 1)]
        first = upto + 1
    return sorted((s, m, p) for s, m, p in found)


def repeats(n: int, found: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of n words some run holds after its first period."""
    edge = np.zeros(n + 1, dtype=np.int64)
    for s, m, p in found:
        edge[s + p] += 1
        edge[s + m] -= 1
    return np.cumsum(edge[:-1]) > 0


Change = Callable[[int | None, list[bytes]], list[bytes]]


def _words(text: str | None) -> list[bytes]:
    """The words of a text: bytes.split() cuts at the six ASCII white spaces."""
    return text.encode().split() if text else []


def _map(docs: DataFrame, columns: list[str], added: str, make: Callable[[dict[str, list]], list[pa.Array]]) -> DataFrame:
    guard = Guard(docs, columns)
    small_batches(docs.sparkSession, 500)
    more = StructType.fromDDL(added)
    schema = StructType([*guard.df.schema.fields, *more.fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([*batch.columns, *make({c: batch.column(c).to_pylist() for c in columns})], names=schema.names)

    return guard.restore(guard.df.mapInArrow(run, schema), more.names)


def find(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """docs with n_words and runs, the runs of each whole text's words by start, then period.

    Words are what stands between ASCII white space.  Null and empty texts have no words and no runs; texts of
    any length are searched whole.  Rows are searched one by one: repeated rows stay and have equal runs, an
    empty table gives no rows, other columns pass through whatever their names, and columns named as the added
    ones are replaced.  Nothing is shuffled."""

    def make(rows: dict[str, list]) -> list[pa.Array]:
        size, out = [], []
        for text in rows["text"]:
            w = numbers(_words(text))
            size.append(len(w))
            out.append([dict(zip(("start", "length", "period"), x, strict=True)) for x in runs(w, least, times)])
        kind = pa.list_(pa.struct([(k, pa.int64()) for k in ("start", "length", "period")]))
        return [pa.array(size, pa.int64()), pa.array(out, kind)]

    return _map(docs, ["text"], f"n_words long, runs {RUNS}", make)


def collapse(docs: DataFrame, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """docs with the text of each row that has runs replaced: words that a run holds after its first period go,
    the others are joined by one space.  Rows without runs, null and empty texts stay as they are."""

    def make(rows: dict[str, list]) -> list[pa.Array]:
        out = []
        for text in rows["text"]:
            words = _words(text)
            found = runs(numbers(words), least, times)
            if found:
                gone = repeats(len(words), found).tolist()
                text = b" ".join([x for x, drop in zip(words, gone, strict=True) if not drop]).decode()
            out.append(text)
        return [pa.array(out, pa.string())]

    columns = docs.columns
    return _map(docs, ["text"], "_collapsed string", make).select(*(F.col("_collapsed").alias(c) if c == "text" else F.col(f"`{c}`") for c in columns))


DIGEST = "n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def digest(docs: DataFrame, change: Change | None = None, least: int = LEAST_WORDS, times: int = LEAST_PERIODS) -> DataFrame:
    """(doc_id, n_runs; start, length, period and exponent_milli of the run with the greatest exact quotient of
    length and period, ties to the smallest start and period; runs_sha256, collapsed_sha256) of each row of docs.

    What is hashed are the runs of find(), a line `start,length,period` each, and the words that collapse() keeps,
    joined by one space.  change(doc_id, words) puts other words in the place of a row's.  Nulls, empty texts and
    repeated rows as in find(); without runs the four numbers are null."""

    def make(rows: dict[str, list]) -> list[pa.Array]:
        columns: list[list] = [[] for _ in range(7)]
        for key, text in zip(rows["doc_id"], rows["text"], strict=True):
            words = _words(text)
            if change:
                words = change(key, words)
            found = runs(numbers(words), least, times)
            best = None
            for s, m, p in found:
                if best is None or m * best[2] > best[1] * p or (m * best[2] == best[1] * p and (s, p) < (best[0], best[2])):
                    best = s, m, p
            if found:
                gone = repeats(len(words), found).tolist()
                words = [x for x, drop in zip(words, gone, strict=True) if not drop]
            lines = "".join(f"{s},{m},{p}\n" for s, m, p in found)
            row = (len(found), *(best or (None, None, None)), best and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(words)).hexdigest())
            for column, value in zip(columns, row, strict=True):
                column.append(value)
        return [pa.array(c, pa.int64() if k < 5 else pa.string()) for k, c in enumerate(columns)]

    names = [x.split()[0] for x in DIGEST.split(", ")]
    return _map(docs.select("doc_id", "text"), ["doc_id", "text"], DIGEST, make).select("doc_id", *names)
