"""Periodic runs of words by recompression: a run-length grammar answers how far two places of a text agree."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from runlens.llm.words import mixed, slices, word_array

COPIES = 4  # a run holds its period so many times at least
SHORTEST = 6  # and so many words
MOST_LEVELS = 120
WAVES = 3  # rounds in which one candidate stands for its neighbours; after them all that are left are tried at once


class Grammar:
    """A text as levels of symbols: blocks of equal symbols and pairs of unlike ones become symbols of the next level in turn.

    Symbols have one name wherever they occur, and what becomes a symbol depends on its neighbours only. So equal stretches have
    equal symbols but for a few at their ends, and two places are compared by climbing from words to larger and larger symbols and
    down again where they differ. Both directions use the same levels, the backward one read from the right.

    ``symbols`` starts and ends with a number that occurs once, and has one such number at every border that nothing may cross.
    """

    def __init__(self, symbols: np.ndarray, small: int):
        """Levels are added until at most ``small`` symbols are left."""
        _, level = np.unique(symbols, return_inverse=True)
        level = level.astype(np.int64)
        self.levels, starts_of, names = [level], [], int(level.max()) + 1
        self.weights = [np.ones(len(level), np.int64)]
        while len(level) > small and len(self.levels) < MOST_LEVELS:
            if len(self.levels) % 2:
                starts, level, names = self._blocks(level, names)
            else:
                starts, level, names = self._pairs(level, names, len(self.levels))
            starts_of.append(starts)
            self.weights.append(np.add.reduceat(self.weights[-1], starts))
            self.levels.append(level)
        self.sizes = np.array([len(x) for x in self.levels])
        self.base = np.cumsum(self.sizes) - self.sizes
        self.forward = self._tables(self.levels, self.weights, starts_of)
        mirrored = [len(self.levels[i]) - np.append(s[1:], len(self.levels[i]))[::-1] for i, s in enumerate(starts_of)]
        self.backward = self._tables([x[::-1] for x in self.levels], [w[::-1] for w in self.weights], mirrored)

    @staticmethod
    def _blocks(level: np.ndarray, names: int) -> tuple[np.ndarray, np.ndarray, int]:
        starts = np.flatnonzero(np.concatenate([[True], level[1:] != level[:-1]]))
        length = np.diff(np.append(starts, len(level)))
        out = level[starts]
        many = np.flatnonzero(length > 1)
        kinds, name = np.unique(out[many] * (len(level) + 1) + length[many], return_inverse=True)
        out[many] = names + name
        return starts, out, names + len(kinds)

    @staticmethod
    def _pairs(level: np.ndarray, names: int, salt: int) -> tuple[np.ndarray, np.ndarray, int]:
        left = (mixed(level.astype(np.uint64) + np.uint64(salt << 40)) & np.uint64(1)).astype(bool)
        pair = np.flatnonzero(left[:-1] & ~left[1:])
        second = np.zeros(len(level), bool)
        second[pair + 1] = True
        starts = np.flatnonzero(~second)
        kinds, name = np.unique(level[pair] * names + level[pair + 1], return_inverse=True)
        out = level.copy()
        out[pair] = names + name
        return starts, out[starts], names + len(kinds)

    def _tables(self, levels: list, weights: list, starts_of: list) -> tuple:
        """For all levels in a row: symbol, weight to its left, length of the block from it on, its parent where it is the first child,
        its first child."""
        symbol, before, rest, up, down = [], [], [], [], []
        for i, level in enumerate(levels):
            symbol.append(level)
            before.append(np.cumsum(weights[i]) - weights[i])
            ends = np.flatnonzero(np.concatenate([level[1:] != level[:-1], [True]]))
            rest.append(np.repeat(ends, np.diff(np.concatenate([[-1], ends]))) - np.arange(len(level)) + 1)
            parent = np.full(len(level), -1, np.int64)
            if i < len(starts_of):
                parent[starts_of[i]] = self.base[i + 1] + np.arange(len(starts_of[i]))
            up.append(parent)
            down.append(self.base[i - 1] + starts_of[i - 1] if i else np.full(len(level), -1, np.int64))
        return tuple(map(np.concatenate, (symbol, before, rest, up, down)))

    def _agree(self, tables: tuple, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many words from ``a`` and from ``b`` on are equal; never a place against itself."""
        symbol, before, rest, up, down = tables
        begin, a, b = before[a], a.copy(), b.copy()
        out, climbing, active = np.zeros(len(a), np.int64), np.ones(len(a), bool), np.arange(len(a))
        while len(active):
            x, y = a[active], b[active]
            high, higher = up[x], up[y]
            rise = climbing[active] & (high >= 0) & (higher >= 0)
            same = ~rise & (symbol[x] == symbol[y])
            step = np.minimum(rest[x], rest[y])
            low = ~rise & ~same
            fall, over = down[x], down[y]
            done = low & (fall < 0)
            fell = low & ~done
            a[active] = np.select([rise, same, fell], [high, x + step, fall], x)
            b[active] = np.select([rise, same, fell], [higher, y + step, over], y)
            climbing[active[fell]] = False
            out[active[done]] = before[x[done]] - begin[active[done]]
            active = active[~done]
        return out

    def after(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words from places i and j on."""
        return self._agree(self.forward, i, j)

    def ahead(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Equal words that end right before places i and j."""
        return self._agree(self.backward, self.sizes[0] - i, self.sizes[0] - j)


def grid_candidates(symbols: np.ndarray, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Places i and periods p, by p, where the words at i, i+p, i+2p and i+3p are equal and i is a multiple of p.

    A run of period p that holds it four times holds such a place.
    """
    places, periods = [], []
    for p in range(1, longest // COPIES + 1):
        grid = symbols[::p]
        equal = grid[1:] == grid[:-1]
        at = np.flatnonzero(equal[:-2] & equal[1:-1] & equal[2:])
        if len(at):
            places.append(at * p)
            periods.append(np.full(len(at), p))
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(places), np.concatenate(periods)


def runs_of(symbols: np.ndarray, places: np.ndarray, periods: np.ndarray, small: int) -> np.ndarray:
    """Rows (start, end, period) of all runs through the candidates, by start and period.

    Periods double from round to round, so that a run is known before multiples of its period are looked at: candidates inside a
    known run are none. Of candidates in a row the first is tried; what its run doesn't hold is tried in the next wave.
    """
    grammar = Grammar(symbols, small)
    known = np.zeros(len(symbols), np.int64)  # the end of the furthest known run that holds a place
    found, top, last = [], 1, int(periods.max(initial=0))
    while top // 2 < last:
        chosen = (periods > top // 2) & (periods <= top)
        at, p = places[chosen], periods[chosen]
        free = known[at] < at + 2 * p
        at, p = at[free], p[free]
        new, wave = np.zeros((0, 3), np.int64), 0
        while len(at):
            first = np.ones(len(at), bool)
            if wave < WAVES:
                first[1:] = (p[1:] != p[:-1]) | (at[1:] != at[:-1] + p[1:])
            i, q = at[first], p[first]
            runs = np.stack([i - grammar.ahead(i, i + q), i + q + grammar.after(i, i + q), q], axis=1)
            runs = np.unique(runs[runs[:, 1] - runs[:, 0] >= np.maximum(SHORTEST, COPIES * q)], axis=0)
            runs = runs[known[runs[:, 0]] < runs[:, 1]]
            new = np.concatenate([new, runs])
            at, p, wave = at[~first], p[~first], wave + 1
            if len(at) and len(runs):  # within one round a place can lie in runs of several periods: looked up by period and start
                order = np.lexsort((runs[:, 0], runs[:, 2]))
                runs = runs[order]
                key = runs[:, 2] * (len(symbols) + 1) + runs[:, 0]
                near = np.searchsorted(key, p * (len(symbols) + 1) + at, "right") - 1
                held = (near >= 0) & (runs[near, 2] == p) & (runs[near, 1] >= at + 2 * p)
                at, p = at[~held], p[~held]
        new = np.unique(new, axis=0)
        for start, end, _ in new.tolist():
            np.maximum(known[start:end], end, out=known[start:end])
        found.append(new)
        top *= 2
    out = np.concatenate(found) if found else np.zeros((0, 3), np.int64)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def text_runs(lists: list[list[bytes]]) -> list[np.ndarray]:
    """Per list of words, its runs as rows (start, length, period)."""
    counts = np.fromiter(map(len, lists), np.int64, len(lists))
    flat = [w for ws in lists for w in ws]
    names = {w: i for i, w in enumerate(dict.fromkeys(flat))}
    total, borders = len(flat), np.cumsum(counts + 1) - counts - 1  # a border stands before every text, and one at the end
    symbols = np.empty(total + len(lists) + 1, np.int64)
    inside = np.ones(len(symbols), bool)
    inside[borders], inside[-1] = False, False
    symbols[~inside] = len(names) + np.arange(len(lists) + 1)
    symbols[inside] = np.fromiter(map(names.__getitem__, flat), np.int64, total)
    places, periods = grid_candidates(symbols, int(counts.max(initial=0)))
    out = [np.zeros((0, 3), np.int64)] * len(lists)
    if not len(places):
        return out
    # Only texts with candidates get a grammar.
    owner = np.searchsorted(borders, places, "right") - 1
    picked = np.unique(owner)
    width = counts[picked] + 1
    begin = np.cumsum(width) - width
    own = np.repeat(borders[picked] - begin, width) + np.arange(int(width.sum()))
    shift = borders[picked] - begin
    places = places - shift[np.searchsorted(picked, owner)]
    runs = runs_of(np.append(symbols[own], symbols[-1]), places, periods, 8 * len(picked) + 8)
    text = np.searchsorted(begin, runs[:, 0], "right") - 1
    rows = np.stack([runs[:, 0] - begin[text] - 1, runs[:, 1] - runs[:, 0], runs[:, 2]], axis=1)
    for k, part in zip(picked.tolist(), np.split(rows, np.searchsorted(text, np.arange(1, len(picked)))), strict=True):
        out[k] = part
    return out


def collapsed(words: list[bytes], runs: np.ndarray) -> list[bytes]:
    """The words but those that some run holds after its first period."""
    if not len(runs):
        return words
    steps = np.zeros(len(words) + 1, np.int64)
    np.add.at(steps, runs[:, 0] + runs[:, 2], 1)
    np.add.at(steps, runs[:, 0] + runs[:, 1], -1)
    kept = np.flatnonzero(np.cumsum(steps[:-1]) == 0)
    return [words[i] for i in kept.tolist()]


def find_runs(docs: DataFrame, *, with_text: bool = False, with_runs: bool = False) -> DataFrame:
    """Per document: doc_id, n_words, n_runs; start, length, period and exponent_milli of its longest run; runs_sha256 and collapsed_sha256;
    ``runs`` (start, length, period of each) and ``collapsed_text`` where asked for.

    A run is a stretch of consecutive words with smallest period q, of at least ``SHORTEST`` words and ``COPIES`` * q words, that no
    neighbouring word extends. Of runs of greatest length the one with the smallest start counts, then with the smallest
    period. exponent_milli is 1000 * length / period, rounded down. The collapsed text keeps the first q words of every run and what
    is in none, joined by one space; runs_sha256 is the hash of ``start,length,period`` and a line feed per run, by start and period.

    A null text, an empty one or one of white space has no words and no run: four nulls and hashes of the empty text. Repeated rows,
    null ids and repeated ids are documents of their own; other columns are left out. An empty table gives no rows. Documents are
    handled one by one where they are read: nothing is shuffled, and a task holds some megabytes of text, or one text.
    """

    def find(batches):
        for part in slices(batches):
            lists = [t.split() if t else [] for t in part.column("text").to_pylist()]
            out = {name: [] for name in ("n_words", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")}
            listed, texts = [], []
            for words, runs in zip(lists, text_runs(lists), strict=True):
                kept = b" ".join(collapsed(words, runs))
                rows = runs.tolist()
                best = max(rows, key=lambda r: (r[1], -r[0], -r[2]), default=None)
                lines = "".join(f"{s},{n},{q}\n" for s, n, q in rows)
                row = (
                    len(words), len(rows), *(best or [None] * 3), best and 1000 * best[1] // best[2],
                    hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(kept).hexdigest(),
                )
                for column, value in zip(out.values(), row, strict=True):
                    column.append(value)
                if with_runs:
                    listed.append([dict(zip(("start", "length", "period"), r, strict=True)) for r in rows])
                if with_text:
                    texts.append(kept.decode("utf-8", "replace"))
            arrays = [part.column("doc_id")] + [pa.array(v, pa.string() if k.endswith("256") else pa.int64()) for k, v in out.items()]
            names = ["doc_id", *out]
            if with_runs:
                arrays.append(pa.array(listed, pa.list_(pa.struct([(n, pa.int64()) for n in ("start", "length", "period")]))))
                names.append("runs")
            if with_text:
                arrays.append(pa.array(texts, pa.string()))
                names.append("collapsed_text")
            yield pa.RecordBatch.from_arrays(arrays, names)

    numbers = ", ".join(f"{c} long" for c in ("n_words", "n_runs", "start", "length", "period", "exponent_milli"))
    schema = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {numbers}, runs_sha256 string, collapsed_sha256 string"
    schema += ", runs array<struct<start: long, length: long, period: long>>" * with_runs + ", collapsed_text string" * with_text
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(find, schema)


def planted_text(doc_id: Column, text: Column) -> Column:
    """The text, made periodic for one id in ten: h is the CRC-32 of the id in decimal and g = floor(h / 10); if h % 10 = 0, each of the n
    words from number a = g % n on becomes word a + (i - a) % p, where p = 1 + floor((n - a) / (3 + g % 8)). A null id has no h."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def rebuilt(words: Column) -> Column:
        n = F.size(words).cast("long")
        a = g % n
        p = F.lit(1) + F.floor((n - a) / (F.lit(3) + g % 8))
        place = F.sequence(F.lit(0).cast("long"), n - 1)
        periodic = F.concat_ws(" ", F.transform(place, lambda i: F.get(words, F.when(i < a, i).otherwise(a + (i - a) % p).cast("int"))))
        return F.when(n > 0, periodic).otherwise(text)

    # A lambda's argument is worked out once, however often it is named.
    return F.when(h % 10 == 0, F.transform(F.array(word_array(text)), rebuilt)[0]).otherwise(text)
