"""Periodic runs of words by recompression: a run-length grammar whose longest-common-extension queries are exact.

Block compression (equal neighbours become one symbol with a count) and pair compression (a left symbol and a right
symbol become one) take turns until few symbols are left. Equal stretches of a text are compressed alike but for
their ends, so two places are compared by climbing the levels while both stand at the same symbol and coming down
where they differ. A run of period p and at least 2p words holds two neighbouring points of the grid 0, p, 2p ...;
the grids of all periods together have about n log n points. Those whose words match are extended both ways.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

LEAST = 12  # words of a run, and two periods at least
SLICE = 128
SHORT = 4096  # words of texts whose grid points are kept between texts
CHUNK = 500_000  # grid points of a longer text that are looked at together
FEW = 8  # symbols of the top level
_BITS = 0x9E3779B97F4A7C15


class Grammar:
    """The levels of one sequence, laid one behind the other with a stop at both ends of each.

    For a symbol: its name, the number of equal symbols from it on (``after``) and up to it (``before``), its length in
    words, the symbol of the next level that starts (``up_first``) or ends (``up_last``) with it or -1, and the first
    and last symbol below it or -1.
    """

    def __init__(self, sequence: np.ndarray):
        names, sizes = sequence.astype(np.int64), np.ones(len(sequence), np.int64)
        levels = []
        turn = 0
        while True:
            new = np.flatnonzero(np.concatenate([[True], names[1:] != names[:-1]]))
            counts = np.diff(np.append(new, len(names)))
            block = np.repeat(np.arange(len(new)), counts)
            inside = np.arange(len(names)) - new[block]
            levels.append([names, counts[block] - inside, inside + 1, sizes])
            if len(names) <= FEW or len(levels) > 200:
                break
            bases, block_sizes = names[new], sizes[new] * counts
            _, blocks = np.unique(bases * (len(names) + 1) + counts, return_inverse=True)
            turn += 1
            side = ((blocks.astype(np.uint64) + np.uint64(1)) * np.uint64(_BITS + 2 * turn) >> np.uint64(40 + turn % 16)).astype(np.int64) & 1
            rising = (side[:-1] == 0) & (side[1:] == 1)
            falling = (side[:-1] == 1) & (side[1:] == 0)
            joined = rising if rising.sum() >= falling.sum() else falling
            second = np.concatenate([[False], joined])  # the second of a pair belongs to the symbol before it
            first = np.flatnonzero(~second)
            last = np.append(first[1:], len(blocks)) - 1
            partner = np.where(last > first, blocks[last] + 1, 0)
            _, names = np.unique(blocks[first] * (len(blocks) + 1) + partner, return_inverse=True)
            sizes = np.add.reduceat(block_sizes, first)
            levels[-1] += [new[first], np.append(new[first][1:], len(levels[-1][0])) - 1]
        starts = np.cumsum([1] + [len(level[0]) + 2 for level in levels])
        total = int(starts[-1])
        self.name = np.full(total, -1, np.int64)
        self.after, self.before, self.size = (np.ones(total, np.int64) for _ in range(3))
        self.up_first, self.up_last, self.down_first, self.down_last = (np.full(total, -1, np.int64) for _ in range(4))
        for k, level in enumerate(levels):
            here, n = starts[k], len(level[0])
            self.name[here : here + n], self.after[here : here + n], self.before[here : here + n], self.size[here : here + n] = level[:4]
            if len(level) > 4:
                above = starts[k + 1]
                parents = above + np.arange(len(level[4]))
                self.up_first[here + level[4]], self.up_last[here + level[5]] = parents, parents
                self.down_first[parents], self.down_last[parents] = here + level[4], here + level[5]
                self.down_first[above - 1] = self.down_last[above - 1] = here - 1  # the stops stand over the stops
                self.down_first[above + len(parents)] = self.down_last[above + len(parents)] = here + n

    def common(self, one: np.ndarray, two: np.ndarray, forward: bool) -> np.ndarray:
        """How many words agree from the places ``one`` and ``two`` on (or up to them, going backwards); places from
        -1 to the number of words, never equal."""
        along, up, down, way = (self.after, self.up_first, self.down_first, 1) if forward else (self.before, self.up_last, self.down_last, -1)
        found = np.zeros(len(one), np.int64)
        which, a, b = np.arange(len(one)), one + 1, two + 1
        rising = np.ones(len(one), bool)
        while len(which):
            same = (self.name[a] == self.name[b]) & (self.name[a] >= 0)
            climb = same & rising & (up[a] >= 0) & (up[b] >= 0)
            step = same & ~climb
            fall = ~same
            many = np.minimum(along[a], along[b])
            found[which[step]] += (many * self.size[a])[step]
            rising &= ~fall & ~(step & (along[a] != along[b]))
            a = np.where(climb, up[a], np.where(step, a + way * many, down[a]))
            b = np.where(climb, up[b], np.where(step, b + way * many, down[b]))
            on = a >= 0
            if not on.all():
                which, a, b, rising = which[on], a[on], b[on], rising[on]
        return found


@lru_cache(maxsize=1)
def _short_grid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(periods, places, number of points whose second word stands before n): the points (i, i + p) with p | i."""
    periods = np.concatenate([np.full(-(-(SHORT - p) // p), p, np.int32) for p in range(1, SHORT)])
    places = np.concatenate([np.arange(0, SHORT - p, p, dtype=np.int32) for p in range(1, SHORT)])
    order = np.argsort(periods + places, kind="stable")
    periods, places = periods[order], places[order]
    return periods, places, np.searchsorted(periods + places, np.arange(SHORT + 1))


def _grid(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The grid points of all periods up to n / 2, in bounded portions, small periods first."""
    if n <= SHORT:
        periods, places, until = _short_grid()
        periods, places = periods[: until[n]], places[: until[n]]
        kept = periods <= n // 2
        yield periods[kept], places[kept]
        return
    first = 1
    while first <= n // 2:
        counts = -(-(n - np.arange(first, n // 2 + 1)) // np.arange(first, n // 2 + 1))
        taken = max(1, int(np.searchsorted(np.cumsum(counts), CHUNK, side="right")))
        counts = counts[:taken]
        periods = np.repeat(np.arange(first, first + taken), counts)
        nth = np.arange(len(periods)) - np.repeat(np.cumsum(counts) - counts, counts)
        yield periods, nth * periods
        first += taken


def _matching(ids: np.ndarray, periods: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The points at which at least three neighbouring words agree with those a period on: a run has six and more."""
    at = np.flatnonzero(ids[places] == ids[places + periods])
    p, i, n = periods[at].astype(np.int64), places[at].astype(np.int64), len(ids)

    def agrees(shift: int) -> np.ndarray:
        k = i + shift
        return (k >= 0) & (k + p < n) & (ids[np.clip(k, 0, n - 1)] == ids[np.clip(k + p, 0, n - 1)])

    left, right = agrees(-1), agrees(1)
    return at[(left & right) | (right & agrees(2)) | (left & agrees(-2))]


def runs_of(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, smallest period) of every run, by start and period. ``least`` is six or more."""
    n = len(ids)
    if least < 6:
        raise ValueError("runs of fewer than six words are not looked for")
    if n < least:
        return []
    grammar, found = None, {}
    for periods, places in _grid(n):
        at = _matching(ids, periods, places)
        periods, places = periods[at].astype(np.int64), places[at].astype(np.int64)
        for low, high in ((1, 9), (9, 65), (65, n)):  # what lies in a run of a dividing period has been answered
            here = (periods >= low) & (periods < high)
            p, i = periods[here], places[here]
            for (start, end), q in found.items():
                if len(p) == 0:
                    break
                known = (i >= start) & (i + p < end) & (p % q == 0)
                if known.any():
                    p, i = p[~known], i[~known]
            if len(p) == 0:
                continue
            grammar = grammar or Grammar(ids)
            begin = i - grammar.common(i - 1, i + p - 1, forward=False)
            end = i + p + grammar.common(i, i + p, forward=True)
            long = end - begin >= np.maximum(least, 2 * p)
            for s, e, q in set(zip(begin[long].tolist(), end[long].tolist(), p[long].tolist(), strict=True)):
                if q < found.get((s, e), q + 1):
                    found[s, e] = q
    return sorted(((s, e - s, q) for (s, e), q in found.items()), key=lambda r: (r[0], r[2]))


def words_of(text: str | None) -> list[bytes]:
    """Words between ASCII white space, as they are."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def numbered(words: list[bytes]) -> np.ndarray:
    seen: dict[bytes, int] = {}
    return np.array([seen.setdefault(w, len(seen)) for w in words], np.int64)


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The text with each run cut down to its first period."""
    gone = np.zeros(len(words) + 1, np.int32)
    for start, length, period in runs:
        gone[start + period] += 1
        gone[start + length] -= 1
    kept = np.cumsum(gone)[:-1] == 0
    return b" ".join([w for w, k in zip(words, kept.tolist(), strict=True) if k]) if runs else b" ".join(words)


def _per_document(docs: DataFrame, schema: str, row: Callable[[int | None, str | None], tuple]) -> DataFrame:
    names = [field.split(" ")[0] for field in schema.split(", ")]

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                rows = [row(i, t) for i, t in zip(part["doc_id"].to_pylist(), part["text"].to_pylist(), strict=True)]
                columns = list(zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, TYPES[n]) for c, n in zip(columns, names, strict=True)], names)

    return docs.select("doc_id", "text").mapInArrow(look, schema)


_LONG = pa.int64()
_RUN = pa.list_(pa.struct([("start", _LONG), ("length", _LONG), ("period", _LONG)]))
TYPES = dict.fromkeys(["doc_id", "n_runs", "start", "length", "period", "exponent_milli"], _LONG) | {
    "runs": _RUN, "collapsed": pa.string(), "runs_sha256": pa.string(), "collapsed_sha256": pa.string(),
}


def runs(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """(doc_id, runs, collapsed): all runs of each whole text, and the text with each run cut to its first period.

    A run is a stretch of words with smallest period q, of at least 12 and 2q words, that no neighbouring word extends.
    ``change`` may put other words in the place of a document's own. Null and empty texts have no runs; rows with a
    repeated or null doc_id come back as they are; an empty table gives no rows. A task holds one text and its grammar.
    """

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = change(doc_id, words_of(text)) if change else words_of(text)
        found = runs_of(numbered(words))
        return doc_id, [dict(zip(("start", "length", "period"), r)) for r in found], collapsed(words, found).decode("utf-8", "replace")

    return _per_document(docs, "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string", row)


def run_digests(docs: DataFrame, change: Callable[[int | None, list[bytes]], list[bytes]] | None = None) -> DataFrame:
    """The same as numbers and digests: the number of runs, the longest one (ties: the smallest start, then period),
    SHA-256 of all runs and of the collapsed text."""

    def row(doc_id: int | None, text: str | None) -> tuple:
        words = change(doc_id, words_of(text)) if change else words_of(text)
        found = runs_of(numbered(words))
        most = min(found, key=lambda r: (-r[1], r[0], r[2]), default=None)
        listed = "".join(f"{s},{n},{p}\n" for s, n, p in found)
        longest = (*most, 1000 * most[1] // most[2]) if most else (None,) * 4
        return doc_id, len(found), *longest, hashlib.sha256(listed.encode()).hexdigest(), hashlib.sha256(collapsed(words, found)).hexdigest()

    return _per_document(
        docs, "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string", row
    )
