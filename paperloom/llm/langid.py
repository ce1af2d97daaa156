"""Language identification by cross-parsing entropy (Ziv and Merhav's relative entropy).

A suffix automaton of labelled text per language gives, at every position of a text, the longest
match with that text. Parsing a text greedily into longest matches costs few phrases against its
own language and many against others; phrases times log2 of the sample's length, per symbol, is an
estimate of the cross entropy. The language with the least wins.

The labelled sample is bounded: at most SAMPLE_ROWS whole texts a language, together at most SAMPLE_CHARS code
points; those of at most ROW_CHARS come first, by a hash, then longer ones, the shorter first. Prediction reads whole texts: a text is laid out in lanes of LANE
symbols, and all lanes of a batch step through the automata of all languages together in numpy. Each
lane is first parsed as if a phrase began with it; then the state at the end of the lane before is
carried in, until a phrase begins where one had begun: the phrases are those of the whole text.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from paperloom.llm.common import TEXT_BATCH_ROWS, cut_lines, freeing, prepare

SAMPLE_ROWS = 32
ROW_CHARS = 2000
SAMPLE_CHARS = SAMPLE_ROWS * ROW_CHARS
LANE = 256
STEP_CHARS = 500_000
UNDEFINED = "und"

_CLASSES: list[np.ndarray] = []


def classes() -> np.ndarray:
    """For each code point: its lower-case letter, or a space (32) where it isn't a letter."""
    if not _CLASSES:
        table = np.full(0x110000, 32, np.uint32)
        for c in range(0x110000):
            if not 0xD800 <= c < 0xE000 and chr(c).isalpha():
                low = chr(c).lower()
                table[c] = ord(low) if len(low) == 1 else c
        _CLASSES.append(table)
    return _CLASSES[0]


def letters(text: str | None) -> np.ndarray:
    """The text's lower-cased letters; any run of other characters is one space."""
    if not text:
        return np.zeros(0, np.uint32)
    out = classes()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    gap = out == 32
    return out[~(gap & np.concatenate(([True], gap[:-1])))]


def automaton(symbols: list[int], width: int) -> np.ndarray:
    """The suffix automaton's transitions, [state, symbol] to state or -1; state 0 is the root."""
    moves, link, length = [{}], [-1], [0]
    last = 0
    for c in symbols:
        now = len(moves)
        moves.append({})
        length.append(length[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in moves[p]:
            moves[p][c] = now
            p = link[p]
        if p >= 0:
            q = moves[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                twin = len(moves)
                moves.append(dict(moves[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and moves[p].get(c) == q:
                    moves[p][c] = twin
                    p = link[p]
                link[q] = link[now] = twin
        last = now
    table = np.full((len(moves), width), -1, np.int32)
    for state, out in enumerate(moves):
        for c, to in out.items():
            table[state, c] = to
    return table


class Parser:
    """The automata of all languages over one alphabet, in one table."""

    def __init__(self, sample: dict[str, str]):
        self.languages = sorted(sample)
        texts = [letters(sample[x]) for x in self.languages]
        alphabet = np.unique(np.concatenate([*texts, np.array([32], np.uint32)]))
        self.symbol = np.zeros(0x110000, np.int16)  # 0: in no sample
        self.symbol[alphabet] = np.arange(1, len(alphabet) + 1)
        self.width = len(alphabet) + 1
        tables = [automaton(self.symbol[t].tolist(), self.width) for t in texts]
        self.first = np.cumsum([0, *(len(t) for t in tables)])[:-1]
        shifted = [np.where(t >= 0, t + f, -1) for t, f in zip(tables, self.first)]
        self.table = np.concatenate([*shifted, np.zeros((0, self.width), np.int32)])
        self.table = self.table.astype(np.int32).ravel()
        self.bits = np.array([np.log2(max(2, len(t))) for t in texts])

    def phrases(self, texts: list[np.ndarray]) -> np.ndarray:
        """[text, language]: the number of phrases."""
        n = np.array([len(t) for t in texts])
        lanes = -(-n // LANE)
        total = int(lanes.sum())
        out = np.zeros((len(texts), len(self.languages)))
        if not total:
            return out
        begin = np.cumsum(lanes) - lanes
        grid = np.full(total * LANE, -1, np.int16)
        for t, b in zip(texts, begin * LANE):
            grid[b : b + len(t)] = self.symbol[t]
        grid = np.ascontiguousarray(grid.reshape(total, LANE).T)
        size = (grid >= 0).sum(axis=0)
        order = np.argsort(-size, kind="stable")  # lanes that end drop off at the tail
        grid, size = grid[:, order], size[order]
        alive = np.searchsorted(-size, -np.arange(LANE), side="left")
        counts = np.zeros((len(self.languages), total))
        place = np.empty(total, np.int64)  # of the text's next lane
        place[order] = np.arange(total)
        last = np.zeros(total, bool)
        last[(begin + lanes)[lanes > 0] - 1] = True
        follows = np.where(last[order], -1, place[np.minimum(order + 1, total - 1)])
        for k, root in enumerate(self.first):
            at_root = self.table[root * self.width : (root + 1) * self.width].copy()
            at_root[at_root < 0] = root
            begins = np.zeros(grid.shape, bool)
            state = np.full(total, root, np.int32)
            for i in range(LANE):
                m = alive[i]
                if not m:
                    break
                begins[i, :m], state[:m] = self._step(root, at_root, state[:m], grid[i, :m])
            ends = state.copy()
            enter = np.flatnonzero(follows >= 0)
            while len(enter):
                lane, state = follows[enter], ends[enter]
                changed = []
                for i in range(LANE):
                    over = i >= size[lane]
                    if over.any():
                        moved = over & (ends[lane] != state)
                        ends[lane[moved]] = state[moved]
                        changed.append(lane[moved])
                        lane, state = lane[~over], state[~over]
                    if not len(lane):
                        break
                    start, state = self._step(root, at_root, state, grid[i, lane])
                    open_ = ~(start & begins[i, lane])
                    lane, state = lane[open_], state[open_]
                    begins[i, lane] = start[open_]
                moved = ends[lane] != state
                ends[lane[moved]] = state[moved]
                enter = np.concatenate([*changed, lane[moved]]).astype(np.int64)
                enter = enter[follows[enter] >= 0]
            counts[k, order] = begins.sum(axis=0)
        which = np.repeat(np.arange(len(texts)), lanes)
        for k in range(len(self.languages)):
            out[:, k] = np.bincount(which, counts[k], len(texts))
        return out

    def _step(self, root: int, at_root: np.ndarray, state: np.ndarray, symbol: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Whether a phrase begins with each symbol, and the states after it."""
        to = self.table[state * self.width + symbol]
        cut = to < 0
        return cut | (state == root), np.where(cut, at_root[symbol], to)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Languages, scores and bits a symbol of the best language."""
        found: list[str] = []
        scores, costs = np.zeros(len(texts)), np.zeros(len(texts))
        symbols = [letters(t) for t in texts]
        for begin, end in cut_lines((len(s) for s in symbols), STEP_CHARS):
            part = symbols[begin:end]
            n = np.array([len(s) for s in part])
            empty = np.array([not (s != 32).any() for s in part])
            if not self.languages:
                empty[:] = True
            if empty.all():
                found += [UNDEFINED] * len(part)
                continue
            cost = self.phrases(part) * self.bits / np.maximum(n, 1)[:, None]
            best = cost.argmin(axis=1)
            least = cost.min(axis=1)
            if len(self.languages) > 1:
                second = np.partition(cost, 1, axis=1)[:, 1]
                score = np.clip(1 - least / np.maximum(second, 1e-12), 0, 1)
            else:
                score = np.ones(len(part))
            found += [UNDEFINED if e else self.languages[b] for e, b in zip(empty, best)]
            scores[begin:end] = np.where(empty, 0.0, score)
            costs[begin:end] = np.where(empty, 0.0, least)
        return found, scores, costs


def sample(labelled: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id") -> dict[str, str]:
    """{language: text}: at most SAMPLE_ROWS whole rows a language of SAMPLE_CHARS code points in all, one after another.

    Rows without label or text give none. Rows of at most ROW_CHARS code points come first, by a hash; longer ones follow by
    length. A row that doesn't fit in what is left isn't taken; the first always is, so a language whose shortest labelled
    row is longer than SAMPLE_CHARS learns from that row alone. Rows that repeat each other take their places
    and are used once. Places are decided
    on lengths and hashes: each task keeps its own first ones before any are exchanged, and only chosen texts are moved.
    """
    size = F.length(text)
    rows = labelled.select(F.col(label).alias("lang"), size.alias("size"), F.xxhash64(F.col(key).cast("string"), text).alias("at"), F.col(text).alias("whole"))
    rows = rows.where("lang is not null and whole is not null and size > 0")
    order = Window.partitionBy("lang").orderBy(F.greatest("size", F.lit(ROW_CHARS)), "at", "size")
    first = rows.select("lang", "size", "at").withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= SAMPLE_ROWS).collect()
    chosen: dict[tuple[str, int], int] = {}
    used: dict[str, int] = {}
    for row in sorted(first, key=lambda r: (r.lang, r.rank)):
        if (row.lang, row.at) not in chosen and (row.lang not in used or used[row.lang] + row.size <= SAMPLE_CHARS):
            used[row.lang] = used.get(row.lang, 0) + row.size
            chosen[row.lang, row.at] = row.rank
    if not chosen:
        return {}
    picks = labelled.sparkSession.createDataFrame([(*k, r) for k, r in chosen.items()], "lang string, at long, rank int")
    found: dict[str, list[str]] = {}
    # picks: at most SAMPLE_ROWS rows of two numbers a language
    for row in rows.join(F.broadcast(picks), ["lang", "at"]).dropDuplicates(["lang", "at"]).orderBy("lang", "rank").select("lang", "whole").collect():
        found.setdefault(row.lang, []).append(row.whole)
    return {x: " ".join(parts) for x, parts in found.items()}


def identify(docs: DataFrame, labelled: dict[str, str], text: str = "text") -> DataFrame:
    """All columns of docs with lang_pred, score (0 to 1) and bits (a symbol, against lang_pred).

    score is 1 - cost of the best language / cost of the second. A text that is null or has no
    letter is ``und`` with score 0; so is every text if there is no labelled text. Ties go to
    the first language by name. Columns of docs with these names are replaced.
    """
    prepare(docs.sparkSession)
    docs = docs.drop("lang_pred", "score", "bits")
    names, at = docs.columns, docs.columns.index(text)
    model = docs.sparkSession.sparkContext.broadcast(Parser(labelled))  # bounded by the sample

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, batch.num_rows, TEXT_BATCH_ROWS):
                part = batch.slice(begin, TEXT_BATCH_ROWS)
                found, scores, costs = model.value.predict(part.column(at).to_pylist())
                made = [pa.array(found, pa.string()), pa.array(scores), pa.array(costs)]
                yield pa.RecordBatch.from_arrays([*part.columns, *made], [*names, "lang_pred", "score", "bits"])

    schema = docs.withColumns({"lang_pred": F.lit(""), "score": F.lit(0.0), "bits": F.lit(0.0)}).schema
    return docs.mapInArrow(freeing(run), schema)


def with_letters(docs: DataFrame, text: str = "text") -> DataFrame:
    """The rows of docs whose text has a letter, by the classes that identify() uses."""
    prepare(docs.sparkSession)
    at = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = [bool((letters(t) != 32).any()) for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(some, pa.bool_()))

    return docs.mapInArrow(freeing(run), docs.schema)


def fold(key: Column, folds: int) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % folds, F.lit(0))
