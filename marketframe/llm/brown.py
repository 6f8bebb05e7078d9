"""Brown class-based n-gram scoring.

Words of the training documents are counted by Spark. Every word that occurs more than ONCE times is known and gets one of CLASSES
classes by exchange on its adjacency counts: it moves to the class that raises the likelihood of the class bigrams most. The CLUSTERED most
frequent words (the head) move one after the other, on the table of their pairs with each other and with the classes of all other words; the
others all at once against the current classes, each from the row of its neighbours, which is written once. Both take turns until the
likelihood of a token rises by less than RISE, SWEEPS times at most. Words seen once stand for unknown ones as the tail class, and the end of a text is a class of
its own. A token has probability P(class | class before) P(word | class): transitions are interpolated with class frequencies, emissions are
relative frequencies, with one added in the tail so that unknown words have some.

Sizes: workers hold the LISTED most frequent words, the head's table of (CLUSTERED + CLASSES + 3) ** 2 cells, and two bytes of class per known word. The
other known words stay in tables: in training and in scoring they reach their numbers, counts and classes by shuffle joins of the few tokens
beyond the list, so the result does not depend on LISTED. A row of neighbours has at most two entries per occurrence of its word, and
none for pairs within the head. Counts cover all training documents and all their words.

Null and empty texts have the end as their only token; a null id counts as training; repeated rows are counted and scored each;
ties in frequency at the limit of the list leave all words of that frequency beyond it, ties at that of the head go by hash; an empty
training set gives every token the probability of an unknown one; other columns are ignored; an empty table gives no rows.
"""
from __future__ import annotations

from copy import copy
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.hasharrays import HashArray, Tally
from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf, arrays

LISTED, CLUSTERED, CLASSES = 1 << 19, 1024, 64
SWEEPS = 12
#: a turn that raises the log likelihood of a token by less than this is the last one
RISE = 0.001
#: words this rare are tail words, so that the tail's transitions are those of new words
ONCE = 1
#: pseudo-tokens of the class frequencies in a transition
PRIOR = 20.0
#: adjacency counts up to this are looked up in tables of gains
SMALL = 16
END = np.uint64(0x9B1A6F0D5C4E3721)
SCORED = "rid long, doc_id long, held_out boolean, n_tokens long, n_known long, log_counts double, score double, tail array<long>, before array<short>, after array<short>"
NEIGHBOURS = "w int, entries binary"
#: marks the hash of a word beyond the list among ids
OPEN = np.int64(-1 << 63)


def _count(batches):
    tally = Tally(("h", "c"))
    for batch in batches:
        yield from tally.add(np.array([END]), np.array([len(batch)]))
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(lower=True)
            yield from tally.add(*np.unique(chunk.hash, return_counts=True))
    yield from tally.end()


def vocabulary(docs: DataFrame) -> DataFrame:
    """(h, c): every token of docs (text), the end included, with its count."""
    return docs.select("text").mapInArrow(_count, "h long, c long").groupBy("h").agg(F.sum("c").alias("c"))


def _least_count(levels: list[tuple[int, int]], bound: int) -> int:
    """The smallest count such that at most bound words have it or more; levels: (count, words), falling."""
    total, least = 0, None
    for c, n in levels:
        total += n
        if total > bound:
            break
        least = c
    return least if least is not None else (levels[0][0] + 1 if levels else 1)


class Words:
    """The listed words with counts and ids by falling count; ids of the other known words follow, then the tail and the end."""

    def __init__(self, keys: np.ndarray, counts: np.ndarray, clustered: int, known: int, once: int, ends: int, tokens: int, distinct: int):
        order = np.lexsort((keys, -counts))
        self.n, self.m, self.known = len(keys), min(clustered, known), known
        self.tail, self.end = known, known + 1
        self.array = HashArray(keys[order].view(np.uint64), np.arange(self.n), counts[order])
        self.once, self.ends, self.tokens, self.distinct = once, ends, tokens, distinct

    @property
    def whole(self) -> bool:
        """Whether all known words are listed."""
        return self.n == self.known

    def bare(self) -> Words:
        """The numbers without the list."""
        out = copy(self)
        out.array = None
        return out

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Position of every word in the list, -1 beyond it."""
        return self.array.find(hashes) if self.n else np.full(len(hashes), -1, dtype=np.int32)

    def sequence(self, chunk: texts.Chunk) -> np.ndarray:
        """Ids of all tokens of a chunk, an end before the first; marked hashes of words beyond the list, the tail where no known word is."""
        at = self.find(chunk.hash)
        ids = np.full(len(at) + chunk.rows + 1, self.end, dtype=np.int64)
        beyond = np.int64(self.tail) if self.whole else chunk.hash.view(np.int64) | OPEN
        ids[np.arange(len(at)) + chunk.row + 1] = np.where(at >= 0, self.array.values[0][np.maximum(at, 0)], beyond) if self.n else beyond
        return ids

    def moving(self, ids: np.ndarray) -> np.ndarray:
        """Which ids are words beyond the head."""
        return (ids >= self.m) & (ids < self.known)


def _entries(words: Words, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Keys (word, neighbour, side) of adjacent ids: under each word beyond the head, under the left one where there is none."""
    on_left, on_right = words.moving(left), words.moving(right)
    keep = on_left | ~on_right
    return np.concatenate([(left[keep] << 32) | (right[keep] << 1), (right[on_right] << 32) | (left[on_right] << 1) | 1]).view(np.uint64)


def _rows(key: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
    """w and its entries (neighbour and side, count as 32-bit numbers) from sorted keys."""
    w = (key >> np.uint64(32)).astype(np.int32)
    first = np.flatnonzero(np.append(True, w[1:] != w[:-1])) if len(w) else np.zeros(0, dtype=np.int64)
    body = np.stack([(key & np.uint64(0xFFFFFFFF)).astype(np.uint32), n.astype(np.uint32)], axis=1)
    ends = (np.append(first, len(w)) * 8).astype(np.int32)
    return pa.RecordBatch.from_arrays([pa.array(w[first]), pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(body)])], names=["w", "entries"])


def _adjacent(batches, held):
    words, tally = held.value, Tally(("g", "c"), 1_500_000)

    def rows(parts):
        for part in parts:
            yield _rows(part.column("g").to_numpy().view(np.uint64), part.column("c").to_numpy())
    for batch in batches:
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(lower=True)
            ids = words.sequence(chunk)
            both = (ids[:-1] >= 0) & (ids[1:] >= 0)
            yield from rows(tally.add(*np.unique(_entries(words, ids[:-1][both], ids[1:][both]), return_counts=True)))
    yield from rows(tally.end())


def _open_pairs(batches, held):
    """Adjacent tokens of which one is beyond the list."""
    words = held.value
    for batch in batches:
        for chunk in texts.chunks(batch.column("text")):
            chunk.words(lower=True)
            ids = words.sequence(chunk)
            at = np.flatnonzero((ids[:-1] < 0) | (ids[1:] < 0))
            yield pa.RecordBatch.from_arrays([pa.array(ids[at]), pa.array(ids[at + 1])], names=["a", "b"])


def _numbered(batches, held):
    for batch in batches:
        yield _rows(*np.unique(_entries(held.value, *(batch.column(x).to_numpy() for x in ("a", "b"))), return_counts=True))


def neighbours(docs: DataFrame, held, more: DataFrame | None, shelf: Shelf) -> DataFrame:
    """docs: text; more: h, id of the known words beyond the list. w and entries, a row per word: its adjacency counts in all texts."""
    rows = docs.select("text").mapInArrow(lambda b: _adjacent(b, held), NEIGHBOURS)
    if more is not None:
        pairs = shelf.put(docs.select("text").mapInArrow(lambda b: _open_pairs(b, held), "a long, b long"), "pairs")
        ids = more.select(F.col("h").bitwiseOR(F.lit(int(OPEN))).alias("key"), F.col("id").cast("long").alias("id"))
        tail = F.lit(held.value.tail).cast("long")

        def numbered(found: DataFrame, side: str) -> DataFrame:
            return found.join(ids, F.col(side) == F.col("key"), "left").withColumn(side, F.coalesce("id", tail)).select("a", "b")
        a, b = F.col("a") < 0, F.col("b") < 0
        for found in (numbered(pairs.where(a & ~b), "a"), numbered(pairs.where(b & ~a), "b"), numbered(numbered(pairs.where(a & b), "a"), "b")):
            rows = rows.unionByName(found.mapInArrow(lambda b: _numbered(b, held), NEIGHBOURS))
    return rows.groupBy("w").agg(F.collect_list("entries").alias("entries")).mapInArrow(_merged, NEIGHBOURS)


def _entries_of(bodies: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Entries in each of some binary values, and all of them."""
    if not len(bodies):
        return np.zeros(0, dtype=np.int64), np.zeros((0, 2), dtype=np.uint32)
    ends = np.frombuffer(bodies.buffers()[1], dtype=np.int32)[bodies.offset:bodies.offset + len(bodies) + 1]
    return np.diff(ends) // 8, np.frombuffer(bodies.buffers()[2], dtype=np.uint32)[ends[0] // 4:ends[-1] // 4].reshape(-1, 2)


def _merged(batches):
    """Rows with a list of entries from several tasks, as rows with each entry once."""
    for batch in batches:
        w, lists = batch.column("w").to_numpy(), batch.column("entries")
        size, body = _entries_of(lists.flatten())
        key = (np.repeat(np.repeat(w, np.diff(lists.offsets.to_numpy())), size).astype(np.uint64) << np.uint64(32)) | body[:, 0]
        order = np.argsort(key)
        key = key[order]
        first = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, dtype=np.int64)
        yield _rows(key[first], np.add.reduceat(body[order, 1].astype(np.int64), first) if len(key) else first)


def _unpacked(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words of the rows; row, neighbour, side and count of every entry."""
    w = batch.column("w").to_numpy()
    size, body = _entries_of(batch.column("entries"))
    return w, np.repeat(np.arange(len(w)), size), (body[:, 0] >> 1).astype(np.int64), body[:, 0] & 1, body[:, 1].astype(np.float64)


def _unit_cells(batches, state):
    words, label = state.value.words, state.value.label
    unit = np.where(np.arange(len(label)) < words.m, np.arange(len(label)), words.m + label.astype(np.int64))
    size = words.m + state.value.classes + 3
    total, cells, counts, waiting = np.zeros(size ** 2), [], [], 0

    def add():
        if cells:
            total[:] += np.bincount(np.concatenate(cells), np.concatenate(counts), len(total))
    for batch in batches:
        w, row, other, side, n = _unpacked(batch)
        own = w[row]
        right, left = side == 0, (side == 1) & ~words.moving(other)
        cells += [unit[own[right]] * size + unit[other[right]], unit[other[left]] * size + unit[own[left]]]
        counts += [n[right], n[left]]
        waiting += len(n)
        if waiting > 1_000_000:
            add()
            cells, counts, waiting = [], [], 0
    add()
    cell = np.flatnonzero(total)
    for i in range(0, len(cell), 100_000):
        yield pa.RecordBatch.from_arrays([pa.array(cell[i:i + 100_000].astype(np.int32)), pa.array(total[cell[i:i + 100_000]].astype(np.int64))], names=["cell", "n"])


def _f(x: np.ndarray) -> np.ndarray:
    return x * np.log(np.maximum(x, 1e-300)) * (x > 0)


def exchange(pairs: np.ndarray, m: int, classes: int = CLASSES, sweeps: int = SWEEPS, label: np.ndarray | None = None) -> np.ndarray:
    """Class of every id. pairs: adjacency counts; ids from m on keep their classes: those in label, else their own (classes + id - m)."""
    size = len(pairs)
    label = np.concatenate([np.arange(m) % classes, classes + np.arange(size - m)]) if label is None else label.copy()
    k = max(classes, int(label.max()) + 1)
    one = np.zeros((size, k))
    one[np.arange(size), label] = 1
    right, left = pairs @ one, pairs.T @ one            # id followed by class, id preceded by class
    both = one.T @ right
    f = _f
    for _ in range(sweeps):
        moved = 0
        for w in range(m):
            a, self_n = label[w], pairs[w, w]
            out, into = right[w].copy(), left[w].copy()
            if not out.sum() and not into.sum():
                continue
            out[a] -= self_n
            into[a] -= self_n
            # take the word out of its class
            both[a, :] -= right[w]
            both[:, a] -= left[w]
            both[a, a] += self_n
            rows, cols = both.sum(axis=1), both.sum(axis=0)
            # gain of each class: changed cells of its row and column, then its totals
            base = both[:classes, :]
            gain = (f(base + out[None, :]) - f(base)).sum(axis=1)
            column = both[:, :classes]
            gain += (f(column + into[:, None]) - f(column)).sum(axis=0)
            diagonal = both[np.arange(classes), np.arange(classes)]
            o, i = out[:classes], into[:classes]
            gain -= f(diagonal + o) - f(diagonal) + f(diagonal + i) - f(diagonal)
            gain += f(diagonal + o + i + self_n) - f(diagonal)
            no, ni = out.sum() + self_n, into.sum() + self_n
            gain -= f(rows[:classes] + no) - f(rows[:classes]) + f(cols[:classes] + ni) - f(cols[:classes])
            b = int(np.argmax(np.round(gain, 6)))
            both[b, :] += out
            both[:, b] += into
            both[b, b] += self_n
            if b != a:
                moved += 1
                label[w] = b
                right[:, a] -= pairs[:, w]
                right[:, b] += pairs[:, w]
                left[:, a] -= pairs[w, :]
                left[:, b] += pairs[w, :]
        if moved <= m // 100:
            break
    return label


class State(NamedTuple):
    """Class of every id (tail: classes, end: classes + 1, not yet in one: classes + 2), class bigrams and their likelihood."""

    words: Words
    classes: int
    label: np.ndarray
    n: np.ndarray
    value: float


def settled(table: DataFrame, words: Words, classes: int, label: np.ndarray) -> State:
    """The state in which the head has moved by exchange, given the classes of all other words."""
    held = table.sparkSession.sparkContext.broadcast(State(words.bare(), classes, label, None, 0.0))
    cells = arrays(table.mapInArrow(lambda b: _unit_cells(b, held), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    held.destroy()
    size = words.m + classes + 3
    units = np.zeros(size ** 2)
    units[cells["cell"]] = cells["n"]
    units = units.reshape(size, size)
    of = exchange(units, words.m, classes, label=np.concatenate([label[:words.m], np.arange(classes + 3)]).astype(np.int64))
    label = label.copy()
    label[:words.m] = of[:words.m]
    n = np.zeros((classes + 3, classes + 3))
    np.add.at(n, (of[:, None], of[None, :]), units)
    return State(words, classes, label, n, float(_f(n).sum() - _f(n.sum(axis=1)).sum() - _f(n.sum(axis=0)).sum()))


def _moves(batches, held):
    """w and its new class, for the words beyond the head that another class would suit better."""
    words, classes, label, n, _ = held.value
    c = classes + 3
    rows, cols = n.sum(axis=1), n.sum(axis=0)
    # of each side: counts by (class beside the word, class it may take), and gains of small counts
    base = np.stack([n[:classes].T, n[:, :classes]])
    table = np.stack([_f(base + x) - _f(base) for x in range(1, SMALL + 1)], axis=1)
    for batch in batches:
        batch = batch.filter(pa.array(words.moving(batch.column("w").to_numpy())))
        if not batch.num_rows:
            continue
        w, row, other, side, count = _unpacked(batch)
        seen = np.bincount((row * 2 + side) * c + label[other], count, len(w) * 2 * c)
        at = np.flatnonzero(seen)
        x, beside = seen[at], at % c
        row, side = at // c // 2, at // c % 2
        gain = np.zeros((len(w), classes))
        small = x <= SMALL
        for some, part in ((small, lambda i: table[side[i], x[i].astype(np.int64) - 1, beside[i]]),
                           (~small, lambda i: _f(base[side[i], beside[i]] + x[i, None]) - _f(base[side[i], beside[i]]))):
            some = np.flatnonzero(some)
            for i in np.array_split(some, len(some) // 50_000 + 1):
                if len(i):
                    first = np.flatnonzero(np.append(True, row[i[1:]] != row[i[:-1]]))
                    gain[row[i[first]]] += np.add.reduceat(part(i), first)
        out, into = (np.bincount(row, x * (side == k), len(w)) for k in (0, 1))
        gain -= _f(rows[:classes] + out[:, None]) - _f(rows[:classes]) + _f(cols[:classes] + into[:, None]) - _f(cols[:classes])
        # staying: the same, with the word taken out of its class
        now = label[w].astype(np.int64)
        own = now[row]
        cell = np.where(side == 0, n[own, beside], n[beside, own])
        stay = np.bincount(row, _f(cell) - _f(np.maximum(cell - x, 0)), len(w))
        stay -= _f(rows[now]) - _f(rows[now] - out) + _f(cols[now]) - _f(cols[now] - into)
        in_class = np.flatnonzero(now < classes)
        gain[in_class, now[in_class]] = stay[in_class]
        to = np.argmax(np.round(gain, 6), axis=1)
        moved = to != now
        yield pa.RecordBatch.from_arrays([pa.array(w[moved]), pa.array(to[moved].astype(np.int16))], names=["w", "to"])


def cluster(table: DataFrame, words: Words, classes: int, sweeps: int = SWEEPS) -> State:
    """The classes of all known words by turns of the head and of the others (table: see neighbours())."""
    label = np.full(words.known + 2, classes + 2, dtype=np.int16)
    label[:words.m], label[words.tail], label[words.end] = np.arange(words.m) % classes, classes, classes + 1
    state = settled(table, words, classes, label)
    if words.m == words.known:
        return state
    for i in range(sweeps):
        held = table.sparkSession.sparkContext.broadcast(state._replace(words=words.bare()))
        moves = arrays(table.mapInArrow(lambda b: _moves(b, held), "w int, to short"))
        held.destroy()
        label = state.label.copy()
        label[moves["w"]] = moves["to"]
        after = settled(table, words, classes, label)
        rise = after.value - state.value
        # the first turn puts words into classes, later ones must raise the likelihood
        if not i or rise > 0:
            state = after
        if i and rise < RISE * words.tokens:
            break
    return state


class ClassModel:
    """Classes, log10 transition table and log10 emissions of the listed words."""

    def __init__(self, state: State):
        words = self.words = state.words
        self.label = state.label
        self.classes = state.classes
        k = state.classes + 2
        n = state.n[:k, :k]
        freq = (n.sum(axis=0) + 1) / (n.sum() + k)
        self.move = np.log10((n + PRIOR * freq[None, :]) / (n.sum(axis=1, keepdims=True) + PRIOR))
        self.total = n.sum(axis=0)
        ids, counts = words.array.values
        self.emit = np.log10(counts / self.total[self.label[ids]]) if len(ids) else np.zeros(0)
        self.tail = -np.log10(2 * words.once + 1)

    def score(self, batches):
        """SCORED: sums over the listed words and the ends; the other words with the classes beside them, -1 for another such word."""
        w = self.words
        for batch in batches:
            parts, tails = [], []
            for chunk in texts.chunks(batch.column("text")):
                chunk.words(lower=True)
                at = w.find(chunk.hash)
                listed = at >= 0
                place = np.arange(len(at)) + chunk.row + 1
                cls = np.full(len(at) + chunk.rows + 1, self.classes + 1, dtype=np.int64)
                cls[place] = -1
                cls[place[listed]] = self.label[w.array.values[0][at[listed]]]
                step = np.where((cls[:-1] >= 0) & (cls[1:] >= 0), self.move[cls[:-1], cls[1:]], 0.0)
                own = np.append(chunk.row, np.arange(chunk.rows))
                step_of = np.concatenate([step[place - 1], step[np.cumsum(chunk.count()) + np.arange(chunk.rows)]])
                score = texts.row_sums(own, step_of, chunk.rows) + texts.row_sums(chunk.row[listed], self.emit[at[listed]], chunk.rows)
                logs = texts.row_sums(chunk.row[listed], np.log10(w.array.values[1][at[listed]] + 1.0), chunk.rows) + np.log10(w.ends + 1)
                parts.append((chunk.count() + 1, chunk.count(listed) + (1 if w.ends else 0), logs, score, chunk.count(~listed)))
                tails.append((chunk.hash[~listed].view(np.int64), *(cls[place[~listed] + k].astype(np.int16) for k in (-1, 1))))
            if parts:
                n, known, logs, score, n_tail = (np.concatenate(x) for x in zip(*parts))
                ends = pa.array(np.concatenate(([0], np.cumsum(n_tail))).astype(np.int32))
                lists = [pa.ListArray.from_arrays(ends, pa.array(np.concatenate(x))) for x in zip(*tails)]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("doc_id").cast(pa.int64()), batch.column("held_out"), pa.array(n), pa.array(known),
                                                  pa.array(logs), pa.array(score), *lists], names=[x.split()[0] for x in SCORED.split(", ")])

    def score_others(self, batches):
        """batches: rid and t, the words beyond the list in text order (place, cls, c, before, after). What they add to the sums of a text."""
        for batch in batches:
            lists = batch.column("t")
            rows = np.repeat(np.arange(len(lists)), np.diff(lists.offsets.to_numpy()))
            flat = lists.flatten()
            cls, c, before, after = (pc.fill_null(pc.struct_field(flat, x), y).to_numpy().astype(np.int64) for x, y in (("cls", self.classes), ("c", 0), ("before", -1), ("after", -1)))
            # the word after one whose class after is unknown is the next of the text's other words
            after = np.where(after < 0, np.append(cls[1:], 0), after)
            score = self.move[cls, after] + np.where(before >= 0, self.move[np.maximum(before, 0), cls], 0.0)
            tail = cls == self.classes
            score += np.where(tail, np.log10(c + 1.0) + self.tail, np.log10(np.maximum(c, 1) / self.total[cls].clip(1)))
            sums = [np.bincount(rows, x, len(lists)) for x in (score, np.log10(c + 1.0), c > 0)]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), *map(pa.array, sums[:2]), pa.array(sums[2].astype(np.int64))], names=["rid", "more_score", "more", "found"])


def _others(words: DataFrame, shelf: Shelf, first: int) -> DataFrame:
    """words: h, c. The same with ids from first on."""
    rows = shelf.put(words.withColumn("place", F.monotonically_increasing_id()), "others")
    part, at = F.shiftright("place", 33), F.col("place").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted((r[0], r[1]) for r in rows.groupBy(part).agg(F.max(at) + 1).collect())
    starts = np.concatenate(([first], first + np.cumsum([n for _, n in sizes])))
    start = F.create_map(*[F.lit(x) for (k, _), s in zip(sizes, starts.tolist()) for x in (k, s)])
    return rows.select("h", "c", (F.element_at(start, part) + at).cast("int").alias("id"))


def fit(docs: DataFrame, shelf: Shelf, listed: int = LISTED, clustered: int = CLUSTERED, classes: int = CLASSES) -> tuple[ClassModel, DataFrame]:
    """The model of docs (text), and the table of the words beyond the list: h, c, cls."""
    vocab = shelf.put(vocabulary(docs), "vocabulary")
    end = int(END.astype(np.int64))
    tokens, distinct = vocab.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    levels = [(r[0], r[1]) for r in vocab.where(F.col("h") != end).groupBy("c").count().orderBy(F.desc("c")).collect()]
    ends = vocab.where(F.col("h") == end).select(F.sum("c")).first()[0] or 0
    known, once = (sum(n for c, n in levels if (c > ONCE) == more) for more in (True, False))
    least = max(ONCE + 1, _least_count(levels, listed))
    repeated = vocab.where((F.col("h") != end) & (F.col("c") > ONCE))
    held_rows, beyond = repeated.where(F.col("c") >= least), repeated.where(F.col("c") < least)
    if sum(n for c, n in levels if c >= least) < min(clustered, known):
        # the head is listed in any case
        held_rows = repeated.orderBy(F.desc("c"), "h").limit(clustered)
        beyond = repeated.join(held_rows.select("h"), "h", "left_anti")
    rows = arrays(held_rows)
    words = Words(rows["h"], rows["c"], clustered, known, once, ends, tokens, distinct)
    more = None if words.whole else _others(beyond.select("h", "c"), shelf, words.n)
    held = docs.sparkSession.sparkContext.broadcast(words)
    table = shelf.put(neighbours(docs, held, more, shelf), "neighbours")
    state = cluster(table, words, classes)
    shelf.drop(table)
    others = vocab.where((F.col("h") != end) & (F.col("c") <= ONCE)).select("h", "c", F.lit(classes).cast("short").alias("cls"))
    if more is not None:
        label = docs.sparkSession.sparkContext.broadcast(state.label)

        def classed(batches):
            for batch in batches:
                yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("c"), pa.array(label.value[batch.column("id").to_numpy()])], names=["h", "c", "cls"])
        others = others.unionByName(more.mapInArrow(classed, "h long, c long, cls short"))
    return ClassModel(state), others


def score(docs: DataFrame, held_out, listed: int = LISTED, clustered: int = CLUSTERED, classes: int = CLASSES) -> DataFrame:
    """docs (doc_id, text) scored by a model of the rows where the condition held_out is false."""
    shelf = Shelf(docs.sparkSession, "brown")
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    model, others = fit(rows.where(~F.col("held_out")), shelf, listed, clustered, classes)
    words, held = model.words, docs.sparkSession.sparkContext.broadcast(model)
    # row numbers become stable by being written
    scored = shelf.put(rows.withColumn("rid", F.monotonically_increasing_id()).mapInArrow(lambda b: held.value.score(b), SCORED), "scored")
    tail = scored.select("rid", F.posexplode(F.arrays_zip("tail", "before", "after")).alias("place", "x")).select("rid", "place", F.col("x.tail").alias("h"), "x.before", "x.after")
    more = (tail.join(others, "h", "left").groupBy("rid").agg(F.array_sort(F.collect_list(F.struct("place", "cls", "c", "before", "after"))).alias("t"))
            .mapInArrow(lambda b: held.value.score_others(b), "rid long, more_score double, more double, found long"))
    whole = float(np.log10(words.tokens + words.distinct + 1))
    zero = lambda x: F.coalesce(x, F.lit(0))
    return (scored.drop("tail", "before", "after").join(more, "rid", "left")
            .select("doc_id", "held_out", "n_tokens", (F.col("n_known") + zero("found")).alias("n_known"),
                    F.lit(int(words.tokens)).cast("long").alias("train_tokens"), (F.col("log_counts") + zero("more") - F.col("n_tokens") * whole).alias("base_score"),
                    (F.col("score") + zero("more_score")).alias("score")))


@query("op7_brown_classes")
def op7_brown_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.expr("crc32(cast(doc_id as string)) % 7 = 2")
    return score(table(spark, sf_dir, "documents"), held_out).withColumn("perplexity", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")))
