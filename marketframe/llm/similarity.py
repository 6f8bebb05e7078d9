"""N-gram Jaccard join: documents whose sets of word shingles overlap by at least a percentage, and their components.

Rule has the words of a shingle and the percentage; band ends and bucket counts follow from them. The query has three words and 90 %.

Method. Each distinct set becomes one class (copies collapse before anything is joined). Classes are banded by set size; a size
near the lower edge of its band joins the band below too, so that every linkable pair shares a band. A band deals each set's
shingles into more buckets than linkable sets can differ in, so two linked sets agree in all of at least one bucket: classes
that share a bucket's content form a tile. There are SLACK and a SPARE-th more buckets than the pigeonhole asks for, and each set leaves out as many
of its own: the thinnest first, in an order of buckets by their content. Linked sets agree in more buckets than that, and those of them that either leaves
out are all among the ones left out by the set that goes further, so one stays in both. Nothing is lost by this; empty and thin buckets, in which long
documents agree by chance, make no tiles, and neither does a passage that many documents share, because whole buckets have to agree. Within tiles, hashed bitmap signatures (parity bits) bound the overlap from above: the
set bits of their exclusive-or never exceed the size of the symmetric difference. Pairs that pass meet wider bitmaps, of two bits a
shingle, and those that pass again are confirmed by intersecting the exact sorted arrays.

A tile is not expanded into its pairs. First each class meets one class, the least of those that are the smallest of its tiles, then
the smallest of each of its tiles where the two are still apart; the confirmed links give components. Only tiles that still hold several components are compared in full, as blocks of at most TILE rows whose bitmaps
are compared in arrays; blocks are spread over tasks, so one large group fills no task. Pairs are no rows there: a block hands on the circles of
classes that its bitmaps connect, wide bitmaps part them, and where sets are compared only links that connect a circle are handed on. linked() and keep_one() need no links
inside one component: the components are those of all links. join() lists them: it compares every tile in full, in the same blocks,
and returns all pairs of classes that link and the number of links of every row.

Nulls and empty texts have no shingles and link with nothing; fewer words than a shingle has are one shingle; repeated rows and ties
are copies of one class; columns other than doc_id and text are ignored; an empty table gives no rows. Shingles and classes
are 64-bit hashes.
"""
from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from marketframe.llm import texts
from marketframe.llm.graphs import components
from marketframe.llm.registry import query, table
from marketframe.llm.storage import Shelf, arrays

#: longs of a parity bitmap
BITS = 16
#: ratio of a band's ends
RATIO = 1.5
#: buckets above the pigeonhole minimum, and one more for so many of them: each set leaves out as many of its thinnest
SLACK, SPARE = 4, 5
TILE = 512
#: shingles of a part of a circle whose sets are compared
MASS = 1 << 20
#: bits of the filter in front of the shuffle of exact sets: 2 MB whatever the input
FILTER_BITS = 1 << 24
SIGNED = "doc_id long, th long, n long, cls long, keys array<long>, bits array<long>"


@dataclass(frozen=True)
class Rule:
    """Shingles of so many words, and the overlap that links: 100 * intersection >= percent * union."""

    words: int = 3
    percent: int = 90

    def __post_init__(self):
        # linkable sets lie in one band or in neighbouring ones, so a band's ratio has to exceed that of their sizes
        if self.words < 1 or not 100 / RATIO < self.percent < 100:
            raise ValueError(f"shingles need a word, and links more than {100 / RATIO:.0f} and less than 100 percent: {self}")

    @property
    def least(self) -> int:
        """Smallest size that can differ and still link: n / (n + 1) reaches the percentage."""
        return -(-self.percent // (100 - self.percent))

    @cached_property
    def edges(self) -> np.ndarray:
        """Lower ends of the bands, up to sets of 2 ** 40 shingles."""
        out = [self.least]
        while out[-1] < 1 << 40:
            out.append(int(out[-1] * RATIO) + 1)
        return np.array(out, dtype=np.int64)

    def differ(self, size: np.ndarray) -> np.ndarray:
        """Most shingles in which a set of this size and a linked one that is no smaller can differ."""
        return size * (100 - self.percent) // self.percent


#: three words and 90 percent, as the query has them
RULE = Rule()


def shingles(chunk: texts.Chunk, words: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the distinct shingles, ordered by both."""
    chunk.words(lower=True)
    h, inside = texts.window_hash(chunk.hash, chunk.row, words)
    row = chunk.row[:len(h)][inside]
    h = h[inside]
    n = chunk.count()
    first = np.concatenate(([0], np.cumsum(n)))
    for size in range(1, words):
        short = np.flatnonzero(n == size)
        if len(short):
            whole, _ = texts.window_hash(chunk.hash, np.zeros(len(chunk.hash), dtype=np.int64), size)
            row = np.concatenate([row, short])
            h = np.concatenate([h, texts.mix(whole[first[short]] ^ np.uint64(size))])
    row, h, _ = texts.distinct_per_row(row, h)
    return row, h


def _tile_keys(row: np.ndarray, h: np.ndarray, band: np.ndarray, rows: int, rule: Rule):
    """(row, key) of the buckets of the rows that have a band (band < 0: none), without the thinnest ones of each row."""
    on = band >= 0
    top = rule.edges[np.minimum(np.maximum(band, 0) + 1, len(rule.edges) - 1)]
    differ = rule.differ(top)
    spare = SLACK + differ // SPARE
    k = np.where(on, differ + 1 + spare, 0)
    base = np.concatenate(([0], np.cumsum(k)))
    keep = on[row]
    r, x = row[keep], texts.mix(h[keep] ^ np.uint64(0x5851F42D4C957F2D))
    at = base[r] + ((x >> np.uint64(33)) % k[r].astype(np.uint64)).astype(np.int64)
    total, filled = np.zeros(base[-1], dtype=np.uint64), np.zeros(base[-1], dtype=np.int64)
    np.add.at(total, at, texts.mix(x))
    np.add.at(filled, at, 1)
    owner = np.repeat(np.arange(rows), k)
    slot = np.arange(base[-1]) - base[owner]
    place = texts.mix((band[owner].astype(np.uint64) << np.uint64(40)) ^ slot.astype(np.uint64))
    key = texts.mix(total ^ place ^ (filled.astype(np.uint64) << np.uint64(50)))
    # an order by content alone, so that sets that agree in a bucket place it alike
    order = np.lexsort((key, filled, owner))
    good = order[np.arange(len(order)) - base[owner] >= spare[owner]]
    return owner[good], key[good]


def signatures(batches, rule: Rule):
    """doc_id, th, text -> SIGNED."""
    for batch in batches:
        for chunk in texts.chunks(batch.column("text")):
            row, h = shingles(chunk, rule.words)
            rows = chunk.rows
            n = np.bincount(row, minlength=rows)
            s1 = np.zeros(rows, dtype=np.uint64)
            np.add.at(s1, row, texts.mix(h ^ np.uint64(0x2545F4914F6CDD1D)))
            cls = texts.mix(s1 ^ (n.astype(np.uint64) << np.uint64(44)))
            bits = np.zeros((rows, BITS), dtype=np.uint64)
            np.bitwise_xor.at(bits, (row, (h & np.uint64(BITS - 1)).astype(np.int64)), np.uint64(1) << ((h >> np.uint64(8)) & np.uint64(63)))
            band = np.searchsorted(rule.edges, n, side="right") - 1
            low = np.where((band > 0) & (rule.percent * n <= 100 * rule.edges[np.maximum(band, 0)]), band - 1, -1)
            parts = [_tile_keys(row, h, b, rows, rule) for b in (band, low)]
            owner, key = np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])
            order = np.argsort(owner, kind="stable")
            ends = np.concatenate(([0], np.cumsum(np.bincount(owner, minlength=rows)))).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id").cast(pa.int64()).slice(chunk.first, rows), batch.column("th").slice(chunk.first, rows), pa.array(n),
                 pa.array(cls.view(np.int64), mask=n == 0),
                 pa.ListArray.from_arrays(pa.array(ends), pa.array(key[order].view(np.int64))),
                 pa.ListArray.from_arrays(pa.array(np.arange(0, rows * BITS + 1, BITS, dtype=np.int32)), pa.array(bits.reshape(-1).view(np.int64)))],
                names=["doc_id", "th", "n", "cls", "keys", "bits"])


def signed(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """The signature of every row."""
    return docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(lambda b: signatures(b, rule), SIGNED)


def _bitmap(keys: DataFrame) -> np.ndarray:
    """A bitmap of hashed keys (column k) of fixed size, filled by Spark: it lets through all keys, and others when it is crowded."""
    at = F.pmod(F.col("k"), F.lit(FILTER_BITS))
    words = arrays(keys.groupBy(F.shiftright(at, 6).alias("w")).agg(F.bit_or(F.expr(f"shiftleft(1L, cast(pmod(k, {FILTER_BITS}) & 63 as int))")).alias("v")))
    out = np.zeros(FILTER_BITS // 64, dtype=np.uint64)
    out[words["w"]] = words["v"].view(np.uint64)
    return out


def _sets(batches, held, words: int):
    """The sorted shingles of the rows that the bitmap lets through."""
    bitmap = held.value
    for batch in batches:
        at = np.mod(batch.column("k").to_numpy(), FILTER_BITS)
        wanted = (bitmap[at >> 6] >> (at & 63).astype(np.uint64)) & np.uint64(1)
        part = pa.Table.from_batches([batch]).filter(pa.array(wanted.astype(bool))).combine_chunks()
        for own in part.to_batches():
            for chunk in texts.chunks(own.column("text")):
                row, h = shingles(chunk, words)
                n = np.bincount(row, minlength=chunk.rows)
                ends = np.concatenate(([0], np.cumsum(n))).astype(np.int32)
                yield pa.RecordBatch.from_arrays([own.column("doc_id").cast(pa.int64()).slice(chunk.first, chunk.rows), own.column("th").slice(chunk.first, chunk.rows),
                                                  pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], names=["doc_id", "th", "items"])


def _confirm(batches, percent: int):
    """(x, y, xs, ys) -> the pairs that link, by intersecting the sorted arrays."""
    for batch in batches:
        xs, ys = batch.column("xs"), batch.column("ys")
        good = []
        for i in range(len(batch)):
            a, b = xs[i].values.to_numpy().view(np.uint64), ys[i].values.to_numpy().view(np.uint64)
            at = np.searchsorted(a, b)
            both = int((a[np.minimum(at, len(a) - 1)] == b).sum())
            good.append(100 * both >= percent * (len(a) + len(b) - both))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(good, pa.bool_()))


def _wide(batches, held, words: int):
    """Parity bitmaps of about two bits a shingle, a power of two long, of the rows that the bitmap lets through."""
    for own in _sets(batches, held, words):
        items = own.column("items")
        out, sizes = [], []
        for x in items:
            h = x.values.to_numpy().view(np.uint64)
            slots = max(1024, 1 << int(2 * len(h) - 1).bit_length())
            odd = np.bincount((texts.mix(h) & np.uint64(slots - 1)).astype(np.int64), minlength=slots) & 1
            out.append(np.packbits(odd.astype(np.uint8), bitorder="little").view(np.int64))
            sizes.append(len(h))
        yield pa.RecordBatch.from_arrays([own.column("doc_id"), own.column("th"), pa.array(sizes, pa.int64()), pa.array(out, pa.list_(pa.int64()))], names=["doc_id", "th", "n", "wide"])


def _screen(batches, percent: int):
    """(x, y, nx, ny, wx, wy) -> the pairs whose wide bitmaps allow a link; a longer one is folded to the shorter."""
    for batch in batches:
        good = []
        for nx, ny, wx, wy in zip(batch.column("nx").to_pylist(), batch.column("ny").to_pylist(), batch.column("wx"), batch.column("wy")):
            a, b = wx.values.to_numpy().view(np.uint64), wy.values.to_numpy().view(np.uint64)
            a, b = (a, b) if len(a) <= len(b) else (b, a)
            while len(b) > len(a):
                b = b[:len(b) // 2] ^ b[len(b) // 2:]
            apart = int(np.bitwise_count(a ^ b).sum())
            good.append(apart * (100 + percent) <= (nx + ny) * (100 - percent))
        yield pa.RecordBatch.from_arrays([batch.column("x"), batch.column("y")], names=["x", "y"]).filter(pa.array(good, pa.bool_()))


def _bound(percent: int) -> Column:
    """Whether the bitmaps of two classes (nx, bx; ny, by) allow a link: |A xor B| <= (|A| + |B|) (100 - p) / (100 + p)."""
    apart = F.aggregate(F.zip_with("bx", "by", lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda s, v: s + v)
    total = F.col("nx") + F.col("ny")
    return ((apart * (100 + percent) <= total * (100 - percent)) & (100 * F.least("nx", "ny") >= percent * F.greatest("nx", "ny")))


def _fetched(wanted: DataFrame, docs: DataFrame, make, columns: str, shelf: Shelf, name: str, rule: Rule) -> DataFrame:
    """cls and columns made from the text that stands for it, of the wanted classes. wanted: cls, rep."""
    key = F.xxhash64("doc_id", "th").alias("k")
    wanted = shelf.put(wanted.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th")), f"wanted-{name}")
    held = docs.sparkSession.sparkContext.broadcast(_bitmap(wanted.select(key)))
    # only rows that may be wanted leave the scan; texts are not shuffled
    near = (docs.select("doc_id", F.xxhash64("text").alias("th"), "text").select("*", key)
            .mapInArrow(lambda b: make(b, held, rule.words), f"doc_id long, th long, {columns}"))
    same = near["doc_id"].eqNullSafe(wanted["doc_id"]) & (near["th"] == wanted["th"])
    names = [c.split()[0] for c in columns.split(", ")]
    out = shelf.put(near.join(wanted, same).groupBy("cls").agg(*[F.any_value(c).alias(c) for c in names]), name)
    shelf.drop(wanted)
    return out


def confirmed(pairs: DataFrame, classes: DataFrame, docs: DataFrame, shelf: Shelf, tag: str, rule: Rule) -> DataFrame:
    """Of distinct pairs (x, y) of classes, those that link. classes: cls, rep, n, bits."""
    side = [classes.select(F.col("cls").alias(k), F.col("n").alias(f"n{k}"), F.col("bits").alias(f"b{k}"), F.col("rep").alias(f"r{k}")) for k in "xy"]
    named = [side[0].select("x", "nx", "bx", "rx"), side[1].select("y", "ny", "by", "ry")]
    likely = shelf.put(pairs.join(named[0], "x").join(named[1], "y").where(_bound(rule.percent)).select("x", "y", "rx", "ry"), f"likely-{tag}")

    def fetched(chosen: DataFrame, make, columns: str, name: str) -> DataFrame:
        """What is made from the texts of the classes of chosen pairs."""
        wanted = chosen.select(F.explode(F.array(F.struct(F.col("x").alias("cls"), F.col("rx").alias("rep")),
                                                 F.struct(F.col("y").alias("cls"), F.col("ry").alias("rep")))).alias("s")).select("s.*").distinct()
        return _fetched(wanted, docs, make, columns, shelf, name, rule)
    # wide bitmaps first: large sets that only share a bucket by a common passage are told apart without their sets
    wide = fetched(likely, _wide, "n long, wide array<long>", f"wide-{tag}")
    passed = shelf.put(likely.select("x", "y").join(wide.select(F.col("cls").alias("x"), F.col("n").alias("nx"), F.col("wide").alias("wx")), "x")
                       .join(wide.select(F.col("cls").alias("y"), F.col("n").alias("ny"), F.col("wide").alias("wy")), "y").select("x", "y", "nx", "ny", "wx", "wy")
                       .mapInArrow(lambda b: _screen(b, rule.percent), "x long, y long"), f"passed-{tag}")
    sets = fetched(likely.join(passed, ["x", "y"]), _sets, "items array<long>", f"sets-{tag}")
    links = (passed.join(sets.select(F.col("cls").alias("x"), F.col("items").alias("xs")), "x")
            .join(sets.select(F.col("cls").alias("y"), F.col("items").alias("ys")), "y").select("x", "y", "xs", "ys")
            .mapInArrow(lambda b: _confirm(b, rule.percent), "x long, y long"))
    out = shelf.put(links.select(F.col("x").alias("a"), F.col("y").alias("b")), f"links-{tag}")
    for used in (sets, passed, wide, likely):
        shelf.drop(used)
    return out


def _folded(bits: np.ndarray, longs: int) -> np.ndarray:
    """Rows of parity bitmaps, folded to so many longs."""
    while bits.shape[-1] > longs:
        half = bits.shape[-1] // 2
        bits = bits[..., :half] ^ bits[..., half:]
    return bits


class _Blocks:
    """The members of the blocks of a batch as flat arrays, and the rows of each that may link. Bitmaps may differ in length."""

    def __init__(self, batch: pa.RecordBatch, percent: int):
        members = batch.column("members")
        self.percent, self.flat, ends = percent, members.values, members.offsets.to_numpy()
        self.spans = list(zip(ends[:-1].tolist(), ends[1:].tolist()))
        self.side, self.cls, root, self.n = (self.flat.field(c).to_numpy(zero_copy_only=False) for c in ("side", "cls", "root", "n"))
        self.root = root.copy()
        bits = self.flat.field("bits")
        self.at, self.bits = bits.offsets.to_numpy().astype(np.int64), bits.values.to_numpy().view(np.uint64)
        self.longs = np.diff(self.at)

    def open(self, lo: int, hi: int):
        """(row, rows on the other side, in other components at that time, that pass the bounds) of the block from lo to hi."""
        # side 0 and 1 are the parts of a tile, 2 stands in both
        left, right = lo + np.flatnonzero(self.side[lo:hi] != 1), lo + np.flatnonzero(self.side[lo:hi] != 0)
        n, percent, longs = self.n, self.percent, self.longs
        place, maps = np.zeros(hi - lo, dtype=np.int64), {}
        for size in np.unique(longs[lo:hi]).tolist():
            rows = np.flatnonzero(longs[lo:hi] == size)
            place[rows] = np.arange(len(rows))
            maps[size, size] = self.bits[self.at[lo + rows][:, None] + np.arange(size)]
        for i in left.tolist():
            ok = self.root[right] != self.root[i]
            ok &= 100 * np.minimum(n[i], n[right]) >= percent * np.maximum(n[i], n[right])
            rows = right[ok]
            if not len(rows):
                continue
            own, apart = maps[int(longs[i]), int(longs[i])][place[i - lo]], np.zeros(len(rows), dtype=np.int64)
            for size in np.unique(longs[rows]).tolist():
                least, these = min(size, int(longs[i])), longs[rows] == size
                if (size, least) not in maps:
                    maps[size, least] = _folded(maps[size, size], least)
                apart[these] = np.bitwise_count(maps[size, least][place[rows[these] - lo]] ^ _folded(own, least)).sum(axis=1, dtype=np.int64)
            rows = rows[apart * (100 + percent) <= (n[i] + n[rows]) * (100 - percent)]
            if len(rows):
                yield i, rows


def _compare(batches, percent: int):
    """members of blocks -> pairs that lie on two sides, in different components, and pass the bounds."""
    for batch in batches:
        blocks = _Blocks(batch, percent)
        xs, ys = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for lo, hi in blocks.spans:
            for i, rows in blocks.open(lo, hi):
                xs.append(np.full(len(rows), blocks.cls[i]))
                ys.append(blocks.cls[rows])
        x, y = np.concatenate(xs), np.concatenate(ys)
        pair = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)]), axis=1)
        yield pa.RecordBatch.from_arrays([pa.array(pair[0]), pa.array(pair[1])], names=["x", "y"])


def _circles(batches, percent: int):
    """members of blocks -> the circles of each: its classes that such pairs connect. A class is in one circle of a block at most."""
    for batch in batches:
        blocks, out = _Blocks(batch, percent), []
        for lo, hi in blocks.spans:
            label = np.arange(lo, hi)
            for i, rows in blocks.open(lo, hi):
                met = np.unique(label[np.append(rows, i) - lo])
                if len(met) > 1:
                    label[np.isin(label, met)] = met[0]
            order = np.argsort(label, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(label[order])) + 1):
                if len(part) > 1:
                    out.append(np.unique(blocks.cls[lo + part]))
        yield pa.RecordBatch.from_arrays([pa.array(out, pa.list_(pa.int64()))], names=["circle"])


def _link(batches, percent: int):
    """members of blocks with their sets -> links that connect its components: fewer than a block has rows, whatever links in it."""
    for batch in batches:
        blocks, a, b = _Blocks(batch, percent), [], []
        items, root = blocks.flat.field("items"), blocks.root
        at, value = items.offsets.to_numpy(), items.values.to_numpy().view(np.uint64)
        for lo, hi in blocks.spans:
            here = root[lo:hi]
            for i, rows in blocks.open(lo, hi):
                own, size = value[at[i]:at[i + 1]], at[rows + 1] - at[rows]
                other = np.concatenate([value[at[j]:at[j + 1]] for j in rows.tolist()])
                same = own[np.minimum(np.searchsorted(own, other), len(own) - 1)] == other
                both = np.add.reduceat(same, np.cumsum(size) - size, dtype=np.int64)
                for j in rows[100 * both >= percent * (len(own) + size - both)].tolist():
                    if root[j] != root[i]:
                        a.append(blocks.cls[i])
                        b.append(blocks.cls[j])
                        here[here == root[j]] = root[i]
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _order() -> Column:
    """What stands for a class: the smallest id, rows without an id last."""
    return F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "th")


def _tiles(docs: DataFrame, shelf: Shelf, rule: Rule) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(rows: doc_id, th, n, cls; classes: cls, rep, n, bits; shared: key, cls and the smallest class of every tile of several classes)."""
    full = shelf.put(signed(docs, rule), "signatures")
    rows = shelf.put(full.select("doc_id", "th", "n", "cls"), "rows")
    classes = shelf.put(full.where("n > 0").groupBy("cls").agg(F.min(_order()).alias("rep"), F.any_value("n").alias("n"),
                                                               F.any_value("bits").alias("bits")), "classes")
    keyed = full.where("n > 0").select("cls", F.explode("keys").alias("key")).repartition("key")
    ends = keyed.groupBy("key").agg(F.min("cls").alias("low"), F.max("cls").alias("high")).where("low < high").select("key", "low")
    shared = shelf.put(keyed.join(ends, "key").select("key", "cls", "low").distinct(), "tiles")
    shelf.drop(full)
    return rows, classes, shared


def _blocks(tiles: DataFrame, facts: DataFrame) -> DataFrame:
    """members of the blocks of tiles, with the facts of their classes. tiles: key, cls, root, parts that the tile is cut into."""
    dealt = (tiles.withColumn("own", F.pmod(F.xxhash64("cls"), F.col("parts")))
             .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
             .withColumn("side", F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1))
             .groupBy("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"))
             .agg(F.array_sort(F.collect_list(F.struct("cls", "side", "root"))).alias("members")))
    # near copies meet in many tiles with the same members; each such block is compared once
    blocks = dealt.groupBy("members").count().select(F.xxhash64("members").alias("block"), F.explode("members").alias("m")).select("block", "m.*")
    return (blocks.join(facts, "cls").groupBy("block")
            .agg(F.collect_list(F.struct("side", "cls", "root", *[c for c in facts.columns if c != "cls"])).alias("members")).select("members"))


def _open(placed: DataFrame, shelf: Shelf) -> DataFrame:
    """The tiles that hold several roots, for _blocks. placed: key, cls, root."""
    mixed = placed.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("m")).where("r0 < r1")
    return shelf.put(placed.join(mixed.select("key", F.ceil(F.col("m") / TILE).cast("long").alias("parts")), "key"), "open")


def _pooled(circles: DataFrame, classes: DataFrame, roots: DataFrame, mass: int, shelf: Shelf, tag: str) -> DataFrame:
    """Circles (key, low, cls) as tiles for _blocks, whose parts hold about mass shingles at most. roots: cls, root.

    A class is in many circles, so circles that share classes are compared as one pool where that moves fewer shingles.
    """
    pools = components(circles.select(F.col("cls").alias("a"), F.col("low").alias("b")).distinct(), shelf)
    named = circles.select("key", "cls").join(pools.toDF("cls", "pool"), "cls").join(classes.select("cls", "n"), "cls")
    ways = named.select("pool", F.lit(False).alias("whole"), "key", "cls", "n")
    ways = shelf.put(ways.union(named.select("pool", F.lit(True), F.col("pool"), "cls", "n")).distinct(), f"ways-{tag}")
    parts = (ways.groupBy("pool", "whole", "key").agg(F.count("*").alias("m"), F.sum("n").alias("n"))
             .withColumn("parts", F.ceil(F.greatest(F.col("m") / TILE, F.col("n") / mass)).cast("long")))
    moved = [F.sum(F.when(side, F.col("n") * F.col("parts"))) for side in (F.col("whole"), ~F.col("whole"))]
    better = parts.groupBy("pool").agg((moved[0] <= moved[1]).alias("whole"))
    tiles = ways.join(better, ["pool", "whole"]).join(parts.select("pool", "whole", "key", "parts"), ["pool", "whole", "key"])
    return tiles.join(roots, "cls").select("key", "cls", "root", "parts")


def _connected(placed: DataFrame, classes: DataFrame, docs: DataFrame, shelf: Shelf, rule: Rule) -> DataFrame:
    """Links (a, b) that connect all roots that links within tiles connect. placed: key, cls, root.

    The pairs of a group of near copies grow with its square and recur in many tiles, so none is a row: bitmaps only tell the circles
    of a block, and equal circles become one; wide bitmaps part these again; where the sets of a circle are compared, links that
    connect it are handed on.
    """
    def circles(tiles: DataFrame, facts: DataFrame, tag: str) -> DataFrame:
        found = _blocks(tiles, facts).mapInArrow(lambda b: _circles(b, rule.percent), "circle array<long>").groupBy("circle").count()
        return shelf.put(found.select(F.xxhash64("circle").alias("key"), F.col("circle")[0].alias("low"), F.explode("circle").alias("cls")), f"circles-{tag}")

    def fetched(met: DataFrame, make, columns: str, name: str) -> DataFrame:
        wanted = classes.join(met.select("cls").distinct(), "cls", "left_semi").select("cls", "rep")
        return _fetched(wanted, docs, make, columns, shelf, name, rule)
    open_rows = _open(placed, shelf)
    roots = open_rows.select("cls", "root").distinct()
    near = circles(open_rows, classes.select("cls", "n", "bits"), "near")
    wide = fetched(near, _wide, "n long, wide array<long>", "wide-circles")
    facts = wide.withColumnRenamed("wide", "bits")
    # a bitmap takes a sixteenth of its set or less
    nearer = circles(_pooled(near, classes, roots, 16 * MASS, shelf, "near"), facts, "nearer")
    sets = fetched(nearer, _sets, "items array<long>", "sets-circles")
    links = _blocks(_pooled(nearer, classes, roots, MASS, shelf, "nearer"), facts.join(sets, "cls")).mapInArrow(lambda b: _link(b, rule.percent), "a long, b long")
    out = shelf.put(links.distinct(), "links-circles")
    for used in (open_rows, near, wide, nearer, sets):
        shelf.drop(used)
    return out


def groups(docs: DataFrame, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    """(rows, classes): rows has doc_id, th, n, cls; classes has cls, component: the (doc_id, th) that stands for its component."""
    shelf = Shelf(docs.sparkSession, "jaccard")
    rows, classes, shared = _tiles(docs, shelf, rule)
    meets = shared.where("cls <> low").select(F.col("low").alias("x"), F.col("cls").alias("y")).distinct()
    # each class meets one class first: in a group of near copies that settles most, and the sets of a class travel once
    first = shelf.put(meets.groupBy("y").agg(F.min("x").alias("x")).select("x", "y"), "first")
    links = confirmed(first, classes, docs, shelf, "first", rule)
    roots = components(links, shelf)
    # then the smallest class of each of its tiles, where they are still apart
    sides = [roots.select(F.col("node").alias(c), F.col("root").alias(f"r{c}")) for c in "xy"]
    apart = meets.join(sides[0], "x", "left").join(sides[1], "y", "left").where(F.coalesce("rx", "x") != F.coalesce("ry", "y")).select("x", "y")
    stars = shelf.put(apart.join(first, ["x", "y"], "left_anti"), "star-pairs")
    links = shelf.put(links.union(confirmed(stars, classes, docs, shelf, "stars", rule)), "star-links")
    roots = components(links, shelf)
    # tiles that still hold several components
    placed = shared.join(roots, F.col("cls") == F.col("node"), "left").select("key", "cls", F.coalesce("root", "cls").alias("root"))
    more = _connected(placed, classes, docs, shelf, rule)
    roots = components(links.union(more), shelf)
    for used in (shared, first, stars, links, more):
        shelf.drop(used)
    final = classes.select("cls", "rep").join(roots, F.col("cls") == F.col("node"), "left").select("cls", "rep", F.coalesce("root", "cls").alias("root"))
    least = final.groupBy("root").agg(F.min("rep").alias("component"))      # the smallest id; rows without one come last
    return rows.select("doc_id", "th", "n", "cls"), final.join(least, "root").select("cls", "component")


def join(docs: DataFrame, rule: Rule = RULE) -> tuple[DataFrame, DataFrame]:
    """(pairs, members): all pairs (a, b) of classes that link, a < b; doc_id, n_shingles, cls and n_links of every row.

    A class is a distinct set of shingles. n_links counts the other rows that a row links with, those of its own class included;
    rows without shingles have no class and no links.
    """
    shelf = Shelf(docs.sparkSession, "jaccard-join")
    rows, classes, shared = _tiles(docs, shelf, rule)
    # every class is its own root, so that every tile is compared in full
    open_rows = _open(shared.select("key", "cls", F.col("cls").alias("root")), shelf)
    candidates = (_blocks(open_rows, classes.select("cls", "n", "bits"))
                  .mapInArrow(lambda b: _compare(b, rule.percent), "x long, y long").distinct())
    pairs = confirmed(candidates, classes, docs, shelf, "pairs", rule)
    for used in (shared, open_rows):
        shelf.drop(used)
    sizes = rows.where("n > 0").groupBy("cls").agg(F.count("*").alias("size"))
    beside = pairs.union(pairs.select("b", "a")).toDF("cls", "other").join(sizes.toDF("other", "more"), "other").groupBy("cls").agg(F.sum("more").alias("beside"))
    counts = sizes.join(beside, "cls", "left").select("cls", (F.col("size") - 1 + F.coalesce("beside", F.lit(0))).alias("n_links"))
    return pairs, rows.join(counts, "cls", "left").select("doc_id", F.col("n").alias("n_shingles"), "cls", F.coalesce("n_links", F.lit(0)).alias("n_links"))


def linked(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    rows, classes = groups(docs, rule)
    return rows.join(classes, "cls", "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("component.doc_id", "doc_id").alias("component_id"))


def keep_one(docs: DataFrame, rule: Rule = RULE) -> DataFrame:
    """One row of each component, all columns of docs; rows without shingles all stay."""
    rows, classes = groups(docs, rule)
    # names that no input column can have by accident
    keep = classes.select("component").distinct().select(F.col("component.doc_id").alias("__id"), F.col("component.th").alias("__th"))
    empty = rows.where("n = 0").select(F.col("doc_id").alias("__id"), F.col("th").alias("__th"), F.lit(True).alias("__all")).distinct()
    chosen = keep.withColumn("__all", F.lit(False)).union(empty)
    th = F.xxhash64(docs["text"])
    out = docs.join(chosen, docs["doc_id"].eqNullSafe(chosen["__id"]) & (th == chosen["__th"]))
    # repeated rows of a kept document are copies of it
    first = F.when(F.col("__all"), F.monotonically_increasing_id()).otherwise(F.lit(-1))
    return out.withColumn("__one", first).dropDuplicates(["__id", "__th", "__one"]).select(*[docs[c] for c in docs.columns])


@query("op6_ngram_jaccard")
def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents"))
