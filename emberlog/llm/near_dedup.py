"""Near-duplicate groups by banded MinHash with sequential Bayesian verification.

Texts with equal shingle sets form one class, and only classes are compared. Bands of a MinHash
signature propose pairs; the signatures of a pair are compared batch by batch and the pair is dropped
once the posterior chance that its similarity reaches the threshold is under ``miss``; the pairs left
are confirmed on their full shingle sets.

A class is named by the least row number in it, a long, so that groups are aggregated in hash tables.
A bucket of n classes never gives all its pairs. First each member meets the bucket's smallest one, its
hub. Then the members of a hub are compared in blocks inside tasks, and only those that are still in
different components, since links inside a component change nothing. A task gives out the pairs that
pass the signature batches and one more, wider sketch; for texts of up to ``WIDE`` shingles this is the
whole set, so what is given out grows with the links. No link between components is lost.

Joins on a name, bucket, hub or root, which a third of all rows may share, divide such keys.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from emberlog.llm._store import frequent, free_name, marked_in, scratch, slices, spread_join, type_of, written
from emberlog.llm._words import Shingles, mixed

#: Bands and rows: a pair at similarity 0.8 shares no band with a chance of 8.5e-7.
BANDS, ROWS = 46, 6
HASHES = BANDS * ROWS
#: Hashes in the wider sketch, bytes of the members in one block of a hub, and members in a block of a hub of up to 8 blocks.
WIDE, BLOCK_BYTES, BLOCK_MEMBERS = 1024, 12 << 20, 256
_RNG = np.random.default_rng(77)
_A = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32) | np.uint32(1)
_B = _RNG.integers(0, 2**32, HASHES, dtype=np.uint32)
_FOLD = _RNG.integers(1, 2**63, ROWS, dtype=np.uint64) | np.uint64(1)
_BAND = _RNG.integers(1, 2**63, BANDS, dtype=np.uint64)


def signature(s: np.ndarray) -> np.ndarray:
    """The least value of each of ``HASHES`` hash functions over a shingle set, a block at a time."""
    x, out = (s >> np.uint64(32)).astype(np.uint32), np.full(HASHES, 0xFFFFFFFF, np.uint32)
    for k in range(0, len(x), 512):
        block = x[k : k + 512, None] * _A
        block += _B
        np.minimum(out, block.min(axis=0), out=out)
    return out


def band_keys(sig: np.ndarray) -> np.ndarray:
    return mixed((sig.reshape(BANDS, ROWS).astype(np.uint64) * _FOLD).sum(axis=1, dtype=np.uint64) + _BAND).view(np.int64)


def set_name(s: np.ndarray) -> bytes:
    """A 128-bit name of a shingle set; equal sets have equal names."""
    return xxhash.xxh3_128_digest(s.tobytes())


def described(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in slices(batches, "text"):
            counts, names, sketches, bands = [], [], [], []
            for text in batch.column("text").to_pylist():
                s = shingles.of(text)
                counts.append(len(s))
                sig = signature(s) if len(s) else None
                names.append(set_name(s) if len(s) else None)
                sketches.append((sig & np.uint32(255)).astype(np.uint8).tobytes() if len(s) else None)
                bands.append(band_keys(sig) if len(s) else None)
            columns = [batch.column("doc_id"), batch.column("text_key"), pa.array(counts, pa.int64()), pa.array(names, pa.binary()), pa.array(sketches, pa.binary()), pa.array(bands, pa.list_(pa.int64()))]
            yield pa.record_batch(columns, ["doc_id", "text_key", "n_shingles", "name", "sketch", "bands"])

    return run


def wide_sketches(width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """class_id, sketch and the least ``WIDE`` values, cut to 32 bits, of the shingle sets of texts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for batch in slices(batches, "text"):
            wide = [np.unique((shingles.of(t) >> np.uint64(32)).astype(np.uint32))[:WIDE].tobytes() for t in batch.column("text").to_pylist()]
            yield pa.record_batch([batch.column("class_id"), batch.column("sketch"), pa.array(wide, pa.binary())], ["class_id", "sketch", "wide"])

    return run


@lru_cache(maxsize=8)
def least_matches(threshold: float, miss: float, step: int = 32) -> list[tuple[int, int]]:
    """(hashes compared, matches needed to go on) after each batch.

    With a flat prior, the posterior of similarity s after m matches of n is in proportion to
    p^m (1-p)^(n-m), p = s + (1-s)/256 being the chance that two bytes agree. A pair goes on while the
    posterior weight at or above the threshold is ``miss`` or more.
    """
    s = (np.arange(20_000) + 0.5) / 20_000
    p = s + (1 - s) / 256
    out = []
    for n in [*range(step, HASHES, step), HASHES]:
        m = np.arange(n + 1)[:, None]
        log = m * np.log(p) + (n - m) * np.log1p(-p)
        weight = np.exp(log - log.max(axis=1, keepdims=True))
        chance = weight[:, s >= threshold].sum(axis=1) / weight.sum(axis=1)
        out.append((n, int(np.argmax(chance >= miss))))
    return out


@lru_cache(maxsize=4 * WIDE)
def least_common(n: int, threshold: float, miss: float) -> int:
    """The least of ``n`` sampled shingles that two sets must share for the same posterior bound."""
    s = (np.arange(4_000) + 0.5) / 4_000
    low, high = 0, n
    while low < high:
        m = (low + high) // 2
        log = m * np.log(s) + (n - m) * np.log1p(-s)
        weight = np.exp(log - log.max())
        low, high = (low, m) if weight[s >= threshold].sum() >= miss * weight.sum() else (m + 1, high)
    return low


def may_link(x: np.ndarray, y: np.ndarray, n_x: int, n_y: int, threshold: float, miss: float) -> bool:
    """Whether two wide sketches, of sets of ``n_x`` and ``n_y`` shingles, leave the threshold possible.

    Sketches below ``WIDE`` values are whole sets, and then the bound is exact but for equal 32-bit values,
    which it counts as common. Else the values up to the end of the shorter range are a sample of the union.
    """
    whole = len(x) < WIDE and len(y) < WIDE
    if not whole:
        end = min(v[-1] for v in (x, y) if len(v) == WIDE)
        x, y = x[: np.searchsorted(x, end, "right")], y[: np.searchsorted(y, end, "right")]
    common = len(np.intersect1d(x, y, assume_unique=True))
    if whole:
        common += n_x - len(x)
        return 100 * common >= round(100 * threshold) * (n_x + n_y - common)
    n = len(x) + len(y) - common
    return common >= least_common(n, threshold, miss)


def runs_of(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each key as one table, of batches sorted by the keys."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        names = list(zip(*(batch.column(k).to_pylist() for k in keys), strict=True))
        cuts = [0, *(i for i in range(1, len(names)) if names[i] != names[i - 1]), len(names)]
        for i, j in zip(cuts, cuts[1:], strict=False):
            if i == j:
                continue
            if held and names[i] != last:
                yield pa.Table.from_batches(held)
                held = []
            held.append(batch.slice(i, j - i))
            last = names[i]
    if held:
        yield pa.Table.from_batches(held)


def block_pairs(threshold: float, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs (a, b) of different components that may be links, of two blocks ``x`` and ``y`` of a hub.

    A key holds two blocks at most, so that memory is bounded however many members a hub has.
    """
    percent = round(100 * threshold)

    def compared(rows: pa.Table) -> Iterator[tuple[int, int]]:
        name, part, n, block = (rows.column(c).to_numpy() for c in ("class_id", "part", "n_shingles", "block"))
        wide = rows.column("wide").combine_chunks()
        sketch = np.frombuffer(b"".join(rows.column("sketch").to_pylist()), np.uint8).reshape(-1, HASHES)
        x, y = rows.column("x")[0].as_py(), rows.column("y")[0].as_py()
        left, right = np.flatnonzero(block == x), np.flatnonzero(block == y)
        needed = least_matches(threshold, miss)
        for k in range(0, len(left), 16):
            some = left[k : k + 16]
            i, j = np.repeat(some, len(right)), np.tile(right, len(some))
            alive = (part[i] != part[j]) & (100 * np.minimum(n[i], n[j]) >= percent * np.maximum(n[i], n[j]))
            if x == y:
                alive &= i < j
            i, j = i[alive], j[alive]
            matches, before = np.zeros(len(i), np.int64), 0
            for upto, least in needed:
                matches += (sketch[i, before:upto] == sketch[j, before:upto]).sum(axis=1)
                alive, before = matches >= least, upto
                i, j, matches = i[alive], j[alive], matches[alive]
            for p, q in zip(i.tolist(), j.tolist(), strict=True):
                if may_link(np.frombuffer(wide[p].as_buffer(), np.uint32), np.frombuffer(wide[q].as_buffer(), np.uint32), int(n[p]), int(n[q]), threshold, miss):
                    yield min(name[p], name[q]), max(name[p], name[q])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in runs_of(batches, ["hub", "x", "y"]):
            found = list(compared(rows))
            if found:
                yield pa.record_batch([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    return run


def surviving(threshold: float, miss: float) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose signatures leave the threshold possible."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        needed = least_matches(threshold, miss)
        for batch in batches:
            left, right = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.uint8).reshape(-1, HASHES) for c in ("sketch_a", "sketch_b"))
            alive, matches, before = np.arange(len(left)), np.zeros(len(left), np.int64), 0
            for n, least in needed:
                matches[alive] += (left[alive, before:n] == right[alive, before:n]).sum(axis=1)
                alive, before = alive[matches[alive] >= least], n
            yield batch.select(["a", "b"]).take(pa.array(alive))

    return run


def confirmed(threshold: float, width: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Pairs whose full sets have the similarity: 100 * common >= 100 * threshold * union.

    The text of a hub (``is_hub``) comes before those of its partners; its set is all that is held.
    """
    percent = round(100 * threshold)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, own = Shingles(width), np.empty(0, np.uint64)
        for batch in slices(batches, "text"):
            links = []
            for a, b, is_hub, text in zip(*(batch.column(c).to_pylist() for c in ("hub", "class_id", "is_hub", "text")), strict=True):
                s = shingles.of(text)
                if is_hub:
                    own = s
                    continue
                common = len(np.intersect1d(own, s, assume_unique=True))
                if 100 * common >= percent * (len(own) + len(s) - common):
                    links.append((a, b))
            yield pa.record_batch([pa.array([p[k] for p in links], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def text_key(text: str) -> Column:
    """A 256-bit name of a text: with the id it tells rows apart, also without or with repeated ids."""
    return F.unhex(F.sha2(F.col(text), 256))


def of_rows(texts: DataFrame, rows: DataFrame, doc_id: str, how: str, key: str = "text_key") -> DataFrame:
    """``texts`` joined to the (doc_id, text_key) of ``rows``; a null id is an id.

    Only texts that ``rows`` may name are shuffled.
    """
    row_id, row_key, maybe = free_name(texts, "_row_id"), free_name(texts, "_row_key"), free_name(texts, "_maybe")
    rows = rows.withColumnsRenamed({"doc_id": row_id, "text_key": row_key})
    marked = marked_in(texts, [F.col(doc_id), F.col(key)], rows, [F.col(row_id), F.col(row_key)], maybe)
    some = marked.where(maybe).drop(maybe)
    out = some.join(rows, some[doc_id].eqNullSafe(rows[row_id]) & some[key].eqNullSafe(rows[row_key]), how)
    if how == "left_anti":
        return marked.where(~F.col(maybe)).drop(maybe).unionByName(out)
    return out if how == "left_semi" else out.drop(row_id, row_key)


def rows_left(texts: DataFrame, gone: DataFrame, named: DataFrame, doc_id: str, key: str) -> DataFrame:
    """``texts`` without the rows whose (doc_id, text_key) are in ``gone``; ``named`` has the doc_id and text_key of all of its rows.

    The names that stay though the bitmap of ``gone`` has their slot are found first, without texts. A row in such
    a slot only is looked up by a join; any other one in a slot of ``gone`` goes in place, and is not shuffled.
    """
    names = [F.col("doc_id"), F.col("text_key")]
    same = named["doc_id"].eqNullSafe(gone["doc_id"]) & (named["text_key"] == gone["text_key"])
    some = marked_in(named, names, gone, names, "maybe").where("maybe").drop("maybe")
    clashes = written(some.join(gone, same, "left_anti").select(*names).distinct(), "clashing_rows")
    maybe, clash = free_name(texts, "_maybe"), free_name(texts, "_clash")
    marked = marked_in(marked_in(texts, [F.col(doc_id), F.col(key)], gone, names, maybe), [F.col(doc_id), F.col(key)], clashes, names, clash)
    some = marked.where(F.col(maybe) & F.col(clash)).drop(maybe, clash)
    return marked.where(~F.col(maybe)).drop(maybe, clash).unionByName(of_rows(some, gone, doc_id, "left_anti", key))


class Job:
    """The tables and parameters that the steps of one run share.

    classes: class_id, doc_id, text_key, n_shingles, sketch, bands of a row for each class; texts: doc_id, text, text_key.
    """

    def __init__(self, classes: DataFrame, texts: DataFrame, width: int, threshold: float, miss: float, keep: Callable[..., DataFrame]):
        self.classes, self.texts, self.width, self.threshold, self.miss, self.keep = classes, texts, width, threshold, miss, keep

    def maybe_in(self, ids: DataFrame) -> DataFrame:
        """The rows of ``classes`` that the class_id of ``ids`` may name; the others, with their sketches, are not shuffled."""
        return marked_in(self.classes, [F.col("class_id")], ids, [F.col("class_id")], "maybe").where("maybe").drop("maybe")

    def with_texts(self, wanted: DataFrame, *columns: str) -> DataFrame:
        """``wanted``, rows with a class_id, with the text of the class and with ``columns`` of ``classes``.

        A text is shuffled once for each task that reads it, however many rows have it or want it.
        """
        rows = self.maybe_in(wanted).select("class_id", "doc_id", "text_key", *columns).join(wanted, "class_id")
        rows = self.keep(rows, "wanted_texts")
        some = marked_in(self.texts, [F.col("doc_id"), F.col("text_key")], rows, [F.col("doc_id"), F.col("text_key")], "maybe")
        texts = some.where("maybe").select("text_key", "text").dropDuplicates(["text_key"])  # texts with one key are equal
        return rows.drop("doc_id").join(texts, "text_key").drop("text_key")

    def verified(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) that are links, signatures first. Many pairs can share an ``a``, few a ``b``."""
        named = lambda c: self.maybe_in(pairs.select(F.col(c).alias("class_id")))
        side = lambda c: named(c).select(F.col("class_id").alias(c), F.col("n_shingles").alias(f"n_{c}"), F.col("sketch").alias(f"sketch_{c}"))
        both = spread_join(pairs, side("a").join(pairs.select("a").distinct(), "a", "left_semi"), "a", "b").join(side("b"), "b")
        both = both.where(F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * round(100 * self.threshold))
        rows = both.select("a", "b", "sketch_a", "sketch_b").mapInArrow(surviving(self.threshold, self.miss), "a long, b long")
        return self.exact(self.keep(rows, "surviving_pairs"))

    def exact(self, pairs: DataFrame) -> DataFrame:
        """The ``pairs`` (a, b) that are links on their full sets; ``pairs`` should be a written table.

        Texts are dealt to their pairs, since sets take more bytes: that of ``a`` once for a part of its pairs, that of ``b`` once for each pair.
        """
        parts = F.coalesce("_parts", F.lit(1))
        dealt = pairs.join(frequent(pairs, "a"), "a", "left").select("a", "b", F.pmod(F.xxhash64("b"), parts).cast("int").alias("part"))
        own = dealt.select(F.col("a").alias("hub"), "part", F.lit(True).alias("is_hub"), F.col("a").alias("class_id")).distinct()
        other = dealt.select(F.col("a").alias("hub"), "part", F.lit(False).alias("is_hub"), F.col("b").alias("class_id"))
        both = self.with_texts(self.keep(own.unionByName(other), "sides")).select("hub", "part", "is_hub", "class_id", "text")
        both = both.repartition("hub", "part").sortWithinPartitions("hub", "part", F.desc("is_hub"))
        return both.mapInArrow(confirmed(self.threshold, self.width), "a long, b long")

    def cross_pairs(self, star: DataFrame, labels: DataFrame) -> DataFrame:
        """Pairs of the members of each hub of ``star`` (a hub, b member) that are in different components and may be links.

        The blocks of a hub are as many as its bytes ask for, and each pair of blocks is one key.
        """
        keep = self.keep
        part = F.coalesce("root", "b").alias("part")
        members = star.join(labels.withColumnRenamed("node", "b"), "b", "left").select(F.col("a").alias("hub"), F.col("b").alias("class_id"), part)
        members = keep(members.join(self.classes.select("class_id", "n_shingles"), "class_id"), "members")
        size = HASHES + 64 + 4 * F.least("n_shingles", F.lit(WIDE))
        hubs = members.groupBy("hub").agg(F.count("*").alias("n"), F.sum(size).alias("bytes"), F.min("part").alias("first"), F.max("part").alias("last")).where("first <> last")
        # as few blocks as memory allows, but some, so that a hub is not one task
        blocks = F.greatest(F.ceil(F.col("bytes") / BLOCK_BYTES), F.least(F.ceil(F.col("n") / BLOCK_MEMBERS), F.lit(8)))
        hubs = hubs.select("hub", blocks.cast("int").alias("blocks"))
        members = spread_join(members, hubs, "hub", "class_id").withColumn("block", F.pmod(F.hash("class_id"), "blocks"))
        members = keep(members, "hub_members")
        wide = self.with_texts(members.select("class_id").distinct(), "sketch").select("class_id", "sketch", "text")
        wide = keep(wide.mapInArrow(wide_sketches(self.width), "class_id long, sketch binary, wide binary"), "wide_sketches")
        other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other")
        members = members.join(wide, "class_id").select("hub", "class_id", "part", "n_shingles", "sketch", "wide", "block", other)
        members = members.select("*", F.least("block", "other").alias("x"), F.greatest("block", "other").alias("y")).drop("other")
        pairs = members.repartition("hub", "x", "y").sortWithinPartitions("hub", "x", "y").mapInArrow(block_pairs(self.threshold, self.miss), "a long, b long")
        return keep(pairs.distinct().join(star, ["a", "b"], "left_anti"), "cross_pairs")


def components(links: DataFrame, keep: Callable[..., DataFrame]) -> DataFrame:
    """node, root for each node of ``links`` (a, b): the least node that it can reach.

    Each round hooks every node to its least neighbour, follows the hooks to their ends by doubling,
    and goes on with the links between those ends. A round at least halves the nodes.
    """
    edges = keep(links.select("a", "b").where("a <> b"), "edges")
    labels = keep(edges.select(F.explode(F.array("a", "b")).alias("node")).distinct().withColumn("root", F.col("node")), "labels")
    while not edges.isEmpty():
        both = edges.union(edges.select("b", "a"))
        up = keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("to")).select("node", F.least("node", "to").alias("to")), "hooks")
        while True:
            over = up.select(F.col("node").alias("to"), F.col("to").alias("next"))
            moved = spread_join(up, over, "to", "node").select("node", F.col("next").alias("to"), (F.col("to") != F.col("next")).alias("moved"))
            up = keep(moved, "hooks")
            if up.where("moved").isEmpty():
                break
            up = up.drop("moved")
        step = up.select(F.col("node").alias("root"), F.col("to"))
        labels = keep(spread_join(labels, step, "root", "node", "left").select("node", F.coalesce("to", "root").alias("root")), "labels")
        end = lambda c: up.select(F.col("node").alias(c), F.col("to").alias(f"end_{c}"))
        moved = spread_join(edges, end("a"), "a", "b").join(end("b"), "b").where("end_a <> end_b")
        edges = keep(moved.select(F.col("end_a").alias("a"), F.col("end_b").alias("b")).distinct(), "edges")
    return labels


def grouped(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """row, doc_id, text_key, n_shingles, root, component_id for each row of ``docs``, as a written table.

    ``root`` names the component and is null for rows without shingles; ``component_id`` is the least
    doc_id in it, null only if all of its rows have none, and the own doc_id without shingles.
    """
    with scratch(docs.sparkSession) as keep:
        texts = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"), text_key(text).alias("text_key"))
        schema = f"doc_id {type_of(docs, doc_id)}, text_key binary, n_shingles long, name binary, sketch binary, bands array<long>"
        rows = keep(texts.mapInArrow(described(width), schema).withColumn("row", F.monotonically_increasing_id()), "described")
        # the least row of a class gives it its number, and stands for it whether it has an id or not
        names = rows.where("name is not null").groupBy("name").agg(F.min("row").alias("class_id"), F.min("doc_id").alias("least_id"))
        names = keep(names, "classes")
        labelled = keep(spread_join(rows.select("row", "doc_id", "text_key", "n_shingles", "name"), names, "name", "row", "left").drop("name"), "labelled")
        # the rows that stand for no class are few beside the others, whose sketches and bands need no shuffle
        copies = keep(labelled.where("row <> class_id").select("row"), "copies")
        marked = marked_in(rows.where("name is not null").drop("name"), [F.col("row")], copies, [F.col("row")], "maybe")
        alone = marked.where(~F.col("maybe")).unionByName(marked.where("maybe").join(copies, "row", "left_anti")).drop("maybe")
        job = Job(keep(alone.withColumnRenamed("row", "class_id"), "class_rows"), texts, width, threshold, miss, keep)

        buckets = keep(job.classes.select("class_id", F.explode("bands").alias("key")), "buckets")
        shared = buckets.groupBy("key").agg(F.min("class_id").alias("hub"), F.max("class_id").alias("last")).where("hub <> last").select("key", "hub")
        shared = keep(shared, "shared_keys")
        # most keys have one class: their rows are told apart in place, and are not shuffled again
        met = keep(marked_in(buckets, [F.col("key")], shared, [F.col("key")], "maybe").where("maybe").drop("maybe"), "shared_buckets")
        star = spread_join(met, shared, "key", "class_id").where("hub <> class_id").select(F.col("hub").alias("a"), F.col("class_id").alias("b"))
        star = keep(star.distinct(), "star_pairs")
        links = keep(job.verified(star), "star_links")
        labels = components(links, keep)
        pairs = job.cross_pairs(star, labels)
        if not pairs.isEmpty():
            more = keep(job.exact(pairs), "cross_links")
            if not more.isEmpty():
                labels = components(links.unionByName(more), keep)

        # classes without a link are their own components
        linked = keep(names.select("class_id", "least_id").join(labels.withColumnRenamed("node", "class_id"), "class_id"), "linked_classes")
        least = linked.groupBy("root").agg(F.min("least_id").alias("component_id"))
        linked = keep(spread_join(linked, least, "root", "class_id").select("class_id", "root", "component_id"), "components")
        out = spread_join(labelled, linked, "class_id", "row", "left")
        component = F.when(F.col("class_id").isNull(), F.col("doc_id")).when(F.col("root").isNull(), F.col("least_id")).otherwise(F.col("component_id"))
        return written(out.select("row", "doc_id", "text_key", "n_shingles", F.coalesce("root", "class_id").alias("root"), component.alias("component_id")), "near_duplicates")


def near_duplicates(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8, miss: float = 1e-6) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of ``docs``.

    Words are split at ASCII white space with A-Z lower-cased; a text with fewer than ``width`` words
    is one shingle. Null and empty texts have none and are linked with nothing. ``component_id`` is the
    least doc_id of the component, and ``kept`` marks the rows that have it. Rows with null ids link
    like all others; a component's id is null only if all of its rows have none, and then ``kept`` marks
    all of them, while ``keep_one`` gives one. Repeated rows each give a row. Other columns of ``docs``
    are not read.
    """
    out = grouped(docs, doc_id, text, width, threshold, miss).select("doc_id", "n_shingles", "component_id")
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def keep_one(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, with their columns, of one document for each component; repeated rows of it once.

    A document is an id with a text, so that null and repeated ids are no exception: of the rows with
    the component's id one is chosen, and rows equal to it in id and text are repeats. Texts without
    shingles are linked with nothing and stay, repeated rows of one id once. An empty table gives an
    empty one. Columns of ``docs`` may have any names. Only texts of rows that stay and may be taken for one that goes are shuffled.
    """
    marked = grouped(docs, doc_id, text, width, threshold)
    own = marked.where(F.col("root").isNotNull() & F.col("doc_id").eqNullSafe(F.col("component_id")))
    chosen = own.groupBy("root").agg(F.min("row").alias("row"))
    firsts = written(marked.join(chosen.select("row"), "row", "left_semi").select("root", F.col("doc_id").alias("first_id"), F.col("text_key").alias("first_key")), "chosen_rows")
    both = spread_join(marked.where("root is not null"), firsts, "root", "row")
    is_first = F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("text_key") == F.col("first_key"))
    gone = written(both.where(~is_first).select("doc_id", "text_key").distinct(), "dropped_rows")
    key = free_name(docs, "_text_key")
    kept = rows_left(docs.withColumn(key, text_key(text)), gone, marked.select("doc_id", "text_key"), doc_id, key)
    left = of_rows(marked.where(F.col("root").isNotNull() | F.col("doc_id").isNotNull()), gone, "doc_id", "left_anti")
    again = written(left.groupBy("doc_id", "text_key").agg(F.count("*").alias("n")).where("n > 1").select("doc_id", "text_key"), "repeated_rows")
    if again.isEmpty():
        return kept.drop(key)
    once = of_rows(kept, again, doc_id, "left_anti", key)
    return once.unionByName(of_rows(kept, again, doc_id, "left_semi", key).dropDuplicates([doc_id, key])).drop(key)
