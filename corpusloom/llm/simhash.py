"""SimHash near-duplicates with BK-trees.

A BK-tree keeps each child under its integer Hamming distance to the parent; a search
follows only the edges within the radius. Trees are built per shard and reach the tasks by
the shuffle that deals out the shards, because fingerprints grow with the corpus and so
have no size bound that a driver-side broadcast could rely on. This departure from
broadcast trees is meant to stay: a broadcast would hold at small sizes alone, with the
same links, and would need the shuffle beside it.

* ``linked_fingerprints``: radius 2 or so. Two fingerprints within the radius agree on one
  of radius + 1 blocks of bits, so a shard is one value of one block; shards that are too
  full are cut again by the remaining bits, which loses no pair.
* ``near_duplicates``: word shingles and a Jaccard bound. Texts at that bound differ in up
  to a dozen bits, where blocks no longer select anything; there a shard is one band of
  smallest shingle hashes, the tree finds the leaders within a wide radius, and their
  shingle sets are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ROW, SPACED_WORD, bare, forget, packed, staged
from .components import connected_components

SEED = 42
BITS = 64
#: Fingerprints of a shard above which it is cut by further bits; after the last cut a shard has 2**19 values at most.
SHARD_ROWS = 20_000
MAX_CUTS = 2
#: Bands and hashes of a band in near_duplicates: a pair at Jaccard 0.8 meets with probability 1 - (1 - 0.8**3)**10 = 0.9992.
BANDS, BAND_HASHES = 10, 3
#: Hamming radius of near_duplicates: pairs at Jaccard 0.8 are 10 bits apart on average, 3 standard deviations above are 18.
WIDE_RADIUS = 18
#: Shards of at most so many texts are compared pair by pair at once.
PAIRS_UP_TO = 32
#: Smallest shingle hashes kept of a text. At Jaccard 0.8 a pair agrees on 48 of 60 on average; with fewer than
#: SKETCH_AGREE it is not compared further (4 standard deviations below).
SKETCH, SKETCH_AGREE = 60, 36
#: Texts of a block when classes of a full shard are compared with each other.
BLOCK_ROWS = 2_000
#: Smallest shingle hashes kept of a text in that comparison: all of a short text, and an estimate within 0.025 for others.
FINE = 256
CHUNK = 1 << 16
#: Digests and numbers of texts (40 bytes each) that are broadcast; more are joined by shuffle.
BROADCAST_TEXTS = 200_000


def shingle_hashes(text: str | None, shingle: int) -> np.ndarray:
    """XXH64 (seed 42) of the word shingles, repeats included; fewer words are one shingle, none gives none.

    bytes.lower() and bytes.split() know ASCII only: A-Z, and the white space \\x20 \\x09-\\x0D.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    digest = xxhash.xxh64_intdigest
    if len(words) < shingle:
        return np.array([digest(b" ".join(words), SEED)], np.uint64)
    grams = zip(*[words[i:] for i in range(shingle)], strict=False)
    return np.fromiter((digest(b" ".join(g), SEED) for g in grams), np.uint64, len(words) - shingle + 1)


def fingerprint(hashes: np.ndarray) -> int:
    """Bit i is 1 if it is set in over half of the hashes; no hashes give 0. As a signed 64-bit number."""
    counts = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), CHUNK):
        part = np.ascontiguousarray(hashes[at : at + CHUNK])
        counts += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(hashes), bitorder="little").view(np.int64)[0])


def fingerprints(text: Column, shingle: int = 3) -> Column:
    """The SimHash of a text column as a bigint."""

    @F.pandas_udf("bigint")
    def simhash(texts: pd.Series) -> pd.Series:
        return pd.Series([fingerprint(shingle_hashes(t, shingle)) for t in texts], dtype="int64")

    return simhash(text)


def hex_fingerprint(value: Column) -> Column:
    return F.lower(F.lpad(F.hex(value), 16, "0"))


class BKTree:
    """Distinct integers under Hamming distance."""

    __slots__ = ("children", "values")

    def __init__(self) -> None:
        self.values: list[int] = []
        self.children: list[dict[int, int]] = []

    def within(self, value: int, radius: int) -> list[tuple[int, int]]:
        """(distance, member) of every member within the radius."""
        found, open_nodes = [], [0] if self.values else []
        while open_nodes:
            node = open_nodes.pop()
            d = (self.values[node] ^ value).bit_count()
            if d <= radius:
                found.append((d, self.values[node]))
            low, high = d - radius, d + radius
            open_nodes += [child for edge, child in self.children[node].items() if low <= edge <= high]
        return found

    def add(self, value: int) -> None:
        self.values.append(value)
        self.children.append({})
        node, new = 0, len(self.values) - 1
        while new:
            d = (self.values[node] ^ value).bit_count()
            if not d:
                self.values.pop()
                self.children.pop()
                return
            child = self.children[node].setdefault(d, new)
            if child == new:
                return
            node = child


def _cut(mask: int, parts: int) -> list[int]:
    """Masks that add to ``mask`` one of ``parts`` blocks of the remaining bits each."""
    rest = [i for i in range(BITS) if not mask >> i & 1]
    ends = [len(rest) * k // parts for k in range(parts + 1)]
    return [mask | sum(1 << i for i in rest[a:b]) for a, b in zip(ends, ends[1:], strict=False)]


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _shard_rows(fps: DataFrame, masks: Column) -> DataFrame:
    return fps.select("fp", F.explode(masks).alias("mask")).withColumn("part", F.col("fp").bitwiseAND(F.col("mask")))


def linked_fingerprints(fps: DataFrame, radius: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Links (a, b) between distinct values of ``fp`` within the radius that connect all that such links connect.

    A shard's links are thinned to a spanning forest where they are found, so there are
    fewer of them than fingerprints in the shard.
    """
    parts = radius + 1
    masks = _cut(0, parts)
    rows, ready = _shard_rows(fps.select("fp").distinct(), F.array(*[F.lit(_signed(m)) for m in masks])), []
    for _ in range(MAX_CUTS):
        rows = staged(rows, "simhash-shards")
        full = staged(rows.groupBy("mask", "part").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > shard_rows).select("mask", "part"), "simhash-full")
        n_full = full.count()
        if not n_full:
            break
        hint = F.broadcast(full) if n_full <= 100_000 else full
        ready.append(rows.join(hint, ["mask", "part"], "left_anti"))
        finer = {m: _cut(m, parts) for m in masks}
        masks = [x for cut in finer.values() for x in cut]
        table = F.create_map(*[x for m, cut in finer.items() for x in (F.lit(_signed(m)), F.array(*[F.lit(_signed(c)) for c in cut]))])
        rows = _shard_rows(rows.join(hint, ["mask", "part"], "left_semi"), F.element_at(table, F.col("mask")))
    for more in ready:
        rows = rows.unionByName(more)

    def link(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        shard, tree, roots = None, BKTree(), {}

        def root(x: int) -> int:
            while roots[x] != x:
                roots[x] = x = roots[roots[x]]
            return x

        for batch in batches:
            links = []
            for mask, part, fp in zip(batch["mask"].tolist(), batch["part"].tolist(), batch["fp"].tolist(), strict=True):
                if shard != (mask, part):
                    shard, tree, roots = (mask, part), BKTree(), {}
                value = fp & (1 << 64) - 1
                roots[value] = value
                for _, other in tree.within(value, radius):
                    a, b = root(value), root(other)
                    if a != b:
                        roots[a] = b
                        links.append((fp, _signed(other)))
                tree.add(value)
            yield pd.DataFrame(links, columns=["a", "b"], dtype="int64")

    dealt = rows.repartition("mask", "part").sortWithinPartitions("mask", "part")
    return dealt.mapInPandas(link, "a bigint, b bigint")


def simhash_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 3, radius: int = 2) -> DataFrame:
    """(id, fingerprint, component_id) for every row; component_id is the smallest id reachable over links.

    Null texts are empty and have fingerprint 0, which links like any other. A null id is
    never a component_id unless a component has no other.
    """
    marked = staged(docs.select(bare(id_col).alias("id"), fingerprints(bare(text_col), shingle).alias("fp")), "simhash-marked")
    fps = staged(marked.groupBy("fp").agg(F.min("id").alias("least")), "simhash-values")
    roots = connected_components(linked_fingerprints(fps, radius))
    rooted = fps.join(roots, fps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id")
    return marked.join(named, "fp").select(F.col("id").alias(id_col), hex_fingerprint(F.col("fp")).alias("fingerprint"), "component_id")


def _least(hashes: np.ndarray, odd: np.ndarray, add: np.ndarray) -> np.ndarray:
    """The smallest value of the hashes under each of the functions (odd, add), by blocks that stay in the cache."""
    least = np.full(len(odd), np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(hashes), 512):
        values = hashes[at : at + 512, None] * odd
        values += add
        # Multiply-shift mixes the low bits up; the hashes are well mixed already.
        values ^= values >> np.uint64(29)
        np.minimum(least, values.min(0), out=least)
    return least


def _signatures(shingle: int, bands: int, rows: int):
    odd = np.array([xxhash.xxh64_intdigest(b"factor%d" % i, SEED) | 1 for i in range(SKETCH)], np.uint64)
    add = np.array([xxhash.xxh64_intdigest(b"summand%d" % i, SEED) for i in range(SKETCH)], np.uint64)

    @F.pandas_udf("fp bigint, bands array<bigint>, sketch binary")
    def signature(texts: pd.Series) -> pd.DataFrame:
        fps, keys, sketches = [], [], []
        for text in texts:
            # Without repeats, as in the sets whose similarity decides: else texts that differ in repeats alone are far apart.
            hashes = np.unique(shingle_hashes(text, shingle))
            fps.append(fingerprint(hashes))
            if not len(hashes):
                keys.append([])
                sketches.append(b"")
                continue
            least = _least(hashes, odd, add)
            keys.append([_signed(xxhash.xxh64_intdigest(b"%d:" % i + least[i * rows : (i + 1) * rows].tobytes(), SEED)) for i in range(bands)])
            sketches.append(least.astype(np.uint32).tobytes())
        return pd.DataFrame({"fp": pd.Series(fps, dtype="int64"), "bands": keys, "sketch": sketches})

    return signature


def _lead(radius: int, pairs_up_to: int):
    """Compare the members of a shard: rows (shard, node, fp, leader).

    Of a shard of at most ``pairs_up_to`` texts all pairs within the radius whose sketches agree
    come out. In a larger one a member is compared with the leaders near it, and leaders are
    chosen from the shard's centre outwards (its bitwise majority): the text that copies were
    made from leads them. Leaders have a row with a null ``leader``.
    """

    def settle(key: int, cut: bool, members: list[tuple[int, int, bytes]]) -> list[tuple]:
        tree, nodes, out = BKTree(), {}, []
        pairwise = not cut and len(members) <= pairs_up_to
        if not pairwise:
            values = np.array([m[1] for m in members], np.int64)
            bits = np.unpackbits(values.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
            centre = int(np.packbits(2 * bits > len(values), bitorder="little").view(np.uint64)[0])
            members = sorted(members, key=lambda m: (((m[1] & (1 << 64) - 1) ^ centre).bit_count(), m[0]))
        for node, fp, sketch in members:
            value, own = fp & (1 << 64) - 1, np.frombuffer(sketch, np.uint32)
            near = [other for _, at in tree.within(value, radius) for other, theirs in nodes[at] if (own == theirs).sum() >= SKETCH_AGREE]
            out += [(key, node, fp, other) for other in near]
            if pairwise or not near:
                tree.add(value)
                nodes.setdefault(value, []).append((node, own))
            if not pairwise and not near:
                out.append((key, node, fp, None))
        return out

    def lead(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def table(rows: list[tuple]) -> pd.DataFrame:
            return pd.DataFrame(rows, columns=["shard", "node", "fp", "leader"]).astype({"shard": "int64", "node": "int64", "fp": "int64", "leader": "Int64"})

        now, members, out = None, [], []
        for batch in batches:
            for key, salt, cut, node, fp, sketch in zip(*[batch[c].tolist() for c in ("shard", "salt", "cut", "node", "fp", "sketch")], strict=True):
                if now is not None and now[:2] != (key, salt):
                    out += settle(now[0], now[2], members)
                    members = []
                    if len(out) > CHUNK:
                        yield table(out)
                        out = []
                now = (key, salt, cut)
                members.append((node, fp, sketch))
        if members:
            out += settle(now[0], now[2], members)
        yield table(out)

    return lead


def _may_reach(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether sets with these smallest hashes can have that Jaccard similarity: exact for sets kept whole, else up to 4 standard deviations."""
    both = np.union1d(a, b)
    whole = len(a) < FINE and len(b) < FINE
    both = both if whole else both[:FINE]
    shared = np.intersect1d(a, b, assume_unique=True)
    n = len(shared) if whole else np.searchsorted(shared, both[-1], side="right")
    slack = 0.01 if whole else 4 * (similarity * (1 - similarity) / len(both)) ** 0.5
    return n >= (similarity - slack) * len(both)


def _finest(shingle: int):
    @F.pandas_udf("binary")
    def finest(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique((shingle_hashes(t, shingle) >> np.uint64(32)).astype(np.uint32))[:FINE].tobytes() for t in texts], dtype=object)

    return finest


def _across(radius: int, similarity: float):
    """Pairs (node, leader) of a block's asking and asked texts that are in different classes so far.

    The asked ones of a block come first and make its tree. Of two texts that both ask, the
    one with the larger node reports the pair.
    """

    def across(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        block, tree, nodes, out = None, BKTree(), {}, []
        for batch in batches:
            for *key, asks, node, fp, root, minor, sketch, finest in zip(*[batch[c].tolist() for c in ("shard", "qb", "tb", "asks", "node", "fp", "root", "minor", "sketch", "fine")], strict=True):
                if block != key:
                    block, tree, nodes = key, BKTree(), {}
                value, own, fine = fp & (1 << 64) - 1, np.frombuffer(sketch, np.uint32), np.frombuffer(finest, np.uint32)
                if not asks:
                    tree.add(value)
                    nodes.setdefault(value, []).append((node, root, minor, own, fine))
                    continue
                near = [m for _, at in tree.within(value, radius) for m in nodes[at] if m[1] != root and (m[0] < node or not m[2])]
                if near:
                    agree = (np.stack([m[3] for m in near]) == own).sum(1) >= SKETCH_AGREE
                    out += [(node, near[i][0]) for i in np.flatnonzero(agree) if _may_reach(fine, near[i][4], similarity)]
            if len(out) > CHUNK:
                yield pd.DataFrame(out, columns=["node", "leader"], dtype="int64")
                out = []
        yield pd.DataFrame(out, columns=["node", "leader"], dtype="int64")

    return across


def _texts_of(source: DataFrame, texts: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, text) of the distinct texts with these nodes, from (copy, text) rows; a few digests are broadcast, so that only their texts move.

    ``forget`` on it deletes the digests.
    """
    wanted = staged(texts.join(nodes.distinct(), "node", "left_semi").select("node", F.col("copy").alias("w_copy")), "neardup-wanted")
    hinted = F.broadcast(wanted) if wanted.count() <= BROADCAST_TEXTS else wanted
    out = source.join(hinted, F.col("copy") == F.col("w_copy")).dropDuplicates(["node"]).select("node", "text")
    out.staged_path = wanted.staged_path
    return out


def _class_crossings(source: DataFrame, texts: DataFrame, members: DataFrame, roots: DataFrame, shingle: int, similarity: float, radius: int, block_rows: int) -> DataFrame:
    """Pairs (node, leader) of members of one shard that may be alike and are in different classes so far.

    Texts outside their shard's largest class ask all texts of the shard. Both sides are cut
    into blocks, and a task holds one block of the asked, so memory doesn't grow with a shard.
    """
    rooted = staged(members.join(roots, "node", "left").select("shard", "node", "fp", "sketch", F.coalesce("root", "node").alias("root")), "neardup-rooted")
    classes = rooted.groupBy("shard", "root").agg(F.count(F.lit(1)).alias("n"))
    mixed = classes.groupBy("shard").agg(F.max(F.struct("n", "root")).alias("top"), F.sum("n").alias("n")).filter("top.n < n")
    blocks = mixed.select("shard", F.col("top.root").alias("major"), F.ceil((F.col("n") - F.col("top.n")) / block_rows).alias("qbs"), F.ceil(F.col("n") / block_rows).alias("tbs"))
    rows = staged(rooted.join(blocks, "shard").withColumn("minor", F.col("root") != F.col("major")), "neardup-mixed")
    again = _texts_of(source, texts, rows.select("node"))
    fine = staged(again.select("node", _finest(shingle)("text").alias("fine")), "neardup-fine")
    out = staged(_blocks(rows.join(fine, "node")).mapInPandas(_across(radius, similarity), "node bigint, leader bigint").distinct(), "neardup-across")
    forget(rooted, rows, fine, again)
    return out


def _blocks(rows: DataFrame) -> DataFrame:
    """Rows (shard, node, fp, root, minor, sketch, fine, qbs, tbs) dealt to qbs blocks of those that ask and tbs of those asked."""
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("bigint"), F.col(n) - 1))
    asked = rows.select("*", F.lit(False).alias("asks"), every("qbs").alias("qb"), F.pmod(F.xxhash64("node"), "tbs").alias("tb"))
    asking = rows.filter("minor").select("*", F.lit(True).alias("asks"), F.pmod(F.xxhash64("node", F.lit(1)), "qbs").alias("qb"), every("tbs").alias("tb"))
    dealt = asked.unionByName(asking).repartition("shard", "qb", "tb").sortWithinPartitions("shard", "qb", "tb", "asks")
    return dealt.select("shard", "qb", "tb", "asks", "node", "fp", "root", "minor", "sketch", "fine")


def _leader_blocks(source: DataFrame, texts: DataFrame, heads: DataFrame, shingle: int, block_rows: int) -> DataFrame:
    """The leaders (shard, salt, node, fp, sketch) of cut shards in blocks: all ask, and those of one tree have met already."""
    sizes = heads.groupBy("shard").agg(F.ceil(F.count(F.lit(1)) / block_rows).alias("tbs"))
    fine = _texts_of(source, texts, heads.select("node")).select("node", _finest(shingle)("text").alias("fine"))
    rows = heads.join(sizes, "shard").join(fine, "node")  # AQE broadcasts the sizes while they are few
    return _blocks(rows.select("shard", "node", "fp", F.col("salt").alias("root"), F.lit(True).alias("minor"), "sketch", "fine", F.col("tbs").alias("qbs"), "tbs"))


def _alike(source: DataFrame, texts: DataFrame, pairs: DataFrame, shingle: int, similarity: float) -> DataFrame:
    """Those of the distinct pairs (node, leader) whose shingle sets reach the similarity."""
    wanted = pairs.select(F.explode(F.array("node", "leader")).alias("node"))
    again = _texts_of(source, texts, wanted)
    sets = staged(again.select("node", F.array_distinct(_shingle_sets(shingle)("text")).alias("set")), "neardup-sets")
    both = pairs.join(sets.select("node", F.col("set").alias("a")), "node").join(sets.select(F.col("node").alias("leader"), F.col("set").alias("b")), "leader")
    common = F.size(F.array_intersect("a", "b"))
    out = staged(both.filter(common >= similarity * (F.size("a") + F.size("b") - common) - 1e-9).select("node", "leader"), "neardup-links")
    forget(sets, again)
    return out


def _copy(text: Column) -> Column:
    """The texts without a word are one text."""
    return F.md5(F.when(text.rlike(SPACED_WORD), text).otherwise(""))


def _classes(docs: DataFrame, id_col: str, text_col: str, shingle: int, similarity: float, radius: int, shard_rows: int, pairs_up_to: int, block_rows: int) -> DataFrame:
    """(copy, least, root): the distinct texts by digest, the smallest id of each, and a number that the texts of a class share."""
    word = F.when(bare(text_col).rlike(SPACED_WORD), bare(text_col)).otherwise("")
    source = docs.select(F.md5(word).alias("copy"), word.alias("text"))
    marked = staged(docs.select(bare(id_col).alias("id"), F.md5(word).alias("copy"), _signatures(shingle, BANDS, BAND_HASHES)(word).alias("s")), "neardup-marked")
    texts = staged(marked.groupBy("copy").agg(F.min("id").alias("least"), F.first("s").alias("s")).select(F.monotonically_increasing_id().alias("node"), "copy", "least", "s.*"), "neardup-texts")
    bands = texts.select("node", F.explode("bands").alias("shard"))
    sizes = bands.groupBy("shard").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    # A shard that is too full is dealt to several trees first; their leaders then meet in blocks, as they can be as many as the texts.
    salts = F.ceil(F.col("n") / shard_rows)
    thin = bands.join(sizes, "shard").select("shard", "node", "n", F.pmod(F.xxhash64("node"), salts).alias("salt"), (salts > 1).alias("cut"))
    left = staged(thin.join(texts.select("node", "fp", "sketch"), "node"), "neardup-rows")
    lead, out = _lead(radius, pairs_up_to), "shard bigint, node bigint, fp bigint, leader bigint"
    met = staged(left.select("shard", "salt", "cut", "node", "fp", "sketch").repartition("shard", "salt").sortWithinPartitions("shard", "salt", "node").mapInPandas(lead, out), "neardup-met")
    pairs = met.filter("leader is not null").select("node", "leader")
    if not left.filter("cut").isEmpty():
        heads = staged(met.filter("leader is null").select("shard", "node").join(left.filter("cut"), ["shard", "node"]).select("shard", "salt", "node", "fp", "sketch"), "neardup-heads")
        pairs = pairs.unionByName(_leader_blocks(source, texts, heads, shingle, block_rows).mapInPandas(_across(radius, similarity), "node bigint, leader bigint"))
    pairs = staged(pairs.distinct(), "neardup-candidates")
    edge = [F.col("node").alias("a"), F.col("leader").alias("b")]
    links = _alike(source, texts, pairs, shingle, similarity)
    roots = connected_components(links.select(*edge))
    full = left.filter((F.col("n") > pairs_up_to) | F.col("cut"))
    if not full.isEmpty():
        across = _class_crossings(source, texts, full, roots, shingle, similarity, radius, block_rows)
        crossing = staged(across.join(pairs, ["node", "leader"], "left_anti"), "neardup-crossing")
        more = _alike(source, texts, crossing, shingle, similarity)
        forget(across, crossing)
        if not more.isEmpty():
            roots = connected_components(links.unionByName(more).select(*edge))
    out = staged(texts.join(roots, "node", "left").select("copy", "least", F.coalesce("root", "node").alias("root")), "neardup-classes")
    forget(marked, texts, left, met, pairs, links)
    return out


def near_duplicate_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, shard_rows: int = SHARD_ROWS, pairs_up_to: int = PAIRS_UP_TO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(id, class_id): documents whose texts are equal, or linked by word-shingle sets at that Jaccard similarity.

    In a full shard a document is first compared with the leaders near its fingerprint, so a
    group of copies costs as many comparisons as it has members. A second round compares those
    members of a full shard that the first left in different classes, so no link is lost that
    the shards, the radius and the sketches of smallest shingle hashes let through. class_id
    is the smallest id of the class, of whatever type, and null only where all ids of a class
    are. Null texts and those without a word equal empty ones. Every row comes back.
    """
    classes = _classes(docs, id_col, text_col, shingle, similarity, radius, shard_rows, pairs_up_to, block_rows)
    least = classes.groupBy("root").agg(F.min("least").alias("class_id"))
    named = classes.join(least, "root").select(F.col("copy").alias("c_copy"), "class_id")
    rows = docs.select(bare(id_col).alias(id_col), _copy(bare(text_col)).alias("_cl_copy"))
    return rows.join(named, F.col("_cl_copy") == F.col("c_copy")).select(bare(id_col), "class_id")


def _shingle_sets(shingle: int):
    @F.pandas_udf("array<bigint>")
    def sets(texts: pd.Series) -> pd.Series:
        return pd.Series([np.unique(shingle_hashes(t, shingle)).view(np.int64) for t in texts])

    return sets


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 5, similarity: float = 0.8, radius: int = WIDE_RADIUS, shard_rows: int = SHARD_ROWS, pairs_up_to: int = PAIRS_UP_TO, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """One row of each class, that of the smallest id (null ids last, then by the text's digest); columns unchanged.

    Rows that share an id but not a class are different documents and stay. Of rows with
    one id and one text any one stays.
    """
    classes = _classes(docs, id_col, text_col, shingle, similarity, radius, shard_rows, pairs_up_to, block_rows)
    first = F.min(F.struct(F.col("least").isNull().alias("none"), F.col("least").alias("id"), F.col("copy").alias("copy"))).alias("w")
    kept = staged(classes.groupBy("root").agg(first).select(F.col("w.id").alias("k_id"), F.col("w.copy").alias("k_copy")), "neardup-kept")
    forget(classes)
    rows = docs.select(packed(docs), bare(id_col).alias("id"), _copy(bare(text_col)).alias("copy"))
    own = (F.col("copy") == F.col("k_copy")) & F.col("id").eqNullSafe(F.col("k_id"))
    again = rows.select("id", "copy").groupBy("id", "copy").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select(F.col("id").alias("a_id"), F.col("copy").alias("a_copy"))
    again = staged(again, "neardup-again")
    both = (F.col("k_copy") == F.col("a_copy")) & F.col("k_id").eqNullSafe(F.col("a_id"))
    single = rows.join(kept.join(again, both, "left_anti"), own, "left_semi").select(ROW)
    if not again.isEmpty():
        several = rows.join(kept.join(again, both, "left_semi"), own, "left_semi").dropDuplicates(["id", "copy"]).select(ROW)
        single = single.unionByName(several)
    return single.select(*[F.col(ROW)[c].alias(c) for c in docs.columns])
