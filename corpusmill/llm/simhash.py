"""SimHash near-duplicate groups by a byte-position inverted index with count filtering."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import documents, id_back, id_key, materialize, tasks
from .components import connected

SEED = 42


def fingerprint(text: str, shingle: int) -> int:
    """64-bit SimHash of the word shingles of a text, ASCII letters lower-cased; no words give zero."""
    words = lowered_words(text)
    if not words:
        return 0
    if len(words) < shingle:
        shingles = [b" ".join(words)]
    else:
        shingles = map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(s, SEED) for s in shingles], dtype=">u8")
    total = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 1 << 16):
        total += np.unpackbits(hashes[i : i + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * total > len(hashes)).tobytes(), "big")


def fingerprints(docs: DataFrame, shingle: int) -> DataFrame:
    """``(doc_key, fp)``, the fingerprint as a signed long. No shuffle."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            fp = np.array([fingerprint(t, shingle) for t in pdf["text"]], dtype=np.uint64).view(np.int64)
            yield pd.DataFrame({"doc_key": pdf["doc_key"], "fp": fp})

    return documents(docs).select(id_key().alias("doc_key"), "text").mapInPandas(run, "doc_key long, fp long")


def forest(members: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges that connect members of one posting list as all links within ``bits`` do; at most one a member.

    Breadth first: a member taken from the queue is compared with those not reached yet. Close members are reached by
    the first comparison, so a list of near copies costs about its length, not its square.
    """
    left = members
    a, b = [], []
    queue: list[np.uint64] = []
    while len(left):
        if not queue:
            queue, left = [left[0]], left[1:]
        at = queue.pop()
        near = linked(left, at, bits)
        if near.any():
            found = left[near]
            a.append(np.full(len(found), at))
            b.append(found)
            queue.extend(found)
            left = left[~near]
    return (np.concatenate(a), np.concatenate(b)) if a else (members[:0], members[:0])


def linked(a: np.ndarray, b: np.ndarray, bits: int) -> np.ndarray:
    """Which pairs share the least number of positional bytes that a link guarantees, and differ in few enough bits."""
    differ = np.atleast_1d(a ^ b)
    tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(axis=1)
    near = tally >= 8 - bits
    near[near] = np.bitwise_count(differ[near]) <= bits
    return near


def covering(bits: int, width: int) -> list[tuple[int, ...]]:
    """Choices of ``width`` of 8 positions, one of which lies in any ``8 - bits`` positions that a pair may share.

    Positions are dealt to as many groups as the pigeonhole principle allows: of ``8 - bits`` shared positions,
    ``width`` at least then fall into one group.
    """
    groups = (8 - bits - 1) // (width - 1) if width > 1 else bits + 1
    if width == 1:
        return [(p,) for p in range(groups)]
    return [c for g in range(groups) for c in combinations(range(g, 8, groups), width)]


def width_for(n: int, bits: int) -> int:
    """Bytes a posting list is named by, for ``n`` fingerprints: two while lists have some 64 members at most, else as
    many as a linked pair shares at least. Every width finds every link; it only sets what the lists cost."""
    return min(2, 8 - bits) if n <= 64 << 16 else 8 - bits


#: Posting lists of at most so many fingerprints are compared pair by pair at once, longer ones breadth first.
SHORT_LIST = 64


def links(distinct: DataFrame, bits: int, width: int) -> DataFrame:
    """Edges ``(u, v)`` between distinct fingerprints that connect all pairs at ``bits`` or fewer differing bits.

    ``bits`` differing bits lie in at most ``bits`` of the 8 bytes, so a linked pair shares at least ``8 - bits``
    positional bytes, the guaranteed minimum. The index lists fingerprints by (position, byte) postings, ``width`` of
    them together (``covering``), as lists of one byte hold a 256th of all fingerprints and their pairs grow as the
    square. For pairs that meet, the shared positional bytes are tallied; those that reach the minimum are verified on
    their bits.
    """
    if not 0 < bits < 8 or not 1 <= width <= 8 - bits:
        raise ValueError("bits must be from 1 to 7, and width from 1 to the bytes that a linked pair shares")
    masks = [sum(0xFF << 8 * p for p in c) for c in covering(bits, width)]
    signed = [m - (1 << 64) if m >> 63 else m for m in masks]
    postings = F.array(*(F.struct(F.lit(i).cast("short").alias("c"), F.col("fp").bitwiseAND(F.lit(m)).alias("bytes")) for i, m in enumerate(signed)))
    listed = distinct.select("fp", F.explode(postings).alias("p")).select("p.c", "p.bytes", "fp")
    ordered = listed.repartition(tasks(distinct.sparkSession), "c", "bytes").sortWithinPartitions("c", "bytes", "fp")

    def verify(c: np.ndarray, key: np.ndarray, fp: np.ndarray) -> pd.DataFrame:
        starts = np.flatnonzero(np.concatenate([[True], (c[1:] != c[:-1]) | (key[1:] != key[:-1])]))
        sizes = np.diff(np.append(starts, len(fp)))
        size = np.repeat(sizes, sizes)
        place = np.arange(len(fp)) - np.repeat(starts, sizes)
        a, b = [fp[:0]], [fp[:0]]
        rows, step = np.flatnonzero((size > 1) & (size <= SHORT_LIST)), 1
        while len(rows):
            rows = rows[place[rows] + step < size[rows]]
            near = rows[linked(fp[rows], fp[rows + step], bits)]
            a.append(fp[near])
            b.append(fp[near + step])
            step += 1
        for s, n in zip(starts[sizes > SHORT_LIST], sizes[sizes > SHORT_LIST]):
            x, y = forest(fp[s : s + n], bits)
            a.append(x)
            b.append(y)
        edges = np.stack([np.concatenate(a).view(np.int64), np.concatenate(b).view(np.int64)], axis=1)
        edges.sort(axis=1)
        return pd.DataFrame({"u": edges[:, 0], "v": edges[:, 1]}).drop_duplicates()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest: list[tuple[np.ndarray, ...]] = []  # the list that may go on in the next batch
        for pdf in batches:
            if not len(pdf):
                continue
            c, key, fp = pdf["c"].to_numpy(), pdf["bytes"].to_numpy(), pdf["fp"].to_numpy().view(np.uint64)
            end = int(np.flatnonzero((c == c[-1]) & (key == key[-1]))[0])  # where the last list of the batch begins
            if end == 0 and rest and (rest[0][0][0], rest[0][1][0]) == (c[0], key[0]):
                rest.append((c, key, fp))
                continue
            done = [*rest, (c[:end], key[:end], fp[:end])]
            if sum(len(x[0]) for x in done):
                yield verify(*(np.concatenate(x) for x in zip(*done)))
            rest = [(c[end:], key[end:], fp[end:])]
        if rest:
            yield verify(*(np.concatenate(x) for x in zip(*rest)))

    return ordered.mapInPandas(run, "u long, v long").distinct()


def simhash_groups(docs: DataFrame, shingle: int = 5, bits: int = 4) -> DataFrame:
    """``doc_id, fingerprint, component_id``: every document, its fingerprint, the smallest id of its group.

    Texts of null count as empty; texts without words share the fingerprint zero and so one group. Copies share a
    fingerprint and are indexed once. Null ids take part, as the smallest id. Equal rows give equal rows.
    """
    rows = materialize(fingerprints(docs, shingle), "fingerprints")
    distinct = materialize(rows.groupBy("fp").agg(F.min("doc_key").alias("first")), "distinct-fingerprints")
    roots = connected(links(distinct.select("fp"), bits, width_for(distinct.count(), bits)))
    grouped = distinct.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    members = grouped.select("fp", "root").join(smallest, "root").select("fp", "component")
    hexed = F.lower(F.lpad(F.hex("fp"), 16, "0"))
    return rows.join(members, "fp").select(id_back("doc_key").alias("doc_id"), hexed.alias("fingerprint"), id_back("component").alias("component_id"))


#: Bytes of a wide fingerprint.
WIDE = 128
#: Chance that two texts at a similarity of 0.8 share a byte: their bits differ with chance 0.1515.
SHARED = (1 - 0.1515) ** 8
#: Lists a wide fingerprint stands in where lists are named by three bytes.
LISTS = 256
_STEPS = np.random.default_rng(11).integers(0, 2**64, size=WIDE // 8, dtype=np.uint64)
_BITS = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1).astype(np.int64)
#: Lists of more members that are still in parts join a family; members of shorter ones are paired.
SMALL_LIST = 16
#: Members of a family's block; beyond ``MOST_BLOCKS`` of them blocks grow, up to the largest.
FAMILY_BLOCK, MOST_BLOCKS, LARGEST_BLOCK = 2048, 64, 16384


def choices_for(n: int) -> np.ndarray:
    """Byte positions that name the posting lists of ``n`` fingerprints, one row a list.

    Unrelated texts share a byte with chance 1 / 256, so lists are named by so many bytes that some four of them meet in
    one by chance, three up to 64 million texts. A pair at the threshold meets in ``LISTS * SHARED ** 3``, about five, lists
    on average, however many bytes name one.
    """
    width = 3
    while n > 4 * 256**width:
        width += 1
    lists = round(LISTS / SHARED ** (width - 3))
    return np.array([np.random.default_rng([7, c]).choice(WIDE, width, replace=False) for c in range(lists)])


def lowered_words(text: str) -> list[bytes]:
    """Words with ASCII letters lower-cased, as bytes, in which only ASCII white space separates."""
    return text.encode("utf-8", "surrogatepass").lower().split()


def shingle_hashes(words: list[bytes], shingle: int) -> np.ndarray:
    """Hashes of the distinct word shingles, sorted; fewer words make one shingle, none make none."""
    if not words:
        return np.zeros(0, np.uint64)
    shingles = [b" ".join(words)] if len(words) < shingle else map(b" ".join, zip(*(words[i:] for i in range(shingle))))
    return np.unique(np.array([xxhash.xxh3_64_intdigest(x) for x in shingles], dtype=np.uint64))


def wide_fingerprint(base: np.ndarray) -> bytes:
    """SimHash of ``8 * WIDE`` bits from one hash a shingle; no shingles give zeros."""
    if not len(base):
        return bytes(WIDE)
    total = np.zeros((WIDE, 8), np.int64)
    place = 256 * np.arange(8)
    for i in range(0, len(base), 1 << 14):
        part = base[i : i + (1 << 14)]
        for k, step in enumerate(_STEPS):
            h = (part ^ step) * np.uint64(0x9E3779B97F4A7C15)
            h = (h ^ (h >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(32)
            counts = np.bincount((h.view(np.uint8).reshape(-1, 8) + place).ravel(), minlength=2048).reshape(8, 256)
            total[8 * k : 8 * k + 8] += counts @ _BITS
    return np.packbits(2 * total.ravel() > len(base)).tobytes()


def similar(a: np.ndarray, b: np.ndarray, least: float) -> bool:
    """Whether two sorted sets of hashes have at least this Jaccard similarity; two empty ones do."""
    n, m = len(a), len(b)
    if min(n, m) < least * max(n, m):
        return False
    both = np.sort(np.concatenate([a, b]))
    common = int((both[1:] == both[:-1]).sum())
    return common >= least * (n + m - common)


class Bounds:
    """What a pair of wide fingerprints must show for its texts to be compared: enough shared bytes, few enough
    differing bits. Each bound lies three standard errors from what texts at the threshold show on average."""

    def __init__(self, similarity: float):
        share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
        byte = (1 - share) ** 8
        self.similarity = similarity
        self.most_bits = 8 * WIDE * share + 3 * np.sqrt(8 * WIDE * share * (1 - share))
        self.least_bytes = WIDE * byte - 3 * np.sqrt(WIDE * byte * (1 - byte))

    def near(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For rows of eight-byte words: the tally of shared positional bytes reaches its minimum, and bits agree."""
        differ = a ^ b
        tally = (differ.view(np.uint8).reshape(len(differ), WIDE) == 0).sum(axis=1)
        near = tally >= self.least_bytes
        near[near] = np.bitwise_count(differ[near]).sum(axis=1, dtype=np.int64) <= self.most_bits
        return near


def _wide(column: pd.Series) -> np.ndarray:
    return np.frombuffer(b"".join(column), np.uint64).reshape(-1, WIDE // 8)


#: Kinds of rows that posting lists give.
LED, PAIR, MEMBER = 0, 1, 2


def posting_lists(distinct: DataFrame, choices: np.ndarray) -> DataFrame:
    """Lists of fingerprints ``(node, wide)`` that share all bytes of a choice: ``(kind, a, b)``.

    ``LED``: the least node of a list of three or more, and another member. ``PAIR``: the two members of a list of two.
    ``MEMBER``: ``a`` is a list of three or more and ``b`` a member. A list is read in order and never held, so its
    length does not matter.
    """

    def post(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        salt = np.arange(len(choices), dtype=np.uint64)
        for pdf in batches:
            for i in range(0, len(pdf), 1000):
                part = pdf.iloc[i : i + 1000]
                wide = np.frombuffer(b"".join(part["wide"]), np.uint8).reshape(-1, WIDE).astype(np.uint64)
                key = np.broadcast_to(salt, (len(part), len(choices))).copy()
                for k in range(choices.shape[1]):  # the choice above, its bytes below
                    key = key << np.uint64(8) | wide[:, choices[:, k]]
                yield pd.DataFrame({"key": key.view(np.int64).ravel(), "node": np.repeat(part["node"].to_numpy(), len(choices))})

    def pair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        last_key, leader, second, seen = None, 0, 0, 0
        for pdf in batches:
            n = len(pdf)
            if not n:
                continue
            key, node = pdf["key"].to_numpy(), pdf["node"].to_numpy()
            new = np.concatenate([[key[0] != last_key], key[1:] != key[:-1]])
            starts = np.flatnonzero(new)
            group = np.cumsum(new) - (1 if new[0] else 0)  # with a list that goes on as group 0
            heads = node[starts] if new[0] else np.concatenate([[leader], node[starts]])
            first = starts if new[0] else np.concatenate([[-seen], starts])
            place = np.arange(n) - first[group]
            lead = heads[group]
            third = np.flatnonzero(place == 2)
            seconds = np.where(third > 0, node[np.maximum(third - 1, 0)], second)
            more = np.flatnonzero(place >= 2)
            two = np.flatnonzero((place[:-1] == 1) & new[1:])  # whose list ends with them
            ended = [(leader, second)] if new[0] and seen == 2 else []  # the list of two before this batch
            a = np.concatenate([[x for x, _ in ended], lead[two], lead[third], lead[more], key[third], key[third], key[more]])
            b = np.concatenate([[y for _, y in ended], node[two], seconds, node[more], lead[third], seconds, node[more]])
            n_two, n_led = len(ended) + len(two), len(third) + len(more)
            kind = np.repeat([PAIR, LED, MEMBER], [n_two, n_led, len(a) - n_two - n_led])
            yield pd.DataFrame({"kind": kind, "a": a.astype(np.int64), "b": b.astype(np.int64)})
            last_key, leader, second, seen = key[-1], lead[-1], node[-1], int(place[-1]) + 1
        if seen == 2:
            yield pd.DataFrame({"kind": [PAIR], "a": [leader], "b": [second]})

    listed = distinct.select("node", "wide").mapInPandas(post, "key long, node long")
    ordered = listed.repartition(tasks(distinct.sparkSession), "key").sortWithinPartitions("key", "node")
    return ordered.mapInPandas(pair, "kind int, a long, b long")


def verified(pairs: DataFrame, distinct: DataFrame, sets: DataFrame | None, bounds: Bounds) -> DataFrame:
    """The pairs ``(u, v)`` whose wide fingerprints are near and, with ``sets``, whose shingle sets are similar."""

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.loc[bounds.near(_wide(pdf["a"]), _wide(pdf["b"])), ["u", "v"]]

    def same(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            keep = [similar(np.frombuffer(a, np.uint32), np.frombuffer(b, np.uint32), bounds.similarity) for a, b in zip(pdf["a"], pdf["b"])]
            yield pdf.loc[np.array(keep, bool), ["u", "v"]]

    table, value, check = (distinct, "wide", near) if sets is None else (sets, "shingles", same)
    both = pairs.join(table.select(F.col("node").alias("u"), F.col(value).alias("a")), "u")
    both = both.join(table.select(F.col("node").alias("v"), F.col(value).alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInPandas(check, "u long, v long")


def family_links(roots: DataFrame, parts: DataFrame, distinct: DataFrame, sets: DataFrame, bounds: Bounds) -> DataFrame:
    """Edges ``(u, v)`` that connect members of families ``(node, root)`` as all their verified pairs do.

    Lists with common members form a family. Its members are dealt into blocks; each two blocks of a family meet in
    one task, so every pair of a family is compared wherever its lists are, and a task holds two blocks at most. Members
    of one part, as ``parts (node, part)`` tells, are connected already: a task compares the members of all but its largest
    part with those of other parts, and of two parts one link is enough. A family without near copies costs its square.
    """
    n = F.col("n")
    blocks = F.greatest(F.least(F.ceil(n / FAMILY_BLOCK), F.lit(MOST_BLOCKS)), F.ceil(n / LARGEST_BLOCK)).cast("int")
    sizes = materialize(roots.groupBy("root").agg(F.count("*").alias("n")).select("root", blocks.alias("blocks")), "family-sizes")
    placed = roots.join(sizes, "root").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    placed = placed.join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    placed = placed.join(distinct.select("node", "wide"), "node").join(sets, "node")
    other = F.explode(F.when(F.col("blocks") == 1, F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.col("blocks") - 1), lambda o: o != F.col("block"))))
    met = placed.select("root", "block", "node", "part", "wide", "shingles", other.alias("other"))
    met = met.select("root", F.least("block", "other").alias("p"), F.greatest("block", "other").alias("q"), "node", "part", "wide", "shingles")

    def search(pdf: pd.DataFrame) -> pd.DataFrame:
        node, wide = pdf["node"].to_numpy(), _wide(pdf["wide"])
        _, part, size = np.unique(pdf["part"].to_numpy(), return_inverse=True, return_counts=True)
        shingles = [np.frombuffer(x, np.uint32) for x in pdf["shingles"]]
        found = []
        order = np.argsort(size[part], kind="stable")
        for x in order[: len(order) - size.max()]:
            apart = np.flatnonzero(part != part[x])
            for y in apart[bounds.near(wide[apart], wide[x])] if len(apart) else ():
                if part[y] != part[x] and similar(shingles[x], shingles[y], bounds.similarity):
                    found.append((node[x], node[y]))
                    part[part == part[y]] = part[x]
        return pd.DataFrame(np.array(found, np.int64).reshape(-1, 2), columns=["u", "v"])

    return met.groupBy("root", "p", "q").applyInPandas(search, "u long, v long")


def count_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """``key, part, n``: how many texts of a batch ``(part, keys)`` each list holds of each part."""
    for pdf in batches:
        sizes = pdf["keys"].map(len).to_numpy(np.int64)
        if sizes.sum():
            rows = pd.DataFrame({"key": np.concatenate(pdf["keys"].tolist()), "part": np.repeat(pdf["part"].to_numpy(), sizes)})
            yield rows.groupby(["key", "part"]).size().reset_index(name="n")


def near_links(distinct: DataFrame, sets_of, similarity: float) -> DataFrame:
    """Edges ``(u, v)`` that connect the texts ``(node, wide)`` whose shingle sets are at least ``similarity`` alike.

    1. Texts are listed under many choices of (position, byte) postings. Every text meets one leader, of those that lead
       its lists the one it shares most lists with, so near copies cost one pair each however many lists they share. The
       members of a list of two meet. Shared positional bytes are tallied a pair, then bits, then shingle sets compared.
    2. Verified pairs connect most lists of near copies, and a list in one part needs no more. Long lists that are still in
       parts are joined to families, which are searched in blocks. In short ones, members of different parts and families
       are paired. So every list ends in one part, or all its pairs across parts have been compared.
    ``sets_of`` gives ``(node, shingles)`` for a table of nodes.
    """
    bounds = Bounds(similarity)
    found = materialize(posting_lists(distinct, choices_for(distinct.count())), "posting-lists")
    meets = found.filter(F.col("kind") != MEMBER).groupBy(F.col("a").alias("u"), F.col("b").alias("v")).agg(F.count("*").alias("n"), F.max("kind").alias("kind"))
    meets = materialize(meets, "meetings")
    most = meets.groupBy("v").agg(F.max_by("u", F.struct("n", -F.col("u"))).alias("u")).select("u", "v")
    pairs = most.unionByName(meets.filter(F.col("kind") == PAIR).select("u", "v")).distinct()
    near = materialize(verified(pairs, distinct, None, bounds), "near-pairs")
    members = found.filter(F.col("kind") == MEMBER).select(F.col("a").alias("key"), F.col("b").alias("node"))
    active = near.select(F.col("u").alias("node")).unionByName(near.select(F.col("v").alias("node"))).unionByName(members.select("node")).distinct()
    sets = materialize(sets_of(active), "shingle-sets")
    edges = materialize(verified(near, distinct, sets, bounds), "near-edges")
    parts = connected(edges).withColumnRenamed("root", "part")
    # parts are looked up a text, with all its lists, and counted a list where the texts are: near copies of one part share
    # most lists, so a task passes on about one row for each list, not one for each text and list
    listed = members.groupBy("node").agg(F.collect_list("key").alias("keys")).join(parts, "node", "left").select(F.coalesce("part", "node").alias("part"), "keys")
    per_part = listed.mapInPandas(count_parts, "key long, part long, n long").groupBy("key", "part").agg(F.sum("n").alias("n"))
    per_part = materialize(per_part, "list-parts")
    lists = per_part.groupBy("key").agg(F.sum("n").alias("size"), F.count("*").alias("n_parts")).filter("n_parts > 1").select("key", "size")
    # from here lists are rows of parts, not of members: a list of many near copies has a few
    open_parts = materialize(per_part.select("key", "part").join(lists, "key"), "open-parts")
    if open_parts.isEmpty():
        return edges
    long = open_parts.filter(F.col("size") > SMALL_LIST)
    heads = long.groupBy("key").agg(F.min("part").alias("u"))
    stars = long.join(heads, "key").select("u", F.col("part").alias("v")).filter("u != v").distinct()
    joined = connected(stars).select(F.col("node").alias("part"), F.col("root").alias("family"))
    grown = parts.join(joined, "part").select("node", F.col("family").alias("root"))
    alone = joined.join(parts.select(F.col("node").alias("part")), "part", "left_anti").select(F.col("part").alias("node"), F.col("family").alias("root"))
    families = materialize(grown.unionByName(alone), "families")
    if not families.isEmpty():
        edges = edges.unionByName(family_links(families, parts, distinct, sets, bounds))
    # short lists whose parts are not all in one family, by members
    own = F.coalesce("family", "part")
    short = open_parts.filter(F.col("size") <= SMALL_LIST).join(joined, "part", "left").groupBy("key").agg(F.min(own).alias("a"), F.max(own).alias("b"))
    short = members.join(short.filter("a != b").select("key"), "key").join(parts, "node", "left").withColumn("part", F.coalesce("part", "node"))
    short = short.join(joined, "part", "left").select("key", "node", own.alias("family"))
    other = short.select("key", F.col("node").alias("x"), F.col("family").alias("x_family"))
    met = short.join(other, "key").filter("node < x and family != x_family").select(F.col("node").alias("u"), F.col("x").alias("v")).distinct()
    return edges.unionByName(verified(verified(met, distinct, None, bounds), distinct, sets, bounds))


def near_groups(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``(doc_key, text_hash, first_key, first_hash)``: groups of texts connected by pairs whose shingle sets have at
    least this Jaccard similarity. The first of a group is its row of the smallest id, then text hash; a null id is the smallest.

    Words are lower-cased (ASCII), shingles counted once and told apart by 32-bit hashes; texts of equal words are one
    node, found by 128 bits of hash. A 64-bit fingerprint tells texts apart that differ by a few shingles only: at a similarity of 0.8
    they differ in ten bits, more than its bytes can guarantee to match. So ``8 * WIDE`` bits are used here, which differ
    in ``acos(2 s / (1 + s)) / pi`` of all, and no pair is linked by them alone. A pair at 0.8 meets in a list with a
    chance of about 0.95, one at 0.85 nearly always; larger groups hang together by other pairs too.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for text in pdf["text"]:
                words = lowered_words(text)
                digest = np.frombuffer(xxhash.xxh3_128_digest(b" ".join(words)), np.int64)
                out.append((digest[0], digest[1], wide_fingerprint(shingle_hashes(words, shingle))))
            made = pd.DataFrame(out, columns=["h1", "h2", "wide"], index=pdf.index)
            yield pd.concat([pdf[["doc_key", "text_hash"]], made], axis=1)

    def hash_sets(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            sets = [np.unique(shingle_hashes(lowered_words(t), shingle).astype(np.uint32)).tobytes() for t in pdf["text"]]
            yield pd.DataFrame({"node": pdf["node"], "shingles": sets})

    texts = documents(docs).select(id_key().alias("doc_key"), F.xxhash64("text").alias("text_hash"), "text")
    rows = materialize(texts.mapInPandas(run, "doc_key long, text_hash long, h1 long, h2 long, wide binary"), "wide-fingerprints")
    distinct = rows.groupBy("h1", "h2").agg(F.min(F.struct("doc_key", "text_hash")).alias("first"), F.max("wide").alias("wide"))
    distinct = materialize(distinct.withColumn("node", F.monotonically_increasing_id()), "distinct-wide")

    def sets_of(nodes: DataFrame) -> DataFrame:
        """Shingle sets of the texts that meet others, from the first row of each; they are read again rather than stored."""
        wanted = distinct.join(nodes, "node").select("node", F.col("first.doc_key").alias("doc_key"), F.col("first.text_hash").alias("text_hash"))
        found = texts.join(wanted, ["doc_key", "text_hash"]).select("node", "text")
        return found.mapInPandas(hash_sets, "node long, shingles binary").dropDuplicates(["node"])

    roots = connected(near_links(distinct, sets_of, similarity))
    grouped = distinct.select("node", "h1", "h2", "first").join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    smallest = grouped.groupBy("root").agg(F.min("first").alias("component"))
    members = grouped.join(smallest, "root").select("h1", "h2", "component")
    found = rows.select("doc_key", "text_hash", "h1", "h2").join(members, ["h1", "h2"])
    return found.select("doc_key", "text_hash", F.col("component.doc_key").alias("first_key"), F.col("component.text_hash").alias("first_hash"))


def near_dedup(docs: DataFrame, shingle: int = 5, similarity: float = 0.8) -> DataFrame:
    """``docs`` with one row of each group: that of the smallest id, then text hash; of rows equal in both, one.

    Rows are named by id and text, so groups whose first rows share an id, or have none, keep one row each.
    """
    groups = near_groups(docs, shingle, similarity).filter("doc_key = first_key and text_hash = first_hash")
    kept = groups.select(F.col("first_key").alias("_kept"), F.col("first_hash").alias("_kept_hash")).distinct()
    rows = docs.withColumn("_key", id_key()).withColumn("_hash", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    rows = rows.join(kept, (F.col("_key") == F.col("_kept")) & (F.col("_hash") == F.col("_kept_hash")), "left_semi")
    return rows.dropDuplicates(["_key", "_hash"]).select(*docs.columns)
