"""Merkle manifest of a dataset: trees of SHA-256 whose parents keep copied hash states before each child slot."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import id_back, id_key, materialize, tasks

#: Children of a node.
FAN = 8
#: Levels of a tree that one task folds at once, and the nodes below them.
LEVELS = 4
BLOCK = FAN**LEVELS
#: Columns of a document's record, in order.
RECORD = ("doc_id", "source", "lang", "n_chars", "text")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def field(value: Column) -> Column:
    """A value with its length in UTF-8 bytes before it, so that fields cannot run into one another; ``-`` for null."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf(columns: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(columns[c]) for c in RECORD)), 256)


class Parent:
    """A node over up to ``FAN`` digests. ``states[i]`` is the hash state before child ``i``: to fold another digest into
    that place, the state is resumed, and only the replacement and the right siblings are hashed."""

    def __init__(self, children: list[str]):
        self.children = children
        self.states = []
        state = hashlib.sha256()
        for c in children:
            self.states.append(state.copy())
            state.update(c.encode())
        self.digest = state.hexdigest()

    def fold(self, place: int, digest: str) -> str:
        state = self.states[place].copy()
        state.update("".join([digest, *self.children[place + 1 :]]).encode())
        return state.hexdigest()

    def siblings(self, place: int) -> str:
        return "".join(self.children[:place] + self.children[place + 1 :])


class Block:
    """Up to ``LEVELS`` levels over up to ``BLOCK`` digests that follow one another in a tree of ``size`` nodes."""

    def __init__(self, digests: list[str], size: int):
        self.levels: list[list[Parent]] = []
        nodes = digests
        while size > 1 and len(self.levels) < LEVELS:
            self.levels.append([Parent(nodes[i : i + FAN]) for i in range(0, len(nodes), FAN)])
            nodes = [p.digest for p in self.levels[-1]]
            size = -(-size // FAN)
        self.digest = nodes[0]

    def path(self, place: int) -> list[tuple[Parent, int]]:
        out = []
        for level in self.levels:
            place, slot = divmod(place, FAN)
            out.append((level[place], slot))
        return out


class Path:
    """What lies above a block on the way to the root: states before its place on every level, and right siblings."""

    def __init__(self, lefts: list[str], rights: list[str]):
        self.states = [hashlib.sha256(x.encode()) for x in lefts]
        self.rights = [x.encode() for x in rights]
        self.siblings = "".join(a + b for a, b in zip(lefts, rights))
        self.folded: dict[str, str] = {}

    def fold(self, digest: str) -> str:
        """The root if the block had this digest; documents that were not tampered with share one answer."""
        if digest not in self.folded:
            at = digest
            for state, right in zip(self.states, self.rights):
                state = state.copy()
                state.update(at.encode() + right)
                at = state.hexdigest()
            self.folded[digest] = at
        return self.folded[digest]


def ranked(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place``, from 0 in each ``tree`` by ``order``, and ``size``, the rows of the tree.

    Rows are dealt to ranges by sampled bounds and numbered where they lie; rows of earlier ranges are added from
    counts. Rows equal in tree and order are dealt by their number in the stored table, so a tree or key that holds a third
    of all rows is many ranges, and no task holds one whole.
    """
    spark = rows.sparkSession
    numbered = materialize(rows.withColumn("_row", F.monotonically_increasing_id()), "merkle-rows")
    keys = [F.col(tree).asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in order), F.col("_row").asc()]
    dealt = numbered.repartitionByRange(tasks(spark), *keys).sortWithinPartitions(*keys)
    columns = rows.columns

    def number(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, last, seen = TaskContext.get().partitionId(), None, 0
        for pdf in batches:
            if not len(pdf):
                continue
            name = pdf[tree].map(lambda x: (x is not None, x)).to_numpy()
            new = pd.Series([a != b for a, b in zip(name, [last, *name[:-1]])])
            run = new.cumsum()
            nth = run.groupby(run).cumcount()
            nth = nth + (run == 0) * seen
            yield pdf[columns].assign(_part=part, _nth=nth.to_numpy())
            last, seen = name[-1], int(nth.iloc[-1]) + 1

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema) + ", _part int, _nth long"
    placed = materialize(dealt.mapInPandas(number, schema), "merkle-ranges")
    counts = placed.groupBy(F.col(tree).alias("_tree"), F.col("_part").alias("_p")).agg(F.count("*").alias("n"))
    before = Window.partitionBy("_tree").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    bases = counts.select("_tree", "_p", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("_base"), F.sum("n").over(Window.partitionBy("_tree")).alias("size"))
    joined = placed.join(bases, (F.col("_part") == F.col("_p")) & F.col(tree).eqNullSafe(F.col("_tree")))
    return joined.select(*columns, (F.col("_base") + F.col("_nth")).alias("place"), "size")


NODES = "tree string, place long, size long, digest string"


def parents(nodes: DataFrame) -> DataFrame:
    """The next ``LEVELS`` levels of all trees at once: one node for each ``BLOCK`` of ``nodes (tree, place, size, digest)``."""

    def fold(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        place, size = int(pdf["place"].iloc[0]) // BLOCK, int(pdf["size"].iloc[0])
        block = Block(pdf["digest"].tolist(), size)
        for _ in block.levels:
            size = -(-size // FAN)
        return pd.DataFrame({"tree": [pdf["tree"].iloc[0]], "place": [place], "size": [size], "digest": [block.digest]})

    block = F.floor(F.col("place") / BLOCK).alias("block")
    return nodes.select("tree", "place", "size", "digest", block).groupBy("tree", "block").applyInPandas(fold, NODES)


def paths(nodes: DataFrame, above: DataFrame) -> DataFrame:
    """``(tree, place, lefts, rights)`` of every node: its siblings on each level up to the root.

    ``above`` has the same for the blocks of the nodes, which their own levels come before.
    """

    def down(key: tuple, pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        block = Block(pdf["digest"].tolist(), int(pdf["size"].iloc[0]))
        lefts, rights = [], []
        for i in range(len(pdf)):
            way = block.path(i)
            lefts.append(["".join(p.children[:s]) for p, s in way] + list(top["lefts"].iloc[0]))
            rights.append(["".join(p.children[s + 1 :]) for p, s in way] + list(top["rights"].iloc[0]))
        return pd.DataFrame({"tree": pdf["tree"], "place": pdf["place"], "lefts": lefts, "rights": rights})

    block = F.floor(F.col("place") / BLOCK).alias("block")
    below = nodes.withColumn("block", block).groupBy("tree", "block")
    return below.cogroup(above.withColumn("block", F.col("place")).groupBy("tree", "block")).applyInPandas(
        down, "tree string, place long, lefts array<string>, rights array<string>"
    )


def grown(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Stored levels of ``nodes`` up to one node a tree, lowest first, and that node a tree."""
    levels = [nodes]
    while not levels[-1].filter("size > 1").isEmpty():
        levels.append(materialize(parents(levels[-1]), "merkle-nodes"))
    return levels[:-1], levels[-1]


def descended(levels: list[DataFrame], top: DataFrame) -> DataFrame:
    """Paths of the blocks that the lowest of ``levels`` falls into, from paths of the trees' last nodes."""
    for nodes in reversed(levels[1:]):
        top = materialize(paths(nodes, top), "merkle-paths")
    return top


def manifest(docs: DataFrame, tampered: Column, tamper: dict[str, Column] | None = None) -> DataFrame:
    """A Merkle tree over ``docs`` by language, and every document's proof checked against its root.

    Returns ``doc_id, lang, leaf, subroot, root, proof_sha256, folded_root, verified``. A leaf is the SHA-256 of the
    columns ``RECORD``. Leaves of a language ascend by id, null first, and rows of one id by leaf; runs of ``FAN`` nodes
    become their hash until one is left, the subroot, and subroots by language likewise the root. A null id and a null
    language are ordinary values; a lone leaf is its subroot. ``proof_sha256`` is the hash of the siblings on the way
    up. Where ``tampered`` holds, the leaf is made anew with the columns of ``tamper``, by default the text with A-Z
    lower-cased, and folded into the original siblings; ``verified`` says whether the root came out the same. Equal
    rows stand side by side and give a row each; other columns are not read; an empty table gives no rows.

    A task folds blocks of ``BLOCK`` leaves, four levels at once; upper levels are tables 4,096 times smaller each.
    """
    tamper = tamper if tamper is not None else {"text": F.translate("text", _UPPER, _LOWER)}
    own = {c: F.col(c) if c in ("source", "lang", "text") else F.col(c).cast("long") for c in RECORD}
    other = F.when(tampered, leaf(own | tamper))
    rows = docs.select(id_key().alias("doc_key"), F.col("lang").cast("string").alias("tree"), leaf(own).alias("digest"), other.alias("other"))
    leaves = materialize(ranked(rows, "tree", ["doc_key", "digest"]), "merkle-leaves")
    levels, tops = grown(leaves.select("tree", "place", "size", "digest"))
    subroots = tops.select(F.lit("").alias("tree"), F.col("tree").alias("lang"), F.col("digest"))
    subroots = ranked(subroots, "tree", ["lang"])
    subroots = materialize(subroots, "merkle-subroots")
    upper, root = grown(subroots.select("tree", "place", "size", "digest"))
    empty = F.array().cast("array<string>")
    way = root.select("tree", "place", empty.alias("lefts"), empty.alias("rights"))
    way = descended(upper, way)
    way = paths(subroots.select("tree", "place", "size", "digest"), way) if upper else way
    way = way.select(F.col("place").alias("p"), "lefts", "rights").join(subroots.select("place", "lang", F.col("digest").alias("subroot")), F.col("p") == F.col("place"))
    ends = root.select(F.col("digest").alias("root"))
    way = materialize(way.crossJoin(F.broadcast(ends)).select(F.col("lang").alias("tree"), F.lit(0).cast("long").alias("place"), "lefts", "rights", "subroot", "root"), "merkle-ways")
    blocks = descended(levels, way.select("tree", "place", "lefts", "rights"))
    blocks = blocks.join(way.select(F.col("tree").alias("t"), "subroot", "root"), F.col("tree").eqNullSafe(F.col("t")))

    def judge(key: tuple, pdf: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("place")
        block = Block(pdf["digest"].tolist(), int(pdf["size"].iloc[0]))
        top = top.iloc[0]
        above = Path(list(top["lefts"]), list(top["rights"]))
        proofs, folded = [], []
        for i, (digest, other) in enumerate(zip(pdf["digest"], pdf["other"])):
            way = block.path(i)
            proof = hashlib.sha256("".join(p.siblings(s) for p, s in way).encode())
            proof.update(above.siblings.encode())
            proofs.append(proof.hexdigest())
            at = digest if other is None else other
            for p, s in way:
                at = p.fold(s, at)
            folded.append(above.fold(at))
        out = pdf[["doc_key", "tree", "digest"]].assign(subroot=top["subroot"], root=top["root"], proof_sha256=proofs, folded_root=folded)
        return out

    block = F.floor(F.col("place") / BLOCK)
    below = leaves.withColumn("block", block).groupBy("tree", "block")
    above = blocks.select("tree", F.col("place").alias("block"), "lefts", "rights", "subroot", "root").groupBy("tree", "block")
    judged = below.cogroup(above).applyInPandas(judge, "doc_key long, tree string, digest string, subroot string, root string, proof_sha256 string, folded_root string")
    return judged.select(
        id_back("doc_key").alias("doc_id"), F.col("tree").alias("lang"), F.col("digest").alias("leaf"), "subroot", "root", "proof_sha256", "folded_root",
        (F.col("folded_root") == F.col("root")).alias("verified"),
    )


def every_third(doc_id: Column) -> Column:
    """Whether 3 divides the crc32 of the decimal id; never for a null id."""
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("long").cast("string")), F.lit(3)) == 0, F.lit(False))
