"""The pipeline's stages on generated tables: columns stay, decisions take effect."""

import collections
import random
import re

import corpus_pipeline
import public_tokenizers
import pyarrow as pa
from pyspark.sql import functions as F

from corpusmill.llm import mixing, packing

DATA = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").cache()
    columns, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, DATA).cache()
        assert docs.columns == columns, name
        counts.append(docs.count())
    assert counts[1] < counts[0] and counts[2] < counts[1] and counts[3] == counts[2] and counts[4] != counts[3]
    pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA).toPandas()
    assert (pieces.groupby("doc_id").length.sum() % pieces.groupby("doc_id").doc_tokens.first() == 0).all()
    assert set(pieces.doc_id) == {r["doc_id"] for r in docs.select("doc_id").collect()}


def test_mixture_follows_the_decision_of_each_row(spark):
    rows = [(i if i % 4 else None, " ".join(["w"] * (5 + i % 7)), "abc"[i % 3]) for i in range(120)]
    rows += [(i, " ".join(["v"] * (20 + i % 5)), "abc"[(i + 1) % 3]) for i in range(1, 60)]  # ids in two sources
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    wanted = collections.Counter()
    for r in mixing.mix(docs).collect():
        wanted[(r["doc_id"], r["source"], r["size"])] += r["copies"]
    got = collections.Counter((r["doc_id"], r["source"], len(r["text"].split())) for r in corpus_pipeline.mixture(spark, docs, DATA).collect())
    assert got == +wanted


CLASHES = ["_id", "_size", "_source", "_n", "_copies", "_copy", "_h", "_s", "_key", "_hash", "copy", "spans", "words", "size", "score", "kept", "node", "part", "row_key", "doc_key", "certain", "place"]


def odd_docs(spark, n):
    rng = random.Random(31)
    vocabulary = ["".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(300)]
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([4, 60, 90]))) for _ in range(30)]
    texts += [texts[1], texts[2] + " x", "", None, " \n ", texts[3] + "\n" + texts[4], " ".join(rng.choices(vocabulary, k=4000))]
    rows = [(i, t, "en", [None, "a", "b"][i % 3], len(t or "")) for i, t in enumerate(texts)]
    rows += [rows[1], (None, texts[5], None, None, 1), (None, texts[6], None, None, 1), (3, "another text of id three " + texts[7], "en", "a", 9)]
    df = spark.createDataFrame(rows[:n], "doc_id long, text string, lang string, source string, n_chars long")
    return df.withColumns({c: F.lit(7) for c in CLASHES})


def test_stages_take_odd_rows_and_clashing_columns(spark):
    for n in (1000, 0):
        docs = odd_docs(spark, n)
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, DATA)
            assert out.columns == docs.columns, name
            found = out.collect()
            assert all(r[c] == 7 for r in found for c in CLASHES), name
            assert bool(found) == bool(n) or name == "quality_rules", name
        pieces = corpus_pipeline.STAGES[-1][1](spark, docs, DATA)
        assert pieces.count() == (docs.count() and pieces.count()) and pieces.filter("length < 1").count() == 0


def test_near_duplicates_and_passages_against_brute_force(spark):
    docs = odd_docs(spark, 1000)
    rows = [(r["doc_id"], r["text"] or "") for r in docs.collect()]

    def shingles(t):
        w = t.lower().split()
        return frozenset([tuple(w)] if len(w) < 5 else zip(*(w[k:] for k in range(5))))

    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))
    for _ in rows:  # repeated until roots settle; the table is small
        for i in range(len(rows)):
            for j in range(i):
                if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]) and root[i] != root[j]:
                    low, high = sorted((root[i], root[j]))
                    root = [low if x == high else x for x in root]
    kept = corpus_pipeline.near_duplicates(spark, docs, DATA).collect()
    groups = {frozenset(rows[i] for i in range(len(rows)) if root[i] == g) for g in set(root)}
    assert len(kept) == len(groups) and all(sum((r["doc_id"], r["text"] or "") in g for r in kept) == 1 for g in groups)

    first = {}
    for i, t in sorted(rows, key=lambda r: -1 if r[0] is None else r[0]):
        w = t.split()
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), -1 if i is None else i)
    want = collections.Counter()
    for i, t in rows:
        w = t.split()
        gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < (-1 if i is None else i) for x in range(13)}
        want[(i, " ".join(x for k, x in enumerate(w) if k not in gone))] += 1
    got = corpus_pipeline.repeated_passages(spark, docs, DATA).collect()
    assert collections.Counter((r["doc_id"], " ".join((r["text"] or "").split())) for r in got) == want
    assert all(r["n_chars"] == len(r["text"] or "") for r in got)


def test_a_worker_gives_back_what_encoding_took():
    """Workers outlive the stage that encodes, beside the executor's heap; the encoder stays, its working memory does not."""

    def held():
        with open("/proc/self/smaps_rollup") as f:
            return sum(map(int, re.findall(r"Pss_Anon:\s+(\d+)", f.read()))) / 1024

    def encode(n):
        text = " ".join(f"word{i}" for i in range(2000))
        batch = pa.RecordBatch.from_pydict({"doc_key": pa.array(range(n), pa.int64()), "text": [text] * n})
        return sum(b.num_rows for b in packing.digests(iter([batch]), public_tokenizers.path("byte_bpe_50k.json"), 2048))

    assert encode(1) > 0  # the encoder is loaded and knows the words
    before = held()
    assert encode(1200) > 0
    assert held() - before < 30
    assert sum(b.num_rows for b in packing.digests(iter([pa.RecordBatch.from_pydict({"doc_key": pa.array([], pa.int64()), "text": pa.array([], pa.string())})]), public_tokenizers.path("byte_bpe_50k.json"), 2048)) == 0
