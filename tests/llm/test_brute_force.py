"""Whole results of operators that SQL cannot express against plain Python on small inputs."""

import collections
import math
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
import xxhash
from tokenizers import Tokenizer

from corpusmill.llm import output, packing, quality_rules, sharding, site_quality, tokens

BYTES, LOWER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")


def split(t):
    return [w for w in (t or "").replace("\t", " ").replace("\n", " ").split(" ") if w]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(21)
    vocabulary = ["".join(rng.choices("abcdefghié", k=rng.randint(2, 9))) for _ in range(150)]
    texts = ["\n".join(" ".join(rng.choices(vocabulary, k=rng.randint(0, 30))) for _ in range(rng.randint(1, 6))) for _ in range(60)]
    texts += ["", None, "\n", "a\n\nb", "日本\n語 x", texts[3], "é ́\nx"]
    out = [(i, t, ["a", "b", None][i % 3], f"p{i % 5}") for i, t in enumerate(texts)]
    return [*out, out[4], (None, texts[5], "a", None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string, source string, path string").repartition(3)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 4 > 0), int(i % 9 == 0)) for i in range(50)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")


@pytest.mark.parametrize("rule", tokens.RULES)
def test_section_tokens(docs, rows, rule):
    tokenizer = Tokenizer.from_file(BYTES)
    wanted = collections.Counter()
    for doc_id, text, *_ in rows:
        text = text or ""
        lines, at = [], 0
        for line in text.split("\n"):
            lines.append((at, min(at + len(line) + 1, len(text))))
            at += len(line) + 1
        if len(lines) > 1 and lines[-1][0] >= len(text):
            lines.pop()
        starts = [o[0] for o in tokenizer.encode(text, add_special_tokens=False).offsets]
        share = [0.0] * len(lines)
        for i, b in enumerate(starts):
            e = starts[i + 1] if i + 1 < len(starts) else len(text)
            e = max(e, min(b + 1, len(text)))
            over = [max(0, min(e, hi) - max(b, lo)) for lo, hi in lines]
            if rule == "start":
                share[next(k for k, (lo, hi) in enumerate(lines) if lo <= b < hi)] += 1
            elif rule == "majority":
                share[over.index(max(over))] += 1
            else:
                share = [s + o / (e - b) for s, o in zip(share, over)]
        for k, (lo, hi) in enumerate(lines):
            wanted[(doc_id, k, lo, hi, round(share[k], 6), len(starts))] += 1
    got = tokens.section_tokens(docs, BYTES, rule).collect()
    assert collections.Counter((r["doc_id"], r["section_no"], r["start_char"], r["end_char"], round(r["n_tokens"], 6), r["doc_tokens"]) for r in got) == wanted


def test_quality_score_and_verdict(docs, labels, rows):
    buckets = 512

    def signed(h):
        return h - 2**64 if h >= 2**63 else h

    def grams(text):
        w = [x.encode() for x in split(text)]
        one = [xxhash.xxh64_intdigest(x, 42) for x in w]
        two = [xxhash.xxh64_intdigest(b, h) for h, b in zip(one, w[1:])]
        return [signed(h) % buckets for h in one + two]

    trusted = {i for i in range(50) if i % 4 and i % 9}
    raw, target = collections.Counter(), collections.Counter()
    for doc_id, text, *_ in rows:
        raw.update(grams(text))
        if doc_id in trusted:
            target.update(grams(text))
    n, m = sum(raw.values()) + buckets, sum(target.values()) + buckets
    ratio = [math.log((target[b] + 1) / m) - math.log((raw[b] + 1) / n) for b in range(buckets)]
    for r in quality_rules.quality_rules(docs, labels, buckets=buckets).collect():
        g = grams(r["text"])
        score = sum(ratio[b] for b in g) / len(g) if g else 0.0
        assert abs(r["score"] - score) < 1e-5
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)


def test_site_posteriors(docs, labels, rows):
    got = site_quality.site_quality(docs, labels, "source", "path").toPandas()
    assert len(got) == len(rows)
    got["chance"] = 1 / (1 + np.exp(-got.evidence))
    got = got.fillna({"host": "none", "path": "none"})

    def strength(rates):
        m, v = np.mean(rates), np.var(rates)
        return min(1e4, max(1.0, m * (1 - m) / v - 1 if v else 1e4))

    host, path = got.groupby("host").chance.agg(["sum", "count"]), got.groupby(["host", "path"]).chance.agg(["sum", "count"])
    rate = host["sum"].sum() / host["count"].sum()
    outer, inner = strength(host["sum"] / host["count"]), strength(path["sum"] / path["count"])
    for r in got.itertuples():
        h, p = host.loc[r.host], path.loc[(r.host, r.path)]
        host_rate = (h["sum"] + outer * rate) / (h["count"] + outer)
        path_rate = (p["sum"] + inner * host_rate) / (p["count"] + inner)
        assert abs(r.host_rate - host_rate) < 1e-9 and abs(r.path_rate - path_rate) < 1e-9
        assert abs(r.score - 1 / (1 + math.exp(-(r.evidence + math.log(path_rate / (1 - path_rate)))))) < 1e-9 and r.kept == (r.score >= 0.5)


def test_site_quality_of_repeated_rows(spark, labels, rows):
    twice = spark.createDataFrame(rows + rows, "doc_id long, text string, source string, path string")
    got = site_quality.site_quality(twice, labels, "source", "path").toPandas()
    assert len(got) == 2 * len(rows) and got.groupby(["doc_id", "host", "path"], dropna=False).score.nunique().max() == 1


def test_shards(spark, rows):
    texts = [(i, "one hot text " * 9 if i % 3 == 0 else f"twin {i // 4}" if i % 3 == 1 else f"own text {i} " * (1 + i % 7), "x") for i in range(3000)]
    texts += [(r[0], r[1], "y") for r in rows]
    docs = spark.createDataFrame(texts, "doc_id long, text string, shard string").repartition(4)
    got = sharding.shard(docs).toPandas()
    want = collections.Counter(((-1 if i is None else i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _ in texts)
    assert collections.Counter(zip(got.doc_id.fillna(-1).astype(int), got["size"], got.text_crc32)) == want
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    shares = got.groupby("shard")["size"].sum()
    assert len(shares) == 8 and shares.max() / shares.min() < 1.1
    spread = got.groupby("text_crc32").agg(bytes=("size", "sum"), shards=("shard", "nunique"))
    small = spread.bytes <= 0.04 * shares.sum() / 8
    assert (spread[small].shards == 1).all() and spread[~small].shards.max() > 1  # both sides of the tolerance
    again = sharding.shard(docs.repartition(7)).toPandas()
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert collections.Counter(map(tuple, got[key].fillna(-1).values)) == collections.Counter(map(tuple, again[key].fillna(-1).values))


def test_shards_keep_groups_that_ranges_cut(spark):
    """Groups of 3.6 % of a shard, over a range's share, stay whole; rows equal in text and id are cut when they are a third."""
    rows = [(230 * j + i, f"group {i:03d} " + "w" * 25, "x") for i in range(230) for j in range(20)]
    got = sharding.shard(spark.createDataFrame(rows, "doc_id long, text string, x string").repartition(3)).toPandas()
    assert (got.groupby("text_crc32").shard.nunique() == 1).all()
    shares = got.groupby("shard")["size"].sum()
    assert len(shares) == 8 and shares.max() / shares.min() < 1.2

    rows = [(None, None)] * 900 + [(None, "hot and equal")] * 400 + [(i, f"own {i}") for i in range(1400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got, again = (sharding.shard(docs.repartition(k), shards=4).toPandas() for k in (2, 5))
    shares = got.groupby("shard")["size"].sum()
    assert len(got) == len(rows) and len(shares) == 4 and shares.max() / shares.min() < 1.1
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    key = ["doc_id", "size", "text_crc32", "shard", "slot"]
    assert collections.Counter(map(tuple, got[key].fillna(-1).values)) == collections.Counter(map(tuple, again[key].fillna(-1).values))


def test_steps_are_balanced(spark):
    rng = random.Random(3)
    pieces = [(i, 0, rng.choice([5, 60, 200, 300, 700, 1500, 2048]), i, 1) for i in range(6000)]
    df = spark.createDataFrame(pieces, "doc_key long, start long, length int, ids_crc32 long, doc_tokens long")
    got = packing.pack(df, step_tokens=1 << 17).toPandas()
    assert sorted(got.doc_key) == list(range(6000))
    sums = got.groupby("step_id").length.sum()
    assert len(sums) == -(-got.length.sum() // (1 << 17)) and sums.max() - sums.min() <= 4 * 2048
    windows = got.drop_duplicates("sequence_id").groupby(["step_id", "window"]).size().unstack(fill_value=0)
    assert (windows.max() - windows.min()).max() <= 2  # every step holds a like mixture of window sizes


def test_orc_prunes_by_id(spark, docs, rows, tmp_path):
    path = f"{tmp_path}/orc"
    output.write_token_orc(docs, path, LOWER)
    some = output.read_token_orc(spark, path, [7, 11])
    plan = some._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [In(doc_key, [" in plan
    tokenizer = Tokenizer.from_file(LOWER)
    assert {r["doc_id"]: list(r["ids"]) for r in some.collect()} == {i: tokenizer.encode(rows[i][1], add_special_tokens=False).ids + [1] for i in (7, 11)}
    first = [(r["low"], r["high"]) for r in spark.read.orc(path).groupBy("part").agg({"doc_key": "min"}).withColumnRenamed("min(doc_key)", "low").join(spark.read.orc(path).groupBy("part").agg({"doc_key": "max"}).withColumnRenamed("max(doc_key)", "high"), "part").orderBy("part").collect()]
    assert all(a[1] <= b[0] for a, b in zip(first, first[1:]))  # parts hold ascending ranges
