"""Brute force on a small fixture with nulls, blanks, copies, near copies, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pandas as pd
import public_tokenizers
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from corpusmill.llm import chunks, components, fmindex, mixing, output, packing, quality_rules, sharding, simhash, site_quality, substrings, tokens, vptree

BYTES, LOWER = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size long, score double, kept boolean, words string, shard int"


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(1)
    vocabulary = ["".join(rng.choices("abcdefghiéß", k=rng.randint(2, 9))) for _ in range(400)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    texts = [" ".join(rng.choices(vocabulary, k=rng.choice([3, 20, 80, 300]))) for _ in range(40)]
    texts += [texts[1], texts[1], texts[2] + " x", texts[3].upper() + ".\n" + texts[4], passage + "\n" + texts[5], texts[6] + " " + passage]
    texts += ["", " \n ", None, "a", "one\ttwo  three\x0bfour", "x " * 200, "same line here\nsame line here\n", " ".join(rng.choices(vocabulary, k=6000)), "# $ % & | < > *"]
    out = [(i, t, "en", [None, "a", "b", "c", "hot"][min(i % 9, 4)], len(t or ""), 7, 0.5, True, "w", 3) for i, t in enumerate(texts)]
    return [*out, out[1], (None, texts[7], None, "a", 1, None, None, None, None, None), (5, "another text with an old id", "en", "b", 1, 1, 1.0, False, "", 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 3 and 1, 1 if i % 11 == 0 else 0) for i in range(0, 50, 2)] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


def test_chunks_equal_whole_texts(rows):
    odd = ["", " ", "  a  b ", "a\n b", "\n", "x  ", "<|endoftext|> a <|endoftext|>", "日本 é́  b", "a \x1c b \x85 c", " 22's it's", "Σ ΟΣ x", "́ a ́b", "İ I x"]
    texts = odd + [r[1] or "" for r in rows]
    for path, byte_level in ((BYTES, True), (LOWER, False)):
        encoder = chunks.ChunkEncoder(path, byte_level, starts=byte_level, limit=50)
        whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        for _ in range(2):
            assert [x.tolist() for x in encoder.encode(texts)] == [e.ids for e in whole]
        if byte_level:
            assert [x.tolist() for x in encoder.token_starts(texts)] == [[o[0] for o in e.offsets] for e in whole]


def test_chunks_equal_whole_texts_of_odd_characters():
    rng = random.Random(4)
    pool = [*"aAbZéÉßİIıΣσς.,;'|!0123\n\n    \t\r\x0b\x1c\x85\xa0\x00\x01", "\u0301", "\u0323", "\u2003", "\u3000", "日", "<|endoftext|>", "'s", "foo", "ｈ", "—", "ǅ", "\u212b", "각", "🙂"]
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 14))) for _ in range(4000)] + ["".join(rng.choices("aAbZéß.,' \n", k=rng.randint(0, 40))) for _ in range(2000)]
    texts += ["\u0130\u0323 x", "A\u0130\u0301 x"]  # lower-casing before normalising would change these
    for path, byte_level in ((BYTES, True), (LOWER, False)):
        encoder = chunks.ChunkEncoder(path, byte_level, starts=byte_level, limit=1000)
        whole = encoder.tokenizer.encode_batch(texts, add_special_tokens=False)
        for i in range(0, len(texts), 500):
            part, want = texts[i : i + 500], whole[i : i + 500]
            assert [x.tolist() for x in encoder.encode(part)] == [e.ids for e in want]
            if byte_level:
                assert [x.tolist() for x in encoder.token_starts(part)] == [[o[0] for o in e.offsets] for e in want]


def test_encoding_comes_in_bounded_parts_and_keeps_common_chunks():
    rng = random.Random(6)
    common = ["the", "of", "und", "straße,"]
    texts = [" ".join([*common, *("".join(rng.choices("abcdefgéß", k=7)) for _ in range(rng.randint(0, 30)))]) for _ in range(300)]
    texts += ["", " ".join(texts[:40]), "\u0130 A\u0301"]
    for path, byte_level in ((BYTES, True), (LOWER, False)):
        encoder = chunks.ChunkEncoder(path, byte_level, limit=200)
        want = [e.ids for e in encoder.tokenizer.encode_batch(texts, add_special_tokens=False)]
        got, calls = [], []
        array = pa.array(["outside", *texts]).slice(1)
        for begin, end in chunks.array_batches(array, 2000):
            assert end - begin == 1 or sum(len(t.encode()) for t in texts[begin:end]) <= 2000
            for lo, hi, ids, ends in encoder.encode_parts(array.slice(begin, end - begin), most=150):
                assert hi - lo == 1 or len(ids) <= 150
                got += [ids[a:b].tolist() for a, b in zip(ends[:-1], ends[1:])]
            calls.append(encoder.numbered)
        assert got == want and min(calls[1:]) < 200 < max(calls)
        encoder = chunks.ChunkEncoder(path, byte_level)
        for i in range(0, 300, 60):
            encoder.encode(texts[i : i + 60])
        encoder.limit = 200
        encoder._forget()
        assert len(encoder.number) + len(encoder.first_number) == encoder.numbered <= 100 and {*common[1:]} <= {*encoder.number}
        assert [x.tolist() for x in encoder.encode(texts)] == want


def test_section_tokens(docs, none, rows):
    for rule in tokens.RULES:
        got = tokens.section_tokens(docs, BYTES, rule).toPandas()
        assert abs(got.n_tokens.sum() - sum(d for d in got.drop_duplicates(["doc_id", "doc_tokens"]).doc_tokens) - got[(got.doc_id == 1) & (got.section_no == 0)].doc_tokens.iloc[0]) < 1e-6
        assert (got.groupby(["doc_id", "doc_tokens"]).n_tokens.sum().round(6) % 1 == 0).all()
    assert tokens.section_tokens(none, BYTES).count() == 0
    shares, whole, touched = tokens.attribute(np.array([[0, 2], [2, 5], [5, 7]]), np.array([[0, 3], [3, 7]]), "majority")
    assert shares.tolist() == [1, 2] and whole.tolist() == [1, 1] and touched.tolist() == [1, 1]
    assert tokens.attribute(np.array([[0, 4]]), np.array([[0, 2], [2, 4]]), "majority")[0].tolist() == [1, 0]


def test_nearest(spark):
    rng = np.random.default_rng(3)
    v = rng.normal(size=(600, 16))
    v[100:140] = v[50]
    rows = [(i, x.tolist()) for i, x in enumerate(v)] + [(700, None), (701, [0.0] * 16), (702, [float("nan")] * 16), (703, [None] * 16), (704, [1.0, 2.0]), (705, [2.0, 4.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    hits = 0
    for factor, least in ((1.0, 1.0), (0.16, 0.9)):
        got = vptree.nearest(df, df.filter("vec_id % 50 = 0 or vec_id > 700"), k=5, factor=factor, shard_rows=200).toPandas()
        assert got[got.query_id == 704].vec_id.tolist() == [705] and not set(got.query_id) & {700, 701, 702, 703}
        hits = 0
        for q in range(0, 600, 50):
            s = np.round(unit @ unit[q], 12)
            s[q] = -9
            best = np.lexsort((np.arange(600), -s))[:5]
            mine = got[got.query_id == q].sort_values("rank")
            hits += len(set(best) & set(mine.vec_id))
            if factor == 1:
                assert mine.vec_id.tolist() == best.tolist()
        assert hits >= least * 60
    assert vptree.nearest(df.limit(0), df.limit(0)).count() == 0


@pytest.mark.parametrize("dim", [16, 64])
def test_recall_is_measured(spark, tmp_path, dim):
    """The factor follows the vectors: recall over all queries keeps to what was wanted in few and many dimensions."""
    rng = np.random.default_rng(dim)
    v = rng.normal(size=(20000, dim))
    pd.DataFrame({"vec_id": np.arange(20000), "embedding": list(v)}).to_parquet(f"{tmp_path}/vectors.parquet")
    df = spark.read.parquet(f"{tmp_path}/vectors.parquet")
    got = vptree.nearest(df, df.filter("vec_id % 100 = 0"), recall=0.95).toPandas()
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    scores = unit[::100] @ unit.T
    scores[np.arange(200), np.arange(0, 20000, 100)] = -9
    best = np.argsort(-scores, axis=1)[:, :5]
    mine = got.groupby("query_id").vec_id.apply(set)
    recall = sum(len(set(b) & mine[100 * i]) for i, b in enumerate(best)) / 1000
    assert len(got) == 1000 and recall >= 0.93 and got.sample_recall.iloc[0] >= 0.95 and got.factor.nunique() == 1
    if dim == 16:
        given = vptree.nearest(df, df.filter("vec_id % 100 = 0"), factor=0.16)
        assert given.filter("sample_recall is not null").isEmpty() and got.factor.iloc[0] > 0.16


def test_nearest_of_repeated_rows(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, x.tolist()) for i, x in enumerate(rng.normal(size=(120, 8)))]
    rows += [rows[50], rows[50], rows[16], (50, rng.normal(size=8).tolist())]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    results = []
    for most in (vptree.MOST_BROADCAST, 0):
        monkeypatch.setattr(vptree, "MOST_BROADCAST", most)
        got = vptree.nearest(df, df.filter("vec_id % 50 = 0"), factor=1.0, shard_rows=40, block_rows=2)
        results.append(sorted(map(tuple, got.collect())))
    assert results[0] == results[1]
    got = got.toPandas()
    assert got.groupby("query_id").size().to_dict() == {0: 5, 50: 10, 100: 5}  # two different vectors bear id 50
    v = np.array([r[1] for r in rows[:120]])
    unit = v / np.linalg.norm(v, axis=1, keepdims=True)
    best = [i for i in np.argsort(-(unit @ unit[50])) if i != 50][:5]
    assert all(((got.query_id == 50) & (got["rank"] == r + 1) & (got.vec_id == i)).any() for r, i in enumerate(best))


def test_packing(docs, none, rows):
    got = packing.pack_documents(docs, BYTES).toPandas()
    tokenizer = Tokenizer.from_file(BYTES)
    wanted = collections.Counter()
    for r in rows:
        ids = np.array(tokenizer.encode(r[1] or "", add_special_tokens=False).ids + [1], "<u4")
        for s in range(0, len(ids), 2048):
            wanted[(r[0], s, zlib.crc32(ids[s : s + 2048].tobytes()))] += 1
    mine = collections.Counter((None if np.isnan(r.doc_id) else int(r.doc_id), r.start, r.ids_crc32) for r in got.itertuples())
    assert mine == wanted
    got = got.sort_values(["sequence_id", "offset"])
    assert ((got.groupby("sequence_id").length.cumsum() - got.length) == got.offset).all()
    assert got.groupby("sequence_id").length.sum().max() <= 2048
    assert sorted(got.sequence_id.unique()) == list(range(got.sequence_id.nunique()))
    assert packing.pack_documents(none, BYTES).count() == 0
    sequences = packing.packed_sequences(docs, BYTES).toPandas()
    assert sequences.ids.map(len).sum() == got.length.sum()


def test_pieces_reuse_the_workers_encoder(monkeypatch):
    class Rows:
        def mapInArrow(self, run, schema):
            return run

    made = []
    monkeypatch.setattr(output, "ChunkEncoder", lambda *a, **b: made.append(a) or chunks.ChunkEncoder(*a, **b))
    output.encoder_of.cache_clear()
    run = packing.encode_digests(Rows(), BYTES, 7)
    texts = ["", "one two, three\n four", "Zwei  Wörter. " * 9, "a b c d e f", " x" * 70]
    tokenizer = Tokenizer.from_file(BYTES)
    for task in ([texts[:2], texts[2:]], [texts[::-1], []]):
        batches = [pa.record_batch([pa.array(range(len(t)), pa.int64()), pa.array(t, pa.string())], names=["doc_key", "text"]) for t in task]
        got = [tuple(r.values()) for b in run(iter(batches)) for r in b.to_pylist()]
        want = []
        for t in task:
            for key, text in enumerate(t):
                ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
                want += [(key, s, len(ids[s : s + 7]), zlib.crc32(ids[s : s + 7].tobytes()), len(ids)) for s in range(0, len(ids), 7)]
        assert got == want
    assert len(made) == 1
    output.encoder_of.cache_clear()


def test_plan_fills_windows():
    rng = random.Random(5)
    histogram = collections.Counter(rng.randint(1, 2048) for _ in range(20000))
    plan = packing.plan_tiers(histogram)
    total = sum(k * v for k, v in histogram.items())
    sums = collections.Counter()
    for length, _, n, first, per, _, _ in plan:
        for s in range(n // per):
            sums[first + s] += length * per
    assert sum(sums.values()) == total and max(sums.values()) <= 2048
    assert sum(2048 - x for x in sums.values() if x & (x - 1)) < 0.01 * total


def small_fingerprint(t):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    s = [" ".join(w[k : k + 4]) for k in range(len(w) - 3)] if len(w) >= 4 else ([" ".join(w)] if w else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(s))


def test_simhash_groups(docs, none, rows):
    prints = [(-1 if r[0] is None else r[0], small_fingerprint(r[1])) for r in rows]
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if bin(prints[i][1] ^ prints[j][1]).count("1") <= 4:
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 10**9)
    for i, (doc, _) in enumerate(prints):
        least[find(i)] = min(least[find(i)], doc)
    wanted = collections.Counter((d, f"{f:016x}", least[find(i)]) for i, (d, f) in enumerate(prints))
    got = simhash.simhash_groups(docs, 4, 4).fillna(-1).collect()
    assert collections.Counter(map(tuple, got)) == wanted
    assert simhash.simhash_groups(none).count() == 0


def test_forest_connects_what_pairs_connect():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 2**32, 8, dtype=np.uint64)
    members = np.unique(np.concatenate([b ^ (np.uint64(1) << rng.integers(0, 32, 60, dtype=np.uint64)) for b in base]))
    a, b = simhash.forest(members, 4)
    assert len(a) == len(members) - 8


def test_every_choice_of_shared_bytes_is_covered():
    for bits in range(1, 8):
        for width in range(1, 9 - bits):
            lists = [set(c) for c in simhash.covering(bits, width)]
            for shared in itertools.combinations(range(8), 8 - bits):
                assert any(c <= set(shared) for c in lists)


def test_links_are_the_same_at_every_width(spark):
    rng = np.random.default_rng(8)
    base = rng.integers(0, 2**63, 200, dtype=np.uint64)
    near = [b ^ np.bitwise_or.reduce(np.uint64(1) << rng.choice(64, k, replace=False).astype(np.uint64)) for b in base for k in (2, 4, 5)]
    hot = (np.uint64(0xABCD) << np.uint64(48)) | rng.integers(0, 2**47, 300, dtype=np.uint64)  # long lists of two bytes
    fp = np.unique(np.concatenate([base, near, hot]).view(np.int64))
    differ = np.bitwise_count((fp[:, None] ^ fp[None, :]).view(np.uint64))
    want = grouped_by_pairs(fp.tolist(), [(int(fp[a]), int(fp[b])) for a, b in np.argwhere(differ <= 4) if a < b])
    df = spark.createDataFrame([(int(x),) for x in fp], "fp long")
    for width in (1, 2, 3, 4):
        edges = [(r["u"], r["v"]) for r in simhash.links(df, 4, width).collect()]
        assert grouped_by_pairs(fp.tolist(), edges) == want


def test_near_dedup_keeps_one_of_similar_texts(spark):
    rng = random.Random(2)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    base = [rng.choices(vocabulary, k=300) for _ in range(20)]
    rows = []
    for i, w in enumerate(base):
        rows.append((3 * i, " ".join(w)))
        near = list(w)
        for at in rng.sample(range(300), 5):  # about 25 of 296 shingles: similarity 0.84
            near[at] = "changed"
        rows.append((3 * i + 1, " ".join(near)))
    rows += [(1000, rows[0][1]), (0, rows[0][1]), (2000, None), (2001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = sorted(r["doc_id"] for r in simhash.near_dedup(df).collect())
    assert kept == [3 * i for i in range(20)] + [2000]


def test_near_dedup_keeps_one_row_of_each_group_without_ids(spark):
    rng = random.Random(8)
    texts = [" ".join("".join(rng.choices("abcdefgh", k=6)) for _ in range(100)) for _ in range(12)]
    rows = [(None, t) for t in texts[:8]] + [(None, texts[0]), (10, texts[0]), (11, texts[1]), (12, texts[1])]
    rows += [(5, texts[8]), (5, texts[9]), (6, texts[9]), (5, texts[10]), (4, texts[10]), (7, texts[11])]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    kept = sorted(((r["doc_id"] or 0), texts.index(r["text"])) for r in simhash.near_dedup(df).collect())
    assert kept == [(0, i) for i in range(8)] + [(4, 10), (5, 8), (5, 9), (7, 11)]


def grouped_by_pairs(nodes, near):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def similarities(texts):
    sets = {i: set(zip(*(words(t.lower())[k:] for k in range(5)))) for i, t in texts.items()}
    return {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a in sets for b in sets if a < b}


def test_near_groups_of_a_template_family(spark, monkeypatch):
    """Texts of one template are about 0.6 alike and share posting lists; only each one's near copy is a link."""
    rng = random.Random(6)
    vocabulary = ["".join(rng.choices("abcdefgh", k=6)) for _ in range(2000)]
    template, texts = rng.choices(vocabulary, k=300), {}
    for i in range(0, 160, 2):
        mine = list(template)
        at = rng.randrange(220)
        mine[at : at + 60] = rng.choices(vocabulary, k=60)
        texts[i] = " ".join(mine)
        mine[rng.randrange(280)] = "changed"
        texts[i + 1] = " ".join(mine)
    pairs = similarities(texts)
    want = grouped_by_pairs(texts, [p for p, j in pairs.items() if j >= 0.8])
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    for small, block in ((16, 2048), (2, 30), (1000, 2048)):
        monkeypatch.setattr(simhash, "SMALL_LIST", small)
        monkeypatch.setattr(simhash, "FAMILY_BLOCK", block)
        got = {r["doc_key"]: r["first_key"] for r in simhash.near_groups(df).collect()}
        assert got == want


def test_near_groups_against_all_pairs(spark):
    """Recall of links at 0.8, and no group without one, on generated documents."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    texts = {r["doc_id"]: r["text"] for r in docs.collect() if len(words(r["text"])) >= 5}
    pairs = [p for p, j in similarities(texts).items() if j >= 0.8]
    want = grouped_by_pairs(texts, pairs)
    got = {r["doc_key"]: r["first_key"] for r in simhash.near_groups(docs).collect()}
    assert all(want[d] == want[f] for d, f in got.items() if d in want)  # nothing joins that pairs do not join
    assert sum(got[a] == got[b] for a, b in pairs) >= 0.98 * len(pairs)


def test_posting_lists_read_in_batches(spark):
    rng = np.random.default_rng(9)
    wide = [bytes(128) if i % 3 else rng.integers(0, 256, 128, dtype=np.uint8).tobytes() for i in range(60)]
    df = spark.createDataFrame(list(enumerate(wide)), "node long, wide binary").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = simhash.posting_lists(df, simhash.choices_for(60)[:5]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    zero = [i for i in range(60) if i % 3]
    assert sorted({(r["a"], r["b"]) for r in rows if r["kind"] == simhash.LED}) == [(zero[0], i) for i in zero[1:]]
    lists = collections.defaultdict(list)
    for r in rows:
        if r["kind"] == simhash.MEMBER:
            lists[r["a"]].append(r["b"])
    assert len(lists) == 5 and all(sorted(x) == zero for x in lists.values())
    assert not [r for r in rows if r["kind"] == simhash.PAIR]


@pytest.mark.parametrize("batch", [1, 2, 3, 1000])
def test_lists_of_two(spark, batch):
    wide = [bytes([i // 2] * 128) for i in range(20)] + [bytes([200] * 128)] * 3 + [bytes([250] * 128)]
    df = spark.createDataFrame(list(enumerate(wide)), "node long, wide binary").repartition(2)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(batch))
    try:
        rows = simhash.posting_lists(df, simhash.choices_for(60)[:2]).collect()
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    by = collections.Counter((r["kind"], r["b"] if r["kind"] == simhash.MEMBER else (r["a"], r["b"])) for r in rows)
    want = {(simhash.PAIR, (i, i + 1)): 2 for i in range(0, 20, 2)} | {(simhash.LED, (20, i)): 2 for i in (21, 22)} | {(simhash.MEMBER, i): 2 for i in (20, 21, 22)}
    assert by == want


def test_near_copies_cost_one_pair_each(spark, monkeypatch):
    """A group of some thousand near copies, each in more than a hundred lists, is verified by a few pairs a member."""
    rng = random.Random(12)
    base = [f"w{rng.randint(0, 5000)}" for _ in range(400)]
    texts = []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randint(0, 4)):
            w[rng.randrange(400)] = f"x{rng.randint(0, 10**6)}"
        texts.append((i, " ".join(w)))
    asked, whole = [], simhash.verified

    def counted(pairs, *rest):
        asked.append(pairs.count())
        return whole(pairs, *rest)

    monkeypatch.setattr(simhash, "verified", counted)
    groups = simhash.near_groups(spark.createDataFrame(texts, "doc_id long, text string")).toPandas()
    assert set(groups.first_key) == {0}
    assert asked[0] <= 6 * 2000 and sum(asked) <= 14 * 2000  # of each member in turn with the leaders of its lists: over 100 * 2000


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 120)]
    got = {r["node"]: r["root"] for r in components.connected(spark.createDataFrame(edges, "u long, v long")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 120)}


def test_quality_rules(docs, none, labels, rows):
    got = quality_rules.quality_rules(docs, labels)
    assert got.columns[:5] == ["doc_id", "text", "lang", "source", "n_chars"]
    for r in got.collect():
        t, w = r["text"] or "", words(r["text"])
        triples = collections.Counter(zip(w, w[1:], w[2:]))
        covered = {k + x for k in range(len(w) - 2) if triples[tuple(w[k : k + 3])] > 1 for x in range(3)}
        lines = [x for x in t.split("\n") if words(x)]
        assert (r["n_words"], r["word_chars"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), len(covered))
        assert (r["n_symbols"], r["n_dup_lines"]) == (len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)))
        assert r["base_failed"] == (len(w) < 50 or 2 * len(covered) > len(w))
        assert r["kept"] == (not r["base_failed"] and r["score"] >= quality_rules.THRESHOLD)
    assert got.count() == len(rows)
    assert quality_rules.quality_rules(none, labels).count() == 0
    assert {r["score"] for r in quality_rules.quality_rules(docs, labels.limit(0)).collect()} == {0.0}


def test_strip_repeats(docs, none, rows):
    keyed = [(-1 if r[0] is None else r[0], words(r[1])) for r in rows]
    first = {}
    for i, w in sorted(keyed, key=lambda x: x[0]):
        for k in range(len(w) - 12):
            first.setdefault(tuple(w[k : k + 13]), i)
    wanted = collections.Counter()
    for i, w in keyed:
        gone = {k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(13)}
        kept = " ".join(x for k, x in enumerate(w) if k not in gone)
        wanted[(i, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest())] += 1
    got = substrings.strip_repeats(docs)
    assert collections.Counter(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept_sha256").fillna(-1).collect())) == wanted
    assert all(hashlib.sha256(" ".join(words(r["kept_text"])).encode()).hexdigest() == r["kept_sha256"] for r in got.collect())
    assert substrings.strip_repeats(none).count() == 0


def removed(rows):
    """Words that brute force removes of each ``(doc_id, text)``, by id."""
    first, out = {}, {}
    for i, t in sorted(rows):
        for k in range(len(words(t)) - 12):
            first.setdefault(tuple(words(t)[k : k + 13]), i)
    for i, t in rows:
        w = words(t)
        out[i] = len({k + x for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for x in range(13)})
    return out


def test_strip_repeats_of_other_spacing(spark):
    rng = random.Random(11)
    vocabulary = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 9))) for _ in range(400)]
    passage = rng.choices(vocabulary, k=40)
    texts = [" ".join(rng.choices(vocabulary, k=20)) + "\n" + gap.join(passage) for gap in (" ", "  ", "\r\n", "\n\n", "\n        ", "\t")]
    texts.append("".join(x + " " * rng.randint(1, 9) for x in passage))
    rows = list(enumerate(texts))
    got = substrings.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string"))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == removed(rows) == {0: 0} | {i: 40 for i in range(1, 7)}


def test_strip_repeats_bounds_an_index(spark, monkeypatch):
    rng = random.Random(12)
    vocabulary = ["".join(rng.choices("abcdefghi", k=rng.randint(2, 5))) for _ in range(300)]
    passage = ["".join(rng.choices("abcdefghi", k=30)) for _ in range(3)] + rng.choices(vocabulary, k=20)
    own = [rng.choices(vocabulary, k=30) for _ in range(300)]
    rows = [(i, " ".join(own[i] + passage)) for i in range(300)] + [(300 + i, " ".join(own[i][-6:] + passage)) for i in range(10)]
    search = substrings._search

    def bounded(pdf):
        if len(pdf) > 150:
            raise ValueError(f"{len(pdf)} segments in one index")
        return search(pdf)

    monkeypatch.setattr(substrings, "_search", bounded)
    monkeypatch.setattr(substrings, "SHARD_SEGMENTS", 40)
    monkeypatch.setattr(substrings, "ROUTE_SEGMENTS", 10, raising=False)
    got = substrings.strip_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(3))
    assert {r["doc_id"]: r["n_removed"] for r in got.collect()} == removed(rows)


def test_fm_index():
    rng = np.random.default_rng(4)
    parts = [rng.integers(0, 4, n).astype(np.uint32) for n in rng.integers(5, 60, 30)]
    lengths = np.array([len(p) for p in parts])
    index = fmindex.FMIndex(np.concatenate(parts), lengths)
    places = [(i, k) for i, p in enumerate(parts) for k in range(len(p) - 4)]
    count = collections.Counter(tuple(parts[i][k : k + 5]) for i, k in places)
    ends = np.array([index.starts[i] + k + 5 for i, k in places])
    length, lo, hi = index.matching_statistics(ends, 5, least=1)
    assert (length == 5).all() and (hi - lo).tolist() == [count[tuple(parts[i][k : k + 5])] for i, k in places]
    all_ends = [(i, k) for i, p in enumerate(parts) for k in range(1, len(p) + 1)]
    length, lo, hi = index.matching_statistics(np.array([index.starts[i] + k for i, k in all_ends]), 60)
    joined = [tuple(p) for p in parts]
    for (i, k), n, places_n in zip(all_ends, length, hi - lo):
        def occurs(m):
            return sum(joined[j][s : s + m] == joined[i][k - m : k] for j in range(len(joined)) for s in range(len(joined[j]) - m + 1))
        assert n and occurs(n) == places_n >= 2 and (n == k or occurs(n + 1) == 1)


def test_site_quality(docs, none, labels, rows):
    got = site_quality.site_quality(docs, labels, "source", "lang")
    assert got.count() == len(rows) and got.filter("score is null or kept is null").count() == 0
    assert site_quality.site_quality(none, labels, "source", "lang").count() == 0
    assert site_quality.site_quality(docs, labels.limit(0), "source", "lang").filter("not kept").count() == 0


def test_mixing(docs, none, rows):
    got = mixing.mix(docs).toPandas()
    assert len(got) == len(rows) and (got.taken <= 2 * got["size"]).all()
    sizes = collections.Counter()
    for r in rows:
        sizes[r[3]] += len(words(r[1]))
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None]
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, free, left = {}, set(order), 1.5 * sum(sizes.values())
    while True:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            break
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    target |= {s: level * weight[s] for s in free}
    for s in order:
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        assert abs(mine.target.iloc[0] - target[s]) < 1e-6 and mine.source_size.iloc[0] == sizes[s]
        assert abs(mine.taken.sum() - target[s]) <= mine["size"].max() / 2
    again = mixing.mix(docs.repartition(5)).toPandas()
    assert sorted(map(tuple, got.fillna(-1).values.tolist()), key=str) == sorted(map(tuple, again.fillna(-1).values.tolist()), key=str)
    assert mixing.mix(none).count() == 0


def test_mixing_of_null_and_repeated_ids(spark):
    """Rows without ids, rows of one id, and equal rows are drawn each on their own, so sums come near their targets."""
    rows = [(None, f"text {i} " + "w " * 8, "a") for i in range(400)]
    rows += [(i % 8, f"text {i} " + "w " * 8, "b") for i in range(400)]
    rows += [(None, "one hot text of exactly ten words it is all", "c")] * 400 + [(7, "same " * 10, "d")] * 300 + [(None, None, "e")] * 50
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    first, second = (mixing.mix(docs.repartition(n), share=0.4).toPandas() for n in (3, 6))
    for x in "abcd":
        mine = first[first.source == x]
        assert abs(mine.taken.sum() - mine.target.iloc[0]) <= 5 and mine.target.iloc[0] > 100
    key = ["size", "source", "target", "copies", "mark", "nth"]
    assert sorted(map(tuple, first[key].values.tolist())) == sorted(map(tuple, second[key].values.tolist()))
    assert sorted(first[first.source == "d"].nth) == list(range(300))


def test_mixing_odds_are_unequal(spark):
    rows = [(i, " ".join(["w"] * 10), "a", 4.0 if i % 2 else 1.0) for i in range(4000)] + [(5000, " ".join(["w"] * 10), "a", 1e6), (5001, "w w w", "a", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, importance double")
    got = mixing.mix(docs, share=0.4, importance=F.col("importance")).toPandas()
    n = {x: got[(got.doc_id < 4000) & (got.doc_id % 2 == x)].copies.sum() for x in (0, 1)}
    # chances in proportion: 1600 documents are wanted, so 0.16 and 0.64 of the two halves
    assert abs(n[0] - 320) < 60 and abs(n[1] - 1280) < 60 and abs(got.taken.sum() - got.target.iloc[0]) <= 5
    assert got[got.doc_id == 5000].copies.iloc[0] == 1 and got[got.doc_id == 5001].copies.iloc[0] == 0


def test_sharding(spark, docs, none, rows):
    got = sharding.shard(docs).toPandas()
    assert sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    for _, part in got.groupby("shard"):
        assert sorted(part.slot) == list(range(len(part)))
    assert sharding.shard(none).count() == 0
    many = spark.createDataFrame([(i, "one hot text" if i % 3 == 0 else f"text {i}" * (1 + i % 7)) for i in range(3000)], "doc_id long, text string")
    sums = sharding.shard(many).groupby("shard").sum("size").toPandas()["sum(size)"]
    assert len(sums) == 8 and sums.max() / sums.min() < 1.1


def test_token_orc(spark, docs, none, rows, tmp_path):
    path = f"{tmp_path}/tokens"
    output.write_token_orc(docs, path, LOWER)
    tokenizer = Tokenizer.from_file(LOWER)
    start, wanted = 0, []
    for i, text in sorted(((-1 if r[0] is None else r[0]), r[1] or "") for r in rows):
        ids = np.array(tokenizer.encode(text, add_special_tokens=False).ids + [1], "<u4")
        wanted.append((i, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    got = output.token_digest(spark, path).fillna(-1).collect()
    assert sorted((r["doc_id"], r["n_tokens"], r["ids_crc32"]) for r in got) == sorted(wanted)
    by_start = sorted(got, key=lambda r: r["start"])
    assert [r["doc_id"] for r in by_start] == [w[0] for w in wanted] and by_start[-1]["start"] + by_start[-1]["n_tokens"] == start
    assert [r["doc_id"] for r in output.read_token_orc(spark, path, [3]).collect()] == [3]
    output.write_token_orc(none, f"{path}-none", LOWER)
    assert output.token_digest(spark, f"{path}-none").count() == 0
