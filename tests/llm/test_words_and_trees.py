"""Language models, spelling variants and Merkle trees against plain Python, with nulls, ties, repeated rows and empty tables."""

import collections
import hashlib
import math
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpusmill.llm import language_id, merkle, spelling

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, word string, n long, tree string, place long, score double, size long"


def made(rng, parts, n):
    return " ".join("".join(rng.choices(parts, k=rng.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(8)
    kinds = {"aa": ["the", "ing", "or", "wh", "ed"], "bb": ["sch", "ung", "der", "ein", "ü"], "cc": ["ció", "ado", "que", "ñ", "os"]}
    texts = [(made(rng, kinds[k], rng.choice([2, 8, 60])), k) for _ in range(60) for k in kinds]
    texts += [(None, "aa"), ("", "bb"), ("123 -- 5²", "cc"), ("schungder " * 4000, "bb"), ("a" * 700 + " " + "a" * 701, "aa"), ("Ünge schung", None), ("日本語 の", "cc")]
    texts += [(f"colour color {w} {w}", "aa") for w in ("colours", "colours", "colour", "kolour", "kolour", "KOLOUR")]
    out = [(i, t, k, ["s", None, "hot"][i % 3], len(t or ""), "w", 1, "t", 2, 0.5, 3) for i, (t, k) in enumerate(texts)]
    return [*out, out[3], (None, texts[4][0], "aa", None, None, None, None, None, None, None, None), (5, "other text of a used id", None, "s", 1, "", 0, "", 0, 0.0, 0)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def kneser_ney(words, order, chars):
    """p(char | history) of one language by dictionaries."""
    count = [collections.Counter() for _ in range(order + 1)]
    for w, n in words.items():
        padded = "\x02" + w + "\x03"
        for e in range(1, len(padded)):
            count[min(e + 1, order)][padded[max(0, e - order + 1) : e + 1]] += n
    for k in range(order - 1, 0, -1):
        for g in {g[1:]: 0 for g in count[k + 1]}:
            count[k][g] = sum(1 for h in count[k + 1] if h[1:] == g)

    def discount(k):
        one, two = (sum(1 for n in count[k].values() if n == x) for x in (1, 2))
        return min(0.95, max(0.05, one / (one + 2 * two))) if one else 0.5

    d = [0] + [discount(k) for k in range(1, order + 1)]

    def p(history, c):
        k = len(history) + 1
        below = p(history[1:], c) if k > 1 else 1 / chars
        follow = {g: n for g, n in count[k].items() if g[:-1] == history}
        total = sum(follow.values())
        if not total:
            return below
        return max(follow.get(history + c, 0) - d[k], 0) / total + d[k] * len(follow) / total * below

    return p


def test_kneser_ney_against_dictionaries(spark):
    words = {"aa": {"the": 5, "then": 2, "hen": 1, "e": 3, "other": 1}, "bb": {"der": 4, "denn": 1, "über": 2}}
    df = spark.createDataFrame([(k, w, n) for k, v in words.items() for w, n in v.items()], "lang string, word string, n long")
    model = language_id.build(language_id.gram_counts(df).toPandas())
    chars = 1 + len(set("".join(w for v in words.values() for w in v)) | {"\x03"})
    tried = ["the", "thex", "über", "e", "ddd", "日", "rehto"]
    total, length = model.score_words(tried)
    assert length.tolist() == [len(w) + 1 for w in tried]
    for j, k in enumerate(model.languages):
        p = kneser_ney(words[k], language_id.ORDER, chars)
        for i, w in enumerate(tried):
            padded = "\x02" + w + "\x03"
            wanted = sum(math.log(p(padded[max(0, e - language_id.ORDER + 1) : e], padded[e])) for e in range(1, len(padded)))
            assert abs(total[i, j] - wanted) < 1e-4
        seen = sorted(set("".join(w for v in words.values() for w in v)) | {"\x03"}) + ["日"]
        for history in ("", "t", "th", "\x02th", "zz"):
            assert abs(sum(p(history, c) for c in seen) - 1) < 1e-9  # probabilities of a history add up


def test_language_of_held_out_texts(docs, none, rows):
    model = language_id.fit(docs.filter(~language_id.held_out(F.col("doc_id"))))
    assert model.languages == ["aa", "bb", "cc"]
    got = language_id.identify(docs, model).toPandas()
    assert len(got) == len(rows) and got.score.between(0, 1).all()
    letters = [(i, t, k) for i, t, k, *_ in rows if t and any(c.isalpha() for c in t)]
    blank = {i for i, t, *_ in rows if not (t and any(c.isalpha() for c in t))}
    assert set(got[got.lang_pred == "und"].doc_id) == blank
    assert (got[got.lang_pred == "und"].score == 0).all() and not got[got.lang_pred == "und"].accepted.any()
    truth = pd.DataFrame([(i, k) for i, t, k in letters if i is not None and i < 180 and zlib.crc32(str(i).encode()) % 3 == 1], columns=["doc_id", "lang"]).drop_duplicates()
    joined = truth.merge(got.drop_duplicates("doc_id"), on="doc_id")
    assert len(joined) > 40 and (joined.lang == joined.lang_pred).mean() >= 0.97
    strange = language_id.identify(docs.sparkSession.createDataFrame([(1, "zzxj qqkw vvv jjj xxq " * 20)], "doc_id long, text string"), model).first()
    assert strange["lang_pred"] in model.languages and not strange["accepted"]
    again = language_id.identify(docs.repartition(7), model).toPandas()
    key = ["doc_id", "lang_pred", "score"]
    assert collections.Counter(map(repr, got[key].values.tolist())) == collections.Counter(map(repr, again[key].values.tolist()))
    assert language_id.identify(none, model).count() == 0
    assert {r["lang_pred"] for r in language_id.identify(docs, language_id.fit(none)).collect()} == {"und"}


def test_held_out(spark):
    df = spark.createDataFrame([(i,) for i in range(200)] + [(None,)], "doc_id long")
    got = {r[0]: r[1] for r in df.select("doc_id", language_id.held_out(F.col("doc_id"))).collect()}
    assert got == {i: i is not None and zlib.crc32(str(i).encode()) % 3 == 1 for i in [*range(200), None]}


def variants(rows, one_in=97):
    count = collections.Counter()
    for doc_id, text, *_ in rows:
        for w in re.findall(r"[A-Za-zÀ-ÿ]+", text or ""):
            w = "".join(c.lower() if "A" <= c <= "Z" else c for c in w)
            h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{w}".encode())
            if h % one_in == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            count[w] += 1
    words = {w: n for w, n in count.items() if len(w) >= 5 and n >= 3}

    def near(a, b):
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b)) == 1
        a, b = sorted((a, b), key=len)
        return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))

    beside = {w: [v for v in words if abs(len(v) - len(w)) < 2 and v != w and near(w, v)] for w in words}
    form = {}
    for w, n in words.items():
        best = min(beside[w], key=lambda v: (-words[v], v), default=None)
        if best and words[best] >= 2 * n:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return {(w, form.get(w), root(w), n, len(beside[w]), words.get(form.get(w))) for w, n in words.items()}


@pytest.mark.parametrize("one_in", [97, 3])
def test_spelling_variants(docs, rows, one_in):
    got = {tuple(r) for r in spelling.spelling_variants(docs, one_in=one_in).collect()}
    assert got == variants(rows, one_in) and any(r[1] for r in got)


def test_spelling_of_long_words_and_ties(spark, none):
    long = "ab" * 400
    chain = ["aaaaa"] * 64 + ["aaaab"] * 32 + ["aaabb"] * 16 + ["aabbb"] * 8 + ["abbbb"] * 4 + ["zaaaa"] * 64
    texts = [" ".join(chain), " ".join([long] * 8 + [long + "a"] * 3 + ["c" + long[1:]] * 3), "éàüßç " * 3 + "éàüßd " * 9, None, ""]
    df = spark.createDataFrame([(7 * i + 1, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, h string")
    got = {tuple(r) for r in spelling.spelling_variants(df, one_in=10**9).collect()}
    assert got == variants([(7 * i + 1, t) for i, t in enumerate(texts)], 10**9)
    assert ("abbbb", "aabbb", "aaaaa", 4, 1, 8) in got
    assert spelling.spelling_variants(none).count() == 0


def test_filter_in_passes(docs):
    words = spelling.hashed(spelling.word_counts(docs)).cache()
    whole, parts = (sorted(map(tuple, spelling.near_words(words, b).collect())) for b in (32 << 20, 96))
    assert whole == parts and len(whole) > 20


def test_edits_hash_as_words_do():
    word = "abcÿe".encode("latin-1")
    alphabet = np.array([ord("b"), ord("z"), 0xFF], np.uint64)
    got = {(int(h), c) for _, hs, c in spelling.edits(spelling.letters([word]), alphabet) for h in hs}
    want = [(word[:i] + word[i + 1 :], -1) for i in range(5)] + [(word[:i] + bytes([x]) + word[i + 1 :], 0) for i in range(5) for x in (ord("b"), ord("z"), 0xFF) if word[i] < x]
    assert got == {(int(spelling.word_hashes(spelling.letters([w]))[0]), c) for w, c in want}


def sha(parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def manifest(rows):
    """Every row of the manifest, without hash states."""

    def leaf(r, text):
        values = [r[0], r[3], r[2], r[4], text]
        return sha("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values)

    def grow(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            levels.append([sha(levels[-1][i : i + 8]) for i in range(0, len(levels[-1]), 8)])
        return levels

    def sides(levels, i):
        for level in levels[:-1]:
            at = i // 8 * 8
            yield level[at:i], level[i + 1 : at + 8]
            i //= 8

    by = collections.defaultdict(list)
    for r in rows:
        by[r[2]].append((r[0] is not None, r[0], leaf(r, r[1]), r))
    langs = sorted(by, key=lambda x: (x is not None, (x or "").encode()))
    for x in langs:
        by[x].sort(key=lambda t: (t[0], t[1] or 0, t[2]))
    trees = {x: grow([t[2] for t in by[x]]) for x in langs}
    top = grow([trees[x][-1][0] for x in langs])
    out = collections.Counter()
    lower = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    for nth, x in enumerate(langs):
        for i, (_, doc_id, d, r) in enumerate(by[x]):
            way = [*sides(trees[x], i), *sides(top, nth)]
            tampered = doc_id is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0
            at = leaf(r, r[1] and r[1].translate(lower)) if tampered else d
            for a, b in way:
                at = sha([*a, at, *b])
            out[(doc_id, x, d, trees[x][-1][0], top[-1][0], sha(y for a, b in way for y in a + b), at, at == top[-1][0])] += 1
    return out


def test_manifest(spark, docs, none, rows):
    got = merkle.manifest(docs, merkle.every_third(F.col("doc_id")))
    assert got.columns == ["doc_id", "lang", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert collections.Counter(map(tuple, got.collect())) == manifest(rows)
    assert merkle.manifest(none, merkle.every_third(F.col("doc_id"))).count() == 0
    one = docs.filter("doc_id = 1")
    assert {(r["root"], r["verified"]) for r in merkle.manifest(one, F.lit(False)).collect()} == {(r["leaf"], True) for r in merkle.manifest(one, F.lit(False)).collect()}


def test_manifest_of_several_blocks(spark):
    """More leaves than a task folds at once, a language of a third of all rows with one id, more languages than a node has children."""
    rows = [(i, "Text A" if i % 5 else "text", "en", "s", i) for i in range(merkle.BLOCK + 777)]
    rows += [(i, None, f"l{i}", None, None) for i in range(20)]
    rows += [(None, f"T{i % 7}", None, "s", 1) for i in range(2500)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    got = merkle.manifest(df, merkle.every_third(F.col("doc_id")))
    assert collections.Counter(map(tuple, got.collect())) == manifest(rows)
