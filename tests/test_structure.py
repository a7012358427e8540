"""Hierarchical chunks and set-similarity joins against plain Python."""

import hashlib
import itertools
import random
import re

import pytest
from pyspark.sql import functions

from corpusmill.functions import text as T
from corpusmill.operators import ranking, sections, similarity
from corpusmill.plans import structure

DATA = "/root/testdata/sf0.001"
BREAK = re.compile(r"(?<=[.!?])\s+")


def plain_chunks(text, most=512, least=100, overlap=50):
    """The chunks of one text by a loop with its state in variables: (titles, type, content)."""
    out, stack, lines = [], [], []

    def kind(c):
        first = c.split("\n")[0]
        if re.match(r"#+\s+", c) or re.fullmatch(r"[A-Z][A-Z\s]+", first):
            return "heading"
        if any(re.match(r"\s*([-*+]|\d+\.)\s+", x + "\n") for x in c.split("\n")):
            return "list_item"
        if "```" in c:
            return "code_block"
        if c.count("|") >= 4:
            return "table"
        if re.search(r"\b(?:parameter|config|setting|value|option)\s*[=:]\s*", c.lower()):
            return "technical_spec"
        return "procedure" if re.search(r"\b(?:step|procedure|method|instruction)\s*\d*[:.]\s*", c.lower()) else "paragraph"

    def close():
        content = "\n".join(lines).strip()
        if lines and len(content) >= least:
            out.append((list(stack), kind(content), content))

    for line in text.split("\n"):
        s = line.strip()
        level = title = None
        if s.startswith("#") and re.match(r"#+\s+\S", s):
            level, title = len(s) - len(s.lstrip("#")), s.lstrip("#").strip()
        elif m := re.match(r"([\d.]*\d)\s+(\S.*)$", s):
            if re.fullmatch(r"\d+(\.\d+)*", m[1]):
                level, title = m[1].count(".") + 1, m[2].strip()
        elif len(s) > 1 and len(s) < 100 and s[0].isascii() and s[0].isupper() and all(x.isspace() or (x.isascii() and x.isupper()) for x in s):
            level, title = 1, s
        elif len(s) > 2 and s.endswith(":") and ":" not in s[:-1] and "A" <= s[0] <= "Z":
            level, title = 2, s[:-1].strip()
        if level:
            close()
            stack, lines = stack[: level - 1] + [title], []
        lines.append(line)
        if sum(len(x) for x in lines) > most:
            joined, at = "\n".join(lines), 0
            for parts, gap in ((BREAK.split(joined), 1), (joined.split("\n\n"), 2)):
                ends = list(itertools.accumulate(len(p) + gap for p in parts))
                fits = [e - gap for e in itertools.takewhile(lambda e: e - gap <= most - overlap, ends)]
                at = at or (fits[-1] if fits else 0)
            if at:
                out.append((list(stack), "paragraph", joined[:at].strip()))
                lines = joined[at:].split("\n")
            else:
                close()
                lines = []
    close()
    return out


def plain_document(text, overlap=50):
    chunks = plain_chunks(text)
    refs = [[r for p in ranking.REFERENCES for r in re.findall(p, c, re.IGNORECASE)] for _, _, c in chunks]
    rows = []
    for i, (titles, kind, content) in enumerate(chunks):
        parts = [s for s in BREAK.split(content) if s]
        before = " ".join([s for s in BREAK.split(chunks[i - 1][2]) if s][-2:]) if i else ""
        before = before if 0 < len(before) <= overlap else None
        needs = {j for j, (t, _, _) in enumerate(chunks) for r in refs[i] if j != i and r and any(r.lower() in x.lower() for x in t)}
        needs |= {i - 1} if before else set()
        rows.append((i, " > ".join(titles), kind, hashlib.md5(content.encode()).hexdigest(), len(content.split()), len(parts), refs[i], before, sorted(needs)))
    return rows


def test_hierarchical_chunks_of_documents(spark):
    texts = {r["doc_id"]: r["text"] for r in structure.headed(spark.read.parquet(f"{DATA}/documents.parquet")).collect()}
    columns = ["chunk_no", "titles", "chunk_type", "content_md5", "n_words", "n_sentences", "refs", "overlap", "depends"]
    got = {}
    for r in structure.tx06(spark, DATA).collect():
        got.setdefault(r["doc_id"], []).append(tuple(r[c] for c in columns))
    want = {i: rows for i, t in texts.items() if t is not None and (rows := plain_document(t))}
    assert {i: sorted(x) for i, x in got.items()} == want
    flat = [x for rows in want.values() for x in rows]
    assert {x[2] for x in flat} >= {"heading", "paragraph", "table", "list_item"} and any(x[7] for x in flat) and any(len(x[8]) > 1 for x in flat)


def test_hierarchical_chunks_of_odd_texts(spark):
    texts = ["", None, "short", "# A\n## B\n#### C\n" + "word " * 30 + "\n# D\n" + "word " * 30, "x" * 2000, "a. " * 400 + "\n" + "b. " * 400, "one\n\n" * 200, "Title here:\n" + "```\ncode\n```\n" * 20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in sections.hierarchical_chunks(df, "doc_id", "text").collect():
        got.setdefault(r["doc_id"], []).append((r["chunk_no"], r["titles"], r["chunk_type"], r["content"]))
    want = {i: [(n, *c) for n, c in enumerate(plain_chunks(t))] for i, t in enumerate(texts) if t and plain_chunks(t)}
    assert {i: sorted(x) for i, x in got.items()} == {i: [(n, t, k, c) for n, t, k, c in rows] for i, rows in want.items()}
    assert got[3][0][1] == ["A", "B", "C"] and got[3][1][1] == ["D"]


@pytest.mark.parametrize("threshold,shared", [(0.5, 1), (0.7, 1), (0.7, 2), (0.8, 2), (1.0, 1)])
def test_similar_sets(spark, threshold, shared):
    rng = random.Random(5)
    sets = [sorted(rng.sample([f"t{i}" for i in range(30)], rng.randint(1, 10))) + ["hot"] for _ in range(150)]
    sets += [[x for x in sets[i] if rng.random() > 0.1] + rng.sample(["new", "old"], 1) for i in range(100)] + [sets[0], sets[1], [], ["a"], ["a"], ["a", "b"]]
    df = spark.createDataFrame([(i, s + s[:1]) for i, s in enumerate(sets)], "id long, tokens array<string>")
    pairs, members = similarity.similar_sets(df, "id", "tokens", threshold, shared)
    rep = {}
    for i, s in enumerate(sets):
        if s:
            rep.setdefault(frozenset(s), i)
    want = {}
    for (x, a), (y, b) in itertools.combinations(rep.items(), 2):
        if len(x & y) / len(x | y) >= threshold - 1e-12:
            want[min(a, b), max(a, b)] = len(x & y)
    assert {(r["a"], r["b"]): r["common"] for r in pairs.collect()} == want
    assert {r["id"]: r["rep"] for r in members.collect()} == {i: rep[frozenset(s)] for i, s in enumerate(sets) if s}


def test_components_and_clusters(spark):
    edges = [(i, i + 1) for i in range(100)] + [(200, 300), (300, 250), (250, 200)]
    got = {r["node"]: r["root"] for r in similarity.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(101)} | {i: 200 for i in (200, 250, 300)}
    assert similarity.components(spark.createDataFrame([], "a long, b long")).count() == 0
    sets = spark.createDataFrame([(1, list("abcdefghij")), (2, list("bcdefghijk")), (3, list("cdefghijkl")), (4, list("xyz")), (5, list("xyz")), (6, ["q"])], "id long, tokens array<string>")
    found = {r["id"]: (r["cluster"], r["size"], r["confidence"]) for r in similarity.clusters(sets, "id", "tokens").collect()}
    assert found == {1: (1, 3, 0.8), 2: (1, 3, 0.8), 3: (1, 3, 0.8), 4: (4, 2, 0.7), 5: (4, 2, 0.7)}


def test_sketches_bound_what_differs(spark):
    rng = random.Random(9)
    sets = [(i, [rng.getrandbits(63) - 2**62 for _ in range(rng.randint(1, 300))]) for i in range(40)]
    sets += [(40 + i, x[: len(x) // 2] + [5, 6]) for i, x in sets]
    rows = spark.createDataFrame(sets, "i int, o array<long>").select("i", similarity._sketch(functions.col("o")).alias("s")).collect()
    bits = {r["i"]: sum((r["s"][f"s{w}"] & (2**64 - 1)) << (64 * w) for w in range(similarity.SKETCH_WORDS)) for r in rows}
    held = {i: set(x) for i, x in sets}
    apart = {(a, b): (bits[a] ^ bits[b]).bit_count() for a in held for b in held}
    assert all(n <= len(held[a] ^ held[b]) and (n - len(held[a] ^ held[b])) % 2 == 0 for (a, b), n in apart.items())
    assert sum(n > 60 for n in apart.values()) > 1000  # sets without much in common are told apart


def test_sets_that_share_one_rare_token_are_not_compared(spark, monkeypatch):
    """Long texts of one template meet in its rare words; only those that can be alike may be counted on whole sets, and only they are kept."""
    rng = random.Random(3)
    common = [f"c{i}" for i in range(2000)]
    sets = [["rare", *rng.sample(common, 500)] for _ in range(60)]
    sets += [[*s[:480], *(f"new{i}-{j}" for j in range(20))] for i, s in enumerate(sets[:5])]
    kept = {}
    monkeypatch.setattr(similarity, "stored", lambda df, name, f=similarity.stored: kept.setdefault(name, f(df, name)))
    pairs, _ = similarity.similar_sets(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"), "id", "tokens", 0.8)
    assert {(r["a"], r["b"]) for r in pairs.collect()} == {(i, 60 + i) for i in range(5)}
    assert kept["candidates"].count() < 400  # 2,080 pairs share the rare token
    assert "token-sets" not in kept
    assert max(r["n"] for r in kept["first-tokens"].select(functions.size("p").alias("n")).collect()) <= 100 + similarity.MOST_MET


@pytest.mark.parametrize("threshold", [0.6, 0.8])
def test_similar_sets_of_many_sizes(spark, threshold):
    rng = random.Random(8)
    sets = []
    for _ in range(12):
        whole = [f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(rng.choice([15, 40, 120, 200, 700]))]
        for _ in range(9):
            share = rng.random() * 0.15
            sets.append([x for x in whole if rng.random() > share] + [f"n{rng.randrange(400)}" for _ in range(int(len(whole) * rng.random() * 0.1))])
    held = list(dict.fromkeys(frozenset(s) for s in sets))
    sets = [sorted(s) for s in held]
    want = {(a, b): len(held[a] & held[b]) for a, b in itertools.combinations(range(len(held)), 2) if len(held[a] & held[b]) / len(held[a] | held[b]) >= threshold - 1e-12}
    assert len(want) > 50
    pairs, _ = similarity.similar_sets(spark.createDataFrame(list(enumerate(sets)), "id long, tokens array<string>"), "id", "tokens", threshold)
    assert {(r["a"], r["b"]): r["common"] for r in pairs.collect()} == want


def test_chunks_are_cut_once(spark):
    docs = spark.createDataFrame([(1, "# A\n" + "See section B. Some words here. " * 30 + "\n# B\n" + "More words. " * 30)], "doc_id long, text string")
    rows = sections.hierarchical_chunks(docs, "doc_id", "text")
    assert "MapInPandas" not in rows._jdf.queryExecution().toString()
    got = sorted(rows.collect(), key=lambda r: r["chunk_no"])
    assert len(got) > 2 and any(r["overlap"] for r in got) and got[0]["overlap"] is None and any(len(r["depends"]) > 1 for r in got)


def test_signs_of_references_miss_none(spark):
    parts = ["SEE  Section 4.2", "foresee page 3", "Refer to [Part 8]", "refer\nto x", "As Shown in B.", "as described", "Figure 7", "figure", "(see the end)", "(See)", "[a] [B]", "KKelvin İ", "seen", ""]
    texts = [" ".join(x) for x in itertools.permutations(parts, 2)] + [None]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    plain = functions.concat(*(functions.regexp_extract_all("t", functions.lit("(?i)" + T.ascii_bounds(p)), 1) for p in ranking.REFERENCES))
    rows = df.select("t", ranking.cross_references(functions.col("t")).alias("a"), plain.alias("b")).collect()
    assert all(r["a"] == r["b"] for r in rows) and sum(len(r["a"] or []) > 0 for r in rows) > 100
