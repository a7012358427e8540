"""Confidence in result lists against plain Python, on texts that hold the marked words."""

import collections
import math
import re
import statistics

from corpusmill.operators import confidence

STOP = ["the", "of", "is"]


def tokens(t):
    return re.findall(r"\w+", t.lower())


def semantic(question, texts):
    docs = [collections.Counter(w for w in tokens(t) if len(w) > 1 and w not in STOP) for t in [question, *texts]]
    df = collections.Counter(w for d in docs for w in d)
    v = [{w: n * (math.log((1 + len(docs)) / (1 + df[w])) + 1) for w, n in d.items()} for d in docs]
    norm = lambda x: math.sqrt(sum(a * a for a in x.values()))
    cosine = [sum(w * v[0].get(t, 0) for t, w in d.items()) / (norm(d) * norm(v[0])) if d and v[0] else 0.0 for d in v[1:]]
    return statistics.mean(c / (i + 1) for i, c in enumerate(cosine))


def whole(question, hits):
    first = [t.lower() for t, *_ in hits[:3]]
    doubts = [sum(len(re.findall(p, t)) for p in confidence.DOUBT) for t in first]
    content = []
    for t, d in zip(first, doubts):
        sentences = [s for s in re.split(r"[.!?]+", t) if s.strip()]
        sure = sum(len(re.findall(p, t)) for p in confidence.CERTAIN)
        content.append(max(0.0, min(1.0, 0.1 * sure + min(0.3, 0.05 * len(sentences)) + (0.2 if re.search(r"\d", t) else 0) - 0.15 * d)))
    penalty = min(1.0, 10 * statistics.mean(d / max(1, len(t.split())) for t, d in zip(first, doubts)))
    counts = collections.Counter(w for t in first for w in tokens(t))
    if len(hits) < 2:
        agree = 0.8
    elif not counts:
        agree = 0.5
    else:
        scores = [s for _, s, _ in hits]
        agree = 0.3 * (1 - len({x for *_, x in hits}) / len(hits)) + 0.4 * max(0, 1 - statistics.pstdev(scores)) + 0.3 * sum(n > 1 for n in counts.values()) / len(counts)
    return semantic(question, [t for t, *_ in hits]), statistics.mean(content), agree, penalty


def test_result_confidence(spark):
    lists = {
        1: ("how to install the config tool", [("You must install the tool. It will always work, exactly 3 times!", 0.9, "a"), ("Maybe it might work; usually it depends.", 0.7, "b"), ("install config INSTALL tool", 0.2, "a"), ("perhaps", 0.1, "c"), ("the of", 0.05, "c")]),
        2: ('say "hello" now', [("Official standard text", 0.5, None)]),
        3: ("plain", [("", 0.5, "a"), (None, 0.4, "a")]),
        4: ("is DB-2 or API 4.5 set in debug and more than ten words of text here", [("unclear unclear unclear", 3.0, "x"), ("unclear", 1.0, "y"), ("api debug 4 api", 0.0, "z")]),
    }
    hits = spark.createDataFrame([(q, i + 1, *h) for q, (_, hs) in lists.items() for i, h in enumerate(hs)], "qid long, rank int, text string, score double, source string")
    questions = spark.createDataFrame([(q, t) for q, (t, _) in lists.items()] + [(9, "no results")], "qid long, query string")
    got = {r["qid"]: r for r in confidence.result_confidence(hits, questions, "qid", STOP).collect()}
    assert set(got) == set(lists)
    classes = {1: "complex", 2: "moderate", 3: "simple", 4: "expert"}
    for q, (question, hs) in lists.items():
        s, c, a, p = whole(question, [(t or "", x, y) for t, x, y in hs])
        if q == 2:
            a = 0.8
        want = (0.4 * s + 0.3 * c + 0.2 * a + 0.1 * (1 - p)) * confidence.FACTORS[classes[q]]
        r = got[q]
        assert r["question_class"] == classes[q]
        for name, x in (("semantic", s), ("content", c), ("consistency", a), ("penalty", p), ("confidence", max(0, min(1, want)))):
            assert abs(r[name] - x) < 2e-6, (q, name)
