"""Knowledge mining on inline texts."""

from corpusmill.operators import knowledge as K
from corpusmill.sources import files


def docs(spark, *texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_acronyms(spark):
    d = docs(spark, "The Modular Data Exchange (MDE) works.\nABC: Alpha beta code\nTHE: no\nAAA: no such", "ABC - longer definition text")
    found = K.acronyms(d, "doc_id", "text")
    got = {(r["doc_id"], r["acronym"]): r["definition"] for r in found.collect()}
    assert got == {(0, "MDE"): "The Modular Data Exchange", (0, "ABC"): "Alpha beta code", (1, "ABC"): "longer definition text"}
    merged = {r["acronym"]: (r["definition"], r["documents"]) for r in K.merged_acronyms(found, "doc_id").collect()}
    assert merged["ABC"] == ("longer definition text", 2)
    assert {r["acronym"]: r["definition"] for r in K.first_expansions(found, "doc_id").collect()}["ABC"] == "Alpha beta code"


def test_synonyms(spark):
    got = {(r["term"], r["synonym"]) for r in K.synonyms(docs(spark, "A meter (also known as endpoint) is here."), "doc_id", "text").collect()}
    assert got == {("meter", "endpoint"), ("endpoint", "meter")}


def test_lookups(spark):
    q = spark.createDataFrame([(1, "what is http"), (2, "METER")], "qid long, query string")
    a = spark.createDataFrame([("HTTP", "text transfer", 0.9, 3), ("ABC", "is code", 0.8, 1)], "acronym string, definition string, confidence double, usage_count int")
    assert [(r["qid"], r["acronym"]) for r in K.relevant_acronyms(q, a, 1).collect()] == [(1, "HTTP")]
    s = spark.createDataFrame([("meter", "endpoint", "x", 0.9, 1), ("gauge", "Meter", "y", 0.9, 5)], "term string, synonym string, term_type string, confidence double, usage_count int")
    assert [(r["term"], r["rank"]) for r in K.relevant_synonyms(q, s, 2).orderBy("rank").collect()] == [("gauge", 1), ("meter", 2)]


def test_specifications(spark):
    text = "Voltage: 5V; speed (rpm): 1500; torque = 10–20 Nm; heat is 20 °C; loss: 3; length: 4 meters; bogusvalue: 10XYZ"
    got = {(r["name"], r["value"], r["unit"]) for r in K.specifications(docs(spark, text, None, ""), "doc_id", "text").collect()}
    assert got == {("voltage", 5.0, "V"), ("speed", 1500.0, "rpm"), ("torque", 15.0, "Nm"), ("bogusvalue", 10.0, "XYZ"), ("heat", 20.0, "C"), ("loss", 3.0, None), ("length", 4.0, None)}


def test_steps(spark):
    got = K.steps(docs(spark, "Step 1: open it Step 2: look\n- bullet one\nInstall the part\nnothing"), "doc_id", "text", ["install", "remove"]).orderBy("step").collect()
    assert [(r["step"], r["instruction"], r["depends_on"]) for r in got] == [(1, "open it", None), (2, "look", 1), (3, "bullet one", 2), (4, "Install the part", 3)]


def test_entities_and_relations(spark):
    d = docs(spark, "The pump is connected to the valve. " + "x" * 200 + " motor", None)
    entities = K.entity_spans(d, "doc_id", "text", {"part": ["pump", "valve", "motor"]})
    assert [(r["entity"], r["start"]) for r in entities.orderBy("start").collect()] == [("pump", 4), ("valve", 29), ("motor", 237)]
    verbs = K.entity_spans(d, "doc_id", "text", {"verb": ["connected to"]})
    assert [tuple(r) for r in K.relations(entities, verbs, "doc_id").collect()] == [(0, "pump", "connected to", "valve")]


def test_sections_and_chunks(spark):
    d = docs(spark, "intro line here.\n# First Part\nbody one. body two.\nSECOND PART\n" + "long sentence number one is here. " * 30)
    got = {r["section"]: (r["title"], r["body"][:9]) for r in K.sections(d, "doc_id", "text").collect()}
    assert got == {0: (None, "intro lin"), 1: ("First Part", "body one."), 2: ("SECOND PART", "long sent")}
    chunks = K.section_chunks(d, "doc_id", "text", 200).orderBy("chunk_index").collect()
    assert chunks[1]["content"] == "Section: First Part\nbody one. body two." and all(len(c["content"]) <= 230 for c in chunks)
    packed = K.pack_sentences(d, "doc_id", "text", 100, 0).orderBy("chunk_index").collect()
    assert " ".join(c["content"] for c in packed).split() == d.first()["text"].split()


def test_index_entries(spark):
    d = docs(spark, "intro\n## A\n### ABC\nAlpha beta\n### ACD\nother\n## B\n### BCD\nlast")
    assert [(r["entry"], r["content"]) for r in K.index_entries(d, "doc_id", "text").orderBy("section", "entry").collect()] == [("ABC", "Alpha beta"), ("ACD", "other"), ("BCD", "last")]


def test_classes(spark):
    rows = spark.createDataFrame([(1, "secret.pdf", "plain"), (2, "a.pdf", "for internal use"), (3, "a.pdf", "plain")], "doc_id long, name string, text string")
    got = {r["doc_id"]: (r["security"], r["security_confidence"]) for r in K.security_class(rows, "name", "text", [("secret", "private"), ("internal", "internal")]).collect()}
    assert got == {1: ("private", 0.95), 2: ("internal", 0.9), 3: (None, None)}
    a = spark.createDataFrame([(1, "unknown", 0.4)], "doc_id long, kind string, confidence double")
    b = spark.createDataFrame([(1, "manual", 0.3)], "doc_id long, kind string, confidence double")
    assert tuple(K.merged_classes(a, b, "doc_id", ["kind"]).first()) == (1, "manual", 0.4)


def test_dictionary_and_index_export(spark):
    listing = spark.createDataFrame([("", "t", "b", "int", "YES", 2), ("", "t", "a", "text", "no", 1), ("s", "u", "c", "int", "1", 1)], "schema_name string, table_name string, column_name string, data_type string, is_nullable string, position int")
    got = {(r["schema_name"], r["column_name"]): (r["ordinal"], r["nullable"]) for r in files.data_dictionary(listing).collect()}
    assert got == {("dbo", "a"): (1, False), ("dbo", "b"): (2, True), ("s", "c"): (1, True)}
    acr = spark.createDataFrame([("ABC", "alpha", 0.5, False, ["x", "y", "z"]), ("ABD", "beta", 0.9, True, ["x"])], "acronym string, definition string, confidence double, verified boolean, sources array<string>")
    lines = [r["line"] for r in files.markdown_index(acr).collect()]
    assert lines == ["## A\n\n### ABC\nalpha\n*Confidence: 0.5 | Sources: x, y*", "### ABD\nbeta"]


def test_synonyms_are_ranked_once_a_word(spark):
    table = spark.createDataFrame([("Meter", f"gauge{i}", "x", i / 10, i) for i in range(8)] + [("dial", "METER", "x", 0.65, 1), ("meter", "other", "y", 9.0, 9)], "term string, synonym string, term_type string, confidence double, usage_count int")
    asked = spark.createDataFrame([(i, "METER") for i in range(40)] + [(40, "gauge2"), (41, "none"), (42, None)], "qid long, query string")
    found = K.relevant_synonyms(asked, table, 3, "x")
    assert "BroadcastHashJoin" in found._jdf.queryExecution().executedPlan().toString()  # questions do not meet in a task for their word
    got = {(r["qid"], r["rank"]): (r["term"], r["synonym"]) for r in found.collect()}
    want = {(i, k + 1): x for i in range(40) for k, x in enumerate([("Meter", "gauge7"), ("dial", "METER"), ("Meter", "gauge6")])}
    assert got == want | {(40, 1): ("Meter", "gauge2")}


def test_chunks_are_passed_on_in_pieces(spark, monkeypatch):
    docs = spark.createDataFrame([(i, f"One {i}. Two {i}. " * (i % 5)) for i in range(60)] + [(60, None)], "doc_id long, text string").coalesce(1)
    rows = lambda: sorted(map(tuple, K.pack_sentences(docs, "doc_id", "text", 20, 8).collect()))
    whole = rows()
    monkeypatch.setattr(K, "MOST_CHARACTERS", 50)
    assert rows() == whole and len(whole) > 100
