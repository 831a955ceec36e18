"""Lexicon, candidate, unit, graph, retrieval, note, label, metric, report, source and streaming operators on fixtures."""

import random

import pytest
from pyspark.sql import functions as F

from quireflow.functions import rules
from quireflow.operators import candidates as K
from quireflow.operators import graph as G
from quireflow.operators import labels as B
from quireflow.operators import lexicon as L
from quireflow.operators import metrics as M
from quireflow.operators import notes as N
from quireflow.operators import reports as R
from quireflow.operators import retrieval as V
from quireflow.operators import stats
from quireflow.operators import units as U
from quireflow.sources import readers, writers
from quireflow.streaming import sessions


def lexicon(spark, rows):
    return spark.createDataFrame(rows, "term_id long, section string, canonical_term string, aliases array<string>, confidence double, is_generic boolean, total_frequency long")


TERMS = [
    (0, "method", "Neural Network", ["neural network", "neural-network", "NN"], 0.9, False, 50),
    (1, "experiment", "Accuracy", ["accuracy", "NN"], 0.7, True, 5),
    (2, "intro", "Graph", ["graph", "graph theory"], 0.6, False, -3),
]


def test_lexicon_joins(spark):
    lex = L.section_lexicon(lexicon(spark, TERMS)).cache()
    assert lex.count() == 7 and lex.where("term_id = 2").first()["tf"] == 0
    p = spark.createDataFrame([("NN", "method"), ("Graph theory", "intro"), ("unknown", "intro"), ("deep neural network", "experiment")], "phrase string, section string")
    got = {r["phrase"]: (r["canonical"], r["bow_confidence"]) for r in L.canonicalize(p, lex).collect()}
    assert got == {"NN": ("Neural Network", 0.9), "Graph theory": ("Graph", 0.6), "unknown": ("unknown", 0.0), "deep neural network": ("deep neural network", 0.0)}
    best = {r["phrase"]: r for r in L.match_terms(p, lex).collect()}
    assert best["nn"]["canonical_term"] == "Neural Network" and best["deep neural network"]["quality"] == 0.84 and "unknown" not in best
    s = spark.createDataFrame([(1, 0, "method", "A neural network and a NN beat a graph. Accuracy!")], "doc_id long, sentence_index int, section string, text string")
    hits = [(r["canonical_term"], r["rank"]) for r in L.sentence_hits(s, lex, ["doc_id", "sentence_index"]).orderBy("rank").collect()]
    assert hits == [("Neural Network", 1), ("Accuracy", 2)]
    prior = {(r["canonical_term"], r["section"]): r["prior"] for r in L.section_prior(lex, rules.SECTIONS).collect()}
    assert prior["Accuracy", "experiment"] == pytest.approx(0.6) and prior["Accuracy", "intro"] == pytest.approx(0.1)


def test_overlap_join_agrees_with_all_pairs(spark):
    random.seed(1)
    texts = [" ".join(random.choice("abcdefgh") for _ in range(random.randrange(1, 12))) for _ in range(80)]
    left = spark.createDataFrame(list(enumerate(texts[:50])), "id long, text string")
    right = spark.createDataFrame(list(enumerate(texts[50:])), "item_id long, text string")
    want = {}
    for i, a in enumerate(texts[:50]):
        x = set(a.split())
        scored = [(len(x & set(b.split())) / len(x | set(b.split())), -j) for j, b in enumerate(texts[50:])]
        if max(scored)[0] >= 0.68:
            want[i] = (-max(scored)[1], max(scored)[0])
    got = {r["id"]: (r["item_id"], r["overlap"]) for r in L.nearest_by_overlap(left, right, ["id"], "item_id").collect()}
    assert got == want and len(want) > 10


def test_decode_and_rerank(spark):
    s = spark.createDataFrame([(1, 0, "The deep net (x) wins."), (1, 1, "Big data")], "doc_id long, sentence_index int, text string")
    t = [(1, 0, 0, 0, 0, 3, .9, .05, .05), (1, 0, 1, 0, 4, 8, .1, .8, .1), (1, 0, 2, 0, 9, 12, .1, .3, .6), (1, 0, 3, 1, 0, 3, .1, .2, .7), (1, 0, 4, 1, 4, 8, .2, .5, .3), (1, 0, 5, 1, 4, 5, .1, .6, .3)]
    t = spark.createDataFrame(t, "doc_id long, window_id int, pos int, sentence_index int, start_char int, end_char int, p_o double, p_b double, p_i double")
    got = [(r["surface"], round(r["s_boundary"], 6)) for r in K.decode(t, s).orderBy("first_pos").collect()]
    assert got == [("deep net", 0.7), ("data", 0.5)]
    random.seed(2)
    names = [" ".join(random.choice("abcd") for _ in range(3)) for _ in range(40)]
    scores = [random.random() for _ in names]
    tokens = [set(n.split()) for n in names]
    chosen, left = [], list(range(40))
    while left and len(chosen) < 15:  # the definition, step by step
        value = lambda k: 0.75 * scores[k] + 0.25 * (1 - max((len(tokens[k] & tokens[c]) / len(tokens[k] | tokens[c]) for c in chosen), default=0.0))
        top = max(left, key=lambda k: (value(k), -k))
        chosen.append(top)
        left.remove(top)
    got = K.greedy_coverage(scores, tokens, 15, 0.75)
    assert [k for k, _, _ in got] == chosen and got[0][1] == 1.0 and all(0 <= c <= 1 for _, c, _ in got)
    c = spark.createDataFrame([(1, 0, k, n, s) for k, (n, s) in enumerate(zip(names, scores))], "doc_id long, window_id int, first_pos int, canonical string, s_candidate double")
    rows = K.coverage_rerank(c, 5).orderBy("rank").collect()
    assert [r["rank"] for r in rows] == [1, 2, 3, 4, 5] and rows[0]["s_candidate"] == max(scores)


def test_windows_and_bio(spark):
    s = spark.createDataFrame([(1, i, " ".join(["w"] * n)) for i, n in enumerate([5, 6, 0, 30, 2])], "doc_id long, sentence_index int, text string").replace("", " ")
    got = [(r["window_id"], r["sentence_index"], r["segment"], r["n_tokens"]) for r in K.windows(s, 20).orderBy("sentence_index").collect()]
    assert got == [(0, 0, 0, 5), (0, 1, 1, 6), (1, 3, 0, 18), (2, 4, 0, 2)]
    b = spark.createDataFrame([(["Deep", "net", "is", "a", "(Graph)", "deep", "Net"], ["I", "I-x", "O", "B", "B", "b", "i"])], "w array<string>, t array<string>")
    assert b.select(K.bio_phrases(F.col("w"), F.col("t"))).first()[0] == ["Deep net", "a", "Graph"]


UNITS = [(1, "a b", "intro", "problem", 0, 0.9, "s0"), (1, "c", "intro", "problem", 0, 0.8, "s0"), (1, "d e", "method", "process", 1, 0.7, "s1"), (1, "f", "method", "gap", 2, 0.6, "s2")]


def unit_table(spark):
    return spark.createDataFrame(UNITS, "doc_id long, phrase string, section string, role string, sentence_index int, unit_importance double, evidence_sentence string").withColumns({"evidence_score": F.lit(0.5), "role_score": F.lit(0.5), "s_rerank": F.lit(0.1)})


def test_gate_graph_payload(spark):
    u = unit_table(spark).withColumn("trace", U.threshold_trace(F.col("phrase"), F.when(F.col("phrase") == "c", F.lit(0.71)), F.lit(0.0)))
    g = U.gate(u, limit=2).cache()
    assert {r["phrase"]: (r["status"], r["unit_id"]) for r in g.collect()} == {"a b": ("kept", "ecu_001"), "c": ("kept", "ecu_002"), "d e": ("over_limit", None), "f": ("failed", None)}
    assert g.where("phrase = 'c'").first()["trace"]["passed_features"] == ["bow_support"]
    kept = g.where("status = 'kept'").select("doc_id", "final_rank", "unit_id", "sentence_index", "section", "role")
    assert [(r["source"], r["target"], r["kind"], r["edge_rank"]) for r in G.concept_graph_edges(kept).orderBy("edge_rank").collect()] == [("ecu_001", "ecu_002", "same_evidence_sentence", 1), ("ecu_001", "ecu_002", "same_section_role", 2)]
    assert '"schema_version":"evidence_units_v1"' in U.payload(g).first()["payload"]


def test_knowledge_graph(spark):
    v = spark.createDataFrame([("deep net", "Deep Net", 0.5), ("graph", "Graph", 0.9), ("tree", "Tree", 0.4)], "alias string, canonical_term string, confidence double")
    t = spark.createDataFrame([(1, 0, 3, "The Deep Net uses a graph."), (1, 1, 3, "A tree near a graph"), (1, 2, 3, "tree")], "doc_id long, text_index int, n_texts int, text string")
    terms = G.match_terms_in_texts(t, v)
    assert [(r["canonical_term"], round(r["match_score"], 6)) for r in terms.orderBy("rank").collect()] == [("Graph", 1.0), ("Deep Net", 1.0), ("Tree", 0.65)]
    edges = [(r["source"], r["target"], r["relation"]) for r in G.semantic_edges(t, terms.select("doc_id", "canonical_term", "alias")).orderBy("edge_rank").collect()]
    assert edges == [("Deep Net", "Graph", "uses"), ("Tree", "Graph", "co_occurs_in_evidence")]
    nodes = spark.createDataFrame([(1, "d", "Deep Net", 1), (1, "d", "Graph", 2), (1, "d", "Tree", 3), (1, "d", "Vine", 4)], "doc_id long, domain string, canonical_term string, rank int")
    chain = G.related_chain(nodes, G.semantic_edges(t, terms.select("doc_id", "canonical_term", "alias")))
    assert [(r["source"], r["target"]) for r in chain.collect()] == [("Tree", "Vine")]


def test_retrieval(spark):
    turns = spark.createDataFrame([(1, 0, "user", "old question"), (1, 2, "user", "How does attention work"), (1, 3, "assistant", "x")], "conv_id long, turn long, role string, text string")
    r = V.conversation_keywords(turns).first()
    assert r["turn"] == 2 and r["keywords"] == ["does attention", "attention work", "does", "attention", "work"]
    ranked = V.rank_units(unit_table(spark).withColumn("words", F.lit("")), F.array(F.lit("d e"), F.lit("zz")), 2).orderBy("rank").collect()
    assert ranked[0]["phrase"] == "d e" and ranked[0]["matched_keywords"] == ["d e"] and ranked[0]["relevance"] == pytest.approx(0.26 + 0.21 + 0.05)
    vec = spark.createDataFrame([(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 0.0]), (3, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    got = V.cosine_topk(vec, vec.where("vec_id = 0").select(F.col("vec_id").alias("query_id"), F.col("embedding").alias("q")), 2).orderBy("rank").collect()
    assert [r["vec_id"] for r in got] == [0, 1]
    text = ("x" * 790 + ". ") * 3
    pieces = V.char_chunks(text)
    assert pieces[0] == text[:800].strip() or pieces[0].endswith(".")
    assert V.char_chunks("short") == [] and V.char_chunks(None) == [] and V.char_chunks("y" * 900)[1] == "y" * 200
    e = spark.createDataFrame([(1, "2024-01-01 00:00:00"), (2, "2024-01-01 02:00:00")], "user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    assert [r["user_id"] for r in V.active_sessions(e, F.to_timestamp(F.lit("2024-01-01 02:30:00"))).collect()] == [2]


def predictions(spark):
    rows = [
        (1, 0, 4, "intro", "We propose a method that solves the old problem of trees in a forest.", "objective", 0.9, 0.6), (1, 1, 4, "intro", "solves the old problem of trees", "problem", 0.9, 0.6),
        (1, 2, 4, "intro", "Our experiment shows an accuracy on the benchmark that is higher than any before it.", "result", 0.3, 0.3), (1, 3, 4, "intro", "In this work we presented a way to grow trees in all the forests here.", "finding", 0.3, 0.3),
    ]
    return spark.createDataFrame(rows, "doc_id long, sentence_index int, n_sentences int, section string, text string, role string, importance double, evidence_score double")


def test_notes_and_overview(spark):
    p = predictions(spark)
    n = N.section_notes(p)
    got = n.first()["notes"]
    assert got[0].startswith("We propose") and "solves the old problem of trees" not in got
    filled = {r["section"]: r["notes"] for r in N.backfill_notes(p, n.select("doc_id", "section", F.slice("notes", 1, 1).alias("notes"))).collect()}
    assert filled["experiment"][0].startswith("Our experiment") and filled["conclusion"][0].startswith("In this work") and len({x for v in filled.values() for x in v}) == sum(map(len, filled.values()))
    u = unit_table(spark).withColumn("passed", F.lit(True)).withColumn("phrase", F.when(F.col("phrase") == "d e", F.lit("tree growth,")).otherwise(F.col("phrase")))
    terms = N.overview_terms(u)
    assert {(r["section"], tuple(r["terms"])) for r in terms.collect()} == {("intro", ("a b",)), ("method", ("tree growth",))}
    titles = spark.createDataFrame([(1, "2020_on_trees"), (2, "x")], "doc_id long, title string")
    text = {r["doc_id"]: r["overview"] for r in N.overview_text(terms, titles).collect()}
    assert text[1].startswith("This paper addresses a b, framing") and "around tree growth." in text[1] and text[2] == "This paper presents a research contribution in the area suggested by x."
    assert {r["doc_id"]: r["overview"] for r in N.overview_text(terms, titles, "plain").collect()}[1] == "Paper: on trees. Problem/background: a b. Method: tree growth."
    assert N.evidence_snippets(u).where("section = 'intro'").first()["snippets"] == ["s0"]
    assert N.markdown_card(terms, n, titles).first()["markdown"].startswith("# on trees\n\n## Intro\n**Terms:** a b\n- We propose")


def test_labels(spark):
    def table(a, b):
        m = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                m[i + 1][j + 1] = m[i][j] + 1 if x == y else max(m[i][j + 1], m[i + 1][j])
        return m[-1][-1]

    random.seed(3)
    for _ in range(200):
        a, b = ([random.choice("abc") for _ in range(random.randrange(12))] for _ in range(2))
        assert B.lcs(a, b) == table(a, b)
    assert B.rouge_l(["a", "b", "c"], ["a", "c"]) == pytest.approx(0.8)
    assert B.greedy_labels(["the cat sat", "dogs bark", "on a mat"], ["the cat sat on a mat", ""]) == [1.0, 0.0, 0.0]
    assert B.greedy_labels(["the cat sat", "dogs bark", "on a mat"], [" ".join(["the cat sat on a mat"] * 8)])[1] == 0.0
    assert B.phrase_spans("A Deep--Net, deep net; DEEP  NET!", "deep net") == [(13, 21), (23, 32)] and B.phrase_spans("x", "!") == []
    assert B.bio_labels([(0, 1), (2, 5), (6, 9)], [(2, 9), (6, 9)]) == ["O", "B", "I"]
    assert B.budget([5] * 4, [False] * 4, 100) == [0, 1, 2, 3] and B.budget([60, 60, 60], [False] * 3, 100) == [0]
    assert B.budget([40, 40, 40, 40], [False, False, True, False], 100, lead=1) == [1, 2]
    s = spark.createDataFrame([("We use deep nets for the graph.",)], "text string")
    assert B.weak_phrases(s).first()["phrases"][:3] == ["use deep nets graph", "deep nets graph", "use deep nets"]
    ev = spark.createDataFrame([("the cat sat", ["the", "cat", "sat"], [("cat s", ["cat", "s"])]), ("a b c", ["a", "b", "c"], [("c b x a", ["c", "b", "x", "a"])]), ("q", ["q"], [("z", ["z"])])], "s string, t array<string>, e array<struct<text:string,tokens:array<string>>>")
    assert [r[0] for r in ev.select(B.contains_evidence(F.col("s"), F.col("t"), F.col("e"))).collect()] == [True, True, False]
    facet = spark.createDataFrame([(["a", "b"], [("challenge", ["x"]), ("outcome", ["a", "c"])])], "t array<string>, s array<struct<facet:string,tokens:array<string>>>").select(B.best_facet(F.col("t"), F.col("s")).alias("f"))
    assert tuple(facet.first()["f"]) == (pytest.approx(1 / 3), "result")
    hard = facet.select(B.role_target(F.lit("aclsum"), F.lit("intro"), F.lit(None).cast("string"), F.col("f")).alias("r")).first()["r"]
    assert hard["role_id"] == rules.ROLES.index("result") and sum(hard["candidates"]) == 0
    soft = facet.select(B.role_target(F.lit("qasper"), F.lit("method"), F.lit("gap"), F.col("f")).alias("r")).first()["r"]
    assert soft["role_id"] == -100 and sum(soft["candidates"]) == 4
    assert B.repeat_to_size(spark.range(3), 7, [F.col("id")]).count() == 7 and B.repeat_to_size(spark.range(9), 7, [F.col("id")]).count() == 7
    d = spark.createDataFrame([("train", 1, "gap", "intro", 1.0, None), ("train", 1, None, "intro", None, 0.4), ("dev", 2, "gap", "method", 0.2, 0.9)], "split string, doc_id long, role string, section string, evidence_label double, importance_label double")
    r = B.split_summary(d).where("split = 'train'").first()
    assert (r["documents"], r["sentences"], r["evidence_positive"], r["importance_labeled"], r["importance_positive"], r["role_counts"], r["section_counts"]) == (1, 2, 1, 1, 0, {"gap": 1}, {"intro": 2})


def test_metrics_and_reports(spark):
    d = spark.createDataFrame([(0.9, 1), (0.6, 0), (0.4, 1), (0.1, 0), (0.5, None)], "s double, y int")
    r = M.binary_counts(d, F.col("s"), F.col("y")).first()
    assert (r["tp"], r["fp"], r["fn"], r["tn"], r["f1"]) == (1, 1, 1, 1, 0.5)
    sweep = M.threshold_sweep(d, F.col("s"), F.col("y"))
    assert sweep.count() == 19 and tuple(M.best_threshold(sweep).first()) == (0.15, 0.8)
    p, g = (spark.createDataFrame(x, "d int, k string") for x in ([(1, "a"), (1, "b"), (1, "b")], [(1, "b"), (2, "a")]))
    assert tuple(M.exact_match(p, g, ["d", "k"]).first()) == (1, 2, 2, 0.5, 0.5, 0.5)
    m = spark.createDataFrame([("gap", "gap", ["gap"], 0.9, 1.0, 0.5, 1.0), ("gap", "result", None, 0.1, 0.0, 0.5, None)], "role string, role_gold string, candidates array<string>, evidence_score double, evidence_label double, importance double, importance_label double")
    r = M.structure_metrics(m).first()
    assert r["role_accuracy"] == 0.5 and r["candidate_accuracy"] == 1.0 and r["evidence_f1"] == 1.0 and r["importance_mae"] == 0.5
    s = spark.createDataFrame([(1, "intro"), (1, "method"), (2, "intro")], "doc_id long, section string")
    c = {(r["kind"], r["key"]): r["n"] for r in R.coverage_summary(R.section_counts(s)).collect()}
    assert c["present", "2"] == 1 and c["missing", "method"] == 1 and c["low_coverage", ""] == 2
    assert [spark.range(1).select(R.looks_noisy(F.lit(x))).first()[0] for x in ("bert", "abc", "cls head", "1 2 x", "fig a 3", "graph tree")] == [False, True, True, True, True, False]
    risk = R.risk_report(spark.createDataFrame([(1,), (2,)], "doc_id long"), unit_table(spark), spark.createDataFrame([(1, "intro", ["x"])], "doc_id long, section string, notes array<string>")).orderBy("doc_id").collect()
    assert risk[0]["empty_notes"] == 4 and risk[0]["no_units"] == 3 and risk[0]["coverage_score"] == 0.2 and risk[1]["risk_score"] == 17.5
    b = R.batch_report(spark.createDataFrame([(1, "ok", 4), (2, "ok", 2), (3, "failed", None)], "doc_id long, status string, units int")).first()
    assert tuple(b) == (3, 2, 1, 3.0, 2, 4)


def test_sources(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes("ok é\n".encode() + b"\xff\xfebad")
    (tmp_path / "b.txt").write_text("two")
    (tmp_path / "c.md").write_text("no")
    got = {r["doc_id"]: r["text"] for r in readers.texts(spark, str(tmp_path)).collect()}
    assert got == {"a": "ok é\nbad", "b": "two"} and readers.texts(spark, str(tmp_path), limit=1).count() == 1
    with pytest.raises(FileNotFoundError):
        readers.texts(spark, str(tmp_path), names=["a.txt", "zz.txt"])
    csv = tmp_path / "lex.csv"
    csv.write_text("﻿section_mapped,canonical_term,matched_surface_terms,is_generic,confidence_score,total_frequency,source_corpus\nMethods,Deep Net,deep nets; DNN,true,,7,both\n,,x,,,,\n")
    r = readers.section_lexicon(spark, str(csv)).collect()
    assert len(r) == 1 and r[0]["section"] == "method" and r[0]["aliases"] == ["deep nets", "Deep Net", "DNN"] and r[0]["confidence"] == pytest.approx(0.68) and r[0]["total_frequency"] == 7
    m = tmp_path / "m.csv"
    m.write_text("document,method__deep net,graph\nd1,2,0\nd2,x,1.5\n")
    assert {tuple(r) for r in readers.matrix(spark, str(m)).collect()} == {("d1", "method", "deep net", 2.0), ("d2", "intro", "graph", 1.5)}
    rct = tmp_path / "rct.txt"
    rct.write_text("###1\nMETHODS\tWe did it.\nbad line\nRESULTS\tIt worked.\n\n###2\nODD\tx\n")
    assert [tuple(r)[:5] for r in readers.labelled_lines(spark, str(rct)).orderBy("doc_id", "sentence_index").collect()] == [("1", 0, "We did it.", "method", "process"), ("1", 1, "It worked.", "experiment", "result"), ("2", 0, "x", "intro", "background")]
    df, errors = readers.first_readable(spark, [str(tmp_path / "none"), str(csv)], lambda s, p: s.read.csv(p))
    assert df is not None and len(errors) == 1 and readers.optional(spark, None, "a int", None).count() == 0
    raw = spark.createDataFrame([("p1", "T", "a;b")], "paper_id string, title string, keywords string")
    assert tuple(readers.keyphrase_records(raw).first()) == ("p1", "T", "", "", ["a", "b"])
    recs = spark.createDataFrame([(1, "x"), (2, "y")], "doc_id long, v string")
    writers.json_lines(recs, str(tmp_path / "j"))
    assert readers.json_lines(spark, str(tmp_path / "j"), "doc_id long, v string").count() == 2
    writers.upsert(spark, recs, str(tmp_path / "kv"))
    writers.upsert(spark, spark.createDataFrame([(2, "z")], "doc_id long, v string"), str(tmp_path / "kv"))
    assert {(r["doc_id"], r["v"]) for r in spark.read.parquet(str(tmp_path / "kv")).collect()} == {(1, "x"), (2, "z")}
    md = spark.createDataFrame([("### A\n\nold\n\n### B\n\nkeep",), ("### B\n\nx",)], "text string").withColumn("o", F.lit("new $1"))
    got = [r["text"] for r in writers.put_overview(md, "A", "o").collect()]
    assert got == ["### A\n\nnew $1\n\n### B\n\nkeep", "### A\n\nnew $1\n\n### B\n\nx"]
    assert readers.report_summary(md, ["A", "B"]).first()["parts"] == {"A": "old", "B": "keep"}


def test_streams(spark, tmp_path):
    e = spark.createDataFrame([(i, f"2024-01-01 {h:02d}:00:00", u) for i, (h, u) in enumerate([(0, 1), (0, 1), (1, 2), (5, 1), (12, 3)])], "event_id long, t string, user_id long")
    e = e.select("event_id", F.to_timestamp("t").alias("ts"), "user_id", F.lit("x").alias("event_type"), F.lit(1.0).alias("value"), F.lit("{}").alias("props"))
    e.orderBy("ts").coalesce(1).write.parquet(str(tmp_path / "in"))
    for k, f in enumerate((sessions.windowed_counts, lambda s: sessions.sessions(s, "2 hours"), sessions.expiring_sessions, sessions.distinct_events)):
        q = f(sessions.event_stream(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName(f"out{k}").outputMode("append").option("checkpointLocation", str(tmp_path / f"c{k}")).start()
        q.processAllAvailable()
        q.stop()
    assert {(str(r["start"])[11:16], r["n"]) for r in spark.table("out0").collect()} >= {("00:00", 2), ("01:00", 1), ("05:00", 1)}
    assert {(r["user_id"], r["n"]) for r in spark.table("out1").collect()} == {(1, 2), (2, 1), (1, 1)}
    assert all(r["expired"] for r in spark.table("out2").collect()) and spark.table("out3").count() == 5
    batch = sessions.latest_turns(spark.createDataFrame([(1, 0, "user", "a"), (1, 2, "user", "b")], "conv_id long, turn long, role string, text string")).first()
    assert tuple(batch) == (1, 2, "b")


def test_stats(spark):
    s = spark.createDataFrame([(1, 0, "intro", "A b b."), (1, 1, "method", "c"), (2, 0, "intro", "?")], "doc_id long, sentence_index int, section string, text string")
    got = {(r["doc_id"], r["section"]): (r["sentence_count"], r["token_count"], r["type_count"]) for r in stats.section_token_stats(s).collect()}
    assert got == {(1, "intro"): (1, 3, 2), (1, "method"): (1, 1, 1), (2, "intro"): (1, 0, 0)}
    m = spark.createDataFrame([(1, "intro", "x", 2, 0.5), (1, "intro", "y", 1, 0.5), (1, "method", "z", 9, 0.1)], "doc_id long, section string, term string, frequency long, tfidf double")
    assert [r["term"] for r in stats.top_features(m, 2, by_section=False).orderBy("rank").collect()] == ["x", "y"] and tuple(stats.matrix_summary(m).first()) == (1, 3, 9, 0.5)
    hits = spark.createDataFrame([(1, 0, "B", 0.9), (1, 1, "C", 0.5)], "doc_id long, sentence_index int, canonical_term string, confidence double")
    p = {r["section"]: r for r in stats.section_profiles(s.where("doc_id = 1"), hits).collect()}
    assert p["intro"]["hit_count"] == 1 and p["method"]["top_terms"][0]["canonical_term"] == "C"


def test_registered_queries_and_their_sql_agree(spark):
    import __spark_entry__ as entry

    q, o = entry.queries(), entry.oracle_sql()
    assert set(o) <= set(q) and len(q) >= 58
    assert entry.entry(spark).count() > 0


def test_cards(spark):
    from quireflow.operators import cards

    d = spark.createDataFrame([(" ".join(f"w{i:02d}x" for i in range(60)) + " deep net end", ["deep net"]), ("1 x2 b " + " ".join(["word"] * 40), [""]), ("a b", []), ("z " * 20 + "we propose it " + "y " * 40, [])], "s string, f array<string>")
    got = [r[0] for r in d.select(cards.excerpt(F.col("s"), F.col("f"))).collect()]
    assert got[0].startswith("... w33x") and got[0].endswith("net end") and got[1] == "... " + " ".join(["word"] * 30) + " ..." and got[2] == "a b"
    assert got[3].startswith("... z z we propose it y") and len(got[3].split()) == 32
    n = spark.createDataFrame([(1, "method", ["A sparse-attention encoder helps", "sparse-attention encoder again"])], "doc_id long, section string, notes array<string>")
    f = {r["term"]: r["weight"] for r in cards.focus_terms(n, ["helps"]).collect()}
    assert f["sparse-attention encoder"] == 8 and f["helps"] == 8
    s = {r["section"]: r["summary"] for r in cards.section_summaries(unit_table(spark), n).collect()}
    assert s["intro"].startswith("The paper starts from a b") and "Mostly problem." in s["intro"] and "sparse-attention" in s["method"]
    p = cards.chat_prompt(unit_table(spark), n, spark.createDataFrame([(1, "Why?")], "doc_id long, question string")).first()["prompt"]
    assert "Question: Why?" in p and p.index("[intro]") < p.index("[method]") and "- a b (problem): s0" in p and "note: A sparse" in p
    r = spark.createDataFrame([(1, ["u"]), (2, []), (3, []), (None, [])], "doc_id long, evidence_units array<string>")
    assert {x["doc_id"]: x["plan"] for x in cards.route_requests(r, spark.createDataFrame([(2,)], "doc_id long")).collect()} == {1: "evidence", 2: "vector", 3: "not_found", None: "invalid"}
    assert spark.range(1).select(cards.highlighted(F.lit("a<b Deep net"), ["deep", "deep net"])).first()[0] == "a&lt;b <mark>Deep net</mark>"


def test_features(spark):
    from quireflow.operators import features

    assert features.word_pieces("Unaffable, x!", {"un", "##aff", "##able", ",", "x"}) == ["un", "##aff", "##able", ",", "x", "[UNK]"]
    u = spark.createDataFrame([(1, "intro", "deep graph net"), (1, "method", "deep net")], "doc_id long, section string, phrase string")
    m = spark.createDataFrame([(1, "intro", "graph net", 4, 1.0), (1, "intro", "deep graph", 1, 2.0), (1, "method", "other", 1, 1.0)], "doc_id long, section string, term string, frequency long, tfidf double")
    s = stats.matrix_summary(m)
    assert [(r["term"], r["tfidf_support"]) for r in features.match_features(u, m, s).collect()] == [("deep graph", 1.0)]
    assert features.match_features(u, m, s, "tfidf").first()["term"] == "deep graph" and features.matrix_report(m).first()["features"] == 3
    t = spark.createDataFrame([(1, 0, "intro", "graph net and graph net")], "doc_id long, sentence_index int, section string, text string")
    x = features.on_the_fly_tfidf(t, spark.createDataFrame([("graph net", "intro", 2.0), ("graph net", "method", 9.0)], "term string, section string, idf double"))
    assert [(r["term"], r["tfidf"]) for r in x.collect()] == [("graph net", 4.0)]
    d = features.tokenize_pieces(spark.createDataFrame([("ab",)], "text string"), ["a", "##b"]).first()["pieces"]
    assert d == ["a", "##b"]
