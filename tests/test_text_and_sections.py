"""Text, section and inline-heading operators on fixtures with hand-derived values."""

import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quireflow.functions import scores as C
from quireflow.functions import text as T
from quireflow.functions.frames import barrier
from quireflow.operators import sections as S
from quireflow.operators.inline import inline_sections


def one(spark, column, **values):
    return spark.createDataFrame([tuple(values.values())], list(values)).select(column.alias("x")).first()["x"] if values else spark.range(1).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize(
    ("given_text", "want"),
    [("Héllo, W_orld+1!", "h llo w_orld+1"), ("  A--b\t\nC ", "a--b c"), ("", ""), ("ÉTÉ", "t"), ("state-of-the-art (SOTA)", "state-of-the-art sota")],
)
def test_normalize(spark, given_text, want):
    assert one(spark, T.normalize("t"), t=given_text) == want
    assert one(spark, T.normalize(T.normalize("t")), t=given_text) == want


def test_small_text_functions(spark):
    lit = F.lit
    assert one(spark, T.normalize_term(lit("﻿A_b-C+d"))) == "a b-c+d"
    assert one(spark, T.split_sentences(lit("One two. Three (4) five! (Six) is? no split. É too"))) == ["One two.", "Three (4) five!", "(Six) is? no split. É too"]
    long = " ".join(f"w{i}" for i in range(170))
    assert [len(x.split()) for x in one(spark, T.split_sentences(lit(long)))] == [80, 80, 10]
    assert one(spark, T.split_sentences(lit(" ".join(["w"] * 160)))) == [" ".join(["w"] * 160)]
    assert one(spark, T.split_sentences(lit(" \n "))) == []
    assert one(spark, T.split_sentences_browser(lit("Short one. This is a longer sentence. 4 not a start."))) == ["This is a longer sentence. 4 not a start."]
    assert one(spark, T.normalize_heading(lit("3.1. Related  Work:"))) == "related work"
    assert [one(spark, T.heading_section(lit(h))) for h in ("2 Prior art", "Future work", "Model", "Results", "Preface")] == ["related_work", "conclusion", "method", "experiment", "intro"]
    assert one(spark, T.canonical_section(lit(" Background "))) == "intro" and one(spark, T.canonical_section(lit("odd"))) == "intro" and one(spark, T.canonical_role(lit("Gap"))) == "gap"
    assert one(spark, T.alias_variants(lit("Self-attention layer"))) == ["self-attention layer", "self attention layer", "self-attention-layer"]
    assert one(spark, T.keyphrase_list(lit("a; b ;;c"))) == ["a", "b", "c"] and one(spark, T.keyphrase_list(lit("a|b"))) == ["a", "b"]
    assert one(spark, T.first_present(lit(None).cast("string"), lit(" "), lit("x"))) == "x"
    assert [one(spark, T.bio_prefix(lit(t).cast("string"))) for t in ("B-KP", " i", "O", None)] == ["B", "I", "O", "O"]
    assert one(spark, T.as_float(lit("1.5"))) == 1.5 and one(spark, T.as_float(lit("x"), 2.0)) == 2.0 and one(spark, T.as_int(lit("3.9"))) == 3 and one(spark, T.as_bool(lit(" TRUE ")))
    assert one(spark, T.safe_name(lit("a b/c.txt"))) == "a_b_c.txt" and one(spark, T.safe_name(lit("///"))) == "paper" and one(spark, T.slug(lit(" A b!c "))) == "a-b-c"
    assert one(spark, T.clean_title(lit("2017_attention_is all"))) == "attention is all" and one(spark, T.clean_title(lit("2017_"))) == "the paper"
    assert one(spark, T.trim_words(lit("a b, c d"), 2)) == "a b ..." and one(spark, T.trim_words(lit("a b"), 2)) == "a b"
    assert [one(spark, T.join_terms(F.array(*map(F.lit, x)))) for x in (["a"], ["a", "b"], ["a", "b", "c"])] == ["a", "a and b", "a, b, and c"]
    assert one(spark, T.query_keywords(lit("What is the attention-based model for NLP?"))) == ["attention-based model", "model nlp", "attention-based", "model", "nlp"]
    assert one(spark, T.html_text(lit("<p>a<script>x</script>b <!-- c --><b>d</b></p>"))) == "a b d"


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text("ab c-", max_size=12), min_size=1, max_size=6))
def test_jaccard_is_symmetric_and_bounded(spark, texts):
    d = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string").select("a", "b", T.tokens("a").alias("x"), T.tokens("b").alias("y"))
    for r in d.select("a", "b", C.jaccard(F.col("x"), F.col("y")).alias("l"), C.jaccard(F.col("y"), F.col("x")).alias("r")).collect():
        x, y = ({w for w in re.sub(r"[^a-z0-9_+\-]+", " ", t).split()} for t in (r["a"], r["b"]))
        assert r["l"] == r["r"] == (len(x & y) / len(x | y) if x and y else 0.0)


def test_match_quality(spark):
    def q(p, a):
        d = spark.createDataFrame([(p, a)], "p string, a string").select("p", "a", F.split("p", " ").alias("pt"), F.split("a", " ").alias("at"))
        return d.select(C.match_quality(F.col("p"), F.col("a"), F.col("pt"), F.col("at"))).first()[0]

    assert q("deep net", "deep net") == 1.0 and q("very deep net", "deep net") == 0.84 and q("deep net", "very deep net") == 0.78
    assert q("net", "deep net") == 0.0 and q("a b c d", "a b c e") == 0.0 and q("net", "nets") == 0.0


def test_scores(spark):
    s = lambda c: one(spark, c)
    assert s(C.candidate_score(F.lit(0.8), F.lit(0.4), F.lit(1.0))) == pytest.approx(0.72)
    assert s(C.concept_importance(F.lit(2.0), F.lit(1.0), F.lit(1.0))) == 1.0
    assert s(C.term_confidence(F.lit(""), F.lit("Both"), F.lit("Q1"), F.lit(True))) == pytest.approx(0.71) and s(C.term_confidence(F.lit("0.4"), F.lit(""), F.lit(""), F.lit(False))) == 0.4
    role = lambda t, sec: tuple(s(C.role_of(F.lit(t), F.lit(sec))))
    assert role("We propose a new framework.", "method") == ("core_method", 0.82)
    assert role("We propose a new framework.", "intro") == ("objective", 0.82)
    assert role("Our accuracy rose.", "method") == ("metric", 0.66) and role("Nothing here.", "conclusion") == ("contribution", 0.45)
    assert s(C.importance_of(F.lit("We achieve it"), F.lit("result"), 0.4)) == pytest.approx(0.98) and s(C.importance_of(F.lit("x"), F.lit("none"))) == 0.45
    assert s(C.evidence_of(F.lit("In this work BLEU rose"), F.lit("none"), F.lit(0.1))) == 0.62 and s(C.evidence_of(F.lit("x"), F.lit("finding"), F.lit(0.9))) == 0.35
    assert s(C.noisy_sentence(F.lit("short one"))) and not s(C.noisy_sentence(F.lit("We propose this"))) and s(C.noisy_sentence(F.lit("the full list of references is given on the last page here")))
    assert s(C.noisy_phrase(F.lit("eos model"))) and s(C.noisy_phrase(F.lit("-x y"))) and s(C.noisy_phrase(F.lit("ab"))) and not s(C.noisy_phrase(F.lit("attention layer")))
    assert s(C.cosine(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(1.0), F.lit(1.0)))) == pytest.approx(2**-0.5) and s(C.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) is None
    assert s(C.softmax(F.array(F.lit(0.0), F.lit(0.0)))) == [0.5, 0.5] and s(C.argmax(F.array(F.lit(1.0), F.lit(3.0), F.lit(3.0)))) == 1
    assert s(C.domain_of(F.lit("bert layers"), F.lit(""))) == "NLP & LLM" and s(C.domain_of(F.lit("x"), F.lit("Cat"))) == "Cat" and s(C.domain_of(F.lit("x"), F.lit(""))) == "Other"
    strong = C.cross_note_score("conclusion", F.lit("In this work we presented a method that works well on data"), F.lit(0.9), F.lit("finding"), F.lit(1.0), F.lit(1.0))
    assert s(strong) == 1.0 and s(C.cross_note_score("conclusion", F.lit("A method"), F.lit(0.9), F.lit("finding"), F.lit(1.0), F.lit(1.0))) == 0.0


PAPER = """A Paper Title Line
1 Introduction
Graphs are hard. We study them.
12
2. Related Work
Earlier work was slow.
3 Method
We build a tree. It is small.
4 Experiments
It wins. By far.
5 Conclusion
Trees help.
References
[1] Nobody. Nothing.
6 Method
Ignored text.
"""


def test_line_sections(spark):
    d = spark.createDataFrame([(1, PAPER), (2, "No headings. At all."), (3, ""), (4, None), (5, "References\nOnly these. Lines.")], "doc_id long, text string")
    rows = S.sentence_table(d).orderBy("doc_id", "sentence_index").collect()
    first = [(r["section"], r["section_title"], r["text"]) for r in rows if r["doc_id"] == 1]
    assert first == [
        ("intro", "Introduction", "A Paper Title Line"), ("intro", "1 Introduction", "Graphs are hard."), ("intro", "1 Introduction", "We study them."), ("related_work", "2. Related Work", "Earlier work was slow."),
        ("method", "3 Method", "We build a tree."), ("method", "3 Method", "It is small."), ("experiment", "4 Experiments", "It wins."), ("experiment", "4 Experiments", "By far."), ("conclusion", "5 Conclusion", "Trees help."),
    ]
    assert [(r["doc_id"], r["section"], r["section_title"]) for r in rows if r["doc_id"] > 1] == [(2, "intro", "Unsectioned")] * 2 + [(5, "intro", "Unsectioned")] * 2


def repaired(spark, sections, texts, repair):
    rows = [[(t, s, "" if s != "intro" else "Unsectioned") for t, s in zip(texts, sections)]]
    d = spark.createDataFrame([(rows[0],)], "s0 array<struct<text:string,section:string,section_title:string>>")
    return [x["section"] for x in barrier(d, r=repair("s0")).first()["r"]]


def test_repairs(spark):
    assert repaired(spark, ["intro"] * 7, ["x"] * 7, S.positional) == ["intro"] * 7
    assert repaired(spark, ["intro"] * 8, ["x"] * 8, S.positional) == ["intro"] * 2 + ["related_work"] + ["method"] * 3 + ["experiment"] * 2
    assert repaired(spark, ["intro"] * 10, ["x"] * 10, S.positional) == ["intro"] * 2 + ["related_work"] * 2 + ["method"] * 3 + ["experiment"] * 2 + ["conclusion"]
    text = ["x"] * 3 + ["Prior work is slow", "However we propose more", "Recent ideas"] + ["x"] * 4
    assert repaired(spark, ["intro"] * 6 + ["method"] * 4, text, S.bridge) == ["intro"] * 3 + ["related_work", "intro", "related_work"] + ["method"] * 4
    text = ["x"] * 8 + ["In this work we did it", "x"]
    assert repaired(spark, ["intro"] * 2 + ["method"] * 8, text, S.conclusion_tail) == ["intro"] * 2 + ["method"] * 6 + ["conclusion"] * 2
    text = ["x"] * 38 + ["We conclude that"] + ["x"]
    assert repaired(spark, ["intro"] * 39 + ["method"], text, S.low_coverage) == ["intro"] * 8 + ["related_work"] * 6 + ["method"] * 12 + ["experiment"] * 12 + ["conclusion"] * 2
    assert repaired(spark, ["intro"] * 39, ["x"] * 39, S.low_coverage) == ["intro"] * 39


FILL = "the tree is a simple thing that we all know and like very much indeed "


def running_paper(end="references one two three"):
    return (
        "a title of this text by some people and more words here abstract this is what we do in short " + FILL * 3 + "1 introduction " + FILL * 4 + "2 related work " + FILL * 4
        + "3 model architecture the model has layers " + FILL * 4 + "4 experiments " + FILL * 4 + "5 conclusion " + FILL * 4 + end
    )


def test_inline_sections():
    got = [(s, t) for s, t, _ in inline_sections(running_paper())]
    assert [s for s, _ in got] == ["intro", "intro", "intro", "related_work", "method", "experiment", "conclusion"] and got[0] == ("intro", "Lead")
    assert not any("references" in x for _, _, x in inline_sections(running_paper()))
    assert inline_sections("abstract short text introduction too short") == [] and inline_sections(None) == [] and inline_sections(FILL * 30) == []
    # nothing but terminals: no chunks
    assert inline_sections(FILL * 20 + "references x " + FILL * 8 + "appendix y") == []
    text = running_paper().replace("5 conclusion", "5 then")
    assert [s for s, _, _ in inline_sections(text)][-1] == "experiment"


def test_context_window(spark):
    d = spark.createDataFrame([([("a",), ("b",)],)], "sents array<struct<text:string>>")
    got = d.select(F.inline(S.context_window())).collect()
    assert [(r["previous"], r["current"], r["next"]) for r in got] == [("", "a", "b"), ("a", "b", "")]


def test_section_paths(spark):
    d = spark.createDataFrame([(["Intro", "Our Model", None], [["One. Two."], ["Three."], ["Four."]])], "n array<string>, p array<array<string>>")
    got = d.select(S.section_paths(F.col("n"), F.col("p")).alias("s")).first()["s"]
    assert [(x["text"], x["section"]) for x in got] == [("One.", "intro"), ("Two.", "intro"), ("Three.", "method"), ("Four.", "intro")]
