"""Cases of the review's second round: caps, hostile rows, clashing names, and verdicts that hang on the method alone."""

import json
import random
import time

import pytest
from pyspark.sql import functions as F

pytest.importorskip("quireflow.llm")
from quireflow.llm import chat, decontam, langid, quality, secrets, simhash_bk, stages, toxicity, url_cascade, wrapper  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PAGES = "page_id long, url string, html string"


def test_seventy_languages_and_a_large_alphabet(spark):
    random.seed(41)
    rows, k = [], 0
    for lang in range(70):
        letters = random.sample("abcdefghijklmnopqrstuvwxyz", 9)
        words = ["".join(random.choice(letters) for _ in range(5)) for _ in range(40)]
        for _ in range(4):
            rows.append((k, " ".join(random.choice(words) for _ in range(60)), f"l{lang}", "s", 1))
            k += 1
    han = [chr(c) for c in range(0x4E00, 0x4E00 + 5000)]
    for part in (0, 1):  # two languages of 2,500 letters each, in words of one to four letters
        letters = han[part * 2500 : part * 2500 + 2500]
        words = ["".join(random.choices(letters, k=random.randrange(1, 5))) for _ in range(400)]
        for _ in range(6):
            rows.append((k, "".join(random.choices([*words, *letters], [5] * 400 + [0.2] * 2500, k=1000)), f"han{part}", "s", 1))
            k += 1
    rows.append((k, "word " * 5000, "long", "s", 1))
    docs = spark.createDataFrame(rows, DOCS)
    got = {r["doc_id"]: r["lang_pred"] for r in langid.identify_languages(docs, learn=F.col("doc_id") % 4 != 1).collect()}
    assert [(i, got[i], lang) for i, _, lang, *_ in rows if got[i] != lang] == []


def test_full_and_sorted_phrase_tables_agree():
    import numpy as np

    random.seed(42)
    nxt = langid.suffix_automaton([random.choice([0, 2, 3, 4]) for _ in range(300)])
    full, found = langid.PhraseTable(nxt, 6), langid.PhraseTable(nxt, 6, full_entries=0)
    state, symbol = np.array([random.randrange(len(nxt)) for _ in range(500)]), np.array([random.randrange(6) for _ in range(500)])
    assert found.full is None and all((a == b).all() for a, b in zip(full.step(state, symbol), found.step(state, symbol)))


def test_chat_reads_larger_and_odd_records(spark):
    deep = "[" * 100_000 + "]" * 100_000
    records = [
        json.dumps({"messages": [{"role": "user", "content": "a", "name": "x"}], "id": 1}), json.dumps({"messages[]": {"role": "a", "content": "b"}}), deep, "[1]", json.dumps({"messages": "x"}),
        json.dumps({"messages": [{"role": "user", "content": "a"}, 7]}), json.dumps({"prompt": "p" * 1_000_000, "response": "r", "score": 2}),
    ]
    rows = chat.format_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [chat.read_turns(r["formatted"]) for r in rows] == [[("user", "a")], [], [], [], [], [("user", "a")], [("user", "p" * 1_000_000), ("assistant", "r")]]
    turns = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert chat.read_back(chat.format_records(chat.conversation_records(turns))).count() == 0


def test_conversations_take_several_layouts(spark):
    rows = [(c, t, "user" if t % 2 == 0 else "assistant", f"{c} {t}") for c in range(6) for t in range(2 + c // 2)]
    out = chat.format_records(chat.conversation_records(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    assert len({r["layout"] for r in out}) == 3
    for r in out:
        assert chat.read_turns(r["formatted"]) == [(x[2], x[3]) for x in rows if x[0] == r["conv_id"]]


def test_extraction_keeps_the_article_whole_and_stays_linear(spark):
    assert wrapper.main_text("<article><p>Let <math>x</math> be</p><p class='lead comment'>lead</p><div class=comment>c</div></article>") == "Let x be\n\nlead"
    assert wrapper.main_text("<div>" * 300 + "<p>deep</p>" + "<div class=advert>buy</div>") == "deep"
    for piece in ('<a href="', "<a b='", "<a ", "<p class=x", "&amp;<", '"<b '):
        began = time.time()
        wrapper.main_text("<p>text</p>" + piece * 40_000)
        assert time.time() - began < 10
    rows = [(1, None, None), (1, "http://h.com/1", "<p>" + "long " * 200_000)] * 3
    got = wrapper.extract_main_text(spark.createDataFrame([(*r, "x", 1) for r in rows], PAGES + ", tree_id string, host int")).collect()
    assert len(got) == 6 and wrapper.extract_main_text(spark.createDataFrame([], PAGES)).count() == 0


def test_the_wrapper_decides_where_labels_say_nothing(spark):
    """Menus and notices in plain elements, no article: only the alignment of the host's pages tells them apart."""
    random.seed(43)
    words = lambda n: " ".join("".join(random.choice("abcdefgh") for _ in range(6)) for _ in range(n))
    body = [(words(3), words(40), words(30)) for _ in range(12)]
    page = lambda h, a, b: f"<body><div><div>Home</div><div>All our offers of the week</div></div><div><h1>{h}</h1><p>{a}</p><p>{b}</p></div><div><p>Write to us at any time, we answer</p></div></body>"
    docs = spark.createDataFrame([(k, f"http://h.com/{k}", page(*x)) for k, x in enumerate(body)], PAGES)
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(docs).collect()}
    alone = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(docs, min_pages=100).collect()}
    assert all(got[k] == "\n\n".join(x) for k, x in enumerate(body)) and all("offers" in alone[k] for k in alone)


def brute_match(a, b, i=0, j=0):
    """The size of a largest order-preserving alignment, by trying all ways."""
    if a.labels[i] != b.labels[j]:
        return 0

    def best(x, y):
        if not x or not y:
            return 0
        return max(best(x[1:], y), best(x, y[1:]), (brute_match(a, b, x[0], y[0]) + best(x[1:], y[1:])) if a.labels[x[0]] == b.labels[y[0]] else 0)

    return 1 + best(a.children[i], b.children[j])


def test_tree_matching_agrees_with_all_alignments():
    random.seed(44)
    tree = lambda n: wrapper.Tree(["r", *(random.choice("ab") for _ in range(n))], [-1, *(random.randrange(k + 1) for k in range(n))])
    for _ in range(60):
        a, b = tree(random.randrange(7)), tree(random.randrange(7))
        assert len(wrapper.tree_match(a, b)) == brute_match(a, b)


def test_a_million_characters_are_scanned_for_secrets(spark):
    texts = ["g" * 1_000_000, "gz1" * 300_000, "word " * 200_000, "x" * 19 + " " + "deadbeefdeadbeef " * 20_000]
    began = time.time()
    got = secrets.scan_secrets(spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)).orderBy("doc_id").collect()
    assert time.time() - began < 90 and [len(r["base"]) for r in got] == [0, 0, 0, 20_000] and len(got[1]["spans"]) == 1


def test_many_repositories_make_an_example(spark):
    rows = [(i, "key zq8Kd02LmX77PpQ41vBn" + (" and Hw55tRk19aaPQmz83Lx0" if i < 9 else ""), "en", "one", 1) for i in range(12)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert [len(got[i]["spans"]) for i in range(12)] == [1] * 9 + [0] * 3


def test_negated_and_reported_insults_are_learned_as_harmless(spark):
    """Documents that differ in the context of one word alone."""
    random.seed(45)
    words = lambda n: " ".join("".join(random.choice("aeioumnrst") for _ in range(5)) for _ in range(n))
    rows, labels = [], []
    for i in range(900):
        kind = i % 6
        middle = {0: "you vilewort", 1: "not a vilewort", 2: "he said that vilewort"}.get(kind, words(3))
        rows.append((i, f"{words(20)}. {middle}. {words(15)}", "en", "s", 1))
        labels.append((i, 1, int(kind == 0)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, lab, learn=F.col("doc_id") % 5 != 0).join(lab, "doc_id").where("doc_id % 5 = 0").collect()
    assert all((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out)


CLASH = DOCS + ", p_key int, p_live int, row_key string, row_check int, live_spans int, key int, check int, s int, d_id int, root int"


def test_stages_keep_columns_with_their_own_names(spark, tmp_path):
    random.seed(46)
    words = lambda n: " ".join("".join(random.choice("abcdefghijkl") for _ in range(6)) for _ in range(n))
    texts = [words(60) for _ in range(8)] + [words(20_000), None, ""]
    texts += [texts[0], texts[1] + " x", texts[2] + " password=abcdefgh12345678"]
    rows = [(i, t, "en", "s", 1, *range(2), "k", *range(7)) for i, t in enumerate(texts)]
    spark.createDataFrame([(0, "nothing of the kind stands in any document here")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    for docs in (spark.createDataFrame(rows, CLASH), spark.createDataFrame([], CLASH)):
        for stage in (stages.quality_stage, stages.near_duplicate_stage, stages.decontamination_stage, stages.secret_stage):
            docs = spark.createDataFrame(stage(spark, docs, str(tmp_path)).collect(), CLASH)
            assert docs.columns == spark.createDataFrame([], CLASH).columns
        kept = {r["doc_id"]: r["text"] for r in docs.collect()}
        if kept:
            assert set(kept) >= set(range(3, 9)) and len({0, 11} & set(kept)) == len({1, 12} & set(kept)) == len({2, 13} & set(kept)) == 1
            assert not any("abcdefgh12345678" in t for t in kept.values())
        assert stages.packing_stage(spark, docs, str(tmp_path)).count() >= len(kept)


def test_other_operators_on_odd_rows(spark):
    pages = spark.createDataFrame([(1, "http://" + "a." * 400 + "com/" + "x" * 100_000, None)] * 2 + [(None, None, None)], PAGES)
    assert url_cascade.filter_urls(pages).count() == 3
    docs = spark.createDataFrame([(1, "word " * 200_000, None, None, 1), (None, None, None, None, None)], DOCS)
    assert quality.judge_quality(docs, keep=("doc_id",)).count() == 2 and simhash_bk.near_duplicates(docs).count() == 2
    assert decontam.contaminated(docs, spark.createDataFrame([(1, "word word word")], "item_id long, text string")).count() == 1
