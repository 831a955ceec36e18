"""Cases of the review's first round in which an operator did less than its whole job."""

import random
import re

import pytest

pytest.importorskip("quireflow.llm")
from quireflow.llm import shingle_join, wrapper  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n):
    return ["".join(random.choice("abcdefghijklmn") for _ in range(7)) for _ in range(n)]


def brute_near_copies(texts):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").lower())
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(texts)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, x in enumerate(sets):
        for j in range(i):
            o = len(x & sets[j])
            if x == sets[j] or o >= 0.8 * (len(x | sets[j])):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def test_near_copies_are_those_of_equal_shingles(spark):
    """A block of new words, pairs of .3 to .8, the same words in another order, a common passage, a large group."""
    import corpus_pipeline

    random.seed(21)
    texts, common = [None, "", "a b", "a b", "A  B", "a b c"], words(60)
    for _ in range(12):
        w = words(80)
        texts.append(" ".join(w))
        for block in (8, 16, 19, 24, 60):
            at = random.randrange(80)
            texts.append(" ".join(w[:at] + words(block) + w[at:]))
        texts += [" ".join(words(16) + w), " ".join(w + words(16)), " ".join(w[40:] + w[:40]), " ".join(random.sample(w, 80)), " ".join(common + w)]
        texts += [" ".join(common + words(20)) for _ in range(3)]
    w = words(200)
    for k in range(60):
        texts.append(" ".join(x if random.random() > (0.01 if k % 3 else 0.04) else words(1)[0] for x in w))
    docs = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in enumerate(texts)], DOCS)
    got = {r["doc_id"]: r["component_id"] for r in shingle_join.near_copies(docs).collect()}
    want = brute_near_copies(texts)
    assert [got[i] for i in range(len(texts))] == want and len(set(want)) < len(want) - 60
    kept = corpus_pipeline.near_duplicate_stage(spark, docs, "")
    assert kept.count() == len(set(want)) and shingle_join.near_copies(docs.limit(0)).count() == 0


def test_headline_and_lead_beside_a_body_stay(spark):
    def page(k, tag):
        body = "".join(f"<p>{' '.join(words(40))} {k}</p>" for _ in range(3))
        return f"<body><div>Our site</div><{tag}><h1>Head {k}</h1><p class=lead>Lead {k}</p><div class=body><div>{body}</div></div><section><p>More {k}</p></section></{tag}></body>"

    random.seed(22)
    rows = [(k, f"http://{tag}.com/{k}", page(k, tag)) for tag in ("article", "div") for k in range(8)]
    got = wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    for r in got:
        parts, k = r["text"].split("\n\n"), r["page_id"]
        assert len(parts) == 6 and parts[:2] == [f"Head {k}", f"Lead {k}"] and parts[-1] == f"More {k}"


def test_empty_and_odd_pages_leave_the_template(spark):
    page = lambda k, first="Our site, since ever": f"<body><div>{first}</div><div class=content><h1>Head {k}</h1><p>Text of {k}</p></div></body>"
    html = [page(k) for k in range(20)] + [None, "", "<body>", "<ul><li>another layout</ul>", page(24, "Text of its own")]
    rows = [(k, f"http://h.com/{k}", x) for k, x in enumerate(html)]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Head {k}\n\nText of {k}" for k in range(20))
    assert got[20] == got[21] == got[22] == "" and got[23] == "another layout" and got[24] == "Text of its own\n\nHead 24\n\nText of 24"
