"""Each corpus operator against a brute-force version, a round trip or planted cases, and on hostile rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

pytest.importorskip("quireflow.llm")
from quireflow.llm import chat, common, decontam, langid, packing, quality, queries, secrets, simhash_bk, toxicity, url_cascade, wrapper  # noqa: E402

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def documents(spark, texts, **columns):
    rows = [(i, t, columns.get("lang", "en"), f"s{i % 3}", len(t or "")) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


HOSTILE = [None, "", " \t\n ", "one", "é" * 5, "a b c d", "a b c d", "x" * 30_000, "<|endoftext|> 你好 \U0001f600 token=" + "k9" * 10]


def hostile(spark):
    """Nulls, empties, ties, repeats, a long text, and columns whose names operators use inside."""
    rows = [(i % 8 if i else None, t, None if i % 2 else "en", None if i % 3 == 0 else "s", None, 1, 2, 3) for i, t in enumerate(HOSTILE)]
    return spark.createDataFrame(rows, DOCS + ", q_words int, hash int, k_0 int")


def empty(spark):
    return spark.createDataFrame([], DOCS)


# --- packing


def test_packing_gives_every_id_once(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = packing.pack_documents(docs, block_tokens=20_000).collect()
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(packing.vocabulary_path())
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for r in rows:
        by_doc[r["doc_id"]].append(r)
        by_seq[r["sequence_id"]].append(r)
    for d in docs.collect():
        want = np.array([*t.encode(d["text"] or "", add_special_tokens=False).ids, 1], dtype="<u4")
        pieces = sorted(by_doc[d["doc_id"]], key=lambda r: r["start"])
        assert [r["start"] for r in pieces] == list(np.cumsum([0, *[r["length"] for r in pieces]])[:-1])
        assert b"".join(bytes(r["ids"]) for r in pieces) == want.tobytes() and all(r["doc_tokens"] == len(want) for r in pieces)
    for pieces in by_seq.values():
        pieces.sort(key=lambda r: r["offset"])
        assert [r["offset"] for r in pieces] == list(np.cumsum([0, *[r["length"] for r in pieces]])[:-1])
        n = sum(r["length"] for r in pieces)
        assert n <= 2048 and (n == 2048 or n & (n - 1) == 0)


def test_packing_balances_cost():
    items = [(k, np.zeros(n), 0, n) for k, n in enumerate([900, 800, 700, 600, 500, 300, 200, 96])]
    bins, over = packing.fill(items, [2048, 2048], 1.0, 1 / 1024)
    cost = [sum(x[3] + x[3] ** 2 / 1024 for x in b) for b in bins]
    assert not over and sum(x[3] for b in bins for x in b) == 4096 and abs(cost[0] - cost[1]) < 0.2 * max(cost)


def test_packing_of_hostile_rows(spark):
    rows = packing.piece_digests(packing.pack_documents(hostile(spark))).collect()
    one = zlib.crc32(np.array([1], dtype="<u4").tobytes())
    assert sum(r["doc_tokens"] == 1 and r["ids_crc32"] == one for r in rows) == 2
    assert sum(r["start"] == 0 for r in rows) == len(HOSTILE)
    assert packing.pack_documents(empty(spark)).count() == 0


# --- urls


def test_cascade_is_exact_on_its_universe(spark):
    random.seed(3)
    keys = [f"h{k}.example.{random.choice(['com', 'net'])}" for k in range(3000)]
    listed = set(random.sample(keys, 400))
    universe = spark.createDataFrame([(k, k in listed) for k in set(keys)], "key string, listed boolean")
    cascade = url_cascade.Cascade.build(universe, bits_per_key=3.0, hashes=2)
    assert len(cascade.levels) > 2
    got = universe.select("key", "listed", cascade.holds(F.col("key")).alias("held")).collect()
    assert all(r["held"] == r["listed"] for r in got)


def test_url_rules_and_parts(spark):
    urls = ["https://A.Example.COM/en/7x?q=1", "http://b.com/en/8", "http://com/en/", "http://x.example.net/de/81#f", "http://net/de/1", "http://notnet/de/1", "x.com/en/", None, "", "a://org?x", "ftp://w.org/es/", "http://www.cheap-pills.org/x"]
    pages = spark.createDataFrame([(i, u, 1) for i, u in enumerate(urls)], "page_id long, url string, key int")
    got = [(r["host"], r["path"], r["rule"], r["verdict"]) for r in url_cascade.filter_urls(pages).orderBy("page_id").collect()]
    assert got == [
        ("a.example.com", "/en/7x", "example.com/en/7", "allow"), ("b.com", "/en/8", "com/en/", "block"), ("com", "/en/", "com/en/", "block"), ("x.example.net", "/de/81", "example.net/de/8", "block"),
        ("net", "/de/1", "net/de/", "allow"), ("notnet", "/de/1", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("", "", None, "allow"), ("org", "", None, "allow"),
        ("w.org", "/es/", "org/es/", "block"), ("www.cheap-pills.org", "/x", None, "block"),
    ]
    listed = spark.createDataFrame([("B.com",)], "key string")
    for size in (4 << 20, 0):  # by the cascade, and by joins beyond the bound
        got = {r["page_id"]: r["listed"] for r in url_cascade.filter_urls(pages, listed, max_filter_bytes=size).collect()}
        assert got[1] and sum(got.values()) == 1
    assert url_cascade.filter_urls(pages.limit(0)).count() == 0


# --- secrets


def brute_base(text):
    found = []
    for kind, pattern, group, least in (("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12), ("access", "AKIA[A-Z0-9]+", 0, 18), ("hex", "[0-9a-f]+", 0, 16)):
        for m in re.finditer(pattern, text):
            if len(m[group]) >= least:
                found.append((m.start(), ("assign", "access", "hex").index(kind), kind, m.end()))
    return sorted(found)


SECRETS = [
    "password=abcdefghijkl token: 'short' x", 'API_KEY = "0123456789abcdef0123"', "é token=secret=abcdefghijklmnop \U0001f600 AKIA" + "Q" * 14, "AKIAAKIA" + "B" * 20 + " deadbeefdeadbeefdeadbeef", "token=password: abcdefghijklmnopq", "AKIASHORT1",
    "Secret:deadbeefdeadbeef00", None, "", "nothing here",
]


def test_base_spans_agree_with_a_scan(spark):
    docs = documents(spark, SECRETS)
    rows = {r["doc_id"]: r for r in secrets.scan_secrets(docs).collect()}
    for i, t in enumerate(SECRETS):
        assert [(s["start"], s["rank"], s["kind"], s["end"]) for s in rows[i]["base"]] == brute_base(t or "")


def test_ownership_separates_examples(spark):
    shared, own = "zq8Kd02LmX77PpQ41vBn", "Hw55tRk19aaPQmz83Lx0"
    rows = [(i, f"see {shared} here" + (f" and {own}" if i == 0 else ""), "en", f"o{i % 5}", 1) for i in range(20)]
    got = {r["doc_id"]: r for r in secrets.scan_secrets(spark.createDataFrame(rows, DOCS)).collect()}
    assert [s["kind"] for s in got[0]["live"]] == ["opaque"] and all(not got[i]["spans"] for i in range(1, 20))
    text = spark.createDataFrame([("abcdef", [(1, 3), (2, 4)])], "t string, s array<struct<start:bigint,end:bigint>>")
    assert text.select(secrets.redact(F.col("t"), F.col("s"), "#")).first()[0] == "a#ef"
    assert secrets.scan_secrets(hostile(spark)).count() == len(HOSTILE) and secrets.scan_secrets(empty(spark)).count() == 0


# --- near duplicates


def brute_print(text, size=4):
    import xxhash

    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(low)
    if not w:
        return 0
    hs = [xxhash.xxh64_intdigest(" ".join(w[k : k + size]), 42) for k in range(max(1, len(w) - size + 1))]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_near_copies(texts, size=5, threshold=0.8):
    """The smallest index that links of shingle similarity reach, by all pairs."""
    sets = []
    for t in texts:
        w = WORD.findall((t or "").lower())
        sets.append({tuple(w[k : k + size]) for k in range(max(1, len(w) - size + 1))} if w else set())
    linked = lambda x, y: x == y or len(x & y) >= threshold * len(x | y)
    root = list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            if root[i] != root[j] and linked(sets[i], sets[j]):
                a, b = sorted((root[i], root[j]))
                root = [a if r == b else r for r in root]
    return root


def brute_components(prints, radius=4):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


@pytest.mark.parametrize("limit", [4096, 4])
def test_near_duplicates_agree_with_all_pairs(spark, limit):
    random.seed(5)
    base = [" ".join(random.choice("abcdefghijklmnop") * 2 for _ in range(120)) for _ in range(12)]
    texts = list(HOSTILE) + base
    for t in base[:4]:
        for _ in range(10):
            w = t.split()
            w[random.randrange(len(w))] = "new"
            texts.append(" ".join(w))
    got = {r["doc_id"]: r for r in simhash_bk.near_duplicates(documents(spark, texts), shard_limit=limit).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_components(prints)
    low = {r: min(i for i, x in enumerate(roots) if x == r) for r in roots}
    for i, p in enumerate(prints):
        assert got[i]["fp"] & (1 << 64) - 1 == p and got[i]["component_id"] == low[roots[i]]
    assert simhash_bk.near_duplicates(hostile(spark)).count() == len(HOSTILE) and simhash_bk.near_duplicates(empty(spark)).count() == 0


def test_vocabulary_prints_catch_what_shingles_of_five_agree_on(spark):
    random.seed(11)
    word = lambda: "".join(random.choice("abcdefghijklmn") for _ in range(7))
    base = [[word() for _ in range(300)] for _ in range(15)]
    texts, group = [], []
    for g, w in enumerate(base):
        texts.append(" ".join(w))
        group.append(g)
        for _ in range(3):
            c = list(w)
            for _ in range(4):
                c[random.randrange(300)] = word()
            texts.append(" ".join(c))
            group.append(g)
    got = {r["doc_id"]: r["component_id"] for r in simhash_bk.near_duplicates(documents(spark, texts), radius=7, features="vocabulary").collect()}
    assert all(got[i] == 4 * g for i, g in enumerate(group))


def test_chains_of_prints_are_one_component(spark):
    chain = [(1 << (3 * k)) - 1 for k in range(20)]
    links = simhash_bk.shard_links(chain, 4)
    assert {b for _, b in links} == {chain[0]} and len(links) == 19
    edges = spark.createDataFrame([(k, k + 1) for k in range(60)] + [(100, 101), (7, 7)], "a long, b long")
    got = dict(tuple(r) for r in common.components(edges).collect())
    assert all(got[k] == 0 for k in range(1, 61)) and got[101] == 100
    for extra in (1, 2, 3):
        masks = simhash_bk.block_masks(4, extra)
        for _ in range(200):
            a = random.getrandbits(64)
            b = a
            for bit in random.sample(range(64), 4):
                b ^= 1 << bit
            assert any(a & m == b & m for m in masks)


# --- chat


def test_chat_round_trip(spark):
    turns = [("user", "\\### Assistant: </turn> ok"), ("assistant", "a\n### b\\"), ("odd\n<role>", ""), ("assistant", "\U0001f600é")]
    text, loss = chat.format_turns(turns)
    assert chat.read_turns(text) == turns and [chat.unescape(text[a:b]) for a, b in loss] == ["a\n### b\\", "\U0001f600é"]
    records = ['{"prompt":"p","response":"r"}', '{"conversations":[{"from":"human","value":"h"},{"from":"gpt","value":"g"}]}', '{"instruction":"i","input":"x","output":"o"}', '{"odd":1}', None, "not json"]
    rows = chat.format_records(spark.createDataFrame(list(enumerate(records)), "conv_id long, record string")).orderBy("conv_id").collect()
    assert [chat.read_turns(r["formatted"]) for r in rows] == [[("user", "p"), ("assistant", "r")], [("user", "h"), ("assistant", "g")], [("user", "i\n\nx"), ("assistant", "o")], [], [], []]
    assert rows[0]["layout"] != rows[1]["layout"]


def test_chat_rows_by_turn(spark):
    rows = [(1, 1, "assistant", "b", 0), (1, 0, "user", None, 0), (None, None, None, None, 0), (1, 1, "assistant", "b", 0)]
    t = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, record int")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_records(chat.conversation_records(t))).collect()}
    assert got[1]["n_turns"] == 3 and got[1]["loss_chars"] == 2 and got[1]["loss_sha256"] == hashlib.sha256(b"bb").hexdigest()
    assert got[1]["turns_sha256"] == hashlib.sha256(b"user\n\nassistant\nb\nassistant\nb\n").hexdigest() and got[None]["n_turns"] == 1


# --- languages


def test_phrases_agree_with_greedy_parsing():
    random.seed(1)
    model = langid.Model({"x": "".join(random.choice("abc ") for _ in range(300)), "y": "".join(random.choice("abd ") for _ in range(300))}, block=50)
    for _ in range(20):
        text = "".join(random.choice("abcdz ") for _ in range(170))
        s = model.symbols(text)
        got = model.phrases([s])[0]
        for j, lang in enumerate(model.langs):
            trained = bytes(x for x in model_train(model, lang))
            n = 0
            for b in range(0, len(s), 50):
                block, at = bytes(s[b : b + 50]), 0
                while at < len(block):
                    k = 0
                    while at + k < len(block) and block[at : at + k + 1] in trained:
                        k += 1
                    at, n = at + max(1, k), n + 1
            assert got[j] == n


TRAINED = {}


def model_train(model, lang):
    if not TRAINED:
        random.seed(1)
        for name, letters in (("x", "abc "), ("y", "abd ")):
            TRAINED[name] = "".join(random.choice(letters) for _ in range(300))
    return [c for c in model.symbols(TRAINED[lang]).tolist() if c != langid.UNKNOWN]


def test_languages_on_held_out_rows(spark):
    out = queries.op6_cross_parsing(spark, "/root/testdata/sf0.01")
    lang = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "lang")
    right = out.join(lang, "doc_id").where("held_out").agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.97
    got = langid.identify_languages(hostile(spark)).collect()
    assert len(got) == len(HOSTILE) and sum(r["lang_pred"] == "und" for r in got) == 3 and all(0 <= r["score"] <= 1 for r in got)
    assert langid.identify_languages(empty(spark)).count() == 0


# --- quality


def brute_quality(text):
    w = WORD.findall(text or "")
    at = defaultdict(list)
    for k in range(len(w) - 4):
        at[tuple(w[k : k + 5])].append(k)
    covered = {p for ks in at.values() if len(ks) > 1 for k in ks for p in range(k, k + 5)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_counts_agree_with_a_scan(spark):
    random.seed(2)
    texts = HOSTILE + ["a b c d e a b c d e f", "x x x x x x x", "l\nl\n \nl", "#*$ <b>& |"] + [" ".join(random.choice("abc") for _ in range(random.randrange(60))) for _ in range(40)]
    got = {r["doc_id"]: r for r in quality.judge_quality(documents(spark, texts), keep=("doc_id",)).collect()}
    for i, t in enumerate(texts):
        r = got[i]
        want = brute_quality(t)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, (i, t)
        assert r["base_failed"] == (want[0] < 10 or 100 * want[4] > 20 * want[0]) and not (r["base_failed"] and r["kept"])
    assert quality.judge_quality(hostile(spark)).count() == len(HOSTILE) and quality.judge_quality(empty(spark)).count() == 0


def test_quality_keeps_clean_and_drops_junk(spark):
    sf = "/root/testdata/sf0.01"
    o = queries.op7_quality_divergence(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("not base_failed")
    n = {(r[0], r[1]): r[2] for r in o.groupBy("quality", "kept").count().collect()}
    assert n.get((1, False), 0) <= 0.01 * n[1, True] and n.get((0, False), 0) >= 0.7 * (n.get((0, False), 0) + n.get((0, True), 0))


# --- html


def test_main_text_and_template(spark):
    page = lambda k: f"<html><head><title>t</title></head><body><nav><a href=/x>x{k}</a></nav><div>Our site, since ever</div><div class='content'><h1>Head {k}</h1><p>One {k} &amp; two<br>three <b>four</b><p>Five\n  {k}</div><form>f</form><div class=\"ad box\">buy {k}</div><!-- c --><script>if (a < b) {{}}</script><footer>&copy; {k}</footer></body></html>"
    rows = [(k, f"http://h.com/{k}", page(k)) for k in range(8)] + [(90, "http://o.com/", page(90)), (91, None, None), (92, "x", ""), (93, "http://p.com", "<p>a<p>b &lt;c&gt;</p>tail<div>d")]
    got = {r["page_id"]: r["text"] for r in wrapper.extract_main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    for k in range(8):
        assert got[k] == f"Head {k}\n\nOne {k} & two three four\n\nFive {k}"
    assert got[90].startswith("Our site, since ever\n\nHead 90") and got[91] == "" and got[92] == "" and got[93] == "a\n\nb <c>\n\ntail\n\nd"


def test_deep_and_broken_markup():
    assert wrapper.main_text("<div>" * 3000 + "deep") == "deep"
    assert wrapper.main_text("<p>a</b></p></div><p>b<") == "a\n\nb<"
    a = wrapper.fold(wrapper.parse("<body><ul><li>a<li>b</ul><p>x</p><p>y</p></body>")[0])
    assert a.labels == ["#root", "body", "ul", "li", "p"]
    b = wrapper.Tree.of("-1 #root\n0 body\n1 nav\n1 ul\n3 li\n1 p")
    assert wrapper.tree_match(a, b) == {0: 0, 1: 1, 2: 3, 3: 4, 4: 5}


# --- decontamination


def test_contamination_agrees_with_containment(spark):
    random.seed(4)
    word = lambda: "".join(random.choice("abcdef") for _ in range(4))
    items = [" ".join(word() for _ in range(n)) for n in (5, 9, 16, 30, 60, 130, 3, 1)] + [None, ""]
    texts = list(HOSTILE)
    for k in range(60):
        body = [word() for _ in range(random.choice([0, 40, 700]))]
        w = (items[k % 8] or "").split()
        if k % 3 and len(w) > 12:
            w[random.randrange(len(w))] = "other"
        at = random.randrange(len(body) + 1)
        texts.append(" ".join(body[:at] + [x.upper() for x in w] + body[at:]))
    bench = spark.createDataFrame([(i, t, 7) for i, t in enumerate(items)], "item_id long, text string, doc_id int")
    want = set()
    for i, t in enumerate(texts):
        for j, q in enumerate(items):
            qw, dw = WORD.findall((q or "").lower()), WORD.findall((t or "").lower())
            n = min(5, len(qw))
            a, b = decontam.shingles(qw, n) if n else set(), decontam.shingles(dw, n) if n else set()
            if a and len(a & b) >= 0.8 * len(a):
                want.add((i, j))
    for size in (16 << 20, 100):  # one block, and several
        got = {(r["doc_id"], r["item_id"]) for r in decontam.contaminated(documents(spark, texts), bench, block_bytes=size).collect()}
        assert got == want and len(want) > 30
    assert decontam.contaminated(empty(spark), bench).count() == 0 and decontam.contaminated(hostile(spark), bench.limit(0)).count() == 0


# --- toxicity


def test_grammar_transducers():
    assert toxicity.patterns(list("N.I")) == ["N", ".", "n"] and toxicity.patterns(list("TI")) == ["T", "J"] and toxicity.patterns(list("I.T")) == ["J", ".", "T"]
    assert toxicity.patterns(list("R....I")) == ["R", ".", ".", ".", ".", "r"] and toxicity.patterns(list("N....I")) == ["N", ".", ".", ".", ".", "I"]
    g = toxicity.Grammar({"idiot": 1.0}, {"lowe": 1.0}, dict(toxicity.PATTERNS), 1.0)
    assert g.score("You idiot.") > g.score("An idiot.") > g.score("He said idiot") > g.score("not an idiot") > g.score("a fine day") and g.score(None) == g.score("")
    assert g.matches("Loweische. lowe") == [("I", 1.0)]


def test_toxicity_learns_and_holds(spark):
    random.seed(6)
    word = lambda: "".join(random.choice("aeioumnrst") for _ in range(5))
    rows, labels = [], []
    for i in range(600):
        bad = i % 6 == 0
        w = [word() for _ in range(40)]
        if bad:
            for s in (random.choice(["vilewort", "gnarlo" + word()[:3]]) for _ in range(3)):
                w[random.randrange(40)] = s
        rows.append((i, " ".join(w), "en", "s", 1))
        labels.append((i, 1, int(bad)))
    docs, lab = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    out = toxicity.score_toxicity(docs, lab, learn=F.col("doc_id") % 5 != 0).join(lab, "doc_id").where("doc_id % 5 = 0").collect()
    assert sum((r["score"] >= 0.5) == (r["toxic"] == 1) for r in out) >= 0.97 * len(out)
    assert toxicity.score_toxicity(hostile(spark), lab).count() == len(HOSTILE) and toxicity.score_toxicity(empty(spark), lab.limit(0)).count() == 0


# --- pipeline


def test_pipeline_agrees_with_its_stages_by_hand(spark, tmp_path):
    import corpus_pipeline

    random.seed(8)
    base = spark.read.parquet(f"{SF}/documents.parquet").limit(60).collect()
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    item = bench.first()["text"]
    rows = [tuple(r) for r in base]
    rows += [(1000, base[1]["text"], base[1]["lang"], "s", 1), (1001, base[1]["text"] + " tail", base[1]["lang"], "s", 1), tuple(base[2]), (1002, "too short", "en", "s", 9)]
    rows += [(1003, base[3]["text"] + " " + item, base[3]["lang"], "s", 1), (1004, base[4]["text"] + " password=abcdefgh12345678", base[4]["lang"], "s", 1)]
    rows += [(None, None, None, None, None), (1005, "", None, None, None)]
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    bench.write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    seen = []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        after = stage(spark, kept, str(tmp_path)).collect()
        before = [tuple(r) for r in kept.collect()]
        seen.append((before, [tuple(r) for r in after]))
        kept = spark.createDataFrame(after, DOCS)
    fails = lambda t: (lambda q: q[0] < 10 or 100 * q[4] > 20 * q[0])(brute_quality(t))
    before, after = seen[0]
    assert all(not fails(r[1]) for r in after) and not Counter(after) - Counter(before)
    before, after = seen[1]
    groups = brute_near_copies([r[1] for r in before])
    assert len(after) == len(set(groups)) and not Counter(after) - Counter(before)
    before, after = seen[2]
    items = [WORD.findall(r["text"].lower()) for r in bench.collect()]
    clean = [r for r in before if all(len((a := decontam.shingles(q, 5)) & decontam.shingles(WORD.findall(r[1].lower()), 5)) < 0.8 * len(a) for q in items)]
    assert Counter(after) == Counter(clean)
    before, after = seen[3]
    assert len(after) == len(before) and not any("abcdefgh12345678" in r[1] for r in after) and all(r[4] == len(r[1]) for r in after if "[secret]" in r[1])
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in got} == {r[0] for r in after} and sum(r["length"] for r in got) == sum({r["doc_id"]: r["doc_tokens"] for r in got}.values())
