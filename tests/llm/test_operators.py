"""Text operators against brute force, exact round trips or held-out accuracy."""

import hashlib
import random
import re
from itertools import combinations

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer
from xxhash import xxh64_intdigest

import corpus_pipeline
from stridelake.llm import bpe, decontaminate, exact_dedup, html_text, line_dedup, quality, simhash, substring_dedup, toxicity, url_filters
from stridelake.llm.common import min_reachable
from stridelake.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SPACE = re.compile(rb"[^\x20\x09-\x0D]+")


def rows(table, sf=SF):
    return duckdb.connect().execute(f"select * from '{sf}/{table}.parquet' order by 1").fetchall()


def run(spark, key, sf=SF):
    return QUERIES[key][0](spark, sf).collect()


def near_texts(n=120, seed=3):
    """Texts of a few families, each varied by single words, so fingerprints are near."""
    rng = random.Random(seed)
    vocabulary = [f"{a}{b}" for a in "bcdfghjklm" for b in ("an", "en", "ir", "ost", "ul")]
    out = []
    for k in range(n):
        words = [rng.choice(vocabulary) for _ in range(300)] if k % 12 == 0 else list(base)  # noqa: F821
        base = words if k % 12 == 0 else base  # noqa: F821
        if k % 12:
            for _ in range(rng.randrange(3)):
                words[rng.randrange(300)] = rng.choice(vocabulary)
        out.append((k, " ".join(words)))
    return out


def fingerprint(text):
    words = SPACE.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in text.encode()))
    grams = [b" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    return sum(1 << b for b in range(64) if 2 * sum(xxh64_intdigest(g, 42) >> b & 1 for g in grams) > len(grams))


def components(prints):
    """doc_id → smallest reachable doc_id, by comparing all pairs."""
    up = {i: i for i in prints}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            up[y] = x
    return {i: root(i) for i in up}


def test_simhash_query(spark):
    prints = {d[0]: fingerprint(d[1]) for d in rows("documents")}
    want = components(prints)
    got = run(spark, "op1_simhash_near_dedup")
    assert {r.doc_id: (r.fingerprint, r.component_id) for r in got} == {i: (f"{prints[i]:016x}", want[i]) for i in prints}


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_simhash_links_in_blocks(spark, block):
    texts = near_texts()
    prints = {i: fingerprint(t) for i, t in texts}
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.classes(docs, block).collect()}
    assert got == components(prints)
    assert 10 <= len(set(got.values())) < 120


def test_simhash_links_every_bit_pattern(spark):
    """All pairs within 4 bits are found wherever the differing bits lie."""
    rng = random.Random(5)
    base = [rng.getrandbits(64) for _ in range(60)]
    prints = list(dict.fromkeys(base + [b ^ sum(1 << k for k in rng.sample(range(64), 4)) for b in base]))
    signed = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"), 2)
    got = {r.node: r.component for r in min_reachable(edges).collect()}
    want = components(dict(enumerate(prints)))
    assert {i: got.get(i, i) for i in want} == want


def test_simhash_dense_bucket_needs_no_pairs(spark):
    """Hundreds of fingerprints in one bucket: as many links as nodes, not as pairs."""
    prints = [0] + [(1 << a) | (1 << b) for a in range(22, 64) for b in range(a)]
    signed = [(int(np.uint64(p).astype(np.int64)), i) for i, p in enumerate(prints)]
    edges = simhash.links(spark.createDataFrame(signed, "fp long, rep long"))
    assert edges.count() < 50 * len(prints)
    assert {r.component for r in min_reachable(edges).collect()} == {0}


def test_components_of_long_paths(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 90), (90, 95), (7, 7)]
    got = {r.node: r.component for r in min_reachable(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{i: 0 for i in range(1, 41)}, 100: 90, 95: 90}


def test_bpe_query(spark):
    own = Tokenizer.from_file(bpe.default_path())
    docs = rows("documents")
    enc = own.encode_batch([d[1] for d in docs], add_special_tokens=False)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {d[0]: (len(e.ids), sha(",".join(map(str, e.ids))), sha(own.decode(e.ids, skip_special_tokens=False))) for d, e in zip(docs, enc, strict=True)}
    assert {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in run(spark, "op2_bpe_encode_decode")} == want


def test_bpe_on_odd_texts():
    own, t = Tokenizer.from_file(bpe.default_path()), bpe.Transducer(bpe.default_path())
    rng = random.Random(2)
    texts = ["", "<|endoftext|>", "a <|endoftext|>b<|endoftext|>", "it's we'll 'S  \n\n x", " " * 3000 + "a", "a" * 20_000, "　x\x85y  z\x1c1", "ªº²½ßé日本😀"]
    texts += ["".join(rng.choice(al) for _ in range(rng.randrange(1, 400))) for al in ("ab ", "the inong", "0123 .", "=-_*#", "eé日 \n") for _ in range(20)]
    for s in texts:
        ids = [i for part in t.encode(s) for i in part.tolist()]
        assert ids == own.encode(s, add_special_tokens=False).ids
        assert "".join(t.decode(ids)) == own.decode(ids, skip_special_tokens=False)
    assert "".join(t.decode([0, 999_999, 447, 223])) == own.decode([0, 447, 223])


def test_bpe_stream_is_stable_within_the_lookahead():
    t = bpe.Transducer(bpe.default_path())
    rng = random.Random(4)
    for al in ("ab", "aet", "theinong", "abcdefghijklmnopqrstuvwxyz", "=-"):
        s = "".join(rng.choice(al) for _ in range(4000)).encode()
        whole = t._merged(s)
        for block in (64, 500):
            assert [i for part in t.stream(s, block) for i in part] == whole
        ends = np.cumsum([len(t.bytes_of[i]) for i in whole])
        for cut in rng.sample(range(t.lookahead, 4000), 20):
            stable = [i for i, e in zip(whole, ends, strict=True) if e <= cut - t.lookahead]
            assert t._merged(s[:cut])[: len(stable)] == stable


def test_decontamination_query(spark):
    word = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    cut = lambda s: word.findall(bytes(c + 32 if 65 <= c <= 90 else c for c in (s or "").encode()))
    windows = {}
    for item, text in rows("benchmark"):
        w = cut(text)
        for i in range(max(1, len(w) - 9)):
            if w:
                windows.setdefault(tuple(w[i : i + 10]), set()).add(str(item))
    want = {}
    for doc in rows("documents"):
        w, hit, items = cut(doc[1]), set(), set()
        for size in {len(x) for x in windows}:
            for i in range(len(w) - size + 1):
                if found := windows.get(tuple(w[i : i + size])):
                    hit |= set(range(i, i + size))
                    items |= found
        want[doc[0]] = (len(w), len(hit), len(items), hashlib.sha256(",".join(sorted(items)).encode()).hexdigest(), bool(hit))
    got = run(spark, "op4_benchmark_decontamination")
    assert {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in got} == want
    assert any(r.contaminated for r in got)


def test_decontamination_blocks_and_offsets(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    bench = spark.read.parquet(f"{SF}/benchmark.parquet")
    one = {r.doc_id: r for r in decontaminate.scan(docs, bench).collect()}
    many = {r.doc_id: r for r in decontaminate.scan(docs, bench, block_bytes=20_000).collect()}
    assert one == many
    text = {d[0]: d[1].encode() for d in rows("documents")}
    for r in one.values():
        for s in r.spans:
            assert len(decontaminate.words(text[r.doc_id][s.from_byte : s.to_byte])) == s.to_word - s.from_word
    kept = {r.doc_id for r in decontaminate.clean(docs, bench, block_bytes=20_000).collect()}
    assert kept == {i for i, r in one.items() if not r["items"]}


def accuracy(spark, key, label):
    held = {r.doc_id: r.predicted for r in run(spark, key, "/root/testdata/sf0.01") if r.held_out}
    truth = {d[0]: d[1 if label == "quality" else 2] for d in rows("labels", "/root/testdata/sf0.01") if d[0] in held}
    return sum(held[i] == y for i, y in truth.items()) / len(truth), held, truth


def test_quality_on_held_out_rows(spark):
    right, held, truth = accuracy(spark, "op5_quality_classifier", "quality")
    assert right > 0.95
    assert sum(held[i] for i, y in truth.items() if y) > 0.97 * sum(truth.values())  # good documents are kept


def test_toxicity_on_held_out_rows(spark):
    right, held, truth = accuracy(spark, "op7_toxicity", "toxic")
    assert right > 0.9


def test_rules_as_columns_equal_rules_in_numpy(spark):
    rng = np.random.default_rng(1)
    x = rng.random((500, len(quality.STATISTICS)))
    y = ((x[:, 2] > 0.5) & (x[:, 5] < 0.7)).astype(float)
    m = quality.fit_rules(x, y)
    frame = spark.createDataFrame([(tuple(map(float, r)),) for r in x], f"s struct<{', '.join(f'{k}: double' for k in quality.STATISTICS)}>")
    got = np.array([r[0] for r in frame.select(m.score("s")).collect()])
    margin = m.intercept + sum(w * quality._holds(x, rule) for w, rule in m.rules)
    assert np.allclose(got, 1 / (1 + np.exp(-margin)))
    assert ((got > 0.5) == y).mean() > 0.97 and 0 < len(m.rules) < 120


def test_exact_dedup_on_a_small_table(spark):
    docs = spark.createDataFrame([(1, "Ab"), (2, "aB"), (3, "Éa"), (4, "éa"), (5, None), (6, ""), (7, "ab ")], "doc_id long, text string")
    got = {r.doc_id: (r.keep_id, r.group_size) for r in exact_dedup.verdicts(docs).collect()}
    assert got == {1: (2, 2), 2: (2, 2), 5: (6, 2), 6: (6, 2)}


def test_exact_dedup_of_an_id_with_two_texts(spark, tmp_path):
    docs = spark.createDataFrame([(1, "alone"), (1, "Copy"), (2, "copy")], "doc_id long, text string")
    assert sorted((r.doc_id, r.text) for r in exact_dedup.deduplicated(docs).collect()) == [(1, "alone"), (2, "copy")]
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = run(spark, "op3_exact_dedup", str(tmp_path))
    assert sorted((r.doc_id, r.keep_id, r.group_size, r.kept) for r in got) == [(1, 1, 1, True), (1, 2, 2, False), (2, 2, 2, True)]


def test_line_templates(spark):
    lines = [f"session {i} opened for user u{i} now" for i in range(8)] + ["session of parliament opened late for once"]
    docs = spark.createDataFrame([(i, f"{'abcdefghi'[i] * 3} begins a text of its own\n{line}\n\nshort") for i, line in enumerate(lines)], "doc_id long, text string")
    assert [r.template for r in line_dedup.templates(docs).collect()] == ["session <*> opened for user <*> now"]
    got = {r.doc_id: r for r in line_dedup.deduplicated(docs).collect()}
    assert all(got[i].n_dropped == 1 and "opened" not in got[i].text for i in range(8))
    assert got[8].n_dropped == 0 and got[8].n_lines == 4


def test_leaf_with_three_equally_frequent_lines(spark):
    common = [f"click here to {rest}" for rest in ("read the full story", "subscribe to our newsletter", "see all the comments")]
    prose = [f"click here to {w} {w}a {w}b {w}c" for w in ("abc", "bcd", "cde", "def")]
    texts = [(k, f"{'abcdefghijklmnopqr'[k] * 4} is a text\n{common[k % 3]}") for k in range(18)] + [(20 + k, p) for k, p in enumerate(prose)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    assert all(got[k].n_dropped == 1 and "click" not in got[k].text for k in range(18))
    assert all(got[20 + k].n_dropped == 0 for k in range(4))


def test_what_recurring_lines_leave_makes_a_template(spark):
    common = ["click here to read the full story"] * 12 + ["click here to subscribe to our newsletter"] * 5
    names = ["anna", "berta", "carla", "dora", "emma"]
    texts = list(enumerate([*common, *[f"click here to greet {n} by mail" for n in names]]))
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    assert all(r.n_dropped == 1 for r in line_dedup.deduplicated(docs).collect())
    assert "click here to greet <*> by mail" in [r.template for r in line_dedup.templates(docs).collect()]


def test_short_lines_recur_with_a_smaller_least_size(spark):
    texts = [(k, f"{k * 7}\n{k} {k}\nRead more\nAll rights reserved.\nPage {k}\n\nword{'abcdef'[k]}") for k in range(6)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string"), min_tokens=1).collect()}
    assert {k: r.text for k, r in got.items()} == {k: f"{k * 7}\n{k} {k}\n\nword{'abcdef'[k]}" for k in range(6)}


def test_many_lines_use_many_mask_words(spark):
    rng = random.Random(1)
    common = ["all of these words recur always"]
    texts = [(k, "\n".join(rng.choice([*common, f"line {k} x{i} y{i} only here w{rng.random()}"]) for i in range(300))) for k in range(6)]
    got = {r.doc_id: r for r in line_dedup.deduplicated(spark.createDataFrame(texts, "doc_id long, text string")).collect()}
    for k, t in texts:
        ls = t.split("\n")
        assert got[k].n_lines == 300 and common[0] not in got[k].text.split("\n")
        assert got[k].n_dropped >= ls.count(common[0])


@pytest.mark.parametrize("word,plain", [("1d10t", "idiot"), ("st*pid", "stupid"), ("l0s3r!!", "loser"), ("t.r.a.s.h", "trash"), ("m o r o n ", "moron"),
                                        ("cl0wwwwn", "clown"), ("word", "word"), ("555-1234", "555-1234")])
def test_restored_words(word, plain):
    counts = {w: 50 for w in "idiot stupid loser trash moron clown the word thing other and train story".split()}
    grams, total = {}, {}
    for w, n in counts.items():
        s = toxicity.EDGE * 2 + w + toxicity.EDGE
        for i in range(len(w) + 1):
            grams[s[i : i + 3]] = grams.get(s[i : i + 3], 0) + n
            total[s[i : i + 2]] = total.get(s[i : i + 2], 0) + n
    size = len(toxicity.LETTERS) + 2
    m = toxicity.CharModel({g: float(np.log((n + 0.1) / (total[g[:2]] + 0.1 * size))) for g, n in grams.items()},
                           {p: float(np.log(0.1 / (n + 0.1 * size))) for p, n in total.items()})
    assert m.restore(word) == plain


def test_disguised_toxic_text_scores_high(spark):
    docs = spark.createDataFrame([(1, "you are an id10t and a l o s e r"), (2, "the idiot and the loser are other words"), (3, "the story and the train")], "doc_id long, text string")
    m = toxicity.char_model(docs)
    got = {r.doc_id: r.score for r in toxicity.score(docs, m, toxicity.Lexicon(0.01, {"idiot$": 0.95, "loser$": 0.95})).collect()}
    assert got[1] > 0.9 and got[2] > 0.9 and got[3] < 0.05


TOXIC = ["you are a s t u p i d", "and a l o s e r", "s  t  u  p  i  d", "s t u\np i d", "you,stupid", "you/loser", "st.upid", "l-o-s-e-r"]


def test_each_disguise_in_a_document_of_its_own(spark):
    plain = "you are a stupid and a loser and the others are not so you and a train are late"
    docs = spark.createDataFrame([(0, plain), (1, "a b c of the story"), *[(10 + k, t) for k, t in enumerate(TOXIC)]], "doc_id long, text string")
    m = toxicity.char_model(spark.createDataFrame([(k, plain) for k in range(20)], "doc_id long, text string"))
    got = {r.doc_id: r.score for r in toxicity.score(docs, m, toxicity.Lexicon(0.01, {"stupid$": 0.95, "loser$": 0.95})).collect()}
    assert [TOXIC[k] for k in range(len(TOXIC)) if got[10 + k] < 0.9] == [] and got[0] > 0.9 and got[1] < 0.05


def brute_repeats(docs, size):
    seen, gone = {}, {}
    for i, t in sorted(docs):
        w = t.split()
        for s in range(len(w) - size + 1):
            if seen.setdefault(tuple(w[s : s + size]), (i, s)) != (i, s):
                gone.setdefault(i, set()).update(range(s, s + size))
    return gone


@pytest.mark.parametrize("group", [2, 5, 20_000])
@pytest.mark.parametrize("size", [3, 7, 20])
def test_substrings_beside_brute_force(spark, size, group):
    rng = random.Random(size)
    common = [rng.choice("abc") for _ in range(60)]
    docs = [(k, " ".join([rng.choice("abcdefgh") for _ in range(rng.randrange(60))] + common[rng.randrange(20) : rng.randrange(20, 60)] + ["z"] * rng.randrange(40)))
            for k in range(40)]
    got = substring_dedup.removed(spark.createDataFrame(docs, "doc_id long, text string"), size, group).collect()
    gone = brute_repeats(docs, size)
    text = dict(docs)
    assert {r.doc_id: (r.n_removed, r.kept) for r in got} == {
        i: (len(gone.get(i, ())), " ".join(w for k, w in enumerate(t.split()) if k not in gone.get(i, ()))) for i, t in text.items()}


def test_word_hashes_do_not_depend_on_parts(monkeypatch):
    rng = random.Random(6)
    text = np.frombuffer(" ".join("".join(rng.choice("abé\t ") for _ in range(rng.randrange(12))) for _ in range(400)).encode(), np.uint8)
    whole, _ = substring_dedup.word_hashes(text, np.zeros(1, np.int64))
    words = text.tobytes().split()
    assert len(whole) == len(words) and len(set(whole.tolist())) == len(set(words))
    monkeypatch.setattr(substring_dedup, "PIECE", 50)
    parts, _ = substring_dedup.word_hashes(text, np.zeros(1, np.int64))
    assert (parts == whole).all()


HTML = [
    ("<p>one<p>two", "one\n\ntwo"),
    ("a<br>b<div>c</div>d", "a\nb\nc\nd"),
    ("<ul><li>a<li>b<ol start=3><li>x<li>y</ol><li>c</ul>", "- a\n- b\n  3. x\n  4. y\n- c"),
    ("<table><tr><th>k<th>value<tr><td>longer<td>2</table>", "k      | value\nlonger | 2"),
    ("<script>var a='</p>'</script><style>p{}</style><!-- x -->seen<div hidden>no</div><i style='display: none'>no</i>", "seen"),
    ("<pre> a\n   b</pre>", " a\n   b"),
    ("x &amp; y&nbsp;z <b> bold </b>tail", "x & y\xa0z bold tail"),
    ("<title>t</title><body>b</body>", "b"),
    ("a < b <c", "a < b <c"),
    ("<td>cell</td></div></p>", "cell"),
    ("", ""), ("<", "<"), ("<div" * 500, "<div" * 500),
]


@pytest.mark.parametrize("html,text", HTML)
def test_rendered(html, text):
    assert html_text.visible_text(html).strip("\n") == text


SEEN = [
    ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
    ("<svg><title>no</title><defs/><path d='M0'/><text>one</text><text>two</text></svg> end", "one two end"),
    ("<dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("<h1 aria-hidden=true>Head</h1><p aria-hidden='true'>para", "Head\n\npara"),
    ("is <select><option>a<option selected>b</select> ok", "is b ok"),
    ("<select multiple><optgroup label=g><option>a<option>b</select>", "g a b"),
    ("<select><option disabled>a<option>b</select>", "b"),
    ("<textarea>\nl1 &amp;\nl2</textarea>", "l1 &\nl2"),
    ("x<input value=v><input type=hidden value=no><input placeholder=p>y", "x v p y"),
    ("<head><title>t</title>text <b>bold</b><p>para", "text bold\n\npara"),
    ("<head><meta charset=x><a href=y>link</a> and <span>more</span>", "link and more"),
    ("<head><template><p>no</p></template><script>no</script></head>yes", "yes"),
    ("<object>no</object><canvas>no</canvas><video>no</video>yes", "yes"),
]


@pytest.mark.parametrize("html,text", SEEN)
def test_all_that_is_seen(html, text):
    assert html_text.visible_text(html).strip("\n") == text


def test_nested_fields_end():
    assert html_text.visible_text("<select><option>x" * 5_000).split()[-1] == "x"
    assert html_text.visible_text("<svg><text>" * 5_000 + "x").strip() == "x"


def test_deep_pages_end():
    assert html_text.visible_text("<div>" * 20_000 + "x") == "x"
    assert html_text.visible_text("<table><tr><td>" * 300 + "x").strip() == "x"


def test_pages_keep_every_visible_word(spark):
    """Beside the standard library's parser, which knows no layout."""
    from html.parser import HTMLParser

    class Words(HTMLParser):
        def __init__(self):
            super().__init__()
            self.skip, self.out = 0, []

        def handle_starttag(self, tag, attrs):
            self.skip += tag in ("script", "style", "title")

        def handle_endtag(self, tag):
            self.skip -= tag in ("script", "style", "title")

        def handle_data(self, data):
            if not self.skip:
                self.out.append(data)

    got = {r.page_id: r.text for r in run(spark, "op9_html_extraction")}
    for page_id, _, html in rows("pages"):
        p = Words()
        p.feed(html)
        marks = {"-"}
        assert [w for w in got[page_id].split() if w not in marks] == [w for w in " ".join(p.out).split() if w not in marks]


def test_url_intervals(spark):
    entries = spark.sql("""select * from values ('l', 'domain', 'Example.com', 'add', date'2024-01-10'), ('l', 'domain', 'example.com', 'remove', date'2024-02-01'),
      ('l', 'domain', 'example.com', 'add', date'2024-03-01'), ('l', 'domain', 'example.com', 'remove', date'2024-03-01'),
      ('m', 'path', 'a.example.com/x', 'add', date'2024-01-01') as t(list, kind, value, action, day)""")
    days = ["2024-01-09", "2024-01-10", "2024-01-31", "2024-02-01", "2024-03-02"]
    captures = [(k, f"http://u@A.example.com.:80/{p}?q", d) for k, (d, p) in enumerate([*((d, "y") for d in days), ("2024-05-01", "x/deep"), ("2024-05-01", "xx")])]
    frame = spark.createDataFrame(captures, "page_id long, url string, fetched string").selectExpr("page_id", "url", "cast(fetched as date) fetched")
    got = {r.page_id: r.blocked for r in url_filters.evaluate(frame, entries).collect()}
    assert got == {0: False, 1: True, 2: True, 3: False, 4: False, 5: True, 6: False}


def test_listed_hosts_are_blocked_however_they_are_written(spark):
    entries = spark.sql("select * from values ('l', 'domain', 'example.com', 'add', date'2024-01-01'), ('l', 'path', 'other.org/x', 'add', date'2024-01-01') as t(list, kind, value, action, day)")
    urls = ["http://a@b@example.com/", "//example.com/x", " \thttp://example.com", "HTTP://u:p@EXAMPLE.com:80", "\x01//www.example.com.", "http://other.org/x \n", "http://other.org//x/y"]
    free = ["http://example.com@b.org/", "http://b.org/example.com", "example.com", "http://other.org/xy", "/x", "mailto:a@example.com"]
    frame = spark.createDataFrame([(None if k % 2 else k, u) for k, u in enumerate(urls + free)], "page_id long, url string").withColumn("fetched", F.lit("2024-06-01").cast("date"))
    got = {r.url: r.blocked for r in url_filters.evaluate(frame, entries).collect()}
    assert got == {**{u: True for u in urls}, **{u: False for u in free}}


def test_pipeline_beside_brute_force(spark):
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    score = {r.doc_id: r.score for r in quality.score(docs, quality.fit(docs, quality.may_learn(labels))).collect()}
    left = {d[0]: d[1] for d in rows("documents") if score[d[0]] >= quality.THRESHOLD}
    last = {}
    for i, t in sorted(left.items()):
        last[t.encode().lower()] = i
    left = {i: left[i] for i in last.values()}
    left = {i: left[i] for i, c in components({i: fingerprint(t) for i, t in sorted(left.items())}).items() if i == c}
    dirty = {r.doc_id for r in decontaminate.scan(docs, bench).collect() if r["items"]}
    own = Tokenizer.from_file(bpe.default_path())
    want = {i: len(own.encode(t, add_special_tokens=False).ids) for i, t in left.items() if i not in dirty}
    assert {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, SF).collect()} == want
    assert 0 < len(want) < len(score)
