"""The training-data operators on small tables, against brute force; nulls, empty texts, ties, repeated rows, empty tables, clashing names."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from plumbline.llm import encoding, html_extract, jaccard, mixing, neighbours, packing, pii, quality, registry, shared, suffixes, token_files, url_filter

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, component_id long, spans string"


def words_of(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


@pytest.fixture(scope="module")
def docs(spark):
    """Documents with copies, near copies, nulls, empty and odd texts, and columns whose names the operators use too."""
    rng = random.Random(7)
    make = lambda n: " ".join("".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6))) for _ in range(n))
    base, passage = make(200), make(30)
    rows = [(1, base), (2, base), (3, base.replace(base.split()[50], "changed")), (4, base + " " + make(60)), (5, None), (6, ""), (7, " \n "), (8, "one two"), (9, "One TWO"), (10, "é" * 3000)]
    rows += [(11 + k, make(80) + "\n" + passage + "\n" + make(40)) for k in range(6)]
    rows += [(30, "mail a.b@mail1.example.com or +1 (555) 010-9999, 10.0.0.1"), (31, "x " * 200), (1, base), (40, make(5000)), (41, "#$% " * 90)]
    return spark.createDataFrame([(i, t, None if i == 8 else "en", None if i == 9 else f"s{i % 2}", None, 0, "x") for i, t in rows], DOCS).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS)


def rows(df, *columns):
    return sorted(map(tuple, df.select(*columns).collect()), key=repr)


# ---------------------------------------------------------------- components


@pytest.mark.parametrize("seed", [1, 2])
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(40)] + [(100, k) for k in range(101, 160)] + [(k, k + 1) for k in range(200, 240)]
    parent = list(range(300))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in edges:
        lo, hi = sorted((find(a), find(b)))
        parent[hi] = lo
    got = dict(map(tuple, shared.components(spark.createDataFrame([*edges, (5, None)], "a long, b long")).collect()))
    assert got == {x: find(x) for e in edges for x in e if e[0] != e[1]} | {x: got[x] for x in got if got[x] == find(x)}
    assert shared.components(spark.createDataFrame([], "a long, b long")).count() == 0


# ---------------------------------------------------------------- 1 URL filters


def test_url_filter(spark):
    page = lambda i, url, html="": (i, url, html, "mine")
    canonical = '<link rel="canonical" href="{}">'.format
    pages = spark.createDataFrame(
        [
            page(1, "https://A.Example.NET/x"), page(2, "http://example.net/en/x"), page(3, "http://example.com/de/1"), page(4, "http://a.example.org/fr/1?q#f"), page(5, None), page(6, "no scheme"),
            page(7, "http://y.org/a", canonical("https://b.net/z?u=1&amp;v=2")), page(8, "http://y.org/b", '<meta http-equiv="refresh" content="0; url=/a">'),
            page(9, "http://z.org/a", canonical("//q.org/fr/k")), page(10, "http://z.org/b", canonical("http://b.net/") + canonical("http://z.org/a")), page(11, "http://notnet/x"), page(12, "http://x.net"),
            page(13, "http://y.org/c/d", "<LINK href='../x' rel=canonical>"), page(1, "https://A.Example.NET/x"),
        ],
        "page_id long, url string, html string, verdict string",
    )
    got = [tuple(r) for r in url_filter.filter_urls(pages).select("page_id", "host", "path", "rule", "verdict").collect()]
    verdicts = {r[0]: r[3:] for r in got}
    assert len(got) == 14 and Counter(r[0] for r in got)[1] == 2
    assert verdicts == {1: ("net/", "block"), 2: ("example.net/en/", "allow"), 3: ("example.com/de/", "block"), 4: ("org/fr/", "allow"), 5: (None, "allow"), 6: (None, "allow"), 7: (None, "block"), 8: (None, "block"), 9: (None, "allow"), 10: (None, "allow"), 11: (None, "allow"), 12: (None, "allow"), 13: (None, "allow")}
    assert ("a.example.net", "/x") == next(r[1:3] for r in got if r[0] == 1)
    assert url_filter.filter_urls(pages.limit(0)).count() == 0
    more = spark.createDataFrame([("http://notnet/x", "http://c.net/a")], "url string, target string")
    assert dict(rows(url_filter.filter_urls(pages, redirects=more), "page_id", "verdict"))[11] == "block"


def test_url_links_are_those_of_the_page(spark):
    """No edges to nowhere, from comments or from scripts; relative targets and character references are resolved."""
    link = '<link rel="canonical" href="{}">'.format
    pages = [
        (1, "http://bad.net/x", link("http://")), (2, "http://good.org/a", link("http://")), (3, None, link("http://bad.net/x")), (4, "nothing", link("http://bad.net/x")),
        (5, "http://c.org/", "<!-- " + link("http://bad.net/x") + " -->"), (6, "http://d.org/", "<script>var a = '" + link("http://bad.net/x") + "'</script>"),
        (7, "http://e.org/a/b/c", link("../../q/./r")), (8, "http://e.org/q/r", link("http://bad.net/y")), (9, "http://f.org/p", link("http://b&#97;d.n&#x65;t/z&amp;k")), (10, "http://", link("http://bad.net/x")),
        (11, "http://g.org/a?b=1", link("../../../x")), (12, "http://g.org/x", "<meta http-equiv=refresh content='0;url=http://bad.net/u'>"), (13, "http://h.org/a", link("javascript:void(0)") + link("mailto:a@bad.net")),
    ]
    out = url_filter.filter_urls(spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({c: F.lit("x") for c in ("_node", "_rule", "class_verdict", "rule")}))
    got = {r["page_id"]: r["verdict"] for r in out.collect()}
    assert sorted(k for k, v in got.items() if v == "block") == [1, 7, 8, 9, 11, 12]
    assert {"_node", "_rule", "class_verdict"} <= set(out.columns) and out.columns.count("rule") == 1
    edges = {(r["url"], r["target"]) for r in url_filter.links(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    assert ("http://e.org/a/b/c", "http://e.org/q/r") in edges and ("http://f.org/p", "http://bad.net/z&k") in edges and ("http://g.org/a?b=1", "http://g.org/x") in edges


def test_long_rule_lists_are_joined(spark):
    """A list past the length of one expression gives what the rules one by one give."""
    rng = random.Random(2)
    host = lambda: ".".join(rng.choice(["a", "b", "c", "net", "org"]) for _ in range(rng.randint(1, 3)))
    path = lambda: "".join(rng.choice(["x", "y", "/"]) for _ in range(rng.randint(0, 5)))
    rules = [*{f"{host()}/{path()}": None for _ in range(1500)}]
    rules = [(rng.choice(["allow", "block"]), r) for r in rules]
    places = [(host(), rng.choice(["", "/" + path()])) for _ in range(600)]

    def want(h, p):
        fits = [(len(r), r, v) for v, r in rules for n, _, rest in [r.partition("/")] if (h == n or h.endswith("." + n)) and p.startswith("/" + rest)]
        return max(fits)[1:] if fits else None

    df = spark.createDataFrame(places, "host string, path string")
    got = url_filter.ruled(df, "host", "path", rules * 1, "r").collect()
    assert len(got) == 600 and all((tuple(r["r"]) if r["r"] else None) == want(r["host"], r["path"]) for r in got)


# ---------------------------------------------------------------- 2 HTML extraction

FRAME = '<html><head><title>t</title><style>p{}</style></head><body><header><a href="/">Home</a></header><nav><ul><li>Menu</li></ul></nav><div class="sidebar-2">side</div><div id="cookie-notice">We use cookies</div>'
TAIL = '<div class="ad">Buy</div><form><p>Name</p></form><section class="comments"><p>First!</p></section><footer>&copy; x</footer></body></html>'


def test_html_extract(spark):
    page = lambda body: FRAME + body + TAIL
    rows_ = [
        (1, "http://a/1", page("<article><h1>Title</h1><p>One &amp; two\n  <b>three</b><script>var x='</p>'</script></p><p>Next<br>line</p></article>"), "z"),
        (2, "http://a/2", page('<div class="post7"><p>Body text of the page here.</p><p>More of the body text.</p></div>'), "z"),
        (3, "http://a/3", page('<div class="post9"><p>Short.</p></div><div class="other"><a href=x>long link text that is only links</a></div>'), "z"),
        (4, None, None, "z"), (5, "http://b/5", "", "z"), (6, "http://b/6", "<p>bare < text & more", "z"),
    ]
    got = dict(rows(html_extract.extract_main_text(spark.createDataFrame(rows_, "page_id long, url string, html string, text string")), "page_id", "text"))
    assert got == {1: "Title\nOne & two three\nNext line", 2: "Body text of the page here.\nMore of the body text.", 3: "Short.", 4: "", 5: "", 6: "bare < text & more"}


@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ('<section id="discussion"><p>We discuss it.</p></section>', True), ('<div class="side-effects"><p>Nausea.</p></div>', True), ('<div class="form-factor"><p>Small.</p></div>', True),
        ('<div class="share-price"><p>Up.</p></div>', True), ('<div class="search-algorithms"><p>Binary.</p></div>', True), ('<div class="related"><p>Work of others is near to ours.</p></div>', True),
        ('<div class="related"><a href=x>One</a> <a href=y>Two</a></div>', False), ('<div class="search"><input name=q> Find it</div>', False), ('<div class="cookie-notice">We use cookies</div>', False),
        ('<div id="leftSidebar2">More</div>', False), ('<div class="post ad-slot">Buy</div>', False), ('<ul class="user-comments"><li>First!</ul>', False), ('<div class="entry-header"><h2>Part</h2></div>', True),
        ('<div role="navigation">Up</div>', False), ('<p data-class="ad">Plain.</p>', True),
    ],
)
def test_html_parts_by_name(inside, kept):
    words = re.sub("<[^>]*>", "", inside)
    text = html_extract.extract_text(f"<article><p>Start of it.</p>{inside}<p>End of it.</p></article>", None)
    assert text == ("Start of it.\n" + words + "\nEnd of it." if kept else "Start of it.\nEnd of it.")


def test_html_button_in_a_sentence():
    assert html_extract.extract_text("<article><p>Press <button>Go</button> to start.</p><button>Share</button></article>", None) == "Press Go to start."


def test_html_extract_of_odd_tables(spark):
    """An empty table, repeated rows, ties of votes, a very long page and columns of any names."""
    schema = "page_id long, url string, html string, _host string, _path int"
    long_page = "<div class=a>" + "".join(f"<p>word{k} text</p>" for k in range(60_000)) + "</div>"
    data = [(1, "http://a/1", "<div class=a><p>One one.</p></div><div class=b><p>x</p></div>", "h", 1), (1, "http://a/1", "<div class=a><p>One one.</p></div><div class=b><p>x</p></div>", "h", 1)]
    data += [(2, "http://t/1", "<div class=a><p>Left text.</p></div><div class=b><p>y</p></div>", None, None), (3, "http://t/2", "<div class=a><p>z</p></div><div class=b><p>Right text.</p></div>", None, None), (4, "http://l/", long_page, None, None)]
    out = html_extract.extract_main_text(spark.createDataFrame(data, schema))
    got = [tuple(r) for r in out.select("page_id", "_host", "_path", "text").collect()]
    assert sorted(x[:3] for x in got if x[0] == 1) == [(1, "h", 1)] * 2 and {x[3] for x in got if x[0] == 1} == {"One one."}
    by = {x[0]: x[3] for x in got}
    assert (by[2], by[3]) == ("y", "Right text.") and by[4] == "\n".join(f"word{k} text" for k in range(60_000))
    assert html_extract.extract_main_text(spark.createDataFrame([], schema)).count() == 0


def test_html_extract_of_the_table(spark):
    """Every page of the test table against a plain reading of it: the blocks of its article element."""
    import html as entities

    pages = spark.read.parquet(f"{DATA}/pages.parquet")
    got = dict(rows(html_extract.op2_html_extract(spark, DATA), "page_id", "text"))
    for i, page in pages.select("page_id", "html").collect():
        body = re.search(r"(?s)<article>(.*?)</article>", page).group(1)
        blocks = (" ".join(entities.unescape(re.sub(r"<[^>]*>", "", re.sub("<br>", " ", b))).split()) for b in re.split(r"</?(?:p|h1|h2|div|li|ul)>", body))
        assert got[i] == "\n".join(b for b in blocks if b), i


# ---------------------------------------------------------------- 3 suffixes


def brute_suffixes(data):
    first = {}
    for i, t in sorted((r for r in data if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for k in range(len(b) - 49):
            first.setdefault(b[k : k + 50], i)
    out = []
    for i, t in data:
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, int)
        for k in range(len(b) - 49):
            if i is not None and first.get(b[k : k + 50], i) < i:
                gone[k : k + 50] = 1
        kept = bytes(x for x, g in zip(b, gone, strict=False) if not g)
        out.append((i, len(b), int(gone.sum()), int((np.diff(np.concatenate(([0], gone))) == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def test_suffixes(spark, docs, none):
    rng = random.Random(3)
    base = "".join(rng.choice("ab é") for _ in range(2500))
    made = [(k * 3 - 50, "".join(base[s : s + rng.randint(10, 120)] if rng.random() < 0.7 else "".join(rng.choice("xyz ") for _ in range(60)) for s in rng.sample(range(2400), rng.randint(0, 6)))) for k in range(150)]
    made += [(900, "x" * 200), (901, "x" * 300), (902, "ab" * 100), (903, "ab" * 100), (None, base)]
    for df in (spark.createDataFrame(made, "doc_id long, text string").repartition(5), docs):
        got = rows(suffixes.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
        assert got == brute_suffixes([tuple(r) for r in df.select("doc_id", "text").collect()])
    assert suffixes.without_repeats(none).count() == 0


@pytest.mark.parametrize("hot", [False, True])
def test_suffixes_of_a_hot_passage(spark, monkeypatch, hot):
    """A passage in all texts, shorter and longer than a string; hot marks are dealt by context, with the same results."""
    if hot:
        monkeypatch.setattr(suffixes, "CONTEXTS", 30)
        monkeypatch.setattr(suffixes, "SAMPLE", 120)
        monkeypatch.setattr(suffixes, "HOT", 0.5)
    rng = random.Random(5)
    noise = lambda n: "".join(rng.choice("pqrs") for _ in range(n))
    common = "a common phrase of fifty-five bytes that all texts have. "
    made = [(k, noise(40) + common + noise(40) + common[:30] + noise(30)) for k in range(240)]
    df = spark.createDataFrame(made, "doc_id long, text string")
    if hot:
        assert len(suffixes.hot_marks(df, 50, 20)) > 0
    assert rows(suffixes.without_repeats(df), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == brute_suffixes(made)


def test_suffix_index_takes_a_new_batch(spark):
    """Batches added one by one, the index opened again before the last; ranks of levels are those of a binary counter; a new batch's
    copies of old documents are found."""
    rng = random.Random(6)
    base = "".join(rng.choice("abc é") for _ in range(4000))
    made = [(k, "".join(base[s : s + rng.randint(20, 150)] + "-" for s in rng.sample(range(3800), 5))) for k in range(60)]
    index, ranks, found = suffixes.SuffixIndex(spark, buckets=5), [], []
    for k in range(6):
        if k == 5:
            index = suffixes.SuffixIndex(spark, index.folder, 5, index.levels)
        found += index.add(spark.createDataFrame(made[10 * k : 10 * k + 10], "doc_id long, text string")).collect()
        ranks.append([r for _, r in index.levels])
    assert ranks == [[0], [1], [1, 0], [2], [2, 0], [2, 1]]
    once = suffixes.SuffixIndex(spark, buckets=5).add(spark.createDataFrame(made, "doc_id long, text string")).collect()

    def contexts(rows_, kind):
        return {(r["doc_id"], c) for r in rows_ if r["kind"] == kind for c in np.frombuffer(r["contexts"], np.uint64).tolist()}

    assert contexts(found, suffixes.KNOWN) == contexts(once, suffixes.KNOWN) and contexts(found, suffixes.OPEN) >= contexts(once, suffixes.OPEN)
    for path, _ in index.levels:  # every level's arrays are in order
        stored = index.arrays(path).collect()
        assert len({r["bucket"] for r in stored}) == len(stored)
        for r in stored:
            keys, contexts_ = suffixes._unplaned(r["keys"], 6), suffixes._unplaned(r["contexts"], 7)
            assert (np.lexsort((contexts_, keys)) == np.arange(len(keys))).all()


def test_marks_of_a_long_text(monkeypatch):
    rng = random.Random(4)
    data, offsets = np.frombuffer("".join(rng.choice("abcd") for _ in range(9000)).encode(), np.uint8), np.array([0, 5, 4100, 4100, 9000])
    whole = [x.tolist() for x in suffixes.marks(data, offsets)]
    monkeypatch.setattr(suffixes, "HASHED", 700)
    assert [x.tolist() for x in suffixes.marks(data, offsets)] == whole


# ---------------------------------------------------------------- 4 and 10 tokens


def library(name):
    import public_tokenizers
    from tokenizers import Tokenizer

    return public_tokenizers.path(name), Tokenizer.from_file(public_tokenizers.path(name))


@pytest.mark.parametrize(("name", "by_words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_encoder_equals_the_library(name, by_words):
    path, library_ = library(name)
    encode, rng = encoding.encoder(path, by_words).encode, random.Random(1)
    signs = "abcIZ\u0130\u0131\u00df\u017f\u00e9\u00c9\u0141\u01c5\u0149\u0307'\u2019.,!?-_019 \n\t" + "".join(map(chr, range(0x100, 0x250, 7)))
    for _ in range(8000):
        t = "".join(rng.choice(signs) for _ in range(rng.randint(1, 14)))
        assert encode(t) == np.array(library_.encode(t, add_special_tokens=False).ids, "<u4").tobytes(), t


def columns_of(encoder, texts):
    out = []
    for ids, counts in encoder.encode(pa.RecordBatch.from_pydict({"text": pa.array(texts, pa.string())}), "text"):
        assert len(ids) == counts.sum()
        out += [x.tolist() for x in np.split(ids, np.cumsum(counts)[:-1])]
    return out


@pytest.mark.parametrize("joined", [True, False])
@pytest.mark.parametrize(("name", "by_words"), [("byte_bpe_50k.json", False), ("word_bpe_49k.json", True)])
def test_column_encoder_equals_the_library(name, by_words, joined, monkeypatch):
    """Odd texts beside plain ones, empty and null ones, a text longer than a step, marks of special tokens, and few pieces remembered."""
    monkeypatch.setattr(encoding, "COLUMN_BYTES", 700)
    monkeypatch.setattr(encoding, "JOINED_PIECES", 30)
    path, library_ = library(name)
    column, rng = encoding.ColumnEncoder(path, by_words, remembered=200), random.Random(2)
    assert column.joined == (not by_words)
    column.joined, column.signs = column.joined and joined, column.signs and joined
    plain, odd = "abcIZ\u0130\u00df\u00e9'\u2019.,!-_019 \n\u4e16\U0001f642", "ab., \t\n\r\x00\u00a0\u2003\u0301"
    texts = ["".join(rng.choice(odd if k % 5 == 0 else plain) for _ in range(rng.randint(0, 16))) if k % 9 else None for k in range(3000)]
    texts += ["", None, " ", "\n", "\n\n", ".", "a.", " a, ", "b,\nc.", "x <|endoftext|> y", "<|endoftext|>", "z"]
    texts += [" ".join(f"w{k}ord, {k} it's." for k in range(500)), "a" * 2000 + " " + "b" * 1500 + "\nc", "  " + "d e " * 400, None]
    assert columns_of(column, texts) == [library_.encode(t or "", add_special_tokens=False).ids for t in texts]
    assert columns_of(column, []) == [] and columns_of(column, [None, ""]) == [[], []]


def test_token_files_ask_the_library_for_many_pieces_at_once():
    """Each new piece is in one text with many others; with one call for each, encoding took most of the time."""
    path, library_ = library("byte_bpe_50k.json")
    column, asked = encoding.ColumnEncoder(path, False), []

    class Counted:
        def encode(self, text, **more):
            asked.append(text)
            return library_.encode(text, **more)

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library_.encode_batch_fast(texts, **more)

    column.single.tokenizer = Counted()
    texts = [f"Word{k % 500} and w{k}, x{k % 90}. The{k}." for k in range(3000)]
    assert columns_of(column, texts) == [library_.encode(t, add_special_tokens=False).ids for t in texts]
    assert len(asked) < 10


def test_token_files_of_many_shards(spark, docs, monkeypatch):
    """The number of files follows the bytes of text; columns of other names are ignored."""
    monkeypatch.setattr(token_files, "SHARD_BYTES", 4000)
    path, _ = library("byte_bpe_50k.json")
    named = docs.withColumns({"shard": F.lit("x"), "folder": F.lit(1), "base": F.lit(2)})
    few, many = token_files.write_tokens(docs, path, 2, shards=2), token_files.write_tokens(named, path, 2)
    assert many.count() > 8
    assert rows(token_files.read_tokens(many, "crc32"), "doc_id", "start", "n_tokens", "crc32") == rows(token_files.read_tokens(few, "crc32"), "doc_id", "start", "n_tokens", "crc32")


def test_token_files(docs, none):
    path, library_ = library("byte_bpe_50k.json")
    data = sorted(((r[0], r[1] or "") for r in docs.select("doc_id", "text").collect()))
    want, start = [], 0
    for i, t in data:
        ids = np.array([*library_.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    manifest = shared.materialize(token_files.write_tokens(docs, path, 2, shards=3), "manifest")
    assert rows(token_files.read_tokens(manifest, "crc32"), "doc_id", "start", "n_tokens", "crc32") == sorted(want, key=repr)
    one = next(r for r in token_files.read_tokens(manifest).collect() if r["doc_id"] == 8)
    assert library_.decode(one["ids"][:-1]) == "one two" and one["ids"][-1] == 2
    assert token_files.read_tokens(token_files.write_tokens(none, path, 2)).count() == 0


def test_packing(docs, none):
    path, library_ = library("word_bpe_49k.json")
    want = []
    for i, t in docs.select("doc_id", "text").collect():
        ids = np.array([*library_.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want += [(i, k // 2048, k, len(ids[k : k + 2048]), zlib.crc32(ids[k : k + 2048].tobytes())) for k in range(0, len(ids), 2048)]
    got = packing.packed_documents(docs).collect()
    assert sorted(tuple(r)[:5] for r in got) == sorted(want)
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    for items in by.values():
        at = 0
        for offset, length in sorted(items):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.packed_documents(none).count() == 0


def test_packing_takes_one_python_worker_of_a_task(docs, monkeypatch):
    """Texts are cut and packed in one step: two steps take two workers, and more of an executor's workers come to hold a tokenizer."""
    plans = {}

    def stored(df, name, rows=None):
        plans[name] = df._jdf.queryExecution().executedPlan().toString()
        return shared.materialize(df, name, rows)

    monkeypatch.setattr(packing, "materialize", stored)
    path, _ = library("word_bpe_49k.json")
    got = packing.packed_documents(docs)
    assert plans["packed"].count("MapInArrow") == 1
    two = packing.pack(packing.pieces(docs, path, 0, value="crc32"))
    assert plans["packed"].count("MapInArrow") == 2
    names = ("doc_id", "piece", "start", "length", "offset", "crc")
    assert rows(got.withColumnRenamed("ids_crc32", "crc"), *names) == rows(two.withColumnRenamed("crc32", "crc"), *names)


def test_encoder_remembers_a_bounded_number_of_pieces():
    path, library_ = library("word_bpe_49k.json")
    e = encoding.Encoder(path, True, remembered=50)
    for k in range(200):
        t = f"The w{k}ord and{k * 7}, x{k % 9}"
        assert e.encode(t) == np.array(library_.encode(t, add_special_tokens=False).ids, "<u4").tobytes()
        assert len(e) <= 52


def test_packing_is_close_to_the_bound(spark):
    rng = random.Random(2)
    sizes = [min(2048, int(rng.lognormvariate(6, 1)) + 1) for _ in range(4000)]
    df = spark.createDataFrame([(k, n, 5) for k, n in enumerate(sizes)], "k long, length long, offset int").withColumns({c: F.lit("x") for c in ("_bin", "_turn", "_part", "_base")}).repartition(20)
    got = packing.pack(df)
    assert got.count() == 4000 and got.select("sequence_id").distinct().count() <= 1.01 * -(-sum(sizes) // 2048) + 1


def test_packing_fills_bins_of_a_hot_source(spark):
    """5,000 long items in each of two partitions and the short ones that fill them in two others: as many bins as long items."""
    sizes = [1400 + k % 8 for k in range(10_000)] + [600 + k % 8 for k in range(10_000)]
    df = spark.createDataFrame(spark.sparkContext.parallelize([(k, n) for k, n in enumerate(sizes)], 4), "k long, length long")
    got = packing.pack(df).collect()
    by = defaultdict(list)
    for r in got:
        by[r["sequence_id"]].append((r["offset"], r["length"]))
    assert sorted(r["k"] for r in got) == list(range(20_000)) and len(by) == 10_000
    for items in by.values():
        ends = list(itertools.accumulate(n for _, n in sorted(items)))
        assert [o for o, _ in sorted(items)] == [0, *ends[:-1]] and ends[-1] <= 2048


@pytest.mark.parametrize("seed", range(20))
def test_counted_best_fit_is_best_fit(seed):
    rng = random.Random(seed)
    counts = {n: rng.randint(1, 30) for n in rng.sample(range(1, 65), rng.randint(1, 40))}
    runs = packing.best_fit_counts(counts, 64).tolist()
    bins = defaultdict(list)
    for size, n in counts.items():
        for k in range(n):
            _, first, start, each, offset = max(r for r in runs if r[0] == size and r[1] <= k)
            bins[start + (k - first) // each].append((offset + (k - first) % each * size, size))
    assert all([o for o, _ in sorted(b)] == [0, *itertools.accumulate(n for _, n in sorted(b))][:-1] and sum(n for _, n in b) <= 64 for b in bins.values())
    assert len(bins) == len(packing.best_fit(np.array([s for s, n in counts.items() for _ in range(n)]), 64)[2])


# ---------------------------------------------------------------- 5 mixing


def test_pattern_stays_within_one_block():
    for weights in ({"a": 0.5, "b": 0.3, "c": 0.2}, {f"s{k}": k + 1.0 for k in range(20)}, {"a": 1.0}, {"a": 0.999, "b": 0.001}):
        slots = mixing.quantised(weights)
        placed, served = mixing.pattern(slots), Counter()
        assert [p[4] for p in placed] == list(range(mixing.PERIOD)) and sum(slots.values()) == mixing.PERIOD
        for t, (s, j, release, deadline, _) in enumerate(placed, 1):
            assert release <= t - 1 < deadline and j == served[s]
            served[s] += 1
            assert all(abs(served[x] - t * n / mixing.PERIOD) < 1 for x, n in slots.items())


@pytest.mark.parametrize("weights", [{f"s{k:03}": 0.5 if k == 0 else 0.5 / 400 for k in range(401)}, {f"s{k}": float((k + 1) ** 3) ** 0.7 for k in range(20)}, {f"s{k:03}": 1.0 + k for k in range(700)}])
def test_schedule_stays_within_one_block_of_the_given_weights(weights):
    total, slots = sum(weights.values()), 6000
    placed, served = mixing.schedule(weights, dict.fromkeys(weights, slots))[:slots], Counter()
    assert [p[4] for p in placed] == list(range(slots))
    for t, (s, j, release, deadline, _) in enumerate(placed, 1):
        assert release <= t - 1 < deadline and j == served[s]
        served[s] += 1
        if t % 10 == 0:
            assert all(abs(served[x] - t * w / total) < 1 + 1e-6 for x, w in weights.items())


def test_mixing_follows_weights_of_many_sources(spark):
    """Half of the weight at one of 601 sources; a block holds one document."""
    data = [(k, "x" * 99, "big" if k < 600 else f"s{k}") for k in range(1200)]
    weights = {"big": 0.5} | {f"s{k}": 0.5 / 600 for k in range(600, 1200)}
    out = mixing.mix(spark.createDataFrame(data, "doc_id long, text string, source string"), weights, block=100).collect()
    assert sorted(r["slot"] for r in out) == list(range(1200))
    for t in range(1, 1201, 50):
        assert abs(sum(r["source"] == "big" and r["slot"] < t for r in out) - t / 2) < 1


def test_mixing(spark, docs, none):
    out = mixing.mix(docs.withColumns({c: F.lit("x") for c in ("shard", "local", "row", "hash", "_s", "slot")}), mixing.supply_weights(mixing.source_sizes(docs)), block=500)
    assert rows(out, "doc_id") == rows(docs, "doc_id")
    assert set(r["source"] for r in out.select("source").collect()) == {"s0", "s1", None}
    assert {"shard", "local", "row", "hash", "_s"} <= set(out.columns)
    blocks = out.select("source", "block", "slot").distinct().collect()
    assert len({r["slot"] for r in blocks}) == len(blocks)
    assert mixing.mix(none, {"a": 1.0}).count() == 0
    assert rows(mixing.mixed_documents(docs), *docs.columns) == rows(docs, *docs.columns)
    with pytest.raises(ValueError, match="without a weight"):
        mixing.mix(docs, {"s0": 1.0})


def test_mixing_equals_brute_force(spark):
    """Block, release, deadline and slot of every row, against blocks cut row by row and a schedule by exact fractions, slot by slot."""
    from fractions import Fraction
    from math import ceil, floor

    rng = random.Random(12)
    data = [(k, "x" * rng.randint(0, 80), rng.choice(["a", "a", "a", "b", "c"])) for k in range(300)]
    sizes = Counter()
    for _, t, s in data:
        sizes[s] += len(t) + 1
    weights = mixing.supply_weights(sizes)
    df = spark.createDataFrame(data, "doc_id long, text string, source string").repartition(3)
    assert mixing.source_sizes(df) == dict(sizes) and mixing.block_size({"a": 10**12}) == 5_000_000
    own, upto = {}, Counter()
    for k, t, s in data:
        own[k] = s, upto[s] // 150
        upto[s] += len(t) + 1
    share = {s: Fraction(w) / sum(map(Fraction, weights.values())) for s, w in weights.items()}
    last, served, want, slot = {s: max(b for x, b in own.values() if x == s) for s in sizes}, Counter(), {}, 0
    while any(served[s] <= last[s] for s in sizes):
        ready = [(ceil((served[s] + 1) / share[s]), -floor(served[s] / share[s]), s) for s in sizes if served[s] <= last[s] and floor(served[s] / share[s]) <= slot]
        if ready:
            deadline, release, s = min(ready)
            want[s, served[s]] = -release, deadline, slot
            served[s] += 1
        slot += 1
    got = mixing.mix(df, weights, block=150).collect()
    assert {r["doc_id"]: (r["source"], r["block"], r["release"], r["deadline"], r["slot"]) for r in got} == {k: (s, b, *want[s, b]) for k, (s, b) in own.items()}


# ---------------------------------------------------------------- 6 neighbours


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[50:80] = x[40]
    data = [(int(i), v.tolist()) for i, v in enumerate(x)] + [(600, None), (620, [0.0] * 8), (640, [float("nan")] * 8), (660, [1.0]), (680, [])]
    got = neighbours.nearest(spark.createDataFrame(data, "vec_id long, embedding array<float>").withColumn("rank", F.lit(1))).collect()
    assert {r["query_id"] for r in got} == set(range(0, 600, 20))
    exact, hit = x.astype(float), 0
    for q in range(0, 600, 20):
        mine = sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])
        assert [r["rank"] for r in mine] == list(range(1, 21))
        assert [(r["score"], r["vec_id"]) for r in mine] == sorted(((r["score"], r["vec_id"]) for r in mine), key=lambda t: (-t[0], t[1]))
        scores = (exact * exact[q]).sum(axis=1)
        assert all(r["score"] == scores[r["vec_id"]] and r["vec_id"] != q for r in mine)
        scores[q] = -np.inf
        hit += len({r["vec_id"] for r in mine} & set(np.lexsort((np.arange(600), -scores))[:20].tolist()))
    assert hit >= 0.9 * 600
    few = spark.createDataFrame([(0, [1.0, 2.0]), (7, [3.0, 1.0])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in neighbours.nearest(few).collect()] == [(0, 1, 7, 5.0)]
    assert neighbours.nearest(few.limit(0)).count() == 0


def test_neighbours_of_the_table(spark):
    found = neighbours.op6_neighbours(spark, "/root/testdata/sf0.01")
    assert neighbours.measured_recall(found, spark.read.parquet("/root/testdata/sf0.01/embeddings.parquet")) >= 0.9


def test_neighbours_leaves_follow_the_rows(spark, monkeypatch):
    """Leaves past the bound are split again by trees of their own; duplicates that cannot be split stay; all rows are in a leaf."""
    monkeypatch.setattr(neighbours, "LEAF_ROWS", 100)
    monkeypatch.setattr(neighbours, "SAMPLE", 150)
    rng = np.random.default_rng(2)
    x = rng.normal(size=(2000, 6))
    x[:400] = x[0]
    df = neighbours.usable(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    most = float((x**2).sum(axis=1).max())
    tree = neighbours.Tree(neighbours._lifted(x[rng.choice(2000, 150, replace=False)], most))
    before = tree.n_leaves
    placed, counts = neighbours.grown(df, tree, 6, most)
    assert counts.sum() == 2000 == placed.count() and tree.n_leaves > 3 * before and sorted(counts)[-2] <= 100
    q = np.append(x[1500], 0.0)
    assert sorted(tree.walk(q, 10**6, counts, 0)) == sorted({k for k in tree.leaf_of if k >= 0})
    found = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"))
    assert neighbours.measured_recall(found, spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")) >= 0.9


def test_neighbours_of_long_vectors_are_exact(spark):
    """Ties and near ties among vectors of length 1e8 are ordered by their exact scores."""
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 6)) * 1e8
    x[100:160] = x[20]
    x[160:200] = x[20] * (1 + 1e-15 * np.arange(40))[:, None]
    got = neighbours.nearest(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), recall=1.0).collect()
    for q in range(0, 300, 20):
        scores = (x * x[q]).sum(axis=1)
        scores[q] = -np.inf
        assert [r["vec_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == np.lexsort((np.arange(300), -scores))[:20].tolist()


# ---------------------------------------------------------------- 7 personal data

PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}


def brute_spans(t):
    out = []
    for kind, p in PATTERNS.items():
        for m in re.finditer(p, t):
            digits = re.sub(r"\D", "", m.group())
            if not (kind == "ip" and any(int(v) > 255 for v in m.group().split(".")) or kind == "card" and not (14 <= len(digits) <= 19 and pii.luhn(digits)) or kind == "phone" and not 10 <= len(digits) <= 15):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda s: (s[1], pii.KINDS.index(s[0])))


def test_base_spans():
    rng = random.Random(4)
    for _ in range(20000):
        t = "".join(rng.choice("0123456789..--  @+ab()é@1") for _ in range(rng.randint(1, 40)))
        assert pii.base_spans(t) == brute_spans(t), t


def test_trees_on_held_out_examples(spark):
    """Thresholds come from calibration; on new examples in other passages they keep precision and find most."""
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    passages = pii.sampled_passages(docs)
    assert {lang for lang, _ in passages} >= {"en", "de"} and len(passages) <= pii.PASSAGES and passages == pii.sampled_passages(docs.repartition(7))
    for own in ((), passages):
        model, limits = pii.trained(own)
        assert len(set(limits.values())) > 1 and all(0 < x <= 2 for x in limits.values())
        texts, spans, labels, langs = pii.examples(2000, 99, own)
        p = pii.boosting.predict(model, np.array([pii.features(t, *s) for t, s in zip(texts, spans, strict=True)], float))
        taken = p >= np.array([limits.get((s[0], lang), limits[s[0], None]) for s, lang in zip(spans, langs, strict=True)])
        labels = np.array(labels)
        assert labels[taken].mean() >= 0.97 and taken[labels == 1].mean() >= 0.9


def test_least_threshold():
    p, y = np.array([0.9, 0.8, 0.8, 0.4, 0.1]), np.array([1, 1, 0, 1, 0])
    assert pii._least(p, y, 1.0) == 0.9 and pii._least(p, y, 0.75) == 0.4 and pii._least(p, 1 - y, 0.9) == 2.0 and pii._least(p[:0], y[:0], 0.5) == 2.0


def test_gate_never_changes_the_candidates():
    rng = random.Random(6)
    parts = ["(", "[", ")", "]", " ", "at", "AT", "At", "dot", "DOT", ".", "jane", "roe", "com", ":", "::", "ab", "fe", "1", "@", "-"]
    for _ in range(30000):
        t = "".join(rng.choice(parts) for _ in range(rng.randint(1, 14)))
        assert pii.GATE.search(t) or not pii.candidates(t), t


@pytest.mark.parametrize("kind, span", [("email", "jane.roe (AT) example (DOT) com"), ("email", "jane [ at ] example [ dot ] com"), ("email", "jane.roe(At)example(Dot)org"), ("ip", "2001:db8::1"), ("ip", "fe80::1ff:fe23:4567:890a"), ("ip", "::1"), ("ip", "2001:db8:85a3::")])
def test_loose_forms_are_found(kind, span):
    assert (kind, 6, 6 + len(span)) in pii.candidates(f"reach {span} today")
    found = pii.spans_of(f"write from {span} today", *pii.trained())
    assert [(s["kind"], s["start"], s["end"]) for s in found] == [(kind, 11, 11 + len(span))]


def test_pii(spark, docs, none):
    got = {r["doc_id"]: r for r in pii.find_pii(docs, "doc_id", "n_chars").collect()}
    assert [(s["kind"], s["base"]) for s in got[30]["spans"]] == [("email", True), ("phone", True), ("ip", True)]
    assert got[5]["spans"] == [] and got[6]["spans"] == [] and pii.find_pii(none, "doc_id").count() == 0
    text = {r["doc_id"]: r["text"] for r in pii.redact_documents(docs).collect()}
    assert text[30] == "mail [EMAIL] or [PHONE], [IP]" and text[5] is None and text[6] == ""
    named = docs.withColumns({"_text": F.lit("x"), "_lang": F.lit(1), "_spans": F.lit(2)})
    assert pii.redact_documents(named).columns == named.columns and {r["doc_id"]: r["text"] for r in pii.redact_documents(named).collect()} == text
    loose = spark.createDataFrame([(1, "call (555) 010-9999 now"), (2, "page 1999-2003 only")], "doc_id long, text string")
    assert {r[0]: [s["kind"] for s in r[1]] for r in pii.find_pii(loose, "doc_id").collect()} == {1: ["phone"], 2: []}


# ---------------------------------------------------------------- 8 Jaccard join


def brute_components(data, size, percent):
    sets = {}
    for i, t in data:
        w = words_of("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in (t or "")))
        sets[i] = {tuple(w[k : k + size]) for k in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            lo, hi = sorted((find(a), find(b)))
            parent[hi] = lo
    return {i: (len(s), find(i)) for i, s in sets.items()}


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (2, 60)])
def test_jaccard(spark, docs, none, size, percent):
    rng = random.Random(size)
    vocabulary = ["w%d" % k for k in range(400)]
    base = [[rng.choice(vocabulary) for _ in range(rng.randint(1, 120))] for _ in range(8)]
    made = []
    for i in range(160):
        w = list(rng.choice(base))
        for _ in range(rng.randint(0, max(1, len(w) // 15))):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        made.append((i, " ".join(w).upper() if i % 7 == 0 else " ".join(w)))
    for df in (spark.createDataFrame(made, "doc_id long, text string").repartition(4), docs):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.jaccard_components(df, size, percent).collect()}
        assert got == brute_components([tuple(r) for r in df.select("doc_id", "text").collect()], size, percent)
    assert jaccard.jaccard_components(none).count() == 0


@pytest.mark.parametrize(("vocabulary", "size", "percent"), [(60, 5, 80), (3000, 4, 85)])
def test_jaccard_of_a_large_family(spark, vocabulary, size, percent):
    """2,000 copies of one text with one to four changed words: most link with few others, all share most grams."""
    rng = random.Random(5)
    own = ["w%d" % k for k in range(vocabulary)]
    base, made = [rng.choice(own) for _ in range(80)], []
    for i in range(2000):
        w = list(base)
        for _ in range(rng.randint(1, 4)):
            w[rng.randrange(80)] = rng.choice(own)
        made.append((i, " ".join(w)))
    ids, m = {}, np.zeros((2000, 60_000), np.float32)
    for i, t in made:
        w = t.split()
        for k in range(len(w) - size + 1):
            m[i, ids.setdefault(tuple(w[k : k + size]), len(ids))] = 1
    both, n = m @ m.T, m.sum(1)
    linked, want = 100 * both >= percent * (n[:, None] + n - both), np.arange(2000)
    while True:
        new = np.array([want[linked[k]].min() for k in range(2000)])
        if (new[new] == want).all():
            break
        want = new[new]
    got = {r["doc_id"]: r["component_id"] for r in jaccard.jaccard_components(spark.createDataFrame(made, "doc_id long, text string").repartition(4), size, percent).collect()}
    assert [got[k] for k in range(2000)] == want.tolist()


def test_jaccard_of_repeated_ids_and_hashes_of_chosen_texts(spark):
    """Rows of one doc_id are one document, with the greatest of their sets, wherever they lie; words that collide modulo 2^64 differ."""
    thue = [0]
    while len(thue) < 2048:
        thue += [1 - x for x in thue]
    a, b = ("".join("ab"[x ^ y] for x in thue) for y in (0, 1))
    long_text = " ".join(f"w{k}" for k in range(60))
    data = [(1, "p q r s"), (1, long_text), (2, long_text + " x"), (3, a), (4, b), (5, "p q r s")]
    for parts in (1, 5):
        got = {(r["doc_id"], r["component_id"]) for r in jaccard.jaccard_components(spark.createDataFrame(data, "doc_id long, text string").repartition(parts)).collect()}
        assert got == {(1, 1), (2, 1), (3, 3), (4, 4), (5, 5)}


def test_very_long_text_in_steps(spark, monkeypatch):
    """A text of many steps has the same sets and counts as one step gives."""
    rng = random.Random(3)
    text = " ".join(rng.choice(["alpha", "beta", "x" * 40, "gamma\n", "é"]) for _ in range(60_000))
    data, offsets = np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())])
    whole = jaccard.gram_sets(data, offsets, 4)[1].tolist()
    monkeypatch.setattr(shared, "STEP_BYTES", 5000)
    monkeypatch.setattr(shared, "LONG_SPAN", 1000)
    assert jaccard.gram_sets(data, offsets, 4)[1].tolist() == whole
    assert {k: int(v[0]) for k, v in quality.count_step(data, offsets).items()} == dict(zip(quality.COUNTS, brute_counts(text), strict=True))


# ---------------------------------------------------------------- 9 quality rules


def brute_counts(t):
    w, t = words_of(t), t or ""
    triples, covered, seen, dup = Counter(zip(w, w[1:], w[2:], strict=False)), set(), set(), 0
    for k in range(len(w) - 2):
        if triples[tuple(w[k : k + 3])] > 1:
            covered |= {k, k + 1, k + 2}
    for line in t.split("\n"):
        if words_of(line):
            dup += line in seen
            seen.add(line)
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(covered)


def test_quality_counts(spark, docs, none):
    rng = random.Random(1)
    odd = spark.createDataFrame([(100 + k, "".join(rng.choice("ab é\n\n  \t#") for _ in range(rng.randint(0, 80)))) for k in range(200)], "doc_id long, text string")
    for df in (docs, odd.withColumns({"lang": F.lit("en"), "source": F.lit("s")})):
        want = sorted(((i, *brute_counts(t)) for i, t in df.select("doc_id", "text").collect()), key=repr)
        got = quality.judge_quality(df, "doc_id")
        assert rows(got, "doc_id", *quality.COUNTS) == want
        assert all(r["base_failed"] == (r["n_words"] < 50 or 100 * r["n_repeat_words"] > 50 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in got.collect())
    assert quality.judge_quality(none, "doc_id").count() == 0


def test_quality_outliers(spark):
    rng = random.Random(8)
    make = lambda n, sign: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) + sign for _ in range(n))
    data = [(k, make(rng.randint(60, 400), ""), "en", "s0" if k < 200 else "s1") for k in range(300)] + [(k, make(rng.randint(60, 400), "###"), "en", "s0") for k in range(300, 315)]
    judged = quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), "doc_id")
    kept = {r["doc_id"] for r in judged.where("kept").collect()}
    assert kept == set(range(300))


def test_quality_of_a_small_source_is_judged_by_its_language(spark):
    """Ten documents with a sign after each word, alone in their source, beside a large source of the language."""
    rng = random.Random(9)
    make = lambda n, sign: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) + sign for _ in range(n))
    data = [(k, make(rng.randint(60, 400), ""), "en", "s0") for k in range(300)] + [(k, make(rng.randint(60, 400), "###"), "en", "s1") for k in range(300, 310)]
    judged = quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), "doc_id")
    assert {r["doc_id"] for r in judged.where("kept").collect()} == set(range(300))


def test_quality_of_a_single_row_of_a_language_or_source(spark):
    rng = random.Random(9)
    make = lambda n, sign: " ".join("".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8))) + sign for _ in range(n))
    data = [(k, make(rng.randint(60, 400), ""), "en", "s0") for k in range(300)] + [(300, make(100, "###"), "en", "s1"), (301, make(100, "###"), "xx", "s0"), (302, make(100, ""), "yy", None)]
    judged = quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), "doc_id")
    assert {r["doc_id"] for r in judged.where("kept").collect()} == {*range(300), 302}


@pytest.mark.parametrize("name", ["length", "word", "symbols", "lines", "repeats"])
def test_quality_moderate_outliers_in_one_statistic(spark, name):
    """Clean rows stay; a cluster of 30 % of a group that is far out in one statistic does not move the estimate."""
    rng = random.Random(10)
    word = lambda: "".join(rng.choice("abcdefghijklm") for _ in range(rng.randint(2, 8)))
    clean = lambda n: [word() for _ in range(n)]

    def odd():
        w = clean(200)
        if name == "length":
            w = clean(60_000)
        elif name == "word":
            w = [x + x for x in w]
        elif name == "symbols":
            w = [x + ("#" if k % 8 == 0 else "") for k, x in enumerate(w)]
        elif name == "lines":
            return "\n".join([" ".join(w)] + [w[0]] * 25)
        else:
            w = w[:120] + w[:50] + w[120:160]
        return " ".join(w)

    n = 3 if name == "length" else 90
    data = [(k, " ".join(clean(rng.randint(60, 400))), "en", "s") for k in range(300)] + [(1000 + k, odd(), "en", "s") for k in range(n)]
    judged = quality.judge_quality(spark.createDataFrame(data, "doc_id long, text string, lang string, source string"), "doc_id")
    assert {r["doc_id"] for r in judged.where("kept").collect()} == set(range(300))


def test_quality_estimate_is_the_subset_of_least_determinant(spark):
    """The distributed estimate against concentration steps in numpy on the same rows, from many random starts."""
    rng = np.random.default_rng(3)
    x = np.concatenate((rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5)), rng.normal(6, 0.5, size=(130, 5))))
    df = spark.createDataFrame([("g", *map(float, r)) for r in x], "grp string, " + ", ".join(f"{f} double" for f in quality.FEATURES))
    got = quality.fit_mcd(df).first()
    best = None
    for _ in range(40):
        h = rng.choice(len(x), 12, replace=False)
        for _ in range(30):
            mu, cov = x[h].mean(0), quality.consistency(0.75) * np.cov(x[h].T, bias=True) + np.diag(np.square(quality.FLOOR))
            h = np.argsort(np.einsum("ij,jk,ik->i", x - mu, np.linalg.inv(cov), x - mu))[: int(0.75 * len(x)) + 1]
        det = np.linalg.slogdet(cov)[1]
        if best is None or det < best[0]:
            best = det, x[h].mean(0)
    assert np.allclose(got["mu"], best[1], atol=0.15) and abs(got["det"] - best[0]) < 0.1


def test_quality_with_clashing_names(docs):
    named = docs.withColumns({c: F.lit("x") for c in ("n_words", "mu", "grp", "_n", "_both", "_lang", "row", "distance", "kept", "f_word")})
    assert quality.keep_quality(named).columns == named.columns
    assert rows(quality.keep_quality(named), "doc_id") == rows(quality.keep_quality(docs), "doc_id")


# ---------------------------------------------------------------- registered queries on whole tables


def documents(spark):
    return {i: t or "" for i, t in spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "text").collect()}


def test_suffix_query(spark):
    got = rows(suffixes.op3_suffix_dedup(spark, DATA), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert got == brute_suffixes(list(documents(spark).items()))


def test_token_query(spark):
    _, library_ = library("byte_bpe_50k.json")
    want, start = [], 0
    for i, t in sorted(documents(spark).items()):
        ids = np.array([*library_.encode(t, add_special_tokens=False).ids, 2], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, token_files.op4_token_files(spark, DATA).select("doc_id", "start", "n_tokens", "ids_crc32").collect())) == want


def test_pii_query(spark):
    texts = documents(spark)
    passages = pii.sampled_passages(spark.read.parquet(f"{DATA}/documents.parquet"))
    model, lang = pii.trained(passages), dict(spark.read.parquet(f"{DATA}/documents.parquet").select("doc_id", "lang").collect())
    mark = lambda spans: ",".join(f"{k}:{s}:{e}" for k, s, e in spans)
    for r in pii.op7_pii(spark, DATA).collect():
        base = brute_spans(texts[r["doc_id"]])
        assert [r[f"n_{k}"] for k in pii.KINDS] == [sum(s[0] == k for s in base) for k in pii.KINDS]
        assert r["base_sha256"] == hashlib.sha256(mark(base).encode()).hexdigest()
        assert r["spans"] == mark((s["kind"], s["start"], s["end"]) for s in pii.spans_of(texts[r["doc_id"]], *model, lang[r["doc_id"]]))


def test_jaccard_query(spark):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.op8_jaccard(spark, DATA).collect()}
    assert got == brute_components(list(documents(spark).items()), 4, 85)


def test_quality_query(spark):
    """Of the labelled documents that pass the base rules, all good ones are kept and all bad ones are not."""
    sf = "/root/testdata/sf0.01"
    judged = quality.op9_quality_rules(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").where("NOT base_failed")
    found = {(r["quality"], r["kept"]): r["count"] for r in judged.groupBy("quality", "kept").count().collect()}
    assert set(found) == {(1, True), (0, False)} and found[1, True] > 100


# ---------------------------------------------------------------- registration


@pytest.mark.parametrize("name", sorted(registry.QUERIES))
def test_registered(spark, name):
    assert registry.QUERIES[name](spark, DATA).limit(1).count() == 1
    assert re.match(r"op\d+_", name)


def test_pipeline(spark):
    import corpus_pipeline

    source = spark.read.parquet(f"{DATA}/documents.parquet")
    docs, seen = source, []
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.materialize(stage(spark, docs, DATA), "stage")
        assert docs.columns == source.columns
        seen.append([tuple(r) for r in docs.select("doc_id", "text").collect()])
    good, single, clean, mixed = seen
    own = {i: brute_counts(t) for i, t in source.select("doc_id", "text").collect()}
    assert all(own[i][0] >= 50 and 2 * own[i][4] <= own[i][0] for i, _ in good)
    groups = brute_components(good, 5, 80)
    assert sorted(i for i, _ in single) == sorted(i for i, (_, c) in groups.items() if i == c)
    text = dict(single)
    model = pii.trained(pii.sampled_passages(spark.createDataFrame(single, "doc_id long, text string").join(source.select("doc_id", "lang"), "doc_id")))
    lang = dict(source.select("doc_id", "lang").collect())
    assert all(t == pii.redacted(text[i], pii.spans_of(text[i], *model, lang[i])) for i, t in clean)
    assert sorted(mixed) == sorted(clean)
    assert {r["doc_id"] for r in corpus_pipeline.run(spark, DATA).collect()} == {i for i, _ in mixed}
