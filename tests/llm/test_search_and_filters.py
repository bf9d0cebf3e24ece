"""Fill-in-middle, URL filter and lexical search against brute force on small hand-made tables."""

import hashlib
import math
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from riskloom.llm import fill_in_middle, lexical_search, url_filter
from riskloom.llm.url_filter import Rule, Vocabulary

EXTRA = "n long, h1 string, form string, terms string, host string, item string, score string"
CLASH = (7, "x", "y", "z", "q", "r", "s")


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# ---- fill-in-middle


def expected_form(doc_id, text, forms=fill_in_middle.Forms()):
    text = text or ""
    digest = sha(f"{forms.seed}:{'' if doc_id is None else doc_id}")
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    n = len(text)
    low, high = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, s, m = forms.markers
    if not text or any(x in text for x in forms.markers) or h[2] % 100 >= 100 - forms.plain_percent:
        return n, "plain", None, None, text
    prefix, middle, suffix = text[:low], text[low:high], text[high:]
    if h[3] % 100 < forms.spm_percent:
        return n, "spm", low, high - low, f"{s}{suffix}{p}{prefix}{m}{middle}"
    return n, "psm", low, high - low, f"{p}{prefix}{s}{suffix}{m}{middle}"


def middle_rows():
    rng = np.random.default_rng(3)
    letters = list("ab c\n.<>PSM") + list("äßéñ") + list("日本語–…") + list("😀𝄞")
    rows = [(i, "".join(rng.choice(letters, rng.integers(0, 80)))) for i in range(150)]
    rows += [(1000, None), (1001, ""), (None, "no id at all"), (None, None), (3, rows[3][1]), (3, "other text, same id")]
    rows += [(1100 + i, t) for i, t in enumerate(["<P>", "a<S>b", "<M", "<", "<P", "<S", "P><S>", "ä" * 50, "😀" * 33])]
    rows += [(1200, "long é " * 700_000), (1201, "a" * 3_000_000)]
    return rows


def test_fill_in_middle_equals_brute_force(spark):
    rows = middle_rows()
    docs = spark.createDataFrame([(*r, *CLASH) for r in rows], f"doc_id bigint, text string, {EXTRA}").repartition(3)
    found = Counter(tuple(r) for r in fill_in_middle.middle_report(docs).collect())
    wanted = Counter()
    for doc_id, text in rows:
        n, form, prefix, middle, output = expected_form(doc_id, text)
        wanted[(doc_id, n, form, prefix, middle, sha(output), sha(text or ""))] += 1
    assert found == wanted
    assert {r[2] for r in found} == {"plain", "spm", "psm"}


def test_every_form_restores_its_text_with_any_markers(spark):
    forms = fill_in_middle.Forms(seed="9", plain_percent=0, spm_percent=50, markers=("[p|", "[s$", "[m."))
    texts = ["", "[p", "a[s$b", "[", "[[", "$.|", "日[本", "x" * 40, "[m", "|[s"] * 8
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    made = fill_in_middle.fill_in_middle(docs, forms)
    found = made.withColumn("back", fill_in_middle.restored_text(made.output, made.form, forms)).collect()
    for r in found:
        assert r["back"] == texts[r["doc_id"]]
        assert (r["n"], r["form"], r["prefix_chars"], r["middle_chars"], r["output"]) == expected_form(
            r["doc_id"], texts[r["doc_id"]], forms
        )


def test_cuts_by_bytes_move_to_the_begin_of_a_character(spark):
    forms = fill_in_middle.Forms(unit="bytes", plain_percent=0)
    texts = ["aé日😀" * k for k in range(1, 40)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id bigint, text string")
    for r in fill_in_middle.fill_in_middle(docs, forms).collect():
        raw = texts[r["doc_id"]].encode()
        digest = sha(f"1:{r['doc_id']}")
        cuts = sorted(int(digest[8 * i : 8 * i + 8], 16) % (len(raw) + 1) for i in range(2))
        chars = [len(raw[:c].decode(errors="ignore")) for c in cuts]
        assert [r["prefix_chars"], r["prefix_chars"] + r["middle_chars"]] == chars
        parts = [len(texts[r["doc_id"]][:c].encode()) for c in chars]
        assert [r["prefix_bytes"], r["prefix_bytes"] + r["middle_bytes"]] == parts


def test_sparse_index_converts_both_ways():
    text = "plain é 日本 😀 and ASCII again, then ü"
    raw = np.frombuffer(text.encode(), np.uint8)
    index = fill_in_middle.SparseExceptions(raw)
    starts = np.array([len(text[:i].encode()) for i in range(len(text) + 1)])
    assert len(index.byte) == sum(ord(c) > 127 for c in text)
    assert (index.to_bytes(np.arange(len(text) + 1)) == starts).all()
    assert (index.to_chars(starts) == np.arange(len(text) + 1)).all()
    inside = np.arange(len(raw) + 1)
    assert (index.to_chars(inside) == np.searchsorted(starts, inside, side="right") - 1).all()


def test_fill_in_middle_refuses_an_unknown_unit(spark):
    docs = spark.createDataFrame([], "doc_id bigint, text string")
    with pytest.raises(ValueError, match="words"):
        fill_in_middle.fill_in_middle(docs, fill_in_middle.Forms(unit="words"))
    assert fill_in_middle.middle_report(docs).count() == 0


# ---- URL filter

URLS = [
    None, "", "no scheme.net/en/", "http://", "http://net", "http://net/", "HTTP://A.NET/x", "http://a.netx/", "http://xnet/y",
    "http://example.net/en/1", "http://www.EXAMPLE.net/en/1?casino", "http://example.net/EN/1", "http://notexample.net/en/",
    "https://example.com/de/2", "https://m.example.com/de/2#x", "https://example.com/de", "https://x.org/fr/casino", "http://org/fr/",
    "http://free-bets.example.com/en/1", "http://free.example.com/en/1", "http://free-free.example.com/", "http://casino.example.org/",
    "http://onlinecasino.example.org/", "http://mycasinox.example.org/", "http://xxx.org/", "http://xxxl.org/", "http://a.org/free/bets",
    "http://a.org/free?bets", "http://a.org/#free-bets", "http://a.org/FREE_Bets", "http://a.org/freebets", "http://a.org/éfree/bets",
    "ftp://user:pw@host.net:8080/en/x", "http://a.org://example.net/en/", "://example.net/en/q", "http://.net/", "http://a..net/en/",
    "http://a.org/\nfree\nbets", "http://日本.org/free-日本-bets", "http://a.org/" + "y/" * 200_000 + "casino", "http://a.org/free", "http://a.org/free",
]


def expected_judgement(url, rules, vocabulary):
    rest = (url or "").partition("://")
    rest = rest[2] if rest[1] else ""
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]

    def fold(t):
        return "".join(c.lower() if c.isascii() else c for c in t)

    host = fold(host)
    fitting = [r for r in rules if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    text, found = host + fold(path), {}
    for term, weight, boundary in vocabulary.terms:
        for at in range(len(text)):
            if text.startswith(term, at):
                sides = [at == 0 or not text[at - 1].isalnum()]
                sides.append(at + len(term) == len(text) or not text[at + len(term)].isalnum())
                if all(sides) if boundary == "whole" else any(sides):
                    found[term] = weight
    if fitting:
        rule = max(fitting, key=lambda r: len(r.text))
        return host, path, rule.text, rule.verdict, found
    return host, path, None, "block" if sum(found.values()) >= vocabulary.bound else "allow", found


def test_url_filter_equals_brute_force(spark):
    small = Vocabulary((("casino", 2, "edge"), ("xxx", 2, "whole"), ("free", 1, "whole"), ("bets", 1, "whole"), ("free-bets", 1, "whole")))
    schema = f"page_id bigint, url string, html string, path string, verdict string, {EXTRA}"
    pages = spark.createDataFrame([(i, u, "h", "p", "v", *CLASH) for i, u in enumerate(URLS)], schema).repartition(3)
    for vocabulary in (small, url_filter.VOCABULARY):
        found = {r["page_id"]: r for r in url_filter.judge_urls(pages, url_filter.RULES, vocabulary).collect()}
        assert len(found) == len(URLS)
        for i, url in enumerate(URLS):
            if url and len(url) > 10_000 and vocabulary is not small:
                continue
            host, path, rule, verdict, hits = expected_judgement(url, url_filter.RULES, vocabulary)
            r = found[i]
            assert (r["host"], r["path"], r["rule"], r["verdict"]) == (host, path, rule, verdict), url
            assert {*r["strict"], *r["soft"]} == set(hits), url


def test_vocabulary_rejects_only_at_its_bound(spark):
    pages = spark.createDataFrame(
        [(1, "http://a.org/poker"), (2, "http://a.org/poker/slots"), (3, "http://a.org/poker/poker"), (4, "http://casino.org/")],
        "page_id bigint, url string",
    )
    verdicts = {r["page_id"]: r["verdict"] for r in url_filter.judge_urls(pages).collect()}
    assert verdicts == {1: "allow", 2: "block", 3: "allow", 4: "block"}
    strict = Vocabulary(url_filter.VOCABULARY.terms, bound=1)
    assert {r["verdict"] for r in url_filter.judge_urls(pages, (), strict).collect()} == {"block"}
    assert {r["verdict"] for r in url_filter.judge_urls(pages, (), Vocabulary(())).collect()} == {"allow"}


def test_url_filter_without_rows_and_with_wrong_terms(spark):
    assert url_filter.judge_urls(spark.createDataFrame([], "page_id bigint, url string")).count() == 0
    with pytest.raises(ValueError, match="boundaries"):
        Vocabulary((("a", 1, "middle"),))
    with pytest.raises(ValueError, match="repeated"):
        Vocabulary((("a", 1, "whole"), ("a", 2, "whole")))


def test_longest_rule_decides():
    rules = url_filter.RuleTable((Rule("block", "b.c", "/"), Rule("allow", "c", "/long/"), Rule("block", "c", "/"), Rule("allow", "b.c", "/long/x")))
    assert rules.longest("a.b.c", "/long/x").text == "b.c/long/x"
    assert rules.longest("a.b.c", "/long/").text == "c/long/"
    assert rules.longest("a.b.c", "/").text == "b.c/"
    assert rules.longest("b.cc", "/") is None
    assert rules.longest("c", "") is None


# ---- lexical search

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return TERM.findall("".join(c.lower() if c.isascii() else c for c in text or ""))


def expected_ranking(docs, items, top):
    counted = [(doc_id, Counter(terms_of(text))) for doc_id, text in docs]
    n_docs = sum(bool(c) for _, c in counted)
    total = sum(sum(c.values()) for _, c in counted)
    df = Counter(t for _, c in counted for t in c)
    out = []
    for item_id, text in items:
        found = []
        for doc_id, c in counted:
            n, score = sum(c.values()), 0
            for t in set(terms_of(text)) & set(c):
                w = math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1)))
                m = 100 - 90 + (90 * n * n_docs) // total
                score += w * ((1_000_000_000 * c[t]) // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc_id is None, doc_id or 0, doc_id))
        found.sort(key=lambda x: x[:3])
        out += [(item_id, k + 1, x[3], -x[0]) for k, x in enumerate(found[:top])]
    return Counter(out)


def search_rows():
    rng = np.random.default_rng(8)
    words = [f"w{i}" for i in range(120)] + ["Ähre", "日本", "don't", "C3PO", "x_y"]
    weight = 1 / np.arange(1, len(words) + 1)

    def prose(n):
        return " ".join(rng.choice(words, n, p=weight / weight.sum()))

    texts = [prose(int(n)) for n in rng.integers(1, 120, 160)]
    docs = list(enumerate(texts))
    docs += [(500 + i, texts[7]) for i in range(30)] + [(600 + i, texts[9] + " w3") for i in range(12)]
    docs += [(700, None), (701, ""), (702, " .,; \n"), (None, texts[4]), (None, texts[4]), (None, None), (7, texts[7]), (800, prose(4000))]
    items = [(i, prose(int(n))) for i, n in enumerate(rng.integers(1, 30, 25))]
    items += [(100, texts[7]), (101, None), (102, ""), (103, "nowhere found"), (104, "W1 w1, w1"), (104, "W1 w1, w1"), (None, texts[9])]
    return docs, items


@pytest.mark.parametrize(
    "search",
    [lexical_search.Search(), lexical_search.Search(top=3, segment=200, width=2, block=60), lexical_search.Search(segment=1, width=1)],
)
def test_lexical_search_equals_brute_force(spark, search):
    docs, items = search_rows()
    frame = spark.createDataFrame([(*r, *CLASH) for r in docs], f"doc_id bigint, text string, {EXTRA}").repartition(3)
    asked = spark.createDataFrame([(*r, *CLASH) for r in items], f"item_id bigint, text string, {EXTRA}").repartition(2)
    found = Counter(tuple(r) for r in lexical_search.search_documents(frame, asked, search).collect())
    assert found == expected_ranking(docs, items, search.top)


def test_lexical_search_on_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id bigint, text string")
    nothing = spark.createDataFrame([], "item_id bigint, text string")
    docs = spark.createDataFrame([(1, "a b")], "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "a b")], "item_id bigint, text string")
    assert lexical_search.search_documents(none, items).count() == 0
    assert lexical_search.search_documents(docs, nothing).count() == 0
    # The logarithm of (2 * 1 + 2) / (2 * 1 + 1) counts 287 for each of the two terms.
    found = lexical_search.search_documents(docs, items).collect()
    assert [tuple(r) for r in found] == [(1, 1, 1, 2 * 287 * (1_000_000_000 // (1000 + 8 * (10 + 90))))]


def test_intervals_without_a_rare_term_are_never_split():
    rng = np.random.default_rng(2)
    size, rare = 4000, 40
    terms = [np.array([0, 1 + i % 7, *([8] if i % 100 == 3 else [])], np.int32) for i in range(size)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in terms])])
    flat = np.concatenate(terms)
    corpus = lexical_search.Corpus(size, 3 * size, np.bincount(flat, minlength=9))
    ids = rng.permutation(size)
    segment = lexical_search.Segment(
        ids, np.zeros(size, bool), np.full(size, 3), offsets, flat, np.ones(len(flat), np.int32), corpus, corpus.weights(), 10
    )
    best = lexical_search.Best(10)
    scored = segment.search(np.array([0, 8]), best, 4)
    assert list(best.id) == sorted(ids[3::100])[:10] and len(set(best.score)) == 1
    assert scored < 4 * rare


def test_range_maxima_equal_brute_force():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(30, rng.integers(0, 12), replace=False)).astype(np.int32) for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = np.concatenate(rows)
    counts = rng.integers(1, 9, len(flat)).astype(np.int32)
    corpus = lexical_search.Corpus(300, 5000, np.bincount(flat, minlength=30))
    segment = lexical_search.Segment(
        np.arange(300), np.zeros(300, bool), rng.integers(5, 50, 300), offsets, flat, counts, corpus, corpus.weights(), 300
    )
    for term in range(30):
        start, end = segment.start[term], segment.start[term + 1]
        for a in range(start, end):
            for b in range(a + 1, end + 1):
                bound, split = segment._bounds(np.array([[a]]), np.array([[b]]))
                assert bound[0] == segment.impact[a:b].max()
                assert segment.impact[a:b][segment.place[a:b] == split[0]][0] == bound[0]


def test_segments_hold_every_document_once():
    sizes = [3, 0, 5, 0, 0, 40, 1, 2]
    lists = pa.array([list(range(s)) for s in sizes], pa.list_(pa.int32()))
    ids = pa.array([0, 1, None, 3, 4, 5, 6, 7], pa.int64())
    batch = pa.RecordBatch.from_arrays([ids, pa.array(sizes, pa.int64()), lists, lists], names=["doc_id", "n", "terms", "counts"])
    for postings in (1, 5, 8, 1000):
        parts = list(lexical_search.segments(iter([batch, batch.slice(2, 4)]), postings))
        assert sum(len(p[0]) for p in parts) == 12
        assert [int(s) for p in parts for s in p[3]] == [*sizes, *sizes[2:6]]
        assert all(p[3].sum() <= max(postings, p[3].max()) for p in parts)
        assert all(len(p[4]) == len(p[5]) == p[3].sum() for p in parts)
