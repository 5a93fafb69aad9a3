"""Nulls, ties, repeated rows, empty tables, clashing names, very long texts and hot keys; brute-force versions of what SQL can't say."""

import itertools
import json
import math
import random
import re
import zlib
from html.parser import HTMLParser

import numpy as np
import pytest

from gridloom.llm import decontam, jaccard, langid, quality, sharding, substring, tokens, toxicity, urlfilter, warc
from gridloom.llm.queries import tokenizer_file
from gridloom.sources.tables import table
from tests.llm.test_operators import DOCS, brute_base, brute_classes, brute_hits, brute_removed, corpus, frame, near_group, sets

SF = "/root/testdata/sf0.001"


# substrings


def as_found(df):
    return {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in df.collect()}


def test_substring_ids_at_both_ends_of_int64(spark):
    p = " ".join(f"p{i}" for i in range(20))
    rows = [((1 << 62) + 5, p + " a", "en", "s", 0), ((1 << 63) - 1, p + " b", "en", "s", 0), ((1 << 62) + 9, p + " c", "en", "s", 0), (-(1 << 63), "x " + p, "en", "s", 0)]
    assert as_found(substring.dedup(frame(spark, rows))) == brute_removed(rows)
    assert as_found(substring.dedup(frame(spark, rows[:3]))) == brute_removed(rows[:3])


@pytest.mark.parametrize("hot", [0, 2, 1000])
def test_substring_hot_anchor(spark, monkeypatch, hot):
    """A phrase that half of all documents have, with other words around it in each, and copies of passages beside it."""
    monkeypatch.setattr(substring, "HOT", hot)
    rng = random.Random(3)
    word = lambda: f"w{rng.randrange(10**6)}"
    rows = []
    for i in range(80):
        own = [word() for _ in range(30)]
        if i % 2:
            own[10:15] = "all rights reserved by us".split()
        if i % 8 == 1 and rows:
            own = rows[0][1].split()[:20] + own
        rows.append((i, " ".join(own), "en", "s", 0))
    rows[0] = (0, "x y z all rights reserved by us " + " ".join(word() for _ in range(20)), "en", "s", 0)
    rows[9] = (9, "new " + rows[0][1] + " end", "en", "s", 0)
    assert as_found(substring.dedup(frame(spark, rows))) == brute_removed(rows)


def test_substring_repeated_null_and_long(spark):
    rows = corpus(4)
    long = (700, " ".join(f"n{i % 5000}" for i in range(40_000)), "en", "s", 0)
    rows += [long, (701, long[1][:9000] + " z", "en", "s", 0)]
    assert as_found(substring.dedup(frame(spark, rows))) == brute_removed(rows)
    p = " ".join(f"p{i}" for i in range(20))
    twice = substring.dedup(frame(spark, [(1, p, "a", "b", 0), (1, p, "a", "b", 0), (None, p, "a", "b", 0), (2, p, "a", "b", 0)])).collect()
    assert sorted((str(r["doc_id"]), r["n_removed"]) for r in twice) == [("1", 0), ("1", 0), ("2", 20), ("None", 0)]
    assert substring.dedup(frame(spark, [])).count() == 0 and substring.keep(frame(spark, [])).count() == 0


def test_keeps_carry_columns_of_any_name(spark):
    p = " ".join(f"p{i}" for i in range(20))
    names = ["_kept", "_d", "_t", "_row", "th", "tk", "kept_text", "n_removed", "class_id", "comp", "rep", "_g", "n_words", "kept", "words", "_w", "item", "m0"]
    df = frame(spark, [(1, p, "en", "s", 5), (2, f"start {p} end", "en", "s", 5), (3, "a b c", "en", "s", 5)]).selectExpr("*", *[f"doc_id + {i} as {n}" for i, n in enumerate(names)])
    bench = spark.createDataFrame([(1, "a b c", "x", 1)], "item_id long, text string, th string, _w int")
    for kept, ids in ((substring.keep(df), {1, 2, 3}), (decontam.keep(df, bench), {1, 2}), (jaccard.keep(df), {1, 3}), (quality.keep(df), None)):
        assert kept.columns == df.columns
        got = kept.collect()
        assert ids is None or {r["doc_id"] for r in got} == ids
        assert all(r[n] == r["doc_id"] + i for r in got for i, n in enumerate(names))


# decontamination


def test_decontamination_edges(spark):
    bench = spark.createDataFrame([(1, " ".join(f"b{i}" for i in range(12))), (2, " ".join(f"b{i}" for i in range(12))), (None, "zz yy"), (3, "")], "item_id long, text string")
    long = " ".join(f"w{i}" for i in range(30_000)) + " b0 b1 b2 b3 b4 b5 b6 b7 b8 b9 end"
    rows = [(1, long, "en", "s", 0), (1, long, "en", "s", 0), (None, "zz yy", "en", "s", 0), (4, "", "en", "s", 0), (5, None, None, None, None)]
    got = decontam.report(frame(spark, rows), bench).collect()
    assert len(got) == 5
    for r in got:
        text = {1: long, None: "zz yy"}.get(r["doc_id"])
        n, hit, ids, _ = brute_hits(text, [(1, bench.first()["text"]), (2, bench.first()["text"]), (None, "zz yy")])
        assert (r["n_words"], r["n_hit"]) == (n, hit) and r["n_items"] == (2 if r["doc_id"] == 1 else 0)
    assert decontam.report(frame(spark, []), bench).count() == 0 and decontam.keep(frame(spark, []), bench).count() == 0


# near copies


def test_jaccard_hot_keys_in_pieces(spark, monkeypatch):
    for name, value in (("PIECES", 2), ("HOLDERS", 3), ("BLOCK", 10)):
        monkeypatch.setattr(jaccard, name, value)
    rows = near_group(60, 8) + [(500 + i, t, "en", "s", 0) for i, (_, t, *_) in enumerate(near_group(20, 9))]
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(frame(spark, rows)).collect()}
    s = {t: sets(t) for _, t, *_ in rows}
    links = {t: sum(t != u and len(s[t] & s[u]) >= 0.8 * len(s[t] | s[u]) for u in s) for t in s}
    classes = brute_classes(rows)
    assert got == {i: (classes[i], links[t]) for i, t, *_ in rows}


def test_jaccard_nulls_repeats_ties_and_long_texts(spark):
    ten = [f"x{i}" for i in range(13)]
    long = " ".join(f"l{i}" for i in range(30_000))
    # nine shingles each, eight of ten in common: exactly the similarity
    rows = [(4, " ".join(ten), "a", "b", 0), (2, " ".join([*ten[:12], "y"]), "a", "b", 0), (None, " ".join(ten), "a", "b", 0), (None, "alone here", "a", "b", 0), (4, " ".join(ten), "a", "b", 0), (8, long, "a", "b", 0), (9, long + " z", "a", "b", 0), (7, None, None, None, None), (6, " ", "a", "b", 0)]
    got = sorted(((str(r["doc_id"]), r["class_id"], r["n_links"]) for r in jaccard.classes(frame(spark, rows)).collect()), key=str)
    assert got == sorted([("4", 2, 1), ("2", 2, 1), ("None", 2, 1), ("None", None, 0), ("4", 2, 1), ("8", 8, 1), ("9", 8, 1), ("7", 7, 0), ("6", 6, 0)], key=str)
    assert jaccard.classes(frame(spark, [])).count() == 0 and jaccard.keep(frame(spark, [])).count() == 0


# SentencePiece


GIANTS = ["--" * 400, "ab" * 300, "z" * 900, "日本語のテキスト" * 60, " ".join("the quick brown fox" for _ in range(60)), "▁ \n" * 150, "x y" + "-=" * 200 + " tail of words"]


@pytest.mark.parametrize("chunk", [16, 64])
def test_sentencepiece_ids_do_not_depend_on_chunks(spark, chunk):
    df = spark.createDataFrame([*enumerate(GIANTS), (50, GIANTS[0]), (51, None), (52, "")], "doc_id long, text string")
    whole = {r["doc_id"]: r["ids"] for r in tokens.encode(df, tokenizer_file()).collect()}
    cut = tokens.encode(df, tokenizer_file(), giant=200, chunk=chunk).collect()
    assert len(cut) == len(GIANTS) + 3 and all(r["ids"] == whole[r["doc_id"]] for r in cut) and all(r["round_trip"] for r in cut if r["doc_id"] != 51)


def test_sentencepiece_ties_go_to_the_shortest_last_piece():
    vocab = tokens.Vocabulary(tokenizer_file())
    rng = random.Random(2)
    for _ in range(30):
        text = "▁" + "".join(rng.choice("-=ab") for _ in range(rng.randint(1, 60)))
        best, last = [0.0], [0]
        for e in range(1, len(text) + 1):
            pieces = [(vocab.ids.get(text[e - n : e]), n) for n in range(1, min(e, vocab.longest) + 1)]
            found = [(best[e - n] + vocab.scores[i], n) for i, n in pieces if i is not None] + ([] if text[e - 1] in vocab.ids else [(best[e - 1] + vocab.unknown_score, 1)])
            top = max(s for s, _ in found)
            best.append(top)
            last.append(min(n for s, n in found if s == top))
        e, want = len(text), []
        while e:
            i = vocab.ids.get(text[e - last[e] : e])
            want = (vocab.fallback(text[e - 1]) if i is None else [i]) + want
            e -= last[e]
        assert tokens.Stretches(vocab).encode(vocab.stretch.findall(text))[0].tolist() == want


def test_sentencepiece_empty_table(spark):
    assert tokens.encode(spark.createDataFrame([], "doc_id long, text string"), tokenizer_file()).count() == 0


# WARC


class Reader(HTMLParser):
    """The visible text by a parser of another kind."""

    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.out, self.links, self.hidden = [], [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if re.fullmatch(warc.BLOCKS, tag) else "")
        self.links += [v for k, v in attrs if tag == "a" and k == "href"][:1]

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style", "noscript", "template")
        self.out.append("\n" if re.fullmatch(warc.BLOCKS, tag) else "")

    def handle_data(self, data):
        self.out.append("" if self.hidden else data)


def test_warc_text_and_links_match_a_parser(spark):
    pages = table(spark, SF, "pages")
    html = {r["page_id"]: r["html"] for r in pages.collect()}
    got = warc.derive(warc.responses(pages), "page_id").collect()
    assert len(got) == 2 * len(html)
    for r in got:
        p = Reader()
        p.feed(html[r["page_id"]] or "")
        p.close()
        if r["type"] == "conversion":
            want = re.sub("[ \t\x0b\f\r\xa0]+", " ", "".join(p.out))
            assert r["block"] == re.sub(" ?\n[ \n]*", "\n", want).strip(" \n")
        else:
            assert json.loads(r["block"])["links"] == p.links


def test_warc_references_comments_long_pages_and_names(spark):
    long = "<p>" + "word &amp; &eacute; " * 20_000 + "</p>"
    rows = [(1, "u", "<title>T&eacute;</title>&#38;lt; &euro; &uuml;<!-- <title>no</title> <a href=x> -->"), (2, "u", "<!-- <title>no</title> -->a"), (3, "u", long)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {(r["page_id"], r["type"]): r["block"] for r in warc.derive(warc.responses(df), "page_id").collect()}
    assert got[1, "conversion"] == "Té\n&lt; € ü" and '"title":"Té"' in got[1, "metadata"] and '"title":""' in got[2, "metadata"]
    assert got[3, "conversion"] == ("word & é " * 20_000).strip()
    source = warc.responses(df).selectExpr("*", "page_id as _text", "page_id as block_digest", "page_id as r")
    assert [r["_text"] for r in warc.derive(source, "_text").collect()] == [1, 1, 2, 2, 3, 3]
    assert warc.derive(warc.responses(df.limit(0)), "page_id").count() == 0


# URL rules


def test_url_rules_without_tokens_and_by_ties(spark):
    pages = spark.createDataFrame([(1, "http://abc12345x.net/p"), (2, "http://ok.net/p"), (2, "http://ok.net/p"), (3, None), (4, "http://organic.com/"), (5, "http://a.org"), (6, "http://z.net/" + "q/" * 20_000 + "spam-x")], "page_id long, url string")
    rules = urlfilter.rules(spark, [("block", "org", ""), ("allow", "org", "")], [(r"^[^/]*\d{5}", []), (r"^[^/]*\d{5}", [])])
    got = sorted((r["page_id"], r["verdict"], r["rule"]) for r in urlfilter.judge(pages, rules).collect())
    assert got == [(1, "block", None), (2, "allow", None), (2, "allow", None), (3, "allow", None), (4, "allow", None), (5, "block", "org"), (6, "allow", None)]
    none = urlfilter.judge(pages, urlfilter.rules(spark, [], [])).collect()
    assert len(none) == 7 and {r["verdict"] for r in none} == {"allow"}


def test_url_rules_by_the_thousand_match_brute_force(spark):
    rng = random.Random(5)
    name = lambda: "".join(rng.choice("abcde") for _ in range(rng.randint(2, 4)))
    lines = [f"{rng.choice(['allow', 'block'])} {'.'.join(name() for _ in range(rng.randint(1, 2)))}.{rng.choice(['org', 'net'])}/{rng.choice(['', name(), name() + '/'])}" for _ in range(7000)]
    lines += [rng.choice(["*/{0}-{1}/*", "{0}.{1}.*", "*//*{0}*", ".{0}.net/{1}/"]).format(name(), name()) for _ in range(3000)] + ["! comment", "", "e*7"]
    urls = [f"http://{'.'.join(name() for _ in range(rng.randint(1, 3)))}.{rng.choice(['org', 'net', 'com'])}/{'/'.join(rng.choice([name(), name() + '-' + name()]) for _ in range(rng.randint(0, 3)))}" for _ in range(600)]
    got = {r["page_id"]: (r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.listed(spark.createDataFrame([(x,) for x in lines], "value string"))).collect()}
    prefixes = [(v, h, p) for v, h, p in (re.match(r"(allow|block) ([^/]+)(.*)$", x).groups() for x in lines[:7000])]
    patterns = [re.compile(".*".join(map(re.escape, re.split(r"[*]+", x)))) for x in [*lines[7000:10000], "e*7"]]
    for i, u in enumerate(urls):
        host, path = re.match("http://([^/]*)(.*)$", u).groups()
        fit = sorted((len(h + p), h + p, v) for v, h, p in prefixes if (host == h or host.endswith("." + h)) and path.startswith(p))
        want = (fit[-1][1], fit[-1][2]) if fit else (None, "block" if any(p.search(host + path) for p in patterns) else "allow")
        assert got[i] == want, u
    assert sum(r is not None for r, _ in got.values()) > 20 and sum(v == "block" and r is None for r, v in got.values()) > 10


# toxicity


def test_toxicity_matches_a_plain_version(spark):
    rng = random.Random(4)
    words = [f"{a}{b}word" for a in "bcdfg" for b in "aeiou"]
    rows = [(i, " ".join(rng.choice(words) for _ in range(rng.randint(0, 40))) + " Vile nasty" * (i % 3), "en", "s", 0) for i in range(300)] + [(1000, None, None, None, None), (1001, "", "en", "s", 0), (1002, "vile " * 30_000, "en", "s", 0), (5, "repeated row", "en", "s", 0)]
    df = frame(spark, rows)
    graded = spark.createDataFrame([(i, i % 3) for i in range(300)] + [(7, 1), (None, 2), (8, None)], "doc_id long, grade int")
    model = toxicity.train(df, graded)
    assert (np.diff(model.thresholds) > 0).all()
    got = sorted(((r["doc_id"], r["severity"], r["grade"], r["toxic"]) for r in toxicity.score(df.selectExpr("*", "1 as severity", "2 as grade"), model).collect()), key=repr)

    def plain(text):
        n = {}
        for w in re.findall(r"[^\W\d_]+", text or ""):
            n[w] = n.get(w, 0) + 1
        norm = math.sqrt(sum(math.log1p(c) ** 2 for c in n.values())) or 1.0
        s = sum(math.log1p(c) / norm * float(sum(model.weights[f] for f in toxicity.features(w))) for w, c in n.items())
        up = [1 / (1 + math.exp(-(t - s))) for t in model.thresholds]
        p = np.diff([0.0, *up, 1.0])
        return float(p @ np.arange(3)), 1 - p[0] >= toxicity.TOXIC_AT, int(1 + p[1:].argmax()) if 1 - p[0] >= toxicity.TOXIC_AT else 0

    want = sorted(((i, *[plain(t)[k] for k in (0, 2, 1)]) for i, t, *_ in rows), key=repr)
    assert [(a[0], *a[2:]) for a in got] == [(b[0], *b[2:]) for b in want] and np.allclose([a[1] for a in got], [b[1] for b in want], atol=1e-5)
    by = {a[0]: a for a in got}
    mean = [np.mean([by[i][1] for i in range(k, 300, 3) if i != 5]) for k in range(3)]
    assert mean[0] + 0.2 < mean[1] < mean[2]
    assert toxicity.score(df.limit(0), model).count() == 0


# language


def test_language_pair_expectations_match_enumeration():
    rng = np.random.default_rng(3)
    emit, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths, at, want = np.array([4, 1, 4]), 0, np.zeros((3, 3))
    for n in lengths:
        pairs, total = np.zeros((3, 3)), 0.0
        for path in itertools.product(range(3), repeat=int(n)):
            p = np.exp(start[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path)))
            total += p
            for a, b in itertools.pairwise(path):
                pairs[a, b] += p
        want += pairs / total
        at += n
    post, got = langid.expected(emit, trans, start, lengths)
    assert np.allclose(got, want) and np.allclose(post, langid.posteriors(emit, trans, start, lengths))


def test_features_of_many_words():
    """Those of each word alone, in the same order: sums of weights are the same to the bit."""
    rng = random.Random(1)
    words = ["a", "I", "ab", "Éa", "straße", "İstanbul", "𐐀𐐁", "aé²", "abc", "abcd", "ǅ", "x" * 300, "\ud800"] + ["".join(rng.choices("abcdefgéßЖ漢𐐀İ", k=rng.randint(1, 14))) for _ in range(500)]
    flat, count = langid.features_of(words)
    assert [x.tolist() for x in np.split(flat, np.cumsum(count)[:-1])] == list(map(langid.features, words))


def test_language_spans_of_mixed_texts(spark):
    rng = random.Random(2)
    stems = {"en": ["the", "which", "thing", "working", "house", "through"], "de": ["der", "nicht", "schließen", "straße", "wurden", "über"]}
    prose = lambda lang, n: " ".join(rng.choice(stems[lang]) for _ in range(n))
    train = frame(spark, [(i, prose("en" if i % 2 else "de", 30), "en" if i % 2 else "de", "s", 0) for i in range(160)])
    tagger = langid.train(train)
    parts = [("en", prose("en", 12)), ("de", prose("de", 9)), ("en", prose("en", 10))]
    mixed = " ".join(t for _, t in parts) + " 12 34."
    long = prose("de", 30_000)
    rows = frame(spark, [(1, mixed, None, None, 0), (1, mixed, None, None, 0), (2, None, None, None, 0), (3, "12 34", "en", "s", 0), (4, long, "en", "s", 0)]).selectExpr("*", "1 as spans", "2 as score")
    got = [(r["doc_id"], [(s["lang"], mixed[s["start"] : s["stop"]]) for s in r["spans"]]) for r in langid.label_spans(rows, tagger).collect()]
    assert got[0] == got[1] == (1, parts) and got[2] == (2, []) and got[3] == (3, []) and [x for x, _ in got[4][1]] == ["de"]
    assert {r["doc_id"]: r["lang_pred"] for r in langid.predict(rows, tagger).collect()} == {1: "en", 2: "und", 3: "und", 4: "de"}
    assert langid.label_spans(rows.limit(0), tagger).count() == 0


# shards


def test_shards_keep_groups_whole(spark):
    rng = random.Random(6)
    rows = [(i, f"{rng.choice('abc')} " * rng.randint(1, 60) + str(rng.randrange(700)), "en", "s", 0) for i in range(4000)] + [(9000 + i, "hot " * 3, "en", "s", 0) for i in range(2500)] + [(20_000, "giant " * 9000, "en", "s", 0)] + [(30_000 + i, "medium group", "en", "s", 0) for i in range(90)]
    got = sharding.shard(frame(spark, rows).selectExpr("*", "1 as shard", "2 as key", "3 as item")).collect()
    text = {i: t for i, t, *_ in rows}
    assert sorted(r["doc_id"] for r in got) == sorted(text)
    where = {}
    for r in got:
        assert r["size"] == 16 + len(text[r["doc_id"]]) and r["text_crc32"] == zlib.crc32(text[r["doc_id"]].encode()) and r["law"] == "bytes" and 0 <= r["shard"] < 40
        where.setdefault(text[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for t, s in where.items() if not t.startswith("hot")) and len(where["hot " * 3]) > 10
    for k in range(40):
        slots = sorted(r["slot"] for r in got if r["shard"] == k)
        assert slots == list(range(len(slots)))


def test_shard_packing_matches_a_plain_version():
    rng = np.random.default_rng(2)
    items = np.r_[rng.pareto(1.5, (300, 3)) + 0.1, np.ones((5, 3))]
    got = sharding.pack(items, 7)
    v = [[float(x) for x in row] for row in items / items.sum(0) * 7]
    room, want = [[1.0] * 3 for _ in range(7)], [0] * len(v)
    for i in sorted(range(len(v)), key=lambda i: (-max(v[i]), i)):
        after = [[a - b for a, b in zip(r, v[i], strict=True)] for r in room]
        fits = [k for k in range(7) if min(after[k]) >= -1e-9]
        k = max(fits, key=lambda k: (sum(a * b for a, b in zip(room[k], v[i], strict=True)), -k)) if fits else max(range(7), key=lambda k: (after[k][0], -k))
        room[k], want[i] = after[k], k
    assert got.tolist() == want


# quality


def vector(t):
    n, chars, symbols, dup, rep, failed = brute_base(t)
    lines = len([x for x in (t or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)])
    root = lambda a, b: math.sqrt(a / b) if b else 0.0
    return failed, n, lines, [math.log(chars / n) if n else 0.0, root(symbols, chars), root(len(re.findall("[A-Z]", t or "")), chars), root(dup, lines), root(rep, n)]


def brute_quality(rows):
    """(kept, distance) by doc_id: the estimates with numpy, a group at a time."""
    at = lambda b, share: sorted(b)[math.ceil(len(b) * share - 1e-9) - 1]
    info = [(i, (lang, source), *vector(t)) for i, t, lang, source, *_ in rows]
    x, noise = np.array([r[5] for r in info]), np.array([[1 / (4 * max(u, 0.1)) for u in (r[3], r[3], r[3], r[4], r[3] / 10)] for r in info])
    passed = np.array([not r[2] for r in info])
    keys = {(): (None, passed)}
    for r in info:
        for k in ((r[1][0],), r[1]):
            mine = np.array([q[1][: len(k)] == k for q in info])
            keys.setdefault(k, (k[:-1], mine & passed))
    dist = lambda m, c, some: np.array([v @ np.linalg.solve(c + np.diag(e), v) for v, e in zip(x[some] - m, noise[some], strict=True)])

    def moments(some, scale):
        z = x[some]
        return (len(z), z.mean(0), scale * (z.T @ z / len(z) - np.outer(z.mean(0), z.mean(0)))) if len(z) else (0, np.zeros(5), np.zeros((5, 5)))

    def shrunk(raw):
        out = {}
        for k in sorted(keys, key=len):
            n, m, c = raw[k]
            if k:
                pm, pc, _ = out[keys[k][0]]
                a, b = n / (n + quality.CENTRE), n / (n + quality.PRIOR)
                off = m - pm if n else np.zeros(5)
                m, c = a * m + (1 - a) * pm, b * c + (1 - b) * pc + a * quality.CENTRE / (n + quality.PRIOR) * np.outer(off, off)
            out[k] = (m, c, np.linalg.slogdet(c + quality.RIDGE * np.eye(5))[1])
        return out

    def step(now):
        raw = {}
        for k, (_, some) in keys.items():
            idx = np.flatnonzero(some)
            d = np.floor(np.log(np.maximum(dist(now[k][0], now[k][1], idx), 1e-9)) * quality.FINE_LOG) if len(idx) else np.zeros(0)
            raw[k] = moments(idx[d <= at(d, quality.SUPPORT)] if len(idx) else idx, quality.CONSISTENCY)
        return shrunk(raw)

    starts = [{}, {}]
    for k, (_, some) in keys.items():
        idx = np.flatnonzero(some)
        if not len(idx):
            for s in starts:
                s[k] = moments(idx, 1.0)
            continue
        bins = np.floor(x[idx] * quality.FINE)
        m = np.array([(at(b, 0.5) + 0.5) / quality.FINE for b in bins.T])
        s = np.array([(at(b, 0.75) - at(b, 0.25)) / quality.FINE / 1.349 for b in bins.T])
        starts[0][k] = (len(idx), m, np.diag(s * s))
        starts[1][k] = moments(idx, 1.0)
    runs = [shrunk(s) for s in starts]
    for _ in range(quality.FIRST_STEPS):
        runs = [step(r) for r in runs]
    best = {k: min((r[k] for r in runs), key=lambda e: e[2]) for k in keys}
    for _ in range(quality.MOST_STEPS):
        new = step(best)
        fell = {k for k in keys if new[k][2] < best[k][2] - quality.FALL}
        best |= {k: new[k] for k in fell}
        if not fell:
            break
    out = {}
    for j, r in enumerate(info):
        d = dist(*best[r[1]][:2], np.array([j]))[0]
        out[r[0]] = (bool(passed[j] and d <= quality.CUTOFF), math.sqrt(d))
    return out


def mixed_quality(seed=5, n=240):
    rng = random.Random(seed)
    word = lambda a, b: "".join(rng.choice("abcdefghijKL") for _ in range(rng.randint(a, b)))
    rows = []
    for i in range(n):
        lang, source = rng.choice([("en", "web"), ("en", "web"), ("en", "law"), ("de", "web"), (None, "x"), ("fr", None)])
        text = "\n".join(" ".join(word(2, 9 if lang == "en" else 14) for _ in range(rng.randint(3, 9))) for _ in range(rng.randint(3, 9)))
        if rng.random() < 0.08:
            text += " ### $$ <<>> " * rng.randint(1, 30)
        if rng.random() < 0.1:
            text += "\nsame line\nsame line" * rng.randint(1, 6)
        rows.append((i, text, lang, source, 0))
    return rows + [(900, rows[0][1], *rows[0][2:]), (901, None, "zz", "only failed", 0), (902, "", None, None, 0), (903, "q " * 5000, "en", "web", 0)]


def test_quality_verdicts_match_brute_force(spark):
    rows = mixed_quality()
    got = {r["doc_id"]: (r["kept"], r["distance"]) for r in quality.score(frame(spark, rows)).collect()}
    want = brute_quality(rows)
    assert {i: k for i, (k, _) in got.items()} == {i: k for i, (k, _) in want.items()}
    assert np.allclose([got[i][1] for i in want], [d for _, d in want.values()], rtol=1e-6)
    assert 0 < sum(not want[i][0] for i in range(240)) < 80


def test_quality_without_rows_or_passing_rows(spark):
    assert quality.score(frame(spark, [])).count() == 0 and quality.keep(frame(spark, [])).count() == 0
    got = quality.score(frame(spark, [(1, "a b", "en", "s", 0), (1, "a b", "en", "s", 0), (2, None, None, None, None)])).collect()
    assert len(got) == 3 and not any(r["kept"] for r in got)


def test_schema_constant_names_the_documents_table(spark):
    assert frame(spark, []).columns == [c.split()[0] for c in DOCS.split(", ")]
