"""Each operator on small fixtures: nulls, empty and repeated rows, ties, empty tables, clashing columns; brute force where SQL can't tell."""

import hashlib
import itertools
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from gridloom.llm import decontam, jaccard, langid, quality, sharding, substring, tokens, toxicity, urlfilter, warc
from gridloom.llm.queries import tokenizer_file

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def frame(spark, rows, schema=DOCS):
    return spark.createDataFrame(rows, schema)


def corpus(seed=1, n=60):
    """Texts with near and exact copies, shared passages, nulls, blanks and one-word texts."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(400)]
    prose = lambda k: [rng.choice(vocab) for _ in range(k)]
    passage, out = prose(30), []
    for i in range(n):
        kind = i % 6
        if kind == 0 or not out:
            t = prose(rng.randint(40, 120))
        elif kind == 1:
            t = list(rng.choice([x for x in out if x]))
            t[rng.randrange(len(t))] = "changed"
        elif kind == 2:
            t = prose(15) + passage[: rng.randint(10, 30)] + prose(15)
        elif kind == 3:
            t = rng.choice(out)
        elif kind == 4:
            t = prose(rng.randint(1, 6))
        else:
            t = prose(60)
        out.append(t)
    rows = [(i + 1, " ".join(t), "en", "s", 0) for i, t in enumerate(out)]
    return rows + [(901, None, None, None, None), (902, "", "en", "s", 0), (903, " \n\t ", "en", None, 0)]


# near copies


def sets(text):
    w = (text or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(rows):
    s = {i: sets(t) for i, t, *_ in rows}
    top = {i: i for i in s}
    find = lambda x: x if top[x] == x else find(top[x])
    for a, b in itertools.combinations(sorted(s), 2):
        if s[a] and s[b] and len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b]):
            x, y = sorted((find(a), find(b)))
            top[y] = x
    return {i: find(i) for i in s}


def near_group(n=60, seed=5):
    """One base text with a rising number of edits: similarities on both sides of the threshold."""
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(150)]
    out = []
    for i in range(n):
        t = list(base)
        for _ in range(rng.randint(0, 9)):
            t[rng.randrange(150)] = f"e{rng.randrange(10**6)}"
        out.append((i + 1, " ".join(t), "en", "s", 0))
    rng.shuffle(out)
    return out


@pytest.mark.parametrize("rows", [corpus(), near_group(), corpus(2)])
def test_jaccard_classes_match_brute_force(spark, rows):
    got = {r["doc_id"]: r["class_id"] for r in jaccard.classes(frame(spark, rows)).collect()}
    assert got == brute_classes(rows)


def test_jaccard_residual_pairs_are_a_superset_of_the_links(spark):
    rows = near_group(50, 9)
    df = frame(spark, rows)
    nodes = df.selectExpr("doc_id as rep", "doc_id as comp")
    got = {(r["a"], r["b"]) for r in jaccard._prefix_pairs(nodes, df, 0.8, 5).collect()}
    s = {i: sets(t) for i, t, *_ in rows}
    true = {(a, b) for a, b in itertools.combinations(sorted(s), 2) if len(s[a] & s[b]) >= 0.8 * len(s[a] | s[b])}
    assert true <= got and len(got) < 2 * len(true) + 50


def test_jaccard_bands_reach_the_recall():
    b, r = jaccard.bands_and_rows()
    assert 1 - (1 - 0.8**r) ** b >= jaccard.RECALL and b * r <= jaccard.MOST_HASHES


def test_jaccard_links_and_keep(spark):
    t = " ".join(f"x{i}" for i in range(20))
    df = frame(spark, [(3, t, "en", "s", 1), (5, t, "en", "s", 1), (7, t + " y", "en", "s", 1), (9, None, None, None, None)]).selectExpr("*", "1 as tk", "'a' as bucket")
    got = {r["doc_id"]: (r["class_id"], r["n_links"]) for r in jaccard.classes(df).collect()}
    assert got == {3: (3, 1), 5: (3, 1), 7: (3, 1), 9: (9, 0)}
    kept = jaccard.keep(df)
    assert kept.columns == df.columns and sorted(r["doc_id"] for r in kept.collect()) == [3, 9]


# substrings


def brute_removed(rows, window=13):
    words = {i: (t or "").split() for i, t, *_ in rows}
    first = {}
    for i in sorted(words):
        for j in range(len(words[i]) - window + 1):
            first.setdefault(tuple(words[i][j : j + window]), i)
    out = {}
    for i, w in words.items():
        gone = {j + d for j in range(len(w) - window + 1) if first[tuple(w[j : j + window])] < i for d in range(window)}
        out[i] = (len(w), len(gone), hashlib.sha256(" ".join(x for j, x in enumerate(w) if j not in gone).encode()).hexdigest())
    return out


@pytest.mark.parametrize("seed", [1, 3])
def test_substring_matches_brute_force(spark, seed):
    rows = corpus(seed) + [(990, "a b " * 40, "en", "s", 0), (991, "b a " * 40, "en", "s", 0)]
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in substring.dedup(frame(spark, rows)).collect()}
    assert got == brute_removed(rows)


def test_suffix_automaton_gives_the_least_id():
    rng = random.Random(4)
    seqs = [([rng.choice([b"a", b"b", b"c"]) for _ in range(30)], rng.randrange(50)) for _ in range(12)]
    machine = substring.SuffixAutomaton()
    for w, d in seqs:
        machine.add(w, d)
    machine.finish()
    for n in (2, 4):
        ask = [rng.choice([b"a", b"b", b"c"]) for _ in range(40)]
        want = [min([d for w, d in seqs if any(w[j : j + n] == ask[i : i + n] for j in range(len(w)))], default=substring.NO_ID) for i in range(len(ask) - n + 1)]
        assert machine.least_ids(ask, n) == want


def test_substring_keep_cuts_text_and_drops_spent_rows(spark):
    p = " ".join(f"p{i}" for i in range(20))
    df = frame(spark, [(1, p, "en", "s", 5), (2, f"start {p} end", "en", "s", 5), (3, p, "de", "t", 5), (4, None, None, None, None)])
    kept = {r["doc_id"]: r["text"] for r in substring.keep(df).collect()}
    assert kept[1] == p and kept[2].split() == ["start", "end"] and 3 not in kept and 4 in kept and kept[4] is None


# decontamination


def brute_hits(text, items):
    pat = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
    low = lambda t: pat.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    w, hit, ids = low(text), set(), set()
    for item, t in items:
        b = low(t)
        n = min(10, len(b))
        wins = {tuple(b[i : i + n]) for i in range(len(b) - n + 1)} if b else set()
        for j in range(len(w) - n + 1 if b else 0):
            if tuple(w[j : j + n]) in wins:
                hit |= set(range(j, j + n))
                ids.add(str(item))
    return len(w), len(hit), len(ids), hashlib.sha256(",".join(sorted(ids)).encode()).hexdigest()


def test_decontamination_matches_brute_force(spark):
    rows = corpus(6)
    items = [(10, rows[2][1].upper()), (9, rows[8][1]), (2, "Three. short, words"), (3, "one"), (4, None), (5, "..."), (6, rows[5][1][:80])]
    rows += [(950, "here are THREE short-words and one more", "en", "s", 0), (951, "x" + " one" * 30, "en", "s", 0)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {r["doc_id"]: (r["n_words"], r["n_hit"], r["n_items"], r["items_sha256"]) for r in decontam.report(frame(spark, rows), bench).collect()}
    assert got == {i: brute_hits(t, items) for i, t, *_ in rows}
    kept = {r["doc_id"] for r in decontam.keep(frame(spark, rows), bench).collect()}
    assert kept == {i for i, x in got.items() if not x[1]}


def test_decontamination_without_items(spark):
    got = decontam.report(frame(spark, corpus(1, 6)), spark.createDataFrame([], "item_id long, text string")).collect()
    assert len(got) == 9 and not any(r["contaminated"] for r in got)


# quality


def brute_base(t):
    t = t or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    grams = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
    n = Counter(grams)
    again = {i + d for i, g in enumerate(grams) if n[g] > 1 for d in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(again), len(w) < 10 or 100 * len(again) > 20 * len(w)


def test_quality_base_counts(spark):
    rows = corpus(8) + [(i, t, "en", "s", 0) for i, t in enumerate(["a b\na b\n\n a b\na b", "# * $ x|y <b>", "äöü 😀 x", "r s t u v " * 9, "a a a a a a a a a a a a"], 970)]
    got = {r["doc_id"]: tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) for r in quality.score(frame(spark, rows)).collect()}
    assert got == {i: brute_base(t) for i, t, *_ in rows}


def test_quality_rejects_outliers_and_keeps_clean_rows(spark):
    rng = random.Random(3)
    prose = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(60))
    rows = [(i, prose(), "en", "web", 0) for i in range(400)] + [(1000 + i, "#$% |<> &&& " * 20 + prose()[:60], "en", "web", 0) for i in range(5)]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(frame(spark, rows)).collect()}
    assert sum(kept[i] for i in range(400)) >= 398 and not any(kept[i] for i in range(1000, 1005))
    assert quality.keep(frame(spark, rows).selectExpr("*", "1 as n_words", "2 as m0")).columns[-2:] == ["n_words", "m0"]


# language, toxicity


def labelled(n=160):
    rng = random.Random(2)
    stems = {"en": ["the", "which", "thing", "working", "house", "through"], "de": ["der", "nicht", "schließen", "straße", "wurden", "über"]}
    return [(i, " ".join(rng.choice(stems["en" if i % 2 else "de"]) for _ in range(30)), "en" if i % 2 else "de", "s", 0) for i in range(n)]


def test_language_of_held_out_texts(spark):
    rows = labelled() + [(900, None, "en", "s", 0), (901, "12 34 !", "en", "s", 0), (902, "der nicht über", None, None, None)]
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, rows)).collect()}
    assert all(got[i]["held_out"] == (zlib.crc32(str(i).encode()) % 5 == 0) for i, *_ in rows)
    assert all(got[i]["lang_pred"] == lang for i, _, lang, *_ in rows[:160])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == "und" and got[900]["score"] == 0.0 and got[902]["lang_pred"] == "de"


def test_language_forward_backward_matches_enumeration():
    rng = np.random.default_rng(1)
    emit, trans, start = rng.normal(size=(9, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    lengths = np.array([4, 1, 4])
    got, at = langid.posteriors(emit, trans, start, lengths), 0
    for n in lengths:
        want = np.zeros((n, 3))
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(emit[at + i, y] for i, y in enumerate(path)) + sum(trans[a, b] for a, b in itertools.pairwise(path))
            for i, y in enumerate(path):
                want[i, y] += np.exp(s)
        assert np.allclose(got[at : at + n], want / want.sum(1, keepdims=True))
        at += n


def test_language_without_labels(spark):
    got = langid.predict(frame(spark, [(1, "abc def", None, None, 0)])).collect()
    assert got[0]["lang_pred"] == "und"
    assert langid.predict(frame(spark, [])).count() == 0


def test_toxicity_orders_severity(spark):
    rng = random.Random(7)
    rows, labels = [], []
    for i in range(600):
        kind = i % 3
        words = [f"n{rng.randrange(300)}" for _ in range(30)] + [["plain"], ["nasty"], ["vile"]][kind] * 3
        rows.append((i, " ".join(re.sub(r"\d", lambda m: "abcdefghij"[int(m[0])], w) for w in words), "en", "s", 0))
        labels.append((i, 0 if kind == 2 else 1, int(kind > 0)))
    df, lab = frame(spark, [*rows, (9000, None, None, None, None)]), spark.createDataFrame([*labels, (1, None, None)], "doc_id long, quality int, toxic int")
    got = {r["doc_id"]: r for r in toxicity.score(df, toxicity.train(df, toxicity.grades(lab))).collect()}
    mean = [np.mean([got[i]["severity"] for i in range(k, 600, 3)]) for k in range(3)]
    assert mean[0] + 0.5 < mean[1] < mean[2] and all(got[i]["toxic"] == (i % 3 > 0) for i in range(600)) and 9000 in got
    none = toxicity.score(df, toxicity.train(df, toxicity.grades(lab.where("false")))).collect()
    assert len(none) == 601 and all(r["severity"] == 0 for r in none)


# SentencePiece


def brute_best(vocab, text):
    """Highest total score of marked text, by plain dynamic programming."""
    best = [0.0] + [-np.inf] * len(text)
    for e in range(1, len(text) + 1):
        for s in range(max(0, e - vocab.longest), e):
            i = vocab.ids.get(text[s:e])
            if i is not None:
                best[e] = max(best[e], best[s] + vocab.scores[i])
        if text[e - 1] not in vocab.ids:
            best[e] = max(best[e], best[e - 1] + vocab.unknown_score)
    return best[-1]


TEXTS = ["", "Hello world", "  two  spaces ", "naïve 😀 \x00\x01 zero", "line\nbreak\n\n", "a" * 300, "日本語のテキスト", "ſtrange▁mark", "x" * 50 + " " + "the quick brown fox " * 40]


def test_sentencepiece_is_optimal_and_round_trips(spark):
    vocab = tokens.Vocabulary(tokenizer_file())
    df = spark.createDataFrame([*enumerate(TEXTS), (99, None)], "doc_id long, text string")
    rows = {r["doc_id"]: r for r in tokens.encode(df, tokenizer_file()).collect()}
    for i, t in enumerate(TEXTS):
        ids = rows[i]["ids"]
        assert vocab.decode(ids) == t.replace("▁", " ") and rows[i]["round_trip"]
        assert vocab.cost[ids].sum() == brute_best(vocab, tokens._marked(t)) if t else ids == []
    assert rows[99]["ids"] is None
    back = {r["doc_id"]: r["text"] for r in tokens.decode(tokens.encode(df, tokenizer_file()), tokenizer_file()).collect()}
    assert back[1] == TEXTS[1] and back[99] is None


def test_sentencepiece_giant_texts_in_chunks(spark):
    vocab = tokens.Vocabulary(tokenizer_file())
    rng = random.Random(1)
    giant = [" ".join("".join(rng.choice("etaoin") for _ in range(rng.randint(1, 9))) for _ in range(300)), "".join(rng.choice("ab ") for _ in range(700)), "z" * 900]
    df = spark.createDataFrame(list(enumerate(giant)), "doc_id long, text string")
    for r in tokens.encode(df, tokenizer_file(), giant=200, chunk=64).collect():
        t = giant[r["doc_id"]]
        assert r["round_trip"] and vocab.decode(r["ids"]) == t
        assert vocab.cost[r["ids"]].sum() == brute_best(vocab, tokens._marked(t))


# WARC


def test_warc_records_are_linked_and_round_trip(spark, tmp_path):
    html = "<html lang='de'><head><title>T &amp; &#228;</title><style>x{}</style></head><body><p>One</p>two<!-- no --><a href=\"/a?x=1&amp;y\">link</a><script>var a='<p>';</script></body></html>"
    pages = spark.createDataFrame([(1, "http://x.org/a", html), (2, None, None), (2, None, None)], "page_id long, url string, html string")
    source = warc.responses(pages)
    got = warc.derive(source, "page_id").collect()
    assert len(got) == 6
    ids = {r["page_id"]: r["record_id"] for r in source.collect()}
    for r in got:
        assert r["refers_to"] == ids[r["page_id"]] and r["content_length"] == len(r["block"].encode())
        assert r["block_digest"] == "sha1:" + __import__("base64").b32encode(hashlib.sha1(r["block"].encode()).digest()).decode()
    one = {r["type"]: r for r in got if r["page_id"] == 1}
    assert one["conversion"]["block"] == "T & ä\nOne\ntwolink" and one["metadata"]["concurrent_to"] == one["conversion"]["record_id"]
    assert '"title":"T & ä"' in one["metadata"]["block"] and '"/a?x=1&y"' in one["metadata"]["block"] and '"lang":"de"' in one["metadata"]["block"]
    warc.write_warc(warc.derive(source.where("page_id = 1")), str(tmp_path / "w"))
    back = warc.read_warc(spark, str(tmp_path / "w")).collect()
    assert len(back) == 2 and all(r["whole"] for r in back) and {r["block"] for r in back} == {x["block"] for x in one.values()}


# URL rules


def test_url_rules(spark):
    urls = ["http://example.org/es/x", "https://A.Example.ORG/en/12?q", "http://notexample.org/es/", "ftp://x.com/fr/de/", "x://y.com/de/q#f", "no scheme", None, "http://spam-shop.net/a", "http://ok.net/ad", "http://ok.net", "http://example.org/de/",
            "http://deep.sub.example.org/en/1/2", "a://b.net/phishing/x", "http://org/", "http://x.org", "http://x.com/frx/"]
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urlfilter.judge(spark.createDataFrame(list(enumerate(urls)), "page_id long, url string"), urlfilter.rules(spark)).collect()}
    assert got[0] == ("example.org", "/es/x", "example.org/es/", "block") and got[1] == ("a.example.org", "/en/12", "example.org/en/1", "block")
    assert got[2][2:] == ("org/", "allow") and got[3][2:] == ("com/fr/", "allow") and got[4] == ("y.com", "/de/q", "com/de/", "block")
    assert got[5] == got[6] == ("", "", None, "allow") and got[7][2:] == (None, "block") and got[8][2:] == (None, "allow") and got[9] == ("ok.net", "", None, "allow")
    assert got[10][2:] == ("org/", "allow") and got[11][2:] == ("example.org/en/1", "block") and got[12][3] == "block" and got[13][2] == "org/" and got[14][2] is None and got[15][2] is None
    assert urlfilter.judge(spark.createDataFrame([], "page_id long, url string"), urlfilter.rules(spark)).count() == 0


# shards


def test_shards_balance_and_number_without_gaps(spark):
    rng = random.Random(1)
    rows = [(i, "x" * int(rng.paretovariate(1.2) * 20) if i % 3 else "hot text", "en", "s", 0) for i in range(4000)] + [(None, None, None, None, None), (7, "twice", "en", "s", 0), (7, "twice", "en", "s", 0)]
    rows = [r for r in rows if len(r[1] or "") < 3000]  # longer ones are whole shards here: see test_edges
    got = sharding.shard(frame(spark, rows)).collect()
    by = [[r for r in got if r["shard"] == k] for k in range(40)]
    assert all(sorted(r["slot"] for r in b) == list(range(len(b))) for b in by)
    size = [sum(r["size"] for r in b) for b in by]
    assert max(size) - min(size) < 0.1 * np.mean(size)
    texts = Counter((i, 16 + len((t or "").encode()), zlib.crc32((t or "").encode())) for i, t, *_ in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == texts
    assert sharding.shard(frame(spark, [])).count() == 0


def test_quality_small_groups_are_judged_by_their_own_estimate(spark):
    rng = random.Random(11)
    prose = lambda low, high: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(low, high))) for _ in range(60))
    rows = [(i, prose(2, 5), "en", "web", 0) for i in range(600)]
    rows += [(1000 + i, prose(16, 22).upper(), "de", "law", 0) for i in range(80)] + [(2000 + i, prose(2, 5), "de", "law", 0) for i in range(3)]
    kept = {r["doc_id"]: r["kept"] for r in quality.score(frame(spark, rows)).collect()}
    assert sum(kept[1000 + i] for i in range(80)) >= 78 and not any(kept[2000 + i] for i in range(3))
    failed = quality.score(frame(spark, [*rows, (3000, "too short", "fr", None, 0)]).where("lang <> 'de'")).where("doc_id = 3000").first()
    assert not failed["kept"] and failed["distance"] is not None


def test_quality_rejects_duplicate_lines_in_a_tight_group(spark):
    rng = random.Random(12)
    line = lambda: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9))) for _ in range(4))
    rows = [(i, "\n".join(line() for _ in range(30)), "en", "web", 0) for i in range(100)]
    one = [line() for _ in range(30)]
    rows += [(1000, "\n".join(x for _ in range(25) for x in ("log in now", line())), "en", "web", 0), (1001, "\n".join([*one, one[3]]), "en", "web", 0)]
    got = {r["doc_id"]: r for r in quality.score(frame(spark, rows)).collect()}
    assert not got[1000]["base_failed"] and not got[1000]["kept"] and got[1001]["kept"]
    assert sum(got[i]["kept"] for i in range(100)) >= 99


@pytest.mark.parametrize("block", [500, 20])
def test_jaccard_counts_every_link(spark, monkeypatch, block):
    monkeypatch.setattr(jaccard, "BLOCK", block)
    rows = near_group()
    s = {t: sets(t) for _, t, *_ in rows}
    want = {i: sum(t != u and len(s[t] & s[u]) >= 0.8 * len(s[t] | s[u]) for u in s) for i, t, *_ in rows}
    df = frame(spark, rows)
    nodes = df.groupBy("text").agg({"doc_id": "min"}).selectExpr("`min(doc_id)` as rep", "1L as comp", "146 as n")
    got = {r["rep"]: r["n_links"] for r in jaccard.degrees(nodes, df).collect()}
    assert got and got == {i: want[i] for i in got} and max(got.values()) > 5
    if block == 20:
        assert {r["doc_id"]: r["n_links"] for r in jaccard.classes(df).collect()} == want
