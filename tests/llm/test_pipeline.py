"""The corpus pipeline against a brute-force version of all of its stages."""

import random
import re

import pytest

corpus_pipeline = pytest.importorskip("corpus_pipeline")

from gridloom.llm import quality, tokens  # noqa: E402
from gridloom.llm.queries import tokenizer_file  # noqa: E402
from tests.llm.test_edges import brute_quality  # noqa: E402
from tests.llm.test_operators import DOCS, brute_classes, brute_hits  # noqa: E402


def cut(rows, window=13):
    """rows without the words of windows that smaller ids hold, the gaps before kept words as they are."""
    first = {}
    found = {i: [m.span() for m in re.finditer(r"[^\x20\x09-\x0D]+", t or "")] for i, t, *_ in rows}
    texts = {i: t for i, t, *_ in rows}
    seq = {i: [texts[i][a:b] for a, b in s] for i, s in found.items()}
    for i in sorted(seq):
        for j in range(len(seq[i]) - window + 1):
            first.setdefault(tuple(seq[i][j : j + window]), i)
    out = []
    for i, t, *rest in rows:
        gone = {j + d for j in range(len(seq[i]) - window + 1) if first[tuple(seq[i][j : j + window])] < i for d in range(window)}
        if gone and len(gone) == len(seq[i]):
            continue
        if gone:
            s = found[i]
            stop = [a for a, _ in s[1:]] + [len(t)]
            t = t[: s[0][0]] + "".join(t[a:b] for k, ((a, _), b) in enumerate(zip(s, stop, strict=True)) if k not in gone)
        out.append((i, t, *rest))
    return out


def fixture():
    rng = random.Random(9)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 9)))
    prose = lambda n: [word() for _ in range(n)]
    passage, item, out = prose(30), prose(14), []
    for i in range(150):
        kind = rng.randrange(8)
        t = prose(rng.randint(40, 90))
        if kind == 1 and out:
            t = out[rng.randrange(len(out))].split(" ")
            t[rng.randrange(len(t))] = "changed"
        elif kind == 2:
            t[20:20] = passage
        elif kind == 3:
            t[10:10] = item
        elif kind == 4:
            t += ["###", "$$$", "<<<>>>"] * 10
        out.append(" ".join(t))
    rows = [(i + 1, t, rng.choice(["en", "de"]), "web", len(t)) for i, t in enumerate(out)]
    return [*rows, (900, None, None, None, None), (901, "", "en", "web", 0), (902, rows[0][1], "en", "web", 1)], [(1, " ".join(item)), (2, None), (3, " ".join(prose(20)))]


def test_pipeline_matches_brute_force(spark, tmp_path):
    rows, bench = fixture()
    spark.createDataFrame(rows, DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(bench, "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    verdict = brute_quality(rows)
    left = [r for r in rows if verdict[r[0]][0]]
    classes = brute_classes(left)
    left = cut([r for r in left if classes[r[0]] == r[0]])
    left = [r for r in left if not brute_hits(r[1], bench)[1]]
    vocab = tokens.Vocabulary(tokenizer_file())
    got = {r["doc_id"]: r for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    assert set(got) == {r[0] for r in left} and 40 < len(got) < 140
    for i, t, *_ in left:
        want = tokens.Stretches(vocab).encode(vocab.stretch.findall(tokens._marked(t)))[0].tolist()
        assert got[i]["ids"] == want and got[i]["n_tokens"] == len(want) and got[i]["round_trip"] and vocab.decode(want) == t


def test_pipeline_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert [name for name, _ in corpus_pipeline.STAGES][0] == "quality rules" and len(corpus_pipeline.STAGES) == 5


def test_verdicts_compile(spark, monkeypatch):
    """No filter takes the elimination's formulas into one condition, whose code is too long for the compiler and fills the driver."""
    cov = [1.0 if i == j else 0.0 for i, j in quality.PAIRS]
    params = spark.createDataFrame([('g{"lang":"en","source":"s"}', "", 0, 1, [0.0] * 5, cov, 0.0, 0)], "_g string, _p string, _s int, _n long, _m array<double>, _c array<double>, _det double, _step int")
    monkeypatch.setattr(quality, "fit", lambda stats: (params, 1))
    docs = spark.createDataFrame([(1, "one two three four five six seven eight nine ten", "en", "s", 48), (2, "short", "en", "s", 5)], DOCS)
    spark.conf.set("spark.sql.codegen.fallback", "false")
    try:
        assert [r.doc_id for r in quality.keep(docs).collect()] == [1]
    finally:
        spark.conf.unset("spark.sql.codegen.fallback")
