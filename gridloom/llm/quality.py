"""Quality rules: base counts, then robust multivariate outliers per language and source.

Each document becomes a vector of five transformed statistics. Per (lang, source) group the
minimum-covariance-determinant estimate is sought by concentration steps from two starts:
medians with quartile spreads, and the moments of all rows. A step keeps the `SUPPORT` share of rows nearest to the present centre and takes their mean and covariance.
After `FIRST_STEPS` steps each group goes on with the start of least determinant, until no
group's determinant falls any more. Rows whose squared Mahalanobis distance passes `CUTOFF` are
rejected. All of it is DataFrame code: moments are partial aggregates, quantiles come from
counts of fine bins (the support ends with the bin that its last row lies in), and the Cholesky
factor of each group's covariance is a handful of columns on one row a group.

Every group has its own estimate, at every size: its mean and covariance are those of a
normal-inverse-Wishart posterior whose prior is its language's estimate (and of that, the one
over all rows). A group of n rows counts n / (n + PRIOR) in the covariance and, as few rows
tell a centre, n / (n + CENTRE) in the mean; the distance of the two means widens the
covariance, so that neither a small group's habits nor its outliers are judged by a foreign
centre alone. Each row's own sampling noise (`UNITS`) is added to the covariance: a tight group
makes small differences count, but not one odd line or symbol.

Defined cases: null or blank text has no words and fails the base rule; null lang or source
is a group of its own; a group without a row that passes the base rules has no covariance
and takes its prior, and a table without one has no estimate; an empty table gives an empty
result; repeated rows count and are judged each; rows at equal distance are all in the support
or all out of it; texts of any length are read whole; columns other than those named are
carried only by `keep`, under their own names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from gridloom.llm.common import SPACES, WORD_GAP, sized_broadcast, stored, text_of

SYMBOLS = "#*$%&|<>"
WINDOW = 5
SUPPORT = 0.75
#: Concentration steps from every start; most steps after them, and the fall of the log determinant that counts as one.
FIRST_STEPS, MOST_STEPS, FALL = 1, 10, 1e-3
#: Bins of a unit of a statistic, and of a unit of the log of a squared distance, by which quantiles are counted.
FINE, FINE_LOG = 4096, 512
#: Added to each variance when determinants are compared: columns may be constant.
RIDGE = 1e-6
#: Rows that the language's estimate counts for in a group, and the one over all rows in a language.
PRIOR = 40
#: The same for the mean.
CENTRE = 2
#: Independent units behind each statistic of a row. A share's root, or the log of a mean word length (words
#: spread by about half their mean), has the sampling variance 1 / (4 units). Symbols and capitals come by
#: words, and a repeat covers two windows of words at least.
UNITS = ("n_words", "n_words", "n_words", "n_lines", f"n_words / {2 * WINDOW}")
#: 1 / P(chi2 with p + 2 degrees <= the SUPPORT quantile of chi2 with p) x SUPPORT, for p = 5.
CONSISTENCY = 1.41
#: The 0.9999 quantile of chi-square with five degrees of freedom.
CUTOFF = 25.7
P = len(UNITS)
XS = [f"x{i}" for i in range(P)]
PAIRS = [(i, j) for i in range(P) for j in range(i + 1)]


def statistics(docs: DataFrame, text: str = "text") -> DataFrame:
    """docs with n_words, n_lines, the four base counts, base_failed and the vector x0..x4."""
    w = F.col("_w")
    at = lambda i: F.get(w, i)
    body = F.btrim(text_of(text), F.lit(SPACES))
    grams = F.when(
        F.size(w) >= WINDOW,
        F.transform(F.sequence(F.lit(0), F.size(w) - WINDOW), lambda i: F.xxhash64(*[at(i + j) for j in range(WINDOW)])),
    ).otherwise(F.array().cast("array<bigint>"))
    lines = F.filter(F.split(text_of(text), "\n", -1), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    df = docs.withColumn("_w", F.when(body == "", F.array().cast("array<string>")).otherwise(F.split(body, WORD_GAP, -1)))
    df = df.withColumns({
        "n_words": F.size("_w").cast("long"),
        "word_chars": F.length(F.array_join("_w", "")).cast("long"),
        "n_symbols": (F.length(text_of(text)) - F.length(F.regexp_replace(text_of(text), "[#*$%&|<>]", ""))).cast("long"),
        "_upper": (F.length(text_of(text)) - F.length(F.regexp_replace(text_of(text), "[A-Z]+", ""))).cast("long"),
        "_lines": lines,
        "_grams": grams,
    })
    again = F.size(F.array_distinct("_grams")) < F.size("_grams")
    df = df.withColumns({
        "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
        "n_lines": F.size("_lines").cast("long"),
        "_pairs": F.when(again, F.array_sort(F.transform("_grams", lambda h, i: F.struct(h.alias("h"), i.alias("i"))))),
    })
    s = F.col("_pairs")
    same = lambda x, y: F.coalesce(x["h"] == y["h"], F.lit(False))
    twice = F.filter(s, lambda x, j: same(x, F.get(s, j - 1)) | same(x, F.get(s, j + 1)))
    df = df.withColumn("_at", F.array_sort(F.transform(twice, lambda x: x["i"])))
    covered = F.aggregate(
        "_at",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("long").alias("n")),
        lambda a, i: F.struct((i + WINDOW).alias("end"), (a["n"] + WINDOW - F.greatest(F.lit(0), a["end"] - i)).alias("n")),
        lambda a: a["n"],
    )
    df = df.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0).cast("long")))
    share = lambda a, b: F.sqrt(F.coalesce(F.try_divide(a, b), F.lit(0.0)))
    return df.withColumns({
        "base_failed": (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words")),
        "x0": F.when(F.col("n_words") > 0, F.ln(F.col("word_chars") / F.col("n_words"))).otherwise(0.0),
        "x1": share(F.col("n_symbols"), F.col("word_chars")),
        "x2": share(F.col("_upper"), F.col("word_chars")),
        "x3": share(F.col("n_dup_lines"), F.col("n_lines")),
        "x4": share(F.col("n_repeat_words"), F.col("n_words")),
    }).drop("_w", "_upper", "_lines", "_grams", "_pairs", "_at")


# From here on the many expressions are SQL text, which Spark parses at once. An estimate is two arrays, so that its
# shrinking, done for some hundred rows, is a few expressions that the driver plans; only the rows' distances are columns.


def _moments(rows: DataFrame, near: str, scale: float) -> DataFrame:
    """Mean `_m` and covariance `_c` (arrays, nulls where there is none) of the rows of each key `_g` and start `_s` that are near, with their number."""
    at = lambda c: f"avg(if({near}, {c}, null))"
    out = rows.groupBy("_g", "_p", "_s").agg(
        F.expr(f"count(if({near}, {XS[0]}, null)) as _n"),
        F.expr(f"array({', '.join(at(x) for x in XS)}) as _m"),
        F.expr(f"array({', '.join(at(f'{XS[i]} * {XS[j]}') for i, j in PAIRS)}) as _q"),
    )
    return out.selectExpr("_g", "_p", "_s", "_n", "_m", f"transform(_q, (q, k) -> {scale}D * (q - {_side('_m', 0)} * {_side('_m', 1)})) as _c")


def _side(of: str, which: int) -> str:
    """The element of an array of P that belongs to row (0) or column (1) of the covariance's k-th entry."""
    return f"get({of}, get(array({', '.join(str(p[which]) for p in PAIRS)}), k))"


def _toward(n: str, m: str, c: str, m0: str, c0: str) -> tuple[str, str]:
    """Mean and covariance of n rows shrunk towards a prior by n / (n + CENTRE) and n / (n + PRIOR)."""
    mix = lambda a, b, k: f"zip_with({a}, {b}, (x, y) -> coalesce({n} / ({n} + {k}D) * x, 0D) + (1 - {n} / ({n} + {k}D)) * y)"
    off = f"zip_with({m}, {m0}, (x, y) -> coalesce(x - y, 0D))"
    wider = f"{n} / ({n} + {CENTRE}D) * {CENTRE} / ({n} + {PRIOR})"
    return mix(m, m0, CENTRE), f"transform({mix(c, c0, PRIOR)}, (z, k) -> z + {wider} * {_side(off, 0)} * {_side(off, 1)})"


def _shrunk(raw: DataFrame, n: int) -> DataFrame:
    """Estimates of groups, of languages and of all rows, each shrunk towards the next, with the log of their determinants `_det`.

    A row meets the raw estimates of its parent (a_) and of that one's (b_).
    """
    parent = lambda x: sized_broadcast(raw.selectExpr(*[f"{k} as {x}{k}" for k in raw.columns]), n)
    df = raw.join(parent("a_"), F.expr("_p = a__g and _s = a__s"), "left").join(parent("b_"), F.expr("a__p = b__g and _s = b__s"), "left")
    # the parent's estimate: itself for all rows, shrunk for a language
    m, c = _toward("a__n", "a__m", "a__c", "b__m", "b__c")
    df = df.selectExpr(*raw.columns, "a__g", f"if(b__g is null, a__m, {m}) as p_m", f"if(b__g is null, a__c, {c}) as p_c")
    m, c = _toward("_n", "_m", "_c", "p_m", "p_c")
    df = df.selectExpr("_g", "_p", "_s", "_n", f"if(a__g is null, _m, {m}) as _m", f"if(a__g is null, _c, {c}) as _c")
    left = df.selectExpr("*", *[f"get(_c, {k}) + {RIDGE if i == j else 0.0} as l{i}{j}" for k, (i, j) in enumerate(PAIRS)])
    for j in range(P - 1):
        left = left.withColumns({f"l{i}{k}": F.expr(f"l{i}{k} - l{i}{j} * l{k}{j} / l{j}{j}") for i in range(j + 1, P) for k in range(j + 1, i + 1)})
    return left.selectExpr(*df.columns, " + ".join(f"ln(l{i}{i})" for i in range(P)) + " as _det")


def _noise() -> list[str]:
    return [f"1 / (4 * greatest(cast({u} as double), 0.1D))" for u in UNITS]


def _with_distance(df: DataFrame) -> DataFrame:
    """df with `_d`, the squared Mahalanobis distance of x0..x4, by elimination in the covariance plus the row's sampling noise."""
    noise = _noise()
    start = {f"v{i}": f"{x} - get(_m, {i})" for i, x in enumerate(XS)}
    start |= {f"c{i}{j}": f"get(_c, {k}) + {noise[i]}" if i == j else f"get(_c, {k})" for k, (i, j) in enumerate(PAIRS)}
    df = df.withColumns({"_d": F.lit(0.0), **{k: F.expr(e) for k, e in start.items()}})
    for j in range(P):
        new = {"_d": f"_d + v{j} * v{j} / c{j}{j}"}
        new |= {f"v{i}": f"v{i} - c{i}{j} / c{j}{j} * v{j}" for i in range(j + 1, P)}
        new |= {f"c{i}{k}": f"c{i}{k} - c{i}{j} / c{j}{j} * c{k}{j}" for i in range(j + 1, P) for k in range(j + 1, i + 1)}
        df = df.withColumns({k: F.expr(e) for k, e in new.items()})
    return df.drop("_m", "_c", *start)


def _group() -> Column:
    return F.concat(F.lit("g"), F.to_json(F.struct(F.col("lang"), F.col("source"))))


def _levels() -> Column:
    """(key `_g`, its parent `_p`) of a row's group, its language and all rows."""
    lang = F.concat(F.lit("l"), F.to_json(F.struct(F.col("lang"))))
    return F.explode(F.array(*[F.struct(g.alias("_g"), p.alias("_p")) for g, p in ((_group(), lang), (lang, F.lit("")), (F.lit(""), F.lit(None).cast("string")))])).alias("_k")


def _reached(bins: DataFrame, by: list[str], shares: dict[str, float]) -> DataFrame:
    """For each key of bins (by, bin, n), the first bin by which so large a share of its rows is reached."""
    w = Window.partitionBy(*by).orderBy("bin")
    run = bins.withColumns({"_run": F.sum("n").over(w), "_all": F.sum("n").over(Window.partitionBy(*by))})
    return run.groupBy(*by).agg(*[F.min(F.when(F.col("_run") >= F.ceil(F.col("_all") * share - 1e-9), F.col("bin"))).alias(name) for name, share in shares.items()])


def _starts(stats: DataFrame, rows: DataFrame) -> DataFrame:
    """Raw estimates of the two starts: medians with quartile spreads, and all rows."""
    x = F.explode(F.array(*[F.struct(F.lit(i).alias("i"), F.floor(F.col(x) * FINE).alias("bin")) for i, x in enumerate(XS)]))
    bins = stats.where("not base_failed").select("lang", "source", x.alias("x")).groupBy("lang", "source", "x.i", "x.bin").agg(F.count(F.lit(1)).alias("n"))
    bins = bins.select(_levels(), "i", "bin", "n").groupBy("_k._g", "i", "bin").agg(F.sum("n").alias("n"))
    q = _reached(bins, ["_g", "i"], {"a": 0.25, "m": 0.5, "b": 0.75})
    q = q.groupBy("_g").agg(*[F.expr(f"max(if(i = {i}, (m + 0.5D) / {FINE}, null)) as m{i}") for i in range(P)], *[F.expr(f"max(if(i = {i}, (b - a) / {FINE} / 1.349D, null)) as s{i}") for i in range(P)])
    raw = _moments(rows.withColumn("_s", F.lit(1)), "true", 1.0)
    first = raw.select("_g", "_p", F.lit(0).alias("_s"), "_n").join(q, "_g", "left")
    first = first.selectExpr("_g", "_p", "_s", "_n", f"array({', '.join(f'm{i}' for i in range(P))}) as _m", f"array({', '.join(f's{i} * s{i}' if i == j else '0D' for i, j in PAIRS)}) as _c")
    return stored(raw.unionByName(first), "mcd")


def _concentrated(rows: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """One concentration step from params: raw moments."""
    far = _with_distance(rows.join(sized_broadcast(params.drop("_p", "_n", "_det", "_step"), n), "_g")).withColumn("bin", F.expr(f"floor(ln(greatest(_d, 1e-9D)) * {FINE_LOG})"))
    bins = far.where(F.col(XS[0]).isNotNull()).groupBy("_g", "_s", "bin").agg(F.count(F.lit(1)).alias("n"))  # a filter on _d would be written out whole
    cut = _reached(bins, ["_g", "_s"], {"_cut": SUPPORT})
    return stored(_moments(far.join(sized_broadcast(cut, n), ["_g", "_s"], "left"), "bin <= _cut", CONSISTENCY), "mcd")


def _least(params: DataFrame) -> DataFrame:
    """Of each key the estimate of least determinant, of a later step only if it falls by more than FALL."""
    rank = F.expr(f"struct(coalesce(_det, double('inf')) + if(_step > 0, {FALL}D, 0D), _step, _s)")
    return params.groupBy("_g").agg(F.min_by(F.struct(*params.columns), rank).alias("_x")).select("_x.*")


def fit(stats: DataFrame) -> tuple[DataFrame, int]:
    """Estimates by key `_g` (a group, a language, or '' for all rows) and their number."""
    rows = stats.select(_levels(), "n_words", "n_lines", *[F.expr(f"if(base_failed, null, {x}) as {x}") for x in XS]).select("_k.*", "n_words", "n_lines", *XS)
    raw = _starts(stats, rows)
    n = raw.count()
    params = stored(_shrunk(raw, n), "mcd")
    for _ in range(FIRST_STEPS - 1):
        params = stored(_shrunk(_concentrated(rows, params, n), n), "mcd")
    # one start a group from here on: its parent's chosen estimate is its prior
    chosen = _least(_shrunk(_concentrated(rows, params, n), n).withColumn("_step", F.lit(0)))
    params = stored(chosen.withColumn("_s", F.lit(0)), "mcd")
    for _ in range(MOST_STEPS):
        new = _shrunk(_concentrated(rows, params, n), n).withColumn("_step", F.lit(1))
        params = stored(_least(params.withColumn("_step", F.lit(0)).unionByName(new)), "mcd")
        if not params.where("_step = 1").count():
            break
    return params, n


def judge(stats: DataFrame, params: DataFrame, n: int) -> DataFrame:
    """stats with `distance` and `kept`, by the estimate of each row's group."""
    own = sized_broadcast(params.drop("_p", "_n", "_s", "_det", "_step"), n)
    df = _with_distance(stats.withColumn("_g", _group()).join(own, "_g", "left")).withColumn("distance", F.sqrt("_d"))
    kept = ~F.col("base_failed") & F.coalesce(F.col("_d") <= CUTOFF, F.lit(True))
    return df.withColumn("kept", kept).drop("_g", "_d")


def score(docs: DataFrame) -> DataFrame:
    """Base counts, distance and verdict of every row of docs (doc_id, text, lang, source)."""
    cols = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed"]
    stats = stored(statistics(docs.select("doc_id", "text", "lang", "source")).drop("text"), "quality")
    return judge(stats, *fit(stats)).select(*cols, "kept", "distance")


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that are kept, with all their columns."""
    rows = docs.select(F.struct("*").alias("_row"), "doc_id", "text", "lang", "source")
    stats = stored(statistics(rows).select("_row", "lang", "source", "base_failed", "n_words", "n_lines", *XS), "quality")
    params, n = fit(stats)
    # with a number by which no filter passes: it would take each elimination step's formulas into the next one's, thousands of lines of one condition
    return judge(stats, params, n).select("_row", "kept", F.monotonically_increasing_id().alias("_i")).where("kept and _i >= 0").select("_row.*")
