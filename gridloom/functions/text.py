"""Text functions on columns: names, scores, terms, snippets, estimates, paths."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words that a query does without.
STOP_WORDS = ["a", "an", "and", "are", "as", "at", "be", "by", "for", "from", "how", "i", "in", "is", "it", "of", "on", "or", "that", "the", "to", "what", "when", "where", "which", "with"]

#: Words that hint at a question about how to do something, and at one about the subject.
PROCEDURAL_HINTS = ["how", "steps", "procedure", "workflow", "run", "generate", "create", "produce", "configure", "set", "api", "job", "tool", "script", "parameter", "arguments", "command"]
DOMAIN_HINTS = ["lunar", "moon", "surface", "temperature", "dataset", "science", "mission", "apollo", "regolith", "insolation", "illumination", "thermal", "orbit", "crater"]
CHANNELS = ["procedural", "domain", "mixed"]


def clean_name(name: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", " "))


def name_score(clean: Column, raw: Column, wanted: str) -> Column:
    """100 for an equal clean name, 98 for an equal raw one, 85 for a beginning, 65 inside, else 0."""
    w = clean_name(F.lit(wanted))
    return F.when(clean == w, 100).when(raw == wanted, 98).when(F.startswith(clean, w), 85).when(F.contains(clean, w), 65).otherwise(0)


def has_type(types: Column, wanted: str) -> Column:
    """Is wanted a whole token of a list parted by commas, slashes or spaces?"""
    spaced = F.concat(F.lit(" "), F.lower(F.translate(types, ",/", "  ")), F.lit(" "))
    return F.contains(spaced, F.lit(f" {wanted.lower()} "))


def terms(query: Column, most: int = 24) -> Column:
    """The first terms of a query, four at least: lower-case runs of letters, digits and `_:./-` of over one character, but stop words."""
    w = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_:./-]+)"), F.lit(1))
    return F.slice(F.filter(w, lambda x: (F.length(x) > 1) & ~x.isin(STOP_WORDS)), 1, max(4, most))


def collapsed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"[ \t\n\r\f\x0B]+", " "))


def snippet(text: Column, most: int = 240) -> Column:
    t = collapsed(text)
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.rtrim(F.substring(t, 1, most - 1)), F.lit("…")))


def token_estimate(text: Column) -> Column:
    """Words times 1.3, rounded half to even, one at least."""
    n = F.size(F.filter(F.split(collapsed(text), " "), lambda x: x != ""))
    return F.greatest(F.lit(1), F.rint(n * 1.3)).cast("int")


def section(text: Column) -> Column:
    """The first heading among the first six lines."""
    heads = F.filter(F.slice(F.split(text, "\n"), 1, 6), lambda x: F.startswith(F.ltrim(x), F.lit("#")))
    return F.trim(F.regexp_replace(F.get(heads, F.lit(0)), r"^\s*#+", ""))


def boolish(text: Column, default: bool = False) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin("1", "true", "yes", "y", "on"), True).when(t.isin("0", "false", "no", "n", "off"), False).otherwise(default)


def listed(text: Column) -> Column:
    """Trimmed, non-empty parts of a `;` list."""
    return F.filter(F.transform(F.split(text, ";"), lambda x: F.trim(x)), lambda x: x != "")


def kebab(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-"), F.lit("-"))


def overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def unit_name_score(clean: Column, wanted: Column) -> Column:
    """1.0 for equal clean names, 0.92 for a beginning, 0.86 inside, else and for empty names 0."""
    return F.when((clean == "") | (wanted == ""), 0.0).when(clean == wanted, 1.0).when(F.startswith(clean, wanted), 0.92).when(F.contains(clean, wanted), 0.86).otherwise(0.0)


def scenario_score(fields: list[Column], wanted: Column) -> Column:
    """Score of (id, name, root, directory) for a reference: whole, beginning, inside, or all of its words anywhere."""
    whole = F.coalesce(*[F.when(f == wanted, n) for f, n in zip(fields, (1000, 950, 900, 880), strict=True)])
    inside = [F.when(F.contains(f, wanted), n).otherwise(0) for f, n in zip(fields, (700, 650, 620, 610), strict=True)]
    begins = [F.when(F.startswith(f, wanted), n).otherwise(0) for f, n in zip(fields[:3], (780, 740, 720), strict=True)]
    words, hay = F.filter(F.split(wanted, " "), lambda x: x != ""), F.concat_ws(" ", *[F.nullif(f, F.lit("")) for f in fields])
    spread = F.when((F.size(words) > 0) & F.forall(words, lambda t: F.contains(hay, t)), 600 + F.least(F.lit(40), 10 * F.size(words))).otherwise(0)
    return F.when(wanted == "", 0).otherwise(F.coalesce(whole, F.greatest(*inside, *begins, spread)))


def turn_order(case_id: Column) -> Column:
    """1 for a base id, 2 for `.followup`, N for `.turnN`, else 99."""
    rest = F.lower(F.trim(F.regexp_extract(case_id, r"^[^.]*[.](.*)$", 1)))
    number = F.regexp_extract(rest, "^turn([0-9]+)$", 1)
    return F.when(~F.contains(case_id, F.lit(".")), 1).when(rest == "followup", 2).when(number != "", number.try_cast("int")).otherwise(99)


def all_tokens_in(tokens: Column, words: Column) -> Column:
    """Is every token inside some word?"""
    return F.forall(tokens, lambda t: F.exists(words, lambda w: F.contains(w, t)))


def degrees_text(c: Column) -> Column:
    """Degrees as signed degrees, minutes and seconds."""
    a = F.abs(c)
    s = F.round((a * 3600) % 60, 2)
    return F.format_string("%s%d°%02d'%05.2f", F.when(c < 0, "-").otherwise(""), F.floor(a).cast("int"), (F.floor(a * 60) % 60).cast("int"), s)


def routed(query: Column, default: str = "mixed") -> Column:
    """The channel of which the query has more hints, counted by distinct words; the default on a tie, mixed for a blank query."""
    words = F.regexp_extract_all(F.lower(query), F.lit("([a-z0-9_:/.-]+)"), F.lit(1))
    how, what = (F.size(F.array_intersect(words, F.array(*map(F.lit, hints)))) for hints in (PROCEDURAL_HINTS, DOMAIN_HINTS))
    return F.when(F.coalesce(collapsed(query), F.lit("")) == "", "mixed").when(how > what, "procedural").when(what > how, "domain").otherwise(default)


def channel_split(k: Column, intent: Column, procedural: Column, domain: Column) -> Column:
    """k rows dealt over both channels by their budgets: rounded half to even, one each at least.

    What is over k is taken from the channel that the intent does not name, for a mixed one from the larger.
    """
    p, d, k = F.greatest(procedural, F.lit(0.0)), F.greatest(domain, F.lit(0.0)), F.greatest(k, F.lit(1))
    share = lambda x: F.when(p + d > 0, F.try_divide(x, p + d)).otherwise(0.5)
    a, b = (F.greatest(F.rint(k * share(x)).cast("int"), F.lit(1)) for x in (p, d))
    over, keeps_a = F.greatest(a + b - k, F.lit(0)), F.when(intent == "procedural", True).when(intent == "domain", False).otherwise(a < b)
    return F.struct(F.when(keeps_a, a).otherwise(F.greatest(a - over, F.lit(1))).alias("procedural"), F.when(keeps_a, F.greatest(b - over, F.lit(1))).otherwise(b).alias("domain"))


def sanitised(text: Column) -> Column:
    """ASCII only, spaces collapsed, each paragraph on one line, paragraphs parted by one blank line."""
    ascii_only = F.regexp_replace(F.regexp_replace(text, r"\r\n?", "\n"), r"[^\x00-\x7F]", "")
    lines = F.transform(F.split(ascii_only, "\n"), lambda x: F.trim(F.regexp_replace(x, r"[\t\x0B\f\x1C-\x1F ]+", " ")))
    parts = F.split(F.array_join(lines, "\n"), r"\n{2,}")
    return F.array_join(F.filter(F.transform(parts, lambda x: F.trim(F.translate(x, "\n", " "))), lambda x: x != ""), "\n\n")


def channel(text: Column) -> Column:
    t = F.lower(F.trim(text))
    return F.when(t.isin(CHANNELS), t).otherwise("mixed")


def tags(text: Column) -> Column:
    """Trimmed, non-empty parts of a comma list, each once, in order."""
    return F.array_distinct(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != ""))


#: Kinds of features, and other words for them.
KINDS = ["Crater", "Mons", "Mare", "Massif", "Rima", "Rupes", "Vallis", "Dorsum", "Planitia", "Palus", "Lacus", "Promontorium", "Montes", "Patera", "Sinus", "Catena", "Oceanus", "Dorsa"]
OTHER_KINDS = {
    "mountain": "Mons", "mountains": "Montes", "sea": "Mare", "plain": "Planitia", "plains": "Planitia", "valley": "Vallis", "ridge": "Dorsum", "ridges": "Dorsa", "marsh": "Palus",
    "lake": "Lacus", "ocean": "Oceanus", "cape": "Promontorium", "cliff": "Rupes", "cliffs": "Rupes", "trench": "Rima", "channel": "Rima", "crater": "Crater",
}


def kind(text: Column) -> Column:
    """The usual spelling of a kind of feature or another word for it; other texts as they are, NULL for blank ones."""
    t = F.nullif(collapsed(text), F.lit(""))
    words = {k.lower(): k for k in KINDS} | OTHER_KINDS
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in words.items() for x in pair]), F.lower(t)), t)


def _by(value: Column, f: Callable[[Column], Column]) -> Column:
    """f of a value that is evaluated once, however often f has it: as what an array's function gets."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def name_variants(name: Column, feature_type: Column) -> Column:
    """Array of (name, type) to look up in turn.

    The name as it is; with a kind that it begins or ends with, also without it; each kind before and after
    the bare name; at last the name without a type. Equal ones, whatever their case, are kept once.
    """
    none, blank = F.lit(None).cast("string"), F.lit("")
    pair = lambda a, t, ok: F.when(ok, F.struct(a.alias("name"), t.alias("type")))

    def split(s: Column) -> Column:
        words = F.split(s["base"], " ")
        return F.struct(s["base"].alias("base"), s["given"].alias("given"), words.alias("words"), F.size(words).alias("n"), kind(F.get(words, F.lit(0))).alias("first"), kind(F.get(words, F.size(words) - 1)).alias("last"))

    def parted(s: Column) -> Column:
        n = s["n"]
        begins, ends = (n > 1) & s["first"].isin(KINDS), (n > 1) & s["last"].isin(KINDS)
        inner = F.when(begins, s["first"]).when(ends, s["last"])
        some = lambda a: F.array_join(F.slice(s["words"], F.lit(a), F.greatest(n - 1, F.lit(0))), " ")
        bare = F.when(begins, some(2)).when(ends, some(1))
        return F.struct(s["base"].alias("base"), s["given"].alias("given"), inner.alias("inner"), bare.alias("bare"), F.coalesce(bare, s["base"]).alias("stem"))

    def listed_(s: Column) -> Column:
        base, given, inner, bare, stem = (s[c] for c in ("base", "given", "inner", "bare", "stem"))
        typed = [p for t in (given, inner) for p in (pair(F.concat(t, F.lit(" "), stem), t, t.isNotNull()), pair(F.concat(stem, F.lit(" "), t), t, t.isNotNull()), pair(base, t, t.isNotNull()))]
        every = F.array(pair(base, given, base != ""), pair(base, inner, inner.isNotNull()), pair(bare, inner, inner.isNotNull()), *typed, pair(base, none, given.isNotNull()))
        named = F.filter(every, lambda x: x.isNotNull() & (x["name"] != "") & (F.coalesce(base, blank) != ""))
        return F.transform(named, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type"), F.lower(x["name"]).alias("_n"), F.lower(x["type"]).alias("_t")))

    def once(named: Column) -> Column:
        same = lambda x, y: (x["_n"] == y["_n"]) & x["_t"].eqNullSafe(y["_t"])
        kept = F.filter(named, lambda x, i: ~F.exists(F.slice(named, F.lit(1), i), lambda y: same(x, y)))
        return F.transform(kept, lambda x: F.struct(x["name"].alias("name"), x["type"].alias("type")))

    found = F.struct(collapsed(name).alias("base"), kind(feature_type).alias("given"))
    for step in (split, parted, listed_, once):
        found = _by(found, step)
    return found
