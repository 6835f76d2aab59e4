"""Text, id and list expressions. All are Column to Column and stay in the JVM.

Null text behaves as the empty string unless a function says otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

BLANKS = r"[ \t\n\x0B\f\r]+"
EDGES = r"^[ \t\n\x0B\f\r]+|[ \t\n\x0B\f\r]+$"


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def compact(c) -> Column:
    """Runs of ASCII white space to one blank, ends trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(col(c), F.lit("")), BLANKS, " "))


def strip(c) -> Column:
    """Without ASCII white space at both ends."""
    return F.regexp_replace(col(c), EDGES, "")


def let(value, body) -> Column:
    """body(value) with the value computed once: what a lambda takes from outside is computed anew for each element."""
    return F.element_at(F.transform(F.array(col(value)), body), 1)


def distinct_by(items, key) -> Column:
    """Of elements with equal keys the first, in order; by sorting, so linear but for a logarithm."""
    ranked = F.array_sort(F.transform(items, lambda x, i: F.struct(key(x).alias("k"), i.alias("i"), x.alias("x"))))
    first = let(ranked, lambda r: F.filter(r, lambda e, i: (i == 0) | (e["k"] != F.get(r, F.greatest(i - 1, F.lit(0)))["k"])))
    return F.transform(F.array_sort(F.transform(first, lambda e: F.struct(e["i"], e["x"]))), lambda e: e["x"])


def phrase(c) -> Column:
    """Lower-cased compact phrase."""
    return F.lower(compact(c))


def quoted(c) -> Column:
    return F.concat(F.lit('"'), col(c), F.lit('"'))


def matchable(c) -> Column:
    """Lower case, brackets and punctuation to blanks, compact."""
    return compact(F.regexp_replace(F.lower(F.coalesce(col(c), F.lit(""))), r"[()\[\]{},;:\"'`]", " "))


def alnum(c) -> Column:
    """Lower-case ASCII letter and digit runs joined by blanks."""
    return F.array_join(F.regexp_extract_all(F.lower(F.coalesce(col(c), F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0)), " ")


def holds_phrase(text, part) -> Column:
    """Whole-phrase containment of blank-separated tokens (X06); an empty phrase is in nothing."""
    pad = lambda x: F.concat(F.lit(" "), col(x), F.lit(" "))
    return (col(part) != "") & F.contains(pad(text), pad(part))


def first_text(*cs) -> Column:
    """First argument that is neither null nor empty."""
    return F.coalesce(*[F.nullif(F.trim(col(c)), F.lit("")) for c in cs])


def clean_list(c, limit: int | None = None) -> Column:
    """Compact entries, empty ones dropped, first of equals kept in order."""
    out = F.array_distinct(F.filter(F.transform(F.coalesce(col(c), F.array().cast("array<string>")), compact), lambda x: x != ""))
    return F.slice(out, 1, limit) if limit else out


def scalar_or_list(json) -> Column:
    """A JSON string or list of strings as an array."""
    return F.coalesce(F.from_json(col(json), "array<string>"), F.when(col(json).isNotNull(), F.array(col(json))), F.array().cast("array<string>"))


def query_key(query, retmax) -> Column:
    return F.sha1(F.concat_ws("\n", col(query), col(retmax).cast("string")))


def pmcid(c) -> Column:
    """PMC and digits; bare digits get the prefix, anything else is null."""
    x = F.upper(compact(c))
    return F.when(x.rlike("^PMC[0-9]+$"), x).when(x.rlike("^[0-9]+$"), F.concat(F.lit("PMC"), x))


def term_id(c) -> Column:
    """HP:ddddddd from HP_, HP-, HP: or seven bare digits; others unchanged."""
    x = compact(c)
    digits = F.regexp_extract(F.upper(x), r"^(?:HP[:_-])?([0-9]{7})$", 1)
    return F.when(digits != "", F.concat(F.lit("HP:"), digits)).otherwise(x)


def to_int(c, default: int = 0) -> Column:
    return F.coalesce(F.try_to_number(F.trim(col(c)), F.lit("S999999999")).cast("int"), F.lit(default))


def to_bool(c) -> Column:
    return F.lower(compact(c)).isin("1", "true", "yes", "y", "t")


UNITS = {"minute": "min", "minutes": "min", "sec": "s", "seconds": "s", "day": "d", "days": "d", "year": "y", "years": "y", "month": "mo", "months": "mo", "week": "wk", "weeks": "wk", "mmhg": "mmHg", "bpm": "bpm", "mmol/l": "mmol/L", "mg/dl": "mg/dL", "beats/min": "beats/min", "beats/minute": "beats/minute"}
TEMPORAL = "day days week weeks month months year years h hours min minute minutes s sec seconds".split()
LAB = "ms mmhg % bpm mmol/l mg/dl beats/min beats/minute".split()
WEAK = "signs symptoms with without near induced presenting diagnosed patient patients case clinical pathophysiology mechanism".split() + ["lack of", "due to", "associated with", "in the setting of"]
CASE_TITLES = "case clinical patient proband history findings phenotype".split() + ["physical examination"]
POLARITY = {"LOW_FLAG": r"low|decreased|reduced|hypo|below|lowered", "HIGH_FLAG": r"high|elevated|increased|hyper|above|raised", "NORMAL_FLAG": r"normal|within\s+normal|reference\s+range"}


def unit(c) -> Column:
    """Spelling of a unit (X10); unknown ones stay as written, trimmed."""
    x = F.trim(F.coalesce(col(c), F.lit("")))
    table = F.create_map(*[F.lit(v) for kv in UNITS.items() for v in kv])
    return F.coalesce(F.try_element_at(table, F.lower(x)), x)


def is_temporal(c) -> Column:
    return F.lower(col(c)).isin(TEMPORAL)


def is_lab(c) -> Column:
    return F.lower(col(c)).isin(LAB)


def flags(context) -> Column:
    """Polarity flags whose words occur (X11)."""
    x = F.coalesce(col(context), F.lit(""))
    return F.filter(F.array(*[F.when(x.rlike(rf"(?i)\b(?:{p})\b"), k) for k, p in POLARITY.items()]), lambda v: v.isNotNull())


def label_options(unit_, anchors, context) -> Column:
    """Candidate labels of a measurement from unit, anchors and, for lab units, polarity."""
    u, a = F.lower(F.coalesce(col(unit_), F.lit(""))), col(anchors)
    lit = lambda s: F.array(*[F.lit(x) for x in s.split()])
    lab = F.when(F.array_contains(a, "CALCIUM"), lit("IONIZED_CALCIUM SERUM_CALCIUM OTHER")).when(F.array_contains(a, "MAGNESIUM"), lit("MAGNESIUM OTHER")).otherwise(lit("LAB_VALUE OTHER"))
    share = F.when(F.array_contains(a, "EF"), lit("LVEF OTHER")).otherwise(lit("PERCENT_VALUE OTHER"))
    base = (
        F.when(u == "ms", lit("QTc QT PR QRS OTHER")).when(u == "mmhg", lit("BLOOD_PRESSURE OTHER")).when(u.isin("bpm", "beats/min", "beats/minute"), lit("HEART_RATE OTHER"))
        .when(u.isin("mmol/l", "mg/dl"), lab).when(u == "%", share).when(u.isin(TEMPORAL), lit("DURATION FREQUENCY OTHER")).otherwise(lit("OTHER"))
    )
    return F.array_distinct(F.concat(base, F.when(u.isin(LAB), flags(context)).otherwise(F.array().cast("array<string>"))))


def is_weak(c, max_tokens: int = 5) -> Column:
    """A search phrase worth rewriting: empty, long, bracketed, listed, or narrative."""
    p = phrase(c)
    return (p == "") | (F.size(F.split(p, " ")) > max_tokens) | p.rlike(r"[(),]") | F.exists(F.array(*map(F.lit, WEAK)), lambda w: F.contains(p, w))


def is_case_title(c) -> Column:
    t = F.lower(F.coalesce(col(c), F.lit("")))
    return F.exists(F.array(*map(F.lit, CASE_TITLES)), lambda w: F.contains(t, w))


def trimmed(items) -> Column:
    """Stripped elements, empty ones dropped."""
    return F.filter(F.transform(items, lambda x: strip(x)), lambda x: x != "")


def sentences(c) -> Column:
    """Split after . ? ! and white space."""
    return trimmed(F.split(compact(c), r"(?<=[.?!])\s+"))


def all_lines(c) -> Column:
    return trimmed(F.split(F.coalesce(col(c), F.lit("")), "\n"))


def lines(c, limit: int = 12) -> Column:
    """Stripped, non-empty, distinct lines in order."""
    return F.slice(F.array_distinct(all_lines(c)), 1, limit)


def lines_nocase(c) -> Column:
    """All lines, of those that differ in case alone the first spelling."""
    return distinct_by(all_lines(c), F.lower)


def lines_plain(c) -> Column:
    """Lines without bullets and numbering; one line of 120 characters or more is cut into sentences."""
    raw = strip(F.coalesce(col(c), F.lit("")))
    each = trimmed(F.split(raw, r"\r?\n"))
    each = F.when((F.size(each) <= 1) & (F.length(raw) >= 120), F.split(raw, r"(?<=[.!?])\s+(?=[A-Z0-9])")).otherwise(each)
    return trimmed(F.transform(each, lambda x: F.regexp_replace(x, r"^\s*[-*\d.)\]]+\s*", "")))


def unfenced(c) -> Column:
    """Text inside a code fence, else the text."""
    return F.trim(F.regexp_replace(F.trim(F.coalesce(col(c), F.lit(""))), r"(?s)^```[a-zA-Z]*\s*\n?(.*?)\n?```$", "$1"))


def filled(template: str, values: dict[str, Column | str]) -> Column:
    """A prompt: {name} and {{name}} replaced, null values by nothing."""
    out = F.lit(template)
    for k, v in values.items():
        v = F.coalesce(col(v).cast("string"), F.lit(""))
        out = F.replace(F.replace(out, F.lit("{{" + k + "}}"), v), F.lit("{" + k + "}"), v)
    return out


def capped(c, n: int, tail: str = "") -> Column:
    """At most n characters; what was cut is marked by tail."""
    x = col(c)
    return F.when(F.length(x) > n, F.concat(F.rtrim(F.substring(x, 1, n)), F.lit(tail))).otherwise(x)


def signature(ids) -> Column:
    """Sorted ids joined by a bar."""
    return F.array_join(F.array_sort(col(ids)), "|")


def uniform(seed: int | str, *keys) -> Column:
    """A reproducible number in [0, 1) for a key: the first 32 bits of a SHA-1 (section R)."""
    h = F.sha1(F.concat_ws("|", F.lit(str(seed)), *[col(k).cast("string") for k in keys]))
    return F.conv(F.substring(h, 1, 8), 16, 10).cast("double") / 4294967296.0


GENERIC = "total level concentration activity abnormal increase increased decrease decreased circulating plasma serum blood urine urinary bone hand finger thumb metacarpal phalanx epiphysis epiphyses igg iga ige igg2 immunoglobulin immunoglobulins ossification".split()
STOP_NAME = "abnormal circulating plasma serum blood of the and level concentration activity".split()
BLACKLIST = ("acid phosphatase", "alkaline phosphatase", "arylsulfatase", "erythematous", "macular rash", "rash")


def usable_anchor(c) -> Column:
    """Anchor with at most five tokens, or null for none and for one generic token."""
    t = F.filter(F.split(alnum(c), " "), lambda x: x != "")
    t = F.when(F.size(t) >= 6, F.slice(t, 1, 5)).otherwise(t)
    return F.when((F.size(t) > 1) | ((F.size(t) == 1) & ~F.element_at(t, 1).isin(GENERIC)), F.array_join(t, " "))


def name_anchors(name, synonyms: dict[str, list[str]] | None = None) -> Column:
    """Keywords that show a term in a line: listed synonyms, else leading 3 and 4 tokens, the first five, and the name."""
    t = F.filter(F.split(alnum(name), " "), lambda x: (x != "") & ~x.isin(STOP_NAME))
    head = lambda n: F.array_join(F.slice(t, 1, n), " ")
    own = F.concat(F.when(F.size(t) > 0, F.array(head(3), head(4))).otherwise(F.array().cast("array<string>")), F.slice(t, 1, 5), F.array(alnum(name)))
    if synonyms:
        table = F.create_map(*[x for k, v in synonyms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
        own = F.coalesce(F.try_element_at(table, F.lower(F.trim(col(name)))), own)
    return F.array_distinct(F.filter(F.transform(own, usable_anchor), lambda x: x.isNotNull()))


DEFINES = r"(?i)\b(is|are|was|were) (defined|characteri[sz]ed|caused|a|an|the)\b|\brefers? to\b|\bconsists? of\b"
METHOD = r"(?i)\b(method|methods|protocol|guideline|guidelines|questionnaire|software|algorithm|we (used|performed|conducted))\b"


def sentence_score(sentence, hits) -> Column:
    """+10 definitional, -6 methodological, +2 for each of `hits` phrases held, -0.005 a character."""
    s = col(sentence)
    return F.when(s.rlike(DEFINES), 10.0).otherwise(0.0) - F.when(s.rlike(METHOD), 6.0).otherwise(0.0) + hits * 2.0 - F.length(s) * 0.005


def approx_flag(name, canonical, support, stop: tuple[str, ...] = ("with", "from", "that", "this", "abnormal", "abnormality")) -> Column:
    """1 if no informative token of the name is in the text."""
    tokens = F.filter(F.split(matchable(name), " "), lambda t: (F.length(t) >= 4) & ~t.isin(*stop))
    text = matchable(F.concat_ws(" ", col(canonical), col(support)))
    return F.when((F.size(tokens) > 0) & ~F.exists(tokens, lambda t: F.contains(text, t)), 1).otherwise(0)
