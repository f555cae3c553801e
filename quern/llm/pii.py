"""Personal data: proposed spans, boosted trees, calibrated thresholds.

The base rules' spans are taken as they are.  What they leave of a text is searched by generators of high recall
(numbers of nine digits or more in any grouping; addresses whose at sign or dots are bracketed, spelt out or set apart; dotted
numbers with such dots).  A number of 14 or 15 digits is proposed as a card and as a phone.
Boosted trees score each proposal by its format and its context, and a threshold for each kind selects what is
redacted beside the base spans.  Context is learnt: how much likelier a word is before base spans of a kind than elsewhere
before what is proposed, counted over the whole corpus.

Labels come from the corpus itself.  Each base span is rewritten in forms that the rules do not know: spelt out, without
its plus, with 00 for it, grouped otherwise - and, as what must not be taken, with a broken checksum, a part over 255, numbers for a host,
as a date, in thousands or as a plain number, and for "name at host" the word that stood before it in the place of the name.  Rewritten spans keep the words that stood before them.  Trees are fitted on two thirds of
them; thresholds are set on the last third, at PRECISION.

Everything is DataFrame expressions: trees become conditional expressions over the proposals of a row.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import _tables as tables

KINDS = ("email", "ip", "card", "phone")
#: Base spans, and plain numbers, by hash, that the trees are fitted and thresholds are set on at most.
SEEDS = 4_000
TREES = 12
DEPTH = 4
#: Part of right ones among the rewritten spans above a kind's threshold.
PRECISION = 0.98
#: Code points before a span that its features read, and words of them.
BEFORE = 24
WORDS_BEFORE = 2
#: Words that contexts are learnt for: the most frequent ones of those that stand before LEAST spans or more.
CONTEXT = 300
LEAST = 20

# Possessive repeats cannot backtrack, so no text is slow and no long one exhausts the stack;
# what they match is the same, as what follows a repeat never begins like its body.
#: kind: (text that must be there, pattern) of the base rules.
BASE = {
    "email": ("@", r"(?:\G|(?<![A-Za-z0-9._%+-]))[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++"),
    "ip": (".", r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++"),
    "card": (None, r"[0-9](?:[\x20-]?[0-9]){13,}+"),
    "phone": ("+", r"\+[0-9][\x20().0-9-]+[0-9]"),
}
_AT = r"(?:\x20?[\[({<](?:at|@)[\])}>]\x20?|\x20at\x20|\x20?@\x20?)"
_DOT = r"(?:\x20?[\[({<](?:dot|\.)[\])}>]\x20?|\x20dot\x20|\x20\.\x20)"
#: generator: (kind or null for kinds by number of digits, pattern) of what the base rules leave.
GENERATORS = {
    "spelt": ("email", rf"(?i)(?<![a-z0-9._%+-])[a-z0-9._%+-]++{_AT}[a-z0-9-]++(?:(?:{_DOT}|\.)[a-z0-9-]++)++"),
    "marked": ("ip", rf"(?i)(?<![0-9])[0-9]++(?:(?:{_DOT}|\.)[0-9]++){{3}}"),
    "number": (None, r"(?<![0-9])[(]?[0-9](?:[\x20().-]{0,2}[0-9]){8,}+"),
}
_FOUND = "struct<start:int,text:string,before:string>"


def _let(value: Column, body) -> Column:
    """body of value, which is evaluated once however often body names it."""
    return F.get(F.transform(F.array(value), body), 0)


def _total(numbers: Column, upto: Column | None = None) -> Column:
    return F.aggregate(numbers if upto is None else F.slice(numbers, F.lit(1), upto), F.lit(0), lambda a, x: a + x)


def located(found: Column, between: Column) -> Column:
    """Start (in code points), text and the code points before of each match, from the matches and the pieces between them.

    Running totals go in two levels, root n chunks of root n elements: an aggregate that gathers its output in its buffer
    copies all of it at each step.
    """
    parts = F.zip_with(found, between, lambda m, b: F.struct(F.length(b).alias("gap"), F.length(m).alias("size"), m.alias("text"), F.right(b, F.lit(BEFORE)).alias("before")))
    matches = F.filter(parts, lambda p: p["text"].isNotNull())  # the piece after the last match has none of its own

    def place(chunk: Column, begin: Column) -> Column:
        def each(moves: Column) -> Column:
            start = lambda p, i: begin + _total(moves, i) + p["gap"]
            return F.transform(chunk, lambda p, i: F.struct(start(p, i).alias("start"), p["text"].alias("text"), p["before"].alias("before")))

        return _let(F.transform(chunk, lambda p: p["gap"] + p["size"]), each)

    def chunked(all_: Column) -> Column:
        n = F.greatest(F.ceil(F.sqrt(F.size(all_))).cast("int"), F.lit(1))
        chunks = F.transform(F.sequence(F.lit(0), F.floor((F.size(all_) - 1) / n).cast("int")), lambda k: F.slice(all_, k * n + 1, n))
        return _let(chunks, lambda c: _let(F.transform(c, lambda x: _total(F.transform(x, lambda p: p["gap"] + p["size"]))), lambda sums: _joined(c, sums)))

    def _joined(chunks: Column, sums: Column) -> Column:
        begins = F.transform(sums, lambda _, k: _total(sums, k))
        return F.flatten(F.zip_with(chunks, begins, place))

    return _let(matches, chunked)


def _digits(text: Column) -> Column:
    return F.regexp_replace(text, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether the Luhn sum of a string of digits is a multiple of 10."""
    each = F.transform(F.split(F.reverse(digits), ""), lambda d, i: F.when(i % 2 == 0, d.cast("int")).otherwise((d.cast("int") * 2) % 10 + F.floor(d.cast("int") / 5).cast("int")))
    return F.aggregate(each, F.lit(0), lambda a, d: a + F.coalesce(d, F.lit(0))) % 10 == 0


def _octet(text: Column) -> Column:
    """The greatest part of a dotted number, 999 for parts of over three digits besides leading zeros."""
    part = lambda p: F.regexp_replace(p, "^0+(?=[0-9])", "")
    return F.array_max(F.transform(F.split(text, r"\."), lambda p: F.when(F.length(part(p)) > 3, 999).otherwise(part(p).cast("int"))))


def _strict(generator: str, text: Column) -> Column:
    """Whether a match of a base generator stands."""
    if generator == "ip":
        return _octet(text) <= 255
    n = F.length(_digits(text))
    if generator == "card":
        return F.when((n >= 14) & (n <= 19), luhn(_digits(text))).otherwise(False)
    return (n >= 10) & (n <= 15) if generator == "phone" else F.lit(True)


#: Format and context features of a proposal.
FEATURES = ("kind", "digits", "length", "separators", "checksum", "octets", "context", "groups", "letters", "glued", "tail", "first_run", "last_run", "longest_run", "brackets", "sign", "dots", "marks", "lead")


def features(text: Column, before: Column, kind: Column) -> list[Column]:
    """The features of a proposal, by name, from what it says, the code points before it and its kind (a place in KINDS);
    context is not among them, but the words that it is made of are."""
    local = F.regexp_extract(text, r"^[A-Za-z0-9._%+-]*", 0)
    n = F.length(_digits(text))
    runs = F.filter(F.split(text, "[^0-9]+"), lambda x: x != "")
    longest = F.array_max(F.transform(runs, F.length))
    octets = F.when(F.size(runs) == 4, F.array_max(F.transform(runs, lambda r: F.when(F.length(r) > 3, 999).otherwise(r.cast("int")))) <= 255).otherwise(False)
    made = {
        "kind": kind,
        "digits": n,
        "length": F.length(text),
        "separators": F.length(F.regexp_replace(text, "[^\\x20().-]", "")),
        "checksum": F.when((n >= 12) & (n <= 19), luhn(_digits(text))).otherwise(False),
        "octets": octets,
        "groups": F.size(F.split(text, "[^0-9A-Za-z]+")),
        "letters": F.length(F.regexp_replace(text, "[^A-Za-z]", "")),
        "glued": F.rlike(before, F.lit("[0-9A-Za-z+.-]$")),
        "tail": F.length(F.regexp_extract(F.right(text, F.lit(16)), "[A-Za-z]*$", 0)),
        "first_run": F.coalesce(F.length(F.get(runs, 0)), F.lit(0)),
        "last_run": F.coalesce(F.length(F.element_at(F.when(F.size(runs) > 0, runs), -1)), F.lit(0)),
        "longest_run": F.coalesce(longest, F.lit(0)),
        "brackets": F.length(F.regexp_replace(text, r"[^\[\](){}<>]", "")),
        "sign": F.when(F.rlike(text, F.lit(r"(?i)[\[({<](?:at|@)[\])}>]")), 3).when(F.contains(text, F.lit("@")), 2).when(F.rlike(text, F.lit(r"(?i)\x20at\x20")), 1).otherwise(0),
        "dots": F.size(F.regexp_extract_all(text, F.lit(rf"(?i){_DOT}"), F.lit(0))),
        "marks": F.length(F.regexp_replace(local, "[A-Za-z]", "")),
        "lead": F.startswith(text, F.lit("00")),
    }
    return [*(made[f].cast("double").alias(f) for f in FEATURES if f != "context"), _words_before(before).alias("words")]


def _words_before(before: Column) -> Column:
    words = F.regexp_extract_all(F.lower(before), F.lit(r"\p{L}{2,}"), F.lit(0))
    return F.when(F.size(words) > WORDS_BEFORE, F.slice(words, -WORDS_BEFORE, WORDS_BEFORE)).otherwise(words)


def _matches(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def _placed(name: str, text: str, pattern: str) -> Column:
    """The places of name_found in text; rows without matches are not split."""
    found = F.col(f"{name}_found")
    return F.when(F.size(found) > 0, located(found, F.split(text, pattern, -1))).otherwise(F.array().cast(f"array<{_FOUND}>")).alias(name)


def proposals(docs: DataFrame) -> DataFrame:
    """doc_id, base, seeds and proposed of each row of docs.

    base: array of struct<start, kind, end>, by start, then kind; seeds: what those spans say and what stands before them;
    proposed: spans of the generators with their features.  Generators read the text with base spans blanked out.
    """
    df = docs.select("doc_id", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    for name, (must, pattern) in BASE.items():
        found = _matches(F.col("text"), pattern)
        df = df.withColumn(f"{name}_found", found if must is None else F.when(F.contains("text", F.lit(must)), found).otherwise(F.array().cast("array<string>")))
    df = df.select("doc_id", "text", *(_placed(name, "text", pattern) for name, (_, pattern) in BASE.items()))
    df = df.select("doc_id", "text", *(F.filter(name, _stands(name)).alias(name) for name in BASE))
    base = F.array_sort(F.concat(*(F.transform(name, _span(KINDS.index(name))) for name in BASE)))
    seeds = F.concat(*(F.transform(name, _seed(KINDS.index(name))) for name in BASE))
    df = df.select("doc_id", "text", base.alias("base"), seeds.alias("seeds"), *(F.size(name).alias(f"n_{name}") for name in BASE))
    for name, (_, pattern) in BASE.items():
        df = df.withColumn("text", F.when(F.col(f"n_{name}") > 0, _blanked(name, "text", pattern)).otherwise(F.col("text")))
    df = df.select("doc_id", "text", "base", "seeds", *(_matches(F.col("text"), pattern).alias(f"{name}_found") for name, (_, pattern) in GENERATORS.items()))
    df = df.select("doc_id", "base", "seeds", *(_placed(name, "text", pattern) for name, (_, pattern) in GENERATORS.items()))
    return df.select("doc_id", "base", "seeds", F.concat(*(_proposed(name, kind) for name, (kind, _) in GENERATORS.items())).alias("proposed"))


def _stands(name: str):
    return lambda s: _strict(name, s["text"])


def _span(kind: int):
    return lambda s: F.struct(s["start"].alias("start"), F.lit(kind).alias("kind"), (s["start"] + F.length(s["text"])).alias("end"))


def _seed(kind: int):
    return lambda s: F.struct(F.lit(kind).alias("kind"), s["text"].alias("text"), s["before"].alias("before"))


def _blanked(name: str, text: str, pattern: str) -> Column:
    """text with the matches that stand put as as many NULs."""
    blank = lambda b, m: F.concat(b, F.coalesce(F.when(_strict(name, m), F.repeat(F.lit("\0"), F.length(m))).otherwise(m), F.lit("")))
    return F.array_join(F.zip_with(F.split(text, pattern, -1), _matches(F.col(text), pattern), blank), "")


_CARD, _PHONE = KINDS.index("card"), KINDS.index("phone")


def _number_kinds(text: Column) -> Column:
    """What a number may be, a card before a phone."""
    n = F.length(_digits(text))
    card, phone = F.lit(_CARD), F.lit(_PHONE)
    return F.when(n > 15, F.array(card)).when(n >= 14, F.array(card, phone)).otherwise(F.array(phone))


def _proposed(name: str, kind: str | None) -> Column:
    """The proposals of a generator's matches, one for each kind that a match may be of."""
    one = lambda s, own: F.struct(s["start"].alias("start"), (s["start"] + F.length(s["text"])).alias("end"), *features(s["text"], s["before"], own))
    if kind:
        return F.transform(name, lambda s: one(s, F.lit(KINDS.index(kind))))
    return F.flatten(F.transform(name, lambda s: F.transform(_number_kinds(s["text"]), lambda own: one(s, own))))


def rewritten(kind: Column, text: Column, before: Column, pick: Column) -> Column:
    """Forms of a base span that the base rules do not know: array of struct<kind, text, label>; pick, a whole number, varies them."""
    word = F.regexp_extract(before, r"([A-Za-z]{2,})[^A-Za-z]*$", 1)
    vary = lambda step, *of: F.element_at(F.array(*of), (F.pmod(F.floor(pick / step), F.lit(len(of))) + 1).cast("int"))
    name = F.substring_index(text, "@", 1)
    letters = F.coalesce(F.nullif(F.regexp_replace(name, "[^A-Za-z]", ""), F.lit("")), name)
    marked = F.concat(letters, F.pmod(pick, F.lit(10)).cast("string"))
    local = vary(11, name, letters, marked, name)
    host = vary(5, F.substring_index(text, "@", -1), F.substring_index(F.substring_index(text, "@", -1), ".", -2))
    digits = _digits(text)
    bare = F.ltrim(F.regexp_replace(text, "^[+]", ""))
    choose = lambda *of: F.element_at(F.array(*(x if isinstance(x, Column) else F.lit(x) for x in of)), (F.pmod(pick, F.lit(len(of))) + 1).cast("int"))
    runs = lambda step, *sizes: vary(step, *(F.lit(f"([0-9]{{{n}}})(?=[0-9])") for n in sizes))
    grouped = lambda d, by, of=F.lit("([0-9]{4})(?=[0-9])"): F.regexp_replace(d, of, F.concat(F.lit("$1"), by))
    joined = lambda by, *of: F.call_function("concat_ws", by, *of)  # noqa: E731  F.concat_ws takes no column to join by
    last = F.substring(digits, -1, 1).cast("int")
    broken = F.concat(F.substring(digits, F.lit(1), F.length(digits) - 1), ((last + 1 + F.pmod(F.floor(pick / 7), F.lit(9))) % 10).cast("string"))
    regroup = lambda d: joined(choose("-", " ", "."), F.substring(d, -10, 3), F.substring(d, -7, 3), F.substring(d, -4, 4))
    parts = F.split(text, r"\.")
    over = (256 + F.pmod(F.floor(pick / 7), F.lit(744))).cast("string")
    forms = {
        "email": [
            (F.concat(local, choose(" [at] ", "[at]", " (at) ", "(at)"), F.replace(host, F.lit("."), choose(" [dot] ", ".", "[dot]", " (dot) ", "(dot)"))), 1),
            (F.concat(local, choose(" (at) ", "[at]"), F.replace(host, F.lit("."), choose(".", "(dot)", " [dot] "))), 1),
            (F.concat(local, choose(" [at] ", "(at)"), F.replace(F.regexp_replace(host, "[A-Za-z]", "5"), F.lit("."), choose(" [dot] ", "."))), 0),
            (F.concat(local, choose(" [at] ", "(at)", "[at]"), F.regexp_replace(host, r"\.[^.]*$", ""), F.lit("."), F.substring(host, -1, 1)), 0),
            (F.concat(local, F.lit(" at "), F.replace(host, F.lit("."), F.lit(" dot "))), 1),
            (F.concat(local, choose("@", " @ "), F.replace(host, F.lit("."), choose("[.]", "[dot]", " . ", " dot "))), 1),
            (F.concat(vary(11, name, marked), F.lit(" at "), host), 1),
            (F.concat(word, F.lit(" at "), host), 0),
            (F.concat(word, choose(" at ", " @ "), F.regexp_replace(host, "[A-Za-z]", "5")), 0),
        ],
        "ip": [
            (joined(choose("[.]", " [.] ", "[dot]", "(dot)", " (dot) "), parts), 1),
            (joined(choose(" dot ", " . "), parts), 1),
            (F.concat(F.substring_index(text, ".", 3), choose("[.]", "(dot)", "{.}"), F.get(parts, 3)), 1),
            (F.concat(F.substring_index(text, ".", 3), F.lit("."), over), 0),
            (joined(choose(" dot ", " . "), F.get(parts, 0), over, F.get(parts, 2), F.get(parts, 3)), 0),
            (joined(choose("[.]", "(.)", " [dot] "), over, F.get(parts, 1), F.get(parts, 2), F.get(parts, 3)), 0),
        ],
        "card": [
            (grouped(digits, choose(".", "  ", ". ", "--", " - ")), 1),
            (grouped(digits, choose("  ", ".", "-."), runs(3, 3, 5, 2, 6)), 1),
            (grouped(broken, choose("  ", ".", "-."), runs(3, 3, 5, 2, 6)), 0),
            (grouped(broken, choose(".", "  ", ". ", "--", " - ")), 0),
            (grouped(broken, choose("", "-", " ", ".")), 0),
        ],
        "phone": [
            (bare, 1),
            (regroup(digits), 1),
            (F.concat(F.lit("("), F.substring(digits, -10, 3), F.lit(") "), F.substring(digits, -7, 3), choose("-", " ", "."), F.substring(digits, -4, 4)), 1),
            (F.concat(F.substring(digits, 1, 1), choose(" ", "-", "."), regroup(digits)), 1),
            (F.concat(F.lit("00"), F.substring(digits, 1, 2), choose(" ", "-", "."), grouped(F.substring(digits, 3, 10), choose(" ", "-", "."), runs(3, 2, 3, 4, 5))), 1),
            (F.concat(F.lit("("), F.substring(digits, -10, 3), F.lit(") "), grouped(F.substring(digits, -7, 7), choose(" ", "-", "."), runs(3, 2, 3, 4))), 1),
            (F.concat(F.lit("00"), F.substring(digits, 1, 2), choose(" ", "-", "."), grouped(F.concat(F.substring(digits, 3, 10), F.substring(digits, 2, 1)), choose(" ", "-", "."), runs(3, 2, 3, 4, 5))), 1),
            (F.concat(F.lit("00"), bare), 1),
            (F.regexp_replace(F.substring(digits, 1, 12), F.lit("(?<=[0-9])(?=(?:[0-9]{3})+$)"), choose(" ", ".")), 0),
            (digits, 0),
            (F.concat(F.lit("20"), F.substring(digits, -8, 2), choose("-", "."), F.substring(digits, -6, 2), choose("-", "."), F.substring(digits, -4, 2), F.lit(" "), F.substring(digits, -2, 2)), 0),
            (F.concat(F.substring(digits, -7, 7), F.lit("."), F.substring(digits, -4, 4)), 0),
            (F.concat_ws(" ", F.substring(digits, -9, 5), F.substring(digits, -5, 5)), 0),
        ],
    }
    out = F.array().cast("array<struct<kind:int,text:string,label:int>>")
    for of, made in forms.items():
        own = F.array(*(F.struct(F.lit(KINDS.index(of)).alias("kind"), t.alias("text"), F.lit(label).alias("label")) for t, label in made))
        out = F.when(kind == KINDS.index(of), own).otherwise(out)
    return out


def _plain(found: DataFrame) -> DataFrame:
    """Proposals that are digits only."""
    return found.where("size(proposed) > 0").select("doc_id", F.explode("proposed").alias("p")).where("p.separators = 0 and p.letters = 0 and p.dots = 0")


def examples(found: DataFrame, seeds: int = SEEDS) -> DataFrame:
    """key, label, features and words of rewritten base spans, and of numbers without any separator, of `seeds` of either at most, those of
    least hash.  A rewritten span counts if a generator takes all of it; a number that may be of two kinds is an example of either."""
    each = found.where("size(seeds) > 0").select("doc_id", F.posexplode("seeds").alias("at", "s")).select(F.xxhash64("doc_id", "at", "s").alias("key"), "s.*")
    each = each.orderBy("key", "kind", "text", "before").limit(seeds)
    forms = each.select("key", "before", F.explode(rewritten(F.col("kind"), F.col("text"), F.col("before"), F.abs(F.col("key") % 1_000_003))).alias("f")).select("key", "before", "f.*")
    whole = F.lit(False)
    for kind, pattern in GENERATORS.values():
        right = (F.col("kind") == KINDS.index(kind)) if kind else F.col("kind").isin(_CARD, _PHONE)
        whole = whole | (right & (F.regexp_extract("text", pattern, 0) == F.col("text")))
    said = F.when(F.col("kind") >= _CARD, _number_kinds(F.col("text"))).otherwise(F.array("kind"))
    forms = forms.where(whole).withColumn("said", F.explode(said)).withColumn("label", F.when(F.col("said") == F.col("kind"), F.col("label")).otherwise(0).cast("double"))
    forms = forms.select("key", "label", *features(F.col("text"), F.col("before"), F.col("said")))
    plain = _plain(found).select(F.xxhash64("doc_id", "p").alias("key"), "p.*").orderBy("key").limit(seeds)
    return forms.unionByName(plain.drop("start", "end").withColumn("label", F.lit(0.0)))


def contexts(found: DataFrame) -> dict[tuple[int, str], float]:
    """(kind, word): log of how much likelier the word is before base spans of the kind than before the rest of base spans and plain
    numbers.  All of found is counted; CONTEXT words come back."""
    seeds = found.where("size(seeds) > 0").select(F.explode("seeds").alias("s")).select("s.kind", _words_before(F.col("s.before")).alias("words"))
    rows = seeds.union(_plain(found).select(F.lit(-1), "p.words"))
    of = range(-1, len(KINDS))
    each = rows.select("kind", F.explode(F.concat(F.array(F.lit("")), F.array_distinct("words"))).alias("word"))  # "": the row itself
    counts = each.groupBy("word").agg(*(F.count_if(F.col("kind") == k).alias(f"n{k}") for k in of), F.count("*").alias("n"))
    counts = counts.where(F.col("n") >= LEAST).orderBy(F.col("n").desc(), "word").limit(CONTEXT + 1).collect()
    total = next((r for r in counts if r["word"] == ""), None)
    out = {}
    for r in counts:
        for k in of[1:] if r["word"] else ():
            own, rest = (r[f"n{k}"] + 0.5) / (total[f"n{k}"] + 1), (r["n"] - r[f"n{k}"] + 0.5) / (total["n"] - total[f"n{k}"] + 1)
            out[k, r["word"]] = round(math.log(own / rest), 4)
    return out


def _tree(node, c) -> Column:
    """A fitted tree as a conditional expression over a proposal."""
    if not node.getClass().getSimpleName().startswith("Internal"):
        return F.lit(float(node.prediction()))
    split = node.split()
    value = c[FEATURES[split.featureIndex()]].cast("double")
    return F.when(value <= float(split.threshold()), _tree(node.leftChild(), c)).otherwise(_tree(node.rightChild(), c))


class Scorer:
    """Boosted trees and a threshold for each kind; without proposals to learn from, nothing is selected."""

    def __init__(self, trees=(), weights=(), thresholds=None, contexts=None):
        self.trees, self.weights, self.thresholds, self.contexts = trees, weights, thresholds or {}, contexts or {}

    def context(self, kind: Column, words: Column) -> Column:
        if not self.contexts:
            return F.lit(0.0)
        table = F.create_map(*(F.lit(x) for (k, word), value in self.contexts.items() for x in (f"{k} {word}", value)))
        value = lambda w: F.coalesce(F.try_element_at(table, F.concat_ws(" ", kind.cast("int").cast("string"), w)), F.lit(0.0))
        return F.aggregate(words, F.lit(0.0), lambda a, w: a + value(w))

    def score(self, c) -> Column:
        total = F.lit(0.0)
        for tree, weight in zip(self.trees, self.weights):
            total = total + _tree(tree._call_java("rootNode"), c) * float(weight)
        return 1 / (1 + F.exp(-2 * total))

    def selects(self, c) -> Column:
        if not self.thresholds:
            return F.lit(False)
        limit = F.lit(2.0)
        for kind, at in self.thresholds.items():
            limit = F.when(c["kind"] == kind, at).otherwise(limit)
        return self.score(c) >= limit


def fit(found: DataFrame, seeds: int = SEEDS) -> Scorer:
    """Trees and thresholds from examples(found)."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    known = contexts(found)
    rows = tables.written(examples(found, seeds).withColumn("context", Scorer(contexts=known).context(F.col("kind"), F.col("words"))).drop("words"))
    if rows.select("label").distinct().count() < 2:
        tables.drop(rows)
        return Scorer()
    part = F.pmod(F.xxhash64("key"), F.lit(3))  # the forms of one span stay together
    vectors = VectorAssembler(inputCols=list(FEATURES), outputCol="features").transform(rows).withColumn("part", part)
    if vectors.where("part > 0").select("label").distinct().count() < 2:
        tables.drop(rows)
        return Scorer()
    model = GBTClassifier(maxIter=TREES, maxDepth=DEPTH, stepSize=0.4, seed=5, minInstancesPerNode=3).fit(vectors.where("part > 0"))
    scorer = Scorer(model.trees, model.treeWeights, contexts=known)
    seen = rows.where(part == 0).withColumn("bin", F.floor(scorer.score({f: F.col(f) for f in FEATURES}) * 100))
    counts = seen.groupBy("kind", "bin").agg(F.sum("label").alias("right"), F.count("*").alias("n")).collect()  # at most 101 rows a kind
    for kind in range(len(KINDS)):
        hits = n = 0
        for r in sorted((r for r in counts if r["kind"] == kind and r["bin"] >= 50), key=lambda r: -r["bin"]):
            hits, n = hits + r["right"], n + r["n"]
            if n >= 5 and hits >= PRECISION * n:
                scorer.thresholds[kind] = r["bin"] / 100
    tables.drop(rows)
    return scorer


def find_personal_data(docs: DataFrame) -> DataFrame:
    """doc_id, base and spans of each row of docs: arrays of struct<start, kind, end>, by start, then kind (a place in KINDS),
    in code points, end exclusive; spans holds base and what the trees select of the rest.  A null text is empty; without base
    spans to learn from, nothing is added.  Rows that share an id, or are the same, are judged each for itself; no other column is read."""
    found = tables.written(proposals(docs))
    scorer = fit(found)
    if not scorer.thresholds:
        return found.select("doc_id", "base", F.col("base").alias("spans"))
    scored = F.transform("proposed", lambda p: p.withField("context", scorer.context(p["kind"], p["words"])))
    # of a number that passes as a card and as a phone, which stand side by side, the card stays
    again = lambda all_, p, i: (p["kind"] == _PHONE) & F.coalesce(F.get(all_, i - 1)["start"] == p["start"], F.lit(False))
    chosen = _let(F.filter(scored, scorer.selects), lambda all_: F.filter(all_, lambda p, i: ~again(all_, p, i)))
    chosen = F.transform(chosen, lambda p: F.struct(p["start"].alias("start"), p["kind"].cast("int").alias("kind"), p["end"].alias("end")))
    return found.select("doc_id", "base", F.array_sort(F.concat("base", chosen)).alias("spans"))


def query(docs: DataFrame) -> DataFrame:
    name = lambda s: F.element_at(F.array(*map(F.lit, KINDS)), s["kind"] + 1)
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", name(s), s["start"], s["end"])), ",")
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("bigint")
    return find_personal_data(docs).select(
        "doc_id", *(count(i).alias(f"n_{k}") for i, k in enumerate(KINDS)), F.sha2(joined("base").cast("binary"), 256).alias("base_sha256"), joined("spans").alias("spans")
    )
