"""Operator 8, PII: base patterns, and candidate gradient boosting beside them. DataFrame functions only.

Generators of high recall propose spans that may overlap: addresses written with (at) and (dot), defanged IP addresses, card
numbers of other lengths, phone numbers without a plus. Boosted trees, unrolled into CASE expressions, score each by its
format and the words before it; a threshold per kind, calibrated for precision on examples held back from training, selects.
Spans of the base patterns always stay, and candidates that touch them go.

The tables have no labels for personal data, so the trees learn from the corpus' own base spans: in a bounded sample of documents
these are written in the ways that the generators look for, which gives good candidates in their real context, and spoilt,
which gives near misses there. Invented examples stand beside them for kinds that the corpus lacks. The thresholds
are calibrated on documents that the trees have not seen. Features come from the same expressions throughout.
"""

from __future__ import annotations

import random

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import boosting
from .base import bounded_sample, materialize, table

KINDS = ("email", "ip", "card", "phone")
#: The base patterns. Possessive quantifiers and "not inside a run, or where the last match ended" change no match, but keep
#: the matcher from trying each start inside a long run and from recursing over long numbers.
BASE = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "email": r"(?i)(?:(?<![a-z0-9._%+-])|\G)[a-z0-9._%+-]++ ?[(\[]at[)\]] ?[a-z0-9-]++(?:(?: ?[(\[]dot[)\]] ?|\.)[a-z0-9-]{2,}+)++",
    "ip": r"(?<![0-9])[0-9]{1,3}(?:\[\.\][0-9]{1,3}){3}(?![0-9])",
    "card": r"(?<![0-9])[0-9](?:[\x20-]?[0-9]){12,18}(?![0-9])",
    "phone": r"(?<![0-9])\(?[0-9]{3}\)?[\x20.-][0-9]{3}[\x20.-][0-9]{4}(?![0-9])",
}
#: Cheap conditions without which a pattern can't match.
GATES = {
    "email": lambda t: t.contains("@"), "ip": lambda t: t.rlike(r"[0-9]\.[0-9]"), "card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "phone": lambda t: t.contains("+"),
    "loose_email": lambda t: t.rlike(r"(?i)[(\[]at[)\]]"), "loose_ip": lambda t: t.contains("[.]"), "loose_card": lambda t: t.rlike(r"[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9][\x20-]?[0-9]"), "loose_phone": lambda t: t.rlike(r"[0-9]{3}[\x20.-][0-9]{4}"),
}
#: Documents, about, whose base spans the trees learn from, and candidates of one document, at most.
DOCUMENTS, OF_ONE = 20_000, 50
#: Candidates, about, that the driver learns from.
EXAMPLES = 50_000
CONTEXT = 24
FEATURES = ("kind", "digits", "length", "luhn", "marks", "joined", "good_words", "bad_words", "first_digit", "written", "ending", "octets", "spaces", "issuer", "local")
#: Last labels of common domains, and words that end sentences of examples that are no addresses.
ENDINGS, WORDS = ("com", "org", "net", "edu", "gov", "info", "biz", "dev", "app", "io"), ("later", "tomorrow", "noon", "please", "there", "tonight", "early", "again")
GOOD, BAD = r"(?i)mail|contact|reach|write|phone|tel|call|mobile|fax|card|visa|amex|pay|host|server|\bip\b|addr", r"(?i)order|version|release|isbn|serial|invoice|part|ticket|no\.|number|id\b|#|build|page"
PRECISION = 0.98


def found_spans(text: Column, pattern: str, gate: Column) -> Column:
    """array<struct<start, value>> of a pattern's matches, in code points: the pieces between the matches give the places."""
    parts, hits = F.split(text, pattern, -1), F.regexp_extract_all(text, F.lit(pattern), 0)
    empty = F.expr("cast(array() as array<struct<start:int,value:string>>)")
    zero = F.struct(F.lit(0).alias("at"), empty.alias("out"))
    both = F.arrays_zip(F.slice(parts, 1, F.size(hits)).alias("gap"), hits.alias("hit"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["gap"])
        return F.struct((start + F.length(x["hit"])).alias("at"), F.array_append(acc["out"], F.struct(start.alias("start"), x["hit"].alias("value"))).alias("out"))

    return F.when(gate, F.aggregate(both, zero, step)["out"]).otherwise(empty)


def digits_of(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def luhn(digits: Column) -> Column:
    """Whether a string of digits passes Luhn's check."""
    at = F.transform(F.split(F.reverse(digits), ""), lambda x, i: F.when(i % 2 == 0, x.try_cast("int")).otherwise(F.when(x.try_cast("int") > 4, x.try_cast("int") * 2 - 9).otherwise(x.try_cast("int") * 2)))
    return F.aggregate(at, F.lit(0), lambda a, x: a + F.coalesce(x, F.lit(0))) % 10 == 0


def byte_part(x: Column) -> Column:
    """Whether digits stand for at most 255, however many zeros lead."""
    bare = F.regexp_replace(x, "^0+", "")
    return (F.length(bare) < 3) | ((F.length(bare) == 3) & (bare <= "255"))


VALID = {
    "email": lambda v: F.lit(True),
    "ip": lambda v: F.forall(F.split(v, r"\."), byte_part),
    "card": lambda v: F.length(digits_of(v)).between(16, 19) & luhn(digits_of(v)),
    "phone": lambda v: F.length(digits_of(v)).between(8, 15),
}


def spans_of(kind: str, found: Column) -> Column:
    """array<struct<k, start, end>>, the kind by its number."""
    return F.transform(found, lambda x: F.struct(F.lit(KINDS.index(kind)).alias("k"), x["start"].alias("start"), (x["start"] + F.length(x["value"])).alias("end")))


def base_spans(text: Column) -> Column:
    def valid(kind: str) -> Column:
        return F.filter(found_spans(text, BASE[kind], GATES[kind](text)), lambda x: VALID[kind](x["value"]))

    return F.concat(*(spans_of(k, valid(k)) for k in KINDS))


def candidates(text: Column) -> Column:
    """array<struct<k, start, end, the features>> of all generators."""

    def features(kind: str, x: Column) -> Column:
        digits, start = digits_of(x["value"]), x["start"]
        end = start + F.length(x["value"])
        before = F.substring(text, F.greatest(start - CONTEXT + 1, F.lit(1)), F.least(start, F.lit(CONTEXT)))
        joined = F.regexp_like(F.concat(F.substring(before, -1, 1), F.substring(text, end + 1, 1)), F.lit(r"[A-Za-z0-9_=\"/]"))
        as_double = lambda c: c.cast("double")
        return F.struct(
            F.lit(KINDS.index(kind)).alias("k"), start.alias("start"), end.alias("end"), F.lit(float(KINDS.index(kind))).alias("kind"), as_double(F.length(digits)).alias("digits"), as_double(F.length(x["value"])).alias("length"),
            as_double(luhn(digits)).alias("luhn"), as_double(F.length(x["value"]) - F.length(digits)).alias("marks"), as_double(joined).alias("joined"),
            as_double(F.regexp_like(before, F.lit(GOOD))).alias("good_words"), as_double(F.regexp_like(before, F.lit(BAD))).alias("bad_words"), F.coalesce(F.substring(digits, 1, 1).try_cast("double"), F.lit(-1.0)).alias("first_digit"),
            as_double(F.regexp_like(x["value"], F.lit(r"(?i)[(\[]dot[)\]]"))).alias("written"),
            # of an address: whether it ends like a domain (2), in two letters as those of countries do (1), or in another word
            F.when(F.regexp_like(x["value"], F.lit(rf"(?i)[.)\]\x20](?:{'|'.join(ENDINGS)})$")), 2.0).when(F.regexp_like(x["value"], F.lit(r"(?i)[.)\]\x20][a-z]{2}$")), 1.0).otherwise(0.0).alias("ending"),
            as_double(F.forall(F.regexp_extract_all(x["value"], F.lit("[0-9]+"), 0), byte_part)).alias("octets"), as_double(F.length(x["value"]) - F.length(F.replace(x["value"], F.lit(" "), F.lit("")))).alias("spaces"),
            as_double(F.regexp_like(digits, F.lit("^(?:3[0478]|36|4|5[1-5]|2[2-7]|6011|65)"))).alias("issuer"), as_double(F.regexp_like(x["value"], F.lit(r"^[A-Za-z0-9-]*[._%+0-9][^\[(]*[(\[]"))).alias("local"),
        )

    def proposed(kind: str) -> Column:
        return F.transform(found_spans(text, LOOSE[kind], GATES[f"loose_{kind}"](text)), lambda x: features(kind, x))

    return F.concat(*(proposed(k) for k in KINDS))


def invented_examples(n: int = 3000, seed: int = 7) -> list[tuple[str, int]]:
    """Texts with one candidate each and whether it is personal data."""
    rng = random.Random(seed)
    digits = lambda k: "".join(rng.choice("0123456789") for _ in range(k))
    word = lambda: "".join(rng.choice("abdeghiklmnorstu") for _ in range(rng.randint(3, 8)))

    def checked(k: int, first: str) -> str:
        body = first + digits(k - 1 - len(first))
        total = sum(d if i % 2 else (2 * d - 9 if d > 4 else 2 * d) for i, d in enumerate(map(int, reversed(body))))
        return body + str(-total % 10)

    out = []
    for i in range(n):
        good = i % 2
        about = rng.choice(["", rng.choice(["mail ", "call ", "phone: ", "card ", "contact ", "tel. ", "server "]) if good else rng.choice(["order ", "order no. ", "version ", "invoice ", "serial ", "part ", "ticket #", "isbn "])])
        lead = " ".join(word() for _ in range(3)) + " " + about
        kind = rng.randrange(4)
        marks = rng.choice([" (at) ", "(at)", " [at] ", "[at]"]), rng.choice([" (dot) ", "[dot]", " [dot] ", "."])
        if kind == 0:
            name, lot = rng.choice([word(), f"{word()}.{word()}", f"{word()}{digits(2)}"]), rng.random()
            if good and lot < 0.1:  # endings of their own, under names that only addresses have
                v = f"{word()}{digits(2)}{marks[0]}{word()}{marks[1]}{word()}"
            elif good:
                v = f"{name}{marks[0]}{word()}{marks[1]}{rng.choice(ENDINGS) if lot < 0.75 else word()[:2]}"
            else:
                v = f"{word()}{marks[0]}{word()}{marks[1]}{rng.choice(WORDS) if lot < 0.5 else word() + 'e' if lot < 0.85 else rng.choice(('it', 'to', 'so', 'we', 'app'))}"
        elif kind == 1:
            v = "[.]".join(str(rng.randint(1, 255)) for _ in range(4)) if good else "[.]".join(str(rng.choice([rng.randint(0, 255), rng.randint(256, 999)])) for _ in range(3)) + f"[.]{rng.randint(256, 999)}"
        elif kind == 2:
            k, first = rng.choice([(15, "34"), (15, "37"), (13, "4"), (14, "36"), (14, "38")])
            real = checked(k, first)
            v = real if good else rng.choice([digits(rng.randint(13, 15)), real[:-1] + str((int(real[-1]) + rng.randint(1, 9)) % 10), checked(rng.randint(13, 15), rng.choice("1789"))])
        else:
            area = f"{rng.randint(201, 989)}"
            plain = rng.choice(["({}) {}-{}", "{}-{}-{}", "{}.{}.{}", "{} {} {}"]).format(area, rng.randint(200, 999), digits(4))
            v = plain if good or about else rng.choice(["{}-{}-{}x", "={} {} {}", "{}.{}.{}"]).format("0" + digits(2), digits(3), digits(4))
        out.append((f"{lead}{v} {word()} {word()}.", good))
    return out


def variant(seed: Column, options: tuple[str, ...], n: int) -> Column:
    """One of the options, by a row's hash."""
    return F.element_at(F.array(*map(F.lit, options)), F.pmod(F.xxhash64(F.lit(n), seed), F.lit(len(options))).cast("int") + 1)


def marks_of(seed: Column) -> tuple[Column, Column]:
    """How a text writes "at" and "dot": good and spoilt ones alike."""
    return variant(seed, (" (at) ", "(at)", " [at] ", "[at]"), 1), variant(seed, (" (dot) ", "[dot]", " [dot] ", "."), 2)


def disguised(text: Column, seed: Column) -> Column:
    """The text with addresses and numbers written as the generators look for them."""
    at, dot = marks_of(seed)
    text = F.regexp_replace(text, F.lit(r"([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]++)\.([A-Za-z0-9-]+)"), F.concat(F.lit("$1"), at, F.lit("$2"), dot, F.lit("$3")))
    text = F.regexp_replace(text, r"(?<![0-9.])([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})\.([0-9]{1,3})(?![0-9.])", "$1[.]$2[.]$3[.]$4")
    return F.regexp_replace(text, r"\+[0-9]{1,3}[ -]?(?=\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})", "")


def spoilt(text: Column, seed: Column) -> Column:
    """The text with what is written like an address or a number, but is none: no domain at the end, parts too large, orders, digits changed."""
    at, dot = marks_of(seed)
    text = F.regexp_replace(text, F.lit(r"([A-Za-z0-9._%+-]++)@([A-Za-z0-9-]++)(?:\.[A-Za-z0-9-]++)+"), F.concat(F.lit("$1"), at, F.lit("$2"), dot, variant(seed, WORDS, 3)))
    text = F.regexp_replace(text, r"(?<![0-9.])[0-9]{1,3}\.([0-9]{1,3})\.[0-9]{1,3}\.([0-9]{1,3})(?![0-9.])", "999[.]$1[.]999[.]$2")
    text = F.regexp_replace(text, r"\+[0-9]{1,3}[ -]?(?=\(?[0-9]{3}\)?[ .-][0-9]{3}[ .-][0-9]{4})", "order no. ")
    return F.regexp_replace(text, r"(?<![0-9])([0-9]{12})([0-9])([0-9]{3})(?![0-9])", "$1$3$2")


def corpus_examples(docs: DataFrame, most: int = DOCUMENTS) -> DataFrame:
    """i, y and the features of candidates in the disguised and in the spoilt texts of documents with base spans: good ones are those of a
    disguised text that hold a base span's digits, the others are of spoilt texts (cards that pass Luhn's check there by chance are left
    out); i is the document's hash."""
    drawn = bounded_sample(docs.where("text is not null").select("doc_id", "text"), "doc_id", most)
    held = drawn.withColumn("base", base_spans(F.col("text"))).where(F.size("base") > 0)
    own = F.transform("base", lambda b: digits_of(F.substring(F.col("text"), b["start"] + 1, b["end"] - b["start"])))
    held = held.withColumn("own", own).withColumn("clear", F.size(F.filter(candidates(F.col("text")), lambda c: c["k"] < 2)) == 0)
    texts = [F.struct(F.lit(good).alias("good"), f(F.col("text"), F.col("doc_id")).alias("t")) for good, f in ((1, disguised), (0, spoilt))]
    both = held.select(F.xxhash64("doc_id").alias("i"), "own", "clear", F.explode(F.array(*texts)).alias("x"))
    found = both.select("i", "own", "clear", "x.good", "x.t", F.explode(F.slice(candidates(F.col("x.t")), 1, OF_ONE)).alias("c"))
    digits = digits_of(F.substring(F.col("t"), F.col("c.start") + 1, F.col("c.end") - F.col("c.start")))
    known = (F.col("c.k") == 0) | F.exists("own", lambda o: o.endswith(digits))
    usable_ = ((F.col("good") == 0) | known) & ((F.col("c.k") > 1) | F.col("clear")) & ((F.col("c.k") != 2) | (F.col("good") == 1) | (F.col("c.luhn") == 0))
    examples = materialize(found.where(usable_).select("i", "c.start", F.col("good").alias("y"), *(F.col(f"c.{f}") for f in FEATURES)), "pii-examples")
    few = F.pmod(F.xxhash64("i", "start", "y", "kind"), F.lit(1 << 20)) < F.lit((1 << 20) * EXAMPLES // max(EXAMPLES, examples.count()))
    return examples.where(few).drop("start")


def fit_selector(docs: DataFrame) -> tuple[boosting.Trees, list[float]]:
    """Trees, and per kind the least score that keeps PRECISION on documents held back (infinite, if none does)."""
    data = invented_examples()
    df = docs.sparkSession.createDataFrame([(i, t, y) for i, (t, y) in enumerate(data)], "i long, text string, y int")
    invented = df.select("i", "y", F.explode(candidates(F.col("text"))).alias("c")).select("i", "y", *(F.col(f"c.{f}") for f in FEATURES))
    got = sorted(tuple(r) for r in invented.unionByName(corpus_examples(docs)).collect())  # bounded by both samples
    x, y, i = np.array([r[2:] for r in got]), np.array([float(r[1]) for r in got]), np.array([r[0] for r in got])
    held = i % 5 == 0
    trees = boosting.fit(x[~held], y[~held], trees=48, depth=3, rate=0.4, bins=32)
    score, thresholds = trees.margin(x[held]), []
    for k in range(len(KINDS)):
        s, t = score[x[held, 0] == k], y[held][x[held, 0] == k]
        ok = [c for c in np.unique(s[t == 1]) if t[s >= c].mean() >= PRECISION]  # where a good one stands
        thresholds.append(max(0.0, float(ok[0])) if ok else float("inf"))
    return trees, thresholds


def selector_quality(docs: DataFrame) -> dict[str, tuple[float, float, int]]:
    """Precision, recall and number of good candidates by kind, of the fitted selector on the corpus' held-back examples."""
    trees, thresholds = fit_selector(docs)
    got = [tuple(r) for r in corpus_examples(docs).where("i % 5 = 0").collect()]
    out = {}
    for k, kind in enumerate(KINDS):
        mine = [r for r in got if r[2] == k]
        if mine:
            said, y = trees.margin(np.array([r[2:] for r in mine])) >= thresholds[k], np.array([r[1] for r in mine]) == 1
            out[kind] = (float(y[said].mean()) if said.any() else 1.0, float(said[y].mean()) if y.any() else 1.0, int(y.sum()))
    return out


def score_sql(trees: boosting.Trees, of: str) -> str:
    """The trees' log-odds as SQL over a struct's fields."""

    def node(t: int, i: int) -> str:
        if i >= 2**trees.depth - 1:
            return f"{trees.value[t][i - 2**trees.depth + 1]:.6f}D"
        left, cut = node(t, 2 * i + 1), trees.threshold[t][i]
        if np.isinf(cut):
            return left
        right = node(t, 2 * i + 2)
        return left if left == right else f"(CASE WHEN {of}.{FEATURES[trees.feature[t][i]]} <= {cut:.6f}D THEN {left} ELSE {right} END)"

    return " + ".join([f"{trees.base:.6f}D", *(node(t, 0) for t in range(len(trees.feature)))])


def detect(docs: DataFrame) -> DataFrame:
    """All columns of `docs` in a struct `row_`, base (array<struct<k, start, end>>) and spans (likewise, base ones included), sorted by kind and start.

    A null text is empty and has no spans. Repeated rows are searched alike; empty tables give no rows; columns of any
    other name are kept inside `row_`.
    """
    trees, thresholds = fit_selector(docs)
    text = F.coalesce(F.col("row_.text"), F.lit(""))
    row = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row_"))
    stage = row.select("row_", base_spans(text).alias("base"), candidates(text).alias("loose"))
    limits = " ".join(f"WHEN {k} THEN {t}D" for k, t in enumerate(thresholds) if np.isfinite(t))
    limit = f"(CASE c.k {limits} ELSE double('Infinity') END)" if limits else "double('Infinity')"
    free = "filter(loose, c -> NOT exists(base, b -> b.start < c.end AND c.start < b.end))"
    stage = stage.select("row_", "base", F.expr(f"filter(transform({free}, c -> struct(c.k AS k, c.start AS start, c.end AS end, ({score_sql(trees, 'c')}) AS score)), c -> c.score >= {limit})").alias("more"))
    # of accepted candidates that overlap, the one with the best score, then the earliest, then the first kind
    best = "filter(more, c -> NOT exists(more, o -> o.start < c.end AND c.start < o.end AND (o.score > c.score OR (o.score = c.score AND struct(o.start, o.k, o.end) < struct(c.start, c.k, c.end)))))"
    return stage.select("row_", "base", F.expr(f"array_sort(concat(base, transform({best}, c -> struct(c.k AS k, c.start AS start, c.end AS end))))").alias("spans"))


def named(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), s.k + 1), ':', s.start, ':', s.end)), ',')")


def op8_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents").select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {i})) as long)").alias(f"n_{k}") for i, k in enumerate(KINDS)]
    return found.select(F.col("row_.doc_id").alias("doc_id"), *counts, F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("spans").alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with every span replaced by its kind in brackets; overlapping spans become one, of the first one's kind."""
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))
    names = F.array(*(F.lit(f"[{k.upper()}]") for k in KINDS))
    ordered = F.array_sort(F.transform(spans, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["k"].alias("k"))))

    def step(acc: Column, s: Column) -> Column:
        fresh = s["start"] >= acc["at"]
        out = F.when(fresh, F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.element_at(names, s["k"] + 1))).otherwise(acc["out"])
        return F.struct(F.greatest(acc["at"], s["end"]).alias("at"), out.alias("out"))

    whole = F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substring(text, a["at"] + 1, F.length(text))))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents with personal data replaced; n_chars, where there is such a column, follows the text. A null text stays null."""
    found = detect(docs)
    text = F.when(F.col("row_.text").isNotNull(), redacted(F.col("row_.text"), F.col("spans")))
    done = found.select("row_", text.alias("text_"))
    new = {"text": F.col("text_"), "n_chars": F.length("text_").cast(docs.schema["n_chars"].dataType) if "n_chars" in docs.columns else None}
    return done.select(*((new[c] if c in new else F.col(f"row_.`{c}`")).alias(c) for c in docs.columns))
