"""Operator 12, secret scans: multipart credential linking. DataFrame functions only.

Base patterns find what is a secret by itself. Beside them, patterns of high recall find parts that alone mean little:
identifiers, keys and endpoints. A text's parts are numbered by scope (what stands between blank lines) and linked by an
interval join: intervals, widened by the reach, are laid over bins of that width, and parts that share (text, scope, bin) and overlap are
neighbours. An identifier is reported where a secret or a key is near, a key where an identifier is near, an endpoint where both are.
The joins are semi joins over bins that hold a bounded number of parts, so neither pairs nor groups grow.

Only texts that hold an identifier and a secret or key at all reach the join, each distinct one once, without its characters.
"""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .base import materialize, table
from .pii import found_spans


def either(word: str) -> str:
    """A pattern for a word's ASCII letters in either case."""
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def any_word(*words: str) -> str:
    return "(?:" + "|".join(map(either, words)) + ")"


#: Between a name and its value.
SET = r"""["']?\x20*[:=]\x20*["']?"""
#: Base kinds, then those that count only together. What RE2 and Java take alike, so that SQL can say the same.
KINDS = ("assign", "access", "hex", "id", "key", "endpoint")
PATTERNS = {
    "assign": rf"({either('password')}|{either('passwd')}|{either('secret')}|{either('token')}|{either('api')}_?{either('key')}){SET}([A-Za-z0-9+/_.=-]+)",
    "access": r"AKIA[A-Z0-9]+",
    "hex": r"[0-9a-f]{32,}",
    "id": rf"A[A-Z]IA[A-Z0-9]{{8,}}|{any_word('access_key_id', 'accesskeyid', 'access_key', 'key_id', 'client_id', 'clientid', 'account', 'app_id', 'tenant', 'username', 'user', 'login')}{SET}[A-Za-z0-9._@-]+",
    "key": rf"{any_word('passphrase', 'passcode', 'pass', 'pwd', 'bearer', 'authorization', 'private_key', 'signature', 'sig')}{SET}[A-Za-z0-9+/_.=!@#$%^&*-]+|[A-Za-z0-9+/_-]{{16,}}",
    "endpoint": rf"[A-Za-z0-9+]+://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+|{any_word('endpoint', 'hostname', 'host', 'server', 'region', 'bucket', 'database')}{SET}[A-Za-z0-9._:/-]+",
}
#: The same matches, without trying each start inside a long run.
FAST = {"endpoint": PATTERNS["endpoint"].replace("[A-Za-z0-9+]+://", r"(?:(?<![A-Za-z0-9+])|\G)[A-Za-z0-9+]++://", 1)}
#: Words, in lower case, one of which stands, and a colon or an equals sign too, in any text that a pattern matches in; what a pattern matches
#: without them has its own gate.
HINTS = {
    "assign": ("password", "passwd", "secret", "token", "api"), "id": ("key", "client", "account", "app_id", "tenant", "user", "login"), "key": ("pass", "pwd", "bearer", "authorization", "private_key", "sig"),
    "endpoint": ("://", "endpoint", "host", "server", "region", "bucket", "database"),
}
ALSO = {"access": lambda t: t.contains("AKIA"), "hex": lambda t: F.lit(True), "id": lambda t: t.contains("IA"), "key": lambda t: t.rlike("[0-9][A-Za-z+/_-]|[A-Za-z+/_-][0-9]") & t.rlike("[A-Za-z0-9+/_-]{16}")}
BREAK = r"\n[\x20\t\r]*\n"
BASE, IDENTIFIERS, SECRETS = (0, 1, 2), (1, 3), (0, 2, 4)
ID, KEY, ENDPOINT, BORDER = 3, 4, 5, 6
#: Code points that may stand between two parts of one credential.
REACH = 400

VALID = {
    "assign": lambda v: F.length(F.regexp_extract(v, PATTERNS["assign"], 2)) >= 8,
    "access": lambda v: F.length(v) >= 16,
    "hex": lambda v: F.lit(True),
    "id": lambda v: F.lit(True),
    "key": lambda v: v.rlike("[:=]") | (v.rlike("[a-z]") & v.rlike("[A-Z]") & v.rlike("[0-9]")),
    "endpoint": lambda v: F.lit(True),
}


def may_hold(text: Column, low: Column, kind: str) -> Column:
    """A cheap condition without which a kind's pattern can't match; `low` is the text in lower case."""
    either_ = lambda found: functools.reduce(Column.__or__, found, F.lit(False))
    set_ = (text.contains(":") | text.contains("=")) & either_([low.contains(h) for h in HINTS.get(kind, ())])
    return set_ | (ALSO[kind](text) if kind in ALSO else F.lit(False))


def parts_of(text: Column, low: Column, kind: str) -> Column:
    """array<struct<start, k, end>> of a kind's valid matches, by start."""
    pattern = FAST.get(kind, PATTERNS[kind])
    found = F.filter(found_spans(text, pattern, may_hold(text, low, kind) & text.rlike(pattern)), lambda x: VALID[kind](x["value"]))
    return F.transform(found, lambda x: F.struct(x["start"].alias("start"), F.lit(KINDS.index(kind)).alias("k"), (x["start"] + F.length(x["value"])).alias("end")))


def borders_of(text: Column) -> Column:
    return F.transform(found_spans(text, BREAK, text.rlike(BREAK)), lambda x: F.struct(x["start"].alias("start"), F.lit(BORDER).alias("k"), (x["start"] + F.length(x["value"])).alias("end")))


def scanned(docs: DataFrame, keep: list[str]) -> DataFrame:
    """row_ (the kept columns), base, and for texts that may hold a credential in parts `name` (the text's SHA-256) and all `parts`."""
    text = F.coalesce(F.col("text_"), F.lit(""))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in keep)).alias("row_"), F.col("text").alias("text_"))
    low = rows.withColumn("low_", F.lower(text))
    each = low.select("row_", "text_", *(parts_of(text, F.col("low_"), k).alias(f"{k}_") for k in KINDS))
    some = lambda kinds: F.greatest(*(F.size(f"{KINDS[k]}_") for k in kinds)) > 0
    open_ = some(IDENTIFIERS) & some(SECRETS) & some((ID, KEY, ENDPOINT))
    return each.select(
        "row_", F.array_sort(F.concat(*(f"{KINDS[k]}_" for k in BASE))).alias("base"), F.when(open_, F.sha2(text.cast("binary"), 256)).alias("name"),
        F.when(open_, F.concat(*(f"{k}_" for k in KINDS), borders_of(text))).alias("parts"),
    )


def in_bins(parts: DataFrame, reach: int, wider: int = 0) -> DataFrame:
    """The parts once for each bin that they, widened, touch."""
    first, last = F.floor((F.col("start") - wider) / reach), F.floor((F.col("end") - 1 + wider) / reach)
    return parts.withColumn("bin", F.explode(F.sequence(first, last)))


def near(parts: DataFrame, others: DataFrame, reach: int, how: str, lower_kind: bool = False) -> DataFrame:
    """Parts with (left_semi) or without (left_anti) another within reach in their scope; a reach of 0 is an overlap."""
    width = reach or REACH
    a, b = in_bins(parts, width).alias("a"), in_bins(others, width, reach).alias("b")
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("name", "scope", "bin")]
    meets = (F.col("a.start") < F.col("b.end") + reach) & (F.col("b.start") - reach < F.col("a.end"))
    if lower_kind:
        meets &= F.col("b.k") < F.col("a.k")
    hit = a.join(b, [*same, meets], "left_semi").select("name", "scope", "k", "start", "end").distinct()
    return hit if how == "left_semi" else parts.join(hit, ["name", "scope", "k", "start", "end"], "left_anti")


def linked(open_: DataFrame, reach: int = REACH) -> DataFrame:
    """name, more: of each distinct text (name, parts) the weak parts that are reported, by start; texts without any are left out."""
    each = open_.dropDuplicates(["name"]).select("name", F.explode("parts").alias("p")).select("name", "p.*")
    running = F.expr(f"count_if(k = {BORDER}) over (partition by name order by start, k desc rows between unbounded preceding and current row)")
    parts = each.withColumn("scope", running).where(F.col("k") < BORDER)
    parts = materialize(parts, "credential-parts")
    of = lambda kinds: parts.where(F.col("k").isin(*kinds))
    # what overlaps a part of an earlier kind is that part's
    weak = near(of((ID, KEY, ENDPOINT)), parts, 0, "left_anti", lower_kind=True)
    weak = materialize(weak, "credential-weak")
    strong = of(BASE)
    among = lambda kinds: strong.where(F.col("k").isin(*kinds)).unionByName(weak.where(F.col("k").isin(*kinds)))
    only = lambda k: weak.where(F.col("k") == k)
    ids, secrets = among(IDENTIFIERS), among(SECRETS)
    reported = near(only(ID), secrets, reach, "left_semi").unionByName(near(only(KEY), ids, reach, "left_semi")).unionByName(near(near(only(ENDPOINT), ids, reach, "left_semi"), secrets, reach, "left_semi"))
    return reported.groupBy("name").agg(F.array_sort(F.collect_list(F.struct(F.col("start"), F.col("k"), F.col("end")))).alias("more"))


def detect(docs: DataFrame, *, keep: list[str] | None = None, reach: int = REACH) -> DataFrame:
    """row_ (struct of the columns in `keep`, all by default), base and spans (array<struct<start, k, end>>, base ones included), by start and kind.

    A null text is empty and has no spans. Repeated rows are searched alike, equal texts linked once; empty tables give no rows;
    columns of any other name are kept inside `row_`. Of weak parts that overlap, or that overlap a base span, the earlier kind's stays
    (KINDS); base spans always stay. What is collected is the parts of one text.
    """
    all_ = materialize(scanned(docs, docs.columns if keep is None else keep), "credential-scan")
    alone = all_.where("name is null").select("row_", "base", F.col("base").alias("spans"))
    open_ = all_.where("name is not null")
    both = open_.select("row_", "base", "name").join(linked(open_.select("name", "parts"), reach), "name", "left")
    spans = F.when(F.col("more").isNull(), F.col("base")).otherwise(F.array_sort(F.concat("base", "more")))
    return alone.unionByName(both.select("row_", "base", spans.alias("spans")))


def named(spans: str) -> Column:
    return F.expr(f"array_join(transform({spans}, s -> concat(element_at(array({', '.join(repr(k) for k in KINDS)}), s.k + 1), ':', s.start, ':', s.end)), ',')")


def op12_scan_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect(table(spark, sf_dir, "documents"), keep=["doc_id"])
    counts = [F.expr(f"cast(size(filter(base, s -> s.k = {k})) as long)").alias(f"n_{KINDS[k]}") for k in BASE]
    return found.select(F.col("row_.doc_id").alias("doc_id"), *counts, F.sha2(named("base").cast("binary"), 256).alias("base_sha256"), named("spans").alias("spans"))


def _sql() -> str:
    quote = lambda t: t.replace("'", "''")
    valid = {"assign": f"length(regexp_extract(v, '{quote(PATTERNS['assign'])}', 2)) >= 8", "access": "length(v) >= 16", "key": "(regexp_matches(v, '[:=]') OR (regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')))"}
    kinds = [(i, k, PATTERNS[k]) for i, k in enumerate(KINDS)] + [(BORDER, "border", BREAK)]
    found = " UNION ALL ".join(f"SELECT * FROM (SELECT rid, {i} AS k, unnest(hits) AS v, unnest(range(len(hits))) AS j, hits, string_split_regex(t, '{quote(p)}') AS gaps FROM (SELECT rid, t, regexp_extract_all(t, '{quote(p)}') AS hits FROM d) WHERE len(hits) > 0) WHERE {valid.get(k, 'true')}" for i, k, p in kinds)
    close = f"o.rid = w.rid AND o.scope = w.scope AND w.s < o.e + {REACH} AND o.s - {REACH} < w.e"
    has = lambda ks: f"EXISTS (SELECT 1 FROM c o WHERE {close} AND o.k IN {ks})"
    names = "CASE k " + " ".join(f"WHEN {i} THEN '{k}'" for i, k in enumerate(KINDS)) + " END || ':' || s || ':' || e"
    return f"""WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents), f AS ({found}),
p AS (SELECT rid, k, s, s + length(v) AS e FROM (SELECT rid, k, v, CAST(list_sum(list_transform(gaps[1 : j + 1], lambda g: length(g))) + coalesce(list_sum(list_transform(hits[1 : j], lambda h: length(h))), 0) AS BIGINT) AS s FROM f)),
q AS (SELECT *, count(*) FILTER (k = {BORDER}) OVER (PARTITION BY rid ORDER BY s, k DESC ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS scope FROM p),
c AS (SELECT * FROM q w WHERE k < {BORDER} AND (k < {ID} OR NOT EXISTS (SELECT 1 FROM q o WHERE o.rid = w.rid AND o.k < w.k AND w.s < o.e AND o.s < w.e))),
r AS (SELECT * FROM c w WHERE k < {ID} OR (k = {ID} AND {has(SECRETS)}) OR (k = {KEY} AND {has(IDENTIFIERS)}) OR (k = {ENDPOINT} AND {has(SECRETS)} AND {has(IDENTIFIERS)})),
g AS (SELECT rid, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, coalesce(string_agg({names}, ',' ORDER BY s, k) FILTER (k < {ID}), '') AS base, string_agg({names}, ',' ORDER BY s, k) AS spans FROM r GROUP BY 1)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (rid)"""


OP12_SQL = _sql()
