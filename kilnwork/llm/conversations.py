"""Operator 11, conversation structure repair: a Spark SQL higher-order fold.

Turns are put in order by one range partitioning and cut into chunks of a bounded number of rows, so a conversation of any
length is spread. Windows tell which turn says something for the first time. A chunk's turns are collected without their texts
and folded by aggregate(), which carries four structs (cost, audit), one for each state of the grammar (nothing yet, after a
system turn, after the user, after the assistant), through least(). A conversation's first chunk starts in the first state; later ones
are folded from each of the four, and a second fold joins the chunks' results. Least structs are exact ones: an edit's letter
settles its cost, so of two audits with equal costs that lead to the same state none begins the other, and what is least stays least
whatever follows.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .base import WORD, materialize, release, returning, table

#: log2 of the rows of a chunk.
CHUNK_BITS = 7
#: The costs of an edit, and of a truncated turn that stays.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
STATES = ("e", "s", "u", "a")
BLANKS = " \t\n\x0b\x0c\r"
PATH = "struct<c:bigint,t:string>"


def damage(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text, copies: the damaged turns, those that were dropped with no copies."""
    blank = F.lit(" ")
    kind = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary")) % 20
    role, text = F.coalesce("role", blank), F.coalesce("text", blank)
    return turns.select(
        "conv_id", "turn", F.when(kind == 4, "user").otherwise(role).alias("role"),
        F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text).alias("text"), F.when(kind == 0, 0).when(kind == 3, 2).otherwise(1).cast("long").alias("copies"),
    )


def ordered(turns: DataFrame) -> DataFrame:
    """The turns in their order, each distinct one once: `at` grows with (conv_id, turn, role, text), nulls first."""
    counted = turns.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("n"))
    keys = [F.asc_nulls_first(c) for c in ("conv_id", "turn", "role", "text")]
    ranged = counted.repartitionByRange(*keys).sortWithinPartitions(*keys)
    says = F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), "role", "text").cast("binary"), 256)
    last = F.substring(F.rtrim("text", F.lit(BLANKS)), -1, 1)
    return ranged.select(
        "*", F.monotonically_increasing_id().alias("at"), says.alias("says"), F.substring("role", 1, 1).alias("initial"),
        (~F.col("text").rlike(WORD)).alias("blank"), (~last.isin(".", "!", "?")).alias("truncated"),
    )


def path(cost, audit) -> Column:
    return F.struct(cost.cast("long").alias("c"), audit.alias("t"))


def further(p: Column, cost: Column, letters: Column) -> Column:
    """A path with one more edit; none stays none."""
    return F.when(p.isNotNull(), path(p["c"] + cost, F.concat(p["t"], letters)))


def let(value: Column, f) -> Column:
    return F.get(F.transform(F.array(value), f), F.lit(0))


def inserted(m: Column) -> Column:
    """The states when turns may have been inserted: a user's turn goes anywhere but behind another one, an assistant's behind that."""
    ins = lambda p: further(p, F.lit(INSERT), F.lit("I"))
    user = F.least(m["u"], ins(m["e"]), ins(m["s"]), ins(m["a"]))
    return let(F.struct(m["e"].alias("e"), m["s"].alias("s"), user.alias("u"), m["a"].alias("a")), lambda k: F.struct(k["e"].alias("e"), k["s"].alias("s"), k["u"].alias("u"), F.least(k["a"], ins(k["u"])).alias("a")))


def edited(m: Column, x: Column) -> Column:
    """The states behind a turn. Its further copies are duplicates, which must go; audits are least with insertions behind them."""
    more = x["n"] - 1
    tail, rest = F.repeat(F.lit("D"), more.cast("int")), more * DELETE + F.when(x["truncated"], TRUNCATED).otherwise(0)
    free = ~x["blank"] & x["first"]
    gone = lambda p: further(p, x["n"] * DELETE, F.repeat(F.lit("D"), x["n"].cast("int")))
    kept = lambda p, initial: F.when(free & (x["initial"] == initial), further(p, rest, F.concat(F.lit("K"), tail)))
    recast = lambda p: F.when(free, further(p, rest + REROLE, F.concat(F.lit("R"), tail)))
    before = [m[s] for s in ("e", "s", "a")]
    return F.struct(
        gone(m["e"]).alias("e"), F.least(gone(m["s"]), kept(m["e"], "s")).alias("s"),
        F.least(gone(m["u"]), *(kept(p, "u") for p in before), *map(recast, before)).alias("u"), F.least(gone(m["a"]), kept(m["u"], "a"), recast(m["u"])).alias("a"),
    )


def nowhere() -> Column:
    return F.lit(None).cast(PATH)


def start(state: str) -> Column:
    return F.struct(*((path(F.lit(0), F.lit("")) if s == state else nowhere()).alias(s) for s in STATES))


def folded(rows: Column, state: str) -> Column:
    """The least path from one state to each, over a chunk's turns."""
    return F.aggregate(rows, start(state), lambda m, x: let(inserted(m), lambda k: edited(k, x)))


def illegal_pairs(rows: Column) -> Column:
    """How many neighbours inside a chunk must not follow each other, copies of one turn among them."""
    i = F.transform(rows, lambda x: x["initial"])
    pairs = F.zip_with(F.slice(i, 1, F.size(i) - 1), F.slice(i, 2, F.size(i)), lambda a, b: F.concat(a, b))
    return (F.size(F.filter(pairs, lambda p: ~p.isin("su", "ua", "au"))) + F.aggregate(rows, F.lit(0).cast("long"), lambda k, x: k + x["n"] - 1)).cast("long")


def chunked(live: DataFrame, chunk_bits: int) -> DataFrame:
    """conv_id, chunk, rows (in order, flagged), the chunk's counts, and `from_e` to `from_a`, its folds."""
    chunk = F.shiftright("at", chunk_bits).alias("chunk")
    light = live.select("conv_id", chunk, F.struct("at", "n", "initial", "blank", "truncated").alias("row"), F.lit(None).cast("long").alias("first"), F.lit(False).alias("opens"))
    # first in its chunk by an aggregate that maps combine, then first of all by a window over what is left
    said = live.groupBy("conv_id", "says", chunk).agg(F.min("at").alias("first"))
    rank = F.row_number().over(Window.partitionBy("conv_id", "says").orderBy("first"))
    firsts = said.withColumn("r", rank).where("r = 1").select("conv_id", "chunk", F.lit(None).cast(light.schema["row"].dataType).alias("row"), "first", F.lit(False).alias("opens"))
    opening = live.groupBy("conv_id").agg(F.min("at").alias("first"))
    opening = opening.select("conv_id", F.shiftright("first", chunk_bits).alias("chunk"), F.lit(None).cast(light.schema["row"].dataType).alias("row"), F.lit(None).cast("long").alias("first"), F.lit(True).alias("opens"))
    got = light.unionByName(firsts).unionByName(opening).groupBy("conv_id", "chunk").agg(F.array_sort(F.collect_list("row")).alias("rows"), F.collect_list("first").alias("firsts"), F.max("opens").alias("opens"))
    flagged = got.select("conv_id", "chunk", "opens", F.transform("rows", lambda x: x.withField("first", F.array_contains("firsts", x["at"]))).alias("rows"))
    count = lambda f: F.aggregate("rows", F.lit(0).cast("long"), lambda k, x: k + f(x))
    free = lambda x: ~x["blank"] & x["first"]
    return flagged.select(
        "*", count(lambda x: F.when(x["blank"], x["n"]).otherwise(0)).alias("blank"), count(lambda x: F.when(x["blank"], 0).when(x["first"], x["n"] - 1).otherwise(x["n"])).alias("duplicate"),
        count(lambda x: (free(x) & x["truncated"]).cast("long")).alias("truncated"), illegal_pairs(F.col("rows")).alias("illegal"), F.get("rows", F.lit(0))["initial"].alias("head"), F.element_at("rows", -1)["initial"].alias("tail"),
        folded(F.col("rows"), "e").alias("from_e"), *(F.when(~F.col("opens"), folded(F.col("rows"), s)).alias(f"from_{s}") for s in STATES[1:]),
    )


def joined(chunks: DataFrame) -> DataFrame:
    """A row per conversation: its counts, cost and audit, `pieces` (chunk, the state before it, its part of the audit) and `closing` insertions."""
    got = chunks.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("chunk", "blank", "duplicate", "truncated", "illegal", "head", "tail", *(f"from_{s}" for s in STATES)))).alias("all"))
    # `by`: the state before each chunk so far, one letter each; costs and audits differ before it could decide
    none = F.lit(None).cast("struct<c:bigint,t:string,by:string>")
    zero = F.struct(*((F.struct(F.lit(0).cast("long").alias("c"), F.lit("").alias("t"), F.lit("").alias("by")) if s == "e" else none).alias(s) for s in STATES))

    def step(m: Column, x: Column) -> Column:
        def to(t: str) -> Column:
            through = [F.when(m[s].isNotNull() & x[f"from_{s}"][t].isNotNull(), F.struct((m[s]["c"] + x[f"from_{s}"][t]["c"]).alias("c"), F.concat(m[s]["t"], x[f"from_{s}"][t]["t"]).alias("t"), F.concat(m[s]["by"], F.lit(s)).alias("by"))) for s in STATES]
            return F.least(*through).alias(t)

        return F.struct(*map(to, STATES))

    ins = lambda p, k: F.when(p.isNotNull(), F.struct((p["c"] + k * INSERT).alias("c"), F.concat(p["t"], F.lit("I" * k)).alias("t"), p["by"].alias("by"), F.lit(k).alias("k")))
    ends = lambda m: F.least(*(ins(m[s], k).withField("last", F.lit(s)) for s, k in (("e", 0), ("s", 2), ("u", 1), ("a", 0))))
    # a column of its own, so that the fold is made once
    end = got.withColumn("reached", F.aggregate("all", zero, step)).withColumn("end", ends(F.col("reached")))
    states = F.split(F.concat("end.by", "end.last"), "")
    piece = lambda x, i: F.coalesce(*(F.when((F.get(F.col("states"), i) == s) & (F.get(F.col("states"), i + 1) == t), x[f"from_{s}"][t]["t"]) for s in STATES for t in STATES))
    pieces = F.transform("all", lambda x, i: F.struct(x["chunk"].alias("chunk"), F.get(F.col("states"), i).alias("state"), piece(x, i).alias("audit")))
    total = lambda name: F.aggregate("all", F.lit(0).cast("long"), lambda k, x: k + x[name])
    n = F.size("all")
    borders = F.zip_with(F.slice("all", 1, n - 1), F.slice("all", 2, n), lambda a, b: (~F.concat(a["tail"], b["head"]).isin("su", "ua", "au")).cast("long"))
    return end.withColumn("states", states).select(
        "conv_id", *(total(c).alias(c) for c in ("blank", "duplicate", "truncated")), (total("illegal") + F.aggregate(borders, F.lit(0).cast("long"), lambda k, x: k + x)).alias("illegal"),
        F.col("end.c").alias("cost"), F.col("end.t").alias("audit"), pieces.alias("pieces"), F.struct(F.col("end.k").alias("k"), F.col("end.last").alias("last")).alias("closing"),
    )


def turns_of(last: Column, k: Column | int) -> Column:
    """Roles of k turns inserted behind a turn of this initial: they alternate."""
    k = F.lit(k) if isinstance(k, int) else k
    both = F.when(last == "u", F.array(F.lit("assistant"), F.lit("user"))).otherwise(F.array(F.lit("user"), F.lit("assistant")))
    return F.slice(both, 1, k)


def edits(chunks: DataFrame, found: DataFrame) -> DataFrame:
    """conv_id, at, k, role (null: its own), kept: what stays of the turns and what is inserted, in the order (at, k)."""
    pieces = found.select("conv_id", F.explode("pieces").alias("p")).select(F.col("conv_id").alias("c_"), F.col("p.chunk").alias("k_"), F.when(F.col("p.state") == "e", "").otherwise(F.col("p.state")).alias("state"), F.col("p.audit").alias("audit"))
    both = chunks.select("conv_id", "chunk", "rows").join(pieces, F.col("conv_id").eqNullSafe(F.col("c_")) & (F.col("chunk") == F.col("k_"))).drop("c_", "k_")
    out = "array<struct<at:bigint,k:int,role:string,kept:boolean>>"
    zero = F.struct(F.lit(1).alias("place"), F.col("state").alias("last"), F.lit(None).cast(out).alias("out"))
    zero = zero.withField("out", F.expr(f"cast(array() as {out})"))

    def step(acc: Column, x: Column) -> Column:
        ahead = F.substring(F.col("audit"), acc["place"], F.lit(3))
        k = F.length(F.regexp_extract(ahead, "^I*", 0))
        letter = F.substring(ahead, k + 1, F.lit(1))
        return let(F.struct(k.alias("k"), letter.alias("letter"), turns_of(acc["last"], k).alias("new")), lambda v: behind(acc, x, v))

    def behind(acc: Column, x: Column, v: Column) -> Column:
        before = F.when(v["k"] > 0, F.substring(F.element_at(v["new"], -1), 1, 1)).otherwise(acc["last"])
        role = F.when(v["letter"] == "R", F.when(before == "u", "assistant").otherwise("user"))
        item = lambda k, r, kept: F.struct(x["at"].alias("at"), k.cast("int").alias("k"), r.alias("role"), kept.alias("kept"))
        own = F.when(v["letter"] == "D", F.expr(f"cast(array() as {out})")).otherwise(F.array(item(F.lit(2), role, F.lit(True))))
        new = F.transform(v["new"], lambda r, i: item(i, r, F.lit(False)))
        last = F.when(v["letter"] == "D", before).when(v["letter"] == "R", F.substring(role, 1, 1)).otherwise(x["initial"])
        return F.struct((acc["place"] + v["k"] + x["n"].cast("int")).alias("place"), last.alias("last"), F.concat(acc["out"], new, own).alias("out"))

    inside = both.select("conv_id", F.explode(F.aggregate("rows", zero, step)["out"]).alias("x")).select("conv_id", "x.*")
    behind_all = found.where("closing.k > 0").select("conv_id", F.posexplode(turns_of(F.col("closing.last"), F.col("closing.k"))))
    return inside.unionByName(behind_all.select("conv_id", F.lit((1 << 63) - 1).alias("at"), F.col("pos").alias("k"), F.col("col").alias("role"), F.lit(False).alias("kept")))


def repair(turns: DataFrame, *, chunk_bits: int = CHUNK_BITS, name: str = "conversations") -> tuple[DataFrame, DataFrame]:
    """(conversations, repaired turns) of `turns` (conv_id, turn, role, text, copies).

    Conversations: conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, for every conv_id, a null one among them;
    zeros and an empty audit where no turn has a copy. Repaired turns: conv_id, at, k, role, text, in the order (at, k). Roles and texts must not be null; null turns come first. Turns
    of one number are ordered by role, then text (bytes); equal rows are copies of each other. Other columns are ignored, empty
    tables give empty ones. An audit is one string, and a conversation's chunks meet in one task as audits without texts. Gaps that pass 64 bits are null.
    """
    all_ = materialize(ordered(turns), f"{name}-ordered")
    live = all_.where("n > 0")
    real = lambda c: F.when(F.col("n") > 0, F.col(c))
    spans = all_.groupBy("conv_id").agg(F.min(real("turn")).alias("lo"), F.max(real("turn")).alias("hi"), F.count_distinct(real("turn")).alias("d"))
    gaps = F.coalesce(F.when(F.col("d") == 0, 0), F.expr("try_cast(cast(hi as decimal(20, 0)) - lo + 1 - d as bigint)")).alias("gaps")
    chunks = materialize(chunked(live, chunk_bits), f"{name}-chunks")
    found = materialize(joined(chunks), f"{name}-found")
    both = spans.select("conv_id", gaps).join(found.withColumnRenamed("conv_id", "c_"), F.col("conv_id").eqNullSafe(F.col("c_")), "left")
    counts = [F.coalesce(c, F.lit(0)).alias(c) for c in ("blank", "duplicate", "truncated", "illegal", "cost")]
    conversations = both.select("conv_id", "gaps", *counts, F.coalesce("audit", F.lit("")).alias("audit"))
    done = materialize(edits(chunks, found), f"{name}-edits")
    release(chunks)
    own = done.where("kept").join(live.select("at", F.col("role").alias("own"), "text"), "at").select("conv_id", "at", "k", F.coalesce("role", "own").alias("role"), "text")
    return conversations, own.unionByName(done.where("not kept").select("conv_id", "at", "k", "role", F.lit("").alias("text")))


def digests(repaired: DataFrame) -> DataFrame:
    """conv_id, sha256 of the repaired turns as `role:text`, joined by newlines: turns stream through a task in their order, so none holds a
    conversation's text (the digest of one text is a sequence, whatever computes it)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        done, at, sha = [], None, None
        for b in returning(batches):
            for conv, role, text in zip(*(b.column(c).to_pylist() for c in ("conv_id", "role", "text"))):
                if sha is None or conv != at:
                    if sha is not None:
                        done.append((at, sha.hexdigest()))
                    at, sha = conv, hashlib.sha256()
                else:
                    sha.update(b"\n")
                sha.update(f"{role}:{text}".encode("utf-8", "surrogatepass"))
            if done:
                yield pa.record_batch([pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done])], ["conv_id", "repaired_sha256"])
                done = []
        if sha is not None:
            yield pa.record_batch([pa.array([at], pa.int64()), pa.array([sha.hexdigest()])], ["conv_id", "repaired_sha256"])

    in_order = repaired.repartition("conv_id").sortWithinPartitions("conv_id", "at", "k")
    return in_order.select(F.col("conv_id").cast("long"), "role", "text").mapInArrow(run, "conv_id long, repaired_sha256 string")


OP11_SQL = rf"""WITH RECURSIVE bits(i, v, k) AS (SELECT i, i, 0 FROM range(256) r(i) UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(v ORDER BY i) AS t FROM bits WHERE k = 8),
src AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS name FROM conversations),
k AS (SELECT src.*, xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(name, ''), lambda x: ascii(x)::BIGINT), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS k FROM src, crc),
d AS (SELECT conv_id, turn, CASE WHEN k = 4 THEN 'user' ELSE role END AS role, CASE k WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE k WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS copy FROM k),
n1 AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS i FROM d),
o AS (SELECT *, left(role, 1) AS ini, NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS seen,
  NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*$') AS open, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY i) AS prev FROM n1),
ins(st, mid, ic, il, ib) AS (VALUES ('e', 'e', 0, '', ''), ('s', 's', 0, '', ''), ('u', 'u', 0, '', ''), ('a', 'a', 0, '', ''), ('e', 'u', 5, 'I', 'user:'), ('s', 'u', 5, 'I', 'user:'), ('a', 'u', 5, 'I', 'user:'), ('u', 'a', 5, 'I', 'assistant:'), ('e', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:'), ('s', 'a', 10, 'II', 'user:' || chr(10) || 'assistant:')),
ed(mid, l, need, nst, ec, nrole) AS (VALUES ('e', 'D', NULL, 'e', 2, NULL), ('s', 'D', NULL, 's', 2, NULL), ('u', 'D', NULL, 'u', 2, NULL), ('a', 'D', NULL, 'a', 2, NULL), ('e', 'K', 's', 's', 0, NULL), ('e', 'K', 'u', 'u', 0, NULL), ('s', 'K', 'u', 'u', 0, NULL), ('a', 'K', 'u', 'u', 0, NULL), ('u', 'K', 'a', 'a', 0, NULL), ('e', 'R', NULL, 'u', 1, 'user'), ('s', 'R', NULL, 'u', 1, 'user'), ('a', 'R', NULL, 'u', 1, 'user'), ('u', 'R', NULL, 'a', 1, 'assistant')),
ids AS (SELECT DISTINCT conv_id FROM conversations),
f(conv_id, i, st, c, t, b) AS (SELECT conv_id, 0::BIGINT, 'e', 0::BIGINT, '', '' FROM ids
 UNION ALL SELECT conv_id, i, nst, c, t, b FROM (
  SELECT f.conv_id, o.i, nst, f.c + ic + ec + CASE WHEN l <> 'D' AND o.open THEN 5 ELSE 0 END AS c, f.t || il || l AS t, concat_ws(chr(10), nullif(f.b, ''), nullif(ib, ''), CASE WHEN l <> 'D' THEN coalesce(nrole, o.role) || ':' || o.text END) AS b
  FROM f JOIN o ON f.conv_id IS NOT DISTINCT FROM o.conv_id AND o.i = f.i + 1 JOIN ins USING (st) JOIN ed USING (mid) WHERE (l = 'D' OR NOT (o.blank OR o.seen)) AND (need IS NULL OR need = o.ini)) z
 QUALIFY row_number() OVER (PARTITION BY conv_id, nst ORDER BY c, t) = 1),
n AS (SELECT ids.conv_id, count(o.i) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (seen AND NOT blank) AS duplicate, count(*) FILTER (open AND NOT blank AND NOT seen) AS truncated,
  count(*) FILTER (prev || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM ids LEFT JOIN o ON ids.conv_id IS NOT DISTINCT FROM o.conv_id GROUP BY 1),
done AS (SELECT f.conv_id, c + ic AS cost, t || il AS audit, concat_ws(chr(10), nullif(b, ''), nullif(ib, '')) AS b FROM f JOIN n ON f.conv_id IS NOT DISTINCT FROM n.conv_id AND f.i = n.n JOIN ins USING (st) WHERE mid IN ('e', 'a')
 QUALIFY row_number() OVER (PARTITION BY f.conv_id ORDER BY cost, audit) = 1)
SELECT n.conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, sha256(b) AS repaired_sha256 FROM n JOIN done ON n.conv_id IS NOT DISTINCT FROM done.conv_id""".replace("\\\\", "\\")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, repaired = repair(damage(table(spark, sf_dir, "conversations")))
    sums = digests(repaired).withColumnRenamed("conv_id", "c_")
    both = found.join(sums, F.col("conv_id").eqNullSafe(F.col("c_")), "left").drop("c_")
    return both.withColumn("repaired_sha256", F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())))
