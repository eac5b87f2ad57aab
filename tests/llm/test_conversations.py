"""Conversation repair against DuckDB SQL and against a search over all edits."""

import functools
import hashlib
import random
import zlib

import duckdb
import pytest

from kilnwork.llm import conversations as C

SF = "/root/testdata/sf0.001"
TURNS = "conv_id long, turn long, role string, text string"
BLANKS = " \t\n\x0b\x0c\r"


def damaged(rows):
    for conv, turn, role, text in rows:
        name = lambda x: " " if x is None else str(x)
        kind, role, text = zlib.crc32(f"{name(conv)}:{name(turn)}".encode()) % 20, name(role), name(text)
        text = "" if kind == 1 else text.translate({ord(c): None for c in ".!?"}) if kind == 2 else text
        yield from [(conv, turn, "user" if kind == 4 else role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1)


def repaired(rows):
    """The figures of one conversation, by trying every edit from the end backwards."""
    rows = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))
    seen, faults = set(), []
    for _, _, role, text in rows:
        bare = text.rstrip(BLANKS)
        faults.append("blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((role, text))

    @functools.cache
    def best(i, state, room=3):
        found = [(0, "", ())] if i == len(rows) and state in "ea" else []
        add = lambda cost, letter, line, rest: rest and found.append((cost + rest[0], letter + rest[1], ((line,) if line else ()) + rest[2]))
        if room:
            new = "a" if state == "u" else "u"
            add(5, "I", {"u": "user:", "a": "assistant:"}[new], best(i, new, room - 1))
        if i < len(rows):
            _, _, role, text = rows[i]
            add(2, "D", "", best(i + 1, state))
            if faults[i] not in ("blank", "duplicate"):
                more = 5 * (faults[i] == "truncated")
                new = "a" if state == "u" else "u"
                if role[:1] == new or (role[:1] == "s" and state == "e"):
                    add(more, "K", f"{role}:{text}", best(i + 1, role[:1]))
                add(more + 1, "R", {"u": "user", "a": "assistant"}[new] + f":{text}", best(i + 1, new))
        return min(found) if found else None

    turns = [r[1] for r in rows if r[1] is not None]
    cost, audit, lines = best(0, "e")
    illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


def brute(rows):
    after, out = list(damaged(rows)), {}
    for conv in {r[0] for r in rows}:
        out[conv] = repaired([r for r in after if r[0] == conv])
    return out


FIGURES = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def of(spark, rows, tmp_path, **options):
    df = spark.createDataFrame([(*r, 1, 2) for r in rows], f"{TURNS}, n int, at int")
    found, lines = C.repair(C.damage(df), **options)
    sums = {r.conv_id: r.repaired_sha256 for r in C.digests(lines).collect()}
    return {r.conv_id: (*(r[f] for f in FIGURES[:-1]), sums.get(r.conv_id, hashlib.sha256(b"").hexdigest())) for r in found.collect()}


def odd_rows(seed=5):
    rng, rows = random.Random(seed), []
    for conv in [None, *range(40)]:
        for i in range(rng.choice([1, 2, 3, 5, 9, 14])):
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None, "Üser"])
            text = rng.choice(["Yes.", "No!", "And then", "", " \t", None, "Ends?\n", "é.", "x" * 50, "Yes."])
            rows.append((conv, rng.choice([i, i, i, None, 0, -3, i * 2]), role, text))
    return rows + rows[:7]


@pytest.mark.parametrize("bits", [0, 2, 7])
def test_repair_of_odd_conversations(spark, tmp_path, bits):
    """Nulls, blanks, ties, repeated rows and unknown roles, with chunks of one turn, of four and of many."""
    rows = odd_rows()
    assert of(spark, rows, tmp_path, chunk_bits=bits) == brute(rows)


def test_repair_of_a_long_conversation_and_of_none(spark, tmp_path):
    rng = random.Random(2)
    rows = [(1, i, rng.choice(["user", "assistant"]), rng.choice([f"Line {i}.", f"line {i}", "Same."])) for i in range(500)] + [(2, 7, "user", "Hi.")] * 300
    import sys

    old = sys.getrecursionlimit()
    sys.setrecursionlimit(20_000)
    try:
        want = brute(rows)
    finally:
        sys.setrecursionlimit(old)
    assert of(spark, rows, tmp_path, chunk_bits=4) == want
    assert of(spark, [], tmp_path) == {}


def test_repaired_turns_alternate(spark):
    _, lines = C.repair(C.damage(spark.createDataFrame(odd_rows(9), TURNS)), chunk_bits=2)
    by = {}
    for r in sorted(lines.collect(), key=lambda r: (str(r.conv_id), r.at, r.k)):
        by.setdefault(r.conv_id, []).append(r.role[:1])
    for roles in by.values():
        bare = "".join(roles).removeprefix("s")
        assert bare and bare == "ua" * (len(bare) // 2)


def test_query_against_sql(spark, tmp_path):
    rows = [r for r in odd_rows(3) if r[1] is None or abs(r[1]) < 10**6]
    spark.createDataFrame(rows, TURNS).write.parquet(f"{tmp_path}/conversations.parquet")
    for folder in (SF, str(tmp_path)):
        con = duckdb.connect()
        name = f"{folder}/conversations.parquet"
        con.execute(f"create view conversations as select * from read_parquet('{name if folder == SF else name + '/*.parquet'}')")
        got, want = C.op11_repair_conversations(spark, folder).toPandas(), con.execute(C.OP11_SQL).df()
        assert sorted(got.columns) == sorted(want.columns)
        key = lambda df: sorted(map(tuple, df[sorted(df.columns)].astype(str).to_numpy().tolist()))
        text = lambda df: df.assign(conv_id=df.conv_id.map(lambda x: "null" if x != x or x is None else str(int(x))))
        assert key(text(got)) == key(text(want))
