"""Conversation repair against a plain dynamic programme over (cost, letters)."""

import hashlib
import random
import zlib

import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType, StructField, StructType

from tabulon.llm import conversations, queries

SCHEMA = StructType([StructField("conv_id", LongType()), StructField("turn", LongType()),
                     StructField("role", StringType()), StructField("text", StringType())])
SPACE = " \t\n\x0b\x0c\r"
TO = {"n": "u", "s": "u", "u": "a", "a": "u"}  # roles written so far: none, s, u, a


def slow_audit(kinds):
    """Least (cost, letters) for rows given as (initial, must go, truncated)."""
    best = {"n": (0, "")}

    def better(table, state, value):
        if state not in table or value < table[state]:
            table[state] = value

    def with_inserts(table):
        for _ in range(4):
            for state, (cost, letters) in list(table.items()):
                better(table, TO[state], (cost + 5, letters + "I"))
        return table

    for initial, gone, cut in kinds:
        after = {}
        for state, (cost, letters) in with_inserts(best).items():
            better(after, state, (cost + 2, letters + "D"))
            if not gone:
                if initial == TO[state] or (initial == "s" and state == "n"):
                    better(after, initial, (cost + 5 * cut, letters + "K"))
                better(after, TO[state], (cost + 1 + 5 * cut, letters + "R"))
        best = after
    return min(v for k, v in with_inserts(best).items() if k in "na")


def slow_row(conv, rows):
    """Result for one conversation's (turn, role, text) rows after damage."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2]))
    seen, kinds, counts = set(), [], dict.fromkeys(("blank", "duplicate", "truncated"), 0)
    for _, role, text in rows:
        bare = text.strip(SPACE)
        fault = "blank" if not bare else "duplicate" if (role, text) in seen else "truncated" if bare[-1] not in ".!?" else None
        seen.add((role, text))
        if fault:
            counts[fault] += 1
        kinds.append((role[:1], fault in ("blank", "duplicate"), fault == "truncated"))
    cost, audit = slow_audit(kinds)
    lines, state, queue = [], "n", list(rows)
    for letter in audit:
        if letter == "I":
            state = TO[state]
            lines.append({"u": "user:", "a": "assistant:"}[state])
            continue
        _, role, text = queue.pop(0)
        if letter != "D":
            state = role[:1] if letter == "K" else TO[state]
            lines.append(f"{role if letter == 'K' else {'u': 'user', 'a': 'assistant'}[state]}:{text}")
    turns = {t for t, *_ in rows if t is not None}
    return (conv, max(turns) - min(turns) + 1 - len(turns) if turns else 0, *counts.values(),
            sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:])), cost, audit,
            hashlib.sha256("\n".join(lines).encode()).hexdigest())


def slow_damage(rows):
    """conv: rows after damage, for every original conv."""
    out = {}
    for conv, turn, role, text in rows:
        mine = out.setdefault(conv, [])
        role, text = (" " if v is None else v for v in (role, text))
        draw = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if draw == 1:
            text = ""
        if draw == 2:
            text = text.translate(str.maketrans("", "", ".!?"))
        if draw == 4:
            role = "user"
        mine += [(turn, role, text)] * (0 if draw == 0 else 2 if draw == 3 else 1)
    return out


def slow(rows):
    return sorted((slow_row(c, r) for c, r in slow_damage(rows).items()), key=repr)


def got(df):
    return sorted(map(tuple, df.collect()), key=repr)


def invented(seed, conversations_, most):
    choose = random.Random(seed)
    for conv in range(conversations_):
        for turn in range(choose.randint(1, most)):
            text = choose.choice(["Yes.", "No!", "Cut off", "", " \t", f"Text {choose.randint(0, 30)}.", None])
            yield conv, choose.choice([turn, turn, turn + 3, None]), choose.choice(
                ["user", "assistant", "user", "assistant", "system", "tool", "", None, "umpire"]), text


@pytest.mark.parametrize("base", ["/root/testdata/sf0.001", "/root/testdata/sf0.01"])
def test_query_equals_slow_version(spark, base):
    rows = pq.read_table(f"{base}/conversations.parquet").to_pylist()
    assert got(queries.op11_conversations(spark, base)) == slow([tuple(r[n] for n in SCHEMA.names) for r in rows])


@pytest.mark.parametrize("sizes", [{}, {"run": 4, "chunk_bits": 4, "fan_bits": 1}, {"run": 64, "chunk_bits": 6, "fan_bits": 2}])
def test_any_cut_gives_the_same(spark, sizes):
    rows = list(invented(3, 25, 12)) + [(99, t, r, x) for _, t, r, x in invented(4, 1, 9000)] + list(invented(5, 3, 300))
    rows += [(None, *rows[0][1:])] * 3 + [(77, None, None, None), (78, 1, "user", "long " * 100_000 + ".")]
    df = spark.createDataFrame(rows, SCHEMA).withColumn("who", F.lit("x")).withColumn("pos", F.lit(None)).repartition(5)
    assert got(conversations.audited(conversations.damaged(df), "present", **sizes)) == slow(rows)


def test_repaired_rows_are_what_the_checksum_holds(spark):
    rows = list(invented(8, 30, 20))
    df = spark.createDataFrame(rows, SCHEMA)
    lines = {}
    for conv, place, role, text, edit in sorted(map(tuple, conversations.repaired(df, run=4, chunk_bits=4).collect())):
        assert place == len(lines.setdefault(conv, [])) and edit in "KRI"
        lines[conv].append(f"{role}:{text}")
    for row in conversations.audited(df).collect():
        joined = "\n".join(lines.get(row.conv_id, []))
        assert row.repaired_sha256 == hashlib.sha256(joined.encode()).hexdigest()
        roles = "".join(line[0] for line in lines.get(row.conv_id, []))
        assert roles.removeprefix("s").replace("ua", "") == "" and roles != "s"


def test_no_rows(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert conversations.audited(conversations.damaged(empty), "present").count() == 0
    # conv 0, turn 6 is dropped: the conversation stays, with nothing in it
    gone = next(t for t in range(1000) if zlib.crc32(f"0:{t}".encode()) % 20 == 0)
    alone = spark.createDataFrame([(0, gone, "user", "Hello.")], SCHEMA)
    assert got(conversations.audited(conversations.damaged(alone), "present")) == [
        (0, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_auction_prices_are_distances():
    choose = random.Random(1)
    for _ in range(200):
        cells = "".join(choose.choice("suaxdSUAX") for _ in range(choose.randint(1, 12)))
        ends = conversations.closing_costs()
        letters, last, costs = conversations.traced(cells, ends, range(1))
        expected = slow_audit([(c.lower(), c == "d", c.isupper()) for c in cells])
        assert (costs[0] + ends[last[0]], letters[0] + conversations.CLOSING[last[0]]) == expected
