"""Conversation repair against a forward search over whole audits."""
import hashlib
import random
import re
import zlib

import pytest

from varpack.llm import conversation_repair as repair

SF = "/root/testdata/sf0.001"
INK = re.compile(r"[^\x20\x09-\x0D]")
NAMES = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]


def damaged(rows):
    out = []
    for c, t, r, x in rows:
        r, x = (" " if v is None else v for v in (r, x))
        hit = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        x = "" if hit == 1 else re.sub("[.!?]", "", x) if hit == 2 else x
        out += [(c, t, "user" if hit == 4 else r, x)] * (0 if hit == 0 else 2 if hit == 3 else 1)
    return out


def cheapest(rows, faults):
    """(cost, audit, lines): all cheapest prefixes by grammar state, whole strings."""
    best = {"": (0, "", ())}                       # the state is the last initial

    def offer(to, state, entry):
        if state not in to or entry[:2] < to[state][:2]:
            to[state] = entry

    def spoken(state):
        return "assistant" if state == "u" else "user"

    def inserted(states):
        for _ in range(3):
            for state, (cost, audit, lines) in list(states.items()):
                offer(states, spoken(state)[0], (cost + 5, audit + "I", (*lines, spoken(state) + ":")))
        return states

    for (role, text), fault in zip(rows, faults):
        after, extra = {}, 5 * (fault == "truncated")
        for state, (cost, audit, lines) in inserted(best).items():
            offer(after, state, (cost + 2, audit + "D", lines))
            if fault not in ("blank", "duplicate"):
                if role and state + role[0] in ("s", "u", "su", "ua", "au"):
                    offer(after, role[:1], (cost + extra, audit + "K", (*lines, f"{role}:{text}")))
                offer(after, spoken(state)[0], (cost + 1 + extra, audit + "R", (*lines, f"{spoken(state)}:{text}")))
        best = after
    ends = [e for state, e in inserted(best).items() if state in ("", "a")]
    return min(ends, key=lambda e: e[:2])


def brute(rows, source=None):
    out = []
    for conv in dict.fromkeys(r[0] for r in (source or rows)):
        mine = sorted((r for r in rows if r[0] == conv), key=lambda r: (r[1] is not None, r[1] or 0, r[2], hashlib.md5(r[3].encode()).digest()))
        faults, seen = [], set()
        for _, _, role, text in mine:
            ink = INK.findall(text)
            faults.append("blank" if not ink else "duplicate" if (role, text) in seen else "truncated" if ink[-1] not in ".!?" else "")
            seen.add((role, text))
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = cheapest([r[2:] for r in mine], faults)
        illegal = sum(a[2][:1] + b[2][:1] not in ("su", "ua", "au") for a, b in zip(mine, mine[1:]))
        out.append((conv, max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *map(faults.count, ("blank", "duplicate", "truncated")), illegal,
                    cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=repr)


def rows_of(df):
    return sorted((tuple(r[n] for n in NAMES) for r in df.collect()), key=repr)


def made_up(seed, conversations, longest):
    r = random.Random(seed)
    rows = []
    for c in range(conversations):
        for t in range(r.randint(1, longest)):
            role = r.choice(["user", "assistant"] * 5 + ["system", "tool", "", "uncle", "Assistant"])
            rows.append((c, t + (t > 3) * r.randint(0, 2), role, r.choice(["a.", "b!", "c", "d?", " ", "", f"{t}.", f"{t}!", f"{t} é? \n", "e . x"])))
    return rows


ODD = [(900, None, "user", "no turn."), (900, None, "user", "no turn."), (900, 1, None, "x."), (900, 2, "user", None), (None, 1, "user", "hi."), (None, 2, "assistant", "ho."),
       (None, None, None, None), (901, 7, "system", "only."), (902, -5, "assistant", "first."), (902, 3, "user", "then."), (902, 3, "user", "then."), (902, 3, "assistant", "tie."),
       (903, 1, "user", "long " * 20000 + "."), (903, 2, "assistant", "\x0b. \x0c\t")]


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1) for r in rows], "conv_id long, turn long, role string, text string, audit string, at int").repartition(5)


@pytest.mark.parametrize("block", [1, 3, 1 << 16])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    rows = made_up(block, 60, 9) + ODD
    df = frame(spark, rows)
    got = repair.repair_conversations(df, repair.damage(df))
    assert rows_of(got) == brute(damaged(rows), rows)
    assert dict(got.dtypes) == {"conv_id": "bigint", "audit": "string", "repaired_sha256": "string", **{n: "bigint" for n in NAMES[1:7]}}


@pytest.mark.parametrize("block", [4, 50, 1 << 16])
def test_one_long_conversation_over_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(repair, "BLOCK", block)
    r = random.Random(3)
    rows = [(5, t, r.choice(["user", "assistant", "assistant", "system"]), r.choice([f"{t}.", f"{t}", "again.", f"{t}!"])) for t in range(400)]
    rows += [(4, 0, "user", "q?"), (4, 1, "assistant", "a."), (6, 0, "user", "q?")] + [(7, 1, "user", "same.")] * 30
    df = frame(spark, rows).withColumn("copies", repair.F.lit(1))
    got = repair.repair_conversations(df, df)
    assert rows_of(got) == brute(rows)


def test_dropped_whole_and_empty(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    df = frame(spark, [(gone, 0, "user", "x.")])
    assert rows_of(repair.repair_conversations(df, repair.damage(df))) == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256().hexdigest())]
    none = df.limit(0)
    assert repair.repair_conversations(none, repair.damage(none)).collect() == []


def test_lines_are_the_repaired_rows(spark):
    rows = [(1, 0, "user", "q?"), (1, 1, "user", "a."), (1, 2, "user", "cut"), (1, 3, "assistant", "end.")]
    df = frame(spark, rows).withColumn("copies", repair.F.lit(1))
    report, lines = repair.repair(df)
    assert [(r.cost, r.audit) for r in report.collect()] == [(4, "DKDK")]
    assert [(r.role, r.text) for r in lines.orderBy("at", "sub").collect()] == [("user", "a."), ("assistant", "end.")]


def test_query_against_brute_force(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(repair.query(spark, SF)) == brute(damaged(rows), rows)
