import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from tests.llm.conftest import sample
from versekit.llm import dialogue

ROWS = "conv_id long, turn long, role string, text string"


def plain(rows):
    """(cost, audit, roles) by recursion over (row, roles so far): every edit, no heaps."""
    @lru_cache(None)
    def best(i, state, inserted):
        found = []
        if i == len(rows):
            if state in ("", "a"):
                found.append((0, ""))
        else:
            row = rows[i]
            c, a = best(i + 1, state, 0)
            found.append((c + 3, "D" + a))
            if row[0] != "-":
                role, cut = row[0].lower(), row[0].isupper()
                for x, price in {(role, 0), ("u", 2), ("a", 2)}:
                    if (state, x) in ALLOWED:
                        c, a = best(i + 1, x, 0)
                        found.append((c + price + cut, ("R" if price else "K") + a))
        for x in "ua":
            if (state, x) in ALLOWED and inserted < 4:
                c, a = best(i, x, inserted + 1)
                found.append((c + 2, "I" + a))
        return min(found, default=(10 ** 9, ""))

    return best(0, "", 0)


ALLOWED = {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}


@pytest.mark.parametrize("stretch", [1, 2, 3, 7, 1024])
def test_least_audits(stretch):
    rng = random.Random(stretch)
    for k in range(1500):
        rows = "".join(rng.choices("uasxUASX-", [5, 5, 2, 1, 2, 2, 1, 1, 2], k=rng.randrange(0, 14)))
        assert dialogue.repair(rows, stretch) == plain(rows), rows


def test_long_conversations():
    rng = random.Random(4)
    for n in (65, 130, 300):
        rows = "".join(rng.choices("uaUAs-", k=n))
        assert dialogue.repair(rows, 1024) == dialogue.repair(rows, 64) == plain(rows)


def brute(rows):
    """The contract on plain lists: conv_id to its result."""
    by = {}
    for r in rows:
        key = "%s:%s" % tuple(" " if r[k] is None else r[k] for k in ("conv_id", "turn"))
        role, text = (" " if r[k] is None else r[k] for k in ("role", "text"))
        kind = zlib.crc32(key.encode()) % 20
        text = "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text
        role = "user" if kind == 4 else role
        by.setdefault(r["conv_id"], []).extend([(r["turn"], role, text)] * (0 if kind == 0 else 2 if kind == 3 else 1))
    out = {}
    for conv, own in by.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), r[2].encode()))
        seen, signs, n = set(), [], dict(blank=0, duplicate=0, truncated=0)
        for _, role, text in own:
            said = re.findall(r"[^\x20\x09-\x0D]", text)
            fault = "blank" if not said else "duplicate" if (role, text) in seen else "" if said[-1] in ".!?" else "truncated"
            seen.add((role, text))
            if fault:
                n[fault] += 1
            x = role[:1] if role[:1] in ("s", "u", "a") else "x"
            signs.append("-" if fault in ("blank", "duplicate") else x.upper() if fault else x)
        turns = [r[0] for r in own if r[0] is not None]
        cost, audit = plain("".join(signs))
        left, roles, i = [], "", 0
        for e in audit:
            give = "assistant" if roles[-1:] == "u" else "user"
            role, text = (give, "") if e == "I" else (give if e == "R" else own[i][1], own[i][2])
            i += e != "I"
            if e != "D":
                left.append(f"{role}:{text}")
                roles += role[0]
        assert re.fullmatch("(s?(ua)+)?", roles)
        out[conv] = dict(gaps=max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, **n,
                         illegal=sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(own, own[1:])),
                         cost=cost, audit=audit, repaired_sha256=hashlib.sha256("\n".join(left).encode()).hexdigest())
    return out


def found(df):
    rows = df.collect()
    out = {r["conv_id"]: {k: v for k, v in r.asDict().items() if k != "conv_id"} for r in rows}
    assert len(out) == len(rows)
    return out


def test_whole_table(spark):
    got = found(dialogue.repairs(dialogue.damage(spark.read.parquet("/root/testdata/sf0.01/conversations.parquet").repartition(5))))
    assert got == brute(sample("conversations"))


def test_hard_rows(spark, monkeypatch):
    rng = random.Random(1)
    rows = [dict(conv_id=c, turn=rng.choice([None, 0, 1, 2, 5, 9]), role=rng.choice(["user", "assistant", "system", "tool", "", None, "User"]),
                 text=rng.choice([None, "", " \t", "Yes.", "no", "What?  \n", "Yes.", "東京。", "a" * 70_000 + "!"])) for c in [None, *range(-3, 30)] for _ in range(rng.randrange(1, 9))]
    hot = [dict(conv_id=77, turn=i // 2, role=rng.choice(["user", "assistant"]), text=rng.choice(["Yes.", "no", f"t{i}.", f"t{i}"])) for i in range(700)]
    drop = [i for i in range(1000, 1200) if zlib.crc32(f"{i}:0".encode()) % 20 == 0][:3]
    rows += hot + [dict(conv_id=i, turn=0, role="user", text="Gone.") for i in drop] + [dict(hot[0]), dict(hot[0])]
    df = spark.createDataFrame([tuple(r.values()) for r in rows], ROWS).withColumns({"kind": F.lit("own"), "copies": F.lit(9), "gaps": F.lit(1), "place": F.lit(0)})
    monkeypatch.setattr(dialogue, "HELD_BYTES", 20_000)  # texts wait in the task's file
    expected = brute(rows)
    assert found(dialogue.repairs(dialogue.damage(df))) == expected
    assert expected[drop[0]] == dict(gaps=0, blank=0, duplicate=0, truncated=0, illegal=0, cost=0, audit="", repaired_sha256=hashlib.sha256(b"").hexdigest())
    left = {}
    for r in sorted(dialogue.repaired_rows(dialogue.damage(df)).collect(), key=lambda r: r["place"]):
        left.setdefault(r["conv_id"], []).append(f"{r['role']}:{r['text']}")
    for conv, e in expected.items():
        assert hashlib.sha256("\n".join(left.get(conv, [])).encode()).hexdigest() == e["repaired_sha256"]


def test_no_rows(spark):
    none = spark.createDataFrame([], ROWS)
    assert dialogue.repairs(dialogue.damage(none)).collect() == [] and dialogue.repaired_rows(none).collect() == []


def test_seen_keeps_all_digests():
    rng = random.Random(2)
    seen, known = dialogue.Seen(held=16), set()
    for _ in range(3000):
        d = rng.randrange(900).to_bytes(2, "big") * 8
        assert seen.again(d) == (d in known)
        known.add(d)
