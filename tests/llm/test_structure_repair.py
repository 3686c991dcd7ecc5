"""op12 against a uniform-cost search over (cost, audit) written from the contract alone."""
import hashlib
import heapq
import random
import re
import zlib

import pytest

from voxtable.llm import structure_repair as repair_module


def damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = (" " if x is None else x for x in (role, text))
        k = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        text = "" if k == 1 else re.sub("[.!?]", "", text) if k == 2 else text
        role = "user" if k == 4 else role
        out += [] if k == 0 else [(conv, turn, role, text)] * (2 if k == 3 else 1)
    return sorted(out, key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), r[3].encode()))


def fault(rows, i):
    _, _, role, text = rows[i]
    bare = text.strip(" \t\n\x0b\x0c\r")
    if not bare:
        return "blank"
    if any(r[2:] == (role, text) for r in rows[:i]):
        return "duplicate"
    return "" if bare[-1] in ".!?" else "truncated"


def cheapest(rows, faults):
    """(cost, audit, repaired) by uniform-cost search; roles are rebuilt from their place."""
    def ends(s):
        return s in ("", "a")

    follow = {"": "su", "s": "u", "u": "a", "a": "u"}
    put = {"": "u", "s": "u", "u": "a", "a": "u"}
    heap, done = [(0, "", 0, "", ())], set()
    while heap:
        g, audit, j, s, made = heapq.heappop(heap)
        if j == len(rows) and ends(s):
            return g, audit, made
        if (audit, j, s) in done or audit.endswith("III"):
            continue
        done.add((audit, j, s))
        name = {"u": "user", "a": "assistant"}[put[s]]
        heapq.heappush(heap, (g + 3, audit + "I", j, put[s], (*made, (name, ""))))
        if j < len(rows):
            role, text = rows[j][2:]
            heapq.heappush(heap, (g + 4, audit + "D", j + 1, s, made))
            if faults[j] not in ("blank", "duplicate"):
                more = 3 * (faults[j] == "truncated")
                heapq.heappush(heap, (g + 3 + more, audit + "R", j + 1, put[s], (*made, (name, text))))
                if role[:1] and role[:1] in follow[s]:
                    heapq.heappush(heap, (g + more, audit + "K", j + 1, role[:1], (*made, (role, text))))


def expected(rows):
    rows = damage(rows)
    faults = [fault(rows, i) for i in range(len(rows))]
    initials = [r[2][:1] for r in rows]
    turns = {r[1] for r in rows if r[1] is not None}
    cost, audit, made = cheapest(rows, faults)
    return (max(turns) - min(turns) + 1 - len(turns) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(f"{r}:{t}" for r, t in made).encode()).hexdigest())


def random_rows(r, convs):
    rows = []
    for conv in convs:
        for turn in range(r.randint(1, 6)):
            role = r.choice(["user", "assistant", "user", "assistant", "system", "tool", None, ""])
            rows.append((conv, r.choice([turn, turn, turn, 2, None, turn + 40]), role, r.choice(["A.", "B!", "C", "A.", "  ", None, "é?\n", "long " * 9])))
    r.shuffle(rows)
    return rows


@pytest.mark.parametrize("piece", [128, 1, 2])
def test_query_against_search(spark, piece):
    r = random.Random(piece)
    rows = random_rows(r, [None, *range(1, 220)])
    df = repair_module.damaged(spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(3))
    got = {x.conv_id: tuple(x)[1:] for x in repair_module.report(repair_module.repair(df, piece)).collect()}
    convs = {x[0] for x in rows}
    assert set(got) == convs
    for c in convs:
        assert got[c] == expected([x for x in rows if x[0] == c]), c


def test_one_conversation_over_many_partitions(spark):
    """The pieces of a long conversation give what a single search gives, and the turns come out in order."""
    r = random.Random(5)
    rows = [(7, t, r.choice(["user", "assistant"]) if r.random() < .3 else ["user", "assistant"][t % 2], r.choice([f"Text {t}.", f"Text {t}", "Same."])) for t in range(1500)]
    rows += [(7, 900, "user", "Again and again.")] * 500 + [(8, 0, "user", "Hi."), (8, 1, "assistant", "Yes.")]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string").repartition(5)
    pieces = repair_module.repair(repair_module.damaged(df), 32)
    got = {x.conv_id: x for x in repair_module.report(pieces).collect()}
    mine = damage([x for x in rows if x[0] == 7])
    kinds = {"": 0, "truncated": 1, "duplicate": 2, "blank": 3}
    seen, packed = set(), []
    for i, (_, _, role, text) in enumerate(mine):
        bare = text.strip()
        f = "blank" if not bare else "duplicate" if (role, text) in seen else "" if bare[-1] in ".!?" else "truncated"
        seen.add((role, text))
        packed.append((role, text, kinds[f], 1))
    cost, audit, roles, texts = repair_module.mend(packed, 0, repair_module.END, True)
    assert (got[7].cost, got[7].audit) == (cost, audit)
    assert got[7].repaired_sha256 == hashlib.sha256("\n".join(f"{a}:{b}" for a, b in zip(roles, texts)).encode()).hexdigest()
    out = repair_module.turns(pieces).where("conv_id = 7").orderBy("part", "ord", "place").collect()
    assert [(x.role, x.text) for x in out] == list(zip(roles, texts))
    assert re.fullmatch("(s?(ua)+)?", "".join(x.role[0] for x in out))
