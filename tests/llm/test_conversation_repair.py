import hashlib
import itertools
import random
import re
from functools import cache

from pyspark.sql import functions as F

from veritable.llm import conversation_repair as cr

NEXT = {("0", "s"): "s", ("0", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}


def faults(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.strip(" \t\n\x0b\x0c\r")
        fault = "blank" if not shown else "duplicate" if (role, text) in seen else "truncated" if shown[-1] not in ".!?" else None
        seen.add((role, text))
        out.append(fault)
    return out


def plain(rows):
    """Least (cost, audit) from the end backwards, with whole strings; then the text of that audit."""
    marks = faults(rows)

    @cache
    def inserted(i, state, left):
        options = step(i, state) + ([(0, "")] if i == len(rows) and state in "0a" else [])
        if left:
            options += [(c + 3, "I" + t) for x in "ua" if (to := NEXT.get((state, x))) for c, t in [inserted(i, to, left - 1)]]
        return min(options, default=(10**9, ""))

    def step(i, state):
        if i == len(rows):
            return []
        (role, _), fault = rows[i], marks[i]
        c, t = inserted(i + 1, state, 3)
        out = [(c + 4, "D" + t)]
        if fault not in ("blank", "duplicate"):
            extra = 3 if fault else 0
            if role[:1] and (to := NEXT.get((state, role[:1]))):
                c, t = inserted(i + 1, to, 3)
                out.append((c + extra, "K" + t))
            for x in "ua":
                if to := NEXT.get((state, x)):
                    c, t = inserted(i + 1, to, 3)
                    out.append((c + extra + 3, "R" + t))
        return out

    cost, audit = inserted(0, "0", 3)
    left, state, i = [], "0", 0
    for op in audit:
        if op == "D":
            i += 1
            continue
        role, text = ("", "") if op == "I" else rows[i]
        i += op != "I"
        if op != "K":
            role = next({"u": "user", "a": "assistant"}[x] for x in "ua" if (state, x) in NEXT)
        state = NEXT[state, role[0]]
        left.append(f"{role}:{text}")
    illegal = sum((a[0][:1] + b[0][:1]) not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (*[marks.count(f) for f in ("blank", "duplicate", "truncated")], illegal, cost, audit, hashlib.sha256("\n".join(left).encode()).hexdigest())


def streamed(rows):
    out = cr._Summary(1)
    for i, ((role, text), fault) in enumerate(zip(rows, faults(rows))):
        out.turn(i, role, text, fault)
    return out.row()[2:]


def drawn(draw, n):
    roles = draw.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["assistant"], ["tool", " ", "user"], ["system"]])
    return [(draw.choice(roles), draw.choice(["Yes.", "No!", "so", "", " \n", f"t{draw.random()}.", f"c{draw.random()}"])) for _ in range(n)]


def test_against_whole_strings():
    draw = random.Random(1)
    for k in range(3000):
        rows = drawn(draw, k % 12)
        assert streamed(rows) == plain(rows), rows


def test_against_every_sequence_of_edits():
    """All sequences of edits of short conversations, by the definition alone."""
    draw = random.Random(2)
    allowed = re.compile(r"(s?(ua)+)?")
    gaps = [("",), ("Iu",), ("Ia",), ("Iu", "Ia"), ("Ia", "Iu")]
    for _ in range(60):
        rows = drawn(draw, draw.randint(0, 3))
        marks = faults(rows)
        each = [[("D",)] if m in ("blank", "duplicate") else [("K",), ("Ru",), ("Ra",), ("D",)] for m in marks]
        best = None
        for ops in itertools.product(*each):
            for filled in itertools.product(gaps, repeat=len(rows) + 1):
                initials, cost, audit = "", 0, ""
                for i in range(len(rows) + 1):
                    for g in filled[i]:
                        if g:
                            initials, cost, audit = initials + g[1], cost + 3, audit + "I"
                    if i < len(rows):
                        op = ops[i][0]
                        initials += {"K": rows[i][0][:1], "D": ""}.get(op, op[1:])
                        cost += {"K": 0, "D": 4}.get(op, 3) + (3 if marks[i] == "truncated" and op != "D" else 0)
                        audit += op[0]
                if allowed.fullmatch(initials) and (best is None or (cost, audit) < best):
                    best = (cost, audit)
        assert plain(rows)[4:6] == best, rows


def test_open_edits_stay_few_in_long_conversations():
    draw = random.Random(3)
    out = cr._Summary(1)
    most = 0
    for i in range(20_000):
        role = ["user", "assistant"][i % 2] if draw.random() < 0.9 else "user"
        text, fault = f"t{i}.", draw.choice([None, None, None, None, "blank", "truncated", "duplicate"])
        out.turn(i, role, text, fault)
        most = max(most, out.repair.open_edits)
    assert most < 200
    assert len(out.row()[7]) >= 20_000


def test_everything_unknown_stays_open_but_right():
    rows = [("tool", f"t{i}.") for i in range(31)]
    assert streamed(rows) == plain(rows)


def test_table_with_odd_rows(spark):
    rows = [
        (1, 2, "assistant", "Two."), (1, 0, "user", "Zero."), (1, 5, "user", "Five?"), (1, 5, "user", "Five?"),
        (2, None, "user", "null turn."), (2, None, "assistant", "b."), (2, 3, None, "no role."), (2, 4, "user", None), (2, 9, "", "empty role."),
        (None, 1, "user", "x."), (None, 2, "assistant", "y."), (3, None, None, None), (4, 1, "assistant", "long " * 50_000 + "."), (4, 2, "system", "s."),
    ]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"key": F.lit(0), "fault": F.lit("f"), "number": F.lit(1)})
    got = {r["conv_id"]: tuple(r)[1:] for r in cr.repair(df.repartition(3)).collect()}
    fill = lambda x: " " if x is None else x
    for key in (1, 2, 3, 4, None):
        own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1] is not None, r[1] or 0, fill(r[2]), fill(r[3])))
        turns = {r[1] for r in own if r[1] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert got[key] == (gaps, *plain([(fill(r[2]), fill(r[3])) for r in own])), key
    assert len(got) == 5
    made = cr.edits(df.repartition(3)).collect()
    for key, values in got.items():
        own = sorted((r for r in made if r["conv_id"] == key), key=lambda r: r["number"])
        assert "".join(r["edit"] for r in own) == values[6]
        text = "\n".join(f"{r['new_role']}:{r['new_text']}" for r in own if r["edit"] != "D")
        assert hashlib.sha256(text.encode()).hexdigest() == values[7]
    assert cr.repair(df.limit(0)).count() == 0 and cr.edits(df.limit(0)).count() == 0


def test_the_query_keeps_every_conversation(spark, tmp_path):
    import zlib

    from veritable.llm.queries import op13_conversation_repair

    rows = [(c, t, ["system", "user", "assistant", "user"][t % 4], f"Turn {t}. Of {c}!") for c in range(60) for t in range(c % 7)]
    rows += [(c, 0, "user", None) for c in range(100, 140)] + [(None, None, None, None), (None, 1, "user", "Hi.")]
    path = str(tmp_path / "conversations.parquet")
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").write.parquet(path)
    got = {r["conv_id"]: tuple(r)[1:] for r in op13_conversation_repair(spark, str(tmp_path)).collect()}
    worn = {}
    for c, t, role, text in rows:
        show = lambda x: " " if x is None else str(x)
        mark = zlib.crc32(f"{show(c)}:{show(t)}".encode()) % 20
        role, text = show(role), show(text)
        text = "" if mark == 1 else re.sub("[.!?]", "", text) if mark == 2 else text
        worn.setdefault(c, []).extend([(t, "user" if mark == 4 else role, text)] * (0 if mark == 0 else 2 if mark == 3 else 1))
    assert set(got) == set(worn)
    for key, own in worn.items():
        own.sort(key=lambda r: (r[0] is not None, r[0] or 0))
        turns = {r[0] for r in own if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        assert got[key] == (gaps, *plain([r[1:] for r in own])), key
    assert any(not own for own in worn.values())
