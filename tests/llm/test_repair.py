"""Conversation repair against whole-audit search, with small blocks, on odd and long conversations."""
import hashlib
import itertools
import random
import re
import zlib

from pyspark.sql import functions as F

from quarry.llm import repair as R
from quarry.llm.q_repair import damaged

GRAMMAR = re.compile(r"(s?(ua)+)?")


def _kind(rows):
    seen, out = set(), []
    for role, text in rows:
        shown = text.rstrip(R.SPACE)
        out.append("blank" if not shown else "duplicate" if (role, text) in seen else "none" if shown[-1] in ".!?" else "truncated")
        seen.add((role, text))
    return out


def _model(rows):
    """(cost, audit, repaired lines) by cheapest whole audits, row by row."""
    best = {"": (0, "", ())}  # by the last initial kept ('' at the start)
    follow = {"": "u", "s": "u", "u": "a", "a": "u"}
    name = {"u": "user", "a": "assistant"}

    def grow(best):
        for _ in range(2):
            for q, (c, a, r) in list(best.items()):
                to = follow[q]
                got = (c + 5, a + "I", r + (f"{name[to]}:",))
                best[to] = min(best.get(to, got), got)
        return best

    for (role, text), fault in zip(rows, _kind(rows)):
        new = {}

        def put(q, got, new=new):
            new[q] = min(new.get(q, got), got)

        for q, (c, a, r) in grow(dict(best)).items():
            put(q, (c + 2, a + "D", r))
            if fault not in ("blank", "duplicate"):
                late = 5 * (fault == "truncated")
                if (q, role[:1]) in {("", "s"), ("", "u"), ("s", "u"), ("u", "a"), ("a", "u")}:
                    put(role[:1], (c + late, a + "K", r + (f"{role}:{text}",)))
                put(follow[q], (c + 1 + late, a + "R", r + (f"{name[follow[q]]}:{text}",)))
        best = new
    return min(x for q, x in grow(best).items() if q in ("", "a"))


def _cases(n, r, longest=9):
    texts = ["ok.", "yes!", "no?", "cut", " ", "", "x.\n", "why?  "]
    for _ in range(n):
        yield [(r.choice(["system", "user", "user", "assistant", "assistant", "tool", " ", ""]), r.choice(texts) if r.random() < .4 else f"t{r.random()}.")
               for _ in range(r.randrange(1, longest))]


def _codes(rows):
    place = {"s": 0, "u": 1, "a": 2}
    return [place.get(role[:1], 3) * 4 + R.FAULTS.index(f) for (role, _), f in zip(rows, _kind(rows))]


def _solve(rows, block):
    """The operator's steps without Spark, in blocks."""
    walk, codes = R.Walk(), _codes(rows)
    blocks = [R._steps(codes[i:i + block]) for i in range(0, len(codes), block)]
    steps = [R.table_of(walk, b) for b in blocks] + [R.FINISH]
    states = walk.states(steps, 0, 0)
    edits = [e for b, q, to in zip(blocks, states, states[1:]) for e in R.row_edits(b, walk.states(b, q, to))]
    after = R.finish(states[-2])
    cost = sum(next(c for t, c, _ in m[q] if t == to) for m, q, to in zip(steps, states, states[1:]))
    names, out = {"u": "user", "a": "assistant"}, []
    for (role, text), (_, before, own) in zip(rows, edits):
        out += [f"{names[x]}:" for x in before]
        if own != "d":
            out.append(f"{role if own == 'k' else names[own]}:{text}")
    return cost, "".join(x for x, _, _ in edits) + "I" * len(after), tuple(out + [f"{names[x]}:" for x in after])


def test_equals_whole_audits():
    for rows in _cases(3000, random.Random(1)):
        want = _model(rows)
        for block in (1, 2, 3, 100):
            assert _solve(rows, block) == want, rows


def test_all_short_role_orders():
    for n in range(1, 6):
        for roles in itertools.product(["system", "user", "assistant", "x"], repeat=n):
            rows = [(role, f"t{i}.") for i, role in enumerate(roles)]
            cost, audit, lines = _solve(rows, 2)
            assert (cost, audit, lines) == _model(rows)
            assert GRAMMAR.fullmatch("".join(x[0] for x in lines))


def test_long_conversation_is_linear():
    rows = next(_cases(1, random.Random(3), 2)) * 0 + [(random.Random(i).choice(["user", "assistant", "system"]), f"t{i}.") for i in range(30_000)]
    assert _solve(rows, R.BLOCK) == _solve(rows, 1 << 20)


def _crc(conv, turn):
    text = lambda x: " " if x is None else str(x)
    return zlib.crc32(f"{text(conv)}:{text(turn)}".encode()) % 20


def _damage(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        how = _crc(conv, turn)
        if how:
            text = "" if how == 1 else re.sub("[.!?]", "", text) if how == 2 else text
            out += [(conv, turn, "user" if how == 4 else role, text)] * (2 if how == 3 else 1)
    return out


def _expected(rows):
    convs = {r[0] for r in rows}
    bad = _damage(rows)
    out = {}
    for c in convs:
        mine = sorted([r for r in bad if r[0] == c],
                      key=lambda r: (r[1] is not None, r[1] or 0, r[2].encode(), hashlib.md5(r[3].encode()).hexdigest()))
        pairs = [(r[2], r[3]) for r in mine]
        kinds = _kind(pairs)
        turns = [r[1] for r in mine if r[1] is not None]
        cost, audit, lines = _model(pairs) if pairs else (0, "", ())
        heads = [p[0][:1] for p in pairs]
        out[c] = (max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, kinds.count("blank"), kinds.count("duplicate"),
                  kinds.count("truncated"), sum(a + b not in ("su", "ua", "au") for a, b in zip(heads, heads[1:])), cost, audit,
                  hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


SCHEMA = "conv_id long, turn long, role string, text string, uid string, pos long, blk string"


def _report(convs, block=R.BLOCK):
    src = convs.select("conv_id", "turn", "role", "text")
    got = R.report(damaged(src), src, block).collect()
    assert len({r.conv_id for r in got}) == len(got)
    return {r.conv_id: tuple(r)[1:] for r in got}


def test_report_on_odd_tables(table, empty):
    r = random.Random(9)
    rows = [(c, t, r.choice(["user", "assistant", "system", None, ""]), r.choice(["a.", "b", None, "", "c!", "  "]) if r.random() < .5 else f"x{r.random()}?")
            for c in range(60) for t in range(r.randrange(1, 12))]
    rows += [(None, t, "user", "same.") for t in range(5)] + [(100, None, "user", "hm.")] * 3 + [(100, None, None, None), (101, 5, "user", "a.")]
    rows += [(200, t, ["user", "assistant"][t % 2], f"long {t}." if t % 7 else "again.") for t in range(700)]
    rows += [(300, 4, "user", "hot.")] * 400
    got = {}
    for block in (5, R.BLOCK):
        got[block] = _report(table([(*x, "u", 1, "b") for x in rows], SCHEMA), block)
    want = _expected(rows)
    assert got[5] == want and got[R.BLOCK] == want
    assert _report(table([], SCHEMA)) == {}


def test_repaired_rows(table):
    rows = [(c, t, role, text, "u", 1, "b") for c, turns in {
        1: [("assistant", "hi."), ("user", "q?")], 2: [("user", "q?"), ("user", "more?"), ("assistant", "cut")],
        3: [("tool", "x.")], 4: [("system", "s."), ("user", "q?"), ("assistant", "a.")], 5: [("user", " ")]}.items()
        for t, (role, text) in enumerate(turns)]
    out = R.repair(table(rows, SCHEMA)).orderBy("conv_id", "place", "sub").collect()
    for c in range(1, 6):
        pairs = [(role, text) for i, _, role, text, *_ in rows if i == c]
        mine = [r for r in out if r.conv_id == c]
        assert [f"{r.role}:{r.text}" for r in mine] == list(_model(pairs)[2])
        assert GRAMMAR.fullmatch("".join(r.role[0] for r in mine))
    assert R.repair(table([], SCHEMA)).count() == 0


def test_no_task_gathers_a_conversation(table):
    """A conversation's rows are spread over blocks of bounded size."""
    rows = [(1, t, "user", f"{t}.", "u", 1, "b") for t in range(900)]
    put = R.ordered(R._source(table(rows, SCHEMA), "conv_id", "turn", "role", "text").withColumn("copy", F.lit(0)), 50)
    sizes = [r["count"] for r in put.groupBy("conv_id", "blk").count().collect()]
    assert sum(sizes) == 900 and max(sizes) <= 50
    assert [r.turn for r in put.orderBy("pos").collect()] == list(range(900))
