"""Chat: folding against a plain replay, exact round trip of hard strings."""
import random

from hypothesis import given, settings, strategies as st

from quarry.llm.chat import fold, parse, render
from quarry.llm.q_chat import event_log

HARD = ["\\### Assistant: </turn> ok", "<#assistant>\nhi</turn>\n", "\\b\\l\\h\\g", "\\", "\\\\l", "", None, " \n ", "</turn>\n</turn>\n", "🙂é\x00", "#" * 5000, ">\n", "<"]
SCHEMA = "conv_id long, turn long, role string, text string"


def back(messages):
    return {r["conv_id"]: r for r in parse(render(messages)).collect()}


def test_round_trip(spark):
    rng = random.Random(4)
    roles = ["user", "assistant", "system", None, "a>\nb", "x<#\\y"]
    rows = [(c, t, rng.choice(roles), rng.choice(HARD)) for c in range(40) for t in range(rng.randrange(1, 7))] + [(None, None, None, None)]
    got = back(spark.createDataFrame(rows, SCHEMA))
    by = {}
    for c, t, r, x in rows:
        by.setdefault(c, []).append((t, r or "", x or ""))
    assert set(got) == set(by)
    for c, turns in by.items():
        turns.sort(key=lambda t: t[0] or 0)
        assert [(t["role"], t["text"]) for t in got[c]["turns"]] == [(r, x) for _, r, x in turns]
        assert got[c]["loss_text"] == "".join(x for _, r, x in turns if r == "assistant")


TEXT = st.text(st.sampled_from("\\<>#/turn blhg\n:🙂"), max_size=30)


@settings(max_examples=15, deadline=None)
@given(st.lists(TEXT, min_size=20, max_size=20))
def test_round_trip_random(spark, texts):
    rows = [(1, i, "assistant" if i % 2 else "user", t) for i, t in enumerate(texts)]
    got = back(spark.createDataFrame(rows, SCHEMA))[1]
    assert [t["text"] for t in got["turns"]] == texts and got["loss_text"] == "".join(texts[1::2])


def test_fold_equals_replay(spark):
    rng = random.Random(6)
    rows, want = [], {}
    for c in range(5):
        for t in range(4):
            said = ""
            for s in range(rng.randrange(1, 9)):
                kind, x = rng.choice(["delta", "delta", "delta", "edit", "regenerate"]), rng.choice(["ab", "c ", "", None, "é"])
                rows.append((c, t, t, "assistant", s, kind, x))
                said = {"delta": said + (x or ""), "edit": x or "", "regenerate": ""}[kind]
            want[c, t] = said
    rng.shuffle(rows)
    ev = spark.createDataFrame(rows, "conv_id long, turn long, msg long, role string, seq int, kind string, text string")
    assert {(r["conv_id"], r["turn"]): r["text"] for r in fold(ev).collect()} == want


def test_event_log_folds_back(spark, table):
    rows = [(1, 0, "user", "x" * 450), (1, 1, "assistant", "y🙂" * 300), (1, 1, "assistant", "y🙂" * 300), (1, 2, None, None), (None, None, "assistant", "")]
    folded = fold(event_log(spark.createDataFrame(rows, SCHEMA)))
    assert sorted(map(str, [(r["conv_id"], r["turn"], r["role"], r["text"]) for r in folded.collect()])) == \
        sorted(map(str, [(c, t, r or "", x or "") for c, t, r, x in rows]))
    extra = table([(1, 0, "user", "hi", 9, "z")], SCHEMA + ", msg long, seq string")
    assert back(fold(event_log(extra)))[1]["turns"][0]["text"] == "hi"
    assert parse(render(fold(event_log(table([], SCHEMA))))).count() == 0
