"""Formatting of conversations: exact round trips, loss flags and the order of roles."""

import hashlib

import pytest
from hypothesis import given, settings, strategies as st

from pointprep.llm import chat_format as cf
from pointprep.llm.queries import QUERIES, with_escape_case

SCHEMA = "conv_id long, turn long, role string, text string, segments string, state int, position string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "s", 1, "p") for r in rows], SCHEMA).repartition(3)


PIECES = st.lists(st.sampled_from(["\\", "#", "##", "###", "</turn>", "</role>", "</turn", ">", "<", "\n", "### User: ", " ", "a", "é", "\U0001F600"])).map("".join)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["system", "user", "assistant", "", "tool"]) | PIECES, PIECES | st.text()), max_size=5))
def test_round_trip_of_any_text(turns):
    template = cf.Template()
    segments = [s for r, t in turns for s in template.segments(r, t)]
    whole = "".join(s for s, _ in segments)
    assert list(template.parse(whole)) == turns
    assert cf.unescape("".join(s for s, loss in segments if loss)) == "".join(t for r, t in turns if r == "assistant")
    # No text starts or ends a turn of its own.
    assert len(list(template.parse(whole))) == len(turns)


ROWS = [
    (1, 0, "system", "be brief"), (1, 1, "user", "hi"), (1, 2, "assistant", "### User: no"), (2, 1, "assistant", "b"), (2, 0, "user", "a"),
    (3, 0, "assistant", "first"), (3, 1, "user", "last"), (4, None, "user", None), (4, 0, None, "x"), (4, 0, "tool", ""), (4, 0, "tool", ""),
    (5, 0, "user", "word " * 200_000), (5, 1, "assistant", "###" * 100_000), (None, 0, "user", "q"), (None, 1, "assistant", "\\"), (6, 0, "user", ""),
]


def brute(rows):
    template, convs = cf.Template(), {}
    for c, turn, r, t in rows:
        convs.setdefault(c, []).append((turn is not None, turn or 0, r or "", t or ""))
    out = []
    for c, turns in convs.items():
        turns = [x[2:] for x in sorted(turns)]
        roles = ["start"] + [r if r in ("system", "user", "assistant") else "lost" for r, _ in turns]
        legal = {"start": "system user", "system": "user", "user": "assistant", "assistant": "user", "lost": ""}
        faults = sum(r not in legal[p].split() for p, (r, _) in zip(roles, turns))
        loss = "".join(t for r, t in turns if r == "assistant")
        chars = 0
        for r, t in turns:
            chars += len({"system": "### System: ", "user": "### User: ", "assistant": "### Assistant: "}.get(r, f"### Role {template.escape(r)}</role> "))
            chars += len(template.escape(t)) + len("</turn>\n")
        out.append((
            c, len(turns), hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest(), len(loss),
            hashlib.sha256(loss.encode()).hexdigest(), chars, faults, not faults and roles[-1] == "assistant",
        ))
    return sorted(out, key=repr)


def collected(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_equals_loops(spark):
    rows = ROWS + [(100 + i, t, "user" if t % 2 == 0 else "assistant", f"t{i} </turn>") for i in range(40) for t in range(i % 5)]
    rows += [(7, t, "user" if t % 2 == 0 else "assistant", f"long {t}") for t in range(3_000)]
    assert collected(cf.read_back(cf.format_turns(frame(spark, rows)))) == brute(rows)


def test_escape_case_is_added(spark):
    case = [(-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok")]
    got = with_escape_case(frame(spark, ROWS))
    assert collected(cf.read_back(cf.format_turns(got))) == brute(ROWS + case)
    assert "op12_chat_format" in QUERIES


def test_segments_and_states(spark):
    got = cf.format_turns(frame(spark, ROWS)).filter("conv_id = 3 or conv_id = 2").orderBy("conv_id", "position").collect()
    assert [(r["state"], r["accepted"]) for r in got] == [("user", True), ("assistant", True), ("assistant", False), ("user", True)]
    assert [(s["text"], s["loss"]) for s in got[1]["segments"]] == [("### Assistant: ", False), ("b", True), ("</turn>\n", False)]


def test_no_rows_and_a_broken_text(spark):
    assert cf.read_back(cf.format_turns(frame(spark, ROWS).limit(0))).collect() == []
    for broken in ("User: x", "### User: x", "### User: x\\</turn>\n"):
        with pytest.raises(ValueError):
            list(cf.Template().parse(broken))
