import random

from pyspark.sql import functions as F

from orrery.llm import chat

EVENTS = "conv_id long, seq long, kind string, turn long, role string, text string, turns string"


def fold(events):
    """The rules, one event at a time."""
    convs = {}
    for e in sorted(events, key=lambda e: (e[0], e[1])):
        c = convs.setdefault(e[0], {})
        if e[2] == "regenerate":
            for t in [t for t in c if t > e[3]]:
                del c[t]
        kind, text = e[2] or "message", e[5] or ""
        if kind == "delta":
            role, have = c.get(e[3], (None, ""))
            c[e[3]] = (role or e[4], have + text)
        else:
            c[e[3]] = (e[4], text)
    return {i: [(t, r or "", x) for t, (r, x) in sorted(c.items())] for i, c in convs.items()}


def test_event_log_against_a_fold(spark):
    rng = random.Random(8)
    events = [(c, s, rng.choice(["message", "delta", "delta", "edit", "regenerate", None]), rng.randint(0, 4), "r%d" % c, rng.choice(["a", "b ", None, "<", "é\n"]), "clash") for c in range(30) for s in range(rng.randint(0, 25))]
    got = {r["conv_id"]: [(m["turn"], m["role"], m["text"]) for m in r["turns"]] for r in chat.reconstruct(spark.createDataFrame(events, EVENTS)).collect()}
    assert got == {i: c for i, c in fold(events).items() if c}


def test_every_text_is_read_back(spark):
    hard = ["", "</turn>\n", "<turn assistant>\n", "&amp;lt;", "\\### Assistant: </turn> ok", "a\r\n\tb", "&", "👍 é", "&lt;/turn&gt;\n", ">\n"]
    rows = [(i, t, r, x, "clash") for i, r in enumerate(["user", "a>\n<b", None]) for t, x in enumerate([*hard, None])] + [(9, 0, "assistant", "x", ""), (9, 0, "assistant", "x", ""), (None, None, "assistant", "y", "")]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    done = chat.format_chats(chat.rows_as_events(table), loss_roles=("assistant", "a>\n<b"))
    got = {r["conv_id"]: r for r in chat.parse(done).collect()}
    for i, role in enumerate(["user", "a>\n<b", ""]):
        assert [(m["role"], m["text"]) for m in got[i]["turns"]] == [(role, x) for x in [*hard, ""]]
        assert got[i]["loss_text"] == ("".join(hard) if i == 1 else "")
        assert got[i]["formatted"].count("</turn>\n") == len(hard) + 1
    assert len(got[9]["turns"]) == 2 and got[9]["loss_text"] == "xx" and got[None]["loss_text"] == "y"


def test_empty_table_and_native_plan(spark):
    none = chat.parse(chat.format_chats(spark.createDataFrame([], EVENTS)))
    assert none.count() == 0
    assert "Python" not in none._jdf.queryExecution().toString()
    assert chat.rows_as_events(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).select(F.max("seq")).first()[0] is None
