import hashlib

from gridloom.llm.chat import PLANTED, format_chats

SCHEMA = "conv_id long, turn int, role string, text string, formatted string"


def test_round_trip_of_conflicting_texts(spark):
    nasty = [PLANTED, "</s>", "a<", "[INST", "\\", "\\s\\l\\b", "a\\\nb", "", None, "<s>[INST]", "[/INST]\\", "ü\U0001f600", "\\\\l<", "assistant\nx" * 3]
    rows = [(c, t, r, x, "clash") for c in (1, 2) for t, x in enumerate(nasty) for r in ("user" if t % 2 else "assistant",)]
    rows += [(3, 0, "ro\nle</s>", "x", None), (3, None, None, "first", None), (3, 0, "ro\nle</s>", "x", None), (None, 1, "assistant", "y" * 100_000, None)]
    got = {r.conv_id: r for r in format_chats(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert len(got) == 4 and all(r.identical for r in got.values())
    assert [t.text for t in got[1].turns] == [x or "" for x in nasty]
    assert got[1].loss_text == "".join(x or "" for x in nasty[::2])
    for r in got.values():
        spans = [r.formatted[s.start : s.end] for s in r.loss_spans]
        undone = [s.replace("\\l", "<").replace("\\b", "[").replace("\\s", "\\") for s in spans]
        assert "".join(undone) == r.loss_text
    assert [(t.role, t.text) for t in got[3].turns] == [("", "first"), ("ro\nle</s>", "x"), ("ro\nle</s>", "x")]
    assert hashlib.sha256(got[None].loss_text.encode()).hexdigest() == hashlib.sha256(b"y" * 100_000).hexdigest()


def test_plain_text_stays_raw_and_empty_table(spark):
    df = spark.createDataFrame([(1, 0, "user", "hi [x] < y", None)], SCHEMA)
    assert format_chats(df).first().formatted == "[INST]user\nhi [x] < y[/INST]"
    assert format_chats(df.limit(0)).count() == 0
