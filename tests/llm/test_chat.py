import hashlib

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ledgerlake.llm import op3_chat as op

TURNS = "conv_id long, turn long, role string, text string, formatted string"
NASTY = st.text(alphabet=st.sampled_from(list("<|>\\n im_startend\n:image1é")), max_size=40)


@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "sys|\n<|x"]), NASTY), max_size=6))
def test_round_trip(turns):
    c = op.Conversation()
    for role, text in turns:
        c.add(role, [{"type": "text", "text": text}])
    _, formatted, spans, _, _ = c.row(1)
    assert [(r, op.unescape(t)) for r, t in op.read_back(formatted)] == turns
    assert [op.unescape(formatted[s["start"] : s["end"]]) for s in spans] == [t for r, t in turns if r == "assistant"]


def brute(rows):
    by = {}
    for conv, turn, role, text, *_ in rows:
        by.setdefault(conv, []).append((turn is not None, turn or 0, role is not None, role or "", text or ""))
    out = []
    for conv, turns in by.items():
        turns.sort()
        loss = "".join(t for *_, r, t in turns if r == "assistant")
        digest = hashlib.sha256("".join(f"{r}\n{t}\n" for *_, r, t in turns).encode()).hexdigest()
        out.append((conv, len(turns), digest, len(loss), hashlib.sha256(loss.encode()).hexdigest()))
    return sorted(out, key=str)


def test_digests(spark, sf):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    rows += [(None, 0, "user", "x"), (None, 1, "assistant", None), (-7, None, None, None), (-7, 1, "assistant", op.PROBE), (-7, 1, "assistant", op.PROBE), (-8, 0, "assistant", "y" * 500_000)]
    rows += [(-9, i, "user", f"{i}") for i in range(3000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], TURNS).repartition(4)
    got = sorted((tuple(r)[:5] for r in op.digest(op.format_chats(df)).collect()), key=str)
    assert got == brute(rows)


def test_query_appends_the_probe(spark, sf):
    got = op.op3_chat_format(spark, sf).where("conv_id = -1").collect()
    assert got[0]["n_turns"] == 2 and got[0]["loss_chars"] == len(op.PROBE)


def test_parts(spark):
    schema = "conv_id long, turn long, role string, parts array<struct<type:string,text:string,reference:string,units:int>>"
    parts = [("text", "see <|image:9|>", None, None), ("image", None, "a.png", 2), ("audio", None, "b.wav", None), ("document", None, "c.pdf", 3), (None, "end", None, None)]
    row = op.format_chats(spark.createDataFrame([(1, 0, "user", parts), (1, 1, "assistant", None)], schema)).collect()[0]
    assert row["formatted"] == "<|im_start|>user\nsee <\\|image:9|><|image:1|><|audio:2|><|document:3|>end<|im_end|>\n<|im_start|>assistant\n<|im_end|>\n"
    assert [(a["kind"], a["reference"], a["tokens"]) for a in row["attachments"]] == [("image", "a.png", 512), ("audio", "b.wav", 25), ("document", "c.pdf", 1536)]
    assert row["attachment_tokens"] == 512 + 25 + 1536


def test_unknown_part():
    with pytest.raises(ValueError):
        op.Flattener().visit({"type": "video"})


def test_empty(spark):
    assert op.format_chats(spark.createDataFrame([], TURNS)).agg(F.count("*")).collect()[0][0] == 0
