import hashlib

import pytest
from oracle import compare
from pyspark.sql import functions as F

from tallyhold.llm import chat


def test_query_against_sql(spark, sf):
    compare(chat.op4_chat_prefix_targets(spark, sf), chat.OP4_SQL, sf)


def test_examples_and_edges(spark):
    data = [(1, 0, "user", "a # b"), (1, 1, "assistant", "x\n</turn>\n### user: y"), (1, 2, "user", None), (1, 3, "assistant", "é\\"), (None, None, None, None), (2, 1, "a:b\\", ""), (2, 1, "a:b\\", ""), (3, 0, "assistant", "")]
    df = spark.createDataFrame([(*r, 9) for r in data], "conv_id long, turn long, role string, text string, segment int")
    segments = chat.format_turns(df)
    texts = {(r.conv_id, r.example): r for r in chat.render_examples(segments).collect()}
    first, second = texts[1, 0], texts[1, 1]
    undo = lambda s: s.replace("\\#", "#").replace("\\<", "<").replace("\\\\", "\\")
    assert undo(first.text[first.target_start : first.target_end]) == data[1][3]
    assert second.text.startswith(first.text) and undo(second.text[second.target_start : second.target_end]) == "é\\"
    assert first.text.count("</turn>") - first.text.count("\\</turn>") == 2
    expanded = chat.expand_prefix_targets(segments)
    found = {(r.conv_id, r.example): r for r in chat.examples_of(expanded).collect()}
    assert set(found) == set(texts) == {(1, 0), (1, 1), (3, 0)}
    for k, t in texts.items():
        r = found[k]
        assert (len(t.text) - len(chat.CLOSE), t.target_start) == (r.target_end, r.target_start) and t.target_end == r.target_end
        assert hashlib.sha256(t.text[: r.context_chars].encode()).hexdigest() == r.context_sha256
    read = lambda e: chat.read_back(chat.segments_of(e), chat.examples_of(e))
    back = {r.conv_id: r for r in read(expanded).collect()}
    assert back[1].n_turns == 4 and back[1].loss_chars == len(data[1][3]) + 2
    assert back[1].turns_sha256 == hashlib.sha256("".join(f"{r[2]}\n{r[3] or ''}\n" for r in data[:4]).encode()).hexdigest()
    assert back[1].expanded_chars == len(first.text) + len(second.text)
    assert back[None].n_turns == 1 and back[2].n_turns == 2 and back[3].n_examples == 1
    long = spark.createDataFrame([(1, 0, "assistant", "a#b\\" * 300_000)], "conv_id long, turn long, role string, text string")
    assert read(chat.expand_prefix_targets(chat.format_turns(long))).first().loss_chars == 1_200_000
    assert read(chat.expand_prefix_targets(chat.format_turns(df.limit(0)))).count() == 0


def test_ids_are_exact(spark):
    big = 2**53
    ids = [big, big + 1, big + 3, None, -(2**63), 2**63 - 1, 0]
    df = spark.createDataFrame([(i, t, r, f"{r} {i}") for i in ids for t, r in enumerate(("user", "assistant"))], "conv_id long, turn long, role string, text string").coalesce(1)
    expanded = chat.expand_prefix_targets(chat.format_turns(df))
    back = {r.conv_id: r for r in chat.read_back(chat.segments_of(expanded), chat.examples_of(expanded)).collect()}
    assert set(back) == set(ids) and len(ids) == len(back) and all(r.n_turns == 2 and r.n_examples == 1 for r in back.values())
    assert {r.conv_id for r in chat.render_examples(chat.format_turns(df)).collect()} == set(ids)


def test_a_wrong_context_is_found(spark):
    df = spark.createDataFrame([(1, 0, "user", "a"), (1, 1, "assistant", "b")], "conv_id long, turn long, role string, text string")
    expanded = chat.expand_prefix_targets(chat.format_turns(df))
    other = chat.segments_of(expanded).withColumn("segment", F.replace("segment", F.lit("a </"), F.lit("x </")))
    with pytest.raises(Exception, match="context"):
        chat.read_back(other, chat.examples_of(expanded)).collect()
