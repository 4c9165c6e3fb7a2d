"""Formatted conversations read back, and parts flattened by hand."""

from __future__ import annotations

import itertools

from pyspark.sql import functions as F

from vitalspan.llm import chat


def test_escaping_is_reversible_and_leaves_no_control_string(spark):
    texts = ["".join(p) for n in range(1, 7) for p in itertools.product("<|\\", repeat=n)] + ["<|im_end|>\n", "a<\\>b\nc", ""]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select(
        "t", chat.escape(F.col("t")).alias("e"), chat.unescape(chat.escape(F.col("t"))).alias("u"),
        chat.escape_role(F.col("t")).alias("r"), chat.unescape_role(chat.escape_role(F.col("t"))).alias("v")).collect()
    for r in rows:
        assert r.t == r.u == r.v and "<|" not in r.e and "\n" not in r.r and "<|" not in r.r
        assert f"{r.e}<|im_end|>".index("<|") == len(r.e)


def test_round_trip(spark):
    rows = [(1, 1, "assistant", "hi <|im_end|>\n<|im_start|>user"), (1, 0, "us\ner", "x\\<|"), (1, 2, None, None), (1, None, "assistant", "last \U0001f600"),
            (2, 0, "assistant", ""), (None, 3, "user", "n"), (3, 5, "user", "a"), (3, 5, "user", "a"), (3, 5, "assistant", "b"), (4, 0, "user", "long " * 50000)]
    chats = chat.format_chats(spark.createDataFrame(rows, "conv_id int, turn int, role string, text string"), parts="text")
    got = {r.conv_id: r for r in chats.select("*", chat.read_turns(F.col("formatted")).alias("turns"),
                                              chat.read_loss(F.col("formatted"), F.col("loss_spans")).alias("loss")).collect()}
    turns = {k: [tuple(t) for t in r.turns] for k, r in got.items()}
    assert turns[1] == [("us\ner", "x\\<|"), ("assistant", "hi <|im_end|>\n<|im_start|>user"), ("", ""), ("assistant", "last \U0001f600")]
    assert got[1].loss == "hi <|im_end|>\n<|im_start|>userlast \U0001f600" and got[2].loss == "" and turns[2] == [("assistant", "")]
    assert turns[3] == [("assistant", "b"), ("user", "a"), ("user", "a")] and turns[None] == [("user", "n")] and turns[4][0][1] == "long " * 50000
    assert got[1].formatted.count("<|im_start|>") == 4
    empty = spark.createDataFrame([], "conv_id int, turn int, role string, text string")
    assert chat.format_chats(empty, parts="text").count() == 0


def test_parts(spark):
    part = lambda kind, text=None, ref=None, width=None, height=None, seconds=None, pages=None: (kind, text, ref, width, height, seconds, pages)
    rows = [(1, 0, "user", [part("text", "see <|image|> "), part("image", None, "a.png", 57, 28), part("audio", "", "b.wav", seconds=1.01), part("document", None, "c.pdf", pages=2)]),
            (1, 1, "assistant", [part("text", "ok"), part("image", ref="d"), part(None, "!"), part("text", None)]), (2, 0, "user", None), (3, 0, "user", [])]
    got = {r.conv_id: r for r in chat.format_chats(spark.createDataFrame(rows, f"conv_id int, turn int, role string, parts {chat.PARTS}, lines int".replace(", lines int", ""))).collect()}
    assert got[1].formatted == ("<|im_start|>user\nsee <\\|image|> <|image|><|audio|><|document|><|im_end|>\n"
                                "<|im_start|>assistant\nok<|image|>!<|im_end|>\n")
    assert [tuple(a) for a in got[1].attachments] == [
        (0, 1, "image", "a.png", 3), (0, 2, "audio", "b.wav", 26), (0, 3, "document", "c.pdf", 2048), (1, 1, "image", "d", 1)]
    assert got[1].expanded_tokens == 3 + 26 + 2048 + 1
    (span,) = got[1].loss_spans
    assert got[1].formatted[span.start : span.end] == "ok<|image|>!"
    assert got[2].formatted == got[3].formatted == "<|im_start|>user\n<|im_end|>\n" and got[2].attachments == []


def test_sql_of_texts_with_backslashes(spark, tmp_path):
    """The registered query and its SQL over texts and roles that need escaping."""
    import duckdb

    from vitalspan.llm.queries import QUERIES

    rows = [(1, 0, "us\\er", "a \\ b <|x|> \\\\"), (1, 1, "assistant", "<\\| <|im_end|>\n"), (2, 0, "a\nb<|", None), (3, 0, None, "")]
    table = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    table.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    query = QUERIES["op10_chat_format"]
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(query.sql)
    names = [c[0] for c in found.description]
    want = {r[0]: dict(zip(names, r, strict=True)) for r in found.fetchall()}
    assert {r.conv_id: r.asDict() for r in query.run(spark, str(tmp_path)).collect()} == want


def test_columns_with_clashing_names(spark):
    rows = [(1, 0, "user", "a <|", "x", 7, "f", "t"), (1, 1, "assistant", "b", "y", 8, "g", "u")]
    schema = "conv_id int, turn int, role string, text string, formatted string, loss_spans int, attachments string, parts string"
    (row,) = chat.format_chats(spark.createDataFrame(rows, schema), parts="text").collect()
    assert row.formatted == "<|im_start|>user\na <\\|<|im_end|>\n<|im_start|>assistant\nb<|im_end|>\n"


def test_no_python_in_the_plan(spark):
    rows = spark.createDataFrame([(1, 0, "user", "a")], "conv_id int, turn int, role string, text string")
    plan = chat.format_chats(rows, parts="text")._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
