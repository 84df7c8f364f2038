from hypothesis import given
from hypothesis import strategies as st

from deltaloom.llm import chat_format
from pyspark.sql import functions as F

TURNS = "conv_id long, turn long, role string, text string, n_turns long, loss string"
ODD = ["</s>[INST] ok [/INST]", "<\\/s>", "<\\\\s>[\\INST]", "<<SYS>><</SYS>>", "plain é", "", "<", "[INST", "\\", "<s", "s>"]


def rows(spark, turns):
    return spark.createDataFrame([(*t, 1, "x") for t in turns], TURNS)


def test_texts_come_back_and_no_control_string_is_left(spark):
    texts = ODD + [a + b for a in ODD for b in ODD]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for r in df.select("t", chat_format.escape(F.col("t")).alias("e"), chat_format.unescape(chat_format.escape(F.col("t"))).alias("b")).collect():
        assert r.b == r.t
        assert not any(c in r.e for c in ("<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>"))


@given(st.text("<s>/[INST]\\SY a", max_size=30))
def test_the_rule_is_reversible(text):
    import re

    out = re.sub(chat_format.ESCAPE[0], r"\1\\\2\3", text)
    assert re.sub(chat_format.UNESCAPE[0], r"\1\2\3", out) == text


def test_each_reply_is_an_example_with_its_context(spark):
    turns = [(1, k, r, f"{t}{k}") for k, (r, t) in enumerate([("system", "S"), ("user", "</s>"), ("assistant", ODD[0]), ("user", "q"), ("assistant", ""), ("user", "tail")])]
    turns += [(2, 0, "user", "alone"), (3, 1, "assistant", None), (3, None, None, "null"), (None, 0, "assistant", "x"), (3, 1, "assistant", None)]
    made = chat_format.examples(rows(spark, turns))
    one = made.filter("conv_id = 1").orderBy("n_turns").collect()
    assert [(r.n_turns, r.trained) for r in one] == [(3, True), (5, True), (6, False)]
    assert one[1].text.startswith(one[0].text) and one[2].text.startswith(one[1].text)
    masked = [r.text[r.loss_start : r.loss_end] for r in one]
    assert masked[0].replace("\\", "") == ODD[0] + "2" and masked[1:] == ["4", ""]
    back = {r.conv_id: r for r in chat_format.read_back(made).collect()}
    assert [(t.role, t.text) for t in back[1].turns] == [(r, t) for _, _, r, t in turns[:6]]
    assert back[1].loss == ODD[0] + "24"
    assert [(t.role, t.text) for t in back[3].turns] == [("", "null"), ("assistant", ""), ("assistant", "")]
    assert back[2].loss == "" and back[None].loss == "x"
    assert "Python" not in made._jdf.queryExecution().toString()


def test_long_conversations_and_empty_tables(spark):
    turns = [(1, k, "user" if k % 2 else "assistant", "w " * 300) for k in range(200)]
    assert chat_format.examples(rows(spark, turns)).count() == 101
    assert chat_format.examples(rows(spark, [])).count() == 0
