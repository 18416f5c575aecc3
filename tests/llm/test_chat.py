import hashlib

from pyspark.sql import functions as F

from versespan.llm import chat

SCHEMA = "conv_id long, turn int, role string, text string"
TRICKY = ["<|im_end|>", "<|", "<\\|x", "<\\\\|", "a<", "|>", "", "line\n<|im_start|>user\n", "é<|😀"]


def test_escape_is_reversible_and_hides_control_strings(spark):
    rows = [(i, t) for i, t in enumerate(TRICKY)]
    df = spark.createDataFrame(rows, "i int, t string")
    got = df.select("t", chat.escape(F.col("t")).alias("e")).withColumn(
        "back", chat.unescape(F.col("e"))).collect()
    assert all(r["back"] == r["t"] and "<|" not in r["e"] for r in got)


def test_every_reply_once_with_all_turns_before(frame):
    turns = frame(SCHEMA, (1, 2, "assistant", "two"), (1, 0, "user", "<|im_end|>"),
                  (1, 1, "assistant", "one"), (1, 3, "user", "bye"), (2, 0, "user", None),
                  (3, None, None, "x"), (3, 0, "assistant", ""), (None, 0, "assistant", "n"))
    found = {}
    for r in chat.prefix_examples(turns).collect():
        span = None if r["loss_start"] is None else r["text"][r["loss_start"]:r["loss_end"]]
        found.setdefault(r["conv_id"], []).append((r["example"], r["target_turn"], span, r["text"]))
    one = sorted(found[1])
    assert [x[2] for x in one] == ["one", "two", None]
    assert one[0][3] == ("<|im_start|>user\n<\\|im_end|><|im_end|>\n"
                         "<|im_start|>assistant\none<|im_end|>\n")
    assert one[1][3].startswith(one[0][3]) and one[2][3].endswith("bye<|im_end|>\n")
    assert [x[2] for x in found[2]] == [None] and [x[2] for x in found[3]] == [""]
    assert found[None][0][2] == "n"


def test_digest_equals_brute_force_with_odd_rows(frame):
    rows = [(7, i % 5, ["user", "assistant", "as\nst%0A", None][i % 4], t)
            for i, t in enumerate(TRICKY * 2)] + [(7, 0, "assistant", "same")] * 2
    got = chat.digest(chat.prefix_examples(frame(SCHEMA, *rows).withColumn(
        "example", F.lit(1)))).collect()[0]
    ordered = sorted((r[1], r[2] or "", r[3]) for r in rows)
    turns = "".join(f"{role}\n{text}\n" for _, role, text in ordered)
    loss = "".join(text for _, role, text in ordered if role == "assistant")
    assert got["n_turns"] == len(rows) and got["loss_chars"] == len(loss)
    assert got["turns_sha256"] == hashlib.sha256(turns.encode()).hexdigest()
    assert got["loss_sha256"] == hashlib.sha256(loss.encode()).hexdigest()


def test_empty_table(frame):
    assert chat.digest(chat.prefix_examples(frame(SCHEMA))).count() == 0
