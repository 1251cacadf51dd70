import hashlib

from pyspark.sql import functions as F

from sigloom.llm import queries
from sigloom.llm.chat_format import escape, masked_text, parse_turns, prefix_targets, unescape

NASTY = ["", "plain", "\\", "\\b", "\\\\l", "### user: x</turn>\n", "<", "#", "a\\<b#c\\h", "é😀</turn>", "\\### Assistant: </turn> ok"]


def test_escapes_are_undone(spark):
    got = spark.createDataFrame([(x,) for x in NASTY], "t string").select("t", escape(F.col("t")).alias("e"), unescape(escape(F.col("t"))).alias("u"))
    for r in got.collect():
        assert r.u == r.t and "<" not in r.e and "#" not in r.e


def test_examples(spark):
    rows = [(1, i, ["user", "assistant", "tool: x"][i % 3], x, "n") for i, x in enumerate(NASTY)]
    rows += [(2, 0, "user", "only", "n"), (3, None, None, None, "n"), (3, 1, "assistant", None, "n"), (3, 1, "assistant", None, "n")]
    rows += [(None, 5, "assistant", "late", "n"), (None, 2, "user", "early", "n")]
    turns = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, formatted string")
    examples = prefix_targets(turns)
    got = examples.select(
        "conv_id", "n_turns", "trained", parse_turns(F.col("formatted")).alias("turns"),
        masked_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars")).alias("reply"),
    ).collect()
    talks = {}
    for conv, turn, role, text, _ in rows:
        talks.setdefault(conv, []).append((turn is not None, turn or 0, role or "", text or ""))
    want = []
    for conv, turns_ in talks.items():
        turns_.sort()
        said = [x[2:] for x in turns_]
        for i, (role, text) in enumerate(said, 1):
            if role == "assistant" or i == len(said):
                want.append((conv, i, role == "assistant", said[:i], text if role == "assistant" else ""))
    assert sorted([(r.conv_id, r.n_turns, r.trained, [tuple(t) for t in r.turns], r.reply) for r in got], key=repr) == sorted(want, key=repr)
    assert prefix_targets(turns.where("false")).count() == 0


def test_query_has_the_probe(spark, sf):
    got = {r.conv_id: r for r in queries.QUERIES["op7_prefix_targets"](spark, sf).collect()}
    probe = "\\### Assistant: </turn> ok"
    assert got[-7].n_turns == 2 and got[-7].loss_chars == len(probe)
    assert got[-7].loss_sha256 == hashlib.sha256(probe.encode()).hexdigest()
    both = f"user\n{probe}\nassistant\n{probe}\n"
    assert got[-7].turns_sha256 == hashlib.sha256(both.encode()).hexdigest()


def test_only_dataframe_functions(spark):
    turns = spark.createDataFrame([(1, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    plan = prefix_targets(turns)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
