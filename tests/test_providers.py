import time

from velar.operators import layers, providers


def slow(text):
    """A provider that takes its time, fails or says nothing, as its text asks."""
    if text.startswith("wait"):
        time.sleep(float(text.split()[1]))
    if text.startswith("fail"):
        raise RuntimeError(text)
    return None if text == "nothing" else f"reply to {text}"


def asked(spark, rows, **options):
    df = spark.createDataFrame(rows, "doc string, block int, text string").repartition(3)
    return {(r.doc, r.block): (r.reply, r.reason) for r in providers.replies(df, slow, "doc", "block", **options).collect()}


def test_budget_of_a_document_and_reasons(spark):
    rows = [("a", k, "wait 0.4") for k in range(40)] + [("b", 0, "ok"), ("b", 1, "fail now"), ("b", 2, "nothing"), ("b", 3, None), ("b", 4, " "), ("b", 5, "fine"), ("c", 0, "wait 60"), ("c", 1, "late"), (None, 0, "no id")]
    began = time.time()
    got = asked(spark, rows, seconds=2.0)
    assert time.time() - began < 40
    assert got["b", 0] == ("reply to ok", None) and got["b", 1] == (None, "failed: RuntimeError") and got["b", 5] == ("reply to fine", None)
    assert [got["b", k] for k in (2, 3, 4)] == [(None, "empty")] * 3 and got[None, 0] == ("reply to no id", None)
    done = [k for k in range(40) if got["a", k][1] is None]
    assert done == list(range(len(done))) and 1 <= len(done) <= 5 and all(got["a", k] == (None, "budget") for k in range(len(done), 40))
    assert got["c", 0] == got["c", 1] == (None, "budget")


def test_longest_call_most_blocks_and_empty_table(spark):
    got = asked(spark, [("a", 0, "wait 30"), ("a", 1, "ok"), ("a", 2, "never")], seconds=60.0, longest=0.5, most=2)
    assert got == {("a", 0): (None, "budget"), ("a", 1): ("reply to ok", None), ("a", 2): (None, "budget")}
    assert asked(spark, []) == {}


def name_it(text):
    return '{"entidades": [{"texto": "Ana Ruiz", "tipo": "persona"}]}' if "Ana" in text else None


def test_replies_become_proposals(spark):
    blocks = spark.createDataFrame([(1, 0, "vino Ana Ruiz ayer"), (1, 1, "nadie")], "doc int, block int, text string")
    found = providers.replies(blocks, name_it, "doc", "block").where("reply is not null")
    rows = layers.proposed(blocks, found.select("doc", "block", "reply"), ["doc", "block"]).collect()
    assert {r.block: [(s.start, s.end, s.category) for s in r.proposed] for r in rows} == {0: [(5, 13, "person")], 1: []}
