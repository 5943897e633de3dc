from tallyspark.llm import conversations as cv
from tests.oracle import compare

SCHEMA = "conv_id long, turn long, role string, text string, level string"


def rows(spark, data):
    return {(r.conv_id, r.turn, r.text): r for r in cv.reply_ordered(spark.createDataFrame(data, SCHEMA)).collect()}


def test_nested_quotes_become_threads(spark):
    data = [
        (1, 0, "user", "How do I bake bread?\nAnd  CAKE too?", ""),
        (1, 1, "user", "What about the weather?", ""),
        (1, 2, "assistant", "> how do i bake   bread?\nWith flour.", ""),
        (1, 3, "assistant", ">What about the weather?\nIt rains.", ""),
        (1, 4, "user", "> > How do I bake bread?\n> With flour.\n\nHow much flour?", ""),
        (1, 5, "user", ">>> How do I bake bread?\n> not said by anyone\nStill there?", ""),
        (1, 6, "user", "> and cake too?\n> how do I bake bread?\n> It rains.\nBoth.", ""),
        (2, 1, "user", "> How do I bake bread?\nother talk", ""),
        (2, 2, "user", None, ""),
        (2, 2, "user", "", ""),
        (None, 3, "user", "x", ""),
        (None, 4, "user", "> x\ny", ""),
        (3, None, "user", "> x\nz", ""),
    ]
    got = rows(spark, data)
    assert len(got) == len(data)
    want = {2: (0, 0, 1), 3: (1, 1, 1), 4: (2, 0, 2), 5: (0, 0, 1), 6: (0, 0, 1), 0: (None, 0, 0), 1: (None, 1, 0)}
    mine = {r.turn: r for r in got.values() if r.conv_id == 1}
    assert {t: (r.parent_turn, r.root_turn, r.depth) for t, r in mine.items()} == want
    assert sorted(mine, key=lambda t: mine[t].position) == [0, 2, 5, 6, 4, 1, 3] and [r.position for r in sorted(mine.values(), key=lambda r: r.position)] == list(range(7))
    assert mine[4].text == "How much flour?" and mine[2].text == "With flour."
    other = {(r.conv_id, r.turn): r for r in got.values()}
    assert other[(2, 1)].parent_turn is None and other[(None, 4)].parent_turn == 3 and other[(3, None)].position == 0
    assert {r.position for r in got.values() if r.conv_id == 2} == {0, 1, 2}


def test_long_chain_in_one_conversation(spark):
    data = [(7, k, "user", (f"> line {k - 1}\n" if k else "") + f"line {k}", "") for k in range(60)] + [(7, 100 + k, "user", "> line 0\nsame answer", "") for k in range(50)]
    got = sorted(cv.reply_ordered(spark.createDataFrame(data, SCHEMA).repartition(5), parts=7).collect(), key=lambda r: r.position)
    assert [r.position for r in got] == list(range(110))
    assert all(r.depth == (r.turn if r.turn < 100 else 1) and r.root_turn == 0 for r in got)
    assert [(r.depth, r.turn) for r in got] == sorted((r.depth, r.turn) for r in got)


def test_empty(spark):
    assert cv.reply_ordered(spark.createDataFrame([], SCHEMA)).count() == 0


def test_oracle(spark):
    n, off = compare(spark, cv.QUERIES["op5_conversations"], cv.ORACLES["op5_conversations"])
    assert n and not off
