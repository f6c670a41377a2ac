from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from spindrift.llm import chat as C

PIECES = st.lists(st.sampled_from(["<", "|", "\\", "im_start", "im_end", "|>", "<|im_start|>", "<|im_end|>", "<\\|", "\n", "assistant", "é", "$1", "n", "日"]), max_size=8).map("".join)


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.tuples(st.one_of(st.none(), st.sampled_from(["user", "assistant", "a\\n\n<|im_end|>", "x\\"])), st.one_of(st.none(), PIECES)), min_size=1, max_size=5), min_size=8, max_size=8))
def test_round_trip(spark, chats):
    rows = [(c, t, role, text) for c, turns in enumerate(chats) for t, (role, text) in enumerate(turns)]
    made = C.formatted_chats(C.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))
    for r in made.select("conv_id", "formatted", C.parsed(made.formatted).alias("turns"), C.masked(made.formatted, made.loss).alias("under"), "loss").collect():
        want = [(role or "", text or "") for role, text in chats[r.conv_id]]
        assert [(t.role, t.text) for t in r.turns] == want
        assert r.under == "".join(text for role, text in want if role == "assistant")
        assert r.formatted.count(C.START) == r.formatted.count(C.END) == len(want)
        assert [r.formatted[s.start - len("assistant\n") : s.start] for s in r.loss] == ["assistant\n"] * len(r.loss)


def test_events_fold(spark):
    log = [
        (1, 1, 10, "message", "user", "hi"),
        (1, 2, 11, "message", "assistant", None),
        (1, 3, 11, "delta", None, "Hel"),
        (1, 4, 11, "delta", None, "lo"),
        (1, 5, 11, "regenerate", None, ""),
        (1, 6, 11, "delta", None, "Good "),
        (1, 7, 12, "message", "user", "gone"),
        (1, 8, 11, "delta", None, "day"),
        (1, 9, 10, "edit", None, "hello"),
        (1, 10, 12, "delete", None, None),
        (2, 1, 1, "message", None, None),
    ]
    turns = {r.conv_id: [(t.role, t.text) for t in r.turns] for r in C.reconstructed(spark.createDataFrame(log, "conv_id long, seq long, msg long, kind string, role string, text string")).collect()}
    assert turns == {1: [("user", "hello"), ("assistant", "Good day")], 2: [("", "")]}


def test_ties_and_empty(spark):
    rows = spark.createDataFrame([(1, 0, "user", "b"), (1, 0, "user", "b"), (1, 0, "user", "a"), (None, None, None, None)], "conv_id long, turn long, role string, text string")
    got = {r.conv_id: [t.text for t in r.turns] for r in C.reconstructed(C.events_of(rows)).collect()}
    assert got == {1: ["a", "b", "b"], None: [""]}
    assert C.formatted_chats(C.events_of(rows.limit(0))).count() == 0


def test_streamed_log_folds_to_the_turns(spark):
    texts = ["", None, "a" * 250, "é<|im_end|>\n" * 40, "😀" * 101, "one", "two", "line\n\n"]
    rows = [(c, t, ("user", "assistant", "tool\n")[t % 3], texts[(c + t) % len(texts)], 1) for c in range(6) for t in range(9)] + [(1, 3, "user", "tie", 1), (1, 3, "user", "tie", 1), (None, 0, None, None, 1)]
    df = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string, msg int")
    log = C.streamed(df)
    assert {r.kind for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate", "delete"}
    want = {}
    for c, t, role, text, _ in sorted(((c, t, role or "", text or "", 1) for c, t, role, text, _ in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1:])):
        want.setdefault(c, []).append((role, text))
    got = {r.conv_id: [tuple(t) for t in r.turns] for r in C.reconstructed(log).collect()}
    assert got == want
    out = C.formatted_chats(log)
    read = {r.conv_id: ([tuple(t) for t in r.turns], r.under) for r in out.select("conv_id", C.parsed(F.col("formatted")).alias("turns"), C.masked(F.col("formatted"), F.col("loss")).alias("under")).collect()}
    assert read == {c: (turns, "".join(t for r, t in turns if r == "assistant")) for c, turns in want.items()}


def test_long_stream_and_clashing_columns(spark):
    names = "log set named turn turns first there head body trained size whole start parts n t".split()
    rows = [(1, k, 7, "message" if k == 0 else "delta", "assistant" if k == 0 else None, f"{k} ", *names) for k in range(20_000)]
    df = spark.createDataFrame(rows, "conv_id long, seq int, msg int, kind string, role string, text string, " + ", ".join(f"{c} string" for c in names))
    out = C.formatted_chats(df).collect()
    text = "".join(f"{k} " for k in range(20_000))
    assert len(out) == 1 and out[0].formatted == "<|im_start|>assistant\n" + text + "<|im_end|>\n"
    assert [tuple(s) for s in out[0].loss] == [(len("<|im_start|>assistant\n"), len(text))]
