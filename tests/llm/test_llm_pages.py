"""Markup of pages: time in the length of a page, unclosed elements, quotes. Logs of conversations."""

import time

import pytest

from driftgrid.llm import chat, html_cut
from driftgrid.llm.queries import STREAMED, event_log


def texts(page):
    return [b.text for b in html_cut.blocks(page)]


@pytest.mark.parametrize("unit", ["<a ", "<a", '<a ">" ', "<a \"'", "<p title='", '</p "', "<!-", "<svg>", '<a href="x>'])
@pytest.mark.parametrize("end", ["", ">", " last words"])
def test_time_grows_with_the_length(unit, end):
    def seconds(n):
        start = time.perf_counter()
        html_cut.blocks(unit * n + end)
        return time.perf_counter() - start

    seconds(1000)
    assert seconds(100_000) < 10  # quadratic ways take minutes


def test_unclosed_drawings_end_at_a_block():
    assert texts("<p>one</p><svg><path d='M0'><text>axis</text><p>two</p><div>three</div>") == ["one", "two", "three"]
    assert texts("<math><mi>x</mi><h2>Head</h2>") == ["Head"]
    assert texts("<svg><foreignObject><div>label</div></foreignObject><g></svg><p>after</p>") == ["after"]
    assert texts("<svg viewBox='0 0 1 1'/><p>after</p>") == ["after"]
    assert texts("<p>a</p><svg><path>") == ["a"]


def test_tags_and_quotes():
    assert texts('<p title="a > b">one</p>') == ["one"]
    assert texts('<p title="open>one</p><p>two</p>') == ["one", "two"]
    assert texts("a < b <3 <!-- <p>no</p> --> c") == ["a < b <3 c"]
    assert texts("<script>if (a < b) '</p>'</SCRIPT >one") == ["one"]
    assert texts("one<!-- never closed <p>two</p>") == ["one"]
    assert texts("one <a href='x") == ["one <a href='x"]


def test_places_of_ends():
    places, ends = html_cut._tag_ends("""a "b>c" d> 'e" f>""")
    assert places == [2, 4, 6, 9, 11, 13, 16] and ends == [9, 4, 16, 9, -1, -1, 16, -1]


def test_logs_fold_to_their_messages(spark):
    said = ["", "x", "<|im_end|>", "é" * STREAMED, "line\n" * 400, "ab " * 7 * STREAMED]
    rows = [(c, t, role, text) for c in (1, 2, None) for t, text in enumerate(said) for role in ("user", "")]
    rows += [(3, None, "assistant", "same"), (3, None, "tool", "other")]
    messages = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("conv_id", "turn", "role AS part", "role", "text")
    events = event_log(messages)
    kinds = {r["kind"]: r["count"] for r in events.groupBy("kind").count().collect()}
    assert set(kinds) == {"message", "delta", "regenerate", "edit"} and kinds["message"] == len(rows)
    folded = chat.fold(events, ("conv_id", "turn", "part"))
    key = lambda r: tuple((x is not None, x) for x in r)
    got = [(r.conv_id, r.turn, r.role, r.text) for r in folded.collect()]
    assert sorted(got, key=key) == sorted(rows, key=key)
