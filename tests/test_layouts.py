"""Page layouts: selectors, dates and links."""

from datetime import date, datetime

import pytest

from eventloom.sources import layouts
from eventloom.sources.layouts import Selectors, boxes, layout_events

PLACES = {"title": "h2 a", "date": ".m + .d", "time": ".t", "url": "&@href", "location": "[data-at^=hall]", "description": "#about p"}
HTML = """<div class=x><h2><a>outside</a></h2></div>
<a class="box big" href="/1"><h2>not<a>One &amp; <b>two</b><br/></a></h2><i class="m">Jun</i><i class="d">5</i><p class=t>7 pm</p><p class=t>9 pm</p>
<u data-at="hall-3">Hall</u><u data-at="no">Not</u><div id=about><p>About<script>no()</script></p></div></a>
<li class=box>open<h2><a>Three</a></h2></li><h2><a>after</a></h2></i>"""


def test_boxes():
    got = boxes(HTML, Selectors(".box", PLACES))
    assert got == [
        {"title": ["One & two"], "date": ["Jun 5"], "time": ["7 pm", "9 pm"], "url": ["/1"], "location": ["Hall"], "description": ["About"]},
        {"title": ["Three"]},
    ]


def test_boxes_in_boxes():
    got = boxes("<div class=box><h2><a>A</a></h2><div class=box><h2><a>B</a></h2></div></div>", Selectors("div.box", {"title": "h2 a"}))
    assert got == [{"title": ["A", "B"]}, {"title": ["B"]}]
    assert boxes("", Selectors("div.box", {"title": "h2"})) == boxes("<div", Selectors("div.box", {"title": "h2"})) == []
    with pytest.raises(ValueError):
        Selectors("div >", {})


LAYOUT = (("s", ".box", PLACES | {"date": ".m", "url": "a@href"}, "https://s.org/", "America/New_York", "20:00", "Here"),)


@pytest.mark.parametrize(
    ("day", "time", "start", "end"),
    [
        ("June 5 - 21, 2026", "", datetime(2026, 6, 6), datetime(2026, 6, 22)),
        ("Jan. 22 – Feb. 7, 2027", "7:30 pm", datetime(2027, 1, 23, 0, 30), datetime(2027, 2, 8, 0, 30)),
        ("June 12-June 28, 2026", "", datetime(2026, 6, 13), datetime(2026, 6, 29)),
        ("Fri, June 5, 2026 1:00pm - 4:00pm", "", datetime(2026, 6, 5, 17), datetime(2026, 6, 5, 20)),
        ("Jan 3", "7-9pm", datetime(2027, 1, 4, 0), datetime(2027, 1, 4, 2)),
        ("Dec 3", "9 pm to 1 am", datetime(2026, 12, 4, 2), datetime(2026, 12, 4, 6)),
        ("6/5/2026", "noon", datetime(2026, 6, 5, 16), None),
        ("2026-06-05T19:30:00", "", datetime(2026, 6, 5, 23, 30), None),
    ],
)
def test_dates(spark, day, time, start, end):
    html = f'<div class=box><h2><a href="x?y=1">T</a></h2><p class=m>{day}</p><p class=t>{time}</p></div><div class=box><h2><a>no date</a></h2></div>'
    rows = spark.createDataFrame([("s", html), ("s", None), ("other", html)], "source string, html string")
    (got,) = layout_events(rows, date(2026, 2, 1), LAYOUT).collect()
    assert (got.title, got.start_time, got.end_time, got.location, got.url) == ("T", start, end, "Here", "https://s.org/x?y=1")


def test_known_tags_are_read_once(monkeypatch):
    tried, inner = [], Selectors.fitting
    monkeypatch.setattr(Selectors, "fitting", lambda self, tag, attrs: tried.append(tag) or inner(self, tag, attrs))
    selectors = Selectors(".box", PLACES)
    page = '<!doctype html><!-- no --><div class="a box"><script>a<b</script><h2><a href="x?a=1&amp;b">T<br/>&lt;</a></h2><p class=t>7 pm</p></div>'
    first = boxes(page, selectors)
    assert first == [{"title": ["T <"], "time": ["7 pm"]}] and tried == ["div", "script", "h2", "a", "br", "p"]
    assert boxes(page, selectors) == first and len(tried) == 6


@pytest.mark.parametrize("rest", ["", "<", "<p", "<!-- a", "<!-->", "<!---x-->", "<script>", "<script/>", "<p title='a>b'>", "<p x=a/>", "</ a>", "&am", "<style><p></style>", "</h2 >", "<P Class='t' class=m>x</P>"])
def test_pages_by_known_tags_and_by_the_parser(rest):
    for page in (HTML, HTML.replace("One", f"O{rest}ne"), HTML + rest):
        parsed = layouts._Page(Selectors(".box", PLACES))
        parsed.feed(page)
        parsed.close()
        read = layouts._Page(Selectors(".box", PLACES))
        assert not read.read(page) or read.boxes == parsed.boxes
        assert boxes(page, Selectors(".box", PLACES)) == boxes(page, SimpleSelectors(".box", PLACES))


class SimpleSelectors(Selectors):
    """Leaves each page to the parser."""

    def tag(self, inner):
        return None


def test_dates_are_parsed_once(spark):
    rows = spark.createDataFrame([("s", HTML)], "source string, html string")
    plan = layout_events(rows, date(2026, 2, 1), LAYOUT)._jdf.queryExecution().optimizedPlan().toString()
    parsed = [line for line in plan.splitlines() if "[0-9]+|[a-z]+" in line]
    assert not any("Filter" in line for line in parsed) and sum("add_months" in line for line in parsed) == 1
