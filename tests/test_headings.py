"""Headings recovered from navigation and from type size."""

from ledgerspark.sources.headings import MOST_HEADINGS, recovered
from ledgerspark.sources.html import to_markdown

NAV = '<ul><li><a href="#risk">Principal risks</a></li></ul>'


def test_navigation():
    body = '<div id="risk">Text of risks.</div>'
    assert "## Principal risks\n\nText of risks." in to_markdown(NAV * 3 + body)
    assert "##" not in to_markdown(NAV * 2 + body)
    assert to_markdown(NAV * 3 + '<h2 id="risk">Risks</h2>').count("##") == 1
    assert "##" not in to_markdown('<a href="#risk">see page</a>' * 3 + body)
    assert "##" not in to_markdown(NAV * 3 + "<div>No target.</div>")
    many = "<h3>One</h3>" * (MOST_HEADINGS + 1)
    assert "## Principal" not in to_markdown(NAV * 3 + many + body)
    assert "## Principal" in to_markdown(NAV * 3 + many[: -len("<h3>One</h3>")] + body)


def test_the_most_common_words_win():
    html = '<a href="#x">Strategy</a>' * 2 + '<a href="#x">Our strategy</a>' * 3 + '<p id="x">Body</p>'
    assert "## Our strategy" in to_markdown(html)


def test_type_size():
    style = "<style>.fa{font-size:96px}.fb{font-size:72pt}.fc{font-size:40px}.fd{font-size:120px}</style>"
    page = '<div class="pf"><div class="t fa">Strategic</div><div class="t fb">report</div><div class="t fc">Small text.</div><div class="t fd">Governance</div></div>'
    text = to_markdown(style + page)
    assert "## Strategic report" in text and "## Governance" in text and text.count("Strategic") == 1
    assert text.index("## Strategic report") < text.index("Small text.") < text.index("## Governance")
    assert "## Governance Governance" not in to_markdown(style + '<div class="t fd">Governance</div><div class="t fd">Governance</div>')
    assert "##" not in to_markdown(style + '<div class="t fa">2024 results</div>') + to_markdown(style + '<table><tr><td><div class="t fa">In a table</div></td></tr></table>')
    twice = to_markdown(style + '<div class="t fa">Outlook</div><p>a</p><div class="t fc">x</div><div class="t fa">OUTLOOK</div>')
    assert twice.count("## ") == 1 and "OUTLOOK" in twice
    assert recovered(style + '<div class="t fa">Line</div>' * 301) == ({}, set())


def test_an_open_head_ends_at_the_body():
    assert to_markdown("<html><head><title>T</title><body><p>Seen</p>") == "Seen"
    assert to_markdown("<html><head><title>T</title><p>Seen</p>") == "Seen"
    assert to_markdown("<html><head><title>T</title></head><body>Seen</body></html>") == "Seen"
