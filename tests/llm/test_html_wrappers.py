"""Hosts whose layouts don't fit one wrapper."""

import re

from duesight.llm import html


def page(i, n=1):
    parts = "".join(f"<div class='c{i}-{k}'><b>x</b></div>" for k in range(n))
    return f"<html><body>{parts}<article><p>a {i}</p></article></body></html>"


def test_every_form_has_a_wrapper():
    streams = [html.symbols_of(html.tokens(page(i, n))) for i, n in enumerate([1] * 12 + [30])]
    found = html.generalised([html.folded(s) for s in streams], 20)
    assert len(found) > 2 and sorted(k for _, members in found for k in members) == list(range(13))
    for wrapper, members in found:
        pattern, symbols = html.compiled(wrapper)
        chars = {s: html.character(i) for i, s in enumerate(symbols)}
        assert all(re.fullmatch(pattern, "".join(chars[x] for x in streams[k])) for k in members)
        assert len(wrapper) <= 20 or members == [12]


def test_a_host_of_many_layouts_has_several_wrappers(spark):
    rows = [(i, "https://many.example.com/", page(i, 1 if i else 30)) for i in range(40)]
    rows += [(i, "https://one.example.com/", page(1)) for i in (40, 41)] + [(42, "https://many.example.com/", None), rows[3]]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for forms in (64, 4):
        assert html.wrappers(df, forms, 20).where("host LIKE 'many%'").count() > 2
        found = html.extracted(df, forms, 20).collect()
        assert sorted(r["page_id"] for r in found) == sorted(r[0] for r in rows)
        assert [r["page_id"] for r in found if not r["by_wrapper"]] == [42]
        assert {r["page_id"]: r["text"] for r in found} == {i: html.main_text(t)[0] for i, _, t in rows}


def test_hosts_whose_patterns_look_alike(spark):
    rows = [(i, f"https://h{i}.example.com/", page(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    assert all(r["by_wrapper"] for r in html.extracted(df).collect())


def test_symbols_beyond_the_last_character_share_it(monkeypatch):
    monkeypatch.setattr(html, "LAST", html.FIRST + 3)
    pattern, symbols = html.compiled(["a", "b", "c", "article", "d", "/article"])
    assert re.fullmatch(pattern, "".join(html.character(i) for i in range(len(symbols))))
