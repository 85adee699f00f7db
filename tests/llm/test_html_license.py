import random
import time
from itertools import pairwise

import pytest

from graphloom.llm.html_extract import extract, parse, render
from graphloom.llm.license_scan import DICE, UNIT, Scanner, scan, words
from graphloom.llm.license_templates import TEMPLATES


@pytest.mark.parametrize(
    ("source", "text"),
    [
        ("<p>a<p>b <b>c</b>  d", "a\n\nb c d"),
        ("<ul><li>x<li>y<ol start=3><li>z</ol></ul>", "- x\n- y\n  3. z"),
        ("<table><tr><td>aa<td>b<tr><td>c<td>dd</table>", "aa | b\nc  | dd"),
        ("<table><tr><td colspan=2>wide<td>x<tr><td>a<td>b<td>c</table>", "wide  | x\na | b | c"),
        ("a<br>b<hr>c", "a\nb\n\n---\n\nc"),
        ("<pre> q\n  w</pre>", " q\n  w"),
        ("<div hidden>n</div><span style='display: none'>n</span>y<script>1<2</script><style>p{}</style><!-- c -->", "y"),
        ("<details><summary>s</summary>body</details>", "s"),
        ("<head><title>T</title></head><body>1 &lt; 2 &amp; &eacute;</body>", "1 < 2 & é"),
        ("no tags < here", "no tags < here"),
        ("", ""),
        ("</p></div>x", "x"),
        ("<select><option>a<option>b</select>", "a\nb"),
        ("a <span aria-hidden=true>shown</span> <svg><desc>n</desc><text>drawn</text></svg> <math><mi>x</mi></math>", "a shown drawn x"),
        ("<table><tr><td rowspan=2>A<td>b1<td>c1<tr><td>b2<td>c2<tr><td>d</table>", "A | b1 | c1\n  | b2 | c2\nd"),
        ("<table><tr><td>a<td rowspan=9>b<tr><td>c</table>x", "a | b\nc\n\nx"),
        ("<a title='>' href=x>y</a> <b \" c>z</b> t<i class=", "y z t"),
        ("<div style='visibility: hidden'>a <b style='color:red; visibility:visible'>b</b> c</div>d", "b\nd"),
        ("<table><tr><td colspan=1000>a<td>b<tr><td>c<td rowspan=1000 colspan=1000>d</table>", "a     | b\nc | d"),
        (f"<table><tr><td>{'x' * 90}<td>a<tr><td>b<td>c</table>", f"{'x' * 90} | a\nb | c"),
        ("<table><td>" * 9 + "x" + "<tr><td>y", "x y"),
        ("<p>one<div>two<p>three</div>four</b>", "one\n\ntwo\n\nthree\n\nfour"),
    ],
)
def test_render(source, text):
    assert render(parse(source)) == text


def test_depth_is_free():
    assert render(parse("<div>" * 5000 + "x")) == "x"


@pytest.mark.parametrize("piece", ["<a ", "<div>", "<div x='", "</b><i>", "<!", "<p><span>", "<ul><li>", "<table><td>", '<a "', "<b><table><div></b>"])
def test_time_follows_length(piece):
    """A megabyte of what no page should hold; a quadratic reader would take minutes."""
    began = time.process_time()
    tree = parse(piece * (1_000_000 // len(piece)))
    assert time.process_time() - began < 25 and tree.tag == "#root"


WIDE = "w" * 20_000


@pytest.mark.parametrize(
    "source",
    [
        f"<table><tr><td>{WIDE}<td>y" + "<tr><td>a<td>b" * 8_000,
        "<table>" + "<tr><td rowspan=1000 colspan=1000>" * 20 + "<tr>" * 40_000,
        "<table>" + "<tr>" + "<td rowspan=1000>x" * 3_000 + "<tr><td>y" * 10_000,
        "<table>" + "<tr><td colspan=1000>" * 10_000 + "<tr>" + "<td>abcdefgh" * 2_000,
        "<ul><li>x" * 20_000,
        "<blockquote>x" * 20_000,
        "<table><td>x" * 10_000,
        "<table><tr>" + "<td>" + "z" * 70 + "<td>a" * 3_000 + "<tr><td>a" * 3_000,
    ],
)
def test_text_follows_length(source):
    began = time.process_time()
    text = render(parse(source))
    assert len(text) <= 12 * len(source) and time.process_time() - began < 25


@pytest.mark.parametrize("tail", ["", " and in addition some words that no template has", "\n" + TEMPLATES["MIT"][-60:]])
def test_licence_time_follows_length(tail):
    """A template, and then one of its units for a megabyte."""
    s, text = Scanner(TEMPLATES, DICE), TEMPLATES["MIT"] + "\npermission is hereby granted" * 36_000 + tail
    began = time.process_time()
    found = s.scan(text)
    assert time.process_time() - began < 60 and found[0]["license"] == "MIT"


def test_extract_frame(spark):
    rows = [(1, "<title> T  t</title><p>x", "keep"), (1, "<title> T  t</title><p>x", "keep"), (None, None, None)]
    got = extract(spark.createDataFrame(rows, "page_id long, html string, text string")).select("page_id", "text", "page.title", "page.text").collect()
    assert [tuple(r) for r in got] == [(1, "keep", "T t", "x"), (1, "keep", "T t", "x"), (None, None, "", "")]
    assert extract(spark.createDataFrame([], "page_id long, html string")).count() == 0


def test_licences_found_and_pruned():
    s = Scanner(TEMPLATES, DICE)
    for name, text in TEMPLATES.items():
        found = s.scan(f"some prose that is of no licence at all\n{text}\nand more of the same prose")
        assert [m["license"] for m in found] == [name], name
    assert s.scan("the software of the author and the license of the file") == []
    bare = "Licensed under the Apache License, Version 2.0."
    assert s.scan(bare.upper())[0]["dice"] == 1.0 and [m["license"] for m in s.scan(f"{bare}\n{bare}")] == ["Apache-2.0-notice"] * 2
    for n in range(1, 60):  # bounds lose nothing
        near = set(s.near(n))
        assert all(2 * min(n, m) / (n + m) < DICE for m, name in s.sizes if name not in near)


def test_dice_against_brute_force():
    s = Scanner({"t": "a b c d e f g h i j"}, 0.8)
    assert s.scan("a b c d e f g h i k")[0]["dice"] == pytest.approx(2 * 8 / 18)
    assert s.scan("a b c x y z") == []


def test_unknown_words_count_each():
    s = Scanner({"t": "a b c d e f g h i j"}, 0.5)
    assert s.scan("a b c d e f g h i j u v w x")[0]["dice"] == pytest.approx(2 * 9 / (9 + 13))
    assert s.scan("a b c d e u\nf g h i j")[0]["dice"] == pytest.approx(2 * 8 / (9 + 10))  # u f is a bigram, too


def test_notices_with_insertions():
    s, tokens = Scanner(TEMPLATES, DICE), TEMPLATES["MIT"].split()
    lines = TEMPLATES["MIT"].split("\n")
    for text in ("\n".join([lines[0], "Page 3 of the printed manual of 2011", *lines[1:]]), " ".join([*tokens[:60], "quux.", *tokens[60:]])):
        assert [m["license"] for m in s.scan(f"Some prose first.\n{text}\nAnd prose after it.")] == ["MIT"]


def brute_force(templates: dict[str, str], text: str) -> float:
    """The best Dice over all stretches of units and all templates."""
    units, best = [words(x) for x in UNIT.split(text)], 0.0
    sets = [set(pairwise(words(t))) for t in templates.values()]
    for i in range(len(units)):
        for j in range(i + 1, len(units) + 1):
            w = [x for u in units[i:j] for x in u]
            own = set(pairwise(w))
            best = max([best, *(2 * len(own & t) / (len(own) + len(t)) for t in sets)])
    return best


def test_best_stretch_against_brute_force():
    r = random.Random(5)
    templates = {"t": "a b c d e f g h i j k l", "u": "c d a f b", "v": "x a"}
    for dice in (0.5, 0.8):
        s = Scanner(templates, dice)
        for _ in range(1500):
            parts = [r.choice(("a b c", "d e f g", "h i j k l", "c d a", "f b", "x a", "q", "q r", "q r s t", "", "a", "e f", "the a b")) for _ in range(r.randint(1, 12))]
            text = "\n".join(parts) if r.random() < 0.7 else "\n".join(["a b c d e", *r.sample(parts, len(parts) // 3), "f g h i j k l", *parts])
            found, best = s.scan(text), brute_force(templates, text)
            assert max((m["dice"] for m in found), default=0) == pytest.approx(best if best >= dice else 0), text


def test_scan_frame(frame):
    got = scan(frame([(1, "All rights reserved.", 5), (None, None, 6), (2, "", 7)], "doc_id long, text string, c int")).collect()
    assert [[m["license"] for m in r["licenses"]] for r in got] == [["proprietary"], [], []]
    assert scan(frame([])).count() == 0
