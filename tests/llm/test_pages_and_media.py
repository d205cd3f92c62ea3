from __future__ import annotations

import io
import random
import wave

import numpy as np
import pyarrow as pa
import pytest

from lodestar.llm import chroma
from lodestar.llm.markup import extract_text, render

PAGES = [
    ("", ""),
    ("plain  text\n here", "plain text here"),
    ("<p>a<p>b &amp; c", "a\n\nb & c"),
    ("<ul><li>x<li>y<ol start=3><li>1<li value=9>2<li>3</ol></ul>after", "* x\n* y\n  3. 1\n  9. 2\n  10. 3\n\nafter"),
    ("<table><tr><th>name<th>n<tr><td>a long one<td>1<tr><td colspan=2>both<td>z</table>", "name        n\na long one  1\nboth           z"),
    ("<div>a<div hidden>no<p>no</div><span style='display: none'>no</span>b</div>", "ab"),
    ("<script>var a='</p>'</script><style>p{}</style><title>t</title><p>x<noscript>no</noscript>", "x"),
    ("<pre>\n a\n   b</pre>c", " a\n   b\n\nc"),
    ('<a title="x>y" href=\'q>"r\'>link</a> 1 < 2', "link 1 < 2"),
    ("a<br>b<br/>c</p>d", "a\nb\nc\n\nd"),
    ("<blockquote>q<p>r</blockquote>s", "  q\n\n  r\n\ns"),
    ("<b>bold<p>para</b> rest</p>", "bold\n\npara rest"),
    ("<!-- c > --><!DOCTYPE html>x<!-- open", "x"),
    ("<dl><dt>t<dd>d<dt>u</dl>", "t\n  d\nu"),
    ("<textarea><b>raw</textarea><input type=submit value=Go><input value=no>", "<b>raw\n\nGo"),
    ("<td>loose</td><td>cells</td>", "  loose\n  cells"),
    ("<select><option>no</select><dialog>no</dialog><dialog open>yes</dialog>", "yes"),
    ("&lt;p&gt; &nbsp;x &unknown; &#x41;", "<p> \xa0x &unknown; A"),
    ("<table><caption>cap</caption><tr><td>a<table><tr><td>in</table></table>", "cap\na\n\nin"),
    ("unclosed <a href='x", "unclosed"),
]


@pytest.mark.parametrize("page,text", PAGES)
def test_layout(page, text):
    assert render(page) == text


def test_pages_table(spark):
    df = spark.createDataFrame([(k, p, "t") for k, (p, _) in enumerate(PAGES)] + [(99, None, "t"), (1, PAGES[1][0], "t")], "page_id long, html string, text string")
    got = [tuple(r) for r in extract_text(df).collect()]
    assert sorted(got) == sorted([(k, t) for k, (_, t) in enumerate(PAGES)] + [(99, ""), (1, PAGES[1][1])])
    assert extract_text(df.limit(0)).count() == 0


def test_odd_pages_take_no_time():
    for page in ("<div>" * 50000 + "x", '<a "' * 30000, '<a b="' * 20000 + ">x", "<" * 50000, "&" * 50000, "<p>" * 30000 + "x", "</p>" * 30000, "<!--" * 20000, "<script>" * 20000, "x" * 2_000_000):
        render(page)
    r = random.Random(0)
    tags = ["<p>", "</p>", "<li>", "<ul>", "</ul>", "<table>", "<tr>", "<td>", "</table>", "x", " ", "<b>", "</b>", "<div hidden>", "</div>", "<br>", "<ol>", "&lt;", "<", "<pre>", "</pre>"]
    for _ in range(500):
        render("".join(r.choices(tags, k=40)))


def melody(r, seconds):
    t = np.arange(int(0.08 * chroma.RATE)) / chroma.RATE
    notes = [sum(np.sin(2 * np.pi * 220 * 2 ** (n / 12) * t) for n in r.integers(0, 24, 2)) for _ in range(int(seconds / 0.08))]
    x = np.concatenate(notes)
    return np.clip(128 + 50 * x, 0, 255).astype(np.uint8)


def wav(x, width=1):
    out = io.BytesIO()
    with wave.open(out, "wb") as w:
        w.setnchannels(1)
        w.setsampwidth(width)
        w.setframerate(chroma.RATE)
        w.writeframes(x.tobytes())
    return out.getvalue()


def test_samples_of_files():
    x = melody(np.random.default_rng(0), 0.2)
    assert np.array_equal(chroma.samples(wav(x)), chroma.samples(x.tobytes()))
    wide = ((x.astype(np.int32) - 128) * 256).astype("<i2")
    assert np.allclose(chroma.samples(wav(wide, 2)), chroma.samples(x.tobytes()))
    assert len(chroma.samples(b"RIFFbroken")) == 10 and len(chroma.samples(b"")) == 0


def test_codes_match_a_plain_version():
    """One frame, one area and one bit at a time; and the same whatever is computed beside it."""
    r = np.random.default_rng(1)
    parts = [chroma.samples(melody(r, s).tobytes()) for s in (0.3, 0.1, 0.5)] + [np.zeros(3000, np.float32), np.zeros(0, np.float32)]
    packed, n, frames = chroma.codes(parts)
    at = 0
    for k, p in enumerate(parts):
        alone, m, f = chroma.codes([p])
        assert m[0] == n[k] and f[0] == frames[k] and np.array_equal(alone, packed[at : at + n[k]])
        rows, _ = chroma.image([p])
        for t in range(int(n[k])):
            code = 0
            for j, (kind, y, h, w) in enumerate(chroma.FILTERS):
                area = rows[t : t + w, y : y + h]
                whole = area.sum()
                one = {0: whole, 1: area[:, h // 2 :].sum(), 2: area[w // 2 :].sum(), 3: area[: w // 2, h // 2 :].sum() + area[w // 2 :, : h // 2].sum(), 4: area[:, h // 3 : 2 * (h // 3)].sum(), 5: area[w // 3 : 2 * (w // 3)].sum()}[kind]
                two = rows[t : t + w].sum() - whole if kind == 0 else whole - one
                v = np.log((1.0 + one) / (1.0 + two))
                code |= int(chroma.GRAY[np.searchsorted(chroma.QUARTILES[j], v, side="right")]) << (2 * j)
            assert code == packed[at + t]
        at += n[k]


def plain_alignment(rows):
    """By the definition: first places of integers, votes, the peak, and bit errors."""
    codes = {i: [int(x) for x in chroma.codes([chroma.samples(m or b"")])[0]] for i, m in rows if i is not None}
    home = {i: min(j for j, c in codes.items() if c == codes[i]) for i in codes if codes[i]}
    first = {}
    runs = {i: [(t, v) for t, v in enumerate(codes[i]) if t == 0 or codes[i][t - 1] != v] for i in sorted(set(home.values()))}
    for i, steps in runs.items():
        for t, v in steps:
            first.setdefault(v, (i, t))
    out = {}
    for i in codes:
        rep, best = home.get(i), None
        votes = {}
        for t, v in runs.get(rep, []):
            j, s = first[v]
            if j != rep:
                votes[j, t - s] = votes.get((j, t - s), 0) + 1
        if votes:
            (j, d), n = min(votes.items(), key=lambda x: (-x[1], x[0]))
            begin, end = max(0, d), min(len(codes[rep]), len(codes[j]) + d)
            wrong = sum((codes[rep][t] ^ codes[j][t - d]).bit_count() for t in range(begin, end))
            if n >= chroma.MIN_VOTES and 100 * wrong <= chroma.MAX_ERRORS * 32 * (end - begin):
                best = (j, d, n, end - begin, wrong)
        out[i] = (rep, *(best or (None,) * 5))
    return out


def test_alignment(spark):
    r = np.random.default_rng(5)
    song, other = melody(r, 2.0), melody(r, 1.5)
    shift = chroma.HOP * 40
    rows = [(3, song.tobytes()), (8, song[shift:].tobytes()), (5, wav(song)), (9, np.concatenate([other, song[: shift * 3]]).tobytes()), (4, other.tobytes()), (6, None), (7, b""), (10, b"\x80" * 5000), (11, b"\x80" * 6000), (None, song.tobytes()), (4, other.tobytes())]
    df = spark.createDataFrame([(i, m, 1) for i, m in rows], "id long, m binary, votes int")
    got = [tuple(x) for x in chroma.align(df, "id", "m").collect()]
    expected = plain_alignment(rows)
    assert expected[8][1:3] == (3, -40) and expected[5][0] == 3
    assert len(got) == len(rows)
    for i, _, n, _, *rest in got:
        assert tuple(rest) == (expected[i] if i is not None else (None,) * 6), i
    assert chroma.align(df.limit(0), "id", "m").count() == 0


def test_smaller_ids_with_the_same_integers_hide_no_alignment(spark, monkeypatch):
    """Recording 1 has the integers of 2 and 3 at scattered times; all pairs of places give the peak."""
    r = np.random.default_rng(8)
    song, step = melody(r, 2.0), chroma.HOP * 30
    cuts = [song[k : k + step + chroma.FRAME + chroma.WIDTH * chroma.HOP] for k in range(0, len(song) - step, step)]  # nearly every integer of song is in one
    rows = [(1, np.concatenate([cuts[k] for k in r.permutation(len(cuts) - 1)])), (2, song), (3, np.concatenate([melody(r, 1.0)[: 3 * step], song]))]
    df = spark.createDataFrame([(i, m.tobytes()) for i, m in rows], "id long, m binary")
    runs = {i: [(t, v) for t, v in enumerate(c) if t == 0 or c[t - 1] != v] for i, c in ((i, chroma.codes([chroma.samples(m.tobytes())])[0].tolist()) for i, m in rows)}
    votes = {}
    for t, v in runs[3]:
        for j in (1, 2):
            for s, w in runs[j]:
                if v == w:
                    votes[j, t - s] = votes.get((j, t - s), 0) + 1
    (ref, offset), n = max(votes.items(), key=lambda x: x[1])
    assert ref == 2 and n > 100
    for hot in (1000, 1):
        monkeypatch.setattr(chroma, "HOT", hot, raising=False)
        got = {x["id"]: x for x in chroma.align(df, "id", "m").collect()}
        assert (got[3]["aligned_to"], got[3]["offset"], got[3]["bit_errors"]) == (2, offset, 0)
        assert got[1]["aligned_to"] is None and got[2]["aligned_to"] == 1


@pytest.mark.parametrize(
    "page,text",
    [
        ("<p>so <math><mi>x</mi><mo>=</mo><mn>2</mn><annotation>no</annotation></math> holds", "so x=2 holds"),
        ("a<svg><title>no</title><desc>no</desc>no<g><text>north</text><text>so<tspan>uth</tspan></text></g></svg>b", "a\nnorth\nsouth\nb"),
        ("<svg hidden><text>no</text></svg><svg><g style='display:none'><text>no</text></g><defs><text>no</text></defs></svg>x", "x"),
        ("<xmp>\n<b>a &amp;\n  c</xmp>d", "<b>a &amp;\n  c\n\nd"),
        ("<object data=x><p>instead</p></object>", "instead"),
    ],
)
def test_formulas_labels_listings_and_fallbacks_show(page, text):
    assert render(page) == text


INLINE = ("b", "i")


def random_tree(r, depth, inside=None):
    """Children: strings, ("br",) or (tag, children); tables have rows of cells."""
    out = []
    for _ in range(r.randrange(1, 4)):
        kind = r.choice(["text", "text", "b", "br"] + (["div", "p", "ul", "ol", "table", "blockquote", "hidden", "pre"] if depth else []))
        if kind == "text":
            out.append(r.choice(["one", " two  three", "four ", "\n five\n", "&amp;six"]))
        elif kind == "br":
            out.append(("br", []))
        elif kind == "b":
            out.append(("b", [r.choice(["bold", " b c "])]))
        elif kind == "p":
            out.append(("p", [r.choice(["para", "para graph "]), ("b", ["x"])]))
        elif kind in ("ul", "ol"):
            out.append((kind, [("li", random_tree(r, depth - 1)) for _ in range(r.randrange(1, 4))]))
        elif kind == "table":
            out.append((kind, [("tr", [(r.choice(["td", "th"]), random_tree(r, 0)) for _ in range(r.randrange(1, 4))]) for _ in range(r.randrange(1, 4))]))
        elif kind == "pre":
            out.append((kind, ["a  b\n  c"]))
        else:
            out.append((kind, random_tree(r, depth - 1)))
    return out


def markup_of(nodes, r=None):
    """As HTML; with r, end tags that may be left out are left out at random."""
    out = ""
    for k, node in enumerate(nodes):
        if isinstance(node, str):
            out += node
            continue
        tag, kids = node
        if tag == "br":
            out += "<br>"
        elif tag == "hidden":
            out += f"<div hidden>{markup_of(kids, r)}</div>"
        else:
            after = nodes[k + 1] if k + 1 < len(nodes) else None
            last = after is None or (not isinstance(after, str) and after[0] in ("p", "div", "ul", "ol", "table", "pre", "blockquote"))
            bare = r is not None and r.random() < 0.7 and (tag in ("li", "tr", "td", "th") or (tag == "p" and after is not None and last))
            out += f"<{tag}>{markup_of(kids, r)}" + ("" if bare else f"</{tag}>")
    return out


def plain_layout(nodes, items=False):
    """Lines of a container, by the rules: one walk over its tree, cells and items by themselves."""
    lines, inline, gap = [], [""], [False]

    def put(line, blank_too=False):
        if line or blank_too:
            if gap[0] and lines:
                lines.append("")
            lines.append(line)
            gap[0] = False

    def flush():
        for line in inline[0].split("\n"):
            put(" ".join(line.split()))
        inline[0] = ""

    def edge(margin):
        flush()
        gap[0] |= margin

    def walk(nodes, nested):
        number = 0
        for node in nodes:
            if isinstance(node, str):
                inline[0] += node.replace("\n", " ").replace("&amp;", "&")
                continue
            tag, kids = node
            if tag == "br":
                inline[0] += "\n"
            elif tag == "b":
                walk(kids, nested)
            elif tag == "hidden":
                pass
            else:
                margin = tag in ("p", "ul", "ol", "table", "blockquote", "pre") and not (tag in ("ul", "ol") and nested)
                edge(margin)
                if tag == "pre":
                    for line in kids[0].split("\n"):
                        put(line, True)
                elif tag in ("ul", "ol"):
                    for _, item in kids:
                        number += 1
                        mark = "* " if tag == "ul" else f"{number}. "
                        edge(False)
                        for k, line in enumerate(plain_layout(item, True)):
                            put((mark if not k else " " * len(mark) if line else "") + line, True)
                    number = 0
                elif tag == "table":
                    rows = [[plain_layout(cell, nested) for _, cell in row] for _, row in kids]
                    wide = [max((len(x) for row in rows if c < len(row) for x in row[c]), default=0) for c in range(max(map(len, rows)))]
                    for row in rows:
                        for k in range(max((len(c) for c in row), default=0)):
                            put("  ".join((c[k] if k < len(c) else "").ljust(wide[j]) for j, c in enumerate(row)).rstrip(), True)
                elif tag == "blockquote":
                    for line in plain_layout(kids, nested):
                        put("  " + line if line else "", True)
                else:
                    walk(kids, nested)
                edge(margin)

    walk(nodes, items)
    flush()
    return lines


def test_layout_against_a_plain_version():
    r = random.Random(6)
    for _ in range(1500):
        tree = random_tree(r, 3)
        expected = "\n".join(plain_layout(tree))
        assert render(markup_of(tree)) == expected, markup_of(tree)
        assert render(markup_of(tree, r)) == expected


@pytest.mark.parametrize("start", ["<p><button>" + "<div>" * 40_000, "<li>" * 40_000, "<ul><li>x" * 20_000, "<table><tr><td>x" * 20_000, "<blockquote>x" * 40_000, "<dl><dt>" * 30_000 + "<dd>x"])
def test_deep_pages_take_time_in_proportion(start):
    import time

    began = time.time()
    text = render(start + "end")
    assert time.time() - began < 20 and text.endswith("end") and len(text) < 100 * len(start)


def test_cells_over_rows_and_long_cells():
    page = "<table><tr><td rowspan=2>a<td>b<td>c<tr><td>dd<td>e<tr><td>f<td>g<td>h</table>"
    assert render(page) == "a  b   c\n   dd  e\nf  g   h"
    assert render(f"<table><tr><td>{'x' * 100}<td>b<tr><td>y<td>c</table>") == f"{'x' * 100}  b\ny{' ' * 81}c"


def test_recordings_of_one_id_are_aligned_each_by_itself(spark):
    """Id 1 has two recordings; whatever the order of the rows, 3 and 4 align to the one that they hold."""
    r = np.random.default_rng(12)
    one, two = melody(r, 1.5).tobytes(), melody(r, 1.5).tobytes()
    cut = chroma.HOP * 20
    rows = [(1, one), (1, two), (3, two[cut:]), (4, one[cut:]), (0, melody(r, 0.5).tobytes())]
    results = set()
    for order in ([0, 1, 2, 3, 4], [1, 0, 4, 3, 2], [3, 2, 1, 0, 4]):
        got = chroma.align(spark.createDataFrame([rows[k] for k in order], "id long, m binary").repartition(3), "id", "m").collect()
        results.add(tuple(sorted(tuple(str(v) for v in x) for x in got)))
        found = {x["id"]: x for x in got}
        assert [(found[k]["aligned_to"], found[k]["offset"], found[k]["bit_errors"]) for k in (3, 4)] == [(1, -20, 0)] * 2
    assert len(results) == 1


def test_planted_cuts_are_found(spark):
    """Cuts of one of 25 recordings, with noise: at least nine of ten align to it at the right offset."""
    r = np.random.default_rng(21)
    songs = [melody(r, 2.0) for _ in range(25)]
    rows = [(k, s.tobytes()) for k, s in enumerate(songs)]
    planted = {}
    for k, s in enumerate(songs):
        a = int(r.integers(10, 100))
        noisy = np.clip(s[a * chroma.HOP :].astype(int) + r.integers(-2, 3, len(s) - a * chroma.HOP), 0, 255).astype(np.uint8)
        planted[100 + k] = (k, -a)
        rows.append((100 + k, noisy.tobytes()))
    got = {x["id"]: (x["aligned_to"], x["offset"]) for x in chroma.align(spark.createDataFrame(rows, "id long, m binary"), "id", "m").collect()}
    assert sum(got[k] == v for k, v in planted.items()) >= 0.9 * len(planted)


def test_votes_are_counted_where_they_are_cast(spark, monkeypatch):
    """Near copies share many places; still no table that is written holds more rows than there are recordings."""
    r = np.random.default_rng(12)
    song = melody(r, 0.8)
    rows = [(i, np.concatenate([song[: -(-chroma.HOP * i)] if i else song, melody(r, 0.2)]).tobytes()) for i in range(40)]
    df = spark.createDataFrame(rows, "id long, m binary")
    written, write = [], chroma.materialize
    monkeypatch.setattr(chroma, "materialize", lambda t, *a: written.append(write(t, *a)) or written[-1])
    found = []
    for few in (100_000, 1000):
        monkeypatch.setattr(chroma, "FEW_CODES", few)
        found.append(sorted(tuple(x) for x in chroma.align(df, "id", "m").collect()))
        assert max(t.count() for t in written) <= len(rows)
    assert found[0] == found[1] and sum(x[5] is not None for x in found[0]) > 20


@pytest.mark.parametrize("pairs", [7, 1 << 21])
def test_votes_in_parts(monkeypatch, pairs):
    """Votes of a block counted a few at a time, from its own recordings and others, against all pairs of places."""
    monkeypatch.setattr(chroma, "PAIRS", pairs)
    r = np.random.default_rng(4)
    tune = r.integers(0, 9, 30) * 0x01010101
    docs = [np.concatenate([r.integers(0, 9, 5) * 0x01010101, tune[r.integers(0, 8) :], r.integers(0, 9, r.integers(0, 6)) * 0x01010101]).astype(np.int32).tolist() for _ in range(12)]
    lo = [0, 1, 2, 3, 4, 5, 5, 7, 8, 9, 10, 11]
    runs = [[(t, v) for t, v in enumerate(d) if not t or d[t - 1] != v] for d in docs]
    expected = {}
    for c in range(4, 12):
        votes = {}
        for t, v in runs[c]:
            for ref in range(lo[c]):
                for s, w in runs[ref]:
                    if v == w:
                        votes[ref, t - s] = votes.get((ref, t - s), 0) + 1
        for (ref, d), n in sorted(votes.items(), key=lambda x: (-x[1], x[0])):
            begin, end = max(0, d), min(len(docs[c]), len(docs[ref]) + d)
            wrong = sum((docs[c][t] ^ docs[ref][t - d]).bit_count() for t in range(begin, end))
            if n >= chroma.MIN_VOTES and 100 * wrong <= chroma.MAX_ERRORS * 32 * (end - begin):
                expected[c] = (ref, d, end - begin, wrong)
                break
    order = [*range(4, 12), *range(4)]
    columns = [pa.array([c < 4 for c in order]), pa.array(order), pa.array([lo[c] for c in order]), pa.array([docs[c] for c in order], pa.list_(pa.int32()))]
    batch = pa.RecordBatch.from_arrays(columns, names=["other", "c", "lo", "codes"])
    got = {x[0]: x[1:] for cut in ([0, 12], [0, 5, 9, 12]) for out in chroma._aligned(batch.slice(a, b - a) for a, b in zip(cut, cut[1:])) for x in zip(*out.to_pydict().values())}
    assert got == expected and len(got) > 4
    assert not list(chroma._aligned([batch.slice(8)]))  # an empty block
