"""Personal data and page texts against plain versions."""

from __future__ import annotations

import random
import re

import pytest

from tapewright.llm import html_text, pii

PLAIN = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def plain_spans(text):
    out = []
    for k, (kind, p) in enumerate(PLAIN.items()):
        for m in re.finditer(p, text):
            d = re.sub(r"\D", "", m[0])
            luhn = sum(int(c) if i % 2 == 0 else sum(divmod(2 * int(c), 10)) for i, c in enumerate(reversed(d))) % 10 == 0
            if kind == "email" or kind == "ip" and all(int(x) < 256 for x in m[0].split(".")) or kind == "card" and 14 <= len(d) <= 19 and luhn or kind == "phone" and 10 <= len(d) <= 15:
                out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    rng = random.Random(1)
    bits = ["a", "b.", "@", "@@", "x.y", "-", "1", "255", "256", ".", "1.2.3.4", "0001.2.3.004", "+1", "+", "(555)", " ", "4111 1111 1111 1111", "4111-1111-1111-1112", "é", "\n", "mail@host.org", "%"]
    for _ in range(4000):
        t = "".join(rng.choice(bits) for _ in range(rng.randrange(14)))
        assert pii.base_spans(t) == plain_spans(t), t


def test_long_runs_are_fast():
    for t in ("a" * 200_000, "1" * 200_000, "@" * 100_000, "1." * 100_000, "+1" * 100_000, "1 " * 100_000, "a@a" * 50_000):
        assert isinstance(pii.base_spans(t), list) and isinstance(pii.look_alikes(t, []), list)


def test_contexts_find_what_the_patterns_miss(spark):
    docs = [(k, f"words here please call Maria +1 (555) 010-{1000 + k} soon") for k in range(12)]
    docs += [(100, "so please call Maria 555-010-4242, she said"), (101, "the number of 555-010-4242 things"), (102, None), (103, ""), (None, "10.0.0.1"), (104, "x" * 50_000)]
    df = spark.createDataFrame([(*d, 1) for d in docs], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.find_pii(df).collect()}
    assert len(got) == len(docs)
    assert got[100].spans == "phone:21:33" and got[100].base == "" and got[100].n_phone == 0
    assert got[101].spans == "" and got[102].spans == "" and got[None].spans == got[None].base == "ip:0:8"
    assert all(got[k].n_phone == 1 and got[k].spans == got[k].base for k in range(12))
    assert pii.find_pii(df.limit(0)).count() == 0


def test_forms_of_look_alikes():
    def found(text):
        return [(pii.KINDS[k], text[a:b]) for a, k, b in pii.look_alikes(text, pii.base_spans(text))]

    assert found("call me at (743) 555-3824.") == [("phone", "(743) 555-3824")]
    assert found("phone: 555 010 4242") == [("phone", "555 010 4242")]
    assert found("4111 1111 1111 1112 is mine") == [("card", "4111 1111 1111 1112")]
    assert found("ann (at) host.org, bob@localhost") == [("email", "ann (at) host.org"), ("email", "bob@localhost")]
    assert found("ssn 123-45-6789 of 2024-05-12, hex a1234567890b, 12345678x") == []
    assert found("4465758382889437 4465758382889437") == [("card", "4465758382889437")] * 2
    assert found("+1 (555) 010-1000 5550104242") == [("phone", "010-1000"), ("phone", "5550104242")]
    assert found("") == []


def test_contexts_on_both_sides():
    text = "phone: 5550104242 -- is, Mine! " + "y" * 70
    left, right, one, both = pii.Contexts(text).patterns(7, 17)
    assert (left, right, one, both) == ("^ phone _", "_ is mine", "phone _", "phone _ is")
    assert pii.Contexts("5550104242").patterns(0, 10) == ["^ _", "_ $", "^ _", "^ _ $"]
    assert len(pii.Contexts(text).patterns(25, 29)[1]) < 70


def test_second_round_finds_what_the_first_cannot(spark):
    """A pattern that only holds discovered numbers is trusted after they are, and then finds one more."""
    docs = [f"note {k} please call Maria +1 (555) 010-{1000 + k} q{k} z" for k in range(12)]
    docs += [f"note {k} please call Maria 555-020-{1000 + k} w{k} z" for k in range(3)]
    docs += [f"v{k} my old mobile 555 020 {1000 + k} u{k} z" for k in range(3)]
    docs += ["and my old mobile (555) 020-9999 r z", "a plain number of 555-020-7777 things"]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")

    def found(rounds):
        rows = pii.find_pii(df, rounds=rounds, least_seeds=2.5, least_confidence=0.6).collect()
        return {r.doc_id for r in rows if r.spans != r.base}

    assert found(1) == {12, 13, 14}
    assert found(3) == {12, 13, 14, 15, 16, 17, 18}


def test_edges_that_tell_nothing_are_left_out(spark):
    rows = [(0, "a", f"i{k}", 1, k > 0) for k in range(4)] + [(0, "b", f"i{k}", 1, True) for k in range(9)] + [(0, "c", f"i{k}", 1, False) for k in range(3)]
    df = spark.createDataFrame(rows, "kind int, pattern string, instance string, n long, base boolean")
    assert sorted(map(tuple, pii.live_edges(df).collect())) == [r for r in rows if r[1] == "a"]


def test_scores_of_patterns_by_plain_python(spark):
    rng = random.Random(4)
    edges = {(rng.randrange(2), f"p{rng.randrange(12)}", f"i{rng.randrange(40)}"): rng.randrange(1, 9) for _ in range(220)}
    seeds = {(k, f"i{i}") for k in range(2) for i in range(22)}
    rows = [(k, p, i, n, (k, i) in seeds) for (k, p, i), n in edges.items()]
    belief = {(k, i): float((k, i) in seeds) for k, _, i, _, _ in rows}
    for turn in range(3):
        trusted = {}
        for key in {(k, p) for k, p, *_ in rows}:
            mine = [(n, belief[k, i]) for k, p, i, n, _ in rows if (k, p) == key]
            share = sum(n * b for n, b in mine) / sum(n for n, _ in mine)
            if sum(b for _, b in mine) >= 4 and share >= 0.5:
                trusted[key] = share
        for k, i in belief:
            wrong = 1.0
            for k2, p, i2, _, _ in rows:
                if (k2, i2) == (k, i) and (k, p) in trusted:
                    wrong *= 1 - pii.TRUST * trusted[k, p]
            belief[k, i] = max(belief[k, i], 1 - wrong)
    df = spark.createDataFrame(rows, "kind int, pattern string, instance string, n long, base boolean")
    got = {(r.kind, r.pattern): r.confidence for r in pii.trusted_patterns(df, rounds=3, least_seeds=4, least_confidence=0.5).collect()}
    assert got.keys() == trusted.keys() and all(abs(got[k] - trusted[k]) < 1e-9 for k in got)


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body>
<header><a href="/">Site</a></header><nav><ul><li><a href=x>Menu</a></ul></nav><div class="cookie-notice">We use cookies, many, many, of them.</div>
<div id=wrap><div class="content"><h1>A   title &amp; more</h1><p>First, <b>bold</b> words,
 with a long enough sentence to count, and more.<p>Second one, not closed, also long enough to say a thing or two.<br>After a break.</p>
<aside>Related: nothing, of, note, here, really, at all, indeed</aside><p>Short.</p><form><p>Sign up, please, for our letter, now</p></form></div>
<div class="sidebar"><p>Side words, that are quite long, with commas, and so on, and on.</p></div></div>
<div class="comments"><p>A reader, who says, many things, with many commas, and words.</p></div><footer>&copy; us</footer><!-- <p>gone</p> --></body></html>"""


def test_main_text():
    assert html_text.main_text(PAGE).split("\n\n") == [
        "A title & more", "First, bold words, with a long enough sentence to count, and more.",
        "Second one, not closed, also long enough to say a thing or two. After a break.", "Short.",
    ]


LONG = "A paragraph of the article, long enough to count, with commas, and with a few more words."


@pytest.mark.parametrize("around", ["div", "article"])
@pytest.mark.parametrize("name", "comments post-comments story-comments entry-footer main-menu main-nav article-sidebar content-ads postComments comment-list cookie-law-info".split())
def test_named_blocks_go(around, name):
    page = f"<body><{around}><h1>Title</h1><p>{LONG}</p><div class='x {name}'><p>Others say this, and that, and many more things, at length, here.</p></div><p>{LONG}</p></{around}></body>"
    assert html_text.main_text(page).split("\n\n") == ["Title", LONG, LONG]


def test_what_reads_like_the_article_stays():
    text = html_text.main_text
    assert text(f"<body>\n<form action=x>\n<div><p>{LONG}</p><p>{LONG}</p></div></form></body>") == f"{LONG}\n\n{LONG}"
    assert text(f"<body><form><nav>Menu</nav><article><p>{LONG}</p></article></form></body>") == LONG
    beside = f"<body><div><div><p>{LONG}</p><p>{LONG}</p></div><h2>Steps</h2><ul><li>one</li><li>two</li></ul><div><p>Short end.</p></div><h2>More</h2><ul><li><a href=x>link one</a></li></ul></div></body>"
    assert text(beside).split("\n\n") == [LONG, LONG, "Steps", "one", "two", "Short end."]
    assert text(f"<body><div><p>{LONG}</p><p class='notice-of-meeting'>{LONG}</p><p class='menu-of-pages'><a href=x>One page</a></p></div></body>") == f"{LONG}\n\n{LONG}"
    assert text(f"<body><article><p>{LONG}</p></article><article><p>{LONG}</p></article></body>") == f"{LONG}\n\n{LONG}"
    assert text(f"<body><div class='has-sidebar'><p>{LONG}</p></div></body>") == LONG
    assert text(f"<body><article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article></body>") == f"Title\n\n{LONG}"
    assert text(f"<body><article><p>{LONG}</p></article><form><p>Sign up, please, for our letter, now</p></form></body>") == LONG


def test_points_by_plain_recursion():
    """The points of containers are those of a recursive count over small random trees."""
    rng = random.Random(8)

    def make(depth):
        tag = rng.choice(["div", "section", "p", "ul", "td", "a"]) if depth else "div"
        inner = [make(depth + 1) for _ in range(rng.randrange(1, 4))] if depth < 4 and tag not in ("p", "a") else []
        words = ["word, and word" * rng.randrange(6)] if rng.random() < 0.7 else []
        node = html_text.Node(tag, "", None)
        node.children = words + inner
        for c in inner:
            c.parent = node
        return node

    for _ in range(200):
        root = make(0)
        order = html_text.prune(root)
        html_text.score(order)
        for node in order:
            total, touched = 0.0, False

            def gather(at, up):
                nonlocal total, touched
                own = html_text.own_text(at).strip()
                direct = at.tag not in ("p", "td")
                level = up if direct else up - 1
                if at.tag in ("p", "td", "div", "section") and len(own) >= 25 and 0 <= level < 5:
                    total += (1 + own.count(",") + min(len(own) / 100, 3)) / (1, 2, 6, 9, 12)[level]
                    touched = True
                for c in at.children:
                    if not isinstance(c, str):
                        gather(c, up + 1)

            gather(node, 0)
            if touched:
                assert abs(node.points - (total + html_text.BONUS.get(node.tag, 0)) * (1 - node.linked / max(1, node.chars))) < 1e-9


def test_odd_pages(spark):
    for html in ("", "<", "a < b", "<p", "</p>", "<div" * 50, "<div>" * 5000 + "deep", "<p title='>'>x</p>", '<p a="', "<!--", "<script>", "&lt;p&gt;", "<table><tr><td>a<td>b<tr><td>c</table>"):
        assert isinstance(html_text.main_text(html), str)
    assert html_text.main_text("<article><p>One.</p><p>Two.</p></article><footer>no</footer>") == "One.\n\nTwo."
    assert html_text.main_text("<article></article>") == ""
    df = spark.createDataFrame([(1, "u", PAGE, "x"), (2, None, None, "x"), (None, "u", "", None)], "page_id long, url string, html string, text string")
    got = {r.page_id: r for r in html_text.extract_pages(df).collect()}
    assert len(got) == 3 and got[2].text == "" and got[None].n_chars == 0 and got[1].n_chars == len(got[1].text)
    assert html_text.extract_pages(df.limit(0)).count() == 0
