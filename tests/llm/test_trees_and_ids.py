"""Tree matching against all order-keeping matches, pages of any shape, and rows that share an id."""

from __future__ import annotations

import functools
import random
import time

from compoundry.llm import suffix_dedup, wrapper_induction
from compoundry.llm.wrapper_induction import Matcher, Page, Tree


def tree_of(html: str) -> Tree:
    return Tree(Page(html).pack())


def random_page(rng: random.Random, depth: int = 0) -> str:
    if depth == 3:
        return "<p>x</p>"
    return "".join(f"<{n}>{random_page(rng, depth + 1) if rng.random() < 0.7 else 'x'}</{n}>" for n in rng.choices(["div", "section", "h2"], k=rng.randint(0, 4)))


def largest_match(a: Tree, b: Tree, i: int = 0, j: int = 0) -> int:
    """Over every way to pair children in order."""
    if a.label[i] != b.label[j]:
        return 0
    x, y = a.child[i], b.child[j]

    @functools.cache
    def best(s: int, t: int) -> int:
        if s == len(x) or t == len(y):
            return 0
        # the s-th child stays alone, or meets any later child of the other side
        return max([best(s + 1, t), *[largest_match(a, b, x[s], y[u]) + best(s + 1, u + 1) for u in range(t, len(y))]])

    return 1 + best(0, 0)


def test_matches_are_the_largest(monkeypatch):
    rng = random.Random(11)
    for cells in (1 << 22, 2):
        monkeypatch.setattr(Matcher, "CELLS", cells)
        matcher = Matcher()
        for _ in range(150):
            a, b = tree_of(random_page(rng)), tree_of(random_page(rng))
            pairs = matcher.align(a, b)
            assert len(pairs) == largest_match(a, b)
            assert len({i for i, _ in pairs}) == len({j for _, j in pairs}) == len(pairs)
            parent = lambda t: {c: k for k, cs in enumerate(t.child) for c in cs}
            up, down, match = parent(a), parent(b), dict(pairs)
            for i, j in pairs:
                assert a.label[i] == b.label[j] and (i == 0 or match[up[i]] == down[j])
            for i, j in pairs:
                for k, m in pairs:
                    if up.get(i) == up.get(k) and i < k:
                        assert j < m


def test_deep_and_wide_pages_are_aligned():
    start = time.time()
    deep = lambda t: "<body>" + "<div>" * 5000 + f"<p>{t}</p>" + "</div>" * 5000
    wide = lambda t, n: "<body><div class=a><p>always here</p></div><div class=b>" + "".join(f"<p>{t} {i}</p><h2>{t}</h2>" for i in range(n)) + "</div>"
    assert wrapper_induction.induce([tree_of(deep("one")), tree_of(deep("two"))]) == [["one"], ["two"]]
    got = wrapper_induction.induce([tree_of(wide("one", 10_000)), tree_of(wide("two", 9_000)), tree_of(wide("three", 10))])
    assert [len(x) for x in got] == [20_000, 18_000, 20]
    assert time.time() - start < 60


def test_class_names_of_layouts_keep_their_text(spark):
    keeps = ["elementor-widget elementor-widget-text-editor", "site has-sidebar", "post-body no-comments", "related-work", "with-ads", "entry-content"]
    drops = ["sidebar", "cookie-banner", "site-footer", "comments-area", "ad-slot", "main nav-menu", "widget", "newsletter_signup"]
    rows = [(i, None, f'<body><article><p>start {i}</p><div class="{c}"><p>part {i}</p></div></article>') for i, c in enumerate(keeps + drops)]
    out = wrapper_induction.extract(spark.createDataFrame([(i, f"http://h{i}.example.com/", h) for i, _, h in rows], "page_id long, url string, html string"))
    got = {r["page_id"]: r["_text"] for r in out.collect()}
    assert got == {i: f"start {i}" + (f"\n\npart {i}" if i < len(keeps) else "") for i, _, _ in rows}


def test_rows_that_share_an_id_are_documents_of_their_own(spark):
    shared = "the very same thirty bytes, twice"
    texts = [f"{'a' * 9} {shared} only here first", f"{shared} {'b' * 40} only here second"]
    for ident in (None, 7):
        rows = [(ident, texts[0], 1), (ident, texts[1], 2), (ident, None, 3), (3, "", 4), (9, "unlike all others " * 2, 5)]
        df = spark.createDataFrame(rows, "doc_id long, text string, n int")
        got = {r["n"]: bytes(r["_kept"]).decode() for r in suffix_dedup.remove_repeated_bytes(df, 30, 8).collect()}
        one = {r["n"]: bytes(r["_kept"]).decode() for r in suffix_dedup.remove_repeated_bytes(df.withColumn("doc_id", df.n.cast("long")), 30, 8).collect()}
        assert got == one and len(got) == 5
        assert shared not in got[1] + got[2]
        assert "only here first" in got[1] and "only here second" in got[2]
