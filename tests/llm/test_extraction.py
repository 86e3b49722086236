"""Parsing, exact marginals, training and the extracted text of pages."""

import html as references
import itertools
import random
import re

import numpy as np
import pytest

from talentweave.llm import extraction
from talentweave.llm.columns import table
from talentweave.llm.dom import MAX_DEPTH, Tree, parse
from talentweave.llm.layouts import labelled_pages
from talentweave.llm.queries import QUERIES


@pytest.fixture(scope="module")
def model():
    return extraction.trained()


def shape(html):
    tree = parse(html)
    return [(tree.depth[i], tree.tag[i] or tree.text[i]) for i in range(1, len(tree.tag))]


def test_parser():
    assert shape("a <b>b</b>c&amp;d&nbsp;\n e<br>f<!-- x <p>y</p> -->") == [(1, "a bc&d e f")]
    assert shape("<p>one<p><b>two<br><p>three</p>four") == [
        (1, "p"), (2, "one"), (1, "p"), (2, "two"), (1, "p"), (2, "three"), (1, "four")]
    assert shape("<ul><li>a<li>b<ul><li>c</ul><li>d</ul>") == [
        (1, "ul"), (2, "li"), (3, "a"), (2, "li"), (3, "b"), (3, "ul"), (4, "li"), (5, "c"), (2, "li"), (3, "d")]
    assert shape("<table><tr><td>1<td>2<tr><th>3</table>") == [
        (1, "table"), (2, "tr"), (3, "td"), (4, "1"), (3, "td"), (4, "2"), (2, "tr"), (3, "th"), (4, "3")]
    assert shape('<SCRIPT>var a = "</p><p>";</script><style>p{}</style><div title="a>b">x</DIV>') == [(1, "div"), (2, "x")]
    assert shape("<script>never ends <p>x") == [] and shape("") == [] and shape(None or " \n") == []
    assert shape("</p></div>x < y <3 &am") == [(1, "x < y <3 &am")] and shape("<div class='a") == [(1, "div")]
    tree = parse('<div id=x class="a b" hidden><a href="/q">link</a> no</div>')
    assert tree.attributes[1] == {"id": "x", "class": "a b", "hidden": ""} and tree.linked[2] == 4


def test_deep_and_long_pages():
    tree = parse("<div>" * 5000 + "deep" + "</div>" * 5000 + "<p>after</p>")
    assert max(tree.depth) <= MAX_DEPTH and [t for t in tree.text if t] == ["deep", "after"] and tree.depth[-1] == 2
    assert [t for t in parse("<p>" + "word " * 400_000 + "</p>").text if t] == [" ".join(["word"] * 400_000)]
    assert len(parse('<a "' * 3000 + "<p>x").parent) >= 1


def random_tree(rng, n):
    tree = Tree()
    for i in range(n):
        tree.add(rng.randrange(i) if i else 0, rng.choice(["div", "p"]), {"class": rng.choice("ab")})
    return tree


def test_marginals_equal_all_labellings():
    rng, numbers = random.Random(1), np.random.default_rng(2)
    trees = [random_tree(rng, n) for n in (1, 2, 5, 9)]
    forest = extraction.Forest(trees, {}, {})
    own, pair = numbers.normal(0, 2, (forest.nodes, 2)), numbers.normal(0, 2, (forest.nodes, 2, 2))
    single, both, total = extraction.marginals(forest, own, pair)
    for tree, start in zip(trees, forest.starts):
        n = len(tree.parent)
        wanted, wanted_both, z = np.zeros((n, 2)), np.zeros((n, 2, 2)), 0.0
        for labels in itertools.product((0, 1), repeat=n):
            p = np.exp(sum(own[start + i, y] for i, y in enumerate(labels)) + sum(pair[start + i, labels[tree.parent[i]], labels[i]] for i in range(1, n)))
            z += p
            for i, y in enumerate(labels):
                wanted[i, y] += p
                wanted_both[i, labels[tree.parent[i]], y] += p if i else 0
        assert np.allclose(single[start:start + n], wanted / z) and np.allclose(both[start:start + n], wanted_both / z) and np.isclose(total[start], np.log(z))


def test_training_follows_the_gradient():
    trees = [parse(p) for p in labelled_pages(12)]
    names = sorted({f for t in trees for found in extraction.features(t)[0] for f in found})
    model = extraction.TreeModel({f: i for i, f in enumerate(names)}, {"pair": 0})
    forest, gold = extraction.Forest(trees, model.own_index, model.pair_index), np.concatenate([extraction._gold(t) for t in trees])
    losses = model.fit(forest, gold, 30)
    assert losses[-1] < 0.5 * losses[0] and losses[0] == pytest.approx(np.log(2))


@pytest.mark.parametrize("all_names, least", [(True, 0.97), (False, 0.95)])
def test_accuracy_on_held_out_layouts(all_names, least):
    model = extraction.trained(labelled_pages(600, all_names=all_names))
    trees = [parse(p) for p in labelled_pages(200, seed=77)]
    good = total = 0
    for tree, shares in zip(trees, model.main(trees)):
        gold = extraction._gold(tree)
        for i, text in enumerate(tree.text):
            good, total = good + bool(text and (shares[i] >= 0.5) == gold[i]), total + bool(text)
    assert good >= least * total


def test_layouts_by_hand(model):
    prose = "This is a longer sentence of the article, with a comma. It goes on for a while."
    page = (
        '<html><head><title>T</title></head><body><header><a href="/">Site</a></header><div class="cookie-notice">We use cookies, as you know. Fine.</div>'
        f'<nav><ul><li><a href="/a">A</a></li></ul></nav><main><h1>Title</h1><p>{prose}</p><div class="ad">Buy this now. It is good.</div><p>{prose}</p></main>'
        f'<aside><h3>More</h3><a href="/b">Other story</a></aside><section id="comments"><h3>Comments</h3><div>Ann</div><p>{prose}</p></section>'
        '<form><label>Mail</label><input><button>Send</button></form><footer>&copy; Site</footer></body></html>')
    assert extraction.main_texts([page], model) == [f"Title\n{prose}\n{prose}"]
    assert extraction.main_texts([page, "", page], model) == [f"Title\n{prose}\n{prose}", "", f"Title\n{prose}\n{prose}"]


def plain_article(page):
    inside = re.search("<article>(.*?)</article>", page, re.S)[1]
    blocks = (" ".join(references.unescape(b.replace("<br>", " ").replace("<b>", "")).split()) for b in re.split("</?(?:p|h1)>", inside))
    return "\n".join(b for b in blocks if b)


def test_query_equals_articles_of_all_pages(spark, tables):
    found = {r.page_id: r for r in QUERIES["op13_dom_marginals"](spark, tables).collect()}
    pages = table(spark, tables, "pages").collect()
    assert len(found) == len(pages) and found[pages[0].page_id].asDict().keys() == {"page_id", "url", "text", "n_chars"}
    for page in pages:
        assert found[page.page_id].text == plain_article(page.html) and found[page.page_id].n_chars == len(plain_article(page.html))


def test_odd_rows(spark, model):
    rows = [(1, None, "x"), (None, "", "x"), (2, "<article><p>Some text of the page. And more of it.</p></article>", "x")] * 2 + [(3, "<p>" * 100_000, "x")]
    pages = spark.createDataFrame(rows, "c1 bigint, html string, _text string")
    got = extraction.extracted(pages, model)
    assert got.columns == ["c1", "html", "_text", "main_text"]
    assert sorted((str(r.c1), r.main_text) for r in got.collect()) == sorted(
        [("1", ""), ("None", ""), ("2", "Some text of the page. And more of it.")] * 2 + [("3", "")])
    assert extraction.extracted(pages.limit(0), model).count() == 0
    assert extraction.extracted(pages, model, out="_text").columns == ["c1", "html", "_text"]
