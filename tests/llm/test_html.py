from __future__ import annotations

import numpy as np
import pytest

from loresift.llm import bilstm, html_blocks, html_extract
from loresift.llm.common import read_table

FOLDER = "/root/testdata/sf0.001"
ODD_PAGES = [
    (1, "u", None), (2, "u", ""), (3, None, "<"), (4, "u", "<p" * 500), (5, "u", "<div>" * 3000 + "deep"),
    (None, "u", "<article><p>a&amp;b &lt;i&gt;\n c</article><footer>f</footer>"), (6, "u", "<script>x</p>"),
    (1, "u", "<nav>menu</nav>" + "<article>" + "<p>body text</p>" * 3000 + "</article>"),
]


def texts(page):
    return [b.text for b in html_blocks.blocks(page)]


def test_blocks_of_broken_and_nested_markup():
    page = (
        "<html><head><title>T</title><style>p{}</style></head><body><!-- no <p>x</p> --><script>var a='</p>';</script>"
        "<ul><li>one<li>two <a href='>'>link</a></ul><p><b>Bold.<br><p>A&amp;B &copy; \n c<i>d</i></p>tail &am"
    )
    assert texts(page) == ["T", "one", "two link", "Bold.", "A&B © cd", "tail &am"]
    found = html_blocks.blocks("<article class='post big'><p>x</p></article><div id=comments><p>y")
    assert found[0].path == {"article", ".post", ".big", "p"} and found[1].path == {"div", ".comments", "p"}
    assert texts("") == texts("<p>") == []
    assert texts("a <b") == ["a"] and texts("1 < 2 <p>x") == ["1 < 2", "x"]


def test_formulas_and_fallback_texts_are_kept():
    page = (
        "<article><p>Let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> be<svg><title> drawn</title><path d='M0'/></svg>.</p>"
        "<noscript>Whole text</noscript><p><object>a</object> <canvas>b</canvas> <audio>c</audio> <video>d</video></article>"
    )
    assert texts(page) == ["Let x=2 be drawn.", "Whole text", "a b c d"]


def test_end_tags_reach_elements_at_any_depth():
    found = html_blocks.blocks("<nav>" + "<span>" * 500 + "menu</nav><article><p>body" + "<i>" * 500 + "<p>more")
    assert [(b.text, b.path) for b in found] == [
        ("menu", {"nav"}), ("body", {"article", "p"}), ("more", {"article", "p"})
    ]
    assert abs(found[1].vector - found[2].vector).max() == 0


def test_gradient_matches_differences():
    draw = np.random.default_rng(0)
    net = bilstm.BiLstm(3, hidden=2)
    net.weights = {k: w.astype(np.float64) for k, w in net.weights.items()}
    sequences = [draw.normal(size=(n, 3)) for n in (4, 2)]
    x, mask = bilstm._padded(sequences)
    y = np.array([[1, 0], [0, 1], [1, 0], [1, 0]], float)

    def loss():
        both = np.concatenate([net._run(way, x, mask) for way in ("forth", "back")], axis=2)
        p = bilstm._sigmoid(both @ net.weights["out"][:-1] + net.weights["out"][-1])
        m = mask[..., 0]
        return -(m * (y * np.log(p) + (1 - y) * np.log(1 - p))).sum() / m.sum()

    grads = net._gradient(x, mask, y, mask[..., 0])
    for name, weights in net.weights.items():
        for at in np.ndindex(weights.shape):
            held = weights[at]
            weights[at] = held + 1e-2
            up = loss()
            weights[at] = held - 1e-2
            down = loss()
            weights[at] = held
            assert grads[name][at] == pytest.approx((up - down) / 2e-2, abs=2e-3)


@pytest.fixture(scope="module")
def labeller():
    pages = [f"<nav><a>x{i}</a></nav><article><p>some text {i}</p></article><footer>f</footer>" for i in range(40)]
    return html_extract.train(pages)


def test_unseen_templates_are_labelled(labeller):
    draw = np.random.default_rng(77)
    right = total = 0
    for _ in range(150):
        rows, labels = html_extract.template_page(draw, ["alpha", "beta", "gamma"])
        if rows:
            chance = labeller.probabilities([html_blocks.features(rows)])[0]
            right, total = right + ((chance >= 0.5) == labels).sum(), total + len(labels)
    assert right / total > 0.98


def test_padding_does_not_matter(labeller):
    draw = np.random.default_rng(5)
    rows = [html_blocks.features(html_extract.template_page(draw, ["a", "b"])[0]) for _ in range(20)]
    together, alone = labeller.probabilities(rows), [labeller.probabilities([r])[0] for r in rows]
    assert all(np.allclose(a, b, atol=1e-5) for a, b in zip(together, alone, strict=True))


def test_pages_match_their_articles(spark):
    pages = read_table(spark, FOLDER, "pages")
    got = {r.page_id: r for r in html_extract.extract(pages).collect()}
    for row in pages.collect():
        article = row.html.split("<article>", 1)[1].split("</article>", 1)[0]
        assert got[row.page_id].text == "\n".join(texts(article))
        assert got[row.page_id].n_chars == len(got[row.page_id].text)


def test_odd_pages(spark):
    pages = spark.createDataFrame([(*p, "x") for p in ODD_PAGES], "page_id long, url string, html string, text string")
    got = html_extract.extract(pages).collect()
    assert len(got) == len(ODD_PAGES)
    assert next(r.text for r in got if r.page_id is None) == "a&b <i> c"
    assert {r.text for r in got if r.page_id in (2, 6)} == {""}
    assert "\n".join(["body text"] * 3000) in {r.text for r in got}
    assert html_extract.extract(pages.where("false")).collect() == []
