"""Block reading, gradients of the recurrent network, and held-out accuracy."""

import numpy as np
import pytest

from millrace.llm import html_blocks as hb

FRAME = "<nav><ul><li><a href='/a'>One</a></li><li><a href='/b'>Two</a></li></ul></nav><div class='ad'>Buy {i} now.</div>"


def page(i):
    body = "".join(f"<p>Sentence {k} of page {i}, with words.<br>And more of it.</p>" for k in range(1 + i % 5))
    return f"<html><head><title>T{i}</title><script>var t='</p>';</script></head><body>{FRAME.format(i=i)}<article><h1>Title {i}</h1>{body}</article><footer>&copy; {i}</footer></body></html>"


def wanted(i):
    return f"Title {i}" + "".join(f" Sentence {k} of page {i}, with words. And more of it." for k in range(1 + i % 5))


def test_blocks_of_odd_markup():
    texts = [b.text for b in hb.blocks_of("<p>a<b>b</b> &amp;&#x41;<!-- x --> c<p>d<script>no</script>e<br/>f<table><tr><td>g<td>h</table>5 < 6 <img alt='>'>i<sty")]
    assert texts == ["ab &A c", "d", "e f", "g", "h", "5 < 6 i"]
    assert hb.blocks_of(None) == hb.blocks_of("") == hb.blocks_of("<!-- open") == []


def test_gradients_equal_differences():
    rng = np.random.default_rng(3)
    model = hb.BidirectionalLSTM(5, hidden=3, seed=2)
    model.weights = {k: w.astype(np.float64) for k, w in model.weights.items()}
    x, y = rng.normal(size=(4, 2, 5)), rng.integers(0, 2, (4, 2)).astype(float)
    mask = np.array([[1, 1], [1, 1], [1, 0], [1, 0]], dtype=float)
    _, grads = model.gradients(x, mask, y, mask)
    for name, grad in grads.items():
        weight = model.weights[name]
        for place in [tuple(rng.integers(0, n) for n in weight.shape) for _ in range(6)]:
            kept = weight[place]
            losses = []
            for step in (1e-3, -1e-3):
                weight[place] = kept + step
                losses.append(model.gradients(x, mask, y, mask)[0])
            weight[place] = kept
            assert grad[place] == pytest.approx((losses[0] - losses[1]) / 2e-3, abs=2e-4)


def test_held_out_frames():
    labelled = [(b, [hb.marked_label(x.path) or 0 for x in b]) for b in (hb.blocks_of(page(i)) for i in range(60))]
    model = hb.fit(labelled[:40] + hb.framed(labelled[:40], copies=8))
    held = hb.framed(labelled[40:], seed=5, copies=5)
    flags = hb.label_pages(model, hb.Features(), [b for b, _ in held])
    right = sum(int((f == np.array(y, dtype=bool)).sum()) for f, (_, y) in zip(flags, held, strict=True))
    assert right / sum(len(y) for _, y in held) > 0.97


def test_pages_of_a_table(spark):
    rows = [(i, f"http://x/{i}", page(i), "kept") for i in range(60)] + [(None, None, page(1), "kept"), (61, "u", None, "kept"), (62, "u", "", None), (1, "http://x/1", page(1), "kept")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, main_text string")
    got = hb.main_text_report(pages).collect()
    assert len(got) == 64
    for row in got:
        expected = "" if row.page_id in (61, 62) else wanted(1 if row.page_id is None else row.page_id)
        assert (row.text, row.n_chars) == (expected, len(expected))
    assert hb.main_text_report(pages.where("false")).collect() == []


def test_sample_is_thinned_by_marked_pages(spark):
    bare = [(None, f"<p>Page {i}</p>") for i in range(400)]
    # Copies and equal keys are no reason to draw fewer.
    rows = bare + [(None, page(i % 20)) for i in range(60)]
    pages = spark.createDataFrame(rows, "page_id long, html string")
    sample = hb.labelled_sample(pages, "html", rows=10)
    assert len(sample) == 10 and len({tuple(b.text for b in blocks) for blocks, _ in sample}) == 10
    assert len(hb.labelled_sample(pages, "html", rows=30)) == 20


def test_table_without_marked_pages(spark):
    with pytest.raises(ValueError):
        hb.fit([])
    body = "".join(f"<p>Sentence {k} of this page, with some words in it.</p>" for k in range(4))
    rows = [(1, f"<html><body><nav><ul><li><a href='/'>Home</a></li></ul></nav><div class='content'>{body}</div><footer><p>Legal</p></footer></body></html>")]
    got = hb.extract_text(spark.createDataFrame(rows, "page_id long, html string")).first()
    assert got.main_text == " ".join(f"Sentence {k} of this page, with some words in it." for k in range(4))


@pytest.mark.parametrize("odd", [
    "<svg width='1'/>", "<math/>", "<iframe src='x' />", "<script src='x'/>", "<svg width='1'>", "<video-player></video-player>", "<template-x></template-x>", "<style-guide>", "<button-group>",
    "<div><button>no</div>", "<div><select><option>no</div>", "<div><object>no</div>", "<p><video>no</p>", "<svg><foreignObject><p>no</p></foreignObject></svg>",
    "<button><b>no</b></button>", "<SCRIPT a='>'>no</b></SCRIPT >", "<noscript><p>no</p></noscript>", "<textarea><p>no</textarea>", "<iframe>no<p>no</iframe>",
])
def test_text_after_odd_elements_stays(odd):
    assert [b.text for b in hb.blocks_of(f"<article><p>A</p>{odd}<p>B</p></article><p>C</p>")] == ["A", "B", "C"]
