import gzip
import re

import numpy as np
import pytest

from foliomill.llm import html_blocks, learned_ann, warc
from foliomill.llm.common import load_file

PAGES = "page_id bigint, url string, html string, digest string, payload string, n string"


@pytest.fixture(scope="module")
def pages(spark):
    long = "<p>" + "é" * 600 + "</p>"
    rows = [(1, "u1", long), (2, None, long), (3, "u 3\r\nX: y", long), (3, "u3", long), (4, "u4", None), (5, "u5", ""), (6, "u6", "<p>short")]
    rows += [(7, "u7", "<p>short"), (None, "u8", "x" * 1000), (9, "u9", "x" * 1000), (10, "u10", "WARC/1.1\r\n\r\n\r\n" * 90), (11, "u11", "a" * 3_000_000)]
    return spark.createDataFrame([(*r, "x", "y", "z") for r in rows], PAGES)


def test_revisits(pages):
    archives = warc.write_archives(warc.resolved(pages), archive_bytes=2000)
    got = sorted(((r.page_id is None, r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in warc.read_archives(archives).collect()), key=str)
    want = [(False, 1, "revisit", 3, 1207), (False, 2, "revisit", 3, 1207), (False, 3, "response", None, 1207), (False, 3, "response", None, 1207)]
    want += [(False, 4, "response", None, 0), (False, 5, "response", None, 0), (False, 6, "response", None, 8), (False, 7, "response", None, 8)]
    want += [(True, 0, "revisit", 9, 1000), (False, 9, "response", None, 1000), (False, 10, "response", None, 1260), (False, 11, "response", None, 3_000_000)]
    assert got == sorted(want, key=str)
    payloads = {}
    for row in archives.collect():
        content = load_file(row.path)
        assert gzip.decompress(content).startswith(b"WARC/1.1\r\n")
        for record in warc.parse_records(content):
            assert b"X" not in record["headers"]
            if record["headers"][b"WARC-Type"] == b"response":
                payloads.setdefault(record["headers"][b"WARC-Record-ID"], record["payload"].decode())
    assert payloads == {b"<urn:page:%d>" % r.page_id: r.html or "" for r in pages.collect() if r.page_id in (3, 4, 5, 6, 7, 9, 10, 11)}


def test_no_pages(pages):
    assert warc.read_archives(warc.write_archives(warc.resolved(pages.limit(0)))).count() == 0
    assert html_blocks.extract(pages.limit(0)).count() == 0


def test_archive_that_is_cut_off():
    with pytest.raises(ValueError, match="cut off"):
        list(warc.members(gzip.compress(b"x" * 100)[:-9]))


def test_extraction_of_odd_pages(pages):
    got = {(r.page_id, r.url): r for r in html_blocks.extract(pages).collect()}
    assert len(got) == pages.count()
    assert got[4, "u4"].text == got[5, "u5"].text == ""
    assert got[6, "u6"].text == "short" and got[6, "u6"].n_chars == 5
    assert got[11, "u11"].n_chars == 3_000_000


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ("<article><h1>T &lt;i&gt;</h1><p>One<br>two <b>bo</b>ld<p>Three&nbsp;&#233; x</article><footer>f", "T <i>\nOne two bold\nThree é x"),
        ("<script>var a='</p><p>no';</script><main><p>Yes.</p><!-- <p>no</p> --></main>", "Yes."),
        ("<body><nav><a href=1>A</a></nav><article><p>In it.</p><div class='user-comments'><p>Not this.</p></div><p>End.</article>", "In it.\nEnd."),
        ("<div id=cookie-consent>We use cookies.</div><article><p>Body text.</p><form><label>Name</label><input></form></article>", "Body text."),
        ("<article><p>a < b and 3 > 2</p></article>", "a < b and 3 > 2"),
        ("<article><p>cut off in the mid", "cut off in the mid"),
        ("<article><p title=\"a>b\">quoted</p></article>", "quoted"),
        ("<article class='post comments-open'><h1>T</h1><p>One two three.</p></article>", "T\nOne two three."),
        ("<article class='category-social'><p>One two three.</p></article>", "One two three."),
        ("<div class='entry-content has-sidebar'><p>One two three.</p><p>More of it here.</p></div>", "One two three.\nMore of it here."),
        ("<div class='post tag-side-effects'><p>One two three.</p></div>", "One two three."),
        ("<article><p data-hidden-id=3>One two.</p></article>", "One two."),
        ("<article><p title='a hidden gem'>One two.</p><p hidden>no</p><div style='display: none'>no</div></article>", "One two."),
        ("<body class='sidebar'><div class='widget'><main><p>One two.</p></main></div><div class='widget'><p>No.</p></div>", "One two."),
    ],
)
def test_extraction_cases(page, want):
    assert html_blocks.main_text(page, html_blocks.train()) == want


def test_extraction_equals_the_articles_of_the_pages(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").collect()
    tree = html_blocks.train()
    import html

    for r in rows:
        article = re.search(r"<article>(.*?)(?:</article>|<footer|\Z)", r.html, re.S)[1]
        parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", p.replace("<br>", " "))).split()) for p in re.split(r"</?(?:p|h1)>", article)]
        assert html_blocks.main_text(r.html, tree) == "\n".join(p for p in parts if p)


@pytest.mark.parametrize("names", [True, False])
def test_tree_generalises_to_the_page_left_out(names, monkeypatch):
    """Held-out accuracy over blocks, with and without marks by tag and name."""
    pages = html_blocks.LABELLED
    right = total = 0
    for k in range(len(pages)):
        monkeypatch.setattr(html_blocks, "LABELLED", pages[:k] + pages[k + 1 :])
        tree = html_blocks.grow(*html_blocks.table(html_blocks.labelled(), names))
        x, y = html_blocks.table([pages[k]], names)
        right += int((html_blocks.classify(tree, x) == y).sum())
        total += len(y)
    assert right / total >= 0.8


def test_pages_without_names_are_told_by_densities():
    menu = "".join(f"<li><a href=#>Item {i}</a></li>" for i in range(6))
    prose = ["Headline of the day", *(" ".join(["word"] * n) + "." for n in (60, 45, 80, 30))]
    page = f"<body><div><ul>{menu}</ul></div><div><div><h2>{prose[0]}</h2>" + "".join(f"<p>{p}</p>" for p in prose[1:]) + f"</div></div><div><ul>{menu}</ul></div>"
    assert html_blocks.main_text(page, html_blocks.train()) == "\n".join(prose)


def test_deep_and_unbalanced_pages():
    page = "<div>" * 100_000 + "<p>Deep text here.</p>" + "</span></p></section>" * 100_000
    assert html_blocks.main_text(page, html_blocks.train()) == "Deep text here."


VECTORS = "vec_id bigint, embedding array<float>, label int, part string, v string, routes string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 0, "x", "y", "z") for i, v in rows], VECTORS)


def brute(rows, every, k):
    use = [(i, np.array(v, np.float64)) for i, v in rows if v and None not in v and np.isfinite(v).all() and any(v)]
    out = {}
    for i, q in use:
        if i is not None and i % every == 0:
            scores = sorted((-(q @ x) / np.linalg.norm(q) / np.linalg.norm(x), j) for j, x in use if j != i)
            out[i] = [(j, -s) for s, j in scores[:k]]
    return out


def test_search_over_all_parts_is_exact(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000 + i, rows[3][1]) for i in range(50)] + [(2000, None), (2001, [0.0] * 8), (2002, [float("nan")] + [1.0] * 7), (2003, [None] + [1.0] * 7)]
    rows += [(2004, [float("inf")] + [1.0] * 7), (2005, []), (2006, [1.0, 2.0])]
    found = learned_ann.search(vectors(spark, rows), every=10, k=5, parts=4, probes=4, block=64).collect()
    want = brute([r for r in rows if r[0] != 2006], 10, 5)
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.vec_id, r.score))
    assert got.keys() == want.keys()
    for q, pairs in want.items():
        assert [s for _, s in got[q]] == pytest.approx([s for _, s in pairs], abs=1e-12)
        if len({round(s, 9) for _, s in pairs}) == len(pairs):
            assert [j for j, _ in got[q]] == [j for j, _ in pairs]
    assert [j for j, _ in got[1000]] == [3, 1001, 1002, 1003, 1004]


def test_search_with_missing_large_and_repeated_ids(spark):
    rng = np.random.default_rng(7)
    big = (1 << 53) + 1
    rows = [(i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(120)]
    rows += [(big + i, rng.normal(0, 1, 8).astype(np.float32).tolist()) for i in range(60)]
    rows += [(None, rows[0][1]), (None, None)] + [rows[10]] * 3 + [(20, rows[5][1])]
    found = learned_ann.search(vectors(spark, rows), every=10, k=5, parts=4, probes=4, block=32).collect()
    got = {}
    for r in sorted(found, key=lambda r: r.rank):
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    usable = [(i, np.array(v, np.float64)) for i, v in rows if i is not None]
    for own, lists in got.items():
        vectors_of = {tuple(v) for i, v in usable if i == own}
        want = []
        for q in map(np.array, vectors_of):
            scores = sorted((-(q @ x) / np.linalg.norm(q) / np.linalg.norm(x), j) for j, x in usable if j != own)[:5]
            want += [(n, j, round(-s, 9)) for n, (s, j) in enumerate(scores, 1)]
        assert sorted((n, j, round(s, 9)) for n, j, s in lists) == sorted(want)
    assert set(got) == {i for i, _ in usable if i % 10 == 0}
    assert len(got[20]) == 10 and len(got[10]) == 5


def test_recall_of_the_query(spark):
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = [(r.vec_id, list(r.embedding)) for r in df.collect()]
    want = {(q, j) for q, pairs in brute(rows, 50, 5).items() for j, _ in pairs}
    got = {(r.query_id, r.vec_id) for r in learned_ann.search(df).collect()}
    assert len(got) == len(want) and len(got & want) / len(want) >= 0.9


def test_recall_on_many_clustered_rows():
    """Ranks, parts and the share of rows probed of 50 000 rows around 400 centres, without Spark's part of the work."""
    rng = np.random.default_rng(11)
    centres = rng.normal(0, 1, (400, 32))
    x = centres[rng.integers(0, 400, 50_000)] + rng.normal(0, 0.35, (50_000, 32))
    router, probes = learned_ann.train_router(x[:6000], 64)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    order = np.argsort(-router.probabilities(unit), axis=1)
    hit = rows = 0
    for q in range(0, 50_000, 100):
        scores = unit @ unit[q]
        scores[q] = -1
        probed = np.isin(order[:, 0], order[q, :probes])
        hit += probed[np.argpartition(-scores, 5)[:5]].sum()
        rows += probed.sum()
    assert hit / 2500 >= 0.9
    assert rows / 500 / 50_000 <= 0.25


def test_few_and_no_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [1.0, 1.0]), (2, [0.0, 1.0])]
    found = learned_ann.search(vectors(spark, rows), every=50).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(found, key=lambda r: r.rank)] == [(0, 1, 1), (0, 2, 2)]
    assert learned_ann.search(vectors(spark, [])).count() == 0


def test_parts_are_balanced():
    x = np.random.default_rng(6).normal(0, 1, (500, 16))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    graph = learned_ann.neighbour_graph(x, 10)
    label = learned_ann.balanced_parts(x, graph, 8)
    sizes = np.bincount(label, minlength=8)
    assert sizes.max() - sizes.min() <= 2
    inside = (label[graph] == label[:, None]).mean()
    assert inside > 1.5 / 8
