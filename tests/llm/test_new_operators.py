"""Whitening, fill-in-the-middle and page extraction against plain versions of what they promise."""

import hashlib
import html
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from fathom.llm import infilling, pages, whitening
from tests.llm.conftest import prose, rows

SF = "/root/testdata/sf0.001"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# 11 --------------------------------------------------------------------------------------------------------------


def reference(vectors, k):
    """Components by LAPACK, sums in whole numbers."""
    x = {i: [int(np.floor(256 * float(c))) for c in v] for i, v in vectors.items()}
    fit = np.array(sorted({tuple(v) for v in x.values()}), dtype=object)
    n, s = len(fit), fit.sum(axis=0)
    centred = (n * fit - s).astype(float) / n
    values, basis = np.linalg.eigh(centred.T @ centred / n)
    order = np.argsort(-values)[:k]
    return x, n, s, values[order], basis[:, order], values.sum()


def test_whitening_against_lapack(spark):
    got = entry.queries()["op11_whitening"](spark, SF).collect()
    vectors = {r.vec_id: r.embedding for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()}
    x, n, s, values, basis, trace = reference(vectors, 4)
    assert len(got) == 4 * len(vectors)
    for c in range(4):
        own = {r.vec_id: r for r in got if r.component == c + 1}
        want = {i: (np.array([n * a - b for a, b in zip(v, s, strict=True)], float) / n) @ basis[:, c] / values[c] ** 0.5 for i, v in x.items()}
        sign = np.sign(sum(own[i].whitened * want[i] for i in own))
        assert max(abs(own[i].whitened - sign * want[i]) for i in own) < 1e-8
        assert all(abs(r.explained - values[c] / trace) < 1e-10 and r.n == n and r.identity_error < 1e-8 for r in own.values())
        assert all(r.deviation == sum((n * a - b) ** 2 for a, b in zip(x[r.vec_id], s, strict=True)) for r in own.values())
    assert len({r.identity_error for r in got}) == 1


def test_whitening_of_odd_vectors(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=3)]) for i in range(40)]
    odd = [(100, None), (101, [1.0, None, 2.0]), (102, [float("nan"), 0.0, 0.0]), (103, [float("inf"), 0.0, 0.0]), (104, []), (105, [0.25]), (None, [1.0, 2.0, 3.0])]
    made = spark.createDataFrame([(i, v, "n", "x") for i, v in good + good[:5] + odd], "vec_id long, embedding array<float>, n string, x string")
    got = whitening.whiten(made, k=5).collect()
    assert {r.vec_id for r in got} == {*range(40), 104, 105, None} and len(got) == (45 + 3) * 3
    assert {r.n for r in got} == {43} and all(r.identity_error < 1e-9 for r in got)
    by_id = {(r.vec_id, r.component): r.whitened for r in got}
    assert all(abs(by_id[104, c] - by_id[105, c]) > 1e-6 for c in (1,))
    for few in (made.limit(0), made.where("vec_id >= 100 and vec_id < 104"), made.where("vec_id = 7"), made.where("vec_id in (1, 1)")):
        assert whitening.whiten(few).count() == 0 and whitening.whiten(few).columns == whitening.whiten(made).columns
    huge = spark.createDataFrame([(1, [1e38, 1.0]), (2, [-1e38, 2.0]), (3, [0.0, 5.0])], "vec_id long, embedding array<float>")
    found = whitening.whiten(huge).collect()
    assert len(found) == 3 and all(r.deviation is not None and np.isfinite(r.whitened) for r in found)


@pytest.mark.parametrize("rank", [1, 3, 8, 9])
def test_factor_and_rotation(rank):
    rng = np.random.default_rng(rank)
    half = rng.integers(-9, 9, (9, rank)).astype(float)
    a = half @ half.T
    factor, pivots = whitening.cholesky(a)
    assert factor.shape[1] == np.linalg.matrix_rank(a) and np.allclose(factor @ factor.T, a[np.ix_(pivots, pivots)])
    assert np.allclose(factor, np.tril(factor))
    values, vectors = whitening.eigen(a, 9)
    assert np.allclose(values, np.linalg.eigvalsh(a)[::-1][: len(values)]) and np.allclose(a @ vectors, vectors * values)


def test_scatter_is_exact():
    rng = np.random.default_rng(1)
    for most in (300, 1 << 22, 1 << 40):
        y = rng.integers(-most, most, (50, 4))
        assert (whitening.scatter(y) == y.astype(object).T @ y.astype(object)).all()


# 12 --------------------------------------------------------------------------------------------------------------


def test_boundary_sets_select_every_member():
    rng = random.Random(2)
    sets = [[], [0], [65_535, 65_536], list(range(10, 9_000)), [*range(5, 70_000, 3), *range(80_000, 90_000), 200_000, 200_007], sorted(rng.sample(range(300_000), 40_000))]
    kinds = set()
    for members in sets:
        own = infilling.BoundarySet.of(np.array(members, np.int64))
        kinds |= {h[1] for h in own.heads}
        assert len(own) == len(members)
        assert all(own.select(k) == members[k] for k in {*range(min(50, len(members))), *range(0, len(members), 97), *([len(members) - 1] if members else [])})
        assert infilling.BoundarySet(own.data).totals == own.totals
    assert kinds == {infilling.ARRAY, infilling.BITMAP, infilling.RUNS}


def cut(doc_id, text):
    """The form by its own words."""
    text = text or ""
    tokens = re.findall(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+", text)
    digest, n = sha(f"42:{'' if doc_id is None else doc_id}"), len(tokens)
    h = [int(digest[8 * i : 8 * i + 8], 16) for i in range(4)]
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = ("".join(t) for t in (tokens[:a], tokens[a:b], tokens[b:]))
    spm = h[3] % 100 < 80
    return n, "spm" if spm else "psm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}" if spm else f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_infilling_query_against_plain(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = entry.queries()["op12_infilling"](spark, SF).collect()
    assert len(got) == len(texts) and {r.form for r in got} == {"plain", "psm", "spm"}
    for r in got:
        *want, output = cut(r.doc_id, texts[r.doc_id])
        assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want and r.output_sha256 == sha(output) and r.restored_sha256 == sha(texts[r.doc_id] or "")


def test_infilling_of_odd_texts(spark, docs, nothing):
    odd = ["a<S", "S>b <P", "x <P> y", "<M>", "\U0001f600 é x  ", "  ", "a\x0bb\x0cc", "< <S < P> >", "<P", "M> <"]
    made = spark.createDataFrame([(i, odd[i % len(odd)], "f") for i in range(400)], "doc_id long, text string, form string")
    for given in (made, docs):
        found = infilling.transform(given).withColumn("back", infilling.restored(F.col("output"), F.col("form"))).collect()
        assert len(found) == given.count()
        for r in found:
            *want, output = cut(r.doc_id, r.text)
            assert [r.n, r.form, r.prefix_chars, r.middle_chars] == want and r.output == output and r.back == (r.text or "")
    assert infilling.transform(nothing).count() == 0
    stored = docs.withColumn("borders", infilling.borders("text"))
    assert sorted(map(str, infilling.transform(stored).select("doc_id", "n", "output").collect())) == sorted(map(str, infilling.transform(docs).select("doc_id", "n", "output").collect()))
    assert "row" in infilling.transform(docs).columns and infilling.transform(docs, seed=7).where("form <> 'plain'").count() > 0


# 13 --------------------------------------------------------------------------------------------------------------


def article(page):
    inside = re.search(r"<article>(.*?)</article>", page, re.S)[1]
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", re.sub(r"</?(p|h1|br)>", " ", inside))).split())


def test_given_pages_give_their_articles(spark):
    given = {r.page_id: r for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    got = entry.queries()["op13_pages"](spark, SF).collect()
    assert len(got) == len(given)
    assert all(r.text == article(given[r.page_id].html) and r.n_chars == len(r.text) and r.url == given[r.page_id].url for r in got)


def kept(page):
    tree, found = kept.tree, pages.blocks(page)
    out = []
    for x, b in zip(pages.described(found), found, strict=True):
        node = tree
        while node.left is not None:
            node = node.left if x[node.feature] <= node.most else node.right
        out += [b[0]] if node.keep else []
    return " ".join(out)


kept.tree = pages.train()


def layout(rng, kind):
    """A page of a layout that is not among the examples, and its main text."""
    p = lambda n=40: prose(rng, rng.randint(1, n))
    main = [p(8), *(p(120) for _ in range(rng.randint(1, 6)))]
    body = f"<h1>{main[0]}</h1>" + "".join(f"<p>{m}</p>\n" for m in main[1:])
    links = " ".join(f'<li><a href="/{i}">{p(3)}</a></li>' for i in range(4))
    around = {
        "plain": (f"<nav><ul>{links}</ul></nav><aside>{p()}</aside><article>", f"</article><footer>{p()}</footer>"),
        "comments": (f"<header>{p()}</header><article>", f"</article><div id=comments><h3>{p(4)}</h3><article><p>{p()}</p></article></div>"),
        "notices": (f'<div class="gdpr-consent"><p>{p()}</p></div><div class=topMenu><ul>{links}</ul></div><main id="m">', f'</main><div class="sidebar right"><p>{p()}</p></div>'),
        "inside": (f"<nav>{links}</nav><article>", f'<div class="ad-slot"><p>{p()}</p></div><form><p>{p()}</p></form></article><div class="site-footer">{p()}</div>'),
    }[kind]
    return f"<!doctype html><html><head><title>{p(4)}</title><script>if (a<b) x('</p>')</script></head><body>{around[0]}{body}{around[1]}</body></html>", " ".join(main)


@pytest.mark.parametrize("kind", ["plain", "comments", "notices", "inside"])
def test_layouts_never_seen(kind):
    rng = random.Random(kind)
    made = [layout(rng, kind) for _ in range(40)]
    assert sum(kept(page) == main for page, main in made) >= 39


def test_scanner_reads_broken_markup():
    texts = lambda page: [b[0] for b in pages.blocks(page)]
    assert texts(None) == texts("") == texts("<!-- open") == texts("<script>x") == texts("<div class='a") == []
    assert texts("a < b &amp; c &lt;p&gt;") == ["a < b & c <p>"]
    assert texts("<p>one<b>two</b> <i>three</i><br>four<p>five&nbsp; six") == ["onetwo three four", "five six"]
    assert texts('<a title="x > y" href=\'z\'>link</a><STYLE>p{}</STYLE><Script a="</script>">no</SCRIPT >yes') == ["linkyes"]
    assert texts("<div>a</span></div></div>b<![CDATA[x]]>c") == ["a", "bc"]
    assert pages.blocks("<article><h2>t</h2>x</article><nav>y</nav>")[0][3:] == (0, 0, 1, 2, 0, 1)
    assert pages.blocks("<p>one <a>two three</a></p>")[0][1:3] == (3, 2 / 3)


def test_scanner_is_linear():
    for page in ("<div>" * 200_000 + "x", "<a \"" * 200_000, "<" * 500_000, "<p>x" * 100_000, "<script>" * 100_000, "<b class='ad'>" * 100_000 + "<p>t" * 1000, "<!--" * 200_000, "&" * 300_000):
        pages.blocks(page)


def test_extract_on_odd_rows(spark):
    odd = [None, "", "plain text alone that is long enough to be kept as the main text of a page without any marks in it", "<nav>x</nav>"]
    made = spark.createDataFrame([(None if i == 3 else i, h, "t", "b") for i, h in enumerate(odd * 2)], "page_id long, html string, text string, blocks string")
    got = pages.extract(made)
    assert got.columns == ["page_id", "blocks", "text"]
    assert sorted(r.text for r in got.collect()) == sorted(["", "", "", "", "", "", odd[2], odd[2]])
    assert pages.extract(made.limit(0)).count() == 0
    assert len(rows()) > 0
