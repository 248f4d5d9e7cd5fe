"""Operators 1, 5, 7 and 9, and the pipeline."""

import base64
import collections
import hashlib
import html
import math
import random

import numpy as np
import re
import zlib

import corpus_pipeline
import pytest
from fathomline.llm import common, html_extract, line_dedup, mixing, quality, warc
from pyspark.sql import functions as F
from tests.llm.helpers import none, odd, plain
from tests.llm.test_dedup import brute_classes, brute_contamination
from fathomline.llm.queries import ORACLES
from tests.oracle import TESTDATA, rows_of, rows_of_sql

SF = f"{TESTDATA}/sf0.001"


def test_quality_on_held_out_rows(spark):
    docs, labels = (common.table(spark, f"{TESTDATA}/sf0.01", t) for t in ("documents", "labels"))
    rows = quality.judged(docs, labels).join(labels, "doc_id").collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) for r in rows)
    held = [r for r in rows if r.held_out]
    assert sum(r.predicted == r.quality for r in held) / len(held) > 0.95
    good = [r for r in held if r.quality == 1]
    assert sum(r.predicted for r in good) / len(good) > 0.98


def test_features_do_not_depend_on_pieces(monkeypatch):
    rnd = random.Random(4)
    texts = ["".join(rnd.choice("abc é\n😀") for _ in range(n)) for n in (0, 1, 3, 500, 40)]

    def bags():
        out = [collections.Counter() for _ in texts]
        for docs, buckets in quality.features(texts):
            for d, b in zip(docs.tolist(), buckets.tolist()):
                out[d][b] += b > 2  # repeats of words aren't seen over the edge of a piece
        return [+c for c in out]

    whole = bags()
    monkeypatch.setattr(quality, "PIECE", 64)
    assert bags() == whole


def test_words_and_repeats_go_over_the_edges_of_pieces():
    rnd = random.Random(5)
    texts = ["ab ab cd ab " * 30, "x" * 300 + " " + "x" * 300, "", "  ", "the the", "a", *(" ".join(rnd.choices(["a", "bb", "ccc", "a\n"], k=80)) for _ in range(20)), "y" * 150]

    def bags(size):
        out = [collections.Counter() for _ in texts]
        for docs, buckets in quality.features(texts, size):
            for d, b in zip(docs.tolist(), buckets.tolist(), strict=True):
                out[d][b] += 1
        return out

    whole = bags(1 << 20)
    assert sum(w[1] + w[2] for w in whole) > 500  # there are repeats
    for size in (1, 2, 3, 5, 7, 64, 299, 300, 301):
        assert bags(size) == whole, size


def test_scores_equal_a_plain_computation(spark):
    """Hashes, means and the logistic of a few texts, feature by feature in plain Python."""
    m32, m64 = (1 << 32) - 1, (1 << 64) - 1

    def plain(text):
        cps, out = [ord(c) for c in text], []
        for n in quality.NGRAMS:
            for i in range(len(cps) - n + 1):
                h = cps[i] * int(quality._ODD[0]) & m32
                for k in range(1, n):
                    h ^= (h >> 15) + cps[i + k] * int(quality._ODD[k]) & m32
                    h = h * 0x2C1B3C6D & m32
                out.append(((h ^ n) * 0x9E3779B1 & m32) >> (32 - quality.BITS))
        words = []
        for w in "".join(c if ord(c) > 32 else " " for c in text).split(" "):
            if w:
                h = sum(ord(c) * pow(int(quality._P), i, 1 << 64) for i, c in enumerate(w)) & m64
                h ^= h >> 29
                words.append(h)
        out += [(h * int(quality._P) & m64) >> (64 - quality.BITS) for h in words]
        return out + [back for back in (1, 2) for i in range(back, len(words)) if words[i] == words[i - back]]

    rng = np.random.default_rng(1)
    model = quality.Model(rng.normal(size=1 << quality.BITS), 0.25)
    texts = ["", "ab", "The fox the fox", "é\u20ac😀 x x x", "one two\none two", "tab\tbed  and  more"]
    want = []
    for t in texts:
        f = plain(t)
        want.append(1 / (1 + np.exp(-(sum(model.weights[b] for b in f) / max(len(f), 1) + 0.25))))
    assert np.allclose(model.scores(texts), want, rtol=1e-12)


def test_quality_learns_nothing_from_held_out_or_odd_rows(spark):
    docs = plain(spark, ["a", "b", None, ""])
    labels = spark.createDataFrame([(0, 1, 0), (None, 0, 0), (2, 0, 0), (3, None, 0), (0, 1, 0)], "doc_id long, quality int, toxic int")
    assert {r.score for r in quality.judged(docs, labels).collect()} and quality.judged(odd(spark), labels.limit(0)).filter("score = 0.5").count() == 4
    assert quality.judged(none(spark), labels).count() == 0


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + ([None] if None in sizes else [])
    weight = {s: i % 3 + 1 for i, s in enumerate(names)}
    total, full = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in full)
        rest = sum(weight[s] for s in names if s not in full)
        target = {s: 3.0 * sizes[s] if s in full else left * weight[s] / rest for s in names}
        over = {s for s in names if s not in full and target[s] > 3 * sizes[s]}
        if not over:
            return target
        full |= over


def test_mixing(spark):
    rnd = random.Random(6)
    rows = [(i, " ".join("w" * rnd.choice((1, 5, 40, 300))), rnd.choice(["a", "b", "c", "d", "é", None, "z"][: rnd.randint(1, 7)])) for i in range(400)] + [(900, None, "q"), (901, "x\x0by\xa0z", "q")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    found = mixing.report(docs).collect()
    size = {i: len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for i, t, _ in rows}
    of = {i: s for i, _, s in rows}
    sizes = collections.Counter()
    for i, n in size.items():
        sizes[of[i]] += n
    target, taken = brute_targets(dict(sizes)), collections.Counter()
    for r in found:
        assert r["size"] == size[r.doc_id] and r.source_size == sizes[of[r.doc_id]] and math.isclose(r.target, target[of[r.doc_id]], rel_tol=1e-9)
        assert r.taken <= 3 * r["size"]
        taken[of[r.doc_id]] += r.taken
    assert all(abs(taken[s] - target[s]) <= max(n for i, n in size.items() if of[i] == s) + 1 for s in target)
    assert sorted(map(tuple, mixing.report(docs.repartition(7)).collect())) == sorted(map(tuple, found))
    copies = collections.Counter(r.doc_id for r in mixing.mixed(docs).collect())
    assert all(copies[r.doc_id] * r["size"] == r.taken for r in found)


def test_mixing_odd_rows(spark):
    assert mixing.report(odd(spark)).count() == 4 and mixing.report(none(spark)).count() == 0
    out = mixing.mixed(odd(spark, ("a", "b c", None)))
    assert out.columns == [c for c in odd(spark).columns if c != "copy"] + ["copy"] and {r._sid for r in out.collect()} <= {3}


def test_warc(spark, tmp_path):
    rows = [(1, "a", "<p>ü\r\n\r\n</p>"), (2, None, "<p>ü\r\n\r\n</p>"), (3, "b%0A\r\nc", None), (4, "", ""), (5, "u", "x"), (5, "v", "x"), (None, "n", "y")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    warc.write(pages, str(tmp_path / "w"))
    back = {(r.page_id, r.url): r for r in warc.reconstruct(spark, str(tmp_path / "w")).collect()}
    assert {k: bytes(r.payload) for k, r in back.items()} == {(i, u): (h or "").encode() for i, u, h in rows}
    assert {k: (r.record_type, r.refers_to) for k, r in back.items()} == {
        (1, "a"): ("revisit", 2), (2, None): ("response", None), (3, "b%0A\r\nc"): ("revisit", 4), (4, ""): ("response", None), (5, "u"): ("revisit", 5), (5, "v"): ("response", None), (None, "n"): ("response", None),
    }
    assert back[5, "v"].payload_digest == base64.b32encode(hashlib.sha1(b"x").digest()).decode()
    assert warc.archive(pages.union(pages.limit(1))).count() == 8 and warc.archive(pages.limit(0)).count() == 0
    assert {r.record_type for r in warc.archive(pages, least=100).collect()} == {"response"}


def test_a_payload_is_stored_once(spark, tmp_path):
    """Wholly equal rows: one response, the others revisit it; code and SQL agree on repeated ids; files follow bytes."""
    rows = [(1, "a", "x" * 50)] * 3 + [(2, "b", "x" * 50), (2, "c", "x" * 50), (7, "d", "y"), (7, "d", "y"), (8, "e", None), (8, "f", "")] + [(100 + i, "z", f"{i} " * 200) for i in range(40)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(3)
    warc.write(pages, str(tmp_path / "w"), bytes_a_file=4000)
    assert len(list((tmp_path / "w" / "responses").glob("*.gz"))) > 2
    stored = warc.read(spark, str(tmp_path / "w" / "responses"))
    assert stored.count() == stored.select("sha256").distinct().count() == 43
    back = warc.reconstruct(spark, str(tmp_path / "w")).collect()
    assert collections.Counter((r.page_id, r.url, bytes(r.payload)) for r in back) == collections.Counter((i, u, (h or "").encode()) for i, u, h in rows)
    pages.write.parquet(str(tmp_path / "pages.parquet"))
    assert rows_of(warc.archive(pages)) == rows_of_sql(ORACLES["op7_warc"], str(tmp_path))


def test_records_of_other_writers():
    import gzip

    record = lambda head, block: f"WARC/1.0\r\n{head}\r\nContent-Length: {len(block)}\r\n\r\n{block}\r\n\r\n".encode()
    members = [
        record("WARC-Type: warcinfo\r\nWARC-Record-ID: <urn:uuid:1>", "software: x"), record("WARC-Type: request", "GET / HTTP/1.1\r\n\r\n"),
        record("WARC-Type: response\r\nWARC-Record-ID: <urn:uuid:2>\r\nWARC-Target-URI: http://a/%25", "HTTP/1.1 200 OK\r\n\r\nbody"),
        record("warc-type: resource\r\nWARC-Payload-Digest: md5:00", "plain"), record("WARC-Type: revisit\r\nWARC-Refers-To: <urn:uuid:2>", ""),
    ]
    found = list(warc.records(b"".join(map(gzip.compress, members))))
    assert [(r[0], r[1], r[2], r[7], r[8]) for r in found] == [(None, "http://a/%25", "response", b"body", 4), (None, None, "response", b"plain", 5), (None, None, "revisit", None, None)]
    assert found[0][4] == base64.b32encode(hashlib.sha1(b"body").digest()).decode()


def test_warc_finds_changed_payloads(tmp_path):
    import gzip

    bad = b"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:1>\r\nWARC-Payload-Digest: sha1:A\r\nX-Payload-SHA256: b\r\nX-Payload-Length: 1\r\nContent-Length: 5\r\n\r\n\r\n\r\nx\r\n\r\n"
    with pytest.raises(ValueError, match="payload"):
        list(warc.records(gzip.compress(bad)))


def test_html_of_pages(spark):
    pages = common.table(spark, SF, "pages")
    given = {r.page_id: r.html for r in pages.collect()}
    for r in html_extract.extract(pages).collect():
        article = re.search(r"<article>(.*?)</article>", given[r.page_id], re.S)[1]
        blocks = (" ".join(html.unescape(re.sub(r"<[^>]+>", "", b)).split()) for b in re.split(r"</?(?:p|h1)>", article))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)


PAGES = [
    ("<body><header><a>Home</a></header><nav>m</nav><div class='cookie-notice'>C</div><main><h1>T &amp; m</h1><p>One<br>two &nbsp; three</p><ul><li>a<li>b</ul><div id=ad-slot>Buy</div><form>S</form>"
     "<table><tr><td>1<td>2</table><section class=comments><article class=comment>hi</article></section></main><aside>s</aside><footer>f</footer><script>if(a<b){x='</p>'}</script>", ["T & m", "One two three", "a", "b", "1 2"]),
    ("<p>a<p>b <b>c</b>d<div>e</div>f<!-- x --><!-- y", ["a", "b cd", "e", "f"]),
    ("<title>T</title><div class='page-header'>H</div><p hidden>n</p><p>x</p><div id=sidebar>z</div>", ["x"]),
    ("<article><header><h1>T</h1></header>x<aside>no</aside></article><p>out</p>", ["T", "x"]),
    ("just &lt;text&gt; 5 < 6", ["just <text> 5 < 6"]), ("", []), (None, []), ("<div" * 50, []),
]


@pytest.mark.parametrize(("page", "lines"), PAGES)
def test_html_parse(page, lines):
    found = html_extract.parse(page)
    assert [t for (t, _, _), r in zip(found, html_extract.roles(found)) if r] == lines or page and page.startswith("<div<")


@pytest.mark.parametrize("table", [1 << 26, 8])
def test_shared_lines_are_a_longest_common_subsequence(monkeypatch, table):
    monkeypatch.setattr(html_extract, "TABLE", table)
    rnd = random.Random(0)
    for _ in range(500):
        a, b = ([rnd.choice("abcd") for _ in range(rnd.randint(0, 12))] for _ in range(2))
        best = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                best[i + 1][j + 1] = best[i][j] + 1 if x == y else max(best[i][j + 1], best[i + 1][j])
        kept = [x for x, k in zip(a, html_extract.shared(a, b)) if k]
        it = iter(b)
        assert len(kept) == best[-1][-1] and all(c in it for c in kept)


def test_differencing(spark):
    page = lambda *own: "<div>Site</div><div>Top</div>" + "".join(f"<p>{x}</p>" for x in own) + "<div>All rights</div>"
    long = "a text that is long enough to be most of its page"
    rows = [(1, "http://h.org/a/1", page(long, "p1")), (2, "http://h.org/a/2?x=1", page(long + "!", "p2")), (3, "http://h.org/b", page(long)), (4, "http://h.org/b", page(long)), (5, "http://one.org/", page("x")), (6, None, page("y"))]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    found = {r.page_id: r.text for r in html_extract.extract(pages.repartition(3)).collect()}
    assert found[1] == f"{long}\np1" and found[2] == f"{long}!\np2"
    # A copy, under the same URL or another, is differenced with a page of other lines; a page alone on its host keeps what it has.
    assert found[3] == found[4] == long and found[5] == "Site\nTop\nx\nAll rights"


def test_html_odd_rows(spark):
    pages = spark.createDataFrame([(None, None, None, True), (1, "", "", True), (1, "", "", True), (2, "x", "<p>" + "a " * 100_000, False)], "page_id long, url string, html string, marked boolean")
    found = html_extract.extract(pages)
    assert found.count() == 4 and found.agg(F.max("n_chars")).first()[0] == 199_999 and html_extract.extract(pages.limit(0)).count() == 0


def test_pipeline_stages(spark):
    docs = common.table(spark, SF, "documents")
    columns, benchmark = docs.columns, [(r.item_id, r.text) for r in common.table(spark, SF, "benchmark").collect()]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    now = docs
    for name, stage in corpus_pipeline.STAGES:
        then = common.stored(stage(spark, now, SF), "stage")
        before, after = ([tuple(r) for r in d.select(*columns).collect()] for d in (now, then))
        if name == "quality classifier":
            scores = {r.doc_id: r.score for r in quality.scored(now, quality.fit(now, common.table(spark, SF, "labels"))).collect()}
            assert sorted(after) == sorted(r for r in before if scores[r[0]] >= 0.5)
        elif name == "line dedup":
            left = {r.doc_id: (r.text, r.n_removed) for r in line_dedup.report(now).collect()}
            assert {r[0]: r[1] for r in after} == {i: t for i, (t, n) in left.items() if not n or t.strip()} and all(r[4] == len(r[1]) for r in after)
        elif name == "n-gram Jaccard join":
            rows = sorted(before)
            roots = brute_classes([r[1] for r in rows])
            assert sorted(after) == [r for i, r in enumerate(rows) if roots[i][0] == i]
        elif name == "benchmark decontamination":
            hit = {x[0] for x in brute_contamination([r[:2] for r in before], benchmark) if x[5]}
            assert sorted(after) == sorted(r for r in before if r[0] not in hit)
        else:
            copies = {r.doc_id: r.copies for r in mixing.plan(now).collect()}
            assert sorted(after) == sorted(r for r in before for _ in range(copies[r[0]]))
        if name != names[-1]:
            assert then.columns == columns
        now = then


def test_pipeline_odd_rows(spark):
    labels = common.table(spark, SF, "labels")
    cols = "doc_id long, text string, lang string, source string, n_chars long"
    for rows in ([], [(None, None, None, None, None), (1, "", "en", "s", 0), (1, "", "en", "s", 0), (2, "a b c", None, None, 5)]):
        docs = spark.createDataFrame(rows, cols)
        for _, stage in corpus_pipeline.STAGES:
            docs = common.stored(stage(spark, docs, SF), "odd")
        assert docs.count() <= len(rows) * 3
    assert labels.count() > 0
