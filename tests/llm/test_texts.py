import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from eventide.llm import html_text, media, pii, quality, queries, url_rules
from tests.llm import brute
from tests.llm.conftest import SF
from tests.oracle import spark_rows, sql_rows


def test_media_payloads(spark, docs, texts, tmp_path):
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r["doc_id"]: r for r in queries.op1_media_columns(spark, str(tmp_path)).collect()}
    assert rows.keys() == texts.keys()
    for i, t in texts.items():
        data = (t or "").encode()
        padded = data + b"\xff" * (-len(data) % 576 or (576 if not data else 0))
        r = rows[i]
        assert (r["n_bytes"], r["payload_bytes"]) == (len(data), len(padded))
        assert r["payload_sha256"] == hashlib.sha256(padded).hexdigest() and r["tail_crc32"] == zlib.crc32(padded[-32:])
        stored = media.to_png(padded)
        assert (r["media_bytes"], r["media_sha256"]) == (len(stored), hashlib.sha256(stored).hexdigest())
        assert r["feature"] == brute.picture_feature(padded) and r["position"] == (1 if (t or "").split("\n")[0].split() else 0)
    same = {}
    for i, t in texts.items():
        r = rows[i]
        assert same.setdefault(t or "", (r["media_bytes"], r["media_sha256"], r["feature"])) == (r["media_bytes"], r["media_sha256"], r["feature"])


def test_base_spans(docs, texts, twice, no_docs):
    got = {r["doc_id"]: r for r in pii.summary(pii.extract(docs)).collect()}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        counts, spans = brute.personal_data(t)
        assert [got[i][f"n_{k}"] for k in pii.KINDS] == counts, (i, t[:80])
        assert got[i]["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
        assert set(spans.split(",")) - {""} <= set(got[i]["spans"].split(","))
    assert pii.extract(twice).count() == 7 and pii.extract(no_docs).count() == 0


def test_patterns_find_unseen_identifiers(spark):
    rows = [(k, f"Please write to user{k}@mail.example.org about it") for k in range(20)]
    rows += [(100, "Please write to root@localhost about it"), (101, "The id abcd1234 stands elsewhere"), (102, "they like to talk@night a lot")]
    found = {r["doc_id"]: r["spans"] for r in pii.summary(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[100] == "email:16:30" and found[101] == "" and found[102] == ""


def test_patterns_find_identifiers_by_other_patterns(spark):
    """What one pattern finds makes another one known, in which no seed stands."""
    rows = [(k, f"Please write to user{k}@mail.example.org about it") for k in range(60)]
    rows += [(100 + k, f"Please write to clerk{k}@desk about it") for k in range(10)]
    rows += [(200 + k, f"Signed today by clerk{k}@desk of here") for k in range(10)] + [(300, "Signed today by chief@desk of here")]
    found = {r["doc_id"]: r["spans"] for r in pii.summary(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert found[100] == "email:16:27" and found[200] == "email:16:27" and found[300] == "email:16:26"


def test_patterns_find_groups_and_trim(spark):
    """Identifiers of several tokens and of any length are found; punctuation around them stays outside."""
    rows = [(k, f"You can ring us on +44 20 7946 0{100 + k} during the day") for k in range(40)]
    rows += [(100, "You can ring us on 030 12 34 5 during the day"), (101, "You can ring us on (0301), during the day"), (102, "It ran on 030 12 34 5 machines")]
    found = {r["doc_id"]: r["spans"] for r in pii.summary(pii.extract(spark.createDataFrame(rows, "doc_id long, text string"))).collect()}
    assert (found[100], found[101], found[102]) == ("phone:19:30", "phone:20:24", "")


def test_very_long_texts_of_many_spans(spark):
    """Time and memory grow with a text's length, not with its square."""
    words = [f"user{k}@mail.example.org" if k % 10 == 0 else f"10.0.{k % 256}.{k // 256 % 256}" if k % 10 == 5 else f"id{k}" if k % 2 else "word" for k in range(100_000)]
    text = " ".join(words)
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    r = pii.summary(pii.extract(df)).first()
    counts, spans = brute.personal_data(text)
    assert [r[f"n_{k}"] for k in pii.KINDS] == counts and r["base_sha256"] == hashlib.sha256(spans.encode()).hexdigest()
    want = " ".join("[EMAIL]" if k % 10 == 0 else "[IP]" if k % 10 == 5 else w for k, w in enumerate(words))
    assert pii.redact(df).first()["text"] == want


def test_redaction(spark, twice):
    rows = [(1, "a x@y.zz b 1.2.3.4 c"), (2, None), (3, ""), (4, "nothing"), (None, "+44 20 7946 0958 rang")]
    got = {r["doc_id"]: r["text"] for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: "a [EMAIL] b [IP] c", 2: None, 3: "", 4: "nothing", None: "[PHONE] rang"}
    assert pii.redact(twice).count() == 7


def test_quality_held_out(spark):
    sf = "/root/testdata/sf0.01"
    scored = queries.op6_quality_classifier(spark, sf).join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").filter("held_out").collect()
    good, bad = ([r["score"] for r in scored if r["quality"] == q] for q in (1, 0))
    auc = sum((g > b) + (g == b) / 2 for g in good for b in bad) / len(good) / len(bad)
    right = sum((r["score"] >= 0.5) == r["quality"] for r in scored) / len(scored)
    assert auc > 0.95 and right > 0.9


def test_quality_rows(spark, docs, texts, twice, no_docs):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = quality.train(docs, labels)
    again = quality.train(docs.repartition(3), labels.union(spark.createDataFrame([(1, None, None), (None, 1, 0), (10**9, 1, 0)], labels.schema)))
    assert (model == again).all()
    rows = quality.classify(docs, model)
    assert set(rows.columns) == set(docs.columns) | {"predicted"}
    got = rows.collect()
    assert len(got) == len(texts) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.7) for r in got)
    assert len({r["score"] for r in got if not r["text"]}) == 1
    assert quality.classify(twice, model).count() == 7 and quality.classify(no_docs, model).count() == 0
    nothing = quality.train(docs, labels.limit(0))
    assert {r["score"] for r in quality.classify(docs, nothing).collect()} == {0.5}
    held = {r["doc_id"]: r["h"] for r in docs.select("doc_id", quality.held_out().alias("h")).collect()}
    assert held == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in texts}


def page(k, article, side="Latest news from the desk"):
    return f"""<!DOCTYPE html><html><head><title>T{k}</title><style>p{{}}</style></head><body><header>Site</header><nav><ul><li>Home</li></ul></nav>
<div class="cookie-notice">We use cookies</div><article><h1>Story {k}</h1>{article}</article><aside>{side}</aside><div id="comments"><p>First!</p></div>
<form><p>Subscribe</p></form><script>var x = "<p>no</p>";</script><footer>&copy; Site</footer></body></html>"""


def test_main_text(spark, no_docs):
    rows = [(k, f"http://h.example.org/{k}", page(k, f"<p>Tom &amp; Jerry\n  no <b>{k}</b></p><p>Caf&eacute; &#x41;<br>b</p>")) for k in range(8)]
    rows += [(100, None, None), (101, "nonsense", ""), (102, "http://x.example/", "<p>plain <i>text</i><p>two"), (103, "http://x.example/", "no markup &lt;b&gt;"), (0, "http://h.example.org/0", rows[0][2])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash")).withColumn("host", F.lit("clash"))
    got = html_text.extract(df).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    said = {r["page_id"]: r["text"] for r in got}
    assert {k: said[k] for k in range(8)} == {k: f"Story {k} Tom & Jerry no {k} Café A b" for k in range(8)}
    assert (said[100], said[101], said[102], said[103]) == ("", "", "plain text two", "no markup <b>")
    assert html_text.extract(df.limit(0)).count() == 0


def test_branches_that_repeat_on_a_site_go(spark):
    """Without telling names: what every page of a site says is cut, what differs stays."""
    html = lambda k: f"<html><body><div class='b7'>Ring us on weekdays</div><div class='c9'><p>Own text {k} of this page</p></div></body></html>"
    df = spark.createDataFrame([(k, f"http://s.example/{k}", html(k)) for k in range(12)], "page_id long, url string, html string")
    assert {r["page_id"]: r["text"] for r in html_text.extract(df).collect()} == {k: f"Own text {k} of this page" for k in range(12)}


def test_names_spare_what_holds_the_article():
    text = "The whole story of the day is told here at length."
    for html in (
        "<body class='no-sidebar'><p>{}</p></body>", "<html class='has-overlay'><body id='search'><div>{}</div></body></html>", "<main class='with-sidebar'><p>{}</p></main>", "<article class='post has-comments'>{}</article>",
        "<div id='search-result-article'>{}</div><p>Back</p>", "<div class='social'><article><p>{}</p></article></div><p>Elsewhere</p>", "<div class='form'><div role='main'>{}</div></div>", "<article><div class='related-work'>{}</div></article>",
        "<article><p>{}</p><div class='related'>More</div></article>", "<div><p>{}</p><div id='comments'>" + "<p>First!</p>" * 30 + "</div></div>", "<div><p>{}</p><p class='ad'>Buy</p></div>", "<article class='menu'><p>{}</p><p class='share'>Tell it</p></article>",
        "<article>{}</article><div class='sidebar'><article>Teaser</article></div>", "<article>{}</article><div id='comments'>" + "<article>First!</article>" * 30 + "</div>",
    ):
        said = html_text.main_text(html.format(text), set())
        assert said.removesuffix(" Back") == text, html
    assert html_text.main_text("<div><p>Long enough to stay</p><p class='no-ads'>Yes</p></div>", set()) == "Long enough to stay Yes"


def test_articles_on_copied_pages_stay(spark, monkeypatch):
    """Copies of a page are one page, and a few articles on many pages are no boilerplate."""
    html = lambda t, wrap: f"<html><head><link href='/{t}'></head><body><div class='b7'>Ring us</div>{wrap.format(f'Own text {t}')}</body></html>"
    div, story = "<div class='c9'><p>{}</p></div>", "<div class='w1'><article class='story'><p>{}</p></article></div>"
    rows = [(k, f"http://a.example/{k}", html("x", div)) for k in range(7)]
    rows += [(10 + k, f"http://b.example/{k}", html(k % 3, story)) for k in range(60)]
    rows += [(100 + k, f"http://c.example/{k}", html(k % 6, div)) for k in range(60)]
    rows += [(200 + k, f"http://d.example/{k}", html(k % 3, div).replace("</body>", f"<div class='n'>No {k}</div></body>")) for k in range(400)]
    rows += [(1000 + k, f"http://e.example/{k}", html("x", story).replace("</body>", f"<div class='n'>No {k}</div></body>")) for k in range(20)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    for limit in (html_text.BROADCAST_COPIES, 0):
        monkeypatch.setattr(html_text, "BROADCAST_COPIES", limit)
        said = {r["page_id"]: r["text"] for r in html_text.extract(df).collect()}
        assert {said[k] for k in range(7)} == {"Ring us Own text x"}
        assert {k: said[10 + k] for k in range(60)} == {k: f"Own text {k % 3}" for k in range(60)}
        assert {k: said[100 + k] for k in range(60)} == {k: f"Own text {k % 6}" for k in range(60)}
        assert {k: said[200 + k] for k in range(400)} == {k: f"Own text {k % 3} No {k}" for k in range(400)}
        assert {said[1000 + k] for k in range(20)} == {"Own text x"}


def test_pages_of_any_shape():
    """Unquoted values, quotes and comments that nothing closes, and deep nests, in time that grows with the page."""
    said = lambda h: html_text.main_text(h, {1})
    assert said("<p title=it's>Hello</p>") == said("<p title='it\"s' class=x/>Hello</p>") == said("<P TITLE = a>Hello<!-- <p>no</p> --></P>") == "Hello"
    assert said('<p title="x>Hello</p> world') == "Hello world" and said("a < b <3 <b>c</b> <") == "a < b <3 c <"
    assert said("<p>Hello</p><!-- no") == said("<p>Hello</p><a href=") == said("<p>Hello</p></") == "Hello" or said("<p>Hello</p></") == "Hello </"
    n = 20_000
    assert said("<div>" * n + "deep" + "</div>" * n + "after") == "deep after"
    assert said("<div class='ad-x'>" * n + "deep" + "</div>" * n + "after") == "after"
    assert said("<p>" + "<blockquote>" * n + "deep" + "</x>" * n) == "deep" and said("<ul><li>" * n + "deep") == "deep"
    assert said("Hello" + '<a href="x ' * 5 * n) == said("Hello" + "<a x='>' " * 5 * n) == said("Hello<script>" * 1) == "Hello"
    assert said("<" * n) == "<" * n


def test_style_tree(spark):
    """Every node's importance and pages, as a plain version has them; deep branches hand theirs up."""
    page = lambda k: f"<html><body><div class='a'><p>Ring us</p></div><div class='b'><div><div><div><p>Text {k % 3}</p></div></div></div></div>" + ("<div class='c'><p>Extra</p></div>" if k % 2 else "") + f"<p>{k}</p></body></html>"
    rows = [(f"http://h{k % 2}.example/{k}", page(k)) for k in range(14)] + [("http://h0.example/again", page(0)), ("http://one.example/", page(5))]
    df = spark.createDataFrame([(k, *r) for k, r in enumerate(rows)], "page_id long, url string, html string")
    got = {(r["host"], r["node"]): (r["pages"], round(r["importance"], 6)) for r in html_text.style_tree(df).collect() if r["node"]}
    want = brute.style_tree([(u.split("/")[2], h) for u, h in rows], html_text._short)
    assert got == want and len(want) > 20


def test_quality_features_and_training():
    """Scores and training equal versions that take one feature and one document at a time."""
    import numpy as np

    texts = [t.encode() for t in ("a good text about the sea", "bad bad bad", "", " \t", "Good 日本 text", "x", "the sea the sea the sea and more of it")]
    labels = np.array([1, 0, 0, 0, 1, 0, 1])
    model = quality.Model().fit(texts, labels)
    assert np.allclose(model.folded(), brute.fitted(texts, labels, quality), atol=1e-4)
    data = np.frombuffer(b"".join(texts), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    folded = model.folded()
    want = [1 / (1 + np.exp(-(np.mean([float(folded[f]) for f in brute.quality_features(t, quality.BITS)]) + float(folded[-1])))) for t in texts]
    assert np.allclose(quality.scores(folded, data, offsets), want, atol=1e-6)


def test_url_rules(spark):
    urls = ["http://a.example.net/en/x?y", "HTTP://EXAMPLE.NET/en", "http://example.net/en/", "http://notexample.net/", "http://net/", "http://x.org/fr/1#f", "http://x.org/de", "http://example.com/de/a", "http://sub.example.com/de/", "http://example.com/fr/", "no url", "", None, "http://", "http:///p", "http://a.example.net?q=/en/", "ftp://u:p@h.net:80/", "http://é.net/", "x://y://z.net/en", "http://net./x"]
    rows = list(enumerate(urls)) + [(0, urls[0])]
    df = spark.createDataFrame(rows, "page_id long, url string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit("clash"))
    for extra in ([], [("org", "/", "block"), ("", "/", "block"), (None, "/", "block"), ("x.org", None, "block")]):
        rules = queries.RULES + extra
        got = url_rules.apply_rules(df, spark.createDataFrame(rules, "host string, path string, verdict string"))
        usable = [r for r in rules if None not in r and r[0]]
        assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, *brute.url_verdict(u, usable)) for i, u in rows], key=repr)
    none = spark.createDataFrame([], "host string, path string, verdict string")
    assert {r["verdict"] for r in url_rules.apply_rules(df, none).collect()} == {"allow"} and url_rules.apply_rules(df.limit(0), none).count() == 0


def test_url_rules_in_portions(spark, monkeypatch):
    monkeypatch.setattr(url_rules, "PORTION_BYTES", 20)
    rules = [(f"h{k}.example", f"/{'p' * (k % 4)}", "block" if k % 2 else "allow") for k in range(30)] + [("example", "/pp", "block")]
    rows = [(k, f"http://w.h{k % 35}.example/{'p' * (k % 5)}") for k in range(150)]
    got = url_rules.apply_rules(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame(rules, "host string, path string, verdict string"))
    assert sorted(map(tuple, got.collect()), key=repr) == sorted([(i, *brute.url_verdict(u, rules)) for i, u in rows], key=repr)


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == sql_rows(queries.ORACLE_SQL[name], SF)


def test_media_documents(spark):
    """Items keep their order; captions stay with their pictures; what can't be resolved has no payload."""
    docs = spark.createDataFrame([(1, "picture one"), (2, None)], "doc_id long, text string")
    refs, stored = media.store(docs)
    digest = {r["doc_id"]: r["digest"] for r in refs.collect()}
    html = f'<p>Before</p><figure><img src="media:{digest[1]}"><figcaption>A caption</figcaption></figure><p>Between</p><img src="media:{"0" * 64}"><p>After</p>'
    pages = spark.createDataFrame([(7, html), (8, None), (9, "")], "doc_id long, html string")
    rows = sorted((r for r in media.resolve(media.interleave(pages), media.read_back(stored)).collect() if r["doc_id"] == 7), key=lambda r: r["position"])
    assert [r["kind"] for r in rows] == ["text", "media", "text", "media", "text"]
    clash = spark.createDataFrame([(html,), (None,)], "html string").withColumn("text", F.lit("its id"))
    named = media.resolve(media.interleave(clash, id_col="text"), media.read_back(stored), id_col="text")
    assert named.filter("kind = 'media'").count() == 2 and named.columns.count("text") == 1
    broken = spark.createDataFrame([("a", b"no picture"), ("b", None), ("c", media.SIGNATURE)], "digest string, media binary")
    assert {(r["digest"], r["payload_bytes"], r["media_bytes"]) for r in media.read_back(broken).collect()} == {("a", None, 10), ("c", None, 8)}
    real = spark.read.parquet(f"{SF}/pages.parquet").select(F.col("page_id").alias("doc_id"), "html")
    for r in media.interleave(real).limit(20).collect():
        assert [x["position"] for x in r["items"]] == list(range(len(r["items"]))) and any(x["kind"] == "text" for x in r["items"])
    assert rows[1]["caption"] == "A caption" and rows[1]["payload_sha256"] == hashlib.sha256(b"picture one" + b"\xff" * 565).hexdigest() and rows[3]["payload_sha256"] is None
