"""Quality rules, personal data, pages and languages against plain versions."""

import random
import re
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fixtures import DOCS_DDL, corpus, ordered, prose, sha
from opslens.llm import html, language, pii, quality
from opslens.operators import joins


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), DOCS_DDL).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], DOCS_DDL)


def texts(spark, values):
    return spark.createDataFrame(list(enumerate(values)), "doc_id long, text string")


# -- quality ---------------------------------------------------------------------------------------------------------


def measures(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    wins = Counter(tuple(w[i : i + 5]) for i in range(len(w) - 4))
    hit = {i + k for i in range(len(w) - 4) if wins[tuple(w[i : i + 5])] > 1 for k in range(5)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(hit)


def test_measures(docs):
    got = quality.judge(docs).drop("text", "failed_rule", "kept").collect()
    want = [(r[0], *(m := measures(r[1])), m[0] < 10 or 100 * m[4] > 20 * m[0]) for r in corpus()]
    assert ordered(got) == ordered(want)


def test_measures_of_repeated_words(spark):
    rng = random.Random(4)
    values = [" ".join(rng.choice("abc") for _ in range(n)) for n in range(40)] + ["a\nb\na\n\n \nb\na", "a b c d e " * 3 + "f g h i j " * 2]
    got = quality.measures(texts(spark, values)).orderBy("doc_id").drop("doc_id", "text").collect()
    assert [tuple(r) for r in got] == [measures(v) for v in values]


def test_order_of_rules_does_not_change_what_is_kept(docs):
    rules = quality.standard_rules()
    a, b = (quality.measures(docs).select("doc_id", quality.cascade(x).isNull().alias("k")) for x in (rules, rules[::-1]))
    assert ordered(a.collect()) == ordered(b.collect())


def test_rules_that_reject_more_at_less_cost_come_first(docs):
    rules = [quality.Rule("never", F.lit(False)), quality.Rule("always", F.lit(True)), quality.Rule("null", F.lit(None).cast("boolean"))]
    assert quality.order_rules(quality.measures(docs), rules)[0].name == "always"
    assert quality.judge(docs, rules).where("kept").count() == 0


def test_prose_is_kept_and_junk_is_not(spark):
    good = prose(random.Random(1), 100)
    junk = [" ".join(f"{w}%%%" for w in good.split()), " | ".join(good.split()), " ".join(w.upper() + "!!" for w in good.split()), "\n".join(["same line of words here"] * 30), "1234 " * 20 + good[:20]]
    got = {r.doc_id: r.kept for r in quality.judge(texts(spark, [good, *junk, "a b", "", None])).collect()}
    assert got == {0: True, **{i: False for i in range(1, 9)}}


def test_quality_is_native_and_empty_tables_pass(docs, none):
    plan = quality.judge(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert quality.judge(none).collect() == []


# -- personal data ---------------------------------------------------------------------------------------------------

PATTERNS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def luhn(d):
    odd = [int(x) for x in d[::-1]]
    return sum(odd[::2]) + sum(sum(divmod(2 * x, 10)) for x in odd[1::2])


def base_spans(text):
    out = []
    for kind, pattern in PATTERNS.items():
        for m in re.finditer(pattern, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            if (
                kind == "email"
                or kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))
                or kind == "card" and 16 <= len(d) <= 19 and luhn(d) % 10 == 0
                or kind == "phone" and 8 <= len(d) <= 15
            ):
                out.append((kind, m.start(), m.end()))
    return out


def random_text(rng):
    parts = ["4111 1111 1111 1111", "4111-1111-1111-1112", "378282246310005", "6304000000000000000", "a@b.c_x@d.e", "x@y", "b..c@d.e", "a.b@c..d", "1.2.3.4", "1.2.3.4.5.6.7.8", "256.1.1.1",
             "010.0.0.255", "+1 (017) 555-7713", "+1 2", "+12345678901234567890", "+1+2 345 6789", "é", " ", "  ", ".", "-", "@", "7", "42", "a", "-x-", "\n", "%", "00000000000000000000.1.1.1", "1234567890123456789012"]
    return "".join(rng.choice(parts) for _ in range(rng.randint(0, 14)))


def test_base_spans(spark):
    rng = random.Random(8)
    values = [random_text(rng) for _ in range(1500)] + [None, "", "1" * 5000, "a" * 5000 + "@", "a." * 4000 + "@" + "b." * 4000, "1 " * 4000, "+" + "1" * 4000]
    got = pii.digest(texts(spark, values)).orderBy("doc_id").collect()
    for v, r in zip(values, got):
        want = base_spans(v)
        said = [s for s in r.spans.split(",") if s.split(":")[0] in PATTERNS]
        assert said == [f"{k}:{a}:{b}" for k, a, b in want], v
        assert r.base_sha256 == sha(",".join(said).encode())
        assert [r.n_email, r.n_ip, r.n_card, r.n_phone] == [sum(k == x for k, _, _ in want) for x in PATTERNS]


def test_checksums_and_context_decide_the_added_kinds(spark):
    values = ["IBAN GB82 WEST 1234 5698 7654 32 x", "IBAN GB82 WEST 1234 5698 7654 33 x", "ssn: 123-45-6789", "item 123-45-6789", 'token = "04dbebab91ab85687d33eeaaf9ac699e1188f962"', "see 04dbebab91ab85687d33eeaaf9ac699e1188f962"]
    got = [r.spans for r in pii.digest(texts(spark, values)).orderBy("doc_id").collect()]
    assert got == ["iban:5:32", "", "ssn:5:16", "", "secret:9:49", ""]


def test_redaction_keeps_the_rest(spark):
    df = spark.createDataFrame([(1, "Write to a@b.cd or +1 (017) 555-7713, é 1.2.3.4.", [5]), (2, None, None), (3, "plain", [])], "doc_id long, text string, spans array<int>")
    got = pii.redact(df).orderBy("doc_id").collect()
    assert [tuple(r) for r in got] == [(1, "Write to <EMAIL> or <PHONE>, é <IP>.", [5]), (2, None, None), (3, "plain", [])]


def test_personal_data_is_native_and_prose_has_none(docs, none):
    plan = pii.digest(docs)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert {r.spans for r in pii.digest(docs).collect()} == {""} and pii.digest(none).collect() == []


# -- pages -----------------------------------------------------------------------------------------------------------

PAGES = "page_id long, url string, html string, text string, host string, hashes string"


def test_article_without_what_surrounds_it(spark):
    page = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href="/x">x</a></ul></nav>
      <div class="ad">buy</div><article><h1>Head &amp; more</h1><p>one <b>two</b>
      three<br>four<p>caf&eacute; &#x41;&nbsp;b<ul><li>x<li>y</ul><script>if (a < b) "</p>"</script><aside>no</aside>
      <div id="comments"><p>reader</p></div><form>f</form></article><footer>&copy; me</footer>"""
    rows = [(1, "http://h/1", page), (2, None, None), (3, "x", ""), (4, "http://h/2", "just <i>te</i>xt < 3 & more"), (5, "http://h/3", "<p>a<div>b</p>c"), (1, "http://h/1", page)]
    got = html.extract(spark.createDataFrame([(*r, "t", "h", "s") for r in rows], PAGES)).orderBy("page_id").collect()
    want = "Head & more\none two three four\ncafé A b\nx\ny"
    assert [(r.page_id, r.url, r.text) for r in got] == [(1, "http://h/1", want), (1, "http://h/1", want), (2, None, ""), (3, "x", ""), (4, "http://h/2", "just text < 3 & more"), (5, "http://h/3", "a\nb\nc")]
    assert all(r.n_chars == len(r.text) for r in got)


def test_templates_of_a_site_go_where_a_page_has_no_article(spark):
    rows = [(i, f"https://WWW.site.org/{i}", f"<div>Top of the site</div><p>own text {i}</p><p>{'shared by two' if i < 2 else i}</p><div>All <b>rights</b></div>") for i in range(12)]
    rows += [(100 + i, f"http://other{i}.org/", "<div>Top of the site</div>") for i in range(6)]
    got = {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "own text 0\nshared by two" and got[7] == "own text 7\n7" and got[100] == "Top of the site"


def test_deep_and_empty_pages(spark):
    rows = [(1, "u", "<div>" * 5000 + "deep" + "</div>" * 5000), (2, "u", "</p></div>" * 50), (3, "u", "<p title='a>b' x=\"'\">q<!-- <p>no")]
    got = html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).orderBy("page_id").collect()
    assert [r.text for r in got] == ["deep", "", "q"]
    assert html.extract(spark.createDataFrame([], PAGES)).collect() == []


@pytest.mark.parametrize("page, want", [
    ("<main><p>main text</p><aside><article>teaser</article></aside></main>", "main text"),
    ("<div><p>main text</p></div><nav><article>teaser</article></nav>", "main text"),
    ("<div><p>main text</p></div><section class='related'><article>teaser</article></section>", "main text"),
    ("<div><p>main text</p></div><section class=comments><article>a reader's long comment</article></section>", "main text"),
    ("<article></article><div>main text</div>", "main text"),
    ("<article> <nav>x</nav></article><main>main text</main>", "main text"),
    ("<main><p>main text, a long one</p><div><article>teaser</article></div></main>", "main text, a long one\nteaser"),
    ("<div><h1>head</h1><article>part one, longer</article><article>part two</article></div><p>other", "head\npart one, longer\npart two"),
    ("<body><article>part one, longer</article><p>other</p><article>part two</article>", "part one, longer\npart two"),
    ("<article>outer <article>inner, the longer one</article></article>", "outer\ninner, the longer one"),
    ("<body class=search><form><article>in a form</article></form>", "in a form"),
    ("<aside><article>nothing else</article></aside>", "nothing else"),
])
def test_articles_are_looked_at_where_they_are(page, want):
    tree = html.parse(page)
    assert "\n".join(html.text_of(tree, root) for root in html.article(tree)) == want


LONG = "a paragraph of the article that goes on for quite a while, as paragraphs of articles do. " * 3


@pytest.mark.parametrize("page, want", [
    # names that the main text may have as well
    (f"<article><p>{LONG}</p><section id=discussion><h2>Discussion</h2><p>of the results</p></section></article>", f"{LONG.strip()}\nDiscussion\nof the results"),
    (f"<article><p>{LONG}</p><p class=notice>Mind the gap.</p></article>", f"{LONG.strip()}\nMind the gap."),
    (f"<nav>x</nav><div id=notice class='content social'><p>{LONG}</p></div>", LONG.strip()),
    (f"<div class='main no-sidebar share-page'><p>{LONG}</p></div><p>rest</p>", f"{LONG.strip()}\nrest"),
    ("<div class=comments>all there is</div>", "all there is"),
    # names of several words
    *((f"<article><p>{LONG}</p><div class={name}>Something else.</div></article>", LONG.strip()) for name in ("post-comments", "ad-slot", "cookie-notice", "related-posts", "side-bar", "share_buttons", "'box newsletter-box'")),
    (f"<article><p>{LONG}</p><p class=sponsor-line>Paid for.</p><ul><li>a<li class=ad>b</ul></article>", f"{LONG.strip()}\na"),
    # comments that are longer than the article, and a discussion of readers
    (f"<article><p>{LONG}</p><div class=comments>" + f"<div class=comment><p>{LONG}</p></div>" * 4 + "</div></article>", LONG.strip()),
    (f"<article><p>{LONG}</p><section class=discussion><h2>Replies</h2><div class=comment>no</div></section></article>", LONG.strip()),
])
def test_names_are_weak_evidence(page, want):
    tree = html.parse(page)
    assert "\n".join(html.text_of(tree, root) for root in html.article(tree)) == want


def plain_extraction(rows, least_pages):
    """The same rule by dictionaries: subtrees as nested tuples, counted over the distinct pages of their host."""
    host = lambda url: re.sub(r"^\w+://([^/]*).*", r"\1", url or "").lower()

    def nested(tree, i):
        return (tree[i].tag, tree[i].attributes, *(nested(tree, p) if isinstance(p, int) else " ".join(p.split()) for p in tree[i].parts))

    def looked_at(page, name):
        tree = html.parse(page)
        measured = html.measure(tree)
        roots = html.article(tree, measured)
        return tree, measured, roots, {i: nested(tree, i) for i in html.candidates(tree, roots, measured, name)}

    pages, seen = {(host(u), h or "") for _, u, h in rows}, Counter()
    for name, page in pages:
        seen.update((name, subtree) for subtree in set(looked_at(page, name)[3].values()))
    out = []
    for number, url, page in rows:
        name = host(url)
        tree, measured, roots, subtrees = looked_at(page or "", name)
        count = {t: seen[name, t] for t in subtrees.values()}
        known = {t for t, n in count.items() if n >= least_pages}
        wide = {t for t in known if count[t] >= html.PROSE_SHARE * sum(h == name for h, _ in pages)}
        gone = html.recurring(tree, roots, measured, subtrees, known, wide)
        out.append((number, url, "\n".join(filter(None, (html.text_of(tree, r, gone) for r in roots)))))
    return out


def test_extraction_against_counts_of_whole_subtrees(spark):
    """Hosts with templates that neither a tag nor a name tells of, shared passages, copies, nulls."""
    rng = random.Random(8)
    parts = [f"<div class=k{i}><span>{prose(rng, 3)}</span></div>" for i in range(4)] + [f"<ul><li>{prose(rng, 2)}</li></ul>" for _ in range(3)] + [f"<p>{prose(rng, 12)}</p>" for _ in range(3)]
    rows = []
    for i in range(120):
        name = rng.choice(["a.org", "A.org", "b.org", "c.org"])
        body = "".join(rng.choice([rng.choice(parts), f"<p>{prose(rng, 20)}</p>", f"<section><h2>{prose(rng, 2)}</h2><p>{prose(rng, 15)}</p></section>"]) for _ in range(rng.randint(1, 9)))
        rows.append((i, f"http://{name}/{i}", f"<body><div>{prose(random.Random(name.lower()), 4)}</div>{f'<article>{body}</article>' if rng.random() < 0.5 else body}</body>"))
    rows += [(200 + i, rows[i % 5][1], rows[i % 5][2]) for i in range(30)] + [(300, None, None), (301, "", "<p>x"), (302, None, "<p>x")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = [tuple(r)[:3] for r in html.extract(df).collect()]
    want = plain_extraction(rows, html.LEAST_PAGES)
    assert ordered(got) == ordered(want)
    plain = [(n, u, "\n".join(filter(None, (html.text_of(t, r) for r in html.article(t))))) for n, u, t in ((n, u, html.parse(h or "")) for n, u, h in rows)]
    assert sum(a != b for a, b in zip(ordered(want), ordered(plain))) > 60  # so many pages are changed by templates


def extracted(spark, rows):
    return {r.page_id: r.text for r in html.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}


def test_templates_inside_an_article_go_and_shared_prose_stays(spark):
    box, links = "<div class=box><p>Get our letter</p></div>", "<ul><li><a href=/a>Read this too</a></li></ul>"
    own = [f"the text of page {i} alone, which is about {'abcdefghijklmnopqrstuvwxyz'[i] * 30}" for i in range(20)]
    shared = "<p>A passage that some articles share.</p><ul><li><b>Salt</b></li><li>{}</li></ul>"
    rows = [(i, f"http://h/{i}", f"<article><h1>Head {i}</h1>{box}<p>{own[i]}, see <a href=/b>the same page</a>.</p>{shared.format(i) if i < 8 else ''}{links if i % 2 else ''}<p>Rights reserved</p></article>") for i in range(20)]
    got = extracted(spark, rows)
    assert got == {i: f"Head {i}\n{own[i]}, see the same page." + (f"\nA passage that some articles share.\nSalt\n{i}" if i < 8 else "") for i in range(20)}


def test_copies_and_near_copies_keep_their_text(spark):
    body = "".join(f"<p>Paragraph {k} of the copied page</p>" for k in range(6))
    other = [f"<html><body><div>Top of the site</div><p>the text of page {i} alone, of some length</p></body></html>" for i in range(12)]
    whole = [f"<html><body><div>Top of the site</div>{body}</body></html>"] * 9
    near = [f"<html><body><div>Top of the site</div>{body.replace('copied', 'other')}<p>seen {i} times</p></body></html>" for i in range(9)]
    held = [f"<title>{i}</title><body><div>Top of the site</div><div class=x>{body.replace('copied', 'third')}</div></body>" for i in range(9)]
    parted = [f"<div>Top of the site</div>" + "".join(f"<section><h2>Part {k}</h2><p>Paragraph {k} of parts</p></section>" for k in range(4)) + f"<p>{i}" for i in range(9)]
    for url in ("http://h/{}", None):
        pages = [*other, *whole, *near, *held, *parted, "", None]
        got = extracted(spark, [(i, url and url.format(i), x) for i, x in enumerate(pages)])
        text = "\n".join(f"Paragraph {k} of the copied page" for k in range(6))
        want = [f"the text of page {i} alone, of some length" for i in range(12)] + [text] * 9
        want += [text.replace("copied", "other") + f"\nseen {i} times" for i in range(9)] + [text.replace("copied", "third")] * 9
        want += ["\n".join(f"Part {k}\nParagraph {k} of parts" for k in range(4)) + f"\n{i}" for i in range(9)] + ["", ""]
        assert got == dict(enumerate(want))


def test_copies_of_a_page_count_once(spark):
    page = "<div>A remark of this page</div><p>own text of the page, a good deal of it</p>"
    got = extracted(spark, [(i, f"http://h/{i}", page if i < 20 else page.replace("own", f"other {i}")) for i in range(23)])
    assert all(text.startswith("A remark of this page\n") for text in got.values())


def test_templates_of_a_section_go_on_a_large_host(spark, monkeypatch):
    menu, notice = "<div><a href=/s>Section</a></div>", "<div>Closed on Sundays</div>"
    rows = [(i, "http://large/", f"{menu if i < 30 else ''}<p>the text of page {i} alone, of some length</p>{notice if 10 < i < 20 else ''}") for i in range(400)]
    rows += [(1000 + i, f"http://small{i % 2}/", f"{notice}<p>the text of page {i} alone, of some length</p>") for i in range(9)]
    rows += [(2000, "http://large/", rows[12][2])] * 300
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(4)
    got = {r.page_id: r.text for r in html.extract(df).collect()}
    want = {i: f"the text of page {i} alone, of some length" for i in range(400)}
    want |= {1000 + i: f"{'Closed on Sundays' + chr(10) if i % 2 else ''}the text of page {i} alone, of some length" for i in range(9)} | {2000: want[12]}
    assert got == want
    monkeypatch.setattr(joins, "HOT_PARTITIONS", 0.5)
    small = joins.join_lookup.__kwdefaults__ | {"small_rows": 0, "hot_sample": 1.0}
    monkeypatch.setattr(joins.join_lookup, "__kwdefaults__", small)
    assert ordered(html.extract(df, most_broadcast=0).collect()) == ordered(html.extract(df).collect())
    assert html.extract(df, most_broadcast=0).count() == len(rows)


# -- languages -------------------------------------------------------------------------------------------------------

SYLLABLES = {"aa": "the and ing shu wor".split(), "bb": "der und ein sch keit".split(), "cc": "привет мир как дела".split()}


def spoken(rng, lang, n):
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 3))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(6)
    rows = [(i, spoken(rng, lang, 60), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 40)] + [(900, None, "aa"), (901, "zzz", None), (None, "the and", "aa")]
    return language.learn(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def test_languages(spark, model):
    rng = random.Random(7)
    rows = [(i, spoken(rng, lang, rng.randint(3, 400)), lang) for i, lang in enumerate(["aa", "bb", "cc"] * 30)]
    got = language.predict(spark.createDataFrame(rows, "doc_id long, text string, score string"), model).collect()
    assert len(got) == 90 and sum(r.lang_pred == rows[r.doc_id][2] for r in got) >= 89
    assert all(0 <= r.score <= 1 for r in got)


def test_a_rare_language_is_learned(spark):
    rng = random.Random(9)
    rare = "".join(chr(c) for c in range(0x10D0, 0x10F0))
    rows = [(i, prose(rng, 30), "en") for i in range(2000)] + [(5000 + i, "".join(rng.choice(rare + "   ") for _ in range(300)), "ka") for i in range(2)]
    df = spark.createDataFrame([*rows, (None, rows[-1][1], "ka")], "doc_id long, text string, lang string").repartition(4)
    learned = language.learn(df, training_docs=50)
    assert learned.languages == ["en", "ka"]
    got = {(r.lang, r.lang_pred) for r in language.predict(df, learned).collect()}
    assert got == {("en", "en"), ("ka", "ka")}


def test_spans_of_mixed_text(spark, model):
    rng = random.Random(3)
    text = spoken(rng, "aa", 30) + ". " + spoken(rng, "bb", 50) + " 12 " + spoken(rng, "cc", 10)
    (r,) = language.predict(texts(spark, [text]), model, with_spans=True).collect()
    assert r.lang_pred == "bb" and [s.lang for s in r.spans] == ["aa", "bb", "cc"]
    assert abs(r.spans[0].end - 30) <= 2 and r.spans[-1].start == 80


def viterbi(scores, penalty):
    k = len(scores[0])
    best, path = list(scores[0]), [[i] for i in range(k)]
    for row in scores[1:]:
        step = [max(range(k), key=lambda j: best[j] - penalty * (j != i)) for i in range(k)]
        path = [path[j] + [i] for i, j in enumerate(step)]
        best = [best[j] - penalty * (j != i) + row[i] for i, j in enumerate(step)]
    return max(best)


def test_paths_are_best(model):
    rng = random.Random(5)
    values = ["".join(spoken(rng, rng.choice("abc") * 2, rng.randint(1, 4)) + " " for _ in range(6)) for _ in range(20)] + ["", "x"]
    letters = language.Letters(values, model.table)
    scores, path = model.word_scores(letters).astype(float), model.paths(letters)
    for low, high in zip(letters.texts, letters.texts[1:]):
        if low < high:
            own = scores[range(low, high), path[low:high]].sum() - model.penalty * (path[low + 1 : high] != path[low : high - 1]).sum()
            assert own == pytest.approx(viterbi(scores[low:high].tolist(), model.penalty), abs=1e-3)


def test_texts_without_letters_and_models_without_languages(spark, docs, none, model):
    values = [None, "", " 12 !? ", "\U0001f600"]
    assert {(r.lang_pred, r.score) for r in language.predict(texts(spark, values), model).collect()} == {("und", 0.0)}
    empty = language.learn(none)
    assert {r.lang_pred for r in language.predict(docs, empty).collect()} == {"und"}
    assert language.predict(none, model).collect() == []
