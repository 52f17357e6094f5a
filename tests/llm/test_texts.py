import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from almoneda.llm import chat, decontaminate, html_text, quality, rollups, toxicity


def edit_in(pattern, text):
    """Least edits of pattern anywhere in text, by the textbook table."""
    row = list(range(len(pattern) + 1))
    best = row[-1]
    for c in text:
        new = [0]
        for i, p in enumerate(pattern, 1):
            new.append(min(row[i] + 1, new[-1] + 1, row[i - 1] + (c != p)))
        row = new
        best = min(best, row[-1])
    return best


def test_leaks_equal_brute_force(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 7)))
    prose = lambda n: " ".join(word() for _ in range(n))
    items = [(i, prose(rng.randint(6, 30))) for i in range(12)]
    docs = []
    for i in range(120):
        text = prose(rng.randint(0, 60))
        if i % 2:
            x = list(rng.choice(items)[1])
            for _ in range(rng.randint(0, max(1, int(0.16 * len(x))))):
                at, kind = rng.randrange(len(x)), rng.randrange(3)
                x[at : at + (kind != 0)] = [] if kind == 1 else [rng.choice("abcdxyz")]
            text = text + " " + ("".join(x).upper() if i % 4 == 1 else "".join(x).replace(" ", "\n ")) + " " + prose(5)
        docs.append((i, text))
    docs += [(500, None), (501, ""), (502, "z " * 100_000 + items[3][1])]
    table = spark.createDataFrame(items + [(90, None), (91, "tiny"), (3, items[3][1])], "item_id long, text string")
    df = spark.createDataFrame(docs, "doc_id long, text string").withColumn("hits", F.lit(0))
    out = decontaminate.find_leaks(df, table)
    assert out.columns == ["doc_id", "text", "hits", "hits_"]
    for r in out.collect():
        plain = decontaminate.normalize(r.text)
        want = {}
        if len(plain) < 5000:
            for i, t in items:
                t = decontaminate.normalize(t)
                if (d := edit_in(t, plain)) <= int(0.1 * len(t)) and len(t) >= 25:
                    want[i] = d
            assert {h.item_id: h.distance for h in r.hits_} == want, r.doc_id
        for h in r.hits_:
            item = decontaminate.normalize(dict(items)[h.item_id])
            assert edit_in(item, decontaminate.normalize(r.text[h.start : h.end])) <= h.distance
    assert [h.item_id for r in out.filter("doc_id = 502").collect() for h in r.hits_] == [3]
    short = spark.createDataFrame([(1, "Is it so?"), (2, "tiny"), (3, "a b"), (4, " "), (5, "a b")], "item_id long, text string")
    texts = spark.createDataFrame([(1, "well, is  IT\nso? yes"), (2, "this is it so?"), (3, "tinyest"), (4, "destiny"), (5, "a tiny, a b"), (6, "a bc")], "doc_id long, text string")
    for size in (4_000_000, 8):
        got = decontaminate.find_leaks(texts, short, block_bytes=size).collect()
        assert {r.doc_id: [(h.item_id, h.distance, h.start, h.end) for h in r.hits] for r in got} == {1: [(1, 0, 6, 16)], 2: [(1, 0, 5, 14)], 3: [], 4: [], 5: [(2, 0, 2, 6), (3, 0, 8, 11), (5, 0, 8, 11)], 6: []}
    blocks = decontaminate.find_leaks(df.drop("hits"), table, block_bytes=100)
    one = decontaminate.find_leaks(df.drop("hits"), table)
    key = lambda x: sorted((r.doc_id, sorted(map(tuple, r.hits))) for r in x.collect())
    assert key(blocks) == key(one)
    assert decontaminate.find_leaks(df.drop("hits"), table.limit(0)).filter("size(hits) > 0").count() == 0
    assert decontaminate.find_leaks(df.limit(0), table).count() == 0


@pytest.mark.parametrize("page,want", [
    (None, ""), ("", ""), ("<p>", ""), ("plain & simple &lt;b&gt;", "plain & simple <b>"), ("<p>a<b>b</b>c<p>d &amp; e\n\t f<br>g</p>", "abc d & e f g"),
    ("<body><header>Top</header><main><h1>T</h1><p>text of it</p><aside>no</aside><form><p>q</p></form></main><footer>f</footer>", "T text of it"),
    ("<article><header><h1>Title</h1></header><p>Body.</p><section class='comments'><p>hi</p></section></article>", "Title Body."),
    ("<div class=ad>buy</div><article><p>x <script>var t='</p>';</script>y<!-- <p>no --> z<style>p{}</style></p></article>", "x y z"),
    ("<table><tr><td>a<td>b<tr><td>c</table>", "a b c"), ("<ul><li>a<li>b</ul>", "a b"),
    ("<html><body><div id='menu'><a href=1>x</a></div><div class='content'><p>Long article text here, with many words that matter.</p><p>Second para.</p></div><div class='cookie-notice'>ok</div><div class='footer'>c</div></body></html>", "Long article text here, with many words that matter. Second para."),
])
def test_extract(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("part", [
    '<section id="related-work"><p>Part.</p></section>', '<div id="side-effects"><p>Part.</p></div>', '<section class="legal-framework">Part.</section>', '<div id="search-algorithms">Part.</div>',
    "<ul class='tags'><li>Part.</li></ul>", "<figure><img src=x><figcaption>Part.</figcaption></figure>", "<p><math><mi>Part.</mi><annotation>tex</annotation></math></p>", "<noscript>Part.</noscript>", "<h4 class=alerts>Part.</h4>",
])
def test_extract_keeps_parts_of_articles_whatever_their_names(part):
    text = "Long article text here, with many words that matter."
    for tag in ("article", "main", "div"):
        page = f"<body><div id='menu'><a href=1>x</a></div><{tag}><p>{text}</p>{part}<p>{text}</p><div class=ad>Buy.</div><div class='related-links'><a href=2>Another article</a></div></{tag}></body>"
        assert html_text.extract(page) == f"{text} Part. {text}", tag


def test_extract_keeps_all_parts_of_an_article():
    """Siblings in a wrapper or under the body, several marked articles, and a page whose only mark is a teaser."""
    parts = [" ".join(f"Paragraph {i} of part {p}, which says a good deal about its matter." for _ in range(3)) for p in range(3) for i in range(2)]
    box = lambda tag, ps: f"<{tag}>" + "".join(f"<p>{p}</p>" for p in ps) + f"</{tag}>"
    links = "<div><ul>" + "".join(f"<li><a href={i}>Link {i}</a></li>" for i in range(9)) + "</ul></div>"
    whole = " ".join(parts)
    for tag in ("div", "article"):
        body = box(tag, parts[:4]) + box(tag, parts[4:5]) + box(tag, parts[5:])
        assert html_text.extract(f"<body>{links}{body}</body>") == whole
        assert html_text.extract(f"<body>{links}<div>{body}</div>{links}</body>") == whole
    teaser = "<article class=card><a href=1>See also</a></article>"
    assert html_text.extract(f"<body>{links}{box('div', parts)}{teaser}</body>") == whole
    assert html_text.extract(f"<body>{box('article', parts[:4])}{box('div', parts[4:])}{links}</body>") == whole


@pytest.mark.parametrize("page", [
    "<a " * 350_000, "<div>" * 90_000 + "</i>" * 90_000, "<b>" * 150_000 + "</i>" * 150_000, "<p><div>" + "<b>" * 80_000 + "</p>" * 80_000, "<iframe>" * 130_000, "<a href=\"x>" * 90_000, "<" * 10**6,
    "<ul>" + "<li>" * 100_000, "<table>" + "<tr><td>x" * 60_000, "<!--" * 200_000, "<div class=related>" * 50_000,
])
def test_hostile_pages_take_linear_time(page):
    import time

    took = []
    for part in (page[: len(page) // 4], page):
        began = time.process_time()
        html_text.extract(part)
        took.append(time.process_time() - began)
    assert took[1] < max(2.0, 10 * took[0]) and took[1] < 30


@pytest.mark.parametrize("page,want", [
    ('<article><p>Body text of the article.</p></article><article class="comment"><p>Reader says hi</p></article>', "Body text of the article."),
    ('<article><p>Body text.</p><div title="a hidden gem"><p>Kept part.</p></div><div hidden><p>no</p></div><p hidden="">no</p></article>', "Body text. Kept part."),
    ('<article><p>Body text.</p><div itemprop="comment"><p>no</p></div></article>', "Body text."), ("<p>1 < 2 and <b>3</b></p>", "1 < 2 and 3"), ("<p>open <a href='x", "open <a href='x"),
])
def test_extract_by_hand(page, want):
    assert html_text.extract(page) == want


def brute_densities(node, out, body=None):
    """Density of each element of a well-formed page, from its whole subtree, and the sum of its children's."""
    import math

    def count(e):
        inner = [count(x) for x in e]
        own = len(" ".join(" ".join([e.text or "", *[x.tail or "" for x in e]]).split()))
        c, t = own + sum(i[0] for i in inner), len(e) + sum(i[1] for i in inner)
        return (c, t, c, 1 + sum(i[3] for i in inner)) if e.tag == "a" else (c, t, sum(i[2] for i in inner), sum(i[3] for i in inner))

    whole = body or count(node)

    def density(e):
        c, t, lc, lt = count(e)
        if not c:
            return 0.0
        ratio = c / max(lc, 1) * (t or 1) / (lt or 1)
        return c / (t or 1) * max(math.log(ratio), 0) / math.log(c / max(c - lc, 1) * lc + (whole[2] or 1) / (whole[0] or 1) * c + math.e)

    out.append((node.get("n"), density(node), sum(density(x) for x in node)))
    for x in node:
        brute_densities(x, out, whole)
    return out


def test_densities_equal_brute_force_and_decide():
    import xml.etree.ElementTree as ET

    rng = random.Random(12)
    prose = lambda n: " ".join(rng.choice(["river", "stone", "of", "walking", "light"]) for _ in range(n))

    def part(depth):
        if depth == 0 or rng.random() < 0.3:
            return f"<p n='{rng.random()}'>{prose(rng.randint(3, 60))}</p>" if rng.random() < 0.6 else f"<ul n='{rng.random()}'>" + "".join(f"<li n='{rng.random()}'><a n='{rng.random()}'>{prose(2)}</a></li>" for _ in range(rng.randint(1, 6))) + "</ul>"
        return f"<div n='{rng.random()}'>" + "".join(part(depth - 1) for _ in range(rng.randint(1, 4))) + "</div>"

    for _ in range(60):
        page = "<html n='0'>" + "".join(part(3) for _ in range(3)) + "</html>"
        want = brute_densities(ET.fromstring(page), [])
        root = html_text.parse(page)
        order = html_text.densities(root)
        got = sorted((round(n.density, 9), round(n.sum, 9)) for n in order)
        assert got == sorted((round(d, 9), round(s, 9)) for _, d, s in want)
        peak = max(order, key=lambda n: (n.sum, n.chars))
        stack, paragraphs = [peak], []  # the core's paragraphs are all in the result
        while stack:
            n = stack.pop()
            paragraphs += ["".join(x for x in n.items if isinstance(x, str))] if n.tag == "p" else []
            stack += [x for x in n.items if not isinstance(x, str)]
        text = html_text.extract(page)
        assert all(" ".join(p.split()) in text for p in paragraphs)


def test_density_overrules_marks():
    prose = "".join(f"<p>Paragraph {i} of the story, which says a good deal about its matter and goes on for a while.</p>" for i in range(20))
    page = f"<body><article class='card'><h2>Teaser card</h2></article><div class='content'>{prose}</div></body>"
    assert all(f"Paragraph {i} " in html_text.extract(page) for i in range(20))


def test_extract_keeps_whole_articles(spark, sf_dir):
    import html

    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("text", F.lit(1))
    out = html_text.main_text(pages)
    assert out.columns[-1] == "text_"
    for r in out.collect():
        body = re.search(r"<article>(.*)</article>", r.html, re.S)[1]
        body = re.sub(r"<[^>]+>", "", re.sub(r"</?(?:p|h1|br)[^>]*>", " ", body))
        assert r.text_ == " ".join(html.unescape(body).split())
    assert html_text.main_text(pages.limit(0)).count() == 0
    deep = "<div>" * 5000 + "<p>deep</p>"
    assert html_text.extract(deep) == "deep" and html_text.extract("<a " * 3000) != None  # noqa: E711


def brute_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    runs = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    inside = {i + k for i in range(len(words) - 7) if runs[tuple(words[i : i + 8])] > 1 for k in range(8)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    n = len(words)
    return (n, sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside), n < 20 or 100 * len(inside) > 30 * n)


def test_quality_counts(spark, sf_dir):
    rows = [(r.doc_id, r.text, r.lang) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]
    rows += [(None, None, None), (900, "", "en"), (901, "a\n\na\n \n \nb" * 9, "xx"), (902, "x y z " * 40_000, "en"), (903, "é ß #$%", None), (903, "é ß #$%", None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("kept", F.lit(1))
    got = quality.quality(df.repartition(5))
    fields = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    assert Counter((r.doc_id, *[r[f] for f in fields]) for r in got.collect()) == Counter((i, *brute_quality(t)) for i, t, _ in rows)
    assert got.filter("base_failed AND kept").count() == 0 and quality.quality(df.limit(0)).count() == 0


def test_jensen_shannon(spark):
    js = lambda p, q: spark.range(1).select(quality.jensen_shannon(F.array(*map(F.lit, p)), F.array(*map(F.lit, q)))).first()[0]
    assert js([1.0, 1.0], [5.0, 5.0]) == 0 and js([1.0, 0.0], [0.0, 3.0]) == 1
    for p, q in (([1.0, 3.0], [3.0, 1.0]), ([5.0, 0.0, 2.0], [1.0, 1.0, 9.0])):
        a, b = np.array(p) / sum(p), np.array(q) / sum(q)
        entropy = lambda x: -sum(v * np.log2(v) for v in x if v > 0)
        assert abs(js(p, q) - np.sqrt(entropy((a + b) / 2) - (entropy(a) + entropy(b)) / 2)) < 1e-12


def test_frozen_references_judge_alike_whatever_else_is_judged(spark):
    rng = random.Random(8)
    prose = lambda: " ".join(rng.choice(["the", "of", "and", "in", "cat", "house", "river", "walks"]) for _ in range(150))
    rows = [(i, prose(), "en") for i in range(40)] + [(100 + i, " ".join(f"{i}{j}#%{j}" for j in range(200)), "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    good = spark.range(30).select("id")
    got = {r.doc_id: r.kept for r in quality.quality(df, trusted=good).collect()}
    assert all(got[i] for i in range(40)) and not any(got[i] for i in range(100, 300))
    measured = quality.measures(df.select(F.col("doc_id").alias("id"), "lang", "text"))
    refs = quality.language_references(measured, F.lit(False), good)
    alone = {r.doc_id: r.kept for r in quality.quality(df.filter("doc_id >= 90"), refs=refs).collect()}
    assert alone == {i: False for i in range(100, 300)}


def test_classes_are_disjoint():
    for c in map(chr, [*range(128), 233, 0x1F600]):
        assert [k for k, p in quality.CLASSES.items() if re.fullmatch(p, c)] == [list(quality.CLASSES)[quality._CLASS_OF[c.encode()[0]]]], c


def test_quality_keeps_prose_and_drops_junk(spark):
    d = "/root/testdata/sf0.01"
    df, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    x = quality.quality(df, trusted=labels.filter("quality = 1").select(F.col("doc_id").alias("id"))).join(labels, "doc_id").filter("NOT base_failed").groupBy("quality").agg(F.avg(F.col("kept").cast("int")).alias("k")).collect()
    share = {r.quality: r.k for r in x}
    assert share[1] >= 0.99 and share[0] <= 0.4


def test_chat_trees(spark):
    rows = [(1, 1, None, "user", "q", 0.0), (1, 2, 1, "assistant", "a1", 1.0), (1, 3, 1, "assistant", "a2", 5.0), (1, 4, 3, "user", None, None), (1, 5, 4, "assistant", "end", 0.5), (1, 6, 2, "user", "x", 9.0),
            (2, 1, 99, "user", "orphan", 0.0), (3, 1, 2, "user", "loop", 0.0), (3, 2, 1, "user", "loop", 0.0), (None, 1, None, "user", "no tree", 0.0), (1, 5, 4, "assistant", "end", 0.5)]
    df = spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double")
    paths = chat.reply_paths(df)
    got = sorted((r.tree or 0, [p.msg for p in r.path], r.score) for r in paths.collect())
    assert got == [(0, [1], 0.0), (1, [1, 2, 6], 10.0), (1, [1, 3, 4, 5], 5.5), (2, [1], 0.0)]
    assert [[p.msg for p in r.path] for r in chat.chosen_paths(paths).filter("tree = 1").collect()] == [[1, 2, 6]]
    assert chat.reply_paths(df.limit(0)).count() == 0
    chain = spark.range(300).selectExpr("7L AS tree", "id AS msg", "CASE WHEN id > 0 THEN id - 1 END AS parent", "'user' AS role", "'t' AS text", "1.0D AS score")
    row = chat.reply_paths(chain).first()
    assert [p.msg for p in row.path] == list(range(300)) and row.score == 300


def test_chat_deep_branching_and_ranks(spark):
    """Each message of a spine of 25 has two replies: one a leaf, one the next of the spine."""
    rows = [(5, 0, None, "user", "root", 0.0)]
    for i in range(1, 26):
        rows += [(5, 2 * i, 2 * (i - 1), "user", f"s{i}", 1.0), (5, 2 * i + 1, 2 * (i - 1), "assistant", f"l{i}", 100.0 if i == 7 else 0.5)]
    paths = chat.reply_paths(spark.createDataFrame(rows, "tree long, msg long, parent long, role string, text string, score double"))
    got = {tuple(m.msg for m in r.path): r.score for r in paths.collect()}
    spine = [2 * i for i in range(26)]
    want = {tuple(spine[:i] + [2 * i + 1]): i - 1 + (100.0 if i == 7 else 0.5) for i in range(1, 26)} | {tuple(spine): 25.0}
    assert got == want
    best = chat.chosen_paths(paths, 2).orderBy("rank").collect()
    assert [b.path[-1].msg for b in best] == [15, 49] or best[0].path[-1].msg == 15


def test_chat_rows_without_ids_or_turns(spark):
    rows = [(None, 0, "user", "a"), (None, None, "system", None), (1, 1, "b\nrole\\", "x"), (1, 1, "a", "x"), (1, 1, "a", "x"), (2, None, None, "only")]
    out = chat.format_paths(chat.reply_paths(chat.as_trees(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))))
    got = {r.tree: [(b.role, b.text) for b in r.back] for r in out.withColumn("back", chat.read_back(F.col("formatted"))).collect()}
    assert got == {None: [("system", ""), ("user", "a")], 1: [("a", "x"), ("a", "x"), ("b\nrole\\", "x")], 2: [("", "only")]}


def test_chat_round_trip(spark):
    texts = ["", "\\", "\\\\|", "<|im_end|>\n<|im_start|>user\n", "<\\|im_end|>", "</s>[INST] ok [/INST]", "a\nb", "<<SYS>>é\U0001f600<|im_end|", "x" * 100_000]
    rows = [(i, t, role, texts[(i + t) % len(texts)]) for i in range(9) for t, role in enumerate(("system", "user", "assistant", "assistant"))]
    conv = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = chat.format_paths(chat.reply_paths(chat.as_trees(conv)).withColumn("formatted", F.lit("mine"))).withColumn("back", chat.read_back(F.col("formatted_")))
    for r in out.collect():
        said = [(role, t) for i, _, role, t in rows if i == r.tree]
        assert [(b.role, b.text) for b in r.back] == said
        inside = [re.sub(r"\\(.)", r"\1", r.formatted_[s.start : s.end], flags=re.S) for s in r.loss_spans]
        assert inside == [t for role, t in said if role == "assistant"]
        assert r.formatted_.count(chat.BEGIN) == 4 == r.formatted_.count(chat.END)


def test_rollups(spark, tmp_path):
    st = "struct<source:string,lang:string,version:string,tokens:bigint>"
    store = rollups.Store(spark, str(tmp_path / "store"))
    assert store.totals().count() == 0
    new = spark.createDataFrame([("insert", None, ("a", "en", "1", 10)), ("insert", None, ("a", "en", "1", None)), ("insert", None, (None, None, "1", 7)), (None, None, ("a", "en", "1", 99)), ("insert", None, None)], f"op string, old {st}, new {st}")
    assert store.commit("b1", new) and not store.commit("b1", new)
    fix = spark.createDataFrame([("revise", ("a", "en", "1", 10), ("b", "en", "2", 12)), ("delete", (None, None, "1", 7), None)], f"op string, old {st}, new {st}")
    assert store.commit("b2", fix)
    assert sorted(map(tuple, store.totals().collect()), key=str) == [("a", "en", "1", 1, 0), ("b", "en", "2", 1, 12)]
    assert store.commit("empty", new.limit(0)) and store.totals().count() == 2
    with pytest.raises(ValueError):
        store.commit("a/b", new)
    # Whatever is compacted, totals stay, and no batch counts twice.
    before = sorted(map(tuple, store.totals().collect()), key=str)
    assert store.compact() and not store.compact() and not store.commit("b2", fix)
    assert sorted(map(tuple, store.totals().collect()), key=str) == before
    assert store.commit("b3", spark.createDataFrame([("insert", None, ("b", "en", "2", 5))], f"op string, old {st}, new {st}")) and store.compact()
    assert sorted(map(tuple, rollups.Store(spark, str(tmp_path / "store")).totals().collect()), key=str) == [("a", "en", "1", 1, 0), ("b", "en", "2", 2, 17)]
    # Of two processes that commit one batch the later one loses, though it saw no such batch when it began.
    late = rollups.Store(spark, str(tmp_path / "store"))
    late._since, late._has = lambda: (0, None, -1, []), lambda *_: False
    assert not late.commit("b3", new) and len(store._names("data")) == 4
    assert sorted(map(tuple, store.totals().collect()), key=str) == [("a", "en", "1", 1, 0), ("b", "en", "2", 2, 17)]


def test_rollups_of_many_batches(spark, tmp_path):
    """What a commit reads doesn't grow with the batches before it; entries go to further folders; ids hold for good."""
    st = "struct<source:string,lang:string,version:string,tokens:bigint>"
    one = spark.createDataFrame([("insert", None, ("a", "en", "1", 1))], f"op string, old {st}, new {st}").coalesce(1)
    store, reads = rollups.Store(spark, str(tmp_path / "store"), compact_after=3), []
    store.FOLDER, store.KEPT = 2, 2  # costs recur every six commits
    get, names = store._get, store._names
    store._get = lambda *a: reads.append(a) or get(*a)
    store._names = lambda f: [reads.append(x) or x for x in names(f)]
    cost = []
    for i in range(18):
        reads.clear()
        assert store.commit(f"b{i}", one)
        cost.append(len(reads))
    assert max(cost[12:]) <= max(cost[6:12]) and len(names("versions")) <= 2
    assert not any(store.commit(f"b{i}", one) for i in (0, 7, 17))
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "1", 18, 18)]
    # A commit that was cut off before its id was marked counts, and isn't taken twice.
    put = store._put
    store._put = lambda folder, *a: folder.startswith("ids/") or put(folder, *a)
    assert store.commit("cut", one)
    store._put = put
    assert not store.commit("cut", one) and store.compact() and not store.commit("cut", one)
    assert [tuple(r) for r in store.totals().collect()] == [("a", "en", "1", 19, 19)]


def test_counts_by_a_public_tokenizer(spark):
    import os

    path = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(path):
        pytest.skip("no tokenizer file")
    from tokenizers import Tokenizer

    rows = [(1, "Hello, world"), (2, None), (3, ""), (4, "<|endoftext|> ñ" * 50)]
    got = {r.doc_id: r.tokens_ for r in rollups.count_with_tokenizer(spark.createDataFrame(rows, "doc_id long, text string").withColumn("tokens", F.lit(0)), path).collect()}
    t = Tokenizer.from_file(path)
    assert got == {i: len(t.encode(x or "", add_special_tokens=False).ids) for i, x in rows}


def test_rollup_query_with_null_ids_and_repeats(spark, tmp_path):
    rows = [(1, "a b", "s", "en"), (1, "a b", "s", "en"), (2, "a b", "s", "en"), (None, "a b", "s", "en"), (None, "x", None, "en"), (None, "x", None, "en"), (5, None, "s", None), (6, "", "s", None)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {(r.source, r.lang, r.version): (r.docs, r.tokens) for r in rollups.op10_token_rollup(spark, str(tmp_path)).collect()}
    assert got == {("s", "en", "pieces-1"): (2, 4), (None, "en", "pieces-1"): (2, 2), ("s", None, "pieces-1"): (1, 0)}


def test_toxicity_on_held_out(spark):
    d = "/root/testdata/sf0.1"
    docs, labels = spark.read.parquet(f"{d}/documents.parquet"), spark.read.parquet(f"{d}/labels.parquet")
    got = toxicity.toxicity(docs, labels).join(labels, "doc_id").filter("held_out").toPandas()
    caught, wrong = got[got.toxic == 1].predicted.mean(), got[got.toxic == 0].predicted.mean()
    order = got.score.rank()
    pos, neg = (got.toxic == 1).sum(), (got.toxic == 0).sum()
    auc = (order[got.toxic == 1].sum() - pos * (pos + 1) / 2) / (pos * neg)
    assert caught >= 0.85 and wrong <= 0.01 and auc >= 0.97 and got.score.between(0, 1).all()


def test_toxicity_edges(spark):
    docs = spark.createDataFrame([(None, None, "a"), (1, "", "b"), (2, "you idiot, you utter moron", "c"), (2, "fine day", "c"), (3, "x" * 300_000, "d")], "doc_id long, text string, score string")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == 5 and all(0 <= r.score <= 1 for r in got)
    assert max(got, key=lambda r: r.score).doc_id == 2
    assert toxicity.toxicity(docs.limit(0), none).count() == 0
    few = spark.createDataFrame([(2, 1, 1), (3, None, None), (None, 1, 1), (1, 0, 0)], "doc_id long, quality int, toxic int")
    assert toxicity.toxicity(docs, few).count() == 5


def test_features_don_t_depend_on_length():
    at = toxicity.FEATURES.index("capitals")
    for unit in ("ΑΒΓ abc ", "ÀÉ xyz ", "plain words "):
        for n in (1_990, 2_010, 40_000):
            text = (unit * (n // len(unit) + 1))[:n]
            assert toxicity.Tokens({}).features(text)[at] == sum(map(str.isupper, text)) / n
    texts = ["you IDIOT!! st*pid, a.b.c soooo bad", "", "fine", "ich du you idiot idiot"]
    small, fresh = toxicity.Tokens({"idiot": 3.0}, most=2), [toxicity.Tokens({"idiot": 3.0}).features(t) for t in texts]
    assert [small.features(t) for t in texts] == fresh  # what is kept doesn't matter


def test_an_id_with_many_rows_is_fitted_once(spark):
    rows = [(i, f"w{i} fine words here", i % 2) for i in range(50)] + [(7, f"copy {k}", 1) for k in range(500)]
    model = toxicity.fit(spark.createDataFrame(rows, "id long, text string, toxic int"), max_rows=40)
    assert 0 <= model.score(np.array([toxicity.Tokens(model.lexicon).features("w1")]))[0] <= 1


def test_isotonic():
    x, p = toxicity.isotonic(np.array([1.0, 2, 3, 4, 4]), np.array([0.0, 1, 0, 1, 1]))
    assert np.interp([1, 2, 3, 4], x, p).tolist() == [0, 0.5, 0.5, 1]


ARTICLE = " ".join(f"Paragraph {i} has a good many words in it, as articles do, and goes on for a while so that it counts." for i in range(12))
AS_HTML = "".join(f"<p>{x}.</p>" for x in ARTICLE[:-1].split(". "))


@pytest.mark.parametrize("wrapper", ["layout has-sidebar", "with-sidebar", "no-banner", "nav-open", "hasSidebar", "content-with-ads", "page is-commentable", "search-results-off"])
@pytest.mark.parametrize("inner", ["<article>%s</article>", "%s", "<div><div>%s</div></div>", "<main>%s</main>"])
def test_wrappers_whose_names_sound_like_noise_keep_the_article(wrapper, inner):
    page = f"<body><nav><a href=1>Home</a></nav><div class='{wrapper}'>{inner % AS_HTML}</div><div class='bottom'>Fine print one.</div></body>"
    assert ARTICLE in html_text.extract(page)


NOISE_NAMES = ["post-comments", "comments-section", "cookie-banner", "ad-container", "sponsored-content", "newsletter-signup", "related-posts", "sidebar", "social-share", "commentList", "site-footer", "popup-box"]


@pytest.mark.parametrize("name", NOISE_NAMES)
@pytest.mark.parametrize("place", ["<body><article><h1>Title here</h1>%(a)s%(n)s</article></body>", "<body><div>%(a)s</div>%(n)s</body>", "<body>%(n)s<main><h1>Title here</h1>%(a)s</main></body>", "<body><div class='layout has-sidebar'><h1>Title here</h1>%(a)s%(n)s</div></body>"])
def test_parts_named_as_noise_go_wherever_they_stand(name, place):
    noise = f"<div class='x1 {name}'><p>Noise words stand here and say things at some length, as they do.</p><p>And once more, with words.</p></div>"
    title = "Title here " if "Title" in place else ""
    assert html_text.extract(place % {"a": AS_HTML, "n": noise}) == title + ARTICLE


@pytest.mark.parametrize("page,want", [
    ("<p>a</p><!--><p>b</p><!---><p>c</p><!-- x --!><p>d</p><!-- y --><p>e</p>", "a b c d e"),
    ("<p title=\"a<b>c\">x</p><p data-x='1 < 2 > 0'>y</p>", "x y"),
    ("<p>a</p><template>1<template>2</template>3</template><p>b</p><svg><svg/>1<svg>2</svg>3</svg><p>c</p>", "a b c"),
    ("<article><p><a href=1>All of this article</a> <a href=2>is links</a></p></article>", "All of this article is links"),
    (f"<body><div class='legal'>{'Plain words of law. ' * 75}</div></body>", ("Plain words of law. " * 75).strip()),
    ("<body><div class='comments'>Only comments here.</div></body>", "Only comments here."),
])
def test_markup_and_pages_of_noise_alone(page, want):
    assert html_text.extract(page) == want


@pytest.mark.parametrize("item,text,found", [
    ("what is it, then?", "so what is ot, then? yes", 1), ("a twenty letter item", "here a twenty leter item is", 1), ("日本の首都は", "問題日本の首都はどこ", 0), ("ab cd", "xab cd", None), ("ab cd", "ab cd.", 0), ("yes", "yesterday", None), ("yes", "oh yes!", 0),
    ("a twenty letter item", "here a twenty leter items", None), ("ไทย", "ภาษาไทยคือ", 0), ("short one x", "Short  ONE y", 1),
])
def test_short_items_have_their_share_of_edits(item, text, found):
    got = decontaminate.Matcher([(1, item)], 0.1, 25).find(text)
    assert [d for _, d, _, _ in got] == ([] if found is None else [found])
