import html
import re

from tidewright.llm.html_text import blocks_of, classify, extract, main_text

RUN = "It was the best of times, it was the worst of times, and it was the age of wisdom for all of us."


def test_article_of_every_page_is_whole(spark, small):
    pages = spark.read.parquet(f"{small}/pages.parquet")
    got = {r["page_id"]: r for r in extract(pages, ["page_id", "url"]).collect()}
    assert len(got) == pages.count()
    for r in pages.collect():
        article = r["html"].split("<article>")[1].split("</article>")[0]
        blocks = (" ".join(html.unescape(re.sub("<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1|br)>", article))
        assert got[r["page_id"]]["text"] == "\n".join(b for b in blocks if b)
        assert got[r["page_id"]]["n_chars"] == len(got[r["page_id"]]["text"])


def test_boilerplate_goes_and_short_blocks_follow_their_neighbours():
    page = (f'<head><title>t</title></head><body><div id="cookie-banner"><p>{RUN}</p></div><div class="site-header"><a href=/>Home</a></div><ul class=menu><li>{RUN}</ul>'
            f'<div class="content has-sidebar"><h2>A title</h2><p>{RUN}</p><p>Short.</p><p class=ad>{RUN}</p><p>{RUN} <a href="x">link</a></p></div><aside>{RUN}</aside>'
            f'<form>{RUN}<input></form><script>if (a < b) "<p>{RUN}</p>"</script><section id="comments"><article class="comment">{RUN}</article></section><footer>&copy; x</footer>')
    assert main_text(page)[0].split("\n") == ["A title", RUN, "Short.", RUN + " link"]


def test_passes_by_density_without_any_article_element():
    links = " ".join('<a href="x">some link</a>' for _ in range(9))
    blocks = blocks_of(f"<div>{links}</div><p>{RUN}</p><p>Hm.</p><p>{RUN}</p><p>{'zzz ' * 40}</p>")
    classify(blocks)
    assert [b.label for b in blocks] == ["bad", "good", "good", "good", "bad"]


def test_space_references_and_broken_markup():
    assert main_text(f"<article><p> a&nbsp;&amp;lt;  b\n c<br>d &#x41;&eacute; </p><p>{RUN}</article>")[0] == f"a &lt; b c d Aé\n{RUN}"
    for page in ("", "<", "<p", "a<b", "<!-- x", "<script>", '<p title="', "<a " * 2000, "</div></p>", "<table><tr><td>"):
        assert isinstance(main_text(page)[0], str)


def test_odd_rows(spark, odd, nothing):
    out = extract(odd, ["doc_id", "n", "size"], "text")
    assert out.count() == odd.count()
    assert {r["text"] for r in out.where("doc_id in (2, 3, 4)").collect()} == {""}
    assert extract(nothing, ["doc_id"], "text").count() == 0


def test_only_hidden_elements_are_hidden():
    for shown in ('style="overflow:hidden"', 'class="overflow-hidden"', 'class="md:hidden"', 'title="The hidden city"', "style='backface-visibility:hidden'", "data-hidden=x",
                  'aria-hidden=false', 'alt="display:none"', 'hidden=false', "title='a \"hidden\" door'"):
        for page in (f"<article {shown}><p>{RUN}</p></article>", f"<div {shown}><div><article><p>{RUN}</p></article></div></div>", f"<div {shown}><p>{RUN}</p></div>"):
            assert main_text(page)[0] == RUN, page
    for unseen in ("hidden", 'hidden=""', "class=x HIDDEN", 'aria-hidden="true"', 'style="color:red; display : none"', "style='visibility:hidden !important;'", "hidden/"):
        assert main_text(f"<article><p>{RUN}</p><div {unseen}>{RUN}</div></article>")[0] == RUN, unseen


def test_unclosed_and_self_closed_elements_take_nothing_else():
    for head in ("<head><title>t</title><meta charset=utf-8>", "<html><head><title>t</title><script>'<p>'</script><body>", "<head><style>p {}</style><link href=x></head>",
                 "<head><title>t</title></head><body>", "<HEAD lang=en><title>a <b> c</title>"):
        assert main_text(f"{head}<article><p>{RUN}</p></article>")[0] == RUN, head
        assert main_text(f"{head}<p>{RUN}</p>")[0] == RUN, head
    assert main_text(f"<head><title>t</title><meta charset=utf-8>{RUN}")[0] == RUN
    for empty in ('<svg class="x" />', "<svg/>", "<math/>", '<svg width=1 viewBox="0 0 1 1"/>', "<iframe src='x'/>", "<canvas />", "<object data='a/b'/>", "<svg-icon>", "<video-player>",
                  '<script src="x" /></script>', "<script src=/a/></script>"):
        got = main_text(f"<article><p>{RUN} {empty} {RUN}</p><p>{RUN}</p><svg><text>drawn</text></svg></article>")[0]
        assert got == f"{RUN} {RUN}\n{RUN}", empty
    for unclosed in ("<svg><path d=x>", "<video src=x>", "<select><option>a"):
        assert main_text(f"<article><p>{RUN}</p>{unclosed}<p>{RUN}</p></article>")[0] == f"{RUN}\n{RUN}", unclosed
    assert main_text(f"<article><p>{RUN}</p><script>if (a < b) x")[0] == RUN


def test_formulas_and_the_tail_behind_a_bare_angle_stay():
    formula = "<math><mi>x</mi> <mo>=</mo> <mn>2</mn></math>"
    assert main_text(f"<article><p>{RUN} {formula} {RUN}</p></article>")[0] == f"{RUN} x = 2 {RUN}"
    assert main_text(f"<article><p>{RUN} 1 < 2, {RUN}")[0] == f"{RUN} 1 < 2, {RUN}"
    assert main_text(f"<article><p>{RUN} 1 < 2 <a href='x")[0] == f"{RUN} 1 < 2"


def test_names_in_an_article_need_few_stop_words_or_many_links_as_well():
    for section, want in ((f'<section id="discussion"><h2>Discussion</h2><p>{RUN}</p></section>', ["Discussion", RUN]),
                          (f'<section id="social-impact"><h2>Impact</h2><p>{RUN}</p><p>1843.</p></section>', ["Impact", RUN, "1843."]),
                          (f'<h2 id="legal-status">Legal status</h2><p>{RUN}</p>', ["Legal status", RUN]), (f'<p id="search-results">{RUN}</p>', [RUN]),
                          (f'<h2 id="related-work" class="section-header">Related work</h2><p>{RUN}</p>', ["Related work", RUN]),
                          (f'<div class="entry-header"><h2>A title</h2></div><p>{RUN}</p>', ["A title", RUN]),
                          (f'<figure aria-label="Form of the shell"><figcaption>{RUN}</figcaption></figure>', [RUN]),
                          (f'<p>{RUN} See <span class="toc-target">this</span>.</p>', [f"{RUN} See this."])):
        assert main_text(f"<article><p>{RUN}</p>{section}<p>{RUN}</p></article>")[0].split("\n") == [RUN, *want, RUN], section
    for other in ('<div class="related-posts"><h3>Read on</h3><ul><li><a href=x>What the fox says</a></li></ul></div>', '<div class="share-bar">Facebook Pinterest</div>',
                  f'<p class="ad">{RUN}</p>', f'<div role="search">{RUN}</div>', '<section id="related"><a href=x>The best of times, the worst of times</a></section>'):
        assert main_text(f"<article><p>{RUN}</p>{other}<p>{RUN}</p></article>")[0] == f"{RUN}\n{RUN}", other
    assert main_text(f'<div><h2 id="legal-status">Legal status</h2><p>{RUN}</p></div>')[0] == f"Legal status\n{RUN}"


def test_languages_without_stop_words_tables_and_teasers_outside_articles():
    italian = "Questo libro racconta ogni anno vicende straordinarie: uomini, donne, bambini, tutti insieme dentro piccole citta lontane."
    russian = "Это было лучшее из всех времён, это было худшее из всех времён; это был век мудрости, это был век глупости."
    chinese = "那是最美好的时代,那是最糟糕的时代;那是智慧的年头,那是愚昧的年头。"
    links = "<div>" + " ".join('<a href="x">some link</a>' for _ in range(9)) + "</div>"
    for run in (italian, russian, chinese):
        assert main_text(f"{links}<div><h1>{run[:9]}</h1><p>{run}</p><p>{run}</p></div>{links}")[0].split("\n")[-2:] == [run, run], run
        assert main_text(f'<article><section id="social-impact"><p>{run}</p></section></article>')[0] == run
    code = "for (i = 0; i < 10; i++) { total += prices[i] * amounts[i]; printf(total); } " * 2
    table = "<table><tr><td>Width 1200 mm, height 700 mm, depth 450 mm, weight 31 kg, colours: black, white, silver</td></tr></table>"
    for block in (f"<pre>{html.escape(code)}</pre>", table):
        got = main_text(f"{links}<p>{RUN}</p>{block}<p>{RUN}</p>")[0].split("\n")
        assert got == [RUN, " ".join(html.unescape(re.sub("<[^>]*>", "", block)).split()), RUN], block
        assert main_text(f"{links}{block}{links}<p>{RUN}</p>")[0] == RUN
    teaser = "<article><h3>Teaser</h3><p>Apples, pears, plums, cherries, oranges, lemons, melons, berries, grapes, figs</p></article>"
    assert main_text(f"<div><p>{RUN}</p><p>{RUN}</p></div>{teaser}")[0].startswith(f"{RUN}\n{RUN}")
    assert main_text(f"<p>{RUN}</p><article><p>{RUN}</p><p>{RUN}</p></article>")[0] == f"{RUN}\n{RUN}"


def test_what_the_layout_names_goes_from_articles_too():
    heading = "<h3>Comments</h3>"
    for holder in ("article", "main"):
        for other in (f'<div id="comments"><p>{RUN}</p></div>', f'<div id="comments">{heading}<p>{RUN}</p></div>', f'<section id="comments">{heading}<p>{RUN}</p></section>',
                      f'<div class="user-comments"><p>{RUN}</p></div>', f'<div id="comments"><article><p>{RUN}</p></article><article><p>{RUN}</p></article></div>',
                      f'<ol class="comment-list"><li>{RUN}</li></ol>', f'<div id="respond"><p>{RUN}</p></div>', f'<div id="disqus_thread"><p>{RUN}</p></div>',
                      f'<article class="user-comment"><p>{RUN}</p></article>', f'<div class="notice"><p>{RUN}</p></div>', f'<div class="cookie-notice"><p>{RUN}</p></div>',
                      f'<div class="ad-box"><p>{RUN}</p></div>', f'<div id="sidebar"><p>{RUN}</p></div>', f'<div class="left-sidebar"><p>{RUN}</p></div>',
                      f'<div class="newsletter-signup"><p>{RUN}</p></div>', f'<div class="related"><p>{RUN}</p></div>', f'<div class="related-posts"><p>{RUN}</p></div>',
                      f'<div class="share-buttons"><p>{RUN}</p></div>', f'<div role="complementary"><p>{RUN}</p></div>'):
            assert main_text(f"<{holder}><p>{RUN}</p>{other}<p>{RUN}</p></{holder}>")[0] == f"{RUN}\n{RUN}", (holder, other)


def test_what_articles_say_stays():
    links = '<ul><li><a href="1">See one</a></li><li><a href="2">See two</a></li></ul>'
    for part, want in (("<p>" + RUN + " <label>word</label> more of it</p>", [RUN + " word more of it"]), (links, ["See one", "See two"]),
                       (f'<section id="comments-on-method"><h2>Comments on method</h2><p>{RUN}</p></section>', ["Comments on method", RUN]),
                       (f'<section id="ad-spending"><h2>Spending</h2><p>{RUN}</p></section>', ["Spending", RUN]),
                       (f'<section class="discussion"><h2>Discussion</h2><p>{RUN}</p></section>', ["Discussion", RUN]),
                       (f'<div class="comments-open"><p>{RUN}</p></div>', [RUN]), (f'<div id="share"><h2>Market share</h2><p>{RUN}</p></div>', ["Market share", RUN]),
                       (f'<p>{RUN} A <span class="sponsored-term">word</span> of it.</p>', [f"{RUN} A word of it."])):
        assert main_text(f"<article><p>{RUN}</p>{part}<p>{RUN}</p></article>")[0].split("\n") == [RUN, *want, RUN], part


def test_pages_of_short_blocks_only():
    assert main_text("<body><p>Hello world.</p></body>")[0] == "Hello world."
    assert main_text("<body><p>Привет, мир.</p><p>Как дела?</p></body>")[0] == "Привет, мир.\nКак дела?"
    assert main_text('<nav><a href=/>Home</a></nav><p>Hello world.</p><footer>&copy; x</footer>')[0] == "Hello world."


def test_deep_and_unbalanced_pages_take_linear_time():
    import time
    for make in (lambda n: "<div>" * n + "</p></section>" * n + "x", lambda n: "<article>" + '<div id="search-x">' * n + "x" + "</div>" * n,
                 lambda n: "<article>" + '<div id="search-x"><p>x</p>' * n):
        took = []
        for n in (4000, 16000):
            t = time.process_time()
            main_text(make(n))
            took.append(time.process_time() - t)
        assert took[1] < 10 * took[0] + 0.3
