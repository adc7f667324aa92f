import random

from boutline.llm.tagpath import extract, main_text

PAGES = [
    ("<html><head><title>T</title><style>p{}</style></head><body><nav><ul><li><a href='/x'>Menu</a></li></ul></nav><div class=\"ad\">Buy now!</div>"
     "<article><h1>Head &amp; line</h1><p><b>First.<br><p>Sec<i>ond</i>\n  text.</p></article><footer>&copy; me</footer></body></html>", "Head & line First. Second text."),
    (None, ""), ("", ""), ("<p> \n </p>", ""), ("just text &lt;b&gt;", "just text <b>"),
    ("<article><p>One.</p><aside>Related</aside><section class='comments'><p>Nice!</p></section><p>Two.</p><form>Name <input></form></article>", "One. Two."),
    ("<div class=ad>Unclosed advert<article><p>Body text, all of it.</p></article>", "Body text, all of it."),
    ("<main><div id='cookie-notice'>We use cookies</div><ul><li>a<li>b</ul><script>if(a<b){}</script><p>c<!-- no --></main>", "a b c"),
    ("<body><div class='side-nav'>x</div><div class='content'><p>A long paragraph, with commas, and full stops. It goes on.</p><p>Short.</p></div>"
     "<div class='page-footer'>Imprint</div></body>", "A long paragraph, with commas, and full stops. It goes on. Short."),
    ("<article><p style='display:none'>gone</p><p title='a>b'>kept</p><textarea>raw</textarea></article>", "kept"),
    ("<article><table><tr><td>1<td>2<tr><td>3</table><pre>x   y</pre></article><article class='comment'>spam</article>", "1 2 3 x y"),
    ("<article>a</span></div>b<p>c", "ab c"),
]


def test_worked_pages():
    for html, want in PAGES:
        assert main_text(html) == want, html


def test_extract_keeps_rows_and_clashing_columns(spark):
    rows = [(i, h, "t", 5) for i, (h, _) in enumerate(PAGES)] + [(0, PAGES[0][0], "t", 5), (None, "<p>" + "long text, " * 50_000, "t", 5)]
    pages = spark.createDataFrame(rows, "page_id long, html string, text string, n_chars int")
    got = extract(pages, "html", ["page_id"]).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_chars == len(r.text)
        assert r.page_id is None or r.text == PAGES[r.page_id][1]
    assert extract(pages.limit(0), "html", ["page_id"]).count() == 0


def test_short_article_beside_a_long_one_and_page_without_article():
    long = "A long sentence, with commas, that goes on. " * 20
    assert main_text(f"<article><p>{long}</p></article><article><p>Short one.</p></article>") == f"{long.strip()} Short one."
    assert main_text(f"<body><div><span>Top</span></div><div class='content'><div>{long}</div><div>Tail.</div></div></body>") == f"{long.strip()} Tail."


def test_class_of_an_article_does_not_drop_it():
    assert main_text('<article class="post-form"><p>Text, kept.</p></article>') == "Text, kept."
    assert main_text('<article class="comments"><p>Nice!</p></article><main><p>Text.</p></main>') == "Text."


def test_content_outside_of_a_main_element_and_short_containers_beside_it():
    long = "A long sentence, with commas, that goes on. " * 20
    page = f"<article class=a><p>{long}</p></article><article class=b><div>Short</div></article><section><div>menu</div></section>"
    assert main_text(f"<body>{page}</body>") == f"{long.strip()} Short"
    # a container without weight does not keep out what the ratios find elsewhere
    assert main_text(f"<body><div><article><b>x</b></article></div><div class=t><p>{long * 9}</p></div></body>") == (long * 9).strip()


def test_deep_nesting():
    n = 20_000
    assert main_text("<div>" * n + "x" + "</div>" * n) == "x"
    assert main_text("<div>" * n + "<p>x" + "</b>" * n) == "x"


def test_ratios_and_threshold_against_a_plain_version():
    rng = random.Random(4)
    marks = ".,;:!?"
    for _ in range(200):
        classes = [f"c{i}" for i in range(rng.randrange(2, 7))]
        blocks = []
        for _ in range(rng.randrange(1, 15)):
            words = ["".join(rng.choices("abc", k=rng.randrange(1, 6))) + (rng.choice(marks) if rng.random() < 0.3 else "") for _ in range(rng.choice([1, 2, 30]))]
            blocks.append((rng.choice(classes), rng.random() < 0.4, " ".join(words)))
        page = "".join(f"<section><{'main' if m else 'div'}><div class={c}>{t}</div></{'main' if m else 'div'}></section>" for c, m, t in blocks)
        order = list(dict.fromkeys((c, m) for c, m, _ in blocks))
        texts = [[t for c, m, t in blocks if (c, m) == key] for key in order]

        def smooth(v):
            padded = [v[0], *v, v[-1]]
            return [min(0.25 * padded[i] + 0.5 * padded[i + 1] + 0.25 * padded[i + 2], 16 * v[i]) for i in range(len(v))]

        length = smooth([sum(map(len, ts)) / len(ts) for ts in texts])
        punctuation = smooth([sum(t.count(x) for t in ts for x in marks) / len(ts) for ts in texts])
        weight = {k: (a * (b + 1)) ** 0.5 * (8 if k[1] else 1) for k, a, b in zip(order, length, punctuation)}
        least = 0.5 * (sum(w * w for w in weight.values()) / len(weight)) ** 0.5
        chosen = {k for k, w in weight.items() if w >= least}
        if any(m for _, m in chosen):
            assert main_text(page) == " ".join(t for c, m, t in blocks if (c, m) in chosen)
        elif len([1 for c, m, _ in blocks if (c, m) in chosen]) > 1:  # their container is the whole page
            assert main_text(page) == " ".join(t for c, m, t in blocks if (c, m) in chosen)
