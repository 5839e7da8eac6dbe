"""Labelled pages from which the content model is trained.

Each page is put together from parts: site furniture and articles in the shapes that
occur on the web. Blocks of main text carry the attribute ``data-main``; the model reads
it for training only. The texts are filler, so the model learns from structure, names,
lengths and links, not from words or a language.
"""

from __future__ import annotations

import random

_SYLLABLES = "ba ko ri sen tal mi ur ve do lan es qui por ta nim el sa gro fen ul".split()

# Site furniture; $w is a few words, $s a sentence, $l a link list, $p a paragraph of text.
FURNITURE = {
    "top": [
        "<header><a href='/'>$w</a><nav>$l</nav></header>",
        "<nav><ul>$l</ul></nav>",
        "<div id='header'><h1>$w</h1><div class='menu'>$l</div></div>",
        "<div class='navbar'><ul class='nav'>$l</ul></div>",
        "<div class='masthead'><p>$w</p></div><ul id='main-menu'>$l</ul>",
        "<div role='navigation'>$l</div>",
        "<header><p>$s</p></header>",
        "<header class='site-header'><h1>$w</h1><p>$s</p></header>",
    ],
    "notice": [
        "<div class='cookie-notice'>$s <button>$w</button></div>",
        "<div id='consent'><p>$p</p><a href='#'>$w</a></div>",
        "<div class='alert'>$s</div>",
        "<div class='notice'><p>$s</p></div>",
        "<div class='popup'><form><p>$s</p><input name='e'><button>$w</button></form></div>",
        "<div class='banner'>$s</div>",
    ],
    "advert": [
        "<div class='ad'>$s</div>",
        "<div class='advert'><a href='/x'>$w</a> $s</div>",
        "<div class='sponsored'><p>$p</p></div>",
        "<aside class='promo'>$s</aside>",
        "<div id='ads-top'><p>$s</p></div>",
        "<ins class='adsbygoogle'>$w</ins>",
    ],
    "side": [
        "<aside><h3>$w</h3><ul>$l</ul></aside>",
        "<div class='sidebar'><h2>$w</h2><p>$s</p>$l</div>",
        "<div id='related'><h3>$w</h3><ul>$l</ul></div>",
        "<aside class='widget'><p>$p</p></aside>",
        "<div class='share social'><a href='/f'>$w</a> <a href='/t'>$w</a></div>",
        "<div class='breadcrumb'><a href='/'>$w</a> &gt; <a href='/a'>$w</a></div>",
        "<div class='tags'>$l</div>",
        "<aside><p>$p</p><p>$s</p></aside>",
    ],
    "form": [
        "<form action='/s'><label>$w</label><input name='q'><button>$w</button></form>",
        "<form><p>$s</p><textarea></textarea><select><option>$w</option><option>$w</option></select></form>",
        "<div class='newsletter'><h4>$w</h4><p>$s</p><form><input><button>$w</button></form></div>",
        "<div class='search'><form><label>$w</label><input></form></div>",
    ],
    "comments": [
        "<section class='comments'><h2>$w</h2><div class='comment'><p>$p</p></div><div class='comment'><p>$s</p></div></section>",
        "<div id='comments'><ol><li class='comment'><b>$w</b><p>$p</p></li><li class='comment'><p>$p</p></li></ol></div>",
        "<div class='replies'><h3>$w</h3><p class='reply'>$p</p><p class='reply'>$s</p></div>",
        "<section id='discussion'><article class='comment'><header>$w</header><p>$p</p></article></section>",
        "<ul class='comment-list'><li><p>$p</p><p>$s</p></li><li>$s</li></ul>",
        "<div class='user-comments'><div>$p</div><div>$s</div></div>",
    ],
    "bottom": [
        "<footer>&copy; $w. $s</footer>",
        "<footer><nav>$l</nav><p>$s</p></footer>",
        "<div id='footer'><p>$s</p>$l</div>",
        "<div class='copyright'>$s</div>",
        "<footer class='site-footer'><ul>$l</ul><p>$p</p></footer>",
    ],
}

# Articles; $B is their body, a run of main blocks, with furniture in between now and then.
ARTICLES = [
    "<article data-main=1><h1 data-main=1>$w</h1>$B</article>",
    "<article data-main=1><header data-main=1><h1 data-main=1>$w</h1></header>$B</article>",
    "<main data-main=1><h1 data-main=1>$w</h1>$B</main>",
    "<main data-main=1><article data-main=1><h2 data-main=1>$w</h2><section data-main=1>$B</section></article></main>",
    "<div id='content' data-main=1><h1 data-main=1>$w</h1>$B</div>",
    "<div class='post-body entry' data-main=1>$B</div>",
    "<div class='container' data-main=1><div class='article-text' data-main=1><h1 data-main=1>$w</h1>$B</div></div>",
    "<section class='story' data-main=1><h2 data-main=1>$w</h2>$B</section>",
    "<div data-main=1><h1 data-main=1>$w</h1>$B</div>",
    "<table><tr><td data-main=1><h1 data-main=1>$w</h1>$B</td></tr></table>",
    "<div data-main=1>$B</div>",
]
BLOCKS = [
    "<p data-main=1>$p</p>",
    "<p data-main=1>$p</p>",
    "<p data-main=1>$s</p>",
    "<p data-main=1>$s</p>",
    "<p data-main=1>$w</p>",
    "<p data-main=1>$p <a href='/r'>$w</a> $s</p>",
    "<p data-main=1><b>$w</b> $p<br>$s",
    "<h2 data-main=1>$w</h2>",
    "<h3 data-main=1>$w</h3>",
    "<ul data-main=1><li data-main=1>$s</li><li data-main=1>$w</li></ul>",
    "<ol data-main=1><li data-main=1>$p</li><li data-main=1>$s</li></ol>",
    "<blockquote data-main=1><p data-main=1>$p</p></blockquote>",
    "<blockquote data-main=1>$s</blockquote>",
    "<pre data-main=1>$s</pre>",
    "<figure data-main=1><img src='i'><figcaption data-main=1>$s</figcaption></figure>",
    "<table data-main=1><tr data-main=1><td data-main=1>$w</td><td data-main=1>$w</td></tr></table>",
    "<div data-main=1>$p</div>",
    "<section data-main=1><h2 data-main=1>$w</h2><p data-main=1>$p</p><p data-main=1>$s</p></section>",
]


class _Filler:
    def __init__(self, draw: random.Random):
        self.draw = draw

    def words(self, low: int, high: int) -> str:
        d = self.draw
        return " ".join("".join(d.choices(_SYLLABLES, k=d.randint(1, 3))) for _ in range(d.randint(low, high)))

    def sentence(self) -> str:
        return self.words(2, 18).capitalize() + self.draw.choice("...?!")

    def fill(self, shape: str) -> str:
        makers = {
            "$w": lambda: self.words(1, 5),
            "$s": self.sentence,
            "$p": lambda: " ".join(self.sentence() for _ in range(self.draw.randint(2, 9))),
            "$l": lambda: "".join(f"<li><a href='/{i}'>{self.words(1, 3)}</a></li>" for i in range(self.draw.randint(2, 7))),
        }
        for key, make in makers.items():
            while key in shape:
                shape = shape.replace(key, make(), 1)
        return shape


def labelled_pages(n: int = 400, seed: int = 5) -> list[str]:
    """``n`` labelled pages, the same for the same seed."""
    draw = random.Random(seed)
    filler = _Filler(draw)
    pages = []
    for _ in range(n):
        part = lambda kind, chance: draw.choice(FURNITURE[kind]) if draw.random() < chance else ""
        body = []
        for _ in range(draw.randint(1, 14)):
            body.append(draw.choice(BLOCKS))
            body.append(part(draw.choice(["advert", "side", "form", "notice"]), 0.08))
        article = draw.choice(ARTICLES).replace("$B", "".join(body) + part("comments", 0.1))
        shape = (
            "<html><head><title>$w</title></head><body>"
            + part("notice", 0.3)
            + part("top", 0.9)
            + part("advert", 0.5)
            + part("side", 0.3)
            + article
            + part("advert", 0.2)
            + part("comments", 0.35)
            + part("side", 0.35)
            + part("form", 0.3)
            + part("bottom", 0.9)
            + part("notice", 0.1)
            + "</body></html>"
        )
        pages.append(filler.fill(shape))
    return pages
