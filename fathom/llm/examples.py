"""Labelled pages from which the tree of ``pages`` is grown: one layout for each kind of page, filled with invented words.

In a layout, [m] is main text of any length, [l] a long and [s] a short piece of it, [o] other prose of any length, [k] a
link, [t] a main text link. Main text carries ``MARK``, which is how a block is known to be labelled.
"""

from __future__ import annotations

import random
import re

MARK = "§"
DRAWS = 10  # pages of each layout
SIZES = {"m": (1, 300), "l": (20, 300), "s": (1, 8), "o": (1, 60), "k": (1, 5), "t": (1, 5)}  # words

LAYOUTS = (
    # an article between plain elements, with an advert of prose before it
    "<nav><ul><li>[k]</li><li>[k]</li><li>[k]</li></ul></nav><article><h1>[s]</h1><p>[m]</p><p>[m]</p><p>[m]</p></article><footer>[o] [k]</footer>",
    "<nav><ul><li>[k]</li><li>[k]</li></ul></nav><div class='ad'>[o]</div><article><h1>[s]</h1><p>[m]</p><p>[m]</p><p>[s]</p></article><footer>[o]</footer>",
    "<nav>[k] [k]</nav><div class='ad'>[o]</div><article><h1>[m]</h1></article><footer>[o]</footer>",
    # an advert, a share bar and related texts inside the article; a header with the title and a line on the author
    "<header><h1>[o]</h1><p>[o]</p></header><article><header><h1>[s]</h1><p class='byline'>[o]</p></header><p>[m]</p><div class='advertisement'><p>[o]</p></div><p>[m]</p>"
    "<ul><li>[m]</li><li>[s]</li></ul><div class='share'>[k]</div><section class='related'><h3>[o]</h3>[k] [k]</section></article><footer><p>[o]</p></footer>",
    # reader comments after the text, in articles of their own, and inside it
    "<main><h1>[s]</h1><p>[m]</p><h2>[s]</h2><p>[m]</p></main><section id='comments'><h2>[o]</h2><article class='comment'><p>[o]</p></article><article class='comment'><p>[o]</p></article></section>",
    "<article class='post'><h2>[s]</h2><p>[m]</p><p>[m]</p><div class='comments'><h3>[o]</h3><p>[o]</p><p>[o]</p></div></article>",
    # a notice, a form, sidebars of prose and teasers
    "<div class='cookie-notice'><p>[o]</p><button>[o]</button></div><div class='content'><h1>[s]</h1><p>[m]</p><blockquote>[m]</blockquote><table><tr><td>[s]</td><td>[m]</td></tr></table></div>"
    "<aside><h3>[o]</h3><p>[o]</p></aside><form><p>[o]</p><label>[o]</label></form><footer>[o]</footer>",
    "<div id='page'><div class='sidebar'><p>[o]</p><article class='teaser'><p>[o]</p></article></div><div id='main-content'><p>[m]</p><p>[s]</p><p>[m] [t] [m]</p></div></div>",
    # paragraphs left open, lists of links inside the article
    "<article><h1>[s]</h1><p><b>[m].<br><p>[m]<p>[m] [t]<ul><li>[t]</li><li>[t]</li></ul><p>[s]</article><footer>[o] [k]</footer>",
    # elements by role; text of the page outside its main part
    "<body class='single-post'><div role='banner'>[o]</div><div role='navigation'>[k] [k]</div><div role='main'><h1>[s]</h1><p>[m]</p><div class='newsletter-signup'><p>[o]</p></div><p>[m]</p><p>[s]</p></div><div role='contentinfo'>[o]</div></body>",
    "<div>[k] [k]</div><p>[o]</p><main><p>[m]</p><p>[m]</p></main><div>[o]</div><p>[o] [k]</p>",
    # no names at all: words and links alone
    "<div><ul><li>[k]</li><li>[k]</li><li>[k]</li></ul></div><div><p>[l]</p><p>[l]</p><p>[l] [t]</p></div><div>[k] [k]</div>",
    "<table><tr><td>[k]</td><td>[k]</td></tr><tr><td>[l]<br>[l]</td></tr><tr><td>[l] [t] [l]</td></tr></table><p>[k] [k] [k]</p>",
    "<div>[k] | [k]</div><div>[l]</div><div>[s]</div><div>[l]</div><div>[k] [k]</div><div>[k]</div>",
    "<p>[k]</p><h1>[s]</h1><p>[l]</p><p>[s]</p><p>[l]</p><p>[k]</p>",
    "<p>[l]</p>",
    # nothing but boilerplate
    "<nav><ul><li>[k]</li><li>[k]</li></ul></nav><div class='menu'><p>[o]</p></div><form><p>[o]</p></form><footer>[o]</footer>",
    "<div><ul><li>[k]</li><li>[k]</li></ul></div><div>[k] [k] [k]</div><div>[k]</div>",
)


def filled(layout: str, rng: random.Random) -> str:
    def piece(found: re.Match) -> str:
        low, high = SIZES[found[1]]
        text = " ".join(["word"] * round(low * (high / low) ** rng.random()))
        text = MARK + text if found[1] in "mlst" else text
        return f"<a href='/'>{text}</a>" if found[1] in "kt" else text

    return re.sub(r"\[([mlsokt])\]", piece, layout)


def pages(draws: int = DRAWS) -> list[str]:
    """The labelled pages, the same in every run."""
    rng = random.Random(13)
    return [filled(layout, rng) for layout in LAYOUTS for _ in range(draws)]
