"""Names that say little about what is inside, and readers' comments under other names."""

import itertools
import math
import random

import pytest
from llm_helpers import WORDS

from logweave.llm import html_text

STORY = ["The river rose by two metres in a single night and took the old bridge with it.", "Workers had warned of loose stones for years, but no money was found for repairs.", "A ferry now crosses twice an hour; the school has moved its classes to the far bank.", "The council meets again on Monday to hear what a new bridge would cost the town."]
REMARK = "I was there and the water was much higher than they say, believe me."
TEXT = "\n\n".join(STORY)
STORY_HTML = "".join(f"<p>{x}</p>" for x in STORY)


@pytest.mark.parametrize("name", ["has-sidebar", "with-sidebar", "content-sidebar", "menu-open", "modal-open", "cookies-recipe", "site has-sidebar", "sidebar-right layout"])
def test_names_of_the_page(name):
    assert html_text.main_text(f"<body><div class='{name}'>{STORY_HTML}</div></body>") == TEXT
    assert html_text.main_text(f"<body><nav><a href='/'>Home</a></nav><div id='{name}'><div>{STORY_HTML}</div></div><footer>Contact us</footer></body>") == TEXT


@pytest.mark.parametrize("page", [
    f"<article>{STORY_HTML}<div class='article-comments'><p>{REMARK}</p></div></article>",
    f"<main>{STORY_HTML}<article class='comment-body'><p>{REMARK}</p></article></main>",
    f"<main>{STORY_HTML}<section id='comments-section'><h2>What readers say</h2><p>{REMARK * 20}</p></section></main>",
    f"<main><div class='main-menu'><p>{REMARK}</p></div>{STORY_HTML}<div class='main-footer'><p>{REMARK}</p></div></main>",
    f"<article>{STORY_HTML}<div class='article-sidebar'><p>{REMARK}</p></div></article>",
    f"<div class='page'><div class='sidebar'><p>{REMARK}</p></div><div>{STORY_HTML}</div></div>",
])
def test_what_is_named_goes(page):
    assert html_text.main_text(f"<body>{page}</body>") == TEXT


def test_references_are_of_one_text_node():
    assert html_text.main_text("<p>x&<b>amp;</b> y&amp;z &lt;p&gt; &eacute;</p>") == "x&amp; y&z <p> é"


def brute_sums(node):
    """Density sums of all nodes, by the formula, from the leaves up: (sum, node) of the largest, and whether links are inside."""
    sums = {}

    def walk(n):
        own = 0
        for k in n.kids:
            if isinstance(k, str):
                if not linked(n):
                    own += sum(len(w) for w in [k.strip().replace(" ", "")])
            elif not k.off:
                walk(k)
        sums[id(n)] = (own + sum(k.density for k in n.kids if not isinstance(k, str) and not k.off), n)

    def linked(n):
        while n is not None:
            if n.name == "a":
                return True
            n = n.up
        return False

    walk(node)
    return sums


def test_choice_of_the_subtree_by_brute_force():
    rng = random.Random(5)

    def part(depth):
        if depth == 0 or rng.random() < 0.2:
            words = " ".join(rng.choice(WORDS) for _ in range(rng.randrange(30)))
            return f"<a href='x'>{words}</a>" if rng.random() < 0.3 else words
        tag = rng.choice(["div", "p", "section", "span", "ul"])
        return f"<{tag}>{''.join(part(depth - 1) for _ in range(rng.randrange(1, 5)))}</{tag}>"

    for _ in range(60):
        root = html_text.parse(f"<body>{part(5)}{part(4)}</body>")
        body = next(k for k in root.kids if not isinstance(k, str) and k.name == "body")
        html_text.cut_named(body)
        html_text.measure(body)
        sums = brute_sums(body)
        top = max(s for s, _ in sums.values())
        assert math.isclose(body.best.total, top, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(sums[id(body.best)][0], top, rel_tol=1e-9, abs_tol=1e-9)
        assert all(math.isclose(sums[id(n)][0], n.total, rel_tol=1e-9, abs_tol=1e-9) for _, n in itertools.islice(sums.values(), 50))
