"""Block labels of pages that have an article."""

import random

import pytest

from methgrid.llm import html

PROSE = "the quick brown fox of the lazy dog jumped over it and ran to the river with all of its friends."
KEYWORDS = "camera lenses tripods bags filters flashes batteries chargers straps memory cards printers"


@pytest.mark.parametrize(
    ("page", "want"),
    [
        (f"<div><p>{PROSE}</p><p>{PROSE}</p></div><article><p>Teaser</p></article>", f"{PROSE}\n{PROSE}\nTeaser"),
        (f"<article><p>{PROSE}</p><ul><li><a>One more story</a></li><li>{KEYWORDS}</li><li>short</li><li><a>Another story</a></li></ul></article>", PROSE),
        (f"<article><p>{PROSE}</p><p>{KEYWORDS}</p><p>short</p></article><p>{KEYWORDS}</p>", f"{PROSE}\n{KEYWORDS}\nshort"),
    ],
)
def test_rules_decide_beside_and_inside_an_article(page, want):
    assert "\n".join(html.main_blocks(page)) == want


def slow_labels(found):
    """The two passes as the docstring has them, every neighbour looked for among all blocks."""
    first = []
    for text, tag, aside, article, linked in found:
        words = [w.strip(".,;:!?*#$%&'\"()") for w in text.lower().split()]
        dense = 10 * sum(w in html.STOP_WORDS for w in words) >= len(words) or len(words) > 40
        undecided = tag in html.HEADING or len(text) < html.LONG or (article and not dense)
        first.append(False if aside or 2 * linked > len(text) else None if undecided else dense)
    out = []
    for k, (_, tag, _, article, _) in enumerate(found):
        label = first[k]
        if label is None:
            near = [j for j in range(len(found)) if first[j] is not None and not found[j][2] and found[j][3] == article]
            if tag in html.HEADING:
                near = [j for j in near if j > k] or near
                near = sorted(near, key=lambda j: abs(j - k))
            else:
                near = sorted(near, key=lambda j: (abs(j - k), j))
            label = first[near[0]] if near else article
        out.append(label)
    return [b[0] for b, keep in zip(found, out) if keep]


def test_labels_against_brute_force():
    r = random.Random(2)
    parts = [f"<p>{PROSE}</p>", f"<p>{KEYWORDS}</p>", "<p>short</p>", "<h2>Title</h2>", f"<p><a href=x>{PROSE}</a></p>", f"<div class=ad><p>{PROSE}</p></div>", f"<nav><p>{PROSE}</p></nav>", "<p>the of and</p>"]
    decided_by_stop_words = 0
    for _ in range(400):
        body = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        page = f"<article>{body}</article>" + "".join(r.choice(parts) for _ in range(r.randint(0, 4))) if r.random() < 0.5 else body
        assert html.main_blocks(page) == slow_labels(html.blocks(page))
        decided_by_stop_words += KEYWORDS not in html.main_blocks(page) and KEYWORDS in page and "<article>" not in page
    assert decided_by_stop_words > 20


def test_long_pages_and_tails():
    page = f"<p>{PROSE}</p>" + "<p>short</p>" * 30_000 + f"<p>{KEYWORDS}</p>"
    assert len(html.main_blocks(page)) == 15_001
    assert html.main_blocks(f"<article><p>{PROSE}</p><3 the rest") == [PROSE, "<3 the rest"]
    assert html.main_blocks(f"<article><p>{PROSE}</p>end <div class='x") == [PROSE, "end"]
