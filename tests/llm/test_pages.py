"""Pages whose wrappers have any class names, and elements that are not closed."""

import random

import pytest

from tidemark.llm import extract

#: Wrapper names of real themes, the first eleven of which were seen to empty a page.
WRAPPERS = (
    "sidebar-right nav-open header-fixed ad-free share-enabled layout-sidebar search-enabled footer-sticky cookie-ok comment-open login-required "
    "menu-collapsed page-nav-left two-col-sidebar ads-blocked newsletter-ready modal-closed widget-area-none theme-header-dark social-on pagination-off breadcrumb-top form-page "
    "banner-slim notice-seen consent-given promo-2024 alert-free toolbar-hidden masthead-small rail-left popup-shown"
).split()
PLACES = ["wrapper {}", "{} site", "page-shell {} v2", "app {}", "container-fluid {}"]


def body(r, n):
    return [" ".join(r.choice("alpha beta gamma delta epsilon zeta eta theta".split()) for _ in range(r.randint(8, 30))) + "." for _ in range(n)]


@pytest.mark.parametrize("wrapper", WRAPPERS)
@pytest.mark.parametrize("inner", ["<article>{}</article>", "<div class='content'>{}</div>", "{}"])
def test_no_wrapper_empties_a_page(wrapper, inner):
    r = random.Random(wrapper + inner)
    for place in PLACES:
        paragraphs = body(r, r.randint(2, 5))
        tag = r.choice(["div", "section", "app-root", "span"])
        kind = r.choice(["class", "id"])
        page = f"<body><nav><a href=/>Home</a></nav><{tag} {kind}='{place.format(wrapper)}'>" + inner.format("".join(f"<p>{p}</p>" for p in paragraphs)) + f"<div class='sidebar'><p>Short note.</p></div></{tag}><div class='comments'><div class='comment'><p>Nice one.</p></div></div><footer>Bye</footer></body>"
        assert extract.Page(page).main_text([]) == " ".join(paragraphs)


def test_long_comments_and_notices_stay_away():
    r = random.Random(1)
    text, long = "".join(f"<p>{p}</p>" for p in body(r, 2)), "".join(f"<p>{p}</p>" for p in body(r, 40))
    want = text.replace("</p><p>", " ").removeprefix("<p>").removesuffix("</p>")
    for away in ("<div class='comments'>{}</div>", "<section id='comments' class='comments-area'>{}</section>", "<div class='cookie-banner'>{}</div>", "<ol class='commentlist'><li>{}</li></ol>", "<aside>{}</aside>"):
        assert extract.Page(f"<div class='post'>{text}</div>{away.format(long)}").main_text([]) == want
    assert extract.Page(f"<article>{text}</article><div class='sidebar'>{long}</div>").main_text([]) == want


@pytest.mark.parametrize("odd", ["<svg class='i'/>", "<svg viewBox='0 0 1 1' />", "<p>{}<button>Buy", "<div>{}<select><option>1", "<div>{}<noscript>none", "<div>{}<iframe src=x>", "<div>{}<svg><svg><path/></svg>", "<div>{}<button>A<button>B</button>", "<div>{}<title>x"])
def test_raw_elements_that_are_not_closed(odd):
    inside = odd.format("") + ("</p>" if odd.startswith("<p>") else "</div>" if odd.startswith("<div>") else "")
    page = f"<article><p>One.</p>{inside}<p>Two.</p></article>"
    assert extract.Page(page).main_text([]) == "One. Two."


def test_closed_raw_elements_and_forms():
    page = "<article><p>One.</p><svg><title>t</title><text>no</text></svg><button class=x>Buy</button><script>if (a<b) '</div>'</script><style>p{}</style><p>Two.</p></article>"
    assert extract.Page(page).main_text([]) == "One. Two."
    assert extract.Page("<form id='aspnetForm'><div><p>The whole page is a form.</p></div></form>").main_text([]) == "The whole page is a form."
    assert extract.Page("<div><p>A text that is there to be read.</p><form><label>Name</label> <input></form></div>").main_text([]) == "A text that is there to be read."


@pytest.mark.parametrize("piece", ["<button>", "<svg>", "<select><option>", "<div class='nav x'>", "<span class='ad y'>", "<title>"])
def test_many_unclosed_elements_take_linear_time(piece):
    import time

    def took(n):
        began = time.process_time()
        extract.Page(piece * n).main_text([])
        return time.process_time() - began

    took(200)
    assert took(20_000) < 40 * max(took(1000), 0.01)
