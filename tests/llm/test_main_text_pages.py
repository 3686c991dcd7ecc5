"""op1 on pages whose body is a form, whose names look like furniture, and whose tags are nested deeply."""
import time

import pytest

from voxtable.llm.tag_ratio import main_text

TEXT = "Long sentence about something that matters. " * 8
P = f"<p>{TEXT}</p>"
CHROME = '<nav><a href="/">Home</a></nav><div class="side-bar"><p>Beside</p></div><div id="cookie-notice"><p>We use cookies</p></div><form class="search"><input><p>Find</p></form>'


@pytest.mark.parametrize("body", [f"<form action='x'>{P * 3}</form>", f"<form><div>{P * 2}</div><div>{P}</div></form>", f'<article class="post social-policy">{P * 3}</article>', f'<div class="content side-by-side">{P * 3}</div>',
                                  f'<div role="main" class="modal-page">{P * 3}</div>', f'<main id="login">{P * 3}</main>'])
def test_bodies(body):
    lines = main_text(f"<html><body>{CHROME}{body}<footer><p>Imprint</p></footer></body></html>").split("\n")
    assert lines == [TEXT.strip()] * 3


def test_headings_keep_their_names():
    got = main_text(f'<body>{CHROME}<article>{P}<h2 id="login">Login</h2>{P}<h2 id="related-work">Related work</h2>{P}</article></body>').split("\n")
    assert got == [TEXT.strip(), "Login", TEXT.strip(), "Related work", TEXT.strip()]


def test_a_small_form_is_apart():
    got = main_text(f'<body><article>{P * 3}<form><p>Leave your address</p></form></article><div class="related-posts">{P}</div><div class="social-links">{P}</div></body>')
    assert got.split("\n") == [TEXT.strip()] * 3


def test_deep_nesting_takes_time_in_proportion():
    def took(n):
        t = time.perf_counter()
        assert main_text("<div>x" * n).startswith("x")
        main_text("<div>" * n + "</b>" * n + "<i>" * n + "<p>x")
        return time.perf_counter() - t
    took(500)
    assert took(20_000) < 16 * max(took(5_000), .05)
