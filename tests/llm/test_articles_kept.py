"""Whole articles stay, whatever is written round them, and boilerplate goes."""

import pytest

from talus.llm import decontam, html_text

TEXT = ["The river had risen over night, and nobody in the old market could say when the water would go back again to where it came from.",
        "When the morning came, they went along the green bank to look at the stones, which lay there as they had been left many years ago.",
        "Nothing of this was ever written down, as far as we know, and so the story is told here once more for those who have not heard it."]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
MENU = '<nav><ul><li><a href="/">Home</a></li><li><a href="/x">News</a></li></ul></nav>'
FOOT = "<footer>Copyright 2026 by nobody, all rights reserved.</footer>"

PAGES = {
    "head without end": f"<html><head><title>x</title><meta charset=utf-8>{MENU}<article>{BODY}</article>{FOOT}",
    "head without end, text at once": f"<head><title>x</title><article>{BODY}</article>{FOOT}",
    "has-sidebar": f'<body>{MENU}<div class="page has-sidebar"><article>{BODY}</article></div>{FOOT}',
    "menu-open": f'<body>{MENU}<div class="menu-open page"><article>{BODY}</article></div>{FOOT}',
    "article inside a sidebar's wrapper": f'<body>{MENU}<div class="sidebar"><main>{BODY}</main></div>{FOOT}',
    "form round an article": f"<body><form action=x>{MENU}<article>{BODY}</article>{FOOT}</form>",
    "form round a page": f"<body><form action=x>{MENU}<div>{BODY}</div>{FOOT}</form>",
    "social policy": f'<body>{MENU}<div class="social-policy-article">{BODY}</div>{FOOT}',
    "quote in an unquoted value": f"<body>{MENU}<article><p title=it's>{TEXT[0]}</p><p>{TEXT[1]}</p><p>{TEXT[2]}</p></article>{FOOT}",
    "filed under": f'<body>{MENU}<article class="post tag-newsletter category-comments">{BODY}</article>{FOOT}',
}


def kept(spark, pages):
    df = spark.createDataFrame([(k, "u", p) for k, p in enumerate(pages)], "page_id long, url string, html string")
    return [r.text for r in html_text.main_text(df).orderBy("page_id").collect()]


def test_articles_are_whole(spark):
    got = dict(zip(PAGES, kept(spark, PAGES.values()), strict=True))
    assert {n: t for n, t in got.items() if t != "\n\n".join(TEXT)} == {}


def test_a_quote_named_as_boilerplate_is_a_part_of_its_article(spark):
    page = f'<body>{MENU}<article><p>{TEXT[0]}</p><blockquote class="related-quote">{TEXT[1]}</blockquote><p>{TEXT[2]}</p></article>{FOOT}'
    assert kept(spark, [page]) == ["\n\n".join(TEXT)]


def test_boilerplate_goes_all_the_same(spark):
    around = [
        f'<div class="sidebar">{"<p>Sign up for our letter and get all the news of the week by mail.</p>" * 2}</div>', "<form><p>Your name and address, please, so that we can write to you.</p><input></form>",
        f'<section id="comments"><article class="comment-body" id="div-comment-2"><p>{TEXT[1]} I think so too!</p></article></section>', '<div class="cookie-notice">We use cookies on this page to make it better for you and all.</div>',
        '<div class="social-links"><a href=a>Follow us</a> <a href=b>Share it</a></div>', f'<aside><div class="content"><p>{TEXT[0]} Read on.</p></div></aside>',
    ]
    assert kept(spark, [f"<body>{MENU}<article>{BODY}</article>{a}{FOOT}" for a in around]) == ["\n\n".join(TEXT)] * len(around)


@pytest.mark.parametrize("page", ["<p a='>" * 20_000, "<p =" * 50_000, "<p a=\"b'c" * 30_000, "<div class=\"x" + " y" * 100_000 + "\">t", "<p " + "a='b' " * 50_000])
def test_odd_attributes_take_no_more_time(page):
    html_text.blocks(page)
