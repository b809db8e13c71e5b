"""Products in the attributes of a page."""

from __future__ import annotations

import pytest

from basketry.sources import pages

CASES = {
    '<div itemscope><h1 class="x" itemprop="name"> Сыр\n 200 г </h1><meta itemprop="price" content="129,90"><link itemprop="availability" href="https://schema.org/InStock"></div>': ("Сыр 200 г", 129.9, True),
    "<META PROPERTY='og:title' CONTENT='Чай \"A\"'><meta property='product:price:amount' content='1 299.00'/><meta property='og:availability' content='OutOfStock'>": ('Чай "A"', 1299.0, False),
    '<span itemprop="price">55</span><meta property="og:price:amount" content="49.5">': (None, 49.5, True),
    '<input itemprop=price value=10><b itemprop="name" content=""></b>': (None, 10.0, True),
    '<i itemprop="price" content="0"></i><i itemprop="price" content="5"></i>': (None, None, None),
    '<!-- <i itemprop="price" content="5"> -->': (None, None, None),
    '<i itemprop="priceCurrency" content="5"><i data-itemprop="price" content="6">': (None, None, None),
    '<i itemprop="price" data-content="6" content="7">': (None, 7.0, True),
    "": (None, None, None),
}


@pytest.mark.parametrize("extra", [None, "<meta itemprop='name' content='no price'>"])
def test_microdata(spark, extra):
    rows = [(i, h) for i, h in enumerate([*CASES, extra])]
    got = {r.id: (r.name, r.price, r.in_stock) for r in pages.product_in_microdata(spark.createDataFrame(rows, "id int, html string")).collect()}
    assert [got[i] for i in range(len(CASES))] == list(CASES.values())
    assert got[len(CASES)] == (None, None, None)
