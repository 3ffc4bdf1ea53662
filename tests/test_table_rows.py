"""Hand-checked results for one page of the test table (page 2 of the smallest set)."""

import pytest

import __spark_entry__ as entry_point

FOLDER = "/root/testdata/sf0.001"

EXPECTED = {
    "page_fields": [(2, "Reorea. Nd.", "Reorea. Nd.", "en", "blog.therst.example.net")],
    "url_canonical": [
        (
            2,
            "https://blog.therst.example.net/en/53?utm_source=feed",
            "blog.therst.example.net/en/53",
        )
    ],
    "page_links": [
        (2, 0, "/En"),
        (2, 1, "/laleenéelle"),
        (2, 2, "/la"),
        (2, 3, "/des"),
        (2, 4, "/et."),
        (2, 5, "/Enmentai."),
    ],
    "page_text": [
        (
            2,
            "Reorea. Nd. En laleenéelle la des et. Enmentai. "
            "Ascirr para osóciónta cióngañ no. Reorea. Nd. Reorea. Nd. "
            "&copy; blog.therst.example.net &middot; And therhean is the is esndha reedes ha.",
        )
    ],
}


@pytest.mark.parametrize("name", sorted(EXPECTED))
def test_page(spark, name):
    rows = entry_point.queries()[name](spark, FOLDER).filter("page_id = 2").collect()
    assert sorted(tuple(row) for row in rows) == EXPECTED[name]
