"""Which blocks of a page are its text: forms around the page, blocks beside the path, names beside other words."""

import pytest
from pyspark.sql import functions as F

from rodada.llm.html_text import main_text, page_texts

P = "Lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor incididunt ut labore et dolore magna aliqua. "
ONE, TWO, THREE = (P * k for k in (1, 2, 3))


@pytest.mark.parametrize(
    ("page", "blocks"),
    [
        (f"<body><form id='aspnetForm'><div><p>{THREE}</p><p>{TWO}</p></div></form></body>", [THREE, TWO]),
        (f"<body><p>x</p><form id='aspnetForm'><div><p>{THREE}</p><p>{TWO}</p></div></form></body>", [THREE, TWO]),
        (f"<body><article><p>{THREE}</p><form><p>Write to us</p></form><p>{TWO}</p></article></body>", [THREE, TWO]),
        (f"<body><div><h1>A</h1><p>{THREE}</p></div><div><h2>B</h2><p>{THREE}</p><p>{ONE}</p></div></body>", ["A", THREE, "B", THREE, ONE]),
        (f"<body><div><h1>A</h1><p>{THREE}</p></div><div><a href='x'>one</a> <a href='y'>two</a> <a href='z'>three</a></div></body>", ["A", THREE]),
        (f"<body><article><h1>T</h1><p>{THREE}</p><section class='search algorithms'><h2>S</h2><p>{TWO}</p></section><p>{ONE}</p></article></body>", ["T", THREE, "S", TWO, ONE]),
        (f"<body><article><h1>T</h1><p>{THREE}</p><div class='related-work'><h2>R</h2><p>{TWO}</p></div><p>{ONE}</p></article></body>", ["T", THREE, "R", TWO, ONE]),
        (f"<body><article><h1>T</h1><p>{THREE}</p><div class='related-posts'><p>Read on</p></div><p>{ONE}</p></article></body>", ["T", THREE, ONE]),
        (f"<body><article><h1>T</h1><p>{THREE}</p><div class='cookie-notice box'><p>We use cookies here.</p></div><p>{ONE}</p></article></body>", ["T", THREE, ONE]),
        (f"<body><article><div class='post-header'><h1>Title</h1></div><div><div><p>{THREE}</p><p>{TWO}</p></div></div></article></body>", ["Title", THREE, TWO]),
        (f"<body><article><header><h1>Title</h1></header><div><div><p>{THREE}</p><p>{TWO}</p></div></div></article></body>", ["Title", THREE, TWO]),
        (f"<body><article><div class='entry-header'><h1>Title</h1></div><p>{THREE}</p></article></body>", ["Title", THREE]),
        (f"<body><header><h1>Site</h1></header><article><p>{THREE}</p></article><section class='comments'><p>{ONE}</p></section></body>", [THREE]),
    ],
)
def test_blocks(page, blocks):
    assert main_text(page) == "\n\n".join(b.strip() for b in blocks)


def test_rows_without_page_id(spark):
    rows = [(None, "u", f"<p>{ONE}</p>", "x"), (1, None, None, "y"), (1, None, None, "y"), (2, "u", "", "z")]
    got = page_texts(spark.createDataFrame(rows, "page_id long, url string, html string, text string")).orderBy(F.col("page_id").asc_nulls_first()).collect()
    assert [(r["page_id"], r["n_chars"]) for r in got] == [(None, len(ONE.strip())), (1, 0), (1, 0), (2, 0)]
