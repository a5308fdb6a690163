"""Text density decides on every page; markup only raises weights and names left-out parts."""

from __future__ import annotations

from ridewave.llm.html_text import main_text
from tests.llm.fixtures import passage

TEXT = [passage(40 + i, 60) for i in range(4)]
BODY = "".join(f"<p>{t}</p>" for t in TEXT)
ALL = "\n\n".join(TEXT)


def test_text_outside_of_teasers_and_comments_stays():
    teaser = "<article class='related-post'><p>" + passage(60, 40) + "</p></article>"
    comment = "<div class='comments'><article><p>" + passage(61, 40) + "</p></article></div>"
    assert main_text(f"<body><div>{BODY}</div>{teaser}{comment}</body>") == ALL
    assert main_text(f"<body><div class='comments'><article>x</article><p>{TEXT[0]}</p></div><div>{BODY}</div></body>") == ALL


def test_only_whole_or_leading_class_tokens_name_a_part():
    for name in ("has-sidebar", "content-with-sidebar", "no-header page"):
        assert main_text(f"<body><div class='{name}'>{BODY}</div></body>") == ALL
    for name in ("sidebar", "sidebar-left", "x comments2", "cookieNotice"):
        assert main_text(f"<body><div class='{name}'><p>{TEXT[0]}</p></div><div>{BODY}</div></body>") == ALL


def test_sparse_lines_beside_an_article_go_and_unclosed_parts_end():
    assert main_text(f"<body><div>Short line</div><article>{BODY}</article><div>Imprint</div></body>") == ALL
    assert main_text(f"<body><nav><a href=x>Menu</a><article>{BODY}</article></body>") == ALL
    assert main_text(f"<body><article>{BODY}<aside>Side<p>more</article></body>") == ALL
