"""Slots that say the same on a host's pages."""

from tessara.llm.html_extraction import extract_text


def texts(frame, rows):
    return [r.text for r in extract_text(frame("page_id long, url string, html string", rows)).orderBy("page_id").collect()]


def page(k, menu="Menu words"):
    return f"<div class=top>{menu}</div><div class=body><p>Story {k} begins.</p></div>"


def test_copies_and_odd_pages(frame):
    copies = [(i, "http://copies.example/", page(0)) for i in range(4)]
    null = [(10 + i, None, "plain text") for i in range(3)]
    odd = [(20 + i, f"http://odd.example/{i}", page(i, "Other words" if i == 0 else "Menu words")) for i in range(12)]
    bare = [(40, "http://odd.example/bare", "<div class=top>Menu words</div>")]
    want = ["Menu words Story 0 begins."] * 4 + ["plain text"] * 3 + ["Other words Story 0 begins."] + [f"Story {i} begins." for i in range(1, 12)] + ["Menu words"]
    assert texts(frame, copies + null + odd + bare) == want
