"""Page windows: one pass for all pages against a search page by page, and the cases that decide where a page ends."""

import random
import time

from tierscope.functions.windows import Page, Places, folded, page_windows, windows


def by_search(flat, texts):
    """The same windows by searching the flat text for each line of each page."""
    flat = folded(flat)

    def place(text):
        lines = [x for x in map(folded, (text or "").split("\n")) if len(x) >= 24]
        for line in sorted(lines, key=lambda x: -len(x))[:5]:
            for n in (80, 48, 30):
                if len(line) >= n and line[:n] in flat:
                    return flat.index(line[:n])
        return None

    def border(text, start, without=""):
        own = set(map(folded, (without or "").split("\n")))
        spots = [flat.find(x[:60], start) for x in map(folded, (text or "").split("\n")) if len(x) >= 12 and x not in own]
        return min((s for s in spots if s > start), default=None)

    out = []
    for i, text in enumerate(texts):
        before, after = (texts[i - 1] if i else None), (texts[i + 1] if i + 1 < len(texts) else None)
        start = border(text, place(before)) if place(before) is not None else None
        start = place(text) if start is None else start
        if start is None:
            out.append(None)
            continue
        near, far = border(after, start, text), place(after)
        ends = [e for e, ok in ((near, near is not None and near > start + 200), (far, far is not None and far > start), (near, near is not None)) if ok]
        out.append((flat[start : ends[0]], True) if ends else (flat[start : start + min(4000, max(600, 3 * len(folded(text))))], False))
    return out


def document(rng):
    words = ["alpha", "beta", "gamma—delta", "“quoted”", "é", "ใช้", " ", "page"]
    line = lambda: " ".join(rng.choice(words) for _ in range(rng.randrange(0, 30)))
    header = line()
    pages = ["\n".join([header] * rng.randrange(2) + [line() for _ in range(rng.randrange(0, 6))]) for _ in range(rng.randrange(1, 8))]
    flat = "\n".join(p for p in pages if rng.random() < 0.9)
    return flat, [rng.choice([p, p, p, None, p.upper()]) for p in pages]


def test_windows_against_a_search_by_page():
    rng, bounded = random.Random(14), 0
    for _ in range(800):
        flat, pages = document(rng)
        got = windows(flat, pages)
        assert got == by_search(flat, pages)
        bounded += sum(w is not None and w[1] for w in got)
    assert bounded > 300


def test_decisions():
    page, following = "A heading line that is long enough to anchor\nmore of it", "Another page begins with this line\nrest"
    flat = "intro " + page + " tail words " + following
    assert windows(flat, [page, following])[0] == (page.replace("\n", " ") + " tail words ", True)
    assert windows(flat, ["nothing of this page can be found anywhere"]) == [None]
    [(cut, bounded)] = windows("x" * 30 + "y" * 9000, ["x" * 30])
    assert (len(cut), bounded) == (600, False)
    assert windows("a line of 28 characters here", ["a line of 28 characters here"]) == [None], "no line of under 30 characters has a place"
    header = "Running header of the whole report"
    pages = [f"{header}\nPage {i} opens with a line of its own, number {i}{i}\n" + f"Page {i} ends with this much longer closing line, which anchors it well" for i in range(3)]
    text, bounded = windows(" ".join(x.replace("\n", " ") for x in pages), pages)[1]
    assert bounded and text.startswith(header) and "Page 1 ends" in text
    # A paragraph on both pages is no border between them; a line that stands at the begin borders nothing.
    both = "This paragraph goes on over the page break and is on both"
    a, b = Page.of("First line of the first page of two\n" + both), Page.of(both + "\nAnd this is only on the second page")
    assert Places("First line of the first page of two " + both + " And this is only on the second page", [a, b]).border(b, 0, a) == 94
    p = Page.of("abcdefghijklmnop")
    assert Places("abcdefghijklmnop abcdefghijklmnop", [p]).border(p, 0) == -1


def test_many_pages_in_one_pass():
    rng = random.Random(3)
    pages = ["\n".join(f"line {i} {j} " + "".join(rng.choice("abcdefgh ") for _ in range(70)) for j in range(40)) for i in range(500)]
    begun = time.time()
    found = windows("\n".join(pages), pages)  # the first page begins at its own longest line
    assert all(w == (folded(p) + " ", True) for w, p in zip(found[1:-1], pages[1:-1])) and time.time() - begun < 20, "1.6 MB for 500 pages"


def test_windows_of_tables(spark):
    rng = random.Random(15)
    docs = [document(rng) for _ in range(20)] + [("", [None]), (None, ["a page"])]
    flat = spark.createDataFrame([(i, f, "x") for i, (f, _) in enumerate(docs)], "doc_id long, text string, page string")
    pages = spark.createDataFrame([(i, n, t) for i, (_, p) in enumerate(docs) for n, t in enumerate(p)] + [(99, 0, "no text")], "doc_id long, page int, text string").repartition(3)
    got = {(r["doc_id"], r["page"]): None if r["text"] is None else (r["text"], r["bounded"]) for r in page_windows(flat, pages).collect()}
    assert got == {(i, n): w for i, (f, p) in enumerate(docs) for n, w in enumerate(windows(f, p))}
    assert page_windows(flat.limit(0), pages).count() == 0
