"""Long items, repeated pieces, and letters whose form depends on their place."""

import random
import time

from veilframe.llm import leaks


def table(item, text):
    """The last row of the distances of the item to parts of the text that end at each place."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(text, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[-1] + 1))
    return row


def anchored_plainly(item, back, distance):
    row = list(range(len(back) + 1))
    for i, c in enumerate(item, 1):
        last, row = row, [i]
        for j, x in enumerate(back, 1):
            row.append(min(last[j - 1] + (c != x), last[j] + 1, row[-1] + 1))
    return next((j for j, d in enumerate(row) if d <= distance), len(back))


def masks(item):
    out = {}
    for i, c in enumerate(item):
        out[c] = out.get(c, 0) | 1 << i
    return out


def test_items_with_repeated_pieces_equal_brute_force():
    rng = random.Random(4)
    for trial in range(120):
        unit = "".join(rng.choice("ab c") for _ in range(rng.randint(2, 6)))
        item = leaks.fold((unit * 40)[: rng.randint(50, 120)])
        if len(item) < 50:
            continue
        text = list(item)
        for _ in range(rng.randint(0, 12)):
            text[rng.randrange(len(text))] = rng.choice(["", "a", "xx", "c"])
        text = leaks.fold("".join(rng.choice("abc ") for _ in range(rng.randint(0, 80))) + "".join(text) + "".join(rng.choice("abc ") for _ in range(80)))
        matcher = leaks.Matcher([(1, item)], 0.08, 50)
        row, most = table(item, text), int(0.08 * len(item))
        want = (min(row), row.index(min(row))) if min(row) <= most else None
        assert matcher.find(text).get(0) == want, (item, text)
        if want:
            back = text[max(0, want[1] - len(item) - want[0]) : want[1]][::-1]
            assert leaks.anchored(item[::-1], back, want[0], masks(item[::-1])) == anchored_plainly(item[::-1], back, want[0])


def test_a_long_periodic_item_is_found_and_placed_at_once():
    item = leaks.fold("the same twelve words come again and again in this long line. " * 330)[:20_000]
    text = "Before it. " + item[:7000].upper() + "x" + item[7000:] + " After it."
    matcher = leaks.Matcher([(9, item)], 0.08, 50)
    start = time.time()
    hits = matcher.find(leaks.fold(text))
    rows = leaks._placed(5, text, hits, matcher)
    assert time.time() - start < 2
    assert rows == [{"doc_id": 5, "item_id": 9, "distance": 1, "start": 11, "end": 11 + 20_001}]
    start = time.time()
    assert not matcher.find(leaks.fold(("the same twelve words " + "q" * 30) * 500))
    assert time.time() - start < 4


def test_places_of_letters_whose_form_depends_on_their_place():
    text = "Ο ΣΟΦΟΣ  ΟΔΥΣΣΕΥΣ\n İstanbul ǅ ΤΕΛΟΣ."
    folded, places = leaks.folded_offsets(text)
    assert folded == leaks.fold(text) and len(places) == len(folded)
    assert all(text[i].lower().startswith(c) or c in text[i].lower() or text[i] == "Σ" or c == " " for c, i in zip(folded, places))
    rng = random.Random(1)
    for _ in range(200):
        some = "".join(rng.choice("aΣσ İß\n É.ǅ") for _ in range(30))
        assert leaks.folded_offsets(some)[0] == leaks.fold(some)
