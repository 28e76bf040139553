import numpy as np
import pytest

from tests.pages import SAMPLE, SAMPLE_SIZE, images_of, words_of
from tidemark.operators import layout, raster, reconcile
from tidemark.operators.boxes import Box, Region, Word
from tidemark.operators.reconcile import Page


def words(rows):
    return [Word(k, t, float(c), Box(*map(float, b))) for k, (t, c, *b) in enumerate(rows)]


def texts(anchors):
    return [[w.text for w in a.words] for a in anchors]


def test_sample_headers_and_values(spark):
    w = words(SAMPLE)
    heads = layout.find_anchors(w)
    assert texts(heads) == [["ACTUAL"], ["CHARGED", "WEIGHT"]]
    found = layout.find_values(w, heads, 3024.0)
    assert [(r.text, r.box.x0, r.kind) for r in found] == [("802.91", 937, "actual"), ("802.91", 1407, "charged")]
    pages, sizes = words_of(spark, {"p": SAMPLE}), images_of(spark, {"p": SAMPLE_SIZE})
    assert [(r["anchor_ord"], list(r["words"])) for r in layout.anchors(pages, sizes).orderBy("anchor_ord").collect()] == [(0, ["ACTUAL"]), (1, ["CHARGED", "WEIGHT"])]
    assert [(r["original_text"], r["kind"]) for r in layout.regions(pages, sizes).orderBy("region_ord").collect()] == [("802.91", "actual"), ("802.91", "charged")]


def test_halves_and_far_values():
    assert texts(layout.find_anchors(words([("WEI", 90, 100, 100, 140, 120), ("GHT", 90, 142, 100, 180, 120)]))) == [["WEI", "GHT"]]
    heads = layout.find_anchors(words(SAMPLE[2:5]))
    assert layout.find_values(words([("99.5", 90, 940, 5000, 1080, 5040)]), heads, 3024.0) == []


def test_adjacent_columns_and_damaged_numbers():
    rows = [("ACTUAL", 90, 300, 100, 370, 120), ("WEIGHT", 90, 300, 122, 370, 142), ("CHARGED", 90, 404, 100, 480, 120), ("WEIGHT", 90, 404, 122, 480, 142), ("117.5", 90, 300, 160, 350, 180), ("152.0", 90, 404, 160, 455, 180)]
    w = words(rows)
    heads = layout.find_anchors(w)
    found = layout.find_values(w, heads, 800.0)
    assert [(r.text, r.box.x0, r.kind) for r in found] == [("117.5", 300, "actual"), ("152.0", 404, "charged")]
    w = words([*rows[:2], ("»N.n", 50, 305, 160, 345, 180)])
    assert [r.text for r in layout.find_values(w, layout.find_anchors(w), 800.0)] == ["»N.n"]


def test_values_of_one_row_stay():
    rows = [Region(Box(0, y, 10, y + 10), "1.0", "weight", None) for y in (100, 105, 400)]
    assert [r.box.y0 for r in layout.largest_row(rows, 1000)] == [100, 105]


def page(regions, rows=(), size=(1000.0, 1000.0), grey=None):
    w = words(rows)
    return Page(*size, w, layout.find_anchors(w), regions, grey)


BOTH = [("ACTUAL", 90, 200, 300, 270, 320), ("CHARGED", 90, 320, 300, 400, 320)]


def test_rules_one_by_one():
    r = lambda x, t="12.5", kind="actual", y=350, h=15, anchor="ACTUAL WEIGHT", cell=None: Region(Box(x, y, x + 50, y + h), t, anchor, kind, cell)
    p = page([r(200), r(205), r(320, kind="charged")])
    reconcile.distinct_cells(p)
    assert [x.box.x0 for x in p.regions] == [200, 320]
    p = page([], BOTH)
    reconcile.count_columns(p)
    assert p.expected == 2
    p = page([r(200), r(260, y=500), r(500)])
    reconcile.best_pair(p)
    assert [x.box.x0 for x in p.regions] == [200, 500]
    p = page([r(200, h=90, y=330), r(320)])
    reconcile.line_height(p)
    assert [x.box.x0 for x in p.regions] == [320]
    p = page([r(200, "1"), r(320, "12")])
    reconcile.enough_digits(p)
    assert [x.text for x in p.regions] == ["12"]
    p = page([r(200, "125.5")], [*BOTH, ("125.5", 90, 320, 350, 370, 365)])
    reconcile.equal_sibling(p)
    assert [x.kind for x in p.regions] == ["actual", "charged"] and p.expected == 2
    p = page([r(200), r(210, "1", anchor="inferred weight"), r(320, kind="charged")], BOTH)
    p.expected = 2
    reconcile.one_of_each_kind(p)
    assert [(x.box.x0, x.kind) for x in p.regions] == [(200, "actual"), (320, "charged")]
    p = page([r(200)], [*BOTH[:1], ("SAID", 90, 330, 300, 370, 320), ("CONTAIN", 90, 380, 300, 450, 320)])
    p.expected = 2
    reconcile.one_column_before_goods(p)
    assert p.expected == 1
    p = page([r(200)], BOTH)
    p.expected = 2
    reconcile.missing_partner(p)
    assert [x.kind for x in p.regions] == ["actual", "charged"] and p.regions[1].box.x0 == 320


@pytest.mark.parametrize(
    ("regions", "expected", "matched", "want"),
    [([], 1, False, "unmatched"), ([], 1, True, "id_matched_no_weight_region"), ([], 2, True, "partial_weight_detection"), ([Region(Box(0, 0, 50, 200), "12.5", "w", "actual")], 1, True, "unsafe_weight_geometry"), ([Region(Box(0, 0, 50, 12), "12.5", "w", "actual")], 1, True, "ok")],
)
def test_status_precedence(regions, expected, matched, want):
    p = page(regions)
    p.expected = expected
    assert reconcile.status_of(p, matched)[0] == want


def sheet_of_rules(width=600, height=400, rules=(100, 160, 220), top=110, bottom=300):
    grey = np.full((height, width), 250, np.uint8)
    for x in rules:
        grey[top:bottom, x - 1 : x + 2] = 20
    return grey


def draw(grey, x, y, digits=4, h=10):
    """Digit-like strokes."""
    for k in range(digits):
        grey[y : y + 7, x + 9 * k : x + 9 * k + 4] = 30
        grey[y + 4 : y + h, x + 9 * k + 4 : x + 9 * k + 7] = 30
    return Box(x, y, x + 9 * digits - 3, y + h)


def test_rules_bands_and_boxes():
    grey = sheet_of_rules()
    assert [r.x for r in raster.vertical_rules(grey, 100, 310, 0, 600)] == pytest.approx([100, 160, 220], abs=2)
    drawn = draw(grey, 112, 180)
    bands = raster.ink_bands(grey, (102, 158), 165)
    assert bands and abs(bands[0].top - 180) <= 1
    box = raster.ink_box(grey, bands[0])
    assert abs(box.x0 - drawn.x0) <= 4 and abs(box.x1 - drawn.x1) <= 8


def test_ruled_sibling():
    grey = sheet_of_rules()
    partner = raster.sibling_cell(grey, Region(Box(168, 180, 195, 192), "12.5", "CHARGED WEIGHT", "charged"))
    assert partner.kind == "actual" and partner.cell == (pytest.approx(100, abs=2), pytest.approx(160, abs=2)) and 100 < partner.box.x0 < partner.box.x1 < 160
    assert raster.sibling_cell(sheet_of_rules(rules=(20, 160, 220)), Region(Box(168, 180, 195, 192), "12.5", "CHARGED", "charged")) is None


def test_columns_by_width():
    rules = [raster.Rule(x, 100.0) for x in (200, 420, 520, 620, 660)]
    assert raster.weight_columns(rules, 1600) == [(420, 520), (520, 620)]
    assert raster.weight_columns([raster.Rule(x, 100.0) for x in (250, 350, 450)], 1000) == [(250, 350)]
    assert raster.weight_columns(rules[:2], 1600) == []


def test_cells_under_headers_take_the_printed_row():
    grey = np.full((1000, 1000), 250, np.uint8)
    rows = [("ACTUAL", 90, 200, 300, 270, 320), ("CHARGED", 90, 320, 300, 400, 320), ("55.25", 90, 205, 350, 250, 362)]
    a, b = draw(grey, 205, 350), draw(grey, 325, 351)
    w = words(rows)
    cells = raster.cells_under_headers(grey, layout.find_anchors(w), w)
    assert [c.kind for c in cells] == ["actual", "charged"] and cells[0].text == "55.25" and cells[1].text == ""
    assert abs(cells[0].box.y0 - a.y0) <= 2 and abs(cells[1].box.y0 - b.y0) <= 2
    assert reconcile.settle(Page(1000, 1000, w, layout.find_anchors(w), [], grey)).expected == 2


def test_nothing_is_drawn_on_a_page():
    grey = sheet_of_rules()
    grey.setflags(write=False)
    raster.cells_of_table(grey, [])
    raster.template_kind(grey)
    raster.localise(grey, [Region(Box(110, 180, 150, 192), "1", "w", "actual", (100, 160))], [150])
